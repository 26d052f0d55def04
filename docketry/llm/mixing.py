"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into hash blocks. The blocks that its target asks for (whole passes over the source,
then a prefix of a seeded block permutation) are its exact quota. The vector of quotas is split down a
binary tree of output shards: each node draws how many blocks of each source go left from the
multivariate hypergeometric distribution, so every shard has about the same mix and the quotas are met
exactly. Each leaf then owns a disjoint run of every source's permuted blocks and shuffles it locally.

The driver holds one total for each source and splits only sums over AT_ONCE sources at a time down the tree; the
sources' own quotas are worked out and dealt in the executors, within what their sum was dealt, which is the same draw.

Nulls and odd rows: a null text has size 0; a null source is a source of its own, last in order; rows
that repeat, or share a doc_id, are mixed row by row; sources of size 0 get target 0; an empty table gives an empty result.
Only doc_id, text and source are read; other columns are carried as they are, and added ones get a name that is free.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free, lookup

BLOCKS = 4096
SHARDS = 64
SEED = 20_17
#: Sources whose blocks one task plans.
AT_ONCE = 256


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its size; the excess goes to the others by weight."""
    total, limit = float(sum(sizes)), [cap * s for s in sizes]
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > limit[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = limit[i]
        left -= sum(limit[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def deal(quotas: np.ndarray, room: np.ndarray, seed: list[int]) -> np.ndarray:
    """quotas[s] blocks of each source dealt to shards of room[shard] blocks in all: an array [shards, sources] whose columns sum to quotas."""
    room = np.asarray(room, dtype=np.int64)
    out = np.zeros((len(room), len(quotas)), dtype=np.int64)
    stack = [(0, len(room), np.asarray(quotas, dtype=np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([*seed, lo, hi])
        left = rng.multivariate_hypergeometric(q, int(room[lo:mid].sum()), method="marginals") if q.sum() else q * 0
        stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def shares(total: int, shards: int) -> np.ndarray:
    """Room of the shards: a node's is cut in proportion to the number of its shards."""
    out, stack = np.zeros(shards, dtype=np.int64), [(0, shards, total)]
    while stack:
        lo, hi, n = stack.pop()
        if hi - lo == 1:
            out[lo] = n
            continue
        mid = (lo + hi) // 2
        left = n * (mid - lo) // (hi - lo)
        stack += [(lo, mid, left), (mid, hi, n - left)]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """quotas[s] blocks of each source dealt evenly to shards."""
    return deal(quotas, shares(int(np.sum(quotas)), shards), [seed])


def sequence(blocks: np.ndarray, words: np.ndarray, goal: float, source: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A source's quota as places of blocks in the order they are drawn, with the takes of each block and its partial need."""
    some = np.flatnonzero(words > 0)
    size = int(words.sum())
    takes, needs = np.zeros(len(blocks), dtype=np.int64), np.zeros(len(blocks), dtype=np.int64)
    if not len(some):
        return some, takes, needs
    whole = int(goal // size)
    rest = round(goal - whole * size)
    order = some[np.random.default_rng([seed, 1, source]).permutation(len(some))]
    ends = np.cumsum(words[order])
    full = int(np.searchsorted(ends, rest, side="right"))
    need = rest - (int(ends[full - 1]) if full else 0)
    takes[some] = whole
    takes[order[:full]] += 1
    if need > 0:
        needs[order[full]] = need
    passes = [some[np.random.default_rng([seed, 2, source, p]).permutation(len(some))] for p in range(whole)]
    return np.concatenate([*passes, order[: full + (need > 0)]]).astype(np.int64), takes, needs


def _of_sources(rows: pd.DataFrame, seed: int):
    """(source_no, its rows in order of blocks, sequence, takes, needs) of every source among rows."""
    for no, g in rows.sort_values(["source_no", "block"]).groupby("source_no", sort=True):
        yield int(no), g, *sequence(g["block"].to_numpy(), g["words"].to_numpy(), float(g["target"].iloc[0]), int(no), seed)


def units(stats: DataFrame, weights: tuple[float, ...], cap: float, shards: int, seed: int) -> DataFrame:
    """For words by (source, block): source_size, target, the block's whole takes, its partial need and its shards."""
    spark = stats.sparkSession
    stats = cut(stats)
    sums = stats.groupBy("source").agg(F.sum("words").alias("size")).collect()  # one row for each source
    sums = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], cap)
    rows = [(r["source"], i, r["size"], float(g)) for i, (r, g) in enumerate(zip(sums, goal, strict=True))]
    totals = spark.createDataFrame(rows, "source string, source_no int, source_size long, target double")
    known = lookup(stats, totals, ["source"], len(rows), F.col("block")).withColumn("part", F.floor(F.col("source_no") / AT_ONCE).cast("int"))
    known = cut(known)

    def places(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "places": [sum(len(seq) for _, _, seq, _, _ in _of_sources(rows, seed))]})

    quota = np.zeros(-(-len(rows) // AT_ONCE), dtype=np.int64)
    for r in known.groupBy("part").applyInPandas(places, "part int, places long").toLocalIterator():  # one row for AT_ONCE sources
        quota[r["part"]] = r["places"]
    room = spark.sparkContext.broadcast(split_tree(quota, shards, seed))  # 8 bytes a shard for AT_ONCE sources

    def dealt(rows: pd.DataFrame) -> pd.DataFrame:
        part, found, out = int(rows["part"].iloc[0]), list(_of_sources(rows, seed)), []
        table = deal(np.array([len(seq) for _, _, seq, _, _ in found], dtype=np.int64), room.value[:, part], [seed, 3, part])
        for k, (_, g, seq, takes, needs) in enumerate(found):
            of = np.repeat(np.arange(shards), table[:, k])  # the shard of each place in the source's sequence
            where: list[list[int]] = [[] for _ in range(len(g))]
            for place, at in enumerate(seq.tolist()):
                where[at].append(int(of[place]))
            out.append(g[["source", "block", "source_size", "target"]].assign(takes=takes, need=needs, shards=where))
        return pd.concat(out)

    return known.groupBy("part").applyInPandas(dealt, "source string, block int, source_size long, target double, takes long, need long, shards array<int>")


def plan_mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), cap: float = 3, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, shards (one for each time it is taken), partial, row.

    A document at the end of a source's last, partial block may be taken in part: then partial words by its last draw. All
    others are taken whole and have partial 0. row is the whole row of docs.
    """
    same = F.xxhash64(F.lit(seed), "doc_id", "text")  # rows that agree in both stand for each other
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        "doc_id",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.pmod(same, F.lit(blocks)).cast("int").alias("block"),
        F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("order"),
    )
    planned = cut(units(base.groupBy("source", "block").agg(F.sum("size").alias("words")), tuple(weights), cap, shards, seed))
    # (source, block) keys are hash blocks: none holds more than a source's 1/blocks of the rows, unless rows repeat.
    known = lookup(base, planned, ["source", "block"], planned.count(), F.col("order"))
    inside = Window.partitionBy("source").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = known.filter("need > 0").withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("need") - F.col("before")))).drop("before")
    all_ = known.filter("need = 0").withColumn("part", F.lit(0).cast("long")).unionByName(edge)
    # The partial draw is the last of its block's shards, so a document outside it loses that one.
    mine = F.when((F.col("need") > 0) & (F.col("part") == 0), F.slice("shards", 1, F.greatest(F.lit(0), F.size("shards") - 1))).otherwise(F.col("shards"))
    return all_.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("takes") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.when(F.col("size") > 0, mine).otherwise(F.array().cast("array<int>")).alias("shards"),
        F.when(F.col("part") < F.col("size"), F.col("part")).otherwise(0).alias("partial"),
        "row",
    )


def draw_mix(docs: DataFrame, plan: DataFrame | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: a row of docs for each time that it is taken, with draw (0, 1, ...), shard, taken (words of this draw,
    the first ones of the text), size, source_size and target, shuffled within each shard. plan: a plan of the same docs."""
    plan = plan_mix(docs, shards=shards, seed=seed) if plan is None else plan
    last = F.col("draw") == F.size("shards") - 1
    words = F.when(last & (F.col("partial") > 0), F.col("partial")).otherwise(F.col("size"))
    added = {"draw": F.col("draw"), "shard": F.col("shard"), "taken": words, "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target")}
    drawn = plan.select("*", F.posexplode("shards").alias("draw", "shard"))
    own = F.xxhash64(F.lit(seed + 2), "shard", "row.doc_id", "row.text", "draw")
    placed = drawn.withColumn("order", own).repartition(shards, "shard", F.pmod("order", F.lit(8))).sortWithinPartitions("shard", "order")
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[v.alias(free(k, docs.columns)) for k, v in added.items()])


def op1_source_mix(spark, sf_dir) -> DataFrame:
    """Contract query: the mix of all documents by weights 5, 2, 1."""
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "shards")
