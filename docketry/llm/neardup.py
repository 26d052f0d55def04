"""Near-duplicate documents: MinHash signatures joined by multi-index Hamming search, links confirmed on full sets.

A document's set is its distinct word shingles. Documents with equal sets form a class, which has a number of its own. A
class's signature has positions of 12 bits, each a minimum hash; the distance of two signatures is the number of positions
that differ. The signature is split into chunks. By the pigeonhole principle two signatures within a distance of
chunks * (errors + 1) - 1 have a chunk with at most that many errors (one), so each chunk is entered into the index
once for every choice of positions that may differ, with these left out: equal keys then find *all* pairs under that
distance. For 85 % there are nine chunks of five positions: a pair at the threshold is farther apart than 17 of 45 positions
with a probability of about 4e-5, and one at 0.9 of about 1e-7. For 80 % there are eleven chunks of four: a pair at the
threshold is farther apart than 21 of 44 with a probability of about 1e-5.

All pairs of a bucket are never made. First every class is paired with the least and the greatest class of each of its
buckets; confirmed links are merged into components. Buckets that still hold several components are cut into blocks of
BLOCK classes, and each pair of blocks is compared in one step, in the first bucket that two classes share: classes of
different components whose set sizes, signatures and odd sketches (the parities of SKETCH hashed places, whose difference is
that of the sets but for collisions) allow a link. Pairs that would merge something are handed on and confirmed on full
sets. A pair that its sketches make certain spares those that it makes needless; should one not be confirmed after all, the
comparison is made once more without sparing any. So components are exact for all pairs within the distance.

Nulls and odd rows: a null or wordless text has an empty set, is linked with nothing and is kept; rows are judged one by one,
also where they share a doc_id; equal rows stay or go together; a row with a null doc_id links others, is kept and names
no component; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fan_join, free, lookup
from .components import components
from .shingles import mix, pieces, shingles, words
from .textbytes import as_bytes

WORDS = 5
BITS, ERRORS = 12, 1


@dataclass(frozen=True)
class Index:
    """Sets are linked when 100 * intersection >= percent * union; signatures have chunks * per_chunk positions."""

    percent: int
    chunks: int
    per_chunk: int

    @property
    def positions(self) -> int:
        return self.chunks * self.per_chunk

    @property
    def max_distance(self) -> int:
        return self.chunks * (ERRORS + 1) - 1

    @property
    def columns(self) -> list[str]:
        return [f"s{c}" for c in range(self.chunks)]


CHUNKS, PER_CHUNK = 9, 5
#: The index of the contract query, and that of a similarity of 0.8.
AT_85, AT_80 = Index(85, CHUNKS, PER_CHUNK), Index(80, 11, 4)
POSITIONS, MAX_DISTANCE = AT_85.positions, AT_85.max_distance
#: Classes of a bucket that are compared with as many others at a time, and bits of a sketch.
BLOCK, SKETCH = 512, 2048
#: A sketch rules a pair out, or makes it certain, only from so many standard deviations on.
DEVIATIONS = 6
#: Ids of documents to shingle again are broadcast up to this number; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000

_FACTORS = np.random.default_rng(9).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(data: np.ndarray, off: np.ndarray, index: Index = AT_85, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set size [text], two 64-bit sums that tell sets apart [text, 2], chunks of the signature [text, chunk] and odd sketches [text, SKETCH / 8]."""
    n = len(off) - 1
    size, key, chunks = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, index.chunks), np.int64)
    odd = np.zeros((n, SKETCH // 8), np.uint8)
    for i, j in pieces(off):
        hashes, _, _, first = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        all_, at = shingles(hashes, first, k)
        some = np.flatnonzero(at[1:] > at[:-1])
        if not len(some):
            continue
        for p in range(index.positions):
            least = mix(np.minimum.reduceat(all_ * _FACTORS[p], at[some])) & np.uint64((1 << BITS) - 1)
            chunks[i + some, p // index.per_chunk] |= least.astype(np.int64) << BITS * (p % index.per_chunk)
        for d in some:
            s = np.unique(all_[at[d] : at[d + 1]])
            size[i + d] = len(s)
            mixed = mix(s)
            key[i + d] = s.sum(), mixed.sum()
            odd[i + d] = np.packbits(np.bincount((mixed >> np.uint64(40) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1)
    return size, key.view(np.int64), chunks, odd


def sign(docs: DataFrame, index: Index = AT_85) -> DataFrame:
    """doc_id, h (a hash of the text), n (set size), k1, k2 (equal for equal sets), the chunks and the odd sketch of every row."""
    names = ["doc_id", "h", "n", "k1", "k2", *index.columns]
    schema = pa.schema([*[(c, pa.int64()) for c in names], ("odd", pa.binary())])

    def run(batches):
        for b in batches:
            n, key, chunks, odd = signatures(*as_bytes(b.column("text")), index)
            cols = [n, key[:, 0], key[:, 1], *chunks.T]
            sketch = pa.array([x.tobytes() for x in odd], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *[pa.array(np.ascontiguousarray(c)) for c in cols], sketch], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", odd binary")


def sets(docs: DataFrame) -> DataFrame:
    """k1, k2 and the sorted distinct shingle hashes of every row."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            data, off = as_bytes(b.column("text"))
            for i, j in pieces(off):
                hashes, _, _, first = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                all_, at = shingles(hashes, first, WORDS)
                own = [np.unique(all_[at[d] : at[d + 1]]) for d in range(j - i)]
                key = np.array([(s.sum(), mix(s).sum()) for s in own], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), lists], schema=schema)

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, shingles array<long>")


def _keys(index: Index) -> F.Column:
    """The index keys of a class: each chunk with each choice of ERRORS = 1 positions left out."""
    lanes = [((1 << BITS) - 1) << BITS * v for v in range(index.per_chunk)]
    out = []
    for c in range(index.chunks):
        for v, lane in enumerate(lanes):
            out.append(F.xxhash64(F.lit(c * index.per_chunk + v), F.col(f"s{c}").bitwiseAND(F.lit(~lane))))
    return F.array(*out)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids, and where null is, those without one (or with the least long)."""
    known = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    some = ids.select(known(F.col(ids.columns[0])).alias("id")).distinct()
    some = some.hint("broadcast" if some.count() <= BROADCAST_IDS else "shuffle_hash")
    return docs.select(known(F.col("doc_id").cast("long")).alias("id"), "text").join(some, "id", "left_semi")


def odd_range(difference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation (not less than the true one) of the odd places that differ, for set differences."""
    far = np.exp(-2.0 * difference / SKETCH)
    return SKETCH / 2 * (1 - far), np.sqrt(np.minimum(SKETCH / 4 * (1 - far), difference**2 / SKETCH + difference * 0.05) + 1)


def compare(cid, root, n, chunks, odd, side, key_no: int, index: Index = AT_85, sparing: bool = True) -> list[tuple[int, int, bool]]:
    """Pairs (a, b, certain) of different components that may be links, among classes of two blocks (side 0 and 1; or one block, all on side 2).

    A pair counts only in the bucket of the first key that its classes share, and with sparing not when pairs that are
    certain links by their sketches already join its ends.
    """
    lanes = ((chunks[:, :, None] >> (BITS * np.arange(index.per_chunk))) & ((1 << BITS) - 1)).astype(np.int16)
    parent = {int(r): int(r) for r in root}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, order = [], np.arange(len(cid))
    for i in range(len(cid)):
        js = np.flatnonzero((root != root[i]) & ((side == 1) if side[i] == 0 else (side == 2) & (order > i)))
        js = js[100 * np.minimum(n[js], n[i]) >= index.percent * np.maximum(n[js], n[i])]
        if not len(js):
            continue
        differ = lanes[js] != lanes[i]
        per = differ.sum(2)
        ok = per <= ERRORS
        chunk = ok.argmax(1)
        rows = np.arange(len(js))
        lane = np.where(per[rows, chunk] == 0, 0, differ[rows, chunk].argmax(1))
        js = js[(per.sum(1) <= index.max_distance) & (chunk * index.per_chunk + lane == key_no)]
        if not len(js):
            continue
        most = (n[js] + n[i]) * (100 - index.percent) / (100 + index.percent)  # the set difference of a pair that is just linked
        apart = np.bitwise_count(odd[js] ^ odd[i]).sum(1, dtype=np.int64)
        mean, spread = odd_range(most)
        possible = (apart <= most) & (apart <= mean + DEVIATIONS * spread)
        certain = apart + DEVIATIONS * spread <= mean
        for j, sure in zip(js[possible].tolist(), certain[possible].tolist(), strict=True):
            a, b = find(int(root[i])), find(int(root[j]))
            if a != b:
                out.append((int(min(cid[i], cid[j])), int(max(cid[i], cid[j])), sure))
                if sure and sparing:
                    parent[max(a, b)] = min(a, b)
    return out


def _cross(sides: DataFrame, index: Index, sparing: bool) -> DataFrame:
    """(a, b, sure) from buckets with several components; sides: key, key_no, fan, cid, root, n, chunks and odd."""
    blocks = F.ceil(F.col("fan") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), "cid"), blocks).cast("int")
    at = sides.withColumn("__b", own).withColumn("__o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    at = at.withColumns({"__lo": F.least("__b", "__o"), "__hi": F.greatest("__b", "__o")})
    at = at.withColumn("side", F.when(F.col("__lo") == F.col("__hi"), 2).when(F.col("__b") == F.col("__lo"), 0).otherwise(1)).drop("__b", "__o", "fan")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def run(t):
        got = []
        if t.num_rows > 1:
            col = lambda c: t.column(c).to_numpy()
            odd = np.frombuffer(b"".join(t.column("odd").to_pylist()), np.uint64).reshape(t.num_rows, -1)
            got = compare(col("cid"), col("root"), col("n"), np.stack([col(c) for c in index.columns], 1), odd, col("side"), int(col("key_no")[0]), index, sparing)
        return pa.Table.from_pydict({k: [x[i] for x in got] for i, k in enumerate(schema.names)}, schema=schema)

    return at.groupBy("key", "__lo", "__hi").applyInArrow(run, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, index: Index) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough.

    Only the texts of classes in pairs are shingled again, found by a class's least doc_id and told apart by their sets. A
    class with many pairs is salted on its side of the join.
    """
    pairs = cut(pairs.select("a", "b"))
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    fans = cut(ends.groupBy("cid").agg(F.count("*").alias("fan")).join(classes.select("cid", "k1", "k2", "n", "least"), "cid"))
    full = sets(_only(docs, fans.select("least"))).withColumn("n", F.size("shingles").cast("long"))
    known = cut(full.join(fans.drop("least"), ["k1", "k2", "n"]).dropDuplicates(["cid"]).select("cid", "shingles", "fan"))
    side = lambda x: known.select(F.col("cid").alias(x), F.col("shingles").alias(f"set_{x}"), "fan")
    both = fan_join(fan_join(pairs, side("a"), ["a"], "fan", F.col("b")), side("b"), ["b"], "fan", F.col("a"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", (100 * shared >= index.percent * (F.size("set_a") + F.size("set_b") - shared)).alias("linked")).filter("linked").select("a", "b")


def _open_buckets(member: DataFrame, label: DataFrame) -> DataFrame:
    """key, key_no, fan, cid and root of the classes in buckets that hold several components."""
    named = lookup(member.select("cid", "key", "key_no"), label.select(F.col("node").alias("cid"), "label"), ["cid"], label.count(), F.col("key"), nulls=False)
    named = named.select("cid", "key", "key_no", F.coalesce("label", "cid").alias("root"))
    open_ = named.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("fan")).filter("r1 != r2").select("key", "fan")
    return cut(fan_join(named, open_.withColumn("size", F.col("fan")), ["key"], "fan", F.col("cid")).withColumnRenamed("size", "fan"))


def link_classes(classes: DataFrame, signed: DataFrame, docs: DataFrame, index: Index = AT_85) -> DataFrame:
    """(node, label) of every class that is linked with another; classes has cid, least (doc_id), n, k1, k2 and the chunks, signed the odd sketches."""
    keys = classes.select("cid", F.posexplode(_keys(index)).alias("key_no", "key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("fan"), F.min("cid").alias("low"), F.max("cid").alias("high")).filter("fan > 1")
    member = cut(fan_join(keys, buckets, ["key"], "fan", F.col("cid")))
    ends = member.select("cid", F.explode(F.array("low", "high")).alias("hub")).filter("cid != hub")
    tried = cut(ends.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct())
    links = cut(_confirmed(tried, classes, docs, index))
    label = components(links)
    for sparing in (True, False):
        left = _open_buckets(member, label)
        known = classes.join(left.select("cid").distinct(), "cid", "left_semi")
        sketch = signed.select("k1", "k2", "n", F.col("doc_id").alias("least"), "odd")
        same = [known[c].eqNullSafe(sketch[c]) for c in ("k1", "k2", "n", "least")]
        known = known.join(sketch, same).select("cid", known["n"], *index.columns, "odd").dropDuplicates(["cid"])
        cross = cut(_cross(left.join(known, "cid"), index, sparing))
        new = cut(cross.join(tried, ["a", "b"], "left_anti").select("a", "b"))
        if not new.isEmpty():
            links = cut(links.unionByName(_confirmed(new, classes, docs, index)))
            label = components(links)
        if cross.filter("sure").join(links, ["a", "b"], "left_anti").isEmpty():
            break  # all that was spared for the sake of a certain pair was needless
        tried = tried.unionByName(new)
    return label


def group(docs: DataFrame, index: Index = AT_85) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, component_id (the least doc_id reachable by links), kept, of every row."""
    signed = cut(sign(docs, index))
    classes = signed.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("fan"), *[F.min(c).alias(c) for c in index.columns])
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    label = link_classes(classes.drop("fan"), signed, docs, index)
    linked = classes.select("cid", "k1", "k2", "n", "least", "fan").join(label.select(F.col("node").alias("cid"), "label"), "cid", "left")
    named = linked.filter("label is not null").groupBy("label").agg(F.min("least").alias("first"))
    linked = linked.join(named, "label", "left").withColumn("root", F.coalesce("first", "least"))
    # Only classes whose root isn't their only member's own id need to be looked up.
    several = cut(linked.filter("fan > 1 or not (root <=> least)").select("k1", "k2", "n", "root", "fan"))
    joined = fan_join(signed.select("doc_id", "h", "n", "k1", "k2"), several, ["k1", "k2", "n"], "fan", F.col("doc_id"), "left")
    root = F.coalesce("root", "doc_id")
    return joined.select("doc_id", "h", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, index: Index = AT_85) -> DataFrame:
    """docs with one document of each group; all columns stay."""
    id_, h = free("id", docs.columns), free("h", docs.columns)
    stay = group(docs, index).filter("kept").select(F.col("doc_id").alias(id_), F.col("h").alias(h)).distinct()
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.xxhash64("text").eqNullSafe(F.col(h)), "left_semi")


def op9_near_duplicates(spark, sf_dir) -> DataFrame:
    """Contract query: set size, component and verdict of every document."""
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")
