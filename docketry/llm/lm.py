"""Language-model scoring by context-tree weighting over bytes, with the unigram base of the contract.

A byte is eight binary decisions; a decision's context is the bits of the byte so far and the DEPTH bytes before it
(0xFF, which no UTF-8 text holds, stands before the start and is the end symbol). Every node of the context tree, at every
depth, has a Krichevsky-Trofimov estimate from its counts; by the weighting P_w = 1/2 P_e + 1/2 prod P_w(children) each
node's posterior share says how far its own estimate is mixed with those of longer contexts. A context that was never
seen adds nothing, so its parent's estimate stands. The score is log10 of the probability of the text and its end.

Counts are exact and gathered from every training text. Texts are handled in chunks of about CHUNK bytes. A chunk counts its
distinct byte strings of DEPTH + 1 bytes and hands them on, packed, by part: a hash of the three nearest context bytes, so
that a part holds subtrees whole. A part sums its counts, weights its nodes and gives every chunk the costs of the byte
strings that it asked for, in the same order, so no byte string is ever a row of its own. Nodes are exact at every depth.
Only those of two context bytes, of which there are at most 2**24 whatever the input, reach the driver and are broadcast.
A part with very many entries is summed and priced in groups of chunks. Word counts stay distributed: a table of at most
WORD_SLOTS winners by hash is broadcast and the other words are joined.

Nulls and odd rows: a null text is empty and scored as its end alone; without training texts every decision has
probability 1/2 and base counts are 0; repeated rows are scored row by row; an empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fan_join, fold, lookup
from .shingles import mix, pieces, words
from .textbytes import as_bytes

DEPTH = 5
EDGE = 0xFF
#: Depth up to which nodes are broadcast.
TOP = 2
#: Bytes of texts that are handled together, and distinct byte strings that a task of build weighs.
CHUNK, STRINGS = 1 << 24, 500_000
#: Entries of a part that one task sums or prices, and those that wait to be summed.
ENTRIES, MERGE = 8_000_000, 4_000_000
#: Byte strings of a chunk that wait to be counted.
HOLD = 1 << 21
WORD_SLOTS = 1 << 20
#: The end token's place among word hashes.
END_KEY = 0x5EED
#: Bytes after which a task hands on what it has counted.
FLUSH = 1 << 25


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of every symbol of the texts (DEPTH context bytes, then the symbol) and each text's first key and end."""
    size = off[1:] - off[:-1]
    at = np.concatenate([[0], np.cumsum(size + DEPTH + 1)])
    buf = np.full(at[-1], EDGE, np.uint8)
    for i in range(len(size)):
        buf[at[i] + DEPTH : at[i] + DEPTH + size[i]] = data[off[i] : off[i + 1]]
    n = max(0, len(buf) - DEPTH)
    key = np.zeros(n, np.uint64)
    for d in range(DEPTH + 1):
        key <<= np.uint64(8)
        key |= buf[d : d + n]
    return key, at[:-1], at[1:] - DEPTH  # text i has keys at[i] to at[i] + size[i], the last being its end


def own_keys(key: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The keys without those that straddle two texts."""
    ok = np.zeros(len(key), bool)
    for a, b in zip(first, end, strict=True):
        ok[a:b] = True
    return key[ok]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series after a shift."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    half, one = table(n0, _HALF, 0.5), table(n0 + n1, _ONE, 1.0)
    return half + table(n1, _HALF, 0.5) - one - np.log(np.pi)


def table(n: np.ndarray, known: np.ndarray, shift: float) -> np.ndarray:
    """log gamma(n + shift) of whole numbers n: looked up while small, else by the series."""
    small = np.minimum(n, len(known) - 1).astype(np.int64)
    out = known[small]
    big = n >= len(known)
    if big.any():
        out[big] = log_gamma(n[big] + shift)
    return out


_HALF, _ONE = log_gamma(np.arange(1 << 12) + 0.5), log_gamma(np.arange(1 << 12) + 1.0)


def decisions(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node (1 to 255) and the bit of each of the eight decisions of symbols: two arrays [8, symbols]."""
    s = sym.astype(np.int64)
    node = np.stack([(1 << j) | (s >> (8 - j)) for j in range(8)])
    return node, np.stack([(s >> (7 - j)) & 1 for j in range(8)])


def summed(code: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes and the sums of values by code."""
    order = np.argsort(code)
    code = code[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]


def parent(code: np.ndarray, depth: int) -> np.ndarray:
    """Codes (context << 8 | node) of a depth as codes one byte of context shorter."""
    return ((code >> 8) & ((1 << 8 * (depth - 1)) - 1)) << 8 | (code & 255)


def leaves(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the deepest nodes with the numbers of zeros and ones seen."""
    node, bit = decisions(key & np.uint64(255))
    ctx = (key >> np.uint64(8)).astype(np.int64)
    code = (ctx[None] << 8 | node).ravel()
    n = np.broadcast_to(count.astype(np.float64), bit.shape).ravel()
    one = bit.ravel() == 1
    return summed(code, np.where(one, 0, n), np.where(one, n, 0))


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate of a one, share of the node's own estimate, and log P_w; below: the sum of the children's log P_w."""
    own = log_kt(n0, n1)
    p = (n1 + 0.5) / (n0 + n1 + 1)
    if below is None:
        return p, np.ones_like(p), own
    total = np.logaddexp(own, below) - np.log(2)
    return p, np.exp(own - np.log(2) - total), total


def slot(code: np.ndarray, depth: int) -> np.ndarray:
    """The exact names of nodes of a depth among those of all depths."""
    return code | depth << 48


class Nodes:
    """Values by node (named as by slot, in order); none for nodes that were never seen."""

    def __init__(self, at: np.ndarray, value: np.ndarray, none: float):
        self.at, self.value = np.append(at, np.iinfo(np.int64).max), np.append(value, none)

    def find(self, at: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.at, at)
        return np.where(self.at[i] == at, i, len(self.at) - 1)

    def __getitem__(self, at):
        return self.value[self.find(at)]


def count_corpus(docs: DataFrame, grams: bool = True) -> DataFrame:
    """(kind, key, n): word hashes (kind 0) and, if asked for, byte strings (kind 1) of all docs, counted."""
    strings = grams
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def merged(parts):
        return [summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))] if parts else []

    def rows(kind, parts):
        if not parts:
            return
        key, n = merged(parts)[0]
        for at in range(0, len(key), 1 << 18):
            k = key[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[at : at + (1 << 18)])], schema=schema)

    def run(batches):
        found, grams, held = [], [], 0
        for b in batches:
            data, off = as_bytes(b.column("text"))
            found.append((np.array([END_KEY], np.uint64), np.array([b.num_rows])))
            for i, j in pieces(off):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                found.append(np.unique(words(part, at)[0], return_counts=True))
                if strings:
                    grams.append(np.unique(own_keys(*padded(part, at)), return_counts=True))
                held += len(part)
                if len(found) >= 24:
                    found, grams = merged(found), merged(grams)
                if held >= FLUSH:
                    yield from rows(0, found)
                    yield from rows(1, grams)
                    found, grams, held = [], [], 0
        yield from rows(0, found)
        yield from rows(1, grams)

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def deep(key: np.ndarray, n: np.ndarray):
    """Nodes deeper than TOP as (slots, estimates, shares), deepest first; at last those of TOP as (codes, zeros, ones, log P_w of the children)."""
    code, n0, n1 = leaves(key, n)
    below = None
    for depth in range(DEPTH, TOP, -1):
        p, share, total = weigh(n0, n1, below)
        yield slot(code, depth), p, share
        code, n0, n1, below = summed(parent(code, depth), n0, n1, total)
    yield code, n0, n1, below


def by_subtree(grams: DataFrame) -> DataFrame:
    """grams (with key) in partitions that hold subtrees of three context bytes whole, of about STRINGS rows."""
    near = F.col("key").bitwiseAND(F.lit(0xFFFFFF00))  # the three context bytes next to the symbol
    parts = max(int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // STRINGS))
    return grams.repartition(parts, near)


def build(counts: DataFrame, depth: int = DEPTH) -> tuple[Nodes, Nodes]:
    """Estimates and shares (share -1: never seen) of the nodes from the counts of byte strings, either of all nodes or, with depth TOP, of those up to it."""
    schema = pa.schema([("sum_row", pa.bool_()), ("at", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64())])

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        *nodes, (code, n0, n1, below) = deep(t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy())
        for at, p, share in nodes if depth > TOP else ():
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), bool)), pa.array(at), pa.array(p), pa.array(share), pa.array(np.zeros(len(at)))], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(code), bool)), pa.array(code), pa.array(n0), pa.array(n1), pa.array(below)], schema=schema)

    rows = by_subtree(counts.filter("kind = 1").select("key", "n")).mapInArrow(run, "sum_row boolean, at long, a double, b double, c double")
    got = rows.groupBy("sum_row", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).orderBy("at").toArrow()
    sums = got.column("sum_row").to_numpy()
    at, a, b, below = (got.column(x).to_numpy() for x in ("at", "a", "b", "c"))
    found = [(at[~sums], a[~sums], b[~sums])]
    code, n0, n1, below = (x[sums] for x in (at, a, b, below))
    for d in range(TOP, -1, -1):
        p, share, total = weigh(n0, n1, below)
        found.append((slot(code, d), p, share))
        if d:
            code, n0, n1, below = summed(parent(code, d), n0, n1, total)
    return tables(found)


def tables(found: list) -> tuple[Nodes, Nodes]:
    """Estimates and shares of lists of nodes (slots, estimates, shares), the deepest first."""
    at, p, share = (np.concatenate(x) for x in zip(*found[::-1], strict=True))
    return Nodes(at, p, 0.5), Nodes(at, share, -1.0)


class Scorer:
    """log10 probabilities of symbols after their contexts."""

    def __init__(self, tables: tuple[Nodes, Nodes]):
        self.p, self.share = tables

    def work_out(self, key: np.ndarray) -> np.ndarray:
        node, bit = decisions(key & np.uint64(255))
        ctx = (key >> np.uint64(8)).astype(np.int64)
        out = np.zeros(len(key))
        for j in range(8):
            code = ctx << 8 | node[j]
            p, deeper = np.full(len(key), 0.5), np.zeros(len(key), bool)
            for depth in range(DEPTH, -1, -1):
                at = self.p.find(slot(code, depth))
                own, share = self.p.value[at], self.share.value[at]
                p = np.where(deeper, share * own + (1 - share) * p, own)
                deeper = share >= 0
                if depth:
                    code = parent(code, depth)
            out += np.log10(np.where(bit[j] == 1, p, 1 - p))
        return out


class Levels:
    """The decisions of sorted distinct byte strings at every depth from DEPTH to TOP: runs of equal prefixes are the nodes.

    Byte strings that only texts to be scored hold come with count 0; such nodes have weight 1 and change nothing above them.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.own, self.up = {}, {}  # depth -> for each decision (code, zeros, ones, log P_w of the children, run of each key); runs' parents
        count = n.astype(np.float64)
        below = [None] * 8
        for depth in range(DEPTH, TOP - 1, -1):
            nodes, totals = [], []
            for j in range(8):
                prefix = key >> np.uint64(8 - j)
                new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
                start = np.flatnonzero(new)
                ones = np.add.reduceat(count * ((key >> np.uint64(7 - j)) & np.uint64(1)).astype(np.float64), start)
                zeros = np.add.reduceat(count, start) - ones
                code = ((prefix[start] >> np.uint64(j)) << np.uint64(8) | np.uint64(1 << j) | (prefix[start] & np.uint64((1 << j) - 1))).astype(np.int64)
                nodes.append((code, zeros, ones, below[j], (np.cumsum(new) - 1).astype(np.int32), start))
                if depth > TOP:
                    totals.append(weigh(zeros, ones, below[j])[2])
            self.own[depth] = nodes
            if depth == TOP:
                break
            key, at = np.unique(key & np.uint64((1 << 8 * depth) - 1), return_inverse=True)
            count = np.bincount(at, count)
            self.up[depth], below = [], []
            for j in range(8):
                prefix = key >> np.uint64(8 - j)
                run = np.cumsum(np.concatenate([[False], prefix[1:] != prefix[:-1]]))
                to = run[at[nodes[j][5]]]
                self.up[depth].append(to)
                below.append(np.bincount(to, totals[j], minlength=int(run[-1]) + 1))

    def sums(self):
        """(codes, zeros, ones, log P_w of the children) of the nodes of depth TOP."""
        return [np.concatenate([x[k] for x in self.own[TOP]]) for k in range(4)]

    def cost(self, key: np.ndarray, top: dict) -> np.ndarray:
        """log10 probability of each key, from the mixtures at depth TOP (see mixtures)."""
        out = np.zeros(len(key))
        for j in range(8):
            at = np.searchsorted(top["code"], self.own[TOP][j][0])
            acc, rest, full = (top[k][at] for k in ("acc", "rest", "full"))
            for depth in range(TOP + 1, DEPTH + 1):
                _, zeros, ones, below, _, _ = self.own[depth][j]
                to = self.up[depth][j]
                acc, rest, full = step(zeros, ones, below, acc[to], rest[to], full[to])
            bit = (key >> np.uint64(7 - j)) & np.uint64(1)
            p = full[self.own[DEPTH][j][4]]
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def step(zeros, ones, below, acc, rest, full):
    """One depth down: what shorter contexts have given, the weight left for longer ones, and the mixture if this is the deepest node that was seen."""
    p, share, _ = weigh(zeros, ones, below)
    seen = zeros + ones > 0
    return np.where(seen, acc + rest * share * p, acc), np.where(seen, rest * (1 - share), 0.0), np.where(seen, acc + rest * p, full)


def mixtures(code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> dict:
    """For the nodes of depth TOP (at most 2**24, whatever the input): code, acc, rest and full as in step."""
    levels = []
    for depth in range(TOP, -1, -1):
        _, _, total = weigh(zeros, ones, below)
        if depth:
            up, to = np.unique(parent(code, depth), return_inverse=True)
            levels.append((code, zeros, ones, below, to))
            code, zeros, ones, below = up, np.bincount(to, zeros), np.bincount(to, ones), np.bincount(to, total)
        else:
            levels.append((code, zeros, ones, below, np.zeros(len(code), np.int64)))
    acc, rest, full = np.zeros(1), np.ones(1), np.full(1, 0.5)
    for code, zeros, ones, below, to in levels[::-1]:
        acc, rest, full = step(zeros, ones, below, acc[to], rest[to], full[to])
    return {"code": code, "acc": acc, "rest": rest, "full": full}


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of a byte string, by its three nearest context bytes, so that subtrees deeper than TOP are whole."""
    return (mix((key >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)


def chunk_keys(t: pa.Table, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct byte strings of a chunk's texts and how often its training texts hold them (or none, if not counted)."""
    data, off = as_bytes(t.column("text").combine_chunks())
    learn = t.column("learn").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    found, waiting, size, none = [], ([], []), 0, np.zeros(0, np.uint32)
    spans = list(pieces(off))
    for i, j in spans:
        key, first, end = padded(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for d in range(j - i):
            waiting[int(learn[i + d])].append(key[first[d] : end[d]])
        size += len(key)
        if size >= HOLD or j == spans[-1][1]:
            for side, keys in enumerate(waiting):
                if keys and counted:
                    k, n = np.unique(np.concatenate(keys), return_counts=True)
                    found.append((k, (n * side).astype(np.uint32)))
                elif keys:
                    found.append((np.unique(np.concatenate(keys)), none))
            waiting, size = ([], []), 0
            if counted and sum(len(k) for k, _ in found[1:]) >= MERGE:
                found = [summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))]
    if not counted:
        return np.unique(np.concatenate([k for k, _ in found])), none
    key, n = summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
    return key, n.astype(np.int64)


def blob_keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings and counts of rows of packed ones, summed; at most MERGE entries wait to be summed."""
    key, n, held, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    rows = list(zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True))
    for i, (k, c) in enumerate(rows):
        held.append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)))
        waiting += len(held[-1][0])
        if waiting >= MERGE or i == len(rows) - 1:
            key, n = summed(np.concatenate([key, *[x for x, _ in held]]), np.concatenate([n, *[x for _, x in held]]))
            held, waiting = [], 0
    return key, n


BLOB = "part int, salt int, entries long, keys binary, counts binary"
BLOB_SCHEMA = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("entries", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def packed(part: int, salt: int, key: np.ndarray, n: np.ndarray) -> dict:
    return {"part": part, "salt": salt, "entries": len(key), "keys": key.tobytes(), "counts": n.astype(np.int64).tobytes()}


def by_chunk(chunked: DataFrame, parts: int) -> DataFrame:
    """The packed byte strings of each chunk by part; salt is the chunk."""

    def run(t):
        key, n = chunk_keys(t)
        part = part_of(key, parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        chunk, out = t.column("chunk")[0].as_py(), []
        for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            own = order[ends[p] : ends[p + 1]]
            out.append(packed(p, chunk, key[own], n[own]))
        return pa.Table.from_pylist(out, schema=BLOB_SCHEMA)

    return chunked.select("chunk", "text", "learn").groupBy("chunk").applyInArrow(run, BLOB)


def splits(blobs: DataFrame) -> tuple[DataFrame, int]:
    """The parts with more than ENTRIES entries, and into how many groups they are split."""
    big = blobs.groupBy("part").agg(F.ceil(F.sum("entries") / ENTRIES).cast("int").alias("groups")).filter("groups > 1")
    big = cut(big)
    return big, big.count()


def salted(blobs: DataFrame, big: DataFrame, n: int) -> DataFrame:
    """blobs with their group of a part that is split."""
    found = lookup(blobs, big, ["part"], n, F.col("salt"))
    return found.withColumn("group", F.when(F.col("groups") > 1, F.pmod(F.xxhash64("salt"), F.col("groups"))).otherwise(0).cast("int")).drop("groups")


def merged(blobs: DataFrame) -> DataFrame:
    """One packed row for each part, with its nodes of depth TOP. A part with many entries is summed group by group until its distinct ones are left."""
    tops = [("code", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("below", pa.float64())]

    def some(t):
        key, n = blob_keys(t)
        return pa.Table.from_pylist([packed(t.column("part")[0].as_py(), t.column("group")[0].as_py(), key, n)], schema=BLOB_SCHEMA)

    def all_(t):
        key, n = blob_keys(t)
        row = pa.Table.from_pylist([packed(t.column("part")[0].as_py(), 0, key, n)], schema=BLOB_SCHEMA)
        for (name, kind), x in zip(tops, Levels(key, n).sums(), strict=True):
            row = row.append_column(name, pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)))
        return row

    before = None
    while True:
        big, n = splits(blobs)
        size = lookup(blobs, big, ["part"], n, F.col("salt")).filter("groups > 1").agg(F.sum("entries")).first()[0] if n else 0
        if not n or before is not None and size > 0.9 * before:
            schema = BLOB + ", code array<long>, zeros array<double>, ones array<double>, below array<double>"
            return cut(blobs.groupBy("part").applyInArrow(all_, schema))
        blobs, before = cut(salted(blobs, big, n).groupBy("part", "group").applyInArrow(some, BLOB)), size


def top_nodes(whole: DataFrame) -> dict:
    """The mixtures of the nodes of depth TOP, from those of every part."""
    each = whole.select(F.inline(F.arrays_zip("code", "zeros", "ones", "below")))
    got = each.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).orderBy("code").toArrow()
    return mixtures(*[got.column(c).to_numpy() for c in ("code", "zeros", "ones", "below")])


def costs(blobs: DataFrame) -> DataFrame:
    """(chunk, part, cost): the packed log10 probabilities (4 bytes each) of each chunk's byte strings, in their order.

    A part's nodes go once to each of its groups of chunks, so a subtree that many chunks ask for is priced in several tasks.
    """
    whole = merged(blobs)
    shared = blobs.sparkSession.sparkContext.broadcast(top_nodes(whole))
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("cost", pa.binary())])

    def run(nodes, asked):
        if not asked.num_rows:
            return pa.Table.from_pylist([], schema=schema)
        key, n = blob_keys(nodes)
        cost = Levels(key, n).cost(key, shared.value).astype(np.float32)
        out = []
        for salt, k in zip(asked.column("salt").to_pylist(), asked.column("keys").to_pylist(), strict=True):
            out.append({"chunk": salt, "part": asked.column("part")[0].as_py(), "cost": cost[np.searchsorted(key, np.frombuffer(k, np.uint64))].tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    big, n = splits(blobs)
    nodes = lookup(whole, big, ["part"], n, F.col("part")).withColumn("group", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1))).select("part", "group", "keys", "counts")
    asked = salted(blobs, big, n).select("part", "salt", "group", "keys")
    return nodes.groupBy("part", "group").cogroup(asked.groupBy("part", "group")).applyInArrow(run, "chunk int, part int, cost binary")


def score_texts(data: np.ndarray, off: np.ndarray, keys: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Scores of texts by the costs of their byte strings (keys in order)."""
    out = np.zeros(len(off) - 1)
    for i, j in pieces(off):
        key, first, end = padded(data[off[i] : off[j]], off[i : j + 1] - off[i])
        order = np.argsort(key)  # sorted, they are found next to each other
        logs = np.empty(len(key), np.float32)
        logs[order] = cost[np.minimum(np.searchsorted(keys, key[order]), len(keys) - 1)]  # keys across two texts are not used
        for d in range(j - i):
            out[i + d] = logs[first[d] : end[d]].sum(dtype=np.float64)
    return out


def word_table(counts: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, int, int]:
    """Word counts by key, the broadcast table's keys and counts (the most frequent word of each slot), N and V."""
    found = counts.filter("kind = 0").select("key", "n", F.col("key").bitwiseAND(F.lit(WORD_SLOTS - 1)).alias("slot"))
    total = found.agg(F.sum("n").alias("N"), F.count("*").alias("V")).first()
    best = cut(found.groupBy("slot").agg(F.max(F.struct("n", "key")).alias("w")).select("slot", "w.key", "w.n"))
    got = best.toArrow()  # at most WORD_SLOTS rows
    keys, n = np.zeros(WORD_SLOTS, np.uint64), np.zeros(WORD_SLOTS, np.int64)
    at = got.column("slot").to_numpy()
    keys[at], n[at] = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    others = found.join(best.select("slot", F.col("key").alias("winner")), "slot").filter("key != winner").select("key", "n")
    return others, keys, n, total["N"] or 0, total["V"] or 0


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of docs, with models of training."""
    row = lambda df, learn, wanted: df.select(F.col("doc_id").cast("long"), "text", F.lit(learn).alias("learn"), F.lit(wanted).alias("wanted"))
    return score_rows(row(docs, False, True).unionByName(row(training, True, False)))


def score_rows(rows: DataFrame) -> DataFrame:
    """What score gives, of the rows (doc_id, text, learn, wanted) that are wanted, with models of those to learn from."""
    spark = rows.sparkSession
    counts = cut(count_corpus(rows.filter("learn"), grams=False))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-total // CHUNK)))).cast("int").alias("chunk")
    chunked = rows.select("doc_id", "text", "learn", "wanted", at)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK))
    blobs = cut(by_chunk(chunked, parts))
    priced = costs(blobs)
    others, top_keys, top_n, N, V = word_table(counts)
    shared = spark.sparkContext.broadcast((top_keys, top_n))
    names = "doc_id long, n_bytes long, n_tokens long, known long, logs double, score double, rare array<long>, times array<long>"
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_bytes", "n_tokens", "known")], ("logs", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(left, right):
        return pa.Table.from_batches(list(batches(left, right)), schema=schema)

    def batches(left, right):
        top_keys, top_n = shared.value
        if not left.num_rows:
            return
        keys, _ = chunk_keys(left, counted=False)
        cost = np.zeros(len(keys), np.float32)
        order = np.argsort(part_of(keys, parts), kind="stable")
        blobs = sorted(zip(right.column("part").to_pylist(), right.column("cost").to_pylist(), strict=True))
        cost[order] = np.frombuffer(b"".join(c for _, c in blobs), np.float32)
        left = left.filter(left.column("wanted"))
        log_n = np.log10(top_n + 0.5)
        none = np.log10(0.5)
        end = END_KEY & (WORD_SLOTS - 1)
        end_in = int(top_keys[end]) == END_KEY and top_n[end] > 0
        for b in left.combine_chunks().to_batches():
            data, off = as_bytes(b.column("text"))
            scores = score_texts(data, off, keys, cost)
            for i, j in pieces(off):
                h, _, _, first = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                at = (h & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
                hit = (top_keys[at] == h) & (top_n[at] > 0)
                empty = top_n[at] == 0  # no word of training has this slot, so neither is this one
                logs = np.where(hit, log_n[at], np.where(empty, none, 0.0))
                m = j - i
                tokens, known, sums, rare, times = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), [], []
                for d in range(m):
                    x, y = first[d], first[d + 1]
                    left = h[x:y][~(hit[x:y] | empty[x:y])]
                    left = np.append(left, np.uint64(END_KEY)) if not end_in else left
                    k, c = np.unique(left, return_counts=True)
                    rare.append(k)
                    times.append(c)
                    tokens[d] = y - x + 1
                    known[d] = np.count_nonzero(hit[x:y]) + end_in
                    sums[d] = logs[x:y].sum() + (log_n[end] if end_in else 0.0)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in rare])]), pa.int32())
                size = off[i + 1 : j + 1] - off[i:j]
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(z).view(np.int64), pa.int64())) for z in (rare, times)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, m), pa.array(size), pa.array(tokens), pa.array(known), pa.array(sums), pa.array(scores[i:j]), *lists], schema=schema)

    scored = cut(chunked.groupBy("chunk").cogroup(priced.groupBy("chunk")).applyInArrow(run, names)).withColumn("row", F.monotonically_increasing_id())
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
    met = fan_join(rare, others.withColumn("fan", F.col("n")), ["key"], "fan", F.col("row"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = met.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("l"))
    all_ = scored.drop("rare", "times").join(more, "row", "left")
    norm = float(np.log10(N + 0.5 * (V + 1)))
    return all_.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(N).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("l", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op5_context_tree(spark, sf_dir) -> DataFrame:
    """Contract query: base and context-tree score of every whole text, learned from the texts whose fold is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = fold(F.col("doc_id"), 5) != 1
    out = score_rows(docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(learn, F.lit(False)).alias("learn"), F.lit(True).alias("wanted")))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
