"""Benchmark decontamination by latent semantic retrieval, then checks of word order and of the answer.

Passages are windows of two blocks of BLOCK words, one starting at every block, over whole texts. Document frequencies of
all words (in DF_SLOTS hashed slots) come from every document. A randomised SVD of the TF-IDF blocks of every document,
together with all items of the benchmark, weighted alike, gives one latent space of RANK dimensions: tasks sum the sketch
A'A R of a random matrix R, from which the driver takes the leading right singular vectors (Nystroem's formula). The items are projected, and every passage of every document is compared with all items by cosine. Candidates are
confirmed by the longest common subsequence of words around the passage: LCS_SURE of the item's words in order, or LCS_ANSWER
of them with the answer's words too (column ``answer``, else the item's last sentence). A passage whose share of its length
in the benchmark's vocabulary is below the threshold cannot reach it and is skipped.

The cosine alone would lose long items, which no passage resembles, and changed ones. So the checks also run wherever they
can succeed at all: LCS_ANSWER of an item's words in order need that many of them around the passage. An item's words that
are frequent in the corpus are taken as present; the others are looked up in the text, and every passage with enough of
them nearby is checked. No passage that the checks accept is left out.

The benchmark is the query set: its words and items are broadcast, ITEMS of them are compared at a time, and all share one
pass over the texts.

Nulls and odd rows: a null or wordless text or item matches nothing; items that repeat match alike; with no items nothing
is contaminated; rows that repeat are judged row by row; an empty table gives an empty result. Only doc_id and text of
documents and item_id, text and answer of the benchmark are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows
from .shingles import pieces, words
from .textbytes import as_bytes

BLOCK = 16
DF_SLOTS = 1 << 20
#: Tasks that add up the tasks' sketches, a share of the vocabulary each.
ADDING = 8
ITEMS = 4096
RANK, OVERSAMPLE = 128, 16
#: Cosine of candidates; short items get less, as they fill less of a passage.
MIN_COSINE = 0.5
LCS_SURE, LCS_ANSWER, ANSWER = 0.75, 0.55, 0.8
#: How much more frequent a word is taken to be in texts like the item than in all (this steers cost, not results).
LIKE = 3.0
#: Passages projected at a time.
AT_ONCE = 4096

#: Texts are lower-cased. What is not an ASCII letter or digit, nor part of a longer character, is between words.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts and each text's first word."""
    h, _, _, first = words(data, off, GAP)
    return h, first


def blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block of each word, numbered through all texts, and each text's first block."""
    size = first[1:] - first[:-1]
    per = -(-size // BLOCK)
    base = np.concatenate([[0], np.cumsum(per)])
    place = np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], size)
    return np.repeat(base[:-1], size) + place // BLOCK, base


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Blocks that hold a word of each slot, and the number of blocks, over all documents."""
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total, seen = np.zeros(DF_SLOTS + 1, np.int64), False
        for b in batches:
            data, off = as_bytes(b.column("text"))
            for i, j in pieces(off):
                h, first = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                block, base = blocks(first)
                pair = np.unique(block << 20 | (h & np.uint64(DF_SLOTS - 1)).astype(np.int64))
                total[:DF_SLOTS] += np.bincount(pair & (DF_SLOTS - 1), minlength=DF_SLOTS)
                total[DF_SLOTS] += base[-1]
                seen = True
        if seen:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    got = docs.select(F.lower("text").alias("text")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most DF_SLOTS + 1 rows
    out = np.zeros(DF_SLOTS + 1, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out[:DF_SLOTS], int(out[DF_SLOTS])


def benchmark_items(benchmark: DataFrame) -> list[dict]:
    """Items with words: id, word hashes and those of the answer. The benchmark is the stated query set."""
    has_answer = "answer" in benchmark.columns
    out = []
    for r in benchmark.select("item_id", "text", *(["answer"] if has_answer else [])).collect():
        text = (r["text"] or "").lower()
        parts = [p for p in re.split(r"[.!?\n]+", text) if p.strip()]
        answer = ((r["answer"] if has_answer else None) or (parts[-1] if parts else "")).lower()
        raw = [np.frombuffer(x.encode("utf-8"), np.uint8) for x in (text, answer)]
        own, ans = (tokens(x, np.array([0, len(x)]))[0] for x in raw)
        if len(own):
            out.append({"item_id": r["item_id"], "words": own, "answer": ans})
    return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"], len(x["words"])))


class Space:
    """Vocabulary and weights of the items, their TF-IDF rows (sparse), and the passages of texts."""

    def __init__(self, items: list[dict], idf: np.ndarray):
        slots = [(x["words"] & np.uint64(DF_SLOTS - 1)).astype(np.int64) for x in items]
        self.idf = idf
        self.vocab = np.unique(np.concatenate(slots))
        self.dim = np.full(DF_SLOTS, -1, np.int32)
        self.dim[self.vocab] = np.arange(len(self.vocab))
        self.weight = idf[self.vocab].astype(np.float32)
        rows = [np.unique(self.dim[s], return_counts=True) for s in slots]
        self.at = np.cumsum([0, *[len(d) for d, _ in rows]])
        self.dims = np.concatenate([d for d, _ in rows])
        self.values = np.concatenate([n for _, n in rows]).astype(np.float32) * self.weight[self.dims]
        self.norm = np.sqrt(np.add.reduceat(self.values**2, self.at[:-1]))

    def of_items(self, matrix: np.ndarray) -> np.ndarray:
        """The items' rows times a matrix [vocabulary, any]."""
        return np.stack([self.values[a:b] @ matrix[self.dims[a:b]] for a, b in zip(self.at[:-1], self.at[1:], strict=True)])

    def hits(self, h: np.ndarray, first: np.ndarray):
        """Vocabulary hits, their blocks, and each text's first block."""
        dim = self.dim[(h & np.uint64(DF_SLOTS - 1)).astype(np.int64)]
        block, base = blocks(first)
        hit = dim >= 0
        return dim[hit], block[hit], base

    def passages(self, h: np.ndarray, first: np.ndarray):
        """Vocabulary hits and their blocks; then, for the passage from each block, the squared TF-IDF length inside the
        vocabulary and in all, and whether the block is its text's last (then the passage is that block); each text's first block."""
        slot = (h & np.uint64(DF_SLOTS - 1)).astype(np.int64)
        block, base = blocks(first)
        last = np.zeros(base[-1], bool)
        last[base[1:][base[1:] > base[:-1]] - 1] = True
        # A word's weight is its count times its idf, so the words of the two blocks are counted together.
        key, n = np.unique(slot << 32 | block, return_counts=True)
        word, of = key >> 32, key & 0xFFFFFFFF
        square = (self.idf[word] ** 2).astype(np.float64)
        own = square * n * n
        twice = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1] + 1) & ~last[of[:-1]])
        both = 2 * square[twice] * n[twice] * n[twice + 1]
        sums = []
        for some in (self.dim[word] >= 0, np.ones(len(word), bool)):
            one = np.bincount(of[some], own[some], minlength=base[-1])
            joint = some[twice]
            total = one + np.bincount(of[twice][joint], both[joint], minlength=base[-1])
            total[:-1] += np.where(last[:-1], 0, one[1:])
            sums.append(total)
        dim = self.dim[slot]
        hit = dim >= 0
        return dim[hit], block[hit], *sums, last, base


def row_sums(matrix: np.ndarray, dim: np.ndarray, block: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For blocks lo to hi: the sum of the matrix rows of their hits (block must be sorted)."""
    a, b = np.searchsorted(block, [lo, hi])
    out = np.zeros((hi - lo, matrix.shape[1]), np.float32)
    of = block[a:b] - lo
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if b > a else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, b - a))
    for k in range(int(n.max(initial=0))):  # the k-th hits of all blocks, at most BLOCK of them
        at = starts[n > k] + k
        out[of[at]] += matrix[dim[a:b][at]]
    return out


def sketched(docs: DataFrame, space: Space, test: np.ndarray) -> np.ndarray:
    """A'A times a matrix [vocabulary, any], where A has the TF-IDF row of each block of every document."""
    weighted = (space.weight[:, None] * test).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((space, weighted))
    schema = pa.schema([("dim", pa.int32()), ("sums", pa.binary())])

    def run(batches):
        space, weighted = shared.value
        total = np.zeros(weighted.shape, np.float64)
        for b in batches:
            data, off = as_bytes(b.column("text"))
            for i, j in pieces(off):
                dim, block, base = space.hits(*tokens(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                for lo in range(0, int(base[-1]), AT_ONCE):
                    hi = min(lo + AT_ONCE, int(base[-1]))
                    z = row_sums(weighted, dim, block, lo, hi)
                    x, y = np.searchsorted(block, [lo, hi])
                    if y == x:
                        continue
                    order = np.argsort(dim[x:y], kind="stable")
                    d = dim[x:y][order]
                    starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                    total[d[starts]] += np.add.reduceat(z[block[x:y][order] - lo], starts, axis=0)
        some = np.flatnonzero(np.abs(total).sum(1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[k].astype(np.float32).tobytes() for k in some], pa.binary())], schema=schema)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, sums in zip(b.column("dim").to_pylist(), b.column("sums").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(sums, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=schema)

    # Sorted, so that sums don't depend on which task comes first. The driver gets one row for each word of the vocabulary.
    each = docs.select(F.lower("text").alias("text")).mapInArrow(run, "dim int, sums binary")
    out = np.zeros(weighted.shape, np.float64)
    for row in each.repartition(ADDING, "dim").sortWithinPartitions("dim", "sums").mapInArrow(add, "dim int, sums binary").toLocalIterator():
        out[row["dim"]] = np.frombuffer(row["sums"], np.float64)
    return out * space.weight[:, None]


def fit(docs: DataFrame, space: Space, seed: int = 23) -> np.ndarray:
    """Leading right singular vectors [vocabulary, rank] of the TF-IDF blocks of all documents and of the items."""
    v = len(space.vocab)
    r = min(RANK + OVERSAMPLE, v)
    test = np.random.default_rng(seed).standard_normal((v, r)).astype(np.float32)
    sketch = sketched(docs, space, test)
    own = space.of_items(test)
    items = np.zeros((v, r), np.float64)
    np.add.at(items, space.dims, space.values[:, None] * np.repeat(own, np.diff(space.at), axis=0))
    sketch += items * max(1.0, np.linalg.norm(sketch) / max(1e-9, np.linalg.norm(items)))  # the items weigh as much as the documents
    core = test.T @ sketch
    core = (core + core.T) / 2
    val, vec = np.linalg.eigh(core)
    good = val > val.max() * 1e-7 if val.max() > 0 else np.zeros(len(val), bool)
    if not good.any():
        return np.zeros((v, 1), np.float32)
    left, _, _ = np.linalg.svd(sketch @ (vec[:, good] / np.sqrt(val[good])), full_matrices=False)
    return left[:, :RANK].astype(np.float32)


def common_length(masks: dict[int, int], m: int, text: list[int]) -> int:
    """Length of the longest common subsequence of text and the m words that masks has the places of."""
    full = v = (1 << m) - 1
    for at in filter(None, map(masks.get, text)):
        u = v & at
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def places(own: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(own.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Matcher:
    """Checks of a block of items, and their places in the latent space."""

    def __init__(self, space: Space, latent: np.ndarray, items: list[dict]):
        self.space, self.items = space, items
        self.queries = np.ascontiguousarray(latent.T, dtype=np.float32)
        size = np.array([len(x["words"]) for x in items])
        self.least = np.minimum(MIN_COSINE, 0.8 * np.sqrt(size / (2 * BLOCK))).astype(np.float32)
        self.masks = [(places(x["words"]), places(x["answer"])) for x in items]
        self.size = size
        self.fewest = np.array([next(n for n in range(1, m + 1) if n / m >= LCS_ANSWER) for m in size.tolist()])
        self._index()

    def _index(self):
        """The items of each word that is looked up, and how many such words each item needs around a passage.

        The most frequent words are taken as present, as many as make chance hits rarest (by Chernoff's bound).
        """
        self.span = 2 * BLOCK + 2 * self.size
        self.need, word, of = self.fewest.copy(), [], []
        for k, x in enumerate(self.items):
            own, n = np.unique(x["words"], return_counts=True)
            share = np.exp(0.1 - self.space.idf[(own & np.uint64(DF_SLOTS - 1)).astype(np.int64)])  # of the blocks
            met = LIKE * share * self.span[k] / BLOCK
            order = np.argsort(-met / n, kind="stable")
            need = self.fewest[k] - np.concatenate([[0], np.cumsum(n[order])[:-1]])  # with the first 0, 1, ... words given
            left = met.sum() - np.concatenate([[0], np.cumsum(met[order])[:-1]])
            some = np.maximum(need, 1)
            rare = np.where(need > 0, np.where(some > left, some * np.log(some / np.maximum(left, 1e-9)) - some + left, some - left), -np.inf)
            best = int(rare.argmax())
            self.need[k] = need[best]
            given = np.zeros(len(own), bool)
            given[order[:best]] = True
            word.append(own[~given])
            of.append(np.full(np.count_nonzero(~given), k))
        word, of = np.concatenate(word), np.concatenate(of)
        order = np.argsort(word, kind="stable")
        self.looked, at = np.unique(word[order], return_index=True)
        self.item_of, self.item_at = of[order], np.append(at, len(of))
        self.looked_slot = np.zeros(DF_SLOTS, bool)
        self.looked_slot[(self.looked & np.uint64(DF_SLOTS - 1)).astype(np.int64)] = True

    def able(self, h: np.ndarray, first: np.ndarray):
        """(text, item, numbers of passages) wherever enough of an item's words are around a passage."""
        pos = np.flatnonzero(self.looked_slot[(h & np.uint64(DF_SLOTS - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.looked, h[pos]), len(self.looked) - 1)
        same = self.looked[at] == h[pos]
        pos, at = pos[same], at[same]
        n = self.item_at[at + 1] - self.item_at[at]
        item = self.item_of[np.repeat(self.item_at[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pos = np.repeat(pos, n)
        text = np.searchsorted(first, pos, side="right") - 1
        key = np.sort((text * len(self.items) + item) << 32 | pos)
        group, pos = key >> 32, key & 0xFFFFFFFF
        item = group % len(self.items)
        last = np.arange(len(key)) + self.need[item] - 1
        i = np.flatnonzero(last < len(key))
        i = i[(group[last[i]] == group[i]) & (pos[last[i]] - pos[i] < self.span[item[i]])]
        if not len(i):
            return
        text, size = group[i] // len(self.items), self.size[item[i]]
        # Passages whose surroundings, from size words before to size words after, hold the words i to last[i].
        lo = np.maximum(0, -((first[text] + 2 * BLOCK + size - 1 - pos[last[i]]) // BLOCK))
        hi = np.minimum(pos[i] + size - first[text], first[text + 1] - first[text] - 1) // BLOCK
        starts = np.flatnonzero(np.concatenate([[True], group[i][1:] != group[i][:-1]]))
        for a, b in zip(starts, [*starts[1:], len(i)], strict=True):
            some = np.zeros(hi[a:b].max() + 2, np.int64)
            good = lo[a:b] <= hi[a:b]
            np.add.at(some, lo[a:b][good], 1)
            np.add.at(some, hi[a:b][good] + 1, -1)
            if good.any():
                yield int(text[a]), int(item[i[a]]), np.flatnonzero(np.cumsum(some) > 0)

    def around(self, first: np.ndarray, t: int, k: int, at):
        """First and last place of the words around passages."""
        start = first[t] + at * BLOCK
        return np.maximum(first[t], start - self.size[k]), np.minimum(first[t + 1], start + 2 * BLOCK + self.size[k])

    def enough(self, h: np.ndarray, first: np.ndarray, t: int, k: int, at: np.ndarray) -> np.ndarray:
        """The passages around which there are enough of all words of an item, in any order."""
        lo, hi = self.around(first, t, k, at)
        text = h[lo[0] : hi[-1]]
        if len(at) < 8:
            masks, size = self.masks[k][0], int(self.size[k])
            return at if common_length(masks, size, text.tolist()) >= self.fewest[k] else at[:0]
        own, n = np.unique(self.items[k]["words"], return_counts=True)
        where = np.minimum(np.searchsorted(own, text), len(own) - 1)
        pos = np.flatnonzero(own[where] == text)
        word = where[pos]
        order = np.argsort(word, kind="stable")
        pos, ends = pos[order] + lo[0], np.searchsorted(word[order], np.arange(len(own) + 1))
        total = np.zeros(len(at), np.int64)
        for w in range(len(own)):
            p = pos[ends[w] : ends[w + 1]]
            if len(p):
                total += np.minimum(n[w], np.searchsorted(p, hi) - np.searchsorted(p, lo))
        return at[total >= self.fewest[k]]

    def checked(self, h: np.ndarray, first: np.ndarray):
        """(text, item, cosine 0, share in order, share of the answer, contaminated) of every passage that the checks can accept."""
        for t, k, at in self.able(h, first):
            for a in self.enough(h, first, t, k, at).tolist():
                yield self.check(h, first, t, k, 0.0, a)

    def check(self, h, first, t, k, c, at):
        """(text, item, cosine, share in order, share of the answer (0 where it decides nothing), contaminated) of a text's passage."""
        item = self.items[k]
        size = len(item["words"])
        lo, hi = self.around(first, t, k, at)
        text = h[lo:hi].tolist()
        own, answer = self.masks[k]
        order = common_length(own, size, text) / size
        asked = len(item["answer"]) and LCS_ANSWER <= order < LCS_SURE  # the answer decides nothing elsewhere
        ans = common_length(answer, len(item["answer"]), text) / len(item["answer"]) if asked else 0.0
        return t, k, c, order, ans, order >= LCS_SURE or (order >= LCS_ANSWER and ans >= ANSWER)


class Finder:
    """Retrieval in the latent space of all items, and their matchers."""

    def __init__(self, space: Space, basis: np.ndarray, items: list[dict]):
        self.space = space
        self.matrix = (space.weight[:, None] * basis).astype(np.float32)
        latent = space.of_items(basis) / np.maximum(space.norm, 1e-9)[:, None]
        self.matchers = [Matcher(space, latent[at : at + ITEMS], items[at : at + ITEMS]) for at in range(0, len(items), ITEMS)]
        self.least = min(m.least.min() for m in self.matchers)

    def candidates(self, h: np.ndarray, first: np.ndarray):
        """(matcher, text, item, cosine, number of the text's passage) wherever the cosine reaches the item's threshold."""
        dim, block, inside, all_, last, base = self.space.passages(h, first)
        if not len(last):
            return
        norm = np.sqrt(np.maximum(all_, 1e-9))
        able = np.sqrt(inside) >= 0.99 * self.least * norm
        need = able.copy()
        need[1:] |= able[:-1] & ~last[:-1]
        number = np.cumsum(need) - 1  # only blocks of passages that can reach the threshold are projected
        keep = need[block]
        dim, block = dim[keep], number[block[keep]]
        kept = np.flatnonzero(need)
        for lo in range(0, len(kept), AT_ONCE):
            hi = min(lo + AT_ONCE, len(kept))
            sums = row_sums(self.matrix, dim, block, lo, min(hi + 1, len(kept)))
            here = kept[lo:hi]
            z = sums[: hi - lo].copy()
            follows = np.zeros(hi - lo, bool)
            m = min(hi + 1, len(kept)) - lo
            follows[: m - 1] = (kept[lo + 1 : lo + m] == here[: m - 1] + 1) & ~last[here[: m - 1]]
            z[follows] += sums[1:][follows[: m - 1].nonzero()[0]] if follows.any() else 0
            on = able[here]
            here, z = here[on], z[on] / norm[here[on], None].astype(np.float32)
            for matcher in self.matchers:
                cos = z @ matcher.queries
                p, q = np.nonzero(cos >= matcher.least)
                text = np.searchsorted(base, here[p], side="right") - 1
                for t, k, c, at in zip(text.tolist(), q.tolist(), cos[p, q].tolist(), (here[p] - base[text]).tolist(), strict=True):
                    yield matcher, t, k, c, at

    def found(self, h: np.ndarray, first: np.ndarray):
        """(matcher, what check gives) of all candidates and of all passages that the checks can accept."""
        for matcher, t, k, c, at in self.candidates(h, first):
            yield matcher, matcher.check(h, first, t, k, c, at)
        for matcher in self.matchers:
            for hit in matcher.checked(h, first):
                yield matcher, hit


def finder_of(docs: DataFrame, benchmark: DataFrame) -> Finder | None:
    """Retrieval and checks for the benchmark, with statistics and latent space of docs; None without items."""
    items = benchmark_items(benchmark)
    if not items:
        return None
    df, n_blocks = frequencies(docs)
    space = Space(items, np.log((1.0 + n_blocks) / (1.0 + df)).astype(np.float32) + 0.1)
    return Finder(space, fit(docs, space), items)


def judge(finder: Finder | None, text) -> tuple[np.ndarray, list[set], np.ndarray, np.ndarray]:
    """Contaminated, items found, greatest cosine and greatest share in order, of the texts of an Arrow column."""
    data, off = as_bytes(text)
    n = len(off) - 1
    bad, cosine, order, found = np.zeros(n, bool), np.zeros(n), np.zeros(n), [set() for _ in range(n)]
    for i, j in pieces(off) if finder else ():
        h, first = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for matcher, (t, k, c, o, _, hit) in finder.found(h, first):
            t += i
            cosine[t], order[t] = max(cosine[t], c), max(order[t], o)
            if hit:
                bad[t] = True
                found[t].add(matcher.items[k]["item_id"])
    return bad, found, cosine, order


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted, distinct), cosine and in_order (the greatest among candidates of the cosine, and among all passages checked; 0 if none) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(finder_of(docs, benchmark))
    schema = pa.schema([("doc_id", pa.int64()), ("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.int64())), ("cosine", pa.float64()), ("in_order", pa.float64())])

    def run(batches):
        for b in batches:
            bad, found, cosine, order = judge(shared.value, b.column("text"))
            ids = pa.array([sorted(x for x in s if x is not None) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bad), ids, pa.array(cosine), pa.array(order)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).mapInArrow(run, "doc_id long, contaminated boolean, item_ids array<long>, cosine double, in_order double")


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(finder_of(docs, benchmark))
    return keep_rows(docs, lambda b, more: ~judge(shared.value, more["lower"])[0], lower=F.lower("text"))


def op3_decontaminate(spark, sf_dir) -> DataFrame:
    """Contract query: for every document whether it holds benchmark items, and which."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find(docs, benchmark)
