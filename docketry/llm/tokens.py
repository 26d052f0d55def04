"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at special strings, then into pre-tokens by the tokenizer's pattern. The symbols of a pre-token form a
linked list; a heap holds the adjacent pairs that can merge, by rank and then position; the lowest is popped and merged
again and again. The count is the number of initial symbols minus the merges, so no identifiers are made. Counts of
short pre-tokens are kept in a bounded memo in each Python worker.

Nulls and odd rows: a null text is empty and has no token; repeated rows are counted row by row; an empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import as_bytes

LIMIT = 512
#: Entries of the memo in a worker, and the longest pre-token (characters) that it keeps.
MEMO, MEMO_CHARS = 600_000, 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in keep else chr(256 + extra))
        extra += b not in keep
    return out


class Merges(dict):
    """Token counts of pre-tokens by text; a missing one is worked out."""

    def __init__(self, spec: tuple[dict, list[int]]):
        super().__init__()
        self.pairs, self.first = spec  # (left << 20 | right) -> rank << 20 | merged symbol; the symbol of each byte

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode("utf-8"))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n

    def count(self, piece: bytes) -> int:
        pairs, first = self.pairs, self.first
        sym = [first[b] for b in piece]
        n = left = len(sym)
        if n < 2:
            return n
        heap = []
        get = pairs.get
        for i in range(n - 1):
            m = get(sym[i] << 20 | sym[i + 1])
            if m is not None:
                heap.append((m >> 20, i, m & 0xFFFFF, sym[i], sym[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, new, a, b = pop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            left -= 1
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                m = get(new << 20 | sym[k])
                if m is not None:
                    push(heap, (m >> 20, i, m & 0xFFFFF, new, sym[k]))
            h = prev[i]
            if h >= 0:
                m = get(sym[h] << 20 | new)
                if m is not None:
                    push(heap, (m >> 20, h, m & 0xFFFFF, sym[h], new))
        return left


def load(path: str) -> dict:
    """What counting needs of a byte-level BPE file in the tokenizers library's JSON form."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    pairs = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        pairs.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
    first = [vocab[c] for c in byte_symbols()]
    return {"pairs": pairs, "first": first, "special": [t["content"] for t in spec.get("added_tokens", []) if t["content"]]}


_workers: dict[str, Merges] = {}


def counter(spec: dict, pattern: str, key: str):
    """text -> number of tokens; the memo is shared by all tasks of a worker that use the same key."""
    import regex

    merges = _workers.get(key)
    if merges is None:
        _workers.clear()
        merges = _workers[key] = Merges((spec["pairs"], spec["first"]))
    find, of = regex.compile(pattern).findall, merges.__getitem__
    special = sorted(spec["special"], key=len, reverse=True)
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def count(text: str) -> int:
        if cut is None or not any(s in text for s in special):
            return sum(map(of, find(text)))
        parts = cut(text)
        return len(parts) // 2 + sum(sum(map(of, find(p))) for p in parts[::2] if p)

    return count


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. The vocabulary (bounded by its file) is broadcast."""
    shared, key = docs.sparkSession.sparkContext.broadcast(load(path)), f"{path}\n{pattern}"
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        count = counter(shared.value, pattern, key)
        for b in batches:
            texts = b.column("text")
            _, off = as_bytes(texts)
            n = [count(t) if t else 0 for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(off[1:] - off[:-1], pa.int64()), pa.array(n, pa.int64())], schema=schema)

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir) -> DataFrame:
    """Contract query: bytes and tokens of every whole text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
