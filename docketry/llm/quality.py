"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and cut into blocks of STEP; a filter spans SPAN blocks and is applied at every block, so the
windows overlap. Over chunks of CHUNK blocks, which together cover the whole document, each filter's responses are
max-pooled; the chunks' maxima are pooled again by maximum and by mean, and a logistic unit makes one probability of them.
The network is trained by Adam, at first on at most PER_LABEL labelled texts of each class, then on every labelled text: tasks
learn apart from their own texts, from the same network on, and their weights are averaged. Classes weigh by their numbers over all.

Nulls and odd rows: a null text is empty and is scored as such; with no labels at all, or of one class only, every score
is that class's (0.5 without any); repeated rows are scored row by row; an empty table gives an empty result. Labels,
lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, keep_rows
from .shingles import pieces
from .textbytes import as_bytes, averaged, labelled, labelled_sample, trained

PER_LABEL = 500
EPOCHS = 12
#: Adam's rate in the pass over all texts.
RATE = 0.001
STEP, SPAN, CHUNK = 4, 3, 64
EMBED, FILTERS = 8, 24
#: Blocks convolved at a time, so that the working set stays in cache.
AT_ONCE = 1 << 14


def to_blocks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as zero-padded blocks [blocks, STEP] and the first block of each; each text has SPAN - 1 empty blocks after it."""
    size = off[1:] - off[:-1]
    need = np.maximum(1, -(-size // STEP)) + SPAN - 1
    first = np.concatenate([[0], np.cumsum(need)])
    out = np.zeros(first[-1] * STEP, np.uint8)
    for i in range(len(size)):
        at = first[i] * STEP
        out[at : at + size[i]] = data[off[i] : off[i + 1]]
    return out.reshape(-1, STEP), first


def new_model(seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    f = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
    return {"e": f(256, EMBED, k=0.5), "w": f(SPAN, STEP * EMBED, FILTERS, k=0.15), "b": np.zeros(FILTERS, np.float32), "v": f(2 * FILTERS, k=0.1), "c": np.zeros(1, np.float32)}


def convolve(m: dict, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responses [blocks - SPAN + 1, FILTERS] before the non-linearity, and the embedded blocks."""
    x = m["e"].take(blocks.ravel(), axis=0).reshape(len(blocks), STEP * EMBED)
    n = len(blocks) - SPAN + 1
    z = x[:n] @ m["w"][0]
    for k in range(1, SPAN):
        z += x[k : k + n] @ m["w"][k]
    z += m["b"]
    return z, x


def pool(m: dict, blocks: np.ndarray) -> np.ndarray:
    """The pooled features of one document's blocks: maximum and mean of the chunks' maxima."""
    n = len(blocks) - SPAN + 1
    best, total, chunks = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0
    for at in range(0, n, AT_ONCE):
        z, _ = convolve(m, blocks[at : at + AT_ONCE + SPAN - 1])
        whole = len(z) // CHUNK
        parts = [z[: whole * CHUNK].reshape(whole, CHUNK, FILTERS).max(1)] if whole else []
        if len(z) > whole * CHUNK:
            parts.append(z[whole * CHUNK :].max(0, keepdims=True))
        h = np.maximum(np.concatenate(parts), 0)
        best, total, chunks = np.maximum(best, h.max(0)), total + h.sum(0), chunks + len(h)
    return np.concatenate([best, total / max(1, chunks)])


def scores(m: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    if "constant" in m:
        return np.full(len(off) - 1, m["constant"])
    pooled = np.zeros((len(off) - 1, 2 * FILTERS), np.float32)
    for a, b in pieces(off):
        blocks, first = to_blocks(data[off[a] : off[b]], off[a : b + 1] - off[a])
        for i in range(b - a):
            pooled[a + i] = pool(m, blocks[first[i] : first[i + 1]])
    return 1 / (1 + np.exp(-np.clip(pooled @ m["v"] + m["c"][0], -30, 30).astype(np.float64)))


def gradient(m: dict, blocks: np.ndarray, y: float, weight: float, g: dict) -> None:
    """Adds the gradient of one document's weighted log loss to g."""
    z, x = convolve(m, blocks)
    n = len(z)
    starts = np.arange(0, n, CHUNK)
    if n > CHUNK:
        pad = np.full((len(starts) * CHUNK - n, FILTERS), -np.inf, np.float32)
        where = np.concatenate([z, pad]).reshape(len(starts), CHUNK, FILTERS).argmax(1) + starts[:, None]
    else:
        where = z.argmax(0)[None]
    h = np.take_along_axis(z, where, 0)
    on, top = h > 0, h.argmax(0)
    act = np.maximum(h, 0)
    feats = np.concatenate([act.max(0), act.mean(0)])
    p = 1 / (1 + np.exp(-np.clip(float(feats @ m["v"] + m["c"][0]), -30, 30)))
    d = np.float32((p - y) * weight)
    g["v"] += d * feats
    g["c"] += d
    dh = np.broadcast_to(d * m["v"][FILTERS:] / len(h), h.shape).copy()
    dh[top, np.arange(FILTERS)] += d * m["v"][:FILTERS]
    dh *= on
    r, c = np.nonzero(dh)
    if not len(r):
        return
    pos, val = where[r, c], dh[r, c]
    g["b"] += dh.sum(0)
    spread = np.zeros((len(c), FILTERS), dh.dtype)
    spread[np.arange(len(c)), c] = val
    for k in range(SPAN):
        g["w"][k] += x[pos + k].T @ spread
        de = (spread @ m["w"][k].T).reshape(-1, EMBED)
        at = blocks[pos + k].ravel().astype(np.int64)[:, None] * EMBED + np.arange(EMBED)
        g["e"] += np.bincount(at.ravel(), de.ravel(), 256 * EMBED).reshape(256, EMBED).astype(g["e"].dtype)


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, batch: int = 16, seed: int = 1) -> dict:
    """The network from (text, 0 or 1)."""
    ys = np.array([int(y) for _, y in rows])
    if len(rows) == 0 or ys.min() == ys.max():
        return {"constant": float(ys.min()) if len(rows) else 0.5}
    m, rng = new_model(), np.random.default_rng(seed)
    docs = []
    for t, _ in rows:
        raw = np.frombuffer(t.encode("utf-8"), np.uint8)
        docs.append(to_blocks(raw, np.array([0, len(raw)]))[0])
    weight = np.where(ys == 1, 0.5 / (ys == 1).mean(), 0.5 / (ys == 0).mean())
    mean, var, t = {k: np.zeros_like(x) for k, x in m.items()}, {k: np.zeros_like(x) for k, x in m.items()}, 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            g = {k: np.zeros_like(x) for k, x in m.items()}
            part = order[at : at + batch]
            for i in part:
                gradient(m, docs[i], ys[i], weight[i], g)
            t += 1
            for k in m:
                d = g[k] / len(part) + 1e-5 * m[k]
                mean[k] = 0.9 * mean[k] + 0.1 * d
                var[k] = 0.99 * var[k] + 0.01 * d * d
                m[k] -= (rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return m


def refine(first: dict, rows, share: dict[int, int], batch: int = 16) -> tuple[int, np.ndarray]:
    """One pass of Adam over (text, 0 or 1) from first on: the number of texts, and the changes of all weights as one vector.
    share: texts of each class."""
    m, total = {k: x.copy() for k, x in first.items()}, sum(share.values())
    mean, var, t, n = {k: np.zeros_like(x) for k, x in m.items()}, {k: np.zeros_like(x) for k, x in m.items()}, 0, 0
    while part := list(itertools.islice(rows, batch)):
        g = {k: np.zeros_like(x) for k, x in m.items()}
        for text, y in part:
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            gradient(m, to_blocks(raw, np.array([0, len(raw)]))[0], int(y), 0.5 * total / share[int(y)], g)
        n, t = n + len(part), t + 1
        for k in m:
            d = g[k] / len(part) + 1e-5 * m[k]
            mean[k] = 0.9 * mean[k] + 0.1 * d
            var[k] = 0.99 * var[k] + 0.01 * d * d
            m[k] -= (RATE * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return n, np.concatenate([(m[k] - first[k]).ravel() for k in first])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The network from all labelled documents whose fold is not 1."""
    known = labels.filter(fold(F.col("doc_id"), 3) != 1)
    rows = labelled(docs.filter(fold(F.col("doc_id"), 3) != 1), known, "quality")
    share = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    if len(share) < 2:
        return {"constant": float(min(share)) if share else 0.5}
    model = trained(labelled_sample(docs, known, "quality", PER_LABEL), train)
    if "constant" in model:  # the sample's documents of a class are missing
        model = new_model()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n, v = averaged(rows, lambda texts: refine(shared.value, texts, share))
    shared.destroy()
    at = np.cumsum([0, *(x.size for x in model.values())])
    return {k: (x + v[a : a + x.size].reshape(x.shape)).astype(np.float32) for a, (k, x) in zip(at, model.items(), strict=False)} if n else model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row. The network (some 20 kB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(shared.value, *as_bytes(b.column("text"))), pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is at least 0.5; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return keep_rows(docs, lambda b, more: scores(shared.value, *as_bytes(b.column("text"))) >= 0.5)


def op4_quality(spark, sf_dir) -> DataFrame:
    """Contract query: the quality score of every whole text."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = predict(docs, fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
