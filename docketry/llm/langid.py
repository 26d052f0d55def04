"""Language identification with error-correcting output codes over byte n-grams.

Every language gets a codeword of bits. For each bit a binary linear classifier over the text's byte bigrams and
(hashed) trigrams, case folded for A-Z, predicts the bit's margin. Decoding takes the codeword with the least
loss, each bit's logistic loss weighted by that bit's accuracy in training; the score is the decoded language's share
and a small lead over the second is flagged as ambiguous. Training starts from at most PER_LANGUAGE texts of each language and
goes on over every text with a language: tasks learn apart from their own texts and their weights are averaged. Languages weigh
by their numbers, and bits by their accuracy, over all texts.

Nulls and odd rows: a text that is null or has no letter is ``und`` with score 0; so is every text when there is nothing
to learn from, and with one language all others get it; repeated rows are judged row by row; an empty table gives an
empty result. Only doc_id and text are read for a prediction, and doc_id is only carried through.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, keep_rows
from .shingles import pieces
from .textbytes import as_bytes, averaged, labelled_sample, trained

PER_LANGUAGE = 300
EPOCHS = 6
#: Bits of a codeword when there are too many languages for the exhaustive code.
RANDOM_BITS = 31
#: A lead of the best language's share below this is ambiguous.
AMBIGUOUS = 0.2
TABLE = 1 << 16
UND = "und"

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the bigram and the trigram that start at each byte but the last two."""
    b = FOLD[data].astype(np.uint32)
    two = (b[:-1] << 8 | b[1:])[: max(0, len(b) - 2)]
    three = ((two << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16) if len(b) > 2 else two
    return two.astype(np.int32), three.astype(np.int32)


def code_book(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of +1 and -1: every split of the languages while that is short, else random words far apart."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 5:
        cols = [c for c in itertools.product((1.0, -1.0), repeat=k) if c[0] > 0 and min(c) < 0]
        return np.array(cols).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        book = rng.choice((1.0, -1.0), size=(k, RANDOM_BITS))
        gap = min(int((book[i] != book[j]).sum()) for i in range(k) for j in range(i))
        if gap > far and (abs(book.sum(0)) < k).all():
            best, far = book, gap
    return best


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text and their frequencies; trigrams come after the bigrams."""
    data = np.frombuffer(text.ljust(3), dtype=np.uint8)
    two, three = grams(data)
    idx, n = np.unique(np.concatenate([two, three + TABLE]), return_counts=True)
    return idx, (n / len(two)).astype(np.float32)


def trust(accuracy: np.ndarray) -> np.ndarray:
    """The weight of each bit."""
    acc = np.clip(accuracy, 0.5, 0.999)
    return np.log(acc / (1 - acc)) + 0.1


def train(rows: list[tuple[str, str]], names: list[str] | None = None, epochs: int = EPOCHS, seed: int = 3) -> dict:
    """Names, codewords, weights [bit, n-gram], biases and the accuracy of each bit, from (text, language); seen is what refine goes on with."""
    names = sorted({y for _, y in rows}) if names is None else names
    book = code_book(len(names))
    bits = book.shape[1]
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, y in rows:
        raw = text.encode("utf-8")
        if not raw:
            continue
        xs.append(features(raw))
        ys.append(names.index(y))
        if len(raw) > 80:  # short pieces too, so that short texts are known
            for size in (24, 60):
                at = int(rng.integers(0, len(raw) - size))
                xs.append(features(raw[at : at + size]))
                ys.append(names.index(y))
    share = np.bincount(ys, minlength=len(names)) if ys else np.ones(len(names))
    weigh = share.sum() / np.maximum(share, 1) / len(names)
    w, b = np.zeros((2 * TABLE, bits), np.float32), np.zeros(bits, np.float32)
    seen = np.full((2 * TABLE, 1), 1e-6, np.float32)
    for epoch in range(epochs):
        for i in rng.permutation(len(xs)):
            idx, x = xs[i]
            want = book[ys[i]]
            margin = x @ w[idx] + b
            g = (-want / (1 + np.exp(np.clip(want * margin, -30, 30))) * weigh[ys[i]]).astype(np.float32)
            seen[idx, 0] += x * x
            w[idx] -= (x / np.sqrt(seen[idx, 0]))[:, None] * g * (2.0 / (1 + epoch))
            b -= 0.02 * g
    right = np.zeros(bits)
    for (idx, x), y in zip(xs, ys, strict=True):
        right += (x @ w[idx] + b) * book[y] > 0
    return {"names": names, "book": book, "w": np.ascontiguousarray(w.T), "b": b, "trust": trust(right / max(1, len(xs))), "seen": seen}


def refine(model: dict, rows, share: dict[str, int]) -> tuple[int, np.ndarray]:
    """One pass over (text, language) from model on: the number of texts, and one vector of the changes of weights [n-gram, bit]
    and biases and of the share of texts that each bit had right before it learnt from them. share: texts of each language."""
    book, at_name = model["book"], {name: i for i, name in enumerate(model["names"])}
    first = model["w"].T
    w, b, seen, right, n = first.copy(), model["b"].copy(), model["seen"].copy(), np.zeros(book.shape[1]), 0
    total = sum(share.values())
    for text, y in rows:
        raw = text.encode("utf-8")
        if not raw:
            continue
        want, weigh = book[at_name[y]], total / len(share) / share[y]
        n += 1
        parts = [raw]
        if len(raw) > 80:
            parts += [raw[k : k + size] for size in (24, 60) for k in (zlib.crc32(raw, size) % (len(raw) - size),)]
        for part in parts:
            idx, x = features(part)
            margin = x @ w[idx] + b
            if part is raw:
                right += margin * want > 0
            g = (-want / (1 + np.exp(np.clip(want * margin, -30, 30))) * weigh).astype(np.float32)
            seen[idx, 0] += x * x
            w[idx] -= (x / np.sqrt(seen[idx, 0]))[:, None] * g * (2.0 / (1 + EPOCHS))
            b -= 0.02 / (1 + EPOCHS) * g
    return n, np.concatenate([(w - first).ravel(), b - model["b"], right / max(1, n)])


def margins(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Margins [text, bit] of all texts in data, over every byte of each."""
    n, bits = len(off) - 1, len(model["b"])
    out = np.zeros((n, bits), np.float32)
    size = off[1:] - off[:-1]
    long_ = np.flatnonzero(size >= 3)
    if len(long_):
        two, three = grams(data)
        edges = np.stack([off[long_], off[long_ + 1] - 2], 1).ravel()
        last = edges[-1] >= len(two)
        for k in range(bits):
            w = model["w"][k]
            at = w[:TABLE].take(two)
            at += w[TABLE:].take(three)
            out[long_, k] = np.add.reduceat(at, edges[:-1] if last else edges)[::2] / (size[long_] - 2)
    for i in np.flatnonzero((size > 0) & (size < 3)):
        idx, x = features(data[off[i] : off[i + 1]].tobytes())
        out[i] = model["w"][:, idx] @ x
    return out + model["b"]


def decode(model: dict, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language of each text, its share, and its lead over the second."""
    if len(model["names"]) == 1:
        return np.zeros(len(m), int), np.ones(len(m)), np.ones(len(m))
    loss = np.stack([(np.logaddexp(0, -m * c) * model["trust"]).sum(1) for c in model["book"]], 1) / model["trust"].sum()
    z = np.exp(-loss * model["book"].shape[1])
    z /= z.sum(1, keepdims=True)
    order = np.sort(z, 1)
    return z.argmax(1), order[:, -1], order[:, -1] - order[:, -2]


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def judge(model: dict, text, letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is in doubt, of the texts of an Arrow column."""
    n = len(text)
    lang, score, doubt = np.full(n, UND, dtype=object), np.zeros(n), np.ones(n, bool)
    if model["names"] and n:
        data, off = as_bytes(text)
        parts = [margins(model, data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in pieces(off)]
        best, share, lead = decode(model, np.concatenate(parts))
        ok = letters.to_numpy(zero_copy_only=False).astype(bool)
        lang[ok] = np.array(model["names"], dtype=object)[best[ok]]
        score[ok], doubt[ok] = np.clip(share[ok], 0, 1), lead[ok] < AMBIGUOUS
    return lang, score, doubt


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous. The model is broadcast; its size depends on the number of languages only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches):
        for b in batches:
            lang, score, doubt = judge(shared.value, b.column("text"), b.column("letters"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text", has_letter().alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def fit(docs: DataFrame) -> dict:
    """The model from all texts with a lang whose fold is not 2."""
    known = docs.filter(fold(F.col("doc_id"), 4) != 2).filter("lang is not null and text is not null")
    share = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    model = trained(labelled_sample(known, known, "lang", PER_LANGUAGE), lambda rows: train(rows, sorted(share)))
    bits = model["book"].shape[1]
    if bits:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        n, v = averaged(known.select("text", F.col("lang").alias("y")), lambda rows: refine(shared.value, rows, share))
        shared.destroy()
        if n:
            size = 2 * TABLE * bits
            w, b = v[:size].reshape(-1, bits).T, v[size : size + bits]
            model |= {"w": np.ascontiguousarray((model["w"] + w).astype(np.float32)), "b": (model["b"] + b).astype(np.float32), "trust": trust(v[size + bits :])}
    return {k: x for k, x in model.items() if k != "seen"}


def keep(docs: DataFrame) -> DataFrame:
    """docs without those whose text is null or has no letter, or whose language is in doubt; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return keep_rows(docs, lambda b, more: ~judge(shared.value, b.column("text"), more["letters"])[2], letters=has_letter())


def op2_language(spark, sf_dir) -> DataFrame:
    """Contract query: the language of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
