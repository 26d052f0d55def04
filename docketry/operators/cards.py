"""Index cards, recall by question signals and by evidence class, and exact vector search."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scalar as S


def key_facts(facts: DataFrame, limit: int = 8) -> DataFrame:
    """The facts of each document that a question is most likely to want (W2): money or known fields, then digits, then others."""
    kept = facts.filter("header is not null and header != '' and value != ''")
    rank = F.when(F.col("value").rlike("[元¥￥]") | F.col("header").isin(*L.FIELD_WORDS), 0).when(F.col("value").rlike("[0-9]"), 1).otherwise(2)
    ranked = kept.withColumn("rank", rank)
    same = Window.partitionBy("doc_key", "header", F.substring("value", 1, 30)).orderBy("rank", "fact_id")
    single = ranked.withColumn("__n", F.row_number().over(same)).filter("__n = 1").drop("__n")
    place = F.row_number().over(Window.partitionBy("doc_key").orderBy("rank", "fact_id"))
    return single.withColumn("place", place).filter(F.col("place") <= limit).select("doc_key", "place", "rank", "fact_id", "header", "value")


def key_facts_of(documents: DataFrame, limit: int = 8) -> DataFrame:
    """key_facts of documents that come with their facts (doc_key, facts: fact_id, header, value), one row each: doc_key, key_facts,
    an array of rank, fact_id, header, value in order. Nothing is shuffled; at most limit facts are held beside the document's own."""
    kept = F.filter("facts", lambda f: f["header"].isNotNull() & (f["header"] != "") & (f["value"] != ""))
    rank = lambda f: F.when(f["value"].rlike("[元¥￥]") | f["header"].isin(*L.FIELD_WORDS), 0).when(f["value"].rlike("[0-9]"), 1).otherwise(2)
    ranked = F.sort_array(F.transform(kept, lambda f: F.struct(rank(f).alias("rank"), f["fact_id"].alias("fact_id"), f["header"].alias("header"), f["value"].alias("value"))))
    same = lambda a, b: (a["header"] == b["header"]) & (F.substring(a["value"], 1, 30) == F.substring(b["value"], 1, 30))
    more = lambda got, f: F.when((F.size(got) < limit) & ~F.exists(got, lambda g: same(g, f)), F.array_append(got, f)).otherwise(got)
    # As a generator's output the order is worked out once.
    ordered = documents.select("doc_key", F.explode(F.array(ranked)).alias("__r"))
    return ordered.select("doc_key", F.explode(F.array(F.aggregate("__r", F.slice("__r", 1, 0), more))).alias("key_facts"))


def load_cards(documents: DataFrame, features: DataFrame, facts: DataFrame) -> DataFrame:
    """One card for each document: features and key facts beside its summary (R1, J22); documents: doc_no, doc_key, category, summary.
    facts may be one row a fact, or a document with its facts as key_facts_of takes them."""
    feats = features.groupBy("doc_key").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "code", "value"))), "; ").alias("features"))
    if "facts" in facts.columns:
        line = lambda f: F.concat_ws(": ", f["header"], f["value"])
        keys = key_facts_of(facts).select("doc_key", F.transform("key_facts", line).alias("key_facts")).filter(F.size("key_facts") > 0)
        return documents.join(feats, "doc_key", "left").join(keys, "doc_key", "left")
    keys = key_facts(facts).groupBy("doc_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(": ", "header", "value").alias("t")))), lambda x: x["t"]).alias("key_facts"))
    return documents.join(feats, "doc_key", "left").join(keys, "doc_key", "left")


def card_text(with_facts: bool = True) -> Column:
    parts = ["doc_key", F.coalesce("summary", F.lit("")), F.coalesce("features", F.lit(""))]
    return F.concat_ws(" ", *parts, *([F.array_join(F.coalesce("key_facts", F.array().cast("array<string>")), " ")] if with_facts else []))


def question_signals(question: str) -> list[tuple[str, str, float]]:
    """(kind, needle, weight) of a question: codes, amounts, periods, CJK n-grams and categories."""
    w, q = L.CARD_WEIGHTS, question or ""
    found = {("code", c, w["code"]) for c in re.findall(r"(?:本公司·)?([A-Z]{2}[0-9]{4,}(?:-[0-9]{2})?)", q)}
    found |= {("amount", a, w["amount"]) for a in re.findall(r"[0-9][0-9,]*\.?[0-9]*", q.replace(",", "")) if len(a) >= 4}
    found |= {("period", p, w["period"]) for p in re.findall(r"[0-9]{2,4}\.[0-9]{1,2}\.[0-9]{1,2}\s*[-—~]\s*[0-9]{2,4}\.[0-9]{1,2}\.[0-9]{1,2}", q)}
    for run in re.findall("[一-龥]{2,10}", q):
        grams = {run[i : i + n] for n in L.CARD_GRAMS for i in range(len(run) - n + 1)}
        found |= {("gram", g, w["gram"] + w["gram_char"] * (len(g) - 2)) for g in grams if not g.endswith(L.CARD_STOP)}
    found |= {("category", c, w["category"]) for c in ("发票", "合同", "物流凭证") if c in q}
    return sorted(found)


def score_cards(cards: DataFrame, question: str) -> DataFrame:
    """Cards with their score for the question (R3); the signals of one question become one expression."""
    text = F.col("__text")
    score = F.lit(0.0)
    for kind, needle, weight in question_signals(question):
        where = F.replace(text, F.lit(","), F.lit("")) if kind == "amount" else text
        hit = F.col("category") == needle if kind == "category" else F.contains(where, F.lit(needle))
        score = score + F.when(hit, weight).otherwise(0.0)
    return cards.withColumn("__text", card_text()).withColumn("score", F.round(score, 2)).drop("__text")


def recall(cards: DataFrame, question: str, k: int = 4) -> DataFrame:
    """The k best cards with a score."""
    return score_cards(cards, question).filter("score > 0").orderBy(F.desc("score"), "doc_no").limit(k)


def recall_by_class(cards: DataFrame, classes: list[str], k: int = 3) -> DataFrame:
    """For each evidence class the cards with the most of its words (R5, J19, W4): class, doc_no, doc_key, hits, place."""
    words = [(c, w) for c in classes for w in L.CLASS_HINTS.get(c, (c,))]
    hints = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(w).alias("word")) for c, w in words])
    where = F.concat_ws(" ", "category", "doc_key", F.coalesce("summary", F.lit("")))
    hit = cards.select("doc_no", "doc_key", where.alias("where"), F.explode(hints).alias("h")).filter(F.contains("where", F.col("h.word")))
    counted = hit.groupBy("h.class", "doc_no", "doc_key").agg(F.count("*").alias("hits"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("hits"), "doc_no"))
    return counted.withColumn("place", place).filter(F.col("place") <= k)


def attainment(truth: DataFrame, got: DataFrame) -> DataFrame:
    """Per question, wanted, found and whether all are there (A17); truth and got: question_id, doc_key."""
    have = got.select("question_id", "doc_key", F.lit(1).alias("hit")).distinct()
    return truth.distinct().join(have, ["question_id", "doc_key"], "left").groupBy("question_id").agg(
        F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("*") == F.count("hit")).alias("attained")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_top_k(chunks: DataFrame, query: list[float], k: int = 5, **meta) -> DataFrame:
    """The k chunks nearest to a query vector, after exact filters on columns."""
    for column, value in meta.items():
        chunks = chunks.filter(F.col(column) == F.lit(value))
    q = F.array(*[F.lit(float(x)) for x in query])
    return chunks.withColumn("similarity", F.round(cosine(F.col("embedding"), q), 6)).orderBy(F.desc_nulls_last("similarity"), "vec_id").limit(k)


#: Queries that are sent out at a time, and vectors that a task multiplies with them at a time.
QUERY_BLOCK, ROW_BLOCK = 4096, 1024


def _units(vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dim`` numbers at unit length, and which rows are such; others have no cosine."""
    own = np.fromiter((v is not None and len(v) == dim for v in vectors), bool, len(vectors))
    m = np.zeros((len(vectors), dim))
    if own.any():
        m[own] = np.array([np.asarray(v, np.float64) for v, o in zip(vectors, own, strict=True) if o])
    length = np.sqrt((m * m).sum(axis=1))
    ok = own & (length > 0) & np.isfinite(length)
    return np.divide(m, length[:, None], out=np.zeros_like(m), where=ok[:, None]), ok


def _nearest(wanted: pd.DataFrame, k: int):
    """A function of batches (vec_id, embedding) that gives each query's k nearest of a partition; it holds no more than these."""
    dims = sorted({len(v) for v in wanted["vector"] if v is not None and len(v)})
    asked = [(dim, *_units(list(wanted["vector"]), dim)) for dim in dims]
    ids, low = wanted["query_id"].to_numpy(), np.iinfo(np.int64).min  # a null vec_id comes first among equals

    def run(batches):
        best = np.full((len(ids), 0), -np.inf)
        best_id = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for i in range(0, len(batch), ROW_BLOCK):
                part = batch.iloc[i : i + ROW_BLOCK]
                sim = np.full((len(ids), len(part)), -np.inf)
                for dim, q, q_ok in asked:
                    m, ok = _units(list(part["embedding"]), dim)
                    sim[np.ix_(q_ok, ok)] = np.round(q[q_ok] @ m[ok].T, 6)
                sim, near = np.hstack([best, sim]), np.hstack([best_id, np.broadcast_to(part["vec_id"].fillna(low).to_numpy(np.int64), sim.shape)])
                order = np.lexsort((near, -sim), axis=-1)[:, :k]
                best, best_id = np.take_along_axis(sim, order, 1), np.take_along_axis(near, order, 1)
        flat, flat_id = best.ravel(), pd.Series(best_id.ravel(), dtype="Int64")
        found = pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "vec_id": flat_id.mask(flat_id == low), "similarity": pd.Series(flat, dtype="Float64").mask(pd.Series(flat == -np.inf))})
        yield found

    return run


def vector_top_k_batch(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest chunks (vec_id, embedding) of each query (query_id, vector), exactly: query_id, vec_id, similarity, place.

    Queries go against all chunks in blocks of about QUERY_BLOCK, so what is sent out is bounded: a task multiplies blocks
    of unit vectors and keeps k for each query, and only these meet. Equal similarities are in order of vec_id. A null
    or zero vector, or one of another length, has a null similarity and comes last.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    kind, id_kind = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["vec_id"]
    out = None
    for b in range(blocks):
        wanted = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "vector").toPandas()
        near = chunks.select("vec_id", "embedding").mapInPandas(_nearest(wanted, k), f"query_id {kind}, vec_id {id_kind}, similarity double")
        out = near if out is None else out.unionByName(near)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), F.asc("vec_id")))
    return out.withColumn("place", place).filter(F.col("place") <= k)


def dedupe_documents(hits: DataFrame) -> DataFrame:
    """Documents of retrieved chunks, best chunk first, each once."""
    first = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("similarity"), "vec_id"))
    return hits.withColumn("__n", first).filter("__n = 1").drop("__n")


def truth_check(truth: DataFrame, facts: DataFrame) -> DataFrame:
    """Whether each expected fact (doc_key, header, value) is there."""
    have = facts.select("doc_key", "header", S.strip_space(F.col("value")).alias("bare"), F.lit(True).alias("there")).distinct()
    wanted = truth.withColumn("bare", S.strip_space(F.col("value")))
    return wanted.join(have, ["doc_key", "header", "bare"], "left").withColumn("there", F.coalesce("there", F.lit(False))).drop("bare")
