"""Findings of round 3: what grows is stored once or not shuffled, with the same results."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from docketry.operators import cards, graph
from test_graph_pairs import rows, sig  # noqa: F401


def plan_of(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_f1_fronts_are_kept(spark, sf, sig):  # noqa: F811
    p, every, plans = graph.profiles_of(sig), graph.judge_best(graph.candidate_pairs(sig)), []
    anchors = spark.createDataFrame([("doc:01", 1.0), ("doc:05", 0.8)], "node string, anchor_confidence double")

    def near(nodes):
        plans.append(nodes._jdf.queryExecution().optimizedPlan().toString())
        return graph.judge_best(graph.pairs_at(p, nodes))

    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    assert rows(graph.paths(near, anchors, 3, keep=keep)) == rows(graph.paths(every, anchors, 3))
    assert len(plans) == 3 and not any("Join" in x for x in plans)
    assert plan_of(spark, sf, "ask_chains").count("lineitem.parquet") == 1  # only the types of documents are left to be read


def test_f5_f2_slim_pairs(spark, sig):  # noqa: F811
    p = graph.profiles_of(sig)
    slim, cols = p.drop("node"), ("src", "dst", *graph.KINDS, "hints", "shared")
    want = rows(graph.pairs_of(p), *cols)
    for parts in (None, 7):
        assert rows(graph.pairs_of(slim, wide=None, parts=parts), *cols) == want and want
    for kind in graph.KINDS:
        assert rows(graph.pairs_of(slim, wide=None, kind=kind), *cols) == rows(graph.pairs_of(p).filter(kind), *cols)
    cache = graph.pair_signature(graph.pairs_of(p).filter("tax")).select("pair_key", F.when(F.col("dst_doc") > "20", "old").otherwise(F.col("signature")).alias("signature"))
    got = graph.prepare_requests_of(slim, cache, wide=None, parts=5)
    assert rows(got, "src", "dst", "request_id") == rows(graph.prepare_requests(graph.pairs_of(p), cache), "src", "dst", "request_id")


def test_f5_signals_are_not_shuffled_apart(spark, sf):
    """Signals are told within a document: what is shuffled before the pairs' join are contracts, invoices and nothing else."""
    plan = plan_of(spark, sf, "candidate_pairs")
    assert "hashpartitioning(node" not in plan and plan.count("Exchange hashpartitioning(__k") == 2


def test_f8_new_documents(spark, sf, sig):  # noqa: F811
    new, stored = sig.filter("doc_key < '12'"), sig.filter("doc_key > '07'")
    cols = ("src", "dst", *graph.KINDS, "hints", "shared")
    want = rows(graph.candidates_for(new, stored), *cols)
    slim = lambda s: graph.profiles_of(s).drop("node")
    for parts in (None, 7):
        assert rows(graph.candidates_of(slim(new), slim(stored), parts), *cols) == want and want
    assert "hashpartitioning(src" not in plan_of(spark, sf, "new_doc_candidates")


def test_f6_key_facts_of_documents(spark, sf):
    many = [(f"a{i:02d}", ["备注", "合同金额", "日期"][i % 3], ["甲乙", "12 元", "12 元" + "x" * 40, "2024", "7"][i % 5]) for i in range(30)]
    docs = [("a", many), ("b", [("b2", None, "1"), ("b1", "", "2"), ("b3", "备注", ""), ("b4", "备注", None)]), ("c", [("c2", "备注", "x" * 30 + "1"), ("c1", "备注", "x" * 30 + "2")]), ("d", [])]
    documents = spark.createDataFrame(docs, "doc_key string, facts array<struct<fact_id string, header string, value string>>")
    for limit in (2, 8, 40):
        got = cards.key_facts_of(documents, limit).select("doc_key", F.posexplode("key_facts").alias("i", "f")).select("doc_key", (F.col("i") + 1).alias("place"), "f.*")
        assert rows(got) == rows(cards.key_facts(documents.select("doc_key", F.inline("facts")), limit)) and rows(got)
    assert "Window" not in plan_of(spark, sf, "key_facts")


def test_f7_cards_of_documents(spark, sf):
    docs = spark.createDataFrame([(1, "a", "合同", ""), (2, "b", "合同", ""), (3, "z", "合同", "")], "doc_no int, doc_key string, category string, summary string")
    features = spark.createDataFrame([("a", "x", "1"), ("a", "w", "2")], "doc_key string, code string, value string")
    own = spark.createDataFrame([("a", [("a1", "备注", "甲"), ("a2", "日期", "2024")]), ("b", [("b1", "", "甲")]), ("y", [("y1", "备注", "甲")])], "doc_key string, facts array<struct<fact_id string, header string, value string>>")
    assert rows(cards.load_cards(docs, features, own)) == rows(cards.load_cards(docs, features, own.select("doc_key", F.inline("facts"))))
    assert "Window" not in plan_of(spark, sf, "cards_assembled")
