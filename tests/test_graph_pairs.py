"""Questions on pairs and edges are answered where a pair is met: the same as from stored edges, without a shuffle of pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docketry.operators import graph

SIGNAL = "node string, doc_key string, kind string, value string"


@pytest.fixture(scope="module")
def sig(spark):
    rnd = random.Random(7)
    rows = {(f"doc:{d:02d}", f"{d:02d}", rnd.choice(graph.KINDS), str(rnd.randrange(6))) for d in range(30) for _ in range(rnd.choice((1, 3, 9)))}
    return spark.createDataFrame(sorted(rows), SIGNAL)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def unshuffled(spark, sf, name):
    """The query's plan has the pairs' join and no exchange by the columns of a pair."""
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Join \[__k", plan)
    return not re.search(r"Exchange hashpartitioning\((src|dst|least|pair_key|edge_id|_w)", plan)


def test_f1_pairs_equal_brute_force(spark, sig):
    have = {}
    for node, _, kind, value in sig.collect():
        have.setdefault(node, set()).add(f"{kind}={value}")
    want = [(a, b, sorted(have[a] & have[b])) for a in sorted(have) for b in sorted(have) if a < b and have[a] & have[b]]
    p = graph.profiles_of(sig)
    for wide in (None, 0, 2, 64):
        got = graph.pairs_of(p, ["signals"], wide)
        assert rows(got, "src", "dst", "shared") == sorted(want, key=repr)
        assert all(sorted(have[r["src"]]) == r["src_signals"] and sorted(have[r["dst"]]) == r["dst_signals"] for r in got.collect())


@pytest.mark.parametrize("name", ["edge_confidence", "edge_counts", "document_deleted", "edge_verdict"])
def test_f1_f2_f11_f13_edges_not_stored(spark, sf, name):
    assert unshuffled(spark, sf, name)


def test_f3_labels(spark, sf, sig):
    labels = spark.createDataFrame([("doc:01", "x"), ("doc:01", "y"), ("doc:02", None), ("doc:03", "z")], "node_id string, label string")
    edges = graph.judge(graph.candidate_pairs(sig))
    cols = ("edge_id", "src_label", "dst_label")
    assert rows(graph.judge_labelled(graph.profiles_of(sig), labels), *cols) == rows(graph.with_labels(edges, labels), *cols)
    assert unshuffled(spark, sf, "edge_labels")


def test_f4_f12_best_and_conflicts(spark, sf, sig):
    pairs = graph.candidate_pairs(sig)
    edges, cols = graph.judge(pairs), ("edge_id", "relation", "confidence", "status")
    assert rows(graph.judge_best(pairs), *cols) == rows(graph.best_edges(edges), *cols)
    assert rows(graph.judge_conflicts(pairs), *cols, "conflict") == rows(graph.flag_conflicts(edges), *cols, "conflict")
    assert unshuffled(spark, sf, "edge_ownership") and unshuffled(spark, sf, "edge_conflicts")


def test_f5_unknown_relations_not_joined(spark, sig):
    requests = graph.candidate_pairs(sig).withColumn("request_id", graph.request_id(F.lit("doc_doc"), F.col("src"), F.col("dst")))
    replies = requests.select("request_id", F.when(F.col("amount"), "amount_consistent").otherwise("friends").alias("relation"))
    got = graph.ingest_replies(requests, replies)
    assert rows(got, "edge_id") == rows(graph.judge(requests).filter("relation = 'amount_consistent'"), "edge_id")
    assert re.search(r"Filter .*amount_consistent,table_row_matches_doc", got._jdf.queryExecution().optimizedPlan().toString())


def test_f6_requests(spark, sf, sig):
    pairs = graph.candidate_pairs(sig)
    cache = graph.pair_signature(pairs.filter("counterparty")).select("pair_key", F.when(F.col("dst_doc") > "20", "old").otherwise(F.col("signature")).alias("signature"))
    want = rows(graph.prepare_requests(pairs, cache), "src", "dst", "request_id")
    assert rows(graph.prepare_requests_of(graph.profiles_of(sig), cache), "src", "dst", "request_id") == want and want
    assert unshuffled(spark, sf, "requests_prepared")


def test_f8_justified(spark, sf):
    docs = [("a", [("a1", "金额", "1,200.00"), ("a2", "合同编号", "HT-1")]), ("b", [("b2", "金额", "1200.00"), ("b1", "备注", "共1200.00")]), ("c", [("c1", "合同金额", "1200")])]
    documents = spark.createDataFrame(docs, "doc_key string, facts array<struct<fact_id string, header string, value string>>")
    facts = documents.select("doc_key", F.inline("facts"))
    pairs = graph.candidate_pairs(graph.signals(facts))
    edges = graph.judge(pairs, "shared").filter("relation = 'amount_consistent'")
    got = rows(graph.judge_justified(graph.profiles(documents, proofs=True), "amount_consistent"))
    assert got == rows(graph.justify(edges, facts), "edge_id", "side", "fact_id") and got
    assert unshuffled(spark, sf, "edges_justified")


def test_f7_f9_f10_edges_at_nodes(spark, sig):
    p, every = graph.profiles_of(sig), graph.judge_best(graph.candidate_pairs(sig))
    at = spark.createDataFrame([("doc:01",), ("doc:05",)], "node string")
    near = lambda nodes: graph.judge_best(graph.pairs_at(p, nodes))
    assert rows(near(at), "edge_id") == rows(every.filter("src in ('doc:01', 'doc:05') or dst in ('doc:01', 'doc:05')"), "edge_id")
    anchors = at.withColumn("anchor_confidence", F.lit(1.0))
    assert rows(graph.paths(near, anchors, 2)) == rows(graph.paths(every, anchors, 2))


def test_f15_hours_of_the_nearest_second(spark, tmp_path):
    ts = ["2024-01-01 00:59:59.6", "2024-01-02 01:10:00", "2024-01-03 02:59:59.5", "1969-12-31 23:30:00"]
    e = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ts)], "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    assert rows(entry.queries()["blank_row_split"](spark, str(tmp_path)), "block", "n") == [(1, 1), (2, 2), (3, 1)]


def test_f2_pairs_counted(spark, sig):
    p = graph.profiles_of(sig.union(spark.createDataFrame([("doc:90", "90", "tax", "a\x1fb"), ("doc:91", "91", "tax", "a"), ("doc:92", "92", "tax", "a\x1fb")], SIGNAL)))
    want = rows(graph.pairs_of(p).groupBy(*graph.KINDS, "hints").count(), *graph.KINDS, "hints", "count")
    for most in (0, 2, 6, 9):
        assert rows(graph.pair_classes(p, most, few=most > 2), *graph.KINDS, "hints", "n") == want
    edges = graph.judge(graph.pairs_of(p))
    assert rows(graph.count_edges(graph.edge_classes(p))) == rows(graph.count_edges(edges))
    assert rows(graph.count_edges(graph.edge_classes(p.limit(0)))) == rows(graph.count_edges(edges.limit(0)))


def test_f13_least_id_in_the_same_plan(spark, sf):
    df = entry.queries()["edge_verdict"](spark, sf)
    assert "min(edge_id" in df._jdf.queryExecution().optimizedPlan().toString()  # it was collected by a job of its own
    assert df.filter("status = 'rejected'").count() == 1

def test_f14_row_top2_equals_brute_force(spark, sf, sig):
    """The closest documents of rows are those of all pairs; pairs are neither made nor shuffled where nodes have few signals."""
    docs = sig.filter("doc_key < '25'")
    of = sig.filter("doc_key > '04'").withColumn("node", F.concat(F.lit("row:"), "doc_key", F.lit("r"), F.pmod(F.hash("value"), F.lit(2)).cast("string")))
    have = {}
    for name, df in (("row", of), ("doc", docs)):
        for r in df.collect():
            have.setdefault((name, r["node"], r["doc_key"]), set()).add((r["kind"], r["value"]))
    want = []
    for (name, src, key), own in have.items():
        near = sorted((-len({k for k, _ in own & held}), dst) for (side, dst, other), held in have.items() if (name, side) == ("row", "doc") and other != key and own & held)
        want += [(src, dst, -less, i + 1) for i, (less, dst) in enumerate(near[:2])]
    assert rows(graph.row_candidates(of, docs)) == sorted(want, key=repr) and want
    none = F.lit(None).cast("string")
    members = graph.profiles_of(of).withColumnRenamed("node", "src").withColumn("dst", none).unionByName(graph.profiles_of(docs).withColumnRenamed("node", "dst").withColumn("src", none))
    for most in (1, 3, 8):
        assert rows(graph.row_candidates_of(members, F.col("src"), F.col("dst"), most=most, wide=members if most == 3 else None)) == sorted(want, key=repr)
    plan = entry.queries()["row_doc_top2"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((src|dst)", plan) and "SortMergeJoin" not in plan
