"""Layout, facts, graph, ledgers, sources and streaming on small tables."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docketry.operators import cards, facts, graph, layout, ledger, registry
from docketry.sources import files
from docketry.streaming import incremental

FORM = [["付款申请", "", ""], ["单位全称", "某某有限公司", ""], ["开户行", "宁波银行", ""], ["联系电话", "13800138000", ""], ["甲方（公章）：", "乙方（公章）：", ""]]


def test_layouts():
    form = layout.layout_of(FORM)
    assert form["layout"] == "kv" and form["title_rows"] == [FORM[0]] and form["signature_rows"] == [FORM[4]] and len(form["body"]) == 3
    plain = layout.layout_of([["品种", "单位", "数量"], ["香樟", "株", "5"], ["桂花", "棵", "7"]])
    assert plain["layout"] == "table" and plain["header"] == ["品种", "单位", "数量"] and len(plain["body"]) == 2
    assert layout.layout_of([["★注：以上价格均含税"], ["1、苗木胸径以实测为准，误差不得超过百分之五"]])["layout"] == "note"
    assert layout.layout_of([["甲方（签字）：", "乙方（签字）："]])["layout"] == "signature"
    assert layout.layout_of([["a1", "b2", "c3"]])["layout"] == "noheader"
    assert not layout.signature_row(["申请单位", "某某公司", "申请日期", "2026年9月1日"])


def test_kv_scores_agree(spark):
    tables = {"f": FORM[1:4], "l": [["品种", "规格"], ["香樟", "10cm"], ["桂花", "8cm"]]}
    cells = [(t, r, c, v) for t, rows in tables.items() for r, row in enumerate(rows) for c, v in enumerate(row)]
    for got in layout.kv_scores(spark.createDataFrame(cells, "table_id string, row int, col int, value string")).collect():
        want = layout.kv_figures(tables[got["table_id"]])
        assert got["is_kv"] == want["is_kv"] and got["hit"] == want["hit"] and got["score"] == pytest.approx(want["score"], abs=1e-3)


def test_offsets_and_spans(spark):
    blocks = spark.createDataFrame([("d", 1, 0, "ab"), ("d", 1, 1, "cde"), ("d", 1, 2, "f")], "doc_key string, page int, seq int, text string")
    text = layout.page_text(blocks).first()["text"]
    for r in layout.page_offsets(blocks).collect():
        assert text[r["char_start"] : r["char_end"]] == r["text"]
    raw, final = "甲方：某某公司，金额100", "甲方：CO0001，金额100"
    found = spark.createDataFrame([(raw, final)], "raw string, final string").select(layout.offset_map("raw", "final").alias("m")).first()["m"]
    segments = spark.createDataFrame([("d", *m) for m in found], "doc_key string, final int, raw int, length int")
    at = final.index("100")
    spans = spark.createDataFrame([("d", at, at + 3), ("d", 3, 9)], "doc_key string, start int, end int")
    got = {r["start"]: r for r in layout.map_spans(spans, segments).collect()}
    assert got[at]["exact"] and raw[got[at]["raw_start"] : got[at]["raw_end"]] == "100"
    assert not got[3]["exact"] and raw[got[3]["raw_start"] : got[3]["raw_end"]] == "某某公司"


def test_offset_map_of_whole_turns(spark, tmp_path):
    """Blocks of a long turn: every character that is no digit, to the end."""
    from docketry.plans import catalogue

    text = " ".join(f"line {i} has {i * 37} words and more" for i in range(60))
    rows = [(1, 0, text), (1, 1, "short 12"), (2, 0, "")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["blocks"] for r in catalogue.offset_map(spark, str(tmp_path)).collect()}
    for c, t, raw in rows:
        at = [i for _, start, n in got[c, t] for i in range(start, start + n)]
        assert at == [i for i, x in enumerate(raw) if not x.isdigit()]
        assert all(final == start for final, start, _ in got[c, t])


def test_facts(spark):
    tables = spark.createDataFrame([("A", 1, 1, ["合同金额", "甲方"], [["350,000.00", "CO0001"], [None, " "]])], "doc_key string, page_no int, table_index int, header array<string>, rows array<array<string>>")
    got = {r["fact_id"]: r for r in facts.cell_facts(tables).collect()}
    assert set(got) == {"A|cell|p1|t1|r1|c0", "A|cell|p1|t1|r1|c1", "A|cell|p1|t1|r0|c0", "A|cell|p1|t1|r0|c1"}
    assert got["A|cell|p1|t1|r1|c1"]["semantic"] == "company" and got["A|cell|p1|t1|r1|c1"]["value_is_code"]
    assert facts.kv_pairs([["单位全称", "某某公司", "开户行", "宁波银行"], ["金额", "", ""], ["100", "", ""]]) == [(1, 1, "单位全称", "某某公司"), (1, 3, "开户行", "宁波银行"), (3, 0, "金额", "100")]
    page = "标题\ntext:合同编号： HT-001 \n2026年的一句很长很长很长很长的话：没有"
    got = facts.line_facts(spark.createDataFrame([("A", 1, page)], "doc_key string, page_no int, text string")).collect()
    assert [(r["header"], r["value"]) for r in got] == [("合同编号", "HT-001")] and page[got[0]["char_start"] : got[0]["char_end"]] == "HT-001"


def test_segments_and_chunks():
    pages = ["a" * 10 + "\n" + "b。" * 1500, "", "c"]
    segs = facts.segment_pages(pages)
    assert all(len(s["text"]) <= 2001 for s in segs) and "".join(s["text"] for s in segs).replace("\n", "") == "".join(pages).replace("\n", "")
    text = "\n".join(f"line {i} " + "x" * (i * 7 % 90) for i in range(120)) + "\n" + "y，" * 900
    got = facts.chunk_text(text)
    assert max(map(len, got)) <= 700 + 20 + 101
    assert facts.chunk_text("") == [] and [c.strip() for c in facts.chunk_text("text:a text:b")] == ["text:a \ntext:b"]


def pair(spark, **kinds):
    row = {k: bool(kinds.get(k)) for k in graph.KINDS}
    return spark.createDataFrame([("doc:a", "doc:b", "a", "b", *row.values(), ["x=1"])], "src string, dst string, src_doc string, dst_doc string, " + ", ".join(f"{k} boolean" for k in row) + ", shared array<string>")


@pytest.mark.parametrize(
    ("relation", "kinds", "value", "status"),
    [("contract_to_invoice", graph.KINDS, 0.95, "validated"), ("same_project", ("project",), 0.75, "validated"), ("counterparty_shared", ("counterparty",), 0.725, "validated"), ("amount_consistent", ("amount",), 0.70, "validated"), ("same_project", ("counterparty",), 0.40, "hypothesis"), ("same_project", ("tax",), 0.35, "rejected")],
)
def test_confidence(spark, relation, kinds, value, status):
    c, s, _ = graph.confidence(relation)
    got = pair(spark, **{k: True for k in kinds}).select(c.alias("c"), s.alias("s")).first()
    assert (got["c"], got["s"]) == (pytest.approx(value), status)


def test_pairs_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    sig = [(f"doc:{d}", f"{d}", rnd.choice(graph.KINDS), str(rnd.randrange(9))) for d in range(40) for _ in range(3)]
    got = {(r["src"], r["dst"]) for r in graph.candidate_pairs(spark.createDataFrame(sig, "node string, doc_key string, kind string, value string").distinct()).collect()}
    assert got == {(a[0], b[0]) for a in sig for b in sig if a[1] < b[1] and a[2:] == b[2:]}


def test_paths_and_conflicts(spark):
    rows = [("e1", "doc:a", "doc:b", "r", 0.9, "validated"), ("e2", "doc:b", "doc:c", "r", 0.8, "hypothesis"), ("e3", "doc:c", "doc:a", "r", 0.5, "rejected"), ("e4", "doc:b", "doc:a", "q", 0.4, "validated")]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, relation string, confidence double, status string")
    anchors = spark.createDataFrame([("doc:a", 1.0)], "node string, anchor_confidence double")
    got = {(r["end_node"], tuple(r["edges"])): r["confidence"] for r in graph.paths(edges, anchors).collect()}
    assert got == {("doc:b", ("e1",)): 0.9, ("doc:b", ("e4",)): 0.4, ("doc:c", ("e1", "e2")): 0.504, ("doc:c", ("e4", "e2")): 0.224}
    flagged = {r["edge_id"]: (r["conflict"], r["status"]) for r in graph.flag_conflicts(edges).collect()}
    assert flagged["e1"] == (True, "hypothesis") and flagged["e2"] == (False, "hypothesis")


def test_cards(spark):
    rows = [(1, "a/合同1", "合同", "苗木采购合同 350000", "", ["合同金额: 350,000.00"]), (2, "b/发票", "发票", "CO0001", "", [])]
    c = spark.createDataFrame(rows, "doc_no int, doc_key string, category string, summary string, features string, key_facts array<string>")
    assert [r["doc_no"] for r in cards.recall(c, "苗木采购合同金额").collect()] == [1]
    assert cards.recall(c, "CO0001").first()["doc_no"] == 2
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in cards.vector_top_k(v, [1.0, 0.0], 2).collect()] == [4, 3]


def test_ledger(spark):
    old = spark.createDataFrame([(1, "a", "n"), (2, "b", "n")], "k int, v string, note string")
    new = spark.createDataFrame([(2, "c", ""), (3, "d", "m")], "k int, v string, note string")
    got = {r["k"]: (r["v"], r["note"], r["action"]) for r in ledger.upsert(old, new, "k", keep_old=("note",)).collect()}
    assert got == {1: ("a", "n", "kept"), 2: ("c", "n", "updated"), 3: ("d", "m", "inserted")}
    inbox = spark.createDataFrame([("i", "invoice", "d", {"a": "1"}, "posted"), ("j", "invoice", "e", {"a": "1", "b": "2"}, "pending")], "item_id string, kind string, doc_key string, fields map<string,string>, status string")
    items = spark.createDataFrame([("i", "other", "x", {"a": "9"}), ("j", "invoice", "e", {"a": "9"}), ("k", "contract", "f", {})], "item_id string, kind string, doc_key string, fields map<string,string>")
    got = {r["item_id"]: (r["fields"], r["status"]) for r in ledger.stage(inbox, items).collect()}
    assert got == {"i": ({"a": "1"}, "posted"), "j": ({"a": "9", "b": "2"}, "pending"), "k": ({}, "pending")}
    changed, audit = ledger.update_cell(old, "k", 1, "v", " z ")
    assert changed.filter("k = 1").first()["v"] == "z" and audit.first()["old"] == "a"
    tables = {"documents": spark.createDataFrame([(1, "a"), (2, "b")], "doc_no int, doc_key string"), "edges": spark.createDataFrame([("doc:a", "doc:b"), ("doc:b", "row:c#t1r1")], "src string, dst string")}
    left, gone = ledger.delete_document(tables, "a", spark.createDataFrame([], "doc_no int, doc_key string"))
    assert left["documents"].count() == 1 and left["edges"].count() == 1 and gone.first()["doc_no"] == 1
    assert ledger.next_numbers(left["documents"], gone).first()["next"] == 3


def test_registry(spark):
    names = spark.createDataFrame([("南苑新村消防维保项目",), ("南苑新村消防维保工程",), ("南苑新村消防",), ("北",)], "name string")
    known = spark.createDataFrame([("PJ0001", "南苑新村消防维保项目")], "code string, name string")
    got = {r["name"]: r["match"] for r in registry.check_projects(names, known).collect()}
    assert got["南苑新村消防维保项目"] == "exact" and got["南苑新村消防"] == "similar" and got["北"] == "none"
    rows = spark.createDataFrame([("x", i % 7, i) for i in range(100)] + [("y", 3, 0)], "g string, a int, b int")
    numbered = sorted((r["g"], r["a"], r["b"], r["number"]) for r in registry.numbered(rows, "g", ["a", "b"]).collect())
    assert [n for *_, n in numbered] == [*range(1, 101), 1]


def test_html_and_pipes(spark):
    html = "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d<br>e</td></tr></table>"
    assert files.html_grid(html) == [["a", "b", "b"], ["a", "c", "d e"]]
    rows = spark.createDataFrame([(html,), ("| a | b |\n|---|---|\n| 1 | 2 |",), ("x\n\n y ",)], "c string").select(files.parse_block(F.col("c")).alias("r"))
    assert [r["r"] for r in rows.collect()] == [[["a", "b", "b"], ["a", "c", "d e"]], [["a", "b"], ["1", "2"]], [["x"], ["y"]]]


def xlsx() -> bytes:
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>品种</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5.0</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.xlsx").write_bytes(xlsx())
    (tmp_path / "in/~$a.xlsx").write_bytes(b"x")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    (tmp_path / "in/bad.docx").write_bytes(b"x")
    found = files.discover(spark, str(tmp_path / "in"), content=True)
    assert [r["rel_path"] for r in found.collect()] == ["bad.docx", "sub/a.xlsx"]
    rows = found.select("name", files.read_office("name", "content").alias("r")).filter("name = 'a.xlsx'").first()["r"]
    assert rows[0]["cells"] == ["品种", "", "5"] and rows[0]["merged"] and rows[0]["sheet"] == "S"
    hub = tmp_path / "hub"
    hub.mkdir()
    (hub / "a.json").write_text(json.dumps({"kind": "hub_doc", "doc_key": "a", "pages": ["x"]}))
    (hub / "a.l1.json").write_text(json.dumps({"kind": "hub_doc", "doc_key": "b"}))
    (hub / "c.json").write_text(json.dumps({"kind": "other"}))
    assert [r["doc_key"] for r in files.read_hub(spark, str(hub)).collect()] == ["a"]


def test_incremental(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, n long, fingerprint string")
    folder = str(tmp_path / "in")
    rows((1, 1, "a"), (1, 2, "b"), (2, 1, "a")).write.parquet(folder)
    built = []

    def build(batch):
        built.append(batch.count())
        return batch

    run = lambda: incremental.incremental_build(spark.readStream.schema("k long, n long, fingerprint string").parquet(folder), str(tmp_path / "out"), "k", "n", build).awaitTermination()
    run()
    rows((1, 3, "b"), (3, 1, "a")).write.mode("append").parquet(folder)
    run()
    got = {r["k"]: r["fingerprint"] for r in incremental.State(spark, str(tmp_path / "out/state")).read().collect()}
    assert got == {1: "b", 2: "a", 3: "a"} and built == [2, 1]


def test_projection(spark):
    hub = spark.createDataFrame([("a", ["标题\n合同编号：HT-1"], [("kv", 1, [], [["开户行", "宁波银行"]], [["付款申请"]], []), ("table", 1, ["品种", "数量"], [["香樟", "5"]], [], [])])],
                                "doc_key string, pages array<string>, tables array<struct<layout:string,page:int,header:array<string>,rows:array<array<string>>,title_rows:array<array<string>>,signature_rows:array<array<string>>>>")
    out = facts.project_document(hub)
    got = {(r["fact_kind"], r["header"], r["value"]) for r in out["facts"].filter("coalesce(row_index, 1) > 0").collect()}
    assert got == {("cell", "开户行", "宁波银行"), ("title", None, "付款申请"), ("cell", "品种", "香樟"), ("cell", "数量", "5"), ("kv", "合同编号", "HT-1")}
    assert out["fingerprints"].first()["n_cells"] == 4 and out["segments"].count() == 1


def test_sample_corpus(spark, tmp_path):
    (tmp_path / "legend.json").write_text(json.dumps({"类别": {"company": {"CO0001": {"real": "某某公司"}}}}, ensure_ascii=False))
    (tmp_path / "edges.json").write_text(json.dumps({"edges": [{"src": "a", "dst": "b", "relation": "r", "weight": 0.8}, {"src": "a", "dst": "c", "relation": "r", "weight": 0.5}]}))
    (tmp_path / "truth.json").write_text(json.dumps({"questions": [{"id": "q", "evidence_facts": [{"doc_key": "a", "header": "h", "value": "1 2"}]}]}))
    assert files.read_legend(spark, str(tmp_path / "legend.json")).first()["code"] == "CO0001"
    assert [r["status"] for r in files.read_weak_edges(spark, str(tmp_path / "edges.json")).orderBy("dst").collect()] == ["validated", "hypothesis"]
    truth = files.read_truth(spark, str(tmp_path / "truth.json"))
    assert cards.truth_check(truth, spark.createDataFrame([("a", "h", "12")], "doc_key string, header string, value string")).first()["there"]


def test_wanted_chains_and_capped_paths(spark):
    """One hop of a wanted relation is enough, a wanted type at the end too; the cap keeps the same paths as a full listing cut afterwards."""
    import random

    rnd = random.Random(4)
    ends = {tuple(sorted(rnd.sample(range(14), 2))) for _ in range(40)}
    rows = [(f"e{i}", f"doc:{a:02d}", f"doc:{b:02d}", rnd.choice("rq"), 0.9, "validated") for i, (a, b) in enumerate(sorted(ends))]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, relation string, confidence double, status string")
    anchors = spark.createDataFrame([("doc:01", 1.0), ("doc:05", 0.5)], "node string, anchor_confidence double")
    every = graph.paths(edges, anchors, most=None).collect()
    for most in (1, 5, 30, 200):
        want = set()
        for a in ("doc:01", "doc:05"):
            own = sorted((r["hops"], r["nodes"], r["edges"]) for r in every if r["anchor"] == a)[:most]
            want |= {(a, tuple(e)) for _, _, e in own}
        assert {(r["anchor"], tuple(r["edges"])) for r in graph.paths(edges, anchors, most=most).collect()} == want
    docs = spark.createDataFrame([(f"{i:02d}", "发票" if i < 4 else "合同") for i in range(14)], "doc_key string, category string")
    for types in ([], ["发票"]):
        got = {tuple(r["edges"]) for r in graph.wanted_chains(graph.paths(edges, anchors, most=None), ["q"], types, docs).collect()}
        assert got == {tuple(r["edges"]) for r in every if "q" in r["relations"] or types and int(r["end_node"][4:]) < 4}


def test_names_apart(spark):
    """Names of a family that meet each other and those that exist, against one pass in order over the directory."""
    rows = [("d", f"{i:02d}", n) for i, n in enumerate(["a.txt", "a.txt", "a(1).txt", "a.txt", "b", "b", "a(1)(1).txt", "a(2).txt", "a.doc"])] + [("e", "00", "a.txt")]
    there = {"d": {"a.txt", "a(3).txt", "b(1)"}, "e": set()}
    want, taken = {}, {k: set(v) for k, v in there.items()}
    for d, old, new in rows:
        stem, dot, ext = new.rpartition(".") if "." in new else (new, "", "")
        given = next(x for n in range(99) if (x := new if n == 0 else f"{stem}({n}){dot}{ext}") not in taken[d])
        taken[d].add(given)
        want[d, old] = given
    asked = spark.createDataFrame(rows, "dir string, old string, new string")
    have = spark.createDataFrame([(d, n) for d, ns in there.items() for n in ns], "dir string, name string")
    assert {(r["dir"], r["old"]): r["new"] for r in ledger.rename_plan(asked, have).collect()} == want


def test_nearest_vectors_equal_brute_force(spark, monkeypatch):
    """Blocks of queries and rows, ties, zero and null vectors, another length, a table smaller than k and an empty one."""
    import random

    import numpy as np

    monkeypatch.setattr(cards, "QUERY_BLOCK", 3)
    monkeypatch.setattr(cards, "ROW_BLOCK", 7)
    rnd = random.Random(5)
    vectors = [[float(rnd.randint(-2, 2)) for _ in range(3)] for _ in range(60)] + [[0.0] * 3, None, [1.0, 2.0]]
    asked = [*vectors[:8], [0.0] * 3, [1.0, 2.0]]
    e = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, vector array<float>")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return None
        return round(float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))), 6)

    for table, n in ((e, len(vectors)), (e.filter("vec_id < 2"), 2), (e.limit(0), 0)):
        got = {(r["query_id"], r["place"]): (r["vec_id"], r["similarity"]) for r in cards.vector_top_k_batch(table, q, 5).collect()}
        want = {}
        for i, a in enumerate(asked):
            ranked = sorted(((v, cosine(a, vectors[v])) for v in range(n)), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
            want |= {(i, place): x for place, x in enumerate(ranked[:5], 1)}
        assert got == want
