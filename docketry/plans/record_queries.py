"""Queries of operators on records: facts, ledgers, the inbox, registrations, stored files and the graph's requests."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import cards, facts, graph, layout, ledger, registry
from ..sources import files
from . import adapters as A
from . import router
from .entries import query, shared_folder


def _pairs(column: str):
    """A map as text, in order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias(column)


def _text_map(*pairs):
    """A map of texts from (key, value) columns; null values are left out."""
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k), v.cast("string").alias("v")) for k, v in pairs]), lambda p: p["v"].isNotNull()))


# --- Facts ---


@query("""WITH t AS (SELECT o_orderkey AS o, 'O' || o_orderkey AS doc_key FROM orders)
SELECT doc_key || '|title|p1|t1|r1' AS fact_id, doc_key, 'title' AS fact_kind, '付款申请 | ' || o AS value FROM t UNION ALL SELECT doc_key || '|signature|p1|t1|r2', doc_key, 'signature', '经办人签字' FROM t""")
def title_facts(spark, d):
    """title and signature rows, one fact each; blank rows are none."""
    o = A.table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("doc_key"), F.lit(1).alias("page_no"), F.lit(1).alias("table_index"),
                                           F.array(F.array(F.lit(" 付款申请"), F.lit(""), F.col("o_orderkey").cast("string"))).alias("title_rows"), F.array(F.array(F.lit(" ")), F.array(F.lit("经办人签字"))).alias("signature_rows"))
    return facts.title_facts(o).select("fact_id", "doc_key", "fact_kind", "value")


@query("""WITH t AS (SELECT 'O' || o_orderkey AS doc_key, o_orderkey::VARCHAR AS o, o_custkey % 2 = 0 AS right_of FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT doc_key, 1 AS row_index, 1 AS col_index, '合同编号' AS header, o AS value, NULL AS semantic FROM t WHERE right_of UNION ALL SELECT doc_key, 2, 0, '合同编号', o, NULL FROM t WHERE NOT right_of
UNION ALL SELECT doc_key, 3, 2, '开户行：', '宁波银行', 'bank_name' FROM t""")
def kv_table_facts(spark, d):
    """labels with the next filled cell to their right, else the cell below."""
    k, right = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 2 == 0
    rows = F.array(F.array(F.lit("合同编号"), F.when(right, k).otherwise(""), F.lit("")), F.array(F.when(right, "").otherwise(k), F.lit(""), F.lit("")), F.array(F.lit("开户行："), F.lit(""), F.lit("宁波银行")))
    o = A.table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("doc_key"), F.lit(1).alias("page_no"), F.lit(1).alias("table_index"), rows.alias("rows"))
    return facts.kv_table_facts(o).select("doc_key", "row_index", "col_index", F.trim("header").alias("header"), "value", "semantic")


@query("""WITH t AS (SELECT 'O' || o_orderkey AS doc_key, 'HT-' || o_orderkey AS a, c_name AS b FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT doc_key, '合同编号' AS header, a AS value, (3 + 5)::INT AS char_start, (3 + 5 + length(a))::INT AS char_end FROM t UNION ALL SELECT doc_key, '甲方', b, (3 + 5 + length(a) + 1 + 7 + 4)::INT, (3 + 5 + length(a) + 1 + 7 + 4 + length(b))::INT FROM t""")
def line_facts(spark, d):
    """'label: value' lines with the value's place in the page, block labels left out."""
    o = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(F.lit("标题\n合同编号：HT-"), F.col("o_orderkey").cast("string"), F.lit("\nheader:甲方: "), "c_name", F.lit("\n见合同CO0001号：无\n空："))
    pages = o.select(F.concat(F.lit("O"), "o_orderkey").alias("doc_key"), F.lit(1).alias("page_no"), text.alias("text"))
    return facts.line_facts(pages).select("doc_key", "header", "value", "char_start", "char_end")


@query("""WITH p AS (SELECT 'O' || o_orderkey AS doc_key, substr(sha256('project:' || o_custkey), 1, 16) AS parent, o_orderkey AS o FROM orders)
SELECT doc_key, 'project' AS code, 0 AS seq, parent AS hash FROM p UNION ALL SELECT doc_key, 'project_sub', 1, substr(sha256(parent || ':南苑' || o), 1, 16) FROM p UNION ALL SELECT doc_key, 'project_sub', 2, substr(sha256(parent || ':北苑'), 1, 16) FROM p""")
def project_features(spark, d):
    """A project and its parts, hashed with the parent's hash."""
    o = A.table(spark, d, "orders")
    value = F.concat(F.col("o_custkey").cast("string"), F.lit("/南苑"), F.col("o_orderkey").cast("string"), F.lit("-北苑"))
    return facts.feature_hashes(o.select(F.concat(F.lit("O"), "o_orderkey").alias("doc_key"), F.lit("project").alias("code"), value.alias("value")))


@query("""SELECT l_orderkey AS doc_key, sha256('{' || string_agg('"' || code || ':' || seq || '":"' || h || '"', ',' ORDER BY code, seq, h) || '}') AS bundle FROM (SELECT l_orderkey, l_returnflag AS code, l_linenumber::INT AS seq, md5(l_linestatus || l_partkey) AS h FROM lineitem) GROUP BY 1""")
def feature_bundles(spark, d):
    """one hash over each document's feature hashes."""
    li = A.table(spark, d, "lineitem")
    return facts.feature_bundle(li.select(F.col("l_orderkey").alias("doc_key"), F.col("l_returnflag").alias("code"), F.col("l_linenumber").cast("int").alias("seq"), F.md5(F.concat("l_linestatus", F.col("l_partkey").cast("string"))).alias("hash")))


@query("""SELECT 'C' || conv_id AS doc_key, sha256(string_agg(coalesce(text, ''), chr(12) ORDER BY turn, text)) AS pages_hash, count(*)::INT AS n_pages, sha256('[{"rows":[["' || conv_id || '","x"],["y"]]}]') AS tables_hash, 1 AS n_tables, 3 AS n_cells FROM conversations GROUP BY conv_id""")
def hub_fingerprints(spark, d):
    """F8: hashes and counts of documents whose pages are the turns of conversations."""
    c = A.table(spark, d, "conversations")
    pages = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    tables = F.array(F.struct(F.array(F.array(F.col("conv_id").cast("string"), F.lit("x")), F.array(F.lit("y"))).alias("rows")))
    return facts.hub_fingerprint(c.groupBy("conv_id").agg(pages.alias("pages")).select(F.concat(F.lit("C"), "conv_id").alias("doc_key"), "pages", tables.alias("tables")))


@query("SELECT doc_id AS doc_key FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def summaries_reused(spark, d):
    """documents whose hash and number of segments stay as they were; those of low quality have changed."""
    row = lambda name, n: A.table(spark, d, name).select(F.col("doc_id").alias("doc_key"), F.md5(F.col("doc_id").cast("string")).alias("hub_hash"), n.alias("n_segments"))
    return facts.reusable_summaries(row("documents", F.lit(1)), row("labels", F.col("quality").cast("int")))


@query(f"WITH {A.FACTS_SQL}, m AS (SELECT *, row_number() OVER (ORDER BY page_no NULLS LAST, table_index NULLS LAST, row_index NULLS LAST, col_index NULLS LAST, fact_id) AS place FROM (SELECT fact_id, 1 AS page_no, CASE WHEN col_index = 2 THEN NULL ELSE 1 END AS table_index, 1 AS row_index, col_index FROM facts WHERE header = '合同编号' OR col_index = 2)) SELECT fact_id, place FROM m")
def facts_in_order(spark, d):
    """Facts in page order with their places, those without a table last."""
    f = A.facts(spark, d).filter("header = '合同编号' or col_index = 2").withColumn("table_index", F.when(F.col("col_index") != 2, F.col("table_index")))
    listed = facts.list_facts(f.select("fact_id", "page_no", "table_index", "row_index", "col_index"))
    order = [F.asc_nulls_last(c) for c in ("page_no", "table_index", "row_index", "col_index")]
    return listed.select("fact_id", F.row_number().over(Window.orderBy(*order, "fact_id")).cast("long").alias("place"))


@query("""WITH b AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), s AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM b)
SELECT conv_id, turn, st::INT AS char_start, (st + length(t))::INT AS char_end, true AS there FROM s""")
def page_ranges(spark, d):
    """Blocks with their ranges, and whether the assembled page holds each at its range."""
    c = A.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_key"), F.lit(1).alias("page"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    page = layout.page_text(c).withColumnRenamed("text", "whole")
    both = layout.page_offsets(c).join(page, ["doc_key", "page"])
    there = F.substr("whole", F.col("char_start") + 1, F.length("text")) == F.col("text")
    return both.select(F.col("doc_key").alias("conv_id"), F.col("seq").alias("turn"), "char_start", "char_end", there.alias("there"))


@query("""SELECT o_orderkey AS k, 2 AS n_pipe, o_custkey::VARCHAR || '/' || o_orderstatus AS cell, 2 AS n_plain, o_orderpriority AS line, 2 AS n_html, o_custkey::VARCHAR || '/' || o_custkey AS spanned FROM orders""")
def table_blocks(spark, d):
    """Table blocks drawn with pipes, as plain lines and in HTML."""
    o = A.table(spark, d, "orders")
    key = F.col("o_custkey").cast("string")
    pipe = F.concat(F.lit("| a | b |\n|---|:-:|\n| "), key, F.lit(" | "), "o_orderstatus", F.lit(" |\n说明"))
    plain = F.concat(F.lit(" x \n\n"), "o_orderpriority", F.lit("\n "))
    html = F.concat(F.lit("<table><tr><th>a</th><th>b</th></tr><tr><td colspan=2>"), key, F.lit("</td></tr></table>"))
    rows = o.select("o_orderkey", *[files.parse_block(c).alias(n) for n, c in (("p", pipe), ("t", plain), ("h", html))])
    joined = lambda c: F.array_join(F.col(c)[1], "/")
    return rows.select(F.col("o_orderkey").alias("k"), F.size("p").alias("n_pipe"), joined("p").alias("cell"), F.size("t").alias("n_plain"), joined("t").alias("line"), F.size("h").alias("n_html"), joined("h").alias("spanned"))


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), t AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS run FROM n WHERE event_type = 'click')
SELECT user_id AS doc_key, min(n)::INT AS first_line, count(*)::INT AS n_rows, string_agg(event_type || '/' || n, ';' ORDER BY n) AS rows FROM t GROUP BY user_id, run""")
def table_line_runs(spark, d):
    """Runs of table lines among a page's lines as blocks; a user's clicks are the table lines."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    lines = A.table(spark, d, "events").select(F.col("user_id").alias("doc_key"), F.lit(1).alias("page_no"), n.alias("line_no"), "event_type")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("table: "), "event_type", F.lit(" |"), F.col("line_no").cast("string"))).otherwise(F.col("event_type"))
    runs = files.table_runs(lines.withColumn("line", line))
    return runs.select("doc_key", "first_line", F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "/")), ";").alias("rows"))


@query("""WITH v AS (SELECT DISTINCT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k) AS n FROM v)
SELECT p_brand AS doc_key, string_agg(p_name, ';' ORDER BY k) AS projects FROM r WHERE n <= 20 GROUP BY 1""")
def table_metadata(spark, d):
    """At most twenty distinct project values of each table, as the feature says."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.array(x["p_partkey"].cast("string"), x["p_name"]))
    tables = A.table(spark, d, "part").groupBy("p_brand").agg(rows.alias("rows")).select(F.col("p_brand").alias("doc_key"), F.lit("S").alias("sheet"), F.array(F.lit("序号"), F.lit("项目名称")).alias("header"), "rows")
    return files.table_metadata(tables).select("doc_key", F.array_join("projects", ";").alias("projects"))


@query("SELECT DISTINCT l_orderkey AS stem, l_linenumber AS page_no FROM lineitem o WHERE NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_returnflag = 'R' AND c.l_orderkey = o.l_orderkey AND c.l_linenumber = o.l_linenumber)")
def pages_missing(spark, d):
    """Pages that no cache holds; those of returned lines are cached."""
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.lit("h").alias("hash10"), F.col("l_linenumber").alias("page_no"), "l_returnflag")
    return files.missing_pages(li.drop("l_returnflag").distinct(), li.filter("l_returnflag = 'R'")).select("stem", "page_no")


@query("SELECT o_orderkey AS position, o_custkey % 3 = 0 OR o_custkey % 3 = 1 AND o_custkey % 2 = 1 AS needs_ocr FROM orders")
def processing_order(spark, d):
    """Which files need recognition, and so come last."""
    o, c = A.table(spark, d, "orders"), F.col("o_custkey")
    ext = F.when(c % 3 == 0, "png").when(c % 3 == 1, "pdf").otherwise("docx")
    return files.order_for_processing(o.select(F.col("o_orderkey").alias("position"), ext.alias("ext"), F.when(c % 2 == 1, 1).otherwise(2).alias("n_text_pages"), F.lit(2).alias("n_pages"))).select("position", "needs_ocr")


# --- Written and read again ---


@query("SELECT conv_id, turn, role, text FROM conversations")
def messages_read(spark, d):
    """Conversation lines written as JSON among broken ones, and read; broken lines are skipped."""
    path = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    c = A.table(spark, d, "conversations")
    lines = c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    lines.unionByName(c.select(F.concat(F.lit('{"conv_id": '), F.col("turn").cast("string")).alias("value"))).write.text(path)
    return files.read_messages(spark, path)


@query("SELECT 'D' || doc_id AS doc_key, coalesce(nullif(source, ''), '_') AS folder, sha256(coalesce(text, '')) AS content, 2 AS n_pages FROM documents")
def hub_read(spark, d):
    """S3, K1: hub documents written by source folder and read; other kinds of JSON beside them are left out."""
    path = f"{shared_folder(spark)}/hub-{uuid.uuid4().hex}"
    docs = A.table(spark, d, "documents").select(F.lit("hub_doc").alias("kind"), F.concat(F.lit("D"), "doc_id").alias("doc_key"), F.col("source").alias("source_dir"), F.array(F.coalesce("text", F.lit("")), F.lit("x")).alias("pages"))
    files.write_hub(docs, path)
    files.write_hub(docs.withColumn("kind", F.lit("other")), path)
    got = spark.read.schema(files.HUB).option("recursiveFileLookup", "true").json(path)
    return got.filter("kind = 'hub_doc'").select("doc_key", F.coalesce(F.nullif("source_dir", F.lit("")), F.lit("_")).alias("folder"), F.sha2(F.col("pages")[0], 256).alias("content"), F.size("pages").alias("n_pages"))


@query("SELECT c_custkey::VARCHAR AS k, c_name AS name, c_mktsegment || ', \"' || c_nationkey || '\"' AS note FROM customer")
def ledger_export(spark, d):
    """A ledger as CSV with a byte order mark, read again."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    files.write_ledger(A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')).alias("note")), path)
    got = spark.read.option("header", "true").csv(path)
    return got.toDF("k", "name", "note")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def audit_log(spark, d):
    """Audit rows appended by day in two batches, and read."""
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    e = A.table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    files.append_audit(e.filter("event_type = 'click'"), path)
    files.append_audit(e.filter("event_type <> 'click'"), path)
    return spark.read.parquet(path).select("event_id", F.col("day").cast("string").alias("day"))


@query("SELECT 'D' || doc_id AS doc_key, length(coalesce(text, ''))::INT AS n, sha256(coalesce(text, '')) AS hash FROM documents")
def sidecars(spark, d):
    """K2: a line of JSON for each document, read again."""
    path = f"{shared_folder(spark)}/sidecars-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    files.write_sidecars(A.table(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("doc_key"), F.length(text).alias("n"), F.sha2(text, 256).alias("hash")), path)
    return spark.read.schema("doc_key string, n int, hash string").json(path)


@query("SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderstatus <> 'P' OR o_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")
def buckets_replaced(spark, d):
    """K6: rows written by bucket of their key, then the buckets of some keys written again; no other bucket changes."""
    path = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    rows = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    files.replace_partitions(rows, path, "k", 16)
    first = spark.read.parquet(path).filter("bucket < 4").drop("bucket")
    files.replace_partitions(first.checkpoint(), path, "k", 16)
    return spark.read.parquet(path).select("k", "n", "last")


# --- Ledger and inbox ---


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey = 7 THEN 12345.5 ELSE o_totalprice::DECIMAL(15,2)::DOUBLE END AS amount, CASE WHEN o_orderkey = 9 THEN o_custkey % 2 <> 0 ELSE o_custkey % 2 = 0 END AS paid FROM orders")
def cells_updated(spark, d):
    """A ledger with one typed cell changed and one status turned round."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(15,2)").cast("double").alias("amount"), (F.col("o_custkey") % 2 == 0).alias("paid"))
    return ledger.toggle(ledger.update_cell(o, "k", 7, "amount", " 12,345.5 ")[0], "k", 9, "paid")


_OLD = "o_orderkey % 3 <> 0"
_NEW = "o_orderkey % 3 <> 1"


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS old, o_orderkey % 3 <> 1 AS new, o_orderstatus = 'F' AS decided, o_orderpriority AS p FROM orders), i AS (SELECT *, new AND NOT (old AND decided) AS fresh FROM a)
SELECT k::VARCHAR AS item_id, CASE WHEN fresh THEN 'contract' ELSE 'invoice' END AS kind, CASE WHEN old AND decided THEN 'posted' WHEN k = 2 THEN 'rejected' ELSE 'pending' END AS status,
CASE WHEN k = 5 AND NOT (old AND decided) THEN 'a=edited;b=' || CASE WHEN fresh THEN 'new' ELSE p END || CASE WHEN old AND fresh THEN ';c=kept' WHEN fresh THEN '' ELSE ';c=kept' END
WHEN fresh AND old THEN 'a=new;b=new;c=kept' WHEN fresh THEN 'a=new;b=new' ELSE 'a=' || p || ';b=' || p || ';c=kept' END AS fields FROM i""")
def inbox_staged(spark, d):
    """Items staged over an inbox, one edited and one rejected; decided items never change."""
    o = A.table(spark, d, "orders")
    item, p = F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderpriority")
    old = o.filter(_OLD).select(item, F.lit("invoice").alias("kind"), F.lit("d").alias("doc_key"), _text_map(("a", p), ("b", p), ("c", F.lit("kept"))).alias("fields"), F.when(F.col("o_orderstatus") == "F", "posted").otherwise("pending").alias("status"))
    new = o.filter(_NEW).select(item, F.lit("contract").alias("kind"), F.lit("d").alias("doc_key"), _text_map(("a", F.lit("new")), ("b", F.lit("new"))).alias("fields"))
    staged = ledger.decide(ledger.update_fields(ledger.stage(old, new), "5", {"a": "edited"}), "2", "rejected")
    return staged.select("item_id", "kind", "status", _pairs("fields"))


@query("""SELECT sha1('O' || o_orderkey) AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'contract' ELSE 'invoice' END AS kind, 'pending' AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'contract_code=HT-' || o_orderkey ELSE 'invoice_no=' || o_orderkey || '00000000' END AS fields FROM orders WHERE o_orderkey % 3 <> 0""")
def inbox_refreshed(spark, d):
    """Documents that pass the gate, staged with the fields that their text has; others aren't."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "物流凭证").when(k % 2 == 0, "合同").otherwise("发票")
    page = F.when(k % 2 == 0, F.concat(F.lit("合同编号：HT-"), k.cast("string"))).otherwise(F.concat(F.lit("发票号码："), k.cast("string"), F.lit("00000000")))
    docs = A.table(spark, d, "orders").select(F.concat(F.lit("O"), k).alias("doc_key"), F.lit("x.xlsx").alias("name"), kind.alias("category"), F.array(page).alias("pages"))
    none = spark.createDataFrame([], "item_id string, kind string, doc_key string, fields map<string,string>, status string")
    return ledger.refresh_inbox(none, docs).select("item_id", "kind", "status", _pairs("fields"))


@query("SELECT 'new/' || o_orderkey || '（2）.docx' AS new_key, 'old/' || o_orderkey || '.docx' AS old_key, '（2）' AS marker FROM orders WHERE o_custkey % 4 <> 0")
def copies_replaced(spark, d):
    """Copies by name without marks and equal content, each with the document that it replaces."""
    o = A.table(spark, d, "orders")
    file = lambda folder, mark, content: o.select(F.concat(F.lit(f"{folder}/"), "o_orderkey", F.lit(f"{mark}.docx")).alias("doc_key"), F.concat(F.lit(f"{folder}/"), "o_orderkey", F.lit(f"{mark}.docx")).alias("name"), F.md5(content.cast("string")).alias("head_tail"))
    return ledger.copy_plan(file("new", "（2）", F.col("o_custkey")), file("old", "", F.when(F.col("o_custkey") % 4 == 0, -1).otherwise(F.col("o_custkey"))))


@query(f"WITH {A.EDGES_SQL}, t AS (SELECT o_orderkey FROM orders WHERE o_orderkey <> 7) SELECT (SELECT count(*) FROM t) AS documents, (SELECT count(*) FROM edges WHERE 'O7' NOT IN (src_doc, dst_doc)) AS edges, 7::BIGINT AS gone, (SELECT max(o_orderkey) + 1 FROM orders) AS next")
def document_deleted(spark, d):
    """A document gone from every table, its edges too, its number never given again."""
    docs = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_no"), F.concat(F.lit("O"), "o_orderkey").alias("doc_key"))
    left, stones = ledger.delete_document({"documents": docs, "profiles": A.profiles(spark, d)}, "O7", docs.limit(0))
    edges = graph.edge_classes(left["profiles"], few=True)
    one = [left["documents"].agg(F.count("*").alias("documents")), edges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges")), stones.agg(F.max("doc_no").alias("gone")), ledger.next_numbers(left["documents"], stones)]
    out = one[0]
    for df in one[1:]:
        out = out.join(F.broadcast(df))  # one row each
    return out


@query("SELECT c_name AS \"user\", CASE WHEN c_custkey = 5 THEN 'admin' WHEN c_custkey = 3 THEN 'accountant' ELSE 'viewer' END AS role, true AS active FROM customer UNION ALL SELECT 'new', 'viewer', true")
def users_after(spark, d):
    """Users after a registration, one of a name that exists, and the admin role handed over."""
    c = A.table(spark, d, "customer")
    name = {k: c.filter(F.col("c_custkey") == k).select("c_name").first()[0] for k in (3, 5)}
    users = c.select(F.col("c_name").alias("user"), F.when(F.col("c_custkey") == 3, "admin").otherwise("viewer").alias("role"), F.lit(True).alias("active"))
    return ledger.transfer_admin(ledger.register_user(ledger.register_user(users, "new"), name[3]), name[3], name[5])


@query("SELECT o_orderkey, o_custkey AS party, NULL::INTEGER AS paid, o_orderstatus FROM orders")
def columns_altered(spark, d):
    """Columns added, dropped and renamed."""
    return ledger.alter(A.table(spark, d, "orders"), add={"paid": "int"}, drop=("o_totalprice", "o_orderdate", "o_orderpriority"), rename={"o_custkey": "party"})


@query("SELECT 'o_' || lower(o_orderpriority[1]) AS column, 'drop' AS change FROM orders GROUP BY 1 UNION ALL SELECT column_name, 'add' FROM (DESCRIBE SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)")
def catalog_changes(spark, d):
    """Catalogue and physical columns against each other, in both directions."""
    o = A.table(spark, d, "orders")
    catalogue = o.select(F.concat(F.lit("o_"), F.lower(F.substring("o_orderpriority", 1, 1))).alias("column")).distinct().unionByName(spark.createDataFrame([("o_orderkey",)], "column string"))
    return ledger.reconcile(catalogue, o.dtypes)


@query("""WITH f AS (SELECT o_custkey AS dir, o_orderkey AS old, row_number() OVER (PARTITION BY o_custkey ORDER BY lpad(o_orderkey::VARCHAR, 9, '0')) AS n FROM orders)
SELECT dir, old, CASE WHEN dir % 2 = 1 AND n = 1 THEN '合同.docx' ELSE '合同(' || (n - (dir % 2)) || ').docx' END AS new FROM f""")
def names_apart(spark, d):
    """One proposed name for all files of a directory, numbered apart; in even directories it exists already."""
    o = A.table(spark, d, "orders")
    asked = o.select(F.col("o_custkey").cast("string").alias("dir"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("old"), F.lit("合同.docx").alias("new"))
    there = o.filter("o_custkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("dir"), F.lit("合同.docx").alias("name")).distinct()
    return ledger.rename_plan(asked, there).select(F.col("dir").cast("long").alias("dir"), F.col("old").cast("long").alias("old"), "new")


# --- Registration ---


@query(f"WITH b AS (SELECT o_custkey, o_orderkey, o_custkey % 4 AS top, row_number() OVER (PARTITION BY o_custkey ORDER BY lpad(o_orderkey::VARCHAR, 9, '0')) AS n FROM orders) SELECT {A.CODE_SQL.format(p='CO', k='o_custkey')} AS parent_code, o_orderkey AS k, (n + top)::INT AS branch_seq, {A.CODE_SQL.format(p='CO', k='o_custkey')} || '-' || printf('%02d', n + top) AS code FROM b")
def branch_codes(spark, d):
    """Branches numbered after the highest number of their parent."""
    branches = A.table(spark, d, "orders").select(A.code("CO", "o_custkey").alias("parent_code"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("value"))
    top = A.table(spark, d, "customer").filter("c_custkey % 4 > 0").select(A.code("CO", "c_custkey").alias("parent_code"), (F.col("c_custkey") % 4).cast("int").alias("branch_seq"))
    return registry.branch_codes(branches, top).select("parent_code", F.col("value").cast("long").alias("k"), F.col("branch_seq").cast("int").alias("branch_seq"), "code")


@query(f"SELECT 'O' || o_orderkey AS doc_key, {A.CODE_SQL.format(p='CO', k='o_custkey')} AS code, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS real_value FROM orders JOIN customer ON o_custkey = c_custkey")
def real_values(spark, d):
    """Real values of the codes in texts, those of secret categories hidden."""
    texts = A.table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("doc_key"), F.concat(F.lit("甲方："), A.code("CO", "o_custkey")).alias("text"))
    codes = A.table(spark, d, "customer").select(A.code("CO", "c_custkey").alias("code"), F.when(F.col("c_mktsegment") == "BUILDING", "tax_id").otherwise("company").alias("category"), F.col("c_name").alias("real_value"))
    return registry.lookup_real(texts, codes)


@query("""WITH r AS (SELECT 'PJ' || lpad(s_suppkey::VARCHAR, 4, '0') AS code, s_name AS name FROM supplier), n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 10)
SELECT * FROM r UNION ALL SELECT 'PJ' || lpad((row_number() OVER (ORDER BY name) + (SELECT max(s_suppkey) FROM supplier))::VARCHAR, 4, '0'), name FROM n""")
def projects_approved(spark, d):
    """Approved proposals coded after the highest code, those that are registered left alone."""
    known = A.table(spark, d, "supplier").select(F.format_string("PJ%04d", "s_suppkey").alias("code"), F.col("s_name").alias("name"))
    asked = A.table(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("name"), F.when(F.col("p_size") > 10, "approved").otherwise("pending").alias("status"))
    return registry.approve_proposals(asked.unionByName(known.select("name", F.lit("approved").alias("status"))), known)


@query("SELECT 'SU' || s_suppkey AS code, s_suppkey = 3 AS is_primary FROM supplier")
def primary_entity(spark, d):
    """Exactly one primary own company."""
    return registry.set_primary(A.table(spark, d, "supplier").select(F.concat(F.lit("SU"), "s_suppkey").alias("code"), F.lit(True).alias("is_primary")), "SU3")


# --- Graph, cards and questions ---


@query(f"""WITH {A.EDGES_SQL} SELECT edge_id, CASE WHEN edge_id = (SELECT min(edge_id) FROM edges) THEN 'rejected' ELSE status END AS status FROM edges""")
def edge_verdict(spark, d):
    """One edge rejected by a person."""
    from . import catalogue

    # The least id comes from the same plan, so that both readings of the edges share what is shuffled to find pairs.
    e = catalogue._edges(spark, d)
    least = F.broadcast(e.agg(F.min("edge_id").alias("least")))  # one row
    return graph.set_status(e.join(least), F.col("least"), "rejected").select("edge_id", "status")


@query(f"""WITH {A.PAIRS_SQL} SELECT src, dst, substr(sha1('doc_doc|' || src || '|' || dst), 1, 16) AS request_id FROM pairs WHERE NOT counterparty""")
def requests_prepared(spark, d):
    """Pairs without a verdict that still holds, with request ids; pairs that share a counterparty have one."""
    from . import catalogue

    cache = graph.pair_signature(catalogue._pairs(spark, d, "counterparty")).select("pair_key", "signature")
    return graph.prepare_requests_of(A.profiles(spark, d).drop("node"), cache, wide=None, parts=A.pair_parts(spark, d)).select("src", "dst", "request_id")


@query(f"""WITH {A.EDGES_SQL} SELECT edge_id, relation, confidence, status FROM edges WHERE relation = 'amount_consistent'""")
def replies_ingested(spark, d):
    """Replies that name a relation become edges with confidences of our own; unknown relations go."""
    from . import catalogue

    pairs = catalogue._pairs(spark, d)
    requests = pairs.withColumn("request_id", graph.request_id(F.lit("doc_doc"), F.col("src"), F.col("dst")))
    replies = requests.select("request_id", F.when(F.col("amount"), "amount_consistent").otherwise("friends").alias("relation"))
    return graph.ingest_replies(requests, replies).select("edge_id", "relation", "confidence", "status")


@query(f"""WITH {A.EDGES_SQL}, e AS (SELECT edge_id, 'src' AS side, src_doc AS doc_key, shared FROM (SELECT e.edge_id, e.src_doc, e.dst_doc, p.shared FROM edges e JOIN pairs p USING (src, dst) WHERE relation = 'amount_consistent') UNION ALL
SELECT edge_id, 'dst', dst_doc, shared FROM (SELECT e.edge_id, e.src_doc, e.dst_doc, p.shared FROM edges e JOIN pairs p USING (src, dst) WHERE relation = 'amount_consistent')),
w AS (SELECT edge_id, side, doc_key, unnest(list_transform(shared, lambda s: string_split(s, '=')[-1])) AS wanted FROM e)
SELECT edge_id, side, min(fact_id) AS fact_id FROM w JOIN facts USING (doc_key) WHERE contains(replace(value, ',', ''), wanted) GROUP BY 1, 2""")
def edges_justified(spark, d):
    """For each edge of equal amounts and each side the first fact that holds a shared value."""
    return graph.judge_justified(graph.profiles(A.facts_by_document(spark, d), proofs=True), "amount_consistent", wide=None)


@query(f"""WITH {A.FACTS_SQL}, k AS (SELECT *, CASE WHEN header IN ({", ".join(f"'{w}'" for w in L.FIELD_WORDS)}) THEN 0 WHEN regexp_matches(value, '[0-9]') THEN 1 ELSE 2 END AS rank FROM facts),
t AS (SELECT doc_key, string_agg(header || ': ' || value, ';' ORDER BY rank, fact_id) AS key_facts FROM k GROUP BY 1)
SELECT o_orderkey AS doc_no, 'O' || o_orderkey AS doc_key, CASE WHEN o_custkey % 2 = 0 THEN 'doc_type=' || o_orderpriority || '; status=' || o_orderstatus END AS features, key_facts FROM orders JOIN t ON doc_key = 'O' || o_orderkey""")
def cards_assembled(spark, d):
    """Index cards with features and key facts."""
    o = A.table(spark, d, "orders")
    key = F.concat(F.lit("O"), "o_orderkey").alias("doc_key")
    docs = o.select(F.col("o_orderkey").alias("doc_no"), key, F.lit("合同").alias("category"), F.lit("").alias("summary"))
    each = F.array(F.struct(F.lit("status").alias("code"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("doc_type").alias("code"), F.col("o_orderpriority").alias("value")))
    features = o.filter("o_custkey % 2 = 0").select(key, F.explode(each).alias("f")).select("doc_key", "f.*")
    # All documents' facts are read; those of invoices have no card here and are left before they are brought together.
    own = A.facts_by_document(spark, d).filter("doc_key like 'O%'")
    return cards.load_cards(docs, features, own).select("doc_no", "doc_key", "features", F.array_join("key_facts", ";").alias("key_facts"))


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label AS doc_key, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS similarity FROM embeddings, q)
SELECT doc_key, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY similarity DESC NULLS LAST, vec_id) = 1""")
def documents_retrieved(spark, d):
    """Each document once, by its chunk nearest to a vector."""
    e = A.table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.filter("vec_id = 0").first()["embedding"]])
    return cards.dedupe_documents(e.select(F.col("label").alias("doc_key"), "vec_id", F.round(cards.cosine(F.col("embedding"), q), 6).alias("similarity")))


@query("""WITH k AS (SELECT DISTINCT p_name AS doc_key FROM part), h AS (SELECT doc_key, contains(doc_key, 'small') AS a, contains(doc_key, 'widget') AS b, contains(doc_key, 're') AS c FROM k),
t AS (SELECT doc_key, CASE WHEN a AND b AND c THEN 1 WHEN a AND b THEN 2 WHEN a::INT + b::INT + c::INT >= 2 THEN 3 END AS tier FROM h) SELECT doc_key, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def keyword_documents(spark, d):
    """Documents by the keywords in their keys, of the first of three tiers that has any."""
    return router.keyword_docs(A.table(spark, d, "part").select(F.col("p_name").alias("doc_key")).distinct(), ["small", "widget", "re", "x"])
