"""Queries of value functions: each runs over a whole table, whose columns are made into the values that the function is for.

The made columns are plain expressions that Spark and DuckDB both know; what the function does is written again in the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import masking as M
from ..functions import scalar as S
from ..operators import ledger, registry
from . import adapters as A
from .entries import query


def _made(table: str, **columns: str):
    """A table of made columns: its DataFrame builder and its SQL."""
    sql = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return lambda spark, d: A.table(spark, d, table).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]), f"(SELECT {sql} FROM {table})"


def _pick(key: str, *values: str) -> str:
    """One of the expressions by a key's remainder."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_typed, _typed_sql = _made("orders", k="o_orderkey", money="' ' || CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) || ' '", yes=_pick("o_custkey", "'是'", "' √ '", "'No'", "'×'", "'也许'"), n=_pick("o_custkey", "'12,345'", "'1.5.2'", "''"))


@query(f"SELECT k, trim(money)::DOUBLE AS money, CASE WHEN yes IN ('是', ' √ ') THEN true WHEN yes IN ('No', '×') THEN false END AS yes, CASE WHEN n = '12,345' THEN 12345 END AS n FROM {_typed_sql}")
def typed_cells(spark, d):
    """User text as column types; what doesn't fit is null."""
    return _typed(spark, d).select("k", S.coerce(F.col("money"), "double").alias("money"), S.coerce(F.col("yes"), "boolean").alias("yes"), S.coerce(F.col("n"), "int").alias("n"))


_KINDS = ("id_card", "bank_account", "tax_id", "date", "bank_name", "phone", "company", "party")
_values, _values_sql = _made(
    "orders", k="o_orderkey", category=_pick("o_orderkey", *[f"'{c}'" for c in _KINDS]),
    value=_pick(
        "o_custkey", "'1101011990' || lpad(CAST(o_custkey AS STRING), 7, '0') || 'X'", "' 6222 0000-' || lpad(CAST(o_orderkey AS STRING), 8, '0') || ' '", "'91320200MA' || lpad(CAST(o_custkey AS STRING), 8, '0')", "'2026年' || CAST(1 + o_custkey % 12 AS STRING) || '月3日'",
        "'宁波银行第' || CAST(o_custkey AS STRING) || '支行'", "'138' || lpad(CAST(o_custkey AS STRING), 8, '0')", "'无锡' || CAST(o_custkey AS STRING) || '有限公司'", "'张三'", "''", "repeat('长', 61)", "'x' || CAST(o_custkey AS STRING)",
    ),
)


@query(rf"""WITH v AS (SELECT k, category, value, trim(value) AS s FROM {_values_sql}), b AS (SELECT *, regexp_replace(s, '[\s\-]', '', 'g') AS bare FROM v)
SELECT k, category, value, s <> '' AND length(s) <= CASE category WHEN 'company' THEN 40 WHEN 'party' THEN 20 WHEN 'bank_name' THEN 60 WHEN 'date' THEN 12 ELSE 1000 END AND CASE category
WHEN 'id_card' THEN regexp_full_match(s, '[0-9]{{17}}[0-9Xx]') WHEN 'bank_account' THEN regexp_full_match(bare, '[0-9]{{12,19}}') WHEN 'tax_id' THEN regexp_full_match(replace(s, ' ', ''), '[0-9A-Z]{{15,20}}')
WHEN 'date' THEN regexp_full_match(s, '{L.DATE[1:-1]}') WHEN 'bank_name' THEN regexp_matches(s, '[一-龥]') AND (contains(s, '银行') OR length(s) >= 4)
WHEN 'phone' THEN regexp_full_match(regexp_replace(s, '[^0-9]', '', 'g'), '1[3-9][0-9]{{9}}|0[0-9]{{9,11}}')
ELSE regexp_matches(s, '[一-龥]') AND NOT regexp_full_match(s, '{L.DATE[1:-1]}') AND NOT regexp_full_match(bare, '[0-9]{{12,}}') END AS valid FROM b""")
def value_valid(spark, d):
    """Values of every category against the format of each."""
    return _values(spark, d).select("k", "category", "value", S.value_valid(F.col("value"), F.col("category")).alias("valid"))


_heads, _heads_sql = _made("part", k="p_partkey", header=_pick("p_partkey", "'开户行'", "' 银行账号：'", "'单位'", "'单位全称'", "'甲方（公章）：'", "'施工企业'", "'经办人'", "'公司'", "'合同金额'", "'联系电话(' || p_brand || ')'", "p_name", "''", "'付款日期 ='"))


def _category_sql(core: str) -> str:
    rules = " ".join(f"WHEN {' OR '.join(f'contains({core}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{c}'" for c, words in L.HEADER_RULES)
    return f"CASE WHEN {core} = '' OR {core} IN ({_list(L.AMBIGUOUS_HEADERS)}) THEN NULL ELSE CASE {rules} WHEN length({core}) >= 3 AND regexp_matches({core}, '(单位|公司|企业|集团)$') THEN 'company' END END"


@query(f"""WITH c AS (SELECT k, header, regexp_replace(trim(regexp_replace(regexp_replace(trim(header), '[：:=＝ ]+$', ''), '[（(][^）)]*[）)]', '', 'g')), '[：:=＝ ]+$', '') AS core FROM {_heads_sql})
SELECT k, header, {_category_sql("core")} AS category FROM c""")
def header_semantics(spark, d):
    """P25: what headers mean; ambiguous ones mean nothing."""
    return _heads(spark, d).select("k", "header", S.match_category(F.col("header")).alias("category"))


_names, _names_sql = _made("orders", k="o_orderkey", category=_pick("o_orderkey", "'company'", "'party'", "'date'", "'tax_id'"), code="'X' || CAST(o_orderkey AS STRING)",
                           value=_pick("o_custkey", "'株'", "'无锡市第' || CAST(o_custkey AS STRING) || '工程有限公司'", "'合同名称'", "'张晓晓（个人）'", "'某某'", "'2026年9月'", "'350元'", "''", "'备注如上'", "'甲；乙'", "'本合同名称：'"))
_SUFFIXES = "|".join(sorted(L.COMPANY_SUFFIXES, key=len, reverse=True))


@query(rf"""WITH n AS (SELECT *, regexp_replace(value, '[：:=＝ ]+$', '') AS lab, trim(regexp_replace(value, '[（(].*?[)）]', '', 'g')) AS core FROM {_names_sql}),
r AS (SELECT k, category, code, value, CASE WHEN category IN ('company', 'party') AND value = '' THEN 'empty' WHEN category IN ('company', 'party') AND value IN ({_list(L.UNITS)}) THEN 'unit'
WHEN category IN ('company', 'party') AND regexp_matches(value, '{L.MONEY}') THEN 'amount' WHEN category IN ('company', 'party') AND regexp_matches(value, '{L.DATE_FRAGMENT}') THEN 'date fragment'
WHEN category IN ('company', 'party') AND ({" OR ".join(f"contains(value, '{w}')" for w in L.NOISE)}) THEN 'punctuation' WHEN category IN ('company', 'party') AND regexp_matches(value, '^(已付|已收|大写|本次|备注|说明|注：)') THEN 'remark'
WHEN category IN ('company', 'party') AND length(value) <= 1 THEN 'single character' WHEN category IN ('company', 'party') AND len(list_filter([{_list(L.LABELS)}], lambda w: ends_with(lab, w) AND length(lab) <= length(w) + 2)) > 0 THEN 'label'
WHEN category = 'company' AND NOT regexp_full_match(value, '[一-龥A-Za-z0-9（）()·\-]{{2,40}}({_SUFFIXES})[一-龥A-Za-z0-9（）()·\-]{{0,20}}') THEN 'no company suffix'
WHEN category = 'party' AND NOT regexp_full_match(core, '[一-龥·]{{2,4}}') THEN 'not a name' WHEN category = 'party' AND NOT contains('{L.SURNAMES}', core[1]) THEN 'no surname'
WHEN category = 'date' AND NOT regexp_matches(value, '{L.DATE_FRAGMENT}') THEN 'not a date' END AS reason FROM n) SELECT * FROM r WHERE reason IS NOT NULL""")
def registration_faults(spark, d):
    """Registrations that the structural rules refuse, with the reason."""
    return registry.scan_dirty(_names(spark, d))


_banks, _banks_sql = _made("customer", k="c_custkey", value=_pick("c_custkey", "'宁波银行无锡分行'", "'开户银行'", "'某信用社'", "'无锡' || c_name || '支行'", "'银行账号'", "c_name", "'行'", "'中国银行卡'"))


@query(f"SELECT k, value, length(value) >= 2 AND NOT regexp_full_match(value, '.?({'|'.join(L.BANK_LABEL_TAILS)})') AND ({' OR '.join(f'contains(value, {chr(39)}{b}{chr(39)})' for b in L.BANKS)} OR regexp_matches(value, '{L.BANK_TAIL}')) AS plausible FROM {_banks_sql}")
def bank_names(spark, d):
    """Which values name a bank."""
    return _banks(spark, d).select("k", "value", S.bank_name_plausible(F.col("value")).alias("plausible"))


_coded, _coded_sql = _made("orders", k="o_orderkey", value=_pick("o_custkey", "'甲方：CO' || lpad(CAST(o_custkey AS STRING), 4, '0')", "'[本公司·CO0001]'", "'TX' || lpad(CAST(o_custkey AS STRING), 5, '0')", "'[TX0001]'", "'XCO0001'", "'CO001'", "'见 PT0007x'", "CAST(o_orderkey AS STRING)"))


@query(rf"SELECT k, value, regexp_matches(value, '\[(本公司·)?({'|'.join(sorted(L.PREFIXES.values()))})[0-9]{{2,}}\]') OR regexp_matches(value, '(^|[^A-Za-z])(CO|PT|DT)[0-9]{{4,}}($|[^0-9])') AS masked FROM {_coded_sql}")
def masked_already(spark, d):
    """Values that hold a code."""
    return _coded(spark, d).select("k", "value", S.already_masked(F.col("value")).alias("masked"))


_logs, _logs_sql = _made("events", k="event_id", line=_pick("event_id", "'Authorization: Bearer ' || md5(event_type) || ' ok'", "'key sk-' || md5(event_type)", "'api_key=' || md5(event_type) || ', user=7'", "'Password: \"x y\"'", "event_type"))


@query(r"""SELECT k, CASE k % 5 WHEN 0 THEN 'Authorization: Bearer *** ok' WHEN 1 THEN 'key sk-***' WHEN 2 THEN 'api_key=***, user=7' ELSE line END AS line FROM """ + _logs_sql)
def secret_redaction(spark, d):
    """Log lines without their secrets."""
    return _logs(spark, d).select("k", S.redact_secrets(F.col("line")).alias("line"))


@query("SELECT event_id AS k, CASE WHEN event_id % 4 <> 3 THEN (props->>'k')::INT END AS n FROM events")
def reply_objects(spark, d):
    """The JSON object of each reply that words and marks stand around; none where there is no object."""
    e = A.table(spark, d, "events")
    reply = F.when(F.col("event_id") % 4 == 3, "无").otherwise(F.concat(F.lit("﻿好的：\n​"), "props", F.lit("。")))
    return e.select(F.col("event_id").alias("k"), S.json_object(reply, "k int")["k"].alias("n"))


@query("SELECT o_orderkey, o_totalprice::DECIMAL(15,2)::DOUBLE AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus FROM orders")
def json_safe(spark, d):
    """Decimals as doubles and times as ISO text."""
    o = A.table(spark, d, "orders")
    return S.jsonable(o.select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_custkey % 3 = 1 THEN date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::VARCHAR ELSE '19999' END AS value FROM orders""")
def excel_dates(spark, d):
    """Serial numbers in date columns become dates, other numbers and columns stay."""
    o = A.table(spark, d, "orders")
    serial = F.when(F.col("o_custkey") % 3 == 2, "19999").otherwise(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string"))
    return o.select(F.col("o_orderkey").alias("k"), S.excel_date(serial, F.when(F.col("o_custkey") % 3 == 1, "数量").otherwise("开票日期")).alias("value"))


_nodes, _nodes_sql = _made("orders", k="o_orderkey", node=_pick("o_orderkey", "'doc:O' || CAST(o_orderkey AS STRING)", "'row:A/O' || CAST(o_orderkey AS STRING) || '#t1r2'", "'table:O1#t3'", "'entity:CO0001'"))


@query(f"SELECT k, CASE WHEN node LIKE 'entity:%' THEN NULL ELSE split_part(substr(node, strpos(node, ':') + 1), '#', 1) END AS doc_key FROM {_nodes_sql}")
def node_docs(spark, d):
    """The document of each node."""
    return _nodes(spark, d).select("k", S.node_doc(F.col("node")).alias("doc_key"))


_projects, _projects_sql = _made("part", k="p_partkey", name="p_name", kind=_pick("p_partkey", "'建设项目'", "'工程'", "'工程工程'", "'项目工程项目工程'", "''"))


@query(f"""SELECT k, regexp_replace(name, '\\s+', '', 'g') || CASE kind WHEN '项目工程项目工程' THEN '项目' ELSE '' END AS core, sha256(regexp_replace(name, '\\s+', '', 'g') || kind) AS fingerprint FROM {_projects_sql}""".replace("\\\\", "\\"))
def project_names(spark, d):
    """Project names without wrapping, and their cores without kinds of project; rounds try each kind once, in order."""
    name = F.concat(F.lit("《"), "name", F.lit(" "), "kind", F.lit("》[CO0001]"))
    return _projects(spark, d).select("k", S.project_core(name).alias("core"), S.project_fingerprint(name).alias("fingerprint"))


@query("""SELECT o_orderkey AS k, 'HT-' || o_orderkey AS contract_code, '两年' AS contract_term, CASE WHEN o_custkey % 2 = 0 THEN c_name END AS party_a, o_totalprice::DECIMAL(15,2)::DOUBLE AS amount, strftime(o_orderdate, '%Y-%m-%d') AS sign_date, 'note=' || o_orderstatus AS extra
FROM orders JOIN customer ON o_custkey = c_custkey""")
def ledger_rows(spark, d):
    """Replies about contracts as ledger rows; fields that nobody knows are kept as extra."""
    o = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    party = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.col("c_name"), F.lit(" "))).otherwise(" ")
    reply = F.to_json(F.struct(F.concat(F.lit(" ht-"), "o_orderkey").alias("contract_code"), F.lit("两年").alias("contract_term"), party.alias("party_a"), F.concat(F.lit("￥"), F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("元")).alias("amount"), F.date_format("o_orderdate", "yyyy年M月d日").alias("sign_date"), F.col("o_orderstatus").alias("note")))
    row = o.select(F.col("o_orderkey").alias("k"), S.ledger_row(F.concat(F.lit("结果：\n"), reply)).alias("r")).select("k", "r.*")
    return row.withColumn("extra", F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))


_files, _files_sql = _made("orders", k="o_orderkey", name=_pick("o_orderkey", "'采购合同.pdf'", "'x' || CAST(o_orderkey AS STRING) || '.docx'", "'电子发票.xlsx'", "'单据.xlsx'", "'单据.xlsx'", "'扫描.png'"),
                           page=_pick("o_custkey", "'苗木采购合同' || chr(10) || '正文'", "'header:增值税专用发票' || chr(10) || 'text:运单'", "'运单 运单 发票'", "'合同编号：' || CAST(o_orderkey AS STRING)", "'无'"))


@query(f"""WITH f AS (SELECT k, name, k % 6 AS n, c, CASE c % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'invoice head' WHEN 2 THEN 'words' ELSE 'none' END AS kind FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders) JOIN {_files_sql} USING (k))
SELECT k, category, CASE category WHEN '合同' THEN 'contract' WHEN '发票' THEN 'invoice' ELSE 'other' END AS kind, n IN (0, 1) AND (n = 0 OR kind = 'title') AS contract FROM (
SELECT *, CASE WHEN n = 0 OR n = 1 AND kind = 'title' THEN '合同' WHEN n = 2 THEN '发票' WHEN kind = 'invoice head' THEN '发票' WHEN kind = 'words' THEN '物流凭证' ELSE '其它' END AS category FROM f)""")
def document_kinds(spark, d):
    """Contract rule, category and inbox kind of documents by name and pages."""
    f = _files(spark, d)
    pages = F.array("page")
    contract, category = S.is_contract(F.col("name"), pages), S.classify_document(F.col("name"), pages)
    return f.select("k", category.alias("category"), S.kind_of(category, contract).alias("kind"), contract.alias("contract"))


@query("""SELECT 'O' || o_orderkey AS k, o_orderkey::VARCHAR || '00000000' AS invoice_no, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, c_name AS seller, o_totalprice::DECIMAL(15,2)::DOUBLE AS total, 13.5::DOUBLE AS tax FROM orders JOIN customer ON o_custkey = c_custkey""")
def invoice_parse(spark, d):
    """Fields of invoices by the first pattern that finds them."""
    o = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    total = F.format_number(F.col("o_totalprice").cast("decimal(15,2)"), 2)
    lines = [F.concat(F.lit("发票号码："), F.col("o_orderkey").cast("string"), F.lit("00000000")), F.concat(F.lit("开票日期: "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("销售方："), "c_name"), F.lit("税额：13.50"), F.concat(F.lit("价税合计（小写）¥"), total)]
    return o.select(F.concat(F.lit("O"), "o_orderkey").alias("k"), S.invoice_fields(F.concat_ws("\n", *lines)).alias("f")).select("k", "f.invoice_no", "f.invoice_date", "f.seller", "f.total", "f.tax")


@query(f"""SELECT 'O' || o_orderkey AS doc_key, CASE WHEN o_orderkey % 2 = 0 THEN 'HT-' || o_orderkey || '-A' ELSE '无编号-合同' || o_orderkey END AS contract_code, NULL::VARCHAR AS contract_term,
CASE WHEN o_custkey % 3 = 0 THEN c_name ELSE '{L.UNCHECKED}' END AS party_a, 0.0::DOUBLE AS income, false AS is_paid FROM orders JOIN customer ON o_custkey = c_custkey""")
def contract_rows(spark, d):
    """Ledger rows of contracts, party A by its code where the code is known."""
    o = A.table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("dir/合同 ht-"), "o_orderkey", F.lit("-a.pdf"))).otherwise(F.concat(F.lit("dir/合同"), "o_orderkey", F.lit(".pdf")))
    docs = o.select(F.concat(F.lit("O"), "o_orderkey").alias("doc_key"), name.alias("name"), F.concat(F.lit("合同\n甲方（买方）： "), A.code("CO", "o_custkey"), F.lit("，下称甲方")).alias("text"))
    return ledger.contract_rows(docs, A.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(A.code("CO", "c_custkey").alias("code"), F.col("c_name").alias("real_value")))


_rows, _rows_sql = _made("orders", k="o_orderkey", a=_pick("o_orderkey", "'甲方（盖章）'", "'日期'", "'年 月 日'", "'日期：'", "''", "repeat('签字', 13)"), b=_pick("o_custkey", "''", "'2026年3月1日'", "'数量'", "'★' || CAST(o_custkey AS STRING)"))


@query(rf"""WITH c AS (SELECT k, a, b, k % 6 AS n, substr(b, 1, 1) = '★' AS star, regexp_full_match(b, '[0-9]{{4}}年.*日') AS dated FROM {_rows_sql})
SELECT k, CASE n WHEN 0 THEN true WHEN 5 THEN false WHEN 4 THEN false ELSE b = '' OR dated END AS signature, star AS note FROM c""")
def signature_rows(spark, d):
    """Signature rows and blocks of notes among rows of two cells."""
    row = F.array("a", "b")
    return _rows(spark, d).select("k", S.is_signature_row(row).alias("signature"), S.is_note_block(F.array(row)).alias("note"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '采购合同' || o_orderkey || '.docx' END AS name FROM orders")
def garbled_names(spark, d):
    """Garbled file names decoded again, the ending kept; sound names are left alone."""
    from ..sources import files

    o = A.table(spark, d, "orders")
    name = F.concat(F.lit("采购合同"), F.col("o_orderkey").cast("string"))
    wrong = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    return o.select(F.col("o_orderkey").alias("k"), files.repair_name(F.concat(F.when(F.col("o_orderkey") % 3 == 0, name).otherwise(wrong), F.lit(".docx"))).alias("name"))


@query("SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS clear, true AS hidden FROM customer")
def decrypted_fields(spark, d):
    """Encrypted names in clear only for those who may see them."""
    c = A.table(spark, d, "customer")
    key = F.lit(b"0123456789abcdef")
    sealed = c.select("c_custkey", "c_mktsegment", "c_name", M.encrypt(F.col("c_name"), key).alias("cipher"))
    return sealed.select(F.col("c_custkey").alias("k"), M.decrypt(F.col("cipher"), key, F.col("c_mktsegment") == "BUILDING").alias("clear"), (~F.contains("cipher", F.col("c_name"))).alias("hidden"))


_cells, _cells_sql = _made("customer", k="c_custkey", phone=_pick("c_custkey", "'138' || lpad(CAST(c_custkey AS STRING), 8, '0')", "'无'", "''"), name="'王' || '小' || substr('甲乙丙丁戊己庚辛壬癸', 1 + CAST(c_custkey % 10 AS INT), 1)", qty="CAST(c_custkey AS STRING)")
_PHONE_SQL = "CASE WHEN length(phone) = 11 THEN substr(phone, 1, 3) || '****' || right(phone, 4) ELSE phone END"


@query(f"SELECT k, {_PHONE_SQL} AS phone, '王*' || right(name, 1) AS name, qty, {_PHONE_SQL} AS kv, repeat('{L.FAIL_CLOSED}', 2) AS closed FROM {_cells_sql}")
def table_masked(spark, d):
    """Rows masked by their columns' meaning, by the label before a value, and blanked altogether."""
    row, head = F.array("phone", "name", "qty"), F.array(F.lit("联系电话"), F.lit("姓名"), F.lit("数量"))
    kv, closed = F.array(F.lit("联系电话"), "phone"), F.array(F.array("phone", "qty"))
    got = _cells(spark, d).select("k", M.mask_table(F.array(row), head)[0].alias("r"), M.mask_kv_row(kv)[1].alias("kv"), F.array_join(M.fail_closed(closed)[0], "").alias("closed"))
    return got.select("k", F.col("r")[0].alias("phone"), F.col("r")[1].alias("name"), F.col("r")[2].alias("qty"), "kv", "closed")


@query(f"SELECT k % 7 AS table_id, count(*) * 2 AS cells, count(*) FILTER (length(phone) = 11) AS masked, count(*) FILTER (length(phone) < 11) AS skipped_format, '联系电话=phone' AS columns FROM {_cells_sql} GROUP BY 1")
def masking_stats(spark, d):
    """Cells, masked cells and cells skipped for their format, by table."""
    c = _cells(spark, d)
    cells = c.select((F.col("k") % 7).alias("table_id"), F.lit("联系电话").alias("header"), F.col("phone").alias("value")).unionByName(c.select((F.col("k") % 7).alias("table_id"), F.lit("数量").alias("header"), F.col("qty").alias("value")))
    return M.mask_stats(cells).withColumn("columns", F.array_join("columns", ","))


@query("SELECT substr(sha256(string_agg(r || '=' || t, '|' ORDER BY r)), 1, 32) AS tag FROM (SELECT o_orderpriority AS r, strftime(max(o_orderdate), '%Y-%m-%d') AS t FROM orders GROUP BY 1)")
def config_tag(spark, d):
    """A fingerprint of the latest change of every registry."""
    o = A.table(spark, d, "orders")
    return M.config_tag(o.select(F.col("o_orderpriority").alias("registry"), F.col("o_orderdate").cast("date").alias("updated_at")))


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\\s\\x{3000}\\x0b\\p{Z}]+', '', 'g')) >= 20 AS native FROM documents".replace("\\\\", "\\"))
def text_pages(spark, d):
    """Texts long enough that no recognition is needed."""
    return A.table(spark, d, "documents").select("doc_id", S.is_text_page(F.col("text")).alias("native"))
