"""Single-value functions and masking against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import lexicon as L
from docketry.functions import masking as M
from docketry.functions import scalar as S
from docketry.plans import router


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("header", "category"),
    [("单位", None), ("单位全称", "company"), ("甲方（公章）：", "company"), ("申请单位", "company"), ("开户行", "bank_name"), ("合同金额", None), ("经办人：", "party"), ("税号", "tax_id"), ("", None)],
)
def test_match_category(spark, header, category):
    from docketry.operators.layout import category_of

    assert one(spark, S.match_category(F.col("h")), h=header) == category
    assert category_of(header) == category


@pytest.mark.parametrize(("category", "value", "ok"), [("company", "株", False), ("company", "无锡某某城市服务有限公司", True), ("company", "合同名称", False), ("party", "张晓晓", True), ("party", "合格", False), ("date", "2026年9月", True), ("company", "350元", False)])
def test_value_acceptable(spark, category, value, ok):
    assert (one(spark, S.value_acceptable(F.col("c"), F.col("v")), c=category, v=value) is None) == ok


def test_small_functions(spark):
    assert one(spark, S.number(F.col("a")), a="1,234,567.89 元") == 1234567.89
    assert one(spark, S.number(F.col("a")), a="无") is None
    assert one(spark, S.strip_space(F.col("a")), a=" a　b\tc ") == "abc"
    assert one(spark, S.date_parts(F.col("a"))["day"], a="2026年9月1日") == "2026-09-01"
    assert one(spark, S.contract_code(F.col("a")), a="ab-1 苗木 ht-2026-001合同 x-1-2-3") == "HT-2026-001"
    assert one(spark, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(S.split_copy_marker(F.col("a")))]), a="d/合同（2026年）（2）.docx")[0] == "合同（2026年）"
    assert one(spark, S.clip(F.col("a"), 10), a="一二三四五六七。八九十") == "一二三四五六七。"
    assert one(spark, S.coerce(F.col("a"), "boolean"), a="已") is True
    assert one(spark, S.excel_date(F.col("a"), F.lit("开票日期")), a="46266") == "2026-09-01"
    assert one(spark, S.project_core(F.col("a")), a="《南苑 消防建设项目》") == "南苑消防"
    assert one(spark, S.codes_in(F.col("a")), a="[本公司·CO0001] PT0002 XCO0003 CO00045") == ["CO0001", "CO00045", "PT0002"]
    assert one(spark, S.already_masked(F.col("a")), a="甲方：CO0003")
    assert one(spark, S.invoice_fields(F.col("a")), a="发票号码：12345678\n价税合计（小写）¥1,200.50\n2026年9月1日")["total"] == 1200.5
    assert one(spark, S.node_doc(F.col("a")), a="row:A/b#t1r2") == "A/b"


def test_classify(spark):
    kind = lambda n, *p: one(spark, S.classify_document(F.col("n"), F.col("p")), n=n, p=list(p))
    assert kind("x.pdf", "合同编号：\n苗木采购合同\n正文") == "合同"
    assert kind("x.xlsx", "苗木采购合同") == L.OTHER
    assert kind("付款申请.docx", "付款申请\ntable:合同名称 | 苗木采购合同\n合同金额") == L.OTHER
    assert kind("a.xlsx", "text:正文\nheader:增值税专用发票") == "发票"
    assert kind("a.xlsx", "运单 运单 发票") == "物流凭证"


CASES = [
    ("开户行账号：106535801040010703", "bank_account"), ("PO-202606000000017", None), ("327981.651376147", None), ("6222 0000 0000 0000 123", "bank_card"), ("甲方：CO0003", None),
    ("身份证 110101199003071234。", "id_card"), ("手机13800138000", "phone"), ("付款方：宁波银行无锡分行，", "bank_name"), ("甲方：无锡某某服务有限公司", "company"), ("乙方：张三（个人）", "party"), ("纳税人识别号：91320200MA1XYZ0001", "tax_id"), ("签于2026年9月1日", "date"),
]


@pytest.mark.parametrize(("text", "category"), CASES)
def test_spans(text, category):
    assert [s[2] for s in M.spans_of(text)] == ([category] if category else [])


def test_names_everywhere_and_registered():
    text = "甲方：无锡某某服务有限公司\n见无锡某某服务有限公司与南苑项目"
    spans = M.spans_of(text, {"南苑": "project"})
    assert [(text[a : a + n], c) for a, n, c, _ in spans] == [("无锡某某服务有限公司", "company"), ("无锡某某服务有限公司", "company"), ("南苑", "project")]


def test_masking_round(spark):
    from docketry.operators import registry

    docs = spark.createDataFrame([("a", 1, "甲方：无锡某某服务有限公司 手机13800138000"), ("b", 2, "乙方：无锡某某服务有限公司"), ("c", 3, "plain")], "doc_key string, doc_no long, text string")
    found = docs.select("doc_key", "doc_no", M.discover("text").alias("spans"))
    each = found.select("doc_no", F.explode("spans").alias("s")).select("s.category", "s.value", "doc_no", F.col("s.start").alias("place"))
    none = spark.createDataFrame([], "category string, norm_key string, code string")
    codes = registry.issue_codes(each, none, spark.createDataFrame([("company", 7)], "category string, last_seq int"))
    out = {r["doc_key"]: r["masked"] for r in M.apply_codes(docs, found, codes).collect()}
    assert out == {"a": "甲方：CO0008 手机138****8000[PH0001]", "b": "乙方：CO0008", "c": "plain"}
    again = spark.createDataFrame(list(out.items()), "doc_key string, text string").select(M.discover("text").alias("s"))
    assert again.filter(F.size("s") > 0).count() == 0  # masked text has nothing left to mask


def test_mask_cells(spark):
    rows = spark.createDataFrame([(["姓名", "单位"], [["张三丰", "株"], [None, "棵"]])], "header array<string>, rows array<array<string>>")
    assert rows.select(M.mask_table(F.col("rows"), F.col("header"))).first()[0] == [["张*丰", "株"], [None, "棵"]]
    assert one(spark, M.mask_kv_row(F.col("r")), r=["开户行", "宁波银行", "联系电话", "13800138000"]) == ["开户行", "宁**行", "联系电话", "138****8000"]


@pytest.mark.parametrize(
    ("question", "action"),
    [("库里有多少份文件？", "count_docs"), ("一共几份合同？", "count_docs"), ("有哪些文件？", "list_docs"), ("图里有多少条边？", "count_edges"), ("库里有多少条事实？", "count_facts"), ("仓库里有什么？", "overview"),
     ("发票金额是否一定等于合同金额？", None), ("为什么这个月扣款这么多？", None), ("HT-2026-0001 这个合同都关联了哪些单据？", None), ("上月新增了几份合同？", None)],
)
def test_route(question, action):
    assert (router.route(question) or {}).get("action") == action


def test_parse_query():
    p = router.parse_query("[本公司·CO0001] 的 HT-2026-0001 合同金额 350,000.00 对应哪张发票")
    assert (p["codes"], p["doc_nos"], p["amounts"], p["types"], p["reverse"]) == (["CO0001"], ["HT-2026-0001"], ["350,000.00"], ["发票", "合同"], True)
    assert "contract_to_invoice" in p["relations"]
    assert router.unsupported_condition("上月几份合同") == "上月"
    assert router.field_words("合计金额是多少")[0] == "总额"


APART = [
    ("卡 6222 0000\n0000 0000 123 止", "6222 0000\n0000 0000 123", "bank_card"), ("6222/0000/0000/0000/123", "6222/0000/0000/0000/123", "bank_card"),
    ("证件１１０１０１１９９００３０７１２３４ 完", "１１０１０１１９９００３０７１２３４", "id_card"), ("票据号 6222000000000000123", None, None), ("3636558.96×0.9-8400=789814.72", None, None),
    ("订单编号：6222 0000 0000 0000 123", None, None), ("PO-6222 0000 0000 0000 123", None, None),
]


@pytest.mark.parametrize(("text", "value", "category"), APART)
def test_digits_apart(text, value, category):
    assert [(s[3], s[2]) for s in M.spans_of(text)] == ([(value, category)] if value else [])


def test_company_tails():
    assert M.company_tail("北京某某有限公司上海分公司") == "北京某某有限公司上海分公司" and M.company_tail("宁波某某股份有限公司等") == "宁波某某股份有限公司" and M.company_tail("张三") == "张三"


def test_ascii_comma_is_ignored():
    assert router.route("一共有多少份文件,")["action"] == "count_docs"


@pytest.mark.parametrize(("name", "core"), [("南苑工程工程工程", "南苑"), ("A项目工程", "A项目"), ("XY项目工程项目工程", "XY项目"), ("X建设项目工程", "X建设"), ("工程", "工程"), ("", "")])
def test_project_core_rounds(spark, name, core):
    assert one(spark, S.project_core(F.col("a")), a=name) == core
