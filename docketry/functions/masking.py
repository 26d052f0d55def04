"""Pseudonymising free text and tables.

Masking with stable codes is done in two passes so that it needs no shared counter: ``discover`` finds the spans of every
document with the ordered rules (an Arrow-batched UDF: look-around and per-document state aren't expressible natively);
``operators.registry.issue_codes`` gives each distinct value one code; ``apply_codes`` writes them back in one pass.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from . import lexicon as L
from .scalar import mask_value, match_category, trim_space, value_valid

SPAN = StructType([StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("category", StringType()), StructField("value", StringType())])

#: Fixed patterns of free text, tried in this order; a later one never overlaps what an earlier one has taken.
_UNDERLINE = r"\$\s*\\underline\{\\text\{([^}]+)\}\}\s*\$"
_PARTY = r"(?:（[^）]+）|\([^\)]+\))?(?:[:：]\s*(?:" + _UNDERLINE + r"|([^\n，,。；;]{2,60}))|\s*" + _UNDERLINE + ")"
_KNOWN_BANK = "(?:" + "|".join(sorted(map(re.escape, L.BANKS), key=len, reverse=True)) + r")(?:[一-龥]{0,10}(?:分行|支行|营业部|分理处|办事处|储蓄所))?"
_COMPANY_TAIL = r"(?:有限责任公司|有限公司|集团有限公司|集团|事务所|人民政府|管理局|委员会|事业部|中心)"
TEXT_RULES = (
    ("bank_name", r"(?:开户行|开户银行|开户机构|银行名称|开户网点)\s*[:：]?\s*([\u4e00-\u9fa5A-Za-z0-9（）()·]{2,24}?)(?=[\s，,。；;：:、]|$)"),
    ("bank_name", _KNOWN_BANK),
    ("party_a", "甲方" + _PARTY),
    ("party_b", "乙方" + _PARTY),
    ("company", r"(?:(?<=^)|(?<=[\s，,。；;：:（(“\"、]))[\u4e00-\u9fa5A-Za-z0-9（）()·]{2,40}?" + _COMPANY_TAIL),
    ("date", r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?"),
    ("tax_id", r"(?:纳税人识别号|纳税识别号|纳税人识别码|统一社会信用代码|税号)\s*[:：]?\s*([0-9A-Z]{15,20})"),
    ("tax_id", r"(?<![0-9A-Z])(?=[0-9A-HJ-NP-RT-UW-Y]{0,17}[A-HJ-NP-RT-UW-Y])[0-9A-HJ-NP-RT-UW-Y]{18}(?![0-9A-Z])"),
    ("bank_account", r"(?:账号|帐号|账户|银行账号|对公账号|卡号|银行账户)\s*[:：]?\s*((?:\d[\s\-]?){11,18}\d)"),
    ("bank_account", r"银行[^\d]{0,15}((?:\d[\s\-]?){11,18}\d)"),
    ("phone", r"(?<!\d)(?:1[3-9]\d{9}|0\d{2,3}[\-\s]?\d{7,8}(?:[\-\s]?\d{1,6})?)(?!\d)"),
    ("id_card", r"(?<!\d)\d{17}[\dXx](?!\d)"),
    ("bank_card", r"(?<![0-9A-Za-z])(?<![A-Za-z]-)\d{13,19}(?![0-9A-Za-z])"),
)
#: Fixed patterns of numbers written with separators: the run, what in or beside it makes it an amount or an expression, and
#: what before it makes it a document's number.
DIGIT_RUN = re.compile(r"(?<![\dXx])[\dXx](?:[\s\-_/．.·]{0,2}[\dXx])*")
DECIMAL = re.compile(r"\.\d+")
MATH_NEIGHBOURS = "×*=+%"
DOC_NO_HINT = re.compile(r"(票据号|凭证号|发票号码|票据|编号|单号|订单|票号|号码|发文|代码|券号|No\.?|NO\.?)\s*[:：]?\s*[A-Za-z\-]{0,4}$")
#: Fixed suffixes up to the last of which a company's name goes.
COMPANY_TAILS = ("股份有限公司", "有限责任公司", "集团有限公司", "有限公司", "分公司", "人民政府", "事务所", "管理局", "委员会", "事业部", "中心", "集团")
_COMPILED = tuple((c, re.compile(p, re.MULTILINE)) for c, p in TEXT_RULES)
_CODE = re.compile(L.CODE)
_ACCOUNT_HINT = re.compile("(账号|帐号|账户|开户行账|银行账|卡号|联行)")
_DOC_NO_LEFT = re.compile(r"[A-Za-z]{1,6}[-_]?[0-9]*$")


def company_tail(name: str) -> str:
    """Up to the last organisation suffix (M3)."""
    return name[: max((name.rfind(t) + len(t) for t in COMPANY_TAILS if t in name), default=len(name))]


def digit_runs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, category) of id and card numbers whose digits stand apart or on two lines (M6): 18 with their check
    character are an id, 13 to 19 a card. Amounts, operands and numbers of documents are none."""
    found = []
    for m in DIGIT_RUN.finditer(text):
        a, b = m.span()
        bare = "".join(c for c in m.group(0) if c.isdecimal() or c in "Xx")
        kind = "id_card" if re.fullmatch(r"\d{17}[\dXx]", bare) else "bank_card" if re.fullmatch(r"\d{13,19}", bare) else None
        before = text[max(0, a - 9) : a]
        amount = DECIMAL.search(m.group(0)) or before[-1:] in tuple(MATH_NEIGHBOURS) or text[b : b + 1] in tuple(MATH_NEIGHBOURS)
        if kind and not amount and not re.search(r"[A-Za-z]-?$", before) and not DOC_NO_HINT.search(before):
            found.append((a, b, kind))
    return found


def person_cut(name: str) -> str:
    """Up to the first bracket (M3)."""
    return re.split(r"[（(]", name, maxsplit=1)[0]


def resolve_company(span: str, known: list[str]) -> str:
    """The longest name already seen in this document that the span ends with, else the span (M4)."""
    return max((k for k in known if span.endswith(k)), key=len, default=span)


def spans_of(text: str, names: dict[str, str] | None = None) -> list[tuple[int, int, str, str]]:
    """(start, length, category, value) of everything to mask, in order, without overlaps (M1, M2, M6, M7).

    names: registered names (value -> category), longest first before all rules (M8). Codes already in the text stay.
    """
    text = text or ""
    taken = [False] * len(text)
    for m in _CODE.finditer(text):
        taken[m.start() : m.end()] = [True] * (m.end() - m.start())
    out: list[tuple[int, int, str, str]] = []
    known: list[str] = []

    def take(a: int, b: int, category: str, value: str) -> None:
        if a < b and not any(taken[a:b]):
            taken[a:b] = [True] * (b - a)
            out.append((a, b - a, category, value))
            if category == "company" and value not in known:
                known.append(value)

    def everywhere(values: dict[str, str]) -> None:
        if values:
            any_ = re.compile("|".join(re.escape(v) for v in sorted(values, key=lambda v: (-len(v), v))))
            for m in any_.finditer(text):
                take(m.start(), m.end(), values[m.group(0)], m.group(0))

    everywhere({n: c for n, c in (names or {}).items() if n})
    for category, pattern in _COMPILED:
        for m in pattern.finditer(text):
            k = next((i for i in range(1, (m.lastindex or 0) + 1) if m.group(i)), 0)
            a, raw, kind = m.start(k), m.group(k), category
            value = raw.rstrip()
            if category == "bank_name" and not _plausible_bank(value):
                continue
            if category in ("party_a", "party_b"):
                if re.search(_COMPANY_TAIL, value):
                    value, kind = company_tail(value), "company"
                else:
                    value, kind = person_cut(value).strip(), "party"
                if not value or _CODE.search(value):
                    continue
            elif category == "company":
                whole = company_tail(value)
                value = resolve_company(whole, known)
                a += len(whole) - len(value)
            elif category == "id_card" and (_ACCOUNT_HINT.search(text[max(0, a - 12) : a]) or _DOC_NO_LEFT.search(text[max(0, a - 9) : a])):
                if _DOC_NO_LEFT.search(text[max(0, a - 9) : a]):
                    continue
                kind = "bank_account"
            elif category == "bank_card" and (_DOC_NO_LEFT.search(text[max(0, a - 9) : a]) or DOC_NO_HINT.search(text[max(0, a - 9) : a])):
                continue
            if raw.startswith(value):
                a = m.start(k) if category != "company" else a
            take(a, a + len(value), kind, value)
    # Numbers written apart, where nothing is taken yet; what is taken parts a run as a code in its place would.
    for a, b, kind in digit_runs("".join("\0" if t else c for c, t in zip(text, taken, strict=True))):
        take(a, b, kind, text[a:b])
    everywhere({v: c for _, _, c, v in out if c in ("company", "party")})  # the same names wherever they stand
    return sorted(out)


def _plausible_bank(s: str) -> bool:
    if len(s) < 2 or any(s.endswith(w) and len(s) <= len(w) + 1 for w in L.BANK_LABEL_TAILS):
        return False
    return any(b in s for b in L.BANKS) or re.search(L.BANK_TAIL, s) is not None


@F.pandas_udf(ArrayType(SPAN))
def discover(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("start", "length", "category", "value"), s, strict=True)) for s in spans_of(t)])


def norm_key(value: Column, category: Column) -> Column:
    """The key that a value is registered by: bare if plain and short, else sha256."""
    bare = F.regexp_replace(value, r"[\s\p{Z}]+", "")
    return F.when(~category.isin(*L.SECRET) & (F.length(bare) <= 64), bare).otherwise(F.sha2(bare, 256))


def replacement(value: Column, category: Column, code: Column) -> Column:
    """What stands for a value: the bare code, or its masked form with the code in brackets if it's secret."""
    return F.when(category.isin(*L.SECRET), F.concat(mask_value(value, category), F.lit("["), code, F.lit("]"))).otherwise(code)


def apply_spans(text: Column, spans: Column) -> Column:
    """text with spans (start, length, replacement), from right to left, in one pass."""
    last_first = F.reverse(F.array_sort(spans))
    return F.aggregate(last_first, text, lambda t, s: F.overlay(t, s["replacement"], s["start"] + 1, s["length"]))


def apply_codes(docs: DataFrame, found: DataFrame, codes: DataFrame) -> DataFrame:
    """docs with column masked; found: doc_key and spans of each document; codes: category, norm_key, code."""
    each = found.select("doc_key", F.explode("spans").alias("s")).select("doc_key", "s.*")
    each = each.withColumn("norm_key", norm_key(F.col("value"), F.col("category"))).join(codes.select("category", "norm_key", "code"), ["category", "norm_key"])
    part = F.struct("start", "length", replacement(F.col("value"), F.col("category"), F.col("code")).alias("replacement"))
    per = each.groupBy("doc_key").agg(F.collect_list(part).alias("parts"))
    joined = docs.join(per, "doc_key", "left")
    return joined.withColumn("masked", F.when(F.col("parts").isNotNull(), apply_spans(F.col("text"), F.col("parts"))).otherwise(F.col("text"))).drop("parts")


def mask_cell(value: Column, header: Column) -> Column:
    """A table cell by its column's meaning: masked if the value is valid for it, else as it is."""
    category = match_category(header)
    secret = category.isin("id_card", "tax_id", "bank_account", "phone", "bank_name", "company", "party")
    return F.when(secret & value_valid(value, category), mask_value(value, category)).otherwise(value)


def mask_table(rows: Column, header: Column) -> Column:
    """All rows of a table by the meaning of its columns."""
    return F.transform(rows, lambda r: F.transform(r, lambda c, i: mask_cell(c, F.coalesce(F.get(header, i), F.lit("")))))


def mask_kv_row(row: Column) -> Column:
    """A row of label and value pairs: values at odd places by the label before them."""
    return F.transform(row, lambda c, i: F.when(i % 2 == 1, mask_cell(c, F.coalesce(F.get(row, i - 1), F.lit("")))).otherwise(c))


def fail_closed(rows: Column) -> Column:
    """Every cell blanked, for tables that couldn't be masked."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.lit(L.FAIL_CLOSED)))


def mask_stats(cells: DataFrame) -> DataFrame:
    """Cells, masked, skipped for their format, and columns by category, of each table (A14); cells: table_id, header, value."""
    category = match_category(F.col("header"))
    done = cells.select("table_id", "header", category.alias("category"), (mask_cell(F.col("value"), F.col("header")) != F.col("value")).alias("masked"), F.coalesce(value_valid(F.col("value"), category), F.lit(True)).alias("valid"))
    return done.groupBy("table_id").agg(
        F.count("*").alias("cells"),
        F.count_if("masked").alias("masked"),
        F.count_if(F.col("category").isNotNull() & ~F.col("valid")).alias("skipped_format"),
        F.array_sort(F.collect_set(F.when(F.col("category").isNotNull(), F.concat_ws("=", "header", "category")))).alias("columns"),
    )


def safe_columns(columns: Column) -> Column:
    """Column metadata (label -> category) without entries whose label could be a value."""
    from .scalar import is_label

    return F.map_filter(columns, lambda k, v: is_label(k) & ~F.coalesce(value_valid(k, v), F.lit(False)) & ~k.rlike(L.CODE))


def encrypt(value: Column, key: Column) -> Column:
    """Authenticated encryption of a field."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def decrypt(cipher: Column, key: Column, allowed: Column) -> Column:
    """The field in clear only where it is allowed."""
    return F.when(allowed, F.aes_decrypt(F.unbase64(cipher), key, F.lit("GCM")).cast("string"))


def legend(categories: dict[str, str] | None = None) -> str:
    """What the codes mean, for a prompt."""
    return "\n".join(f"{p}0001: {c}" for c, p in (categories or L.PREFIXES).items())


def config_tag(registrations: DataFrame) -> DataFrame:
    """A fingerprint of the masking configuration: hash of the latest change of each registry."""
    latest = registrations.groupBy("registry").agg(F.max("updated_at").cast("string").alias("at"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("registry", "at"))), lambda x: F.concat_ws("=", x["registry"], x["at"])), "|")
    return latest.agg(F.substring(F.sha2(parts, 256), 1, 32).alias("tag"))


def alias_windows(names: DataFrame, low: int = 2, high: int = 6, max_entities: int = 8) -> DataFrame:
    """(gram, entity): n-grams of registered names that at most max_entities of them share (M15, J20); names: entity, name."""
    bare = names.select("entity", F.regexp_replace("name", r"[\s\p{Z}]+", "").alias("name"))
    sized = bare.select("entity", "name", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n")).filter(F.length("name") >= F.col("n"))
    grams = sized.select("entity", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1), lambda i: F.substr("name", i, F.col("n")))).alias("gram")).distinct()
    rare = grams.groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") <= max_entities).select("gram")
    return grams.join(rare, "gram").select("gram", "entity")


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans (doc_key, start, end) as one."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("island", island).groupBy("doc_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two strings."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def outbound_plan(question: Column, names: dict[str, str]) -> Column:
    """Spans of registered names (value -> code) in a question, longest first, for confirmation before anything is sent."""
    hits = [F.when(question.contains(v), F.struct((F.instr(question, v) - 1).alias("start"), F.lit(len(v)).alias("length"), F.lit(c).alias("replacement"))) for v, c in sorted(names.items(), key=lambda x: -len(x[0]))]
    return F.filter(F.array(*hits), lambda s: s.isNotNull()) if hits else F.array()


def guard_payload(text: Column, names: dict[str, str]) -> Column:
    """The text with registered names as codes and long numbers masked."""
    out = reduce(lambda t, v: F.replace(t, F.lit(v), F.lit(names[v])), sorted(names, key=lambda v: (-len(v), v)), text)
    return F.regexp_replace(out, r"(?<![0-9A-Za-z])([0-9]{4})[0-9]{4,11}([0-9]{4})(?![0-9A-Za-z])", "$1****$2")


__all__ = ["discover", "apply_codes", "mask_cell", "mask_table", "mask_kv_row", "trim_space"]
