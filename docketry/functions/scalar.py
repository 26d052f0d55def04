"""Column expressions: normalising, hashing, classifying and validating single values. All are built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

_SPACE = r"[\s\p{Z}]+"


def let(value: Column, f) -> Column:
    """f(value) with value worked out once, outside generated code."""
    return F.transform(F.array(value), f)[0]


def strip_space(c: Column) -> Column:
    """Without any white space, ideographic space included."""
    return F.regexp_replace(c, _SPACE, "")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}|{_SPACE}$", "")


def number(c: Column) -> Column:
    """The number in noisy text, or null."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def date_parts(c: Column) -> dict[str, Column]:
    """year, month and day spellings of the first date like 2026-9-1 or 2026年9月1日."""
    at = r"([0-9]{4})[-/年]([0-9]{1,2})(?:[-/月]([0-9]{1,2}))?"
    y, m, d = (F.regexp_extract(c, at, k) for k in (1, 2, 3))
    ym = F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))
    return {
        "year": F.when(y != "", y),
        "month": F.when(m != "", ym),
        "day": F.when(d != "", F.concat(ym, F.lit("-"), F.lpad(d, 2, "0"))),
    }


def feature_hash(code: Column, value: Column) -> Column:
    """First 16 hex digits of sha256 of 'code:value' with white space removed."""
    return F.substring(F.sha2(F.concat(code, F.lit(":"), strip_space(value)), 256), 1, 16)


def subitem_hash(parent: Column, sub: Column) -> Column:
    return F.substring(F.sha2(F.concat(parent, F.lit(":"), sub), 256), 1, 16)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def text_hash(text: Column) -> Column:
    """sha256 of the text without white space."""
    return F.sha2(strip_space(text), 256)


def head_tail_hash(content: Column, size: int = L.HEAD_TAIL_BYTES) -> Column:
    """sha256 of the length, the first and (if longer) the last bytes of a binary."""
    n = F.octet_length(content)
    tail = F.when(n > size, F.substr(content, n - size + 1, F.lit(size))).otherwise(F.lit(b""))
    return F.sha2(F.concat(n.cast("string").cast("binary"), F.substr(content, F.lit(1), F.lit(size)), tail), 256)


def contract_code(name: Column) -> Column:
    """The longest run of ASCII words joined by hyphens that has a digit, in capitals; the first of the longest."""
    runs = F.filter(F.regexp_extract_all(name, F.lit(r"([A-Za-z0-9]+(?:-[A-Za-z0-9]+)+)"), F.lit(1)), lambda x: x.rlike("[0-9]"))
    best = F.array_max(F.transform(runs, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return F.upper(best["x"])


def split_copy_marker(name: Column) -> tuple[Column, Column]:
    """Base name and copy marker of a file name such as 'x（2）.docx' (P16)."""
    stem = F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")
    marker = F.regexp_extract(stem, L.COPY_MARKER, 0)
    base = F.rtrim(F.substr(stem, F.lit(1), F.length(stem) - F.length(marker)))
    base = F.regexp_replace(base, r"[ \-_]+$", "")
    real = (marker != "") & (base != "")
    return F.when(real, base).otherwise(stem), F.when(real, marker).otherwise("")


def coerce(c: Column, kind: str) -> Column:
    """User text as a column type; booleans by their usual words."""
    if kind == "boolean":
        s = F.lower(F.trim(c))
        return F.when(s.isin("是", "已", "√", "true", "t", "1", "yes", "y"), True).when(s.isin("否", "未", "×", "false", "f", "0", "no", "n"), False)
    if kind in ("int", "long", "double") or kind.startswith("decimal"):
        return F.regexp_replace(F.trim(c), ",", "").try_cast(kind)
    return F.trim(c).try_cast(kind)


def clip(c: Column, limit: int) -> Column:
    """At most limit characters, cut after the last sentence end if that leaves 60 % of them."""
    s = F.replace(F.trim(c), F.lit("\n"), F.lit(" "))
    head = F.substring(s, 1, limit)
    ended = F.regexp_extract(head, f"(?s)^.*[{L.SENTENCE_END}]", 0)
    return F.when(F.length(s) <= limit, s).when(F.length(ended) >= limit * 0.6, F.rtrim(ended)).otherwise(F.rtrim(head))


def excel_date(c: Column, header: Column) -> Column:
    """Excel serial numbers 20000 to 60000 as ISO dates, in date columns only."""
    n = F.when(c.rlike("^[0-9]{5}$"), c.try_cast("int"))
    iso = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), n), "yyyy-MM-dd")
    return F.when(header.contains("日期") & n.between(20000, 60000), iso).otherwise(c)


def any_contains(c: Column, words) -> Column:
    """One pattern rather than a condition for each word, to keep generated code small."""
    return c.rlike("|".join(map(re.escape, words)))


def any_start(c: Column, words) -> Column:
    return c.rlike("^(" + "|".join(map(re.escape, words)) + ")")


def header_core(header: Column) -> Column:
    """A header without trailing label marks and bracketed parts."""
    marks = r"[：:=＝ ]+$"
    plain = F.regexp_replace(trim_space(header), marks, "")
    return F.regexp_replace(trim_space(F.regexp_replace(plain, r"[（(][^）)]*[）)]", "")), marks, "")


def match_category(header: Column) -> Column:
    """The category that a header names, or null; words that could mean anything are never guessed (P25)."""

    def of_core(core):
        out = F.when((core == "") | core.isin(*L.AMBIGUOUS_HEADERS), F.lit(None).cast("string"))
        for category, words in L.HEADER_RULES:
            out = out.when(any_contains(core, words), category)
        return out.when((F.length(core) >= 3) & core.rlike(L.COMPANY_HEADER_TAIL), "company")

    return let(header_core(header), of_core)


def value_valid(value: Column, category: Column) -> Column:
    """Does the value have its category's format (P26)?"""

    def of(s):
        bare = F.regexp_replace(s, r"[\s\-]", "")
        limit = F.lit(1 << 30)
        for name, n in L.MAX_VALUE_LENGTH.items():
            limit = F.when(category == name, n).otherwise(limit)
        by = (
            F.when(category.isin("id_card", "bank_card"), s.rlike(L.ID_CARD))
            .when(category == "bank_account", bare.rlike(L.ACCOUNT))
            .when(category == "tax_id", F.replace(s, F.lit(" "), F.lit("")).rlike(L.TAX_ID))
            .when(category == "date", s.rlike(L.DATE))
            .when(category == "bank_name", s.rlike(L.CJK) & (s.contains("银行") | (F.length(s) >= 4)))
            .when(category == "phone", F.regexp_replace(s, "[^0-9]", "").rlike(L.PHONE))
            .otherwise(~s.rlike(L.DATE) & ~bare.rlike("^[0-9]{12,}$") & s.rlike(L.CJK))
        )
        return (s != "") & (F.length(s) <= limit) & by

    return let(trim_space(F.coalesce(value, F.lit(""))), of)


def looks_like_label_word(value: Column) -> Column:
    """Is the value a field name from the list, or one with at most two characters before it (P27)?"""
    s = F.regexp_replace(trim_space(value), r"[：:=＝ ]+$", "")
    return s.rlike("^.{0,2}(" + "|".join(L.LABELS) + ")$")


def noise_reason(value: Column) -> Column:
    """Why a value can't be a company or a person, or null."""
    s = trim_space(F.coalesce(value, F.lit("")))
    return (
        F.when(s == "", "empty")
        .when(s.isin(*L.UNITS), "unit")
        .when(s.rlike(L.MONEY), "amount")
        .when(s.rlike(L.DATE_FRAGMENT), "date fragment")
        .when(any_contains(s, L.NOISE), "punctuation")
        .when(any_start(s, L.NOISE_HEADS), "remark")
        .when(F.length(s) <= 1, "single character")
    )


def value_acceptable(category: Column, value: Column) -> Column:
    """Why a value must not be registered under its category; null if it may."""
    suffix = "|".join(sorted(L.COMPANY_SUFFIXES, key=len, reverse=True))
    named = category.isin("company", "party")

    def of(s):
        core = trim_space(F.regexp_replace(s, r"[（(].*?[)）]", ""))
        return (
            F.when(named & noise_reason(s).isNotNull(), noise_reason(s))
            .when(named & looks_like_label_word(s), "label")
            .when((category == "company") & ~s.rlike(rf"^[一-龥A-Za-z0-9（）()·\-]{{2,40}}({suffix})[一-龥A-Za-z0-9（）()·\-]{{0,20}}$"), "no company suffix")
            .when((category == "party") & ~core.rlike(L.PERSON), "not a name")
            .when((category == "party") & ~core.rlike(f"^[{L.SURNAMES}]"), "no surname")
            .when((category == "date") & ~s.rlike(L.DATE_FRAGMENT), "not a date")
        )

    return let(trim_space(F.coalesce(value, F.lit(""))), of)


def is_label(value: Column) -> Column:
    """Short, without long numbers, codes or sentence marks."""

    def of(s):
        mark = F.when(s.rlike(L.CJK), ~s.rlike("[，,。；;、]")).otherwise(s.rlike(r"^[A-Za-z][A-Za-z0-9 _/\-]{0,11}$"))
        return (s != "") & (F.length(s) <= 12) & ~s.rlike("[0-9]{3,}") & ~s.rlike(L.CODE) & mark

    return let(trim_space(F.coalesce(value, F.lit(""))), of)


def is_label_cell(value: Column) -> Column:
    """Is a cell a field name rather than a value of the category that it names (P28)?"""

    def of(x):
        s, category = x["s"], x["category"]
        like = F.when(category.isin("company", "party", "date"), value_acceptable(category, s).isNull()).otherwise(value_valid(s, category))
        return is_label(s) & (category.isNull() | s.rlike("[：:＝=]$") | ~F.coalesce(like, F.lit(False)))

    s = trim_space(F.coalesce(value, F.lit("")))
    return let(F.struct(s.alias("s"), match_category(s).alias("category")), of)


def is_semantic_label(value: Column) -> Column:
    return match_category(value).isNotNull() & is_label_cell(value)


def bank_name_plausible(value: Column) -> Column:
    """Does the value name a bank rather than repeat a label (P29)?"""
    s = trim_space(value)
    label = s.rlike("^.?(" + "|".join(L.BANK_LABEL_TAILS) + ")$")
    return (F.length(s) >= 2) & ~label & (any_contains(s, L.BANKS) | s.rlike(L.BANK_TAIL))


def already_masked(value: Column) -> Column:
    """Does the value hold a code of any category (P30)?"""
    every = "|".join(sorted(set(L.PREFIXES.values())))
    plain = "|".join(sorted(p for c, p in L.PREFIXES.items() if c not in L.SECRET))
    return value.rlike(rf"\[(本公司·)?({every})[0-9]{{2,}}\]|(?<![A-Za-z])({plain})[0-9]{{4,}}(?![0-9])")


def is_signature_row(row: Column) -> Column:
    """Signature rows: strong words, or only date labels and dates."""
    cells = F.filter(F.transform(row, lambda c: trim_space(F.coalesce(c, F.lit("")))), lambda c: c != "")
    weak = lambda c: (c.rlike(L.SIGNATURE_WEAK) & ~c.rlike("[0-9]")) | c.rlike(L.DATE_VALUE)
    joined = F.array_join(cells, " ")
    shape = (F.size(cells) > 0) & (F.size(cells) <= 4) & F.forall(cells, lambda c: F.length(c) <= 24)
    return shape & (joined.rlike(L.SIGNATURE_STRONG) | (joined.rlike(L.SIGNATURE_WEAK) & F.forall(cells, weak)))


def is_note_block(rows: Column) -> Column:
    """Notes: rows of at most two cells with long or starred text."""
    cells = F.transform(rows, lambda r: F.filter(F.transform(r, lambda c: trim_space(F.coalesce(c, F.lit("")))), lambda c: c != ""))
    some = F.filter(cells, lambda r: F.size(r) > 0)
    flat = F.flatten(some)
    stars = F.size(F.filter(flat, lambda c: any_start(c, L.NOTE_HEADS)))
    long_ = F.size(F.filter(flat, lambda c: F.length(c) > 18))
    return (F.size(some) > 0) & F.forall(some, lambda r: F.size(r) <= 2) & ((long_ >= 2) | (stars >= 1))


def redact_secrets(c: Column) -> Column:
    """Bearer tokens and key-like strings blanked."""
    c = F.regexp_replace(c, r"(?i)(bearer\s+)[A-Za-z0-9._\-]{8,}", "$1***")
    c = F.regexp_replace(c, r"\bsk-[A-Za-z0-9_\-]{8,}", "sk-***")
    return F.regexp_replace(c, r"(?i)((?:api[_-]?key|password|secret)\s*[=:]\s*)[^\s,;\"']+", "$1***")


def clean_reply(c: Column) -> Column:
    """Model text without byte order marks and zero-width characters."""
    return F.trim(F.translate(c, "﻿​‌‍⁠", ""))


def json_object(c: Column, schema: str) -> Column:
    """The outermost JSON object in a reply, parsed leniently."""
    return F.from_json(F.regexp_extract(clean_reply(c), r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})


def node_doc(node: Column) -> Column:
    """The document of a doc, table or row node."""
    return F.nullif(F.regexp_extract(node, r"^(?:doc|row|table):([^#]*)", 1), F.lit(""))


def project_norm(c: Column) -> Column:
    """A project name without codes, white space and wrapping marks."""
    c = F.regexp_replace(c, L.CODE, "")
    c = strip_space(F.translate(c, "（）【】《》［］", "()[]<>[]"))
    marks = "[\"'“”‘’()\\[\\]<>:：,，.。;；、\\-—_/\\\\|]+"
    return F.regexp_replace(c, f"^{marks}|{marks}$", "")


def project_core(c: Column) -> Column:
    """The norm without trailing kinds of project, taken off in rounds while more than one character stays."""

    def without(word):
        return lambda x: F.when(x.endswith(word) & (F.length(x) > len(word) + 1), F.substring(x, F.lit(1), F.length(x) - len(word))).otherwise(x)

    def one_round(s):
        for word in L.CORE_SUFFIXES:
            s = let(s, without(word))
        return s

    def of(s):
        shortest = min(map(len, L.CORE_SUFFIXES))
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(s) / shortest).cast("int")))
        return F.aggregate(rounds, s, lambda x, _: one_round(x))

    return let(project_norm(c), of)


def project_fingerprint(c: Column) -> Column:
    return F.sha2(project_norm(c), 256)


def invoice_fields(text: Column) -> Column:
    """A struct of the invoice fields, each by its first pattern that has a value."""
    fields = []
    for name, patterns in L.INVOICE_PATTERNS.items():
        found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])
        if name in ("amount", "tax", "total"):
            found = F.replace(found, F.lit(","), F.lit("")).try_cast("double")
        if name == "invoice_date":
            cn = [F.regexp_extract(text, r"([0-9]{4})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})", k) for k in (1, 2, 3)]
            found = F.coalesce(found, F.when(cn[0] != "", F.concat_ws("-", cn[0], F.lpad(cn[1], 2, "0"), F.lpad(cn[2], 2, "0"))))
        fields.append(found.alias(name))
    return F.struct(*fields)


def is_text_page(text: Column) -> Column:
    """A page with at least 20 characters other than white space needs no recognition."""
    return F.length(strip_space(F.coalesce(text, F.lit("")))) >= 20


def _title_lines(pages: Column) -> Column:
    """Title blocks of the first three pages, then the first six plain lines of the first two."""
    lines = lambda n: F.flatten(F.transform(F.slice(pages, 1, n), lambda p: F.split(F.coalesce(p, F.lit("")), "\n")))
    block = lambda x: any_start(x, L.TITLE_PREFIXES)
    plain = lambda x: (trim_space(x) != "") & ~x.rlike(r"^[\s　]*(table:|row:)") & ~block(trim_space(x)) & ~x.rlike(L.TITLE_LABEL) & ~x.rlike(L.EMPTY_LABEL)
    return F.concat(F.filter(lines(3), block), F.slice(F.filter(lines(2), plain), 1, 6))


def is_contract(name: Column, pages: Column) -> Column:
    """PDF or Word whose file name, or a title line's end, says contract."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^.]*)$", 1))

    def hit(x):
        block = any_start(x, L.TITLE_PREFIXES)
        core = F.regexp_replace(trim_space(F.when(block, F.regexp_replace(x, "^[a-z_]+:", "")).otherwise(x)), "[：: 　]+$", "")
        return core.rlike("(" + "|".join(L.CONTRACT_TOKENS) + ")书?$")

    return ext.isin(*L.CONTRACT_EXTENSIONS) & (any_contains(name, L.CONTRACT_TOKENS) | F.exists(_title_lines(pages), hit))


def classify_document(name: Column, pages: Column) -> Column:
    """Category of a document: contract rule, then keywords of name, title blocks and whole text (P20)."""
    name, pages = F.coalesce(name, F.lit("")), F.coalesce(pages, F.array().cast("array<string>"))
    full = F.array_join(pages, "\n")
    ends = F.concat(F.substring(F.coalesce(F.get(pages, F.lit(0)), F.lit("")), 1, 300), F.right(F.coalesce(F.element_at(pages, F.when(F.size(pages) > 0, -1)), F.lit("")), F.lit(300)))
    titles = F.array_join(F.filter(F.split(full, "\n"), lambda x: x.startswith("header:") | x.startswith("doc_title:") | x.startswith("title:")), "\n")
    times = lambda c, w: (F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / len(w)
    out = F.when(F.size(pages) == 0, L.OTHER).when(is_contract(name, pages), "合同")
    for where in (name, titles):
        for category, words in L.CATEGORY_KEYWORDS.items():
            out = out.when(any_contains(where, words), category)
    score = {c: sum((3 * times(ends, w) + times(full, w) for w in ws), F.lit(0.0)) for c, ws in L.CATEGORY_KEYWORDS.items()}
    best = F.greatest(*score.values())
    for category, s in score.items():
        out = out.when((best > 0) & (s == best), category)
    return out.otherwise(L.OTHER)


def kind_of(category: Column, passed: Column) -> Column:
    """Inbox kind of a document."""
    return F.when(F.coalesce(passed, F.lit(False)) | (category == "合同"), "contract").when(category == "发票", "invoice").otherwise("other")


def mask_value(value: Column, category: Column) -> Column:
    """The masked form of a valid value (M5)."""
    s = trim_space(value)
    digits = F.regexp_replace(s, "[^0-9Xx]", "")
    keep = lambda c, a, b: F.concat(F.substring(c, 1, a), F.repeat(F.lit("*"), F.greatest(F.lit(4), F.length(c) - a - b)), F.right(c, F.lit(b)))
    n = F.length(s)
    name = (
        F.when(n <= 2, F.concat(F.substring(s, 1, 1), F.lit("*")))
        .when(n <= 4, F.concat(F.substring(s, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(s, F.lit(1))))
        .otherwise(F.concat(F.substring(s, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(s, F.lit(2))))
    )
    return (
        F.when(category == "id_card", F.concat(F.substring(digits, 1, 6), F.lit("******"), F.right(digits, F.lit(4))))
        .when(category == "bank_card", keep(F.regexp_replace(s, "[^0-9]", ""), 6, 4))
        .when(category.isin("tax_id", "bank_account"), keep(F.regexp_replace(s, r"[\s\-]", ""), 4, 4))
        .when(category == "phone", F.concat(F.substring(s, 1, 3), F.lit("****"), F.right(s, F.lit(4))))
        .otherwise(name)
    )


def codes_in(text: Column) -> Column:
    """Distinct codes in a text, bare, in order of code."""
    found = F.regexp_extract_all(text, F.lit(f"({L.CODE})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[\[\]]|本公司·", ""))))


def jsonable(df):
    """df with decimals as doubles and times as ISO seconds, as JSON wants them."""
    as_text = lambda c, kind: F.col(c).cast("double") if kind.startswith("decimal") else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else F.date_format(c, "yyyy-MM-dd") if kind == "date" else F.col(c)
    return df.select(*[as_text(c, kind).alias(c) for c, kind in df.dtypes])


def contract_fields(name: Column, text: Column) -> Column:
    """Contract number from the file name, or a mark with the name, and what the masked text calls party A, or null."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    party = F.trim(F.regexp_extract(text, L.PARTY_A, 1))
    return F.struct(F.coalesce(contract_code(stem), F.concat(F.lit("无编号-"), stem)).alias("contract_code"), F.nullif(party, F.lit("")).alias("party_a"))


def ledger_row(ai_json: Column, known: str = "contract_code string, contract_term string, party_a string, amount string, sign_date string") -> Column:
    """A model's reply about a ledger item: known fields normalised, the key checked, all others kept as extra."""
    raw = F.regexp_extract(clean_reply(ai_json), r"(?s)\{.*\}", 0)
    named, all_ = F.from_json(raw, known), F.from_json(raw, "map<string,string>")
    names = [f.strip().split(" ")[0] for f in known.split(",")]
    return F.struct(
        F.upper(F.nullif(F.trim(named["contract_code"]), F.lit(""))).alias("contract_code"),
        named["contract_term"].alias("contract_term"),
        F.nullif(F.trim(named["party_a"]), F.lit("")).alias("party_a"),
        number(named["amount"]).alias("amount"),
        date_parts(named["sign_date"])["day"].alias("sign_date"),
        F.map_filter(F.coalesce(all_, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*names)).alias("extra"),
    )
