"""Table layout: rows that aren't data, key/value scores, header choice, page text with offsets, and span mapping.

Stripping leading rows looks at each row in the light of those left, so it runs as one Python function for each table in
Arrow batches; scores and offsets are native aggregates and windows.
"""

from __future__ import annotations

import difflib
import re
from statistics import mode

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import lexicon as L
from ..functions import scalar as S

Row = list[str]

LAYOUT = StructType([
    StructField("layout", StringType()),
    StructField("header", ArrayType(StringType())),
    StructField("body", ArrayType(ArrayType(StringType()))),
    StructField("title_rows", ArrayType(ArrayType(StringType()))),
    StructField("signature_rows", ArrayType(ArrayType(StringType()))),
])


# Single values in Python, for the functions below; the native forms are in functions.scalar.
def _core(s: str) -> str:
    return re.sub(r"[（(][^）)]*[）)]", "", s.strip().rstrip("：:=＝ ")).strip().rstrip("：:=＝ ")


def category_of(header: str) -> str | None:
    core = _core(header)
    if not core or core in L.AMBIGUOUS_HEADERS or header.strip().rstrip("：:=＝ ") in L.AMBIGUOUS_HEADERS:
        return None
    named = next((c for c, words in L.HEADER_RULES if any(w in core for w in words)), None)
    return named or ("company" if len(core) >= 3 and re.search(L.COMPANY_HEADER_TAIL, core) else None)


def _value_like(s: str, category: str) -> bool:
    if category == "company":
        suffix = "|".join(sorted(L.COMPANY_SUFFIXES, key=len, reverse=True))
        return not label_word(s) and re.fullmatch(rf"[一-龥A-Za-z0-9（）()·\-]{{2,40}}(?:{suffix})[一-龥A-Za-z0-9（）()·\-]{{0,20}}", s) is not None
    if category == "party":
        return not label_word(s) and re.fullmatch(L.PERSON[1:-1], s) is not None and s[0] in L.SURNAMES
    if category == "date":
        return re.search(L.DATE_FRAGMENT, s) is not None
    patterns = {"id_card": L.ID_CARD, "bank_account": L.ACCOUNT, "tax_id": L.TAX_ID, "phone": L.PHONE}
    return re.match(patterns[category], re.sub(r"[\s\-]", "", s)) is not None if category in patterns else "银行" in s or len(s) >= 4


def label_word(s: str) -> bool:
    s = s.strip().rstrip("：:=＝ ")
    return any(s.endswith(w) and len(s) <= len(w) + 2 for w in L.LABELS)


def label_cell(s: str) -> bool:
    s = s.strip()
    if not s or len(s) > 12 or re.search("[0-9]{3,}", s) or re.search(L.CODE, s):
        return False
    if not (not re.search("[，,。；;、]", s) if re.search(L.CJK, s) else re.match(r"^[A-Za-z][A-Za-z0-9 _/\-]{0,11}$", s)):
        return False
    category = category_of(s)
    return category is None or s.endswith(("：", ":", "＝", "=")) or not _value_like(s, category)


def semantic_label(s: str) -> bool:
    return category_of(s) is not None and label_cell(s)


def signature_row(row: Row) -> bool:
    cells = [c.strip() for c in row if c.strip()]
    if not cells or len(cells) > 4 or max(map(len, cells)) > 24:
        return False
    joined = " ".join(cells)
    if re.search(L.SIGNATURE_STRONG, joined):
        return True
    return bool(re.search(L.SIGNATURE_WEAK, joined)) and all((re.search(L.SIGNATURE_WEAK, c) and not re.search("[0-9]", c)) or re.match(L.DATE_VALUE, c) for c in cells)


def _filled(row: Row) -> int:
    return sum(1 for c in row if c.strip())


def strip_rows(rows: list[Row], width: int, merged: frozenset[int] = frozenset(), most: int = 3) -> tuple[list[Row], list[Row], list[Row]]:
    """Title rows, signature rows and data rows (Y1): leading rows are titles or signatures while the rules say so; signature rows go everywhere."""
    title, signature, start = [], [], 0
    for k, row in enumerate(rows[:most]):
        n, rest = _filled(row), sorted(map(_filled, rows[k + 1 :])) or [0]
        usual = rest[len(rest) // 2]
        text = " | ".join(c.strip() for c in row if c.strip())
        if n and signature_row(row):
            signature.append(row)
        elif (
            n == 0
            or (n <= 1 and width > 1)
            or (k in merged and width > 1 and not label_word(next(c for c in row if c.strip())))
            or (n <= 2 <= usual and 2 * n < usual)
            or (len(text) > 12 and not any(p in text for p in L.TITLE_PUNCTUATION) and category_of(text) is None and usual > n)
        ):
            title.append(row)
        else:
            break
        start = k + 1
    later = rows[start:]
    return title, signature + [r for r in later if signature_row(r)], [r for r in later if not signature_row(r)]


def kv_figures(rows: list[Row]) -> dict:
    """Key/value score and its parts (Y2)."""
    rows = [r for r in rows if _filled(r)]
    none = {"score": 0.0, "is_kv": False, "hit": 0, "hit_ratio": 0.0, "pair_row_ratio": 0.0, "label_col_ratio": 0.0, "pair_ratio": 0.0}
    if len(rows) < 2:
        return none
    hit = paired = pair_rows = 0
    first = []
    for k, row in enumerate(rows):
        cells, below = [c.strip() for c in row], [c.strip() for c in rows[k + 1]] if k + 1 < len(rows) else []
        left = next(i for i, c in enumerate(cells) if c)
        first.append(left)
        under = lambda i, below=below: below[i] if i < len(below) else ""
        values = [c for c in cells[left + 1 :] if c] + [under(left)]
        pair_rows += label_cell(cells[left]) and any(v and not semantic_label(v) for v in values)
        for i, c in enumerate(cells):
            if c and semantic_label(c):
                hit += 1
                right = next((x for x in cells[i + 1 :] if x), "")
                value = right if right and not semantic_label(right) else ("" if right and not under(i) else under(i) if not right else "")
                paired += bool(value) and not semantic_label(value)
    n = len(rows)
    parts = {"hit": hit / n, "pair_row": pair_rows / n, "label_col": first.count(mode(sorted(first))) / n, "pair": paired / max(hit, 1)}
    score = sum(w * parts[k] for k, w in L.KV_WEIGHTS.items())
    return {
        "score": round(score, 3),
        "is_kv": score >= 0.5 and hit >= 1 and parts["pair_row"] >= 0.5 and parts["label_col"] >= 0.5,
        "hit": hit,
        **{f"{k}_ratio": round(v, 3) for k, v in parts.items()},
    }


def note_block(rows: list[Row]) -> bool:
    rows = [r for r in rows if _filled(r)]
    cells = [c.strip() for r in rows for c in r if c.strip()]
    return bool(rows) and max(map(_filled, rows)) <= 2 and (sum(len(c) > 18 for c in cells) >= 2 or any(c.startswith(L.NOTE_HEADS) for c in cells))


def layout_of(rows: list[Row], width: int | None = None, merged: frozenset[int] = frozenset()) -> dict:
    """Layout, header, body, title and signature rows of a table."""
    rows = [["" if c is None else str(c) for c in (() if r is None else r)] for r in (() if rows is None else rows)]
    width = max(map(len, rows), default=0) if width is None else width
    title, signature, data = strip_rows(rows, width, merged)
    out = {"layout": "table", "header": [], "body": data, "title_rows": title, "signature_rows": signature}
    if not data:
        return out | {"layout": "signature" if signature else "table"}
    if kv_figures(data)["is_kv"]:
        return out | {"layout": "kv"}
    if note_block(data):
        return out | {"layout": "note"}
    widest = max(map(_filled, data))
    fits = (k for k in range(min(L.HEADER_SCAN, len(data) - 1)) if _filled(data[k]) == widest and all(not c.strip() or label_cell(c) or category_of(c) for c in data[k]))
    at = next(fits, 0)
    title, data = title + data[:at], data[at:]
    out |= {"title_rows": title, "body": data}
    if signature and len(data) <= 2:
        return out | {"layout": "signature"}
    if len(data) < 2 or (_filled(data[0]) <= 1 < max(map(_filled, data[1:]))):
        return out | {"layout": "noheader"}
    return out | {"header": [c.strip() for c in data[0]], "body": data[1:]}


@F.pandas_udf(LAYOUT)
def layout(rows: pd.Series) -> pd.DataFrame:
    """Layouts of tables given as array<array<string>>."""
    return pd.DataFrame([layout_of(r if r is not None else []) for r in rows], columns=LAYOUT.names)


def kv_scores(cells: DataFrame) -> DataFrame:
    """Native key/value score of tables in long form (Y2, A13): table_id, row, col, value, with empty cells left out or blank.

    A cell's right neighbour is the next filled cell of its row; the cell below is that of the next filled row.
    """
    some = cells.filter(S.trim_space(F.col("value")) != "").select("table_id", "row", "col", S.trim_space(F.col("value")).alias("v"))
    some = some.withColumn("r", F.dense_rank().over(Window.partitionBy("table_id").orderBy("row")))
    marked = some.withColumns({"label": S.is_label_cell(F.col("v")), "semantic": S.is_semantic_label(F.col("v"))})
    in_row = Window.partitionBy("table_id", "r").orderBy("col")
    later = in_row.rowsBetween(1, Window.unboundedFollowing)
    marked = marked.withColumns({
        "left": F.row_number().over(in_row) == 1,
        "right_semantic": F.lead("semantic").over(in_row),
        "value_right": F.coalesce(F.max(~F.col("semantic")).over(later), F.lit(False)),
    })
    below = marked.select("table_id", (F.col("r") - 1).alias("r"), "col", F.col("semantic").alias("below_semantic"))
    both = marked.join(below, ["table_id", "r", "col"], "left")
    value_below = ~F.coalesce("below_semantic", F.lit(True))
    both = both.withColumns({
        "pair_row": F.col("left") & F.col("label") & (F.col("value_right") | value_below),
        "paired": F.col("semantic") & F.coalesce(~F.col("right_semantic"), value_below),
    })
    lefts = both.filter("left").groupBy("table_id", "col").agg(F.count("*").alias("n"))
    modal = lefts.groupBy("table_id").agg(F.max("n").alias("modal"))
    figures = both.groupBy("table_id").agg(F.max("r").alias("n"), F.count_if("semantic").alias("hit"), F.count_if("pair_row").alias("pair_rows"), F.count_if("paired").alias("pairs"))
    out = figures.join(modal, "table_id").withColumns({
        "hit_ratio": F.col("hit") / F.col("n"),
        "pair_row_ratio": F.col("pair_rows") / F.col("n"),
        "label_col_ratio": F.col("modal") / F.col("n"),
        "pair_ratio": F.col("pairs") / F.greatest(F.col("hit"), F.lit(1)),
    })
    score = sum((F.lit(w) * F.col(f"{k}_ratio") for k, w in L.KV_WEIGHTS.items()), F.lit(0.0))
    score = F.when(F.col("n") >= 2, score).otherwise(0.0)
    kv = (score >= 0.5) & (F.col("hit") >= 1) & (F.col("pair_row_ratio") >= 0.5) & (F.col("label_col_ratio") >= 0.5)
    return out.select("table_id", F.round(score, 3).alias("score"), kv.alias("is_kv"), "hit", *[F.round(f"{k}_ratio", 3).alias(f"{k}_ratio") for k in L.KV_WEIGHTS])


def split_blank_runs(rows: DataFrame, run: int = 2) -> DataFrame:
    """Sheet rows (sheet, row, cells) with the number of their block: ``run`` or more blank rows end one (S7, W12). Blank rows go."""
    filled = rows.filter(F.exists("cells", lambda c: F.coalesce(S.trim_space(c) != "", F.lit(False))))
    order = Window.partitionBy("sheet").orderBy("row")
    gap = F.col("row") - F.lag("row").over(order)
    starts = filled.withColumn("starts", (gap.isNull() | (gap > run)).cast("int"))
    return starts.withColumn("block", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def page_offsets(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_key, page, seq, text) with their character range in the page text, blocks joined by newlines."""
    before = Window.partitionBy("doc_key", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return blocks.withColumn("char_start", start.cast("int")).withColumn("char_end", (F.col("char_start") + F.length("text")).cast("int"))


def page_text(blocks: DataFrame) -> DataFrame:
    """The page text itself: doc_key, page, text."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return blocks.groupBy("doc_key", "page").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def offset_map(raw: pd.Series, final: pd.Series) -> pd.Series:
    """Equal blocks of two texts: [start in final, start in raw, length]."""
    blocks = lambda a, b: [[m.b, m.a, m.size] for m in difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_matching_blocks() if m.size]
    return pd.Series([blocks(a, b) for a, b in zip(raw, final, strict=True)])


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def page_anchors(page: pd.Series, cells: pd.Series) -> pd.Series:
    """Start and end of each cell in the page text, searched onwards from the one before; null if it isn't there."""

    def find(text, parts):
        at, out = 0, []
        for p in parts if parts is not None else ():
            k = (text or "").find(p, at) if p else -1
            out.append([k, k + len(p)] if k >= 0 else None)
            at = k + len(p) if k >= 0 else at
        return out

    return pd.Series([find(t, c) for t, c in zip(page, cells, strict=True)])


def map_spans(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans (doc_key, start, end) of the final text in the raw text, by segments (doc_key, final, raw, length).

    exact if one segment holds the span; otherwise the range from the nearest segment's end at or before it to the next one's
    start after it, with exact false; covered: characters of the span inside segments.
    """
    s, g = spans.alias("s"), segments.alias("g")
    same = F.col("s.doc_key") == F.col("g.doc_key")
    pairs = s.join(g, same, "left")
    g_end = F.col("g.final") + F.col("g.length")
    inside = (F.col("s.start") >= F.col("g.final")) & (F.col("s.end") <= g_end)
    shift = F.col("g.raw") - F.col("g.final")
    covered = F.greatest(F.lit(0), F.least(F.col("s.end"), g_end) - F.greatest(F.col("s.start"), F.col("g.final")))
    point = lambda p: (p >= F.col("g.final")) & (p <= g_end)
    per = pairs.groupBy("s.doc_key", "s.start", "s.end").agg(
        F.min(F.when(inside, F.col("s.start") + shift)).alias("e0"),
        F.min(F.when(inside, F.col("s.end") + shift)).alias("e1"),
        F.max(F.when(point(F.col("s.start")), F.col("s.start") + shift)).alias("p0"),
        F.min(F.when(point(F.col("s.end")), F.col("s.end") + shift)).alias("p1"),
        F.max(F.when(g_end <= F.col("s.start"), F.col("g.raw") + F.col("g.length"))).alias("l0"),
        F.min(F.when(F.col("g.final") >= F.col("s.end"), F.col("g.raw"))).alias("l1"),
        F.sum(covered).alias("covered"),
    )
    return per.select(
        "doc_key", "start", "end",
        F.coalesce("e0", "p0", "l0").alias("raw_start"),
        F.coalesce("e1", "p1", "l1").alias("raw_end"),
        F.col("e0").isNotNull().alias("exact"),
        F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
    )


def pipe_table(content: Column) -> Column:
    """Rows of a pipe-drawn table, separator rows dropped."""
    lines = F.filter(F.split(content, "\n"), lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2) & ~x.rlike(r"^[\s|:\-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(S.trim_space(x), r"^\||\|$", ""), r"\|"), S.trim_space))


def plain_table(content: Column) -> Column:
    """One row of one cell for each line with text."""
    return F.transform(F.filter(F.split(content, "\n"), lambda x: S.trim_space(x) != ""), lambda x: F.array(S.trim_space(x)))
