"""Facts, segments and chunks of documents.

Explodes, prefix sums and pattern captures are native. Greedy packing (segments, chunks) and the key/value walk are
sequential within one document or table, so they are Arrow-batched functions that yield arrays for a native explode.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import lexicon as L
from ..functions import scalar as S
from .layout import semantic_label

FACT = ["fact_id", "doc_key", "fact_kind", "page_no", "table_index", "row_index", "col_index", "header", "semantic", "value", "value_norm", "value_is_code", "char_start", "char_end"]


def _finish(facts: DataFrame) -> DataFrame:
    """Facts with their ids, semantics and normal forms."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fact_id = (
        F.when(F.col("fact_kind") == "cell", F.concat("doc_key", F.lit("|cell|p"), text("page_no"), F.lit("|t"), text("table_index"), F.lit("|r"), text("row_index"), F.lit("|c"), text("col_index")))
        .when(F.col("fact_kind") == "kv", F.concat("doc_key", F.lit("|kv|p"), text("page_no"), F.lit("|s"), text("char_start")))
        .otherwise(F.concat("doc_key", F.lit("|"), "fact_kind", F.lit("|p"), text("page_no"), F.lit("|t"), text("table_index"), F.lit("|r"), text("row_index")))
    )
    return facts.withColumns({
        "fact_id": fact_id,
        "semantic": S.match_category(F.coalesce("header", F.lit(""))),
        "value_norm": F.substring(S.strip_space(F.col("value")), 1, 120),
        "value_is_code": F.col("value").rlike(L.CODE),
        "header": F.substring("header", 1, 120),
    }).select(*FACT)


def cell_facts(tables: DataFrame) -> DataFrame:
    """Facts of plain tables: doc_key, page_no, table_index, header, rows (F1). A header of at most one word over wider rows isn't trusted."""
    filled = lambda r: F.size(F.filter(r, lambda c: S.trim_space(F.coalesce(c, F.lit(""))) != ""))
    trusted = ~((filled(F.col("header")) <= 1) & (F.coalesce(F.array_max(F.transform("rows", filled)), F.lit(0)) > 1))
    rows = tables.withColumn("trusted", trusted).select("doc_key", "page_no", "table_index", "header", "trusted", F.posexplode("rows").alias("r", "row"))
    cells = rows.select("doc_key", "page_no", "table_index", (F.col("r") + 1).alias("row_index"), "header", "trusted", F.posexplode("row").alias("col_index", "value"))
    named = F.when(F.col("trusted"), F.coalesce(F.get("header", F.col("col_index")), F.lit(""))).otherwise("")
    cells = cells.withColumn("header", named).filter(S.trim_space(F.coalesce("value", F.lit(""))) != "").filter((F.col("header") != "") | ~S.is_label_cell(F.col("value")))
    none = F.lit(None).cast("int")
    heads = tables.select("doc_key", "page_no", "table_index", F.lit(0).alias("row_index"), F.posexplode("header").alias("col_index", "value"))
    heads = heads.filter(S.trim_space(F.coalesce("value", F.lit(""))) != "").withColumn("header", F.col("value"))
    both = cells.drop("trusted").unionByName(heads)
    return _finish(both.withColumns({"fact_kind": F.lit("cell"), "char_start": none, "char_end": none}))


def title_facts(tables: DataFrame) -> DataFrame:
    """Title and signature rows, one fact each (F3): doc_key, page_no, table_index, title_rows, signature_rows."""
    out = None
    for kind in ("title", "signature"):
        row = F.array_join(F.filter(F.transform("row", lambda c: S.trim_space(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | ")
        part = tables.select("doc_key", "page_no", "table_index", F.posexplode(f"{kind}_rows").alias("r", "row")).select(
            "doc_key", "page_no", "table_index", (F.col("r") + 1).alias("row_index"), F.lit(kind).alias("fact_kind"), row.alias("value")
        )
        out = part if out is None else out.unionByName(part)
    none = F.lit(None).cast("int")
    return _finish(out.filter("value != ''").withColumns({"col_index": none, "header": F.lit(None).cast("string"), "char_start": none, "char_end": none}))


_PAIR = StructType([StructField("row_index", IntegerType()), StructField("col_index", IntegerType()), StructField("header", StringType()), StructField("value", StringType())])


def kv_pairs(rows: list[list[str]]) -> list[tuple[int, int, str, str]]:
    """(row, column, label, value) of a key/value table (F2): the next filled cell of the row, else the cell below."""
    rows = [["" if c is None else str(c) for c in (() if r is None else r)] for r in (() if rows is None else rows)]
    out: dict[tuple[int, int], tuple[int, int, str, str]] = {}
    for r, cells in enumerate(rows, 1):
        spent: set[int] = set()
        for i, cell in enumerate(cells):
            label = cell.strip()
            bare = label.rstrip("：:=＝ ")
            if not label or i in spent or not bare or len(bare) > 24 or re.search(L.CODE, bare) or (len(bare) > 12 and re.search("[0-9]", bare)):
                continue
            at = next(((r, j) for j in range(i + 1, len(cells)) if cells[j].strip()), None)
            if at:
                spent.add(at[1])
            elif r < len(rows) and i < len(rows[r]) and rows[r][i].strip():
                at = (r + 1, i)
            if at is None:
                continue
            value = rows[at[0] - 1][at[1]]
            if not semantic_label(value) and value.strip() != label:
                out[at] = (at[0], at[1], label, value)  # the last label wins a cell
    return list(out.values())


@F.pandas_udf(ArrayType(_PAIR))
def kv_table(rows: pd.Series) -> pd.Series:
    return rows.map(lambda r: [dict(zip(_PAIR.names, p, strict=True)) for p in kv_pairs(r)])


def kv_table_facts(tables: DataFrame) -> DataFrame:
    """Facts of key/value tables (F2): doc_key, page_no, table_index, rows."""
    pairs = tables.select("doc_key", "page_no", "table_index", F.explode(kv_table("rows")).alias("p")).select("doc_key", "page_no", "table_index", "p.*")
    none = F.lit(None).cast("int")
    return _finish(pairs.withColumns({"fact_kind": F.lit("cell"), "char_start": none, "char_end": none}))


def label_ok(label: Column) -> Column:
    s = F.regexp_replace(S.trim_space(label), "[：:=＝ ]+$", "")
    return (s != "") & (F.length(s) <= 24) & ~s.rlike(L.CODE) & ~(s.rlike("[0-9]") & (F.length(s) > L.KV_MAX_LABEL))


def lines_of(pages: DataFrame) -> DataFrame:
    """Lines of pages (doc_key, page_no, text) with their start in the page."""
    lines = pages.select("doc_key", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_key", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def line_facts(pages: DataFrame) -> DataFrame:
    """'label: value' lines as facts with the value's range in the page."""
    at = lines_of(pages)
    prefix = F.regexp_extract("line", L.BLOCK_PREFIX, 0)
    body = F.substr("line", F.length(prefix) + 1)
    label, value = (S.trim_space(F.regexp_extract(body, L.KV_LINE, k)) for k in (1, 2))
    mark = F.regexp_extract(body, r"^(\s*[^：:\n]{1,12}[：:]\s*)", 1)
    found = at.withColumns({"label": label, "value": value, "char_start": F.col("start") + F.length(prefix) + F.length(mark)})
    found = found.filter((F.col("value") != "") & label_ok(F.col("label")) & (F.length("value") <= L.KV_MAX_VALUE))
    none = F.lit(None).cast("int")
    return _finish(found.select(
        "doc_key", "page_no", none.alias("table_index"), none.alias("row_index"), none.alias("col_index"), F.lit("kv").alias("fact_kind"),
        F.col("label").alias("header"), "value", F.col("char_start").cast("int"), (F.col("char_start") + F.length("value")).cast("int").alias("char_end"),
    ))


def list_facts(facts: DataFrame, semantic: str | None = None) -> DataFrame:
    """Facts in page order, those without a place last."""
    if semantic is not None:
        facts = facts.filter(F.col("semantic") == semantic)
    return facts.orderBy(*[F.asc_nulls_last(c) for c in ("page_no", "table_index", "row_index", "col_index")], "fact_id")


def replace_facts(old: DataFrame, new: DataFrame, key: str = "doc_key") -> DataFrame:
    """old without the documents of new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the features (doc_key, seq) that new has, and new (K8)."""
    return old.join(new.select("doc_key", "seq").distinct(), ["doc_key", "seq"], "left_anti").unionByName(new)


def known_features(features: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Features whose code the catalogue has."""
    return features.join(catalogue.select("code").distinct(), "code", "left_semi")


_SEGMENT = StructType([StructField("text", StringType()), *[StructField(c, IntegerType()) for c in ("page_from", "page_to", "char_start", "char_end")]])


def packed(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs [i, j) of neighbours with sizes of at most ``most`` in all, each as long as can be; a larger one is a run of its own."""
    ends, runs, i = list(itertools.accumulate(sizes, initial=0)), [], 0
    while i < len(sizes):
        runs.append((i, max(i + 1, bisect_right(ends, ends[i] + most) - 1)))
        i = runs[-1][1]
    return runs


def after_sentences(line: str, most: int) -> list[str]:
    """A line in pieces of about ``most`` characters, cut after the last sentence that ends in them, else at ``most``."""
    stops, cuts = [m.end() for m in re.finditer(f"[{L.SENTENCE_END}]", line)], [0]
    while len(line) - cuts[-1] > most:
        k = bisect_right(stops, cuts[-1] + most + 1)
        cuts.append(stops[k - 1] if k and stops[k - 1] > cuts[-1] else cuts[-1] + most)
    return [line[x:y] for x, y in itertools.pairwise([*cuts, len(line)]) if y > x]


def segment_pages(pages: list[str], most: int = L.SEGMENT_MAX) -> list[dict]:
    """Lines packed up to ``most`` characters, longer ones cut after a sentence, with page and character ranges.

    Every piece is placed by the end of its line in the page, line break included.
    """
    pieces = []  # (page, end of the line, text)
    for number, page in enumerate(pages, 1):
        lines = (page or "").split("\n")
        for line, end in zip(lines, itertools.accumulate(len(x) + 1 for x in lines), strict=True):
            pieces += [(number, end, x) for x in after_sentences(line.rstrip(), most) if line.strip()]
    out = []
    for i, j in packed([len(x) + 1 for _, _, x in pieces], most):
        (first, end, head), (last, reached, _) = pieces[i], pieces[j - 1]
        out.append({"text": "\n".join(x for _, _, x in pieces[i:j]), "page_from": first, "page_to": last, "char_start": max(end - len(head), 0), "char_end": reached})
    return out


@F.pandas_udf(ArrayType(_SEGMENT))
def segments(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: segment_pages(list(p) if p is not None else []))


def document_segments(docs: DataFrame) -> DataFrame:
    """seg_id ('doc_no-i'), text, ranges and a truncated summary of each segment (F6, F11); docs: doc_no, pages."""
    each = docs.select("doc_no", F.posexplode(segments("pages")).alias("i", "s")).select("doc_no", "i", "s.*")
    return each.select(F.concat_ws("-", "doc_no", F.col("i") + 1).alias("seg_id"), "doc_no", "text", "page_from", "page_to", "char_start", "char_end", S.clip(F.col("text"), L.SUMMARY_MAX).alias("summary"))


def near_breaks(line: str, size: int, slack: int) -> list[str]:
    """A line in pieces of ``size``, each cut moved to the nearest break within ``slack`` (the earlier one of two)."""
    cuts = [0]
    while len(line) - cuts[-1] > size:
        rest = line[cuts[-1] :]
        around = (k for d in range(slack + 1) for k in (size - d, size + d) if 0 < k < min(len(rest), size + slack))
        cuts.append(cuts[-1] + next((k for k in around if rest[k] in L.CHUNK_BREAKS), size))
    return [line[x:y] for x, y in itertools.pairwise([*cuts, len(line)]) if y > x]


_JOINED = re.compile(rf"(?<![A-Za-z0-9_\n])(?=(?:{'|'.join(L.CHUNK_LABELS)}):)")


def chunk_text(text: str, size: int = L.CHUNK_SIZE, overlap: int = L.CHUNK_OVERLAP, slack: int = L.CHUNK_FLOAT) -> list[str]:
    """Chunks that start at line starts, over-long lines cut near a break, each led by the tail of the one before."""
    bodies: list[str] = []
    lines = _JOINED.sub("\n", (text or "").strip()).splitlines()
    for over, run in itertools.groupby(lines, key=lambda x: len(x) > size):
        run = list(run)
        if over:
            bodies += [piece for x in run for piece in near_breaks(x, size, slack)]
        else:
            bodies += ["\n".join(run[i:j]) for i, j in packed([len(x) + 1 for x in run], size)]
    tails = ["", *(b[-overlap:] if overlap else "" for b in bodies)]
    led = (t + "\n" * (t != "" and not t.endswith("\n")) + b for t, b in zip(tails, bodies, strict=False))
    return [c for c in led if c.strip()]


@F.pandas_udf(ArrayType(StringType()))
def chunks(text: pd.Series) -> pd.Series:
    return text.map(chunk_text)


def hub_fingerprint(hub: DataFrame) -> DataFrame:
    """Hashes and counts of a hub document's parts (F8): doc_key, pages, tables."""
    cells = F.aggregate("tables", F.lit(0), lambda a, t: a + F.aggregate(t["rows"], F.lit(0), lambda x, r: x + F.size(r)))
    return hub.select(
        "doc_key",
        F.sha2(F.array_join("pages", "\f"), 256).alias("pages_hash"),
        F.sha2(F.coalesce(F.to_json("tables"), F.lit("[]")), 256).alias("tables_hash"),
        F.size("pages").alias("n_pages"),
        F.size("tables").alias("n_tables"),
        cells.alias("n_cells"),
    )


def feature_hashes(features: DataFrame) -> DataFrame:
    """(doc_key, code, seq, hash) of features (doc_key, code, value) (F12, F13, F15): dates fan out by year, month and day, projects by part."""
    parts = S.date_parts(F.col("value"))
    dates = features.filter(F.col("code").startswith("date")).select("doc_key", "code", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in parts.items()])).alias("p"))
    dates = dates.filter("p.v is not null").select("doc_key", F.concat_ws("_", "code", "p.k").alias("code"), F.lit(0).alias("seq"), F.col("p.v").alias("value"))
    plain = features.filter(~F.col("code").startswith("date") & (F.col("code") != "project")).select("doc_key", "code", F.lit(0).alias("seq"), "value")
    names = features.filter("code = 'project'").select("doc_key", F.posexplode(F.filter(F.split("value", r"[/\-／]"), lambda x: S.trim_space(x) != "")).alias("seq", "value"), F.first("value").over(Window.partitionBy("doc_key").orderBy("value")).alias("whole"))
    subs = names.withColumn("parent", S.feature_hash(F.lit("project"), S.trim_space(F.split("whole", r"[/\-／]")[0])))
    subs = subs.select("doc_key", F.when(F.col("seq") == 0, "project").otherwise("project_sub").alias("code"), "seq", F.when(F.col("seq") == 0, F.col("parent")).otherwise(S.subitem_hash(F.col("parent"), S.trim_space(F.col("value")))).alias("hash"))
    return dates.unionByName(plain).withColumn("hash", S.feature_hash(F.col("code"), F.col("value"))).drop("value").unionByName(subs)


def reusable_summaries(old: DataFrame, current: DataFrame) -> DataFrame:
    """Documents whose hash and number of segments haven't changed (F10): doc_key."""
    return old.alias("o").join(current.alias("c"), ["doc_key", "hub_hash", "n_segments"]).select("doc_key")


def feature_bundle(hashes: DataFrame) -> DataFrame:
    """One hash over each document's feature hashes in order of code and number."""
    pair = F.concat(F.lit('"'), "code", F.lit(":"), F.col("seq").cast("string"), F.lit('":"'), "hash", F.lit('"'))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("code", "seq", pair.alias("p")))), lambda x: x["p"])
    return hashes.groupBy("doc_key").agg(F.sha2(F.concat(F.lit("{"), F.array_join(ordered, ","), F.lit("}")), 256).alias("bundle"))


def project_document(hub: DataFrame) -> dict[str, DataFrame]:
    """The projections of hub documents (doc_key, pages, tables): fingerprints, segments and facts of every kind."""
    tables = hub.select("doc_key", F.posexplode("tables").alias("i", "t")).select(
        "doc_key", F.coalesce("t.page", F.lit(1)).alias("page_no"), (F.col("i") + 1).alias("table_index"), F.col("t.layout").alias("layout"),
        *[F.coalesce(F.col(f"t.{c}"), F.array().cast(k)).alias(c) for c, k in (("header", "array<string>"), ("rows", "array<array<string>>"), ("title_rows", "array<array<string>>"), ("signature_rows", "array<array<string>>"))],
    )
    pages = hub.select("doc_key", F.posexplode("pages").alias("p", "text")).select("doc_key", (F.col("p") + 1).alias("page_no"), "text")
    kv = F.col("layout").eqNullSafe(F.lit("kv"))
    all_ = cell_facts(tables.filter(~kv)).unionByName(kv_table_facts(tables.filter(kv))).unionByName(title_facts(tables)).unionByName(line_facts(pages))
    return {"fingerprints": hub_fingerprint(hub), "segments": document_segments(hub.select(F.col("doc_key").alias("doc_no"), "pages")), "facts": all_}
