"""File discovery, JSON artifacts, office documents, HTML tables and their writers.

Listing and JSON are Spark's own readers. Office archives and HTML are parsed by the standard library inside Arrow-batched
functions over binaryFile, one file at a time, so files may be many but each must fit a task.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import lexicon as L
from ..functions import scalar as S

TABLE = StructType([
    StructField("source", StringType()), StructField("sheet", StringType()), StructField("table_index", IntegerType()), StructField("page", IntegerType()),
    StructField("layout", StringType()), StructField("header", ArrayType(StringType())), StructField("rows", ArrayType(ArrayType(StringType()))),
    StructField("title_rows", ArrayType(ArrayType(StringType()))), StructField("signature_rows", ArrayType(ArrayType(StringType()))),
])
HUB = StructType([
    StructField("kind", StringType()), StructField("doc_key", StringType()), StructField("source_file", StringType()), StructField("source_dir", StringType()),
    StructField("rel_path", StringType()), StructField("category", StringType()), StructField("page_count", IntegerType()),
    StructField("pages", ArrayType(StringType())), StructField("tables", ArrayType(TABLE)), StructField("offset_maps", ArrayType(ArrayType(ArrayType(IntegerType())))),
])
BLOCK = StructType([StructField("block_label", StringType()), StructField("block_content", StringType())])
PAGE = StructType([StructField("res", StructType([StructField("page_index", IntegerType()), StructField("full_text", StringType()), StructField("parsing_res_list", ArrayType(BLOCK))]))])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def discover(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Input files under a folder (S1, S2, S19): path, rel_path, name, ext, length; lock files and other endings are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    kept = found.withColumns({"name": file_name(F.col("path")), "ext": ext}).filter(F.col("ext").isin(*L.INPUT_EXTENSIONS) & ~F.col("name").rlike(r"^[~.]~?\$|^\.~|^~\$"))
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^[a-z]+:/*", "/")
    rel = F.regexp_replace(F.substr("path", F.instr("path", root) + F.length(root)), "^/+", "")
    return kept.select("path", rel.alias("rel_path"), "name", "ext", "length", *(["content"] if content else [])).orderBy("path")


def order_for_processing(files: DataFrame) -> DataFrame:
    """Files that need no recognition first, else in their order (S5): name, ext, n_text_pages, n_pages, position."""
    needs = F.col("ext").isin(*L.OCR_EXTENSIONS) | ((F.col("ext") == "pdf") & (F.coalesce("n_text_pages", F.lit(0)) < F.coalesce("n_pages", F.lit(1))))
    return files.withColumn("needs_ocr", needs).orderBy("needs_ocr", "position")


def doc_key(rel_path: Column) -> Column:
    """First folder and stem, or the stem alone."""
    stem = F.regexp_replace(file_name(rel_path), r"(?<=.)\.[^.]*$", "")
    return F.when(rel_path.contains("/"), F.concat_ws("/", F.substring_index(rel_path, "/", 1), stem)).otherwise(stem)


def read_hub(spark: SparkSession, folder: str) -> DataFrame:
    """Hub documents under a folder (S3): sidecars, mapping files and other kinds are left out."""
    at = spark.read.schema(HUB).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    name = file_name(F.col("_metadata.file_path"))
    return at.filter("kind = 'hub_doc'").filter(~name.rlike(r"\.(l1|features)\.json$") & ~name.contains("_mapping"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page JSON: page_no, text (full text, or block lines with their labels) and blocks."""
    at = spark.read.schema(PAGE).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder)
    blocks = F.coalesce("res.parsing_res_list", F.array().cast(ArrayType(BLOCK)))
    lines = F.array_join(F.transform(blocks, lambda b: F.concat(F.coalesce(b["block_label"], F.lit("")), F.lit(":"), F.coalesce(b["block_content"], F.lit("")))), "\n")
    return at.select(F.col("_metadata.file_path").alias("path"), F.col("res.page_index").alias("page_no"), F.coalesce(F.nullif("res.full_text", F.lit("")), lines).alias("text"), blocks.alias("blocks"))


def missing_pages(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Pages (stem, hash10, page_no) that no cache holds."""
    return wanted.join(cached.select("stem", "hash10", "page_no"), ["stem", "hash10", "page_no"], "left_anti")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Conversation lines; lines that aren't JSON are skipped."""
    return spark.read.schema("conv_id long, turn long, role string, text string").option("mode", "DROPMALFORMED").json(path)


def table_runs(lines: DataFrame) -> DataFrame:
    """Runs of 'table:' lines in pages (doc_key, page_no, line_no, line) as blocks."""
    from pyspark.sql import Window

    own = lines.filter(F.col("line").startswith("table:"))
    order = Window.partitionBy("doc_key", "page_no").orderBy("line_no")
    run = own.withColumn("run", F.col("line_no") - F.row_number().over(order))
    row = F.transform(F.split(F.regexp_replace("line", "^table:", ""), r"\|"), S.trim_space)
    got = run.groupBy("doc_key", "page_no", "run").agg(F.min("line_no").alias("first_line"), F.transform(F.sort_array(F.collect_list(F.struct("line_no", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    return got.drop("run")


def table_metadata(tables: DataFrame, most: int = 20) -> DataFrame:
    """What may leave the house of tables: sheet, header and at most ``most`` project values."""
    at = F.array_position(F.col("header"), "项目名称").cast("int")
    values = F.array_distinct(F.filter(F.transform("rows", lambda r: F.when(at > 0, F.get(r, at - 1))), lambda v: F.coalesce(v != "", F.lit(False))))
    return tables.select("doc_key", "sheet", "header", F.slice(values, 1, most).alias("projects"))


def read_legend(spark: SparkSession, path: str) -> DataFrame:
    """The entity legend of a sample corpus as rows: category, code, real_value, masked."""
    entry = "struct<real:string,masked:string>"
    at = spark.read.option("multiLine", "true").schema(f"`类别` map<string,map<string,{entry}>>").json(path)
    codes = at.select(F.explode("类别").alias("category", "codes")).select("category", F.explode("codes").alias("code", "e"))
    return codes.select("category", "code", F.col("e.real").alias("real_value"), F.col("e.masked").alias("masked"))


def read_weak_edges(spark: SparkSession, path: str, validated: float = 0.8) -> DataFrame:
    """Edges of a sample corpus (S20): validated from a weight on, else hypotheses."""
    at = spark.read.option("multiLine", "true").schema("edges array<struct<src:string,dst:string,relation:string,weight:double,basis:string>>").json(path)
    e = at.select(F.explode("edges").alias("e")).select("e.*")
    return e.select(F.substring(F.sha1(F.concat_ws("|", "src", "dst", "relation")), 1, 32).alias("edge_id"), "src", "dst", "relation", F.col("weight").alias("confidence"), F.when(F.col("weight") >= validated, "validated").otherwise("hypothesis").alias("status"), "basis")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected facts of a sample corpus's questions (S20): question_id, doc_key, header, value."""
    fact = "array<struct<doc_key:string,header:string,value:string>>"
    at = spark.read.option("multiLine", "true").schema(f"questions array<struct<id:string,question:string,evidence_docs:array<string>,evidence_facts:{fact}>>").json(path)
    q = at.select(F.explode("questions").alias("q"))
    return q.select(F.col("q.id").alias("question_id"), F.explode("q.evidence_facts").alias("f")).select("question_id", "f.*")


# --- Office and HTML ---

SHEET_ROW = StructType([StructField("sheet", StringType()), StructField("row", IntegerType()), StructField("cells", ArrayType(StringType())), StructField("merged", BooleanType())])
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group(0):
        n = 26 * n + ord(c) - 64
    return n - 1


def cell_name(row: int, col: int) -> str:
    """A1 name of a cell, both from 0."""
    name, col = "", col + 1
    while col:
        col, r = divmod(col - 1, 26)
        name = chr(65 + r) + name
    return f"{name}{row + 1}"


def xlsx_rows(content: bytes) -> list[dict]:
    """Rows of all sheets with text cells; merged ranges keep their first cell, rows in a range over columns are marked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_MAIN + "si"):
                shared.append("".join(t.text or "" for t in si.iter(_MAIN + "t")))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            target = links[sheet.get(_REL + "id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            wide = set()
            for m in root.iter(_MAIN + "mergeCell"):
                a, _, b = m.get("ref").partition(":")
                if b and column_number(a) != column_number(b):
                    wide |= set(range(int(re.sub("[A-Z]", "", a)), int(re.sub("[A-Z]", "", b)) + 1))
            for row in root.iter(_MAIN + "row"):
                cells: list[str] = []
                for c in row.iter(_MAIN + "c"):
                    value = c.find(_MAIN + "v")
                    text = "".join(t.text or "" for t in c.iter(_MAIN + "t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                    elif re.fullmatch(r"-?[0-9]+\.0+", text):
                        text = text.partition(".")[0]
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells)) + [text.strip()]
                n = int(row.get("r") or 0)
                out.append({"sheet": sheet.get("name"), "row": n, "cells": cells, "merged": n in wide})
    return out


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs (sheet 'p') and table rows (sheet 't1', 't2', ...) in order; cells that span columns are padded."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    text = lambda e: "".join(t.text or "" for t in e.iter(_W + "t")).strip()
    out, tables = [], 0
    for n, e in enumerate(body if body is not None else ()):
        if e.tag == _W + "p" and text(e):
            out.append({"sheet": "p", "row": n, "cells": [text(e)], "merged": False})
        elif e.tag == _W + "tbl":
            tables += 1
            for k, tr in enumerate(e.iter(_W + "tr")):
                cells, wide = [], False
                for tc in tr.findall(_W + "tc"):
                    props = tc.find(_W + "tcPr")
                    span = props.find(_W + "gridSpan") if props is not None else None
                    merge = props.find(_W + "vMerge") if props is not None else None
                    more = int(span.get(_W + "val") or 1) if span is not None else 1
                    goes_on = merge is not None and merge.get(_W + "val") != "restart"
                    cells += ["" if goes_on else text(tc)] + [""] * (more - 1)
                    wide |= more > 1
                out.append({"sheet": f"t{tables}", "row": k, "cells": cells, "merged": wide})
    return out


def office_rows(name: str, content: bytes) -> list[dict]:
    """Rows of an office file by its ending; none for a file that isn't what its ending says."""
    try:
        return xlsx_rows(content) if name.lower().endswith(".xlsx") else docx_blocks(content) if name.lower().endswith(".docx") else []
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []


@F.pandas_udf(ArrayType(SHEET_ROW))
def read_office(name: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([office_rows(n, bytes(c)) for n, c in zip(name, content, strict=True)])


class _Tables(HTMLParser):
    """Cells of all tables with their spans."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            number = lambda k: max(1, int(v)) if (v := dict(attrs).get(k) or "1").isdigit() else 1
            self.cell, self.span = [], (number("rowspan"), number("colspan"))
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((" ".join("".join(self.cell).split()), *self.span))
            self.cell = None


def html_grid(html: str) -> list[list[str]]:
    """Rows of an HTML table, cells repeated over the rows and columns that they span."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    parser._close()
    grid: list[dict[int, str]] = [{} for _ in parser.rows]
    for r, row in enumerate(parser.rows):
        c = 0
        for text, down, across in row:
            while c in grid[r]:
                c += 1
            for dr in range(min(down, len(grid) - r)):
                for dc in range(across):
                    grid[r + dr][c + dc] = text
            c += across
    return [[row.get(c, "") for c in range(max(row) + 1)] if row else [] for row in grid]


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def parse_html_table(html: pd.Series) -> pd.Series:
    return html.map(html_grid)


def parse_block(content: Column) -> Column:
    """Rows of a table block: HTML, pipes or plain lines."""
    from ..operators.layout import pipe_table, plain_table

    pipes = F.size(F.filter(F.split(content, "\n"), lambda x: x.rlike(r"\|.*\|"))) > 0
    return F.when(F.lower(content).contains("<table") | F.lower(content).contains("<tr"), parse_html_table(content)).when(pipes, pipe_table(content)).otherwise(plain_table(content))


def page_tables(pages: DataFrame) -> DataFrame:
    """Table blocks of pages with their rows (S14): path, page_no, block_no, rows."""
    blocks = pages.select("path", "page_no", F.posexplode("blocks").alias("block_no", "b")).filter(F.lower("b.block_label").contains("table"))
    return blocks.select("path", "page_no", "block_no", parse_block(F.coalesce("b.block_content", F.lit(""))).alias("rows"))


@F.pandas_udf(StringType())
def repair_name(name: pd.Series) -> pd.Series:
    """A garbled file name decoded again, the ending kept; null if it isn't garbled or nothing better is found."""

    def fix(s):
        if not s:
            return None
        stem, dot, ext = s.rpartition(".")
        stem, ext = (stem, dot + ext) if dot and stem else (s, "")
        if not re.search("[�À-ɏ─-▟]", stem):
            return None
        for wrong, right in (("cp437", "gbk"), ("latin-1", "utf-8"), ("latin-1", "gbk"), ("gbk", "utf-8"), ("cp1252", "utf-8")):
            try:
                new = stem.encode(wrong).decode(right)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if re.search(L.CJK, new) and "�" not in new:
                return new + ext
        return None

    return name.map(fix)


# --- Sinks ---


def write_hub(hub: DataFrame, folder: str) -> None:
    """Hub documents by source folder (K1)."""
    hub.withColumn("folder", F.coalesce(F.nullif("source_dir", F.lit("")), F.lit("_"))).write.mode("append").partitionBy("folder").json(folder)


def write_sidecars(documents: DataFrame, folder: str) -> None:
    """One line of JSON for each document's summary, hash and counts (K2)."""
    documents.select(F.to_json(F.struct(*documents.columns)).alias("value")).write.mode("overwrite").text(folder)


def write_ledger(ledger: DataFrame, folder: str) -> None:
    """CSV with a header and a byte order mark in its first name, which spreadsheets look for."""
    first = ledger.columns[0]
    ledger.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", "true").csv(folder)


def write_cards(cards: DataFrame, folder: str) -> None:
    """Cards as JSON, and as text for reading."""
    cards.write.mode("overwrite").json(f"{folder}/json")
    cards.select(F.concat_ws("\n", F.concat(F.lit("## "), "doc_key"), F.coalesce("summary", F.lit("")), F.coalesce("features", F.lit(""))).alias("value")).write.mode("overwrite").text(f"{folder}/md")


def append_audit(events: DataFrame, folder: str) -> None:
    """Audit rows appended, by day."""
    events.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(folder)


def replace_partitions(rows: DataFrame, folder: str, key: str, buckets: int = 256) -> None:
    """Rows written over those of the same buckets of key, other buckets untouched (K6)."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
