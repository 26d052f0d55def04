"""Ledgers, the inbox of items to post, duplicate content, copies, repository state, roles and dynamic columns.

Upserts are keyed full joins that give a new table; nothing is changed in place.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scalar as S


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old=()) -> DataFrame:
    """old and new by key with the action on each row (K7): new values win; columns of keep_old keep the old value where the new one is null or blank."""
    o, n = old.alias("o"), new.dropDuplicates([key]).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, was = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()

    def value(c):
        fresh = F.nullif(F.col(f"n.{c}"), F.lit("")) if dict(new.dtypes)[c] == "string" else F.col(f"n.{c}")
        return F.when(is_new, F.coalesce(fresh, F.col(f"o.{c}")) if c in keep_old else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    action = F.when(is_new & was, "updated").when(is_new, "inserted").otherwise("kept")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[value(c) for c in old.columns if c != key], action.alias("action"))


def search(ledger: DataFrame, words: str, limit: int = 100, offset: int = 0, order: str | None = None) -> DataFrame:
    """Rows with the words in any column, as text, in pages of 1 to 5000."""
    text = ledger.filter(reduce(or_, [F.col(c).cast("string").ilike(f"%{words}%") for c in ledger.columns])) if words else ledger
    return text.orderBy(order or ledger.columns[0]).offset(max(0, offset)).limit(min(max(1, limit), 5000))


def filter_by(df: DataFrame, **equal) -> DataFrame:
    """Rows that meet every condition given: a value, or a LIKE pattern with %."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column).like(value) if isinstance(value, str) and "%" in value else F.col(column) == F.lit(value))
    return df


def update_cell(ledger: DataFrame, key: str, row, column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """ledger with one typed cell changed, and the audit row with old and new."""
    kind = dict(ledger.dtypes)[column]
    value = S.coerce(F.lit(text), kind)
    at = F.col(key) == F.lit(row)
    audit = ledger.filter(at).select(F.col(key).cast("string").alias("key"), F.lit(column).alias("column"), F.col(column).cast("string").alias("old"), value.cast("string").alias("new"))
    return ledger.withColumn(column, F.when(at, value).otherwise(F.col(column))), audit


def toggle(ledger: DataFrame, key: str, row, column: str) -> DataFrame:
    """One boolean cell turned round."""
    return ledger.withColumn(column, F.when(F.col(key) == F.lit(row), ~F.coalesce(F.col(column), F.lit(False))).otherwise(F.col(column)))


def stage(inbox: DataFrame, items: DataFrame) -> DataFrame:
    """inbox with items (item_id, kind, doc_key, fields) staged: decided rows are left alone, pending ones get the new fields."""
    new = items.select("item_id", F.col("kind").alias("__k"), F.col("doc_key").alias("__d"), F.col("fields").alias("__f")).dropDuplicates(["item_id"])
    both = inbox.join(new, "item_id", "full_outer")
    open_ = F.col("__k").isNotNull() & (F.col("status").isNull() | (F.col("status") == "pending"))
    return both.select(
        "item_id",
        F.when(open_, F.col("__k")).otherwise(F.col("kind")).alias("kind"),
        F.when(open_, F.col("__d")).otherwise(F.col("doc_key")).alias("doc_key"),
        F.when(open_, F.map_concat(F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys("__f"), k)), "__f")).otherwise(F.col("fields")).alias("fields"),
        F.coalesce("status", F.lit("pending")).alias("status"),
    )


def decide(inbox: DataFrame, item, status: str) -> DataFrame:
    """A pending item approved (posted) or rejected; decided ones don't change."""
    return inbox.withColumn("status", F.when((F.col("item_id") == F.lit(item)) & (F.col("status") == "pending"), status).otherwise(F.col("status")))


def update_fields(inbox: DataFrame, item, fields: dict[str, str]) -> DataFrame:
    """Fields of a pending item overwritten or added."""
    new = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    merged = F.map_concat(F.map_filter("fields", lambda k, v: ~k.isin(*fields)), new)
    return inbox.withColumn("fields", F.when((F.col("item_id") == F.lit(item)) & (F.col("status") == "pending"), merged).otherwise(F.col("fields")))


def inbox_counts(inbox: DataFrame) -> DataFrame:
    """Items by status and kind, with a subtotal of each status."""
    out = inbox.groupingSets([["status", "kind"], ["status"]], "status", "kind").agg(F.count("*").alias("n"), F.grouping("kind").alias("g"))
    return out.select("status", F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "n")


# --- Duplicate content and copies ---


def content_index(files: DataFrame) -> DataFrame:
    """Files (doc_key, content_hash, scanned_at) by content: canonical key, other keys, scans."""
    return files.groupBy("content_hash").agg(
        F.min_by("doc_key", F.struct("scanned_at", "doc_key")).alias("canonical"),
        F.array_sort(F.collect_set("doc_key")).alias("doc_keys"),
        F.count("*").alias("scans"),
    ).withColumn("duplicates", F.size("doc_keys") - 1)


def dedup_decision(files: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """What to do with files (doc_key, content_hash, mask_tag) given the index (content_hash, canonical, mask_tag)."""
    known = files.join(index.select("content_hash", "canonical", F.col("mask_tag").alias("old_tag")), "content_hash", "left")
    return known.withColumn(
        "decision",
        F.when(F.lit(force), "forced").when(F.col("canonical").isNull(), "new").when(~F.col("mask_tag").eqNullSafe(F.col("old_tag")), "config_changed").when(F.col("canonical") == F.col("doc_key"), "unchanged_skip").otherwise("duplicate_skip"),
    )


def copy_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files whose name without copy marks and whose head and tail match a document: it is replaced (D3, J25); both: doc_key, name, head_tail."""
    base, marker = S.split_copy_marker(F.col("name"))
    new = files.select(F.col("doc_key").alias("new_key"), base.alias("base"), marker.alias("marker"), "head_tail")
    old = existing.select(F.col("doc_key").alias("old_key"), S.split_copy_marker(F.col("name"))[0].alias("base"), "head_tail")
    return new.join(old, ["base", "head_tail"]).filter("new_key != old_key").select("new_key", "old_key", "marker")


def next_numbers(existing: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The first document number never used, retired ones included."""
    return existing.select("doc_no").unionByName(tombstones.select("doc_no")).agg((F.coalesce(F.max("doc_no"), F.lit(0)) + 1).alias("next"))


def delete_document(tables: dict[str, DataFrame], doc_key: str, tombstones: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the document, its edges from either end gone too, and the tombstones with its number."""
    out = {}
    for name, df in tables.items():
        if "doc_key" in df.columns:
            df = df.filter(~F.col("doc_key").eqNullSafe(F.lit(doc_key)))
        if {"src", "dst"} <= set(df.columns):
            mine = lambda c: F.coalesce(S.node_doc(F.col(c)) == doc_key, F.lit(False))
            df = df.filter(~(mine("src") | mine("dst")))
        out[name] = df
    gone = tables["documents"].filter(F.col("doc_key") == doc_key).select("doc_no", "doc_key")
    return out, tombstones.unionByName(gone, allowMissingColumns=True)


def format_preview(tables: dict[str, DataFrame], keep=("entity_map",)) -> DataFrame:
    """Rows that formatting the repository would drop, by table; mappings stay."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), F.when(F.lit(name in keep), 0).otherwise(F.col("n_rows")).alias("dropped")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def repository_state(documents: DataFrame, *counted: tuple[str, DataFrame]) -> DataFrame:
    """Documents with the number of their rows in each of the counted tables."""
    for name, df in counted:
        counts = df.groupBy("doc_key").agg(F.count("*").alias(name))
        documents = documents.join(counts, "doc_key", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return documents


def repository_summary(items: DataFrame) -> DataFrame:
    """One row of totals over repository items (listed, source_exists, hub_exists, duplicate, n_facts, n_edges)."""
    gone = lambda c: F.count_if(F.col("listed") & ~F.col(c))
    return items.agg(
        F.count_if("listed").alias("docs"), F.count_if(~F.col("listed")).alias("orphan"), gone("source_exists").alias("source_missing"), gone("hub_exists").alias("hub_missing"),
        F.count_if("duplicate").alias("duplicate"), F.coalesce(F.sum("n_facts"), F.lit(0)).alias("facts"), F.coalesce(F.sum("n_edges"), F.lit(0)).alias("edges"),
    )


def unlisted(on_disk: DataFrame, documents: DataFrame) -> DataFrame:
    """Files without a document."""
    return on_disk.join(documents.select("doc_key"), "doc_key", "left_anti")


def reclassify(documents: DataFrame) -> DataFrame:
    """Documents whose category would change (D10): name, pages, category."""
    return documents.withColumn("new_category", S.classify_document(F.col("name"), F.col("pages"))).filter(~F.col("category").eqNullSafe(F.col("new_category")))


def refresh_inbox(inbox: DataFrame, documents: DataFrame) -> DataFrame:
    """Items staged from documents (doc_key, name, category, pages) that pass the gate."""
    kind = S.kind_of(F.col("category"), S.is_contract(F.col("name"), F.col("pages")))
    fields = S.invoice_fields(F.array_join("pages", "\n"))
    names = ("invoice_no", "invoice_date", "seller", "buyer", "total", "contract_code")
    at = documents.withColumns({"kind": kind, "f": fields}).filter("kind != 'other'")
    pairs = F.array(*[F.struct(F.lit(n), F.col(f"f.{n}").cast("string")) for n in names])
    items = at.select(F.sha1("doc_key").alias("item_id"), "kind", "doc_key", F.map_from_entries(F.filter(pairs, lambda p: p["col2"].isNotNull())).alias("fields"))
    return stage(inbox, items)


# --- Roles and columns ---

ROLES = {"admin": ("ledger:read", "ledger:write", "entity:decrypt:project", "user:manage"), "accountant": ("ledger:read", "ledger:write"), "viewer": ("ledger:read",)}


def allowed(users: DataFrame, grants: DataFrame, permission: str) -> DataFrame:
    """Users (user, role) with whether their role has a permission (C1, J3); grants: role, permission."""
    has = grants.filter(F.col("permission") == permission).select("role", F.lit(True).alias("ok")).distinct()
    return users.join(has, "role", "left").withColumn("allowed", F.coalesce("ok", F.lit(False))).drop("ok")


def register_user(users: DataFrame, name: str) -> DataFrame:
    """users with a new one, admin if it's the first (C2); a name that exists stays as it is."""
    first = users.agg(F.count("*").alias("n"), F.count_if(F.col("user") == name).alias("same"))
    new = first.filter("same = 0").select(F.lit(name).alias("user"), F.when(F.col("n") == 0, "admin").otherwise("viewer").alias("role"), F.lit(True).alias("active"))
    return users.select("user", "role", "active").unionByName(new)


def transfer_admin(users: DataFrame, old: str, new: str) -> DataFrame:
    """The admin role handed over; there is never a second admin."""
    return users.withColumn("role", F.when(F.col("user") == new, "admin").when(F.col("user") == old, "accountant").otherwise(F.col("role")))


def alter(ledger: DataFrame, add: dict[str, str] | None = None, drop=(), rename: dict[str, str] | None = None) -> DataFrame:
    """ledger with columns added (typed nulls), dropped and renamed."""
    for name, kind in (add or {}).items():
        ledger = ledger.withColumn(name, F.lit(None).cast(kind))
    return ledger.drop(*drop).withColumnsRenamed(rename or {})


def can_be_key(ledger: DataFrame, column: str) -> DataFrame:
    """Is a column without nulls and repeats (C3)?"""
    return ledger.agg(((F.count("*") == F.count(column)) & (F.count("*") == F.count_distinct(column))).alias("ok"))


def reconcile(catalog: DataFrame, physical: list[tuple[str, str]]) -> DataFrame:
    """catalog (column) against the columns there are (name, type): rows to add and to drop."""
    spark = catalog.sparkSession
    there = spark.createDataFrame(physical, "column string, type string")
    new = there.join(catalog.select("column"), "column", "left_anti").select("column", F.lit("add").alias("change"))
    gone = catalog.join(there.select("column"), "column", "left_anti").select("column", F.lit("drop").alias("change"))
    return new.unionByName(gone)


def history(messages: DataFrame, turns: int = 6) -> DataFrame:
    """The last 2 * turns messages of each conversation as one text, oldest first."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = messages.withColumn("n", last).filter(F.col("n") <= 2 * turns)
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("history"), F.count("*").alias("n_messages"))


def rename_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed names (dir, old, new) made different from each other and from the names that exist (dir, name).

    A taken name gets (1), (2), ... before its ending, in order of the old names. Names can only meet if they are alike
    without such numbers, so each such family of a directory is settled by itself; a task
    reads its families in order and holds the names of one.
    """
    parts = lambda c: (F.regexp_replace(c, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(c, r"(?<=.)(\.[^.]*)$", 1))
    family = lambda c: F.concat_ws("/", F.regexp_replace(parts(c)[0], r"(\([0-9]+\))+$", ""), parts(c)[1])
    stem, ext = parts(F.col("new"))
    asked = files.select("dir", family(F.col("new")).alias("family"), F.lit(1).alias("asks"), "old", "new", stem.alias("stem"), ext.alias("ext"))
    none = F.lit(None).cast("string")
    there = existing.select("dir", family(F.col("name")).alias("family"), F.lit(0).alias("asks"), none.alias("old"), F.col("name").alias("new"), none.alias("stem"), none.alias("ext"))
    order = ["dir", "family", "asks", "old", "new"]
    rows = asked.unionByName(there).repartition("dir", "family").sortWithinPartitions(*order)

    def settle(batches):
        at, taken, tried = None, set(), {}
        for batch in batches:
            out = []
            for directory, fam, asks, old, new, stem, ext in batch.itertuples(index=False):
                if (directory, fam) != at:
                    at, taken, tried = (directory, fam), set(), {}
                given, n = new, tried.get(new, 0) if asks else 0
                while asks and given in taken:
                    n += 1
                    given = f"{stem}({n}){ext}"
                if asks:
                    tried[new] = n
                    out.append((directory, old, given))
                taken.add(given)
            yield pd.DataFrame(out, columns=["dir", "old", "new"])

    return rows.mapInPandas(settle, "dir string, old string, new string")


def contract_rows(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """Ledger rows of contracts by patterns alone (P24): documents: doc_key, name, text; codes: code, real_value.

    Party A's real value by its code in the text; where it isn't known, it is left for a person to check.
    """
    found = documents.select("doc_key", S.contract_fields(F.col("name"), F.col("text")).alias("f")).select("doc_key", "f.*")
    real = codes.select(F.col("code").alias("party_a"), "real_value").dropDuplicates(["party_a"])
    return found.join(real, "party_a", "left").select(
        "doc_key", "contract_code", F.lit(None).cast("string").alias("contract_term"), F.coalesce("real_value", F.lit(L.UNCHECKED)).alias("party_a"), F.lit(0.0).alias("income"), F.lit(False).alias("is_paid"),
    )


def thinking_stats(messages: DataFrame) -> DataFrame:
    """Entries, characters and tokens of each conversation's thinking (A18); messages: conv_id, text, tokens."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("entries"), F.sum(F.length("text")).alias("chars"), F.sum("tokens").alias("tokens"))


def shared_documents(a: DataFrame, b: DataFrame) -> DataFrame:
    """Document keys in both of two workspaces; none if they are isolated."""
    return a.select("doc_key").intersect(b.select("doc_key"))
