"""Entity registration: stable codes, registered projects, dirty and dead registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scalar as S
from ..functions.masking import norm_key, similarity


def prefix_of(category: Column) -> Column:
    out = None
    for name, prefix in L.PREFIXES.items():
        out = F.when(category == name, prefix) if out is None else out.when(category == name, prefix)
    return out


def issue_codes(found: DataFrame, known: DataFrame, watermark: DataFrame) -> DataFrame:
    """known and a code for every new value, in order of first appearance after the category's watermark.

    found: category, value, doc_no, place; known: category, norm_key, code; watermark: category, last_seq. Values with a
    structural fault are not registered (P27). Numbers come from counts of hash parts, so no single task sorts a category.
    """
    new = found.filter(S.value_acceptable(F.col("category"), F.col("value")).isNull()).withColumn("norm_key", norm_key(F.col("value"), F.col("category")))
    first = new.groupBy("category", "norm_key").agg(F.min(F.struct("doc_no", "place")).alias("at")).join(known.select("category", "norm_key"), ["category", "norm_key"], "left_anti")
    number = numbered(first.select("category", "norm_key", "at.doc_no", "at.place"), "category", ["doc_no", "place", "norm_key"])
    seq = F.coalesce("last_seq", F.lit(0)) + F.col("number")
    issued = number.join(watermark, "category", "left").select("category", "norm_key", F.concat(prefix_of(F.col("category")), F.lpad(seq.cast("string"), F.greatest(F.lit(4), F.length(seq.cast("string"))), F.lit("0"))).alias("code"))
    return known.select("category", "norm_key", "code").unionByName(issued)


def numbered(df: DataFrame, group: str, order: list[str], parts: int = 64) -> DataFrame:
    """df with ``number``: 1, 2, ... within each group in order. Rows are ranged over parts by the first order column, which
    are counted apart, so a group with most of the rows is still numbered by many tasks."""
    bounds = df.select(F.min(order[0]).alias("lo"), F.max(order[0]).alias("hi"))
    span = df.join(F.broadcast(bounds))  # one row
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(parts - 1), F.floor((F.col(order[0]) - F.col("lo")) * parts / (F.col("hi") - F.col("lo") + 1)))).otherwise(0)
    at = span.withColumn("__part", part.cast("int")).drop("lo", "hi")
    counts = at.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.join(F.broadcast(counts.withColumn("__before", before).drop("__n")), [group, "__part"])
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    return at.withColumn("number", (F.col("__before") + inside).cast("long")).drop("__part", "__before")


def branch_codes(branches: DataFrame, existing: DataFrame) -> DataFrame:
    """Codes of branches (parent_code, value) after the parent's highest branch number."""
    top = existing.groupBy("parent_code").agg(F.max("branch_seq").alias("top"))
    n = F.row_number().over(Window.partitionBy("parent_code").orderBy("value")) + F.coalesce("top", F.lit(0))
    both = branches.join(top, "parent_code", "left").withColumn("branch_seq", n)
    return both.withColumn("code", F.concat("parent_code", F.format_string("-%02d", "branch_seq"))).drop("top")


def lookup_real(texts: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes found in texts with their real values where the category is plain; secret ones stay hidden."""
    found = texts.select("doc_key", F.explode(S.codes_in(F.col("text"))).alias("code"))
    plain = codes.filter(~F.col("category").isin(*L.SECRET)).select("code", "real_value")
    return found.join(plain, "code", "left")


def scan_dirty(registered: DataFrame) -> DataFrame:
    """Registrations (category, code, value) that break the structural rules, with the reason."""
    return registered.withColumn("reason", S.value_acceptable(F.col("category"), F.col("value"))).filter("reason is not null")


def cross_category(registered: DataFrame) -> DataFrame:
    """Values registered under several categories, by fingerprint."""
    at = registered.withColumn("fingerprint", S.project_fingerprint(F.col("value")))
    return at.groupBy("fingerprint").agg(F.count_distinct("category").alias("n_categories"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("code")).alias("codes")).filter("n_categories > 1")


def code_references(texts: DataFrame) -> DataFrame:
    """Documents that mention each code: code, n_docs."""
    return texts.select("doc_key", F.explode(S.codes_in(F.col("text"))).alias("code")).distinct().groupBy("code").agg(F.count("*").alias("n_docs"))


def dead(registered: DataFrame, texts: DataFrame) -> DataFrame:
    """Registrations that no text mentions."""
    return registered.join(code_references(texts).select("code"), "code", "left_anti")


def orphan_codes(texts: DataFrame, registered: DataFrame) -> DataFrame:
    """Codes in texts that nobody registered."""
    return code_references(texts).join(registered.select("code").distinct(), "code", "left_anti")


def check_projects(names: DataFrame, registered: DataFrame) -> DataFrame:
    """Project names (name) against the registry (code, name): exact, core, similar or none.

    Equal fingerprints join first. What is left is compared only with registered cores that share a character bigram, so
    no pair without one is made; the ratio is the matching-block ratio.
    """
    r = registered.select("code", S.project_norm(F.col("name")).alias("r_norm"), S.project_core(F.col("name")).alias("r_core"))
    n = names.select("name", S.project_norm(F.col("name")).alias("norm"), S.project_core(F.col("name")).alias("core")).distinct()
    exact = n.join(r, n.norm == r.r_norm).select("name", F.lit("exact").alias("match"), "code", F.lit(1.0).alias("ratio"))
    rest = n.join(exact.select("name"), "name", "left_anti")
    core = rest.join(r, rest.core == r.r_core).select("name", F.lit("core").alias("match"), "code", F.lit(1.0).alias("ratio"))
    rest = rest.join(core.select("name"), "name", "left_anti").filter(F.length("core") >= L.SIMILAR_MIN)
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(F.col(c), i, F.lit(2)))))
    left = rest.select("name", "core", grams("core").alias("gram"))
    right = r.filter(F.length("r_core") >= L.SIMILAR_MIN).select("code", "r_core", grams("r_core").alias("gram"))
    pairs = left.join(right, "gram").select("name", "core", "code", "r_core").distinct()
    inside = F.contains("core", F.col("r_core")) | F.contains("r_core", F.col("core"))
    scored = pairs.withColumn("ratio", F.when(inside, 1.0).otherwise(similarity("core", "r_core"))).filter(F.col("ratio") >= L.SIMILAR_RATIO)
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ratio"), "code"))
    close = scored.withColumn("__n", best).filter("__n = 1").select("name", F.lit("similar").alias("match"), "code", "ratio")
    found = exact.unionByName(core).unionByName(close)
    return n.select("name").join(found, "name", "left").withColumn("match", F.coalesce("match", F.lit("none")))


def approve_proposals(proposals: DataFrame, registered: DataFrame) -> DataFrame:
    """registered and the approved proposals (name, status) that aren't in it, coded after the highest code."""
    last = registered.agg(F.coalesce(F.max(F.substring("code", 3, 9).cast("int")), F.lit(0)).alias("last"))
    new = proposals.filter("status = 'approved'").select(S.trim_space(F.col("name")).alias("name")).distinct()
    new = new.withColumn("fp", S.project_fingerprint(F.col("name"))).join(registered.select(S.project_fingerprint(F.col("name")).alias("fp")), "fp", "left_anti")
    seq = F.row_number().over(Window.orderBy("name"))
    coded = new.withColumn("n", seq).join(F.broadcast(last)).select(F.format_string("PJ%04d", F.col("n") + F.col("last")).alias("code"), "name")
    return registered.select("code", "name").unionByName(coded)


def set_primary(entities: DataFrame, code: str) -> DataFrame:
    """Own companies with exactly one primary."""
    return entities.withColumn("is_primary", F.col("code") == code)
