"""URL filters with a path-template tree for each host.

Path segments that vary by their form (numbers, long hexadecimal strings) become typed wildcards at once; then,
level by level, a segment position whose parent has many different, thinly used children becomes ``*``. The tree is as deep
as the paths are. From the deepest level up, a branch whose share of blocked labels does not differ significantly from that
of the rest of its parent is merged with it, leaves and inner branches alike; one without labels of its own, or beside
siblings without any, shows no difference and is merged whatever the table's size. Each template belongs to the nearest
branch above it that stands apart, and is rejected when that branch's smoothed blocked share is above a threshold. Labels
come from the rules: pages that a rule blocks or allows.

Nulls and odd rows: a url that is null or has no ``://`` has an empty host and path; repeated rows are judged row by
row; an empty table gives an empty result. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, lower_ascii

#: (host, path, verdict); the longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: A position is variable when its parent has at least so many children, with fewer pages each than that.
MIN_CHILDREN, MAX_SUPPORT = 16, 8
#: Two-sided 5 %: branches closer than this to the blocked share of the rest of their parent are merged.
MERGE_Z = 1.96
#: The prior: so many labelled pages with that blocked share. A host without labels is allowed.
PRIOR_PAGES, PRIOR_BLOCKED = 4.0, 0.1
MAX_BLOCKED = 0.5


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; null where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def shape_of(path: Column) -> Column:
    """The path with numbers and long hexadecimal runs as typed wildcards, without empty segments."""
    typed = F.regexp_replace(F.regexp_replace(path, r"(?<=/)[0-9]+(?=[/.]|$)", "{n}"), r"(?<=/)[0-9a-fA-F-]{16,}(?=[/.]|$)", "{x}")
    return F.regexp_replace(F.regexp_replace(typed, r"/+", "/"), r"/$", "")


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, blocked, labelled) with the column template: thinly used children are generalised to ``*``."""
    at = shapes.withColumn("segs", F.split(F.substr("shape", F.lit(2)), "/")).withColumn("template", F.lit(""))
    deepest = shapes.agg(F.max(F.size(F.split("shape", "/")))).first()[0] or 1
    for d in range(deepest - 1):
        seg = F.get("segs", F.lit(d))
        nodes = (
            at.filter(seg.isNotNull())
            .groupBy("host", "template", seg.alias("seg"))
            .agg(F.sum("n").alias("n"))
            .groupBy("host", "template")
            .agg(F.count("*").alias("children"), F.sum("n").alias("pages"))
            .filter((F.col("children") >= MIN_CHILDREN) & (F.col("pages") < MAX_SUPPORT * F.col("children")))
            .select("host", "template", F.lit(True).alias("varies"))
        )
        nodes = cut(nodes)
        at = lookup(at, nodes, ["host", "template"], nodes.count(), F.col("shape"))
        step = F.when(seg.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("varies"), "*").otherwise(seg)))
        at = cut(at.withColumn("template", step).drop("varies"))
    return at.drop("segs")


def apart(b, l, rest_b, rest_l):  # noqa: E741
    """Does a branch of b blocked among l labelled pages differ from the rest of its parent?"""
    pooled = (b + rest_b + 0.5) / (l + rest_l + 1.0)
    gap = F.abs((b + 0.5) / (l + 1.0) - (rest_b + 0.5) / (rest_l + 1.0))
    z = gap / F.sqrt(pooled * (1 - pooled) * (1 / (l + 1.0) + 1 / (rest_l + 1.0)))
    return (l > 0) & (rest_l > 0) & (z > MERGE_Z)


def verdicts(shaped: DataFrame) -> DataFrame:
    """host, template and purity (smoothed blocked share of the branch that it is merged into) of each template."""
    ends = shaped.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    parts = F.split("template", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), (i - 1).alias("depth"), (i == F.size(parts)).alias("end")))
    each = ends.select("host", "b", "l", F.explode(prefix).alias("p"))
    own = lambda c: F.sum(F.when(F.col("p.end"), F.col(c)).otherwise(0)).alias(c)
    nodes = cut(each.groupBy("host", F.col("p.node").alias("node"), F.col("p.depth").alias("depth")).agg(own("b"), own("l")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    level = lambda d: nodes.filter(F.col("depth") == d).select("host", "node", "b", "l")
    pools, here = {}, level(deepest)
    for d in range(deepest, 0, -1):
        here = here.withColumn("parent", F.regexp_replace("node", r"/[^/]*$", ""))
        up = here.groupBy("host", "parent").agg(F.sum("b").alias("cb"), F.sum("l").alias("cl")).withColumnRenamed("parent", "node")
        up = cut(level(d - 1).join(up, ["host", "node"], "left").fillna(0, ["cb", "cl"]))
        sums = up.select("host", F.col("node").alias("parent"), (F.col("b") + F.col("cb")).alias("pb"), (F.col("l") + F.col("cl")).alias("pl"))
        here = lookup(here, sums, ["host", "parent"], up.count(), F.col("node"))
        b, l = F.col("b"), F.col("l")  # noqa: E741
        pools[d] = here = cut(here.withColumn("apart", apart(b, l, F.col("pb") - b, F.col("pl") - l)))
        joins = here.filter("not apart").groupBy("host", "parent").agg(F.sum("b").alias("mb"), F.sum("l").alias("ml")).withColumnRenamed("parent", "node")
        here = up.join(joins, ["host", "node"], "left").fillna(0, ["mb", "ml"])
        here = here.select("host", "node", (F.col("b") + F.col("mb")).alias("b"), (F.col("l") + F.col("ml")).alias("l"))
    purity = (F.col("b") + PRIOR_PAGES * PRIOR_BLOCKED) / (F.col("l") + PRIOR_PAGES)
    known = cut(here.select("host", "node", purity.alias("purity")))
    out = known
    for d in range(1, deepest + 1):
        above = known.select("host", F.col("node").alias("parent"), F.col("purity").alias("above"))
        known = lookup(pools[d], above, ["host", "parent"], above.count(), F.col("node"))
        known = cut(known.select("host", "node", F.when(F.col("apart"), purity).otherwise(F.col("above")).alias("purity")))
        out = out.unionByName(known)
    return ends.select("host", "template").join(out.withColumnRenamed("node", "template"), ["host", "template"])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    at = at.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    at = cut(at.withColumns({"rule": rule, "ruled": verdict, "shape": shape_of(F.col("path"))}))
    shapes = cut(
        at.groupBy("host", "shape").agg(
            F.count("*").alias("n"),
            F.sum((F.col("ruled") == "block").cast("long")).alias("blocked"),
            F.count("ruled").alias("labelled"),
        ).fillna({"blocked": 0})
    )
    shaped = templates(shapes)
    scored = cut(verdicts(shaped))
    of = lookup(shaped.select("host", "shape", "template"), scored, ["host", "template"], scored.count(), F.col("shape"))
    joined = lookup(at, of, ["host", "shape"], shapes.count(), F.col("page_id"))
    method = F.when(F.col("purity") > MAX_BLOCKED, "block").otherwise("allow")
    return joined.withColumn("verdict", F.coalesce("ruled", method))


COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def op7_url_templates(spark, sf_dir) -> DataFrame:
    """Contract query: host, path, rule and verdict of every page, with the template that it falls under."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(*COLUMNS, "template", "purity")
