"""Connected components of a link table, by hooking to the least neighbour and pointer jumping.

Every round each component's root points to the least root that it has a link with (or stays), chains of pointers are
shortened until each leads to its end, and links inside a component are dropped. No link or label leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup


def _through(df: DataFrame, col: str, labels: DataFrame, n: int, spread) -> DataFrame:
    """df with col replaced by its label, where it has one."""
    found = lookup(df.withColumnRenamed(col, "__at"), labels.select(F.col("node").alias("__at"), F.col("label").alias("__label")), ["__at"], n, spread, nulls=False)
    return found.withColumn(col, F.coalesce("__label", "__at")).drop("__at", "__label")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every end of links (a, b): label is the least node reachable. Ends that are null are ignored."""
    scratch = Scratch(links.sparkSession)
    edges = scratch.table(links.filter("a is not null and b is not null and a != b").select("a", "b").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
        n = hooks.count()
        if n == 0:
            break
        while True:  # pointer jumping
            jumped = scratch.table(_through(hooks.withColumn("old", F.col("label")), "label", hooks, n, F.col("node")))
            done = jumped.filter("old != label").isEmpty()
            hooks = jumped.drop("old")
            if done:
                break
        labels = hooks if labels is None else scratch.table(_through(labels, "label", hooks, n, F.col("node")))
        moved = _through(_through(edges, "a", hooks, n, F.col("b")), "b", hooks, n, F.col("a"))
        edges = scratch.table(moved.filter("a != b").distinct())
    return scratch.finish(labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label")))
