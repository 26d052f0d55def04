"""Incremental builds by Structured Streaming: new documents in, keyed state out.

A micro-batch drops documents that repeat, skips those whose fingerprint is known, and replaces the state of the others, so
a batch that runs again changes nothing. State is Parquet in numbered versions with the version in the path, so a failed
batch leaves the last good one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in a batch."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*batch.columns))))
    return batch.withColumn("__n", place).filter("__n = 1").drop("__n")


def changed(batch: DataFrame, state: DataFrame | None, key: str) -> DataFrame:
    """Rows whose fingerprint isn't the state's (Z3)."""
    if state is None:
        return batch
    return batch.join(state.select(key, F.col("fingerprint").alias("__old")), key, "left").filter("__old is null or __old != fingerprint").drop("__old")


def merge(state: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    return new if state is None else state.join(new.select(key), key, "left_anti").unionByName(new)


class State:
    """A keyed table in versions under a folder; the version of a batch is written once, then listed by its id."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _paths(self) -> list[int]:
        jvm, path = self.spark.sparkContext._jvm, self.folder
        fs_path = jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))
        return sorted(int(p.getPath().getName()) for p in fs.listStatus(fs_path) if p.isDirectory() and p.getPath().getName().isdigit() and done(p))

    def read(self, before: int | None = None) -> DataFrame | None:
        found = [v for v in self._paths() if before is None or v < before]
        return self.spark.read.parquet(f"{self.folder}/{found[-1]}") if found else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{version}")


def incremental_build(stream: DataFrame, folder: str, key: str, order: str, build: Callable[[DataFrame], DataFrame], available_now: bool = True):
    """A query that keeps build(rows) of the newest row of every key under folder/state (Z2, Z3, G8). Stop it with query.stop().

    build gets rows with a fingerprint and returns one row for each key, the fingerprint included.
    """
    state = State(stream.sparkSession, f"{folder}/state")

    def step(batch: DataFrame, batch_id: int) -> None:
        old = state.read(before=batch_id)
        state.write(merge(old, build(changed(latest(batch, key, order), old, key)), key), batch_id)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
