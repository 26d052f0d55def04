"""The register of queries and oracles, and the folder that queries write to."""

from __future__ import annotations

import tempfile
import uuid

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with its DuckDB oracle if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def shared_folder(spark) -> str:
    """The folder that all executors share; without one, only a local session gets a folder of its own."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root or tempfile.mkdtemp(prefix="docketry-")


def stored(spark, df, name: str):
    """df, written to the shared folder and read again: it is worked out once however often it is used."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
