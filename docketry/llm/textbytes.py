"""Views of Arrow string columns as bytes, bounded samples of labelled rows to start a training from, and its pass over all rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Parts in which the ids of a label are ranked before they are ranked together.
SPLITS = 64
#: Values of a vector that travel in one row, and tasks a core that learn apart: small files are learnt from together.
SLICE, TASKS = 1 << 14, 4
#: Texts that a task holds as strings.
AT_ONCE = 64
#: Words of 64 bits in a Bloom filter of ids, and the bits that an id sets in its word.
FILTER_WORDS, FILTER_BITS = 1 << 19, 3


def as_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string array end to end as uint8, and the n + 1 offsets; a null is empty. Nothing is copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, y, text) of at most per_label documents for each value y of labels[label], those with the least hash of doc_id.

    One scan ranks ids within their label (each task keeps its own per_label least ones only). A doc_id with several
    texts gives the least, so the size is bounded by per_label and the number of label values.
    """
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("y"))
    labels = labels.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64(F.lit(11), "doc_id"))
    for part in (["y", F.pmod("h", F.lit(SPLITS))], ["y"]):  # each label in parts first, so that no task gets all tasks' ids of one label
        place = F.row_number().over(Window.partitionBy(*part).orderBy("h", "doc_id"))
        labels = labels.withColumn("place", place).filter(F.col("place") <= per_label).drop("place")
    chosen = labels.select("doc_id", "y")
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).filter("text is not null")


def trained(sample: DataFrame, train) -> dict:
    """train([(text, y), ...]) of a labelled sample, whose size labelled_sample bounds, on the driver."""
    rows = sorted(sample.collect(), key=lambda r: (str(r["y"]), r["doc_id"], r["text"]))
    return train([(r["text"], r["y"]) for r in rows])


def likely(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts (doc_id, text) whose doc_id is in ids, and a few others, without a shuffle of texts.

    A Bloom filter is broadcast: at most FILTER_WORDS rows, however many ids there are. With more ids more of the other rows
    stay (3 % of them at four million ids, 22 % at ten million, by a simulation), but never is a row of ids lost.
    """
    h = "xxhash64(29, cast(doc_id as string))"
    bits = " | ".join(f"shiftleft(1L, cast(shiftright({h}, {32 + 6 * k}) & 63 as int))" for k in range(FILTER_BITS))
    word, mask = F.expr(f"cast(pmod({h}, {FILTER_WORDS}) as int)").alias("word"), F.expr(bits).alias("mask")
    bloom = ids.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("all"))
    return texts.select("doc_id", "text", word, mask).join(F.broadcast(bloom), "word").filter("(`all` & mask) = mask").select("doc_id", "text")


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(text, y) of every row of docs whose text isn't null and whose doc_id has a value of labels[label], the greatest of several.

    Texts without a label are left out where they are read, but for few, and the join then decides."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    y = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    return likely(docs.filter("text is not null").select("doc_id", "text"), known).join(y, "doc_id").select("text", "y")


def averaged(rows: DataFrame, learn) -> tuple[int, np.ndarray]:
    """All rows (text, y) learnt from: each task gives learn's vector of its own rows, and tasks weigh by their number of rows.

    learn takes an iterator of (text, y) and gives their number and a vector. Vectors are added in slices in the executors; the
    driver gets one vector. The mean depends on how rows are dealt to tasks, not on the order in which tasks end.
    """
    def run(batches):
        few = (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE))
        n, v = learn((t, y) for b in few for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True))
        if n:
            part = TaskContext.get().partitionId()
            v = v.astype(np.float32)
            for k, at in enumerate(range(0, len(v), SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part]), pa.array([n]), pa.array([zlib.compress(v[at : at + SLICE].tobytes(), 1)], pa.binary())], names=["k", "part", "n", "v"])

    def add(table):
        each = sorted(zip(table.column("part").to_pylist(), table.column("n").to_pylist(), table.column("v").to_pylist(), strict=True))
        total = sum(np.frombuffer(zlib.decompress(v), np.float32).astype(np.float64) * n for _, n, v in each)
        return pa.table({"k": table.column("k")[:1], "n": pa.array([sum(n for _, n, _ in each)]), "v": pa.array([total.tobytes()], pa.binary())})

    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.coalesce(tasks).mapInArrow(run, "k long, part long, n long, v binary")
    got = sorted(parts.groupBy("k").applyInArrow(add, "k long, n long, v binary").collect(), key=lambda r: r["k"])
    n = got[0]["n"] if got else 0
    return n, np.concatenate([np.frombuffer(r["v"], np.float64) for r in got]) / n if got else np.zeros(0)
