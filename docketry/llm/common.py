"""Helpers shared by the operators: tables, folds, checkpoints and skew-safe lookup joins."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters other than ASCII white space is a word, in every contract.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a lookup table may be broadcast; beyond it the join is salted.
BROADCAST_ROWS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def fold(c: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(c.cast("string").cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docketry-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of an iteration, written to a folder of their own in the shared folder.

    Unlike a checkpoint, which keeps the estimated size of the plan that it cuts off, such a table has its files' size. Over
    the rounds of an iteration estimates multiply to numbers with millions of digits, which fill the driver's memory.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def finish(self, df: DataFrame) -> DataFrame:
        """df, checkpointed; then the folder is removed."""
        out = cut(df)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out


def lookup(big: DataFrame, small: DataFrame, keys: list[str], small_rows: int, spread: Column, salts: int = 32, nulls: bool = True) -> DataFrame:
    """big left-joined with small on keys (null equals null, unless nulls is false: one long key is cheapest then); small has one row for each key.

    small is broadcast while it has at most BROADCAST_ROWS rows. Beyond that both sides are salted by
    ``spread``, so a key with a third of big's rows still lands in many tasks.
    """
    if small_rows == 0:
        return big.select("*", *[F.lit(None).cast(t).alias(c) for c, t in small.dtypes if c not in keys])
    right = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) if nulls else F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    if small_rows <= BROADCAST_ROWS:
        right = F.broadcast(right)
    else:
        big = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        right = right.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append(F.col("__salt") == F.col("__rsalt"))
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return big.join(right, cond, "left").drop("__salt", "__rsalt", *[f"__k{i}" for i in range(len(keys))])


#: A key with more rows than this on the other side of a join is spread over several salts.
HOT_ROWS = 500


def fan_join(big: DataFrame, small: DataFrame, keys: list[str], fan: str, spread: Column, how: str = "inner") -> DataFrame:
    """big joined with small (one row for each key) where column ``fan`` says how many rows of big a key has.

    Keys with more than HOT_ROWS rows get a salt for every HOT_ROWS of them; their list, at most a HOT_ROWS-th of big's
    rows, goes through lookup(). All other keys join once.
    """
    hot = cut(small.filter(F.col(fan) > HOT_ROWS).select(*keys, F.ceil(F.col(fan) / HOT_ROWS).cast("int").alias("__n")))
    n = hot.count()
    if n == 0:
        return big.join(small.drop(fan), keys, how)
    marked = lookup(big, hot, keys, n, spread, nulls=False)
    marked = marked.withColumn("__s", F.when(F.col("__n") > 0, F.pmod(F.xxhash64(spread, F.lit(1)), F.col("__n")).cast("int")).otherwise(0)).drop("__n")
    salts = F.greatest(F.lit(1), F.ceil(F.col(fan) / HOT_ROWS)).cast("int")
    right = small.withColumn("__s", F.explode(F.when(F.col(fan) > HOT_ROWS, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))))
    return marked.join(right, [*keys, "__s"], how).drop("__s", fan)


def free(name: str, columns: list[str]) -> str:
    """name, with as many underscores as make it differ from all columns."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def keep_rows(docs: DataFrame, mask, **extra: Column) -> DataFrame:
    """The rows of docs for which mask(Arrow batch, extra columns by name) is true, all columns as they are; extra columns are worked out for mask only.

    Rows are filtered where they are read, so nothing is shuffled or joined.
    """
    names = docs.columns
    added = {k: free(f"extra_{k}", names) for k in extra}

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.select(names).filter(pa.array(mask(b, {k: b.column(v) for k, v in added.items()})))

    return docs.select("*", *[c.alias(added[k]) for k, c in extra.items()]).mapInArrow(run, docs.schema)
