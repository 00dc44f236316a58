"""Working tables in the shared folder, keys that hold nulls, and ranks over range partitions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters (Java and RE2 syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a lookup side up to which it is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 10_000
BATCH_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def local_folder(application: str) -> str:
    """A folder of this machine for one local application."""
    return tempfile.mkdtemp(prefix="campusquery-")


def lower_batches(spark: SparkSession) -> None:
    """For frames that run after their function has returned; lasts."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXT_ROWS:  # 0 is no limit
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of TEXT_ROWS rows at most: with long texts the default of 10000 makes buffers of hundreds of MB on both sides."""
    before = spark.conf.get(BATCH_ROWS)
    lower_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


class Work:
    """Tables that cut the lineage: Parquet below ``spark.checkpoint.dir``, which all executors see.

    A lost executor costs only the stage at work. Where the setting is absent, a local master (tests, a bench)
    gets a temporary folder of its machine; on a cluster, where executors could not see that, it raises.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = local_folder(spark.sparkContext.applicationId)
        self.spark, self.root, self.made = spark, f"{base.rstrip('/')}/work-{uuid.uuid4().hex}", []

    def part(self) -> Work:
        """Tables of one step, which may end with a ``last`` of its own."""
        own = Work(self.spark)
        own.root = self.path("part")
        return own

    def path(self, name: str) -> str:
        """A new path below this object's folder; a name may be used again."""
        self.made.append(f"{self.root}/{len(self.made)}-{name}")
        return self.made[-1]

    def save(self, df: DataFrame, name: str, last: bool = False) -> DataFrame:
        """``df`` written and read again; with ``last``, nothing else of this object is read any more and is deleted."""
        path = self.path(name)
        with small_batches(self.spark):
            df.write.parquet(path)
        if last:
            self.drop(*[x for x in self.made if x != path])
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *paths: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for x in paths:
            path = jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)


def unit_interval(*parts: Column | str) -> Column:
    """A number in (0, 1) that the values of ``parts`` decide."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows spread over range partitions and sorted, with ``_pid`` and ``_idx`` (place in the partition).

    The result must be saved before use: it is a snapshot of one physical layout.
    """
    lined = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return lined.withColumn("_at", at).select(
        "*", F.shiftright("_at", 33).cast("int").alias("_pid"), F.col("_at").bitwiseAND(2**33 - 1).alias("_idx")
    ).drop("_at")


def ranked(work: Work, df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``_rank``, gapless from 0 within ``by`` (not null) in ``order``, without a task that holds a group.

    Rows go to range partitions of (by, order); every partition counts its rows per group, and the
    counts before it give its offset. The offset table has a row per partition and group border, so it
    is broadcast only where groups are few (checked); otherwise Spark chooses the join.
    """
    lined = work.save(in_order(df, by + order), name)
    parts = lined.groupBy("_pid", *by).agg(F.min("_idx").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    parts = work.save(parts, f"{name}_parts")
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    out = lined.join(parts, ["_pid", *by])
    return out.withColumn("_rank", F.col("_idx") - F.col("_first") + F.col("_skip")).drop("_pid", "_idx", "_first", "_skip")
