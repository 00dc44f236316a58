"""Sinks: tables that are replaced as a whole, logs that grow, state that is replaced by key, and files for people."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusquery.functions.text import blank


def file_system(spark: SparkSession, path: str):
    """(path, its file system) of the Hadoop library, which reaches every store that Spark does."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts the table at ``new`` in the place of that at ``path``; where that fails, the old one comes back.

    Between the two renames there is a moment without a table; a reader that meets it fails and may try again.
    """
    old = f"{path.rstrip('/')}.old.{uuid.uuid4().hex}"
    (target, fs), (staged, _), (aside, _) = (file_system(spark, p) for p in (path, new, old))
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"can't move {path}")
    if not fs.rename(staged, target):
        if fs.exists(aside):
            fs.rename(aside, target)
        raise OSError(f"can't put a table at {path}")
    fs.delete(aside, True)


def replace_all(tables: dict[str, DataFrame]) -> None:
    """Writes the tables (by path) beside their places and then swaps them in: they may read what they replace, and a failed write changes none."""
    mark = uuid.uuid4().hex
    staged = {path: f"{path.rstrip('/')}.new.{mark}" for path in tables}
    try:
        for path, df in tables.items():
            df.write.parquet(staged[path])
        for path, df in tables.items():
            swap(df.sparkSession, staged[path], path)
    finally:
        for path, df in tables.items():
            p, fs = file_system(df.sparkSession, staged[path])
            fs.delete(p, True)


def replace(df: DataFrame, path: str) -> None:
    """One table, as ``replace_all`` does."""
    replace_all({path: df})


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a log; writers don't disturb each other, as each adds files of its own."""
    df.write.mode("append").parquet(path)


def log_errors(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Adds (fase, id_entidad, url, motivo_fallo, detalles_excepcion) with the time to the error log."""
    names = "fase string, id_entidad string, url string, motivo_fallo string, detalles_excepcion string"
    df = spark.createDataFrame(rows, names)
    append(df.withColumns({"timestamp": F.current_timestamp(), "detalles_excepcion": blank(F.col("detalles_excepcion"))}), path)


def put(df: DataFrame, path: str, key: str, order: str | None = None) -> None:
    """State at ``path`` with the rows of ``df`` in place of those of their keys; of a repeated key the last by ``order`` counts."""
    spark = df.sparkSession
    if order:
        rest = [c for c in df.columns if c != key]
        df = df.groupBy(key).agg(*[F.max_by(F.struct(c), order)[c].alias(c) for c in rest]).select(*df.columns)
    p, fs = file_system(spark, path)
    if fs.exists(p):
        df = spark.read.parquet(path).join(df, key, "left_anti").select(*df.columns).unionByName(df)
    replace(df, path)


def sheet_lines(df: DataFrame) -> DataFrame:
    """(value): lines of a sheet, cells quoted and none that a spreadsheet would run as a formula."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return df.select(F.concat_ws(",", *[cell(blank(F.col(f"`{c}`").cast("string"))) for c in df.columns]).alias("value"))


def write_sheet(df: DataFrame, path: str) -> None:
    """One CSV file at ``path`` for people: a byte order mark, a header as it is, and quoted, guarded cells.

    The rows go through one task, which spills.
    """
    head = df.sparkSession.createDataFrame([("\ufeff" + ",".join(df.columns), 0)], "value string, part int")
    write_single(in_one(head.unionByName(sheet_lines(df).withColumn("part", F.lit(1)))).select("value"), path)


def in_one(rows: DataFrame) -> DataFrame:
    """Rows in one partition, by ``part`` and as they came, with their number ``_k``."""
    lined = rows.withColumn("_at", F.monotonically_increasing_id()).repartition(1).sortWithinPartitions("part", "_at")
    return lined.withColumn("_k", F.monotonically_increasing_id())


def pretty(df: DataFrame) -> DataFrame:
    """(value): each row as JSON, indented by two; fields that are null are there."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write_pretty(df: DataFrame, path: str) -> None:
    """One JSON file at ``path`` for people: a list of the rows, indented. The rows go through one task, which spills."""
    end = df.sparkSession.createDataFrame([(None, 1)], "value string, part int")
    rows = in_one(pretty(df).withColumn("part", F.lit(0)).unionByName(end))
    opened = F.when(F.col("_k") == 0, F.lit("[\n")).otherwise(F.lit(",\n"))
    closed = F.when(F.col("_k") == 0, F.lit("[]")).otherwise(F.lit("]"))
    write_single(rows.select(F.when(F.col("part") == 1, closed).otherwise(F.concat(opened, "value")).alias("value")), path)


def write_single(lines: DataFrame, path: str) -> None:
    """Lines as one file at ``path``, in place of what is there; ``lines`` has one partition."""
    spark, beside = lines.sparkSession, f"{path}.new.{uuid.uuid4().hex}"
    lines.write.text(beside)
    (target, fs), (staged, _) = file_system(spark, path), file_system(spark, beside)
    try:
        (part,) = [f.getPath() for f in fs.listStatus(staged) if f.getPath().getName().startswith("part-")]
        fs.delete(target, True)
        if not fs.rename(part, target):
            raise OSError(f"can't put a file at {path}")
    finally:
        fs.delete(staged, True)


@contextmanager
def sole_writer(spark: SparkSession, path: str, stale: float = 6 * 3600) -> Iterator[None]:
    """Holds the lock file ``path`` while a load runs; raises where another holds it. One older than ``stale`` seconds was left by a writer that died."""
    p, fs = file_system(spark, path)
    if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > stale:
        fs.delete(p, False)
    if not fs.createNewFile(p):  # atomic
        raise BlockingIOError(f"another load holds {path}")
    try:
        yield
    finally:
        fs.delete(p, False)
