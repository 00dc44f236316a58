"""Figures of a crawl, of the interface and of its use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ratio

MB = 1024.0 * 1024.0
#: What the browser keeps of each log.
KEPT = {"searches": 200, "recent": 50, "latencies": 100, "views": 500}


def derived(totals: DataFrame) -> DataFrame:
    """Ratios of a crawl's totals (io_seconds, parse_seconds, degrees, pdfs, hits, pdf_bytes, json_bytes), with what stands for no denominator."""
    per = lambda a, b, digits, none: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), digits)).otherwise(none)
    hits = F.when(F.col("degrees") > 0, F.round(F.col("hits") / F.col("degrees") * 100, 2)).otherwise(0.0)
    grams = F.round((F.col("pdf_bytes") + F.col("json_bytes")) / MB * 0.05, 3)
    return totals.withColumns({
        "io_per_degree": per("io_seconds", "degrees", 3, 0.0), "parse_per_pdf": per("parse_seconds", "pdfs", 3, 0.0), "hit_pct": hits, "pdf_to_json": per("pdf_bytes", "json_bytes", 2, 1.0), "g_co2": grams,
    })


def co2_of_cpu(seconds: Column) -> Column:
    """Grams of CO2 of seconds of a processor."""
    return F.round(seconds * 0.0003 * 250, 4)


def newest(log: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` last rows of a log, the newest first."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)


def recent(log: DataFrame, key: str, limit: int, most: int, skip: int = 0) -> DataFrame:
    """The ``limit`` newest rows, by their number, of a list that the interface gives out, ``most`` at most, after ``skip`` others."""
    return log.orderBy(F.desc(key)).offset(max(0, skip)).limit(min(most, max(1, limit)))


def top_entries(counts: DataFrame, key: str, n: int = KEPT["views"]) -> DataFrame:
    """The entries of a map of counts (key, n) that are kept: the highest, the key decides ties."""
    return counts.orderBy(F.desc("n"), key).limit(n)


def conversion(events: DataFrame, order: list[str], search: Column, calculator: Column) -> DataFrame:
    """(views, searches, pct): views of the calculator among the newest events over the searches that are kept."""
    views = newest(events, order, KEPT["recent"]).agg(F.count_if(calculator).alias("views"))
    searches = newest(events.filter(search), order, KEPT["searches"]).agg(F.count("*").alias("searches"))
    both = views.withColumn("_k", F.lit(1)).join(searches.withColumn("_k", F.lit(1)), "_k")
    return both.select("views", "searches", ratio(F.col("views"), F.col("searches")).alias("pct"))


def api_stats(log: DataFrame, order: list[str], ms: str, failed: Column, shown: int = 15) -> DataFrame:
    """(n, mean_ms, error_pct, recent) of the latencies that are kept; ``recent``: the last ``shown``, the oldest first."""
    kept = newest(log, order, KEPT["latencies"]).withColumn("_failed", failed)
    items = F.array_sort(F.collect_list(F.struct(*order, ms)))
    share = lambda a, b: F.coalesce(F.floor(F.try_divide(a, b) + 0.5), F.lit(0)).cast("long")  # noqa: E731  (halves go up)
    out = kept.agg(F.count("*").alias("n"), share(F.sum(ms), F.count("*")).alias("mean_ms"), share(F.count_if("_failed") * 100.0, F.count("*")).alias("error_pct"), items.alias("_items"))
    return out.select("n", "mean_ms", "error_pct", F.transform(F.slice("_items", F.greatest(F.size("_items") - shown + 1, F.lit(1)), F.lit(shown)), lambda x: x[ms]).alias("recent"))


def checkpoint_sizes(state: DataFrame, *keys: str) -> DataFrame:
    """Sizes of the sets of checkpoints (lists and maps), with their ``keys``; one that is missing counts 0."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return state.select(
        *keys, size("processed_universities").alias("universities"), size("processed_degrees").alias("degrees"), size("non_study_plan_pdfs").alias("rejected"), size("failed_pdf_downloads").alias("failed")
    )


def merged(parts: DataFrame, counters: list[str]) -> DataFrame:
    """Sums of the counters that several workers report."""
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def health(spark: SparkSession) -> DataFrame:
    """What a caller that asks for the service's health gets."""
    return spark.createDataFrame([("ok", "campusquery")], "status string, service string")
