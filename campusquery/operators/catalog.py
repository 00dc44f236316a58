"""Search, coverage, paging, top lists and usage analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusquery.functions import fixed
from campusquery.functions.text import blank, field_pattern, zfill


def public_first(kind: Column) -> Column:
    return F.when(F.lower(blank(kind)).rlike("p[úu]blic"), 0).otherwise(1)


def search(degrees: DataFrame, unis: DataFrame, plans: DataFrame | None = None, *, title: str | None = None, level: str | None = None, university: str | None = None,
           region: str | None = None, kind: str | None = None, field: str | None = None) -> DataFrame:
    """Degrees with their university under the filters given; patterns in the arguments are live. ``plans``: only degrees with a course in it."""
    out = degrees.join(plans, "codigo_estudio", "left_semi") if plans is not None else degrees
    out = out.join(unis, "u_key", "left")
    for value, name in ((title, "titulo"), (level, "nivel"), (region, "ccaa"), (kind, "tipo")):
        out = out.filter(F.col(name).ilike(f"%{value}%")) if value else out
    if university:
        out = out.filter(F.col("codigo") == zfill(F.lit(university), 3))
    pattern = field_pattern(field)
    return out.filter(F.col("titulo").rlike(f"(?iu){pattern}")) if pattern else out


def page(found: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of a search: public universities first, then by title and key."""
    return found.orderBy(public_first(F.col("tipo")), F.col("titulo").asc_nulls_last(), "codigo_estudio").offset(skip).limit(min(500, max(1, limit)))


def page_numbers(n_items: Column, size: int, number: int) -> list[Column]:
    """Pages (one at least), first and last item of page ``number``."""
    pages = F.greatest(F.lit(1), F.ceil(n_items / size))
    return [pages.alias("pages"), F.when(n_items == 0, 0).otherwise((number - 1) * size + 1).alias("first_item"), F.least(F.lit(number * size), n_items).alias("last_item")]


def lookup(unis: DataFrame, code: str) -> DataFrame:
    """The university of the padded code, else of the code as given."""
    padded = zfill(F.lit(code), 3)
    return unis.filter((F.col("codigo") == padded) | (F.col("codigo") == code)).orderBy(F.when(F.col("codigo") == padded, 0).otherwise(1)).limit(1)


def with_city(unis: DataFrame, *parts: str) -> DataFrame:
    """``unis`` with the struct ``place`` (city, lat, lng): the first city whose key or province the texts ``parts`` hold, else Madrid.

    The cities are one constant array, so the lookup is an expression and no join.
    """
    cities = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(p.lower()).alias("province"), F.lit(n).alias("city"), F.lit(a).alias("lat"), F.lit(b).alias("lng")) for k, a, b, p, n in fixed.CITIES])
    known = F.lower(F.concat_ws(" ", *[blank(F.col(c)) for c in parts]))
    hit = F.get(F.filter(cities, lambda c: F.col("_text").contains(c["key"]) | F.col("_text").contains(c["province"])), F.lit(0))
    madrid = next(k for k, c in enumerate(fixed.CITIES) if c[0] == "madrid")
    rows = unis.withColumn("_text", known).withColumn("place", F.coalesce(hit, F.get(cities, F.lit(madrid))))
    return rows.withColumn("place", F.struct(*[F.col(f"place.{c}") for c in ("city", "lat", "lng")])).drop("_text")


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, digits), F.lit(0.0))


def last_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The ``n`` last rows of each key; Spark keeps n per key and task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def top(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def latency(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean_ms"), F.round(F.count_if(F.col("event_type") == "error") * 100.0 / F.count("*"), 2).alias("error_pct")
    )


def failure_streaks(log: DataFrame, by: str, order: list[str], failed: Column, least: int = 10) -> DataFrame:
    """Runs of at least ``least`` failures in a row (circuit breaker): gaps and islands over the log of each key."""
    w = Window.partitionBy(by).orderBy(*order)
    runs = log.withColumn("_ok", F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter(failed).groupBy(by, "_ok").agg(F.count("*").alias("failures"), F.min(order[0]).alias("since")).filter(F.col("failures") >= least).drop("_ok")
