"""Upserts, pruning, cascades and state tables, as joins that make the new table; and order-aware merging of courses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusquery.functions.text import first_number, meaningful


def given(c: Column, kind: str) -> Column:
    """The value, or null where it counts as not given: empty text or 0."""
    return F.nullif(c, F.lit("" if kind == "string" else 0).cast(kind))


def insert_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))


def folded(new: DataFrame, key: str, merge: list[str], overwrite: list[str], order: str) -> DataFrame:
    """One row a key: later ones (by ``order``, unique in a key) merge into the first, from which the other columns are."""
    kinds = dict(new.dtypes)

    def last(c: str) -> Column:
        own = given(F.col(c), kinds[c])
        return F.coalesce(F.max_by(own, F.when(own.isNotNull(), F.col(order))), F.min_by(c, order))

    rest = [c for c in new.columns if c not in (key, order)]
    return new.groupBy(key).agg(*[(last(c) if c in merge else F.max_by(c, order) if c in overwrite else F.min_by(c, order)).alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: str, merge: list[str], overwrite: list[str] = (), protected: str | None = None, order: str | None = None) -> DataFrame:
    """``old`` (unique keys) with the rows of ``new``: ``merge`` columns keep what is stored where nothing
    is given, ``overwrite`` columns take even null; rows where ``protected`` holds stay, and other columns do.

    With ``order``, keys of ``new`` may repeat and their rows come in that order; without, they are unique.
    """
    kinds = dict(old.dtypes)
    new = folded(new, key, list(merge), list(overwrite), order) if order else new
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    keep = F.col("_new").isNull() | (F.coalesce(F.col(f"o.{protected}"), F.lit(False)) if protected else F.lit(False))
    cols = []
    for c in old.columns:
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None).cast(kinds[c])
        changed = F.coalesce(given(theirs, kinds[c]), mine) if c in merge else theirs if c in overwrite else mine
        cols.append(F.when(F.col("_old").isNull(), theirs).when(keep, mine).otherwise(changed).alias(c))
    return both.select(*cols)


def prune(old: DataFrame, active: DataFrame, key: str, least: int = 100, protected: str | None = None) -> DataFrame:
    """Without the keys that aren't active; untouched where fewer than ``least`` are, which hints at a failed crawl."""
    if active.select(key).distinct().limit(least).count() < least:
        return old
    gone = old.join(active, key, "left_anti")
    if protected:
        gone = gone.filter(~F.coalesce(F.col(protected), F.lit(False)))
    return old.join(gone, key, "left_anti")


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def new_errors(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` whose keys are unseen; nulls equal nulls. With ``order``, of those that repeat in ``new`` the first alone."""
    if order:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    seen = old.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return new.join(seen, same, "left_anti")


def up_to_date(url: Column, date: Column, seen_url: Column, seen_date: Column, known: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(url) & blank(date), True).when(~known, False).otherwise(F.coalesce(url == seen_url, F.lit(False)) | F.coalesce(date == seen_date, F.lit(False)))


def new_reports(old: DataFrame, new: DataFrame, at: str, order: str) -> DataFrame:
    """Reports of ``new`` of a time that is unseen, the first of each; those without a time all enter."""
    timed = new.filter(F.col(at).isNotNull())
    return new.filter(F.col(at).isNull()).unionByName(new_errors(old, timed, [at], order))


def record(state: DataFrame, new: DataFrame, key: str, keep: list[str], stamp: str, order: str) -> DataFrame:
    """State with the records of ``new`` in their order: ``keep`` columns stay where the new value says nothing, ``stamp`` is the last one's."""
    new = new.filter(meaningful(F.col(key)))
    told = lambda c: F.max_by(c, F.when(meaningful(F.col(c)), F.col(order))).alias(f"_{c}")
    last = new.groupBy(F.col(key).alias("_key")).agg(*[told(c) for c in keep], F.max_by(stamp, order).alias(f"_{stamp}"))
    both = state.join(last, F.col(key) == F.col("_key"), "full_outer")
    kept = [F.coalesce(f"_{c}", c).alias(c) for c in keep]
    return both.select(F.coalesce(key, "_key").alias(key), *kept, F.when(F.col("_key").isNotNull(), F.col(f"_{stamp}")).otherwise(F.col(stamp)).alias(stamp))


def remember(cache: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """A negative cache (key) with the keys of ``seen`` that say something, each once."""
    return cache.select(key).union(seen.filter(meaningful(F.col(key))).select(key)).distinct()


def unrejected(rows: DataFrame, caches: dict[str, DataFrame]) -> DataFrame:
    """Rows of which no column is in its negative cache; ``caches`` has one (a single column) by the column it is for."""
    for c, cache in caches.items():
        known = cache.toDF(f"_{c}")
        rows = rows.join(known, F.col(c) == F.col(f"_{c}"), "left_anti")
    return rows


def incomplete(degrees: DataFrame, plans: DataFrame, key: str, status: str = "status", done: tuple[str, ...] = ("completo", "doctorado_estructural")) -> DataFrame:
    """Degrees without a complete plan, which the second part of a crawl looks for; ``plans`` has a row a plan with its status."""
    return degrees.join(plans.filter(F.col(status).isin(*done)).select(key), key, "left_anti")


def keep_corrected(new: DataFrame, old: DataFrame, key: str, value: str, flag: str) -> DataFrame:
    """``new`` with the ``value`` of ``old`` where that was corrected (``flag``), and so marked."""
    fixed = old.filter(F.coalesce(F.col(flag), F.lit(False))).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    both = new.join(fixed, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    had = F.coalesce(F.col(flag), F.lit(False)) if flag in new.columns else F.lit(False)
    return both.withColumns({value: F.when(hit, F.col("_value")).otherwise(F.col(value)), flag: hit | had}).drop("_key", "_value")


def first_wins(old: Column, new: Column) -> Column:
    """Two maps as one; a key of both keeps the value of ``old``."""
    return F.map_concat(old, F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k)))


def written(requests: Column, seconds: float = 30) -> Column:
    """Which of the requests to save (array of struct at, force, in order; times in seconds) are carried out: forced ones, and others
    ``seconds`` after the last one carried out."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        go = x["force"] | acc["last"].isNull() | (x["at"] - acc["last"] >= seconds)
        return F.struct(F.when(go, x["at"].cast("double")).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(go)).alias("out"))

    return F.aggregate(requests, start, step, lambda acc: acc["out"])


def breaker(log: DataFrame, by: str, order: list[str], failed: Column, missing: Column, threshold: int = 10, pauses: int = 3) -> DataFrame:
    """(by, trip, action, order ...) of a circuit breaker over a log: each ``threshold`` failures in a row pause it, the ``pauses``-th time it skips the rest.

    Answers that say a page is ``missing`` count for nothing. One row of a key's log is at work at a time, spilling.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.filter(~missing).withColumn("_failed", failed)
    rows = rows.withColumn("_run", F.sum((~F.col("_failed")).cast("int")).over(w)).filter("_failed")
    own = Window.partitionBy(by, "_run").orderBy(*order)
    trips = rows.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") % threshold == 0)
    trips = trips.withColumn("trip", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("trip") <= pauses)
    return trips.select(by, "trip", F.when(F.col("trip") < pauses, "pausa").otherwise("salto").alias("action"), *order)


def year_credits(courses: DataFrame, plan: str) -> DataFrame:
    """(plan, curso, ects): credits of each year that courses cover; a course without credits counts 6."""
    n = F.coalesce(F.nullif(first_number(F.col("ects").cast("string")), F.lit(0.0)), F.lit(6.0))
    return courses.groupBy(plan, F.trim(F.coalesce("curso", F.lit(""))).alias("curso")).agg(F.sum(n.cast("decimal(12,2)")).cast("double").alias("ects"))


def long_words(name: Column) -> Column:
    """Words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(name, F.lit(r"(?U)\w{4,}"), F.lit(0)))


def renamed(name: Column, seen: Column) -> Column:
    """Does a name (its key) share all but one of its long words, two at least, with one of the ``seen`` names (array)."""
    own = long_words(name)
    return (F.size(own) > 0) & F.exists(seen, lambda s: F.size(F.array_intersect(own, long_words(s))) >= F.greatest(F.lit(2), F.size(own) - 1))


def latest_versions(degrees: DataFrame, by: list[str], code: str, order: str) -> DataFrame:
    """One row per key: the highest numeric code, the first on ties; a first row without a numeric code stays."""
    w = Window.partitionBy(*by)
    number = F.col(code).try_cast("bigint")
    first = F.first(F.struct(number.alias("v"))).over(w.orderBy(order))
    place = F.row_number().over(w.orderBy(F.when(first["v"].isNull(), F.lit(0)).otherwise(1), F.when(first["v"].isNotNull(), number).desc_nulls_last(), order))
    return degrees.withColumn("_place", place).filter("_place = 1").drop("_place")


def first_with_fill(courses: DataFrame, plan: str, name_key: str, order: list[str], fill: list[str], kind: str, default: str = "OB") -> DataFrame:
    """The first course of each name in a plan; later ones fill its blanks, and its type where that is the default."""
    w = Window.partitionBy(plan, name_key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.first(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(w), F.lit("")) for c in fill}
    filled[kind] = F.coalesce(F.first(F.nullif(F.col(kind), F.lit(default)), ignorenulls=True).over(w), F.lit(default))
    place = F.row_number().over(Window.partitionBy(plan, name_key).orderBy(*order))
    return courses.withColumns(filled | {"_place": place}).filter("_place = 1").drop("_place")


def carry_forward(rows: DataFrame, doc: str, order: list[str], header: str, to: str) -> DataFrame:
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(F.col(header), ignorenulls=True).over(w))


def stitch(rows: DataFrame, doc: str, order: list[str], text: str, fragment: Column) -> DataFrame:
    """(doc, island, text): rows that are fragments joined to the row before; islands count the others."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumns({"island": F.sum((~fragment).cast("int")).over(w), "_o": F.struct(*order)})
    parts = F.array_sort(F.collect_list(F.struct("_o", F.col(text).alias("t"))))
    return numbered.groupBy(doc, "island").agg(F.concat_ws(" ", F.transform(parts, lambda x: x["t"])).alias(text))


def preselect(items: Column, limit: float = 60.0) -> Column:
    """Indices of the items (array of struct i, ects) taken in order while the sum stays within ``limit``; one too big is skipped."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("t"))
    step = lambda acc, x: F.when(
        acc["s"] + x["ects"] <= limit, F.struct((acc["s"] + x["ects"]).alias("s"), F.concat(acc["t"], F.array(x["i"])).alias("t"))
    ).otherwise(acc)
    return F.aggregate(items, start, step, lambda acc: acc["t"])


def preselect_plan(items: Column, limit: float = 60.0) -> Column:
    """Indices of the items (array of struct i, ects, caracter, curso) selected at first: those whose year holds a "1" where any
    item has a year, else basic, compulsory and untyped ones in order while their sum stays within ``limit``. Without credits an item counts 6."""
    year = lambda x: F.coalesce(x["curso"], F.lit(""))
    kind = lambda x: F.coalesce(x["caracter"], F.lit("")).isin("FB", "OB", "")
    ects = lambda x: F.coalesce(F.nullif(x["ects"], F.lit(0).cast("double")), F.lit(6.0))
    first = F.transform(F.filter(items, lambda x: F.contains(year(x), F.lit("1"))), lambda x: x["i"])
    flat = F.transform(F.filter(items, kind), lambda x: F.struct(x["i"].alias("i"), ects(x).alias("ects")))
    return F.when(F.exists(items, lambda x: year(x).rlike(r"(?U)\S")), first).otherwise(preselect(flat, limit))


def merge_plans(documents: list[dict], required: float, rejected: frozenset | set = frozenset()) -> dict:
    """Courses, credit summary and status of one degree from its documents, newest first; a fold over few rows.

    A document is a dict of ``courses``, ``summary`` and ``hash``. One whose hash is in ``rejected`` is passed over; one without courses and
    summary is returned in ``rejected``. Of a summary's keys the first value stays. An older document adds a course only
    where its year has under 55 credits, its name is unseen and no seen name shares all but one of its long words; older
    are all but the first that was fetched. It ends once the credits are complete.
    """
    key = lambda n: re.sub(r"\s*\(.*?\)", "", n or "").strip().lower()
    long = lambda n: set(re.findall(r"\w{4,}", n))
    number = lambda x: float(m[0].replace(",", ".")) if (m := re.search(r"\d+(?:[.,]\d+)?", x or "")) else None
    taken, seen, summary, useless, used = [], {}, {}, [], 0
    for k, doc in enumerate(documents):
        if doc.get("hash") in rejected:
            continue
        if not doc["courses"] and not doc.get("summary"):
            useless.append(doc.get("hash"))
            continue
        used += 1
        summary = {**(doc.get("summary") or {}), **summary}
        years: dict = {}
        for c in taken:
            years[(c.get("curso") or "").strip()] = years.get((c.get("curso") or "").strip(), 0) + (number(c.get("ects")) or 6)
        for c in doc["courses"]:
            name, year = key(c["nombre"]), (c.get("curso") or "").strip()
            own = long(name)
            full = k and year and years.get(year, 0) >= 55
            clash = k and own and any(len(own & other) >= max(2, len(own) - 1) for other in seen.values())
            if name and name not in seen and not full and not clash:
                seen[name] = own
                taken.append(c)
        if taken and sum(number(c.get("ects")) or 0 for c in taken) >= required:
            break
    return {"courses": taken, "summary": summary, "rejected": useless, "documents": used}
