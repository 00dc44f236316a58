"""The directory of universities and its lists: filters, orders and pages as the pages of the site show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusquery.functions.text import blank, has_any

from .catalog import public_first


def held(c: Column, wanted: str) -> Column:
    """Does a text hold another, whatever the case."""
    return F.contains(F.lower(blank(c)), F.lit(wanted.lower()))


def directory(unis: DataFrame, query: str = "", kind: str = "todos", region: str = "todas") -> DataFrame:
    """Universities whose name, municipality and province together hold ``query``, of a type and a region; signs have no meaning in ``query``."""
    out = unis.filter(held(F.concat_ws(" ", *[blank(F.col(c)) for c in ("nombre", "municipio", "provincia")]), query)) if query else unis
    out = out.filter(F.contains(F.lower(blank(F.col("tipo"))), F.lit(kind))) if kind != "todos" else out
    return out.filter(held(F.col("ccaa"), region)) if region != "todas" else out


def by_name(unis: DataFrame) -> DataFrame:
    """Public universities first, then by name as Spanish sorts it; the code decides ties."""
    return unis.orderBy(public_first(F.col("tipo")), F.collate(blank(F.col("nombre")), "es"), "codigo")


def directory_page(unis: DataFrame, number: int = 1, size: int = 12, **filters: str) -> DataFrame:
    """Page ``number`` of the directory."""
    return by_name(directory(unis, **filters)).offset((number - 1) * size).limit(size)


def universities_page(unis: DataFrame, skip: int = 0, limit: int = 100, *, kind: str | None = None, region: str | None = None, name: str | None = None) -> DataFrame:
    """The list of universities under the filters given (patterns are live), public ones first, then by name and code; 1 to 500 rows."""
    out = unis
    for value, column in ((kind, "tipo"), (region, "ccaa"), (name, "nombre")):
        out = out.filter(F.col(column).ilike(f"%{value}%")) if value else out
    return out.orderBy(public_first(F.col("tipo")), F.col("nombre").asc_nulls_last(), "codigo").offset(max(0, skip)).limit(min(500, max(1, limit)))


def university_pill(kind: Column, pill: str) -> Column:
    """Does a university's type pass the pill; an unknown pill passes all."""
    t = F.lower(blank(kind))
    return {"Pública": has_any(t, ["pública", "publica"]), "Privada": has_any(t, ["privada"])}.get(pill, F.lit(True))


def degree_pill(level: Column, title: Column, pill: str) -> Column:
    """Does a degree pass the pill; an unknown pill passes all."""
    n, t = F.lower(blank(level)), F.lower(blank(title))
    return {
        "Grado": has_any(n, ["grado"]), "Máster": has_any(n, ["máster", "master"]), "Doctorado": has_any(n, ["doctor", "99/2011"]) | has_any(t, ["doctor"]),
    }.get(pill, F.lit(True))


def incidents(log: DataFrame, term: str, fields: tuple[str, ...] = ("fase", "id_entidad", "motivo_fallo", "url")) -> DataFrame:
    """Rows of the error log in which one of four fields holds ``term``; a blank term passes all."""
    found = F.lit(False)
    for c in fields:
        found = found | held(F.col(c), term)
    return log.filter(found) if term else log


def courses_in_order(courses: DataFrame, plan: str) -> DataFrame:
    """Courses with their ``place`` in their plan's list: by year, then name, both as text, the ones without last; their ordinal decides ties."""
    order = [F.col("curso").asc_nulls_last(), F.col("nombre").asc_nulls_last(), F.col("orden")]
    return courses.withColumn("place", F.row_number().over(Window.partitionBy(plan).orderBy(*order)))


def last_first(rows: DataFrame, by: str, order: str, limit: int | None = None) -> DataFrame:
    """Rows of each key with their ``place`` in reverse of their order, and only the first ``limit`` of these where one is set."""
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))))
    return out.filter(F.col("place") <= limit) if limit else out


def badge(level: Column, title: Column) -> Column:
    """The level that a card shows."""
    n, t = F.lower(blank(level)), F.lower(blank(title))
    return F.when(has_any(n, ["doctor", "99/2011"]) | t.contains("doctor"), "Doctorado").when(has_any(n, ["máster", "master"]), "Máster").otherwise("Grado Oficial")


def fading(state: Column) -> Column:
    """Is a degree being phased out, by its state."""
    return has_any(F.lower(blank(state)), ["extin", "suprim", "no vigente"])


def specialised(topic: Column, module: Column) -> Column:
    """(label, marked): the topic or else the module of a course, and whether it names a specialisation."""
    label = F.coalesce(F.nullif(topic, F.lit("")), F.nullif(module, F.lit("")))
    return F.struct(F.coalesce(label, F.lit("-")).alias("label"), F.coalesce(label.rlike("(?i)menci|itinerari|especialid"), F.lit(False)).alias("marked"))
