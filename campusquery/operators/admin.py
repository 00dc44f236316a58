"""Commands of an administrator over the catalogue, many at a time: each gets a status, and the tables change as one.

A command table has ``pos``, which orders commands on one key, the key and the fields; in updates, ``given`` (array of
names) says which fields are set, perhaps to null. What is created or changed is marked as kept by hand
(``gestionado_por_admin``). Statuses are those of the interface: 201, 200 and 204 for done, 400, 404 and 422 for refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusquery.functions.text import blank, zfill

MARK = "gestionado_por_admin"
STATE = "Publicado en B.O.E."


def found(commands: DataFrame, table: DataFrame, key: str, named: str, pad: int = 0, raw: bool = True, to: str = "_key") -> DataFrame:
    """``commands`` with the stored key that ``named`` means, its padded form first, else (``raw``) as given; null where there is none."""
    for form, on in (("_padded", zfill(F.col(named), pad) if pad else None), ("_raw", F.col(named) if raw else None)):
        if on is not None:
            commands = commands.join(table.select(F.col(key).alias(form)), on == F.col(form), "left")
        else:
            commands = commands.withColumn(form, F.lit(None).cast("string"))
    return commands.withColumn(to, F.coalesce("_padded", "_raw")).drop("_padded", "_raw")


def names_blank(field: str) -> Column:
    return F.array_contains("given", field) & (F.trim(blank(F.col(field))) == "")


def repeated(key: str) -> Column:
    """Is a command on a key that an earlier one names, too."""
    return F.row_number().over(Window.partitionBy(key).orderBy("pos")) > 1


def inserted(table: DataFrame, accepted: DataFrame) -> DataFrame:
    """``table`` with the accepted rows in its columns; what they lack is null, and the mark is set."""
    kinds, mark = dict(table.dtypes), {MARK: F.lit(True)} if MARK in table.columns else {}
    rows = accepted.withColumns(mark)
    return table.unionByName(rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in table.columns]))


def changed(table: DataFrame, key: str, accepted: DataFrame, fields: list[str]) -> DataFrame:
    """``table`` after the accepted commands (``_key``), each field as the last command that sets it says."""
    last = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.array_contains("given", c), F.col("pos"))).alias(f"_{c}")
    news = accepted.groupBy("_key").agg(*[last(c) for c in fields])
    both = table.join(news, F.col(key) == F.col("_key"), "left")
    now = {c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)) for c in fields}
    mark = {MARK: F.col("_key").isNotNull() | F.coalesce(MARK, F.lit(False))} if MARK in table.columns else {}
    return both.withColumns(now | mark).select(*table.columns)


def create_universities(unis: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(universities, statuses): 201, or 400 where the padded code is there."""
    rows = found(commands.withColumn("codigo", zfill(F.col("codigo"), 3)), unis, "codigo", "codigo")
    rows = rows.withColumn("status", F.when(F.col("_key").isNotNull() | repeated("codigo"), 400).otherwise(201))
    return inserted(unis, rows.filter("status = 201")), rows.select("pos", "status")


def update_universities(unis: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(universities, statuses): 404 without such a university, 422 for a blank name, else 200. Commands name ``codigo``."""
    rows = found(commands, unis, "codigo", "codigo", 3)
    fields = [c for c in unis.columns if c in commands.columns and c != "codigo"]
    status = F.when(F.col("_key").isNull(), 404).when(names_blank("nombre"), 422).otherwise(200) if "nombre" in fields else F.when(F.col("_key").isNull(), 404).otherwise(200)
    rows = rows.withColumn("status", status)
    return changed(unis, "codigo", rows.filter("status = 200"), fields), rows.select("pos", "status")


def delete_universities(unis: DataFrame, degrees: DataFrame, plans: DataFrame, children: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(universities, degrees, plans, children, statuses): with a university go its degrees, their plans and what hangs on these."""
    rows = found(commands, unis, "codigo", "codigo", 3)
    rows = rows.withColumn("status", F.when(F.col("_key").isNull() | repeated("_key"), 404).otherwise(204))
    gone = rows.filter("status = 204").select(F.col("_key").alias("codigo"))
    lost = degrees.join(gone, F.col("universidad_codigo") == F.col("codigo"), "left_semi").select("codigo_estudio")
    rest = [t.join(lost, "codigo_estudio", "left_anti") for t in (degrees, plans, children)]
    return unis.join(gone, "codigo", "left_anti"), *rest, rows.select("pos", "status")


def create_degrees(degrees: DataFrame, unis: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(degrees, statuses): 201, or 400 where the code is there or the university isn't. A blank state means published."""
    rows = found(commands, degrees, "codigo_estudio", "codigo_estudio")
    rows = found(rows, unis, "codigo", "universidad_codigo", 3, to="_uni")
    able = F.col("_key").isNull() & F.col("_uni").isNotNull()
    rows = rows.withColumn("_able", able)
    first = F.col("_able") & (F.row_number().over(Window.partitionBy("codigo_estudio", "_able").orderBy("pos")) == 1)
    rows = rows.withColumns({"status": F.when(first, 201).otherwise(400), "universidad_codigo": F.col("_uni"), "estado": F.coalesce(F.nullif(F.col("estado"), F.lit("")), F.lit(STATE))})
    return inserted(degrees, rows.filter("status = 201")), rows.select("pos", "status")


def update_degrees(degrees: DataFrame, unis: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(degrees, statuses): 404 without such a degree, 422 for a blank title or university, 400 for an unknown university, else 200."""
    rows = found(commands, degrees, "codigo_estudio", "codigo_estudio")
    rows = found(rows, unis, "codigo", "universidad_codigo", 3, raw=False, to="_uni")
    moved = F.array_contains("given", "universidad_codigo")
    status = F.when(F.col("_key").isNull(), 404).when(names_blank("titulo") | names_blank("universidad_codigo"), 422).when(moved & F.col("_uni").isNull(), 400).otherwise(200)
    rows = rows.withColumns({"status": status, "universidad_codigo": F.col("_uni")})
    fields = [c for c in degrees.columns if c in commands.columns and c != "codigo_estudio"]
    return changed(degrees, "codigo_estudio", rows.filter("status = 200"), fields), rows.select("pos", "status")


def delete_degrees(degrees: DataFrame, plans: DataFrame, children: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(degrees, plans, children, statuses): 204, or 404 without such a degree."""
    rows = found(commands, degrees, "codigo_estudio", "codigo_estudio")
    rows = rows.withColumn("status", F.when(F.col("_key").isNull() | repeated("_key"), 404).otherwise(204))
    gone = rows.filter("status = 204").select(F.col("_key").alias("codigo_estudio"))
    return *[t.join(gone, "codigo_estudio", "left_anti") for t in (degrees, plans, children)], rows.select("pos", "status")


def create_courses(courses: DataFrame, plans: DataFrame, degrees: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(courses, plans, statuses): 201, or 404 without such a degree; a degree without a plan gets one of source "gestion_admin".

    ``courses`` have a number ``id``; new ones go on from the highest by ``pos``.
    """
    rows = found(commands, degrees, "codigo_estudio", "codigo_estudio")
    rows = rows.withColumn("status", F.when(F.col("_key").isNull(), 404).otherwise(201))
    done = rows.filter("status = 201")
    new_plans = done.select("codigo_estudio").distinct().join(plans, "codigo_estudio", "left_anti").withColumn("origen_fuente", F.lit("gestion_admin"))
    highest = courses.agg(F.max("id")).first()[0] or 0
    numbered = done.withColumn("id", F.lit(highest) + F.col("pos") + 1)
    return inserted(courses, numbered), inserted(plans, new_plans), rows.select("pos", "status")


def update_courses(courses: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(courses, statuses): 200, or 404 without a course of that ``id``."""
    rows = found(commands, courses, "id", "id").withColumn("status", F.when(F.col("_key").isNull(), 404).otherwise(200))
    fields = [c for c in courses.columns if c in commands.columns and c not in ("id", "codigo_estudio")]
    return changed(courses, "id", rows.filter("status = 200"), fields), rows.select("pos", "status")


def delete_courses(courses: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(courses, statuses): 204, or 404 without a course of that ``id``."""
    rows = found(commands, courses, "id", "id").withColumn("status", F.when(F.col("_key").isNull() | repeated("_key"), 404).otherwise(204))
    return courses.join(rows.filter("status = 204").select(F.col("_key").alias("id")), "id", "left_anti"), rows.select("pos", "status")
