"""The load of plan files into the catalogue, and prices of degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusquery.functions import fixed
from campusquery.functions.dates import plain_date
from campusquery.functions.text import blank, zfill

from .admin import MARK
from .state import given, insert_only, new_errors, new_reports, prune, upsert

PRICES = {"precio_credito_ects": "double", "precio_credito_2": "double", "precio_credito_3": "double", "precio_credito_4": "double", "precio_estimado_anual": "double", "fuente_precio": "string"}
META = ("boe_url", "boe_fecha", "origen_fuente", "pdf_sha256")


def last_given(c: str, kind: str) -> Column:
    """The last value of a key's files that says something; empty text and 0 don't."""
    own = given(F.col(c), kind)
    return F.max_by(own, F.when(own.isNotNull(), F.col("file")))


def per_degree(files: DataFrame) -> DataFrame:
    """One row a degree: values of its first file (``f_``), the last that say something (``l_``); files without a code are left out."""
    files = files.filter(F.coalesce(F.col("codigo_estudio").cast("string"), F.lit("")) != "").withColumn("boe_fecha", plain_date(F.col("boe_fecha")))
    first = [F.min_by(c, "file").alias(f"f_{c}") for c in ("universidad_codigo", "universidad_nombre", "tipo", "titulo", "nivel_academico", "estado", *PRICES)]
    last = [last_given(c, kind).alias(f"l_{c}") for c, kind in (PRICES | {"boe_url": "string", "origen_fuente": "string", "pdf_sha256": "string"}).items()]
    date = F.max_by("boe_fecha", F.when(F.col("boe_fecha").isNotNull(), F.col("file"))).alias("l_boe_fecha")
    return files.groupBy("codigo_estudio").agg(*first, *last, date)


def load_plans(files: DataFrame, unis: DataFrame, degrees: DataFrame, plans: DataFrame, summaries: DataFrame, courses: DataFrame) -> dict[str, DataFrame]:
    """The five tables after the plan files (``sources.files.plan_files``), which come in the order of their names.

    A degree that is missing is made, and its university, if that is missing, too; prices and what a plan says of itself
    replace what is stored where they say something, also for degrees kept by hand. Summaries and courses of a plan that
    was there are replaced by those of its files. A university's padded code is the one that its new degree carries.
    """
    one = per_degree(files)
    code = zfill(F.coalesce(F.nullif(F.col("f_universidad_codigo"), F.lit("")), F.lit("000")), 3)
    fresh = one.join(degrees.select("codigo_estudio"), "codigo_estudio", "left_anti").withColumn("codigo", code)
    lacking = fresh.groupBy("codigo").agg(F.min_by(F.struct("f_universidad_nombre", "f_tipo"), "codigo_estudio").alias("x")).join(unis.select("codigo"), "codigo", "left_anti")
    new_unis = lacking.select("codigo", F.coalesce("x.f_universidad_nombre", F.concat(F.lit("Universidad "), "codigo")).alias("nombre"), F.coalesce("x.f_tipo", F.lit("Desconocido")).alias("tipo"))

    new_degrees = fresh.select(
        "codigo_estudio", F.coalesce("f_titulo", F.concat(F.lit("Estudio "), "codigo_estudio")).alias("titulo"), F.coalesce("f_nivel_academico", F.lit("")).alias("nivel_academico"),
        F.col("f_estado").alias("estado"), F.col("codigo").alias("universidad_codigo"), *[F.coalesce(f"l_{c}", f"f_{c}").alias(c) for c in PRICES],
    )
    news = one.select("codigo_estudio", *[f"l_{c}" for c in PRICES])
    priced = degrees.join(news, "codigo_estudio", "left").withColumns({c: F.coalesce(f"l_{c}", c) for c in PRICES}).select(*degrees.columns)

    meta = one.select(F.col("codigo_estudio").alias("_key"), *[f"l_{c}" for c in META])
    both = plans.join(meta, F.col("codigo_estudio") == F.col("_key"), "full_outer")
    out_plans = both.select(F.coalesce("codigo_estudio", "_key").alias("codigo_estudio"), *[F.coalesce(f"l_{c}", c).alias(c) for c in META])

    touched = one.select("codigo_estudio")
    entries, elements = children(files)
    return {
        "universities": with_rows(unis, new_unis), "degrees": with_rows(priced, new_degrees), "plans": out_plans,
        "summaries": with_rows(summaries.join(touched, "codigo_estudio", "left_anti"), entries), "courses": with_rows(courses.join(touched, "codigo_estudio", "left_anti"), elements),
    }


def children(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (codigo_estudio, tipo_credito, cantidad_creditos) of the files' summaries, and rows of their courses with ``file`` and ``orden``."""
    known = files.filter(F.coalesce(F.col("codigo_estudio").cast("string"), F.lit("")) != "")
    entries = known.select("codigo_estudio", F.explode("plan_estudios.resumen_creditos").alias("tipo_credito", "cantidad_creditos"))
    rows = known.select("codigo_estudio", "file", F.posexplode("plan_estudios.elementos_curriculares").alias("orden", "e"))
    return entries, rows.select("codigo_estudio", "file", "orden", "e.*").withColumn("nombre_elemento", blank(F.col("nombre_elemento")))


def with_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` and ``rows`` in its columns; what these lack is null."""
    kinds = dict(table.dtypes)
    return table.unionByName(rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in table.columns]))


def apply_prices(degrees: DataFrame, prices: DataFrame, kind: str = "tipo") -> DataFrame:
    """``degrees`` with the six price columns of ``prices`` (codigo_estudio): at public universities these replace all that
    is stored, null too; elsewhere only a missing source is filled."""
    public = F.lower(blank(F.col(kind))).rlike("p[úu]blica")
    news = prices.select("codigo_estudio", *[F.col(c).alias(f"_{c}") for c in PRICES], F.lit(True).alias("_has"))
    both = degrees.join(news, "codigo_estudio", "left")
    now = {c: F.when(public & F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)) for c in PRICES}
    now["fuente_precio"] = F.when(public & F.col("_has"), F.col("_fuente_precio")).when(F.col("_has") & ~public, F.coalesce("fuente_precio", F.lit(fixed.PRICE_SOURCE["private"]))).otherwise(F.col("fuente_precio"))
    return both.withColumns(now).select(*degrees.columns)


def tuition_totals(courses: DataFrame, plan: str, price: Column) -> DataFrame:
    """Per plan: number, credits and cost of the chosen courses (ects, tier, chosen), and number and cost of each tier; without credits a course counts 6."""
    n = F.coalesce(F.nullif(F.col("ects"), F.lit(0).cast("decimal(12,2)")), F.lit(6).cast("decimal(12,2)"))
    rows = courses.filter("chosen").withColumns({"_n": n, "_cost": n * price})
    whole = lambda c: F.sum(c).cast("double")
    tiers = [x for k in (1, 2, 3, 4) for x in (F.count_if(F.col("tier") == k).alias(f"n{k}"), F.coalesce(whole(F.when(F.col("tier") == k, F.col("_cost"))), F.lit(0.0)).alias(f"cost{k}"))]
    return rows.groupBy(plan).agg(F.count("*").alias("n"), whole("_n").alias("ects"), whole("_cost").alias("cost"), *tiers)


def newest_first(files: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Documents of each key with ``place``, and ``latest``: the first that could be fetched (``fetched``)."""
    w = Window.partitionBy(by)
    rows = files.withColumn("place", F.row_number().over(w.orderBy(*order)))
    first = F.min(F.when(F.col("fetched"), F.col("place"))).over(w)
    return rows.withColumn("latest", F.coalesce(F.col("fetched") & (F.col("place") == first), F.lit(False)))


def sync(stored: dict[str, DataFrame], news: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after a load of what a crawl has brought; what ``news`` lacks stays as it is.

    Universities are only added; degrees are added or merged, unless kept by hand, and go where the registry no longer
    has them; then come the plan files, and last errors and reports that are new.
    """
    out = dict(stored)
    if "universities" in news:
        out["universities"] = insert_only(out["universities"], with_rows(out["universities"].limit(0), news["universities"]), "codigo")
    if "degrees" in news:
        new = news["degrees"]
        merged = [c for c in ("titulo", *PRICES) if c in new.columns]
        rows = upsert(out["degrees"], new, "codigo_estudio", merged, ["nivel_academico", "estado"], MARK)
        out["degrees"] = prune(rows, new, "codigo_estudio", protected=MARK)
    if "files" in news:
        out |= load_plans(news["files"], *[out[t] for t in ("universities", "degrees", "plans", "summaries", "courses")])
    if "errors" in news:
        out["errors"] = with_rows(out["errors"], new_errors(out["errors"], news["errors"], ["id_entidad", "motivo_fallo", "timestamp"], "pos"))
    if "reports" in news:
        out["reports"] = with_rows(out["reports"], new_reports(out["reports"], news["reports"], "timestamp_reporte", "pos"))
    return out
