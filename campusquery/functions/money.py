"""Credits, tariffs and tuition as column expressions; money is decimal, rounded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .text import blank, has_any, region

CATEGORIES = ("Grado", "Máster Habilitante", "Máster No Habilitante")
DEFAULT_PRICE = 16.80


def required_credits(level: Column, title: Column, total: Column) -> Column:
    """Credits that a plan must reach; ``total``: what its own summary says, counted from 30."""
    v, t = blank(level), F.lower(blank(title))
    n = F.lower(v)
    own = F.replace(F.trim(blank(total)), F.lit(","), F.lit(".")).try_cast("double")
    return (
        F.when(own >= 30, own).when(t.contains("medicina"), 360.0).when(has_any(t, fixed.SPECIAL_DEGREES), 300.0)
        .when(has_any(n, ["grado", "graduado", "graduada", "grau"]), 240.0)
        .when(has_any(n, ["máster", "master", "431"]), F.when(has_any(t, fixed.ENGINEERING_MASTERS), 120.0).when(has_any(t, fixed.LAW_MASTERS), 90.0).otherwise(60.0))
        .otherwise(240.0)
    )


def is_doctoral(level: Column, title: Column) -> Column:
    n = F.lower(blank(level))
    return has_any(n, ["doctor", "560", "900"]) | F.lower(blank(title)).contains("doctor")


def completeness(doctoral: Column, has_plan: Column, n_courses: Column, n_summary: Column, ects: Column, required: Column, known: Column | None = None) -> Column:
    """State of a degree's plan; ``known``: is there anything on the degree."""
    return (
        F.when(~(F.lit(True) if known is None else known), "sin_datos").when(doctoral & has_plan, "doctorado_estructural").when(~has_plan, "sin_plan").when((n_courses == 0) & (n_summary > 0), "solo_resumen")
        .when(n_courses == 0, "sin_asignaturas").when(ects >= required, "completo").otherwise("incompleto_parcial")
    )


def category(level: Column, title: Column) -> Column:
    n, t = F.lower(blank(level)), F.lower(blank(title))
    return (
        F.when(has_any(n, ["doctorado", "560", "900"]) | t.contains("doctor"), "Doctorado")
        .when(has_any(n, ["máster", "master", "431"]), F.when(has_any(t, fixed.REGULATED_MASTERS), CATEGORIES[1]).otherwise(CATEGORIES[2]))
        .otherwise(CATEGORIES[0])
    )


def tariff_table(spark: SparkSession) -> DataFrame:
    """72 rows (t_region, t_category, t_place, p1 to p4, fees, decree) of the catalogue."""
    rows = []
    for k, (name, (*tiers, doctoral, fees, decree)) in enumerate(fixed.TARIFFS.items()):
        rows += [(name, c, k, *map(str, p), str(fees), decree) for c, p in zip(CATEGORIES, tiers, strict=True)]
        rows.append((name, "Doctorado", k, str(doctoral), None, None, None, str(fees), decree))
    money = "p1 string, p2 string, p3 string, p4 string, fees string"
    df = spark.createDataFrame(rows, f"t_region string, t_category string, t_place int, {money}, decree string")
    return df.withColumns({c: F.col(c).cast("decimal(8,2)") for c in ("p1", "p2", "p3", "p4", "fees")})


def degree_price(degrees: DataFrame, region_col: str, kind: str, level: str, title: str) -> DataFrame:
    """``degrees`` with precio_1 to precio_4, precio_anual and fuente_precio.

    The region is looked up by its canonical name, then by the first entry that contains it or is contained
    in it. Not public, or unknown: no prices, and a text that says why.
    """
    spark, public = degrees.sparkSession, F.lower(blank(F.col(kind))).rlike("p[úu]blica")
    # A column of its own: the region's rule is long, and what follows names it more than once.
    degrees, kept, name = degrees.withColumn("_name", region(F.col(region_col))), degrees.columns, F.col("_name")
    table = F.broadcast(tariff_table(spark))  # 72 rows
    names = F.array(*[F.lit(x) for x in fixed.TARIFFS])
    low = F.lower(name)
    near = F.get(F.filter(names, lambda x: (low != "") & (F.lower(x).contains(low) | low.contains(F.lower(x)))), F.lit(0))
    keyed = degrees.withColumns({"_public": public, "_region": F.when(F.array_contains(names, name), name).otherwise(near), "_category": category(F.col(level), F.col(title))})
    out = keyed.join(table, (F.col("_region") == F.col("t_region")) & (F.col("_category") == F.col("t_category")) & F.col("_public"), "left")
    annual = F.when(F.col("_category") == "Doctorado", F.col("p1") + F.col("fees")).otherwise(60 * F.col("p1") + F.col("fees")).cast("decimal(8,2)")
    source = (
        F.when(~F.col("_public"), fixed.PRICE_SOURCE["private"])
        .when(F.col("t_region").isNull(), F.format_string(fixed.PRICE_SOURCE["unknown"], F.coalesce(F.nullif(F.col(region_col), F.lit("")), F.lit("Sin CCAA"))))
        .otherwise(F.concat(F.lit(fixed.PRICE_SOURCE["official"]), F.col("decree")))
    )
    out = out.withColumns({"precio_anual": annual, "fuente_precio": source} | {f"precio_{k}": F.col(f"p{k}") for k in range(1, 5)})
    return out.select(*kept, *[f"precio_{k}" for k in range(1, 5)], "precio_anual", "fuente_precio")


def tier_price(tier: int | Column, p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Price of an enrolment: as stored, else a multiple of the base price, 16.80 where none is stored."""
    base = F.coalesce(F.nullif(p1, F.lit(0)), F.lit(DEFAULT_PRICE))
    stored = [F.coalesce(F.nullif(p, F.lit(0)), base * k) for p, k in ((p2, 1.5), (p3, 3.0), (p4, 4.5))]
    return F.when(tier == 2, stored[0]).when(tier == 3, stored[1]).when(tier == 4, stored[2]).otherwise(base) if isinstance(tier, Column) else [base, *stored][tier - 1]


def discount(kind: Column, private: Column, cost: Column, first_cost: Column, base: Column, ects: Column, first_ects: Column, own_price: Column) -> Column:
    """(amount, fee_share): what a reduction takes off the cost, and the share of the fees that is left.

    ``first_cost`` and ``first_ects`` count first enrolments alone. At a private university only grants and honours
    count, at the degree's own price of a credit, or 16.80 where it has none.
    """
    own = F.coalesce(F.nullif(own_price, F.lit(0.0)), F.lit(DEFAULT_PRICE))
    cut = lambda amount, share=1.0: F.struct(amount.alias("amount"), F.lit(share).alias("fee_share"))
    return (
        F.when(private & (kind == "beca_mec"), cut(first_ects * own)).when(private & (kind == "mh_bachillerato"), cut(F.least(ects, F.lit(60.0)) * own)).when(private, cut(F.lit(0.0)))
        .when(kind == "fn_general", cut(cost * 0.5, 0.5)).when(kind.isin("fn_especial", "discapacidad", "victima_violencia"), cut(cost, 0.0))
        .when(kind == "beca_mec", cut(first_cost)).when(kind == "mh_bachillerato", cut(F.least(cost, 60 * base))).when(kind == "bonif_99", cut(first_cost * 0.99))
        .otherwise(cut(F.lit(0.0)))
    )


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km, to one decimal."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.round(6371 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 1)


def flat_simulation(credits: Column, tier: Column, per_credit: Column, per_year: Column) -> Column:
    """(total, n): cost and number of courses of a year without a list of courses: at the price of a credit, else a 60th of the year's, else 16.80."""
    rate = F.coalesce(F.nullif(per_credit, F.lit(0.0)), F.nullif(per_year, F.lit(0.0)) / 60, F.lit(DEFAULT_PRICE))
    factor = F.when(tier == 1, 1.0).when(tier == 2, 1.5).when(tier == 3, 3.0).otherwise(4.5)
    return F.struct((credits * rate * factor).alias("total"), F.floor(credits / 6 + 0.5).cast("long").alias("n"))


def shown_annual(stored: Column, per_credit: Column) -> Column:
    """The year's price that a card shows: as stored, else 60 credits and the fees in whole euro, else null."""
    return F.coalesce(F.nullif(stored, F.lit(0.0)), F.floor(60 * F.nullif(per_credit, F.lit(0.0)) + 45.0 + 0.5).cast("double"))
