"""The registry's lists of universities and degrees, site maps, document links and the spreadsheet export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusquery.functions import fixed, text, web
from campusquery.functions.text import blank, has_any
from campusquery.operators import catalog, html, state


def named(rows: DataFrame, key: str) -> Column:
    """The registry's column ``key`` under any of its names, the first that isn't blank; blank where none is there."""
    here = {c.strip(): c for c in rows.columns}
    found = [F.nullif(F.trim(F.col(f"`{here[n]}`").cast("string")), F.lit("")) for n in fixed.REGISTRY_COLUMNS[key] if n in here]
    return F.coalesce(*found, F.lit(""))


def from_html(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """First table of each page as (key, pos, one column per registry name), where the list came as a web page."""
    first = html.extract_tables(pages, key).filter("table = 0")
    head = F.first("cells").over(Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = first.withColumn("_head", head).filter((F.size("cells") >= 2) & ~F.get("cells", F.lit(0)).rlike("Código|CÃ³digo|Codigo"))
    at = lambda n: F.get("cells", F.nullif(F.array_position("_head", n), F.lit(0)).cast("int") - 1)
    names = [n for forms in fixed.REGISTRY_COLUMNS.values() for n in forms]
    return rows.select(key, F.col("row").alias("pos"), *[F.when(F.size("cells") == F.size("_head"), at(n)).alias(n) for n in names])


def registry_universities(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Universities with a code and a name, the public ones first and else as listed (``pos``)."""
    clean = lambda k: text.sanitize(named(rows, k))
    out = rows.select(
        text.excel_code(named(rows, "codigo"), 3).alias("codigo"), clean("universidad").alias("nombre"), clean("tipo").alias("tipo"), clean("comunidad").alias("ccaa"), clean("municipio").alias("municipio"),
        clean("provincia").alias("provincia"), named(rows, "url").alias("web"), named(rows, "email").alias("email"), clean("telefono").alias("telefono"), F.col(pos).alias("pos"),
    )
    return out.filter((F.col("codigo") != "") & (F.col("nombre") != "")).orderBy(catalog.public_first(F.col("tipo")), "pos")


def registry_degrees(rows: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Active degrees, of each title (and key ``by``) the latest version."""
    code, title, level, now = text.excel_code(named(rows, "codigo")), named(rows, "titulo"), named(rows, "nivel"), named(rows, "estado")
    active = rows.filter((code != "") & (title != "") & text.active_degree(now, level, title))
    out = active.select(*by, F.col(pos).alias("pos"), code.alias("codigo_estudio"), text.sanitize(title).alias("titulo"), text.sanitize(level).alias("nivel"), text.sanitize(now).alias("estado"))
    return state.latest_versions(out.withColumn("_base", text.title_base(F.col("titulo"))), [*by, "_base"], "codigo_estudio", "pos").drop("_base", "pos")


def title_words(title: Column) -> Column:
    """Up to three words of four letters or more by which an address may name a degree."""
    words = F.regexp_extract_all(F.lower(blank(title)), F.lit(r"(?U)\b[a-záéíóúñ]{4,}\b"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~w.isin(fixed.COMMON_TITLE_WORDS)), 1, 3)


def sitemap_urls(maps: DataFrame, key: str, xml: str = "xml", words: Column | None = None) -> DataFrame:
    """(key, url) of the addresses in site maps that lead to studies, or hold one of ``words`` (array)."""
    rows = maps.select(key, (words if words is not None else F.array().cast("array<string>")).alias("_words"), F.explode(F.regexp_extract_all(blank(F.col(xml)), F.lit("(?i)<loc>(.*?)</loc>"), F.lit(1))).alias("url"))
    rows = rows.withColumn("url", F.trim("url"))
    low = F.lower("url")
    return rows.filter(has_any(low, fixed.STUDY_ADDRESS) | F.exists("_words", lambda w: low.contains(w))).select(key, "url").distinct()


def document_date(label: Column, href: Column) -> Column:
    """d/m/yyyy in the label, else yyyy/mm/dd in the address; null where neither is a date."""
    day = lambda c, p, ymd: F.try_to_date(F.concat_ws("-", *[F.lpad(F.regexp_extract(c, p, k), 4 if k == ymd[0] else 2, "0") for k in ymd]), "yyyy-MM-dd")
    return F.coalesce(day(label, r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", (3, 2, 1)), day(href, r"([0-9]{4})/([0-9]{2})/([0-9]{2})", (1, 2, 3)))


def document_candidates(links: DataFrame, key: str, most: int = 8) -> DataFrame:
    """Official documents among links (key, pos, href, label and their context, as ``html.document_links`` gives them): those from 2009 on, by priority and then the newest.

    Only priorities of 90 or more count where there are such, else those above 0; ``most`` a key.
    """
    href, label = blank(F.trim("href")), blank(F.col("label"))
    official = F.lower(href).contains("boe.es") | F.lower(label).contains("boe") | F.lower(href).contains(".pdf")
    early = href.rlike("/(19[0-9]{2}|200[0-8])/") | href.rlike(r"(?i)A[0-9]{5}-[0-9]{5}\.pdf")
    rank = html.link_rank(*[F.col(c) for c in ("legend", "heading", "before", "around")])
    rows = links.withColumns({"date": document_date(label, href), "_rank": rank}).withColumns({"priority": F.col("_rank.priority"), "kind": F.col("_rank.kind")})
    rows = rows.filter(official & ~early & (F.col("date").isNull() | (F.col("date") >= F.lit("2009-01-01").cast("date"))))
    rows = rows.withColumn("url", web.normalize_url(href)).withColumn("_top", F.max("priority").over(Window.partitionBy(key)))
    rows = rows.filter(F.when(F.col("_top") >= 90, F.col("priority") >= 90).otherwise(F.col("priority") > 0))
    order = [F.desc("priority"), F.coalesce("date", F.lit("1970-01-01").cast("date")).desc(), F.col("pos")]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select(key, "place", "url", "label", "date", "priority", "kind")
