"""Queries over what a crawl brings: addresses, scores, prices in text, sections and plans of several documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from campusquery.functions import fixed, text, web
from campusquery.operators import catalog, grid, html, state
from campusquery.sources import registry
from campusquery.sources.tables import courses, read

from .catalogue import LINKS_SQL, query, sql_any


@query(LINKS_SQL + "SELECT page_id, pos, CASE page_id % 3 WHEN 0 THEN 100 + CASE WHEN contains(lower(href), 'the') OR contains(lower(label), 'the') THEN 40 ELSE 0 END WHEN 1 THEN 20 + CASE WHEN contains(lower(href), 'the') OR contains(lower(label), 'the') THEN 40 ELSE 0 END ELSE 60 + CASE WHEN contains(lower(href), 'the') OR contains(lower(label), 'the') THEN 40 ELSE 0 END END AS score FROM l", views=False)
def url_score(spark, d):
    k = F.col("page_id") % 3
    prefix = F.when(k == 0, "/grados").when(k == 1, "/grados/becas").otherwise("/oferta-academica")
    rows = html.links(read(spark, d, "pages"))
    return rows.select("page_id", "pos", web.url_score(F.concat(prefix, "href"), F.col("label"), F.lit("Grado"), ["the"]).alias("score"))


@query("""WITH p AS (SELECT (p_partkey // 40)::BIGINT AS doc, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey)::INTEGER - 1 AS page, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS head FROM part),
m AS (SELECT doc, page, last_value(CASE WHEN head IS NOT NULL THEN contains(head, 'blue') OR contains(head, 'widget') END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM p),
n AS (SELECT doc, count(DISTINCT head) AS n FROM p GROUP BY 1)
SELECT doc, page, n < 2 OR coalesce(now, false) AS included FROM m JOIN n USING (doc)""", views=False)
def multi_degree_mask(spark, d):
    """Pages of documents on several degrees, those of one degree marked; a third of the pages has a heading."""
    page = F.row_number().over(Window.partitionBy(F.floor(F.col("p_partkey") / 40)).orderBy("p_partkey")) - 1
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ANEXO II: Grado en "), "p_name")).otherwise("sin nada")
    rows = read(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("doc"), page.alias("page"), body.alias("text"), F.lit("Grado en blue widget").alias("titulo"), F.lit("Universidad").alias("universidad"))
    return grid.degree_pages(rows, "doc").select("doc", "page", "included")


def course_grids(spark, d):
    """A table of each degree's courses; that of an even code ends with the rest of the last name."""
    kind = F.when(F.col("caracter") == "A", "Básica").when(F.col("caracter") == "N", "Optativa").otherwise("OB")
    when = F.when(F.col("cuatrimestre") == "F", "1º cuatrimestre").otherwise("anual")
    cells = F.array(F.col("l_partkey").cast("string"), "nombre", F.col("ects").cast("int").cast("string"), kind, "curso", when)
    rows = courses(spark, d).groupBy("codigo_estudio").agg(F.array_sort(F.collect_list(F.struct("orden", "l_partkey", "l_suppkey", "l_extendedprice", cells.alias("c")))).alias("x"))
    head, rest = (F.array(*[F.lit(c) for c in row]) for row in (["Código", "Asignatura", "Créditos ECTS", "Carácter", "Curso", "Cuatrimestre"], ["", "de laboratorio", "", "", "", ""]))
    whole = F.concat(F.array(head), F.transform("x", lambda x: x["c"]), F.when(F.col("codigo_estudio") % 2 == 0, F.array(rest)).otherwise(F.array().cast("array<array<string>>")))
    return rows.select("codigo_estudio", F.lit(0).alias("table"), F.posexplode(whole).alias("row", "cells"))


GRID_SQL = """, x AS (SELECT *, row_number() OVER (PARTITION BY codigo_estudio ORDER BY orden, l_partkey, l_suppkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY codigo_estudio) AS n FROM a),
y AS (SELECT codigo_estudio, i, nombre || CASE WHEN i = n AND codigo_estudio % 2 = 0 THEN ' de laboratorio' ELSE '' END AS nombre, ects::INTEGER AS e, CASE caracter WHEN 'A' THEN 'FB' WHEN 'N' THEN 'OP' ELSE 'OB' END AS k,
      CASE WHEN curso = ects::INTEGER::VARCHAR AND ects >= 5 THEN '' ELSE curso END AS y, CASE cuatrimestre WHEN 'F' THEN '1C' ELSE 'Anual' END AS t FROM x)
"""


@query(GRID_SQL + """SELECT codigo_estudio, nombre, arg_min(e, i)::VARCHAR AS ects, coalesce(arg_min(k, i) FILTER (k <> 'OB'), 'OB') AS caracter, coalesce(arg_min(y, i) FILTER (y <> ''), '') AS curso, arg_min(t, i) AS cuatrimestre
FROM y WHERE e <= 18 GROUP BY 1, 2""")
def grid_courses(spark, d):
    lines = grid.table_lines(course_grids(spark, d), "codigo_estudio")
    return grid.courses(lines, "codigo_estudio").select("codigo_estudio", "nombre", "ects", "caracter", "curso", "cuatrimestre")


@query(GRID_SQL + "SELECT codigo_estudio, nombre AS etiqueta, arg_max(e, i)::VARCHAR AS creditos FROM y WHERE e > 18 GROUP BY 1, 2")
def grid_summary(spark, d):
    return grid.summary(grid.table_lines(course_grids(spark, d), "codigo_estudio"), "codigo_estudio")


@query("""SELECT codigo_estudio, nombre, ects::INTEGER::VARCHAR AS ects, CASE caracter WHEN 'A' THEN 'FB' WHEN 'N' THEN 'OP' ELSE 'OB' END AS caracter, ects > 18 AS sum
FROM a WHERE ects > 18 OR ects IN (1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 14, 15, 18)""")
def line_course_fallback(spark, d):
    """Courses in running text: a line of each, between a heading and a page number."""
    kind = F.when(F.col("caracter") == "A", "FB").when(F.col("caracter") == "N", "Optativa").otherwise("Obligatoria")
    rows = courses(spark, d).select("codigo_estudio", F.concat_ws(" ", "nombre", F.col("ects").cast("int"), kind).alias("line"))
    docs = rows.groupBy("codigo_estudio").agg(F.concat(F.lit("Asignatura ECTS 6 OB\n"), F.array_join(F.collect_list("line"), "\n"), F.lit("\nPágina 6 OB")).alias("text"))
    return grid.text_courses(docs, "codigo_estudio").drop("row")


@query("""WITH r AS (SELECT (p_partkey // 40)::BIGINT AS page_id, p_name AS nombre, (p_partkey % 70)::VARCHAR AS ects, CASE p_partkey % 3 WHEN 0 THEN 'FB' WHEN 1 THEN 'OP' ELSE 'OB' END AS caracter, '' AS curso,
  row_number() OVER (PARTITION BY p_partkey // 40, p_name ORDER BY p_partkey) AS i FROM part) SELECT page_id, nombre, ects, caracter, curso FROM r WHERE i = 1""", views=False)
def html_courses(spark, d):
    k = F.col("p_partkey")
    row = F.concat(F.lit("<tr><td>"), k, F.lit("</td><td> "), "p_name", F.lit("</td><td>"), k % 70, F.lit("</td><td>"), F.when(k % 3 == 0, "Básica").when(k % 3 == 1, "Optativa").otherwise("OB"), F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "")
    head = F.lit("<form><input></form><table><tr><th>Código</th><th>Asignatura</th><th>ECTS</th><th>Tipo</th></tr>")
    pages = read(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("page_id")).agg(F.concat(head, body, F.lit("</table><table><tr><td>ECTS</td><td><select></td></tr><tr><td>Otra cosa</td><td>6</td></tr></table>")).alias("html"))
    return grid.web_courses(html.extract_tables(pages), "page_id").select("page_id", "nombre", "ects", "caracter", "curso")


@query("""WITH r AS (SELECT *, CASE event_id % 4 WHEN 1 THEN DATE '2012-01-02' END AS date, CASE event_id % 7 WHEN 0 THEN 90 WHEN 1 THEN 100 ELSE 30 END AS priority FROM events WHERE event_id % 4 <> 0),
m AS (SELECT *, max(priority) OVER (PARTITION BY user_id) AS top FROM r)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, coalesce(date, DATE '1970-01-01') DESC, event_id)::INTEGER AS place, priority, date IS NOT NULL AS dated,
  'https://www.boe.es' || CASE event_id % 4 WHEN 1 THEN '/boe/dias/2012/01/02/x.pdf' WHEN 2 THEN '/z.pdf' ELSE '/w.html' END AS url FROM m WHERE top < 90 OR priority >= 90 QUALIFY place <= 8""", views=False)
def document_candidates(spark, d):
    forms = F.array(*[F.lit(x) for x in ("/boe/dias/2007/01/02/x.pdf", "/boe/dias/2012/01/02/x.pdf", "/z.pdf", "/w.html")])
    legend = F.when(F.col("event_id") % 7 == 0, "Plan de estudios").when(F.col("event_id") % 7 == 1, "Modificación")
    links = read(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), F.get(forms, (F.col("event_id") % 4).cast("int")).alias("href"), F.lit("BOE").alias("label"), *[x.alias(n) for x, n in ((legend, "legend"), (F.lit(""), "heading"), (legend, "before"), (F.lit(""), "around"))])
    return registry.document_candidates(links, "user_id").select("user_id", "place", "priority", F.col("date").isNotNull().alias("dated"), "url")


@query("SELECT max(p_partkey)::VARCHAR AS codigo_estudio, arg_max('Grado en ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' por la Universidad' ELSE '' END, p_partkey) AS titulo FROM part WHERE p_partkey % 3 <> 1 GROUP BY p_name", views=False)
def registry_degrees(spark, d):
    k = F.col("p_partkey")
    title = F.concat(F.lit("Grado en "), "p_name", F.when(k % 2 == 0, " por la Universidad").otherwise(""))
    rows = read(spark, d, "part").select(k.alias("pos"), F.concat(k, F.lit(".0")).alias("Código"), title.alias("Título"), F.when(k % 3 == 0, "Vigente").when(k % 3 == 1, "Extinguida").otherwise("Renovado").alias("Situación"))
    return registry.registry_degrees(rows, []).select("codigo_estudio", "titulo")


@query("SELECT CASE WHEN c_custkey < 100 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS codigo, c_name AS nombre FROM customer WHERE c_custkey % 7 <> 0", views=False)
def registry_universities(spark, d):
    """The registry's list as a whole, with padded codes; rows without a name are left out."""
    return registry.registry_universities(registry_rows(spark, d)).select("codigo", "nombre")


@query("SELECT CASE WHEN c_custkey < 100 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS codigo FROM customer WHERE c_custkey % 7 <> 0 ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END, c_custkey LIMIT 50", views=False)
def registry_first_universities(spark, d):
    """The first 50 of the list: public ones, as listed."""
    return registry.registry_universities(registry_rows(spark, d)).limit(50).select("codigo")


def registry_rows(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("pos"), F.concat(k, F.lit(".0")).alias("CÃ³digo"), F.when(k % 7 != 0, F.col("c_name")).alias("Universidad"), F.when(k % 3 == 0, "Pública").otherwise("Privada").alias("Tipo"))


@query(f"WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'https://u.es/grados/' || page_id FROM pages) SELECT DISTINCT page_id, url FROM u WHERE {sql_any('lower(url)', fixed.STUDY_ADDRESS)}", views=False)
def sitemap_urls(spark, d):
    xml = F.concat(F.lit("<urlset><loc>"), "url", F.lit("</loc><loc> https://u.es/grados/"), "page_id", F.lit("</loc></urlset>"))
    return registry.sitemap_urls(read(spark, d, "pages").select("page_id", xml.alias("xml")), "page_id")


@query("SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events", views=False)
def flatten_metrics(spark, d):
    nested = read(spark, d, "events").select("event_id", F.struct(F.struct("user_id", "value").alias("time"), F.from_json("props", "k bigint").alias("props")).alias("m"))
    return nested.select("event_id", "m.time.user_id", "m.props.k", "m.time.value")


@query(None)
def merge_plans(spark, d):
    """Plans of degrees whose lines stand for documents, newest first; a fold over the few rows of a degree, many degrees to an Arrow batch.

    A supplier's lines are a document; one of a supplier divisible by 13 is known as no plan.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            taken = []
            for code, items in zip(batch.codigo_estudio, batch["items"], strict=True):
                taken += [(code, k, c["nombre"], float(c["ects"])) for k, c in enumerate(state.merge_plans(plan_documents(items), 120, {"0"})["courses"])]
            yield pd.DataFrame(taken, columns=["codigo_estudio", "pos", "nombre", "ects"])

    items = F.array_sort(F.collect_list(F.struct("l_suppkey", "orden", "l_partkey", "l_extendedprice", "nombre", "ects", "curso")))
    return courses(spark, d).groupBy("codigo_estudio").agg(items.alias("items")).mapInPandas(fold, "codigo_estudio long, pos int, nombre string, ects double")


def plan_documents(items) -> list[dict]:
    """Documents of a degree's lines, which lie in the order of their suppliers."""
    groups = [(key, list(g)) for key, g in groupby(items, key=lambda r: r["l_suppkey"])]
    return [{"hash": str(key % 13), "summary": {"Total": str(key)}, "courses": [{"nombre": r["nombre"], "ects": str(r["ects"]), "curso": r["curso"]} for r in g]} for key, g in groups]


@query("SELECT doc_id, lower(trim(regexp_replace(text, '\\s*\\(.*?\\)', '', 'g'))) AS k FROM documents", views=False)
def name_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", text.name_key(F.col("text")).alias("k"))


@query("SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY 1, 2 QUALIFY place <= 2", views=False)
def top_types_by_user(spark, d):
    n = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("place <= 2")


def registry_pages(spark, d):
    """The registry's lists as web pages of some rows, with a row of headings that is repeated."""
    k = F.col("c_custkey")
    cell = lambda *cs: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c.cast("string"), F.lit(" </td>")) for c in cs], F.lit("</tr>"))
    line = cell(k, F.col("c_name"), F.when(k % 3 == 0, "Pública").otherwise("Privada"))
    pages = read(spark, d, "customer").groupBy(F.floor(k / 25).alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, line.alias("l")))), lambda x: x["l"]), "").alias("body"))
    head = "<tr><th>Código</th><th>Universidad</th><th>Tipo</th></tr>"
    return pages.select("page_id", F.concat(F.lit(f"<p>x</p><table>{head}"), "body", F.lit(f"{head}<tr><td>corta</td></tr></table><table><tr><td>Código</td><td>otra</td></tr></table>")).alias("html"))


@query("SELECT (c_custkey // 25)::BIGINT AS page_id, row_number() OVER (PARTITION BY c_custkey // 25 ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END, c_custkey)::INTEGER AS place, lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INTEGER, '0') AS codigo, c_name AS nombre FROM customer", views=False)
def registry_pages_universities(spark, d):
    """Universities from the registry's lists where these came as web pages."""
    rows = registry.from_html(registry_pages(spark, d)).withColumn("pos", F.col("page_id") * 10_000 + F.col("pos"))
    out = registry.registry_universities(rows)
    place = F.row_number().over(Window.partitionBy(F.floor(F.col("pos") / 10_000)).orderBy(catalog.public_first(F.col("tipo")), "pos"))
    return out.select(F.floor(F.col("pos") / 10_000).alias("page_id"), place.alias("place"), "codigo", "nombre")


@query("SELECT (p_partkey // 25)::BIGINT AS page_id, max(p_partkey)::VARCHAR AS codigo_estudio, 'Grado en ' || p_name AS titulo FROM part WHERE p_partkey % 4 <> 1 GROUP BY 1, p_name", views=False)
def registry_pages_degrees(spark, d):
    """Active degrees, the latest of a title, of each page of the registry's list."""
    k = F.col("p_partkey")
    line = F.concat(F.lit("<tr><td>"), k, F.lit("</td><td>Grado en "), "p_name", F.lit("</td><td>"), F.when(k % 4 == 1, "Extinguida").otherwise("Vigente"), F.lit("</td></tr>"))
    pages = read(spark, d, "part").groupBy(F.floor(k / 25).alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, line.alias("l")))), lambda x: x["l"]), "").alias("body"))
    pages = pages.select("page_id", F.concat(F.lit("<table><tr><th>Código</th><th>Título</th><th>Estado</th></tr>"), "body", F.lit("</table>")).alias("html"))
    return registry.registry_degrees(registry.from_html(pages), ["page_id"]).select("page_id", "codigo_estudio", "titulo")


@query("""SELECT page_id, place, v.url, priority, dated FROM pages, (VALUES (1, 'https://www.boe.es/boe/dias/2012/01/02/x.pdf', 100, true), (2, 'https://www.boe.es/y.pdf', 90, false)) v (place, url, priority, dated) WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 1, 'https://www.boe.es/boe/dias/2015/03/04/w.pdf', 30, true FROM pages WHERE page_id % 2 = 1""", views=False)
def detail_documents(spark, d):
    """Ranked documents of degrees' pages, by what stands around their links."""
    rich = "<fieldset><legend>Modificación</legend><a href='/boe/dias/2012/01/02/x.pdf'>BOE</a></fieldset><strong>Plan de estudios</strong><a href='/y.pdf'>BOE</a><strong>Acuerdo de Consejo de Ministros</strong><a href='/z.pdf'>BOE</a><strong>Plan de estudios</strong><a href='/boe/dias/2007/01/02/old.pdf'>BOE</a>"
    poor = "<p>Boletín</p><a href='/boe/dias/2015/03/04/w.pdf'>BOE</a><a href='/nada'>nada</a>"
    pages = read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, rich).otherwise(poor).alias("html"))
    found = registry.document_candidates(html.document_links(pages), "page_id")
    return found.select("page_id", "place", "url", "priority", F.col("date").isNotNull().alias("dated"))


@query("SELECT p_partkey, list_filter(regexp_extract_all(lower('Grado en ' || p_name || ' con Máster Universidad de ' || p_type), '[a-záéíóúñ]{4,}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in fixed.COMMON_TITLE_WORDS) + "], w))[:3] AS words FROM part", views=False)
def title_words(spark, d):
    title = F.concat(F.lit("Grado en "), "p_name", F.lit(" con Máster Universidad de "), "p_type")
    return read(spark, d, "part").select("p_partkey", registry.title_words(title).alias("words"))
