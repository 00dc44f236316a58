"""Course tables, sections, registry lists, site maps and document links, held to literal expectations."""

import datetime

from pyspark.sql import functions as F

from campusquery.operators import grid, html, state
from campusquery.plans import catalogue, extraction  # noqa: F401  (registers its queries)
from campusquery.sources import registry


def lines(spark, *tables):
    rows = [(1, t, r, cells) for t, table in enumerate(tables) for r, cells in enumerate(table)]
    return grid.table_lines(spark.createDataFrame(rows, "doc_id long, table int, row int, cells array<string>"), "doc_id")


HEAD = ["Asignatura", "ECTS", "Carácter", "Curso", "Cuatrimestre"]


def test_courses_of_a_mapped_table(spark):
    got = lines(spark, [HEAD, ["Álgebra lineal y", "6", "Básica", "1º", "1º cuatrimestre"], ["de matrices", "", "", "", ""], [None, "", "", "", ""], ["40147 - Cálculo I", "7,5", "OB", "Segundo", "anual"], ["Trabajo fin de grado", "24", "TFG", "4", "2"]])
    rows = [tuple(r)[3:] for r in grid.courses(got, "doc_id").orderBy("table", "row").collect()]
    assert rows == [
        ("", "", "Álgebra lineal y de matrices", "6", "FB", "1", "1C"), ("", "", "Cálculo I", "7.5", "OB", "2", "Anual"), ("", "", "Trabajo fin de grado", "24", "TFG/TFM", "4", "2C"),
    ]


def test_sums_and_noise_are_no_courses(spark):
    got = lines(spark, [HEAD, ["Formación básica", "60", "", "", ""], ["Optativas", "0", "", "", ""], ["Gran bloque", "24", "OB", "", ""], ["El Rector", "6", "", "", ""], ["AAAA", "6", "", "", ""], ["Física", "6", "", "", ""]])
    assert [r.nombre for r in grid.courses(got, "doc_id").collect()] == ["Física"]
    assert {r.etiqueta: r.creditos for r in grid.summary(got, "doc_id").collect()} == {"Formación básica": "60", "Optativas": "0-6", "Gran bloque": "24"}


def test_doubled_names_fill_blanks(spark):
    got = lines(spark, [HEAD, ["Física.", "6", "", "", ""], ["Física", "6", "Optativa", "3", "2º"]], [HEAD, ["FÍSICA", "6", "Básica", "4", ""]])
    (r,) = grid.courses(got, "doc_id").collect()
    assert (r.nombre, r.caracter, r.curso, r.cuatrimestre) == ("Física", "OP", "3", "2C")


def test_tables_without_headers(spark):
    """A short code leaves the second cell as the name; a line on a module alone is a header and makes the first column that of names."""
    plain = [["A1", "Historia antigua", "6", "Optativa"], ["Gramática", "6"], ["Nota suelta", "sin cifra"]]
    rows = {r.nombre: r for r in grid.courses(lines(spark, plain), "doc_id").collect()}
    assert set(rows) == {"Historia antigua", "Gramática"} and rows["Historia antigua"].caracter == "OP"
    assert [r.nombre for r in grid.courses(lines(spark, [*plain, ["MÓDULO I"]]), "doc_id").collect()] == ["Gramática"]


def test_topic_column_and_displaced_topic(spark):
    head = ["Materia", "Asignatura", "ECTS", "Curso"]
    got = lines(spark, [head, ["Lengua", "Gramática", "6", "1"], ["", "Sintaxis", "6", "Literatura"], ["", "Métrica", "6", ""]])
    rows = {r.nombre: (r.materia, r.curso) for r in grid.courses(got, "doc_id").collect()}
    assert rows == {"Gramática": ("Lengua", "1"), "Sintaxis": ("Literatura", ""), "Métrica": ("", "")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, table int, row int, cells array<string>")
    assert not grid.courses(grid.table_lines(none, "doc_id"), "doc_id").collect()
    assert not lines(spark, [[None, ""], []]).collect()


def test_courses_in_running_text(spark):
    df = spark.createDataFrame([(1, "Asignatura 6 OB\n  40147 - Cálculo I 7,5 Básica \r\nFormación básica 60 FB\nTesis 7 OB\nPrácticas en empresa 18 PE\nOB OP FB 6 OB"), (2, ""), (3, None)], "k int, text string")
    got = [(r.nombre, r.ects, r.caracter, r.sum) for r in grid.text_courses(df, "k").orderBy("row").collect()]
    assert got == [("Cálculo I", "7.5", "FB", False), ("Formación básica", "60", "FB", True), ("Prácticas en empresa", "18", "PE", False)]


def test_courses_on_web_pages(spark):
    tables = [[["Assignatura", "Crèdits", "Tipus", "Curs"], ["Àlgebra bàsica", "6", "Optativa", "2n"], ["Lunes 9 h", "6", "", ""], ["ÀLGEBRA BÀSICA", "9", "", ""]], [["Guía docente", "x"], ["1", "Historia", "99", "4.50", "3er año"], ["Sola"], ["Arte", "-"]], [["Calificación cualitativa ECTS", "x"], ["Física", "6"]]]
    rows = [(1, t, r, cells, 0) for t, table in enumerate(tables) for r, cells in enumerate(table)] + [(2, 0, 0, ["Asignatura", "ECTS"], 1), (2, 0, 1, ["Física", "6"], 1)]
    df = spark.createDataFrame(rows, "k int, table int, row int, cells array<string>, fields int")
    got = [(r.k, r.nombre, r.ects, r.caracter, r.curso) for r in grid.web_courses(df, "k").orderBy("k", "table", "row").collect()]
    assert got == [(1, "Àlgebra bàsica", "6", "OP", "2n"), (1, "Historia", "4.5", "OB", "3er año"), (1, "Arte", "6", "OB", "")]


def test_valid_tables(spark):
    df = spark.createDataFrame([("Asignatura ECTS", 0), ("Asignatura ECTS", 2), ("Escala de calificaciones ECTS", 0), ("Noticias", 0), (None, 0)], "t string, n int")
    assert [r[0] for r in df.select(grid.valid_table(F.col("t"), F.col("n"))).collect()] == [True, False, False, False, False]


def included(spark, title, *texts):
    rows = [(1, k, t, title, "Universidad de Cádiz") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, titulo string, universidad string")
    return [r.included for r in grid.degree_pages(df, "doc_id").orderBy("page").collect()]


def test_pages_of_one_of_several_degrees(spark):
    pages = ("Resolución sobre Psicología.\nANEXO I: Grado en Informática", "tabla", "ANEXO II: Grado en Marketing", None, "ANEXO III: Grado en Psicología")
    assert included(spark, "Graduado en Marketing", *pages) == [False, False, True, True, False]
    assert included(spark, "Graduado en Enfermería", *pages) == [False] * 5
    assert included(spark, "Grado", *pages) == [True] * 5  # no telling word
    assert included(spark, "Graduado en Marketing", *pages[:2]) == [True, True]


def test_registry(spark):
    rows = spark.createDataFrame([(0, "7.0", "Uni Privada ;", "Privada"), (1, "13", "Uni Pública", "Pública"), (2, "", "Sin código", "Pública"), (3, "14", None, "Pública")], "pos int, `CÃ³digo` string, Universidad string, Tipo string")
    assert [(r.codigo, r.nombre, r.ccaa) for r in registry.registry_universities(rows).collect()] == [("013", "Uni Pública", ""), ("007", "Uni Privada", "")]
    degrees = [(0, "100", "Grado en Física por la Universidad A", "Grado", "Vigente"), (1, "250.0", "Grado en Física", "Grado", "Renovado"), (2, "9", "Grado en Arte", "Grado", "Extinguida"), (3, "8", "Licenciado en Arte", "Ciclo", "Vigente")]
    df = spark.createDataFrame(degrees, "pos int, `Código` string, `Título` string, `Nivel académico` string, `Situación` string")
    assert [(r.codigo_estudio, r.estado) for r in registry.registry_degrees(df, []).collect()] == [("250", "Renovado")]
    page = "<table><tr><th>Código</th><th>Título</th><th>Estado</th></tr><tr><td>5</td><td>Grado en Arte</td><td>Vigente</td></tr></table>"
    web = registry.from_html(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    assert [(r.page_id, r.codigo_estudio, r.titulo) for r in registry.registry_degrees(web, ["page_id"]).collect()] == [(1, "5", "Grado en Arte")]


def test_site_maps(spark):
    df = spark.createDataFrame([(1, "<urlset><loc> https://u.es/Grados </loc><LOC>https://u.es/x</LOC><loc>https://u.es/fisica</loc></urlset>", "Grado en fisica"), (2, None, None)], "k int, xml string, t string")
    assert sorted(r.url for r in registry.sitemap_urls(df, "k").collect()) == ["https://u.es/Grados"]
    assert sorted(r.url for r in registry.sitemap_urls(df, "k", words=registry.title_words(F.col("t"))).collect()) == ["https://u.es/Grados", "https://u.es/fisica"]


PAGE = """<fieldset><legend>Modificaciones del plan</legend><a href="/boe/dias/2012/01/02/x.pdf">BOE 3/4/2011</a></fieldset>
<table><tr><th>Publicación plan estudios</th><td><a href="/boe/dias/2013/13/02/y.pdf"><b>BOE</b></a></td></tr></table><strong>Acuerdo de Consejo de Ministros</strong><a href="/z.pdf">BOE</a>
<strong>Plan de estudios</strong><a href="/boe/dias/2007/01/02/old.pdf">BOE</a><a href="/a">nada</a><a name="x">sin</a>"""


def test_document_candidates(spark):
    pages = [(1, PAGE), (2, "<strong>Varios</strong><a href='/w.pdf'>Boletín</a><a href='/v.pdf'>1/1/2008</a><p>Extinción</p>"), (3, None), (4, "")]
    df = html.document_links(spark.createDataFrame(pages, "page_id long, html string"))
    got = [tuple(r) for r in registry.document_candidates(df, "page_id").orderBy("page_id", "place").collect()]
    assert got == [
        (1, 1, "https://www.boe.es/boe/dias/2012/01/02/x.pdf", "BOE 3/4/2011", datetime.date(2011, 4, 3), 100, "plan_correccion"), (1, 2, "https://www.boe.es/boe/dias/2013/13/02/y.pdf", "BOE", None, 90, "plan_inicial"),
        (2, 1, "https://www.boe.es/w.pdf", "Boletín", None, 30, "boe_general"),
    ]


def test_registry_list_is_whole(spark, data):
    rows = {r.codigo: r.nombre for r in catalogue.QUERIES["registry_universities"](spark, data).collect()}
    own = {f"{r.c_custkey:03d}": r.c_name for r in spark.read.parquet(f"{data}/customer.parquet").collect() if r.c_custkey % 7}
    assert rows == own and "001" in rows and len(rows) > 50


def test_preselection_by_year_and_type(spark):
    plans = {
        1: [(1, 6.0, "OP", "1"), (2, 90.0, "OB", "Curso 1º"), (3, 6.0, "FB", "2"), (4, 6.0, "FB", None)],
        2: [(1, 30.0, "OP", ""), (2, 30.0, "OB", " "), (3, 40.0, "FB", None), (4, 12.0, None, ""), (5, 0.0, "", ""), (6, 6.0, "TFG", ""), (7, None, "FB", ""), (8, 6.0, "FB", ""), (9, 6.0, "FB", "")],
        3: [(1, 6.0, "OB", "2")],
    }
    rows = spark.createDataFrame(list(plans.items()), "k long, x array<struct<i int, ects double, caracter string, curso string>>")
    got = {r.k: r.t for r in rows.select("k", state.preselect_plan(F.col("x")).alias("t")).collect()}
    assert got == {1: [1, 2], 2: [2, 4, 5, 7, 8], 3: []}
