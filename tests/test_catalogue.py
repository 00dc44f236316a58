"""Every query against its SQL, and the literal expectations of the rules."""

import pytest
from oracle import comparable, sql_rows
from pyspark.sql import functions as F

from campusquery.functions import money, text
from campusquery.operators import catalog, html, state
import campusquery.plans.administration  # noqa: F401  (registers its queries)
import campusquery.plans.extraction  # noqa: F401  (registers its queries)
import campusquery.plans.rules  # noqa: F401  (registers its queries)
from campusquery.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    rows = QUERIES[name](spark, data).toPandas()
    if name in ORACLE_SQL:
        assert comparable(rows) == sql_rows(ORACLE_SQL[name], data)
    else:
        assert len(rows)


def values(spark, column, *args):
    """``column(F.col(c0), ...)`` over the tuples ``args``."""
    rows = [(i, *a) for i, a in enumerate(args)]
    names = [f"c{k}" for k in range(len(args[0]))]
    kinds = ["double" if any(isinstance(a[k], float) for a in args) else "string" for k in range(len(names))]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return [r[0] for r in df.select("i", column(*map(F.col, names)).alias("v")).orderBy("i").select("v").collect()]


def test_required_credits(spark):
    got = values(spark, lambda a, b, c: money.required_credits(a, b, c), ("Grado", "Medicina", None), ("Grado", "Arquitectura", ""), ("Máster - RD", "Ingeniería Industrial", None), ("Máster", "Abogacía", None), ("Máster", "Historia", None), (None, None, "240"))
    assert got == [360, 300, 120, 90, 60, 240]


def test_degree_prices(spark):
    rows = [(1, "Andalucía", "Pública", "Grado", "Historia"), (2, "Comunidad de Madrid", "Universidad Pública", "Grado", "X"), (3, "Catalunya", "Pública", "Máster", "Abogacía"), (4, "Cataluña", "Pública", "Máster", "Arte"), (5, "", "Pública", "Grado", "X"), (6, "Marte", "Pública", "Grado", "X"), (7, "Galicia", "Privada", "Grado", "X")]
    df = spark.createDataFrame(rows, "id int, r string, k string, l string, t string")
    got = {r.id: r for r in money.degree_price(df, "r", "k", "l", "t").collect()}
    assert [str(got[1][f"precio_{k}"]) for k in (1, 2, 3, 4)] == ["12.62", "25.24", "54.40", "75.60"]
    assert str(got[1].precio_anual) == "816.30" and str(got[2].precio_anual) == "1348.40"
    assert str(got[3].precio_1) == "27.67" and str(got[4].precio_1) == "41.17"
    assert [got[k].precio_1 for k in (5, 6, 7)] == [None] * 3 and len({got[k].fuente_precio for k in (5, 6, 7)}) == 3
    assert [got[k].fuente_precio for k in (1, 5, 6, 7)] == [
        "Oficial SIIU / Decreto de Precios Públicos de las Universidades Públicas de Andalucía", "CCAA desconocida o no registrada (Sin CCAA)",
        "CCAA desconocida o no registrada (Marte)", "Universidad Privada (Tarifas fijadas por la institución)",
    ]


def test_discounts(spark):
    kinds = ["fn_general", "discapacidad", "beca_mec", "mh_bachillerato", "bonif_99", "otro", None]
    rows = [(i, k, p, 1000.0, 600.0, 10.0, 72.0, 36.0, own) for i, (k, p, own) in enumerate([(k, False, 20.0) for k in kinds] + [(k, True, 20.0) for k in kinds] + [("beca_mec", True, 0.0), ("mh_bachillerato", True, None)])]
    df = spark.createDataFrame(rows, "i int, kind string, private boolean, cost double, first double, base double, ects double, first_ects double, own double")
    d = money.discount(*[F.col(c) for c in ("kind", "private", "cost", "first", "base", "ects", "first_ects", "own")])
    got = [(round(r.d.amount, 2), r.d.fee_share) for r in df.select("i", d.alias("d")).orderBy("i").collect()]
    assert got == [
        (500.0, 0.5), (1000.0, 0.0), (600.0, 1.0), (600.0, 1.0), (594.0, 1.0), (0.0, 1.0), (0.0, 1.0),
        (0.0, 1.0), (0.0, 1.0), (720.0, 1.0), (1200.0, 1.0), (0.0, 1.0), (0.0, 1.0), (0.0, 1.0), (604.8, 1.0), (1008.0, 1.0),
    ]


def test_regions(spark):
    assert values(spark, text.region, ("",), (None,), ("Andalucía",), ("Euskadi",), ("Marte",)) == ["", "", "Andalucía", "País Vasco", "Marte"]


def test_prices(spark):
    assert values(spark, lambda c: text.price(c, 1, 45000), ("85,50",), ("1.250",), ("9.800,00",), ("invalid",)) == [85.5, 1250, 9800, None]
    assert values(spark, lambda c: text.price(c, 15, 500), ("5.0",)) == [None]


def test_years_and_terms(spark):
    six = lambda c: text.year(c, F.lit(6.0))
    assert values(spark, six, ("1º",), ("Segon",), ("iii",), ("4t",), ("5è curs",), ("año 6",), ("6",), ("Comunicación Oral y Escrita.",), (None,)) == ["1", "2", "3", "4", "5", "6", "", "", ""]
    assert values(spark, text.term, ("1º",), ("2º cuatrimestre",), ("anual",), ("S1",), ("otoño",), (None,)) == ["1C", "2C", "Anual", "1C", "otoño", ""]
    topic = values(spark, lambda a, b: text.displaced_topic(a, b, F.lit(6.0)), ("Comunicación", ""), ("Comunicación", "Lengua"), ("1º", ""))
    assert topic == ["Comunicación", "Lengua", ""]


def test_subject_types_keep_their_quirks(spark):
    assert values(spark, text.subject_type, ("Formación Básica",), ("Operaciones",), ("Pedagogía",), ("TFG",), ("Historia",), (None,)) == ["FB", "OP", "PE", "TFG/TFM", "OB", "OB"]


def test_text_cleaning(spark):
    assert values(spark, text.sanitize, ("aígolocisP ne odarG",), ("a  b\t;,",), (None,)) == ["Grado en Psicología", "a b", ""]
    assert values(spark, text.sanitize_subject, ("40147 - CÁLCULO I ...... ",)) == ["CÁLCULO I"]
    assert values(spark, text.csv_cell, ("=1+1",), ('a"b',), (None,)) == ["\"'=1+1\"", '"a""b"', '""']
    assert values(spark, lambda c: text.zfill(c, 3), ("7",), ("12345",)) == ["007", "12345"]


def test_credit_summary(spark):
    got = values(spark, text.credit_summary, ("Formación básica: 60 Obligatorias: 120 Optativas: 48 Trabajo fin de 12 Créditos totales 240",))[0]
    assert [got[k] for k in ("Formación Básica", "Obligatorias", "Optativas", "Créditos Totales")] == ["60", "120", "48", "240"]


def test_links_and_sites(spark):
    assert values(spark, text.valid_link, ("#",), ("mailto:a",), ("/x",), (None,)) == [False, False, True, False]
    assert values(spark, text.same_site, ("http://www.a.es/x", "https://b.a.es"), ("http://a.es", "http://b.es"), (None, "http://a.es")) == [True, False, False]
    assert values(spark, text.https, ("a.es",), ("http://a.es",), ("https://a.es",)) == ["https://a.es"] * 3


def test_distance(spark):
    df = spark.range(1).select(money.haversine_km(F.lit(36.5271), F.lit(-6.2886), F.lit(40.4168), F.lit(-3.7038)))
    assert df.first()[0] == 487.5


def test_html_tables():
    page = "<table><tr><th>Asignatura</th></tr><tr><td>Cálculo <b>I</b></td><td>6</td></tr></table>"
    assert html.table_rows(page) == [(0, 0, ["Asignatura"]), (0, 1, ["Cálculo I", "6"])]
    assert html.table_rows(None) == []


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", 5.0, False), (2, "b", 6.0, True)], "k int, t string, p double, admin boolean")
    new = spark.createDataFrame([(1, "", 0.0, None), (2, "x", 1.0, None), (3, "c", 2.0, None)], old.schema)
    got = {r.k: (r.t, r.p) for r in state.upsert(old, new, "k", ["t", "p"], protected="admin").collect()}
    assert got == {1: ("a", 5.0), 2: ("b", 6.0), 3: ("c", 2.0)}


def test_prune_needs_enough_keys(spark):
    old = spark.range(10).withColumnRenamed("id", "k")
    assert state.prune(old, old.filter("k < 3"), "k", 100).count() == 10
    assert state.prune(old, old.filter("k < 3"), "k", 3).count() == 3


def test_latest_version_keeps_a_first_row_without_number(spark):
    rows = [("t", "x", 1), ("t", "9", 2), ("u", "5", 3), ("u", "7", 4), ("u", "y", 5)]
    df = spark.createDataFrame(rows, "t string, code string, i int")
    assert sorted(r.code for r in state.latest_versions(df, ["t"], "code", "i").collect()) == ["7", "x"]


def test_merge_plans():
    first = {"courses": [{"nombre": "Cálculo (I)", "ects": "6", "curso": "1"}]}
    older = {"courses": [{"nombre": "cálculo", "ects": "6", "curso": "1"}, {"nombre": "Historia antigua universal", "ects": "6", "curso": "2"}, {"nombre": "Historia universal antigua", "ects": "6", "curso": "2"}]}
    assert [c["nombre"] for c in state.merge_plans([first, older], 240)["courses"]] == ["Cálculo (I)", "Historia antigua universal"]


def test_search_filters(spark, data):
    from campusquery.sources.tables import degrees, universities

    t, u = degrees(spark, data), universities(spark, data)
    assert catalog.search(t, u, field="salud").count() == 0
    assert catalog.search(t, u, field="todas").count() == t.count()
    assert catalog.search(t, u, university="7").count() == t.filter("u_key = 7").count()


def test_incremental_intake(spark, data, tmp_path):
    from campusquery.streaming.ingest import daily_counts

    events = spark.read.parquet(f"{data}/events.parquet")
    events.limit(500).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        daily_counts(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "ck"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] <= 500


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_addresses(spark):
    from campusquery.functions import web

    got = values(spark, web.normalize_url, ("http://https://a.es/x",), ("//a.es",), ("/boe/x",), ("http://wwww.boe.es/a",), ("'a.es'",), ("http://doe.gobex.es/?q",), (None,))
    assert got == ["https://a.es/x", "https://a.es", "https://www.boe.es/boe/x", "https://www.boe.es/a", "https://a.es", "https://doe.juntaex.es/?q", ""]
    score = values(spark, web.url_score, ("https://a.es/estudios/grado", "", "Grado"), ("https://a.es/becas", "", "Grado"), ("https://a.es/graus", "", "Grado"))
    assert score == [100, 1, 100]
