"""Commands, loads, state, sinks and figures on small tables, and what SQL doesn't hold."""

import json
import os

import pytest
from pyspark.sql import functions as F

from campusquery.functions import dates, money, web
from campusquery.operators import admin, catalog, directory, grid, html, load, metrics, state
from campusquery.plans import administration, extraction  # noqa: F401  (they register their queries)
from campusquery.plans.catalogue import QUERIES
from campusquery.sinks import files as sinks
from campusquery.sources import files
from campusquery.sources.tables import courses, read

UNI = "codigo string, nombre string, tipo string, gestionado_por_admin boolean"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_universities_are_created_once_and_changed_as_given(spark):
    unis = spark.createDataFrame([("007", "A", "Pública", False), ("12345", "B", None, None), ("x", "C", "Privada", True)], UNI)
    new = spark.createDataFrame([(0, "7", "n"), (1, "8", "n"), (2, "008", "otra"), (3, "x", "n")], "pos int, codigo string, nombre string")
    made, status = admin.create_universities(unis, new)
    assert rows(status, "pos", "status") == [(0, 400), (1, 201), (2, 400), (3, 201)]
    assert rows(made, "codigo", "nombre", "gestionado_por_admin")[1:3] == [("008", "n", True), ("00x", "n", True)]
    edits = [(0, "7", "Z", None, ["nombre", "tipo"]), (1, "7", "Y", "q", ["nombre"]), (2, "x", " ", None, ["nombre"]), (3, "x", None, "t", ["tipo"]), (4, "nada", "q", None, ["nombre"]), (5, "12345", None, None, [])]
    out, status = admin.update_universities(unis, spark.createDataFrame(edits, "pos int, codigo string, nombre string, tipo string, given array<string>"))
    assert rows(status, "pos", "status") == [(0, 200), (1, 200), (2, 422), (3, 200), (4, 404), (5, 200)]
    assert rows(out, "codigo", "nombre", "tipo", "gestionado_por_admin") == [("007", "Y", None, True), ("12345", "B", None, True), ("x", "C", "t", True)]


def test_deletions_take_what_hangs_on_them(spark):
    unis = spark.createDataFrame([("001", "A", "", False), ("002", "B", "", False)], UNI)
    degrees = spark.createDataFrame([("1", "001"), ("2", "002"), ("3", None)], "codigo_estudio string, universidad_codigo string")
    plans, kids = degrees.select("codigo_estudio"), degrees.select("codigo_estudio", F.lit("x").alias("n"))
    commands = spark.createDataFrame([(0, "1"), (1, "001"), (2, "9")], "pos int, codigo string")
    u, d, p, k, status = admin.delete_universities(unis, degrees, plans, kids, commands)
    assert rows(u, "codigo") == [("002",)] and rows(d, "codigo_estudio") == rows(p, "codigo_estudio") == rows(k, "codigo_estudio") == [("2",), ("3",)]
    assert rows(status, "pos", "status") == [(0, 204), (1, 404), (2, 404)]
    gone = spark.createDataFrame([(0, "2"), (1, "8")], "pos int, codigo_estudio string")
    d, p, k, status = admin.delete_degrees(degrees, plans, kids, gone)
    assert rows(d, "codigo_estudio") == rows(k, "codigo_estudio") == [("1",), ("3",)] and rows(status, "pos", "status") == [(0, 204), (1, 404)]


def test_degrees_need_a_university(spark):
    unis = spark.createDataFrame([("001", "A", "", False), ("zz", "B", "", False)], UNI)
    degrees = spark.createDataFrame([("1", "t", "e", "001", None)], "codigo_estudio string, titulo string, estado string, universidad_codigo string, gestionado_por_admin boolean")
    new = [(0, "1", "t", "", "1"), (1, "2", "t", None, "1"), (2, "2", "u", "", "1"), (3, "3", "t", "E", "zz"), (4, "4", "t", "", "5"), (5, "4", "t", "", "001")]
    out, status = admin.create_degrees(degrees, unis, spark.createDataFrame(new, "pos int, codigo_estudio string, titulo string, estado string, universidad_codigo string"))
    assert rows(status, "pos", "status") == [(0, 400), (1, 201), (2, 400), (3, 201), (4, 400), (5, 201)]
    assert rows(out, "codigo_estudio", "estado", "universidad_codigo", "gestionado_por_admin") == [("1", "e", "001", None), ("2", admin.STATE, "001", True), ("3", "E", "zz", True), ("4", admin.STATE, "001", True)]
    edit = [(0, "1", "", "", ["titulo"]), (1, "1", "x", " ", ["universidad_codigo"]), (2, "1", "x", "77", ["universidad_codigo"]), (3, "9", "x", "1", ["titulo"]), (4, "1", "nuevo", "1", ["titulo", "universidad_codigo"])]
    out, status = admin.update_degrees(degrees, unis, spark.createDataFrame(edit, "pos int, codigo_estudio string, titulo string, universidad_codigo string, given array<string>"))
    assert rows(status, "pos", "status") == [(0, 422), (1, 422), (2, 400), (3, 404), (4, 200)]
    assert rows(out, "titulo", "universidad_codigo", "gestionado_por_admin") == [("nuevo", "001", True)]


def test_courses_get_a_plan(spark):
    degrees, plans = spark.createDataFrame([("1",), ("2",)], "codigo_estudio string"), spark.createDataFrame([("1", "boe")], "codigo_estudio string, origen_fuente string")
    own = spark.createDataFrame([(10, "1", "a", "1")], "id long, codigo_estudio string, nombre_elemento string, curso string")
    new = spark.createDataFrame([(0, "1", "b"), (1, "2", "c"), (2, "3", "d"), (3, "2", "e")], "pos int, codigo_estudio string, nombre_elemento string")
    out, plans, status = admin.create_courses(own, plans, degrees, new)
    assert rows(plans, "codigo_estudio", "origen_fuente") == [("1", "boe"), ("2", "gestion_admin")] and rows(status, "pos", "status") == [(0, 201), (1, 201), (2, 404), (3, 201)]
    assert rows(out, "id", "codigo_estudio", "nombre_elemento") == [(10, "1", "a"), (11, "1", "b"), (12, "2", "c"), (14, "2", "e")]
    out, status = admin.update_courses(own, spark.createDataFrame([(0, 10, "z", ["curso"], None), (1, 5, "q", ["nombre_elemento"], "2")], "pos int, id long, nombre_elemento string, given array<string>, curso string"))
    assert rows(out, "nombre_elemento", "curso") == [("a", None)] and rows(status, "pos", "status") == [(0, 200), (1, 404)]
    out, status = admin.delete_courses(own, spark.createDataFrame([(0, 10), (1, 10)], "pos int, id long"))
    assert out.count() == 0 and rows(status, "pos", "status") == [(0, 204), (1, 404)]


def test_plan_files_of_a_folder(spark, tmp_path):
    plan = {"codigo_estudio": "5", "universidad_codigo": "9", "precio_credito_ects": 12.5, "boe_fecha": "2020-02-03", "plan_estudios": {"resumen_creditos": {"Total": "240"}, "elementos_curriculares": [{"nombre_elemento": "Cálculo", "creditos_ects": "6", "otro": 1}]}}
    (tmp_path / "a.json").write_text(json.dumps(plan, indent=2))
    (tmp_path / "b.json").write_text('{"codigo_estudio": ')
    (tmp_path / "c.json").write_text('{"titulo": "sin código"}')
    (tmp_path / "d.txt").write_text("no")
    got = files.plan_files(spark, str(tmp_path))
    assert rows(got, "file", "codigo_estudio") == [("a.json", "5"), ("c.json", None)]
    none = {
        "unis": "codigo string, nombre string, tipo string", "degrees": "codigo_estudio string, titulo string, nivel_academico string, estado string, universidad_codigo string, " + ", ".join(f"{c} {k}" for c, k in load.PRICES.items()),
        "plans": "codigo_estudio string, boe_url string, boe_fecha date, origen_fuente string, pdf_sha256 string", "summaries": "codigo_estudio string, tipo_credito string, cantidad_creditos string",
        "courses": "codigo_estudio string, nombre_elemento string, creditos_ects string, orden int",
    }
    out = load.load_plans(got, *[spark.createDataFrame([], s) for s in none.values()])
    assert rows(out["universities"], "codigo", "nombre", "tipo") == [("009", "Universidad 009", "Desconocido")]
    assert rows(out["degrees"], "codigo_estudio", "titulo", "universidad_codigo", "precio_credito_ects") == [("5", "Estudio 5", "009", 12.5)]
    assert [str(r.boe_fecha) for r in out["plans"].collect()] == ["2020-02-03"] and rows(out["summaries"], "tipo_credito", "cantidad_creditos") == [("Total", "240")]
    assert rows(out["courses"], "codigo_estudio", "nombre_elemento", "creditos_ects", "orden") == [("5", "Cálculo", "6", 0)]


def test_sinks(spark, tmp_path):
    path, one = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.replace(one, path)
    sinks.replace(spark.read.parquet(path).withColumn("v", F.upper("v")), path)  # reads what it replaces
    assert rows(spark.read.parquet(path), "k", "v") == [(1, "A"), (2, "B")]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|assert"):
        sinks.replace_all({path: one, str(tmp_path / "u"): one.select(F.raise_error(F.lit("assert")).cast("int").alias("x"))})
    assert rows(spark.read.parquet(path), "k", "v") == [(1, "A"), (2, "B")] and sorted(os.listdir(tmp_path)) == ["t"]
    news = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1)], "k int, v string, o int")
    sinks.put(news.drop("o").filter("v is null"), str(tmp_path / "s"), "k")
    sinks.put(spark.createDataFrame([(2, "x"), (3, "z")], "k int, v string"), str(tmp_path / "s"), "k")
    assert rows(spark.read.parquet(str(tmp_path / "s")), "k", "v") == [(2, "x"), (3, "z")]
    sinks.put(news.select("k", "v", "o"), str(tmp_path / "o"), "k", "o")
    assert rows(spark.read.parquet(str(tmp_path / "o")), "k", "v") == [(2, "y"), (3, None)]
    for _ in range(2):
        sinks.log_errors(spark, [("fase", "1", "u", "m", None)], str(tmp_path / "log"))
    assert rows(spark.read.parquet(str(tmp_path / "log")), "fase", "detalles_excepcion") == [("fase", "")] * 2


def test_files_for_people(spark, tmp_path):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["=1+1", 'a"b', None, "ñ"])], "k int, v string").repartition(3).orderBy("k")
    sinks.write_sheet(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text(encoding="utf-8") == '﻿k,v\n"0","\'=1+1"\n"1","a""b"\n"2",""\n"3","ñ"\n'
    sinks.write_pretty(df, str(tmp_path / "x.json"))
    sinks.write_pretty(df, str(tmp_path / "x.json"))
    text = (tmp_path / "x.json").read_text(encoding="utf-8")
    assert json.loads(text) == [{"k": k, "v": v} for k, v in enumerate(["=1+1", 'a"b', None, "ñ"])] and '\n  "k" : 0' in text
    sinks.write_pretty(df.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == [] and sorted(os.listdir(tmp_path))[-1] == "x.json"


def test_folder_size(spark, data, tmp_path):
    (tmp_path / "a").mkdir()
    for name, n in (("x", 3_000_000), ("a/y", 17), ("a/z", 1)):
        (tmp_path / name).write_bytes(b"x" * n)
    assert rows(files.folder_size(spark, str(tmp_path)), "files", "bytes", "mb", "gb") == [(3, 3_000_018, 2.86, 0.003)]
    (r,) = QUERIES["folder_size"](spark, data).collect()
    assert r.bytes == sum(os.path.getsize(os.path.join(data, f)) for f in os.listdir(data))


def test_saves_are_spread(spark, data):
    """Every user's saves, one after another."""
    got = {(r.user_id, r.event_id): r.done for r in QUERIES["save_throttle"](spark, data).collect()}
    last, events = {}, sorted(read(spark, data, "events").collect(), key=lambda r: r.event_id)
    assert len(got) == len(events)
    for r in events:
        now = int(r.ts.timestamp())
        go = r.event_type == "error" or r.user_id not in last or now - last[r.user_id] >= 30 * 3600
        last[r.user_id] = now if go else last[r.user_id]
        assert got[r.user_id, r.event_id] == go


def merged_by_hand(docs, required, rejected):
    """The rules of the merge one by one, as the survey tells them."""
    plan, names, k = [], [], -1
    for doc in docs:
        k += 1
        if doc["hash"] in rejected:
            continue
        covered = {}
        for name, year, ects in plan:
            covered[year] = covered.get(year, 0) + ects
        for c in doc["courses"]:
            name = c["nombre"].lower()
            if k > 0 and covered.get(c["curso"], 0) >= 55:
                continue
            if name in names:
                continue
            words = {w for w in name.split() if len(w) > 3}
            if k > 0 and words and any(len(words & {w for w in n.split() if len(w) > 3}) >= max(2, len(words) - 1) for n in names):
                continue
            names.append(name)
            plan.append((name, c["curso"], float(c["ects"])))
        if sum(e for *_, e in plan) >= required:
            break
    return [n for n, *_ in plan]


def test_merged_plans_of_all_degrees(spark, data):
    got = {}
    for r in sorted(QUERIES["merge_plans"](spark, data).collect(), key=lambda r: r.pos):
        got.setdefault(r.codigo_estudio, []).append(r.nombre)
    own = {}
    for r in sorted(courses(spark, data).collect(), key=lambda r: (r.codigo_estudio, r.l_suppkey, r.orden, r.l_partkey, r.l_extendedprice)):
        own.setdefault(r.codigo_estudio, []).append(r.asDict())
    want = {code: merged_by_hand(extraction.plan_documents(items), 120, {"0"}) for code, items in own.items()}
    assert got == {k: v for k, v in want.items() if v} and any(len(v) < len(own[k]) for k, v in want.items())


def test_merge_of_summaries_and_rejected_documents():
    course = lambda n, y="1", e="6": {"nombre": n, "ects": e, "curso": y}
    out = state.merge_plans([{"hash": "r", "courses": [course("Nunca")]}, {"hash": "e", "courses": [], "summary": {}}, {"hash": "a", "courses": [], "summary": {"Total": "240"}}, {"hash": "b", "courses": [course("Física", None, None), course("Física")], "summary": {"Total": "60", "OB": "6"}}], 240, {"r"})
    assert [c["nombre"] for c in out["courses"]] == ["Física"] and out["summary"] == {"Total": "240", "OB": "6"} and out["rejected"] == ["e"] and out["documents"] == 2
    full = [{"courses": [course(f"Uno {k}x", "1", "30") for k in "ab"]}, {"courses": [course("Nueva"), course("Otra", "2")]}]
    assert [c["nombre"] for c in state.merge_plans(full, 240)["courses"]] == ["Uno ax", "Uno bx", "Otra"]
    assert len(state.merge_plans(full, 60)["courses"]) == 2


def test_state_rules(spark):
    old = spark.createDataFrame([("1", "u", "f", "t0")], "k string, url string, fecha string, stamp string")
    new = spark.createDataFrame([(1, "1", "", "f2", "t1"), (2, "1", None, "null", "t2"), (3, "2", None, None, "t3"), (4, " ", "x", "y", "t4"), (5, None, "x", "y", "t5")], "o int, k string, url string, fecha string, stamp string")
    assert rows(state.record(old, new, "k", ["url", "fecha"], "stamp", "o"), "k", "url", "fecha", "stamp") == [("1", "u", "f2", "t2"), ("2", None, None, "t3")]
    log = spark.createDataFrame([("a", i, x) for i, x in enumerate("ffffnfsffffffffff")], "k string, i int, x string")
    trips = state.breaker(log, "k", ["i"], F.col("x") == "f", F.col("x") == "n", 5, 2)
    assert rows(trips, "trip", "action", "i") == [(1, "pausa", 5), (2, "salto", 11)]
    item = spark.createDataFrame([("a", "x"), ("b", None), (None, "y")], "a string, b string")
    assert rows(state.unrejected(item, {"a": item.filter("a = 'a'").select("a"), "b": item.select("b")}), "a", "b") == [("b", None)]


def test_figures_without_rows(spark):
    events = spark.createDataFrame([], "ts timestamp, event_id long, value double, event_type string")
    assert rows(metrics.conversion(events, ["ts"], F.lit(True), F.lit(True)), "views", "searches", "pct") == [(0, 0, 0.0)]
    assert rows(metrics.api_stats(events, ["ts", "event_id"], "value", F.lit(True)), "n", "mean_ms", "error_pct", "recent") == [(0, 0, 0, [])]
    zero = spark.createDataFrame([(1.0, 1.0, 0, 0, 0, 5, 0)], "io_seconds double, parse_seconds double, degrees int, pdfs int, hits int, pdf_bytes long, json_bytes long")
    assert rows(metrics.derived(zero), "io_per_degree", "parse_per_pdf", "hit_pct", "pdf_to_json", "g_co2") == [(0.0, 0.0, 0.0, 1.0, 0.0)]


def test_dates(spark):
    df = spark.createDataFrame([("2020-1-5", "2024-05-06T07:08:09"), ("20-1-5", "2024-05-06T07:08:09Z"), ("2021-02-29", "x"), (None, None)], "a string, b string")
    got = df.select(dates.plain_date(F.col("a")).cast("string").alias("a"), dates.iso_time(F.col("b")).cast("string").alias("b")).collect()
    assert [tuple(r) for r in got] == [("2020-01-05", "2024-05-06 07:08:09"), (None, None), (None, None), (None, None)]


def test_addresses_of_links(spark):
    page = '<a href="grados/x">Ver</a><a href="//a.es/master">M</a><a href="http://[grado">roto</a><a href="https://b.a.es/?grado"><b>Sub</b></a><a href="https://c.es/grado">fuera</a><a href="/nada">nada</a>'
    df = spark.createDataFrame([(1, "https://www.a.es/dir/p?q", page), (2, None, page), (3, "https://a.es", None)], "page_id long, url string, html string")
    assert rows(html.site_links(df), "page_id", "url", "label") == [(1, "https://a.es/master", "M"), (1, "https://b.a.es/?grado", "Sub"), (1, "https://www.a.es/dir/grados/x", "Ver")]
    words = df.limit(1).select(web.match_words(F.lit("Máster en la  Física de Los Sólidos")).alias("w")).first().w
    assert words == ["Física", "Sólidos"]


def test_orders_and_filters(spark):
    unis = spark.createDataFrame([("1", "Zamora", "Pública", "", "", ""), ("2", "Ávila", None, None, None, None), ("3", "Nube", "publica", "Puerto", "Real", "X"), ("4", "Ñora", "Pública", "", "", ""), ("5", "avión", "Pública", "", "", "")], "codigo string, nombre string, tipo string, municipio string, provincia string, ccaa string")
    assert [r.codigo for r in directory.directory_page(unis).collect()] == ["5", "3", "4", "1", "2"]
    assert [r.codigo for r in directory.directory(unis, "puerto real").collect()] == ["3"] and directory.directory(unis, "%").count() == 0
    assert directory.incidents(unis.withColumn("fase", F.lit("A")), "", ()).count() == 5
    assert rows(catalog.with_city(unis.withColumn("provincia", F.lit("Las Palmas")), "nombre", "provincia"), "codigo", "place")[1][1].city == "Palma de Mallorca"


def test_tuition_of_a_simulation(spark):
    df = spark.range(1)
    of = lambda *a: df.select(money.flat_simulation(*[F.lit(x).cast("double") if k != 1 else F.lit(x) for k, x in enumerate(a)]).alias("s")).first().s
    assert [round(of(*a).total, 2) for a in ((60, 1, 20, 900), (60, 2, None, 900), (30, 4, 0, 0), (9, 3, None, None))] == [1200, 1350, 2268, 453.6]
    assert [of(c, 1, 1, 1).n for c in (60, 9, 2)] == [10, 2, 0]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_course_tables_shuffle_once(spark):
    raw = spark.createDataFrame([(k % 7, 0, k, ["Código", str(k)]) for k in range(40)], "doc long, table int, row int, cells array<string>")
    assert exchanges(grid.courses(grid.table_lines(raw, "doc"), "doc")) == 1
    pages = spark.createDataFrame([(k % 7, k, "ANEXO", "t", "u") for k in range(40)], "doc long, page int, text string, titulo string, universidad string")
    assert exchanges(grid.degree_pages(pages, "doc")) <= 2


def test_one_load_at_a_time(spark, tmp_path):
    lock = str(tmp_path / "lock")
    with sinks.sole_writer(spark, lock):
        with pytest.raises(BlockingIOError), sinks.sole_writer(spark, lock):
            pass
        assert os.path.exists(lock)
    assert not os.path.exists(lock)
    (tmp_path / "lock").write_text("")
    os.utime(lock, (0, 0))
    with sinks.sole_writer(spark, lock):
        pass


def test_documents_of_the_crawler(spark, tmp_path):
    (tmp_path / "state.json").write_text(json.dumps({"processed_universities": ["1", "2"], "processed_degrees": {"a": {"boe_url": "u"}}, "non_study_plan_pdfs": [], "x": 1}, indent=1))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "errors.json").write_text(json.dumps([{"timestamp": "2024-05-06T07:08:09", "id_entidad": "1"}, {"timestamp": "ayer", "fase": "f"}], indent=1))
    assert rows(metrics.checkpoint_sizes(files.checkpoint(spark, str(tmp_path / "state.json"))), "universities", "degrees", "rejected", "failed") == [(2, 1, 0, 0)]
    assert files.checkpoint(spark, str(tmp_path / "broken.json")).count() == files.error_log(spark, str(tmp_path / "broken.json")).count() == 0
    got = files.error_log(spark, str(tmp_path / "errors.json")).orderBy("pos").collect()
    assert [(str(r.timestamp), r.fase, r.id_entidad) for r in got] == [("2024-05-06 07:08:09", None, "1"), ("None", "f", None)]
