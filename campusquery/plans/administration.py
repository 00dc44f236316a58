"""Queries over the directory, the commands of an administrator, the load of plan files, state and figures of a crawl.

Tables that are stored, and what arrives, are made from the catalogue by the remainders of its keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from campusquery.functions import dates, fixed, money, text, web
from campusquery.operators import admin, catalog, directory, html, load, metrics, state
from campusquery.sources import files
from campusquery.sources.tables import SQL_VIEWS, courses, degrees, read, universities

from .catalogue import pick, q, query, sql_any, sql_pick


# Directory

TOWNS = ("Cádiz", "Jerez de la Frontera", "Puerto Real")
NAMES = ("Ávila", "Zamora", "avión", "Ñora", "Nuevo", "Nube", "ábaco")


@query(f"SELECT codigo, nombre FROM u WHERE contains(lower(nombre || ' ' || {sql_pick('u_key', *TOWNS)} || ' ' || provincia), 'real nation') AND contains(lower(tipo), 'pública') AND contains(lower(ccaa), 'as')")
def directory_filter(spark, d):
    u = universities(spark, d).withColumn("municipio", pick("u_key", *TOWNS))
    return directory.directory(u, "REAL Nation", "pública", "AS").select("codigo", "nombre")


@query(f"SELECT codigo, {sql_pick('u_key', *NAMES)} || ' ' || codigo AS nombre FROM u ORDER BY CASE WHEN tipo = 'Pública' THEN 0 ELSE 1 END, nombre COLLATE es, codigo LIMIT 60 OFFSET 60")
def directory_order(spark, d):
    """The second page of the directory; "Ñ" follows "N", and accents don't part letters."""
    u = universities(spark, d).withColumns({"nombre": F.concat_ws(" ", pick("u_key", *NAMES), "codigo"), "municipio": F.lit("")})
    return directory.directory_page(u, 2, 60).select("codigo", "nombre")


@query("SELECT codigo, nombre FROM u WHERE tipo ILIKE '%priv%' AND ccaa ILIKE '%a_ia%' ORDER BY nombre, codigo LIMIT 40 OFFSET 5")
def universities_page(spark, d):
    return directory.universities_page(universities(spark, d), 5, 40, kind="PRIV", region="a_ia").select("codigo", "nombre")


KINDS = ("Universidad Pública", "publica", "Privada de la Iglesia", "Otra", None)
LEVELS = ("Grado", "Máster - RD 822", "master", "Doctor - RD 99/2011", "RD 99/2011", "Otro")


@query(f"""WITH k AS (SELECT c_custkey AS id, lower(coalesce({sql_pick('c_custkey', *KINDS)}, '')) AS t FROM customer)
SELECT id, contains(t, 'pública') OR contains(t, 'publica') AS publica, contains(t, 'privada') AS privada, true AS todas FROM k""", views=False)
def university_pills(spark, d):
    kind = pick("c_custkey", *KINDS)
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[directory.university_pill(kind, p).alias(n) for p, n in (("Pública", "publica"), ("Privada", "privada"), ("Todas", "todas"))])


@query(f"""WITH k AS (SELECT p_partkey AS id, lower({sql_pick('p_partkey', *LEVELS)}) AS n, lower({sql_pick('p_partkey', 'Grado en Arte', 'Doctorado en Arte', 'X', 'Y')}) AS t FROM part)
SELECT id, contains(n, 'grado') AS grado, contains(n, 'máster') OR contains(n, 'master') AS master, contains(n, 'doctor') OR contains(n, '99/2011') OR contains(t, 'doctor') AS doctorado FROM k""", views=False)
def degree_pills(spark, d):
    level, title = pick("p_partkey", *LEVELS), pick("p_partkey", "Grado en Arte", "Doctorado en Arte", "X", "Y")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), *[directory.degree_pill(level, title, p).alias(n) for p, n in (("Grado", "grado"), ("Máster", "master"), ("Doctorado", "doctorado"))])


STATES = ("Vigente", "Extinguida", "SUPRIMIDA", "No vigente", "Extinto")


@query(f"""WITH k AS (SELECT p_partkey AS id, lower({sql_pick('p_partkey', *LEVELS)}) AS n, lower({sql_pick('p_partkey', *STATES)}) AS e, lower(CASE WHEN p_partkey % 7 = 0 THEN 'Doctorado en ' ELSE 'Grado en ' END || p_name) AS t FROM part)
SELECT id, CASE WHEN contains(n, 'doctor') OR contains(n, '99/2011') OR contains(t, 'doctor') THEN 'Doctorado' WHEN contains(n, 'máster') OR contains(n, 'master') THEN 'Máster' ELSE 'Grado Oficial' END AS badge,
  contains(e, 'extin') OR contains(e, 'suprim') OR contains(e, 'no vigente') AS extinct FROM k""", views=False)
def level_badge(spark, d):
    title = F.concat(F.when(F.col("p_partkey") % 7 == 0, "Doctorado en ").otherwise("Grado en "), "p_name")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), directory.badge(pick("p_partkey", *LEVELS), title).alias("badge"), directory.fading(pick("p_partkey", *STATES)).alias("extinct"))


@query("SELECT event_id FROM events WHERE contains(lower(event_type), 'ew') OR contains(user_id::VARCHAR, 'ew') OR contains(lower('motivo ' || event_id), 'ew') OR contains('https://u.es/' || event_id % 9, 'ew')", views=False)
def incident_search(spark, d):
    e = read(spark, d, "events")
    log = e.select("event_id", F.col("event_type").alias("fase"), F.col("user_id").cast("string").alias("id_entidad"), F.concat(F.lit("motivo "), "event_id").alias("motivo_fallo"), F.concat(F.lit("https://u.es/"), F.col("event_id") % 9).alias("url"))
    return directory.incidents(log, "EW").select("event_id")


@query("SELECT codigo_estudio, orden, row_number() OVER (PARTITION BY codigo_estudio ORDER BY nullif(curso, '3') NULLS LAST, nombre, orden)::INTEGER AS place FROM a")
def courses_in_order(spark, d):
    c = courses(spark, d).withColumn("curso", F.nullif(F.col("curso"), F.lit("3")))
    return directory.courses_in_order(c, "codigo_estudio").select("codigo_estudio", "orden", "place")


@query("SELECT u_key, codigo_estudio, row_number() OVER (PARTITION BY u_key ORDER BY codigo_estudio DESC)::INTEGER AS place FROM t QUALIFY place <= 3")
def degrees_last_first(spark, d):
    return directory.last_first(degrees(spark, d).select("u_key", "codigo_estudio"), "u_key", "codigo_estudio", 3)


@query("""WITH k AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '' END AS materia, CASE p_partkey % 4 WHEN 0 THEN 'MENCIÓN en ' || p_type WHEN 1 THEN 'Itinerario' WHEN 2 THEN '' ELSE 'Bloque' END AS modulo FROM part),
l AS (SELECT id, coalesce(nullif(materia, ''), nullif(modulo, '')) AS l FROM k)
SELECT id, coalesce(l, '-') AS label, coalesce(regexp_matches(l, '(?i)menci|itinerari|especialid'), false) AS marked FROM l""", views=False)
def specialisations(spark, d):
    k = F.col("p_partkey")
    topic = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "")
    module = F.when(k % 4 == 0, F.concat(F.lit("MENCIÓN en "), "p_type")).when(k % 4 == 1, "Itinerario").when(k % 4 == 2, "").otherwise("Bloque")
    return read(spark, d, "part").select(k.alias("id"), directory.specialised(topic, module).alias("s")).select("id", "s.label", "s.marked")


PLACE_SQL = f"lower(nombre || ' ' || {sql_pick('u_key', 'Getafe', 'Vigo', 'Elche', '', 'Ferrol')} || ' ' || provincia || ' ' || {sql_pick('u_key', 'Castilla y León', 'Galicia', 'Comunitat Valenciana', 'Marte', 'Andalucía', 'Las Palmas', 'La Rioja')})"
CITY_SQL = "CASE " + " ".join(f"WHEN contains(p, {q(k)}) OR contains(p, {q(prov.lower())}) THEN {q(name)}" for k, _, _, prov, name in fixed.CITIES) + " ELSE 'Madrid' END"


@query(f"SELECT u_key, {CITY_SQL} AS city FROM (SELECT u_key, {PLACE_SQL} AS p FROM u)")
def city_of_university(spark, d):
    """City by name, municipality, province and region together; the first city of the list that one of them names counts."""
    u = universities(spark, d).withColumns({"municipio": pick("u_key", "Getafe", "Vigo", "Elche", "", "Ferrol"), "ccaa": pick("u_key", "Castilla y León", "Galicia", "Comunitat Valenciana", "Marte", "Andalucía", "Las Palmas", "La Rioja")})
    return catalog.with_city(u, "nombre", "municipio", "provincia", "ccaa").select("u_key", "place.city")


FAMILY = ("Historia del Arte", "MEDICINA", "Derecho", "Química", "Óptica", "INFORMÁTICA", "Música y Arte", "Turismo")
ASKED = ("Salud", "Ingeniería y Arquitectura", "Ciencias Sociales", "Artes y Humanidades", "Ciencias Experimentales")


@query("WITH k AS (SELECT o_orderkey AS codigo_estudio, " + sql_pick("o_orderkey", *FAMILY) + " AS t FROM orders) SELECT codigo_estudio, " + ", ".join(f"regexp_matches(t, {q('(?i)' + p)}) AS f{k}" for k, (_, p) in enumerate(fixed.FIELDS)) + " FROM k", views=False)
def field_families(spark, d):
    title = pick("codigo_estudio", *FAMILY)
    return degrees(spark, d).select("codigo_estudio", *[title.rlike(f"(?iu){text.field_pattern(a)}").alias(f"f{k}") for k, a in enumerate(ASKED)])


# Commands

UNIS = "s AS (SELECT codigo, nombre, tipo, u_key FROM u WHERE u_key % 2 = 0), "


def stored_universities(spark, d):
    return universities(spark, d).filter("u_key % 2 = 0").select("codigo", "nombre", "tipo", F.lit(False).alias(admin.MARK))


def university_commands(spark, d):
    """Commands to create, update and delete, as their keys' remainders have it."""
    u = universities(spark, d).withColumns({"pos": F.col("u_key"), "codigo": F.col("u_key").cast("string")})
    new = u.filter("u_key % 3 = 0").select("pos", "codigo", F.concat("nombre", F.lit(" nueva")).alias("nombre"), "tipo")
    given = F.when(F.col("u_key") % 4 == 0, F.array(F.lit("nombre"), F.lit("tipo"))).otherwise(F.array(F.lit("nombre")))
    name = F.when(F.col("u_key") % 15 == 0, "  ").otherwise(F.concat("nombre", F.lit(" bis")))
    edit = u.filter("u_key % 5 = 0").select("pos", "codigo", name.alias("nombre"), F.lit(None).cast("string").alias("tipo"), given.alias("given"))
    return new, edit, u.filter("u_key % 7 = 0").select("pos", "codigo")


@query("""SELECT codigo, CASE WHEN u_key % 2 = 1 THEN nombre || ' nueva' WHEN u_key % 5 = 0 AND u_key % 15 <> 0 THEN nombre || ' bis' ELSE nombre END AS nombre,
  CASE WHEN u_key % 20 = 0 AND u_key % 15 <> 0 THEN NULL ELSE tipo END AS tipo, u_key % 2 = 1 OR (u_key % 5 = 0 AND u_key % 15 <> 0) AS gestionado_por_admin
FROM u WHERE (u_key % 2 = 0 OR u_key % 3 = 0) AND NOT (u_key % 2 = 0 AND u_key % 7 = 0)""")
def crud_universities(spark, d):
    """Universities after edits of what was stored, deletions of the same, and new ones."""
    unis, none = stored_universities(spark, d), spark.createDataFrame([], "universidad_codigo string, codigo_estudio string")
    new, edit, gone = university_commands(spark, d)
    made, _ = admin.create_universities(unis, new)
    changed, _ = admin.update_universities(made, edit.filter("pos % 2 = 0"))
    left, *_ = admin.delete_universities(changed, none, none, none, gone.filter("pos % 2 = 0"))
    return left


@query("""SELECT 'create' AS op, u_key AS pos, CASE WHEN u_key % 2 = 0 THEN 400 ELSE 201 END AS status FROM u WHERE u_key % 3 = 0
UNION ALL SELECT 'update', u_key, CASE WHEN u_key % 2 = 1 THEN 404 WHEN u_key % 15 = 0 THEN 422 ELSE 200 END FROM u WHERE u_key % 5 = 0
UNION ALL SELECT 'delete', u_key, CASE WHEN u_key % 2 = 1 THEN 404 ELSE 204 END FROM u WHERE u_key % 7 = 0""")
def crud_university_statuses(spark, d):
    unis, none = stored_universities(spark, d), spark.createDataFrame([], "universidad_codigo string, codigo_estudio string")
    new, edit, gone = university_commands(spark, d)
    done = {"create": admin.create_universities(unis, new)[-1], "update": admin.update_universities(unis, edit)[-1], "delete": admin.delete_universities(unis, none, none, none, gone)[-1]}
    a, b, c = (x.select(F.lit(op).alias("op"), "pos", "status") for op, x in done.items())
    return a.union(b).union(c)


@query("""SELECT 'degrees' AS what, count(*) AS n FROM t WHERE NOT (u_key % 2 = 0 AND u_key % 7 = 0) UNION ALL SELECT 'courses', count(*) FROM a JOIN t USING (codigo_estudio) WHERE NOT (u_key % 2 = 0 AND u_key % 7 = 0)
UNION ALL SELECT 'universities', count(*) FROM u WHERE u_key % 2 = 0 AND u_key % 7 <> 0""")
def cascade_delete(spark, d):
    """What is left after universities are deleted with their degrees and courses."""
    t = degrees(spark, d).join(universities(spark, d).select("u_key", F.col("codigo").alias("universidad_codigo")), "u_key").select("codigo_estudio", "universidad_codigo")
    *_, gone = university_commands(spark, d)
    unis, left, _, rest, _ = admin.delete_universities(stored_universities(spark, d), t, t, courses(spark, d, names=False), gone)
    out = [x.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, x in (("degrees", left), ("courses", rest), ("universities", unis))]
    return out[0].union(out[1]).union(out[2])


def stored_degrees(spark, d):
    u = universities(spark, d).select("u_key", F.col("codigo").alias("universidad_codigo"))
    return degrees(spark, d).filter("codigo_estudio % 2 = 0").join(u, "u_key").select("codigo_estudio", "titulo", "estado", "universidad_codigo", F.lit(False).alias(admin.MARK))


def degree_commands(spark, d):
    t = degrees(spark, d)
    new = t.filter("codigo_estudio % 3 = 0").select(F.col("codigo_estudio").alias("pos"), "codigo_estudio", "titulo", F.lit("").alias("estado"), F.col("u_key").cast("string").alias("universidad_codigo"))
    k = F.col("codigo_estudio")
    both = F.when(k % 10 == 0, F.array(F.lit("titulo"), F.lit("universidad_codigo"))).otherwise(F.array(F.lit("titulo")))
    title, uni = F.when(k % 25 == 0, "").otherwise(F.concat("titulo", F.lit(" bis"))), F.when(k % 35 == 0, " ").otherwise((F.col("u_key") + 1).cast("string"))
    edit = t.filter("codigo_estudio % 5 = 0").select(k.alias("pos"), "codigo_estudio", title.alias("titulo"), uni.alias("universidad_codigo"), both.alias("given"))
    return new, edit


EDITED = """CASE WHEN codigo_estudio % 2 = 1 THEN 404 WHEN codigo_estudio % 25 = 0 OR codigo_estudio % 70 = 0 THEN 422 WHEN u_key % 2 = 0 OR u_key + 1 > (SELECT max(c_custkey) FROM customer) THEN 400 ELSE 200 END"""


@query(f"""SELECT 'create' AS op, codigo_estudio AS pos, CASE WHEN codigo_estudio % 2 = 0 OR u_key % 2 = 1 THEN 400 ELSE 201 END AS status FROM t WHERE codigo_estudio % 3 = 0
UNION ALL SELECT 'update', codigo_estudio, {EDITED} FROM t WHERE codigo_estudio % 5 = 0""")
def crud_degree_statuses(spark, d):
    unis, t = stored_universities(spark, d), stored_degrees(spark, d)
    new, edit = degree_commands(spark, d)
    a, b = (x[-1].select(F.lit(op).alias("op"), "pos", "status") for op, x in (("create", admin.create_degrees(t, unis, new)), ("update", admin.update_degrees(t, unis, edit))))
    return a.union(b)


@query(f""", e AS (SELECT *, codigo_estudio % 5 = 0 AND {EDITED} = 200 AS done, CASE WHEN length((u_key + 1)::VARCHAR) < 3 THEN lpad((u_key + 1)::VARCHAR, 3, '0') ELSE (u_key + 1)::VARCHAR END AS next FROM t)
SELECT codigo_estudio, CASE WHEN done THEN titulo || ' bis' ELSE titulo END AS titulo, estado, CASE WHEN done THEN next ELSE codigo END AS universidad_codigo, done AS gestionado_por_admin FROM e JOIN u USING (u_key) WHERE codigo_estudio % 2 = 0
UNION ALL SELECT codigo_estudio, titulo, 'Publicado en B.O.E.', codigo, true FROM t JOIN u USING (u_key) WHERE codigo_estudio % 6 = 3 AND u_key % 2 = 0""")
def crud_degrees(spark, d):
    unis, t = stored_universities(spark, d), stored_degrees(spark, d)
    new, edit = degree_commands(spark, d)
    changed, _ = admin.update_degrees(t, unis, edit)
    return admin.create_degrees(changed, unis, new)[0]


@query("""SELECT codigo_estudio, origen_fuente, n FROM (SELECT codigo_estudio, CASE WHEN codigo_estudio % 4 = 0 THEN 'boe' ELSE 'gestion_admin' END AS origen_fuente FROM t WHERE codigo_estudio % 4 = 0 OR codigo_estudio % 6 = 0)
JOIN (SELECT codigo_estudio, count(a.orden) + CASE WHEN codigo_estudio % 6 = 0 THEN 1 ELSE 0 END AS n FROM t LEFT JOIN a USING (codigo_estudio) GROUP BY 1) USING (codigo_estudio)""")
def crud_courses(spark, d):
    """Plans and their number of courses after a course is added to every third degree; only even ones exist, and half of these have a plan."""
    c = courses(spark, d, names=False).select((F.col("codigo_estudio") * 10 + F.col("orden")).alias("id"), "codigo_estudio", F.lit("x").alias("nombre_elemento"))
    t, plans = stored_degrees(spark, d), degrees(spark, d).filter("codigo_estudio % 4 = 0").select("codigo_estudio", F.lit("boe").alias("origen_fuente"))
    commands = degrees(spark, d).filter("codigo_estudio % 3 = 0").select(F.col("codigo_estudio").alias("pos"), "codigo_estudio", F.lit("nueva").alias("nombre_elemento"))
    rows, plans, _ = admin.create_courses(c, plans, t, commands)
    counts = rows.groupBy("codigo_estudio").agg(F.count("*").alias("n"))
    return plans.join(counts, "codigo_estudio", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# The load of plan files

PRICED = {"precio_credito_ects": 1, "precio_credito_2": 2, "precio_credito_3": 3, "precio_credito_4": 4}


def plan_documents(spark, d):
    """A file for every fifth degree, and a second one for every fifteenth."""
    k = F.col("codigo_estudio")
    course = F.struct(*[F.lit(x).alias(n) for n, x in zip(("modulo", "materia", "nombre_elemento", "creditos_ects", "caracter", "curso", "cuatrimestre"), ("", "", "Nueva", "6", "OB", "1", "1C"), strict=True)])
    t = degrees(spark, d).join(universities(spark, d).select("u_key", "nombre"), "u_key")

    def made(file: str, factor: int):
        return t.select(
            F.concat(F.lit(file), k).alias("file"), k.cast("string").alias("codigo_estudio"), F.col("u_key").cast("string").alias("universidad_codigo"), F.when(F.col("u_key") % 4 == 0, F.col("nombre")).alias("universidad_nombre"),
            F.lit(None).cast("string").alias("tipo"), F.when(k % 3 != 0, F.col("titulo")).alias("titulo"), F.col("nivel").alias("nivel_academico"), "estado",
            *[F.when(k % 2 == 0, 0.0).otherwise(F.col("precio") * n * factor).alias(c) for c, n in PRICED.items()], F.lit(None).cast("double").alias("precio_estimado_anual"),
            F.when(k % 3 == 0, "").otherwise(file).alias("fuente_precio"), F.lit(f"https://{file}.es").alias("boe_url"), pick("codigo_estudio", "2020-1-5", "2020-02-30", None, "5/1/2020").alias("boe_fecha"),
            F.lit("").alias("origen_fuente"), F.lit(None).cast("string").alias("pdf_sha256"),
            F.struct(F.create_map(F.lit("Total"), F.lit(file)).alias("resumen_creditos"), F.when(k % 10 == 0, F.array(course, course)).alias("elementos_curriculares")).alias("plan_estudios"),
        )

    return made("a", 1).filter(k % 5 == 0).unionByName(made("b", 2).filter(k % 15 == 0))


def stored(spark, d) -> dict:
    """The catalogue before the load: two of three universities, even degrees, a plan for every fourth."""
    t, u = degrees(spark, d), universities(spark, d)
    code = F.col("codigo_estudio").cast("string").alias("codigo_estudio")
    prices = [F.lit(None if c == "precio_credito_3" else 7.0).cast("double").alias(c) for c in PRICED]
    plans = t.filter("codigo_estudio % 4 = 0")
    known = t.filter("codigo_estudio % 2 = 0").join(u.select("u_key", "codigo"), "u_key")
    return {
        "unis": u.filter("u_key % 3 <> 0").select("codigo", "nombre", "tipo"),
        "degrees": known.select(code, "titulo", F.col("nivel").alias("nivel_academico"), "estado", F.col("codigo").alias("universidad_codigo"), *prices, F.lit(60.0).alias("precio_estimado_anual"), F.lit("vieja").alias("fuente_precio")),
        "plans": plans.select(code, F.lit("https://viejo.es").alias("boe_url"), F.lit("2019-01-01").cast("date").alias("boe_fecha"), F.lit("boe").alias("origen_fuente"), F.lit("abc").alias("pdf_sha256")),
        "summaries": plans.select(code, F.lit("Total").alias("tipo_credito"), F.lit("viejo").alias("cantidad_creditos")),
        "courses": plans.select(code, F.lit("Vieja").alias("nombre_elemento"), F.lit("6").alias("creditos_ects")),
    }


def loaded(spark, d, name: str):
    return load.load_plans(plan_documents(spark, d), *stored(spark, d).values())[name]


@query("""SELECT codigo, nombre, tipo FROM u WHERE u_key % 3 <> 0 UNION ALL SELECT DISTINCT codigo, CASE WHEN u_key % 4 = 0 THEN nombre ELSE 'Universidad ' || codigo END, 'Desconocido' FROM u JOIN t USING (u_key) WHERE u_key % 3 = 0 AND codigo_estudio % 10 = 5""")
def plan_load_universities(spark, d):
    return loaded(spark, d, "universities")


LOADED = ", ".join(f"CASE WHEN codigo_estudio % 10 = 5 THEN precio * {n} * CASE WHEN codigo_estudio % 15 = 0 THEN 2 ELSE 1 END ELSE {'NULL' if c == 'precio_credito_3' else '7.0'} END::DOUBLE AS {c}" for c, n in PRICED.items())


@query(f"""SELECT codigo_estudio::VARCHAR AS codigo_estudio, CASE WHEN codigo_estudio % 2 = 1 AND codigo_estudio % 3 = 0 THEN 'Estudio ' || codigo_estudio ELSE titulo END AS titulo, nivel AS nivel_academico, estado, codigo AS universidad_codigo, {LOADED},
  CASE WHEN codigo_estudio % 2 = 0 THEN 60.0::DOUBLE END AS precio_estimado_anual, CASE WHEN codigo_estudio % 5 = 0 AND codigo_estudio % 3 <> 0 THEN 'a' WHEN codigo_estudio % 2 = 0 THEN 'vieja' ELSE '' END AS fuente_precio
FROM t JOIN u USING (u_key) WHERE codigo_estudio % 2 = 0 OR codigo_estudio % 5 = 0""")
def plan_load_degrees(spark, d):
    """Degrees after the load: new ones from their first file, and prices of those that were there where files have some."""
    return loaded(spark, d, "degrees")


@query("""SELECT codigo_estudio::VARCHAR AS codigo_estudio, CASE WHEN codigo_estudio % 15 = 0 THEN 'https://b.es' WHEN codigo_estudio % 5 = 0 THEN 'https://a.es' ELSE 'https://viejo.es' END AS boe_url,
  CASE WHEN codigo_estudio % 20 = 0 THEN '2020-01-05' WHEN codigo_estudio % 4 = 0 THEN '2019-01-01' END AS boe_fecha, CASE WHEN codigo_estudio % 4 = 0 THEN 'boe' END AS origen_fuente, CASE WHEN codigo_estudio % 4 = 0 THEN 'abc' END AS pdf_sha256
FROM t WHERE codigo_estudio % 4 = 0 OR codigo_estudio % 5 = 0""")
def plan_load_plans(spark, d):
    return loaded(spark, d, "plans").withColumn("boe_fecha", F.col("boe_fecha").cast("string"))


@query("""SELECT codigo_estudio::VARCHAR AS codigo_estudio, 'Total' AS tipo_credito, 'viejo' AS cantidad_creditos FROM t WHERE codigo_estudio % 4 = 0 AND codigo_estudio % 5 <> 0
UNION ALL SELECT codigo_estudio::VARCHAR, 'Total', 'a' FROM t WHERE codigo_estudio % 5 = 0 UNION ALL SELECT codigo_estudio::VARCHAR, 'Total', 'b' FROM t WHERE codigo_estudio % 15 = 0""")
def plan_load_summaries(spark, d):
    return loaded(spark, d, "summaries")


@query("""SELECT codigo_estudio::VARCHAR AS codigo_estudio, 'Vieja' AS nombre_elemento, 1 AS n FROM t WHERE codigo_estudio % 4 = 0 AND codigo_estudio % 5 <> 0
UNION ALL SELECT codigo_estudio::VARCHAR, 'Nueva', CASE WHEN codigo_estudio % 30 = 0 THEN 4 ELSE 2 END FROM t WHERE codigo_estudio % 10 = 0""")
def plan_load_courses(spark, d):
    return loaded(spark, d, "courses").groupBy("codigo_estudio", "nombre_elemento").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT 'universities' AS what, (SELECT count(*) FROM u WHERE u_key % 3 <> 0 OR u_key % 4 = 0 OR u_key IN (SELECT u_key FROM t WHERE codigo_estudio % 35 = 0 AND codigo_estudio % 4 <> 0)) AS n
UNION ALL SELECT 'degrees', (SELECT count(*) FROM t WHERE codigo_estudio % 7 <> 0 OR (codigo_estudio % 2 = 0 AND codigo_estudio % 14 = 0 AND codigo_estudio % 4 = 0) OR codigo_estudio % 5 = 0)
UNION ALL SELECT 'renamed', (SELECT count(*) FROM t WHERE codigo_estudio % 2 = 0 AND codigo_estudio % 4 <> 0 AND codigo_estudio % 7 <> 0)
UNION ALL SELECT 'courses', (SELECT sum(CASE WHEN codigo_estudio % 10 = 0 THEN CASE WHEN codigo_estudio % 30 = 0 THEN 4 ELSE 2 END WHEN codigo_estudio % 4 = 0 AND codigo_estudio % 5 <> 0 THEN 1 ELSE 0 END)::BIGINT FROM t)
UNION ALL SELECT 'errors', (SELECT count(DISTINCT (user_id, event_type)) + 1 FROM events WHERE NOT (user_id = 3 AND event_type = 'click')) UNION ALL SELECT 'reports', (SELECT count(DISTINCT ts::DATE) FROM events)""")
def sync(spark, d):
    """Sizes of the tables after a whole load, in which all parts take part."""
    t, u, e, s = degrees(spark, d), universities(spark, d), read(spark, d, "events"), stored(spark, d)
    k = F.col("codigo_estudio")
    known = s["degrees"].withColumn(admin.MARK, k.cast("bigint") % 4 == 0)
    new = t.filter("codigo_estudio % 7 <> 0").join(u.select("u_key", "codigo"), "u_key").select(k.cast("string").alias("codigo_estudio"), F.concat("titulo", F.lit(" nuevo")).alias("titulo"), F.col("nivel").alias("nivel_academico"), "estado", F.col("codigo").alias("universidad_codigo"))
    errors = e.select("event_id", F.col("user_id").cast("string").alias("id_entidad"), F.col("event_type").alias("motivo_fallo"), F.lit(None).cast("timestamp").alias("timestamp"), F.col("event_id").alias("pos"))
    reports = e.select(F.to_date("ts").alias("timestamp_reporte"), F.col("event_id").alias("pos"))
    old = spark.createDataFrame([("3", "click", None)], "id_entidad string, motivo_fallo string, timestamp timestamp")
    before = {"universities": s["unis"], "degrees": known, "plans": s["plans"], "summaries": s["summaries"], "courses": s["courses"], "errors": old, "reports": reports.limit(0)}
    news = {"universities": u.filter("u_key % 4 = 0").select("codigo", "nombre"), "degrees": new, "files": plan_documents(spark, d), "errors": errors, "reports": reports}
    after = load.sync(before, news)
    renamed = after["degrees"].filter((k.cast("bigint") % 2 == 0) & F.col("titulo").endswith(" nuevo"))
    sizes = [x.agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "n") for w, x in {n: after[n] for n in ("universities", "degrees", "courses", "errors", "reports")}.items()]
    out = renamed.agg(F.count("*").alias("n")).select(F.lit("renamed").alias("what"), "n")
    for x in sizes:
        out = out.union(x)
    return out


@query(f"""SELECT codigo_estudio, CASE WHEN tipo = 'Pública' AND codigo_estudio % 2 = 0 THEN CASE WHEN codigo_estudio % 4 = 0 THEN NULL ELSE 12.5 END ELSE 7.0 END::DOUBLE AS precio_credito_ects,
  CASE WHEN codigo_estudio % 2 = 1 THEN CASE WHEN codigo_estudio % 3 = 0 THEN 'propia' END WHEN tipo = 'Pública' THEN 'oficial' WHEN codigo_estudio % 3 = 0 THEN 'propia' ELSE {q(fixed.PRICE_SOURCE['private'])} END AS fuente_precio FROM t JOIN u USING (u_key)""")
def apply_prices(spark, d):
    """Prices that arrive for even degrees: all six count at public universities, elsewhere only the source of one that has none."""
    k = F.col("codigo_estudio")
    t = degrees(spark, d).join(universities(spark, d).select("u_key", "tipo"), "u_key").withColumns({c: F.lit(7.0) for c in load.PRICES} | {"fuente_precio": F.when(k % 3 == 0, "propia")})
    new = degrees(spark, d).filter("codigo_estudio % 2 = 0").select(k, *[F.when(k % 4 != 0, 12.5).alias(c) for c in load.PRICES if c != "fuente_precio"], F.lit("oficial").alias("fuente_precio"))
    return load.apply_prices(t, new).select("codigo_estudio", "precio_credito_ects", "fuente_precio")


@query("SELECT codigo_estudio, l_partkey, row_number() OVER w::INTEGER AS place, l_suppkey % 3 <> 0 AND count(*) FILTER (l_suppkey % 3 <> 0) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS latest FROM a WINDOW w AS (PARTITION BY codigo_estudio ORDER BY orden DESC, l_partkey, l_suppkey, l_extendedprice)")
def latest_document(spark, d):
    """Lines as documents of a degree, newest first; two of three could be fetched, and the first of these is the latest."""
    rows = courses(spark, d, names=False).withColumn("fetched", F.col("l_suppkey") % 3 != 0)
    return load.newest_first(rows, "codigo_estudio", [F.desc("orden"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]).select("codigo_estudio", "l_partkey", "place", "latest")


# Upserts and state

@query("""WITH n AS (SELECT user_id AS k, coalesce(max_by(event_type, event_id) FILTER (event_type <> ''), CASE WHEN count(*) > 0 THEN '' END) AS titulo, max_by(event_id % 4, event_id) AS nivel, min_by(value, event_id) AS saldo FROM (SELECT * REPLACE (CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS event_type) FROM events) GROUP BY 1)
SELECT coalesce(c_custkey, k) AS k, CASE WHEN k IS NULL THEN c_name WHEN c_custkey IS NULL THEN titulo ELSE coalesce(nullif(titulo, ''), c_name) END AS titulo, CASE WHEN k IS NULL THEN 0 ELSE nivel END AS nivel, CASE WHEN c_custkey IS NULL THEN saldo ELSE c_acctbal END AS saldo
FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN n ON k = c_custkey""", views=False)
def upsert_repeated_keys(spark, d):
    """Events as news of customers, many of a key: each merges into the one before; the first makes a customer that isn't there."""
    old = read(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("titulo"), F.lit(0).cast("bigint").alias("nivel"), F.col("c_acctbal").alias("saldo"))
    new = read(spark, d, "events").select(F.col("user_id").alias("k"), "event_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("titulo"), (F.col("event_id") % 4).alias("nivel"), F.col("value").alias("saldo"))
    return state.upsert(old, new, "k", ["titulo"], ["nivel"], order="event_id")


@query("SELECT event_id FROM events WHERE event_id % 4 > 0 QUALIFY row_number() OVER (PARTITION BY user_id % 20, CASE WHEN event_type <> 'view' THEN event_type END ORDER BY event_id) = 1 AND NOT (user_id % 20 = 3 AND event_type = 'click')", views=False)
def error_dedupe_in_batch(spark, d):
    """Errors that repeat within a batch enter once; nulls equal nulls."""
    e = read(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("id_entidad"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("motivo"))
    old = spark.createDataFrame([(3, "click")], "id_entidad bigint, motivo string")
    return state.new_errors(old, e.filter("event_id % 4 > 0"), ["id_entidad", "motivo"], "event_id").select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 9 = 0 UNION ALL (SELECT event_id FROM events WHERE event_id % 9 <> 0 AND day(ts) <> 3 QUALIFY row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) = 1)", views=False)
def new_reports(spark, d):
    """Reports by day; those of a known day are left out, those without a time all enter."""
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.to_date("ts")).alias("at"))
    return state.new_reports(e.filter("day(at) = 3"), e, "at", "event_id").select("event_id")


@query("""WITH n AS (SELECT user_id AS k, max_by('u' || event_id, event_id) FILTER (event_type NOT IN ('view', 'click')) AS url, max_by(event_id::VARCHAR, event_id) AS stamp FROM events GROUP BY 1)
SELECT coalesce(c_custkey, k) AS k, coalesce(url, CASE WHEN c_custkey IS NOT NULL THEN 'viejo' END) AS url, coalesce(stamp, '0') AS stamp FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) FULL JOIN n ON k = c_custkey""", views=False)
def state_record(spark, d):
    """The last address that says something, and the time of the last news."""
    old = read(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("viejo").alias("url"), F.lit("0").alias("stamp"))
    url = F.when(F.col("event_type") == "view", " N/A").when(F.col("event_type") != "click", F.concat(F.lit("u"), "event_id"))
    new = read(spark, d, "events").select(F.col("user_id").alias("k"), url.alias("url"), F.col("event_id").cast("string").alias("stamp"), "event_id")
    return state.record(old, new, "k", ["url"], "stamp", "event_id")


@query("""SELECT event_id FROM events WHERE event_id % 3 <> 0 AND user_id % 5 <> 0 AND event_type <> 'error' AND NOT (event_id % 1000 < 100) AND NOT coalesce(event_id % 7 = 0 AND user_id % 2 = 0, false)""", views=False)
def negative_caches(spark, d):
    """Documents that none of the five caches knows: rejected address, rejected hash, unreachable address, ended degree, closed site."""
    e = read(spark, d, "events")
    rows = e.select("event_id", F.col("event_id").cast("string").alias("url"), F.concat(F.lit("h"), F.col("event_id") % 1000).alias("hash"), F.concat(F.lit("e"), "event_id").alias("entry"), F.col("user_id").cast("string").alias("degree"), F.when((F.col("event_id") % 7 == 0) & (F.col("user_id") % 2 == 0), "site").otherwise(F.col("event_type")).alias("site"))
    none = spark.createDataFrame([], "k string")
    cache = lambda seen, c: state.remember(none, seen.select(F.col(c).alias("k")), "k")
    known = {
        "url": cache(rows.filter("event_id % 3 = 0"), "url"), "hash": cache(rows.filter("event_id % 1000 < 100"), "hash"), "entry": cache(rows.filter("event_id < 0"), "entry"),
        "degree": cache(e.filter("user_id % 5 = 0").select(F.col("user_id").cast("string").alias("u")), "u"), "site": cache(spark.createDataFrame([("site",), ("error",), ("N/A",), (None,)], "s string"), "s"),
    }
    return state.unrejected(rows, known).select("event_id")


@query("""SELECT t.codigo_estudio FROM t LEFT JOIN (SELECT codigo_estudio, sum(ects) AS e FROM a GROUP BY 1) USING (codigo_estudio) WHERE coalesce(e, 0) < 60""")
def incomplete_plans(spark, d):
    sums = courses(spark, d, names=False).groupBy("codigo_estudio").agg(F.count("*").alias("n"), F.sum("ects").cast("double").alias("e"))
    status = money.completeness(F.lit(False), F.col("n") > 0, F.col("n"), F.lit(0), F.col("e"), F.lit(60.0))
    return state.incomplete(degrees(spark, d).select("codigo_estudio"), sums.select("codigo_estudio", status.alias("status")), "codigo_estudio")


@query("""SELECT u_key, CASE WHEN u_key % 2 = 0 AND u_key % 3 = 0 THEN 'https://fija.es/' || u_key ELSE 'https://nueva.es' END AS web, u_key % 2 = 0 AND u_key % 3 = 0 AS corregida FROM u WHERE u_key % 7 <> 0""")
def corrected_addresses(spark, d):
    """Addresses of a new list, but for those that an older list has corrected."""
    u = universities(spark, d)
    old = u.filter("u_key % 2 = 0").select("u_key", F.concat(F.lit("https://fija.es/"), "u_key").alias("web"), F.when(F.col("u_key") % 3 == 0, True).alias("corregida"))
    new = u.filter("u_key % 7 <> 0").select("u_key", F.lit("https://nueva.es").alias("web"))
    return state.keep_corrected(new, old, "u_key", "web", "corregida")


@query("""WITH r AS (SELECT user_id, event_id, event_type, sum((event_type = 'click')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events WHERE event_type <> 'signup'),
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS i FROM r WHERE event_type <> 'click'),
t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS trip FROM n WHERE i % 4 = 0)
SELECT user_id, trip, CASE WHEN trip < 3 THEN 'pausa' ELSE 'salto' END AS action, event_id FROM t WHERE trip <= 3""", views=False)
def breaker_actions(spark, d):
    """Pauses and skips of a breaker at four failures in a row; a click is a success, a signup says nothing."""
    return state.breaker(read(spark, d, "events"), "user_id", ["event_id"], F.col("event_type") != "click", F.col("event_type") == "signup", 4)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'later' END AS extra FROM events", views=False)
def map_merge_first_wins(spark, d):
    old = F.from_json("props", "map<string,string>")
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("later"), F.lit("extra"), F.col("event_type"))).otherwise(F.create_map(F.lit("extra"), F.lit("later")))
    return read(spark, d, "events").select("event_id", state.first_wins(old, new).alias("m")).select("event_id", "m.k", "m.extra")


# Dates

DAYS = ("2020-02-29", "2021-02-29", "2020-1-5", "20200105", "5/1/2020", None, "2020-13-01")
TIMES = ("2024-05-06T07:08:09.123456", "2024-05-06 07:08", "2024-05-06", "2024-05-06T25:00:00", "ayer", None, "2024-05-06T07:08:09")


@query(f"SELECT event_id, try_cast(CASE WHEN regexp_matches(x, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN x END AS DATE)::VARCHAR AS day FROM (SELECT event_id, {sql_pick('event_id', *DAYS)} AS x FROM events)", views=False)
def plan_dates(spark, d):
    return read(spark, d, "events").select("event_id", dates.plain_date(pick("event_id", *DAYS)).cast("string").alias("day"))


@query(f"SELECT event_id, try_cast(x AS TIMESTAMP)::VARCHAR AS stamp FROM (SELECT event_id, {sql_pick('event_id', *TIMES)} AS x FROM events)", views=False)
def report_times(spark, d):
    return read(spark, d, "events").select("event_id", dates.iso_time(pick("event_id", *TIMES)).cast("string").alias("stamp"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 10 > 0 THEN ts END > (SELECT max(ts) FROM events) - INTERVAL 1 DAY, false) AS fresh FROM events", views=False)
def cache_ttl(spark, d):
    e = read(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return e.select("event_id", dates.fresh(F.when(F.col("event_id") % 10 > 0, F.col("ts")), now).alias("fresh"))


@query(None)
def save_throttle(spark, d):
    """Saves that are carried out of those that each user's events ask for, 30 hours apart at least unless forced."""
    e = read(spark, d, "events").select("user_id", F.struct("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_type") == "error").alias("force")).alias("x"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    done = F.arrays_zip(F.col("x.event_id").alias("event_id"), state.written(F.col("x"), 30 * 3600).alias("done"))
    return rows.select("user_id", F.explode(done).alias("z")).select("user_id", "z.event_id", "z.done")


# Figures

@query("""WITH k AS (SELECT user_id, sum(value) AS io, count(*) FILTER (event_type = 'view') AS n, sum(value) FILTER (event_type = 'click') AS parse, count(*) FILTER (event_type = 'click') AS pdfs, count(*) FILTER (event_type = 'error') AS hits, sum(event_id * 1000) AS pb, sum(event_id) FILTER (event_type = 'signup') AS jb FROM events WHERE user_id % 3 = 0 OR event_type = 'purchase' GROUP BY 1)
SELECT user_id, CASE WHEN n > 0 THEN round(io / n, 3) ELSE 0 END::DOUBLE AS io_per_degree, CASE WHEN pdfs > 0 THEN round(parse / pdfs, 3) ELSE 0 END::DOUBLE AS parse_per_pdf, CASE WHEN n > 0 THEN round(hits / n * 100, 2) ELSE 0 END::DOUBLE AS hit_pct,
  CASE WHEN coalesce(jb, 0) > 0 THEN round(pb / jb, 2) ELSE 1 END::DOUBLE AS pdf_to_json, round((pb + coalesce(jb, 0)) / 1048576 * 0.05, 3)::DOUBLE AS g_co2 FROM k""", views=False)
def derived_metrics(spark, d):
    e = read(spark, d, "events").filter("user_id % 3 = 0 or event_type = 'purchase'")
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col(c))), F.lit(0))
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    totals = e.groupBy("user_id").agg(F.sum("value").alias("io_seconds"), of("click", "value").alias("parse_seconds"), n("view").alias("degrees"), n("click").alias("pdfs"), n("error").alias("hits"), F.sum(F.col("event_id") * 1000).alias("pdf_bytes"), of("signup", "event_id").alias("json_bytes"))
    return metrics.derived(totals).select("user_id", "io_per_degree", "parse_per_pdf", "hit_pct", "pdf_to_json", "g_co2")


@query("SELECT event_id, round(event_id * 0.0003 * 250, 4)::DOUBLE AS g FROM events", views=False)
def cpu_co2(spark, d):
    return read(spark, d, "events").select("event_id", metrics.co2_of_cpu(F.col("event_id")).alias("g"))


@query("""SELECT user_id, count(*)::INTEGER AS universities, count(DISTINCT event_type)::INTEGER AS degrees, count(*) FILTER (event_type = 'error')::INTEGER AS rejected, 0::INTEGER AS failed FROM events GROUP BY 1""", views=False)
def checkpoint_sizes(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(
        F.collect_list("event_id").alias("processed_universities"), F.map_from_entries(F.collect_set(F.struct("event_type", F.lit("x").alias("v")))).alias("processed_degrees"),
        F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("non_study_plan_pdfs"), F.lit(None).cast("map<string,string>").alias("failed_pdf_downloads"),
    )
    return metrics.checkpoint_sizes(e, "user_id")


@query("SELECT count(*) AS pdfs, sum(event_id)::BIGINT AS bytes, count(*) FILTER (event_type = 'error') AS errors FROM events", views=False)
def worker_counters(spark, d):
    """Counters of workers, one a user, summed."""
    parts = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("pdfs"), F.sum("event_id").alias("bytes"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return metrics.merged(parts, ["pdfs", "bytes", "errors"])


@query(None)
def folder_size(spark, d):
    return files.folder_size(spark, d)


@query("SELECT 'ok' AS status, 'campusquery' AS service", views=False)
def service_health(spark, d):
    return metrics.health(spark)


@query("""WITH v AS (SELECT count(*) FILTER (event_type = 'purchase') AS v FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)), s AS (SELECT count(*) AS s FROM (SELECT * FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 200))
SELECT v AS views, s AS searches, round(v * 100.0 / s, 2)::DOUBLE AS pct FROM v, s""", views=False)
def conversion_ratio(spark, d):
    """Views among the 50 newest events over the searches that are kept."""
    return metrics.conversion(read(spark, d, "events"), ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase")


@query("""WITH k AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), r AS (SELECT * FROM k ORDER BY ts DESC, event_id DESC LIMIT 15)
SELECT count(*) AS n, floor(avg(value) + 0.5)::BIGINT AS mean_ms, floor(count(*) FILTER (event_type = 'error') * 100.0 / count(*) + 0.5)::BIGINT AS error_pct, (SELECT string_agg(value::VARCHAR, '|' ORDER BY ts, event_id) FROM r) AS recent FROM k""", views=False)
def latency_summary(spark, d):
    """The latencies that are kept, and the last 15 of them."""
    out = metrics.api_stats(read(spark, d, "events"), ["ts", "event_id"], "value", F.col("event_type") == "error")
    return out.withColumn("recent", F.array_join(F.transform("recent", lambda x: x.cast("string")), "|"))


@query("(SELECT 'reports' AS list, event_id FROM events WHERE event_type = 'signup' ORDER BY event_id DESC LIMIT 10) UNION ALL (SELECT 'errors', event_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 200 OFFSET 5)", views=False)
def recent_lists(spark, d):
    """The newest ten reports, and as many of the newest errors as may be asked for."""
    e = read(spark, d, "events")
    reports, errors = metrics.recent(e.filter("event_type = 'signup'"), "event_id", 10, 100), metrics.recent(e.filter("event_type = 'error'"), "event_id", 1000, 200, 5)
    return reports.select(F.lit("reports").alias("list"), "event_id").union(errors.select(F.lit("errors").alias("list"), "event_id"))


@query("""SELECT 'searches' AS log, event_id AS id FROM (SELECT * FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 200) UNION ALL SELECT 'recent', event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)
UNION ALL SELECT 'latencies', event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) UNION ALL SELECT 'views', o_custkey FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 500)""", views=False)
def retention(spark, d):
    """What the browser's four logs keep."""
    e, order = read(spark, d, "events"), ["ts", "event_id"]
    views = metrics.top_entries(degrees(spark, d).groupBy(F.col("u_key").alias("id")).agg(F.count("*").alias("n")), "id")
    kept = {"searches": metrics.newest(e.filter("event_type = 'click'"), order, metrics.KEPT["searches"]), "recent": metrics.newest(e, order, metrics.KEPT["recent"]), "latencies": metrics.newest(e, order, metrics.KEPT["latencies"])}
    a, b, c = (x.select(F.lit(log).alias("log"), F.col("event_id").alias("id")) for log, x in kept.items())
    return a.union(b).union(c).union(views.select(F.lit("views").alias("log"), "id"))


# Credits, tariffs and tuition

@query("SELECT codigo_estudio, curso, sum(CASE WHEN l_partkey % 4 = 0 THEN 6 ELSE ects END)::DOUBLE AS ects FROM a GROUP BY 1, 2")
def year_credits(spark, d):
    c = courses(spark, d, names=False).withColumn("ects", F.when(F.col("l_partkey") % 8 == 0, "sin").when(F.col("l_partkey") % 4 != 0, F.col("ects").cast("string")))
    return state.year_credits(c, "codigo_estudio")


@query("""WITH l AS (SELECT row_number() OVER () AS id, l_orderkey AS codigo_estudio, l_linenumber AS orden, p_name || CASE WHEN l_linenumber > 1 THEN ' ring avanzado' ELSE ' avanzado' END AS nombre FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT id, codigo_estudio, orden, list_distinct(regexp_extract_all(nombre, '[a-z0-9_]{4,}')) AS own FROM l),
x AS (SELECT b.id, bool_or(len(list_intersect(b.own, a.own)) >= greatest(2, len(b.own) - 1)) AS renamed FROM w b JOIN w a ON a.codigo_estudio = b.codigo_estudio AND a.orden < b.orden GROUP BY 1)
SELECT codigo_estudio, orden, coalesce(renamed, false) AS renamed FROM w LEFT JOIN x USING (id)""", views=False)
def renamed_courses(spark, d):
    """Courses that share all but one of their long words with an earlier one of their plan."""
    name = F.concat("nombre", F.when(F.col("orden") > 1, " ring avanzado").otherwise(" avanzado"))
    plans = courses(spark, d).groupBy("codigo_estudio").agg(F.array_sort(F.collect_list(F.struct("orden", name.alias("n")))).alias("x"))
    rows = plans.select("codigo_estudio", "x", F.explode("x").alias("c"))
    earlier = F.transform(F.filter("x", lambda y: y["orden"] < F.col("c.orden")), lambda y: y["n"])
    return rows.select("codigo_estudio", "c.orden", state.renamed(F.col("c.n"), earlier).alias("renamed"))


TIER = "CASE least(orden, 4) WHEN 1 THEN 12.62 WHEN 2 THEN 25.24 WHEN 3 THEN 54.40 ELSE 75.60 END"


@query(f""", x AS (SELECT codigo_estudio, least(orden, 4) AS tier, CASE WHEN l_partkey % 5 = 0 THEN 6 ELSE ects END::DECIMAL(12,2) AS e, CASE WHEN l_partkey % 5 = 0 THEN 6 ELSE ects END::DECIMAL(12,2) * {TIER} AS c FROM a WHERE l_partkey % 7 <> 0)
SELECT codigo_estudio, count(*) AS n, sum(e)::DOUBLE AS ects, sum(c)::DOUBLE AS cost, """ + ", ".join(f"count(*) FILTER (tier = {k}) AS n{k}, coalesce(sum(c) FILTER (tier = {k}), 0)::DOUBLE AS cost{k}" for k in (1, 2, 3, 4)) + " FROM x GROUP BY 1")
def tuition_totals(spark, d):
    """Totals of the chosen courses; a fifth of them has no credits and counts 6."""
    tier, part = F.least(F.col("orden"), F.lit(4)), F.col("l_partkey")
    c = courses(spark, d, names=False).select("codigo_estudio", tier.alias("tier"), (part % 7 != 0).alias("chosen"), F.when(part % 10 == 0, 0).when(part % 5 != 0, F.col("ects")).cast("decimal(12,2)").alias("ects"))
    price = F.when(F.col("tier") == 1, F.lit("12.62")).when(F.col("tier") == 2, "25.24").when(F.col("tier") == 3, "54.40").otherwise("75.60").cast("decimal(6,2)")
    return load.tuition_totals(c, "codigo_estudio", price)


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'sin_datos' WHEN event_id % 2 = 0 AND event_id % 3 > 0 THEN 'doctorado_estructural' WHEN event_id % 3 = 0 THEN 'sin_plan' WHEN event_id % 5 = 0 AND event_id % 7 > 0 THEN 'solo_resumen' WHEN event_id % 5 = 0 THEN 'sin_asignaturas' WHEN event_id % 300 >= 240 THEN 'completo' ELSE 'incompleto_parcial' END AS status FROM events""", views=False)
def completeness_outcomes(spark, d):
    """All seven states of a plan."""
    k = F.col("event_id")
    doctoral = money.is_doctoral(F.when(k % 2 == 0, "Doctor - RD 99/2011").otherwise("Grado"), F.lit("Historia"))
    status = money.completeness(doctoral, k % 3 > 0, F.when(k % 5 > 0, 40).otherwise(0), k % 7, (k % 300).cast("double"), money.required_credits(F.lit("Grado"), F.lit("Historia"), F.lit(None).cast("string")), k % 11 != 0)
    return read(spark, d, "events").select("event_id", status.alias("status"))


@query("""SELECT codigo_estudio, round(cr * (CASE WHEN codigo_estudio % 3 = 0 THEN precio / 1000 WHEN codigo_estudio % 3 = 1 THEN precio / 60 ELSE 16.8 END) * (CASE codigo_estudio % 4 WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 WHEN 3 THEN 3.0 ELSE 4.5 END) + 1e-6, 2)::DOUBLE AS total, floor(cr / 6 + 0.5)::BIGINT AS n FROM (SELECT *, (codigo_estudio % 61)::DOUBLE AS cr FROM t)""")
def flat_simulation(spark, d):
    """A year without a list of courses: at the price of a credit, a 60th of the year's, or the common price."""
    k = F.col("codigo_estudio")
    s = money.flat_simulation((k % 61).cast("double"), k % 4, F.when(k % 3 == 0, F.col("precio") / 1000).when(k % 3 == 1, 0.0), F.when(k % 3 == 1, F.col("precio")))
    return degrees(spark, d).select("codigo_estudio", s.alias("s")).select("codigo_estudio", F.round(F.col("s.total") + 1e-6, 2).alias("total"), "s.n")


@query("SELECT codigo_estudio, CASE WHEN codigo_estudio % 3 = 1 THEN precio WHEN codigo_estudio % 3 = 2 AND codigo_estudio % 50 > 0 THEN floor(60 * (codigo_estudio % 50) / 7.0 + 45.5) END::DOUBLE AS anual FROM t")
def display_annual_price(spark, d):
    k = F.col("codigo_estudio")
    return degrees(spark, d).select("codigo_estudio", money.shown_annual(F.when(k % 3 == 1, F.col("precio")).otherwise(0.0), F.when(k % 3 == 2, (k % 50) / 7.0)).alias("anual"))


# Documents and pages

@query("SELECT doc_id, length(trim(coalesce(text, ''), ' ')) < 50 AS pictures FROM documents", views=False)
def needs_reading(spark, d):
    return read(spark, d, "documents").select("doc_id", files.needs_reading(F.col("text")).alias("pictures"))


@query(f"SELECT doc_id, {sql_any('lower(text)', fixed.ENDED)} OR doc_id % 9 = 0 AS ended FROM documents", views=False)
def page_extinct(spark, d):
    return read(spark, d, "documents").select("doc_id", web.page_extinct(F.col("text"), F.when(F.col("doc_id") % 9 == 0, "Título EXTINGUIDO").otherwise("Vigente")).alias("ended"))


@query("SELECT doc_id, contains(upper(coalesce(text, '')), 'EXTINGUID') OR contains(upper(coalesce(text, '')), 'SIN DOCENCIA') OR doc_id % 4 = 0 AS ended FROM documents", views=False)
def list_extinct(spark, d):
    return read(spark, d, "documents").select("doc_id", web.list_extinct(F.concat(F.col("text"), F.when(F.col("doc_id") % 4 == 0, " (Titulación extinguida)").otherwise(""))).alias("ended"))


@query("SELECT codigo_estudio, CASE WHEN codigo_estudio % 2 = 0 THEN '240' ELSE '60' END AS total, n::INTEGER AS n FROM (SELECT codigo_estudio, count(*) AS n FROM a GROUP BY 1)")
def web_plan(spark, d):
    rows = courses(spark, d).groupBy("codigo_estudio").agg(F.collect_list("nombre").alias("x"))
    plan = web.web_plan(F.col("x"), F.when(F.col("codigo_estudio") % 2 == 0, "GRADO en X").otherwise("Máster"))
    return rows.select("codigo_estudio", plan.alias("p")).select("codigo_estudio", F.col("p.resumen_creditos")["Créditos Totales"].alias("total"), F.col("p.total_elementos").alias("n"))


@query("SELECT p_partkey, list_filter(string_split('Grado en la  ' || p_name || ' for de Los', ' '), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(q(w) for w in fixed.LINK_STOP_WORDS) + "], lower(w))) AS words FROM part", views=False)
def match_words(spark, d):
    title = F.concat(F.lit("Grado en la  "), "p_name", F.lit(" for de Los"))
    return read(spark, d, "part").select("p_partkey", web.match_words(title).alias("words"))


PAGE_LINKS = [("/grados/plan", "Ver"), ("master?x=1", "Máster"), ("https://otro.example.info/grados", "Grados"), ("#grados", "Grados"), ("/contacto", "Nada"), ("mailto:grado@x.es", "Grado"), ("/becas/grados", "Becas"), ("/grados/plan", "Oferta formativa de grado")]


def academic_pages(spark, d):
    body = F.lit("".join(f'<p><a href="{h}">{t}</a></p>' for h, t in PAGE_LINKS))
    return read(spark, d, "pages").select("page_id", "url", body.alias("html"))


WHOLE_SQL = """k AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS root, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS folder FROM pages)
"""


@query("WITH " + WHOLE_SQL + """SELECT page_id, 0 AS pos, root || '/grados/plan' AS url, 'Ver' AS label FROM k UNION ALL SELECT page_id, 1, folder || 'master?x=1', 'Máster' FROM k
UNION ALL SELECT page_id, 6, root || '/becas/grados', 'Becas' FROM k UNION ALL SELECT page_id, 7, root || '/grados/plan', 'Oferta formativa de grado' FROM k""", views=False)
def site_links(spark, d):
    """Links of pages that may lead to studies on the same site, as whole addresses."""
    return html.site_links(academic_pages(spark, d)).select("page_id", "pos", "url", "label")


@query("WITH " + WHOLE_SQL + """SELECT page_id, 1 AS place, root || '/grados/plan' AS url, 140 AS score FROM k UNION ALL SELECT page_id, 2, root || '/becas/grados', 20 FROM k""", views=False)
def page_link_scores(spark, d):
    """The two best addresses of each page for a Grado, by their best label."""
    return html.best_links(html.site_links(academic_pages(spark, d)), "page_id", F.lit("Grado"), most=2).select("page_id", "place", "url", "score")


@query("SELECT codigo, (row_number() OVER (PARTITION BY u_key ORDER BY codigo_estudio) - 1)::INTEGER AS pos, codigo_estudio::VARCHAR AS codigo_estudio, titulo FROM u JOIN t USING (u_key)")
def degree_lists(spark, d):
    """Rows of the list of degrees that is keyed by university, from its text; a text for each remainder of the keys."""
    t = degrees(spark, d).groupBy("u_key").agg(F.array_sort(F.collect_list(F.struct("codigo_estudio", "titulo", F.col("nivel").alias("nivel_academico"), "estado"))).alias("d"))
    u = t.join(universities(spark, d).select("u_key", "codigo"), "u_key")
    one = F.create_map(F.col("codigo"), F.struct(F.transform("d", lambda x: x.withField("codigo_estudio", x["codigo_estudio"].cast("string"))).alias("titulaciones_vigentes")))
    return files.degree_lists(u.select(F.to_json(one).alias("value"))).select("codigo", "pos", "codigo_estudio", "titulo")
