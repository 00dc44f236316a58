"""Queries over the catalogue and the SQL that gives the same rows.

Customers stand for universities, orders for degrees, lines for courses, events for usage and logs; texts and
pages stand for what a crawl brings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusquery.functions import fixed, money, text
from campusquery.operators import catalog, html, state
from campusquery.sources.tables import SQL_VIEWS, courses, degrees, read, universities

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None, views: bool = True):
    """Registers a function of (spark, sf_dir) under its name, with its SQL after the catalogue's views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (SQL_VIEWS + sql) if views else sql
        return f

    return add


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(c: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(p)})" for p in parts) + ")"


def pick(key: str, *forms) -> Column:
    """One of the forms, in turn by a number column."""
    return F.get(F.array(*[F.lit(x) for x in forms]), (F.col(key) % len(forms)).cast("int"))


def sql_pick(key: str, *forms) -> str:
    return "[" + ", ".join(q(x) if isinstance(x, str) else "NULL" if x is None else str(x) for x in forms) + f"][1 + ({key} % {len(forms)})::INTEGER]"


# Search

PUBLIC_SQL = "CASE WHEN regexp_matches(lower(tipo), 'p[úu]blic') THEN 0 ELSE 1 END"


@query(f"SELECT t.codigo_estudio, titulo, nivel, codigo, nombre, tipo, ccaa FROM t LEFT JOIN u USING (u_key) WHERE ccaa ILIKE '%asia%' AND codigo_estudio IN (SELECT codigo_estudio FROM a) ORDER BY {PUBLIC_SQL}, titulo, codigo_estudio LIMIT 50 OFFSET 20")
def search_degrees(spark, d):
    """Flagship: degrees of a region that have courses, public first, one page."""
    found = catalog.search(degrees(spark, d), universities(spark, d), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("codigo_estudio")), region="asia")
    return catalog.page(found, 20, 50).select("codigo_estudio", "titulo", "nivel", "codigo", "nombre", "tipo", "ccaa")


@query("SELECT count(*) AS total, greatest(1, ceil(count(*) / 50))::BIGINT AS pages, 51::BIGINT AS first_item, least(100, count(*)) AS last_item FROM t LEFT JOIN u USING (u_key) WHERE nivel ILIKE '%URG%'")
def search_total(spark, d):
    n = catalog.search(degrees(spark, d), universities(spark, d), level="urg").agg(F.count("*").alias("total"))
    pages, first, last = catalog.page_numbers(F.col("total"), 50, 2)
    return n.select("total", pages.cast("long"), first.cast("long").alias("first_item"), last)


@query("SELECT codigo, nombre, tipo, provincia, ccaa FROM u WHERE codigo = '007'")
def degree_by_code(spark, d):
    return catalog.lookup(universities(spark, d), "7").select("codigo", "nombre", "tipo", "provincia", "ccaa")


@query("SELECT codigo, nombre FROM (SELECT CASE WHEN u_key % 2 = 0 THEN codigo ELSE u_key::VARCHAR END AS codigo, nombre FROM u) WHERE codigo = '7'")
def degree_by_raw_code(spark, d):
    """A code that is stored without zeros is found as it was given, since no padded one is there."""
    u = universities(spark, d).withColumn("codigo", F.when(F.col("u_key") % 2 == 0, F.col("codigo")).otherwise(F.col("u_key").cast("string")))
    return catalog.lookup(u, "7").select("codigo", "nombre")


@query("SELECT t.codigo_estudio, titulo, estado FROM t JOIN u USING (u_key) WHERE codigo = '007'")
def degrees_of_university(spark, d):
    return degrees(spark, d).join(catalog.lookup(universities(spark, d), "7"), "u_key").select("codigo_estudio", "titulo", "estado")


@query("SELECT codigo, nombre FROM u WHERE nombre ILIKE '%000_1%'")
def ilike_filter(spark, d):
    return universities(spark, d).filter(F.col("nombre").ilike("%000_1%")).select("codigo", "nombre")


@query("SELECT codigo_estudio FROM t WHERE codigo_estudio IN (SELECT codigo_estudio FROM a WHERE caracter = 'R')")
def has_plan_semi(spark, d):
    plans = courses(spark, d, names=False).filter("caracter = 'R'").select("codigo_estudio")
    return degrees(spark, d).join(plans, "codigo_estudio", "left_semi").select("codigo_estudio")


@query("SELECT u_key, codigo FROM u")
def zfill_lookup(spark, d):
    return universities(spark, d).select("u_key", "codigo")


@query("SELECT event_id, NOT lower(trim(CASE WHEN event_id % 5 = 0 THEN ' NaN ' WHEN event_id % 5 = 1 THEN '' ELSE event_type END)) IN ('', 'none', 'null', 'undefined', 'n/a', 'nan') AS ok FROM events", views=False)
def meaningful_value(spark, d):
    e = read(spark, d, "events")
    v = F.when(F.col("event_id") % 5 == 0, " NaN ").when(F.col("event_id") % 5 == 1, "").otherwise(F.col("event_type"))
    return e.select("event_id", text.meaningful(v).alias("ok"))


LINKS_SQL = r"""WITH x AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)')) AS l, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)'), 1) - 1 AS pos FROM pages),
l AS (SELECT page_id, url, pos::INTEGER AS pos, regexp_extract(l, '(?is)href="([^"]*)"', 1) AS href, trim(regexp_extract(l, '(?s)>([^<]*)$', 1)) AS label FROM x)
"""


@query(LINKS_SQL + "SELECT page_id, pos, href, label FROM l", views=False)
def page_links(spark, d):
    return html.links(read(spark, d, "pages")).select("page_id", "pos", "href", "label")


@query(LINKS_SQL + "SELECT page_id, pos, trim(href) <> '' AND NOT regexp_matches(lower(trim(href)), '^(#|javascript:|mailto:|tel:|whatsapp:|ftp:|data:)') AS ok FROM l", views=False)
def valid_link(spark, d):
    return html.links(read(spark, d, "pages")).select("page_id", "pos", text.valid_link(F.col("href")).alias("ok"))


HOST = "regexp_replace(lower(regexp_extract({}, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"


@query(f"WITH h AS (SELECT page_id, {HOST.format('url')} AS h FROM pages) SELECT page_id, h AS host, h = 'example.com' OR h LIKE '%.example.com' OR 'example.com' LIKE '%.' || h AS same FROM h WHERE h <> ''", views=False)
def same_site(spark, d):
    p = read(spark, d, "pages").select("page_id", text.host(F.col("url")).alias("host"), text.same_site(F.col("url"), F.lit("https://www.example.com/x")).alias("same"))
    return p.filter("host <> ''")


@query("SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'https://' || substr(url, 8) WHEN url LIKE 'https://%' THEN url ELSE 'https://' || url END AS url FROM pages", views=False)
def ensure_https(spark, d):
    return read(spark, d, "pages").select("page_id", text.https(F.col("url")).alias("url"))


@query(f"SELECT doc_id, {sql_any('lower(text)', ['extin', 'suprim', 'no vigente'])} AS extinct FROM documents", views=False)
def extinct_flag(spark, d):
    return read(spark, d, "documents").select("doc_id", text.has_any(F.lower("text"), ["extin", "suprim", "no vigente"]).alias("extinct"))


# Coverage

@query("SELECT count(DISTINCT a.codigo_estudio) AS with_courses, count(DISTINCT t.codigo_estudio) AS degrees, round(count(DISTINCT a.codigo_estudio) * 100.0 / count(DISTINCT t.codigo_estudio), 2)::DOUBLE AS pct FROM t LEFT JOIN a USING (codigo_estudio)")
def coverage_ratio(spark, d):
    both = degrees(spark, d).join(courses(spark, d, names=False).select(F.col("codigo_estudio").alias("p")).distinct(), F.col("codigo_estudio") == F.col("p"), "left")
    return both.agg(F.countDistinct("p").alias("with_courses"), F.countDistinct("codigo_estudio").alias("degrees")).select("*", catalog.ratio(F.col("with_courses"), F.col("degrees")).alias("pct"))


@query("SELECT ccaa, count(*) AS n FROM u JOIN t USING (u_key) WHERE trim(ccaa) <> '' GROUP BY ccaa")
def degrees_by_region(spark, d):
    return universities(spark, d).join(degrees(spark, d), "u_key").filter(F.trim("ccaa") != "").groupBy("ccaa").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT ccaa FROM u WHERE ccaa IS NOT NULL")
def distinct_regions(spark, d):
    return universities(spark, d).filter("ccaa is not null").select("ccaa").distinct().orderBy("ccaa")


@query("SELECT (SELECT count(*) FROM t) AS plan_rows, (SELECT count(DISTINCT codigo_estudio) FROM a) AS plans_with_courses")
def plan_rows_vs_plans_with_courses(spark, d, names=False):
    return degrees(spark, d).agg(F.count("*").alias("plan_rows")).join(courses(spark, d, names=False).agg(F.countDistinct("codigo_estudio").alias("plans_with_courses")), how="inner")


ECTS = "coalesce(sum(ects::DECIMAL(12,2)), 0)::DOUBLE"


@query(f"SELECT t.codigo_estudio, count(a.orden) AS n, {ECTS} AS ects FROM t LEFT JOIN a USING (codigo_estudio) GROUP BY 1")
def credit_sum_per_plan(spark, d):
    return plan_sums(spark, d).select("codigo_estudio", "n", "ects")


def plan_sums(spark, d) -> DataFrame:
    """Degrees with the number and the credits of their courses, read from text as the catalogue stores them."""
    value = text.first_number(F.concat(F.col("ects").cast("string"), F.lit(" ECTS"))).cast("decimal(12,2)")
    sums = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("codigo_estudio"), F.col("l_quantity").alias("ects")).groupBy("codigo_estudio").agg(F.count("*").alias("n"), F.sum(value).alias("ects"))
    return degrees(spark, d).join(sums, "codigo_estudio", "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "ects": F.coalesce(F.col("ects").cast("double"), F.lit(0.0))})


STATUS = f"""s AS (SELECT t.codigo_estudio, nivel, count(a.orden) AS n, {ECTS} AS ects FROM t LEFT JOIN a USING (codigo_estudio) GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN nivel = '1-URGENT' THEN 'doctorado_estructural' WHEN n = 0 THEN 'sin_plan' WHEN ects >= 60 THEN 'completo' ELSE 'incompleto_parcial' END AS status FROM s)
"""


def with_status(spark, d) -> DataFrame:
    s = plan_sums(spark, d)
    doctoral = F.col("nivel") == "1-URGENT"
    return s.withColumn("status", money.completeness(doctoral, doctoral | (F.col("n") > 0), F.col("n"), F.lit(0), F.col("ects"), F.lit(60.0)))


@query("," + STATUS + "SELECT codigo_estudio, status FROM c")
def completeness_status(spark, d):
    return with_status(spark, d).select("codigo_estudio", "status")


@query("," + STATUS + "SELECT nivel, count(*) AS total, count(*) FILTER (status = 'completo') AS complete, count(*) FILTER (status = 'incompleto_parcial') AS partial, round(count(*) FILTER (status = 'completo') * 100.0 / count(*), 2)::DOUBLE AS pct FROM c GROUP BY ROLLUP (nivel)")
def quality_by_level(spark, d):
    c = with_status(spark, d).rollup("nivel").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completo").alias("complete"), F.count_if(F.col("status") == "incompleto_parcial").alias("partial"))
    return c.select("*", catalog.ratio(F.col("complete"), F.col("total")).alias("pct"))


# Text

@query(r"SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[;:,]+$', '')) AS clean FROM documents", views=False)
def sanitize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", text.sanitize(F.col("text")).alias("clean"))


@query(r"SELECT p_partkey, regexp_replace(trim(p_name), '[.,;:\- ]+$', '') AS clean FROM part", views=False)
def sanitize_subject(spark, d):
    return read(spark, d, "part").select("p_partkey", text.sanitize_subject(F.concat(F.lit("40147 - "), "p_name", F.lit(" ...... "))).alias("clean"))


@query("SELECT p_partkey, 'Grado en ' || reverse(p_name) AS fixed FROM part", views=False)
def unreverse(spark, d):
    return read(spark, d, "part").select("p_partkey", text.unreverse(F.concat("p_name", F.lit(" ne odarG"))).alias("fixed"))


@query("SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}'))) AS k FROM part", views=False)
def keywords(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_sort(text.tokens(F.col("p_name"))).alias("k"))


@query("WITH k AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}')) AS k, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]{3,}')) AS s FROM part) SELECT p_partkey, CASE WHEN len(k) = 0 THEN false WHEN len(k) <= 2 THEN len(list_intersect(k, s)) >= 1 ELSE len(list_intersect(k, s)) >= 2 OR 2 * len(list_intersect(k, s)) >= len(k) END AS hit FROM k", views=False)
def section_match(spark, d):
    return read(spark, d, "part").select("p_partkey", text.section_match(text.tokens(F.col("p_name")), text.tokens(F.col("p_type"))).alias("hit"))


TYPE_SQL = "CASE " + " ".join(f"WHEN {sql_any('lower(x)', p)} THEN {q(n)}" for p, n in fixed.SUBJECT_TYPES) + " ELSE 'OB' END"


@query(f"SELECT p_partkey, {TYPE_SQL.replace('lower(x)', 'lower(p_name)')} AS kind FROM part", views=False)
def subject_type(spark, d):
    return read(spark, d, "part").select("p_partkey", text.subject_type(F.col("p_name")).alias("kind"))


@query("""SELECT doc_id, '"' || replace(CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END, '"', '""') || '"' AS cell FROM documents""", views=False)
def csv_guard(spark, d):
    return read(spark, d, "documents").select("doc_id", text.csv_cell(F.col("text")).alias("cell"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1", views=False)
def content_sha256(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2(F.col("text"), 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS code FROM customer", views=False)
def excel_code(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.excel_code(F.concat(F.lit(" "), "c_custkey", F.lit(".0")), 3).alias("code"))


@query("SELECT doc_id, " + ", ".join(f"regexp_extract(text, {q('(?i)' + p)}, 1) AS c{k}" for k, (_, p) in enumerate(fixed.CREDIT_SUMMARY)) + " FROM documents", views=False)
def credit_summary_regex(spark, d):
    m = text.credit_summary(F.col("text"))
    rows = read(spark, d, "documents").select("doc_id", m.alias("m"))
    return rows.select("doc_id", *[F.coalesce(F.col("m")[name], F.lit("")).alias(f"c{k}") for k, (name, _) in enumerate(fixed.CREDIT_SUMMARY)])


# Tariffs


LEVELS = ["Grado", "Máster - RD 822", "Doctorado", "431 master", "Otro", "RD 560", "900"]
TITLES = ["Historia", "Abogacía", "Doctor en Arte", "Formación del Profesorado", "Física"]
NEAR = ["Andalucía", "Comunidad de Madrid (Región)", "Galicia", "Mar", "Marte", "Rioja", "Bale", ""]
PLACE = [*fixed.TARIFFS, *NEAR]
TARIFF_SQL = "k (k, r, cat, p1, p2, p3, p4, fees, decree) AS (VALUES " + ", ".join(
    f"({k}, {q(name)}, {q(cat)}, {', '.join(map(str, p))}, {x[4]}, {q(x[5])})" for k, (name, x) in enumerate(fixed.TARIFFS.items()) for cat, p in [*zip(("Grado", "MH", "MN"), x[:3], strict=True), ("D", (x[3], "NULL", "NULL", "NULL"))]
) + ")"
REGION_SQL = "CASE WHEN raw = '' THEN '' " + " ".join("WHEN " + " AND ".join(sql_any("lower(trim(raw))", g) for g in groups) + f" THEN {q(name)}" for groups, name in fixed.REGIONS) + " ELSE raw END"


@query(f""", {TARIFF_SQL},
x AS (SELECT codigo_estudio, tipo, {sql_pick('codigo_estudio', *LEVELS)} AS nivel, {sql_pick('codigo_estudio', *TITLES)} AS titulo, {sql_pick('u_key', *PLACE)} AS raw FROM t JOIN u USING (u_key)),
y AS (SELECT *, {REGION_SQL} AS name, CASE WHEN {sql_any('lower(nivel)', ['doctorado', '560', '900'])} OR contains(lower(titulo), 'doctor') THEN 'D' WHEN {sql_any('lower(nivel)', ['máster', 'master', '431'])} THEN CASE WHEN {sql_any('lower(titulo)', fixed.REGULATED_MASTERS)} THEN 'MH' ELSE 'MN' END ELSE 'Grado' END AS cat FROM x),
m AS (SELECT *, (SELECT min(k) FROM k WHERE k.r = y.name) AS same, (SELECT min(k) FROM k WHERE y.name <> '' AND (contains(lower(k.r), lower(y.name)) OR contains(lower(y.name), lower(k.r)))) AS near FROM y)
SELECT codigo_estudio, raw AS ccaa, {', '.join(f"CASE WHEN tipo = 'Pública' THEN p{i} END::DOUBLE AS precio_{i}" for i in (1, 2, 3, 4))}, CASE WHEN tipo = 'Pública' THEN CASE WHEN m.cat = 'D' THEN p1 ELSE 60 * p1 END + fees END::DOUBLE AS precio_anual,
  CASE WHEN tipo <> 'Pública' THEN {q(fixed.PRICE_SOURCE['private'])} WHEN decree IS NULL THEN replace({q(fixed.PRICE_SOURCE['unknown'])}, '%s', CASE WHEN raw = '' THEN 'Sin CCAA' ELSE raw END) ELSE {q(fixed.PRICE_SOURCE['official'])} || decree END AS fuente_precio
FROM m LEFT JOIN k ON k.k = coalesce(same, near) AND k.cat = m.cat""")
def degree_price(spark, d):
    """Tariffs of all degrees: every category, and regions by their name, by part of it, and unknown."""
    u = universities(spark, d).select("u_key", "tipo", pick("u_key", *PLACE).alias("ccaa"))
    rows = degrees(spark, d).join(u, "u_key").select("codigo_estudio", pick("codigo_estudio", *TITLES).alias("titulo"), pick("codigo_estudio", *LEVELS).alias("nivel"), "tipo", "ccaa")
    priced = money.degree_price(rows, "ccaa", "tipo", "nivel", "titulo").drop("titulo", "nivel", "tipo")
    return priced.withColumns({c: F.col(c).cast("double") for c in priced.columns if c.startswith("precio_")})


@query("SELECT codigo_estudio, precio / 100 AS p1, precio / 100 * 1.5 AS p2, CASE WHEN codigo_estudio % 2 = 0 THEN 50.0::DOUBLE ELSE precio / 100 * 3.0 END AS p3, precio / 100 * 4.5 AS p4 FROM t")
def tier_price(spark, d):
    base, zero = F.col("precio") / 100, F.lit(0.0)
    third = F.when(F.col("codigo_estudio") % 2 == 0, 50.0).otherwise(0.0)
    return degrees(spark, d).select("codigo_estudio", *[money.tier_price(k, base, zero, third, F.lit(None).cast("double")).alias(f"p{k}") for k in (1, 2, 3, 4)])


# Tuition

LINES = "x AS (SELECT *, row_number() OVER (PARTITION BY codigo_estudio ORDER BY orden, l_partkey, l_suppkey, l_extendedprice) AS i, least(orden, 4) AS tier FROM a)"


@query(None)
def preselect_courses(spark, d, names=False):
    items = F.array_sort(F.collect_list(F.struct("orden", "l_partkey", "l_suppkey", "l_extendedprice", "ects")))
    rows = courses(spark, d, names=False).groupBy("codigo_estudio").agg(items.alias("x"))
    numbered = F.transform("x", lambda x, i: F.struct((i + 1).alias("i"), x["ects"].alias("ects")))
    return rows.select("codigo_estudio", F.array_join(state.preselect(numbered), ",").alias("taken"))


ORACLE_SQL["preselect_courses"] = SQL_VIEWS.replace("WITH u AS", "WITH RECURSIVE u AS") + f""", {LINES},
r AS (SELECT codigo_estudio, i, CASE WHEN ects <= 60 THEN ects ELSE 0 END AS s, CASE WHEN ects <= 60 THEN i::VARCHAR ELSE '' END AS taken FROM x WHERE i = 1
      UNION ALL SELECT r.codigo_estudio, x.i, CASE WHEN s + ects <= 60 THEN s + ects ELSE s END, CASE WHEN s + ects <= 60 THEN taken || CASE WHEN taken = '' THEN '' ELSE ',' END || x.i::VARCHAR ELSE taken END
      FROM r JOIN x ON x.codigo_estudio = r.codigo_estudio AND x.i = r.i + 1)
SELECT codigo_estudio, max_by(taken, i) AS taken FROM r GROUP BY 1"""

@query(None)
def preselect_plans(spark, d):
    """The preselection with its branch by year and its types; two of three plans have no years, and lines without a type stand for blank ones."""
    kind = F.when(F.col("caracter") == "A", "OB").when(F.col("caracter") == "R", "OP").when(F.col("l_partkey") % 2 == 0, "FB").otherwise("")
    rows = courses(spark, d, names=False).withColumns({"caracter": kind, "curso": F.when(F.col("codigo_estudio") % 3 == 0, F.col("curso")).otherwise("")})
    items = F.array_sort(F.collect_list(F.struct("orden", "l_partkey", "l_suppkey", "l_extendedprice", "ects", "caracter", "curso")))
    numbered = F.transform("x", lambda x, i: F.struct((i + 1).alias("i"), x["ects"].alias("ects"), x["caracter"].alias("caracter"), x["curso"].alias("curso")))
    return rows.groupBy("codigo_estudio").agg(items.alias("x")).select("codigo_estudio", F.array_join(state.preselect_plan(numbered), ",").alias("taken"))


ORACLE_SQL["preselect_plans"] = SQL_VIEWS.replace("WITH u AS", "WITH RECURSIVE u AS") + f""", {LINES},
y AS (SELECT codigo_estudio, i, CASE WHEN ects = 0 THEN 6 ELSE ects END AS e, CASE WHEN codigo_estudio % 3 = 0 THEN curso ELSE '' END AS label,
        CASE caracter WHEN 'A' THEN 'OB' WHEN 'R' THEN 'OP' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'FB' ELSE '' END END IN ('FB', 'OB', '') AS able FROM x),
r AS (SELECT codigo_estudio, 0::BIGINT AS i, 0::DOUBLE AS s, '' AS taken FROM y WHERE i = 1
      UNION ALL SELECT r.codigo_estudio, y.i, CASE WHEN able AND s + e <= 60 THEN s + e ELSE s END, CASE WHEN able AND s + e <= 60 THEN taken || CASE WHEN taken = '' THEN '' ELSE ',' END || y.i::VARCHAR ELSE taken END
      FROM r JOIN y ON y.codigo_estudio = r.codigo_estudio AND y.i = r.i + 1),
f AS (SELECT codigo_estudio, max_by(taken, i) AS flat FROM r GROUP BY 1),
g AS (SELECT codigo_estudio, bool_or(trim(label) <> '') AS named, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (contains(label, '1')), '') AS first FROM y GROUP BY 1)
SELECT codigo_estudio, CASE WHEN named THEN first ELSE flat END AS taken FROM g JOIN f USING (codigo_estudio)"""

COST = "(ects::DECIMAL(12,2) * CASE tier WHEN 1 THEN 12.62 WHEN 2 THEN 25.24 WHEN 3 THEN 54.40 ELSE 75.60 END)"


def tuition(spark, d) -> DataFrame:
    """Per degree: number, credits and cost of its courses, and of those at the first enrolment; a tier per line number."""
    tier = F.least(F.col("l_linenumber"), F.lit(4))
    price = F.when(tier == 1, F.lit("12.62")).when(tier == 2, "25.24").when(tier == 3, "54.40").otherwise("75.60").cast("decimal(6,2)")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("codigo_estudio"), tier.alias("tier"), F.col("l_quantity").cast("decimal(12,2)").alias("ects"), (F.col("l_quantity").cast("decimal(12,2)") * price).alias("cost"))
    return rows


@query(f", {LINES} SELECT codigo_estudio, " + ", ".join(f"coalesce(sum({COST}) FILTER (tier = {k}), 0)::DOUBLE AS tier{k}" for k in (1, 2, 3, 4)) + " FROM x GROUP BY 1")
def tuition_by_tier(spark, d):
    p = tuition(spark, d).groupBy("codigo_estudio").pivot("tier", [1, 2, 3, 4]).agg(F.sum("cost"))
    return p.select("codigo_estudio", *[F.coalesce(F.col(str(k)).cast("double"), F.lit(0.0)).alias(f"tier{k}") for k in (1, 2, 3, 4)])


DISCOUNTS = f""", {LINES}, y AS (SELECT codigo_estudio, sum({COST})::DOUBLE AS cost, coalesce(sum({COST}) FILTER (tier = 1), 0)::DOUBLE AS first FROM x GROUP BY 1),
z AS (SELECT *, cost * 0.5 AS large_family, cost AS special, first AS grant, least(cost, 60 * 12.62) AS honours, first * 0.99 AS bonus FROM y)"""


def discounts(spark, d) -> DataFrame:
    y = tuition(spark, d).groupBy("codigo_estudio").agg(F.sum("cost").cast("double").alias("cost"), F.coalesce(F.sum(F.when(F.col("tier") == 1, F.col("cost"))).cast("double"), F.lit(0.0)).alias("first"))
    return y.withColumns({"large_family": F.col("cost") * 0.5, "special": F.col("cost"), "grant": F.col("first"), "honours": F.least("cost", F.lit(60 * 12.62)), "bonus": F.col("first") * 0.99})


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("codigo_estudio", *[F.round(F.col(c) + 1e-6, 2).alias(c) for c in cols])


def sql_rounded(*cols: str) -> str:
    return ", ".join(f"round({c} + 1e-6, 2) AS {c}" for c in cols)


@query(DISCOUNTS + f" SELECT codigo_estudio, {sql_rounded('large_family', 'special', 'grant', 'honours', 'bonus')} FROM z")
def tuition_discounts(spark, d):
    return rounded(discounts(spark, d), "large_family", "special", "grant", "honours", "bonus")


@query(DISCOUNTS + ", w AS (SELECT codigo_estudio, greatest(0, cost - large_family + 22.5) AS family_total, greatest(0, cost - grant + 45) AS grant_total, greatest(0, cost - honours + 45) AS honours_total FROM z)" + f" SELECT codigo_estudio, {sql_rounded('family_total', 'grant_total', 'honours_total')} FROM w")
def tuition_total(spark, d):
    z = discounts(spark, d)
    return rounded(z.withColumns({"family_total": F.greatest(F.lit(0.0), F.col("cost") - F.col("large_family") + 22.5), "grant_total": F.greatest(F.lit(0.0), F.col("cost") - F.col("grant") + 45), "honours_total": F.greatest(F.lit(0.0), F.col("cost") - F.col("honours") + 45)}), "family_total", "grant_total", "honours_total")


REDUCTIONS = ["fn_general", "fn_especial", "beca_mec", "mh_bachillerato", "bonif_99", "ninguna"]


@query(f""", {LINES}, y AS (SELECT codigo_estudio, sum({COST})::DOUBLE AS cost, coalesce(sum({COST}) FILTER (tier = 1), 0)::DOUBLE AS first, sum(ects)::DOUBLE AS e, coalesce(sum(ects) FILTER (tier = 1), 0)::DOUBLE AS e1 FROM x GROUP BY 1),
z AS (SELECT *, u_key % 2 = 1 AS private, (codigo_estudio % 6)::INTEGER AS k, CASE WHEN codigo_estudio % 5 = 0 THEN 16.8 ELSE 20 END AS own FROM y JOIN t USING (codigo_estudio)),
w AS (SELECT *, CASE WHEN private THEN CASE k WHEN 2 THEN e1 * own WHEN 3 THEN least(e, 60) * own ELSE 0 END ELSE CASE k WHEN 0 THEN cost * 0.5 WHEN 1 THEN cost WHEN 2 THEN first WHEN 3 THEN least(cost, 60 * 12.62) WHEN 4 THEN first * 0.99 ELSE 0 END END::DOUBLE AS amount,
  CASE WHEN private OR k > 1 THEN 1 WHEN k = 0 THEN 0.5 ELSE 0 END AS share FROM z)
SELECT codigo_estudio, round(amount + 1e-6, 2) AS amount, round(greatest(0, cost - amount + 45 * share) + 1e-6, 2) AS total FROM w""")
def tuition_reductions(spark, d):
    """Totals under the reduction that a degree's code selects; every other university counts as private."""
    first = lambda c: F.coalesce(F.sum(F.when(F.col("tier") == 1, F.col(c))).cast("double"), F.lit(0.0))
    y = tuition(spark, d).groupBy("codigo_estudio").agg(*[F.sum(c).cast("double").alias(c) for c in ("cost", "ects")], first("cost").alias("first"), first("ects").alias("e1"))
    z = y.join(degrees(spark, d).select("codigo_estudio", "u_key"), "codigo_estudio")
    kind = F.get(F.array(*[F.lit(x) for x in REDUCTIONS]), (F.col("codigo_estudio") % 6).cast("int"))
    own = F.when(F.col("codigo_estudio") % 5 == 0, F.lit(0.0)).otherwise(20.0)
    cut = money.discount(kind, F.col("u_key") % 2 == 1, F.col("cost"), F.col("first"), F.lit(12.62), F.col("ects"), F.col("e1"), own)
    w = z.withColumn("cut", cut).select("codigo_estudio", F.col("cut.amount").alias("amount"), F.greatest(F.lit(0.0), F.col("cost") - F.col("cut.amount") + 45 * F.col("cut.fee_share")).alias("total"))
    return rounded(w, "amount", "total")


@query("SELECT codigo_estudio, curso, count(*) AS n, array_to_string(list_sort(list(nombre)), '|') AS nombres FROM a GROUP BY 1, 2")
def courses_by_year(spark, d):
    return courses(spark, d).groupBy("codigo_estudio", "curso").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("nombre")), "|").alias("nombres"))


# Places

CITY_SQL = "CASE " + " ".join(f"WHEN contains(p, {q(k)}) OR contains(p, {q(prov.lower())}) THEN {q(name)}" for k, _, _, prov, name in fixed.CITIES) + " ELSE 'Madrid' END"
PLACES = ("Universidad de Cádiz", "Castilla y León", "Comunitat Valenciana", "Las Palmas", "Burgos", "Marte")


def resolved(spark, d) -> DataFrame:
    """Universities with the first city whose key or province their text holds."""
    place = F.get(F.array(*[F.lit(p) for p in PLACES]), (F.col("u_key") % len(PLACES)).cast("int"))
    return catalog.with_city(universities(spark, d).withColumn("lugar", place), "lugar").select("u_key", "place.*")


PLACE_SQL = "lower([" + ", ".join(q(p) for p in PLACES) + f"][1 + (u_key % {len(PLACES)})::INTEGER])"


@query(f"SELECT u_key, {CITY_SQL} AS city FROM (SELECT u_key, {PLACE_SQL} AS p FROM u)")
def resolve_city(spark, d):
    return resolved(spark, d).select("u_key", "city")


CITIES_SQL = "c(city, lat, lng) AS (VALUES " + ", ".join(f"({q(n)}, {a}::DOUBLE, {b}::DOUBLE)" for _, a, b, _, n in fixed.CITIES) + ")"


@query(f", {CITIES_SQL}, g AS (SELECT u_key, {CITY_SQL} AS city FROM (SELECT u_key, {PLACE_SQL} AS p FROM u)), k AS (SELECT u_key, city, pow(sin(radians(lat - 36.5271) / 2), 2) + cos(radians(36.5271)) * cos(radians(lat)) * pow(sin(radians(lng + 6.2886) / 2), 2) AS h FROM g JOIN c USING (city))\nSELECT u_key, city, round(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)), 1) AS km FROM k ORDER BY km, u_key LIMIT 30")
def nearest_universities(spark, d):
    _, lat, lng, *_ = fixed.CITIES[0]
    km = money.haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return resolved(spark, d).select("u_key", "city", km.alias("km")).orderBy("km", "u_key").limit(30)


# Usage

@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10", views=False)
def top_searches(spark, d):
    return catalog.top(read(spark, d, "events").filter("event_type = 'click'"), "user_id")


@query("SELECT u_key, coalesce(n, 0) AS n FROM u LEFT JOIN (SELECT user_id AS u_key, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) USING (u_key) ORDER BY n DESC, u_key LIMIT 6")
def top_viewed(spark, d):
    views = read(spark, d, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("u_key")).agg(F.count("*").alias("n"))
    return universities(spark, d).join(views, "u_key", "left").select("u_key", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "u_key").limit(6)


@query("SELECT user_id, count(*) AS n, round(avg(value), 3) AS mean_ms, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 2)::DOUBLE AS error_pct FROM events GROUP BY 1", views=False)
def latency_by_domain(spark, d):
    return catalog.latency(read(spark, d, "events"), "user_id")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50", views=False)
def recent_events(spark, d):
    return read(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM events GROUP BY 1", views=False)
def error_rate(spark, d):
    e = read(spark, d, "events")
    total = e.agg(F.count("*").alias("total"))
    return e.groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(total), how="inner").select("event_type", "n", catalog.ratio(F.col("n"), F.col("total")).alias("pct"))


@query("""WITH r AS (SELECT user_id, ts, event_type, sum((event_type <> 'view')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, count(*) AS failures, min(ts) AS since FROM r WHERE event_type = 'view' GROUP BY user_id, k HAVING count(*) >= 5""", views=False)
def circuit_breaker(spark, d):
    return catalog.failure_streaks(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "view", 5)


# Dedupe and windows

@query("SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_name", views=False)
def latest_version_per_title(spark, d):
    p = read(spark, d, "part").select("p_name", "p_partkey", text.title_base(F.col("p_name")).alias("base"), F.col("p_partkey").cast("string").alias("code"))
    return state.latest_versions(p, ["base"], "code", "p_partkey").select("p_name", "p_partkey")


ORDER = ["orden", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(""", x AS (SELECT *, CASE WHEN cuatrimestre = 'F' THEN '' ELSE cuatrimestre END AS c2, CASE WHEN caracter = 'N' THEN 'OB' ELSE caracter END AS k2 FROM a),
y AS (SELECT codigo_estudio, nombre, orden, first_value(nullif(c2, '') IGNORE NULLS) OVER w AS c, first_value(nullif(k2, 'OB') IGNORE NULLS) OVER w AS k, row_number() OVER (PARTITION BY codigo_estudio, lower(nombre) ORDER BY orden, l_partkey, l_suppkey, l_extendedprice) AS n
FROM x WINDOW w AS (PARTITION BY codigo_estudio, lower(nombre) ORDER BY orden, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT codigo_estudio, nombre, orden, coalesce(c, '') AS cuatrimestre, coalesce(k, 'OB') AS caracter FROM y WHERE n = 1""")
def first_course_with_fill(spark, d):
    c = courses(spark, d).withColumns({"cuatrimestre": F.when(F.col("cuatrimestre") == "F", "").otherwise(F.col("cuatrimestre")), "caracter": F.when(F.col("caracter") == "N", "OB").otherwise(F.col("caracter")), "_k": text.name_key(F.col("nombre"))})
    return state.first_with_fill(c, "codigo_estudio", "_k", ORDER, ["cuatrimestre"], "caracter").select("codigo_estudio", "nombre", "orden", "cuatrimestre", "caracter")


@query("SELECT codigo_estudio, orden, l_partkey FROM a QUALIFY max(orden) OVER (PARTITION BY codigo_estudio) > 0 AND row_number() OVER (PARTITION BY codigo_estudio ORDER BY orden DESC, l_partkey, l_suppkey, l_extendedprice) <= 3")
def candidate_cap(spark, d):
    return catalog.last_rows(courses(spark, d, names=False), ["codigo_estudio"], [F.desc("orden"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], 3).select("codigo_estudio", "orden", "l_partkey")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events", views=False)
def carry_forward_section(spark, d):
    e = read(spark, d, "events").withColumn("_h", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return state.carry_forward(e, "user_id", ["ts", "event_id"], "_h", "section").select("event_id", "section")


@query("""WITH r AS (SELECT user_id, ts, event_id, event_type, sum((event_type <> 'view')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, island::BIGINT AS island, string_agg(event_type, ' ' ORDER BY ts, event_id) AS joined FROM r GROUP BY 1, 2""", views=False)
def stitch_fragments(spark, d):
    e = state.stitch(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "view")
    return e.withColumnRenamed("event_type", "joined")


# Nested

@query("SELECT codigo_estudio, count(*) AS n, sum(ects)::DOUBLE AS ects FROM a GROUP BY 1")
def explode_courses(spark, d):
    nested = courses(spark, d).groupBy("codigo_estudio").agg(F.collect_list(F.struct("orden", "nombre", "ects")).alias("elementos"))
    return nested.select("codigo_estudio", F.explode("elementos").alias("e")).groupBy("codigo_estudio").agg(F.count("*").alias("n"), F.sum("e.ects").alias("ects"))


@query("SELECT event_id, 'k' AS clave, json_extract_string(props, '$.k')::BIGINT AS valor FROM events", views=False)
def explode_summary(spark, d):
    m = read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("clave", "valor"))
    return m


@query("SELECT t.codigo_estudio, titulo, count(a.orden) AS n, coalesce(string_agg(nombre, '|' ORDER BY orden, nombre), '') AS cursos FROM t LEFT JOIN a USING (codigo_estudio) GROUP BY 1, 2")
def nested_detail(spark, d):
    parts = courses(spark, d).groupBy("codigo_estudio").agg(F.array_sort(F.collect_list(F.struct("orden", "nombre"))).alias("c"))
    out = degrees(spark, d).join(parts, "codigo_estudio", "left")
    return out.select("codigo_estudio", "titulo", F.coalesce(F.size("c"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("c", lambda x: x["nombre"]), "|"), F.lit("")).alias("cursos"))


# Upserts: even keys are stored, keys divisible by 3 arrive

@query("""SELECT codigo_estudio, CASE WHEN codigo_estudio % 2 = 1 THEN titulo WHEN codigo_estudio % 3 = 0 AND codigo_estudio % 5 <> 0 THEN titulo || ' nuevo' ELSE titulo END AS titulo, CASE WHEN codigo_estudio % 2 = 1 THEN 0.0::DOUBLE ELSE precio END AS precio
FROM t WHERE codigo_estudio % 2 = 0 OR codigo_estudio % 3 = 0""")
def upsert_degrees(spark, d):
    t = degrees(spark, d).select("codigo_estudio", "titulo", "precio")
    old = t.filter("codigo_estudio % 2 = 0")
    new = t.filter("codigo_estudio % 3 = 0").select("codigo_estudio", F.when(F.col("codigo_estudio") % 2 == 1, F.col("titulo")).when(F.col("codigo_estudio") % 5 == 0, "").otherwise(F.concat("titulo", F.lit(" nuevo"))).alias("titulo"), F.lit(0.0).alias("precio"))
    return state.upsert(old, new, "codigo_estudio", ["titulo", "precio"])


@query("SELECT codigo, CASE WHEN u_key % 2 = 0 THEN nombre ELSE nombre || ' nueva' END AS nombre FROM u WHERE u_key % 2 = 0 OR u_key % 3 = 0")
def insert_only_universities(spark, d):
    u = universities(spark, d)
    new = u.filter("u_key % 3 = 0").select("codigo", F.concat("nombre", F.lit(" nueva")).alias("nombre"))
    return state.insert_only(u.filter("u_key % 2 = 0").select("codigo", "nombre"), new, "codigo")


@query("SELECT codigo_estudio FROM t WHERE codigo_estudio % 3 = 0 OR codigo_estudio % 7 = 0")
def prune_missing(spark, d):
    t = degrees(spark, d).select("codigo_estudio", (F.col("codigo_estudio") % 7 == 0).alias("admin"))
    return state.prune(t, t.filter("codigo_estudio % 3 = 0"), "codigo_estudio", 100, "admin").select("codigo_estudio")


@query("SELECT codigo_estudio, CASE WHEN codigo_estudio % 3 = 0 THEN 'nuevo' ELSE nombre END AS nombre, count(*) AS n FROM a GROUP BY 1, 2")
def replace_children(spark, d):
    c = courses(spark, d).select("codigo_estudio", "nombre")
    out = state.replace_children(c, c.filter("codigo_estudio % 3 = 0").withColumn("nombre", F.lit("nuevo")), "codigo_estudio")
    return out.groupBy("codigo_estudio", "nombre").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_id % 2 = 1", views=False)
def error_dedupe_nullsafe(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 > 1, F.col("event_type")).alias("reason"))
    return state.new_errors(e.filter("event_id % 2 = 0"), e, ["event_id", "reason"]).select("event_id")


@query("SELECT codigo_estudio, CASE WHEN codigo_estudio % 4 = 0 THEN true WHEN codigo_estudio % 2 = 1 THEN false ELSE true END AS fresh FROM t")
def up_to_date_check(spark, d):
    t, k = degrees(spark, d).select("codigo_estudio"), F.col("codigo_estudio") % 4
    seen = t.filter("codigo_estudio % 2 = 0").select("codigo_estudio", F.lit("u").alias("seen_url"), F.lit("2020-01-01").alias("seen_date"))
    rows = t.join(seen, "codigo_estudio", "left")
    return rows.select("codigo_estudio", state.up_to_date(F.when(k != 0, "u"), F.when(k == 1, "2021-01-01"), F.col("seen_url"), F.col("seen_date"), F.col("seen_url").isNotNull()).alias("fresh"))


@query("SELECT url, count(*) AS n FROM pages WHERE page_id % 5 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0) GROUP BY 1", views=False)
def negative_cache_anti(spark, d):
    p = read(spark, d, "pages")
    return p.join(p.filter("page_id % 5 = 0").select("url"), "url", "left_anti").groupBy("url").agg(F.count("*").alias("n"))


# Extraction

@query("""WITH r AS (SELECT (p_partkey // 40)::BIGINT AS page_id, [p_name, '6 ECTS'] AS cells, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_name || '<') AS i FROM part)
SELECT page_id, 0::INTEGER AS "table", i::INTEGER AS "row", cells FROM r UNION ALL SELECT DISTINCT page_id, 0, 0, ['Asignatura', 'Créditos'] FROM r""", views=False)
def html_subjects(spark, d):
    """Cells of course tables set into pages made from the catalogue; the pages themselves hold no table."""
    row = F.concat(F.lit("<tr><td>"), "p_name", F.lit("</td><td>6 ECTS</td></tr>"))
    pages = read(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("page_id")).agg(F.concat_ws("", F.lit("<table><tr><th>Asignatura</th><th>Créditos</th></tr>"), F.array_sort(F.collect_list(row)), F.lit("</table>")).alias("html"))
    return html.extract_tables(pages).drop("fields")


