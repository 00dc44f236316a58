"""Queries over the text rules: each input is put together from lists of different lengths, and the SQL states the rule itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from campusquery.functions import fixed, money, text, web
from campusquery.operators import html
from campusquery.sources.tables import read

from .catalogue import pick, q, query, sql_any, sql_pick

KEY = "event_id"


def joined(*lists) -> Column:
    """One form of each list, in turn by the key; lengths without a common divisor make all combinations."""
    return F.concat(*[pick(KEY, *x) for x in lists])


def sql_joined(*lists) -> str:
    return "(" + " || ".join(sql_pick(KEY, *x) for x in lists) + ")"


def listed(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def rows(spark, d, *cols):
    return read(spark, d, "events").select(KEY, *cols)


TERMS = ([*fixed.TERM_YEARLY, *fixed.TERM_ODD, *fixed.TERM_EVEN, "Otoño", "9", "", "tercero"], ["", " ", "  cuat", "x", " 2"])


@query(f"""WITH x AS (SELECT {KEY}, {sql_joined(*TERMS)} AS x FROM events), t AS (SELECT *, lower(trim(x)) AS t FROM x)
SELECT {KEY}, CASE WHEN x = '' THEN '' WHEN {sql_any('t', fixed.TERM_YEARLY)} THEN 'Anual' WHEN t IN {listed(fixed.TERM_ODD)} OR {sql_any('t', fixed.TERM_ODD_PART)} THEN '1C'
  WHEN t IN {listed(fixed.TERM_EVEN)} OR {sql_any('t', fixed.TERM_EVEN_PART)} THEN '2C' ELSE trim(x) END AS t FROM t""", views=False)
def normalize_term(spark, d):
    """Terms; any text that holds "an" is yearly, "verano" too."""
    return rows(spark, d, text.term(joined(*TERMS)).alias("t"))


YEARS = ([f for forms in fixed.YEARS for f in forms], ["", " "])
NO_YEARS = ["Comunicación Oral", "7", "06", "6", "año 6", "curso 6 (OB)", "5", "", "0", "grupo 3 y 4"]


@query(f"""WITH x AS (SELECT {KEY}, CASE WHEN {KEY} % 3 = 0 THEN {sql_pick(KEY, *NO_YEARS)} ELSE {sql_joined(*YEARS)} END AS x FROM events), t AS (SELECT *, trim(x) AS raw, lower(trim(x)) AS t, regexp_extract(trim(x), '(?:^|[^0-9A-Za-zº])([1-6])(?:$|[^0-9A-Za-zº])', 1) AS lone FROM x)
SELECT {KEY}, CASE WHEN raw = '' THEN '' WHEN regexp_matches(raw, '^[0-9]+$') AND ltrim(raw, '0') = '6' THEN '' """ + " ".join(f"WHEN t IN {listed(forms)} THEN '{k}'" for k, forms in enumerate(fixed.YEARS, 1)) + f"""
  WHEN lone <> '' AND NOT (lone = '6' AND NOT {sql_any('t', ['curso', 'año', 'curs'])}) THEN lone ELSE '' END AS y FROM t""", views=False)
def normalize_year(spark, d):
    """Years of courses of 6 credits, by every form that is known, and others."""
    x = F.when(F.col(KEY) % 3 == 0, pick(KEY, *NO_YEARS)).otherwise(joined(*YEARS))
    return rows(spark, d, text.year(x, F.lit(6.0)).alias("y"))


PLACES = (["", "Junta de ", "GOBIERNO DE "], ["Andalucía", "Aragón", "Principado de Asturias", "Illes Balears", "CANARIAS", "Cantabria", "castilla y leon", "CASTILLA LA MANCHA", "Catalunya", "Com. Valenciana", "Extremadura", "Galicia", "Madrid", "Murcia", "Navarra", "Euskadi", "La Rioja", "No aplicable", "Marte", ""], ["", " "])


def region_case(n: str) -> str:
    return " ".join("WHEN " + " AND ".join(sql_any(n, g) for g in groups) + f" THEN {q(name)}" for groups, name in fixed.REGIONS)


@query(f"WITH x AS (SELECT {KEY}, {sql_joined(*PLACES)} AS x FROM events) SELECT {KEY}, CASE WHEN x = '' THEN '' {region_case('lower(trim(x))')} ELSE x END AS r FROM x", views=False)
def normalize_region(spark, d):
    return rows(spark, d, text.region(joined(*PLACES)).alias("r"))


def sql_price(x: str, low: float, high: float) -> str:
    """A European numeral, as ``text.price`` reads it."""
    t = f"regexp_replace(coalesce({x}, ''), '[^0-9.,]', '', 'g')"
    v = f"try_cast(CASE WHEN contains({t}, '.') AND contains({t}, ',') THEN replace(replace({t}, '.', ''), ',', '.') WHEN regexp_matches({t}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+$') THEN replace({t}, '.', '') ELSE replace({t}, ',', '.') END AS DOUBLE)"
    return f"CASE WHEN {v} BETWEEN {low} AND {high} THEN {v} END"


PRICES = (["", "€ ", "aprox. "], ["85,50", "1.250", "9.800,00", "5.0", "gratis", "12.5", "0,5", "45.001", "1.2.3"], ["", "0", " €", ","])


@query(f"SELECT {KEY}, {sql_price(sql_joined(*PRICES), 1, 45000)} AS v FROM events", views=False)
def parse_price(spark, d):
    return rows(spark, d, text.price(joined(*PRICES), 1, 45000).alias("v"))


PAGES = (
    ["Precio crédito: ", "Importe del ECTS ", "Segunda matrícula ", "", "Tercera matrícula: "], ["85,50", "9", "120", "600", "1.250,00", "9.800"], [" €/crédito", " € por crédito", " €", "€ al año", " /curso", " ects", ""],
    ["", ". Cuota anual 9.800 €", " y 4ª matrícula 240 €", " tuition 15000", " honorarios: 900", " 2ª matrícula 90", " 7.500 € por curso", "; 99 €/ects", " coste 45 €", ". Fin", " x"],
)


def sql_first(patterns: list[str], low: float, high: float) -> str:
    return "coalesce(" + ", ".join(sql_price(f"regexp_extract(t, {q(p)}, 1)", low, high) for p in patterns) + ")"


@query(f"""WITH t AS (SELECT {KEY}, lower({sql_joined(*PAGES)}) AS t FROM events),
p AS (SELECT {KEY}, {sql_first(fixed.CREDIT_PRICE, 15, 500)} AS base, {sql_first(fixed.ANNUAL_PRICE, 1000, 45000)} AS year, """ + ", ".join(f"{sql_first(p, 15, 500)} AS t{k}" for k, p in enumerate(fixed.TIER_PRICE, 2)) + f""" FROM t)
SELECT {KEY}, coalesce(base, round(year / 60, 2)) AS precio_1, coalesce(t2, base) AS precio_2, coalesce(t3, base) AS precio_3, coalesce(t4, base) AS precio_4, coalesce(year, round(base * 60, 2)) AS precio_anual FROM p""", views=False)
def private_price_extract(spark, d):
    p = web.private_prices(joined(*PAGES))
    return rows(spark, d, *[c.alias(k) for k, c in p.items()])


LEGENDS = ["Modificación del plan", "", "Correcciones", "Varios", "Datos"]
HEADINGS = ["", "Modificaciones", "Plan de Estudios", "Otro", "Publicación plan estudios", "X", "Y"]
BEFORE = ["Plan de estudios", "BOE", "Acuerdo de Consejo de Ministros", "", "Plan estudios por Consejo de Ministros", "Publicación plan estudios", "Renovación acreditación", "Z", "W"]
AROUND = ["", "Autorización CCAA", "corrección plan estudio", "Acuerdo de Consejo de Ministros", "Extinción", "texto", "más", "otro", "Renovacion acreditacion", "a", "b"]


@query(f"""WITH c AS (SELECT {KEY}, lower({sql_pick(KEY, *LEGENDS)}) AS l, lower({sql_pick(KEY, *HEADINGS)}) AS h, lower({sql_pick(KEY, *BEFORE)}) AS b, lower({sql_pick(KEY, *AROUND)}) AS o FROM events), e AS (SELECT *, l || ' ' || h || ' ' || b || ' ' || o AS e FROM c)
SELECT {KEY}, CASE WHEN {sql_any('l', ['correcci', 'modificaci'])} OR {sql_any('h', ['correcci', 'modificaci'])} OR {sql_any('e', ['corrección plan estudio', 'correccion plan estudio'])} THEN 100
  WHEN ({sql_any('b', ['publicación plan estudios', 'publicacion plan estudios', 'plan de estudios', 'plan estudios'])} OR {sql_any('e', ['publicación plan estudios', 'publicacion plan estudios'])}) AND NOT contains(b, 'consejo de ministros') THEN 90
  WHEN contains(b, 'consejo de ministros') OR contains(e, 'acuerdo de consejo de ministros') THEN 10
  WHEN {sql_any('e', ['autorización ccaa', 'autorizacion ccaa', 'extinción', 'extincion', 'renovación acreditación', 'renovacion acreditacion'])} THEN 0 ELSE 30 END AS priority FROM e""", views=False)
def link_priority(spark, d):
    return rows(spark, d, html.link_rank(*[pick(KEY, *x) for x in (LEGENDS, HEADINGS, BEFORE, AROUND)])["priority"].alias("priority"))


LEVELS = ["Grado", "Máster - RD 822", "graduada", "Doctorado", "431", "", "GRAU"]
TITLES = ["Medicina", "Farmacia", "Ingeniería Industrial", "Abogacía", "Historia", "Doble grado en Arte", "Psicología general sanitaria", "Arquitectura", "ingenieria de montes", "PCEO", "Derecho"]
TOTALS = [None, "45,0", "12", "sin", "300"]


@query(f"""WITH x AS (SELECT {KEY}, lower({sql_pick(KEY, *LEVELS)}) AS n, lower({sql_pick(KEY, *TITLES)}) AS t, try_cast(replace(trim(coalesce({sql_pick(KEY, *TOTALS)}, '')), ',', '.') AS DOUBLE) AS own FROM events)
SELECT {KEY}, CASE WHEN own >= 30 THEN own WHEN contains(t, 'medicina') THEN 360 WHEN {sql_any('t', fixed.SPECIAL_DEGREES)} THEN 300 WHEN {sql_any('n', ['grado', 'graduado', 'graduada', 'grau'])} THEN 240
  WHEN {sql_any('n', ['máster', 'master', '431'])} THEN CASE WHEN {sql_any('t', fixed.ENGINEERING_MASTERS)} THEN 120 WHEN {sql_any('t', fixed.LAW_MASTERS)} THEN 90 ELSE 60 END ELSE 240 END::DOUBLE AS required FROM x""", views=False)
def required_credits(spark, d):
    return rows(spark, d, money.required_credits(pick(KEY, *LEVELS), pick(KEY, *TITLES), pick(KEY, *TOTALS)).alias("required"))


STATES = ["VIGENTE", "Publicado en B.O.E.", "Extinguida, vigente", "Impartiéndose", "pendiente", "En extinciÃ³n", "Renovado", "Autorizada (sin docencia)", "", "Alta"]
OLD_LEVELS = ["Grado", "Solo segundo ciclo", "Máster", "RD 56/2005 Máster", "Primer ciclo", "Doctorado", "Ciclo Largo"]
OLD_TITLES = ["Grado en X", "Licenciado en X", "Ingeniero Técnico", "Máster en Y", "  Diplomada en Z", "Arquitecto", "Grado para Licenciados", "Arquitecta técnica", "X", "Y", "Z"]
FOLDED = "translate(replace(lower(trim({})), 'ã³', 'o'), 'áéíóúñ', 'aeioun')"


@query(f"""WITH x AS (SELECT {KEY}, {FOLDED.format(sql_pick(KEY, *STATES))} AS s, {FOLDED.format(sql_pick(KEY, *OLD_LEVELS))} AS n, {FOLDED.format(sql_pick(KEY, *OLD_TITLES))} AS t FROM events)
SELECT {KEY}, {sql_any('s', fixed.ACTIVE)} AND NOT {sql_any('s', fixed.INACTIVE)} AND NOT {sql_any('n', fixed.OLD_LEVELS)} AND NOT ({' OR '.join(f"starts_with(t, {q(p)})" for p in fixed.OLD_TITLES)}) AS active FROM x""", views=False)
def active_degree_filter(spark, d):
    return rows(spark, d, text.active_degree(pick(KEY, *STATES), pick(KEY, *OLD_LEVELS), pick(KEY, *OLD_TITLES)).alias("active"))


SCHEMES = ["http://", "https://", "", "//", "http://https://"]
HOSTS = [*fixed.HOSTS, "wwwwww.boe.es", "ww.bocm.es", "www.uca.es", "dogc.gencat.cat", "WWW.EDUCACION.GOB.ES"]
REST = ["", "/a/B?c=d", "/x#y", "?q", "/"]


@query(f"""WITH x AS (SELECT {KEY}, {sql_pick(KEY, *SCHEMES)} AS s, regexp_replace(lower({sql_pick(KEY, *HOSTS)}), '^''', CASE WHEN {KEY} % {len(SCHEMES)} = 2 THEN '' ELSE '''' END) AS h, {sql_pick(f"({KEY} // 7)", *REST)} AS r FROM events),
m AS (SELECT *, CASE {" ".join(f"WHEN h = {q(a)} THEN {q(b)}" for a, b in fixed.HOSTS.items())} {" ".join(f"WHEN regexp_matches(h, {q(p)}) THEN {q(n)}" for p, n in fixed.HOST_PATTERNS)} ELSE h END AS now FROM x)
SELECT {KEY}, CASE WHEN s = 'http://' AND NOT {sql_any('now', fixed.SECURE_HOSTS)} THEN 'http://' ELSE 'https://' END || now || r AS url FROM m""", views=False)
def normalize_url(spark, d):
    """Addresses of official hosts as they were and as they are misspelt, with schemes of all sorts."""
    raw = F.concat(pick(KEY, *SCHEMES), pick(KEY, *HOSTS), F.get(F.array(*[F.lit(x) for x in REST]), (F.floor(F.col(KEY) / 7) % len(REST)).cast("int")))
    return rows(spark, d, web.normalize_url(raw).alias("url"))
