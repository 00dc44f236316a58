"""Course tables of documents: rows of cells become courses and sums of credits, with windows and array expressions alone.

Input rows are (document, table, row, cells); tables are numbered over the whole document. One shuffle by document
carries all windows; a document is a few hundred rows, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusquery.functions import fixed, text
from campusquery.functions.text import blank, has_any

from . import state

NUMBER = r"\b([0-9]+(?:[.,][0-9]+)?)\b"
YEAR = r"(?U)\b[1-6][º°]?\b"
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
SO_FAR = (Window.unboundedPreceding, 0)


def number(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, NUMBER, 1), F.lit(","), F.lit("."))


def with_roles(rows: DataFrame, doc: str) -> DataFrame:
    """Rows but headers, with the place of each role's column: ``at`` in the whole table, ``at_subject_now`` as known at the row."""
    cells = F.transform("cells", lambda c: F.trim(F.regexp_replace(blank(c), r"\s+", " ")))
    # All windows and groups that follow are within a document; where rows already lie so, Spark leaves this shuffle out.
    rows = rows.select(doc, "table", "row", cells.alias("cells")).filter(F.exists("cells", lambda c: c != "")).repartition(doc)
    rows = rows.withColumn("_header", has_any(F.lower(F.array_join("cells", " ")), fixed.GRID_HEADER))

    def role(c: Column) -> Column:
        chain = None
        for name, words in fixed.GRID_ROLES.items():
            chain = (F if chain is None else chain).when(has_any(F.lower(c), words), name)
        return chain.otherwise("")

    found = rows.withColumn("_roles", F.when(F.col("_header"), F.reverse(F.transform("cells", role))))
    last = lambda name: F.size("cells") - F.nullif(F.array_position("_roles", name), F.lit(0))
    found = found.withColumns({f"_{r}": last(r).cast("int") for r in fixed.GRID_ROLES})
    w = Window.partitionBy(doc, "table").orderBy("row")
    known = lambda r, frame: F.last(f"_{r}", ignorenulls=True).over(w.rowsBetween(*frame))
    # A table without a column of names takes the first column of topics for them.
    subject = lambda frame: F.coalesce(known("subject", frame), F.first("_topic", ignorenulls=True).over(w.rowsBetween(*frame)))
    at = F.struct(*[(subject(ALL) if r == "subject" else known(r, ALL)).alias(r) for r in fixed.GRID_ROLES])
    placed = found.withColumns({"at": at, "_now": subject(SO_FAR)}).filter(~F.col("_header"))
    return placed.select(doc, "table", "row", "cells", "at", F.col("_now").alias("at_subject_now"))


def name_place(at: Column, cells: Column) -> Column:
    """The column of names, or the second where the first holds but a short code, else the first."""
    short = (F.size(cells) > 1) & (F.length(F.get(cells, F.lit(0))) <= 4)
    return F.when(at < F.size(cells), at).otherwise(F.when(short, 1).otherwise(0))


def stitched(rows: DataFrame, doc: str) -> DataFrame:
    """Rows whose name goes on in the next rows, joined; a rest finds no name before it only after an unnamed row, and then stands alone."""
    w = Window.partitionBy(doc, "table").orderBy("row")
    rows = rows.withColumn("_place", name_place(F.col("at_subject_now"), F.col("cells")))
    rows = rows.withColumn("_t", F.get("cells", F.col("_place")))
    first = F.substring("_t", 1, 1)
    small = (F.lower(first) == first) & (F.upper(first) != first)
    others = F.filter("cells", lambda c, i: i != F.col("_place"))
    starts = F.lower("_t").rlike("^(" + "|".join(fixed.FRAGMENT_STARTS) + ")")
    rows = rows.withColumn("_rest", ~F.exists(others, lambda c: c.rlike(NUMBER)) & (F.col("_t") != "") & (small | starts))
    before = F.lag("cells").over(w)
    unnamed = ~F.lag("_rest").over(w) & (F.get(before, name_place(F.col("at_subject_now"), before)) == "")
    rows = rows.withColumn("_head", ~F.col("_rest") | before.isNull() | unnamed)
    rows = rows.withColumn("_k", F.sum(F.col("_head").cast("int")).over(w.rowsBetween(*SO_FAR)))
    rest = F.collect_list(F.when(~F.col("_head"), F.struct("row", "_t", F.col("at_subject_now").alias("s"))))
    joined = rows.groupBy(doc, "table", "_k").agg(F.min("row").alias("row"), F.min_by("cells", "row").alias("cells"), F.first("at").alias("at"), F.array_sort(rest).alias("_rest"))
    place = name_place(F.get("_rest", F.lit(0))["s"], F.col("cells"))
    longer = lambda c: F.aggregate("_rest", c, lambda acc, x: F.trim(F.concat(F.regexp_replace(acc, r"[ :\-,]+$", ""), F.lit(" "), x["_t"])))
    whole = F.when(F.size("_rest") == 0, F.col("cells")).otherwise(F.transform("cells", lambda c, i: F.when(i == place, longer(c)).otherwise(c)))
    return joined.select(doc, "table", "row", whole.alias("cells"), "at")


def valid_name(c: Column) -> Column:
    """Is this text a course name: 4 to 150 characters with a word in it, and no label, law, signature, centre or degree."""
    ok = (F.length(c) > 3) & (F.length(c) <= 150) & c.rlike("[a-zA-ZáéíóúñÁÉÍÓÚÑ]{3,}") & ~c.rlike(r"([A-ZÁÉÍÓÚÑ])\1{2,}")
    for p in fixed.NO_COURSE_NAME:
        ok = ok & ~c.rlike(f"(?iuU){p}")
    return ok & ~F.lower(F.trim(c)).isin(fixed.NO_COURSE_WORD)


def table_signs(c: Column) -> list[Column]:
    """Does a table's text, or a line of it, show courses, and a scale of marks."""
    t = F.lower(blank(c))
    return [has_any(t, fixed.COURSE_TABLE), has_any(t, fixed.MARKS_TABLE)]


def valid_table(c: Column, inputs: Column) -> Column:
    """Is this text of a table (``inputs``: its form fields) one of courses, neither a form nor a scale of marks."""
    courses, marks = table_signs(c)
    return (inputs == 0) & ~marks & courses


def table_lines(rows: DataFrame, doc: str) -> DataFrame:
    """One row per named line: name, credits, type, year and term as found, topic in force, and ``sum`` for sums of credits.

    Lines that name a module or topic alone read as headers, so modules stay blank and topics come from their own column.
    """
    rows = stitched(with_roles(rows, doc), doc)
    cells, at = F.col("cells"), F.col("at")
    cell = lambda r: F.get(cells, at[r])
    own_topic = ~at["topic"].eqNullSafe(at["subject"]) & (at["topic"] < F.size(cells))
    w = Window.partitionBy(doc).orderBy("table", "row").rowsBetween(*SO_FAR)
    rows = rows.withColumn("_event", F.when(own_topic, cell("topic")))
    rows = rows.withColumns({"materia": F.coalesce(F.last("_event", ignorenulls=True).over(w), F.lit("")), "_n": F.count("_event").over(w)})

    c0, c1 = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
    code = (F.length(c0) <= 4) | c0.rlike("(?U)^[1-6][º°]?\\b") | c0.rlike("^[0-9]+$")
    name = F.when(at["subject"] < F.size(cells), cell("subject")).when((F.size(cells) > 1) & code & (F.length(c1) > 3), c1).otherwise(c0)
    rows = rows.withColumn("_name", name)
    moved = (F.size(cells) > 1) & ~at["topic"].eqNullSafe(at["subject"]) & (F.lower("_name") == F.lower("materia")) & ~c1.rlike("^" + NUMBER) & (F.length(c1) > 3)
    first = lambda xs: F.get(xs, F.lit(0))
    mapped = F.nullif(number(blank(cell("ects"))), F.lit(""))
    listed = first(F.filter(F.transform("cells", number), lambda x: x.try_cast("double").isin([float(k) for k in fixed.COURSE_CREDITS])))
    kind = F.nullif(text.subject_type(cell("kind")), F.lit("OB"))
    other = first(F.filter(F.transform("cells", lambda c: text.subject_type(c)), lambda x: x != "OB"))
    rows = rows.withColumns({
        "nombre": text.sanitize_subject(F.when(moved, c1).otherwise(F.col("_name"))), "_ects": F.coalesce(mapped, listed), "caracter": F.coalesce(kind, other, F.lit("OB")),
        "_curso": F.coalesce(F.nullif(cell("year"), F.lit("")), first(F.filter("cells", lambda c: c.rlike(YEAR))), F.lit("")),
        "_term": F.coalesce(F.nullif(cell("term"), F.lit("")), first(F.filter("cells", lambda c: has_any(F.lower(c), ["cuatrimestre", "semestre"]))), F.lit("")),
    })
    curricular = F.col("_ects").isNotNull() | at["ects"].isNotNull() | at["kind"].isNotNull() | at["year"].isNotNull()
    rows = rows.filter(curricular & text.let(F.col("nombre"), valid_name)).withColumn("ects", F.coalesce("_ects", F.lit("6")))
    n, low = F.col("ects").try_cast("double"), F.lower("nombre")
    single = F.col("caracter").isin("TFG/TFM", "PE")
    sums = F.trim("nombre").rlike(f"(?iu){fixed.SUMMARY_LABEL}") | (n > 30) | ((n > 18) & ~single) | (n <= 0) | has_any(low, ["reconocimiento", "artículo 12.8", "total ", "total:"])
    return rows.select(doc, "table", "row", "nombre", "ects", "caracter", "_curso", "_term", "materia", "_n", sums.alias("sum"))


def summary(lines: DataFrame, doc: str) -> DataFrame:
    """(document, label, credits) of the sums of credits; the last of a label counts, and what isn't above 0 reads "0-6"."""
    credits = F.when(F.col("ects").try_cast("double") > 0, F.col("ects")).otherwise("0-6")
    return lines.filter("sum").groupBy(doc, F.col("nombre").alias("etiqueta")).agg(F.max_by(credits, F.struct("table", "row")).alias("creditos"))


def courses(lines: DataFrame, doc: str) -> DataFrame:
    """Courses, one per name and document; a text in the year's place becomes the topic where none is in force."""
    n = F.col("ects").try_cast("double")
    free = F.nullif(text.displaced_topic(F.col("_curso"), F.lit(""), n), F.lit(""))
    w = Window.partitionBy(doc, "_n").orderBy("table", "row").rowsBetween(*SO_FAR)
    topic = F.when(F.col("materia") != "", F.col("materia")).otherwise(F.coalesce(F.first(free, ignorenulls=True).over(w), F.lit("")))
    rows = lines.filter("not sum").withColumns({
        "modulo": F.lit(""), "materia": text.sanitize(topic), "curso": text.year(F.col("_curso"), n), "cuatrimestre": text.term(F.col("_term")),
        "_key": F.lower(F.trim(F.regexp_replace("nombre", r"(?U)[^\w\s]", ""))),
    })
    one = state.first_with_fill(rows, doc, "_key", ["table", "row"], ["curso", "cuatrimestre"], "caracter")
    return one.select(doc, "table", "row", "modulo", "materia", "nombre", "ects", "caracter", "curso", "cuatrimestre")


def keywords(title: Column, university: Column) -> Column:
    """Telling words of a title: folded, three letters or more, without stop words and the university's own name."""
    own = F.array_union(F.array(*[F.lit(w) for w in fixed.STOP_WORDS]), text.tokens(blank(university)))
    return F.array_except(text.tokens(blank(title)), own)


def degree_pages(pages: DataFrame, doc: str, title: str = "titulo", university: str = "universidad") -> DataFrame:
    """``pages`` (document, page from 0, text) with ``included``: does the page belong to the degree ``title``.

    A document publishes several degrees if the keyword sets of its headings don't nest, that is, if in order of size
    one isn't part of the next. Then a page belongs to the last heading up to it; with one degree, or a title without keywords, all do.
    """
    t = blank(F.col("text"))
    annex = F.regexp_instr(t, F.lit(r"(?iu)\bANEXO\b"))
    signed = F.regexp_extract(t, rf"(?isu)^.*?{fixed.SIGNATURE}(.*)$", 1)
    after = F.when(F.col("page") > 0, t).when(annex > 0, F.substr(t, annex)).when(signed != "", signed).otherwise(t)
    found = F.transform(F.flatten(F.array(*[F.regexp_extract_all(after, F.lit(f"(?iu){p}"), F.lit(0)) for p in fixed.SECTION_MARKERS])), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    sets = F.transform(F.filter(found, lambda s: ~s.rlike(f"(?iu){fixed.PREAMBLE}")), lambda s: keywords(s, F.col(university)))
    rows = pages.withColumns({"_sets": F.filter(sets, lambda s: F.size(s) > 0), "_target": keywords(F.col(title), F.col(university))}).repartition(doc)
    # Once a document, not once a page: a list of all headings in each page's row would grow with the square of the pages.
    by_size = F.array_sort(F.transform(F.flatten(F.collect_list("_sets")), lambda s: F.struct(F.size(s).alias("n"), F.array_sort(s).alias("s"))))
    heads = rows.filter(F.size("_sets") > 0).groupBy(doc).agg(by_size.alias("_all"))
    apart = F.exists(F.sequence(F.lit(1), F.size("_all") - 1), lambda k: F.size(F.array_except(F.get("_all", (k - 1).cast("int"))["s"], F.get("_all", k.cast("int"))["s"])) > 0)
    heads = heads.select(F.col(doc).alias("_doc"), F.when(F.size("_all") >= 2, apart).otherwise(False).alias("_apart"))
    rows = rows.join(heads.hint("merge"), F.col(doc) == F.col("_doc"), "left")
    several = F.coalesce("_apart", F.lit(False)) & (F.size("_target") > 0)
    heading = F.when(F.size("_sets") > 0, text.section_match(F.col("_target"), F.element_at("_sets", -1)))
    now = F.coalesce(F.last(heading, ignorenulls=True).over(Window.partitionBy(doc).orderBy("page").rowsBetween(*SO_FAR)), F.lit(False))
    return rows.withColumn("included", ~several | now).drop("_sets", "_target", "_doc", "_apart")


def text_courses(docs: DataFrame, doc: str, body: str = "text") -> DataFrame:
    """(document, row, nombre, ects, caracter, sum) of lines such as "Cálculo 6 OB", for documents whose tables give nothing."""
    rows = docs.select(doc, F.posexplode(F.split(F.col(body), "\r\n|\r|\n")).alias("row", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    form = f"(?iu){fixed.COURSE_LINE}"
    rows = rows.filter((F.length("line") >= 6) & F.col("line").rlike(form) & ~has_any(F.lower("line"), fixed.NO_COURSE_LINE))
    part = lambda k: F.regexp_extract("line", form, k)
    rows = rows.select(doc, "row", text.sanitize_subject(part(1)).alias("nombre"), F.replace(part(2), F.lit(","), F.lit(".")).alias("ects"), text.subject_type(part(3)).alias("caracter"))
    noise = lambda name: name.rlike(f"(?iu){fixed.NO_COURSE_NAME[1]}") | name.rlike(f"(?iuU){fixed.NO_COURSE_NAME[2]}")
    n = F.col("ects").try_cast("double")
    rows = rows.filter(~text.let(F.col("nombre"), noise)).withColumn("sum", (n > 18) | F.col("nombre").rlike(f"(?iu){fixed.SUMMARY_LABEL}"))
    return rows.filter(F.col("sum") | n.isin([float(k) for k in fixed.LINE_CREDITS]))


def web_courses(tables: DataFrame, page: str) -> DataFrame:
    """Courses in the tables of web pages (page, table, row, cells, fields), one per name and page; credits are 6 where none are found.

    A row with a header word anywhere is a header, and its columns hold for the rows below it.
    """
    line = F.lower(F.array_join("cells", " "))
    rows = tables.withColumns({"_line": line, "_header": has_any(line, fixed.WEB_HEADER) & (F.size("cells") >= 2)})
    table = Window.partitionBy(page, "table")
    shows, marks = (F.max(x).over(table) for x in table_signs(F.col("_line")))  # as ``valid_table`` of the whole table, whose signs lie within lines
    real = (F.col("fields") == 0) & shows & ~marks

    def role(c: Column) -> Column:
        chain = None
        for name, words in fixed.WEB_ROLES.items():
            chain = (F if chain is None else chain).when(has_any(F.lower(c), words), name)
        return chain.otherwise("")

    rows = rows.withColumns({"_real": real, "_roles": F.when(F.col("_header"), F.reverse(F.transform("cells", role)))})
    so_far = table.orderBy("row").rowsBetween(*SO_FAR)
    rows = rows.withColumns({f"_{r}": F.last((F.size("cells") - F.nullif(F.array_position("_roles", r), F.lit(0))).cast("int"), ignorenulls=True).over(so_far) for r in fixed.WEB_ROLES})
    rows = rows.filter(F.col("_real") & ~F.col("_header") & (F.size("cells") >= 2))

    c0, c1, here = F.get("cells", F.lit(0)), F.get("cells", F.lit(1)), F.get("cells", F.coalesce("_subject", F.lit(0)))
    digits, code = "^[0-9]+$", (F.length(c0) <= 4) | c0.rlike("^[0-9]+$") | F.lower(c0).rlike("^[1-6][º°a-z]*$")
    name = F.when((F.length(here) >= 4) & ~here.rlike(digits), here).when(code & (F.length(c1) >= 4), c1).otherwise(c0)
    ok = lambda x: (F.length(x) >= 4) & (F.length(x) <= 150) & x.rlike("[a-zA-ZáéíóúñÁÉÍÓÚÑ]{3,}") & ~has_any(F.lower(x), fixed.WEB_HEADER) & ~has_any(F.lower(x), fixed.NO_WEB_COURSE)
    first = lambda xs: F.get(xs, F.lit(0))
    rest = F.slice("cells", 2, F.size("cells"))
    mapped = lambda r: F.col(f"_{r}") < F.size("cells")
    cell = lambda r: F.get("cells", F.col(f"_{r}"))
    whole = lambda x: F.regexp_replace(F.regexp_replace(x, r"^0+(?=[0-9])", ""), r"\.0+$|(?<=\.[0-9])0+$", "")
    found = whole(first(F.filter(F.transform(rest, number), lambda x: x.try_cast("double").between(1, 60))))
    rows = rows.withColumn("nombre", name).filter(text.let(F.col("nombre"), ok)).select(
        page, "table", "row", "nombre", F.coalesce(F.nullif(F.when(mapped("ects"), number(cell("ects"))).otherwise(found), F.lit("")), F.lit("6")).alias("ects"),
        F.when(mapped("kind"), text.subject_type(cell("kind"))).otherwise(F.coalesce(first(F.filter(F.transform("cells", lambda c: text.subject_type(c, "")), lambda x: x != "")), F.lit("OB"))).alias("caracter"),
        F.when(mapped("year"), cell("year")).otherwise(F.coalesce(first(F.filter(rest, lambda c: has_any(F.lower(c), fixed.WEB_YEARS))), F.lit(""))).alias("curso"),
    )
    place = F.row_number().over(Window.partitionBy(page, F.lower("nombre")).orderBy("table", "row"))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")
