"""Text rules as column expressions; each works on null, which counts as blank unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ACCENTED, PLAIN = "áàäâãéèëêíìïîóòöôõúùüûñçýÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇÝ", "aaaaaeeeeiiiiooooouuuuncyAAAAAEEEEIIIIOOOOOUUUUNCY"
#: UTF-8 read as Latin-1.
BROKEN = {"Ã³": "o", "Ã¡": "a", "Ã©": "e", "Ã\xad": "i", "Ãº": "u", "Ã±": "n"}


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, where naming it several times would repeat it in a filter."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def has_any(c: Column, parts: list[str]) -> Column:
    return reduce(or_, [c.contains(p) for p in parts])


def zfill(c: Column, n: int) -> Column:
    """Left-padded with zeros to ``n``; never cut."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def excel_code(c: Column, n: int = 0) -> Column:
    """Code without the ".0" of a numeric cell, padded; blank stays blank."""
    t = F.regexp_replace(F.trim(blank(c)), r"\.0$", "")
    return F.when(t == "", t).otherwise(zfill(t, n))


def fold(c: Column) -> Column:
    """Lower case, broken encodings repaired, accents removed."""
    t = reduce(lambda x, kv: F.replace(x, F.lit(kv[0].lower()), F.lit(kv[1])), BROKEN.items(), F.lower(F.trim(blank(c))))
    return F.translate(t, ACCENTED, PLAIN)


def meaningful(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(F.trim(blank(c))).isin("", "none", "null", "undefined", "n/a", "nan")


def unreverse(c: Column) -> Column:
    def right(t: Column) -> Column:
        mirrored = reduce(or_, [t.endswith(x) for x in fixed.MIRRORED_ENDS] + [t.contains(x) for x in fixed.MIRRORED_PARTS])
        return F.when(mirrored, F.reverse(t)).otherwise(t)

    return let(F.trim(blank(c)), right)


def sanitize(c: Column) -> Column:
    s = F.trim(F.regexp_replace(unreverse(c), "[\\s ​]+", " "))
    return F.trim(F.regexp_replace(s, "[;:,]+$", ""))


def sanitize_subject(c: Column) -> Column:
    s = F.trim(F.regexp_replace(unreverse(c), "[\\s ​]+", " "))
    s = F.trim(F.regexp_replace(s, r"\s*\.{2,}\s*", " "))
    s = F.regexp_replace(s, r"^(?:[0-9]{4,6}|[A-Z][0-9]{3,4})\s*[-–—]\s*(?=.)", "")
    return F.regexp_replace(s, r"[.,;:\- ]+$", "")


def region(c: Column) -> Column:
    """Canonical region; an unknown name stays, blank gives blank."""
    n = F.lower(F.trim(blank(c)))
    chain = F.when(blank(c) == "", F.lit(""))
    for groups, name in fixed.REGIONS:
        chain = chain.when(reduce(and_, [has_any(n, g) for g in groups]), F.lit(name))
    return chain.otherwise(c)


def subject_type(c: Column, default: str = "OB") -> Column:
    t, chain = F.lower(blank(c)), F.when(blank(c) == "", F.lit(default))
    for parts, name in fixed.SUBJECT_TYPES:
        chain = chain.when(has_any(t, parts), F.lit(name))
    return chain.otherwise(F.lit(default))


def term(c: Column) -> Column:
    """1C, 2C or Anual; another text stays, trimmed."""
    t = F.lower(F.trim(blank(c)))
    return (
        F.when(blank(c) == "", F.lit(""))
        .when(has_any(t, fixed.TERM_YEARLY), "Anual")
        .when(t.isin(fixed.TERM_ODD) | has_any(t, fixed.TERM_ODD_PART), "1C")
        .when(t.isin(fixed.TERM_EVEN) | has_any(t, fixed.TERM_EVEN_PART), "2C")
        .otherwise(F.trim(c))
    )


def year(c: Column, ects: Column) -> Column:
    """Year 1 to 6 or blank. A number of 5 or more that equals the credits is a displaced credit figure."""
    raw = F.trim(blank(c))
    t, credits = F.lower(raw), F.floor(ects).cast("string")
    lone = F.regexp_extract(raw, r"\b([1-6])\b", 1)
    chain = F.when(raw == "", F.lit(""))
    chain = chain.when(raw.rlike("^[0-9]+$") & (F.regexp_replace(raw, "^0+(?=.)", "") == credits) & (ects >= 5), "")
    for k, forms in enumerate(fixed.YEARS, 1):
        chain = chain.when(t.isin(forms), F.lit(str(k)))
    return chain.when((lone != "") & ~((lone == credits) & (ects >= 5) & ~has_any(t, ["curso", "año", "curs"])), lone).otherwise("")


def displaced_topic(c: Column, materia: Column, ects: Column) -> Column:
    """``materia``, or the text in the year's place where that is no year and ``materia`` is blank."""
    raw = F.trim(blank(c))
    wordy = (year(c, ects) == "") & ~raw.rlike(r"\b[1-6]\b") & raw.rlike("[a-zA-ZáéíóúñÁÉÍÓÚÑ]{4,}")
    return F.when(wordy & (F.trim(blank(materia)) == ""), raw).otherwise(materia)


def title_base(c: Column) -> Column:
    """Title up to " por ", lower case, white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(F.substring_index(c, " por ", 1))), r"\s+", " ")


def name_key(c: Column) -> Column:
    """Course name without what stands in parentheses, lower case."""
    return F.trim(F.lower(F.regexp_replace(blank(c), r"\s*\(.*?\)", "")))


def tokens(c: Column, least: int = 3) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))


def section_match(title: Column, section: Column) -> Column:
    """Do the title's keywords (arrays) occur in the section: one must, of two one, of more two or half."""
    n, shared = F.size(title), F.size(F.array_intersect(title, section))
    return F.when(n == 0, False).when(n <= 2, shared >= 1).otherwise((shared >= 2) | (2 * shared >= n))


def price(c: Column, low: float, high: float) -> Column:
    """European numeral within [low, high], else null."""
    t = F.regexp_replace(blank(c), r"[^0-9.,]", "")
    both = t.contains(".") & t.contains(",")
    t = F.when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(
        t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.replace(t, F.lit("."), F.lit(""))
    ).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    v = t.try_cast("double")
    return F.when((v >= low) & (v <= high), v)


def valid_link(c: Column) -> Column:
    return (F.trim(blank(c)) != "") & ~F.lower(F.trim(blank(c))).rlike("^(#|javascript:|mailto:|tel:|whatsapp:|ftp:|data:)")


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(blank(c), r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    x, y = host(a), host(b)
    return (x != "") & (y != "") & ((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)))


def https(c: Column) -> Column:
    t = F.trim(blank(c))
    return F.when(t == "", "").when(t.startswith("http://"), F.concat(F.lit("https://"), F.substr(t, F.lit(8)))).when(
        t.startswith("https://"), t
    ).otherwise(F.concat(F.lit("https://"), t))


def csv_cell(c: Column) -> Column:
    """Quoted cell; what a spreadsheet could run as a formula gets an apostrophe."""
    t = blank(c)
    t = F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)
    return F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))


def first_number(c: Column) -> Column:
    """The first number in a text, with comma or point; null if there is none."""
    return F.nullif(F.regexp_extract(F.replace(blank(c), F.lit(","), F.lit(".")), r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def credit_summary(c: Column) -> Column:
    """Map of label to credits of the labels found."""
    found = [F.struct(F.lit(k).alias("k"), F.regexp_extract(blank(c), f"(?iu){p}", 1).alias("v")) for k, p in fixed.CREDIT_SUMMARY]
    return F.map_from_entries(F.filter(F.array(*found), lambda x: x["v"] != ""))


def active_degree(state: Column, level: Column, title: Column) -> Column:
    s, old = fold(state), reduce(or_, [fold(title).startswith(p) for p in fixed.OLD_TITLES])
    return has_any(s, fixed.ACTIVE) & ~has_any(s, fixed.INACTIVE) & ~has_any(fold(level), fixed.OLD_LEVELS) & ~old


def field_pattern(request: str | None) -> str | None:
    """Pattern of the titles of a field of knowledge; None for no filter."""
    r = (request or "").lower().strip()
    if not r or r == "todas":
        return None
    return next((p for parts, p in fixed.FIELDS if any(x in r for x in parts)), None)
