"""Addresses, scores of links and prices in page text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import blank, has_any, let, price


def normalize_url(c: Column) -> Column:
    """One scheme, official hosts as they are served now, securely where they must be; blank gives blank."""
    moved = F.create_map(*[F.lit(x) for kv in fixed.HOSTS.items() for x in kv])

    def schemed(single: Column) -> Column:
        return F.when(single.rlike("^https?://"), single).when(single.startswith("//"), F.concat(F.lit("https:"), single)).when(
            single.startswith("/"), F.concat(F.lit("https://www.boe.es"), single)
        ).otherwise(F.concat(F.lit("https://"), single))

    def served(host: Column) -> Column:
        chain = F.when(moved[host].isNotNull(), moved[host])
        for pattern, name in fixed.HOST_PATTERNS:
            chain = chain.when(host.rlike(pattern), name)
        return chain.otherwise(host)

    def joined(full: Column) -> Column:
        scheme, host, rest = (F.regexp_extract(full, r"^(https?)://([^/?#]*)(.*)$", k) for k in (1, 2, 3))
        secured = lambda now: F.concat(F.when(has_any(now, fixed.SECURE_HOSTS), "https").otherwise(scheme), F.lit("://"), now, rest)
        return let(let(F.lower(host), served), secured)

    raw = F.regexp_replace(F.trim(blank(c)), "^['\"` ]+|['\"` ]+$", "")
    single = F.regexp_replace(raw, "^(?:https?://)+(?=https?://)", "")
    return let(single, lambda s: F.when(s == "", "").otherwise(let(schemed(s), joined)))


def url_score(url: Column, label: Column, level: Column, keywords: list[str] = ()) -> Column:
    """Worth of a link for a level of study: 10, more for words of the level, of offers and of the title, 80 less (1 at least) for offices."""
    u, t, n = F.lower(blank(url)), F.lower(blank(label)), F.lower(blank(level))
    chain = None
    for names, addresses, labels in fixed.LEVEL_WORDS.values():
        worth = F.when(has_any(u, addresses), 90).when(has_any(t, labels), 70).otherwise(0)
        chain = (F if chain is None else chain).when(has_any(n, names), worth)
    s = F.lit(10) + chain.otherwise(0) + F.when(has_any(u, fixed.OFFER_ADDRESS), 50).otherwise(0) + F.when(has_any(t, fixed.OFFER_LABEL), 40).otherwise(0)
    if keywords:
        words = [k.lower() for k in keywords]
        s = s + F.when(has_any(u, words) | has_any(t, words), 40).otherwise(0)
    return F.when(has_any(u, fixed.OFFICE_ADDRESS), F.greatest(F.lit(1), s - 80)).otherwise(s)


def match_words(title: Column) -> Column:
    """Words of a title by which a link may name a degree: of three letters or more, as split at white space, but common ones."""
    words = F.split(F.trim(blank(title)), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(fixed.LINK_STOP_WORDS))


def academic(url: Column, label: Column) -> Column:
    """May a link lead to studies, by a word in its label or address."""
    return has_any(F.lower(blank(label)), fixed.STUDY_ADDRESS) | has_any(F.lower(blank(url)), fixed.STUDY_ADDRESS)


def page_extinct(page: Column, state: Column) -> Column:
    """Does a degree's page, anywhere in its text or in its state, say that the degree has ended."""
    return has_any(F.lower(blank(page)), fixed.ENDED) | has_any(F.lower(blank(state)), fixed.ENDED)


def list_extinct(page: Column) -> Column:
    """Does the list of a degree's states, looked at where its page has no documents, say that it has ended."""
    up = F.upper(blank(page))
    return up.contains("EXTINGUID") | up.contains("SIN DOCENCIA")


def web_plan(courses: Column, title: Column) -> Column:
    """A plan made of courses (array) from web pages: the credits of a Grado or of another title, the number, and the courses."""
    total = F.when(F.lower(blank(title)).contains("grado"), "240").otherwise("60")
    return F.struct(F.create_map(F.lit("Créditos Totales"), total).alias("resumen_creditos"), F.size(courses).alias("total_elementos"), courses.alias("elementos_curriculares"))


def first_price(c: Column, patterns: list[str], low: float, high: float) -> Column:
    """The first pattern whose first match is a number in range; a match out of range isn't tried again."""
    return F.coalesce(*[price(F.regexp_extract(c, f"(?u){p}", 1), low, high) for p in patterns])


def private_prices(c: Column) -> dict[str, Column]:
    """Prices in the text of a private university's page: per credit at four enrolments, and a year; each gives the other by 60."""
    t = F.lower(blank(c))
    base, year = first_price(t, fixed.CREDIT_PRICE, 15, 500), first_price(t, fixed.ANNUAL_PRICE, 1000, 45000)
    tiers = [F.coalesce(first_price(t, p, 15, 500), base) for p in fixed.TIER_PRICE]
    return {"precio_1": F.coalesce(base, F.round(year / 60, 2))} | {f"precio_{k}": x for k, x in enumerate(tiers, 2)} | {"precio_anual": F.coalesce(year, F.round(base * 60, 2))}
