"""HTML by the standard parser: table rows, links and their context."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusquery.functions import web
from campusquery.functions.text import has_any, same_site, valid_link


class Tables(HTMLParser):
    """Cells of all tables, by table and row, and the number of form fields in each."""

    def __init__(self):
        super().__init__()
        self.tables, self.fields, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.fields.append(0)
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
            self.tables[-1][-1].append(self.cell)
        elif tag in ("input", "select", "textarea") and self.fields:
            self.fields[-1] += 1

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def parsed(html: str | None) -> Tables:
    parser = Tables()
    parser.feed(html or "")
    return parser


def table_rows(html: str | Tables | None) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) of a page."""
    page = html if isinstance(html, Tables) else parsed(html)
    return [(t, r, [" ".join("".join(c).split()) for c in row]) for t, rows in enumerate(page.tables) for r, row in enumerate(rows) if row]


def extract_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table, row, cells, fields) of the pages' tables, in Arrow batches; ``fields``: form fields of the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, parsed(h)) for k, h in zip(b[key], b[html], strict=True)]
            rows = [(k, *r, page.fields[r[0]]) for k, page in found for r in table_rows(page)]
            yield pd.DataFrame(rows, columns=[key, "table", "row", "cells", "fields"])

    return pages.select(key, html).mapInPandas(run, f"{key} long, table int, row int, cells array<string>, fields int")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, label) of each anchor with a quoted target; expressions alone."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)'), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    return rows.select(
        "page_id", "url", "pos", F.regexp_extract("a", r'(?is)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_extract("a", r"(?s)>([^<]*)$", 1)).alias("label")
    )


class Links(HTMLParser):
    """Links with what stands around them: legend and text of their field set, heading of their row, and the label before them."""

    LABELS = ("th", "label", "legend", "h3", "h4", "strong", "td")

    def __init__(self):
        super().__init__()
        self.links, self.sets, self.rows, self.open, self.before, self.link = [], [], [], [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "fieldset":
            self.sets.append({"legend": [], "text": []})
        elif tag == "tr":
            self.rows.append({"th": []})
        elif tag == "a" and (href := dict(attrs).get("href")) is not None:
            around = self.sets[-1] if self.sets else {"legend": [], "text": []}
            self.link = {"href": href.strip(), "label": [], **around, **(self.rows[-1] if self.rows else {"th": []}), "before": self.before}
            self.links.append(self.link)
        if tag in self.LABELS:
            self.before = []
            self.open.append((tag, self.before))
            for holder, name in ((self.sets, "legend"), (self.rows, "th")):
                if tag == name and holder and not holder[-1].get(f"has_{name}"):
                    holder[-1][name].append(self.before)
                    holder[-1][f"has_{name}"] = True

    def handle_endtag(self, tag):
        if tag == "fieldset" and self.sets:
            self.sets.pop()
        elif tag == "tr" and self.rows:
            self.rows.pop()
        elif tag == "a":
            self.link = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        for _, piece in self.open:
            piece.append(data)
        for one in self.sets:
            one["text"].append(data)
        if self.link is not None:
            self.link["label"].append(data)


def link_contexts(page: str | None) -> list[tuple[int, str, str, str, str, str, str]]:
    """(pos, href, label, legend, heading, before, around) of each link of a page; legends and headings may end after the link."""
    parser = Links()
    parser.feed(page or "")
    text = lambda pieces, sep="": sep.join(filter(None, (x.strip() for x in pieces)))
    first = lambda held: text(held[0]) if held else ""
    return [(k, x["href"], text(x["label"]), first(x["legend"]), first(x["th"]), text(x["before"]), text(x["text"], " ")) for k, x in enumerate(parser.links)]


def document_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href, label, legend, heading, before, around) of the pages' links, in Arrow batches."""
    names = ["pos", "href", "label", "legend", "heading", "before", "around"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *x) for k, h in zip(b[key], b[html], strict=True) for x in link_contexts(h)], columns=[key, *names])

    return pages.select(key, html).mapInPandas(run, f"{key} long, pos int, " + ", ".join(f"{n} string" for n in names[1:]))


def site_links(pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "url") -> DataFrame:
    """(key, base, pos, url, label) of the pages' links that may lead to studies on the same site, with their whole addresses; in Arrow batches."""

    def whole(at: str | None, href: str) -> str | None:
        try:
            return urljoin(at or "", href)
        except ValueError:  # a host that is none, such as "http://["
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, at, pos, href, whole(at, href), label) for k, at, h in zip(b[key], b[base], b[html], strict=True) for pos, href, label, *_ in link_contexts(h)]
            yield pd.DataFrame(rows, columns=[key, base, "pos", "href", "url" if base != "url" else "_url", "label"])

    to = "url" if base != "url" else "_url"
    rows = pages.select(key, base, html).mapInPandas(run, f"{key} long, {base} string, pos int, href string, {to} string, label string")
    rows = rows.filter(valid_link(F.col("href")) & web.academic(F.col("href"), F.col("label")) & same_site(F.col(to), F.col(base)))
    return rows.select(key, F.col(base).alias("base"), "pos", F.col(to).alias("url"), "label")


def best_links(links: DataFrame, key: str, level: Column, keywords: list[str] = (), most: int = 12) -> DataFrame:
    """(key, place, url, score): addresses by their best score for a level of study, ``most`` of a key; the first seen decides ties."""
    scored = links.withColumn("_s", web.url_score(F.col("url"), F.col("label"), level, keywords))
    best = scored.groupBy(key, "url").agg(F.max("_s").alias("score"), F.min("pos").alias("_pos"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "_pos"))
    return best.withColumn("place", place).filter(F.col("place") <= most).select(key, "place", "url", "score")


def link_rank(legend: Column, heading: Column, before: Column, around: Column) -> Column:
    """(priority, kind) of a document link by its context: changes of a plan 100, plans 90, agreements 10, regional steps 0, others 30."""
    legend, heading, before, around = (F.lower(F.coalesce(c, F.lit(""))) for c in (legend, heading, before, around))
    everything = F.concat_ws(" ", legend, heading, before, around)
    change = has_any(legend, ["correcci", "modificaci"]) | has_any(heading, ["correcci", "modificaci"]) | has_any(everything, ["corrección plan estudio", "correccion plan estudio"])
    published = ["publicación plan estudios", "publicacion plan estudios"]
    plan = (has_any(before, [*published, "plan de estudios", "plan estudios"]) | has_any(everything, published)) & ~before.contains("consejo de ministros")
    agreed = before.contains("consejo de ministros") | everything.contains("acuerdo de consejo de ministros")
    regional = has_any(everything, ["autorización ccaa", "autorizacion ccaa", "extinción", "extincion", "renovación acreditación", "renovacion acreditacion"])
    rank = lambda n, kind: F.struct(F.lit(n).alias("priority"), F.lit(kind).alias("kind"))
    return (
        F.when(change, rank(100, "plan_correccion")).when(plan, rank(90, "plan_inicial")).when(agreed, rank(10, "acuerdo_consejo_ministros"))
        .when(regional, rank(0, "tramite_autonomico_extincion")).otherwise(rank(30, "boe_general"))
    )
