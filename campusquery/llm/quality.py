"""Quality rules and cross-document line frequency [native].

One pass over the texts takes the per-document figures and the hashes of normalised lines. The lines
of each host are counted over its documents; a line above the limit is boilerplate and is removed, and a
document that loses more than half of its line characters is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Work, table

WINDOW = 8
#: What a line must hold to count as one.
INK = r"[^\x20\x09-\x0D]"
#: 128 bits of a row's id, host and text; rows that share them are equal.
KEY = ["_k1", "_k2"]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more; the first find counts too.

    Windows are compared by 64-bit hashes, those of 2, 4 and 8 words made of pairs of the next shorter ones. Only a text with
    equal hashes sorts them by (hash, place); each place then covers the words up to the next one, eight at most.
    """

    def pairs(h: Column, apart: int) -> Column:
        """Hashes of each value and that ``apart`` places on; the last ``apart`` mean nothing."""
        return let(h, lambda a: F.zip_with(a, F.slice(a, apart + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y)))

    single = F.transform(words, lambda w: F.xxhash64(w))
    grams = F.when(F.size(words) >= WINDOW, F.slice(pairs(pairs(pairs(single, 1), 2), 4), 1, F.size(words) - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            pairs,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size(p) - 1),
                        lambda k: F.coalesce(F.get(p, k - 1)["h"] == F.get(p, k)["h"], F.lit(False))
                        | F.coalesce(F.get(p, k + 1)["h"] == F.get(p, k)["h"], F.lit(False)),
                    ),
                    lambda k: F.get(p, k)["i"],
                )
            ),
        )
        return let(
            places,
            lambda e: F.aggregate(
                F.sequence(F.lit(0), F.size(e) - 1),
                F.lit(0).cast("long"),
                lambda acc, k: acc + F.coalesce(F.least(F.get(e, k + 1) - F.get(e, k), F.lit(WINDOW)), F.lit(WINDOW)).cast("long"),
            ),
        )

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def row_key() -> list[Column]:
    cols = [f(c) for c in ("doc_id", "host", "text") for f in (F.isnull, F.col)]
    return [F.xxhash64(F.lit(k), *cols).alias(k) for k in KEY]


def features(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, host): figures, the key and ``_lines`` (hash, characters, place in the text).

    A null text has no words. A host may be null, which is a host of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(
        *row_key(),
        "doc_id",
        "host",
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda x: x["x"].rlike(INK)).alias("_placed"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    return parts.withColumn("_text_lines", F.col("_placed.x")).select(
        *KEY,
        "doc_id",
        "host",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_text_lines") - F.size(F.array_distinct("_text_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.transform("_placed", lambda x: F.struct(line_hash(x["x"]).alias("h"), F.char_length(x["x"]).alias("c"), x["i"])).alias("_lines"),
    )


def frequent_lines(feats: DataFrame, max_docs: int) -> DataFrame:
    """(host, h) of lines that more than ``max_docs`` documents of the host have.

    A document is a row; it counts a line once. Counting combines on the map side, so a line that all
    documents share makes one row per task.
    """
    once = F.array_distinct(F.transform("_lines", lambda x: x["h"]))
    lines = feats.select("host", F.explode(once).alias("h"))
    return lines.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).select("host", "h")


def line_chars(lines: Column) -> Column:
    return F.aggregate(F.filter(lines, lambda x: x.rlike(INK)), F.lit(0).cast("long"), lambda acc, x: acc + F.char_length(x))


def line_filter(work: Work, docs: DataFrame, max_docs: int = 20, max_removed: float = 0.5) -> DataFrame:
    """Each row with its figures, ``text`` without its frequent lines, ``line_chars``, ``removed_chars`` and ``depleted``.

    Depleted: over ``max_removed`` of the line characters are in frequent lines. A row without lines is
    not depleted. Blank lines stay, and so does a null text. The join with the frequent lines meets hot
    lines; both sides are plain shuffles, which adaptive execution splits. Texts are shuffled once, to
    the places of their frequent lines, and are in no saved table.
    """
    feats = work.save(features(docs), "features")
    often = work.save(frequent_lines(feats, max_docs), "often")
    lines = feats.select(*KEY, "host", F.explode("_lines").alias("x")).select(*KEY, "host", "x.h", "x.i")
    hit = lines.join(often.withColumnsRenamed({"host": "_host", "h": "_h"}), F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")))
    gone = hit.groupBy(*KEY).agg(F.collect_set("i").alias("_gone"))
    total = F.aggregate("_lines", F.lit(0).cast("long"), lambda acc, x: acc + x["c"])
    figures = feats.withColumn("line_chars", total).drop("doc_id", "host", "_lines")
    once = figures.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in figures.columns if c not in KEY])
    # Never broadcast: both grow with the documents.
    found = once.join(gone, KEY, "left")
    out = docs.select("doc_id", "host", "text", *row_key()).join(found.hint("merge"), KEY)
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i))
    out = out.withColumn("_left", F.when(F.col("_gone").isNotNull(), left))
    out = out.withColumn("removed_chars", F.when(F.col("_left").isNull(), F.lit(0)).otherwise(F.col("line_chars") - line_chars(F.col("_left"))).cast("long"))
    out = out.withColumn("text", F.when(F.col("_left").isNull(), F.col("text")).otherwise(F.array_join("_left", "\n")))
    return out.drop(*KEY, "_gone", "_left").withColumn("depleted", F.col("removed_chars") > F.col("line_chars") * F.lit(max_removed))


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and line-frequency verdict over all documents; the host is ``source``."""
    work, docs = Work(spark), table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"))
    out = line_filter(work, docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.col("depleted")).alias("kept"), "removed_chars",
    )
    return work.save(out, "rows", last=True)


SQL_OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT uid, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
k AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, list_slice(w, i, i + 7)) AS n FROM g),
p AS (SELECT uid, i, lead(i) OVER (PARTITION BY uid ORDER BY i) AS nxt FROM k WHERE n > 1),
r AS (SELECT uid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM p GROUP BY uid),
l AS (SELECT uid, host, unnest(ls) AS line FROM d),
m AS (SELECT uid, host, length(line) AS c, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm FROM l),
f AS (SELECT host, norm FROM m GROUP BY host, norm HAVING count(DISTINCT uid) > 20),
x AS (SELECT m.uid, sum(m.c) AS line_chars, coalesce(sum(m.c) FILTER (f.norm IS NOT NULL), 0) AS removed
      FROM m LEFT JOIN f ON m.norm = f.norm AND m.host IS NOT DISTINCT FROM f.host GROUP BY m.uid),
o AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(x.removed, 0)::BIGINT AS removed_chars, coalesce(x.line_chars, 0) AS line_chars
  FROM d LEFT JOIN r USING (uid) LEFT JOIN x USING (uid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND removed_chars <= 0.5 * line_chars AS kept,
       removed_chars
FROM o
"""
