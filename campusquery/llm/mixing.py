"""Mixing sources to target weights by pivotal dependent rounding [native].

A source's target over its size is the copies each of its documents should get; the whole part is given
to all, the fraction is rounded. Two documents that are still fractional move mass (size times fraction)
from one to the other until one is integral; which way is drawn so that every expectation stays. One
fractional document is left of a block; the left-overs of 128 blocks meet in the next level, until one
is left of each source. So the words taken of a source miss its
target by one document at most; then one document is turned over where that brings them nearer.

Rows equal in id, size and source are one unit: as many of them as their number times the fraction get a
further copy outright, and the rest of that number is the fraction of one more row, which alone is rounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, Work, ranked, table, unit_interval

BLOCK = 128
MAX_COPIES = 3
#: Equal rows that one task makes of a unit.
PIECE = 4096
KEY = ["src_null", "src"]


def word_count(text):
    """Number of words; 0 of a null text."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(t, SPACE), lambda w: w != "")).cast("long")


def source_key(source):
    """Two columns without nulls; a null source sorts last."""
    return [source.isNull().alias("src_null"), F.coalesce(source, F.lit("")).alias("src")]


def targets(work: Work, sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Per source: source_size, weight and target; weights repeat over the sources in code-point order.

    A target stops at three times the source's size; what is left is shared by weight among the others, until
    none is above. Each round is one small aggregate; sources are never collected.
    """
    ranks = ranked(work, sizes, [], KEY, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    src = work.save(ranks.select(*KEY, "source_size", weight.alias("weight")), "weights")
    limit = MAX_COPIES * F.col("source_size")
    total = float(src.agg(F.sum("source_size")).first()[0] or 0)
    share, capped = None, -1
    while True:
        full = F.lit(False) if share is None else limit < F.lit(share) * F.col("weight")
        n, held, free = src.agg(
            F.count_if(full), F.sum(F.when(full, limit).otherwise(0)).cast("double"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))
        ).first()
        if n == capped or not free:
            break
        share, capped = (total - held) / free, n
    target = F.lit(0.0) if share is None else F.least(limit.cast("double"), F.lit(share) * F.col("weight"))
    return work.save(src.select("*", target.alias("target")), "targets")


#: One step of the pivot: ``acc`` carries a fractional unit (k, w, p), ``x`` meets it; decided units go to ``out``.
STEP = """
aggregate(units,
  named_struct('c', cast(null as struct<k:struct<doc_id:bigint,size:bigint>,w:double,p:double>),
               'out', cast(array() as array<struct<k:struct<doc_id:bigint,size:bigint>,take:int>>)),
  (acc, x) -> if(acc.c is null,
    named_struct('c', named_struct('k', x.k, 'w', x.w, 'p', x.p), 'out', acc.out),
    if(x.u * (least(acc.c.w * (1 - acc.c.p), x.w * x.p) + least(acc.c.w * acc.c.p, x.w * (1 - x.p)))
         < least(acc.c.w * acc.c.p, x.w * (1 - x.p)),
      if(acc.c.w * (1 - acc.c.p) <= x.w * x.p,
        named_struct('c', named_struct('k', x.k, 'w', x.w, 'p', greatest(0D, x.p - acc.c.w * (1 - acc.c.p) / x.w)),
                     'out', concat(acc.out, array(named_struct('k', acc.c.k, 'take', 1)))),
        named_struct('c', named_struct('k', acc.c.k, 'w', acc.c.w, 'p', least(1D, acc.c.p + x.w * x.p / acc.c.w)),
                     'out', concat(acc.out, array(named_struct('k', x.k, 'take', 0))))),
      if(acc.c.w * acc.c.p <= x.w * (1 - x.p),
        named_struct('c', named_struct('k', x.k, 'w', x.w, 'p', least(1D, x.p + acc.c.w * acc.c.p / x.w)),
                     'out', concat(acc.out, array(named_struct('k', acc.c.k, 'take', 0)))),
        named_struct('c', named_struct('k', acc.c.k, 'w', acc.c.w, 'p', greatest(0D, acc.c.p - x.w * (1 - x.p) / acc.c.w)),
                     'out', concat(acc.out, array(named_struct('k', x.k, 'take', 1))))))))
"""


def round_fractions(work: Work, units: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(src_null, src, doc_id, size, take) of ``units`` (src_null, src, k, w, p, block); blocks: the most of a source."""
    done, level = [], 0
    while True:
        u, order = (unit_interval(F.lit(f"{seed}:{what}:{level}"), F.col("k.doc_id"), F.col("k.size")) for what in ("u", "order"))
        met = units.groupBy(*KEY, "block").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "k", "w", "p", u.alias("u")))).alias("units"))
        met = work.save(met.select(*KEY, "block", F.expr(STEP).alias("s")), f"level{level}")
        out = met.select(*KEY, F.explode("s.out").alias("x")).select(*KEY, "x.k.doc_id", "x.k.size", "x.take")
        left = met.select(*KEY, "block", "s.c.k", "s.c.w", "s.c.p")
        done.append(out)
        if blocks <= 1:
            last = unit_interval(F.lit(f"{seed}:last"), F.col("k.doc_id"), F.col("k.size")) < F.col("p")
            done.append(left.select(*KEY, "k.doc_id", "k.size", last.cast("int").alias("take")))
            return reduce(DataFrame.unionAll, done)
        units, blocks, level = left.withColumn("block", F.floor(F.col("block") / BLOCK)), -(-blocks // BLOCK), level + 1


def settle(rated: DataFrame, took: DataFrame, work: Work) -> DataFrame:
    """``took`` after one document a source, at most, is turned over: that whose words come nearest to the miss.

    The last left-over of a source may be a long document; this keeps it from deciding how near the target is.
    """
    name = {c: F.col(c).alias(f"_{c}") for c in ("doc_id", "size", *KEY, "take")}
    took = took.select(*name.values())
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size"))
    both = rated.join(took, same & (F.col("src") == F.col("_src")) & (F.col("src_null") == F.col("_src_null")), "left")
    both = work.save(both.drop("_doc_id", "_size", "_src", "_src_null"), "rounded")
    given = F.col("size") * (F.col("n_rows") * F.col("whole") + F.col("n_more") + F.coalesce("_take", F.lit(0)))
    miss = both.groupBy(*KEY).agg((F.sum(given) - F.first("target")).alias("_miss"))
    miss = F.broadcast(miss) if miss.count() <= BROADCAST_ROWS else miss
    left = F.abs(F.abs("_miss") - F.col("size"))
    able = both.join(miss, KEY).filter((F.col("_take") == (F.col("_miss") > 0).cast("int")) & (left < F.abs("_miss")))
    turned = able.groupBy(*KEY).agg(F.min(F.struct(left.alias("l"), F.col("doc_id").alias("d"), F.col("size").alias("s"))).alias("_turn"))
    turned = work.save(turned, "turned")
    turned = F.broadcast(turned) if turned.count() <= BROADCAST_ROWS else turned
    hit = F.col("_turn").isNotNull() & F.col("doc_id").eqNullSafe(F.col("_turn.d")) & (F.col("size") == F.col("_turn.s"))
    take = F.coalesce("_take", F.lit(0))
    return both.join(turned, KEY, "left").withColumn("n_more", F.col("n_more") + F.when(hit, 1 - take).otherwise(take))


def copies(work: Work, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 1) -> DataFrame:
    """Distinct (doc_id, size, source) of ``docs`` with ``n_rows``, ``source_size``, ``target``, ``whole`` and ``n_more``.

    Each of the ``n_rows`` equal rows gets ``whole`` copies, and ``n_more`` of them one more. No block grows with
    repeats. Null ids and sources are values like others. A document of size 0 gets no copy beyond the
    whole part of its rate, and of a source of size 0 none.
    """
    work = work.part()
    named = docs.select("doc_id", "size", *source_key(F.col("source")))
    distinct = work.save(named.groupBy("doc_id", "size", *KEY).agg(F.count("*").alias("n_rows")), "units")
    sums = distinct.groupBy(*KEY).agg(F.sum(F.col("size") * F.col("n_rows")).cast("long").alias("source_size"), F.count("*").alias("n_units"))
    sums = work.save(sums, "sums")
    goal = targets(work, sums, weights).join(sums.select(*KEY, "n_units"), KEY)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select(*KEY, "source_size", "target", F.ceil(F.col("n_units") / BLOCK).alias("n_blocks"), rate.alias("rate"))
    goal = work.save(goal.withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("int")), "goal")
    n, blocks = goal.agg(F.count("*"), F.max("n_blocks")).first()
    rated = distinct.join(F.broadcast(goal) if n <= BROADCAST_ROWS else goal, KEY)
    share = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")) * F.col("n_rows")).otherwise(0.0)
    rated = rated.withColumn("n_more", F.floor(share + 1e-12).cast("long"))
    units = rated.withColumn("p", share - F.col("n_more")).filter("p > 1e-12").select(
        *KEY, F.struct("doc_id", "size").alias("k"), F.col("size").cast("double").alias("w"), "p",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_blocks")).alias("block"),
    )
    took = round_fractions(work, units, blocks or 1, seed)
    out = settle(rated, took, work).select("doc_id", "size", *KEY, "n_rows", "source_size", "target", "whole", "n_more")
    return work.save(out, "copies", last=True)


def place_among_equals(work: Work, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``_place``, gapless from 0 among the rows equal in ``key``; a task holds a group's rows of one partition at most."""
    rows = work.save(rows.withColumn("_at", F.monotonically_increasing_id()), "equals")
    rows = rows.withColumn("_pid", F.shiftright("_at", 33))
    own = Window.partitionBy("_pid", *key)
    parts = rows.groupBy("_pid", *key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_p_{k}") for k in ("_pid", *key)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    same = F.lit(True)
    for k in ("_pid", *key):
        same = same & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    numbered = rows.withColumn("_own", F.row_number().over(own.orderBy("_at")) - 1)
    return numbered.join(parts, same).withColumn("_place", F.col("_own") + F.col("_skip")).drop("_at", "_pid", "_own", "_skip", *[f"_p_{k}" for k in ("_pid", *key)])


def mix(work: Work, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 1) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it (0 to 3 times), in the columns of ``docs``.

    Null texts count 0 words. Where rows equal in id, size and source get different numbers of copies, their order decides.
    """
    names = docs.columns
    sized = docs.withColumn("_size", word_count(F.col("text")))
    got = copies(work, sized.select("doc_id", F.col("_size").alias("size"), "source"), weights, seed)
    got = got.filter((F.col("whole") > 0) | (F.col("n_more") > 0)).withColumn("uneven", (F.col("n_more") > 0) & (F.col("n_more") < F.col("n_rows")))
    got = got.select(*[F.col(c).alias(f"_m_{c}") for c in ("doc_id", "size", *KEY, "whole", "n_more", "uneven")])
    null, src = source_key(F.col("source"))
    same = F.col("doc_id").eqNullSafe(F.col("_m_doc_id")) & (F.col("_size") == F.col("_m_size"))
    # Never broadcast: the copies grow with the documents, and their files are far smaller than their rows.
    join = lambda some: sized.join(some.hint("merge"), same & (null == F.col("_m_src_null")) & (src == F.col("_m_src")))
    again = lambda rows, n: rows.filter(n > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).select(*names)
    even = again(join(got.filter("not _m_uneven")), (F.col("_m_whole") + (F.col("_m_n_more") > 0).cast("int")).cast("int"))
    uneven = got.filter("_m_uneven")
    if not uneven.limit(1).count():
        return even
    placed = place_among_equals(work, join(uneven), ["_m_doc_id", "_m_size", "_m_src_null", "_m_src"])
    return even.unionByName(again(placed, (F.col("_m_whole") + (F.col("_place") < F.col("_m_n_more")).cast("int")).cast("int")))


def rows_again(units: DataFrame, most: int) -> DataFrame:
    """A row of ``units`` for each of its ``n_rows`` rows, with ``_place`` from 0; hot units are dealt out in pieces of PIECE rows."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(PIECE).cast("long")))
    pieces = units.withColumn("_start", start)
    pieces = pieces.repartition("doc_id", "size", "_start") if most > PIECE else pieces
    last = F.least(F.col("_start") + PIECE, F.col("n_rows")) - 1
    return pieces.withColumn("_place", F.explode(F.sequence("_start", last))).drop("_start")


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every row of ``documents``; weights 1, 2, 3 repeat over the sources. A null text has size 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    units = copies(Work(spark), docs)
    out = rows_again(units, units.agg(F.max("n_rows")).first()[0] or 0)
    n = F.col("whole") + (F.col("_place") < F.col("n_more")).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * n).cast("long").alias("taken"))
