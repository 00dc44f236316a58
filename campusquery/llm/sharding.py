"""Sharding by rendezvous (highest random weight) hashing [native].

Each record key scores every shard, ``weight / -ln(u)`` with ``u`` drawn from a hash of key and shard,
and goes to the highest. A new shard competes with the old ones and changes no old score, so a row moves
only where the new shard wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, ranked, table, unit_interval

SHARDS = 24


def best_shard(key: Column, weights: list[float], first: int = 0) -> Column:
    """Struct (score, shard) of the winner among shards ``first`` onward; a weight must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(first + k).alias("shard"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights)])
    scores = F.transform(
        shards,
        lambda s: F.struct(
            (s["weight"] / -F.log(unit_interval(key, s["shard"]))).alias("score"), s["shard"].alias("shard")
        ),
    )
    return F.array_max(scores)


def shard_by_key(docs: DataFrame, weights: list[float], new_weight: float = 1.0) -> DataFrame:
    """``docs`` with ``shard``, and ``grown_shard``: where the row lies once a shard of ``new_weight`` joins.

    Null keys count as one key. Text, ties and repeated rows do not matter: the key alone decides.
    """
    n = len(weights)
    scored = docs.withColumns({"_best": best_shard(F.col("doc_id"), weights), "_new": best_shard(F.col("doc_id"), [new_weight], n)})
    return scored.withColumns(
        {"shard": F.col("_best.shard"), "grown_shard": F.when(F.col("_new.score") > F.col("_best.score"), F.lit(n)).otherwise(F.col("_best.shard"))}
    ).drop("_best", "_new")


def with_slots(work: Work, sharded: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard; no task holds a shard.

    The last order key tells equal rows apart, so that a key that many rows repeat still spreads; equal
    rows are interchangeable, so the result does not depend on it.
    """
    lined = sharded.withColumn("_tie", F.monotonically_increasing_id())
    out = ranked(work, lined, ["shard"], ["doc_id", "text_crc32", "size", "_tie"], "slots")
    return out.withColumnRenamed("_rank", "slot").drop("_tie")


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards. A null text has 0 bytes and the CRC of the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    work = Work(spark)
    out = with_slots(work, shard_by_key(docs, [1.0] * SHARDS))
    return work.save(out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"), "rows", last=True)


# The law in SQL: the 64-bit hash of a key, then of a shard with that as its seed, by unsigned arithmetic modulo 2^64.

FULL = "18446744073709551615::UHUGEINT"
#: The five primes of the 64-bit hash (xxHash).
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def sql_hash(value: str, seed: str, size: int, to: str) -> str:
    """Column ``to``, by way of others: the hash of an integer of ``size`` bytes."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in PRIMES)
    times = lambda a, b: f"((({a}) * ({b})) & {FULL})"
    plus = lambda a, b: f"((({a}) + ({b})) & {FULL})"
    turn = lambda a, k: f"((({a} << {k}) & {FULL}) | ({a} >> {64 - k}))"
    if size == 8:
        steps = [times(value, p2), f"xor({plus(seed, f'{p5} + 8')}, {times(turn('{0}', 31), p1)})", plus(times(turn("{1}", 27), p1), p4)]
    else:
        steps = [times(value, p1), f"xor({plus(seed, f'{p5} + 4')}, {{0}})", plus(times(turn("{1}", 23), p2), p3)]
    steps += [times("xor({2}, {2} >> 33)", p2), times("xor({3}, {3} >> 29)", p3), "xor({4}, {4} >> 32)"]
    names = [f"{to}_{k}" for k in range(len(steps) - 1)] + [to]
    return ", ".join(f"{step.format(*names)} AS {name}" for step, name in zip(steps, names, strict=True))


SQL_OP10 = f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS uid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT uid, doc_id, octet_length(b)::BIGINT + 8 AS size,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT)), lambda crc, x: xor(t[1 + (xor(crc, x) & 255)], crc >> 8)))::BIGINT AS text_crc32
      FROM d, t),
k AS (SELECT *, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END)::UHUGEINT AS own, {sql_hash('own', '42::UHUGEINT', 8, 'h')} FROM c),
s AS (SELECT uid, shard, (CASE WHEN doc_id IS NULL THEN 42::UHUGEINT ELSE h END) AS seed, {sql_hash('shard::UHUGEINT', 'seed', 4, 'g')}, (g >> 11)::BIGINT AS u FROM k, range({SHARDS + 1}) r (shard)),
b AS (SELECT uid, arg_max(shard, u) FILTER (shard < {SHARDS})::INTEGER AS shard, arg_max(shard, u)::INTEGER AS grown_shard FROM s GROUP BY uid)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM c JOIN b USING (uid)
"""
