"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of a fixed size, which alone are sent out. Every partition scores its vectors
against the block and counts the scores of each query in a histogram; the sum over the partitions shows in
which bin the k-th best score lies, and the next round refines that bin, until a bin is one score wide. A
last pass keeps what is above that score, and of the scores equal to it the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, table

K, EVERY, SCALE = 20, 20, 64
#: Queries in a block, bins of a histogram, vectors scored at a time.
QUERIES, BINS, CHUNK = 8192, 256, 1024


def integral(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double>) with floor(scale * x), x as double.

    Null vectors, those that hold null or non-finite components and rows without an id take no part; an empty one
    does, with the score 0 against other empty ones. Components beyond 64 bits saturate.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", v.alias("v"))


class Block:
    """Queries of one length: ids, matrix, and the score range [low, low + BINS * width) that is being refined."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float):
        self.ids, self.vectors = ids, vectors
        bound = np.abs(vectors).sum(1) * reach  # no score is beyond
        self.low = -np.ceil(bound)
        widest = max(1.0, float((2 * np.ceil(bound) + 1).max()) if len(ids) else 1.0)
        self.width = 1.0
        while self.width * BINS < widest:
            self.width *= BINS
        self.live = np.ones(len(ids), bool)  # queries that have k candidates


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows of length ``dim``, CHUNK at a time."""
    for b in batches:
        lists = b.column(1)
        fit = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == dim)
        if len(fit):
            ids = b.column(0).to_numpy()[fit]
            v = lists.take(pa.array(fit)).flatten().to_numpy().reshape(len(fit), dim)
            for k in range(0, len(ids), CHUNK):
                yield ids[k : k + CHUNK], v[k : k + CHUNK]


def scores(block: Block, ids: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Scores (queries, vectors); the query's own row gets -inf. Sums of doubles are exact below 2^53 (checked)."""
    if exact:
        s = block.vectors @ v.T
    else:  # integers of any size
        s = (block.vectors.astype(object) @ v.T.astype(object)).astype(float)
    order = np.argsort(block.ids, kind="stable")
    at = np.searchsorted(block.ids[order], ids)
    for j in np.flatnonzero((at < len(order)) & (block.ids[order[np.minimum(at, len(order) - 1)]] == ids)):
        s[block.ids == ids[j], j] = -np.inf
    return s


def histogram(rows: DataFrame, shared, dim: int, k: int, exact: bool) -> DataFrame:
    """(query, bin, n) summed over all partitions; bin BINS counts the scores above the range.

    A partition leaves out its bins below the one where its own k-th best lies: the global k-th is no lower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        n = len(block.ids)
        total = np.zeros(n * (BINS + 2), np.int64)
        base = (np.arange(n) * (BINS + 2))[:, None]
        for ids, v in matrices(batches, dim):
            s = scores(block, ids, v, exact)
            s -= block.low[:, None]
            s /= block.width
            np.floor(s, out=s)
            np.clip(s, -1, BINS, out=s)
            total += np.bincount((s.astype(np.int32) + 1 + base).ravel(), minlength=len(total))
        bins = total.reshape(n, BINS + 2)[:, 1:]
        rest = bins[:, ::-1].cumsum(1)[:, ::-1] - bins  # how many lie above each bin
        query, at = np.nonzero((bins > 0) & (rest < k))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(at), pa.array(bins[query, at])], ["query", "bin", "n"])

    found = rows.mapInArrow(run, "query long, bin long, n long")
    return found.groupBy("query", "bin").agg(F.sum("n").alias("n"))


def refine(block: Block, counts: pd.DataFrame, k: int) -> None:
    """Moves each query's range to the bin that holds its k-th best score."""
    bins = np.zeros((len(block.ids), BINS + 1), np.int64)
    bins[counts["query"].to_numpy(), counts["bin"].to_numpy()] = counts["n"].to_numpy()
    upto = bins[:, ::-1].cumsum(1)  # from the top: above the range, then the highest bin, ...
    block.live &= upto[:, -1] >= k
    at = BINS - (upto >= k).argmax(1)
    block.low = np.where(block.live, block.low + at * block.width, block.low)
    block.width /= BINS


def best(rows: DataFrame, shared, dim: int, k: int, exact: bool) -> DataFrame:
    """(query_id, vec_id, score): all above a query's k-th score, and per partition the k smallest ids equal to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        query, vec, score = (np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        for ids, v in matrices(batches, dim):
            s = scores(block, ids, v, exact)
            q, j = np.nonzero((s >= np.where(block.live, block.low, -np.inf)[:, None]) & (s > -np.inf))
            query, vec, score = (np.concatenate(x) for x in ((query, q), (vec, ids[j]), (score, s[q, j])))
            order = np.lexsort((vec, -score, query))  # no partition needs more than k of a query
            query, vec, score = query[order], vec[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            query, vec, score = (x[place < k] for x in (query, vec, score))
        # Doubles hold the scores exactly; those beyond 64 bits saturate.
        value = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in score], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[query]), pa.array(query), pa.array(vec), pa.array(value)], ["query_id", "query", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, query long, vec_id long, score long")


def top_k(work: Work, vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every query; ties go to the smaller id.

    ``vectors``: (vec_id, v). Rows with the query's own id are not its candidates. Vectors of another length
    than the query's have no product with it and take no part. Two queries with equal ids both count.
    """
    spark, work = vectors.sparkSession, work.part()
    rows = work.save(vectors, "vectors")
    reach = {r[0]: r[1] or 0.0 for r in rows.groupBy(F.size("v").alias("d")).agg(F.max(F.array_max(F.transform("v", F.abs)))).collect()}
    # Queries in blocks of QUERIES rows, numbered without a global sort.
    asked = work.save(rows.filter(is_query).withColumn("_at", F.monotonically_increasing_id()), "queries")
    parts = asked.groupBy(F.shiftright("_at", 33).alias("p"), F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()
    found = []
    for dim in sorted(reach):
        own = asked.filter(F.size("v") == dim)
        group: list[int] = []
        pieces: list[tuple[list[int], int, int]] = []
        for p, _, n in sorted(x for x in parts if x[1] == dim):
            if n > QUERIES:
                pieces += [([p], a, a + QUERIES) for a in range(0, 2**33 if n > 2**32 else _last(own, p) + 1, QUERIES)]
            elif sum(x[2] for x in parts if x[1] == dim and x[0] in group) + n > QUERIES:
                pieces.append((group, 0, 2**33))
                group = [p]
            else:
                group.append(p)
        pieces += [(group, 0, 2**33)] if group else []
        for ps, a, b in pieces:
            at = F.col("_at").bitwiseAND(2**33 - 1)
            got = own.filter(F.shiftright("_at", 33).isin(ps) & (at >= a) & (at < b)).select("vec_id", "v").toPandas()
            if got.empty:
                continue
            got = got.sort_values("vec_id", kind="stable")
            block = Block(got.vec_id.to_numpy(np.int64), np.stack(got.v.to_list()), reach[dim])
            exact = float(np.abs(block.vectors).sum(1).max(initial=0)) * reach[dim] < 2**53
            while block.width >= 1:
                shared = spark.sparkContext.broadcast(block)  # QUERIES vectors
                refine(block, histogram(rows, shared, dim, k, exact).toPandas(), k)
                shared.unpersist()
            shared = spark.sparkContext.broadcast(block)
            found.append(work.save(best(rows, shared, dim, k, exact), f"best{len(found)}").withColumn("_block", F.lit(len(found))))
            shared.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("_block", "query").orderBy(F.desc("score"), "vec_id")
    out = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return work.save(out.select("query_id", "rank", "vec_id", "score"), "best", last=True)


def _last(own: DataFrame, p: int) -> int:
    return own.filter(F.shiftright("_at", 33) == p).agg(F.max(F.col("_at").bitwiseAND(2**33 - 1))).first()[0]


def op7_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors of every vector whose id is divisible by 20, over all embeddings."""
    return top_k(Work(spark), integral(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


SQL_OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS p,
             CASE WHEN p >= 9223372036854775807 THEN 9223372036854775807 WHEN p <= -9223372036854775808 THEN -9223372036854775808 ELSE try_cast(p AS BIGINT) END AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
