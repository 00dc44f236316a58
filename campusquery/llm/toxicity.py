"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

The model is fitted on a bounded, documented sample of labelled rows; every whole text is then scored.
N-grams are hashed to 2^20 buckets; of these, the most telling have a weight: those in three sampled texts or more
whose class shares differ by more than chance (``MIN_TELLING``), ``FEATURES`` at most. Other n-grams count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, table

BITS = 20
ORDERS = (4, 5)
#: Labelled rows of each class that the fit sees at most, buckets that get a weight at most.
SAMPLE, FEATURES = 3000, 1 << 14
#: Squared z of the difference of the class shares from which a bucket is taken for more than chance.
MIN_TELLING = 12.0
THRESHOLD = 0.3
#: Characters hashed at a time; a longer text is hashed whole, by itself.
SLICE = 1 << 20


def buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place of ``codes`` (uint32 code points)."""
    size = len(codes) - n + 1
    h = np.full(max(size, 0), np.uint32(n), np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193 * 2 + 0x9E37)
        h ^= codes[k : k + max(size, 0)] * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS)


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with about SLICE characters together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > SLICE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def known_by_slice(texts: list[str], known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of the distinct buckets of each text that ``known`` (bool by bucket) has, some texts at a time.

    Texts are lower-cased and framed by spaces; no n-gram spans two texts.
    """
    for first, part in groups(texts):
        framed = [f" {t.lower()} " for t in part]
        codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in framed])
        pairs = []
        for n in ORDERS:
            h = buckets(codes, n)
            at = np.flatnonzero(known[h])
            text = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[text]
            pairs.append(((text[inside] + first) << BITS) | h[at[inside]].astype(np.int64))
        pairs = np.unique(np.concatenate(pairs))
        yield pairs >> BITS, pairs & ((1 << BITS) - 1)


def known_buckets(texts: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All that ``known_by_slice`` gives; ``known`` must be few enough."""
    found = [*known_by_slice(texts, known), (np.empty(0, np.int64),) * 2]
    return np.concatenate([t for t, _ in found]), np.concatenate([b for _, b in found])


@dataclass
class Model:
    """Score of a text: logistic of ``bias`` plus the weights of its distinct known buckets."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        text, bucket = known_buckets(texts, self.weights != 0)
        z = self.bias + np.bincount(text, self.weights[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train_rows(work: Work, docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """Sampled (text, toxic) rows outside the held-out quarter, and how many such rows each class has.

    The sample is that of the smallest hashes of doc_id, ``sample`` of each class, so reruns agree. An id
    with labels that differ is toxic; null labels and null ids are left out. Of an id with several texts one is
    taken, that of the smallest hash, so that the sample has 2 * ``sample`` rows at most.
    """
    rows = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = work.save(rows.filter(~held_out(F.col("doc_id"))), "labels")
    counts = {int(r[0]): r[1] for r in rows.groupBy("toxic").count().collect() if r[0] in (0, 1)}
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = [rows.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # 2 * sample rows at most
    found = docs.filter("text is not null").join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"), F.first("toxic").alias("toxic"))
    return work.save(found.select("x.text", F.col("toxic").cast("int").alias("toxic")), "sample"), counts


def held_out(doc_id: Column) -> Column:
    """Remainder 2 of crc32 of the id as text, modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(work: Work, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fits the model: counts by bucket and class on the executors, the weights by numpy. Its tables are deleted.

    Without labels of both classes the score is 0 or 1, as the labels are (0 with no labels).
    """
    work = work.part()
    model = fitted(work, docs, labels, sample, features)
    work.drop(*work.made)
    return model


def fitted(work: Work, docs: DataFrame, labels: DataFrame, sample: int, features: int) -> Model:
    rows, counts = train_rows(work, docs, labels, sample)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    weights = np.zeros(1 << BITS, np.float32)
    if not counts.get(0) or not counts.get(1):
        return Model(weights, -50.0 if not prior else 50.0)
    n = dict.fromkeys((0, 1), 1) | {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everything = np.ones(1 << BITS, bool)
        for b in batches:
            for toxic, part in b.groupby("toxic"):
                n = np.zeros(1 << BITS, np.int64)
                for _, bucket in known_by_slice(part.text.tolist(), everything):
                    n += np.bincount(bucket, minlength=1 << BITS)
                seen_here = np.flatnonzero(n)
                yield pd.DataFrame({"bucket": seen_here, "toxic": toxic, "n": n[seen_here]})

    seen = rows.mapInPandas(presence, "bucket long, toxic int, n long")
    seen = seen.groupBy("bucket").agg(
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("neg")
    )
    seen = work.save(seen, "seen")
    all_pos, all_neg = (float(x or 0) + 1 for x in seen.agg(F.sum("pos"), F.sum("neg")).first())
    n_pos, n_neg = n[1], n[0]
    ratio = F.log((F.col("pos") + 1) / all_pos) - F.log((F.col("neg") + 1) / all_neg)
    p, q = F.col("pos") / n_pos, F.col("neg") / n_neg
    telling = F.pow(p - q, 2) / (p / n_pos + q / n_neg + 1e-9)
    best = seen.filter((F.col("pos") + F.col("neg") >= 3) & (telling >= MIN_TELLING)).select("bucket", ratio.alias("r"), telling.alias("x")).orderBy(F.desc("x"), "bucket").limit(features).toPandas()
    if best.empty:
        return Model(weights, float(np.log(prior / (1 - prior))))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[best.bucket] = np.arange(len(best))

    def selected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, bucket = known_buckets(b.text.tolist(), slot >= 0)
            cut = np.searchsorted(text, np.arange(len(b) + 1))
            cols = slot[bucket].astype("<u2" if features <= 1 << 16 else "<u4")
            yield pd.DataFrame({"toxic": b.toxic, "cols": [cols[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]})

    data = rows.mapInPandas(selected, "toxic int, cols binary").toPandas()  # 2 * sample rows, their selected buckets
    data = data.sort_values(["toxic", "cols"], kind="stable")
    cols = [np.frombuffer(x, "<u2" if features <= 1 << 16 else "<u4") for x in data.cols]
    w, bias = logistic(cols, data.toxic.to_numpy(float), best.r.to_numpy(), prior)
    weights[best.bucket] = w
    return Model(weights, bias)


def logistic(cols: list[np.ndarray], y: np.ndarray, scale: np.ndarray, prior: float, steps: int = 150, l2: float = 1e-4):
    """Weights (already times ``scale``) and bias of a logistic regression on binary features, by Adam.

    Rows weigh so that the classes have the shares of ``prior``.
    """
    row, col = np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols]), np.concatenate(cols)
    share = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    w, b = np.zeros(len(scale)), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    x = scale[col] / np.sqrt(np.mean(scale**2))
    for t in range(1, steps + 1):
        z = b + np.bincount(row, x * w[col], len(y))
        g = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        gw, gb = np.bincount(col, x * g[row], len(w)) + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= 0.03 * fix * m / (np.sqrt(v) + 1e-8)
        b -= 0.03 * fix * mb / (np.sqrt(vb) + 1e-8)
    return w * scale / np.sqrt(np.mean(scale**2)), float(b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, repeated ones too; a null text counts as empty. Runs after its return."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "score": shared.value.score(b.text.fillna("").tolist())})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, score double")


def flag(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, in its columns, whose score is below ``threshold``; other columns pass through untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text.fillna("").tolist()))

    return docs.filter(score(F.col("text")) < threshold)


def op8_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, from labels outside the held-out quarter.

    A row each, whatever repeats; a null text scores as an empty one, a null id is not held out.
    """
    work, (docs, labels) = Work(spark), (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit(work, docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    out = work.save(scored(docs, model), "scores", last=True)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
