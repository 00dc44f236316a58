"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents; a lost executor costs at most the stage at work. All but the last return the
columns of documents, whatever further columns these have. A stage's frame runs after the stage has returned, so
the two that read texts in Python leave the session with smaller Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusquery.llm import mixing, neardup, packing, pii, toxicity
from campusquery.llm.common import Work, lower_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a null or empty text scores as the labels' base rate."""
    lower_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.flag(docs, toxicity.fit(Work(spark), docs.select("doc_id", "text"), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; rows without an id or without words all stay."""
    return neardup.keep_one(Work(spark), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the name of the kind in place of each span; ``n_chars``, where present, follows the text."""
    lower_batches(spark)
    out = pii.redacted(docs)
    if "n_chars" in docs.columns:
        n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, 0 to 3 times."""
    return mixing.mix(Work(spark), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences; repeated documents make pieces like others."""
    return packing.pack(Work(spark), docs, encode_special_tokens=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifiers nor the random rounding; tests hold each stage against brute force (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each one's table goes once the next one's is written."""
    work, docs = Work(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{k}_{name}", last=True)
    return docs
