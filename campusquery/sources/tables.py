"""Tables of a directory, and the catalogue's entities over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from campusquery.functions.text import zfill

PUBLIC = ("BUILDING", "MACHINERY")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file`` and the fields of each JSON document, one a file, or of each object where a document is a list (``pos``); one that can't be read gives no row."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    kind = StructType.fromDDL(f"{schema}, _corrupt string")
    objects = F.from_json("value", ArrayType(kind), {"columnNameOfCorruptRecord": "_corrupt"})
    rows = text.select("file", F.posexplode(objects).alias("pos", "x"))
    return rows.filter(F.col("x").isNotNull() & F.col("x._corrupt").isNull()).select("file", "pos", "x.*").drop("_corrupt")


def universities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codigo, nombre, tipo, provincia, ccaa: the customers with their nation and region."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    kind = F.when(F.col("c_mktsegment").isin(*PUBLIC), "Pública").otherwise("Privada")
    return out.select(
        F.col("c_custkey").alias("u_key"), zfill(F.col("c_custkey").cast("string"), 3).alias("codigo"), F.col("c_name").alias("nombre"), kind.alias("tipo"),
        F.col("n_name").alias("provincia"), F.col("r_name").alias("ccaa"), F.col("c_acctbal").alias("saldo"),
    )


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codigo_estudio, titulo, nivel, estado, u_key, precio: the orders."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("codigo_estudio"), F.concat_ws(" ", F.lit("Grado en"), "o_orderpriority").alias("titulo"), F.col("o_orderpriority").alias("nivel"),
        F.col("o_orderstatus").alias("estado"), F.col("o_custkey").alias("u_key"), F.col("o_totalprice").alias("precio"), "o_orderdate",
    )


def courses(spark: SparkSession, sf_dir: str, names: bool = True) -> DataFrame:
    """codigo_estudio, orden, nombre, ects, caracter, cuatrimestre, curso: the lines, named by their part, or without ``names`` as they are."""
    lines = read(spark, sf_dir, "lineitem")
    if names:
        lines = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.col("l_orderkey").alias("codigo_estudio"), F.col("l_linenumber").alias("orden"), "l_partkey", "l_suppkey", "l_extendedprice", *([F.col("p_name").alias("nombre")] if names else []),
        F.col("l_quantity").alias("ects"), F.col("l_returnflag").alias("caracter"), F.col("l_linestatus").alias("cuatrimestre"), (F.col("l_linenumber") % 6 + 1).cast("string").alias("curso"),
    )


#: The same entities for the oracle.
SQL_VIEWS = """
WITH u AS (SELECT c_custkey AS u_key, CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS codigo, c_name AS nombre,
             CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Pública' ELSE 'Privada' END AS tipo, n_name AS provincia, r_name AS ccaa, c_acctbal AS saldo
           FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT o_orderkey AS codigo_estudio, 'Grado en ' || o_orderpriority AS titulo, o_orderpriority AS nivel, o_orderstatus AS estado, o_custkey AS u_key, o_totalprice AS precio, o_orderdate FROM orders),
a AS (SELECT l_orderkey AS codigo_estudio, l_linenumber AS orden, l_partkey, l_suppkey, l_extendedprice, p_name AS nombre, l_quantity AS ects, l_returnflag AS caracter, l_linestatus AS cuatrimestre, (l_linenumber % 6 + 1)::VARCHAR AS curso
      FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
