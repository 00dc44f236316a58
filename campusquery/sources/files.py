"""Documents in folders: plan files, texts that may need to be read from pictures, and the sizes of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusquery.functions.dates import iso_time
from campusquery.functions.text import blank

from .tables import read_json

COURSE = "modulo string, materia string, nombre_elemento string, creditos_ects string, caracter string, curso string, cuatrimestre string"
PLAN = (
    "codigo_estudio string, universidad_codigo string, universidad_nombre string, tipo string, titulo string, nivel_academico string, estado string, precio_credito_ects double, "
    "precio_credito_2 double, precio_credito_3 double, precio_credito_4 double, precio_estimado_anual double, fuente_precio string, boe_url string, boe_fecha string, origen_fuente string, "
    f"pdf_sha256 string, plan_estudios struct<resumen_creditos:map<string,string>,elementos_curriculares:array<struct<{COURSE.replace(' string', ':string')}>>>"
)


def plan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Plan documents of a folder, with the name of each one's ``file``; one that can't be read is left out, as an empty default is."""
    return read_json(spark, f"{folder}/*.json", PLAN).drop("pos")


def degree_lists(text: DataFrame) -> DataFrame:
    """(codigo, pos, and the fields of a degree) of a catalogue keyed by university, whose text is in ``value``."""
    degree = "codigo_estudio string, titulo string, nivel_academico string, estado string"
    kind = f"map<string,struct<titulaciones_vigentes:array<struct<{degree.replace(' string', ':string')}>>>>"
    rows = text.select(F.explode(F.from_json("value", kind)).alias("codigo", "u"))
    return rows.select("codigo", F.posexplode("u.titulaciones_vigentes").alias("pos", "d")).select("codigo", "pos", "d.*")


STATE = "universities_downloaded boolean, processed_universities array<string>, processed_degrees map<string,string>, non_study_plan_pdfs array<string>, failed_pdf_downloads map<string,string>"
ERROR = "timestamp string, fase string, id_entidad string, url string, motivo_fallo string, detalles_excepcion string"


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The crawler's state; no row where the document can't be read."""
    return read_json(spark, path, STATE).drop("file", "pos")


def error_log(spark: SparkSession, path: str) -> DataFrame:
    """The crawler's errors (a list of objects) with ``pos``, their times read; none where the document can't be read."""
    return read_json(spark, path, ERROR).drop("file").withColumn("timestamp", iso_time(F.col("timestamp")))


def needs_reading(text: Column) -> Column:
    """Does a document's text layer hold so little that its pictures would have to be read."""
    return F.length(F.trim(blank(text))) < 50


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """(files, bytes, mb, gb) of all files below a folder that hold something; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("length")
    total = F.coalesce(F.sum("length"), F.lit(0))
    return files.agg(F.count("*").alias("files"), total.alias("bytes"), F.round(total / 2**20, 2).alias("mb"), F.round(total / 2**30, 3).alias("gb"))
