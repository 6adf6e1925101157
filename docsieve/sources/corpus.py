"""Labelled document trees (one folder per class) and their partitioned-table form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.config import CLASS_NAMES
from docsieve.sources.records import decode_bytes

_PATH = r"/(" + "|".join(CLASS_NAMES) + r")/([^/]+)$"


def read_document_tree(spark: SparkSession, path: str) -> DataFrame:
    """(id, class_name, text) from ``<path>/<class>/<id>`` files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    location = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return files.select(
        F.regexp_extract(location, _PATH, 2).alias("id"),
        F.regexp_extract(location, _PATH, 1).alias("class_name"),
        decode_bytes(F.col("content")).alias("text"),
    ).filter(F.col("class_name") != "")


def write_corpus(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(id, class_name, text) as a table partitioned by class, not one file per document."""
    documents.select("id", "class_name", "text").write.mode(mode).partitionBy("class_name").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The table written by :func:`write_corpus`; a class filter prunes folders."""
    return spark.read.schema("id string, text string, class_name string").parquet(path)
