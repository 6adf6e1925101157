"""Split, fold and balancing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import sampling as sp
from docsieve.plans import mapping as m
from docsieve.sources.tables import read_table

# Fixed values of these queries.
FRACTION, SPLIT_SEED, FOLD_SEED, BALANCE_SEED, FOLDS = 0.2, 68, 415, 7, 5


def _rare(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with the rare class as positive."""
    return read_table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))


def split_exact(spark: SparkSession, folder: str) -> DataFrame:
    return sp.split_exact(m.documents(spark, folder).select("doc_id"), "doc_id", FRACTION, SPLIT_SEED)


def split_report(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return sp.split_report(sp.split_exact(labels, "doc_id", FRACTION, SPLIT_SEED))


def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return sp.stratified_folds(labels, "doc_id", "label", FOLDS, FOLD_SEED)


def balanced_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sp.balanced_sample(_rare(spark, folder), "doc_id", "label", BALANCE_SEED)


def leftovers(spark: SparkSession, folder: str) -> DataFrame:
    return sp.leftovers(_rare(spark, folder), "doc_id", "label", BALANCE_SEED)


QUERIES = {
    "split_exact": split_exact,
    "split_report": split_report,
    "stratified_folds": stratified_folds,
    "balanced_sample": balanced_sample,
    "leftovers": leftovers,
}


def sql_order(seed: int) -> str:
    return f"md5('{seed}|' || doc_id), doc_id"


def sql_split(table: str, seed: int, fraction: float = FRACTION) -> str:
    """'test' for the first ceil(fraction * n) rows of a table in hash order."""
    return (
        f"CASE WHEN row_number() OVER (ORDER BY {sql_order(seed)}) "
        f"<= ceil({fraction}::DOUBLE * (SELECT count(*) FROM {table})) THEN 'test' ELSE 'train' END"
    )


SQL_RARE = f"""
rare AS (SELECT doc_id, 1 - quality AS label FROM labels),
drawn AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_order(BALANCE_SEED)})
         <= (SELECT count(*) FROM rare WHERE label = 1) OR label = 1 AS chosen
  FROM rare)"""

SQL = {
    "split_exact": f"SELECT doc_id, {sql_split('documents', SPLIT_SEED)} AS split FROM documents",
    "split_report": f"""
        WITH s AS (SELECT quality, {sql_split('labels', SPLIT_SEED)} AS split FROM labels),
        parts AS (SELECT 'all' AS part, quality FROM s UNION ALL SELECT split, quality FROM s)
        SELECT part, count(*) AS n_rows, count(*) FILTER (quality = 1) AS n_yes, count(*) FILTER (quality = 0) AS n_no,
               CAST(floor(100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*)) AS BIGINT) AS percent_yes
        FROM parts GROUP BY part""",
    "stratified_folds": f"""
        SELECT doc_id, quality AS label,
               CAST((row_number() OVER (PARTITION BY quality ORDER BY {sql_order(FOLD_SEED)}) - 1) % {FOLDS} AS INTEGER) AS fold
        FROM labels""",
    "balanced_sample": f"WITH {SQL_RARE} SELECT doc_id, label FROM drawn WHERE chosen",
    "leftovers": f"WITH {SQL_RARE} SELECT doc_id, label FROM drawn WHERE NOT chosen",
}
