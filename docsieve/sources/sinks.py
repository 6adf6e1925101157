"""Prediction files, per-split prediction tables and the run index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.functions.documents import class_name, confidence_text, outcome, parse_run_stamp, run_stamp

# Header words of the prediction files.
ID, TRUE_CLASS, PRED_CLASS, CONFIDENCE, ABS_VALUE = "ID", "True Class", "Pred Class", "Confidence", "Abs Value"
TEXT_COLUMNS = {
    "factors": "Exp Factors", "title": "Title", "description": "Description", "document": "Processed Doc",
}


def prediction_columns(has_class: bool, has_confidence: bool, long: bool = False) -> list[Column]:
    """Output columns of a prediction file for records with id, prediction, class_name and so on."""
    columns = [F.col("id").alias(ID)]
    if has_class:
        columns.append(F.col("class_name").alias(TRUE_CLASS))
    columns.append(class_name(F.col("prediction")).alias(PRED_CLASS))
    if has_confidence:
        columns.append(confidence_text(F.col("confidence")).alias(CONFIDENCE))
        columns.append(confidence_text(F.abs("confidence")).alias(ABS_VALUE))
    if long:
        columns.extend(F.col(source).alias(name) for source, name in TEXT_COLUMNS.items())
    return columns


def prediction_rows(scored: DataFrame, *, long: bool = False) -> DataFrame:
    """The rows of a prediction file; class and confidence columns appear where the input has them."""
    return scored.select(*prediction_columns("class_name" in scored.columns, "confidence" in scored.columns, long))


def write_predictions(scored: DataFrame, path: str, *, long: bool = False) -> None:
    prediction_rows(scored, long=long).write.mode("overwrite").options(
        sep="\t", header=True, quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def tagged_rows(scored: DataFrame) -> DataFrame:
    """Split, ID, classes, outcome tag and confidence of labelled predictions."""
    tag = outcome(F.col("label"), F.col("prediction"))
    return scored.select(
        "split", F.col("id"), F.col("label"), F.col("prediction"), tag.alias("tag"),
        confidence_text(F.col("confidence")).alias("confidence_text"),
        confidence_text(F.abs("confidence")).alias("abs_text"),
    )


def write_split_predictions(scored: DataFrame, path: str) -> None:
    """Tagged predictions, one folder per split."""
    tagged_rows(scored).write.mode("overwrite").partitionBy("split").parquet(path)


RUN_SCHEMA = (
    "ts timestamp, label string, precision double, recall double, f4 double, f1 double, script string, "
    "split_seed long, classifier_seed long, params map<string,string>"
)


def record_run(spark: SparkSession, path: str, run_id: str, row: dict[str, object]) -> None:
    """Put one run into the index table; ``f1`` may be missing.

    A run has a folder of its own, named by its id and put in place when the write is committed, so writing a run again
    replaces it, and runs that end at the same time do not meet.
    """
    if not run_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"a run id has letters, digits, - and _ only: {run_id!r}")
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def append_run(spark: SparkSession, path: str, row: dict[str, object]) -> None:
    """Put one run into the index table under a new id."""
    record_run(spark, path, uuid.uuid4().hex, row)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the index with their ``run_id``."""
    return spark.read.schema(f"{RUN_SCHEMA}, run_id string").parquet(path)


def parse_run_lines(lines: DataFrame) -> DataFrame:
    """Run rows from index text; rows of the older layout have no F1."""
    parts = F.split("value", "\t")
    has_f1 = F.size(parts) == 7

    def number(i: int) -> Column:
        return F.get(parts, F.lit(i)).cast("double")

    return lines.select(
        parse_run_stamp(F.get(parts, F.lit(0))).alias("ts"),
        F.get(parts, F.lit(1)).alias("label"),
        number(2).alias("precision"),
        number(3).alias("recall"),
        number(4).alias("f4"),
        F.when(has_f1, F.try_to_number(F.get(parts, F.lit(5)), F.lit("9.99")).cast("double")).alias("f1"),
        F.element_at(parts, -1).alias("script"),
    )


def run_lines(runs: DataFrame) -> DataFrame:
    """Run rows as index text lines."""

    def two(name: str) -> Column:
        return F.format_string("%4.2f", name)

    line = F.concat_ws(
        "\t", run_stamp(F.col("ts")), "label", two("precision"), two("recall"), two("f4"),
        F.when(F.col("f1").isNotNull(), two("f1")), "script",
    )
    return runs.select(line.alias("value"))


def best_runs(runs: DataFrame, group: str, scores: list[str], tie: str) -> DataFrame:
    """The best run of each group by the scores in turn, then by the smallest ``tie``."""
    order = Window.partitionBy(group).orderBy(*[F.desc(s) for s in scores], tie)
    return runs.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
