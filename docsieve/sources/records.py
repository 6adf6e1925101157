"""Tab-separated record, prediction and evaluation files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.config import CLASS_NAMES
from docsieve.functions.documents import class_name
from docsieve.functions.text import strip_field

# The two record layouts, told apart by their number of fields.
LABELLED = ("id", "class_name", "factors", "title", "description")
UNLABELLED = ("id", "factors", "title", "description")
# The evaluation file layout.
EVALUATION = ("id", "other_id", "exp_type", "state", "study_type", "curation_state", "variables")


def _strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """All-string TSV by position; a bare double quote is an ordinary character."""
    return (
        spark.read.schema(_strings(columns))
        .options(sep="\t", header=header, quote="", escape="", enforceSchema=True)
        .csv(path)
        .fillna("")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines, for files that mix layouts."""
    return spark.read.text(path)


def decode_bytes(content: Column) -> Column:
    """UTF-8 text of a binary column; invalid bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def without_header(lines: DataFrame, first_field: str) -> DataFrame:
    """Drop header lines, told by their first field."""
    return lines.filter(~F.col("value").startswith(first_field + "\t"))


def parse_records(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Fields by layout: five with a class, four without; other counts are marked with a reason.

    Every field is stripped, the class is lower-cased, and a line of another length keeps
    its text in ``raw`` with the fields NULL.
    """
    fields = F.transform(F.split(F.col(value), "\t", -1), strip_field)
    parsed = lines.select(*keep, F.col(value).alias("raw"), fields.alias("_f"), F.size(fields).alias("n_fields"))
    five, four = F.col("n_fields") == 5, F.col("n_fields") == 4

    def pick(with_class: int, without: int | None = None) -> Column:
        column = F.when(five, F.get("_f", F.lit(with_class)))
        return column if without is None else column.when(four, F.get("_f", F.lit(without)))

    return parsed.select(
        pick(0, 0).alias("id"),
        F.lower(pick(1)).alias("class_name"),
        pick(2, 1).alias("factors"),
        pick(3, 2).alias("title"),
        pick(4, 3).alias("description"),
        *keep,
        "n_fields",
        F.when(~(five | four), F.concat(F.lit("field count "), F.col("n_fields"))).alias("quarantine_reason"),
        "raw",
    )


def require_known_class(records: DataFrame) -> DataFrame:
    """Mark records the training job cannot use: no class, or one outside the known names."""
    unknown = F.col("class_name").isNull() | ~F.col("class_name").isin(*CLASS_NAMES)
    reason = F.when(unknown, F.lit("no known class"))
    return records.withColumn("quarantine_reason", F.coalesce("quarantine_reason", reason))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction file with a class index in its second column; the class gets its name."""
    raw = read_tsv(spark, path, ("id", "class_index", "confidence", "abs_value", "factors", "title"))
    return raw.withColumn("pred_class", class_name(F.col("class_index")))


def read_evaluations(spark: SparkSession, path: str, predicted: str) -> DataFrame:
    """Evaluated earlier predictions from one file, all of which shared one predicted class."""
    raw = read_tsv(spark, path, EVALUATION)
    return raw.select("id", "exp_type", F.lower("state").alias("evaluated"), F.lit(predicted).alias("old_pred"))
