"""Columns and table helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The blanks that end a word, as a pattern and as a set of characters.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are far longer than the rows that Spark's default Arrow batch of 10,000 is meant for: 1,000 at a time.

    A number that the caller has set stays.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "1000")


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and every column of the row in one struct ``document``.

    Operators add their own columns beside the struct, so extra columns of the input cannot clash with them.
    """
    return df.select(*columns, F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("document"))


def filled(text: str | Column) -> Column:
    """The text; empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Texts of one byte a character take the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """Lower-case words between blanks; an empty array for a blank or null text."""
    return F.array_remove(F.split(ascii_lower(filled(text)), BLANKS), "")


def python_words(text: str | None) -> list[bytes]:
    """The same words inside a task: ``bytes`` methods treat exactly the ASCII letters and blanks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def share(df: DataFrame, rows: int) -> int:
    """How many parts of about ``rows`` rows ``df`` makes; one at least."""
    return max(1, -(-df.count() // rows))
