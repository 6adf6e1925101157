"""The corpus pipeline: documents through five operators, each stage written and read again as the next one's input.

All stages keep every column of their input and may get any extra ones, empty tables, rows that repeat and null ids. A null
or empty text counts as a text without words: the classifier judges it by its site, line dedup leaves it as it is, SimHash
gives it fingerprint zero (one of all such documents stays), it holds no benchmark item, and it encodes to no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.decontaminate import decontaminate
from docsieve.llm.line_dedup import line_dedup
from docsieve.llm.pieces import encode_texts, load_model
from docsieve.llm.quality import keep_good
from docsieve.llm.queries import PIECE_MODEL, TOKENIZERS
from docsieve.llm.simhash import keep_first
from docsieve.llm.text import small_batches, table
from docsieve.session import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; rows with equal id and text are judged alike."""
    small_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that others repeat; ``n_chars``, where there is one, follows the text."""
    done = line_dedup(docs)
    # A null text stays null: it has no line to lose.
    text = F.when(F.col("document.text").isNotNull(), F.col("kept"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return done.select(*[changed.get(c, F.col(f"document.`{c}`")).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id, null ids last.

    Shingle length (3 words) and bit distance (2) are those of the SimHash contract.
    """
    small_batches(spark)
    return keep_first(docs, distance=2, width=3)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    small_batches(spark)
    return encode_texts(docs, load_model(f"{TOKENIZERS}/{PIECE_MODEL}"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", encode_stage),
]

# The classifier is fitted and the pieces are searched for, so SQL cannot state the result; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is in the shared folder before the next reads it."""
    docs, place = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{place}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
