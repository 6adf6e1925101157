"""One query per corpus operator, over its whole table, and its SQL counterpart where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import oracles
from docsieve.llm.alignment import alignment
from docsieve.llm.conversations import damaged, repair_report
from docsieve.llm.decontaminate import contaminated
from docsieve.llm.html_text import main_text
from docsieve.llm.licenses import license_scan
from docsieve.llm.line_dedup import line_dedup
from docsieve.llm.lm_score import lm_scores
from docsieve.llm.pieces import encode_texts, load_model
from docsieve.llm.quality import quality
from docsieve.llm.simhash import simhash
from docsieve.llm.suffix_dedup import suffix_dedup
from docsieve.llm.text import small_batches, table
from docsieve.llm.topk import top_k
from docsieve.llm.url_filter import url_filter

# Where the public tokenizer files are; an environment variable names another folder.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def op1_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return lm_scores(table(spark, folder, "documents"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return simhash(table(spark, folder, "documents"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    scored = quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "text_score", "site_score", "quality", "keep")


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return suffix_dedup(table(spark, folder, "documents")).drop("kept")


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents")).select("doc_id", "sentence_ids", "licenses", "unmatched")


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return encode_texts(table(spark, folder, "documents"), load_model(f"{TOKENIZERS}/{PIECE_MODEL}"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return alignment(table(spark, folder, "documents"), f"{TOKENIZERS}/{BYTE_MODEL}", f"{TOKENIZERS}/{PIECE_MODEL}")


def op12_html_text(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return main_text(table(spark, folder, "pages"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    turns = table(spark, folder, "conversations")
    return repair_report(damaged(turns), turns)


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_score, op2_simhash, op3_line_dedup, op4_top_k, op5_quality, op6_suffix_dedup, op7_decontaminate, op8_url_filter,
        op9_license_scan, op10_sentencepiece, op11_alignment, op12_html_text, op13_conversation_repair,
    )
}
SQL = {
    "op3_line_dedup": oracles.LINE_DEDUP, "op4_top_k": oracles.TOP_K, "op7_decontaminate": oracles.DECONTAMINATE,
    "op9_license_scan": oracles.LICENSE_SCAN, "op13_conversation_repair": oracles.CONVERSATION_REPAIR,
}
