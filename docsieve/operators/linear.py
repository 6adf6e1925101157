"""Linear models as data: weights, scores, feature lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coefficient_table(coefficients: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, weight) from (idx, weight) and the vocabulary."""
    return coefficients.join(vocabulary.select("idx", "term"), "idx").select("term", "weight")


def weight_vector(weights: DataFrame) -> DataFrame:
    """One row with all weights in term order: what a linear model holds, one number per kept term."""
    ordered = F.sort_array(F.collect_list(F.struct("term", "weight")))
    return weights.agg(ordered.alias("_w")).select(F.col("_w.weight").alias("weights"))


def by_position(vectors: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """(idx, term, weight) of a weight array and the vocabulary (idx, term): positions are the join key.

    Positions outside of the vocabulary have no term and are left out, as are terms beyond the array.
    """
    placed = vectors.select(F.posexplode(column).alias("idx", "weight")).withColumn("idx", F.col("idx").cast("long"))
    return placed.join(vocabulary.select("idx", "term"), "idx").select("idx", "term", "weight")


def linear_score(values: DataFrame, weights: DataFrame, intercept: float, key: str) -> DataFrame:
    """(key, confidence, prediction) of the documents in (key, term, value)."""
    summed = values.join(weights, "term", "left").groupBy(key).agg(
        F.coalesce(F.sum(F.col("value") * F.col("weight")), F.lit(0.0)).alias("s")
    )
    margin = F.col("s") + F.lit(intercept)
    return summed.select(key, margin.alias("confidence"), (margin > 0).cast("int").alias("prediction"))


def top_features(weights: DataFrame, n: int) -> DataFrame:
    """The ``n`` strongest terms of each sign and the ``n`` nearest zero, with their rank.

    Strength is compared to nine places so that equal weights tie and order by term.
    """
    w = F.round("weight", 9)
    kinds = F.array_compact(
        F.array(F.when(w > 0, F.lit("positive")), F.when(w < 0, F.lit("negative")), F.lit("near_zero"))
    )
    by_kind = weights.select("term", w.alias("weight"), F.explode(kinds).alias("kind"))
    strength = F.when(F.col("kind") == "near_zero", F.abs("weight")).otherwise(-F.abs("weight"))
    order = Window.partitionBy("kind").orderBy(strength, "term")
    ranked = by_kind.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("kind", "rank", "term", F.round("weight", 6).alias("weight"))


def signed_text(weights: DataFrame, column: str = "weight") -> DataFrame:
    """Weight lines as they are printed in reports: sign, four places, tab, term."""
    return weights.select(F.concat_ws("\t", F.format_string("%+.4f", F.col(column)), "term").alias("line"))


def list_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists (kind, term, rank) side by side; a missing rank means not in that list."""
    return first.select("kind", "term", F.col("rank").alias("rank_a")).join(
        second.select("kind", "term", F.col("rank").alias("rank_b")), ["kind", "term"], "full_outer"
    )
