"""Reproducible splits, folds and balanced samples; every draw is a function of seed and key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.operators.ranking import hash_key, hash_rank, hash_threshold, within_threshold

TRAIN, TEST = "train", "test"


def split_exact(
    df: DataFrame, key: str, fraction: float, seed: int, output: str = "split", ids: DataFrame | None = None
) -> DataFrame:
    """Append train/test with exactly ceil(fraction * n) test rows, drawn in hash order.

    Each row compares its own hash with one threshold, so no row moves. ``ids`` are the same rows
    in a plainer form, for callers that add several splits to one table.
    """
    wanted = F.ceil(F.lit(float(fraction)) * F.col("n_all"))
    threshold = hash_threshold((df if ids is None else ids).select(key), key, seed, wanted)
    return df.withColumn(output, F.when(within_threshold(key, seed, threshold), TEST).otherwise(TRAIN))


def split_approximate(df: DataFrame, key: str, fraction: float, seed: int, output: str = "split") -> DataFrame:
    """Append train/test by each row's hash alone: one pass, the test share only near ``fraction``."""
    share = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    return df.withColumn(output, F.when(share < fraction, TEST).otherwise(TRAIN))


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int, output: str = "fold") -> DataFrame:
    """Append a fold number 0..k-1; each class is dealt out in turn."""
    ranked = hash_rank(df, key, seed, [label], "_rank")
    return ranked.withColumn(output, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def choose_negatives(df: DataFrame, key: str, label: str, seed: int, output: str = "chosen") -> DataFrame:
    """Append a flag: all positives, and as many negatives as there are positives, in hash order."""
    negatives = df.filter(F.col(label) == 0).select(key)
    n_positive = df.agg(F.count_if(F.col(label) == 1)).scalar()
    threshold = hash_threshold(negatives, key, seed, n_positive)
    # With fewer negatives than wanted the threshold falls outside them and all are taken.
    n_negative = df.agg(F.count_if(F.col(label) == 0)).scalar()
    chosen = (F.col(label) == 1) | (n_negative <= n_positive) | within_threshold(key, seed, threshold)
    return df.withColumn(output, chosen)


def balanced_sample(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """All positives and an equal number of negatives."""
    return choose_negatives(df, key, label, seed, "_chosen").filter("_chosen").drop("_chosen")


def leftovers(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """The negatives a balanced sample of the same seed leaves out."""
    return choose_negatives(df, key, label, seed, "_chosen").filter("NOT _chosen").drop("_chosen")


def random_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, when there are fewer) in hash order."""
    wanted = F.least(F.lit(n).cast("long"), F.col("n_all"))
    return df.filter(within_threshold(key, seed, hash_threshold(df.select(key), key, seed, wanted)))


def repeated_splits(df: DataFrame, key: str, fraction: float, seeds: Iterable[int]) -> DataFrame:
    """One copy of the keyed rows per seed, each with its own split."""
    parts = [split_exact(df, key, fraction, s).withColumn("seed", F.lit(s)) for s in seeds]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def split_report(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Row, yes and no counts and the truncated percentage of yes, for all rows and per split."""
    counted = df.groupBy(split).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_yes"))
    both = counted.select(F.explode(F.array(F.lit("all"), F.col(split))).alias("part"), "n", "n_yes")
    totals = both.groupBy("part").agg(F.sum("n").alias("n_rows"), F.sum("n_yes").alias("n_yes"))
    return totals.select(
        "part", "n_rows", "n_yes", (F.col("n_rows") - F.col("n_yes")).alias("n_no"),
        F.floor(F.lit(100) * F.col("n_yes") / F.col("n_rows")).cast("long").alias("percent_yes"),
    )
