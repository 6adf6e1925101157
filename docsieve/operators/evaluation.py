"""Confusion counts, metrics, error lists and confidence profiles of labelled predictions.

All work on rows with ``label`` and ``prediction`` as 0/1; ``by`` adds grouping columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.config import CLASS_NAMES
from docsieve.functions.documents import class_name, outcome


def _ratio(part: Column, whole: Column) -> Column:
    """A share, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    square = float(beta) * float(beta)
    return _ratio(F.lit(1.0 + square) * precision * recall, F.lit(square) * precision + recall)


def confusion_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group with tp, fp, tn, fn; rows without a prediction are not counted."""
    label, pred = F.col("label"), F.col("prediction")
    return df.groupBy(*by).agg(
        F.count_if((label == 1) & (pred == 1)).alias("tp"),
        F.count_if((label == 0) & (pred == 1)).alias("fp"),
        F.count_if((label == 0) & (pred == 0)).alias("tn"),
        F.count_if((label == 1) & (pred == 0)).alias("fn"),
    )


def metrics(counts: DataFrame, betas: Sequence[float] = (1, 2, 3, 4)) -> DataFrame:
    """Append precision, recall, accuracy, true-negative rate and F-beta to confusion counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    scored = counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
            "tn_rate": _ratio(tn, tn + fp),
        }
    )
    return scored.withColumns({f"f{b:g}": fbeta(F.col("precision"), F.col("recall"), b) for b in betas})


def confusion_matrix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows: true class, yes before no; columns: predicted class. Empty cells are 0."""
    named = df.select(*by, class_name(F.col("label")).alias("true_class"), class_name(F.col("prediction")).alias("p"))
    counts = named.groupBy(*by, "true_class").agg(
        F.count_if(F.col("p") == "yes").alias("pred_yes"), F.count_if(F.col("p") == "no").alias("pred_no")
    )
    return counts.orderBy(*by, F.desc("true_class"))


def classification_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class and their support-weighted average."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def side(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        precision, recall = _ratio(hit, hit + wrong), _ratio(hit, hit + missed)
        return F.struct(
            F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"),
            fbeta(precision, recall, 1).alias("f1"), (hit + missed).alias("support"),
        )

    both = confusion_counts(df, by).select(
        *by, side(CLASS_NAMES[1], tp, fp, fn).alias("yes"), side(CLASS_NAMES[0], tn, fn, fp).alias("no")
    )
    yes, no = F.col("yes"), F.col("no")
    support = yes["support"] + no["support"]

    def weighted(name: str) -> Column:
        return _ratio(yes[name] * yes["support"] + no[name] * no["support"], support).alias(name)

    average = F.struct(
        F.lit("avg / total").alias("name"), weighted("precision"), weighted("recall"), weighted("f1"),
        support.alias("support"),
    )
    return both.select(*by, F.inline(F.array(yes, no, average)))


def fbeta_table(df: DataFrame, betas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per beta with precision, recall and the F score."""
    scored = metrics(confusion_counts(df, by), ())
    table = scored.select(*by, "precision", "recall", F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta"))
    square = F.col("beta") * F.col("beta")
    score = _ratio((1.0 + square) * F.col("precision") * F.col("recall"), square * F.col("precision") + F.col("recall"))
    return table.withColumn("f_score", score)


def tagged(df: DataFrame) -> DataFrame:
    return df.withColumn("tag", outcome(F.col("label"), F.col("prediction")))


def error_lists(df: DataFrame, key: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` false positives and negatives, least certain first, with the totals.

    Each task passes on at most ``k`` rows per list.
    """
    errors = tagged(df).filter(F.col("tag").isin("FP", "FN"))
    group = [*by, "tag"]
    order = Window.partitionBy(*group).orderBy("abs_confidence", key)
    first = errors.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    totals = errors.groupBy(*group).agg(F.count("*").alias("n_total"))
    # At most one total per list, so this side is a handful of rows.
    return first.join(F.broadcast(totals), group).select(*group, "position", key, "abs_confidence", "n_total")


def least_certain(df: DataFrame, key: str) -> DataFrame:
    """Predictions from the least to the most certain."""
    return tagged(df).orderBy("abs_confidence", key)


def confidence_histogram(df: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """Rows per outcome and range of absolute confidence; the outer ranges are open."""
    rows = tagged(df).withColumn("bucket", F.width_bucket("abs_confidence", F.lit(low), F.lit(high), F.lit(n)))
    return rows.groupBy("tag", "bucket").agg(F.count("*").alias("n_rows"))
