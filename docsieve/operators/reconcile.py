"""Earlier evaluated predictions against new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.operators.evaluation import confusion_counts, metrics

MISSING = "none"


def merge_evaluations(parts: Sequence[DataFrame], key: str, tie: str) -> DataFrame:
    """Union of evaluation sets; for an ID in several, the last set given wins, then the highest ``tie``."""
    ranked = [p.withColumn("_priority", F.lit(i)) for i, p in enumerate(parts)]
    union = ranked[0]
    for part in ranked[1:]:
        union = union.unionByName(part)
    # Every ID keeps one row, so a combined aggregate does it without sorting an ID's rows.
    columns = [c for c in union.columns if c not in (key, "_priority")]
    best = F.max_by(F.struct(*columns), F.struct("_priority", tie)).alias("best")
    return union.groupBy(key).agg(best).select(key, "best.*")


def reconcile(evaluations: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Evaluations (key, evaluated, old_pred, ...) and predictions (key, new_pred, ...) in one report.

    ``origin`` tells whether the ID is in both, only evaluated or only predicted. Strings of the
    absent side read 'none' (factors read empty); a NULL of a side that is there stays NULL.
    """
    old = evaluations.withColumn("_old", F.lit(True))
    new = predictions.withColumn("_new", F.lit(True))
    joined = old.join(new, key, "full_outer")
    origin = F.when(F.col("_old").isNull(), "new only").when(F.col("_new").isNull(), "old only").otherwise("both")
    kinds, filled = dict(joined.dtypes), {}
    for side, flag in ((evaluations, "_old"), (predictions, "_new")):
        for c in side.columns:
            if c != key and kinds[c] == "string":
                absent = F.lit("" if c == "factors" else MISSING)
                filled[c] = F.when(F.col(flag).isNull(), absent).otherwise(F.col(c))
    return joined.withColumns({**filled, "origin": origin}).drop("_old", "_new")


def reconcile_metrics(report: DataFrame) -> DataFrame:
    """Confusion counts, precision and recall of the old and the new predictions."""
    sides = F.array(
        F.struct(F.lit("old").alias("side"), F.col("old_pred").alias("pred")),
        F.struct(F.lit("new").alias("side"), F.col("new_pred").alias("pred")),
    )
    rows = report.select("evaluated", F.inline(sides)).select(
        "side",
        F.when(F.col("evaluated") == "yes", 1).when(F.col("evaluated") == "no", 0).alias("label"),
        F.when(F.col("pred") == "yes", 1).when(F.col("pred") == "no", 0).alias("prediction"),
    )
    return metrics(confusion_counts(rows, ["side"]), ()).select("side", "tp", "fp", "tn", "fn", "precision", "recall")
