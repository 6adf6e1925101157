"""Linear models by full-batch gradient steps of a fixed size, stated as joins and aggregates.

Minimises ``|w|^2 / 2 + C * sum(weight * loss(y * (w . x + b)))`` over rows of long features (key, term, value). A step is a
join of the features with the weights, a sum by document, a slope by document and a sum by term. Any number of models that
differ in cost, loss or row weights (and so in class balance or fold) are columns of the same step.

Features and rows are dealt out by key once and kept, so sums by document and the way back to the features need no
exchange; the gradient combines inside each task and leaves it as one row a term. Weights are written after each step: a lost
executor repeats one step, and their known size lets the optimiser broadcast them while they are small. The intercept is
the weight of a feature that every row has, not penalised. Features that a model has no use for (terms outside of its
training rows) keep the weight zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from docsieve.session import materialize

# Slope of each loss in the margin z, and a bound on how fast the slope changes.
SLOPES: dict[str, Callable[[Column], Column]] = {
    "hinge": lambda z: F.when(z < 1, -1.0).otherwise(0.0),
    "squared_hinge": lambda z: F.when(z < 1, -2.0 * (1.0 - z)).otherwise(0.0),
    "log": lambda z: -1.0 / (1.0 + F.exp(z)),
    "modified_huber": lambda z: F.when(z >= 1, 0.0).when(z >= -1, -2.0 * (1.0 - z)).otherwise(-4.0),
}
CURVATURE = {"hinge": 1.0, "squared_hinge": 2.0, "log": 0.25, "modified_huber": 2.0}
INTERCEPT = "(intercept)"


@dataclass(frozen=True)
class Spec:
    """One model: its loss, its cost, the column of row weights (NULL or 0 leaves a row out), and its step size.

    Without a step size it is one over the greatest curvature that the rows allow; hinge loss has none, and takes the same.
    """

    name: str
    loss: str = "log"
    C: float = 1.0
    weight: str | None = None
    step: float | None = None

    def __post_init__(self) -> None:
        if self.loss not in SLOPES:
            raise ValueError(f"unknown loss {self.loss!r}")


def _weight(spec: Spec) -> Column:
    return F.lit(1.0) if spec.weight is None else F.coalesce(F.col(spec.weight).cast("double"), F.lit(0.0))


def _steps(values: DataFrame, rows: DataFrame, key: str, specs: Sequence[Spec]) -> list[float]:
    """Step sizes: given, or 1 / (1 + C * curvature * sum of weight * |x|^2), the intercept's 1 among x."""
    if all(s.step is not None for s in specs):
        return [s.step for s in specs]
    lengths = values.groupBy(key).agg(F.sum(F.col("value") * F.col("value")).alias("square"))
    bounds = rows.join(lengths, key).agg(*[F.sum(_weight(s) * F.col("square")).alias(f"b_{i}") for i, s in enumerate(specs)]).first()
    return [s.step if s.step is not None else 1.0 / (1.0 + s.C * CURVATURE[s.loss] * (b or 0.0)) for s, b in zip(specs, bounds)]


def with_intercept(values: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The features, and for every row one more whose weight is the intercept."""
    constant = rows.select(key, F.lit(INTERCEPT).alias("term"), F.lit(1.0).alias("value"))
    return values.select(key, "term", "value").unionByName(constant)


def _sums(values: DataFrame, weights: DataFrame, key: str, n: int) -> DataFrame:
    """(key, m_0, m_1, ...): the margins of every row."""
    return values.join(weights, "term").groupBy(key).agg(*[F.sum(F.col("value") * F.col(f"w_{i}")).alias(f"m_{i}") for i in range(n)])


def fit_wide(values: DataFrame, rows: DataFrame, key: str, specs: Sequence[Spec], steps: int) -> DataFrame:
    """(term, w_0, w_1, ...) after ``steps`` steps from zero; the term ``(intercept)`` holds the intercepts.

    ``values`` has (key, term, value), ``rows`` (key, label 0 or 1, the weight columns of the specs).
    """
    every = range(len(specs))
    dealt = [df.repartition(key).persist(StorageLevel.MEMORY_AND_DISK) for df in (with_intercept(values, rows, key), rows)]
    values, rows = dealt
    try:
        sizes = _steps(values, rows, key, specs)
        zero = values.select("term").distinct().select("term", *[F.lit(0.0).alias(f"w_{i}") for i in every])
        weights, sign = materialize(zero, "descent"), 2.0 * F.col("label") - 1.0
        penalised = (F.col("term") != INTERCEPT).cast("double")
        for _ in range(steps):
            slopes = rows.join(_sums(values, weights, key, len(specs)), key).select(
                key, *[(_weight(s) * sign * SLOPES[s.loss](sign * F.col(f"m_{i}"))).alias(f"s_{i}") for i, s in enumerate(specs)]
            )
            gradient = values.join(slopes, key).groupBy("term").agg(*[F.sum(F.col("value") * F.col(f"s_{i}")).alias(f"g_{i}") for i in every])
            weights = materialize(weights.join(gradient, "term").select("term", *[
                (F.col(f"w_{i}") - F.lit(size) * (penalised * F.col(f"w_{i}") + F.lit(s.C) * F.col(f"g_{i}"))).alias(f"w_{i}")
                for i, (s, size) in enumerate(zip(specs, sizes))
            ]), "descent")
        return weights
    finally:
        for df in dealt:
            df.unpersist()


def fit(values: DataFrame, rows: DataFrame, key: str, specs: Sequence[Spec], steps: int) -> DataFrame:
    """(model, term, weight): the models of :func:`fit_wide` one below the other."""
    weights = fit_wide(values, rows, key, specs, steps)
    models = F.array(*[F.struct(F.lit(s.name).alias("model"), F.col(f"w_{i}").alias("weight")) for i, s in enumerate(specs)])
    return weights.select("term", F.inline(models)).select("model", "term", "weight")


def margins(values: DataFrame, rows: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """``rows`` with columns m_0, m_1, ...: the signed margin by each model of :func:`fit_wide`."""
    n = len(weights.columns) - 1
    return rows.join(_sums(with_intercept(values, rows, key), weights, key, n), key)
