"""Grid search over folds as one aggregate, for the multinomial model with its closed form.

A model is counts by class and term, so the training part of a fold is all counts less those of the fold. One aggregate by
term holds every fold, one join scores every document for all points of the grid, and the points of a document are those
of the fold it belongs to. Test rows are a further fold that no counts are taken from: their scores are those of a refit
on all training rows, so the chosen point and its test metrics come out of the same plan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators import evaluation
from docsieve.operators import features as ft
from docsieve.operators.sampling import TRAIN, split_exact, stratified_folds
from docsieve.session import materialize

SCORE_DIGITS = 9  # mean scores that differ by less are equal; the first point of the grid wins


@dataclass(frozen=True)
class Point:
    """One candidate: smoothing, document-frequency bounds, and whether both classes get one prior."""

    alpha: float = 1.0
    min_df: float | int = 1
    max_df: float | int = 1.0
    balanced: bool = False


def points(grid: Mapping[str, Sequence]) -> list[Point]:
    """All combinations of the values given for the fields of a point, the last field varying fastest."""
    return [Point(**dict(zip(grid, values))) for values in product(*grid.values())]


def fold_table(labels: DataFrame, key: str, label: str, folds: int, fraction: float, seed: int) -> DataFrame:
    """(key, label, fold): test rows get fold number ``folds``, training rows 0 to ``folds - 1`` dealt by class.

    Only keys and labels move; texts join the result once.
    """
    split = split_exact(labels.select(key, label), key, fraction, seed)
    dealt = stratified_folds(split.filter(F.col("split") == TRAIN), key, label, folds, seed)
    test = split.filter(F.col("split") != TRAIN).withColumn("fold", F.lit(folds))
    return dealt.unionByName(test).select(key, label, "fold")


def _log(value: float) -> float:
    return math.log(value) if value > 0 else -math.inf


def _sum_if(test: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, value)), F.lit(0))


@dataclass
class GridCounts:
    """What all models of a grid are made of: counts by term, and sizes by fold."""

    table: DataFrame
    sizes: list[tuple[int, int]]
    totals: dict[tuple[int, int], tuple[float, float, int]]
    bounds: list[tuple[float | int, float | int]]


def count_folds(docs: DataFrame, grid: Sequence[Point], folds: int) -> GridCounts:
    """One aggregate by term over rows (label, fold, terms); terms outside of all bounds are left out."""
    classes, every = {"no": F.col("label") == 0, "yes": F.col("label") == 1}, range(folds + 1)
    found = docs.agg(*[
        F.count_if((F.col("fold") < folds) & (F.col("fold") != f) & test).alias(f"{c}_{f}") for f in every for c, test in classes.items()
    ]).first()
    sizes = [(found[f"no_{f}"], found[f"yes_{f}"]) for f in every]
    bounds = list(dict.fromkeys((p.min_df, p.max_df) for p in grid))

    in_train = ft.term_counts(docs.filter(F.col("fold") < folds), ["label", "fold"])
    by_fold = in_train.groupBy("term").agg(
        *[F.count_if(F.col("fold") == f).alias(f"df_{f}") for f in range(folds)],
        *[_sum_if((F.col("fold") == f) & test, F.col("tf")).alias(f"{c}_{f}") for f in range(folds) for c, test in classes.items()],
    )

    def without(name: str, fold: int) -> Column:
        """The count of the training part of a fold."""
        return reduce(lambda a, b: a + b, [F.col(f"{name}_{f}") for f in range(folds) if f != fold])

    counts = by_fold.select("term", *[without(n, f).alias(f"{n}_{f}") for f in every for n in ("df", "no", "yes")])
    inside = {}
    for f, (b, (low, high)) in product(every, enumerate(bounds)):
        n = sum(sizes[f])
        inside[f, b] = (F.col(f"df_{f}") >= ft.frequency_bound(low, n)) & (F.col(f"df_{f}") <= ft.frequency_bound(high, n)) & (F.col(f"df_{f}") > 0)
    kept = counts.filter(reduce(lambda a, b: a | b, inside.values()))
    table = materialize(kept.withColumns({f"in_{f}_{b}": test for (f, b), test in inside.items()}), "grid-terms")
    sums = table.agg(*[
        column.alias(f"{name}_{f}_{b}") for f, b in inside for name, column in (
            ("no", F.sum(F.when(F.col(f"in_{f}_{b}"), F.col(f"no_{f}")))), ("yes", F.sum(F.when(F.col(f"in_{f}_{b}"), F.col(f"yes_{f}")))),
            ("terms", F.count_if(F.col(f"in_{f}_{b}"))),
        )
    ]).first()
    totals = {(f, b): (float(sums[f"no_{f}_{b}"] or 0), float(sums[f"yes_{f}_{b}"] or 0), sums[f"terms_{f}_{b}"] or 0) for f, b in inside}
    return GridCounts(table, sizes, totals, bounds)


def _log_odds(counts: GridCounts, point: Point, fold: int) -> Column:
    """The weight of a term for one point and fold, NULL where its bounds leave the term out."""
    place = fold, counts.bounds.index((point.min_df, point.max_df))
    no, yes, terms = counts.totals[place]
    share = lambda name, total: F.log((F.col(f"{name}_{fold}") + F.lit(point.alpha)) / F.lit(total + point.alpha * terms))
    return F.when(F.col(f"in_{fold}_{place[1]}"), share("yes", yes) - share("no", no))


def predict_folds(docs: DataFrame, key: str, grid: Sequence[Point], folds: int, counts: GridCounts) -> DataFrame:
    """(key, label, fold, p_0, p_1, ...): for each point the prediction of the model that has not seen the document."""
    every = range(folds + 1)
    odds = counts.table.select("term", F.array(*[F.array(*[_log_odds(counts, p, f) for p in grid]) for f in every]).alias("odds"))
    # Terms are counted in the row; the table has a known size, so the join is broadcast where it is small.
    own = ft.term_counts(docs, [key, "label", "fold"], keep_empty=True).join(odds, "term", "left").select(
        key, "label", "fold", "tf", F.get("odds", F.col("fold")).alias("own")
    )
    sums = own.groupBy(key, "label", "fold").agg(*[F.sum(F.col("tf") * F.get("own", F.lit(i))).alias(f"s_{i}") for i in range(len(grid))])
    limits = []
    for p in grid:
        prior = [0.0 if p.balanced or no == yes else _log(no) - _log(yes) for no, yes in counts.sizes]
        limits.append(F.get(F.array(*[F.lit(x) for x in prior]), F.col("fold")))
    return sums.select(key, "label", "fold", *[
        (F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) > limit).cast("int").alias(f"p_{i}") for i, limit in enumerate(limits)
    ])


def fold_metrics(predicted: DataFrame, grid: Sequence[Point], beta: float) -> DataFrame:
    """(candidate, fold, precision, recall, f1, f<beta>) of every point and fold: one aggregate by fold."""
    label = F.col("label")
    cells = {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}
    counted = predicted.groupBy("fold").agg(*[
        F.count_if((label == a) & (F.col(f"p_{i}") == b)).alias(f"{name}_{i}") for i in range(len(grid)) for name, (a, b) in cells.items()
    ])
    rows = F.array(*[F.struct(F.lit(i).alias("candidate"), *[F.col(f"{n}_{i}").alias(n) for n in cells]) for i in range(len(grid))])
    return evaluation.metrics(counted.select("fold", F.inline(rows)), tuple(dict.fromkeys((1, beta))))


def grid_table(scored: DataFrame, folds: int, beta: float) -> DataFrame:
    """(candidate, mean, least and greatest score over the folds, is_best, test metrics of the best)."""
    score, test = F.col(f"f{beta:g}"), F.col("fold") == folds
    names = ("precision", "recall", *dict.fromkeys(("f1", f"f{beta:g}")))
    summed = scored.groupBy("candidate").agg(
        *[f(F.when(~test, score)).alias(n) for n, f in (("mean_score", F.avg), ("min_score", F.min), ("max_score", F.max))],
        *[F.max(F.when(test, F.col(n))).alias(f"test_{n}") for n in names],
    )
    best = Window.partitionBy().orderBy(F.desc(F.round("mean_score", SCORE_DIGITS)), "candidate")  # one row per candidate
    ranked = summed.withColumn("is_best", F.row_number().over(best) == 1)
    return ranked.withColumns({f"test_{n}": F.when(F.col("is_best"), F.col(f"test_{n}")) for n in names})


def search(docs: DataFrame, key: str, grid: Sequence[Point], folds: int, beta: float = 4.0) -> DataFrame:
    """The scored grid for rows (key, label, fold, terms) of :func:`fold_table`, with the fields of each point."""
    predicted = predict_folds(docs, key, grid, folds, count_folds(docs, grid, folds))
    table = grid_table(fold_metrics(predicted, grid, beta), folds, beta)
    fields = {
        n: F.get(F.array(*[F.lit(float(v) if n != "balanced" else v) for v in (getattr(p, n) for p in grid)]), F.col("candidate"))
        for n in ("alpha", "min_df", "max_df", "balanced")
    }
    return table.select("candidate", *[c.alias(n) for n, c in fields.items()], *table.columns[1:])
