"""Naive Bayes as aggregates over (document, term, count) rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators import features as ft
from docsieve.operators.sampling import TEST, split_exact
from docsieve.session import materialize


@dataclass(frozen=True)
class BayesModel:
    """Per-term log weights (term, w_no, w_yes) and the class parts of the score."""

    weights: DataFrame
    base_no: float
    base_yes: float
    binary: bool


def class_term_table(train: DataFrame, min_df: float | int, max_df: float | int, n_docs: int) -> DataFrame:
    """(term, df, df_no, df_yes, n_no, n_yes) of the terms within the df bounds.

    Counting happens inside each row; the only exchange is the combined aggregate by term.
    """
    counts = ft.term_counts(train, ["label"])
    no, yes = F.col("label") == 0, F.col("label") == 1
    table = counts.groupBy("term").agg(
        F.count("*").alias("df"),
        F.count_if(no).alias("df_no"),
        F.count_if(yes).alias("df_yes"),
        F.coalesce(F.sum(F.when(no, F.col("tf"))), F.lit(0)).alias("n_no"),
        F.coalesce(F.sum(F.when(yes, F.col("tf"))), F.lit(0)).alias("n_yes"),
    )
    return ft.prune(table, n_docs, min_df, max_df)


def _class_sizes(train: DataFrame) -> tuple[int, int]:
    row = train.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    return row[0], row[1]


def _log_share(count: Column, alpha: float, total: float) -> Column:
    return F.log((count + F.lit(alpha)) / F.lit(total))


def multinomial_weights(table: DataFrame, alpha: float) -> DataFrame:
    """(term, w_no, w_yes): log of the smoothed share of each class's term count."""
    sums = table.agg(F.sum("n_no"), F.sum("n_yes"), F.count("*")).first()
    total_no, total_yes = (float(sums[i]) + alpha * sums[2] for i in (0, 1))
    return table.select(
        "term",
        _log_share(F.col("n_no"), alpha, total_no).alias("w_no"),
        _log_share(F.col("n_yes"), alpha, total_yes).alias("w_yes"),
    )


def fit_multinomial(train: DataFrame, alpha: float = 1.0, min_df: float | int = 1, max_df: float | int = 1.0) -> BayesModel:
    """Fit on rows (label, terms); the class prior is the class share."""
    n_no, n_yes = _class_sizes(train)
    table = materialize(class_term_table(train, min_df, max_df, n_no + n_yes), "nb-terms")
    n = n_no + n_yes
    return BayesModel(multinomial_weights(table, alpha), math.log(n_no / n), math.log(n_yes / n), False)


def fit_bernoulli(train: DataFrame, alpha: float = 1.0, min_df: float | int = 1, max_df: float | int = 1.0) -> BayesModel:
    """Presence model; what absent terms contribute is folded into the class part."""
    n_no, n_yes = _class_sizes(train)
    table = materialize(class_term_table(train, min_df, max_df, n_no + n_yes), "nb-terms")
    p_no = (F.col("df_no") + F.lit(alpha)) / F.lit(n_no + 2 * alpha)
    p_yes = (F.col("df_yes") + F.lit(alpha)) / F.lit(n_yes + 2 * alpha)
    absent = table.agg(F.sum(F.log(1 - p_no)), F.sum(F.log(1 - p_yes))).first()
    weights = table.select(
        "term", (F.log(p_no) - F.log(1 - p_no)).alias("w_no"), (F.log(p_yes) - F.log(1 - p_yes)).alias("w_yes")
    )
    n = n_no + n_yes
    return BayesModel(weights, math.log(n_no / n) + absent[0], math.log(n_yes / n) + absent[1], True)


def score(model: BayesModel, docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score_no, score_yes, confidence, prediction) for rows (keys, terms).

    Terms are counted in the row and meet the weights by a join that is broadcast while the
    weights are small; a document's partial sums leave its task as one row.
    """
    counts = ft.term_counts(docs, keys, binary=model.binary, keep_empty=True)
    tf = F.col("tf")
    sums = counts.join(model.weights, "term", "left").groupBy(*keys).agg(
        F.sum(tf * F.col("w_no")).alias("s_no"), F.sum(tf * F.col("w_yes")).alias("s_yes")
    )
    no = F.coalesce(F.col("s_no"), F.lit(0.0)) + F.lit(model.base_no)
    yes = F.coalesce(F.col("s_yes"), F.lit(0.0)) + F.lit(model.base_yes)
    return sums.select(*keys, no.alias("score_no"), yes.alias("score_yes")).withColumns(
        {
            "confidence": F.col("score_yes") - F.col("score_no"),
            "prediction": (F.col("score_yes") > F.col("score_no")).cast("int"),
        }
    )


# Share of the greatest variance of a term that is added to every variance.
VARIANCE_FLOOR = 1e-9


@dataclass(frozen=True)
class GaussianModel:
    """Per-term moments (term, mean_no, mean_yes, var_no, var_yes) and the class parts of the score."""

    table: DataFrame
    base_no: float
    base_yes: float


def _density(x: Column, c: str) -> Column:
    """Log of the normal density of a term's count in class ``c``."""
    away = x - F.col(f"mean_{c}")
    return F.lit(-0.5) * F.log(F.lit(2.0) * F.pi() * F.col(f"var_{c}")) - away * away / (F.lit(2.0) * F.col(f"var_{c}"))


def fit_gaussian(train: DataFrame, min_df: float | int = 1, max_df: float | int = 1.0, floor: float = VARIANCE_FLOOR) -> GaussianModel:
    """Fit on rows (label, terms): sums and squares by term and class in one aggregate, zeros counted by division.

    A class without rows has no moments; its means and variances are those of an empty class, zero and the floor.
    """
    n_no, n_yes = _class_sizes(train)
    n, tf = n_no + n_yes, F.col("tf").cast("double")
    classes = {"no": (F.col("label") == 0, max(n_no, 1)), "yes": (F.col("label") == 1, max(n_yes, 1))}
    counted = ft.term_counts(train, ["label"]).groupBy("term").agg(
        F.count("*").alias("df"),
        *[F.coalesce(F.sum(F.when(test, x)), F.lit(0.0)).alias(f"{name}_{c}") for c, (test, _) in classes.items() for name, x in (("s", tf), ("q", tf * tf))],
    )
    moments = materialize(ft.prune(counted, n, min_df, max_df), "nb-moments")
    mean = (F.col("s_no") + F.col("s_yes")) / F.lit(max(n, 1))
    widest = moments.agg(F.max((F.col("q_no") + F.col("q_yes")) / F.lit(max(n, 1)) - mean * mean)).first()[0] or 0.0
    own = {c: F.col(f"s_{c}") / F.lit(size) for c, (_, size) in classes.items()}
    table = materialize(moments.select("term", *[m.alias(f"mean_{c}") for c, m in own.items()], *[
        (F.greatest(F.col(f"q_{c}") / F.lit(size) - own[c] * own[c], F.lit(0.0)) + F.lit(floor * widest)).alias(f"var_{c}")
        for c, (_, size) in classes.items()
    ]), "nb-gaussian")
    # A document without any kept term: every density at zero.
    absent = table.agg(*[F.coalesce(F.sum(_density(F.lit(0.0), c)), F.lit(0.0)) for c in classes]).first()
    prior = [math.log(size / n) if size else -math.inf for size in (n_no, n_yes)]
    return GaussianModel(table, prior[0] + absent[0], prior[1] + absent[1])


def score_gaussian(model: GaussianModel, docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score_no, score_yes, confidence, prediction): present terms replace their density at zero."""
    counts = ft.term_counts(docs, keys, keep_empty=True).join(model.table, "term", "left")
    x = F.col("tf").cast("double")
    sums = counts.groupBy(*keys).agg(*[F.sum(_density(x, c) - _density(F.lit(0.0), c)).alias(f"s_{c}") for c in ("no", "yes")])
    no, yes = (F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) + F.lit(b) for c, b in (("no", model.base_no), ("yes", model.base_yes)))
    return sums.select(*keys, no.alias("score_no"), yes.alias("score_yes")).withColumns(
        {
            "confidence": F.col("score_yes") - F.col("score_no"),
            "prediction": (F.col("score_yes") > F.col("score_no")).cast("int"),
        }
    )


def compare_splits(
    docs: DataFrame, key: str, seeds: Sequence[int], alphas: Sequence[float], fraction: float,
    min_df: float | int, max_df: float | int,
) -> DataFrame:
    """Test predictions (key, label, seed, alpha, prediction) of every split and smoothing.

    All splits are fitted in one pass over the texts and scored in a second one: each split
    is a set of columns of the same aggregate, not a run of its own.
    """
    flags = [f"test_{s}" for s in seeds]
    ids = docs.select(key)
    for seed, flag in zip(seeds, flags):
        docs = split_exact(docs, key, fraction, seed, flag, ids).withColumn(flag, F.col(flag) == TEST)
    label, tf = F.col("label"), F.col("tf")
    classes = {"no": label == 0, "yes": label == 1}
    sizes = docs.agg(
        *[F.count_if(~F.col(f) & test).alias(f"{c}_{f}") for f in flags for c, test in classes.items()]
    ).first()

    counts = ft.term_counts(docs, ["label", *flags])
    table = counts.groupBy("term").agg(
        *[F.count_if(~F.col(f)).alias(f"df_{f}") for f in flags],
        *[
            F.coalesce(F.sum(F.when(~F.col(f) & test, tf)), F.lit(0)).alias(f"n_{c}_{f}")
            for f in flags for c, test in classes.items()
        ],
    )
    in_bounds = {}
    for f in flags:
        n = sizes[f"no_{f}"] + sizes[f"yes_{f}"]
        low, high = ft.frequency_bound(min_df, n), ft.frequency_bound(max_df, n)
        in_bounds[f] = (F.col(f"df_{f}") >= low) & (F.col(f"df_{f}") <= high)
    kept = table.filter(reduce(lambda a, b: a | b, in_bounds.values()))
    kept = materialize(kept.withColumns({f"in_{f}": test for f, test in in_bounds.items()}), "nb-splits")
    totals = kept.agg(
        *[F.count_if(f"in_{f}").alias(f"terms_{f}") for f in flags],
        *[F.sum(F.when(F.col(f"in_{f}"), F.col(f"n_{c}_{f}"))).alias(f"n_{c}_{f}") for f in flags for c in classes],
    ).first()

    runs = [(seed, flag, i, alpha) for seed, flag in zip(seeds, flags) for i, alpha in enumerate(alphas)]

    def log_odds(flag: str, alpha: float) -> Column:
        yes, no = (
            _log_share(F.col(f"n_{c}_{flag}"), alpha, totals[f"n_{c}_{flag}"] + alpha * totals[f"terms_{flag}"])
            for c in ("yes", "no")
        )
        return F.when(F.col(f"in_{flag}"), yes - no)

    weights = kept.select("term", *[log_odds(flag, alpha).alias(f"w_{flag}_{i}") for _, flag, i, alpha in runs])
    sums = (
        ft.term_counts(docs, [key, "label", *flags], keep_empty=True)
        .join(weights, "term", "left")
        .groupBy(key, "label", *flags)
        .agg(*[F.sum(tf * F.col(f"w_{flag}_{i}")).alias(f"s_{flag}_{i}") for _, flag, i, _ in runs])
    )
    outcomes = F.array(
        *[
            F.struct(
                F.lit(seed).alias("seed"),
                F.lit(float(alpha)).alias("alpha"),
                F.col(flag).alias("is_test"),
                (
                    F.coalesce(F.col(f"s_{flag}_{i}"), F.lit(0.0))
                    > F.lit(math.log(sizes[f"no_{flag}"] / sizes[f"yes_{flag}"]))
                ).cast("int").alias("prediction"),
            )
            for seed, flag, i, alpha in runs
        ]
    )
    return sums.select(key, "label", F.inline(outcomes)).filter("is_test").drop("is_test")


def linear_weights(model: BayesModel) -> tuple[DataFrame, float]:
    """The same model as one signed weight per term and an intercept."""
    weights = model.weights.select("term", (F.col("w_yes") - F.col("w_no")).alias("weight"))
    return weights, model.base_yes - model.base_no
