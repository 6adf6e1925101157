"""Queries that train iterative models: rows are checked, values depend on the solver."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import models, tuning
from docsieve.operators.features import FeatureSpec
from docsieve.operators.pipelines import BLESSED, candidate_pipelines, sigmoid_support_vectors
from docsieve.operators.sampling import TRAIN, split_exact
from docsieve.operators.sgd import AveragedSGD, perceptron
from docsieve.plans import mapping as m
from docsieve.plans.sampling import FRACTION, SPLIT_SEED
from docsieve.session import materialize, shared_dir, spread


def _rare(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with the rare class as positive."""
    return m.labelled_documents(spark, folder).withColumn("label", 1 - F.col("label"))


def _score(spark: SparkSession, folder: str, run: tuning.TextTuning) -> DataFrame:
    """Fit the single candidate of ``run`` on the training split and score all labelled documents."""
    split = materialize(split_exact(_rare(spark, folder), "doc_id", FRACTION, SPLIT_SEED), "split")
    (candidate,) = tuning.expand_grid(run.grid)
    fitted = run.refit(split.filter(F.col("split") == TRAIN), candidate)
    scored = models.with_confidence(fitted.model.transform(split), fitted.model)
    return scored.select(
        "doc_id", "split", "label", F.col("prediction").cast("int").alias("prediction"), "confidence"
    )


def _run(classifier, weighting: str = "tfidf", scaler: str | None = "std", balanced: bool = True, **parameters):
    return tuning.TextTuning(
        classifier, {k: [v] for k, v in parameters.items()}, features=FeatureSpec(0.01, 0.8, None, weighting, scaler),
        balanced=balanced,
    )


def linear_svc_score(spark: SparkSession, folder: str) -> DataFrame:
    return _score(spark, folder, candidate_pipelines()[BLESSED])


def logistic_score(spark: SparkSession, folder: str) -> DataFrame:
    return _score(spark, folder, _run(models.Logistic, C=1e-3, penalty="l2"))


def sgd_score(spark: SparkSession, folder: str) -> DataFrame:
    """Hinge loss by gradient descent, and the perceptron, on the same rows."""
    hinge = _run(AveragedSGD, "count", "maxabs", loss="hinge", alpha=1.0, eta0=0.01, learning_rate="invscaling")
    plain = _run(perceptron, "tfidf", None, False, weight=None)
    parts = [
        _score(spark, folder, run).withColumn("model", F.lit(name)) for name, run in (("hinge", hinge), ("perceptron", plain))
    ]
    return parts[0].unionByName(parts[1])


def decision_tree_score(spark: SparkSession, folder: str) -> DataFrame:
    return _score(spark, folder, _run(models.decision_tree, "count", None, False, max_depth=30))


def kernel_landmark_score(spark: SparkSession, folder: str) -> DataFrame:
    return _score(spark, folder, _run(sigmoid_support_vectors, "tfidf", "maxabs", C=0.1, gamma=0.1))


def nb_ml_score(spark: SparkSession, folder: str) -> DataFrame:
    """The library's multinomial, Bernoulli and Gaussian models."""
    parts = [
        _score(spark, folder, _run(models.naive_bayes, weighting, None, False, kind=kind)).withColumn("model", F.lit(kind))
        for kind, weighting in (("multinomial", "count"), ("bernoulli", "binary"), ("gaussian", "count"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def grid_search_report(spark: SparkSession, folder: str) -> DataFrame:
    """Two feature settings by two costs, three folds, refit: the grid with its scores."""
    run = tuning.TextTuning(
        models.Logistic, {"ngrams": [(1, 1), (1, 2)], "C": [1e-5, 1e-4], "penalty": ["l2"]},
        features=FeatureSpec(0.01, 0.8), folds=3, seeds={"split": SPLIT_SEED, "classifier": 1}, parallelism=4,
    )
    result = run.fit(_rare(spark, folder))
    test = result.metrics().filter("split = 'test'").select(
        F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"), F.col("f4").alias("test_f4")
    )
    (row,) = test.collect()  # one row of the chosen model
    return result.grid_table().select(
        "candidate", "params", "mean_score", "min_score", "max_score", "is_best",
        *[F.when(F.col("is_best"), F.lit(row[c])).alias(c) for c in test.columns],
    )


def split_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Three of the candidate pipelines over two splits, averaged."""
    chosen = {n: r for n, r in candidate_pipelines().items() if n in ("svm_80", "svm_70", "huber_1e-8")}
    return tuning.average_over_splits(tuning.compare_pipelines(_rare(spark, folder), chosen, (1, 2)))


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Fit the blessed pipeline on all labelled documents, save it, load it, score every document."""
    run = candidate_pipelines()[BLESSED]
    (candidate,) = tuning.expand_grid(run.grid)
    fitted = run.refit(materialize(_rare(spark, folder), "labelled"), candidate)
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    fitted.model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    docs = m.documents(spark, folder).select("doc_id", "text")
    docs = spread(docs, "doc_id")
    scored = models.with_confidence(loaded.transform(docs), loaded)
    return scored.select("doc_id", F.col("prediction").cast("int").alias("prediction"), "confidence")


QUERIES = {
    f.__name__: f
    for f in (
        linear_svc_score, logistic_score, sgd_score, decision_tree_score, kernel_landmark_score, nb_ml_score,
        grid_search_report, split_comparison, model_roundtrip,
    )
}
