"""Classifiers and pipeline stages on ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes,
)
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators.analyzer import Analyzer, TextTerms
from docsieve.operators.features import FeatureSpec, fit_features


class TextFeatures(Estimator):
    """Text to scaled vectors; fits to a pipeline model of native stages."""

    def __init__(self, analyzer: Analyzer | None = None, spec: FeatureSpec | None = None, text: str = "text",
                 output: str = "features"):
        super().__init__()
        self.analyzer, self.spec = analyzer or Analyzer(), spec or FeatureSpec()
        self.text, self.output = text, output

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        words = TextTerms.of(self.analyzer, self.text)
        fitted = fit_features(words.transform(dataset), self.spec, output=self.output)
        return PipelineModel([words, *fitted.model.stages])


class ClassBalance(Estimator, HasLabelCol, HasOutputCol):
    """Learns the balancing weight of each class from the rows it is fitted on."""

    def __init__(self, labelCol: str = "label", outputCol: str = "weight"):
        super().__init__()
        self._set(labelCol=labelCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> ClassBalanceModel:
        counts = {r[0]: r[1] for r in dataset.groupBy(self.getLabelCol()).count().collect()}  # one row per class
        n = sum(counts.values())
        weights = {str(int(c)): n / (len(counts) * k) for c, k in counts.items()}
        return ClassBalanceModel(self.getLabelCol(), self.getOutputCol(), list(weights), list(weights.values()))


class ClassBalanceModel(Model, HasLabelCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the learned weights; rows without a label column pass unchanged."""

    classes = Param(Params._dummy(), "classes", "class labels", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "their weights", TypeConverters.toListFloat)

    def __init__(self, labelCol: str = "label", outputCol: str = "weight", classes=(), weights=()):
        super().__init__()
        self._set(labelCol=labelCol, outputCol=outputCol, classes=list(classes), weights=list(weights))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getLabelCol() not in dataset.columns:
            return dataset
        weight = F.lit(1.0)
        for name, value in zip(self.getOrDefault("classes"), self.getOrDefault("weights")):
            weight = F.when(F.col(self.getLabelCol()).cast("int") == int(name), F.lit(value)).otherwise(weight)
        return dataset.withColumn(self.getOutputCol(), weight)


class CostEstimator(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol):
    """Linear model with a cost ``C`` on the summed loss instead of a penalty on the mean loss.

    Spark minimises mean loss + regParam/2 |w|^2, so regParam = 1 / (C * sum of weights).
    """

    def __init__(self, C: float, *, features: str = "features", label: str = "label", weight: str | None = "weight",
                 max_iter: int = 200, tol: float = 1e-4):
        super().__init__()
        self._set(featuresCol=features, labelCol=label)
        self.C, self.weight, self.max_iter, self.tol = C, weight, max_iter, tol

    def _penalty(self, dataset: DataFrame) -> float:
        total = F.sum(self.weight) if self.weight else F.count("*").cast("double")
        return 1.0 / (self.C * dataset.agg(total).first()[0])

    def _common(self) -> dict[str, object]:
        given = {
            "featuresCol": self.getFeaturesCol(), "labelCol": self.getLabelCol(), "maxIter": self.max_iter, "tol": self.tol,
        }
        return {**given, "weightCol": self.weight} if self.weight else given


class SupportVectors(CostEstimator):
    """Linear support vector machine with hinge loss."""

    def _fit(self, dataset: DataFrame):
        return LinearSVC(regParam=self._penalty(dataset), standardization=False, **self._common()).fit(dataset)


class Logistic(CostEstimator):
    """Logistic regression with an L1 or L2 penalty."""

    def __init__(self, C: float, penalty: str = "l2", **options: object):
        super().__init__(C, **options)
        self.penalty = penalty

    def _fit(self, dataset: DataFrame):
        share = {"l2": 0.0, "l1": 1.0}[self.penalty]
        return LogisticRegression(
            regParam=self._penalty(dataset), elasticNetParam=share, standardization=False, **self._common()
        ).fit(dataset)


class WeightVectorModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Linear model from given weights; scores with native expressions only."""

    coefficients = Param(Params._dummy(), "coefficients", "weight per feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "constant term", TypeConverters.toFloat)

    def __init__(self, featuresCol: str = "features", coefficients=(0.0,), intercept: float = 0.0):
        super().__init__()
        self._set(featuresCol=featuresCol, coefficients=list(coefficients), intercept=float(intercept))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = Vectors.dense(self.getOrDefault("coefficients"))
        product = ElementwiseProduct(scalingVec=weights, inputCol=self.getFeaturesCol(), outputCol="_product")
        values = F.unwrap_udt(F.col("_product"))["values"]
        margin = F.aggregate(values, F.lit(self.getOrDefault("intercept")), lambda total, x: total + x)
        scored = product.transform(dataset).withColumn("_margin", margin)
        raw = array_to_vector(F.array(-F.col("_margin"), F.col("_margin")))
        return scored.withColumn("rawPrediction", raw).withColumn(
            "prediction", (F.col("_margin") > 0).cast("double")
        ).drop("_product", "_margin")


def confidence(raw: str = "rawPrediction") -> Column:
    """Signed distance from the decision boundary, positive for 'yes'."""
    return F.get(vector_to_array(F.col(raw)), F.lit(1))


def has_margin(model: object) -> bool:
    """Whether a model has a decision function; naive Bayes and trees have none."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    return not type(last).__name__.startswith(("NaiveBayes", "DecisionTree"))


def with_confidence(scored: DataFrame, model: object) -> DataFrame:
    """Append ``confidence``: the signed margin, NULL for models without a decision function."""
    value = confidence() if has_margin(model) else F.lit(None).cast("double")
    return scored.withColumn("confidence", value)


def coefficients(spark, model: object, vocabulary: list[str]) -> DataFrame:
    """(idx, term, weight) of a fitted linear model."""
    if isinstance(model, WeightVectorModel):
        weights = model.getOrDefault("coefficients")
    else:
        weights = DenseVector(model.coefficients.toArray()).values.tolist()
    rows = [(i, t, float(w)) for i, (t, w) in enumerate(zip(vocabulary, weights))]
    return spark.createDataFrame(rows, "idx long, term string, weight double")


def naive_bayes(kind: str) -> NaiveBayes:
    """Multinomial, Bernoulli or Gaussian naive Bayes with the usual smoothing of one."""
    return NaiveBayes(modelType=kind, smoothing=1.0, featuresCol="features", labelCol="label")


def decision_tree(max_depth: int = 30, seed: int = 42) -> DecisionTreeClassifier:
    """A tree; Spark's trees have 30 levels at most."""
    if max_depth > 30:
        raise ValueError(f"a tree of {max_depth} levels is asked for; 30 is the most")
    return DecisionTreeClassifier(maxDepth=max_depth, featuresCol="features", labelCol="label", seed=seed)


def make_f_scorer(beta: float) -> Evaluator:
    """F-beta of class 1; beta 0 stands for the model's default score, accuracy."""
    if beta == 0:
        return MulticlassClassificationEvaluator(metricName="accuracy")
    return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, beta=float(beta))


def named_steps(pipeline: Pipeline | PipelineModel, names: tuple[str, ...]) -> dict[str, object]:
    """Stages by name, in order."""
    stages = pipeline.getStages() if isinstance(pipeline, Pipeline) else pipeline.stages
    return dict(zip(names, stages))
