"""Sigmoid-kernel features against a few landmark rows, so that a linear model can use them.

Landmarks are kept sparse, so what a model holds and sends to tasks is the features of ``n`` rows, whatever the size of the
vocabulary. Long features (key, term, value) meet landmarks in a join; vectors meet them inside a task, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators.sampling import random_subset
from docsieve.session import materialize


def _sigmoid(product: Column, gamma: float, coef0: float) -> Column:
    return F.tanh(F.lit(gamma) * product + F.lit(coef0))


def choose_landmarks(values: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(landmark, term, value) of ``n`` documents in hash order, numbered by key."""
    chosen = random_subset(values.select(key).distinct(), key, n, seed)
    places = chosen.agg(F.array_sort(F.collect_set(key)).alias("keys")).select(F.posexplode("keys").alias("landmark", key))
    return materialize(values.join(F.broadcast(places), key).select("landmark", "term", "value"), "landmarks")  # n keys


def kernel_values(values: DataFrame, landmarks: DataFrame, key: str, gamma: float, coef0: float = 0.0) -> DataFrame:
    """(key, landmark, value) with tanh(gamma * x . l + coef0) where a document shares a term with a landmark.

    All other pairs have the value tanh(coef0). A document's products combine in its task before they leave it.
    """
    other = landmarks.select("term", "landmark", F.col("value").alias("_l"))
    products = values.join(other, "term").groupBy(key, "landmark").agg(F.sum(F.col("value") * F.col("_l")).alias("_x"))
    return products.select(key, "landmark", _sigmoid(F.col("_x"), gamma, coef0).alias("value"))


class SigmoidLandmarks(Estimator):
    """Picks ``n`` rows in hash order; a row becomes tanh(gamma * x.l + coef0) for each of them."""

    def __init__(self, key: str, n: int = 64, gamma: float = 0.1, coef0: float = 0.0, seed: int = 0,
                 features: str = "features", output: str = "kernel"):
        super().__init__()
        self.key, self.n, self.gamma, self.coef0, self.seed = key, n, gamma, coef0, seed
        self.features, self.output = features, output

    def _fit(self, dataset: DataFrame) -> SigmoidLandmarksModel:
        chosen = random_subset(dataset.select(self.key, self.features), self.key, self.n, self.seed)
        starts, places, values = [0], [], []
        for row in chosen.orderBy(self.key).select(self.features).collect():  # n rows by construction
            vector = row[0].toArray()
            kept = np.flatnonzero(vector)
            places += kept.tolist()
            values += vector[kept].tolist()
            starts.append(len(places))
        return SigmoidLandmarksModel(self.features, self.output, starts, places, values, self.gamma, self.coef0)


class SigmoidLandmarksModel(Model, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Landmark i has the features ``places[starts[i]:starts[i + 1]]`` with the values beside them."""

    starts = Param(Params._dummy(), "starts", "where each landmark begins", TypeConverters.toListInt)
    places = Param(Params._dummy(), "places", "features of the landmarks", TypeConverters.toListInt)
    values = Param(Params._dummy(), "values", "values of the landmarks", TypeConverters.toListFloat)
    gamma = Param(Params._dummy(), "gamma", "factor of the product", TypeConverters.toFloat)
    coef0 = Param(Params._dummy(), "coef0", "constant beside the product", TypeConverters.toFloat)

    def __init__(self, featuresCol: str = "features", outputCol: str = "kernel", starts=(0,), places=(), values=(), gamma: float = 0.1,
                 coef0: float = 0.0):
        super().__init__()
        self._set(
            featuresCol=featuresCol, outputCol=outputCol, starts=list(starts), places=list(places), values=list(values),
            gamma=float(gamma), coef0=float(coef0),
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        starts, places, values = (np.array(self.getOrDefault(p)) for p in ("starts", "places", "values"))
        n, gamma, coef0 = len(starts) - 1, self.getOrDefault("gamma"), self.getOrDefault("coef0")
        # Entries by feature: a feature of a row meets a run of them.
        order = np.argsort(places, kind="stable")
        owner = np.repeat(np.arange(n), np.diff(starts))[order]
        held = dataset.sparkSession.sparkContext.broadcast((places[order].astype(np.int64), owner, values[order].astype(float)))

        @F.pandas_udf("array<double>")
        def kernel(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            by_place, landmark, value = held.value
            for indices, rows in batches:
                own = [np.arange(len(x)) if i is None else np.asarray(i) for i, x in zip(indices, rows)]
                spots = np.concatenate(own).astype(np.int64) if own else np.zeros(0, dtype=np.int64)
                low, high = np.searchsorted(by_place, spots), np.searchsorted(by_place, spots, side="right")
                met = np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]) if len(low) else low, high - low) + np.arange((high - low).sum())
                row = np.repeat(np.arange(len(own)), [len(i) for i in own])
                x = np.concatenate([np.asarray(v, dtype=float) for v in rows]) if own else np.zeros(0)
                cell = np.repeat(row * n, high - low) + landmark[met]
                sums = np.bincount(cell, np.repeat(x, high - low) * value[met], minlength=len(own) * n)
                yield pd.Series(list(np.tanh(gamma * sums.reshape(len(own), n) + coef0)), dtype=object)

        vector = F.unwrap_udt(F.col(self.getFeaturesCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(kernel(vector["indices"], vector["values"])))
