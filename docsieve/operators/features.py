"""Term counts, vocabulary, weighting and scaling in long form: one row per document and term."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import Binarizer, CountVectorizerModel, ElementwiseProduct, Normalizer, VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docsieve.functions.text import filled
from docsieve.operators.ranking import ordered_index
from docsieve.session import materialize, small_batches


# Term occurrences that a task counts at a time; a single longer document is counted whole.
COUNTED_AT_ONCE = 1 << 19


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few enough at a time; their arrays of terms are the last column."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // COUNTED_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in pairwise(edges):
            yield batch.slice(low, high - low)


def _runs(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, place of its term in the distinct terms, and count, of every term of every row; the distinct terms."""
    terms = lists.flatten().dictionary_encode()
    rows, places = pc.list_parent_indices(lists).to_numpy(), terms.indices.to_numpy(zero_copy_only=False)
    n = max(1, len(terms.dictionary))
    pairs, counts = np.unique(rows.astype(np.int64) * n + places, return_counts=True)
    return pairs // n, pairs % n, counts, terms.dictionary


def term_counts(
    df: DataFrame, keys: Sequence[str], terms: str = "terms", binary: bool = False, keep_empty: bool = False
) -> DataFrame:
    """(keys, term, tf), counted inside each row, a batch of rows at a time.

    No shuffle is needed because a record is one row. ``keep_empty`` keeps a record
    without terms as one row of NULLs.
    """
    rows = df.select(*keys, F.col(terms).alias("_terms"))
    schema = StructType([*rows.schema.fields[:-1], StructField("term", StringType()), StructField("tf", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own, places, counts, distinct = _runs(batch.column(batch.num_columns - 1))
            found, tf = distinct.take(pa.array(places)), pa.array(np.ones_like(counts) if binary else counts, pa.int64())
            if keep_empty:
                empty = np.setdiff1d(np.arange(batch.num_rows), own)
                own = np.append(own, empty)
                found, tf = (pa.concat_arrays([x, pa.nulls(len(empty), x.type)]) for x in (found, tf))
            kept = [batch.column(i).take(pa.array(own)) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, found, tf], names=schema.names)

    small_batches(df.sparkSession)
    return rows.mapInArrow(count, schema)


def document_frequency(df: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, df, total): repeats collapse in the row, then in the batch; the rest is one combined aggregate."""

    counted = _part_frequency(df.select(F.lit("").alias("_parts"), F.col(terms).alias("_terms")))
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def frequency_bound(bound: float | int, n_docs: Column | int) -> Column:
    """A df bound in documents: floats are shares of all documents, integers are counts."""
    if isinstance(bound, float):
        return F.lit(bound) * n_docs
    return F.lit(float(bound))


def prune(frequencies: DataFrame, n_docs: Column | int, min_df: float | int = 1, max_df: float | int = 1.0) -> DataFrame:
    """Keep terms with ``min_df <= df <= max_df``, both ends included."""
    low, high = frequency_bound(min_df, n_docs), frequency_bound(max_df, n_docs)
    return frequencies.filter((F.col("df") >= low) & (F.col("df") <= high))


def cap_vocabulary(frequencies: DataFrame, max_features: int) -> DataFrame:
    """The most frequent terms of the corpus; ties go to the alphabetically first."""
    return frequencies.orderBy(F.desc("total"), "term").limit(max_features)


def fit_vocabulary(
    df: DataFrame,
    n_docs: int,
    terms: str = "terms",
    min_df: float | int = 1,
    max_df: float | int = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """(term, idx, df, total): pruned, then numbered alphabetically from 0; written out once."""
    kept = prune(document_frequency(df, terms), n_docs, min_df, max_df)
    if max_features is not None:
        kept = cap_vocabulary(kept, max_features)
    kept = materialize(kept, "vocabulary")
    return ordered_index(kept, "term")


def vocabulary_slices(vocabulary: DataFrame, k: int) -> DataFrame:
    """First, middle and last ``k`` terms, with the number of terms."""
    n = vocabulary.agg(F.count("*")).scalar()
    sized = vocabulary.select("idx", "term").withColumn("n_terms", n)
    half = F.floor(F.col("n_terms") / 2)
    parts = {
        "first": F.col("idx") < k,
        "middle": (F.col("idx") >= half) & (F.col("idx") < half + k),
        "last": F.col("idx") >= F.col("n_terms") - k,
    }
    marks = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in parts.items()]))
    return sized.select(F.explode(marks).alias("part"), "idx", "term", "n_terms")


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    """Row counts in ranges of equal width."""
    low = (F.floor(F.col(column) / width) * width).cast("long")
    value = F.col(column).cast("long")
    return df.groupBy(low.alias("low")).agg(
        F.count("*").alias("n_rows"), F.min(value).alias("smallest"), F.max(value).alias("largest")
    )


def smooth_idf(df: Column, n_docs: Column | int) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def weigh(counts: DataFrame, vocabulary: DataFrame, n_docs: int) -> DataFrame:
    """Relational tf-idf without norm: counts joined to the vocabulary.

    The join broadcasts the vocabulary while it is below the session's threshold.
    """
    return counts.join(vocabulary, "term").withColumn("value", F.col("tf") * smooth_idf(F.col("df"), n_docs))


def l2_norm(weights: DataFrame, key: str) -> DataFrame:
    """Relational row norm: divide each value by the root of its document's sum of squares."""
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    return weights.join(norms, key).withColumn("value", F.col("value") / F.col("_norm")).drop("_norm")


def population_std(values: DataFrame, n_docs: int) -> DataFrame:
    """(term, std) over all documents, absent terms counting as 0."""
    mean = F.sum("value") / F.lit(n_docs)
    square = F.sum(F.col("value") * F.col("value")) / F.lit(n_docs)
    return values.groupBy("term").agg(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))


def _scale(values: DataFrame, scales: DataFrame, scale: str) -> DataFrame:
    """Divide by a per-term scale; a zero scale leaves the value unchanged."""
    factor = F.when(F.col(scale) > ZERO_SCALE, F.col(scale)).otherwise(F.lit(1.0))
    return values.join(scales, "term").withColumn("value", F.col("value") / factor)


# A standard deviation below this is rounding noise of a constant column.
ZERO_SCALE = 1e-9


def standard_scale(values: DataFrame, n_docs: int) -> DataFrame:
    """Divide by the population standard deviation, without centring."""
    scales = materialize(population_std(values, n_docs), "std")
    return _scale(values, scales, "std")


def max_abs_scale(values: DataFrame) -> DataFrame:
    scales = values.groupBy("term").agg(F.max(F.abs("value")).cast("double").alias("max_abs"))
    return _scale(values, materialize(scales, "maxabs"), "max_abs")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with weight n_all / (n_classes * n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per class
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", output: str = "weight") -> DataFrame:
    # One row per class, so this side stays tiny whatever the data.
    weights = class_weights(df, label).select(label, F.col("weight").alias(output))
    return df.join(F.broadcast(weights), label)


@dataclass(frozen=True)
class FeatureSpec:
    """What the feature stage computes; classifiers that share it can share its output."""

    min_df: float | int = 0.01
    max_df: float | int = 0.8
    max_features: int | None = None
    weighting: str = "tfidf"  # tfidf, count or binary
    scaler: str | None = "std"  # std, maxabs or None


@dataclass
class FittedFeatures:
    """Vector stages (count, weigh, norm, scale), all narrow, plus the vocabulary behind them."""

    model: PipelineModel
    vocabulary: list[str]
    table: DataFrame


def vector_rows(df: DataFrame, keys: Sequence[str], vector: str = "features") -> DataFrame:
    """Long form (keys, idx, value) of a sparse vector column."""
    parts = F.unwrap_udt(F.col(vector))
    pairs = F.arrays_zip(parts["indices"].alias("idx"), parts["values"].alias("value"))
    return df.select(*keys, F.inline(filled(pairs))).withColumn("idx", F.col("idx").cast("long"))


def fit_features(
    df: DataFrame, spec: FeatureSpec, terms: str = "terms", output: str = "features", n_docs: int | None = None
) -> FittedFeatures:
    """Fit vocabulary, idf and scale with distributed aggregates; transform is narrow.

    Only model parameters (one entry per kept term, as any linear model holds) reach the
    driver; ``min_df``, ``max_df`` and ``max_features`` say how many there are.
    """
    n_docs = df.count() if n_docs is None else n_docs
    table = fit_vocabulary(df, n_docs, terms, spec.min_df, spec.max_df, spec.max_features)
    if table.isEmpty():
        raise ValueError("no term is left after pruning")
    return _vector_stages(df, spec, table, n_docs, terms, output)


def _vector_stages(
    df: DataFrame, spec: FeatureSpec, table: DataFrame, n_docs: int, terms: str, output: str
) -> FittedFeatures:
    rows = table.orderBy("idx").select("term", smooth_idf(F.col("df"), n_docs).alias("idf")).collect()
    counter = _counter([r["term"] for r in rows], spec, terms)
    stages = [counter, *_weighting(df, [counter], spec, [r["idf"] for r in rows], n_docs)]
    stages[-1].setOutputCol(output)
    return FittedFeatures(PipelineModel(stages), counter.vocabulary, table)


def _counter(vocabulary: list[str], spec: FeatureSpec, terms: str) -> CountVectorizerModel:
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol=terms, outputCol="_tf")
    return counter.setBinary(spec.weighting == "binary").setMinTF(1.0)


def _weighting(df: DataFrame, first: Sequence[Transformer], spec: FeatureSpec, idf: list[float], n_docs: int) -> list[Transformer]:
    """The stages after those that give ``_tf``: weigh, norm and scale."""
    stages, last = [], "_tf"
    if spec.weighting == "tfidf":
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=last, outputCol="_w"))
        stages.append(Normalizer(p=2.0, inputCol="_w", outputCol="_u"))
        last = "_u"
    if spec.scaler:
        values = vector_rows(PipelineModel([*first, *stages]).transform(df), [], last)
        scales = [1.0] * len(idf)
        for row in _vector_scales(values, spec.scaler, n_docs).collect():
            scales[row["idx"]] = 1.0 / row["scale"]
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense(scales), inputCol=last, outputCol="_scaled"))
    return stages


class SharedFeatures:
    """Features of several training parts of the same rows by several specs, for two passes over the terms.

    ``parts`` are conditions on the rows. The first pass counts every term in every part; the second writes ``rows``, with
    the counts of those terms that any part keeps by any spec in the vector ``_all`` in place of the terms. What a part and a
    spec keep is a slice of that vector, so fitting and transforming read no term again.
    """

    def __init__(self, df: DataFrame, parts: Sequence[Column], specs: Sequence[FeatureSpec], terms: str = "terms"):
        self.parts = [F.coalesce(p, F.lit(False)) for p in parts]
        self.n_docs = list(df.agg(*[F.count_if(p).alias(f"n_{i}") for i, p in enumerate(self.parts)]).first())
        mask = F.array(*[p for p in self.parts])
        bits = F.array_join(F.transform(mask, lambda p: p.cast("int").cast("string")), "").alias("_parts")
        counted = _part_frequency(df.select(bits, F.col(terms).alias("_terms")))
        sums = [
            F.sum(F.when(F.substring("_parts", i + 1, 1) == "1", F.col(c)).otherwise(0)).alias(f"{c}_{i}")
            for i in range(len(self.parts)) for c in ("df", "total")
        ]
        counted = counted.groupBy("term").agg(*sums)
        bounds = [
            (F.col(f"df_{i}") >= frequency_bound(s.min_df, n)) & (F.col(f"df_{i}") <= frequency_bound(s.max_df, n)) & (F.col(f"df_{i}") > 0)
            for i, n in enumerate(self.n_docs) for s in specs
        ]
        counted = materialize(counted.filter(reduce(or_, bounds)), "part-frequency")
        self.kept: dict[tuple[int, FeatureSpec], tuple[list[str], list[float]]] = {}
        for i, n in enumerate(self.n_docs):
            own = counted.select("term", F.col(f"df_{i}").alias("df"), F.col(f"total_{i}").alias("total")).filter("df > 0")
            for spec in specs:
                kept = prune(own, n, spec.min_df, spec.max_df)
                if spec.max_features is not None:
                    kept = cap_vocabulary(kept, spec.max_features)
                found = kept.orderBy("term").select("term", smooth_idf(F.col("df"), n).alias("idf")).collect()
                if not found:
                    raise ValueError("no term is left after pruning")
                self.kept[i, spec] = [r["term"] for r in found], [r["idf"] for r in found]
        # Places follow the order of the terms in Spark, that of their bytes.
        everything = sorted({t for vocabulary, _ in self.kept.values() for t in vocabulary}, key=lambda t: t.encode())
        self.place = {t: n for n, t in enumerate(everything)}
        counter = CountVectorizerModel.from_vocabulary(everything, inputCol=terms, outputCol="_all").setMinTF(1.0)
        self.rows = materialize(counter.transform(df).drop(terms), "counts")

    def vectors(self, part: int, spec: FeatureSpec, output: str = "features") -> DataFrame:
        """All rows with the features fitted on one part."""
        vocabulary, idf = self.kept[part, spec]
        first: list[Transformer] = [VectorSlicer(inputCol="_all", outputCol="_tf", indices=[self.place[t] for t in vocabulary])]
        if spec.weighting == "binary":
            first = [first[0].setOutputCol("_n"), Binarizer(threshold=0.0, inputCol="_n", outputCol="_tf")]
        stages = [*first, *_weighting(self.rows.filter(self.parts[part]), first, spec, idf, self.n_docs[part])]
        stages[-1].setOutputCol(output)
        return plain_columns(PipelineModel(stages).transform(self.rows)).drop("_all", "_n")


def _part_frequency(df: DataFrame) -> DataFrame:
    """(_parts, term, df, total) of rows (_parts, _terms), each batch of rows on its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            parts, (own, places, counts, distinct) = batch.column(0).dictionary_encode(), _runs(batch.column(1))
            n = max(1, len(distinct))
            keys = parts.indices.to_numpy()[own].astype(np.int64) * n + places
            found, spots = np.unique(keys, return_inverse=True)
            columns = [
                parts.dictionary.take(pa.array(found // n)), distinct.take(pa.array(found % n)),
                pa.array(np.bincount(spots, minlength=len(found)), pa.int64()),
                pa.array(np.bincount(spots, counts, len(found)).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_parts", "term", "df", "total"])

    small_batches(df.sparkSession)
    return df.mapInArrow(count, "_parts string, term string, df long, total long")


def long_features(df: DataFrame, key: str, spec: FeatureSpec, terms: str = "terms") -> DataFrame:
    """(key, idx, term, value) of every document, fitted on the same documents, for a vocabulary of any size."""
    # Texts are analysed once; the rows of kept terms are written before steps that join a table with a sum over itself.
    df = materialize(df.select(key, terms), "terms")
    n_docs = df.count()
    table = fit_vocabulary(df, n_docs, terms, spec.min_df, spec.max_df, spec.max_features)
    counts = term_counts(df, [key], terms, binary=spec.weighting == "binary")
    if spec.weighting == "tfidf":
        values = l2_norm(materialize(weigh(counts, table, n_docs).select(key, "idx", "term", "value"), "weights"), key)
    else:
        values = counts.join(table, "term").withColumn("value", F.col("tf").cast("double"))
    values = values.select(key, "idx", "term", "value")
    if spec.scaler:
        values = materialize(values, "values")
    if spec.scaler == "std":
        values = standard_scale(values, n_docs)
    elif spec.scaler == "maxabs":
        values = max_abs_scale(values)
    return values.select(key, "idx", "term", "value")


def _vector_scales(values: DataFrame, scaler: str, n_docs: int) -> DataFrame:
    """(idx, scale) for the columns whose scale is not zero."""
    if scaler == "maxabs":
        scale = F.max(F.abs("value"))
    elif scaler == "std":
        mean = F.sum("value") / F.lit(n_docs)
        square = F.sum(F.col("value") * F.col("value")) / F.lit(n_docs)
        scale = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    else:
        raise ValueError(f"unknown scaler {scaler!r}")
    return values.groupBy("idx").agg(scale.alias("scale")).filter(F.col("scale") > ZERO_SCALE)


def plain_columns(df: DataFrame) -> DataFrame:
    """Drop the intermediate vector columns."""
    return df.drop("_tf", "_w", "_u")
