"""Texts are analysed once, however many steps use their terms."""

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from docsieve.functions import text as tx
from docsieve.operators import features as ft
from docsieve.operators import tuning
from docsieve.operators.analyzer import Analyzer, TextTerms
from docsieve.plans.text import QUERIES

TEXTS = ["red fox runs", "blue fox sleeps", "red dog runs runs", "blue dog sits", "red cat ran", "blue cat sits", "red fox", "blue dog", "", None]


def _docs(spark):
    rows = [(i, t, i % 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def analysed(monkeypatch):
    """How often texts were given to the analyser."""
    calls, plain = [], TextTerms._transform
    monkeypatch.setattr(TextTerms, "_transform", lambda self, df: (calls.append(df.columns), plain(self, df))[1])
    return calls


def test_scaled_features_analyse_each_document_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def words(text):
        seen.add(1)
        return (text or "").split()

    terms = _docs(spark).select("doc_id", F.udf(words, "array<string>").asNondeterministic()("text").alias("terms"))
    values = ft.long_features(terms, "doc_id", ft.FeatureSpec(1, 1.0, None, "tfidf", "std")).collect()
    assert seen.value == len(TEXTS)
    assert len(values) == sum(len(set((t or "").split())) for t in TEXTS)


def test_translated_text_is_computed_once(spark):
    plan = _plan(_docs(spark).select(tx.fold_accents(F.col("text")).alias("x")))
    assert plan.count("translate(") == 1
    assert _plan(QUERIES["ngrams_1_3"](spark, "/root/testdata/sf0.001")).count("translate(") == 1


def test_words_of_all_sizes_of_ngrams_are_stemmed_together(spark):
    terms = Analyzer(stop_words=None, ngrams=(1, 2), stem="last").terms(_docs(spark))
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("substring_index") == 0 and plan.count("ArrowEvalPython") == 1
    found = {r["doc_id"]: r["terms"] for r in terms.collect()}
    assert found[2] == ["red", "dog", "run", "run", "red dog", "dog run", "runs run"]
    assert found[8] == [] and found[9] == []


def test_counts_of_keys_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (1, ["a"]), (None, ["c"]), (2, []), (3, None)], "k int, terms array<string>")
    assert sorted(map(tuple, ft.term_counts(df, ["k"]).filter("k = 1").collect())) == [(1, "a", 1), (1, "a", 1), (1, "b", 2)]
    assert {tuple(r) for r in ft.term_counts(df, ["k"], keep_empty=True).filter("k IS NULL OR k > 1").collect()} == {
        (None, "c", 1), (2, None, None), (3, None, None)
    }
    assert {tuple(r) for r in ft.document_frequency(df).collect()} == {("a", 2, 2), ("b", 1, 2), ("c", 1, 1)}


def test_long_documents_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ft, "COUNTED_AT_ONCE", 2)
    df = spark.createDataFrame([(i, ["x", "y", "x"]) for i in range(5)], "k int, terms array<string>").coalesce(1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"k": i, "terms": ["x", "y", "x"]} for i in range(5)])
    assert [b.num_rows for b in ft._slices(iter([batch]))] == [1] * 5
    assert ft.term_counts(df, ["k"]).count() == 10


@pytest.mark.parametrize("weighting, scaler", [("tfidf", "std"), ("binary", None), ("count", "maxabs")])
def test_shared_features_equal_those_fitted_alone(spark, weighting, scaler):
    spec = ft.FeatureSpec(2, 0.8, 4, weighting, scaler)
    terms = Analyzer(stop_words=None).terms(_docs(spark)).drop("text")
    parts = [F.col("doc_id") != 0, F.col("doc_id") > 2]
    shared = ft.SharedFeatures(terms, parts, [spec, ft.FeatureSpec(1, 1.0)])
    for i, part in enumerate(parts):
        alone = ft.plain_columns(ft.fit_features(terms.filter(part), spec).model.transform(terms))
        expected = {r["doc_id"]: r["features"].toArray().tolist() for r in alone.collect()}
        found = {r["doc_id"]: r["features"].toArray().tolist() for r in shared.vectors(i, spec).collect()}
        assert found.keys() == expected.keys()
        assert all(found[k] == pytest.approx(expected[k]) for k in found)


def test_grid_points_of_equal_analysis_share_the_terms(spark, analysed):
    run = tuning.TextTuning(NaiveBayes, {"min_df": [1, 2]}, features=ft.FeatureSpec(1, 1.0, None, "count", None), balanced=False, folds=2)
    folded = _docs(spark).withColumn("fold", (F.floor(F.col("doc_id") / 2) % 2).cast("int"))
    assert len(run.cross_validate(folded)) == 2
    assert len(analysed) == 1


def test_compared_pipelines_share_the_terms(spark, analysed):
    run = tuning.TextTuning(NaiveBayes, {"smoothing": [1.0]}, features=ft.FeatureSpec(1, 1.0, None, "count", None), balanced=False)
    compared = tuning.compare_pipelines(_docs(spark), {"a": run, "b": run}, (1, 2)).collect()
    assert len(analysed) == 1
    assert [r["pipeline"] for r in compared] == ["a", "b", "a", "b"]
    for seed, row in ((1, compared[0]), (2, compared[2])):
        split = tuning.split_exact(_docs(spark), "doc_id", 0.2, seed)
        scored = run.refit(split.filter("split = 'train'"), {"smoothing": 1.0}).model.transform(split.filter("split = 'test'"))
        m = tuning.evaluation.metrics(tuning.evaluation.confusion_counts(scored), (1, 4)).first()
        assert (row["precision"], row["recall"], row["f1"], row["f4"]) == (m["precision"], m["recall"], m["f1"], m["f4"])
