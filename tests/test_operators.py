"""Selections, features, metrics and models on small fixtures with values worked out by hand."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import DenseVector, Vectors, VectorUDT
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.operators import bayes, evaluation, linear, models, ranking, reconcile, sampling, tuning
from docsieve.operators import features as ft
from docsieve.operators.analyzer import Analyzer, TextTerms
from docsieve.operators.landmarks import SigmoidLandmarks, SigmoidLandmarksModel
from docsieve.operators.pipelines import sigmoid_support_vectors
from docsieve.operators.sgd import AveragedSGD, perceptron


def md5(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def ids(spark, n, **columns):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    return df.withColumns({k: F.expr(v) for k, v in columns.items()}) if columns else df


# --- selections -----------------------------------------------------------------------


@pytest.mark.parametrize("n, fraction, expected", [(3201, 0.2, 641), (10, 0.25, 3), (7, 0.0, 0), (7, 1.0, 7)])
def test_exact_split_sizes(spark, n, fraction, expected):
    rows = sampling.split_exact(ids(spark, n), "doc_id", fraction, 5).filter("split = 'test'").collect()
    wanted = sorted(range(n), key=lambda k: (md5(5, k), k))[:expected]
    assert {r["doc_id"] for r in rows} == set(wanted)


def test_split_does_not_depend_on_partitioning(spark):
    a = sampling.split_exact(ids(spark, 500), "doc_id", 0.3, 1).collect()
    b = sampling.split_exact(ids(spark, 500).repartition(7), "doc_id", 0.3, 1).collect()
    assert set(a) == set(b)


def test_approximate_split_is_near_its_share(spark):
    n = sampling.split_approximate(ids(spark, 5000), "doc_id", 0.2, 1).filter("split = 'test'").count()
    assert 900 < n < 1100


def test_folds_are_even_per_class(spark):
    df = sampling.stratified_folds(ids(spark, 103, label="cast(doc_id % 4 = 0 AS int)"), "doc_id", "label", 5, 3)
    counts = df.groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    ranked = sorted((k for k in range(103) if k % 4 == 0), key=lambda k: (md5(3, k), k))
    assert {r["doc_id"]: r["fold"] for r in df.filter("label = 1").collect()} == {k: i % 5 for i, k in enumerate(ranked)}


@pytest.mark.parametrize("rule, n_yes", [("cast(doc_id % 4 = 0 AS int)", 25), ("cast(doc_id % 4 <> 0 AS int)", 75)])
def test_balanced_sample_and_leftovers(spark, rule, n_yes):
    df = ids(spark, 100, label=rule)
    sample = {tuple(r) for r in sampling.balanced_sample(df, "doc_id", "label", 9).collect()}
    rest = {tuple(r) for r in sampling.leftovers(df, "doc_id", "label", 9).collect()}
    assert sum(1 for _, y in sample if y) == n_yes
    assert sum(1 for _, y in sample if not y) == min(n_yes, 100 - n_yes)
    assert not sample & rest and {k for k, _ in sample | rest} == set(range(100))


def test_random_subset(spark):
    assert sampling.random_subset(ids(spark, 50), "doc_id", 7, 1).count() == 7
    assert sampling.random_subset(ids(spark, 5), "doc_id", 7, 1).count() == 5


def test_ordered_index(spark):
    df = spark.createDataFrame([(f"t{(i * 37) % 101:03d}",) for i in range(101)], "term string")
    rows = ranking.ordered_index(df, "term").orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(101))
    assert [r["term"] for r in rows] == sorted(r["term"] for r in rows)


def test_split_report_truncates(spark):
    df = ids(spark, 641, label="cast(doc_id < 216 AS int)", split="'test'")
    row = sampling.split_report(df).filter("part = 'test'").first()
    assert (row["n_rows"], row["n_yes"], row["n_no"], row["percent_yes"]) == (641, 216, 425, 33)


# --- features -------------------------------------------------------------------------


def docs(spark, *texts):
    rows = [(i, t.split(), i % 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, terms array<string>, label int")


def test_counts_in_the_row(spark):
    df = docs(spark, "b a b", "", "c")
    assert {tuple(r) for r in ft.term_counts(df, ["doc_id"]).collect()} == {(0, "a", 1), (0, "b", 2), (2, "c", 1)}
    kept = ft.term_counts(df, ["doc_id"], keep_empty=True, binary=True).collect()
    assert {tuple(r) for r in kept} == {(0, "a", 1), (0, "b", 1), (1, None, None), (2, "c", 1)}


@pytest.mark.parametrize(
    "low, high, kept", [(0.1, 0.8, {"half", "one"}), (0.2, 0.8, {"half"}), (2, 0.98, {"half"}), (0.1, 1.0, {"all", "half", "one"}), (1, 1, {"one"})]
)
def test_pruning_bounds(spark, low, high, kept):
    texts = ["all" + (" half" if i < 5 else "") + (" one" if i == 0 else "") for i in range(10)]
    vocabulary = ft.fit_vocabulary(docs(spark, *texts), 10, min_df=low, max_df=high)
    assert {r["term"] for r in vocabulary.collect()} == kept


def test_relational_and_vector_features_agree(spark):
    df = docs(spark, "a b b c", "a c", "b d d d", "c", "a b c d")
    table = ft.fit_vocabulary(df, 5)
    relational = ft.l2_norm(ft.weigh(ft.term_counts(df, ["doc_id"]), table, 5), "doc_id")
    scaled = {(r["doc_id"], r["term"]): r["value"] for r in ft.standard_scale(relational.select("doc_id", "term", "value"), 5).collect()}
    fitted = ft.fit_features(df, ft.FeatureSpec(1, 1.0, None, "tfidf", "std"))
    rows = ft.vector_rows(fitted.model.transform(df), ["doc_id"]).collect()
    vector = {(r["doc_id"], fitted.vocabulary[r["idx"]]): r["value"] for r in rows}
    assert vector.keys() == scaled.keys()
    assert all(abs(vector[k] - scaled[k]) < 1e-9 for k in vector)


@pytest.mark.parametrize("weighting, scaler", [("tfidf", "std"), ("tfidf", None), ("count", "maxabs"), ("binary", None)])
def test_long_features_equal_the_vector_stages(spark, weighting, scaler):
    df = docs(spark, "a b b c", "a c", "", "b d d d", "c", "a b c d")
    spec = ft.FeatureSpec(1, 1.0, None, weighting, scaler)
    long = {(r["doc_id"], r["idx"]): r["value"] for r in ft.long_features(df, "doc_id", spec).collect()}
    fitted = ft.fit_features(df, spec)
    vectors = {(r["doc_id"], r["idx"]): r["value"] for r in ft.vector_rows(fitted.model.transform(df), ["doc_id"]).collect()}
    assert long.keys() == vectors.keys() and all(abs(long[k] - vectors[k]) < 1e-9 for k in long)


def test_scalers_keep_constant_columns(spark):
    rows = [(0, "const", 2.0), (1, "const", 2.0), (0, "vary", -4.0), (1, "vary", 2.0), (0, "sparse", 3.0)]
    df = spark.createDataFrame(rows, "doc_id long, term string, value double")
    std = {(r["doc_id"], r["term"]): r["value"] for r in ft.standard_scale(df, 2).collect()}
    assert std[0, "const"] == 2.0 and math.isclose(std[0, "vary"], -4 / 3) and math.isclose(std[0, "sparse"], 2.0)
    top = {(r["doc_id"], r["term"]): r["value"] for r in ft.max_abs_scale(df).collect()}
    assert top[0, "vary"] == -1.0 and top[1, "vary"] == 0.5 and top[0, "const"] == 1.0


def test_empty_vocabulary_is_refused(spark):
    with pytest.raises(ValueError):
        ft.fit_features(docs(spark, "a b", "b c"), ft.FeatureSpec(2, 0.5))


def test_text_stage_saves_and_loads(spark, tmp_path):
    stage = TextTerms.of(Analyzer(ngrams=(1, 2), stem="words", accents="ascii", stop_words=None))
    PipelineModel([stage]).write().overwrite().save(str(tmp_path / "p"))
    (loaded,) = PipelineModel.load(str(tmp_path / "p")).stages
    assert loaded.analyzer() == stage.analyzer()
    df = spark.createDataFrame([("Hopping céll",)], "text string")
    assert loaded.transform(df).first()["terms"] == ["hop", "cell", "hop cell"]


# --- metrics --------------------------------------------------------------------------


def confusion(spark, tp, fn, fp, tn):
    return spark.createDataFrame([(tp, fp, tn, fn)], "tp long, fp long, tn long, fn long")


@pytest.mark.parametrize(
    "counts, expected",
    [  # fixed values: published counts and their figures
        ((211, 10, 140, 280), {"precision": 0.601, "recall": 0.955, "f4": 0.923, "f1": 0.738}),
        ((1864, 2, 3027, 167), {"precision": 0.381108, "recall": 0.998928}),
        ((1489, 186, 1256, 1447), {"precision": 0.542441, "recall": 0.888955}),
        ((0, 5, 0, 9), {"precision": 0.0, "recall": 0.0, "f1": 0.0}),
    ],
)
def test_metrics(spark, counts, expected):
    row = evaluation.metrics(confusion(spark, *counts)).first()
    for name, value in expected.items():
        digits = len(str(value).split(".")[1])
        assert round(row[name], digits) == value


def test_confusion_counts_add_up_and_skip_missing_predictions(spark):
    df = ids(spark, 40, label="cast(doc_id % 3 = 0 AS int)", prediction="CASE WHEN doc_id < 30 THEN cast(doc_id % 2 AS int) END")
    row = evaluation.confusion_counts(df).first()
    assert sum(row) == 30
    matrix = evaluation.confusion_matrix(df.filter("prediction IS NOT NULL")).collect()
    assert [r["true_class"] for r in matrix] == ["yes", "no"]
    assert matrix[0]["pred_yes"] == row["tp"] and matrix[1]["pred_no"] == row["tn"]


def test_error_lists_keep_totals(spark):
    df = ids(spark, 20, label="0", prediction="1", abs_confidence="20.0 - doc_id")
    rows = evaluation.error_lists(df, "doc_id", 11).orderBy("position").collect()
    assert len(rows) == 11 and rows[0]["doc_id"] == 19 and rows[0]["n_total"] == 20


def test_scorer_factory():
    assert models.make_f_scorer(0).getMetricName() == "accuracy"
    assert models.make_f_scorer(4).getBeta() == 4.0


def test_reconciliation(spark):
    schema = "doc_id string, evaluated string, old_pred string, exp_type string"
    no = spark.createDataFrame([("both", "yes", "no", "a"), ("twice", "no", "no", "a"), ("twice", "no", "no", "b")], schema)
    yes = spark.createDataFrame([("twice", "no", "yes", "c"), ("old", "yes", "yes", "c")], schema)
    new = spark.createDataFrame([("both", "yes"), ("twice", "no"), ("new", "yes")], "doc_id string, new_pred string")
    merged = reconcile.merge_evaluations([no, yes], "doc_id", "exp_type")
    report = reconcile.reconcile(merged, new, "doc_id")
    rows = {r["doc_id"]: r for r in report.collect()}
    assert rows["twice"]["old_pred"] == "yes" and rows["old"]["new_pred"] == "none"
    assert rows["new"]["evaluated"] == "none" and rows["new"]["origin"] == "new only"
    factored = new.withColumn("factors", F.lit("age").cast("string"))
    odd = spark.createDataFrame([("both", None, "no", None), ("old", "yes", "yes", "c")], schema)
    kept = {r["doc_id"]: r for r in reconcile.reconcile(odd, factored, "doc_id").collect()}
    assert kept["both"]["exp_type"] is None and kept["both"]["evaluated"] is None
    assert (kept["old"]["factors"], kept["both"]["factors"], kept["new"]["exp_type"]) == ("", "age", "none")
    sides = {r["side"]: r for r in reconcile.reconcile_metrics(report).collect()}
    assert (sides["old"]["tp"], sides["old"]["fp"], sides["old"]["fn"]) == (1, 1, 1)
    assert (sides["new"]["tp"], sides["new"]["tn"], sides["new"]["fn"]) == (1, 1, 0)


# --- models ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    words = {1: "harbour lantern gravel oak", 0: "violin ticket marble cloud"}
    common = "paper river stone green letter"
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        label = int(i % 3 == 0)
        pool = (words[label] + " " + common).split()
        rows.append((i, " ".join(rng.choice(pool, 12)), label))
    return spark.createDataFrame(rows, "doc_id long, text string, label int").cache()


def test_closed_form_bayes_equals_the_library(spark, corpus):
    from pyspark.ml.classification import NaiveBayes

    terms = TextTerms().transform(corpus)
    model = bayes.fit_multinomial(terms, 1.0)
    ours = {r["doc_id"]: r for r in bayes.score(model, terms, ["doc_id"]).collect()}
    fitted = ft.fit_features(terms, ft.FeatureSpec(1, 1.0, None, "count", None))
    library = NaiveBayes(smoothing=1.0).fit(fitted.model.transform(terms))
    shift = library.pi[1] - library.pi[0] - (model.base_yes - model.base_no)
    for r in library.transform(fitted.model.transform(terms)).collect():
        gap = r["rawPrediction"][1] - r["rawPrediction"][0]
        assert math.isclose(gap, ours[r["doc_id"]]["confidence"] + shift, abs_tol=1e-9)


def test_linear_form_scores_like_bayes(spark, corpus):
    terms = TextTerms().transform(corpus)
    model = bayes.fit_multinomial(terms, 1.0)
    weights, intercept = bayes.linear_weights(model)
    values = ft.term_counts(terms, ["doc_id"]).withColumnRenamed("tf", "value")
    a = {r[0]: r[1] for r in linear.linear_score(values, weights, intercept, "doc_id").collect()}
    b = {r["doc_id"]: r["confidence"] for r in bayes.score(model, terms, ["doc_id"]).collect()}
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in b)


def test_compare_splits_equals_one_run_per_split(spark, corpus):
    terms = TextTerms().transform(corpus).select("doc_id", "label", "terms")
    together = {tuple(r) for r in bayes.compare_splits(terms, "doc_id", (1, 2), (1.0, 0.1), 0.25, 0.02, 0.9).select("doc_id", "seed", "alpha", "prediction").collect()}
    apart = set()
    for seed in (1, 2):
        split = sampling.split_exact(terms, "doc_id", 0.25, seed)
        for alpha in (1.0, 0.1):
            model = bayes.fit_multinomial(split.filter("split = 'train'"), alpha, 0.02, 0.9)
            for r in bayes.score(model, split.filter("split = 'test'"), ["doc_id"]).collect():
                apart.add((r["doc_id"], seed, alpha, r["prediction"]))
    assert together == apart


def _tuning(classifier, grid, **options):
    return tuning.TextTuning(classifier, grid, features=ft.FeatureSpec(1, 1.0), folds=3, seeds={"split": 1, "classifier": 2}, **options)


def test_shared_grid_equals_plain_cross_validation(spark, corpus):
    folded = sampling.stratified_folds(corpus, "doc_id", "label", 3, 1)
    run = _tuning(models.Logistic, {"C": [1e-3, 1.0]})
    shared = [mean for _, mean, _ in run.cross_validate(folded)]
    plain = []
    for C in (1e-3, 1.0):
        chain = Pipeline(stages=[models.TextFeatures(Analyzer(), ft.FeatureSpec(1, 1.0)), models.ClassBalance(), models.Logistic(C)])
        cv = CrossValidator(estimator=chain, estimatorParamMaps=ParamGridBuilder().build(), evaluator=models.make_f_scorer(4), numFolds=3, foldCol="fold")
        plain.append(cv.fit(folded.withColumn("label", F.col("label").cast("double"))).avgMetrics[0])
    assert np.allclose(shared, plain, atol=1e-6)


def test_tuning_run_reports(spark, corpus):
    result = _tuning(models.SupportVectors, [{"C": [1e-3]}, {"C": [1e-2], "max_df": [0.9]}]).fit(corpus)
    grid = result.grid_table().collect()
    assert len(grid) == 2 and sum(r["is_best"] for r in grid) == 1
    assert {r["split"] for r in result.metrics().collect()} == {"train", "test"}
    assert result.metrics().filter("split = 'test'").first()["f4"] > 0.9
    best = {r["term"] for r in result.top_features(3).filter("kind = 'positive'").collect()}
    assert best <= {"harbour", "lantern", "gravel", "oak"}
    text = result.render()
    assert "Best parameters" in text and "Top features" in text
    assert result.index_row("test", None)["split_seed"] == 1


def test_named_steps_drive_a_fit(spark, corpus):
    """A grid of step__parameter names gives what the bare names give, and its report shows the names that were given."""
    folded = sampling.stratified_folds(corpus, "doc_id", "label", 3, 1)
    named = _tuning(models.Logistic, {"vectorizer__min_df": [1, 3], "classifier__C": [1e-2], "scaler__scaler": [None]})
    bare = _tuning(models.Logistic, {"min_df": [1, 3], "C": [1e-2], "scaler": [None]})
    assert [m for _, m, _ in named.cross_validate(folded)] == [m for _, m, _ in bare.cross_validate(folded)]
    assert [c["vectorizer__min_df"] for c, _, _ in named.cross_validate(folded)] == [1, 3]
    fitted = named.refit(corpus, {"vectorizer__ngrams": (1, 2), "classifier__C": 1.0})
    assert any(" " in t for t in fitted.vocabulary)
    for name in ("nobody__C", "vectorizer__C", "classifier__min_df"):
        with pytest.raises(ValueError):
            tuning.step_parameter(name)


def test_grids():
    assert tuning.expand_grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert len(tuning.expand_grid([{"a": [1, 2]}, {"b": [3]}])) == 3
    seeds = tuning.random_seeds({"x": 5, "y": None})
    assert seeds["x"] == 5 and isinstance(seeds["y"], int)


@pytest.fixture(scope="module")
def vectors(spark, corpus):
    terms = TextTerms().transform(corpus)
    fitted = ft.fit_features(terms, ft.FeatureSpec(1, 1.0, None, "count", "maxabs"))
    df = ft.plain_columns(fitted.model.transform(terms)).select("doc_id", "label", "features")
    return models.ClassBalance().fit(df).transform(df).cache()


def _accuracy(scored):
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize("loss", ["hinge", "log", "modified_huber", "squared_hinge"])
@pytest.mark.parametrize("schedule, eta0", [("optimal", 0.0), ("invscaling", 0.5), ("constant", 0.1)])
def test_sgd_separates(vectors, loss, schedule, eta0):
    # The optimal schedule opens with long steps, which the squared loss takes longest to recover from.
    model = AveragedSGD(loss=loss, learning_rate=schedule, eta0=eta0, alpha=1e-3, seed=1, blocks=1, n_iter=30).fit(vectors)
    assert _accuracy(model.transform(vectors)) > 0.95


@pytest.mark.parametrize("penalty", ["l2", "elasticnet"])
def test_sgd_does_not_depend_on_partitions(vectors, penalty):
    fits = [AveragedSGD(penalty=penalty, seed=3, blocks=4).fit(vectors.repartition(n)) for n in (1, 4, 16)]
    for other in fits[1:]:
        assert np.allclose(other.getOrDefault("coefficients"), fits[0].getOrDefault("coefficients"), atol=1e-12)
        assert math.isclose(other.getOrDefault("intercept"), fits[0].getOrDefault("intercept"), abs_tol=1e-12)


def _slow_sgd(rows, blocks, size, loss, alpha, l1, l2, eta, epochs, seed):
    """Row by row: ``rows`` are (hash, order by epoch, features, stored places, sign, weight)."""
    slopes = {"hinge": lambda z: -1.0 if z <= 1 else 0.0, "log": lambda z: -1 / (1 + math.exp(z))}
    w, b = np.zeros(size), 0.0
    for epoch in range(epochs):
        total, total_b = np.zeros(size), 0.0
        for block in range(blocks):
            v, c, owed, paid, own = w.copy(), b, 0.0, np.zeros(size), [r for r in rows if r[0] % blocks == block]
            for _, _, x, seen, y, s in sorted(own, key=lambda r: (r[1][epoch], r[0])):
                step = -eta * s * y * slopes[loss](y * (v @ x + c))
                v = v * (1 - eta * l2) + step * x
                c += step
                owed += eta * l1
                if l1:
                    new = np.where(v > 0, np.maximum(0, v - owed - paid), np.minimum(0, v + owed - paid))
                    paid[seen] += (new - v)[seen]
                    v[seen] = new[seen]
            total += len(own) * (v - w)
            total_b += len(own) * (c - b)
        w, b = w + total / len(rows), b + total_b / len(rows)
    return w, b


@pytest.mark.parametrize("loss, penalty", [("hinge", "l2"), ("log", "elasticnet"), ("hinge", "l1")])
@pytest.mark.parametrize("blocks, lanes", [(1, 64), (7, 64), (7, 2)])
def test_sgd_equals_one_row_at_a_time(spark, monkeypatch, loss, penalty, blocks, lanes):
    from docsieve.operators import sgd

    monkeypatch.setattr(sgd, "LANES", lanes)
    rng = np.random.default_rng(blocks)
    x = np.round(rng.normal(size=(60, 6)) * (rng.random((60, 6)) < 0.5), 3)
    x[7] = 0
    label = (x.sum(axis=1) + rng.normal(size=60) > 0).astype(int)
    make = lambda i: Vectors.dense(x[i]) if i % 3 == 0 else Vectors.sparse(6, {j: float(v) for j, v in enumerate(x[i]) if v})
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    df = spark.createDataFrame([(make(i), int(label[i]), float(1 + i % 4)) for i in range(60)], schema)
    epochs, eta, alpha = 3, 0.05, 0.1
    vector = F.unwrap_udt("features")
    hashed = df.withColumn("row", F.xxhash64(vector["indices"], vector["values"], 2.0 * F.col("label") - 1.0, "weight"))
    hashed = hashed.withColumn("orders", F.array(*[F.xxhash64(F.lit(5 + e), "row") for e in range(epochs)]))
    rows = [(r["row"], r["orders"], r["features"].toArray(), (r["features"].toArray() != 0) | isinstance(r["features"], DenseVector), 2 * r["label"] - 1, r["weight"])
            for r in hashed.collect()]
    share = {"l2": (0, 1), "elasticnet": (0.15, 0.85), "l1": (1, 0)}[penalty]
    want, want_b = _slow_sgd(rows, blocks, 6, loss, alpha, share[0] * alpha, share[1] * alpha, eta, epochs, 5)
    model = AveragedSGD(loss, penalty, alpha, learning_rate="constant", eta0=eta, n_iter=epochs, seed=5, blocks=blocks).fit(df.repartition(3))
    assert np.allclose(model.getOrDefault("coefficients"), want, atol=1e-10)
    assert math.isclose(model.getOrDefault("intercept"), want_b, abs_tol=1e-10)


def test_sgd_blocks_grow_with_the_rows(spark, vectors):
    """Blocks follow the number of rows and come from more than one task."""
    run = AveragedSGD(seed=1, block_rows=4)
    fits = [run.fit(vectors.repartition(n)) for n in (1, 9)]
    assert np.allclose(*[m.getOrDefault("coefficients") for m in fits], atol=1e-12)
    assert _accuracy(fits[0].transform(vectors)) > 0.8


def test_tuner_seed_and_beta_zero(spark, corpus):
    run = _tuning(AveragedSGD, {"loss": ["hinge"]})
    run._seed = 41
    assert run._classifier({"loss": "hinge"}).seed == 41 and run._classifier({"loss": "hinge", "seed": 2}).seed == 2
    assert run._classifier({"loss": "hinge", "min_df": 1}).seed == 41
    run = _tuning(models.naive_bayes, {"kind": ["multinomial"]})
    run.beta, run.compare_beta = 0, 2.0
    result = run.fit(corpus)
    assert 0.5 < result.scores[0][1] <= 1.0
    assert result.index_row("s", None)["label"] == "PRF2,F1"


def test_sgd_penalties(vectors):
    def zeros(penalty):
        model = AveragedSGD(penalty=penalty, alpha=0.02, learning_rate="constant", eta0=0.1, n_iter=7, blocks=1).fit(vectors)
        return sum(w == 0 for w in model.getOrDefault("coefficients")), model

    plain, sparse = zeros(None)[0], zeros("l1")[0]
    assert sparse > plain
    start = zeros("elasticnet")[1]
    warm = AveragedSGD(warm_start=start, n_iter=1, learning_rate="constant", eta0=1e-6).fit(vectors)
    assert np.allclose(warm.getOrDefault("coefficients"), start.getOrDefault("coefficients"), atol=1e-3)


def test_sgd_reaches_the_logistic_objective(vectors):
    alpha = 0.01
    n = vectors.count()

    def objective(w, b):
        rows = vectors.collect()
        z = np.array([(2 * r["label"] - 1) * (r["features"].dot(w) + b) for r in rows])
        s = np.array([r["weight"] for r in rows])
        return float(np.mean(s * np.log1p(np.exp(-z))) + alpha / 2 * np.dot(w, w))

    exact = models.Logistic(1.0 / (alpha * n)).fit(vectors)
    best = objective(exact.coefficients.toArray(), exact.intercept)
    sgd = AveragedSGD(loss="log", alpha=alpha, n_iter=40, seed=1).fit(vectors)
    reached = objective(np.array(sgd.getOrDefault("coefficients")), sgd.getOrDefault("intercept"))
    assert reached < best * 1.15


def test_perceptron_and_tree_and_bayes(vectors):
    assert _accuracy(perceptron(n_iter=5).fit(vectors).transform(vectors)) > 0.9
    with pytest.raises(ValueError):
        models.decision_tree(31)
    tree = models.decision_tree(30).fit(vectors)
    assert models.with_confidence(tree.transform(vectors), tree).filter("confidence IS NOT NULL").count() == 0
    assert _accuracy(models.naive_bayes("multinomial").fit(vectors).transform(vectors)) > 0.95


def test_confidence_sign_and_adhoc_texts(spark, corpus):
    run = _tuning(models.SupportVectors, {"C": [1e-2]})
    fitted = run.refit(corpus, {"C": 1e-2})
    texts = spark.createDataFrame([(0, "harbour gravel"), (1, "marble ticket"), (2, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in models.with_confidence(fitted.model.transform(texts), fitted.model).collect()}
    assert rows[0]["confidence"] > 0 and rows[0]["prediction"] == 1
    assert rows[1]["confidence"] < 0 and rows[1]["prediction"] == 0
    assert rows[2]["confidence"] is not None


def test_weight_vector_model_saves(vectors, tmp_path):
    model = AveragedSGD(seed=1).fit(vectors)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = models.WeightVectorModel.load(str(tmp_path / "m"))
    assert loaded.transform(vectors).select("prediction").collect() == model.transform(vectors).select("prediction").collect()


def test_landmarks(vectors, tmp_path):
    fitted = SigmoidLandmarks("doc_id", 8, gamma=0.5, coef0=0.1).fit(vectors)
    rows = {r["doc_id"]: r for r in fitted.transform(vectors).collect()}
    chosen = sorted(r["doc_id"] for r in sampling.random_subset(vectors.select("doc_id"), "doc_id", 8, 0).collect())
    matrix = np.vstack([rows[i]["features"].toArray() for i in chosen])
    for row in rows.values():
        assert np.allclose(row["kernel"].toArray(), np.tanh(0.5 * matrix @ row["features"].toArray() + 0.1))
    fitted.write().save(str(tmp_path / "landmarks"))
    loaded = SigmoidLandmarksModel.load(str(tmp_path / "landmarks"))
    assert loaded.transform(vectors).collect() == fitted.transform(vectors).collect()


def test_landmarks_of_dense_and_empty_rows(spark):
    rows = [(0, Vectors.dense([1.0, 0.0, 2.0])), (1, Vectors.sparse(3, {})), (2, Vectors.sparse(3, {2: 3.0})), (3, Vectors.dense([0.0, 0.0, 0.0]))]
    df = spark.createDataFrame(rows, ["doc_id", "features"])
    out = {r["doc_id"]: r["kernel"].toArray() for r in SigmoidLandmarks("doc_id", 4, gamma=0.1).fit(df).transform(df).collect()}
    x = np.vstack([v.toArray() for _, v in rows])
    for i in range(4):
        assert np.allclose(out[i], np.tanh(0.1 * x @ x[i]))


def test_sigmoid_pipeline_can_be_saved(spark, corpus, tmp_path):
    chain = Pipeline(stages=[models.TextFeatures(Analyzer(), ft.FeatureSpec(1, 1.0)), models.ClassBalance(), sigmoid_support_vectors(0.1, landmarks=6)])
    fitted = chain.fit(corpus)
    fitted.write().save(str(tmp_path / "sigmoid"))
    loaded = PipelineModel.load(str(tmp_path / "sigmoid"))
    columns = ["doc_id", "prediction", "rawPrediction"]
    assert loaded.transform(corpus).select(*columns).collect() == fitted.transform(corpus).select(*columns).collect()


def test_gaussian_moments_count_zeros(spark):
    rows = [(0, 1, ["a", "a", "b"]), (1, 1, ["a"]), (2, 0, ["b"]), (3, 0, []), (4, 0, ["c", "c", "c"])]
    docs = spark.createDataFrame(rows, "doc_id long, label int, terms array<string>")
    model = bayes.fit_gaussian(docs, floor=0.01)
    x = np.array([[t.count(w) for w in "abc"] for _, _, t in rows], dtype=float)
    y = np.array([label for _, label, _ in rows])
    floor = 0.01 * x.var(axis=0).max()
    got = {r["term"]: r for r in model.table.collect()}
    want = np.zeros((5, 2))
    for c, name in ((0, "no"), (1, "yes")):
        mean, var = x[y == c].mean(axis=0), x[y == c].var(axis=0) + floor
        assert np.allclose([got[w][f"mean_{name}"] for w in "abc"], mean) and np.allclose([got[w][f"var_{name}"] for w in "abc"], var)
        want[:, c] = np.log((y == c).mean()) + (-0.5 * np.log(2 * np.pi * var) - (x - mean) ** 2 / (2 * var)).sum(axis=1)
    scored = {r["doc_id"]: (r["score_no"], r["score_yes"]) for r in bayes.score_gaussian(model, docs, ["doc_id"]).collect()}
    assert np.allclose([scored[i] for i in range(5)], want)
    one_class = bayes.fit_gaussian(docs.filter("label = 1"))
    assert {r["prediction"] for r in bayes.score_gaussian(one_class, docs, ["doc_id"]).collect()} == {1}


def test_pipeline_steps_by_name():
    chain = Pipeline(stages=[models.TextFeatures(), models.ClassBalance(), models.SupportVectors(1.0)])
    assert models.named_steps(chain, ("vectorizer", "balance", "classifier"))["classifier"].C == 1.0


def test_coefficients_join_the_vocabulary(spark):
    model = models.WeightVectorModel("features", [0.5, -0.25], 0.0)
    rows = linear.coefficient_table(
        models.coefficients(spark, model, ["a", "b"]).select("idx", "weight"),
        spark.createDataFrame([(0, "a"), (1, "b")], "idx long, term string"),
    )
    assert {tuple(r) for r in rows.collect()} == {("a", 0.5), ("b", -0.25)}
    lines = {r["line"] for r in linear.signed_text(rows).collect()}
    assert lines == {"+0.5000\ta", "-0.2500\tb"}
    scored = model.transform(spark.createDataFrame([(Vectors.sparse(2, {0: 2.0}),)], ["features"])).first()
    assert scored["prediction"] == 1.0 and list(scored["rawPrediction"]) == [-1.0, 1.0]
