"""The one-pass grid against a model fitted for each fold, and full-batch steps against numpy."""

import math
import random

import numpy as np
import pytest

from docsieve.operators import bayes, descent, evaluation, grid
from docsieve.plans import search
from docsieve.session import materialize

FOLDS = 3


@pytest.fixture(scope="module")
def folded(spark):
    """Documents whose words hint at their class, with folds and test rows."""
    rng, rows = random.Random(9), []
    for i in range(140):
        label = int(rng.random() < 0.35)
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 12))] + ["good" if label else "bad"] * (rng.random() < 0.4)
        rows.append((i, label, sorted(words)))
    docs = spark.createDataFrame(rows, "doc_id long, label int, terms array<string>")
    folds = grid.fold_table(docs.select("doc_id", "label"), "doc_id", "label", FOLDS, 0.2, 3)
    return materialize(docs.drop("label").join(folds, "doc_id"), "folded")


def test_fold_table_deals_by_class(folded):
    counts = {(r["fold"], r["label"]): r["count"] for r in folded.groupBy("fold", "label").count().collect()}
    assert sum(n for (f, _), n in counts.items() if f == FOLDS) == math.ceil(0.2 * 140)
    for label in (0, 1):
        sizes = [counts[f, label] for f in range(FOLDS)]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("fold", range(FOLDS + 1))
def test_grid_equals_a_fit_per_fold(folded, fold):
    points = grid.points({"alpha": (1.0, 0.1), "min_df": (2, 0.1), "max_df": (0.9,), "balanced": (False, True)})
    predicted = grid.predict_folds(folded, "doc_id", points, FOLDS, grid.count_folds(folded, points, FOLDS))
    got = {r["doc_id"]: [r[f"p_{i}"] for i in range(len(points))] for r in predicted.filter(f"fold = {fold}").collect()}
    train, valid = folded.filter(f"fold < {FOLDS} AND fold <> {fold}"), folded.filter(f"fold = {fold}")
    for i, p in enumerate(points):
        model = bayes.fit_multinomial(train, p.alpha, p.min_df, p.max_df)
        if p.balanced:
            model = bayes.BayesModel(model.weights, 0.0, 0.0, False)
        want = {r["doc_id"]: r["prediction"] for r in bayes.score(model, valid, ["doc_id"]).collect()}
        assert {d: v[i] for d, v in got.items()} == want


def test_grid_chooses_the_best_mean_and_tests_it(folded):
    points = grid.points({"alpha": (1.0, 0.5, 0.01), "min_df": (1, 3), "max_df": (1.0,)})
    rows = sorted(grid.search(folded, "doc_id", points, FOLDS).collect(), key=lambda r: r["candidate"])
    best = max(rows, key=lambda r: (round(r["mean_score"], 9), -r["candidate"]))
    assert [r["candidate"] for r in rows if r["is_best"]] == [best["candidate"]]
    assert all(r["min_score"] <= r["mean_score"] <= r["max_score"] for r in rows)
    p = points[best["candidate"]]
    model = bayes.fit_multinomial(folded.filter(f"fold < {FOLDS}"), p.alpha, p.min_df, p.max_df)
    scored = bayes.score(model, folded.filter(f"fold = {FOLDS}"), ["doc_id", "label"])
    want = evaluation.metrics(evaluation.confusion_counts(scored), (1, 4)).first()
    for name in ("precision", "recall", "f1", "f4"):
        assert best[f"test_{name}"] == pytest.approx(want[name])
    assert all(r["test_f4"] is None for r in rows if not r["is_best"])


def test_grid_of_odd_tables(spark, folded):
    points = [grid.Point(), grid.Point(0.1, 1, 1.0, True)]
    assert grid.search(folded.filter("false"), "doc_id", points, FOLDS).count() == 0
    one_class = folded.withColumn("label", folded["label"] * 0)
    assert {r["mean_score"] for r in grid.search(one_class, "doc_id", points, FOLDS).collect()} == {0.0}


SLOPES = {
    "hinge": lambda z: -(z < 1).astype(float), "squared_hinge": lambda z: np.where(z < 1, -2 * (1 - z), 0.0),
    "log": lambda z: -1 / (1 + np.exp(z)), "modified_huber": lambda z: np.where(z >= 1, 0.0, np.where(z >= -1, -2 * (1 - z), -4.0)),
}


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 7)) * (rng.random((60, 7)) < 0.6)
    x[3] = 0  # a row without features
    y = (x @ np.array([1.0, -2, 0.5, 0, 0, 1, 0]) + rng.normal(size=60) * 0.3 > 0).astype(int)
    s = rng.random(60) + 0.5
    values = spark.createDataFrame([(i, f"t{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], "key long, term string, value double")
    rows = spark.createDataFrame([(i, int(y[i]), float(s[i]), float(s[i]) if i % 4 else None) for i in range(60)], "key long, label int, s double, part double")
    return values, rows, x, y, s


def slow_steps(x, y, s, spec, size, steps):
    x, sign, w = np.hstack([x, np.ones((len(x), 1))]), 2.0 * y - 1, np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        pull = x.T @ (s * sign * SLOPES[spec.loss](sign * (x @ w)))
        w = w - size * (np.append(w[:-1], 0.0) + spec.C * pull)
    return w


def test_steps_equal_numpy(features):
    values, rows, x, y, s = features
    specs = [descent.Spec(loss, loss, C=0.3, weight="s", step=0.01) for loss in SLOPES]
    specs += [descent.Spec("part", "log", C=2.0, weight="part", step=0.02), descent.Spec("plain", "squared_hinge", C=0.1)]
    got = {(r["model"], r["term"]): r["weight"] for r in descent.fit(values, rows, "key", specs, 6).collect()}
    part = np.where(np.arange(60) % 4, s, 0.0)
    auto = 1 / (1 + 0.1 * 2.0 * ((x**2).sum() + 60))
    for spec in specs:
        own = {"part": part, "plain": np.ones(60)}.get(spec.name, s)
        want = slow_steps(x, y, own, spec, auto if spec.step is None else spec.step, 6)
        names = [*[f"t{j}" for j in range(7)], descent.INTERCEPT]
        assert np.allclose([got[spec.name, t] for t in names], want, atol=1e-12)


def test_margins_and_falling_loss(features):
    values, rows, x, y, _ = features
    spec = descent.Spec("log", "log", C=1.0)
    losses = []
    for steps in (1, 10, 40):
        weights = descent.fit_wide(values, rows, "key", [spec], steps)
        w = {r["term"]: r["w_0"] for r in weights.collect()}
        scored = {r["key"]: r["m_0"] for r in descent.margins(values, rows, "key", weights).collect()}
        vector = np.array([w[f"t{j}"] for j in range(7)])
        assert np.allclose([scored[i] for i in range(60)], x @ vector + w[descent.INTERCEPT])
        z = (2 * y - 1) * np.array([scored[i] for i in range(60)])
        losses.append(vector @ vector / 2 + np.log1p(np.exp(-z)).sum())
    assert losses[0] > losses[1] > losses[2]


def test_steps_do_not_depend_on_partitions(features):
    values, rows, *_ = features
    fits = []
    for n in (1, 5):
        found = descent.fit(values.repartition(n), rows.repartition(n), "key", [descent.Spec("m", "hinge", C=0.3, step=0.01)], 4)
        fits.append({r["term"]: round(r["weight"], 12) for r in found.collect()})
    assert fits[0] == fits[1]


def test_no_text_moves_in_a_grid(spark, small):
    """Texts meet the folds in a broadcast join and are counted in their rows: no exchange has a text or a term array."""
    docs = search._folded(spark, small)
    points = grid.points(search.GRID)
    plan = grid.predict_folds(docs, "doc_id", points, search.FOLDS, grid.count_folds(docs, points, search.FOLDS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    assert moved and not any("text" in line or "terms" in line for line in moved)
