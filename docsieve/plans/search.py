"""Grid search and full-batch linear models, checkable in SQL end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve import jobs
from docsieve.config import Settings
from docsieve.functions.documents import class_name
from docsieve.operators import descent, grid, models
from docsieve.operators import features as ft
from docsieve.operators.analyzer import Analyzer
from docsieve.operators.features import FeatureSpec
from docsieve.operators.tuning import TextTuning
from docsieve.plans import mapping as m
from docsieve.plans.model import MAX_DF, MIN_DF
from docsieve.plans.sampling import FRACTION, SPLIT_SEED, sql_order, sql_split
from docsieve.plans.text import sql_counts, sql_tokens
from docsieve.session import materialize, shared_dir, spread
from docsieve.sources import sinks
from docsieve.sources.corpus import write_corpus
from docsieve.sources.tables import read_table

WORDS = Analyzer()
# Fixed values of these queries.
FOLDS, BETA = 5, 4.0
GRID = {"alpha": (1.0, 0.1, 0.01), "min_df": (0.01, 0.02), "balanced": (False, True), "max_df": (0.8,)}
STEPS = 5
MODELS = (
    descent.Spec("hinge", "hinge", C=0.5, weight="weight", step=0.004),
    descent.Spec("log", "log", C=1.0, weight="weight", step=0.004),
    descent.Spec("squared_hinge", "squared_hinge", C=0.2, weight=None, step=0.004),
    descent.Spec("modified_huber", "modified_huber", C=0.2, weight="weight", step=0.004),
)
COSTS = tuple(10.0 ** (n / 2) for n in range(-8, 4))
GRID_STEPS = 4
JOB_MIN_DF = (0.01, 0.03)


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with the rare class as positive."""
    return read_table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))


def _folded(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label, fold, terms) of the labelled documents."""
    folds = grid.fold_table(_labels(spark, folder), "doc_id", "label", FOLDS, FRACTION, SPLIT_SEED)
    docs = m.documents(spark, folder).select("doc_id", "text")
    return WORDS.terms(spread(docs.join(folds, "doc_id"), "doc_id")).drop("text")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def grid_search_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve points by five folds by F4, arg-max, refit and test metrics: one aggregate and one scoring join."""
    found = grid.search(_folded(spark, folder), "doc_id", grid.points(GRID), FOLDS, BETA)
    return _rounded(found, *[c for c in found.columns if c.endswith("_score") or c.startswith("test_")])


def grid_fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every point in every fold, and of its refit on the test rows (the last fold)."""
    docs, wanted = _folded(spark, folder), grid.points(GRID)
    predicted = grid.predict_folds(docs, "doc_id", wanted, FOLDS, grid.count_folds(docs, wanted, FOLDS))
    scored = grid.fold_metrics(predicted, wanted, BETA)
    return _rounded(scored.select("candidate", "fold", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "f4"), "precision", "recall", "f1", "f4")


def _values(docs: DataFrame, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """Unit-length tf-idf rows (doc_id, term, value) of documents with their training rows counted, and the rows."""
    counts = materialize(ft.term_counts(docs, ["doc_id", "in_train"]), "counts")
    df = counts.filter("in_train").groupBy("term").agg(F.count("*").alias("df"))
    kept = materialize(ft.prune(df, n_docs, MIN_DF, MAX_DF), "kept")
    weighed = ft.weigh(counts, kept, n_docs)
    return ft.l2_norm(weighed.select("doc_id", "term", "value"), "doc_id"), docs


def _training(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """Long features, rows (doc_id, label, fold, weight) and the number of training rows; weights balance the classes."""
    docs = materialize(_folded(spark, folder).withColumn("in_train", F.col("fold") < FOLDS), "folded")
    train = docs.filter("in_train")
    n = train.count()
    values, _ = _values(docs, n)
    balance = ft.class_weights(train.select("label")).select("label", "weight")
    rows = docs.select("doc_id", "label", "fold").join(F.broadcast(balance), "label")  # one row per class
    return materialize(values, "values"), rows, n


def descent_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of linear models with four losses after five full-batch steps on the training rows."""
    values, rows, _ = _training(spark, folder)
    train = rows.filter(F.col("fold") < FOLDS)
    return _rounded(descent.fit(values.join(train.select("doc_id"), "doc_id", "left_semi"), train, "doc_id", MODELS, STEPS), "weight")


def descent_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Margins and predictions of the same models on the test rows."""
    values, rows, _ = _training(spark, folder)
    train, test = rows.filter(F.col("fold") < FOLDS), rows.filter(F.col("fold") == FOLDS)
    weights = descent.fit_wide(values.join(train.select("doc_id"), "doc_id", "left_semi"), train, "doc_id", MODELS, STEPS)
    scored = descent.margins(values, test, "doc_id", weights)
    models = F.array(*[F.struct(F.lit(s.name).alias("model"), F.col(f"m_{i}").alias("confidence")) for i, s in enumerate(MODELS)])
    long = scored.select("doc_id", "label", F.inline(models))
    return long.select("doc_id", "label", "model", F.round("confidence", 6).alias("confidence"), (F.col("confidence") > 0).cast("int").alias("prediction"))


def descent_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve costs by five folds of the log loss: sixty models and twelve refits as columns of the same steps."""
    values, rows, _ = _training(spark, folder)
    # A row weighs in a fold's model if it is a training row outside of that fold.
    rows = materialize(rows.withColumns({
        f"fold_{f}": F.when((F.col("fold") < FOLDS) & (F.col("fold") != f), F.col("weight")) for f in range(FOLDS + 1)
    }), "rows")
    specs = [descent.Spec(f"{c}|{f}", "log", C=cost, weight=f"fold_{f}") for c, cost in enumerate(COSTS) for f in range(FOLDS + 1)]
    weights = descent.fit_wide(values, rows, "doc_id", specs, GRID_STEPS)
    scored = descent.margins(values, rows, "doc_id", weights)
    own = [F.get(F.array(*[F.col(f"m_{c * (FOLDS + 1) + f}") for f in range(FOLDS + 1)]), F.col("fold")) for c in range(len(COSTS))]
    predicted = scored.select("label", "fold", *[(x > 0).cast("int").alias(f"p_{c}") for c, x in enumerate(own)])
    table = grid.grid_table(grid.fold_metrics(predicted, COSTS, BETA), FOLDS, BETA)
    cost = F.get(F.array(*[F.lit(c) for c in COSTS]), F.col("candidate"))
    return _rounded(table.select("candidate", F.round(cost, 9).alias("cost"), *table.columns[1:]), *[
        c for c in table.columns if c.endswith("_score") or c.startswith("test_")
    ])


def tuning_job(spark: SparkSession, folder: str) -> DataFrame:
    """The tuning job on a prepared corpus, read back: outcomes by split from the prediction tables, scores from the run index."""
    place = f"{shared_dir(spark)}/tuning-{uuid.uuid4().hex}"
    texts = m.documents(spark, folder).select("doc_id", "text").join(_labels(spark, folder), "doc_id")
    write_corpus(texts.select(F.col("doc_id").cast("string").alias("id"), class_name(F.col("label")).alias("class_name"), "text"), f"{place}/corpus")
    run = TextTuning(
        models.naive_bayes, {"kind": ["multinomial"], "min_df": list(JOB_MIN_DF)}, analyzer=WORDS,
        features=FeatureSpec(MIN_DF, MAX_DF, None, "count", None), balanced=False, seeds={"split": SPLIT_SEED, "classifier": 1},
    )
    jobs.tune(spark, f"{place}/corpus", place, run, Settings(folds=FOLDS, test_fraction=FRACTION), "job", "tuning_job")
    runs = sinks.read_runs(spark, f"{place}/{Settings().index_table}").select(
        "run_id", F.element_at("params", "min_df").alias("min_df"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "f4")]
    )
    tags = spark.read.parquet(f"{place}/{Settings().prediction_prefix}-job")
    counted = tags.groupBy("split").agg(*[F.count_if(F.col("tag") == t).alias(t.lower()) for t in ("TP", "FP", "TN", "FN")])
    return counted.withColumn("run_id", F.lit("job")).join(F.broadcast(runs), "run_id")  # one row per run


QUERIES = {f.__name__: f for f in (grid_search_bayes, grid_fold_scores, descent_weights, descent_scores, descent_grid, tuning_job)}

# In SQL every point, fold and model is a row of its own.
_LAB = f"""
pick AS (SELECT doc_id, 1 - quality AS label, {sql_split('labels', SPLIT_SEED)} AS split FROM labels),
dealt AS (
  SELECT doc_id, label, CASE WHEN split = 'test' THEN {FOLDS} ELSE
         (row_number() OVER (PARTITION BY split, label ORDER BY {sql_order(SPLIT_SEED)}) - 1) % {FOLDS} END AS fold
  FROM pick),
lab AS (SELECT doc_id, text, label, CAST(fold AS INTEGER) AS fold FROM documents JOIN dealt USING (doc_id)),
{sql_tokens('lab', 'doc_id, label, fold')}, {sql_counts('doc_id, label, fold')}"""
def _points(points: list[grid.Point]) -> str:
    return ", ".join(f"({i}, {p.alpha}, {p.min_df}, {p.max_df}, {str(p.balanced).lower()})" for i, p in enumerate(points))


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif(({whole})::DOUBLE, 0), 0)"


def _f(beta: float) -> str:
    return _ratio(f"(1 + {beta * beta}::DOUBLE) * precision * recall", f"{beta * beta}::DOUBLE * precision + recall")


_METRICS = f"""
cells AS (
  SELECT candidate, fold, count(*) FILTER (label = 1 AND hit) AS tp, count(*) FILTER (label = 0 AND hit) AS fp,
         count(*) FILTER (label = 0 AND NOT hit) AS tn, count(*) FILTER (label = 1 AND NOT hit) AS fn
  FROM judged GROUP BY candidate, fold),
parts AS (SELECT *, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall FROM cells),
scored AS (SELECT *, {_f(1.0)} AS f1, {_f(BETA)} AS f4 FROM parts),
means AS (
  SELECT candidate, avg(f4) AS mean_score, min(f4) AS min_score, max(f4) AS max_score
  FROM scored WHERE fold < {FOLDS} GROUP BY candidate),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(mean_score, {grid.SCORE_DIGITS}) DESC, candidate) = 1 AS is_best FROM means)"""
_TABLE = """
       round(mean_score, 6) AS mean_score, round(min_score, 6) AS min_score, round(max_score, 6) AS max_score, is_best,
       CASE WHEN is_best THEN round(precision, 6) END AS test_precision, CASE WHEN is_best THEN round(recall, 6) END AS test_recall,
       CASE WHEN is_best THEN round(f1, 6) END AS test_f1, CASE WHEN is_best THEN round(f4, 6) END AS test_f4"""


def _sql_bayes(points: list[grid.Point], prior: int = 0) -> str:
    """CTEs up to scored and ranked; ``prior`` is added to the class sizes that the prior is made of."""
    return f"""WITH {_LAB},
point(candidate, alpha, min_df, max_df, balanced) AS (VALUES {_points(points)}),
size AS (
  SELECT r.f, count(*) AS n, count(*) FILTER (label = 0) AS d_no, count(*) FILTER (label = 1) AS d_yes
  FROM dealt JOIN (SELECT unnest(range({FOLDS + 1})) AS f) r ON fold <> r.f AND fold < {FOLDS} GROUP BY r.f),
seen AS (
  SELECT r.f, term, count(*) AS df, coalesce(sum(tf) FILTER (label = 0), 0)::DOUBLE AS n_no, coalesce(sum(tf) FILTER (label = 1), 0)::DOUBLE AS n_yes
  FROM cnt JOIN (SELECT unnest(range({FOLDS + 1})) AS f) r ON fold <> r.f AND fold < {FOLDS} GROUP BY r.f, term),
kept AS (
  SELECT candidate, alpha, f, term, n_no, n_yes FROM seen JOIN size USING (f) CROSS JOIN point
  WHERE df >= min_df::DOUBLE * n AND df <= max_df::DOUBLE * n),
whole AS (SELECT candidate, f, sum(n_no) AS t_no, sum(n_yes) AS t_yes, count(*) AS v FROM kept GROUP BY candidate, f),
odds AS (
  SELECT candidate, f, term, ln((n_yes + alpha) / (t_yes + alpha * v)) - ln((n_no + alpha) / (t_no + alpha * v)) AS w
  FROM kept JOIN whole USING (candidate, f)),
total AS (
  SELECT candidate, doc_id, sum(tf * w) AS s FROM cnt JOIN odds ON odds.term = cnt.term AND odds.f = cnt.fold GROUP BY candidate, doc_id),
judged AS (
  SELECT p.candidate, d.fold, d.label,
         coalesce(s, 0) > CASE WHEN balanced THEN 0 ELSE ln(d_no::DOUBLE + {prior}) - ln(d_yes::DOUBLE + {prior}) END AS hit
  FROM dealt d CROSS JOIN point p JOIN size ON size.f = d.fold LEFT JOIN total t ON t.candidate = p.candidate AND t.doc_id = d.doc_id),
{_METRICS}"""


_BAYES = _sql_bayes(grid.points(GRID))
_JOB = _sql_bayes([grid.Point(1.0, x, MAX_DF) for x in JOB_MIN_DF], 1)
_N = f"(SELECT count(*) FROM dealt WHERE fold < {FOLDS})"
_VALUES = f"""{_LAB},
freq AS (
  SELECT term, count(*) AS df FROM cnt WHERE fold < {FOLDS} GROUP BY term
  HAVING count(*) >= {MIN_DF}::DOUBLE * {_N} AND count(*) <= {MAX_DF}::DOUBLE * {_N}),
raw AS (SELECT doc_id, term, tf * (ln((1.0 + {_N}) / (1.0 + df)) + 1.0) AS value FROM cnt JOIN freq USING (term)),
x AS MATERIALIZED (
  SELECT doc_id, term, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM raw
  UNION ALL SELECT doc_id, '{descent.INTERCEPT}', 1.0 FROM dealt),
balance AS (SELECT label, {_N}::DOUBLE / (2 * count(*)) AS weight FROM dealt WHERE fold < {FOLDS} GROUP BY label),
doc AS MATERIALIZED (SELECT doc_id, label, 2 * label - 1 AS y, fold, weight FROM dealt JOIN balance USING (label))"""
_SQL_SLOPES = {
    "hinge": "CASE WHEN z < 1 THEN -1.0 ELSE 0 END", "squared_hinge": "CASE WHEN z < 1 THEN -2 * (1 - z) ELSE 0 END",
    "log": "-1 / (1 + exp(z))", "modified_huber": "CASE WHEN z >= 1 THEN 0 WHEN z >= -1 THEN -2 * (1 - z) ELSE -4 END",
}
_SLOPE = "CASE loss " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SQL_SLOPES.items()) + " END"


def _sql_descent(steps: int) -> str:
    """CTEs w0, w1, ... of (model, term, w) from x, run(model, loss, cost, size) and use(model, doc_id, y, s)."""
    ctes = ["w0 AS (SELECT model, term, 0.0::DOUBLE AS w FROM run CROSS JOIN (SELECT DISTINCT term FROM x))"]
    for i in range(steps):
        ctes.append(f"""
z{i} AS (
  SELECT model, doc_id, any_value(y) AS y, any_value(s) AS s, any_value(y) * sum(value * w) AS z
  FROM use JOIN x USING (doc_id) JOIN w{i} USING (model, term) GROUP BY model, doc_id),
g{i} AS (
  SELECT model, term, sum(value * s * y * {_SLOPE}) AS g FROM z{i} JOIN run USING (model) JOIN x USING (doc_id) GROUP BY model, term),
w{i + 1} AS MATERIALIZED (
  SELECT model, term, w - size * (CASE WHEN term = '{descent.INTERCEPT}' THEN 0 ELSE w END + cost * g) AS w
  FROM w{i} JOIN g{i} USING (model, term) JOIN run USING (model))""")
    return ",\n".join(ctes)


_RUNS = ", ".join(f"('{s.name}', '{s.loss}', {s.C}, {s.step}, {str(s.weight is not None).lower()})" for s in MODELS)
_MODELS = f"""WITH {_VALUES},
run(model, loss, cost, size, weighted) AS (VALUES {_RUNS}),
use AS (SELECT model, doc_id, y, CASE WHEN weighted THEN weight ELSE 1 END AS s FROM doc CROSS JOIN run WHERE fold < {FOLDS}),
{_sql_descent(STEPS)}"""
_COSTS = ", ".join(f"({c}, {cost!r})" for c, cost in enumerate(COSTS))

SQL = {
    "grid_search_bayes": f"""{_BAYES}
        SELECT r.candidate, alpha::DOUBLE AS alpha, min_df::DOUBLE AS min_df, max_df::DOUBLE AS max_df, balanced, {_TABLE}
        FROM ranked r JOIN scored t ON t.candidate = r.candidate AND t.fold = {FOLDS} JOIN point p ON p.candidate = r.candidate""",
    "grid_fold_scores": f"""{_BAYES}
        SELECT candidate, fold, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               round(f4, 6) AS f4 FROM scored""",
    "tuning_job": f"""{_JOB},
        chosen AS (SELECT candidate, p.min_df FROM ranked JOIN point p USING (candidate) WHERE is_best),
        fitted AS (SELECT term, w FROM odds JOIN chosen USING (candidate) WHERE f = {FOLDS}),
        sums AS (SELECT doc_id, sum(tf * w) AS s FROM cnt JOIN fitted USING (term) GROUP BY doc_id),
        outcome AS (
          SELECT CASE WHEN fold = {FOLDS} THEN 'test' ELSE 'train' END AS split, label,
                 coalesce(s, 0) > (SELECT ln(d_no::DOUBLE + 1) - ln(d_yes::DOUBLE + 1) FROM size WHERE f = {FOLDS}) AS hit
          FROM dealt LEFT JOIN sums USING (doc_id))
        SELECT 'job' AS run_id, split, count(*) FILTER (label = 1 AND hit) AS tp, count(*) FILTER (label = 0 AND hit) AS fp,
               count(*) FILTER (label = 0 AND NOT hit) AS tn, count(*) FILTER (label = 1 AND NOT hit) AS fn,
               any_value(CAST(min_df AS VARCHAR)) AS min_df, any_value(round(precision, 6)) AS precision,
               any_value(round(recall, 6)) AS recall, any_value(round(f1, 6)) AS f1, any_value(round(f4, 6)) AS f4
        FROM outcome CROSS JOIN chosen JOIN scored t ON t.candidate = chosen.candidate AND t.fold = {FOLDS} GROUP BY split""",
    "descent_weights": f"{_MODELS} SELECT model, term, round(w, 6) AS weight FROM w{STEPS}",
    "descent_scores": f"""{_MODELS}
        SELECT doc_id, label, model, round(sum(value * w), 6) AS confidence, CAST(sum(value * w) > 0 AS INTEGER) AS prediction
        FROM doc JOIN x USING (doc_id) JOIN w{STEPS} USING (term) WHERE fold = {FOLDS} GROUP BY doc_id, label, model""",
    "descent_grid": f"""WITH {_VALUES},
        cost(candidate, cost) AS (VALUES {_COSTS}),
        used AS (
          SELECT candidate, f, doc_id, y, label, fold, CASE WHEN fold < {FOLDS} AND fold <> f THEN weight ELSE 0 END AS s
          FROM doc CROSS JOIN cost CROSS JOIN (SELECT unnest(range({FOLDS + 1})) AS f)),
        use AS (SELECT candidate * {FOLDS + 1} + f AS model, doc_id, y, s FROM used),
        run AS (
          SELECT candidate * {FOLDS + 1} + f AS model, 'log' AS loss, any_value(cost) AS cost,
                 1 / (1 + any_value(cost) * {descent.CURVATURE['log']} * sum(s * square)) AS size
          FROM used JOIN (SELECT doc_id, sum(value * value) AS square FROM x GROUP BY doc_id) USING (doc_id) JOIN cost USING (candidate)
          GROUP BY candidate, f),
        {_sql_descent(GRID_STEPS)},
        judged AS (
          SELECT candidate, fold, label, sum(value * w) > 0 AS hit
          FROM used u JOIN x USING (doc_id) JOIN w{GRID_STEPS} v ON v.term = x.term AND v.model = u.candidate * {FOLDS + 1} + u.f
          WHERE u.fold = u.f GROUP BY candidate, fold, label, doc_id),
        {_METRICS}
        SELECT r.candidate, round(cost::DOUBLE, 9) AS cost, {_TABLE}
        FROM ranked r JOIN scored t ON t.candidate = r.candidate AND t.fold = {FOLDS} JOIN cost c ON c.candidate = r.candidate""",
}
