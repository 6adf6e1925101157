"""Train, score and evaluate queries on a closed-form model, checkable in SQL end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.documents import class_name
from docsieve.operators import bayes, curation, evaluation, linear, reconcile
from docsieve.operators import features as ft
from docsieve.operators import sampling as sp
from docsieve.operators.analyzer import Analyzer
from docsieve.operators.ranking import ordered_index
from docsieve.plans import mapping as m
from docsieve.plans.sampling import BALANCE_SEED, FRACTION, SPLIT_SEED, SQL_RARE, sql_split
from docsieve.plans.text import sql_counts, sql_tokens
from docsieve.session import materialize, spread
from docsieve.sources import sinks
from docsieve.sources.tables import read_table

WORDS = Analyzer()
# Fixed values of these queries.
MIN_DF, MAX_DF, ALPHA, OTHER_ALPHA = 0.01, 0.8, 1.0, 0.1
SEEDS, ALPHAS = tuple(range(101, 111)), (1.0, 0.1)
OLD_SEED, NEW_SEED = 11, 12
TOP, LISTED, ERRORS = 20, 50, 5
# Smaller variances make scores that no two engines round alike.
GAUSS_FLOOR = 1e-3
BETAS = (1, 2, 3, 4)


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with their terms and split."""
    docs = sp.split_exact(m.labelled_documents(spark, folder), "doc_id", FRACTION, SPLIT_SEED)
    return WORDS.terms(docs).drop("text")


def _model(docs: DataFrame, alpha: float = ALPHA, binary: bool = False) -> bayes.BayesModel:
    fit = bayes.fit_bernoulli if binary else bayes.fit_multinomial
    return fit(docs, alpha, MIN_DF, MAX_DF)


def _train(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("split") == sp.TRAIN)


def _scored(spark: SparkSession, folder: str, binary: bool = False) -> DataFrame:
    docs = _labelled(spark, folder)
    return bayes.score(_model(_train(docs), binary=binary), docs, ["doc_id", "label", "split"])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _with_abs(df: DataFrame) -> DataFrame:
    return df.withColumn("abs_confidence", F.round(F.abs("confidence"), 6))


def nb_multinomial_params(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_model(_train(_labelled(spark, folder))).weights, "w_no", "w_yes")


def nb_multinomial_predict(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_scored(spark, folder), "score_no", "score_yes", "confidence")


def nb_bernoulli_predict(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_scored(spark, folder, binary=True), "score_no", "score_yes", "confidence")


def _gaussian(spark: SparkSession, folder: str) -> tuple[DataFrame, bayes.GaussianModel]:
    docs = _labelled(spark, folder)
    return docs, bayes.fit_gaussian(_train(docs), MIN_DF, MAX_DF, GAUSS_FLOOR)


def nb_gaussian_params(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and variance of every kept term in each class, absent terms counting as zero."""
    table = _gaussian(spark, folder)[1].table
    return _rounded(table, "mean_no", "mean_yes", "var_no", "var_yes")


def nb_gaussian_predict(spark: SparkSession, folder: str) -> DataFrame:
    docs, model = _gaussian(spark, folder)
    scored = bayes.score_gaussian(model, docs, ["doc_id", "label", "split"])
    return scored.withColumns({n: F.round(n, 4) for n in ("score_no", "score_yes", "confidence")})


def positional_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights as one array in vocabulary order, told apart by position again: (idx, term, weight)."""
    weights, _ = bayes.linear_weights(_model(_train(_labelled(spark, folder))))
    vectors = linear.weight_vector(weights)
    vocabulary = ordered_index(weights.select("term"), "term")
    joined = linear.by_position(vectors, "weights", vocabulary)
    return _rounded(joined, "weight")


def linear_score(spark: SparkSession, folder: str) -> DataFrame:
    """The model as one weight per term, applied to the counts of every document."""
    docs = _labelled(spark, folder)
    weights, intercept = bayes.linear_weights(_model(_train(docs)))
    plain = m.documents(spark, folder).select("doc_id", "text")
    every = WORDS.terms(spread(plain, "doc_id"))
    values = ft.term_counts(every, ["doc_id"], keep_empty=True).withColumnRenamed("tf", "value")
    return _rounded(linear.linear_score(values, weights, intercept, "doc_id"), "confidence")


def _records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Prepared training records with label, and prepared candidates."""
    tables = m.curation_tables(spark, folder)

    def prepared(extract: DataFrame) -> DataFrame:
        return curation.kept(curation.prepare(extract, m.SETTINGS))

    training = prepared(curation.training_extract(tables, m.KEYS))
    label = (F.col("eval_state") == "Yes").cast("int")
    return training.withColumn("label", label), prepared(curation.candidate_extract(tables, m.KEYS))


def _candidate_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    training, candidates = _records(spark, folder)
    # Extraction is several joins; both passes of the model read its written result.
    training = materialize(training.select("exp_id", "label", "document"), "training")
    candidates = materialize(candidates, "candidates")
    model = _model(WORDS.terms(spread(training, "exp_id"), "document"))
    waiting = spread(candidates.select("exp_id", "document"), "exp_id")
    scored = bayes.score(model, WORDS.terms(waiting, "document"), ["exp_id"])
    return scored.withColumnRenamed("exp_id", "id"), candidates.withColumnRenamed("exp_id", "id")


def prediction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Extract, prepare, train, score the candidates, format: the short prediction file."""
    return sinks.prediction_rows(_candidate_scores(spark, folder)[0])


def prediction_rows_long(spark: SparkSession, folder: str) -> DataFrame:
    scored, candidates = _candidate_scores(spark, folder)
    texts = candidates.select("id", F.coalesce("factors", F.lit("")).alias("factors"), "title", "description", "document")
    return sinks.prediction_rows(scored.join(texts, "id"), long=True)


def prediction_tags(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.tagged_rows(_scored(spark, folder).withColumn("id", m.record_id()))


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion_matrix(_scored(spark, folder), ["split"])


def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    report = evaluation.classification_report(_scored(spark, folder), ["split"])
    return _rounded(report, "precision", "recall", "f1")


def fbeta_table(spark: SparkSession, folder: str) -> DataFrame:
    table = evaluation.fbeta_table(_scored(spark, folder), BETAS, ["split"])
    return _rounded(table, "precision", "recall", "f_score")


def accuracy_by_split(spark: SparkSession, folder: str) -> DataFrame:
    counts = evaluation.confusion_counts(_scored(spark, folder), ["split"])
    return _rounded(evaluation.metrics(counts, ()).select("split", "tp", "fp", "tn", "fn", "accuracy"), "accuracy")


def true_negative_rate(spark: SparkSession, folder: str) -> DataFrame:
    """A model of the balanced sample, tried on the negatives the sample left out."""
    rare = m.labelled_documents(spark, folder).withColumn("label", 1 - F.col("label"))
    docs = WORDS.terms(sp.choose_negatives(rare, "doc_id", "label", BALANCE_SEED)).drop("text")
    model = _model(docs.filter("chosen"))
    scored = bayes.score(model, docs.filter("NOT chosen"), ["doc_id", "label"])
    counts = evaluation.confusion_counts(scored)
    return _rounded(evaluation.metrics(counts, ()).select("tn", "fp", "tn_rate"), "tn_rate")


def error_lists(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.error_lists(_with_abs(_scored(spark, folder)), "doc_id", ERRORS, ["split"])


def least_certain(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluation.least_certain(_with_abs(_scored(spark, folder)), "doc_id")
    return rows.select("doc_id", "label", "prediction", "tag", "abs_confidence")


def confidence_hist(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confidence_histogram(_with_abs(_scored(spark, folder)), 0.0, 200.0, 20)


def top_features(spark: SparkSession, folder: str) -> DataFrame:
    weights, _ = bayes.linear_weights(_model(_train(_labelled(spark, folder))))
    return linear.top_features(weights, TOP)


def feature_list_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest terms of two smoothings compared by rank."""
    docs = _train(_labelled(spark, folder))
    lists = [
        linear.top_features(bayes.linear_weights(_model(docs, alpha))[0], LISTED).filter("kind <> 'near_zero'")
        for alpha in (ALPHA, OTHER_ALPHA)
    ]
    return linear.list_difference(*lists)


def _evaluations_and_predictions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two evaluated batches of earlier predictions and a newer model's predictions.

    Batch one holds what a count model called 'no', batch two what a presence model called
    'yes'; an ID can be in both. The newer model predicts every document it was not trained on.
    """
    docs = m.documents(spark, folder).select("doc_id", "text", "lang")
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    known = sp.split_exact(labels, "doc_id", 0.5, OLD_SEED, "old_split")
    known = sp.split_exact(known, "doc_id", 0.5, NEW_SEED, "new_split")
    every = WORDS.terms(spread(docs.join(known, "doc_id", "left"), "doc_id")).drop("text")

    evaluated = every.filter(F.col("label").isNotNull())
    old_train = evaluated.filter(F.col("old_split") == sp.TRAIN)
    batches = []
    for binary, wanted, name in ((False, 0, "no"), (True, 1, "yes")):
        scored = bayes.score(_model(old_train, binary=binary), evaluated, ["doc_id", "label", "lang"])
        batches.append(
            scored.filter(F.col("prediction") == wanted).select(
                "doc_id", F.when(F.col("label") == 1, "yes").otherwise("no").alias("evaluated"),
                F.lit(name).alias("old_pred"), F.col("lang").alias("exp_type"),
            )
        )
    evaluations = reconcile.merge_evaluations(batches, "doc_id", "old_pred")

    new_train = evaluated.filter(F.col("new_split") == sp.TRAIN)
    unseen = every.filter(F.col("new_split").isNull() | (F.col("new_split") == sp.TEST))
    scored = bayes.score(_model(new_train, OTHER_ALPHA), unseen, ["doc_id"])
    predictions = scored.select(
        "doc_id", class_name(F.col("prediction")).alias("new_pred"),
        sinks.confidence_text(F.col("confidence")).alias("confidence"),
        sinks.confidence_text(F.abs("confidence")).alias("abs_value"),
    )
    return evaluations, predictions


def reconcile_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.reconcile(*_evaluations_and_predictions(spark, folder), "doc_id")


def reconcile_metrics(spark: SparkSession, folder: str) -> DataFrame:
    report = reconcile.reconcile(*_evaluations_and_predictions(spark, folder), "doc_id")
    return _rounded(reconcile.reconcile_metrics(report), "precision", "recall")


def _split_metrics(spark: SparkSession, folder: str) -> DataFrame:
    docs = WORDS.terms(m.labelled_documents(spark, folder)).drop("text")
    predicted = bayes.compare_splits(docs, "doc_id", SEEDS, ALPHAS, FRACTION, MIN_DF, MAX_DF)
    counts = evaluation.confusion_counts(predicted, ["seed", "alpha"])
    return evaluation.metrics(counts, (1, 4)).select("seed", "alpha", "precision", "recall", "f1", "f4")


def metric_means(spark: SparkSession, folder: str) -> DataFrame:
    names = ("precision", "recall", "f1", "f4")
    means = _split_metrics(spark, folder).groupBy("alpha").agg(
        F.count("*").alias("n_splits"), *[F.round(F.avg(n), 6).alias(n) for n in names]
    )
    return means


def best_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The best split run of each smoothing by F4, then F1."""
    runs = _rounded(_split_metrics(spark, folder), "precision", "recall", "f1", "f4")
    return sinks.best_runs(runs, "alpha", ["f4", "f1"], "seed")


QUERIES = {
    f.__name__: f
    for f in (
        nb_multinomial_params, nb_multinomial_predict, nb_bernoulli_predict, nb_gaussian_params, nb_gaussian_predict,
        positional_weights, linear_score, prediction_rows,
        prediction_rows_long, prediction_tags, confusion_matrix, classification_report, fbeta_table,
        accuracy_by_split, true_negative_rate, error_lists, least_certain, confidence_hist, top_features,
        feature_list_diff, reconcile_predictions, reconcile_metrics, metric_means, best_runs,
    )
}


def sql_bayes(p: str, docs: str, counts: str, alpha: float, binary: bool = False) -> str:
    """CTEs {p}n, {p}t, {p}b and {p}w of a model of docs(label) and counts(label, term, tf)."""
    n = f"(SELECT n_no + n_yes FROM {p}n)"
    ctes = f"""
{p}n AS (SELECT count(*) FILTER (label = 0) AS n_no, count(*) FILTER (label = 1) AS n_yes FROM {docs}),
{p}t AS (
  SELECT term, count(*) AS df, count(*) FILTER (label = 0) AS df_no, count(*) FILTER (label = 1) AS df_yes,
         coalesce(CAST(sum(tf) FILTER (label = 0) AS DOUBLE), 0) AS n_no,
         coalesce(CAST(sum(tf) FILTER (label = 1) AS DOUBLE), 0) AS n_yes
  FROM {counts} GROUP BY term
  HAVING count(*) >= {MIN_DF}::DOUBLE * {n} AND count(*) <= {MAX_DF}::DOUBLE * {n}),"""
    if not binary:
        return ctes + f"""
{p}b AS (SELECT ln(n_no::DOUBLE / (n_no + n_yes)) AS no, ln(n_yes::DOUBLE / (n_no + n_yes)) AS yes FROM {p}n),
{p}w AS (
  SELECT term,
         ln((n_no + {alpha}) / ((SELECT sum(n_no) FROM {p}t) + {alpha} * (SELECT count(*) FROM {p}t))) AS w_no,
         ln((n_yes + {alpha}) / ((SELECT sum(n_yes) FROM {p}t) + {alpha} * (SELECT count(*) FROM {p}t))) AS w_yes
  FROM {p}t)"""
    return ctes + f"""
{p}p AS (
  SELECT term, (df_no + {alpha}) / ((SELECT n_no FROM {p}n) + 2 * {alpha}) AS p_no,
         (df_yes + {alpha}) / ((SELECT n_yes FROM {p}n) + 2 * {alpha}) AS p_yes
  FROM {p}t),
{p}b AS (
  SELECT ln(n_no::DOUBLE / (n_no + n_yes)) + (SELECT sum(ln(1 - p_no)) FROM {p}p) AS no,
         ln(n_yes::DOUBLE / (n_no + n_yes)) + (SELECT sum(ln(1 - p_yes)) FROM {p}p) AS yes FROM {p}n),
{p}w AS (SELECT term, ln(p_no) - ln(1 - p_no) AS w_no, ln(p_yes) - ln(1 - p_yes) AS w_yes FROM {p}p)"""


def sql_scores(p: str, docs: str, counts: str, key: str, binary: bool = False) -> str:
    """CTE {p}s(key, score_no, score_yes) of every row of docs."""
    tf = "1" if binary else "c.tf"
    return f"""
{p}s AS (
  SELECT d.{key}, any_value((SELECT no FROM {p}b)) + coalesce(sum({tf} * w.w_no), 0) AS score_no,
         any_value((SELECT yes FROM {p}b)) + coalesce(sum({tf} * w.w_yes), 0) AS score_yes
  FROM {docs} d LEFT JOIN {counts} c ON c.{key} = d.{key} LEFT JOIN {p}w w ON w.term = c.term
  GROUP BY d.{key})"""


_LAB = f"""
lab AS (
  SELECT d.doc_id, d.text, l.quality AS label, {sql_split('labels', SPLIT_SEED)} AS split
  FROM documents d JOIN labels l USING (doc_id)),
{sql_tokens('lab', 'doc_id, label, split')}, {sql_counts('doc_id, label, split')},
train_docs AS (SELECT doc_id, label FROM lab WHERE split = 'train'),
train_cnt AS (SELECT doc_id, label, term, tf FROM cnt WHERE split = 'train')"""
_MULTI = f"WITH {_LAB}, {sql_bayes('m', 'train_docs', 'train_cnt', ALPHA)}"
_GAUSS = f"""WITH {_LAB},
size AS (SELECT count(*) FILTER (label = 0) AS n_no, count(*) FILTER (label = 1) AS n_yes FROM train_docs),
mom AS (
  SELECT term, coalesce(sum(tf) FILTER (label = 0), 0)::DOUBLE AS s_no, coalesce(sum(tf) FILTER (label = 1), 0)::DOUBLE AS s_yes,
         coalesce(sum(tf * tf) FILTER (label = 0), 0)::DOUBLE AS q_no, coalesce(sum(tf * tf) FILTER (label = 1), 0)::DOUBLE AS q_yes
  FROM train_cnt GROUP BY term
  HAVING count(*) >= {MIN_DF}::DOUBLE * (SELECT n_no + n_yes FROM size) AND count(*) <= {MAX_DF}::DOUBLE * (SELECT n_no + n_yes FROM size)),
spread AS (
  SELECT {GAUSS_FLOOR}::DOUBLE * max((q_no + q_yes) / (n_no + n_yes) - pow((s_no + s_yes) / (n_no + n_yes), 2)) AS floor FROM mom, size),
par AS (
  SELECT term, s_no / n_no AS mean_no, s_yes / n_yes AS mean_yes, greatest(q_no / n_no - pow(s_no / n_no, 2), 0) + floor AS var_no,
         greatest(q_yes / n_yes - pow(s_yes / n_yes, 2), 0) + floor AS var_yes
  FROM mom, size, spread)"""


def _sql_density(x: str, c: str) -> str:
    return f"(-0.5::DOUBLE * ln(2 * pi() * var_{c}) - pow({x} - mean_{c}, 2) / (2 * var_{c}))"


_SCORED = f"""{_MULTI}, {sql_scores('m', 'lab', 'cnt', 'doc_id')},
pred AS (
  SELECT l.doc_id, l.label, l.split, score_no, score_yes, score_yes - score_no AS confidence,
         CAST(score_yes > score_no AS INTEGER) AS prediction,
         CASE WHEN l.label = 1 AND score_yes > score_no THEN 'TP' WHEN l.label = 0 AND score_yes > score_no THEN 'FP'
              WHEN l.label = 0 THEN 'TN' ELSE 'FN' END AS tag,
         round(abs(score_yes - score_no), 6) AS abs_confidence
  FROM ms JOIN lab l USING (doc_id))"""
_BERNOULLI = f"""WITH {_LAB}, {sql_bayes('m', 'train_docs', 'train_cnt', ALPHA, True)}, {sql_scores('m', 'lab', 'cnt', 'doc_id', True)},
pred AS (
  SELECT l.doc_id, l.label, l.split, score_no, score_yes, score_yes - score_no AS confidence,
         CAST(score_yes > score_no AS INTEGER) AS prediction
  FROM ms JOIN lab l USING (doc_id))"""
_PREDICT_ROWS = """
        SELECT doc_id, label, split, round(score_no, 6) AS score_no, round(score_yes, 6) AS score_yes,
               round(confidence, 6) AS confidence, prediction FROM pred"""
_COUNTS = """count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn"""


def _sql_ratio(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif(({whole})::DOUBLE, 0), 0)"


def _sql_f(beta: float, p: str = "p", r: str = "r") -> str:
    square = float(beta) ** 2
    return _sql_ratio(f"{1 + square}::DOUBLE * {p} * {r}", f"{square}::DOUBLE * {p} + {r}")


_P, _R = _sql_ratio("tp", "tp + fp"), _sql_ratio("tp", "tp + fn")
_CONF = f"{_SCORED}, conf AS (SELECT split, {_COUNTS} FROM pred GROUP BY split)"


def _sql_top(weights: str, k: int) -> str:
    return f"""
  SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'near_zero' THEN abs(w) ELSE -abs(w) END, term) AS rank,
         term, w FROM (
    SELECT term, round(weight, 9) AS w, 'positive' AS kind FROM {weights} WHERE round(weight, 9) > 0
    UNION ALL SELECT term, round(weight, 9), 'negative' FROM {weights} WHERE round(weight, 9) < 0
    UNION ALL SELECT term, round(weight, 9), 'near_zero' FROM {weights})
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'near_zero' THEN abs(w) ELSE -abs(w) END, term) <= {k}"""


_CANDIDATES = f"""WITH {m.SQL_TABLES}, {m.SQL_PREPARED},
cand AS (
  SELECT exp_id, coalesce(factors, '') AS factors, title, description,
         title || ' --- ' || description || ' --- ' || {m.sql_factor_terms('factors')} AS document
  FROM candidate WHERE NOT contains(title, '{m.SETTINGS.reject_prefix}')),
recs AS (
  SELECT exp_id, CASE eval_state WHEN 'Yes' THEN 1 ELSE 0 END AS label, document AS text FROM prepared WHERE reject_reason IS NULL
  UNION ALL SELECT exp_id, NULL, document FROM cand),
{sql_tokens('recs', 'exp_id, label')}, {sql_counts('exp_id, label')},
train_docs AS (SELECT exp_id, label FROM recs WHERE label IS NOT NULL),
train_cnt AS (SELECT * FROM cnt WHERE label IS NOT NULL),
{sql_bayes('m', 'train_docs', 'train_cnt', ALPHA)}, {sql_scores('m', 'cand', 'cnt', 'exp_id')}"""
_SHORT = """exp_id AS "ID", CASE WHEN score_yes > score_no THEN 'yes' ELSE 'no' END AS "Pred Class",
               printf('%6.3f', score_yes - score_no) AS "Confidence", printf('%6.3f', abs(score_yes - score_no)) AS "Abs Value\""""

_RECONCILE = f"""WITH old_split AS (SELECT doc_id, {sql_split('labels', OLD_SEED, 0.5)} AS old_split FROM labels),
new_split AS (SELECT doc_id, {sql_split('labels', NEW_SEED, 0.5)} AS new_split FROM labels),
every AS (
  SELECT d.doc_id, d.text, d.lang, l.quality AS label, o.old_split, n.new_split
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN old_split o USING (doc_id) LEFT JOIN new_split n USING (doc_id)),
{sql_tokens('every', 'doc_id, label, old_split, new_split')}, {sql_counts('doc_id, label, old_split, new_split')},
known AS (SELECT * FROM every WHERE label IS NOT NULL),
old_docs AS (SELECT doc_id, label FROM every WHERE old_split = 'train'),
old_cnt AS (SELECT * FROM cnt WHERE old_split = 'train'),
new_docs AS (SELECT doc_id, label FROM every WHERE new_split = 'train'),
new_cnt AS (SELECT * FROM cnt WHERE new_split = 'train'),
unseen AS (SELECT * FROM every WHERE new_split IS NULL OR new_split = 'test'),
{sql_bayes('x1_', 'old_docs', 'old_cnt', ALPHA)}, {sql_scores('x1_', 'known', 'cnt', 'doc_id')},
{sql_bayes('x2_', 'old_docs', 'old_cnt', ALPHA, True)}, {sql_scores('x2_', 'known', 'cnt', 'doc_id', True)},
{sql_bayes('x3_', 'new_docs', 'new_cnt', OTHER_ALPHA)}, {sql_scores('x3_', 'unseen', 'cnt', 'doc_id')},
batches AS (
  SELECT doc_id, 'no' AS old_pred, 0 AS pri FROM x1_s WHERE NOT score_yes > score_no
  UNION ALL SELECT doc_id, 'yes', 1 FROM x2_s WHERE score_yes > score_no),
ev AS (
  SELECT b.doc_id, CASE k.label WHEN 1 THEN 'yes' ELSE 'no' END AS evaluated, b.old_pred, k.lang AS exp_type
  FROM batches b JOIN known k USING (doc_id) QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY pri DESC) = 1),
nw AS (
  SELECT doc_id, CASE WHEN score_yes > score_no THEN 'yes' ELSE 'no' END AS new_pred,
         printf('%6.3f', score_yes - score_no) AS confidence, printf('%6.3f', abs(score_yes - score_no)) AS abs_value
  FROM x3_s),
report AS (
  SELECT coalesce(ev.doc_id, nw.doc_id) AS doc_id, coalesce(evaluated, 'none') AS evaluated,
         coalesce(old_pred, 'none') AS old_pred, coalesce(exp_type, 'none') AS exp_type,
         coalesce(new_pred, 'none') AS new_pred, coalesce(confidence, 'none') AS confidence,
         coalesce(abs_value, 'none') AS abs_value,
         CASE WHEN ev.doc_id IS NULL THEN 'new only' WHEN nw.doc_id IS NULL THEN 'old only' ELSE 'both' END AS origin
  FROM ev FULL JOIN nw ON ev.doc_id = nw.doc_id)"""


def _sql_side(side: str) -> str:
    col = f"{side}_pred"
    return f"""SELECT '{side}' AS side,
          count(*) FILTER (evaluated = 'yes' AND {col} = 'yes') AS tp, count(*) FILTER (evaluated = 'no' AND {col} = 'yes') AS fp,
          count(*) FILTER (evaluated = 'no' AND {col} = 'no') AS tn, count(*) FILTER (evaluated = 'yes' AND {col} = 'no') AS fn
        FROM report"""


def _sql_runs() -> str:
    """CTE runs(seed, alpha, precision, recall, f1, f4) over all splits and smoothings."""
    ctes = [f"""lab AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
        {sql_tokens('lab', 'doc_id, label')}, {sql_counts('doc_id, label')}"""]
    unions = []
    for seed in SEEDS:
        ctes.append(f"""
        sp{seed} AS (SELECT doc_id, quality AS label, {sql_split('labels', seed)} AS split FROM labels),
        d{seed} AS (SELECT * FROM sp{seed} WHERE split = 'train'),
        e{seed} AS (SELECT * FROM sp{seed} WHERE split = 'test'),
        c{seed} AS (SELECT cnt.* FROM cnt JOIN d{seed} USING (doc_id))""")
        for i, alpha in enumerate(ALPHAS):
            p = f"m{seed}_{i}"
            ctes += [sql_bayes(p, f"d{seed}", f"c{seed}", alpha), sql_scores(p, f"e{seed}", "cnt", "doc_id")]
            unions.append(
                f"SELECT {seed} AS seed, {alpha}::DOUBLE AS alpha, label, CAST(score_yes > score_no AS INTEGER) AS prediction "
                f"FROM {p}s JOIN lab USING (doc_id)"
            )
    counted = f"counted AS (SELECT seed, alpha, {_COUNTS} FROM ({' UNION ALL '.join(unions)}) GROUP BY seed, alpha)"
    pr = f"pr AS (SELECT seed, alpha, {_P} AS p, {_R} AS r FROM counted)"
    runs = f"runs AS (SELECT seed, alpha, p AS precision, r AS recall, {_sql_f(1)} AS f1, {_sql_f(4)} AS f4 FROM pr)"
    return "WITH " + ", ".join([*ctes, counted, pr, runs])


_CLASS_ROWS = f"""{_CONF}, sides AS (
  SELECT split, 'yes' AS name, tp AS hit, fp AS wrong, fn AS missed FROM conf
  UNION ALL SELECT split, 'no', tn, fn, fp FROM conf),
pr AS (SELECT split, name, {_sql_ratio('hit', 'hit + wrong')} AS p, {_sql_ratio('hit', 'hit + missed')} AS r, hit + missed AS support FROM sides),
f AS (SELECT *, {_sql_f(1)} AS f1 FROM pr)"""

SQL = {
    "nb_multinomial_params": f"{_MULTI} SELECT term, round(w_no, 6) AS w_no, round(w_yes, 6) AS w_yes FROM mw",
    "nb_multinomial_predict": _SCORED + _PREDICT_ROWS,
    "nb_bernoulli_predict": _BERNOULLI + _PREDICT_ROWS,
    "linear_score": f"""{_MULTI},
        every AS (SELECT doc_id, text FROM documents),
        every_raw AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '(?i)\\b([a-z_]\\w+)\\b', 1) AS toks FROM every),
        occ AS (SELECT doc_id, unnest(toks) AS term FROM every_raw),  -- stop words carry no weight
        s AS (SELECT e.doc_id, (SELECT yes - no FROM mb) + coalesce(sum(w_yes - w_no), 0) AS c
              FROM every e LEFT JOIN occ USING (doc_id) LEFT JOIN mw USING (term) GROUP BY e.doc_id)
        SELECT doc_id, round(c, 6) AS confidence, CAST(c > 0 AS INTEGER) AS prediction FROM s""",
    "prediction_rows": f"{_CANDIDATES} SELECT {_SHORT} FROM ms",
    "prediction_rows_long": f"""{_CANDIDATES} SELECT {_SHORT}, factors AS "Exp Factors", title AS "Title",
        description AS "Description", document AS "Processed Doc" FROM ms JOIN cand USING (exp_id)""",
    "prediction_tags": f"""{_SCORED} SELECT split, 'D-' || doc_id AS id, label, prediction, tag,
        printf('%6.3f', confidence) AS confidence_text, printf('%6.3f', abs(confidence)) AS abs_text FROM pred""",
    "confusion_matrix": f"""{_SCORED} SELECT split, CASE label WHEN 1 THEN 'yes' ELSE 'no' END AS true_class,
        count(*) FILTER (prediction = 1) AS pred_yes, count(*) FILTER (prediction = 0) AS pred_no
        FROM pred GROUP BY split, label ORDER BY split, true_class DESC""",
    "classification_report": f"""{_CLASS_ROWS}
        SELECT split, name, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
        UNION ALL
        SELECT split, 'avg / total', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
               round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f GROUP BY split""",
    "fbeta_table": f"""{_CONF}, pr AS (SELECT split, {_P} AS p, {_R} AS r FROM conf),
        t AS (SELECT split, p, r, unnest([{', '.join(f'{float(b)}::DOUBLE' for b in BETAS)}]) AS beta FROM pr)
        SELECT split, round(p, 6) AS precision, round(r, 6) AS recall, beta,
               round({_sql_ratio('(1 + beta * beta) * p * r', 'beta * beta * p + r')}, 6) AS f_score FROM t""",
    "accuracy_by_split": f"""{_CONF}
        SELECT split, tp, fp, tn, fn, round({_sql_ratio('tp + tn', 'tp + fp + tn + fn')}, 6) AS accuracy FROM conf""",
    "true_negative_rate": f"""
        WITH {SQL_RARE},
        lab AS (SELECT d.doc_id, d.text, r.label, r.chosen FROM documents d JOIN drawn r USING (doc_id)),
        {sql_tokens('lab', 'doc_id, label, chosen')}, {sql_counts('doc_id, label, chosen')},
        train_docs AS (SELECT * FROM lab WHERE chosen), train_cnt AS (SELECT * FROM cnt WHERE chosen),
        rest AS (SELECT * FROM lab WHERE NOT chosen),
        {sql_bayes('m', 'train_docs', 'train_cnt', ALPHA)}, {sql_scores('m', 'rest', 'cnt', 'doc_id')}
        SELECT count(*) FILTER (NOT score_yes > score_no) AS tn, count(*) FILTER (score_yes > score_no) AS fp,
               round({_sql_ratio('count(*) FILTER (NOT score_yes > score_no)', 'count(*)')}, 6) AS tn_rate FROM ms""",
    "error_lists": f"""{_SCORED}
        SELECT split, tag, CAST(position AS INTEGER) AS position, doc_id, abs_confidence, n_total FROM (
          SELECT split, tag, doc_id, abs_confidence,
                 row_number() OVER (PARTITION BY split, tag ORDER BY abs_confidence, doc_id) AS position,
                 count(*) OVER (PARTITION BY split, tag) AS n_total
          FROM pred WHERE tag IN ('FP', 'FN')) WHERE position <= {ERRORS}""",
    "least_certain": f"""{_SCORED} SELECT doc_id, label, prediction, tag, abs_confidence FROM pred
        ORDER BY abs_confidence, doc_id""",
    "confidence_hist": f"""{_SCORED}
        SELECT tag, CAST(CASE WHEN abs_confidence >= 200 THEN 21 ELSE floor(abs_confidence / 10) + 1 END AS BIGINT) AS bucket,
               count(*) AS n_rows FROM pred GROUP BY 1, 2""",
    "top_features": f"""{_MULTI}, lw AS (SELECT term, w_yes - w_no AS weight FROM mw), top AS ({_sql_top('lw', TOP)})
        SELECT kind, CAST(rank AS INTEGER) AS rank, term, round(w, 6) AS weight FROM top""",
    "feature_list_diff": f"""WITH {_LAB}, {sql_bayes('x1_', 'train_docs', 'train_cnt', ALPHA)},
        {sql_bayes('x2_', 'train_docs', 'train_cnt', OTHER_ALPHA)},
        la AS (SELECT term, w_yes - w_no AS weight FROM x1_w), lb AS (SELECT term, w_yes - w_no AS weight FROM x2_w),
        ta AS ({_sql_top('la', LISTED)}), tb AS ({_sql_top('lb', LISTED)})
        SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.term, b.term) AS term,
               CAST(a.rank AS INTEGER) AS rank_a, CAST(b.rank AS INTEGER) AS rank_b
        FROM (SELECT * FROM ta WHERE kind <> 'near_zero') a FULL JOIN (SELECT * FROM tb WHERE kind <> 'near_zero') b
        ON a.kind = b.kind AND a.term = b.term""",
    "reconcile_predictions": f"{_RECONCILE} SELECT * FROM report",
    "reconcile_metrics": f"""{_RECONCILE}, conf AS ({_sql_side('old')} UNION ALL {_sql_side('new')})
        SELECT side, tp, fp, tn, fn, round({_P}, 6) AS precision, round({_R}, 6) AS recall FROM conf""",
    "nb_gaussian_params": f"{_GAUSS} SELECT term, round(mean_no, 6) AS mean_no, round(mean_yes, 6) AS mean_yes, "
        "round(var_no, 6) AS var_no, round(var_yes, 6) AS var_yes FROM par",
    "nb_gaussian_predict": f"""{_GAUSS},
        ps AS (
          SELECT d.doc_id, d.label, d.split,
                 any_value((SELECT ln(n_no::DOUBLE / (n_no + n_yes)) FROM size)) + any_value((SELECT sum({_sql_density("0", "no")}) FROM par))
                 + coalesce(sum({_sql_density("c.tf", "no")} - {_sql_density("0", "no")}), 0) AS score_no,
                 any_value((SELECT ln(n_yes::DOUBLE / (n_no + n_yes)) FROM size)) + any_value((SELECT sum({_sql_density("0", "yes")}) FROM par))
                 + coalesce(sum({_sql_density("c.tf", "yes")} - {_sql_density("0", "yes")}), 0) AS score_yes
          FROM lab d LEFT JOIN cnt c ON c.doc_id = d.doc_id LEFT JOIN par ON par.term = c.term GROUP BY d.doc_id, d.label, d.split)
        SELECT doc_id, label, split, round(score_no, 4) AS score_no, round(score_yes, 4) AS score_yes,
               round(score_yes - score_no, 4) AS confidence, CAST(score_yes > score_no AS INTEGER) AS prediction FROM ps""",
    "positional_weights": f"""{_MULTI}
        SELECT row_number() OVER (ORDER BY term) - 1 AS idx, term, round(w_yes - w_no, 6) AS weight FROM mw""",
    "metric_means": f"""{_sql_runs()}
        SELECT alpha, count(*) AS n_splits, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
               round(avg(f1), 6) AS f1, round(avg(f4), 6) AS f4 FROM runs GROUP BY alpha""",
    "best_runs": f"""{_sql_runs()}
        SELECT CAST(seed AS INTEGER) AS seed, alpha, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1, round(f4, 6) AS f4 FROM runs
        QUALIFY row_number() OVER (PARTITION BY alpha ORDER BY round(f4, 6) DESC, round(f1, 6) DESC, seed) = 1""",
}
