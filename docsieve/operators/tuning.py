"""Grid search with shared feature stages, repeated splits, and tidy run reports."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from inspect import signature
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.operators import evaluation, linear
from docsieve.operators.analyzer import Analyzer, TextTerms
from docsieve.operators.features import FeatureSpec, SharedFeatures, fit_features, plain_columns, vocabulary_slices
from docsieve.operators.models import ClassBalance, coefficients, make_f_scorer, with_confidence
from docsieve.operators.sampling import TEST, TRAIN, split_exact, split_report, stratified_folds
from docsieve.session import materialize

# Grid keys that change features; all others go to the classifier.
ANALYZER_KEYS = ("accents", "lowercase", "pattern", "stop_words", "ngrams", "stem")
FEATURE_KEYS = ("min_df", "max_df", "max_features", "weighting", "scaler")

# Steps of a chain by name, and the parameters each of them takes; the classifier takes all others.
STEPS = {"vectorizer": (*ANALYZER_KEYS, "min_df", "max_df", "max_features", "weighting"), "scaler": ("scaler",), "classifier": None}

Candidate = dict[str, object]


def step_parameter(name: str) -> str:
    """The parameter of a ``step__parameter`` name; a name without a step is its own."""
    step, mark, parameter = name.partition("__")
    if not mark:
        return name
    if step not in STEPS:
        raise ValueError(f"no step {step!r} in {name!r}; steps are {', '.join(STEPS)}")
    own, others = STEPS[step], [k for keys in STEPS.values() if keys for k in keys]
    if parameter not in own if own is not None else parameter in others:
        raise ValueError(f"step {step!r} has no parameter {parameter!r}")
    return parameter


def expand_grid(grid: Mapping[str, Sequence] | Sequence[Mapping[str, Sequence]]) -> list[Candidate]:
    """All combinations of a parameter grid; a list of grids gives their union."""
    grids = [grid] if isinstance(grid, Mapping) else grid
    return [dict(zip(g, values)) for g in grids for values in product(*g.values())]


def random_seeds(given: Mapping[str, int | None]) -> dict[str, int]:
    """Seeds to report and reuse: those given, fresh ones where None."""
    return {name: random.randrange(1000) if seed is None else seed for name, seed in given.items()}


def _ready(vectors: DataFrame) -> DataFrame:
    """Write vectors out and read them back.

    Solvers run one job per step; with the texts and their expressions out of the lineage
    a step ships nothing but the weights.
    """
    return materialize(vectors, "vectors")


def _pick(candidate: Candidate, keys: Sequence[str]) -> Candidate:
    return {step_parameter(k): v for k, v in candidate.items() if step_parameter(k) in keys}


@dataclass
class FittedPipeline:
    """A fitted chain and what its reports need."""

    model: PipelineModel
    vocabulary: list[str]
    candidate: Candidate


@dataclass
class TextTuning:
    """Split, grid search with stratified folds, refit on all training rows, evaluate.

    Grid keys are parameters, alone (``min_df``) or with their step (``vectorizer__min_df``, ``classifier__C``).
    ``classifier`` turns the classifier part of a candidate into an estimator on
    ``features``, ``label`` and (when ``balanced``) ``weight``. Candidates that share their
    feature parameters share one fitted and cached feature stage per fold, those of equal analysis the terms and their counts.
    """

    classifier: Callable[..., Estimator]
    grid: Mapping[str, Sequence] | Sequence[Mapping[str, Sequence]]
    key: str = "doc_id"
    text: str = "text"
    analyzer: Analyzer = field(default_factory=Analyzer)
    features: FeatureSpec = field(default_factory=FeatureSpec)
    balanced: bool = True
    folds: int = 5
    beta: float = 4.0
    compare_beta: float = 4.0
    test_fraction: float = 0.2
    seeds: Mapping[str, int | None] = field(default_factory=lambda: {"split": None, "classifier": None})
    parallelism: int = 2

    def __post_init__(self) -> None:
        self._seed: int | None = None

    def fit(self, docs: DataFrame) -> TuningResult:
        """Tune on rows (key, text, label).

        Splits and folds are drawn from keys and labels alone; texts join the folds once.
        """
        started = datetime.now(UTC)
        seeds = random_seeds(self.seeds)
        self._seed = seeds.get("classifier")
        split = split_exact(docs.select(self.key, self.text, "label"), self.key, self.test_fraction, seeds["split"])
        split = materialize(split, "split")
        train = split.filter(F.col("split") == TRAIN)
        folds = materialize(stratified_folds(train.select(self.key, "label"), self.key, "label", self.folds, seeds["split"]), "folds")
        scores = self.cross_validate(train.select(self.key, self.text).join(folds, self.key))
        best = max(range(len(scores)), key=lambda i: scores[i][1])
        terms = self._terms(split, scores[best][0])
        fitted = self._refit_terms(terms.filter(F.col("split") == TRAIN), scores[best][0])
        scored = with_confidence(PipelineModel(fitted.model.stages[1:]).transform(terms), fitted.model)
        columns = [self.key, "split", "label", F.col("prediction").cast("int").alias("prediction"), "confidence"]
        predictions = materialize(scored.select(*columns), "predictions")
        return TuningResult(self, seeds, scores, best, fitted, predictions, started, datetime.now(UTC))

    def cross_validate(self, folded: DataFrame) -> list[tuple[Candidate, float, list[float]]]:
        """(candidate, mean score, fold scores) for every grid point, in grid order."""
        candidates = expand_grid(self.grid)
        groups: dict[str, list[int]] = {}
        for i, c in enumerate(candidates):
            groups.setdefault(repr(_pick(c, ANALYZER_KEYS)), []).append(i)
        results: dict[int, list[float]] = {i: [] for i in range(len(candidates))}
        for group in groups.values():
            specs: dict[FeatureSpec, list[int]] = {}
            for i in group:
                specs.setdefault(self._spec(candidates[i]), []).append(i)
            terms = self._terms(folded.select(self.key, self.text, "label", "fold"), candidates[group[0]])
            shared = SharedFeatures(terms, [F.col("fold") != fold for fold in range(self.folds)], list(specs))
            for (spec, members), fold in product(specs.items(), range(self.folds)):
                for i, score in zip(members, self._score_fold(_ready(shared.vectors(fold, spec)), fold, candidates, members)):
                    results[i].append(score)
        return [(c, sum(results[i]) / self.folds, results[i]) for i, c in enumerate(candidates)]

    def _analyzer(self, candidate: Candidate) -> Analyzer:
        return self.analyzer.with_options(**_pick(candidate, ANALYZER_KEYS))

    def _spec(self, candidate: Candidate) -> FeatureSpec:
        return FeatureSpec(**{**self.features.__dict__, **_pick(candidate, FEATURE_KEYS)})

    def _classifier(self, candidate: Candidate) -> Estimator:
        options = {step_parameter(k): v for k, v in candidate.items()}
        options = {k: v for k, v in options.items() if k not in ANALYZER_KEYS + FEATURE_KEYS}
        # Classifiers that draw random numbers take the run's seed; the others have no such parameter.
        if self._seed is not None and "seed" in signature(self.classifier).parameters:
            options.setdefault("seed", self._seed)
        return self.classifier(**options)

    def _terms(self, rows: DataFrame, candidate: Candidate) -> DataFrame:
        """The rows with their terms in place of the text, written out: texts are analysed once."""
        words = TextTerms.of(self._analyzer(candidate), self.text)
        return materialize(words.transform(rows).select(*[c for c in rows.columns if c != self.text], "terms"), "terms")

    def weighted(self, train: DataFrame) -> DataFrame:
        """Training rows, with the weights of their classes where the run balances them."""
        return ClassBalance().fit(train.select("label")).transform(train) if self.balanced else train

    def _score_fold(self, vectors: DataFrame, fold: int, candidates, members) -> list[float]:
        train, valid = self.weighted(vectors.filter(F.col("fold") != fold)), vectors.filter(F.col("fold") == fold)

        def run(i: int) -> float:
            scored = self._classifier(candidates[i]).fit(train).transform(valid)
            return make_f_scorer(self.beta).evaluate(scored)

        with ThreadPool(min(self.parallelism, len(members))) as pool:
            return pool.map(inheritable_thread_target(train.sparkSession)(run), members)

    def refit(self, train: DataFrame, candidate: Candidate) -> FittedPipeline:
        """Fit one candidate on all given rows."""
        return self._refit_terms(self._terms(train.select(self.key, self.text, "label"), candidate), candidate)

    def _refit_terms(self, terms: DataFrame, candidate: Candidate) -> FittedPipeline:
        words = TextTerms.of(self._analyzer(candidate), self.text)
        fitted = fit_features(terms, self._spec(candidate))
        vectors = plain_columns(fitted.model.transform(terms)).select(self.key, "label", "features")
        model = self._classifier(candidate).fit(_ready(self.weighted(vectors)))
        return FittedPipeline(PipelineModel([words, *fitted.model.stages, model]), fitted.vocabulary, candidate)


@dataclass
class TuningResult:
    """Everything a run reports, as small tables."""

    run: TextTuning
    seeds: dict[str, int]
    scores: list[tuple[Candidate, float, list[float]]]
    best: int
    fitted: FittedPipeline
    predictions: DataFrame
    started: datetime
    ended: datetime

    def grid_table(self) -> DataFrame:
        """(candidate, params, mean_score, min_score, max_score, is_best)."""
        rows = [
            (i, {k: str(v) for k, v in c.items()}, mean, min(folds), max(folds), i == self.best)
            for i, (c, mean, folds) in enumerate(self.scores)
        ]
        schema = "candidate int, params map<string,string>, mean_score double, min_score double, max_score double, is_best boolean"
        return self.predictions.sparkSession.createDataFrame(rows, schema)

    def metrics(self) -> DataFrame:
        """Training and test metrics side by side."""
        betas = tuple(dict.fromkeys((1.0, self.run.compare_beta)))
        return evaluation.metrics(evaluation.confusion_counts(self.predictions, ["split"]), betas)

    def errors(self, k: int = 5) -> DataFrame:
        rows = self.predictions.withColumn("abs_confidence", F.abs("confidence"))
        return evaluation.error_lists(rows, self.run.key, k, ["split"])

    def weights(self) -> DataFrame | None:
        """(idx, term, weight), for linear models."""
        last = self.fitted.model.stages[-1]
        if not (hasattr(last, "coefficients") or hasattr(last, "intercept")):
            return None
        return coefficients(self.predictions.sparkSession, last, self.fitted.vocabulary)

    def top_features(self, n: int = 20) -> DataFrame | None:
        weights = self.weights()
        return None if weights is None else linear.top_features(weights.select("term", "weight"), n)

    def split_report(self) -> DataFrame:
        return split_report(self.predictions)

    def index_row(self, script: str, ts) -> dict[str, object]:
        """One row for the run index."""
        test = self.metrics().filter(F.col("split") == TEST).first()
        return {
            "ts": ts, "label": f"PRF{self.run.compare_beta:g},F1", "precision": test["precision"], "recall": test["recall"],
            "f4": test[f"f{self.run.compare_beta:g}"], "f1": test["f1"], "script": script,
            "split_seed": self.seeds["split"], "classifier_seed": self.seeds.get("classifier"),
            "params": {k: str(v) for k, v in self.fitted.candidate.items()},
        }

    def confusion(self) -> DataFrame:
        return evaluation.confusion_matrix(self.predictions, ["split"])

    def vocabulary_parts(self, k: int = 10) -> DataFrame:
        """First, middle and last ``k`` terms of the vocabulary."""
        rows = [(i, t) for i, t in enumerate(self.fitted.vocabulary)]
        return vocabulary_slices(self.predictions.sparkSession.createDataFrame(rows, "idx long, term string"), k)

    def options(self) -> DataFrame:
        """(option, values): what the grid tried for each option."""
        tried: dict[str, list[str]] = {}
        for candidate, *_ in self.scores:
            for name, value in candidate.items():
                if str(value) not in tried.setdefault(name, []):
                    tried[name].append(str(value))
        rows = [(name, ", ".join(values)) for name, values in tried.items()]
        return self.predictions.sparkSession.createDataFrame(rows, "option string, values string")

    def steps(self) -> DataFrame:
        """(step, stage, params): the fitted chain in order, without its learned values."""
        learned = ("coefficients", "vocabulary", "scalingVec", "classes", "weights")
        rows = []
        for i, stage in enumerate(self.fitted.model.stages):
            held = {p.name: str(v) for p, v in stage.extractParamMap().items() if p.name not in learned}
            rows.append((i, type(stage).__name__, held))
        return self.predictions.sparkSession.createDataFrame(rows, "step int, stage string, params map<string,string>")

    def report(self) -> dict[str, DataFrame]:
        """The parts of the report; every part is a small table by construction."""
        parts = {
            "Metrics": self.metrics(), "Confusion matrix": self.confusion(), "Options tried": self.options(), "Grid": self.grid_table(),
            "Pipeline": self.steps(), "Errors": self.errors(), "Split": self.split_report(), "Vocabulary": self.vocabulary_parts(),
        }
        top = self.top_features()
        return parts if top is None else {**parts, "Top features": top.orderBy("kind", "rank")}

    def render(self) -> str:
        """The report as text."""
        lines = [
            f"Start: {self.started:%Y/%m/%d-%H-%M-%S}", f"Seeds: {self.seeds}", f"Best parameters: {self.fitted.candidate}",
            f"Number of features: {len(self.fitted.vocabulary)}",
        ]
        for title, table in self.report().items():
            lines.append(f"\n### {title}")
            lines.append("\t".join(table.columns))
            lines += ["\t".join(str(v) for v in row) for row in table.collect()]
        return "\n".join([*lines, f"\nEnd: {self.ended:%Y/%m/%d-%H-%M-%S}"])


def compare_pipelines(
    docs: DataFrame, pipelines: Mapping[str, TextTuning], seeds: Sequence[int], fraction: float = 0.2
) -> DataFrame:
    """Test metrics (pipeline, seed, precision, recall, f1, f4) of fixed pipelines over several splits.

    Each pipeline's grid must hold one candidate.
    """
    spark, rows = docs.sparkSession, []
    groups: dict[tuple, dict[FeatureSpec, list[str]]] = {}
    for name, run in pipelines.items():
        (candidate,) = expand_grid(run.grid)
        specs = groups.setdefault((run._analyzer(candidate), run.key, run.text), {})
        specs.setdefault(run._spec(candidate), []).append(name)
    split, key = docs, next(iter(pipelines.values())).key
    for i, seed in enumerate(seeds):
        split = split_exact(split, key, fraction, seed, f"_split_{i}", docs)
    split = materialize(split, "split")
    for specs in groups.values():
        # Pipelines of equal analysis share the terms, those of equal features the vectors.
        run = pipelines[next(iter(specs.values()))[0]]
        terms = run._terms(split, expand_grid(run.grid)[0])
        shared = SharedFeatures(terms, [F.col(f"_split_{i}") == TRAIN for i in range(len(seeds))], list(specs))
        for (i, seed), (spec, names) in product(enumerate(seeds), specs.items()):
            vectors = _ready(shared.vectors(i, spec))
            train, test = (vectors.filter(F.col(f"_split_{i}") == part) for part in (TRAIN, TEST))
            for name in names:
                run = pipelines[name]
                scored = run._classifier(expand_grid(run.grid)[0]).fit(run.weighted(train)).transform(test)
                m = evaluation.metrics(evaluation.confusion_counts(scored), (1, 4)).first()
                rows.append((name, seed, m["precision"], m["recall"], m["f1"], m["f4"]))
    return spark.createDataFrame(rows, "pipeline string, seed int, precision double, recall double, f1 double, f4 double")


def average_over_splits(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pipeline").agg(
        F.count("*").alias("n_splits"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "f4")]
    )
