"""The three batch jobs: prepare a training corpus, tune a pipeline on it, and score a file of records."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.config import CLASS_NAMES, POSITIVE_INDEX, Settings
from docsieve.functions.documents import build_document, reject_reason
from docsieve.functions.preprocess import preprocess
from docsieve.operators.models import has_margin, with_confidence
from docsieve.operators.tuning import TextTuning, TuningResult
from docsieve.session import materialize
from docsieve.sources.corpus import read_corpus, write_corpus
from docsieve.sources.records import parse_records, read_lines, require_known_class, without_header
from docsieve.sources.sinks import record_run, write_predictions, write_split_predictions

# Fixed value: the first header word of record files.
HEADER = "exp ID"


def read_records(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """Parsed records of a TSV file with their document and reject reason."""
    records = parse_records(without_header(read_lines(spark, path), HEADER))
    document = build_document(F.col("title"), F.col("description"), F.col("factors"))
    return records.withColumns(
        {
            "document": preprocess(document, settings.preprocessor),
            "reject_reason": reject_reason(F.col("id"), F.col("title"), settings.reject_prefix, settings.keep_rejected),
        }
    )


def outcome(otherwise: Column | None = None) -> Column:
    """What becomes of a record: skipped by the reject rule, quarantined, or ``otherwise``."""
    kind = F.when(F.col("reject_reason").isNotNull(), "skipped").when(F.col("quarantine_reason").isNotNull(), "quarantined")
    return (kind if otherwise is None else kind.otherwise(otherwise)).alias("kind")


def prepare_training(spark: SparkSession, path: str, output: str, settings: Settings) -> DataFrame:
    """Write the labelled documents of a record file by class; return the counts per outcome.

    ``kind`` is a class name, ``skipped`` for rejected records or ``quarantined``.
    """
    records = require_known_class(read_records(spark, path, settings))
    usable = F.col("quarantine_reason").isNull() & F.col("reject_reason").isNull()
    write_corpus(records.filter(usable).select("id", "class_name", F.col("document").alias("text")), output)
    return records.groupBy(outcome(F.col("class_name"))).agg(F.count("*").alias("n_records"))


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, label) of a prepared corpus."""
    label = F.col("class_name") == CLASS_NAMES[POSITIVE_INDEX]
    return read_corpus(spark, path).select("id", "text", label.cast("int").alias("label"))


def tune(
    spark: SparkSession, corpus: str, output: str, run: TextTuning, settings: Settings, run_id: str, script: str = "tune"
) -> TuningResult:
    """Tune ``run`` on a prepared corpus and write all that a run leaves.

    Under ``output``: the fitted chain (``model-<run_id>``), the report as text (``report-<run_id>``), the tagged predictions by split
    (``<prediction_prefix>-<run_id>``), and one row of the run index (``index_table``). Everything is named by the run, so a
    run that is done again replaces what it left and adds nothing. F-betas, test share and folds come from the settings.
    """
    run = replace(
        run, key="id", text="text", beta=settings.grid_beta, compare_beta=settings.compare_beta,
        test_fraction=settings.test_fraction, folds=settings.folds,
    )
    result = run.fit(labelled_corpus(spark, corpus))
    result.fitted.model.write().overwrite().save(f"{output}/model-{run_id}")
    report = spark.createDataFrame([(result.render(),)], "value string")
    report.coalesce(1).write.mode("overwrite").text(f"{output}/report-{run_id}")
    write_split_predictions(result.predictions, f"{output}/{settings.prediction_prefix}-{run_id}")
    # The index comes last: a run that is listed there is complete.
    record_run(spark, f"{output}/{settings.index_table}", run_id, result.index_row(script, result.ended))
    return result


def predict_records(
    spark: SparkSession, path: str, model_path: str, output: str, settings: Settings, long_output: str | None = None
) -> DataFrame:
    """Score a record file with a saved model and write the prediction files; return the counts per outcome.

    Class and confidence columns appear when the file has classes and the model a margin. Records
    that are not scored go to ``<output>-left-out`` with their reason, so input and output rows
    add up. Records are scored once, into the shared folder; both files are projections of that.
    """
    model = PipelineModel.load(model_path)
    records = read_records(spark, path, settings)
    usable = F.col("quarantine_reason").isNull() & F.col("reject_reason").isNull()
    kept = records.filter(usable)
    scored = model.transform(kept.withColumn("text", F.col("document")))
    if has_margin(model):
        scored = with_confidence(scored, model)
    wanted = [c for c in scored.columns if c in (*kept.columns, "prediction", "confidence")]
    scored = materialize(scored.select(*wanted), "scored")
    if scored.filter(F.col("class_name").isNotNull()).isEmpty():
        scored = scored.drop("class_name")
    write_predictions(scored, output)
    if long_output:
        write_predictions(scored, long_output, long=True)
    left_out = materialize(
        records.filter(~usable).select("id", "raw", F.coalesce("quarantine_reason", "reject_reason").alias("reason"), outcome()), "left-out"
    )
    left_out.write.mode("overwrite").parquet(f"{output}-left-out")
    counts = scored.select(F.lit("scored").alias("kind")).unionByName(left_out.select("kind")).groupBy("kind")
    return counts.agg(F.count("*").alias("n_records"))
