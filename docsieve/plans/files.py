"""Files written from the given tables to the shared folder and read back, and the SQL that tells what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve import jobs
from docsieve.functions.documents import class_index, confidence_text
from docsieve.operators import curation, reconcile
from docsieve.plans import mapping as m
from docsieve.session import shared_dir
from docsieve.sources import records
from docsieve.sources.corpus import read_corpus
from docsieve.sources.tables import read_table

TSV = {"sep": "\t", "header": True, "quote": "", "escape": "", "emptyValue": "", "nullValue": ""}
# Fixed values of these queries: records that lose a field, and records that get an unknown class.
SHORT, UNKNOWN = 11, 13


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _training_file(spark: SparkSession, folder: str) -> str:
    """A labelled record file with its header, some lines short of a field, some of a class nobody knows."""
    found = curation.training_extract(m.curation_tables(spark, folder), m.KEYS)
    number = F.substring("exp_id", 3, 20).cast("long")
    state = F.when(number % UNKNOWN == 1, F.lit("Maybe")).otherwise(F.col("eval_state"))
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ")
    fields = [F.col("exp_id"), state, plain(F.col("factors")), plain(F.col("title")), plain(F.col("description"))]
    line = F.when(number % SHORT == 4, F.concat_ws("\t", *fields[:3])).otherwise(F.concat_ws("\t", *fields))
    head = spark.range(1).select(F.lit("\t".join((jobs.HEADER, "eval state", "factors", "title", "description"))).alias("value"))
    path = _place(spark, "records")
    found.select(line.alias("value")).unionByName(head).write.text(path)
    return path


def record_file(spark: SparkSession, folder: str) -> DataFrame:
    """A record file read back: fields, document, and why a line cannot be used."""
    read = records.require_known_class(jobs.read_records(spark, _training_file(spark, folder), m.SETTINGS))
    return read.select(
        F.coalesce("id", F.substring_index("raw", "\t", 1)).alias("id"), "class_name", "factors", "n_fields", "quarantine_reason",
        "reject_reason", F.md5("document").alias("document_md5"),
    )


def prepared_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The prepare job on the same file: its labelled corpus by class, read back, beside the counts it reports."""
    corpus = _place(spark, "corpus")
    counts = jobs.prepare_training(spark, _training_file(spark, folder), corpus, m.SETTINGS)
    by_class = read_corpus(spark, corpus).groupBy(F.col("class_name").alias("kind")).agg(
        F.count("*").alias("n_written"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("id").alias("n_ids")
    )
    return counts.join(by_class, "kind", "left")


def reconciled_files(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation files of two earlier classes and a newer prediction file, written as TSV, read back and reconciled."""
    labels = read_table(spark, folder, "labels").join(m.documents(spark, folder).select("doc_id", "lang", "source"), "doc_id")
    place = _place(spark, "predictions")
    name, none = F.concat(F.lit("D-"), F.col("doc_id")), F.lit("")
    for part, old in ((0, "no"), (1, "yes")):
        known = labels.filter(F.col("toxic") == part).select(
            name.alias("a"), none.alias("b"), F.col("lang").alias("c"), F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("d"),
            none.alias("e"), none.alias("f"), F.concat_ws("|", "lang", "source").alias("g"),
        )
        known.write.options(**TSV).csv(f"{place}/{old}")
    margin = (F.col("doc_id") % 17 - 8).cast("double") / 4
    newer = labels.filter("doc_id % 3 <> 0").select(
        name.alias("a"), F.when(margin > 0, class_index(F.lit("yes"))).otherwise(class_index(F.lit("no"))).alias("b"),
        F.trim(confidence_text(margin)).alias("c"), F.trim(confidence_text(F.abs(margin))).alias("d"), none.alias("e"), none.alias("f"),
    )
    newer.write.options(**TSV).csv(f"{place}/new")
    batches = [records.read_evaluations(spark, f"{place}/{old}", old) for old in ("no", "yes")]
    predictions = records.read_predictions(spark, f"{place}/new").withColumnRenamed("pred_class", "new_pred")
    merged = reconcile.merge_evaluations(batches, "id", "old_pred")
    return reconcile.reconcile(merged, predictions.select("id", "new_pred", "confidence", "abs_value"), "id")


QUERIES = {f.__name__: f for f in (record_file, prepared_corpus, reconciled_files)}

_FILE = f"""WITH {m.SQL_TABLES},
line AS (
  SELECT exp_id, CAST(substr(exp_id, 3) AS BIGINT) AS number, eval_state, coalesce(factors, '') AS factors,
         trim(title, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS title,
         trim(description, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS description
  FROM training),
parsed AS (
  SELECT exp_id AS id, number, number % {SHORT} = 4 AS short, title, description, factors,
         CASE WHEN number % {UNKNOWN} = 1 THEN 'maybe' ELSE lower(eval_state) END AS class_name FROM line),
judged AS (
  SELECT *, CASE WHEN short THEN 'field count 3' WHEN class_name = 'maybe' THEN 'no known class' END AS quarantine_reason,
         CASE WHEN NOT short AND contains(title, '{m.SETTINGS.reject_prefix}') THEN 'Encode experiment ' || id END AS reject_reason,
         title || ' --- ' || description || ' --- ' || {m.sql_factor_terms('factors')} AS document
  FROM parsed)"""
SQL = {
    "record_file": f"""{_FILE}
        SELECT id, CASE WHEN NOT short THEN class_name END AS class_name, CASE WHEN NOT short THEN factors END AS factors,
               CASE WHEN short THEN 3 ELSE 5 END AS n_fields, quarantine_reason, reject_reason,
               md5(CASE WHEN short THEN ' ---  --- ' ELSE document END) AS document_md5
        FROM judged""",
    "prepared_corpus": f"""{_FILE},
        kinds AS (
          SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'skipped' WHEN quarantine_reason IS NOT NULL THEN 'quarantined'
                         ELSE class_name END AS kind FROM judged)
        SELECT kind, count(*) AS n_records, CASE WHEN kind IN ('yes', 'no') THEN count(*) END AS n_written,
               CASE WHEN kind IN ('yes', 'no') THEN CAST(sum(length(document)) AS BIGINT) END AS n_chars,
               CASE WHEN kind IN ('yes', 'no') THEN count(DISTINCT id) END AS n_ids
        FROM kinds GROUP BY kind""",
    "reconciled_files": """
        WITH old AS (
          SELECT 'D-' || doc_id AS id, doc_id, lang AS exp_type, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS evaluated,
                 CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END AS old_pred, (doc_id % 17 - 8) / 4.0::DOUBLE AS margin, doc_id % 3 <> 0 AS known
          FROM labels JOIN documents USING (doc_id))
        SELECT id, exp_type, evaluated, old_pred, CASE WHEN NOT known THEN 'none' WHEN margin > 0 THEN 'yes' ELSE 'no' END AS new_pred,
               CASE WHEN known THEN trim(printf('%6.3f', margin)) ELSE 'none' END AS confidence,
               CASE WHEN known THEN trim(printf('%6.3f', abs(margin))) ELSE 'none' END AS abs_value,
               CASE WHEN known THEN 'both' ELSE 'old only' END AS origin
        FROM old""",
}
