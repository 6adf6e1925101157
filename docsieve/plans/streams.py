"""A stream of record files made from the given tables, scored and accounted for, and its SQL counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import bayes, curation
from docsieve.plans import mapping as m
from docsieve.plans.model import _CANDIDATES, WORDS, _model, _records
from docsieve.session import materialize, shared_dir, spread
from docsieve.streaming.scoring import LEFT_OUT, SCORED, line_stream, read_accounts, start_accounting

# Fixed values of this query: which records lose their last field, and which arrive a second time.
BROKEN, AGAIN = 10, 7


def _record_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Lines of the first and of the second delivery: candidates, some of them cut short, some sent again."""
    found = curation.candidate_extract(m.curation_tables(spark, folder), m.KEYS)
    fields = [F.col("exp_id"), F.coalesce("factors", F.lit("")), F.regexp_replace("title", r"[\t\r\n]", " "), F.col("description")]
    number = F.substring("exp_id", 3, 20).cast("long")
    line = F.when(number % BROKEN == 3, F.concat_ws("\t", *fields[:3])).otherwise(F.concat_ws("\t", *fields))
    lines = materialize(found.select(F.regexp_replace(line, r"[\r\n]", " ").alias("value"), number.alias("number")), "lines")
    return lines.select("value"), lines.filter(F.col("number") % AGAIN == 0).select("value")


def stream_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Two deliveries of record files, two runs of one restartable query: every line scored or left out with its reason."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    training, _ = _records(spark, folder)
    training = materialize(training.select("exp_id", "label", "document"), "training")
    model = _model(WORDS.terms(spread(training, "exp_id"), "document"))

    def score(batch: DataFrame) -> DataFrame:
        return bayes.score(model, WORDS.terms(batch), ["id"]).select("id", "prediction", "confidence")

    for delivery in _record_lines(spark, folder):
        delivery.write.mode("append").text(f"{place}/inbox")
        lines = line_stream(spark, f"{place}/inbox", m.SETTINGS)
        start_accounting(lines, score, f"{place}/out", f"{place}/state").awaitTermination()
    scored = read_accounts(spark, f"{place}/out", SCORED).select(
        "id", F.lit("scored").alias("kind"), F.lit(None).cast("string").alias("reason"), "prediction", F.round("confidence", 6).alias("confidence")
    )
    left = read_accounts(spark, f"{place}/out", LEFT_OUT).select(
        # A line without a record has no id of its own: its first field tells it apart.
        F.coalesce("id", F.substring_index("raw", "\t", 1)).alias("id"), "kind", "reason",
        F.lit(None).cast("int").alias("prediction"), F.lit(None).cast("double").alias("confidence"),
    )
    return scored.unionByName(left)


QUERIES = {"stream_accounts": stream_accounts}
SQL = {
    "stream_accounts": f"""{_CANDIDATES},
        sent AS (SELECT exp_id, title, CAST(substr(exp_id, 3) AS BIGINT) AS number FROM candidate),
        arrived AS (SELECT *, 1 AS delivery FROM sent UNION ALL SELECT *, 2 FROM sent WHERE number % {AGAIN} = 0),
        judged AS (
          SELECT *, CASE WHEN number % {BROKEN} = 3 THEN 'quarantined' WHEN contains(title, '{m.SETTINGS.reject_prefix}') THEN 'skipped'
                         WHEN delivery = 2 THEN 'repeated' ELSE 'scored' END AS kind
          FROM arrived)
        SELECT exp_id AS id, kind, CASE kind WHEN 'quarantined' THEN 'field count 3' WHEN 'skipped' THEN 'Encode experiment ' || exp_id
                 WHEN 'repeated' THEN 'id seen before' END AS reason,
               CASE kind WHEN 'scored' THEN CAST(score_yes > score_no AS INTEGER) END AS prediction,
               CASE kind WHEN 'scored' THEN round(score_yes - score_no, 6) END AS confidence
        FROM judged LEFT JOIN ms USING (exp_id)""",
}
