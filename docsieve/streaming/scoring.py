"""Score record files as they arrive, and account for every line that is not scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docsieve.config import Settings
from docsieve.functions.documents import build_document, reject_reason
from docsieve.functions.preprocess import preprocess
from docsieve.operators.models import with_confidence
from docsieve.sources.records import parse_records

# What becomes of a line. ``kept`` lines are scored, all others are left out with their reason.
KEPT, REPEATED, HEADER, QUARANTINED, SKIPPED = "kept", "repeated", "header", "quarantined", "skipped"
LINE_SCHEMA = "id string, arrived timestamp, text string, raw string, kind string, reason string"
# How far the watermark stays behind the newest arrival.
LATENESS = "1 hour"
SCORED, LEFT_OUT, COUNTS = "scored", "left_out", "counts"


def record_stream(spark: SparkSession, folder: str, settings: Settings, horizon: str = "1 day") -> DataFrame:
    """Kept records of arriving TSV files, each ID once per ``horizon``.

    The state holds one entry per ID inside the horizon and is dropped behind the watermark.
    """
    kept = judged_lines(_lines(spark, folder), settings).filter(F.col("kind") == KEPT)
    return kept.select("id", "arrived", "text").withWatermark("arrived", horizon).dropDuplicatesWithinWatermark(["id"])


def _lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).withColumn("arrived", F.current_timestamp()).select("value", "arrived")


def judged_lines(lines: DataFrame, settings: Settings) -> DataFrame:
    """Every line with its record's id and document, its kind, and the reason it is left out."""
    parsed = parse_records(lines, keep=("arrived",))
    document = build_document(F.col("title"), F.col("description"), F.col("factors"))
    rejected = reject_reason(F.col("id"), F.col("title"), settings.reject_prefix, settings.keep_rejected)
    header = F.coalesce(F.lower("id") == "exp id", F.lit(False))
    kind = (
        F.when(header, HEADER).when(F.col("quarantine_reason").isNotNull(), QUARANTINED).when(rejected.isNotNull(), SKIPPED).otherwise(KEPT)
    )
    reason = F.when(header, "header line").otherwise(F.coalesce("quarantine_reason", rejected))
    return parsed.select(
        "id", "arrived", preprocess(document, settings.preprocessor).alias("text"), "raw", kind.alias("kind"), reason.alias("reason")
    )


def _first_of_id(horizon_ms: int) -> Callable:
    def mark(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, arrived = state.exists, state.getCurrentWatermarkMs()
        for frame in frames:
            arrived = max(arrived, int(frame["arrived"].max().timestamp() * 1000))
            frame = frame.sort_values("raw", kind="stable")
            again = pd.Series(True, index=frame.index)
            if not seen and len(frame):
                again.iloc[0] = False
            seen = seen or len(frame) > 0
            frame.loc[again, "kind"] = REPEATED
            frame.loc[again, "reason"] = "id seen before"
            yield frame
        if not state.exists:
            state.update((True,))
            state.setTimeoutTimestamp(arrived + horizon_ms)

    return mark


def line_stream(
    spark: SparkSession, folder: str, settings: Settings, horizon_ms: int = 86_400_000, files_per_batch: int | None = None
) -> DataFrame:
    """Every arriving line once, with its kind: records of an ID seen within the horizon are ``repeated``.

    The state is one flag per ID, dropped when the horizon has passed. Of lines that arrive together the one that sorts
    first is kept.
    """
    judged = judged_lines(_lines(spark, folder, files_per_batch), settings)
    kept = judged.filter(F.col("kind") == KEPT).withWatermark("arrived", LATENESS).groupBy("id").applyInPandasWithState(
        _first_of_id(horizon_ms), LINE_SCHEMA, "seen boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
    return kept.unionByName(judged.filter(F.col("kind") != KEPT))


def score_stream(records: DataFrame, model: PipelineModel) -> DataFrame:
    scored = with_confidence(model.transform(records), model)
    return scored.select("id", "arrived", F.col("prediction").cast("int").alias("prediction"), "confidence")


def start_scoring(
    scored: DataFrame, output: str, checkpoint: str, trigger: dict[str, object] | None = None,
    sink: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Append scores to a parquet folder (or hand each batch to ``sink``); restarts resume at the checkpoint."""
    writer = scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    if sink is not None:
        return writer.foreachBatch(lambda batch, _: sink(batch)).start()
    return writer.format("parquet").option("path", output).start()


def start_accounting(
    lines: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, trigger: dict[str, object] | None = None
) -> StreamingQuery:
    """Write each batch of :func:`line_stream`: scored records, left-out lines, and how many there are of each kind.

    ``score`` turns kept rows (id, arrived, text) into rows to write. A batch has a folder of its own in each table, so a batch
    that runs again after a failure replaces what it left. Its counts are written last: only batches that have counts are
    complete, and :func:`read_accounts` reads no others.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            place = lambda table: f"{output}/{table}/batch={number}"
            kept = F.col("kind") == KEPT
            score(batch.filter(kept).select("id", "arrived", "text")).write.mode("overwrite").parquet(place(SCORED))
            batch.filter(~kept).select("id", "arrived", "raw", "kind", "reason").write.mode("overwrite").parquet(place(LEFT_OUT))
            batch.groupBy("kind").agg(F.count("*").alias("n_lines")).coalesce(1).write.mode("overwrite").parquet(place(COUNTS))
        finally:
            batch.unpersist()

    writer = lines.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(write).start()


def read_accounts(spark: SparkSession, output: str, table: str) -> DataFrame:
    """The rows of a table of complete batches, with their ``batch``."""
    done = spark.read.parquet(f"{output}/{COUNTS}").select("batch").distinct()
    return spark.read.parquet(f"{output}/{table}").join(F.broadcast(done), "batch", "left_semi")  # one row per batch
