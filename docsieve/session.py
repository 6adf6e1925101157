"""Session set-up and shared-storage materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SPREAD_CONF = "docsieve.spread"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(name: str = "docsieve", **conf: object) -> SparkSession:
    """A session with adaptive execution on; cluster settings win where already given."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only in local mode where none is named."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="docsieve-")
        spark.conf.set(CHECKPOINT_CONF, path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut, lost executors cost nothing, and the optimiser sees the real
    size of the table: a later join broadcasts it only when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by key where the caller has set ``docsieve.spread`` to a number of partitions.

    For tables of one row group, which no scan setting can split. Unset, as on a cluster, nothing moves.
    """
    parts = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(parts), key) if parts else df


def small_batches(spark: SparkSession) -> None:
    """Documents are longer than the rows that Spark's default Arrow batch of 10,000 is meant for: 1,000 at a time.

    A number that the caller has set stays.
    """
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, "1000")
