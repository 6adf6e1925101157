"""Positions and hash-ordered selections that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.session import materialize

# Hex digits of the hash that locate a cut, step by step; of 10^12 rows, 16^8 buckets hold some 200 each.
PREFIXES = (4, 8)


def hash_key(key: str, seed: int) -> Column:
    """Reproducible "random" order: md5 of seed and key, independent of partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _hash_bucket(h: Column, digits: int = PREFIXES[0]) -> Column:
    """One of evenly filled buckets that keep the order of the hash."""
    return F.substring(h, 1, digits)


def hash_threshold(ids: DataFrame, key: str, seed: int, wanted: Column) -> Column:
    """The (hash, key) pair of the last of the ``wanted`` smallest rows, as a scalar.

    ``wanted`` may use the column ``n_all``, the row count. Bucket counts (at most 65,536 rows a
    step) locate the one bucket the cut falls into; each step cuts the bucket of the last one
    65,536 times finer, so what is sorted in the end is a few rows however long the table.
    """
    rows = ids.select(F.col(key).alias("k"), hash_key(key, seed).alias("h"))
    everything, need = Window.partitionBy(), None
    for digits in PREFIXES:
        buckets = rows.groupBy(_hash_bucket(F.col("h"), digits).alias("b"), *([] if need is None else ["need"])).agg(F.count("*").alias("n"))
        sized = buckets.withColumn("upto", F.sum("n").over(Window.orderBy("b"))).withColumn("n_all", F.sum("n").over(everything))
        left = (wanted.cast("long") if need is None else need) - F.col("upto") + F.col("n")
        cut = sized.withColumn("left", left).filter((F.col("left") >= 1) & (F.col("left") <= F.col("n"))).select("b", "left")
        # `cut` holds one row at most: the bucket where the running count passes the wanted one.
        rows = rows.join(F.broadcast(cut), _hash_bucket(F.col("h"), digits) == F.col("b"), "inner")
        rows, need = rows.select("k", "h", F.col("left").alias("need")), F.col("need")
    ranked = rows.withColumn("r", F.row_number().over(Window.orderBy("h", "k")))
    return ranked.filter(F.col("r") == F.col("need")).select(F.struct("h", "k").alias("cut")).scalar()


def within_threshold(key: str, seed: int, threshold: Column) -> Column:
    """True for rows up to the threshold; false for all rows when nothing was wanted."""
    mine = F.struct(hash_key(key, seed).alias("h"), F.col(key).alias("k"))
    return F.coalesce(mine <= threshold, F.lit(False))


def hash_rank(ids: DataFrame, key: str, seed: int, within: Sequence[str] = (), output: str = "rank") -> DataFrame:
    """Append the 1-based position in hash order, per group of ``within``.

    Rows are numbered inside hash buckets, which stay even however large a group is; the
    bucket offsets are at most 65,536 rows per group.
    """
    bucketed = ids.withColumn("_h", hash_key(key, seed)).withColumn("_b", _hash_bucket(F.col("_h")))
    group = [*within, "_b"]
    sizes = bucketed.groupBy(*group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*within).orderBy("_b")) - F.col("_n")
    offsets = sizes.select(*group, before.alias("_before"))
    position = F.row_number().over(Window.partitionBy(*group).orderBy("_h", key))
    return (
        bucketed.withColumn("_r", position)
        .join(offsets, group, "inner")
        .withColumn(output, (F.col("_before") + F.col("_r")).cast("long"))
        .drop("_h", "_b", "_n", "_r", "_before")
    )


def ordered_index(df: DataFrame, key: str, output: str = "idx") -> DataFrame:
    """Append the 0-based position of a unique key in its natural order.

    Rows are range partitioned, the placement is written out so that it is fixed, and each
    part is numbered from its own offset.
    """
    placed = materialize(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ordered")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    position = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    # One offset row per part, so this side is far smaller than the table it numbers.
    return (
        placed.withColumn("_r", position)
        .join(F.broadcast(offsets), "_p")
        .withColumn(output, (F.col("_before") + F.col("_r")).cast("long"))
        .drop("_p", "_r", "_before")
    )
