"""Line deduplication over the corpus, in DataFrame operations only.

A line's key is the line without blanks at its ends, A-Z in lower case. A key of at least ``min_chars`` code points found
in at least ``min_docs`` documents keeps its lines in the document with the largest ``doc_id`` only.

Only hashes of keys with their document and position are shuffled. The 128-bit hashes are cut into ranges, each range is
sorted by hash, document and position, and one pass over it ranks the documents of each key: the first document of a key
stays, the later ones go if there are enough. What comes back to a document is its keep bitmap, compressed as runs of
dropped positions; texts are read once more to apply it.

A key with more than 1/4096 of all rows (at most 4,096 such keys, so they are broadcast) never meets in one task: its
two facts, how many documents and which is the largest, come from an aggregate with map-side combining.

Null or empty text: one empty line. Null ``doc_id``: the smallest id. Rows with the same id are one document where
documents are counted, and each row is returned. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.text import BLANK_CHARS, ascii_lower, filled, packed
from docsieve.session import materialize

HEAVY_PARTS = 4096  # a key is heavy from this part of all rows on, so there are no more heavy keys than this
RANGE_BITS = 16  # hash ranges that tasks share out


def _lines(text: Column) -> Column:
    return F.split(filled(text), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each long line: the hash of its key, its document (id and text hash) and its position."""
    lines = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.select("doc", "version", "pos", F.btrim("line", F.lit(BLANK_CHARS)).alias("line")).filter(
        F.char_length("line") >= min_chars
    )
    lowered = keyed.withColumn("line", ascii_lower(F.col("line")))
    return lowered.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "version", "pos"
    )


def dropped_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """The rows of ``lines`` whose line goes."""
    lines = materialize(lines, "lines")
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    # At most HEAVY_PARTS keys can pass this filter.
    heavy = materialize(counts.filter(F.col("n") * HEAVY_PARTS > lines.count()).select("h1", "h2"), "heavy")
    document = F.coalesce(F.col("doc"), F.lit(-(2**63)))

    common = lines.join(F.broadcast(heavy), ["h1", "h2"], "left_semi")
    facts = common.select("h1", "h2", document.alias("d")).distinct().groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.max("d").alias("top")
    )
    goes = facts.filter(F.col("n") >= min_docs).select("h1", "h2", "top")
    gone = common.join(F.broadcast(goes), ["h1", "h2"]).filter(document != F.col("top"))

    ranged = lines.join(F.broadcast(heavy), ["h1", "h2"], "left_anti").withColumn(
        "range", F.shiftrightunsigned("h1", 64 - RANGE_BITS)
    )
    key = Window.partitionBy("range", "h1", "h2")
    ranked = ranged.repartition("range").withColumn("rank", F.dense_rank().over(key.orderBy(document.desc())))
    rare = ranked.withColumn("n", F.max("rank").over(key)).filter((F.col("rank") > 1) & (F.col("n") >= min_docs))
    columns = ("doc", "version", "pos")
    return gone.select(*columns).unionByName(rare.select(*columns))


def as_runs(positions: Column) -> Column:
    """Sorted positions as runs of start and length: a bitmap in run-length form."""
    first = F.filter(positions, lambda p, i: (i == 0) | (F.get(positions, i - 1) != p - 1))
    last = F.filter(positions, lambda p, i: (i == F.size(positions) - 1) | (F.get(positions, i + 1) != p + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """One row per document that loses lines: the dropped runs of its keep bitmap."""
    by_document = dropped.groupBy("doc", "version").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    return by_document.select("doc", F.col("version").alias("doc_version"), as_runs(F.col("p")).alias("dropped_runs"))


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``document`` (all input columns), ``doc_id``, ``n_lines``, ``n_dropped``, ``dropped_runs`` and ``kept`` (the text left)."""
    own = packed(docs, "doc_id", "text")
    bitmaps = keep_bitmaps(dropped_lines(line_hashes(own, min_chars), min_docs))
    joined = own.withColumn("version", F.xxhash64("text")).join(
        bitmaps, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("version") == F.col("doc_version")), "left"
    )
    # Named columns that several expressions read: they are made once a row, not once for each line.
    cut = joined.withColumn("lines", _lines(F.col("text"))).withColumn("all", F.sequence(F.lit(0), F.size("lines") - 1))
    runs = F.col("dropped_runs")
    gone = F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    stay = F.array_except("all", gone)
    n_lines, n_dropped = F.size("lines").cast("long"), F.when(runs.isNull(), 0).otherwise(F.size(gone)).cast("long")
    kept = F.when(runs.isNull(), filled("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    )
    return cut.select(
        "document", "doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), runs.alias("dropped_runs"), kept.alias("kept")
    )
