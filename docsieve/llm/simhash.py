"""SimHash near-duplicates: fingerprints within a few bits, found by a Gray-order hierarchical index, and their components.

Fingerprint: A-Z in lower case, words between blanks, every 3-word shingle with its repeats (fewer words: the whole
sequence; no word: fingerprint zero), XXH64 with seed 42; a bit is 1 if set in over half the hashes.

Equal fingerprints are one node, so copies cost nothing after the first grouping. Two fingerprints within d bits agree on
one of d + 1 blocks of bits, so each node goes to d + 1 groups, one per block. A group with more than ``GROUP_ROWS`` nodes
is cut again the same way on the bits that are still free; after four cuts 13 bits or fewer are free, which bounds a
group by 2^13 whatever the data. Inside a task the nodes of each group are sorted by Gray rank, which puts fingerprints
that share bits side by side; upper nodes of the index hold the bits that all below share, and a search adds up the
differences on its way down and leaves a node as soon as they exceed d. Only a spanning link of each found component
leaves the task, never its pairs.

Null text: no word. Null ``doc_id``: the row is linked like any other and never gives a component its id. Rows with the
same id are each returned. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.graph import components
from docsieve.llm.text import packed, python_words
from docsieve.session import materialize

SEED = 42
BITS = 64
GROUP_ROWS = 2048  # larger groups are cut again
CUTS = 4
FAN_OUT = 8  # children of an index node
QUERY_ROWS = 2048  # fingerprints that go down the index together
TASK_ROWS = 200_000  # fingerprints indexed at a time inside a task
SHINGLE_BLOCK = 1 << 16


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """The unsigned fingerprint of a word sequence."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, SHINGLE_BLOCK):
        part = words[start : min(n, start + SHINGLE_BLOCK) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(
            (fingerprint(python_words(t.as_py()), width) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows
        )
        own = pa.array(prints.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), own], ["doc_id", "version", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id``, ``version`` (a hash of the text) and ``fp`` (the 64 bits as a signed long)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return own.mapInArrow(lambda batches: _fingerprints(batches, width), "doc_id long, version long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _blocks(mask: int, parts: int) -> list[int]:
    """``mask`` with one more block of its free bits, for each of ``parts`` blocks."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


def candidate_groups(prints: DataFrame, distance: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``mask``, ``key`` and ``fp``: groups that agree on the bits of a mask, such that every near pair shares one."""
    rows, masks, done = prints.select("fp", F.lit(0).cast("long").alias("mask")), [0], []
    for cut in range(CUTS):
        finer = {m: _blocks(m, distance + 1) for m in masks}
        masks = sorted({x for b in finer.values() for x in b})
        blocks = F.create_map(*[
            x for m, b in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(y)).cast("long") for y in b]))
        ])
        # With few rows to cut again, a plan over all masks is still one projection.
        rows = rows.select("fp", F.explode(blocks[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        if cut:
            rows = rows.distinct()
        sizes = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
        last = cut == CUTS - 1
        fits = sizes if last else sizes.filter(F.col("n") <= group_rows)
        done.append(rows.join(fits.drop("n"), ["mask", "key"]).select("mask", "key", "fp"))
        large = sizes.filter(F.col("n") > group_rows)
        if last or large.isEmpty():
            break
        rows = materialize(rows.join(large.drop("n"), ["mask", "key"]).select("fp", "mask"), "large")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


class Forest:
    """Union-find over 0..n-1 in numpy; roots are the least members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            top = self.roots()
            high, low = np.maximum(top[a], top[b]), np.minimum(top[a], top[b])
            apart = high != low
            a, b = high[apart], low[apart]
            np.minimum.at(self.parent, a, b)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in order of group and Gray rank, under levels of nodes that hold the bits shared by all below them."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        full = np.full(len(codes), np.uint64(2**64 - 1))
        self.codes, self.group = codes, group
        self.levels = [(codes, full, group, group)]
        while len(self.levels[-1][0]) > FAN_OUT:
            pattern, mask, low, high = self.levels[-1]
            starts = np.arange(0, len(pattern), FAN_OUT)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ first), starts)
            self.levels.append((pattern[starts] & shared, shared, np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def near(self, rows: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, later row) of the same group that differ in ``distance`` bits or fewer."""
        top = len(self.levels[-1][0])
        query, node = np.repeat(rows, top), np.tile(np.arange(top), len(rows))
        gone = np.zeros(len(query), dtype=np.int64)
        seen = np.zeros(len(query), dtype=np.uint64)  # bits that the differences so far are about
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask, low, high = self.levels[depth]
            if depth < len(self.levels) - 1:
                child = node[:, None] * FAN_OUT + np.arange(FAN_OUT)
                inside = child < len(pattern)
                query, gone, seen = (np.repeat(x, FAN_OUT)[inside.ravel()] for x in (query, gone, seen))
                node = child[inside]
            own = self.group[query]
            # Only the node's last row decides whether anything after the query is below it.
            live = (low[node] <= own) & (own <= high[node]) & ((node + 1) * FAN_OUT**depth - 1 > query)
            query, node, gone, seen = query[live], node[live], gone[live], seen[live]
            gone = gone + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node] & ~seen)
            seen = mask[node]
            live = gone <= distance
            query, node, gone, seen = query[live], node[live], gone[live], seen[live]
        return query, node


def spanning_links(group: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, root code) that hold together all codes of a group within ``distance`` steps of each other."""
    order = np.lexsort((gray_rank(codes), group))
    group, codes = group[order], codes[order]
    index, forest = GrayIndex(group, codes), Forest(len(codes))
    for start in range(0, len(codes), QUERY_ROWS):
        forest.join(*index.near(np.arange(start, min(len(codes), start + QUERY_ROWS)), distance))
    top = forest.roots()
    linked = top != np.arange(len(codes))
    return codes[linked], codes[top[linked]]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups are indexed together, about TASK_ROWS rows at a time."""

    def made(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            fresh = np.append(True, np.any(rows[1:, :2] != rows[:-1, :2], axis=1))
            a, b = spanning_links(np.cumsum(fresh), rows[:, 2].view(np.uint64), distance)
            yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp")], axis=1))
        count += batch.num_rows
        if count >= TASK_ROWS:
            rows = np.ascontiguousarray(np.concatenate(held))
            inside = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
            cut = inside[-1] + 1 if len(inside) else 0
            yield from made(np.ascontiguousarray(rows[:cut]))
            held, count = [rows[cut:]], len(rows) - cut
    if held:
        yield from made(np.ascontiguousarray(np.concatenate(held)))


def near_components(prints: DataFrame, distance: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``fp`` and ``root`` for every fingerprint linked to a smaller one; ``prints`` holds distinct fingerprints."""
    groups = candidate_groups(prints, distance, group_rows).repartition("mask", "key").sortWithinPartitions("mask", "key")
    links = groups.mapInArrow(lambda batches: _links(batches, distance), "a long, b long")
    return components(links).select(F.col("node").alias("fp"), "root")


def _grouped(own: DataFrame, distance: int) -> DataFrame:
    """``fp``, ``component_id`` and ``head`` (the first document: id and version) of each distinct fingerprint of ``own``."""
    # Documents without an id come after all others.
    head = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "version")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(head).alias("head")), "nodes")
    linked = near_components(nodes.select("fp"), distance)
    rooted = nodes.join(linked, "fp", "left").select("fp", "first", "head", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min("head").alias("head"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id", "head")


def simhash(docs: DataFrame, distance: int = 2, width: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable by links)."""
    own = materialize(fingerprints(docs, width), "prints")
    known = materialize(_grouped(own, distance).select("fp", "component_id"), "components")
    return own.join(known, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_rows(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the ``doc_id`` and ``version`` of ``heads``, with all their columns."""
    named = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"))
    own = packed(docs, "doc_id", "text").select(named.alias("name"), "document")
    heads = heads.select(F.struct("doc_id", "version").alias("head"))
    # Rows that repeat an id and a text are one document.
    kept = own.join(heads, F.col("name").eqNullSafe(F.col("head"))).dropDuplicates(["name"])
    return kept.select(*[F.col(f"document.`{c}`").alias(c) for c in docs.columns])


def keep_first(docs: DataFrame, distance: int = 2, width: int = 3) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the smallest id, then the smallest hash of the text."""
    own = materialize(fingerprints(docs, width), "prints")
    heads = materialize(_grouped(own, distance).select("head.doc_id", "head.version").distinct(), "heads")
    return first_rows(docs, heads)
