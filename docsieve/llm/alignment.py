"""Alignment of two tokenizers over a corpus: token groups with common ends, and how often two tokens are linked.

A document is read as one space and its text. Tokens of A (byte-level BPE) and of B (pieces, with the space that B adds)
cover the same bytes; where both have an end, a group ends. A link is an A token and a B token whose bytes overlap. The
count of a pair of ids is the number of documents that hold it linked.

Texts are shuffled whole, so each distinct text is tokenised and aligned once, whatever the number of its copies; its pairs
count as often as it has copies, and its measures go back to the documents by hash. Ends that follow each other cut the bytes
into segments, each in one token of A and one of B, so a text has as many links as segments. Pair counts are a table, in the
end joined to the pairs of every text: those with the greatest counts, at most ``FREQUENT``, are looked up in a broadcast
array, which takes most links and all hot keys; all others are joined by a shuffle.

Null or empty text, or one whose tokens of A or B do not join to its bytes: no tokens, zeros and an empty hash. Special
tokens inside a text are plain text. Null ids stay; repeated rows are documents of their own. Long texts are tokenised in
slabs cut at single spaces, where neither tokenizer has a token across. Empty table: no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.session import materialize

FREQUENT = 1 << 19  # pairs in the broadcast array, at most
SLAB = 1 << 20  # characters tokenised at a time, up to the next cut
HELD_PAIRS = 1 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
STEPS = 16  # histogram steps for each doubling of a count

# Fixed value: how byte-level BPE with a pattern of its own splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Side(NamedTuple):
    """One tokenizer: ids of a text, and the bytes of each id."""

    encode: Callable[[str], list[int]]
    entries: list[bytes]


def byte_letters() -> dict[str, int]:
    """The character that byte-level BPE shows for each byte: itself where it prints, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


def byte_side(file: bytes) -> Side:
    """The byte-level tokenizer of a tokenizers file; with the faster library where its ids are its merge ranks."""
    model, letters = json.loads(file), byte_letters()
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    special = {t["content"] for t in model["added_tokens"]}
    entries = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]))
    for token, number in vocab.items():
        if token not in special:
            entries[number] = bytes(letters[c] for c in token)
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    ranked = made == list(range(256, 256 + len(made))) and sum(map(bool, entries)) == 256 + len(made)
    if ranked and model["pre_tokenizer"] == plain and model["normalizer"] is None:
        ranks = {entry: number for number, entry in enumerate(entries) if entry}
        return Side(tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, entries)
    own = tokenizers.Tokenizer.from_buffer(file)
    own.encode_special_tokens = True
    return Side(lambda text: own.encode(text, add_special_tokens=False).ids, entries)


def piece_side(file: bytes) -> Side:
    """The tokenizer of a SentencePiece file; it adds the first space itself."""
    own = sentencepiece.SentencePieceProcessor(model_proto=file)
    entries = []
    for number in range(own.vocab_size()):
        piece = own.id_to_piece(number)
        entries.append(bytes([int(piece[3:5], 16)]) if own.is_byte(number) else piece.replace("▁", " ").encode())
    return Side(lambda text: own.encode(text[1:]), entries)


class Pair(NamedTuple):
    a: Side
    b: Side
    sizes: tuple[np.ndarray, np.ndarray]
    written: list[str]  # decimal ids, each followed by nothing, a comma, a bar and a semicolon


@lru_cache(maxsize=2)
def _pair(a: bytes, b: bytes) -> Pair:
    sides = byte_side(a), piece_side(b)
    sizes = tuple(np.array([len(e) for e in s.entries], dtype=np.int64) for s in sides)
    most = max(map(len, sizes))
    return Pair(*sides, sizes, [f"{n}{mark}" for mark in ("", ",", "|", ";") for n in range(most)])


def _slabs(text: str) -> Iterator[str]:
    """``text``, which begins with a space, in parts that begin with one."""
    start = 0
    while len(text) - start > SLAB and (cut := CUT.search(text, start + SLAB)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Aligned(NamedTuple):
    """One text: its tokens, where they end, and the ends they share."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    shared: np.ndarray


def align(text: str | None, pair: Pair) -> Aligned:
    """Both tokenizations of a space and ``text``; without tokens if one of them does not join to it."""
    none = np.zeros(0, dtype=np.int64)
    if not text:
        return Aligned(none, none, none, none, none)
    whole, ids = " " + text, ([], [])
    for slab in _slabs(whole):
        for side, own in zip((pair.a, pair.b), ids, strict=True):
            own.extend(side.encode(slab))
    data = whole.encode("utf-8", "surrogatepass")
    if any(b"".join(map(side.entries.__getitem__, own)) != data for side, own in zip((pair.a, pair.b), ids, strict=True)):
        return Aligned(none, none, none, none, none)
    a, b = (np.array(own, dtype=np.int64) for own in ids)
    ends_a, ends_b = (np.cumsum(sizes[own]) for sizes, own in zip(pair.sizes, (a, b), strict=True))
    return Aligned(a, b, ends_a, ends_b, np.intersect1d(ends_a, ends_b, assume_unique=True))


def links(one: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B token of each link: every segment between two ends lies in one of each."""
    ends = np.union1d(one.ends_a, one.ends_b)
    return np.searchsorted(one.ends_a, ends), np.searchsorted(one.ends_b, ends)


def written(one: Aligned, pair: Pair) -> str:
    """The groups as text: ids of A, a bar, ids of B; groups parted by semicolons."""
    n = len(pair.written) // 4
    group_a, group_b = np.searchsorted(one.shared, one.ends_a), np.searchsorted(one.shared, one.ends_b)
    out = np.empty(len(one.a) + len(one.b), dtype=np.int64)
    # An A token comes after all B tokens of earlier groups, a B token after all A tokens of its own.
    before_b = np.searchsorted(group_b, group_a)
    before_a = np.searchsorted(group_a, group_b, side="right")
    out[np.arange(len(one.a)) + before_b] = one.a + n * np.where(one.ends_a == one.shared[group_a], 2, 1)
    out[np.arange(len(one.b)) + before_a] = one.b + n * np.where(one.ends_b == one.shared[group_b], 3, 1)
    if len(out):
        out[-1] -= 3 * n
    return "".join(map(pair.written.__getitem__, out.tolist()))


TEXT_SCHEMA = pa.schema([
    ("digest", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
])
TEXT_COLUMNS = (
    "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<int>"
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def aligned_texts(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """One row for each distinct text with tokens: hash, copies, measures, and its distinct id pairs with their times.

    A pair is one number: id of A times the number of B's entries, plus id of B.
    """
    files = docs.sparkSession.sparkContext.broadcast((a, b))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        rows, held = [], 0
        for batch in batches:
            for text, copies in zip(batch.column("text"), batch.column("copies").to_pylist(), strict=True):
                text = text.as_py()
                one = align(text, pair)
                if not len(one.a):
                    continue
                in_a, in_b = links(one)
                pairs, times = np.unique(one.a[in_a] * len(pair.b.entries) + one.b[in_b], return_counts=True)
                sha = hashlib.sha256(written(one, pair).encode()).hexdigest()
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                rows.append((digest, copies, len(one.a), len(one.b), len(one.shared), len(in_a), sha, pairs, times))
                held += len(pairs)
                if held > HELD_PAIRS:
                    yield _batch(rows, TEXT_SCHEMA)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, TEXT_SCHEMA)

    distinct = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return distinct.mapInArrow(measured, TEXT_COLUMNS)


def pair_counts(texts: DataFrame, entries_b: int) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``best`` (whether no pair of its A id has more)."""
    counts = materialize(texts.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n")), "pairs")
    own = (F.col("pair") / entries_b).cast("long")
    # One row for each id of A: bounded by the vocabulary.
    most = F.broadcast(counts.groupBy(own.alias("a")).agg(F.max("n").alias("most")))
    return counts.join(most, own == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_pairs(judged: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs with the greatest counts, at most ``frequent``, sorted, with their counts and whether they are best."""
    step = F.floor(F.log2("n") * STEPS).alias("step")
    histogram = judged.groupBy(step).count().orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in histogram:
        total += row["count"]
        if total > frequent:
            break
        least = row["step"]
    rows = judged.filter(F.floor(F.log2("n") * STEPS) >= least if least is not None else F.lit(False)).toArrow()
    pairs, n, best = (rows.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return pairs[order], n[order], best[order].astype(np.int64)


SUMS = ("n_a", "n_b", "n_groups", "n_links")


def alignment(docs: DataFrame, a_file: str, b_file: str, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every document."""
    a, b = (open(path, "rb").read() for path in (a_file, b_file))
    spark = docs.sparkSession
    texts = materialize(aligned_texts(docs, a, b), "texts")
    judged = materialize(pair_counts(texts, len(piece_side(b).entries)), "judged")
    known = spark.sparkContext.broadcast(frequent_pairs(judged, frequent))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            offsets = batch.column("pairs").offsets.to_numpy().astype(np.int64)
            own, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "times"))
            offsets -= offsets[0]
            place = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
            hit = pairs[place] == own if len(pairs) else np.zeros(len(own), dtype=bool)
            part = lambda values: np.diff(np.append(0, np.cumsum(values))[offsets])
            weight = np.where(hit, n[place] if len(n) else 0, 0) * times
            good = np.where(hit, best[place] if len(n) else 0, 0) * times
            left = np.append(0, np.cumsum(~hit))[offsets].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(v[~hit])) for v in (own, times)]
            kept = [batch.column(c) for c in ("digest", *SUMS, "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(part(good)), pa.array(part(weight)), *rest],
                ["digest", *SUMS, "groups_sha256", "n_best", "count_sum", "pairs", "times"],
            )

    first = materialize(texts.drop("copies").mapInArrow(
        looked_up, "digest binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, "
        "pairs array<long>, times array<long>"
    ), "looked")
    rare = first.select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("digest", "link.pairs", "link.times")
    found = rare.join(judged, rare["pairs"] == judged["pair"]).groupBy("digest").agg(
        F.sum(F.col("best").cast("long") * F.col("times")).alias("rare_best"), F.sum(F.col("n") * F.col("times")).alias("rare_sum")
    )
    whole = first.drop("pairs", "times").join(found, "digest", "left").select(
        "digest", *SUMS, "groups_sha256", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"),
    )
    names = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in (*SUMS, "n_best", "count_sum")]
    return names.join(whole, "digest", "left").select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
