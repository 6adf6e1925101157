"""Scores of whole documents by a gated recurrent language model, next to those of a unigram base.

Counts: every word of every training document (those with crc32 of the id mod 7 not 2), plus one end per document. The
``KNOWN`` most frequent words go to the tasks as a table of that fixed size; all other words meet their counts in a join,
where none of them can be hot, as none has more than 1/KNOWN of the tokens.

Network: its words are those with at least one in ``SHARE`` of the training tokens, so they follow the corpus and are fewer
than SHARE at any size. Every other word, seen or not, is read and predicted as one of ``BUCKETS`` hash classes, inside which
it has its add-one unigram share; the classes together with the words cover all tokens, so the model gives every text a
proper probability over known and unknown words.

Training: texts become word ids once. Each training document is dealt by a hash of its id and text to one of ``ROUNDS``
rounds and, inside it, to a learner; there are as many learners as give each about ``LEARNER`` tokens a round. A learner
starts from the common weights, trains on its documents in hash order and leaves its change of the weights; the changes
are averaged by tokens in a tree of tasks. So each training document is learned once, the work grows with the corpus, and
the model does not depend on files or partitions. Scoring carries the state from window to window over whole documents.

Null or empty text: the end alone. Null ``doc_id``: the empty string's crc, so a training document. Rows with one id and
one text get one score each. No training document: every word is unknown and the base is 0 for each. Empty table: no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.gru import Network, Trainer, score
from docsieve.session import materialize

KNOWN = 65_536  # words with counts in every task
SHARE = 32_768  # a word of the network has at least one in so many training tokens
BUCKETS = 1_024  # hash classes of all other words
ROUNDS = 8
LEARNER = 400_000  # training tokens of a learner in a round, on average
END = b" "  # the end token: no word holds a blank
HELD_OUT = (7, 2)
COUNTED = 3_000_000  # words a task counts before it hands their counts on
CHUNK = 1_000_000  # tokens of the documents a learner works on at a time
SCORED = 4_000_000  # tokens of the documents scored at a time, of which the longest runs on alone
SLICE = 1 << 24  # bytes of the texts split into words at a time, beyond the first
FAN_IN = 32  # changes averaged by a task


def training(doc_id: str = "doc_id"):
    divisor, rest = HELD_OUT
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % divisor != rest


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts are about SLICE bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    edges = [*np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE, prepend=-1)).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has: those of ``text.python_words``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # blanks at the ends leave empty strings
    owners = np.repeat(np.arange(len(texts)), lengths)[real]
    return words.filter(pa.array(real)), np.bincount(owners, minlength=len(texts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, ends = [], 0, 0

    def out() -> pa.RecordBatch:
        found = pa.chunked_array(held, pa.string()).value_counts()
        held.clear()
        return pa.RecordBatch.from_pydict({"word": found.field("values").cast(pa.binary()), "n": found.field("counts")})

    for batch in batches:
        for part in _slices(batch):
            held.append(split_words(part.column("text"))[0])
            size += len(held[-1])
            if size >= COUNTED:
                yield out()
                size = 0
        ends += batch.num_rows
    if held:
        yield out()
    if ends:
        yield pa.RecordBatch.from_pydict({"word": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())})


class Lexicon:
    """The most frequent words with their counts, the words of the network, and what is common to all words."""

    def __init__(self, top: list[tuple[bytes, int]], tokens: int, distinct: int, share: int, bucket_weights: np.ndarray):
        """``bucket_weights``: for each hash class, counts plus one of all its words."""
        self.ids = {w: i for i, (w, _) in enumerate(top)}
        self.words = pa.array([w for w, _ in top], pa.binary())
        counts = np.array([n for _, n in top] + [0], dtype=np.int64)
        self.log_counts = np.log10(counts + 1.0)
        self.tokens, self.distinct, self.buckets = tokens, distinct, len(bucket_weights)
        self.size = int((counts[:-1] * share >= tokens).sum())
        # Words of the network leave their hash classes; an unseen word adds its one to each.
        rest = bucket_weights.astype(np.float64) + 1
        own = np.array([zlib.crc32(w) % self.buckets for w, _ in top], dtype=np.int64)
        np.subtract.at(rest, own[: self.size], counts[: self.size] + 1)
        self.network_ids = np.append(np.where(np.arange(len(top)) < self.size, np.arange(len(top)), self.size + own), -1).astype(np.int32)
        self.weights = np.append(counts[: self.size] + 1.0, rest)
        # What a word outside the network adds to the log of its class, its own count apart.
        self.log_weights = np.append(np.zeros(self.size), np.log10(rest))

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of the words and the end of each text: where each text starts; places in the table, -1 outside it; ids for the network; and
        the words outside the table."""
        words, lengths = split_words(texts)
        ends = np.cumsum(lengths + 1) - 1
        inner = np.ones(len(words) + len(texts), dtype=bool)
        inner[ends] = False
        words = pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())])
        at = np.full(len(inner), len(words) - 1)
        at[inner] = np.arange(len(words) - 1)
        places = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)[at]
        ids, missing = self.network_ids[places], np.flatnonzero(places < 0)
        rare = words.take(pa.array(at[missing]))
        ids[missing] = [self.size + zlib.crc32(w) % self.buckets for w in rare.to_pylist()]
        return ends - lengths, places, ids, rare

    def network(self) -> Network:
        return Network.untrained(self.weights)


IDS = (
    "doc_id long, version long, held_out boolean, n_tokens long, n_known long, base double, inside double, rare array<binary>, ids binary"
)


def id_type(words: int) -> type:
    """What the ids of so many words are kept in: half the bytes where they fit."""
    return np.uint16 if words <= 1 << 16 else np.int32


def _read(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Each text as word ids, with what its counts say: sums of logs of the counts (``base``) and of shares in hash classes (``inside``)."""
    kind = id_type(len(lexicon.weights))
    for batch in batches:
        for part in _slices(batch):
            starts, places, ids, rare = lexicon.read(part.column("text"))
            logs, outside = lexicon.log_counts[places], places < 0
            inside = np.where(ids >= lexicon.size, logs - lexicon.log_weights[ids], 0.0)
            edges, n_rare = np.append(starts, len(ids)), np.add.reduceat(outside, starts, dtype=np.int64)
            rows = pa.array((edges * np.dtype(kind).itemsize).astype(np.int64)).buffers()[1]
            held = {
                "n_tokens": np.diff(edges), "n_known": np.diff(edges) - n_rare,
                "base": np.add.reduceat(logs, starts), "inside": np.add.reduceat(inside, starts),
                "rare": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)), pa.int32()), rare),
                "ids": pa.Array.from_buffers(pa.large_binary(), len(starts), [None, rows, pa.py_buffer(ids.astype(kind))]).cast(pa.binary()),
            }
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("doc_id", "version", "held_out")} | held)


CHANGE = "tokens double, change binary, sums binary"


def _learn(batches: Iterator[pa.RecordBatch], net: Network, sums: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by learner: the change of the weights that each makes, and its sums of squares."""
    start, learner, trainer, texts, size, total, kind = net.flat(), None, None, [], 0, 0, id_type(net.start)

    def train() -> None:
        nonlocal texts, size, total
        trainer.train(texts)
        texts, size, total = [], 0, total + size

    def out() -> pa.RecordBatch:
        train()
        change = (trainer.net.flat() - start).astype(np.float16)
        return pa.RecordBatch.from_pydict(
            {"tokens": [float(total)], "change": [change.tobytes()], "sums": [trainer.sums().astype(np.float32).tobytes()]}
        )

    for batch in batches:
        for own, ids in zip(batch.column("learner").to_pylist(), batch.column("ids"), strict=True):
            if own != learner:
                if trainer is not None:
                    yield out()
                learner, trainer, total = own, Trainer(net.like(start), sums), 0
            texts.append(np.frombuffer(ids.as_py(), dtype=kind))
            size += len(texts[-1])
            if size >= CHUNK:
                train()
    if trainer is not None:
        yield out()


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, means = 0.0, [0.0, 0.0]
    kinds = (np.float16, np.float32)
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("tokens", "change", "sums")), strict=True):
            tokens = row[0].as_py()
            total += tokens
            for i, kind in enumerate(kinds):
                own = np.frombuffer(row[i + 1].as_py(), dtype=kind).astype(np.float64)
                means[i] = means[i] + (own - means[i]) * (tokens / total)
    if total:
        change, sums = (m.astype(kind).tobytes() for m, kind in zip(means, kinds, strict=True))
        yield pa.RecordBatch.from_pydict({"tokens": [total], "change": [change], "sums": [sums]})


def average(changes: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The mean change and sums of squares by tokens; each task reads FAN_IN rows, and the driver gets one."""
    while rows > 1:
        rows = -(-rows // FAN_IN)
        changes = materialize(changes.coalesce(rows).mapInArrow(_mean, CHANGE), "mean")
    found = changes.first()
    return None if found is None else (
        np.frombuffer(found["change"], dtype=np.float16).astype(np.float32), np.frombuffer(found["sums"], dtype=np.float32)
    )


def train_network(texts: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, learner: int = LEARNER) -> Network:
    """``texts``: ``doc_id``, ``version`` and ``ids`` of the training documents."""
    sc, net, sums = texts.sparkSession.sparkContext, lexicon.network(), None
    learners = max(1, round(lexicon.tokens / max(rounds, 1) / learner))
    place = F.xxhash64("doc_id", "version")
    for r in range(rounds):
        now = sc.broadcast((net, sums))
        dealt = texts.filter(F.pmod(place, F.lit(rounds)) == r).select(
            F.pmod(F.xxhash64(place, F.lit(r)), F.lit(learners)).cast("int").alias("learner"), place.alias("at"), "ids"
        )
        dealt = dealt.repartitionById(learners, F.col("learner")).sortWithinPartitions("learner", "at")
        changes = materialize(dealt.mapInArrow(lambda b, now=now: _learn(b, *now.value), CHANGE), "changes")
        mean = average(changes, learners)
        if mean is not None:
            net, sums = net.like(net.flat() + mean[0]), mean[1]
    return net


def _score(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    def out(held: list[pa.RecordBatch], texts: list[np.ndarray]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        model = score(net, texts) / math.log(10) + table.column("inside").to_numpy()
        made = table.drop_columns(["inside"]).append_column("model", pa.array(model, pa.float64()))
        return made.to_batches()[0]

    held, texts, size, kind = [], [], 0, id_type(net.start)
    for batch in batches:
        own = [np.frombuffer(ids.as_py(), dtype=kind) for ids in batch.column("ids")]
        held, texts, size = [*held, batch.drop_columns(["ids"])], texts + own, size + sum(map(len, own))
        if size >= SCORED:
            yield out(held, texts)
            held, texts, size = [], [], 0
    if texts:
        yield out(held, texts)


SCORES = "doc_id long, version long, held_out boolean, n_tokens long, n_known long, base double, model double"


def most_frequent(counts: DataFrame, known: int) -> list[tuple[bytes, int]]:
    """The ``known`` most frequent words, ties by the word.

    A histogram of the counts on a scale of 16 steps to a doubling (a thousand rows at most) gives a bound that few more
    words reach, so tasks send those and not a full list each.
    """
    step = F.floor(16 * F.log2("n"))
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)
    bound, total = 0, 0
    for row in steps:
        bound, total = row["step"], total + row["words"]
        if total >= known:
            break
    rows = counts.filter(step >= bound).orderBy(F.desc("n"), "word").limit(known).collect()
    return [(bytes(r["word"]), r["n"]) for r in rows]


def lm_scores(
    docs: DataFrame, known: int = KNOWN, share: int = SHARE, buckets: int = BUCKETS, rounds: int = ROUNDS, learner: int = LEARNER
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(
        own.filter(training()).select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts"
    )
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    weights = np.zeros(buckets, dtype=np.int64)
    for row in counts.groupBy((F.crc32("word") % buckets).alias("b")).agg(F.sum(F.col("n") + 1).alias("w")).collect():
        weights[row["b"]] = row["w"]
    lexicon = Lexicon(most_frequent(counts, known), size["tokens"], size["distinct"], share, weights)
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(lexicon)
    rows = own.select("doc_id", F.xxhash64("text").alias("version"), (~training()).alias("held_out"), "text")
    texts = materialize(rows.mapInArrow(lambda b: _read(b, words.value), IDS), "ids")
    net = sc.broadcast(train_network(texts.filter(~F.col("held_out")), lexicon, rounds, learner))
    scored = materialize(texts.drop("rare").mapInArrow(lambda b: _score(b, net.value), SCORES), "scores")
    rare = texts.select("doc_id", "version", "rare").dropDuplicates(["doc_id", "version"]).select("doc_id", "version", F.explode("rare").alias("word"))
    found = rare.join(counts, "word").groupBy("doc_id", "version").agg(
        F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more")
    ).select(F.col("doc_id").alias("id"), F.col("version").alias("v"), "more_known", "more")
    joined = scored.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("v")), "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * math.log10(lexicon.tokens + lexicon.distinct + 1)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
