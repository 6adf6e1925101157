"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The texts of a batch become one array of code points, cut wherever two neighbours are adjacent in no piece (so at every
start of a word); a segmentation never crosses such a cut. Distinct words are taken once. Words of equal length advance
together: at each end position all substrings that may be a piece are probed by hash in the sorted piece keys, and the
best candidate of each word becomes its backpointer.

Candidates are weighed as the model file says. In a unigram model the sum of piece scores decides. In a BPE model the
merges of a prefix decide: a candidate is possible only if it and the piece before it would not have merged across their
border, which leaves exactly one at each position; a table of each piece's last merge answers that for all pairs at once.
Both give the ids of the library (the tests compare them).

A code point outside the pieces becomes its UTF-8 byte pieces, or the unknown piece if there are none. Null and empty
texts: no ids. Decoding maps an empty or null list to an empty text, ids out of range to nothing, broken bytes to U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import packed

SPACE = "▁"  # fixed value: the sign that stands for a blank in pieces
STEP = np.uint64(0x9E3779B97F4A7C15)  # an odd factor for polynomial hashes
FILTER_BITS = 20
NEVER = np.int64(2**62)
BATCH_CHARS = 3_000_000  # code points segmented at a time


@dataclass
class Model:
    """Piece tables as arrays: all a task needs, and as large as the vocabulary."""

    kind: str  # unigram or bpe
    pieces: list[str]
    scores: np.ndarray
    plain: np.ndarray  # ids that text can contain
    byte_ids: np.ndarray  # id of each byte piece, -1 if there is none
    unknown: int
    text_of: list[bytes]

    def __post_init__(self) -> None:
        order = [int(i) for i in self.plain]
        self.longest = max(map(len, (self.pieces[i] for i in order)), default=1)
        keys = np.array([_hash_of(self.pieces[i]) for i in order], dtype=np.uint64)
        sort = np.argsort(keys)
        self.keys, self.key_ids = keys[sort], np.array(order, dtype=np.int64)[sort]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash; choose another factor")
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.chars = np.unique(np.array([ord(c) for i in order for c in self.pieces[i]], dtype=np.uint32))
        self.joined = np.zeros((len(self.chars) + 1, len(self.chars) + 1), dtype=bool)
        self.char_of = np.zeros(0x110000, dtype=np.uint16)
        self.char_of[self.chars] = np.arange(1, len(self.chars) + 1)
        ends = np.cumsum([len(t) for t in self.text_of])
        self.text_ends, self.text_bytes = ends, np.frombuffer(b"".join(self.text_of), dtype=np.uint8)
        place = {int(c): n for n, c in enumerate(self.chars, 1)}
        for i in order:
            codes = [place[ord(c)] for c in self.pieces[i]]
            self.joined[codes[:-1], codes[1:]] = True
        if self.kind == "bpe":
            self._merges(order)

    def _merges(self, order: list[int]) -> None:
        """The last merge of each piece built alone, when it happens, and the rank of each pair that makes a piece."""
        known = {self.pieces[i]: i for i in order}
        size = len(self.pieces)
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.time = np.full(size, -1, dtype=np.int64)
        rank = (-self.scores).astype(np.int64) - int((-self.scores[self.plain]).min(initial=0)) if order else self.scores
        self.alone = np.zeros(size, dtype=bool)
        for i in sorted(order, key=lambda i: len(self.pieces[i])):
            parts = list(self.pieces[i])
            while len(parts) > 1:
                made = [(rank[known[a + b]], n) for n, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in known]
                if not made:
                    break
                _, n = min(made)
                if len(parts) == 2:
                    a, b = known.get(parts[0], -1), known.get(parts[1], -1)
                    self.left[i], self.right[i] = a, b
                    self.time[i] = max(rank[i], self.time[a], self.time[b])
                parts[n : n + 2] = [parts[n] + parts[n + 1]]
            self.alone[i] = len(parts) == 1
        pairs = {}
        for i in order:
            piece = self.pieces[i]
            for cut in range(1, len(piece)):
                a, b = known.get(piece[:cut]), known.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = int(rank[i])
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        self.maybe_pair = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe_pair[self._pair_slot(self.pair_keys)] = True

    @staticmethod
    def _pair_slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * STEP >> np.uint64(64 - FILTER_BITS)).view(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece id of each substring hash, -1 if none."""
        found = np.full(hashes.shape, -1, dtype=np.int64)
        some = self.maybe[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        wanted = hashes[some]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found[some] = np.where(self.keys[at] == wanted, self.key_ids[at], -1)
        return found

    def _merge_rank(self, keys: np.ndarray) -> np.ndarray:
        """The rank of the piece that a pair makes; NEVER if it makes none."""
        rank = np.full(len(keys), NEVER)
        some = np.flatnonzero(self.maybe_pair[self._pair_slot(keys)])
        wanted = keys[some]
        spot = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        rank[some] = np.where(self.pair_keys[spot] == wanted, self.pair_ranks[spot], NEVER)
        return rank

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a, b in a row stay two pieces: no merge across their border comes before those inside them."""
        good = np.ones(len(a), dtype=bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            merge = self._merge_rank(x * len(self.pieces) + y)
            broken = (merge < until_x) & (merge <= until_y)
            good[at[broken]] = False
            tx, ty = self.time[x], self.time[y]
            live = ~broken & ((tx >= 0) | (ty >= 0))
            at, x, y, until_x, until_y, tx, ty = (v[live] for v in (at, x, y, until_x, until_y, tx, ty))
            back = tx > ty  # the later of the two is taken apart; equal pieces merge from the left
            until_x, until_y = np.where(back, tx, until_x), np.where(back, until_y, ty)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return good


def _hash_of(piece: str) -> np.uint64:
    value = 0
    for c in piece:
        value = (value * int(STEP) + ord(c) + 1) % 2**64
    return np.uint64(value)


def load_model(path: str) -> Model:
    """The tables of a SentencePiece model file with identity normalisation."""
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    size = own.get_piece_size()
    pieces = [own.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
    byte_ids = np.full(256, -1, dtype=np.int64)
    text_of = [p.replace(SPACE, " ").encode() for p in pieces]
    for i in range(size):
        if own.is_byte(i):
            byte_ids[int(pieces[i][1:-1], 16)] = i
            text_of[i] = bytes([int(pieces[i][1:-1], 16)])
        elif own.is_control(i):
            text_of[i] = b""
        elif own.is_unknown(i):
            text_of[i] = " ⁇ ".encode()
    scores = np.array([own.get_score(i) for i in range(size)])
    # BPE files rank their pieces by whole numbers; unigram files hold log probabilities.
    whole = np.array_equal(scores[plain], np.round(scores[plain])) if plain else True
    return Model("bpe" if whole else "unigram", pieces, scores, np.array(plain, dtype=np.int64), byte_ids, own.unk_id(), text_of)


def _split(model: Model, words: np.ndarray) -> np.ndarray:
    """Best pieces of equal-length words (rows of code points): ids at the end position of each piece, -1 elsewhere."""
    n, length = words.shape
    prefix = np.zeros((n, length + 1), dtype=np.uint64)
    powers = np.ones(model.longest + 1, dtype=np.uint64)
    for k in range(model.longest):
        powers[k + 1] = np.uint64(int(powers[k]) * int(STEP) % 2**64)
    for k in range(length):
        prefix[:, k + 1] = prefix[:, k] * STEP + words[:, k] + np.uint64(1)
    last = np.full((n, length + 1), -1, dtype=np.int64)  # the piece that ends here
    back = np.zeros((n, length + 1), dtype=np.int64)
    best = np.zeros((n, length + 1))
    for end in range(1, length + 1):
        starts = np.arange(max(0, end - model.longest), end)
        ids = model.find(prefix[:, end, None] - prefix[:, starts] * powers[end - starts])
        row, which = np.nonzero(ids >= 0)
        piece, start = ids[row, which], starts[which]
        if model.kind == "bpe":
            before = last[row, start]
            fits = model.alone[piece] & ((start == 0) | (before >= 0))
            inner = np.flatnonzero(fits & (start > 0))
            fits[inner] = model.apart(before[inner], piece[inner])
            weight = np.where(fits, 0.0, -np.inf)
        else:
            weight = best[row, start] + model.scores[piece]
        table = np.full(ids.shape, -np.inf)
        table[row, which] = weight
        choice = table.argmax(axis=1)  # the first of equals: the longest piece
        rows = np.arange(n)
        best[:, end] = table[rows, choice]
        possible = best[:, end] > -np.inf
        last[possible, end] = ids[rows, choice][possible]
        back[:, end] = starts[choice]
    out = np.full((n, length), -1, dtype=np.int64)
    at = np.full(n, length)
    rows = np.arange(n)
    while len(rows):
        if np.any(last[rows, at] < 0):
            raise ValueError("a word has no segmentation: the model lacks single pieces")
        out[rows, at - 1] = last[rows, at]
        at = back[rows, at]
        rows, at = rows[at > 0], at[at > 0]
    return out


def _distinct(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and for each row which distinct one it is."""
    keys = np.zeros(len(block), dtype=np.uint64)
    for column in block.T:
        keys = keys * STEP + column + np.uint64(1)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    if not np.array_equal(block[first][which], block):  # two words of one hash
        _, first, which = np.unique(block, axis=0, return_index=True, return_inverse=True)
    return first, which.ravel()


def encode_batch(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and the number of ids of each text."""
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    sizes = np.array([len(t) for t in marked], dtype=np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    char = model.char_of[codes]
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = ~model.joined[char[:-1], char[1:]]
    text_starts = np.cumsum(sizes) - sizes
    fresh[text_starts[sizes > 0]] = True
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, len(codes)))
    word_ids = np.zeros(len(starts), dtype=np.int64)  # a number for each distinct word
    pieces: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    number = 0
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        block = codes[starts[own][:, None] + np.arange(length)]
        first, which = _distinct(block)
        word_ids[own] = number + which
        number += len(first)
        distinct, known = block[first], np.ones(len(first), dtype=bool)
        if length == 1:
            known = char[starts[own][first]] > 0
        split = _split(model, distinct[known].astype(np.uint64))
        flat, many = np.zeros(0, dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        many[known] = (split >= 0).sum(axis=1)
        if known.all():
            flat = split[split >= 0]
        else:
            done, rest = iter(split[:, 0]), []
            for code, fine in zip(distinct[:, 0], known, strict=True):
                rest.append([next(done)] if fine else _unknown(model, int(code)))
            many, flat = np.array([len(r) for r in rest]), np.array([x for r in rest for x in r], dtype=np.int64)
        pieces.append(flat)
        counts.append(many)
    flat, many = np.concatenate(pieces), np.concatenate(counts)
    place = np.cumsum(many) - many
    each = many[word_ids]
    total = np.cumsum(each)
    index = np.repeat(place[word_ids] - (total - each), each) + np.arange(total[-1])
    ids = flat[index].astype(np.int32)
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return ids, np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)


def _unknown(model: Model, code: int) -> list[int]:
    ids = [int(model.byte_ids[b]) for b in chr(code).encode("utf-8", "surrogatepass")]
    return ids if min(ids) >= 0 else [model.unknown]


def decode_batch(model: Model, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of lists of ids, laid end to end in ``ids``."""
    ends = np.cumsum(counts)
    known = (ids >= 0) & (ids < len(model.pieces))
    safe = np.where(known, ids, 0).astype(np.int64)
    sizes = np.where(known, np.diff(np.append(0, model.text_ends))[safe], 0)
    total = np.cumsum(sizes)
    index = np.repeat(model.text_ends[safe] - total, sizes) + np.arange(total[-1] if len(total) else 0)
    raw = model.text_bytes[index].tobytes()
    edges = np.append(0, total)
    texts, start = [], 0
    for end in ends:
        own = raw[edges[start] : edges[end]]
        first = next((i for i in ids[start:end] if 0 <= i < len(model.pieces)), None)
        if first is not None and model.pieces[first].startswith(SPACE):
            own = own[1:]
        texts.append(own.decode("utf-8", "replace"))
        start = end
    return texts


def decode_ids(model: Model, ids: list[int] | np.ndarray | None) -> str:
    """The text of one list of ids."""
    own = np.array([] if ids is None else ids, dtype=np.int64)
    return decode_batch(model, own, np.array([len(own)]))[0]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[str]]]:
    """Rows with about BATCH_CHARS of text together, whatever the size of the batches they come in."""
    held, texts, size = [], [], 0
    for batch in batches:
        start = 0
        for n, text in enumerate(batch.column("text").to_pylist()):
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BATCH_CHARS:
                yield pa.Table.from_batches([*held, batch.slice(start, n + 1 - start)]), texts
                held, texts, size, start = [], [], 0, n + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held), texts


def _encode(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for rows, texts in _gathered(batches):
        ids, counts = encode_batch(model, texts)
        offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
        same = [a == b for a, b in zip(decode_batch(model, ids, counts), texts, strict=True)]
        made = pa.table({
            "document": rows.column("document"), "doc_id": rows.column("doc_id"),
            "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), "n_tokens": pa.array(counts), "round_trip": pa.array(same),
        })
        yield from made.to_batches()


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """``document``, ``doc_id``, ``ids``, ``n_tokens`` and ``round_trip`` (whether decoding the ids gives the text)."""
    own = packed(docs, "doc_id", "text")
    kind = f"document {own.schema['document'].dataType.simpleString()}, doc_id {own.schema['doc_id'].dataType.simpleString()}"
    return own.mapInArrow(
        lambda batches: _encode(batches, model), f"{kind}, ids array<int>, n_tokens long, round_trip boolean"
    )


def encode_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and what ``encode`` makes of its text; nothing else of the row reaches Python."""
    return encode(docs.select("doc_id", "text"), model).drop("document")


def decode(rows: DataFrame, model: Model, ids: str = "ids", output: str = "text") -> DataFrame:
    """``rows`` with the text of ``ids``."""

    @F.pandas_udf("string")
    def text_of(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: decode_ids(model, x))

    return rows.withColumn(output, text_of(ids))


