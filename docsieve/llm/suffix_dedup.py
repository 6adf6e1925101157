"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a smaller ``doc_id``, or before it in
the same document. All strings are judged on the input; matches never cross documents.

1. Documents are dealt into chunks of about ``CHUNK_BYTES``. Each string of ``length`` bytes is represented by the least
   hash of the 24-byte grams in it, so equal strings have equal representatives, and neighbours mostly share theirs (one
   in about 30 bytes is new). Only the distinct representatives of a chunk are sent, to ranges of the hash space.
2. A range merges the sorted lists of all chunks, finds each by binary search in the merged order, and tells the chunks
   which of their representatives others have too.
3. A chunk takes the strings whose representative occurs twice in it or elsewhere, and builds a suffix array over their
   bytes: order by 8-byte words, then Larsson-Sadakane refinement, in which only groups still equal are sorted again by the
   rank of the suffix that follows, until ``length`` bytes are in order. Common prefixes of neighbours in the array give
   the groups of equal strings; all but the first of a group are marked here, so a passage that any number of documents
   share leaves a chunk once. Firsts whose representative others have too are sent to its range with their bytes.
4. A range drops sent segments whose bytes an earlier one has: all strings in them start earlier elsewhere. Over the others
   that share their representative with one more it builds the same array, and marks what starts earlier in another chunk.
5. Marks return to their chunk, and texts are cut.

The order stops at ``length`` bytes, so long copies cost no more rounds than short ones. Kasai's carry from one text
position to the next needs the complete order (ties may put the follower of a neighbour on the other side), so common
prefixes are compared word by word instead.

Texts are shuffled once: the three steps that read them share one exchange. A task holds one chunk or one range at a
time. Null or empty text: nothing to remove. Null ``doc_id``: the smallest. Rows with one id and one text are one
document and each is returned; rows with one id and different texts are ordered by a hash of the text. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 100
GRAM = 24  # bytes of a gram; LENGTH - GRAM + 1 of them are in a string
CHUNK_BYTES = 2 << 20
SLAB_BYTES = 1 << 20  # of whole documents hashed at a time
CHUNKS_A_TASK = 8
FACTOR = 0x9E3779B97F4A7C15
MARK, SENT = 0, 1
ROWS = "key long, kind int, chunk long, doc long, version long, data binary"


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes ^ hashes >> np.uint64(29)
    hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ hashes >> np.uint64(32)


def _gram_hashes(text: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on; polynomials of lengths that are powers of two, put together."""
    part, power, width, whole, have = text.astype(np.uint64) + np.uint64(1), FACTOR, 1, None, 0
    while True:
        if size & width:
            # Longer parts come first in the gram, so what is there already is moved behind this one.
            n = len(text) - have - width + 1
            whole = part if whole is None else part[:n] * np.uint64(pow(FACTOR, have, 2**64)) + whole[width : width + n]
            have += width
        if 2 * width > size:
            return _mixed(whole)
        part = part[:-width] * np.uint64(power) + part[width:]
        power = power**2 % 2**64
        width *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _slab(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one representative in a slab of documents, and the grams that represent, with repeats."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams, width = _gram_hashes(text), length - GRAM + 1
    least = _least(grams, width)
    inside = np.ones(len(least), dtype=bool)
    # A string that starts in the last length - 1 bytes of a document would reach into the next.
    for end in ends:
        inside[max(0, end - length + 1) : end] = False
    fresh = np.ones(len(least), dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(fresh)
    stops = np.append(starts[1:], len(least))
    real = inside[starts]
    starts, stops = starts[real], stops[real]
    name = least[starts]
    # A gram represents if it equals the greatest of the leasts of the strings around it.
    least[~inside] = 0
    edge = np.zeros(width - 1, dtype=np.uint64)
    around = ~_least(~np.concatenate([edge, least, edge]), width)
    return starts, stops, name, grams[grams == around]


def representatives(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one representative: first start, end (exclusive), the representative, and whether its gram is there twice.

    Documents are hashed in slabs of ``SLAB_BYTES``, or one at a time where they are longer.
    """
    parts, first, begin = [], 0, 0
    for n, end in enumerate(ends):
        if n + 1 == len(ends) or ends[n + 1] - begin > SLAB_BYTES:
            starts, stops, name, grams = _slab(text[begin:end], ends[first : n + 1] - begin, length)
            parts.append((starts + begin, stops + begin, name, grams))
            first, begin = n + 1, end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    starts, stops, name, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, counts = np.unique(grams, return_counts=True)
    return starts, stops, _mixed(name), counts[np.searchsorted(found, name)] > 1 if len(name) else np.zeros(0, bool)


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number that sorts like them; zeros after the end."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    words = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + len(text)]
    return words


def suffix_order(text: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """All positions in the order of the ``length`` bytes that follow."""
    size = len(text)
    order = np.argsort(words, kind="stable")
    fresh = np.ones(size, dtype=bool)
    fresh[1:] = words[order][1:] != words[order][:-1]
    rank = np.empty(size, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(size), 0))
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        alone = fresh & np.append(fresh[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        suffix = order[open_]
        after = suffix + step
        key = rank[suffix] << 32 | np.where(after < size, rank[np.minimum(after, size - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        suffix, key = suffix[sort], key[sort]
        order[open_] = suffix
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        fresh[open_] = first
        rank[suffix] = open_[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        depth += step
    return order


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from positions ``a`` and ``b`` on are the same, a word at a time."""
    same, left = np.ones(len(a), dtype=bool), np.arange(len(a))
    for at in [*range(0, length - 8, 8), length - 8]:
        equal = words[a[left] + at] == words[b[left] + at]
        same[left[~equal]] = False
        left = left[equal]
    return same


def later_copies(text: np.ndarray, starts: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each of ``starts``: does an equal string start at another of them with a smaller ``rank``? All strings end inside."""
    if len(starts) < 2:
        return np.zeros(len(starts), dtype=bool)
    words = _words(text)
    number = np.full(len(text), -1, dtype=np.int64)
    number[starts] = np.arange(len(starts))
    order = suffix_order(text, words, length)
    chosen = number[order]
    chosen = chosen[chosen >= 0]
    at = starts[chosen]
    group = np.cumsum(np.append(True, ~common_prefix(words, at[:-1], at[1:], length)))
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank[chosen])
    later = np.zeros(len(starts), dtype=bool)
    later[chosen] = rank[chosen] > least[group]
    return later


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each size, one after the other."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


class Chunk:
    """The documents of a chunk in order, end to end; rows that repeat an id and a text are left out."""

    def __init__(self, table: pa.Table):
        self.doc = table.column("doc").to_numpy()
        self.version = table.column("version").to_numpy()
        order = np.lexsort((self.version, self.doc))
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (np.diff(self.doc[order]) == 0) & (np.diff(self.version[order]) == 0)
        order = order[~again]
        self.doc, self.version = self.doc[order], self.version[order]
        texts = table.column("text").take(pa.array(order)).to_pylist()
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.text = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def marks(self, starts: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Document, version and packed runs of the sorted ``starts``, per document."""
        fresh = np.ones(len(starts), dtype=bool)
        owner = np.searchsorted(self.ends, starts, side="right")
        fresh[1:] = (np.diff(starts) != 1) | (np.diff(owner) != 0)
        first = np.flatnonzero(fresh)
        begin, end = starts[first], starts[np.append(first[1:], len(starts)) - 1] + 1 if len(starts) else starts
        own, found = owner[first], []
        for place in np.unique(own):
            mine = own == place
            runs = np.stack([begin[mine], end[mine]], axis=1) - self.begins[place]
            found.append((int(self.doc[place]), int(self.version[place]), _pack(runs)))
        return found


def _groups(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True))


def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _announce(batches: Iterator[pa.RecordBatch], length: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Step 1: the distinct representatives of each chunk, by range."""
    seen: dict[int, list[np.ndarray]] = {}
    held: dict[int, list[bytes]] = {}

    def settle(chunk: int) -> None:
        texts = held.pop(chunk)
        ends = np.cumsum([len(t) for t in texts])
        name = representatives(np.frombuffer(b"".join(texts), dtype=np.uint8), ends, length)[2]
        seen.setdefault(chunk, []).append(np.unique(name))

    for batch in batches:
        for chunk, text in zip(batch.column("chunk").to_pylist(), batch.column("text"), strict=True):
            held.setdefault(chunk, []).append(text.as_py())
        for chunk in list(held):
            settle(chunk)
    for chunk, parts in seen.items():
        hashes = np.unique(np.concatenate(parts))
        places = _ranges(hashes, ranges)
        rows = [(int(places[a]), chunk, _pack(hashes[a:b])) for a, b in _groups(places)]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("key", "chunk", "data"), map(list, zip(*rows, strict=True)), strict=True)))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by ``key``, one table for each key."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for a, b in _groups(keys):
            if held and int(keys[a]) != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: which representatives of a chunk are in other chunks too."""
    for _, table in _by_key(batches):
        lists = [_unpack(d, "<u8") for d in table.column("data").to_pylist()]
        merged = np.sort(np.concatenate(lists))
        rows = []
        for chunk, own in zip(table.column("chunk").to_pylist(), lists, strict=True):
            shared = own[np.searchsorted(merged, own, side="right") - np.searchsorted(merged, own, side="left") > 1]
            if len(shared):
                rows.append((chunk, _pack(shared)))
        if rows:
            yield pa.RecordBatch.from_pydict({"chunk": [r[0] for r in rows], "data": [r[1] for r in rows]})


def _search_chunk(texts: pa.Table, shared: pa.Table, length: int, ranges: int) -> pa.Table:
    """Step 3: marks inside the chunk, and the strings that ranges must compare."""
    rows: list[tuple] = []
    if texts.num_rows:
        chunk, number = Chunk(texts), int(texts.column("chunk")[0].as_py())
        begin, end, name, twice = representatives(chunk.text, chunk.ends, length)
        others = np.sort(np.concatenate([np.zeros(0, np.uint64), *[_unpack(d, "<u8") for d in shared.column("data").to_pylist()]]))
        elsewhere = np.searchsorted(others, name, side="right") > np.searchsorted(others, name, side="left")
        taken = elsewhere | twice
        begin, end, name, elsewhere = begin[taken], end[taken], name[taken], elsewhere[taken]
        if len(begin):
            # Only the bytes of taken strings: segments of the chunk, end to end.
            wanted = np.zeros(len(chunk.text), dtype=bool)
            wanted[_spread(begin, end - begin + length - 1)] = True
            place = np.cumsum(wanted) - 1
            starts = _spread(begin, end - begin)
            later = later_copies(chunk.text[wanted], place[starts], starts, length)
            rows += [(number, MARK, number, *m) for m in chunk.marks(np.sort(starts[later]))]
            # Of each run that others share: from its first string to its last that is new here.
            run = np.repeat(np.arange(len(begin)), end - begin)
            send = ~later & elsewhere[run]
            low = np.full(len(begin), np.iinfo(np.int64).max)
            high = np.full(len(begin), -1)
            np.minimum.at(low, run[send], starts[send])
            np.maximum.at(high, run[send], starts[send])
            sent = np.flatnonzero(high >= 0)
            sent = sent[np.argsort(_ranges(name[sent], ranges), kind="stable")]
            goes = _ranges(name[sent], ranges)
            for a, b in _groups(goes):
                at, size = low[sent[a:b]], high[sent[a:b]] - low[sent[a:b]] + length
                owner = np.searchsorted(chunk.ends, at, side="right")
                parts = [chunk.doc[owner], chunk.version[owner], at - chunk.begins[owner], size, name[sent[a:b]].view(np.int64)]
                data = zstandard.compress(np.concatenate(parts).astype("<i8").tobytes() + chunk.text[_spread(at, size)].tobytes(), 1)
                rows.append((int(goes[a]), SENT, number, b - a, 0, data))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "kind", "chunk", "doc", "version", "data"), columns, kinds, strict=True)})


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Step 4: marks pass; strings that chunks have sent are compared, range by range."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ("chunk", "doc", "version", "data")

    def out(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(names))

    for _, table in _by_key(batches):
        kind = table.column("kind").to_numpy()
        for part in table.filter(pa.array(kind == MARK)).select(names).to_batches():
            yield part
        sent = table.filter(pa.array(kind == SENT))
        if not sent.num_rows:
            continue
        heads, bodies, chunks = [], [], []
        for n, chunk, data in zip(sent.column("doc").to_pylist(), sent.column("chunk").to_pylist(), sent.column("data").to_pylist(), strict=True):
            raw = zstandard.decompress(data)
            heads.append(np.frombuffer(raw, dtype="<i8", count=5 * n).reshape(5, n))
            bodies.append(np.frombuffer(raw, dtype=np.uint8, offset=40 * n))
            chunks.append(np.full(n, chunk))
        doc, version, at, size, name = np.concatenate(heads, axis=1)
        chunk, text = np.concatenate(chunks), np.concatenate(bodies)
        del heads, bodies, chunks
        begin = np.cumsum(size) - size
        # Segments of a document are apart, so their order is that of the strings in them.
        order = np.lexsort((at, version, doc))
        doc, version, at, size, name, chunk, begin = (x[order] for x in (doc, version, at, size, name, chunk, begin))
        many = size - length + 1
        copy = _copies(text, begin, size)
        flags = np.repeat(copy, many)
        # Equal strings have one name: a segment that is the only one of its name has been compared in its chunk.
        _, named, times = np.unique(name[~copy], return_inverse=True, return_counts=True)
        held = np.zeros(len(copy), dtype=bool)
        held[~copy] = times[named] > 1
        if held.any():
            starts = _spread(np.cumsum(size[held]) - size[held], many[held])
            text = np.concatenate([text[x : x + n] for x, n in zip(begin[held].tolist(), size[held].tolist(), strict=True)])
            flags[np.repeat(held, many)] = later_copies(text, starts, starts, length)
        if flags.any():
            # Runs of marked starts, cut where a segment ends.
            edge = np.zeros(len(flags) + 1, dtype=bool)
            edge[np.append(0, np.cumsum(many))] = True
            first = np.flatnonzero(flags & (edge[:-1] | ~np.append(False, flags[:-1])))
            last = np.flatnonzero(flags & (edge[1:] | ~np.append(flags[1:], False)))
            begins = np.cumsum(many) - many
            own = np.searchsorted(begins, first, side="right") - 1
            low = at[own] + first - begins[own]
            runs = np.stack([low, low + last - first + 1], axis=1)
            d, v, c = doc[own], version[own], chunk[own]
            same = np.flatnonzero(np.append(True, (np.diff(d) != 0) | (np.diff(v) != 0)))
            rows = [(int(c[x]), int(d[x]), int(v[x]), _pack(runs[x:y])) for x, y in zip(same, [*same[1:], len(d)], strict=True)]
            yield out(list(zip(*rows, strict=True)))


def _copies(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which segments have the bytes of an earlier one."""
    data, digests = memoryview(text), bytearray(16 * len(begin))
    for n, (a, b) in enumerate(zip(begin.tolist(), (begin + size).tolist(), strict=True)):
        digests[16 * n : 16 * n + 16] = hashlib.blake2b(data[a:b], digest_size=16).digest()
    low, high = np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T
    order = np.lexsort((high, low))  # stable: equal ones stay in order
    found = np.zeros(len(begin), dtype=bool)
    found[order[1:]] = (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])
    return found


def removed_spans(runs: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed byte runs (start, end) of a document, from runs of marked string starts."""
    if not len(runs):
        return np.zeros((0, 2), dtype=np.int64)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(runs[:, 1] + length - 1)
    fresh = np.append(True, runs[1:, 0] > ends[:-1])
    first = np.flatnonzero(fresh)
    return np.stack([runs[first, 0], ends[np.append(first[1:], len(runs)) - 1]], axis=1)


def _cut(texts: pa.Table, marks: pa.Table, length: int, with_text: bool) -> pa.Table:
    """Step 5: each row's text without its removed spans."""
    runs: dict[tuple, list[np.ndarray]] = {}
    for d, v, data in zip(*(marks.column(c).to_pylist() for c in ("doc", "version", "data")), strict=True):
        runs.setdefault((d, v), []).append(_unpack(data, "<i8").reshape(-1, 2))
    rows = []
    for own, d, v, text in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "doc", "version", "text")), strict=True):
        spans = removed_spans(np.concatenate(runs[d, v]), length) if (d, v) in runs else np.zeros((0, 2), dtype=np.int64)
        edges = [0, *spans.ravel().tolist(), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(spans) else text
        rows.append((own, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})


def suffix_dedup(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, with_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the bytes left, if ``with_text``)."""
    if length < GRAM + 8:
        raise ValueError(f"strings need {GRAM + 8} bytes at least")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks = max(1, -(-size // chunk_bytes))
    tasks = max(1, -(-chunks // CHUNKS_A_TASK))
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("version"),
        F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(chunks)).alias("chunk"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    ).repartition(tasks, "chunk")
    announced = texts.mapInArrow(lambda b: _announce(b, length, tasks), "key long, chunk long, data binary")
    shared = announced.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_answer, "chunk long, data binary")
    found = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        lambda a, b: _search_chunk(a, b, length, chunks), ROWS
    )
    marks = found.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(
        lambda b: _compare(b, length), "chunk long, doc long, version long, data binary"
    )
    return texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(
        lambda a, b: _cut(a, b, length, with_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
