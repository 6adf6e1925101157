"""Conversation structure repair: the cheapest edits that make a conversation alternate, by Hirschberg's divide and conquer.

The role initials of a repaired conversation read ``(s?(ua)+)?``: nothing, or a system turn or none and then user and
assistant in turn. Edits of a turn are Keep (free), Rerole to user or assistant (2) and Delete (3); an empty user or
assistant turn can be Inserted anywhere (2). Blank turns (no character but blanks) and duplicates (role and text seen
earlier in the conversation) must go; a turn whose last character but blanks is no end mark costs 1 if it stays. Of the
cheapest edits those with the ASCII-least initials win.

The pattern has four states, and an edit leads from a state to one other. So what a run of turns does is a 4 x 4 table of
costs, and beside it which of the edits from one state come first in ASCII order. Halving a run, the forward vector of its first half and
the backward vector of its second meet at the middle turn; the crossing with the least sum, and of those the one whose
edits come first, splits the problem in two. Only vectors of four are held, so space is linear in the turns.

Conversations are cut into chunks of at most ``CHUNK`` turns: turns are sorted by range over all tasks, so that one hot
conversation fills many. Each chunk is reduced to its table, the tables of a conversation are crossed the same way
(a table stands for a turn), and then every chunk is solved by itself between the two states given to it. Memory of a
conversation in one task is one table a chunk; texts only stream past, sorted. Duplicates are found by hash over all turns.

A null role or text is one space. A null turn comes first; turns with equal numbers come by role, then by text. A null
``conv_id`` is a conversation like any other. A conversation without turns needs no edits. Empty table: no rows. Extra
columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import BLANK_CHARS
from docsieve.session import materialize

CHUNK_BITS = 12  # a chunk holds at most 2^12 turns
OUT_ROWS = 1_000
END_MARKS = ".!?"

# Costs of the edits, the penalty of a truncated turn that stays, and the pattern's states: nothing yet, after system, user, assistant.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INITIALS = "sua"
NAMES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
FAR = 1 << 40
PAD = len(FAULTS) * (len(INITIALS) + 1)  # the code of no turn


def _insert(state: int) -> tuple[str, int]:
    """The one role that can be inserted in ``state``, and the state after it."""
    return next((role, NEXT[state, role]) for role in "ua" if (state, role) in NEXT)


def _pieces(initial: str, fault: str) -> dict[tuple[int, int], tuple[int, str]]:
    """For each two states the cheapest edits between them that use up one turn: their cost and their initials."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state, lead = start, ""
        for _ in range(4):
            spent, stays = COSTS["I"] * len(lead), TRUNCATED_COST * (fault == "truncated")
            offers = [(spent + COSTS["D"], lead + "D", state)]
            if fault not in ("blank", "duplicate"):
                ways = [("K", initial), ("R", "u"), ("R", "a")]
                offers += [(spent + COSTS[e] + stays, lead + e, NEXT[state, r]) for e, r in ways if (state, r) in NEXT]
            for cost, edits, end in offers:
                found[start, end] = min(found.get((start, end), (cost, edits)), (cost, edits))
            lead, state = lead + "I", _insert(state)[1]
    return found


def _tables() -> tuple[np.ndarray, np.ndarray, list[dict[tuple[int, int], str]]]:
    """By turn code and two states: cost, place among the edits from one state in ASCII order, and the edits."""
    cost, order, edits = np.full((PAD + 1, 4, 4), FAR), np.zeros((PAD + 1, 4, 4), dtype=np.int64), []
    for fault, initial in itertools.product(FAULTS, [*INITIALS, ""]):
        found = _pieces(initial, fault)
        for (a, b), (c, text) in found.items():
            cost[len(edits), a, b] = c
            order[len(edits), a, b] = sum(t < text for (s, _), (_, t) in found.items() if s == a)
        edits.append({ends: text for ends, (_, text) in found.items()})
    cost[PAD][np.diag_indices(4)] = 0
    return cost, order, edits


COST, ORDER, EDITS = _tables()
TAIL = ["", "II", "I", ""]  # edits that end the pattern in each state
TAIL_COST = np.array([COSTS["I"] * len(t) for t in TAIL])


def _ahead(cost: np.ndarray, order: np.ndarray, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row of ``codes`` and each state: 4 x the least cost to get there, plus the rank of its edits in ASCII order."""
    key = np.full((len(codes), 4), 4 * FAR)
    key[np.arange(len(codes)), start] = 0
    for step in range(codes.shape[1]):
        reach = key[:, :, None] + 4 * cost[codes[:, step]]
        source = reach.argmin(axis=1)[:, None]
        best = np.take_along_axis(reach, source, axis=1)[:, 0]
        place = (best & 3) * 4 + np.take_along_axis(order[codes[:, step]], source, axis=1)[:, 0]
        key = np.minimum(best & ~3, 4 * FAR) | (place[:, :, None] > place[:, None, :]).sum(axis=2)
    return key


def _behind(cost: np.ndarray, codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row of ``codes`` and each state the least cost to get from there to ``end``."""
    left = np.full((len(codes), 4), FAR)
    left[np.arange(len(codes)), end] = 0
    for step in range(codes.shape[1] - 1, -1, -1):
        left = np.minimum((cost[codes[:, step]] + left[:, None, :]).min(axis=2), FAR)
    return left


def crossings(cost: np.ndarray, order: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The states before, between and after the codes of each row on its cheapest, then ASCII-least, way from start to end."""
    states = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.int8)
    states[:, 0], states[:, -1] = start, end

    def split(low: int, high: int) -> None:
        if high - low > 1:
            middle = (low + high) // 2
            first = _ahead(cost, order, codes[:, low:middle], states[:, low])
            states[:, middle] = (first + 4 * _behind(cost, codes[:, middle:high], states[:, high])).argmin(axis=1)
            split(low, middle)
            split(middle, high)

    split(0, codes.shape[1])
    return states


def _by_length(lists: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lists of about one length together: their places, and their codes padded to one width."""
    sizes = np.array([len(x) for x in lists])
    for width in np.unique(1 << np.ceil(np.log2(sizes)).astype(int)) if len(lists) else []:
        places = np.flatnonzero((sizes <= width) & (2 * sizes > width))
        codes = np.full((len(places), width), PAD, dtype=np.int64)
        for row, place in enumerate(places):
            codes[row, : sizes[place]] = lists[place]
        yield places, codes


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk with its table: costs and orders from each state to each."""
    for batch in batches:
        lists = batch.column("codes").to_pylist()
        keys = np.zeros((len(lists), 4, 4), dtype=np.int64)
        for places, codes in _by_length(lists):
            for state in range(4):
                keys[places, state] = _ahead(COST, ORDER, codes, np.full(len(places), state))
        flat = pa.array(list(keys.reshape(-1, 16)), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "keys"])


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of each conversation the states at its ends, and the edits after the conversation's last chunk.

    Conversations with equally many chunks go together.
    """
    for batch in batches:
        chunks = batch.column("chunks")
        sizes, fields = np.diff(chunks.offsets.to_numpy()), chunks.flatten()
        every = fields.field("keys").flatten().to_numpy().reshape(-1, 4, 4)
        first = fields.field("first").to_numpy()
        begins = np.cumsum(sizes) - sizes
        for size in np.unique(sizes):
            places = begins[sizes == size][:, None] + np.arange(size)
            keys = every[places.ravel()]
            cost, order, steps = keys >> 2, keys & 3, np.arange(len(keys)).reshape(places.shape)
            start = np.zeros(len(places), dtype=int)
            end = (_ahead(cost, order, steps, start) + 4 * TAIL_COST).argmin(axis=1)
            states = crossings(cost, order, steps, start, end)
            tails = np.full(places.shape, "", dtype=object)
            tails[:, -1] = [TAIL[e] for e in end]
            columns = first[places], states[:, :-1], states[:, 1:], tails
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in columns], ["first", "start", "end", "tail"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk with the states between its turns."""
    for batch in batches:
        lists, start, end = (batch.column(c) for c in ("codes", "start", "end"))
        lists, start, end = lists.to_pylist(), start.to_numpy(), end.to_numpy()
        states: list = [None] * len(lists)
        for places, codes in _by_length(lists):
            for place, found in zip(places, crossings(COST, ORDER, codes, start[places], end[places]), strict=True):
                states[place] = found[: len(lists[place]) + 1].tobytes()
        made = pa.array(states, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("first"), pa.array([bytes(x) for x in lists], pa.binary()), made, batch.column("tail")],
            ["conv_id", "first", "codes", "states", "tail"],
        )


def _edited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted chunks, each before its turns, to the turns with their edits, and the inserted turns among them."""
    rows: list[tuple] = []
    chunk, at = None, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "codes", "states", "tail")), strict=True):
            conv, turn, role, text = row[:4]
            if row[4] is not None:
                chunk, at = row[4:], 0
                continue
            codes, states, tail = chunk
            state, last, fault = states[at], states[at + 1], FAULTS[codes[at] // 4]
            letters = EDITS[codes[at]][state, last] + (tail if at == len(codes) - 1 else "")
            for letter in letters:
                if letter == "I":
                    initial, state = _insert(state)
                    rows.append((conv, None, "I", None, None, NAMES[initial], ""))
                    continue
                if letter == "R":
                    new = next(NAMES[i] for i in "ua" if NEXT.get((state, i)) == last)
                rows.append((conv, turn, letter, fault, role, new if letter == "R" else role, text))
                state = last
            at += 1
            if len(rows) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Turns with their edits, sorted, to one row a conversation."""
    nothing = object()
    conv, done = nothing, []

    def close() -> None:
        gaps = turns[-1] - turns[0] + 1 - distinct if turns else 0
        done.append((conv, gaps, *counts, illegal, cost, "".join(audit), digest.hexdigest()))

    for batch in batches:
        for own, turn, edit, fault, given, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv is nothing or own != conv:
                if conv is not nothing:
                    close()
                conv, turns, distinct, counts, illegal, cost, audit = own, [], 0, [0, 0, 0], 0, 0, []
                digest, before, written = hashlib.sha256(), None, False
            if edit != "I":
                illegal += before is not None and before + given[:1] not in ("su", "ua", "au")
                before = given[:1]
                if fault:
                    counts[FAULTS.index(fault) - 1] += 1
                if turn is not None and (not turns or turn != turns[-1]):
                    turns, distinct = [turns[0], turn] if turns else [turn], distinct + 1
            cost += COSTS[edit] + TRUNCATED_COST * (fault == "truncated" and edit != "D")
            audit.append(edit)
            if edit != "D":
                digest.update(("\n" if written else "").encode() + f"{role}:{text}".encode())
                written = True
        if len(done) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema, strict=True)], schema=schema)
            done = []
    if conv is not nothing:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema, strict=True)], schema=schema)


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` after known damage, chosen by crc32(``conv_id:turn``) modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4 makes it a user's.
    """
    kind = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn"))) % 20
    own = turns.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", END_MARKS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return own.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select(
        "conv_id", "turn", role.alias("role"), text.alias("text")
    )


def _codes(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` and ``code`` of every turn: its role initial and its first fault in one number."""
    bare = F.rtrim("text", F.lit(BLANK_CHARS))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    whole = F.concat(F.col("conv_id").isNull().cast("string"), _filled("conv_id"), F.lit(":"), F.char_length("role"), F.lit(":"), "role", "text")
    own = rows.select(
        "conv_id", "at", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*END_MARKS)).alias("truncated"),
        # An empty role is found at place 1 of any text; it has no initial.
        F.when((F.col("role") == "") | (initial == 0), len(INITIALS)).otherwise(initial - 1).alias("initial"),
        F.unhex(F.sha2(whole, 256)).alias("same"),
    )
    # Counting combines before the shuffle, so a text that most turns share is one row a task.
    repeated = own.filter(~F.col("blank")).groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    fault = F.when(F.col("blank"), 1).when(F.col("at") > F.col("first"), 2).when(F.col("truncated"), 3).otherwise(0)
    code = (fault * 4 + F.col("initial")).cast("tinyint")
    return own.join(repeated, "same", "left").select("conv_id", "at", code.alias("code"))


def repair(turns: DataFrame) -> DataFrame:
    """Every turn with its ``edit``, and the inserted turns, in order.

    ``conv_id``, ``turn``, ``edit`` (K, R, D or I), ``fault`` (blank, duplicate, truncated or empty), ``given`` (the role it
    had), ``role`` and ``text``. The rows of a conversation are in one partition and follow each other there.
    """
    own = turns.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"))
    # Beginnings of texts are enough to deal rows out: the driver holds a sample of these keys.
    dealt = own.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32))
    ordered = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    rows = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")
    chunks = _codes(rows).groupBy("conv_id", F.shiftright("at", CHUNK_BITS).alias("block")).agg(
        F.min("at").alias("first"), F.sort_array(F.collect_list(F.struct("at", "code"))).alias("turns")
    ).select("conv_id", "first", F.col("turns.code").alias("codes"))
    kind = chunks.schema["conv_id"].dataType.simpleString()
    reduced = materialize(chunks.mapInArrow(_reduce, f"conv_id {kind}, first long, codes array<tinyint>, keys array<long>"), "chunks")
    # One table a chunk: what a task holds of a conversation.
    tables = reduced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "keys"))).alias("chunks"))
    ends = tables.select("chunks").mapInArrow(_cross, "first long, start tinyint, end tinyint, tail string")
    solved = reduced.select("conv_id", "first", "codes").join(ends, "first").mapInArrow(
        _solve, f"conv_id {kind}, first long, codes binary, states binary, tail string"
    )
    both = rows.withColumn("is_turn", F.lit(True)).unionByName(
        solved.select("conv_id", F.col("first").alias("at"), F.lit(False).alias("is_turn"), "codes", "states", "tail"),
        allowMissingColumns=True,
    )
    names = "conv_id", "turn", "role", "text", "codes", "states", "tail"
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "is_turn").select(*names)
    turn = turns.schema["turn"].dataType.simpleString()
    made = f"conv_id {kind}, turn {turn}, edit string, fault string, given string, role string, text string"
    types = _arrow(turns, "conv_id", "turn") + [pa.field(n, pa.string()) for n in ("edit", "fault", "given", "role", "text")]
    return stream.mapInArrow(lambda batches: _edited(batches, pa.schema(types)), made)


def _arrow(df: DataFrame, *columns: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(c, to_arrow_type(df.schema[c].dataType)) for c in columns]


def summary(turns: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cost and the initials of its repair, and a hash of the repaired turns."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    texts = ("audit", "repaired_sha256")
    types = pa.schema(_arrow(turns, "conv_id") + [pa.field(c, pa.int64()) for c in counts] + [pa.field(c, pa.string()) for c in texts])
    kind = turns.schema["conv_id"].dataType.simpleString()
    made = f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, {', '.join(f'{c} string' for c in texts)}"
    return repair(turns).mapInArrow(lambda batches: _digests(batches, types), made)


def repair_report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``summary`` of ``turns`` for every ``conv_id`` of ``conversations``; zeros and empty texts where no turn is left."""
    found = summary(turns)
    names = conversations.select(F.col("conv_id").alias("asked")).distinct()
    blank = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    filled = [F.coalesce(F.col(c), blank.get(c, F.lit(0))).alias(c) for c in found.columns[1:]]
    return names.join(found, F.col("asked").eqNullSafe(F.col("conv_id")), "left").select(F.col("asked").alias("conv_id"), *filled)
