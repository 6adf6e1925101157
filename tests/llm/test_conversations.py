"""Conversation repair against plain Python: a forward search over whole edit texts, and all edits of short ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from docsieve.llm import conversations
from docsieve.llm.conversations import damaged, repair, repair_report, summary

SHAPE = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row] * (2 if kind == 3 else 1)
    return out


def slow_faults(rows):
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def slow_repair(rows, faults):
    """The least (cost, edits, repaired turns): every edit of every turn from every reachable shape."""
    def grown(best):
        # Inserted turns: more than three in a row never pay.
        for _ in range(3):
            for shape, (cost, edits, turns) in list(best.items()):
                for new in ("user", "assistant"):
                    offer(best, shape, new[0], cost + 2, edits + "I", [*turns, (new, "")])
        return best

    def offer(best, shape, initial, cost, edits, turns):
        legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        after = shape if initial is None else legal.get((shape, initial))
        if after is not None and (cost, edits) < best.get(after, (10**9, ""))[:2]:
            best[after] = (cost, edits, turns)

    best = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        before, best = grown(best), {}
        for shape, (cost, edits, turns) in before.items():
            offer(best, shape, None, cost + 3, edits + "D", turns)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                offer(best, shape, role[:1], cost + extra, edits + "K", [*turns, (role, text)])
                for new in ("user", "assistant"):
                    offer(best, shape, new[0], cost + 2 + extra, edits + "R", [*turns, (new, text)])
    best = grown(best)
    return min(best[s] for s in ("", "a") if s in best)


def slow_report(rows, asked):
    groups = {c: [] for c in asked}
    for row in rows:
        groups[row[0]].append(row)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = slow_faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, edits, fixed = slow_repair(own, faults)
        assert SHAPE.match("".join(r[:1] for r, _ in fixed))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, sha))
    return sorted(out, key=repr)


def rows_of(rng, count, longest):
    texts = ["Yes.", "No!", "so", "", "  \n", "What? ", "and then", "é…", "End.\t", "漢字"]
    rows = []
    for conv in range(count):
        role = ["user", "assistant"]
        for turn in range(rng.randint(0, longest)):
            who = rng.choice(["system", "tool", "", None, "user", "assistant"]) if rng.random() < 0.25 else role[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(10**6)}."
            at = None if rng.random() < 0.04 else turn * (2 if rng.random() < 0.1 else 1)
            rows.append((conv if conv else None, at, who, None if rng.random() < 0.04 else text))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("chunk_bits", [12, 2, 0])
def test_repair_matches_brute_force(spark, monkeypatch, chunk_bits):
    monkeypatch.setattr(conversations, "CHUNK_BITS", chunk_bits)
    rows = rows_of(random.Random(chunk_bits), 150, 14)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(repair_report(damaged(turns), turns)) == slow_report(slow_damage(rows), {r[0] for r in rows})


def test_long_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_BITS", 5)
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"turn {rng.randrange(900)}{rng.choice('.,')}") for t in range(1500)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(repair_report(damaged(turns), turns)) == slow_report(slow_damage(rows), {7})


def test_crossings_are_the_least_of_all_edits():
    """All texts of up to three edits a gap for short runs, judged by the shape alone."""
    rng = random.Random(2)
    for _ in range(60):
        roles = [rng.choice("suax") for _ in range(rng.randint(1, 3))]
        faults = [rng.choice(["", "truncated", "blank"]) for _ in roles]
        found = []
        ways = [[lead + edit for n in range(3) for lead in ["u" * n if n < 2 else "", *(("ua", "au") if n == 2 else ("a",) if n == 1 else ())]
                 for edit in (["D"] if f == "blank" else ["D", "K", "Ru", "Ra"])] for f in faults]
        for picks in itertools.product(*ways, ["", "u", "a", "ua", "au"]):
            shape, cost, edits = "", 0, ""
            for pick, role, fault in zip(picks, [*roles, ""], [*faults, ""], strict=True):
                inserted = re.match("[ua]*", pick).group()
                edit = pick[len(inserted):]
                shape += inserted + {"K": role, "Ru": "u", "Ra": "a"}.get(edit, "")
                cost += 2 * len(inserted) + {"D": 3, "K": 0, "Ru": 2, "Ra": 2, "": 0}[edit] + (fault == "truncated" and edit not in ("D", ""))
                edits += "I" * len(inserted) + edit[:1]
            if SHAPE.match(shape):
                found.append((cost, edits))
        rows = [(1, n, r, f"{n}") for n, r in enumerate(roles)]
        assert min(found) == slow_repair(rows, faults)[:2]


def test_repaired_turns_keep_their_texts_and_order(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Yes"), (2, 0, "assistant", "One.")]
    out = repair(spark.createDataFrame(rows, SCHEMA)).coalesce(1).collect()
    one = [(r["turn"], r["edit"], r["fault"], r["given"], r["role"], r["text"]) for r in out if r["conv_id"] == 1]
    assert one == [
        (0, "K", "", "system", "system", "Be kind."), (1, "K", "", "user", "user", "Hi."), (None, "I", None, None, "assistant", ""),
        (2, "K", "", "user", "user", "Hello?"), (3, "K", "truncated", "assistant", "assistant", "Yes"),
    ]
    assert [(r["edit"], r["role"]) for r in out if r["conv_id"] == 2] == [("I", "user"), ("K", "assistant")]


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_report(damaged(none), none).count() == 0
    rows = [(None, None, None, None), (3, None, "user", "x" * 400_000 + "."), (3, None, "user", None), (3, 1, "assistant", "a."), (3, 1, "assistant", "a.")]
    clash = "conv_id long, turn long, role string, text string, at long, code int, first long, keep int, kind int, `copy` int, same int"
    turns = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], clash)
    assert got(repair_report(damaged(turns), turns)) == slow_report(slow_damage(rows), {None, 3})
    empty = hashlib.sha256(b"").hexdigest()
    assert got(repair_report(turns.filter("false"), turns)) == sorted([(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (None, 3)], key=repr)
    assert summary(turns).columns == COLUMNS
