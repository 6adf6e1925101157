"""Tokenizer alignment against the libraries and a plain loop over bytes."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import pytest
import sentencepiece
import tokenizers

from docsieve.llm import alignment
from docsieve.llm.alignment import align, byte_letters, byte_side, links, piece_side
from tests.llm.conftest import ODD, TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    own = tokenizers.Tokenizer.from_file(A)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=B)


def slow_tokens(text, libraries):
    """(id, first byte, byte after the last) of each token of both sides, or none."""
    if not text:
        return [], []
    one, two = libraries
    letters, whole, sides = byte_letters(), (" " + text).encode(), []
    vocab = {v: k for k, v in one.get_vocab().items()}
    tokens = [(i, bytes(letters[c] for c in vocab[i])) for i in one.encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, two.id_to_piece(i)) for i in two.encode(text)]
    pieces = [(i, bytes.fromhex(p[3:5]) if p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in pieces]
    for side in (tokens, pieces):
        if b"".join(t for _, t in side) != whole:
            return [], []
        at = 0
        sides.append([])
        for i, t in side:
            sides[-1].append((i, at, at + len(t)))
            at += len(t)
    return sides


def slow_alignment(rows, libraries):
    tokens = {t: slow_tokens(t, libraries) for _, t in rows}
    linked = {}
    for text, (a, b) in tokens.items():
        linked[text] = []
        if len(a) * len(b) > 10**7:
            owner = [n for n, (_, s, e) in enumerate(b) for _ in range(s, e)]
            linked[text] = [(i, b[n][0]) for i, s, e in a for n in sorted(set(owner[s:e]))]
        else:
            linked[text] = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
    counts = Counter(p for _, t in rows for p in set(linked[t]))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for doc, text in rows:
        a, b = tokens[text]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        for low, high in itertools.pairwise([0, *ends]):
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in (a, b)) if len(a) < 3000 else "")
        own = linked[text]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(ends), len(own), sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), sha if len(a) < 3000 else None))
    return sorted(out, key=repr)


def got(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    return sorted(((*r[:-1], None) if r[1] >= 3000 else r for r in rows), key=repr)


def rows_of(small):
    rows = duckdb.sql(f"SELECT doc_id, substr(text, 1, 900) FROM '{small}/documents.parquet' ORDER BY doc_id LIMIT 120").fetchall()
    extra = ["<|endoftext|> and <s> </s> <unk>", "a  b   c\t\n\n d ", " lead", "tail ", "▁ and ▁▁", "It's 10,000 – naïve 漢字 \U0001F600\x00", "\n", " "]
    return rows + [(900 + n, t) for n, t in enumerate(extra)] + [(1, rows[0][1]), (None, rows[0][1])] + rows[:5]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 300, 0])
def test_alignment_matches_brute_force(documents, small, libraries, frequent):
    rows = rows_of(small)
    docs = documents(rows).repartition(3)
    assert got(alignment.alignment(docs, A, B, frequent)) == slow_alignment(rows, libraries)


def test_odd_rows(odd, clashing, documents, libraries):
    want = slow_alignment(ODD, libraries)
    for df in (odd, clashing):
        assert got(alignment.alignment(df, A, B)) == want
    none = alignment.alignment(documents([]), A, B)
    assert none.columns == COLUMNS and none.count() == 0


def test_slabs_change_nothing(monkeypatch, small):
    """Cut at nearly every space, all texts have the tokens they have in one piece."""
    pair = alignment._pair(open(A, "rb").read(), open(B, "rb").read())
    rng = random.Random(6)
    texts = [t for _, t in rows_of(small) if t] + ["".join(rng.choice(" ab'sé1.\n漢\t") for _ in range(400)) for _ in range(60)]
    whole = [align(t, pair) for t in texts]
    monkeypatch.setattr(alignment, "SLAB", 3)
    for t, one in zip(texts, whole, strict=True):
        cut = align(t, pair)
        assert (cut.a.tolist(), cut.b.tolist()) == (one.a.tolist(), one.b.tolist())


def test_a_very_long_line():
    pair = alignment._pair(open(A, "rb").read(), open(B, "rb").read())
    for text in ("word " * 1_000_000, "xyz" * 700_000):
        one = align(text, pair)
        in_a, in_b = links(one)
        assert one.ends_a[-1] == one.ends_b[-1] == len(text) + 1
        assert len(in_a) == len(one.a) + len(one.b) - len(one.shared)


def test_faster_library_and_the_file_agree(small, libraries):
    side = byte_side(open(A, "rb").read())
    for _, text in rows_of(small):
        if text:
            assert side.encode(" " + text) == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_entries(libraries):
    side = piece_side(open(B, "rb").read())
    assert side.entries[libraries[1].piece_to_id("<0x0A>")] == b"\n" and side.entries[libraries[1].piece_to_id("▁the")] == b" the"
