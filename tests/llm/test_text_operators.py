"""Line dedup, licences, pieces and decontamination against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import sentencepiece

from docsieve.llm import decontaminate, licenses, line_dedup, pieces
from tests.llm.conftest import ODD

LINES = ["This line is long enough to count", "  this LINE is long enough to count\t", "Another long line, with commas", "short", "", "ÄÖÜ äöü a long line of letters"]


def kept_lines(rows, least=3, chars=20):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    owners = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            owners[key(line)].add(-(2**63) if i is None else i)
    result = []
    for i, text in rows:
        own = -(2**63) if i is None else i
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= chars and len(owners[key(x)]) >= least and own != max(owners[key(x)]))]
        result.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(result, key=repr)


def deduped(df):
    from pyspark.sql import functions as F

    rows = line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_line_dedup_matches_brute_force(documents):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    assert deduped(documents(rows)) == kept_lines(rows)


def test_line_dedup_of_odd_rows(odd, clashing):
    assert deduped(odd) == kept_lines(ODD)
    assert deduped(clashing) == kept_lines(ODD)


def test_line_dedup_heavy_and_rare_keys_agree(documents, monkeypatch):
    rows = [(i, "the same line in every document\nand a line of its own %04d\n%s" % (i, LINES[i % 3])) for i in range(50)]
    want = kept_lines(rows)
    assert deduped(documents(rows)) == want
    monkeypatch.setattr(line_dedup, "HEAVY_PARTS", 1)  # no key is heavy
    assert deduped(documents(rows)) == want


def test_line_dedup_of_nothing(documents):
    assert deduped(documents([])) == []


@pytest.mark.parametrize(("positions", "runs"), [([0], [(0, 1)]), ([1, 2, 3, 7], [(1, 3), (7, 1)]), ([0, 2, 4], [(0, 1), (2, 1), (4, 1)])])
def test_bitmap_runs(spark, positions, runs):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(positions,)], "p array<int>").select(line_dedup.as_runs(F.col("p")).alias("r")).first()
    assert [tuple(r) for r in row["r"]] == runs


@pytest.mark.parametrize(("text", "found", "rest"), [
    ("Released under the MIT License.", "MIT", ""),
    ("Some text. Licensed under the Apache License, Version 2.0.\nMore.", "Apache-2.0", ""),
    ("This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "MIT,GPL-3.0-only", ""),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "", "j"),
    ("You may not use this file except in compliance with the License.", "", "b"),
    ("The licensed under the MIT License thing", "", ""), ("", "", ""), (None, "", ""),
])
def test_license_rules(documents, text, found, rest):
    row = licenses.license_scan(documents([(1, text)])).first()
    assert (row["licenses"], row["unmatched"]) == (found, rest)


# Notices of public licences as files carry them.
MIT_TEXT = """Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE_TEXT = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */"""
BSD_TEXT = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
# 1. Redistributions of source code must retain the above copyright notice,
#    this list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright
#    notice, this list of conditions and the following disclaimer in the
#    documentation and/or other materials provided with the distribution.
"""
BSD_LAST = """# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products derived from
#    this software without specific prior written permission.
"""
GPL_TEXT = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version {0} of the License, or
// (at your option) any later version.
"""


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("text,found", [
    (MIT_TEXT, "MIT"), (APACHE_TEXT, "Apache-2.0"), (BSD_TEXT, "BSD-2-Clause"), (BSD_TEXT + BSD_LAST, "BSD-3-Clause"),
    (GPL_TEXT.format(2), "GPL-2.0-or-later"), (GPL_TEXT.format(3), "GPL-3.0-or-later"), (f"{APACHE_TEXT}\n\n{MIT_TEXT}", "Apache-2.0,MIT"),
    ("Some words\nReleased under the MIT License\nmore words", "MIT"), (MIT_TEXT.replace("free of charge", "for a fee").replace("copies or", "copies nor"), ""),
])
def test_whole_notices(documents, text, found, ends):
    assert licenses.license_scan(documents([(1, text.replace("\n", ends))])).first()["licenses"] == found


def test_every_rule_is_found_and_no_letter_is_spare(documents):
    """Each rule's sentences, one a line, give its licence; each letter is in a rule or is only a part of others."""
    sentence = {letter: text for text, letter in licenses.SENTENCES.items()}
    df = documents([(i, "\n".join(sentence[x] for x in sequence)) for i, (_, sequence) in enumerate(licenses.RULES)])
    found = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in licenses.license_scan(df).collect()}
    assert found == {i: (name, "") for i, (name, _) in enumerate(licenses.RULES)}
    assert set(sentence) == set("".join(sequence for _, sequence in licenses.RULES))


def test_license_order_matters(documents):
    a, b = "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License."
    rows = licenses.license_scan(documents([(1, f"{a}\n{b}"), (2, f"{b}\n{a}")])).orderBy("doc_id").collect()
    assert [(r["licenses"], r["unmatched"]) for r in rows] == [("Apache-2.0", ""), ("Apache-2.0", "b")]


def test_license_of_odd_rows(odd, clashing):
    for df in (odd, clashing):
        assert licenses.license_scan(df).count() == len(ODD)


@pytest.fixture(scope="module")
def model(piece_model):
    return pieces.load_model(piece_model)


@pytest.fixture(scope="module")
def library(piece_model):
    return sentencepiece.SentencePieceProcessor(model_file=piece_model)


def fuzz(model, n, seed=1):
    rng = random.Random(seed)
    pool = [model.pieces[i].replace("▁", " ") for i in model.plain]
    texts = ["".join(rng.choice(pool[:300] if rng.random() < 0.7 else pool) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    texts += ["".join(rng.choice("ab eht  n\t\n①é\x00漢\U0001F600") for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*texts, "", " ", "▁x", "a" * 5000, " " * 999]


def test_pieces_equal_the_library(model, library):
    texts = fuzz(model, 2000)
    ids, counts = pieces.encode_batch(model, texts)
    ends, got = counts.cumsum(), []
    for a, b in zip(ends - counts, ends, strict=True):
        got.append(ids[a:b].tolist())
    assert got == library.encode(texts)
    assert pieces.decode_batch(model, ids, counts) == [library.decode(g) for g in got]


def test_unigram_model_maximises_the_sum(model):
    """A small unigram model against all segmentations."""
    import numpy as np

    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca"]
    scores = np.array([0, -3.1, -2.2, -2.4, -2.6, -3.3, -3.7, -4.05, -3.2, -4.4])
    small = pieces.Model("unigram", names, scores, np.arange(1, len(names)), np.full(256, -1), 0, [n.encode() for n in names])

    def best(text):
        if not text:
            return 0.0
        return max((scores[i] + best(text[len(names[i]):]) for i in range(1, len(names)) if text.startswith(names[i])), default=-1e9)

    for text in ("abc", "abcabc ca", "cab bca abcb", "aaa", "b  c"):
        ids, _ = pieces.encode_batch(small, [text])
        marked = "▁" + text.replace(" ", "▁")
        assert "".join(names[i] for i in ids) == marked
        assert scores[ids].sum() == pytest.approx(best(marked))
    assert pieces.encode_batch(small, ["xa"])[0].tolist() == [1, 0, 2]


def test_decoding_of_odd_ids(model, library):
    assert pieces.decode_ids(model, None) == pieces.decode_ids(model, []) == ""
    assert pieces.decode_ids(model, [10**6, -4]) == ""
    for ids in ([3, 200], [0, 5000], [1, 5000, 2], [28705, 28705]):
        assert pieces.decode_ids(model, ids) == library.decode(ids)


def test_encoding_of_odd_rows(spark, odd, clashing, model):
    for df in (odd, clashing):
        rows = pieces.encode(df, model).collect()
        assert len(rows) == len(ODD) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    back = pieces.decode(pieces.encode_texts(odd, model), model).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in ODD), key=repr)
    assert pieces.encode_texts(odd.limit(0), model).collect() == []


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def leaks(docs, items, threshold=0.8):
    found = set()
    for item, text in set(items):
        w = words_of(text)
        n = min(5, len(w))
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for doc, body in docs:
            d = words_of(body)
            held = {tuple(d[i : i + n]) for i in range(len(d) - n + 1)}
            if wanted and len(wanted & held) >= threshold * len(wanted):
                found.add((doc, item, len(wanted), len(wanted & held)))
    return sorted(found, key=repr)


def test_decontamination_matches_brute_force(spark, documents):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 12, 20, 33, 60, 0])]
    items += [(50, None), (None, "alpha beta gamma delta epsilon zeta"), (8, items[8][1])]
    docs = []
    for i in range(80):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        passage = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 2)):
            if passage:
                passage[rng.randrange(len(passage))] = "changed"
        docs.append((i, " ".join([*body, *passage, *body[:3]])))
    docs += [(90, None), (91, ""), (None, "Alpha beta gamma  delta epsilon zeta eta")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(documents(docs), benchmark).select("doc_id", "item_id", "n_shingles", "n_found").distinct().collect()
    want = leaks(docs, items)
    assert sorted((tuple(r) for r in found), key=repr) == want
    clean = decontaminate.decontaminate(documents(docs), benchmark)
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((i for i, _ in docs if i not in {w[0] for w in want}), key=repr)


def test_decontamination_of_odd_rows(spark, odd, clashing):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "long enough"), (2, None)], "item_id long, text string")
    for df in (odd, clashing):
        assert decontaminate.contaminated(df, none).count() == 0
        assert decontaminate.decontaminate(df, none).count() == len(ODD)
        assert {r["doc_id"] for r in decontaminate.contaminated(df, some).collect()} == {None, 6, 7}


def test_query_plans_are_native(spark, small):
    from docsieve.llm import queries

    for name in ("op3_line_dedup", "op7_decontaminate", "op9_license_scan"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
