"""The pipeline, stage by stage, against plain Python on a small corpus."""

import random

import pytest
import sentencepiece

import corpus_pipeline
from docsieve.llm import quality
from tests.llm.conftest import ODD
from tests.llm.test_similarity import labelled, slow_simhash
from tests.llm.test_text_operators import kept_lines, leaks


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    rng = random.Random(11)
    docs, labels = labelled(rng, 800)
    items = [(i, " ".join(f"item{i}word{k}" for k in range(8 + i))) for i in range(6)]
    shared = "a line that many documents share, word for word"
    rows = []
    for i, text, *rest in docs:
        if i % 9 == 0:
            text += "\n" + shared
        if i % 31 == 0:
            text += " " + items[i % 6][1]
        rows.append((i, text, *rest))
    rows += [(1300 + i, rows[i][1], *rows[i][2:]) for i in range(0, 60, 3)]  # copies
    rows += [(1400 + n, t) for n, (_, t) in enumerate(ODD)] + [(None, "a text without an id")]
    path = str(tmp_path_factory.mktemp("sf"))
    documents(rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items, {i for i, q, t in labels if q == 1 and t == 0}


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The input and the output of every stage, as lists of rows."""
    path, place = folder[0], str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [docs.collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, path)
        assert number == len(corpus_pipeline.STAGES) - 1 or made.schema.names == docs.schema.names
        made.write.parquet(f"{place}/{number}")
        docs = spark.read.parquet(f"{place}/{number}")
        kept.append(docs.collect())
    return kept


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_quality_stage_keeps_clean_documents(stages, folder):
    before, after = stages[0], stages[1]
    kept, clean = {r["doc_id"] for r in after}, folder[2]
    known = {r["doc_id"] for r in before if r["doc_id"] is not None and r["doc_id"] < 800}
    assert len(clean - kept) <= 8 and len((known - clean) & kept) <= 12
    assert len(after) < len(before) and set(after) <= set(before)


def test_quality_decisions_match_its_scores(spark, stages, folder):
    docs, labels = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality.quality(docs, labels).filter("keep").collect()}
    assert {r["doc_id"] for r in stages[1]} == good


def test_line_stage(stages):
    import hashlib

    want = {(i, sha) for i, _, _, sha in kept_lines(pairs(stages[1]))}
    assert {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs(stages[2])} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in stages[2])
    assert len(stages[2]) == len(stages[1]) and any(a != b for a, b in zip(sorted(pairs(stages[1]), key=repr), sorted(pairs(stages[2]), key=repr)))


def test_near_stage_keeps_one_of_each_group(stages):
    groups = slow_simhash(pairs(stages[2]))
    heads = {c for _, _, c in groups if c is not None}
    alone = {f for _, f, c in groups if c is None}
    kept = [r["doc_id"] for r in stages[3]]
    assert sorted(k for k in kept if k is not None) == sorted(heads) and sum(k is None for k in kept) == len(alone)
    assert set(stages[3]) <= set(stages[2]) and len(stages[3]) < len(stages[2])


def test_benchmark_stage(stages, folder):
    bad = {i for i, *_ in leaks(pairs(stages[3]), folder[1])}
    assert bad and {r["doc_id"] for r in stages[4]} == {r["doc_id"] for r in stages[3]} - bad


def test_encoding_stage(stages, piece_model):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    want = {i: library.encode(t or "") for i, t in pairs(stages[4])}
    assert {r["doc_id"]: r["ids"] for r in stages[5]} == want and all(r["round_trip"] for r in stages[5])


def test_run_does_all_stages(spark, stages, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert sorted(rows, key=repr) == sorted(stages[-1], key=repr)
