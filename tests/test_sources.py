import datetime as dt

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from docsieve import jobs
from docsieve.config import Settings
from docsieve.operators import models
from docsieve.operators.features import FeatureSpec
from docsieve.operators.pipelines import BLESSED, candidate_pipelines
from docsieve.operators.tuning import TextTuning, expand_grid
from docsieve.sources import corpus, records, sinks
from docsieve.sources.tables import read_table, register_views
from docsieve.streaming.scoring import (
    COUNTS, LEFT_OUT, SCORED, line_stream, read_accounts, record_stream, score_stream, start_accounting, start_scoring,
)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_record_layouts(spark):
    df = records.parse_records(
        lines(spark, "E1\t Yes \tsex\tTitle \tsaid \"x\"\n", "E2\tsex\tT\tD", "a\tb\tc", "a\tb\tc\td\te\tf")
    )
    five, four, three, six = df.collect()
    assert (five["id"], five["class_name"], five["title"], five["description"]) == ("E1", "yes", "Title", 'said "x"')
    assert (four["id"], four["class_name"], four["factors"]) == ("E2", None, "sex")
    assert four["quarantine_reason"] is None
    assert three["quarantine_reason"] == "field count 3" and three["id"] is None and three["raw"] == "a\tb\tc"
    assert six["quarantine_reason"] == "field count 6"
    known = records.require_known_class(df).collect()
    assert [r["quarantine_reason"] for r in known] == [None, "no known class", "field count 3", "field count 6"]


def test_empty_input_keeps_its_schema(spark, tmp_path):
    (tmp_path / "empty.tsv").write_text("exp ID\tfactors\ttitle\tdescription\n")
    df = records.read_tsv(spark, str(tmp_path / "empty.tsv"), records.UNLABELLED)
    assert df.columns == list(records.UNLABELLED) and df.count() == 0


def test_tsv_with_bare_quotes_and_blanks(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('exp ID\tfactors\ttitle\tdescription\nE1\t\ta "b\tc d\nE2\tx\t"y"\tz\n')
    rows = records.read_tsv(spark, str(tmp_path / "a.tsv"), records.UNLABELLED).orderBy("id").collect()
    assert rows[0]["title"] == 'a "b' and rows[0]["factors"] == "" and rows[1]["title"] == '"y"'


def test_document_tree_and_table(spark, tmp_path):
    for name, key, text in (("yes", "E-1", "one"), ("no", "E 2+x", "two"), ("other", "E-3", "three")):
        (tmp_path / "tree" / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name / key).write_bytes(text.encode() + b"\xff")
    tree = corpus.read_document_tree(spark, str(tmp_path / "tree"))
    got = {tuple(r) for r in tree.collect()}
    assert got == {("E-1", "yes", "one�"), ("E 2+x", "no", "two�")}
    corpus.write_corpus(tree, str(tmp_path / "table"))
    assert {(r["id"], r["class_name"], r["text"]) for r in corpus.read_corpus(spark, str(tmp_path / "table")).collect()} == got


def test_prediction_files(spark, tmp_path):
    scored = spark.createDataFrame(
        [("E1", "yes", 1, -0.0417, "sex", "t", "d", "doc")],
        "id string, class_name string, prediction int, confidence double, factors string, title string, description string, document string",
    )
    sinks.write_predictions(scored, str(tmp_path / "long"), long=True)
    text = "".join(p.read_text() for p in (tmp_path / "long").glob("part-*"))
    head, row = sorted(set(text.splitlines()), reverse=True, key=lambda line: line.startswith("ID"))
    assert head.split("\t")[:5] == ["ID", "True Class", "Pred Class", "Confidence", "Abs Value"]
    assert row.split("\t") == ["E1", "yes", "yes", "-0.042", " 0.042", "sex", "t", "d", "doc"]
    assert sinks.prediction_rows(scored.drop("class_name", "confidence")).columns == ["ID", "Pred Class"]


def test_split_predictions_and_reading_them_back(spark, tmp_path):
    scored = spark.createDataFrame(
        [("E1", "test", 1, 0, -0.5), ("E2", "train", 0, 0, -1.0)],
        "id string, split string, label int, prediction int, confidence double",
    )
    sinks.write_split_predictions(scored, str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).orderBy("id").collect()
    assert [(r["split"], r["tag"]) for r in rows] == [("test", "FN"), ("train", "TN")]


def test_prediction_and_evaluation_files(spark, tmp_path):
    (tmp_path / "new.tsv").write_text("ID\tClass\tConf\tAbs\tF\tT\nE1\t1\t0.5\t0.5\tx\ty\nE2\t0\t-0.5\t0.5\t\ty\n")
    rows = records.read_predictions(spark, str(tmp_path / "new.tsv")).orderBy("id").collect()
    assert [r["pred_class"] for r in rows] == ["yes", "no"]
    (tmp_path / "old.tsv").write_text("h\th\th\th\th\th\th\nE1\tG1\tchip\tYes\ts\tc\ta|b\n")
    row = records.read_evaluations(spark, str(tmp_path / "old.tsv"), "no").first()
    assert tuple(row) == ("E1", "chip", "yes", "no")


def test_run_index_appends_and_parses(spark, tmp_path):
    base = {"label": "PRF4,F1", "precision": 0.6, "recall": 0.95, "f4": 0.92, "script": "a", "split_seed": 1,
            "classifier_seed": None, "params": {"C": "1"}}
    for minute, f1 in ((1, 0.74), (2, None)):
        sinks.append_run(spark, str(tmp_path / "runs"), {**base, "ts": dt.datetime(2018, 4, 5, 11, minute), "f1": f1})
    runs = sinks.read_runs(spark, str(tmp_path / "runs"))
    assert runs.count() == 2 and runs.filter("f1 IS NULL").count() == 1
    text = {r["value"] for r in sinks.run_lines(runs).collect()}
    assert "2018/04/05-11-01-00\tPRF4,F1\t0.60\t0.95\t0.92\t0.74\ta" in text
    parsed = sinks.parse_run_lines(spark.createDataFrame([(t,) for t in text], "value string")).orderBy("ts").collect()
    assert [r["f1"] for r in parsed] == [0.74, None] and parsed[0]["script"] == "a"


def test_views(spark, small):
    register_views({"labels_view": read_table(spark, small, "labels")})
    assert spark.sql("SELECT count(*) FROM labels_view").first()[0] > 0


def test_stream_scores_each_record_once(spark, small, tmp_path):
    docs = spark.createDataFrame(
        [(i, "mouse embryo tissue" if i % 2 else "cell culture treatment", i % 2) for i in range(20)],
        "doc_id long, text string, label int",
    )
    run = candidate_pipelines()[BLESSED]
    (candidate,) = expand_grid(run.grid)
    run.features = type(run.features)(1, 1.0)
    model = run.refit(docs, candidate).model
    model.write().overwrite().save(str(tmp_path / "model"))
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.tsv").write_text("exp ID\tfactors\ttitle\tdescription\nE1\tNone\tmouse\tembryo tissue\nE2\tNone\tENCSR1\tx\n")
    (inbox / "b.tsv").write_text("E1\tNone\tmouse\tembryo tissue\nE3\tNone\tcell\tculture\nbroken\tline\n")
    stream = score_stream(record_stream(spark, str(inbox), Settings()), PipelineModel.load(str(tmp_path / "model")))
    start_scoring(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    rows = {r["id"]: r["prediction"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"E1": 1, "E3": 0}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_accounts_for_every_line(spark, tmp_path):
    """Two deliveries and a batch that runs again: each line is scored or left out once, and the counts add up."""
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()

    def run(score=lambda batch: batch.select("id", F.length("text").alias("prediction"))):
        stream = line_stream(spark, str(inbox), Settings(), files_per_batch=1)
        query = start_accounting(stream, score, out, str(tmp_path / "state"))
        query.awaitTermination()
        return query

    (inbox / "a.tsv").write_text("exp ID\tfactors\ttitle\tdescription\nE1\tNone\tmouse\tx\nE1\tNone\tmouse\ty\nE2\tNone\tENCSR1\tx\nbad\tline\n")
    run()
    (inbox / "b.tsv").write_text("E1\tNone\tmouse\tx\nE3\tNone\tcell\tculture\n\n")

    def broken(batch):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(broken)
    assert {r["id"] for r in read_accounts(spark, out, SCORED).collect()} == {"E1"}
    run()
    run()
    assert sorted(r["id"] for r in read_accounts(spark, out, SCORED).collect()) == ["E1", "E3"]
    left = {(r["raw"].split("\t")[0], r["kind"], r["reason"]) for r in read_accounts(spark, out, LEFT_OUT).collect()}
    assert left == {
        ("exp ID", "header", "header line"), ("E1", "repeated", "id seen before"), ("E2", "skipped", "Encode experiment E2"),
        ("bad", "quarantined", "field count 2"), ("", "quarantined", "field count 1"),
    }
    counts = read_accounts(spark, out, COUNTS).groupBy("kind").agg(F.sum("n_lines")).collect()
    assert dict(map(tuple, counts)) == {"kept": 2, "repeated": 2, "header": 1, "skipped": 1, "quarantined": 2}


def test_tuning_job_leaves_a_complete_run_once(spark, tmp_path):
    rows = [(f"Y{i}", "yes", f"embryo {i} mutant tissue") for i in range(14)] + [(f"N{i}", "no", f"culture {i} stem fibroblast") for i in range(14)]
    corpus.write_corpus(spark.createDataFrame(rows, "id string, class_name string, text string"), str(tmp_path / "corpus"))
    run = TextTuning(
        models.Logistic, {"C": [1e-2, 1.0]}, features=FeatureSpec(1, 1.0), seeds={"split": 3, "classifier": 4},
    )
    settings = Settings(grid_beta=2.0, compare_beta=2.0, folds=2, test_fraction=0.25, index_table="runs", prediction_prefix="tags")
    for _ in range(2):
        result = jobs.tune(spark, str(tmp_path / "corpus"), str(tmp_path), run, settings, "first-1", "s")
    assert result.run.folds == 2 and len(result.scores) == 2
    runs = sinks.read_runs(spark, str(tmp_path / "runs")).collect()
    assert [(r["run_id"], r["label"], r["split_seed"], r["script"]) for r in runs] == [("first-1", "PRF2,F1", 3, "s")]
    tags = spark.read.parquet(str(tmp_path / "tags-first-1"))
    assert tags.count() == 28 and tags.filter("split = 'test'").count() == 7
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report-first-1")).collect())
    for part in ("Start: ", "End: ", "### Confusion matrix", "### Options tried", "C\t0.01, 1.0", "### Pipeline", "### Vocabulary", "middle"):
        assert part in text
    loaded = PipelineModel.load(str(tmp_path / "model-first-1"))
    assert loaded.transform(jobs.labelled_corpus(spark, str(tmp_path / "corpus"))).filter("prediction = label").count() > 20
    jobs.tune(spark, str(tmp_path / "corpus"), str(tmp_path), run, settings, "second")
    assert sinks.read_runs(spark, str(tmp_path / "runs")).count() == 2
    with pytest.raises(ValueError):
        sinks.record_run(spark, str(tmp_path / "runs"), "a/b", {})


def test_prepare_and_predict_jobs(spark, tmp_path):
    head = "exp ID\teval state\tfactors\ttitle\tdescription\n"
    rows = [f"Y{i}\tYes\tage\tembryo {i}\tmutant tissue\n" for i in range(8)]
    rows += [f"N{i}\tNo\ttreatment\tculture {i}\tstem fibroblast\n" for i in range(8)]
    rows += ["R1\tYes\t\tlimb (ENCSR070)\tx\n", "Q1\tMaybe\t\tt\td\n", "short\tline\n"]
    (tmp_path / "train.tsv").write_text(head + "".join(rows))
    counts = jobs.prepare_training(spark, str(tmp_path / "train.tsv"), str(tmp_path / "corpus"), Settings())
    assert {r["kind"]: r["n_records"] for r in counts.collect()} == {"yes": 8, "no": 8, "skipped": 1, "quarantined": 2}

    docs = corpus.read_corpus(spark, str(tmp_path / "corpus")).select(
        F.col("id").alias("doc_id"), "text", (F.col("class_name") == "yes").cast("int").alias("label")
    )
    run = candidate_pipelines()[BLESSED]
    run.features = type(run.features)(1, 1.0)
    run.refit(docs, {"C": 1e-2}).model.write().overwrite().save(str(tmp_path / "model"))
    (tmp_path / "new.tsv").write_text(
        "exp ID\tfactors\ttitle\tdescription\nA\tage\tembryo\tmutant\nB\tNone\tculture\tfibroblast\nC\t\tENCSR1\tx\nbad\tline\n"
    )
    counts = jobs.predict_records(
        spark, str(tmp_path / "new.tsv"), str(tmp_path / "model"), str(tmp_path / "short"), Settings(), str(tmp_path / "long")
    )
    assert {r["kind"]: r["n_records"] for r in counts.collect()} == {"scored": 2, "skipped": 1, "quarantined": 1}
    left_out = spark.read.parquet(str(tmp_path / "short-left-out")).collect()
    assert {r["raw"].split("\t")[0]: r["kind"] for r in left_out} == {"C": "skipped", "bad": "quarantined"}
    assert all(r["reason"] for r in left_out)
    text = "".join(p.read_text() for p in (tmp_path / "short").glob("part-*"))
    assert "ID\tPred Class\tConfidence\tAbs Value" in text and "A\tyes\t" in text and "C\t" not in text and "B\tno\t" in text
    assert "Processed Doc" in "".join(p.read_text() for p in (tmp_path / "long").glob("part-*"))
