"""Every query with a SQL counterpart gives the same rows in DuckDB; the others give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
LEARNING = [n for n in QUERIES if n not in SQL]


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _sorted(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _sorted(df.collect(), df.columns) == _sorted(result.fetchall(), columns)


@pytest.mark.parametrize("name", [
    "logistic_score", "linear_svc_score", "sgd_score", "decision_tree_score", "kernel_landmark_score", "nb_ml_score",
])
def test_scores_cover_every_labelled_document(spark, small, name):
    df = QUERIES[name](spark, small)
    n = spark.read.parquet(f"{small}/labels.parquet").count()
    rows = df.groupBy(*[c for c in df.columns if c == "model"]).count().collect()
    assert rows and all(r["count"] == n for r in rows)


def test_learners_that_report(spark, small):
    grid = QUERIES["grid_search_report"](spark, small).collect()
    assert len(grid) == 4 and sum(r["is_best"] for r in grid) == 1
    assert {r["n_splits"] for r in QUERIES["split_comparison"](spark, small).collect()} == {2}
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert QUERIES["model_roundtrip"](spark, small).count() == n


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
