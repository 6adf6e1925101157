"""The test tables seen as curation tables, in Spark and in SQL side by side.

Every document is a record: its first line is the title, the rest the description, its
label the evaluation state, the number in its source the evaluator. The language and
source of documents that are not in English are factor values; usage events and
toxicity marks are properties of other kinds, which the factor filter must drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.config import Settings
from docsieve.operators.curation import Keys, Tables
from docsieve.session import spread
from docsieve.sources.tables import read_table

# Fixed values of this mapping.
OBJECT_TYPE, SOURCE, PAGE_SOURCE, LOADER, UNATTRIBUTED = 42, 189, 190, 3, 19
TERMS = (
    (1, "Not Evaluated"), (2, "Yes"), (3, "No"), (11, "raw factor"), (12, "other"), (13, "usage event"),
)
_TERM_ROWS = ", ".join(f"({k}, '{t}')" for k, t in TERMS)
KEYS = Keys(
    object_type=OBJECT_TYPE, source=SOURCE, not_evaluated=1, loader_user=LOADER, factor_term="raw factor"
)
SETTINGS = Settings(reject_prefix="Der")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def title_and_description(docs: DataFrame) -> DataFrame:
    """(doc_id, name, description) and the other columns without the text."""
    cut = F.instr("text", "\n")
    rest = F.when(cut > 0, F.substring(F.col("text"), cut + 1, F.length("text"))).otherwise("")
    return docs.withColumn("name", F.substring_index("text", "\n", 1)).withColumn("description", rest).drop("text")


def record_id(key: str = "doc_id"):
    return F.concat(F.lit("D-"), F.col(key))


def curation_tables(spark: SparkSession, folder: str) -> Tables:
    docs = documents(spark, folder)
    labels = read_table(spark, folder, "labels")
    state = F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 3).otherwise(1)
    evaluator = F.nullif(F.substring("source", 4, 9).cast("int"), F.lit(UNATTRIBUTED))
    experiment = title_and_description(docs.select("doc_id", "text", "source")).join(
        labels.select("doc_id", "quality"), "doc_id", "left"
    ).select(
        F.col("doc_id").alias("experiment_key"), "name", "description",
        state.alias("evaluation_state_key"), evaluator.alias("evaluated_by_key"),
    )

    def ids(df: DataFrame, key: str, prefix: str, source: int) -> DataFrame:
        return df.select(
            F.concat(F.lit(prefix), F.col(key)).alias("accid"), F.col(key).alias("object_key"),
            F.lit(OBJECT_TYPE).alias("object_type_key"), F.lit(source).alias("source_key"),
        )

    def values(df: DataFrame, key: str, term: int, value) -> DataFrame:
        return df.select(
            F.col(key).alias("object_key"), F.lit(OBJECT_TYPE).alias("object_type_key"),
            F.lit(term).alias("term_key"), value.alias("value"),
        )

    foreign = docs.filter(F.col("lang") != "en")
    properties = (
        values(foreign, "doc_id", 11, F.col("lang"))
        .unionByName(values(foreign, "doc_id", 11, F.col("source")))
        .unionByName(values(read_table(spark, folder, "events"), "user_id", 13, F.col("event_type")))
        .unionByName(values(labels, "doc_id", 12, F.col("toxic").cast("string")))
    )
    pages = read_table(spark, folder, "pages")
    return Tables(
        experiment=experiment,
        accession=ids(docs, "doc_id", "D-", SOURCE).unionByName(ids(pages, "page_id", "P-", PAGE_SOURCE)),
        property=properties,
        # As inline values the dictionary has a known size, so joins with it need no shuffle.
        term=spark.sql(f"SELECT * FROM VALUES {_TERM_ROWS} AS t(term_key, term)"),
        user=read_table(spark, folder, "region").select(
            F.col("r_regionkey").alias("user_key"), F.col("r_name").alias("user_name")
        ),
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, label) of the documents that have a quality label; label 1 is 'yes'."""
    labels = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = documents(spark, folder).select("doc_id", "text")
    return spread(docs.join(labels, "doc_id"), "doc_id")


SQL_TABLES = f"""
experiment AS (
  SELECT d.doc_id AS experiment_key, split_part(d.text, chr(10), 1) AS name,
         CASE WHEN instr(d.text, chr(10)) > 0 THEN substr(d.text, instr(d.text, chr(10)) + 1) ELSE '' END AS description,
         CASE l.quality WHEN 1 THEN 2 WHEN 0 THEN 3 ELSE 1 END AS evaluation_state_key,
         nullif(CAST(substr(d.source, 4) AS INTEGER), {UNATTRIBUTED}) AS evaluated_by_key
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
accession AS (
  SELECT 'D-' || doc_id AS accid, doc_id AS object_key, {OBJECT_TYPE} AS object_type_key, {SOURCE} AS source_key
  FROM documents
  UNION ALL SELECT 'P-' || page_id, page_id, {OBJECT_TYPE}, {PAGE_SOURCE} FROM pages),
property AS (
  SELECT doc_id AS object_key, {OBJECT_TYPE} AS object_type_key, 11 AS term_key, lang AS value
  FROM documents WHERE lang <> 'en'
  UNION ALL SELECT doc_id, {OBJECT_TYPE}, 11, source FROM documents WHERE lang <> 'en'
  UNION ALL SELECT user_id, {OBJECT_TYPE}, 13, event_type FROM events
  UNION ALL SELECT doc_id, {OBJECT_TYPE}, 12, CAST(toxic AS VARCHAR) FROM labels),
term AS (SELECT * FROM (VALUES {_TERM_ROWS}) AS v(term_key, term)),
users AS (SELECT r_regionkey AS user_key, r_name AS user_name FROM region),
named AS (
  SELECT object_key, min(accid) AS public_id FROM accession
  WHERE object_type_key = {OBJECT_TYPE} AND source_key = {SOURCE} GROUP BY object_key),
factor_list AS (
  SELECT public_id AS accid, array_to_string(list_sort(list(value)), ' | ') AS factors
  FROM (SELECT object_key, value FROM property WHERE object_type_key = {OBJECT_TYPE}
          AND term_key IN (SELECT term_key FROM term WHERE term = 'raw factor')) AS raw
  INNER JOIN named USING (object_key)
  GROUP BY public_id),
described AS (
  SELECT public_id AS exp_id, evaluation_state_key, evaluated_by_key, name AS title,
         replace(replace(description, chr(9), ' '), chr(10), ' ') AS description
  FROM experiment INNER JOIN named ON named.object_key = experiment.experiment_key),
training AS (
  SELECT exp_id, state.term AS eval_state, factors, title, description
  FROM (SELECT * FROM described WHERE evaluated_by_key IS NOT NULL AND NOT evaluated_by_key = {LOADER}) AS judged
  INNER JOIN (SELECT * FROM term WHERE term = 'Yes' OR term = 'No') AS state ON state.term_key = evaluation_state_key
  LEFT JOIN factor_list ON accid = exp_id),
candidate AS (
  SELECT exp_id, factors, title, description
  FROM (SELECT * FROM described WHERE evaluation_state_key = 1) AS waiting
  LEFT JOIN factor_list ON accid = exp_id)
"""


def sql_factor_terms(column: str) -> str:
    """The factor-term rule as a SQL expression."""
    token = (
        "array_to_string(list_filter(string_split(regexp_replace(lower(trim(t)), '[^a-z0-9_]', '_', 'g') || '_EF', '_'), "
        "lambda p: length(p) > 1), '_')"
    )
    return (
        f"CASE WHEN {column} IS NULL OR {column} IN ('', 'None') THEN '' ELSE "
        f"array_to_string(list_sort(list_transform(string_split({column}, '|'), lambda t: {token})), ' ') END"
    )


SQL_PREPARED = f"""
prepared AS (
  SELECT *, {sql_factor_terms('factors')} AS factor_terms,
         title || ' --- ' || description || ' --- ' || {sql_factor_terms('factors')} AS document,
         CASE WHEN contains(title, '{SETTINGS.reject_prefix}') THEN 'Encode experiment ' || exp_id END AS reject_reason
  FROM training)
"""
