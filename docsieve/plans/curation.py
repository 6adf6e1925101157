"""Extraction and preparation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.documents import class_index, class_name, factor_terms
from docsieve.operators import curation
from docsieve.plans import mapping as m
from docsieve.sources.records import parse_records, require_known_class
from docsieve.sources.tables import read_table

_WITH = f"WITH {m.SQL_TABLES}"
_WITH_PREPARED = f"WITH {m.SQL_TABLES}, {m.SQL_PREPARED}"


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    return curation.prepare(curation.training_extract(m.curation_tables(spark, folder), m.KEYS), m.SETTINGS)


def training_documents(spark: SparkSession, folder: str) -> DataFrame:
    kept = curation.kept(_prepared(spark, folder))
    return kept.withColumn("class_name", F.lower("eval_state")).orderBy("exp_id")


def predict_candidates(spark: SparkSession, folder: str) -> DataFrame:
    records = curation.candidate_extract(m.curation_tables(spark, folder), m.KEYS)
    return records.orderBy("exp_id")


def factor_agg(spark: SparkSession, folder: str) -> DataFrame:
    return curation.factor_lists(m.curation_tables(spark, folder), m.KEYS)


def evaluation_stats(spark: SparkSession, folder: str) -> DataFrame:
    return curation.evaluation_stats(m.curation_tables(spark, folder))


def reject_counts(spark: SparkSession, folder: str) -> DataFrame:
    return curation.outcome_counts(_prepared(spark, folder), F.lower("eval_state"))


def class_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Records of class 'No', once by the class column and once by the raw line pattern."""
    records = curation.training_extract(m.curation_tables(spark, folder), m.KEYS)
    line = F.concat_ws("\t", "exp_id", "eval_state", F.coalesce("factors", F.lit("")), "title", "description")
    by_line = line.rlike("^exp ID\t|\tNo\t")
    return (
        records.select("exp_id", (F.col("eval_state") == "No").alias("by_class"), by_line.alias("by_line"))
        .filter("by_class OR by_line")
    )


def subtract_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose ID is not among the labelled ones."""
    left = m.documents(spark, folder).select("doc_id", "lang", "source")
    return curation.subtract(left, read_table(spark, folder, "labels"), "doc_id")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Record lines of all layouts: labelled and unlabelled records, chat turns, benchmark items."""
    docs = m.title_and_description(m.documents(spark, folder))
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id", "left")
    description = F.translate("description", "\t\n", "  ")
    factors = F.concat_ws(" | ", "lang", "source")
    state = F.when(F.col("quality") == 1, " Yes ").otherwise(" No ")
    five = F.concat_ws("\t", m.record_id(), state, factors, F.translate("name", "\t", " "), description)
    four = F.concat_ws("\t", m.record_id(), factors, F.translate("name", "\t", " "), description)
    records = joined.select(F.when(F.col("quality").isNotNull(), five).otherwise(four).alias("value"))
    flat = F.translate("text", "\t\n", "  ")
    turns = read_table(spark, folder, "conversations").select(
        F.concat_ws("\t", F.concat_ws("-", "conv_id", "turn"), "role", flat).alias("value")
    )
    items = read_table(spark, folder, "benchmark").select(
        F.concat_ws("\t", "item_id", flat, F.lit(""), F.lit(""), F.lit(""), F.lit("")).alias("value")
    )
    return records.unionByName(turns).unionByName(items)


def arity_parse(spark: SparkSession, folder: str) -> DataFrame:
    return require_known_class(parse_records(_lines(spark, folder)))


def label_remap(spark: SparkSession, folder: str) -> DataFrame:
    """Class index by name in the usual order and in the reversed one."""
    labels = read_table(spark, folder, "labels")
    named = labels.withColumn("class_name", class_name(F.col("quality")))
    return named.select(
        "doc_id", "class_name",
        class_index(F.col("class_name")).alias("idx"),
        class_index(F.col("class_name"), ("yes", "no")).alias("idx_reordered"),
    )


def factor_terms_query(spark: SparkSession, folder: str) -> DataFrame:
    """Factor strings with punctuation: part types and brands of an order, and its priority."""
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = read_table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    values = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", F.concat_ws(" | ", "p_type", "p_brand").alias("value")
    )
    lists = values.groupBy("l_orderkey").agg(
        F.expr("listagg(value, ' | ') WITHIN GROUP (ORDER BY value)").alias("value")
    )
    joined = orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    factors = F.concat_ws(" | ", "value", "o_orderpriority")
    return joined.select("o_orderkey", factors.alias("factors"), factor_terms(factors).alias("terms"))


QUERIES = {
    "training_documents": training_documents,
    "predict_candidates": predict_candidates,
    "factor_agg": factor_agg,
    "evaluation_stats": evaluation_stats,
    "reject_counts": reject_counts,
    "class_filter": class_filter,
    "subtract_ids": subtract_ids,
    "arity_parse": arity_parse,
    "label_remap": label_remap,
    "factor_terms": factor_terms_query,
}

SQL = {
    "training_documents": f"""{_WITH_PREPARED}
        SELECT exp_id, eval_state, factors, title, description, factor_terms, document,
               lower(eval_state) AS class_name
        FROM prepared WHERE reject_reason IS NULL ORDER BY exp_id""",
    "predict_candidates": f"{_WITH} SELECT * FROM candidate ORDER BY exp_id",
    "factor_agg": f"{_WITH} SELECT accid, factors FROM factor_list",
    "evaluation_stats": f"""{_WITH}
        SELECT t.term, u.user_name, count(*) AS n_records
        FROM experiment e JOIN term t ON e.evaluation_state_key = t.term_key
        LEFT JOIN users u ON e.evaluated_by_key = u.user_key
        GROUP BY t.term, u.user_name ORDER BY u.user_name NULLS LAST, t.term""",
    "reject_counts": f"""{_WITH_PREPARED}
        SELECT CASE WHEN reject_reason IS NOT NULL THEN 'skipped' ELSE lower(eval_state) END AS kind,
               count(*) AS n_records
        FROM prepared GROUP BY 1""",
    "class_filter": f"""{_WITH}
        SELECT * FROM (
          SELECT exp_id, eval_state = 'No' AS by_class,
                 regexp_matches(exp_id || chr(9) || eval_state || chr(9) || coalesce(factors, '') || chr(9) || title
                                || chr(9) || description, '^exp ID\\t|\\tNo\\t') AS by_line
          FROM training)
        WHERE by_class OR by_line""",
    "subtract_ids": """
        SELECT doc_id, lang, source FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "arity_parse": """
        WITH doc AS (
          SELECT d.doc_id, l.quality, d.lang || ' | ' || d.source AS factors,
                 translate(split_part(d.text, chr(10), 1), chr(9), ' ') AS title,
                 translate(CASE WHEN instr(d.text, chr(10)) > 0 THEN substr(d.text, instr(d.text, chr(10)) + 1)
                                ELSE '' END, chr(9) || chr(10), '  ') AS description
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
        line AS (
          SELECT CASE WHEN quality IS NOT NULL
                 THEN concat_ws(chr(9), 'D-' || doc_id, CASE quality WHEN 1 THEN ' Yes ' ELSE ' No ' END, factors, title, description)
                 ELSE concat_ws(chr(9), 'D-' || doc_id, factors, title, description) END AS raw
          FROM doc
          UNION ALL
          SELECT concat_ws(chr(9), conv_id || '-' || turn, role, translate(text, chr(9) || chr(10), '  ')) FROM conversations
          UNION ALL
          SELECT item_id || chr(9) || translate(text, chr(9) || chr(10), '  ') || repeat(chr(9), 4) FROM benchmark),
        part AS (
          SELECT raw, list_transform(string_split(raw, chr(9)),
                                     lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS f
          FROM line)
        SELECT CASE len(f) WHEN 5 THEN f[1] WHEN 4 THEN f[1] END AS id,
               CASE len(f) WHEN 5 THEN lower(f[2]) END AS class_name,
               CASE len(f) WHEN 5 THEN f[3] WHEN 4 THEN f[2] END AS factors,
               CASE len(f) WHEN 5 THEN f[4] WHEN 4 THEN f[3] END AS title,
               CASE len(f) WHEN 5 THEN f[5] WHEN 4 THEN f[4] END AS description,
               CAST(len(f) AS INTEGER) AS n_fields,
               CASE WHEN len(f) NOT IN (4, 5) THEN 'field count ' || len(f)
                    WHEN len(f) = 4 OR lower(f[2]) NOT IN ('no', 'yes') THEN 'no known class' END AS quarantine_reason,
               raw
        FROM part""",
    "label_remap": """
        SELECT doc_id, CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS class_name,
               CAST(quality AS INTEGER) AS idx, CAST(1 - quality AS INTEGER) AS idx_reordered
        FROM labels""",
    "factor_terms": f"""
        WITH lists AS (
          SELECT l_orderkey, string_agg(p_type || ' | ' || p_brand, ' | ' ORDER BY p_type || ' | ' || p_brand) AS value
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
        joined AS (
          SELECT o_orderkey, concat_ws(' | ', value, o_orderpriority) AS factors
          FROM orders LEFT JOIN lists ON o_orderkey = l_orderkey)
        SELECT o_orderkey, factors, {m.sql_factor_terms('factors')} AS terms FROM joined""",
}
