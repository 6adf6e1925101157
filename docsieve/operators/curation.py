"""Extracts over the five curation tables: training records, candidates, progress counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.config import Settings
from docsieve.functions.documents import FACTOR_SEPARATOR, build_document, factor_terms, reject_reason
from docsieve.functions.preprocess import preprocess
from docsieve.functions.text import blank_breaks


@dataclass(frozen=True)
class Tables:
    """experiment(experiment_key, name, description, evaluation_state_key, evaluated_by_key),
    accession(accid, object_key, object_type_key, source_key),
    property(object_key, object_type_key, term_key, value), term(term_key, term), user(user_key, user_name)."""

    experiment: DataFrame
    accession: DataFrame
    property: DataFrame
    term: DataFrame
    user: DataFrame


@dataclass(frozen=True)
class Keys:
    """Dictionary keys the extracts filter on; the defaults are fixed values of the source schema."""

    object_type: int = 42
    source: int = 189
    not_evaluated: int = 20225941
    loader_user: int = 1561
    factor_term: str = "raw experimental factor"
    evaluated_terms: tuple[str, ...] = ("Yes", "No")


def factor_lists(tables: Tables, keys: Keys) -> DataFrame:
    """(accid, factors): the factor values of each accession in one string, in value order.

    Property rows are cut to the factor term first, so only those meet the accessions.
    """
    wanted = tables.term.filter(F.col("term") == keys.factor_term)
    factors = tables.property.filter(F.col("object_type_key") == keys.object_type).join(wanted, "term_key")
    ids = tables.accession.filter(
        (F.col("source_key") == keys.source) & (F.col("object_type_key") == keys.object_type)
    )
    return (
        factors.select("object_key", "value")
        .join(ids.select("object_key", "accid"), "object_key")
        .groupBy("accid")
        .agg(F.expr(f"listagg(value, '{FACTOR_SEPARATOR}') WITHIN GROUP (ORDER BY value)").alias("factors"))
    )


def _with_accession(tables: Tables, keys: Keys, kept: Column) -> DataFrame:
    ids = tables.accession.filter(F.col("source_key") == keys.source).select("accid", "object_key")
    return tables.experiment.filter(kept).join(ids, F.col("object_key") == F.col("experiment_key"))


def _columns(*first: Column) -> list[Column]:
    return [
        F.col("accid").alias("exp_id"), *first, F.col("factors"), F.col("name").alias("title"),
        blank_breaks(F.col("description")).alias("description"),
    ]


def training_extract(tables: Tables, keys: Keys) -> DataFrame:
    """Records evaluated by a person; a missing evaluator does not count as one."""
    states = tables.term.filter(F.col("term").isin(*keys.evaluated_terms))
    by_person = F.col("evaluated_by_key") != keys.loader_user
    return (
        _with_accession(tables, keys, by_person)
        .join(states, F.col("evaluation_state_key") == F.col("term_key"))
        .join(factor_lists(tables, keys), "accid", "left")
        .select(*_columns(F.col("term").alias("eval_state")))
    )


def candidate_extract(tables: Tables, keys: Keys) -> DataFrame:
    """Records nobody has evaluated yet."""
    waiting = F.col("evaluation_state_key") == keys.not_evaluated
    return _with_accession(tables, keys, waiting).join(factor_lists(tables, keys), "accid", "left").select(*_columns())


def evaluation_stats(tables: Tables) -> DataFrame:
    """Records per evaluation state and evaluator, unknown evaluators last."""
    counts = tables.experiment.groupBy("evaluation_state_key", "evaluated_by_key").agg(F.count("*").alias("n"))
    return (
        counts.join(tables.term, F.col("evaluation_state_key") == F.col("term_key"))
        .join(tables.user, F.col("evaluated_by_key") == F.col("user_key"), "left")
        .groupBy("term", "user_name")
        .agg(F.sum("n").alias("n_records"))
        .orderBy(F.asc_nulls_last("user_name"), "term")
    )


def prepare(records: DataFrame, settings: Settings) -> DataFrame:
    """Append factor terms, the processed document and the reject reason to extracted records."""
    document = build_document(F.col("title"), F.col("description"), F.col("factors"))
    return records.withColumns(
        {
            "factor_terms": factor_terms(F.col("factors")),
            "document": preprocess(document, settings.preprocessor),
            "reject_reason": reject_reason(
                F.col("exp_id"), F.col("title"), settings.reject_prefix, settings.keep_rejected
            ),
        }
    )


def kept(prepared: DataFrame) -> DataFrame:
    return prepared.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def outcome_counts(prepared: DataFrame, class_column: Column) -> DataFrame:
    """How many records were skipped and how many kept per class."""
    kind = F.when(F.col("reject_reason").isNotNull(), "skipped").otherwise(class_column)
    return prepared.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_records"))


def subtract(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(key), key, "left_anti")
