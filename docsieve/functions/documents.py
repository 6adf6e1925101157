"""Factor terms, document text, reject rule and class names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.config import CLASS_NAMES

# Fixed values of the document format.
FACTOR_SEPARATOR = " | "
FACTOR_SUFFIX = "_EF"
SECTION_SEPARATOR = " --- "
NO_FACTORS = "None"
REJECT_REASON = "Encode experiment "


def _factor_token(term: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(term)), "[^a-z0-9_]", "_")
    pieces = F.split(F.concat(plain, F.lit(FACTOR_SUFFIX)), "_")
    return F.array_join(F.filter(pieces, lambda p: F.length(p) > 1), "_")


def factor_terms(factors: Column) -> Column:
    """One indivisible token per factor term, sorted, duplicates kept; '' for none."""
    terms = F.transform(F.split(factors, r"\|"), _factor_token)
    absent = factors.isNull() | factors.isin("", NO_FACTORS)
    return F.when(absent, F.lit("")).otherwise(F.array_join(F.sort_array(terms), " "))


def build_document(title: Column, description: Column, factors: Column) -> Column:
    """Title, description and factor tokens as one text; NULL parts count as empty."""
    parts = [F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), factor_terms(factors)]
    return F.concat_ws(SECTION_SEPARATOR, *parts)


def reject_reason(record_id: Column, title: Column, prefix: str, keep_rejected: bool = False) -> Column:
    """Why a record is skipped, NULL when it is kept; the test is case-sensitive."""
    if keep_rejected:
        return F.lit(None).cast("string")
    return F.when(title.contains(prefix), F.concat(F.lit(REJECT_REASON), record_id))


def class_name(index: Column) -> Column:
    """Class name for a class index."""
    return F.get(F.array(*[F.lit(n) for n in CLASS_NAMES]), index.cast("int"))


def class_index(name: Column, order: tuple[str, ...] = CLASS_NAMES) -> Column:
    """Position of a class name in ``order``; NULL for an unknown name."""
    position = F.array_position(F.array(*[F.lit(n) for n in order]), name)
    return F.when(position > 0, (position - 1).cast("int"))


def outcome(truth: Column, predicted: Column) -> Column:
    """TP, FP, TN or FN from 0/1 columns."""
    return (
        F.when((truth == 1) & (predicted == 1), "TP")
        .when((truth == 0) & (predicted == 1), "FP")
        .when((truth == 0) & (predicted == 0), "TN")
        .when((truth == 1) & (predicted == 0), "FN")
    )


def confidence_text(value: Column) -> Column:
    """Fixed-width confidence as it is written to prediction files; NULL without one."""
    return F.when(value.isNotNull(), F.format_string("%6.3f", value))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd-HH-mm-ss")


def parse_run_stamp(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy/MM/dd-HH-mm-ss")
