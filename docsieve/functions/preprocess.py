"""Named document preprocessors: text column in, text column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions import text as tx
from docsieve.functions.stemming import stem_words

Preprocessor = Callable[[Column], Column]


def _without_urls(doc: Column) -> Column:
    return tx.strip_urls(F.lower(doc))


def _stemmed(doc: Column) -> Column:
    return F.array_join(stem_words(tx.tokenize(_without_urls(doc))), " ")


# The names that settings use.
PREPROCESSORS: dict[str, Preprocessor] = {
    "printable": tx.printable_ascii,
    "vectorizer_preprocessor": _without_urls,
    "vectorizer_preprocessor_stem": _stemmed,
}


def register(name: str, function: Preprocessor) -> None:
    """Make a preprocessor selectable by name."""
    PREPROCESSORS[name] = function


def preprocess(doc: Column, name: str | None) -> Column:
    """Apply a preprocessor by name and strip the result; None or 'None' leaves the text as it is."""
    if name is None or name == "None":
        return doc
    if name not in PREPROCESSORS:
        raise ValueError(f"unknown preprocessor {name!r}; known: {sorted(PREPROCESSORS)}")
    return tx.strip_field(PREPROCESSORS[name](doc))
