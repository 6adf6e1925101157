import os

import pytest
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text) pairs; lang and source may follow."""

    def make(rows):
        full = [(i, t, *(rest or ("en", "src0")), len(t or "")) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture(scope="session")
def piece_model():
    return f"{TOKENIZERS}/piece_bpe_32k.model"


# Nulls, blanks, repeats, ties and a long text, for every operator on documents.
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (None, "a line that is long enough\nshort"), (4, "word " * 30_000), (5, "one"), (5, "one"),
    (6, "a line that is long enough\nshort"), (7, "A LINE that is long enough  \nother"), (8, "é ü ñ 漢字 \U0001F600"), (None, None),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def clashing(documents, odd):
    """The odd rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("__id", "__v", "name", "head", "version", "fp", "chunk", "lines", "document", "words", "keep", "h1", "rank", "kept", "host", "n", "shingle")
    return odd.select("*", *[F.lit(1).alias(n) for n in names])
