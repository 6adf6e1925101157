import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsieve.functions import text as tx
from docsieve.functions.documents import build_document, class_index, factor_terms, reject_reason, run_stamp, parse_run_stamp
from docsieve.functions.preprocess import PREPROCESSORS, preprocess, register
from docsieve.functions.stemming import stem_last_words, stem_words
from docsieve.operators.analyzer import Analyzer
from docsieve.sources.records import decode_bytes


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "factors, expected",
    [
        ("Age (days) | sex|a | RNA-seq", "EF age_days_EF rna_seq_EF sex_EF"),
        ("None", ""), ("", ""), (None, ""), ("x", "EF"), ("sex|sex", "sex_EF sex_EF"),
    ],
)
def test_factor_terms(spark, factors, expected):
    assert one(spark, factor_terms(F.col("f")), f=factors) == expected


def test_document_parts_may_be_missing(spark):
    document = build_document(F.col("t"), F.col("d"), F.col("f"))
    assert one(spark, document, t="A title", d=None, f=None) == "A title ---  --- "
    assert one(spark, document, t="A", d="B", f="sex") == "A --- B --- sex_EF"


def test_reject_reason_is_case_sensitive_and_switchable(spark):
    rule = reject_reason(F.col("i"), F.col("t"), "ENC")
    assert one(spark, rule, i="7", t="an ENC record") == "Encode experiment 7"
    assert one(spark, rule, i="7", t="an enc record") is None
    assert one(spark, reject_reason(F.col("i"), F.col("t"), "ENC", keep_rejected=True), i="7", t="ENC") is None


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=60))
def test_accents_match_the_unicode_data(spark, value):
    kept = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    assert one(spark, tx.fold_accents(F.col("v")), v=value) == kept
    plain = "".join(c for c in kept if ord(c) < 128)
    assert one(spark, tx.fold_accents(F.col("v"), "ascii"), v=value) == plain


def test_accents_expansions(spark):
    assert one(spark, tx.fold_accents(F.col("v")), v="ﬁn ½ 각 ÀÉ ß") == unicodedata.normalize("NFKD", "ﬁn ½ 각 AE ß")


def test_token_patterns(spark):
    text = "a 3d _x e12 don't ßtraße 00 night"
    assert one(spark, tx.tokenize(F.col("v")), v=text) == ["_x", "e12", "don", "tra", "night"]
    assert one(spark, tx.tokenize(F.col("v"), "default"), v=text) == ["3d", "_x", "e12", "don", "ßtraße", "00", "night"]
    assert "éa" not in one(spark, tx.tokenize(F.col("v"), "unicode"), v="éa ab")


def test_invalid_bytes_become_replacement_characters(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xe2\x27 end"),)], "b binary")
    assert df.select(decode_bytes(F.col("b")).alias("x")).first()["x"] == "ok �' end"


def terms(spark, text, analyzer=None, preprocessor=None):
    df = spark.createDataFrame([(text,)], "text string")
    if preprocessor:
        df = df.withColumn("text", preprocess(F.col("text"), preprocessor))
    return (analyzer or Analyzer()).terms(df).first()["terms"]


def test_pairs_close_over_left_out_words(spark):
    """Stop words and tokens the rule does not take are gone before pairs are made."""
    pairs = lambda text: terms(spark, text, Analyzer(ngrams=(2, 2)))
    assert pairs("light of the moon") == ["light moon"]
    assert pairs("plate 96 well") == ["plate well"]
    assert pairs("of moon") == [] and pairs("") == []


def test_rules_meet_in_one_text(spark):
    text = "Naïve cells/gene_7 (3x) were re-plated: CAFÉ"
    assert terms(spark, text) == ["naive", "cells", "gene_7", "re", "plated", "cafe"]
    longest = "x" * 5_000
    assert terms(spark, f"a {longest} b") == [longest]


@pytest.mark.parametrize("name, text, want", [
    ("vectorizer_preprocessor", "as of http://a.test/x?y=z#w nothing", ["nothing"]),
    ("vectorizer_preprocessor", "http://a.test http://b.test", []),
    ("vectorizer_preprocessor_stem", "planting, planted and plants", ["plant", "plant", "plant"]),
    ("vectorizer_preprocessor_stem", "ftp and horses", ["ftp", "hors"]),
])
def test_terms_after_a_preprocessor(spark, name, text, want):
    assert terms(spark, text, preprocessor=name) == want


def test_preprocessor_registry(spark):
    assert one(spark, preprocess(F.col("v"), "None"), v=" a ") == " a "
    register("shout", F.upper)
    try:
        assert one(spark, preprocess(F.col("v"), "shout"), v=" a ") == "A"
    finally:
        PREPROCESSORS.pop("shout")
    with pytest.raises(ValueError):
        preprocess(F.col("v"), "nobody")


STEMS = {
    "consistency": "consist", "knightly": "knight", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas",
    "generate": "generat", "communication": "communic", "hopping": "hop", "hoping": "hope", "agreed": "agre",
    "by": "by", "say": "say", "cry": "cri", "skies": "sky", "dying": "die", "innings": "inning", "relational": "relat",
    "valenci": "valenc", "hopefulness": "hope", "formative": "format", "replacement": "replac", "controll": "control",
    "yellow": "yellow", "youth": "youth", "feed": "feed", "embryonic": "embryon", "testis": "testi",
}


def test_stems(spark):
    assert one(spark, stem_words(F.col("w")), w=list(STEMS)) == list(STEMS.values())


def test_stem_last_word_only(spark):
    grams = ["hopping", "hopping hopping", "a b relational"]
    assert one(spark, stem_last_words(F.col("g")), g=grams) == ["hop", "hopping hop", "a b relat"]


def test_class_order(spark):
    assert one(spark, class_index(F.col("c")), c="yes") == 1
    assert one(spark, class_index(F.col("c"), ("yes", "no")), c="yes") == 0
    assert one(spark, class_index(F.col("c")), c="maybe") is None


def test_run_stamp_round_trip(spark):
    stamp = "2018/04/05-11-25-58"
    assert one(spark, run_stamp(parse_run_stamp(F.col("s"))), s=stamp) == stamp
