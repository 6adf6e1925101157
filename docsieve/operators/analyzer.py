"""From text to n-gram terms, as DataFrame steps and as a pipeline stage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions import text as tx
from docsieve.functions.stemming import stem_last_words, stem_words
from docsieve.functions.stopwords import ENGLISH


@dataclass(frozen=True)
class Analyzer:
    """Lower-case, fold accents, tokenise, drop stop words, build n-grams, stem.

    ``stem`` is None, ``"words"`` (before the stop words) or ``"last"`` (last word of each n-gram).
    """

    accents: str | None = "unicode"
    lowercase: bool = True
    pattern: str = "ascii"
    stop_words: tuple[str, ...] | None = ENGLISH
    ngrams: tuple[int, int] = (1, 1)
    stem: str | None = None

    def with_options(self, **changes: object) -> Analyzer:
        return replace(self, **changes)

    def tokens(self, df: DataFrame, text: str = "text", output: str = "tokens") -> DataFrame:
        """Append the token array after stop words."""
        value = F.lower(text) if self.lowercase else F.col(text)
        value = F.coalesce(tx.fold_accents(value, self.accents), F.lit(""))
        df = df.withColumn(output, tx.tokenize(value, self.pattern))
        if self.stem == "words":
            df = df.withColumn(output, stem_words(F.col(output)))
        if self.stop_words:
            df = df.withColumn(output, tx.drop_words(F.col(output), self.stop_words))
        return df

    def terms(self, df: DataFrame, text: str = "text", output: str = "terms") -> DataFrame:
        """Append the array of all n-grams in the range, repeats kept."""
        low, high = self.ngrams
        columns = df.columns
        tag = f"_{uuid.uuid4().hex[:6]}_"
        df = self.tokens(df, text, f"{tag}1")
        for n in range(2, high + 1):
            df = df.withColumn(f"{tag}{n}", tx.next_ngrams(F.col(f"{tag}{n - 1}"), F.col(f"{tag}1"), n))
        sizes = [F.col(f"{tag}{n}") for n in range(low, high + 1)]
        # Tokens of the named patterns hold no space, so the last word of an n-gram is a token and each is stemmed once.
        if stems_once := self.stem == "last" and self.pattern in tx.TOKEN_PATTERNS:
            df = df.withColumn(f"{tag}s", stem_words(F.col(f"{tag}1")))
            stems = F.col(f"{tag}s")
            sizes = [stems if n == 1 else tx.next_ngrams(F.col(f"{tag}{n - 1}"), stems, n) for n in range(low, high + 1)]
        grams = sizes[0] if len(sizes) == 1 else F.concat(*sizes)
        if self.stem == "last" and not stems_once:
            grams = stem_last_words(grams)
        return df.select(*columns, grams.alias(output))


BLESSED_ANALYZER = Analyzer()


class TextTerms(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage around :class:`Analyzer`; saves and loads with the pipeline."""

    accents = Param(Params._dummy(), "accents", "unicode, ascii or none", TypeConverters.toString)
    lowercase = Param(Params._dummy(), "lowercase", "lower-case first", TypeConverters.toBoolean)
    pattern = Param(Params._dummy(), "pattern", "token pattern", TypeConverters.toString)
    stopWords = Param(Params._dummy(), "stopWords", "stop words", TypeConverters.toListString)
    ngrams = Param(Params._dummy(), "ngrams", "lowest and highest n", TypeConverters.toListInt)
    stem = Param(Params._dummy(), "stem", "none, words or last", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, accents=None, lowercase=None, pattern=None,
                 stopWords=None, ngrams=None, stem=None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="terms", accents="unicode", lowercase=True, pattern="ascii",
                         stopWords=list(ENGLISH), ngrams=[1, 1], stem="none")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, analyzer: Analyzer, text: str = "text", output: str = "terms") -> TextTerms:
        return cls(
            inputCol=text, outputCol=output, accents=analyzer.accents or "none", lowercase=analyzer.lowercase,
            pattern=analyzer.pattern, stopWords=list(analyzer.stop_words or ()), ngrams=list(analyzer.ngrams),
            stem=analyzer.stem or "none",
        )

    def analyzer(self) -> Analyzer:
        def given(value: str) -> str | None:
            return None if value == "none" else value

        return Analyzer(
            accents=given(self.getOrDefault("accents")), lowercase=self.getOrDefault("lowercase"),
            pattern=self.getOrDefault("pattern"), stop_words=tuple(self.getOrDefault("stopWords")) or None,
            ngrams=tuple(self.getOrDefault("ngrams")), stem=given(self.getOrDefault("stem")),
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.analyzer().terms(dataset, self.getInputCol(), self.getOutputCol())
