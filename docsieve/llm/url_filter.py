"""URL filter: fixed rules first, else naive Bayes over segmented host and path words.

Names run words together (``blogofthenews``). A unigram Viterbi splits each distinct name into the words that page texts
use, and a multinomial naive Bayes scores the words of host and path. The urls that a rule judges are its training rows:
it learns what blocked and allowed sites look like and judges the others.

All counts are over all pages: words of the page texts, names, and the class counts of every judged url. Names are
segmented once each, however many urls hold them; a group holds one name and the dictionary words inside it, bounded by
the length of the name times the number of different word lengths. Word statistics come back to the names as sums, and urls get the sums of the distinct names they
hold, so a name that a third of the urls share (a common host) is one row of a small side until the last join, which
adaptive execution splits.

Null url, or no ``://``: host and path are empty, no rule fits, and the verdict is that of the class sizes alone. Without
training rows, or with equal scores, the verdict is ``allow``. Rows with the same url are each returned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import ascii_lower, filled, packed
from docsieve.session import materialize

# The rules, host and path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(filled(url), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(filled(url), URL, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, slash, prefix = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit(f".{site}"))) & F.startswith(path, F.lit(slash + prefix))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def names_in(host: Column, path: Column) -> Column:
    """Runs of letters in host and path, lower case. A run of digits is the one name ``0``: numbers tell sites apart, not classes."""
    shaped = F.regexp_replace(F.lower(F.concat_ws("/", host, path)), r"\p{N}+", ".0.")
    return F.array_remove(F.split(shaped, r"[^\p{L}0]+"), "")


def word_counts(pages: DataFrame, column: str) -> DataFrame:
    """How often each word is in the page texts; tags, scripts and styles left out."""
    text = F.regexp_replace(filled(column), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    found = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return found.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _best_split(name: str, cost: dict[str, float], unknown: float, lengths: Sequence[int]) -> list[str]:
    """The words of least total cost, longer ones first where it is equal; a letter outside the dictionary costs ``unknown``."""
    best, back = np.full(len(name) + 1, np.inf), [0] * (len(name) + 1)
    best[0] = 0.0
    for end in range(1, len(name) + 1):
        for size in lengths:
            start = end - size
            if start < 0:
                continue
            c = cost.get(name[start:end], unknown if end - start == 1 else None)
            if c is not None and best[start] + c < best[end]:
                best[end], back[end] = best[start] + c, start
    parts, end = [], len(name)
    while end:
        parts.append(name[back[end]:end])
        end = back[end]
    return parts[::-1]


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name`` and ``words`` for each distinct ``name``: the unigram Viterbi split by the counts.

    A word costs -log of its share; a letter that is no word costs as much as two words of a single count.
    """
    found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.collect_set(F.char_length("word")).alias("sizes")).first()
    # Only lengths that a dictionary word has are looked at, so one very long word costs one more substring a letter.
    total, lengths = found["t"], sorted({1, *found["sizes"]}, reverse=True)
    left = F.char_length("name") - F.col("at") + 1
    pieces = names.select("name", F.explode(F.sequence(F.lit(1), F.char_length("name"))).alias("at")).select(
        "name", F.explode(F.transform(
            F.filter(F.array(*[F.lit(n) for n in lengths]), lambda k: k <= left), lambda k: F.substring(F.col("name"), F.col("at"), k),
        )).alias("word"),
    ).distinct()
    known = pieces.join(counts, "word").select("name", "word", (-F.log(F.col("n") / F.lit(float(max(total, 1))))).alias("cost"))
    unknown = 2 * float(np.log(max(total, 2)))

    def split_all(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cost = {w: c for w, c in zip(rows["word"], rows["cost"], strict=True) if w is not None}
        return pd.DataFrame({"name": [key[0]], "words": [_best_split(key[0], cost, unknown, lengths)]})

    each = names.select("name", F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("cost"))
    return each.unionByName(known).groupBy("name").applyInPandas(split_all, "name string, words array<string>")


def url_filter(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", text: str = "html"
) -> DataFrame:
    """``document``, the key, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (log odds of block, null where a rule judges)."""
    urls = packed(pages, key, "url").select(
        "document", key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    # Work on the distinct sets of names: far fewer rows than urls.
    bags = urls.select(F.sort_array(names_in(F.col("host"), F.col("path"))).alias("bag"), F.col("fit.verdict").alias("class"))
    bags = materialize(
        bags.groupBy("bag").agg(F.count_if(F.col("class") == "block").alias("block"), F.count_if(F.col("class") == "allow").alias("allow")),
        "bags",
    )
    names = bags.select(F.explode("bag").alias("name")).distinct()
    counts = word_counts(pages, text)
    split = materialize(segment_names(names, materialize(counts, "words")), "names")
    # Class counts of words, by way of names, so that a common name is one row before its words are counted.
    by_name = bags.select(F.explode("bag").alias("name"), "block", "allow").groupBy("name").agg(
        F.sum("block").alias("block"), F.sum("allow").alias("allow")
    )
    in_class = split.join(by_name, "name").select(F.explode("words").alias("word"), "block", "allow").groupBy("word").agg(
        F.sum("block").alias("block"), F.sum("allow").alias("allow")
    )
    in_class = materialize(in_class, "classes")
    sums = in_class.agg(
        F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a"), F.count("*").alias("v")
    ).first()
    rows = bags.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a")).first()
    odds = F.log((F.col("block") + 1.0) / (sums["b"] + sums["v"])) - F.log((F.col("allow") + 1.0) / (sums["a"] + sums["v"]))
    prior = float(np.log((rows["b"] + 1.0) / (rows["a"] + 1.0)))
    weight = split.select("name", F.explode("words").alias("word")).join(in_class, "word").groupBy("name").agg(F.sum(odds).alias("w"))
    scored = bags.select("bag", F.explode("bag").alias("name")).join(weight, "name").groupBy("bag").agg(F.sum("w").alias("w"))
    judged = urls.withColumn("bag", F.sort_array(names_in(F.col("host"), F.col("path")))).join(scored, "bag", "left")
    score = F.round(F.coalesce(F.col("w"), F.lit(0.0)) + prior, 9)
    return judged.select(
        "document", key, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fit").isNull(), score).alias("score"),
    )
