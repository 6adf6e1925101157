"""English word stems (the published Snowball "English" rules) as column expressions.

Words live in an array and are stemmed in place, without a shuffle: a task encodes the words of a batch of
documents and stems each distinct one once. A step looks at a word's ending first and computes the regions
R1 and R2 only for words whose suffix matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm; longer suffixes stand before their own endings.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_PREFIXES = "gener|commun|arsen"
REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT_SYLLABLE = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLED = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
STEP_2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"),
    ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"),
    ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
    ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"),
    ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
STEP_4 = (
    "ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism",
    "iti", "ive", "ize", "ous", "al", "er", "ic",
)
# Extra conditions: what must stand before the suffix, and suffixes that need R2 in step 3.
BEFORE = {"ogi": "l$", "li": "[cdeghkmnrt]$", "ion": "[st]$"}
STEP_3_IN_R2 = ("ative",)

STEP_4_RULES = tuple((suffix, "") for suffix in STEP_4)

# What must stand before a suffix for it to lie in R1 or R2.
IN_R1 = f"^(?:{REGION_PREFIXES}|(?!{REGION_PREFIXES}){REGION})"
IN_R2 = IN_R1 + REGION


def _search(pattern: str) -> Callable[[str], object]:
    return re.compile(pattern).search


_r1, _r2, _past_r1 = _search(IN_R1), _search(IN_R2), _search(IN_R1 + ".")
_vowel, _vowel_before_s, _short = _search("[aeiouy]"), _search("[aeiouy].+s$"), _search(SHORT_SYLLABLE)
_at_bl_iz, _doubled, _final_y = _search("(at|bl|iz)$"), _search(DOUBLED), _search("^.+[^aeiouy][yY]$")
_before = {suffix: _search(pattern) for suffix, pattern in BEFORE.items()}


def _mark_consonant_y(w: str) -> str:
    return re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w)) if "y" in w else w


def _plurals(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _vowel_before_s(w):
        return w[:-1]
    return w


def _past_and_progressive(w: str) -> str:
    """Cut the ending and repair what is left."""
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            cut = w[: -len(suffix)]
            if suffix.startswith("ee"):
                return cut + "ee" if _r1(cut) else w
            return _repair(cut) if _vowel(cut) else w
    return _repair(w[:-1]) if w.endswith("+") else w


def _repair(cut: str) -> str:
    if _at_bl_iz(cut):
        return cut + "e"
    if _doubled(cut):
        return cut[:-1]
    return cut + "e" if _short(cut) and not _past_r1(cut) else cut


def _replace_suffix(w: str, rules: tuple[tuple[str, str], ...], region, in_r2: tuple[str, ...] = ()) -> str:
    """The longest matching suffix decides; it is replaced only inside its region."""
    for suffix, new in rules:
        if w.endswith(suffix):
            cut = w[: -len(suffix)]
            fits = (_r2 if suffix in in_r2 else region)(cut) and (suffix not in _before or _before[suffix](cut))
            return cut + new if fits else w
    return w


def _last_letter(w: str) -> str:
    cut = w[:-1]
    if w.endswith("e"):
        return cut if _r2(cut) or (_r1(cut) and not _short(cut)) else w
    return cut if w.endswith("ll") and _r2(cut) else w


def _unchanged_words() -> dict[str, str]:
    """Words the rules leave alone, with the stem each of them gets."""
    finished = {form: w for w in FINISHED_AFTER_PLURALS for form in (w, w + "s")}
    return {**WHOLE_WORDS, **finished}


_KNOWN = _unchanged_words()
_ENDINGS = {n: tuple({suffix for suffix, _ in rules}) for n, rules in ((2, STEP_2), (3, STEP_3))}


@lru_cache(maxsize=1 << 18)
def stem_word(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in _KNOWN:
        return _KNOWN[word]
    w = _past_and_progressive(_plurals(_mark_consonant_y(word)))
    if w.endswith(("y", "Y")) and _final_y(w):
        w = w[:-1] + "i"
    if w.endswith(_ENDINGS[2]):
        w = _replace_suffix(w, STEP_2, _r1)
    if w.endswith(_ENDINGS[3]):
        w = _replace_suffix(w, STEP_3, _r1, STEP_3_IN_R2)
    if w.endswith(STEP_4):
        w = _replace_suffix(w, STEP_4_RULES, _r2)
    return _last_letter(w).replace("Y", "y")


def stem_words(words: Column) -> Column:
    """Stems of an array of lower-case words, in order; each distinct word of a batch is stemmed once."""

    def stems(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        known = pa.array([stem_word(w) for w in flat.dictionary.to_pylist()], pa.string())
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
        mask = lists.is_null() if lists.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(flat.indices), mask=mask)

    return F.arrow_udf(stems, "array<string>")(words)


def stem_last_words(grams: Column) -> Column:
    """Stem only the last word of each n-gram."""
    last = stem_words(F.transform(grams, lambda g: F.substring_index(g, " ", -1)))
    heads = F.transform(grams, lambda g: F.regexp_extract(g, "^(.* )?[^ ]*$", 1))
    return F.zip_with(heads, last, lambda a, b: F.concat(a, b))
