"""Text normalisation, tokens, stop words and n-grams as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns. Java's \b follows Unicode word rules, so the ASCII form
# states its left boundary as a look-behind; the greedy run supplies the right one.
TOKEN_PATTERNS = {
    "ascii": r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]+)",
    "unicode": r"(?U)\b([a-z_]\w+)\b",
    "default": r"(?U)\b(\w\w+)\b",
}

# The characters stripped from both ends of a field.
FIELD_BLANKS = " \t\n\r\f\x0b"


def strip_field(value: Column) -> Column:
    """Strip every kind of ASCII blank, not only spaces."""
    return F.btrim(value, F.lit(FIELD_BLANKS))


def blank_breaks(value: Column) -> Column:
    """Tabs and newlines become spaces, one for one."""
    return F.translate(value, "\t\n", "  ")


def printable_ascii(value: Column) -> Column:
    """Drop every character that is not printable ASCII, tab or newline."""
    return F.regexp_replace(value, r"[^\x20-\x7E\t\n]", "")


def has_non_ascii(value: Column) -> Column:
    """True when the text needs more bytes than characters."""
    return F.octet_length(value) > F.char_length(value)


def strip_urls(value: Column) -> Column:
    return F.regexp_replace(value, r"https?://\S+", " ")


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without combining marks, derived from the Unicode data.

    Returns the characters replaced one for one followed by those dropped, the
    replacements, and the characters that expand to several.
    """
    single, target, dropped, several = [], [], [], {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue  # surrogates have no text form; Hangul syllables follow a formula
        char = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base == char:
            continue
        if len(base) == 1:
            single.append(char)
            target.append(base)
        elif base:
            several[char] = base
        else:
            dropped.append(char)
    return "".join(single + dropped), "".join(target), several


@lru_cache(maxsize=1)
def _longer_pattern() -> str:
    """Pattern of the characters that expand to several, as ranges.

    The intersection lets the matcher pass over ordinary letters in one comparison.
    """
    points = sorted(ord(c) for c in _decompositions()[2])
    ranges: list[list[int]] = []
    for point in points:
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    low = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges if b < 0x100)
    high = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges if a >= 0x100)
    return f"[{low}]|[\\x{{100}}-\\x{{10ffff}}&&[{high}가-힣]]"


def _jamo(code: Column) -> Column:
    """The character for a code point of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _expand(char: Column) -> Column:
    """One character that decomposes into several."""
    _, _, several = _decompositions()
    entries = "\x02".join(f"{c}\x01{text}" for c, text in several.items())
    table = F.str_to_map(F.lit(entries), F.lit("\x02"), F.lit("\x01"))
    index = F.ascii(char) - 0xAC00
    tail = index % 28
    hangul = F.concat(
        _jamo(F.floor(index / 588) + 0x1100),
        _jamo(F.floor((index % 588) / 28) + 0x1161),
        F.when(tail > 0, _jamo(tail + 0x11A7)).otherwise(""),
    )
    return F.when(char.between("가", "힣"), hangul).otherwise(F.coalesce(F.element_at(table, char), char))


def fold_accents(value: Column, mode: str | None = "unicode") -> Column:
    """NFKD without combining marks; ``ascii`` also drops what is still not ASCII.

    Plain ASCII texts skip the work, and the per-character path runs only for texts
    holding a character with a longer decomposition (ligatures, fractions, Hangul).
    """
    if mode is None:
        return value
    source, target, _ = _decompositions()
    longer = _longer_pattern()

    def expanded(folded: Column) -> Column:
        chars = F.transform(F.split(folded, ""), lambda c: F.when(c.rlike(longer), _expand(c)).otherwise(c))
        return F.when(has_non_ascii(folded) & folded.rlike(longer), F.array_join(chars, "")).otherwise(folded)

    # As the variable of a transform the translated text is computed once, not once per mention.
    result = F.get(F.transform(F.array(F.translate(value, source, target)), expanded), F.lit(0))
    if mode == "ascii":
        result = F.regexp_replace(result, r"[^\x00-\x7F]", "")
    elif mode != "unicode":
        raise ValueError(f"unknown accent mode {mode!r}")
    return F.when(has_non_ascii(value), result).otherwise(value)


def tokenize(value: Column, pattern: str = "ascii") -> Column:
    """Array of tokens by a named or literal pattern with one group."""
    return F.regexp_extract_all(value, F.lit(TOKEN_PATTERNS.get(pattern, pattern)), F.lit(1))


def drop_words(tokens: Column, words: Sequence[str] | None) -> Column:
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(list(words)))


def next_ngrams(shorter: Column, tokens: Column, n: int) -> Column:
    """n-grams from the (n-1)-grams of the same tokens, joined by a space."""
    left = F.slice(shorter, F.lit(1), F.greatest(F.size(shorter) - 1, F.lit(0)))
    right = F.slice(tokens, F.lit(n), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))


def filled(array: Column) -> Column:
    """The array, NULL when empty: exploded, it yields the same rows.

    Exploding a plain computed column makes the optimiser add a size filter below it,
    which evaluates the whole text expression a second time.
    """
    return F.when(F.size(array) > 0, array)
