"""Column functions on text.  All stay inside the JVM."""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import STOPWORDS


@functools.cache
def _bases(form: str) -> tuple[str, str]:
    """Characters that decompose into one base character and marks, and those bases."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            continue
        base = "".join(x for x in unicodedata.normalize(form, c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def strip_marks(text: Column) -> Column:
    """Letters without their accents; only texts that have characters beyond ASCII are translated."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, *_bases("NFD")), r"\p{Mn}", "")).otherwise(text)


def _ranges(kept: Callable[[str], bool]) -> str:
    """A pattern's class of all characters that pass a test."""
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and kept(chr(c))]
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


@functools.cache
def _marks() -> str:
    return _ranges(lambda c: unicodedata.category(c) == "Mn")


@functools.cache
def _white() -> str:
    return _ranges(str.isspace)


@functools.cache
def _parts() -> dict[str, str]:
    """Characters, other than syllables of Hangul, that decompose into several that are no marks."""
    out = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if not "\uac00" <= c <= "\ud7a3" and unicodedata.decomposition(c):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(base) != 1:
                out[c] = base
    return out


def _decomposed(text: Column) -> Column:
    """A text in which what decomposes into several characters has done so, without marks: Hangul by arithmetic, the rest by a map.

    A syllable's number gives its lead, vowel and tail, of 19, 21 and 27 jamo that follow one another.
    """
    parts = _parts()
    jamo = lambda first, n: F.array(*[F.lit(chr(first + k)) for k in range(n)])
    leads, vowels, tails = jamo(0x1100, 19), jamo(0x1161, 21), F.concat(F.array(F.lit("")), jamo(0x11A8, 27))

    def one(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        at = lambda k: k.cast("int")
        syllable = F.concat(F.get(leads, at(F.floor(n / 588))), F.get(vowels, at(F.floor(n % 588 / 28))), F.get(tails, at(n % 28)))
        return F.when(n.between(0, 11171), syllable).otherwise(F.coalesce(F.from_json(F.lit(json.dumps(parts)), "map<string,string>")[c], c))

    several = f"[\uac00-\ud7a3{''.join(parts)}]"
    return F.when(text.rlike(several), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def normalise(text: Column, exact: bool = False) -> Column:
    """Without accents, in lower case, runs of white space as one space, trimmed; null stays null.

    The built-in form treats characters of one base letter, as Latin, Greek and Cyrillic
    have; ``exact`` decomposes those of all scripts, also inside the JVM, and knows marks and
    white space by this Python's tables, whatever Java's are.
    """
    if not exact:
        return F.trim(F.regexp_replace(F.lower(strip_marks(text)), r"(?U)\s+", " "))
    bare = F.regexp_replace(F.translate(_decomposed(text), *_bases("NFD")), f"[{_marks()}]", "")
    stripped = F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(stripped), f"[{_white()}]+", " "))


def ascii_name(text: Column) -> Column:
    """Compatibility decomposition, ASCII characters only, case kept; null gives ``nan``."""
    return F.coalesce(F.regexp_replace(F.translate(text, *_bases("NFKD")), r"[^\x00-\x7F]", ""), F.lit("nan"))


def municipality_code(code: Column) -> Column:
    """A code as text, trimmed, without a trailing ``.0``."""
    return F.regexp_replace(F.trim(code.cast("string")), r"\.0$", "")


def word_pattern(term: str) -> str:
    """Pattern of a literal term as a whole word, by Unicode's word characters."""
    return rf"(?U)\b{re.escape(term)}\b"


def has_word(text: Column, term: Column) -> Column:
    """Whether a text has a term, itself a column, as a whole word."""
    return F.call_function("rlike", text, F.concat(F.lit(r"(?U)\b\Q"), term, F.lit(r"\E\b")))


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether the text in lower case contains one of the terms anywhere."""
    lowered = F.lower(text)
    return functools.reduce(lambda a, b: a | b, [lowered.contains(t) for t in terms])


def content_hash(*parts: Column) -> Column:
    """SHA-256, in hexadecimal, of one text or of several joined by ``|``."""
    return F.sha2(parts[0] if len(parts) == 1 else F.concat_ws("|", *parts), 256)


def tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Tokens of three or more of ``a-z0-9_`` in the normalised text, without stop words, in order."""
    # white space ends a token however much there is: it needs no normalising
    found = F.regexp_extract_all(F.lower(strip_marks(text)), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stopwords))


def note_tokens(text: Column, stopwords: list[str]) -> Column:
    """Set of tokens with simple singular forms, for matching questions and notes."""

    def forms(t: Column) -> Column:
        long = F.length(t) > 3
        cut = lambda n: F.left(t, F.length(t) - n)
        return F.array(
            t,
            F.when(long & t.endswith("es"), cut(2)),
            F.when(long & t.endswith("s"), cut(1)),
            F.when(long & t.endswith("is"), F.concat(cut(2), F.lit("l"))),
        )

    found = F.regexp_extract_all(strip_marks(F.lower(text)), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    all_forms = F.flatten(F.transform(F.filter(found, lambda t: ~t.isin(stopwords)), forms))
    return F.array_distinct(F.filter(all_forms, lambda t: F.length(t) >= 3))


def thousands(value: Column) -> Column:
    """A whole number with ``.`` between thousands."""
    return F.translate(F.format_number(value, 0), ",", ".")


def percent(share: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.format_string("%.1f%%", share * 100)
