"""Normalisation and pre-tokenisation of text columns, with built-in functions only."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import accents, chars
from .accents import lower_strip

__all__ = ["clean_text", "cjk_spacing", "lower_strip", "whitespace_tokenize", "split_punctuation", "basic_tokenize", "basic_tokenize_sql", "ascii_lower", "normalize"]


@lru_cache(maxsize=2)
def _table(fold: bool) -> tuple[str, str]:
    """FROM and TO of the one translate() that cleans, and folds, too: what is dropped has no counterpart."""
    gone = chars.members(chars.DROPPED)
    blank = "".join(c for c in chars.members(chars.WHITESPACE) if c != " ")
    source, target = blank, " " * len(blank)
    if fold:
        known = set(gone) | set(blank)
        frm, to, _ = accents.tables()
        pairs = [(a, b) for a, b in zip(frm, to) if a not in known]
        source, target = source + "".join(a for a, _ in pairs), target + "".join(b for _, b in pairs)
        gone += "".join(c for c in frm[len(to) :] if c not in known)
    return source + gone, target


def _spaced(c: Column) -> Column:
    return F.regexp_replace(c, f"([{chars.CHINESE}])", " $1 ")


def clean_text(c: Column) -> Column:
    """Drop control characters and the like; white space of any kind becomes a blank."""
    return F.translate(c, *_table(False))


def cjk_spacing(c: Column) -> Column:
    """Cleaned text with a blank on both sides of every CJK ideograph."""
    return _spaced(clean_text(c))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whitespace_tokenize(c: Column) -> Column:
    """Runs of anything but blank, TAB, CR and LF."""
    return F.regexp_extract_all(c, F.lit("[^ \\t\\r\\n]+"), F.lit(0))


def split_punctuation(c: Column) -> Column:
    """Each punctuation character, and each run of others between blanks."""
    return F.regexp_extract_all(c, F.lit(f"[{chars.COMMON}[^ {chars.PUNCTUATION}]]+|[{chars.PUNCTUATION}]"), F.lit(0))


def normalize(c: Column, do_lower_case: bool = True, tokenize_chinese_chars: bool = True) -> Column:
    """Cleaned text, with CJK spacing and folding as asked for: one translate() for text that has no character for which more is needed."""
    plain = F.translate(c, *_table(do_lower_case))
    full = _spaced(clean_text(c)) if tokenize_chinese_chars else clean_text(c)
    if do_lower_case:
        full = lower_strip(full)
    rare = (chars.CHINESE if tokenize_chinese_chars else "") + (accents.special() if do_lower_case else "")
    return F.when(c.rlike(f"[{rare}]"), full).otherwise(plain) if rare else plain


def basic_tokenize_sql(c: Column, do_lower_case: bool = True, tokenize_chinese_chars: bool = True) -> Column:
    """basic_tokenize() in built-in functions alone."""
    return split_punctuation(normalize(c, do_lower_case, tokenize_chinese_chars))


def basic_tokenize(c: Column, do_lower_case: bool = True, tokenize_chinese_chars: bool = True) -> Column:
    """The words of a text: cleaned, folded and split at blanks and punctuation (null for null).

    A word that is nothing but combining marks is dropped.  Arrow batches and numpy:
    several times as fast as basic_tokenize_sql(), whose translate() looks each
    character up as a string.
    """
    from ..operators.words import basic_words

    return basic_words(c, do_lower_case, tokenize_chinese_chars)
