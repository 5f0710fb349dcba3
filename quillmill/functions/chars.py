"""Character classes, as the insides of regular-expression brackets.

The escapes mean the same to Java's engine and to RE2, so that the SQL of the
tests is written with the same constants.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, general and CJK punctuation, half- and fullwidth forms (letters there, too), and six single characters.
PUNCTUATION = (
    "\\x{21}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7E}\\x{B7}\\x{2000}-\\x{206F}\\x{2E80}\\x{2E99}\\x{2E9B}\\x{2EF3}"
    "\\x{3000}-\\x{303F}\\x{30FB}\\x{FE30}-\\x{FE4F}\\x{FF00}-\\x{FFEF}"
)
CONTROL = "\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}-\\x{9F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}"
WHITESPACE = "\\x{9}\\x{A}\\x{D}\\x{20}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}"
CHINESE = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{2F800}-\\x{2FA1F}"
#: Letters and digits that nearly all text is made of: tested first, they spare a character class its long list of ranges.
COMMON = "a-zA-Z0-9"
#: What cleaning drops before it looks at anything else.
DROPPED = CONTROL + "\\x{FFFD}\\x{2028}\\x{2029}"


def members(inside: str) -> str:
    """The characters of a class, in order."""
    out = []
    for a, b in re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", inside):
        out += map(chr, range(int(a, 16), int(b or a, 16) + 1))
    return "".join(out)


def _all_of(c: Column, inside: str) -> Column:
    return c.rlike(f"^[{inside}]$")


def is_punctuation(c: Column) -> Column:
    """Whether a one-character string is punctuation (null for null)."""
    return _all_of(c, PUNCTUATION)


def is_control(c: Column) -> Column:
    """Whether a one-character string is a control or invisible formatting character."""
    return _all_of(c, CONTROL)


def is_whitespace(c: Column) -> Column:
    """Whether a one-character string is white space."""
    return _all_of(c, WHITESPACE)


def is_chinese(c: Column) -> Column:
    """Whether a one-character string is a CJK ideograph."""
    return _all_of(c, CHINESE)


def is_dropped(c: Column) -> Column:
    """Whether cleaning drops a one-character string."""
    return _all_of(c, DROPPED)


def is_ascii(c: Column) -> Column:
    """Whether a string has ASCII characters only."""
    return c.rlike("^[\\x00-\\x7F]*$")


def count_class(c: Column, inside: str) -> Column:
    """How many characters of a string are of a class."""
    return F.regexp_count(c, F.lit(f"[{inside}]"))


def valid_utf8(raw: Column) -> Column:
    """Bytes as a string; undecodable ones become U+FFFD, which cleaning drops."""
    return F.make_valid_utf8(raw.cast("string"))
