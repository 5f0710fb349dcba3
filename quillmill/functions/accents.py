"""Lower-casing and accent folding as tables for ``translate``.

A code point of the basic plane becomes its canonical decomposition without marks
(Mn, Mc), in lower case.  Above that plane, decomposition alone applies, but for
the scripts with case in ``_CASED`` and a few signs.  Almost all of it maps one code
point to one or none, which ``translate`` does in one pass; Hangul syllables and a
few musical symbols and Indic vowels become several.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Supplementary ranges whose capitals are lowered.
_CASED = ((0x10400, 0x10427), (0x104B0, 0x104D3), (0x10C80, 0x10CB2), (0x118A0, 0x118BF), (0x1E900, 0x1E921))
#: Supplementary signs that lose their mark.
_BASED = (0x1109A, 0x1109C, 0x110AB)
#: Vowel signs that become the first spacing sign of their decomposition, although that is a mark, too.
_SIGNS = (0x0B48, 0x0CC0, 0x0CC7, 0x0CC8, 0x0CCA, 0x0CCB, 0x0DDA, 0x0DDD, 0x1B3B, 0x1B3D, 0x1B43, 0x114BB)

_S, _L, _V, _T = 0xAC00, 0x1100, 0x1161, 0x11A7
HANGUL = "\\x{AC00}-\\x{D7A3}"


def fold_char(ch: str) -> str:
    """What one character becomes: none, one or several."""
    cp = ord(ch)
    if cp < 128:
        return ch.lower()
    flat = unicodedata.normalize("NFD", ch)
    if cp in _SIGNS:
        return next(c for c in flat if unicodedata.category(c) != "Mn")
    if any(a <= cp <= b for a, b in _CASED):
        return ch.lower()
    if cp in _BASED:
        return "".join(c for c in flat if unicodedata.category(c) not in ("Mn", "Mc"))
    out = []
    for c in flat:
        if ord(c) > 0xFFFF:
            out.append(c)
        elif unicodedata.category(c) not in ("Mn", "Mc"):
            low = c.lower()
            out.append(low if len(low) == 1 else c)
    return "".join(out)


@lru_cache(maxsize=1)
def tables() -> tuple[str, str, dict[str, str]]:
    """FROM and TO of translate (what FROM has beyond TO is deleted), and the characters that become several, Hangul aside."""
    one, none, many = [], [], {}
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF or _S <= cp <= 0xD7A3 or 0x30000 <= cp or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2F7FF:
            continue  # no letters with case or marks there
        ch = chr(cp)
        to = fold_char(ch)
        if to == ch:
            continue
        if len(to) == 1:
            one.append((ch, to))
        elif to:
            many[ch] = to
        else:
            none.append(ch)
    return "".join(a for a, _ in one) + "".join(none), "".join(b for _, b in one), many


def _hangul(c: Column) -> Column:
    jamo = lambda base, n: F.array(*[F.lit(chr(base + i) if base != _T or i else "") for i in range(n)])
    lead, vowel, tail = jamo(_L, 19), jamo(_V, 21), jamo(_T, 28)

    def one(ch: Column) -> Column:
        s = F.ascii(ch) - _S
        split = F.concat(F.element_at(lead, F.floor(s / 588).cast("int") + 1), F.element_at(vowel, F.floor(s % 588 / 28).cast("int") + 1), F.element_at(tail, (s % 28).cast("int") + 1))
        return F.when(ch.between(chr(_S), chr(0xD7A3)), split).otherwise(ch)

    return F.when(c.rlike(f"[{HANGUL}]"), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def special() -> str:
    """The class of characters that translate() alone can't fold."""
    return HANGUL + "".join(f"\\x{{{ord(ch):X}}}" for ch in tables()[2])


def fold_special(c: Column) -> Column:
    """Hangul and the other characters that become several."""
    out = _hangul(c)
    for ch, to in tables()[2].items():
        out = F.replace(out, F.lit(ch), F.lit(to))
    return out


def lower_strip(c: Column) -> Column:
    """Lower case without accents; null for null.  Built-in functions only."""
    source, target, _ = tables()
    plain = F.translate(c, source, target)
    return F.when(c.rlike(f"[{special()}]"), fold_special(plain)).otherwise(plain)
