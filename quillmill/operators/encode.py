"""Encoding text columns to token ids with a WordPiece vocabulary, and back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .segment import Segmenter
from .wordpiece import UNLIMITED, Encoder, Vocab
from .words import word_lists

_NO_IDS = pa.array([], pa.list_(pa.int32()))


def encoding(vocab: Vocab, bidirectional: bool, max_length: int, special: bool, pad_to: int, fold: bool = True, cjk: bool = True):
    """A function of text: lists of ids.  A text goes to Python as it is, and nothing but its ids comes back."""
    held: list[Encoder] = []  # one for each Python worker

    @arrow_udf("array<int>")
    def encode_text(batch: pa.Array) -> pa.Array:
        if not held:
            held.append(Encoder(vocab, bidirectional, max_length))
        return pa.concat_arrays([_NO_IDS, *(held[0].encode(words, special, pad_to) for words in word_lists(batch, fold, cjk))])

    return encode_text


def token_lists(vocab: Vocab, fold: bool = True, cjk: bool = True, bidirectional: bool = False):
    """A function of text: lists of pieces."""
    held: list[Encoder] = []
    tokens = pa.array(vocab.tokens, pa.string())

    @arrow_udf("array<string>")
    def tokenize_text(batch: pa.Array) -> pa.Array:
        if not held:
            held.append(Encoder(vocab, bidirectional))
        out = [pa.array([], pa.list_(pa.string()))]
        for words in word_lists(batch, fold, cjk):
            ids = held[0].encode(words, False)
            out.append(pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values), mask=ids.is_null() if ids.null_count else None))
        return pa.concat_arrays(out)

    return tokenize_text


def encode(
    text: Column,
    vocab: Vocab,
    max_length: int = -1,
    padding: str = "max_length",
    bidirectional: bool = False,
    do_lower_case: bool = True,
    tokenize_chinese_chars: bool = True,
) -> Column:
    """[CLS], pieces, [SEP] and, with padding "max_length" and a limit, zeros; at most ``max_length`` ids (two at least).

    A word of more UTF-8 bytes than ``max_length - 1`` is [UNK]; a word that the
    limit cuts keeps its first pieces.  -1 is no limit.  A null text is null.
    """
    pad_to = max_length if padding == "max_length" else -1
    return encoding(vocab, bidirectional, max_length, True, pad_to, do_lower_case, tokenize_chinese_chars)(text)


def encode_raw(text: Column, vocab: Vocab, bidirectional: bool = False, do_lower_case: bool = True, tokenize_chinese_chars: bool = True) -> Column:
    """The pieces alone: no special ids, limit or padding."""
    return encoding(vocab, bidirectional, -1, False, -1, do_lower_case, tokenize_chinese_chars)(text)


def segment(word: Column, vocab: Vocab, direction: str = "forward", max_length: int = -1) -> Column:
    """The ids of a single word: "forward", "backward" or "both"."""
    most = max_length - 1 if max_length >= 0 else UNLIMITED
    if direction not in ("forward", "backward", "both"):
        raise ValueError(f"no such direction: {direction}")
    held: list[Segmenter] = []

    @arrow_udf("array<int>")
    def segment_words(batch: pa.Array) -> pa.Array:
        if not held:
            held.append(Segmenter(vocab))
        coded = batch.dictionary_encode()
        ids, offs = held[0].limited(coded.dictionary, most, direction)
        return pa.ListArray.from_arrays(pa.array(offs.astype("int32")), pa.array(ids)).take(coded.indices)

    return segment_words(word)


def _literal(tokens: list[str]) -> Column:
    """An array constant: one string that the optimizer splits once, so that access by index costs nothing per row."""
    return F.split(F.lit("\n".join(tokens)), "\n")


def tokens_of(ids: Column, vocab: Vocab) -> Column:
    """The tokens of ids; an unknown id is an error."""
    table = _literal(list(vocab.tokens))
    return F.transform(ids, lambda i: F.when((i >= 0) & (i < len(vocab.tokens)), F.get(table, i)).otherwise(F.raise_error(F.concat(F.lit("unknown token id "), i.cast("string")))))


def tokenize(text: Column, vocab: Vocab, do_lower_case: bool = True, tokenize_chinese_chars: bool = True) -> Column:
    """The pieces of a text as strings."""
    return token_lists(vocab, do_lower_case, tokenize_chinese_chars)(text)


def decode(ids: Column, vocab: Vocab) -> Column:
    """Text of ids: 0 and special ids are skipped, ## pieces glued, the others joined by blanks.

    Up to and with the first piece that does not begin with ## nothing is put
    between pieces.  An unknown id is an error.
    """
    glued = _literal(["" if t in ("[CLS]", "[SEP]") or i == 0 else t[2:] if t.startswith("##") else " " + t for i, t in enumerate(vocab.tokens)])
    part = F.transform(ids, lambda i: F.when((i >= 0) & (i < len(vocab.tokens)), F.get(glued, i)).otherwise(F.raise_error(F.concat(F.lit("unknown token id "), i.cast("string")))))
    return F.regexp_replace(F.array_join(part, ""), "^([^ ]*) ", "$1")
