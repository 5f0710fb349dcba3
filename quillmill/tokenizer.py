"""One object for all tokenizers: options in, columns and DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bpe, encode
from .operators.wordpiece import Vocab
from .sources.vocab import parse_merges, parse_vocab

RESOURCES = Path(__file__).parent / "resources"


@dataclass(frozen=True)
class TokenizerOptions:
    """What a tokenizer is made of; max_length -1 is no limit."""

    kind: str = "bert"  #: "bert" or "bpe"
    vocab_path: str | None = None  #: None: the vocabulary that comes with the package
    do_lower_case: bool = True
    tokenize_chinese_chars: bool = True
    model_max_length: int = 128
    bidirectional: bool = False
    bpe_vocab_path: str | None = None
    bpe_merges_path: str | None = None
    bpe_pretokenize: str = "reference"


def load_vocab(spark: SparkSession | None = None, path: str | None = None) -> Vocab:
    """A WordPiece vocabulary from a file of any file system, or the one of the package."""
    if path is None:
        return Vocab(tuple(parse_vocab((RESOURCES / "vocab.txt").read_text(encoding="utf-8"))))
    return Vocab(tuple(parse_vocab(_read(spark, path))))


def load_bpe(spark: SparkSession | None = None, vocab_path: str | None = None, merges_path: str | None = None) -> bpe.BpeVocab:
    """A byte-level BPE vocabulary and its merges; ids must be 0 to n - 1."""
    import json

    if vocab_path is None:
        ids = json.loads((RESOURCES / "bpe_vocab.json").read_text(encoding="utf-8"))
        merges = (RESOURCES / "merges.txt").read_text(encoding="utf-8")
    else:
        if merges_path is None:
            raise ValueError("a BPE vocabulary needs its merges")
        ids, merges = json.loads(_read(spark, vocab_path)), _read(spark, merges_path)
    if sorted(ids.values()) != list(range(len(ids))):
        raise ValueError("vocabulary ids have gaps")
    return bpe.BpeVocab(tuple(sorted(ids, key=ids.get)), tuple(parse_merges(merges)))


def _read(spark: SparkSession | None, path: str) -> str:
    spark = spark or SparkSession.active()
    return spark.read.text(path, wholetext=True).first()[0]


class Tokenizer:
    """Encodes and decodes text columns by its options."""

    def __init__(self, options: TokenizerOptions = TokenizerOptions(), spark: SparkSession | None = None):
        self.options = options
        if options.kind == "bert":
            self.vocab = load_vocab(spark, options.vocab_path)
        elif options.kind == "bpe":
            self.vocab = load_bpe(spark, options.bpe_vocab_path, options.bpe_merges_path)
        else:
            raise ValueError(f"no such tokenizer: {options.kind}")

    def encode(self, text: Column, padding: str = "max_length", max_length: int | None = None) -> Column:
        """Ids of a text column.  BPE has neither limit nor padding."""
        o = self.options
        if o.kind == "bpe":
            return bpe.encode(text, self.vocab, o.bpe_pretokenize)
        limit = o.model_max_length if max_length in (None, -1) else max_length
        return encode.encode(text, self.vocab, limit, padding, o.bidirectional, o.do_lower_case, o.tokenize_chinese_chars)

    def encode_raw(self, text: Column) -> Column:
        """Ids without special ones, limit and padding."""
        o = self.options
        if o.kind == "bpe":
            return bpe.encode(text, self.vocab, o.bpe_pretokenize)
        return encode.encode_raw(text, self.vocab, o.bidirectional, o.do_lower_case, o.tokenize_chinese_chars)

    def tokenize(self, text: Column) -> Column:
        """Tokens of a text column as strings."""
        return encode.tokens_of(self.encode_raw(text), self.vocab)

    def decode(self, ids: Column) -> Column:
        """Text of a column of ids."""
        return bpe.decode(ids, self.vocab) if self.options.kind == "bpe" else encode.decode(ids, self.vocab)

    def encode_batch(self, docs: DataFrame, text_col: str = "text", out_col: str = "ids", padding: str = "max_length", max_length: int | None = None) -> DataFrame:
        """docs with a column of ids; rows, their order and their partitions stay."""
        return docs.withColumn(out_col, self.encode(F.col(text_col), padding, max_length))
