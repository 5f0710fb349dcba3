"""The tokenizers as SQL functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, arrow_udtf

from ..operators import bpe as byte_level
from ..operators.encode import encoding, token_lists
from ..operators.wordpiece import Encoder
from ..operators.words import word_lists
from ..tokenizer import Tokenizer, TokenizerOptions


def register(spark: SparkSession, bert: TokenizerOptions = TokenizerOptions(), bpe: TokenizerOptions | None = None) -> None:
    """Register for SQL:

    - ``bert_encode(text) -> array<int>``: [CLS], pieces, [SEP], padded to the model's length
    - ``bert_tokenize(text) -> array<string>``: the pieces of a text, without a limit
    - ``bpe_encode(text) -> array<int>`` (if ``bpe`` is given)
    - ``bert_encode_words``, ``bert_tokenize_words``, ``bpe_encode_pieces``: the same of lists of words or mapped pieces
    - ``tokenize_lateral(TABLE) -> (doc_id, pos, token)``: a table function of a table (doc_id, text), the words of its texts

    Each works on Arrow batches, with what a worker holds made once.
    """
    vocab = Tokenizer(bert, spark).vocab
    limit, both, fold, cjk = bert.model_max_length, bert.bidirectional, bert.do_lower_case, bert.tokenize_chinese_chars
    held: list[Encoder] = []
    whole: list[Encoder] = []

    @arrow_udf("array<int>")
    def bert_encode_words(words: pa.Array) -> pa.Array:
        if not held:
            held.append(Encoder(vocab, both, limit))
        return held[0].encode(words, True, limit)

    @arrow_udf("array<string>")
    def bert_tokenize_words(words: pa.Array) -> pa.Array:
        if not whole:
            whole.append(Encoder(vocab, both))
        ids = whole[0].encode(words, False)
        return pa.ListArray.from_arrays(ids.offsets, pa.array(vocab.tokens, pa.string()).take(ids.values), mask=ids.is_null() if ids.null_count else None)

    spark.udf.register("bert_encode_words", bert_encode_words)
    spark.udf.register("bert_tokenize_words", bert_tokenize_words)
    spark.udf.register("bert_encode", encoding(vocab, both, limit, True, limit, fold, cjk))
    spark.udf.register("bert_tokenize", token_lists(vocab, fold, cjk, both))
    if bpe is not None:
        if bpe.bpe_pretokenize != "reference":
            raise ValueError("as a SQL function, BPE has the mapped pre-tokenization only")
        merges = Tokenizer(bpe, spark).vocab
        spark.udf.register("bpe_encode", byte_level.encoding(merges))
        spark.udf.register("bpe_encode_pieces", byte_level.encoding(merges, of_pieces=True))

    @arrow_udtf(returnType="doc_id bigint, pos int, token string")
    class TokenizeLateral:
        def eval(self, rows: pa.RecordBatch):
            import numpy as np

            ids, at = rows.column("doc_id").cast(pa.int64()), 0
            for lists in word_lists(rows.column("text"), fold, cjk):
                offs = lists.offsets.to_numpy()
                size = np.diff(offs)
                doc = np.repeat(np.arange(len(lists)), size)
                pos = np.arange(offs[-1] - offs[0]) - np.repeat(offs[:-1] - offs[0], size)
                yield pa.table({"doc_id": ids.take(pa.array(doc + at)), "pos": pa.array(pos, pa.int32()), "token": lists.flatten().cast(pa.string())})
                at += len(lists)

    spark.udtf.register("tokenize_lateral", TokenizeLateral)


def bert_table(spark: SparkSession, query: str, tokenizer: Tokenizer, text_col: str = "text"):
    """The rows of a SQL query with their words and ids."""
    rows = spark.sql(query)
    return tokenizer.encode_batch(rows, text_col).withColumn("n_ids", F.size("ids"))
