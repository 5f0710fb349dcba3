"""WordPiece: dictionary segmentation of words, forward, backward and both.

Segmentation depends on the word alone.  So the fast path takes the words that an
Arrow batch has, each once (dictionary encoding), segments them all at once, and
assembles all documents of the batch with numpy; nothing is shuffled.  segment_relational() is the same as joins and higher-order functions,
without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def less(a: list[int], b: list[int]) -> bool:
    """Whether segmentation a is preferred to b: the smaller least id, then the smaller sorted ids of 4 and up; a tie is no."""
    if not a:
        return True
    if not b:
        return False
    if min(a) < min(b):
        return True
    return sorted(x for x in a if x >= 4) < sorted(x for x in b if x >= 4)


@dataclass(frozen=True)
class Vocab:
    """Tokens by id; of a repeated token the last id counts."""

    tokens: tuple[str, ...]
    ids: dict[str, int] = field(init=False, repr=False, compare=False)
    longest: int = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "ids", {t: i for i, t in enumerate(self.tokens)})
        object.__setattr__(self, "longest", max((len(t) for t in self.tokens), default=0))

    def id_of(self, token: str) -> int:
        """A token's id; 0 if there is none."""
        return self.ids.get(token, 0)

    @property
    def unk(self) -> int:
        return self.id_of("[UNK]")

    @property
    def cls(self) -> int:
        return self.id_of("[CLS]")

    @property
    def sep(self) -> int:
        return self.id_of("[SEP]")

    def forward(self, word: str) -> tuple[list[int], bool]:
        """Greedy longest pieces from the left, as far as they go, and whether they reach the end."""
        out, at, n, get = [], 0, len(word), self.ids.get
        while at < n:
            mark = "##" if at else ""
            for end in range(min(n, at + self.longest - len(mark)), at, -1):
                found = get(mark + word[at:end])
                # A token that begins with ## is a piece inside words, never a word's first one.
                if found is not None and (at or not word.startswith("##", 0, end)):
                    out.append(found)
                    at = end
                    break
            else:
                return out, False
        return out, True

    def backward(self, word: str) -> tuple[list[int], bool]:
        """Greedy longest pieces from the right, in the word's order, and whether they reach the start."""
        out, end, get = [], len(word), self.ids.get
        while end > 0:
            for at in range(max(0, end - self.longest), end):
                found = get(("##" if at else "") + word[at:end])
                if found is not None and (at or not word.startswith("##", 0, end)):
                    out.append(found)
                    end = at
                    break
            else:
                return out[::-1], False
        return out[::-1], True

    def limited(self, word: str, most: int, backward: bool = False) -> list[int]:
        """One word's ids with room for ``most``: [UNK] if it has more bytes than that or can't be segmented, cut at the far end if too many."""
        if len(word.encode()) > most > 0:
            return [self.unk]
        pieces, ok = self.backward(word) if backward else self.forward(word)
        if not ok and (backward or len(pieces) <= most):
            return [self.unk] if most > 0 else []
        return (pieces[max(0, len(pieces) - most) :] if backward else pieces[:most]) if most > 0 else []

    def both(self, word: str, most: int) -> list[int]:
        """Forward or backward segmentation, whichever is preferred; backward on a tie."""
        f, b = self.limited(word, most), self.limited(word, most, backward=True)
        return f if f == b or self.prefers(f, b) else b

    @staticmethod
    def prefers(f: list[int], b: list[int]) -> bool:
        """Whether f is preferred to b."""
        return less([x for x in f if x >= 4], [x for x in b if x >= 4])


UNLIMITED = (1 << 31) - 1


class Encoder:
    """Encodes batches of word lists: the distinct words of a batch are segmented all at once (see segment.py)."""

    def __init__(self, vocab: Vocab, bidirectional: bool = False, max_length: int = -1):
        from .segment import Segmenter

        self.vocab, self.bidirectional = vocab, bidirectional
        self.most = max_length - 1 if max_length >= 0 else UNLIMITED
        self.segmenter = Segmenter(vocab)

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lists of ``words``, without special ones, and the n + 1 offsets of each list's."""
        flat = words.flatten()
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.combine_chunks()
        coded = flat.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        known = coded.dictionary
        n = len(known)
        # The table of pieces: each word's, and behind them [UNK].
        if self.bidirectional:
            if self.most > 0:
                table, first = self.segmenter.both(known, self.most)
            else:
                table, first = np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
            ok, over = np.ones(n, bool), np.zeros(n, bool)
        else:
            table, first, ok = self.segmenter.greedy(known)
            over = pc.binary_length(known).to_numpy(zero_copy_only=False) > self.most
        table, first, length = np.append(table, np.int32(self.vocab.unk)), first[:-1], np.diff(first)
        size = np.where(over | ~ok, 1, length)
        doc_at = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=doc_at[1:])
        size_w = size[which]
        run = np.zeros(len(size_w) + 1, np.int64)
        np.cumsum(size_w, out=run[1:])
        doc = np.repeat(np.arange(len(counts)), counts)
        before = run[:-1] - run[doc_at[doc]]
        room = self.most - 1 - before if self.most < UNLIMITED else np.full(len(size_w), UNLIMITED, np.int64)
        if self.bidirectional and self.most < UNLIMITED:
            room = np.maximum(self.most - 1 - before, 0)
        over_w, ok_w, len_w = over[which], ok[which], length[which]
        partial = ~over_w & ~ok_w & (len_w > room) & (room > 0)
        use_unk = over_w | (~ok_w & ~partial)
        take = np.where(room <= 0, 0, np.where(use_unk, 1, np.minimum(len_w, room)))
        if partial.any():
            # A failing word that fills the list ends it: what follows in the document adds nothing.
            stops = np.zeros(len(take) + 1, np.int64)
            np.cumsum(partial, out=stops[1:])
            take[(stops[:-1] - stops[doc_at[doc]]) > 0] = 0
        start = np.where(use_unk, len(table) - 1, first[which] if n else 0)
        total = np.zeros(len(take) + 1, np.int64)
        np.cumsum(take, out=total[1:])
        ids = table[np.repeat(start - total[:-1], take) + np.arange(total[-1])]
        return ids, total[doc_at]

    def encode(self, words: pa.Array, special: bool = True, pad_to: int = -1) -> pa.Array:
        """Lists of ids: [CLS], pieces, [SEP], zeros up to ``pad_to``; a null stays null."""
        ids, cut = self.pieces(words)
        if not special:
            offsets = cut
        else:
            size = np.diff(cut)
            full = np.maximum(size + 2, pad_to)
            offsets = np.zeros(len(cut), np.int64)
            np.cumsum(full, out=offsets[1:])
            out = np.zeros(offsets[-1], np.int32)
            out[np.repeat(offsets[:-1] + 1 - cut[:-1], size) + np.arange(len(ids))] = ids
            out[offsets[:-1]] = self.vocab.cls
            out[offsets[:-1] + 1 + size] = self.vocab.sep
            ids = out
        null = words.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null) if null.any() else None)


def segment_relational(words: DataFrame, vocab: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, ids, ok): forward pieces as far as they go, and whether they reach the end, for distinct words.

    All substrings up to the longest token's length are joined with the vocabulary
    (Spark broadcasts it by its size); the longest match at each place is kept, and
    a fold walks from match to match.
    """
    last = vocab.groupBy("token").agg(F.max("id").alias("id")).where("token != '##'")
    inner = F.col("token").startswith("##")
    bodies = last.select(F.when(inner, F.expr("substring(token, 3)")).otherwise(F.col("token")).alias("body"), inner.alias("inner"), "id")
    longest = bodies.agg(F.max(F.length("body")).alias("__m"))
    own = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct()
    at = own.select("word", F.explode(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)))).alias("i")).crossJoin(F.broadcast(longest))
    parts = at.select("word", "i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("__m", F.length("word") - F.col("i") + 1)))).alias("l"))
    parts = parts.select("word", "i", "l", F.col("word").substr(F.col("i"), F.col("l")).alias("body"), (F.col("i") > 1).alias("inner"))
    best = parts.join(bodies, ["body", "inner"]).groupBy("word", "i").agg(F.max(F.struct("l", "id")).alias("m"))
    jumps = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("jumps"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))

    def walk(acc: Column, i: Column) -> Column:
        hit = F.col("jumps")[i]
        moved = F.struct((i + hit["l"]).alias("at"), F.concat(acc["ids"], F.array(hit["id"])).alias("ids"))
        return F.when((acc["at"] == i) & hit.isNotNull(), moved).otherwise(acc)

    walked = own.join(jumps, "word", "left").withColumn("w", F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), start, walk))
    return walked.select("word", F.col("w.ids").alias("ids"), (F.col("w.at") == F.length("word") + 1).alias("ok"))
