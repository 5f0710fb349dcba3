"""Greedy segmentation of many words at once: a trie in arrays, all words a character further in each step."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordpiece import Vocab
from .words import code_points, string_parts

#: Fewer words than this are segmented one by one: a long word is many steps.
FEW = 48
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """The tokens' texts: transitions in an open hash table, and for each state the id of the token that ends there.

    ``first`` has the ids of tokens that begin a word, ``inner`` those of tokens
    with ##; -1 is none.  ``back`` has the texts from their ends.
    """

    def __init__(self, vocab: Vocab, back: bool):
        states: dict[tuple[int, int], int] = {}
        first, inner = [-1], [-1]
        for token, i in vocab.ids.items():
            body = token[2:] if token.startswith("##") else token
            at = 0
            for c in map(ord, reversed(body) if back else body):
                got = states.get((at, c))
                if got is None:
                    got = states[at, c] = len(first)
                    first.append(-1)
                    inner.append(-1)
                at = got
            if at:
                (inner if token.startswith("##") else first)[at] = i
        self.first, self.inner = np.array(first, np.int32), np.array(inner, np.int32)
        bits = max(10, (4 * len(states)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        if states:
            keys = np.array([(a << 21) | c for a, c in states], np.int64)
            for k, slot, to in zip(keys.tolist(), self._slot(keys).tolist(), states.values()):
                while self._keys[slot] >= 0:
                    slot = (slot + 1) & self._mask
                self._keys[slot], self._next[slot] = k, to
        # Where a piece begins, most of the steps are: a table of its own.
        self._root = np.zeros(0x110000, np.int32)
        for (a, c), to in states.items():
            if a == 0:
                self._root[c] = to

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> self._shift).astype(np.int64)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after the characters c; 0 where the trie has none."""
        out = self._root[c]
        at = np.flatnonzero(state)
        keys = (state[at].astype(np.int64) << 21) | c[at]
        slot = self._slot(keys)
        to = np.zeros(len(at), np.int32)
        open_ = np.arange(len(at))
        while len(open_):
            have = self._keys[slot[open_]]
            hit = have == keys[open_]
            to[open_[hit]] = self._next[slot[open_[hit]]]
            open_ = open_[~hit & (have >= 0)]
            slot[open_] = (slot[open_] + 1) & self._mask
        out[at] = to
        return out


class Segmenter:
    """Segments the distinct words of a batch."""

    def __init__(self, vocab: Vocab):
        self.vocab = vocab
        self._trie = lru_cache(maxsize=2)(lambda back: Trie(vocab, back))

    def greedy(self, words: pa.Array, back: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words' pieces in the words' order, the n + 1 offsets of each word's, and whether they make up the whole word."""
        n = len(words)
        buf, offs = string_parts(words)
        points, cut = code_points(buf, offs)
        lo, hi = cut[:-1], cut[1:]
        trie, ok = self._trie(back), hi == lo
        found: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.flatnonzero(hi > lo)
        # How many characters of the word are done, and up to where its present piece and the longest token in that reach.
        done = np.zeros(len(word), np.int64)
        at, last = done.copy(), done.copy()
        ident, state = np.full(len(word), -1, np.int32), np.zeros(len(word), np.int32)
        size = (hi - lo)[word]
        while len(word) > FEW:
            live = np.flatnonzero(at < size)
            w = word[live]
            c = points[hi[w] - 1 - at[live]] if back else points[lo[w] + at[live]]
            to = trie.step(state[live], c.astype(np.int64))
            moved = to > 0
            live, to = live[moved], to[moved]
            state[live] = to
            at[live] += 1
            first = at[live] == size[live] if back else done[live] == 0
            token = np.where(first, trie.first[to], trie.inner[to])
            end = token >= 0
            last[live[end]], ident[live[end]] = at[live[end]], token[end]
            stuck = np.ones(len(word), bool)
            stuck[live] = False
            stuck = np.flatnonzero(stuck)
            if not len(stuck):
                continue
            whole = stuck[last[stuck] > done[stuck]]
            found.append((word[whole], ident[whole]))
            done[whole] = at[whole] = last[whole]
            state[whole] = 0
            ok[word[whole[done[whole] == size[whole]]]] = True
            go = np.ones(len(word), bool)
            go[stuck] = False
            go[whole[done[whole] < size[whole]]] = True
            if not go.all():
                word, done, at, last, ident, state, size = (x[go] for x in (word, done, at, last, ident, state, size))
        owner = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in found)])
        ids = np.concatenate([np.zeros(0, np.int32), *(b for _, b in found)])
        if len(word):
            # What is left is done from its beginning.
            left = np.zeros(n, bool)
            left[word] = True
            keep = ~left[owner]
            owner, ids = owner[keep], ids[keep]
            for w, text in zip(word.tolist(), words.take(pa.array(word)).to_pylist()):
                pieces, ok[w] = self.vocab.backward(text) if back else self.vocab.forward(text)
                pieces = pieces[::-1] if back else pieces
                owner, ids = np.append(owner, np.full(len(pieces), w)), np.append(ids, np.array(pieces, np.int32))
        order = np.argsort(owner, kind="stable")
        count = np.bincount(owner, minlength=n)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=offsets[1:])
        ids = ids[order].astype(np.int32)
        if back and len(ids):  # found from the end on
            ids = ids[np.repeat(offsets[1:] + offsets[:-1], count) - 1 - np.arange(len(ids))]
        return ids, offsets, ok

    def _side(self, words: pa.Array, most: int, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and where in it each word's ids begin and how many there are, as Vocab.limited() gives them."""
        n = len(words)
        ids, offs, ok = self.greedy(words, back)
        size = np.diff(offs)
        long = pc.binary_length(words).to_numpy(zero_copy_only=False) > most
        unk = long | (~ok & (np.full(n, back) | (size <= most)))
        take = np.minimum(size, most)
        return np.append(ids, np.int32(self.vocab.unk)), np.where(unk, len(ids), offs[1:] - take if back else offs[:-1]), np.where(unk, 1, take)

    def limited(self, words: pa.Array, most: int, direction: str = "forward") -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of each word's, with room for ``most``; null words count as empty."""
        if most <= 0:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        if direction == "both":
            return self.both(words, most)
        table, start, size = self._side(words, most, direction == "backward")
        return _gather(table, start, size)

    def both(self, words: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of the preferred segmentations, as Vocab.both() gives them; ``most`` is 1 or more."""
        n = len(words)
        sides = [self._side(words, most, back) for back in (False, True)]
        table = np.concatenate([s[0] for s in sides])
        base = len(sides[0][0])
        starts, sizes = np.stack([sides[0][1], sides[1][1] + base]), np.stack([sides[0][2], sides[1][2]])
        same = sizes[0] == sizes[1]
        at = np.flatnonzero(same)
        where = np.repeat(at, sizes[0][at])
        step = np.arange(len(where)) - np.repeat(np.cumsum(sizes[0][at]) - sizes[0][at], sizes[0][at])
        differ = table[starts[0][where] + step] != table[starts[1][where] + step]
        same[where[differ]] = False
        pick = np.ones(n, np.int64)
        for w in np.flatnonzero(~same).tolist():
            f, b = (table[s : s + z].tolist() for s, z in ((starts[0][w], sizes[0][w]), (starts[1][w], sizes[1][w])))
            pick[w] = 0 if self.vocab.prefers(f, b) else 1
        return _gather(table, starts[pick, np.arange(n)], sizes[pick, np.arange(n)])


def _gather(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a table that begin at ``start``, one behind the other, and their offsets."""
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    return table[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])], offs
