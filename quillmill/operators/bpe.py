"""Byte-level BPE.

Bytes are mapped to printable characters first and split into pieces after that
(pretokenize="reference"), so that blanks, which the map turns into letters, do not
end a piece; "canonical" splits the text and maps the pieces.  As columns, byte map
and split are built-in functions; encode() does both with numpy on whole batches.
Few merges in order are applied to a whole batch at a time, others once for each
distinct piece that a worker meets.
"""

from __future__ import annotations

import heapq
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .words import chunks_of, string_parts, to_utf8

_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MOVED = [b for b in range(256) if b not in set(_PLAIN)]
_FROM = "".join(map(chr, _MOVED))
_TO = "".join(chr(256 + i) for i in range(len(_MOVED)))
_NUL = chr(256)
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
_LETTER, _NUMBER = "\\p{L}", "\\p{N}"
SPACE = "\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_REST = f"[^{SPACE}{_LETTER}{_NUMBER}]"
PIECE = "|".join([*("'" + s for s in _SUFFIXES), *(f" ?{x}+" for x in (_LETTER, _NUMBER, _REST)), f"[{SPACE}]+(?![^{SPACE}])", f"[{SPACE}]+"])
#: The same for mapped strings, where no white space is left (and for engines without look-ahead).
MAPPED_PIECE = "|".join([*("'" + s for s in _SUFFIXES), f"{_LETTER}+", f"{_NUMBER}+", f"[^{_LETTER}{_NUMBER}]+"])
#: Ids that are decoded at once.
DECODED_IDS = 1 << 18
#: The first private-use character.
_FOLD_FROM = 0xE000
#: Pieces that a worker remembers the ids of, and the longest of them.
MEMO_PIECES, MEMO_LENGTH = 1 << 18, 256


def byte_map(text: Column) -> Column:
    """A character for each UTF-8 byte of a text: printable Latin-1 as it is, the 68 other bytes from U+0100 on."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _FROM, _TO)


def byte_unmap(mapped: Column) -> Column:
    """The text of mapped bytes; characters that stand for no byte are dropped, bad UTF-8 is replaced."""
    known = F.regexp_replace(mapped, f"[^\\x{{21}}-\\x{{7E}}\\x{{A1}}-\\x{{AC}}\\x{{AE}}-\\x{{FF}}\\x{{100}}-\\x{{{255 + len(_MOVED):X}}}]", "")
    # translate() takes NUL for "delete", so that byte goes by itself.
    bytes_ = F.translate(F.replace(known, F.lit(_NUL), F.lit("\x00")), _TO[1:], _FROM[1:])
    return F.make_valid_utf8(F.encode(bytes_, "ISO-8859-1").cast("string"))


def pretokenize(text: Column, mode: str = "reference") -> Column:
    """The pieces that merging works on."""
    if mode == "reference":
        return F.regexp_extract_all(byte_map(text), F.lit(MAPPED_PIECE), F.lit(0))
    if mode == "canonical":
        return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), byte_map)
    raise ValueError(f"no such pre-tokenization: {mode}")


@dataclass(frozen=True)
class BpeVocab:
    """Tokens by id, and merges in rank order (of a repeated pair the last rank counts)."""

    tokens: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]
    ids: dict[str, int] = field(init=False, repr=False, compare=False)
    ranks: dict[tuple[str, str], int] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "ids", {t: i for i, t in enumerate(self.tokens)})
        object.__setattr__(self, "ranks", {m: i for i, m in enumerate(self.merges)})

    def merge(self, piece: str) -> list[str]:
        """Merge the adjacent pair of lowest rank, everywhere it occurs from the left, until there is none.

        A heap of pairs over a linked list of tokens: n log n for a piece of n characters.
        """
        parts: list[str] = list(piece)
        n, rank = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            low, made = heap[0][0], []
            left, right = self.merges[low]
            # All places of this pair, from the left; new pairs count only after the last of them.
            while heap and heap[0][0] == low:
                i = heapq.heappop(heap)[1]
                j = after[i]
                if parts[i] != left or j >= n or parts[j] != right:
                    continue
                parts[i], parts[j] = left + right, ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    made.append(i)
                if before[i] >= 0:
                    made.append(before[i])
            for i in made:
                if parts[i] and after[i] < n and (r := rank((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
        return [x for x in parts if x]

    def ordered(self) -> bool:
        """Whether one pass over the merges in rank order does the same as merging by lowest rank.

        So it is if both sides of a merge are single characters or made by a merge
        of lower rank, and no token is made by two merges.
        """
        made: set[str] = set()
        for a, b in self.merges:
            if any(len(x) > 1 and x not in made for x in (a, b)) or a + b in made:
                return False
            made.add(a + b)
        return len(self.ranks) == len(self.merges)


class Mapped:
    """The mapped bytes of texts, and where pieces begin in them (pretokenize="reference"), with numpy."""

    def __init__(self):
        self.point = np.arange(256, dtype=np.uint16)
        self.point[_MOVED] = 256 + np.arange(len(_MOVED))
        kinds = [unicodedata.category(chr(int(p)))[0] for p in self.point]
        #: 1 letter, 2 number, 0 anything else.
        self.kind = np.array([1 if k == "L" else 2 if k == "N" else 0 for k in kinds], np.uint8)

    def starts(self, buf: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Byte offsets of the pieces of the texts that ``cut`` cuts ``buf`` into."""
        n = len(buf)
        kind = self.kind[buf]
        begins = np.ones(n, bool)
        begins[1:] = kind[1:] != kind[:-1]
        heads = cut[:-1][cut[:-1] < n]
        begins[heads] = True
        at = np.flatnonzero(begins & (buf == ord("'")))
        end = cut[np.searchsorted(cut, at, side="right")]
        for suffix in _SUFFIXES:
            k = len(suffix)
            fits = at + k < end
            own, last = at[fits], end[fits]
            for i, c in enumerate(suffix.encode()):
                same = buf[own + 1 + i] == c
                own, last = own[same], last[same]
            begins[own + 1] = False
            own = own[own + 1 + k < last]
            begins[own + 1 + k] = True
        return np.flatnonzero(begins)


class Folder:
    """Merging whole batches: each token is a character, and a merge replaces two by one everywhere.

    For merges that are ordered() and few; a merge is one pass over the batch.
    """

    MOST = 1024

    def __init__(self, vocab: BpeVocab, mapped: Mapped):
        codes = {chr(int(p)): int(p) for p in mapped.point}
        for x in sorted({c for m in vocab.merges for t in m for c in t} - set(codes)):
            codes[x] = 0x200 + len(codes)
        self.passes = []
        for a, b in vocab.merges:
            codes[a + b] = 0x200 + len(codes)
            self.passes.append((chr(codes[a]) + chr(codes[b]), chr(codes[a + b])))
        self.id = np.full(max(codes.values()) + 1, -1, np.int32)
        for token, code in codes.items():
            self.id[code] = vocab.ids.get(token, -1)

    def ids(self, points: np.ndarray, starts: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts' tokens, and the n + 1 offsets of each text's."""
        # U+0001 ends a piece, U+0002 a text (no byte is mapped to either).
        text = np.insert(points, np.concatenate((starts, cut[1:])), np.append(np.full(len(starts), 1, np.uint16), np.full(len(cut) - 1, 2, np.uint16)))
        s = text.astype("<u2").tobytes().decode("utf-16-le")
        for pair, one in self.passes:
            s = s.replace(pair, one)
        out = np.frombuffer(s.encode("utf-16-le"), np.uint16)
        ids = self.id[out]
        known = np.append(0, np.cumsum(ids >= 0))
        return ids[ids >= 0], np.append(0, known[np.flatnonzero(out == 2)])


class Merger:
    """Merging piece by piece: each distinct piece once, with a memo of those that this worker has met."""

    def __init__(self, vocab: BpeVocab):
        self.vocab = vocab
        self.memo: dict[str, list[int]] = {}

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and the n + 1 offsets of each one's."""
        coded = pieces.dictionary_encode()
        known = []
        for piece in coded.dictionary.to_pylist():
            got = self.memo.get(piece)
            if got is None:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                got = [self.vocab.ids[t] for t in self.vocab.merge(piece) if t in self.vocab.ids]
                if len(piece) <= MEMO_LENGTH:
                    self.memo[piece] = got
            known.append(got)
        taken = pa.array(known, pa.list_(pa.int32())).take(coded.indices)
        size = pc.list_value_length(taken).to_numpy(zero_copy_only=False).astype(np.int64)
        return taken.flatten().to_numpy(), np.append(0, np.cumsum(size))


class BpeEncoder:
    """Encodes Arrow batches of texts, or of their pieces."""

    def __init__(self, vocab: BpeVocab):
        self.mapped, self.merger = Mapped(), Merger(vocab)
        self.folder = Folder(vocab, self.mapped) if vocab.ordered() and len(vocab.merges) <= Folder.MOST else None

    def _texts(self, buf: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, starts = self.mapped.point[buf], self.mapped.starts(buf, cut)
        if self.folder:
            return self.folder.ids(points, starts, cut)
        data, offs = to_utf8(points.astype(np.uint32), np.append(starts, len(buf)))
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
        ids, run = self.merger.ids(pieces)
        return ids, run[np.searchsorted(starts, cut)]

    def texts(self, col: pa.Array) -> pa.Array:
        """Lists of the ids of texts; a null for a null."""
        buf, offs = string_parts(col)
        null, out = col.is_null().to_numpy(zero_copy_only=False), [pa.array([], pa.list_(pa.int32()))]
        for i, j in chunks_of(offs):
            ids, cut = self._texts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            out.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null[i:j]) if null[i:j].any() else None))
        return pa.concat_arrays(out)

    def pieces(self, lists: pa.Array) -> pa.Array:
        """Lists of the ids of lists of mapped pieces; a null for a null."""
        ids, run = self.merger.ids(lists.flatten())
        cut = run[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))]
        null = lists.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null) if null.any() else None)


def encoding(vocab: BpeVocab, of_pieces: bool = False):
    """A function of text (or of lists of mapped pieces): lists of ids."""
    held: list[BpeEncoder] = []

    @arrow_udf("array<int>")
    def bpe_ids(batch: pa.Array) -> pa.Array:
        if not held:
            held.append(BpeEncoder(vocab))
        return held[0].pieces(batch) if of_pieces else held[0].texts(batch)

    return bpe_ids


def encode(text: Column, vocab: BpeVocab, mode: str = "reference") -> Column:
    """Ids of a text's tokens; tokens that the vocabulary lacks are left out.  A null text is null."""
    return encoding(vocab)(text) if mode == "reference" else encoding(vocab, True)(pretokenize(text, mode))


def encode_fold(text: Column, vocab: BpeVocab, mode: str = "reference") -> Column:
    """The tokens without Python: one replacement in the whole text for each merge, in rank order (for few merges that are ``ordered``)."""
    if not vocab.ordered():
        raise ValueError("these merges must be applied by lowest rank; use encode()")
    # A token is one character while merging, of the private-use area where a merge made it; ``end`` keeps pieces apart.
    taken = {c for m in vocab.merges for t in m for c in t}
    free = (chr(c) for c in range(_FOLD_FROM if len(vocab.merges) + len(taken) < 0x1800 else 0xF0000, 0x110000) if chr(c) not in taken)
    end = next(free)
    code = dict(zip((a + b for a, b in vocab.merges), free))
    whole = F.array_join(pretokenize(text, mode), end)
    for a, b in vocab.merges:
        whole = F.replace(whole, F.lit(code.get(a, a) + code.get(b, b)), F.lit(code[a + b]))
    whole = F.replace(whole, F.lit(end), F.lit(""))
    first = ord(end)
    table = [""] * (max(map(ord, code.values()), default=first) - first + 1)
    for token, c in code.items():
        table[ord(c) - first] = token
    made = F.array(*map(F.lit, table))
    # An empty text is split to an empty string.
    return F.array_remove(F.transform(F.split(whole, ""), lambda c: F.when(c > end, F.get(made, F.ascii(c) - first)).otherwise(c)), "")


def decode(ids: Column, vocab: BpeVocab) -> Column:
    """Text of ids; ids out of range and characters that stand for no byte are left out, bad UTF-8 is replaced."""
    byte = {chr(int(p)): b for b, p in enumerate(Mapped().point)}
    raw = [bytes(byte[c] for c in t if c in byte) for t in vocab.tokens]
    start = np.append(0, np.cumsum([len(x) for x in raw]))
    data = np.frombuffer(b"".join(raw), np.uint8)

    @arrow_udf("binary")
    def bytes_of(batch: pa.Array) -> pa.Array:
        flat = batch.flatten()
        lists = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)))
        cut, out, done = np.zeros(len(lists), np.int64), [], 0
        # Some ids at a time, wherever lists end, so that memory is that of the batch and its bytes.
        for a in range(0, len(flat), DECODED_IDS):
            part = pc.fill_null(flat.slice(a, DECODED_IDS), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            good = (part >= 0) & (part < len(raw))
            part = np.where(good, part, 0)
            size = np.where(good, start[part + 1] - start[part], 0)
            run = np.append(0, np.cumsum(size))
            out.append(data[np.repeat(start[part] - run[:-1], size) + np.arange(run[-1])])
            i, j = np.searchsorted(lists, (a + 1, a + len(part) + 1))
            cut[i:j] = done + run[lists[i:j] - a]
            done += int(run[-1])
        found = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(cut), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *out]))])
        return (pc.if_else(batch.is_null(), pa.scalar(None, pa.large_binary()), found) if batch.null_count else found).cast(pa.binary())

    return F.make_valid_utf8(bytes_of(ids).cast("string"))
