"""Byte-level BPE encoding and decoding with a pair occurrence index.

The words of a block of texts are found in numpy over code points. Each word that the block has
and the cache has not enters one array of symbols. An index maps each pair to all its positions
there; active ranks are applied in ascending order, each at all its positions at once, and only
the lists of the pairs that a merge makes are updated. A merge can't make a pair of lower rank
than its own, because a rank's symbols are made by lower ranks; so one pass over the ranks gives
each word the result of merging it alone.

Memory is bounded by the block (``BLOCK`` code points, or one text that is longer) and the cache
(``CACHE`` words, started anew when full). Null texts are empty; an empty text has no tokens.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import slices, trim
from folioscope.llm.words import same_spelling, span_hashes

BLOCK = 8 << 20
PIECE = 1 << 20
CACHE = 300_000

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: The code points of Unicode's property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Ranges that are letters (L) or numbers (N) since Unicode 16.0, which the tokenizers follow.
NEWER = [
    (0x1C89, 0x1C8A, "L"), (0xA7CB, 0xA7CD, "L"), (0xA7DA, 0xA7DC, "L"), (0x105C0, 0x105F3, "L"), (0x10D40, 0x10D49, "N"), (0x10D4A, 0x10D65, "L"),
    (0x10D6F, 0x10D85, "L"), (0x10EC2, 0x10EC4, "L"), (0x11380, 0x11389, "L"), (0x1138B, 0x1138B, "L"), (0x1138E, 0x1138E, "L"), (0x11390, 0x113B5, "L"),
    (0x113B7, 0x113B7, "L"), (0x113D1, 0x113D1, "L"), (0x113D3, 0x113D3, "L"), (0x116D0, 0x116E3, "N"), (0x11BC0, 0x11BE0, "L"), (0x11BF0, 0x11BF9, "N"),
    (0x13460, 0x143FA, "L"), (0x16100, 0x1611D, "L"), (0x16130, 0x16139, "N"), (0x16D40, 0x16D6C, "L"), (0x16D70, 0x16D79, "N"), (0x18CFF, 0x18CFF, "L"),
    (0x1CCF0, 0x1CCF9, "N"), (0x1E5D0, 0x1E5ED, "L"), (0x1E5F0, 0x1E5F0, "L"), (0x1E5F1, 0x1E5FA, "N"),
]


@functools.cache
def kinds() -> np.ndarray:
    """For each code point whether it is a letter, a number, white space or another."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    for first, last, k in NEWER:
        out[first : last + 1] = LETTER if k == "L" else NUMBER
    out[WHITE] = SPACE
    return out


def cuts(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The first code point of each word of segments that end at ``stops`` (ascending, the last: all).

    Words: a contraction, or a run of letters, of numbers or of other characters with the one
    blank before it, or white space without the character before the next such run.
    """
    n = len(points)
    kind = kinds()[points]
    starts_segment = np.zeros(n + 1, bool)
    starts_segment[0] = True
    starts_segment[stops] = True
    first = np.ones(n + 1, bool)  # of runs of one kind
    first[1:n] = kind[1:] != kind[:-1]
    first |= starts_segment
    word = first[:n].copy()
    space = kind == SPACE
    run = np.flatnonzero(first[:n])
    run_end = np.append(run[1:], n)
    # the last character of white space goes to what follows, if that is in the same segment
    white = space[run] & (run_end < n)
    white[white] &= ~starts_segment[run_end[white]]
    last = run_end[white] - 1
    word[last] = True
    blank = last[points[last] == 32]
    word[blank + 1] = False
    # contractions: an apostrophe that starts a word, alone of its kind
    quote = np.flatnonzero((points == 39) & word & first[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~starts_segment[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        one = np.isin(a, [ord(c) for c in "stmd"])
        has_two = quote + 2 < n
        has_two[has_two] &= (kind[quote[has_two] + 2] == LETTER) & ~starts_segment[quote[has_two] + 2]
        b = np.where(has_two, points[np.minimum(quote + 2, n - 1)], 0)
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        word[quote[one | two] + 1] = False
        for at in (quote[one] + 2, quote[two] + 3):
            at = at[at < n]
            word[at] = True
    return np.flatnonzero(word)


class Vocabulary:
    """Symbols, merges and special tokens of a tokenizer file in JSON (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        # the usual visible stand-ins of bytes: printable ones stand for themselves, others follow 255
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        stand_in = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        back = {c: b for b, c in stand_in.items()}
        self.of_byte = np.array([vocab[stand_in[b]] for b in range(256)], np.int32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        # two tables of ranks by a hash of the pair; the second has the pairs whose place in the first is taken
        self.first = np.full(1 << 21, -1, np.int32)
        place = self._place(self.left, self.right, 0x9E3779B1, 11)
        self.first[place[::-1]] = np.arange(len(merges) - 1, -1, -1)
        rest = np.flatnonzero(self.first[place] != np.arange(len(merges)))
        for self.factor in range(0x85EBCA6B, 0x85EBCA6B + 20_000, 2):
            place = self._place(self.left[rest], self.right[rest], self.factor, 11)
            if len(np.unique(place)) == len(rest):
                break
        else:
            raise ValueError(f"no hash tells the pairs of {path} apart")
        self.second = np.full(1 << 21, -1, np.int32)
        self.second[place] = rest

    @staticmethod
    def _place(left: np.ndarray, right: np.ndarray, factor: int, shift: int) -> np.ndarray:
        x = left.astype(np.uint32) * np.uint32(factor) ^ right.astype(np.uint32) * np.uint32(0x27D4EB2F)
        return x * np.uint32(0x165667B1) >> np.uint32(shift)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        out = self.first[self._place(left, right, 0x9E3779B1, 11)]
        ok = (self.left[out] == left) & (self.right[out] == right) & (out >= 0)
        other = self.second[self._place(left, right, self.factor, 11)]
        also = (self.left[other] == left) & (self.right[other] == right) & (other >= 0)
        return np.where(ok, out, np.where(also, other, -1))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of distinct words, one after another, and where each word's begin."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        symbol = np.empty(n + 1, np.int32)
        symbol[:n] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        symbol[n] = -2  # what lies beyond each word's end
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        starts = ends - lengths
        before[starts] = n
        has = np.flatnonzero(after[:n] != n)
        rank = self.ranks(symbol[has], symbol[has + 1])
        has, rank = has[rank >= 0].astype(np.int32), rank[rank >= 0]
        by = np.argsort(rank, kind="stable")
        has, rank = has[by], rank[by]
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(rank: np.ndarray, at: np.ndarray) -> None:
            """Adds positions, sorted by rank, to the lists of their pairs."""
            edge = np.flatnonzero(np.diff(rank)) + 1
            for r, x in zip(rank[np.append(0, edge)].tolist(), np.split(at, edge), strict=True):
                if (to := lists.get(r)) is None:
                    lists[r] = [x]
                    heapq.heappush(active, r)
                else:
                    to.append(x)

        if len(has):
            note(rank, has)
        while active:
            r = heapq.heappop(active)
            found = lists.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b, new = self.left[r], self.right[r], self.made[r]
            nxt = after[at]
            at = at[(symbol[at] == a) & (symbol[nxt] == b)]
            if not len(at):
                continue
            if a == b:  # overlapping pairs merge from the left
                if len(found) == 1:
                    at = np.sort(at)
                kept, gone = [], -1
                for p in at.tolist():
                    if p != gone:
                        kept.append(p)
                        gone = int(after[p])
                at = np.array(kept, np.int32)
            nxt = after[at]
            far = after[nxt]
            symbol[at] = new
            symbol[nxt] = -1
            after[at] = far
            before[far] = at
            near = before[at]
            where = np.concatenate([near[near != n], at[far != n]])
            if not len(where):
                continue
            rank = self.ranks(symbol[where], symbol[after[where]])
            ok = rank >= 0
            if ok.any():
                where, rank = where[ok], rank[ok]
                by = np.argsort(rank, kind="stable")
                note(rank[by], where[by])
        alive = symbol[:n] >= 0
        count = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=count[1:])
        return symbol[:n][alive], np.append(count[starts], count[n])


class Encoder:
    """Encodes texts; keeps the words it has met."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def _segments(self, text: str) -> list[str | int]:
        """The text cut at special tokens, which stand as their ids."""
        parts: list[str | int] = [text]
        for token, i in self.vocabulary.special.items():
            if token in text:
                cut: list[str | int] = []
                for p in parts:
                    if isinstance(p, int):
                        cut.append(p)
                        continue
                    for k, piece in enumerate(p.split(token)):
                        if k:
                            cut.append(i)
                        if piece:
                            cut.append(piece)
                parts = cut
        return parts

    @staticmethod
    def _firsts(local: np.ndarray) -> np.ndarray:
        """The first place of each number of ``local``."""
        firsts = np.zeros(local.max() + 1 if len(local) else 0, np.int64)
        firsts[local[::-1]] = np.arange(len(local) - 1, -1, -1)
        return firsts

    def _codes(self, texts: list[str], special: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """The index of each word of the segments, and the offsets of the segments' words."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(lengths)
        starts = cuts(points, stops[:-1]) if len(points) else np.zeros(0, np.int64)
        mark = np.flatnonzero(special)
        if len(mark):  # a special token is one word
            inside = np.zeros(len(points), bool)
            for k in mark:
                inside[stops[k] - lengths[k] + 1 : stops[k]] = True
            starts = starts[~inside[starts]]
        ends = np.append(starts[1:], len(points))
        data = points.view(np.uint8)
        local, _ = pd.factorize(span_hashes(data, starts * 4, ends * 4))
        firsts = self._firsts(local)
        if not same_spelling(data, starts * 4, ends * 4, firsts[local]):  # two words of one hash: by spelling
            local, _ = pd.factorize(np.array([data[4 * a : 4 * b].tobytes() for a, b in zip(starts, ends, strict=True)], object))
            firsts = self._firsts(local)
        if len(mark):  # a special token is no word, even one that spells it
            at = np.searchsorted(starts, stops[mark] - lengths[mark])
            tokens, names = pd.factorize(np.array([texts[k] for k in mark], object))
            local[at] = len(firsts) + tokens
            firsts = np.append(firsts, at[self._firsts(tokens)])
        whole = "".join(texts)
        s, e = starts[firsts].tolist(), ends[firsts].tolist()
        spell = [whole[a:b].encode("utf-8", "replace") for a, b in zip(s, e, strict=True)]
        if len(mark):
            spell[len(spell) - len(names) :] = [b"\xff" + t.encode() for t in names]
        index = self.index
        known = np.fromiter((index.setdefault(w, len(index)) for w in spell), np.int64, len(spell))
        return known[local].astype(np.int32), np.append(np.searchsorted(starts, stops - lengths), len(starts))

    def _learn(self) -> None:
        """Encodes the words that the cache has no ids of."""
        done = len(self.at) - 1
        fresh = list(self.index)[done:]
        if not fresh:
            return
        special = {b"\xff" + t.encode(): i for t, i in self.vocabulary.special.items()}
        ids, at = self.vocabulary.merge([w if w not in special else b" " for w in fresh])
        if special.keys() & self.index.keys():
            for k, w in enumerate(fresh):
                if w in special:
                    ids[at[k]] = special[w]
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + at[1:]])

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts: (first, one past the last, word codes, offset of each text's codes).

        The codes hold until the next run; ``self.ids`` and ``self.at`` have their tokens.
        """
        first = 0
        while first < len(texts):
            if len(self.index) > CACHE:
                self._clear()
            last, size = first, 0
            parts: list[np.ndarray] = []
            offsets = [0]
            while last < len(texts) and (last == first or size < BLOCK):
                piece: list[str] = []
                special: list[bool] = []
                owner: list[int] = []
                got = 0
                begin = last
                while last < len(texts) and (last == begin or got < PIECE) and (last == first or size + got < BLOCK):
                    for part in self._segments(texts[last] or ""):
                        special.append(isinstance(part, int))
                        piece.append(part if isinstance(part, str) else next(t for t, i in self.vocabulary.special.items() if i == part))
                        owner.append(last - begin)
                        got += len(piece[-1])
                    last += 1
                size += got
                if got:
                    codes, at = self._codes(piece, special)
                    ends = np.zeros(last - begin, np.int64)
                    np.add.at(ends, owner, np.diff(at))
                else:
                    codes, ends = np.zeros(0, np.int32), np.zeros(last - begin, np.int64)
                parts.append(codes)
                offsets.extend((offsets[-1] + np.cumsum(ends)).tolist())
            self._learn()
            yield first, last, np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(offsets)
            first = last

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        """The token ids of words one after another."""
        start = self.at[codes]
        count = self.at[codes + 1] - start
        ends = np.cumsum(count)
        if not len(ends):
            return np.zeros(0, np.int32)
        return self.ids[np.arange(ends[-1]) + np.repeat(start - (ends - count), count)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The token ids of each text."""
        out = []
        for first, last, codes, at in self.blocks(texts):
            out += [self.tokens(codes[at[i] : at[i + 1]]) for i in range(last - first)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that aren't UTF-8 become replacement characters."""
        of = self.vocabulary.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(path)


def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    decimal = [str(k) for k in range(len(own.vocabulary.bytes_of))]
    for batch in slices(batches, 1):
        n_tokens, ids_sha, text_sha = [], [], []
        for first, last, codes, at in own.blocks(batch.column(1).to_pylist()):
            for i in range(last - first):
                ids = own.tokens(codes[at[i] : at[i + 1]]).tolist()
                n_tokens.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([decimal[k] for k in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the ids, and returns digests of both.

    One row for each row of ``docs``: the id, ``n_tokens``, ``ids_sha256`` (of decimal ids joined
    by commas) and ``decoded_sha256``. Null and empty texts: no tokens, digests of nothing. An id
    may be null or repeated, repeated rows each have their row, very long texts are encoded whole, an
    empty table gives an empty one; other columns aren't read.
    """
    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return got.mapInArrow(functools.partial(_digests, path), schema).withColumnRenamed("id", id_col)


def _arrays(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in slices(batches, 1):
        texts = batch.column(1).to_pylist()
        for first, last, codes, at in own.blocks(texts):
            ids = own.tokens(codes)
            count = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(own.at[codes + 1] - own.at[codes], out=count[1:])
            part = pa.ListArray.from_arrays(pa.array(count[at].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), part], ["id", "token_ids"])
        del texts
        trim()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``token_ids`` (array of int) of each row; null and empty texts have no ids.

    Very long texts are encoded whole; null and repeated ids and repeated rows each have their row;
    an empty table gives an empty one; other columns aren't read.
    """
    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return got.mapInArrow(functools.partial(_arrays, path), "id long, token_ids array<int>").withColumnRenamed("id", id_col)


def _texts(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The id and ``text`` of each row of token ids; null means none.

    Very long rows are decoded whole; null and repeated ids and repeated rows each have their row; an
    empty table gives an empty one; other columns aren't read.
    """
    got = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return got.mapInArrow(functools.partial(_texts, path), "id long, text string").withColumnRenamed("id", id_col)
