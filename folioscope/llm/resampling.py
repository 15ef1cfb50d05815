"""Importance resampling of documents towards a target text, by n-grams found in suffix arrays.

The words of a block of texts are numbered and their suffixes sorted by the first ``longest``
words, which is as far as features reach. Neighbours in that order that share k words stand in one
run of the LCP array: a run is one k-gram and all its occurrences. Each run is hashed once, its
bucket is scattered to the occurrences, and a document is the list of its occurrences' buckets.
Those lists are written; what the corpus and the target hold in each bucket (as many numbers as
there are buckets, whatever the size of the corpus) gives each bucket's gain, and the lists are
scored by it.

A bucket's gain is floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) for s of S features of the
corpus, t of T of the target, and B buckets. A document's weight is the floored mean of its
features' gains, its score the weight and floor(-1000 * ln(-ln(u))), where u comes from the sha256 of
the seed and its id: Gumbel top-k.

Odd rows: null and empty texts and such without words have no features and the weight 0; they are
scored as all others, but have too few words to be drawn. Null ids are hashed as an empty text.
Rows that repeat id and text have the same score; of equal scores the smaller id is drawn first,
null ids last. Very long texts are read in pieces that end between words; features reach across.
An empty table gives an empty one, an empty target gains from add-one smoothing alone. Other
columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace, trim, utf8
from folioscope.llm.ordering import placed
from folioscope.llm.words import ALNUM, LOWER, pieces

BUCKETS, LONGEST, SEED, SHARE, LEAST_WORDS = 10_000, 2, 7, 25, 20
#: Bytes of text whose words are numbered and sorted at once.
BLOCK = 1 << 22
#: Words of more bytes are hashed one at a time.
SHORT = 64


def _crc_steps() -> np.ndarray:
    """What each low byte does to a crc32 (the reversed polynomial of zlib)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


STEPS = _crc_steps()
_ONES = np.uint32(0xFFFFFFFF)


def crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc32 of what gave ``state`` (0: of nothing) followed by each span of bytes."""
    out = state ^ _ONES
    some = np.flatnonzero((lengths > 0) & (lengths <= SHORT))
    at, left, now, k = starts[some], lengths[some], out[some], 0
    while len(some):
        now = STEPS[(now ^ data[at + k]) & 0xFF] ^ (now >> np.uint32(8))
        k += 1
        more = left > k
        if not more.all():
            out[some] = now
            some, at, left, now = some[more], at[more], left[more], now[more]
    out ^= _ONES
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes(), int(state[i]))
    return out


def found_words(data: np.ndarray, offsets: np.ndarray, first: int, last: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows first to last in the bytes from start to stop: the words' letters, their lengths, and the byte where each begins."""
    raw = LOWER[data[start:stop]]
    inside = ALNUM[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    edges = offsets[first:last] - start
    fresh[edges[(edges >= 0) & (edges <= len(raw))]] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return raw[inside], ends - starts, starts


def suffix_runs(ids: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word suffixes in the order of their first ``longest`` words, and for each k whether a suffix shares k with the one before.

    ``left`` is the number of words from each position to the end of its text. Prefix doubling:
    ranks by the first k words give those by the first 2 k.
    """
    rank, k = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < longest:
        ahead = np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(left > k)
        ahead[inner] = rank[inner + k] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1])[: len(ids)])
        k *= 2
    shared, a, b = [], order[:-1], order[1:]
    same = np.ones(max(len(ids) - 1, 0), bool)
    for k in range(longest):
        reach = same & (left[a] > k) & (left[b] > k)
        same = reach.copy()
        same[reach] = ids[a[reach] + k] == ids[b[reach] + k]
        shared.append(np.append(False, same)[: len(ids)])
    return order, shared


def bucket_lists(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: (first, one past the last, buckets of all features, features of each row, words of each row)."""
    kept: list[np.ndarray] = []
    carry = words_before = 0
    carried = np.zeros(0, np.int64)
    for first, last, start, stop in pieces(offsets, data, ALNUM, BLOCK):
        alone = last == first + 1 and offsets[last] - offsets[first] > BLOCK
        begin = int(carried[0]) if alone and kept and len(carried) else start
        letters, lengths, starts = found_words(data, offsets, first, last, begin, stop)
        carry = int(np.searchsorted(starts + begin, start)) if begin < start else 0
        at = np.searchsorted(starts, offsets[first : last + 1] - begin)
        at[-1] = len(starts)
        n = len(lengths)
        row = np.repeat(np.arange(last - first), np.diff(at))
        left = at[1:][row] - np.arange(n)
        ends = np.append(0, np.cumsum(lengths))
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spelled, spots = utf8(coded.dictionary)
        sizes = np.diff(spots)
        order, shared = suffix_runs(ids, left, longest)
        hashed = np.zeros(n, np.uint32)
        out = np.zeros((n, longest), np.uint32)
        real = np.zeros((n, longest), bool)
        space = np.array([32], np.uint8)
        for k in range(longest):
            reach = left > k
            real[:, k] = reach & (np.arange(n) + k >= carry)
            head = order[reach[order] & ~shared[k]]
            run = np.cumsum(reach[order] & ~shared[k]) - 1
            word = ids[head + k]
            state = hashed[head] if k else np.zeros(len(head), np.uint32)
            if k:
                state = crc_on(state, space, np.zeros(len(head), np.int64), np.ones(len(head), np.int64))
            state = crc_on(state, spelled, spots[word], sizes[word])
            there = reach[order]
            hashed = np.zeros(n, np.uint32)
            hashed[order[there]] = state[run[there]]
            out[:, k] = hashed % np.uint32(buckets)
        flat = out[real]
        if alone:
            kept.append(flat)
            words_before += n - carry
            carried = (starts + begin)[-(longest - 1) :] if longest > 1 else np.zeros(0, np.int64)
            if stop < offsets[last]:
                continue
            flat = np.concatenate(kept)
            yield first, last, flat, np.array([len(flat)]), np.array([words_before])
            kept, words_before, carried = [], 0, np.zeros(0, np.int64)
            continue
        each = np.append(0, np.cumsum(real.sum(axis=1)))
        yield first, last, flat, np.diff(each[at]), np.diff(at)


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def bucketed(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, features): the buckets of a text's features as little-endian numbers of two bytes, or of four from 65,537 buckets on."""
    kind = _kind(buckets)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last, flat, n, words in bucket_lists(data, offsets, longest, buckets):
                ends = np.append(0, np.cumsum(n)) * np.dtype(kind).itemsize
                lists = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(words, pa.int64()), lists.cast(pa.binary())], ["doc_id", "n_words", "features"])
            trim()

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of_id}, n_words long, features binary")


def bucket_counts(lists: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features all rows have in each bucket: a task gives its own sums, Spark adds them up."""
    kind = _kind(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            total += np.bincount(data[offsets[0] : offsets[-1]].view(kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in lists.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: the log ratio of its smoothed shares in the target and in the corpus, in thousandths."""
    b, all_own, all_target = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_own + b) / ((s + 1) * (all_target + b)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(lists: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the features' gains."""
    kind = _kind(len(gain))

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            step = np.dtype(kind).itemsize
            sums = np.append(0, np.cumsum(gain[data[offsets[0] : offsets[-1]].view(kind)]))
            n = np.diff(offsets) // step
            total = sums[(offsets[1:] - offsets[0]) // step] - sums[(offsets[:-1] - offsets[0]) // step]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    kind_of_id = lists.schema["doc_id"].dataType.simpleString()
    return lists.mapInArrow(run, f"doc_id {kind_of_id}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` of those that aren't drawn is null.

    Drawn are ``share`` percent of the documents with at least ``least_words`` words.
    """
    space = Workspace(docs.sparkSession, "resampling")
    lists = space.stash(bucketed(docs, longest, buckets), "lists")
    gain = gains(bucket_counts(lists, buckets), bucket_counts(bucketed(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets), buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(u)))
    scored = weighed(lists, gain).select("doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("_fit"))
    order = [F.col("_fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = placed(space, scored, order, "_place", "ranked")
    drawn = ranked.where("_fit").count() * share // 100
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"))
