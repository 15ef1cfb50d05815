"""Benchmark decontamination by winnowing.

From each run of ``WINDOW`` neighbouring k-grams the one of least hash is kept, of the benchmark's
items and of the texts. Two texts that share ``SPAN`` = K + WINDOW - 1 words share a run of k-grams,
so they keep the same k-gram there: every shared window of ``SPAN`` words is found. Where a text's
fingerprint may be among the items', the windows around it are candidates, which extends the hit to
words and items. Items of fewer words are one window each, sought at every position of the texts;
there are at most ``SPAN`` - 1 lengths of those.

Candidates are joined with the written table of the items' windows, by hash and by spelling: Spark
broadcasts that table while it is small and sorts and splits both sides when it isn't. Only what
may be among the items' fingerprints and windows leaves the scan of the texts; that is told by two
sketches of 2**``BITS`` bits each, whatever the size of the benchmark. A sketch only lets too much
through, never too little.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace, parts, slices, trim, utf8
from folioscope.llm.words import ALNUM, grams, word_hashes

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
#: A sketch has 2**BITS bits, 2 MB, unless a caller wants another size.
BITS = 24
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the k-grams that are least in any run of ``WINDOW`` (equal ones: the last)."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW):
        lower = hashes[j : j + n] <= best
        best[lower] = hashes[j : j + n][lower]
        at[lower] = j
    at += np.arange(n)
    return at[np.append(True, at[1:] != at[:-1])]


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z as a-z."""
    return WORD.findall(text.encode("utf-8", "replace").lower())


def window_at(words: list[bytes], at: int, size: int) -> str:
    return b" ".join(words[at : at + size]).decode()


class Sketch(NamedTuple):
    """The lengths of the items' windows, and 2**bits packed bits of fingerprints and of windows."""

    bits: int
    sizes: tuple[int, ...]
    prints: bytes
    windows: bytes

    def may_have(self, part: str, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        byte = _unpacked(getattr(self, part))[(place >> np.uint64(3)).astype(np.int64)]
        return (byte >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


@functools.lru_cache(4)
def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def candidates(sketch: Sketch, words: np.ndarray, row: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, first words and hashes of the windows that may be an item's.

    ``words`` may hold several texts; ``row`` says which text each belongs to.
    """
    found = {}
    for size in sketch.sizes:
        n = len(words) - size + 1
        if n <= 0:
            continue
        if size == SPAN:
            short = grams(words, K)
            at = winnow(short)
            at = at[sketch.may_have("prints", short[at])]
            start = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
            start = start[(start >= 0) & (start < n)]
        else:
            start = np.arange(n)
        start = start[row[start] == row[start + size - 1]]
        if not len(start):
            continue
        window = grams(words[start[:, None] + np.arange(size)].ravel(), size)[::size] if size == SPAN else grams(words, size)[start]
        ok = sketch.may_have("windows", window)
        if ok.any():
            found[size] = start[ok], window[ok]
    return found


FOUND = "array<struct<size:int,hash:long,window:string,starts:array<int>>>"
_FOUND = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("window", pa.string()), ("starts", pa.list_(pa.int32()))]))


def _found(sketch: Sketch, column: pa.Array) -> tuple[list[int], list[list[dict]]]:
    """Of each text its number of words and its candidate windows, each with its places."""
    data, offsets = utf8(column)
    n_words: list[int] = []
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for first, last, hashes, at in word_hashes(data, offsets, ALNUM):
        row = np.repeat(np.arange(last - first), np.diff(at))
        n_words += np.diff(at).tolist()
        met: dict[int, dict[tuple[int, str], dict]] = {}
        words: dict[int, list[bytes]] = {}
        for size, (start, window) in candidates(sketch, hashes, row).items():
            for s, h in zip(start.tolist(), window.view(np.int64).tolist(), strict=True):
                r = int(row[s])
                if r not in words:
                    words[r] = words_of(column[first + r].as_py())
                p = s - int(at[r])
                spelt = window_at(words[r], p, size)
                one = met.setdefault(r, {}).setdefault((size, spelt), {"size": size, "hash": h, "window": spelt, "starts": []})
                one["starts"].append(p)
        for r, own in met.items():
            out[first + r] = list(own.values())
    return n_words, out


def _scan(sketch: Sketch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        n_words, found = _found(sketch, batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(found, _FOUND)], ["row", "doc_id", "n_words", "found"])
        trim()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (item, text): its distinct windows, and its fingerprints as windows of length 0."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, offsets = utf8(pa.array([text.as_py()], pa.string()))
            _, _, hashes, _ = next(word_hashes(data, offsets, ALNUM))
            if not len(hashes):
                continue
            size, words = min(SPAN, len(hashes)), words_of(text.as_py())
            own = {window_at(words, p, size): h for p, h in enumerate(grams(hashes, size).view(np.int64).tolist())}
            rows = [(size, h, w) for w, h in own.items()]
            if size == SPAN:
                short = grams(hashes, K)
                rows += [(0, h, None) for h in np.unique(short[winnow(short)]).view(np.int64).tolist()]
            sizes, codes, spelt = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.string()), pa.array(sizes, pa.int32()), pa.array(codes, pa.int64()), pa.array(spelt, pa.string())], ["item", "size", "hash", "window"])


def indexed(benchmark: DataFrame, space: Workspace, id_col: str, text_col: str, bits: int = BITS) -> tuple[DataFrame, Sketch]:
    """The written table (item, size, hash, window) of a benchmark, and its sketch."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    table = space.stash(rows.mapInArrow(_windows, "item string, size int, hash long, window string"), "windows")
    sizes = tuple(sorted(r[0] for r in table.where("size > 0").select("size").distinct().collect()))  # SPAN of them at most
    place = F.shiftrightunsigned("hash", 64 - bits)
    words = table.groupBy((F.col("size") == 0).alias("print"), F.shiftright(place, 6).alias("at"))
    filled = {True: np.zeros(1 << max(bits - 6, 0), np.int64), False: np.zeros(1 << max(bits - 6, 0), np.int64)}
    for r in words.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")).alias("bits")).collect():  # 2**(bits - 5) rows at most
        filled[r["print"]][r["at"]] = r["bits"]
    packed = {k: zlib.compress(v.tobytes(), 1) for k, v in filled.items()}
    return table.where("size > 0"), Sketch(bits, sizes, packed[True], packed[False])


def _hits(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (row, start, size, hash, window) whose window is an item's; ``found``: (row, found)."""
    each = found.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.*")
    return each.join(windows.select("size", "hash", "window").distinct(), ["size", "hash", "window"], "left_semi")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: what it shares with the benchmark's items.

    Words: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z. A
    window: ``SPAN`` consecutive words of an item, or all words of an item that has fewer. Columns:
    the id, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items`` (distinct
    item ids whose windows occur), ``items_sha256`` (of those ids, sorted as strings, joined by
    commas) and ``contaminated``. Null and empty texts have no words; null items have no windows; a
    null item id counts as an empty string. Rows that repeat an id are judged alone. Without items
    nothing is hit, an empty table gives an empty one, and no column but the named is read. Very
    long texts are read in pieces, with their windows across pieces.
    """
    space = Workspace(docs.sparkSession, "decontaminate")
    windows, sketch = indexed(benchmark, space, item_col, item_text_col, bits)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # the row numbers are written with the candidates: from here on they are fixed
    scanned = space.stash(rows.mapInArrow(functools.partial(_scan, sketch), f"row long, doc_id long, n_words long, found {FOUND}"), "scanned")
    met = _hits(scanned, windows)
    # a row's groups are bounded by its own text: spans of words, then distinct items
    spans = F.array_sort(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("start"), (s + F.col("size")).alias("end"))))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(a, s):
        fresh = s["end"] - F.greatest(a["end"], s["start"])
        return F.struct((a["n"] + F.greatest(F.lit(0), fresh)).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))

    counted = met.groupBy("row").agg(spans.alias("spans")).select("row", F.aggregate("spans", zero, step)["n"].alias("n_hit"))
    named = met.select("row", "size", "hash", "window").join(windows, ["size", "hash", "window"]).select("row", "item").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    whole = scanned.select("row", "doc_id", "n_words").join(counted.join(named, "row"), "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = whole.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumnRenamed("doc_id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, whole, that hold no window of an item; nulls, empty texts and repeats too.

    Very long texts are read whole, an empty table gives an empty one.

    Texts without a candidate window pass as they are read; only those with one are written apart
    and joined, so no other text is shuffled. Columns may have any names.
    """
    space = Workspace(docs.sparkSession, "decontaminate")
    windows, sketch = indexed(benchmark, space, item_col, item_text_col, bits)

    def sought(column: pa.Array) -> pa.Array:
        out = pa.concat_arrays([pa.array(_found(sketch, column.slice(start, n))[1], _FOUND) for start, n in parts(column)])
        trim()
        return out

    found = F.arrow_udf(sought, FOUND)(F.col(text_col))
    doubtful = docs.select(F.struct(*docs.columns).alias("kept"), found.alias("found")).where("size(found) > 0")
    doubtful = space.stash(doubtful.withColumn("row", F.monotonically_increasing_id()), "doubtful")
    passed = doubtful.join(_hits(doubtful.select("row", "found"), windows).select("row"), "row", "left_anti")
    return docs.where(F.size(found) == 0).unionByName(passed.select("kept.*"))
