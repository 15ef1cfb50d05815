"""Spelling variants: one-edit pairs of words by merging the light subtrees of an errata trie.

The words are the leaves of a trie. At each branching node the child with the most words is heavy,
the others (and a word that ends there) are light, so a word lies under at most log2 of all words
light edges. Two words that differ by one edit part at one node, and one of them at least is on a
light edge there. So each light subtree is merged, word by word, into what stands beside it, the
smaller into the larger: with its first character skipped, replaced by the heavy one, or put
behind the heavy one, it is looked up among all words; with its first character replaced by a mark
it meets the other light subtrees. Where terminals coincide, two words are one edit apart, and each
such pair is found once.

Words are sorted and cut into ranges, a task each. A node whose words are all in one range is
merged in that task; the nodes that reach across ranges are the common beginnings of neighbouring
ranges. Their children are counted by Spark, and the words below them leave their merged spellings
to a join and a grouping by Spark; a group of the mark has a word for each letter at most.

Characters are those of Latin-1, so a word is kept as one byte a code point.

Odd rows: null and empty texts have no words; a null id counts as an empty text where deletions are
drawn; rows that repeat id and text count again; very long texts are cut between words, and words
of any length are whole. Of equally frequent near words the first in code-point order is the form.
An empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace, trim, utf8
from folioscope.llm.resampling import crc_on
from folioscope.llm.words import LOWER, pieces

LEAST, OFTEN, DELETED, TIMES = 7, 2, 31, 10
BLOCK = 1 << 22
#: Words of a range: what one task sorts and merges.
RANGE = 100_000

LETTER = np.zeros(256, bool)
LETTER[97:123] = True
#: Texts are cut where neither a letter nor a part of a longer character stands.
UNCUT = LETTER.copy()
UNCUT[0x80:] = True
#: UTF-8 has the letters from U+00C0 on as this byte and one of 0x80 to 0xBF.
LEAD = 0xC3
#: Stands for any character; no word holds it.
MARK = 0


def runs(data: np.ndarray, offsets: np.ndarray, prefixes: np.ndarray, least: int, deleted: int) -> Iterator[pa.Array]:
    """The words of runs of rows in one byte a code point, the drawn character left out."""
    for first, last, start, stop in pieces(offsets, data, UNCUT, BLOCK):
        raw = LOWER[data[start:stop]]
        if not len(raw):
            continue
        second = np.append(False, raw[:-1] == LEAD)
        inside = LETTER[raw] | (raw == LEAD) | second
        edges = offsets[first:last] - start
        fresh = np.zeros(len(raw) + 1, bool)
        fresh[edges[(edges >= 0) & (edges <= len(raw))]] = True
        begin = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | fresh[:-1]))
        end = np.flatnonzero(inside & (~np.append(inside[1:], False) | fresh[1:])) + 1
        points = np.cumsum(raw != LEAD)
        size = points[end - 1] - points[begin] + (raw[begin] != LEAD)
        some = size >= least
        begin, end, size = begin[some], end[some], size[some]
        row = first + np.searchsorted(offsets[first:last], begin + start, "right") - 1
        hashed = crc_on(prefixes[row], raw, begin, end - begin)
        keep = np.zeros(len(raw) + 1, np.int32)
        np.add.at(keep, begin, 1)
        np.add.at(keep, end, -1)
        kept = (np.cumsum(keep)[:-1] > 0) & (raw != LEAD)
        hit = np.flatnonzero(hashed % np.uint32(deleted) == 0)
        if len(hit):
            place = np.append(0, np.cumsum(kept))
            letters = np.flatnonzero(kept)
            kept[letters[place[begin[hit]] + (hashed[hit] % size[hit].astype(np.uint32)).astype(np.int64)]] = False
            size[hit] -= 1
            for i in hit[size[hit] < least].tolist():
                kept[begin[i] : end[i]] = False
            size = size[size >= least]
        letters = (raw + second.astype(np.uint8) * np.uint8(0x40))[kept]
        ends = np.append(0, np.cumsum(size))
        yield pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN, deleted: int = DELETED) -> DataFrame:
    """(word, n): the words, a byte a code point, with their counts. Each block's words are counted before they are shuffled."""

    def run(batches):
        for batch in batches:
            prefixes = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in batch.column(0).to_pylist()], np.uint32)
            for found in runs(*utf8(batch.column(1)), prefixes, least, deleted):
                coded = found.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])
            trim()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def node_of(prefix: bytes) -> bytes:
    return hashlib.blake2b(prefix, digest_size=16).digest()


class Words:
    """A range of the sorted words: bytes, offsets, counts, and the length of each one's beginning shared with the one before."""

    def __init__(self, column: pa.Array, counts: np.ndarray):
        self.data, self.offsets = utf8(column)
        self.n, self.counts = len(column), counts
        self.size = np.diff(self.offsets)
        self.start = self.offsets[:-1]
        self.column = column
        self.shared = self._shared()

    def _shared(self) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        some, k = np.arange(1, self.n), 0
        while len(some):
            some = some[(self.size[some] > k) & (self.size[some - 1] > k)]
            some = some[self.data[self.start[some] + k] == self.data[self.start[some - 1] + k]]
            k += 1
            out[some] = k
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def letter(self, which: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """The character of words at a depth, -1 where they end."""
        at = np.minimum(self.start[which] + depth, max(len(self.data) - 1, 0))
        return np.where(self.size[which] > depth, self.data[at].astype(np.int16), np.int16(-1))


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
    return int(other[0]) if len(other) else n


def range_ends(ranged: DataFrame) -> list[tuple[int, bytes, bytes]]:
    """Of each range that has words its number, first and last word: as many rows as tasks."""
    ends = ranged.groupBy("range").agg(F.min("word").alias("low"), F.max("word").alias("high")).orderBy("range")
    return [(r["range"], bytes(r["low"]), bytes(r["high"])) for r in ends.collect()]


def paths(ends: list[tuple[int, bytes, bytes]]) -> dict[int, tuple[int, int]]:
    """Of each range how far its first and its last word go along nodes that reach into the range before and after; -1: none does."""
    meet = [common(a[2], b[1]) for a, b in zip(ends, ends[1:], strict=False)]
    return {k: (meet[i - 1] if i else -1, meet[i] if i < len(meet) else -1) for i, (k, _, _) in enumerate(ends)}


def crossing(words: Words, reach: tuple[int, int]) -> Iterator[tuple[int, int, int, bytes]]:
    """The nodes of a range that reach across its ends: (depth, first word, one past the last, node). Each comes once."""
    if not words.n:
        return
    least = np.minimum.accumulate(words.shared[1:]) if words.n > 1 else np.zeros(0, np.int64)
    whole = int(least[-1]) if len(least) else max(reach)
    for end, deep in enumerate(reach):
        spelled = words.word(-1 % words.n if end else 0)
        running = hashlib.blake2b(digest_size=16)
        back = np.minimum.accumulate(words.shared[:0:-1]) if end and words.n > 1 else least
        for depth in range(deep + 1):
            if depth:
                running.update(spelled[depth - 1 : depth])
            if end and depth <= min(reach[0], whole):
                continue  # the node is on the first word's path too
            span = int(np.searchsorted(-back, -depth, "right")) + 1
            yield depth, words.n - span if end else 0, words.n if end else span, running.copy().digest()


def _range(table: pa.Table) -> tuple[int, Words]:
    """The number of a range and its words in order."""
    table = table.sort_by("word").combine_chunks()
    return int(table["range"][0].as_py()), Words(table["word"].combine_chunks(), table["n"].to_numpy())


def child_counts(ranged: DataFrame, reach: dict[int, tuple[int, int]]) -> DataFrame:
    """(node, child, n) of the nodes that reach across ranges; a child of -1 is a word that ends there."""

    def run(table):
        number, words = _range(table)
        rows: list[tuple[bytes, int, int]] = []
        for depth, low, high, node in crossing(words, reach[number]):
            child, n = np.unique(words.letter(np.arange(low, high), depth), return_counts=True)
            rows += zip([node] * len(child), child.tolist(), n.tolist(), strict=True)
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int64()))], ["node", "child", "n"])

    found = ranged.groupBy("range").applyInArrow(run, "node binary, child int, n long")
    return found.groupBy("node", "child").agg(F.sum("n").alias("n"))


def heavy_children(children: DataFrame) -> dict[bytes, int]:
    """The heavy child of each branching node that reaches across ranges: of the largest the least; a word's end is always light.

    Such nodes are beginnings that neighbouring ranges share: as many as ranges times the letters of
    their common beginnings, of which only branching ones come to the driver.
    """
    real = F.when(F.col("child") >= 0, F.col("child"))
    rank = F.when(F.col("child") >= 0, F.struct(F.col("n"), (-F.col("child")).alias("c")))
    some = children.groupBy("node").agg(F.count("*").alias("k"), F.max_by(real, rank).alias("heavy")).where("k > 1")
    return {bytes(r["node"]): r["heavy"] for r in some.collect()}


def inner_light(words: Words, outer: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Words on light edges at nodes within the range: (words, depth, heavy character of each one's node).

    Depths at which no node branches are passed over.
    """
    beside, depth = np.arange(1, words.n), 0  # words that share a node with the one before them
    reached: dict[int, list[tuple[int, int]]] = {}
    for d, low, high in outer:
        reached.setdefault(d, []).append((low, high))
    while len(beside):
        depth = max(depth, int(words.shared[beside].min()))
        member = np.unique(np.concatenate([beside - 1, beside]))
        head = np.append(True, (member[1:] != member[:-1] + 1) | (words.shared[member[1:]] < depth))
        group = np.cumsum(head) - 1
        child = words.letter(member, depth)
        turn = np.append(True, head[1:] | (child[1:] != child[:-1]))
        first = np.flatnonzero(turn)
        size = np.diff(np.append(first, len(member)))
        size = np.where(child[first] < 0, 0, size)  # a word's end is light
        of = group[first]
        order = np.lexsort((child[first], -size, of))
        best = order[np.append(True, of[order][1:] != of[order][:-1])]
        heavy = child[first[best]][group]  # one for each group, groups in order
        light = child != heavy
        for low, high in reached.get(depth, ()):
            light &= (member < low) | (member >= high)
        if light.any():
            yield member[light], depth, heavy[light]
        beside = beside[words.shared[beside] > depth]
        depth += 1


def spelled(words: Words, which: np.ndarray, at: np.ndarray, kind: str, heavy: np.ndarray) -> pa.Array:
    """Words with the character ``at`` a depth changed: replaced by ``heavy``, that put before it, it left out, or marked."""
    grown = {"replace": 0, "insert": 1, "skip": -1, "mark": 0}[kind]
    size = words.size[which] + grown
    ends = np.append(0, np.cumsum(size))
    where = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    turn = np.repeat(at, size)
    source = where.copy()
    if kind == "insert":
        source -= where > turn
        source = np.minimum(source, np.repeat(np.maximum(words.size[which] - 1, 0), size))
    elif kind == "skip":
        source += where >= turn
    data = words.data[np.repeat(words.start[which], size) + source]
    if kind in ("replace", "insert"):
        data[ends[:-1] + at] = heavy
    elif kind == "mark":
        data[ends[:-1] + at] = MARK
    return pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def merged(words: Words, which: np.ndarray, at: np.ndarray, heavy: np.ndarray, least: int) -> Iterator[tuple[bool, np.ndarray, pa.Array]]:
    """(marked, words, their merged spellings) for words on light edges."""
    own = words.letter(which, at)
    here = own >= 0
    yield False, which[here], spelled(words, which[here], at[here], "replace", heavy[here])
    yield False, which, spelled(words, which, at, "insert", heavy)
    skip = here & (own != words.letter(which, at + 1)) & (words.size[which] > least)
    yield False, which[skip], spelled(words, which[skip], at[skip], "skip", heavy[skip])
    yield True, which[here], spelled(words, which[here], at[here], "mark", heavy[here])


class Near:
    """What is known so far of each word's near words: their number and the most frequent (ties: the first)."""

    def __init__(self, words: Words):
        self.words = words
        self.number = np.zeros(words.n, np.int64)
        self.best = np.full(words.n, -1, np.int64)

    def _offer(self, mine: np.ndarray, theirs: np.ndarray) -> None:
        """One near word for each of some words."""
        had, n = self.best[mine], self.words.counts
        better = (had < 0) | (n[theirs] > n[had]) | ((n[theirs] == n[had]) & (theirs < had))
        self.best[mine[better]] = theirs[better]

    def meet(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of words by their places, each pair once."""
        one, other = np.concatenate([a, b]), np.concatenate([b, a])
        self.number += np.bincount(one, minlength=self.words.n)
        order = np.lexsort((other, -self.words.counts[other], one))
        one, other = one[order], other[order]
        first = np.append(True, one[1:] != one[:-1])[: len(one)]
        self._offer(one[first], other[first])

    def group(self, which: np.ndarray, keys: pa.Array) -> None:
        """Words whose marked spellings coincide are near each other: all meet the most frequent of them, and that the second."""
        code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((which, -self.words.counts[which], code))
        code, which = code[order], which[order]
        head = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        size = np.diff(np.append(head, len(code)))
        self.number[which] += np.repeat(size - 1, size)
        head, size = head[size > 1], size[size > 1]
        self._offer(which[head], which[head + 1])
        behind = np.repeat(head, size - 1) + np.arange((size - 1).sum()) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + 1
        self._offer(which[behind], which[np.repeat(head, size - 1)])


SENT = pa.schema([("word", pa.binary()), ("n_near", pa.int64()), ("near", pa.binary()), ("near_n", pa.int64()), ("spelling", pa.binary()), ("marked", pa.bool_()), ("n", pa.int64())])


def merged_words(ranged: DataFrame, reach: dict[int, tuple[int, int]], heavy: dict[bytes, int], least: int) -> DataFrame:
    """Two sorts of rows: what a range's words found within it, and spellings for Spark to look up (those with ``spelling``)."""

    def rows(_many: int, /, **columns) -> pa.Table:
        return pa.Table.from_arrays([columns.get(f.name, pa.nulls(_many, f.type)) for f in SENT], schema=SENT)

    def run(table):
        number, words = _range(table)
        counts, outer, out = pa.array(words.counts), [], []
        for depth, low, high, node in crossing(words, reach[number]):
            outer.append((depth, low, high))
            if node not in heavy:
                continue
            which = np.arange(low, high)
            which = which[words.letter(which, depth) != heavy[node]]
            for marked, some, spelling in merged(words, which, np.full(len(which), depth, np.int64), np.full(len(which), heavy[node], np.uint8), least):
                taken = pa.array(some)
                out.append(rows(len(some), word=words.column.take(taken), spelling=spelling.cast(pa.binary()), marked=pa.array(np.full(len(some), marked)), n=counts.take(taken)))
        near, known = Near(words), words.column.cast(pa.large_binary())
        for which, depth, best in inner_light(words, outer):
            for marked, some, spelling in merged(words, which, np.full(len(which), depth, np.int64), best.astype(np.uint8), least):
                if marked:
                    near.group(some, spelling)
                    continue
                there = pc.index_in(spelling, value_set=known)
                hit = np.flatnonzero(there.is_valid().to_numpy(zero_copy_only=False))
                near.meet(some[hit], there.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        some = np.flatnonzero(near.number)
        best = pa.array(near.best[some])
        out.append(rows(len(some), word=words.column.take(pa.array(some)), n_near=pa.array(near.number[some]), near=words.column.take(best), near_n=counts.take(best)))
        return pa.concat_tables(out)

    names = {pa.binary(): "binary", pa.int64(): "long", pa.bool_(): "boolean"}
    return ranged.groupBy("range").applyInArrow(run, ", ".join(f"{f.name} {names[f.type]}" for f in SENT))


def near_words(space: Workspace, words: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n_near, near, near_n) of those of (word, n) that have near words; ``near`` is the most frequent, of equal ones the first."""
    ranges = max(1, -(-words.count() // RANGE))
    ranged = space.stash(words.repartitionByRange(ranges, "word").withColumn("range", F.spark_partition_id()), "ranged")
    reach = paths(range_ends(ranged))
    heavy = heavy_children(child_counts(ranged, reach)) if len(reach) > 1 else {}
    sent = space.stash(merged_words(ranged, reach, heavy, least), "merged")
    inner = sent.where("spelling is null").select("word", "n_near", "near", "near_n")
    one = F.lit(1).cast("long").alias("n_near")
    asked = sent.where("spelling is not null and not marked").select("word", "n", F.col("spelling").alias("_other"))
    met = asked.join(words.select(F.col("word").alias("_other"), F.col("n").alias("_n")), "_other")
    ways = F.array(F.struct("word", one, F.col("_other").alias("near"), F.col("_n").alias("near_n")), F.struct(F.col("_other").alias("word"), one, F.col("word").alias("near"), F.col("n").alias("near_n")))
    met = met.select(F.inline(ways))
    # a group of one marked spelling has a word for each letter at most
    own = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("_less"), "word")))
    groups = sent.where("marked").groupBy("spelling").agg(own.alias("_own")).where(F.size("_own") > 1)
    groups = groups.select(F.posexplode("_own").alias("_at", "_me"), F.size("_own").cast("long").alias("_size"), F.col("_own")[0].alias("_top"), F.col("_own")[1].alias("_second"))
    other = F.when(F.col("_at") == 0, F.col("_second")).otherwise(F.col("_top"))
    groups = groups.select(F.col("_me.word").alias("word"), (F.col("_size") - 1).alias("n_near"), other["word"].alias("near"), (-other["_less"]).alias("near_n"))
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("_less"), "near"))
    found = inner.union(met).union(groups).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return found.select("word", "n_near", "_best.near", "_best.near_n")


def roots(space: Workspace, forms: DataFrame) -> DataFrame:
    """(word, root): where each word's forms lead. A form is at least ``TIMES`` as frequent, so chains are short; each round doubles the step."""
    now, k = space.stash(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("_moved")), "roots0"), 0
    while now.where("_moved").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        step = now.join(further, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved"))
        k += 1
        now = space.stash(step, f"roots{k}")
    return now.select("word", "root")


def group_variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, deleted: int = DELETED, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the corpus's words.

    Words are maximal runs of ASCII letters and of U+00C0 to U+00FF, A-Z lower-cased, of at least
    ``least`` code points and ``often`` occurrences, after one occurrence in ``deleted`` has lost a
    code point that its id and spelling draw. A word's form is its most frequent near word if that
    is at least ``times`` as frequent.
    """
    space = Workspace(docs.sparkSession, "variants")
    words = space.stash(vocabulary(docs, least, often, deleted), "words")
    near = near_words(space, words, least)
    often_enough = F.col("near_n") >= times * F.col("n")
    whole = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often_enough, F.col("near")).alias("form"), F.when(often_enough, F.col("near_n")).alias("form_n"))
    whole = space.stash(whole, "whole")
    out = whole.join(roots(space, whole.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
    shown = lambda c: F.decode(c, "ISO-8859-1").alias(c)
    return out.select(shown("word"), shown("form"), shown("root"), "n", "n_near", "form_n")
