"""Substring search by an index of trigrams.

A text's trigrams are its distinct runs of three characters after case folding; two zero characters
follow its end, so that short terms are beginnings of trigrams. A trigram is a number of three times
21 bits. The index is a table of (trigram, block, ids): for each trigram the texts of a block of
``BLOCK`` ids that have it, in one row for each piece of texts that was read at a time, with the
number of texts of each trigram beside it. A term of three characters or more is sought by its
rarest trigrams: the ids that lists of all of them share are candidates. Lists and texts meet by
block: each text is read once, for all terms that it may have, and these are verified. A list is
shuffled once a trigram and not once a term, and once for ``SETS`` sets of terms and not for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import fold
from folioscope.sources.scratch import stash

#: A term is sought by so many of its trigrams, the rarest ones: more of them exclude little.
RAREST = 3
#: Lists of ids are cut at multiples of 2**BITS, so that no list is longer.
BITS = 12
BLOCK = 1 << BITS
#: Lists are made for so many characters at a time, and so many bytes are verified at a time.
PIECE = 1 << 23
#: So many sets of terms, about, are answered at a time in a block, and so many of them are written out at a time.
SETS = 1 << 12
WRITTEN = 1 << 8


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for key in keys:
        new |= key[1:] != key[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, len(keys[0])] if len(keys[0]) else np.zeros(1, np.int64)


def _packed(places: np.ndarray) -> bytes:
    """Places in a block, two bytes each or a bit for each place there is, whatever is shorter."""
    if 16 * len(places) < BLOCK:
        return places.astype(np.uint16).tobytes()
    return np.packbits(np.bincount(places, minlength=BLOCK) > 0).tobytes()


def _bits(packed: bytes) -> np.ndarray:
    if 8 * len(packed) == BLOCK:
        return np.frombuffer(packed, np.uint8)
    return np.packbits(np.bincount(np.frombuffer(packed, np.uint16), minlength=BLOCK) > 0)


def _places(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits))


def _lists(ids: list[int], grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    ids, n = np.array(ids, np.int64), np.array([len(g) for g in grams])
    texts = np.argsort(ids >> BITS, kind="stable")
    ends = _runs((ids >> BITS)[texts])
    for own in (texts[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)):
        gram, place = np.concatenate([grams[k] for k in own]), np.repeat((ids[own] & (BLOCK - 1)).astype(np.int16), n[own])
        order = np.argsort(gram, kind="stable")
        gram, offsets = gram[order], _runs(gram[order])
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[order]))
        yield pa.RecordBatch.from_arrays([pa.array(gram[offsets[:-1]]), pa.array(np.full(len(listed), ids[own[0]] >> BITS)), listed], ["trigram", "block", "ids"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, grams, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            ids.append(key.as_py())
            grams.append(np.unique(codes(text + "\0\0")))
            held += len(text)
            if held > PIECE:
                yield from _lists(ids, grams)
                ids, grams, held = [], [], 0
    if ids:
        yield from _lists(ids, grams)


def _of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, size, code): a term's distinct trigrams; of a shorter term its one or two characters as a number."""
    for batch in batches:
        rows = []
        for term in batch.column(0).to_pylist():
            if len(term) < 3:
                rows.append((term, len(term), sum(ord(c) << 21 * k for k, c in enumerate(reversed(term)))))
            else:
                rows += [(term, 3, int(g)) for g in np.unique(codes(term))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["term", "size", "code"])


def _sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, terms, places) of (trigram, block, ids, terms, one, two).

    A trigram's list goes out once for the terms that are sought by it. Lists of trigrams that begin
    alike, and of which the beginning is a term, become one of that term.
    """
    for batch in batches:
        trigram, block, terms = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        n, place = batch.column(2).value_lengths().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(n)
        some = np.flatnonzero(terms.is_valid().to_numpy(zero_copy_only=False))
        blocks, grams, named, lists = [block[some]], [trigram[some]], terms.take(pa.array(some)).to_pylist(), [_packed(place[ends[k] - n[k] : ends[k]]) for k in some]
        for size in (1, 2):
            asked = np.repeat(batch.column(3 + size).to_numpy(zero_copy_only=False), n)
            code, at, own = np.repeat(trigram >> (63 - 21 * size), n)[asked], np.repeat(block, n)[asked], place[asked]
            order = np.lexsort((code, at))
            code, at, own = code[order], at[order], own[order]
            cuts = _runs(code, at)
            code = code[cuts[:-1]]
            blocks.append(at[cuts[:-1]])
            grams.append(-(code << 2 | size))
            named += [chr(c) if size == 1 else chr(c >> 21) + chr(c & (1 << 21) - 1) for c in code.tolist()]
            lists += [_packed(np.unique(own[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks)), pa.array(np.concatenate(grams)), pa.array(named, pa.string()), pa.array(lists, pa.binary())], ["block", "gram", "terms", "places"])


def _hashed(spelt: np.ndarray) -> np.ndarray:
    """Each three bytes that follow one another as a number of 20 bits."""
    spelt = spelt.astype(np.uint32)
    return (spelt[:-2] << 16 | spelt[1:-1] << 8 | spelt[2:]) * np.uint32(2654435761) >> np.uint32(12)


def _having(texts: list[bytes], terms: list[bytes]) -> Iterator[np.ndarray]:
    """For each term, of three bytes at least and without white space, the texts that have it.

    The places of a term's rarest three bytes in the texts are looked up, and the other bytes are
    compared there.
    """
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    starts, grams = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), _hashed(joined)
    often, rarest = np.bincount(grams, minlength=1 << 20), []
    for term in terms:
        own = _hashed(np.frombuffer(term, np.uint8))
        k = int(np.argmin(often[own]))
        rarest.append((k, own[k]))
    sought = np.zeros(1 << 20, bool)
    sought[[gram for _, gram in rarest]] = True
    place = np.flatnonzero(sought[grams])
    gram = grams[place]
    place = place[np.argsort(gram, kind="stable")]
    ends = np.cumsum(np.bincount(gram, minlength=1 << 20))
    for term, (k, gram) in zip(terms, rarest, strict=True):
        at = place[ends[gram] - often[gram] : ends[gram]] - k
        at = at[(at >= 0) & (at + len(term) <= len(joined))]
        for j in [*range(k + 3, len(term)), *range(k + 3)]:
            at = at[joined[at + j] == term[j]]
        yield np.unique(np.searchsorted(starts, at, "right") - 1)


class _Block:
    """The terms that texts of a block may have, and those that they do have."""

    def __init__(self, block: int):
        self.block, self.lists, self.grams, self.found = block, {}, {}, {}
        self.sought: dict[str, np.ndarray] | None = None
        self.texts: dict[int, bytes] = {}
        self.held = 0

    def listed(self, gram: int, terms: str, places: bytes) -> None:
        known = self.lists.get(gram)
        if known is None:
            for term in terms.split(" "):
                self.grams.setdefault(term, []).append(gram)
        self.lists[gram] = _bits(places) if known is None else known | _bits(places)

    def _candidates(self) -> None:
        """Terms that a list decides are found; the others are sought in the texts at some places."""
        self.sought = {}
        for term, grams in self.grams.items():
            if len(grams) < min(RAREST, len({term[k : k + 3] for k in range(len(term) - 2)})):
                continue  # no text of the block has one of its trigrams
            own = _places(np.bitwise_and.reduce([self.lists[g] for g in grams]))
            if len(term) <= 3 and "\0" not in term:
                self.found[term] = [own]
            elif len(own):
                self.sought[term] = own
        self.lists, self.grams = {}, {}

    def read(self, place: int, text: str) -> None:
        if self.sought is None:
            self._candidates()
        spelt = text.encode()
        if self.held + len(spelt) > PIECE:
            self._verify()
        self.texts[place] = self.texts[place] + b" " + spelt if place in self.texts else spelt
        self.held += len(spelt)

    def _verify(self) -> None:
        """Looks for the terms that any of the texts at hand may have."""
        place, texts = np.array(list(self.texts), np.int64), list(self.texts.values())
        here = np.zeros(BLOCK, bool)
        here[place] = True
        terms = [term for term, own in self.sought.items() if here[own].any()]
        spelt = [term.encode() for term in terms]
        if self.held > PIECE or min(map(len, spelt), default=0) < 3:  # one long text, or a term with a zero character
            had = (np.array([k for k, text in enumerate(texts) if term in text], np.int64) for term in spelt)
        else:
            had = _having(texts, spelt)
        for term, own in zip(terms, had, strict=True):
            if len(own):
                self.found.setdefault(term, []).append(place[own])
        self.texts, self.held = {}, 0

    def rows(self) -> pa.RecordBatch:
        if self.sought is None:
            self._candidates()
        if self.texts:
            self._verify()
        lists = [_packed(np.concatenate(own)) for own in self.found.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(self.found), pa.string()), pa.array([self.block] * len(lists), pa.int64()), pa.array(lists, pa.binary())], ["term", "block", "places"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, places) of the texts that have the term, of rows in the order of their block: lists before texts."""
    at = None
    for batch in batches:
        for block, gram, terms, places, key, text in zip(*batch.columns, strict=True):
            if at is None or at.block != block.as_py():
                if at is not None:
                    yield at.rows()
                at = _Block(block.as_py())
            if gram.is_valid:
                at.listed(gram.as_py(), terms.as_py(), places.as_py())
            else:
                at.read(key.as_py() & (BLOCK - 1), text.as_py())
    if at is not None:
        yield at.rows()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one value of the first two columns each, which they are sorted by."""
    held, key = [], None
    for batch in batches:
        cuts = _runs(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
            if held and own != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            key = own
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, block, ids) of the texts that have all terms of a set, of (block, chunk, places, sets, needed) a term."""
    for group in _groups(batches):
        lists = np.stack([_bits(p.as_py()) for p in group["places"]])
        sets, needed = (pc.list_flatten(group[c]).to_numpy() for c in ("sets", "needed"))
        each = np.repeat(np.arange(len(lists)), pc.list_value_length(group["sets"]).to_numpy())
        order = np.argsort(sets, kind="stable")
        sets, needed, each = sets[order], needed[order], each[order]
        cuts = _runs(sets)
        whole = np.diff(cuts) == needed[cuts[:-1]]
        each, sets = each[np.repeat(whole, np.diff(cuts))], sets[cuts[:-1]][whole]
        cuts = np.r_[0, np.cumsum(np.diff(cuts)[whole])]
        for k in range(0, len(sets), WRITTEN):
            ends = cuts[k : k + WRITTEN + 1]
            shared = np.bitwise_and.reduceat(lists[each[ends[0] : ends[-1]]], ends[:-1] - ends[0], axis=0)
            which, place = np.nonzero(np.unpackbits(shared, axis=1))
            own = np.searchsorted(which, np.arange(len(ends)))
            listed = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(place.astype(np.int16)))
            some = pa.array(np.diff(own) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(sets[k : k + WRITTEN]), pa.array(np.full(len(listed), group["block"][0].as_py(), np.int64)), listed], ["number", "block", "ids"]).filter(some)


class Index:
    """A written index over (id, text): ``postings`` (trigram, block, ids), ``counts`` (trigram, n)."""

    def __init__(self, texts: DataFrame, postings: DataFrame, counts: DataFrame, key: str, text: str):
        self.texts, self.postings, self.counts, self.key, self.text = texts, postings, counts, key, text


def _folded(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(F.col(key).cast("long").alias("id"), fold(F.col(text)).alias("text")).where("id is not null and text <> ''")


def build(texts: DataFrame, key: str, text: str) -> Index:
    """Indexes a table of texts by a whole number, ``key``. Null and empty texts have no postings; a common trigram's postings are lists for ``BLOCK`` ids each."""
    postings = stash(_folded(texts, key, text).mapInArrow(_posted, "trigram long, block long, ids array<smallint>"), "trigrams")
    counts = stash(postings.groupBy("trigram").agg(F.sum(F.size("ids")).alias("n")), "trigram-counts")
    return Index(texts, postings, counts, key, text)


def search(index: Index, queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """(query_id, key) of each text that has all terms of a query (parted by white space) as substrings, whatever the case.

    A query without terms fits every text that isn't null. A term is sought and verified once,
    however many queries have it, and queries of the same terms are answered once: their rows are
    made last, from the ids that the lists of all their terms share. A null query fits nothing.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(fold(F.col(query)), r"\s+"), lambda w: w != "")))
    asked = queries.where(F.col(query).isNotNull()).select(F.col(query_id).alias("query"), words.alias("terms"))
    asked = stash(asked.withColumn("set", F.array_join("terms", " ")), "queries")
    # the numbers are written before they are used
    sets = stash(asked.where("size(terms) > 0").select("set", "terms").distinct().withColumn("number", F.monotonically_increasing_id()), "sets")
    chunks = max(1, -(-sets.count() // SETS))
    each = sets.select("number", F.size("terms").alias("needed"), F.explode("terms").alias("term")).withColumn("chunk", F.expr(f"pmod(xxhash64(number), {chunks}L)"))
    parts = each.groupBy("term", "chunk").agg(F.collect_list(F.struct("number", "needed")).alias("_sets"))
    parts = stash(parts.select("term", "chunk", F.col("_sets.number").alias("sets"), F.col("_sets.needed").alias("needed")), "sets-of-terms")
    coded = stash(parts.select("term").distinct().mapInArrow(_of_terms, "term string, size int, code long"), "terms")
    # a trigram that no text has leaves its term without candidates
    ranked = coded.where("size = 3").join(index.counts, F.col("code") == F.col("trigram"), "left").groupBy("term").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code"))), 1, RAREST).alias("_best"))
    of_trigram = ranked.select("term", F.explode("_best.code").alias("trigram")).groupBy("trigram").agg(F.array_join(F.collect_list("term"), " ").alias("terms"))
    # a term of one or two characters begins some trigram wherever it occurs
    wanted = index.counts.select("trigram").join(of_trigram, "trigram", "left")
    for size, begins in ((1, "one"), (2, "two")):
        short = coded.where(F.col("size") == size).select("code", F.lit(True).alias("_begins"))
        wanted = wanted.join(short, F.shiftright("trigram", 63 - 21 * size) == F.col("code"), "left").withColumn(begins, F.coalesce("_begins", F.lit(False))).drop("code", "_begins")
    wanted = stash(wanted.where("terms is not null or one or two"), "sought")
    found = index.postings.join(wanted, "trigram").select("trigram", "block", "ids", "terms", "one", "two").mapInArrow(_sought, "block long, gram long, terms string, places binary")
    # a text is read once, after the lists of its block
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    lists = found.select("*", *none("long", "id"), *none("string", "text"))
    texts = _folded(index.texts, index.key, index.text).select(F.shiftright("id", BITS).alias("block"), *none("long", "gram"), *none("string", "terms"), *none("binary", "places"), "id", "text")
    met = lists.union(texts).repartition("block").sortWithinPartitions("block", F.col("gram").desc_nulls_last())
    had = met.mapInArrow(_verified, "term string, block long, places binary")
    # what the lists of all terms of a set share
    dealt = had.join(parts, "term").select("block", "chunk", "places", "sets", "needed").repartition("block", "chunk").sortWithinPartitions("block", "chunk")
    answers = dealt.mapInArrow(_answered, "number long, block long, ids array<smallint>")
    kind = index.texts.schema[index.key].dataType
    of = asked.join(sets.select("set", "number"), "set").select("query", "number")
    rows = answers.join(of, "number").select("query", "block", F.explode("ids").alias("at")).select("query", (F.shiftleft("block", BITS) + F.col("at")).cast(kind).alias("id"))
    every = [r["query"] for r in asked.where("size(terms) = 0").select("query").collect()]
    if every:
        rows = rows.union(index.texts.where(F.col(index.text).isNotNull()).select(F.explode(F.array(*map(F.lit, every))).alias("query"), F.col(index.key).alias("id")))
    return rows.select(F.col("query").alias(query_id), F.col("id").alias(index.key))
