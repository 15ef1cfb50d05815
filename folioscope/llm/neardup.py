"""Near duplicates: universal hash minima, banding, signature verification, exact confirmation.

A text's set is its distinct shingles of five words. Texts with equal sets (by 128 bits) become one
node, so that a group of copies of any size costs one. ``HASHES`` minima of universal hash
functions describe a node; nodes that agree in all rows of a band of the first ones share a bucket.
The number of bands follows the asked similarity, so that two sets that just reach it share no
bucket with a probability of at most ``MISSED`` (32 bands of 5 at 0.85, 47 at 0.80). A node's
signature is the low byte of each minimum.

In each bucket every node is held against one only, the one that shares its buckets with the most
others: in a group of edited copies that is the text they were made from. Links join nodes into
components. Where a bucket still holds several components, the nodes outside its largest one are
held against all of the bucket, in blocks of ``BLOCK`` that are one row each, by signature, inside a
task: only pairs from different components, not tried before, whose signatures agree well enough
leave it. So a bucket of linked copies costs as many pairs as it has nodes, n copies and m
strangers n * m comparisons but n / ``BLOCK`` * m / ``BLOCK`` rows, and no cap drops any. What passes
by signature is confirmed on the full sets, word by word, and components come from alternating
large-star and small-star.

Very long texts are read in pieces, one set at a time. Empty tables give empty tables; only the two
named columns are read, whatever else is there.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace, slices, trim, utf8
from folioscope.llm.components import components
from folioscope.llm.words import NOT_SPACE, grams, mix, word_hashes

WORDS = 5
SPACES = re.compile(r"[\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MOST_ROWS = 5
HASHES = 512
BLOCK = 512
#: Two sets that just reach the asked similarity share no bucket with this probability at most: the
#: first for which ``HASHES`` minima suffice (from 4 percent on that is the first).
MISSED = (1e-8, 1e-6)
#: Of the minima, so many deviations fewer than expected may agree before full sets are compared.
DEVIATIONS = 5.5


class Plan(NamedTuple):
    """What follows from the asked similarity."""

    percent: int
    bands: int
    rows: int
    least_agreeing: float


def plan_for(percent: int) -> Plan:
    """The bands with the most rows that miss few enough pairs within ``HASHES``, and the least share of equal minima."""
    alike = percent / 100
    if not 0 < alike <= 1:
        raise ValueError(f"percent must be over 0 and at most 100, not {percent}")
    for missed in MISSED:
        for rows in range(MOST_ROWS, 0, -1):
            bands = math.ceil(math.log(missed) / math.log1p(-(alike**rows))) if alike < 1 else 1
            if bands * rows <= HASHES:
                return Plan(percent, bands, rows, alike - DEVIATIONS * math.sqrt(alike * (1 - alike) / HASHES))
    raise ValueError(f"{HASHES} minima are too few for {percent} percent")


_rng = (mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
FACTOR, ADD = _rng[:HASHES] | np.uint32(1), _rng[HASHES:]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of one text, sorted; fewer words than a shingle has make one."""
    if not len(words):
        return words
    return np.unique(grams(words, min(WORDS, len(words))))


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for first, last, hashes, at in word_hashes(data, offsets, NOT_SPACE):
        for i in range(last - first):
            yield shingle_set(hashes[at[i] : at[i + 1]])


def minima(items: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(items), 4096):
        x = short[k : k + 4096]
        for j in range(0, HASHES, 32):
            h = FACTOR[j : j + 32, None] * x
            h += ADD[j : j + 32, None]
            np.minimum(least[j : j + 32], h.min(axis=1), out=least[j : j + 32])
    return least


def band_keys(least: np.ndarray, plan: Plan) -> np.ndarray:
    """A 64-bit key for each band of one node's minima."""
    rows = least[: plan.bands * plan.rows].reshape(plan.bands, plan.rows).astype(np.uint64)
    key = np.arange(1, plan.bands + 1, dtype=np.uint64)
    for r in range(plan.rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def _signed(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        n, ones, twos, sig, keys = [], [], [], [], []
        for items in sets_of(batch.column(2)):
            n.append(len(items))
            if len(items):
                one, two = struct.unpack("<qq", hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                least = minima(items)
                sig.append(least.astype(np.uint8).tobytes())
                keys.append(band_keys(least, plan).tobytes())
            else:
                one = two = None
                sig.append(None)
                keys.append(None)
            ones.append(one)
            twos.append(two)
        columns = [pa.array(n, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "n_shingles", "one", "two", "sig", "keys"])
        del columns, n, ones, twos, sig, keys
        trim()


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    data, offsets = utf8(column)
    return data[offsets[0] : offsets[-1]].view(kind).reshape(-1, width)


def _buckets(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            keys = _matrix(batch.column(1), np.int64, plan.bands)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), plan.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["bucket", "node"])


def _agreeing(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (u, v, signatures), those whose signatures agree well enough."""
    for batch in batches:
        if len(batch):
            same = (_matrix(batch.column(2), np.uint8, HASHES) == _matrix(batch.column(3), np.uint8, HASHES)).mean(axis=1)
            yield batch.select([0, 1]).filter(pa.array(same >= plan.least_agreeing))


def spelled(text: str) -> set[tuple[str, ...]]:
    """A text's shingles by their words."""
    words = SPACES.split(text.translate(SMALL))
    words = words[not words[0] : len(words) - (not words[-1])]
    n = min(WORDS, len(words))
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if n else set()


def alike(percent: int, a: set | np.ndarray, b: set | np.ndarray, both: int) -> bool:
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (u, v, texts), those with 100 * intersection >= percent * union: by hashes, then by words."""
    kept: tuple[str | None, np.ndarray, set | None] = (None, np.zeros(0), None)
    for batch in batches:
        ok = []
        for k, b in enumerate(sets_of(batch.column(3))):
            text = batch.column(2)[k].as_py()
            if text != kept[0]:
                kept = text, next(sets_of(pa.array([text]))), None
            a = kept[1]
            passes = alike(plan.percent, a, b, len(np.intersect1d(a, b, assume_unique=True)))
            if passes:
                kept = kept if kept[2] is not None else (*kept[:2], spelled(text))
                c = spelled(batch.column(3)[k].as_py())
                passes = alike(plan.percent, kept[2], c, len(kept[2] & c))
            ok.append(passes)
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _within(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, pivot, most, block of nodes outside the largest component, block of nodes): pairs not tried before."""
    for batch in batches:
        for row in range(len(batch)):
            bucket, pivot, most = (batch.column(k)[row].as_py() for k in range(3))
            (l_node, l_label, l_sig, l_keys), (node, label, sig, keys) = (_block(batch.column(k).slice(row, 1).flatten(), plan) for k in (3, 4))
            band = int(np.flatnonzero(l_keys[0] == bucket)[0])
            us, vs = [], []
            for i in np.flatnonzero(l_node != pivot):
                # a pair that is wholly outside the largest component comes up twice
                j = np.flatnonzero((label != l_label[i]) & (node != pivot) & ((label == most) | (node > l_node[i])))
                if band:  # a pair is tried in the first bucket that it shares
                    j = j[~(keys[j, :band] == l_keys[i, :band]).any(axis=1)]
                j = j[(sig[j] == l_sig[i]).mean(axis=1) >= plan.least_agreeing]
                us.append(np.full(len(j), l_node[i], np.int64))
                vs.append(node[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])


def _block(items: pa.StructArray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    node, label, sig, keys = items.flatten()
    return node.to_numpy(), label.to_numpy(), _matrix(sig, np.uint8, HASHES), _matrix(keys, np.int64, plan.bands)


def _with(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """Pairs with the column of both nodes; joins whose large partitions Spark can split."""
    first = side.select(F.col("node").alias("u"), F.col(column).alias("a"))
    second = side.select(F.col("node").alias("v"), F.col(column).alias("b"))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked when 100 * intersection >= ``percent`` * union of their sets; a component's
    id is the least doc_id in it. A null text, or one without words, has no shingles and stands
    alone. A null id is never the least; where all are null, so is the component, and the row is
    kept. Rows that repeat an id count as texts of their own.
    """
    space, plan = Workspace(docs.sparkSession, "neardup"), plan_for(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = "doc_id long, text_hash long, n_shingles long, one long, two long, sig binary, keys binary"
    signed = space.stash(rows.mapInArrow(functools.partial(_signed, plan), schema), "signed")
    # one row for each distinct set; the numbers are written with it
    first = F.min_by(F.struct("doc_id", "text_hash", "sig", "keys"), F.coalesce("doc_id", F.lit(1 << 62)))
    nodes = signed.where("one is not null").groupBy("one", "two").agg(F.min("doc_id").alias("least"), first.alias("first"))
    nodes = space.stash(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("node", "first.keys").mapInArrow(functools.partial(_buckets, plan), "bucket long, node long")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = space.stash(buckets.join(sizes, "bucket"), "shared")
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = shared.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("top"))
    crowded = space.stash(shared.join(ranked.select("bucket", F.col("top.node").alias("pivot")), "bucket"), "crowded")
    space.drop("shared")
    inside = crowded.select("node").distinct().join(nodes, "node").select("node", "first.*")
    inside = inside.select("node", F.col("doc_id").alias("at"), F.col("text_hash").alias("hash"), "sig", "keys")
    texts = rows.join(inside, rows["doc_id"].eqNullSafe(inside["at"]) & (rows["text_hash"] == inside["hash"]))
    texts = space.stash(texts.select("node", "text", "sig", "keys").dropDuplicates(["node"]), "texts")
    sigs = texts.select("node", "sig", "keys")
    confirmed = lambda pairs: _with(pairs, texts, "text").mapInArrow(functools.partial(_confirmed, plan), "u long, v long")

    stars = crowded.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    agreeing = _with(stars, sigs, "sig").mapInArrow(functools.partial(_agreeing, plan), "u long, v long")
    links = space.stash(confirmed(agreeing), "links-1")
    labels = components(links, space, "stars")
    labelled = crowded.where("size > 2").join(labels, "node", "left").select("bucket", "pivot", "node", F.coalesce("component", "node").alias("label"))
    labelled = space.stash(labelled, "labelled")
    tried = space.stash(block_pairs(labelled, sigs).mapInArrow(functools.partial(_within, plan), "u long, v long").distinct(), "tried")
    joined = components(links.union(confirmed(tried)), space, "all")
    least = nodes.select("node", "one", "two", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("one", "two", "component_id")
    out = signed.select("doc_id", "n_shingles", "one", "two").join(least, ["one", "two"], "left")
    component = F.when(F.col("one").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def block_pairs(labelled: DataFrame, sigs: DataFrame) -> DataFrame:
    """For buckets of (bucket, pivot, node, label) with several labels: blocks of nodes outside the largest label, beside blocks of all nodes.

    Rows: (bucket, pivot, most, part, whole). A bucket of n nodes, m of them outside its largest
    label, makes ceil(n / BLOCK) * ceil(m / BLOCK) rows.
    """
    tally = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = tally.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("bucket", F.col("top.label").alias("most"), blocks(F.col("n")).alias("wholes"), blocks(F.col("n") - F.col("top.n")).alias("parts"))
    held = labelled.join(mixed, "bucket").join(sigs, "node")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    listed = F.collect_list(F.struct("node", "label", "sig", "keys"))
    whole = held.groupBy("bucket", at("wholes").alias("to")).agg(listed.alias("whole"))
    part = held.where("label <> most").groupBy("bucket", "pivot", "most", "wholes", at("parts").alias("from")).agg(listed.alias("part"))
    part = part.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("wholes") - 1)))
    return part.join(whole, ["bucket", "to"]).select("bucket", "pivot", "most", "part", "whole")
