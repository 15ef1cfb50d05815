"""A quality classifier by importance resampling.

Two generative models of hashed n-grams, one of the target (texts labelled good) and one of the
raw corpus, give each text its weight: the sum of the logarithms of their ratio. The n-grams: words
and pairs of words, and the shapes of one to three neighbouring words (kinds of characters, runs as
one, and whether the word repeats the one before). A text's key is its weight over ``TEMPERATURE``
plus Gumbel noise; the k texts of the largest keys are a sample without replacement by weight, and
they are what the classifier selects. k is how many texts' weights reach a cut that is set on
labelled rows which the target model hasn't seen: so the sample has as many texts as there are good
ones, and near the cut chance decides, the more so the less a text's weight tells.

Raw counts, weights and k are taken over every text, and of all of it; very long texts are read in
pieces. The target model and the cut use at most ``SAMPLE`` labelled ids, those of the least hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace, parts, slices, trim, utf8
from folioscope.llm.words import NOT_SPACE, grams, mix, word_hashes

SAMPLE = 20_000
WORD_BITS, SHAPE_BITS = 14, 12
TEMPERATURE = 1.0
SMOOTHING = 1.0
_BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
_AGAIN = np.uint64(0x2545F4914F6CDD1D)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For runs of rows: buckets of words and their rows, buckets of shapes and theirs, and the number of rows."""
    data, offsets = utf8(column)
    for (first, last, words, at), (_, _, shapes, _) in zip(word_hashes(data, offsets, NOT_SPACE), word_hashes(data, offsets, NOT_SPACE, "shape"), strict=True):
        row = np.repeat(np.arange(last - first), np.diff(at))
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        shapes = mix(shapes + np.where(again, _AGAIN, np.uint64(0)))
        found: list[list[np.ndarray]] = [[], [], [], []]
        for kind, hashes, bits, sizes in ((0, words, WORD_BITS, (1, 2)), (2, shapes, SHAPE_BITS, (1, 2, 3))):
            for k in sizes:
                got = grams(hashes, k)
                inside = row[k - 1 :] == row[: len(row) - k + 1]
                found[kind].append((got[inside] >> np.uint64(64 - bits)).astype(np.int64))
                found[kind + 1].append(row[: len(got)][inside])
        yield *(np.concatenate(x) for x in found), last - first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets over a task's texts: (bucket, of all, of the target's)."""
    total, target = np.zeros(_BUCKETS, np.int64), np.zeros(_BUCKETS, np.int64)
    for batch in slices(batches, 0):
        chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        done = 0
        for words, word_row, shapes, shape_row, n in features(batch.column(0)):
            bucket = np.concatenate([words, shapes + (1 << WORD_BITS)])
            total += np.bincount(bucket, minlength=_BUCKETS)
            mine = chosen[done : done + n]
            if mine.any():
                target += np.bincount(bucket[np.concatenate([mine[word_row], mine[shape_row]])], minlength=_BUCKETS)
            done += n
        trim()
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some]), pa.array(target[some])], ["bucket", "total", "target"])


def log_ratios(total: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log of target over raw probability of each bucket, words and shapes each their own law."""
    out = []
    for part in (slice(0, 1 << WORD_BITS), slice(1 << WORD_BITS, _BUCKETS)):
        t, r = target[part] + SMOOTHING * total[part] / max(1, total[part].sum()) * 1000, total[part].astype(float)
        t, r = t / max(t.sum(), 1e-300), r / max(r.sum(), 1.0)
        out.append(np.where(r > 0, np.log(np.maximum(t, 1e-300) / np.maximum(r, 1e-300)), 0.0) if target.any() else np.zeros(len(r)))
    return np.concatenate(out)


def weights(ratio: np.ndarray, column: pa.Array) -> np.ndarray:
    """The weight of each text, the sum of its buckets' log ratios; not a number where it has no words."""
    out = []
    for words, word_row, shapes, shape_row, n in features(column):
        total = np.bincount(word_row, ratio[words], n) + np.bincount(shape_row, ratio[shapes + (1 << WORD_BITS)], n)
        total[np.bincount(word_row, minlength=n) == 0] = np.nan
        out.append(total)
    return np.concatenate(out) if out else np.zeros(0)


def gumbel(seed: int, *columns: Column) -> Column:
    """Gumbel noise by a hash, the same for the same values and seed."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def kth(keys: DataFrame, k: int, key: str = "key") -> float:
    """The k-th largest key (infinite for none, minus infinite where there are no more than k).

    A quantile sketch brackets it; only keys inside the bracket (about one in 2,500) are ordered.
    """
    keys = keys.select(key).where(F.col(key).isNotNull())
    n = keys.count()
    if k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    share = 1 - k / n
    low, high = keys.agg(F.percentile_approx(key, [max(0.0, share - 2e-4), min(1.0, share + 2e-4)], 100_000)).first()[0]
    above = keys.where(F.col(key) > high).count()
    inside = keys.where(F.col(key).between(low, high))
    return inside.orderBy(F.desc(key)).offset(k - above - 1).limit(1).first()[0]


def top_k(keys: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The rows of the k largest keys; rows that tie with the k-th come too, and null keys never do."""
    return keys.where(F.col(key) >= F.lit(kth(keys, k, key)))


def cut(good: np.ndarray, bad: np.ndarray, leniency: float = 0.005) -> float:
    """The weight from which texts count as good.

    The edge between labelled weights that tells good from bad best (mean share of each told right)
    is best for both; of all edges within ``leniency`` of it, the least is taken, since losing a
    good text costs more than keeping a bad one.
    """
    if not len(bad) or not len(good):
        return -math.inf
    keys = np.unique(np.concatenate([good, bad]))
    edges = np.concatenate([[keys[0] - 1], (keys[1:] + keys[:-1]) / 2, [keys[-1] + 1]])
    right = 1 - np.searchsorted(np.sort(good), edges) / len(good) + np.searchsorted(np.sort(bad), edges) / len(bad)
    return float(edges[np.flatnonzero(right / 2 >= right.max() / 2 - leniency)[0]])


class Classifier:
    """The log ratio of each bucket, and the weight from which a text counts towards k."""

    def __init__(self, shared, edge: float, seed: int):
        self.shared, self.edge, self.seed = shared, edge, seed

    def weight(self, text: Column) -> Column:
        """The weight of a text; null where it has no words."""
        shared = self.shared

        def weigh(column: pa.Array) -> pa.Array:
            w = np.concatenate([weights(shared.value, column.slice(start, n)) for start, n in parts(column)])
            trim()
            return pa.array(w, pa.float64(), mask=np.isnan(w))

        return F.arrow_udf(weigh, "double")(text)

    def key(self, weight: Column, id_col: Column, text: Column) -> Column:
        return weight / TEMPERATURE + gumbel(self.seed, id_col, text)

    def least_key(self, scored: DataFrame) -> float:
        """For rows (log_weight, gumbel_key) the key from which ``top_k`` takes them."""
        return kth(scored, scored.where(F.col("log_weight") >= F.lit(self.edge)).count(), "gumbel_key")

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, seed: int) -> Classifier:
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
        known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
        held = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 0
        known = Workspace(spark, "quality").stash(known.withColumn("held", held), "known")
        good = F.broadcast(known.where("label = 1 and not held").select("doc_id", F.lit(True).alias("chosen")))  # at most `sample` rows
        counted = rows.join(good, "doc_id", "left").select("text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
        counts = counted.mapInArrow(_counted, "bucket int, total long, target long").groupBy("bucket").agg(F.sum("total"), F.sum("target")).collect()
        total, target = np.zeros(_BUCKETS, np.int64), np.zeros(_BUCKETS, np.int64)
        for bucket, t, g in counts:  # one row for each bucket at most
            total[bucket], target[bucket] = t, g
        own = cls(spark.sparkContext.broadcast(log_ratios(total, target)), -math.inf, seed)  # one number for each bucket
        told = rows.join(F.broadcast(known.where("held")), "doc_id")  # at most `sample` rows
        # an id with several texts tells by the one of least hash
        told = told.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        told = told.select(own.weight(F.col("text")).alias("weight"), "label").collect()
        told = {y: np.array(sorted(r["weight"] for r in told if r["weight"] is not None and (r["label"] == 1) == y)) for y in (True, False)}
        own.edge = cut(told[True], told[False])
        return own


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """One row for each row of ``docs``: its id, ``log_weight``, ``gumbel_key``, ``selected``.

    A text that is null or has no words has a null weight and is not selected. Where no bad row or
    no good row is labelled, all texts with words are selected. Labels that are null, or whose id
    no text has, teach nothing; an id labelled twice counts as its least label. A null id takes
    part with the noise of its seed. Rows that repeat an id and a text have one key and go the same
    way. An empty table gives an empty one; no column but the named is read.
    """
    own = Classifier.fit(docs, labels, id_col, text_col, label_col, sample, seed)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), own.weight(F.col(text_col)).alias("log_weight"), F.col(text_col).alias("_text"))
    rows = rows.select(id_col, "log_weight", own.key(F.col("log_weight"), F.col(id_col), F.col("_text")).alias("gumbel_key"))
    rows = Workspace(docs.sparkSession, "quality").stash(rows, "keys")
    return rows.withColumn("selected", F.coalesce(F.col("gumbel_key") >= F.lit(own.least_key(rows)), F.lit(False)))


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, whole, that ``classify`` selects: no text is shuffled.

    A first pass writes the keys, from which the least key of the sample follows; a second one
    finds each row's key again. Defined for nulls, empty and repeated rows as ``classify`` is.
    """
    own = Classifier.fit(docs, labels, id_col, text_col, label_col, sample, seed)
    text = F.col(text_col)
    key = lambda weight: own.key(weight, F.col(id_col).cast("long"), text)
    packed = docs.select(own.weight(text).alias("log_weight"), F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    keys = packed.select("log_weight", own.key(F.col("log_weight"), F.col("_id"), F.col("_text")).alias("gumbel_key"))
    least = own.least_key(Workspace(docs.sparkSession, "quality").stash(keys, "keys"))
    return docs.where(F.coalesce(key(own.weight(text)) >= F.lit(least), F.lit(False)))
