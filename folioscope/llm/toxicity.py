"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct terms (runs of ASCII letters and digits and of characters
beyond ASCII, capitals folded), hashed to ``BITS`` bits. All terms of the labelled texts take part,
each by its evidence: a term whose G statistic of presence and label is g counts g / (g + ``HALF``),
so that terms which few texts show are hardly learned by heart. The machine adds to linear weights
the products of all pairs of terms, through ``FACTORS`` latent numbers a term, so that two terms can
weigh together what neither weighs alone. It learns by AdaGrad on the logistic loss. One labelled
row in ``CALIBRATION`` is kept from the fit and sets the score's slope and offset.

The fit uses at most ``SAMPLE`` labelled ids, those of the least hash, and of them no more than have
``TERMS`` terms in all: what the driver holds is bounded by that. A row counts with all terms of its
text; evidence is counted in Spark. Scores are of every whole text; very long ones are read in
pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace, slices, trim, utf8
from folioscope.llm.words import ALNUM, word_hashes

SAMPLE = 20_000
BITS, FACTORS = 20, 4
#: Terms of all rows of the sample together.
TERMS = 20_000_000
#: The G statistic at which a term counts half.
HALF = 15.0
EPOCHS, BATCH, RATE, L2 = 30, 512, 0.2, 1e-4
CALIBRATION = 5


def terms(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct hashed terms of each text."""
    data, offsets = utf8(column)
    for first, last, hashes, at in word_hashes(data, offsets, ALNUM, "folded"):
        bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
        for i in range(last - first):
            yield np.unique(bucket[at[i] : at[i + 1]])


def evidence(rows: DataFrame, yes: int, no: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (toxic, terms), ``yes`` of them toxic and ``no`` not, each term with the G statistic of its 2 by 2 table.

    Counted in Spark; there are no more terms than 2**``BITS``.
    """
    seen = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("y"), F.count_if(F.col("toxic") == 0).alias("n"))
    share = (F.col("y") + F.col("n")) / F.lit(float(yes + no))

    def part(count: Column, expected: Column) -> Column:
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    absent = 1 - share
    g = 2 * (part(F.col("y"), share * yes) + part(F.col("n"), share * no) + part(yes - F.col("y"), absent * yes) + part(no - F.col("n"), absent * no))
    got = seen.select("term", F.greatest(F.round(g, 9), F.lit(0.0)).alias("g")).toArrow().sort_by("term")
    return got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy().astype(float)


class Machine:
    """y(x) = bias + sum of w_i + sum over pairs of <v_i, v_j>, for the terms i of a text.

    While it learns, w_i and v_i are taken times the term's ``scale``; ``fit`` leaves the products.
    """

    def __init__(self, chosen: np.ndarray, seed: int = 5, scale: np.ndarray | None = None):
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0
        self.w = np.zeros(len(chosen))
        self.scale = np.ones(len(chosen)) if scale is None else scale
        self.v = np.random.default_rng(seed).normal(0, 0.01, (len(chosen), FACTORS))

    def chosen(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Of each text's terms, the places of those that the machine knows."""
        return [p[p >= 0] for p in (self.place[t] for t in texts)]

    def raw(self, flat: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The value of each of n texts, and the sums of their factors."""
        x = None if self.scale is None else self.scale[flat]
        y = self.bias + np.bincount(row, self.w[flat] if x is None else self.w[flat] * x, n)
        sums = np.zeros((n, FACTORS))
        for f in range(FACTORS):
            v = self.v[flat, f] if x is None else self.v[flat, f] * x
            sums[:, f] = np.bincount(row, v, n)
            y += 0.5 * (sums[:, f] ** 2 - np.bincount(row, v * v, n))
        return y, sums

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> None:
        """AdaGrad over batches; ``texts`` are places, as ``chosen`` gives them."""
        rng = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8), 1e-8
        rate = labels.mean()
        self.bias = float(np.log(rate / (1 - rate)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                mine = order[k : k + BATCH]
                flat = np.concatenate([texts[i] for i in mine])
                row = np.repeat(np.arange(len(mine)), [len(texts[i]) for i in mine])
                y, sums = self.raw(flat, row, len(mine))
                error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[mine]) / len(mine)
                met, place = np.unique(flat, return_inverse=True)
                x = self.scale[met]
                each = error[row] * x[place]
                gradient = np.bincount(place, each, len(met)) + L2 * self.w[met]
                seen_w[met] += gradient**2
                self.w[met] -= RATE * x / np.sqrt(seen_w[met]) * gradient
                for f in range(FACTORS):
                    v = self.v[met, f]
                    gradient = np.bincount(place, each * (sums[row, f] - (v * x)[place]), len(met)) + L2 * v
                    seen_v[met, f] += gradient**2
                    self.v[met, f] = v - 0.3 * RATE * x / np.sqrt(seen_v[met, f]) * gradient
                seen_b += error.sum() ** 2
                self.bias -= RATE / np.sqrt(seen_b) * error.sum()
        self.w, self.v, self.scale = self.w * self.scale, self.v * self.scale[:, None], None

    def calibrate(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Puts 0.5 where most of both labels are told right, and a slope by the spread around it."""
        y = np.array([self.raw(t, np.zeros(len(t), np.int64), 1)[0][0] for t in texts])
        if labels.min() == labels.max():
            return
        keys = np.unique(y)
        edges = np.concatenate([[keys[0] - 1], (keys[1:] + keys[:-1]) / 2, [keys[-1] + 1]])
        good, bad = np.sort(y[labels == 0]), np.sort(y[labels == 1])
        wrong = (len(good) - np.searchsorted(good, edges)) + np.searchsorted(bad, edges)
        best = np.flatnonzero(wrong == wrong.min())
        self.offset = float(edges[best].mean())
        self.slope = float(2 / max(1e-6, np.median(np.abs(y - self.offset))))

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of texts given by their terms."""
        texts, n = self.chosen(texts), len(texts)
        flat = np.concatenate(texts) if n else np.zeros(0, np.int16)
        row = np.repeat(np.arange(n), [len(t) for t in texts])
        y, _ = self.raw(flat, row, n)
        return 1 / (1 + np.exp(-np.clip(self.slope * (y - self.offset), -30, 30)))


def _termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, t in enumerate(terms(batch.column(3))):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), pa.array([t], pa.list_(pa.int32()))], ["toxic", "held", "luck", "terms"])


def _scored(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        got, texts = [], []
        for t in terms(batch.column(1)):
            texts.append(t)
            if len(texts) == 1024:
                got.append(shared.value.scores(texts))
                texts = []
        got.append(shared.value.scores(texts))
        trim()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got))], ["doc_id", "score"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5, most_terms: int = TERMS) -> Machine:
    """A machine fitted to a bounded sample of labelled rows of ``docs`` (doc_id, text).

    An id with several texts teaches by the one of least hash.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    known = labels.dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    known = space.stash(known.withColumn("held", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(CALIBRATION)) == 0).withColumn("luck", F.xxhash64(F.lit(seed), "doc_id")), "known")
    rows = docs.join(F.broadcast(known), "doc_id")  # at most `sample` rows
    rows = rows.groupBy("doc_id", "toxic", "held", "luck").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = space.stash(rows.select("toxic", "held", "luck", "text").mapInArrow(_termed, "toxic int, held boolean, luck long, terms array<int>"), "terms")
    n_rows, n_terms = rows.agg(F.count("*"), F.sum(F.size("terms"))).first()
    if (n_terms or 0) > most_terms:
        rows = space.stash(rows.orderBy("luck", "terms").limit(n_rows * most_terms // n_terms), "fewer")
    counts = {(r["held"], r["toxic"] == 1): r["count"] for r in rows.groupBy("held", "toxic").count().collect()}
    total = lambda toxic, *held: sum(counts.get((h, toxic), 0) for h in held)
    if not total(True, False, True) or not total(False, False, True):
        own = Machine(np.zeros(0, np.int64), seed)
        own.offset = -1.0 if counts and total(True, False, True) else 1.0
        return own
    both = total(True, False) > 0 and total(False, False) > 0  # else the part kept for calibration teaches too
    yes, no = (total(y, False) if both else total(y, False, True) for y in (True, False))
    known, g = evidence(rows.where("not held") if both else rows, yes, no)
    got = rows.select("toxic", "held", "terms").toArrow()  # at most `sample` rows, with `most_terms` terms
    toxic, held = got.column(0).to_numpy().astype(float), got.column(1).to_numpy().astype(bool)
    own = Machine(known, seed, g / (g + HALF))
    texts = own.chosen([x for chunk in got.column(2).chunks for x in np.split(chunk.flatten().to_numpy(), np.cumsum(pc.list_value_length(chunk).to_numpy())[:-1])])
    order = sorted(range(len(texts)), key=lambda i: (toxic[i], held[i], len(texts[i]), texts[i].tobytes()))
    texts, toxic, held = [texts[i] for i in order], toxic[order], held[order]
    fit = ~held if both else np.ones(len(held), bool)
    own.fit([t for t, f in zip(texts, fit, strict=True) if f], toxic[fit], seed)
    test = held if held.any() else fit
    own.calibrate([t for t, h in zip(texts, test, strict=True) if h], toxic[test])
    own.w, own.v = own.w.astype(np.float32), own.v.astype(np.float32)
    return own


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, sample: int = SAMPLE, most_terms: int = TERMS) -> DataFrame:
    """One row for each row of ``docs``: its id, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Rows whose crc32 of the id as text is 0 modulo ``folds`` are held out: their labels teach
    nothing. Null and empty texts have no terms and get the score of the bias alone. A null id is
    not held out and has no label; an id labelled twice counts as toxic if either says so. Without
    any toxic (or any other) label every text gets one score, below (above) one half. An empty table
    gives an empty one; repeated rows get equal scores; no column but the named is read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    shared = spark.sparkContext.broadcast(train(rows, known.where(~held), sample, most_terms=most_terms))  # a fixed number of weights
    out = rows.mapInArrow(functools.partial(_scored, shared), "doc_id long, score double")
    return out.select(F.col("doc_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
