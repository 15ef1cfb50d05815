"""Document fingerprints by I-Match, with DataFrame operations only.

A text's terms are its distinct words (runs of letters and digits, lower case), as 64-bit hashes.
Document frequencies are counted over all texts, term by term. The lexicon holds the terms whose
inverse document frequency lies in a band: in no more than ``COMMON`` of all texts and in no fewer
than ``RARE`` of them (two at least). So it has at most (mean distinct terms of a text) / ``RARE``
terms, however large the corpus: a quarter of a million for texts of 250 terms. It goes to the
tasks as a constant of bits, one for each place of a hash that a term of the band holds: eight
places a term or more, 2**``BITS`` at least. A term outside the band is let in where it shares a
place with one of the band, so one in eight at most, and the same term is in or out for all texts.

Randomised lexicon subsets, fixed and overlapping: level j parts all terms by a hash into 2**j
subsets, of which the first 2**BASE count, for every j from ``BASE`` up. So the first level covers all
terms, and each further one half of those before it. In each subset the text's lexicon terms are
sorted and hashed together; a fingerprint has the 64-bit hash of all its terms in order, and these
hashes at all levels where the text has terms: 2**BASE a level at most, as many levels as the text's
size has binary digits. A text that keeps fewer than twice ``FEW`` terms has its other terms hashed
too, apart; one without words stands for itself. Two fingerprints are compared at the level where
a subset holds about half a term of the text with more terms, so that a change in some terms leaves
the hashes of the other subsets. Their likeness is the share of equal hashes among the subsets where
either has terms: of lexicon terms, or of all where one keeps fewer than ``FEW`` and both have all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace

COMMON, RARE = 0.05, 1e-3
BITS = 21
BASE, TOP = 6, 40
FEW = 24


def terms(text: Column) -> Column:
    """The distinct hashed words of a text."""
    words = F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def frequent(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) of the terms in the band, by their exact number of texts, over all rows."""
    every = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    n = docs.count()
    seen = every.groupBy("term").agg(F.count("*").alias("df"))
    return seen.where(F.col("df").between(max(2, int(n * RARE)), max(2, int(n * COMMON))))


def lexicon(band: DataFrame) -> Column:
    """The places of terms as a literal array of bits, 64 in each element: a power of two, eight a term or more."""
    band = Workspace(band.sparkSession, "imatch").stash(band.select("term"), "band")
    width = max(BITS, math.ceil(math.log2(8 * max(1, band.count()))))
    slots = band.select(F.shiftrightunsigned("term", 64 - width).cast("int").alias("slot"))
    found = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    bits = [0] * (1 << (width - 6))
    for word, some in found.collect():  # a row for each element at most
        bits[word] = some
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded to a constant


def in_lexicon(term: Column, bits: Column) -> Column:
    """Whether a term's place is taken; the width of a place follows from the number of elements."""
    slot = F.call_function("shiftrightunsigned", term, 58 - F.round(F.log2(F.size(bits).cast("double"))).cast("int")).cast("int")
    return F.getbit(F.get(bits, F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))) == 1


def fingerprint(text: Column, bits: Column) -> Column:
    """Of a text: the numbers of lexicon terms and of all, the hash of all, and the hashes of lexicon terms and of the rest by subset."""
    # each step binds its input to a name, so that it is computed once
    every = _let(terms(text), lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.xxhash64(text))))
    own = _let(every, lambda t: F.struct(t.alias("every"), F.filter(t, lambda x: in_lexicon(x, bits)).alias("kept")))
    none = F.array().cast("array<bigint>")

    def shaped(s: Column) -> Column:
        rest = F.when(F.size(s["kept"]) < 2 * FEW, _hashes(F.array_except(s["every"], s["kept"]), 1)).otherwise(none)
        return F.struct(F.size(s["kept"]).alias("n_kept"), F.size(s["every"]).alias("n"), F.xxhash64(F.array_sort(s["every"])).alias("whole"), _hashes(s["kept"], 0).alias("kept"), rest.alias("rest"))

    return _let(own, shaped)


def _places(term: Column, kind: int) -> Column:
    """For each level that has a term its subset (level, number, kind) and, below, 48 bits of the term, as one number."""
    place = F.shiftrightunsigned(term, 64 - TOP)
    # a level has a term if the bits of its place from BASE up to the level are zero
    high = F.shiftrightunsigned(place, BASE)
    deepest = F.when(high == 0, F.lit(TOP)).otherwise(BASE + F.round(F.log2(high.bitwiseAND(-high).cast("double"))).cast("int"))
    low = F.shiftleft(F.shiftleft(place.bitwiseAND(F.lit((1 << BASE) - 1)), 1) + kind, 48).bitwiseOR(term.bitwiseAND(F.lit((1 << 48) - 1)))
    return F.transform(F.sequence(F.lit(BASE), deepest), lambda j: F.shiftleft(j.cast("long"), BASE + 49).bitwiseOR(low))


def _hashes(terms_: Column, kind: int) -> Column:
    """For each subset with terms its level, number and kind, in the high half, and the hash of its terms in order."""
    def runs(rows: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (F.shiftright(F.get(rows, i), 48) != F.shiftright(F.get(rows, i - 1), 48)))
        return _let(at, lambda starts: F.transform(starts, lambda i, k: hashed(rows, i, F.coalesce(F.get(starts, k + 1), F.size(rows)))))

    def hashed(rows: Column, start: Column, end: Column) -> Column:
        subset = F.shiftright(F.get(rows, start), 48)
        return F.shiftleft(subset, 32).bitwiseOR(F.hash(F.slice(rows, start + 1, end - start)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))

    placed = F.sort_array(F.flatten(F.transform(terms_, lambda t: _places(t, kind))))
    return _let(placed, lambda rows: F.when(F.size(rows) > 0, runs(rows)).otherwise(F.slice(rows, 1, 0)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def rendered(print_: Column) -> Column:
    """A fingerprint as a string: the numbers of kept and of all terms, the hash of all, then each subset and hash, in hexadecimal, of kept ones and of the rest."""
    shown = lambda a: F.lower(F.array_join(F.transform(a, lambda h: F.hex(h)), "."))
    return F.concat_ws(":", print_["n_kept"].cast("string"), print_["n"].cast("string"), F.lower(F.hex(print_["whole"])), shown(print_["kept"]), shown(print_["rest"]))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among subsets where either fingerprint has terms; 1 for equal ones."""
    subsets = lambda x: F.transform(x, lambda h: F.shiftright(h, 32))

    def share(s: Column) -> Column:
        return F.size(F.array_intersect(s["x"], s["y"])) / F.greatest(F.lit(1), F.size(F.array_union(subsets(s["x"]), subsets(s["y"]))))

    def at(x: Column, level: Column) -> Column:
        return F.filter(x, lambda h: F.shiftright(h, 33 + BASE) == level)

    few = (F.least(a["n_kept"], b["n_kept"]) < FEW) & (F.greatest(a["n_kept"], b["n_kept"]) < 2 * FEW)
    most = F.when(few, F.greatest(a["n"], b["n"])).otherwise(F.greatest(a["n_kept"], b["n_kept"]))
    level = F.greatest(F.lit(BASE), F.ceil(F.log2(most.cast("double"))).cast("int") + 1)
    hashes = lambda x: F.when(few, F.concat(x["kept"], x["rest"])).otherwise(x["kept"])
    compared = F.struct(level.alias("l"), hashes(a).alias("x"), hashes(b).alias("y"))
    chosen = _let(compared, lambda s: F.struct(at(s["x"], s["l"]).alias("x"), at(s["y"], s["l"]).alias("y")))
    return F.when(a == b, F.lit(1.0)).otherwise(_let(chosen, share))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``fingerprint`` (a string) of each row; equal texts have equal ones, null is empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select(F.col("id").alias(id_col), _let(fingerprint(F.col("text"), lexicon(frequent(rows))), rendered).alias("fingerprint"))


KEY = ["f", "k", "h"]


def following(keys: DataFrame, space: Workspace) -> DataFrame:
    """For distinct rows (f, k, h, n), by descending f, k and h: the row before (pf, pk, ph, pn), the first's being the last.

    Rows are ranged by key and written with their range's number; only the edge rows of each range
    meet in one task.
    """
    order = [F.desc(c) for c in KEY]
    ranged = space.stash(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("part").orderBy(*order)
    row = F.struct(*KEY, "n")
    ranged = ranged.withColumn("row", row).withColumn("before", F.lag("row").over(own))
    edges = ranged.groupBy("part").agg(F.max("row").alias("first"), F.min("row").alias("last"))
    around = Window.orderBy("part")  # one row for each partition
    edges = edges.select("first", F.coalesce(F.lag("last").over(around), F.last("last").over(around.rowsBetween(0, Window.unboundedFollowing))).alias("edge"))
    joined = ranged.join(edges.select(*(F.col("first")[c].alias(c) for c in KEY), "edge"), KEY, "left")
    before = F.coalesce("before", "edge")
    return joined.select(*KEY, *(before[c].alias(f"p{c}") for c in (*KEY, "n")))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document.

    The next document is that of the next lower id (after the lowest: the highest). The edited
    text has its last third of code points replaced by as many of the next document's first, or
    all. Null texts are empty; a null id comes after all others. Rows that share an id follow each
    other by the hash of their texts, and rows that repeat id and text are one document, each with
    its row. A single document is its own next. An empty table gives an empty one; no column but
    the named is read; very long texts are read whole.
    """
    space = Workspace(docs.sparkSession, "imatch")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = lexicon(frequent(rows))
    rows = rows.select(F.col("doc_id").isNotNull().cast("int").alias("f"), F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text").alias("h"), "text")
    order = space.stash(following(rows.select(*KEY, F.length("text").cast("long").alias("n")).distinct(), space), "order")
    # both joins read one exchange of the texts
    start = rows.join(order, KEY).select(*(F.col(f"p{c}").alias(c) for c in KEY), F.expr("left(text, cast(pn div 3 as int))").alias("start"), fingerprint(F.col("text"), bits).alias("next_print"))
    start = start.dropDuplicates(KEY)
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(length(text) div 3 as int))"), F.col("start"))
    both = rows.join(start, KEY).select("f", "k", n.cast("long").alias("n_chars"), "text", "next_print", edited.alias("edited"))
    prints = F.struct(fingerprint(F.col("text"), bits).alias("own"), fingerprint(F.col("edited"), bits).alias("edited"), F.col("next_print").alias("next"))

    def compared(p: Column) -> Column:
        return F.struct(rendered(p["own"]).alias("own"), rendered(p["edited"]).alias("edited"), likeness(p["own"], p["edited"]).alias("near_edited"), likeness(p["own"], p["next"]).alias("near_next"))

    both = both.select(F.when(F.col("f") == 1, F.col("k")).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), _let(prints, compared).alias("p"))
    return both.select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", F.col("p.own").alias("fingerprint"), F.col("p.edited").alias("edited_fingerprint"), "p.near_edited", "p.near_next")
