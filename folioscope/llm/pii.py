"""Personal data by candidate gradient boosting, with DataFrame operations only.

Base patterns find e-mail addresses, ip addresses, card and phone numbers; matches that fail their
check (parts up to 255, Luhn, number of digits) are dropped. Generators of high recall propose
further spans, overlapping each other and the dropped matches: spelt-out addresses as e-mail, digit
runs and groups as cards, number groups after a plus or brackets as phones, dotted quads as ips.
Boosted trees score each candidate by its format (groups, separators, plus, brackets) and context
(neighbouring characters, words before it).

The trees learn from the texts themselves. The checks are the teacher, and no feature tells what
they test, so what is learnt is in which format and context numbers are real: a candidate inside a
base span of its kind is positive; one that meets a base span of another kind, or that fails the
check of its own kind, is negative; others teach nothing, and equal texts teach once. A threshold for each kind is set on texts that the trees haven't seen; a
kind without ``LEAST_HELD`` labelled candidates there adds nothing. Candidates over it that meet no
base span are added; base spans always stay.

Equal feature values are counted together before they reach the driver, so the trees see every
text and the driver a table bounded by the number of feature combinations. Trees become SQL.

The patterns are the plain ones in a form that can't blow up: possessive, and, where a run can't
match from its middle unless from its start, tried at the start of runs or where a match ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match of a pattern has in it; texts without it aren't searched.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: For each kind, pairs of a pattern and of what every match of it has in it.
GENERATORS = {
    "email": [(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\.)[A-Za-z0-9-]{1,63})+", r"(?i)[(\[{]\x20?at\x20?[)\]}]"), (PATTERNS["email"], "@")],
    "ip": [(r"(?<![0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])", r"[0-9]\.[0-9]")],
    "card": [(r"(?<![0-9])[0-9]{16,19}(?![0-9])", "[0-9]{16}"), (r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", r"[0-9]{4}[\x20-][0-9]{4}")],
    "phone": [(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"\+[0-9]"), (r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]{3}[\\x20.-][0-9]{4}")],
}
SPAN = "struct<kind:string,start:int,end:int,s:string>"
PART = 128
ROUNDS, SHRINK, LEAST_PRECISION, LEAST_HELD = 40, 0.3, 0.95, 5
FEATURES = ("kind", "groups", "separator", "plus", "bracket", "before", "after", "word")
_WORDS = "card|visa|master|credit|phone|call|tel|fax|mobile|mail|host|server|addr"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits)))

    def part(i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(at, part), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """Whether a match of a kind's pattern passes its check."""
    if kind == "ip":
        return s.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(s))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def matches(text: Column, pattern: str, kind: str, hint: str) -> Column:
    """Leftmost non-overlapping matches as (kind, start, end, s), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")

    def placed(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        start = F.struct(F.array().cast(f"array<array<{SPAN}>>").alias("out"), none.alias("part"), F.lit(0).alias("at"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + F.length(x["p"])
            end = begin + F.length(x["m"])
            one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("s"))
            full = F.size(a["part"]) >= PART  # parts keep what is copied at each step short
            out = F.when(full, F.concat(a["out"], F.array(a["part"]))).otherwise(a["out"])
            return F.struct(out.alias("out"), F.when(full, F.array(one)).otherwise(F.concat(a["part"], F.array(one))).alias("part"), end.alias("at"))

        pairs = F.zip_with(m, F.slice(pieces, F.lit(1), F.size(m)), lambda x, p: F.struct(x.alias("m"), p.alias("p")))
        return F.when(F.size(m) > 0, F.aggregate(pairs, start, step, lambda a: F.concat(F.flatten(a["out"]), a["part"]))).otherwise(none)

    return F.when(F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint), _let(found, placed)).otherwise(none)


def based(text: Column, kind: str) -> Column:
    """All matches of a kind's base pattern, whether they pass its check or not."""
    return matches(text, PATTERNS[kind], kind, HINTS[kind])


def masked(text: Column, spans: Column) -> Column:
    """The text with every code point in a span as its kind's first letter; of spans that overlap the first counts."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.left(x["kind"], F.lit(1)).alias("letter"))))
    none = F.array().cast("array<string>")
    begin = F.struct(F.array().cast("array<array<string>>").alias("out"), none.alias("part"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        start = F.greatest(a["at"], x["start"])
        new = F.array(F.substring(text, a["at"] + 1, start - a["at"]), F.repeat(x["letter"], F.greatest(F.lit(0), x["end"] - start)))
        full = F.size(a["part"]) >= PART
        out = F.when(full, F.concat(a["out"], F.array(a["part"]))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.when(full, new).otherwise(F.concat(a["part"], new)).alias("part"), F.greatest(a["at"], x["end"]).alias("at"))

    def joined(a: Column) -> Column:
        return F.array_join(F.concat(F.flatten(a["out"]), a["part"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), "")

    return F.when(F.size(ordered) > 0, F.aggregate(ordered, begin, step, joined)).otherwise(text)


def candidates(text: Column, hidden: Column | None = None) -> Column:
    """Spans of the generators, with the features of each; in ``hidden``, where that is given."""
    spans = F.concat(*(matches(text if hidden is None else hidden, p, k, hint) for k, ps in GENERATORS.items() for p, hint in ps))

    def side(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike("^\\p{L}"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike("^\\s"), 3).otherwise(4)

    def one(x: Column) -> Column:
        s, back = x["s"], F.least(x["start"], F.lit(24))
        context = F.lower(F.substring(text, x["start"] - back + 1, back))
        between = lambda c: s.rlike(f"[0-9)]{c}[(0-9]")
        return F.struct(
            *(x[c].alias(c) for c in ("kind", "start", "end")),
            F.coalesce(*(F.when(x["kind"] == k, valid(k, s)) for k in KINDS), F.lit(False)).alias("ok"),
            F.struct(
                F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int").alias("kind"),
                F.when(x["kind"] == "email", 0).otherwise(F.size(F.split(s, "[^0-9]+")) - 1).alias("groups"),
                F.when(between("\\."), 3).when(between("-"), 2).when(between("\\x20"), 1).otherwise(0).alias("separator"),
                F.startswith(s, F.lit("+")).cast("int").alias("plus"),
                F.contains(s, F.lit("(")).cast("int").alias("bracket"),
                side(F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1))).otherwise("")).alias("before"),
                side(F.substring(text, x["end"] + 1, F.lit(1))).alias("after"),
                context.rlike(_WORDS).cast("int").alias("word"),
            ).alias("f"),
        )

    return F.transform(spans, one)


def labelled(found: Column, marks: Column) -> Column:
    """Of candidates those that teach, as (features, label); ``marks``: dots with the letters of base spans, as ``masked`` puts them."""

    def label(c: Column) -> Column:
        here = F.substring(marks, c["start"] + 1, c["end"] - c["start"])
        other = F.replace(here, F.left(c["kind"], F.lit(1)), F.lit(""))
        return F.when(other == "", 1).when(other.rlike("[a-z]") | ~c["ok"], 0)

    told = F.transform(found, lambda c: F.struct(c["f"].alias("f"), label(c).alias("label")))
    return F.filter(told, lambda t: t["label"].isNotNull())


class Trees:
    """Boosted regression trees of depth two on counted rows of integer features."""

    def __init__(self):
        self.start, self.trees = 0.0, []

    @staticmethod
    def _splits(rows: list[tuple]) -> list[tuple[int, int]]:
        return [(f, v) for f in range(len(FEATURES)) for v in sorted({r[0][f] for r in rows})[1:]]

    @staticmethod
    def _leaf(rows: list[tuple]) -> float:
        g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
        return g / (h + 1.0)

    def _grow(self, rows: list[tuple], depth: int):
        if depth == 0 or len(rows) < 2:
            return self._leaf(rows)
        gain = lambda part: sum(r[1] for r in part) ** 2 / (sum(r[2] for r in part) + 1.0)
        best = None
        for f, v in self._splits(rows):
            low, high = [r for r in rows if r[0][f] < v], [r for r in rows if r[0][f] >= v]
            score = gain(low) + gain(high)
            if best is None or score > best[0] + 1e-12:
                best = score, f, v, low, high
        if best is None or best[0] <= gain(rows) + 1e-9:
            return self._leaf(rows)
        _, f, v, low, high = best
        return f, v, self._grow(low, depth - 1), self._grow(high, depth - 1)

    def fit(self, table: list[tuple[tuple[int, ...], int, int]]) -> Trees:
        """``table``: features, rows, positive rows."""
        n, yes = sum(t[1] for t in table), sum(t[2] for t in table)
        rate = min(max(yes / max(n, 1), 1e-3), 1 - 1e-3)
        self.start = math.log(rate / (1 - rate))
        now = [self.start] * len(table)
        for _ in range(ROUNDS if table else 0):
            rows = []
            for (x, m, y), s in zip(table, now, strict=True):
                p = 1 / (1 + math.exp(-s))
                rows.append((x, y - m * p, max(m * p * (1 - p), 1e-9)))
            tree = self._grow(rows, 2)
            self.trees.append(tree)
            now = [s + SHRINK * self._value(tree, x) for (x, _, _), s in zip(table, now, strict=True)]
        return self

    def _value(self, tree, x: tuple[int, ...]) -> float:
        while isinstance(tree, tuple):
            f, v, low, high = tree
            tree = low if x[f] < v else high
        return tree

    def score(self, x: tuple[int, ...]) -> float:
        """The same sum, in the same order, as ``column`` makes."""
        total = self.start
        for t in self.trees:
            total += SHRINK * self._value(t, x)
        return total

    def column(self, f: Column) -> Column:
        def sql(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(SHRINK * tree)
            i, v, low, high = tree
            return F.when(f[FEATURES[i]] < v, sql(low)).otherwise(sql(high))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + sql(t)
        return total


def calibrated(trees: Trees, table: list[tuple[tuple[int, ...], int, int]]) -> dict[int, float]:
    """For each kind the least score from which candidates are right often enough; none: never."""
    out = {}
    for kind in range(1, len(KINDS) + 1):
        rows = sorted(((trees.score(x), m, y) for x, m, y in table if x[0] == kind), reverse=True)
        n = yes = 0
        for i, (s, m, y) in enumerate(rows):
            n, yes = n + m, yes + y
            last = i + 1 == len(rows) or rows[i + 1][0] < s
            if last and n >= LEAST_HELD and yes >= LEAST_PRECISION * n and s > 0:
                out[kind] = s
    return out


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


class Detector:
    """Finds personal data in texts with trees fitted to a table's texts."""

    def __init__(self, trees: Trees, least: dict[int, float]):
        self.trees, self.least = trees, least

    @classmethod
    def train(cls, docs: DataFrame, text_col: str = "text") -> Detector:
        # a text without any of the generators' hints has no candidates
        hints = "|".join(dict.fromkeys(f"(?:{hint})" for ps in GENERATORS.values() for _, hint in ps))
        read = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("text").rlike(hints))
        text = F.col("text")
        passing = lambda k: F.filter(based(text, k), lambda x: valid(k, x["s"]))
        read = read.select(F.xxhash64("text").alias("t"), F.xxhash64(F.reverse("text")).alias("u"), F.length("text").alias("n"), candidates(text).alias("found"), F.concat(*map(passing, KINDS)).alias("base"))
        # bound to names: an expression inside a lambda function is computed for each element
        own = F.when(F.size("found") > 0, F.struct("n", "found", "base"))
        told = _let(own, lambda s: _let(masked(F.repeat(F.lit("."), s["n"]), s["base"]), lambda marks: labelled(s["found"], marks)))
        taught = read.select("t", "u", told.alias("told")).where(F.size("told") > 0)
        # equal texts count once, by two hashes of 64 bits
        taught = taught.groupBy("t", "u").agg(F.first("told").alias("told"))
        held = (F.pmod(F.xxhash64(F.lit(9), "t"), F.lit(4)) == 0).alias("held")
        told = taught.select(held, F.explode("told").alias("c")).select("held", "c.f.*", "c.label")
        counts = told.groupBy("held", *FEATURES).agg(F.count("*").alias("rows"), F.sum("label").alias("yes")).collect()
        table = {h: sorted((tuple(r[f] for f in FEATURES), r["rows"], r["yes"]) for r in counts if r["held"] is h) for h in (False, True)}
        trees = Trees().fit(table[False])
        return cls(trees, calibrated(trees, table[True]))

    def _added(self, found: Column) -> Column:
        """Candidates that score enough; where some overlap, the first, of those the best, then the longest."""
        scored = F.transform(found, lambda c: F.struct(c["start"].alias("start"), (-self.trees.column(c["f"])).alias("score"), (-c["end"]).alias("back"), c["kind"].alias("kind")))
        enough = lambda c: F.coalesce(*(F.when(c["kind"] == KINDS[k - 1], c["score"] <= -s) for k, s in self.least.items()), F.lit(False))
        ordered = F.sort_array(F.filter(scored, enough))
        begin = F.struct(F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

        def step(a: Column, c: Column) -> Column:
            one = F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["back"]).alias("end"))
            free = c["start"] >= a["at"]
            return F.struct(F.when(free, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"), F.when(free, -c["back"]).otherwise(a["at"]).alias("at"))

        return F.aggregate(ordered, begin, step, lambda a: a["out"])

    def spans(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``_base`` and ``_added``: arrays of (kind, start, end), by kind and start."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        plain = lambda a: F.transform(a, lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end"))))
        passing = lambda k: F.filter(based(text, k), lambda x: valid(k, x["s"]))
        kept = [passing(k) for k in KINDS]
        out = docs.withColumn("_base", plain(F.concat(*kept)))
        if not self.least:
            return out.withColumn("_added", F.slice("_base", 1, 0))
        # candidates are sought where no base span is: those that meet one can't come up
        free = masked(text, F.col("_base"))
        added = _let(F.struct(free.alias("h"), F.col("_base").alias("b")), lambda s: _let(F.struct(candidates(text, s["h"]).alias("c"), s["b"].alias("b")), lambda q: F.when(F.size(q["c"]) > 0, self._added(q["c"])).otherwise(F.slice(q["b"], 1, 0))))
        return out.withColumn("_added", added)


def _listed(spans: Column) -> Column:
    order = F.transform(spans, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(order), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, counts and digest of base spans, and all spans.

    Spans are kind:start:end in code points, the end exclusive, by kind as in ``KINDS`` and start,
    joined by commas. Null and empty texts have none; very long ones are searched whole. Ids may be
    null or repeated, each row has its own; an empty table gives an empty one; no column but the
    named is read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = Detector.train(rows).spans(rows)
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    digest = F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256")
    return found.select(F.col("doc_id").alias(id_col), *counts, digest, _listed(F.concat("_base", "_added")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in brackets; null stays null.

    Spans that overlap are replaced together, under the kind of the first. Other columns stay,
    whatever their names, and so do repeated rows; an empty table gives an empty one.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_kept"), F.col(text_col).alias("_text"))
    found = Detector.train(packed, "_text").spans(packed, "_text")
    ordered = F.sort_array(F.transform(F.concat("_base", "_added"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    text = F.col("_text")
    begin = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("part"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        end = -x["back"]
        new = F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        new = F.when(x["start"] >= a["at"], new).otherwise(F.slice(new, 1, 0))
        full = F.size(a["part"]) >= PART
        out = F.when(full, F.concat(a["out"], F.array(a["part"]))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.when(full, new).otherwise(F.concat(a["part"], new)).alias("part"), F.greatest(a["at"], end).alias("at"))

    def joined(a: Column) -> Column:
        return F.array_join(F.concat(F.flatten(a["out"]), a["part"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), "")

    clean = F.aggregate(ordered, begin, step, joined)
    clean = F.when(text.isNull() | (F.size(ordered) == 0), text).otherwise(clean)
    return found.select(F.col("_kept").withField(text_col, clean).alias("_kept")).select("_kept.*")
