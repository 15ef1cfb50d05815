"""Column functions on names and texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Small letters that full case folding changes.
FOLDED = {"ß": "ss", "ς": "σ", "ſ": "s", "ŉ": "ʼn", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ǰ": "ǰ"}


def fold(c: Column) -> Column:
    """Case folding for search: small letters, and those that fold to others or to several.

    Texts of ASCII alone are lowered; in others the letters are replaced only where one of them occurs.
    """
    single = {letter: to for letter, to in FOLDED.items() if len(to) == 1}
    several = {letter: to for letter, to in FOLDED.items() if len(to) > 1}

    def spelled_out(low: Column) -> Column:
        out = F.translate(low, "".join(single), "".join(single.values()))
        for letter, to in several.items():
            out = F.replace(out, F.lit(letter), F.lit(to))
        return F.when((F.octet_length(low) > F.char_length(low)) & low.rlike(f"[{''.join(FOLDED)}]"), out).otherwise(low)

    return F.element_at(F.transform(F.array(F.lower(c)), spelled_out), 1)


def _weights(name: Column) -> Column:
    """What each character of a name adds to its hash; characters beyond 255 don't count."""
    code = lambda c: F.ascii(c).cast("long")

    def weight(c: Column) -> Column:
        special = F.when(c == 0, 0).when(c == 0x21, 11).when(c == 0x2E, 12).when(c == 0x30, 10).when(c == 0x5F, 13).when(c == 0xB4, 11)
        return special.when(c <= 0x5A, c - 48).when(c <= 0x7F, c - 80).when(c <= 0xAF, c - 48).otherwise(c - 304)

    return F.transform(F.filter(F.transform(F.split(name, ""), code), lambda c: c < 256), weight)


def context_hash(name: Column) -> Column:
    """The 32-bit hash that names a topic: h = 43 h + t(c), modulo 2**32; 1 for an empty name.

    The weight t(c) of a character follows its code; characters beyond 255 don't count.
    """
    folded = F.aggregate(_weights(name), F.lit(0).cast("long"), lambda h, w: F.pmod(h * 43 + w, F.lit(1 << 32)))
    return F.when(name == "", F.lit(1).cast("long")).otherwise(folded)


def hash_and_power(name: Column) -> Column:
    """``h``, the hash of a part of a name (0 if empty), ``p``, 43 to the number of its characters modulo 2**32, and that number ``n``.

    A name's hash is that of its first part times ``p`` of its second plus that one's hash.
    """
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("p"), F.lit(0).alias("n"))
    parts = F.when(name == "", F.array().cast("array<bigint>")).otherwise(_weights(name))
    return F.aggregate(parts, start, lambda a, w: F.struct(F.pmod(a["h"] * 43 + w, F.lit(1 << 32)).alias("h"), F.pmod(a["p"] * 43, F.lit(1 << 32)).alias("p"), (a["n"] + 1).alias("n")))


def reverse_hash(h: int) -> str:
    """The shortest name over 1-9 0 . _ A-Z with a hash, by trying the lost high words."""
    h &= 0xFFFFFFFF
    if h == 1:
        return ""
    letters = {**{k: chr(48 + k) for k in range(1, 10)}, 10: "0", 12: ".", 13: "_", **{k: chr(48 + k) for k in range(17, 43)}}
    for high in range(43):
        x, out = (high << 32) | h, ""
        while x:
            x, digit = divmod(x, 43)
            if digit not in letters:
                break
            out = letters[digit] + out
        else:
            if out:
                return out
    return f"CTX_{h:08X}"


@F.pandas_udf(StringType())
def _reversed(h: pd.Series) -> pd.Series:
    names = {x: reverse_hash(int(x)) for x in h.dropna().unique()}
    return h.map(names)


def reverse_hashes(df: DataFrame, hash_col: str, out: str) -> DataFrame:
    """A name for each hash; each distinct hash is inverted once."""
    names = df.select(hash_col).where(F.col(hash_col).isNotNull()).distinct().withColumn(out, _reversed(F.col(hash_col)))
    return df.join(names, hash_col, "left")


#: The usual beginnings of context names.
PREFIXES = ("", "idh_", "IDH_", "hid_", "HID_", "helpid_", "id_", "topic_", "ctx_")


def hash_of(name: str) -> int:
    """The hash of a name in plain Python, for the few that the library itself states."""
    h = 0
    for c in map(ord, name):
        special = {0: 0, 0x21: 11, 0x2E: 12, 0x30: 10, 0x5F: 13, 0xB4: 11}
        if c < 256:
            h = (h * 43 + special.get(c, c - 48 if c <= 0x5A or 0x7F < c <= 0xAF else c - 80 if c <= 0x7F else c - 304)) % (1 << 32)
    return h


def names_from_titles(titles: DataFrame, hash_col: str, title_col: str, out: str) -> DataFrame:
    """Each hash with the first name made from its title that has this hash, null where none has.

    Names: a prefix and the title's words, joined by nothing or by a low line, with and without
    each number of words left out at the end; compared by hash, with no candidate left out. Each
    spelling of the words is hashed once; a prefix adds its own hash times 43 to their length.
    """
    words = F.filter(F.split(F.col(title_col), "[^A-Za-z0-9.]+"), lambda w: w != "")
    shorter = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.slice(words, 1, n))
    bodies = F.flatten(F.transform(shorter, lambda w: F.array(F.array_join(w, ""), F.array_join(w, "_"))))
    made = titles.select(hash_col, title_col, F.posexplode(F.when(F.size(words) > 0, bodies)).alias("_at", "_body")).withColumn("_b", hash_and_power(F.col("_body")))
    signed = lambda h: h - (1 << 32) if h >= 1 << 31 else h
    whole = lambda p: F.pmod(F.pmod(F.col("_b.p") * F.lit(signed(hash_of(p))), F.lit(1 << 32)) + F.col("_b.h"), F.lit(1 << 32))
    hit = [F.when(whole(p) == F.col(hash_col), F.struct(F.lit(k).alias("k"), F.col("_at").alias("at"), F.concat(F.lit(p), "_body").alias("name"))) for k, p in enumerate(PREFIXES)]
    right = made.select(hash_col, title_col, F.coalesce(*hit).alias("_hit")).where("_hit is not null")
    found = right.groupBy(hash_col, title_col).agg(F.min("_hit")["name"].alias(out))
    return titles.join(found, [hash_col, title_col], "left")


def html_escape(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def rtf_escape(c: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def safe_name(c: Column) -> Column:
    """A file name without characters that file systems object to."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def label(title: Column, number: Column) -> Column:
    """A topic's title, or its number where it has none."""
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Topic "), number.cast("string")))
