"""Typed columns of system records, by column functions on their payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(payload: Column, at: int, size: int, signed: bool = False) -> Column:
    """The little-endian number of ``size`` bytes at a byte of a binary column; null beyond its end."""
    digits = F.concat(*(F.hex(F.substring(payload, at + size - k, 1)) for k in range(size)))
    value = F.when(F.length(payload) >= at + size, F.conv(digits, 16, 10).cast("long"))
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value) if signed else value


def text(payload: Column, at: int, size: int) -> Column:
    """The bytes of a zero-ended field as text (ASCII and Latin-1)."""
    return F.substring_index(F.decode(F.substring(payload, at + 1, size), "ISO-8859-1"), "\0", 1)


#: The fields of a window record of 90 bytes, with their bits in the flags.
WINDOW = {"x": (0x0008, 72), "y": (0x0010, 74), "width": (0x0020, 76), "height": (0x0040, 78), "maximize": (0x0080, 80)}


def windows(records: DataFrame) -> DataFrame:
    """(file, number, type, name, caption, x, y, width, height, maximize, scroll_color, fixed_color) of ``system_record`` rows of code 6.

    Fields whose bit isn't set, or that lie beyond the payload, are null; windows are numbered from
    0 in each file's order of records.
    """
    p = F.col("payload")
    flags = number(p, 0, 2)
    has = lambda bit, value: F.when(flags.bitwiseAND(F.lit(bit)) != 0, value)
    own = records.where("code = 6")
    ahead = own.groupBy("file").agg(F.array_sort(F.collect_list("ord")).alias("_all"))
    own = own.join(ahead, "file").withColumn("number", F.array_position("_all", F.col("ord")) - 1)
    sized = [has(bit, number(p, at, 2, signed=True)).alias(name) for name, (bit, at) in WINDOW.items()]
    named = [has(0x0001, text(p, 2, 10)).alias("type"), has(0x0002, text(p, 12, 9)).alias("name"), has(0x0004, text(p, 21, 51)).alias("caption")]
    return own.select("file", "number", *named, *sized, has(0x0100, number(p, 82, 4)).alias("scroll_color"), has(0x0200, number(p, 86, 4)).alias("fixed_color"))
