"""Rows as nested JSON without their raw bytes, at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType


def holds_bytes(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(holds_bytes(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return holds_bytes(kind.elementType)
    if isinstance(kind, MapType):
        return holds_bytes(kind.keyType) or holds_bytes(kind.valueType)
    return isinstance(kind, BinaryType)


def without_bytes(value: Column, kind: DataType, encode: bool = False) -> Column | None:
    """A value rebuilt by its type: binary fields left out or, with ``encode``, as base64; what holds none stays as it is.

    None where nothing is left: a binary value itself, an array or map of them. A struct that has
    lost all its fields is left out too; a null struct, array or map stays null. Keys of maps can't
    be left out, so a map with binary keys is, unless they are encoded.
    """
    if not holds_bytes(kind):
        return value
    if isinstance(kind, BinaryType):
        return F.base64(value) if encode else None
    if isinstance(kind, StructType):
        kept = [(f.name, without_bytes(value.getField(f.name), f.dataType, encode)) for f in kind]
        kept = [c.alias(name) for name, c in kept if c is not None]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, ArrayType):
        if without_bytes(F.lit(None), kind.elementType, encode) is None:
            return None
        return F.transform(value, lambda x: without_bytes(x, kind.elementType, encode))
    if holds_bytes(kind.keyType) and not encode or without_bytes(F.lit(None), kind.valueType, encode) is None:
        return None
    out = F.transform_values(value, lambda _, v: without_bytes(v, kind.valueType, encode))
    return F.transform_keys(out, lambda k, _: without_bytes(k, kind.keyType, encode)) if holds_bytes(kind.keyType) else out


def strip_bytes(df: DataFrame, encode: bool = False) -> DataFrame:
    """``df`` with ``without_bytes`` applied to each column; columns of which nothing is left go."""
    kept = [(f.name, without_bytes(F.col(f"`{f.name}`"), f.dataType, encode)) for f in df.schema]
    return df.select(*(c.alias(name) for name, c in kept if c is not None))


def in_parts(df: DataFrame, by: list[str], place: str, item: Column, size: int, out: str = "items") -> DataFrame:
    """The items of each key in arrays of at most ``size``, in order of ``place`` (from 0, without gaps): (by, part, out).

    So that a key with any number of items makes rows of bounded size, and no task has all of them.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(place).alias("_at"), item.alias("_item"))))
    each = df.groupBy(*by, F.floor(F.col(place) / size).cast("long").alias("part")).agg(listed.alias("_listed"))
    return each.select(*by, "part", F.transform("_listed", lambda x: x["_item"]).alias(out))


def to_json(value: Column) -> Column:
    """JSON of a value, null fields included."""
    return F.to_json(value, {"ignoreNullFields": "false"})
