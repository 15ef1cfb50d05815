"""Points in ranges and rectangles of any size: ranges by nodes that are painted, rectangles by cells that make an equi-join of the lookup."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: A range of longs has aligned cells of 2**0 to 2**62 positions.
DEEPEST = 62
#: A node has 2**BITS positions, or nodes of the level below.
BITS = 14
#: Nodes are painted so many rows at a time; one node may have more.
ROWS = 1 << 17


def dyadic(low: str, high: str) -> Column:
    """The aligned cells (level, cell) that together are the range from ``low`` to ``high``, both columns of whole numbers.

    A cell of a level covers the 2**level positions that share all but their last ``level`` bits. A
    range has at most two of a level, however wide it is; an empty range (low > high) has none.
    """
    first, past = f"-shiftright(-cast({low} as bigint), k)", f"shiftright(cast({high} as bigint) + 1, k)"
    cell = lambda at, odd: f"if({first} < {past} and {odd} & 1 = 1, named_struct('level', k, 'cell', {at}), null)"
    both = f"array({cell(first, f'({first})')}, {cell(f'{past} - 1', f'({past})')})"
    return F.expr(f"filter(flatten(transform(sequence(0, {DEEPEST}), k -> {both})), c -> c is not null)")


def _blocks(ends: DataFrame, by: list[str]) -> DataFrame:
    """What the ranges cover of the nodes where they begin and end, as blocks of 2**_kind positions from _from on.

    A range within one node is two blocks that may overlap. Any other has one block from its low end
    on and one up to its high end, both as long as a node: what juts out of the node doesn't count.
    So a node has at most some (BITS + 2) * 2**BITS different blocks, however many ranges.
    """
    laid = ends.withColumns({"_first": F.expr(f"shiftright(_low, {BITS})"), "_last": F.expr(f"shiftright(_high, {BITS})")})
    laid = laid.withColumn("_kind", F.expr(f"if(_first = _last, cast(floor(log2(_high - _low + 1)) as int), {BITS})"))
    at = lambda end: f"cast({end} & {(1 << BITS) - 1} as int)"
    pair = f"array(struct(_first as _node, {at('_low')} as _from), struct(_last as _node, {at('_high')} - shiftleft(1, _kind) + 1 as _from))"
    return laid.select(*by, F.expr(f"explode({pair})").alias("_b"), "_kind", "_order", "_carry").select(*by, "_b._node", "_kind", "_b._from", "_order", "_carry")


def _nodes_between(ends: DataFrame, by: list[str]) -> DataFrame:
    """The whole nodes that lie between those where a range begins and ends, as ranges of the next level."""
    inner = ends.select(*by, F.expr(f"shiftright(_low, {BITS}) + 1").alias("_low"), F.expr(f"shiftright(_high, {BITS}) - 1").alias("_high"), "_order", "_carry")
    return inner.where("_low <= _high")


def _borders(rows: pa.Table, keys: int) -> np.ndarray:
    """Whether a row is the first of its node."""
    first = np.zeros(len(rows), bool)
    first[0] = True
    for column in rows.columns[:keys]:
        first[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1)).to_numpy()
    return first


def _owners(rows: pa.Table, by: int) -> pa.Table:
    """The places of whole nodes with the last block that holds each; blocks come in their order within a node."""
    node = np.cumsum(_borders(rows, by + 1))
    kind, at = rows["_kind"].to_numpy(), rows["_from"].to_numpy().astype(np.int64)
    place, block = np.flatnonzero(kind < 0), np.flatnonzero(kind >= 0)
    key = node[place] << BITS | at[place]
    order = np.argsort(key)
    place, key = place[order], key[order]
    start, end = np.maximum(at[block], 0), np.minimum(at[block] + (1 << kind[block].astype(np.int64)) - 1, (1 << BITS) - 1)
    left, right = np.searchsorted(key, node[block] << BITS | start), np.searchsorted(key, node[block] << BITS | end, "right")
    some = left < right
    left, right, block = left[some], right[some], block[some]
    # a run of places is two runs of 2**k places; owners of 2**k places are handed down to their halves
    owner, level = np.full(len(place), -1), np.frexp(right - left)[1] - 1
    for k in range(level.max(initial=0), -1, -1):
        of = level == k
        np.maximum.at(owner, left[of], block[of])
        np.maximum.at(owner, right[of] - (1 << k), block[of])
        if k:
            half, above = 1 << k - 1, owner.copy()
            np.maximum(owner[half:], above[:-half], out=owner[half:])
    place, owner = place[owner >= 0], owner[owner >= 0]
    places = rows["_node"].to_numpy()[place] << BITS | at[place]
    keys = {n: rows[n].take(place) for n in rows.column_names[:by]}
    return pa.table(keys | {"_place": places, "_order": rows["_order"].take(owner), "_carry": rows["_carry"].take(owner)})


def _painted(by: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, enough = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= enough:
            rows = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_borders(rows, by + 1))[-1])  # the last node may go on
            if cut:
                yield from _owners(rows.slice(0, cut), by).to_batches()
            held, n = rows.slice(cut).to_batches(), n - cut
            enough = max(ROWS, 2 * n)
    if n:
        yield from _owners(pa.Table.from_batches(held).combine_chunks(), by).to_batches()


def covering(points: DataFrame, ranges: DataFrame, by: list[str], at: str, low: str, high: str, carry: str, order: str) -> DataFrame:
    """Each point with ``carry`` of the last range (by ``order``) of its key that holds it, null where none does.

    Positions lie in nodes of 2**BITS, these in nodes of the next level, five levels at most. A range
    is two blocks a level, in the nodes where it begins and ends; the whole nodes between are a range
    of the next level. Equal blocks are reduced to their last range before they are shuffled, and each
    place is asked for once, so that no node grows with the rows. From the widest level down,
    the nodes are painted one after another, and what holds a node is a block in it.
    A null position is in no range, a range with a null end holds nothing; points that are equal in all
    columns each have their row. Keys are of plain types.
    """
    ends = ranges.select(*by, F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high"), F.col(order).alias("_order"), F.col(carry).alias("_carry"))
    asked = points.select(F.struct(*points.columns).alias("_own"), *(F.col(b) for b in by), F.col(at).cast("long").alias("_at"))
    ends = ends.where("_low <= _high").where(_all_there(by))
    least, most = ends.agg(F.min("_low"), F.max("_high")).first()
    if least is None:
        return points.withColumn(carry, F.lit(None).cast(ranges.schema[carry].dataType))
    depth = next(k for k in range(1, 6) if k == 5 or least >> BITS * k == most >> BITS * k)
    levels = [ends]
    for _ in range(depth - 1):
        levels.append(_nodes_between(levels[-1], by))
    within = asked.where(F.col("_at").between(least, most)).where(_all_there(by))
    found = None
    for k in reversed(range(depth)):
        blocks = _blocks(levels[k], by)
        if found is not None:
            blocks = blocks.union(found.select(*by, F.col("_place").alias("_node"), F.lit(BITS).alias("_kind"), F.lit(0).alias("_from"), "_order", "_carry"))
        blocks = blocks.groupBy(*by, "_node", "_kind", "_from").agg(F.max(F.struct("_order", "_carry")).alias("_range")).select(*by, "_node", "_kind", "_from", "_range.*")
        places = within.select(*by, F.expr(f"shiftright(_at, {BITS * k})").alias("_place")).distinct()
        none = [F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in ("_order", "_carry")]
        places = places.select(*by, F.expr(f"shiftright(_place, {BITS})").alias("_node"), F.lit(-1).alias("_kind"), F.expr(f"cast(_place & {(1 << BITS) - 1} as int)").alias("_from"), *none)
        rows = places.union(blocks).repartition(*by, "_node").sortWithinPartitions(*by, "_node", "_order", "_carry")
        kinds = StructType([*(rows.schema[b] for b in by), StructField("_place", LongType()), rows.schema["_order"], rows.schema["_carry"]])
        found = rows.mapInArrow(functools.partial(_painted, len(by)), kinds)
    found = found.select(*by, F.col("_place").alias("_at"), "_carry")
    return asked.join(found, [*by, "_at"], "left").select("_own.*", F.col("_carry").alias(carry))


def _all_there(by: list[str]) -> Column:
    return functools.reduce(Column.__and__, (F.col(b).isNotNull() for b in by), F.lit(True))


def interleaved(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """``df`` with the Z-order code of two numbers of 31 bits: what lies together has codes that lie together.

    Bits are spread in five steps, each a column of its own, so that none is written out twice.
    """
    df = df.withColumns({"_zx": F.col(x).cast("long"), "_zy": F.col(y).cast("long")})
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        df = df.withColumns({c: F.expr(f"({c} | shiftleft({c}, {shift})) & {mask}L") for c in ("_zx", "_zy")})
    return df.withColumn(out, F.expr("_zx | shiftleft(_zy, 1)")).drop("_zx", "_zy")


def in_rectangles(points: DataFrame, boxes: DataFrame, x: str, y: str, left: str, right: str, low: str, high: str) -> DataFrame:
    """Points with the boxes that hold them, edges included: one row for each pair, with the columns of both.

    Coordinates are whole numbers from 0 to 2**31 - 1. A box lies on at most nine cells whose sides
    are the powers of two next above half its own sides, each cell by its levels and its Z-order
    code; a point looks up its cell at each pair of levels whose boxes reach around it, and the edges
    decide. So a box costs the same whatever its size, and its cells have at most some nine times its
    area; a point beyond all boxes of a pair of levels costs a comparison. A point's code is made
    once: its cells' codes are those bits of it that the levels leave.
    A null coordinate or edge meets nothing; an empty box (left > right) holds nothing.
    """
    # the least level at which the side spans at most three cells
    level = lambda a, b: f"cast(ceil(log2(greatest(({b}) - ({a}) + 1, 2) / 2.0D)) as int)"
    laid = boxes.where(f"{left} <= {right} and {low} <= {high}").withColumns({"_kx": F.expr(level(left, right)), "_ky": F.expr(level(low, high))})
    # at most 32 * 32 rows: pairs of levels, each with the rectangle around its boxes
    pairs = laid.groupBy("_kx", "_ky").agg(F.min(left).alias("l"), F.max(right).alias("r"), F.min(low).alias("b"), F.max(high).alias("t")).collect()
    if not pairs:
        return points.join(boxes, F.lit(False))
    cells = lambda a, b, k: F.explode(F.expr(f"sequence(shiftright(cast({a} as bigint), {k}), shiftright(cast({b} as bigint), {k}))"))
    laid = laid.withColumn("_cx", cells(left, right, "_kx")).withColumn("_cy", cells(low, high, "_ky"))
    laid = laid.withColumns({"_cx": F.expr("shiftleft(_cx, _kx)"), "_cy": F.expr("shiftleft(_cy, _ky)")})
    laid = interleaved(laid, "_cx", "_cy", "_cell").select(*boxes.columns, "_kx", "_ky", "_cell")

    def left_bits(kx: int, ky: int) -> int:
        return sum(1 << 2 * k for k in range(kx, 31)) | sum(2 << 2 * k for k in range(ky, 31))

    around = f"{x} between {min(p['l'] for p in pairs)} and {max(p['r'] for p in pairs)} and {y} between {min(p['b'] for p in pairs)} and {max(p['t'] for p in pairs)}"
    each = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in (*p.asDict().items(), ("bits", left_bits(p["_kx"], p["_ky"]))))) for p in pairs))
    asked = interleaved(points.where(around), x, y, "_z").select("*", F.explode(each).alias("_k"))
    asked = asked.where(f"{x} between _k.l and _k.r and {y} between _k.b and _k.t")
    asked = asked.select(*points.columns, F.col("_k._kx").cast("int").alias("_kx"), F.col("_k._ky").cast("int").alias("_ky"), F.expr("_z & _k.bits").alias("_cell"))
    inside = f"{x} between {left} and {right} and {y} between {low} and {high}"
    return asked.join(laid, ["_kx", "_ky", "_cell"]).where(inside).select(*points.columns, *boxes.columns)
