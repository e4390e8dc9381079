"""Column expressions on masks of stride 8: bit 8 * row + column of a bigint, read as unsigned.

Every function takes and returns Columns that stay inside whole-stage code generation, except the two
floods, which run on Arrow batches. A null mask gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

SIDE = 8
_TOP = -(1 << 63)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def places(keep: Callable[[int, int], bool]) -> int:
    """The mask of all cells (row, column) that ``keep`` accepts."""
    return _signed(sum(1 << (SIDE * r + c) for r in range(SIDE) for c in range(SIDE) if keep(r, c)))


def long(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")


def up(x: Column, by: int) -> Column:
    return F.shiftleft(x, by)


def down(x: Column, by: int | Column) -> Column:
    """Shift right without sign."""
    return F.shiftrightunsigned(x, by) if isinstance(by, int) else F.call_function("shiftrightunsigned", x, by.cast("int"))


def land(a: Column, b: int | Column) -> Column:
    return a.bitwiseAND(long(b))


def lor(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out.bitwiseOR(x)
    return out


def lxor(a: Column, b: int | Column) -> Column:
    return a.bitwiseXOR(long(b))


_LAST = places(lambda r, c: c == SIDE - 1)
_FIRST = places(lambda r, c: c == 0)
_NOT_LAST, _NOT_FIRST = _signed(~_LAST & (2**64 - 1)), _signed(~_FIRST & (2**64 - 1))


def size(mask: Column) -> Column:
    """How many cells."""
    return F.bit_count(mask).cast("int")


def column_bits(mask: Column) -> Column:
    """The columns that have a cell, as a byte."""
    half = lor(mask, down(mask, 32))
    quarter = lor(half, down(half, 16))
    return land(lor(quarter, down(quarter, 8)), 255)


def row_bits(mask: Column) -> Column:
    """The rows that have a cell, as a byte."""
    out = F.lit(0).cast("bigint")
    for r in range(SIDE):
        out = out + F.when(land(mask, places(lambda rr, c, r=r: rr == r)) != 0, 1 << r).otherwise(0)
    return out


def _length(byte: Column) -> Column:
    """The number of its highest bit, from 1; 0 for 0."""
    out = F.lit(0)
    for k in range(1, SIDE + 1):
        out = F.when(byte >= 1 << (k - 1), F.lit(k)).otherwise(out)
    return out


def _trailing(byte: Column) -> Column:
    """Zeros below its lowest bit; 0 for 0."""
    return F.when(byte == 0, 0).otherwise(F.bit_count(land(byte, -byte) - 1))


def settled(df: DataFrame) -> DataFrame:
    """The same rows; filters that follow stay above. Pushed below, a filter on a computed column would take its whole
    computation along, once for every mention, and masks mention themselves often."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def with_box(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Adds ``min_row``, ``min_col``, ``w``, ``h``: the tight box; (0, 0) wide for no cells."""
    bits = df.withColumns({"__cols": column_bits(F.col(mask)), "__rows": row_bits(F.col(mask))})
    low = bits.withColumns({"min_col": _trailing(F.col("__cols")).cast("int"), "min_row": _trailing(F.col("__rows")).cast("int")})
    return low.withColumns({"w": (_length(F.col("__cols")) - F.col("min_col")).cast("int"), "h": (_length(F.col("__rows")) - F.col("min_row")).cast("int")}).drop("__cols", "__rows")


def with_normal(df: DataFrame, mask: str = "mask", out: str = "normal") -> DataFrame:
    """Adds the box and ``out``: the shape moved so that its box begins at (0, 0)."""
    return with_box(df, mask).withColumn(out, down(F.col(mask), F.col("min_row") * SIDE + F.col("min_col")))


def _exchange(x: Column, keep: int, by: int) -> Column:
    """Exchanges the cells of ``keep`` with those ``by`` places on."""
    moved = land(lxor(x, down(x, by)), keep)
    return lxor(lxor(x, moved), up(moved, by))


def transposed(df: DataFrame, mask: str, out: str) -> DataFrame:
    """Rows become columns, by the textbook method for bit matrices: blocks of 4, 2 and 1 cells change places across the diagonal."""
    x, at = F.col(mask), df
    for k in (4, 2, 1):
        at = at.withColumn(out, _exchange(x, places(lambda r, c, k=k: not r & k and bool(c & k)), (SIDE - 1) * k))
        x = F.col(out)
    return at


def mirrored_columns(x: Column) -> Column:
    """Column c becomes column 7 - c."""
    for k in (4, 2, 1):
        keep = places(lambda r, c, k=k: not c & k)
        x = lor(up(land(x, keep), k), land(down(x, k), keep))
    return x


def mirrored_rows(x: Column) -> Column:
    """Row r becomes row 7 - r."""
    for k in (4, 2, 1):
        keep = places(lambda r, c, k=k: not r & k)
        x = lor(up(land(x, keep), SIDE * k), land(down(x, SIDE * k), keep))
    return x


def with_rotations(df: DataFrame, mask: str = "normal", w: str = "w", h: str = "h") -> DataFrame:
    """Adds ``m90``, ``m180``, ``m270``: the clockwise rotations, each with its box at (0, 0). The mask must have its own there."""
    t = transposed(df, mask, "__t")
    gap_w, gap_h = SIDE - F.col(w), SIDE - F.col(h)
    return t.withColumns(
        {
            "m90": down(mirrored_columns(F.col("__t")), gap_h),
            "m180": down(mirrored_columns(mirrored_rows(F.col(mask))), gap_h * SIDE + gap_w),
            "m270": down(mirrored_rows(F.col("__t")), gap_w * SIDE),
        }
    ).drop("__t")


def least_unsigned(*masks: Column) -> Column:
    return lxor(F.least(*(lxor(m, _TOP) for m in masks)), _TOP)


def with_canonical(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Adds the box, ``normal``, the rotations, ``canonical`` (the least of the four as unsigned numbers), ``s90`` and ``s180``
    (unchanged by a quarter or half turn), ``weight`` (how many of the four differ) and ``max_dim``."""
    turned = with_rotations(with_normal(df, mask))
    return turned.withColumns(
        {
            "canonical": least_unsigned(*(F.col(c) for c in ("normal", "m90", "m180", "m270"))),
            "s90": (F.col("w") == F.col("h")) & (F.col("m90") == F.col("normal")),
            "s180": F.col("m180") == F.col("normal"),
            "max_dim": F.greatest("w", "h"),
        }
    ).withColumn("weight", F.when(F.col("s90"), 1).when(F.col("s180"), 2).otherwise(4))


def cells(mask: Column) -> Column:
    """The cells as an array of (row, col), by place."""
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", mask, i) == 1)
    return F.transform(at, lambda i: F.struct(F.floor(i / SIDE).cast("int").alias("row"), (i % SIDE).cast("int").alias("col")))


def from_cells(array: Column) -> Column:
    """The mask of an array of (row, col)."""
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["row"] * SIDE + x["col"])))


def beside(mask: Column) -> Column:
    """The cells and their four neighbours, within the 8 x 8 board."""
    return lor(mask, up(land(mask, _NOT_LAST), 1), down(land(mask, _NOT_FIRST), 1), up(mask, SIDE), down(mask, SIDE))


def frontier(mask: Column, n: int = SIDE) -> Column:
    """The empty neighbours inside the n x n board."""
    board = places(lambda r, c: r < n and c < n)
    return land(land(beside(mask), lxor(mask, -1)), board)


def euler(mask: Column) -> Column:
    """Corners - edges + cells of the closed squares, exact for any mask, also where it touches column or row 7."""
    last, bottom = land(mask, _LAST), down(mask, SIDE * (SIDE - 1))
    right = up(land(mask, _NOT_LAST), 1)
    wide = lor(mask, right)
    corners = F.bit_count(lor(wide, up(wide, SIDE))) + F.bit_count(lor(last, up(last, SIDE))) + F.bit_count(lor(bottom, up(bottom, 1)))
    upright = F.bit_count(wide) + F.bit_count(last)
    level = F.bit_count(lor(mask, up(mask, SIDE))) + F.bit_count(bottom)
    return (corners - upright - level + F.bit_count(mask)).cast("int")


def holes(mask: Column) -> Column:
    """How many holes a connected shape has."""
    return 1 - euler(mask)


def _spread(seed: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Floods each board from its seed until nothing moves; boards that are done drop out."""
    now, open_ = seed & inside, np.arange(len(seed))
    one, row = np.uint64(1), np.uint64(SIDE)
    not_last, not_first = (np.uint64(x & (2**64 - 1)) for x in (_NOT_LAST, _NOT_FIRST))
    while len(open_):
        x = now[open_]
        new = (x | (x & not_last) << one | (x & not_first) >> one | x << row | x >> row) & inside[open_]
        moved = new != x
        now[open_] = new
        open_ = open_[moved]
    return now


def _boards(masks: pa.Array) -> np.ndarray:
    return pc.fill_null(masks, 0).to_numpy(zero_copy_only=False).view(np.uint64)


def _connected(masks: pa.Array) -> pa.Array:
    m = _boards(masks)
    lowest = m & (~m + np.uint64(1))
    return pc.if_else(masks.is_valid(), pa.array((m != 0) & (_spread(lowest, m) == m)), None)


def _holed(masks: pa.Array) -> pa.Array:
    empty = ~_boards(masks)
    rim = np.full(len(empty), places(lambda r, c: r in (0, SIDE - 1) or c in (0, SIDE - 1)) & (2**64 - 1), np.uint64)
    return pc.if_else(masks.is_valid(), pa.array(_spread(rim, empty) != empty), None)


def connected(mask: Column) -> Column:
    """Whether all cells hang together by their sides; false for no cells.

    A flood takes as many steps as its longest way, which no built-in expression does without the most steps for every row. So this and the next
    run on Arrow batches, where all boards of a batch take a step at once.
    """
    return F.arrow_udf(_connected, T.BooleanType())(mask)


def has_hole_by_flood(mask: Column) -> Column:
    """Whether some empty cell can't be reached from outside by sides: the background is flooded from the rim."""
    return F.arrow_udf(_holed, T.BooleanType())(mask)


def touches_all_sides(mask: Column, w: int, h: int) -> Column:
    """Whether a mask on a w x h board touches its four sides."""
    sides = (lambda r, c: r == 0, lambda r, c: r == h - 1, lambda r, c: c == 0, lambda r, c: c == w - 1)
    return F.lit(True) & (land(mask, places(sides[0])) != 0) & (land(mask, places(sides[1])) != 0) & (land(mask, places(sides[2])) != 0) & (land(mask, places(sides[3])) != 0)


def grown(df: DataFrame, mask: str = "mask", n: int = SIDE) -> DataFrame:
    """One row per shape and empty neighbour that keeps it within n x n: ``grown``, moved to (0, 0). The mask must have its box there.

    The shape is first moved one row and column inwards where it has room, so that cells above and left of it count. One of seven
    rows or columns then ends at the board's rim, so the cells below or right of it are taken from where it was.
    """
    boxed = with_box(df, mask)
    room = boxed.withColumns({"dr": (F.col("h") < SIDE).cast("int"), "dc": (F.col("w") < SIDE).cast("int")})
    moved = room.withColumn("moved", F.call_function("shiftleft", F.col(mask), F.col("dr") * SIDE + F.col("dc")))
    open_ = moved.withColumn("open", land(beside(F.col("moved")), lxor(F.col("moved"), -1)))
    below, right = places(lambda r, c: r == SIDE - 1), places(lambda r, c: c == SIDE - 1)
    rim = F.when(F.col("h") == SIDE - 1, long(below)).otherwise(0).bitwiseOR(F.when(F.col("w") == SIDE - 1, long(right)).otherwise(0))
    far = open_.withColumn("far", land(land(beside(F.col(mask)), lxor(F.col(mask), -1)), rim))
    both = far.withColumn("place", F.explode(F.array(F.struct("moved", "open"), F.struct(F.col(mask).alias("moved"), F.col("far").alias("open")))))
    each = both.withColumns({"moved": F.col("place.moved"), "open": F.col("place.open")}).where("open <> 0")
    at = each.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("open"), i) == 1)))
    whole = at.withColumn("new", F.col("moved").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("i"))))
    out = with_normal(whole.drop("min_row", "min_col", "w", "h"), "new", "grown")
    return settled(out.select(*df.columns, "w", "h", "grown")).where((F.col("w") <= n) & (F.col("h") <= n))


def to_hex(mask: Column) -> Column:
    """The record as stored: 8 bytes, little-endian, in hexadecimal."""
    wide = F.lpad(F.hex(mask), 16, "0")
    return F.lower(F.concat(*(F.substring(wide, 15 - 2 * i, 2) for i in range(8))))


def from_hex(text: Column) -> Column:
    """The first 8 bytes of a stored record; null where it has fewer."""
    big = F.concat(*(F.substring(text, 15 - 2 * i, 2) for i in range(8)))
    return F.when(F.length(text) >= 16, F.conv(big, 16, -10).cast("decimal(20,0)").cast("bigint"))
