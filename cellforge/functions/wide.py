"""Shapes on boards wider than 8, from their stored record: little-endian bytes in hexadecimal, bit stride * row + column."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellforge.functions.geometry import settled


def cells(record: Column, stride: Column) -> Column:
    """The cells as an array of (row, col), by place. Only set bits take room, whatever the record's width."""
    count = F.floor(F.length(record) / 2).cast("int")
    byte = F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(record, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
    bits = F.transform(byte, lambda b, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.call_function("getbit", b.cast("bigint"), k) == 1), lambda k: i * 8 + k))
    return F.when(
        count > 0,
        F.transform(F.flatten(bits), lambda at: F.struct(F.floor(at / stride).cast("int").alias("row"), (at % stride).cast("int").alias("col"))),
    )


def extent(array: Column, part: str) -> Column:
    """Of the given coordinate the greatest minus the least plus 1; 0 for no cells."""
    along = F.transform(array, lambda x: x[part])
    return F.when(F.size(array) > 0, F.array_max(along) - F.array_min(along) + 1).otherwise(0)


def _distinct(array: Column, moves: list[tuple[int, int, int]]) -> Column:
    """How many distinct (kind, row, col) come of moving every cell so. As one number each, which array_distinct hashes."""
    one = 1 << 20
    made = F.transform(array, lambda x: F.array(*(F.lit(k * one * one) + (x["row"] + r).cast("bigint") * one + (x["col"] + c) for k, r, c in moves)))
    return F.size(F.array_distinct(F.flatten(made)))


def euler(array: Column) -> Column:
    """Corners - edges + cells, at any width."""
    corners = _distinct(array, [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1)])
    edges = _distinct(array, [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 0, 1)])
    return corners - edges + F.size(array)


def turned(df: DataFrame, array: str, stride: str) -> DataFrame:
    """Adds ``w``, ``h``, ``normal`` and ``canonical`` (the set bits of the shape moved to (0, 0) and of the least of its four turns, highest first), ``s90``, ``s180``,
    ``weight`` and ``max_dim``, at any width. A number is less than another if its bits, from the highest, come first to a lower one."""
    at = F.col(array)
    boxed = settled(df).withColumns({"w": extent(at, "col"), "h": extent(at, "row")})
    low_row, low_col = F.array_min(F.transform(at, lambda x: x["row"])), F.array_min(F.transform(at, lambda x: x["col"]))
    placed = settled(boxed.withColumns({"__r": low_row, "__c": low_col}))
    moved = settled(placed.withColumn("__at", F.transform(at, lambda x: F.struct((x["row"] - F.col("__r")).alias("row"), (x["col"] - F.col("__c")).alias("col")))))
    w, h = F.col("w"), F.col("h")
    ways = (lambda x: (x["row"], x["col"]), lambda x: (x["col"], h - 1 - x["row"]), lambda x: (h - 1 - x["row"], w - 1 - x["col"]), lambda x: (w - 1 - x["col"], x["row"]))

    def bits(way: Callable[[Column], tuple[Column, Column]]) -> Column:
        return F.sort_array(F.transform("__at", lambda x: (way(x)[0] * F.col(stride) + way(x)[1]).cast("int")), asc=False)

    made = settled(moved.withColumns({f"__b{i}": bits(way) for i, way in enumerate(ways)}))
    known = F.size(at) > 0
    return made.withColumns(
        {
            "normal": F.col("__b0"),
            "canonical": F.least("__b0", "__b1", "__b2", "__b3"),
            "s90": F.when(known, (w == h) & (F.col("__b0") == F.col("__b1"))),
            "s180": F.when(known, F.col("__b0") == F.col("__b2")),
            "max_dim": F.greatest("w", "h"),
        }
    ).withColumn("weight", F.when(F.col("s90"), 1).when(F.col("s180"), 2).when(known, 4)).drop("__at", "__r", "__c", "__b0", "__b1", "__b2", "__b3")


def _boards(records: list[bytes], stride: int) -> np.ndarray:
    """Boards of 0 and 1 with a free rim: record x row x column."""
    longest = max(map(len, records))
    raw = np.frombuffer(b"".join(r.ljust(longest, b"\0") for r in records), np.uint8).reshape(len(records), longest)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    rows = -(-bits.shape[1] // stride)
    padded = np.zeros((len(records), rows * stride), bool)
    padded[:, : bits.shape[1]] = bits
    return np.pad(padded.reshape(len(records), rows, stride), ((0, 0), (1, 1), (1, 1)))


def _spread(now: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Floods all boards at once from where they are set, until nothing moves; boards that are done drop out."""
    open_ = np.arange(len(now))
    while len(open_):
        x = now[open_]
        new = x.copy()
        new[:, 1:] |= x[:, :-1]
        new[:, :-1] |= x[:, 1:]
        new[:, :, 1:] |= x[:, :, :-1]
        new[:, :, :-1] |= x[:, :, 1:]
        new &= inside[open_]
        now[open_] = new
        open_ = open_[(new != x).any(axis=(1, 2))]
    return now


def _floods(records: list[bytes], stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether all cells hang together (not if there are none), and whether some empty cell is shut in."""
    at = _boards(records, stride)
    flat = at.reshape(len(at), -1)
    seed = np.zeros_like(flat)
    seed[np.arange(len(flat)), flat.argmax(axis=1)] = True
    reached = _spread(seed.reshape(at.shape) & at, at)
    rim = np.zeros_like(at)
    rim[:, 0] = True
    return flat.any(axis=1) & (reached == at).all(axis=(1, 2)), (_spread(rim, ~at) != ~at).any(axis=(1, 2))


#: Cells of all boards that are flooded at once.
_AT_ONCE = 4_000_000
_KIND = pa.struct([("connected", pa.bool_()), ("flooded", pa.bool_())])


def _wholes(records: pa.Array, strides: pa.Array) -> pa.Array:
    out: list[dict | None] = [None] * len(records)
    by: dict[int, list[tuple[int, bytes]]] = {}
    for i, (text, stride) in enumerate(zip(records.to_pylist(), strides.to_pylist(), strict=True)):
        try:
            if stride and stride > 0:
                by.setdefault(stride, []).append((i, bytes.fromhex(text)))
        except (TypeError, ValueError):
            continue
    for stride, some in by.items():
        some.sort(key=lambda x: len(x[1]))  # boards of like size together
        start = 0
        while start < len(some):
            end = start + 1
            while end < len(some) and (end + 1 - start) * 8 * (len(some[end][1]) + 4 * stride) <= _AT_ONCE:
                end += 1
            part = some[start:end]
            for (i, _), hangs, holed in zip(part, *_floods([r for _, r in part], stride), strict=True):
                out[i] = {"connected": bool(hangs), "flooded": bool(holed)}
            start = end
    return pa.array(out, _KIND)


def whole(record: Column, stride: Column) -> Column:
    """What takes floods: whether all cells hang together and some empty cell is shut in; null where the record can't be read. On Arrow batches,
    where all boards of a stride take a step at once."""
    return F.arrow_udf(_wholes, "connected boolean, flooded boolean")(record, stride)
