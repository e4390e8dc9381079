"""Shapes as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cellforge.functions import geometry as g


def as_text(mask: Column, w: Column, h: Column) -> Column:
    """``[size=S WxH] (column,row) ...``, cells by place."""
    listed = F.concat_ws(" ", F.transform(g.cells(mask), lambda x: F.format_string("(%d,%d)", x["col"], x["row"])))
    return F.format_string("[size=%d %dx%d] %s", g.size(mask), w, h, listed)


def as_picture(mask: Column, w: Column, h: Column, full: str = "██", blank: str = "  ") -> Column:
    """One line per row, the highest row first."""

    def line(r: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), w - 1), lambda c: F.when(F.call_function("getbit", mask, r * g.SIDE + c) == 1, full).otherwise(blank)), "")

    return F.when(h > 0, F.array_join(F.transform(F.sequence(h - 1, F.lit(0), F.lit(-1)), line), "\n")).when(h == 0, "")
