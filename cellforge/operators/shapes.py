"""Classifying, counting, indexing and checking shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellforge.functions import geometry as g, wide
from cellforge.session import cut, width


def classified(df: DataFrame, mask: str = "mask") -> DataFrame:
    """``g.with_canonical`` and ``cells_n``, ``chi`` and ``hole`` (the last two mean something for connected shapes only)."""
    return g.settled(g.with_canonical(df, mask).withColumns({"cells_n": g.size(F.col("normal")), "chi": g.euler(F.col("normal")), "hole": g.euler(F.col("normal")) <= 0}))


def one_sided(df: DataFrame, mask: str = "mask") -> DataFrame:
    """The distinct shapes up to moving and turning: ``canonical`` and its class. The canonical masks are made distinct before
    they are classified again, so that the shuffle carries one number per shape."""
    least = g.with_canonical(df.select(F.col(mask).alias("mask")).where(F.col("mask").isNotNull() & (F.col("mask") != 0))).select(F.col("canonical").alias("mask")).distinct()
    return classified(least)


def bins(shapes: DataFrame) -> DataFrame:
    """Per longest side and hole: ``one_sided``, ``fixed`` (each shape counted in its different turns), ``sym180`` and ``sym90`` (fixed ones that a half or quarter turn keeps)."""
    fixed = F.col("weight").cast("bigint")
    return shapes.groupBy("max_dim", "hole").agg(
        F.count(F.lit(1)).alias("one_sided"),
        F.sum(fixed).alias("fixed"),
        F.sum(F.when(F.col("s180"), fixed).otherwise(0)).alias("sym180"),
        F.sum(F.when(F.col("s90"), fixed).otherwise(0)).alias("sym90"),
    )


def cumulative(counted: DataFrame) -> DataFrame:
    """From exact longest sides to all up to n, per class: ``n``, ``hole`` and the four counts. Few rows by nature: sides x 2."""
    w = Window.partitionBy("hole").orderBy("max_dim").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select(F.col("max_dim").alias("n"), "hole", *(F.sum(c).over(w).alias(c) for c in ("one_sided", "fixed", "sym180", "sym90")))


def burnside(fixed: Column, sym180: Column, sym90: Column) -> Column:
    """(fixed + sym180 + 2 sym90) / 4; an error where it doesn't divide."""
    total = fixed + sym180 + 2 * sym90
    return F.when(total % 4 == 0, (total / 4).cast("bigint")).otherwise(F.raise_error(F.lit("the turns' sum isn't divisible by 4")).cast("bigint"))


def duplicates(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Keys that more than one row has: ``copies``, ``findings`` (copies - 1) and the first row. Combined before the shuffle, so a hot key costs one row per split."""
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(row).alias("first_row")).where("copies > 1").withColumn("findings", F.col("copies") - 1)


def indexed(df: DataFrame, order: list[str], out: str = "global_index") -> DataFrame:
    """Numbers the rows from 0 by ``order`` without one task holding them all.

    The rows are range-partitioned and written; each partition's count gives the next one's start, and rows are numbered within
    theirs. Rows equal in ``order`` are numbered in an undefined order.
    """
    parts = cut(df.repartitionByRange(width(df.sparkSession), *order).withColumn("__part", F.spark_partition_id()), "indexed")
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # as many rows as partitions
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__at", inside).join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__at")).drop("__part", "__start", "__at")


def index_range(df: DataFrame, first: int | None = None, last: int | None = None, limit: int | None = None, hole: bool | None = None, index: str = "global_index") -> DataFrame:
    """Rows ``first`` to ``last``, counted from 1 and both included, or the first ``limit``; the class is filtered after the range."""
    if limit is not None:
        first, last = 1, limit
    if first is not None and first < 1 or last is not None and first is not None and last < first:
        raise ValueError("the range is empty")
    out = df
    if first is not None:
        out = out.where(F.col(index) >= first - 1)
    if last is not None:
        out = out.where(F.col(index) <= last - 1)
    return out if hole is None else out.where(F.col("hole") == hole)


def checked(df: DataFrame, mask: str, w: str, h: str, size: str, max_dim: str, hole: str) -> DataFrame:
    """Per record what of its declared fields disagrees with its mask: one boolean per rule, null where the field is.

    ``not_empty``, ``at_origin``, ``w_right``, ``h_right``, ``size_right``, ``max_dim_right``, ``connected``, ``canonical_right``, ``hole_right`` (by Euler's
    number) and ``flood_agrees`` (that with the flood's answer).
    """
    kept = df.withColumnsRenamed({w: "__w", h: "__h"})
    shaped = classified(kept, mask).drop("cells_n")
    x = F.col(mask)
    return shaped.select(
        *[c for c in df.columns if c not in (w, h)],
        (x != 0).alias("not_empty"),
        (F.col("normal") == x).alias("at_origin"),
        (F.col("w") == F.col("__w")).alias("w_right"),
        (F.col("h") == F.col("__h")).alias("h_right"),
        (g.size(x) == F.col(size)).alias("size_right"),
        (F.col("max_dim") == F.col(max_dim)).alias("max_dim_right"),
        g.connected(x).alias("connected"),
        (F.col("canonical") == x).alias("canonical_right"),
        (F.col("hole") == F.col(hole) if hole != "hole" else F.lit(None).cast("boolean")).alias("hole_right"),
        (g.has_hole_by_flood(x) == F.col("hole")).alias("flood_agrees"),
    )


def checked_wide(df: DataFrame, record: str, stride: str, w: str, h: str, size: str, max_dim: str, hole: str) -> DataFrame:
    """``checked`` for the stored records of wider exports. A record that can't be read, or has no stride, leaves its rules null."""
    named = df.withColumnsRenamed({w: "__dw", h: "__dh"}).withColumns({"__cells": wide.cells(F.col(record), F.col(stride)), "__whole": wide.whole(F.col(record), F.col(stride))})
    facts = g.settled(wide.turned(named, "__cells", stride))
    at = F.col("__cells")
    here = F.sort_array(F.transform(at, lambda x: (x["row"] * F.col(stride) + x["col"]).cast("int")), asc=False)
    made = facts.withColumn("__hole", wide.euler(at) <= 0)
    told = F.col("__whole").isNotNull()
    rules = {
        "not_empty": F.size(at) > 0, "at_origin": here == F.col("normal"), "w_right": F.col("w") == F.col("__dw"), "h_right": F.col("h") == F.col("__dh"),
        "size_right": F.size(at) == F.col(size), "max_dim_right": F.col("max_dim") == F.col(max_dim), "connected": F.col("__whole.connected"),
        "canonical_right": here == F.col("canonical"), "hole_right": F.col("__hole") == F.col(hole), "flood_agrees": F.col("__whole.flooded") == F.col("__hole"),
    }
    return made.select(*[c for c in df.columns if c not in (w, h)], *(F.when(told, x).alias(r) for r, x in rules.items()))


RULES = ("not_empty", "at_origin", "w_right", "h_right", "size_right", "max_dim_right", "connected", "canonical_right", "hole_right", "flood_agrees")


def verdict(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group the records and how many break each rule; a rule that can't be told isn't broken."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_records"), *(F.sum((~F.col(r)).cast("bigint")).alias(f"bad_{r}") for r in RULES)).na.fill(0)


def layout(n: Column) -> tuple[Column, Column]:
    """The stride and the record's bytes for side n."""
    stride = F.greatest(F.lit(8), n)
    return stride, F.greatest(F.lit(8), F.ceil(n * stride / 8).cast("int"))


#: A stream's path. A fixed value of the format.
STREAM_PATH = r"^(no_holes|with_holes)/n([0-9]{2,})_fixed(\.zip)?$"


def stream_faults(streams: DataFrame) -> DataFrame:
    """Per stream entry the rules of a manifest that it breaks, as booleans, null fields breaking those on them."""
    side = F.regexp_extract("stream_path", STREAM_PATH, 2)
    category = F.regexp_extract("stream_path", STREAM_PATH, 1)
    path_ok = F.coalesce(F.col("stream_path").rlike(STREAM_PATH), F.lit(False))
    number = F.when(side != "", side.try_cast("int"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("dataset_id", "max_dimension", "has_hole")) > 1
    return streams.select(
        "stream_id",
        (~path_ok).alias("bad_path"),
        (path_ok & (side != F.lpad(number.cast("string"), F.greatest(F.lit(2), F.length(number.cast("string"))), F.lit("0")))).alias("bad_padding"),
        (path_ok & ~F.coalesce(number == F.col("max_dimension"), F.lit(False))).alias("bad_side"),
        (path_ok & ~F.coalesce((category == "with_holes") == F.col("has_hole"), F.lit(False))).alias("bad_class"),
        (~F.coalesce(F.col("record_count").rlike("^[1-9][0-9]*$"), F.lit(False))).alias("bad_count"),
        twice.alias("repeated"),
    )


def landmark_check(landmarks: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per export: landmarks, those whose mask is among the export's shapes, and those that aren't.

    Distinct masks are joined, so repeated records on either side don't multiply.
    """
    logged = shapes.where("cells is not null").select("dataset_id", F.col("cells").alias("mask")).distinct().withColumn("found", F.lit(True))
    return landmarks.where("mask is not null").join(logged, ["dataset_id", "mask"], "left").groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_landmarks"), F.count("found").alias("n_found"), F.sum(F.col("found").isNull().cast("bigint")).alias("n_missing")
    )


def landmark_summary(landmarks: DataFrame, group: list[str]) -> DataFrame:
    """Per group: shapes, mean size to one digit, holes and their share, and the least and greatest size, width and height."""
    shaped = classified(landmarks.where("mask is not null"))
    n = F.count(F.lit(1))
    held = F.sum(F.col("hole").cast("bigint"))
    return shaped.groupBy(*group).agg(
        n.alias("n"), F.round(F.avg("cells_n"), 1).alias("avg_size"), held.alias("n_holes"), F.round(held * 100 / n, 1).alias("hole_percent"),
        F.min("cells_n").alias("min_size"), F.max("cells_n").alias("max_size"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.min("h").alias("min_h"), F.max("h").alias("max_h"),
    )


def histogram(landmarks: DataFrame, group: str) -> DataFrame:
    """Per group and size the count, and a bar of 40 signs for the greatest, 1 at least. At most 64 sizes in a group."""
    counts = landmarks.where("mask is not null").select(group, g.size(F.col("mask")).alias("size")).groupBy(group, "size").agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(Window.partitionBy(group))
    return counts.withColumn("bar", F.repeat(F.lit("█"), F.greatest(F.lit(1), F.floor(F.col("n") * 40 / top)).cast("int")))


def children(shapes: DataFrame, n: int) -> DataFrame:
    """The distinct one-sided shapes that come of adding a cell to a given one, within n x n: ``mask`` and how many given shapes lead to it (``parents``)."""
    grown = g.grown(shapes.select("mask"), "mask", n)
    turned = g.with_canonical(grown.select(F.col("mask").alias("parent"), F.col("grown").alias("mask")))
    return turned.select("parent", F.col("canonical").alias("mask")).distinct().groupBy("mask").agg(F.count(F.lit(1)).alias("parents"))


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """``points`` with ``out``: of the marks of their key the last whose ``at`` isn't after theirs, as a struct of the marks' other columns; null where there is none.

    Both are sorted together in range partitions, in which the last mark is carried along, and each partition's last mark is handed on
    to the next; so a key that holds a third of the rows is spread. Of marks equal in ``at`` the last by their other columns counts. Points without a
    key or place get none.
    """
    spark, rest = points.sparkSession, [c for c in marks.columns if c not in (*keys, at)]
    place = [F.struct(*keys).alias("__key"), F.col(at).alias("__at")]
    left = points.select(*place, F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__point"), F.lit(None).cast(marks.select(F.struct(*rest).alias("m")).schema[0].dataType).alias("__mark"))
    right = marks.dropna(subset=[*keys, at]).select(*place, F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["__point"].dataType).alias("__point"), F.struct(*rest).alias("__mark"))
    order = ["__at", "__kind", "__mark"]
    parts = cut(left.unionByName(right).repartitionByRange(width(spark), "__key", *order).withColumn("__part", F.spark_partition_id()), "as_of")
    before = Window.partitionBy("__key", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("__here", F.last("__mark", ignorenulls=True).over(before)).where("__kind = 1")
    # per key at most one row for each part
    tails = parts.groupBy("__key", "__part").agg(F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.struct("__at", "__mark"))).alias("tail"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    handed = tails.withColumn("__before", F.last("tail", ignorenulls=True).over(earlier)).where("__before is not null").select("__key", "__part", "__before")
    joined = rows.join(handed, ["__key", "__part"], "left")
    known = F.when(F.col("__at").isNotNull(), F.coalesce("__here", "__before"))
    return joined.select("__point.*", known.alias(out))


def asked_chunks(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each asked range [first, last] with the chunks [start, start + count) that it overlaps, and how many records of each it wants.

    Chunks of one key follow each other without overlapping. The chunks in which a range begins and ends are searched as of its two ends; those
    between are joined by their number, so a range costs as many rows as it has chunks.
    """
    keys = [c for c in asked.columns if c in chunks.columns]
    full = chunks.where("count > 0")
    place = Window.partitionBy(*keys).orderBy("start")  # a key has few chunks
    numbered = cut(full.withColumn("number", F.row_number().over(place)), "chunks")
    marks = numbered.select(*keys, F.col("start").alias("__place"), "number")
    began = as_of(asked.withColumn("__place", F.col("first")), marks, keys, "__place", "a").withColumn("__place", F.col("last"))
    both = as_of(began, marks, keys, "__place", "b").drop("__place")
    each = both.where("b is not null").withColumn("number", F.explode(F.sequence(F.coalesce("a.number", F.lit(1)), F.col("b.number")))).drop("a", "b")
    low, high = F.greatest("first", "start"), F.least(F.col("last"), F.col("start") + F.col("count") - 1)
    return each.join(numbered, [*keys, "number"]).where(low <= high).withColumn("wanted", high - low + 1).drop("number")


def indexed_within(df: DataFrame, group: str, order: list[str], out: str = "global_index") -> DataFrame:
    """``indexed`` from 0 in each group, without a task that holds one."""
    numbered = cut(indexed(df, [group, *order], out), "numbered")
    starts = numbered.groupBy(group).agg(F.min(out).alias("__start"))
    return numbered.join(starts, group).withColumn(out, F.col(out) - F.col("__start")).drop("__start")


def extracted(asked: DataFrame, numbered: DataFrame, group: str, mask: str, record: str) -> DataFrame:
    """Each asked (group, ``global_index``) with the ``record`` that stands there as ``record_mask`` (null where none does) and whether it is the ``mask`` that was
    expected, null where there is nothing to compare."""
    there = numbered.select(group, "global_index", F.col(record).alias("record_mask"), F.lit(True).alias("__there"))
    joined = asked.join(there, [group, "global_index"], "left")
    return joined.withColumn("same", F.when(F.col("__there"), F.col(mask) == F.col("record_mask"))).drop("__there")


def totals(rows: DataFrame, group: str, record: str, hole: str) -> DataFrame:
    """Per group how many records it has, how many of them are different, and how many of those have a hole, none, or don't say."""
    once = rows.groupBy(group, record).agg(F.count(F.lit(1)).alias("n"), F.max(hole).alias("hole"))
    return once.groupBy(group).agg(
        F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.coalesce(F.col("hole").cast("bigint"), F.lit(0))).alias("n_holes"),
        F.sum(F.coalesce((~F.col("hole")).cast("bigint"), F.lit(0))).alias("n_without"), F.sum(F.col("hole").isNull().cast("bigint")).alias("n_unsaid"),
    )


def rooms(landmarks: DataFrame) -> DataFrame:
    """Landmarks as assets: their order, index, stored record, box, size and hole."""
    shaped = classified(landmarks.where("mask is not null").select("landmark_id", "label", "selection_order", "global_index", "mask"))
    return shaped.select(
        "landmark_id", "label", "selection_order", "global_index", "mask", g.to_hex(F.col("mask")).alias("record"), F.col("w").alias("width"), F.col("h").alias("height"), F.col("cells_n").alias("size"), "hole"
    )


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two sets of shapes has and the other hasn't: the columns and ``side`` (``left`` or ``right``), each row once."""
    return a.distinct().subtract(b).withColumn("side", F.lit("left")).unionByName(b.distinct().subtract(a).withColumn("side", F.lit("right")))
