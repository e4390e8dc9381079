"""Differences between two copies of a table (problem 5).

Both copies are brought to one notation and one row per key, cogrouped by hash bucket as Arrow
tables, aligned by sorted search and compared column by column through null-aware masks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellforge.session import cut

#: Rows of both copies that one bucket holds on average; a bucket is one task's Arrow table.
BUCKET_ROWS = 100_000

#: Blanks, and the signs that only group digits.
_GROUPING = r"[\s\u00a0\u202f\u2009,_'’]"


def as_number(col: Column) -> Column:
    """A declared count in one notation: the number's plain digits.

    A sign, padding zeros, grouping signs, blanks and a fraction of zeros don't matter. Text that is
    no number stays as it is, trimmed.
    """

    def moved(p: Column) -> Column:
        """The digits with zeros enough on either side for the point to move, so that no number goes through a double."""
        shift = F.coalesce(F.nullif(p["exponent"], F.lit("")).cast("int"), F.lit(0))
        left = F.concat(F.repeat(F.lit("0"), F.greatest(-shift, F.lit(0))), p["whole"])
        right = F.concat(p["fraction"], F.repeat(F.lit("0"), F.greatest(shift, F.lit(0))))
        return F.struct(F.concat(left, right).alias("digits"), (F.length(left) + shift).alias("point"))

    def cut_apart(p: Column) -> Column:
        whole = F.regexp_replace(F.substring(p["digits"], F.lit(1), p["point"]), r"^0+(?=\d)", "")
        fraction = F.regexp_replace(F.substring(p["digits"], p["point"] + 1, F.length(p["digits"])), "0+$", "")
        return F.concat(F.when(whole == "", "0").otherwise(whole), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))

    def written(bare: Column) -> Column:
        names = ("sign", "whole", "fraction", "exponent")
        parts = F.struct(*(F.regexp_extract(bare, r"^([+-]?)(\d+)(?:\.(\d*))?(?:[eE]([+-]?\d{1,3}))?$", i + 1).alias(n) for i, n in enumerate(names)))
        number = lambda p: _let(_let(moved(p), cut_apart), lambda x: F.concat(F.when((p["sign"] == "-") & (x != "0"), "-").otherwise(""), x))
        return _let(parts, lambda p: F.when(p["whole"] != "", number(p)))

    text = F.trim(col.cast("string"))
    bare = F.regexp_replace(text, _GROUPING, "")
    return F.when(text.rlike(r"^[1-9]\d*$"), text).otherwise(F.coalesce(_let(bare, written), text))


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def as_path(col: Column) -> Column:
    """A stream path in one notation: one forward slash between names, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(col), r"[\\/]+", "/"), r"^(\./)+|^/|/$", "")


def as_is(col: Column) -> Column:
    return col.cast("string")


def tidy(df: DataFrame, key: str, columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Key and columns in one notation. The array keeps them together, so that later mentions don't compute them again."""
    made = F.struct(F.col(key).cast("bigint").alias("__key"), *(make(F.col(c)).alias(c) for c, make in columns.items()))
    return df.select(F.inline(F.array(made)))


def one_per_key(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key: its row's values, and whether the key has ``many`` unlike rows, of which the values say nothing.

    Equal repetitions leave no trace. The aggregation is combined before the shuffle, so a key that
    holds a third of the rows costs no more than another.
    """
    row = F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())))
    return rows.groupBy("__key").agg(*(F.min(c).alias(c) for c in columns), (F.min(row) != F.max(row)).alias("__many"))


def _unlike_rows(sides: list[DataFrame], keys: DataFrame, columns: list[str]) -> DataFrame:
    """The diffs of keys that have unlike rows on a side, by sets: a column differs where its values do. Where the rows differ and no
    single column does, since only what stands together is another, every column that isn't the same in all rows of one side does.

    Rows, then (key, column, value), are the grouping keys, so a key of any number of rows is spread; it comes down to
    one row for each column.
    """
    both = [s.join(keys, "__key", "left_semi").withColumn("__side", F.lit(1 << i)) for i, s in enumerate(sides)]
    rows = both[0].unionByName(both[1]).groupBy("__key", *columns).agg(F.bit_or("__side").alias("__side"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("diff"), F.col(c).alias("value")) for c in columns))).alias("x")
    each = rows.select("__key", F.col("__side").alias("side"), (F.col("__side") != 3).cast("int").alias("alone"), pairs).select("__key", "side", "alone", "x.*")
    values = each.groupBy("__key", "diff", "value").agg(F.bit_or("side").alias("side"), F.max("alone").alias("alone"))
    least = lambda side: F.min(F.when(F.col("side").bitwiseAND(F.lit(side)) != 0, F.col("value")))
    apart = F.max((F.col("side") != 3).cast("int"))
    told = values.groupBy("__key", "diff").agg(apart.alias("apart"), (F.sum("alone") > 1).alias("varied"), least(1).alias("primary_value"), least(2).alias("mirror_value"))
    some = told.groupBy("__key").agg(F.max("apart").alias("any_apart"))
    hit = told.join(some, "__key").where("apart = 1 or (any_apart = 0 and varied)")
    return hit.select(F.col("__key").alias("row_key"), "diff", "primary_value", "mirror_value")


#: Marks a key whose rows are compared as sets; never in the result.
_MANY = "\0many"
_OUT = pa.schema([("row_key", pa.int64()), ("diff", pa.string()), ("primary_value", pa.string()), ("mirror_value", pa.string())])


def _aligned(keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place in the sorted ``others`` and whether it is there."""
    at = np.searchsorted(others, keys)
    there = np.zeros(len(keys), bool)
    inside = at < len(others)
    there[inside] = others[at[inside]] == keys[inside]
    return at, there


def _compare(columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    import pyarrow.compute as pc

    def differs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
        unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        return unequal | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))

    def rows(keys: np.ndarray, diff: str, left: object = None, right: object = None) -> pa.Table:
        n = len(keys)
        empty = pa.nulls(n, pa.string())
        return pa.table([pa.array(keys, pa.int64()), pa.array([diff] * n, pa.string()), empty if left is None else left, empty if right is None else right], schema=_OUT)

    def split(t: pa.Table) -> tuple[pa.Table, int]:
        keyed = t.filter(pc.is_valid(t["__key"])).sort_by("__key")
        return keyed, t.num_rows - keyed.num_rows

    def compare(primary: pa.Table, mirror: pa.Table) -> pa.Table:
        (a, a_null), (b, b_null) = split(primary), split(mirror)
        ka, kb = a["__key"].to_numpy(), b["__key"].to_numpy()
        at, there = _aligned(ka, kb)
        _, back = _aligned(kb, ka)
        out = [rows(ka[~there], "missing_in_mirror"), rows(kb[~back], "missing_in_primary")]
        for n, diff in ((a_null, "missing_in_mirror"), (b_null, "missing_in_primary")):
            if n:  # nothing can be aligned with a null key
                out.append(pa.table([pa.nulls(1, pa.int64()), pa.array([diff]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string())], schema=_OUT))
        left, right = a.filter(pa.array(there)), b.take(pa.array(at[there]))
        single = ~(left["__many"].to_numpy() | right["__many"].to_numpy())
        out.append(rows(left["__key"].to_numpy()[~single], _MANY))
        for c in columns:
            bad = differs(left[c], right[c]) & single
            if bad.any():
                mask = pa.array(bad)
                hit = left.filter(mask)
                out.append(rows(hit["__key"].to_numpy(), c, hit[c].combine_chunks(), right.filter(mask)[c].combine_chunks()))
        return pa.concat_tables(x.cast(_OUT) for x in out)

    return compare


def table_diff(primary: DataFrame, mirror: DataFrame, key: str, columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows missing on either side and fields that differ, one row each.

    Returns ``row_key``, ``diff`` (``missing_in_mirror``, ``missing_in_primary`` or a column's name)
    and the two values compared, in the common notation. ``columns`` gives each compared column and
    how to bring it to one notation; other columns, and columns that only one side has, aren't read.

    A null differs from a value and not from a null. Repeated equal rows of a key don't matter; where
    one side repeats a key with unlike values, the sides are compared as sets of rows (``_unlike_rows``). Rows with a
    null key are reported once per side as missing on the other. An empty side makes every key of the other missing; two empty ones give an
    empty result. Texts are compared whole, whatever their length.
    """
    names = list(columns)
    sides = [tidy(side, key, columns) for side in (primary, mirror)]
    rows = primary.count() + mirror.count()
    buckets = max(primary.sparkSession.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    bucketed = [one_per_key(s, names).withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int")).groupBy("__bucket") for s in sides]
    found = cut(bucketed[0].cogroup(bucketed[1]).applyInArrow(_compare(names), "row_key bigint, diff string, primary_value string, mirror_value string"), "diffs")
    many = found.where(F.col("diff") == _MANY)
    if many.isEmpty():
        return found
    return found.where(F.col("diff") != _MANY).unionByName(_unlike_rows(sides, many.select(F.col("row_key").alias("__key")), names))
