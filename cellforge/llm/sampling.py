"""Sample matching target category proportions (problem 3).

Weights are raked by iterative proportional fitting over the category margins, records are drawn by
weighted exponential keys, minimums are repaired, and what could not be met is reported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cellforge.session import cut, width

#: Slices of the key range used to find a category's cut without ranking all of it.
SLICES = 16_384
_EPS = 1e-9


@dataclass(frozen=True)
class Plan:
    """Column names of a target table and the records it draws from."""

    plan: str = "plan_id"
    group: str = "dataset_id"
    margins: tuple[str, ...] = ("max_dimension", "has_hole")
    share: str = "target_share"
    unit: str = "share_unit"
    minimum: str = "min_rows"
    size: str = "sample_size"
    record: str = "cells"
    row: str = "record_id"
    category: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "category", (self.group, *self.margins))


def needs(targets: DataFrame, p: Plan = Plan()) -> DataFrame:
    """Each plan's categories with their ``share`` of the sample and ``need`` in rows.

    Equal repeated rows count once; rows of one category that differ add up in share and take the larger
    minimum. ``share``: as it stands for unit ``fraction``, a hundredth for ``percent``, for ``weight`` the part
    of the plan's sum; an unknown unit or a null share leaves only the minimum. Need is the larger of the
    minimum and share x size rounded up (less a billionth, against the noise of binary fractions).
    """
    rows = targets.select(p.plan, *p.category, p.share, p.unit, p.minimum, p.size).distinct()
    unit = F.lower(F.trim(p.unit))
    # a plan has few categories, so its window is small
    total = F.sum(F.when(unit == "weight", F.col(p.share))).over(Window.partitionBy(p.plan))
    share = (
        F.when(unit == "fraction", F.col(p.share))
        .when(unit == "percent", F.col(p.share) / 100)
        .when((unit == "weight") & (total > 0), F.col(p.share) / total)
    )
    one = rows.withColumn("share", share).groupBy(p.plan, *p.category).agg(
        F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"),
        F.coalesce(F.max(p.minimum), F.lit(0)).cast("bigint").alias("minimum"),
        F.coalesce(F.max(p.size), F.lit(0)).cast("bigint").alias("size"),
    )
    return one.withColumn("need", F.greatest("minimum", F.ceil(F.col("share") * F.col("size") - _EPS)))


def candidates(records: DataFrame, targets: DataFrame, p: Plan = Plan()) -> DataFrame:
    """The distinct records of the categories that some plan asks for, each with its least row id.

    A category is met by exactly its own values; a null in a record, its group or a margin meets none.
    The grouping is combined before the shuffle, so repeated records of a hot group fold in the splits.
    """
    wanted = targets.select(*p.category).distinct()
    rows = records.select(*p.category, p.record, p.row).where(F.col(p.record).isNotNull())
    return rows.join(wanted, list(p.category), "left_semi").groupBy(*p.category, p.record).agg(F.min(p.row).alias(p.row))


def rake(share: np.ndarray, available: np.ndarray, margins: list[np.ndarray], size: float, rounds: int = 200) -> np.ndarray:
    """Expected rows per category by iterative proportional fitting, from a weight of 1 for every record.

    The categories are scaled to their own wanted rows first, as far as they have them; then each margin's classes and the total are scaled
    in turn to their wanted sums, between those rows and what is available, until a whole turn moves nothing. So what a category
    lacks is made up by others, of its classes first, and is taken from none that are met.
    """
    want = share * size
    least = np.minimum(want, available)
    x = available.astype(float)
    x *= np.divide(least, x, out=np.zeros_like(x), where=x > 0)
    for _ in range(rounds):
        before = x.copy()
        for classes in [*margins, np.zeros(len(want), int)]:
            target, now = np.bincount(classes, want), np.bincount(classes, x)
            factor = np.divide(target, now, out=np.ones_like(now), where=now > 0)
            x = np.clip(x * factor[classes], least, available)
        if np.abs(x - before).max(initial=0) < 1e-6:
            break
    for _ in x:  # margins that can't all be met leave the total open: what has rows left takes it, in proportion
        room, left = (x < available - _EPS) & (x > 0), want.sum() - x.sum()
        if left <= _EPS or not room.any():
            break
        x = np.where(room, np.minimum(available, x * (1 + left / x[room].sum())), x)
    return x


def repair(quota: np.ndarray, minimum: np.ndarray, available: np.ndarray, size: int) -> np.ndarray:
    """Lifts categories to their minimums, as far as there are rows, and takes the surplus from the rest in proportion."""
    floor = np.minimum(minimum, available)
    quota = np.maximum(quota, floor)
    over, room = int(quota.sum()) - size, quota - floor
    if over > 0 and room.sum() > 0:
        over = min(over, int(room.sum()))
        less = np.floor(room * (over / room.sum())).astype(np.int64)
        for i in np.argsort(-(room - less), kind="stable")[: over - int(less.sum())]:
            less[i] += less[i] < room[i]
        quota = quota - less
    return quota


def _raked(p: Plan) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(p.category)).reset_index(drop=True)
        available = rows["available"].to_numpy(np.int64)
        margins = [pd.factorize(rows[m], use_na_sentinel=False)[0] for m in p.margins]
        rows["raked"] = rake(rows["share"].to_numpy(float), available, margins, int(rows["size"].max()))
        rows["weight"] = np.divide(rows["raked"], available, out=np.zeros(len(rows)), where=available > 0)
        return rows

    return run


def _quotas(rows: pd.DataFrame) -> pd.DataFrame:
    """What the keys drew, with no category under what was raked for its own target (rounded up) nor under its minimum."""
    rows = rows.reset_index(drop=True)
    size, available = int(rows["size"].max()), rows["available"].to_numpy(np.int64)
    own = np.ceil(np.minimum(rows["raked"], rows["share"] * size) - _EPS).to_numpy(np.int64)
    rows["quota"] = repair(rows["by_key"].to_numpy(np.int64), np.maximum(own, rows["minimum"].to_numpy(np.int64)), available, size)
    return rows


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {more}"


def drawn(targets: DataFrame, records: DataFrame, p: Plan = Plan(), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Every plan's categories with ``raked`` rows, ``weight``, rows drawn ``by_key`` and, repaired, their ``quota``; and the sample.

    Each record gets the key -ln(u)/weight with u hashed from (seed, plan, record). A plan draws the smallest keys of all its
    categories together until its size is reached; then categories under their raked targets or minimums are filled up from their next keys, and those above give theirs back.
    The sample has each category's ``quota`` smallest keys; ties go by the record.

    Nothing is ranked in one task: the key range is cut into slices and counted, a plan's cut falls between two slices, and only the
    slice where a category's quota ends is ranked. Categories are joined with their records in salted parts.
    """
    pool = cut(candidates(records, targets, p), "pool")
    counts = pool.groupBy(*p.category).agg(F.count(F.lit(1)).alias("available"))
    asked = needs(targets, p).join(counts, list(p.category), "left").withColumn("available", F.coalesce("available", F.lit(0)))
    # few bytes but some work a plan: a fixed number of partitions, which isn't coalesced
    by_plan = lambda df: df.repartition(width(targets.sparkSession), p.plan).groupBy(p.plan)
    raked = cut(by_plan(asked).applyInPandas(_raked(p), _schema(asked, "raked double, weight double")), "raked")

    salts = 16
    at = [p.plan, *p.category]
    hashed = F.xxhash64(F.lit(seed), F.col(p.plan), F.col(p.record))
    # the top 53 bits, in (0, 1)
    u = (F.shiftrightunsigned(hashed, 11) + F.lit(0.5)) / F.lit(2.0**53)
    salted = pool.withColumn("salt", F.pmod(F.xxhash64(p.record), F.lit(salts)).cast("int"))

    def keyed(plans: DataFrame, *more: str) -> DataFrame:
        each = plans.select(*at, "weight", *more).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        key = -F.log(u) / F.col("weight")
        return salted.join(each, [*p.category, "salt"]).withColumn("sort_key", key).withColumn("slice", F.floor((1 - F.exp(-F.col("sort_key"))) * SLICES).cast("int"))

    sliced = cut(keyed(raked.where("weight > 0"), "size").groupBy(*at, "size", "slice").agg(F.count(F.lit(1)).alias("n")), "sliced")
    # at most SLICES rows for each of a plan's few categories
    before = F.sum("n").over(Window.partitionBy(p.plan).orderBy("slice").rangeBetween(Window.unboundedPreceding, -1))
    by_key = sliced.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < F.col("size")).groupBy(*at).agg(F.sum("n").alias("by_key"))
    held = raked.join(by_key, at, "left").withColumn("by_key", F.coalesce("by_key", F.lit(0)))
    quotas = cut(by_plan(held).applyInPandas(_quotas, _schema(held, "quota bigint")), "quotas")

    within = F.sum("n").over(Window.partitionBy(*at).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    asked_for = quotas.where("quota > 0 and weight > 0").select(*at, "weight", "quota")
    left = F.col("quota") - F.coalesce(within, F.lit(0))
    open_ = sliced.join(asked_for.drop("weight"), at).withColumn("left", left).where("left > 0").select(*at, "slice", "left")
    rank = F.row_number().over(Window.partitionBy(*at, "slice").orderBy("sort_key", p.record))
    rows = keyed(asked_for).join(open_, [*at, "slice"]).withColumn("rank", rank).where(F.col("rank") <= F.col("left"))
    return quotas, rows.select(*at, p.record, p.row, "sort_key")


def draw(targets: DataFrame, records: DataFrame, p: Plan = Plan(), seed: int = 0) -> DataFrame:
    """Every plan's sample: ``plan``, category, record, its least row id and ``sort_key``. The same input gives the same sample whatever its order."""
    return drawn(targets, records, p, seed)[1]


def report(targets: DataFrame, records: DataFrame, p: Plan = Plan(), seed: int = 0) -> DataFrame:
    """Per plan and category: ``share``, ``minimum``, ``size``, ``need``, ``available``, ``raked``, ``weight``, ``quota``, and of the sample itself the
    rows ``drawn``, their ``reached`` share of it, the ``gap`` (rows of the need that it lacks) and whether it is ``short`` of any.

    A category without records has 0 available. An empty target table gives an empty report; a plan of size 0 draws its minimums' rows from
    categories with a share only. Raking and repairs run per plan over its categories' counts, never over records.
    """
    quotas, sample = drawn(targets, records, p, seed)
    at = [p.plan, *p.category]
    got = sample.groupBy(*at).agg(F.count(F.lit(1)).alias("drawn"))
    held = quotas.join(got, at, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    total = F.sum("drawn").over(Window.partitionBy(p.plan))
    gap = F.greatest(F.col("need") - F.col("drawn"), F.lit(0))
    return held.select(
        *at, "share", "minimum", "size", "need", "available", "raked", "weight", "quota", "drawn",
        F.when(total > 0, F.col("drawn") / total).alias("reached"), gap.alias("gap"), (gap > 0).alias("short"),
    )
