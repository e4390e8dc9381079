"""Choosing a varied subset (problem 4).

Masks become feature rows. Bounded leaves nominate linearly independent rows by pivoted QR, and pairs of leaves
re-pivot their nominees up a tree to one root per group. The root's rows are chosen first; they, or a root's pivots on the cells alone, also cut a
group into clusters, in which deflated rounds go on choosing side by side and crowds are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellforge.session import cut, width

#: Distinct masks of a leaf; bounds a task's memory.
LEAF_ROWS = 1024
#: A group gets a pivot for every so many distinct masks, but no fewer and no more than these.
PER_PIVOT, FEWEST, MOST = 128, 2, 48
#: Distinct masks of a cluster that one task holds. A larger one is cut again for choosing; its crowds are counted by sums.
CLUSTER_ROWS = 4096
#: Cells in which a mask may differ from those of its crowd.
NEAR = 2
#: How steeply a mask's weight falls with the rows near it. Pivoting itself passes over what resembles chosen masks; at 1 crowds would get nothing.
CROWDING = 0.25
_SALTS = 16


def bits(masks: np.ndarray) -> np.ndarray:
    """Mask x cell, as 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(masks, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)


def plain(masks: np.ndarray) -> np.ndarray:
    """Cells of each mask, and whether it is empty."""
    return np.concatenate([bits(masks), (masks == 0)[:, None]], axis=1)


def features(masks: np.ndarray) -> np.ndarray:
    """Cells, neighbouring pairs and 2 x 2 squares of each mask, and whether it is empty, as rows of length 1."""
    grid = bits(masks).reshape(-1, 8, 8)
    across, down = grid[:, :, 1:] * grid[:, :, :-1], grid[:, 1:] * grid[:, :-1]
    square = across[:, 1:] * across[:, :-1]
    rows = np.concatenate([x.reshape(len(masks), -1) for x in (grid, across, down, square, masks == 0)], axis=1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def pivots(rows: np.ndarray, most: int, least: float = 1e-4, weight: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
    """Row-pivoted QR: the chosen rows in order, and the orthonormal directions they add.

    Each step takes the row with the greatest part outside the directions so far and removes that direction from
    all rows; it ends at ``most`` rows or when no row has more than ``least`` left. ``weight``
    only says which of the rows that have comes first.
    """
    rest = rows.astype(np.float64)
    left = (rest**2).sum(axis=1)
    chosen: list[int] = []
    basis = np.zeros((min(most, *rows.shape), rows.shape[1]))
    for k in range(len(basis)):
        able = left > least
        i = int(np.argmax(np.where(able, left if weight is None else left * weight, -1)))
        if not able[i]:
            break
        q = rest[i] - basis[:k].T @ (basis[:k] @ rest[i])
        norm = np.linalg.norm(q)
        if norm**2 <= least:
            left[i] = -1
            continue
        basis[k] = q / norm
        along = rest @ basis[k]
        rest -= along[:, None] * basis[k]
        left = np.where(left < 0, left, left - along**2)
        left[i] = -1
        chosen.append(i)
    return chosen, basis[np.linalg.norm(basis, axis=1) > 0.5]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """The runs of rows that are equal in their first ``keys`` columns, each as arrays. The rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        starts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in at], axis=0)]))
        if held and any(held[-1].column(i)[-1].as_py() != x[0] for i, x in enumerate(at)):
            yield _arrays(held)
            held = []
        for a, b in zip(starts, [*starts[1:], None], strict=True):
            held.append(batch.slice(a, None if b is None else b - a))
            if b is not None:
                yield _arrays(held)
                held = []
    if held:
        yield _arrays(held)


def _arrays(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(batches)
    return {c: t.column(c).to_numpy() for c in t.column_names}


def by_group(df: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``work`` on each group's arrays, the groups of a partition one after another. For groups of bounded size.

    Few bytes but much work a group: a fixed number of partitions, which isn't coalesced.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in _groups(batches, len(keys)):
            made = work(group)
            size = len(made[names[-1]])
            held.append({c: np.full(size, group[c][0]) if c in keys else made[c] for c in names})
            n += size
            if n >= 10_000:
                yield pa.record_batch({c: np.concatenate([h[c] for h in held]) for c in names})
                held, n = [], 0
        if n:
            yield pa.record_batch({c: np.concatenate([h[c] for h in held]) for c in names})

    placed = df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(width(df.sparkSession), *keys)
    return placed.sortWithinPartitions(*keys, "mask").mapInArrow(run, schema)


_ROW = "gid bigint, leaf int, mask bigint, weight double, quota bigint, pivot int"


def _nominate(make: Callable[[np.ndarray], np.ndarray]) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """The independent rows of one leaf or of two leaves' nominees, in pivot order."""

    def run(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        chosen, _ = pivots(make(rows["mask"]), int(rows["quota"][0]), 1e-6, rows["weight"])
        return {c: rows[c][chosen] for c in ("mask", "weight", "quota")} | {"pivot": np.arange(len(chosen), dtype=np.int32)}

    return run


def tournament(rows: DataFrame, leaves: int, make: Callable[[np.ndarray], np.ndarray] = features) -> DataFrame:
    """Per gid up to ``quota`` independent masks in pivot order, from the root of its tree. ``rows``: gid, leaf, mask, weight, quota.

    ``leaves``: how many the largest group has. A merge holds two sets of at most as many nominees as there are features.
    """
    won = by_group(rows.select("gid", "leaf", "mask", "weight", "quota"), ["gid", "leaf"], _nominate(make), _ROW)
    for _ in range((leaves - 1).bit_length()):
        pairs = won.withColumn("leaf", F.shiftright("leaf", 1)).drop("pivot")
        won = by_group(pairs, ["gid", "leaf"], _nominate(make), _ROW)
    return won


def distinct_masks(rows: DataFrame, group: str, mask: str, row: str, first: list[str]) -> DataFrame:
    """``gid``, ``mask``, how many rows have it (``n``), the row that stands for it (``rep``), its leaf, and of its group the distinct
    ``masks``, the ``rows`` and the cells that ``vary``.

    Rows with a null group or mask have no place and are left out. The row that stands for a mask is the first by
    ``first`` (nulls last), then by its id.
    """
    rank = F.struct(*(F.col(c).isNull().alias(f"n{i}") if j == 0 else F.col(c).alias(f"v{i}") for i, c in enumerate(first) for j in (0, 1)), F.col(row).alias("rep"))
    per = rows.where(F.col(group).isNotNull() & F.col(mask).isNotNull()).groupBy(F.xxhash64(group).alias("gid"), F.col(mask).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.min(rank).alias("r"), F.min(F.col(group)).alias("group")
    )
    sizes = per.groupBy("gid").agg(F.count(F.lit(1)).alias("masks"), F.sum("n").alias("rows"), F.bit_or("mask").bitwiseXOR(F.bit_and("mask")).alias("vary"))
    leaf = F.pmod(F.xxhash64("mask", F.lit(2)), F.ceil(F.col("masks") / LEAF_ROWS)).cast("int")
    return per.join(sizes, "gid").select("gid", "group", "mask", "n", F.col("r.rep").alias("rep"), "masks", "rows", "vary", leaf.alias("leaf"))


def leaves_of(masks: DataFrame) -> int:
    return (masks.agg(F.max("leaf")).first()[0] or 0) + 1


def with_pivots(masks: DataFrame, leaves: int) -> DataFrame:
    """``masks`` with ``d``, the distances of each from its group's pivots, by pivot. A group without pivots drops out."""
    quota = F.least("masks", F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.ceil(F.col("masks") / PER_PIVOT)))).cast("bigint")
    won = tournament(masks.select("gid", "leaf", "mask", F.lit(1.0).alias("weight"), quota.alias("quota")), leaves, plain)
    # at most MOST pivots a group; salted, so that the masks of a large group are spread
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    each = won.groupBy("gid").agg(F.array_sort(F.collect_list("mask")).alias("pivots")).withColumn("salt", salts)
    salted = masks.withColumn("salt", F.pmod(F.xxhash64("mask", F.lit(3)), F.lit(_SALTS)).cast("int"))
    away = F.transform("pivots", lambda p: F.bit_count(F.col("mask").bitwiseXOR(p)))
    return salted.join(each, ["gid", "salt"]).drop("salt").withColumn("d", away).drop("pivots")


def _home() -> Column:
    return (F.array_position("d", F.array_min("d")) - 1).cast("int")


def _count_near(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each mask at home in a cluster the rows of all its members that are near."""
    made, home, n = bits(rows["mask"]), np.flatnonzero(rows["home"]), rows["n"].astype(np.float64)
    size = made.sum(axis=1)
    others = np.empty(len(home), np.int64)
    for i in range(0, len(home), 512):
        at = home[i : i + 512]
        apart = size[at, None] + size[None, :] - 2 * (made[at] @ made.T)
        others[i : i + 512] = np.rint((apart < NEAR + 0.5) @ n) - 1
    return {"mask": rows["mask"][home], "others": others}


def _sum_near(members: DataFrame) -> DataFrame:
    """The same for clusters of any size, without forming pairs: every member adds its rows to itself and to each mask one cell away;
    summing over the same set around a mask counts its own rows (places + 1) times, and the rows of every mask one or two cells
    away exactly twice."""
    changed = "filter(transform(sequence(0, 63), i -> shiftleft(1L, i)), m -> (vary & m) <> 0)"
    place = F.explode(F.expr(f"concat(array(0L), {changed})"))
    flip = F.col("mask").bitwiseXOR(F.col("flip"))
    at = ["gid", "cell"]
    sums = members.select(*at, "mask", "n", place.alias("flip")).groupBy(*at, flip.alias("z")).agg(F.sum("n").alias("near"))
    asked = members.where("home").select(*at, "mask", "n", "vary", place.alias("flip")).withColumn("z", flip)
    total = asked.join(sums, [*at, "z"]).groupBy(*at, "mask", "n", "vary").agg(F.sum("near").alias("s"))
    others = (F.col("s") - (F.bit_count("vary") + 1) * F.col("n")) / 2 + F.col("n") - 1
    return total.select(*at, "mask", others.cast("bigint").alias("others"))


def neighbours(away: DataFrame) -> DataFrame:
    """``gid``, ``mask`` and ``others``: the rows, besides one of its own, whose mask differs from it in at most two cells. ``away``: of ``with_pivots``.

    A mask is at home with its nearest pivot, and a guest with every pivot that is at most twice ``NEAR`` further. If two masks are
    near, either is home or guest where the other is at home: its distance there is at most the other's and ``NEAR``, which is at most
    that of its own home and twice ``NEAR``. So each cluster's counts are exact and whole, and only clusters are compared. A cluster of more than
    ``CLUSTER_ROWS`` members is counted by sums instead.
    """
    places = F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda i: F.get("d", i) <= F.array_min("d") + 2 * NEAR)
    each = away.select("gid", "mask", "n", "vary", _home().alias("at"), F.explode(places).alias("cell"))
    members = cut(each.select("gid", "cell", "mask", "n", "vary", (F.col("cell") == F.col("at")).alias("home")), "members")
    large = members.groupBy("gid", "cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CLUSTER_ROWS).select("gid", "cell")
    schema = "gid bigint, cell int, mask bigint, others bigint"
    small = by_group(members.join(large, ["gid", "cell"], "left_anti").drop("vary"), ["gid", "cell"], _count_near, schema)
    return small.unionByName(_sum_near(members.join(large, ["gid", "cell"], "left_semi"))).drop("cell")


def crowded(rows: DataFrame, *, group: str = "dataset_id", mask: str = "mask", row: str = "landmark_id", crowd: int = 8) -> DataFrame:
    """The rows that lie in a crowd: at least ``crowd`` other rows of their group differ from them in at most two cells.

    Returns ``row``, ``group``, ``mask`` and ``others``. Rows with a null group or mask are in none; rows with
    equal masks count as rows of their own; repeated row ids give repeated results. An empty table gives an empty result.
    """
    masks = cut(distinct_masks(rows, group, mask, row, []), "masks")
    near = neighbours(with_pivots(masks, leaves_of(masks))).where(F.col("others") >= crowd)
    return rows.select(row, group, mask, F.xxhash64(group).alias("gid")).join(near.withColumnRenamed("mask", mask), ["gid", mask]).select(row, group, mask, "others")


def _shares(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """How many of a group's rest each of its clusters chooses: in proportion to their weight, as far as they have masks."""
    have, weight, left = rows["have"].astype(float), rows["weight"], float(rows["quota"][0])
    share, open_ = np.zeros(len(have)), np.ones(len(have), bool)
    while left > 1e-9 and open_.any():
        part = left * weight[open_] / weight[open_].sum()
        share[open_] = np.minimum(have[open_], share[open_] + part)
        left = float(rows["quota"][0]) - share.sum()
        open_ &= share < have - 1e-9
    ends = np.rint(np.cumsum(share)).astype(np.int64)  # whole numbers that add up
    return {"cell": rows["mask"], "share": np.minimum(np.diff(ends, prepend=0), rows["have"])}


def _choose(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A cluster's share: rounds of pivoted QR among its masks, the first with the directions of the root's rows taken out. A round
    ends when nothing is left outside its directions; the next is among the masks not yet chosen."""
    made = features(rows["mask"]).astype(np.float64)
    known = pivots(made[rows["root"]], int(rows["root"].sum()), 1e-6)[1]
    rest = np.flatnonzero(~rows["root"])
    most, chosen, rounds, number = min(int(rows["share"][0]), len(rest)), [], [], 1
    while len(chosen) < most:
        held = made[rest] - (made[rest] @ known.T) @ known
        got, _ = pivots(held, most - len(chosen), 1e-6, rows["weight"][rest])
        chosen += rest[got].tolist()
        rounds += [number] * len(got)
        rest, known, number = np.delete(rest, got), np.zeros((0, made.shape[1])), number + 1
    at = np.array(chosen, np.int64)
    return {"mask": rows["mask"][at], "round": np.array(rounds, np.int32), "pivot": np.arange(len(at), dtype=np.int32)}


def clusters(away: DataFrame) -> DataFrame:
    """``gid``, ``mask`` and ``cell``: each mask's cluster, none of more than ``CLUSTER_ROWS`` masks. ``away``: of ``with_pivots``.

    Clusters that are larger are cut again by pivots of their own; one that three more cuts leave too large is cut by hash.
    """
    at = cut(away.select("gid", "mask", F.xxhash64("gid", _home()).alias("cell")), "cells")
    done = None
    for _ in range(3):
        sizes = at.groupBy("cell").agg(F.count(F.lit(1)).alias("masks"))
        large = cut(at.join(sizes.where(F.col("masks") > CLUSTER_ROWS), "cell"), "large")
        small = at.join(sizes.where(F.col("masks") > CLUSTER_ROWS), "cell", "left_anti").select("gid", "mask", "cell")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        leaf = F.pmod(F.xxhash64("mask", F.lit(4)), F.ceil(F.col("masks") / LEAF_ROWS)).cast("int")
        again = large.select(F.col("cell").alias("gid"), F.col("gid").alias("top"), "mask", "masks", leaf.alias("leaf"))
        at = cut(with_pivots(again, leaves_of(again)).select(F.col("top").alias("gid"), "mask", F.xxhash64("gid", _home()).alias("cell")), "cells")
    sizes = at.groupBy("cell").agg(F.count(F.lit(1)).alias("masks"))
    part = F.pmod(F.xxhash64("mask", F.lit(5)), F.ceil(F.col("masks") / CLUSTER_ROWS))
    return done.unionByName(at.join(sizes, "cell").select("gid", "mask", F.xxhash64("cell", part).alias("cell")))


def varied(rows: DataFrame, *, group: str = "dataset_id", mask: str = "mask", row: str = "landmark_id", first: tuple[str, ...] = ("selection_order", "global_index"), fraction: float = 0.1) -> DataFrame:
    """A ``fraction`` of each group's rows, rounded up, that covers the variety of its masks.

    Returns ``group``, ``row``, ``mask``, ``round`` (0: from the group's root), ``pivot`` (the place within its group's root or cluster) and ``others`` (rows near it).

    Equal masks are one candidate, for which the first row by ``first`` (nulls last) stands, so a group of fewer distinct masks than
    asked gives them all. A mask's weight falls with the rows near it, to the power of ``CROWDING``, so that a crowd is chosen from late and
    large groups of similar masks don't dominate. Rows with a null group or mask are never chosen; an empty table gives an empty result.

    The root of each group's tournament gives its first rows, up to ``MOST``. A group that wants more has its clusters go on at the same time, each in one
    task and with its share by weight, so the number of Spark jobs doesn't grow with the group.
    """
    masks = cut(distinct_masks(rows, group, mask, row, list(first)), "masks")
    leaves = leaves_of(masks)
    away = cut(with_pivots(masks.select("gid", "mask", "n", "vary", "masks", "leaf"), leaves), "away")
    weight = F.pow(1.0 + F.col("others"), F.lit(-CROWDING))
    quota = F.least("masks", F.ceil(F.col("rows") * F.lit(fraction) - 1e-9)).cast("bigint")
    state = cut(masks.join(neighbours(away), ["gid", "mask"]).select("gid", "leaf", "mask", weight.alias("weight"), quota.alias("wanted"), "others"), "weighted")
    root = cut(tournament(state.withColumn("quota", F.least("wanted", F.lit(MOST).cast("bigint"))), leaves).select("gid", "mask", F.lit(0).alias("round"), "pivot"), "root")

    taken = root.groupBy("gid").agg(F.count(F.lit(1)).alias("taken"))
    rest = state.join(root.select("gid", "mask"), ["gid", "mask"], "left_anti").join(taken, "gid").where("wanted > taken")
    placed = cut(rest.select("gid", "mask", "weight", (F.col("wanted") - F.col("taken")).alias("quota")).join(clusters(away), ["gid", "mask"]), "placed")
    cells = placed.groupBy("gid", "cell").agg(F.count(F.lit(1)).alias("have"), F.sum("weight").alias("weight"), F.max("quota").alias("quota")).withColumnRenamed("cell", "mask")
    shares = by_group(cells, ["gid"], _shares, "gid bigint, cell bigint, share bigint").where("share > 0")
    asked = placed.select("gid", "mask", "weight", "cell").join(shares, ["gid", "cell"]).withColumn("root", F.lit(False))
    # each cluster gets its group's root, of at most MOST rows
    with_root = shares.join(root.select("gid", "mask"), "gid").select("gid", "cell", "mask", F.lit(0.0).alias("weight"), "share", F.lit(True).alias("root"))
    more = by_group(asked.unionByName(with_root), ["gid", "cell"], _choose, "gid bigint, cell bigint, mask bigint, round int, pivot int")
    chosen = root.unionByName(more.drop("cell"))
    found = chosen.join(state.select("gid", "mask", "others"), ["gid", "mask"]).join(masks.select("gid", "mask", F.col("group").alias("g"), "rep"), ["gid", "mask"])
    return found.select(F.col("g").alias(group), F.col("rep").alias(row), F.col("mask").alias(mask), "round", "pivot", "others")
