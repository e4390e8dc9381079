"""Counting and listing all shapes that fit in an n x n box, up to moving and turning.

Three ways that check each other: growing layer by layer, sums over the row automaton with Burnside's lemma, and listing row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellforge.functions import geometry as g
from cellforge.operators import shapes as sh
from cellforge.plans.rows import automaton
from cellforge.session import cut

_WAYS = "decimal(38,0)"


def _side(n: int, most: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= most:
        raise ValueError(f"n must be a whole number from 1 to {most}")
    return n


# -- growing


def grow(spark: SparkSession, n: int, one_sided: bool = True) -> DataFrame:
    """All shapes in an n x n box as masks, layer by layer: every shape of k + 1 cells is one of k cells and a neighbour.

    A layer's shapes have one cell more than the last one's, so distinct within the layer is enough. Each layer is written, which ends its lineage.
    """
    _side(n, 7)
    layer = spark.createDataFrame([(1,)], "mask bigint")
    layers = []
    while not layer.isEmpty():
        layers.append(layer)
        new = g.grown(layer, "mask", n).select(F.col("grown").alias("mask"))
        if one_sided:
            new = g.with_canonical(new).select(F.col("canonical").alias("mask"))
        layer = cut(new.distinct(), "layer")
    return reduce(DataFrame.unionByName, layers)


def counts(shapes: DataFrame, n: int) -> DataFrame:
    """``n``, ``total``, ``no_hole``, ``has_hole`` for every side up to n, cumulative, from a table of masks one per shape."""
    kinds = sh.classified(shapes).select("max_dim", F.col("hole").cast("int").alias("hole"))
    sides = shapes.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("n"))
    # n rows
    upto = kinds.groupBy("max_dim").agg(F.count(F.lit(1)).alias("all"), F.sum("hole").alias("holed"))
    joined = F.broadcast(sides).join(upto, F.col("max_dim") <= F.col("n"))
    return joined.groupBy("n").agg(F.sum("all").alias("total"), F.sum(F.col("all") - F.col("holed")).alias("no_hole"), F.sum("holed").alias("has_hole"))


# -- sums over the automaton


def placements(spark: SparkSession, w: int, h: int) -> DataFrame:
    """For every height up to ``h`` the connected sets on a w x height board, wherever they lie: ``w``, ``h``, ``no_hole``, ``has_hole``.

    A row of the board is one join with the broadcast edges and one grouped sum. Shapes that ended stay in the node AFTER, so every height's sum
    is read off the same states.
    """
    a = automaton(w)
    rows = [(e.src, e.dst, e.dchi) for e in a.edges]
    edges = cut(spark.createDataFrame(rows, "src int, dst int, dchi int").groupBy("src", "dst", "dchi").agg(F.count(F.lit(1)).alias("times")), "edges")
    state = spark.createDataFrame([(a.start, 0, 1)], "node int, chi int, ways int").withColumn("ways", F.col("ways").cast(_WAYS))
    out = []
    for height in range(1, h + 1):
        # the edges' number depends on w alone
        stepped = state.join(F.broadcast(edges), state["node"] == edges["src"])
        state = cut(stepped.groupBy(F.col("dst").alias("node"), (F.col("chi") + F.col("dchi")).alias("chi")).agg(F.sum(F.col("ways") * F.col("times")).cast(_WAYS).alias("ways")), "rows")
        ended = state.where(F.col("node").isin(list(a.done)))
        out.append(ended.agg(F.sum(F.when(F.col("chi") == 1, F.col("ways"))).alias("no_hole"), F.sum(F.when(F.col("chi") <= 0, F.col("ways"))).alias("has_hole")).select(F.lit(w).alias("w"), F.lit(height).alias("h"), *(F.coalesce(c, F.lit(0)).cast(_WAYS).alias(c) for c in ("no_hole", "has_hole"))))
    return reduce(DataFrame.unionByName, out)


def _orbits(w: int, h: int, quarter: bool) -> list[int]:
    """The cells of a w x h board in sets that a half or quarter turn maps to themselves, as masks."""
    seen, out = set(), []
    for r in range(h):
        for c in range(w):
            if (r, c) in seen:
                continue
            orbit, at = set(), (r, c)
            while at not in orbit:
                orbit.add(at)
                at = (at[1], h - 1 - at[0]) if quarter else (h - 1 - at[0], w - 1 - at[1])
            seen |= orbit
            mask = sum(1 << (8 * a + b) for a, b in orbit)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def symmetric(spark: SparkSession, w: int, h: int, quarter: bool = False) -> DataFrame:
    """Shapes with the tight box w x h that a half (or quarter) turn keeps: ``no_hole``, ``has_hole``. Every choice of orbits is one row of a range."""
    if quarter and w != h:
        raise ValueError("only a square board can be turned by a quarter")
    orbits = _orbits(w, h, quarter)
    if len(orbits) > 40:
        raise ValueError("the board has too many orbits to list")
    chosen = spark.range(1, 1 << len(orbits))
    mask = g.lor(*(F.when(F.col("id").bitwiseAND(F.lit(1 << k)) != 0, g.long(o)).otherwise(g.long(0)) for k, o in enumerate(orbits)))
    made = g.settled(chosen.select(mask.alias("mask"))).where(g.touches_all_sides(F.col("mask"), w, h)).where(g.connected(F.col("mask")))
    chi = made.select(g.euler(F.col("mask")).alias("chi"))
    return chi.agg(F.count(F.when(F.col("chi") == 1, 1)).cast(_WAYS).alias("no_hole"), F.count(F.when(F.col("chi") <= 0, 1)).cast(_WAYS).alias("has_hole"))


def count_shapes(spark: SparkSession, n: int) -> DataFrame:
    """``n``, ``total``, ``no_hole``, ``has_hole`` for every side up to n without listing the shapes.

    Fixed shapes in an n x n box are C(n, n) - 2 C(n - 1, n) + C(n - 1, n - 1) placements; the half-turn and quarter-turn symmetric ones
    are listed by orbits; Burnside's lemma joins them, and must divide by 4.
    """
    _side(n, 7)
    board = cut(reduce(DataFrame.unionByName, (placements(spark, w, min(w + 1, n)) for w in range(1, n + 1))), "placements")
    half = [symmetric(spark, w, h).select(F.lit(w).alias("side"), F.lit("s180").alias("term"), (F.col("no_hole") * (1 if w == h else 2)).alias("no_hole"), (F.col("has_hole") * (1 if w == h else 2)).alias("has_hole")) for w in range(1, n + 1) for h in range(1, w + 1)]
    quarter = [symmetric(spark, w, w, True).select(F.lit(w).alias("side"), F.lit("s90").alias("term"), "no_hole", "has_hole") for w in range(1, n + 1)]
    turned = cut(reduce(DataFrame.unionByName, half + quarter), "turned")
    sides = spark.range(1, n + 1).select(F.col("id").cast("int").alias("n"))

    def corner(dw: int, dh: int, times: int) -> DataFrame:
        return board.select((F.col("w") + dw).alias("n"), (F.col("h") + dh).alias("m"), *((F.col(c) * times).alias(c) for c in ("no_hole", "has_hole"))).where("n = m").select("n", "no_hole", "has_hole")

    # a (w - 1) x w board is a w x (w - 1) board turned
    fixed = reduce(DataFrame.unionByName, (corner(0, 0, 1), corner(1, 0, -2), corner(1, 1, 1))).groupBy("n").agg(F.sum("no_hole").alias("f_no"), F.sum("has_hole").alias("f_yes"))
    sums = turned.groupBy("side", "term").agg(F.sum("no_hole").alias("no"), F.sum("has_hole").alias("yes"))
    upto = F.broadcast(sides).join(sums, F.col("side") <= F.col("n")).groupBy("n").agg(
        *(F.sum(F.when(F.col("term") == t, F.col(c)).otherwise(0)).alias(f"{t}_{c}") for t in ("s180", "s90") for c in ("no", "yes"))
    )
    both = F.broadcast(sides).join(fixed, "n").join(upto, "n")

    def whole(c: str) -> Column:
        total = F.col(f"f_{c}") + F.col(f"s180_{c}") + 2 * F.col(f"s90_{c}")
        return F.when(total % 4 == 0, (total / 4).cast(_WAYS)).otherwise(F.raise_error(F.lit("the turns' sum isn't divisible by 4")).cast(_WAYS))

    return both.select("n", whole("no").alias("no_hole"), whole("yes").alias("has_hole")).select("n", (F.col("no_hole") + F.col("has_hole")).cast(_WAYS).alias("total"), "no_hole", "has_hole")


# -- listing row by row


def list_shapes(spark: SparkSession, n: int) -> DataFrame:
    """All one-sided shapes in an n x n box, ``mask`` and ``max_dim``, by laying rows: no set of shapes seen is kept.

    Boxes at least as wide as high suffice, since the least of a shape's turns lies so. A partial shape is joined with the rows
    that may follow its node, which drops those that can't go on; of the ended ones those stay that touch all four sides and
    are the least of their turns.
    """
    _side(n, 7)
    out = []
    for w in range(1, n + 1):
        a = automaton(w)
        rows = [(e.src, e.row, e.dst) for e in a.edges if a.nodes[e.dst] not in ((-1,), (-2,))]
        edges = spark.createDataFrame(rows, "src int, row long, dst int")
        state = spark.createDataFrame([(a.start, 0)], "node int, mask bigint")
        for h in range(1, w + 1):
            # the edges' number depends on w alone
            stepped = state.join(F.broadcast(edges), F.col("node") == F.col("src"))
            state = cut(stepped.select(F.col("dst").alias("node"), F.col("mask").bitwiseOR(F.shiftleft("row", 8 * (h - 1))).alias("mask")), "laid")
            ended = state.where(F.col("node").isin(list(a.done))).where(g.touches_all_sides(F.col("mask"), w, h)).select("mask")
            least = g.settled(g.with_canonical(ended).select("mask", "canonical")).where("canonical = mask")
            out.append(least.select("mask", F.lit(w).alias("max_dim")))
    return reduce(DataFrame.unionByName, out)


#: Known rows of this count: n, total, without and with holes. Fixed values; the tests list all shapes for n up to 4 and compare.
KNOWN = (
    (1, 1, 1, 0),
    (2, 4, 4, 0),
    (3, 46, 44, 2),
    (4, 2404, 1899, 505),
    (5, 520818, 267976, 252842),
    (6, 410964612, 112877832, 298086780),
    (7, 1185652433093, 144608553854, 1041043879239),
)


def guard(rows: list[tuple[int, int, int, int]]) -> None:
    """Raises where counted rows contradict the known ones or a class sum."""
    known = {r[0]: r for r in KNOWN}
    for r in rows:
        if r[1] != r[2] + r[3]:
            raise ValueError(f"n={r[0]}: the classes don't add up")
        if r[0] in known and tuple(map(int, r)) != known[r[0]]:
            raise ValueError(f"n={r[0]}: {tuple(map(int, r))} is not {known[r[0]]}")
