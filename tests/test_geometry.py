import random

import pytest
from pyspark.sql import functions as F

from cellforge.functions import geometry as g, render, wide

FULL = 2**64 - 1


def signed(m):
    return m - (1 << 64) if m >> 63 else m


def cells(m):
    return [(i // 8, i % 8) for i in range(64) if m >> i & 1]


def mask(cs):
    return sum(1 << (8 * r + c) for r, c in cs)


def moved(cs):
    r0, c0 = min(r for r, _ in cs), min(c for _, c in cs)
    return sorted((r - r0, c - c0) for r, c in cs)


def turned(cs):
    h = max(r for r, _ in cs) + 1
    return sorted((c, h - 1 - r) for r, c in cs)


def flood(start, inside):
    seen, todo = {start}, [start]
    while todo:
        r, c = todo.pop()
        for x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if x in inside and x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    masks = [1, 3, 257, 259, 771, 132866, 460039, 197895, FULL, 60483900686, 458759, (1 << 63) | 1, 1 << 63, 255]
    masks += [rnd.getrandbits(64) for _ in range(150)] + [rnd.getrandbits(64) & 0x0F0F0F0F0F for _ in range(150)]
    df = spark.createDataFrame([(signed(m),) for m in masks], "mask bigint")
    x = F.col("mask")
    return g.with_canonical(df).withColumns(
        {
            "n": g.size(x), "con": g.connected(x), "chi": g.euler(x), "hole": g.has_hole_by_flood(x), "open": g.frontier(x), "open4": g.frontier(x, 4), "back": g.from_cells(g.cells(x)),
            "hex": g.to_hex(x), "text": render.as_text(F.col("normal"), F.col("w"), F.col("h")), "pic": render.as_picture(F.col("normal"), F.col("w"), F.col("h")),
            "wide_n": F.size(wide.cells(g.to_hex(x), F.lit(8))), "wide_chi": wide.euler(wide.cells(g.to_hex(x), F.lit(8))),
        }
    ).collect()


def test_against_coordinates(rows):
    for r in rows:
        m = r["mask"] & FULL
        cs = cells(m)
        n = moved(cs)
        turns = [n]
        for _ in range(3):
            turns.append(moved(turned(turns[-1])))
        assert r["n"] == len(cs) == r["wide_n"]
        assert r["back"] == r["mask"] and bytes.fromhex(r["hex"]) == m.to_bytes(8, "little")
        assert (r["w"], r["h"]) == (max(c for _, c in n) + 1, max(x for x, _ in n) + 1)
        assert [r[c] & FULL for c in ("normal", "m90", "m180", "m270")] == [mask(t) for t in turns]
        assert r["canonical"] & FULL == min(map(mask, turns)) and r["weight"] == len(set(map(mask, turns)))


def test_topology(rows):
    for r in rows:
        cs = cells(r["mask"] & FULL)
        inside = set(cs)
        corners = {(a + i, b + j) for a, b in cs for i in (0, 1) for j in (0, 1)}
        edges = {(0, a + i, b) for a, b in cs for i in (0, 1)} | {(1, a, b + i) for a, b in cs for i in (0, 1)}
        assert r["chi"] == len(corners) - len(edges) + len(cs) == r["wide_chi"]
        assert r["con"] == (flood(cs[0], inside) == inside)
        outside = {(a, b) for a in range(-1, 9) for b in range(-1, 9)} - inside
        assert r["hole"] == (flood((-1, -1), outside) != outside)
        if r["con"]:
            assert r["hole"] == (r["chi"] <= 0)
        around = {x for a, b in cs for x in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1))} - inside
        assert r["open"] & FULL == mask({x for x in around if 0 <= x[0] < 8 and 0 <= x[1] < 8})
        assert r["open4"] & FULL == mask({x for x in around if 0 <= x[0] < 4 and 0 <= x[1] < 4})


def test_rendering(rows):
    plus = next(r for r in rows if r["mask"] == 132866)
    assert plus["text"] == "[size=5 3x3] (1,0) (0,1) (1,1) (2,1) (1,2)"
    assert plus["pic"] == "  ██  \n██████\n  ██  "
    domino = next(r for r in rows if r["mask"] == 259)
    assert domino["pic"] == "██  \n████"  # the highest row comes first


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), (0,)], "mask bigint")
    got = {r["mask"]: r for r in g.with_canonical(df).withColumn("con", g.connected(F.col("mask"))).withColumn("hex", g.from_hex(g.to_hex(F.col("mask")))).collect()}
    assert got[0]["w"] == 0 and got[0]["canonical"] == 0 and got[0]["con"] is False and got[0]["hex"] == 0
    assert got[None]["canonical"] is None and got[None]["hex"] is None


def test_growth(spark):
    got = g.grown(spark.createDataFrame([(1,)], "mask bigint"), "mask", 2).collect()
    assert sorted(r["grown"] for r in got) == [3, 3, 257, 257]
    assert g.grown(spark.createDataFrame([(1,)], "mask bigint"), "mask", 1).count() == 0
