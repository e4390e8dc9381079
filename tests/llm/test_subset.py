import random

import numpy as np
import pytest

from cellforge.llm import subset as s

SCHEMA = "landmark_id bigint, dataset_id string, mask bigint, selection_order int, global_index bigint, gid int, block string"


def test_pivots_are_independent_and_span():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 12))
    chosen, basis = s.pivots(rows, 12, 1e-8)
    assert len(chosen) == 5 and np.linalg.matrix_rank(rows[chosen]) == 5
    assert np.allclose(basis @ basis.T, np.eye(5), atol=1e-8)
    assert np.allclose(rows - rows @ basis.T @ basis, 0, atol=1e-6)
    assert s.pivots(np.zeros((3, 4)), 4)[0] == []


def rows_of(seed=4, n=260):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(49) for _ in range(6)]
    out = []
    for i in range(n):
        m = rnd.choice(base) if rnd.random() < 0.6 else rnd.getrandbits(49)
        for _ in range(rnd.randrange(3)):
            m ^= 1 << rnd.randrange(49)
        out.append((i, rnd.choice(["a", "a", "b"]), m, rnd.choice([None, i]), i, 0, "clash"))
    out += [(1000, None, base[0], 1, 1, 0, ""), (1001, "a", None, 1, 1, 0, ""), (1002, "c", -(1 << 63), 1, 1, 0, ""), (1003, "c", 0, 1, 1, 0, "")]
    out += [(2000 + i, "d", 7, None, None, 0, "") for i in range(12)] + [(2100 + i, "e", 7, None, None, 0, "") for i in range(8)]
    return out


def brute(rows, crowd=8):
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    out = {}
    for r in known:
        n = sum(o[1] == r[1] and ((o[2] ^ r[2]) & (2**64 - 1)).bit_count() <= 2 for o in known) - 1
        if n >= crowd:
            out[r[0]] = n
    return out


@pytest.mark.parametrize("cluster, leaf, per", [(4096, 1024, 128), (40, 10, 4), (6, 10, 300)])
def test_crowds_against_brute_force(spark, monkeypatch, cluster, leaf, per):
    """Also with many pivots, and where every cluster is too large for one task."""
    monkeypatch.setattr(s, "CLUSTER_ROWS", cluster)
    monkeypatch.setattr(s, "LEAF_ROWS", leaf)
    monkeypatch.setattr(s, "PER_PIVOT", per)
    rows = rows_of()
    got = {r["landmark_id"]: r["others"] for r in s.crowded(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert got == want and len(want) > 20


@pytest.mark.parametrize("cluster, leaf, most", [(4096, 1024, 48), (40, 10, 3), (5, 10, 2)])
def test_a_tenth_of_each_group(spark, monkeypatch, cluster, leaf, most):
    """Also where the root has few rows and its clusters, cut again and again, give the rest."""
    monkeypatch.setattr(s, "CLUSTER_ROWS", cluster)
    monkeypatch.setattr(s, "LEAF_ROWS", leaf)
    monkeypatch.setattr(s, "MOST", most)
    rows = rows_of()
    got = s.varied(spark.createDataFrame(rows, SCHEMA)).collect()
    by, chosen = {}, {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            by.setdefault(r[1], []).append(r)
    for r in got:
        chosen.setdefault(r["dataset_id"], []).append(r)
    assert chosen.keys() == by.keys()
    for g, mine in chosen.items():
        distinct = len({r[2] for r in by[g]})
        assert len(mine) == min(distinct, -(-len(by[g]) // 10))
        assert len({r["mask"] for r in mine}) == len(mine)
        assert {r["landmark_id"] for r in mine} <= {r[0] for r in by[g]}


def test_crowds_dont_dominate(spark):
    rnd = random.Random(8)
    centre = rnd.getrandbits(49)
    rows = [(i, "a", centre ^ (1 << (i % 49)), i, i, 0, "") for i in range(49)] + [(100 + i, "a", rnd.getrandbits(49), i, i, 0, "") for i in range(51)]
    got = s.varied(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 10 and sum(r["landmark_id"] < 100 for r in got) <= 2


def test_the_first_row_stands_for_a_mask(spark):
    rows = [(5, "a", 3, None, 1, 0, ""), (6, "a", 3, 2, 9, 0, ""), (7, "a", 3, 2, 4, 0, ""), (8, "a", 3, 2, 4, 0, "")]
    assert [r["landmark_id"] for r in s.varied(spark.createDataFrame(rows, SCHEMA)).collect()] == [7]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert s.varied(none).count() == 0 and s.crowded(none).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None)], SCHEMA)
    assert s.varied(nulls).count() == 0 and s.crowded(nulls).count() == 0


def test_nominees_of_all_leaves_meet(spark):
    """Five leaves that each hold the same three directions give three nominees, not three a leaf."""
    masks = [1 << i | 1 << j for i, j in ((0, 1), (20, 21), (40, 41))]
    rows = [(1, leaf, m, 1.0, 50) for leaf in range(5) for m in masks]
    got = s.tournament(spark.createDataFrame(rows, "gid bigint, leaf int, mask bigint, weight double, quota bigint"), 5).collect()
    assert sorted(r["mask"] for r in got) == sorted(masks)


def test_a_large_group_chooses_as_one(spark, monkeypatch):
    """Cut into many leaves, a group still fills its quota, and no direction is taken twice."""
    monkeypatch.setattr(s, "LEAF_ROWS", 4)
    rows = [(i, "a", 3 << i % 60 | 1 << i // 60, i, i) for i in range(180)]
    df = spark.createDataFrame(rows, "landmark_id int, dataset_id string, mask bigint, selection_order int, global_index int")
    got = s.varied(df).collect()
    assert len(got) == len({r["mask"] for r in got}) == 18
    assert {r["round"] for r in got} == {0} and sorted(r["pivot"] for r in got) == list(range(18))


def test_rows_of_tiny_weight_are_nominated():
    """Masks amid tens of millions of copies fill the quota like any others, after heavier ones."""
    got = s._nominate(s.features)({"mask": np.array([1, 2, 4, 8]), "weight": np.array([1e-8, 1e-8, 1.0, 1e-8]), "quota": np.full(4, 4)})
    assert sorted(got["mask"]) == [1, 2, 4, 8] and got["mask"][0] == 4


def test_rounds_are_deflated():
    """What lies in the root's directions comes after all that doesn't, whatever its weight."""
    rows = {"mask": np.array([1, 2, 4, 8, 1 << 30, 1 << 40]), "weight": np.array([1.0, 1.0, 1.0, 1.0, 1e-3, 1e-3]), "share": np.full(6, 3), "root": np.array([True, True, False, False, False, False])}
    rows["mask"][2] = 1 << 50
    got = s._choose(rows | {"share": np.full(6, 4)})
    assert sorted(got["mask"]) == [8, 1 << 30, 1 << 40, 1 << 50] and set(got["round"]) == {1}
    same = s._choose({"mask": np.array([1, 1, 1 << 40]), "weight": np.array([0.0, 1.0, 1e-6]), "share": np.full(3, 2), "root": np.array([True, False, False])})
    assert same["mask"].tolist() == [1 << 40, 1] and same["round"].tolist() == [1, 2]


def test_shares_add_up():
    got = s._shares({"have": np.array([3, 50, 50]), "weight": np.array([3.0, 1.0, 1.0]), "quota": np.full(3, 40), "mask": np.arange(3)})
    assert got["share"].sum() == 40 and got["share"][0] == 3 and abs(int(got["share"][1]) - int(got["share"][2])) <= 1


def test_crowds_come_from_the_tournament(spark, monkeypatch):
    """Without pivots there are no clusters and no crowds; with others than the tournament's the clusters are larger."""
    df = spark.createDataFrame(rows_of(), SCHEMA)
    monkeypatch.setattr(s, "PER_PIVOT", 4)
    masks = s.cut(s.distinct_masks(df, "dataset_id", "mask", "landmark_id", []))

    def work():
        members = s.with_pivots(masks, 1).selectExpr("gid", "size(filter(d, x -> x <= array_min(d) + 4)) as places")
        return members.groupBy().sum("places").first()[0]

    fair, honest = work(), s.tournament
    assert fair < masks.count() * 16
    monkeypatch.setattr(s, "tournament", lambda *a: honest(*a).where("false"))
    assert s.crowded(df).count() == 0


def test_a_varied_subset_covers_better_than_chance(spark):
    """Mean distance from each mask to the nearest chosen one, and the crowds' share, against random choices."""
    rnd = random.Random(3)
    base = [rnd.getrandbits(49) for _ in range(40)]
    heavy = [b for i, b in enumerate(base) for _ in range(60 if i < 3 else 2)]
    masks = {m ^ (1 << rnd.randrange(49)) ^ (1 << rnd.randrange(49)) for m in heavy * 3}
    rows = [(i, "a", m, i, i, 0, "") for i, m in enumerate(sorted(masks))]
    got = [r["mask"] for r in s.varied(spark.createDataFrame(rows, SCHEMA)).collect()]
    far = lambda chosen: np.mean([min((m ^ c).bit_count() for c in chosen) for m in masks])
    chance = [far(rnd.sample(sorted(masks), len(got))) for _ in range(20)]
    hubs = lambda chosen: np.mean([any((m ^ b).bit_count() <= 2 for b in base[:3]) for m in chosen])
    assert len(got) == -(-len(masks) // 10)
    assert hubs(got) < hubs(masks) / 2 and far(got) < np.min(chance)


def test_the_empty_mask_counts(spark):
    rows = [(i, "a", 0, i, i) for i in range(9)] + [(20 + i, "b", m, i, i) for i, m in enumerate([0, 1, 6])]
    df = spark.createDataFrame(rows, "landmark_id int, dataset_id string, mask bigint, selection_order int, global_index int")
    assert {r["landmark_id"] for r in s.crowded(df).collect()} == set(range(9))
    got = {(r["dataset_id"], r["mask"]) for r in s.varied(df, fraction=1.0).collect()}
    assert got == {("a", 0), ("b", 0), ("b", 1), ("b", 6)}
