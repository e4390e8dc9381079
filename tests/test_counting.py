import itertools

import pytest

from cellforge.plans import counting
from cellforge.plans.rows import automaton

BOARDS = {(1, 1): (1, 0), (2, 1): (3, 0), (2, 2): (13, 0), (3, 2): (40, 0), (3, 3): (213, 5)}


def table(df):
    return sorted(tuple(int(x) for x in r) for r in df.collect())


def test_automaton_counts_every_board_without_spark():
    for (w, h), want in BOARDS.items():
        a = automaton(w)
        state = {(a.start, 0): 1}
        for _ in range(h):
            new = {}
            for (node, chi), ways in state.items():
                for e in a.edges:
                    if e.src == node:
                        new[e.dst, chi + e.dchi] = new.get((e.dst, chi + e.dchi), 0) + ways
            state = new
        ended = {k: v for k, v in state.items() if k[0] in a.done}
        assert (sum(v for (_, c), v in ended.items() if c == 1), sum(v for (_, c), v in ended.items() if c <= 0)) == want


def test_placements(spark):
    got = counting.placements(spark, 4, 4).orderBy("h").collect()
    assert [(int(r["no_hole"]), int(r["has_hole"])) for r in got] == [(10, 0), (108, 0), (1049, 77), (9349, 2157)]


def test_symmetric_boxes(spark):
    for w, h, quarter, want in ((3, 3, False, (10, 1)), (4, 4, False, (42, 5)), (4, 4, True, (6, 1)), (4, 3, False, (20, 1))):
        r = counting.symmetric(spark, w, h, quarter).first()
        assert (int(r[0]), int(r[1])) == want


def test_three_ways_agree(spark):
    want = [r for r in counting.KNOWN if r[0] <= 3]
    listed = counting.list_shapes(spark, 3)
    assert table(counting.counts(listed, 3)) == want
    assert table(counting.count_shapes(spark, 3)) == want
    grown = counting.grow(spark, 2)
    assert sorted(r[0] for r in grown.collect()) == [1, 3, 259, 771]
    twos = listed.where("max_dim <= 2").select("mask")
    assert grown.exceptAll(twos).isEmpty() and twos.exceptAll(grown).isEmpty()


def test_list_to_four(spark):
    assert table(counting.counts(counting.list_shapes(spark, 4), 4)) == [r for r in counting.KNOWN if r[0] <= 4]


@pytest.mark.parametrize("n", [0, -1, 8, True, "3", 2.0])
def test_sides_are_checked(spark, n):
    with pytest.raises(ValueError):
        counting.count_shapes(spark, n)


def test_guard():
    counting.guard(list(counting.KNOWN))
    with pytest.raises(ValueError):
        counting.guard([(3, 46, 43, 3)])
    with pytest.raises(ValueError):
        counting.guard([(9, 5, 2, 2)])


def test_orbits_cover_the_board():
    for w, h, q in itertools.chain(((w, h, False) for w in range(1, 6) for h in range(1, 6)), ((w, w, True) for w in range(1, 6))):
        orbits = counting._orbits(w, h, q)
        assert sum(o.bit_count() for o in orbits) == w * h
        assert len(orbits) == (-(-w * w // 4) if q else -(-w * h // 2))
