import numpy as np
import pytest

from cellforge.llm import sampling as s

TARGETS = "plan_id bigint, dataset_id string, max_dimension int, has_hole boolean, target_share double, share_unit string, min_rows int, sample_size bigint, cells string"
RECORDS = "record_id bigint, dataset_id string, cells bigint, max_dimension int, has_hole boolean, target_share double"


def test_rake_meets_what_it_can_and_takes_from_none():
    share, have = np.array([0.5, 0.3, 0.2]), np.array([100, 10, 100])
    x = s.rake(share, have, [np.array([0, 0, 1]), np.array([0, 1, 1])], 100)
    assert x[1] == 10 and x[0] >= 50 - 1e-6 and x[2] >= 20 - 1e-6
    assert x.sum() == pytest.approx(100) and (x <= have).all()
    assert s.rake(share, np.zeros(3), [np.array([0, 0, 1])], 100).sum() == 0


def test_rake_fits_the_margins_that_can_be_fitted():
    """What one category lacks goes to the others of its classes before it goes anywhere else."""
    share, have = np.array([0.4, 0.2, 0.2, 0.2]), np.array([30, 100, 100, 100])
    x = s.rake(share, have, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], 100)
    assert x[0] == 30 and x.sum() == pytest.approx(100) and (x[1:] >= 20 - 1e-6).all()
    assert x[1] > x[3] and x[2] > x[3]


def test_minimums_are_repaired_within_the_size():
    q = s.repair(np.array([90, 10, 0]), np.array([0, 0, 20]), np.array([100, 100, 15]), 100)
    assert q.tolist() == [76, 9, 15] or (q.sum() == 100 and q[2] == 15)
    assert s.repair(np.array([5, 5]), np.array([9, 9]), np.array([9, 9]), 10).tolist() == [9, 9]


@pytest.fixture(scope="module")
def tables(spark):
    records = [(i, "a", i % 500, 3, True, 0.0) for i in range(3000)] + [(9000 + i, "a", 10_000 + i, 4, False, 0.0) for i in range(7)]
    records += [(9100, "a", None, 3, True, 0.0), (9101, None, 1, 3, True, 0.0), (9102, "b", 1, None, True, 0.0), (9103, "b", 77, 5, False, 0.0), (9104, "b", 77, 5, False, 0.0)]
    targets = [
        (1, "a", 3, True, 0.6, "fraction", 0, 100, ""), (1, "a", 4, False, 0.4, "fraction", 0, 100, ""),
        (2, "a", 3, True, 30.0, "percent", 0, 10, ""), (2, "a", 4, False, 70.0, "percent", 0, 10, ""), (2, "a", 9, False, 0.0, "percent", 2, 10, ""),
        (3, "b", 5, False, 3.0, "weight", 0, 4, ""), (3, "b", 6, False, 1.0, "weight", 0, 4, ""), (3, "b", 6, False, 1.0, "weight", 0, 4, ""),
        (4, "b", 5, None, None, "bushel", 1, None, ""),
    ]
    return spark.createDataFrame(targets, TARGETS), spark.createDataFrame(records, RECORDS)


def test_report(tables):
    got = {(r["plan_id"], r["max_dimension"]): r for r in s.report(*tables).collect()}
    assert [got[k][c] for k in ((1, 3), (1, 4)) for c in ("need", "available", "short")] == [60, 500, False, 40, 7, True]
    assert got[1, 3]["quota"] == 93 and got[1, 4]["quota"] == 7 and got[1, 4]["gap"] == 33
    assert got[2, 3]["need"] == 3 and got[2, 4]["need"] == 7 and not got[2, 4]["short"]
    assert got[2, 9]["need"] == 2 and got[2, 9]["available"] == 0 and got[2, 9]["short"]
    assert got[3, 5]["need"] == 3 and got[3, 5]["available"] == 1 and got[3, 6]["need"] == 1  # repeated rows count once
    assert got[4, 5]["need"] == 1 and got[4, 5]["available"] == 0  # a null meets none


def test_the_shortfall_is_read_from_the_raked_sample(tables, monkeypatch):
    """Without raking nothing but minimums is drawn, and the report shows it."""
    honest = {(r["plan_id"], r["max_dimension"]): r["short"] for r in s.report(*tables).collect()}
    assert not honest[1, 3] and honest[1, 4] and not honest[2, 3]
    monkeypatch.setattr(s, "rake", lambda share, available, margins, size: np.zeros(len(share)))
    blind = {(r["plan_id"], r["max_dimension"]): r for r in s.report(*tables).collect()}
    assert blind[1, 3]["short"] and blind[2, 3]["short"] and blind[1, 3]["drawn"] == 0


def test_drawn_rows_are_counted(tables):
    quotas = {(r["plan_id"], r["max_dimension"], r["has_hole"]): r for r in s.report(*tables).collect()}
    sample = s.draw(*tables).groupBy("plan_id", "max_dimension", "has_hole").count().collect()
    assert {tuple(r[:3]): r[3] for r in sample} == {k: r["drawn"] for k, r in quotas.items() if r["drawn"]}
    assert all(r["drawn"] == r["quota"] for r in quotas.values())


def test_sample_has_the_quotas_and_no_record_twice(tables):
    rows = s.draw(*tables).collect()
    quotas = {(r["plan_id"], r["max_dimension"], r["has_hole"]): r["quota"] for r in s.report(*tables).collect() if r["quota"]}
    got = {}
    for r in rows:
        got.setdefault((r["plan_id"], r["max_dimension"], r["has_hole"]), []).append(r["cells"])
    assert {k: len(v) for k, v in got.items()} == quotas
    assert all(len(set(v)) == len(v) for v in got.values())
    again = s.draw(tables[0], tables[1].orderBy("cells")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    other = s.draw(*tables, seed=1).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, rows))


def test_draw_takes_the_smallest_keys(tables, monkeypatch):
    whole = sorted((r["sort_key"], r["cells"]) for r in s.draw(*tables).where("plan_id = 1 and max_dimension = 3").collect())
    monkeypatch.setattr(s, "SLICES", 3)
    coarse = sorted((r["sort_key"], r["cells"]) for r in s.draw(*tables).where("plan_id = 1 and max_dimension = 3").collect())
    assert whole == coarse


def test_empty(spark, tables):
    none = spark.createDataFrame([], TARGETS)
    assert s.report(none, tables[1]).count() == 0 and s.draw(none, tables[1]).count() == 0
    got = s.report(tables[0], spark.createDataFrame([], RECORDS)).collect()
    assert all(r["available"] == 0 and r["quota"] == 0 for r in got)
    assert s.draw(tables[0], spark.createDataFrame([], RECORDS)).count() == 0
