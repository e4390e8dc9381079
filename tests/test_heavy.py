import random

import pytest
from pyspark.sql import functions as F

from cellforge.operators.heavy import KeyStats, heavy_keys, hot_share, key_stats

SCHEMA = "a int, b boolean, cells bigint, size int, hot string, __salt int"


def brute(rows):
    out = {}
    for a, b, c, s, *_ in rows:
        g = out.setdefault((a, b), [0, set(), []])
        g[0] += 1
        if c is not None:
            g[1].add(c)
        if s is not None:
            g[2].append(s)
    return {k: (n, len(d), sum(v) / len(v) if v else None) for k, (n, d, v) in out.items()}


def stats(df):
    return key_stats(df, ["a", "b"], KeyStats("cells", "size"))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(7, True, rnd.choice([1, 2, 3, rnd.randrange(10**6)]), rnd.randrange(50), "x", 1) for _ in range(3000)]
    out += [(rnd.randrange(300), rnd.random() < 0.5, rnd.randrange(50), rnd.choice([None, 4]), None, 2) for _ in range(3000)]
    out += [(None, None, None, None, None, None)] * 5 + [(None, True, 5, 1, "", 0), (9, None, None, 3, "", 0)]
    return out


def test_matches_brute_force_with_nulls_ties_and_clashing_names(spark, rows):
    got = {(r["a"], r["b"]): (r["n_rows"], r["n_distinct"], r["mean_value"]) for r in stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, (n, d, m) in want.items():
        assert got[k][:2] == (n, d)
        assert got[k][2] == pytest.approx(m) if m is not None else got[k][2] is None


def test_hot_key_takes_the_salted_way(spark, rows):
    hot = stats(spark.createDataFrame(rows, SCHEMA)).where("hot").collect()
    assert (7, True) in {(r["a"], r["b"]) for r in hot}
    assert len(hot) < 256


def test_heavy_keys_are_bounded(spark):
    keyed = spark.range(20000).select(F.xxhash64(F.col("id")).alias("__key_hash"))
    assert heavy_keys(keyed, 1024, 16).count() <= 16


def test_one_key_only(spark):
    df = spark.createDataFrame([(1, True, 5, 2, "", 0)] * 1000, SCHEMA)
    r = stats(df).collect()
    assert len(r) == 1 and r[0]["n_rows"] == 1000 and r[0]["n_distinct"] == 1 and r[0]["mean_value"] == 2


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert stats(df).count() == 0
    assert hot_share(stats(df), ["a", "b"], 0.05, 0).count() == 0


def test_share_counts_all_rows_but_names_no_null_keys(spark):
    df = spark.createDataFrame([(1, True, 1, 1, "", 0)] * 5 + [(None, True, 1, 1, "", 0)] * 95, SCHEMA)
    assert [(r["a"], r["b"]) for r in hot_share(stats(df), ["a", "b"], 0.05, 100).collect()] == [(1, True)]
    assert hot_share(stats(df), ["a", "b"], 0.06, 100).count() == 0
