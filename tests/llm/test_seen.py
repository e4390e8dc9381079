import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cellforge.llm import seen

SCHEMA = "id bigint, k string, h bigint, row bigint, known boolean"


@pytest.mark.parametrize("n, bits", [(0, 20), (1, 10), (5, 8), (1000, 64), (50_000, 58), (3000, 12), (256, 8), (65_536 * 2 + 7, 40)])
def test_succinct_set(n, bits):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, 2**bits - 1, k, dtype=np.uint64, endpoint=True)
    v = np.unique(draw(n))
    e = seen.EliasFano(v, bits)
    assert (e.decode() == v).all()
    p = np.sort(np.concatenate([v, draw(3000)]))
    at, equal = e.successor(p)
    assert (at == np.searchsorted(v, p)).all() and (equal == np.isin(p, v)).all()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**16 - 1), max_size=60), st.lists(st.integers(0, 2**16 - 1), min_size=1, max_size=30))
def test_succinct_set_property(values, probes):
    v, p = np.array(sorted(values), np.uint64), np.array(sorted(probes), np.uint64)
    at, equal = seen.EliasFano(v, 16).successor(p)
    assert at.tolist() == np.searchsorted(v, p).tolist() and equal.tolist() == [x in values for x in sorted(probes)]


def test_runs_stay_few_and_small():
    keys = seen.SeenKeys(64)
    rng = np.random.default_rng(1)
    everything = np.zeros(0, np.uint64)
    for _ in range(30):
        new = np.unique(rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64))
        keys.merge(new)
        everything = np.union1d(everything, new)
    assert len(keys.runs) <= 8 and sum(r.n for r in keys.runs) == len(everything)
    assert keys.contains(everything).all()
    assert max(r.bits_per_key() for r in keys.runs) < 64


def brute(rows):
    first = {}
    for i, k, *_ in rows:
        if i is not None and k is not None:
            first[k] = min(first.get(k, i), i)
    return sorted({(i, i > first[k]) for i, k, *_ in rows if i is not None and k is not None})


def answers(spark, rows, **kw):
    got = seen.seen_before(spark.createDataFrame(rows, SCHEMA), ["k"], "id", **kw).collect()
    return sorted({(r["row_id"], r["seen"]) for r in got})


@pytest.mark.parametrize("batch_rows, partition_keys", [(1 << 17, 10**6), (16, 40), (1, 200)])
def test_against_brute_force(spark, batch_rows, partition_keys):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot", None, f"k{rnd.randrange(200)}"]), 1, 2, None) for i in range(900)]
    rows += [(None, "hot", 0, 0, None), (None, None, 0, 0, None), (5000, "x" * 100_000, 0, 0, True), (5001, "x" * 100_000, 0, 0, True), (5002, "", 0, 0, True), (5003, "", 0, 0, True)]
    rnd.shuffle(rows)
    assert answers(spark, rows, batch_rows=batch_rows, partition_keys=partition_keys) == brute(rows)


def test_repeated_and_tied_rows(spark):
    rows = [(1, "a", 0, 0, None)] * 50 + [(1, "b", 0, 0, None), (2, "b", 0, 0, None), (3, "a", 0, 0, None), (3, "c", 0, 0, None)]
    assert answers(spark, rows, batch_rows=4) == brute(rows) == [(1, False), (2, True), (3, False), (3, True)]
    assert answers(spark, rows) == brute(rows)


def test_one_answer_for_each_row(spark):
    """However rows are split, repeated ones are neither folded away nor multiplied."""
    rows = [(1, "a", 0, 0, None)] * 40 + [(2, "a", 0, 0, None)] * 7 + [(2, "b", 0, 0, None)] * 4 + [(3, "b", 0, 0, None)] * 900
    for parts, batch in ((1, 5), (7, 1 << 17), (3, 1)):
        got = seen.seen_before(spark.createDataFrame(rows, SCHEMA).repartition(parts), ["k"], "id", batch_rows=batch).groupBy("row_id", "seen").count().collect()
        assert sorted(map(tuple, got)) == [(1, False, 40), (2, False, 4), (2, True, 7), (3, True, 900)]


def test_one_order_over_many_batches():
    """Ties are answered as they come, and only their keys are kept until the order moves on."""
    held = seen._Arrivals(64)
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 50, n).astype(np.int64)
    truth, seen_keys, fresh, last = [], set(), set(), None
    for order in (1, 1, 1, 2, 3, 3):
        h = draw(20)
        if order != last:
            seen_keys |= fresh
            fresh, last = set(), order
        truth = [int(x) in seen_keys for x in h]
        fresh |= set(h.tolist())
        assert held.answer(h, np.full(20, order)).tolist() == truth
    h, row = draw(30), np.sort(rng.integers(3, 8, 30))
    want = []
    for x, r in zip(h.tolist(), row.tolist()):
        want.append(x in seen_keys or any(y == x and q < r for y, q in zip(h.tolist(), row.tolist())) or (r > 3 and x in fresh))
    assert held.answer(h, row).tolist() == want


def test_runs_are_stored():
    v = np.unique(np.random.default_rng(3).integers(0, 2**50, 9000, dtype=np.uint64))
    e = seen.EliasFano.from_bytes(seen.EliasFano(v, 50).to_bytes())
    assert (e.decode() == v).all() and e.successor(v)[1].all()
    assert seen.EliasFano.from_bytes(seen.EliasFano(v[:0], 50).to_bytes()).n == 0


def test_batches_against_a_stored_index(spark):
    """Later batches find earlier keys without the rows they came from, also after the partitions were halved."""
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["hot", None, f"k{rnd.randrange(300)}"]), 1, 2, None) for i in range(1200)]
    got, index = [], None
    for a, b, keys in ((0, 300, 10**6), (300, 301, 10**6), (301, 301, 10**6), (301, 1200, 40)):
        df = spark.createDataFrame([r for r in rows if a <= r[0] < b], SCHEMA)
        found, index = seen.seen_with(df, ["k"], "id", index, partition_keys=keys, batch_rows=64)
        got += [(r["row_id"], r["seen"]) for r in found.collect()]
    assert sorted(got) == brute(rows)
    assert index.prefix >= 5 and index.runs.groupBy().sum("n").first()[0] == len({r[1] for r in rows} - {None})


def test_empty(spark):
    assert answers(spark, []) == []
    assert answers(spark, [(None, None, 0, 0, None)]) == []


def test_short_fingerprints_err_as_often_as_said(spark):
    df = spark.range(4000).selectExpr("id", "cast(id as string) k")
    got = seen.seen_before(df, ["k"], "id", fingerprint_bits=16)
    r = seen.wrong_answers(got, df, ["k"], "id", 16).first()
    assert r["n_rows"] == 4000 and r["n_wrong"] == r["n_seen"]
    # on the way from none to all keys kept, half of the final rate
    assert 0.6 < r["wrong_rate"] / (r["expected_rate"] / 2) < 1.4
    assert seen.expected_wrong_rate(4000, 16) == r["expected_rate"]
    exact = seen.wrong_answers(seen.seen_before(df, ["k"], "id"), df, ["k"], "id").first()
    assert exact["n_wrong"] == 0
