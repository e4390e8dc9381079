import random

import pytest
from pyspark.sql import functions as F

from cellforge import queries
from cellforge.operators import shapes as sh
from cellforge.streaming import running


def test_index_is_dense_and_ordered(spark):
    rnd = random.Random(1)
    values = [rnd.choice([1, 1, 1, rnd.randrange(1000)]) for _ in range(2000)]
    got = sh.indexed(spark.createDataFrame([(v,) for v in values], "v int"), ["v"]).orderBy("global_index").collect()
    assert [r["global_index"] for r in got] == list(range(2000)) and [r["v"] for r in got] == sorted(values)
    assert sh.indexed(spark.createDataFrame([], "v int"), ["v"]).count() == 0


def test_range_rules(spark):
    df = spark.range(10).select(F.col("id").alias("global_index"), (F.col("id") % 2 == 0).alias("hole"))
    assert [r[0] for r in sh.index_range(df, 3, 5).collect()] == [2, 3, 4]
    assert [r[0] for r in sh.index_range(df, 5, 9, limit=2).collect()] == [0, 1]
    assert [r[0] for r in sh.index_range(df, 1, 4, hole=True).collect()] == [0, 2]
    try:
        sh.index_range(df, 5, 4)
    except ValueError:
        return
    raise AssertionError


def test_checks_find_what_is_wrong(spark):
    rows = [(1, 460039, 3, 3, 8, 3, True), (2, 460039, 3, 2, 7, 4, False), (3, 458759, 3, 3, 6, 3, False), (4, 257, 1, 2, 2, 2, False), (5, 2, None, 1, None, 1, None)]
    df = spark.createDataFrame(rows, "id int, m bigint, w int, h int, size int, d int, hole_flag boolean")
    got = {r["id"]: {k for k in sh.RULES if r[k] is False} for r in sh.checked(df, "m", "w", "h", "size", "d", "hole_flag").collect()}
    assert got[1] == set()
    assert got[2] == {"h_right", "size_right", "max_dim_right", "hole_right"}
    assert "connected" in got[3]
    assert got[4] == {"canonical_right"}
    assert got[5] == {"at_origin", "canonical_right"}


def test_log_as_a_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/shapes.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "log"))
    log = running.read_log(spark, str(tmp_path / "log"), batch.schema)
    q = running.windowed_counts(log, "1 day", "400 days").writeStream.outputMode("update").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.sql("select window_start, max_dimension, has_hole, max(n_rows) n from counts group by all")
    want = batch.where("emitted_at is not null").count()
    assert last.agg(F.sum("n")).first()[0] == want
    once = running.first_of_each(log, "400 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination(120)
    distinct = batch.where("dataset_id is not null and cells is not null and emitted_at is not null").select("dataset_id", "cells").distinct().count()
    assert spark.table("once").count() == distinct


def _record(at, stride):
    return sum(1 << (stride * r + c) for r, c in at).to_bytes(13, "little").hex()


def test_wide_checks_find_what_is_wrong(spark):
    ring = [(r, c) for r in range(9) for c in range(9) if r in (0, 8) or c in (0, 8)]
    bar, ell = [(0, c) for c in range(9)], [(0, c) for c in range(9)] + [(1, 8)]
    rows = [
        (1, ring, 9, 9, 32, 9, True), (2, ring, 9, 8, 31, 10, False), (3, bar, 9, 1, 9, 9, False), (4, [(r, 0) for r in range(9)], 1, 9, 9, 9, False),
        (5, [(0, 0), (0, 8)], 9, 1, 2, 9, False), (6, [(1, c) for c in range(9)], 9, 1, 9, 9, False), (7, bar, None, 1, None, 9, None), (8, ell, 9, 2, 10, 9, False), (9, [], 0, 0, 0, 0, None),
    ]
    data = [(i, _record(at, 10), 10, *rest) for i, at, *rest in rows] + [(10, "zz", 10, 1, 1, 1, 1, False), (11, _record(bar, 10), None, 1, 1, 1, 1, False)]
    df = spark.createDataFrame(data, "id int, m string, stride int, w int, h int, size int, d int, flag boolean")
    got = {r["id"]: {k for k in sh.RULES if r[k] is False} for r in sh.checked_wide(df, "m", "stride", "w", "h", "size", "d", "flag").collect()}
    assert got[1] == got[3] == got[7] == got[10] == got[11] == set()
    assert got[2] == {"h_right", "size_right", "max_dim_right", "hole_right"}
    assert got[4] == {"canonical_right"}
    assert got[5] == {"connected"}
    assert got[6] == {"at_origin", "canonical_right"}
    turned = [[(c, -r) for r, c in ell], [(-r, -c) for r, c in ell], [(-c, r) for r, c in ell]]
    least = min(sum(1 << (10 * (r - min(y for y, _ in t)) + c - min(z for _, z in t)) for r, c in t) for t in [ell, *turned])
    assert got[8] == (set() if int.from_bytes(bytes.fromhex(_record(ell, 10)), "little") == least else {"canonical_right"})
    assert "not_empty" in got[9] and "connected" in got[9]


def test_every_record_is_checked_and_placed(spark, sf_dir):
    shapes = spark.read.parquet(f"{sf_dir}/shapes.parquet")
    held = shapes.where("cells is not null or wide_cells is not null")
    verdicts = {r["dataset_id"]: r for r in queries.verify_records(spark, sf_dir).collect()}
    assert {k: r["n_records"] for k, r in verdicts.items()} == {r[0]: r[1] for r in held.groupBy("dataset_id").count().collect()}
    narrow = {r["dataset_id"]: r for r in queries.verify_exports(spark, sf_dir).collect()}
    broad = {r[0] for r in shapes.where("wide_cells is not null").select("dataset_id").distinct().collect()}
    assert broad and not broad & set(narrow) and all(verdicts[k] == r for k, r in narrow.items())
    places = queries.record_index(spark, sf_dir).collect()
    places.sort(key=lambda r: r["global_index"])
    value = lambda r: (r["has_hole"], r["max_dimension"], int.from_bytes(bytes.fromhex(r["record"]), "little"), r["record_id"])
    assert [r["global_index"] for r in places] == list(range(held.dropna(subset=["has_hole", "max_dimension", "record_id"]).count()))
    assert [value(r) for r in places] == sorted(value(r) for r in places)
    want = held.where("dataset_id is not null").groupBy("dataset_id", "cells", "wide_cells").count().where("count > 1").count()
    assert queries.duplicate_records(spark, sf_dir).count() == want


def _least(at):
    """The least of the four turns, moved to (0, 0), as an unsigned number of stride 8."""
    turns = [set(at)]
    for _ in range(3):
        turns.append({(c, -r) for r, c in turns[-1]})
    low = lambda t: (min(r for r, _ in t), min(c for _, c in t))
    return min(sum(1 << (8 * (r - low(t)[0]) + c - low(t)[1]) for r, c in t) for t in turns)


def _grown_by_force(masks):
    """Child to how many of the masks, made distinct by turning, lead to it within 8 x 8."""
    out = {}
    for mask in {_least([divmod(i, 8) for i in range(64) if m >> i & 1]) for m in masks}:
        at = {divmod(i, 8) for i in range(64) if mask >> i & 1}
        new = {(r + y, c + x) for r, c in at for y, x in ((0, 1), (1, 0), (0, -1), (-1, 0))} - at
        kids = set()
        for cell in new:
            kid = at | {cell}
            if max(max(k[i] for k in kid) - min(k[i] for k in kid) for i in (0, 1)) < 8:
                kids.add(_least(kid))
        for k in kids:
            out[k] = out.get(k, 0) + 1
    return out


@pytest.fixture
def logged(spark, tmp_path):
    rnd, masks = random.Random(4), [1, (1 << 7) - 1, (1 << 8) - 1, 2**64 - 1, sum(1 << 8 * r for r in range(7))]
    for size in [3, 8, 14, 20, 26, 32, 38] * 6:
        at = {(rnd.randrange(8), rnd.randrange(8))}
        while len(at) < size:
            r, c = rnd.choice(sorted(at))
            y, x = rnd.choice([(0, 1), (1, 0), (0, -1), (-1, 0)])
            if 0 <= r + y < 8 and 0 <= c + x < 8:
                at.add((r + y, c + x))
        masks.append(sum(1 << (8 * r + c) for r, c in at))
    signed = [(i, "a", m - (m >> 63 << 64)) for i, m in enumerate(masks)]
    spark.createDataFrame(signed, "record_id bigint, dataset_id string, cells bigint").write.parquet(str(tmp_path / "shapes.parquet"))
    return str(tmp_path), masks


def test_children_against_brute_force(spark, logged):
    path, masks = logged
    got = {r["mask"] % (1 << 64): r["parents"] for r in queries.growth_children(spark, path).collect()}
    assert got == _grown_by_force(masks)


def test_as_of_against_brute_force(spark):
    """Ties, nulls, keys without marks and a key that holds most rows, over many partitions."""
    rnd = random.Random(12)
    key = lambda: rnd.choice(["a", "a", "a", "b", "c", None])
    points = [(i, key(), rnd.choice([None, rnd.randrange(100)])) for i in range(300)]
    marks = [(k, rnd.choice([None, rnd.randrange(100)]), i) for i, k in enumerate(rnd.choices(["a", "a", "b", None], k=80))]
    got = sh.as_of(spark.createDataFrame(points, "id int, k string, at int"), spark.createDataFrame(marks, "k string, at int, value int"), ["k"], "at", "m").collect()
    want = {}
    for i, k, at in points:
        held = [(a, v) for q, a, v in marks if q == k and k is not None and a is not None and at is not None and a <= at]
        want[i] = max(held)[1] if held else None
    assert {r["id"]: r["m"] and r["m"]["value"] for r in got} == want and len(got) == 300 and any(want.values())


def test_ranges_over_chunks(spark):
    chunks = [("a", i, 10 * i, 10) for i in range(20)] + [("a", 99, 200, 0), ("b", 0, 5, 3), ("b", 1, 8, 1000)]
    asked = [("a", 1, 0, 0), ("a", 2, 15, 44), ("a", 3, 199, 500), ("a", 4, 200, 300), ("b", 5, 0, 4), ("b", 6, 0, 8), ("c", 7, 0, 9)]
    got = sh.asked_chunks(spark.createDataFrame(asked, "k string, id int, first int, last int"), spark.createDataFrame(chunks, "k string, chunk int, start int, count int")).collect()
    want = sorted((i, c, min(b, s + n - 1) - max(a, s) + 1) for k, i, a, b in asked for q, c, s, n in chunks if k == q and n and max(a, s) <= min(b, s + n - 1))
    assert sorted((r["id"], r["chunk"], r["wanted"]) for r in got) == want


def test_records_by_index(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 3), ("b", 9)], "g string, m int")
    numbered = sh.indexed_within(rows, "g", ["m"])
    assert sorted((r["g"], r["m"], r["global_index"]) for r in numbered.collect()) == [("a", 3, 0), ("a", 5, 1), ("b", 9, 0)]
    asked = spark.createDataFrame([("a", 0, 3), ("a", 1, 4), ("a", 2, 5), ("b", 0, None), (None, 0, 9)], "g string, global_index int, mask int")
    found = sh.extracted(asked, numbered, "g", "mask", "m").collect()
    got = {(r["g"], r["global_index"]): (r["record_mask"], r["same"]) for r in found}
    assert got == {("a", 0): (3, True), ("a", 1): (5, False), ("a", 2): (None, None), ("b", 0): (9, None), (None, 0): (None, None)}
