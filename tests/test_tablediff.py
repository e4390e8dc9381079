import pytest
from pyspark.sql import functions as F

from cellforge.operators import tablediff as t

SCHEMA = "k bigint, path string, n string, v int, bucket string"
COLUMNS = {"path": t.as_path, "n": t.as_number, "v": t.as_is}


def diff(spark, a, b):
    x, y = (spark.createDataFrame(rows, SCHEMA) for rows in (a, b))
    return sorted(((r["row_key"], r["diff"]) for r in t.table_diff(x, y, "k", COLUMNS).collect()), key=repr)


@pytest.mark.parametrize(
    "text, number",
    [("12", "12"), (" 12 ", "12"), ("+12", "12"), ("000012", "12"), ("12.0", "12"), ("12.000", "12"), ("1,234,567", "1234567"), ("1 234", "1234"), ("0", "0"), ("-0", "0"), ("-7", "-7"),
     ("12.50", "12.5"), ("9" * 40, "9" * 40), ("", ""), ("1.2e3", "1200"), ("9007199254740993e0", "9007199254740993"), ("12345678901234567890e0", "12345678901234567890"), ("-1.50E-3", "-0.0015"), ("1200e-2", "12"), ("0.00e5", "0"), ("1e3x", "1e3x"), ("5.", "5"), ("many", "many"), ("sys", "sys"), (None, None)],
)
def test_numbers_in_one_notation(spark, text, number):
    assert spark.createDataFrame([(text,)], "n string").select(t.as_number(F.col("n"))).first()[0] == number


def test_paths_in_one_notation(spark):
    df = spark.createDataFrame([("a\\b.zip",), ("a/b.zip",), ("./a//b.zip",), (None,)], "p string")
    assert [r[0] for r in df.select(t.as_path(F.col("p"))).collect()] == ["a/b.zip"] * 3 + [None]


def test_every_case(spark):
    a = [(1, "a/b", "5", 1, "x"), (2, "a", "7", None, ""), (3, "c", "1", 2, ""), (5, "e", None, 3, ""), (6, None, None, None, "")]
    b = [(1, "a\\b", "+5.0", 1, "y"), (2, "a", "07", 4, ""), (4, "d", "1", 2, ""), (5, "f", "0", 3, ""), (6, None, None, None, None)]
    assert diff(spark, a, b) == sorted([(2, "v"), (3, "missing_in_mirror"), (4, "missing_in_primary"), (5, "path"), (5, "n")], key=repr)


def test_repeated_rows(spark):
    a = [(1, "a", "5", 1, "")]
    assert diff(spark, a, [(1, "a", "5", 1, ""), (1, "a", "05", 1, ""), (1, "a", " 5", 1, "z")]) == []
    assert diff(spark, a * 1000, a) == []
    # unlike repetitions differ from a side without them, and not from one that has the same
    twice = [(1, "a", "5", 1, ""), (1, "a", "6", 1, "")]
    assert diff(spark, a, twice) == [(1, "n")]
    assert diff(spark, twice, twice[::-1]) == []


def test_unlike_rows_of_a_key_are_sets(spark):
    row = lambda p, n, v: (1, p, n, v, "")
    three = [row("a", n, 1) for n in ("1", "2", "3")]
    assert diff(spark, three, [three[0], three[2]]) == [(1, "n")]
    assert diff(spark, three, three[::-1] * 3) == []
    assert diff(spark, three, [*three, row("a", None, 1)]) == [(1, "n")]
    # which values stand in one row counts too
    assert diff(spark, [row("a", "1", 1), row("b", "2", 1)], [row("a", "2", 1), row("b", "1", 1)]) == [(1, "n"), (1, "path")]
    assert diff(spark, [row("a", None, 1), row("b", "2", 1)], [row("a", "2", 1), row("b", None, 1)]) == [(1, "n"), (1, "path")]
    # other keys beside such a one are compared as ever
    assert diff(spark, [*three, (2, "a", "1", 1, "")], [*three[:2], (2, "a", "1", 2, "")]) == [(1, "n"), (2, "v")]


def test_null_keys_match_nothing(spark):
    row = (None, "a", "5", 1, "")
    assert diff(spark, [row, row], [row]) == [(None, "missing_in_mirror"), (None, "missing_in_primary")]


def test_empty_sides(spark):
    row = (1, "a", "5", 1, "")
    assert diff(spark, [], []) == []
    assert diff(spark, [row], []) == [(1, "missing_in_mirror")]
    assert diff(spark, [], [row]) == [(1, "missing_in_primary")]


def test_values_come_along_and_long_texts_are_compared_whole(spark):
    long = "x" * 200_000
    a = spark.createDataFrame([(1, long + "a", "5", 1, "")], SCHEMA)
    b = spark.createDataFrame([(1, long + "b", "5", 1, "")], SCHEMA)
    r = t.table_diff(a, b, "k", COLUMNS).collect()
    assert [(x["diff"], x["primary_value"][-1], x["mirror_value"][-1]) for x in r] == [("path", "a", "b")]


def test_many_keys_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(t, "BUCKET_ROWS", 50)
    a = [(k, "p", str(k), k % 7, "") for k in range(500)]
    b = [(k, "p", str(k), k % 7 if k % 50 else -1, "") for k in range(100, 600)]
    want = [(k, "missing_in_mirror") for k in range(100)] + [(k, "missing_in_primary") for k in range(500, 600)] + [(k, "v") for k in range(100, 500, 50)]
    assert diff(spark, a, b) == sorted(want, key=repr)


def test_columns_may_have_any_names(spark):
    names = ("k", "many", "bucket", "side", "diff", "value", "alone", "row_key")
    schema = "id bigint, " + ", ".join(f"{n} string" for n in names)
    a = spark.createDataFrame([(1, *"abcdefgh"), (2, *"abcdefgh"), (2, *"xbcdefgh")], schema)
    b = spark.createDataFrame([(1, *"abcdefgX"), (2, *"abcdefgh"), (2, *"xbcdefgY")], schema)
    got = t.table_diff(a, b, "id", {n: t.as_is for n in names}).select("row_key", "diff").collect()
    assert sorted(map(tuple, got)) == [(1, "row_key"), (2, "row_key")]
