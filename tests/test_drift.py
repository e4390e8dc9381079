import json
import random
from datetime import datetime, timedelta

import pytest

from cellforge.operators import drift

SCHEMA = "file_id bigint, series_id bigint, written_at timestamp_ntz, body string, encoding string, part int"
T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize(
    "keys, want",
    [
        ({"format_version": "int", "encoding": "string", "record_bytes": "int", "stride": "int"}, {"format_version": "format_version", "encoding": "encoding", "record_bytes": "record_bytes", "stride": "stride"}),
        ({"formatVersion": "float", "mask_encoding": "array", "bytes_per_record": "string", "rowStride": "int", "writer_version": "string", "bytes_total": "int"}, {"format_version": "formatVersion", "encoding": "mask_encoding", "record_bytes": "bytes_per_record", "stride": "rowStride"}),
        ({"version": "int", "writer_version": "string", "layout": "object", "layout.stride": "int", "layout.record_bytes": "float"}, {"format_version": "version", "record_bytes": "layout.record_bytes", "stride": "layout.stride"}),
        ({"Encoding": "object", "Encoding.name": "string", "Encoding.order": "string", "manifest_version": "string"}, {"encoding": "Encoding", "format_version": "manifest_version"}),
        ({"writer_version": "string", "bytes_total": "int", "note": "string", "ordering": "string", "max_n": "int", "count": "int", "complete": "bool"}, {}),
        ({"version": "string"}, {"format_version": "version"}),
        ({"version": "string", "writer_version": "string"}, {"format_version": "version"}),
        ({"writer_version": "string"}, {}),
        ({}, {}),
    ],
)
def test_matching(keys, want):
    assert drift.matched(sorted(keys.items())) == want


def test_words():
    assert drift.words("formatVersion") == drift.words("format-version") == drift.words("FORMAT_VERSION") == drift.words("x.format version") == ["format", "version"]


@pytest.mark.parametrize("body, ok", [('{"a": 1}', True), ('﻿ {"a": 1}\n', True), ('{"a": 1', False), ('{"a": NaN}', False), ("", False), (None, False), ("[1]", True), ("3", True), ('{"a": 1} x', False), ("[" * 100_000, False)])
def test_complete_json_only(body, ok):
    assert drift.flatten(body)[0] is ok


def test_flattening():
    _, keys = drift.flatten('{"a": null, "b": 2.0, "c": {"d": true, "e": 12345678901234567890123}, "f": [1]}')
    assert keys == [("b", "float", "2.0"), ("c", "object", '{"d": true, "e": "12345678901234567890123"}'), ("c.d", "bool", "True"), ("c.e", "int", "12345678901234567890123"), ("f", "array", '["1"]')]


def run(spark, bodies, series=None):
    rows = [(i, series[i] if series else 1, T0 + timedelta(hours=i), b if b is None or isinstance(b, str) else json.dumps(b), "clash", 0) for i, b in enumerate(bodies)]
    return drift.unified(spark.createDataFrame(rows, SCHEMA))


def found(table):
    return sorted((r["file_id"], r["field_name"], r["change_kind"]) for r in drift.changes(table, "series_id", ["written_at", "file_id"]).collect())


def test_one_consistent_table(spark):
    table = run(spark, [{"format_version": 3, "encoding": "uint-le-fixed", "record_bytes": 8, "stride": 8}, {"formatVersion": "3", "encoding": {"name": "u64-le-stride8"}, "record_bytes": 8.0, "Stride": "8 "}, {"encoding": ["uint-le-fixed"], "stride": "wide", "record_bytes": None}, "{", None])
    got = {r["file_id"]: r for r in table.collect()}
    assert sorted(got) == [0, 1, 2]
    assert [got[0][f] for f in drift.FIELDS] == [3, "uint-le-fixed", 8, 8]
    assert [got[1][f] for f in drift.FIELDS] == [3, "u64-le-stride8", 8, 8]
    assert [got[2][f] for f in drift.FIELDS] == [None, "uint-le-fixed", None, None]
    assert got[2]["stride_key"] == "stride" and got[2]["stride_kind"] == "string" and got[2]["record_bytes_key"] is None


def test_changes(spark):
    table = run(spark, [{"format_version": 3}, "broken", {"formatVersion": 3.0, "stride": 8}, {"formatVersion": 3.0, "stride": None}, {"formatVersion": 3.0}, None, {}])
    assert found(table) == [(2, "format_version", "renamed"), (2, "format_version", "retyped"), (2, "stride", "added"), (3, "stride", "removed"), (6, "format_version", "removed")]


def test_empty(spark):
    assert found(run(spark, [])) == []
    assert found(run(spark, ["{", None])) == []


def test_long_series_over_many_partitions_with_ties(spark):
    rnd = random.Random(5)
    names = {"format_version": ["format_version", "version"], "stride": ["stride", "rowStride"]}
    bodies, series = [], []
    for _ in range(400):
        bodies.append({rnd.choice(v): rnd.choice([1, 1.5, "1"]) for v in names.values() if rnd.random() < 0.8})
        series.append(rnd.choice([1, 1, 1, 1, 2, 3, None]))
    rows = [(i, s, T0 + timedelta(hours=i // 3), json.dumps(b), "", 0) for i, (b, s) in enumerate(zip(bodies, series))]
    rnd.shuffle(rows)
    got = found(drift.unified(spark.createDataFrame(rows, SCHEMA)))
    want, last = [], {}
    kind = {int: "int", float: "float", str: "string"}
    for i, (b, s) in enumerate(zip(bodies, series)):
        now = {f: next(((n, kind[type(b[n])]) for n in v if n in b), None) for f, v in names.items()}
        for f, x in now.items():
            was = last.get(s, {}).get(f)
            if s in last:
                want += [(i, f, "added")] if x and not was else [(i, f, "removed")] if was and not x else []
                if x and was:
                    want += [(i, f, "renamed")] * (x[0] != was[0]) + [(i, f, "retyped")] * (x[1] != was[1])
        last[s] = now
    assert got == sorted(want)


def test_fields_come_from_the_flood(spark, monkeypatch):
    """Without a round no pair of keys has a score, and nothing is found."""
    honest = drift.flood
    monkeypatch.setattr(drift, "flood", lambda g: honest(g, rounds=0))
    assert drift.matched([("format_version", "int"), ("stride", "int")]) == {}


def test_types_and_nesting_decide_between_like_names():
    """Two keys as like a field by their words: the one whose values are typed like the field's, or that isn't nested, carries it."""
    corpus = drift.Corpus({"stride": {"int": 0.7, "float": 0.3}, "encoding": {"object": 1.0}})
    assert drift.matched([("aStride", "string"), ("bStride", "float")], None, corpus) == {"stride": "bStride"}
    assert drift.matched([("a_encoding", "string"), ("b_encoding", "object")], None, corpus) == {"encoding": "b_encoding"}
    assert drift.matched([("a", "object"), ("a.rowStride", "int"), ("cellStride", "int")]) == {"stride": "cellStride"}


def test_a_key_beside_a_field_is_another(spark):
    """A name that stands beside the field's own in one body carries it in no other; no list of names says so."""
    beside = {"record_bytes": 8, "stride": 8, "encoding": "x", "format_version": 2, "record_count": 5, "format_note": "n"}
    table = run(spark, [beside, {"record_count": 7, "format_note": "m"}, {"bytes_per_record": 8, "record_count": 1}])
    got = {r["file_id"]: r for r in table.collect()}
    assert got[0]["record_bytes_key"] == "record_bytes" and got[2]["record_bytes_key"] == "bytes_per_record"
    assert all(got[1][f"{f}_key"] is None for f in drift.FIELDS)


def test_schemas_are_matched_to_a_fixpoint():
    g = drift.graphs([("formatVersion", "int"), ("mask_encoding", "array"), ("layout", "object"), ("layout.stride", "int")])
    import numpy as np

    assert np.allclose(drift.flood(g, 200, 1e-9), drift.flood(g, 400, 1e-9), atol=1e-6) and drift.flood(g).max() == 1


def test_other_columns_may_have_any_names(spark):
    names = ("signature", "p", "keys__", "name", "seen", "stride_key")
    rows = [(i, "s", json.dumps({"stride": 8, "rowPitch": i}), *"abcdef") for i in range(3)]
    df = spark.createDataFrame(rows, "file_id int, series string, body string, " + ", ".join(f"{n} string" for n in names))
    got = drift.unified(df).collect()
    assert len(got) == 3 and all(r["signature"] == "a" and r["p"] == "b" and r["stride_key"] == "stride" and r["stride"] == 8 for r in got)
