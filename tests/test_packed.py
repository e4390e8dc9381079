import json
import os
import zipfile

import pytest

from cellforge.operators import shapes as sh
from cellforge.sources import packed as p

MASKS = (1, 3, 259, 771, 197895, 460039, 7, 263, 519, 132866)


@pytest.fixture(scope="module")
def shapes(spark):
    return sh.one_sided(spark.createDataFrame([(m,) for m in MASKS], "mask bigint")).select("mask", "hole", "max_dim").cache()


def masks(df):
    return [r["mask"] for r in df.orderBy("global_index").collect()]


@pytest.mark.parametrize("level", [None, 0, 1])
def test_round_trip(spark, shapes, tmp_path, level):
    root = str(tmp_path / "out")
    body = p.write_dataset(shapes, root, 3, zip_level=level, chunk_records=2)
    assert body["format_version"] == 2 and body["count"] == 10 and len(body["streams"]) == 4
    assert masks(p.read_dataset(spark, root)) == [1, 3, 259, 771, 7, 263, 519, 132866, 197895, 460039]
    assert masks(p.read_dataset(spark, root, 3, 5)) == [259, 771, 7]
    assert p.describe(root)["records"] == 10 and p.describe(root)["chunks"] == 6
    with pytest.raises(FileExistsError):
        p.write_dataset(shapes, root, 3)


def test_wide_records(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([(False, 9, "01" + "00" * 8 + "01"), (False, 9, "05")], "hole boolean, max_dim int, record string")
    assert p.write_dataset(rows, root, 9)["record_bytes"] == 11
    assert [r["record"] for r in p.read_dataset(spark, root).orderBy("global_index").collect()] == ["01" + "00" * 8 + "0100", "05" + "00" * 10]
    # a stream or a chunk of it takes its width from the manifest above
    stream = os.path.join(root, "no_holes", "n09_fixed")
    assert p.read_dataset(spark, stream).count() == p.read_dataset(spark, os.path.join(stream, "shapes_000000.bin")).count() == 2
    with open(os.path.join(stream, "shapes_000000.bin"), "r+b") as f:
        f.write(b"\xff" * 11)
    with pytest.raises(Exception, match="beyond the board"):
        p.read_dataset(spark, root).collect()


def test_raw_archives_and_first_version(spark, tmp_path):
    def bin_(*xs):
        return b"".join(x.to_bytes(8, "little") for x in xs)

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/shapes_2000003.bin").write_bytes(bin_(3))
    (tmp_path / "raw/shapes_000012.bin").write_bytes(bin_(1, 2))
    assert masks(p.read_dataset(spark, str(tmp_path / "raw"))) == [1, 2, 3]
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as z:
        z.writestr("any.bin", bin_(8, 9))
    assert masks(p.read_dataset(spark, str(tmp_path / "old.zip"))) == [8, 9]
    root = tmp_path / "v1"
    (root / "all_fixed").mkdir(parents=True)
    (root / "all_fixed/shapes_000000.bin").write_bytes(bin_(7, 8))
    (root / "dataset.json").write_text(json.dumps({"format_version": 1, "count": 2, "complete": True, "encoding": "u64-le-stride8", "dataset_id": "x"}))
    assert masks(p.read_dataset(spark, str(root))) == [7, 8]
    (root / "all_fixed/shapes_000000.bin").write_bytes(bin_(7, 8) + b"1")
    with pytest.raises(ValueError, match="whole number"):
        p.plan(str(root))


GOOD = {
    "format_version": 3, "dataset_id": "d", "max_n": 9, "stride": 9, "record_bytes": 11, "count": "3", "encoding": "uint-le-fixed", "complete": True, **p.CONSTANTS, **p.V3_CONSTANTS,
    "streams": [{"path": "no_holes/n09_fixed", "max_dimension": 9, "has_hole": False, "count": "1"}, {"path": "with_holes/n03_fixed.zip", "max_dimension": 3, "has_hole": True, "count": "2"}],
}


def test_good_manifest():
    m = p.parse_manifest(GOOD)
    assert (m.stride, m.record_bytes, m.used_bits, m.count, len(m.streams)) == (9, 11, 81, 3, 2)


def _with(**changes):
    return GOOD | changes


def _stream(i, **changes):
    streams = [dict(s) for s in GOOD["streams"]]
    streams[i] |= changes
    return GOOD | {"streams": streams}


@pytest.mark.parametrize(
    "body",
    [
        _with(complete=False), _with(complete=1), _with(dataset_id=""), _with(encoding="u64-le-stride8"), _with(count=3), _with(count="03"), _with(count="4"), _with(max_n=True), _with(stride=8), _with(record_bytes=8),
        _with(equivalence="fixed"), _with(ordering="x"), _with(storage_layout=None), _with(representative=None), _with(streams=None), _with(streams=GOOD["streams"][::-1]), _with(streams=[GOOD["streams"][0]] * 2), _with(format_version=4),
        _with(format_version=True), _stream(0, path="../n09_fixed"), _stream(0, path="no_holes/n9_fixed"), _stream(0, path="no_holes/n009_fixed"), _stream(0, path="no_holes/n10_fixed"), _stream(0, max_dimension=9.0), _stream(0, has_hole=0),
        _stream(0, has_hole=True), _stream(0, count="0"), _stream(0, count=1), _stream(1, max_dimension=4),
    ],
)
def test_bad_manifests(body):
    with pytest.raises(ValueError):
        p.parse_manifest(body)


def test_layout():
    assert [p.layout(n) for n in (2, 7, 11, 24, 40)] == [(8, 8), (8, 8), (11, 16), (24, 72), (40, 200)]
    with pytest.raises(ValueError):
        p.layout(0)


def test_parquet_table(spark, shapes, tmp_path):
    p.write_table(shapes, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("hole = 'true'").count() == 2
    with pytest.raises(Exception, match="already exists"):
        p.write_table(shapes, str(tmp_path / "t"))


def test_a_long_raw_file_is_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(p, "CHUNK_RECORDS", 4)
    path = tmp_path / "one.bin"
    path.write_bytes(b"".join(i.to_bytes(8, "little") for i in range(11)))
    assert [(c.skip, c.take) for c in p.plan(str(path))] == [(0, 4), (4, 4), (8, 3)]
    assert masks(p.read_dataset(spark, str(path))) == list(range(11))
    assert masks(p.read_dataset(spark, str(path), 4, 9)) == list(range(3, 9))
    assert p.describe(str(path))["records"] == 11
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder/shapes_000000.bin").write_bytes(path.read_bytes())
    with pytest.raises(ValueError, match="more than"):
        p.plan(str(tmp_path / "folder"))


def test_nothing_to_read_raises(tmp_path):
    (tmp_path / "empty").mkdir()
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("readme.txt", "x")
    for name in ("empty", "empty.zip"):
        with pytest.raises(FileNotFoundError, match="no chunks"):
            p.plan(str(tmp_path / name))
    (tmp_path / "none.bin").write_bytes(b"")
    assert p.plan(str(tmp_path / "none.bin")) == []


def test_raw_files_are_found_at_any_depth(tmp_path):
    for name in ("a/b/x.bin", "y.bin", "a/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    assert [os.path.relpath(f, tmp_path) for f in p.discover(str(tmp_path))] == ["a/b/x.bin", "y.bin"]


def test_written_records_are_held_against_the_input(spark, tmp_path):
    rows = spark.createDataFrame([(False, 2, 3), (None, 2, 7)], "hole boolean, max_dim int, mask bigint")
    with pytest.raises(Exception, match="class is null"):
        p.write_dataset(rows, str(tmp_path / "out"), 2)
    assert not (tmp_path / "out" / p.MANIFEST).exists()


def test_rooms_round_trip(spark, tmp_path):
    marks = spark.createDataFrame([(1, "x", 2, 40, 7), (2, "x", 1, 41, 197895), (3, "x", None, 42, -(1 << 63))], "landmark_id bigint, label string, selection_order int, global_index bigint, mask bigint")
    body = p.write_rooms(sh.rooms(marks), str(tmp_path / "r"), "x")
    assert (body["count"], body["holes_count"], body["avg_size"]) == (3, 1, 3.7)
    got = p.read_rooms(spark, str(tmp_path / "r")).collect()
    assert [(r["selection_order"], r["mask"], r["size"], r["hole"]) for r in got] == [(1, 197895, 7, True), (2, 7, 3, False), (None, -(1 << 63), 1, False)]
    (tmp_path / "r/rooms.bin").write_bytes(b"\0" * 8)
    with pytest.raises(ValueError, match="1 masks and 3 rooms"):
        p.read_rooms(spark, str(tmp_path / "r"))
    assert p.write_rooms(sh.rooms(marks.limit(0)), str(tmp_path / "e"), "x")["count"] == 0 and p.read_rooms(spark, str(tmp_path / "e")).count() == 0
