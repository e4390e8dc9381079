"""Packed datasets: fixed-width little-endian records in chunk files, by class and longest side, under one manifest.

``write_dataset`` writes one from a DataFrame; ``PackedSource`` reads one, or a stream or chunk of one, as a Spark data source
with one partition per chunk.
"""

from __future__ import annotations

import json
import os
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellforge.operators.shapes import STREAM_PATH, indexed

# Fixed values of the format.
CHUNK_RECORDS = 10_000_000
MANIFEST = "dataset.json"
ENCODINGS = {1: "u64-le-stride8", 2: "u64-le-stride8", 3: "uint-le-fixed"}
CONSTANTS = {"storage_layout": "classified-single-copy", "representative": "minimum-rotation", "ordering": "category-major-parallel-unspecified"}
V3_CONSTANTS = {"equivalence": "one-sided", "category_dimension": "exact-max-bounding-box"}
_CHUNK = re.compile(r"shapes_([0-9]{6,})\.bin\Z")
#: Bytes of a batch on reading: some 100,000 narrow records, few enough for many tasks side by side.
_READ_BYTES = 1 << 20
#: Bytes of a chunk on writing, which one task holds, where records are wide; the format allows smaller chunks than its greatest.
CHUNK_BYTES = 256 << 20


def layout(n: int) -> tuple[int, int]:
    """Stride and bytes of a record for side ``n``."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a whole number of at least 1")
    stride = max(8, n)
    return stride, max(8, -(-n * stride // 8))


# -- manifests


@dataclass(frozen=True)
class Stream:
    path: str
    max_dim: int | None
    hole: bool | None
    count: int


@dataclass(frozen=True)
class Manifest:
    version: int
    dataset_id: str
    stride: int
    record_bytes: int
    used_bits: int
    count: int
    streams: tuple[Stream, ...]


def _number(value: object, version: int, least: int) -> int | None:
    """A count as its version writes it: a plain number, or from version 3 on its digits without padding."""
    if version == 3:
        ok = isinstance(value, str) and re.fullmatch("0|[1-9][0-9]*", value)
    else:
        ok = isinstance(value, int) and not isinstance(value, bool)
    return int(value) if ok and int(value) >= least else None  # type: ignore[call-overload]


def parse_manifest(body: dict, where: str = MANIFEST) -> Manifest:
    """The manifest's facts, or a ValueError that lists every rule it breaks."""
    faults: list[str] = []

    def need(ok: bool, what: str) -> None:
        if not ok:
            faults.append(what)

    version = body.get("format_version")
    if version not in (1, 2, 3) or isinstance(version, bool):
        raise ValueError(f"{where}: unknown format_version {version!r}")
    need(body.get("complete") is True, "not complete")
    need(isinstance(body.get("dataset_id"), str) and bool(body.get("dataset_id")), "no dataset_id")
    need(body.get("encoding") == ENCODINGS[version], "encoding")
    total = _number(body.get("count"), version, 0)
    need(total is not None, "count")
    stride, record, used, most = 8, 8, 64, 8
    if version == 3:
        facts = [body.get(k) for k in ("max_n", "stride", "record_bytes")]
        whole = all(type(x) is int and x > 0 for x in facts)
        need(whole, "max_n, stride and record_bytes must be whole numbers above 0")
        if whole:
            stride, record = layout(facts[0])
            need((stride, record) == (facts[1], facts[2]), "stride or record_bytes don't follow from max_n")
            most, used = facts[0], facts[0] * stride
    wanted = ({} if version == 1 else CONSTANTS) | (V3_CONSTANTS if version == 3 else {})
    for key, value in wanted.items():
        need(body.get(key) == value, key)
    streams: list[Stream] = []
    if version == 1:
        streams.append(Stream("all_fixed", None, None, total or 0))
    else:
        listed = body.get("streams")
        need(isinstance(listed, list), "streams")
        before: tuple[bool, int] = (False, 0)
        for entry in listed if isinstance(listed, list) else []:
            path = entry.get("path") if isinstance(entry, dict) else None
            m = re.match(STREAM_PATH, path) if isinstance(path, str) else None
            if not m or "\n" in path:
                faults.append(f"stream path {path!r}")
                continue
            hole, side = m[1] == "with_holes", int(m[2])
            need(m[2] == f"{side:02d}" and 1 <= side <= most, f"{path}: side")
            need((hole, side) > before, f"{path}: out of order or twice")
            before = (hole, side)
            need(type(entry.get("max_dimension")) is int and entry["max_dimension"] == side, f"{path}: max_dimension")
            need(entry.get("has_hole") is hole, f"{path}: has_hole")
            count = _number(entry.get("count"), version, 1)
            need(count is not None, f"{path}: count")
            streams.append(Stream(path, side, hole, count or 0))
        need(total is None or sum(s.count for s in streams) == total, "the streams' counts don't add up to count")
    if faults:
        raise ValueError(f"{where}: " + "; ".join(faults))
    return Manifest(version, body["dataset_id"], stride, record, used, total or 0, tuple(streams))


def read_manifest(root: str) -> Manifest:
    with open(os.path.join(root, MANIFEST), encoding="utf-8") as f:
        return parse_manifest(json.load(f), os.path.join(root, MANIFEST))


# -- reading


@dataclass
class Chunk(InputPartition):
    """One chunk file, or one entry of an archive, and which of its records are wanted."""

    path: str
    entry: str | None
    count: int
    start: int  # global index of its first record
    stream: Stream
    record_bytes: int
    used_bits: int
    skip: int = 0
    take: int = field(default=-1)

    def __post_init__(self) -> None:
        super().__init__(None)
        if self.take < 0:
            self.take = self.count


def _records(size: int, record: int, name: str) -> int:
    if size % record:
        raise ValueError(f"{name}: {size} bytes are no whole number of {record}-byte records")
    return size // record


def _numbered(names: list[str], strict: bool, where: str) -> list[str]:
    """Chunk names by number. ``strict``: no other ``.bin`` and no number twice."""
    found = {}
    for name in names:
        m = _CHUNK.search(os.path.basename(name))
        if m and os.path.basename(name) == m.group():
            if strict and int(m[1]) in found:
                raise ValueError(f"{where}: chunk {int(m[1])} twice")
            found[int(m[1])] = name
        elif strict and name.endswith(".bin"):
            raise ValueError(f"{where}: stray file {name}")
    return [found[k] for k in sorted(found)]


def chunks_of(path: str, stream: Stream, record: int, used: int, strict: bool, start: int) -> list[Chunk]:
    """The chunks of an archive or a folder, which must have some; a single raw file of any length is read in parts of a chunk's length."""
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            sizes = {i.filename: i.file_size for i in z.infolist()}
        names = _numbered(list(sizes), strict, path)
        if not names and not strict:  # an archive of old with one entry under any name
            names = [n for n in sizes if n.endswith(".bin")][:1]
        parts = [(path, n, sizes[n]) for n in names]
    elif os.path.isdir(path):
        parts = [(os.path.join(path, n), None, os.path.getsize(os.path.join(path, n))) for n in _numbered(os.listdir(path), strict, path)]
    else:
        count = _records(os.path.getsize(path), record, path)
        return [Chunk(path, None, count, start, stream, record, used, at, min(CHUNK_RECORDS, count - at)) for at in range(0, count, CHUNK_RECORDS)]
    if not parts:
        raise FileNotFoundError(f"{path}: no chunks")
    out = []
    for file, entry, size in parts:
        count = _records(size, record, entry or file)
        if count > CHUNK_RECORDS:
            raise ValueError(f"{entry or file}: more than {CHUNK_RECORDS} records")
        out.append(Chunk(file, entry, count, start, stream, record, used))
        start += count
    return out


def discover(root: str) -> list[str]:
    """All raw files under a folder, by path."""
    return sorted(os.path.join(folder, n) for folder, _, names in os.walk(root) for n in names if n.endswith(".bin"))


def plan(path: str) -> list[Chunk]:
    """The chunks behind a dataset's root, a stream or chunk of one, an archive or a raw file, with their global indexes.

    A path inside a version 3 dataset takes its record width from the manifest above it.
    """
    path = os.path.realpath(path)
    root = path if os.path.isdir(path) else os.path.dirname(path)
    while not os.path.isfile(os.path.join(root, MANIFEST)) and os.path.dirname(root) != root:
        root = os.path.dirname(root)
    if not os.path.isfile(os.path.join(root, MANIFEST)):
        return chunks_of(path, Stream(path, None, None, 0), 8, 64, False, 0)
    m = read_manifest(root)
    out: list[Chunk] = []
    for s in m.streams:
        at = os.path.realpath(os.path.join(root, *s.path.split("/")))
        if m.version == 1 and not os.path.isdir(at):
            at += ".zip"
        if os.path.commonpath((root, at)) != root:
            raise ValueError(f"{s.path} leads out of the dataset")
        if not (os.path.isfile(at) if at.endswith(".zip") else os.path.isdir(at)):
            raise ValueError(f"{s.path} is missing or of the wrong kind")
        found = chunks_of(at, s, m.record_bytes, m.used_bits, m.version == 3, sum(c.count for c in out))
        if m.version > 1 and sum(c.count for c in found) != s.count:
            raise ValueError(f"{s.path}: the records don't match the manifest's count")
        out += found
    if sum(c.count for c in out) != m.count:
        raise ValueError("the dataset's records don't match its count")
    if path == root:
        return out
    inside = [c for c in out if path in (c.path, os.path.dirname(c.path))]
    if inside or m.version == 3:
        if not inside:
            raise ValueError(f"{path} is no stream of its dataset")
        return inside
    return chunks_of(path, Stream(path, None, None, 0), 8, 64, False, 0)


def decode(data: bytes, record: int, used: int) -> tuple[pa.Array, pa.Array]:
    """Masks (null where a record is wider than 8 bytes) and the records in hexadecimal (null where it isn't)."""
    n = len(data) // record
    raw = np.frombuffer(data, np.uint8).reshape(n, record)
    bits = np.unpackbits(raw[:, used // 8 :], axis=1, bitorder="little")[:, used % 8 :]
    if bits.any():
        raise ValueError("bits are set beyond the board")
    if record == 8:
        return pa.array(raw.reshape(-1).view("<i8")), pa.nulls(n, pa.string())
    text = data.hex()
    return pa.nulls(n, pa.int64()), pa.array([text[2 * record * i : 2 * record * (i + 1)] for i in range(n)])


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Chunk]:
        first, last = int(self.options.get("from", 1)) - 1, int(self.options.get("to", 0)) - 1
        out = []
        for c in plan(self.options["path"]):
            low = max(c.skip, first - c.start)
            high = c.skip + c.take if last < 0 else min(c.skip + c.take, last + 1 - c.start)
            if low < high:
                c.skip, c.take = low, high - low
                out.append(c)
        return out

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        c, step = partition, max(1, _READ_BYTES // partition.record_bytes)
        archive = zipfile.ZipFile(c.path) if c.entry is not None else None
        with archive.open(c.entry) if archive else open(c.path, "rb") as f:
            f.seek(c.skip * c.record_bytes)
            at, left = c.start + c.skip, c.take
            while left:
                n = min(left, step)
                data = f.read(n * c.record_bytes)
                if len(data) != n * c.record_bytes:
                    raise ValueError(f"{c.path}: it ends early")
                mask, record = decode(data, c.record_bytes, c.used_bits)
                yield pa.record_batch(
                    [pa.array(np.arange(at, at + n)), pa.array([c.stream.hole] * n, pa.bool_()), pa.array([c.stream.max_dim] * n, pa.int32()), mask, record],
                    ["global_index", "hole", "max_dim", "mask", "record"],
                )
                at, left = at + n, left - n


class PackedSource(DataSource):
    """``spark.read.format("cellpack").load(path)``; options ``from`` and ``to`` choose records by their number from 1, both
    included, and leave out chunks without any."""

    @classmethod
    def name(cls) -> str:
        return "cellpack"

    def schema(self) -> str:
        return "global_index bigint, hole boolean, max_dim int, mask bigint, record string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_dataset(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    spark.dataSource.register(PackedSource)
    reader = spark.read.format("cellpack")
    if first is not None:
        reader = reader.option("from", first)
    if last is not None:
        reader = reader.option("to", last)
    return reader.load(path)


def describe(path: str) -> dict[str, int]:
    """Bytes, records and chunks, without decoding any."""
    found = plan(path)
    files = {c.path for c in found}
    return {"bytes": sum(os.path.getsize(f) for f in files), "records": sum(c.take for c in found), "chunks": len(found)}


# -- writing


def _write_chunk(root: str, record: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        hole, side, chunk = (rows.column(c)[0].as_py() for c in ("hole", "max_dim", "chunk"))
        folder = os.path.join(root, "with_holes" if hole else "no_holes", f"n{side:02d}_fixed")
        os.makedirs(folder, exist_ok=True)
        target = os.path.join(folder, f"shapes_{chunk:06d}.bin")
        partial = f"{target}.{os.getpid()}-{time.monotonic_ns()}.partial"
        with open(partial, "wb") as f:
            if record == 8:
                f.write(rows.column("mask").to_numpy().astype("<i8").tobytes())
            else:
                for data in rows.column("record").to_pylist():
                    f.write(data[:record].ljust(record, b"\0"))
        os.replace(partial, target)  # a repeated task writes the same file again
        return pa.table({"hole": [hole], "max_dim": pa.array([side], pa.int32()), "n": [rows.num_rows]})

    return run


def _zip_stream(root: str, level: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        hole, side = rows.column("hole")[0].as_py(), rows.column("max_dim")[0].as_py()
        folder = os.path.join(root, "with_holes" if hole else "no_holes", f"n{side:02d}_fixed")
        target, partial = folder + ".zip", f"{folder}.zip.{os.getpid()}-{time.monotonic_ns()}.partial"
        if os.path.isdir(folder):
            method = zipfile.ZIP_DEFLATED if level else zipfile.ZIP_STORED
            with zipfile.ZipFile(partial, "w", method, compresslevel=level or None) as z:
                for name in _numbered(os.listdir(folder), True, folder):
                    z.write(os.path.join(folder, name), name)
            os.replace(partial, target)
        return rows

    return run


def write_dataset(df: DataFrame, root: str, n: int, *, zip_level: int | None = None, chunk_records: int | None = None) -> dict:
    """Writes ``mask`` (or, for n > 8, ``record`` in hexadecimal), ``hole`` and ``max_dim`` as a packed dataset and returns its manifest.

    Version 2 for n up to 6, else version 3. ``root`` is a folder that all executors share, and must be empty or
    missing. One task writes one chunk; with ``zip_level`` (0 stores, 1 to 9 deflate) one then packs each stream's. The manifest comes last, under
    another name first, so that a folder without one is unfinished. A null or contradictory class raises, and so does a dataset that hasn't as many records as
    ``df``. Without ``chunk_records`` a chunk has up to ``CHUNK_BYTES``, and no more records than the format allows.
    """
    stride, record = layout(n)
    chunk_records = min(CHUNK_RECORDS, max(1, CHUNK_BYTES // record)) if chunk_records is None else chunk_records
    if zip_level is not None and not 0 <= zip_level <= 9:
        raise ValueError("zip_level must be from 0 to 9")
    if not 1 <= chunk_records <= CHUNK_RECORDS:
        raise ValueError(f"chunk_records must be from 1 to {CHUNK_RECORDS}")
    if os.path.isdir(root) and os.listdir(root):
        raise FileExistsError(f"{root} is not empty")
    os.makedirs(root, exist_ok=True)
    value = "mask" if record == 8 else "record"
    # unsigned order of the masks
    order = [F.col("hole"), F.col("max_dim"), F.col(value).bitwiseXOR(F.lit(-(1 << 63))) if record == 8 else F.col(value)]
    numbered = indexed(df.select("hole", "max_dim", value, order[2].alias("order__")), ["hole", "max_dim", "order__"])
    # two classes for each side
    starts = numbered.groupBy("hole", "max_dim").agg(F.min("global_index").alias("start"))
    at = F.col("global_index") - F.col("start")
    placed = numbered.join(F.broadcast(starts), ["hole", "max_dim"]).select("hole", "max_dim", F.col(value) if record == 8 else F.unhex(value).alias(value), at.alias("at"), F.floor(at / chunk_records).cast("int").alias("chunk"))
    written = placed.groupBy("hole", "max_dim", "chunk").applyInArrow(_write_chunk(root, record), "hole boolean, max_dim int, n bigint")
    streams = sorted((r["hole"], r["max_dim"], r["n"]) for r in written.groupBy("hole", "max_dim").agg(F.sum("n").alias("n")).collect())
    total = sum(s[2] for s in streams)
    if total != (given := df.count()):
        raise ValueError(f"{total} records were written of {given}: a class is null, or the rows aren't the same at every reading")
    if zip_level is not None and streams:
        listed = df.sparkSession.createDataFrame([s[:2] for s in streams], "hole boolean, max_dim int")
        listed.groupBy("hole", "max_dim").applyInArrow(_zip_stream(root, zip_level), "hole boolean, max_dim int").count()
        import shutil

        for hole, side, _ in streams:
            shutil.rmtree(os.path.join(root, "with_holes" if hole else "no_holes", f"n{side:02d}_fixed"))
    version = 2 if n <= 6 else 3
    write = str if version == 3 else int
    body = {"format_version": version, "dataset_id": f"{time.time_ns()}-{os.getpid()}", "max_n": n}
    if version == 3:
        body |= {"stride": stride, "record_bytes": record}
    body |= {"count": write(total), "encoding": ENCODINGS[version]} | V3_CONSTANTS | CONSTANTS
    end = "" if zip_level is None else ".zip"
    body["streams"] = [{"path": f"{'with_holes' if hole else 'no_holes'}/n{side:02d}_fixed{end}", "max_dimension": side, "has_hole": hole, "count": write(count)} for hole, side, count in streams]
    body["complete"] = True
    parse_manifest(body)
    partial = os.path.join(root, MANIFEST + ".partial")
    with open(partial, "x", encoding="utf-8") as f:
        json.dump(body, f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.rename(partial, os.path.join(root, MANIFEST))
    return body


def write_table(df: DataFrame, path: str) -> None:
    """The same classes as a Parquet table, partitioned by class and side; refuses an existing one."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", CHUNK_RECORDS).partitionBy("hole", "max_dim").parquet(path)


# -- landmarks as assets


def write_rooms(rooms: DataFrame, root: str, label: str) -> dict:
    """Chosen shapes (``selection_order``, ``global_index``, ``mask``, ``width``, ``height``, ``size``, ``hole``) as ``rooms.bin``, their masks one after another, and
    ``rooms.json`` with the rest, both by selection order. A selection that is made to be looked at, and small; its rows
    come one partition at a time."""
    os.makedirs(root, exist_ok=True)
    listed, n, cells, holes = [], 0, 0, 0
    ordered = rooms.orderBy(F.col("selection_order").isNull(), "selection_order", "global_index", "mask")
    with open(os.path.join(root, "rooms.bin"), "wb") as f:
        for r in ordered.toLocalIterator():
            f.write((r["mask"] & (2**64 - 1)).to_bytes(8, "little"))
            listed.append({k: r[k] for k in ("selection_order", "global_index", "width", "height", "size", "hole")})
            n, cells, holes = n + 1, cells + r["size"], holes + bool(r["hole"])
    body = {"label": label, "count": n, "avg_size": round(cells / n, 1) if n else 0, "holes_count": holes, "format": "rooms.bin has one little-endian 64-bit mask of stride 8 for each room", "rooms": listed}
    with open(os.path.join(root, "rooms.json"), "w", encoding="utf-8") as f:
        json.dump(body, f, ensure_ascii=False, indent=2)
    return body


def read_rooms(spark: SparkSession, root: str) -> DataFrame:
    """What ``write_rooms`` wrote: the masks with their facts. Raises where the two files don't have as many."""
    with open(os.path.join(root, "rooms.json"), encoding="utf-8") as f:
        listed = json.load(f)["rooms"]
    masks = np.fromfile(os.path.join(root, "rooms.bin"), "<i8")
    if len(masks) != len(listed):
        raise ValueError(f"{root}: {len(masks)} masks and {len(listed)} rooms")
    keys = ("selection_order", "global_index", "width", "height", "size", "hole")
    rows = [(*(r.get(k) for k in keys), int(m)) for r, m in zip(listed, masks, strict=True)]
    return spark.createDataFrame(rows, "selection_order int, global_index bigint, width int, height int, size int, hole boolean, mask bigint")
