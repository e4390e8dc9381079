"""Has this key been seen before? (problem 1)

Keys are hashed, the hash range is cut into partitions, and each partition goes through its rows in
order of arrival, batch by batch, holding the earlier keys only as Elias-Fano runs. The runs can be stored,
and later batches probed against them and merged in.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellforge.session import cut, width

#: Keys that one partition is to hold; at some 30 to 40 bits each they take about 20 MB.
PARTITION_KEYS = 4_000_000
#: Rows probed and merged at once.
BATCH_ROWS = 1 << 17


class EliasFano:
    """A sorted set of whole numbers: high bits in unary, low bits packed, with a rank directory for the unary part."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        """``values``: sorted, distinct, unsigned and below 2**bits."""
        n = self.n = len(values)
        self.low_bits = low = max(0, bits - max(1, int(n).bit_length())) if n else 0
        high = (values >> np.uint64(low)).astype(np.int64)
        places = high + np.arange(n)
        words = (int(places[-1]) >> 6) + 2 if n else 1
        flat = np.zeros(words * 64, np.uint8)
        flat[places] = 1
        self.unary = np.packbits(flat, bitorder="little").view("<u8")
        self._directory()
        self.low = self._pack(values & np.uint64((1 << low) - 1), low)

    def _directory(self) -> None:
        """How many ones and zeros stand before each word of the unary part."""
        ones = np.bitwise_count(self.unary).astype(np.int64)
        self.ones_before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64 if self.n > 2**31 else np.int32)
        self.zeros_before = (np.arange(len(self.unary) + 1) * 64 - self.ones_before).astype(self.ones_before.dtype)

    @staticmethod
    def _pack(values: np.ndarray, bits: int) -> np.ndarray:
        if not bits or not len(values):
            return np.zeros(2, np.uint64)
        out = []
        step = 1 << 16  # a multiple of 64 values fills whole words
        for i in range(0, len(values), step):
            part = values[i : i + step].astype("<u8")
            table = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel()
            table = np.concatenate([table, np.zeros(-len(table) % 64, np.uint8)])
            out.append(np.packbits(table, bitorder="little").view("<u8"))
        return np.concatenate([*out, np.zeros(1, np.uint64)])

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        bit = index.astype(np.int64) * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.low_bits) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero (from 0); beyond the last word's zeros: the end."""
        word = np.searchsorted(self.zeros_before, k, side="right") - 1
        inside = word < len(self.unary)
        out = np.full(len(k), len(self.unary) * 64, np.int64)
        w, rest = word[inside], (k[inside] - self.zeros_before[word[inside]]).astype(np.int64)
        got = np.empty(len(w), np.int64)
        for i in range(0, len(w), 1 << 14):
            s = slice(i, i + (1 << 14))
            zeros = 1 - np.unpackbits(self.unary[w[s]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            got[s] = np.argmax(np.cumsum(zeros, axis=1, dtype=np.int16) > rest[s, None], axis=1)
        out[inside] = w * 64 + got
        return out

    def successor(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each probe the index of the least element that isn't smaller (n if none), and whether it is equal."""
        if not self.n:
            return np.zeros(len(probes), np.int64), np.zeros(len(probes), bool)
        high = (probes >> np.uint64(self.low_bits)).astype(np.int64)
        low = probes & np.uint64((1 << self.low_bits) - 1)
        first = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) + 1 - high, 0)
        end = np.minimum(self._select0(high) - high, self.n)
        first = np.minimum(first, self.n)
        # binary search among the few elements that share the high bits
        lo, hi = first.copy(), end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        equal = np.zeros(len(probes), bool)
        inside = np.flatnonzero(lo < end)
        equal[inside] = self._lows(lo[inside]) == low[inside]
        return lo, equal

    def decode(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.unary.view(np.uint8), bitorder="little"))
        high = (places - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(np.arange(self.n))

    def to_bytes(self) -> bytes:
        return struct.pack("<qqq", self.n, self.low_bits, len(self.unary)) + self.unary.astype("<u8").tobytes() + self.low.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        out = cls.__new__(cls)
        out.n, out.low_bits, words = struct.unpack_from("<qqq", data)
        body = np.frombuffer(data, "<u8", offset=24)
        out.unary, out.low = body[:words], body[words:]
        out._directory()
        return out

    def bits_per_key(self) -> float:
        return 8 * (self.unary.nbytes + self.low.nbytes + self.ones_before.nbytes + self.zeros_before.nbytes) / max(1, self.n)


class SeenKeys:
    """All keys so far as Elias-Fano runs, each at least twice as long as the next; a new batch is merged into them."""

    def __init__(self, bits: int) -> None:
        self.bits, self.runs = bits, []

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """``probes`` sorted."""
        found = np.zeros(len(probes), bool)
        for run in self.runs:
            rest = np.flatnonzero(~found)
            if not rest.size:
                break
            found[rest] = run.successor(probes[rest])[1]
        return found

    def merge(self, new: np.ndarray) -> None:
        """``new``: sorted, distinct and not yet contained."""
        if not len(new):
            return
        while self.runs and self.runs[-1].n < 2 * len(new):
            new = np.concatenate([self.runs.pop().decode(), new])
            new.sort(kind="stable")  # two sorted halves: one merge
        self.runs.append(EliasFano(new, self.bits))


    def take(self, other: SeenKeys) -> None:
        """The other's keys too; it has none of these."""
        for run in other.runs:
            self.merge(run.decode())


def _firsts(batch_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds the rows of one split: a row with a smaller order of the same hash in its batch is known to be seen, and rows equal in both are
    one with a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, row in _gathered(batches, batch_rows, ("h", "row")):
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            same = np.concatenate([[False], h[1:] == h[:-1]])
            twice = same & np.concatenate([[False], row[1:] == row[:-1]])
            starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            known = row > row[starts]
            keep = np.flatnonzero(~twice)
            n = np.diff(keep, append=len(h)).astype(np.int32)
            yield pa.record_batch({"h": pa.array(h[keep]), "row": pa.array(row[keep]), "known": pa.array(known[keep]), "n": pa.array(n)})

    return run


def _gathered(batches: Iterator[pa.RecordBatch], rows: int, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        n += batch.num_rows
        if n >= rows:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


class _Arrivals:
    """One hash partition in order of arrival. Rows of one order don't come before one another, however many batches they
    fill: their new keys are kept apart, as runs too, until a greater order comes."""

    def __init__(self, bits: int) -> None:
        self.bits, self.seen, self.fresh = bits, SeenKeys(bits), SeenKeys(bits)
        self.at: int | None = None

    def settle(self) -> None:
        self.seen.take(self.fresh)
        self.fresh = SeenKeys(self.bits)

    def _together(self, h: np.ndarray) -> np.ndarray:
        """Rows of one order, to which others may follow."""
        keys, back = np.unique(h.view(np.uint64), return_inverse=True)
        earlier = self.seen.contains(keys)
        new = keys[~earlier]
        self.fresh.merge(new[~self.fresh.contains(new)])
        return earlier[back]

    def _apart(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows whose orders are all in this batch."""
        order = np.lexsort((row, h.view(np.uint64)))
        keys, rows = h[order].view(np.uint64), row[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        starts = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, int)
        distinct = keys[first]
        earlier = self.seen.contains(distinct)
        out = np.zeros(len(h), bool)
        out[order] = (rows > rows[starts]) | earlier[np.cumsum(first) - 1]
        self.seen.merge(distinct[~earlier])
        return out

    def answer(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """``row`` ascending, and not under that of earlier calls."""
        if not len(row):
            return np.zeros(0, bool)
        a = int(np.searchsorted(row, self.at, "right")) if self.at is not None else 0
        b = max(a, int(np.searchsorted(row, row[-1], "left")))
        parts = [self._together(h[:a])] if a else []
        if a < len(row):
            self.settle()
            parts += [self._apart(h[a:b], row[a:b]), self._together(h[b:])]
            self.at = int(row[-1])
        return np.concatenate(parts)


def _probe(bits: int, batch_rows: int, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One hash partition: runs of earlier keys first, if there are any, then rows in order of arrival. ``keep``: its runs come last."""

    def rows_of(row: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        plain = {"row": pa.array(row), "seen": pa.array(seen)}
        return pa.record_batch(plain | {"part": pa.nulls(len(row), pa.int32()), "n": pa.nulls(len(row), pa.int64()), "run": pa.nulls(len(row), pa.binary())} if keep else plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = _Arrivals(bits), None

        def plain() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for batch in batches:
                if batch.num_rows and keep:
                    part = batch.column("part")[0].as_py()
                    runs = batch.filter(batch.column("run").is_valid())
                    for data in runs.column("run"):  # disjoint: they are kept whole, or joined where alike in length
                        state.seen.merge(EliasFano.from_bytes(data.as_py()).decode())
                    batch = batch.filter(batch.column("run").is_null())
                yield batch

        for h, row, known, n in _gathered(plain(), batch_rows, ("h", "row", "known", "n")):
            out, open_ = known.copy(), np.flatnonzero(~known)
            out[open_] = state.answer(h[open_], row[open_])
            ends = np.cumsum(n, dtype=np.int64)
            for i in range(0, int(ends[-1]), batch_rows):  # rows that were folded come back, a batch at a time
                at = np.searchsorted(ends, np.arange(i, min(i + batch_rows, int(ends[-1]))), side="right")
                yield rows_of(row[at], out[at])
        state.settle()
        for kept in state.seen.runs if keep else ():
            yield pa.record_batch({"row": pa.nulls(1, pa.int64()), "seen": pa.nulls(1, pa.bool_()), "part": pa.array([part], pa.int32()), "n": pa.array([kept.n], pa.int64()), "run": pa.array([kept.to_bytes()], pa.binary())})

    return run


def _placed(df: DataFrame, keys: list[str], order: str, fingerprint_bits: int, prefix: int, batch_rows: int) -> DataFrame:
    """``part``, ``h``, ``row``, ``known`` and ``n`` of the rows with a key."""
    parts, bits = 1 << prefix, fingerprint_bits - prefix
    if bits < 8:
        raise ValueError("fingerprint_bits are too few for so many partitions")
    known = df.where(F.col(order).isNotNull()).dropna(subset=keys)
    hashed = known.select(F.shiftrightunsigned(F.xxhash64(*keys), 64 - fingerprint_bits).alias("h") if fingerprint_bits < 64 else F.xxhash64(*keys).alias("h"), F.col(order).cast("bigint").alias("row"))
    folded = hashed.mapInArrow(_firsts(batch_rows), "h bigint, row bigint, known boolean, n int")
    home = F.shiftrightunsigned("h", bits).cast("int") if prefix else F.lit(0)
    spread = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    local = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) if prefix else F.col("h")
    return folded.select(F.when(F.col("known"), spread).otherwise(home).alias("part"), local.alias("h"), "row", "known", "n")


def _prefix(spark: SparkSession, keys: int, partition_keys: int) -> int:
    return max(0, (max(1, width(spark), -(-keys // partition_keys)) - 1).bit_length())


def seen_before(df: DataFrame, keys: list[str], order: str, *, fingerprint_bits: int = 64, partition_keys: int = PARTITION_KEYS, batch_rows: int = BATCH_ROWS, rows: int | None = None) -> DataFrame:
    """For each row with a key, repeated ones too: ``row_id`` (its ``order`` value) and whether its key came at a smaller ``order`` value.

    Rows with a null in ``keys`` or in ``order`` have no key or no place and give no row. Rows equal in order don't count as earlier than
    one another. Keys of any length are hashed whole. An empty table gives an empty result. Columns not named aren't read, so clashing
    names don't matter. ``rows`` is a known row count, else it is counted.

    A key is told apart by ``fingerprint_bits`` bits of its hash. A key that is new is called seen with a
    chance of (keys kept)/2**fingerprint_bits (``expected_wrong_rate``); a seen key is never called new.

    The hash range is cut into equal partitions, so a partition stores only the bits below its prefix. A key
    that holds a third of the rows is folded in the splits before the shuffle: of each split's batch
    only its first row is probed, and the others, known to be seen, are spread by their order. What a task holds is a batch and the runs.
    """
    prefix = _prefix(df.sparkSession, df.count() if rows is None else rows, partition_keys)
    placed = _placed(df, keys, order, fingerprint_bits, prefix, batch_rows)
    ordered = placed.repartitionById(1 << prefix, "part").sortWithinPartitions("row").select("h", "row", "known", "n")
    return ordered.mapInArrow(_probe(fingerprint_bits - prefix, batch_rows, False), "row bigint, seen boolean").select(F.col("row").alias("row_id"), "seen")


def _split(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Halves partitions: the highest of a key's ``bits`` bits goes over to the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("run"), strict=True):
                values = EliasFano.from_bytes(data.as_py()).decode()
                cut_at = int(np.searchsorted(values, np.uint64(1 << (bits - 1))))
                for half, some in enumerate((values[:cut_at], values[cut_at:] - np.uint64(1 << (bits - 1)))):
                    if len(some):
                        yield pa.record_batch({"part": pa.array([2 * part + half], pa.int32()), "n": pa.array([len(some)], pa.int64()), "run": pa.array([EliasFano(some, bits - 1).to_bytes()], pa.binary())})

    return run


@dataclass(frozen=True)
class Index:
    """All keys so far as stored Elias-Fano runs: ``part``, ``n`` (keys) and ``run``, in 2**``prefix`` hash partitions."""

    runs: DataFrame
    prefix: int
    fingerprint_bits: int

    def widened(self, prefix: int) -> Index:
        out = self
        while out.prefix < prefix:
            runs = out.runs.mapInArrow(_split(out.fingerprint_bits - out.prefix), "part int, n bigint, run binary")
            out = Index(runs, out.prefix + 1, out.fingerprint_bits)
        return out


def seen_with(df: DataFrame, keys: list[str], order: str, index: Index | None = None, *, fingerprint_bits: int = 64, partition_keys: int = PARTITION_KEYS, batch_rows: int = BATCH_ROWS) -> tuple[DataFrame, Index]:
    """A batch against a stored index: the answers of ``seen_before``, for which all of the index's keys came earlier, and the index with the
    batch's keys merged in. The rows of earlier batches aren't read again; each partition loads and stores its own runs.

    Without an index this starts one. Partitions are halved before they would hold more than ``partition_keys`` keys. An empty batch gives no answers and
    the same keys.
    """
    spark = df.sparkSession
    bits = index.fingerprint_bits if index else fingerprint_bits
    held = (index.runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if index else 0) + df.count()
    prefix = max(_prefix(spark, held, partition_keys), index.prefix if index else 0)
    rows = _placed(df, keys, order, bits, prefix, batch_rows).withColumn("run", F.lit(None).cast("binary"))
    if index:
        none = F.lit(None)
        old = index.widened(prefix).runs.select("part", none.cast("bigint").alias("h"), none.cast("bigint").alias("row"), none.cast("boolean").alias("known"), none.cast("int").alias("n"), "run")
        rows = rows.unionByName(old)
    ordered = rows.repartitionById(1 << prefix, "part").sortWithinPartitions(F.col("run").isNull(), "row")
    both = cut(ordered.mapInArrow(_probe(bits - prefix, batch_rows, True), "row bigint, seen boolean, part int, n bigint, run binary"), "seen")
    answers = both.where("run is null").select(F.col("row").alias("row_id"), "seen")
    return answers, Index(both.where("run is not null").select("part", "n", "run"), prefix, bits)


def expected_wrong_rate(keys: int, fingerprint_bits: int = 64) -> float:
    """The chance that a new key is called seen, with so many keys kept."""
    return keys / 2.0**fingerprint_bits


def wrong_answers(answers: DataFrame, df: DataFrame, keys: list[str], order: str, fingerprint_bits: int = 64) -> DataFrame:
    """The answers held against the truth: ``n_rows``, ``n_seen``, ``n_wrong``, ``wrong_rate``, ``expected_rate``.

    The truth is each key's least order, grouped by the whole key. Needs one row per ``order`` value.
    """
    known = df.where(F.col(order).isNotNull()).dropna(subset=keys)
    firsts = known.groupBy(*keys).agg(F.min(order).alias("row_id")).select("row_id", F.lit(True).alias("first"))
    held = answers.join(firsts, "row_id", "left")
    wrong = F.sum((F.col("seen") == F.coalesce("first", F.lit(False))).cast("bigint"))
    return held.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.col("seen").cast("bigint")), F.lit(0)).alias("n_seen"),
        F.coalesce(wrong, F.lit(0)).alias("n_wrong"),
        F.count("first").alias("n_keys"),
    ).select(
        "n_rows", "n_seen", "n_wrong",
        F.when(F.col("n_rows") > 0, F.col("n_wrong") / F.col("n_rows")).alias("wrong_rate"),
        (F.col("n_keys") / F.lit(2.0**fingerprint_bits)).alias("expected_rate"),
    )
