"""Mixing sources to target weights (problem 8).

Documents are sized in tokens of a public tokenizer. A classifier fitted on labelled documents gives those
without a source a soft membership in the sources; projected-gradient least squares then fits every document's rate, from
nought to its most uses, so that the sources' expected tokens meet the targets.
"""

from __future__ import annotations

import base64
import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from cellforge.llm.fitting import bounded
from cellforge.session import cut, width

#: A byte-level BPE's vocabulary as ranks; a parameter of everything that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts text into pieces. A fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labelled documents that the classifier is fitted on at most, whole and of any length.
FIT_DOCUMENTS = 2000
_FEATURES = 4096


def source_name(col: Column) -> Column:
    """A source without case, outer blanks and the difference of - and _; null stays null."""
    return F.replace(F.lower(F.trim(F.regexp_replace(col, r"^\s+|\s+$", ""))), F.lit("-"), F.lit("_"))


@lru_cache(1)
def encoder(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@dataclass
class Classifier:
    """Softmax regression on token counts and the site, with the sources it knows."""

    sources: list[str]
    weight: np.ndarray
    bias: np.ndarray

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.sources):
            return np.zeros((len(rows), 0))
        logit = rows @ self.weight + self.bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def vector(ids: list[int], site: str | None) -> np.ndarray:
    """A document as a row of length about 1: the roots of its hashed token counts, and its site."""
    row = np.sqrt(np.bincount(np.asarray(ids, np.int64) % (_FEATURES - 512), minlength=_FEATURES).astype(np.float32))
    row /= max(1.0, float(np.linalg.norm(row)))
    if site is not None:
        row[_FEATURES - 512 + zlib.crc32(site.encode()) % 512] = 1.0
    return row


def fit(rows: np.ndarray, labels: list[str], rounds: int = 80, rate: float = 4.0, decay: float = 1e-3) -> Classifier:
    sources = sorted(set(labels))
    place = {s: i for i, s in enumerate(sources)}
    want = np.eye(len(sources), dtype=np.float32)[[place[s] for s in labels]] if labels else np.zeros((0, 0), np.float32)
    model = Classifier(sources, np.zeros((_FEATURES, len(sources)), np.float32), np.log(want.mean(axis=0) + 1e-6) if labels else np.zeros(0))
    for _ in range(rounds if len(sources) > 1 else 0):
        err = (want - model.posterior(rows)) / len(labels)
        model.weight += rate * (rows.T @ err - decay * model.weight)
        model.bias += rate * err.sum(axis=0)
    return model


def _vectors(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents as sparse rows, so that what is fitted on doesn't grow with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)  # type: ignore[attr-defined]
        for batch in batches:
            rows = [vector(enc.encode_ordinary(t), s) for t, s in zip(batch.column("text").to_pylist(), batch.column("site").to_pylist(), strict=True)]
            at = [np.flatnonzero(r) for r in rows]
            values = pa.array([r[i].astype("<f4").tobytes() for r, i in zip(rows, at, strict=True)], pa.binary())
            yield pa.record_batch([batch.column("src"), pa.array([i.astype("<i4").tobytes() for i in at], pa.binary()), values], ["src", "at", "value"])

    return run


def classifier(documents: DataFrame, ranks: object, most: int = FIT_DOCUMENTS) -> Classifier:
    """Fitted on at most ``most`` documents with a source, chosen by the hash of their id. ``ranks``: the broadcast vocabulary."""
    sample = bounded(documents.where(F.col("src").isNotNull()).select("doc_id", "text", "site", "src"), "doc_id", most)
    # few rows but much work each: spread, and not coalesced
    found = sample.repartition(width(documents.sparkSession)).mapInArrow(_vectors(ranks), "src string, at binary, value binary").collect()
    rows = np.zeros((len(found), _FEATURES), np.float32)
    for i, r in enumerate(found):
        rows[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["value"], "<f4")
    return fit(rows, [r["src"] for r in found])


def _measure(ranks: object, shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, model = encoder(ranks.value), shared.value  # type: ignore[attr-defined]
        for batch in batches:
            texts, sites = batch.column("text").to_pylist(), batch.column("site").to_pylist()
            ids = [enc.encode_ordinary(t) if t else [] for t in texts]
            member: list[object] = [None] * len(ids)
            unnamed = np.flatnonzero(batch.column("src").is_null().to_numpy(zero_copy_only=False)) if model.sources else []
            for some in np.array_split(unnamed, -(-len(unnamed) // 256)) if len(unnamed) else []:
                for i, p in zip(some, model.posterior(np.stack([vector(ids[i], sites[i]) for i in some])), strict=True):
                    member[i] = p
            tokens = pa.array([len(x) for x in ids], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("src"), tokens, pa.array(member, pa.list_(pa.float64()))], ["doc_id", "src", "tokens", "member"])

    return run


def measured(documents: DataFrame, vocabulary: str = VOCABULARY, most: int = FIT_DOCUMENTS) -> tuple[DataFrame, list[str]]:
    """``doc_id``, ``src`` (the source's plain name), ``tokens`` and, where the source is null, ``member`` (its posterior over the
    returned sources). A null or empty text has no tokens. Texts are tokenized whole."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    site = F.col("site") if "site" in documents.columns else F.lit(None).cast("string")
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", site.alias("site"), source_name(F.col("source")).alias("src"))
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(ranks)  # a vocabulary, and a model of fixed size
    model = classifier(slim.where("text is not null"), shared, most)
    sized = slim.mapInArrow(_measure(shared, context.broadcast(model)), "doc_id bigint, src string, tokens bigint, member array<double>")
    return cut(sized, "measured"), model.sources


# -- the fit


def rates(member: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Every row's rate after the given steps of projected gradient descent from nought.

    A rate depends on nothing but the row's membership and the steps so far, one number per source each, so no
    state is kept between rounds.
    """
    top = np.divide(member @ caps, member.sum(axis=1), out=np.zeros(len(member)), where=member.sum(axis=1) > 0)
    x = np.zeros(len(member))
    for g in steps:
        x = np.clip(x - member @ g, 0, top)
    return x


def _members(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _rated(fit_: Fit, mix_id: int, member: np.ndarray, soft: np.ndarray) -> np.ndarray:
    """Documents without a source take part from the second stage on."""
    steps, first = fit_.steps[mix_id], fit_.named_steps[mix_id]
    x = rates(member, fit_.caps[mix_id], steps)
    if soft.any():
        x[soft] = rates(member[soft], fit_.caps[mix_id], steps[first:])
    return x


def _sums(fit_: Fit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per mix and source the expected tokens of one split's units."""
    k = len(fit_.sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros(k) for m in fit_.caps}
        for batch in batches:
            member, soft = _members(batch.column("member"), k), batch.column("soft").to_numpy(zero_copy_only=False)
            tokens = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
            for m in total:
                total[m] += (_rated(fit_, m, member, soft) * tokens) @ member
        ids = np.repeat(np.array(list(total), np.int32), k)
        sums = np.concatenate(list(total.values())) if total else np.zeros(0)
        yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(np.tile(np.arange(k, dtype=np.int32), len(total)), pa.int32()), pa.array(sums)], ["mix_id", "j", "tokens"])

    return run


@dataclass
class Fit:
    """``steps`` per mix, of which the first ``named_steps`` are those of the documents with a source alone; ``named``: the tokens that these reach by
    themselves, ``expected``: with the others. ``moved``: how far the last round still moved any sum, as a share of all tokens."""

    sources: list[str]
    caps: dict[int, np.ndarray]
    goal: dict[int, dict[str, float]]
    total: int = 0
    steps: dict[int, list[np.ndarray]] = field(default_factory=dict)
    named_steps: dict[int, int] = field(default_factory=dict)
    named: dict[int, np.ndarray] = field(default_factory=dict)
    expected: dict[int, np.ndarray] = field(default_factory=dict)
    rounds: int = 0
    moved: float = 0.0


def _descend(fit_: Fit, units: DataFrame, rounds: int, close: float) -> bool:
    """Adds steps until no sum moves by more than ``close`` of all tokens; whether that was reached within ``rounds``."""
    k, total = len(fit_.sources), max(1, fit_.total)
    mass = (F.coalesce(F.sum(F.col("tokens") * F.get("member", F.lit(j))), F.lit(0.0)) for j in range(k))
    have = np.array(units.agg(F.array(*mass)).first()[0], float)
    now = {m: fit_.expected.get(m, np.zeros(k)) for m in fit_.caps}
    for _ in range(rounds):
        for m, g in fit_.goal.items():
            asked = np.array([s in g for s in fit_.sources])
            want = np.array([g.get(s, 0.0) for s in fit_.sources]) * fit_.total
            fit_.steps[m].append(np.divide(now[m] - want, have, out=np.zeros(k), where=(have > 0) & asked))
        new = {m: np.zeros(k) for m in fit_.caps}
        sums = units.mapInArrow(_sums(fit_), "mix_id int, j int, tokens double").groupBy("mix_id", "j").agg(F.sum("tokens").alias("tokens"))
        for r in sums.collect():  # mixes x sources numbers
            new[r["mix_id"]][r["j"]] = r["tokens"]
        fit_.moved = max(float(np.abs(new[m] - now[m]).max(initial=0)) for m in new) / total
        fit_.expected, now, fit_.rounds = new, new, fit_.rounds + 1
        if fit_.moved < close:
            return True
    return False


def fitted(sized: DataFrame, known: list[str], targets: DataFrame, rounds: int = 200, close: float = 1e-4) -> Fit:
    """Rates for every mix by projected-gradient least squares, in two stages: the documents with a source by themselves, whose residual at
    their most uses is what a source lacks; then with the documents without one, by their membership.

    The sources are those of the targets and of the classifier; ``targets`` has one row per mix and source, few by nature (no
    more than ``mixes`` x sources), and is read to the driver. Documents of a known source all have one membership, so they enter as one unit per source; the
    others are units of their own, in their partitions. Each round sums the expected tokens per source over
    all units, and steps by the residual over what the source has, until no sum moves by more than ``close`` of all tokens. A stage that
    hasn't settled after ``rounds`` is warned of, and the report says how far it still moved.
    """
    goal: dict[int, dict[str, tuple[float, float]]] = {}
    for r in targets.select("mix_id", source_name(F.col("source")).alias("s"), "target_weight", "max_uses").where("mix_id is not null and source is not null").distinct().collect():
        weight, cap = goal.setdefault(r["mix_id"], {}).get(r["s"], (0.0, 0.0))
        goal[r["mix_id"]][r["s"]] = (weight + (r["target_weight"] or 0.0), max(cap, float(r["max_uses"] or 0)))
    sources = sorted({s for g in goal.values() for s in g} | set(known))
    caps = {m: np.array([g.get(s, (0.0, 0.0))[1] for s in sources]) for m, g in goal.items()}
    fit_ = Fit(sources, caps, {m: {s: w for s, (w, _) in g.items()} for m, g in goal.items()}, int(sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]))
    fit_.steps = {m: [] for m in goal}
    fit_.named_steps = dict.fromkeys(goal, 0)
    if not goal or not sources:
        return fit_
    hot = F.array(*(F.when(F.col("src") == s, F.lit(1.0)).otherwise(F.lit(0.0)) for s in sources))
    named = cut(sized.where(F.col("src").isin(sources)).groupBy("src").agg(F.sum("tokens").alias("tokens")).select("tokens", hot.alias("member"), F.lit(False).alias("soft")), "named")
    moved = F.array(*(F.get("member", F.lit(known.index(s))) if s in known else F.lit(0.0) for s in sources))
    soft = sized.where("src is null and member is not null and tokens > 0").select("tokens", moved.alias("member"), F.lit(True).alias("soft"))
    settled = _descend(fit_, named, rounds, close)
    fit_.named, fit_.named_steps = dict(fit_.expected), {m: len(x) for m, x in fit_.steps.items()}
    settled &= _descend(fit_, cut(named.unionByName(soft), "units"), rounds, close)
    if not settled:
        warnings.warn(f"the rates still moved by {fit_.moved:.2g} of all tokens after {rounds} rounds", stacklevel=2)
    return fit_


def mix(sized: DataFrame, known: list[str], fit_: Fit, seed: int = 0) -> DataFrame:
    """``mix_id``, ``doc_id``, ``src``, ``tokens``, ``rate``, ``member`` (by the fit's sources) and ``uses``: the rate rounded down, or up with the fraction as its
    chance, by a hash of (seed, mix, document). Documents used at least once only; none over its most uses."""
    sources, k = fit_.sources, len(fit_.sources)
    zero = F.array(*[F.lit(0.0)] * k).cast("array<double>")
    hot = F.array(*(F.when(F.col("src") == s, F.lit(1.0)).otherwise(F.lit(0.0)) for s in sources)).cast("array<double>")
    moved = F.array(*(F.get("member", F.lit(known.index(s))) if s in known else F.lit(0.0) for s in sources)).cast("array<double>")
    member = F.when(F.col("src").isNotNull(), hot).when(F.col("member").isNotNull(), moved).otherwise(zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, soft = _members(batch.column("member"), k), batch.column("src").is_null().to_numpy(zero_copy_only=False)
            for m in fit_.caps:
                x = _rated(fit_, m, rows, soft)
                keep = np.flatnonzero(x > 0)
                at = pa.array(keep)
                kept = [batch.column(c).take(at) for c in ("doc_id", "src", "tokens", "member")]
                yield pa.record_batch([pa.array(np.full(len(keep), m), pa.int32()), *kept, pa.array(x[keep])], ["mix_id", "doc_id", "src", "tokens", "member", "rate"])

    placed = sized.select("doc_id", "src", "tokens", member.alias("member"))
    rated = placed.mapInArrow(run, "mix_id int, doc_id bigint, src string, tokens bigint, member array<double>, rate double") if k else placed.where("false").selectExpr("0 as mix_id", "*", "0d as rate")
    u = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a rate within rounding of a whole number is that number
    near = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))
    uses = (F.floor(near) + F.when(u < near - F.floor(near), 1).otherwise(0)).cast("int")
    return rated.withColumn("uses", uses).where("uses > 0")


def report(sized: DataFrame, known: list[str], targets: DataFrame, fit_: Fit, mixed: DataFrame | None = None) -> DataFrame:
    """Per mix and source: ``target_weight``, ``max_uses``, ``target_tokens`` (of the tokens of all documents), ``source_tokens``, ``lacking`` (the residual
    that the fit leaves to the source's own documents, at their most uses) and ``short`` (it leaves one), ``used_tokens`` of its own documents and ``reached`` (their share of all
    documents' tokens), ``expected_tokens`` and ``mix_share``: its share of the mix's own ``mix_tokens``. The last three count documents
    without a source by their membership. ``moved``: how far the fit's last round moved a sum, as a share of all tokens.

    Rows with a null mix or source are left out; a source without documents has 0 tokens. Rows of one source under several spellings are reported each.
    """
    have = sized.where("src is not null").groupBy("src").agg(F.sum("tokens").alias("source_tokens"))
    total, k = fit_.total, len(fit_.sources)
    spent = F.col("tokens") * F.col("uses")
    by = [F.array(*(F.sum(F.when(cond, spent * F.get("member", F.lit(j))).otherwise(0.0)) for j in range(k))) for cond in (F.col("src").isNotNull(), F.lit(True))]
    sums = (mix(sized, known, fit_) if mixed is None else mixed).groupBy("mix_id").agg(F.sum(spent).alias("mix_tokens"), by[0].alias("own"), by[1].alias("with_soft")) if k else None
    got = {r["mix_id"]: r for r in sums.collect()} if k else {}  # a row for each mix
    rows, zeros = [], np.zeros(k)
    for m in fit_.caps:
        for j, s in enumerate(fit_.sources):
            lacking = fit_.goal[m].get(s, 0.0) * total - float(fit_.named.get(m, zeros)[j])
            own, soft, whole = (got[m]["own"][j], got[m]["with_soft"][j], got[m]["mix_tokens"]) if m in got else (0.0, 0.0, 0)
            rows.append((int(m), s, max(0.0, lacking), lacking > 1e-9 * total, int(round(own)), float(fit_.expected.get(m, zeros)[j]), int(whole), soft / whole if whole else None))
    fitted_ = sized.sparkSession.createDataFrame(rows, "mix_id int, src string, lacking double, short boolean, used_tokens bigint, expected_tokens double, mix_tokens bigint, mix_share double")
    asked = targets.where("mix_id is not null and source is not null").select("mix_id", "source", "target_weight", "max_uses", source_name(F.col("source")).alias("src")).distinct()
    joined = asked.join(have, "src", "left").join(fitted_, ["mix_id", "src"], "left")
    return joined.select(
        "mix_id", "source", "target_weight", "max_uses",
        (F.col("target_weight") * F.lit(float(total))).alias("target_tokens"),
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        "lacking", "short", "used_tokens",
        F.when(F.lit(total > 0), F.col("used_tokens") / F.lit(float(max(1, total)))).alias("reached"),
        "expected_tokens", "mix_tokens", "mix_share", F.lit(fit_.moved).alias("moved"),
    )
