"""Schemas that drift between files (problem 6).

Each body is flattened to its keys and their JSON types. The corpus itself tells what a field's values look like and which keys stand
beside it, and so can't be it under another name. Every distinct schema becomes a graph of keys, words, types
and nesting, which similarity flooding matches with the graph of the wanted fields and of the schema's keys that are known to be others;
the fixpoint's best consistent correspondences say which key carries which field. Bodies are then cast into one
table, and consecutive files of a series are compared.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellforge.session import cut, width

FIELDS = ("format_version", "encoding", "record_bytes", "stride")

#: Keys that are none of the fields, by the task's statement: about the writing program and total bytes.
OTHERS = ("writer_version", "bytes_total")
KINDS = ("int", "float", "string", "bool", "array", "object")
#: Share of words without which two names aren't compared at all.
LEAST = 0.45


def words(name: str) -> list[str]:
    """The words of a key's last part, however they are joined."""
    last = name.rsplit(".", 1)[-1]
    parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", last) if not last.isupper() else last
    return [w.lower() for w in re.split(r"[^0-9A-Za-z]+", parts) if w] or [last.lower()]


def _trigrams(word: str) -> set[str]:
    padded = f"  {word} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


@lru_cache(1 << 16)
def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = _trigrams(a), _trigrams(b)
    return len(x & y) / len(x | y) * 0.8


@dataclass
class Corpus:
    """What all bodies together tell: of each field the share of each JSON type under its own name."""

    kinds: dict[str, dict[str, float]] = field(default_factory=dict)


@dataclass
class Graphs:
    """A schema's graph, the targets', and which pairs of nodes can be joined at all."""

    targets: list[str]
    key_word: np.ndarray
    target_word: np.ndarray
    word: np.ndarray  # initial scores of pairs of words
    key_kind: np.ndarray
    target_kind: np.ndarray
    key_parent: np.ndarray  # the last place is the root
    target_parent: np.ndarray
    able: np.ndarray


def _incidence(lists: list[list[str]], names: list[str]) -> np.ndarray:
    place = {w: i for i, w in enumerate(names)}
    out = np.zeros((len(lists), len(names)))
    for i, some in enumerate(lists):
        out[i, [place[w] for w in some]] = 1
    return out


def _parents(names: list[str]) -> np.ndarray:
    place = {k: i for i, k in enumerate(names)}
    out = np.zeros((len(names), len(names) + 1))
    for i, k in enumerate(names):
        out[i, place.get(k.rsplit(".", 1)[0], len(names)) if "." in k else len(names)] = 1
    return out


def graphs(keys: list[tuple[str, str]], beside: list[set[str]] | None = None, corpus: Corpus | None = None) -> Graphs:
    """``keys``: (path, JSON type); ``beside``: per key the fields that it stands beside, under their own names, in some body."""
    beside = beside or [set() for _ in keys]
    known = [k for (k, _), b in zip(keys, beside, strict=True) if b >= set(FIELDS) and k not in FIELDS and k not in OTHERS]
    targets = [*FIELDS, *OTHERS, *known]
    key_words, target_words = [words(k) for k, _ in keys], [words(t) for t in targets]
    vocab, wanted = sorted({w for ws in key_words for w in ws}), sorted({w for ws in target_words for w in ws})
    word = np.array([[_alike(a, b) for b in wanted] for a in vocab])
    key_word, target_word = _incidence(key_words, vocab), _incidence(target_words, wanted)
    kinds = dict(keys)
    shares = [(corpus.kinds.get(t, {}) if corpus and t in FIELDS else {kinds[t]: 1.0} if t in kinds else {}) or dict.fromkeys(KINDS, 1 / len(KINDS)) for t in targets]
    able = np.zeros((len(keys), len(targets)), bool)
    for i, (k, _) in enumerate(keys):
        for j, t in enumerate(targets):
            if t in FIELDS:
                able[i, j] = k == t or (t not in beside[i] and _named(word, key_word[i], target_word[j]) >= LEAST)
            else:  # one of the others is known by all of its words
                able[i, j] = k == t or (t in OTHERS and set(key_words[i]) == set(target_words[j]))
    return Graphs(
        targets, key_word, target_word, word, _incidence([[kind] for _, kind in keys], list(KINDS)), np.array([[s.get(x, 0.0) for x in KINDS] for s in shares]), _parents([k for k, _ in keys]), _parents(targets), able
    )


def _named(word: np.ndarray, key: np.ndarray, target: np.ndarray) -> float:
    return float(key @ word @ target / max(key.sum(), target.sum()))


def flood(g: Graphs, rounds: int = 100, eps: float = 1e-3) -> np.ndarray:
    """Fixpoint similarities of keys with targets.

    Nodes are the pairs (key, target), (word, word), (type, type) and (parent, parent), the latter pairs of keys themselves or of
    the roots. Only words and types begin with a score, by their spelling. In each round every pair passes its
    score on along the edges of the two graphs, divided by how many pairs of a kind it feeds; what comes in is added to what it began with, and
    each kind is scaled to a greatest of 1, until nothing moves.
    """
    n, m = g.able.shape
    score, word, kind = np.zeros((n, m)), g.word.copy(), np.eye(len(KINDS))
    kind[0, 1] = kind[1, 0] = 0.5  # both are numbers
    first = kind.copy()
    longest = np.maximum(g.key_word.sum(1)[:, None], g.target_word.sum(1)[None, :])
    both = np.zeros((n + 1, m + 1))
    both[n, m] = 1
    top = lambda x: x / max(x.max(initial=0), 1e-9)
    fed_words = np.maximum(1, g.key_word.sum(0)[:, None] * g.target_word.sum(0)[None, :])
    fed_kinds = np.maximum(1, g.key_kind.sum(0)[:, None] * np.maximum(1, (g.target_kind > 0).sum(0))[None, :])
    by_word, by_kind = g.word / fed_words, first / fed_kinds
    for _ in range(rounds):
        both[:n, :m] = score
        came = g.key_word @ word @ g.target_word.T / longest + 0.3 * g.key_kind @ kind @ g.target_kind.T + 0.2 * g.key_parent @ both @ g.target_parent.T
        new = top(came * g.able)
        new_word = top(g.word + by_word * (g.key_word.T @ score @ g.target_word))
        new_kind = top(first + by_kind * (g.key_kind.T @ score @ g.target_kind))
        moved = max(np.abs(new - score).max(initial=0), np.abs(new_word - word).max(initial=0))
        score, word, kind = new, new_word, new_kind
        if moved < eps:
            break
    return score


def matched(keys: list[tuple[str, str]], beside: list[set[str]] | None = None, corpus: Corpus | None = None) -> dict[str, str]:
    """Field -> key: the pairs of the highest scores first, each key and each target once."""
    if not keys:
        return {}
    g = graphs(keys, beside, corpus)
    score = flood(g)
    found, used = {}, set()
    for i, j in np.dstack(np.unravel_index(np.argsort(-score, axis=None, kind="stable"), score.shape))[0]:
        name, target = keys[i][0], g.targets[j]
        if score[i, j] <= 0:
            break
        if name not in used and target not in found:
            found[target] = name
            used.add(name)
    return {t: k for t, k in found.items() if t in FIELDS}


_KINDS = {bool: "bool", int: "int", float: "float", str: "string", list: "array", dict: "object"}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def flatten(body: str | None) -> tuple[bool, list[tuple[str, str, str]]]:
    """Whether a body is one complete JSON text, and its keys that aren't null: (dotted path, JSON type, value)."""
    if body is None:
        return False, []
    try:
        top = json.loads(body.strip("﻿ \t\r\n"), parse_constant=_no_constant, parse_int=_Whole)
    except (ValueError, RecursionError):
        return False, []
    out: list[tuple[str, str, str]] = []
    stack = [("", top)] if isinstance(top, dict) else []
    while stack:
        prefix, node = stack.pop()
        for key, value in node.items():
            if value is None:
                continue
            kind = "int" if isinstance(value, _Whole) else _KINDS[type(value)]
            if kind == "object":
                stack.append((f"{prefix}{key}.", value))
            out.append((prefix + key, kind, json.dumps(value) if kind in ("array", "object") else value if kind == "string" else str(value)))
    return True, sorted(out)


class _Whole(str):
    """A whole number as written; of any length."""


_PARSED = "ok boolean, keys array<struct<name: string, kind: string, value: string>>, signature string"


def _parse(bodies: pd.Series) -> pd.DataFrame:
    rows = [flatten(b) for b in bodies]
    return pd.DataFrame(
        {
            "ok": [ok for ok, _ in rows],
            "keys": [[dict(zip(("name", "kind", "value"), k, strict=True)) for k in keys] for _, keys in rows],
            "signature": [json.dumps([k[:2] for k in keys]) for _, keys in rows],
        }
    )


def _match_all(corpus: Corpus) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for signature, seen in zip(batch["__signature"], batch["seen"], strict=True):
                beside = {x["name"]: {f for f in FIELDS if x[f]} for x in seen}
                keys = [tuple(k) for k in json.loads(signature)]
                found.append(matched(keys, [beside.get(k, set()) for k, _ in keys], corpus))
            yield pd.DataFrame({"__signature": batch["__signature"]} | {f"{f}_key": [x.get(f) for x in found] for f in FIELDS})

    return run


def _found_keys(rows: DataFrame) -> DataFrame:
    """``__signature`` and per field the key that carries it, each distinct schema matched once.

    First all bodies are asked which keys stand beside a field that has its own name, and how that field's values are typed: since at
    most one key of a body carries a field, a key beside it is another. The names stay in Spark; only the types' counts,
    fields x types, come to the driver.
    """
    names = F.transform("__keys", lambda k: k["name"])
    has = [F.array_contains(names, f).alias(f) for f in FIELDS]
    each = rows.select(*has, F.explode("__keys").alias("k"))
    counted = each.where(F.col("k.name").isin(*FIELDS)).groupBy("k.name", "k.kind").count().collect()
    corpus = Corpus({f: {r["kind"]: r["count"] / sum(x["count"] for x in counted if x["name"] == f) for r in counted if r["name"] == f} for f in FIELDS})
    beside = each.groupBy(F.col("k.name").alias("name")).agg(*(F.max(f).alias(f) for f in FIELDS))
    schemas = rows.groupBy("__signature").agg(F.first("__keys").alias("__keys")).select("__signature", F.explode_outer(F.transform("__keys", lambda k: k["name"])).alias("name"))
    seen = schemas.join(beside, "name", "left").groupBy("__signature").agg(F.collect_list(F.struct("name", *FIELDS)).alias("seen"))  # one schema's keys
    # few bytes but much work a row: by number, so that the small partitions aren't coalesced into one task
    spread = seen.repartition(width(rows.sparkSession))
    return spread.mapInPandas(_match_all(corpus), "__signature string, " + ", ".join(f"{f}_key string" for f in FIELDS))


def _with_name(column: str) -> Callable[[Column], Column]:
    return lambda key: key["name"] == F.col(column)


def unified(files: DataFrame, body: str = "body") -> DataFrame:
    """All readable bodies in one table, fields found by schema matching and cast to one type each.

    Keeps the other columns of ``files`` and adds, per field, the value (``format_version`` int, ``encoding`` string,
    ``record_bytes`` int, ``stride`` int), ``<field>_key`` (the key that carried it) and ``<field>_kind`` (its JSON type). A null or unreadable body gives no
    row; an empty object gives a row of nulls; a key with null is absent; a value that can't be cast is null while its key
    and kind stay. Of a key written twice in one object the last counts. Existing columns with
    these names are replaced. An empty table gives an empty one.

    Matching runs once per distinct schema, not per file.
    """
    added = [f"{f}{end}" for f in FIELDS for end in ("", "_key", "_kind")]
    kept = [c for c in files.columns if c != body and c not in added]
    parsed = F.pandas_udf(_parse, _PARSED).asNondeterministic()  # else the filter below would run it again
    rows = cut(files.select(*kept, parsed(F.col(body)).alias("__p")).where("__p.ok").select(*kept, F.col("__p.keys").alias("__keys"), F.col("__p.signature").alias("__signature")), "bodies")
    joined = rows.join(_found_keys(rows), "__signature", "left")
    cols = []
    for f in FIELDS:
        hit = F.get(F.filter("__keys", _with_name(f"{f}_key")), F.lit(0))
        value = hit["value"]
        if f == "encoding":
            inner = F.coalesce(F.get_json_object(value, "$.name"), F.get_json_object(value, "$[0]"))
            cast = F.when(hit["kind"].isin("object", "array"), inner).otherwise(value)
        else:
            cast = F.trim(value).try_cast("double").try_cast("int")
        cols += [cast.alias(f), F.col(f"{f}_key"), hit["kind"].alias(f"{f}_kind")]
    return joined.select(*kept, *cols)


def changes(table: DataFrame, series: str, order: list[str]) -> DataFrame:
    """Every change of a field between consecutive rows of a series, one row per field and kind of change.

    Returns ``series``, the ``order`` columns, ``field_name``, ``change_kind`` and the key and type before and
    after. ``added``/``removed``: present on one side only; ``renamed``/``retyped``: present on both
    under another key or type; both can hold. Rows equal in ``order`` follow each other in an undefined order. A null series is a series of its own.

    The rows are range-partitioned by (series, order), so a series with a third of all rows is spread
    over many tasks; each part's last row is handed on to the next part of its series.
    """
    fields = [F.struct(F.col(f"{f}_key").alias("key"), F.col(f"{f}_kind").alias("kind")).alias(f) for f in FIELDS]
    n = width(table.sparkSession)
    slim = table.select(F.col(series).alias("series__"), *order, F.struct(*fields).alias("now"))
    ranged = cut(slim.repartitionByRange(n, "series__", *order).withColumn("part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("series__", "part").orderBy(*order)
    rows = ranged.withColumn("before", F.lag("now").over(inside)).withColumn("first__", F.row_number().over(inside) == 1)
    # per series at most one row for each part
    tails = ranged.groupBy("series__", "part").agg(F.max_by("now", F.struct(*order)).alias("tail"))
    handed = tails.withColumn("tail", F.lag("tail").over(Window.partitionBy("series__").orderBy("part")))
    ahead = handed.where("tail is not null").select(F.col("series__").alias("s2"), F.col("part").alias("p2"), "tail")
    joined = rows.join(ahead, F.col("series__").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")) & F.col("first__"), "left")
    pairs = joined.withColumn("before", F.coalesce("before", "tail")).where("before is not null")
    found = []
    for f in FIELDS:
        was, now = F.col(f"before.{f}"), F.col(f"now.{f}")
        both = was["key"].isNotNull() & now["key"].isNotNull()
        for kind, cond in (
            ("added", was["key"].isNull() & now["key"].isNotNull()),
            ("removed", was["key"].isNotNull() & now["key"].isNull()),
            ("renamed", both & (was["key"] != now["key"])),
            ("retyped", both & (was["kind"] != now["kind"])),
        ):
            found.append(F.when(cond, F.struct(F.lit(f).alias("field_name"), F.lit(kind).alias("change_kind"), was["key"].alias("key_before"), now["key"].alias("key_after"), was["kind"].alias("kind_before"), now["kind"].alias("kind_after"))))
    out = pairs.select(F.col("series__").alias(series), *order, F.explode(F.filter(F.array(*found), lambda c: c.isNotNull())).alias("c"))
    return out.select(series, *order, "c.*")


