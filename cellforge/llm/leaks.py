"""Evaluation texts leaking into training text (problem 7).

The test items form a BM25 index: posting lists in segments of items, with the greatest weight of each word in a block
of items. Every passage of every document queries it, the maxima skip the blocks that can't reach an item's threshold,
and what is retrieved is verified word by word.
"""

from __future__ import annotations

import html
import math
import pickle
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from cellforge.session import cut

#: Words of a passage, and of the shortest run that counts as a leak.
RUN = 12
#: Items of one index segment on average, and of one block with common maxima.
SEGMENT, BLOCK = 512, 16
#: An index of up to so many bytes is broadcast; tasks read a larger one from its table, a segment at a time.
BROADCAST_BYTES = 64 << 20
#: Code points of documents that are held at once against every segment, if they are more than one document.
HELD_CHARS = 8_000_000
_K1, _B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")
_FORMAT = regex.compile(r"\p{Cf}+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, after decoding character references once, NFKC, dropping format characters and lower-casing."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


def hashes(words: list[str]) -> np.ndarray:
    """Each word as 64 bits, equal words hashed once."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    distinct = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return distinct[coded.indices.to_numpy()] if len(words) else distinct


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start, start + 1, ... of all ranges after one another, and which range each is of."""
    which = np.repeat(np.arange(len(starts)), lengths)
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths) + starts[which], which


@dataclass
class Index:
    """One segment of items. Word 0 stands for every word that no item of it has.

    An item's weights are its BM25 weights over its threshold: the least score that a passage of ``run`` consecutive
    words of the item reaches. So a passage that shares such a run scores 1 or more, whatever the item.

    A word's postings are its items and their weights, by item; its blocks are the runs of postings within ``BLOCK`` items, with
    the greatest weight of each.
    """

    words: np.ndarray  # hashes, sorted; word j + 1 is the j-th
    ids: np.ndarray  # of the items
    lengths: np.ndarray
    item: np.ndarray  # of each posting
    weight: np.ndarray
    block: np.ndarray  # of each run of postings
    block_max: np.ndarray
    block_start: np.ndarray  # its first posting, and one past the last
    word_start: np.ndarray  # each word's first block, and one past the last
    most: np.ndarray  # each word's greatest weight
    passages: np.ndarray  # the items' passages as words, sorted by key
    passage_key: np.ndarray
    passage_at: np.ndarray  # in its item
    run: int

    def codes(self, hashed: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, hashed), max(0, len(self.words) - 1))
        return np.where(self.words[at] == hashed, at + 1, 0) if len(self.words) else np.zeros(len(hashed), np.int64)


def _keys(passages: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A number for each (passage, item); equal ones have equal numbers."""
    out = item.astype(np.uint64) + np.uint64(1)
    for column in passages.T:
        out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def build(items: list[tuple[int, list[str]]], run: int, df: dict[str, int], n: int, mean: float) -> Index:
    """``items``: id and words, at least ``run`` of them; ``df``: in how many of all ``n`` items each word is; ``mean``: their mean length."""
    vocab = sorted({w for _, ws in items for w in ws})
    hashed = hashes(vocab)
    order = np.argsort(hashed)
    code = {vocab[j]: i + 1 for i, j in enumerate(order)}
    rows = []
    for i, ws in items:
        norm = _K1 * (1 - _B + _B * len(ws) / mean)
        held = np.array([code[w] for w in ws])
        own, count = np.unique(held, return_counts=True)
        idf = {code[w]: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in set(ws)}
        score = np.array([idf[c] for c in own]) * count * (_K1 + 1) / (count + norm)
        passages = np.lib.stride_tricks.sliding_window_view(held, run)
        inside = np.sort(passages, axis=1)
        first = np.concatenate([np.ones((len(inside), 1), bool), inside[:, 1:] != inside[:, :-1]], axis=1)
        least = float((score[np.searchsorted(own, inside)] * first).sum(axis=1).min())
        rows.append((least, i, own, score / least, passages))
    rows.sort(key=lambda r: (r[0], r[1]))  # items of like thresholds share a block, which keeps its maxima low
    many = [len(r[2]) for r in rows]
    item, word, weight = np.repeat(np.arange(len(rows)), many), np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
    by = np.lexsort((item, word))
    item, word, weight = item[by].astype(np.int32), word[by], weight[by].astype(np.float32)
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)]))
    starts = np.searchsorted(word[new], np.arange(len(vocab) + 2))
    most = np.zeros(len(vocab) + 1, np.float32)
    np.maximum.at(most, word, weight)
    passages = np.concatenate([r[4] for r in rows]).astype(np.int32)
    at = np.concatenate([np.arange(len(r[4])) for r in rows])
    keys = _keys(passages, np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows]))
    sorted_ = np.argsort(keys, kind="stable")
    return Index(
        hashed[order], np.array([r[1] for r in rows], np.int64), np.array([len(r[4]) + run - 1 for r in rows]), item, weight,
        item[new] // BLOCK, np.maximum.reduceat(weight, new), np.append(new, len(item)), starts, most, passages[sorted_], keys[sorted_], at[sorted_].astype(np.int32), run,
    )


def retrieve(index: Index, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places and items, as arrays, where the passage of ``run`` words from the place scores at least 1.

    ``codes``: the words of all documents after one another; ``ends``: where each document ends. Block-max WAND over many
    passages at once: the sum of the words' greatest weights first, then that of their block maxima, and only the postings of blocks
    that can reach the threshold are summed.
    """
    run, enough = index.run, 1 - 1e-3
    if len(codes) < run or not len(index.ids):
        return
    total = np.concatenate([[0.0], np.cumsum(index.most[codes], dtype=np.float64)])
    starts = np.flatnonzero(total[run:] - total[:-run] >= enough)
    starts = starts[np.searchsorted(ends, starts, side="right") == np.searchsorted(ends, starts + run - 1, side="right")]
    blocks = -(-len(index.ids) // BLOCK)
    for i in range(0, len(starts), 4096):
        at = starts[i : i + 4096]
        terms = np.sort(codes[at[:, None] + np.arange(run)], axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = 0  # a passage's words count once
        flat = terms.ravel()
        entry, term = _ranges(index.word_start[flat], index.word_start[flat + 1] - index.word_start[flat])
        pair = term // run * blocks + index.block[entry]
        bound = np.bincount(pair, index.block_max[entry], minlength=len(at) * blocks)
        hit = np.flatnonzero(bound >= enough)
        if not len(hit):
            continue
        number = np.full(len(bound), -1)
        number[hit] = np.arange(len(hit))
        entry, which = entry[keep := number[pair] >= 0], number[pair[keep]]
        posting, of = _ranges(index.block_start[entry], index.block_start[entry + 1] - index.block_start[entry])
        scores = np.bincount(which[of] * BLOCK + index.item[posting] % BLOCK, index.weight[posting], minlength=len(hit) * BLOCK)
        found = np.flatnonzero(scores >= enough)
        yield at[hit[found // BLOCK] // blocks], hit[found // BLOCK] % blocks * BLOCK + found % BLOCK


def verified(index: Index, codes: np.ndarray, starts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the retrieved the places, items and places in the item where the passage is one of the item's, word by word."""
    asked = codes[starts[:, None] + np.arange(index.run)]
    keys = _keys(asked, items)
    low, high = np.searchsorted(index.passage_key, keys, "left"), np.searchsorted(index.passage_key, keys, "right")
    at, which = _ranges(low, high - low)
    same = (index.passages[at] == asked[which]).all(axis=1)
    return starts[which[same]], items[which[same]], index.passage_at[at[same]]


def matches(index: Index, hashed: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(document's number, item id, longest run, share of the item) of all that share a run."""
    run, codes = index.run, index.codes(hashed)
    hits = [verified(index, codes, *some) for some in retrieve(index, codes, ends)]
    if not hits:
        return
    start, item, place = (np.concatenate(x) for x in zip(*hits, strict=True))
    doc = np.searchsorted(ends, start, side="right")
    order = np.lexsort((place, start - place, item, doc))
    doc, item, place, diagonal = doc[order], item[order], place[order], (start - place)[order]
    groups = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else np.zeros(0, int)
    for a, b in zip(groups, [*groups[1:], len(doc)], strict=True):
        follows = np.concatenate([[False], (diagonal[a + 1 : b] == diagonal[a : b - 1]) & (place[a + 1 : b] == place[a : b - 1] + 1)])
        breaks = np.append(np.flatnonzero(~follows), b - a)
        covered = np.zeros(index.lengths[item[a]] + 1, np.int64)
        np.add.at(covered, place[a:b], 1)
        np.add.at(covered, place[a:b] + run, -1)
        yield int(doc[a]), int(index.ids[item[a]]), int(np.diff(breaks).max()) + run - 1, float((np.cumsum(covered)[:-1] > 0).mean())


def _tokens(run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, ws) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(ws := words_of(t)) >= run]
            yield pa.record_batch([pa.array([i for i, _ in made], pa.int64()), pa.array([ws for _, ws in made], pa.list_(pa.string()))], ["item_id", "words"])

    return work


def _segment(run: int, n: int, mean: float) -> Callable[[pa.Table], pa.Table]:
    def work(rows: pa.Table) -> pa.Table:
        df: dict[str, int] = {}
        for some in rows.column("df").to_pylist():
            df.update((x["word"], x["df"]) for x in some)
        items = sorted(zip(rows.column("item_id").to_pylist(), rows.column("words").to_pylist(), strict=True))
        data = pickle.dumps(build(items, run, df, n, mean))
        return pa.table({"size": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    return work


def indexed(items: DataFrame, run: int = RUN, segment: int = SEGMENT) -> DataFrame:
    """``size`` and ``data``: the index, a segment a row, built in the tasks. ``items``: item_id and text. How many items have a word, their
    number and mean length are those of all items, whatever the segment."""
    tokens = cut(items.mapInArrow(_tokens(run), "item_id bigint, words array<string>"), "tokens")
    n, mean = tokens.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
    each = tokens.select("item_id", "words", F.explode(F.array_distinct("words")).alias("word"))
    df = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # a row for each item: its words are as many as its text has
    held = each.select(F.struct("item_id", "words").alias("i"), "word").join(df, "word").groupBy("i").agg(F.collect_list(F.struct("word", "df")).alias("df"))
    segments = max(1, -(-n // segment))
    placed = held.select("i.item_id", "i.words", "df", F.pmod(F.xxhash64("i.item_id"), F.lit(segments)).alias("seg"))
    return cut(placed.groupBy("seg").applyInArrow(_segment(run, n, mean), "size bigint, data binary"), "index")


def _stored(files: list[str]) -> Iterator[Index]:
    """The segments of an index's table, read one at a time."""
    for uri in files:
        system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1, columns=["data"]):
                yield from (pickle.loads(x.as_py()) for x in batch.column(0))  # noqa: S301 - of our own table


def _search(segments: Callable[[], Iterator[Index]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(ids: list[int | None], docs: list[list[str]]) -> pa.RecordBatch:
        hashed, ends = hashes([w for ws in docs for w in ws]), np.cumsum([len(ws) for ws in docs])
        found = [(ids[doc], *rest) for index in segments() for doc, *rest in matches(index, hashed, ends)]
        cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], ["doc_id", "item_id", "longest_run", "covered"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                docs.append(words_of(text))
                held += len(text)
                if held >= HELD_CHARS:
                    yield search(ids, docs)
                    ids, docs, held = [], [], 0
        if docs:
            yield search(ids, docs)

    return work


def leaks(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text", run: int = RUN, segment: int = SEGMENT) -> DataFrame:
    """Each (document, item) that share ``run`` consecutive words: ``doc_id``, ``item_id``, ``longest_run`` (in words)
    and ``covered`` (the share of the item's words that stand in shared runs).

    Documents are read once, whole, and never shuffled. The index is built and stored in segments; up to ``BROADCAST_BYTES`` it is broadcast, and a larger
    one is read by the tasks from its table, a segment at a time, so that neither the driver nor a task holds more, however many
    items there are.

    Null or empty texts, and items of fewer than ``run`` words, share nothing. Repeated document rows give repeated results; items with
    equal texts are each reported. Empty tables give an empty result. Other columns aren't read.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null").distinct()
    index = indexed(rows, run, segment)
    slim = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    if index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast([r["data"] for r in index.select("data").collect()])
        held: list[Index] = []

        def segments() -> Iterator[Index]:
            if not held:
                held.extend(pickle.loads(x) for x in shared.value)  # noqa: S301 - of our own table
            return iter(held)

    else:
        files = index.inputFiles()

        def segments() -> Iterator[Index]:
            return _stored(files)

    return slim.mapInArrow(_search(segments), "doc_id bigint, item_id bigint, longest_run int, covered double")


def leaked_items(found: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """Every item with ``n_documents`` that contain a passage of it, the ``longest_run`` and the greatest ``covered`` share; zeros where it didn't leak."""
    per = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("longest_run").alias("longest_run"), F.max("covered").alias("covered"))
    every = items.select(F.col(item).cast("bigint").alias("item_id"), "suite").distinct()
    return every.join(per, "item_id", "left").na.fill({"n_documents": 0, "longest_run": 0, "covered": 0.0})
