import html
import random

import numpy as np
import pytest
from collections import Counter

from cellforge.llm import leaks as k

DOCS = "doc_id bigint, text string, item_id int, longest_run string"
ITEMS = "item_id bigint, text string, suite string, doc_id int"


def words(rnd, n, vocabulary=60):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def grams(text):
    w = k.words_of(text)
    return [tuple(w[i : i + 12]) for i in range(len(w) - 11)]


def brute(docs, items):
    return sorted({(d, i) for d, t, *_ in docs for i, x, *_ in items if set(grams(t)) & set(grams(x))})


def found(spark, docs, items, **kw):
    got = k.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw).collect()
    return sorted((r["doc_id"], r["item_id"]) for r in got)


@pytest.mark.parametrize(
    "text, want",
    [("A_b c-d", ["a", "b", "c", "d"]), ("caf&eacute; &amp;amp; x", ["café", "amp", "x"]), ("ﬁne ①", ["fine", "1"]), ("so­ft​ly", ["softly"]), ("Ünder 12,5", ["ünder", "12", "5"]), ("", []), (None, [])],
)
def test_words(text, want):
    assert k.words_of(text) == want


@pytest.mark.parametrize("segment, most", [(512, 64 << 20), (7, 64 << 20), (7, 0)])
def test_against_brute_force(spark, monkeypatch, segment, most):
    """In one segment or many, broadcast or read by the tasks."""
    monkeypatch.setattr(k, "BROADCAST_BYTES", most)
    rnd = random.Random(9)
    shared = words(rnd, 14)
    items = [(i, " ".join(words(rnd, rnd.randrange(5, 60))), "s", 0) for i in range(40)]
    items += [(100, " ".join([*words(rnd, 9), *shared]), "s", 0), (101, " ".join([*shared, *words(rnd, 3)]), "s", 0), (102, " ".join(shared[:11]), "s", 0), (103, None, "s", 0), (104, "", "s", 0), (105, "z " * 30, "s", 0)]
    docs = []
    for d in range(120):
        t = words(rnd, rnd.randrange(0, 200))
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(items)[1] or ""
            w = w.split()
            n = rnd.choice([11, 12, 13, 40])
            s = rnd.randrange(max(1, len(w) - n + 1))
            at = rnd.randrange(len(t) + 1)
            t[at:at] = w[s : s + n]
        text = rnd.choice([" ", "  ", "\n", ", "]).join(t)
        docs.append((d, rnd.choice([str.upper, html.escape, str])(text), 1, ""))
    docs += [(500, None, 1, ""), (501, "", 1, ""), (502, "z " * 12, 1, ""), (503, "z " * 11, 1, ""), (504, " ".join(words(rnd, 30_000)) + " " + " ".join(shared), 1, "")]
    want = brute(docs, items)
    assert found(spark, docs, items, segment=segment) == want
    assert len(want) > 40 and (504, 100) in want and (502, 105) in want and (503, 105) not in want


def test_runs_do_not_cross_documents(spark):
    item = "a b c d e f g h i j k l"
    assert found(spark, [(1, "a b c d e f", 0, ""), (2, "g h i j k l", 0, "")], [(1, item, "", 0)]) == []


def test_length_of_runs_and_cover(spark):
    w = [f"u{i}" for i in range(40)]
    docs = [(1, " ".join([*w[:15], "x", *w[20:40]]), 0, ""), (2, " ".join(w), 0, "")]
    got = {r["doc_id"]: r for r in k.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(w), "q", 0)], ITEMS)).collect()}
    assert got[1]["longest_run"] == 20 and got[1]["covered"] == pytest.approx(35 / 40)
    assert got[2]["longest_run"] == 40 and got[2]["covered"] == 1


def index_of(items):
    tokens = [(i, k.words_of(t)) for i, t in items]
    df = Counter(w for _, ws in tokens for w in set(ws))
    return tokens, k.build(tokens, 12, df, len(tokens), float(np.mean([len(ws) for _, ws in tokens])))


def score(index, terms, item):
    out = 0.0
    for t in terms:
        a, b = index.block_start[index.word_start[t]], index.block_start[index.word_start[t + 1]]
        out += float(index.weight[a:b][index.item[a:b] == item].sum())
    return out


def test_retrieval_loses_no_passage():
    """Every passage of every item reaches its item, all that scores enough is retrieved, and nothing else is."""
    rnd = random.Random(1)
    tokens, index = index_of([(i, " ".join(words(rnd, rnd.randrange(12, 50), 40))) for i in range(50)])
    place = {int(i): j for j, i in enumerate(index.ids)}
    for i, ws in tokens:
        codes = index.codes(k.hashes(ws))
        assert codes.min() > 0
        got = {(int(s), int(j)) for some in k.retrieve(index, codes, np.array([len(codes)])) for s, j in zip(*some)}
        assert {(s, place[i]) for s in range(len(ws) - 11)} <= got
        for s in range(len(ws) - 11):
            terms = sorted(set(codes[s : s + 12].tolist()))
            for j in range(50):
                x = score(index, terms, j)
                assert abs(x - 0.999) < 1e-5 or ((s, j) in got) == (x >= 0.999)


def test_blocks_hold_the_maxima():
    rnd = random.Random(4)
    _, index = index_of([(i, " ".join(words(rnd, 30, 200))) for i in range(100)])
    for e in range(len(index.block)):
        some = slice(index.block_start[e], index.block_start[e + 1])
        assert (index.item[some] // k.BLOCK == index.block[e]).all() and index.block_max[e] == index.weight[some].max()
    assert index.block_max.max() <= index.most.max()


def test_statistics_are_those_of_all_items(spark):
    """The same scores in one segment as in many."""
    import pickle

    rnd = random.Random(8)
    items = spark.createDataFrame([(i, " ".join(words(rnd, 20))) for i in range(60)], "item_id bigint, text string")
    most = {}
    for segment in (512, 9):
        for r in k.indexed(items, 12, segment).collect():
            index = pickle.loads(r["data"])
            for j, i in enumerate(index.ids.tolist()):
                most.setdefault(segment, {})[i] = np.sort(index.weight[index.item == j]).tolist()
    assert most[512].keys() == most[9].keys() and all(np.allclose(most[512][i], most[9][i]) for i in most[9])


def test_many_items_are_never_in_one_place(spark, monkeypatch):
    """Twenty thousand items: the driver gets the index's size alone, and a task one segment at a time."""
    monkeypatch.setattr(k, "BROADCAST_BYTES", 1 << 16)
    rnd = random.Random(11)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(30)) for _ in range(20_000)]
    items = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], ITEMS).repartition(4)
    docs = [(d, "x y z " + " ".join(texts[d * 37].split()[5:20]), 0, "") for d in range(200)]
    got = sorted((r["doc_id"], r["item_id"]) for r in k.leaks(spark.createDataFrame(docs, DOCS), items).collect())
    assert got == [(d, d * 37) for d in range(200)]


def test_report_and_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a " * 20, "s", 0)], ITEMS)
    assert k.leaks(docs, items).count() == 0
    assert k.leaks(spark.createDataFrame([(1, "a " * 20, 0, "")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    r = k.leaked_items(k.leaks(docs, items), items).collect()
    assert [(x["item_id"], x["n_documents"], x["longest_run"]) for x in r] == [(1, 0, 0)]
