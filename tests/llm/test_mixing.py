import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.llm import mixing as m

pytestmark = pytest.mark.skipif(not os.path.exists(m.VOCABULARY), reason="the tokenizer's vocabulary isn't here")
DOCS = "doc_id bigint, text string, source string, site string, tokens string, src int"
TARGETS = "mix_id int, source string, target_weight double, max_uses int, tokens int"


def docs_of(rnd, n=400):
    out = []
    for i in range(n):
        s = rnd.choice(["web", "web", "web", "news", "code"])
        text = " ".join(rnd.choice({"web": "alpha beta gamma", "news": "delta epsilon zeta", "code": "eta theta iota"}[s].split()) for _ in range(rnd.randrange(5, 60)))
        out.append((i, text, rnd.choice([s, s, s.upper(), f" {s} ", None]), s + ".example", "x", 1))
    return out + [(9000, None, "web", None, "", 0), (9001, "", None, None, "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(docs_of(random.Random(4)), DOCS)


def whole(docs, targets):
    sized, known = m.measured(docs)
    fit = m.fitted(sized, known, targets)
    return sized, known, fit, m.report(sized, known, targets, fit)


def test_source_names(spark):
    df = spark.createDataFrame([(" Wiki-Mirror\t",), ("wiki_mirror",), (None,)], "s string")
    assert [r[0] for r in df.select(m.source_name(F.col("s"))).collect()] == ["wiki_mirror", "wiki_mirror", None]


def test_targets_are_met_where_they_can_be(spark, docs):
    targets = spark.createDataFrame([(1, "web", 0.3, 2, 0), (1, "News", 0.3, 2, 0), (1, "code", 0.4, 3, 0), (2, "code", 0.9, 1, 0), (2, "none", 0.1, 5, 0), (None, "web", 1.0, 1, 0), (3, None, 1.0, 1, 0)], TARGETS)
    sized, known, fit, report = whole(docs, targets)
    total = sized.agg(F.sum("tokens")).first()[0]
    assert fit.total == total
    got = {(r["mix_id"], r["source"]): r for r in report.collect()}
    assert len(got) == 5
    for key in ((1, "web"), (1, "News"), (1, "code")):
        r = got[key]
        assert not r["short"] and r["expected_tokens"] == pytest.approx(r["target_weight"] * total, rel=0.02)
        assert r["reached"] == pytest.approx(r["target_weight"], rel=0.35)
    assert got[2, "code"]["short"] and got[2, "none"]["short"] and got[2, "none"]["source_tokens"] == 0
    assert got[2, "code"]["used_tokens"] == got[2, "code"]["source_tokens"]
    uses = m.mix(sized, known, fit).groupBy("mix_id").agg(F.max("uses")).collect()
    assert all(u <= {1: 3, 2: 1}[i] for i, u in uses)


def test_classifier_on_held_out_documents():
    with open(m.VOCABULARY, "rb") as f:
        enc = m.encoder(f.read())
    rows = [(enc.encode_ordinary(t), s.strip().lower()) for _, t, s, *_ in docs_of(random.Random(5)) if t and s]
    x = np.stack([m.vector(ids, None) for ids, _ in rows])
    model = m.fit(x[:200], [s for _, s in rows[:200]])
    p = model.posterior(x[200:])
    hit = np.mean([model.sources[j] == s for j, (_, s) in zip(p.argmax(axis=1), rows[200:])])
    assert hit > 0.95 and np.allclose(p.sum(axis=1), 1)


def test_soft_documents_count_by_membership(docs):
    sized, known = m.measured(docs)
    rows = sized.where("member is not null").collect()
    assert rows and all(len(r["member"]) == len(known) and abs(sum(r["member"]) - 1) < 1e-6 and r["src"] is None for r in rows)
    null = {r["doc_id"]: r["tokens"] for r in sized.where("doc_id >= 9000").collect()}
    assert null == {9000: 0, 9001: 0}


def test_rates_stay_within_their_caps():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(3), 50)
    x = m.rates(p, np.array([1.0, 2.0, 3.0]), [rng.normal(size=3) * 5 for _ in range(6)])
    assert (x >= 0).all() and (x <= p @ np.array([1.0, 2.0, 3.0]) + 1e-12).all()
    assert m.rates(np.zeros((2, 3)), np.ones(3), [np.ones(3)]).tolist() == [0, 0]


def test_least_squares_beats_other_rates(spark, docs):
    """No feasible rates that we try come closer to the targets than the fitted ones."""
    targets = spark.createDataFrame([(1, "web", 0.5, 1, 0), (1, "news", 0.2, 2, 0), (1, "code", 0.3, 2, 0)], TARGETS)
    sized, known, fit, _ = whole(docs, targets)
    want = np.array([{"code": 0.3, "news": 0.2, "web": 0.5}[s] for s in fit.sources]) * fit.total
    best = ((fit.expected[1] - want) ** 2).sum()
    rows = sized.where("tokens > 0").collect()
    place = {s: i for i, s in enumerate(fit.sources)}
    member = np.array([np.eye(3)[place[r["src"]]] if r["src"] else [r["member"][known.index(s)] for s in fit.sources] for r in rows])
    tokens = np.array([r["tokens"] for r in rows], float)
    caps = member @ fit.caps[1]
    rng = np.random.default_rng(0)
    base = m._rated(fit, 1, member, np.array([r["src"] is None for r in rows]))
    assert np.allclose((base * tokens) @ member, fit.expected[1], rtol=1e-3)
    for _ in range(200):
        x = np.clip(base + rng.normal(size=len(base)) * 0.2, 0, caps)
        assert (((x * tokens) @ member - want) ** 2).sum() >= best - 1e-6 * fit.total**2


def test_shortfalls_are_the_fits_residuals(spark, docs, monkeypatch):
    """Without a single step nothing is reached, and the report says so."""
    targets = spark.createDataFrame([(1, "web", 0.3, 2, 0), (1, "code", 0.7, 1, 0)], TARGETS)
    sized, known, fit, report = whole(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    assert not got["web"]["short"] and got["web"]["lacking"] == pytest.approx(0, abs=1e-6)
    assert got["code"]["short"] and got["code"]["lacking"] == pytest.approx(got["code"]["target_tokens"] - got["code"]["source_tokens"])
    assert fit.moved < 1e-4 and got["web"]["moved"] == fit.moved
    idle = m.fitted(sized, known, targets, rounds=0)
    assert all(r["short"] for r in m.report(sized, known, targets, idle).collect())


def test_shares_of_the_mix_itself(spark, docs):
    targets = spark.createDataFrame([(1, "web", 0.3, 2, 0), (1, "news", 0.3, 2, 0), (1, "code", 0.4, 3, 0)], TARGETS)
    sized, known, fit, report = whole(docs, targets)
    rows = report.collect()
    mixed = m.mix(sized, known, fit)
    tokens = mixed.agg(F.sum(F.col("tokens") * F.col("uses"))).first()[0]
    assert {r["mix_tokens"] for r in rows} == {tokens}
    assert sum(r["mix_share"] for r in rows) == pytest.approx(1)
    assert all(r["mix_share"] == pytest.approx(r["target_weight"], abs=0.05) for r in rows)


def test_long_documents_enter_the_fit(spark):
    rows = [(i, ("alpha beta " if i % 2 else "delta zeta ") * 9000, "web" if i % 2 else "news", None, "", 0) for i in range(6)]
    sized, known = m.measured(spark.createDataFrame([*rows, (9, "delta zeta " * 50, None, None, "", 0)], DOCS))
    member = sized.where("doc_id = 9").first()["member"]
    assert known == ["news", "web"] and member[0] > member[1]


def test_empty(spark):
    none, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "web", 1.0, 1, 0)], TARGETS)
    sized, known, fit, report = whole(none, targets)
    assert [(r["short"], r["used_tokens"], r["reached"]) for r in report.collect()] == [(False, 0, None)]
    assert m.mix(sized, known, fit).count() == 0
    assert whole(none, spark.createDataFrame([], TARGETS))[3].count() == 0
