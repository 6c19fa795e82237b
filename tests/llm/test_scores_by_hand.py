"""The quality vote and the toxicity label model against plain loops and full enumeration."""

import itertools
import math
import random

import numpy as np
import pytest

from reelscope.llm import quality, queries, toxicity
from reelscope.llm.common import table


def plain_vote(x, bank, labels, neighbours, power, prior):
    """Cosines one by one, sorted, the nearest weighed."""
    out = []
    for v in x:
        scored = sorted(((float(np.dot(v, b)), float(y)) for b, y in zip(bank, labels)), reverse=True)[:neighbours]
        w = [max(s, 0.0) ** power for s, _ in scored]
        out.append((sum(a * y for a, (_, y) in zip(w, scored)) + 0.1 * prior) / (sum(w) + 0.1))
    return out


@pytest.mark.parametrize("rows,neighbours", [(300, 16), (10, 16), (1, 1)])
def test_vote_against_a_loop(rows, neighbours):
    rng = np.random.default_rng(rows)
    unit = lambda n: (lambda v: (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32))(rng.standard_normal((n, 12)))
    model = quality.Quality(np.ones(1), np.zeros((1, 12)), unit(rows), (rng.random(rows) < 0.6).astype(float), neighbours, 4.0)
    x = unit(700)
    want = plain_vote(x, model.bank, model.labels, neighbours, 4.0, model.prior)
    assert np.abs(model.vote(x, block=64) - want).max() < 1e-5
    assert quality.Quality(np.ones(1), np.zeros((1, 12)), unit(1)[:0], np.zeros(0), 4, 4.0).vote(x).tolist() == [0.5] * 700


def test_whole_quality_scores_against_a_loop(spark):
    """Every score of the query: vectors of one text at a time, plain cosines with all labelled vectors."""
    place = "/root/testdata/sf0.001"
    docs, labels = table(spark, place, "documents"), table(spark, place, "labels")
    model = quality.fit(docs, labels, ~toxicity.held_out("doc_id", 4, 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op2_quality(spark, place).collect():
        terms, weights = quality.features(texts[r.doc_id])
        v = np.zeros(model.basis.shape[1])
        for t, w in zip(terms, weights):
            v += float(w) * float(model.idf[t]) * model.basis[t].astype(float)
        size = np.linalg.norm(v)
        (want,) = plain_vote([v / size if size else v], model.bank.astype(float), model.labels, model.neighbours, model.power, model.prior)
        assert r.score == pytest.approx(want, abs=1e-4) and r.predicted == int(r.score >= 0.7)


def test_posteriors_against_the_joint_table():
    """Bayes' rule over the full joint table of (class, votes) that the fitted prior and tables span."""
    rng = random.Random(3)
    n = toxicity.VOTERS
    masks = []
    for _ in range(4000):
        toxic = rng.random() < 0.2
        fired = [rng.random() < (0.5 if toxic else 0.03) for _ in range(n)]
        fired[1] = fired[0] if rng.random() < 0.9 else fired[1]  # two that depend on each other
        masks.append(sum(f << i for i, f in enumerate(fired)))
    seen, counts = np.unique(masks, return_counts=True)
    model = toxicity.LabelModel().fit(seen, counts.astype(float))
    assert any({0, 1} <= set(g) for g in model.groups)
    joint = {}
    for y in (0, 1):
        for codes in itertools.product(*[range(1 << len(g)) for g in model.groups[:4]]):
            joint[y, codes] = (model.prior if y else 1 - model.prior) * math.prod(math.exp(t[y, c]) for t, c in zip(model.tables, codes))
    assert sum(joint.values()) == pytest.approx(1)  # a distribution over the votes of four groups
    for mask in seen[::17].tolist():
        odds = {}
        for y in (0, 1):
            p = model.prior if y else 1 - model.prior
            for g, t in zip(model.groups, model.tables):
                p *= math.exp(t[y, sum(((mask >> v) & 1) << i for i, v in enumerate(g))])
            odds[y] = p
        got = model.posterior(np.array([mask]))[0]
        assert got == pytest.approx(odds[1] / (odds[0] + odds[1]), rel=1e-9, abs=1e-12)


def test_toxicity_scores_against_a_loop(spark):
    place = "/root/testdata/sf0.001"
    docs = table(spark, place, "documents")
    model = toxicity.fit(docs, table(spark, place, "labels"), ~toxicity.held_out("doc_id", 5, 0))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op1_toxicity(spark, place).collect():
        signs = set(toxicity.all_signs(toxicity.distinct_words(texts[r.doc_id])))
        total = model.bias + sum(w for s, w in model.weights.items() if s in signs)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9) and r.predicted == int(r.score >= 0.5)
