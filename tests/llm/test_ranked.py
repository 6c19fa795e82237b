"""Ranked search against a plain loop: random words, ties, blocks and chunks of every size, odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from reelscope.llm import ranked

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall((text or "").translate(str.maketrans(ranked.UPPER, ranked.LOWER)))


def brute(docs, items, k):
    """(item, rank, id, score) of every item row."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    n_terms = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            if not c:
                continue
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is not None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=3, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted([(r.item_id, r["rank"], r.id, r.score) for r in ranked.search(d, i, k=k, **options).collect()], key=str)


@pytest.mark.parametrize("chunk,block,pass_terms", [(8192, 32, 1 << 20), (50, 4, 40), (7, 2, 10)])
def test_search_against_a_loop(spark, monkeypatch, chunk, block, pass_terms):
    monkeypatch.setattr(ranked, "BLOCK", block)
    rng = random.Random(chunk)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(6000)] + ["É", "é", "12", "x_y", "W1"]
    docs = [(i, rng.choice([" ", ".", ", "]).join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(250)]
    docs += [(1000 + i, docs[3][1]) for i in range(20)] + [(None, docs[5][1]), (7, None), (8, ""), (9, docs[9][1]), (2000, "w1 " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30])))) for i in range(25)] + [(90, docs[3][1]), (91, ""), (92, None), (93, "nowhere"), (0, "w1 w2"), (None, "w3")]
    assert found(spark, docs, items, chunk=chunk, pass_terms=pass_terms) == brute(docs, items, 3)


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2), (2, "a", 1, 2)], "doc_id long, text string, score long, query int")
    items = spark.createDataFrame([(5, "b a", 3, 4)], "item_id long, text string, id long, rank int")
    assert [(r.item_id, r["rank"], r.id) for r in ranked.search(docs, items).orderBy("rank").collect()] == [(5, 1, 1), (5, 2, 2)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.where("false").unionByName(docs.selectExpr("doc_id", "'' AS text", "score", "query")), items)):
        out = ranked.search(d, i)
        assert out.columns == ["item_id", "rank", "id", "score"] and out.count() == 0


def test_summaries_bound_and_skip():
    """Bounds are never below a score, and alike documents in blocks let most of them be skipped."""
    rng = np.random.default_rng(5)
    rows = []
    for group in range(40):
        core = rng.choice(400, 12, replace=False)
        rows += [np.unique(np.r_[core, rng.choice(400, 4), 400]) for _ in range(50)]
    starts = np.r_[0, np.cumsum([len(r) for r in rows])]
    flat = np.concatenate(rows)
    impacts, weights = rng.integers(1, 900_000, len(flat)), rng.integers(0, 9000, 401)
    weights[400] = 500
    chunk = ranked.Chunk(starts, flat, impacts, weights)
    scored = 0
    for r in rows[::100]:
        weighed, best = np.zeros(401, np.int64), ranked.Best(10)
        best.ids, best.known = np.arange(len(rows)), np.ones(len(rows), bool)
        scored += chunk.search(r, best, weighed)[0]
        assert not weighed.any()
        weighed[r] = weights[r]
        every = chunk.scores(np.arange(len(rows)), weighed)
        order = np.lexsort((np.arange(len(rows)), -every))[:10]
        assert best.rows[2].tolist() == order.tolist() and best.rows[0].tolist() == every[order].tolist()
        held, borders, at, terms_, maxima = chunk.cut(400)
        upper = np.add.reduceat(weighed[terms_] * maxima, at)
        assert sorted(held.tolist()) == list(range(len(rows)))
        assert all(every[held[a:b]].max() <= u for a, b, u in zip(borders, borders[1:], upper))
    assert scored < 0.5 * 20 * len(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZéÉ09_ .\x00\x7f [", max_size=20)), max_size=6))
def test_counts_of_terms(texts):
    vocabulary = sorted({"a", "z", "é", "0", "az", "É", " "})
    holder = type("Held", (), {"value": ranked.Vocabulary(vocabulary)})
    got = ranked.counted(holder)()(pa.array(texts, pa.string()))
    for text, n, numbers, tf in zip(texts, got["n"].to_pylist(), got["terms"].to_pylist(), got["tf"].to_pylist()):
        want = Counter(terms(text))
        assert n == want.total()
        assert {vocabulary[i]: c for i, c in zip(numbers, tf)} == {t: want[t] for t in vocabulary if t in want}
