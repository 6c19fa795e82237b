"""The Jaccard join against brute force: edited copies, stars, chains, crowds, empty and odd texts."""

import collections
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from reelscope.llm import jaccard, queries, simhash  # noqa: E402


def shingle_set(text, words):
    tokens = (text or "").encode().lower().split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def brute(rows, words, share, empty_alike=False):
    """id -> (size of the set, smallest id reachable), by counting what all pairs share."""
    p, q = share
    sets = [shingle_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(i, j):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for t in s for j in holders[t]).items():
            if q * n >= p * (len(s) + len(sets[j]) - n):
                join(i, j)
        for t in s:
            holders[t].append(i)
    if empty_alike:
        none = [i for i, s in enumerate(sets) if not s]
        for i in none:
            join(none[0], i)
    return {r[0]: (len(sets[i]), rows[find(i)][0]) for i, r in enumerate(rows)}


def compared(spark, rows, words=4, share=(85, 100), **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = jaccard.near_copies(docs, words=words, share=share, **options).collect()
    assert len(found) == len(rows)
    assert {r.id: (r.n_shingles, r.component) for r in found} == brute(rows, words, share, options.get("empty_alike", False))


def edited(rng, n, copies):
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    yield " ".join(base)
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(1, 2 + n // 60)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"]])
        yield " ".join(words)


def star(rng, copies, edits, length=300):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    yield " ".join(base)
    for _ in range(copies):
        words = list(base)
        for at in rng.sample(range(length), edits):
            words[at] = f"x{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("words,share,frequent", [(4, (85, 100), 32), (5, (4, 5), 2), (3, (1, 2), 2)])
def test_edited_copies(spark, words, share, frequent):
    rng = random.Random(3)
    texts = [t for _ in range(20) for t in edited(rng, rng.randrange(60, 400), 6)]
    texts += ["", None, " \t\x0b", "One two", "one  TWO", "one three", "É é", "é é", "one " * 50, "one " * 9]
    compared(spark, list(enumerate(texts)), words, share, frequent=frequent, empty_alike=frequent == 2)


@pytest.mark.parametrize("seed,words,share,edits", [(1, 5, (4, 5), 6), (2, 5, (4, 5), 6), (3, 4, (85, 100), 5), (4, 4, (85, 100), 7)])
def test_stars_of_copies(spark, seed, words, share, edits):
    """Copies close to one text but not to each other; at seven edits most are beyond the limit."""
    rng = random.Random(seed)
    rows = list(star(rng, 300, edits))
    rng.shuffle(rows)
    compared(spark, list(enumerate(rows)), words, share)


def test_chain_and_shared_passage(spark, monkeypatch):
    """Versions that drift, texts that share a long passage only, and keys that count as hot."""
    monkeypatch.setattr(jaccard, "HOT", 8)
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        base[rng.randrange(120)] = f"y{i}"
        rows.append(" ".join(base))
    passage = " ".join(f"p{i}" for i in range(55))
    rows += [passage + " " + " ".join(f"q{rng.randrange(10**5)}" for _ in range(rng.choice([4, 8, 60]))) for _ in range(150)]
    rng.shuffle(rows)
    compared(spark, list(enumerate(rows)))


def test_query_shapes_nulls_repeats_empty_table_and_extra_columns(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "y"), (None, "a b c d e", None), (None, None, None), (4, "", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "1 AS size", "2 AS key", "3 AS component")
    got = [(r.id, r.n_shingles, r.component) for r in jaccard.near_copies(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (4, 0, 4), (5, 0, 5)], key=str)
    assert jaccard.near_copies(docs.limit(0)).collect() == []
    assert jaccard.near_copies(docs.where("text = ''")).count() == 2


def test_query_on_the_small_tables(spark, sf_dir="/root/testdata/sf0.001"):
    if not os.path.isdir(sf_dir):
        pytest.skip("benchmark tables are not here")
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op13_jaccard(spark, sf_dir).collect()}
    assert found == brute(rows, 4, (85, 100))


def test_stage_removes_edited_copies(spark):
    base = [f"word{i}" for i in range(200)]
    twin = base[:100] + base[102:]
    docs = spark.createDataFrame([(2, " ".join(base)), (5, " ".join(twin)), (7, " ".join(base[:120]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [2, 7]


texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x1c\u2003", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 5))
def test_sets_are_those_of_the_words(found, words):
    """Sizes, equal sets and intersections as with Python's words of bytes."""
    sets = jaccard.shingle_sets(pa.array(found, pa.string()), words)
    plain = [shingle_set(t, words) for t in found]
    for a, x in zip(sets, plain):
        assert len(a) == len(x)
        for b, y in zip(sets, plain):
            assert len(np.intersect1d(a, b)) == len(x & y)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 300), st.integers(0, 60), st.sampled_from([(85, 100), (4, 5), (1, 2)]), st.sampled_from([0.0, 0.5, 0.9, 1.0]), st.integers(0, 2**32 - 1))
def test_linked_sets_share_a_key(size, missing, share, frequent, seed):
    """The prefix rule: whatever the classes, two sets similar enough have a key in common."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, size + 2 * missing, np.uint64))
    classes = np.where(rng.random(len(pool)) < frequent, rng.integers(1, 3, len(pool)), 0).astype(np.int8)
    a = np.sort(rng.permutation(len(pool))[: min(size, len(pool))])
    keep = np.sort(rng.permutation(a)[: max(1, len(a) - missing)])
    b = np.unique(np.r_[keep, rng.permutation(len(pool))[: rng.integers(0, missing + 1)]])
    both = len(np.intersect1d(a, b))
    if both * share[1] >= share[0] * (len(a) + len(b) - both):
        first, second = jaccard.prefix_keys(pool[a], classes[a], share), jaccard.prefix_keys(pool[b], classes[b], share)
        assert len(np.intersect1d(first[0], second[0])) or len(np.intersect1d(first[1], second[1]))
        if len(first[1]) and len(second[1]):  # all rare tokens are keys then
            assert set(pool[a][classes[a] == 0]) <= set(first[0]) and set(pool[b][classes[b] == 0]) <= set(second[0])


def test_parities_never_differ_in_more_places_than_sets_in_tokens(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for i in range(200):
        n = int(rng.integers(0, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.r_[a[int(rng.integers(0, 9)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 200)), np.uint64)])
        rows.append((i, jaccard.parities(a, len(a)).tolist(), jaccard.parities(b, len(b)).tolist()))
        want.append(len(np.setxor1d(a, b)))
    frame = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    for r in frame.select("i", jaccard.differing(frame.a, frame.b).alias("d"), jaccard.differing(frame.b, frame.a).alias("e")).collect():
        assert r.d == r.e and r.d <= want[r.i] and (want[r.i] - r.d) % 2 == 0 and (r.d > 0.2 * want[r.i] or want[r.i] < 4)


@pytest.mark.parametrize("size,rare", [(388, 32), (388, 0), (2000, 0), (146, 13)])
def test_a_set_of_frequent_tokens_has_few_keys(size, rare):
    """Combinations stay in proportion to the set, however frequent its tokens are (2,279 and 15,037 keys for 388 and 2,000 tokens before)."""
    rng = np.random.default_rng(1)
    tokens = np.sort(rng.integers(0, 1 << 63, size, np.uint64))
    for k in (1, 2):
        classes = np.where(rng.permutation(size) < rare, 0, k).astype(np.int8)
        assert len(jaccard.prefix_keys(tokens, classes, (4, 5))[1]) <= 1.6 * size


def test_simhash_blocks_find_the_first_links(spark, monkeypatch):
    """The pipeline's near copies pass through the blocks of fingerprints, and the exact join gives the same result as without them."""
    called = []
    keys = simhash.block_keys
    monkeypatch.setattr(simhash, "block_keys", lambda fp: called.append(1) or keys(fp))
    rng = random.Random(4)
    rows = [t for _ in range(12) for t in edited(rng, rng.randrange(200, 700), 5)] + list(star(rng, 80, 5)) + ["", None, "one two", "ONE two", "one " * 40]
    compared(spark, list(enumerate(rows)), 5, (4, 5), empty_alike=True, simhash_first=True)
    assert called
    called.clear()
    docs = spark.createDataFrame([(2, rows[0]), (5, rows[0] + " more"), (7, "quite another text of several words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [2, 7]
    assert called


def test_close_pairs_against_brute_force(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(63) for _ in range(40)]
    for base in list(prints):
        for n in (0, 1, 2, 3, 4):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(63), n)))
    rows = list(enumerate(prints))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def groups(pairs):
        for i in root:
            root[i] = i
        for i, j in pairs:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        return [find(i) for i, _ in rows]

    want = groups([(i, j) for i, a in rows for j, b in rows[:i] if (a ^ b).bit_count() <= 2])
    for crowd in (64, 1):
        got = simhash.close_pairs(spark.createDataFrame(rows, "id long, fp long"), crowd=crowd).collect()
        assert groups([(r.u, r.v) for r in got]) == want


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_few_pairs_do_not_shuffle_the_texts(spark, monkeypatch, few):
    """Texts and sets were shuffled in every round, for however few pairs; either way the links are those of all pairs."""
    plans, real = {}, jaccard.staged
    monkeypatch.setattr(jaccard, "FEW", few, raising=False)
    monkeypatch.setattr(jaccard, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and real(df, name))
    rng = random.Random(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compared(spark, list(enumerate(star(rng, 30, 6))), frequent=3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in plans["jaccard-sets"]) == (few == 0)


def test_components_against_union_find(spark, monkeypatch):
    """A hub, a long chain and random edges; each round reads the edges from files and shuffles six times at most."""
    plans, real = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    rng = random.Random(5)
    pairs = [(0, i) for i in range(1, 400, 3)] + [(i, i + 1) for i in range(1000, 1200)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(450)]
    pairs = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in pairs if a != b]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in root} == {n: find(n) for n in root}
    assert len(plans) > 2 and max(p.count("Exchange hashpartitioning") for p in plans) <= 6
