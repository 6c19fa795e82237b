"""Ranked lexical search over posting lists in geometric blocks with exact summaries.

A document is a sparse vector of impacts, one for each query term it holds; a query weighs its terms; the score is
their inner product, in integers.  Documents are searched in chunks of some thousands.  In a chunk each term has a
posting list, and a list is cut into blocks of documents that are alike: every document goes to the nearest of some of
the list's documents, by the cosine of random projections of the vectors.  A block's summary holds the largest impact
of each term in it, so query times summary bounds the score of every document in the block.  A block is skipped only if
its bound is below the score that the result's last place has already; a list only if no document that lacks the
terms before it can reach that score.  So results are exact, whatever the blocks are.

Lists are cut when a query first needs them.  Scores found in one chunk of a task are the threshold of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reelscope.llm.common import map_texts, ragged, staged
from reelscope.llm.jaccard import word_hashes

#: Terms are runs of other characters than these (A-Z lower-cased): ASCII but for digits and letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
#: Documents searched together, documents of a block, dimensions of the projections.
CHUNK, BLOCK, DIMENSIONS = 8192, 32, 24
#: Query terms (with repeats over queries) searched in one pass, and so in memory of every task: 8 MB and their strings.
PASS_TERMS = 1 << 20
#: An impact is below 10^6.
IMPACT_BITS = 20


def terms_of(text: Column) -> Column:
    """The terms of a text, in order; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


class Vocabulary:
    """The terms of the queries of a pass, by the hash of a term."""

    def __init__(self, terms: list[str]) -> None:
        hashes = word_hashes(pa.array(terms, pa.string()), PARTS)[0]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the term with this hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def counted(vocabulary):
    """Task-side function: texts to their number of terms and the numbers and counts of the query terms in them."""

    def make():
        known = vocabulary.value

        def work(column: pa.Array) -> dict[str, pa.Array]:
            hashes, counts = word_hashes(column, PARTS)
            numbers = known.numbers(hashes)
            docs = np.repeat(np.arange(len(counts)), counts)[numbers >= 0]
            width = max(1, len(known.hashes))
            pairs, tf = np.unique(docs * width + numbers[numbers >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(counts) + 1) * width), pa.int32())
            lists = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
            return {"n": pa.array(counts, pa.int64()), "terms": lists(pairs % width, pa.int32()), "tf": lists(tf, pa.int32())}

        return work

    return make


class Chunk:
    """Vectors of some documents (rows ``starts``, ``terms``, ``impacts``) with posting lists, cut into blocks as needed."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray) -> None:
        self.starts, self.terms, self.impacts, self.weights = starts, terms, impacts, weights
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        by_term = np.argsort(terms, kind="stable")
        self.holders = rows[by_term]
        self.lists = np.searchsorted(terms[by_term], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        np.maximum.at(self.most, terms, impacts)
        self.rows, self.places, self.points, self.blocks = rows, np.arange(len(terms)), None, {}

    def projected(self) -> np.ndarray:
        """Random projections of the weighted vectors, of length one."""
        if self.points is None:
            signs = np.random.default_rng(12).choice(np.float32([-1, 1]), (len(self.weights), DIMENSIONS))
            points = np.zeros((len(self.starts) - 1, DIMENSIONS), np.float32)
            values = (self.weights[self.terms] * self.impacts).astype(np.float32)
            for d in range(DIMENSIONS):
                points[:, d] = np.bincount(self.rows, values * signs[self.terms, d], len(points))
            self.points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        return self.points

    def cut(self, term: int):
        """The blocks of a term's list: documents block by block, block borders, summary borders, terms and maxima."""
        if term not in self.blocks:
            held = self.holders[self.lists[term] : self.lists[term + 1]]
            pivots = -(-len(held) // BLOCK)
            if pivots > 1:
                points = self.projected()[held]
                middle = points[np.linspace(0, len(held) - 1, pivots).astype(int)]
                block = np.argmax(points @ middle.T, axis=1)
                held = held[np.argsort(block, kind="stable")]
                sizes = np.bincount(block)
                sizes = sizes[sizes > 0]
            else:
                sizes = np.array([len(held)])
            borders = np.r_[0, np.cumsum(sizes)]
            lengths = self.starts[held + 1] - self.starts[held]
            at = ragged(self.places, self.starts[held], lengths)
            pair = np.repeat(np.repeat(np.arange(len(sizes)), sizes), lengths) * len(self.weights) + self.terms[at]
            both = np.sort(pair << IMPACT_BITS | self.impacts[at])
            both = both[np.r_[both[1:] >> IMPACT_BITS != both[:-1] >> IMPACT_BITS, True]]
            summary, maxima = both >> IMPACT_BITS, both & ((1 << IMPACT_BITS) - 1)
            self.blocks[term] = held, borders, np.searchsorted(summary, np.arange(len(sizes)) * len(self.weights)), summary % len(self.weights), maxima
        return self.blocks[term]

    def scores(self, docs: np.ndarray, weighed: np.ndarray) -> np.ndarray:
        """Exact scores; every one of ``docs`` holds a term."""
        lengths = self.starts[docs + 1] - self.starts[docs]
        at = ragged(self.places, self.starts[docs], lengths)
        return np.add.reduceat(weighed[self.terms[at]] * self.impacts[at], np.r_[0, np.cumsum(lengths)[:-1]])

    def search(self, query: np.ndarray, best: "Best", weighed: np.ndarray) -> tuple[int, int]:
        """Put the chunk's documents that belong there into ``best``; gives how many were scored, of how many with a term."""
        bounds = self.weights[query] * self.most[query]
        query, bounds = query[bounds > 0], bounds[bounds > 0]
        order = np.argsort(-bounds, kind="stable")
        query, rest = query[order], np.cumsum(bounds[order][::-1])[::-1]
        weighed[query] = self.weights[query]
        seen = np.zeros(len(self.starts) - 1, bool)
        for term, most in zip(query.tolist(), rest.tolist()):
            if most < best.least:
                break
            if self.lists[term + 1] - self.lists[term] <= BLOCK:  # one block, scored as fast as summed up
                self.put(self.holders[self.lists[term] : self.lists[term + 1]], seen, best, weighed)
                continue
            held, borders, starts, terms, maxima = self.cut(term)
            upper = np.add.reduceat(weighed[terms] * maxima, starts)
            blocks, step = np.argsort(-upper, kind="stable"), 2
            while len(blocks):
                now, blocks = blocks[:step], blocks[step:]
                now = now[upper[now] >= best.least]
                if not len(now):
                    break
                self.put(ragged(held, borders[now], borders[now + 1] - borders[now]), seen, best, weighed)
                step *= 4
        weighed[query] = 0
        return int(seen.sum()), len(self.starts) - 1

    def put(self, docs: np.ndarray, seen: np.ndarray, best: "Best", weighed: np.ndarray) -> None:
        docs = docs[~seen[docs]]
        if len(docs):
            seen[docs] = True
            best.add(self.scores(docs, weighed), docs)


class Best:
    """The best documents of one query so far: scores, whether the id is known, ids; equal scores by id, null first."""

    def __init__(self, k: int) -> None:
        self.k, self.least, self.ids, self.known = k, 1, None, None
        self.rows = np.zeros((3, 0), np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        fit = scores >= self.least
        if not fit.any():
            return
        docs = docs[fit]
        rows = np.concatenate([self.rows, np.stack([scores[fit], self.known[docs].astype(np.int64), self.ids[docs]])], axis=1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]
        if self.rows.shape[1] == self.k:
            self.least = int(self.rows[0, -1])


def searched(queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, chunk: int):
    """Task-side function over batches (id, n, terms, tf): the best documents of each query in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        weighed = np.zeros(len(weights), np.int64)
        held: list = []

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("terms").combine_chunks()
            starts = np.asarray(lists.offsets).astype(np.int64)
            flat = lambda name: np.asarray(table.column(name).combine_chunks().flatten()).astype(np.int64)
            terms, tf = flat("terms"), flat("tf")
            n = np.asarray(table.column("n")).astype(np.int64)
            m = np.repeat(10 + 90 * n * n_docs // max(1, n_terms), np.diff(starts))
            found = Chunk(starts - starts[0], terms, 1_000_000_000 * tf // (1000 * tf + 8 * m), weights)
            ids = table.column("id").combine_chunks()
            known, ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)).astype(np.int64)
            for query, b in zip(queries, best):
                b.ids, b.known = ids, known
                found.search(query, b, weighed)

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                held.append(batch.slice(at, chunk))
                if sum(b.num_rows for b in held) >= chunk:
                    flush()
                    held = []
        if held:
            flush()
        rows = np.concatenate([np.zeros((3, 0), np.int64)] + [b.rows for b in best], axis=1)
        query = np.repeat(np.arange(len(best)), [b.rows.shape[1] for b in best])
        ids = pa.array(rows[2], pa.int64(), mask=rows[1] == 0)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), ids, pa.array(rows[0], pa.int64())], ["query", "id", "score"])

    return run


def search(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", k: int = 10,
    chunk: int = CHUNK, pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """(item_id, rank, id, score): the ``k`` best documents with a score above 0 of every row of ``items``.

    Ids of documents are integers.  Terms, weights and scores are those of the contract: N counts documents with a term,
    L all terms, a term in df documents weighs floor(1000 ln((2N+2)/(2df+1))), and with tf occurrences among n terms adds
    weight * ((10^9 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L.  Whole texts count; null and empty texts have no
    terms and are never found, items without terms find nothing.  Equal scores stand by ascending id, null first.  Rows
    of a repeated id are documents by themselves; repeated items are answered one by one.  Extra columns are not read.
    Queries are searched ``pass_terms`` terms at a time, so what tasks hold of them has a bound.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_column}`").alias("item"), F.array_distinct(terms_of(F.col(f"`{item_text}`"))).alias("terms"))
    asked = staged(asked.withColumn("query", F.monotonically_increasing_id()), "ranked-queries")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-total // pass_terms))
    source = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    found = None
    for number in range(passes):
        here = asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == number).toPandas()
        names = sorted({t for terms in here["terms"] for t in terms})
        number_of = {t: i for i, t in enumerate(names)}
        vocabulary = spark.sparkContext.broadcast(Vocabulary(names))
        vectors = staged(map_texts(source, "text", counted(vocabulary), "n bigint, terms array<int>, tf array<int>", keep=["id"], arrow=True), "ranked-vectors")
        size = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(names), np.int64)
        for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the pass
            df[row["t"]] = row["count"]
        weights = np.floor(1000 * np.log((2 * size.docs + 2) / (2 * df + 1))).astype(np.int64)
        queries = [np.array(sorted(number_of[t] for t in terms), np.int64) for terms in here["terms"]]
        given = spark.sparkContext.broadcast((queries, weights))
        rows = vectors.where(F.size("terms") > 0).mapInArrow(_run(given, size.docs, size.terms, k, chunk), "query bigint, id bigint, score bigint")
        numbers = spark.createDataFrame([(i, int(q)) for i, q in enumerate(here["query"])], "query bigint, name bigint")
        rows = rows.join(F.broadcast(numbers), "query").select(F.col("name").alias("query"), "id", "score")
        found = rows if found is None else found.unionByName(rows)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id")))
    top = found.withColumn("rank", place).where(F.col("rank") <= k)
    return top.join(asked.select("query", "item"), "query").select(F.col("item").alias("item_id"), "rank", "id", "score")


def _run(given, n_docs: int, n_terms: int, k: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = given.value
        return searched(queries, weights, n_docs, n_terms, k, chunk)(batches)

    return run
