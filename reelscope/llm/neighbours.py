"""Approximate nearest neighbours through learned partitions.

The neighbour graph of a bounded sample is cut into balanced partitions; a small network learns to tell a
vector's partition (its target: where its neighbours lie).  Every vector is stored in its most probable
partition; a query goes to the most probable ones until they hold ``mass`` of its probability and some times k rows,
and is compared exactly with all their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from reelscope.llm.common import hash_share, staged

#: Rows of either side that one comparison holds at most, on average.
CELL = 2048


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): distinct rows with an id whose vector has only finite components, not all zero.  All others take no part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    return rows.dropDuplicates(["id", "v"])


class Router:
    """A network with one hidden layer: vectors to probabilities of partitions."""

    def __init__(self, d: int, hidden: int, parts: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return h, e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[1]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int, batch: int = 256, rate: float = 2e-3, seed: int = 1) -> None:
        """Adam on cross-entropy with soft targets."""
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                h, p = self.forward(x[pick])
                dz = (p - target[pick]) / len(pick)
                dh = (dz @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[pick].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others of each row, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Partition numbers of the graph's nodes, none above ``slack`` times the mean size.

    Starts from capacity-bound clusters and moves nodes, those that gain most first, to the partition that
    holds most of their neighbours while there is room.
    """
    n, rng = len(x), np.random.default_rng(seed)
    most = int(np.ceil(slack * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(8):
        near = x @ centres.T
        room = np.full(parts, most)
        order = np.argsort(-near.max(axis=1), kind="stable")
        prefer = np.argsort(-near, axis=1)
        for i in order:
            for p in prefer[i]:
                if room[p]:
                    part[i] = p
                    room[p] -= 1
                    break
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    sources, targets = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (sources, part[targets]), 1)
        np.add.at(votes, (targets, part[sources]), 1)
        sizes = np.bincount(part, minlength=parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(sample: np.ndarray, parts: int, k: int = 10, hidden: int = 128, epochs: int = 25) -> Router:
    x = np.unique(sample, axis=0)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = max(1, min(parts, len(x) // 16))
    router = Router(x.shape[1] if len(x) else 1, hidden, parts)
    if parts > 1:
        graph = neighbour_graph(x, min(k, len(x) - 1))
        part = balanced_partition(x, graph, parts)
        target = np.zeros((len(x), parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 0.5 / graph.shape[1])
        target[np.arange(len(x)), part] += 0.5
        router.fit(x, target, epochs)
    return router


def routed(rows: DataFrame, router: Router, mass: float | None, held: dict[int, int] | None = None, least: int = 0) -> DataFrame:
    """Add ``parts``: the most probable partition, or with ``mass`` the most probable ones that together hold so much of the
    probability and, going by the rows that each has (``held``), at least ``least`` rows."""
    weights = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = weights.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            p = net.probabilities(x / np.linalg.norm(x, axis=1, keepdims=True))
            order = np.argsort(-p, axis=1, kind="stable")
            if mass is None:
                wanted = np.ones(len(p), np.int64)
            else:
                wanted = (np.cumsum(np.take_along_axis(p, order, 1), axis=1) < mass).sum(axis=1) + 1
                sizes = np.array([(held or {}).get(i, 0) for i in range(p.shape[1])])
                wanted = np.maximum(wanted, (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1)
            lists = [o[:w].tolist() for o, w in zip(order, np.minimum(wanted, p.shape[1]))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "parts"])

    return rows.select("id", "v").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, v array<double>, parts array<int>")


def nearest_in_cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query: candidates by one matrix product, then the exact measure on the vectors as given."""
    a, b = np.stack(queries["v"].to_numpy()), np.stack(rows["v"].to_numpy())
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    ids, names = rows["id"].to_numpy(), queries["id"].to_numpy()
    s = (a / na[:, None]) @ (b / nb[:, None]).T
    s[names[:, None] == ids[None, :]] = -np.inf
    out = []
    for i in range(len(a)):
        floor = np.partition(s[i], len(ids) - k)[len(ids) - k] - 1e-9 if len(ids) > k else -2.0
        near = np.flatnonzero(s[i] >= max(floor, -2.0))
        score = (b[near] * a[i]).sum(axis=1) / (na[i] * nb[near])
        top = np.lexsort((ids[near], -score))[:k]
        out.append(pd.DataFrame({"query_id": names[i], "query_hash": queries["h"].iat[i], "vec_id": ids[near][top], "score": score[top]}))
    return pd.concat(out, ignore_index=True)


def search(
    vectors: DataFrame, is_query, id_column: str = "vec_id", vector: str = "embedding", k: int = 5, sample_rows: int = 8192, part_rows: int = 2000, most_parts: int = 256, mass: float = 0.97
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row that ``is_query`` (a function of the id column) picks.

    ``sample_rows`` bounds what the router is fitted on; every usable row is indexed and every query searched.
    There is a partition per ``part_rows`` rows, at most ``most_parts``.  A row with the query's id is the
    query's own.  A query goes on to further partitions until they hold 4 k rows that are not its own, so it finds k
    rows wherever there are so many.  Vectors of different lengths have no cosine; each length is searched by itself.
    Partitions are compared in cells of about CELL rows by CELL queries, so neither a crowded
    partition nor a popular one lands in one task.  Scores are cosines in double precision; ties go to the
    smaller id.
    """
    every = staged(usable(vectors, id_column, vector), "vectors")
    lengths = every.groupBy(F.size("v").alias("d"), "id").count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    found = None
    for row in sorted(lengths.collect()):  # a row for each length
        here = every.where(F.size("v") == row.d)
        part = _search(here, row.n, is_query, k, sample_rows, part_rows, most_parts, mass, 4 * k + row.most)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return every.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    return found


def _search(usable_rows: DataFrame, total: int, is_query, k: int, sample_rows: int, part_rows: int, most_parts: int, mass: float, least: int) -> DataFrame:
    """``search`` among vectors of one length."""
    sample = usable_rows.where(hash_share(sample_rows, total, "id", "v")).select("v").toPandas()
    points = np.stack(sample["v"].to_numpy()) if len(sample) else np.zeros((0, 1))
    router = fit_router(points, min(most_parts, -(-total // part_rows)))
    rows = staged(routed(usable_rows, router, None).select("id", "v", F.col("parts")[0].alias("part")), "indexed")
    sizes = lambda df: {r.part: r.n for r in df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = lambda held: {part: -(-n // CELL) for part, n in held.items()}
    held = sizes(rows)
    asked = routed(usable_rows.where(is_query(F.col("id"))), router, mass, held, least)
    queries = staged(asked.select("id", "v", F.xxhash64("v").alias("h"), F.explode("parts").alias("part")), "routed")
    row_cells, query_cells = cells(held), cells(sizes(queries))
    number = lambda counts: F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(counts.items()) for x in kv])[F.col("part")], F.lit(1)) if counts else F.lit(1)
    deal = lambda counts: F.pmod(F.xxhash64("id", "v"), number(counts)).cast("int")
    spread = lambda counts: F.explode(F.sequence(F.lit(0), (number(counts) - 1).cast("int")))
    left = queries.withColumn("qc", deal(query_cells)).withColumn("rc", spread(row_cells))
    right = rows.withColumn("rc", deal(row_cells)).withColumn("qc", spread(query_cells))
    kind = dict(rows.dtypes)["id"]
    schema = f"query_id {kind}, query_hash bigint, vec_id {kind}, score double"

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "query_hash": [], "vec_id": [], "score": []})
        return nearest_in_cell(a, b, k)

    keys = ["part", "rc", "qc"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
