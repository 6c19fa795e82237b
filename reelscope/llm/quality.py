"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are trigrams over classes of characters and bands of a few ratios (repetition, word length,
case).  Terms are weighted by their document frequency in all texts and projected on the leading singular
vectors of a labelled sample.  Every text is compared with all labelled vectors, in blocks of exact cosine
products, and the labels of the nearest are averaged with their similarity as weight.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelscope.llm.common import map_texts, slices
from reelscope.llm.toxicity import labelled

#: Classes of bytes: 0 beyond ASCII, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence marks, 7 !, 8 |, 9 *, 10 other marks, 11 brackets and slashes.
CLASSES = 12
LOOKUP = np.full(256, 10, np.uint8)
LOOKUP[128:] = 0
LOOKUP[97:123], LOOKUP[65:91], LOOKUP[48:58] = 1, 2, 3
for _marks, _class in ((" \t", 4), ("\n\r", 5), (".,;:?'\"-", 6), ("!", 7), ("|", 8), ("*", 9), ("()[]{}<>/\\", 11)):
    LOOKUP[[ord(c) for c in _marks]] = _class
TRIGRAMS = CLASSES**3
BANDS = 10
RATIOS = 10
TERMS = TRIGRAMS + BANDS * RATIOS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of one whole text.  The empty text has its bands only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    c = LOOKUP[np.frombuffer(data, np.uint8)]
    shares = np.bincount(c, minlength=CLASSES) / max(len(c), 1)
    if len(c) > 2:  # runs are cut to two, so that words of any length look alike
        c = np.r_[c[:2], c[2:][(c[2:] != c[1:-1]) | (c[2:] != c[:-2])]]
    grams = c.astype(np.int32)
    grams = grams[:-2] * CLASSES**2 + grams[1:-1] * CLASSES + grams[2:] if len(c) > 2 else grams[:0]
    counts = np.bincount(grams, minlength=TRIGRAMS)
    terms = np.flatnonzero(counts)
    weights = np.sqrt(counts[terms] / max(len(grams), 1))
    words = data.split()
    n = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    common = Counter(words).most_common(1)[0][1] if words else 0
    pairs = len(set(zip(words, words[1:])))
    ratios = (
        min(np.log2(1 + len(words)) / 14, 1), len(set(words)) / n, sum(map(bytes.__eq__, words, words[1:])) / n, common / n, pairs / max(len(words) - 1, 1),
        len(set(lines)) / max(len(lines), 1), min(len(data) / n / 20, 1), min(4 * shares[2], 1), min(4 * (1 - shares[[0, 1, 2, 4, 5, 6]].sum()), 1), min(4 * shares[3], 1),
    )
    place = np.clip(np.array(ratios) * BANDS, 0, BANDS - 1 - 1e-9)
    low = place.astype(np.int64)
    rest = place - low
    base = TRIGRAMS + BANDS * np.arange(RATIOS)
    bands = np.r_[base + low, base + np.minimum(low + 1, BANDS - 1)]
    return np.r_[terms, bands].astype(np.int32), np.r_[weights, 0.3 * (1 - rest), 0.3 * rest].astype(np.float32)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all texts each term occurs, and the number of texts; at most TERMS sums per task are shuffled."""

    def run(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for t in part.column(0).to_pylist():
                    terms, weights = features(t)
                    total[np.unique(terms[weights > 0])] += 1
                    n += 1
        seen = np.flatnonzero(total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen], pa.int32()), pa.array(np.r_[n, total[seen]], pa.int64())], ["term", "n"])

    sums = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out, total = np.zeros(TERMS), 0
    for term, n in zip(sums["term"], sums["n"]):
        if term < 0:
            total = int(n)
        else:
            out[term] = n
    return out, total


class Quality:
    """A fitted scorer: term weights, the projection, and the labelled vectors with their labels."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, bank: np.ndarray, labels: np.ndarray, neighbours: int, power: float) -> None:
        self.idf, self.basis, self.bank, self.labels = idf, basis, bank, labels
        self.neighbours, self.power = neighbours, power
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def vectors(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.basis.shape[1]), np.float32)
        for i, (terms, weights) in enumerate(rows):
            out[i] = (weights * self.idf[terms]) @ self.basis[terms]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    def vote(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        if not len(self.bank):
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        k = min(self.neighbours, len(self.bank))
        for at in range(0, len(x), block):
            s = x[at : at + block] @ self.bank.T
            near = np.argpartition(s, len(self.bank) - k, axis=1)[:, -k:] if k < len(self.bank) else np.tile(np.arange(k), (len(s), 1))
            w = np.maximum(np.take_along_axis(s, near, 1), 0).astype(float) ** self.power
            out[at : at + block] = ((w * self.labels[near]).sum(axis=1) + 0.1 * self.prior) / (w.sum(axis=1) + 0.1)
        return np.clip(out, 0, 1)

    def score(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
        """Add the score ``out`` (0 to 1) for every whole text, null and empty ones too (they are alike)."""
        shared = docs.sparkSession.sparkContext.broadcast(self)
        return map_texts(docs, text, lambda: lambda texts: {out: pa.array(shared.value.vote(shared.value.vectors([features(t) for t in texts])), pa.float64())}, f"{out} double", keep)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 6_000, dimensions: int = 64, neighbours: int = 16, power: float = 4.0
) -> Quality:
    """``learn``: which ids may be learned from.  ``sample_rows`` bounds the labelled vectors (about 2 MB, which is what is
    broadcast) and the matrix whose singular vectors are taken; document frequencies come from all texts.  Without labels every score is 0.5."""
    chosen = labelled(labels, id_column, label, learn, sample_rows)
    source = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    df, total = document_frequencies(source, "text")
    idf = (np.log((total + 1) / (df + 1)) + 1).astype(np.float32)

    def extract():
        def work(texts: list) -> dict[str, pa.Array]:
            got = [features(t) for t in texts]
            return {"terms": pa.array([g[0] for g in got], pa.list_(pa.int32())), "weights": pa.array([g[1] for g in got], pa.list_(pa.float32()))}

        return work

    picked = source.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "y", "text")
    sample: pd.DataFrame = map_texts(picked, "text", extract, "terms array<int>, weights array<float>", keep=["doc_id", "y"]).orderBy("doc_id").toPandas()
    rows = [(np.asarray(t, np.int64), np.asarray(w, np.float32)) for t, w in zip(sample["terms"], sample["weights"])]
    gram = np.zeros((TERMS, TERMS), np.float32)
    for at in range(0, len(rows), 1024):
        x = np.zeros((len(rows[at : at + 1024]), TERMS), np.float32)
        for i, (t, w) in enumerate(rows[at : at + 1024]):
            np.add.at(x[i], t, w * idf[t])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        gram += x.T @ x
    used = np.flatnonzero(np.diag(gram) > 0)
    basis = np.zeros((TERMS, dimensions), np.float32)
    if len(used):
        values, vectors = np.linalg.eigh(gram[np.ix_(used, used)])
        top = np.argsort(-values)[:dimensions]
        basis[used[:, None], np.arange(len(top))] = vectors[:, top]
    fitted = Quality(idf, basis, np.zeros((0, dimensions), np.float32), sample["y"].to_numpy(float), neighbours, power)
    fitted.bank = fitted.vectors(rows)
    return fitted
