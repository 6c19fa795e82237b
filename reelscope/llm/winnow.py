"""Benchmark decontamination by winnowing.

Words are hashed in k-grams, and of every ``window`` consecutive k-gram hashes the smallest is kept as a
fingerprint.  A shared span of k + window - 1 words holds one whole window, in which both sides choose the
same k-gram, so documents and items that share it meet in the join of fingerprints.  Each met k-gram is
then extended word by word to both sides; runs of full length are hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelscope.llm.common import map_texts, matched, salt, staged, SALTS

#: Fixed value: what counts as a word once A-Z is lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bits of the sieve that is sent to the tasks: 2 MB, whatever the size of the benchmark.
SIEVE_BITS = 24
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; lower() of bytes changes A-Z alone, and no byte of a longer character is in the excluded set."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def word_hashes(words: list[bytes], seen: dict) -> np.ndarray:
    """A 64-bit hash per word; ``seen`` remembers those of earlier texts and is emptied when it grows large."""
    import xxhash

    if len(seen) > 400_000:
        seen.clear()
    try:
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash per k consecutive words (none if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the smallest hash (of equals the last) of some window of consecutive hashes; of a
    text with fewer hashes than a window, none: it holds no span of full length."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    if window == 1:
        return np.arange(len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def lanes(items: DataFrame, text: str, span: int, k: int) -> list[tuple[int, int, int]]:
    """(length of a run that hits, k, window) for whole items and for each shorter length that occurs (at most span - 1)."""
    sizes = map_texts(items.select(text), text, lambda: lambda ts: {"n": pa.array([min(len(words_of(t)), span) for t in ts], pa.int32())}, "n int", keep=[])
    short = sorted(r.n for r in sizes.where(f"n between 1 and {span - 1}").distinct().collect())
    return [(span, k, span - k + 1), *((n, n, 1) for n in short)]


def print_maker(lane_list: list, span: int, whole_items: bool, sieve: np.ndarray | None):
    """Task-side function: texts to word counts and fingerprints with the words around them.

    A fingerprint: (lane, hash, first: position of the first carried word, at: of the k-gram, words carried).
    Items take only the lane of their own length; documents take every lane, sifted.
    """
    kind = pa.list_(pa.struct([("lane", pa.int32()), ("hash", pa.int64()), ("first", pa.int32()), ("at", pa.int32()), ("words", pa.list_(pa.string()))]))

    def work(texts: list) -> dict[str, pa.Array]:
        counts, prints = [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            found = []
            hashes = word_hashes(words, seen)
            for run, k, window in lane_list:
                if whole_items and (run != min(len(words), span)):
                    continue
                grams = gram_hashes(hashes, k)
                if sieve is not None:
                    at = winnowed(grams, window)
                    slot = grams[at] >> np.uint64(64 - SIEVE_BITS)
                    at = at[(sieve[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                else:
                    at = winnowed(grams, window)
                reach = run - k
                for p in at.tolist():
                    first = max(0, p - reach)
                    found.append({"lane": run, "hash": int(grams[p].astype(np.int64)), "first": first, "at": p, "words": [w.decode("utf-8", "replace") for w in words[first : p + k + reach]]})
            prints.append(found)
        return {"n_words": pa.array(counts, pa.int64()), "prints": pa.array(prints, kind)}

    seen: dict = {}
    return work


PRINTS = "n_words bigint, prints array<struct<lane:int,hash:bigint,first:int,at:int,words:array<string>>>"


def sieve_of(prints: DataFrame) -> np.ndarray:
    """A bit set over the high bits of all benchmark fingerprints; at most 2 ** SIEVE_BITS slots reach the driver."""
    slots = prints.select(F.shiftrightunsigned("hash", 64 - SIEVE_BITS).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)
    bits = np.zeros(1 << SIEVE_BITS, np.uint8)
    bits[slots] = 1
    return np.packbits(bits, bitorder="little")


def extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Grow each met k-gram to both sides while the words agree; keep runs of full length.

    The carried words reach as far as any run of full length around the k-gram does, so all such runs are found.
    """
    for pdf in batches:
        start, stop = np.full(len(pdf), -1), np.full(len(pdf), -1)
        for i, (run, k, a, b, p, q, base) in enumerate(zip(pdf["lane"], pdf["k"], pdf["words"], pdf["item_words"], pdf["at"] - pdf["first"], pdf["item_at"] - pdf["item_first"], pdf["first"])):
            if list(a[p : p + k]) != list(b[q : q + k]):
                continue
            lo, hi = 0, k
            while lo < min(p, q) and a[p - lo - 1] == b[q - lo - 1]:
                lo += 1
            while p + hi < len(a) and q + hi < len(b) and a[p + hi] == b[q + hi]:
                hi += 1
            if lo + hi >= run:
                start[i], stop[i] = base + p - lo, base + p + hi
        out = pd.DataFrame({"id": pdf["id"], "hash_of_text": pdf["hash_of_text"], "item_id": pdf["item_id"], "start": start, "stop": stop})
        yield out[start >= 0]


def overlaps(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(sizes, spans).  sizes: id, hash_of_text, n_words for every document; spans: id, hash_of_text, item_id, start, stop:
    runs of at least ``span`` words shared with an item (an item with fewer words, but not none: all its words).

    Spans may overlap; together they cover all words inside an occurring window.  Rows are told apart by id
    and text, so repeated ids are separate documents and wholly equal rows share their result.  Null texts have
    no words.  Fingerprints that occur in both are joined on (lane, hash, piece): a passage that a third of
    all documents holds is dealt over pieces.
    """
    lane_list = lanes(items.select(F.col(f"`{item_text}`").alias("text")), "text", span, k)
    item_rows = map_texts(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")), "text", lambda: print_maker(lane_list, span, True, None), PRINTS, keep=["item_id"])
    flat = lambda df, *keep: df.select(*keep, F.explode("prints").alias("p")).select(*keep, "p.*")
    item_prints = staged(flat(item_rows, "item_id").dropDuplicates(["item_id", "lane", "hash", "words", "at"]), "winnow-items")
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(item_prints))
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash_of_text"), F.col(f"`{text}`").alias("text"))
    doc_rows = staged(map_texts(source, "text", lambda: print_maker(lane_list, span, False, sieve.value), PRINTS, keep=["id", "hash_of_text"]), "winnow-docs")
    met = flat(doc_rows.where(F.size("prints") > 0), "id", "hash_of_text").withColumn("_salt", salt("id", "hash_of_text", "at"))
    theirs = item_prints.select("lane", "hash", "item_id", F.col("first").alias("item_first"), F.col("at").alias("item_at"), F.col("words").alias("item_words"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    width = F.when(F.col("lane") < span, F.col("lane")).otherwise(F.lit(k))
    pairs = met.join(theirs, ["lane", "hash", "_salt"]).withColumn("k", width)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    spans = pairs.mapInPandas(extended, f"id {kinds['id']}, hash_of_text bigint, item_id {kinds['item_id']}, start int, stop int")
    return doc_rows.select("id", "hash_of_text", "n_words"), spans.distinct()


def covered(spans: str) -> "F.Column":
    """Number of positions in the union of an array of (start, stop)."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["to"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(acc["to"], s["stop"]).alias("to")
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])


def report(sizes: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: id, hash_of_text, n_words, n_hit, items (the sorted ids, as strings)."""
    hits = spans.groupBy("id", "hash_of_text").agg(
        covered(F.collect_set(F.struct("start", "stop"))).alias("n_hit"),
        F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"),
    )
    out = matched(sizes, hits, ["id", "hash_of_text"], "left")
    none = F.array().cast("array<string>")
    return out.select("id", "hash_of_text", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that share no span with an item; all columns pass."""
    _, spans = overlaps(docs, items, id_column, text, **options)
    bad = staged(spans.select(F.col("id").alias("_id"), F.col("hash_of_text").alias("_hash")).distinct(), "winnow-bad")
    keyed = docs.withColumn("_id", F.col(f"`{id_column}`")).withColumn("_hash", F.xxhash64(F.col(f"`{text}`")))
    return matched(keyed, bad, ["_id", "_hash"], "left_anti").drop("_id", "_hash")
