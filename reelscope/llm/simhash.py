"""Near copies by SimHash: fingerprints, pigeonhole blocks, Hamming verification, connected components.

Fingerprints of 64 bits are cut into four blocks of 16.  Two fingerprints that differ in at most two
bits agree on at least two of the four blocks, so a join on the six pairs of blocks (32-bit keys) meets
every close pair; the join's pairs are verified by their Hamming distance.  Equal fingerprints are one
node, so copies cost nothing.  A key shared by more than ``crowd`` different fingerprints is not
joined with itself: its members go through points at distance one instead (see ``crowded_links``),
which is linear and loses no link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelscope.llm.common import map_texts, matched, per_group, salt, staged

BLOCKS = 4
BITS = 64 // BLOCKS


def fingerprint_texts(words: int):
    """Task-side function: texts to signed 64-bit fingerprints."""
    import xxhash

    digest = xxhash.xxh64_intdigest

    def one(text: str | None) -> int:
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not tokens:
            return 0
        if len(tokens) <= words:
            hashes = np.array([digest(b" ".join(tokens), 42)], dtype=np.uint64)
        else:
            joined = b" ".join(tokens)
            ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
            starts = np.r_[0, ends[:-1]].tolist()
            stops = (ends - 1).tolist()
            hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops[words - 1 :])), np.uint64, len(tokens) - words + 1)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])

    return lambda texts: {"fp": pa.array([one(t) for t in texts], pa.int64())}


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text, as a signed long.

    A-Z is lower-cased, words are what ASCII white space separates, shingles are ``words`` words with
    repeats (a shorter text: all its words).  Null and empty texts have fingerprint 0.
    """
    return map_texts(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", lambda: fingerprint_texts(words), "fp bigint", keep=["id"])


def block_keys(fp: Column) -> Column:
    """The six pairs of blocks, each with the number of its pair in the high bits."""
    block = lambda i: F.shiftrightunsigned(fp, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))
    pairs = [
        F.shiftleft(block(a), BITS).bitwiseOR(block(b)).bitwiseOR(F.lit(n << (2 * BITS)).cast("bigint"))
        for n, (a, b) in enumerate(combinations(range(BLOCKS), 2))
    ]
    return F.explode(F.array(*pairs))


def links(nodes: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """Edges (u, v), u > v, that join exactly the fingerprints within ``distance`` (at most 2) bits of each other.

    ``nodes``: distinct fingerprints (fp).  Between the members of a crowded key the edges are a spanning
    set of the links there, not all of them.
    """
    if distance != 2:
        raise ValueError("four blocks and midpoints are laid out for two bits")
    keys = staged(nodes.select("fp", block_keys(F.col("fp")).alias("key")), "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    small = matched(keys, sizes.where(F.col("n") <= crowd).select("key"), ["key"], "left_semi")
    left, right = small.alias("l"), small.alias("r")
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") > F.col("r.fp")))
    near = pairs.where(F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance).select(F.col("l.fp").alias("u"), F.col("r.fp").alias("v"))
    big = matched(keys, sizes.where(F.col("n") > crowd).select("key"), ["key"], "left_semi")
    return near.unionByName(crowded_links(big.select("fp").distinct())).distinct()


def crowded_links(fps: DataFrame) -> DataFrame:
    """Links of fingerprints within two bits, through the 65 points at distance at most one.

    Two fingerprints are within two bits of each other exactly if some point is within one bit of both.
    A point has at most 65 fingerprints around it, so nothing grows with the square of a crowd.
    """
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)).cast("bigint") for i in range(64)])
    around = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = around.groupBy("point").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("us")).where(F.size("us") > 1)
    return met.select(F.explode("us").alias("u"), "v").where("u > v").distinct()


def close_pairs(prints: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """Pairs (u, v) of ids that join the rows of ``prints`` (id, fp) whose fingerprints are within ``distance`` bits of each other.

    Rows of one fingerprint are paired with that of the smallest id only, fingerprints as ``links`` joins them.
    """
    least = F.min("id").alias("least")
    nodes = staged(prints.groupBy("fp").agg(least), "simhash-nodes")
    of = lambda name: nodes.select(F.col("fp").alias(f"_{name}"), F.col("least").alias(name))
    edges = links(nodes.select("fp"), distance, crowd).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    near = matched(matched(edges, of("u"), ["_u"]), of("v"), ["_v"]).select("u", "v")
    same = per_group(prints, ["fp"], ["id"], [least]).where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    return near.unionByName(same)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating large and small stars.

    Each round hangs neighbours under smaller ones; the number of rounds grows with the logarithm of the
    longest chain.  A round's edges are kept as files; only their count and checksum reach the driver.
    """
    stamp = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    edges = staged(edges.select("u", "v"), "simhash-edges")
    before = stamp(edges)
    for _ in range(most):
        both = edges.select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.inline(F.array(pair("v", "m"), pair("u", "m")))).where("u <> v")
        edges = staged(small.distinct(), "simhash-edges")
        after = stamp(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, crowd: int = 64) -> DataFrame:
    """(id, fp, component): one row per row of ``docs``; component is the smallest id reachable over links.

    Null ids keep their row and never name a component unless it holds nothing else (then null).  Repeated
    rows stay.  An empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, id_column, text, words).withColumn("_salt", salt("id")), "simhash-prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    return named(prints, nodes, components(links(nodes.select("fp"), distance, crowd)))


def named(prints: DataFrame, nodes: DataFrame, roots: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """(id, fp, component) and the columns ``kept`` of the rows of ``prints`` (id, fp, _salt), given the least id of each node and the nodes' roots."""
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = staged(rooted.join(least, "root").select("fp", "component"), "simhash-labels")
    pieces = prints.select("fp", "_salt").distinct().join(labels, "fp")
    return prints.join(pieces, ["fp", "_salt"]).select("id", "fp", "component", *kept or [])


def representatives(docs: DataFrame, id_column: str = "doc_id", text: str = "text", find=near_copies, **options) -> DataFrame:
    """The rows of ``docs`` without near copies (of those that ``find`` names): of each component one row stays, that with the smallest id
    (of repeated ids that with the smallest text hash; of wholly equal ones any).  All columns pass."""
    keyed = docs.withColumn("_key", F.struct(F.col(f"`{id_column}`").isNull().alias("missing"), F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash")))
    found = find(keyed.select("_key", F.col(f"`{text}`")), "_key", text, **options)
    kept = found.select(F.col("component").alias("_key")).distinct()
    flat = lambda df: df.select(*[c for c in df.columns if c != "_key"], F.col("_key.id").alias("_id"), F.col("_key.hash").alias("_hash"))
    out = matched(flat(keyed), flat(kept), ["_id", "_hash"], "left_semi")
    return out.dropDuplicates(["_id", "_hash"]).drop("_id", "_hash")
