"""Exact Jaccard join of documents by token-combination prefixes.

A document is the set of its distinct word shingles (the tokens).  Two sets link when their intersection is at
least ``share`` = p/q of their union.  All tokens stand in one order: class by class (rare, frequent, very
frequent), by hash within a class.  A set of s tokens can miss at most s - ceil(p*s/q) of its tokens in a linked
set, so if in a prefix of the order the rare tokens, plus those that each frequent part holds beyond k - 1, exceed
that number, then linked sets share a rare token or a combination of k tokens of one part of a frequent class.
Rare tokens are index keys by themselves; frequent ones only in combinations of k = 2, very frequent ones of k = 3,
with the prefix extended as far as that needs.  A class is cut by hash into parts, as many as the size level (power
of two) of the smaller set calls for; a set whose partner may be of the level below is indexed for both.

Candidates share a key and are checked by parities of their tokens and then on their whole sets.  Equal sets are one
node.  A key does not emit all pairs of its nodes: in each round every node meets the key's pivot (the node with the smallest
share of rare tokens, so the middle of a group of edits of one text); nodes that a round has linked with one another
are not compared again, nodes out of reach of all others leave the key (see ``links``), and what the rounds leave is
compared exactly, the nodes outside a key's largest cluster with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from reelscope.llm.common import SALTS, map_texts, matched, slices, staged
from reelscope.llm.simhash import close_pairs, components, fingerprint_texts, named

#: Tokens counted together in a task, and the most frequent tokens the classes hold (4 MB of hashes).
COUNTED, MOST_FREQUENT = 4_000_000, 1 << 19
#: A token is frequent from this many documents on (more if there are too many of them), very frequent from 16 times that.
FREQUENT = 32
#: Sets smaller than this are indexed by single tokens only.
SMALL = 32
#: Keys shared by more nodes than this are dealt over pieces when they are joined.
HOT = 4096
#: Up to this many pairs are sent to the tasks that hold the sets and texts they ask for; beyond it both sides are shuffled.
FEW = 1 << 16
P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xC2B2AE3D27D4EB4F)
SIEVE_BITS = 23
INVERSE = np.uint64(pow(int(P), -1, 1 << 64))
#: A random number per byte (A-Z as a-z), and what parts words.
LETTER = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64)
LETTER[65:91] = LETTER[97:123]
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * P
    h = (h ^ (h >> np.uint64(27))) * Q
    return h ^ (h >> np.uint64(32))


def word_hashes(column: pa.Array, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, one after another, and the number of words of each text.

    A word's hash is the sum of its bytes' numbers times powers of P, from the sums over the whole slice.  ``space``: for
    each byte whether it parts words.
    """
    filled = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    total = int(offsets[-1] - offsets[0])
    data = np.frombuffer(filled.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if total else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~space[data]
    border = np.zeros(total + 1, bool)
    border[offsets] = True
    before = np.r_[False, inside]
    starts = np.flatnonzero(inside & (~before[:-1] | border[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside, False][1:] | border[1:])) + 1
    powers = np.full(total + 1, P)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(LETTER[data] * powers[:-1], out=sums[1:])
    back = np.full(total + 1, INVERSE)
    back[0] = 1
    np.cumprod(back, out=back)
    hashes = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; a text of fewer words is one shingle, none has none.

    A-Z is lower-cased; words are what ASCII white space parts.
    """
    hashes, counts = word_hashes(column)
    starts = np.r_[0, np.cumsum(counts)]

    def run(first: np.ndarray, n: int) -> np.ndarray:
        acc = np.full(len(first), n, np.uint64)
        for j in range(n):
            acc = acc * P + hashes[first + j]
        return mixed(acc)

    whole = run(np.arange(max(0, len(hashes) - words + 1)), words)
    out: list = [None] * len(counts)
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        for i, h in zip(short.tolist(), run(starts[short], n)):
            out[i] = np.array([h], np.uint64)
    for i in np.flatnonzero(counts >= words).tolist():
        found = np.sort(whole[starts[i] : starts[i + 1] - words + 1])
        out[i] = found[np.r_[True, found[1:] != found[:-1]]]
    return [np.zeros(0, np.uint64) if s is None else s for s in out]


def digest(hashes: np.ndarray) -> int:
    """A set's own number, as a signed long."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def needed(size: int, share: tuple[int, int]) -> int:
    """The least number of its tokens that a set of this size shares with any linked set."""
    return -(-share[0] * size // share[1])


class Order:
    """The classes of tokens: sorted hashes of the frequent ones with their class (1 or 2); all others are rare (0)."""

    def __init__(self, tokens: np.ndarray, classes: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens, self.classes = tokens[order], classes[order].astype(np.int8)

    def sieve(self) -> np.ndarray:
        table = np.zeros(1 << SIEVE_BITS, bool)
        table[self.tokens >> np.uint64(64 - SIEVE_BITS)] = True
        return table

    def of(self, hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int8)
        maybe = np.flatnonzero(sieve[hashes >> np.uint64(64 - SIEVE_BITS)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.tokens, hashes[maybe]), len(self.tokens) - 1)
            out[maybe] = np.where(self.tokens[at] == hashes[maybe], self.classes[at], 0)
        return out


def levels(size: int, share: tuple[int, int]) -> range:
    """Size levels (powers of two) of the smaller set of the pairs that a set of this size can be in."""
    return range(needed(size, share).bit_length() - 1, size.bit_length())


def parts_of(level: int, k: int, share: tuple[int, int]) -> int:
    """Into how many parts a class of combinations of ``k`` is cut at a level.

    The more parts, the fewer combinations each holds; but each costs k - 1 tokens, and what the parts of both classes cost
    must leave more tokens than a linked set can lack: 3/8 of the set from a share of 1/2 on, 1/8 below.
    """
    fine = 2 * share[0] >= share[1]
    return max(1, (1 << level) >> (3 if fine else k + 2))


def level_keys(tokens: np.ndarray, classes: np.ndarray, missing: int, level: int, share: tuple[int, int]) -> list[np.ndarray]:
    """Keys of a set at one level: single rare tokens, then combinations in the parts of the frequent classes.

    ``missing``: how many tokens of the set a linked one can lack.  ``tokens`` stand in the order of hashes.  A set with
    any key of a frequent class has all its rare tokens among its keys.
    """
    rare = tokens[classes == 0]
    if len(rare) > missing:
        return [rare[: missing + 1]]
    out, left = [rare], missing + 1 - len(rare)
    for k in (2, 3):
        here = tokens[classes == k - 1]
        if (1 << level) < SMALL:
            out.append(here[:left])
            left -= len(out[-1])
        elif len(here):
            parts = ((here * Q) >> np.uint64(33)) % np.uint64(parts_of(level, k, share))
            by_part = np.argsort(parts, kind="stable")
            first = np.r_[True, np.diff(parts[by_part].astype(np.int64)) != 0]
            rank = np.empty(len(here), np.int64)
            rank[by_part] = np.arange(len(here)) - np.maximum.accumulate(np.where(first, np.arange(len(here)), 0))
            gain = np.cumsum(rank >= k - 1)
            end = int(np.searchsorted(gain, left)) + 1 if gain[-1] >= left else len(here)
            kept = by_part[by_part < end]
            sets = [c for _, g in groupby(zip(parts[kept].tolist(), here[kept].tolist()), key=lambda pt: pt[0]) for c in combinations([t for _, t in g], k)]
            if sets:
                acc = np.full(len(sets), k, np.uint64)
                for column in np.array(sets, np.uint64).T:
                    acc = acc * P + column
                out.append(mixed(acc))
            left -= int(gain[end - 1])
        if left <= 0:
            break
    return out


def prefix_keys(tokens: np.ndarray, classes: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The index keys of a set, distinct: its rare tokens, and those of the frequent classes."""
    if not len(tokens):
        return tokens, tokens
    missing = len(tokens) - needed(len(tokens), share)
    found = [level_keys(tokens, classes, missing, level, share) for level in levels(len(tokens), share)]
    frequent = [k for keys in found for k in keys[1:]]
    return found[0][0], np.unique(np.concatenate(frequent)) if frequent else tokens[:0]


def frequent_tokens(source: DataFrame, words: int, frequent: int = FREQUENT, most: int = MOST_FREQUENT) -> Order:
    """The classes, from counts over all texts.

    Tasks count the tokens of some millions at a time and pass on those that repeat there, so a token in more sets
    than there are such portions is always seen.  The classes place tokens in the order; results do not depend on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], ["token", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for s in shingle_sets(part.column(0), words):
                    if len(s) and (name := digest(s)) not in seen:
                        seen.add(name)
                        held.append(s)
                        n += len(s)
                if n >= COUNTED:
                    yield counted()
                    held, n, seen = [], 0, set()
        if held:
            yield counted()

    counts = source.select("text").mapInArrow(run, "token bigint, n bigint")
    counts = staged(counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent), "jaccard-frequent")
    least = frequent
    steps = counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"))
    held = 0
    for row in sorted(steps.collect(), key=lambda r: -r.step):  # at most some 200 steps
        held += row.c
        if held > most:
            break
        least = row.least
    else:
        least = frequent
    rows = counts.where(F.col("n") >= least).select("token", (F.col("n") >= 16 * least).alias("very")).toPandas()
    return Order(rows["token"].to_numpy(np.int64).view(np.uint64), 1 + rows["very"].to_numpy(bool))


def parities(tokens: np.ndarray, size: int) -> np.ndarray:
    """For each of at least 2 * size places whether an odd number of tokens falls there, in longs.

    Sets whose parities differ in d places differ in d tokens at least.  The longs are a power of two, and the place is
    the token's hash modulo their bits, so parities of fewer places are those of more, folded.
    """
    bits = 64 * max(4, 1 << max(0, (size - 1) // 32).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def keyed(words: int, share: tuple[int, int], order, prints: bool = False):
    """Task-side function: texts to the digests, sizes, numbers of rare tokens, parities and index keys of their sets (and SimHash fingerprints)."""

    def make():
        known = order.value
        sieve = known.sieve()
        printed = fingerprint_texts(words) if prints else None

        def work(column: pa.Array) -> dict[str, pa.Array]:
            sets = shingle_sets(column, words)
            classes = np.split(known.of(np.concatenate(sets), sieve), np.cumsum([len(s) for s in sets])[:-1])
            keys = [prefix_keys(t, c, share) for t, c in zip(sets, classes)]
            longs = lambda arrays: pa.array([a.view(np.int64) for a in arrays], pa.list_(pa.int64()))
            return {
                "fp": pa.array([digest(s) for s in sets], pa.int64()), "size": pa.array([len(s) for s in sets], pa.int64()),
                "rare": pa.array([int((c == 0).sum()) for c in classes], pa.int64()),
                "odd": longs([parities(s, len(s)) for s in sets]), "odd_frequent": longs([parities(s[c > 0], len(s)) for s, c in zip(sets, classes)]),
                "rare_keys": longs([a for a, _ in keys]), "frequent_keys": longs([b for _, b in keys]),
                **({"print": printed(column.to_pylist())["fp"]} if prints else {}),
            }

        return work

    return make


def sets_of(words: int):
    """Task-side function: texts to the digests of their sets and the sets."""

    def work(column: pa.Array) -> dict[str, pa.Array]:
        sets = shingle_sets(column, words)
        return {"fp": pa.array([digest(s) for s in sets], pa.int64()), "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}

    return work


def order_of(fp: str, rare: str, size: str) -> Column:
    """Nodes from the middle of their groups outwards: by the share of rare tokens, then by hash."""
    return F.struct((F.col(rare) / F.greatest(F.lit(1), F.col(size))).alias("share"), F.xxhash64(fp).alias("hash"), F.col(fp).alias("fp"))


def dealt(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows (with fp) and ``table`` (with n, how many rows a key has) on key.

    The rows of a key of more than HOT go to SALTS pieces by their hash and meet a copy of what the table says
    about it.  Such keys are fewer than all rows by a factor of HOT.
    """
    hot = table.where(F.col("n") > HOT).select("key").distinct().withColumn("_hot", F.lit(True))
    rows = rows.join(F.broadcast(hot), "key", "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.lit("deal"), "fp"), F.lit(SALTS)).cast("int")).otherwise(-1)).drop("_hot")
    pieces = F.when(F.col("n") > HOT, F.array(*[F.lit(i) for i in range(SALTS)])).otherwise(F.array(F.lit(-1)))
    return rows.join(table.withColumn("_salt", F.explode(pieces)).drop("n"), ["key", "_salt"], how).drop("_salt")


def salted(name: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), F.col(name)), F.lit(SALTS)).cast("int")


def folded(odd: Column, longs: Column) -> Column:
    """Parities of ``longs`` longs from those of as many or more."""
    xor = lambda acc, x: acc.bitwiseXOR(x)
    one = lambda i: F.aggregate(F.transform(F.sequence(F.lit(0), F.floor(F.size(odd) / longs).cast("int") - 1), lambda j: F.get(odd, i + j * longs)), F.lit(0).cast("bigint"), xor)
    return F.when(F.size(odd) == longs, odd).otherwise(F.transform(F.sequence(F.lit(0), longs - 1), one))


def differing(a: Column, b: Column) -> Column:
    """In how many places two parities differ, taken to the fewer places of both."""
    longs = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(folded(a, longs), folded(b, longs), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d).cast("bigint")


def may_differ(differ: Column, total: Column, share: tuple[int, int]) -> Column:
    """Whether sets of ``total`` tokens together that differ in ``differ`` tokens can be linked."""
    p, q = share
    return differ * (p + q) <= (q - p) * total


def by_number(rows: int):
    """How a table of so many rows is best joined with a larger one: it is sent to where the other's rows are if it has at most FEW."""
    return F.broadcast if rows <= FEW else lambda df: df


def compared(pairs: DataFrame, nodes: DataFrame, sent=by_number(FEW + 1)) -> DataFrame:
    """``pairs`` (u, v, ...) with ``apart`` and ``apart_frequent``: tokens, and frequent tokens, they differ in at least, and ``total``, their tokens."""
    of = lambda name: nodes.select(F.col("fp").alias(name), F.struct("size", "odd", "odd_frequent").alias(f"_{name}"))
    pairs = pairs.withColumn("_salt", salted("u"))
    pieces = matched(of("v"), sent(pairs.select("v", "_salt").distinct()), ["v"])
    met = matched(matched(of("u"), sent(pairs), ["u"]), pieces, ["v", "_salt"])
    return met.select(
        *[c for c in pairs.columns if c != "_salt"], (F.col("_u.size") + F.col("_v.size")).alias("total"),
        differing(F.col("_u.odd"), F.col("_v.odd")).alias("apart"), differing(F.col("_u.odd_frequent"), F.col("_v.odd_frequent")).alias("apart_frequent"),
    )


def verified(pairs: DataFrame, sets_for, share: tuple[int, int]) -> DataFrame:
    """Of the pairs (u, v), the links, by their whole sets.

    ``sets_for``: from a table of nodes (fp), and how it is best joined, to their sets (fp, tokens).  A set that many pairs ask for
    is dealt over pieces.
    """
    p, q = share
    pairs = staged(pairs.select("u", "v").distinct().withColumn("_salt", salted("u")), "jaccard-hopeful")
    sent = by_number(pairs.count())
    ends = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    sets = staged(sets_for(ends, sent), "jaccard-sets")
    pieces = matched(sets.select(F.col("fp").alias("v"), F.col("tokens").alias("b")), sent(pairs.select("v", "_salt").distinct()), ["v"])
    left = matched(sets.select(F.col("fp").alias("u"), F.col("tokens").alias("a")), sent(pairs), ["u"])
    both = matched(left, pieces, ["v", "_salt"])
    shared = F.size(F.array_intersect("a", "b")).cast("bigint")
    return both.where(shared * (p + q) >= F.lit(p) * (F.size("a") + F.size("b"))).select("u", "v")


def labelled(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, label) of linked nodes: two steps towards the first node in order.  Nodes of one label are in one component."""
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    steps = links.select(F.inline(F.array(pair("u", "v"), pair("v", "u"), pair("u", "u"), pair("v", "v"))))
    ranks = nodes.select(F.col("fp").alias("v"), order_of("fp", "rare", "size").alias("rank"))
    step = matched(ranks, by_number(4 * links.count())(steps), ["v"]).groupBy("u").agg(F.min("rank").alias("m")).select(F.col("u").alias("fp"), F.col("m.fp").alias("label"))
    step = staged(step, "jaccard-step")
    return staged(matched(step.withColumnRenamed("label", "_l"), step.select(F.col("fp").alias("_l"), "label"), ["_l"]).select("fp", "label"), "jaccard-labels")


def left_over(live: DataFrame, tops: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) that the rounds leave: of each key the nodes outside its largest cluster with all others in reach.

    With r rare tokens and distance d to the pivot, nodes x and y of a frequent key are in reach if
    r_x + r_y + |d_x - d_y| is small enough, so d_y - r_y has a lower bound from x; rows meet on slices of it.
    """
    p, q = share
    close = lambda a, b: F.least(a, b) * q >= F.greatest(a, b) * p
    reach = live.groupBy("key").agg(F.max(F.col("away") - F.col("rare")).alias("nearest"), F.max("size").alias("largest"))
    rows = staged(dealt(live, matched(tops.select("key", "n", "top"), reach, ["key"])), "jaccard-left")
    wide = F.greatest(F.lit(4), F.floor(F.col("largest") * (q - p) / (4 * (p + q)))).cast("bigint")
    lowest = F.col("away") + F.col("rare") - F.floor((F.col("size") + F.col("largest")) * (q - p) / (p + q))
    slice_of = lambda value: F.floor(value / wide).cast("bigint")
    slices_met = F.sequence(slice_of(lowest), F.greatest(slice_of(lowest), slice_of(F.col("nearest"))))
    sliced = lambda s: F.xxhash64("key", s)
    all_rows = rows.withColumn("key", F.when(F.col("frequent"), sliced(slice_of(F.col("away") - F.col("rare")))).otherwise(F.col("key")))
    outside = rows.where(F.col("label") != F.col("top"))
    outside = outside.withColumn("key", F.explode(F.when(F.col("frequent"), F.transform(slices_met, sliced)).otherwise(F.array("key"))))
    outside = outside.select("key", F.struct("fp", "size", "label", "rare", "away").alias("o"))
    sizes = staged(all_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "jaccard-slices")
    met = dealt(all_rows.select(live.columns), matched(outside, sizes, ["key"]))
    apart = F.col("rare") + F.col("o.rare") + F.abs(F.col("away") - F.col("o.away"))
    wanted = met.where((F.col("label") != F.col("o.label")) & close(F.col("size"), F.col("o.size")) & (~F.col("frequent") | may_differ(apart, F.col("size") + F.col("o.size"), share)))
    return wanted.select(F.least("fp", "o.fp").alias("u"), F.greatest("fp", "o.fp").alias("v")).distinct()


def links(index: DataFrame, nodes: DataFrame, sets_for, share: tuple[int, int], rounds: int = 8, hints: DataFrame | None = None) -> DataFrame:
    """Links (u, v) that span the components of the join; all of them verified.

    ``hints``: pairs (u, v) that are compared first; nodes that they link begin the rounds in one cluster.

    ``index``: (key, frequent, fp); ``nodes``: (fp, size, rare, odd, odd_frequent).  Keys of the same nodes
    are one.  Sets that share no rare token differ in the rare tokens of both, and in their frequent ones at least
    by as much as their distances to the pivot differ (parities obey the triangle inequality).  Pairs that do share one meet on
    a rare key, so a node whom this puts out of reach of all others leaves a frequent key.  Rounds end when what is left to
    compare is in proportion to the index, or where a round did not lessen it by a quarter.
    """
    p, q = share
    close = lambda a, b: F.least(a, b) * q >= F.greatest(a, b) * p
    sizes = staged(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-keys")
    shared = staged(dealt(index, sizes), "jaccard-shared")
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y")]
    kept = shared.groupBy("key").agg(F.min("frequent").alias("frequent"), *marks).groupBy("n", "x", "y", "frequent").agg(F.min("key").alias("key"))
    kept = staged(kept.groupBy("key").agg(F.max("n").alias("n")), "jaccard-distinct-keys")
    found = before = None
    known = nodes.select("fp", "size", "rare", F.col("fp").alias("label"))
    if hints is not None:
        hopeful = compared(hints, nodes).where(may_differ(F.col("apart"), F.col("total"), share))
        found = staged(verified(hopeful, sets_for, share), "jaccard-links")
        known = nodes.select("fp", "size", "rare").join(labelled(found, nodes), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    live = matched(dealt(shared, kept), known, ["fp"])
    live = live.select("key", "frequent", "fp", "size", "rare", "label", F.lit(False).alias("met"), F.lit(0).cast("bigint").alias("away"))
    live = staged(live, "jaccard-live")
    linear = 2 * live.count()
    while True:
        counts = live.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        tops = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("most"), F.count(F.lit(1)).alias("labels"))
        tops = staged(tops.where("labels > 1"), "jaccard-open")
        work = tops.agg(F.sum(F.col("n") * (F.col("n") - F.col("most"))).alias("w"), F.max("n").alias("n")).first()
        if not work.n:
            break
        first = before is None
        last = not first and (rounds <= 0 or work.w <= linear or work.w > 0.75 * before)
        rounds, before = rounds - 1, work.w
        if last:
            rest = staged(left_over(live, tops, share), "jaccard-rest-pairs")
            hopeful = compared(rest, nodes, by_number(rest.count())).where(may_differ(F.col("apart"), F.col("total"), share))
            more = staged(verified(hopeful, sets_for, share), "jaccard-links")
            found = more if found is None else found.unionByName(more)
            break
        pivots = live.groupBy("key").agg(F.min(F.struct("met", order_of("fp", "rare", "size").alias("rank"), "size", "label")).alias("p"))
        table = matched(pivots, tops.select("key", "n"), ["key"]).select("key", "n", F.struct(F.col("p.rank.fp").alias("fp"), "p.size", "p.label").alias("o"))
        met = staged(dealt(live, table).where(F.col("fp") != F.col("o.fp")), "jaccard-met")
        wanted = (F.col("label") != F.col("o.label")) & close(F.col("size"), F.col("o.size"))
        pairs = met.select(F.col("fp").alias("u"), F.col("o.fp").alias("v"), wanted.alias("wanted")).distinct()
        pairs = staged(compared(pairs, nodes, by_number(met.count())), "jaccard-pairs")
        more = staged(verified(pairs.where(F.col("wanted") & may_differ(F.col("apart"), F.col("total"), share)), sets_for, share), "jaccard-links")
        found = more if found is None else found.unionByName(more)
        labels = labelled(found, nodes)
        of = lambda name: labels.select(F.col("fp").alias(name), F.col("label").alias(f"_{name}"))
        rest = matched(met.withColumn("_o", F.col("o.fp")).drop("o", "label", "away"), pairs.select(F.col("u").alias("fp"), F.col("v").alias("_o"), F.col("apart_frequent").alias("away")), ["fp", "_o"])
        rest = rest.join(of("fp"), "fp", "left").withColumn("label", F.coalesce("_fp", "fp")).drop("_fp")
        rest = rest.join(of("_o"), "_o", "left").withColumn("met", F.col("met") | (F.col("label") == F.coalesce("__o", "_o")))
        if first:  # the frequent keys of one pivot are one from now on: a node is there once, with its distance to it
            grouped = rest.where("frequent").withColumn("key", F.xxhash64(F.lit("pivot"), "_o")).dropDuplicates(["key", "fp"])
            rest = rest.where("NOT frequent").unionByName(grouped)
        rest = staged(rest.drop("_o", "__o"), "jaccard-rest")
        reach = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("away") - F.col("rare")).alias("nearest"), F.max("size").alias("largest"))
        rest = dealt(rest, staged(reach, "jaccard-reach"))
        stays = ~F.col("frequent") | may_differ(F.col("rare") + F.col("away") - F.col("nearest"), F.col("size") + F.col("largest"), share)
        live = staged(rest.where(stays).select(live.columns), "jaccard-live")
    return found.distinct() if found is not None else index.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)


def near_copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4, share: tuple[int, int] = (85, 100), empty_alike: bool = False,
    frequent: int = FREQUENT, most: int = MOST_FREQUENT, simhash_first: bool = False,
) -> DataFrame:
    """(id, fp, n_shingles, component): one row per row of ``docs``; component is the smallest id reachable over links.

    Whole texts count.  A text without words (null, empty, only white space) has no shingles and is linked with nothing,
    or with the others of its kind if ``empty_alike``.  Repeated rows stay and are linked (empty ones with the same id
    have the same component either way); a null id keeps its row and names a component only where there is no other
    id.  Extra columns are not read.  An empty table gives an empty result.

    ``simhash_first``: texts whose SimHash fingerprints agree on two of four blocks and are within two bits are compared
    first; what they link is a cluster when the rounds begin.  The result is the same.
    """
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    order = source.sparkSession.sparkContext.broadcast(frequent_tokens(source, words, frequent, most))
    lists = ("odd", "odd_frequent", "rare_keys", "frequent_keys")
    added = "fp bigint, size bigint, rare bigint, " + ", ".join(f"{c} array<bigint>" for c in lists) + (", print bigint" if simhash_first else "")
    prints = map_texts(source, "text", keyed(words, share, order, simhash_first), added, keep=["id"], arrow=True)
    prints = staged(prints.withColumn("_salt", salted("id")), "jaccard-prints")
    firsts = [F.first(c).alias(c) for c in ("size", "rare", *lists, *["print"] * simhash_first)]
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("least"), *firsts), "jaccard-nodes")
    keys = lambda name, frequent: nodes.select(F.explode(name).alias("key"), F.lit(frequent).alias("frequent"), "fp")
    index = keys("rare_keys", False).unionByName(keys("frequent_keys", True))

    def sets_for(wanted: DataFrame, sent=lambda df: df) -> DataFrame:
        ids = matched(nodes.select("fp", "least"), sent(wanted), ["fp"], "left_semi").select(F.col("least").alias("id"))
        texts = matched(source, sent(ids), ["id"], "left_semi")
        sets = map_texts(texts, "text", lambda: sets_of(words), "fp bigint, tokens array<bigint>", keep=[], arrow=True)
        return matched(sets, sent(wanted), ["fp"], "left_semi").dropDuplicates(["fp"])

    hints = close_pairs(nodes.select(F.col("fp").alias("id"), F.col("print").alias("fp"))) if simhash_first else None
    found = links(index, nodes.select("fp", "size", "rare", "odd", "odd_frequent"), sets_for, share, hints=hints)
    out = named(prints, nodes, components(found), ["size"])
    component = F.col("component") if empty_alike else F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select("id", "fp", F.col("size").alias("n_shingles"), component.alias("component"))
