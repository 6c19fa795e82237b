"""Toxicity by weak supervision.

Lexicon and pattern voters look at every training text; a generative model with a latent class estimates
each voter's rates per class and which voters depend on each other, from the counts of vote patterns alone.
Its posteriors label a sample, on which a sparse linear classifier over words is trained.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelscope.llm.common import hash_share, map_texts, staged

#: Seed lexicons, one voter each.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile imbeciles cretin halfwit dimwit brainless fool fools retard retarded",
    "contempt": "pathetic loser losers clown clowns joke laughable ridiculous coward cowards spineless freak freaks creep creeps",
    "worth": "worthless useless trash garbage scum filth filthy vermin rubbish parasite parasites lowlife",
    "disgust": "disgusting revolting repulsive vile sickening hideous ugly gross",
    "profane": "damn crap bastard bastards bitch bitches asshole assholes shit bullshit fuck fucking fucked dick prick slut whore cunt",
    "threat": "kill murder die strangle slaughter exterminate hang rot",
    "foreign": "idiota estúpido estúpida imbécil basura inútil asqueroso mierda puta dummkopf blödmann arschloch scheiße abschaum ekelhaft nutzlos dumm "
    "connard connasse salope merde débile crétin ordure dégoûtant minable stupide",
}
WORD_SETS = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
INSULTS = frozenset().union(*(WORD_SETS[n] for n in ("mind", "contempt", "worth", "disgust", "profane", "foreign")))
#: Look-alikes undone by the spelling voter.
LOOKALIKES = str.maketrans("0134578@$!*", "oieastbasii")
ADDRESSED = re.compile(r"\b(?:you|your|you're|u|du|dich|tu|te|toi|usted|vous|ihr)\b(?:\W+\w+){0,3}?\W+(\w+)", re.IGNORECASE)
SHOUTED = re.compile(r"[^\W\d_a-z]{3,}!{2,}")
STATIC = (*WORD_SETS, "spelling", "addressed", "shouting")
MINED = 6
VOTERS = len(STATIC) + MINED
#: Patterns of votes are one integer; with 16 voters there are at most 65,536, whatever the number of texts.
assert VOTERS <= 16
INNER = re.compile(r"[^\W\d_]+")


def distinct_words(text: str | None) -> set[str]:
    """Lower-cased runs of letters."""
    out: set[str] = set()
    for token in set(text.lower().split()) if text else ():
        if token.isalpha():
            out.add(token)
        else:
            out.update(INNER.findall(token))
    return out


#: Word beginnings of these lengths, with at least these numbers of different words, are signs of their own ("abcd*2").
ROOT_SIZES, ROOT_COUNTS = (4, 5, 6, 7), (2, 3, 5)


def all_signs(words: set[str]) -> set[str]:
    """The words, and the beginnings that several of them share."""
    out = set(words)
    for size in ROOT_SIZES:
        shared = Counter([w[:size] for w in words if len(w) > size])
        out.update(f"{root}*{least}" for root, n in shared.items() if n > 1 for least in ROOT_COUNTS if n >= least)
    return out


class Known:
    """Picks a fixed set of signs out of texts."""

    def __init__(self, signs) -> None:
        self.words = frozenset(s for s in signs if "*" not in s)
        self.roots: dict[str, list[int]] = {}
        for s in signs:
            root, star, least = s.partition("*")
            if star:
                self.roots.setdefault(root, []).append(int(least))
        self.heads = frozenset(r[: ROOT_SIZES[0]] for r in self.roots)

    def of(self, words: set[str]) -> set[str]:
        out = words & self.words
        near = [w for w in words if w[: ROOT_SIZES[0]] in self.heads]
        if len(near) > 1:
            shared = Counter([w[:size] for w in near for size in ROOT_SIZES if len(w) > size and w[:size] in self.roots])
            out.update(f"{root}*{least}" for root, n in shared.items() for least in self.roots[root] if n >= least)
        return out


def static_votes(text: str | None, words: set[str]) -> int:
    """Bits of the seed lexicons and of the pattern voters."""
    mask = 0
    for bit, lexicon in enumerate(WORD_SETS.values()):
        if not lexicon.isdisjoint(words):
            mask |= 1 << bit
    bit = len(WORD_SETS)
    if text:
        if any(c in text for c in "0134578@$*") and any(w.translate(LOOKALIKES) in INSULTS for w in set(text.lower().split()) if not w.isalpha()):
            mask |= 1 << bit
        if not INSULTS.isdisjoint(words) and any(m.lower() in INSULTS for m in ADDRESSED.findall(text)):
            mask |= 2 << bit
        if "!!" in text and SHOUTED.search(text):
            mask |= 4 << bit
    return mask


def mined_votes(signs: set[str], mined: dict[str, int]) -> int:
    mask = 0
    for s in mined.keys() & signs:
        mask |= 1 << (len(STATIC) + mined[s])
    return mask


class LabelModel:
    """A latent class with voters that fire independently given it, but for groups found to depend on each other."""

    def __init__(self) -> None:
        self.groups: list[list[int]] = [[v] for v in range(VOTERS)]
        self.prior = 0.1
        self.tables: list[np.ndarray] = []

    def fit(self, masks: np.ndarray, counts: np.ndarray, rounds: int = 60, dependent: float = 0.15, most_in_group: int = 3) -> LabelModel:
        """EM on pattern counts; then voters whose joint firing exceeds what the classes explain are merged, and EM runs again.

        The class is anchored: at the start a text on which any word voter fires is held to be toxic.
        """
        if not len(masks):
            masks, counts = np.zeros(1, np.int64), np.ones(1)
        shouting = 1 << STATIC.index("shouting")
        start = np.where((masks & ~shouting) != 0, 0.9, 0.02)
        self._em(masks, counts, start, rounds)
        bits = (masks[:, None] >> np.arange(VOTERS)) & 1
        post = self.posterior(masks)
        total = counts.sum()
        seen = np.einsum("n,ni,nj->ij", counts / total, bits, bits)
        expected = np.zeros_like(seen)
        for p in (post, 1 - post):
            weight = (counts * p).sum()
            rate = (counts * p) @ bits / max(weight, 1e-9)
            expected += weight / total * np.outer(rate, rate)
        spread = np.sqrt(np.maximum(np.diag(seen) * (1 - np.diag(seen)), 1e-9))
        self.correlation = (seen - expected) / np.outer(spread, spread)
        np.fill_diagonal(self.correlation, 0)
        pairs = sorted(((abs(self.correlation[i, j]), i, j) for i in range(VOTERS) for j in range(i)), reverse=True)
        owner = {v: [v] for v in range(VOTERS)}
        for strength, i, j in pairs:
            if strength < dependent:
                break
            a, b = owner[i], owner[j]
            if a is not b and len(a) + len(b) <= most_in_group:
                a += b
                for v in b:
                    owner[v] = a
        self.groups = list({id(g): g for g in owner.values()}.values())
        self._em(masks, counts, post, rounds)
        return self

    def _em(self, masks: np.ndarray, counts: np.ndarray, post: np.ndarray, rounds: int) -> None:
        codes = [self._code(masks, g) for g in self.groups]
        for _ in range(rounds):
            self.prior = float(np.clip((counts * post).sum() / counts.sum(), 1e-4, 0.5))
            self.tables = []
            for g, code in zip(self.groups, codes):
                both = np.stack([np.bincount(code, counts * p, minlength=1 << len(g)) + 0.05 for p in (1 - post, post)])
                self.tables.append(np.log(both / both.sum(axis=1, keepdims=True)))
            post = self._from(codes)

    @staticmethod
    def _code(masks: np.ndarray, group: list[int]) -> np.ndarray:
        return sum(((masks >> v) & 1) << i for i, v in enumerate(group))

    def _from(self, codes: list[np.ndarray]) -> np.ndarray:
        odds = np.log(self.prior) - np.log1p(-self.prior)
        for table, code in zip(self.tables, codes):
            odds = odds + table[1, code] - table[0, code]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        return self._from([self._code(masks, g) for g in self.groups])


def fit_linear(rows: list[np.ndarray], target: np.ndarray, features: int, sure: float = 3.0, least: float = 1e-3, l2: float = 5e-5, steps: int = 800) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on soft labels; features are present or absent.

    A feature is kept if its gradient at the constant model exceeds ``sure`` standard errors (and ``least``); weights of
    the kept ones are fitted by accelerated proximal gradient, with the same thresholds as L1 penalty, and those that stay
    are fitted again under a small L2 penalty alone.
    """
    n = len(rows)
    w = np.zeros(features)
    share = float(np.clip(target.mean() if n else 0.05, 1e-3, 0.999))
    bias = float(np.log(share / (1 - share)))
    if not n:
        return w, bias
    sizes = np.fromiter(map(len, rows), np.int64, n)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), sizes)
    df = np.bincount(flat, minlength=features)
    l1 = np.maximum(least, sure * np.sqrt(df * share * (1 - share)) / n)
    kept = np.abs(np.bincount(flat, (share - target)[owner], minlength=features) / n) > l1
    for penalty, ridge in ((l1, 0.0), (np.zeros(features), l2)):
        number = np.cumsum(kept) - 1
        used = kept[flat]
        f, o = number[flat[used]], owner[used]
        k = int(kept.sum())
        x = z = w[kept]
        b = bz = bias
        rate, t = 1 / (0.25 * (1 + np.bincount(o, minlength=n).max(initial=0)) + ridge), 1.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(o, z[f], minlength=n) + bz, -30, 30)))
            error = (p - target) / n
            new = z - rate * (np.bincount(f, error[o], minlength=k) + ridge * z)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty[kept], 0)
            nb = bz - rate * error.sum()
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, bz = new + (t - 1) / nt * (new - x), nb + (t - 1) / nt * (nb - b)
            x, b, t = new, nb, nt
        w[:] = 0
        w[kept] = x
        bias, kept = float(b), w != 0
    return w, bias


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text modulo ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(labels: DataFrame, id_column: str, label: str, learn: Column, rows: int) -> DataFrame:
    """(id, y) for at most about ``rows`` labelled rows to learn from: y is 1 if at least half of an id's labels are."""
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_column}`").isNotNull()).where(learn)
    one = known.groupBy(F.col(f"`{id_column}`").alias("_id")).agg((F.avg(F.col(f"`{label}`").cast("double")) >= 0.5).cast("int").alias("y"))
    return one.where(hash_share(rows, one.count(), "_id"))


class Toxicity:
    """A fitted scorer: weights of signs (words and shared word beginnings) and a constant."""

    def __init__(self, weights: dict[str, float], bias: float, model: LabelModel, mined: dict[str, int]) -> None:
        self.weights, self.bias, self.model, self.mined = weights, bias, model, mined

    def score(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """Add score (0 to 1) for every whole text; null and empty texts have the score of no words."""
        shared = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias))

        def make():
            weights, bias = shared.value
            known = Known(weights)

            def work(texts: list) -> dict[str, pa.Array]:
                total = np.array([bias + sum(weights[s] for s in sorted(known.of(distinct_words(t)))) for t in texts])
                return {"score": pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())}

            return work

        return map_texts(docs, text, make, "score double", keep)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 16_000, vocabulary: int = 50_000) -> Toxicity:
    """``learn``: which ids may be learned from.  ``sample_rows`` bounds the labelled rows that lexicons are mined from and
    the classifier is fitted on; the label model counts the votes on all texts that may be learned from.  Without
    labels the seed voters stand alone, and nothing is mined.  ``vocabulary`` bounds the signs offered to the classifier (the most frequent)."""
    source = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    chosen = labelled(labels, id_column, label, learn, sample_rows)

    def bag():
        def work(texts: list) -> dict[str, pa.Array]:
            words = [distinct_words(t) for t in texts]
            return {"signs": pa.array([sorted(all_signs(w)) for w in words], pa.list_(pa.string())), "mask": pa.array([static_votes(t, w) for t, w in zip(texts, words)], pa.int32())}

        return work

    picked = source.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "y", "text")
    bags = staged(map_texts(picked, "text", bag, "signs array<string>, mask int", keep=["y"]), "toxicity-bags")
    by_sign = staged(bags.select("y", F.explode("signs").alias("sign")).groupBy("sign").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("pos")).where("df >= 4"), "toxicity-signs")
    n, positive = bags.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    lift = ((F.col("pos") + 0.5) / (positive + 1)) / ((F.col("df") - F.col("pos") + 0.5) / (n - positive + 1))
    telling = by_sign.where((F.col("pos") >= 4) & (lift >= 10)).orderBy((F.col("pos") * F.log(lift)).desc(), "sign").limit(96).toPandas()["sign"]
    mined = {s: zlib.crc32(s.partition("*")[0].encode()) % MINED for s in telling}
    words = by_sign.orderBy(F.desc("df"), "sign").limit(vocabulary).toPandas()["sign"].tolist()

    def votes():
        known = Known(mined)

        def work(texts: list) -> dict[str, pa.Array]:
            bags_ = [distinct_words(t) for t in texts]
            return {"mask": pa.array([static_votes(t, b) | mined_votes(known.of(b), mined) for t, b in zip(texts, bags_)], pa.int32())}

        return work

    patterns = map_texts(source.where(learn), "text", votes, "mask int", keep=[]).groupBy("mask").agg(F.count(F.lit(1)).alias("n")).toPandas()
    model = LabelModel().fit(patterns["mask"].to_numpy(np.int64), patterns["n"].to_numpy(float))
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def indexed(frames):
        index = shared.value
        for pdf in frames:
            sets = [set(x) for x in pdf["signs"]]
            yield pd.DataFrame({"mask": [m | mined_votes(s, mined) for m, s in zip(pdf["mask"], sets)], "features": [np.array(sorted(index[w] for w in index.keys() & s), np.int32).tobytes() for s in sets]})

    sample = bags.mapInPandas(indexed, "mask int, features binary").toPandas()
    target = model.posterior(sample["mask"].to_numpy(np.int64))
    weights, bias = fit_linear([np.frombuffer(f, np.int32) for f in sample["features"]], target, max(len(words), 1))
    return Toxicity({w: float(v) for w, v in zip(words, weights) if v}, bias, model, mined)
