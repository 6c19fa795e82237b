"""Language identification by Bayesian fusion of evidence.

Four sources are combined: the likelihood of the text's letter trigrams, the language its markup declares,
its address suffix, and its host.  What a declaration, a suffix or a host says about languages is counted
over all rows from the text evidence (grouped aggregation, a row's own share taken out), and a host's counts
are smoothed towards its domain's and those towards all rows'.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelscope.llm.common import map_texts, matched, salt, slices, staged

BUCKETS = 1 << 15
#: The class of texts that are in no language of the model.
BACKGROUND = "?"
#: Of the background; with much more, texts in two languages of the model would be in none.
MIXED = 0.1
#: What begins a piece of markup, what ends a script or style, and the two ways in which a tag declares a language.
OPENS = re.compile(r"<(?:(!--)|(script|style)\b)?", re.IGNORECASE)
CLOSES = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.IGNORECASE)
META = re.compile(r"http-equiv\s*=\s*[\"']?content-language[\"']?\s+content\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.IGNORECASE)
HTML = re.compile(r"<html\b", re.IGNORECASE)
#: Letters as they are, all other ASCII as one blank.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[:128] = 32
LETTERS[97:123] = np.arange(97, 123)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all letter trigrams, how many each text has).  Case and everything but letters are left out."""
    parts = [(" " + (t or "").lower() + " ").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    c = LETTERS[np.frombuffer(b"".join(parts), np.uint8)]
    owner = np.repeat(np.arange(len(parts)), sizes)
    keep = np.r_[True, (c[1:] != 32) | (c[:-1] != 32) | (owner[1:] != owner[:-1])] if len(c) else np.zeros(0, bool)
    c, owner = c[keep].astype(np.uint32), owner[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(len(parts), np.int64)
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    inside = (owner[:-2] == owner[2:]) & ~((c[:-2] == 32) & (c[2:] == 32))
    bucket = ((code[inside] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    return bucket, np.bincount(owner[:-2][inside], minlength=len(parts))


class TextModel:
    """Trigram likelihoods per language."""

    def __init__(self, languages: list[str], logs: np.ndarray, weight: float = 40.0) -> None:
        self.languages, self.logs, self.weight = languages, logs, weight

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods, number of trigrams) per text.  Neighbouring trigrams say the same again, so a text counts
        as ``weight`` independent ones at most."""
        bucket, sizes = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        has = np.flatnonzero(sizes)
        if len(has):
            starts = (np.cumsum(sizes) - sizes)[has]
            for j in range(len(self.languages)):
                out[has, j] = np.add.reduceat(self.logs[j][bucket], starts, dtype=np.float64)
            out[has] *= (np.minimum(sizes[has], self.weight) / sizes[has])[:, None]
        return out, sizes


def fit_text_model(docs: DataFrame, lang: str = "lang", text: str = "text", sample_rows: int = 20_000, least_share: float = 0.002, least_rows: int = 50, most: int = 64) -> TextModel:
    """Trigram counts of about ``sample_rows`` rows of every language, and a background for texts in none of them.

    A language is kept if it has ``least_rows`` rows; in a small table ``least_share`` of the rows with a language is enough.
    At most ``most`` languages are, those with the most rows (equal ones by name): the model has 256 KB for each of them
    and goes to every task, and a column of free text must not end the driver.  Texts of the others fall to the background.
    The background is a share MIXED of all sampled trigrams, the rest uniform: a text that no language explains better
    belongs to none.
    """
    named = F.lower(F.trim(F.col(f"`{lang}`").cast("string")))
    rows = docs.where(named.isNotNull() & (named != "") & F.col(f"`{text}`").isNotNull()).select(named.alias("lang"), F.col(f"`{text}`").alias("text"))
    shares = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-shares")
    total = shares.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    enough = shares.where((F.col("n") >= max(1.0, min(float(least_rows), least_share * total))) & (F.col("lang") != BACKGROUND))
    found = {r.lang: r.n for r in enough.orderBy(F.desc("n"), "lang").limit(most).collect()}
    languages = sorted(found)
    if not languages:
        return TextModel(["und"], np.zeros((1, BUCKETS)))
    number = {name: i for i, name in enumerate(languages)}

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                who = np.array([number.get(x, -1) for x in part.column(0).to_pylist()])
                bucket, sizes = grams(part.column(1).to_pylist())
                owner = np.repeat(who, sizes)
                key, n = np.unique((owner * BUCKETS + bucket)[owner >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // BUCKETS, pa.int32()), pa.array(key % BUCKETS, pa.int32()), pa.array(n, pa.int64())], ["j", "b", "n"])

    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample_rows / found[name]))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col("text")), F.lit(1 << 30)) < F.lit(1 << 30) * share
    sums = rows.where(drawn).mapInArrow(run, "j int, b int, n bigint").groupBy("j", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums["j"], sums["b"]] = sums["n"]
    n = counts.sum(axis=1, keepdims=True)
    even = np.minimum(BUCKETS / (2 * n + BUCKETS), 0.25)  # half a trigram a bucket; more would make a small language explain everything
    likely = (1 - even) * counts / np.maximum(n, 1) + even / BUCKETS
    mean = (counts.sum(axis=0) + 0.5) / (counts + 0.5 / len(languages)).sum()
    return TextModel([*languages, BACKGROUND], np.log(np.vstack([likely, MIXED * mean + (1 - MIXED) / BUCKETS])))


def page_parts(html: str | None) -> tuple[str, str]:
    """(text outside of markup, language that the first declaring tag names or an empty string) in one pass.

    Scripts, styles and comments go with what they hold, other tags from ``<`` to ``>``.  What is opened and never closed is
    a plain tag if a ``>`` follows at all, and text otherwise; each kind of ending is looked for only once where there is none.
    """
    html, at, out, said = html or "", 0, [], ""
    never: set[str] = set()

    def end(kind: str, start: int) -> int:
        if kind in never:
            return -1
        if kind in CLOSES:
            found = CLOSES[kind].search(html, start)
            stop = found.end() if found else -1
        else:
            stop = html.find(kind, start)
            stop = stop + len(kind) if stop >= 0 else -1
        if stop < 0:
            never.add(kind)
        return stop

    while opened := OPENS.search(html, at):
        start = opened.start()
        out.append(html[at:start])
        kind = "-->" if opened[1] else (opened[2] or "").lower()
        stop = end(kind, opened.end()) if kind else -1
        if stop < 0 or kind in CLOSES:
            closed = end(">", start)
            if closed < 0:
                out.append(html[start:])
                return "".join(out), said
            if not said:
                tag = html[start:closed]
                found = (LANG.search(tag) if HTML.match(tag) else None) or META.search(tag)
                said = found[1].lower() if found else ""
            stop = max(stop, closed)
        out.append(" ")
        at = stop
    out.append(html[at:])
    return "".join(out), said


def page_text(html: str | None) -> str:
    return page_parts(html)[0]


def with_evidence(rows: DataFrame, model: TextModel, text: str, markup: bool, declared: Column | None, address: Column | None, host: Column | None, keep: list[str] | None) -> DataFrame:
    """Add _n, _log, _p (text evidence), _declared, _host, _domain, _suffix and _salt.

    ``markup``: the text is HTML that may declare a language.  ``address``: a URL that gives host, domain and
    suffix; ``host`` stands in for one.  What is missing is an empty string, which is a value of its own.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    known = [x for x in model.languages if x != BACKGROUND]

    def make():
        fitted = shared.value

        def work(texts: list) -> dict[str, pa.Array]:
            parts = [page_parts(t) for t in texts] if markup else [(t, "") for t in texts]
            logs, sizes = fitted.evidence([t for t, _ in parts])
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            said = [lang for _, lang in parts]
            kind = pa.list_(pa.float64())
            return {"_n": pa.array(sizes, pa.int64()), "_log": pa.array(list(logs), kind), "_p": pa.array(list(p), kind), "_said": pa.array(said)}

        return work

    asked = rows
    if declared is not None:
        asked = asked.withColumn("_given", F.coalesce(F.lower(F.trim(declared.cast("string"))), F.lit("")))
    if address is not None:
        name = F.lower(F.regexp_extract(F.coalesce(address.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        asked = asked.withColumn("_host", name)
    else:
        asked = asked.withColumn("_host", F.coalesce(host.cast("string"), F.lit("")) if host is not None else F.lit(""))
    asked = asked.withColumn("_salt", salt(text))
    extra = ["_host", "_salt"] + ["_given"] * (declared is not None)
    out = map_texts(asked, text, make, "_n bigint, _log array<double>, _p array<double>, _said string", None if keep is None else keep + extra)
    said = F.col("_given") if declared is not None else F.col("_said")
    usual = F.when(said.isin(*known) | (said == ""), said).otherwise("other")
    labels = F.split("_host", r"\.")
    domain = F.when(F.lit(address is not None), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).otherwise("")
    suffix = F.when(F.lit(address is not None), F.element_at(labels, -1)).otherwise("")
    return out.withColumn("_declared", usual).withColumn("_domain", domain).withColumn("_suffix", suffix).drop("_said", *["_given"] * (declared is not None))


COUNTED = ["_host", "_domain", "_suffix", "_declared", "_salt", "_p"]


def fused(rows: DataFrame, counted: DataFrame, model: TextModel, pull: float = 10.0, least: int = 3, sure: float = 0.5) -> DataFrame:
    """Add lang (null if undecided), confidence, text_lang and accepted to ``rows`` that carry evidence.

    ``counted``: the evidence of the same rows (COUNTED), which the counts are taken from.  ``pull`` is how many
    rows of the wider group stand against a group's own.  A row is accepted if it has at least ``least`` trigrams and its
    best language at least ``sure``; where the background wins, it is in no language of the model and is not.  Counts reach rows through the (host, salt) pieces that occur, so a host that holds a
    third of all rows is dealt over pieces.
    """
    names = model.languages
    k = len(names)
    total = lambda column: F.array(*[F.sum(F.col(column)[j]) for j in range(k)])
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    hosts = staged(counted.groupBy("_host", "_domain", "_suffix").agg(total("_p").alias("h")), "language-hosts")
    domains = hosts.groupBy("_domain").agg(total("h").alias("d"))
    suffixes = hosts.groupBy("_suffix").agg(total("h").alias("s"))
    everything = hosts.agg(total("h")).first()[0] or [0.0] * k
    overall = np.array([x or 0.0 for x in everything]) + 1.0
    overall = F.array(*[F.lit(float(x)) for x in overall / overall.sum()])
    said = {r._declared: r.c for r in counted.groupBy("_declared").agg(total("_p").alias("c")).collect()}  # at most the languages, "other" and none
    said_map = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(float(v)) for v in x]) for kv in sorted(said.items()) for x in kv]) if said else None
    tables = matched(matched(hosts, domains, ["_domain"]), suffixes, ["_suffix"])
    pieces = counted.select("_host", "_domain", "_suffix", "_salt").distinct()
    priors = staged(matched(pieces, tables, ["_host", "_domain", "_suffix"]).select("_host", "_salt", "h", "d", "s"), "language-priors")
    joined = matched(rows, priors, ["_host", "_salt"])
    own = lambda c: F.zip_with(c, F.col("_p"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    whole = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smoothed = lambda c, wide: F.zip_with(c, wide, lambda x, w: (x + F.lit(pull) * w) / (whole(c) + F.lit(pull)))
    lift = lambda c: F.zip_with(smoothed(c, overall), overall, lambda x, w: F.log(x / w))
    staged_in = joined.withColumn("_h", own(F.col("h"))).withColumn("_d", own(F.col("d"))).withColumn("_s", own(F.col("s"))).withColumn("_c", own(said_map[F.col("_declared")]) if said else F.col("_p"))
    prior = staged_in.withColumn("_dom", smoothed(F.col("_d"), overall)).withColumn("_prior", smoothed(F.col("_h"), F.col("_dom")))
    scored = prior.withColumn("_sum", plus(plus(F.col("_log"), F.transform("_prior", lambda x: F.log(x))), plus(lift(F.col("_s")), lift(F.col("_c")))))
    odds = scored.withColumn("_max", F.array_max("_sum")).withColumn("_e", F.transform("_sum", lambda x: F.exp(x - F.col("_max"))))
    language = F.array(*[F.lit(n) for n in names])
    best = lambda c: F.element_at(language, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    confidence = F.lit(1.0) / whole(F.col("_e"))
    enough = F.col("_n") >= least
    out = odds.withColumn("confidence", confidence).withColumn("text_lang", F.when(enough, best("_log"))).withColumn("accepted", enough & (F.col("confidence") >= sure) & (best("_sum") != BACKGROUND))
    out = out.withColumn("text_lang", F.when(F.col("text_lang") != BACKGROUND, F.col("text_lang")))
    out = out.withColumn("found_lang", F.when(F.col("accepted"), best("_sum")))
    return out.drop("h", "d", "s", "_h", "_d", "_s", "_c", "_dom", "_prior", "_sum", "_max", "_e")


def identify_pages(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """(id, found_lang, confidence, text_lang, declared, host, suffix, n_trigrams, accepted), a row per page.

    Null or empty pages have no trigrams and are not accepted; a missing URL has the empty host.  Repeated rows each get a row.
    """
    source = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    rows = staged(with_evidence(source, model, "html", True, None, F.col("url"), None, ["id"]), "language-evidence")
    out = fused(rows, rows, model, **options)
    return out.select("id", "found_lang", "confidence", "text_lang", F.col("_declared").alias("declared"), F.col("_host").alias("host"), F.col("_suffix").alias("suffix"), F.col("_n").alias("n_trigrams"), "accepted")


def accepted_documents(docs: DataFrame, model: TextModel, lang: str = "lang", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose language is decided, all columns; ``lang`` is the declared language and ``source`` the host.

    The text evidence is computed twice, so that no text is stored or shuffled for the counts.
    """
    given = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    counted = staged(with_evidence(given, model, "text", False, F.col("lang"), None, F.col("source"), []).select(*COUNTED), "language-evidence")
    rows = with_evidence(docs, model, text, False, F.col(f"`{lang}`"), None, F.col(f"`{source}`"), None)
    return fused(rows, counted, model, **options).where("accepted").select(*[F.col(f"`{c}`") for c in docs.columns])
