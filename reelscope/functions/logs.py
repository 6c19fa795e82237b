"""Evaluator-log parsing as column expressions: one log is one text value, so nothing is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns tried in order.
SSIM_PATTERNS = (r"n:\d+\s+Y:([\d.]+)", r"Y:\s*([\d.]+)", r"All:\s*([\d.]+)")
SSIM_LINE_WORDS = ("ssim", "y:", "n:")
DECIMAL = r"\b(0\.\d+|\d+\.\d+)\b"
VMAF_PATTERNS = (r"VMAF\s+score[:\s]+([\d.]+)", r"vmaf[:\s]+([\d.]+)", r"mean[:\s]+([\d.]+)")
NUMBER = r"\b(\d+\.?\d*)\b"
XML_MARKS = ("<?xml", "<vmaf", "<libvmaf", "</vmaf>", "</libvmaf>")
JSON_MARKS = ('"pooled_metrics"', '"vmaf"', '"aggregate"', '"mean"')
TEXT_MARKS = ("vmaf score:", "vmaf:", "mean:")
XML_POOLED = r'(?i)<metric\b[^>]*name="vmaf"[^>]*\bmean="([\d.]+)"'
XML_FRAME = r'(?i)<frame\b[^>]*\bvmaf="([\d.]+)"'
XML_ELEMENT = r"(?i)<vmaf\b[^>]*>\s*([\d.]+)\s*</vmaf>"

IQR_MULTIPLIER = 1.5
MIN_FOR_OUTLIERS = 4


def captures(text: Column, pattern: str) -> Column:
    """All first-group captures as doubles (null where a capture is not a number)."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("double"))


def usable(arr: str) -> Column:
    """Whether a stage found something and every capture was a number."""
    return (F.size(arr) > 0) & ~F.exists(arr, lambda x: x.isNull())


def in_unit(arr: Column) -> Column:
    return F.filter(arr, lambda x: (x >= 0) & (x <= 1))


def mean(arr: Column) -> Column:
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), F.size(arr).cast("double"))


def lines_with(text: Column, words: tuple[str, ...]) -> Column:
    has = lambda line: reduce(lambda a, b: a | b, [F.lower(line).contains(w) for w in words])
    return F.filter(F.split(text, "\n"), has)


def with_ssim_raw(logs: DataFrame, text: str) -> DataFrame:
    """Add ``_raw``: the scores of the first pattern that yields any.

    Each stage is its own column and runs only where the earlier ones found nothing, so a
    normal log is scanned once.
    """
    t = F.col(text)
    nothing = F.array().cast("array<double>")
    out = logs.withColumn("_raw", captures(t, SSIM_PATTERNS[0]))
    for pattern in SSIM_PATTERNS[1:]:
        out = out.withColumn("_raw", F.when(usable("_raw"), F.col("_raw")).otherwise(captures(t, pattern)))
    loose = F.flatten(F.transform(lines_with(t, SSIM_LINE_WORDS), lambda l: captures(l, DECIMAL)))
    return out.withColumn("_raw", F.when(usable("_raw"), F.col("_raw")).otherwise(in_unit(F.coalesce(loose, nothing))))


def stdev(arr: Column) -> Column:
    """Sample standard deviation in one pass over the array."""

    def step(a, x):
        n = a["n"] + 1
        d = x - a["m"]
        m = a["m"] + d / n
        return F.struct(n.alias("n"), m.alias("m"), (a["s"] + d * (x - m)).alias("s"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))
    return F.aggregate(arr, zero, step, lambda a: F.sqrt(F.try_divide(a["s"], a["n"] - 1)))


def with_scores(df: DataFrame, raw: str = "_raw") -> DataFrame:
    """Outlier-free mean and confidence of an array of scores.

    Quartiles are picked by index (n//4, 3n//4), not interpolated.
    """
    staged = df.withColumn("_sorted", F.sort_array(in_unit(F.col(raw))))
    n = F.size("_sorted")
    q1 = F.get("_sorted", F.floor(n / 4).cast("int"))
    q3 = F.get("_sorted", F.floor(n * 3 / 4).cast("int"))
    inside = F.filter("_sorted", lambda x: (x >= q1 - (q3 - q1) * IQR_MULTIPLIER) & (x <= q3 + (q3 - q1) * IQR_MULTIPLIER))
    staged = staged.withColumn("_kept", F.when(n >= MIN_FOR_OUTLIERS, inside).otherwise(F.col("_sorted")))
    staged = staged.withColumn("_kept", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_sorted")))
    k = F.size("_kept")
    steady = F.when(k > 1, F.greatest(F.lit(0.0), 1 - stdev(F.col("_kept")) * 10)).otherwise(0.5)
    conf = n / F.size(raw) * 0.4 + steady * 0.4 + F.least(F.lit(1.0), k / 10) * 0.2
    has = F.coalesce(k > 0, F.lit(False))
    return staged.withColumns(
        {
            "ssim": F.when(has, mean(F.col("_kept"))),
            "ssim_conf": F.when(has, conf).otherwise(0.0),
            "ssim_frames": F.when(has, k).otherwise(0).cast("bigint"),
        }
    ).drop("_sorted", "_kept")


def ssim_scores(logs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``ssim``, ``ssim_conf``, ``ssim_frames`` per log (null score and zero confidence when none)."""
    return with_scores(with_ssim_raw(logs, text)).drop("_raw")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words])


def in_range(x: Column) -> Column:
    return F.when((x >= 0) & (x <= 100), x)


def vmaf_format(text: Column) -> Column:
    braces = text.contains("{") & text.contains("}")
    return (
        F.when(contains_any(text, XML_MARKS), "xml")
        .when(braces & contains_any(text, JSON_MARKS), "json")
        .when(contains_any(text, TEXT_MARKS), "text")
        .otherwise("unknown")
    )


def vmaf_json(text: Column) -> Column:
    """First line holding a JSON object with a score."""
    paths = ("$.pooled_metrics.vmaf.mean", "$.aggregate.VMAF_score", "$.vmaf.mean", "$.vmaf")
    body = F.transform(
        F.filter(F.split(text, "\n"), lambda l: l.contains("{")), lambda l: F.substr(l, F.locate("{", l))
    )
    score = lambda j: F.coalesce(*[F.get_json_object(j, p).try_cast("double") for p in paths])
    found = F.get(F.filter(F.transform(body, score), lambda x: x.isNotNull()), F.lit(0))
    return F.when(text.contains("{"), found)


def last_match(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def vmaf_numeric(text: Column) -> Column:
    found = F.flatten(F.transform(lines_with(text, ("vmaf", "mean")), lambda l: captures(F.trim(l), NUMBER)))
    return F.array_max(F.filter(found, lambda x: (x >= 0) & (x <= 100)))


def vmaf_xml(text: Column) -> Column:
    good = lambda p: F.filter(captures(text, p), lambda x: (x >= 0) & (x <= 100))
    pooled = F.get(good(XML_POOLED), F.lit(0))
    per_frame = mean(F.concat(good(XML_FRAME), good(XML_ELEMENT)))
    return F.when(contains_any(text, XML_MARKS[:3]), F.coalesce(pooled, per_frame))


def vmaf_scores(logs: DataFrame, text: str = "text", patterns: tuple[str, ...] = VMAF_PATTERNS) -> DataFrame:
    """Add ``vmaf`` and ``vmaf_format``; parsers run in the order the detected format suggests.

    ``patterns`` are the configurable text patterns; the last match of the first pattern with a
    valid last match counts.  The loosest parser runs only where the others found nothing.
    """
    t = F.col(text)
    names = [f"_p{i}" for i in range(len(patterns))]
    staged = logs.withColumns({n: last_match(t, p) for n, p in zip(names, patterns)})
    staged = staged.withColumns({"vmaf_format": vmaf_format(t), "_xml": vmaf_xml(t), "_json": vmaf_json(t)})
    staged = staged.withColumn("_text", F.coalesce(*[in_range(F.col(n)) for n in names]))
    xml, json, txt = (in_range(F.col(c)) for c in ("_xml", "_json", "_text"))
    first = (
        F.when(F.col("vmaf_format") == "json", F.coalesce(json, xml, txt))
        .when(F.col("vmaf_format") == "text", F.coalesce(txt, json, xml))
        .otherwise(F.coalesce(xml, json, txt))
    )
    out = staged.withColumn("vmaf", first).withColumn(
        "vmaf", F.when(F.col("vmaf").isNotNull(), F.col("vmaf")).otherwise(vmaf_numeric(t))
    )
    return out.drop(*names, "_xml", "_json", "_text")
