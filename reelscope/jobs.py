"""Running user functions over a table, and reusing their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reelscope.operators import joins as J
from reelscope.sources import stores


def apply_job(df: DataFrame, fn: Callable[[dict], object], result_type: str, keep: list[str]) -> DataFrame:
    """Apply ``fn(row as dict)`` to every row in parallel batches; a failing row keeps its error text.

    Adds ok, error, result to the ``keep`` columns.  Partitioning is left to the input.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([
        *fields, T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()),
        T.StructField("result", T._parse_datatype_string(result_type)),
    ])

    def one(row: dict) -> tuple[bool, str | None, object]:
        try:
            return True, None, fn(row)
        except Exception as exc:  # noqa: BLE001 - the row's error is the result
            return False, f"{type(exc).__name__}: {exc}", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [one(r) for r in pdf.to_dict("records")]
            out = pdf[[f.name for f in fields]].copy()
            out["ok"], out["error"], out["result"] = (pd.Series(list(x), index=out.index, dtype="object") for x in (zip(*done) if done else ([], [], [])))
            yield out

    return df.mapInPandas(run, schema)


def memoised(
    requests: DataFrame, cache: DataFrame, job: Callable[[DataFrame], DataFrame], now: Column, ttl_hours: int = 24
) -> tuple[DataFrame, DataFrame]:
    """(results for all requests, updated cache): only keys without a live entry run through ``job``.

    Requests and the job's output carry ``cache_key``; the cache holds cache_key, value, created_at,
    expires_at.  Each missing key runs once, however many requests ask for it.
    """
    looked = J.cache_lookup(requests, cache.select("cache_key", "value", "expires_at"), now)
    missing = looked.where(~F.col("hit")).drop("value", "expires_at", "hit").dropDuplicates(["cache_key"])
    fresh = job(missing).select("cache_key", "value")
    entries = fresh.withColumn("created_at", now).withColumn("expires_at", now + F.make_dt_interval(hours=F.lit(ttl_hours)))
    table = stores.upsert(cache, entries.select(*cache.columns), ["cache_key"], ["created_at"])
    new = fresh.withColumnRenamed("value", "_new")
    results = looked.join(new, "cache_key", "left").withColumn("value", F.coalesce("value", "_new")).drop("_new", "expires_at")
    return results, table
