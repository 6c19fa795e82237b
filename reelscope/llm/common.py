"""Helpers shared by the corpus operators: reading, staging in the shared folder, Arrow maps over texts, salted joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelscope.session import shared_folder

#: A task works on slices of about this many characters, however many rows Spark puts in one batch.
SLICE_CHARS = 2_000_000
#: Pieces into which every group is dealt before it is joined; a third of all rows becomes 1/192 of them.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the session's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is used more than once to the shared folder and read it back.

    This cuts the lineage on storage that outlives any executor, and gives Spark the true size.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``size`` bytes of text (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    cut = np.cumsum(sizes) // size
    starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def map_texts(
    df: DataFrame, text: str, make: Callable[[], Callable[[list], dict[str, pa.Array]]], added: str, keep: list[str] | None = None, arrow: bool = False
) -> DataFrame:
    """Add columns computed from a text column, in Arrow slices; rows keep their order and number.

    ``make`` runs once in each task and returns a function from a list of texts (None for null; an Arrow
    array of them if ``arrow``) to one Arrow array per added column.  ``added`` is their DDL.  ``keep``: the columns to pass on (all by
    default); a passed column that has the name of an added one gives way.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    name = text if text in kept else "_the_text"
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[] if text in kept else [F.col(f"`{text}`").alias(name)])
    where = source.columns.index(name)
    out = StructType([source.schema[c] for c in kept] + new.fields)
    names = new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, name):
                got = work(part.column(where) if arrow else part.column(where).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + [got[n] for n in names], kept + names)

    return source.mapInArrow(run, out)


def salt(*columns: str) -> Column:
    """A piece number from what tells the rows of a group apart."""
    return F.pmod(F.xxhash64(F.lit("salt"), *[F.col(f"`{c}`") for c in columns]), F.lit(SALTS)).cast("int")


def per_group(rows: DataFrame, keys: list[str], by: list[str], aggregates: list[Column]) -> DataFrame:
    """Join every row with aggregates of its group, in pieces: no task sees a whole group.

    The pieces (keys, salt) that occur get the group's values; rows then meet their piece.  A hot group
    is spread over SALTS pieces, and rows are shuffled once (not at all where the pieces are small).
    Rows whose key is null form one group.
    """
    pieced = rows.withColumn("_salt", salt(*by))
    pieces = pieced.groupBy(*keys, "_salt").agg(F.lit(1).alias("_one")).drop("_one")
    groups = pieced.groupBy(*keys).agg(*aggregates)
    values = matched(pieces, groups, keys)
    return matched(pieced, values, [*keys, "_salt"]).drop("_salt")


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's key columns are dropped."""
    named = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    test = None
    for k in keys:
        one = F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
        test = one if test is None else test & one
    return left.join(named, test, how).drop(*[f"_r_{k}" for k in keys] if how not in ("left_semi", "left_anti") else [])


def hash_share(rows: int, total: int, *columns: str) -> Column:
    """True for a share of the rows that holds about ``rows`` of ``total``, by a hash of the columns."""
    if total <= rows:
        return F.lit(True)
    share = F.pmod(F.xxhash64(F.lit("sample"), *[F.col(f"`{c}`") for c in columns]), F.lit(1 << 30))
    return share < int((1 << 30) * rows / total)


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[starts[0]:starts[0]+lengths[0]], pool[starts[1]:...], ... one after another."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(lengths)
    return pool[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Memo(dict):
    """Distinct strings numbered in order of arrival; ``new`` holds those not looked at yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n
