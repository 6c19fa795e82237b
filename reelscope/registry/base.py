"""Registration of named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from reelscope.registry.sqlviews import sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, body: str | None = None, views: str = "", rounds: str = "", digits: int = 6, **ctes: str):
    """Register ``fn(spark, sf_dir)``; with ``body`` also register its SQL twin.

    Double columns of the Spark result are rounded to ``digits``; ``rounds`` names the
    columns to round on the SQL side.
    """

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if body is not None:
            text = body
            if rounds:
                cols = ", ".join(f"round({c}, {digits}) AS {c}" for c in rounds.split())
                text = f"SELECT * REPLACE ({cols}) FROM (\n{body}\n)"
            ORACLE[name] = sql(text, *views.split(), **ctes)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])
