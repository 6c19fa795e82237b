"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(group)`` puts a whole group into one task.  These helpers cut a
group along its order into *blocks*, run the window inside (group, block), and pass what must
cross a block border through a small table with one row per block of a cut group.

Where to cut is read from the data, as for a range partitioning: a sample of the keys, in proportion to the number of
shuffle partitions, names the groups that hold more than a partition's share and the order keys between which such a
group is cut into shares.  All other groups stay whole, so the usual plan is one exchange and one window, and the
block table exists only for cut groups (at most two blocks per shuffle partition).  Borders only place rows; results
do not depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

BLOCK = "_block"


def time_block(ts: str, seconds: int = 60) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds)


def index_block(index: str, size: int = 1024) -> Column:
    return F.floor(F.col(index) / size)


def by_value(column: str, width: float) -> Column:
    return F.floor(F.col(column) / width)


def _group_window(group: list[str]):
    """Over the block table only: one row per block, never per row."""
    return Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))


def _same(left: DataFrame, table: DataFrame, keys: list[str], how: str, extra: Column | None = None) -> DataFrame:
    """Join with a broadcast table on keys where null equals null; the table's key columns are dropped."""
    right = table.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in table.columns])
    cond = F.lit(True) if extra is None else extra
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(F.broadcast(right), cond, how).drop(*[f"_k_{k}" for k in keys])


#: Sampled keys per shuffle partition, and how many of them make a block.
SAMPLED, SHARE, MOST_BLOCKS = 16, 16, 512


def borders(df: DataFrame, group: list[str], order: list[str]) -> DataFrame | None:
    """Where groups that exceed a partition's share are cut: group, block, from (inclusive), to (exclusive); None if none does.

    The sample is the keys with the smallest hashes, 16 for each shuffle partition; a group with 16 of them or more is
    cut at every 16th.  A table smaller than the sample is not cut.  The table has at most as many rows as there are shuffle partitions (64 at least).
    """
    spark = df.sparkSession
    many = SAMPLED * max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*group, F.struct(*order).alias("_o"))
    sample = keys.orderBy(F.xxhash64(*group, "_o"), "_o").limit(many)
    whole = F.sum(F.size("_os")).over(Window.partitionBy(F.lit(0))) < many  # the table is smaller than the sample
    cut = sample.groupBy(*group).agg(F.sort_array(F.collect_list("_o")).alias("_os")).withColumn("_whole", whole)
    cut = cut.where((F.size("_os") >= 2 * SHARE) & ~F.col("_whole"))
    step = F.greatest(F.lit(SHARE), F.ceil(F.size("_os") / MOST_BLOCKS).cast("int"))
    inner = F.filter(F.array_distinct(F.filter("_os", lambda o, i: (i > 0) & (i % step == 0))), lambda o: o.isNotNull())
    ends = F.concat(F.array(F.lit(None).cast(_key_type(keys))), F.col("_in"))
    table = cut.select(*group, inner.alias("_in")).select(*group, F.posexplode(F.arrays_zip(ends.alias("lo"), F.col("_in").alias("hi"))).alias(BLOCK, "_b"))
    low, high = (F.col(f"_b.{end}").cast(_key_type(keys)).alias(f"_{end}") for end in ("lo", "hi"))
    found = table.select(*group, F.col(BLOCK).cast("bigint").alias(BLOCK), low, high).toArrow()
    return spark.createDataFrame(found, schema=_schema(df, group, keys)) if found.num_rows else None


def _key_type(keys: DataFrame) -> T.StructType:
    """Type of a border, whose fields may be null even where the order keys never are: the first and last end are open."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in keys.schema["_o"].dataType.fields])


def _schema(df: DataFrame, group: list[str], keys: DataFrame) -> T.StructType:
    kind = _key_type(keys)
    fields = [T.StructField(c, df.schema[c].dataType) for c in group]
    return T.StructType([*fields, T.StructField(BLOCK, T.LongType()), T.StructField("_lo", kind), T.StructField("_hi", kind)])


def carried(
    df: DataFrame,
    group: list[str],
    order: list[str],
    block: Column | None = None,
    number: str | None = None,
    sums: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    maxima: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    cuts: DataFrame | None | bool = True,
) -> DataFrame:
    """Add exact whole-group ordered columns.

    ``number``: 1-based row number.  ``sums``: inclusive running sums.  ``maxima``: inclusive
    running maxima.  ``previous`` / ``following``: value of a column in the neighbouring row.
    ``last``: number of the last row so far that meets a condition.  ``order`` must be a total order within the group.

    Groups beyond a partition's share are cut at sampled borders (see ``borders``), or all groups by ``block``, which
    must not fall along the order; ``cuts`` gives known borders of the same keys (None: no group is cut).  Rows are shuffled once; what crosses blocks is broadcast (a row per block of a cut
    group) unless ``block`` is given.  A null group is a group.
    """
    sums, previous, following, maxima, last = sums or {}, previous or {}, following or {}, maxima or {}, last or {}
    keys = [*group, BLOCK]
    if block is None:
        where = borders(df, group, order) if cuts is True else cuts
        if where is None:
            rows = df.withColumn(BLOCK, F.lit(0).cast("bigint"))
            inside = None
        else:
            here = F.struct(*order)
            between = (F.col("_lo").isNull() | (here >= F.col("_lo"))) & (F.col("_hi").isNull() | (here < F.col("_hi")))
            inside = _same(df, where, group, "inner", between).drop("_lo", "_hi")
            rows = _same(df, where, group, "left", between).drop("_lo", "_hi").withColumn(BLOCK, F.coalesce(BLOCK, F.lit(0).cast("bigint")))
    else:
        rows = df.withColumn(BLOCK, block)
        inside = rows.where(F.col(BLOCK).isNotNull())
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names: set[str] = set()
    if inside is not None:
        table, names = _carry(inside, group, order, number, sums, previous, following, maxima, last, w)
        rows = _same(rows, table, keys, "left") if block is None else _matched(rows, table, keys)
    brought = lambda name: F.col(name) if name in names else F.lit(None)
    added = {}
    if number:
        added[number] = F.row_number().over(w) + F.coalesce(brought("_c_n"), F.lit(0))
    for n, expr in sums.items():
        here, before = F.sum(expr).over(upto), brought(f"_c_s_{n}")
        added[n] = F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before) if names else here
    for n, expr in maxima.items():
        added[n] = F.greatest(F.max(expr).over(upto), brought(f"_c_m_{n}")) if names else F.max(expr).over(upto)
    for n, c in previous.items():
        lagged = F.lag(c).over(w)
        added[n] = F.when(F.row_number().over(w) == 1, F.col("_c_last")[n]).otherwise(lagged) if names else lagged
    for n, c in following.items():
        ahead = F.lead(c).over(w)
        added[n] = F.when(F.lead(F.lit(1)).over(w).isNull(), F.col("_c_first")[n]).otherwise(ahead) if names else ahead
    if not last:
        return rows.select(*df.columns, *[col.alias(n) for n, col in added.items()])
    kept = [c for c in ("_c_n", *[f"_c_w_{n}" for n in last]) if c in names]
    numbered = rows.select(*df.columns, BLOCK, *kept, *[col.alias(n) for n, col in added.items()], F.row_number().over(w).alias("_rn"))
    reach = {}
    for n, test in last.items():
        here = F.max(F.when(test, F.col("_rn"))).over(upto)
        reach[n] = F.coalesce(here + F.coalesce(brought("_c_n"), F.lit(0)), brought(f"_c_w_{n}")) if names else here
    return numbered.select(*df.columns, *added, *[col.cast("bigint").alias(n) for n, col in reach.items()])


def _matched(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """As ``_same`` with "left", for a table that may be large."""
    right = table.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in table.columns])
    cond = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = test if cond is None else cond & test
    return rows.join(right, cond, "left").drop(*[f"_k_{k}" for k in keys])


def _carry(inside, group, order, number, sums, previous, following, maxima, last, w):
    """What each block gets from the blocks before (and after) it, and the names of those columns."""
    keys, order_key = [*group, BLOCK], F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(expr).alias(f"_s_{name}") for name, expr in sums.items()]
    aggs += [F.max(expr).alias(f"_m_{name}") for name, expr in maxima.items()]
    if last:
        inside = inside.withColumn("_rn", F.row_number().over(w))
        aggs += [F.max(F.when(test, F.col("_rn"))).alias(f"_w_{name}") for name, test in last.items()]
    if previous:
        aggs.append(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in previous.items()]), order_key).alias("_last"))
    if following:
        aggs.append(F.min_by(F.struct(*[F.col(c).alias(n) for n, c in following.items()]), order_key).alias("_first"))
    blocks = inside.groupBy(*keys).agg(*aggs)
    bw = _group_window(group).orderBy(BLOCK)
    earlier = bw.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    carry = {}
    if number or last:
        carry["_c_n"] = before
    carry |= {f"_c_s_{n}": F.sum(f"_s_{n}").over(earlier) for n in sums}
    carry |= {f"_c_m_{n}": F.max(f"_m_{n}").over(earlier) for n in maxima}
    if previous:
        carry["_c_last"] = F.lag("_last").over(bw)
    if following:
        carry["_c_first"] = F.lead("_first").over(bw)
    table = blocks.select(*keys, *[c.alias(n) for n, c in carry.items()], *[(F.col(f"_w_{n}") + before).alias(f"_at_{n}") for n in last])
    table = table.select(*keys, *carry, *[F.max(f"_at_{n}").over(earlier).alias(f"_c_w_{n}") for n in last])
    return table, {*carry, *[f"_c_w_{n}" for n in last]}


def with_lags(
    df: DataFrame, group: list[str], index: str, lags: dict[str, tuple[str, int]], size: int = 4096
) -> DataFrame:
    """Values of the rows 1, 2, ... before, where ``index`` counts a group's rows without gaps.

    A group is cut every ``size`` rows, and the last rows of a block are copied into the
    next one as context; no join is needed.  ``lags``: name -> (column, distance).
    """
    reach = max(d for _, d in lags.values())
    at = F.floor(F.col(index) / size)
    tail = F.col(index) % size >= size - reach
    copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = df.withColumn(BLOCK, at).withColumn("_ctx", F.explode(copies)).withColumn(BLOCK, F.col(BLOCK) + F.col("_ctx"))
    w = Window.partitionBy(*group, BLOCK).orderBy(index)
    out = rows.withColumns({name: F.lag(c, d).over(w) for name, (c, d) in lags.items()})
    return out.where("_ctx = 0").drop("_ctx", BLOCK)


def trend(df: DataFrame, group: list[str], order: list[str], block: Column, measures: dict[str, Column]) -> DataFrame:
    """Least-squares slope of each measure over row order, per group.

    Columns per measure: slope_<m>, avg_<m>, min_<m>, max_<m>; plus ``n``.  Moments are taken
    inside each block and merged, so rows are shuffled once and no group needs one task.
    Rows where a measure is null are not allowed: filter first.
    """
    rows = df.select(*group, *order, block.alias(BLOCK), *[m.cast("double").alias(n) for n, m in measures.items()])
    keys = [*group, BLOCK]
    x = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("double")
    local = rows.withColumn("_x", x)
    aggs = [F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_ax"), F.regr_sxx("_x", "_x").alias("_sxx")]
    for name in measures:
        aggs += [
            F.avg(name).alias(f"_a_{name}"), F.regr_sxy(name, "_x").alias(f"_s_{name}"),
            F.min(name).alias(f"_l_{name}"), F.max(name).alias(f"_h_{name}"),
        ]
    per_block = local.groupBy(*keys).agg(*aggs)
    w = _group_window(group)
    offset = F.coalesce(
        F.sum("_n").over(w.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = per_block.withColumn("_ax", F.col("_ax") + offset).withColumn("_tn", F.sum("_n").over(w))
    placed = placed.withColumn("_mx", F.sum(F.col("_n") * F.col("_ax")).over(w) / F.col("_tn"))
    for name in measures:
        placed = placed.withColumn(f"_m_{name}", F.sum(F.col("_n") * F.col(f"_a_{name}")).over(w) / F.col("_tn"))
    dx = F.col("_ax") - F.col("_mx")
    out = [F.sum("_n").alias("n"), F.sum(F.col("_sxx") + F.col("_n") * dx * dx).alias("_sxx")]
    for name in measures:
        dy = F.col(f"_a_{name}") - F.col(f"_m_{name}")
        out += [
            F.sum(F.col(f"_s_{name}") + F.col("_n") * dx * dy).alias(f"_sxy_{name}"),
            F.first(f"_m_{name}").alias(f"avg_{name}"),
            F.min(f"_l_{name}").alias(f"min_{name}"), F.max(f"_h_{name}").alias(f"max_{name}"),
        ]
    merged = placed.groupBy(*group).agg(*out)
    slope = lambda name: F.coalesce(F.try_divide(F.col(f"_sxy_{name}"), F.col("_sxx")), F.lit(0.0))
    cols = [c for name in measures for c in (
        slope(name).alias(f"slope_{name}"), F.col(f"avg_{name}"), F.col(f"min_{name}"), F.col(f"max_{name}"))]
    return merged.select(*group, "n", *cols)


def direction(slope: Column) -> Column:
    return F.when(F.abs(slope) < 0.01, "stable").when(slope > 0, "increasing").otherwise("decreasing")


def significance(slope: Column, low: Column, high: Column, n: Column) -> Column:
    relative = F.abs(slope) / (high - low) * n
    return (
        F.when(n < 5, "insufficient_data")
        .when(high == low, "no_variation")
        .when(relative > 0.5, "significant")
        .when(relative > 0.2, "moderate")
        .otherwise("minimal")
    )


def exact_median(df: DataFrame, column: str, half_width: float = 1e-3, accuracy: int = 100000, bins: int = 1 << 16) -> DataFrame:
    """One row (n, median), exact, without holding all values in one task.

    A mergeable sketch brackets the median, the bracket is counted in ``bins`` equal bins, and only
    the values of the one or two bins that hold the middle ranks are ranked, equal values merged.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    edges = values.agg(
        F.percentile_approx("v", [0.5 - half_width, 0.5 + half_width], accuracy).alias("e"), F.count(F.lit(1)).alias("n")
    )
    bracket = edges.select(F.struct(F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"), "n").alias("q")).scalar()
    placed = values.withColumn("q", bracket).where(F.col("v") <= F.col("q.hi"))
    share = F.coalesce(F.try_divide(F.col("v") - F.col("q.lo"), F.col("q.hi") - F.col("q.lo")), F.lit(0.0))
    binned = placed.withColumn("bin", F.when(F.col("v") < F.col("q.lo"), F.lit(-1)).otherwise(F.floor(share * bins)).cast("bigint"))
    counts = binned.groupBy("bin", F.col("q.n").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    all_bins = Window.partitionBy(F.lit(0)).orderBy("bin")  # at most ``bins`` + 2 rows
    ranked = counts.withColumn("hi", F.sum("c").over(all_bins)).withColumn("lo", F.col("hi") - F.col("c"))
    left, right = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda k: (F.col("lo") <= k) & (k < F.col("hi"))
    chosen = ranked.where(holds(left) | holds(right)).agg(
        F.min("bin").alias("a"), F.max("bin").alias("b"), F.min("lo").alias("before"), F.max("n").alias("n")
    )
    target = chosen.select(F.struct("a", "b", "before", "n").alias("t")).scalar()
    middle = binned.withColumn("t", target).where((F.col("bin") == F.col("t.a")) | (F.col("bin") == F.col("t.b")))
    merged = middle.groupBy("v", F.col("t.n").alias("n"), F.col("t.before").alias("before")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(F.lit(0)).orderBy("v")
    final = merged.withColumn("hi", F.sum("c").over(w) + F.col("before")).withColumn("lo", F.col("hi") - F.col("c"))
    hit = lambda k: F.max(F.when(holds(k), F.col("v")))
    return final.agg(F.max("n").alias("n"), ((hit(left) + hit(right)) / 2).alias("median"))
