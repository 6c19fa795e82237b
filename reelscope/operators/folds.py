"""Greedy sequential passes whose next step depends on the last decision.

Such a pass cannot be a window frame.  A group is cut into blocks, and a block is a map from the state before it to the
state after it.  One run of a block from some state tells which map it is there: it *sets* the state (a new run, a newly kept
frame: nothing from before matters), or it passes the state on, with additions to some fields and new values of others.  Such
maps compose by running sums and running maxima over the block table, so all entry states come from one prefix scan.
Blocks run again from the entry found, all in parallel; where that shows another map than assumed, the scan and those
blocks are repeated.  At the end every block began with the state that the scan gives it, which is the sequential
result (sums of doubles may differ in their last bits).  The first blocks run from nothing, so a still video of any length
takes two passes; decisions that hang together over very many blocks in a way that no map foresees are walked in spans of consecutive blocks
that grow fourfold from the second repetition on.  The rows are kept once in slim form, and the table of block states is stored after each round.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reelscope.operators.blocks import BLOCK, borders, carried
from reelscope.session import stored as checkpointed  # kept as files; see there

#: Number of a run of consecutive blocks that one task walks through.
SPAN = "_span"
#: A block's number in the block table, whose rows are ordered by it.
AT = "_at"

Step = Callable[[dict | None, tuple], tuple[object, dict]]


def _walk(pdf: pd.DataFrame, keys: list[str], cols: list[str], step: Step, at: dict):
    """Fold one sorted batch, from the entry state of each key; ``at`` carries the open block between batches.

    Returns the values and, for every block that ended, (group and block, its first id, state it began with, state it ended with).
    """
    entries = pdf["_entry"].tolist() if "_entry" in pdf.columns else None
    values, closed = [], []
    key_rows = zip(*[pdf[k].tolist() for k in keys])
    rows = zip(*[pdf[c].tolist() for c in cols])
    for i, (key, row) in enumerate(zip(key_rows, rows)):
        if key != at.get("key"):
            if "key" in at:
                closed.append((*at["key"][1:], at["first"], at["began"], at["state"]))
            if key[:-1] != at.get("key", (None,))[:-1]:
                at["state"] = entries[i] if entries and isinstance(entries[i], dict) else None
            at["key"], at["first"], at["began"] = key, int(row[0]), at["state"]
        value, at["state"] = step(at["state"], row)
        values.append(value)
    return values, closed


def _alike(a: Column, b: Column, kind: T.StructType, added: tuple[str, ...]) -> Column:
    """Equal states; sums of doubles up to rounding."""
    def same(f: T.StructField) -> Column:
        x, y = a[f.name], b[f.name]
        if f.name in added and isinstance(f.dataType, T.DoubleType):
            return F.coalesce(F.abs(x - y) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x)), x.eqNullSafe(y))
        return x.eqNullSafe(y)

    both = same(kind.fields[0])
    for f in kind.fields[1:]:
        both = both & same(f)
    return (a.isNull() & b.isNull()) | (a.isNotNull() & b.isNotNull() & both)


def entries(table: DataFrame, group: list[str], kind: T.StructType, added: tuple[str, ...] | None, latest: tuple[str, ...], cuts) -> DataFrame:
    """The block table (group, block, _first, _began, _ended) with ``_entry``, the state that the maps before give each block."""
    numbered = carried(table.withColumnRenamed(BLOCK, AT), group, [AT], number="_rn", cuts=cuts)
    changed = ~F.col("_ended").eqNullSafe(F.col("_began"))
    lead = kind.fields[0].name
    restarts = changed if added is None else F.when(F.col("_began").isNull(), F.col("_ended")[lead] != F.col("_first")).otherwise(F.col("_ended")[lead] != F.col("_began")[lead])
    added = added or ()
    marked = numbered.withColumn("_set", restarts | (F.col("_rn") == 1))
    more = lambda f: F.when(F.col("_set"), F.lit(0)).otherwise(F.col("_ended")[f] - F.coalesce(F.col("_began")[f], F.lit(0)))
    if added:
        marked = carried(marked, group, [AT], sums={f"_a_{f}": more(f) for f in added}, cuts=cuts)
    last = F.struct(AT, "_ended", *[f"_a_{f}" for f in added])
    upto = carried(marked, group, [AT], maxima={"_last": F.when(F.col("_set"), last), "_newest": F.when(F.col("_set") | changed, F.struct(AT, "_ended"))}, cuts=cuts)

    def after(f: T.StructField) -> Column:
        base = F.col("_newest" if f.name in latest else "_last")["_ended"][f.name]
        return (base + F.col(f"_a_{f.name}") - F.col("_last")[f"_a_{f.name}"] if f.name in added else base).cast(f.dataType).alias(f.name)

    exits = upto.withColumn("_exit", F.struct(*[after(f) for f in kind.fields]))
    return carried(exits, group, [AT], previous={"_entry": "_exit"}, cuts=cuts).withColumnRenamed(AT, BLOCK).select(*table.columns, "_entry")


def block_fold(
    df: DataFrame, group: list[str], order: list[str], block: Column, cols: list[str], step: Step, state: str, out: str,
    added: tuple[str, ...] | None = None, latest: tuple[str, ...] = (),
) -> DataFrame:
    """Run ``step(state or None, row) -> (value, new state)`` over each group in order.

    ``cols`` are the columns handed to ``step``, first an integer id; ``state`` is the SQL type of the state (a struct);
    ``out`` defines the added column, such as ``"slot bigint"``.  ``step`` must not change the state it is given.

    ``added`` and ``latest`` say how the state goes through a block: the first field is the id of the row at which what it
    stands for began; while it stays, fields in ``added`` grow by amounts that do not depend on the state, fields in
    ``latest`` take new values, and others keep theirs.  Without ``added`` any change counts as a new state.
    """
    rows = df.withColumn(BLOCK, block)
    keys, walk = [*group, BLOCK], [SPAN, *group, BLOCK]
    key_fields = [f for f in rows.schema.fields if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))
    kind = T._parse_datatype_string(state)
    exit_schema = T.StructType([*key_fields, T.StructField("_first", T.LongType()), T.StructField("_began", kind), T.StructField("_ended", kind)])
    out_field = T._parse_datatype_string(out).fields[0]
    out_schema = T.StructType([*rows.schema.fields, out_field])
    names = [*keys, "_first", "_began", "_ended"]

    def exits(batches):
        at: dict = {}
        for pdf in batches:
            _, closed = _walk(pdf, walk, cols, step, at)
            if closed:
                yield pd.DataFrame(closed, columns=names)
        if "key" in at:
            yield pd.DataFrame([(*at["key"][1:], at["first"], at["began"], at["state"])], columns=names)

    def emit(batches):
        at: dict = {}
        for pdf in batches:
            values, _ = _walk(pdf, walk, cols, step, at)
            extra = pd.Series(values, index=pdf.index, dtype="object")
            done = pdf.drop(columns=["_entry", SPAN])
            done[out_field.name] = extra.astype("Int64") if isinstance(out_field.dataType, T.LongType) else extra
            yield done[[f.name for f in out_schema.fields]]

    def placed(frame: DataFrame) -> DataFrame:
        return frame.repartition(SPAN, *group).sortWithinPartitions(*walk, *order)

    def spans(frame: DataFrame, length: int) -> DataFrame:
        return frame.withColumn(SPAN, F.floor(F.col(BLOCK) / length))

    slim = checkpointed(rows.select(*dict.fromkeys([*keys, *order, *cols])))
    table = checkpointed(placed(spans(slim, 1)).mapInPandas(exits, exit_schema))
    cuts = borders(table.withColumnRenamed(BLOCK, AT), group, [AT])
    length, repeated = 1, 0
    while True:
        linked = entries(table, group, kind, added, latest, cuts)
        changed = checkpointed(linked.where(~_alike(F.col("_entry"), F.col("_began"), kind, added or ())).select(*keys, "_entry"))
        if changed.isEmpty():
            break
        length, repeated = length * 4 if repeated else 1, repeated + 1
        first = spans(changed, length).groupBy(SPAN, *group).agg(F.min(BLOCK).alias("_from"), F.min_by("_entry", BLOCK).alias("_entry"))
        todo = spans(slim, length).join(first, [SPAN, *group]).where(F.col(BLOCK) >= F.col("_from")).drop("_from")
        again = placed(todo).mapInPandas(exits, exit_schema).withColumnsRenamed({"_began": "_began2", "_ended": "_ended2"}).drop("_first")
        new = F.col("_ended2").isNotNull()
        table = checkpointed(table.join(again, keys, "left").select(
            *keys, "_first", F.when(new, F.col("_began2")).otherwise(F.col("_began")).alias("_began"),
            F.when(new, F.col("_ended2")).otherwise(F.col("_ended")).alias("_ended"),
        ))
    began = table.select(*keys, F.col("_began").alias("_entry"))
    return placed(spans(rows, 1).join(began, keys)).mapInPandas(emit, out_schema).drop(BLOCK)
