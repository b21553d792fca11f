"""Greedy batches by size over the ordered rows of a group, without a task
that holds a group.

Walking a group's rows in order, a batch takes rows while their sizes stay
within the budget (a row above the budget is a batch of its own). Where a batch
ends depends on where it began, so the walk looks serial; here it is done in
steps that each shuffle narrow rows only:

1. Positions and the sizes of all rows before, as prefix sums (``ordered_sums``).
2. For every row, the row that would begin the next batch if one began here.
   Rows are intervals that tile the line of summed sizes, and the next batch
   begins in the interval that holds ``start + budget``. The line is cut into
   stretches of one budget, and inside a stretch one ordered window finds the
   interval; a stretch holds at most as many rows as the budget has units.
3. Runs of ``SEGMENT_ROWS`` positions are contracted: for every row, the first
   batch start behind its run, if a batch began here (from the last row back).
4. The runs' entry points that are reached from the first row are found by pointer
   doubling: ``log2`` of the number of runs rounds of two joins.
5. Inside each run, starts are walked from its entry; batch numbers are their
   running count plus the starts of the runs before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import ordered_sums
from quarry.sinks.tables import materialize

SEGMENT_ROWS = 4096


def _next_starts(p: DataFrame, group: list[str], budget: int, most: int | None, least: int) -> DataFrame:
    """Add ``next`` to rows (…group, pos, start, size): the position at which
    the batch after one that begins here begins; NULL behind the last row."""
    first = F.floor(F.col("start") / F.lit(budget)).cast("bigint")
    last = F.floor((F.col("start") + F.col("size") - 1) / F.lit(budget)).cast("bigint")
    row = F.struct("pos", (F.col("start") + F.col("size")).alias("end"))
    tiles = p.select(*group, F.explode(F.sequence(first, last)).alias("stretch"), "start", row.alias("row"))
    tiles = tiles.select(*group, "stretch", F.greatest("start", F.col("stretch") * budget).alias("at"), "row",
                         F.lit(None).cast("bigint").alias("asks"))
    asks = p.select(*group, (first + 1).alias("stretch"), (F.col("start") + budget).alias("at"),
                    F.lit(None).cast(tiles.schema["row"].dataType).alias("row"), F.col("pos").alias("asks"))
    upto = Window.partitionBy(*group, "stretch").orderBy("at", F.col("asks").isNotNull()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    met = tiles.unionByName(asks).withColumn("hit", F.last("row", ignorenulls=True).over(upto)).filter("asks IS NOT NULL")
    there = F.when(F.col("at") < F.col("hit.end"), F.col("hit.pos"))
    found = met.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("asks").alias("__pos"), there.alias("found"))
    same = F.col("pos") == F.col("__pos")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    nxt = F.greatest("found", F.col("pos") + least)               # NULL (behind the last row) is skipped by greatest
    nxt = F.when(F.col("found").isNotNull(), nxt)
    if most is not None:
        nxt = F.least(nxt, F.col("pos") + most)                   # and by least
    return p.join(found, same).withColumn("next", nxt).select(*p.columns, "next")


def _exits(batch):
    """For every row of a run: the first start behind the run."""
    import numpy as np
    import pyarrow as pa
    order = np.argsort(batch["pos"].to_numpy())
    batch = batch.take(pa.array(order))
    pos, nxt = batch["pos"].to_numpy(), batch["next"].fill_null(-1).to_numpy()
    end, out = pos[-1] + 1, nxt.copy()
    for i in range(len(pos) - 1, -1, -1):
        if 0 <= nxt[i] < end:
            out[i] = out[nxt[i] - pos[0]]
    exits = pa.array(out, pa.int64(), mask=out < 0)
    return batch.select([c for c in batch.column_names if c not in ("next", "segment")]).append_column("exit", exits)


def _walk(batch):
    """Starts met from the run's entry: their running number in the run."""
    import numpy as np
    import pyarrow as pa
    order = np.argsort(batch["pos"].to_numpy())
    batch = batch.take(pa.array(order))
    pos, nxt = batch["pos"].to_numpy(), batch["next"].fill_null(-1).to_numpy()
    starts = np.zeros(len(pos), np.int64)
    at = batch["entry"][0].as_py()
    while at is not None and 0 <= at - pos[0] < len(pos):
        starts[at - pos[0]] = 1
        at = int(nxt[at - pos[0]])
    return batch.select([c for c in batch.column_names if c not in ("next", "entry")]).append_column(
        "nth", pa.array(np.cumsum(starts)))


def batches_by_size(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str, budget: int,
                    most: int | None = None, least: int = 1, batch: str = "batch", batches: str = "batches",
                    segment_rows: int | None = None) -> DataFrame:
    """Add ``pos`` (0-based position in ``order``, which must tell the rows of a
    group apart), ``batch`` (0-based) and ``batches`` (of the group).

    A batch's sizes sum to ``budget`` at most, unless it holds ``least`` rows;
    it holds ``most`` rows at most. Sizes below 1 count as 1. ``df`` should be
    narrow: its rows are shuffled in every step."""
    group, segment_rows = list(group), segment_rows or SEGMENT_ROWS
    if budget < 1 or least < 1 or (most is not None and most < least):
        raise ValueError("budget and least are 1 or more, most is not below least")
    rows = df.withColumn("__size", F.greatest(F.col(size).cast("bigint"), F.lit(1).cast("bigint"))).withColumn("__one", F.lit(1))
    placed = ordered_sums(rows, group, order, {"__one": "pos", "__size": "__start"}).drop("__one")
    placed = materialize(placed, "batch-positions")
    narrow = placed.select(*group, "pos", F.col("__start").alias("start"), F.col("__size").alias("size"))
    segment = F.floor(F.col("pos") / F.lit(segment_rows)).cast("bigint").alias("segment")
    steps = materialize(_next_starts(narrow, group, budget, most, least).select(*group, "pos", "next", segment), "batch-steps")
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    named = ", ".join(f"`{c}` {kinds[c]}" for c in group)
    schema = (named + ", " if named else "")

    entries = steps.filter("pos = 0").select(*group, "pos")
    if steps.filter("segment > 0").limit(1).count():
        exits = steps.groupBy(*group, "segment").applyInArrow(_exits, schema + "pos bigint, exit bigint")
        exits = materialize(exits, "batch-exits")
        # only entry points go on: rows that some run exits to, and the first row
        doors = exits.filter("exit IS NOT NULL").select(*group, F.col("exit").alias("pos")).unionByName(entries).distinct()
        hops = materialize(_matched(exits, doors, group, "pos", "left_semi").filter("exit IS NOT NULL"), "batch-hops")
        while not hops.isEmpty():
            on = _renamed(hops, group)
            entries = materialize(entries.unionByName(
                _joined(entries, on, group, F.col("pos")).select(*group, F.col("__exit").alias("pos"))).distinct(), "batch-entries")
            hops = materialize(_joined(hops, on, group, F.col("exit")).select(*group, "pos", F.col("__exit").alias("exit")), "batch-hops")
    entries = _matched(entries, steps.select(*group, "pos"), group, "pos", "left_semi")     # none behind the last row
    entries = _renamed(entries.select(*group, F.floor(F.col("pos") / F.lit(segment_rows)).cast("bigint").alias("segment"),
                                      F.col("pos").alias("entry")), group)
    same = F.col("segment") == F.col("__segment")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    walked = steps.join(entries, same, "left").select(*group, "segment", "pos", "next", F.col("__entry").alias("entry")) \
        .groupBy(*group, "segment").applyInArrow(_walk, schema + "segment bigint, pos bigint, nth bigint")
    walked = materialize(walked, "batch-starts")
    before = Window.partitionBy(*group).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    runs = walked.groupBy(*group, "segment").agg(F.max("nth").alias("n")) \
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))) \
        .withColumn("all", F.sum("n").over(Window.partitionBy(*group)))              # a row for each run
    numbers = _joined(walked, _renamed(runs.select(*group, "segment", "before", "all"), group), group, F.col("segment"), "__segment") \
        .select(*group, "pos", (F.col("__before") + F.col("nth") - 1).alias("b"), F.col("__all").alias("all"))
    out = _joined(placed, _renamed(numbers, group), group, F.col("pos"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("pos", batch, batches)]
    return out.select(*kept, F.col("pos").cast("bigint").alias("pos"), F.col("__b").cast("bigint").alias(batch),
                      F.col("__all").cast("bigint").alias(batches))


def _renamed(df: DataFrame, group: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in df.columns])


def _joined(left: DataFrame, right: DataFrame, group: list[str], key, right_key: str = "__pos") -> DataFrame:
    same = key == F.col(right_key)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(right, same)


def _matched(left: DataFrame, right: DataFrame, group: list[str], key: str, how: str) -> DataFrame:
    same = F.col(key) == F.col(f"__{key}")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(_renamed(right, group), same, how)
