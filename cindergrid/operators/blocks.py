"""Windows over a cell's time by blocks: a cell of very many rows is shared out by stretches of time.

Values that a window would carry from far away come from a table of each block's ends, scanned over blocks; windows of a
bounded reach get copies of the neighbour blocks' rows within that reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.sources.tables import staged

#: Hours (or positions) in a block.
BLOCK = 720


def block_of(time: Column, length: int) -> Column:
    return F.floor(time / length).cast("long")


def in_blocks(rows: DataFrame, time: Column, length: int, before: int = 0, after: int = 0) -> DataFrame:
    """rows with __block and __own: each in its own block, and copied to blocks whose rows look `before` back or `after` ahead to it."""
    low, high = (F.floor((time + d) / length).cast("long") for d in (-after, before))
    return rows.withColumn("__block", F.explode(F.sequence(low, high))).withColumn("__own", F.col("__block") == block_of(time, length))


def carried(rows: DataFrame, columns: list[str], time: Column, length: int, cell: str = "cell_id", marked: Column | None = None, reach: int = 0) -> DataFrame:
    """rows with the columns carried forward, then leading nulls backward, by cell in time order.

    marked: also adds __soon, whether the condition holds for a later row of the cell at most `reach` ahead.
    """
    rows = staged(rows.withColumns({"__time": time, "__block": block_of(time, length)}))  # read twice
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("__time"))
    ends = [f(F.col(c), at(c)).alias(f"__{n}_{i}") for i, c in enumerate(columns) for n, f in (("first", F.min_by), ("last", F.max_by))]
    if marked is not None:
        rows = rows.withColumn("__mark", F.when(marked, F.col("__time")))
        ends.append(F.min("__mark").alias("__marked"))
    ends = rows.groupBy(cell, "__block").agg(*ends)
    w = W.partitionBy(cell).orderBy("__block")
    before, after, all_of = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    scan = {f"__in_{i}": F.coalesce(F.last(f"__last_{i}", True).over(before), F.first(f"__first_{i}", True).over(all_of)) for i in range(len(columns))}
    scan |= {"__later": F.first("__marked", True).over(after)} if marked is not None else {}
    ends = ends.withColumns(scan).select(cell, "__block", *scan)
    within = W.partitionBy(cell, "__block").orderBy("__time")
    back, ahead = within.rowsBetween(W.unboundedPreceding, 0), within.rangeBetween(1, reach)
    out = rows.join(ends, [cell, "__block"], "left")
    filled = {c: F.coalesce(F.last(c, True).over(back), F.col(f"__in_{i}")) for i, c in enumerate(columns)}
    if marked is not None:
        near = F.max("__mark").over(ahead).isNotNull() if reach >= 1 else F.lit(False)
        filled["__soon"] = near | F.coalesce(F.col("__later") - F.col("__time") <= reach, F.lit(False))
    return out.withColumns(filled).drop("__time", "__block", "__mark", *scan)
