"""Places of rows in an order, without sorting them in one task: parts are counted, and rows sorted within their part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.sources.tables import staged


def places(rows: DataFrame, part: str, order: list[str], group: list[str] = (), name: str = "place") -> DataFrame:
    """rows with their place from 1 in ascending (part, order), by group; the parts are few enough to be added up in one task."""
    sums = rows.groupBy(*group, part).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group or [F.lit(0)]).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy(*group, part).orderBy(*order))
    return rows.join(F.broadcast(sums), [*group, part]).withColumn(name, F.col("__before") + within).drop("__before")


def hash_places(rows: DataFrame, key: list[str], seed: int, group: list[str] = ()) -> DataFrame:
    """rows with their place in a seeded random order, by group: that of the MD5 of the key. 65536 parts at most."""
    columns = rows.columns
    rows = rows.withColumn("__md5", F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in key), F.lit(str(seed)))))
    rows = rows.withColumn("__part", F.substring("__md5", 1, 4))
    return places(rows, "__part", ["__md5"], list(group)).select(*columns, "place")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows numbered from 0 in ascending order: ranges of about equal size, a task each."""
    ranges = staged(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    return places(ranges, "__range", order, name=name).withColumn(name, (F.col(name) - 1).cast("int")).drop("__range")
