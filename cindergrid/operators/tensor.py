"""Node by time tensors in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.operators.blocks import BLOCK, carried
from cindergrid.operators.places import numbered


def filter_time_range(panel: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    if low is not None:
        panel = panel.where(F.col("epoch_hr") >= low)
    return panel if high is None else panel.where(F.col("epoch_hr") <= high)


def tensor_axis(panel: DataFrame, step: int = 1, low: int | None = None, high: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(cell_id, t_idx, epoch_hr) of every panel cell, or every one of nodes, and every step hours between the panel's ends (or those given)."""
    a, b = panel.agg(F.min("epoch_hr"), F.max("epoch_hr")).first()
    if a is None:
        return panel.select("cell_id", F.lit(0).alias("t_idx"), "epoch_hr")
    a, b = a if low is None else low, b if high is None else high
    hours = F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(step).cast("long")) if b >= a else F.array().cast("array<bigint>")
    return (panel if nodes is None else nodes).select("cell_id").distinct().select("cell_id", F.posexplode(hours).alias("t_idx", "epoch_hr"))


def node_index(panel: DataFrame) -> DataFrame:
    """(cell_id, node_idx): cells in order, numbered from 0; a row per node."""
    return numbered(panel.select("cell_id").distinct(), ["cell_id"], "node_idx")


def build_tensor(panel: DataFrame, features: list[str], horizon: int = 24, step: int = 1, low: int | None = None, high: int | None = None, nodes: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Axis with filled features and y_current, y_future.

    An absent slot is 0; a null in a slot that is there takes the slot before (zeros included), leading ones the first value. y_future
    is 1 where the cell doesn't burn and burns within the next `horizon` positions. Nodes are shared out by blocks of positions.
    """
    rows = panel.groupBy("cell_id", "epoch_hr").agg(*(F.max(c).alias(c) for c in features), F.max("fire_any").alias("fire_any"))
    out = tensor_axis(panel, step, low, high, nodes).join(rows.withColumn("there", F.lit(True)), ["cell_id", "epoch_hr"], "left")
    out = out.withColumns({c: F.when(F.col("there"), F.col(c)).otherwise(0.0) for c in features} | {"y_current": F.coalesce(F.col("fire_any").cast("int"), F.lit(0))})
    out = carried(out, features, F.col("t_idx"), block, marked=F.col("y_current") == 1, reach=horizon)
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)).cast("float") for c in features})
    return out.withColumn("y_future", F.when((F.col("y_current") == 0) & F.col("__soon"), 1).otherwise(0)).drop("there", "fire_any", "__soon")


def tensor_static(nodes: DataFrame, static: DataFrame) -> DataFrame:
    cols = [c for c, t in static.dtypes if c != "cell_id" and t in ("double", "float", "int", "bigint")]
    return nodes.select("cell_id").distinct().join(static.select("cell_id", *cols), "cell_id", "left").na.fill(0, cols)


def pack_tensor(tensor: DataFrame, features: list[str]) -> DataFrame:
    """One row per node: x as an array (time) of arrays (features)."""
    rows = tensor.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("t_idx", F.array(*features).alias("f"), "y_current", "y_future"))).alias("r"))
    return rows.select("cell_id", F.transform("r", lambda r: r["f"]).alias("x"), F.transform("r", lambda r: r["y_current"]).alias("y_current"), F.transform("r", lambda r: r["y_future"]).alias("y_future"))


def tensor_stats(tensor: DataFrame, features: list[str]) -> DataFrame:
    """One row: least, greatest and mean feature value, nulls, positives, share of positives, nodes, times, and whether every node has all times.

    One pass: sums for each node, then over the nodes. Times are the positions up to the last.
    """
    least, most = (F.least, F.greatest) if len(features) > 1 else (lambda c: F.col(c),) * 2
    each = [F.min(least(*features)).alias("x_min"), F.max(most(*features)).alias("x_max"), F.sum("y_future").alias("positives"), F.count("*").alias("cells"), F.max("t_idx").alias("last")]
    each += [f(c).alias(f"__{n}_{i}") for i, c in enumerate(features) for n, f in (("sum", lambda c: F.sum(F.col(c).cast("double"))), ("n", F.count))]
    nodes = tensor.groupBy("cell_id").agg(*each)
    mean = sum(F.try_divide(F.sum(f"__sum_{i}"), F.sum(f"__n_{i}")) for i in range(len(features))) / len(features)
    nulls = sum(F.sum("cells") - F.sum(f"__n_{i}") for i in range(len(features)))
    times = F.max("last") + 1
    totals = [F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), mean.alias("x_mean"), nulls.alias("x_nulls"), F.sum("positives").alias("positives"), (F.sum("positives") / F.sum("cells")).alias("positive_share")]
    return nodes.agg(*totals, F.count("*").alias("nodes"), times.cast("long").alias("times"), ((F.min("cells") == F.max("cells")) & (F.max("cells") == times)).alias("full_axis"))


def static_stats(static: DataFrame) -> DataFrame:
    """One row: least, greatest and mean static value, nulls, nodes."""
    cols = [c for c in static.columns if c != "cell_id"]
    long = static.select("cell_id", F.explode(F.array(*(F.col(c).cast("double") for c in cols))).alias("v"))
    return long.agg(F.min("v").alias("static_min"), F.max("v").alias("static_max"), F.avg("v").alias("static_mean"), F.count_if(F.col("v").isNull()).alias("static_nulls"), F.count_distinct("cell_id").alias("static_nodes"))


def tensor_checks(tensor: DataFrame, features: list[str], static: DataFrame) -> DataFrame:
    """tensor_stats and static_stats with same_nodes and full_axis: whether both have as many nodes, and every node all times."""
    both = tensor_stats(tensor, features).crossJoin(static_stats(static))  # one row each
    return both.withColumn("same_nodes", F.col("nodes") == F.col("static_nodes"))
