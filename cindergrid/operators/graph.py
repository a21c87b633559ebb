"""Weighted neighbour graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.functions.expressions import angle_deg, distance_kernel, wind_reweight


def node_coords(nodes: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cell_id, x, y): null coordinates where the grid has none."""
    return nodes.select("cell_id").distinct().join(centroids.select("cell_id", "x", "y"), "cell_id", "left")


def missing_nodes(nodes: DataFrame) -> int:
    """How many nodes lack a coordinate."""
    return nodes.where("x is null or y is null").count()


def mean_wind(panel: DataFrame, u: str = "u10_mean", v: str = "v10_mean") -> DataFrame:
    """(cell_id, wind_deg): direction of the mean wind, null if either mean is."""
    return panel.groupBy("cell_id").agg(F.avg(u).alias("u"), F.avg(v).alias("v")).select("cell_id", angle_deg(F.col("v"), F.col("u")).alias("wind_deg"))


def median_scale(pairs: DataFrame, parts: int = 4096) -> float:
    """The exact median of dist_m, 0 without one.

    A range of values is parted evenly and its parts counted; the part with the wanted rank is the next range, until it holds one
    value. No task holds more than a part's count, least and greatest value for each of the parts.
    """
    d = F.col("dist_m").cast("double")
    values = pairs.where(d.isNotNull()).select(d.alias("d"))
    n, low, high = values.agg(F.count("*"), F.min("d"), F.max("d")).first()
    if not n:
        return 0.0
    rank, upper = (n - 1) // 2, n  # the lower middle's place in the range, and how many values the range holds
    while low < high:
        part = F.least(F.lit(parts - 1), F.floor((F.col("d") - low) / (high - low) * parts))
        counts = values.where(F.col("d").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
        for r in sorted(counts.collect()):
            if rank < r.n:
                low, high, upper = r.low, r.high, r.n
                break
            rank -= r.n
    if n % 2 or rank + 1 < upper:
        return low
    after = values.where(F.col("d") > low).agg(F.min("d")).first()[0]
    return 0.5 * low + 0.5 * after


def weighted_edges(pairs: DataFrame, scale: float, wind: DataFrame | None = None, coords: DataFrame | None = None, strength: float = 0.0) -> DataFrame:
    """(src, dst, weight) of kNN pairs: distance kernel, stronger along the source's mean wind."""
    out = pairs.select(F.col("source").alias("src"), F.col("target").alias("dst"), distance_kernel(F.col("dist_m"), F.lit(scale)).alias("weight"))
    if wind is None or coords is None or not strength:
        return out
    for side in ("src", "dst"):
        out = out.join(coords.select(F.col("cell_id").alias(side), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y")), side, "left")
    out = out.join(wind.withColumnRenamed("cell_id", "src"), "src", "left")
    angle = angle_deg(F.col("dst_y") - F.col("src_y"), F.col("dst_x") - F.col("src_x"))
    return out.select("src", "dst", wind_reweight(F.col("weight"), F.col("wind_deg"), angle, strength).alias("weight"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """A plus its transpose."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").union(back).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def normalize_adjacency(edges: DataFrame, how: str = "rw") -> DataFrame:
    """rw: by the row sum; sym: by the root of both row sums; none. A row sum of zero counts as one."""
    if how == "none":
        return edges
    if how not in ("rw", "sym"):
        raise ValueError(how)
    sums = edges.groupBy("src").agg(F.sum("weight").alias("s")).withColumn("s", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    out = edges.join(sums, "src")
    if how == "rw":
        return out.select("src", "dst", (F.col("weight") / F.col("s")).alias("weight"))
    out = out.join(sums.select(F.col("src").alias("dst"), F.col("s").alias("t")), "dst", "left")
    return out.select("src", "dst", (F.col("weight") / F.sqrt(F.col("s") * F.coalesce("t", F.lit(1.0)))).alias("weight"))
