"""Exact nearest neighbours among cells, and imputation from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.operators.nearest import near_pairs


def knn_pairs(cells: DataFrame, k: int, include_self: bool = False, queries: DataFrame | None = None, on_missing: str = "skip") -> DataFrame:
    """(source, target, dist_m): each cell's min(k, n - 1) nearest others (k with itself) of cells (cell_id, x, y); ties by target id.

    Cells with null coordinates take no part or, with on_missing="error", are an error. queries: the sources, where these aren't the
    cells; a source that is a cell is its own neighbour then. Cells meet in the leaves of a counted tree (nearest.py).
    """
    if on_missing == "error" and (lost := cells.where("x is null or y is null").first()):
        raise ValueError(f"no coordinates for {lost.cell_id}")
    placed = lambda df: df.select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().dropDuplicates(["cell_id"])
    include_self = include_self or queries is not None
    wanted = max(k, 1) if include_self else k + 1  # a cell is among its own nearest
    pairs = near_pairs(placed(cells if queries is None else queries), placed(cells), ["x", "y"], wanted, ["cell_id"], same=queries is None)
    pairs = pairs.select(F.col("q_cell_id").alias("source"), F.col("t_cell_id").alias("target"), F.sqrt((F.col("t_x") - F.col("q_x")) ** 2 + (F.col("t_y") - F.col("q_y")) ** 2).alias("dist_m"))
    if not include_self:
        pairs = pairs.where("source <> target")
    near = pairs.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("dist_m", "target"))).where(F.col("r") <= k)
    return near.select("source", "target", "dist_m")


def knn_impute(static: DataFrame, centroids: DataFrame, k: int, numeric: list[str], categorical: list[str] = (), panel_cells: DataFrame | None = None, keep_new_cells: bool = False) -> DataFrame:
    """Null numbers become the mean, null categories the mode, over the k nearest static cells (a cell is its own nearest).

    Numbers still null take the column's mean. keep_new_cells also makes rows for panel cells that static lacks.
    """
    places = centroids.select("cell_id", "x", "y")
    known = static.select("cell_id").distinct()
    wanted = known if panel_cells is None or not keep_new_cells else known.union(panel_cells.select("cell_id")).distinct()
    pairs = knn_pairs(places.join(known, "cell_id"), k, include_self=True, queries=None if wanted is known else places.join(wanted, "cell_id"))
    values = pairs.join(static.select(F.col("cell_id").alias("target"), *numeric, *categorical), "target")
    rule = values.groupBy(F.col("source").alias("cell_id")).agg(*(F.avg(c).alias(f"{c}__k") for c in numeric), *(F.mode(c, True).alias(f"{c}__k") for c in categorical))
    means = static.agg(*(F.avg(c).alias(f"{c}__m") for c in numeric)).first() if numeric else {}
    out = wanted.join(static, "cell_id", "left").join(rule, "cell_id", "left")
    fill = {c: F.coalesce(c, f"{c}__k", F.lit(means[f"{c}__m"])) for c in numeric} | {c: F.coalesce(c, f"{c}__k") for c in categorical}
    return out.withColumns(fill).drop(*(f"{c}__k" for c in (*numeric, *categorical)))
