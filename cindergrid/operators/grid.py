"""Regular grids, cell assignment and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.functions.expressions import utm_zone


def bounds(points: DataFrame, x: str = "x", y: str = "y") -> tuple | None:
    """(xmin, xmax, ymin, ymax), four numbers; None without points."""
    r = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return None if r[0] is None else tuple(map(float, r))


def choose_zone(points: list[DataFrame], lon: str = "lon", lat: str = "lat") -> tuple[int, bool]:
    """UTM zone of the centre of the first point table that has rows."""
    for df in points:
        if b := bounds(df, lon, lat):
            return utm_zone((b[0] + b[1]) / 2, (b[2] + b[3]) / 2)
    raise ValueError("no points")


def concat_points(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def shape(box: tuple, size: float) -> tuple[int, int]:
    """Cells along x and y: enough to cover the width, none for a width of zero."""
    n = lambda low, high: int(-(-(high - low) // size))
    return n(box[0], box[1]), n(box[2], box[3])


def build_grid(spark, box: tuple, size: float) -> DataFrame:
    """(cell_id, i, j, box, centroid) of every cell over the bounds; made by Spark from two numbers."""
    nx, ny = shape(box, size)
    ij = spark.range(nx * ny).select((F.col("id") / max(ny, 1)).cast("int").alias("i"), F.pmod("id", F.lit(max(ny, 1))).cast("int").alias("j"))
    grid = ij.select(F.format_string("cell_%d_%d", "i", "j").alias("cell_id"), "i", "j", (box[0] + F.col("i") * size).alias("xmin"), (box[2] + F.col("j") * size).alias("ymin"))
    grid = grid.withColumns({"xmax": F.col("xmin") + size, "ymax": F.col("ymin") + size})
    return grid.withColumns({"centroid_x": (F.col("xmin") + F.col("xmax")) / 2, "centroid_y": (F.col("ymin") + F.col("ymax")) / 2})


def assign_cells(points: DataFrame, x0: float, y0: float, size: float, nx: int, ny: int, x: str = "x", y: str = "y") -> DataFrame:
    """points with cell_id: the cell strictly around the point, by the bounds that build_grid computes; null outside, on an edge or
    without coordinates. The quotient gives a candidate, and as it may be off by a rounding error, its neighbours are tried too. No join.

    Coordinate and candidate are bound as variables of array functions: written out they would stand dozens of times in each plan
    that filters or groups by cell_id.
    """

    def exact(c, low, n):
        def tried(v):
            i = F.floor((v - low) / size).cast("double")
            return F.transform(F.array(i - 1, i, i + 1), lambda k: F.when((v > low + k * size) & (v < low + k * size + size) & k.between(0, n - 1), k.cast("long")))

        return F.get(F.filter(F.get(F.transform(F.array(c), tried), F.lit(0)), F.isnotnull), F.lit(0)).cast("string")

    return points.withColumn("cell_id", F.concat(F.lit("cell_"), exact(x, x0, nx), F.lit("_"), exact(y, y0, ny)))


def grid_coverage(grid: DataFrame, panel: DataFrame) -> DataFrame:
    """Each cell's number of panel rows, and whether it has any."""
    n = panel.groupBy("cell_id").agg(F.count("*").alias("n"))
    return grid.join(n, "cell_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("in_panel", F.col("n") > 0)


def stage_summary(name: str, df: DataFrame, time: str | None = None) -> DataFrame:
    """One row: rows, distinct cells, first and last bin."""
    span = [F.min(time).alias("first_bin"), F.max(time).alias("last_bin")] if time else [F.lit(None).cast("timestamp").alias("first_bin"), F.lit(None).cast("timestamp").alias("last_bin")]
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("cell_id").alias("cells"), *span).select(F.lit(name).alias("stage"), "*")


def stage_sketches(df: DataFrame, time: str) -> DataFrame:
    """(day, n_rows, first_bin, last_bin, cells): a row for each day, cells a mergeable sketch of the distinct ones; kept beside a stage."""
    return df.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n_rows"), F.min(time).alias("first_bin"), F.max(time).alias("last_bin"), F.hll_sketch_agg("cell_id", 14).alias("cells"))


def sketched_summary(name: str, sketches: DataFrame) -> DataFrame:
    """stage_summary from the days' sketches, without the stage; cells is off by about 1 in 100."""
    out = sketches.agg(F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("cells")).alias("cells"), F.min("first_bin").alias("first_bin"), F.max("last_bin").alias("last_bin"))
    return out.select(F.lit(name).alias("stage"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("cells", F.lit(0)).alias("cells"), "first_bin", "last_bin")
