"""The panel, example, tensor and graph jobs over the event and customer tables mapped onto a fixed lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindergrid.functions.expressions import epoch_hours, floor_time_bin, wind_features
from cindergrid.operators import edges, evaluate, graph, grid, knn, panel, tensor
from cindergrid.sources import tables

X0, Y0, SIZE, COLUMNS, ROWS = 500000.0, 4000000.0, 1000.0, 40, 1 << 20
K, HORIZON, LAGS = 8, 24, 6
TENSOR_FEATURES = ("frp_sum", "t2m_mean", "wind_speed_mean", "u10_mean", "v10_mean")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, j = F.col("user_id") % COLUMNS, F.floor(F.col("user_id") / COLUMNS)
    e = e.withColumn("x", X0 + SIZE * i + F.when(F.col("event_id") % 97 == 0, 0).otherwise(50 + 37 * (F.col("event_id") % 23))).withColumn("y", Y0 + SIZE * j + 50 + 41 * (F.col("event_id") % 19))
    return grid.assign_cells(e.withColumn("datetime", F.col("ts").cast("timestamp")), X0, Y0, SIZE, COLUMNS, ROWS)


def fire_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).where("event_type = 'error'")
    return p.select("cell_id", floor_time_bin(F.col("datetime"), 60).alias("datetime_bin"), F.col("value").alias("frp"), (300 + F.col("value") / 10).alias("brightness"))


def timed_points(spark: SparkSession, sf_dir: str, fire: bool) -> DataFrame:
    """Fire or weather points with their time, not yet binned."""
    p = points(spark, sf_dir).where("event_type = 'error'" if fire else "event_type <> 'error'")
    return p.select("cell_id", "datetime", F.col("value").alias("frp" if fire else "t2m"))


def weather_points(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    p = points(spark, sf_dir).where("event_type <> 'error'")
    s = F.col("user_id") % 10
    p = p.select("cell_id", floor_time_bin(F.col("datetime"), minutes).alias("datetime_bin"), F.col("value").alias("t2m"), ((7 * F.col("event_id")) % 21 - 10).alias("u10"), ((13 * F.col("event_id")) % 17 - 8).alias("v10"), (36 + 0.03 * s).alias("lat"), (-120 + 0.04 * ((3 * s) % 10)).alias("lon"))
    return wind_features(p)


def topo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    i, j = F.col("c_custkey") % COLUMNS, F.floor(F.col("c_custkey") / COLUMNS) % 38
    c = c.withColumns({"i": i, "j": j}).where("(i + 7 * j) % 13 <> 5")
    return c.select(F.format_string("cell_%d_%d", "i", "j").alias("cell_id"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal").cast("double")).alias("elevation"), ((F.col("c_custkey") * 7919) % 45).cast("double").alias("slope"), F.col("c_mktsegment").alias("landcover"))


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.join_panel_sparse(panel.aggregate_weather(weather_points(spark, sf_dir)), panel.aggregate_fire(fire_points(spark, sf_dir)))
    return p.withColumn("epoch_hr", epoch_hours(F.col("datetime_bin")))


def panel_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a written stage, for jobs that read it in several steps."""
    return tables.staged(hourly_panel(spark, sf_dir))


def centroids(cells: DataFrame) -> DataFrame:
    part = lambda n: F.split_part("cell_id", F.lit("_"), F.lit(n)).cast("double")
    return cells.select("cell_id").distinct().select("cell_id", (X0 + SIZE * part(2) + SIZE / 2).alias("x"), (Y0 + SIZE * part(3) + SIZE / 2).alias("y"))


def pairs(p: DataFrame) -> DataFrame:
    return knn.knn_pairs(centroids(p), K)


def labelled(p: DataFrame) -> DataFrame:
    """Candidates without burning targets, with label."""
    return edges.label_spread(edges.drop_burning_targets(edges.edge_candidates(p, pairs(p))), edges.filter_burning(p), HORIZON)


def examples(p: DataFrame, static: DataFrame) -> DataFrame:
    """Labelled candidates with trend, neighbourhood, geometry, wind along the edge and both ends' static columns; nulls are 0."""
    c = edges.neighbor_stats(edges.edge_candidates(p, pairs(p), LAGS, ("wind_dir_deg_mean",)))
    e = edges.label_spread(edges.drop_burning_targets(c), edges.filter_burning(p), HORIZON)
    e = edges.edge_geometry(e, centroids(p), "wind_dir_deg_mean_src")
    return edges.join_static_pair(e, static).drop("wind_dir_deg_mean_src", "seen").na.fill(0).na.fill(False)


def static_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain numbers by cell."""
    return panel.aggregate_static(topo_points(spark, sf_dir), ["elevation", "slope"])


def scored(p: DataFrame) -> DataFrame:
    """Labelled edges with a made-up deterministic score that has ties."""
    e = edges.edge_geometry(labelled(p), centroids(p))
    whole = F.col("time_epoch") * 31 + 7 * (F.col("vec_dx") / 1000).cast("long") + 13 * (F.col("vec_dy") / 1000).cast("long")
    return e.withColumn("pred_proba", F.pmod(whole, F.lit(1000)) / 1000)


def spread_graph(p: DataFrame, how: str) -> DataFrame:
    pr = tables.staged(pairs(p))
    return graph.normalize_adjacency(graph.symmetrize(graph.weighted_edges(pr, graph.median_scale(pr))), how)


def spread_tensor(p: DataFrame) -> DataFrame:
    return tensor.build_tensor(p, list(TENSOR_FEATURES), HORIZON)


def wind_graph(p: DataFrame) -> DataFrame:
    pr, cells = tables.staged(pairs(p)), centroids(p)
    return graph.weighted_edges(pr, graph.median_scale(pr), graph.mean_wind(p), cells, 0.5)


def evaluation(p: DataFrame) -> DataFrame:
    return evaluate.average_precision(scored(p))
