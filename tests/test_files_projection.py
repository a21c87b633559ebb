"""Tensor blocks, refreshed days, adjacency meta, sketches; projection against published and integrated values."""

import cmath
import math
import os

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.functions import expressions as x
from cindergrid.operators import graph, grid, panel, tensor
from cindergrid.plans import spread
from cindergrid.sources import tables

SF = "/root/testdata/sf0.001"


def projected(spark, places, zone=31):
    df = spark.createDataFrame(places, "lon double, lat double").withColumn("id", F.monotonically_increasing_id()).coalesce(1)
    e, n = x.project_utm(F.col("lon"), F.col("lat"), zone)
    lon, lat = x.unproject_utm(F.col("e"), F.col("n"), zone)
    return df.withColumns({"e": e, "n": n}).withColumns({"lon2": lon, "lat2": lat}).orderBy("id").collect()


def test_published_place(spark):
    r = projected(spark, [(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)], 17)[0]
    assert abs(r.e - 630084) < 1 and abs(r.n - 4833438) < 1  # published in whole metres


def test_projection_is_the_conformal_one_with_a_true_meridian(spark):
    """A transverse Mercator projection is what is conformal and true to length (times its scale) on the middle meridian."""
    e2 = x.WGS84_F * (2 - x.WGS84_F)
    curve = lambda t: x.WGS84_A * (1 - e2) / (1 - e2 * math.sin(t) ** 2) ** 1.5
    lats = [0.0, 5.0, 33.3, 61.0, 84.0]
    for r in projected(spark, [(3.0, v) for v in lats]):
        top, n = math.radians(r.lat), 20000
        arc = sum(curve(top * i / n) * (1 if i in (0, n) else 4 if i % 2 else 2) for i in range(n + 1)) * top / n / 3
        assert abs(r.e - 500000) < 1e-6 and abs(r.n - x.UTM_SCALE * arc) < 1e-5
    step = 1e-4
    for lon, lat in ((0.2, 10.0), (5.9, 47.0), (3.5, 79.0), (1.0, 0.0)):
        east, west, north, south = projected(spark, [(lon + step, lat), (lon - step, lat), (lon, lat + step), (lon, lat - step)])
        wide = math.cos(math.radians(lat)) * x.WGS84_A / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
        along, up = complex(east.e - west.e, east.n - west.n) / wide, complex(north.e - south.e, north.n - south.n) / curve(math.radians(lat))
        assert abs(up / along - 1j) < 1e-7 and abs(cmath.phase(along)) < 1
    for r in projected(spark, [(lon, lat) for lon in (-3.0, 0.0, 3.1, 8.0) for lat in (-60.0, 0.0, 1e-6, 45.0, 83.0)]):
        assert abs(r.lon - r.lon2) < 1e-10 and abs(r.lat - r.lat2) < 1e-10


def test_written_tensor_needs_no_exchange_by_node(spark, tmp_path):
    rows = [(f"c{c}", 10 + h, float(h) if h % 3 else None, h % 4 == 0) for c in range(9) for h in range(30)]
    t = tensor.build_tensor(spark.createDataFrame(rows, "cell_id string, epoch_hr long, f double, fire_any boolean"), ["f"], 3)
    path = f"file://{tmp_path}/t"
    static = spark.createDataFrame([("c0", 1.5, "u"), ("c1", None, "v")], "cell_id string, e double, land string")
    tables.write_tensor(t, ["f"], {"horizon": 3}, path, static, tensor.node_index(t), buckets=4, block=7)
    blocks, meta = tables.read_tensor(spark, path)
    assert meta == {"horizon": 3, "features": ["f"], "buckets": 4, "block": 7, "static": ["e"]} and blocks.count() == 9 * 5
    back = tables.unpack_tensor(blocks, meta["features"])
    key = ["cell_id", "t_idx", "f", "y_current", "y_future"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, t.select(key).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = back.withColumn("before", F.lag("f").over(W.partitionBy("cell_id").orderBy("t_idx")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" in plan and "Exchange" not in plan
    assert {r.cell_id: r.e for r in tables.read_stage(spark, f"{path}/static").collect()} == {"c0": 1.5, "c1": 0.0}
    assert {r.node_idx for r in tables.read_stage(spark, f"{path}/nodes").collect()} == set(range(9))


def test_refreshing_a_day_rewrites_it_alone(spark, tmp_path):
    weather, fire = panel.aggregate_weather(spread.weather_points(spark, SF)), panel.aggregate_fire(spread.fire_points(spark, SF))
    path, whole = f"file://{tmp_path}/p", panel.join_panel_sparse(weather, fire)
    tables.write_panel(whole, path)
    first = whole.agg(F.min(F.to_date("datetime_bin"))).first()[0]
    doubled = fire.withColumn("frp_sum", F.col("frp_sum") * 2)
    at = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{tmp_path}/p") for f in names if f.endswith(".parquet")}
    before = at()
    panel.refresh_days(spark, path, doubled, [str(first)])
    after = at()
    own = [f for f in before if f"day={first}" in f]
    assert own and not set(own) & set(after) and {f: t for f, t in before.items() if f not in own} == {f: t for f, t in after.items() if f"day={first}" not in f}
    cols = ["cell_id", "datetime_bin", "t2m_mean", "frp_sum", "fire_count", "fire_any"]
    full = panel.refresh_panel_fire(whole, doubled)
    want = full.where(F.to_date("datetime_bin") == F.lit(first)).select(cols).union(whole.where(F.to_date("datetime_bin") != F.lit(first)).select(cols))
    key = lambda df: sorted(repr(tuple(r)) for r in df.select(cols).withColumns({c: F.round(c, 6) for c in ("t2m_mean", "frp_sum")}).collect())
    assert key(tables.read_stage(spark, path)) == key(want)


def test_adjacency_meta_and_sketches(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 2.0)], "source string, target string, dist_m double")
    scale = graph.median_scale(pairs)
    edges = graph.symmetrize(graph.weighted_edges(pairs, scale))
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "cell_id string, node_idx int")
    tables.write_adjacency(edges, nodes, {"k": 2, "normalize": "rw"}, f"file://{tmp_path}/a", scale, 0.5)
    assert tables.read_json(spark, f"file://{tmp_path}/a/meta") == {"k": 2, "normalize": "rw", "node_count": 3, "sparse_nonzeros": 6, "scale_distance": 2.0, "use_wind": True, "wind_strength": 0.5}
    stage = spark.range(60_000).select(F.concat(F.lit("c"), F.col("id") % 20_000).alias("cell_id"), F.timestamp_seconds(F.col("id") * 60).alias("datetime_bin"))
    grid.stage_sketches(stage, "datetime_bin").write.parquet(f"file://{tmp_path}/s")
    kept = spark.read.parquet(f"file://{tmp_path}/s")
    exact, near = grid.stage_summary("x", stage, "datetime_bin").first(), grid.sketched_summary("x", kept).first()
    assert kept.count() == 42 and near.n_rows == exact.n_rows and near.first_bin == exact.first_bin and near.last_bin == exact.last_bin and abs(near.cells / exact.cells - 1) < 0.03
    assert tuple(grid.sketched_summary("x", kept.limit(0)).first()) == ("x", 0, 0, None, None)
