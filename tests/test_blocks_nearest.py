"""Trees of neighbours, blocks of time, exact cells, medians and bounded categories against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cindergrid import catalog
from cindergrid.functions import expressions as x
from cindergrid.operators import blocks, edges, graph, grid, knn, nearest, panel, tensor

SF = "/root/testdata/sf0.001"


def brute_knn(sources, targets, k, include_self):
    out = set()
    for c, a, b in sources:
        near = sorted((math.sqrt((p - a) ** 2 + (q - b) ** 2), d) for d, p, q in targets if include_self or d != c)
        out |= {(c, d) for _, d in near[:k]}
    return out


@pytest.mark.parametrize("kind", ["clusters", "lone", "one point", "two"])
def test_knn_of_any_layout(spark, kind):
    rng = random.Random(kind)
    at = {
        "uniform": lambda i: (rng.random() * 1e4, rng.random() * 1e3), "clusters": lambda i: (rng.random() + 1e5 * (i % 2), rng.random() + 1e5 * (i % 2)),
        "lone": lambda i: (rng.random() * 10, rng.random() * 10) if i % 50 else (rng.random() * 1e6, rng.random() * 1e6),
        "one point": lambda i: (5.0, 5.0) if i % 3 else (rng.random(), 7.0), "line": lambda i: (float(i), 0.0), "two": lambda i: (float(i), 1.0),
    }
    pts = [(f"c{i:03d}", *at[kind](i)) for i in range(2 if kind == "two" else 240)]
    cells = spark.createDataFrame(pts, "cell_id string, x double, y double").repartition(3)
    include_self = kind == "lone"
    got = [(r.source, r.target) for r in knn.knn_pairs(cells, 4, include_self).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_knn(pts, pts, 4, include_self)


def test_knn_of_other_sources_and_of_none(spark):
    rng = random.Random(7)
    pts, ask = ([(f"{n}{i}", rng.gauss(0, s), rng.gauss(0, s)) for i in range(90)] for n, s in (("c", 1), ("q", 300)))
    make = lambda rows: spark.createDataFrame(rows, "cell_id string, x double, y double")
    assert {(r.source, r.target) for r in knn.knn_pairs(make(pts), 3, queries=make(ask)).collect()} == brute_knn(ask, pts, 3, True)
    assert knn.knn_pairs(make(pts).limit(0), 3).collect() == [] == knn.knn_pairs(make(pts), 3, queries=make(ask).limit(0)).collect()
    assert knn.knn_pairs(make(pts[:1]), 3).collect() == []


def test_far_clusters_meet_in_their_leaves(spark):
    rng = random.Random(1)
    cells = spark.createDataFrame([(i, rng.random() * 100 + 1e5 * (i % 2), rng.random() * 100 + 1e5 * (i % 2)) for i in range(6000)], "cell_id long, x double, y double")
    assert nearest.near_pairs(cells, cells, ["x", "y"], 9, ["cell_id"], same=True).count() < 6000 * 9 * 12
    levels, places = nearest.counted_tree(cells, ["x", "y"], [0.0, 0.0], 1e5 + 100)
    assert places.count() == 6000 and max(r.n for t in levels for r in t.where("leaf").collect()) <= nearest.CAP


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * x.EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def test_stations_over_the_whole_sphere(spark):
    rng = random.Random(3)
    anywhere = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    stations = [anywhere() for _ in range(150)] + [(89.885, 0.0), (89.9, 2.5), (90.0, 10.0), (90.0, 50.0), (-90.0, 0.0), (10.0, 180.0), (10.0, -180.0)]
    cells = [anywhere() for _ in range(200)] + [(89.9, 0.0), (90.0, 77.0), (89.99, -170.0), (10.0, 179.999), (10.0, -179.999), (-89.999, 5.0)]
    s = spark.createDataFrame([(i, *p) for i, p in enumerate(stations)] + [(999, None, 1.0)], "station_idx int, lat double, lon double")
    c = spark.createDataFrame([(f"c{i}", *p) for i, p in enumerate(cells)] + [("none", None, 3.0)], "cell_id string, lat double, lon double")
    got = {r.cell_id: (r.station_idx, r.dist_m) for r in panel.nearest_station(c, s).collect()}
    assert len(got) == len(cells)
    for i, p in enumerate(cells):
        least = min(metres(p, q) for q in stations)
        assert abs(got[f"c{i}"][1] - least) < 1e-2 and abs(metres(p, stations[got[f"c{i}"][0]]) - least) < 1e-2
    assert abs(got["c200"][1] - 485.3) < 1 and panel.nearest_station(c, s.limit(0)).collect() == []


def test_points_on_edges_of_any_grid(spark):
    rng = random.Random(6)
    for x0, size in [(280618.5464674407, 1000.0)] + [(rng.uniform(-1e6, 1e6), rng.choice([0.1, 250.0, 1000.0, 333.3])) for _ in range(6)]:
        box = (x0, x0 + 60 * size, x0, x0 + 2 * size)
        nx, ny = grid.shape(box, size)
        cells = grid.build_grid(spark, box, size).where("j = 0").collect()
        at = sorted({v for c in cells for e in (c.xmin, c.xmax) for v in (e, np.nextafter(e, -np.inf), np.nextafter(e, np.inf))} | {rng.uniform(x0 - size, x0 + 62 * size) for _ in range(50)})
        p = spark.createDataFrame([(float(v), x0 + size / 2) for v in at], "x double, y double")
        for r in grid.assign_cells(p, x0, x0, size, nx, ny).collect():
            inside = [c.cell_id for c in sorted(cells, key=lambda c: c.i) if c.xmin < r.x < c.xmax]
            assert r.cell_id == (inside[0] if inside else None)


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 4.0], [2.0] * 9, [1.0, 1.0, 5.0, 5.0], [1e-9, 1.0, 1e12, 1e12 + 1], list(range(1001)), [float(i % 7) for i in range(500)]])
def test_median_by_counting(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "dist_m double")
    for parts in (3, 4096):
        assert graph.median_scale(df, parts) == (float(np.median(values)) if values else 0.0)


def test_categories_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(panel, "WIDEST", 5)
    p = spark.range(60).select(F.lit("a").alias("cell_id"), (F.col("id") % 5).cast("string").alias("c"), (F.col("id") % 6).cast("string").alias("d"))
    assert sum("_prop_" in c for c in panel.aggregate_static(p, [], ["c"]).columns) == 5
    with pytest.raises(ValueError, match="category_shares"):
        panel.aggregate_static(p, [], ["d"])
    assert "d_prop_0" in panel.aggregate_static(p, [], ["d"], {"d": ["0"]}).columns


def hours(spark, seed=2):
    """Cells of hourly rows with holes and nulls; cell a has a third of all rows."""
    rng = random.Random(seed)
    rows = [(c, 100 + h, rng.choice([None, None, float(h)]), float(rng.randrange(4)), rng.random() < 0.1) for c, n in (("a", 200), *((f"b{i}", 40) for i in range(10))) for h in range(n) if rng.random() < 0.8]
    return rows, spark.createDataFrame(rows, "cell_id string, epoch_hr long, t2m_mean double, frp_sum double, fire_any boolean")


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_change_no_result(spark, block):
    rows, df = hours(spark)
    by = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        by.setdefault(r[0], []).append(r)
    filled = {(r.cell_id, r.epoch_hr): r.t2m_mean for r in blocks.carried(df, ["t2m_mean"], F.col("epoch_hr"), block).collect()}
    trend = {(r.cell_id, r.epoch_hr): r.frp_src_trend for r in edges.frp_trend(df, 6, block).collect()}
    asked = df.select(F.col("cell_id").alias("target"), F.col("epoch_hr").alias("time_epoch"), F.col("frp_sum").alias("epoch_hr"))
    asked = asked.union(asked.where("time_epoch % 3 = 0"))  # repeated rows stay
    label = edges.label_spread(asked, edges.filter_burning(df), 5, block).collect()
    assert len(filled) == len(trend) == len(rows) and len(label) == asked.count()
    for c, own in by.items():
        first = next((r[2] for r in own if r[2] is not None), None)
        last = None
        for _, h, t, _, _ in own:
            last = t if t is not None else last
            assert filled[c, h] == (last if last is not None else first)
            near = [(g, s) for _, g, _, s, _ in own if h - 6 <= g < h]
            slope = np.polyfit(*zip(*near), 1)[0] if len(near) > 1 else 0.0
            assert abs(trend[c, h] - slope) < 1e-6
    for r in label:
        assert r.label == int(any(f and r.time_epoch < h <= r.time_epoch + 5 for _, h, _, _, f in by[r.target]))
    made = {(r.cell_id, r.t_idx): r for r in tensor.build_tensor(df, ["t2m_mean"], 5, block=block).collect()}
    other = {(r.cell_id, r.t_idx): r for r in tensor.build_tensor(df, ["t2m_mean"], 5, block=10_000).collect()}
    assert made == other
    fire = {c: {h - 100 for _, h, _, _, f in own if f} for c, own in by.items()}
    low = min(r[1] for r in rows) - 100
    assert all(r.y_future == int(t + low not in fire[c] and any(t + low < h <= t + low + 5 for h in fire[c])) for (c, t), r in made.items())


def test_a_hot_cell_is_shared_out(spark):
    _, df = hours(spark)
    plan = edges.frp_trend(df, 6, 7).withColumn("task", F.spark_partition_id())
    assert plan.where("cell_id = 'a'").select("task").distinct().count() > 1
    bins = df.select("cell_id", F.timestamp_seconds(F.col("epoch_hr") * 3600).alias("datetime_bin"), F.lit(0).alias("station_idx"), "frp_sum").where("cell_id = 'a'").drop("cell_id")
    cells = spark.range(30).select(F.format_string("c%d", "id").alias("cell_id"), F.lit(0).alias("station_idx"))
    out = panel.station_fanout(bins, cells, 7)
    assert out.columns == ["datetime_bin", "frp_sum", "cell_id"] and out.count() == 30 * bins.count() == out.distinct().count()


def test_fractional_origins_against_sql(spark):
    """assign_cells on a grid whose origin is no whole number, against comparisons with the grid's own bounds."""
    x0, size = 280618.5464674407, 1000.0
    p = spark.range(4000).select("id", (F.lit(x0) + (F.col("id") % 400) * 250.0).alias("x"), (F.lit(x0) + (F.col("id") % 97) * 125.5).alias("y"))
    box = (x0, x0 + 90 * size, x0, x0 + 12 * size)
    got = {r.id: r.cell_id for r in grid.assign_cells(p, x0, x0, size, 90, 12).collect()}
    pts, cells = p.toPandas(), grid.build_grid(spark, box, size).toPandas()  # noqa: F841
    want = duckdb.sql("SELECT id, cell_id FROM pts LEFT JOIN cells ON x > xmin AND x < xmax AND y > ymin AND y < ymax").fetchall()
    assert got == dict(want) and None in got.values()


def test_queries_on_whole_tables_keep_their_sql(spark):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("nearest_station", "panel_dense", "tensor", "adjacency_sym"):
        df = catalog.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = con.execute(catalog.ORACLE[name])
        names = [d[0] for d in got.description]
        assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(repr(tuple(dict(zip(names, r))[c] for c in cols)) for r in got.fetchall())
