import math

import duckdb
import pytest
from pyspark.sql import functions as F

from cindergrid import catalog
from cindergrid.functions import expressions as x
from cindergrid.operators import edges, evaluate, graph, grid, knn, panel, tensor
from cindergrid.plans import spread
from cindergrid.sources import tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_points_on_edges_and_outside_have_no_cell(spark):
    p = spark.createDataFrame([(1, 0.0, 5.0), (2, 5.0, 5.0), (3, 25.0, 5.0), (4, None, 5.0)], "id int, x double, y double")
    got = dict(rows(grid.assign_cells(p, 0, 0, 10, 2, 1).select("id", "cell_id")))
    assert got == {1: None, 2: "cell_0_0", 3: None, 4: None}


def test_grid_covers_bounds(spark):
    assert grid.shape((0, 25, 0, 10), 10) == (3, 1)
    assert grid.build_grid(spark, (0.0, 25.0, 0.0, 10.0), 10.0).count() == 3
    assert grid.build_grid(spark, (0.0, 0.0, 0.0, 10.0), 10.0).count() == 0


def test_projection_round_trip(spark):
    p = spark.createDataFrame([(-120.5, 37.25), (-117.0, 0.0), (-119.9, 64.0)], "lon double, lat double")
    e, n = x.project_utm(F.col("lon"), F.col("lat"), 11)
    q = p.withColumns({"e": e, "n": n})
    lon, lat = x.unproject_utm(F.col("e"), F.col("n"), 11)
    for r in q.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8
    r = q.where("lat = 0").first()
    assert abs(r.e - 500000) < 1e-6 and abs(r.n) < 1e-6


def test_datetime_rules(spark):
    p = spark.createDataFrame([("2020-01-02", "930"), ("bad", "930")], "acq_date string, acq_time string")
    assert [r.datetime and str(r.datetime) for r in x.parse_datetime(p).collect()] == ["2020-01-02 09:30:00", None]
    with pytest.raises(ValueError):
        x.parse_datetime(spark.createDataFrame([(1,)], "a int"))


def test_static_aggregate(spark):
    p = spark.createDataFrame([("a", 1.0, "u"), ("a", 3.0, "v"), ("b", 2.0, None), (None, 9.0, "u")], "cell_id string, e double, c string")
    got = {r.cell_id: r for r in panel.aggregate_static(p, ["e"], ["c"]).collect()}
    assert got["a"].e_mean == 2 and abs(got["a"].e_std - math.sqrt(2)) < 1e-12 and got["a"].c_mode == "u" and got["a"].c_prop_u == 0.5
    assert got["b"].e_std is None and got["b"].c_mode is None and got["b"].c_prop_u is None


def test_shares_of_all_values(spark):
    p = spark.range(1200).select(F.lit("a").alias("cell_id"), F.col("id").cast("string").alias("c"))
    assert sum(n.startswith("c_prop_") for n in panel.aggregate_static(p, [], ["c"]).columns) == 1200
    want = {}
    for r in spread.topo_points(spark, SF).collect():
        want.setdefault(r.cell_id, []).append(r.landcover)
    assert len({v for x in want.values() for v in x}) == 5
    shares = {c: {v: round(x.count(v) / len(x), 6) for v in x} for c, x in want.items()}
    got = {}
    for r in catalog.QUERIES["category_shares"](spark, SF).collect():
        got.setdefault(r.cell_id, {})[r.landcover] = r.share
    assert got == shares
    kinds = {v for x in want.values() for v in x}
    assert {r.cell_id: {v: r[f"landcover_prop_{v}"] for v in kinds} for r in catalog.QUERIES["static_features"](spark, SF).collect()} == {c: {v: x.get(v, 0.0) for v in kinds} for c, x in shares.items()}


def test_fill_orders(spark):
    w = spark.sql("select 'a' cell_id, timestamp'2020-01-01 00:00:00' datetime_bin, 5.0D t2m_mean, 1.0D t2m_std")
    f = spark.sql("select 'a' cell_id, timestamp'2020-01-01 01:00:00' datetime_bin, 2.0D frp_sum, 1 fire_count, true fire_any")
    zero = panel.join_panel_sparse(w, f).orderBy("datetime_bin").collect()[1]
    carry = panel.join_panel_sparse(w, f, "carry_first").orderBy("datetime_bin").collect()[1]
    assert (zero.t2m_mean, zero.t2m_std) == (0, 1) and (carry.t2m_mean, carry.t2m_std) == (5, 1)


def test_knn_against_brute_force(spark):
    pts = [(f"c{i}", float(i * 37 % 101) * (50 if i == 3 else 1), float(i * 53 % 97)) for i in range(60)]
    got = {}
    for r in knn.knn_pairs(spark.createDataFrame(pts, "cell_id string, x double, y double"), 4).collect():
        got.setdefault(r.source, []).append((r.dist_m, r.target))
    for c, a, b in pts:
        want = sorted((math.sqrt((a - p) ** 2 + (b - q) ** 2), d) for d, p, q in pts if d != c)[:4]
        assert [t for _, t in sorted(got[c])] == [t for _, t in want]


def test_impute_in_a_gap(spark):
    # thirty new cells lie nearer to each other than to the three static ones
    places = spark.createDataFrame([(f"n{i}", float(i), 0.0) for i in range(30)] + [("a", 100.0, 0.0), ("b", 101.0, 0.0), ("c", 500.0, 0.0)], "cell_id string, x double, y double")
    static = spark.createDataFrame([("a", 1.0, "u"), ("b", 3.0, "u"), ("c", 90.0, "v")], "cell_id string, e double, c string")
    got = {r.cell_id: (r.e, r.c) for r in knn.knn_impute(static, places, 2, ["e"], ["c"], places, True).collect()}
    assert got == {f"n{i}": (2.0, "u") for i in range(30)} | {"a": (1.0, "u"), "b": (3.0, "u"), "c": (90.0, "v")}


def test_unknown_cells_are_skipped_or_an_error(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("lost", None, 0.0)], "cell_id string, x double, y double")
    assert {r.source for r in knn.knn_pairs(cells, 2).collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="lost"):
        knn.knn_pairs(cells, 2, on_missing="error")


def test_nearest_station_across_the_seam(spark):
    cells = spark.createDataFrame([("east", -179.95, 0.0), ("west", 179.98, 0.0), ("far", 0.0, 60.0)], "cell_id string, lon double, lat double")
    stations = spark.createDataFrame([(0, 0.0, 179.95), (1, 0.0, -179.5), (2, -50.0, 10.0)], "station_idx int, lat double, lon double")
    got = {r.cell_id: (r.station_idx, r.dist_m) for r in panel.nearest_station(cells, stations).collect()}
    place = {r.station_idx: r for r in stations.collect()}
    for c in cells.collect():
        def metres(s):
            a = math.sin(math.radians(s.lat - c.lat) / 2) ** 2 + math.cos(math.radians(c.lat)) * math.cos(math.radians(s.lat)) * math.sin(math.radians(s.lon - c.lon) / 2) ** 2
            return 2 * x.EARTH_M * math.asin(math.sqrt(a))

        best = min(place.values(), key=metres)
        assert got[c.cell_id][0] == best.station_idx and abs(got[c.cell_id][1] - metres(best)) < 1e-3


def test_wind_stretches_edges(spark):
    pairs = spark.createDataFrame([("a", "b", 10.0), ("a", "c", 10.0), ("b", "a", 10.0)], "source string, target string, dist_m double")
    coords = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 0.0), ("c", 0.0, 10.0)], "cell_id string, x double, y double")
    wind = spark.createDataFrame([("a", 0.0)], "cell_id string, wind_deg double")
    got = {(r.src, r.dst): r.weight for r in graph.weighted_edges(pairs, 10.0, wind, coords, 0.5).collect()}
    assert all(abs(got[k] - math.exp(-1) * v) < 1e-12 for k, v in {("a", "b"): 1.5, ("a", "c"): 1.0, ("b", "a"): 1.0}.items())


def test_splits(spark):
    rows = [(t, f"s{i}", "t", int(i == 0)) for t in range(20) for i in range(10)]
    e = spark.createDataFrame(rows, "time_epoch long, source string, target string, label int")
    count = lambda df: {(r.label, r.split): r["count"] for r in df.groupBy("label", "split").count().collect()}
    assert {r.split: (r.lo, r.hi) for r in evaluate.time_split(e).groupBy("split").agg(F.min("time_epoch").alias("lo"), F.max("time_epoch").alias("hi")).collect()} == {"train": (0, 13), "val": (14, 16), "test": (17, 19)}
    exact = {(0, "train"): 144, (0, "test"): 36, (1, "train"): 16, (1, "test"): 4}
    assert count(evaluate.time_split(e.withColumn("time_epoch", F.col("time_epoch") % 10))) == exact
    assert count(evaluate.time_split(e.drop("time_epoch"))) == exact
    few = e.where("source in ('s0', 's1', 's2')")  # 42 rows to train on
    assert count(evaluate.time_split(few)) == {(0, "train"): 32, (0, "test"): 8, (1, "train"): 16, (1, "test"): 4}


def test_model_learns_and_scores(spark):
    rows = [(i, f"s{i}", "t", float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)]
    e = spark.createDataFrame(rows, "time_epoch long, source string, target string, dist_m double, frp_src double, label int")
    features = edges.select_feature_columns(e)
    assert features == ["dist_m", "frp_src"]
    model = evaluate.train_spread_model(e, features, rounds=3, depth=2, columns=1.0)
    got = evaluate.score_edges(model, e).collect()
    assert all((r.pred_proba >= 0.5) == bool(r.label) and 0 <= r.pred_proba <= 1 for r in got)
    assert [r.feature for r in evaluate.top_features(model.table(spark), 1).collect()] == ["dist_m"]


def test_feature_list_file_or_columns(spark, tmp_path):
    e = spark.createDataFrame([(1, "s", 2.0, 1.0, 0)], "time_epoch long, source string, elevation double, dist_m double, label int")
    path = f"file://{tmp_path}/list"
    assert tables.read_feature_list(e, path) == tables.read_feature_list(e) == ["elevation", "dist_m"]
    tables.write_feature_list(spark, edges.select_feature_columns(e), path)
    assert tables.read_feature_list(e, path) == ["dist_m", "elevation"]
    assert [tuple(r) for r in edges.align_features(e, ["dist_m", "humidity", "elevation"]).collect()] == [(1.0, 0.0, 2.0)]


def test_numbers_in_order(spark):
    names = [f"cell_{i % 40}_{i // 40}" for i in range(300)]
    p = spark.createDataFrame([(n,) for n in names * 2], "cell_id string")
    assert {r.cell_id: r.node_idx for r in tensor.node_index(p).collect()} == {n: i for i, n in enumerate(sorted(names))}


def test_grid_files(spark, tmp_path):
    g = grid.build_grid(spark, (500000.0, 503000.0, 4000000.0, 4002000.0), 1000.0)
    tables.write_grid(g, f"file://{tmp_path}/g", 11)
    assert tables.read_grid(spark, f"file://{tmp_path}/g/boxes").count() == 6
    low = spark.read.parquet(f"file://{tmp_path}/g/centroids").where("cell_id = 'cell_0_0'").first()
    assert abs(low.lon + 117) < 0.01 and abs(low.lat - 36.14) < 0.01


def test_label_and_trend(spark):
    p = spark.createDataFrame([("a", 10, 1.0, True), ("a", 11, 3.0, True), ("a", 12, 5.0, True), ("b", 36, 1.0, True), ("b", 37, 1.0, True)], "cell_id string, epoch_hr long, frp_sum double, fire_any boolean")
    assert [r.frp_src_trend for r in edges.frp_trend(p, 6).where("cell_id = 'a'").orderBy("epoch_hr").collect()] == [0.0, 0.0, 2.0]
    c = edges.edge_candidates(p, spark.createDataFrame([("a", "b", 1.0)], "source string, target string, dist_m double"))
    got = {r.time_epoch: r.label for r in edges.label_spread(c, edges.filter_burning(p), 24).collect()}
    assert got == {10: 0, 11: 0, 12: 1}


def test_balance(spark):
    e = spark.createDataFrame([(i, "s", "t", int(i < 2)) for i in range(20)], "time_epoch long, source string, target string, label int")
    for ratio, n in ((3, 6), (0, 0), (100, 18)):
        assert edges.balance_examples(e, ratio).where("label = 0").count() == n


def test_graph_rows_sum_to_one(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    s = graph.symmetrize(e)
    assert all(abs(r[1] - 1) < 1e-12 for r in graph.normalize_adjacency(s).groupBy("src").agg(F.sum("weight")).collect())
    w = {(r.src, r.dst): r.weight for r in graph.normalize_adjacency(s, "sym").collect()}
    assert all(abs(w[a, b] - w[b, a]) < 1e-12 for a, b in w)


def test_tensor_fill_and_labels(spark):
    p = spark.createDataFrame([("a", 0, None, False), ("a", 1, 4.0, True), ("a", 3, None, False), ("a", 4, 1.0, True)], "cell_id string, epoch_hr long, f double, fire_any boolean")
    got = tensor.build_tensor(p, ["f"], 2).orderBy("t_idx").collect()
    assert [r.f for r in got] == [4.0, 4.0, 0.0, 0.0, 1.0]
    assert [r.y_future for r in got] == [1, 0, 1, 1, 0]


def test_evaluation(spark):
    s = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0), (0.0, 0)], "pred_proba double, label int")
    assert abs(evaluate.average_precision(s).first()[0] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12
    report = {r["class"]: r for r in evaluate.classification_report(s).collect()}
    assert report["1"].recall == 1 and report["accuracy"].f1 == 0.8
    assert {r.bin: r.n for r in evaluate.calibration_curve(s).collect()} == {0: 2, 4: 1, 8: 2}


def test_column_names():
    assert tables.resolve_latlon(["ID", "Latitude", "my_long"]) == ("Latitude", "my_long")
    with pytest.raises(ValueError):
        tables.resolve_latlon(["a", "b"])


@pytest.mark.parametrize("name", ["assigned_points", "fire_cell_time", "panel_sparse", "knn_pairs", "frp_trend", "spread_labels", "csv_points", "bounded_cells", "projected_cells", "panel_half_hours", "stage_summary", "station_weather", "knn_impute", "example_features", "balanced_examples", "stratified_split", "adjacency_wind", "tensor_all_nodes", "tensor_stats"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in got.description]
    want = sorted(repr(tuple(dict(zip(names, r))[c] for c in cols)) for r in got.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want
