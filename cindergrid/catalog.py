"""Registered queries; the SQL that their results are held against is in catalog_sql."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog_sql import ORACLE  # noqa: F401
from cindergrid.functions import expressions as x
from cindergrid.operators import boosting, edges, evaluate, graph, grid, knn, panel, tensor
from cindergrid.plans import spread as s
from cindergrid.sources import tables


def rounded(df, digits: int = 6):
    """Floating columns rounded, so that sums in another order agree; -0.0 becomes 0.0."""
    return df.select(*((F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def bin_text(df):
    """Times as text, which both engines spell alike."""
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes))


STATION = lambda sp, d: panel.distinct_stations(s.weather_points(sp, d))
P, STAGE = s.hourly_panel, s.panel_stage


def lon_lat(cells):
    """Stand-in longitudes and latitudes of lattice cells."""
    at = lambda c, low: (F.col(c) - low - s.SIZE / 2) / s.SIZE
    return cells.select("cell_id", (-120 + 0.01 * at("x", s.X0)).alias("lon"), (36 + 0.01 * at("y", s.Y0)).alias("lat"))


def station_map(sp, d):
    return panel.nearest_station(lon_lat(s.centroids(P(sp, d))), STATION(sp, d))


def csv_points(sp, d):
    """Weather points written as CSV, every 50th without a longitude, and read back: those with coordinates."""
    p = s.points(sp, d).where("event_type <> 'error'")
    p = p.select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id") * 0.5).alias("Longitude"), (F.col("user_id") * 0.25).alias("Lat"), "value")
    path = tables.shared_path(sp)
    p.write.csv(path, header=True)
    back = tables.read_points(sp, path, "event_id long, Longitude double, Lat double, value double")
    lat, lon = tables.resolve_latlon(back.columns)
    return rounded(back.select("event_id", F.col(lat).alias("lat"), F.col(lon).alias("lon"), "value"))


def panel_stage_files(sp, d):
    path = tables.shared_path(sp)
    tables.write_panel(P(sp, d), path)
    return bin_text(rounded(tables.read_stage(sp, path).select("cell_id", "datetime_bin", "frp_sum", "t2m_mean", "fire_any")))


def customer_places(sp, d):
    c = s.table(sp, d, "customer")
    i, j = F.col("c_custkey") % s.COLUMNS, F.floor(F.col("c_custkey") / s.COLUMNS) % 38
    at = lambda n, k: s.SIZE * n + 50 + k * (F.col("c_custkey") % (23 if k == 37 else 19))
    return c.select("c_custkey", (s.X0 + at(i, 37)).alias("x"), (s.Y0 + at(j, 41)).alias("y"))


def grid_files(sp, d):
    """The grid over the customers' places, written and read back."""
    path = tables.shared_path(sp)
    tables.write_grid(grid.build_grid(sp, grid.bounds(customer_places(sp, d)), s.SIZE), path, 11)
    return rounded(tables.read_grid(sp, f"{path}/boxes").select("cell_id", "i", "j", "xmin", "ymin", "xmax", "ymax", "centroid_x", "centroid_y"))


def bounded_cells(sp, d):
    """The customers' cells in the grid over their own bounds: the extreme ones lie on its border."""
    p = customer_places(sp, d)
    box = grid.bounds(p)
    nx, ny = grid.shape(box, s.SIZE)
    return grid.assign_cells(p, box[0], box[2], s.SIZE, nx, ny).select("c_custkey", "cell_id")


def projected_cells(sp, d):
    """Panel cells' stand-in coordinates in metres of the UTM zone of their centre, and back."""
    cells = lon_lat(s.centroids(P(sp, d)))
    zone, north = grid.choose_zone([cells])
    e, n = x.project_utm(F.col("lon"), F.col("lat"), zone, north)
    cells = cells.withColumns({"east": e, "north": n, "zone": F.lit(zone)})
    lon, lat = x.unproject_utm(F.col("east"), F.col("north"), zone, north)
    cells = cells.withColumns({"lon_back": lon, "lat_back": lat})
    return cells.select("cell_id", "zone", *(F.round(c, n).alias(c) for c, n in (("east", 2), ("north", 2), ("lon_back", 7), ("lat_back", 7))))


def parsed_times(sp, d):
    """Times of fires from a date and a time of day as a whole number; every 40th date is no date."""
    p = s.points(sp, d).where("event_type = 'error'")
    p = p.select("event_id", F.when(F.col("event_id") % 40 != 0, F.date_format("datetime", "yyyy-MM-dd")).otherwise("soon").alias("acq_date"), (F.hour("datetime") * 100 + F.minute("datetime")).alias("acq_time"))
    return bin_text(x.parse_datetime(p).select("event_id", "datetime", x.epoch_hours(F.col("datetime")).alias("epoch_hr")))


def wind_points(sp, d):
    """Wind of weather points from text; every 60th u10 is no number."""
    p = s.points(sp, d).where("event_type <> 'error'")
    p = p.select("event_id", F.when(F.col("event_id") % 60 == 0, "calm").otherwise((((7 * F.col("event_id")) % 21) - 10).cast("string")).alias("u10"), (((13 * F.col("event_id")) % 17) - 8).cast("string").alias("v10"))
    return rounded(x.wind_features(p))


def static_features(sp, d):
    """Numbers, modes and shares of all land covers of each cell."""
    return rounded(panel.aggregate_static(s.topo_points(sp, d), ["elevation", "slope"], ["landcover"]))


def category_shares(sp, d):
    """The same shares in long form, for categories of many values."""
    shares = panel.category_shares(s.topo_points(sp, d), "landcover")
    return rounded(shares.select("cell_id", F.explode("shares").alias("landcover", "share")))


def imputed(sp, d):
    static = tables.staged(panel.aggregate_static(s.topo_points(sp, d), ["elevation", "slope"], ["landcover"], {"landcover": []}))
    cells = s.centroids(P(sp, d).select("cell_id").union(static.select("cell_id")))
    return rounded(knn.knn_impute(static, cells, 5, ["elevation_mean"], ["landcover_mode"], s.centroids(P(sp, d)), True).select("cell_id", "elevation_mean", "landcover_mode", "slope_mean"))


def stage_summary(sp, d):
    p = STAGE(sp, d)
    out = grid.stage_summary("panel", p, "datetime_bin")
    for name, df, time in (("static", s.static_table(sp, d), None), ("weather", panel.aggregate_weather(s.weather_points(sp, d)), "datetime_bin"), ("fire", panel.aggregate_fire(s.fire_points(sp, d)), "datetime_bin"), ("grid", s.centroids(p.select("cell_id").union(s.topo_points(sp, d).select("cell_id"))), None)):
        out = out.unionByName(grid.stage_summary(name, df, time))
    return bin_text(out)


def half_hours(sp, d):
    """The panel of half-hour bins with one row for each hour."""
    weather, fire = (df.withColumn("datetime_bin", x.floor_time_bin(F.col("datetime"), 30)) for df in (s.timed_points(sp, d, False), s.timed_points(sp, d, True)))
    p = panel.join_panel_sparse(panel.aggregate_weather(weather), panel.aggregate_fire(fire)).withColumn("epoch_hr", x.epoch_hours(F.col("datetime_bin")))
    return rounded(panel.dedup_panel(p).select("cell_id", "epoch_hr", "frp_sum", "fire_count", "fire_any", "t2m_max", "_obs_count_sum"))


def example_features(sp, d):
    return rounded(s.examples(STAGE(sp, d), s.static_table(sp, d)))


def example_table(sp, d):
    """The features of the examples by the list that a file keeps, and one that they lack."""
    e = s.examples(STAGE(sp, d), s.static_table(sp, d))
    path = tables.shared_path(sp)
    tables.write_feature_list(sp, edges.select_feature_columns(e), path)
    features = tables.read_feature_list(e, path)
    return rounded(edges.align_features(e.select(*features[:6], "elevation_mean_tgt"), [*features[:6], "humidity", "elevation_mean_tgt"]))


def split_rows(sp, d, split):
    return split(s.labelled(STAGE(sp, d)).select("time_epoch", "source", "target", "label"))


def middle_hour(burning):
    return evaluate.choose_time(burning).first().epoch_hr


def new_burns(sp, d):
    p = STAGE(sp, d)
    return rounded(evaluate.actual_new_burns(p, middle_hour(edges.filter_burning(p)), s.HORIZON))


def burning_sources(sp, d):
    p = STAGE(sp, d)
    burning = edges.filter_burning(p)
    return rounded(evaluate.burning_sources(burning, s.centroids(p), middle_hour(burning)))


def node_coords(sp, d):
    """Panel cells on the terrain's centroids: null where there is no terrain; and how many lack it."""
    nodes = graph.node_coords(P(sp, d), s.centroids(s.topo_points(sp, d)))
    return rounded(nodes.withColumn("missing", F.lit(graph.missing_nodes(nodes))))


def adjacency_files(sp, d):
    p, path = STAGE(sp, d), tables.shared_path(sp)
    pr = tables.staged(s.pairs(p))
    scale = graph.median_scale(pr)
    tables.write_adjacency(graph.normalize_adjacency(graph.symmetrize(graph.weighted_edges(pr, scale))), tensor.node_index(p), {"k": s.K, "normalize": "rw"}, path, scale)
    index = tables.read_stage(sp, f"{path}/nodes")
    e = tables.read_stage(sp, f"{path}/edges")
    for side in ("src", "dst"):
        e = e.join(index.select(F.col("cell_id").alias(side), F.col("node_idx").alias(f"{side}_idx")), side)
    return rounded(e.select("src_idx", "dst_idx", "weight"), 4)


def tensor_files(sp, d):
    """Each node's packed rows, of the tensor written and read back."""
    path = tables.shared_path(sp)
    tables.write_tensor(s.spread_tensor(STAGE(sp, d)), list(s.TENSOR_FEATURES), {"horizon": s.HORIZON}, path, buckets=8)
    blocks, _ = tables.read_tensor(sp, path)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v).cast("long")
    each = blocks.select("cell_id", F.size("x").alias("times"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0]).alias("frp_sum"), total("y_current").alias("burning"), total("y_future").alias("positives"))
    return rounded(each.groupBy("cell_id").agg(F.sum("times").cast("int").alias("times"), *(F.sum(c).alias(c) for c in ("frp_sum", "burning", "positives"))), 2)


def tensor_static_files(sp, d):
    """The static block and the nodes' index, written with the tensor and read back."""
    p, path = STAGE(sp, d), tables.shared_path(sp)
    tables.write_tensor(s.spread_tensor(p), list(s.TENSOR_FEATURES), {}, path, tensor.tensor_static(p, s.static_table(sp, d)), tensor.node_index(p), buckets=8)
    return rounded(tables.read_stage(sp, f"{path}/nodes").join(tables.read_stage(sp, f"{path}/static"), "cell_id").select("node_idx", "cell_id", "elevation_mean", "slope_mean"), 2)


def all_nodes(sp, d):
    """The tensor over the terrain's cells, those without a panel row too, from the panel's 24th to 72nd hour."""
    p = STAGE(sp, d)
    low = p.agg(F.min("epoch_hr")).first()[0]
    span = tensor.filter_time_range(p, low + 24, low + 72)
    return rounded(tensor.build_tensor(span, ["frp_sum"], s.HORIZON, low=low + 24, high=low + 72, nodes=s.topo_points(sp, d)).select("cell_id", "t_idx", "epoch_hr", "frp_sum", "y_current", "y_future"), 4)


def checked_tensor(sp, d):
    p = STAGE(sp, d)
    static = tensor.tensor_static(p, s.static_table(sp, d))
    return rounded(tensor.tensor_checks(s.spread_tensor(p), list(s.TENSOR_FEATURES), static), 4)


def trained(sp, d):
    """Boosted trees fitted on the training part of the examples with the operator's depth, rate and sampling, and the test part.

    Training may stop early by the test part, as the reference job does; ROUNDS bounds the registered queries' time.
    """
    e = tables.staged(evaluate.time_split(s.examples(STAGE(sp, d), s.static_table(sp, d))))
    test = e.where("split = 'test'")
    keys = ["time_epoch", "source", "target"]
    return evaluate.train_spread_model(e.where("split = 'train'"), edges.select_feature_columns(e), test, rounds=ROUNDS, key=keys), test


def scored_examples(sp, d):
    """The test part scored by the trees, which are written and read again."""
    model, test = trained(sp, d)
    path = tables.shared_path(sp)
    boosting.write_trees(sp, model, path)
    return rounded(evaluate.score_edges(boosting.read_trees(sp, path), test).select("time_epoch", "source", "target", "label", "pred_proba"))


def top_features(sp, d):
    return rounded(evaluate.top_features(trained(sp, d)[0].table(sp), 10))


def boosting_sums(sp, d):
    """Sums of gradient and curvature by feature and bin at the root of the first tree, in units of 2**-30, for fixed cuts."""
    e = tables.staged(s.labelled(STAGE(sp, d)).select("dist_m", "frp_src", "label"))
    weight = float(evaluate.class_weight(e).first().weight)
    g, h = boosting.gradients("logistic", F.lit(0.0), F.col("label"), weight)
    bins = {f"b{i}": boosting.bin_of(F.col(c), cuts) for i, (c, cuts) in enumerate(SUM_CUTS.items())}
    sums = boosting.histogram(e.withColumns(bins | {"g": g, "h": h}), F.lit(0), [0, 1], 8)
    return sums.select((F.col("code") / 8).cast("int").alias("feature"), (F.col("code") % 8).alias("bin"), "g", "h", "n")


ROUNDS = 8
SUM_CUTS = {"dist_m": [1200.0, 1800.0, 2500.0], "frp_src": [50.5, 100.5, 200.5, 400.5]}

QUERIES = {
    "csv_points": csv_points,
    "parsed_times": parsed_times,
    "wind_points": wind_points,
    "all_points": lambda sp, d: rounded(grid.concat_points([s.weather_points(sp, d).select("cell_id", "t2m"), s.fire_points(sp, d).select("cell_id", "frp")])),
    "assigned_points": lambda sp, d: s.points(sp, d).select("event_id", "cell_id"),
    "bounded_cells": bounded_cells,
    "grid_files": grid_files,
    "projected_cells": projected_cells,
    "static_features": static_features,
    "category_shares": category_shares,
    "weather_cell_time": lambda sp, d: bin_text(rounded(panel.aggregate_weather(s.weather_points(sp, d, 360)))),
    "fire_cell_time": lambda sp, d: bin_text(rounded(panel.aggregate_fire(s.fire_points(sp, d)))),
    "panel_keys": lambda sp, d: bin_text(panel.union_keys(s.weather_points(sp, d).dropna(), s.fire_points(sp, d).dropna())),
    "panel_sparse": lambda sp, d: bin_text(rounded(P(sp, d).select("cell_id", "datetime_bin", "epoch_hr", "t2m_mean", "t2m_max", "_obs_count_sum", "frp_sum", "fire_count", "fire_any"))),
    "panel_dense": lambda sp, d: bin_text(rounded(panel.densify_panel(STAGE(sp, d).select("cell_id", "datetime_bin", "t2m_mean", "frp_sum"), 60))),
    "panel_stage_files": panel_stage_files,
    "panel_half_hours": half_hours,
    "grid_coverage": lambda sp, d: grid.grid_coverage(s.centroids(s.topo_points(sp, d)), P(sp, d)).select("cell_id", "n", "in_panel"),
    "stage_summary": stage_summary,
    "stations": lambda sp, d: rounded(STATION(sp, d)),
    "nearest_station": lambda sp, d: rounded(station_map(sp, d), 3),
    "station_weather": lambda sp, d: bin_text(rounded(panel.station_fanout(panel.aggregate_station_weather(s.weather_points(sp, d), STATION(sp, d)), station_map(sp, d)))),
    "fire_in_weather_cells": lambda sp, d: bin_text(rounded(panel.restrict_to_panel(panel.aggregate_fire(s.fire_points(sp, d)), s.weather_points(sp, d).dropna(subset=["cell_id"])).select("cell_id", "datetime_bin", "frp_sum"))),
    "refreshed_panel": lambda sp, d: bin_text(rounded(panel.refresh_panel_fire(panel.aggregate_weather(s.weather_points(sp, d)), panel.aggregate_fire(s.fire_points(sp, d))).select("cell_id", "datetime_bin", "t2m_mean", "fire_count", "fire_any", "frp_sum"))),
    "missing_cells": lambda sp, d: panel.missing_cells(P(sp, d), s.topo_points(sp, d).select("cell_id").distinct()),
    "knn_pairs": lambda sp, d: rounded(s.pairs(P(sp, d))),
    "knn_impute": imputed,
    "frp_trend": lambda sp, d: rounded(edges.frp_trend(P(sp, d), s.LAGS).select("cell_id", "epoch_hr", "frp_src_trend")),
    "spread_labels": lambda sp, d: rounded(s.labelled(STAGE(sp, d)).select("time_epoch", "source", "target", "dist_m", "label")),
    "example_features": example_features,
    "example_table": example_table,
    "label_counts": lambda sp, d: evaluate.label_counts(s.labelled(STAGE(sp, d))),
    "class_weight": lambda sp, d: rounded(evaluate.class_weight(s.labelled(STAGE(sp, d)))),
    "balanced_examples": lambda sp, d: split_rows(sp, d, lambda e: edges.balance_examples(tables.staged(e), 1.0)),
    "time_split": lambda sp, d: split_rows(sp, d, lambda e: evaluate.time_split(tables.staged(e))),
    "stratified_split": lambda sp, d: split_rows(sp, d, lambda e: evaluate.stratified_split(tables.staged(e))),
    "scored_examples": scored_examples,
    "top_features": top_features,
    "boosting_sums": boosting_sums,
    "average_precision": lambda sp, d: rounded(s.evaluation(STAGE(sp, d))),
    "pr_curve": lambda sp, d: rounded(evaluate.pr_curve(tables.staged(s.scored(STAGE(sp, d)).select("pred_proba", "label")))),
    "confusion_matrix": lambda sp, d: evaluate.confusion_matrix(s.scored(STAGE(sp, d))),
    "classification_report": lambda sp, d: rounded(evaluate.classification_report(s.scored(STAGE(sp, d)))),
    "calibration_curve": lambda sp, d: rounded(evaluate.calibration_curve(s.scored(STAGE(sp, d)))),
    "max_target_prob": lambda sp, d: rounded(evaluate.max_target_prob(s.scored(STAGE(sp, d)))),
    "map_predictions": lambda sp, d: rounded((lambda p: evaluate.map_predictions(s.centroids(p), s.scored(p)))(STAGE(sp, d))),
    "predicted_edges": lambda sp, d: rounded(evaluate.predicted_edges(s.scored(STAGE(sp, d)), 0.9)),
    "actual_edges": lambda sp, d: rounded(evaluate.actual_edges(s.scored(STAGE(sp, d)))),
    "burning_sources": burning_sources,
    "new_burns": new_burns,
    "choose_time": lambda sp, d: evaluate.choose_time(edges.filter_burning(P(sp, d))),
    "node_coords": node_coords,
    "mean_wind": lambda sp, d: rounded(graph.mean_wind(P(sp, d)), 3),
    "adjacency_rw": lambda sp, d: rounded(s.spread_graph(P(sp, d), "rw")),
    "adjacency_sym": lambda sp, d: rounded(s.spread_graph(P(sp, d), "sym")),
    "adjacency_wind": lambda sp, d: rounded(s.wind_graph(STAGE(sp, d))),
    "adjacency_files": adjacency_files,
    "tensor": lambda sp, d: rounded(s.spread_tensor(STAGE(sp, d)), 4),
    "tensor_all_nodes": all_nodes,
    "tensor_files": tensor_files,
    "tensor_static_files": tensor_static_files,
    "tensor_static": lambda sp, d: rounded(tensor.tensor_static(P(sp, d), s.static_table(sp, d))),
    "tensor_stats": checked_tensor,
}
