"""Cell and time aggregates, sparse and dense panels, stations and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.functions.expressions import haversine_m
from cindergrid.operators.blocks import BLOCK, block_of, carried
from cindergrid.operators.nearest import near_pairs
from cindergrid.operators.places import numbered
from cindergrid.sources.tables import NUMERIC, read_stage, staged

KEYS = ["cell_id", "datetime_bin"]
WEATHER_MARKS = ("t2m", "wind_speed", "u10", "v10", "wind_dir_deg")
STATION_COLUMNS = ("t2m", "u10", "v10", "air_temperature", "temperature", "t2m_c")
#: Which statistics the weather table has of each column.
WEATHER_STATISTICS = {"t2m": ("mean", "max", "std"), "wind_speed": ("mean", "max", "std"), "u10": ("mean",), "v10": ("mean",), "wind_dir_deg": ("mean",)}
#: Values of a category that get columns of their own, at most.
WIDEST = 2000
STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def aggregate_static(points: DataFrame, numeric: list[str], categorical: list[str] = (), values: dict[str, list[str]] | None = None) -> DataFrame:
    """Per cell mean, sample std, min, max of numbers; mode (ties: smallest) and shares of categories.

    A share's column for each of the given values, else for each value there is: these are counted first, and more than WIDEST of
    them are an error; category_shares fits columns of many values.
    """
    points = points.where("cell_id is not null")
    aggs = [f(c).alias(f"{c}_{n}") for c in numeric for n, f in STATISTICS.items()]
    for c in categorical:
        aggs.append(F.mode(c, True).alias(f"{c}_mode"))
        known = (values or {}).get(c)
        if known is None:
            known = sorted(r[0] for r in points.where(F.col(c).isNotNull()).select(c).distinct().limit(WIDEST + 1).collect())
            if len(known) > WIDEST:
                raise ValueError(f"{c} has more than {WIDEST} values: name those that get columns, or use category_shares")
        aggs += [F.try_divide(F.count_if(F.col(c) == v), F.count(c)).alias(f"{c}_prop_{v}") for v in known]
    return points.groupBy("cell_id").agg(*aggs) if aggs else points.select("cell_id").distinct()


def category_shares(points: DataFrame, column: str) -> DataFrame:
    """(cell_id, shares): a map from value to share, for unbounded categories."""
    n = points.where(F.col("cell_id").isNotNull() & F.col(column).isNotNull()).groupBy("cell_id", column).agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("cell_id")))
    return share.groupBy("cell_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column), F.col("share"))))).alias("shares"))


def aggregate_weather(points: DataFrame) -> DataFrame:
    aggs = [STATISTICS[n](c).alias(f"{c}_{n}") for c, names in WEATHER_STATISTICS.items() if c in points.columns for n in names]
    return points.dropna(subset=KEYS).groupBy(*KEYS).agg(*aggs, F.count("*").alias("_obs_count_sum"))


def aggregate_fire(points: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = []
    if "frp" in points.columns:
        aggs += [zero(F.sum("frp")).alias("frp_sum"), zero(F.max("frp")).alias("frp_max")]
    if "brightness" in points.columns:
        aggs += [zero(F.avg("brightness")).alias("brightness_mean"), zero(F.max("brightness")).alias("brightness_max")]
    return points.dropna(subset=KEYS).groupBy(*KEYS).agg(*aggs, F.count("*").cast("int").alias("fire_count"), F.lit(True).alias("fire_any"))


def fill_missing(df: DataFrame) -> DataFrame:
    """False and zero for missing fire values and every sum, maximum and mean."""
    fill = {c: False if t == "boolean" else 0 for c, t in df.dtypes if c in ("fire_any", "fire_count") or (t in NUMERIC and c.endswith(("_sum", "_max", "_mean")))}
    return df.na.fill(fill) if fill else df


def union_keys(*tables: DataFrame) -> DataFrame:
    out = tables[0].select(*KEYS)
    for t in tables[1:]:
        out = out.union(t.select(*KEYS))
    return out.distinct()


def fill_weather(panel: DataFrame, block: int = BLOCK) -> DataFrame:
    """Weather columns carried forward, then backward, per cell in time order, by blocks of hours."""
    cols = [c for c in panel.columns if any(m in c for m in WEATHER_MARKS)]
    return carried(panel, cols, F.unix_micros(F.col("datetime_bin").cast("timestamp")) / 3_600_000_000, block).select(*panel.columns) if cols else panel


def join_panel_sparse(weather: DataFrame, fire: DataFrame, fill_order: str = "zero_first") -> DataFrame:
    """All observed keys with both aggregates. Keys are unique on each side, so one full outer join holds their union."""
    panel = weather.join(fire, KEYS, "full_outer")
    if fill_order == "zero_first":
        return fill_weather(fill_missing(panel))
    if fill_order == "carry_first":
        return fill_missing(fill_weather(panel))
    raise ValueError(fill_order)


def densify_panel(panel: DataFrame, minutes: int, fill_fire: bool = False) -> DataFrame:
    """A row for every bin between a cell's first and last; fire columns stay null on added rows unless fill_fire."""
    span = panel.groupBy("cell_id").agg(F.min("datetime_bin").alias("lo"), F.max("datetime_bin").alias("hi"))
    times = span.select("cell_id", F.explode(F.sequence("lo", "hi", F.expr(f"interval {minutes} minutes"))).alias("datetime_bin"))
    dense = fill_weather(times.join(panel, KEYS, "left"))
    return fill_missing(dense) if fill_fire else dense


def distinct_stations(weather: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(station_idx, lat, lon) of the distinct places, numbered in order; one row for each station."""
    places = weather.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).dropna().distinct()
    return numbered(places, ["lat", "lon"], "station_idx").select("station_idx", "lat", "lon")


def nearest_station(cells: DataFrame, stations: DataFrame) -> DataFrame:
    """(cell_id, station_idx, dist_m) of cells (cell_id, lon, lat); ties go to the smaller (lat, lon).

    Places are points of the unit sphere: the chord between two grows with the distance on the ground, without a seam or a pole.
    """
    at = lambda df: df.dropna(subset=["lat", "lon"]).withColumns({"ux": F.cos(F.radians("lat")) * F.cos(F.radians("lon")), "uy": F.cos(F.radians("lat")) * F.sin(F.radians("lon")), "uz": F.sin(F.radians("lat"))})
    own = at(cells.select("cell_id", *(F.col(c).cast("double").alias(c) for c in ("lat", "lon"))).dropDuplicates(["cell_id"]))
    near = near_pairs(own, at(stations.select("station_idx", *(F.col(c).cast("double").alias(c) for c in ("lat", "lon")))), ["ux", "uy", "uz"], 1, ["lat", "lon", "station_idx"])
    metres = haversine_m(F.col("q_lat"), F.col("q_lon"), F.col("t_lat"), F.col("t_lon"))
    best = near.groupBy(F.col("q_cell_id").alias("cell_id")).agg(F.min(F.struct(metres.alias("d"), F.col("t_lat"), F.col("t_lon"), F.col("t_station_idx"))).alias("best"))
    return best.select("cell_id", F.col("best.t_station_idx").alias("station_idx"), F.col("best.d").alias("dist_m"))


def aggregate_station_weather(weather: DataFrame, stations: DataFrame) -> DataFrame:
    """Per (station, bin) means and maxima of the known columns present (else all numbers), and a count."""
    cols = [c for c in STATION_COLUMNS if c in weather.columns] or [c for c, t in weather.dtypes if t in NUMERIC and c not in ("lat", "lon")]
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("max", F.max))]
    return weather.join(stations, ["lat", "lon"]).where("datetime_bin is not null").groupBy("station_idx", "datetime_bin").agg(*aggs, F.count("*").alias("_cnt_sum"))


def station_fanout(station_weather: DataFrame, mapping: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each cell and bin of the cell's station.

    The mapping is copied to the blocks of hours that its stations have, and both meet by station and block, so a station with many
    cells or bins is shared out.
    """
    timed = station_weather.withColumn("__block", block_of(F.unix_seconds(F.col("datetime_bin").cast("timestamp")) / 3600, block))
    cells = mapping.select("cell_id", "station_idx").join(timed.select("station_idx", "__block").distinct(), "station_idx")
    return timed.join(cells, ["station_idx", "__block"]).drop("station_idx", "__block")


def restrict_to_panel(fire: DataFrame, panel: DataFrame) -> DataFrame:
    return fire.join(panel.select("cell_id").distinct(), "cell_id", "left_semi")


def missing_cells(panel: DataFrame, static: DataFrame) -> DataFrame:
    return panel.select("cell_id").distinct().join(static, "cell_id", "left_anti")


def refresh_panel_fire(panel: DataFrame, fire: DataFrame) -> DataFrame:
    kept = panel.drop(*(c for c in panel.columns if c.startswith(("frp", "fire"))))
    return fill_missing(kept.join(fire.select(*KEYS, "fire_count", "fire_any", "frp_sum"), KEYS, "left"))


def refresh_days(spark: SparkSession, path: str, fire: DataFrame, days: list[str]) -> None:
    """refresh_panel_fire for some days (yyyy-MM-dd) of a written panel: only their partitions are read, worked out and overwritten.

    Its fills look at nothing but their own row, so no hours around the days are needed.
    """
    wanted = [F.to_date(F.lit(d)) for d in days]
    rows = read_stage(spark, path).where(F.col("day").isin(wanted)).drop("day")
    fresh = staged(refresh_panel_fire(rows, fire.where(F.to_date("datetime_bin").isin(wanted))))
    fresh.withColumn("day", F.to_date("datetime_bin")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def dedup_panel(panel: DataFrame, hour: str = "epoch_hr") -> DataFrame:
    """One row per (hour, cell): sums of frp_sum and fire_count, any fire, means of the rest."""
    aggs = [F.sum(c).alias(c) if c in ("frp_sum", "fire_count", "_obs_count_sum") else F.max(c).alias(c) if t == "boolean" or c.endswith("_max") else F.avg(c).alias(c) for c, t in panel.dtypes if c not in (hour, "cell_id") and (t in NUMERIC or t == "boolean")]
    return panel.groupBy(hour, "cell_id").agg(*aggs)
