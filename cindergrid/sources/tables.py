"""Reading and writing points, stages, grids, feature lists, tensors and graphs."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.functions.expressions import nan_to_null, unproject_utm

#: Accepted coordinate column names, in order of preference.
LON_NAMES, LAT_NAMES = ("lon", "longitude", "long"), ("lat", "latitude")
LAT_EXACT, LON_EXACT = ("lat", "latitude", "y", "centroid_y"), ("lon", "longitude", "x", "centroid_x")
#: Columns of examples that are no features, and those that come first among the features.
LABEL_COLUMNS = ("label", "time_epoch", "sx", "sy", "tx", "ty")
PREFERRED_FEATURES = ("dist_m", "frp_src", "frp_src_trend", "burning_neighbor_count", "mean_frp_neighbors", "wind_align")
NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def resolve_latlon(columns: list[str]) -> tuple[str, str]:
    """Names of the latitude and longitude columns: exact names first, then names that contain them."""
    low = {c.lower(): c for c in columns}

    def find(exact, parts):
        found = next((low[n] for n in exact if n in low), None) or next((c for c in columns if any(p in c.lower() for p in parts)), None)
        if found is None:
            raise ValueError(f"no column like {exact[0]} in {columns}")
        return found

    return find(LAT_EXACT, ("lat",)), find(LON_EXACT, ("lon", "long"))


def read_points(spark: SparkSession, path: str, schema: T.StructType | str, lon: str | None = None, lat: str | None = None) -> DataFrame:
    """CSV points with a header and a given schema; rows without coordinates are dropped."""
    df = spark.read.csv(path, header=True, schema=schema)
    low = {c.lower(): c for c in df.columns}
    names = []
    for given, choices in ((lon, LON_NAMES), (lat, LAT_NAMES)):
        name = given if given in df.columns else next((low[c] for c in choices if c in low), None)
        if name is None:
            raise ValueError(f"no column like {choices[0]} in {df.columns}")
        names.append(name)
    return nan_to_null(df).dropna(subset=names)


def shared_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='cindergrid-')).rstrip('/')}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once however often it is read, and pruned by its readers."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, **facts) -> tuple[DataFrame, dict]:
    """df as staged, and aggregates of it that the same pass takes down."""
    seen = Observation()
    out = staged(df.observe(seen, *(c.alias(n) for n, c in facts.items())))
    return out, seen.get


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet stage; NaN becomes null. A missing path is an error."""
    return nan_to_null(spark.read.parquet(path))


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_panel(df: DataFrame, path: str, time: str = "datetime_bin") -> None:
    """A panel partitioned by day."""
    write_stage(df.withColumn("day", F.to_date(time)), path, ["day"])


def write_grid(grid: DataFrame, path: str, zone: int, north: bool = True) -> None:
    """The boxes with centroids in metres, and a table of the centroids' longitudes and latitudes."""
    lon, lat = unproject_utm(F.col("centroid_x"), F.col("centroid_y"), zone, north)
    write_stage(grid, f"{path}/boxes")
    write_stage(grid.select("cell_id", lon.alias("lon"), lat.alias("lat")), f"{path}/centroids")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Boxes with centroids, which are worked out where the table lacks them."""
    grid = read_stage(spark, path)
    if "centroid_x" not in grid.columns:
        grid = grid.withColumns({"centroid_x": (F.col("xmin") + F.col("xmax")) / 2, "centroid_y": (F.col("ymin") + F.col("ymax")) / 2})
    return grid


def feature_list(df: DataFrame, first: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns but labels and coordinates: those named first in their order, then the rest in table order."""
    rank = {c: i for i, c in enumerate(first)}
    found = [c for c, t in df.dtypes if t in NUMERIC and c not in LABEL_COLUMNS]
    return sorted(found, key=lambda c: rank.get(c, len(rank)))


def write_feature_list(spark: SparkSession, features: list[str], path: str) -> None:
    write_json(spark, features, path)


def read_feature_list(df: DataFrame, path: str | None = None) -> list[str]:
    """The list in the file if there is one, else what the table's columns give."""
    try:
        return read_json(df.sparkSession, path) if path else feature_list(df)
    except AnalysisException:
        return feature_list(df)


def write_json(spark: SparkSession, value, path: str) -> None:
    """A small value as one JSON line in a folder that Spark writes."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def tensor_table(spark: SparkSession, path: str, buckets: int) -> str:
    """The name of the session's table over a written tensor's blocks."""
    name = f"tensor_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        fields = spark.read.parquet(f"{path}/blocks").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cell_id) SORTED BY (cell_id, block) INTO {buckets} BUCKETS LOCATION '{path}/blocks'")
    return name


def write_tensor(tensor: DataFrame, features: list[str], meta: dict, path: str, static: DataFrame | None = None, nodes: DataFrame | None = None, buckets: int = 64, block: int = 720) -> None:
    """A tensor as blocks of a node's positions: x, an array of feature arrays, and labels; bucketed and sorted by node.

    The static block (cell_id and numbers) and the nodes' index go beside it, and meta with features, buckets, block and static columns.
    """
    spark = tensor.sparkSession
    rows = tensor.groupBy("cell_id", F.floor(F.col("t_idx") / block).cast("int").alias("block"))
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("t_idx", F.array(*(F.col(c).cast("float") for c in features)).alias("x"), "y_current", "y_future"))).alias("r"))
    each = lambda c: F.transform("r", lambda r: r[c]).alias(c)
    packed = packed.select("cell_id", "block", F.col("r")[0]["t_idx"].alias("first"), *map(each, ("x", "y_current", "y_future")))
    name = f"writing_{uuid.uuid4().hex}"
    packed.write.mode("overwrite").option("path", f"{path}/blocks").bucketBy(buckets, "cell_id").sortBy("cell_id", "block").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    own = []
    if static is not None:
        own = [c for c, t in static.dtypes if c != "cell_id" and t in NUMERIC]
        write_stage(static.select("cell_id", *(F.coalesce(F.col(c).cast("float"), F.lit(0.0)).cast("float").alias(c) for c in own)), f"{path}/static")
    if nodes is not None:
        write_stage(nodes, f"{path}/nodes")
    write_json(spark, meta | {"features": features, "buckets": buckets, "block": block, "static": own}, f"{path}/meta")


def read_tensor(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The blocks, as a bucketed table, so that what goes by node needs no exchange; and the meta."""
    meta = read_json(spark, f"{path}/meta")
    return spark.table(tensor_table(spark, path, meta["buckets"])), meta


def unpack_tensor(blocks: DataFrame, features: list[str]) -> DataFrame:
    """A row for each node and position."""
    zipped = F.posexplode(F.arrays_zip("x", "y_current", "y_future")).alias("at", "r")
    rows = blocks.select("cell_id", "first", zipped)
    return rows.select("cell_id", (F.col("first") + F.col("at")).alias("t_idx"), *(F.col("r.x")[i].alias(c) for i, c in enumerate(features)), "r.y_current", "r.y_future")


def write_adjacency(edges: DataFrame, nodes: DataFrame, meta: dict, path: str, scale: float | None = None, wind_strength: float = 0.0) -> None:
    """Edges, the nodes' index and meta; the numbers of nodes and edges are counted as they are written."""
    counts = []
    for df, name in ((edges.withColumn("weight", F.col("weight").cast("float")), "edges"), (nodes, "nodes")):
        seen = Observation()
        write_stage(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{path}/{name}")
        counts.append(seen.get["n"])
    facts = {"node_count": counts[1], "sparse_nonzeros": counts[0], "scale_distance": scale, "use_wind": bool(wind_strength), "wind_strength": wind_strength}
    write_json(edges.sparkSession, meta | facts, f"{path}/meta")
