"""Shared folder, written tables and connected components for the text operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='cindergrid-')}"
    return f"{root.rstrip('/')}/cg-{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """df as a table written to the shared folder, with the writer's options, and read again, which cuts its lineage."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    from pyarrow import fs

    for df in tables:
        store, path = fs.FileSystem.from_uri(df.stored)
        store.delete_dir(path)


def tree_sum(rows: DataFrame, part: Callable, shape: tuple, dtype=np.float64, fan: int = 64) -> np.ndarray:
    """The sum over all record batches of part(batch), an array of the given shape: summed in each task, then in ever fewer tasks."""

    def gather(found):
        yield pa.record_batch([pa.array([sum(found, np.zeros(shape, dtype)).astype(dtype).tobytes()], pa.binary())], names=["sum"])

    read = lambda b: sum((np.frombuffer(v.as_buffer(), dtype).reshape(shape) for v in b.column("sum")), np.zeros(shape, dtype))
    tasks = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(lambda batches: gather(part(b) for b in batches if b.num_rows), "sum binary")
    while tasks > fan:
        tasks = math.ceil(tasks / fan)
        sums = sums.repartition(tasks).mapInArrow(lambda batches: gather(map(read, batches)), "sum binary")
    return sum((np.frombuffer(r.sum, dtype).reshape(shape) for r in sums.collect()), np.zeros(shape, dtype))


def with_facts(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with the facts of their key; facts has a row for each key, with n, the number of rows that have it, of total.

    A key with more than a thousandth of the rows would fill one task: the facts of these, a thousand at most, are broadcast.
    """
    often = F.col("n") * 1000 > total
    few = F.broadcast(facts.where(often))
    many = rows.join(F.broadcast(facts.where(often).select(key)), key, "left_anti").join(facts.where(~often), key)
    return rows.join(few, key).drop("n").unionByName(many.drop("n"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text 'null'."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n).cast("int")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (u, v): label is the smallest node reachable.

    Alternates large-star and small-star steps; each is a minimum per node and an equi-join, so no
    neighbourhood is collected, and each round's edges are written to the shared folder. Ends when a round
    changes no edge. The joins' rows are two numbers wide; a hub's partition is split by the adaptive skew join.
    """
    stars = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = stars.count()
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        last, stars = stars, written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        same = (now := stars.count()) == n and stars.join(last, ["u", "v"], "left_anti").isEmpty()
        discard(last)
        n = now
        if same:
            break
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
