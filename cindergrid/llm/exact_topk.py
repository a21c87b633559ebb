"""Exact top-k inner products of query vectors against all vectors, by tiled matrix products.

Vectors are packed into tiles of at most TILE rows (in ascending id), queries into blocks of at most BLOCK. Tiles and
blocks are dealt to the rows and columns of a grid of cells, whose number grows with the number of products and whose shape
keeps what is copied small; they meet by an equi-join on the cell. A task multiplies tile and block, keeps each query's
k best of that tile and sends those only. Lists merge in a tree: by salted query first, then by query. Products run in
float64 where every partial sum is below 2**53 and in Python integers beyond, so scores are exact; a score outside
the range of a long is held at its end.

Null vectors, null ids, vectors with null or non-finite components take no part. Vectors of other lengths than the
query's are no candidates for it. Ties go to the smaller id. Rows with a query's own id are never its candidates;
a repeated row is a candidate as often as it occurs, a repeated query id is answered once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE, BLOCK, FAN = 4096, 512, 64
LEAST_CELLS, CELL_PRODUCTS = 32, 1 << 30
PACK = "tg int, qg int, dim int, ids binary, data binary"


def grid(vectors: int, queries: int) -> tuple[int, int]:
    """Groups of tiles and of query blocks: about CELL_PRODUCTS products a cell, groups in proportion to what they hold."""
    cells = max(LEAST_CELLS, math.ceil(vectors * queries / CELL_PRODUCTS))
    blocks = max(1, min(math.ceil(queries / BLOCK), round(math.sqrt(cells * queries / max(1, vectors)))))
    return math.ceil(cells / blocks), blocks


def packed(rows: DataFrame, size: int, groups: tuple[int, int], tiles: bool) -> DataFrame:
    """Rows of (id long, vec array<double>) as blobs of the components' floors; a tile goes to a row of the grid, a block to a column."""

    def pack(batches):
        held: dict[int, list] = {}
        n = 0

        def out(dim):
            nonlocal n
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            order = np.argsort(ids, kind="stable")
            for a in range(0, len(ids), size):
                part = order[a : a + size]
                own, copies = (n + int(ids[part[0]])) % groups[not tiles], groups[tiles]
                n += 1
                blobs = ids[part].tobytes(), np.ascontiguousarray(data[part]).tobytes()
                for other in range(copies):
                    cell = (own, other) if tiles else (other, own)
                    yield pa.record_batch([pa.array([cell[0]], pa.int32()), pa.array([cell[1]], pa.int32()), pa.array([dim], pa.int32()), pa.array([blobs[0]], pa.binary()), pa.array([blobs[1]], pa.binary())], names=["tg", "qg", "dim", "ids", "data"])

        for batch in batches:
            vec = batch.column("vec")
            flat, length = np.floor(vec.flatten().to_numpy(zero_copy_only=False)), np.diff(vec.offsets.to_numpy() - 0)
            ids = batch.column("id").to_numpy()
            start = np.r_[0, np.cumsum(length)[:-1]]
            for dim in np.unique(length):
                own = np.flatnonzero(length == dim)
                held.setdefault(int(dim), []).append((ids[own], flat[start[own][:, None] + np.arange(dim)]))
                if sum(len(x[0]) for x in held[int(dim)]) >= size:
                    yield from out(int(dim))
        for dim in list(held):
            yield from out(dim)

    return rows.mapInArrow(pack, PACK)


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """All inner products as int64 (float64 matrices of whole numbers in)."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(tile).max(initial=0)) * max(1, tile.shape[1])
    if bound < 2.0**53:
        return (queries @ tile.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in queries], object).reshape(queries.shape) @ np.array([[int(v) for v in r] for r in tile], object).reshape(tile.shape).T
    return np.array([[min(max(int(v), -(2**63)), 2**63 - 1) for v in r] for r in exact], np.int64).reshape(len(queries), len(tile))


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest scores; ties go to the smaller column."""
    n = score.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(score), 1))
    if np.abs(score.astype(np.float64)).max(initial=0) < 2.0**62 / n:
        key = score * n + (n - 1 - np.arange(n))
        return np.argpartition(key, n - k, axis=1)[:, n - k :]
    return np.argsort(~score, axis=1, kind="stable")[:, :k]  # ~ turns the order round without overflow


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * component)."""
    fine = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    base = vectors.where(fine).select(F.col(vec_id).cast("long").alias("id"), scaled.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, asked = base.agg(F.count("*"), F.count_if("q")).first()
    tiles = packed(base.select("id", "vec"), TILE, grid(n, asked), True)
    blocks = packed(base.where("q").dropDuplicates(["id"]).select("id", "vec"), BLOCK, grid(n, asked), False)
    pairs = tiles.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(FAN))).join(blocks.withColumnsRenamed({"ids": "qids", "data": "qdata"}), ["tg", "qg", "dim"])

    def multiply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                blob = lambda name: batch.column(name)[i].as_buffer()  # noqa: B023, E731
                ids, qids, dim, salt = np.frombuffer(blob("ids"), np.int64), np.frombuffer(blob("qids"), np.int64), batch.column("dim")[i].as_py(), batch.column("salt")[i].as_py()
                tile, query = (np.frombuffer(blob(x), np.float64).reshape(len(own), dim) for x, own in (("data", ids), ("qdata", qids)))
                score = products(query, tile)
                own = ids[None, :] == qids[:, None]
                width = min(len(ids), k + int(own.sum(axis=1).max(initial=0)))
                at = best(score, width)
                row = np.repeat(np.arange(len(qids)), at.shape[1])
                at = at.ravel()
                keep = ~own[row, at]
                row, at = row[keep], at[keep]
                yield pa.record_batch([pa.array(qids[row]), pa.array(ids[at]), pa.array(score[row, at]), pa.array(np.full(len(row), salt), pa.int64())], names=["query_id", "vec_id", "score", "salt"])

    lists = pairs.select("dim", "ids", "data", "qids", "qdata", "salt").mapInArrow(multiply, "query_id long, vec_id long, score long, salt long")
    order = [F.col("score").desc(), F.col("vec_id")]
    for keys in (["query_id", "salt"], ["query_id"]):
        lists = lists.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")
