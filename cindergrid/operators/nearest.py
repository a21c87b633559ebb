"""Candidates for exact nearest neighbours, by trees of queries and targets that are counted and descended together.

A tree's node is a square (or cube) with its points' bounds; one with more than CAP points is split into 4 parts a side, as
often as needed, so leaves hold a bounded number of points however they cluster. Both trees are descended level by level: for each
node of queries its nodes of targets are sorted by the farthest distance between the two bounds, and once they hold as many targets as
are wanted, no farther node can matter. The nodes kept are written at each level. Leaves that are left meet by equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.sources.tables import staged, staged_with

CAP = 16
STEP = 2  # bits of each coordinate that a level takes
BITS = {1: 24, 2: 24, 3: 20}
SLACK = 1 + 1e-9


def counted_tree(points: DataFrame, dims: list[str], low: list[float], extent: float, cap: int = CAP) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each level below the root (place, parent's place, number of points, bounds, whether a leaf), and points with their leaf."""
    bits = BITS[len(dims)]
    whole = [F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor((F.col(c) - a) / extent * (1 << bits)))).cast("long") for c, a in zip(dims, low)]
    points = points.withColumns({f"__{c}": w for c, w in zip(dims, whole)})
    place = lambda level: F.struct(F.lit(level).alias("level"), *(F.shiftright(f"__{c}", bits - STEP * level).alias(c) for c in dims))
    levels, leaves, alive = [], [], points
    for level in range(1, bits // STEP + 1):
        own = alive.withColumns({"up": place(level - 1), "node": place(level)})
        bounds = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]
        nodes = own.groupBy("node", "up").agg(F.count("*").alias("n"), *bounds).withColumn("leaf", (F.col("n") <= cap) | F.lit(level == bits // STEP))
        nodes, seen = staged_with(nodes, inner=F.count_if(~F.col("leaf")))
        levels.append(nodes)
        at = own.drop("up").join(nodes.select("node", "leaf"), "node")
        leaves.append(at.where("leaf").drop("leaf", *(f"__{c}" for c in dims)))
        if not seen["inner"]:
            break
        alive = at.where("not leaf").drop("leaf", "node")
    return levels, reduce(DataFrame.unionByName, leaves)


def distance_bounds(dims: list[str]) -> tuple[Column, Column]:
    """Least and greatest distance between the boxes of a row's two nodes."""
    zero = F.lit(0.0)
    near = sum((F.pow(F.greatest(zero, F.col(f"tlo_{c}") - F.col(f"qhi_{c}"), F.col(f"qlo_{c}") - F.col(f"thi_{c}")), 2) for c in dims), zero)
    far = sum((F.pow(F.greatest(F.col(f"thi_{c}") - F.col(f"qlo_{c}"), F.col(f"qhi_{c}") - F.col(f"tlo_{c}")), 2) for c in dims), zero)
    return F.sqrt(near), F.sqrt(far)


def leaf_pairs(queries: list[DataFrame], targets: list[DataFrame], dims: list[str], wanted: int) -> DataFrame:
    """(qnode, tnode, reach): leaves of queries with every leaf that may hold one of the wanted nearest targets, all within reach."""

    def side(nodes, a):
        return nodes.select(F.col("up").alias(f"{a}up"), F.col("node").alias(f"{a}node"), F.col("n").alias(f"{a}n"), F.col("leaf").alias(f"{a}leaf"), *(F.col(f"{x}_{c}").alias(f"{a}{x}_{c}") for c in dims for x in ("lo", "hi")))

    pairs = None
    for level in range(max(len(queries), len(targets))):
        if pairs is None:
            pairs = side(queries[0], "q").crossJoin(F.broadcast(side(targets[0], "t"))).drop("qup", "tup")  # at most 64 nodes each
        else:
            for tree, a in ((queries, "q"), (targets, "t")):
                if level < len(tree):
                    mine = [f"{a}node", f"{a}n", f"{a}leaf", *(f"{a}{x}_{c}" for c in dims for x in ("lo", "hi"))]
                    inner = pairs.where(~F.col(f"{a}leaf")).withColumn(f"{a}up", F.col(f"{a}node")).drop(*mine)
                    pairs = pairs.where(f"{a}leaf").unionByName(inner.join(side(tree[level], a), f"{a}up").drop(f"{a}up"))
        near, far = distance_bounds(dims)
        own = W.partitionBy("qnode")
        pairs = pairs.withColumns({"near": near, "far": far})
        pairs = pairs.withColumn("held", F.sum("tn").over(own.orderBy("far").rangeBetween(W.unboundedPreceding, 0)))
        pairs = pairs.withColumn("reach", F.coalesce(F.min(F.when(F.col("held") >= wanted, F.col("far"))).over(own), F.lit(float("inf"))))
        pairs = staged(pairs.where(F.col("near") <= F.col("reach") * SLACK).drop("near", "far", "held"))
    return pairs.select("qnode", "tnode", "reach")


def near_pairs(queries: DataFrame, targets: DataFrame, dims: list[str], wanted: int, ties: list[str], same: bool = False, cap: int = CAP) -> DataFrame:
    """Pairs of rows of both tables, of q_ and t_ columns: every query with its `wanted` nearest targets among them, and few others.

    Distances are Euclidean in dims, numbers without nulls. Of targets at one and the same point only the first `wanted` in the order of
    ties come. same: the tables are one.
    """
    ends = {f"{n}_{c}": f(c) for c in dims for n, f in (("low", F.min), ("high", F.max))}
    (targets, box), (queries, other) = staged_with(targets, **ends), (None, {}) if same else staged_with(queries, **ends)
    end = lambda f, n, c: f((x[f"{n}_{c}"] for x in (box, other) if x.get(f"{n}_{c}") is not None), default=0.0)
    low = [end(min, "low", c) for c in dims]
    extent = max(*(end(max, "high", c) - a for c, a in zip(dims, low)), 1e-9)
    tree, places = counted_tree(targets, dims, low, extent, cap)
    asking, sources = (tree, places) if same else counted_tree(queries, dims, low, extent, cap)
    first = F.row_number().over(W.partitionBy("node", *dims).orderBy(*ties))
    places = places.withColumn("__first", first).where(F.col("__first") <= wanted).drop("__first")
    pairs = leaf_pairs(asking, tree, dims, wanted)
    named = lambda df, a: df.select(F.col("node").alias(f"{a}node"), *(F.col(c).alias(f"{a}_{c}") for c in df.columns if c != "node"))
    met = named(sources, "q").join(pairs, "qnode").join(named(places, "t"), "tnode")
    apart = F.sqrt(sum((F.pow(F.col(f"q_{c}") - F.col(f"t_{c}"), 2) for c in dims), F.lit(0.0)))
    return met.where(apart <= F.col("reach") * SLACK).drop("qnode", "tnode", "reach")
