"""Second-order boosted trees on histograms.

Features are cut at quantiles into bins once; rows are kept narrow: bins, label, a hash, the margin so far. A level of a tree is one
aggregate: sums of gradient and curvature by (node, feature, bin), at most nodes * features * bins rows, from which the driver picks
the splits. Sums are of whole numbers (parts of 2**-30), so trees don't depend on the order of rows. The grown tree is an expression
over the bins, which gives the next margins; these are written each round, which cuts the lineage. Nothing else grows with the rows.
"""

from __future__ import annotations

import dataclasses
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.sources.tables import read_json, staged, write_json

UNIT = 1 << 30
NODES = "tree int, node int, feature string, threshold double, low int, high int, value double, gain double"


def gradients(objective: str, margin: Column, label: Column, weight: float = 1.0, alpha: float = 0.25, gamma: float = 2.0) -> tuple[Column, Column]:
    """Gradient and curvature, in units: of the weighted logistic loss, or the focal loss's fixed formulas."""
    p = 1 / (1 + F.exp(-margin))
    if objective == "logistic":
        scale = F.when(label == 1, weight).otherwise(1.0)
    elif objective == "focal":
        scale = F.when(label == 1, alpha).otherwise(1 - alpha) * F.pow(1 - p, F.lit(gamma))
    else:
        raise ValueError(objective)
    unit = lambda c: F.round(c * UNIT).cast("long")
    return unit((p - label) * scale), unit(p * (1 - p) * scale)


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are below the value, by halving."""

    def part(low, high):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= cuts[middle], part(low, middle)).otherwise(part(middle + 1, high))

    return part(0, len(cuts)).cast("int")


def quantile_cuts(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to bins - 1 cuts of each feature; two numbers a bin and feature reach the driver."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 100 * bins).alias(f"f{i}") for i, c in enumerate(features))).first()
    return [sorted({float(v) for v in cuts or []}) for cuts in found]


def histogram(rows: DataFrame, node: Column, columns: list[int], bins: int) -> DataFrame:
    """(node, code, g, h, n): sums of g and h by node, feature and bin; code is feature * bins + bin."""
    codes = F.explode(F.array(*(F.col(f"b{i}") + i * bins for i in columns)))
    return rows.select(node.alias("node"), codes.alias("code"), "g", "h").groupBy("node", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def best_split(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, bin): rows up to the bin go low. g and h are sums by (feature, bin); features without rows can't win."""
    low_g, low_h = np.cumsum(g, axis=1)[:, :-1] / UNIT, np.cumsum(h, axis=1)[:, :-1] / UNIT
    all_g, all_h = (x.sum(axis=1, keepdims=True) / UNIT for x in (g, h))
    gain = low_g**2 / (low_h + reg) + (all_g - low_g) ** 2 / (all_h - low_h + reg) - all_g**2 / (all_h + reg)
    gain = np.where((low_h >= least) & (all_h - low_h >= least), gain, -np.inf)
    at = int(np.argmax(gain)) if gain.size else 0
    return (float(gain.flat[at]), *divmod(at, gain.shape[1])) if gain.size else (-np.inf, 0, 0)


@dataclasses.dataclass
class Trees:
    """features, and trees as lists of nodes (feature, threshold, low, high, value, gain); the first node is the root, inner ones have no value."""

    features: list[str]
    trees: list[list[tuple]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            feature, threshold, low, high, value = (np.array([n[i] if n[i] is not None else 0 for n in nodes], float if i in (1, 4) else np.int64) for i in range(5))
            leaf = np.array([n[0] is None for n in nodes])
            while not leaf[at].all():
                goes = x[np.arange(len(x)), feature[at]] <= threshold[at]
                at = np.where(leaf[at], at, np.where(goes, low[at], high[at]))
            out += value[at]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each node."""
        rows = [(t, i, None if f is None else self.features[f], *rest) for t, nodes in enumerate(self.trees) for i, (f, *rest) in enumerate(nodes)]
        return spark.createDataFrame(rows, NODES)


def write_trees(spark: SparkSession, model: Trees, path: str) -> None:
    """The nodes as a Parquet table and the feature list beside it."""
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    write_json(spark, model.features, f"{path}/features")


def read_trees(spark: SparkSession, path: str) -> Trees:
    features = read_json(spark, f"{path}/features")
    trees: list[list[tuple]] = []
    for r in sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: (r.tree, r.node)):
        if r.tree == len(trees):
            trees.append([])
        trees[r.tree].append((None if r.feature is None else features.index(r.feature), r.threshold, r.low, r.high, r.value, r.gain))
    return Trees(features, trees)


def binned_precision(rows: DataFrame, score: Column, parts: int = 1 << 16) -> float:
    """Average precision of scores in (0, 1) rounded to parts; at most that many rows reach the driver."""
    found = rows.groupBy(F.floor(score * parts).alias("s")).agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    hit, total = 0, 0
    area, positives = 0.0, sum(r.p for r in found)
    for r in sorted(found, key=lambda r: -r.s):
        hit, total = hit + r.p, total + r.n
        area += r.p * hit / total
    return area / positives if positives else 0.0


def boost(train: DataFrame, features: list[str], validation: DataFrame | None = None, *, rounds: int = 500, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, columns: float = 0.8, patience: int = 25,
          objective: str = "logistic", weight: float = 1.0, alpha: float = 0.25, gamma: float = 2.0, bins: int = 64, reg: float = 1.0, least: float = 1.0, seed: int = 42, key: list[str] | None = None) -> Trees:
    """Trees for label 0 or 1 from features without nulls.

    A tree sees `subsample` of the rows, by a hash of their key (all columns by default), and `columns` of the features. With a
    validation table, boosting ends after `patience` rounds without a better average precision there, and keeps the best number of trees.
    """
    cuts = quantile_cuts(train, features, bins)

    def narrow(df, test):
        u = F.xxhash64(*(key or df.columns))
        return df.select(*(bin_of(F.col(c).cast("double"), cuts[i]).alias(f"b{i}") for i, c in enumerate(features)), F.col("label").cast("int").alias("y"), u.alias("u"), F.lit(test).alias("test"), F.lit(0.0).alias("margin"))

    rows = narrow(train, False)
    rows = staged(rows if validation is None else rows.unionByName(narrow(validation, True)))
    rng = random.Random(seed)
    trees: list[list[tuple]] = []
    best, best_at = -1.0, 0
    for t in range(rounds):
        own = sorted(rng.sample(range(len(features)), max(1, math.ceil(columns * len(features)))))
        g, h = gradients(objective, F.col("margin"), F.col("y"), weight, alpha, gamma)
        seen = ~F.col("test") if subsample >= 1 else ~F.col("test") & (F.pmod(F.xxhash64("u", F.lit(seed), F.lit(t)), F.lit(1 << 20)) < int(subsample * (1 << 20)))
        sampled = rows.where(seen).withColumns({"g": g, "h": h})
        nodes: list[list] = [[None, None, None, None, None, None, None]]  # as in Trees, then the bin
        open_ = [0]

        def walk(i, leaf):
            f, _, low, high, _, _, b = nodes[i]  # noqa: B023
            return leaf(i) if f is None else F.when(F.col(f"b{f}") <= b, walk(low, leaf)).otherwise(walk(high, leaf))

        for level in range(depth):
            known = set(open_)
            place = walk(0, lambda i: F.lit(i if i in known else -1))  # noqa: B023
            sums = {}
            for r in histogram(sampled, place, own, bins).where("node >= 0").collect():
                if r.node not in sums:
                    sums[r.node] = np.zeros((2, len(features), bins))
                sums[r.node][:, r.code // bins, r.code % bins] = r.g, r.h
            following = []
            for i in sorted(open_):
                if i not in sums:
                    nodes[i][4] = nodes[i][4] or 0.0
                    continue
                part = sums[i][:, own]
                total_g, total_h = part[:, 0].sum(axis=1) / UNIT
                nodes[i][4] = float(-rate * total_g / (total_h + reg))
                gain, f, b = best_split(part[0], part[1], reg, least)
                if gain <= 1e-6:
                    continue
                f = own[f]
                sides = []
                for side in (sums[i][:, f, : b + 1].sum(axis=1), sums[i][:, f, b + 1 :].sum(axis=1)):
                    sides.append(len(nodes))
                    nodes.append([None, None, None, None, float(-rate * (side[0] / UNIT) / (side[1] / UNIT + reg)), None, None])
                nodes[i] = [f, cuts[f][b], *sides, None, gain, b]
                following += sides
            open_ = following
            if not open_:
                break
        trees.append([tuple(n[:6]) for n in nodes])
        rows = staged(rows.withColumn("margin", F.col("margin") + walk(0, lambda i: F.lit(float(nodes[i][4] or 0.0)))))  # noqa: B023
        if validation is not None:
            now = binned_precision(rows.where("test"), 1 / (1 + F.exp(-F.col("margin"))))
            if now > best:
                best, best_at = now, t + 1
            elif t + 1 - best_at >= patience:
                break
    return Trees(features, trees if validation is None else trees[:best_at])


def with_margin(model: Trees, rows: DataFrame, name: str) -> DataFrame:
    """rows with the trees' sum; null features count as 0, absent ones too."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.DoubleType())
    def margin(x):
        import pandas as pd

        return pd.Series(model.margins(np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(model.features)))))

    zero = F.lit(0.0)
    x = F.array(*(F.coalesce(F.col(c).cast("double"), zero) if c in rows.columns else zero for c in model.features))
    return rows.withColumn(name, margin(x))
