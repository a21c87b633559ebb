"""Splits, training, scoring, evaluation and map tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cindergrid.operators.boosting import Trees, boost, with_margin
from cindergrid.operators.places import hash_places
from cindergrid.sources.tables import staged


def time_split(edges: DataFrame, time: str = "time_epoch") -> DataFrame:
    """edges with split: cuts at the 70th and 85th percentile of distinct times.

    Without a time column, with ten times or fewer, or with fewer than 50 rows to train on: a stratified 80/20 split.
    """
    if time not in edges.columns:
        return stratified_split(edges)
    times = edges.select(F.col(time).cast("double").alias("t")).distinct()
    n, cut = times.agg(F.count("t"), F.percentile("t", [0.7, 0.85])).first()
    if n <= 10:
        return stratified_split(edges)
    a, b = map(int, cut)
    if edges.where(F.col(time) <= a).count() < 50:
        return stratified_split(edges)
    return edges.withColumn("split", F.when(F.col(time) <= a, "train").when(F.col(time) <= b, "val").otherwise("test"))


def stratified_split(edges: DataFrame, share: float = 0.8, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """edges with split: floor(share * rows) of each label's rows are train, the rest test, in a seeded order of the key."""
    key = key or [c for c in ("time_epoch", "source", "target") if c in edges.columns] or edges.columns
    sizes = edges.groupBy(F.col("label").alias("__label")).agg(F.floor(F.count("*") * share).alias("__train"))
    rows = hash_places(edges.where("label is not null"), key, seed, ["label"]).join(F.broadcast(sizes), F.col("label") == F.col("__label"))
    return rows.withColumn("split", F.when(F.col("place") <= F.col("__train"), "train").otherwise("test")).select(*edges.columns, "split")


def class_weight(edges: DataFrame) -> DataFrame:
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return edges.agg(pos.alias("positives"), neg.alias("negatives"), F.greatest(F.lit(1.0), neg / F.greatest(F.lit(1), pos)).alias("weight"))


def label_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def train_spread_model(train: DataFrame, features: list[str], validation: DataFrame | None = None, rounds: int = 500, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, columns: float = 0.8, patience: int = 25, objective: str = "logistic", **more) -> Trees:
    """Boosted trees on weighted classes, or with objective="focal" on the focal loss; null features count as 0.

    With a validation table, training stops after `patience` rounds without a better average precision there.
    """
    weight = float(class_weight(train).first().weight)
    full = lambda df: df.na.fill(0, features)
    return boost(full(train), features, None if validation is None else full(validation), rounds=rounds, depth=depth, rate=rate, subsample=subsample, columns=columns, patience=patience, objective=objective, weight=weight, **more)


def score_edges(model: Trees, edges: DataFrame) -> DataFrame:
    """edges with pred_proba."""
    return with_margin(model, edges, "__margin").withColumn("pred_proba", 1 / (1 + F.exp(-F.col("__margin")))).drop("__margin")


def top_features(trees: DataFrame, n: int = 20) -> DataFrame:
    """(feature, importance) of a table of trees: the mean gain of a feature's splits, as a share of all features' means."""
    gain = trees.where("feature is not null").groupBy("feature").agg(F.avg("gain").alias("gain"))
    return gain.join(F.broadcast(gain.agg(F.sum("gain").alias("all")))).select("feature", (F.col("gain") / F.col("all")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(n)


def prefix_counts(scored: DataFrame) -> DataFrame:
    """(score, tp, n): positives and rows at or above each distinct score; ranges of about as many scores are summed first, so no window spans all."""
    by = scored.groupBy(F.col("pred_proba").alias("score")).agg(F.sum("label").alias("p"), F.count("*").alias("c"))
    by = staged(by.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    total = by.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("c").alias("cc"))
    above = W.partitionBy(F.lit(0)).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    total = total.select("part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("cc").over(above), F.lit(0)).alias("c0"))
    w = W.partitionBy("part").orderBy(F.desc("score"))
    return by.join(F.broadcast(total), "part").select("score", (F.col("p0") + F.sum("p").over(w)).alias("tp"), (F.col("c0") + F.sum("c").over(w)).alias("n"), "p")


def pr_curve(scored: DataFrame) -> DataFrame:
    sums = prefix_counts(scored)
    total = scored.agg(F.sum("label").alias("all"))
    return sums.join(F.broadcast(total)).select(F.col("score").alias("threshold"), (F.col("tp") / F.col("n")).alias("precision"), F.try_divide("tp", "all").alias("recall"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over distinct scores of the recall gained there times the precision."""
    return prefix_counts(scored).agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("n")), F.sum("p")).alias("average_precision"))


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.groupBy("label", (F.col("pred_proba") >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(class, precision, recall, f1, support) of both classes, accuracy, macro and weighted averages."""
    hit = lambda a, b: F.count_if((F.col("label") == a) & ((F.col("pred_proba") >= threshold).cast("int") == b))
    c = scored.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = []
    for name, tp, fp, fn in (("0", "tn", "fn", "fp"), ("1", "tp", "fp", "fn")):
        p, r = div(F.col(tp), F.col(tp) + F.col(fp)), div(F.col(tp), F.col(tp) + F.col(fn))
        rows.append(F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), div(2 * p * r, p + r).alias("f1"), (F.col(tp) + F.col(fn)).alias("support")))
    each = c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    n = F.sum("support")
    accuracy = c.select(F.lit("accuracy").alias("class"), *(div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias(x) for x in ("precision", "recall", "f1")), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("support"))
    macro = each.agg(F.lit("macro").alias("class"), *(F.avg(x).alias(x) for x in ("precision", "recall", "f1")), n.alias("support"))
    weighted = each.agg(F.lit("weighted").alias("class"), *(div(F.sum(F.col(x) * F.col("support")), n).alias(x) for x in ("precision", "recall", "f1")), n.alias("support"))
    return each.union(accuracy).union(macro).union(weighted)


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, predicted, observed, n); a score on an inner edge belongs to the lower bin; empty bins are left out."""
    at = F.greatest(F.lit(0), F.ceil(F.col("pred_proba") * bins) - 1).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.avg("pred_proba").alias("predicted"), F.avg("label").alias("observed"), F.count("*").alias("n"))


def max_target_prob(scored: DataFrame) -> DataFrame:
    return scored.groupBy("target").agg(F.max("pred_proba").alias("pred_proba"))


def choose_time(burning: DataFrame, wanted: int | None = None) -> DataFrame:
    """One row, epoch_hr: the burning hour nearest to the wanted one (tie: earlier), or the middle one."""
    hours = burning.select("epoch_hr").distinct()
    if wanted is not None:
        return hours.agg(F.min_by("epoch_hr", F.struct(F.abs(F.col("epoch_hr") - wanted), "epoch_hr")).alias("epoch_hr"))
    placed = hours.withColumns({"at": F.row_number().over(W.partitionBy(F.lit(0)).orderBy("epoch_hr")) - 1, "n": F.count("*").over(W.partitionBy(F.lit(0)))})
    return placed.where(F.col("at") == F.floor(F.col("n") / 2)).select("epoch_hr")


def actual_new_burns(panel: DataFrame, hour: int, horizon: int = 24, exclude_current: bool = False) -> DataFrame:
    """(cell_id, frp_sum) of cells with fire in the next `horizon` hours, summed over all their rows there."""
    span = panel.where((F.col("epoch_hr") > hour) & (F.col("epoch_hr") <= hour + horizon))
    out = span.groupBy("cell_id").agg(F.max("fire_any").alias("any"), F.sum("frp_sum").alias("frp_sum")).where("any").drop("any")
    return out.join(panel.where((F.col("epoch_hr") == hour) & F.col("fire_any")), "cell_id", "left_anti") if exclude_current else out


def map_predictions(grid: DataFrame, scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every cell with its greatest predicted probability, 0 without one, and whether it reaches the threshold."""
    top = max_target_prob(scored).withColumnRenamed("target", "cell_id")
    return grid.select("cell_id").join(top, "cell_id", "left").withColumn("pred_proba", F.coalesce("pred_proba", F.lit(0.0))).withColumn("above", F.col("pred_proba") >= threshold)


def predicted_edges(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scored edges at or over the threshold, with both ends."""
    return edges.where(F.col("pred_proba") >= threshold).select("time_epoch", "source", "target", "sx", "sy", "tx", "ty", "pred_proba")


def actual_edges(edges: DataFrame) -> DataFrame:
    """Edges along which fire did spread, with both ends."""
    return edges.where("label = 1").select("time_epoch", "source", "target", "sx", "sy", "tx", "ty")


def burning_sources(burning: DataFrame, centroids: DataFrame, hour: int) -> DataFrame:
    """(cell_id, x, y) of the cells that burn at the hour."""
    return burning.where(F.col("epoch_hr") == hour).select("cell_id").distinct().join(centroids.select("cell_id", "x", "y"), "cell_id", "left")
