"""Boosted trees against a plain numpy version, and SQL over the written trees."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cindergrid import catalog
from cindergrid.operators import boosting, edges, evaluate

SF = "/root/testdata/sf0.001"
FEATURES = ["dist_m", "frp_src", "wind_align"]


def rows(n=300, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.choice([1.0, 2.0, 3.0, 5.0]), rng.gauss(0, 1), rng.choice([0.0, 0.0, rng.random()])
        out.append((i, f"s{i}", "t", a, b, c, int(a + b + rng.gauss(0, 0.7) > 3.5)))
    return out


def table(spark, data):
    return spark.createDataFrame(data, "time_epoch long, source string, target string, dist_m double, frp_src double, wind_align double, label int")


def numpy_boost(x, y, cuts, rounds, depth, rate, objective, weight, alpha=0.25, gamma=2.0, reg=1.0, least=1.0):
    """The same trees grown row by row: (margins, number of leaves of each tree)."""
    bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1)
    margin, leaves = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        scale = np.where(y == 1, weight, 1.0) if objective == "logistic" else np.where(y == 1, alpha, 1 - alpha) * (1 - p) ** gamma
        g, h = (np.floor(v * boosting.UNIT + 0.5) / boosting.UNIT for v in ((p - y) * scale, p * (1 - p) * scale))
        step, count = np.zeros(len(y)), 0
        todo = [(np.arange(len(y)), 0)]
        while todo:
            own, level = todo.pop()
            best = (1e-6, None)
            score = lambda at: g[at].sum() ** 2 / (h[at].sum() + reg)
            if level < depth:
                for f in range(x.shape[1]):
                    for b in range(len(cuts[f])):
                        low, high = own[bins[own, f] <= b], own[bins[own, f] > b]
                        if len(low) and len(high) and h[low].sum() >= least and h[high].sum() >= least:
                            gain = score(low) + score(high) - score(own)
                            if gain > best[0] + 1e-9:
                                best = (gain, (low, high))
            if best[1] is None:
                step[own] = -rate * g[own].sum() / (h[own].sum() + reg)
                count += 1
            else:
                todo += [(part, level + 1) for part in best[1]]
        margin += step
        leaves.append(count)
    return margin, leaves


@pytest.mark.parametrize("objective", ["logistic", "focal"])
def test_trees_against_numpy(spark, objective):
    data = rows()
    df = table(spark, data).repartition(3)
    weight = float(evaluate.class_weight(df).first().weight)
    model = evaluate.train_spread_model(df, FEATURES, rounds=4, depth=3, rate=0.3, subsample=1.0, columns=1.0, objective=objective, bins=8)
    cuts = boosting.quantile_cuts(df, FEATURES, 8)
    x, y = np.array([r[3:6] for r in data]), np.array([r[6] for r in data])
    margin, leaves = numpy_boost(x, y, cuts, 4, 3, 0.3, objective, weight)
    assert [sum(n[0] is None for n in t) for t in model.trees] == leaves
    got = {r.time_epoch: r.pred_proba for r in evaluate.score_edges(model, df).collect()}
    assert max(abs(got[r[0]] - 1 / (1 + np.exp(-m))) for r, m in zip(data, margin)) < 1e-6


def test_stop_sampling_and_files(spark, tmp_path):
    data = rows(400)
    df, late = table(spark, data[:300]), table(spark, data[300:])
    noise = late.withColumn("label", (F.xxhash64("source") % 2 == 0).cast("int"))
    keys = ["time_epoch", "source", "target"]
    fit = lambda test, **more: evaluate.train_spread_model(df, FEATURES, test, depth=2, rate=0.3, key=keys, bins=8, **more)
    stopped = fit(noise, rounds=30, patience=2)
    assert 1 <= len(stopped.trees) < 28
    model, again = fit(late, rounds=3), evaluate.train_spread_model(df.repartition(5), FEATURES, late, rounds=3, depth=2, rate=0.3, key=keys, bins=8)
    assert model == again and all(len({n[0] for n in t if n[0] is not None}) <= 3 for t in model.trees)
    narrow = fit(None, rounds=3, columns=0.3)
    assert len(narrow.trees) == 3 and all(len({n[0] for n in t if n[0] is not None}) == 1 for t in narrow.trees)
    path = f"file://{tmp_path}/model"
    boosting.write_trees(spark, model, path)
    assert boosting.read_trees(spark, path) == model
    con = duckdb.connect()
    con.execute(f"CREATE VIEW trees AS SELECT * FROM '{tmp_path}/model/trees/*.parquet'")
    con.execute("CREATE TABLE e (id BIGINT, feature VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", [(r[0], f, r[3 + i]) for r in data[300:] for i, f in enumerate(FEATURES)])
    walked = con.execute("""
        WITH RECURSIVE w AS (
          SELECT id, t.tree, t.node, t.feature, t.threshold, t.low, t.high, t.value FROM (SELECT DISTINCT id FROM e), trees t WHERE t.node = 0
          UNION ALL
          SELECT w.id, t.tree, t.node, t.feature, t.threshold, t.low, t.high, t.value
          FROM w JOIN e ON e.id = w.id AND e.feature = w.feature JOIN trees t ON t.tree = w.tree AND t.node = CASE WHEN e.v <= w.threshold THEN w.low ELSE w.high END)
        SELECT id, 1 / (1 + exp(-sum(value))) FROM w WHERE feature IS NULL GROUP BY id""").fetchall()
    got = {r.time_epoch: r.pred_proba for r in evaluate.score_edges(model, late).collect()}
    assert len(walked) == len(got) == 100 and all(abs(got[i] - p) < 1e-12 for i, p in walked)
    share = con.execute("WITH g AS (SELECT feature, avg(gain) AS g FROM trees WHERE feature IS NOT NULL GROUP BY 1) SELECT feature, g / sum(g) OVER () FROM g ORDER BY 2 DESC, 1 LIMIT 2").fetchall()
    top = evaluate.top_features(model.table(spark), 2).collect()
    assert [r.feature for r in top] == [f for f, _ in share] and all(abs(r.importance - v) < 1e-12 for r, (_, v) in zip(top, share))


def test_little_to_learn_from(spark):
    one = table(spark, [(1, "s", "t", 1.0, None, 0.0, 1)] * 3)
    model = evaluate.train_spread_model(one, FEATURES, rounds=2, depth=2)
    assert [len(t) for t in model.trees] == [1, 1] and all(r.pred_proba > 0.5 for r in evaluate.score_edges(model, one.drop("frp_src")).collect())
    assert evaluate.score_edges(model, one.limit(0)).collect() == [] and evaluate.top_features(model.table(spark)).collect() == []
    with pytest.raises(ValueError):
        boosting.gradients("hinge", F.lit(0.0), F.lit(1))


def test_precision_of_binned_scores(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0), (0.0, 0)], "s double, y int")
    assert abs(boosting.binned_precision(df, F.col("s")) - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12


def test_sums_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    got = catalog.QUERIES["boosting_sums"](spark, SF)
    want = con.execute(catalog.ORACLE["boosting_sums"]).fetchall()
    assert sorted(map(tuple, got.select("feature", "bin", "g", "h", "n").collect())) == sorted(want)
    assert edges.select_feature_columns(table(spark, rows(3))) == FEATURES
