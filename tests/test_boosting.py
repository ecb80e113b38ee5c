"""Penalised boosting against a plain version, and attributions of pairs."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronly.catalog import model_queries as mq
from patronly.functions import sums
from patronly.operators import attributions as ab, boosting as bo, metrics as me, models as mo

FEATURES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    data = []
    for i in range(500):
        x, y, z = rng.random(), rng.randrange(12) / 4, rng.gauss(0, 1)
        data.append((i, x, y, z, (x > 0.5) == (y > 1) if rng.random() < 0.8 else rng.random() < 0.3))
    return spark.createDataFrame(data, "CustomerId long, x double, y double, z double, churned boolean").repartition(5).cache()


def plain(rows, cuts, hashes, trees, depth, rate, l1, l2, row_share, column_share, seed):
    """The same trees by loops over rows, nodes, features and thresholds."""
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    y = np.array([float(r["churned"]) for r in rows])
    margin, losses, shapes = np.zeros(len(y)), [], []
    soft = lambda g: np.sign(g) * max(abs(g) - l1, 0)
    for number in range(trees):
        losses.append(float(np.mean(np.logaddexp(0, margin) - y * margin)))
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        use = bo.drawn(hashes, seed, number) < row_share
        columns = sorted(np.random.default_rng([seed, number]).permutation(3)[:max(1, int(column_share * 3))].tolist())

        def grow(inside, level):
            rows_in = inside & use
            own = (g[rows_in].sum(), h[rows_in].sum())
            weight = -soft(own[0]) / (own[1] + l2) * rate
            best = None
            if level < depth:
                for f in columns:
                    for t in cuts[f]:
                        left, right = rows_in & (x[:, f] <= t), rows_in & (x[:, f] > t)
                        if h[left].sum() < 1 or h[right].sum() < 1:
                            continue
                        gain = sum(soft(g[s].sum()) ** 2 / (h[s].sum() + l2) for s in (left, right)) - soft(own[0]) ** 2 / (own[1] + l2)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, t)
            if best is None:
                margin[inside] += weight
                return [weight]
            _, f, t = best
            return [(f, t), grow(inside & (x[:, f] <= t), level + 1), grow(inside & (x[:, f] > t), level + 1)]

        shapes.append(grow(np.ones(len(y), bool), 0))
    losses.append(float(np.mean(np.logaddexp(0, margin) - y * margin)))
    return margin, losses, shapes


@pytest.mark.parametrize("l1,l2,depth", [(1.0, 1.0, 4), (0.0, 0.0, 2), (6.0, 3.0, 3)])
def test_trees_equal_plain_version(table, monkeypatch, l1, l2, depth):
    monkeypatch.setattr(bo, "STORE_EVERY", 3)
    model = bo.fit_penalised(table, FEATURES, "churned", trees=8, depth=depth, l1=l1, l2=l2, bins=16)
    _, cuts = bo.binned(table, FEATURES, "churned", "CustomerId", 16)
    rows = table.select("*", F.xxhash64("CustomerId").alias("h")).orderBy("CustomerId").collect()
    margin, losses, _ = plain(rows, cuts, np.array([r["h"] for r in rows]), 8, depth, 0.1, l1, l2, 0.8, 0.8, 42)
    scored = mo.score(model, table, FEATURES, "churned").orderBy("CustomerId").collect()
    assert np.allclose([r["margin"] for r in scored], margin, atol=1e-9)
    assert np.allclose(model.losses, losses, atol=1e-12)
    assert np.allclose([r["score"] for r in scored], 1 / (1 + np.exp(-margin)))


def test_penalised_gradient_vanishes_at_every_leaf(table):
    model = mo.boosted_regularised(table, FEATURES, "churned", trees=12)
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    assert sum(model.importances()) == pytest.approx(1)
    for number in (0, 5, 11):
        leaves = {}
        for r in bo.leaf_rows(model, table, number).collect():
            p = 1 / (1 + np.exp(-r["margin"]))
            g, h, _ = leaves.get(r["leaf"], (0, 0, 0))
            leaves[r["leaf"]] = (g + p - r["y"], h + p * (1 - p), r["weight"])
        assert len(leaves) > 2
        for g, h, w in leaves.values():
            assert abs(g) <= 1 + 1e-9 if w == 0 else abs(g + h * w + 1.0 * w + np.sign(w)) < 1e-9


def test_many_partial_sums_meet_as_a_tree(table, monkeypatch):
    monkeypatch.setattr(sums, "FAN_IN", 2)
    rows = table.repartition(9)
    total = sums.summed(rows, 9, lambda b: np.array([[len(b), b["x"].sum()]]))
    assert total[0, 0] == 500 and total[0, 1] == pytest.approx(table.agg(F.sum("x")).first()[0])
    assert sums.summed(table.limit(0), 1, lambda b: np.zeros((1, 1))) is None


def test_odd_tables(table, spark):
    nobody = mo.boosted_regularised(table.limit(0), FEATURES, "churned", trees=2)
    assert nobody.losses == [] and {r["score"] for r in mo.score(nobody, table, FEATURES, "churned").collect()} == {0.5}
    one = table.withColumn("churned", F.lit(True)).withColumn("x", F.lit(3.0)).withColumn("z", F.when(F.col("CustomerId") > 9, F.col("z")))
    model = mo.boosted_regularised(one, FEATURES, "churned", trees=3)
    assert {len(t.feature) for t in model.trees} == {1} and model.margins(np.zeros((1, 3)))[0] > 0


def brute_pairs(leaves, background, x, n):
    """Shapley interaction values by their definition, main effects as the rest."""
    value = lambda z: sum(v for box, v in leaves if all(lo < z[f] <= hi for f, (lo, hi) in box.items()))
    game = lambda s: np.mean([value([x[f] if f in s else z[f] for f in range(n)]) for z in background])
    out = np.zeros((n, n))
    for i, j in combinations(range(n), 2):
        rest = [f for f in range(n) if f not in (i, j)]
        for size in range(len(rest) + 1):
            for s in combinations(rest, size):
                weight = factorial(size) * factorial(n - size - 2) / (2 * factorial(n - 1))
                out[i, j] += weight * (game((*s, i, j)) - game((*s, i)) - game((*s, j)) + game(s))
        out[j, i] = out[i, j]
    single = np.zeros(n)
    for i in range(n):
        for size in range(n):
            for s in combinations([f for f in range(n) if f != i], size):
                single[i] += factorial(size) * factorial(n - size - 1) / factorial(n) * (game((*s, i)) - game(s))
    out[np.arange(n), np.arange(n)] = single - out.sum(axis=1)
    return out


def test_interactions_equal_their_definition(table):
    model = bo.fit_penalised(table, FEATURES, "churned", trees=3, depth=4, l1=0.0, rate=0.5, bins=8, column_share=1.0)
    background, rows = table.limit(40).cache(), table.orderBy("CustomerId").limit(6)
    found = ab.shap_interactions(model, rows, background, FEATURES).collect()
    near = np.array([[r[f] for f in FEATURES] for r in background.collect()])
    values = {r["CustomerId"]: r for r in ab.shap_values(model, rows, background, FEATURES).collect()}
    for row in rows.collect():
        expected = brute_pairs(model.leaves(), near, [row[f] for f in FEATURES], 3)
        own = {(r["Feature"], r["Other"]): r["Interaction"] for r in found if r["CustomerId"] == row["CustomerId"]}
        got = np.array([[own[a, b] for b in FEATURES] for a in FEATURES])
        assert np.allclose(got, expected, atol=1e-12)
        assert np.allclose(got.sum(axis=1), [values[row["CustomerId"]][f"Attr_{f}"] for f in FEATURES])
    partners = {r["Feature"]: r["Partner"] for r in ab.interaction_partners(ab.shap_interactions(model, table, background, FEATURES)).collect()}
    assert partners["x"] == "y" and partners["y"] == "x"
    assert me.roc_auc(mo.score(model, table, FEATURES, "churned")).first()[0] > 0.8


def test_check_of_interactions_does_not_broadcast_exploded_rows(spark, monkeypatch):
    """One row per customer and feature grows with the customers, whatever Spark estimates."""
    names = mq.flows.CLUSTER_FEATURES
    values = spark.range(20).selectExpr("id as CustomerId", *[f"{i} * 0.5D as Attr_{f}" for i, f in enumerate(names)])
    cells = spark.createDataFrame([(f, o, i * 0.5 if f == o else 0.0) for i, f in enumerate(names) for o in names],
                                  "Feature string, Other string, Interaction double")
    found = spark.range(20).withColumnRenamed("id", "CustomerId").crossJoin(cells)
    monkeypatch.setattr(mq, "_regularised", lambda s: (None, None, None))
    monkeypatch.setattr(mq, "_interactions", lambda s: found)
    monkeypatch.setattr(mq.ab, "shap_values", lambda *given: values)
    check = mq._check_interactions(None)
    plan = check._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert tuple(check.first()) == (20 * len(names), 0, 0, len(names) * (len(names) + 1) // 2)
