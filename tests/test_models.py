"""Properties of models, clusterings, attributions, the export and the streams."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronly.operators import (
    attributions as ab, churn as ch, features as fe, metrics as me, mixed_clusters as mc, models as mo,
    privacy as pv, warning as wa,
)
from patronly.plans.build import build_tables
from patronly.streaming import state as st
from conftest import rows
from test_customers import featured


@pytest.fixture(scope="module")
def planted(spark):
    """Churn follows x; y is weaker noise; c is a category."""
    rng = random.Random(4)
    data = []
    for i in range(600):
        x, y = rng.random(), rng.random()
        data.append((i, x, y, rng.choice("ab"), x + 0.3 * rng.random() > 0.7))
    return spark.createDataFrame(data, "CustomerId long, x double, y double, c string, churned boolean").cache()


def test_components(planted):
    scored, table = mo.pca_by_variance(planted, ["x", "y"], 0.95)
    ratios = [r["Ratio"] for r in table.orderBy("Component").collect()]
    assert sum(ratios) == pytest.approx(1) and ratios == sorted(ratios, reverse=True)
    assert {"PC1", "PC2"} <= set(scored.columns)
    loadings, _ = mo.pca_mixed(planted, ["x", "y"], ["c"], k=3)
    w = loadings.toPandas().pivot(index="Feature", columns="Component", values="Loading").to_numpy()
    assert np.allclose(w.T @ w, np.eye(3), atol=1e-8)
    assert mo.top_loadings(loadings, 2).count() == 6


def test_kmeans_assigns_nearest_centre(planted):
    model = mo.fit_kmeans(planted, ["x", "y"], 3)
    centres = np.array(model.clusterCenters())
    for r in mo.kmeans(planted, ["x", "y"], 3).limit(50).collect():
        assert np.argmin(((centres - [r["x"], r["y"]]) ** 2).sum(1)) == r["Cluster"]


def test_prototypes_cost_never_rises(planted):
    model = mc.kprototypes(planted, ["x", "y"], ["c"], 4)
    assert len(model.costs) > 1 and all(b <= a + 1e-9 for a, b in zip(model.costs, model.costs[1:]))
    for r in model.assign(planted).limit(60).collect():
        costs = [(r["x"] - n[0]) ** 2 + (r["y"] - n[1]) ** 2 + model.gamma * (r["c"] != m[0]) for n, m in model.centres]
        assert r["Cluster"] == int(np.argmin(costs)) and r["Distance"] == pytest.approx(min(costs))


def test_segments_nest(planted):
    table, _, label = mc.hierarchical_segments(planted, ["x", "y"], ["c"], k=5, micro=20)
    assert {r[0] for r in table.select("Cluster").distinct().collect()} == {1, 2, 3, 4, 5}
    both = label(5).select("CustomerId", F.col("Cluster").alias("five")).join(
        label(3).select("CustomerId", F.col("Cluster").alias("three")), "CustomerId")
    pairs = {(r["five"], r["three"]) for r in both.select("five", "three").distinct().collect()}
    assert len(pairs) == 5


def test_tree_and_logistic(planted):
    model, scored = mo.decision_tree(planted, ["x", "y"], "churned")
    assert min(r["count"] for r in scored.groupBy("LeafID").count().collect()) >= 20
    assert model.depth <= 4
    # leaves stay apart although the same class leads in all of them
    mostly = planted.withColumn("churned", F.col("churned") | (F.col("x") < 0.2) | (F.col("y") > 0.3))
    assert mo.decision_tree(mostly, ["x", "y"], "churned")[1].select("LeafID").distinct().count() > 2
    fit = mo.logistic_churn(planted, ["x", "y"], "churned")
    data = fe.class_weights(planted, "churned", "balanced").toPandas()
    p = 1 / (1 + np.exp(-(data[["x", "y"]].to_numpy() @ fit.coefficients.toArray() + fit.intercept)))
    gradient = (data["Weight"] * (p - data["churned"])).to_numpy() @ data[["x", "y"]].to_numpy() + fit.coefficients.toArray()
    assert np.abs(gradient).max() < 1e-2
    assert [r["Feature"] for r in mo.odds_table(fit, ["x", "y"], planted.sparkSession).collect()][0] == "x"


def test_boosting_attributions_add_up(planted):
    split = fe.stratified_split(planted, "churned")
    train, test = split.filter("not IsTest"), split.filter("IsTest")
    model = mo.boosted_churn(fe.class_weights(train, "churned"), ["x", "y"], "churned", trees=8, depth=3)
    scored = mo.score(model, test, ["x", "y"], "churned")
    assert me.roc_auc(scored).first()[0] > 0.8
    assert sum(r["Importance"] for r in mo.feature_importance(model, ["x", "y"], planted.sparkSession).collect()) == pytest.approx(1)
    values = ab.shap_values(model, test, train, ["x", "y"])
    joined = values.join(scored.select("CustomerId", "margin"), "CustomerId").toPandas()
    assert np.allclose(joined["Base"] + joined["Attr_x"] + joined["Attr_y"], joined["margin"], atol=1e-9)
    assert {r["Feature"]: r["MeanAbs"] for r in ab.shap_summary(values, ["x", "y"]).collect()}["x"] > \
        {r["Feature"]: r["MeanAbs"] for r in ab.shap_summary(values, ["x", "y"]).collect()}["y"]
    table = ab.shap_dependence(values, ["x", "y"], {"x": "y", "y": "x"})
    assert table.count() == 2 * test.count()
    assert {(r[0], r[1]) for r in table.select("Feature", "InteractingFeature").distinct().collect()} == {("x", "y"), ("y", "x")}


def test_attributions_match_brute_force():
    rng = np.random.default_rng(0)
    leaves = [({0: (-np.inf, .5), 1: (-np.inf, .4)}, 1.0), ({0: (-np.inf, .5), 1: (.4, np.inf)}, 3.0),
              ({0: (.5, np.inf), 2: (-np.inf, .6)}, -2.0), ({0: (.5, np.inf), 2: (.6, np.inf)}, 5.0)]
    value = lambda z: next(v for box, v in leaves if all(lo < z[f] <= hi for f, (lo, hi) in box.items()))
    background, x = rng.random((12, 3)), rng.random(3)
    game = lambda S: np.mean([value([x[f] if f in S else z[f] for f in range(3)]) for z in background])
    from itertools import permutations
    expected = np.zeros(3)
    for order in permutations(range(3)):
        for i, f in enumerate(order):
            expected[f] += (game(order[:i + 1]) - game(order[:i])) / 6
    counts = [np.bincount(ab._inside(background, sorted(box.items())), minlength=1 << len(box)) for box, _ in leaves]
    tables, base = ab.leaf_tables(leaves, counts)
    got = np.zeros((1, 3))
    for box, table in tables:
        got[:, [f for f, _ in box]] += table[ab._inside(x[None, :], box)]
    assert np.allclose(got[0], expected) and base == pytest.approx(game(()))


def test_export_hides_ids_and_repeats(order_rows, spark):
    rng = random.Random(5)
    raw = order_rows(*[{"CustomerId": rng.randrange(40), "PaymentMethod": rng.choice(["card", "paypal", None])}
                       for _ in range(300)])
    items = spark.createDataFrame([(1, 1, 1.0, 0)], "OrderNumber long, ProductProductOptionId long, Quantity double, IsDeleted int")
    table = pv.export_orders(raw, items, "2020-02-01", "pepper", n=10)
    got = table.toPandas()
    assert "CustomerId" not in got and "OrderNumber" not in got and got["CustomerIdHash"].nunique() == 10
    whole = raw.groupBy("CustomerId").count().toPandas()["count"].tolist()
    assert set(got["CustomerIdHash"].value_counts()) <= set(whole)
    assert table.count() == len(got) and rows(table, *table.columns) == rows(table, *table.columns)
    moved = (datetime(2020, 1, 1, 10) - got["PlacedDateTime"]).dt.days
    assert moved.between(0, 14).all() and got["OrderItemPriceTotal"].between(45, 55).all()


@pytest.fixture(scope="module")
def arriving(order_rows):
    rng = random.Random(6)
    start = datetime(2019, 1, 1)
    data = [{"CustomerId": rng.randrange(12), "OrderItemPriceTotal": float(rng.randrange(90)),
             "PlacedDateTime": str(start + timedelta(days=6 * i, hours=rng.randrange(24)))} for i in range(120)]
    return featured(order_rows(*data)).cache()


def streamed(spark, build, table, parts, folder, lateness=st.LATENESS):
    """Stream the parts (conditions on the order number) one file per trigger, then the clock."""
    for part in parts:
        table.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    st.clock_row(table, lateness).write.mode("append").parquet(f"{folder}/in")
    stream = build(st.read_order_stream(spark, f"{folder}/in", files_per_trigger=1), lateness)
    return spark.read.parquet(st.run_available(stream, f"{folder}/out", f"{folder}/state"))


# In time order; and with every fifth order up to 25 orders (150 days) late.
IN_ORDER = [f"(OrderNumber - 1) div 40 = {i}" for i in range(3)]
LATE = [f"(case when OrderNumber % 5 = 0 then OrderNumber + 24 else OrderNumber end - 1) div 25 = {i}" for i in range(6)]


@pytest.mark.parametrize("parts, lateness", [(IN_ORDER, "30 days"), (LATE, "200 days"), (["true"], "30 days")])
def test_stream_warnings_equal_batch(spark, arriving, tmp_path, parts, lateness):
    out = streamed(spark, st.stream_early_warning, arriving, parts, str(tmp_path), lateness)
    columns = ["OrderNumber", *wa.DEVIATIONS, *wa.FLAG_RULES]
    got, expected = rows(out, *columns), rows(wa.order_warnings(arriving), *columns)
    assert len(got) == len(expected) == 120
    for a, b in zip(got, expected):
        assert a == pytest.approx(b)


def test_stream_drops_only_what_is_later_than_the_watermark(spark, arriving, tmp_path):
    """Orders come six days apart. When the third file comes the watermark stands 30 days
    before order 90: order 1 is too late, order 88 is not."""
    parts = ["OrderNumber between 2 and 87 or OrderNumber in (89, 90)", "OrderNumber between 91 and 100",
             "OrderNumber in (1, 88) or OrderNumber > 100"]
    out = streamed(spark, st.stream_early_warning, arriving, parts, str(tmp_path))
    columns = ["OrderNumber", *wa.DEVIATIONS, *wa.FLAG_RULES]
    got, expected = rows(out, *columns), rows(wa.order_warnings(arriving.filter("OrderNumber > 1")), *columns)
    assert {r[0] for r in got} == set(range(2, 121))
    for a, b in zip(got, expected):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("parts, lateness", [(IN_ORDER, "30 days"), (LATE, "200 days"), (["true"], "30 days")])
def test_stream_alerts_equal_batch_cadence(spark, arriving, tmp_path, parts, lateness):
    out = streamed(spark, st.stream_overdue, arriving, parts, str(tmp_path), lateness)
    last = ch.churn_profile(arriving).filter("ExceededCadence and DaysSinceLastOrder > 35").select("CustomerId", "LastOrderDate")
    alerts = rows(out, "CustomerId", "LastOrderDate")
    assert len(alerts) == len(set(alerts))
    final = arriving.groupBy("CustomerId").agg(F.max("PlacedDateTime").alias("LastOrderDate"))
    assert rows(out.join(final, ["CustomerId", "LastOrderDate"]), "CustomerId") == rows(last, "CustomerId")


def test_build_stores_every_table(spark, order_rows, tmp_path):
    raw = {"raw_order": order_rows({}, {"PlacedDateTime": "2020-03-01 00:00:00"}, {"CustomerId": 2}),
           "raw_order_item": spark.createDataFrame([(1, 1, 1.0, 0)], "OrderNumber long, ProductProductOptionId long, Quantity double, IsDeleted int"),
           "raw_product_product_option": spark.createDataFrame([(1, "Sticker")], "Id long, Name string")}
    paths = build_tables(spark, raw, str(tmp_path / "tables"))
    assert set(paths) == {"order_feature_table", "churn_save", "customer_summary", "customer_summary_first_order",
                          "customer_summary_first_2_orders", "customer_summary_last_order", "product_type_df"}
    assert spark.read.parquet(paths["product_type_df"]).count() == 1
    assert rows(spark.read.parquet(paths["customer_summary_first_order"]), "CustomerId", "TotalOrders") == [(1, 1), (2, 1)]


def test_session_table_does_not_broadcast_its_customers(spark, order_rows):
    """One row per customer grows with the customers, whatever Spark estimates."""
    from patronly.constants import SESSION_ATTRIBUTES
    from patronly.plans import flows

    summary = spark.range(1, 4).selectExpr(
        "id as CustomerId", "id = 1 as OneAndDone", "id * 0.5D as PctWorkday", "timestamp '2020-01-01' as FirstOrderDate",
        "1.0D as PctOrdersWithLabel")
    clean = order_rows(dict(CustomerId=1), dict(CustomerId=2), dict(CustomerId=2, PlacedDateTime="2020-02-01 10:00:00"))
    events = spark.createDataFrame([("1", *["a"] * len(SESSION_ATTRIBUTES)), ("2", *["b"] * len(SESSION_ATTRIBUTES)), ("3", *["c"] * len(SESSION_ATTRIBUTES))],
                                   ", ".join(f"{c} string" for c in ["param_transaction_id", *SESSION_ATTRIBUTES]))
    table = flows.session_table(summary, clean, events, "1999-01-01", {"PctOrdersWithLabel": 1.0})
    table = table.filter(F.col("device_category").isNotNull())  # as encoding the labels reads it, which makes the join an inner one
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [CustomerId" not in plan and "SortMergeJoin [CustomerId" in plan
    assert rows(table, "CustomerId", "OneAndDone", "traffic_source_medium") == [(1, True, "a"), (2, False, "b")]
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]  # as changed while it ran
    assert "SortMergeJoin [OrderNumber_str" in plan and "BroadcastHashJoin" not in plan
