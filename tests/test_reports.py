"""Bins, empty buckets, quantiles, attribution and metric tables on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronly import constants as k
from patronly.functions.columns import cut
from patronly.functions.quantiles import exact_quantiles, running_totals
from patronly.functions.skew import salted_join, small_or_self
from patronly.operators import attribution as at, features as fe, metrics as me, reports as rp
from conftest import rows


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 100.0, 100.01, -1.0, 250000.5, None]], "v double")
    spend = [r[0] for r in df.select(cut("v", k.SPENDING_EDGES, k.SPENDING_LABELS)).collect()]
    assert spend == ["$0–100", "$0–100", "$100–500", None, "$250000–∞", None]
    open_low = [r[0] for r in df.select(cut("v", k.ORDER_VALUE_EDGES, k.ORDER_VALUE_LABELS, False)).collect()]
    assert open_low == [None, "$0-$100", "$100-$500", None, "5,000+", None]
    counts = spark.createDataFrame([(n,) for n in [1, 2, 3, 10, 11, 20, 21]], "n int")
    assert [r[0] for r in counts.select(cut("n", k.ORDER_EDGES, k.ORDER_LABELS)).collect()] == [
        "1", "1", "2", "6–10", "10–20", "10–20", "20–∞"]


@pytest.fixture(scope="module")
def summary(spark):
    return spark.createDataFrame(
        [(1, 1, 50.0, True, 1.0, 0.0), (2, 3, 150.0, False, 0.5, 0.5), (3, 12, 3000.0, False, 0.0, 1.0), (4, 1, 60.0, False, 1.0, 0.0)],
        "CustomerId long, TotalOrders long, LifetimeValue double, LikelyChurned boolean, "
        "PctOrdersWithSticker double, PctOrdersWithLabel double")


def test_revenue_report_keeps_empty_buckets(summary):
    report = rp.revenue_bucket_summary(summary).orderBy("BucketOrder").collect()
    assert [r["CustomerCount"] for r in report] == [2, 1, 0, 0, 1, 0, 0, 0, 0, 0]
    assert report[0]["Pct_ChurnedWithinBucket"] == 50.0 and report[2]["Pct_ChurnedWithinBucket"] is None
    assert report[-1]["CumulativePct_Customers"] == pytest.approx(100) == report[-1]["CumulativePct_Revenue"]
    assert [r["CustomerCount"] for r in rp.revenue_bucket_summary(summary, 5).collect()] == [0] * 10


def test_monthly_average_counts_idle_months_as_zero(spark, summary, order_rows):
    # Months seen: January and March. Customer 1 in both, 2 in March only.
    orders = order_rows(*[{"CustomerId": c, "ShippedDateTime": t} for c, t in [
        (1, "2025-01-05 00:00:00"), (1, "2025-01-06 00:00:00"), (1, "2025-03-06 00:00:00"),
        (2, "2025-03-01 00:00:00"), (2, "2025-07-01 00:00:00"), (9, "2025-05-01 00:00:00")]])
    products = rp.product_type_rows(summary)
    assert rows(products, "CustomerId", "ProductType") == [
        (1, "Sticker"), (2, "Label"), (2, "Sticker"), (3, "Label"), (4, "Sticker")]
    by_orders = {(r["ProductType"], r["OrderBucket"]): r["AvgMonthlyOrderingCusts"]
                 for r in rp.order_bucket_by_product(products, orders).collect()}
    assert by_orders["Sticker", "1"] == 1.0 and by_orders["Sticker", "2"] == 0.5
    assert by_orders["Label", "2"] == 0.5 and by_orders["Label", "20–∞"] == 0.0
    by_value = {(r["ProductType"], r["SpendingBucket"]): r["AvgMonthlyOrderingCusts"]
                for r in rp.revenue_bucket_by_product(products, orders).collect()}
    assert by_value["Label", "$100–500"] == 1.0  # its own product has one month only
    assert len(by_value) == 20
    nobody = rp.revenue_bucket_by_product(products, orders, year=1999)
    assert {r["AvgMonthlyOrderingCusts"] for r in nobody.collect()} == {None}


def test_quantiles_equal_sorting(spark):
    rng = random.Random(3)
    values = [(g, float(rng.randrange(40)) if g == "tied" else rng.random()) for g in ("tied", "free") for _ in range(3000)]
    df = spark.createDataFrame([*values, ("none", None)], "g string, x double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for accuracy in (100_000, 200):  # whole-group bracket, and sketch brackets
        got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, {"x": probs}, ["g"], accuracy).collect()}
        for g in ("tied", "free"):
            expected = np.quantile([v for h, v in values if h == g], probs)
            assert [got[g, p] for p in probs] == pytest.approx(list(expected), abs=1e-12), accuracy
    assert ("none", 0.5) not in got


def test_running_totals_across_slices(spark):
    data = [(float(x), x % 7) for x in range(500)]
    df = spark.createDataFrame(data, "x double, n long").repartition(5)
    for down in (False, True):
        got = {r["x"]: r["Upto_n"] for r in running_totals(df, "x", ["n"], slice_rows=60, descending=down).collect()}
        assert all(got[x] == sum(m for y, m in data if (y >= x if down else y <= x)) for x, _ in data[::37])


def test_salted_join_equals_join(spark):
    fact = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(200)], "i long, k long")
    dim = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, name string")
    plain = fact.join(dim, F.col("k") == F.col("id"), "left")
    for most in (3, 2):  # broadcast, and salted
        assert rows(salted_join(fact, dim, "k", "id", max_rows=most), *plain.columns) == rows(plain, *plain.columns)
    assert small_or_self(fact, 10) is fact and small_or_self(dim, 10) is not dim


def test_salted_join_does_not_broadcast_the_repeated_dimension(spark):
    """Spark takes the 16-fold dimension for as small as the dimension itself."""
    fact, dim = spark.range(300).selectExpr("id as i", "id % 40 as k"), spark.range(50).selectExpr("id", "id * 2 as name")
    salted, plain = salted_join(fact, dim, "k", "id", max_rows=40), fact.join(dim, F.col("k") == F.col("id"), "left")
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows(salted, *plain.columns) == rows(plain, *plain.columns)


def test_attribution_ids_and_modes(spark, order_rows):
    analytics = spark.createDataFrame(
        [("1", "cpc", "google", "7.0"), ("1", "email", None, None), ("1", "email", None, None), ("n/a", "cpc", "bing", "8")],
        "OrderNumber string, medium string, source string, AdwordsCampaignId string")
    campaigns = spark.createDataFrame([("7", *[1] * 8), (None, *[1] * 8)],
        "AdCampaignId string, " + ", ".join(f"{c} int" for c in k.AD_INDICATORS))
    attr = at.order_attribution(at.join_campaigns(at.one_hot_medium_source(analytics), campaigns))
    assert rows(attr, "OrderNumber", "medium_cpc", "source_google", "AdVideo") == [
        (1, 0, 0, None), (1, 1, 1, 1), (None, 1, 0, None)]
    orders = order_rows({}, {})
    assert at.attach_attribution(orders, attr).count() == 3
    assert rows(at.attach_attribution(orders, attr, "max"), "OrderNumber", "medium_cpc", "medium_email", "AdVideo") == [
        (1, 1, 1, 1), (2, None, None, None)]


def test_session_modes(spark):
    events = spark.createDataFrame(
        [("t", "b"), ("t", "a"), ("t", None), ("u", "None"), ("u", ""), ("u", "x"), ("u", ""), ("v", None)],
        "param_transaction_id string, m string")
    assert rows(at.collapse_sessions(events, attributes=["m"]), "param_transaction_id", "m") == [
        ("t", "a"), ("u", ""), ("v", None)]
    assert rows(at.collapse_sessions_strict(events, attributes=["m"]), "param_transaction_id", "m") == [
        ("t", "a"), ("u", "x"), ("v", None)]


def test_scalers_on_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, flat double")
    for scale in (fe.standard_scale, fe.minmax_scale, fe.robust_scale):
        assert {r["flat"] for r in scale(df, ["x", "flat"]).collect()} == {0.0}
    assert rows(fe.standard_scale(df, ["x"]), "x")[-1][0] == pytest.approx(3 / np.std([1, 2, 6]))
    assert rows(fe.robust_scale(df, ["x"]), "x") == [(-0.4,), (0.0,), (1.6,)]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", True), (3, None, False)], "CustomerId long, t string, f boolean")
    assert rows(fe.coerce_types(df), "CustomerId", "t", "f") == [(1, 1, 1), (2, 0, 1), (3, -1, 0)]
    assert rows(fe.coerce_types(df, null_bool="false"), "CustomerId", "f") == [(1, 0), (2, 1), (3, 0)]
    assert rows(fe.label_encode(df, ["t"]), "CustomerId", "t") == [(1, 1), (2, 0), (3, None)]
    assert fe.one_hot_drop_first(df, ["t"]).columns == ["CustomerId", "f", "t_b"]
    assert rows(fe.fixed_category_codes(df, "t", ["b", "z"], "z"), "CustomerId", "t") == [(1, 0), (2, 1), (3, 1)]


def test_many_levels_are_numbered_without_one_task(spark):
    df = spark.range(300).select(F.col("id").alias("CustomerId"), F.format_string("%03d", "id").alias("t"))
    assert rows(fe.label_encode(df, ["t"]).filter("CustomerId <> t"), "CustomerId") == []


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.45), (0, 0.1)], "label int, score double")
    said = me.threshold_predict(df)
    assert rows(me.confusion_matrix(said), "actual", "predicted", "n") == [(0, 0, 2), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    assert me.roc_auc(df).first()[0] == pytest.approx(4.5 / 6)
    curve = {r["threshold"]: (r["precision"], r["recall"]) for r in me.pr_curve(df).collect()}
    assert curve[0.8] == (pytest.approx(2 / 3), 1.0) and curve[0.9] == (0.5, 0.5) and len(curve) == 4
    nobody = me.classification_report(df.withColumn("prediction", F.lit(0)))
    assert {r["class"]: r["precision"] for r in nobody.collect()}["1"] == 0.0
