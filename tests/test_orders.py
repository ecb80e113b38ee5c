"""Traps of the order features on hand-made rows."""

from datetime import datetime

from patronly.operators import cleaning, orders as od
from patronly.schemas import SCHEMAS
from patronly.sources import shop_views as views
from patronly.sources.tables import conform, nan_to_null, read_tables, write_tables
from conftest import rows

import pytest


def test_unknown_deletion_counts_as_live(order_rows):
    raw = order_rows({"IsDeleted": 0}, {"IsDeleted": 1}, {"IsDeleted": None}, {"AffiliateId": 1},
                     {"ShippedDateTime": None})
    assert rows(cleaning.clean_orders(raw), "OrderNumber") == [(1,), (3,)]


def test_missing_prices_get_the_default_label(order_rows):
    raw = order_rows(
        {"ShippingTotal": float("nan")}, {"ShippingTotal": None}, {"OrderItemPriceTotal": None},
        {"ShippingTotal": 0.0}, {"ShippingTotal": 4.0}, {"OrderItemPriceTotal": 75.0},
        {"ShippingTotal": 4.5}, {"ShippingTotal": 2.0}, {"OrderItemPriceTotal": 80.0, "ShippingTotal": 4.0})
    labels = [r[1] for r in rows(od.shipping_type(nan_to_null(raw)), "OrderNumber", "ShippingType")]
    unknown = "UnknownShipping"
    assert labels == [unknown, unknown, unknown, "NormalShipping", "TwoDayShipping", "TwoDayShipping",
                      "ExpeditedShipping", unknown, unknown]
    assert {r[0] for r in rows(od.shipping_type_uncategorized(nan_to_null(raw)).limit(1), "ShippingType")} \
        == {"UncategorizedShipping"}


def test_unknown_time_is_early_morning_and_no_season(order_rows):
    df = od.add_order_columns(order_rows({"PlacedDateTime": None}))
    row = df.first()
    assert row["HourCategory"] == "EarlyMorning" and row["HourOfDay"] is None
    flags = ["WorkHours", "Workday", "FirstWeek", "LastWeek", "Holiday", "Summer", "ElectionSeason",
             "PresidentialElection"]
    assert [row[f] for f in flags] == [False] * 8


def test_calendar_edges(order_rows):
    df = od.add_order_columns(order_rows(
        {"PlacedDateTime": "2020-02-22 17:59:00"},   # Saturday, 7 days before month end
        {"PlacedDateTime": "2020-02-24 17:00:00"},   # Monday, hour 17 still counts as work
        {"PlacedDateTime": "2022-10-07 05:00:00"},   # election season, not presidential
        {"PlacedDateTime": "2020-08-31 23:30:00"}))
    got = rows(df, "OrderNumber", "HourCategory", "WorkHours", "LastWeek", "FirstWeek", "ElectionSeason",
               "PresidentialElection", "DayOfWeek")
    assert got == [
        (1, "Evening", False, False, False, False, False, 5),
        (2, "Evening", True, True, False, False, False, 0),
        (3, "Morning", False, False, True, True, False, 4),
        (4, "Evening", False, True, False, False, True, 0)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, 10, 100.0, 0), (1, 11, None, None), (1, 12, 50.0, 1), (2, 13, 5.0, 0), (2, None, 7.0, 0),
         (3, 14, 1.0, 0)], SCHEMAS["raw_order_item"])


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(
        [(10, "Round STICKER"), (11, "Label sheet"), (12, "Pouch"), (13, None), (14, "Sticker Sample pack")],
        SCHEMAS["raw_product_product_option"])


def test_order_without_items_has_no_sticker_but_an_unknown_pouch(order_rows, items, products):
    raw = order_rows({}, {}, {}, {})
    df = od.order_features(raw, items, products)
    got = rows(df, "OrderNumber", "ItemCount", "AvgItemQuantity", *od.ORDER_FLAGS)
    assert got == [
        (1, 2, 100.0, True, True, False), (2, 2, 6.0, False, False, False),
        (3, 1, 1.0, False, False, False), (4, None, None, False, False, None)]


def test_sample_only_orders(items, products):
    got = rows(od.sample_only_orders(cleaning.clean_items(items), products), "OrderNumber", "OrderSampleOnly")
    assert got == [(1, False), (2, False), (3, True)]


def test_tables_are_checked_and_read_back(spark, order_rows, tmp_path):
    write_tables({"raw_order": order_rows({"Tax": float("nan")}, {})}, str(tmp_path))
    back = read_tables(spark, str(tmp_path), ["raw_order"])["raw_order"]
    assert rows(back, "OrderNumber", "Tax") == [(1, None), (2, 1.0)]
    with pytest.raises(ValueError, match="missing columns: Tax"):
        conform(back.drop("Tax"), SCHEMAS["raw_order"])


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "CustomerId")
    first = rows(cleaning.sample_n(df, 300), "CustomerId")
    assert len(first) == 300 and first == rows(cleaning.sample_n(df.repartition(7), 300), "CustomerId")
    assert cleaning.sample_n(df, 6000).count() == 5000


def test_ship_dates_are_not_broadcast(spark, tmp_path):
    """Compressed files hide how many orders have ship dates, so the join may not follow their size."""
    placed = ["id as o_orderkey", "id as o_custkey", "'1-URGENT' as o_orderpriority", "date'2020-01-01' as o_orderdate",
              "500.0D as o_totalprice"]
    spark.range(1, 5).selectExpr(*placed).write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("select * from values (1L, date'2020-01-02'), (1L, date'2020-01-04'), (2L, null), (9L, date'2020-01-03')"
              " as t(l_orderkey, l_shipdate)").write.parquet(str(tmp_path / "lineitem.parquet"))
    raw = views.shop_table(spark, str(tmp_path), "raw_order")
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows(raw, "OrderNumber", "ShippedDateTime") == [(1, datetime(2020, 1, 4, 20)), (2, None), (3, None), (4, None)]
