"""Traps of customer aggregates, patterns, rules and rolling windows."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronly.operators import churn as ch, customers as cu, orders as od, warning as wa
from patronly.functions.skew import along_customer
from conftest import rows


def featured(raw):
    return od.add_order_columns(raw).withColumns({
        "ItemCount": F.lit(1).cast("bigint"), "AvgItemQuantity": F.lit(10.0),
        "OrderContainsSticker": F.lit(True), "OrderContainsLabel": F.lit(False),
        "OrderContainsPouch": F.lit(None).cast("boolean")})


def placed(*times, customer=1):
    return [{"PlacedDateTime": t, "CustomerId": customer} for t in times]


def test_gaps_are_whole_days(order_rows):
    raw = order_rows(*placed("2020-01-01 23:00:00", "2020-01-02 01:00:00", "2020-01-04 01:00:00", "2020-01-04 01:00:00"))
    assert rows(cu.order_gaps(raw), "MeanDaysBetweenOrders", "StdDaysBetweenOrders") == [
        (pytest.approx(2 / 3), pytest.approx(1.1547005))]
    assert rows(cu.order_gaps(order_rows(*placed("2020-01-01 00:00:00"))), "MeanDaysBetweenOrders",
                "StdDaysBetweenOrders") == [(None, None)]


def test_modes_take_the_smallest_on_ties(order_rows):
    raw = order_rows(*placed("2020-03-02 09:00:00", "2020-02-03 08:00:00"), {"CustomerId": 2, "PlacedDateTime": None})
    assert rows(cu.customer_modes(raw), "CustomerId", "ModeHour", "ModeDayOfWeek", "ModeMonth") == [
        (1, 8, 0, 2), (2, None, None, None)]


def test_first_values_may_mix_orders_but_first_shipped_is_one_row(order_rows):
    raw = order_rows(
        {"PlacedDateTime": "2020-01-01 00:00:00", "ShippedDateTime": "2020-02-01 00:00:00", "Tax": None, "PriceTotal": 1.0},
        {"PlacedDateTime": "2020-01-02 00:00:00", "ShippedDateTime": "2020-01-03 00:00:00", "Tax": 7.0, "PriceTotal": 2.0},
        {"PlacedDateTime": None, "Tax": 9.0})
    assert rows(cu.first_order_values(raw), "OrderNumber", "Tax", "PriceTotal") == [(1, 7.0, 1.0)]
    assert rows(cu.first_shipped_order(featured(raw)), "DayOfMonth") == [(2,)]


def test_first_and_last_break_ties_by_order_number(order_rows):
    raw = order_rows(*placed("2020-01-01 00:00:00", "2020-01-01 00:00:00", "2019-01-01 00:00:00"))
    assert rows(cu.first_n_orders(raw, 2), "OrderNumber") == [(1,), (3,)]
    assert rows(cu.last_n_orders(raw, 1), "OrderNumber") == [(2,)]


def test_shares_of_a_customer_without_listed_labels_are_null(order_rows):
    raw = featured(order_rows({"ShippingTotal": None}, {"CustomerId": 2}, {"CustomerId": 2, "ShippingTotal": None}))
    got = rows(cu.customer_pct(raw), "CustomerId", "PctNormalShipping", "PctTwoDayShipping", "PctMorning",
               "PctEvening", "PctOrdersWithSticker", "PctOrdersWithPouch")
    assert got == [(1, None, None, 1.0, 0.0, 1.0, None), (2, 0.5, 0.0, 1.0, 0.0, 1.0, None)]


def test_label_shares_count_orders_once(order_rows):
    raw = order_rows({"OrderNumber": 5}, {"OrderNumber": 5}, {"OrderNumber": 6, "ShippingTotal": 9.0})
    df = od.shipping_type(raw)
    assert rows(cu.label_share(df, "ShippingType", ["NormalShipping", "ExpeditedShipping"]),
                "PctNormalShipping", "PctExpeditedShipping") == [(0.5, 0.5)]
    assert rows(cu.customer_aggregates(featured(raw)), "TotalOrders") == [(3,)]


def test_annual_gap_edges(order_rows):
    def pattern(days):
        start = datetime(2015, 1, 1)
        return rows(ch.annual_pattern(order_rows(*placed(str(start), str(start + timedelta(days=days))))), "AnnualPattern")
    assert [pattern(d) for d in (314, 315, 415, 416)] == [[(False,)], [(True,)], [(True,)], [(False,)]]


def test_patterns_of_single_order_customers_are_unknown(order_rows):
    raw = featured(order_rows(
        {"PlacedDateTime": "2019-11-20 00:00:00", "CustomerId": 1},
        *placed("2018-11-20 00:00:00", "2019-11-20 00:00:00", "2020-03-01 00:00:00", customer=2),
        *placed("2020-03-01 00:00:00", "2020-03-02 00:00:00", customer=3)))
    got = rows(ch.churn_table(raw), "CustomerId", "HolidayPattern", "SummerPattern", "ElectionPattern", "AnnualPattern")
    assert got == [(1, None, None, None, None), (2, True, False, None, True), (3, False, False, None, False)]


def test_churn_rules(order_rows):
    def label(*times, now="2020-12-31 00:00:00"):
        return rows(ch.churn_table(featured(order_rows(*placed(*times))), now=now), "DaysSinceLastOrder",
                    "ExceededCadence", "LikelyChurned", "OneAndDone")[0]
    assert label("2020-11-26 00:00:00") == (35, False, False, False)
    assert label("2020-09-22 00:00:00") == (100, False, False, False)
    assert label("2020-09-21 00:00:00") == (101, False, True, True)
    assert label("2020-11-01 00:00:00", "2020-11-20 00:00:00") == (41, True, True, False)
    # A holiday customer is excused for 290 days of silence, but not from the own cadence.
    assert label("2018-12-01 00:00:00", "2019-12-01 00:00:00", now="2020-09-16 00:00:00") == (290, False, False, False)
    assert label("2018-12-01 00:00:00", "2019-12-01 00:00:00", now="2020-09-17 00:00:00") == (291, False, True, False)


def test_first_n_summary_uses_all_orders_for_labels_and_shares(order_rows):
    raw = featured(order_rows(
        {"PlacedDateTime": "2019-11-01 08:00:00", "PriceTotal": 10.0},
        {"PlacedDateTime": "2020-06-01 08:00:00", "PriceTotal": 30.0}))
    got = rows(ch.customer_summary_n(raw, "first", 1), "TotalOrders", "AvgPriceTotal", "OneAndDone", "PctHoliday")
    assert got == [(1, 10.0, False, 0.5)]


def test_invariants_and_input_order(order_rows):
    rng = random.Random(1)
    data = [{"CustomerId": rng.randrange(9), "PlacedDateTime": str(datetime(2015, 1, 1) + timedelta(hours=rng.randrange(50000))),
             "ShippingTotal": rng.choice([0.0, 4.0, 9.0, None])} for _ in range(120)]
    table = featured(order_rows(*data))
    summary = ch.customer_summary(table).toPandas()
    assert (summary["OneAndDone"] <= summary["ThreeOrFewerAndChurned"]).all()
    hours = summary[["PctMorning", "PctAfternoon", "PctEvening", "PctEarlyMorning"]].sum(axis=1)
    assert hours.round(9).eq(1).all()
    ships = summary[["PctNormalShipping", "PctTwoDayShipping", "PctExpeditedShipping"]].sum(axis=1)
    assert (ships <= 1 + 1e-9).all()
    again = ch.customer_summary(table.orderBy(F.rand(3))).toPandas()
    key = lambda d: d.sort_values("CustomerId", ignore_index=True).round(9)
    pd.testing.assert_frame_equal(key(summary), key(again))
    joined = cu.customer_pct(table).toPandas().sort_values("CustomerId", ignore_index=True)
    pd.testing.assert_frame_equal(
        joined.round(9), key(summary)[joined.columns], check_like=True)


def test_rolling_windows(order_rows):
    raw = featured(order_rows(
        {"PlacedDateTime": "2020-01-05 00:00:00", "OrderItemPriceTotal": 30.0},
        {"PlacedDateTime": "2020-01-01 00:00:00", "OrderItemPriceTotal": 10.0, "CustomerId": 2},
        {"PlacedDateTime": "2020-01-01 00:00:00", "OrderItemPriceTotal": 10.0},
        {"PlacedDateTime": "2020-01-03 00:00:00", "OrderItemPriceTotal": 20.0}))
    got = rows(wa.order_warnings(raw), "CustomerId", "OrderNumber", "Rolling2_AvgPrice", "DaysSincePrevOrder",
               "Rolling2_Gap", "RollingStd_Price", "Z_Price", "Z_Gap", "Flag_HighPrice", "Flag_IncreasingCadence")
    assert got == [
        (1, 1, 25.0, 2, 2.0, 10.0, 0.2, 0.0, True, True),
        (1, 3, 10.0, None, None, None, 0.0, None, True, False),
        (1, 4, 15.0, 2, 2.0, pytest.approx(7.0710678), pytest.approx(1 / 3), 0.0, True, True),
        (2, 2, 10.0, None, None, None, 0.0, None, True, False)]
    # A zero mean divides by one.
    zero = rows(wa.relative_deviation(wa.rolling_features(raw)), "Z_Discount")
    assert zero == [(0.0,)] * 4


@pytest.mark.parametrize("hot_rows", [0, 5, 40])
def test_hot_customers_get_the_same_windows(order_rows, hot_rows):
    rng = random.Random(2)
    data = [{"CustomerId": rng.choice([1, 1, 2, 3, 4]), "OrderItemPriceTotal": float(rng.randrange(100)),
             "PlacedDateTime": rng.choice([None] + [str(datetime(2020, 1, 1) + timedelta(minutes=20 * rng.randrange(40)))] * 20)}
            for _ in range(160)]
    raw = featured(order_rows(*data)).cache()

    def add(df, w):
        for step in (wa._means(wa.ROLLING_MEANS, 2), wa._gaps(2), wa._stds(wa.ROLLING_STDS, 3, 2)):
            df = step(df, w)
        return df

    columns = ["OrderNumber", "Rolling2_AvgPrice", "DaysSincePrevOrder", "Rolling2_Gap", "RollingStd_Price"]
    plain = rows(along_customer(raw, add, 2), *columns)
    assert rows(along_customer(raw, add, 2, hot_rows=hot_rows), *columns) == plain and len(plain) == 160
