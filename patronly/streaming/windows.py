"""Windowed totals of arriving orders, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .state import LATENESS

_TIMED = "PlacedDateTime is not null"


def windowed_orders(orders: DataFrame, size: str = "30 days", slide: str | None = None, lateness: str = LATENESS,
                    amount: str = "OrderItemPriceTotal") -> DataFrame:
    """Number, revenue and lowest number of the orders per window of event time.

    ``size`` alone gives tumbling windows, ``slide`` sliding ones, aligned to 1970-01-01 UTC.
    The same call works on a stream and on a table. On a stream, in append mode, a window
    comes out once, when the watermark (the newest time less ``lateness``) has passed its
    end; in update mode it comes again whenever it changes. Later orders are dropped. Rows
    without an order number (``clock_row``) only move the clock; orders without a time are
    left out. Counts are partial per task and window before anything moves.
    """
    known = F.col("OrderNumber").isNotNull()
    window = F.window("PlacedDateTime", size, slide) if slide else F.window("PlacedDateTime", size)
    return (
        orders.filter(_TIMED).select("OrderNumber", "PlacedDateTime", amount).withWatermark("PlacedDateTime", lateness)
        .groupBy(window.alias("w")).agg(
            F.count_if(known).alias("Orders"), F.sum(F.when(known, F.col(amount))).alias("Revenue"),
            F.min(F.when(known, F.col("OrderNumber"))).alias("LowestOrder"))
        .filter(F.col("Orders") > 0)
        .select(F.col("w.start").alias("WindowStart"), F.col("w.end").alias("WindowEnd"), "Orders", "Revenue", "LowestOrder"))
