"""Early-warning signals: each order against the customer's last few orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import true_or_false, whole_days
from ..functions.skew import along_customer
from .customers import known_customers, last_n_orders, repeat_orders

# Rolling column -> the order column it averages.
ROLLING_MEANS = {
    "Rolling2_AvgPrice": "OrderItemPriceTotal",
    "Rolling2_AvgShipping": "RushFeeAndShipPrice",
    "Rolling2_AvgDiscount": "PromoCodeDiscount",
}
ROLLING_STDS = {
    "RollingStd_Price": "OrderItemPriceTotal",
    "RollingStd_Shipping": "RushFeeAndShipPrice",
}
# Deviation column -> (current value, its rolling mean).
DEVIATIONS = {
    "Z_Price": ("OrderItemPriceTotal", "Rolling2_AvgPrice"),
    "Z_Shipping": ("RushFeeAndShipPrice", "Rolling2_AvgShipping"),
    "Z_Discount": ("PromoCodeDiscount", "Rolling2_AvgDiscount"),
    "Z_Gap": ("DaysSincePrevOrder", "Rolling2_Gap"),
}
# Flag -> (deviation, comparison, threshold), signs as the shop uses them.
FLAG_RULES = {
    "Flag_LowPrice": ("Z_Price", "<", -1.0),
    "Flag_HighPrice": ("Z_Price", "<", 1.0),
    "Flag_LowShipping": ("Z_Shipping", ">", -1.0),
    "Flag_HighShipping": ("Z_Shipping", ">", 1.0),
    "Flag_LowDiscount": ("Z_Discount", ">", -1.0),
    "Flag_HighDiscount": ("Z_Discount", ">", 1.0),
    "Flag_SlowingCadence": ("Z_Gap", ">", 1.0),
    "Flag_IncreasingCadence": ("Z_Gap", ">", -1.0),
}


def _last(window: Window, rows: int) -> Window:
    return window.rowsBetween(-(rows - 1), Window.currentRow)


def _means(columns: dict, n: int):
    return lambda df, w: df.withColumns(
        {name: F.avg(c).over(_last(w, n)) for name, c in columns.items()})


def _gaps(n: int):
    def add(df, w):
        gap = whole_days(F.lag("PlacedDateTime").over(w), F.col("PlacedDateTime"))
        df = df.withColumn("DaysSincePrevOrder", gap)
        return df.withColumn("Rolling2_Gap", F.avg("DaysSincePrevOrder").over(_last(w, n)))
    return add


def _stds(columns: dict, n: int, least: int):
    return lambda df, w: df.withColumns({
        name: F.when(F.count(c).over(_last(w, n)) >= least, F.stddev_samp(c).over(_last(w, n)))
        for name, c in columns.items()})


def rolling_mean(orders: DataFrame, columns: dict = ROLLING_MEANS, n: int = 2) -> DataFrame:
    """Mean of the last ``n`` orders per customer, from the first order on."""
    return along_customer(known_customers(orders), _means(columns, n), depth=n - 1)


def prev_order_gap(orders: DataFrame, n: int = 2) -> DataFrame:
    """Whole days since the previous order and the mean of the last ``n`` such gaps."""
    return along_customer(known_customers(orders), _gaps(n), depth=n)


def rolling_std(orders: DataFrame, columns: dict = ROLLING_STDS, n: int = 3,
                least: int = 2) -> DataFrame:
    """Sample deviation of the last ``n`` orders; null below ``least`` values."""
    return along_customer(known_customers(orders), _stds(columns, n, least), depth=n - 1)


def _rolling(df: DataFrame, window: Window) -> DataFrame:
    for step in (_means(ROLLING_MEANS, 2), _gaps(2), _stds(ROLLING_STDS, 3, 2)):
        df = step(df, window)
    return df


def rolling_features(orders: DataFrame) -> DataFrame:
    """All rolling columns over one sort of each customer's orders."""
    return along_customer(known_customers(orders), _rolling, depth=2)


def deviation(current, mean) -> Column:
    """Distance from the rolling mean in units of that mean (a zero mean counts as 1)."""
    mean = F.col(mean) if isinstance(mean, str) else mean
    current = F.col(current) if isinstance(current, str) else current
    return (current - mean) / F.when(mean == 0, F.lit(1.0)).otherwise(mean)


def relative_deviation(rolled: DataFrame, columns: dict = DEVIATIONS) -> DataFrame:
    return rolled.withColumns({z: deviation(c, m) for z, (c, m) in columns.items()})


def warning_flags(deviations: DataFrame, rules: dict = FLAG_RULES) -> DataFrame:
    """Threshold flags; an unknown deviation raises none."""
    return deviations.withColumns({
        flag: true_or_false(F.col(z) < t if sign == "<" else F.col(z) > t)
        for flag, (z, sign, t) in rules.items()})


def order_warnings(orders: DataFrame, rules: dict = FLAG_RULES) -> DataFrame:
    """Every order with its rolling columns, deviations and flags."""
    return warning_flags(relative_deviation(rolling_features(orders)), rules)


def latest_warning(orders: DataFrame, summary: DataFrame, rules: dict = FLAG_RULES) -> DataFrame:
    """The newest order of each repeat customer with its warnings and churn label.

    The newest order's frames reach two orders back, so only the last three
    orders of a customer are needed.
    """
    recent = last_n_orders(repeat_orders(orders, summary), 3)
    window = Window.partitionBy("CustomerId").orderBy(
        F.col("PlacedDateTime").asc_nulls_last(), F.col("OrderNumber").asc_nulls_last())
    rolled = _rolling(recent, window).withColumn("_later", F.lead(F.lit(1)).over(window))
    newest = warning_flags(relative_deviation(rolled.filter("_later is null")), rules)
    return newest.select(
        "CustomerId", "OrderNumber", F.col("PlacedDateTime").alias("OrderDate"),
        *DEVIATIONS, *rules,
    ).join(summary.select("CustomerId", "LikelyChurned"), "CustomerId", "inner")
