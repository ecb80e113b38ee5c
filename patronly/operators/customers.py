"""Customer-level aggregates, shares, first/last orders and summaries.

A customer may hold a large part of all orders, so nothing here lines up one
customer's raw orders in one task: sums and counts combine on the map side, and
everything that depends on order sequence works on clock-hour totals, of which a
customer has at most as many as the calendar has hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import FIRST_SHIPPED_COLUMNS, HOUR_LABELS, SHIP_LABELS
from ..functions.columns import as_int, whole_days
from ..functions.skew import row_order
from .orders import month_edge_flags_of, season_flags_of, shipping_binary, work_flags_of

# Output column -> order column whose mean it is.
MEANS = {
    "AvgOrderItemTotal": "OrderItemPriceTotal",
    "AvgPriceTotal": "PriceTotal",
    "AvgItemsPerOrder": "ItemCount",
    "AvgPromoDiscount": "PromoCodeDiscount",
    "AvgQuantity": "AvgItemQuantity",
    "AvgRushFee": "RushFee",
    "AvgShipPrice": "ShipPrice",
    "AvgRushFeeAndShipPrice": "RushFeeAndShipPrice",
}
# Share column -> order flag, in output order.
FLAG_SHARES = {
    "PctFirstWeek": "FirstWeek",
    "PctLastWeek": "LastWeek",
    "PctHoliday": "Holiday",
    "PctSummer": "Summer",
    "PctElectionSeason": "ElectionSeason",
    "PctPresidentialElection": "PresidentialElection",
    "PctWorkHours": "WorkHours",
    "PctWorkday": "Workday",
    "PctOrdersWithSticker": "OrderContainsSticker",
    "PctOrdersWithLabel": "OrderContainsLabel",
    "PctOrdersWithPouch": "OrderContainsPouch",
}
PRODUCT_FLAGS = {n: c for n, c in FLAG_SHARES.items() if c.startswith("OrderContains")}
# Mode column -> (calendar part of an hour, its possible values).
MODES = {"ModeHour": ("hour(Hour)", range(24)), "ModeDayOfWeek": ("weekday(Hour)", range(7)),
         "ModeMonth": ("month(Hour)", range(1, 13))}


def known_customers(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("CustomerId").isNotNull())


# ---------------------------------------------------------------- first and last orders
def _ranked(orders: DataFrame, n: int, newest: bool) -> DataFrame:
    """Up to ``n`` orders per customer; the rank filter also prunes before the shuffle."""
    time, tie = F.col("PlacedDateTime"), F.col("OrderNumber")
    order = ([time.desc_nulls_first(), tie.desc_nulls_first()] if newest
             else [time.asc_nulls_last(), tie.asc_nulls_last()])
    rank = F.row_number().over(Window.partitionBy("CustomerId").orderBy(*order))
    return known_customers(orders).withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def first_n_orders(orders: DataFrame, n: int) -> DataFrame:
    return _ranked(orders, n, newest=False)


def last_n_orders(orders: DataFrame, n: int) -> DataFrame:
    return _ranked(orders, n, newest=True)


def first_order_values(orders: DataFrame) -> DataFrame:
    """Per customer the earliest known value of each column, so one output row may
    mix values of several orders."""
    columns = [c for c in orders.columns if c != "CustomerId"]
    return known_customers(orders).groupBy("CustomerId").agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), row_order())).alias(c) for c in columns])


def first_shipped_order(order_features: DataFrame) -> DataFrame:
    """Per customer the whole row of the order that shipped first."""
    window = Window.partitionBy("CustomerId").orderBy(
        F.col("ShippedDateTime").asc_nulls_last(), F.col("OrderNumber").asc_nulls_last())
    return (
        known_customers(order_features).withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1).select("CustomerId", *FIRST_SHIPPED_COLUMNS)
    )


# ---------------------------------------------------------------- hourly totals
def customer_hours(orders: DataFrame) -> DataFrame:
    """Per customer and clock hour: row counts, first and last time, and the sums and
    counts behind every customer mean."""
    measures = [c for c in dict.fromkeys(MEANS.values()) if c in orders.columns]
    flags = [c for c in PRODUCT_FLAGS.values() if c in orders.columns]
    return (
        known_customers(orders)
        .groupBy("CustomerId", F.date_trunc("HOUR", "PlacedDateTime").alias("Hour"))
        .agg(
            F.count(F.lit(1)).alias("Rows"), F.count("OrderNumber").alias("Orders"),
            F.min("PlacedDateTime").alias("FirstTime"), F.max("PlacedDateTime").alias("LastTime"),
            *[F.sum(F.col(c).cast("double")).alias(f"Sum_{c}") for c in measures],
            *[F.sum(as_int(c)).alias(f"Sum_{c}") for c in flags],
            *[F.count(c).alias(f"Known_{c}") for c in [*measures, *flags]],
        )
    )


def by_time() -> Window:
    """A customer's hours in order; at most one row per hour of the calendar."""
    return Window.partitionBy("CustomerId").orderBy(F.col("Hour").asc_nulls_last())


def gap_columns(hours: DataFrame) -> DataFrame:
    """Adds Gap: whole days from the previous hour's last order to this hour's first.

    Orders inside one hour are less than a day apart, so their gaps are all 0.
    """
    return hours.withColumn("Gap", whole_days(F.lag("LastTime").over(by_time()), F.col("FirstTime")))


def _timed_rows():
    return F.sum(F.when(F.col("Hour").isNotNull(), F.col("Rows")))


def gap_stats() -> dict:
    """Mean and sample deviation of the gaps between a customer's orders."""
    gaps = (_timed_rows() - 1).cast("double")
    total, squares = F.sum("Gap").cast("double"), F.sum(F.col("Gap") * F.col("Gap")).cast("double")
    total, squares = F.coalesce(total, F.lit(0.0)), F.coalesce(squares, F.lit(0.0))
    return {
        "MeanDaysBetweenOrders": F.when(gaps >= 1, F.try_divide(total, gaps)),
        "StdDaysBetweenOrders": F.when(
            gaps >= 2, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(
                squares * gaps - total * total, gaps * (gaps - 1))))),
    }


def _mode(part: str, values):
    """Value with most rows, ties to the smallest, from one count per possible value.

    Count and value travel in one number: count first, then smallest value highest.
    """
    values = list(values)
    base, top = len(values), max(values)
    coded = ", ".join(f"sum(if({part} = {v}, Rows, 0)) * {base} + {top - v}" for v in values)
    mode = F.expr(f"cast({top} - pmod(greatest({coded}), {base}) as int)")
    return F.when(F.count("Hour") > 0, mode)


def mode_columns() -> dict:
    return {name: _mode(part, values) for name, (part, values) in MODES.items()}


def total_columns() -> dict:
    return {
        "TotalOrders": F.sum("Orders"),
        **{
            name: F.try_divide(F.sum(f"Sum_{c}"), F.sum(f"Known_{c}").cast("double"))
            for name, c in MEANS.items()
        },
        "FirstOrderDate": F.min("FirstTime"),
        "LastOrderDate": F.max("LastTime"),
    }


def _per_customer(hours: DataFrame, columns: dict) -> DataFrame:
    return hours.groupBy("CustomerId").agg(*[c.alias(name) for name, c in columns.items()])


def customer_aggregates(orders: DataFrame) -> DataFrame:
    """Order count, eight means, first and last order time per customer."""
    return known_customers(orders).groupBy("CustomerId").agg(
        F.count("OrderNumber").alias("TotalOrders"),
        *[F.avg(c).alias(name) for name, c in MEANS.items()],
        F.min("PlacedDateTime").alias("FirstOrderDate"),
        F.max("PlacedDateTime").alias("LastOrderDate"),
    )


def order_gaps(orders: DataFrame) -> DataFrame:
    return _per_customer(gap_columns(customer_hours(orders)), gap_stats())


def customer_modes(orders: DataFrame) -> DataFrame:
    return _per_customer(customer_hours(orders), mode_columns())


def customer_profile(orders: DataFrame, extra: dict | None = None, prepare=None) -> DataFrame:
    """Aggregates, gap statistics and modes in one pass over the hourly totals.

    ``prepare`` may add window columns to the hours and ``extra`` further
    aggregates over them, which then share the same shuffle and sort.
    """
    hours = gap_columns(customer_hours(orders))
    if prepare is not None:
        hours = prepare(hours)
    columns = {**total_columns(), **gap_stats(), **mode_columns(), **(extra or {})}
    return _per_customer(hours, columns)


# ---------------------------------------------------------------- shares
def label_shares(orders: DataFrame, groups: dict) -> DataFrame:
    """Distinct orders with each label over distinct orders, per customer, for several
    label columns (``groups``: column -> labels).

    Labels first become one bit each, joined per order, so a hot customer stays spread
    over its order ids - as three numbers per order - until only counts are left. A
    customer none of whose orders has a listed label of a column gets null, not 0.
    """
    bits = {(c, label): 1 << i for i, (c, label) in enumerate(
        (c, label) for c, labels in groups.items() for label in labels)}
    mask = sum((F.when(F.col(c) == label, bit).otherwise(0) for (c, label), bit in bits.items()), F.lit(0))
    per_order = known_customers(orders).groupBy("CustomerId", "OrderNumber").agg(
        F.bit_or(mask).alias("labels"))
    numbered = F.col("OrderNumber").isNotNull()
    has = lambda bit: F.col("labels").bitwiseAND(F.lit(bit)) != 0
    counts = per_order.groupBy("CustomerId").agg(
        F.count("OrderNumber").cast("double").alias("all"), F.bit_or("labels").alias("seen"),
        *[F.count_if(numbered & has(bit)).alias(f"n{bit}") for bit in bits.values()])
    shares = []
    for c, labels in groups.items():
        listed = sum(bits[c, label] for label in labels)
        for label in labels:
            share = F.try_divide(F.col(f"n{bits[c, label]}").cast("double"), F.col("all"))
            shares.append(F.when(F.col("seen").bitwiseAND(F.lit(listed)) != 0, F.coalesce(share, F.lit(0.0)))
                          .alias(f"Pct{label}"))
    return counts.select("CustomerId", *shares)


def label_share(orders: DataFrame, column: str, labels) -> DataFrame:
    """Share of one column's labels per customer."""
    return label_shares(orders, {column: list(labels)})


def flag_share(orders: DataFrame, flags: dict = FLAG_SHARES) -> DataFrame:
    """Mean of each flag over a customer's rows; unknown flags are left out."""
    return known_customers(orders).groupBy("CustomerId").agg(
        *[F.avg(as_int(flag)).alias(name) for name, flag in flags.items()])


def flag_share_columns() -> dict:
    """The same shares from hourly totals: calendar flags hold for a whole hour."""
    calendar = {**month_edge_flags_of("Hour"), **season_flags_of("Hour"), **work_flags_of("Hour")}
    rows = F.sum("Rows").cast("double")
    shares = {}
    for name, flag in FLAG_SHARES.items():
        if flag in calendar:
            on = F.sum(F.when(calendar[flag], F.col("Rows")).otherwise(0)).cast("double")
            shares[name] = F.try_divide(on, rows)
        else:
            shares[name] = F.try_divide(
                F.sum(f"Sum_{flag}").cast("double"), F.sum(f"Known_{flag}").cast("double"))
    return shares


SHARE_GROUPS = {"ShippingType": SHIP_LABELS, "HourCategory": HOUR_LABELS}


def customer_pct(orders: DataFrame, flags: dict = FLAG_SHARES, groups: dict = SHARE_GROUPS) -> DataFrame:
    """All label and flag shares of a customer."""
    return label_shares(orders, groups).join(flag_share(orders, flags), "CustomerId", "left")


# ---------------------------------------------------------------- selections and scalars
def repeat_orders(orders: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Orders of customers with more than one order."""
    repeat = aggregates.filter(F.col("TotalOrders") > 1).select("CustomerId")
    return orders.join(repeat, "CustomerId", "left_semi")


def as_of_now(orders: DataFrame) -> DataFrame:
    """The clock of the data: the latest order time, as a one-row table."""
    return orders.agg(F.max("PlacedDateTime").alias("Now"))


def lifetime_value(summary: DataFrame) -> DataFrame:
    return summary.withColumn("LifetimeValue", F.col("AvgPriceTotal") * F.col("TotalOrders"))


def with_report_names(summary: DataFrame) -> DataFrame:
    """Names that reports and models use for existing columns."""
    return lifetime_value(summary).withColumns({
        "AvgOrderValue": F.col("AvgPriceTotal"),
        "AvgDiscount": F.col("AvgPromoDiscount"),
    })


def first_order_flags(summary: DataFrame, first_orders: DataFrame, rollup: DataFrame) -> DataFrame:
    """Summary with the first order's product flags and two-way shipping label."""
    contains = {
        f"OrderContains{kind}": f"FirstOrderContains{kind}" for kind in ["Label", "Sticker", "Pouch"]
    }
    flags = (
        shipping_binary(first_orders).select("CustomerId", "OrderNumber", "ShippingType")
        .join(rollup.select("OrderNumber", *contains), "OrderNumber", "left")
        .select("CustomerId", "ShippingType", *[F.col(a).alias(b) for a, b in contains.items()])
    )
    return summary.join(flags, "CustomerId", "left")
