"""Order-level features: item rollup, calendar parts, shipping labels and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    AFFILIATE, EDGE_DAYS, FREE_SHIPPING_AT, HOUR_RANGES, PRODUCT_WORDS, SAMPLE_WORD, SEASONS, TWO_DAY_PRICE,
    WORK_HOURS, WORKDAYS,
)
from ..functions.columns import hours_between, true_or_false
from ..functions.skew import salted_join
from .cleaning import clean_items, clean_orders

PRODUCT_FLAGS = ["IsSticker", "IsLabel", "IsPouch"]
ORDER_FLAGS = ["OrderContainsSticker", "OrderContainsLabel", "OrderContainsPouch"]


# ---------------------------------------------------------------- items
def product_flags(products: DataFrame, words: dict = PRODUCT_WORDS) -> DataFrame:
    """Id plus one flag per family: the name has its word and not the excluded one."""
    name = F.lower("Name")
    flags = {
        flag: true_or_false(name.contains(word.lower()) & ~name.contains(without.lower()))
        for flag, (word, without) in words.items()
    }
    return products.select("Id", *[c.alias(flag) for flag, c in flags.items()])


def items_with_product(items: DataFrame, flags: DataFrame) -> DataFrame:
    """Items with their product's columns; unknown products leave them null."""
    return salted_join(items, flags, "ProductProductOptionId", "Id", "left")


def order_item_rollup(items: DataFrame) -> DataFrame:
    """Per order: item count, mean quantity and which families it contains."""
    contains = [
        true_or_false(F.bool_or(flag)).alias(flag.replace("Is", "OrderContains", 1))
        for flag in PRODUCT_FLAGS
    ]
    return items.filter(F.col("OrderNumber").isNotNull()).groupBy("OrderNumber").agg(
        F.count(F.lit(1)).alias("ItemCount"), F.avg("Quantity").alias("AvgItemQuantity"), *contains
    )


def sample_only_orders(items: DataFrame, products: DataFrame, word: str = SAMPLE_WORD) -> DataFrame:
    """Per order: whether every item's product name carries the sample word."""
    sample = true_or_false(F.lower("Name").contains(word.lower()))
    named = salted_join(
        items.select("OrderNumber", "ProductProductOptionId"),
        products.select("Id", sample.alias("IsSample")), "ProductProductOptionId", "Id", "left")
    return named.groupBy("OrderNumber").agg(
        F.bool_and(true_or_false(F.col("IsSample"))).alias("OrderSampleOnly"))


def orders_with_rollup(orders: DataFrame, rollup: DataFrame) -> DataFrame:
    """Orders with their rollup. An order without live items contains no sticker and
    no label, while its pouch flag stays unknown."""
    joined = orders.join(rollup, "OrderNumber", "left")
    return joined.withColumns({
        c: true_or_false(F.col(c)) for c in ["OrderContainsSticker", "OrderContainsLabel"]
    })


# ---------------------------------------------------------------- time
def hour_category_of(hour: Column) -> Column:
    named = F
    for label, ends in HOUR_RANGES.items():
        named = named.when(hour.between(*ends), label)
    return named.otherwise("EarlyMorning")


def calendar_of(placed) -> dict[str, Column]:
    placed = F.col(placed) if isinstance(placed, str) else placed
    return {
        "HourOfDay": F.hour(placed), "DayOfWeek": F.weekday(placed),
        "Month": F.month(placed), "DayOfMonth": F.day(placed),
    }


def work_flags_of(placed) -> dict[str, Column]:
    part = calendar_of(placed)
    workday = true_or_false(part["DayOfWeek"] < WORKDAYS)
    return {
        "WorkHours": true_or_false(part["HourOfDay"].between(*WORK_HOURS)) & workday,
        "Workday": workday,
    }


def month_edge_flags_of(placed) -> dict[str, Column]:
    placed = F.col(placed) if isinstance(placed, str) else placed
    day = F.day(placed)
    return {
        "FirstWeek": true_or_false(day <= EDGE_DAYS),
        "LastWeek": true_or_false(F.day(F.last_day(placed)) - day < EDGE_DAYS),
    }


def season_flags_of(placed) -> dict[str, Column]:
    placed = F.col(placed) if isinstance(placed, str) else placed
    month, year = F.month(placed), F.year(placed)
    return {name: true_or_false(month.isin(*months) & (year % every == 0)) for name, (months, every) in SEASONS.items()}


def calendar_parts(orders: DataFrame) -> DataFrame:
    return orders.withColumns(calendar_of("PlacedDateTime"))


def ship_delay_hours(orders: DataFrame) -> DataFrame:
    return orders.withColumn("ShipDelayHours", hours_between("PlacedDateTime", "ShippedDateTime"))


def hour_category(orders: DataFrame) -> DataFrame:
    return orders.withColumn("HourCategory", hour_category_of(F.hour("PlacedDateTime")))


def work_flags(orders: DataFrame) -> DataFrame:
    return orders.withColumns(work_flags_of("PlacedDateTime"))


def month_edge_flags(orders: DataFrame) -> DataFrame:
    return orders.withColumns(month_edge_flags_of("PlacedDateTime"))


def season_flags(orders: DataFrame) -> DataFrame:
    return orders.withColumns(season_flags_of("PlacedDateTime"))


# ---------------------------------------------------------------- money and shipping
def promo_fill(orders: DataFrame) -> DataFrame:
    return orders.withColumn("PromoCodeDiscount", F.coalesce("PromoCodeDiscount", F.lit(0.0)))


def shipping_type(orders: DataFrame, free_at: float = FREE_SHIPPING_AT,
                  two_day: float = TWO_DAY_PRICE, default: str = "UnknownShipping") -> DataFrame:
    """Shipping label from order value and shipping price; null prices give the default."""
    total, price = F.col("OrderItemPriceTotal"), F.col("ShippingTotal")
    small = total < free_at
    return orders.withColumn(
        "ShippingType",
        F.when(small & (price == 0), "NormalShipping")
        .when((small & (price == two_day)) | ((total >= free_at) & (price == 0)), "TwoDayShipping")
        .when(price > two_day, "ExpeditedShipping").otherwise(default),
    )


def shipping_type_uncategorized(orders: DataFrame, **rules) -> DataFrame:
    return shipping_type(orders, default="UncategorizedShipping", **rules)


def shipping_binary(orders: DataFrame, free_at: float = FREE_SHIPPING_AT) -> DataFrame:
    """NormalShipping or OtherShipping from the prices."""
    normal = (F.col("OrderItemPriceTotal") < free_at) & (F.col("ShippingTotal") == 0)
    return orders.withColumn("ShippingType", F.when(normal, "NormalShipping").otherwise("OtherShipping"))


def shipping_simple(df: DataFrame) -> DataFrame:
    """Normal or Other from a shipping label."""
    return df.withColumn(
        "ShippingSimple", F.when(F.col("ShippingType") == "NormalShipping", "Normal").otherwise("Other"))


def fee_total(orders: DataFrame) -> DataFrame:
    return orders.withColumn("RushFeeAndShipPrice", F.col("RushFee") + F.col("ShipPrice"))


# ---------------------------------------------------------------- composed
FEATURE_STEPS = [
    calendar_parts, ship_delay_hours, promo_fill, shipping_type, hour_category,
    work_flags, month_edge_flags, season_flags, fee_total,
]


def add_order_columns(orders: DataFrame) -> DataFrame:
    """All per-order columns that need no other table."""
    return reduce(lambda df, step: step(df), FEATURE_STEPS, orders)


def item_rollup(items: DataFrame, products: DataFrame, words: dict = PRODUCT_WORDS) -> DataFrame:
    live = clean_items(items).select("OrderNumber", "ProductProductOptionId", "Quantity")
    return order_item_rollup(items_with_product(live, product_flags(products, words)))


def order_features(orders: DataFrame, items: DataFrame, products: DataFrame,
                   words: dict = PRODUCT_WORDS, affiliate: int = AFFILIATE) -> DataFrame:
    """The order feature table: one row per clean order."""
    rolled = item_rollup(items, products, words)
    return add_order_columns(orders_with_rollup(clean_orders(orders, affiliate), rolled))
