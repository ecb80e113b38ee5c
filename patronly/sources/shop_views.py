"""The raw shop tables expressed over the star-schema test tables.

The star schema has no shop data of its own, so each raw table is a projection
(and for ship dates one aggregate) of orders, lineitem, part, nation or events.
The work therefore grows with those tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare
from ..schemas import SCHEMAS
from .tables import conform

# Values standing in for the shop's constants on this data.
PRODUCT_WORDS = {
    "IsSticker": ("widget", "old"),
    "IsLabel": ("bolt", "old"),
    "IsPouch": ("gear", "old"),
}
SAMPLE_WORD = "old"
FIRST_ORDER_CUTOFF = "1999-01-01"
ACTIVITY_YEAR = 2001
EXPORT_CUTOFF = "2001-03-01"
CROSSTAB_MIN = 20
EXPORT_CUSTOMERS = 200
PROMO_BUCKET = "6–10"


def _star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def _cases(key, values, default=None):
    """``values`` maps a remainder or text to a literal."""
    column = None
    for match, value in values.items():
        test = key == F.lit(match)
        column = F.when(test, F.lit(value)) if column is None else column.when(test, F.lit(value))
    return column.otherwise(F.lit(default)) if default is not None else column


def _raw_order(spark, folder):
    key = F.col("o_orderkey")
    shipped = (
        _star(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").alias("last_ship"))
    )
    cents = F.floor(F.col("o_totalprice") / 10) / F.lit(100)
    fee = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(15.0)).otherwise(F.lit(0.0))
    shipping = (
        F.when(key % 7 == 3, F.lit(None).cast("double"))
        .when((key % 7).isin(0, 4), F.lit(4.0)).when(key % 7 == 1, F.lit(12.5))
        .when(key % 7 == 2, F.lit(2.0)).otherwise(F.lit(0.0))
    )
    hours = lambda c, n: F.timestamp_add("HOUR", n, c.cast("timestamp"))
    # Spark takes the compressed files for the size of the dates, so it would broadcast one row per order.
    return _star(spark, folder, "orders").join(shipped.hint("merge"), "o_orderkey", "left").select(
        key.alias("OrderNumber"),
        F.when(key % 3 == 0, key + 1000000).otherwise(F.col("o_custkey")).alias("CustomerId"),
        F.when(key % 50 == 0, 1).when(key % 50 != 1, 0).alias("IsDeleted"),
        F.when(key % 20 == 7, 1).otherwise(2).alias("AffiliateId"),
        hours(F.col("o_orderdate"), (key % 24).cast("int")).alias("PlacedDateTime"),
        hours(F.col("last_ship"), F.lit(20)).alias("ShippedDateTime"),
        cents.alias("OrderItemPriceTotal"),
        shipping.alias("ShippingTotal"),
        (cents + fee).alias("PriceTotal"),
        fee.alias("RushFee"),
        shipping.alias("ShipPrice"),
        F.when(key % 4 == 0, -F.floor(F.col("o_totalprice") / 100) / F.lit(100))
        .when(key % 4 != 1, F.lit(0.0)).alias("PromoCodeDiscount"),
        (F.floor(F.col("o_totalprice") / 125) / F.lit(100)).alias("Tax"),
        _cases(key % 5, {0: "card", 1: "paypal", 2: "invoice", 3: "card"}).alias("PaymentMethod"),
        _cases(key % 3, {0: True, 1: False}).alias("NoPromotionalDesignUse"),
    )


def _raw_order_item(spark, folder):
    supplier = F.col("l_suppkey") % 25
    return _star(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("OrderNumber"),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("ProductProductOptionId"),
        F.col("l_quantity").alias("Quantity"),
        F.when(supplier == 0, 1).when(supplier != 1, 0).alias("IsDeleted"),
    )


def _raw_product(spark, folder):
    return _star(spark, folder, "part").select(
        F.col("p_partkey").alias("Id"),
        F.when(F.col("p_partkey") % 40 != 0, F.col("p_name")).alias("Name"),
    )


def _raw_ad_campaigns(spark, folder):
    key = F.col("n_nationkey")
    divisible = lambda n: F.when(key % n == 0, 1).otherwise(0)
    return _star(spark, folder, "nation").select(
        key.cast("string").alias("AdCampaignId"),
        (key % 2).alias("AdSticker"),
        (F.col("n_regionkey") % 2).alias("AdLabel"),
        ((key % 3) % 2).alias("AdPouch"),
        divisible(5).alias("AdCompetitor"),
        divisible(4).alias("AdMaterial"),
        divisible(6).alias("AdUseOrShape"),
        divisible(7).alias("AdVideo"),
        divisible(8).alias("AdDSA"),
    )


_SOURCES = {0: "google", 1: "(direct)", 2: "bing", 4: "facebook"}


def _raw_order_and_analytics(spark, folder):
    event, user = F.col("event_id"), F.col("user_id")
    return _star(spark, folder, "events").select(
        F.when(event % 97 == 0, F.lit("n/a")).otherwise((event % 4000).cast("string"))
        .alias("OrderNumber"),
        _cases(F.col("event_type"), {"click": "cpc", "view": "organic", "signup": "email",
                                     "purchase": "(none)"}).alias("medium"),
        _cases(user % 5, _SOURCES).alias("source"),
        F.when(user % 4 != 0, (user % 30).cast("string")).alias("AdwordsCampaignId"),
    )


def _bigquery_events(spark, folder):
    event, user = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return _star(spark, folder, "events").select(
        (event % 4000).cast("string").alias("param_transaction_id"),
        _cases(F.col("event_type"), {"click": "cpc", "view": "organic", "signup": "None",
                                     "purchase": ""}).alias("traffic_source_medium"),
        _cases(user % 5, _SOURCES).alias("traffic_source_source"),
        F.concat(F.lit("n"), (user % 7).cast("string")).alias("traffic_source_name"),
        F.col("event_type").alias("param_medium"),
        F.when(user % 2 == 0, F.lit("google")).alias("param_source"),
        _cases(k % 3, {0: "mobile", 1: "desktop"}, "tablet").alias("device_category"),
        _cases(user % 4, {0: "iOS", 1: "Android", 2: "Windows"}).alias("device_operating_system"),
        F.concat(F.lit("metro_"), (user % 20).cast("string")).alias("geo_metro"),
    )


# The month of events is stretched to five years of visits, from this time on.
VISITS_FROM, VISITS_STRETCH = "1995-01-01", 60


def _web_visits(spark, folder):
    event, user = F.col("event_id"), F.col("user_id")
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return _star(spark, folder, "events").select(
        event.alias("VisitId"), (user * 10 + event % 10).alias("CustomerId"),
        F.timestamp_micros(F.unix_micros(F.lit(VISITS_FROM).cast("timestamp")) + since * VISITS_STRETCH).alias("VisitedAt"),
        _cases(F.col("event_type"), {"click": "cpc", "view": "organic", "signup": "email"}).alias("traffic_source_medium"),
        _cases(user % 4, {0: "iOS", 1: "Android", 2: "Windows"}).alias("device_operating_system"))


def _promotions(spark, folder):
    key = F.col("s_suppkey")
    start = F.date_add(F.lit("1994-01-01").cast("date"), (key * 37 % 2500).cast("int"))
    return _star(spark, folder, "supplier").select(
        key.alias("PromotionId"), start.cast("timestamp").alias("StartsAt"),
        F.date_add(start, (1 + key % 45).cast("int")).cast("timestamp").alias("EndsAt"))


_BUILDERS = {
    "raw_order": _raw_order,
    "raw_order_item": _raw_order_item,
    "raw_product_product_option": _raw_product,
    "raw_ad_campaigns": _raw_ad_campaigns,
    "raw_order_and_analytics": _raw_order_and_analytics,
    "bigquery_events": _bigquery_events,
    "web_visits": _web_visits,
    "promotions": _promotions,
}


def shop_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One raw table, lazily, in its declared schema."""
    prepare(spark)
    return conform(_BUILDERS[name](spark, folder), SCHEMAS[name])
