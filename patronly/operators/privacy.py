"""Pseudonymised export: salted ids, jittered times and amounts, sampled customers.

Randomness comes from a seeded hash of the row's key, so a rerun or a retried
task gives the same export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import AFFILIATE
from ..functions.columns import uniform
from ..functions.numbering import number_rows
from ..functions.skew import small_or_self
from .cleaning import clean_items, sample_n, shipped_before

# Exported columns and the amounts to jitter.
EXPORT_COLUMNS = [
    "OrderNumber", "CustomerId", "PlacedDateTime", "PaymentMethod", "OrderItemPriceTotal",
    "RushFee", "Tax", "ShipPrice", "PromoCodeDiscount", "NoPromotionalDesignUse",
]
AMOUNTS = ["OrderItemPriceTotal", "RushFee", "Tax", "ShipPrice", "PromoCodeDiscount"]
CATEGORIES = ["PaymentMethod", "NoPromotionalDesignUse"]


def _own_seed(seed: int, name: str) -> Column:
    return F.lit(f"{seed}/{name}")


def _draw(name: str, seed: int, key: str) -> Column:
    """A uniform number per row and purpose."""
    return uniform(key, _own_seed(seed, name), seed=seed)


def salted_hash(df: DataFrame, column: str, salt: str) -> DataFrame:
    """Adds ``<column>Hash`` = SHA-256 of ``salt_value``; null stays null."""
    text = F.concat(F.lit(f"{salt}_"), F.col(column).cast("string"))
    return df.withColumn(f"{column}Hash", F.sha2(text, 256))


def jitter_days(df: DataFrame, column: str = "PlacedDateTime", most: int = 14, seed: int = 42,
                key: str = "OrderNumber") -> DataFrame:
    """Move a time back by 0 to ``most`` whole days."""
    days = F.floor(_draw(column, seed, key) * (most + 1)).cast("int")
    return df.withColumn(column, F.timestamp_add("DAY", -days, F.col(column)))


def jitter_amount(df: DataFrame, columns=AMOUNTS, part: float = 0.1, seed: int = 42,
                  key: str = "OrderNumber") -> DataFrame:
    """Scale amounts by a factor within ``1 ± part``; null and 0 stay."""
    return df.withColumns({
        c: F.col(c) * (F.lit(1.0 - part) + F.lit(2 * part) * _draw(c, seed, key)) for c in columns})


def obfuscate_category(df: DataFrame, column: str, share: float = 0.15, seed: int = 42,
                       key: str = "OrderNumber") -> DataFrame:
    """Replace about ``share`` of the values by a random observed one (maybe the same).

    The observed values are numbered and joined by a drawn number, so they may be many; a
    row that keeps its value draws a number of its own, below zero, and meets nothing.
    """
    values = number_rows(df.select(F.col(column).alias("_value")).filter("_value is not null").distinct(), ["_value"], "_number")
    count = values.count()
    if not count:
        return df
    drawn = F.floor(_draw(f"{column}/value", seed, key) * count)
    chosen = F.when(_draw(column, seed, key) < share, drawn).otherwise(-1 - drawn)
    replaced = df.withColumn("_drawn", chosen).join(values, F.col("_drawn") == F.col("_number"), "left")
    return replaced.withColumn(column, F.coalesce("_value", column)).select(*df.columns)


def id_reference(df: DataFrame) -> DataFrame:
    """Which hash stands for which id: for internal use only."""
    return df.select("OrderNumber", "OrderNumberHash", "CustomerId", "CustomerIdHash")


def sample_customers(orders: DataFrame, n: int = 10_000, seed: int = 42) -> DataFrame:
    """All orders of ``n`` customers picked by a seeded hash."""
    customers = orders.select("CustomerId").filter(F.col("CustomerId").isNotNull()).distinct()
    chosen = small_or_self(sample_n(customers, n, "CustomerId", seed))  # n ids: a broadcast
    return orders.join(chosen, "CustomerId", "left_semi")


def drop_top_customer(orders: DataFrame, customer: str = "CustomerId") -> DataFrame:
    """Leave out the customer with most orders (ties: the smallest id)."""
    top = (
        orders.filter(F.col(customer).isNotNull()).groupBy(customer)
        .agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), F.col(customer)).limit(1).first()
    )
    if top is None:
        return orders
    return orders.filter(~F.col(customer).eqNullSafe(F.lit(top[customer])))


def exportable_orders(orders: DataFrame, items: DataFrame, cutoff: str,
                      affiliate: int = AFFILIATE) -> DataFrame:
    """The export's columns plus the number of live items per order."""
    counts = clean_items(items).filter(F.col("OrderNumber").isNotNull()).groupBy("OrderNumber").agg(
        F.count(F.lit(1)).alias("TotalOrderItems"))
    return shipped_before(orders, cutoff, affiliate).select(*EXPORT_COLUMNS).join(
        counts, "OrderNumber", "left")


def export_orders(orders: DataFrame, items: DataFrame, cutoff: str, salt: str, n: int = 10_000,
                  seed: int = 42, affiliate: int = AFFILIATE) -> DataFrame:
    """The shareable table: sampled customers, hashed ids, jittered values, no raw id."""
    df = sample_customers(exportable_orders(orders, items, cutoff, affiliate), n, seed)
    for column in ("OrderNumber", "CustomerId"):
        df = salted_hash(df, column, salt)
    df = jitter_amount(jitter_days(df, seed=seed), seed=seed)
    for column in CATEGORIES:
        df = obfuscate_category(df, column, seed=seed)
    return df.drop("OrderNumber", "CustomerId")
