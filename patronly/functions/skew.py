"""Keeping one hot key from becoming one hot task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 16
SMALL_ROWS = 100_000
SMALL_BYTES = 16 << 20
HOT_ROWS = 1_000_000


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """Whether a table has at most ``max_rows`` rows (stops counting beyond) and, written
    out as text, at most ``max_bytes`` bytes."""
    row = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(
        F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def salted_join(fact: DataFrame, dimension: DataFrame, fact_key: str, dimension_key: str,
                how: str = "left", salts: int = SALTS, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join a fact table to a dimension whose key may be hot (or null) in the fact.

    A dimension measured at ``max_rows`` rows and a few MB or less is broadcast. Beyond that, fact
    rows of one key spread over ``salts`` partitions and the dimension is repeated
    once per salt, which keeps a third-of-all-rows key (null included) off a single
    task. That join is asked for as a sort-merge join: Spark's size estimate leaves the
    repetition out, so it would collect a repeated dimension on the driver as a broadcast.
    """
    if is_small(dimension, max_rows):
        return fact.join(F.broadcast(dimension), F.col(fact_key) == F.col(dimension_key), how)
    salt = F.pmod(F.xxhash64(*fact.columns), F.lit(salts)).cast("int")
    left = fact.withColumn("_salt", salt)
    right = dimension.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    condition = (F.col(fact_key) == F.col(dimension_key)) & (F.col("_salt") == F.col("_dim_salt"))
    return left.join(right.hint("merge"), condition, how).drop("_salt", "_dim_salt")


def small_or_self(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df`` as a local table to be broadcast if its rows and bytes are small, else ``df``,
    which stays distributed and joins by shuffle. Only the plan differs.

    One job: at most ``max_rows`` + 1 rows come to the driver, cut off before that where they
    are beyond ``max_bytes`` as text, and a table that is small is not computed again.
    """
    size = F.octet_length(F.to_json(F.struct("*")))
    found = df.select(F.struct("*").alias("row"), size.alias("bytes")).limit(max_rows + 1)
    rows, total = [], 0
    for r in found.toLocalIterator():
        rows.append(r["row"])
        total += r["bytes"] or 0
        if len(rows) > max_rows or total > max_bytes:
            return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def along_customer(orders: DataFrame, add: Callable[[DataFrame, Window], DataFrame], depth: int,
                   customer: str = "CustomerId", time: str = "PlacedDateTime",
                   tie: str = "OrderNumber", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add columns that look at most ``depth`` rows back within a customer.

    ``add(df, window)`` gets the window to use. Ordinary customers are one window
    group. A customer with more than ``hot_rows`` rows is cut into one group per
    clock hour; only the first ``depth`` rows of each hour need rows from before
    it, and those are recomputed from the hours' edge rows alone. The list of hot
    customers holds at most rows / hot_rows keys, which bounds its broadcast.
    """
    order = [F.col(time).asc_nulls_last(), F.col(tie).asc_nulls_last()]
    hot = (
        orders.groupBy(customer).agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_rows).select(customer, F.lit(True).alias("_hot"))
    )
    whole = Window.partitionBy(customer).orderBy(*order)
    if not hot.limit(1).count():
        return add(orders, whole)
    # Orders without a time come last; they are cut by order number instead.
    hour = F.coalesce(F.date_trunc("HOUR", F.col(time)), F.timestamp_seconds(
        F.lit(253_370_764_800) + F.coalesce(F.floor(F.col(tie) / max(1, hot_rows)), F.lit(0))))
    in_hour = Window.partitionBy(customer, "_hour").orderBy(*order)

    marked = orders.join(F.broadcast(hot), customer, "left").withColumn(
        "_hour", F.when(F.col("_hot"), hour)
    )
    body = (
        add(marked, in_hour).withColumn("_place", F.row_number().over(in_hour))
        .filter(F.col("_hot").isNull() | (F.col("_place") > depth))
    )
    backwards = Window.partitionBy(customer, "_hour").orderBy(
        F.col(time).desc_nulls_first(), F.col(tie).desc_nulls_first())
    edges = (
        orders.join(F.broadcast(hot), customer, "inner").withColumn("_hour", hour)
        .withColumn("_place", F.row_number().over(in_hour))
        .withColumn("_left", F.row_number().over(backwards))
        .filter((F.col("_place") <= depth) | (F.col("_left") <= depth))
    )
    heads = add(edges, whole).filter(F.col("_place") <= depth).drop("_left")
    helpers = ["_hot", "_hour", "_place"]
    return body.drop(*helpers).unionByName(heads.drop(*helpers))


def row_order(time: str = "PlacedDateTime", tie: str = "OrderNumber") -> Column:
    """Sort key of a customer's orders as one value: unknown times last, ties by id."""
    return F.struct(F.col(time).isNull(), F.col(time), F.col(tie))
