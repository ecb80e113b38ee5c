"""Ad attribution per order and web-session attributes per transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import AD_INDICATORS, SESSION_ATTRIBUTES, TOP_MEDIUMS, TOP_SOURCES
from ..functions.skew import salted_join


def indicator_name(prefix: str, value: str) -> str:
    """``medium_none`` for ``(none)``: parentheses go, spaces and dashes become ``_``."""
    return f"{prefix}_" + value.translate(str.maketrans({" ": "_", "-": "_", "(": None, ")": None}))


def one_hot_medium_source(analytics: DataFrame, mediums=TOP_MEDIUMS, sources=TOP_SOURCES) -> DataFrame:
    """One 0/1 column per listed medium and source; a missing value matches none."""
    medium, source = F.coalesce("medium", F.lit("")), F.coalesce("source", F.lit(""))
    return analytics.withColumns({
        "medium": medium, "source": source,
        **{indicator_name("medium", m): (medium == m).cast("int") for m in mediums},
        **{indicator_name("source", s): (source == s).cast("int") for s in sources},
    })


def _id_text(column: str) -> Column:
    """Campaign ids as integer text, so ``7`` and ``7.0`` are one campaign."""
    return F.regexp_replace(F.trim(F.col(column).cast("string")), r"\.0+$", "")


def join_campaigns(analytics: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Analytics rows with their campaign's columns; a null id matches nothing."""
    left = analytics.withColumn("AdwordsCampaignId", _id_text("AdwordsCampaignId"))
    right = campaigns.withColumn("AdCampaignId", _id_text("AdCampaignId"))
    return salted_join(left, right, "AdwordsCampaignId", "AdCampaignId", "left")


def order_attribution(joined: DataFrame) -> DataFrame:
    """Distinct (order id, indicator columns, campaign columns) rows, id as a number."""
    kept = [
        c for c in joined.columns
        if c.startswith(("medium_", "source_"))
        or (c.startswith("Ad") and not c.startswith("Add") and c != "AdwordsCampaignId")
    ]
    return joined.select(F.col("OrderNumber").try_cast("bigint").alias("OrderNumber"), *kept).distinct()


def indicator_columns(attribution: DataFrame) -> list[str]:
    return [c for c in attribution.columns
            if c in AD_INDICATORS or c.startswith(("medium_", "source_"))]


def attach_attribution(orders: DataFrame, attribution: DataFrame, mode: str = "fanout") -> DataFrame:
    """Orders with their attribution.

    ``fanout`` repeats an order per attribution row; ``max`` keeps one row per
    order, with each indicator on if any row has it on.
    """
    known = attribution.filter(F.col("OrderNumber").isNotNull())
    if mode == "max":
        known = known.groupBy("OrderNumber").agg(
            *[F.max(c).alias(c) for c in indicator_columns(attribution)])
    elif mode != "fanout":
        raise ValueError(f"unknown mode {mode!r}")
    return orders.join(known, "OrderNumber", "left")


def customer_attribution_pct(order_rows: DataFrame) -> DataFrame:
    """Mean of every order flag and attribution indicator per customer, as ``Pct…``."""
    flags = ["WorkHours", "Workday", "OrderContainsSticker", "OrderContainsLabel",
             "OrderContainsPouch", *indicator_columns(order_rows)]
    return order_rows.filter(F.col("CustomerId").isNotNull()).groupBy("CustomerId").agg(
        *[F.avg(F.col(c).cast("int")).alias(f"Pct{c}") for c in flags])


# ---------------------------------------------------------------- web sessions
def _most_common(events: DataFrame, key: str, attributes, valid=None) -> DataFrame:
    """Most common value of each attribute per key; ties give the smallest value.

    Events with the same key and values are counted first, then values in long form, so
    a key holding a large part of the events is summed up on the map side before its rows
    multiply, and no per-key value set has to fit in one aggregate.
    """
    counts = events.filter(F.col(key).isNotNull()).groupBy(key, *attributes).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("attribute"), F.col(a).alias("value"))
        for i, a in enumerate(attributes)
    ]))
    counted = (
        counts.select(key, "_n", pairs.alias("p"))
        .groupBy(key, "p.attribute", "p.value").agg(F.sum("_n").alias("n"))
    )
    usable = F.col("value").isNotNull()
    if valid is not None:
        usable = usable & valid(F.col("value"))
    best = F.min(F.when(usable, F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value"))))
    ranked = counted.groupBy(key, "attribute").agg(best["value"].alias("value"))
    return ranked.groupBy(key).agg(*[
        F.max(F.when(F.col("attribute") == i, F.col("value"))).alias(a)
        for i, a in enumerate(attributes)
    ])


def collapse_sessions(events: DataFrame, key: str = "param_transaction_id",
                      attributes=SESSION_ATTRIBUTES) -> DataFrame:
    """One row per transaction with the most common value of each attribute."""
    return _most_common(events, key, attributes)


def collapse_sessions_strict(events: DataFrame, key: str = "param_transaction_id",
                             attributes=SESSION_ATTRIBUTES) -> DataFrame:
    """As above, with empty text and any spelling of ``none`` left out."""
    return _most_common(events, key, attributes, lambda v: ~F.lower(v).isin("none", ""))


def first_order_sessions(first_orders: DataFrame, sessions: DataFrame) -> DataFrame:
    """First orders with the session attributes of the order's transaction."""
    return first_orders.withColumn("OrderNumber_str", F.col("OrderNumber").cast("string")).join(
        sessions.withColumnRenamed("param_transaction_id", "param_transaction_id_str"),
        F.col("OrderNumber_str") == F.col("param_transaction_id_str"), "left")


def sessions_with_label(order_sessions: DataFrame, summary: DataFrame,
                        label: str = "OneAndDone") -> DataFrame:
    """Keep exactly the summary's customers, with their label as 0/1."""
    return order_sessions.join(
        summary.select("CustomerId", F.col(label).cast("int").alias(label)), "CustomerId", "right")


def semi_filter_events(events: DataFrame, first_orders: DataFrame) -> DataFrame:
    """Events whose transaction is one of the given orders."""
    known = first_orders.select(F.col("OrderNumber").cast("string").alias("_known"))
    return events.join(known, F.col("param_transaction_id") == F.col("_known"), "left_semi")


def churn_crosstab(df: DataFrame, attributes=SESSION_ATTRIBUTES, label: str = "OneAndDone",
                   min_n: int = 500) -> DataFrame:
    """Per attribute value with at least ``min_n`` rows: share of each label value,
    row count and a chart label; highest churn share first."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("Attribute"), F.col(a).alias("Value")) for a in attributes]))
    share = F.avg(F.col(label).cast("double"))
    return (
        df.select(pairs.alias("p"), label).select("p.*", label)
        .filter(F.col("Value").isNotNull())
        .groupBy("Attribute", "Value")
        .agg(F.count(F.lit(1)).alias("N"), (F.lit(1.0) - share).alias("ShareRetained"),
             share.alias("ShareChurned"))
        .filter(F.col("N") >= min_n)
        .withColumn("Label", F.concat("Value", F.lit("\n(n="), F.col("N").cast("string"), F.lit(")")))
        .orderBy("Attribute", F.desc("ShareChurned"), "Value")
    )
