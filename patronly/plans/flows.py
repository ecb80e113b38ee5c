"""Tables that models and clusterings start from, and the classifier end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import (
    attribution, cleaning, customers, features, metrics, models, orders, warning,
)
from ..session import materialize

# Features of the tree and the mixed clusterings.
TREE_NUMERIC = ["AvgOrderItemTotal", "AvgItemsPerOrder", "AvgRushFeeAndShipPrice"]
TREE_CATEGORICAL = ["HasPromoDiscount", "ShippingType"]
MIXED_NUMERIC = ["AvgOrderValue", "AvgPromoDiscount", "AvgItemsPerOrder"]
MIXED_CATEGORICAL = ["ShippingType", "WorkHours", "OrderContainsLabel"]
SEASON_FLAGS = ["WorkHours", "Holiday", "Summer", "ElectionSeason", "PresidentialElection"]
SESSION_FEATURES = ["PctWorkday", "traffic_source_medium", "device_category"]
CLUSTER_FEATURES = ["TotalOrders", "AvgOrderValue", "AvgPromoDiscount", "PctNormalShipping"]
SCALE_FEATURES = ["TotalOrders", "AvgOrderValue", "AvgPromoDiscount"]
PCA_EXCLUDE = ["LikelyChurned", "AvgRushFeeAndShipPrice", "PctNormalShipping", "MeanDaysBetweenOrders"]


def tree_table(first_summary: DataFrame, clean: DataFrame, rollup: DataFrame, cutoff: str,
               mask: dict | None) -> DataFrame:
    """One row per new customer bought in a family: label and tree features."""
    flagged = customers.first_order_flags(first_summary, customers.first_order_values(clean), rollup)
    chosen = cleaning.mask_filter(cleaning.since_cutoff(flagged, cutoff), mask)
    rows = features.has_promo(chosen).select("CustomerId", "OneAndDone", *TREE_NUMERIC, *TREE_CATEGORICAL)
    return rows.dropna()


def prototype_table(first_summary: DataFrame, clean: DataFrame, cutoff: str,
                    mask: dict | None) -> DataFrame:
    """As the tree table, with the four-way shipping label."""
    first = orders.shipping_type_uncategorized(customers.first_order_values(clean))
    joined = features.has_promo(first_summary).join(
        first.select("CustomerId", "ShippingType"), "CustomerId", "left")
    chosen = cleaning.mask_filter(cleaning.since_cutoff(joined, cutoff), mask)
    return chosen.select("CustomerId", "OneAndDone", *TREE_NUMERIC, *TREE_CATEGORICAL).dropna()


def mixed_table(first_summary: DataFrame, order_features: DataFrame) -> DataFrame:
    """First-order summary with the first shipped order's own columns."""
    shipped = customers.first_shipped_order(order_features)
    named = customers.with_report_names(first_summary)
    return orders.shipping_simple(named.join(shipped, "CustomerId", "left"))


def session_table(first_summary: DataFrame, clean: DataFrame, events: DataFrame, cutoff: str,
                  mask: dict | None) -> DataFrame:
    """New customers with their first order's web session; incomplete rows drop out."""
    first = orders.shipping_type_uncategorized(customers.first_order_values(clean))
    sessions = attribution.collapse_sessions_strict(events)
    # Spark takes compressed files or shuffles for the size of a table, so both joins would broadcast one row per customer.
    joined = first_summary.join(
        attribution.first_order_sessions(first, sessions.hint("merge")).select(
            "CustomerId", "traffic_source_medium", "device_category").hint("merge"), "CustomerId", "left")
    chosen = cleaning.mask_filter(cleaning.since_cutoff(joined, cutoff), mask)
    return chosen.select("CustomerId", "OneAndDone", *SESSION_FEATURES).dropna()


def customer_summary_attribution(summary: DataFrame, order_features: DataFrame, order_attribution: DataFrame,
                                 mode: str = "fanout") -> DataFrame:
    """The customer summary with the share of orders per flag and ad indicator. ``fanout``
    weighs an order by its attribution rows, ``max`` counts it once."""
    shares = attribution.customer_attribution_pct(
        attribution.attach_attribution(order_features, order_attribution, mode))
    new = [c for c in shares.columns if c == "CustomerId" or c not in summary.columns]
    return summary.join(shares.select(*new), "CustomerId", "left")


def predict_classifier(table: DataFrame, target: str, **options) -> dict:
    """Boosted trees on one of the prediction tables (key, target, features)."""
    columns = [c for c in table.columns if c not in ("CustomerId", target)]
    return classifier(table, target, columns, **{"threshold": 0.5, **options})


def cluster_table(summary: DataFrame) -> DataFrame:
    """All customers with the numeric columns clusterings and linear models use."""
    named = customers.with_report_names(summary)
    capped = features.clip(named, {"DaysSinceLastOrder": (None, 90), "MeanDaysBetweenOrders": (None, 90)})
    return features.abs_discount(capped).select("CustomerId", "LikelyChurned", *CLUSTER_FEATURES)


def pca_table(summary: DataFrame) -> DataFrame:
    """All numeric customer columns with day counts capped."""
    spread = summary.withColumn("AvgDaysBetweenOrders", F.col("StdDaysBetweenOrders"))
    capped = features.clip(spread, {"DaysSinceLastOrder": (None, 90), "AvgDaysBetweenOrders": (None, 90)})
    return features.numeric_features(capped, PCA_EXCLUDE)


def classifier(table: DataFrame, label: str, columns, categorical=(), weighted: bool = True,
               threshold: float = 0.45, trees: int = 100, seed: int = 42, fraction: float = 0.2) -> dict:
    """Encode, split by class, weight, boost, score and evaluate; returns model and tables."""
    encoded = features.label_encode(table.select("CustomerId", label, *columns), categorical)
    split = materialize(features.stratified_split(encoded, label, fraction, seed))
    train, test = split.filter(~F.col("IsTest")), split.filter("IsTest")
    weight = "Weight" if weighted else None
    model = models.boosted_churn(features.class_weights(train, label), columns, label, weight=weight,
                                 trees=trees, seed=seed)
    scored = metrics.threshold_predict(models.score(model, test, columns, label), threshold)
    return {
        "model": model, "train": train, "test": test, "scored": scored,
        "confusion": metrics.confusion_matrix(scored), "report": metrics.classification_report(scored),
        "curve": metrics.pr_curve(scored), "auc": metrics.roc_auc(scored),
        "importance": models.feature_importance(model, columns, table.sparkSession),
    }


def one_and_done_classifier(sessions: DataFrame, **options) -> dict:
    """One-and-done from the web session of the first order. The sessions are stored first:
    encoding reads them several times for each column."""
    return classifier(materialize(sessions), "OneAndDone", SESSION_FEATURES, SESSION_FEATURES, **options)


def first_order_classifier(mixed: DataFrame, **options) -> dict:
    """One-and-done from the first order's own values, unweighted, cut at one half."""
    categorical = ["ShippingType", *SEASON_FLAGS]
    columns = ["AvgOrderValue", "AvgPromoDiscount", "AvgQuantity", *categorical]
    rows = features.drop_incomplete(features.abs_discount(mixed), ["OneAndDone", *columns])
    return classifier(rows, "OneAndDone", columns, categorical, weighted=False,
                      **{"threshold": 0.5, **options})


def warning_classifier(warnings: DataFrame, **options) -> dict:
    """Churn from the newest order's deviations, unknown ones read as 0."""
    columns = list(warning.DEVIATIONS)
    return classifier(features.fill_zero(warnings, columns), "LikelyChurned", columns,
                      **{"threshold": 0.5, **options})


def mixed_prototypes(mixed: DataFrame) -> DataFrame:
    """First-order rows for mixed clustering: raw values kept, scaled copies as ``Scaled_…``."""
    rows = features.drop_incomplete(
        features.abs_discount(mixed), ["OneAndDone", *MIXED_NUMERIC, *MIXED_CATEGORICAL])
    rows = rows.select("CustomerId", "OneAndDone", *MIXED_NUMERIC, *MIXED_CATEGORICAL)
    scaled = [f"Scaled_{c}" for c in MIXED_NUMERIC]
    return features.minmax_scale(
        rows.withColumns({n: F.col(c) for n, c in zip(scaled, MIXED_NUMERIC)}), scaled)
