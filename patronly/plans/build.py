"""From raw tables to the stored feature, label and summary tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..constants import AFFILIATE, PRODUCT_WORDS
from ..operators import churn, customers, orders, reports
from ..sources.tables import read_tables, summary_name, write_tables


def build_tables(spark: SparkSession, raw: dict[str, DataFrame], folder: str, words=PRODUCT_WORDS,
                 affiliate: int = AFFILIATE, subsets=(("first", 1), ("first", 2), ("last", 1)),
                 now=None) -> dict[str, str]:
    """Write the order features, churn labels, summaries and product rows.

    The written order features are what everything after reads, so the item join
    runs once, later passes read only their columns, and no plan grows.
    """
    stored = lambda name: spark.read.parquet(os.path.join(folder, name))
    features = orders.order_features(
        raw["raw_order"], raw["raw_order_item"], raw["raw_product_product_option"], words, affiliate)
    paths = write_tables({"order_feature_table": features}, folder)
    features = stored("order_feature_table")

    options = {} if now is None else {"now": now}
    paths |= write_tables({summary_name(): churn.customer_summary(features, **options)}, folder)
    summary = stored(summary_name())
    paths |= write_tables({"churn_save": summary.select(*churn.CHURN_COLUMNS)}, folder)

    for side, n in subsets:
        table = churn.customer_summary_n(features, side, n, summary)
        paths |= write_tables({summary_name(side, n): table}, folder)
    product_rows = reports.product_type_rows(customers.with_report_names(summary))
    paths |= write_tables({"product_type_df": product_rows}, folder)
    return paths


def build_from_folder(spark: SparkSession, raw_folder: str, folder: str, **options) -> dict[str, str]:
    return build_tables(spark, read_tables(spark, raw_folder), folder, **options)
