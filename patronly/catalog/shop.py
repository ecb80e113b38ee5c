"""The shop's tables over one test-data folder, built on demand for the queries."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import attribution, churn, cleaning, customers, orders, reports
from ..plans import flows
from ..session import materialize, prepare, shared_folder
from ..sources import shop_views as views


class Shop:
    """Lazily built tables; what several branches of a query read is stored once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def raw(self, name: str) -> DataFrame:
        return views.shop_table(self.spark, self.folder, name)

    def star(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def scratch(self) -> str:
        return shared_folder(self.spark)

    def file_state(self) -> tuple:
        """Name, time and size of what lies in the folder: changes when a table does."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
        return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files))

    @property
    def orders(self):
        return self.raw("raw_order")

    @property
    def items(self):
        return self.raw("raw_order_item")

    @property
    def products(self):
        return self.raw("raw_product_product_option")

    @property
    def clean(self):
        return cleaning.clean_orders(self.orders)

    @property
    def rollup(self):
        return orders.item_rollup(self.items, self.products, views.PRODUCT_WORDS)

    @property
    def features(self):
        return orders.order_features(self.orders, self.items, self.products, views.PRODUCT_WORDS)

    @cached_property
    def stored(self):
        """The order features as a stored table, as every later step reads them."""
        return materialize(self.features)

    @property
    def timed(self):
        """Clean orders with the columns that need no items."""
        return orders.add_order_columns(self.clean)

    @cached_property
    def summary(self):
        return customers.with_report_names(churn.customer_summary(self.stored))

    @cached_property
    def stored_summary(self):
        return materialize(self.summary)

    @cached_property
    def first_summary(self):
        return churn.customer_summary_n(self.stored, "first", 1)

    @cached_property
    def stored_first_summary(self):
        return materialize(self.first_summary)

    @property
    def product_rows(self):
        return reports.product_type_rows(self.stored_summary)

    @property
    def attribution(self):
        hot = attribution.one_hot_medium_source(self.raw("raw_order_and_analytics"))
        return attribution.order_attribution(
            attribution.join_campaigns(hot, self.raw("raw_ad_campaigns")))

    @property
    def first_values(self):
        return customers.first_order_values(self.clean)

    @property
    def repeat(self):
        return customers.repeat_orders(self.stored, customers.customer_aggregates(self.stored))

    @property
    def tree_table(self):
        return flows.tree_table(self.stored_first_summary, self.clean, self.rollup,
                                views.FIRST_ORDER_CUTOFF, {"PctOrdersWithLabel": 1.0})

    @property
    def prototype_table(self):
        return flows.prototype_table(self.stored_first_summary, self.clean, views.FIRST_ORDER_CUTOFF,
                                     {"PctOrdersWithLabel": 1.0})

    @property
    def cluster_table(self):
        return flows.cluster_table(self.stored_summary)

    def by_id(self, df: DataFrame, groups: int = 4) -> DataFrame:
        """A fixed cluster column in place of a model's, for checking cluster tables."""
        return df.withColumn("Cluster", (F.col("CustomerId") % groups).cast("int"))

    @property
    def scored(self):
        """Document labels with a hash score: input for the metrics."""
        from ..functions.columns import uniform

        return self.star("labels").select(
            F.col("quality").cast("int").alias("label"),
            (F.floor(uniform("doc_id", seed=7) * 100) / 100).alias("score"))
