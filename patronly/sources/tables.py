"""Reading the raw tables and writing derived tables and reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..schemas import SCHEMAS
from ..session import prepare


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, once, at the boundary."""
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema
    ])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Check that the declared columns exist, pick them and give them their types."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return nan_to_null(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))


def read_tables(spark: SparkSession, folder: str, names=None) -> dict[str, DataFrame]:
    """Load raw tables from ``folder/<name>`` (Parquet) with their declared schemas."""
    prepare(spark)
    tables = {}
    for name in names or SCHEMAS:
        path = os.path.join(folder, name)
        tables[name] = conform(spark.read.parquet(path), SCHEMAS[name])
    return tables


def summary_name(side: str | None = None, n: int | None = None) -> str:
    """Table name of a customer summary: all orders, or the first/last ``n``."""
    if side is None:
        return "customer_summary"
    return f"customer_summary_{side}_order" if n == 1 else f"customer_summary_{side}_{n}_orders"


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> dict[str, str]:
    """Write each table to ``folder/<name>`` as Parquet; returns the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = os.path.join(folder, name)
        df.write.mode(mode).parquet(paths[name])
    return paths


def write_report_csv(df: DataFrame, path: str, split_by: str | None = None,
                     mode: str = "overwrite") -> str:
    """Write a report as one CSV file with a header; ``split_by`` gives one folder with one
    file per value. For reports, which are bounded (buckets, segments); order rows are
    exported as tables.
    """
    writer = df.coalesce(1).write.mode(mode).option("header", True)
    if split_by:
        writer = writer.partitionBy(split_by)
    writer.csv(path)
    return path
