"""Consecutive numbers over a whole table, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def number_rows(df: DataFrame, order, name: str = "number", partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order of ``order`` (columns or sort expressions).

    The rows are range-partitioned and stored with their place inside the partition;
    the driver then adds up one row count per partition. Equal rows at a border get
    their numbers in any order, so end ``order`` with columns that tell rows apart
    where that matters.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the upper bits of this id are the partition, the lower 33 the place inside it
    stored = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()))
    slice_of = F.shiftright("_id", 33)
    counts = stored.groupBy(slice_of.alias("slice")).agg(F.count("*").alias("n")).orderBy("slice").collect()
    before, starts = 0, []
    for row in counts:
        starts += [F.lit(row["slice"]), F.lit(before)]
        before += row["n"]
    start = F.create_map(*starts)[slice_of] if starts else F.lit(0)
    return stored.withColumn(name, (start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_id")
