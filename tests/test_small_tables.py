"""Tables of unknown size: computed once, bounded on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronly.functions.quantiles import running_totals
from patronly.functions.skew import small_or_self
from patronly.operators import features as fe


def counted(spark, rows):
    """A table that counts how often each of its rows is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def note(x):
        seen.add(1)
        return x

    return spark.range(rows, numPartitions=3).select(note.asNondeterministic()("id").alias("x")), seen


def test_a_small_table_is_computed_once(spark):
    df, seen = counted(spark, 60)
    small = small_or_self(df)
    assert sorted(r["x"] for r in small.collect()) == list(range(60)) and seen.value == 60


@pytest.mark.parametrize("rows,size", [(5, 1 << 20), (1000, 100)])
def test_a_large_table_stays_where_it_is(spark, rows, size):
    df = spark.range(60).withColumnRenamed("id", "x")
    assert small_or_self(df, rows, size) is df


def test_one_hot_stops_at_too_many_levels(spark):
    df = spark.range(30).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    assert len(fe.one_hot_drop_first(df, ["c"], most=30).columns) == 29
    with pytest.raises(ValueError, match="more than 29 levels"):
        fe.one_hot_drop_first(df, ["c"], most=29)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_many_slices(spark, descending):
    rng = np.random.default_rng(1)
    values = [(float(x), int(n)) for x, n in zip(rng.permutation(500) / 7, rng.integers(0, 9, 500))]
    found = running_totals(spark.createDataFrame(values, "x double, n long").repartition(7), "x", ["n"], descending, slice_rows=11)
    total, expected = 0, {}
    for x, n in sorted(values, reverse=descending):
        total += n
        expected[x] = total
    assert {r["x"]: r["Upto_n"] for r in found.collect()} == expected and found.columns == ["x", "n", "Upto_n"]
    assert running_totals(spark.createDataFrame([], "x double, n long"), "x", ["n"]).count() == 0
