"""Exact quantiles and running totals without gathering a column in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .batches import ROWS
from .numbering import number_rows
from .skew import small_or_self

ACCURACY = 100_000


def exact_quantiles(df: DataFrame, columns: dict[str, list[float]], by=(),
                    accuracy: int = ACCURACY) -> DataFrame:
    """Interpolated quantiles, equal to sorting every value, per group and column.

    Returns rows (``by`` columns, ``feature``, ``p``, ``quantile``). First a sketch
    brackets each quantile between two values that surely enclose it; then one
    pass counts the rows below the bracket and the distinct values inside it; a bracket
    that should not hold its rank is an error, never a wrong number.
    Only the inside - about ``10 / accuracy`` of the rows, equal values counted
    once - is ordered. A group of up to ``accuracy`` rows is its own bracket.
    """
    by = list(by)
    # Covers the sketch's rank error (1 / accuracy) and the neighbouring rank.
    margin = 4.0 / accuracy
    asks = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = (
        df.select(*by, F.explode(asks).alias("a")).select(*by, "a.*")
        .filter(F.col("value").isNotNull())
    )
    probs = sorted({p for ps in columns.values() for p in ps})
    wanted = F.coalesce(*[
        F.when(F.col("feature") == c, F.array(*[F.lit(p) for p in ps])) for c, ps in columns.items()])
    ends = [min(1.0, max(0.0, p + s * margin)) for p in probs for s in (-1, 1)]
    sketch = long.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.percentile_approx("value", [float(e) for e in ends], accuracy).alias("e"))
    small = F.col("n") <= accuracy
    end = lambda i, whole: F.when(small, F.col(whole)).otherwise(F.element_at("e", i))
    brackets = sketch.withColumn("b", F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), end(2 * i + 1, "least").alias("low"),
                 end(2 * i + 2, "most").alias("high"))
        for i, p in enumerate(probs)
    ]))).select(*by, "feature", "n", "b.*").filter(F.array_contains(wanted, F.col("p")))
    keys = [*by, "feature", "p", "n"]
    if by:
        counts = _joined_counts(long, brackets, by)
    else:
        counts = _searched_counts(df, brackets.orderBy("feature", "p").collect())
    order = Window.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first())
    upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("p") * (F.col("n") - 1)
    floor, ceil = F.floor(place), F.ceil(place)
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    lower = F.max(F.when(holds(floor), F.col("value")))
    upper = F.max(F.when(holds(ceil), F.col("value")))
    picked = counts.withColumn("upto", upto).groupBy(*keys).agg(lower.alias("lo"), upper.alias("hi"))
    held = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    missed = F.raise_error(F.lit("a quantile lies outside its bracket: raise the accuracy")).cast("double")
    return picked.select(
        *by, "feature", "p",
        F.when(held, F.col("lo") + (F.col("hi") - F.col("lo")) * (place - floor)).otherwise(missed).alias("quantile"))


def _joined_counts(long: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """How often each distinct value inside a bracket occurs, and one row (value null) for
    all below it."""
    # One row per group, column and probability: groups are categories.
    brackets = small_or_self(brackets)
    keys = [*by, "feature", "p", "n"]
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*by, "feature"]]
    bounded = long.alias("l").join(brackets.alias("r"), on, "inner").select(
        *[F.col(f"r.{k}") for k in keys], "low", "high", "value").filter(F.col("value") <= F.col("high"))
    # Values below the bracket collapse into one row (value null) per key.
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    return bounded.groupBy(*keys, inside.alias("value")).agg(F.count(F.lit(1)).alias("c"))


def _searched_counts(df: DataFrame, brackets: list) -> DataFrame:
    """The same for a whole table, whose brackets (by column and probability) the driver
    knows: a value finds its brackets by binary search, so many ranks cost one pass without
    a join, and a value that lies in many brackets moves as one row."""
    features = sorted({r["feature"] for r in brackets})
    place = {f: [i for i, r in enumerate(brackets) if r["feature"] == f] for f in features}
    low, high = ({f: np.array([brackets[i][end] for i in place[f]]) for f in features} for end in ("low", "high"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = {f: np.zeros(len(place[f]) + 1, np.int64) for f in features}

        def inside(some: list) -> pa.RecordBatch:
            found = []
            for f, column in zip(features, pa.Table.from_batches(some).columns):
                value, n = np.unique(column.drop_null().to_numpy(), return_counts=True)
                # The brackets from first to before last hold a value, those from last on lie above it.
                first, last = np.searchsorted(high[f], value, "left"), np.searchsorted(low[f], value, "right")
                np.add.at(below[f], last, n)
                held = first < last
                found.append((first[held] + place[f][0], last[held] + place[f][0], value[held], n[held]))
            return pa.record_batch([np.concatenate(c) for c in zip(*found)], ["first", "last", "value", "c"])

        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                yield inside(kept)
                kept, size = [], 0
        if size:
            yield inside(kept)
        for f in features:
            at = np.array(place[f])
            yield pa.record_batch([at, at + 1, pa.nulls(len(at), pa.float64()), below[f].cumsum()[:-1]], ["first", "last", "value", "c"])

    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    counts = rows.mapInArrow(count, "first long, last long, value double, c long").groupBy("first", "last", "value").agg(F.sum("c").alias("c"))
    named = lambda c, kind: F.lit([r[c] for r in brackets]).cast(f"array<{kind}>")[F.col("i").cast("int")].alias(c)
    return counts.filter("c > 0").withColumn("i", F.explode(F.expr("sequence(first, last - 1)"))).select(
        named("feature", "string"), named("p", "double"), named("n", "long"), "value", "c")


def running_totals(df: DataFrame, order: str, columns: list[str],
                   descending: bool = False, slice_rows: int = 50_000) -> DataFrame:
    """Adds ``Upto_<column>``: the total of all rows up to and including this one in
    the order of a column with distinct values.

    Rows are numbered by that order and cut into slices of ``slice_rows``; each slice runs
    its own window and starts from the totals of the slices before it, which are one row
    per slice. Nothing but one count per partition reaches the driver.
    """
    numbered = number_rows(df, [F.desc(order) if descending else F.asc(order)], "_number")
    sliced = numbered.withColumn("_slice", F.floor(F.col("_number") / slice_rows))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(F.col("_slice").alias("_of")).agg(*[F.sum(c).alias(f"_{c}") for c in columns]).select(
        "_of", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("_slice").orderBy("_number").rowsBetween(Window.unboundedPreceding, 0)
    upto = sliced.withColumns({f"Upto_{c}": F.sum(c).over(inside) for c in columns})
    joined = upto.join(slices, F.col("_slice") == F.col("_of"))
    return joined.withColumns({f"Upto_{c}": F.col(f"Upto_{c}") + F.col(f"_{c}") for c in columns}).drop(
        "_number", "_slice", "_of", *[f"_{c}" for c in columns])
