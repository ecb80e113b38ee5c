"""Joins along time: the last event before an order, windows that hold an order, visits
grouped by pauses.

A key (a customer, a visitor) may own a third of all rows, so no operator here needs a
key's rows in one task: time is cut into slices, windows run inside (key, slice), and
what a slice has to know of the ones before it travels as one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quantiles import running_totals

SLICE = "HOUR"   # unit of time in which one key's rows may meet in a task
DAY_MICROS = 86_400_000_000


def _slice_of(time: Column, unit: str) -> Column:
    return F.date_trunc(unit, time)


def carried_before(rows: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """(keys, _slice, ``name``): the last ``value`` (in the order of ``value``, which starts with
    a time) of all slices of a key before this one, for each slice of ``rows``.

    Rows are first reduced to one per (key, slice), with a map-side combine.
    """
    last = rows.groupBy(*keys, "_slice").agg(F.max(value).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return last.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias(name))


def last_before(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str],
                tie: str, within: str | None = None, unit: str = SLICE) -> DataFrame:
    """Rows of ``left``, each with ``right_time`` and ``columns`` of the last row of ``right`` of
    the same key whose time is not later (an as-of join).

    Of equal times the row with the largest ``tie`` counts. With ``within`` (an interval such
    as ``30 days``) older rows count as none. Rows of ``left`` without key or time, or
    without an earlier row, get nulls; rows of ``right`` without key or time are ignored.
    Columns of ``right`` must not be named as columns of ``left``.
    """
    order = [right_time, tie, *[c for c in columns if c != tie]]
    event = F.struct(*order)
    visits = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        key, _slice_of(F.col(right_time), unit).alias("_slice"), F.col(right_time).alias("_at"), F.lit(0).alias("_kind"), event.alias("_event"))
    asked = left.filter(F.col(key).isNotNull() & F.col(left_time).isNotNull())
    rest = left.filter(F.col(key).isNull() | F.col(left_time).isNull())
    orders = asked.select(key, _slice_of(F.col(left_time), unit).alias("_slice"), F.col(left_time).alias("_at"), F.lit(1).alias("_kind"),
                          F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    both = orders.unionByName(visits, allowMissingColumns=True)
    inside = Window.partitionBy(key, "_slice").orderBy("_at", "_kind", F.col("_event")[tie]).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_here", F.last("_event", ignorenulls=True).over(inside)).filter("_kind = 1")
    before = carried_before(both, [key], F.col("_event"), "_before").withColumnRenamed(key, "_key").withColumnRenamed("_slice", "_of")
    found = seen.join(before, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_of")), "left").select(
        "_row", "_at", F.coalesce("_here", "_before").alias("_event"))
    if within:
        recent = F.col(f"_event.{right_time}") >= F.col("_at") - F.expr(f"interval {within}")
        found = found.withColumn("_event", F.when(recent, F.col("_event")))
    taken = [right_time, *[c for c in columns if c != right_time]]
    done = found.select("_row.*", *[F.col(f"_event.{c}").alias(c) for c in taken])
    types = dict(right.dtypes)
    return done.unionByName(rest.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in taken]))


def attributed_orders(orders: DataFrame, sessions: DataFrame, visits: DataFrame, attributes: Sequence[str],
                      within: str = "30 days") -> DataFrame:
    """Orders with web attributes: those of the order's own transaction if it has any, else
    those of the customer's last visit of the time before. ``AttributedBy`` says which:
    ``transaction``, ``visit`` or ``none``."""
    own = sessions.select(F.col("param_transaction_id").alias("_transaction"), *[F.col(a).alias(f"_own_{a}") for a in attributes])
    seen = last_before(orders, visits, "CustomerId", "PlacedDateTime", "VisitedAt", [*attributes, "VisitId"], "VisitId", within)
    joined = seen.join(own, F.col("OrderNumber").cast("string") == F.col("_transaction"), "left")
    has = F.col("_transaction").isNotNull()
    by = F.when(has, "transaction").when(F.col("VisitId").isNotNull(), "visit").otherwise("none")
    return joined.select(*orders.columns, by.alias("AttributedBy"),
                         *[F.when(has, F.col(f"_own_{a}")).otherwise(F.col(a)).alias(a) for a in attributes])


# ---------------------------------------------------------------- windows of time
def in_windows(rows: DataFrame, windows: DataFrame, time: str, start: str, end: str, bucket_days: int | None = None) -> DataFrame:
    """Every pair of a row and a window that holds its time, start and end included.

    Time is cut into buckets; a window is repeated once per bucket it meets and a row stands
    in one bucket, so Spark joins on the bucket's number (and splits a bucket that is hot)
    and never compares all rows with all windows. Buckets are as wide as the mean window,
    so windows give few rows each, however many there are. Rows without a time, windows
    without an end or with an end before their start, pair with nothing. Column names of the
    two tables must differ.
    """
    good = windows.filter(F.col(start) <= F.col(end))
    if bucket_days is None:
        mean = good.agg(F.avg(F.unix_micros(end) - F.unix_micros(start))).first()[0] or 0
        bucket_days = max(1, round(mean / DAY_MICROS))
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(bucket_days * DAY_MICROS))
    spread = good.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    placed = rows.withColumn("_own", bucket(F.col(time)))
    met = placed.join(spread, F.col("_own") == F.col("_bucket"))
    return met.filter(F.col(time).between(F.col(start), F.col(end))).drop("_own", "_bucket")


def _blocks_of(lo: Column, hi: Column, levels: int) -> Column:
    """The blocks of 2^level pieces that make up the pieces lo to hi - 1: at most two a level."""
    blocks = []
    for level in range(levels):
        first, after = F.shiftright(lo + F.lit((1 << level) - 1), level), F.shiftright(hi, level)
        taken = lambda edge, block: F.when(
            (first < after) & (edge % 2 == 1), F.struct(F.lit(level).alias("level"), block.alias("block")))
        blocks += [taken(first, first), taken(after, after - 1)]
    return F.array_compact(F.array(*blocks))


def window_totals(rows: DataFrame, windows: DataFrame, time: str, start: str, end: str, window_id: str, amount: str) -> DataFrame:
    """Per window: rows inside and their amount; windows without any row have zeros.

    The windows' ends cut time into pieces. A row falls into one piece and a window is a run
    of pieces, so totals go up from pieces to blocks of 2, 4, 8, ... pieces, of which a window
    adds up at most two of each size. Rows and windows are never paired, and no total is
    subtracted from another.
    """
    good = windows.filter(F.col(start) <= F.col(end)).select(
        window_id, F.unix_micros(start).alias("_from"), (F.unix_micros(end) + 1).alias("_until"))
    times = rows.filter(F.col(time).isNotNull()).groupBy(F.unix_micros(time).alias("_at")).agg(
        F.count("*").alias("_rows"), F.sum(amount).alias("_amount"))
    cuts = good.select(F.explode(F.array("_from", "_until")).alias("_at")).withColumn("_cut", F.lit(1))
    marks = times.unionByName(cuts, allowMissingColumns=True).groupBy("_at").agg(
        F.sum("_rows").alias("_rows"), F.sum("_amount").alias("_amount"), F.coalesce(F.max("_cut"), F.lit(0)).alias("_cut"))
    placed = running_totals(marks, "_at", ["_cut"]).withColumnRenamed("Upto__cut", "_piece")
    levels = max(1, (placed.agg(F.max("_piece")).first()[0] or 0).bit_length())

    pieces = placed.filter(F.col("_rows") > 0).groupBy("_piece").agg(F.sum("_rows").alias("_rows"), F.sum("_amount").alias("_amount"))
    blocks = pieces.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).groupBy(
        "level", F.expr("shiftright(_piece, level)").alias("block")).agg(F.sum("_rows").alias("_rows"), F.sum("_amount").alias("_amount"))
    number = lambda at, name: placed.filter("_cut = 1").select(F.col("_at").alias(at), F.col("_piece").alias(name))
    needed = good.join(number("_from", "_lo"), "_from").join(number("_until", "_hi"), "_until").select(
        window_id, F.explode(_blocks_of(F.col("_lo"), F.col("_hi"), levels)).alias("_b")).select(window_id, "_b.*")
    # Spark's size estimate leaves the exploded blocks out, so no side may become a broadcast.
    sums = needed.hint("merge").join(blocks.hint("merge"), ["level", "block"]).groupBy(F.col(window_id).alias("_id")).agg(
        F.sum("_rows").alias("Rows"), F.sum("_amount").alias("Amount"))
    return windows.join(sums, F.col(window_id) == F.col("_id"), "left").select(
        window_id, start, end, F.coalesce("Rows", F.lit(0)).cast("long").alias("Rows"), F.coalesce("Amount", F.lit(0.0)).alias("Amount"))


# ---------------------------------------------------------------- visits by pauses
def with_visit_start(events: DataFrame, key: str, time: str, tie: str, pause: str = "30 minutes", unit: str = SLICE) -> DataFrame:
    """Adds VisitStart: the time of the event that began the visit. A visit goes on as long as
    each event follows the one before it within ``pause``. Events without key or time are left
    out."""
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_slice", _slice_of(F.col(time), unit))
    inside = Window.partitionBy(key, "_slice").orderBy(time, tie)
    before = carried_before(rows, [key], F.struct(F.col(time).alias("at")), "_before").withColumnRenamed(key, "_key").withColumnRenamed("_slice", "_of")
    lagged = rows.withColumn("_lag", F.lag(time).over(inside)).join(
        before, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_of")), "left").drop("_key", "_of")
    previous = F.coalesce("_lag", F.col("_before.at"))
    begins = previous.isNull() | (F.col(time) > previous + F.expr(f"interval {pause}"))
    marked = lagged.withColumn("_start", F.when(begins, F.col(time))).drop("_lag", "_before")
    started = carried_before(
        marked, [key], F.when(F.col("_start").isNotNull(), F.struct(F.col("_start").alias("at"))), "_earlier").withColumnRenamed(key, "_key").withColumnRenamed("_slice", "_of")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    here = marked.withColumn("_here", F.last("_start", ignorenulls=True).over(upto)).join(
        started, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_of")), "left")
    return here.select(*events.columns, F.coalesce("_here", F.col("_earlier.at")).alias("VisitStart"))


def visits_by_pause(events: DataFrame, key: str, time: str, tie: str, value: str, pause: str = "30 minutes") -> DataFrame:
    """One row per visit: key, VisitStart, VisitEnd, Events, Seconds and the sum of ``value``."""
    marked = with_visit_start(events, key, time, tie, pause)
    return marked.groupBy(key, "VisitStart").agg(
        F.max(time).alias("VisitEnd"), F.count("*").alias("Events"), F.sum(value).alias("Total")).select(
        key, "VisitStart", "VisitEnd", "Events",
        ((F.unix_micros("VisitEnd") - F.unix_micros("VisitStart")) / 1_000_000).alias("Seconds"), "Total")
