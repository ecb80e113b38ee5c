"""Streaming early warnings and overdue alerts: orders in, signals out.

Customers are dealt into buckets by a hash, so that one call handles many customers. Orders
wait in their bucket's state until the watermark has passed them and are then taken in time
order, whatever order or trigger they came in. Waiting orders are many small entries of a
map, by span of time and chunk: few orders of a month wait together, many go by day, very
many by hour. A trigger adds entries and takes away those that are due; of the rest it only
rewrites the spans the watermark stands in, so a customer with very many orders is handled
hour by hour. What is known of a customer is an entry of its own. Orders later than the lateness are dropped. To flush a finite
input, end it with ``clock_row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import ACTIVE_DAYS, CADENCE_FACTOR
from ..functions.batches import joined_batches
from ..operators.warning import DEVIATIONS, FLAG_RULES, deviation, warning_flags

LATENESS = "30 days"
_DAY = 86_400_000_000
ORDER_INPUT = ["CustomerId", "OrderNumber", "PlacedDateTime", "OrderItemPriceTotal",
               "RushFeeAndShipPrice", "PromoCodeDiscount"]


def read_order_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Orders arriving as Parquet files of the order feature table."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


# Orders of a known customer and time, and the row that only moves the clock.
_USEFUL = "PlacedDateTime is not null and (CustomerId is not null or OrderNumber is null)"


def clock_row(orders: DataFrame, lateness: str) -> DataFrame:
    """A row without a customer, ``lateness`` and a second after the newest order: it only moves the
    watermark up to that order, so that a finite input is emitted to its end."""
    moved = orders.agg(F.max("PlacedDateTime").alias("at")).select(
        (F.col("at") + F.expr(f"interval {lateness}") + F.expr("interval 1 second")).alias("at"))
    return moved.select(*[
        (F.col("at") if f.name == "PlacedDateTime" else F.lit(None)).cast(f.dataType).alias(f.name) for f in orders.schema])


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


_HOUR = 3_600_000_000
SPANS = (32 * _DAY, _DAY, _HOUR)  # orders of one span wait together: the first that holds a chunk of them at most
BUCKETS = 256  # groups of customers; as the state is kept by bucket, a stream keeps the number it began with
NOBODY = -2 ** 63  # the customer of the row that only moves the clock
CHUNK = 1_000  # waiting orders of one state entry at most
VALUES = ["OrderItemPriceTotal", "RushFeeAndShipPrice", "PromoCodeDiscount"]


def keep_state_on_disk(spark: SparkSession) -> None:
    """Map state and timers need the disk-backed state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _keyed(orders: DataFrame, columns: list[str], lateness: str, buckets: int):
    """The useful rows by bucket of customers; the clock's row has no customer and no null number."""
    rows = orders.filter(_USEFUL).select(*columns).withColumns({
        "CustomerId": F.coalesce("CustomerId", F.lit(NOBODY)), "OrderNumber": F.coalesce("OrderNumber", F.lit(-1))})
    dealt = rows.withColumn("Bucket", F.pmod(F.xxhash64("CustomerId"), F.lit(buckets)))
    return dealt.withWatermark("PlacedDateTime", lateness).groupBy("Bucket")


class Waiting:
    """Waiting orders as state entries: ``orders`` by (slot, chunk), and per slot in ``hours``
    the number of its chunks and its earliest order. A slot is a span of time; ``spans`` are
    the lengths it may have, longest first. ``values`` are float columns, ``keys`` whole
    numbers next to time and number."""

    def __init__(self, handle: StatefulProcessorHandle, values: list[str], keys: list[str] = [], spans: tuple = (_HOUR,), name: str = ""):
        self.values, self.spans, self.whole = values, spans, ["at", "number", *keys]
        self.hours = handle.getMapState(f"{name}hours", "slot long", "chunks int, least long")
        self.orders = handle.getMapState(f"{name}orders", "slot long, chunk int", ", ".join([
            *(f"w{i} array<long>" for i in range(len(self.whole))), *(f"v{i} array<double>" for i in range(len(values)))]))

    def add(self, rows: pd.DataFrame) -> None:
        """Rows (at, number, keys, values) wait from now on; what waits already is not read."""
        for level, span in enumerate(self.spans):
            start, dense = rows["at"] // span, []
            for at, part in rows.groupby(start):
                if len(part) > CHUNK and level < len(self.spans) - 1:
                    dense.append(part)
                else:
                    self._put(int(at) * span // _HOUR * len(self.spans) + level, part)
            if not dense:
                return
            rows = pd.concat(dense)

    def _put(self, slot: int, part: pd.DataFrame) -> None:
        chunks, least = self.hours.getValue((slot,)) if self.hours.containsKey((slot,)) else (0, 2 ** 62)
        for start in range(0, len(part), CHUNK):
            piece = part.iloc[start:start + CHUNK]
            self.orders.updateValue((slot, chunks), (
                *[piece[c].astype("int64").tolist() for c in self.whole], *[piece[c].astype("float64").tolist() for c in self.values]))
            chunks += 1
        self.hours.updateValue((slot,), (chunks, min(least, int(part["at"].min()))))

    def take(self, until: int) -> Iterator[pd.DataFrame]:
        """The orders before ``until`` in order of (time, number), one frame per span of time."""
        columns = [*self.whole, *self.values]
        due = sorted((k[0] // len(self.spans), k[0], v[0]) for k, v in self.hours.iterator() if v[1] < until)
        held = None
        for i, (hour, slot, chunks) in enumerate(due):
            parts = [] if held is None else [held]
            for chunk in range(chunks):
                parts.append(pd.DataFrame(dict(zip(columns, self.orders.getValue((slot, chunk))))))
                self.orders.removeKey((slot, chunk))
            self.hours.removeKey((slot,))
            held = pd.concat(parts, ignore_index=True)
            # Nothing in the slots to come is earlier than the next one's start.
            end = min(until, due[i + 1][0] * _HOUR) if i + 1 < len(due) else until
            ready = held["at"] < end
            if ready.any():
                yield held[ready].sort_values(["at", "number"], kind="stable", ignore_index=True)
                held = held[~ready]
        if held is not None and len(held):
            self.add(held)

    def earliest(self) -> int | None:
        return min((v[1] for _, v in self.hours.iterator()), default=None)


class Known:
    """State by customer, read when a customer's order is due and written at the end of a call
    or after ``most`` customers."""

    def __init__(self, state, nothing: tuple, most: int = 50_000):
        self.state, self.nothing, self.most, self.seen, self.changed = state, nothing, most, {}, set()

    def get(self, customer: int) -> tuple:
        if customer not in self.seen:
            if len(self.seen) >= self.most:
                self.store()
            self.seen[customer] = tuple(self.state.getValue((customer,))) if self.state.containsKey((customer,)) else self.nothing
        return self.seen[customer]

    def set(self, customer: int, value: tuple) -> None:
        self.seen[customer] = value
        self.changed.add(customer)

    def store(self) -> None:
        for customer in self.changed:
            self.state.updateValue((customer,), self.seen[customer])
        self.seen, self.changed = {}, set()


class InOrder(StatefulProcessor):
    """Takes a bucket's orders in time order once the watermark has passed them.

    Subclasses name their value columns, hold their own state by customer and say what to emit
    for a frame of orders (``follow``) and when the clock stands at ``now`` (``quiet``, which
    also gives the next time they want to be called).
    """

    values: list[str] = []
    known: Known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle, self.values, ["customer"], SPANS)
        self.closed = handle.getValueState("closed", "at long")

    def follow(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def quiet(self, now: int) -> tuple[list[pd.DataFrame], int | None]:
        return [], None

    def _advance(self, now: int) -> Iterator[pd.DataFrame]:
        for rows in self.waiting.take(now):
            yield from self.follow(rows)
        found, wake = self.quiet(now)
        yield from found
        self.known.store()
        self.closed.update((now,))
        times = [t for t in (self.waiting.earliest(), wake) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times) // 1000 + 1, now // 1000 + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, closed = timerValues.getCurrentWatermarkInMs() * 1000, self.closed.get()[0] if self.closed.exists() else 0
        for batch in joined_batches(rows):
            new = batch.assign(at=_micros(batch["PlacedDateTime"]), number=batch["OrderNumber"], customer=batch["CustomerId"])
            self.waiting.add(new.loc[(new["at"] >= closed) & (new["customer"] != NOBODY), ["at", "number", "customer", *self.values]])
        yield from self._advance(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


class Follow(InOrder):
    """Every order with the one before it; the state keeps a customer's last two orders taken."""

    values = VALUES

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = Known(handle.getMapState("last", "customer long", "at array<long>, " + ", ".join(
            f"v{i} array<double>" for i in range(len(VALUES)))), ([], *([] for _ in VALUES)))

    def follow(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        before, gaps = [], []
        for customer, at, *values in zip(*(rows[c].tolist() for c in ("customer", "at", *VALUES))):
            times, *last = self.known.get(customer)
            gap = (at - times[-1]) // _DAY if len(times) else np.nan
            gaps.append((gap, (times[-1] - times[-2]) // _DAY if len(times) > 1 else np.nan))
            before.append([v[-1] if len(times) else np.nan for v in last])
            self.known.set(customer, ([*times[-1:], at], *([*v[-1:], x] for v, x in zip(last, values))))
        result = pd.DataFrame({"CustomerId": rows["customer"], "OrderNumber": rows["number"], "PlacedDateTime": pd.to_datetime(rows["at"], unit="us"),
                               **{c: rows[c] for c in VALUES}})
        result[[f"Prev_{c}" for c in VALUES]] = np.array(before, float)
        result[["DaysSincePrevOrder", "PrevGap"]] = np.array(gaps, float)
        yield result


_FOLLOWED = ("CustomerId long, OrderNumber long, PlacedDateTime timestamp, "
             + ", ".join(f"{c} double" for c in VALUES) + ", "
             + ", ".join(f"Prev_{c} double" for c in VALUES)
             + ", DaysSincePrevOrder double, PrevGap double")


def _pair_mean(now, before):
    """Mean of two values, of which either may be unknown."""
    return F.when(F.col(now).isNull(), F.col(before)).when(F.col(before).isNull(), F.col(now)) \
        .otherwise((F.col(now) + F.col(before)) / 2)


def stream_early_warning(orders: DataFrame, lateness: str = LATENESS, rules: dict = FLAG_RULES, buckets: int = BUCKETS) -> DataFrame:
    """Deviations and flags for each order once the watermark has passed it; orders that
    come later than ``lateness`` are dropped. Python only lines orders up, the arithmetic
    is column expressions."""
    keep_state_on_disk(orders.sparkSession)
    followed = (
        _keyed(orders, ORDER_INPUT, lateness, buckets)
        .transformWithStateInPandas(Follow(), _FOLLOWED, "Append", "EventTime")
    )
    rename = lambda c: None if c is None else F.when(~F.isnan(c), F.col(c))
    clean = followed.withColumns({
        c: rename(c) for c in [*VALUES, *[f"Prev_{v}" for v in VALUES], "DaysSincePrevOrder", "PrevGap"]})
    means = {
        "Rolling2_AvgPrice": _pair_mean("OrderItemPriceTotal", "Prev_OrderItemPriceTotal"),
        "Rolling2_AvgShipping": _pair_mean("RushFeeAndShipPrice", "Prev_RushFeeAndShipPrice"),
        "Rolling2_AvgDiscount": _pair_mean("PromoCodeDiscount", "Prev_PromoCodeDiscount"),
        "Rolling2_Gap": _pair_mean("DaysSincePrevOrder", "PrevGap"),
    }
    measured = clean.withColumns(means).withColumns({z: deviation(c, m) for z, (c, m) in DEVIATIONS.items()})
    return warning_flags(measured, rules).select(
        "CustomerId", "OrderNumber", F.col("PlacedDateTime").alias("OrderDate"), *DEVIATIONS, *rules)


# ---------------------------------------------------------------- overdue
_ALERT = "CustomerId long, LastOrderDate timestamp, OverdueSince timestamp, MeanDays double"


class Overdue(InOrder):
    """Silences that made a customer overdue. The state keeps a customer's number of orders, the
    days between the first and the last, the last, and whether its silence was told; and, as
    entries that wait, when each silence has to be looked at."""

    def __init__(self, factor: float, active: int):
        self.factor, self.active = factor, active

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = Known(handle.getMapState("totals", "customer long", "orders long, days long, last long, alerted boolean"), (0, 0, -1, False))
        self.dues = Waiting(handle, [], spans=SPANS, name="due_")

    def _limit(self, orders: int, days: int) -> int | None:
        """Whole days of silence that make a customer overdue; none before two orders."""
        return max(int(self.factor * (days / (orders - 1)) // 1) + 1, self.active + 1) if orders > 1 else None

    def _alerts(self, found: list[tuple]) -> list[pd.DataFrame]:
        """One frame of (customer, start of the silence, days until it was one, mean pause)."""
        customers, starts, silences, means = (list(c) for c in zip(*found)) if found else ([],) * 4
        starts, silences = np.array(starts, "int64"), np.array(silences, "int64")
        return [pd.DataFrame({"CustomerId": customers, "LastOrderDate": pd.to_datetime(starts, unit="us"),
                              "OverdueSince": pd.to_datetime(starts + silences * _DAY, unit="us"), "MeanDays": means})] if found else []

    def follow(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found, touched = [], {}
        for customer, at in zip(rows["customer"].tolist(), rows["at"].tolist()):
            orders, days, last, alerted = self.known.get(customer)
            gap = (at - last) // _DAY if orders else 0
            limit = self._limit(orders, days)
            if limit is not None and gap >= limit and not alerted:
                found.append((customer, last, limit, days / (orders - 1)))
            self.known.set(customer, (orders + 1, days + gap, at, False))
            limit = self._limit(orders + 1, days + gap)
            if limit is not None:
                touched[customer] = at + limit * _DAY
        if touched:
            self.dues.add(pd.DataFrame({"at": list(touched.values()), "number": list(touched)}))
        yield from self._alerts(found)

    def quiet(self, now: int) -> tuple[list[pd.DataFrame], int | None]:
        """Looks at the silences that are due; all orders before ``now`` have been taken."""
        frames = []
        for rows in self.dues.take(now):
            found = []
            for customer, due in zip(rows["number"].tolist(), rows["at"].tolist()):
                orders, days, last, alerted = self.known.get(customer)
                limit = self._limit(orders, days)
                if not alerted and last + limit * _DAY == due:  # else another order has come since
                    self.known.set(customer, (orders, days, last, True))
                    found.append((customer, last, limit, days / (orders - 1)))
            frames += self._alerts(found)
        return frames, self.dues.earliest()


def stream_overdue(orders: DataFrame, lateness: str = LATENESS, factor: float = CADENCE_FACTOR,
                   active: int = ACTIVE_DAYS, buckets: int = BUCKETS) -> DataFrame:
    """An alert when a customer has been silent for more than ``factor`` times the own
    mean pause and more than ``active`` days, by the event-time clock of the stream.

    An alert is also given for a silence that has ended already when it is seen, so the
    alerts depend neither on how the input is cut into batches nor, within ``lateness``,
    on the order it comes in.
    """
    keep_state_on_disk(orders.sparkSession)
    return (
        _keyed(orders, ["CustomerId", "OrderNumber", "PlacedDateTime"], lateness, buckets)
        .transformWithStateInPandas(Overdue(factor, active), _ALERT, "Append", "EventTime")
    )


def run_available(stream: DataFrame, output: str, checkpoint: str) -> str:
    """Process what is there now into Parquet files, then stop."""
    query = (
        stream.writeStream.format("parquet").option("path", output)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return output
