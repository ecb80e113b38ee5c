"""Joins along time against loops over rows; windowed streams against the same call on a table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from patronly.operators import churn as ch, reports as rp, sketches as sk, timelines as tl
from patronly.streaming import state as st, windows as sw
from conftest import rows
from test_customers import featured

START = datetime(2020, 1, 1)
LEFT, RIGHT = "k long, n long, t timestamp", "k long, id long, at timestamp, v string"


@pytest.fixture(scope="module")
def moved():
    """Key 1 owns a third of all rows; keys, times and values may be missing; times tie."""
    rng = random.Random(2)
    key = lambda: rng.choice([1, 1, 1, 2, 3, 4, 5, None])
    time = lambda: None if rng.random() < 0.03 else START + timedelta(minutes=30 * rng.randrange(300))
    left = [(key(), i, time()) for i in range(300)]
    right = [(key(), i, time(), rng.choice(["a", "b", None])) for i in range(200)]
    return left, right


@pytest.mark.parametrize("within,limit", [(None, None), ("5 hours", timedelta(hours=5))])
@pytest.mark.parametrize("unit", ["HOUR", "MONTH"])
def test_last_before(spark, moved, within, limit, unit):
    left, right = moved
    found = tl.last_before(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "k", "t", "at", ["v", "id"], "id", within, unit)
    expected = []
    for k, n, t in left:
        best = max(((at, i, v) for rk, i, at, v in right if None not in (k, t, at) and rk == k and at <= t
                    and (limit is None or at >= t - limit)), default=None, key=lambda b: b[:2])
        expected.append((k, n, t, *((best[0], best[2], best[1]) if best else (None, None, None))))
    assert found.columns == ["k", "n", "t", "at", "v", "id"]
    assert rows(found, *found.columns) == sorted(expected, key=repr)
    assert tl.last_before(spark.createDataFrame([], LEFT), spark.createDataFrame(right, RIGHT), "k", "t", "at", ["v", "id"], "id").count() == 0
    nothing = tl.last_before(spark.createDataFrame(left, LEFT), spark.createDataFrame([], RIGHT), "k", "t", "at", ["v", "id"], "id")
    assert nothing.filter("id is not null").count() == 0 and nothing.count() == len(left)


@pytest.mark.parametrize("days", [None, 1, 1000])
def test_in_windows(spark, days):
    rng = random.Random(3)
    points = [(i, None if i % 40 == 0 else START + timedelta(hours=rng.randrange(24 * 400))) for i in range(200)]
    spans = [(i, START + timedelta(days=a), START + timedelta(days=a + rng.choice([0, 3, 20, 300, -2]))) for i, a in
             ((i, rng.randrange(400)) for i in range(60))] + [(99, START, None)]
    windows = spark.createDataFrame(spans, "w long, s timestamp, e timestamp")
    found = tl.in_windows(spark.createDataFrame(points, "n long, t timestamp"), windows, "t", "s", "e", days)
    expected = sorted((n, w) for n, t in points for w, s, e in spans if t and e and s <= t <= e)
    assert sorted((r["n"], r["w"]) for r in found.collect()) == expected
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    totals = tl.window_totals(spark.createDataFrame([(t, 1.0) for _, t in points], "t timestamp, x double"), windows, "t", "s", "e", "w", "x")
    assert {r["w"]: r["Rows"] for r in totals.collect()} == {w: sum(1 for _, x in expected if x == w) for w, _, _ in spans}


def test_window_totals_never_pair_rows_with_windows(spark):
    """Odd ends, equal ends, repeated and missing ids, missing amounts; rows just inside and outside an end."""
    rng, tick = random.Random(5), timedelta(microseconds=1)
    spans = [(i % 50 if i % 9 else None, START + timedelta(seconds=a), None if i % 20 == 7 else START + timedelta(seconds=a + rng.choice([-1, 0, 0, 7, 90, 2000])))
             for i, a in ((i, rng.randrange(0, 2000, 10)) for i in range(90))]
    ends = [t for _, *both in spans for t in both if t]
    points = [(rng.choice(ends) + rng.choice([-tick, 0 * tick, tick]), rng.choice([None, 0.25, 8.0, -3.5])) for _ in range(400)]
    points += [(None, 1.0), (START - timedelta(days=9), 1.0), (START + timedelta(days=9), 1.0)]
    windows, table = spark.createDataFrame(spans, "w long, s timestamp, e timestamp"), spark.createDataFrame(points, "t timestamp, x double")
    found = tl.window_totals(table, windows, "t", "s", "e", "w", "x")
    inside = lambda w: [x for v, s, e in spans if None not in (w, e) and v == w for t, x in points if t and s <= t <= e]
    expected = [(w, s, e, len(inside(w)), sum((x for x in inside(w) if x is not None), 0.0)) for w, s, e in spans]
    assert rows(found, "w", "s", "e", "Rows", "Amount") == sorted(expected, key=repr)
    for none in (tl.window_totals(table, windows.limit(0), "t", "s", "e", "w", "x"), tl.window_totals(table.limit(0), windows, "t", "s", "e", "w", "x")):
        assert none.filter("Rows > 0").count() == 0


def test_window_totals_pass_no_row_window_pairs(spark):
    """1,000 rows at one time inside 300 equal windows are 300,000 pairs; no operator may see as many rows."""
    windows = spark.range(300).select(F.col("id").alias("w"), F.lit(START).alias("s"), F.lit(START + timedelta(days=1)).alias("e"))
    table = spark.range(1000).select(F.lit(START).alias("t"), F.lit(1.0).alias("x"))
    found = tl.window_totals(table, windows, "t", "s", "e", "w", "x")
    assert {(r["Rows"], r["Amount"]) for r in found.collect()} == {(1000, 1000.0)}
    assert most_rows(found) < 10_000


def most_rows(df):
    """Most rows that any operator of a collected table's final plan put out."""
    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(plan.executedPlan())
            return
        if name.endswith("QueryStageExec"):
            yield from walk(plan.plan())
        found = plan.metrics().get("numOutputRows")
        if found.isDefined():
            yield found.get().value()
        children = plan.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))
    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_visits(spark, moved):
    _, events = moved
    pause, starts = timedelta(hours=2), {}
    expected = []
    for k, i, at, v in sorted((e for e in events if e[0] is not None and e[2] is not None), key=lambda e: (e[0], e[2], e[1])):
        before = starts.get(k)
        begin = at if before is None or at > before[1] + pause else before[0]
        starts[k] = (begin, at)
        expected.append((k, i, begin))
    marked = tl.with_visit_start(spark.createDataFrame(events, RIGHT), "k", "at", "id", "2 hours")
    assert rows(marked, "k", "id", "VisitStart") == sorted(expected, key=repr)
    table = tl.visits_by_pause(spark.createDataFrame(events, RIGHT), "k", "at", "id", "id", "2 hours")
    assert sum(r["Events"] for r in table.collect()) == len(expected)
    assert {(r["k"], r["VisitStart"]) for r in table.collect()} == {(k, b) for k, _, b in expected}


@pytest.fixture(scope="module")
def arriving(order_rows):
    rng = random.Random(6)
    return featured(order_rows(*[
        {"CustomerId": rng.randrange(9), "OrderItemPriceTotal": float(rng.randrange(90)),
         "PlacedDateTime": str(datetime(2019, 1, 1) + timedelta(days=4 * i, hours=rng.randrange(24)))} for i in range(100)])).cache()


LATE = [f"(case when OrderNumber % 5 = 0 then OrderNumber + 20 else OrderNumber end - 1) div 25 = {i}" for i in range(5)]


@pytest.mark.parametrize("size,slide", [("20 days", None), ("30 days", "10 days")])
def test_windowed_stream_equals_table_with_late_orders(spark, arriving, tmp_path, size, slide):
    folder = str(tmp_path)
    for part in LATE:
        arriving.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    st.clock_row(arriving, "200 days").write.mode("append").parquet(f"{folder}/in")
    stream = sw.windowed_orders(st.read_order_stream(spark, f"{folder}/in", files_per_trigger=1), size, slide, "100 days")
    found = spark.read.parquet(st.run_available(stream, f"{folder}/out", f"{folder}/state"))
    expected = sw.windowed_orders(arriving, size, slide)
    assert rows(found, *expected.columns) == rows(expected, *expected.columns) and expected.count() > 15


def test_windows_in_update_mode_end_at_the_tables_totals(spark, arriving, tmp_path):
    folder, seen = str(tmp_path), {}
    for part in LATE:
        arriving.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = sw.windowed_orders(st.read_order_stream(spark, f"{folder}/in", files_per_trigger=1), "20 days", None, "100 days")

    def note(batch, _):
        seen.update({r["WindowStart"]: (r["Orders"], r["Revenue"]) for r in batch.collect()})

    query = stream.writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == {r["WindowStart"]: (r["Orders"], r["Revenue"]) for r in sw.windowed_orders(arriving, "20 days").collect()}


def test_a_customer_with_very_many_orders_waits_in_small_entries(spark, order_rows, tmp_path, monkeypatch):
    """A third of all orders are one customer's; no state entry holds more than a chunk."""
    rng = random.Random(9)
    data = [{"CustomerId": 1 if i % 3 == 0 else i, "OrderItemPriceTotal": float(rng.randrange(90)),
             "PlacedDateTime": str(datetime(2019, 1, 1) + timedelta(minutes=3 * rng.randrange(4000)))} for i in range(900)]
    table = featured(order_rows(*data)).cache()
    monkeypatch.setattr(st, "CHUNK", 7)
    frames = []

    class Entries(dict):
        getValue = dict.__getitem__
        containsKey = dict.__contains__
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__
        iterator = dict.items

    class Handle:
        def getMapState(self, name, *_):
            return Entries()

    waiting = st.Waiting(Handle(), ["v"])
    own = table.filter("CustomerId = 1").select("OrderNumber", F.unix_micros("PlacedDateTime").alias("at"), F.lit(1.0).alias("v")).toPandas()
    own = own.rename(columns={"OrderNumber": "number"})
    for start in range(0, len(own), 50):
        waiting.add(own.iloc[start:start + 50])
    assert max(len(v[0]) for v in waiting.orders.values()) <= 7 and len(waiting.hours) > 50
    middle = int(own["at"].median())
    frames = list(waiting.take(middle))
    assert max(map(len, frames)) < 30 and sum(map(len, frames)) == (own["at"] < middle).sum()
    times = [t for f in frames for t in f["at"]]
    assert times == sorted(times) and waiting.earliest() == own.loc[own["at"] >= middle, "at"].min()
    assert sum(map(len, waiting.take(2 ** 62))) == (own["at"] >= middle).sum() and not waiting.hours and not waiting.orders


def test_changes_between_tables(spark):
    labels = ch.REPORTED_LABELS
    schema = "CustomerId long, " + ", ".join(f"{c} boolean" for c in labels)
    old = spark.createDataFrame([(1, *[False] * 5), (2, *[False] * 5), (3, *[True] * 5), (4, None, *[True] * 4)], schema)
    new = spark.createDataFrame([(1, *[False] * 5), (2, True, *[False] * 4), (4, None, *[True] * 4), (5, *[False] * 5)], schema)
    assert rows(ch.label_changes(old, new), "CustomerId", "Change", "NewLikelyChurned") == [(2, "changed", True), (3, "left", None), (5, "entered", False)]
    assert rows(ch.changed_rows(old, new), "CustomerId") == [(2,), (5,)]
    assert sum(r["Customers"] for r in ch.label_transitions(old, new).collect()) == 5


def test_sketches_merge_and_money_adds_up(spark):
    data = [(i % 7, "x" if i % 3 else "y", START + timedelta(hours=7 * i), i * 0.005) for i in range(400)]
    orders = spark.createDataFrame([(c, g, t, a, None if i % 5 else a) for i, (c, g, t, a) in enumerate(data)],
                                   "CustomerId long, g string, PlacedDateTime timestamp, OrderItemPriceTotal double, RushFeeAndShipPrice double")
    report = {r["g"]: r for r in sk.span_report(sk.monthly_sketches(orders, ["g"]), ["g"], "2020-02-01", "2020-04-01").collect()}
    for g, r in report.items():
        own = sorted(a for _, h, t, a in data if h == g and datetime(2020, 2, 1) <= t < datetime(2020, 4, 1))
        assert r["Orders"] == len(own) and r["Customers"] == 7 and abs(r["Value_50"] - own[len(own) // 2]) < 0.05
    from decimal import ROUND_HALF_UP, Decimal
    cents = lambda a: Decimal(repr(round(a, 8))).quantize(Decimal("0.01"), ROUND_HALF_UP)
    for partitions in (1, 9):
        for r in rp.exact_revenue(orders.repartition(partitions), ["g"]).collect():
            own = [cents(a) for _, g, _, a in data if g == r["g"]]
            assert r["Revenue"] == sum(own) and r["Average"] == (sum(own) / len(own)).quantize(Decimal("0.01"), ROUND_HALF_UP)
            assert r["Total"] == r["Revenue"] + r["Fees"]


def test_grouping_sets_agree_with_single_reports(spark):
    rows_ = spark.createDataFrame([(i, i % 9 + 1, 300.0 * (i % 7), i % 4 == 0, "Sticker" if i % 3 else "Label") for i in range(200)],
                                  "CustomerId long, TotalOrders long, LifetimeValue double, LikelyChurned boolean, ProductType string")
    table = rp.bucket_grouping_sets(rows_)
    assert table._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # one pass
    whole = table.filter("Grouping = 7 and LeastValue = 0.0").first()
    assert whole["Customers"] == 200 and whole["Revenue"] == sum(300.0 * (i % 7) for i in range(200))
    single = {(r["ProductType"], r["SpendingBucket"]): r["n"] for r in rp.spending_bucket(rows_).groupBy("ProductType", "SpendingBucket").agg(
        F.count("*").alias("n")).collect()}
    assert {(r["ProductType"], r["SpendingBucket"]): r["Customers"] for r in table.filter("Grouping = 1 and LeastValue = 0.0").collect()} == single
