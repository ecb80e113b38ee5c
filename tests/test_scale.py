"""How much passes over large tables move or repeat, with results as those of plain versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronly.functions import quantiles as qu
from patronly.operators import attributions as ab, boosting as bo, mixed_clusters as mc, models as mo, warning as wa
from patronly.streaming import state as st
from conftest import rows
from test_customers import featured

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    data = [(i, rng.random(), rng.randrange(6) / 2, rng.choice(["a", "b", "c'", None]), rng.random() < 0.4) for i in range(400)]
    return spark.createDataFrame(data, "CustomerId long, x double, y double, c string, churned boolean").repartition(5).cache()


def test_boosting_stores_blocks_not_rows(table, monkeypatch):
    monkeypatch.setattr(bo, "BLOCK", 30)
    blocks, cuts = bo.binned(table, FEATURES, "churned", "CustomerId", 8)
    kind = bo._bin_type(cuts)
    parts = list(bo._unpacked(blocks.toPandas(), kind))
    assert blocks.count() < 40 and sum(len(y) for _, y, _, _ in parts) == 400
    own = {r["h"]: r for r in table.select("*", F.xxhash64("CustomerId").alias("h")).collect()}
    for hashes, y, values, margin in parts:
        for h, label, bins in zip(hashes, y, values):
            assert label == own[h]["churned"] and [sum(t < own[h][f] for t in c) for f, c in zip(FEATURES, cuts)] == list(bins)
        assert not margin.any()


def test_many_ranks_need_no_join(table):
    ranks = [i / 40 for i in range(41)]
    for accuracy in (100_000, 100):
        found = qu.exact_quantiles(table, {"x": ranks, "y": [0.3], "CustomerId": [0.5]}, accuracy=accuracy)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["feature"], r["p"]): r["quantile"] for r in found.collect()}
        own = table.toPandas()
        assert got == pytest.approx({**{("x", p): np.quantile(own["x"], p) for p in ranks}, ("y", 0.3): np.quantile(own["y"], 0.3), ("CustomerId", 0.5): 199.5})


def test_folds_fitted_at_once_share_the_cores(table, monkeypatch):
    monkeypatch.setattr(mo, "boosted_regularised", (lambda old, shares: lambda *a, **k: shares.append(k["share"]) or old(*a, **k))(
        mo.boosted_regularised, shares := []))
    found = {r["Fold"]: r for r in mo.cross_validate(table, FEATURES, "churned", k=4, trees=2).collect()}
    assert shares == [0.25] * 4 and found[-1]["Rows"] == 400
    assert bo.binned(table, FEATURES, "churned", "CustomerId", 8, 0.25)[0].rdd.getNumPartitions() <= 2


def test_places_lie_in_the_same_boxes_as_values():
    rng = np.random.default_rng(3)
    leaves = [({0: (-np.inf, 0.2), 1: (0.5, np.inf)}, 1.0), ({0: (0.2, 0.7)}, 2.0), ({}, 1.0), ({1: (-np.inf, 0.5), 0: (0.7, np.inf)}, 1.0)]
    values = np.concatenate([rng.random((50, 2)), [[0.2, 0.5], [0.7, 0.5], [np.nan, 0.1], [np.inf, -np.inf], [0.0, np.nan]]])
    grid = ab.Grid(leaves, 2)
    assert grid.places(values).dtype == np.uint8
    for box, _ in leaves:
        own = sorted(box.items())
        assert (ab._inside(grid.places(values), grid.box(own)) == ab._inside(values, own)).all()


def test_many_centres_are_not_one_long_expression(table):
    rng = np.random.default_rng(5)
    model = mc.Prototypes(["x", "y"], ["c"], 0.7, [(list(rng.random(2)), [str(rng.choice(["a", "b", "c'"]))]) for _ in range(60)])
    some = table.withColumn("x", F.when(F.col("CustomerId") != 3, F.col("x")))
    found = model.assign(some)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("0.7") < 5
    short = some.withColumn("d", F.array_min(model.distances())).withColumn("at", (F.array_position(model.distances(), F.col("d")) - 1).cast("int"))
    assert found.orderBy("CustomerId").select("CustomerId", "Cluster", "Distance").collect() == short.orderBy("CustomerId").select(
        "CustomerId", F.col("at").alias("Cluster"), F.col("d").alias("Distance")).collect()


class Entries(dict):
    getValue = dict.__getitem__
    containsKey = dict.__contains__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__
    iterator = dict.items


class Handle:
    def getMapState(self, name, *_):
        return Entries()


def test_few_orders_of_a_month_wait_together_and_many_by_hour(monkeypatch):
    """A bucket's orders take few entries where they are few; a dense month is taken hour by hour."""
    monkeypatch.setattr(st, "CHUNK", 20)
    rng, hour = random.Random(7), 3_600_000_000
    at = [rng.randrange(24 * 900) * hour + 5 for _ in range(300)] + [(24 * 100 + rng.randrange(60)) * hour + 7 for _ in range(2000)]
    table = pd.DataFrame({"at": at, "number": range(len(at)), "customer": [rng.randrange(50) for _ in at], "v": [float(i) for i in range(len(at))]})
    waiting = st.Waiting(Handle(), ["v"], ["customer"], st.SPANS)
    waiting.add(table.iloc[:300])
    assert len(waiting.hours) < 60 and waiting.earliest() == table["at"][:300].min()
    for start in range(300, len(table), 500):
        waiting.add(table.iloc[start:start + 500])
    assert max(len(v[0]) for v in waiting.orders.values()) <= 20
    taken = []
    for until in (24 * 50 * hour, 24 * 101 * hour, 24 * 101 * hour + 6, 2 ** 62):
        frames = list(waiting.take(until))
        assert max(map(len, frames), default=0) < 100 and (waiting.earliest() or until) >= until
        taken += frames
    assert not waiting.hours and not waiting.orders
    got = pd.concat(taken, ignore_index=True)
    expected = table.sort_values(["at", "number"], ignore_index=True)
    assert got[["at", "number", "customer", "v"]].equals(expected)


@pytest.mark.parametrize("build", [st.stream_early_warning, st.stream_overdue])
def test_streams_do_not_depend_on_buckets(spark, order_rows, tmp_path, build):
    """Customer 1 owns a third of the orders; one bucket for all gives what many give, in a few state calls."""
    rng = random.Random(9)
    table = featured(order_rows(*[
        {"CustomerId": 1 if i % 3 == 0 else rng.randrange(2, 40), "OrderItemPriceTotal": None if i % 11 == 0 else float(rng.randrange(90)),
         "PlacedDateTime": str(datetime(2019, 1, 1) + timedelta(days=rng.randrange(500), hours=rng.randrange(24)))} for i in range(300)])).cache()
    found = []
    for buckets in (1, 64):
        folder = f"{tmp_path}/{buckets}"
        for i in range(3):
            table.filter(F.col("PlacedDateTime").between(*(F.lit(datetime(2019, 1, 1) + timedelta(days=d)) for d in (180 * i, 180 * i + 179.999)))).coalesce(
                1).write.mode("append").parquet(f"{folder}/in")
        st.clock_row(table, st.LATENESS).write.mode("append").parquet(f"{folder}/in")
        stream = build(st.read_order_stream(spark, f"{folder}/in", files_per_trigger=1), buckets=buckets)
        found.append(spark.read.parquet(st.run_available(stream, f"{folder}/out", f"{folder}/state")))
    one, many = (rows(f, *f.columns) for f in found)
    assert one == many and len(one) == (300 if build is st.stream_early_warning else len(set(one))) and len(one) > 20
    if build is st.stream_early_warning:
        columns = ["OrderNumber", *wa.DEVIATIONS, *wa.FLAG_RULES]
        for a, b in zip(rows(found[0], *columns), rows(wa.order_warnings(table), *columns)):
            assert a == pytest.approx(b)


def test_sessions_are_joined_once_before_their_text_is_encoded(spark, monkeypatch):
    from patronly.plans import flows

    plans, encode = [], flows.features.label_encode
    monkeypatch.setattr(flows.features, "label_encode", lambda df, columns: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or encode(df, columns))
    own = spark.range(60).selectExpr("id as CustomerId", "id % 3 = 0 as OneAndDone", "(id % 2) / 2 as PctWorkday")
    seen = spark.range(60).selectExpr("id as CustomerId", "if(id % 3 = 0, 'a', 'b') as traffic_source_medium", "'x' as device_category")
    found = flows.one_and_done_classifier(own.join(seen, "CustomerId"), trees=2)
    assert "Join" not in plans[0] and found["scored"].count() == found["test"].count() > 5
