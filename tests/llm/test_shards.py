import itertools
import zlib

import pytest
from cases import MIDDLE, documents, edge_rows, empty
from pyspark.sql import functions as F

from patronly.llm import shards


def place(point, bits):
    """The place of a point on the curve, by the tables."""
    digits, states = shards.curve_tables(len(point))
    at = state = 0
    for level in reversed(range(bits)):
        row = state * (1 << len(point)) + sum(((x >> level) & 1) << d for d, x in enumerate(point))
        at, state = at * (1 << len(point)) + digits[row], states[row]
    return at


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_and_steps_to_neighbours(spark, dims, bits):
    points = {place(p, bits): p for p in itertools.product(range(1 << bits), repeat=dims)}
    assert sorted(points) == list(range(1 << bits * dims))
    assert all(sum(abs(x - y) for x, y in zip(points[i], points[i + 1])) == 1 for i in range(len(points) - 1))
    rows = spark.createDataFrame(list(points.values()), ", ".join(f"x{d} int" for d in range(dims)))
    found = rows.select("*", shards.hilbert_index([F.col(f"x{d}") for d in range(dims)], bits).alias("at")).collect()
    assert {r["at"]: tuple(r)[:-1] for r in found} == points


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = {r["doc_id"]: r for r in shards.hilbert_shards(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows.keys() == texts.keys()
    largest = max(r["size"] for r in rows.values())
    by = {}
    for i, r in rows.items():
        data = (texts[i] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        by.setdefault(r["shard"], []).append(r)
    mean = sum(r["size"] for r in rows.values()) / 16
    assert sorted(by) == list(range(16))
    last = -1
    for s in sorted(by):
        assert sorted(r["slot"] for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r["size"] for r in by[s]) - mean) <= largest
        places = [r["hilbert"] for r in sorted(by[s], key=lambda r: r["slot"])]
        assert places == sorted(places) and places[0] >= last
        last = places[-1]


def test_order_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    one, two = (sorted(map(tuple, shards.hilbert_shards(d).collect())) for d in (docs, docs.repartition(5, "n_chars")))
    assert one == two


def test_cells_of_like_counts_and_hot_values(spark):
    rows = spark.createDataFrame([(i, f"s{i % 64:02}" if i % 3 else "hot", None if i % 5 == 0 else float(i)) for i in range(3840)],
                                 "id long, s string, x double")
    cells = shards.quantise(rows, ["s", "x"], 3)
    found = rows.select("s", "x", cells[0].alias("a"), cells[1].alias("b")).collect()
    for column, cell in (("s", "a"), ("x", "b")):
        values = sorted({(r[column] is not None, r[column] if r[column] is not None else 0, r[cell]) for r in found})
        assert [v[2] for v in values] == sorted(v[2] for v in values)  # monotone
        assert {v[2] for v in values} <= set(range(8))
        sizes = {}
        for r in found:
            sizes.setdefault(r[cell], []).append(r[column])
        for own in sizes.values():
            hottest = max(own.count(v) for v in set(own))
            assert len(own) <= 3840 / 8 + hottest


def test_files_can_be_skipped(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    path = str(tmp_path / "shards")
    shards.write_shards(docs, path)
    stored = spark.read.parquet(path)
    assert stored.drop("_shard").exceptAll(docs).count() == 0 and docs.exceptAll(stored.drop("_shard")).count() == 0
    kept = shards.hilbert_shards(docs, keep=("doc_id", "lang", "n_chars"))
    ranges = shards.shard_ranges(kept, ("lang", "n_chars")).collect()
    assert sum(r["rows"] for r in ranges) == docs.count()
    lang = sorted(r["lang"] for r in docs.select("lang").distinct().collect())[0]
    met = [r for r in ranges if r["min_lang"] <= lang <= r["max_lang"]]
    assert len(met) <= len(ranges) / 2
    long = [r for r in ranges if r["max_n_chars"] >= 10_000]
    assert len(long) < len(ranges)


def test_edges(spark, tmp_path):
    docs = documents(spark, edge_rows())
    for name in ("hilbert", "slot", "number", "before", "_id", "_row", "_k0", "_d0", "shard", "_slice", "cell", "dim"):
        docs = docs.withColumn(name, F.lit("x"))
    found = shards.hilbert_shards(docs, shards=4).collect()
    assert len(found) == len(edge_rows())
    for s in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    assert sorted(r["size"] for r in found) == sorted(len((t or "").encode()) + 1 for _, t, _, _ in edge_rows())
    assert shards.hilbert_shards(empty(spark)).count() == 0
    shards.write_shards(docs, str(tmp_path / "s"), shards=4)
    assert spark.read.parquet(str(tmp_path / "s")).columns == [*docs.columns, "_shard"]
