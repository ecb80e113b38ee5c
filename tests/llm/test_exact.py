import re

import pyarrow as pa
from cases import SMALL, documents, edge_rows, empty, sha, texts
from pyspark.sql import functions as F

from patronly.llm import exact
from patronly.llm.exact import exact_dedup, exact_groups


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), doc_id is not None, doc_id or 0, doc_id))
    out = []
    for bare, members in groups.items():
        best = min(members, key=lambda m: m[:3])[3]
        out += [(m[3], best, len(members), m[3] == best, sha(bare.encode())) for m in members]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edges(spark):
    rows = edge_rows()
    assert result(exact_groups(documents(spark, rows))) == brute([r[:2] for r in rows])
    assert exact_groups(empty(spark)).count() == 0


def test_many_runs_merge_in_rounds(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3), "en", "a") for i in range(400)]
    docs = documents(spark, rows).repartition(40)
    assert result(exact_groups(docs, fan_in=2)) == brute([r[:2] for r in rows])


def test_small_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert result(exact_groups(docs)) == brute(texts(spark, SMALL).items())


def test_dedup_keeps_one_row_per_group_and_all_columns(spark):
    docs = documents(spark, edge_rows())
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    best = {b[1] for b in brute([r[:2] for r in edge_rows()])}
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, best))
    assert exact_dedup(empty(spark)).count() == 0


def test_dedup_drops_rows_not_ids(spark):
    rows = [(1, "longer  text", "en", "a"), (2, "longer text", "en", "a"), (2, "its own", "en", "a"), (None, "longer text", "en", "a"),
            (None, "alone", "en", "a"), (None, "too", "en", "a"), (None, "too", "en", "a"), (3, "x", "en", "a"), (3, "y", "en", "a"),
            (4, "z", "en", "a"), (4, "z", "en", "a")]
    kept = exact_dedup(documents(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, "longer  text"), (2, "its own"), (None, "alone"), (None, "too"), (3, "x"), (3, "y"), (4, "z")], key=repr)


def test_columns_of_any_name_pass_through(spark):
    docs = documents(spark, [(1, "a", "en", "s"), (2, "b", "en", "s")])
    kept = {r["doc_id"]: r.asDict() for r in exact_dedup(docs).collect()}
    assert kept == {r["doc_id"]: r.asDict() for r in docs.collect()}


def test_a_round_merges_sorted_runs_in_one_pass_and_verifies(spark):
    entries = [(run, bytes([d] * 32), check, 5, -points, doc, 0, 1) for run in range(8) for d in range(0, 250, 50)
               for check in (1, 2) for points, doc in ((run % 3, 100 + run),)]
    schema = "run long, sha256 binary, check long, length int, fewest int, doc_id long, key int, group_size long"
    merged = exact.merge_round(spark.createDataFrame(entries, schema).repartition(5), 4, 3)
    stored = merged.withColumn("part", F.spark_partition_id()).collect()
    assert len(stored) == 2 * 5 * 2  # two runs are left; equal digests with another second hash stay apart
    for r in stored:
        own = [e for e in entries if e[0] // 4 == r["run"] and e[1] == r["sha256"] and e[2] == r["check"]]
        assert r["group_size"] == len(own) and (r["fewest"], r["doc_id"]) == min((e[4], e[5]) for e in own)
    for part in {r["part"] for r in stored}:
        keys = [(r["run"], bytes(r["sha256"]), r["check"]) for r in stored if r["part"] == part]
        assert keys == sorted(set(keys))  # each task leaves sorted runs, one entry per digest


def test_entries_of_a_digest_meet_over_batches(spark):
    schema = pa.schema([("run", pa.int64()), ("sha256", pa.binary()), ("check", pa.int64()), ("length", pa.int32()), ("fewest", pa.int32()),
                        ("doc_id", pa.int64()), ("key", pa.int32()), ("group_size", pa.int64())])
    rows = [(0, b"a", 1, 1, -i, i, 0, 1) for i in range(9, 0, -1)] + [(0, b"b", 1, 1, 0, 3, 0, 2), (1, b"b", 1, 1, 0, None, 0, 5)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i:i + 2]], schema) for i in range(0, len(rows), 2)]
    found = [tuple(r.values()) for b in exact._merged(iter(batches)) for r in b.to_pylist()]
    assert found == [(0, b"a", 1, 1, -9, 9, 0, 9), (0, b"b", 1, 1, 0, 3, 0, 2), (1, b"b", 1, 1, 0, None, 0, 5)]
    assert list(exact._merged(iter([]))) == []
