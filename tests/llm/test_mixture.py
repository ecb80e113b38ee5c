import re

import pytest
from cases import SMALL, documents, edge_rows, empty
from pyspark.sql import functions as F

from patronly.llm import mixture, shards


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Water filling by resharing, one source list in Python."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and left * weight[s] / open_weight > most * sizes[s]} if open_weight else set()
        if not above:
            return {s: most * sizes[s] if s in full else left * weight[s] / open_weight for s in order}
        full |= above


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, taken):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    targets = brute_targets(sizes)
    by_source = {}
    source_of = {(i, count(t)): s for i, t, _, s in rows}
    for r in taken:
        source = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source[source] = by_source.get(source, 0) + r["taken"]
    for source, n in by_source.items():
        assert n == round(targets[source]) or abs(n - targets[source]) <= 0.5


def test_targets_are_met_exactly_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    first = sorted(map(tuple, mixture.taken_words(docs, block=64).collect()))
    taken = mixture.taken_words(docs, block=64)
    check(rows, taken.collect())
    assert sorted(map(tuple, taken.collect())) == first
    again = mixture.taken_words(docs.repartition(3, "n_chars"), block=64)  # another split of the same rows
    assert sorted(map(tuple, again.collect())) == first


def test_hot_source_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(shards, "SLICE_ROWS", 7)
    monkeypatch.setattr(mixture, "CHUNK", 5)
    rows = [(i, "w " * (i % 13), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(300)]
    check(rows, mixture.taken_words(documents(spark, rows), block=10).collect())


def test_edges(spark):
    rows = [r for r in edge_rows() if r[0] != 2]
    check(rows, mixture.taken_words(documents(spark, rows), block=100).collect())
    assert mixture.taken_words(documents(spark, edge_rows())).count() == len(edge_rows())
    assert mixture.taken_words(empty(spark)).count() == 0
    assert mixture.mixed_documents(empty(spark)).count() == 0
    blank = documents(spark, [(1, None, None, None), (2, "", "en", "a")])
    assert {r["taken"] for r in mixture.taken_words(blank).collect()} == {0}


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1024])
def test_permutations_permute(spark, n):
    out = spark.range(n).select(mixture._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit("s")).alias("p"))
    assert sorted(r["p"] for r in out.collect()) == list(range(n))


def test_shards_are_multinomial_draws_with_exact_totals(spark):
    rows = [(i, "w " * 50, "en", f"s{i % 3}") for i in range(400)]
    _, spans = mixture.mix(documents(spark, rows), block=10, shard_slots=100)
    slots = {(r["source_no"], r["slot"]): r["shard"] for r in spans.select("shard", "slot", "source_no").distinct().collect()}
    numbers, shard_of = {}, {}
    for (source, slot), shard in slots.items():
        numbers.setdefault(source, []).append(slot)
        shard_of.setdefault(source, []).append((slot, shard))
    share = {s: len(n) / len(slots) for s, n in numbers.items()}
    last = max(slots.values())
    for s, own in numbers.items():
        assert sorted(own) == list(range(len(own)))  # every slot once
        order = [shard for _, shard in sorted(shard_of[s])]
        assert order == sorted(order)  # a source's slots run through the shards
        counts = [order.count(j) for j in range(last - 2)]
        spread = (100 * share[s] * (1 - share[s])) ** 0.5
        assert len(set(counts)) > 3 and all(abs(c - 100 * share[s]) < 5 * spread for c in counts)
    assert all(list(slots.values()).count(j) == 100 for j in range(last - 5))


def test_draws_find_their_source_among_many(spark):
    listed, upto = [], 0
    for i in range(60):
        n = 5000 if i == 30 else 1 + i % 3
        listed.append((i, n, upto))
        upto += n
    sources = spark.createDataFrame(listed, "source_no long, slots long, upto long")
    draws = mixture.shard_draws(sources, upto, 40, 100, 3).collect()
    slots = {i: [] for i, _, _ in listed}
    for r in draws:
        slots[r["source_no"]] += range(r["first"], r["first"] + r["n"])
    assert {i: sorted(x) for i, x in slots.items()} == {i: list(range(n)) for i, n, _ in listed}
    assert {r["shard"] for r in draws if r["source_no"] == 30} >= set(range(40))


def test_blocks_hold_the_taken_words_of_their_slots(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(3 * i)), "en", f"s{i % 2}") for i in range(60)]
    docs = documents(spark, rows)
    blocks = mixture.mixed_blocks(docs, block=16, shard_slots=20).collect()
    assert len({(r["source_no"], r["slot"]) for r in blocks}) == len(blocks) and len({r["shard"] for r in blocks}) > 3
    got = {}
    for r in blocks:
        words = r["text"].split(" ")
        assert len(words) == r["words"] <= 16
        for w in words:
            i = int(w[1:].split("w")[0])
            assert i % 2 == r["source_no"]
            got[i] = got.get(i, 0) + 1
    taken = {r["doc_id"]: r["taken"] for r in mixture.taken_words(docs, block=16, shard_slots=20).collect()}
    assert got == {i: n for i, n in taken.items() if n}


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(3 * i)), "en", f"s{i % 2}") for i in range(60)]
    docs = documents(spark, rows)
    mixed = mixture.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    text, got = {i: t for i, t, _, _ in rows}, {}
    for r in mixed.collect():
        words, own = r["text"].split(" "), text[r["doc_id"]].split(" ")
        places = [own.index(w) for w in words]
        assert places == sorted(set(places)) and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words)
    taken = {r["doc_id"]: r["taken"] for r in mixture.taken_words(docs, block=16).collect()}
    assert got == {i: n for i, n in taken.items() if n}
