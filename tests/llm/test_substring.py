import numpy as np
from cases import SMALL, documents, edge_rows, empty, sha, texts, words

from patronly.llm import substring


def brute(rows, size):
    """(doc_id, n_words, n_removed, kept) by looking at every window."""
    first = {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p:p + size]), doc_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - size + 1):
            if doc_id is not None and first[tuple(w[p:p + size])] < doc_id:
                gone[p:p + size] = True
        out.append((doc_id, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_small_corpus(spark):
    rows = list(texts(spark, SMALL).items())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert result(substring.repeated_passages(docs)) == brute(rows, 50)


def test_edges(spark):
    rows = edge_rows()
    assert result(substring.repeated_passages(documents(spark, rows))) == brute([r[:2] for r in rows], 50)
    assert result(substring.repeated_passages(documents(spark, rows), window=4, gram=2)) == brute([r[:2] for r in rows], 4)
    assert substring.repeated_passages(empty(spark)).count() == 0


def test_shared_passages_in_many_places(spark):
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(120):
        w = [f"w{x}" for x in rng.integers(0, 300, 90)]
        at = int(rng.integers(0, 60))
        cut = int(rng.integers(0, 25))
        rows.append((i, " ".join(w[:at] + passage[cut:cut + int(rng.integers(40, 70))] + w[at:]), "en", "a"))
    rows += [(i, rows[i - 200][1], "en", "a") for i in range(200, 220)] + [(7, rows[7][1], "en", "a"), (7, rows[9][1], "en", "a")]
    docs = documents(spark, rows).repartition(5)
    assert result(substring.repeated_passages(docs)) == brute([r[:2] for r in rows], 50)


def test_kept_text(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(60)), "en", "a"), (2, "x " + " ".join(f"a{i}" for i in range(60)) + " y", "en", "a")]
    found = {r["doc_id"]: r["kept_text"] for r in substring.repeated_passages(documents(spark, rows), with_text=True).collect()}
    assert found == {1: None, 2: "x y"}


def test_smallest_in_runs():
    values = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for size in (1, 2, 3, 5, 8, 35, 50, 51):
        assert list(substring.smallest_in_runs(values, size)) == [min(values[i:i + size]) for i in range(50 - size + 1)]
