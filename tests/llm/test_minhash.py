from collections import Counter

import numpy as np
import pytest
from cases import SMALL, documents, edge_rows, empty, texts, words

from patronly.llm import minhash


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    """By the definition; where no shingle repeats that is the plain Jaccard."""
    if a == b:
        return 1.0
    shared = a.keys() & b.keys()
    if set(a.values()) == {1} == set(b.values()):
        return len(shared) / (len(a) + len(b) - len(shared))
    every = list(a.keys() | b.keys())
    x, y = (np.array([float(c[j]) for j in every]) for c in (a, b))
    return sum(1 / np.maximum(x / a[i], y / b[i]).sum() for i in shared)


def brute(rows):
    """Classes by comparing every two texts that share a shingle."""
    ids = sorted({i for i, t in rows if i is not None and words(t)})
    sets, label = {i: shingles(t) for i, t in rows if i in set(ids)}, {i: i for i in ids}
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    pairs = {(a, b) for members in where.values() for a in members for b in members if a < b}
    links = [(a, b) for a, b in pairs if similarity(sets[a], sets[b]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((i, label.get(i, i), i == label.get(i, i)) for i, _ in rows), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_small_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert result(minhash.near_classes(docs)) == brute(list(texts(spark, SMALL).items()))


def test_edges(spark):
    rows = edge_rows()
    assert result(minhash.near_classes(documents(spark, rows))) == brute([r[:2] for r in rows])
    assert minhash.near_classes(empty(spark)).count() == 0
    kept = minhash.near_dedup(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns


def test_groups_with_strays(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        base = [f"g{g}w{x}" for x in rng.integers(0, 999, 120)]
        for i in range(40):
            w = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 7))):  # from copies to about 0.55
                w[at] = f"new{rng.integers(0, 10**9)}"
            rows.append((int(rng.integers(0, 10**12)), " ".join(w), "en", "a"))
    found = result(minhash.near_classes(documents(spark, rows)))
    assert found == brute([r[:2] for r in rows])


def test_probability_jaccard_is_exact_and_estimated():
    rng = np.random.default_rng(5)
    for n in (3, 40):
        a = Counter({int(i): int(rng.integers(1, 6)) for i in rng.integers(0, 2 * n, n)})
        b = Counter({int(i): int(rng.integers(1, 6)) for i in rng.integers(0, 2 * n, n)})
        sets = [(np.array(sorted(s), np.uint64), np.array([s[i] for i in sorted(s)])) for s in (a, b)]
        exact = similarity(a, b)
        assert minhash.probability_jaccard(*sets) == pytest.approx(exact)
        table = minhash.signatures(sets, 4000)
        assert (table[0] == table[1]).mean() == pytest.approx(exact, abs=0.04)
        # drawn to any time, the registers are the same
        assert (minhash.signatures(sets[:1], 64) == minhash.signatures(sets, 64)[:1]).all()


def test_an_id_on_two_texts_loses_only_the_near_copy(spark):
    base = [f"w{i}" for i in range(60)]
    first, near = " ".join(base), " ".join(base[:-1] + ["other"])
    other = " \t" + "\n".join(f"v{i}" for i in range(60)) + " "
    rows = [(1, first, "en", "a"), (2, near, "en", "a"), (2, other, "en", "a"), (3, other + " end", "en", "a"), (None, near, "en", "a")]
    kept = minhash.near_dedup(documents(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, first), (2, other), (None, near)], key=repr)
