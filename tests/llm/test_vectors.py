import numpy as np

from patronly.llm import vectors


def brute(rows, cosine=0.93):
    good = [(i, label, np.array(v, float)) for i, v, label in rows
            if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {n: 0 for n in range(len(good))}
    root = list(range(len(good)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (_, la, va), (_, lb, vb) = good[a], good[b]
            if la == lb and len(va) == len(vb) and va @ vb / np.sqrt(va @ va) / np.sqrt(vb @ vb) >= cosine:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for n, (i, _, _) in enumerate(good):
        smallest[find(n)] = min(i, smallest.get(find(n), i))
    out = [(i, links[n], smallest[find(n)], i == smallest[find(n)]) for n, (i, _, _) in enumerate(good)]
    known = {id(r) for r in rows if any(r[0] == g[0] for g in good)}
    out += [(r[0], 0, r[0], True) for r in rows if id(r) not in known]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 as size", "2 as usable", "3 as root", "4 as key", "5 as links")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clusters(seed, groups, members, noise, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.standard_normal(32)
        for _ in range(members):
            v = centre + noise * rng.standard_normal(32) * rng.random()
            rows.append((int(rng.integers(0, 10**9)), [float(np.float32(x)) for x in v], int(g % labels)))
    return rows


def test_clusters_equal_brute_force(spark):
    rows = clusters(1, 60, 4, 0.5)
    rows += [(10**9 + n, r[1], r[2]) for n, r in enumerate(rows[:30])] + [(2 * 10**9 + n, r[1], 9) for n, r in enumerate(rows[:5])]
    assert result(vectors.near_vectors(table(spark, rows))) == brute(rows)


def test_group_larger_than_window_and_block(spark):
    rows = clusters(2, 2, 160, 0.4, 1)
    assert result(vectors.near_vectors(table(spark, rows), window=8, block=50)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [], 1), (6, [1.0, None], 1),
            (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1),
            (None, [1.0, 0.0], 1), (12, [3e38, 1.0], 1), (13, [1e-38, 0.0], 1), (14, [-1.0, 0.0], 1)]
    assert result(vectors.near_vectors(table(spark, rows))) == brute(rows)
    assert vectors.near_vectors(table(spark, rows).limit(0)).count() == 0


def test_windows_reach_over_all_borders(spark):
    """Every vector meets the window after it, in its pass, label and size only."""
    rng = np.random.default_rng(3)
    rows = [(p, label, 4, int(k), 1000 * p + n, [float(x) for x in np.abs(rng.standard_normal(4)) + 5])
            for p in range(2) for n, (label, k) in enumerate((int(x) % 3, x) for x in rng.integers(-2**62, 2**62, 150))]
    hashed = spark.createDataFrame(rows, "pass int, label int, size int, key long, vec_id long, vector array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("3", "90"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = [(r["a"], r["b"]) for r in vectors._window_links(hashed, 6, -1.0, 16).collect()]  # all pairs are links
        parent = {}

        def find(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for a, b in found:
            parent[find(a)] = find(b)
        groups = {}
        for p, label, _, _, i, _ in rows:
            groups.setdefault(find(i), set()).add((p, label))
        # windows chain all vectors of a pass and label together, and none of two
        assert len(groups) == 6 and all(len(g) == 1 for g in groups.values())
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_more_partitions_than_rows_in_a_window(spark):
    rows = clusters(4, 40, 5, 0.5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        assert result(vectors.near_vectors(table(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def cone(seed, base, pairs, shared, size=64):
    """Vectors of one label with a mutual cosine of about ``shared``, and ``pairs`` more,
    each at a cosine just above 0.93 to one of them."""
    rng = np.random.default_rng(seed)
    axis = np.eye(size)[0]
    side = rng.standard_normal((base, size))
    side[:, 0] = 0
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    unit = np.sqrt(shared) * axis + np.sqrt(1 - shared) * side
    away = rng.standard_normal((pairs, size))
    away -= (away * unit[:pairs]).sum(axis=1, keepdims=True) * unit[:pairs]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.932 * unit[:pairs] + np.sqrt(1 - 0.932 ** 2) * away
    return [(n, [float(np.float32(x)) for x in v], 0) for n, v in enumerate(np.concatenate([unit, near]))]


def test_pairs_in_a_narrow_label_are_found(spark):
    rows = cone(5, 2000, 400, 0.8)
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    expected = {n: int(row.sum()) - 1 for n, row in enumerate(linked)}
    assert {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(table(spark, rows)).collect()} == expected


def test_any_number_of_signs_holds_the_miss():
    agree = 1 - np.arccos(0.93) / np.pi
    assert vectors.passes_for(0, 0.93, 1e-5) == 1
    assert all((1 - agree ** b) ** vectors.passes_for(b, 0.93, 1e-5) <= 1e-5 for b in range(1, 30))
