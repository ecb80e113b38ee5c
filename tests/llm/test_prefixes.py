import random

import numpy as np
import pytest
from cases import CLASHING, MIDDLE, remainder, sha, words
from pyspark.sql import functions as F

from patronly.llm import prefixes, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def trie(lists):
    """conv_id -> list of (role, text): the nodes, by dictionaries."""
    members = {}
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for prefix in members:
        if prefix:
            kids.setdefault(prefix[:-1], []).append(prefix)

    def below(prefix):
        own = (len(members[prefix]) - 1) * (len(words(prefix[-1][1])) if prefix else 0)
        leaves, saved = (0, own) if prefix in kids else (1, own)
        for kid in kids.get(prefix, ()):
            a, b = below(kid)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for prefix, ids in members.items():
        ends = sorted(c for c in ids if len(lists[c]) == len(prefix))
        out.append((min(ids), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(ids), len(kids.get(prefix, ())),
                    *below(prefix), sha(",".join(map(str, ends)).encode())))
    return sorted(out, key=repr)


def ordered(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in out.items()}


def rebuilt(lists):
    out = {}
    for c, turns in lists.items():
        h, head = remainder(c, 4), c - int(np.fmod(c, 20))
        out[c] = lists.get(head, [])[:h] + turns[h:]
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 2048])
def test_trie_equals_brute_force_for_any_block(spark, block):
    draw = random.Random(block)
    rows = []
    for c in range(60):
        n = draw.choice([1, 1, 2, 3, 5, 8])
        same = c % 3 == 0  # a third of all conversations are one conversation
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "same words here" if same else draw.choice(["a b", "c", "", "d e f"]))
                 for t in range(4 if same else n)]
    rows += [(200, 0, "user", "x y " * 500)] + [(201, t, "user", "long") for t in range(300)] + [(202, t, "user", "long") for t in range(299)]
    lists = ordered(rows)
    assert found(prefixes.prefix_trie(prefixes.turn_lists(spark.createDataFrame(rows, SCHEMA)), block)) == trie(lists)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_prefix_trie(spark, MIDDLE)) == trie(rebuilt(ordered(rows)))


def test_edges(spark):
    rows = [(1, 1, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (1, None, "assistant", "first"), (None, 0, "user", "n"),
            (-3, 0, "user", "a"), (-20, 0, "user", "b"), (20, 0, "user", "y" * 200_000), (21, 0, "", ""), (22, 0, None, None), (40, 5, "user", "z")]
    messages = spark.createDataFrame(rows, SCHEMA)
    for n, name in enumerate(["key", "keys", "words", "t", "turns", "number", "block", "node", "depth", "_head", "_top", *CLASHING]):
        messages = messages.withColumn(name, F.lit(n))
    lists = prefixes.turn_lists(messages)
    assert found(prefixes.prefix_trie(lists)) == trie(ordered(rows))
    assert found(prefixes.prefix_trie(queries.rebuilt(lists))) == trie(rebuilt(ordered(rows)))
    assert found(prefixes.prefix_trie(lists.limit(0))) == []
    # conversations of which nothing is left end at the root
    bare = prefixes.prefix_trie(lists.withColumn("turns", F.slice("turns", 1, 0)))
    ids = sorted(c for c in ordered(rows))
    assert found(bare) == [(min(ids), 0, None, len(ids), 0, 1, 0, sha(",".join(map(str, ids)).encode()))]


def test_extents_and_tables():
    values = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5])
    levels = prefixes.sparse_table(values)
    for k, level in enumerate(levels):
        assert level.tolist() == [min(values[i:i + 2 ** k]) for i in range(len(values) - 2 ** k + 1)]
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    low = prefixes.range_minimum(levels, *map(np.array, zip(*pairs)))
    assert low.tolist() == [min(values[i:j + 1]) for i, j in pairs]
    asks = [(p, d) for p in range(len(values) + 1) for d in range(11)]
    left, right = prefixes.extents(levels, *map(np.array, zip(*asks)))
    for (p, d), a, b in zip(asks, left, right):
        assert all(v >= d for v in values[a:b]) and a <= p <= b
        assert (a == 0 or values[a - 1] < d) and (b == len(values) or values[b] < d)


def test_common_prefixes():
    draw = random.Random(1)
    lists = [[draw.randrange(2) for _ in range(draw.randrange(6))] for _ in range(200)]
    items = np.array([(x, x) for row in lists for x in row]).reshape(-1, 2)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in lists])))
    expected = []
    for a, b in zip(lists, lists[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        expected.append(n)
    assert prefixes.common_prefixes(items, offsets).tolist() == expected
