import itertools
import random
import re

import pytest
from cases import CLASHING, MIDDLE, remainder, sha
from pyspark.sql import functions as F

from patronly.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) of (initial, fault, role, text) rows: every reachable pair of
    (rows read, initials written) by rounds of relaxation, over plain strings."""
    limit = 2 * len(rows) + 4
    best = {(0, ""): (0, "", [])}
    for read in range(len(rows) + 1):
        todo = [k for k in best if k[0] == read]
        while todo:
            k = todo.pop(0)
            cost, audit, turns = best[k]
            moves = [(k[0], x, 2, "I", ({"u": "user", "a": "assistant"}[x], "")) for x in "ua"]
            if read < len(rows):
                initial, fault, role, text = rows[read]
                moves.append((read + 1, "", 3, "D", None))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    moves.append((read + 1, initial, more, "K", (role, text)))
                    moves += [(read + 1, x, 2 + more, "R", ({"u": "user", "a": "assistant"}[x], text)) for x in "ua"]
            for to, x, price, letter, turn in moves:
                written = k[1] + x
                if letter != "D" and (not x or not re.fullmatch("s?(ua)*u?", written)) or len(written) > limit:
                    continue
                new = (cost + price, audit + letter, turns + ([turn] if turn else []))
                if (to, written) not in best or new[:2] < best[to, written][:2]:
                    best[to, written] = new
                    if to == read:
                        todo.append((to, written))
    return min((v for (read, written), v in best.items() if read == len(rows) and re.fullmatch("(s?(ua)+)?", written)), key=lambda v: v[:2])


def brute(messages):
    """One conversation, given as (turn, role, text) without nulls in role and text."""
    messages = sorted(messages, key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
    seen, rows, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in messages:
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        rows.append((role[:1], fault, role, text))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, _, _ in messages if t is not None}
    cost, audit, repaired = cheapest(rows)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), illegal, cost, audit,
            sha("\n".join(f"{r}:{t}" for r, t in repaired).encode())), repaired


def damaged(rows):
    out = {}
    for c, turn, role, text in rows:
        mine = out.setdefault(c, [])
        code = remainder(f"{' ' if c is None else c}:{' ' if turn is None else turn}", 20)
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [] if code == 0 else [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def test_parser_equals_brute_force_on_all_short_inputs():
    kinds = [(i, f) for i in "sua?" for f in ("", "truncated")] + [("u", "blank")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            now = repair.Conversation(0)
            for initial, fault in rows:
                now.open.append((initial, "x"))
                now.tops, cost, agreed = repair._advance(now.tops, initial, fault)
                now.cost += cost
                now._apply(agreed)
            now.end()
            cost, audit, _ = cheapest([(i, f, i, "x") for i, f in rows])
            assert (now.cost, "".join(now.audit)) == (cost, audit), rows
            roles = "".join(r[:1] for _, r, _ in now.turns)
            assert re.fullmatch("(s?(ua)+)?", roles) and not now.open


def test_parser_on_long_random_inputs_and_little_stays_open():
    draw = random.Random(3)
    for n in (8, 14, 60):
        for _ in range(15):
            rows = [(draw.choice("suuuaaa?"), draw.choice(["", "", "", "truncated", "blank"])) for _ in range(n)]
            now, most = repair.Conversation(0), 0
            for initial, fault in rows:
                now.open.append((initial, "x"))
                now.tops, cost, agreed = repair._advance(now.tops, initial, fault)
                now.cost += cost
                now._apply(agreed)
                most = max(most, len(now.open))
            now.end()
            if n < 20:
                assert (now.cost, "".join(now.audit)) == cheapest([(i, f, i, "x") for i, f in rows])[:2]
            assert most < n or n < 20


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_repair_conversations(spark, MIDDLE).collect()}
    expected = {c: brute(own)[0] for c, own in damaged(rows).items()}
    assert found == expected


EDGES = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi!"), (1, 1, "user", "Hi!"), (1, 2, None, "what?"), (1, 7, "assistant", "cut o"),
    (2, None, "user", "q?"), (2, None, "tool", "x"), (2, 3, "user", None), (2, 4, "assistant", " \t"), (3, 0, "user", ""), (3, 9, "", "a."),
    (None, 0, "user", "n."), (None, 1, "assistant", "y" * 200_000 + "."), (4, None, "assistant", "\U0001f600."), (5, 2, "system", "only."),
] + [(6, i, "user" if i % 3 else "assistant", f"row {i}.") for i in range(400)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_edges_and_repaired_turns(spark, partitions):
    messages = spark.createDataFrame(EDGES, SCHEMA).repartition(partitions)
    for n, name in enumerate(["present", "copy", "place", "edit", *CLASHING]):
        messages = messages.withColumn(name, F.lit(n))
    report = {r["conv_id"]: r for r in repair.repair_report(messages).collect()}
    turns = {}
    for r in sorted(repair.repaired_turns(messages).collect(), key=lambda r: (repr(r["conv_id"]), r["place"])):
        turns.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    by = {}
    for c, turn, role, text in EDGES:
        by.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert report.keys() == by.keys()
    for c, own in by.items():
        if len(own) < 20:
            expected, repaired = brute(own)
            assert tuple(report[c])[1:-1] == expected
            assert turns.get(c, []) == [(i, *t) for i, t in enumerate(repaired)]
        else:
            assert [p for p, _, _ in turns[c]] == list(range(report[c]["n_turns"]))
            assert sha("\n".join(f"{r}:{t}" for _, r, t in turns[c]).encode()) == report[c]["repaired_sha256"]
    gone = messages.withColumn("here", F.lit(False))
    assert {tuple(r)[1:] for r in repair.repair_report(gone, present="here").collect()} == {(0, 0, 0, 0, 0, 0, "", sha(b""), 0)}
    assert repair.repair_report(messages.limit(0)).count() == 0 and repair.repaired_turns(messages.limit(0)).count() == 0
