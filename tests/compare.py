"""Run registered queries and compare each with its DuckDB statement.

    python tests/compare.py [folder] [name-pattern ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("set threads=4")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, folder, name, query, text) -> str:
    """"" when equal, else what differs."""
    df = query(spark, folder)
    mine = table(df.columns, df.collect())
    if text is None:
        return "" if mine[1] else "no rows"
    found = connection.execute(text)
    theirs = table([d[0] for d in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    types = {d[0]: str(d[1]) for d in found.description}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if kinds.get(t, t) != types[c]]
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} vs {len(theirs[1])}"
    different = [(a, b) for a, b in zip(*[mine[1], theirs[1]]) if a != b]
    if different:
        return f"{len(different)} of {len(mine[1])} rows differ, e.g.\n   {mine[0]}\n   {different[0][0]}\n   {different[0][1]}"
    if wrong:
        return "types " + ", ".join(wrong)
    return ""


def main():
    import __spark_entry__ as entry
    from patronly.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    patterns = sys.argv[2:]
    spark, connection = local_session(8), duck(folder)
    oracles, bad = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if patterns and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in patterns):
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name, query, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(error))[:1500]
        mark = "ok " if not problem else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s{'' if name in oracles else ' (rows only)'} {problem}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} bad: {' '.join(bad)}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
