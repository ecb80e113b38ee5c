"""Every registered query with its independent DuckDB statement.

``add(name, query, sql, r=..., t=...)``: ``r`` lists the float columns and ``t`` the
time columns of the SQL result. Both sides show floats at six decimals and times as
text; that is presentation only and done here, not in the operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, TimestampNTZType, TimestampType

from . import oracle_views as sql
from .shop import Shop

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shown(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def needed_blocks(text: str) -> list[str]:
    """Names of the shared blocks a statement uses, directly or through others."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop()))
        for name in words & sql.BLOCKS.keys() - found:
            found.add(name)
            todo.append(sql.BLOCKS[name])
    return [name for name in sql.BLOCKS if name in found]


def statement(text: str, r: str = "", t: str = "") -> str:
    blocks = ",\n".join(f"{n} as ({sql.BLOCKS[n]})" for n in needed_blocks(text))
    replaced = [f"round({c}, 6) + 0.0 as {c}" for c in r.split()]
    replaced += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" for c in t.split()]
    star = f"* replace ({', '.join(replaced)})" if replaced else "*"
    return (f"with {blocks}\n" if blocks else "") + f"select {star} from ({text}) result"


def add(name: str, query: Callable[[Shop], DataFrame], text: str | None = None, r: str = "",
        t: str = "") -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = lambda spark, folder: shown(query(Shop(spark, folder)))
    if text is not None:
        ORACLES[name] = statement(text, r, t)
