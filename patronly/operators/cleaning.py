"""Row filters, id coercion and sampling on the raw tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..constants import AFFILIATE
from ..functions.columns import key_digest


def _live(column: str = "IsDeleted"):
    """Not deleted; an unknown deletion mark counts as live."""
    return ~F.col(column).eqNullSafe(F.lit(1))


def clean_orders(orders: DataFrame, affiliate: int = AFFILIATE) -> DataFrame:
    """Live, shipped orders of one affiliate."""
    return orders.filter(_live() & (F.col("AffiliateId") == affiliate)
                         & F.col("ShippedDateTime").isNotNull())


def clean_items(items: DataFrame) -> DataFrame:
    return items.filter(_live())


def shipped_before(orders: DataFrame, cutoff: str, affiliate: int = AFFILIATE) -> DataFrame:
    """Live orders of one affiliate shipped before ``cutoff``; unreadable times drop out."""
    shipped = F.col("ShippedDateTime")
    if dict(orders.dtypes)["ShippedDateTime"] == "string":
        shipped = F.try_to_timestamp(shipped)
    return (
        orders.filter(_live() & (F.col("AffiliateId") == affiliate))
        .withColumn("ShippedDateTime", shipped)
        .filter(F.col("ShippedDateTime") < F.lit(cutoff).cast("timestamp"))
    )


def date_windows(orders: DataFrame, ranges, column: str = "ShippedDateTime") -> DataFrame:
    """Rows whose time falls in any of the half-open ``[start, end)`` ranges."""
    stamp = lambda text: F.lit(text).cast("timestamp")
    inside = [(F.col(column) >= stamp(a)) & (F.col(column) < stamp(b)) for a, b in ranges]
    return orders.filter(reduce(lambda x, y: x | y, inside))


def coerce_ids(df: DataFrame, to_text=(), to_number=()) -> DataFrame:
    """Ids to text join keys, or dirty text ids to bigint with unreadable as null."""
    return df.withColumns({
        **{c: F.col(c).cast("string") for c in to_text},
        **{c: F.col(c).try_cast("bigint") for c in to_number},
    })


def mask_filter(df: DataFrame, mask: dict | None) -> DataFrame:
    """Rows where every named column equals its value; no mask keeps all."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), (mask or {}).items(), df)


def since_cutoff(df: DataFrame, cutoff: str, column: str = "FirstOrderDate") -> DataFrame:
    return df.filter(F.col(column) >= F.lit(cutoff).cast("timestamp"))


def sample_n(df: DataFrame, n: int, key: str = "CustomerId", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), picked by a seeded order of the row key.

    A top-n over all rows would send n rows per input partition to one task, so a
    cut on the digest first leaves little more than n candidates. The cut is
    checked: should it leave fewer than n, the whole table competes.
    """
    digest = key_digest(key, seed=seed)
    total = df.count()
    if total <= n:
        return df
    share = n / total
    cut = share + 8 * math.sqrt(share / total)
    candidates = df
    if cut < 0.5:
        edge = format(int(cut * 16**8), "08x")
        below = df.filter(digest < F.lit(edge))
        if below.limit(n).count() == n:
            candidates = below
    return candidates.orderBy(digest, F.col(key)).limit(n)
