"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DAY_MICROS = 86_400_000_000


def whole_days(start, end) -> Column:
    """Whole 24-hour periods from ``start`` to ``end`` (not calendar midnights)."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(_DAY_MICROS))


def hours_between(start, end) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600_000_000.0)


def true_or_false(flag) -> Column:
    """A nullable flag with null read as false."""
    return F.coalesce(flag, F.lit(False))


def as_int(flag) -> Column:
    return F.col(flag).cast("int") if isinstance(flag, str) else flag.cast("int")


def uniform(*keys, seed: int) -> Column:
    """A number in [0, 1) that depends only on the row's key and the seed.

    A task retry or a different partitioning cannot change it, unlike ``rand``.
    """
    return F.conv(F.substring(key_digest(*keys, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(
        4294967296.0
    )


def key_digest(*keys, seed: int) -> Column:
    """Hex digest of the key and seed: a stable pseudo-random order of rows."""
    texts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit(""))
             for k in keys]
    return F.md5(F.concat_ws(":", *texts, F.lit(str(seed))))


def cut(value, edges, labels, include_lowest: bool = True) -> Column:
    """Right-closed bins with labels; outside (or null) is null."""
    value = F.col(value) if isinstance(value, str) else value
    column = None
    for i, (low, high, label) in enumerate(zip(edges, edges[1:], labels)):
        above = value >= low if i == 0 and include_lowest else value > low
        inside = above if high == float("inf") else above & (value <= high)
        column = F.when(inside, F.lit(label)) if column is None else column.when(inside, F.lit(label))
    return column


def position(value, labels) -> Column:
    """Index of a label in an ordered label list; null when absent."""
    value = F.col(value) if isinstance(value, str) else value
    column = None
    for i, label in enumerate(labels):
        test = value == F.lit(label)
        column = F.when(test, F.lit(i)) if column is None else column.when(test, F.lit(i))
    return column
