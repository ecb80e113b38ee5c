"""Larger batches for work on numbers, where Arrow hands over small ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

ROWS = 1 << 14  # rows of numbers that are worked on at once


def joined_batches(batches: Iterator[pd.DataFrame], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """The same rows in the same order, ``rows`` or a little more at a time.

    ``prepare`` keeps Arrow's batches small because texts may be long; a model of numbers
    spends its time on calls per batch then, not on rows.
    """
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += len(batch)
        if size >= rows:
            yield pd.concat(kept, ignore_index=True)
            kept, size = [], 0
    if size:
        yield pd.concat(kept, ignore_index=True)
