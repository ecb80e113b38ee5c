"""Sums of matrices over all rows of a table, without a row per task on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FAN_IN = 32  # partial sums that one task adds up


def summed(table: DataFrame, partitions: int, of: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of(batch)``, a matrix of one shape, over all batches of rows.

    Each of the table's ``partitions`` tasks returns one matrix. While there are more than
    ``FAN_IN`` of them, tasks add up that many each, so the driver gets ``FAN_IN`` at most,
    whatever the number of tasks. None for a table without rows.
    """
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                one = np.asarray(of(batch), float)
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"shape": [list(total.shape)], "v": [total.tobytes()]})

    def read(shape, v) -> np.ndarray:
        return np.frombuffer(bytes(v)).reshape([int(n) for n in shape])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, shape = None, None
        for batch in batches:
            for shape, v in zip(batch["shape"], batch["v"]):
                total = read(shape, v) if total is None else total + read(shape, v)
        if total is not None:
            yield pd.DataFrame({"shape": [list(total.shape)], "v": [total.tobytes()]})

    kind = "shape array<int>, v binary"
    rows, count = table.mapInPandas(part, kind), partitions
    while count > FAN_IN:
        count = math.ceil(count / FAN_IN)
        rows = rows.repartition(count).mapInPandas(merge, kind)
    found = [read(r["shape"], r["v"]) for r in rows.collect()]
    return sum(found[1:], found[0]) if found else None
