"""Text helpers shared by the corpus operators: columns, words as numbers, hashes.

White space is ``[\\x20\\x09-\\x0D]`` throughout, which is what ``bytes.split`` cuts at.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WHITE = " \t\n\x0b\x0c\r"

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def give_back_memory() -> None:
    """Return freed memory to the system: Python workers live on from task to task, and what
    a task of long texts has used would count against the executor for good."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on the batches of a task, giving memory back at its end."""
    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return tidied


def without_white(text: Column) -> Column:
    """The text without any white space."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id written as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def held_out(doc_id: Column, of: int, fold: int) -> Column:
    """Whether an id belongs to the held-out fold (a null id does not)."""
    return F.coalesce(remainder(doc_id, of) == fold, F.lit(False))


def may_learn(doc_id: Column, of: int, fold: int) -> Column:
    """Whether labels of an id may be learned from (those of a null id may not)."""
    return F.coalesce(remainder(doc_id, of) != fold, F.lit(False))


def labels_of(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row (label_id, label) per id; of contradicting rows the larger label counts."""
    return (labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
            .filter("label_id is not null and label is not null").groupBy("label_id").agg(F.max("label").alias("label")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each span, all spans in one pass.

    Polynomials modulo 2**64: differences of running sums, divided by a power of the
    odd ``base`` so that equal content gives equal hashes wherever it stands.
    """
    n = len(values)
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=sums[1:])
    back = _powers(inverse, n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + np.uint64(base) * (ends - starts).astype(np.uint64))


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as numbers, and where each word starts and ends."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], _IS_WHITE[raw], [True])).astype(np.int8))
    return raw, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash per word of a text in UTF-8."""
    raw, starts, ends = word_spans(data)
    return span_hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends, base)


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words (given as word hashes)."""
    starts = np.arange(max(0, len(words) - size + 1))
    return span_hashes(words, starts, starts + size, base)
