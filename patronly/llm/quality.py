"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.sums import summed
from ..session import materialize
from .text import BASES, labels_of, span_hashes, word_hashes

# Byte classes: other, lower case, upper case, digit, blank, line end, sentence marks,
# quotes and brackets, bytes of letters beyond ASCII. Fixed by this table alone.
_CLASS = np.zeros(256, np.int64)
for _number, _bytes in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c",
        b".,;:?", b"'\"()[]-", bytes(range(128, 256))), 1):
    _CLASS[list(_bytes)] = _number
CLASSES = 9
SIZE = 1 + CLASSES + CLASSES * CLASSES + 10


def features(text: str | None) -> np.ndarray:
    """What a whole text looks like: shares of byte classes and of pairs of classes,
    length, and how much it repeats itself. Null counts as empty."""
    out = np.zeros(SIZE)
    out[0] = 1.0
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    kinds = _CLASS[raw]
    out[1:1 + CLASSES] = np.sqrt(np.bincount(kinds, minlength=CLASSES) / len(raw))
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    out[1 + CLASSES:1 + CLASSES + CLASSES * CLASSES] = np.sqrt(pairs / len(raw))
    words = word_hashes(data)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    lines = span_hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends, BASES[0])
    n, m = max(1, len(words)), len(lines)
    kinds_of_words, times = np.unique(words, return_counts=True)
    kinds_of_lines, line_times = np.unique(lines, return_counts=True)
    following = np.unique(words[:-1] * np.uint64(31) + words[1:]) if len(words) > 1 else words
    out[-10:] = (
        math.log1p(len(raw)), math.log1p(n), len(raw) / n, len(kinds_of_words) / n, len(following) / n,
        (times.max() if len(times) else 0) / n, len(kinds_of_lines) / m, line_times.max() / m, math.log1p(n / m),
        math.log1p(len(set(data)))
    )
    return out


def feature_table(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows (doc_id, trusted, part, x) of every document; ``trusted`` has the
    ids (label_id) of the positives. ``part`` cuts rows in five by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"],
                                "x": [features(t).astype(np.float32).tobytes() for t in batch["text"]]})

    made = rows.mapInPandas(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x binary")
    marks = trusted.select("label_id", F.lit(True).alias("trusted"))
    return materialize(made.join(marks, made["doc_id"] == marks["label_id"], "left").select(
        "doc_id", F.coalesce("trusted", F.lit(False)).alias("trusted"),
        F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int").alias("part"), "x"))


SPREAD = 4.0  # features are cut at so many standard deviations from their mean


def _block(batch: pd.DataFrame, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.frombuffer(b"".join(batch["x"]), np.float32).reshape(-1, SIZE).astype(np.float64)
    return np.clip((x - shift) / scale, -SPREAD, SPREAD)


def _summed(table: DataFrame, sums) -> np.ndarray:
    """Sums over all rows of a stored table, added up as a tree over its tasks."""
    return summed(table, table.rdd.getNumPartitions(), sums)


class Model:
    def __init__(self, weights, shift, scale, prior):
        self.weights, self.shift, self.scale, self.prior = weights, shift, scale, prior


def _risk_sums(table: DataFrame, w: np.ndarray, shift, scale):
    """Over all rows at weights ``w``: counts, losses, gradient sums and curvature."""
    def sums(batch):
        x, p = _block(batch, shift, scale), batch["trusted"].to_numpy(bool) & (batch["part"].to_numpy() != 0)
        z = x @ w
        s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        soft = np.logaddexp(0, z)
        head = np.zeros((3, SIZE))
        head[0, :4] = len(x), p.sum(), soft.sum(), soft[p].sum()
        head[0, 4] = (soft[p] - z[p]).sum()
        head[1], head[2] = x[p].sum(axis=0), s @ x
        return np.vstack((head, (x * (s * (1 - s))[:, None]).T @ x))

    total = _summed(table, sums)
    n, n_p, soft_u, soft_p, plus_p = total[0, :5]
    return n, max(n_p, 1.0), soft_u / n, soft_p / max(n_p, 1.0), plus_p / max(n_p, 1.0), total[1], total[2], total[3:]


def _minimise(table, w, prior, shift, scale, ridge, steps, tolerance):
    """Newton steps on prior*E_P[l(z)] + max(0, E_U[l(-z)] - prior*E_P[l(-z)]), l logistic.

    While the second part, the risk on negatives, is positive, the risk equals the
    unbiased one, which is convex for this loss. A step that would push that part below
    zero (overfitting) is halved, and the search ends at the border where it stays zero.
    """
    step = np.zeros_like(w)
    penalty = np.full(len(w), ridge)
    penalty[0] = 0
    before = math.inf
    for _ in range(steps):
        n, n_p, soft_u, soft_p, plus_p, sum_p, sum_u, curve = _risk_sums(table, w + step, shift, scale)
        negative = soft_u - prior * soft_p
        risk = prior * plus_p + max(0.0, negative) + 0.5 * float(penalty @ (w + step) ** 2)
        if (negative < 0 or risk > before + 1e-12) and np.abs(step).max() > tolerance:
            step = step / 2
            continue
        w, gain, before = w + step, before - risk, risk
        gradient = sum_u / n - prior * sum_p / n_p + penalty * w
        step = -np.linalg.solve(curve / n + np.diag(penalty + 1e-9), gradient)
        if gain < tolerance or np.abs(gradient).max() < tolerance:
            break
    return w


def _prior(table: DataFrame, w, shift, scale, bins: int = 1000) -> float:
    """Share of positives among all rows, from the best bin: where the share of rows
    scored at least c, divided by that of trusted rows not fitted on, is smallest, with
    an allowance for the chance error of both shares. Every row is counted."""
    def sums(batch):
        z = _block(batch, shift, scale) @ w
        at = np.minimum(bins - 1, (bins / (1 + np.exp(-np.clip(z, -500, 500)))).astype(int))
        p = batch["trusted"].to_numpy(bool) & (batch["part"].to_numpy() == 0)
        return np.stack((np.bincount(at, minlength=bins), np.bincount(at[p], minlength=bins))).T.astype(float)

    counts = _summed(table, sums)
    n_u, n_p = counts.sum(axis=0)
    if not n_p:
        return 0.5
    share_u, share_p = (counts[::-1].cumsum(axis=0)[::-1] / (n_u, n_p)).T
    slack = math.sqrt(math.log(40) / 2 / n_u) + math.sqrt(math.log(40) / 2 / n_p)
    seen = share_p > 0
    best = np.argmin((share_u[seen] + 1.01 * slack) / share_p[seen])
    return float(np.clip(share_u[seen][best] / share_p[seen][best], 0.01, 0.99))


def fit(table: DataFrame, rounds: int = 2, ridge: float = 1e-3, steps: int = 12, tolerance: float = 1e-5) -> Model | None:
    """Fit on all rows of a feature table: trusted rows are the positives, every row is
    an unlabelled one. The class prior starts at one half and is estimated anew after
    each fit; the last fit uses the last estimate. Without trusted rows: None."""
    def moments(batch):
        x = np.frombuffer(b"".join(batch["x"]), np.float32).reshape(-1, SIZE).astype(np.float64)
        return np.stack((x.sum(axis=0), (x * x).sum(axis=0), np.full(SIZE, float(len(x)))))

    if not table.filter("trusted and part <> 0").limit(1).count():
        return None
    first, second, n = _summed(table, moments)
    shift = first / n
    scale = np.sqrt(np.maximum(0, second / n - shift ** 2))
    scale[scale < 1e-6] = 1.0
    shift[0], scale[0] = 0.0, 1.0
    prior = 0.5
    for left in reversed(range(rounds)):
        weights = _minimise(table, np.zeros(SIZE), prior, shift, scale, ridge, steps, tolerance)
        if left:
            prior = _prior(table, weights, shift, scale)
    return Model(weights, shift, scale, prior)


def score_table(table: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score, the estimated chance that a text is good (0 if nothing was learned)."""
    if model is None:
        return table.select("doc_id", F.lit(0.0).alias("score"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = _block(batch, model.shift, model.scale) @ model.weights
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -500, 500)))})

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInPandas(score, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality") -> tuple[DataFrame, Model | None]:
    """Score every document; ``usable`` is a condition on label_id that says which labels
    may be learned from. Only labels of 1 are used, as trusted positives; all other texts
    are unlabelled web text.

    Null and empty texts have the same (nearly zero) features and get their score.
    Repeated rows each get a row. Extra columns are ignored; null labels do not count.
    """
    trusted = labels_of(labels, id_col, label_col).filter(usable).filter("label = 1")
    table = feature_table(docs, trusted, id_col, text_col)
    model = fit(table)
    return score_table(table, model), model
