"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .text import mix, tidy

UNKNOWN = "und"
PIECE = 1 << 16  # characters scored at once; longer texts are summed piece by piece
ENTRIES = 1 << 20  # products of counts and log-probabilities made at once

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Per code point: is it a letter (built once per Python worker)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _letter_words(text: str) -> np.ndarray:
    """Lower-case code points with every run of other characters as one space, and a
    space at both ends; empty if the text has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    points = np.where(letter, points, 32)
    keep = letter | np.concatenate(([True], letter[:-1]))
    points = points[keep]
    head = [] if points[0] == 32 else [32]
    tail = [] if points[-1] == 32 else [32]
    return np.concatenate((head, points, tail)).astype(np.uint64)


def gram_buckets(points: np.ndarray, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Bucket numbers of all n-grams of a sequence of code points."""
    found = []
    for n in sizes:
        if len(points) >= n:
            h = np.zeros(len(points) - n + 1, np.uint64)
            for i in range(n):
                h = h * np.uint64(1_000_003) + points[i:len(points) - n + 1 + i]
            found.append((mix(h + np.uint64(n << 56)) & np.uint64(buckets - 1)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _pieces(points: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of a long sequence, and how many leading points the part repeats."""
    for start in range(0, len(points), PIECE):
        yield points[max(0, start - overlap):start + PIECE], min(start, overlap)


def _text_counts(text: str, sizes: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    points = _letter_words(text)
    for part, repeated in _pieces(points, max(sizes) - 1):
        # the n-grams that lie wholly in the repeated points belong to the part before
        yield np.concatenate([gram_buckets(part[max(0, repeated - n + 1):], (n,), buckets) for n in sizes])


def _log_sums(texts, logs: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the summed log-probabilities of its n-grams, and whether it has any.

    The n-grams of many texts form one sparse matrix, kept as its entries in the order of
    texts (an n-gram that comes twice is two entries of one). It is multiplied with the
    table of log-probabilities in blocks of ``ENTRIES`` products.
    """
    totals, seen = np.zeros((len(texts), logs.shape[1])), np.zeros(len(texts), bool)
    rows, found, held = [], [], 0

    def multiply():
        if rows:
            starts = np.concatenate(([0], np.cumsum([len(f) for f in found])))[:-1]
            np.add.at(totals, rows, np.add.reduceat(logs[np.concatenate(found)], starts, axis=0, dtype=np.float64))
            rows.clear()
            found.clear()

    for i, text in enumerate(texts):
        for grams in _text_counts(text or "", sizes, buckets):
            rows.append(i)
            found.append(grams)
            held += len(grams)
            seen[i] = True
            if held * logs.shape[1] > ENTRIES:
                multiply()
                held = 0
    multiply()
    return totals, seen


class Model:
    """Log-probabilities of the buckets per language, in blocks of at most
    ``block`` languages, so that one broadcast holds block x buckets numbers."""

    def __init__(self, names: list[str], blocks: list, sizes: tuple[int, ...], buckets: int, block: int):
        self.names, self.blocks, self.sizes, self.buckets, self.block = names, blocks, sizes, buckets, block


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sizes: tuple[int, ...] = (1, 2, 3),
        buckets: int = 1 << 15, smoothing: float = 0.1, block: int = 64) -> Model:
    """Learn from every row with a text and a label; both counts are sums over all rows.

    Tasks add up n-gram counts per label and bucket and Spark sums them, so what reaches
    the driver is languages x buckets numbers, whatever the number of rows. Rows with a
    text without letters (null and empty ones included) or a null label teach nothing, nor
    do they count for a label's share. No rows give a model without labels.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.filter("label is not null and text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                for n, found in enumerate(_text_counts(text, sizes, buckets)):
                    if not n:  # a text that gives no n-gram teaches nothing, its label neither
                        texts[label] = texts.get(label, 0) + 1
                    if label not in sums:
                        sums[label] = np.zeros(buckets, np.int64)
                    sums[label] += np.bincount(found, minlength=buckets)
                if len(sums) > block:
                    yield from flush(sums, texts)
        yield from flush(sums, texts)

    def flush(sums, texts):
        for label, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"label": label, "bucket": np.append(at, -1).astype("int32"),
                                "n": np.append(total[at], texts[label])})
        sums.clear()
        texts.clear()

    sums = (rows.mapInPandas(tidy(count), "label string, bucket int, n long")
            .groupBy("label", "bucket").agg(F.sum("n").alias("n"))
            .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts")).orderBy("label"))
    spark, names, blocks, matrix, priors = labelled.sparkSession, [], [], [], []

    def close():
        if matrix:
            blocks.append(spark.sparkContext.broadcast((np.stack(matrix, axis=1), np.array(priors))))
            matrix.clear()
            priors.clear()

    for row in sums.toLocalIterator():
        total = np.full(buckets, smoothing)
        for bucket, n in row["counts"]:
            if bucket < 0:
                priors.append(float(np.log(n)))
            else:
                total[bucket] += n
        names.append(row["label"])
        matrix.append(np.log(total / total.sum()).astype(np.float32))
        if len(matrix) == block:
            close()
    close()
    return Model(names, blocks, tuple(sizes), buckets, block)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The most likely label of every text, and its posterior probability as ``score``.

    A text that is null or has no letter gets ``und`` and 0; so does every text if
    nothing was learned. Equal likelihoods go to the label that sorts first. Texts of
    any length are scored whole, piece by piece. Repeated rows each get a row; other columns
    than ``keep`` go; an empty table gives an empty result.
    """
    rows = docs.select(*keep, F.col(text_col).alias("_text"), F.lit(-1).alias("_best"),
                       F.lit(float("-inf")).alias("_most"), F.lit(float("-inf")).alias("_all"))
    sizes, buckets, step = model.sizes, model.buckets, model.block

    def scorer(number: int, table):
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            logs, priors = table.value
            for batch in batches:
                best, most, every = (batch[c].to_numpy(copy=True) for c in ("_best", "_most", "_all"))
                totals, seen = _log_sums(batch["_text"], logs, sizes, buckets)
                totals, at = totals[seen] + priors, np.arange(int(seen.sum()))
                top = totals.argmax(axis=1)
                here, whole = totals[at, top], np.logaddexp.reduce(totals, axis=1)
                better = here > most[seen]
                best[seen] = np.where(better, number * step + top, best[seen])
                most[seen] = np.where(better, here, most[seen])
                every[seen] = np.logaddexp(every[seen], whole)
                yield batch.assign(_best=best, _most=most, _all=every)
        return score

    for number, table in enumerate(model.blocks):
        rows = rows.mapInPandas(tidy(scorer(number, table)), rows.schema)
    names = F.array(*[F.lit(n) for n in model.names]) if model.names else F.lit(None).cast("array<string>")
    found = F.col("_best") >= 0
    return rows.select(
        *keep, F.when(found, F.element_at(names, F.col("_best") + 1)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(found, F.least(F.lit(1.0), F.exp(F.col("_most") - F.col("_all")))).otherwise(0.0).alias("score"))


def keep_known(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "lang") -> DataFrame:
    """The documents in a recognised language, with their columns.

    Rejected are texts that are null or have no letter. Where nothing could be learned
    (no labelled row), texts with a letter stay.
    """
    model = fit(train, text_col, label_col)
    if not model.names:
        return docs.filter(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    columns = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    text = f"_c{columns.index(text_col)}"
    known = predict(renamed, model, text, tuple(renamed.columns)).filter(F.col("lang_pred") != UNKNOWN)
    return known.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
