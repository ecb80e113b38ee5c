"""Repeated passages: seeds on winnowed anchors, extended to whole windows of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .text import BASES, tidy, window_hashes, word_hashes


def smallest_in_runs(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` consecutive values."""
    if len(values) < size:
        return values[:0]
    step, low = 1, values
    while 2 * step <= size:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = size - step
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def window_anchors(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window of words: the smallest hash of its ``gram``-word runs.

    It depends on the window's words only, so equal windows have equal anchors: a repeat
    of at least ``window`` words cannot escape the seeds.
    """
    return smallest_in_runs(window_hashes(words, gram, BASES[0]), window - gram + 1)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _seed_table(docs: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """Stored rows (doc_id, n_words, digest, anchors), one per document."""
    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                data = (text or "").encode("utf-8", "replace")
                words = data.split()
                anchors = np.unique(window_anchors(word_hashes(data), window, gram)).view(np.int64) if len(words) >= window else []
                out.append((len(words), _digest(words), anchors))
            yield pd.DataFrame(out, columns=["n_words", "digest", "anchors"]).assign(doc_id=batch["doc_id"].to_numpy())

    return materialize(docs.mapInPandas(tidy(seeds), f"n_words long, digest binary, anchors array<long>, doc_id {kind}"))


def _seeded_texts(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Stored rows (doc_id, text, shared): the texts that hold an anchor which also stands
    under another id, with those anchors. Of equal word sequences one text is used."""
    texts = seeds.filter("doc_id is not null and n_words > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("anchors").alias("anchors"))
    found = materialize(texts.select("doc_id", F.explode("anchors").alias("anchor")))
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    mine = (found.join(shared.select("anchor"), "anchor").groupBy("doc_id")
            .agg(F.collect_list("anchor").alias("shared")).withColumnRenamed("doc_id", "_id"))
    return materialize(docs.join(mine, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "shared"))


def _candidate_windows(texts: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """(first, second, doc_id, key, at): a hash of 95 bits, in two parts, of every window
    around a shared anchor, and where it starts. ``key``, from the digest, tells apart
    several texts of one id."""
    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, shared in zip(batch["doc_id"], batch["text"], batch["shared"]):
                data = (text or "").encode("utf-8", "replace")
                words = word_hashes(data)
                at = np.flatnonzero(np.isin(window_anchors(words, window, gram), np.asarray(shared, np.int64).view(np.uint64)))
                if len(at):
                    yield pd.DataFrame({
                        "first": window_hashes(words, window, BASES[0])[at].view(np.int64),
                        "second": (window_hashes(words, window, BASES[1])[at] >> np.uint64(33)).astype("int32"),
                        "doc_id": doc_id, "key": _key(_digest(data.split())), "at": at.astype("int32")})

    return texts.mapInPandas(tidy(extend), f"first long, second int, doc_id {kind}, key int, at int")


def _key(digest: bytes) -> np.int32:
    return np.int32(int.from_bytes(digest[:4], "big", signed=True))


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return edge[:-1].cumsum() > 0


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                      gram: int = 16, with_text: bool = False) -> DataFrame:
    """Remove each word that lies in a window of ``window`` words which also starts in a
    document with a smaller id.

    Seed: every window has an anchor chosen by its words alone; anchors that stand in more
    than one text are the seeds, found by one sum per anchor over all texts. Extend: of a
    text with seeds, all windows around them are hashed (95 bits) and the smallest id per
    window is found; a document's windows with a smaller id than its own are repeats.
    Overlapping ones unite to maximal repeats, which are cut out. No pairs of documents are
    made: a passage in m documents costs m rows. Texts with equal word sequences take part
    once; all but the one with the smallest id are removed whole (if they have a window).

    Null and empty texts have no words. A row with a null id is neither a source nor
    changed. Rows with the same id are one document as a source and keep their repeats of
    each other. Extra columns are ignored; an empty table gives an empty result.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if ``with_text``, kept_text (null
    where nothing was removed).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    seeds = _seed_table(rows, kind, window, gram)
    texts = _seeded_texts(rows, seeds)
    windows = _candidate_windows(texts, kind, window, gram)
    sources = windows.groupBy("first", "second").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).filter("source < last")
    starts = (windows.join(sources, ["first", "second"]).filter("source < doc_id")
              .groupBy("doc_id", "key").agg(F.collect_list("at").alias("starts")))
    hits = starts.select(F.col("doc_id").alias("_id"), "key", "starts")
    cut = texts.select("doc_id", "text").join(hits, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "key", "starts")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, key, starts in zip(batch["text"], batch["key"], batch["starts"]):
                words = (text or "").encode("utf-8", "replace").split()
                digest = _digest(words)
                if _key(digest) != key:  # another text of the same id
                    out.append((None, None, None, None))
                    continue
                gone = covered(np.asarray(starts, np.int64), window, len(words))
                kept = [w for w, g in zip(words, gone) if not g]
                text_left = b" ".join(kept).decode("utf-8", "replace") if with_text else None
                out.append((int(gone.sum()), _digest(kept), text_left, digest))
            done = pd.DataFrame(out, columns=["removed", "kept", "kept_text", "_digest"])
            yield done.assign(_id=batch["doc_id"].to_numpy())

    changed = cut.mapInPandas(tidy(remove), f"removed long, kept binary, kept_text string, _digest binary, _id {kind}").filter("removed is not null")
    changed = changed.dropDuplicates(["_id", "_digest"])  # repeated rows of one id
    first = seeds.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("owner"))
    first = first.select(F.col("digest").alias("_first"), "owner")
    whole = F.coalesce((F.col("owner") < F.col("doc_id")) & (F.col("n_words") >= window), F.lit(False))
    every = seeds.select("doc_id", "n_words", "digest").join(first, F.col("digest") == F.col("_first"), "left")
    every = every.join(changed, (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    nothing = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    result = every.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(whole, nothing).otherwise(F.coalesce("kept", "digest")))).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))
    return result
