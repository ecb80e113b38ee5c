"""Toxicity classifier, regularised with swapped identity terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .text import labels_of, tidy

# Identity terms by group; the first of a group is its neutral word.
IDENTITY_TERMS = {
    "gender": ["people", "women", "woman", "men", "man", "female", "male", "transgender", "nonbinary"],
    "faith": ["believers", "christian", "christians", "muslim", "muslims", "jew", "jews", "jewish", "hindu", "hindus",
              "buddhist", "buddhists", "atheist", "atheists"],
    "origin": ["residents", "black", "white", "asian", "asians", "african", "africans", "latino", "latinos", "arab",
               "arabs", "american", "americans", "mexican", "mexicans", "chinese", "indian", "indians", "immigrant",
               "immigrants", "refugee", "refugees"],
    "orientation": ["persons", "gay", "gays", "lesbian", "lesbians", "bisexual", "straight", "queer"],
    "body": ["adults", "disabled", "blind", "deaf", "elderly", "old", "young"],
    "german": ["leute", "frauen", "männer", "juden", "muslime", "christen", "ausländer", "flüchtlinge", "schwule"],
    "french": ["gens", "femmes", "hommes", "juifs", "musulmans", "chrétiens", "étrangers", "réfugiés", "homosexuels"],
    "spanish": ["gente", "mujeres", "hombres", "judíos", "musulmanes", "cristianos", "extranjeros", "refugiados"],
}


STEMS = (5, 7)


def words_in(text: Column) -> Column:
    """The lower-case runs of letters of a text, in order; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def features(words: Column) -> Column:
    """The different words, and the beginnings of longer ones (5 and 7 letters and a star),
    which stand for inflected forms."""
    words = F.array_distinct(words)
    return F.array_distinct(F.concat(words, *[_stems(words, n) for n in STEMS]))


def _stems(words: Column, n: int) -> Column:
    longer = F.filter(words, lambda w: F.char_length(w) > n)
    return F.transform(longer, lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*")))


def telling_words(labelled: DataFrame, size: int = 2000, least: int = 3, evidence: float = 12.0) -> list[str]:
    """Features whose presence goes with the label, from counts over the rows to be fitted.

    For each feature, rows with it are counted per label (a reduced shuffle), and the
    log-likelihood ratio says how much more the label depends on it than chance explains.
    Kept are the ``size`` strongest beyond ``evidence``: the size of the model.
    """
    total = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    n, k = float(total["n"] or 0), float(total["k"] or 0)
    if not 0 < k < n:
        return []
    word = (labelled.select("label", F.explode(features(words_in(F.col("text")))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("a"), F.sum("label").alias("b")).filter(F.col("a") >= least))
    a, b = F.col("a"), F.col("b")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(b, a * (k / n)) + part(a - b, a * (1 - k / n)) + part(k - b, (n - a) * (k / n))
                 + part(n - a - k + b, (n - a) * (1 - k / n)))
    return [r["word"] for r in word.withColumn("ratio", ratio).filter(F.col("ratio") >= evidence)
            .orderBy(F.desc("ratio"), "word").limit(size).collect()]


def _swaps(terms: dict[str, list[str]]) -> dict[str, tuple[str, str]]:
    """For each identity term, the neutral word and the next term of its group."""
    out = {}
    for group in terms.values():
        for i, term in enumerate(group[1:], 1):
            out[term] = (group[0], group[i % (len(group) - 1) + 1])
    return out


def counterfactuals(labelled: DataFrame, terms: dict[str, list[str]] = IDENTITY_TERMS) -> DataFrame:
    """What swapping identity terms does to the features of labelled sentences.

    A text is cut into sentences at ``.``, ``!``, ``?`` and line ends. For each identity term
    of a sentence and each of its swaps the term is replaced in the sentence's words and all
    features are taken again. Returns (gone, come, n): features lost and gained by a swap,
    and how many swaps change just these; as many rows as terms have ways to change.
    """
    swaps = _swaps(terms)
    asks = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(o).alias("other")) for t, others in swaps.items() for o in others])
    sentences = labelled.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[.!?\n]+")).alias("sentence"))
    named = sentences.select(words_in(F.col("sentence")).alias("words")).filter(
        F.arrays_overlap("words", F.array(*[F.lit(t) for t in swaps])))
    swapped = named.select("words", F.explode(F.filter(asks, lambda a: F.array_contains(F.col("words"), a["term"]))).alias("a"))
    before = features(F.col("words"))
    after = features(F.transform("words", lambda w: F.when(w == F.col("a.term"), F.col("a.other")).otherwise(w)))
    return (swapped.select(F.sort_array(F.array_except(before, after)).alias("gone"), F.sort_array(F.array_except(after, before)).alias("come"))
            .groupBy("gone", "come").agg(F.count("*").alias("n")).orderBy("gone", "come"))


class Model:
    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every value of every list."""
    return (np.repeat(np.arange(len(lists)), [len(x) for x in lists]),
            np.concatenate(lists) if lists else np.zeros(0, np.int64))


def minimise(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, gone: list[np.ndarray], come: list[np.ndarray],
             times: np.ndarray, size: int, fairness: float, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the weighted mean logistic loss + ``fairness`` times
    the mean squared change of the score before the logistic under swaps + ``ridge`` / 2
    times the squared weights, by ``rounds`` steps with decaying rates."""
    at, col = _flat(rows)
    gone_at, gone_col = _flat(gone)
    come_at, come_col = _flat(come)
    share, times = weight / weight.sum(), times / max(1, times.sum())
    positive = float(share @ label)
    w = np.zeros(size + 1)
    w[-1] = np.log(positive / (1 - positive))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(at, w[col], len(rows)) + w[-1]
        error = share * (1 / (1 + np.exp(-z)) - label)
        gradient = np.append(np.bincount(col, error[at], size), error.sum())
        gradient[:-1] += ridge * w[:-1]
        if len(gone):
            change = np.bincount(gone_at, w[gone_col], len(gone)) - np.bincount(come_at, w[come_col], len(gone))
            pull = 2 * fairness * times * change
            gradient[:-1] += np.bincount(gone_col, pull[gone_at], size) - np.bincount(come_col, pull[come_at], size)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        rate = 0.2 * (1 - step / (rounds + 1))
        w -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, terms: dict[str, list[str]] = IDENTITY_TERMS, fairness: float = 10.0, ridge: float = 2e-5,
        rounds: int = 500) -> Model | None:
    """Fit on the rows of ``labelled_rows``: (doc_id, label, weight, text).

    The features are those that tell the labels apart and those of the identity terms.
    ``fairness`` weighs the mean squared change of the score under the swaps of
    ``counterfactuals``, so that naming a group says nothing by itself. The driver gets
    the feature numbers of the sampled rows, a bounded table. None if only one label, or
    no row at all, was seen.
    """
    swaps = counterfactuals(labelled, terms).collect()
    named = labelled.sparkSession.range(1).select(features(F.array(*[F.lit(t) for g in terms.values() for t in g]))).first()[0]
    vocabulary = sorted({*telling_words(labelled), *named, *(f for r in swaps for f in (*r["gone"], *r["come"]))})
    number = {w: i for i, w in enumerate(vocabulary)}

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.array([number[w] for w in words if w in number], np.int32).tobytes() for words in batch["f"]]
            yield pd.DataFrame({"label": batch["label"], "weight": batch["weight"], "known": found})

    rows = (labelled.select("label", "weight", features(words_in(F.col("text"))).alias("f"))
            .mapInPandas(tidy(known), "label int, weight double, known binary").collect())
    label = np.array([r["label"] for r in rows], float)
    if not 0 < label.sum() < len(label):
        return None
    weight = np.array([r["weight"] for r in rows])
    at = [np.frombuffer(bytes(r["known"]), np.int32).astype(np.int64) for r in rows]
    gone, come = ([np.array([number[f] for f in r[c]], np.int64) for r in swaps] for c in ("gone", "come"))
    times = np.array([r["n"] for r in swaps], float)
    weights, bias = minimise(at, label, weight, gone, come, times, len(vocabulary), fairness, ridge, rounds)
    return Model(vocabulary, weights, bias)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text (0 to 1). Null and empty texts get the score of no words;
    without a model every score is 0. Repeated rows each get a row, other columns than
    ``keep`` go, an empty table gives an empty result."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    known = F.array_intersect(features(words_in(F.col(text_col))), F.array(*[F.lit(w) for w in model.vocabulary]))
    rows = docs.select(*keep, known.alias("_known"))
    weight, bias = dict(zip(model.vocabulary, model.weights.tolist())), model.bias

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = np.array([bias + sum(weight[w] for w in known) for known in batch["_known"]], float)
            yield batch.drop(columns="_known").assign(score=1 / (1 + np.exp(-z)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_known")
    return rows.mapInPandas(tidy(score), f"{kinds}, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", fit_rows: int = 20_000) -> DataFrame:
    """Stored rows (doc_id, label, weight, text) to fit on: of each label up to ``fit_rows``
    ids whose label may be learned from, those with the smallest hash.

    The ids are chosen from the labels alone and at most twice ``fit_rows`` of them are
    broadcast, so no text moves but those to be fitted. Of an id on several rows one text
    is taken, by its hash. ``weight`` is the number of labelled ids a chosen one stands for. Null ids and null labels teach nothing; extra columns are
    ignored; empty tables give an empty result.
    """
    marks = labels_of(labels, id_col, label_col).filter(usable).filter("label in (0, 1)")
    total = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [marks.filter(F.col("label") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
              .withColumn("weight", F.lit(max(1.0, total.get(label, 0) / fit_rows))) for label in (0, 1)]
    picked = materialize(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    # one row per id leaves a task, however often an id stands in the table
    return materialize(found.groupBy("doc_id", "label", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
