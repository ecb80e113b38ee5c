"""Boosted trees with penalised leaves, from histograms of gradients.

Each round fits one tree to the second-order expansion of the logistic loss: a leaf with
gradient sum G and curvature sum H gets the weight -soft(G) / (H + l2), where soft moves
G towards 0 by l1 and stops there. Splits are searched over bins, so a level of a tree
needs one sum per node, feature and bin over all rows, and nothing else of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.batches import joined_batches
from ..functions.quantiles import exact_quantiles
from ..functions.sums import summed
from ..session import materialize

STORE_EVERY = 10  # trees after which rows get their margins stored


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    """``g`` moved towards 0 by ``l1``, and 0 where it is nearer than that."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


@dataclass
class Tree:
    """Nodes of a tree as lists; node 0 is the root. A row goes left if its value is at most
    the threshold. ``feature`` is -1 at a leaf, whose ``value`` holds the learning rate."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)        # bin of the threshold
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1),
                          (self.value, value), (self.gain, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def leaf_of(self, values: np.ndarray, at: list) -> np.ndarray:
        """The leaf of each row, for ``values`` (rows x features) and the matching limits
        ``at``: thresholds for raw values, bins for binned ones."""
        leaf = np.zeros(len(values), np.int64)
        todo = [(0, np.arange(len(values)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                leaf[rows] = node
                continue
            low = values[:, self.feature[node]].take(rows) <= at[node]
            todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return leaf

    def margins(self, values: np.ndarray, at: list) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(values, at)]


def drawn(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) per row and tree that depends on the row's key hash only."""
    x = key.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) * 2.0 ** -53


def best_split(hist: np.ndarray, columns: list[int], l1: float, l2: float, min_child: float, min_gain: float):
    """(gain, feature, bin) of the best split of a node, or None.

    ``hist`` holds gradient and curvature sums per feature and bin. Of equal gains the
    first feature and the lowest bin win.
    """
    def score(g, h):
        return soft(g, l1) ** 2 / np.maximum(h + l2, 1e-300)  # no curvature, no gradient

    whole = hist[columns[0]].sum(axis=0)
    below = hist[columns].cumsum(axis=1)[:, :-1]
    above = whole - below
    if not below.shape[1]:
        return None
    gain = score(*np.moveaxis(below, -1, 0)) + score(*np.moveaxis(above, -1, 0)) - score(*whole)
    allowed = (below[..., 1] >= min_child) & (above[..., 1] >= min_child)
    gain = np.where(allowed, gain, -np.inf)
    f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, cut]), columns[f], int(cut)) if gain[f, cut] > min_gain else None


class PenalisedModel:
    """Trees, their features, and the loss before each round and after the last."""

    def __init__(self, features: list[str], trees: list[Tree], losses: list[float], params: dict):
        self.features, self.trees, self.losses, self.params = features, trees, losses, params

    def margins(self, values: np.ndarray) -> np.ndarray:
        return sum((t.margins(values, t.threshold) for t in self.trees), np.zeros(len(values)))

    def leaves(self) -> list:
        """(feature -> interval (low, high], value) of every leaf of every tree."""
        out = []
        for tree in self.trees:
            todo = [(0, {})]
            while todo:
                node, box = todo.pop()
                f = tree.feature[node]
                if f < 0:
                    out.append((box, tree.value[node]))
                    continue
                low, high = box.get(f, (-np.inf, np.inf))
                t = tree.threshold[node]
                todo += [(tree.left[node], {**box, f: (low, min(high, t))}), (tree.right[node], {**box, f: (max(low, t), high)})]
        return out

    def importances(self) -> list[float]:
        """Mean gain of the splits on each feature, as shares of their sum."""
        gain, times = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    gain[f] += g
                    times[f] += 1
        mean = gain / np.maximum(times, 1)
        return (mean / mean.sum() if mean.sum() else mean).tolist()

    def score(self, df: DataFrame, label: str) -> DataFrame:
        """Adds label (0/1), score (probability of 1) and margin (its log-odds)."""
        model = df.sparkSession.sparkContext.broadcast(self)
        names = [f"_x{i}" for i in range(len(self.features))]
        rows = df.withColumn("label", F.col(label).cast("int")).withColumns(
            {n: F.col(f).cast("double") for n, f in zip(names, self.features)})

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for values in joined_batches(batches):
                yield pd.Series(model.value.margins(values.to_numpy(float)))

        scored = rows.withColumn("margin", margin(F.struct(*names)))
        return scored.withColumn("score", 1 / (1 + F.exp(-F.col("margin")))).drop(*names)


BLOCK = 1 << 15  # rows stored together
_BLOCKS = "hash binary, y binary, bins binary, margin binary"


def binned(df: DataFrame, features: list[str], label: str, key: str, bins: int, share: float = 1.0) -> tuple[DataFrame, list[list[float]]]:
    """Stored blocks of rows (hash, y, bins, margin) and each feature's thresholds.

    A feature's thresholds are its exact quantiles at ``bins`` - 1 even ranks; a value's bin
    is the number of thresholds below it. Rows with a null feature or label are left out. A
    block holds the numbers of ``BLOCK`` rows or a little more as bytes, so a pass over the
    rows neither builds nor converts any row. Blocks are dealt evenly over ``share`` of the
    cluster's cores.
    """
    known = df.select(F.xxhash64(key).alias("hash"), F.col(label).cast("int").alias("y"),
                      *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna(
        subset=["y", *[f"x{i}" for i in range(len(features))]])
    known = materialize(known)
    ranks = [i / bins for i in range(1, bins)]
    cuts: list[list[float]] = [[] for _ in features]
    for r in exact_quantiles(known, {f"x{i}": ranks for i in range(len(features))}).collect():
        cuts[int(r["feature"][1:])].append(r["quantile"])
    cuts = [sorted(set(c)) for c in cuts]
    kind = _bin_type(cuts)

    def pack(batches):
        for rows in joined_batches(batches, BLOCK):
            below = np.stack([np.searchsorted(c, rows[f"x{i}"].to_numpy(float)) for i, c in enumerate(cuts)])
            yield pd.DataFrame({"hash": [rows["hash"].to_numpy(np.int64).tobytes()], "y": [rows["y"].to_numpy(float).tobytes()],
                                "bins": [below.astype(kind).tobytes()], "margin": [np.zeros(len(rows)).tobytes()]})

    spread = max(1, round(share * max(known.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)))
    return materialize(known.repartition(spread).mapInPandas(pack, _BLOCKS)), cuts


def _bin_type(cuts: list[list[float]]) -> np.dtype:
    """The smallest type that holds the number of a feature's bins."""
    return np.min_scalar_type(max(len(c) for c in cuts) + 1)


def _unpacked(batch: pd.DataFrame, kind: np.dtype):
    """(hash, y, bins as rows x features, margin) of each block."""
    for hashes, y, bins, margin in zip(*(batch[c] for c in ("hash", "y", "bins", "margin"))):
        y = np.frombuffer(y)
        yield np.frombuffer(hashes, np.int64), y, np.frombuffer(bins, kind).reshape(-1, len(y)).T, np.frombuffer(margin)


def _with_margins(blocks: DataFrame, trees: list[Tree], kind: np.dtype) -> DataFrame:
    def add(batches):
        for batch in batches:
            yield batch.assign(margin=[
                (margin + sum(t.margins(values, t.cut) for t in trees)).tobytes() for _, _, values, margin in _unpacked(batch, kind)])

    return blocks.mapInPandas(add, _BLOCKS)


def fit_penalised(df: DataFrame, features, label: str, key: str = "CustomerId", trees: int = 100, depth: int = 4,
                  rate: float = 0.1, l1: float = 1.0, l2: float = 1.0, row_share: float = 0.8, column_share: float = 0.8,
                  bins: int = 64, min_child: float = 1.0, min_gain: float = 1e-6, seed: int = 42, share: float = 1.0) -> PenalisedModel:
    """Fit boosted trees whose leaf weights carry an L1 and an L2 penalty.

    Each tree sees the rows whose draw (a hash of key, seed and tree) is below ``row_share``
    and one sample of ``column_share`` of the features, drawn once per tree. A level costs
    one pass over the blocks of binned rows: per task a matrix node x feature x bin of gradient
    and curvature sums, added up as a tree, from which the driver picks the splits. Margins of
    all trees before are stored with the blocks every ``STORE_EVERY`` trees, so a pass only
    evaluates the trees since then. ``share`` is the part of the cluster's cores to use, where
    several models are fitted at once.

    No row, or one label only, gives trees of one leaf.
    """
    features = list(features)
    rows, cuts = binned(df, features, label, key, bins, share)
    width, kind, parts = max(len(c) for c in cuts) + 1, _bin_type(cuts), max(1, rows.rdd.getNumPartitions())
    chosen = max(1, int(column_share * len(features)))
    params = dict(label=label, key=key, l1=l1, l2=l2, row_share=row_share, seed=seed, rate=rate)
    done: list[Tree] = []
    recent: list[Tree] = []
    losses: list[float] = []

    def histograms(tree: Tree, number: int, nodes: list[int]) -> np.ndarray | None:
        """For each of ``nodes``: (feature, bin, gradient and curvature) sums of its sampled
        rows; and, as one more entry, the loss and the number of all rows."""
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        before = list(recent)

        def sums(batch: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(nodes) + 1, len(features), width, 2))
            for hashes, y, values, stored in _unpacked(batch, kind):
                margin = stored + sum(t.margins(values, t.cut) for t in before)
                p = 1 / (1 + np.exp(-margin))
                out[-1, 0, 0] += (np.logaddexp(0, margin) - y * margin).sum(), len(y)
                at = place[tree.leaf_of(values, tree.cut)]
                use = np.flatnonzero((at >= 0) & (drawn(hashes, seed, number) < row_share))
                first, g, h = at[use] * width, (p - y)[use], (p * (1 - p))[use]
                for f in range(len(features)):
                    cell = first + values[:, f].take(use)
                    for c, v in enumerate((g, h)):
                        out[:-1, f, :, c] += np.bincount(cell, v, len(nodes) * width).reshape(-1, width)
            return out

        return summed(rows, parts, sums)

    for number in range(trees):
        tree = Tree()
        level = [tree.add(0.0)]
        columns = sorted(np.random.default_rng([seed, number]).permutation(len(features))[:chosen].tolist())
        for step in range(depth):
            hist = histograms(tree, number, level)
            if hist is None:
                break
            if step == 0:
                losses.append(float(hist[-1, 0, 0, 0] / max(1.0, hist[-1, 0, 0, 1])))
                tree.value[0] = _weight(hist[0, 0].sum(axis=0), l1, l2, rate)
            below = []
            for node, own in zip(level, hist[:-1]):
                found = best_split(own, columns, l1, l2, min_child, min_gain)
                if found:
                    gain, f, cut = found
                    tree.feature[node], tree.cut[node], tree.threshold[node], tree.gain[node] = f, cut, cuts[f][cut], gain
                    sides = own[f, :cut + 1].sum(axis=0), own[f, cut + 1:].sum(axis=0)
                    tree.left[node], tree.right[node] = (tree.add(_weight(s, l1, l2, rate)) for s in sides)
                    below += [tree.left[node], tree.right[node]]
            level = below
            if not level:
                break
        done.append(tree)
        recent.append(tree)
        if len(recent) == STORE_EVERY:
            rows = materialize(_with_margins(rows, recent, kind))
            parts, recent = max(1, rows.rdd.getNumPartitions()), []
    nothing = Tree()
    nothing.add(0.0)
    last = histograms(nothing, trees, [])
    if last is not None:
        losses.append(float(last[-1, 0, 0, 0] / max(1.0, last[-1, 0, 0, 1])))
    return PenalisedModel(features, done, losses, params)


def _weight(sums: np.ndarray, l1: float, l2: float, rate: float) -> float:
    g, h = sums
    return float(-soft(g, l1) / (h + l2) * rate) if h + l2 > 0 else 0.0


def leaf_rows(model: PenalisedModel, df: DataFrame, number: int) -> DataFrame:
    """What tree ``number`` was fitted on: key, leaf, weight (its value without the rate), y
    and margin (of the trees before) of each training row it sampled. With these rows the
    penalised gradient of every leaf can be summed up and must vanish."""
    p, names = model.params, [f"_x{i}" for i in range(len(model.features))]
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(p["key"]).alias("key"), F.xxhash64(p["key"]).alias("hash"), F.col(p["label"]).cast("int").alias("y"),
                     *[F.col(f).cast("double").alias(n) for n, f in zip(names, model.features)]).dropna(subset=["y", *names])

    def run(batches):
        m = shared.value
        tree, before = m.trees[number], m.trees[:number]
        for batch in joined_batches(batches):
            values = batch[names].to_numpy(float)
            leaf = tree.leaf_of(values, tree.threshold)
            margin = sum((t.margins(values, t.threshold) for t in before), np.zeros(len(values)))
            found = pd.DataFrame({"key": batch["key"], "leaf": leaf, "weight": np.array(tree.value)[leaf] / p["rate"],
                                  "y": batch["y"], "margin": margin})
            yield found[drawn(batch["hash"].to_numpy(), p["seed"], number) < p["row_share"]]

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, leaf long, weight double, y int, margin double")
