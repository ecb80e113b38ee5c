"""Per-row additive attributions of boosted trees against a background table.

Each leaf is a box over the features on its path. Whether a row and a background
row lie inside the box, feature by feature, fixes the Shapley value of every path
feature for that leaf; the background is therefore folded once into a small table
per leaf, and a row only looks its own pattern up.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.batches import joined_batches
from .boosting import PenalisedModel


def _leaves(node, boxes: dict, scale: float, out: list) -> None:
    if node.subtreeDepth() == 0:
        out.append((dict(boxes), node.prediction() * scale))
        return
    split = node.split()
    f, t = split.featureIndex(), split.threshold()
    low, high = boxes.get(f, (-np.inf, np.inf))
    _leaves(node.leftChild(), {**boxes, f: (low, min(high, t))}, scale, out)
    _leaves(node.rightChild(), {**boxes, f: (max(low, t), high)}, scale, out)


def model_leaves(model) -> list:
    """(feature -> interval (low, high], weighted value) per leaf of a boosted model."""
    if isinstance(model, PenalisedModel):
        return model.leaves()
    out: list = []
    for tree, weight in zip(model.trees, model.treeWeights):
        _leaves(tree._call_java("rootNode"), {}, weight, out)
    return out


def _inside(values: np.ndarray, box) -> np.ndarray:
    """Bit pattern per row: which path features lie in the leaf's box."""
    kind = np.min_scalar_type((1 << len(box)) - 1)
    code = np.zeros(len(values), dtype=kind)
    for j, (f, (low, high)) in enumerate(box):
        code |= ((values[:, f] > low) & (values[:, f] <= high)).astype(kind) << kind.type(j)
    return code


class Grid:
    """The thresholds of a model's leaves per feature. A value's place among them is a small
    number that lies inside the box of places exactly where the value lies inside the box, and
    many leaves compare small numbers faster than values."""

    def __init__(self, leaves: list, n: int):
        ends = [{x for box, _ in leaves for x in box.get(f, ()) if np.isfinite(x)} for f in range(n)]
        self.ends = [np.array(sorted(e)) for e in ends]
        self.kind = np.min_scalar_type(max((len(e) for e in ends), default=0) + 1)

    def places(self, values: np.ndarray) -> np.ndarray:
        """1 and the number of thresholds below a value; 0 for one that is inside no box."""
        out = np.zeros(values.shape, self.kind, order="F")
        for f, ends in enumerate(self.ends):
            out[:, f] = np.where(values[:, f] > -np.inf, 1 + np.searchsorted(ends, values[:, f]), 0)
        return out

    def box(self, box: list) -> list:
        """(feature, (low, high]) of a leaf in places."""
        def place(f, x):
            return int(np.searchsorted(self.ends[f], x)) + 1 if x > -np.inf else 0
        return [(f, (place(f, low), place(f, high))) for f, (low, high) in box]


def pattern_counts(background: DataFrame, leaves: list, features) -> list[np.ndarray]:
    """Per leaf, how many rows of the whole background have each pattern: one pass that
    adds up per task, then one sum. The result is as large as the model's leaf tables."""
    grid = Grid(leaves, len(features))
    boxes = [grid.box(sorted(box.items())) for box, _ in leaves]

    def count(batches):
        sums = [np.zeros(1 << len(box), np.int64) for box in boxes]
        for batch in joined_batches(batches):
            values = grid.places(batch.to_numpy(dtype=float))
            for total, box in zip(sums, boxes):
                total += np.bincount(_inside(values, box), minlength=len(total))
        for i, total in enumerate(sums):
            at = np.flatnonzero(total)
            yield pd.DataFrame({"leaf": i, "pattern": at, "n": total[at]})

    counts = [np.zeros(1 << len(box)) for box in boxes]
    rows = background.select(*[F.col(f).cast("double").alias(f) for f in features])
    for r in rows.mapInPandas(count, "leaf int, pattern long, n long").groupBy("leaf", "pattern").agg(F.sum("n").alias("n")).collect():
        counts[r["leaf"]][r["pattern"]] = r["n"]
    return counts


def _patterns(d: int, weight: np.ndarray):
    """All pairs of a row's pattern and a background pattern that decide about a leaf of ``d``
    path features: (mine, weight, A, B, u, v). A holds the u features only the row has
    inside the box, B the v features only the background has; every other feature lies
    inside for both, or the pair can never reach the leaf and is left out."""
    full = (1 << d) - 1
    others = np.flatnonzero(weight)
    mine, other = (x.ravel() for x in np.meshgrid(np.arange(1 << d), others, indexing="ij"))
    met = (mine | other) == full
    mine, other = mine[met], other[met]
    bits = 1 << np.arange(d)
    a, b = ((x[:, None] & bits) > 0 for x in (mine & ~other, other & ~mine))
    return mine, weight[other], a, b, a.sum(axis=1), b.sum(axis=1)


_FACTORIALS = np.array([float(factorial(n)) for n in range(64)])


def leaf_tables(leaves: list, counts: list[np.ndarray]):
    """Per leaf (path features and box, table pattern -> attributions), and the base, from
    the counts of each leaf's patterns in the background. Work and size per leaf grow with
    4**d for a path of d features, which suits trees of depth 10 at most."""
    tables, base = [], 0.0
    for (boxes, value), count in zip(leaves, counts):
        box = sorted(boxes.items())
        d = len(box)
        weight = count / max(1, count.sum())
        base += value * weight[(1 << d) - 1]
        if d == 0:
            continue
        mine, w, a, b, u, v = _patterns(d, weight)
        gain = np.where(u > 0, _FACTORIALS[np.maximum(u - 1, 0)] * _FACTORIALS[v], 0.0) / _FACTORIALS[u + v]
        loss = np.where(v > 0, _FACTORIALS[u] * _FACTORIALS[np.maximum(v - 1, 0)], 0.0) / _FACTORIALS[u + v]
        table = np.zeros((1 << d, d))
        np.add.at(table, mine, value * w[:, None] * (a * gain[:, None] - b * loss[:, None]))
        tables.append((box, table))
    return tables, base


def interaction_tables(leaves: list, counts: list[np.ndarray]):
    """Per leaf (path features and box, table pattern -> interaction of each pair).

    The game of a leaf pays its value to the coalitions that hold all of A and none of B.
    Averaged over coalitions as Shapley interaction values are, two features of A, or two
    of B, interact positively and one of each negatively; the weights are beta integrals.
    Each of a pair's two cells gets half; the diagonal stays 0.
    """
    tables = []
    for (boxes, value), count in zip(leaves, counts):
        box = sorted(boxes.items())
        d = len(box)
        if d < 2:
            continue
        mine, w, a, b, u, v = _patterns(d, count / max(1, count.sum()))
        below = _FACTORIALS[np.maximum(u + v - 1, 0)]

        def part(x, y, allowed):
            return np.where(allowed, _FACTORIALS[np.maximum(x, 0)] * _FACTORIALS[np.maximum(y, 0)] / below, 0.0)[:, None, None]

        cell = (part(u - 2, v, u > 1) * (a[:, :, None] & a[:, None, :]) + part(u, v - 2, v > 1) * (b[:, :, None] & b[:, None, :])
                - part(u - 1, v - 1, (u > 0) & (v > 0)) * ((a[:, :, None] & b[:, None, :]) | (b[:, :, None] & a[:, None, :])))
        cell[:, np.arange(d), np.arange(d)] = 0.0
        table = np.zeros((1 << d, d, d))
        np.add.at(table, mine, 0.5 * value * w[:, None, None] * cell)
        tables.append((box, table))
    return tables


def shap_values(model, df: DataFrame, background: DataFrame, features, key: str = "CustomerId") -> DataFrame:
    """Key, features, one ``Attr_<feature>`` each, and Base. Base, the mean margin of the
    whole background, plus the attributions of a row is its margin.

    What is broadcast has leaves x 2**depth x depth numbers: a matter of the model alone.
    """
    features = list(features)
    leaves = model_leaves(model)
    tables, base = leaf_tables(leaves, pattern_counts(background, leaves, features))
    grid = Grid(leaves, len(features))
    shared = df.sparkSession.sparkContext.broadcast([(grid.box(box), table) for box, table in tables])

    def attribute(batches):
        for batch in joined_batches(batches):
            values = grid.places(batch[features].to_numpy(dtype=float))
            result = np.zeros(values.shape, order="F")
            for box, table in shared.value:
                pattern = _inside(values, box)
                for j, (f, _) in enumerate(box):
                    result[:, f] += table[:, j].take(pattern)
            parts = pd.DataFrame(result, columns=[f"Attr_{f}" for f in features], index=batch.index)
            yield pd.concat([batch, parts], axis=1).assign(Base=base)

    rows = df.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    schema = StructType([*rows.schema, *[StructField(f"Attr_{f}", DoubleType()) for f in features],
                         StructField("Base", DoubleType())])
    return rows.mapInPandas(attribute, schema)


def shap_summary(values: DataFrame, features) -> DataFrame:
    """Mean absolute attribution per feature."""
    means = values.agg(*[F.avg(F.abs(f"Attr_{f}")).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("Feature"), F.col(f).alias("MeanAbs")) for f in features])
    return means.select(F.explode(pairs).alias("p")).select("p.*")


def shap_interactions(model, df: DataFrame, background: DataFrame, features, key: str = "CustomerId") -> DataFrame:
    """Key, Feature, Other, Interaction: one row per key and ordered pair of features.

    Where Feature and Other differ, Interaction is the exact Shapley interaction value,
    half of the pair's joint effect; where they are the same it is the feature's main
    effect, what is left of its attribution. A feature's rows add up to its attribution.
    What is broadcast has leaves x 2**depth x depth**2 numbers.
    """
    features = list(features)
    leaves = model_leaves(model)
    counts = pattern_counts(background, leaves, features)
    grid = Grid(leaves, len(features))
    shared = df.sparkSession.sparkContext.broadcast([
        [(grid.box(box), table) for box, table in tables] for tables in (leaf_tables(leaves, counts)[0], interaction_tables(leaves, counts))])
    n = len(features)

    def attribute(batches):
        single, double = shared.value
        for batch in joined_batches(batches):
            values = grid.places(batch[features].to_numpy(dtype=float))
            whole, pairs = np.zeros((len(batch), n), order="F"), np.zeros((len(batch), n, n), order="F")
            for box, table in single:
                pattern = _inside(values, box)
                for j, (f, _) in enumerate(box):
                    whole[:, f] += table[:, j].take(pattern)
            for box, table in double:
                pattern = _inside(values, box)
                for (i, (f, _)), (j, (g, _)) in combinations(enumerate(box), 2):
                    pairs[:, f, g] += table[:, i, j].take(pattern)
            at = np.arange(n)
            pairs += pairs.transpose(0, 2, 1)  # only one cell of a pair is filled so far
            pairs[:, at, at] = whole - pairs.sum(axis=2)
            yield pd.DataFrame({key: np.repeat(batch[key].to_numpy(), n * n), "Feature": np.tile(np.repeat(features, n), len(batch)),
                                "Other": np.tile(features, n * len(batch)), "Interaction": pairs.ravel()})

    rows = df.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInPandas(attribute, f"`{key}` {kind}, Feature string, Other string, Interaction double")


def interaction_partners(interactions: DataFrame) -> DataFrame:
    """Feature, Partner, MeanAbs: the other feature with the largest mean absolute
    interaction (ties: the first by name), one row per feature."""
    strength = (interactions.filter("Feature <> Other").groupBy("Feature", F.col("Other").alias("Partner"))
                .agg(F.avg(F.abs("Interaction")).alias("MeanAbs")))
    best = Window.partitionBy("Feature").orderBy(F.desc("MeanAbs"), "Partner")
    return strength.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def shap_dependence(values: DataFrame, features, partners: dict[str, str], key: str = "CustomerId") -> DataFrame:
    """Long table (feature, value, attribution, value of the interacting feature). A feature's
    partner, by ``interaction_partners``, is the one it interacts with most strongly; a
    feature without one is shown against itself."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("Feature"), F.col(f).alias("Value"), F.col(f"Attr_{f}").alias("Attribution"),
                 F.lit(partners.get(f, f)).alias("InteractingFeature"), F.col(partners.get(f, f)).alias("InteractingValue"))
        for f in features]))
    return values.select(key, rows.alias("r")).select(key, "r.*")
