"""Clustering rows with numeric and categorical columns, on all rows.

k-prototypes: every round is one grouped aggregate over the table. The centres
(k rows) come back to the driver and enter the next round as literals, so rounds
do not build on each other's plans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import key_digest
from .cleaning import sample_n

COMPILED = 50  # distances of one expression that the JVM still compiles: its limit is 8,000 bytes a method


@dataclass
class Prototypes:
    """Centres of a mixed clustering."""

    numeric: list[str]
    categorical: list[str]
    gamma: float
    centres: list[tuple[list[float], list[str]]]
    sizes: list[int] = field(default_factory=list)
    costs: list[float] = field(default_factory=list)
    converged: bool = False

    def distances(self) -> Column:
        """Array of the squared numeric distance plus gamma per differing category, one
        entry per centre. Plain arithmetic on literals, which compiles with the scan."""
        gamma = f"{float(self.gamma)!r}D"

        def one(numbers, names):
            parts = [f"(`{c}` - {_number(v)}) * (`{c}` - {_number(v)})" for c, v in zip(self.numeric, numbers)]
            parts += [f"if(cast(`{c}` as string) = {_text(v)}, 0.0D, {gamma})" for c, v in zip(self.categorical, names)]
            return " + ".join(parts)

        return F.expr("array(" + ", ".join(one(*c) for c in self.centres) + ")")

    def assign(self, df: DataFrame, cluster: str = "Cluster") -> DataFrame:
        """Adds the nearest centre (ties: lowest index) and its distance."""
        if len(self.centres) * (len(self.numeric) + len(self.categorical)) > COMPILED:
            return self._assign_by_batch(df, cluster)
        return df.withColumn("_all", self.distances()).withColumn("Distance", F.array_min("_all")).withColumn(
            cluster, (F.array_position("_all", F.col("Distance")) - 1).cast("int")).drop("_all")

    def _assign_by_batch(self, df: DataFrame, cluster: str) -> DataFrame:
        """The same sums in the same order for many centres, a batch of rows with all centres
        at once: the JVM does not compile an expression as long as that."""
        levels = [sorted({names[j] for _, names in self.centres}) for j in range(len(self.categorical))]
        centres = np.array([numbers for numbers, _ in self.centres], float).reshape(len(self.centres), len(self.numeric))
        kinds = np.array([[levels[j].index(name) + 1 for j, name in enumerate(names)] for _, names in self.centres])
        gamma, n = float(self.gamma), len(self.numeric)

        @F.pandas_udf("at int, distance double")
        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                total = np.zeros((len(batch), len(centres)))
                for j, c in enumerate(batch.columns):
                    values = batch[c].to_numpy(float)[:, None]
                    total += np.square(values - centres[:, j]) if j < n else np.where(values == kinds[:, j - n], 0.0, gamma)
                at = total.argmin(axis=1)
                yield pd.DataFrame({"at": at, "distance": total[np.arange(len(at)), at]})

        numbers = [F.col(f"`{c}`").cast("double").alias(f"n{j}") for j, c in enumerate(self.numeric)]
        codes = [F.coalesce(F.array_position(F.lit(level).cast("array<string>"), F.col(f"`{c}`").cast("string")), F.lit(0)).cast("double").alias(f"c{j}")
                 for j, (c, level) in enumerate(zip(self.categorical, levels))]
        known = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in self.numeric], F.lit(True))
        found = df.withColumn("_nearest", F.when(known, nearest(F.struct(*numbers, *codes))))
        return found.withColumn("Distance", F.col("_nearest.distance")).withColumn(cluster, F.col("_nearest.at")).drop("_nearest")


def _number(value) -> str:
    return f"({float(value)!r}D)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _default_gamma(df: DataFrame, numeric) -> float:
    """Half the mean population deviation of the numeric columns."""
    row = df.agg(*[F.stddev_pop(c) for c in numeric]).first()
    return 0.5 * float(np.mean([v or 0.0 for v in row]))


def _start(df: DataFrame, numeric, categorical, k: int, seed: int, key: str):
    """k seeded rows with distinct values, in key-hash order.

    A cut on the hash first leaves about 100 k candidates; only if those hold fewer than k
    different rows are all rows compared.
    """
    columns = [*[F.col(c).cast("double").alias(c) for c in numeric],
               *[F.col(c).cast("string").alias(c) for c in categorical]]
    digest, share = key_digest(key, seed=seed), min(1.0, 100 * k / max(1, df.count()))
    rows = []
    for candidates in [df.filter(digest < format(int(share * 16 ** 8), "08x"))] * (share < 1) + [df]:
        distinct = candidates.groupBy(*columns).agg(F.min(digest).alias("_d"))
        rows = distinct.orderBy("_d").limit(k).collect()
        if len(rows) == k:
            break
    return [([r[c] for c in numeric], [r[c] for c in categorical]) for r in rows]


def _huang_start(df: DataFrame, numeric, categorical, gamma: float, k: int, seed: int, key: str):
    """Numbers drawn around the means; categories drawn column by column as often as they
    occur (the values of hash-picked rows), then replaced by those of the nearest row."""
    share = min(1.0, 100.0 * k * max(1, len(categorical)) / max(1, df.count()))
    digest = key_digest(key, seed=seed)
    some = df if share == 1 else df.filter(digest < format(int(share * 16 ** 8), "08x"))
    rows = some.select(digest.alias("_d"), *[F.col(c).cast("string").alias(c) for c in categorical]).orderBy("_d").limit(
        k * max(1, len(categorical))).collect()
    if not rows:
        return []
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    draws = np.random.default_rng(seed).standard_normal((k, len(numeric)))
    numbers = [[(stats[f"m_{c}"] or 0.0) + (stats[f"s_{c}"] or 0.0) * float(z) for c, z in zip(numeric, row)] for row in draws]
    names = [[rows[(i * len(categorical) + j) % len(rows)][c] for j, c in enumerate(categorical)] for i in range(k)]
    if categorical:
        kinds = F.struct(*[F.col(c).cast("string").alias(c) for c in categorical])
        far = Prototypes([], categorical, gamma, [([], n) for n in names]).distances()
        found = df.agg(*[F.min(F.struct(far[i].alias("d"), kinds.alias("r")))["r"].alias(f"r{i}") for i in range(k)]).first()
        names = [[found[f"r{i}"][c] for c in categorical] for i in range(k)]
    return list(zip(numbers, names))


def kprototypes(df: DataFrame, numeric, categorical, k: int = 4, gamma: float | None = None,
                seed: int = 42, rounds: int = 100, key: str = "CustomerId",
                tolerance: float = 1e-9, starts: int = 1, start: str = "huang") -> Prototypes:
    """Fit ``k`` mixed centres: means of numbers, most common categories.

    Rounds go on until the cost no longer falls; ``converged`` says whether that came
    before ``rounds`` were over. The first centres are drawn as Huang proposes, or are
    different rows (``start="rows"``). Of several ``starts`` from different rows the cheapest
    result counts. ``df`` should be a materialised table without nulls in the used columns.
    """
    numeric, categorical = list(numeric), list(categorical)
    gamma = _default_gamma(df, numeric) if gamma is None else gamma
    first = [_huang_start(df, numeric, categorical, gamma, k, seed + i, key) if start == "huang"
             else _start(df, numeric, categorical, k, seed + i, key) for i in range(starts)]
    models = [_fit_once(df, Prototypes(numeric, categorical, gamma, centres), rounds, tolerance) for centres in first]
    return min(models, key=lambda m: m.costs[-1] if m.costs else 0.0)


def _fit_once(df: DataFrame, model: Prototypes, rounds: int, tolerance: float) -> Prototypes:
    numeric, categorical = model.numeric, model.categorical
    for _ in range(rounds):
        found = _round(model.assign(df), numeric, categorical)
        model.costs.append(sum(r["cost"] for r in found if r["attribute"] == 0))
        centres, sizes = [], []
        for i, old in enumerate(model.centres):
            mine = {r["attribute"]: r for r in found if r["Cluster"] == i}
            n = mine[0]["n"] if mine else 0
            sizes.append(n)
            centres.append(([mine[0][f"s_{c}"] / n for c in numeric],
                            [mine[j]["mode"] for j in range(len(categorical))]) if n else old)
        model.sizes = sizes
        if len(model.costs) > 1 and model.costs[-2] - model.costs[-1] <= tolerance * max(1.0, model.costs[-1]):
            model.converged = True
            break
        model.centres = centres
    return model


def _round(assigned: DataFrame, numeric, categorical) -> list:
    """Per centre and categorical column: row count, cost, numeric sums, most common value
    (ties: smallest). Rows are added up by centre and categories, then counted in long form,
    so the rows that come back are centres x columns, however many values or combinations a
    column has.
    """
    sums = {"cost": F.col("Distance"), **{f"s_{c}": F.col(c).cast("double") for c in numeric}}
    names = [f"_c{j}" for j in range(len(categorical))]
    grouped = assigned.groupBy("Cluster", *[F.col(c).cast("string").alias(n) for n, c in zip(names, categorical)]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(n) for n, v in sums.items()])
    pairs = [F.struct(F.lit(j).alias("attribute"), F.col(n).alias("value")) for j, n in enumerate(names)] or [
        F.struct(F.lit(0).alias("attribute"), F.lit(None).cast("string").alias("value"))]
    first = F.col("p.attribute") == 0  # numbers are summed once, not once per category
    counted = (
        grouped.select("Cluster", "n", *sums, F.explode(F.array(*pairs)).alias("p"))
        .groupBy("Cluster", "p.attribute", "p.value")
        .agg(F.sum("n").alias("n"), *[F.sum(F.when(first, F.col(n))).alias(n) for n in sums])
    )
    best = F.min(F.struct(-F.col("n"), F.col("value").alias("value")))["value"]
    return counted.groupBy("Cluster", "attribute").agg(
        best.alias("mode"), *[F.sum(n).alias(n) for n in ("n", *sums)]).collect()


# ---------------------------------------------------------------- landmarks
def landmarks(df: DataFrame, n: int = 200, key: str = "CustomerId", seed: int = 42) -> DataFrame:
    """At most ``n`` seeded rows to measure all others against."""
    return sample_n(df, n, key, seed)


def gower_to_landmarks(df: DataFrame, marks: DataFrame, numeric, categorical,
                       key: str = "CustomerId") -> DataFrame:
    """Gower distance of every row to the landmark rows: the nearest one, its distance
    and the mean distance. Linear in rows: no row is compared with another row.

    The landmarks (at most a few hundred) become one literal array.
    """
    low = df.agg(*[F.min(c).alias(f"l_{c}") for c in numeric], *[F.max(c).alias(f"h_{c}") for c in numeric]).first()
    width = {c: float((low[f"h_{c}"] or 0) - (low[f"l_{c}"] or 0)) or 1.0 for c in numeric}
    rows = marks.select(
        F.col(key).alias("id"), *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.col(c).cast("string").alias(c) for c in categorical]).orderBy("id").collect()
    array = F.array(*[
        F.struct(F.lit(r["id"]).cast(df.schema[key].dataType).alias("id"), *[F.lit(r[c]).alias(c) for c in [*numeric, *categorical]])
        for r in rows])

    def distance(mark):
        parts = [F.abs(F.col(c) - mark[c]) / F.lit(width[c]) for c in numeric]
        parts += [F.when(F.col(c).cast("string") == mark[c], F.lit(0.0)).otherwise(F.lit(1.0)) for c in categorical]
        return sum(parts[1:], parts[0]) / F.lit(float(len(parts)))

    measured = df.withColumn("_d", F.transform(array, lambda m: F.struct(
        distance(m).alias("d"), m["id"].alias("id"))))
    nearest = F.array_min("_d")
    total = F.aggregate("_d", F.lit(0.0), lambda acc, m: acc + m["d"])
    return measured.select(
        key, nearest["id"].alias("NearestLandmark"), nearest["d"].alias("NearestDistance"),
        (total / F.lit(float(len(rows)))).alias("MeanDistance"))


# ---------------------------------------------------------------- hierarchy
def _ward(points: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """Merge weighted points, cheapest variance increase first, down to ``k`` groups.

    Runs on the driver over the micro-cluster centres (a few hundred at most).
    """
    groups = {i: [i] for i in range(len(points))}
    centre = {i: points[i].astype(float) for i in groups}
    mass = {i: float(weights[i]) for i in groups}
    while len(groups) > k:
        ids = sorted(groups)
        stacked, m = np.array([centre[i] for i in ids]), np.array([mass[i] for i in ids])
        gaps = ((stacked[:, None, :] - stacked[None, :, :]) ** 2).sum(-1)
        rise = gaps * (m[:, None] * m[None, :]) / (m[:, None] + m[None, :])
        rise[np.tril_indices(len(ids))] = np.inf
        a, b = (ids[j] for j in np.unravel_index(np.argmin(rise), rise.shape))
        centre[a] = (centre[a] * mass[a] + centre[b] * mass[b]) / (mass[a] + mass[b])
        mass[a] += mass[b]
        groups[a] += groups.pop(b)
    label = {}
    for n, i in enumerate(sorted(groups)):
        label.update({member: n + 1 for member in groups[i]})
    return [label[i] for i in range(len(points))]


def hierarchical_segments(df: DataFrame, numeric, categorical, k: int = 5, micro: int = 60,
                          seed: int = 42, key: str = "CustomerId", rounds: int = 100):
    """Hierarchy over all rows: many small mixed clusters, merged bottom-up.

    Returns (rows with Cluster 1..k, the fitted micro clusters, function giving the
    merge for another k). Merges for a smaller k join groups of a larger one.
    """
    model = kprototypes(df, numeric, categorical, micro, seed=seed, rounds=rounds, key=key, start="rows")
    live = [i for i, n in enumerate(model.sizes) if n]
    levels = [sorted({model.centres[i][1][j] for i in live}) for j in range(len(categorical))]
    # A category level is a corner at distance gamma from every other level.
    corner = np.sqrt(model.gamma / 2.0)
    points = np.array([
        [*model.centres[i][0],
         *[corner if model.centres[i][1][j] == level else 0.0
           for j in range(len(categorical)) for level in levels[j]]] for i in live])
    weights = np.array([model.sizes[i] for i in live])

    def merge(groups: int) -> dict[int, int]:
        return dict(zip(live, _ward(points, weights, groups)))

    def label(groups: int) -> DataFrame:
        names = merge(groups)
        table = F.array(*[F.lit(names.get(i, 0)) for i in range(len(model.centres))])
        return model.assign(df, "Micro").withColumn("Cluster", F.element_at(table, F.col("Micro") + 1))

    return label(k), model, label
