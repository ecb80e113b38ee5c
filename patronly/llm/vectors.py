"""Near-duplicate vectors: sorted projection passes, neighbour windows, united groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.numbering import number_rows
from ..session import materialize
from .graph import components

BITS = 64
BLOCK = 512  # neighbouring vectors, or vectors of one component or run, compared at once
LEAST_BITS = 2  # signs by which every pass sorts at least
MOVED = 1000  # comparisons that cost as much as hashing and moving one vector


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Stored rows (vec_id, label, size, vector, usable). Not usable are vectors without a
    label and those that are null, empty, zero or hold a null or non-finite component."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return materialize(rows.select("vec_id", "label", F.size("vector").alias("size"), "vector",
                                   F.coalesce(good, F.lit(False)).alias("usable")))


def passes_for(bits: float, cosine: float, miss: float) -> int:
    """Passes after which a pair at exactly ``cosine`` has agreed in the first ``bits`` signs
    of no pass with chance ``miss``: two such vectors agree in a projection's sign with
    chance 1 - angle/pi, wherever the other vectors lie."""
    agree = 1 - math.acos(cosine) / math.pi
    hit = min(agree ** bits, 1 - 1e-9)
    return max(1, math.ceil(math.log(miss) / math.log(1 - hit)))


def _matrix(column: pd.Series, size: int | None = None) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are padded with zeros."""
    size = size or max((len(v) for v in column), default=0)
    out = np.zeros((len(column), size))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # keeps huge and tiny components in range
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _hashed(vectors: DataFrame, passes: list[int], bits: int, seed: int, whole: bool) -> DataFrame:
    """One row per vector and pass with the signs of the first ``bits`` of 64 random
    projections as one number, first projection first; with ``whole`` also the vector."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema}
    carried = ["vec_id", "vector"] if whole else []

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, same in batch.groupby("size"):
                unit = _matrix(same["vector"], size)
                for p in passes:
                    if (p, size) not in planes:
                        planes[p, size] = np.random.default_rng([seed, p, size]).standard_normal((size, BITS))
                    signs = (unit @ planes[p, size] > 0).astype(np.uint8)
                    signs[:, bits:] = 0
                    key = np.packbits(signs, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
                    yield pd.DataFrame({"pass": np.int32(p), "label": same["label"], "size": same["size"], "key": key,
                                        **{c: same[c] for c in carried}})

    kinds = {"vec_id": kind, "vector": fields["vector"]}
    return vectors.mapInPandas(compute, f"pass int, label {fields['label']}, size int, key long"
                                        + "".join(f", {c} {kinds[c]}" for c in carried))


def _bits_and_passes(vectors: DataFrame, largest: int, window: int, cosine: float, miss: float, seed: int) -> tuple[int, int]:
    """How many leading bits two vectors have to share, and in how many passes.

    A pass finds every pair that shares the bits: those of a short run lie in one window,
    longer runs are compared whole. The runs of one pass are measured at many lengths:
    vectors in a cone share more bits than evenly spread ones, so their runs are longer,
    and more bits with more passes may cost less. The choice only decides about cost; the
    passes hold the miss for each."""
    least = max(LEAST_BITS, round(math.log2(max(1, largest / window))))
    lengths = list(range(least, BITS, 2))
    runs = _hashed(vectors, [0], BITS, seed, False).groupBy("label", "size", "key").agg(F.count("*").alias("n"))
    # the sign bit of a key is its first projection, so that shifts keep leading bits
    cut = runs.select("label", "size", "n", F.explode(F.array(*[
        F.struct(F.lit(b).alias("bits"), F.shiftright("key", BITS - b).alias("lead")) for b in lengths])).alias("cut"))
    n = F.col("n").cast("double")
    whole = F.when(n > window, n * MOVED * F.ceil(n / BLOCK) + n * n / 2).otherwise(0.0)
    cost = (cut.groupBy("label", "size", "cut").agg(F.sum("n").alias("n"))
            .groupBy(F.col("cut.bits").alias("bits"))
            .agg(F.sum(n * (MOVED + window) + whole).alias("cost")).collect())
    bits = min(cost, key=lambda r: (r["cost"] * passes_for(r["bits"], cosine, miss), r["bits"]))["bits"]
    return bits, passes_for(bits, cosine, miss)


def _star(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place each of n places is connected to by the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _linked(rows: pd.DataFrame, group: np.ndarray, cosine: float, i=None, j=None) -> pd.DataFrame:
    """Verified links inside each group of consecutive rows: of the links found in a group only
    a spanning star is returned, at most one link per vector. With ``i`` and ``j`` only rows
    whose ``own`` is i[row] are compared with those whose ``own`` is j[row]."""
    ids, unit, found = rows["vec_id"].to_numpy(), _matrix(rows["vector"]), []
    own = rows["own"].to_numpy() if i is not None else None
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    for start, end in zip(starts, np.append(starts[1:], len(rows))):
        if end - start < 2:
            continue
        part, names = unit[start:end], ids[start:end]
        first = second = np.arange(end - start)
        if i is not None:
            first, second = (np.flatnonzero(own[start:end] == x[start]) for x in (i, j))
        x, y = np.nonzero(part[first] @ part[second].T >= cosine)
        root = _star(first[x], second[y], end - start)
        linked = np.flatnonzero(root != np.arange(end - start))
        found.append((names[linked], names[root[linked]]))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else ((), ())
    return pd.DataFrame({"a": a, "b": b})


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, group number) of whole groups of rows that are sorted by ``keys``."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        group = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        done = group != group[-1]
        if done.any():
            yield rows[done], group[done]
        rest = rows[~done]
    if rest is not None:
        yield rest, np.zeros(len(rest), int)


def _window_links(hashed: DataFrame, window: int, cosine: float, block: int) -> DataFrame:
    """Links between neighbours in the order of (pass, label, size, key): each vector with the
    ``window`` vectors after it at least.

    Rows are numbered over the whole table and cut into blocks of ``block`` rows by number; a
    block also gets the first ``window`` rows of the next one, so windows reach over every
    border, whatever the partitions.
    """
    kind = hashed.schema["vec_id"].dataType.simpleString()
    numbered = number_rows(hashed, ["pass", "label", "size", "key", "vec_id"])
    own, place = F.floor(F.col("number") / block), F.col("number") % block
    before = F.when((place < window) & (own > 0), own - 1)
    rows = numbered.withColumn("block", F.explode(F.array_compact(F.array(own, before))))
    keys = ["block", "pass", "label", "size"]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, group in _grouped(batches, keys):
            yield _linked(part, group, cosine)

    ordered = rows.select(*keys, "number", "vec_id", "vector").repartition("block").sortWithinPartitions(*keys, "number")
    return ordered.mapInPandas(link, f"a {kind}, b {kind}")


def _run_links(hashed: DataFrame, window: int, bits: int, cosine: float, block: int) -> DataFrame:
    """Links between all vectors of a run, the rows of one label and size that agree in the
    leading bits of a pass, where the run is longer than a window. Such a run is cut in
    blocks of about ``block`` vectors and every two blocks are compared by one call."""
    kind = hashed.schema["vec_id"].dataType.simpleString()
    run = ["pass", "label", "size", "lead"]
    led = hashed.withColumn("lead", F.shiftright("key", BITS - bits))
    long = (led.groupBy(*run).agg(F.count("*").alias("_n")).filter(F.col("_n") > window)
            .select(*run, F.ceil(F.col("_n") / block).cast("int").alias("blocks")))
    cut = led.join(long, run).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = (cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
             .select(*run, "i", "j", "own", "vec_id", "vector"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, group in _grouped(batches, [*run, "i", "j"]):
            yield _linked(part, group, cosine, part["i"].to_numpy(), part["j"].to_numpy())

    ordered = pairs.repartition(*run, "i", "j").sortWithinPartitions(*run, "i", "j")
    return ordered.mapInPandas(link, f"a {kind}, b {kind}")


def _links_inside(members: DataFrame, cosine: float) -> DataFrame:
    """For rows (root, vec_id, copies, vector, n): how many vectors of the same component
    each is linked to, itself and copies included. Components are cut in blocks of about
    512 vectors; every pair of blocks is one small task, and only counts leave it."""
    kind = members.schema["vec_id"].dataType.simpleString()
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = (cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks", "n"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        unit, copies, own = _matrix(rows["vector"]), rows["copies"].to_numpy(), rows["own"].to_numpy()
        links = np.zeros(len(rows), np.int64)
        first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
        linked = unit[first] @ unit[second].T >= cosine
        if i == j:
            np.fill_diagonal(linked, True)
        links[first] += linked @ copies[second]
        if i != j:
            links[second] += linked.T @ copies[first]
        return pd.DataFrame({"vec_id": rows["vec_id"], "links": links})

    return (pairs.groupBy("root", "i", "j").applyInPandas(count, f"vec_id {kind}, links long")
            .groupBy("vec_id").agg(F.sum("links").alias("links")))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = 0.93, window: int = 48, miss: float = 1e-5, passes: int | None = None,
                 passes_per_job: int = 4, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """Groups of vectors of one label that are linked by a cosine of ``cosine`` or more.

    Equal vectors of a label first become one vector with a count. Each pass then sorts the
    vectors of a label by 64 signs of random projections, one after another, and compares
    each with the ``window`` vectors that follow, over all borders of partitions; links
    verified in any pass are united to components. Where more than ``window`` vectors agree
    in the leading signs a pair is meant to share (vectors that lie close together), these
    are also compared whole, in blocks, so a full window never cuts a pair off. The number
    of passes follows from the number of signs and ``miss`` alone, so that a pair at the
    threshold is missed with that chance at any size and however the vectors lie. Within a
    component every pair is then compared, in blocks, which gives the exact number of links
    of each vector, those included that no window showed. No pairs leave a task but one
    link per vector, pass and block.

    Vectors that are null, empty, zero, without label, or hold null or non-finite
    components, and vectors of another length, link with nothing. Repeated rows are
    vectors of their own and link with each other. Extra columns are ignored; an empty
    table gives no rows.

    Returns one row per input row: vec_id, n_links, component_id, kept.
    """
    spark = rows.sparkSession
    stored = usable_vectors(rows, id_col, vector_col, label_col)
    usable = stored.filter("usable and vec_id is not null")
    vectors = materialize(usable.groupBy("label", "size", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    largest = vectors.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    links = None
    if largest > 1:
        bits, enough = _bits_and_passes(vectors, largest, window, cosine, miss, seed)
        passes = passes or enough
        for first in range(0, passes, passes_per_job):
            numbers = list(range(first, min(passes, first + passes_per_job)))
            hashed = materialize(_hashed(vectors, numbers, BITS, seed, True))
            near = _window_links(hashed, window, cosine, max(block, window))
            found = materialize(near.unionByName(_run_links(hashed, window, bits, cosine, block)).distinct())
            links = found if links is None else links.unionByName(found)
    else:
        links = vectors.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b")).limit(0)
    roots = components(links)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    members = (vectors.join(roots, F.col("vec_id") == F.col("node")).drop("node")
               .join(sizes, "root").select("root", "vec_id", "copies", "vector", "n"))
    counted = _links_inside(members, cosine)
    groups = (vectors.select("label", "size", "vector", "copies", F.col("vec_id").alias("_id"))
              .join(roots, F.col("_id") == F.col("node"), "left").drop("node")
              .join(counted.withColumnRenamed("vec_id", "_counted"), F.col("_id") == F.col("_counted"), "left")
              .select("label", "size", "vector", (F.coalesce("links", "copies") - 1).alias("links"),
                      F.coalesce("root", "_id").alias("root")))
    seen = usable.join(groups, ["label", "size", "vector"]).select("vec_id", "links", F.col("root"))
    alone = stored.filter("not (usable and vec_id is not null)").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("root"))
    return seen.unionByName(alone).select(
        "vec_id", F.col("links").cast("long").alias("n_links"), F.col("root").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("root")).alias("kept"))
