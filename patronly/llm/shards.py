"""Sharding along a Hilbert curve through metadata, with DataFrame functions only.

Rows near each other in several metadata columns get near places on the curve, so a run
of the curve is a box-like region and the minimum and maximum of each column in a shard
let a reader skip the shards that a filter on any of the columns cannot meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from ..functions.numbering import number_rows
from ..session import materialize

SLICE_ROWS = 10_000  # rows per slice of the curve, the unit of running totals


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of a Hilbert curve by state * 2**dims + corner.

    A state is where a sub-cube is entered (a corner) and along which axis the curve
    leaves it. A corner, turned into the state's own orientation, stands in Gray code
    order at ``digit``; the orientation of the sub-cube there follows from that digit.
    """
    corners = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (corners - 1)

    def gray(x: int) -> int:
        return x ^ (x >> 1)

    rank = {gray(i): i for i in range(corners)}

    def entry(digit: int) -> int:
        return gray((digit - 1) // 2 * 2) if digit else 0

    def axis(digit: int) -> int:
        odd = digit if digit % 2 else digit - 1
        return (odd ^ (odd + 1)).bit_length() % dims - 1 if digit else 0

    digits, states = [], []
    for state in range(corners * dims):
        start, along = divmod(state, dims)
        for corner in range(corners):
            digit = rank[turn(corner ^ start, -(along + 1))]
            digits.append(digit)
            after = start ^ turn(entry(digit), along + 1)
            states.append(after * dims + (along + axis(digit) + 1) % dims)
    return digits, states


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a point with coordinates 0 .. 2**bits - 1."""
    dims = len(cells)
    digits, states = (F.lit(t) for t in curve_tables(dims))
    corner = [sum((F.shiftright(c, level).bitwiseAND(F.lit(1)) * (1 << d) for d, c in enumerate(cells)), F.lit(0))
              for level in reversed(range(bits))]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("state"))

    def step(s, corner):
        row = s["state"] * (1 << dims) + corner + 1
        return F.struct((s["at"] * (1 << dims) + F.element_at(digits, row)).alias("at"), F.element_at(states, row).alias("state"))

    return F.aggregate(F.array(*[c.cast("int") for c in corner]), start, step, lambda s: s["at"])


def running_before(rows: DataFrame, order: list, weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows that come before in ``order``, and
    ``number``. Sums run inside slices of consecutive rows, then over the slices."""
    numbered = materialize(number_rows(rows, order).withColumn("_slice", F.floor(F.col("number") / SLICE_ROWS)))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (numbered.groupBy("_slice").agg(F.sum(weight).alias("_n"))
              .select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_slice").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return (numbered.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(slices, "_slice")
            .withColumn(name, F.col("_start") + F.col("_inside")).drop("_slice", "_start", "_inside"))


def quantise(rows: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """For each column the cell, 0 .. 2**bits - 1, of a row's value.

    Cells hold like numbers of rows: a value goes to the cell in which the middle of its
    rows lies, in the order of values (numbers by size, all else as text by code point,
    null first). Rows are counted per distinct value before anything moves. The driver
    gets the smallest value of each cell: at most 2**bits values per column.
    """
    number = [isinstance(rows.schema[c].dataType, NumericType) for c in dims]
    values = F.explode(F.array(*[
        F.struct(F.lit(i).alias("dim"), (F.col(c).cast("double") if n else F.lit(None).cast("double")).alias("x"),
                 (F.lit(None).cast("string") if n else F.col(c).cast("string")).alias("s"))
        for i, (c, n) in enumerate(zip(dims, number))])).alias("v")
    counts = rows.select(values).select("v.*").groupBy("dim", "x", "s").agg(F.count("*").alias("n"))
    placed = running_before(counts, ["dim", "x", "s"], "n", "before")
    total = rows.count()
    middle = 2 * (F.col("before") - F.col("dim") * total) + F.col("n") - 1
    cell = F.floor(middle * (1 << bits) / (2 * max(1, total))).cast("int")
    cuts = (placed.groupBy("dim", cell.alias("cell")).agg(F.min("x").alias("x"), F.min("s").alias("s"))
            .orderBy("dim", "cell").collect())
    cells = []
    for i, (c, n) in enumerate(zip(dims, number)):
        own = [r for r in cuts if r["dim"] == i]
        found = F.lit(own[0]["cell"] if own else 0)
        for r in own[1:]:
            found = F.when(F.col(c).cast("double" if n else "string") >= F.lit(r["x"] if n else r["s"]), r["cell"]).otherwise(found)
        cells.append(found)
    return cells


def hilbert_shards(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 16, bits: int = 4,
                   id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Cut the documents, in the order of a Hilbert curve through ``dims``, into shards of
    near-equal bytes.

    Each column of ``dims`` is quantised into 2**bits cells of like row counts; the cells
    give the place on the curve. Documents of one place follow each other by id, then by
    digests of the text, so an order does not depend on how the input is split, and a hot
    place (or id) is spread over tasks. A document belongs to the shard in which the middle
    of its bytes lies, so a shard differs from the mean by at most the largest document.

    The size of a document is its UTF-8 bytes plus 1. Null texts have size 1 and the
    digest of an empty text; null metadata is the lowest value; a null id comes first;
    repeated rows follow each other; other columns than ``keep`` go; an empty table gives
    an empty result.

    Returns the ``keep`` columns (by default the id), size, text_crc32, hilbert, shard and
    slot, the place inside the shard from 0.
    """
    keep = (id_col,) if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the texts are read once; all that follows needs narrow rows (and what is kept)
    rows = materialize(docs.select(
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(dims)],
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_digest"),
        F.monotonically_increasing_id().alias("_row")))
    total = rows.agg(F.sum("size")).first()[0] or 1
    axes = [f"_d{i}" for i in range(len(dims))]
    rows = rows.withColumn("hilbert", hilbert_index(quantise(rows, axes, bits), bits)).drop(*axes)
    placed = running_before(rows, ["hilbert", "_id", "text_crc32", "_digest", "_row"], "size", "before")
    shard = F.floor((2 * F.col("before") + F.col("size")) * shards / (2 * total)).cast("int")
    placed = materialize(placed.withColumn("shard", shard))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("number").alias("first")).collect()}
    start = F.element_at(F.lit([first.get(s, 0) for s in range(shards)]), F.col("shard") + 1)
    return placed.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "size", "text_crc32", "hilbert", "shard",
                         (F.col("number") - start).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write whole documents as Parquet, one folder ``_shard=n`` per shard, rows in the
    order of their slots. Tasks take runs of the curve, so no task gets a whole shard."""
    columns = docs.columns
    placed = hilbert_shards(docs.select(*[F.col(f"`{c}`") for c in columns]), keep=tuple(columns), **options)
    inner = placed.toDF(*[f"_c{i}" for i in range(len(columns))], "_size", "_crc", "_hilbert", "_shard", "_slot")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = inner.repartitionByRange(parts, "_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    runs.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)], "_shard").write.partitionBy("_shard").parquet(path)


def shard_ranges(placed: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Per shard: rows, bytes, and the least and greatest value of each column of ``dims``,
    with which a reader skips shards."""
    return placed.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max)])
