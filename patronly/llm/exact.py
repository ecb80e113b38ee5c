"""Exact duplicates: sorted digest runs, merged as a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .text import without_white

DIGEST = ["sha256", "check", "length"]
ENTRY = ["run", *DIGEST, "fewest", "doc_id", "key", "group_size"]
FAN_IN = 4  # runs merged at once: two rounds of a binomial tree


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry per run and digest from entries in order of ENTRY: the first, which is the
    best, with the sizes of all added up. One pass; an entry waits until its digest ends.

    Entries are only equal if SHA-256, the second hash and the length all agree.
    """
    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        begins = np.zeros(len(table), bool)
        for name in ("run", *DIGEST):
            column = table.column(name).combine_chunks()
            begins[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        begins[0] = True
        starts = np.flatnonzero(begins)
        sizes = np.add.reduceat(table.column("group_size").to_numpy(), starts)
        done = table.take(pa.array(starts)).set_column(len(ENTRY) - 1, table.schema.field("group_size"), pa.array(sizes))
        held = done.slice(len(done) - 1)
        yield from done.slice(0, len(done) - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def merge_round(entries: DataFrame, fan_in: int, ranges: int) -> DataFrame:
    """Runs exchange their entries: run i goes to run i div ``fan_in``, cut into ``ranges``
    ranges of digests so that no task takes a whole run; each task sorts what it got and
    merges it in one pass."""
    head = F.conv(F.hex(F.substring("sha256", 1, 4)), 16, 10).cast("long")
    cut = F.floor(head * ranges / F.lit(1 << 32)).alias("range")
    exchanged = (entries.withColumn("run", F.floor(F.col("run") / fan_in)).select(*ENTRY, cut)
                 .repartition("run", "range").sortWithinPartitions(*ENTRY[:-1]).drop("range"))
    return exchanged.mapInArrow(_merged, exchanged.schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN,
                 key_col: str | None = None) -> DataFrame:
    """Groups of texts that are equal once white space is deleted.

    Every writing task of the digest table leaves one run, sorted by digest, with one entry
    per digest: the size and the best row (most code points, then the smallest id). In each
    round ``fan_in`` runs are exchanged by ranges of digests and merged in one multiway
    pass, equal digests folding into the better row, until one run, spread over all tasks
    by digest, is left. A group of copies thus shrinks to one entry per run before it is
    shuffled, and at every level again. On the way back the winners go from the digest to
    the run's entries and only then to the rows, so a join key has one entry per run or the
    rows of one run, never all copies.

    A digest is verified at every level: entries only merge if a second hash (64 bits) and
    the length of the text without white space agree too.

    Null and empty texts are the same empty text. A row with a null id counts as an id
    smaller than all others. Repeated rows are copies of each other. Extra columns are
    ignored. An empty table gives an empty result.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. With
    ``key_col``, a column that tells rows apart, also key and best: whether the row is the
    one of its group that stays, the smallest key among equally good ones.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(key_col) if key_col else F.lit(0)
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.char_length(text).alias("points"), without_white(text).alias("bare"))
    rows = materialize(rows.select(
        "doc_id", "key", "points", F.unhex(F.sha2("bare", 256)).alias("sha256"), F.xxhash64("bare").alias("check"),
        F.octet_length("bare").alias("length"), F.spark_partition_id().cast("long").alias("run")))

    best = F.struct((-F.col("points")).alias("fewest"), F.col("doc_id"), F.col("key"))
    runs = (rows.groupBy("run", *DIGEST).agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
            .select("run", *DIGEST, "best.fewest", "best.doc_id", "best.key", "group_size"))
    count = (rows.agg(F.max("run")).first()[0] or 0) + 1
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = runs
    for level in range(max(1, math.ceil(math.log(count, fan_in) - 1e-9))):
        left = max(1, math.ceil(count / fan_in ** (level + 1)))
        merged = merge_round(merged, fan_in, max(1, math.ceil(ranges / left)))

    winners = merged.select(*DIGEST, F.col("doc_id").alias("keep_id"), F.col("key").alias("keep_key"), "group_size")
    entries = runs.select("run", *DIGEST).join(winners, DIGEST)
    found = rows.join(entries, ["run", *DIGEST])
    keyed = [F.col("key"), (F.col("key") == F.col("keep_key")).alias("best")] if key_col else []
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"), *keyed)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The one best row of every group, with its columns. Rows are told apart by a key of
    their own, so that an id (or no id) on several texts stays with each text that does.

    The table is stored once with the keys. Only the keys to be dropped are joined: they
    are few, and Spark broadcasts them if they are small by its own measure. Columns of any
    name pass through; nulls, repeated rows and empty tables as in ``exact_groups``.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    keyed = materialize(docs.toDF(*names).withColumn("_row_key", F.monotonically_increasing_id()))
    own = dict(zip(docs.columns, names))
    dropped = exact_groups(keyed, own[id_col], own[text_col], key_col="_row_key").filter("not best").select(F.col("key").alias("_dropped_key"))
    kept = keyed.join(dropped, F.col("_row_key") == F.col("_dropped_key"), "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])
