"""Trie of conversation prefixes, from intervals of sorted conversations.

Conversations are sorted by the digests of their turns and numbered. All that share a
prefix then form one interval, and a row belongs to it as long as no neighbouring pair on
the way has a shorter longest common prefix (LCP).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..functions.numbering import number_rows
from ..session import materialize
from .mixture import word_count

WIDTH = 16      # bytes of a turn's digest
BLOCK = 2_048   # neighbouring conversations that one call looks at


def turn_lists(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """(conv_id, turns) with the turns in order as (key, words): 128 bits of a digest of role
    and text as 32 hex digits, and the number of words.

    Order: turn (null first), then role, then key. Null roles and texts count as empty;
    rows with a null conversation id are left out. The row of a conversation holds no text.
    """
    name, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = F.left(F.sha2(F.concat(F.char_length(name).cast("string"), F.lit(":"), name, said), 256), F.lit(2 * WIDTH))
    rows = messages.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), name.alias("role"), key.alias("key"), word_count(F.col(text)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def common_prefixes(items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row but the first, how many leading items it shares with the row before.
    Row i is items[offsets[i]:offsets[i + 1]]; items are pairs of numbers."""
    lengths = np.diff(offsets)
    shortest = np.minimum(lengths[1:], lengths[:-1])
    starts = np.concatenate(([0], shortest.cumsum()))
    inside = np.arange(starts[-1]) - np.repeat(starts[:-1], shortest)
    same = (items[np.repeat(offsets[:-2], shortest) + inside] == items[np.repeat(offsets[1:-1], shortest) + inside]).all(axis=1)
    # the first place where a pair differs, or its shorter length
    place = np.where(same, np.repeat(shortest, shortest), inside)
    out = shortest.copy()
    some = shortest > 0
    out[some] = np.minimum.reduceat(place, starts[:-1][some]) if some.any() else out[some]
    return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of each 2**k consecutive values."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        low, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(low[:-step], low[step:]))
    return levels


def range_minimum(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum of values[first:last + 1] for each pair, by two overlapping table entries."""
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    out = np.empty(len(first), levels[0].dtype)
    for k, table in enumerate(levels):
        own = level == k
        out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
    return out


def extents(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share the first ``depth`` items with row ``at``.

    values[i] is the LCP of rows i and i + 1. Left and right are found independently, each
    by a binary search: from the widest table entry to the narrowest, a step is taken if
    the whole stretch it covers has an LCP of at least ``depth``.
    """
    left, right, rows = at.copy(), at.copy(), len(levels[0]) + 1
    for k in reversed(range(len(levels))):
        step, table = 1 << k, levels[k]
        if not len(table):
            continue
        fits = right + step < rows
        go = fits & (table[np.where(fits, right, 0)] >= depth)
        right = np.where(go, right + step, right)
        fits = left - step >= 0
        go = fits & (table[np.where(fits, left - step, 0)] >= depth)
        left = np.where(go, left - step, left)
    return left, right


_ID, _TEXT, _DIGEST = LongType(), StringType(), BinaryType()
PIECES = StructType([StructField(n, t) for n, t in (
    ("conv_id", _ID), ("depth", _ID), ("parent_conv_id", _ID), ("n_convs", _ID), ("n_children", _ID), ("n_leaves", _ID),
    ("saved_tokens", _ID), ("ends_sha256", _TEXT), ("node", _DIGEST), ("parent", _DIGEST), ("ends", ArrayType(LongType())), ("block", _ID))])


def _ids_digest(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


NO_ENDS = _ids_digest([])


def _block_nodes(block: int, size: int, numbers: np.ndarray, ids: np.ndarray, keys: list[bytes], words: list) -> list:
    """Columns of PIECES for one block of sorted conversations.

    The block comes with the row before it and the row after it, if there are any: their
    LCPs say which prefixes reach over its borders. Such a node is given as a piece, with
    digests of its prefix and its parent's; all that is counted adds up over its pieces.
    """
    before, after = numbers[0] < block * size, numbers[-1] >= (block + 1) * size
    lengths = np.array([len(k) // WIDTH for k in keys])
    offsets = np.concatenate(([0], lengths.cumsum()))
    shared = common_prefixes(np.frombuffer(b"".join(keys), np.uint64).reshape(-1, WIDTH // 8), offsets)
    home = slice(int(before), len(keys) - int(after))
    n = home.stop - home.start
    lcp = np.concatenate(([shared[0] if before else -1], shared[home.start:home.stop - 1]))
    beyond = shared[-1] if after else -1  # the LCP with the row after the block
    ids, keys, lengths = ids[home], keys[home], lengths[home]
    counts = [np.asarray(w, np.int64) for w in words[home]]
    upto = np.concatenate(([0], np.concatenate(counts).cumsum() if n else ()))  # words of all turns before
    start = np.concatenate(([0], lengths.cumsum()))[:-1]

    def words_before(row, depth):  # of the first turns of a row
        return upto[start[row] + np.maximum(depth, 0)] - upto[start[row]]

    every = np.arange(n)
    whole, new = words_before(every, lengths), words_before(every, lengths) - words_before(every, lcp)
    next_lcp = np.append(lcp[1:], beyond)
    leaf = (next_lcp < lengths).astype(np.int64)
    sums = {name: np.concatenate(([0], v.cumsum())) for name, v in (("whole", whole), ("new", new), ("leaf", leaf))}

    # candidates: the prefixes that start in a row, and in the first row those that go on
    first = np.where(every == 0, 0, lcp + 1)
    number = lengths - first + 1
    at = np.repeat(every, number)
    depth = np.arange(number.sum()) - np.repeat(number.cumsum() - number, number) + np.repeat(first, number)
    table = sparse_table(lcp[1:])
    smallest = sparse_table(ids)
    left, right = extents(table, at, depth)
    open_left = (left == 0) & (lcp[0] >= depth)
    opened = open_left | ((right == n - 1) & (beyond >= depth))
    up_left, up_right = extents(table, at, depth - 1)
    up_open = (depth > 0) & (((up_left == 0) & (lcp[0] >= depth - 1)) | ((up_right == n - 1) & (beyond >= depth - 1)))

    members = right - left + 1
    above = words_before(left, depth - 1)
    saved = (sums["whole"][right + 1] - sums["whole"][left] - members * above
             - (sums["new"][right + 1] - sums["new"][left + 1]) - np.where(open_left, new[left], whole[left] - above))
    # children: longer rows inside the interval whose LCP is its depth, and the first row's own
    width = n + 1
    sorted_lcp = np.sort((lcp * width + every)[lengths > lcp])
    children = (np.searchsorted(sorted_lcp, depth * width + right, "right") - np.searchsorted(sorted_lcp, depth * width + left, "right")
                + np.where(open_left, lcp[left] == depth, True) * (lengths[left] > depth))
    # the rows that end at a node come first in its interval: the run of rows equal to it
    differs = np.append(np.flatnonzero((next_lcp < lengths) | (np.append(lengths[1:], -1) != lengths)), n - 1)
    run_end = differs[np.searchsorted(differs, left)]
    ends = [ids[a:min(b, c) + 1] if stop else () for a, b, c, stop in zip(left, run_end, right, lengths[left] == depth)]

    def prefix(i, d):
        return hashlib.blake2b(keys[at[i]][:WIDTH * d], digest_size=16).digest()

    digests = [None if o else _ids_digest(e) if len(e) else NO_ENDS for e, o in zip(ends, opened)]
    up = np.where((depth > 0) & ~up_open, range_minimum(smallest, up_left, up_right), 0)
    parents = pa.array(up, pa.int64(), mask=(depth == 0) | up_open)
    return [range_minimum(smallest, left, right), depth, parents, members, children,
            sums["leaf"][right + 1] - sums["leaf"][left], saved, digests,
            [prefix(i, d) if o else None for i, (d, o) in enumerate(zip(depth, opened))],
            [prefix(i, d - 1) if o else None for i, (d, o) in enumerate(zip(depth, up_open))],
            [list(map(int, e)) if o else None for e, o in zip(ends, opened)], np.full(len(at), block)]


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[object, list[list]]]:
    """(value, columns) of each run of rows with equal values in column ``key``."""
    now, rows = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows is None or row[key] != now:
                if rows:
                    yield now, list(zip(*rows))
                now, rows = row[key], []
            rows.append(row)
    if rows:
        yield now, list(zip(*rows))


def _pieces(sequences: DataFrame, size: int) -> DataFrame:
    """Stored nodes of all blocks; those that reach over a border come in pieces."""
    flat = sequences.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("keys"),
                            F.transform("turns", lambda t: t["words"]).alias("words"))
    numbered = number_rows(flat, ["keys", "conv_id"])
    own, place = F.floor(F.col("number") / size), F.col("number") % size
    blocks = F.array_compact(F.array(own, F.when((place == 0) & (own > 0), own - 1), F.when(place == size - 1, own + 1)))
    rows = numbered.select(F.explode(blocks).alias("block"), "number", "conv_id", "keys", "words")
    schema = to_arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (_, numbers, ids, keys, words) in _groups(batches, 0):
            if numbers[0] >= (block + 1) * size or numbers[-1] < block * size:
                continue  # only the neighbour of a full last block: there is no such block
            columns = _block_nodes(block, size, np.array(numbers), np.array(ids), list(keys), list(words))
            table = pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            yield from table.to_batches(max_chunksize=4096)

    return materialize(rows.repartition("block").sortWithinPartitions("block", "number").mapInArrow(run, PIECES))


def _ends_digests(pieces: DataFrame) -> DataFrame:
    """(node, ends) for the nodes in pieces: the digest of the ids that end there. A piece
    holds at most a block's ids, in order; a node's pieces stream through one hash."""
    out = StructType([StructField("_node", BinaryType()), StructField("_ends", StringType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        done: list[tuple] = []
        for batch in batches:
            for key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if digest:
                        done.append((node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ids)).encode())
        if digest:
            done.append((node, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)

    rows = pieces.filter(F.size("ends") > 0).select("node", "block", "ends")
    return rows.repartition("node").sortWithinPartitions("node", "block").mapInArrow(run, out)


def prefix_trie(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations (conv_id, turns), as ``turn_lists`` gives them; ids must be
    distinct and not null. One row per distinct prefix, the empty one included.

    Conversations are sorted by their turns' digests (then id) and cut into blocks of
    ``block`` rows. In a block, LCPs of neighbours get a sparse table of range minima, and
    every candidate prefix finds the first and the last row of its interval by two binary
    searches of their own. Counts over an interval are differences of running sums. Nodes
    that reach over a block's border (at most the prefixes of its first and last row) come
    as pieces, which are summed by a digest of the prefix; a prefix shared by a third of
    all conversations is one piece per block. A conversation's digests, 16 bytes per turn,
    are one value of one row.

    Conversations without turns end at the root. Null turns, texts and repeated rows: see
    ``turn_lists``. An empty table has no node.

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (words of turns that members after the first share) and
    ends_sha256 (digest of the ids that end at the node, in order).
    """
    pieces = _pieces(sequences, block)
    parts = pieces.filter("node is not null")
    ends = _ends_digests(parts)
    merged = materialize(
        parts.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
        .join(ends, F.col("node") == F.col("_node"), "left")
        .withColumn("ends_sha256", F.coalesce("_ends", F.lit(NO_ENDS))).drop("_node", "_ends"))
    names = merged.select(F.col("node").alias("_parent"), F.col("conv_id").alias("_parent_id"))
    counted = ["conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = pieces.filter("node is null").select(counted).unionByName(
        merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(counted))
    return (nodes.join(names, F.col("parent") == F.col("_parent"), "left")
            .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent_id"))
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
