"""Near-duplicate texts: ProbMinHash signatures, banding, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.numbering import number_rows
from ..session import materialize
from .graph import components
from .text import BASES, mix, span_hashes, tidy, window_hashes, word_hashes

SHINGLE = 5
CHUNK = 1 << 18  # shingles of documents whose signatures are computed together
ROWS = 256  # documents whose shingles are held at once
BLOCK = 512  # documents of a bucket that are compared with another such block at once
_STEP = np.uint64(0xD1B54A32D192ED03)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of five words and how often each occurs. A text of one
    to four words has one shingle, all of it; a text without words has none."""
    words = word_hashes((text or "").encode("utf-8", "replace"))
    if 0 < len(words) < SHINGLE:
        whole = span_hashes(words, np.array([0]), np.array([len(words)]), BASES[0])
        return whole, np.ones(1, np.int64)
    return np.unique(window_hashes(words, SHINGLE, BASES[0]), return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared i of 1 / sum over j of max(a_j / a_i, b_j / b_i), exactly.

    Sorted by a_j / b_j, the larger quotient is a's from element i on and b's before it,
    so running sums give every inner sum.
    """
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(at_a):
        return 0.0
    x, y = a[1][at_a].astype(float), b[1][at_b].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    from_here = x[::-1].cumsum()[::-1] + only_a
    before = y.cumsum() - y + only_b
    return float((1 / (from_here / x + before / y)).sum())


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash: for each register the element that arrives first, one row per set.

    Elements arrive as Poisson processes at a rate equal to their weight and hit a random
    register each time, so two sets agree in a register with a chance equal to their
    probability Jaccard. The k-th waiting time and register come from the element's hash
    and k alone; a weight only speeds the clock up. All sets are drawn together, one
    arrival of every element per round. An element ends early: as soon as an arrival of it
    is later than the latest register of its set, neither that nor any later one can
    matter. Sets must not be empty.
    """
    hashes = np.concatenate([s[0] for s in sets])
    weights = np.concatenate([s[1] for s in sets]).astype(float)
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    first, which = np.full(len(sets) * registers, np.inf), np.zeros(len(sets) * registers, np.uint64)
    latest = np.full(len(sets), np.inf)  # no end while a register is empty
    time, state = np.zeros(len(hashes)), hashes.copy()
    while len(state):
        state = state + _STEP
        drawn = mix(state)
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        time = time - np.log(uniform) / weights
        on = time < latest[owner]
        state, time, weights, owner, hashes, drawn = state[on], time[on], weights[on], owner[on], hashes[on], drawn[on]
        slot = owner * registers + (mix(drawn ^ _STEP) % np.uint64(registers)).astype(np.int64)
        sooner = np.flatnonzero(time < first[slot])
        order = sooner[np.lexsort((time[sooner], slot[sooner]))]
        slots, at = np.unique(slot[order], return_index=True)
        first[slots], which[slots] = time[order[at]], hashes[order[at]]
        latest = first.reshape(-1, registers).max(axis=1)
    return which.reshape(len(sets), registers)


def _chunks(sizes: list[int]) -> Iterator[slice]:
    """Consecutive sets of ``CHUNK`` elements together, or one set where it alone has more."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > CHUNK:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield slice(start, len(sizes))


def _signature_table(docs: DataFrame, kind: str, bands: int, rows: int) -> DataFrame:
    """Stored rows (doc_id, digest, sketch, bands): digest of the words, 16 bits of each
    register, one key per band. Texts without words have null everywhere."""
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.iloc[start:start + ROWS]
                sets = [shingles(t) for t in part["text"]]
                some = [i for i, s in enumerate(sets) if len(s[0])]
                digest, sketch, keys = ([None] * len(part) for _ in range(3))
                for chunk in _chunks([len(sets[i][0]) for i in some]):
                    table = signatures([sets[i] for i in some[chunk]], bands * rows)
                    low = (mix(table) & np.uint64(0xFFFF)).astype(np.uint16)
                    key = number * _STEP
                    for r in range(rows):
                        key = mix(key * np.uint64(31) + table[:, r::rows])
                    for at, i in enumerate(some[chunk]):
                        words = b" ".join((part["text"].iloc[i]).encode("utf-8", "replace").split())
                        digest[i] = hashlib.sha256(words).digest()
                        sketch[i], keys[i] = low[at].tobytes(), key[at].view(np.int64)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "digest": digest, "sketch": sketch, "bands": keys})

    return materialize(docs.mapInPandas(tidy(compute), f"doc_id {kind}, digest binary, sketch binary, bands array<long>"))


def _promising(pairs: DataFrame, sketches: DataFrame, kind: str, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree in at least the share ``least`` of registers."""
    first = sketches.select(F.col("doc_id").alias("_a"), F.col("sketch").alias("sketch_a"))
    second = sketches.select(F.col("doc_id").alias("_b"), F.col("sketch").alias("sketch_b"))
    joined = pairs.join(first, F.col("a") == F.col("_a")).join(second, F.col("b") == F.col("_b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), -1) for c in ("sketch_a", "sketch_b"))
                yield batch.loc[(x == y).mean(axis=1) >= least, ["a", "b"]]

    return joined.select("a", "b", "sketch_a", "sketch_b").mapInPandas(compare, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, texts: DataFrame, kind: str, threshold: float) -> DataFrame:
    """The pairs whose probability Jaccard, computed from both whole texts, is large enough."""
    first = texts.select(F.col("doc_id").alias("_a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("_b"), F.col("text").alias("text_b"))
    joined = pairs.join(first, F.col("a") == F.col("_a")).join(second, F.col("b") == F.col("_b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_id, kept = None, None  # neighbours often share their second text
        for batch in batches:
            good = []
            for b, x, y in zip(batch["b"], batch["text_a"], batch["text_b"]):
                if b != kept_id:
                    kept_id, kept = b, shingles(y)
                good.append(probability_jaccard(shingles(x), kept) >= threshold)
            yield batch.loc[good, ["a", "b"]]

    return joined.select("a", "b", "text_a", "text_b").mapInPandas(tidy(verify), f"a {kind}, b {kind}")


def _linked_in_block(sets: list, roots: np.ndarray, allowed: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that join different roots, as few as join all that can be
    joined, among the allowed pairs whose probability Jaccard is large enough.

    Two matrix products give, for all pairs, the share of each text's weight that lies in
    shared shingles. The smaller share is never below the probability Jaccard, and if no
    shingle repeats it gives the plain Jaccard, which is then equal to it. Other pairs
    whose bound is large enough are computed exactly.
    """
    n = len(sets)
    size = np.array([s[1].sum() for s in sets], float)
    flat = np.array([len(s[0]) for s in sets]) == size
    owner = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    hashes, weights = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner, weights = owner[shared], weights[shared]
    share = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, weights, column = owner[order], weights[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        low, high = np.searchsorted(column, (start, start + 2048))
        part = (owner[low:high], column[low:high] - start)
        own, has = np.zeros((n, 2048), np.float32), np.zeros((n, 2048), np.float32)
        own[part], has[part] = weights[low:high], 1
        share += own @ has.T
    share = share.astype(float)
    both = np.where(np.add.outer(size, size) > share, share / (np.add.outer(size, size) - share), 1.0)
    plain = flat[:, None] & flat[None, :]
    bound = np.where(plain, both, np.minimum(share / size[:, None], share.T / size[None, :]))
    parent = {r: r for r in roots.tolist()}

    def find(r):
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    links = []
    a, b = np.nonzero(np.triu(allowed & (bound >= threshold - 1e-9), 1))
    for x, y in zip(a.tolist(), b.tolist()):
        one, two = find(roots[x].item()), find(roots[y].item())
        if one != two and ((plain[x, y] and both[x, y] >= threshold) or
                           (not plain[x, y] and probability_jaccard(sets[x], sets[y]) >= threshold)):
            parent[one] = two
            links.append((x, y))
    return links


def _crossing_links(members: DataFrame, texts: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Links between the classes that meet in a bucket, for rows (key, doc_id, root, bands).

    A bucket is cut in blocks of up to ``BLOCK`` documents and every two blocks (nearly
    always the one with itself) are compared by one call, with the whole texts. A pair that
    shares several buckets is compared in the first of them. At most one link per document
    leaves a call, so a bucket of m documents gives rows in proportion to m.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cut = (cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))
    rows = cut.join(texts.select(F.col("doc_id").alias("_id"), "text"), F.col("doc_id") == F.col("_id"))
    rows = rows.select("key", "i", "j", "own", "doc_id", "root", "bands", "text")

    def compare(rows: pd.DataFrame) -> list[tuple]:
        key, i, j = rows["key"].iloc[0], rows["i"].iloc[0], rows["j"].iloc[0]
        roots, own = rows["root"].to_numpy(), rows["own"].to_numpy()
        keys = np.stack(rows["bands"].to_list())
        band = int(np.flatnonzero(keys[0] == key)[0])
        allowed = roots[:, None] != roots[None, :]
        if i != j:
            allowed &= own[:, None] != own[None, :]
        for earlier in range(band):
            allowed &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
        if not allowed.any():
            return []
        ids = rows["doc_id"].to_numpy()
        return [(ids[x], ids[y]) for x, y in _linked_in_block([shingles(t) for t in rows["text"]], roots, allowed, threshold)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            group = rows.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
            done = group < group[-1] if len(rows) else group < 0
            links = [link for _, part in rows[done].groupby(group[done]) for link in compare(part)]
            rest = rows[~done]
            yield pd.DataFrame(links, columns=["a", "b"])
        if rest is not None and len(rest):
            yield pd.DataFrame(compare(rest), columns=["a", "b"])

    ordered = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInPandas(tidy(run), f"a {kind}, b {kind}")


def words_digest(text_col: str):
    """The digest of ``_signature_table`` for a text with words."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.col(text_col), r"[\x20\x09-\x0D]+", " ")), 256))


def _keyed_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, bands: int = 20, rows: int = 4) -> DataFrame:
    """One row per input row: doc_id, digest of the words, class_id, kept. Each text with
    words of its own is numbered in the order of (its smallest id, digest), and the
    numbers stand for the texts (as doc_id) until the classes are known."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stored = _signature_table(source, source.schema["doc_id"].dataType.simpleString(), bands, rows)
    sketches = number_rows(stored.filter("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), ["id", "digest"], "doc_id")
    kind = "bigint"
    keys = sketches.select("doc_id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).filter("centre < last")
    members = materialize(keys.join(buckets.select("key", "centre"), "key"))
    some = members.select("doc_id").distinct().join(sketches.select("doc_id", "id", F.col("digest").alias("_digest")), "doc_id")
    # the text must be the one of the digest: an id may stand on several
    texts = materialize(source.select(F.col("doc_id").alias("_id"), "text", words_digest("text").alias("digest"))
                        .join(some, (F.col("_id") == F.col("id")) & (F.col("digest") == F.col("_digest")))
                        .select("doc_id", "text").dropDuplicates(["doc_id"]))

    stars = members.filter("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    links = materialize(_verified(_promising(stars, sketches, kind, threshold - 0.3), texts, kind, threshold))
    classes = components(links)
    placed = (members.join(classes, F.col("doc_id") == F.col("node"), "left")
              .select("key", "doc_id", "centre", F.coalesce("root", "doc_id").alias("root")))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    open_rows = (placed.join(mixed, "key").select("key", "doc_id", "root")
                 .join(sketches.select(F.col("doc_id").alias("_id"), "bands"), F.col("doc_id") == F.col("_id")).drop("_id"))
    more = materialize(_crossing_links(open_rows, texts, kind, threshold).distinct())
    # the links of the stars are already summed up in their classes
    classes = components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    roots = sketches.select(F.col("doc_id").alias("root"), F.col("id").alias("class_id"), F.col("digest").alias("root_digest"))
    same = (sketches.select("digest", "doc_id").join(classes, F.col("doc_id") == F.col("node"), "left")
            .select(F.col("digest").alias("_digest"), F.coalesce("root", "doc_id").alias("root")).join(roots, "root").drop("root"))
    smallest = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("digest").eqNullSafe(F.col("root_digest"))
    return (stored.select("doc_id", "digest").join(same, F.col("digest") == F.col("_digest"), "left")
            .withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
            .withColumn("kept", F.col("doc_id").isNull() | F.col("digest").isNull() | smallest)
            .select("doc_id", "digest", "class_id", "kept"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                 bands: int = 20, rows: int = 4) -> DataFrame:
    """Classes of texts connected by a probability Jaccard of ``threshold`` or more over
    five-word shingles weighted by their counts.

    Texts with the same words form one text at once. Signatures of ``bands`` x ``rows``
    registers are banded; a pair at 0.8 shares no band with a chance below 3 in 100,000.
    First every member of a bucket is compared with the bucket's smallest id, which leaves
    most buckets in one class, however large; such pairs are rejected only if their sketches
    agree in less than threshold - 0.3 of the registers (over six standard errors) or by the
    exact similarity of their whole texts. Then, in buckets where classes still meet, the
    documents of different classes are compared exactly, in blocks.

    Null, empty and blank texts are classes of their own, as are rows with a null id.
    Repeated rows share a class. Extra columns are ignored; an empty table gives no rows.

    An id that stands on several texts stands for each of them on its own.

    Returns one row per input row: doc_id, class_id (the smallest id of the class), kept
    (of texts of one class that share the smallest id, one).
    """
    return _keyed_classes(docs, id_col, text_col, threshold, bands, rows).select("doc_id", "class_id", "kept")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the smallest id of their class, with their columns. Dropped are
    texts of an id, not ids."""
    dropped = _keyed_classes(docs, id_col, text_col, **options).filter("not kept").select(
        F.col("doc_id").alias("_dropped_id"), F.col("digest").alias("_dropped_digest")).distinct()
    return docs.join(dropped, (docs[id_col] == dropped["_dropped_id"]) & (words_digest(text_col) == dropped["_dropped_digest"]), "left_anti")
