"""Mixing sources to target weights, with DataFrame functions only.

The words of a source are packed into blocks of fixed length, in a pseudorandom order of
its documents. The mix is a list of slots; a permutation of block numbers per source and
pass says which block fills a slot, and slots and blocks are joined by block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbering import number_rows
from ..session import materialize
from .shards import running_before

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 4_096         # slots made from one row at a time

ROUNDS = 32           # of the shuffle behind a permutation


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """Stored rows (source, source_size, n_docs, source_no, weight, target), one per source.

    Sources are numbered by code point (null last) and take the weights in turn. Together
    they get ``share`` of all sizes by weight; a source stops at ``most`` times its size,
    and what is left over goes to the others by weight until none is above. Each round of
    that is one sum over the sources; the driver sees two numbers per round.
    """
    sources = number_rows(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")),
                          [F.col("source").asc_nulls_last()], "source_no")
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("source_no") % len(weights)).cast("int")]
    sources = materialize(sources.withColumn("weight", weight))
    cap = F.col("source_size") * most
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        below = cap < F.col("weight") * level
        row = sources.agg(F.count_if(below).alias("n"), F.sum(F.when(below, cap)).alias("given"),
                          F.sum(F.when(~below, F.col("weight"))).alias("left")).first()
        if row["n"] == capped or not row["left"]:
            break
        capped, level = row["n"], (total - (row["given"] or 0.0)) / row["left"]
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def _permuted(k: Column, n: Column, *key) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by ``key``, sends ``k``.

    A swap-or-not shuffle: each round pairs every number x with (shift - x) modulo n and
    swaps a pair or not, by a hash of the pair's larger number, so each round permutes.
    """
    def step(x, round_no):
        other = F.pmod(F.pmod(F.xxhash64(*key, round_no), n) + n - x, n)
        swap = F.xxhash64(*key, round_no, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k.cast("long"), step)


def place_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, most, seed,
                    key_col: str | None = None) -> DataFrame:
    """Stored rows (row, doc_id, size, source columns, start): where each document starts
    among its source's words. Documents follow each other by a hash of id and text, so the
    order does not depend on how the input is split; only rows alike in both are told apart
    by where they stand. Running totals go over slices of consecutive rows and then over
    the slices, so a hot source is no single task."""
    text = F.col(text_col)
    sizes = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("order"), (F.col(key_col) if key_col else F.monotonically_increasing_id()).alias("row")))
    placed = materialize(running_before(sizes, [F.col("source").asc_nulls_last(), "order", "row"], "size", "before"))
    sources = source_targets(placed, weights, share, most).alias("s")
    first = placed.groupBy("source").agg(F.min("before").alias("first")).alias("f")
    # Spark broadcasts the table of sources if it is small; else it splits a hot source
    known = sources.join(first, F.col("s.source").eqNullSafe(F.col("f.source"))).select("s.*", "first")
    return materialize(
        placed.alias("d").join(known.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")))
        .select("row", "doc_id", "size", "source_no", "source_size", "target", (F.col("before") - F.col("first")).alias("start")))


def shard_draws(sources: DataFrame, total: int, shards: int, shard_slots: int, seed: int) -> DataFrame:
    """(source_no, shard, first, n): how many slots of each shard go to each source, and
    the number of the first of them among the source's slots.

    ``sources`` has source_no, slots and upto (the slots of the sources before). Every slot
    of every shard draws a source in proportion to its slots, so the counts of a shard are
    one multinomial draw. A source's slots run through the shards in order. What it draws
    beyond its slots is left out, and what it has left goes to one more, last shard, so
    that totals are exact; that shard and the ones left short differ from the others by
    about the square root of the number of slots.
    """
    spark, wide = sources.sparkSession, F.lit(max(1, total))
    # cells of like width on the line of all slots: a draw meets the sources of its cell only
    cells = max(1, sources.count())
    cell = lambda x: F.floor(x * F.lit(cells) / wide)
    spread = sources.select("source_no", "slots", "upto", F.explode(F.sequence(
        cell(F.col("upto")), cell(F.col("upto") + F.col("slots") - 1))).alias("cell"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    draws = (spark.range(0, shards * shard_slots, 1, parts).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), wide).alias("x"))
        .withColumn("own", cell(F.col("x"))))
    met = draws.join(spread, F.col("own") == F.col("cell")).filter((F.col("x") >= F.col("upto")) & (F.col("x") < F.col("upto") + F.col("slots")))
    counts = materialize(met.groupBy("source_no", "slots", "shard").agg(F.count("*").alias("n")))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    used = counts.groupBy(F.col("source_no").alias("_no")).agg(F.sum("n").alias("_used"))
    rest = (sources.join(used, F.col("source_no") == F.col("_no"), "left").withColumn("first", F.coalesce("_used", F.lit(0)))
            .withColumn("n", F.col("slots") - F.col("first")).filter("n > 0"))
    cut = drawn.withColumn("n", F.least(F.col("n"), F.col("slots") - F.col("first"))).filter("n > 0")
    return cut.select("source_no", "shard", "first", "n").unionByName(
        rest.select("source_no", F.lit(shards).cast("long").alias("shard"), "first", "n"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 1024,
        shard_slots: int = 1024, seed: int = 7, key_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix documents so that each source gives its target number of words.

    Returns (documents, spans). ``documents`` has one row per input row: row, doc_id, size,
    source_size, target. ``spans`` has what the mix takes: shard, slot (among its source's),
    source_no, pass, row, doc_id, place (in its block), from_word, n_words.

    A source of S words and a target of t (rounded) takes all its blocks t div S times and
    then the first blocks of one more permutation, the last one cut, so that it gives
    exactly t words. The short block at a source's end comes last in its pass. How many
    slots of a source a shard holds is drawn per shard (``shard_draws``). A document is taken
    at most ``most`` times, rounded up. Everything depends on hashes of ids, texts and slot
    numbers: a rerun, a retried task or another split of the input gives the same mix.

    Null and empty texts have size 0 and are not taken; a null source is a source of its
    own, the last; repeated rows are documents of their own; extra columns are ignored;
    an empty table gives empty results. ``row`` tells rows apart: ``key_col``, if given.
    """
    placed = place_documents(docs, id_col, text_col, source_col, weights, share, most, seed, key_col)
    b, size, start = F.lit(block), F.col("size"), F.col("start")
    spans = (placed.filter("size > 0")
             .withColumn("block", F.explode(F.sequence(F.floor(start / b), F.floor((start + size - 1) / b))))
             .withColumn("place", F.greatest(start - F.col("block") * b, F.lit(0)))
             .withColumn("from_word", F.greatest(F.col("block") * b - start, F.lit(0)))
             .withColumn("n", F.least(start + size, (F.col("block") + 1) * b) - F.greatest(start, F.col("block") * b))
             .select("source_no", "block", "place", "row", "doc_id", "from_word", "n"))

    words, full = F.col("source_size"), F.floor(F.col("source_size") / b)
    sources = (placed.filter("source_size > 0").groupBy("source_no", "source_size", "target").agg(F.count("*").alias("_n"))
               .withColumn("take", F.round("target").cast("long"))
               .withColumn("full", full).withColumn("blocks", F.ceil(words / b))
               .withColumn("passes", F.floor(F.col("take") / words))
               .withColumn("rest", F.col("take") - F.col("passes") * words)
               .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b)).filter("slots > 0"))
    sources = materialize(running_before(sources, ["source_no"], "slots", "upto").drop("number"))
    total = sources.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, total // shard_slots)
    draws = shard_draws(sources.select("source_no", "slots", "upto"), total, shards, shard_slots, seed).alias("d")
    mine = draws.join(sources.alias("s"), F.col("d.source_no") == F.col("s.source_no")).select("s.*", "shard", "first", "n")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    number = F.sequence(F.col("first") + F.col("chunk") * CHUNK, F.col("first") + F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)
    slots = (mine.withColumn("chunk", chunk).repartition("source_no", "shard", "chunk").withColumn("slot", F.explode(number))
             .withColumn("pass", F.floor(F.col("slot") / F.col("blocks")))
             .withColumn("k", F.col("slot") % F.col("blocks"))
             .withColumn("block", F.when(F.col("k") < F.col("full"), _permuted(
                 F.col("k"), F.greatest(F.col("full"), F.lit(1)), F.lit(seed), F.col("source_no"), F.col("pass"))).otherwise(F.col("k")))
             .withColumn("cut", F.when(F.col("pass") < F.col("passes"), b)
                         .otherwise(F.least(b, F.col("rest") - F.col("k") * b)))
             .select("source_no", "block", "shard", "slot", "pass", "cut"))
    taken = slots.join(spans, ["source_no", "block"]).withColumn(
        "n_words", F.least(F.col("n"), F.col("cut") - F.col("place"))).filter("n_words > 0")
    return (placed.select("row", "doc_id", "size", "source_size", "target"),
            taken.select("shard", "slot", "source_no", "pass", "row", "doc_id", "place", "from_word", "n_words"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, the words the mix takes, and to how
    many output shards they go."""
    rows, spans = mix(docs, **options)
    taken = (spans.groupBy("row", "shard").agg(F.sum("n_words").alias("n"))
             .groupBy(F.col("row").alias("_row")).agg(F.sum("n").alias("taken"), F.count("*").alias("n_shards")))
    none = F.lit(0)
    return rows.join(taken, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", none).cast("long").alias("taken"),
        F.coalesce("n_shards", none).cast("long").alias("n_shards"))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix as it is written: one row (shard, source_no, slot, words, text) per slot, a
    block of at most ``block`` words joined by one space, in an order by hash in its shard.
    Partition by shard to write it. Cases as in ``mix``."""
    source_col = options.pop("source_col", "source")
    stored = materialize(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
                         .withColumn("_key", F.monotonically_increasing_id()))
    _, spans = mix(stored, "_id", "text", "source", key_col="_key", **options)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"))
    parts = spans.join(stored.select("_key", "text"), F.col("row") == F.col("_key")).select(
        "shard", "source_no", "slot", F.struct("place", "n_words", F.array_join(F.slice(
            words, (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("text")).alias("part"))
    whole = parts.groupBy("shard", "source_no", "slot").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select("shard", "source_no", "slot", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n_words"]).alias("words"),
                        F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text")).sortWithinPartitions(
        "shard", F.xxhash64("source_no", "slot"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    count_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents, with the columns of the input: one row per document and pass
    that takes any of its words. A document taken whole keeps its text as it is; of a
    document taken in part, the taken words stand in their order, joined by one space.
    ``count_col`` gets the new length in code points."""
    columns = docs.columns
    stored = materialize(docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
                         .withColumn("_key", F.monotonically_increasing_id()))
    own = {c: f"_c{i}" for i, c in enumerate(columns)}
    text = own[text_col]
    _, spans = mix(stored, own[id_col], text, own[source_col], key_col="_key", **options)
    parts = spans.groupBy(F.col("row").alias("_id"), "pass").agg(
        F.sum("n_words").alias("_n"), F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("_parts"))
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"))
    some = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(
        "_words", (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")))), " ")
    whole = F.col("_n") == word_count(F.col(text))
    rows = (stored.join(parts, F.col("_key") == F.col("_id"))
            .withColumn("_words", F.when(~whole, words))
            .withColumn(text, F.when(whole, F.col(text)).otherwise(some)))
    if count_col in columns:
        count = f"_c{columns.index(count_col)}"
        rows = rows.withColumn(count, F.char_length(text).cast(docs.schema[count_col].dataType))
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
