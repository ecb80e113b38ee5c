"""Chat formatting of reply trees, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbering import number_rows
from ..session import materialize

# The template's control strings.
OPEN, CLOSE, MARK = "<|im_start|>", "<|im_end|>", "<|"


def escape(text: Column) -> Column:
    """Text without control strings: a backslash becomes \\b, ``<|`` becomes \\l|. No
    output holds ``<|``, and every backslash in it begins an escape."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(MARK), F.lit("\\l|"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and line ends become \\n, since a role ends with its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """The inverse of both."""
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def reply_nodes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """Stored nodes (tree, node, parent, role, text, score) of flat conversations: each
    message replies to the one before it in order of turn (null first); of equal turns the
    smaller role, then the smaller text comes first. Null roles and texts count as empty.
    The score is 0 throughout, as a chain has one branch."""
    rows = messages.select(F.col(conversation).alias("tree"), F.col(turn).alias("turn"),
                           F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = number_rows(rows, ["tree", "turn", "role", "text"], "node")
    before = numbered.select((F.col("node") + 1).alias("_next"), F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    same = (F.col("node") == F.col("_next")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return materialize(numbered.join(before, same, "left").select(
        "tree", "node", F.col("_node").alias("parent"), "role", "text", F.lit(0.0).alias("score")))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees by iterated self-joins.

    ``nodes`` has node (unique), parent (null for a root) and score. Round i joins the
    table of 2**i-step ancestors with itself, so a path of n messages takes log2(n) rounds
    and no round holds more than one row per message. Per root, the ``branches`` leaves
    whose paths have the highest mean score are chosen (ties: the smaller leaf), and only
    their paths are walked, again by those tables. A parent that does not exist makes its
    child a root; messages whose parents form a circle are on no path. A null score is 0.

    Returns rows (leaf, branch, node, steps): branch counts from 1 per root, steps from
    the leaf, which has 0.
    """
    base = nodes.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("total"))
    known = base.select(F.col("node").alias("_known"))
    jump = materialize(base.join(known, F.col("parent") == F.col("_known"), "left")
                       .select("node", F.col("_known").alias("up"), "total", F.lit(1).cast("long").alias("length"),
                               F.coalesce("_known", "node").alias("top")))
    tables = [jump]
    for _ in range(math.ceil(math.log2(max(2, jump.count()))) + 1):
        if not jump.filter("up is not null").limit(1).count():
            break
        far = jump.select(*[F.col(c).alias(f"_{c}") for c in jump.columns])
        jump = materialize(jump.join(far, F.col("up") == F.col("_node"), "left").select(
            "node", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"),
            (F.col("length") + F.coalesce("_length", F.lit(0))).alias("length"), F.coalesce("_top", "top").alias("top")))
        tables.append(jump)
    replied = tables[0].filter("up is not null").select(F.col("up").alias("_replied")).distinct()
    leaves = jump.filter("up is null").join(replied, F.col("node") == F.col("_replied"), "left_anti")
    best = Window.partitionBy("top").orderBy(F.desc(F.col("total") / F.col("length")), "node")
    paths = (leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches)
             .select(F.col("node").alias("leaf"), "branch", "node", F.lit(0).cast("long").alias("steps")))
    for i, table in reversed(list(enumerate(tables))):
        far = table.filter("up is not null").select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        further = paths.join(far, F.col("node") == F.col("_node")).select(
            "leaf", "branch", F.col("_up").alias("node"), (F.col("steps") + 2 ** i).alias("steps"))
        paths = materialize(paths.unionByName(further))
    return paths


def format_paths(nodes: DataFrame, branches: int = 1, trained: str = "assistant") -> DataFrame:
    """One formatted conversation per chosen path.

    Returns (tree, leaf, branch, n_turns, formatted, loss): loss lists the spans (start,
    length, in code points, from 0) of ``formatted`` to be trained on, the texts of the
    role ``trained``. A conversation is one value of one row, so its turns meet in one
    task; nothing larger than a conversation does.
    """
    turns = reply_paths(nodes, branches).join(
        nodes.select(F.col("node").alias("_node"), "tree", "role", "text"), F.col("node") == F.col("_node"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("body", escape(F.col("text"))).select(
        "tree", "leaf", "branch", F.struct(
            (-F.col("steps")).alias("at"), F.concat("head", "body", F.lit(f"{CLOSE}\n")).alias("turn"),
            F.char_length("head").alias("before"), F.char_length("body").alias("length"),
            (F.col("role") == trained).alias("trained")).alias("t"))
    whole = turns.groupBy("leaf", "branch").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list("t")).alias("turns"))
    span = "array<struct<start:bigint,length:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))

    def step(state, t):
        here = F.struct((state["at"] + t["before"]).alias("start"), t["length"].cast("long").alias("length"))
        return F.struct((state["at"] + F.char_length(t["turn"])).alias("at"),
                        F.when(t["trained"], F.concat(state["spans"], F.array(here))).otherwise(state["spans"]).alias("spans"))

    return whole.select("tree", "leaf", "branch", F.size("turns").cast("long").alias("n_turns"),
                        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
                        F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    tail = len(CLOSE) + 1

    def read(piece):
        role = F.substring_index(piece, "\n", 1)
        at = F.char_length(role) + 2
        text = F.substr(piece, at, F.char_length(piece) - at + 1 - tail)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), read)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
