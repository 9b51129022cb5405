"""Chat formatting of reply trees; DataFrame functions only.

A turn is written as START, role, newline, escaped text and END. In texts a backslash becomes BACK and OPEN becomes
SHUT, so no text can hold a control string, and both steps can be undone. Roles are escaped alike, newlines too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work

START, END = "<|turn|>", "<|end|>\n"
OPEN, SHUT, SLASH, BACK = "<|", "<\\p", "\\", "\\b"
NEWLINE = "\\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(SLASH), F.lit(BACK)), F.lit(OPEN), F.lit(SHUT))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(SHUT), F.lit(OPEN)), F.lit(BACK), F.lit(SLASH))


def paths(nodes: DataFrame, tree: str, longest: int) -> DataFrame:
    """(tree, leaf, node, up) for every root-to-leaf path: up counts the steps from the leaf to the node.

    Self-joins double the reach of each node's link to an ancestor, then the leaves take the links from the longest to the
    shortest: a path of n nodes needs about log2(n) rounds each way, not n. longest is the number of nodes of the longest
    path, or more. Each reach is written as a table, so plans stay small and lost executors cost one round. A node whose
    parent is missing is a root; nodes on a cycle have no leaf and give no path.
    """
    work = Work(nodes.sparkSession)
    edges = nodes.select(tree, "node", F.col("parent").alias("to")).where("parent IS NOT NULL")
    links = [work.put(edges.join(nodes.select(tree, F.col("node").alias("to")), [tree, "to"], "left_semi"), "up0")]
    while 2 ** len(links) < longest:
        a = links[-1]
        b = a.select(tree, F.col("node").alias("to"), F.col("to").alias("further"))
        links.append(work.put(a.join(b, [tree, "to"]).select(tree, "node", F.col("further").alias("to")), f"up{len(links)}"))
    inner = links[0].select(tree, F.col("to").alias("node"))
    found = nodes.select(tree, "node").join(inner, [tree, "node"], "left_anti").select(tree, F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    for k in reversed(range(len(links))):
        here = F.struct("node", "up")
        there = F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up")))
        both = found.join(links[k], [tree, "node"], "left").select(tree, "leaf", F.explode(F.array_compact(F.array(here, there))).alias("x"))
        found = both.select(tree, "leaf", "x.node", "x.up")
    return found


def reply_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as a tree of nodes: node is the row's place in its conversation, parent the place before, score 0.

    Null roles and texts count as empty, a null conversation is a conversation, null turns come first, equal turns are
    ordered by role and text and repeated rows stay. An empty table gives no nodes; other columns are not read.
    """
    rows = turns.select(F.col(conv), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = Window.partitionBy(conv).orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order))
    return rows.select(conv, "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_trees(nodes: DataFrame, tree: str = "conv_id", best: int = 1) -> DataFrame:
    """The best paths of each tree, each as one conversation: tree, leaf, rank, segments and formatted.

    nodes has tree, node, parent, role, text and score; node is unique in a tree and a root has no parent. A path's score is
    the sum of its nodes'; equal scores are ranked by the lower leaf. segments are the pieces of the formatted text in
    order, each with loss, which is true for an assistant's text only: the mask over the formatted text.
    """
    work = Work(nodes.sparkSession)
    named = nodes.select(tree, "node", "parent", "role", "text", "score")
    nodes = work.put(named.withColumn("_tree", F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("null"))), "nodes")
    longest = nodes.groupBy("_tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    found = paths(nodes, "_tree", longest)
    steps = found.join(nodes, ["_tree", "node"])
    piece = F.struct((-F.col("up")).alias("at"), "role", "text")
    whole = steps.groupBy("_tree", "leaf").agg(F.first(tree).alias(tree), F.sum("score").alias("path_score"), F.sort_array(F.collect_list(piece)).alias("turns"))
    rank = Window.partitionBy("_tree").orderBy(F.col("path_score").desc(), "leaf")
    chosen = whole.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= best)

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    out = chosen.select(tree, "leaf", "rank", F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.withColumn("formatted", F.concat_ws("", F.col("segments.text")))


def read_back(formatted: Column) -> Column:
    """An array of (role, text), parsed from formatted text."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p.startswith(START))

    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit("\n"))
        role = unescape(F.replace(F.substring(p, F.lit(len(START) + 1), at - len(START) - 1), F.lit(NEWLINE), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(F.substring(p, at + 1, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))
