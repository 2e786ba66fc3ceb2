"""Chat formatting: reply trees become conversations.

Paths from roots to leaves are found by iterative self-joins that double their reach: after k joins every node knows
its ancestor 2^k steps up, and every leaf its 2^k nearest ones, for both meet the same pointers in one join. Depth d
takes log2(d) + 1 joins of ids alone, each written to the shared folder in place of the one before; texts are joined
once, to the finished paths. The rows held are the nodes plus the paths themselves. A path ends as one row, so the task
that formats it holds that one path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import settle, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(col: Column) -> Column:
    r"""Reversible: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no control string is left in a text."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(col: Column) -> Column:
    r"""As escape(), and a line feed becomes ``\n``: the role ends at the first line feed."""
    return F.replace(escape(col), F.lit("\n"), F.lit("\\n"))


def unescape(text: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def _ancestors(nodes: DataFrame, n: int) -> DataFrame:
    """Every leaf (tree, leaf) with each of its ancestors (node), itself first, and how many steps up that is (up).

    nodes: n rows, at most one of each node. A leaf below a cycle gets n steps or more.
    """
    here = nodes.select("tree", F.col("node").alias("source"), F.col("parent").alias("at"))
    known = nodes.select("tree", F.col("node").alias("at"))
    pointers = here.join(known, ["tree", "at"], "left_semi").select("tree", "source", "at", F.lit(1).alias("up"), F.lit(False).alias("path"))
    leaves = nodes.select("tree", "node").join(nodes.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    steps = settle(pointers.unionByName(leaves.select("tree", F.col("node").alias("source"), F.col("node").alias("at"), F.lit(0).alias("up"), F.lit(True).alias("path"))), "chat-steps")
    reach = 1
    while n >= reach and not steps.filter("not path").isEmpty():
        # each round is written: united with a join of itself, the plan would double
        jumps = steps.filter("not path").select("tree", F.col("source").alias("at"), F.col("at").alias("next"))
        further = steps.join(jumps, ["tree", "at"]).select("tree", "source", F.col("next").alias("at"), (F.col("up") + reach).alias("up"), "path")
        steps = settle(steps.filter("path").unionByName(further), "chat-steps", steps)
        reach *= 2
    return steps.filter("path").select("tree", F.col("source").alias("leaf"), F.col("at").alias("node"), "up")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """Every root-to-leaf path of reply trees.

    nodes: tree_id, node_id, parent_id (null or unknown: a root), role, text, score. Other columns are ignored. Of rows
    with one node_id in a tree the least by (parent_id, role, text, score) counts. A null tree_id is a tree of its own;
    rows without node_id are left out; nodes on a cycle, or below one, have no root and so no path. Null scores are 0,
    null roles and texts empty.

    Returns tree (a struct of tree_id), leaf, pos (0: root), role, text, score, a row for each node of each path.
    """
    one = F.min(F.struct(F.col("parent_id").alias("parent"), text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("x")
    nodes = nodes.filter(F.col("node_id").isNotNull()).groupBy(F.struct("tree_id").alias("tree"), F.col("node_id").alias("node")).agg(one).select("tree", "node", "x.*")
    nodes = settle(nodes, "chat-nodes")
    n = nodes.count()
    rows = _ancestors(nodes, n).join(nodes, ["tree", "node"]).withColumn("last", F.max("up").over(Window.partitionBy("tree", "leaf")))
    # a path has n nodes at most; more are on a cycle
    rows = rows.filter(F.col("last") < n).withColumn("pos", F.col("last") - F.col("up"))
    return rows.select("tree", "leaf", "pos", "role", "text", "score")


def format_paths(paths: DataFrame, keep: int | None = None) -> DataFrame:
    """One conversation a path: its turns in the template's marks, and the spans of the loss mask.

    Branches of a tree rank by their mean score, then by leaf; keep: how many of each tree (None: all).
    Returns tree_id, leaf_id, branch_rank, score, n_turns, formatted, loss_spans (start, end in code points of
    formatted; the text of each assistant turn, without marks).
    """
    piece = F.concat(F.lit(START), F.col("r"), F.lit("\n"), F.col("t"), F.lit(END + "\n"))
    rows = paths.select("tree", "leaf", "pos", "role", "score", escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("t")).withColumn("piece", piece)
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(START) + F.length("r") + 1)
    rows = rows.withColumn("until", F.col("at") + F.length("t"))
    out = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("pos", "piece", "role", "at", "until"))).alias("x"), F.avg("score").alias("score"))
    trained = F.filter("x", lambda x: x["role"] == TRAINED_ROLE)
    out = out.select(
        F.col("tree.tree_id").alias("tree_id"), F.col("leaf").alias("leaf_id"),
        F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")).alias("branch_rank"), "score",
        F.size("x").cast("long").alias("n_turns"), F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(trained, lambda x: F.struct(x["at"].cast("long").alias("start"), x["until"].cast("long").alias("end"))).alias("loss_spans"),
    )
    return out if keep is None else out.filter(F.col("branch_rank") <= keep)


def format_conversations(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """reply_paths() and format_paths(); an empty table gives an empty result."""
    return format_paths(reply_paths(nodes), keep)


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row answers the one before.

    Rows with the same turn, or none, stay in the order of (turn, nulls last; role; text); repeated rows are turns of
    their own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), text_or_empty(F.col("role")), text_or_empty(F.col("text")))
    rows = turns.select("conv_id", "role", "text", F.row_number().over(order).alias("node_id"))
    return rows.select(F.col("conv_id").alias("tree_id"), "node_id", (F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation holds."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape(role, role=True), unescape(rest.removesuffix("\n").removesuffix(END))))
    return turns


def digests(conversations: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as digests: the round trip's check.

    conv_id has the type and value of tree_id, null too. A conversation without turns can't be (a path has a node); one
    without trained turns has loss_chars 0 and the digest of the empty text.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(b["tree_id"], b["formatted"], b["loss_spans"]):
                turns = read_back(text)
                loss = "".join(unescape(text[x["start"] : x["end"]]) for x in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = conversations.schema["tree_id"].dataType.simpleString()
    out = conversations.select(F.col("tree_id").cast("string").alias("tree_id"), "formatted", "loss_spans").mapInPandas(digest, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
