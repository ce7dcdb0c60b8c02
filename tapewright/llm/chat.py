"""Reply trees to conversations.

Messages point to the message they answer. Self-joins double the length of the known ancestor chain of
every message each time, so the depth of a tree costs its logarithm in joins. A leaf ends a branch; branches are
ranked by the mean score of their messages, and the chosen paths are formatted with a loss mask.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` per message. Inside roles and texts ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|``, so no text can open or close a turn and every text can be read back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.session import settle

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def linear_tree(messages: DataFrame) -> DataFrame:
    """Messages of plain conversations as trees of one branch: each answers the one before it by turn.

    Columns conv_id, node (1, 2, …), parent, score, role, text. Repeated turns are messages of their own,
    ordered by turn (null first), role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return messages.select(
        "conv_id", F.row_number().over(order).cast("long").alias("node"), F.lit(1.0).alias("score"), "role", "text",
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def best_paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """``(conv_id, branch, depth, node)`` of the best root-to-leaf paths of every tree, depth from 1.

    ``tree``: conv_id, node (unique in its tree), parent (null for a root) and score (null counts 0). A null conv_id is one tree.
    Branches are ranked by the mean score of their messages, ties by leaf id. A message whose parent is
    missing or lies on a cycle hangs on no root and is on no path.
    """
    edges = settle(tree.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "tree")
    hop = edges.select("conv_id", "node", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("steps"),
                       F.col("score").alias("total"))
    size = edges.count()
    levels = []
    for level in range(max(1, size.bit_length()) + 1):
        hop = settle(hop, "hop")
        levels.append(hop)
        if hop.where(F.col("anc").isNotNull()).isEmpty():
            break
        above = hop.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("anc").alias("up"),
                           F.col("steps").alias("more"), F.col("total").alias("plus"))
        complete = hop.where(F.col("anc").isNull())
        hop = hop.where(F.col("anc").isNotNull()).join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("anc") == F.col("n")), "left").select(
            "conv_id", "node", F.when(F.col("n").isNull(), F.when(F.col("anc").isNotNull(), F.col("anc"))).otherwise(F.col("up")).alias("anc"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            (F.col("total") + F.coalesce("plus", F.lit(0.0))).alias("total")).unionByName(complete)
    inner = edges.where(F.col("parent").isNotNull()).select(
        F.col("conv_id").alias("c"), F.col("parent").alias("n")).distinct()
    leaves = hop.where(F.col("anc").isNull()).join(
        inner, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")
    rank = Window.partitionBy("conv_id").orderBy((F.col("total") / F.col("steps")).desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    path = settle(chosen.select("conv_id", "branch", "node", F.col("steps").alias("depth")), "path")
    for level in reversed(range(len(levels) - 1)):
        up = levels[level].where(F.col("anc").isNotNull()).select(
            F.col("conv_id").alias("c"), F.col("node").alias("n"), "anc", "steps")
        lifted = path.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select(
            "conv_id", "branch", F.col("anc").alias("node"), (F.col("depth") - F.col("steps")).alias("depth"))
        path = settle(path.unionByName(lifted), "path")
    return path.select("conv_id", "branch", "depth", "node")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def format_paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """``(conv_id, branch, formatted, loss)``: one conversation per chosen path.

    ``loss`` lists (start, length) in code points of the assistant texts inside ``formatted``, escaped as
    they stand there. Null texts and roles count as empty; a line break in a role is escaped as ``&#10;``.
    One conversation is one row, so its turns must fit a row.
    """
    path = best_paths(tree, branches).select(
        F.col("conv_id").alias("c"), "branch", "depth", F.col("node").alias("n"))
    rows = tree.join(path, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select(
        "conv_id", "branch", "depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit(MIDDLE))
    turns = rows.select(
        "conv_id", "branch", "depth", head.alias("head"), escaped(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("learn"))
    whole = turns.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body", "learn"))).alias("t"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["head"])
        size = F.length(turn["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + len(CLOSE)).alias("at"),
                        F.when(turn["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return whole.select(
        "conv_id", "branch",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("t", zero, step, lambda s: s["spans"]).alias("loss"))


def unescaped(text: str) -> str:
    return text.replace("&lt;|", "<|").replace("&amp;", "&")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, body = part.split(MIDDLE, 1)
        turns.append((unescaped(role.replace("&#10;", "\n")), unescaped(body[:-len(CLOSE)])))
    return turns


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, branch int")


def digests(conversations: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations sees: turns and the text under the mask."""
    import hashlib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, branch, text, loss in zip(frame.conv_id, frame.branch, frame.formatted, frame.loss, strict=True):
                turns = read_back(text)
                learned = "".join(unescaped(text[s["start"]:s["start"] + s["length"]]) for s in loss)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned),
                            hashlib.sha256(learned.encode()).hexdigest(), len(text), branch))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})

    return conversations.mapInPandas(run, DIGESTS)
