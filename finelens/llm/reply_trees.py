"""Reply trees formatted as conversations (native).

Messages point to their parent.  Root-to-leaf paths are enumerated by
iterative self-joins that double their reach: after round k a leaf knows its
2**k nearest ancestors, and every message its ancestor 2**k steps up, so a
thread of n turns takes log2(n) rounds.  Branches are ranked by the sum of
their messages' scores (ties: smallest leaf) and each chosen path becomes one
conversation.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn.
Inside roles and texts a backslash goes behind the first character of every
control string (one more where some stand there already), so no text can open
or close a turn, and removing one backslash there gives the text back.  The
loss mask covers the assistant texts.

Defined results
---------------
* null text and null role are empty; a null score counts as 0;
* a message whose parent is missing from its tree is a root; messages that
  only hang on a cycle have no root and are on no path;
* ``threads``: rows by turn, ties by role and text, repeated rows stay turns of
  their own; rows without conv_id form one conversation without id;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finelens.llm.common import let, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Fixed control strings: their first character and what follows it.
_FIRST = r"([<\[])"
_REST = r"(/?s>|/?INST\]|</?SYS>>|\|(?:im_start|im_end|endoftext)\|>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"(\\*)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(\\*)" + _REST, "$1$2$3")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    # a doubled backslash is one, a single one before n is a line end
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist) of all root-to-leaf paths of (tree, node, parent); dist counts from the leaf."""
    nodes = stored(messages.select("tree", "node", "parent"), "tree-nodes")
    up = nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("above"))
    known = nodes.select("tree", F.col("node").alias("above"))
    up = stored(up.join(known, ["tree", "above"], "left_semi").select("tree", "node", "above"), "tree-up")
    leaves = nodes.select("tree", "node").join(up.select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    reached = stored(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")), "tree-paths")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    roots = nodes.select("tree", "node").join(up.select("tree", "node"), ["tree", "node"], "left_anti")
    step = 1
    while step < largest and not up.isEmpty():
        farther = reached.join(up, ["tree", "node"]).select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("dist") + step).alias("dist")
        )
        reached = stored(reached.unionByName(farther), "tree-paths")
        twice = up.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        up = stored(up.join(twice, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")), "tree-up")
        step *= 2
    rooted = reached.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return reached.join(rooted, ["tree", "leaf"], "left_semi")


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best branches of every tree: (tree, leaf, rank, branch_score, turns).

    ``messages``: tree, node, parent, role, text, score.  ``turns`` is the array of
    (role, text) from root to leaf.
    """
    body = messages.select("tree", "node", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")],
                           F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    steps = stored(paths(messages), "tree-steps")
    scores = steps.join(body.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.sum("score").alias("branch_score")
    )
    order = Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "leaf")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    turns = (
        steps.join(best, ["tree", "leaf"])
        .join(body.drop("score"), ["tree", "node"])
        .groupBy("tree", "leaf", "rank", "branch_score")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "role", "text"))).alias("turns"))
    )
    return turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start, length in characters) to rows with ``turns``."""

    def add(a: Column, t: Column) -> Column:
        def joined(head: Column) -> Column:
            def rest(text: Column) -> Column:
                start = a["at"] + F.length(head)
                span = F.array(F.struct(start.alias("start"), F.length(text).alias("length")))
                return F.struct(
                    F.concat(a["out"], F.array(F.concat(head, text, F.lit(CLOSE + "\n")))).alias("out"),
                    F.when(t["role"] == "assistant", F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"),
                    (start + F.length(text) + len(CLOSE) + 1).alias("at"),
                )

            return let(escaped(t["text"]), rest)

        return let(F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit("\n")), joined)

    empty = F.struct(
        F.array().cast("array<string>").alias("out"),
        F.array().cast("array<struct<start:int,length:int>>").alias("spans"),
        F.lit(0).alias("at"),
    )
    rows = conversations.withColumn("__f", F.aggregate("turns", empty, add))
    return rows.withColumn("formatted", F.array_join("__f.out", "")).withColumn("loss_spans", F.col("__f.spans")).drop("__f")


def parsed(text: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        return let(
            body,
            lambda b: F.struct(
                unescaped_role(F.substring_index(b, "\n", 1)).alias("role"),
                unescaped(F.substr(b, F.instr(b, "\n") + 1)).alias("text"),
            ),
        )

    pieces = F.split(text, r"<\|im_end\|>\n")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(text: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, s["start"] + 1, s["length"]))), "")


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn replies to the one before."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Formats all conversations, stores them, and digests what is read back."""
    shown = stored(formatted(chosen_paths(threads(conversations))).select("tree", "formatted", "loss_spans"), "formatted")
    back = shown.withColumn("turns", parsed(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.expr("try_cast(nullif(tree, '') as bigint)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
