"""Chat formatting over reply trees (native DataFrame operations).

Rows are nodes of reply trees. Self-joins with doubling strides enumerate each
root-to-leaf path, branches are ranked by score, and each chosen path becomes one
conversation: formatted text, the spans under the loss mask and the number of turns.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. Control strings inside
roles and texts are broken up by a backslash after their first character, and a
backslash is doubled, so no control string can come from a text and every text can be
read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.common import Scratch

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

# Starts of control strings that texts may not hold, as public chat templates have them.
CONTROL = r"(<)(?=\||/?s>)|(\[)(?=/?INST\])|(\\)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1$2$3\\")


def unescape(c: Column) -> Column:
    """Undo :func:`escape`: of two backslashes one stays, a single one goes."""
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def linear_nodes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Nodes of a table without reply links: each row answers the row before it by turn.

    Rows with the same turn follow each other by role and text, so ties and repeated
    rows stay, in an order that reruns repeat; null turns come first. Null roles and
    texts are empty.
    """
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return (df.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"),
                      F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .withColumn("node", F.row_number().over(w).cast("long"))
            .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                    F.lit(0.0).alias("score")))


def paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(tree, leaf, node, up)`` for every node on every root-to-leaf path; ``up`` counts
    the steps from the leaf. ``nodes``: tree, node, parent (null at roots).

    Each round joins the members found so far with the ancestors 2^k steps up, and
    these with themselves: rounds grow with the logarithm of the depth. Trees may
    have a null name. A parent that is missing from its tree makes its child a root.
    """
    ids = nodes.select("tree", "node", "parent")
    real = ids.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    jump = scratch.save(ids.join(real, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")))
                        .select("tree", "node", F.col("parent").alias("to")), "jump0")
    leaf = ids.join(ids.select(F.col("tree").alias("t"), F.col("parent").alias("n")),
                    F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    members = scratch.save(leaf.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")),
                           "members0")
    k = 0
    while jump.head(1):
        j = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        on = F.col("tree").eqNullSafe(F.col("t"))
        more = members.join(j, on & (F.col("node") == F.col("n"))).select(
            "tree", "leaf", F.col("to").alias("node"), (F.col("up") + 2 ** k).alias("up"))
        members = scratch.save(members.unionByName(more), f"members{k + 1}")
        nxt = scratch.save(jump.withColumnRenamed("to", "mid").join(j, on & (F.col("mid") == F.col("n")))
                           .select("tree", "node", "to"), f"jump{k + 1}")
        scratch.drop(f"members{k}", f"jump{k}")
        jump, k = nxt, k + 1
    return members


def format_trees(nodes: DataFrame, scratch: Scratch, best: int = 1, learn: str = "assistant") -> DataFrame:
    """``(tree, leaf, rank, n_turns, formatted, loss)`` for the ``best`` branches of each tree.

    ``nodes``: tree, node, parent, role, text, score. A branch's score is the mean of
    its nodes' scores (null: 0); ties go to the smaller leaf. ``loss`` lists the
    (start, length) of each text by ``learn``, in code points of ``formatted``. Null roles and
    texts are empty in :func:`linear_nodes`; texts of any length stay whole; a table without
    nodes gives no rows.
    """
    nodes = scratch.save(nodes, "nodes")
    on = paths(nodes, scratch).alias("p").join(
        nodes.alias("x"), F.expr("p.tree <=> x.tree AND p.node = x.node"))
    on = on.select("p.tree", "p.leaf", "p.up", "x.role", "x.text", F.coalesce("x.score", F.lit(0.0)).alias("score"))
    ranked = on.groupBy("tree", "leaf").agg(F.avg("score").alias("score")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    chosen = ranked.where(F.col("rank") <= best).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "rank")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    turns = (on.join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")))
             .withColumn("head", head).withColumn("body", escape(F.col("text"))))
    turns = turns.withColumn("chars", F.char_length("head") + F.char_length("body") + len(END))
    w = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    start = F.coalesce(F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", start)
    mask = F.when(F.col("role") == learn, F.struct(
        (F.col("start") + F.char_length("head")).cast("long").alias("start"),
        F.char_length("body").cast("long").alias("length")))
    out = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start"), F.concat("head", "body", F.lit(END)).alias("text"), mask.alias("mask")))).alias("turns"))
    return out.select("tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
                      F.array_join(F.col("turns.text"), "").alias("formatted"),
                      F.filter("turns.mask", lambda m: m.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    pieces = F.split(formatted, r"<\|end\|>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, F.lit(len(TURN) + 1), F.char_length(p)), TEXT, 1)).alias("role"),
        unescape(F.substring_index(p, TEXT, -1)).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back of each formatted conversation, as digests."""
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = unescape(F.array_join(F.transform("loss", lambda s: F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))
    return formatted.select(
        F.col("tree").alias("conv_id"), "n_turns", F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
