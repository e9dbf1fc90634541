"""Chat formatting of reply trees.

Iterative self-joins enumerate all root-to-leaf paths: each round doubles how far a node sees up, so a tree takes as
many rounds as its depth has bits. Branches are ranked by score, and each chosen path becomes one conversation, with
turn marks, reversible escapes and the spans that count for the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import staged

#: Marks of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Beginnings of control strings, of this and of other templates; what follows the first character is looked ahead at.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
MOST_ROUNDS = 40


def escape(text: Column) -> Column:
    r"""Backslashes are doubled, and one follows the first character of a control string, which is then none."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_trees(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as trees: (tree, node, parent, role, text, score); rows by turn, of equal turns by role and text. Null roles and texts are empty."""
    rows = turns.select(F.col(id_col).cast("long").alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    return rows.select("tree", node.alias("node"), "role", "text", F.lit(0.0).alias("score")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).select("tree", "node", "parent", "role", "text", "score")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for each node on the way from a leaf up to its root; up counts steps from the leaf.

    A node whose parent is null or missing is a root. A path that runs into a cycle has no root and is left out.
    """
    links = nodes.select(F.col("tree"), "node", "parent").distinct()
    known = links.select(F.col("tree"), F.col("node").alias("parent")).distinct()
    jump = staged(links.where("parent is not null").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("over")), "jumps")
    leaves = links.join(jump.select("tree", F.col("over").alias("node")).distinct(), ["tree", "node"], "left_anti")
    reach = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    first, far = jump, 1
    for _ in range(MOST_ROUNDS):
        further = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("over").alias("node"), (F.col("up") + far).alias("up"))
        reach = staged(reach.unionAll(further), "paths")
        jump = staged(jump.join(jump.select("tree", F.col("node").alias("over"), F.col("over").alias("next")), ["tree", "over"]).select("tree", "node", F.col("next").alias("over")), "jumps")
        far *= 2
        if jump.isEmpty():
            break
    rooted = reach.join(first.select("tree", "node").distinct(), ["tree", "node"], "left_anti").select("tree", "leaf").distinct()
    return reach.join(rooted, ["tree", "leaf"])


def format_trees(nodes: DataFrame, branches: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, branch, branch_score, formatted, spans): the best `branches` paths of each tree, all if None.

    A branch scores the mean of its nodes' scores (null: 0); of equals the smaller leaf is first. spans are (start, end),
    in code points of formatted, of each loss_role text as escaped. Nodes with one tree and id must not repeat. An empty table gives
    an empty result; a tree without a root gives none.
    """
    rows = nodes.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    on_path = paths(rows).join(rows.select("tree", "node", "role", "text", "score"), ["tree", "node"])
    ranked = on_path.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    ranked = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    pieces = F.transform("turns", lambda t: F.struct((t["role"] == loss_role).alias("counts"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body")))
    cut = ranked.withColumn("pieces", pieces)
    size = lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long")
    starts = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all")),
        lambda s, p: F.struct((s["at"] + size(p)).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(p["head"]))).alias("all")),
    )["all"]
    spans = F.transform(F.filter(F.arrays_zip(F.col("pieces"), F.col("starts")), lambda x: x["pieces"]["counts"]), lambda x: F.struct(x["starts"].alias("start"), (x["starts"] + F.length(x["pieces"]["body"])).alias("end")))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return cut.withColumn("starts", starts).select("tree", "leaf", "branch", "branch_score", text.alias("formatted"), spans.alias("spans"))


def parse(formatted: Column) -> tuple[Column, Column]:
    """(roles, texts), unescaped, of a formatted conversation."""
    marks = F.lit(r"(?s)<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>")
    return tuple(F.transform(F.regexp_extract_all(formatted, marks, F.lit(k)), unescape) for k in (1, 2))


def chat_digests(turns: DataFrame, extra: list[tuple[int, int, str, str]] | None = None) -> DataFrame:
    """Formats conversations, writes them to the shared folder, reads them back, and digests what was read.

    turns: (conv_id, turn, role, text); extra rows are added. A null conv_id is a conversation of its own.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    if extra:
        rows = rows.unionAll(rows.sparkSession.createDataFrame(extra, rows.schema))
    none = -(2**63)  # stands for a null id, which joins nothing
    made = format_trees(linear_trees(rows.withColumn("conv_id", F.coalesce("conv_id", F.lit(none)))))
    read = staged(made.select(F.nullif("tree", F.lit(none)).alias("conv_id"), "formatted", "spans"), "chats")
    roles, texts = parse(F.col("formatted"))
    read = read.select("*", roles.alias("roles"), texts.alias("texts"))
    whole = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return read.withColumn("loss", loss).select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
