"""Summary trees: walks by joins, covers of a time window, and the cascade that seals full buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.batches import restarting
from lodestack.sources.staging import staged

MOST_LEVELS = 32
TOKEN_GATE, COUNT_GATE = 50_000, 10


def descend(roots: DataFrame, links: DataFrame, most_depth: int = MOST_LEVELS) -> DataFrame:
    """(root, node, depth) of all nodes below the roots, 1 to most_depth steps, by the shortest way; roots: id; links: (parent, child).

    One join a level, as deep as the tree is. Each level is written, so no level is made twice; a node that a root has reached before ends a cycle.
    """
    links = links.select("parent", "child").distinct()
    frontier = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    found = None
    for depth in range(1, most_depth + 1):
        level = frontier.join(links, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node")) if found is None else found.select("root", "node").unionByName(roots.select(F.col("id").alias("root"), F.col("id").alias("node")))
        frontier = staged(level.join(seen, ["root", "node"], "left_anti"), "level")
        if frontier.isEmpty():
            break
        found = frontier if found is None else found.unionByName(frontier)
    return found if found is not None else frontier


def ancestors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(root, node, depth) of all nodes above."""
    return descend(nodes, links.select(F.col("child").alias("parent"), F.col("parent").alias("child")))


def losing_versions(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, leaves), ids: what goes with the versions of documents that are not the latest.

    nodes: (id, doc_id, version_ms); those without a doc_id are no versions. A document's highest version stays (null is
    the lowest, of equal ones the smallest id); every other one goes with all summaries below it, and hides all leaves
    below it, wherever else they hang. links: (parent, child).
    """
    versions = nodes.where("doc_id is not null").select("id", "doc_id", F.coalesce("version_ms", F.lit(-(2**63))).alias("version"))
    best = versions.groupBy("doc_id").agg(F.min(F.struct(F.bitwise_not("version").alias("older"), F.col("id"))).alias("best"))
    losers = staged(versions.join(best, "doc_id").where(F.col("id") != F.col("best.id")).select("id"), "losers")
    below = descend(losers, links).select(F.col("node").alias("id")).distinct()
    known = nodes.select("id").distinct()
    return losers.unionByName(below.join(known, "id", "left_semi")).distinct(), below.join(known, "id", "left_anti")


def window_cover(leaves: DataFrame, nodes: DataFrame, links: DataFrame, since_ms: int, until_ms: int, limit: int = 200) -> DataFrame:
    """(scope, id, kind, start_ms): the fewest nodes for a window: summaries that lie in it and whose parents don't, and the leaves these leave over.

    leaves: (id, scope, timestamp_ms), live; nodes: (id, scope, parent_id, start_ms, end_ms), live, and doc_id and
    version_ms where some are versions of documents: then only the latest of each in the window takes part, and leaves of others don't come back. By scope and start; an inverted window is refused.
    """
    if until_ms < since_ms:
        raise ValueError(f"the window ends at {until_ms}, before {since_ms}")
    fits = nodes.where((F.col("start_ms") >= since_ms) & (F.col("end_ms") <= until_ms))
    rest = leaves.where(F.col("timestamp_ms").between(since_ms, until_ms))
    if "doc_id" in nodes.columns:
        summaries, hidden = losing_versions(fits, links)
        fits, rest = fits.join(summaries, "id", "left_anti"), rest.join(hidden, "id", "left_anti")
    maximal = staged(fits.join(fits.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("scope", "id", "start_ms"), "maximal")
    covered = descend(maximal.select("id"), links).select(F.col("node").alias("id"))
    rest = rest.join(covered, "id", "left_anti")
    out = maximal.select("scope", "id", F.lit("summary").alias("kind"), "start_ms").unionAll(rest.select("scope", "id", F.lit("leaf").alias("kind"), F.col("timestamp_ms").alias("start_ms")))
    return out.orderBy("scope", "start_ms", "id").limit(limit)


def must_seal(level: Column, tokens: Column, items: Column) -> Column:
    """A buffer of level 0 seals by tokens, others by items."""
    return F.when(level == 0, tokens >= TOKEN_GATE).otherwise(items >= COUNT_GATE)


def seal_cascade(leaves: DataFrame, fan_in: int = COUNT_GATE, tokens: int = TOKEN_GATE) -> DataFrame:
    """(tree, level, node, n_items, tokens, start_ms, end_ms) of sealed nodes: level 1 closes with the leaf that brings a buffer to the gate, each next one by fan_in nodes, until one can't.

    leaves: (tree, seq, tokens, at_ms). Every batch begins anew after the one before; what doesn't reach its gate waits in its buffer.
    """
    rows = restarting(leaves.select("tree", "seq", "tokens", "at_ms"), "tree", ["seq"], "tokens", tokens, reach=True).where("full")
    sums = [F.sum("tokens").alias("tokens"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")]
    made = rows.select("tree", F.col("batch").alias("node"), "tokens", F.col("at_ms").alias("start_ms"), F.col("at_ms").alias("end_ms"))
    sealed, depth = staged(made.groupBy("tree", "node").agg(F.count("*").alias("n_items"), *sums), "sealed"), 1
    found = sealed.withColumn("level", F.lit(1))
    while depth < MOST_LEVELS:
        up = sealed.groupBy("tree", F.floor(F.col("node") / fan_in).alias("node")).agg(F.count("*").alias("n_items"), *sums)
        sealed, depth = staged(up.where(F.col("n_items") >= fan_in), "sealed"), depth + 1
        if sealed.isEmpty():
            break
        found = found.unionByName(sealed.withColumn("level", F.lit(depth)))
    return found.select("tree", "level", "node", "n_items", "tokens", "start_ms", "end_ms")
