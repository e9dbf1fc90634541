"""Graph-aware retrieval: nodes that several asked entities share, and what stands in where there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import score as S
from lodestack.operators import graph
from lodestack.sources.staging import staged

#: Limits of an answer, and steps between entities.
DEFAULT_LIMIT, MOST_LIMIT = 10, 100
DEFAULT_HOPS, MOST_HOPS = 2, 4
HITS = "node string, scope string, score double, rank int, total long, branch string"


def pair_candidates(occurrences: DataFrame, pairs: DataFrame, newest: int | None = None) -> DataFrame:
    """(node, a, b, distance, ts_ms) of all nodes that hold both entities of a pair.

    occurrences: (entity, node, ts_ms); pairs: (a, b, distance), a few. A host that would rather not look at all may give `newest`: how many of each entity's newest occurrences count.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("entity")).distinct()
    own = occurrences.join(F.broadcast(named), "entity").groupBy("entity", "node").agg(F.max("ts_ms").alias("ts_ms"))
    if newest is not None:
        rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts_ms"), "node"))
        own = own.withColumn("rank", rank).where(F.col("rank") <= newest).drop("rank")
    left = own.select(F.col("entity").alias("a"), "node", F.col("ts_ms").alias("left_ms")).join(F.broadcast(pairs), "a")
    right = own.select(F.col("entity").alias("b"), "node", F.col("ts_ms").alias("right_ms"))
    return left.join(right, ["b", "node"]).select("node", "a", "b", "distance", F.greatest("left_ms", "right_ms").alias("ts_ms"))


def fitting_hops(counts: dict[int, int], limit: int, hops: int) -> int:
    """The bound to use: fewer steps while there are more than limit candidates and the next bound has any. counts: candidates by their least distance."""
    within = lambda h: sum(n for d, n in counts.items() if d <= h)
    while within(hops) > limit and hops > 1 and within(hops - 1):
        hops -= 1
    return hops


def _answer(hits: DataFrame, order: list[Column], limit: int, branch: str) -> DataFrame:
    """The first hits with their rank and the number of all; what is ranked are limit rows at most."""
    total = hits.agg(F.count("*").alias("total"))
    best = hits.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(total)).withColumn("branch", F.lit(branch))


def dense_hits(nodes: DataFrame, question: list[float], scopes: list[str] | None = None, window: tuple[int, int] | None = None) -> tuple[DataFrame, list[Column]]:
    """Live summaries that overlap the window, and their order: those with a vector of the question's length by cosine and end, then the others by scope and id."""
    live = nodes.where((F.col("kind") == "summary") & ~F.col("deleted"))
    if window:
        live = live.where((F.col("end_ms") >= window[0]) & (F.col("start_ms") <= window[1]))
    if scopes is not None:
        live = live.where(F.col("scope").isin(scopes))
    score = F.when(F.size("embedding") == len(question), F.round(S.cosine(F.col("embedding"), F.array(*map(F.lit, question))), 9))
    hits = live.select(F.col("id").alias("node"), "scope", "entities", "end_ms", score.alias("score"))
    return hits, [F.desc_nulls_last("score"), F.when(F.col("score").isNotNull(), F.col("end_ms")).desc(), F.asc("scope"), F.asc("node")]


def fast_retrieve(
    query: str, asked: list[str], question: list[float], occurrences: DataFrame, nodes: DataFrame, edges: DataFrame | None = None,
    scopes: list[str] | None = None, limit: int = DEFAULT_LIMIT, max_hops: int = DEFAULT_HOPS, window: tuple[int, int] | None = None, instead: bool = True,
) -> DataFrame:
    """(node, scope, score, rank, total, branch) of the hits; total counts them before the limit.

    nodes: (id, kind, scope, entities, start_ms, end_ms, embedding, deleted), kind leaf or summary; edges: (a, b) where
    entities are linked otherwise than by the nodes that they share.
    A blank query gives nothing. Branches: `local`, where asked entities at most max_hops apart share nodes: by shared
    entities, newest, id; the bound on steps is lowered while more than limit nodes are found and some are left. `occurrence`, where
    there are no such pairs or nodes: twice as many dense hits, those first that hold more asked entities. `dense`, where no
    entity is asked. Scopes are applied before limits, unknown nodes are no hits. A limit or bound of 0 is the default.
    instead=False asks for shared nodes only: without any, there are no hits.
    """
    spark = nodes.sparkSession
    limit = min(limit or DEFAULT_LIMIT, MOST_LIMIT)
    max_hops = min(max_hops or DEFAULT_HOPS, MOST_HOPS)
    columns = ["node", "scope", "score", "rank", "total", "branch"]
    if not query.strip():
        return spark.createDataFrame([], HITS)
    asked = sorted(set(asked))
    if asked:
        targets = spark.createDataFrame([(x,) for x in asked], "entity string")
        pairs = staged(graph.shared_node_pairs(occurrences, targets, max_hops) if edges is None else graph.bfs_pairs(edges, targets, max_hops), "pairs")
        found = staged(pair_candidates(occurrences, pairs), "candidates")
        least = found.groupBy("node").agg(F.min("distance").alias("least"))
        counts = {r.least: r.n for r in least.groupBy("least").agg(F.count("*").alias("n")).collect()}  # a row for each distance
        if counts:
            near = found.where(F.col("distance") <= fitting_hops(counts, limit, max_hops))
            matched = F.size(F.array_union(F.collect_set("a"), F.collect_set("b")))
            local = near.groupBy("node").agg(matched.cast("double").alias("score"), F.max("ts_ms").alias("latest_ms"))
            known = nodes.select(F.col("id").alias("node"), "scope") if scopes is None else nodes.where(F.col("scope").isin(scopes)).select(F.col("id").alias("node"), "scope")
            return _answer(local.join(known, "node"), [F.desc("score"), F.desc("latest_ms"), F.asc("node")], limit, "local").select(columns)
        if not instead:
            return spark.createDataFrame([], HITS)
    hits, order = dense_hits(nodes, question, scopes, window)
    if not asked:
        return _answer(hits, order, limit, "dense").select(columns)
    most = _answer(hits, order, 2 * limit, "occurrence")
    held = F.size(F.array_intersect("entities", F.array(*map(F.lit, asked))))
    again = [F.desc(held), F.asc("rank")]
    return most.withColumn("again", F.row_number().over(Window.orderBy(*again))).where(F.col("again") <= limit).drop("rank").withColumnRenamed("again", "rank").select(columns)

