"""Entity graph: co-occurrence, edges and bounded breadth-first search, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.sources.staging import staged


def edges(occurrences: DataFrame, tasks: int | None = None) -> DataFrame:
    """(a, b, weight, updated_ms) with a < b; weight counts distinct nodes that hold both. tasks: how many share the pairs, so that none has more than it can hold; Spark's own number if not given."""
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    o = dealt(occurrences, "node").groupBy("entity", "node").agg(F.max("ts_ms").alias("ts_ms"))
    other = o.select(F.col("entity").alias("b"), "node", F.col("ts_ms").alias("ts_b"))
    pairs = o.withColumnRenamed("entity", "a").join(other, "node").where("a < b")
    return dealt(pairs.select("a", "b", F.greatest("ts_ms", "ts_b").alias("ts_ms")), "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"), F.max("ts_ms").alias("updated_ms"))


def both_ways(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select(F.col("a").alias("entity"), F.col("b").alias("neighbor"), "weight").unionAll(edge_rows.select(F.col("b").alias("entity"), F.col("a").alias("neighbor"), "weight"))


def co_occurring(occurrences: DataFrame, entity: str, limit: int) -> DataFrame:
    """Entities that share most nodes with the given one."""
    nodes = occurrences.where(F.col("entity") == entity).select("node").distinct()
    return occurrences.where(F.col("entity") != entity).join(nodes, "node").groupBy("entity").agg(F.countDistinct("node").alias("weight")).orderBy(F.desc("weight"), "entity").limit(limit)


def bfs_pairs(edge_rows: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """(a, b, distance) of target pairs at most hops apart; nodes between may be any. Walks from both ends meet halfway. edge_rows: (a, b) and more."""
    ends = edge_rows.select("a", "b")
    links = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("at"), F.col("b").alias("next")).distinct()
    return _pairs_within(targets, hops, lambda front: front.join(links, "at").select("start", F.col("next").alias("at")))


def shared_node_pairs(occurrences: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """The same where entities are linked by nodes that hold both: each hop goes through the nodes, so no node's pairs are listed."""
    held = occurrences.select("entity", "node").distinct()

    def step(front: DataFrame) -> DataFrame:
        nodes = front.join(held.withColumnRenamed("entity", "at"), "at").select("start", "node").distinct()
        return nodes.join(held, "node").select("start", F.col("entity").alias("at"))

    return _pairs_within(targets, hops, step)


def _pairs_within(targets: DataFrame, hops: int, step) -> DataFrame:
    """Each target walks half the way, one join a hop, only new nodes go on; two targets are as far apart as their nearest common node says. Targets walk as numbers: pairs are many, names long."""
    hops = min(hops, 4)
    named = staged(targets.select("entity").where("entity is not null").distinct().withColumn("start", F.monotonically_increasing_id()), "targets")
    front = named.select("start", F.col("entity").alias("at"))
    seen = front.withColumn("distance", F.lit(0))
    for hop in range(1, (hops + 1) // 2 + 1):
        front = staged(step(front).distinct().join(seen, ["start", "at"], "left_anti"), "front")
        seen = seen.unionByName(front.withColumn("distance", F.lit(hop)))
    other = seen.select("at", F.col("start").alias("end"), F.col("distance").alias("rest"))
    met = seen.join(other, "at").where((F.col("start") < F.col("end")) & (F.col("distance") + F.col("rest") <= hops))
    near = met.groupBy("start", "end").agg(F.min(F.col("distance") + F.col("rest")).alias("distance"))
    name = lambda n, to: named.select(F.col("start").alias(n), F.col("entity").alias(to))
    pairs = near.join(name("start", "x"), "start").join(name("end", "y"), "end")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def candidates(occurrences: DataFrame, asked: DataFrame, newest: int = 500) -> DataFrame:
    """(node, matched, latest_ms): nodes under two asked entities at least, each entity's newest occurrences only."""
    from pyspark.sql import Window

    own = occurrences.join(asked, "entity", "left_semi")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts_ms"), "node"))
    return own.withColumn("rank", rank).where(F.col("rank") <= newest).groupBy("node").agg(F.countDistinct("entity").alias("matched"), F.max("ts_ms").alias("latest_ms")).where("matched >= 2")
