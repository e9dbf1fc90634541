"""Batches that start anew: rows of a key in order, cut where the next one no longer fits or where a gate is reached.

Where a batch ends depends on where it began, so a running sum alone can't tell. Here every row gets the row that would
begin the next batch, were it the first of one: prefix sums turn that into a rank among sorted values. Which rows are
firsts is the path from row 0 along these steps. In blocks of rows the steps are followed inside a task; what is left are
the steps from block to block, and pointer doubling finds those on the path in as many rounds as their number has bits.
All of it is shared by tasks inside one key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.sources.staging import staged

BLOCK = 4_096


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with pos, from 0 by order in their key, and total; ranges of the order are counted, and the counts before each are summed."""
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    marked = staged(ranged.withColumn("lodestack_at", F.monotonically_increasing_id()), "placed").withColumn("lodestack_range", F.shiftrightunsigned("lodestack_at", 33))
    counts = marked.groupBy(key, "lodestack_range").agg(F.min("lodestack_at").alias("first"), F.count("*").alias("n"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("n").over(of_key.orderBy("lodestack_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    figures = counts.select(key, "lodestack_range", (before - F.col("first")).alias("lodestack_shift"), F.sum("n").over(of_key).alias("total"))
    return marked.join(figures, [key, "lodestack_range"]).withColumn("pos", F.col("lodestack_at") + F.col("lodestack_shift")).drop("lodestack_at", "lodestack_range", "lodestack_shift")


def prefix_sums(rows: DataFrame, key: str, size: Column) -> DataFrame:
    """placed rows with before and after, the sums of sizes without and with the row: inside blocks of positions, then over the blocks' sums."""
    dealt = rows.withColumn("lodestack_block", F.expr(f"pos div {BLOCK}")).withColumn("lodestack_size", size)
    whole = dealt.groupBy(key, "lodestack_block").agg(F.sum("lodestack_size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(key).orderBy("lodestack_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = whole.select(key, "lodestack_block", F.coalesce(before, F.lit(0)).alias("lodestack_offset"))
    inside = F.sum("lodestack_size").over(Window.partitionBy(key, "lodestack_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn("after", inside).join(offsets, [key, "lodestack_block"]).withColumn("after", F.col("after") + F.col("lodestack_offset"))
    return summed.withColumn("before", F.col("after") - F.col("lodestack_size")).drop("lodestack_block", "lodestack_offset", "lodestack_size")


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each row of a block the first row outside it on its path."""
    pdf = pdf.sort_values("pos")
    first, to = int(pdf["pos"].iloc[0]), pdf["to"].to_numpy(np.int64)
    at = to.copy()
    while (inside := at < first + len(to)).any():
        at[inside] = to[at[inside] - first]
        to = at.copy()
    return pd.DataFrame({"k": pdf["k"], "pos": pdf["pos"], "to": at})


def _firsts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of a block that begin a batch: the path from the row that the block is entered at."""
    pdf = pdf.sort_values("pos")
    first, to, at = int(pdf["pos"].iloc[0]), pdf["to"].to_numpy(np.int64), pdf["entry"].iloc[0]
    begins = np.zeros(len(to), np.int64)
    while pd.notna(at) and at < first + len(to):
        begins[int(at) - first] = 1
        at = to[int(at) - first]
    return pd.DataFrame({"k": pdf["k"], "pos": pdf["pos"], "local": begins.cumsum()})


def _entries(exits: DataFrame) -> DataFrame:
    """(k, entry) of the rows at which the path from row 0 enters blocks; only rows that some block is left for take part."""
    reached = exits.where("to < total").select("k", F.col("to").alias("pos")).distinct()
    jump = staged(exits.join(reached.unionByName(exits.where("pos = 0").select("k", "pos")).distinct(), ["k", "pos"], "left_semi").where("to < total").select("k", "pos", "to"), "jumps")
    found = exits.where("pos = 0").select("k", "pos")
    while not jump.isEmpty():
        found = staged(found.unionByName(found.join(jump, ["k", "pos"]).select("k", F.col("to").alias("pos"))), "entries")
        jump = staged(jump.join(jump.select("k", F.col("pos").alias("to"), F.col("to").alias("next")), ["k", "to"]).select("k", "pos", F.col("next").alias("to")), "jumps")
    return found.select("k", F.col("pos").alias("entry"))


def restarting(rows: DataFrame, key: str, order: list[str], size: str, budget: int, most_items: int | None = None, reach: bool = False) -> DataFrame:
    """rows with pos, batch (from 0) and full.

    reach false: a row that would take its batch over the budget, or over most_items, begins the next one; one that is
    over the budget alone is a batch of its own; full tells that another batch follows. reach true: a batch ends with the row that brings it to the budget;
    full tells that it got there, so only the last one of a key may not. Null and negative sizes count as zero; rows
    without a key are one key; equal rows by order may come in any order. rows should hold no long texts: they are sorted thrice.
    """
    if budget < 1 or most_items is not None and most_items < 1:
        raise ValueError("budget and most_items are 1 or more")
    k = F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0"))
    given = rows.select(k.alias("k"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(order)], F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"), F.struct("*").alias("row"))
    in_order = placed(given, "k", [f"by{i}" for i in range(len(order))]).select("k", "pos", "total", "size", "row")
    sums = staged(prefix_sums(in_order, "k", F.col("size")), "sums")
    # Each row asks how many of its key have a sum of at most (reach: under) before + budget; among all sums and questions in one order that is its place less the questions before it.
    points = sums.select("k", F.col("after").alias("value"), F.lit(int(reach)).alias("kind"), "pos", "total", F.lit(None).cast(sums.schema["row"].dataType).alias("row"))
    asks = sums.select("k", (F.col("before") + budget).alias("value"), F.lit(int(not reach)).alias("kind"), "pos", "total", "row")
    both = points.unionByName(asks).withColumnsRenamed({"pos": "of", "total": "n"})
    rank = F.col("pos") - F.col("of")
    to = rank + 1 if reach else F.greatest(F.least(rank, F.col("of") + most_items) if most_items else rank, F.col("of") + 1)
    answered = placed(both, "k", ["value", "kind", "of"]).where(F.col("kind") == int(not reach))
    steps = staged(answered.select("k", F.col("of").alias("pos"), F.col("n").alias("total"), F.least(to, F.col("n")).alias("to"), (rank < F.col("n") if reach else to < F.col("n")).alias("full"), "row"), "steps")
    steps = steps.withColumn("block", F.expr(f"pos div {BLOCK}"))
    totals = steps.groupBy("k").agg(F.first("total").alias("total"))
    exits = staged(steps.groupBy("k", "block").applyInPandas(lambda pdf: _exits(pdf[["k", "pos", "to"]]), "k string, pos long, to long").join(totals, "k"), "exits")
    entries = _entries(exits).withColumn("block", F.expr(f"entry div {BLOCK}"))
    marked = steps.select("k", "block", "pos", "to").join(entries, ["k", "block"], "left")
    local = staged(marked.groupBy("k", "block").applyInPandas(lambda pdf: _firsts(pdf[["k", "pos", "to", "entry"]]), "k string, pos long, local long"), "firsts").withColumn("block", F.expr(f"pos div {BLOCK}"))
    begun = F.sum("begun").over(Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = local.groupBy("k", "block").agg(F.max("local").alias("begun")).select("k", "block", F.coalesce(begun, F.lit(0)).alias("offset"))
    numbered = local.join(offsets, ["k", "block"]).select("k", "pos", (F.col("offset") + F.col("local") - 1).alias("batch"))
    out = steps.join(numbered, ["k", "pos"])
    # a batch is as full as its first row says; the first row is the one with the lowest pos
    firsts = out.groupBy("k", "batch").agg(F.min_by("full", "pos").alias("batch_full"))
    return out.join(firsts, ["k", "batch"]).select("row.*", "pos", "batch", F.col("batch_full").alias("full"))
