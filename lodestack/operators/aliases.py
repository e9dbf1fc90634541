"""Aliases of entities: short names that begin or end a longer one of the same type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A name gains a word a step, so no chain is longer than the words of a name.
MOST_STEPS = 32


def alias_map(entities: DataFrame) -> DataFrame:
    """(type, alias, canonical): the longest name of the same type that begins or ends with the alias as whole words; of equals the first by name.

    entities: (type, name), repeats allowed; null names and types are left out. Long names ask for their own beginnings and ends, so names are never compared in pairs.
    """
    names = entities.select("type", "name").where("type is not null and name is not null").distinct()
    words, n = F.split("name", " "), F.size(F.split("name", " "))
    cuts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.array_distinct(F.flatten(F.transform(cuts, lambda i: F.array(F.array_join(F.slice(words, 1, i), " "), F.array_join(F.slice(words, i + 1, n), " ")))))
    asked = names.select("type", F.col("name").alias("canonical"), F.explode(parts).alias("name"))
    best = F.min_by("canonical", F.struct(-F.octet_length("canonical"), F.col("canonical")))
    longest = asked.groupBy("type", "name").agg(best.alias("canonical"))  # combined before the shuffle
    return names.join(longest, ["type", "name"]).select("type", F.col("name").alias("alias"), "canonical")


def resolved(aliases: DataFrame, most_steps: int = MOST_STEPS) -> DataFrame:
    """(type, alias, canonical) with chains followed to their ends, one join a step; a canonical name is longer than its alias, so there are no cycles."""
    step = aliases.select("type", F.col("alias").alias("canonical"), F.col("canonical").alias("lodestack_next"))
    found = aliases
    for _ in range(most_steps):
        if found.join(step, ["type", "canonical"], "left_semi").isEmpty():
            break
        found = found.join(step, ["type", "canonical"], "left").select("type", "alias", F.coalesce("lodestack_next", "canonical").alias("canonical"))
    return found


def listed(aliases: DataFrame) -> DataFrame:
    """(type, canonical, aliases): every canonical name's aliases, sorted."""
    return aliases.groupBy("type", "canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def merged(extractions: DataFrame) -> DataFrame:
    """One row for each (kind, text without case, start) with the greatest importance; of equals the text that sorts first."""
    key = [F.col("kind"), F.lower("text").alias("lodestack_text"), F.col("start")]
    kept = extractions.groupBy(*key).agg(F.min("text").alias("text"), F.max("importance").alias("importance"))
    return kept.select("kind", "text", "start", "importance")


def capped(items: DataFrame, key: str, order: str, text: str, most: int = 8, most_bytes: int = 2000) -> DataFrame:
    """The newest items of a list: so many and so many bytes at most, the oldest go first."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    few = items.withColumn("lodestack_rank", F.row_number().over(newest)).where(F.col("lodestack_rank") <= most)
    size = F.sum(F.octet_length(text)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("lodestack_bytes", size).where(F.col("lodestack_bytes") <= most_bytes).drop("lodestack_rank", "lodestack_bytes")
