"""Connected components by alternating large-star and small-star steps, as joins and minima of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import discard, staged

SALTS = 64  # tasks that share the neighbours of a hub


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first())


def _with_least(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """pairs with the least value of each key as m. A hub's rows are dealt by the value: SALTS minima go back to them, and no task gets them all."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    some = salted.groupBy(key, "salt").agg(F.min(value).alias("some"))
    least = some.groupBy(key).agg(F.min("some").alias("m"))
    return salted.join(some.join(least, key).select(key, "salt", "m"), [key, "salt"]).drop("salt")


def _each_of(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(hi, lo), for every row its columns of each pair; rows are read once."""
    made = [F.struct(F.col(hi).alias("hi"), F.col(lo).alias("lo")) for hi, lo in pairs]
    return rows.select(F.explode(F.array(*made)).alias("pair")).select("pair.hi", "pair.lo")


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another one; component is the smallest node reachable.

    Nulls and loops are no edges; repeated edges count once; no edges give an empty table. A node's neighbours are
    never gathered: each step takes minima, combined before the shuffle, and joins them back, a hub's in SALTS portions.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = staged(edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"), (x != y).alias("ok")).where("ok").select("hi", "lo").distinct(), "edges")
    was = _state(now)
    for _ in range(most_rounds if was[0] else 0):
        both = _each_of(now, ("hi", "lo"), ("lo", "hi")).select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        # written, for each step names its input three times: a plan of both would hold every row's way here eighteen times
        large = staged(_with_least(both, "u", "v").where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")), "edges")
        low = _with_least(large, "hi", "lo")
        old, now = now, staged(_each_of(low, ("lo", "m"), ("hi", "m")).where("hi != lo").distinct(), "edges")
        discard(old)
        discard(large)
        state = _state(now)
        if state == was:
            break
        was = state
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
