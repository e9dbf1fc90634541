"""SimHash near-dedup by the generalised pigeonhole principle.

Correlated bits are grouped into partitions; thresholds of the partitions, -1 (not probed) upwards, add up to
max_bits - partitions + 1, so two fingerprints within max_bits are within the threshold of one partition at least.
A dynamic program picks them by estimated candidate counts: those of evenly spread bits in a table of this size, and those
that its own groups of like rows add. Each fingerprint is indexed once a partition and probes every variant
within its threshold; candidates are verified on all bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import staged, text_key
from lodestack.llm.components import components

BITS = 64
SAMPLE_ROWS = 2_048  # for estimates of cost only
BLOCK = 65_536  # shingles that are hashed at once


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash; a bit is set if it is in over half of the shingles' XXH64. No words: 0; null: as empty."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    n = len(found) - words + 1
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = found[at : at + BLOCK + words - 1]
        hashes = np.array([digest(b" ".join(x), seed) for x in zip(*(part[i:] for i in range(words)), strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, key, fp long) of every row; key: MD5 of the text, null as empty."""

    @F.pandas_udf("long")
    def each(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in text], np.int64))

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("key"), each(text).alias("fp"))


def partitions(sample: np.ndarray, m: int) -> list[list[int]]:
    """Bits 0 to 63 in m groups of like size; each group takes the bit most correlated with it, again and again."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    with np.errstate(all="ignore"):
        like = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((BITS, BITS))
    free, groups = list(range(BITS)), []
    for g in range(m):
        want, group = (len(free) + m - g - 1) // (m - g), [free.pop(0)]
        while len(group) < want:
            best = max(free, key=lambda b: (like[b, group].mean(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, rows: int, max_bits: int) -> tuple[list[list[int]], list[int], float]:
    """(bits of each partition, threshold of each, estimated probes and candidates a row); the cheapest of 1 to max_bits + 1 partitions."""
    best: tuple = ([], [], float("inf"))
    x = sample.astype(np.int64).view(np.uint64)
    for m in range(1, max_bits + 2):
        groups = partitions(sample, m)
        costs = []
        for bits in groups:
            mask = np.uint64(sum(1 << b for b in bits))
            seen = np.zeros(max_bits + 1)
            for i in range(0, len(x), 256):
                away = np.bitwise_count((x[i : i + 256, None] ^ x[None]) & mask)
                seen += [(away <= t).sum() for t in range(max_bits + 1)]
            pairs = max(1, len(x) * (len(x) - 1))
            near = [sum(comb(len(bits), j) for j in range(t + 1)) for t in range(max_bits + 1)]
            # for each row: its probes, its candidates if bits were spread evenly, and those of the table's own groups
            costs.append([0.0] + [near[t] + 1 + rows / 2 * near[t] / 2.0 ** len(bits) + rows / 2 * (seen[t] - len(x)) / pairs for t in range(max_bits + 1)])
        total = max_bits + 1  # the sum of threshold + 1 over all partitions
        table = {0: (0.0, [])}
        for cost in costs:
            table = {s: min(((v + cost[t], [*ts, t - 1]) for s0, (v, ts) in table.items() if (t := s - s0) in range(total + 1)), default=(float("inf"), [])) for s in range(total + 1)}
        value, thresholds = table[total]
        if value < best[2]:
            best = (groups, thresholds, value)
    return best


def links(classes: DataFrame, fp: str, max_bits: int = 3) -> DataFrame:
    """(a, b), pairs of different fingerprints of at most max_bits differing bits, each once; fp must be distinct."""
    rows = classes.count()
    sample = np.array([r[0] for r in classes.select(fp).orderBy(F.xxhash64(fp)).limit(SAMPLE_ROWS).collect()], np.int64)
    signed = lambda v: v - (1 << BITS) if v >> (BITS - 1) else v
    groups, thresholds, _ = allocate(sample, rows, max_bits)
    index = probe = None
    for k, (bits, most) in enumerate(zip(groups, thresholds, strict=True)):
        if most < 0:
            continue
        key = F.col(fp).bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        row = classes.select(F.lit(k).alias("part"), key.alias("key"), F.col(fp).alias("fp"))
        flips = [signed(sum(1 << b for b in chosen)) for j in range(2, most + 1) for chosen in combinations(bits, j)]
        ones = [signed(1 << b) for b in bits] if most else []
        # of two keys one bit apart, the one without it probes
        one = F.filter(F.transform(F.array(*[F.lit(v) for v in ones]).cast("array<long>"), lambda v: F.col("key").bitwiseOR(v)), lambda v: v != F.col("key"))
        more = F.transform(F.array(*[F.lit(v) for v in flips]).cast("array<long>"), lambda v: F.col("key").bitwiseXOR(v))
        variants = F.concat(F.array("key"), one, more)
        asks = row.select("part", F.explode(variants).alias("key"), F.col("fp").alias("fp2"))
        index, probe = (row, asks) if index is None else (index.unionAll(row), probe.unionAll(asks))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits
    return index.join(probe, ["part", "key"]).where(near & (F.col("fp") != F.col("fp2"))).select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()


def simhash_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, key, fp, grp, n_class) of every row, written; grp is the smallest fingerprint reachable by links, key the text's MD5."""
    fps = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.count("*").alias("n_class")), "classes")
    found = components(links(classes, "fp", max_bits), "a", "b")
    grouped = classes.join(found, classes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("grp"), "n_class")
    return staged(fps.join(grouped, "fp"), "groups")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept, n_class) of every row; component_id is the smallest doc_id reachable by links.

    Null and empty texts, and texts of white space only, have fingerprint zero and are linked like any other. Equal
    fingerprints are one class before any probing, so exact copies cost one row. Rows with the same doc_id keep one result
    each; a null doc_id is never a component_id unless its group has no other. An empty table gives an empty result.
    """
    rows = simhash_rows(docs, id_col, text_col, words, max_bits)
    least = rows.groupBy("grp").agg(F.min("id").alias("component_id"))
    return rows.join(least, "grp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
        "n_class",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each near-duplicate group of docs: that with the smallest doc_id, of equals the smallest hash of the text.

    A null doc_id comes last. Rows that have doc_id and text in common are one document, of which any one row stays.
    """
    rows = simhash_rows(docs, id_col, text_col, words, max_bits)
    me = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = rows.groupBy("grp").agg(F.min(me).alias("first")).select("first.id", "first.key")
    like = lambda x, y: x["lodestack_id"].eqNullSafe(y["id"]) & (x["lodestack_key"] == y["key"])
    # few rows go as a rule, and a small table of them is broadcast; else both sides are shuffled
    gone = staged(rows.join(first, rows.id.eqNullSafe(first.id) & (rows.key == first.key), "left_anti").select("id", "key").distinct(), "gone")
    again = staged(rows.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select("id", "key"), "repeated")
    keyed = docs.withColumn("lodestack_id", F.col(id_col).cast("long")).withColumn("lodestack_key", text_key(F.col(text_col).cast("string")))
    alone = keyed.join(gone, like(keyed, gone), "left_anti")
    if again.isEmpty():
        return alone.select(docs.columns)
    many = alone.join(again, like(alone, again), "left_semi").groupBy("lodestack_id", "lodestack_key").agg(F.first(F.struct(*docs.columns)).alias("lodestack_row"))
    return alone.join(again, like(alone, again), "left_anti").select(docs.columns).unionByName(many.select("lodestack_row.*"))
