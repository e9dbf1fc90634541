"""Retrieval, ranking, snapshots and roll-ups over DataFrames."""

from __future__ import annotations

from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import score as S
from lodestack.functions import text as T
from lodestack.operators.batches import placed


def diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change) between two snapshots: added, removed, modified or unchanged by content hash."""
    hashed = lambda x, name: x.select(F.col(key).alias(f"{name}_key"), F.sha2(F.col(content).cast("binary"), 256).alias(name))
    both = hashed(old, "was").join(hashed(new, "now"), F.col("was_key") == F.col("now_key"), "full_outer")
    change = F.when(F.col("was_key").isNull(), "added").when(F.col("now_key").isNull(), "removed").when(F.col("was") != F.col("now"), "modified").otherwise("unchanged")
    return both.select(F.coalesce("was_key", "now_key").alias(key), change.alias("change"))


def upsert(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """current with rows put over it by key; rewritten tells which came from rows."""
    kept = current.join(rows.select(key), key, "left_anti").withColumn("rewritten", F.lit(False))
    return kept.unionByName(rows.withColumn("rewritten", F.lit(True)))


def bm25(docs: DataFrame, asked: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents with an asked term; one pass counts them, and the corpus figures are one row."""
    words = T.words(F.col("text"))
    times = lambda t: F.size("w") - F.size(F.array_remove("w", t))
    counted = docs.select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("len"), *[times(t).alias(f"tf{i}") for i, t in enumerate(asked)])
    figures = counted.agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    part: Column = F.lit(0.0)
    for i in range(len(asked)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        part = part + F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    some = F.greatest(*[F.col(f"tf{i}") for i in range(len(asked))], F.lit(0)) > 0
    return counted.where(some).join(F.broadcast(figures)).select("doc_id", F.round(part, 6).alias("score"))


def mmr(vectors: DataFrame, pool: int, k: int, weight: float) -> DataFrame:
    """(label, vec_id, rank): of the pool most like the label's first vector, greedily the most relevant and least like those chosen; ties keep the first."""
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = vectors.join(first, "label").withColumn("relevance", S.cosine(F.col("embedding"), F.col("q")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("relevance"), "vec_id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= pool).select("label", "vec_id", "embedding", "relevance", "rank")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        v = np.stack(pdf["embedding"]).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        relevance, like, chosen = pdf["relevance"].to_numpy(), np.zeros(len(pdf)), []
        for _ in range(min(k, len(pdf))):
            gain = weight * relevance - (1 - weight) * like
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(gain)))
            like = np.maximum(like, v @ v[chosen[-1]])
        return pd.DataFrame({"label": pdf["label"].iloc[0], "vec_id": pdf["vec_id"].to_numpy()[chosen], "rank": range(1, len(chosen) + 1)})

    return best.groupBy("label").applyInPandas(choose, "label int, vec_id long, rank int")


def ngram_search(messages: DataFrame, terms: list[str]) -> DataFrame:
    """(conv_id, turn, score): postings of all the terms' trigrams intersect, then the text decides."""
    asked = sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})
    postings = messages.select("conv_id", "turn", F.explode(F.array_intersect(T.grams(F.col("text")), F.array(*map(F.lit, asked)))).alias("gram"))
    full = postings.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
    low = F.lower("text")
    matched = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return messages.join(full, ["conv_id", "turn"], "left_semi").where(matched == len(terms)).select("conv_id", "turn", F.round(matched / len(terms), 6).alias("score"))


def sealed(docs: DataFrame, fan_out: int) -> DataFrame:
    """Summary nodes of fan_out documents each, in order, per source; content is joined by blank lines and kept as its hash.

    Only ids are numbered, in ranges that share a source among tasks; texts come to their bucket by id. doc_ids are distinct.
    """
    numbered = placed(docs.select("source", "doc_id"), "source", ["doc_id"]).select("doc_id", F.expr(f"pos div {fan_out}").alias("bucket"))
    rows = docs.select("source", "doc_id", "text").join(numbered, "doc_id")
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("source", "bucket").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_children"),
        F.sum(T.chars_tokens(F.col("text"))).alias("tokens"), F.sha2(content.cast("binary"), 256).alias("content_sha256"),
    )


def ranking_metrics(ranked: DataFrame, group: str, k: int) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at k of ranked rows (group, rel, k)."""
    top = F.col("k") <= k
    m = ranked.groupBy(group).agg(F.sum(F.when(top, F.col("rel"))).alias("hits"), F.sum("rel").alias("total"), F.min(F.when(F.col("rel") == 1, F.col("k"))).alias("first"), F.sum(F.when(top, F.col("rel") / F.log2(F.col("k") + 1))).alias("dcg")).where("total > 0")
    ideal = F.element_at(F.array(*[F.lit(sum(1 / log2(i + 1) for i in range(1, n + 1))) for n in range(1, k + 1)]), F.least("total", F.lit(k)).cast("int"))
    return m.select(group, F.round(F.col("hits") / k, 6).alias(f"precision_at_{k}"), F.round(F.col("hits") / F.col("total"), 6).alias(f"recall_at_{k}"), F.round(1 / F.col("first"), 6).alias("rr"), F.round(F.col("dcg") / ideal, 6).alias(f"ndcg_at_{k}"))


def capped_rules(part: DataFrame, cap: int) -> DataFrame:
    """(p_partkey, critical, k): the best `cap` rules, or all critical ones if those are more; ranks are places in ranges of the order, so no task holds all rules."""
    rules = part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") >= 48).alias("critical"))
    most = max(cap, rules.where("critical").count())
    ranked = placed(rules.select(F.lit(0).alias("all"), (-F.col("p_size")).alias("size"), (-F.col("p_retailprice")).alias("price"), "p_partkey", "critical"), "all", ["size", "price", "p_partkey"])
    return ranked.where(F.col("pos") < most).select("p_partkey", "critical", (F.col("pos") + 1).alias("k"))
