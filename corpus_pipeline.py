"""Corpus pipeline: toxicity filter, SimHash near-dedup, suffix-array dedup, benchmark decontamination, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import staged, table, text_key, vocabulary
from lodestack.llm.decontam import text_leaks
from lodestack.llm.piece_codec import encode_pieces
from lodestack.llm.simhash import one_of_each
from lodestack.llm.suffix_dedup import cut_texts
from lodestack.llm.toxicity import THRESHOLD, with_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity operator accepts; each is judged by its own text, with null and repeated doc_ids. Null and empty texts are texts of no words."""
    scored = with_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("lodestack_toxicity") < THRESHOLD).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest doc_id (null last), of equals the smallest text hash. Null, empty and blank texts are one group."""
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of long repeats, n_chars with them; a row of whose text nothing is left goes. Broken characters at cuts go too. Other rows stay as they are."""
    sized = docs.withColumn("lodestack_was", F.md5("text"))
    cut = cut_texts(sized)
    changed = ~F.md5("text").eqNullSafe(F.col("lodestack_was"))
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark. Null and empty texts hold none."""
    found = staged(text_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("key").alias("lodestack_key")).distinct(), "leaked-texts")
    return docs.withColumn("lodestack_key", text_key(F.col("text"))).join(found, "lodestack_key", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, ids) of what is left, a row each; null and empty texts have no ids."""
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", keep_one_of_each),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Trained models and suffix sorting have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
