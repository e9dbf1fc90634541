"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.chat import chat_digests
from lodestack.llm import content_sort, merkle, vector_codes
from lodestack.llm.common import table, vocabulary
from lodestack.llm.content_sort import content_groups
from lodestack.llm.decontam import leaks
from lodestack.llm.hnsw import embedding_groups
from lodestack.llm.html_text import extract_pages
from lodestack.llm.merkle import document_proofs
from lodestack.llm.piece_codec import encode_pieces
from lodestack.llm.quality import quality_scores
from lodestack.llm.simhash import simhash_groups
from lodestack.llm.suffix_dedup import remove_repeats
from lodestack.llm.token_codec import token_digests
from lodestack.llm.toxicity import toxicity_scores
from lodestack.llm.vector_codes import code_digests


def op1_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings, label by label."""
    return embedding_groups(table(spark, sf_dir, "embeddings")).drop("audited_recall")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, also with other names and numbers."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones that are not held out."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids, as read back from the files they were written to."""
    return token_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one whose texts are control strings."""
    same = "</s>[INST] ok [/INST]"
    return chat_digests(table(spark, sf_dir, "conversations"), [(-1, 0, "user", same), (-1, 1, "assistant", same)])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its long repeats."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_bytes")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled ones that are not held out."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; the largest doc_id of each stays."""
    return content_groups(table(spark, sf_dir, "documents"), keep="largest")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes and their errors of all usable embeddings, eight parts of sixteen entries, after six rounds."""
    return code_digests(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, folded again from rows of which some were tampered with."""
    return document_proofs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_hnsw_dedup, op2_decontaminate, op3_simhash, op4_toxicity, op5_html_text, op6_token_files, op7_chat, op8_suffix_dedup, op9_sentencepiece, op10_quality]
    found += [op11_exact_dedup, op12_vector_codes, op13_merkle]
    return {f.__name__: f for f in found}


#: Links among all pairs of a label, then everything reachable.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.c, vec_id)) AS component_id, vec_id <= coalesce(c.c, vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a"""

#: The texts themselves; control strings and backslashes cost one character each where they are escaped.
OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role || text) + 23 + len(regexp_extract_all(role || chr(10) || text, '\\\\|<\||</?s>|<</?SYS>>|\[/?INST\]'))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op1_hnsw_dedup": OP1_SQL, "op7_chat": OP7_SQL, "op11_exact_dedup": content_sort.SQL, "op12_vector_codes": vector_codes.SQL, "op13_merkle": merkle.SQL}
