"""Scores on columns: relevance, freshness, hybrid, admission signals and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import EMAIL, URL, chars_tokens, words

#: Weights of hybrid profiles, for graph, vector, keyword and freshness.
PROFILES = {"balanced": (0.35, 0.35, 0.15, 0.15), "semantic": (0.15, 0.65, 0.20, 0.0), "lexical": (0.25, 0.15, 0.60, 0.0), "graph_first": (0.55, 0.30, 0.15, 0.0)}
#: Weights of the admission signals.
WEIGHTS = {"tokens": 1.0, "unique": 1.0, "kind": 1.5, "source": 1.5, "interaction": 3.0, "entities": 1.0}
KINDS = {"email": 0.8, "document": 0.9, "chat": 0.5}
THRESHOLD = 0.3


def cosine(a: Column, b: Column) -> Column:
    """In double precision, clamped to -1..1; 0 for unequal lengths and zero vectors."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm)))


def keyword_relevance(query: Column, content: Column) -> Column:
    """Share of the query's distinct words that the content has; 0 for no words."""
    q, c = F.array_distinct(words(query)), words(content)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def lexical_score(query: str, content: Column) -> Column:
    """Share of the query's terms, repeats counted, that are substrings of the content; null if none is."""
    asked = query.lower().split()
    low = F.lower(content)
    matched = sum((F.contains(low, F.lit(t)).cast("int") for t in asked), F.lit(0))
    return F.when(matched > 0, matched / F.lit(len(asked)))


def freshness(age_days: Column, half_life: float = 7.0) -> Column:
    if half_life <= 0:
        return F.lit(1.0)
    return F.when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def hybrid(graph: Column, vector: Column, keyword: Column, fresh: Column, profile: str = "balanced") -> Column:
    return sum((w * x for w, x in zip(PROFILES[profile], (graph, vector, keyword, fresh), strict=True)), F.lit(0.0))


def token_ramp(tokens: Column) -> Column:
    """0 below 10, up to 1 at 30, 1 to 3000, down to a half at 8000."""
    return F.when(tokens < 10, 0.0).when(tokens < 30, (tokens - 10) / 20.0).when(tokens <= 3000, 1.0).when(tokens < 8000, 1.0 - 0.5 * (tokens - 3000) / 5000.0).otherwise(0.5)


def unique_words(text: Column) -> Column:
    """Share of distinct words from 0.3 to 0.7, as 0 to 1; under five words a half. A word is what a term holds from its first letter or digit to its last."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}](?:\S*[\p{L}\p{N}])?)"), F.lit(1))

    def share(w: Column) -> Column:
        return F.when(F.size(w) < 5, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.size(F.array_distinct(w)) / F.size(w) - 0.3) / 0.4)))

    return F.get(F.transform(F.array(found), share), F.lit(0))  # the words are looked for once


def entities(text: Column) -> Column:
    """Distinct e-mail addresses and URLs, lower-cased; looked for only where a text has their signs."""
    found = lambda sign, pattern: F.when(F.contains(text, F.lit(sign)), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(found("@", EMAIL), found("://", URL)), F.lower))


def entity_density(tokens: Column, n_entities: Column) -> Column:
    return F.when(tokens == 0, 0.0).otherwise(F.least(F.lit(1.0), n_entities / tokens / 0.01))


def with_signals(rows: DataFrame, text: Column, kind: Column, interaction: Column) -> DataFrame:
    """rows with tok, n_entities, a column s_<signal> for each cheap signal, and total. Words, entities and tokens of a text are counted once, the signals made of the counts."""
    weight = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in KINDS.items()], F.lit(0.5))
    counted = rows.withColumns({"tok": chars_tokens(text), "n_entities": F.size(entities(text)), "s_unique": unique_words(text), "s_kind": weight, "s_source": weight, "s_interaction": interaction})
    made = counted.withColumns({"s_tokens": token_ramp(F.col("tok")), "s_entities": entity_density(F.col("tok"), F.col("n_entities"))})
    return made.withColumn("total", admission({k: F.col(f"s_{k}") for k in WEIGHTS}))


def admission(found: dict[str, Column]) -> Column:
    """Weighted mean of the cheap signals, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((WEIGHTS[k] * v for k, v in found.items()), F.lit(0.0)) / sum(WEIGHTS.values())))
