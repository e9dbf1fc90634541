"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a fixed and of a learned lexicon, their nearness to second-person words, and rates of capitals,
punctuation and obfuscated words. Labelled rows that may be learnt from are split by a hash into three: one learns the
lexicon (words and word beginnings with high log odds), one the trees, one the calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import staged

TRAIN_ROWS = 24_000  # labelled rows that are learnt from, at most: those with the lowest hashes
TERMS = 400  # entries of the learned lexicon
LEAST_DOCS = 5
THRESHOLD = 0.7
CACHE = 200_000
#: Insults, and words for the reader.
INSULTS = "idiot idiots moron morons stupid loser losers pathetic worthless disgusting trash scum clown clowns dumb fool fools jerk freak garbage imbecile retard ugly hate kill shut pig filth vermin idiota imbécil estúpido estúpida basura asqueroso idiote imbécile stupide ordure crétin minable dumm dummkopf abschaum widerlich arschloch versager".split()
YOU = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti usted ustedes vosotros".split()
#: Signs that stand for letters in disguised words.
LEET = str.maketrans("013457@$!|", "oieastasil")
FEATURES = ["insults", "insult_kinds", "learned", "learned_most", "learned_kinds", "near_you", "you", "capitals", "caps_words", "punctuation", "exclaims", "digits", "obfuscated", "disguised", "stretched", "log_words", "word_length"]
_WORD = re.compile(r"[^\s.,;:?!\"()\[\]|]+")
_EDGE = ".,;:?!\"'()[]|*#%&$-_~"
_MIXED = re.compile(r"[^\W\d_][\d@$!|*#.\-_]+[^\W\d_]")
_STRETCH = re.compile(r"(\w)\1\1")


def _starts(word: str) -> Iterator[str]:
    yield word
    for n in range(4, min(9, len(word))):
        yield word[:n] + "…"


def features(text: str | None, learned: dict[str, float], seen: dict) -> list[float]:
    """Values of FEATURES; null as empty, an empty text has zeros."""
    text = text or ""
    low = text.lower()
    words = low.split()
    n = max(1, len(words))
    insult = best = kinds = learned_kinds = obf = disguised = stretched = you = 0.0
    total = 0.0
    hits = set()
    for word, times in Counter(words).items():
        got = seen.get(word)
        if got is None:
            bare = word.strip(_EDGE)
            plain = _STRETCH.sub(r"\1", re.sub(r"[*#.\-_]", "", bare.translate(LEET)))
            mixed = bool(_MIXED.search(bare))
            weight = max((learned[s] for s in _starts(bare) if s in learned), default=0.0)
            got = (bare in _INSULT, weight, mixed, bare not in _INSULT and plain in _INSULT, bool(_STRETCH.search(bare)), bare in _YOU)
            if len(seen) < CACHE:
                seen[word] = got
        bad, weight, mixed, hidden, stretch, reader = got
        if bad or hidden or weight:
            hits.add(word)
            insult += times * (bad or hidden)
            kinds += bad or hidden
            total += times * weight
            learned_kinds += weight > 0
            best = max(best, weight)
        obf += times * mixed
        disguised += times * hidden
        stretched += times * stretch
        you += times * reader
    near = 0
    if hits and you:
        at = [i for i, w in enumerate(words) if w in hits]
        readers = {i for i, w in enumerate(words) if w.strip(_EDGE) in _YOU}
        near = sum(any(i + k in readers for k in range(-4, 5)) for i in at)
    chars = max(1, len(text))
    caps = sum(map(str.isupper, text))
    caps_words = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    punct = sum(text.count(c) for c in ".,;:?!*#%&$|") / chars
    digits = sum(text.count(c) for c in "0123456789") / chars
    return [insult / n, kinds, total / n, best, learned_kinds, near / n, you / n, caps / chars, caps_words / n, punct, text.count("!") / chars, digits, obf / n, disguised / n, stretched / n, math.log1p(len(words)), len(low) / n]


_INSULT, _YOU = frozenset(INSULTS), frozenset(YOU)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def training_rows(docs: DataFrame, labels: DataFrame, target: str, usable: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label, fold 0 to 2) of labelled rows that may be learnt from; the ids are bounded by most, so they are broadcast."""
    picked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where(usable & F.col("label").isin(0, 1))
    picked = picked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(picked), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int"))


def _lexicon(rows: DataFrame) -> dict[str, float]:
    """Log odds of the terms that mark toxic texts best; counts are made by Spark, TERMS entries come back."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for label, text in x[["label", "text"]].itertuples(index=False):
                found = {s for w in set(_WORD.findall((text or "").lower())) for s in _starts(w.strip(_EDGE)) if s}
                yield pd.DataFrame({"term": list(found), "label": label})

    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    counts = rows.mapInPandas(terms, "term string, label int").groupBy("term").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("n") - F.col("bad") + 0.5) / (good + 1)))
    best = counts.withColumn("odds", odds).where((F.col("odds") > 1) & (F.col("bad") / F.col("n") > 0.5)).orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(TERMS)
    return {r["term"]: float(r["odds"]) for r in best.collect()}


def _featured(rows: DataFrame, learned: dict[str, float], keep: str) -> DataFrame:
    names = [x.split()[0] for x in keep.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for x in batches:
            out = pd.DataFrame([features(t, learned, seen) for t in x["text"]], columns=FEATURES, dtype=float)
            yield pd.concat([x[names].reset_index(drop=True), out], axis=1)

    return rows.mapInPandas(each, f"{keep}, {', '.join(f'{f} double' for f in FEATURES)}")


def _feature_column(text: Column, learned: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict = {}
        for x in batches:
            yield pd.Series([features(t, learned, seen) for t in x])

    return each(text)


def with_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", most: int = TRAIN_ROWS, trees: int = 20) -> DataFrame:
    """docs, every row and column of it, with its score as lodestack_toxicity; no row is shuffled. What is learnt: see toxicity_scores."""
    train = training_rows(docs, labels, target, ~held_out(F.col("doc_id"), 3, 1), most, id_col, text_col)
    train = staged(train, "toxicity-rows")
    learned = _lexicon(train.where("fold = 0"))
    known = staged(_featured(train.where("fold > 0"), learned, "doc_id long, label int, fold int"), "toxicity-features")
    found = {(r["fold"], r["label"]): r["n"] for r in known.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    if not all(found.get((fold, label)) for fold in (1, 2) for label in (0, 1)):
        mean = sum(n for (_, label), n in found.items() if label) / max(1, sum(found.values()))
        return docs.withColumn("lodestack_toxicity", F.lit(float(mean)))
    # names that columns of docs don't have
    name = {k: f"lodestack_{k}" for k in ("features", "probability", "margin", "class", "raw", "step")}
    vectors = VectorAssembler(inputCols=FEATURES, outputCol=name["features"])
    trained = GBTClassifier(labelCol="label", featuresCol=name["features"], predictionCol=name["class"], maxIter=trees, maxDepth=4, stepSize=0.2, seed=11, maxBins=64, minInstancesPerNode=4)
    model = trained.setProbabilityCol(name["probability"]).setRawPredictionCol(name["margin"]).fit(vectors.transform(known.where("fold = 1")))
    raw = lambda x: model.transform(x).withColumn(name["raw"], vector_to_array(name["probability"])[1])
    iso = IsotonicRegression(labelCol="label", featuresCol=name["raw"], predictionCol=name["step"])
    iso = iso.fit(raw(vectors.transform(known.where("fold = 2"))).select(name["raw"], F.col("label").cast("double")))
    scored = iso.transform(raw(docs.withColumn(name["features"], array_to_vector(_feature_column(F.col(text_col).cast("string"), learned)))))
    # calibrated, with the trees' own order kept inside a step
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(name["step"]) * 0.98 + F.col(name["raw"]) * 0.02))
    return scored.select(*docs.columns, score.alias("lodestack_toxicity"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", threshold: float = THRESHOLD, most: int = TRAIN_ROWS, trees: int = 20) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; only the text is scored.

    Labels are learnt from rows whose crc32(doc_id as text) mod 3 is not 1, at most `most` of them. Null and empty texts
    are scored as texts of no words. Without both labels every score is the mean of those there are, 0 if none. Repeated
    rows get equal results; a null doc_id has a null held_out and is never learnt from; null labels are passed over.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labelled = labels.select(F.col(id_col).alias("doc_id"), target)
    made = with_toxicity(rows, labelled, target=target, most=most, trees=trees).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("lodestack_toxicity").alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
