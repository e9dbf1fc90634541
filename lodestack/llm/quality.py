"""Quality: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of words, of their shapes, of repeats of the word before and of lengths, by share; a truncated singular
value decomposition of labelled texts makes these latent vectors. A bounded number of labelled vectors goes to every task,
which computes cosines with all of them, block by block, and weights the nearest ones' labels by similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import staged
from lodestack.llm.toxicity import held_out, training_rows

TRAIN_ROWS = 4_096  # labelled vectors, at most: those with the lowest hashes; 512 KB when broadcast
TERMS = 4_096
SHAPES = 1_024  # terms for shapes; the rest are for words
WORDS = 0.5  # weight of words against shapes
RANK = 32
NEIGHBOURS = 25
SHARPNESS = 8.0
THRESHOLD = 0.3
PIECE = 64  # characters
CACHE = 200_000
BLOCK = 512
_RUNS = re.compile(r"(.)\1+")


def shapes(word: str) -> list[str]:
    """A word's kinds of characters, runs as one, 8 at a time: A upper case, a other letters, 9 digits, signs as they are; ' marks more than three letters."""
    kinds = _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))
    return [kinds[i : i + 8] + ("'" if len(word) > 3 else "") for i in range(0, len(kinds), 8)]


def terms(text: str | None, seen: dict[str, tuple[list[int], int]]) -> dict[int, float]:
    """Share of each hashed term; null as empty, an empty text has one term of its own. Long words count as words of PIECE characters."""
    words = (text or "").split()
    if not words:
        return {0: 1.0}
    if max(map(len, words)) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    bag: Counter = Counter()
    vocabulary: Counter = Counter()
    for word, n in Counter(words).items():
        ks = seen.get(word)
        if ks is None:
            ks = [1 + xxhash.xxh64_intdigest(k) % (SHAPES - 1) for k in shapes(word)], SHAPES + xxhash.xxh64_intdigest(word.lower()) % (TERMS - 20 - SHAPES)
            if len(seen) < CACHE:
                seen[word] = ks
        for k in ks[0]:
            bag[k] += n
        vocabulary[ks[1]] += n
    total, held = len(words), sum(bag.values())
    out = {k: np.sqrt(n / held) for k, n in bag.items()} | {k: WORDS * np.sqrt(n / total) for k, n in vocabulary.items()}
    out[TERMS - 1] = np.sqrt(sum(map(eq, words, words[1:])) / total)
    out[TERMS - 2] = np.sqrt(max(0.0, 1 - len(set(words)) / total))
    out[TERMS - 3 - min(15, total.bit_length())] = 0.3  # length, by powers of two
    return out


def _matrix(texts: list, seen: dict[str, tuple[list[int], int]]) -> np.ndarray:
    x = np.zeros((len(texts), TERMS), np.float32)
    for i, t in enumerate(texts):
        bag = terms(t, seen)
        x[i, list(bag)] = list(bag.values())
    return x


def _axes(x: np.ndarray, extra: int = 16, rounds: int = 8) -> np.ndarray:
    """The first RANK right singular vectors of x, by subspace iteration."""
    base = np.random.default_rng(5).normal(size=(x.shape[1], min(RANK + extra, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        base, _ = np.linalg.qr(x.T @ (x @ base))
    _, _, turn = np.linalg.svd(x @ base, full_matrices=False)
    return (turn @ base.T)[:RANK]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", threshold: float = THRESHOLD, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; only the text is scored.

    Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0, at most `most` doc_ids; of rows with one doc_id any one. Null and empty texts
    are alike. Without labelled rows every score is 0. Repeated rows get equal results; a null doc_id has a null held_out
    and is never learnt from; null labels are passed over.
    """
    train = training_rows(docs, labels, target, ~held_out(F.col("doc_id"), 5, 0), most, id_col, text_col)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[list[int], int]] = {}
        for x in batches:
            made = [terms(t, seen) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "label": x["label"], "keys": [list(b) for b in made], "shares": [[float(v) for v in b.values()] for b in made]})

    known = staged(train.mapInPandas(bags, "doc_id long, label int, keys array<int>, shares array<double>"), "quality-rows").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = held_out(F.col("doc_id"), 5, 0).alias("held_out")
    if known.empty:
        return rows.select("doc_id", out, F.lit(0.0).alias("score"), F.lit(int(threshold <= 0)).alias("predicted"))
    x = np.zeros((len(known), TERMS), np.float32)
    for i, (keys, shares) in enumerate(zip(known["keys"], known["shares"], strict=True)):
        x[i, keys] = shares
    idf = (1 + np.log((1 + len(x)) / (1 + (x > 0).sum(0)))).astype(np.float32)
    used = np.flatnonzero((x > 0).any(0))
    axes = _axes(x[:, used] * idf[used])
    to = np.zeros((TERMS, min(RANK, len(axes))), np.float32)
    to[used] = axes[:RANK].T
    to *= idf[:, None]
    model = docs.sparkSession.sparkContext.broadcast((to, _unit(x @ to), known["label"].to_numpy(np.float32)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, vectors, label = model.value
        k = min(NEIGHBOURS, len(vectors))
        seen: dict[str, tuple[list[int], int]] = {}
        for x in batches:
            for i in range(0, len(x), BLOCK):
                part = x.iloc[i : i + BLOCK]
                cos = _unit(_matrix(list(part["text"]), seen) @ to) @ vectors.T
                near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(cos, near, 1), 0) ** SHARPNESS + 1e-9
                value = (weight * label[near]).sum(1) / weight.sum(1)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": np.clip(value, 0, 1).astype(float)})

    made = rows.mapInPandas(score, "doc_id long, score double")
    return made.select("doc_id", out, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
