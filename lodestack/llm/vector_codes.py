"""Product codes of vectors in whole numbers, searched by partial distances.

Vectors become integers and are packed into blocks once; each round is one pass over the blocks. A task assigns every
part of its vectors to the nearest entry of that part's codebook and returns sums and counts by entry, which Spark adds
up: a codebook of 128 short rows is all that comes to the driver and goes out with the next pass. The search starts from a complete
distance, to the entry a part had before, then takes the entries one by one and their dimensions in descending
variance of the codebook; a mask drops a vector from an entry once the distance so far is strictly over its best complete one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import staged

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
BLOCK = 4_096  # vectors packed together
COMPACT = 0.75  # rows are gathered anew once fewer than this share of them is left
BLOCKS = "ids binary, labels binary, v binary"


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts begin and end: of equal length, the first ones longer by one where that is not possible."""
    return np.cumsum([0, *[dim // parts + (k < dim % parts) for k in range(parts)]]).tolist()


def nearest(x: np.ndarray, codebook: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, terms added up) of each row of x; ties go to the lower entry. start: an entry for each row whose distance is completed first."""
    order = np.argsort(-codebook.astype(float).var(0), kind="stable")
    columns, entry = np.ascontiguousarray(x.T), start.astype(np.int64)
    best = ((x - codebook[entry]) ** 2).sum(1)
    terms = x.size
    for e in range(len(codebook)):
        rows = np.flatnonzero(entry != e)
        so_far, limit = np.zeros(len(rows), np.int64), best[rows]
        for d in order:
            if not len(rows):
                break
            off = columns[d][rows] - codebook[e, d]
            so_far += off * off
            terms += len(rows)
            alive = so_far <= limit
            if np.count_nonzero(alive) < COMPACT * len(rows) or d == order[-1]:
                rows, so_far, limit = rows[alive], so_far[alive], limit[alive]
        better = (so_far < limit) | (e < entry[rows])  # all left are at most as far as their best
        entry[rows[better]], best[rows[better]] = e, so_far[better]
    return entry, best, terms


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed blocks of ids, labels (as JSON) and vectors."""
    for x in batches:
        for at in range(0, len(x), BLOCK):
            part = x.iloc[at : at + BLOCK]
            yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "labels": [json.dumps(list(part["label"])).encode()], "v": [np.concatenate(part["v"].to_numpy()).astype("<i4").tobytes()]})


def _assign(block, codebooks: list[np.ndarray], begins: list[int], before: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, entries, distances) of a block, entries and distances by part. A part starts from the entry that the former codebook gives it by its first dimension."""
    v = np.frombuffer(block, "<i4").reshape(-1, begins[-1]).astype(np.int64)
    codes, off = [], []
    for k, book in enumerate(codebooks):
        x = v[:, begins[k] : begins[k + 1]]
        widest = int(np.argmax(book.max(0) - book.min(0))) if x.shape[1] else 0
        start = np.zeros(len(v), np.int64)
        if x.shape[1]:
            rank = np.argsort(book[:, widest], kind="stable")
            start = rank[np.minimum(np.searchsorted(book[rank, widest], x[:, widest]), len(book) - 1)]
        entry, best, _ = nearest(x, book, start)
        codes.append(entry)
        off.append(best)
    return v, np.stack(codes, 1), np.stack(off, 1)


def _moved(codebooks: list[np.ndarray], begins: list[int]):
    """Sums and counts by part and entry of all blocks of a task."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in codebooks], [np.zeros(len(b), np.int64) for b in codebooks]
        for batch in batches:
            for block in batch["v"]:
                v, codes, _ = _assign(block, codebooks, begins)
                for k in range(len(codebooks)):
                    np.add.at(sums[k], codes[:, k], v[:, begins[k] : begins[k + 1]])
                    counts[k] += np.bincount(codes[:, k], minlength=len(counts[k]))
        rows = [(k, e, d, int(counts[k][e]), int(sums[k][e, d])) for k in range(len(codebooks)) for e in np.flatnonzero(counts[k]) for d in range(sums[k].shape[1])]
        yield pd.DataFrame(rows, columns=["part", "entry", "d", "n", "total"])

    return add


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v): vectors as integers; those that are null, empty or hold null or non-finite components are left out, and so are null ids. label is null-safe text."""
    v = F.col("raw")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("raw"))
    good = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    largest = F.floor(F.sqrt(F.lit(2.0**60) / F.size(v)))  # so that no distance overflows
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e9)), F.lit(-1e9)) * SCALE), largest), -largest).cast("int"))
    return rows.where(good & F.col("id").isNotNull()).select("id", F.coalesce(F.concat(F.lit("1"), "label"), F.lit("0")).alias("label"), whole.alias("v"))


def train(blocks: DataFrame, codebooks: list[np.ndarray], begins: list[int], rounds: int) -> list[np.ndarray]:
    """The codebooks after so many rounds; entries without parts stay. What comes back each time is a row for each component of the codebooks."""
    for _ in range(rounds):
        moved = blocks.select("v").mapInPandas(_moved(codebooks, begins), "part int, entry int, d int, n long, total long")
        codebooks = [b.copy() for b in codebooks]
        for x in moved.groupBy("part", "entry", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            codebooks[x.part][x.entry, x.d] = int(x.total) // int(x.n)
    return codebooks


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), codebooks): label as in usable_vectors; code: the entries' numbers by part; error: squared distances summed over parts.

    A component x is floor(4096 x), kept so far from zero as distances of that length fit in a long (32,768 for x, of 64 components). Codebooks start as the parts of
    the smallest ids (of equal ids by the vector, then the label), as many as there are if those are fewer than entries. Vectors without the
    length of the smallest id's are left out like unusable ones; a length that parts doesn't divide gives longer first
    parts. Repeated rows are vectors of their own. An empty table gives no rows and no codebooks.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, id_col, vec_col, label_col)
    order = ["id", "v", "label"]
    dim = [len(r.v) for r in rows.orderBy(*order).limit(1).collect()]
    if not dim:
        return spark.createDataFrame([], f"{id_col} long, label string, code array<int>, error long"), []
    rows = rows.where(F.size("v") == dim[0])
    first = np.array([r.v for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    begins = cuts(dim[0], parts)
    blocks = staged(rows.mapInPandas(_blocks, BLOCKS), "vector-blocks")
    codebooks = train(blocks, [first[:, a:b] for a, b in zip(begins, begins[1:], strict=False)], begins, rounds)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, labels, v in batch.itertuples(index=False):
                _, codes, off = _assign(v, codebooks, begins)
                yield pd.DataFrame({id_col: np.frombuffer(ids, np.int64), "label": json.loads(labels), "code": list(codes.astype(np.int32)), "error": off.sum(1)})

    return blocks.mapInPandas(code, f"{id_col} long, label string, code array<int>, error long"), codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for book in codebooks for entry in book for c in entry).encode()).hexdigest()


def code_digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector; code in lowercase hex, two digits a part; label_error: error summed over the vectors of a label, null being one; null beyond a long."""
    made, codebooks = vector_codes(vectors)
    made = staged(made, "codes")
    sums = made.groupBy("label").agg(F.try_sum("error").alias("label_error"))  # combined in each task: a row for each label
    code = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return made.join(sums, "label").select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other in DuckDB SQL."""
    nearest_of = lambda b: f"SELECT p.vec_id, p.part, p.x, arg_min(b.entry, (list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry, min(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS off FROM p JOIN {b} b USING (part) GROUP BY p.vec_id, p.part, p.x"
    out = f"""WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, q[part * len(q) // {PARTS} + 1:(part + 1) * len(q) // {PARTS}] AS x FROM v, range({PARTS}) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {ENTRIES})"""
    for k in range(ROUNDS):
        out += f""",
a{k} AS MATERIALIZED ({nearest_of(f"b{k}")}),
m{k} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY d) AS c FROM (
  SELECT part, entry, d, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT part, entry, d, sum(x[d + 1]) AS s, count(*) AS n FROM a{k}, range(len(x)) r(d) GROUP BY part, entry, d)) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
    return out + f""",
z AS MATERIALIZED ({nearest_of(f"b{ROUNDS}")}),
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(off)::BIGINT AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(t, ',' ORDER BY part, entry)) FROM (SELECT part, entry, array_to_string(c, ',') AS t FROM b{ROUNDS})) AS codebooks_sha256
FROM c JOIN v USING (vec_id)"""


SQL = _sql()
