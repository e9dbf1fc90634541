"""Exact dedup by a content sort.

Spark samples splitters and deals texts to ranges of their bytes; each range is sorted externally, so equal texts are
neighbours, and each is compared whole with the one before. The splitters see the first PREFIX bytes, a hash of the
whole text and the id, never whole texts: their sample stays small, texts with one long beginning are spread, and so
is a group of copies, by its ids. A group that spans ranges is put together from its runs there: only a range's first
and last runs can go on elsewhere, and only their counts are exchanged, one text for each such run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import staged

PREFIX = 32
RUNS = "id long, sha string, n long, top long, last boolean, run long, body binary"
_RUNS = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("n", pa.int64()), ("top", pa.int64()), ("last", pa.bool_()), ("run", pa.int64()), ("body", pa.binary())])


class _Runs:
    """Runs of equal texts among the rows of a range, in order; only ids are kept of a run, until it ends.

    Runs that share prefix and hash with the range's first or last row may go on in other ranges: their last rows carry a run number and the text.
    """

    def __init__(self, task: int) -> None:
        self.task, self.made = task, 0
        self.key = self.text = self.first = None
        self.ids: list[int | None] = []
        self.held: list[dict] = []  # runs of the current key: they are open if the range ends with it

    def _end_run(self) -> None:
        if self.ids:
            self.held.append({"ids": self.ids, "text": self.text})
        self.ids = []

    def _rows(self, runs: list[dict], is_open: bool) -> Iterator[pa.RecordBatch]:
        for x in runs:
            ids, n = x["ids"], len(x["ids"])
            self.made += 1
            run = (self.task << 40) + self.made if is_open else None
            columns = [
                pa.array(ids, pa.int64()), pa.array([hashlib.sha256(x["text"]).hexdigest()] * n), pa.array(np.full(n, n)), pa.array([ids[-1]] * n, pa.int64()),
                pa.array(np.arange(n) == n - 1), pa.array([run] * n, pa.int64()), pa.array([None] * (n - 1) + [x["text"] if is_open else None], pa.binary()),
            ]
            yield from pa.Table.from_arrays(columns, schema=_RUNS).to_batches(max_chunksize=20_000)

    def _end_key(self, at_end: bool) -> Iterator[pa.RecordBatch]:
        self._end_run()
        yield from self._rows(self.held, at_end or self.key == self.first)
        self.held = []

    def add(self, key: tuple, text: bytes, row_id: int | None) -> Iterator[pa.RecordBatch]:
        if self.first is None:
            self.first = self.key = key
        if key != self.key:
            yield from self._end_key(False)
            self.key = key
        elif self.ids and text != self.text:
            self._end_run()
        self.text = text
        self.ids.append(row_id)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.first is not None:
            yield from self._end_key(True)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, waiting, rows = _Runs(TaskContext.get().partitionId()), [], 0
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("prefix", "hash", "body", "id")]
        for prefix, code, body, row_id in zip(*columns, strict=True):
            for made in runs.add((prefix, code), body, row_id):
                waiting.append(made)
                rows += made.num_rows
            if rows >= 4_096:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, rows = [], 0
    waiting += runs.end()
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "smallest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; rows whose normalised texts have the same bytes are one group.

    normalise: a function from the text's column to another one; none: texts stay as they are. keep: the row with the
    smallest or largest id stays, any other before one with a null id; of rows with that id one. A null text counts as
    empty, empty texts are equal. keep_id is null only in a group whose ids all are. An empty table gives no rows; other
    columns play no part. text_sha256 is of the normalised text in UTF-8.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = (normalise(text) if normalise else text).cast("binary")
    order = (lambda x: F.col(x)) if keep == "largest" else F.bitwise_not  # the row that stays comes last; turning all bits turns the order
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).withColumn("id", order("id"))
    keyed = rows.select("id", "body", F.substring("body", 1, PREFIX).alias("prefix"), F.xxhash64("body").alias("hash"))
    ranged = keyed.repartitionByRange("prefix", "hash", F.col("id").asc_nulls_first()).sortWithinPartitions("prefix", "hash", "body", F.col("id").asc_nulls_first())
    found = staged(ranged.mapInArrow(_neighbours, RUNS), "runs")
    ends = found.where("run is not null and last").select(F.col("run").alias("of"), "body", "n", "top")
    whole = ends.groupBy("body").agg(F.sum("n").alias("size"), F.max("top").alias("best"), F.max_by("of", F.struct("top", "of")).alias("owner"), F.collect_list("of").alias("runs"))
    joined = staged(whole.select(F.explode("runs").alias("run"), "size", "best", "owner"), "joined-runs")
    closed = found.where("run is null").select("id", F.col("top").alias("best"), F.col("n").alias("size"), F.col("last").alias("kept"), "sha")
    open_ = found.where("run is not null").select("id", "last", "run", "sha").join(joined, "run").select("id", "best", "size", (F.col("last") & (F.col("run") == F.col("owner"))).alias("kept"), "sha")
    out = closed.unionByName(open_)
    return out.select(order("id").alias(id_col), order("best").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


#: The same in DuckDB SQL, for the largest id and texts as they are.
SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
