"""Buffers as a stateful stream: items gather by tree, a buffer that reaches its gate is sealed, one that gets too old is flushed.

State is kept by tree: the waiting items, the ids that were taken, and the number of the next node. What a seal takes is
what waits at that moment, in order; what comes later waits for the next one. An item that comes again, in the same or a
later batch, is passed over. Ages go by event time: when the watermark passes the oldest waiting item's time by more than
the age, the buffer is sealed whatever it holds.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestack.sources.staging import shared_dir

SEALED = "tree string, node long, items array<string>, tokens long, start_ms long, end_ms long, forced boolean"
SHARES = 1024  # lists of taken ids of a tree
_COLUMNS = ["tree", "node", "items", "tokens", "start_ms", "end_ms", "forced"]


class SealBuffers(StatefulProcessor):
    """Seals by tokens, flushes by age. Taken ids are known until the watermark has passed their items, which then can't come again.

    State is asked once for what a batch touches, not once for an item: taken ids are kept in SHARES lists by a hash, waiting items in one list."""

    def __init__(self, gate: int, age_ms: int) -> None:
        self.gate, self.age_ms = gate, age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms long, item string, tokens long")
        self.taken = handle.getMapState("taken", "share int", "items array<string>, at_ms array<long>")
        self.figures = handle.getValueState("figures", "node long, tokens long, oldest long, forgotten long")

    def _figures(self) -> list[int]:
        return [int(x) for x in self.figures.get()] if self.figures.exists() else [0, 0, -1, 0]

    def _seal(self, tree: str, held: list[tuple], figures: list[int], forced: bool) -> tuple:
        held = sorted(held)
        row = (tree, figures[0], [x[1] for x in held], sum(x[2] for x in held), held[0][0], held[-1][0], forced)
        figures[:3] = [figures[0] + 1, 0, -1]
        return row

    def _new(self, came: pd.DataFrame) -> pd.DataFrame:
        """The items that were not taken before, which are taken now."""
        came = came.drop_duplicates("item")
        share = came["item"].map(lambda x: zlib.crc32(x.encode()) % SHARES)
        kept = []
        for k, own in came.groupby(share.to_numpy(), sort=False):
            before = self.taken.getValue((int(k),)) if self.taken.containsKey((int(k),)) else ((), ())
            own = own[~own["item"].isin(set(before[0]))]
            if len(own):
                self.taken.updateValue((int(k),), ([*before[0], *own["item"]], [*map(int, before[1]), *map(int, own["at_ms"])]))
                kept.append(own)
        return pd.concat(kept).sort_values(["at_ms", "item"]) if kept else came[:0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        came = self._new(pd.concat(list(rows)).sort_values(["at_ms", "item"]))
        figures, sealed, held = self._figures(), [], []
        before = figures[2]
        for item, tokens, at in zip(came["item"], came["tokens"].fillna(0).clip(lower=0), came["at_ms"], strict=True):
            held.append((int(at), item, int(tokens)))
            figures[1] += int(tokens)
            figures[2] = int(at) if figures[2] < 0 else min(figures[2], int(at))
            if figures[1] >= self.gate:
                sealed.append(self._seal(key[0], held if sealed else [*self._waiting(), *held], figures, False))
                held = []
        if sealed:
            self.waiting.clear()
        if held:
            self.waiting.appendList(held)
        passed = timerValues.getCurrentWatermarkInMs()
        if passed - figures[3] >= self.age_ms:
            self._forget(passed)
            figures[3] = passed
        self.figures.update(tuple(figures))
        self._watch(before, figures[2])
        yield pd.DataFrame(sealed, columns=_COLUMNS)

    def _waiting(self) -> list[tuple]:
        return [(int(x[0]), x[1], int(x[2])) for x in self.waiting.get()] if self.waiting.exists() else []

    def _forget(self, passed: int) -> None:
        for k, v in list(self.taken.iterator()):
            left = [(item, int(at)) for item, at in zip(v[0], v[1], strict=True) if at >= passed]
            if not left:
                self.taken.removeKey(k)
            elif len(left) < len(v[0]):
                self.taken.updateValue(k, ([x[0] for x in left], [x[1] for x in left]))

    def _watch(self, before: int, now: int) -> None:
        """One timer for each tree with waiting items, at the time its oldest one gets too old."""
        if before != now:
            if before >= 0:
                self.handle.deleteTimer(before + self.age_ms)
            if now >= 0:
                self.handle.registerTimer(now + self.age_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        figures = self._figures()
        sealed = [self._seal(key[0], self._waiting(), figures, True)] if figures[2] >= 0 else []
        self.waiting.clear()
        self.figures.update(tuple(figures))
        yield pd.DataFrame(sealed, columns=_COLUMNS)

    def close(self) -> None:
        pass


def sealed_stream(items: DataFrame, gate: int, age_ms: int, late: str = "0 seconds") -> DataFrame:
    """Sealed nodes of a stream of (tree, item, tokens, at). late: how far behind an item may come; what comes behind the watermark is dropped. Null trees and items are left out."""
    rows = items.where("tree is not null and item is not null and at is not null").withWatermark("at", late)
    keyed = rows.select("tree", F.col("item").cast("string").alias("item"), F.col("tokens").cast("long").alias("tokens"), F.unix_millis("at").alias("at_ms"), "at").groupBy("tree")
    return keyed.transformWithStateInPandas(SealBuffers(gate, age_ms), SEALED, "Append", "EventTime")


def run_seals(items: DataFrame, gate: int, age_ms: int, late: str = "0 seconds", place: str | None = None) -> str:
    """Runs over what the stream has now, and returns where the sealed nodes are; called again with the same place it goes on. Each batch writes its own folder, so one that is run again replaces it."""
    spark = items.sparkSession
    place = place or f"{shared_dir(spark)}/seals-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/nodes/batch={epoch}")

    run = sealed_stream(items, gate, age_ms, late).writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return place
