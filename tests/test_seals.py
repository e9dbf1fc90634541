"""Buffers as a stateful stream: gates, replays, late batches, flushes by age."""

import datetime as dt
from unittest.mock import MagicMock

import pandas as pd
import pytest

from lodestack.streaming.seals import SHARES, SealBuffers, run_seals

SCHEMA = "tree string, item string, tokens long, at timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


@pytest.fixture
def stream(spark, tmp_path):
    def put(rows):
        at = lambda s: START + dt.timedelta(seconds=s)
        spark.createDataFrame([(t, i, n, at(s)) for t, i, n, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    return put


def sealed(spark, place):
    return sorted((r.tree, r.node, list(r["items"]), r.tokens, r.forced) for r in spark.read.parquet(f"{place}/nodes").collect())


def test_gate_replay_and_late_batch(spark, stream, tmp_path):
    place = f"file://{tmp_path}/out"
    first = [("a", "1", 40, 0), ("a", "2", 40, 1), ("a", "3", 40, 2), ("a", "4", 10, 3), ("b", "x", 500, 0), (None, "y", 500, 0), ("a", None, 500, 0)]
    run_seals(stream(first), 100, 10**9, "1 hour", place)
    want = [("a", 0, ["1", "2", "3"], 120, False), ("b", 0, ["x"], 500, False)]
    assert sealed(spark, place) == want
    run_seals(stream(first), 100, 10**9, "1 hour", place)  # the same items again
    assert sealed(spark, place) == want
    run_seals(stream([("a", "late", 50, -60), ("a", "2", 40, 1), ("a", "5", 45, 5), ("a", "6", 7, 6)]), 100, 10**9, "1 hour", place)
    assert sealed(spark, place) == [want[0], ("a", 1, ["late", "4", "5"], 105, False), want[1]]


def test_flush_by_age(spark, stream, tmp_path):
    place = f"file://{tmp_path}/out"
    run_seals(stream([("a", "1", 10, 0), ("a", "2", 10, 30)]), 100, 60_000, "0 seconds", place)
    assert sealed(spark, place) == []
    run_seals(stream([("b", "x", 10, 61)]), 100, 60_000, "0 seconds", place)
    run_seals(stream([("b", "y", 1, 62)]), 100, 60_000, "0 seconds", place)
    assert sealed(spark, place) == [("a", 0, ["1", "2"], 20, True)]
    run_seals(stream([("a", "3", 10, 63), ("b", "z", 10, 200)]), 100, 60_000, "0 seconds", place)
    run_seals(stream([("b", "w", 1, 201)]), 100, 60_000, "0 seconds", place)
    got = sealed(spark, place)
    assert ("a", 1, ["3"], 10, True) in got and all(x[3] < 100 and x[4] for x in got)


def test_state_is_not_asked_for_every_item():
    """20,000 items ask for their shares of the taken ids and little else, not thrice an item."""
    handle, buffers, timers = MagicMock(), SealBuffers(1_000, 10**13), MagicMock()
    for state in (handle.getListState.return_value, handle.getValueState.return_value):
        state.exists.return_value = False
    handle.getMapState.return_value.containsKey.return_value = False
    timers.getCurrentWatermarkInMs.return_value = 0
    buffers.init(handle)
    came = pd.DataFrame({"item": [str(i) for i in range(20_000)], "tokens": 1, "at_ms": range(20_000), "tree": "a"})
    (sealed,) = buffers.handleInputRows(("a",), iter([came[:7_000], came[7_000:], came[:50]]), timers)
    assert len(sealed) == 20 and [x for row in sealed["items"] for x in row] == list(came["item"])
    assert len(handle.mock_calls) < 2 * SHARES + 20
