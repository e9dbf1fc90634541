"""Restarting batches against a plain loop, and the cascade over them."""

import numpy as np
import pytest

from lodestack.operators import batches, trees


def loop(sizes, budget, most, reach):
    out, held, total, batch = [], 0, 0, 0
    for x in sizes:
        x = max(x or 0, 0)
        if not reach and held and (total + x > budget or (most and held >= most)):
            held, total, batch = 0, 0, batch + 1
        held, total = held + 1, total + x
        out.append(batch)
        if reach and total >= budget:
            held, total, batch = 0, 0, batch + 1
    return out


@pytest.mark.parametrize(("block", "most", "reach"), [(32, None, False), (4096, 32, False), (32, None, True)])
def test_batches_equal_a_loop(spark, monkeypatch, block, most, reach):
    monkeypatch.setattr(batches, "BLOCK", block)
    rng = np.random.default_rng(block)
    sizes = {k: rng.integers(0, high, n).tolist() for k, (high, n) in {"a": (90, 300), "b": (300, 70), "c": (2, 400), "one": (5, 1)}.items()}
    sizes |= {None: [45] * 30, "zeros": [0] * 50 + [1000, None, -5, 3], "over": [1000, 1, 1000]}
    rows = spark.createDataFrame([(k, i, x) for k, v in sizes.items() for i, x in enumerate(v)], "key string, seq long, size long").repartition(5)
    got = {}
    for r in batches.restarting(rows, "key", ["seq"], "size", 100, most, reach).collect():
        got.setdefault(r.key, []).append((r.seq, r.batch, r.full))
    assert {k: [b for _, b, _ in sorted(v)] for k, v in got.items()} == {k: loop(v, 100, most, reach) for k, v in sizes.items()}
    for k, v in got.items():
        last = max(b for _, b, _ in v)
        total = sum(max(x or 0, 0) for x, (_, b, _) in zip(sizes[k], sorted(v), strict=True) if b == last)
        assert all(full == (b < last or (reach and total >= 100)) for _, b, full in v)
    assert batches.restarting(rows.limit(0), "key", ["seq"], "size", 100).count() == 0
    with pytest.raises(ValueError, match="1 or more"):
        batches.restarting(rows, "key", ["seq"], "size", 0)


def test_cascade_starts_anew_after_each_seal(spark):
    leaves = spark.createDataFrame([("t", i, 45, i) for i in range(7)] + [("u", 0, 500, 9)], "tree string, seq long, tokens long, at_ms long")
    got = sorted(tuple(r) for r in trees.seal_cascade(leaves, fan_in=3, tokens=50).collect())
    assert got == [("t", 1, 0, 2, 90, 0, 1), ("t", 1, 1, 2, 90, 2, 3), ("t", 1, 2, 2, 90, 4, 5), ("t", 2, 0, 3, 270, 0, 5), ("u", 1, 0, 1, 500, 9, 9)]


def test_walk_of_a_cycle_ends(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert sorted((r.node, r.depth) for r in trees.descend(roots, links).collect()) == [("b", 1), ("c", 2), ("d", 1)]
    assert trees.descend(roots.limit(0), links).count() == 0


NODES = "id string, scope string, parent_id string, start_ms long, end_ms long, doc_id string, version_ms long"


def test_losing_versions(spark):
    nodes = spark.createDataFrame([
        ("a1", "s", None, 0, 1, "A", 100), ("a2", "s", None, 2, 3, "A", 200), ("a1.low", "s", "a1", 0, 0, None, None), ("chat", "s", "root", 0, 9, None, None),
        ("b2", "s", None, 0, 1, "B", 300), ("b1", "s", None, 0, 1, "B", 300), ("n", "s", None, 4, 4, "N", None),
    ], NODES)
    links = spark.createDataFrame([("a1", "a1.low"), ("a1.low", "old"), ("a2", "new"), ("chat", "said"), ("b1", "x"), ("b2", "y"), ("n", "z")], "parent string, child string")
    gone, hidden = trees.losing_versions(nodes, links)
    assert sorted(r.id for r in gone.collect()) == ["a1", "a1.low", "b2"] and sorted(r.id for r in hidden.collect()) == ["old", "y"]
    leaves = spark.createDataFrame([(k, "s", i) for i, k in enumerate(["old", "new", "said", "x", "y", "z", "loose"])], "id string, scope string, timestamp_ms long")
    cover = [r.id for r in trees.window_cover(leaves, nodes, links, 0, 9).collect()]
    assert sorted(cover) == ["a2", "b1", "chat", "loose", "n"]
    # a window without the newer version keeps the older one; the newer one's leaf is a leaf there
    assert [r.id for r in trees.window_cover(leaves, nodes, links, 0, 1).collect()] == ["a1", "b1", "new"]
