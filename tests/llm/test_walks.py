"""Graph walks that no scan stands in for: sparse links in a whole shard, and what the audit says."""

import numpy as np

from lodestack.llm import hnsw


def links_of(index, queries):
    return set(zip(*map(np.ndarray.tolist, np.nonzero(queries @ index.T >= 0.98)), strict=True))


def test_sparse_links_are_walked_to(monkeypatch):
    rng = np.random.default_rng(8)
    v = hnsw.unit(rng.normal(size=(4_096, 64)))
    side = hnsw.unit(rng.normal(size=(100, 64)))
    at = rng.permutation(4_096)
    v[at[100:200]] = hnsw.unit(v[at[:100]] + 0.15 * side)  # cosines of about 0.989
    levels = hnsw.build(v.astype(np.float32))
    scanned, walked, walk = [], [], hnsw._walk

    def counted(low, levels, q32, todo, beam, least):
        (scanned if beam >= len(low) else walked).append(len(todo))
        return walk(low, levels, q32, todo, beam, least)

    beam = hnsw.audited_beam(v, levels, 0.98)
    assert beam[0] < 256 and beam[1] >= 0.999
    monkeypatch.setattr(hnsw, "_walk", counted)
    r, c, recall = hnsw.range_search(v, levels, v, 0.98, True, beam)
    assert set(zip(r.tolist(), c.tolist(), strict=True)) == links_of(v, v) and len(r) >= 4_096 + 190
    assert sum(scanned) == hnsw.AUDIT_QUERIES and sum(walked) >= 4_096 and recall >= 0.999


def test_a_missed_link_widens_the_beam():
    rng = np.random.default_rng(9)
    v = hnsw.unit(rng.normal(size=(600, 16)))
    levels = [np.full((600, 32), -1, np.int64)]  # a graph without links: no walk gets anywhere
    assert hnsw.audited_beam(v, levels, 0.98) == (600, 1.0)
    r, c, recall = hnsw.range_search(v, levels, v, 0.98, False, (32, 0.5))
    assert set(zip(r.tolist(), c.tolist(), strict=True)) == links_of(v, v) and recall == 0.5


def test_double_vectors_and_odd_rows(spark):
    near = [1.0, 0.2, 1e-12]
    rows = [(1, [1.0, 0.2, 0.0], "a"), (2, near, "a"), (3, near, None), (4, None, "a"), (5, [], "a"), (6, [0.0] * 3, "a"), (7, [float("inf"), 1.0, 0.0], "a"), (8, [1.0, 0.2], "a"), (1, [1.0, 0.2, 0.0], "a"), (None, near, "a")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label string, n_links int, key string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in hnsw.embedding_groups(d).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *[(k, 0, k, True) for k in range(3, 9)]]
    assert hnsw.embedding_groups(d.limit(0)).count() == 0
