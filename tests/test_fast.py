"""Each branch of graph-aware retrieval on a hand-made graph."""

import pytest

from lodestack.operators import fast, graph

NODES = "id string, kind string, scope string, entities array<string>, start_ms long, end_ms long, embedding array<float>, deleted boolean"


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame([
        ("both", "leaf", "in", ["alice", "launch"], 10, 10, None, False), ("all", "summary", "in", ["alice", "launch", "bob"], 5, 5, [1.0, 0.0], False),
        ("out", "summary", "off", ["alice", "launch"], 90, 90, [1.0, 0.0], False), ("near", "summary", "in", [], 20, 20, [0.9, 0.1], False), ("plain", "summary", "in", ["bob"], 30, 30, None, False),
        ("odd", "summary", "in", ["carol"], 40, 40, [1.0, 0.0, 0.0], False), ("gone", "summary", "in", ["alice"], 50, 50, [1.0, 0.0], True),
    ], NODES)


@pytest.fixture
def held(spark):
    rows = [("alice", "both", 10), ("launch", "both", 11), ("alice", "all", 5), ("launch", "all", 5), ("bob", "all", 5), ("alice", "out", 90), ("launch", "out", 90), ("alice", "lost", 99), ("launch", "lost", 99), ("carol", "odd", 40)]
    return spark.createDataFrame(rows, "entity string, node string, ts_ms long")


def ask(nodes, held, asked, query="q", **more):
    rows = fast.fast_retrieve(query, asked, [1.0, 0.0], held, nodes, **more).collect()
    return [r.node for r in sorted(rows, key=lambda r: r["rank"])], rows


def test_blank_query(nodes, held):
    assert ask(nodes, held, ["alice"], query=" \n")[0] == []


def test_local_branch(nodes, held):
    names, rows = ask(nodes, held, ["alice", "launch", "bob", "alice"])
    assert names == ["all", "out", "both"] and {r.node: (r.score, r.total, r.branch) for r in rows}["all"] == (3.0, 3, "local")
    # the scope comes before the limit; a node that is not known is no hit
    names, rows = ask(nodes, held, ["alice", "launch"], scopes=["in"], limit=1)
    assert names == ["both"] and rows[0].total == 2


def test_dense_branch(nodes, held):
    names, rows = ask(nodes, held, [], scopes=["in"])
    assert names == ["all", "near", "odd", "plain"] and {r.branch for r in rows} == {"dense"}
    names, rows = ask(nodes, held, [], limit=1, window=(15, 95), scopes=["in"])
    assert names == ["near"] and rows[0].total == 3
    assert ask(nodes, held, [])[0][:2] == ["out", "all"]  # of equal cosines the later


def test_occurrence_branch(nodes, held):
    names, rows = ask(nodes, held, ["bob", "carol"], limit=3, max_hops=1)  # they share no node
    assert names == ["all", "odd", "plain"] and {(r.total, r.branch) for r in rows} == {(5, "occurrence")}
    assert ask(nodes, held, ["alice"], limit=2)[0] == ["out", "all"]
    assert ask(nodes, held, ["nobody", "none"], limit=1)[0] == ["out"]


def test_steps_shrink_until_candidates_fit(spark, nodes, held):
    edges = spark.createDataFrame([("alice", "mid"), ("mid", "launch"), ("alice", "bob")], "a string, b string")
    # two steps: alice and launch share four nodes, alice and bob one of these; one step: only the latter is left
    names, rows = ask(nodes, held, ["alice", "launch", "bob"], edges=edges, limit=2)
    assert names == ["all"] and rows[0].score == 2.0
    assert len(ask(nodes, held, ["alice", "launch", "bob"], edges=edges, limit=9)[0]) == 3
    assert fast.fitting_hops({2: 5}, 2, 2) == 2 and fast.fitting_hops({1: 5, 3: 1}, 2, 3) == 1 and fast.fitting_hops({1: 1, 2: 1}, 2, 4) == 4


def test_newest_occurrences_only(spark):
    held = spark.createDataFrame([("a", f"n{i}", i) for i in range(6)] + [("b", f"n{i}", i) for i in range(0, 6, 2)], "entity string, node string, ts_ms long")
    pairs = spark.createDataFrame([("a", "b", 1)], "a string, b string, distance int")
    assert sorted((r.node, r.ts_ms) for r in fast.pair_candidates(held, pairs, newest=3).collect()) == [("n4", 4)]


def test_pairs_through_nodes_equal_those_over_edges(spark, held):
    targets = spark.createDataFrame([(x,) for x in ("alice", "bob", "carol", "launch")], "entity string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    for hops in (1, 2):
        assert plain(graph.shared_node_pairs(held, targets, hops)) == plain(graph.bfs_pairs(graph.edges(held), targets, hops)) == [("alice", "bob", 1), ("alice", "launch", 1), ("bob", "launch", 1)]


def test_no_stand_in_where_only_shared_nodes_are_asked_for(nodes, held):
    assert ask(nodes, held, ["alice", "carol"])[1][0].branch == "occurrence"
    assert ask(nodes, held, ["alice", "carol"], instead=False)[0] == []
    assert len(ask(nodes, held, ["alice", "launch"], instead=False)[0]) == 3


def test_all_shared_nodes_count_however_many_an_entity_has(spark):
    """only an entity's newest 500 occurrences were looked at, so older shared nodes were dropped."""
    rows = [("alice", f"n{i:04}", i) for i in range(1200)] + [("launch", f"n{i:04}", i) for i in range(600)]
    held = spark.createDataFrame(rows, "entity string, node string, ts_ms long")
    nodes = spark.createDataFrame([(f"n{i:04}", "leaf", "in", ["alice"], i, i, None, False) for i in range(1200)], NODES)
    names, found = ask(nodes, held, ["alice", "launch"], limit=2, instead=False)
    assert names == ["n0599", "n0598"] and {r.total for r in found} == {600}
