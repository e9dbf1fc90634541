import hashlib

from pyspark.sql import functions as F

from lodestack.functions import score as S
from lodestack.functions import text as T
from lodestack.operators import graph, retrieval
from lodestack.plans import catalogue


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.chars_tokens(F.col("t")), t="é" * 5) == 2
    assert one(spark, T.bytes_tokens(F.col("t")), t="é" * 5) == 3
    assert one(spark, T.conservative_tokens(F.col("t")), t="ab c!") == 3  # 2+2+1+2+4 quarters


def test_chunk_id_layout(spark):
    want = hashlib.sha256(b"chat\0s1\0" + (7).to_bytes(4, "big") + b"\0hey").hexdigest()[:32]
    assert one(spark, T.chunk_id(F.lit("chat"), F.lit("s1"), F.lit(7), F.lit("hey"))) == want


def test_ids_and_slugs(spark):
    assert one(spark, T.canonical_id(F.lit("handle"), F.lit("@Bob"))) == "handle:bob"
    assert one(spark, T.canonical_id(F.lit("url"), F.lit("http://X.y/Z"))) == "url:http://X.y/Z"
    assert one(spark, T.slug(F.lit("--A  b__C!"))) == "a-b_c"


def test_times(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, T.flexible_time(F.lit("1700000000000"), now)).year == 2023
    assert one(spark, T.flexible_time(F.lit("1700000000"), now)) is None
    assert one(spark, T.flexible_time(F.lit(None).cast("string"), now)).year == 2024
    assert [one(spark, T.backoff(F.lit(k))) for k in (1, 2, 30)] == [60_000, 120_000, 3_600_000]
    assert one(spark, T.age_label(F.lit(31))) == "recent"


def test_scores(spark):
    assert one(spark, S.freshness(F.lit(7.0))) == 0.5
    assert one(spark, S.freshness(F.lit(-1.0))) == 1.0
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, S.lexical_score("a b a", F.lit("xa"))) == 2 / 3
    assert one(spark, S.lexical_score("q", F.lit("xa"))) is None
    assert one(spark, S.keyword_relevance(F.lit("a a b"), F.lit("A"))) == 0.5
    assert [round(one(spark, S.token_ramp(F.lit(n))), 3) for n in (9, 20, 30, 3000, 5500, 9000)] == [0, 0.5, 1, 1, 0.75, 0.5]


def test_bfs_hops(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "a string, b string, weight long")
    targets = spark.createDataFrame([("a",), ("c",)], "entity string")
    assert graph.bfs_pairs(edges, targets, 1).count() == 0
    assert [tuple(r) for r in graph.bfs_pairs(edges, targets, 2).collect()] == [("a", "c", 2)]


def test_walks_meet_halfway(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n0", "n0")], "a string, b string")
    targets = spark.createDataFrame([(f"n{i}",) for i in range(6, -1, -1)] + [(None,), ("alone",)], "entity string")
    for hops in (1, 2, 3, 4):
        want = [(f"n{i}", f"n{k}", k - i) for i in range(7) for k in range(i + 1, min(i + hops, 6) + 1)]
        assert sorted(map(tuple, graph.bfs_pairs(chain, targets, hops).collect())) == want


def test_hub_beyond_the_last_hop_is_not_listed(spark, monkeypatch):
    """Targets at both ends of two steps: the second step's neighbours, far more than the targets, are never walked to."""
    held = spark.createDataFrame([("s", "x"), ("mid", "x"), ("mid", "y"), ("t", "y")] + [(f"far{i}", "y") for i in range(50)], "entity string, node string")
    fronts, kept = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: fronts.append((name, (out := kept(df, name)).count())) or out)
    targets = spark.createDataFrame([("s",), ("t",)], "entity string")
    assert [tuple(r) for r in graph.shared_node_pairs(held, targets, 2).collect()] == [("s", "t", 2)]
    assert fronts == [("targets", 2), ("front", 1 + 51)]


def test_pairs_are_dealt_out_by_the_lines(spark, tmp_path, monkeypatch):
    """More lines, more tasks: a fixed number of them would have to hold ever more pairs each."""
    lines = spark.range(40).selectExpr("id div 4 AS l_orderkey", "id % 7 AS l_suppkey", "id AS l_partkey", "timestamp_millis(id) AS l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(catalogue, "PAIRED_ROWS", 4)
    for name in ("edges_distinct", "weight_groups"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 10
    held = [(f"organization:{i % 7}", i // 4) for i in range(40)]
    want = {(a, b) for a, n in held for b, m in held if n == m and a < b}
    assert {(r.a, r.b) for r in catalogue.QUERIES["edges_distinct"](spark, str(tmp_path)).collect()} == want
