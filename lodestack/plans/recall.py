"""Queries over graph-aware retrieval and versions of documents. Registered with those of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestack.operators import fast, trees
from lodestack.operators.ngram_index import MessageIndex
from lodestack.plans.catalogue import OCC, query
from lodestack.sources.adapters import occurrences, table
from lodestack.sources.engine import LINKS, memory_chunks, summaries, tree_links
from lodestack.sources.staging import shared_dir
from lodestack.streaming.buffers import event_stream
from lodestack.streaming.seals import run_seals

#: Orders as nodes of the memory: every third a leaf, the others summaries, scoped by priority, with the vector of the same number.
NODES = f"""{OCC}, held AS (SELECT node, list(entity ORDER BY entity) AS entities FROM occ GROUP BY node),
nodes AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'leaf' ELSE 'summary' END AS kind, o_orderpriority AS scope, entities, epoch_us(o_orderdate) // 1000 AS end_ms, embedding, o_orderstatus = 'P' AS deleted
  FROM orders LEFT JOIN held ON node = o_orderkey LEFT JOIN embeddings ON vec_id = o_orderkey)"""
SCOPES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
ASKED = ["organization:1", "organization:2", "organization:3", "organization:4"]
SINCE, UNTIL = 1_700_000_600_000, 1_700_030_000_000


def _nodes(spark, sf):
    held = occurrences(spark, sf).groupBy("node").agg(F.array_sort(F.collect_list("entity")).alias("entities"))  # an order's suppliers, a few
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "leaf").otherwise("summary").alias("kind"), F.col("o_orderpriority").alias("scope"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("end_ms"), (F.col("o_orderstatus") == "P").alias("deleted"))
    return o.withColumn("start_ms", F.col("end_ms")).join(held.withColumnRenamed("node", "id"), "id", "left").join(vectors, "id", "left")


def _question(spark, sf):
    """The first vector, as a question that was embedded."""
    return [float(x) for x in table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


_LIVE = "SELECT id, scope, entities, end_ms, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings ORDER BY vec_id LIMIT 1)), 9) AS score FROM nodes WHERE kind = 'summary' AND NOT deleted"
_FIRST = "score DESC NULLS LAST, CASE WHEN score IS NOT NULL THEN end_ms END DESC, scope, id"


@query(f"""WITH {NODES}, own AS (SELECT entity, node, ts_ms FROM occ WHERE entity IN {tuple(ASKED)}),
pairs AS (SELECT x.node, x.entity AS a, y.entity AS b, greatest(x.ts_ms, y.ts_ms) AS ts_ms FROM own x JOIN own y ON x.node = y.node AND x.entity < y.entity),
near AS (SELECT node, len(list_distinct(list_concat(list(a), list(b))))::DOUBLE AS score, max(ts_ms) AS latest_ms FROM pairs GROUP BY node),
hits AS (SELECT n.node, scope, score, row_number() OVER (ORDER BY score DESC, latest_ms DESC, n.node)::INT AS rank, count(*) OVER () AS total FROM near n JOIN nodes ON id = n.node WHERE scope IN {tuple(SCOPES)})
SELECT node::VARCHAR AS node, scope, score, rank, total, 'local' AS branch FROM hits WHERE rank <= 25""")
def retrieve_local(spark, sf):
    """Orders that asked suppliers share, of three scopes; none where they share none."""
    got = fast.fast_retrieve("who supplied this", ASKED, _question(spark, sf), occurrences(spark, sf), _nodes(spark, sf), scopes=SCOPES, limit=25, instead=False)
    return got.withColumn("node", F.col("node").cast("string"))


@query(f"""WITH {NODES}, live AS ({_LIVE}), r AS (SELECT *, row_number() OVER (ORDER BY {_FIRST}) AS k, count(*) OVER () AS total FROM live),
hits AS (SELECT *, row_number() OVER (ORDER BY len(list_intersect(coalesce(entities, []), ['organization:1'])) DESC, k)::INT AS rank FROM r WHERE k <= 20)
SELECT id::VARCHAR AS node, scope, score, rank, total, 'occurrence' AS branch FROM hits WHERE rank <= 10""")
def retrieve_occurrence(spark, sf):
    """One asked supplier makes no pair: like nodes, those first that hold it."""
    got = fast.fast_retrieve("about one supplier", ["organization:1"], _question(spark, sf), occurrences(spark, sf), _nodes(spark, sf))
    return got.withColumn("node", F.col("node").cast("string"))


@query(f"""WITH {NODES}, live AS ({_LIVE} AND scope IN {tuple(SCOPES)} AND end_ms BETWEEN 700000000000 AND 850000000000), r AS (SELECT *, row_number() OVER (ORDER BY {_FIRST})::INT AS rank, count(*) OVER () AS total FROM live)
SELECT id::VARCHAR AS node, scope, score, rank, total, 'dense' AS branch FROM r WHERE rank <= 100""")
def retrieve_dense(spark, sf):
    """No entity: like nodes of three scopes and a window."""
    got = fast.fast_retrieve("anything", [], _question(spark, sf), occurrences(spark, sf), _nodes(spark, sf), scopes=SCOPES, limit=500, window=(700_000_000_000, 850_000_000_000))
    return got.withColumn("node", F.col("node").cast("string"))


@query(f"""WITH RECURSIVE {LINKS}, v AS (SELECT *, CASE WHEN level = 1 THEN 'doc:' || scope || ':' || split_part(id, ':', 3)::BIGINT // 3 END AS doc_id, n_children AS version FROM sums WHERE NOT deleted AND start_ms >= {SINCE} AND end_ms <= {UNTIL}),
lose AS (SELECT id FROM v WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, id) > 1),
down(root, node) AS (SELECT id, id FROM sums UNION SELECT root, child FROM down JOIN links ON node = parent),
gone AS (SELECT node FROM down WHERE root IN (SELECT id FROM lose)), fits AS (SELECT * FROM v WHERE id NOT IN (SELECT node FROM gone)),
best AS (SELECT * FROM fits WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM fits)), seen AS (SELECT node FROM down WHERE root IN (SELECT id FROM best))
SELECT scope, id, 'summary' AS kind, start_ms FROM best UNION ALL
SELECT scope, id, 'leaf', timestamp_ms FROM mem WHERE status <> 'dropped' AND timestamp_ms BETWEEN {SINCE} AND {UNTIL} AND id NOT IN (SELECT node FROM gone) AND id NOT IN (SELECT node FROM seen) ORDER BY scope, start_ms, id LIMIT 200""")
def cover_latest_versions(spark, sf):
    """A window's cover where summaries of level 1 are versions of documents, three each: only the fullest stays, and leaves of the others don't come back."""
    s = summaries(spark, sf).where("not deleted")
    bucket = F.split("id", ":")[2].cast("long")
    s = s.withColumn("doc_id", F.when(F.col("level") == 1, F.concat(F.lit("doc:"), "scope", F.lit(":"), F.floor(bucket / 3)))).withColumn("version_ms", F.col("n_children"))
    leaves = memory_chunks(spark, sf).where("status <> 'dropped'")
    return trees.window_cover(leaves, s, tree_links(spark, sf), SINCE, UNTIL)


@query("""WITH m AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS at_ms, replace(strip_accents(lower(text)), 'ß', 'ss') AS f FROM conversations),
s AS (SELECT *, (contains(f, 'tion')::INT + contains(f, 'wher')::INT + contains(f, 'uber')::INT) AS matched FROM m WHERE conv_id <> 1)
SELECT conv_id::VARCHAR AS thread, turn::VARCHAR AS message, role, sha256(text) AS content_sha256, at_ms, matched / 3 AS score FROM s WHERE matched > 0 ORDER BY score DESC, at_ms DESC, thread, message LIMIT 100""")
def indexed_search(spark, sf):
    """Messages put into an index in two inserts that overlap, and a search in all threads but one."""
    index = MessageIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    c = table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("message"), "role", F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at_ms"))
    index.insert(rows.where("message < 3"))
    index.insert(rows)
    found = index.search("TION wher über", 100, without="1")
    return found.select("thread", "message", "role", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), "at_ms", "score")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS tree, floor(value)::BIGINT AS tokens, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id::VARCHAR) AS k FROM events),
r AS (SELECT tree, k, tokens, at_ms, tokens AS acc, 0::BIGINT AS node FROM e WHERE k = 1 UNION ALL
  SELECT e.tree, e.k, e.tokens, e.at_ms, CASE WHEN r.acc >= 2000 THEN 0 ELSE r.acc END + e.tokens, r.node + (r.acc >= 2000)::INT FROM r JOIN e ON e.tree = r.tree AND e.k = r.k + 1)
SELECT tree, node, count(*)::INT AS n_items, sum(tokens)::BIGINT AS tokens, min(at_ms) AS start_ms, max(at_ms) AS end_ms FROM r GROUP BY tree, node HAVING sum(tokens) >= 2000""")
def sealed_events(spark, sf):
    """Events as a stream: buffers by type, sealed when they reach 2,000."""
    e = event_stream(spark, sf).select(F.col("event_type").alias("tree"), F.col("event_id").cast("string").alias("item"), F.floor("value").alias("tokens"), F.col("ts").alias("at"))
    nodes = spark.read.parquet(f"{run_seals(e, 2_000, 10**13)}/nodes")
    return nodes.select("tree", "node", F.size("items").alias("n_items"), "tokens", "start_ms", "end_ms")
