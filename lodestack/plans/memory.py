"""Queries over the memory engine's tables: lookups, trees, retrieval, ingest, safety. Registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lodestack.functions import mail, safety
from lodestack.functions import text as T
from lodestack.operators import trees
from lodestack.plans.catalogue import query
from lodestack.sources.adapters import table
from lodestack.sources.engine import LINKS, MEM, SUMS, memory_chunks, summaries, tree_links

SINCE, UNTIL = 1_700_000_600_000, 1_700_007_800_000
#: Platforms by the kind of source they belong to.
PLATFORM_KINDS = {"slack": "chat", "discord": "chat", "telegram": "chat", "gmail": "email", "outlook": "email", "notion": "document", "github": "document", "drive": "document"}


#: Patterns of entities, in order of priority.
ENTITY_PATTERNS = {
    "email": rf"({T.EMAIL})",
    "url": rf"({T.URL})",
    "handle": r"(?:^|[^A-Za-z0-9_@.])(@[A-Za-z0-9_]{2,32})\b",
    "discord": r"\b([A-Za-z0-9_.]{2,32}#[0-9]{4})\b",
    "hashtag": r"(?:^|[^A-Za-z0-9_#&/])(#[A-Za-z][A-Za-z0-9_]{1,63})\b",
}
#: What each holds at least, and the same patterns that begin with it, so that other places are passed over quickly.
ENTITY_SIGNS = {"email": "@", "url": "://", "handle": "@", "discord": "#", "hashtag": "#"}
ENTITY_FORMS = {"handle": r"(@(?<![A-Za-z0-9_@.]@)[A-Za-z0-9_]{2,32})\b", "hashtag": r"(#(?<![A-Za-z0-9_#&/]#)[A-Za-z][A-Za-z0-9_]{1,63})\b"}


def clamped(limit: int | None, default: int = 100, most: int = 10_000) -> int:
    """1 to most; the default where none is given."""
    return default if limit is None else max(1, min(limit, most))


def response_limit(limit: int) -> int | None:
    """0: ten; the greatest number: no limit; else a hundred at most."""
    return 10 if limit == 0 else None if limit >= 2**63 - 1 else min(limit, 100)


def _leaves(spark, sf):
    return memory_chunks(spark, sf).where("status <> 'dropped'")


# lookups


@query(f"WITH {MEM} SELECT id, source_id, status, token_count, timestamp_ms FROM mem WHERE id = 'c7'")
def chunk_by_id(spark, sf):
    return memory_chunks(spark, sf).where("id = 'c7'").select("id", "source_id", "status", "token_count", "timestamp_ms")


@query(f"WITH {SUMS} SELECT id, level, start_ms, end_ms FROM sums WHERE tree_id = 't:src1' AND level = 1 AND NOT deleted")
def live_summaries_at_level(spark, sf):
    return summaries(spark, sf).where("tree_id = 't:src1' and level = 1 and not deleted").select("id", "level", "start_ms", "end_ms")


@query(f"WITH {SUMS} SELECT id, tokens, n_children FROM sums WHERE id IN ('s1:src1:0', 's1:src1:1', 's2:src2:0', 'none')")
def summaries_by_ids(spark, sf):
    asked = spark.createDataFrame([(k,) for k in ("s1:src1:0", "s1:src1:1", "s2:src2:0", "none")], "id string")
    return summaries(spark, sf).join(F.broadcast(asked), "id", "left_semi").select("id", "tokens", "n_children")


@query(f"WITH {LINKS} SELECT parent, child FROM links WHERE parent = 's2:src1:0'")
def children_of_summary(spark, sf):
    return tree_links(spark, sf).where("parent = 's2:src1:0'")


@query(f"WITH {SUMS} SELECT tree_id, scope, max(level) AS max_level, min(start_ms) AS created_ms FROM sums GROUP BY 1, 2 ORDER BY created_ms, tree_id")
def trees_of_a_kind(spark, sf):
    return summaries(spark, sf).groupBy("tree_id", "scope").agg(F.max("level").alias("max_level"), F.min("start_ms").alias("created_ms")).orderBy("created_ms", "tree_id")


@query(f"WITH {MEM} SELECT scope, count(*) AS n_items, sum(token_count)::BIGINT AS tokens, min(timestamp_ms) AS oldest_ms FROM mem WHERE status = 'buffered' GROUP BY scope HAVING 1700010000000 - min(timestamp_ms) > 3600000")
def stale_buffers(spark, sf):
    """Buffers whose oldest item is over an hour old; exactly an hour is not."""
    b = memory_chunks(spark, sf).where("status = 'buffered'").groupBy("scope").agg(F.count("*").alias("n_items"), F.sum("token_count").alias("tokens"), F.min("timestamp_ms").alias("oldest_ms"))
    return b.where(F.lit(1_700_010_000_000) - F.col("oldest_ms") > 3_600_000)


@query(f"""WITH {MEM} SELECT id, list_transform(json_extract(refs, '$[*].path'), lambda x: json_extract_string(x, '$')) AS paths FROM (
  SELECT id, CASE WHEN doc_id % 4 = 0 THEN '[{{"path":"raw/' || scope || '/' || doc_id || '.md","start":0}},{{"path":"raw/shared.md","start":' || doc_id || '}}]' END AS refs FROM mem) WHERE refs IS NOT NULL""")
def raw_refs(spark, sf):
    """Paths in a chunk's references, from JSON; none and empty lists give no row."""
    refs = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('[{"path":"raw/'), "scope", F.lit("/"), "doc_id", F.lit('.md","start":0},{"path":"raw/shared.md","start":'), "doc_id", F.lit("}]")))
    read = memory_chunks(spark, sf).select("id", F.from_json(refs, "array<struct<path:string,start:long>>").alias("refs"))
    return read.where(F.size("refs") > 0).select("id", F.col("refs.path").alias("paths"))


@query(f"WITH {MEM} SELECT DISTINCT 'raw/' || scope || '/' || doc_id || '.md' AS path FROM mem WHERE doc_id % 4 = 0 AND scope = 'src4' UNION SELECT 'raw/shared.md' FROM mem WHERE doc_id % 4 = 0 AND scope = 'src4'")
def referenced_paths(spark, sf):
    c = memory_chunks(spark, sf).where("doc_id % 4 = 0 and scope = 'src4'")
    return c.select(F.explode(F.array(F.concat(F.lit("raw/"), "scope", F.lit("/"), "doc_id", F.lit(".md")), F.lit("raw/shared.md"))).alias("path")).distinct()


@query(f"WITH {MEM} SELECT id, 'chunks/' || scope || '/' || id || '.md' AS content_path, sha256(content) AS content_sha256 FROM mem WHERE status = 'sealed'")
def content_pointers(spark, sf):
    c = memory_chunks(spark, sf).where("status = 'sealed'")
    return c.select("id", F.concat(F.lit("chunks/"), "scope", F.lit("/"), "id", F.lit(".md")).alias("content_path"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


@query(f"WITH {MEM} SELECT id, substr(content, 1, 240) AS preview, (SELECT count(*) FROM mem) AS n_chunks FROM mem ORDER BY timestamp_ms DESC, id LIMIT 50")
def chunk_view(spark, sf):
    """The newest chunks with a preview, and how many there are."""
    c = memory_chunks(spark, sf)
    return c.orderBy(F.desc("timestamp_ms"), "id").limit(50).crossJoin(c.agg(F.count("*").alias("n_chunks"))).select("id", F.substring("content", 1, 240).alias("preview"), "n_chunks")


@query("SELECT 'g:' || (user_id % 5) AS namespace, event_type AS key, max((epoch_us(ts) // 1000)) AS updated_ms FROM events WHERE user_id % 5 IN (1, 0) GROUP BY 1, 2 ORDER BY updated_ms DESC, namespace, key")
def namespace_and_global(spark, sf):
    """Keys of a namespace and the global ones, newest first."""
    e = table(spark, sf, "events").where("user_id % 5 in (1, 0)")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.groupBy(F.concat(F.lit("g:"), F.col("user_id") % 5).alias("namespace"), F.col("event_type").alias("key")).agg(F.max(at).alias("updated_ms")).orderBy(F.desc("updated_ms"), "namespace", "key")


# predicates


@query(f"WITH {MEM} SELECT id FROM mem WHERE doc_id % 2 = 1 OR scope IN ('src1', 'src3')")
def scope_allow_list(spark, sf):
    """Chunks of sources, here those with an even number, must be on the list; others pass."""
    tags = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("memory_sources"))).otherwise(F.array().cast("array<string>"))
    c = memory_chunks(spark, sf).withColumn("tags", tags)
    return c.where(~F.array_contains("tags", "memory_sources") | F.col("scope").isin("src1", "src3")).select("id")


@query(f"WITH {MEM} SELECT coalesce(path_scope, source_id) AS effective, count(*) AS n FROM mem GROUP BY 1")
def effective_scope(spark, sf):
    return memory_chunks(spark, sf).groupBy(F.coalesce("path_scope", "source_id").alias("effective")).agg(F.count("*").alias("n"))


@query(f"""WITH {MEM}, k AS (SELECT *, CASE WHEN scope = 'src1' THEN 'slack' WHEN scope = 'src2' THEN 'gmail' WHEN scope = 'src3' THEN 'chat' ELSE 'notion' END AS platform FROM mem)
SELECT platform, count(*) AS n FROM k WHERE platform IN ('chat', 'slack', 'discord', 'telegram') GROUP BY 1""")
def scopes_of_kind(spark, sf):
    """A scope is of a kind if it begins with it, or with a platform of that kind."""
    platform = F.when(F.col("scope") == "src1", "slack").when(F.col("scope") == "src2", "gmail").when(F.col("scope") == "src3", "chat").otherwise("notion")
    kinds = F.create_map(*[F.lit(x) for pair in PLATFORM_KINDS.items() for x in pair])
    c = memory_chunks(spark, sf).select(platform.alias("platform"))
    return c.where((F.col("platform") == "chat") | (F.try_element_at(kinds, "platform") == "chat")).groupBy("platform").agg(F.count("*").alias("n"))


@query(f"""WITH {MEM} SELECT id, len(list_filter(['time', 'and'], lambda t: contains(lower(content), t))) / 2.0 AS score FROM mem
WHERE lang = 'en' AND (scope = 'src1' OR scope = 'src2') AND (contains(lower(content), 'time') OR contains(lower(content), 'and')) ORDER BY score DESC, timestamp_ms DESC LIMIT 100""")
def recall_filtered(spark, sf):
    """Namespace and session filters, then the share of matched terms; an entry needs one at least."""
    hit = F.size(F.filter(F.array(F.lit("time"), F.lit("and")), lambda t: F.lower("content").contains(t))) / 2.0
    c = memory_chunks(spark, sf).where((F.col("lang") == "en") & F.col("scope").isin("src1", "src2")).withColumn("score", hit)
    return c.where("score > 0").orderBy(F.desc("score"), F.desc("timestamp_ms")).select("id", "score").limit(clamped(None))


@query("""SELECT user_id, max((epoch_us(ts) // 1000)) AS last_ms FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1 HAVING (user_id % 4) <> 0 AND 1800000000000 - max((epoch_us(ts) // 1000)) > (user_id % 4) * 1000""")
def due_sources(spark, sf):
    """Sources whose last success is longer ago than their interval; an interval of 0 is manual."""
    e = table(spark, sf, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    first = e.agg(F.min("event_type").alias("event_type"))
    last = e.join(F.broadcast(first), "event_type").groupBy("user_id").agg(F.max("at").alias("last_ms"))
    interval = (F.col("user_id") % 4) * 1000
    return last.where((interval > 0) & (F.lit(1_800_000_000_000) - F.col("last_ms") > interval))


@query("SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '\\{[^{}]*\\}', '', 'g') AS said FROM conversations WHERE role <> 'system'")
def conversation_cleaned(spark, sf):
    """Turns of tools (here: of the system) go, and JSON of calls in the others."""
    return table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), r"\{[^{}]*\}", "").alias("said"))


@query(f"WITH {SUMS} SELECT scope, level, sum(tokens)::BIGINT AS tokens, count(*) AS items, CASE WHEN level = 0 THEN sum(tokens) >= 50000 ELSE count(*) >= 10 END AS seals FROM (SELECT scope, 0 AS level, token_count AS tokens FROM mem WHERE status = 'buffered' UNION ALL SELECT scope, level, tokens FROM sums) GROUP BY 1, 2")
def seal_gate(spark, sf):
    b = memory_chunks(spark, sf).where("status = 'buffered'").select("scope", F.lit(0).alias("level"), F.col("token_count").alias("tokens"))
    g = b.unionAll(summaries(spark, sf).select("scope", "level", "tokens")).groupBy("scope", "level").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return g.withColumn("seals", trees.must_seal(F.col("level"), F.col("tokens"), F.col("items")))


# aggregates


@query(f"WITH {MEM} SELECT status, count(*) AS n, sum(token_count)::BIGINT AS tokens FROM mem GROUP BY 1")
def chunks_by_status(spark, sf):
    return memory_chunks(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


@query(f"WITH {SUMS} SELECT tree_id, count(*) FILTER (NOT deleted) AS live, count(*) AS n FROM sums GROUP BY 1")
def live_summaries_per_tree(spark, sf):
    return summaries(spark, sf).groupBy("tree_id").agg(F.count_if(~F.col("deleted")).alias("live"), F.count("*").alias("n"))


@query(f"WITH {LINKS} SELECT (SELECT count(*) FROM mem) AS n_chunks, (SELECT count(*) FROM sums) AS n_summaries, (SELECT count(*) FROM links) AS n_links, (SELECT count(DISTINCT scope) FROM mem) AS n_trees")
def engine_totals(spark, sf):
    parts = [memory_chunks(spark, sf).agg(F.count("*").alias("n_chunks"), F.countDistinct("scope").alias("n_trees")), summaries(spark, sf).agg(F.count("*").alias("n_summaries")), tree_links(spark, sf).agg(F.count("*").alias("n_links"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # a row each


@query(f"WITH {MEM} SELECT scope, count(*) AS n, count(*) > 10 AS truncated FROM mem WHERE status <> 'dropped' GROUP BY 1")
def truncated_flag(spark, sf):
    """Whether a response of the default limit leaves rows out."""
    return _leaves(spark, sf).groupBy("scope").agg(F.count("*").alias("n")).withColumn("truncated", F.col("n") > response_limit(0))


@query("SELECT count(DISTINCT conv_id) AS n_threads, count(*) AS n_messages FROM conversations WHERE conv_id % 3 = 0")
def purge_stats(spark, sf):
    return table(spark, sf, "conversations").where("conv_id % 3 = 0").agg(F.countDistinct("conv_id").alias("n_threads"), F.count("*").alias("n_messages"))


@query("SELECT count(DISTINCT strftime(ts, '%Y/%m/%d/%H')) AS hours, count(DISTINCT strftime(ts, '%Y/%m/%d')) AS days, count(DISTINCT strftime(ts, '%Y/%m')) AS months, min(strftime(ts, '%Y/%m/%d/%H')) AS oldest, max(strftime(ts, '%Y/%m/%d/%H')) AS newest FROM events")
def time_tree_status(spark, sf):
    hour = F.date_format(F.col("ts").cast("timestamp"), "yyyy/MM/dd/HH")
    e = table(spark, sf, "events").select(hour.alias("h"))
    return e.agg(F.countDistinct("h").alias("hours"), F.countDistinct(F.substring("h", 1, 10)).alias("days"), F.countDistinct(F.substring("h", 1, 7)).alias("months"), F.min("h").alias("oldest"), F.max("h").alias("newest"))


@query("""SELECT node, CASE len(string_split(node, '/')) WHEN 4 THEN 'hour' WHEN 3 THEN 'day' WHEN 2 THEN 'month' ELSE 'year' END AS level, CASE WHEN contains(node, '/') THEN regexp_replace(node, '/[^/]*$', '') ELSE 'root' END AS parent
FROM (SELECT DISTINCT unnest([strftime(ts, '%Y/%m/%d/%H'), strftime(ts, '%Y/%m/%d'), strftime(ts, '%Y/%m'), strftime(ts, '%Y')]) AS node FROM events)""")
def time_nodes(spark, sf):
    """Hour, day, month and year ids with their level and parent."""
    at = F.col("ts").cast("timestamp")
    ids = F.array(*[F.date_format(at, f) for f in ("yyyy/MM/dd/HH", "yyyy/MM/dd", "yyyy/MM", "yyyy")])
    n = table(spark, sf, "events").select(F.explode(ids).alias("node")).distinct()
    level = F.element_at(F.array(*map(F.lit, ("year", "month", "day", "hour"))), F.size(F.split("node", "/")))
    return n.select("node", level.alias("level"), F.when(F.col("node").contains("/"), F.regexp_replace("node", "/[^/]*$", "")).otherwise("root").alias("parent"))


# trees and retrieval


_DOWN = "down(root, node, depth) AS (SELECT parent, child, 1 FROM links UNION ALL SELECT d.root, l.child, d.depth + 1 FROM down d JOIN links l ON d.node = l.parent)"


@query(f"WITH RECURSIVE {LINKS}, {_DOWN} SELECT root, node, depth FROM down WHERE root = 's2:src1:0'")
def drill_down(spark, sf):
    """All nodes below one, level by level."""
    root = spark.createDataFrame([("s2:src1:0",)], "id string")
    return trees.descend(root, tree_links(spark, sf))


@query(f"WITH RECURSIVE {LINKS}, {_DOWN} SELECT root, count(*) AS leaves FROM down WHERE starts_with(node, 'c') GROUP BY root")
def descendant_leaves(spark, sf):
    found = trees.descend(summaries(spark, sf).select("id"), tree_links(spark, sf))
    return found.where(F.col("node").startswith("c")).groupBy("root").agg(F.count("*").alias("leaves"))


@query(f"WITH RECURSIVE {LINKS}, {_DOWN} SELECT node AS root, root AS node, depth FROM down WHERE node IN ('c0', 'c7', 'c21')")
def ancestors_of_chunks(spark, sf):
    asked = spark.createDataFrame([("c0",), ("c7",), ("c21",)], "id string")
    return trees.ancestors(asked, tree_links(spark, sf))


@query(f"""WITH RECURSIVE {LINKS}, {_DOWN}, fits AS (SELECT * FROM sums WHERE NOT deleted AND start_ms >= {SINCE} AND end_ms <= {UNTIL}),
best AS (SELECT * FROM fits WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM fits)), seen AS (SELECT DISTINCT node FROM down WHERE root IN (SELECT id FROM best))
SELECT scope, id, 'summary' AS kind, start_ms FROM best UNION ALL
SELECT scope, id, 'leaf', timestamp_ms FROM mem WHERE status <> 'dropped' AND timestamp_ms BETWEEN {SINCE} AND {UNTIL} AND id NOT IN (SELECT node FROM seen) ORDER BY scope, start_ms, id LIMIT 200""")
def window_cover(spark, sf):
    s = summaries(spark, sf).where("not deleted")
    return trees.window_cover(_leaves(spark, sf), s, tree_links(spark, sf), SINCE, UNTIL)


@query(f"WITH {SUMS} SELECT scope, id, level, start_ms, end_ms FROM sums WHERE NOT deleted AND level >= 1 AND end_ms >= {SINCE} AND start_ms <= {UNTIL} AND scope IN ('src1', 'src2') ORDER BY end_ms DESC, id LIMIT 100")
def digest(spark, sf):
    """Summaries that overlap a window, both ends included, newest first."""
    s = summaries(spark, sf).where(~F.col("deleted") & (F.col("end_ms") >= SINCE) & (F.col("start_ms") <= UNTIL) & F.col("scope").isin("src1", "src2"))
    return s.orderBy(F.desc("end_ms"), "id").limit(100).select("scope", "id", "level", "start_ms", "end_ms")


@query(f"""WITH {SUMS} SELECT id AS node_id, 'summary' AS node_kind, tree_id, level, NULL AS content, start_ms, end_ms FROM sums WHERE NOT deleted
UNION ALL SELECT id, 'leaf', 't:' || scope, 0, substr(content, 1, 500), timestamp_ms, timestamp_ms FROM mem WHERE status <> 'dropped'""")
def unified_hits(spark, sf):
    """Summaries and chunks as rows of one shape; a chunk is a leaf of level 0."""
    s = summaries(spark, sf).where("not deleted").select(F.col("id").alias("node_id"), F.lit("summary").alias("node_kind"), "tree_id", "level", F.lit(None).cast("string").alias("content"), "start_ms", "end_ms")
    c = _leaves(spark, sf).select(F.col("id").alias("node_id"), F.lit("leaf").alias("node_kind"), F.concat(F.lit("t:"), "scope").alias("tree_id"), F.lit(0).alias("level"), F.substring("content", 1, 500).alias("content"), F.col("timestamp_ms").alias("start_ms"), F.col("timestamp_ms").alias("end_ms"))
    return s.unionAll(c)


@query(f"""WITH {SUMS}, hits AS (SELECT id, scope, timestamp_ms, status FROM mem WHERE contains(content, 'the') AND timestamp_ms BETWEEN {SINCE} AND {UNTIL})
SELECT h.id, h.scope, s.id AS summary_id, s.level FROM hits h LEFT JOIN sums s ON s.scope = h.scope AND s.level = 1 AND h.timestamp_ms BETWEEN s.start_ms AND s.end_ms AND NOT s.deleted AND s.id = 's1:' || h.scope || ':' || (((h.timestamp_ms - 1700000000000) // 60000) // 20) WHERE h.status <> 'dropped'""")
def topic_hits(spark, sf):
    """Chunks of a topic in a window, the dropped ones left out, with their live summaries."""
    h = memory_chunks(spark, sf).where(F.col("content").contains("the") & F.col("timestamp_ms").between(SINCE, UNTIL) & (F.col("status") != "dropped"))
    h = h.select("id", "scope", F.concat(F.lit("s1:"), "scope", F.lit(":"), F.expr("doc_id div 20")).alias("summary"))
    s = summaries(spark, sf).where("level = 1 and not deleted").select(F.col("id").alias("summary_id"), "level")
    return h.join(s, F.col("summary") == F.col("summary_id"), "left").select("id", "scope", "summary_id", "level")


@query(f"WITH {MEM} SELECT pos, id, token_count FROM (SELECT unnest(['c9', 'c2', 'c400000', 'c5']) AS id, unnest([0, 1, 2, 3]) AS pos) JOIN mem USING (id)")
def leaves_in_order(spark, sf):
    """Leaves by id, in the order asked; missing ones are left out."""
    asked = spark.createDataFrame(list(enumerate(["c9", "c2", "c400000", "c5"])), "pos int, id string")
    return memory_chunks(spark, sf).join(F.broadcast(asked), "id").select("pos", "id", "token_count")


@query(f"""WITH RECURSIVE {MEM}, leaf AS MATERIALIZED (SELECT scope, token_count, timestamp_ms, row_number() OVER (PARTITION BY scope ORDER BY doc_id) AS k FROM mem WHERE status <> 'dropped'),
run AS (SELECT scope, k, token_count, timestamp_ms, token_count AS acc, 0 AS batch FROM leaf WHERE k = 1 UNION ALL
  SELECT l.scope, l.k, l.token_count, l.timestamp_ms, CASE WHEN r.acc >= 5000 THEN 0 ELSE r.acc END + l.token_count, r.batch + (r.acc >= 5000)::INT FROM run r JOIN leaf l ON l.scope = r.scope AND l.k = r.k + 1),
l1 AS (SELECT scope AS tree, 1 AS level, batch AS node, count(*) AS n_items, sum(token_count) AS tokens, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms FROM run GROUP BY scope, batch HAVING sum(token_count) >= 5000),
l2 AS (SELECT tree, 2 AS level, node // 4 AS node, count(*) AS n_items, sum(tokens) AS tokens, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM l1 GROUP BY tree, node // 4 HAVING count(*) >= 4),
l3 AS (SELECT tree, 3 AS level, node // 4 AS node, count(*) AS n_items, sum(tokens) AS tokens, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM l2 GROUP BY tree, node // 4 HAVING count(*) >= 4),
l4 AS (SELECT tree, 4 AS level, node // 4 AS node, count(*) AS n_items, sum(tokens) AS tokens, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM l3 GROUP BY tree, node // 4 HAVING count(*) >= 4),
l5 AS (SELECT tree, 5 AS level, node // 4 AS node, count(*) AS n_items, sum(tokens) AS tokens, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM l4 GROUP BY tree, node // 4 HAVING count(*) >= 4),
l6 AS (SELECT tree, 6 AS level, node // 4 AS node, count(*) AS n_items, sum(tokens) AS tokens, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM l5 GROUP BY tree, node // 4 HAVING count(*) >= 4)
SELECT tree, level, node::BIGINT AS node, n_items, tokens::BIGINT AS tokens, start_ms, end_ms FROM (FROM l1 UNION ALL FROM l2 UNION ALL FROM l3 UNION ALL FROM l4 UNION ALL FROM l5 UNION ALL FROM l6)""")
def seal_cascade(spark, sf):
    """Levels sealed one after the other: buffers that reach 5,000 tokens, then four nodes each."""
    c = _leaves(spark, sf).select(F.col("scope").alias("tree"), F.col("doc_id").alias("seq"), F.col("token_count").alias("tokens"), F.col("timestamp_ms").alias("at_ms"))
    return trees.seal_cascade(c, fan_in=4, tokens=5_000)


# mutations, as the tables after them


@query(f"WITH {LINKS}, gone AS (SELECT id FROM mem WHERE scope = 'src1') SELECT l.parent, l.child FROM links l WHERE l.child NOT IN (SELECT id FROM gone) AND l.parent NOT IN (SELECT id FROM sums WHERE scope = 'src1')")
def delete_source_cascade(spark, sf):
    """Links that are left after a source goes with its chunks and its tree."""
    gone = memory_chunks(spark, sf).where("scope = 'src1'").select("id").unionAll(summaries(spark, sf).where("scope = 'src1'").select("id"))
    l = tree_links(spark, sf)  # noqa: E741
    return l.join(gone.select(F.col("id").alias("child")), "child", "left_anti").join(gone.select(F.col("id").alias("parent")), "parent", "left_anti").select("parent", "child")


@query(f"WITH {MEM} SELECT id FROM mem WHERE status <> 'dropped' AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) AND doc_id % 11 <> 0")
def reembed_uncovered(spark, sf):
    """Live chunks with neither a vector nor a tombstone (here: every eleventh)."""
    c = _leaves(spark, sf)
    done = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"))
    skipped = c.where("doc_id % 11 = 0").select("doc_id")
    return c.join(done, "doc_id", "left_anti").join(skipped, "doc_id", "left_anti").select("id")


@query("""WITH log AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'upsert' WHEN conv_id % 7 = 0 AND turn = 2 THEN 'delete' WHEN conv_id % 14 = 0 AND turn = 3 THEN 'upsert' ELSE 'message' END AS op FROM conversations),
born AS (SELECT conv_id, max(turn) FILTER (op = 'upsert') AS up, max(turn) FILTER (op = 'delete') AS del FROM log GROUP BY 1)
SELECT b.conv_id, count(l.turn) FILTER (l.op = 'message' AND l.turn > coalesce(b.del, -1)) AS n_messages, max(l.turn) FILTER (l.op = 'message' AND l.turn > coalesce(b.del, -1)) AS last_turn
FROM born b JOIN log l USING (conv_id) WHERE b.up IS NOT NULL AND (b.del IS NULL OR b.up > b.del) GROUP BY b.conv_id""")
def log_fold(spark, sf):
    """Threads after a log of upserts, deletes and messages: a delete ends a thread, a later upsert begins it anew without the messages before."""
    turn, conv = F.col("turn"), F.col("conv_id")
    op = F.when(turn == 0, "upsert").when((conv % 7 == 0) & (turn == 2), "delete").when((conv % 14 == 0) & (turn == 3), "upsert").otherwise("message")
    log = table(spark, sf, "conversations").select("conv_id", "turn", op.alias("op"))
    state = log.groupBy("conv_id").agg(F.max(F.when(F.col("op") == "upsert", turn)).alias("up"), F.max(F.when(F.col("op") == "delete", turn)).alias("del"))
    live = state.where(F.col("up").isNotNull() & (F.col("del").isNull() | (F.col("up") > F.col("del"))))
    counted = (F.col("op") == "message") & (turn > F.coalesce("del", F.lit(-1)))
    return log.join(live, "conv_id").groupBy("conv_id").agg(F.count_if(counted).alias("n_messages"), F.max(F.when(counted, turn)).alias("last_turn"))


# ingest and safety


@query("""SELECT conv_id, string_agg('## ' || strftime(make_timestamp((1700000000 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || ' — ' || role || chr(10) || trim(coalesce(text, '')) || chr(10), chr(10) ORDER BY turn, role, coalesce(text, '')) AS markdown,
  min((1700000000 + turn * 60) * 1000)::BIGINT AS start_ms, max((1700000000 + turn * 60) * 1000)::BIGINT AS end_ms FROM conversations GROUP BY conv_id""")
def chat_markdown(spark, sf):
    """A chat as markdown: messages by time, each under a header of its time and author."""
    c = table(spark, sf, "conversations")
    at = F.col("turn") * 60 + 1_700_000_000
    stamp = F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.concat(F.lit("## "), stamp, F.lit(" — "), "role", F.lit("\n"), F.trim(F.coalesce("text", F.lit(""))), F.lit("\n"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"), said.alias("said"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["said"]), "\n").alias("markdown"), F.min(at * 1000).cast("long").alias("start_ms"), F.max(at * 1000).cast("long").alias("end_ms"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '([\\\\`*_|])', '\\\\\\1', 'g'), '[\\n\\r]', ' ', 'g') AS escaped, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) <= 80 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE substr(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 80) || '…' END AS short FROM documents")
def body_markdown(spark, sf):
    return table(spark, sf, "documents").select("doc_id", mail.markdown_escaped(F.col("text")).alias("escaped"), mail.truncated(F.col("text"), 80).alias("short"))


@query()
def mail_clean(spark, sf):
    """Documents cleaned as mail bodies; the tests compare the steps with plain ones."""
    return table(spark, sf, "documents").select("doc_id", mail.clean_body(F.col("text")).alias("body"))


@query()
def pii_redact(spark, sf):
    """Texts without secrets and personal data; the tests hold the classes against their definitions."""
    return table(spark, sf, "documents").select("doc_id", safety.pii_redacted(safety.secrets_redacted(F.col("text"))).alias("clean"))


@query("SELECT doc_id, regexp_matches(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b') AS has_email, regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b') AS has_aws FROM documents")
def boundary_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", safety.has_email(F.col("text")).alias("has_email"), F.col("text").rlike(r"\bAKIA[0-9A-Z]{16}\b").alias("has_aws"))


def _entities(text: Column) -> Column:
    """(kind, surface) of addresses, links, handles, name#1234 and hashtags, in this order."""
    none = F.array().cast("array<struct<kind:string,surface:string>>")
    found = lambda kind, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("surface")))
    return F.flatten(F.array(*[F.when(F.contains(text, F.lit(ENTITY_SIGNS[k])), found(k, ENTITY_FORMS.get(k, p))).otherwise(none) for k, p in ENTITY_PATTERNS.items()]))


_ENT = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS surface FROM documents" for k, p in ENTITY_PATTERNS.items())


@query(f"SELECT kind, CASE WHEN kind = 'url' THEN 'url:' || surface ELSE kind || ':' || lower(regexp_replace(surface, '^[@#]+', '')) END AS entity_id, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM ({_ENT}) GROUP BY 1, 2")
def entities_by_kind(spark, sf):
    # outer: else Spark works out the array for a filter as well
    e = table(spark, sf, "documents").select("doc_id", F.explode_outer(_entities(F.col("text"))).alias("e")).where("e is not null").select("doc_id", "e.kind", "e.surface")
    return e.groupBy("kind", T.canonical_id(F.col("kind"), F.col("surface")).alias("entity_id")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]{3,}')) AS word FROM documents)
SELECT word, count(DISTINCT doc_id) AS n_docs FROM w GROUP BY 1 ORDER BY n_docs DESC, word LIMIT 200""")
def folded_vocabulary(spark, sf):
    """Words without accents and case, by the number of texts that hold them."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(T.unaccented(F.col("text"))), F.lit("([a-z0-9]{3,})"), F.lit(1)))).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n_docs")).orderBy(F.desc("n_docs"), "word").limit(200)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_custkey FROM orders")
def record_turns(spark, sf):
    """The next sequence number of each session's entries, by time."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("seq"), "o_custkey")


@query("""WITH s AS (SELECT o_custkey AS source, o_orderkey AS snapshot, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT a.source, a.snapshot AS newest, b.snapshot AS before FROM s a LEFT JOIN s b ON a.source = b.source AND b.r = 2 WHERE a.r = 1""")
def latest_two_snapshots(spark, sf):
    """The newest snapshot of each source, and the one before, null where there is none."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("snapshot"), F.row_number().over(w).alias("r")).where("r <= 2")
    return r.groupBy("source").agg(F.max(F.when(F.col("r") == 1, F.col("snapshot"))).alias("newest"), F.max(F.when(F.col("r") == 2, F.col("snapshot"))).alias("before"))
