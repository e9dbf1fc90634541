"""Queries over names, ids, extractions, lists, trees as graphs, and the tables after mutations. Registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions import names as N
from lodestack.functions import score as S
from lodestack.operators import aliases, batches
from lodestack.plans.catalogue import query
from lodestack.sources.adapters import table
from lodestack.sources.engine import LINKS, MEM, SUMS, memory_chunks, summaries, tree_links

# names, ids, tags

_RAW = "'- (' || p_name || '  _' || p_brand || '; ' || p_type || ').'"
_ALNUM = "regexp_replace({}, '[^A-Za-z0-9]+', '{}', 'g')"


@query(f"""WITH p AS (SELECT p_partkey, {_RAW} AS raw, p_name FROM part)
SELECT p_partkey, trim({_ALNUM.format("upper(raw)", "_")}, '_') AS predicate, upper(p_name || ' _' || replace(raw, '- (' || p_name || '  _', '')) AS spaced, lower(trim(regexp_replace(regexp_replace(regexp_replace(raw, '[-_/. ]', ' ', 'g'), '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) AS searched,
  array_to_string(list_transform(list_filter(string_split_regex(p_name, '[^A-Za-z0-9_]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '-') AS tag FROM p""")
def part_names(spark, sf):
    """Names as predicates, search texts and tags."""
    raw = F.concat(F.lit("- ("), "p_name", F.lit("  _"), "p_brand", F.lit("; "), "p_type", F.lit(")."))
    rest = F.concat("p_name", F.lit(" _"), "p_brand", F.lit("; "), "p_type", F.lit(")."))
    return table(spark, sf, "part").select("p_partkey", N.predicate(raw).alias("predicate"), F.upper(rest).alias("spaced"), N.search_text(raw).alias("searched"), N.tag_value(F.col("p_name")).alias("tag"))


@query("""SELECT page_id, replace(replace(replace(url, ':', '-'), '/', '-'), '?', '-') AS file, replace(replace(replace(url || ' x', ':', '-'), '/', '-'), '?', '-').replace(' ', '-') AS uid,
  replace(replace(replace(url, ':', '_'), '/', '_'), '?', '_') AS slug, url AS item, url AS other FROM pages""")
def page_file_names(spark, sf):
    """Addresses as file names, ids and slugs, and the item id out of two composite ids."""
    u = F.col("url")
    item = N.item_id(F.concat(F.lit("mem_src:web:"), u))
    return table(spark, sf, "pages").select("page_id", N.file_name(u).alias("file"), N.uid(F.concat(u, F.lit(" x"))).alias("uid"), N.entity_slug(u).alias("slug"), item.alias("item"), N.item_id(F.concat(F.lit("feed:"), u)).alias("other"))


@query("""WITH h AS (SELECT doc_id, 'archivist:' || substr(sha256(source || chr(0) || text), 1, 32) AS session_id, substr(sha256(source || chr(31) || text), 1, 32) AS evidence_id FROM documents)
SELECT doc_id, session_id, evidence_id, ('0x' || evidence_id[7:8] || evidence_id[5:6] || evidence_id[3:4] || evidence_id[1:2])::BIGINT AS seq FROM h""")
def stable_ids(spark, sf):
    """Ids that depend on scope and content alone."""
    return table(spark, sf, "documents").select("doc_id", N.session_chunk_id(F.col("source"), F.col("text")).alias("session_id"), N.evidence_id(F.col("source"), F.col("text")).alias("evidence_id"), N.stable_seq(F.col("source"), F.col("text")).alias("seq"))


_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_BLANK})), lambda x: x <> '')[1] AS line FROM documents),
t AS (SELECT doc_id, trim(ltrim(line, '#'), {_BLANK}) AS line FROM l) SELECT doc_id, CASE WHEN coalesce(line, '') = '' THEN 'item' || doc_id ELSE substr(line, 1, 120) END AS title FROM t""")
def titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.title(F.col("text"), F.concat(F.lit("item"), "doc_id")).alias("title"))


@query("""WITH t AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'proactive:morning-briefing:' || conv_id WHEN 1 THEN 'proactive:x' || conv_id ELSE 'c' || conv_id END AS thread, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'briefing' WHEN 1 THEN 'notification' ELSE 'general' END AS inferred, CASE WHEN last % 2 = 0 THEN ['general', 'tasks', 'own'] ELSE ['own', 'subconscious', 'tasks'] END AS labels FROM t""")
def thread_labels(spark, sf):
    """Labels that a thread's id tells, and stored ones by their present names."""
    conv = F.col("conv_id")
    thread = F.when(conv % 3 == 0, F.concat(F.lit("proactive:morning-briefing:"), conv)).when(conv % 3 == 1, F.concat(F.lit("proactive:x"), conv)).otherwise(F.concat(F.lit("c"), conv))
    stored = F.when(F.col("last") % 2 == 0, F.array(*map(F.lit, ("work", "agent-task", "worker", "own")))).otherwise(F.array(*map(F.lit, ("own", "from_reflection", "subconscious_tick", "tasks"))))
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return t.select("conv_id", N.inferred_label(thread).alias("inferred"), N.current_labels(stored).alias("labels"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS engagement,
  CASE event_id % 4 WHEN 0 THEN ['source/mail', 'x'] WHEN 1 THEN ['source/mail', 'sent', 'reply'] WHEN 2 THEN ['source/mail', 'mention', 'mention', 'x'] ELSE ['source/mail', 'dm'] END AS tags FROM events""")
def tag_signals(spark, sf):
    """Engagement from tags, repeats counted, and the source's tag moved to the front."""
    kinds = [("x",), ("sent", "reply"), ("mention", "mention", "x"), ("dm", "source/mail")]
    tags = F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in kinds]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.round(N.engagement(tags), 6).alias("engagement"), N.source_tag_first(F.lit("mail"), tags).alias("tags"))


@query("""WITH m AS (SELECT doc_id, lang, text FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'id: ' || doc_id || chr(10) || 'lang: "' || lang || '"' END AS front, CASE WHEN doc_id % 2 = 0 THEN lang END AS field, sha256(text) AS body_sha256 FROM m""")
def front_matter(spark, sf):
    """Markdown files with and without front matter: the block, a scalar of it, and the body's checksum."""
    head = F.concat(F.lit("---\nid: "), "doc_id", F.lit('\nlang: "'), "lang", F.lit('"\n---\n'))
    md = F.concat(F.when(F.col("doc_id") % 2 == 0, head).otherwise(""), "text")
    d = table(spark, sf, "documents").select("doc_id", N.front_matter(md).alias("front"), N.body(md).alias("body"))
    return d.select("doc_id", "front", N.front_field(F.col("front"), "lang").alias("field"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


@query(f"""WITH {SUMS} SELECT id, '---' || chr(10) || 'id: ' || id || chr(10) || 'tree: ' || tree_id || chr(10) || 'level: ' || level || chr(10) || 'children: ' || n_children || chr(10) || '---' || chr(10) || 'from ' || start_ms || ' to ' || end_ms || chr(10) AS markdown FROM sums WHERE NOT deleted""")
def summary_markdown(spark, sf):
    rows = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in (("id", "id"), ("tree", "tree_id"), ("level", "level"), ("children", "n_children"))]
    said = F.concat(F.lit("from "), "start_ms", F.lit(" to "), "end_ms", F.lit("\n"))
    return summaries(spark, sf).where("not deleted").select("id", F.concat_ws("\n", F.lit("---"), *rows, F.lit("---"), said).alias("markdown"))


# dates

_HOUR = "strftime({}, '%Y/%m/%d/%H')"


@query(f"""SELECT event_id, {_HOUR.format("make_timestamp((epoch_us(ts) // 1000) * 1000)")} AS hour, strftime(ts, '%Y-%m-%d') || '#' || (hour(ts) // 3) AS block, strftime(ts, '%Y/%m/%d') AS day, strftime(ts, '%Y') AS year, 'root' AS root FROM events""")
def buffer_nodes(spark, sf):
    """Hour nodes out of buffer file names, their ancestors, and the key of the flush that takes them."""
    at = F.col("ts").cast("timestamp")
    e = table(spark, sf, "events").select("event_id", N.hour_of_file(F.concat(F.unix_millis(at), F.lit("_"), "event_id", F.lit(".md"))).alias("hour"), N.flush_block(at).alias("block"))
    day = N.parent_node(F.col("hour"))
    e = e.withColumn("day", day).withColumn("year", N.parent_node(N.parent_node(F.col("day"))))
    return e.withColumn("root", N.parent_node(F.col("year")))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE epoch_us(o_orderdate) // 1000 - CASE WHEN o_orderkey % 5 IN (1, 2) THEN 3600000 ELSE 0 END END AS at_ms FROM orders""")
def mail_dates(spark, sf):
    """Dates of mails in the forms that occur: milliseconds, RFC 3339, mail dates, plain dates; others have none."""
    at = F.col("o_orderdate").cast("timestamp")
    forms = [F.concat(F.lit('{"internalDate": "'), F.unix_millis(at), F.lit('"}')), F.concat(F.lit('{"date": "'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+01:00'"), F.lit('"}')),
             F.concat(F.lit('{"date": "'), F.date_format(at, "EEE, d MMM yyyy HH:mm:ss '+0100'"), F.lit('"}')), F.concat(F.lit('{"data": {"internalDate": "'), F.date_format(at, "yyyy-MM-dd"), F.lit('"}}')), F.lit('{"date": "soon"}')]
    said = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    first = F.coalesce(*[F.get_json_object(said, p) for p in ("$.date", "$.internalDate", "$.data.internalDate")])
    return table(spark, sf, "orders").select("o_orderkey", N.parsed_date(first).alias("at_ms"))


# entities and lists

_NAMES = "n AS (SELECT DISTINCT p_brand AS type, unnest([upper(p_name), upper(string_split(p_name, ' ')[1]), 'NEW ' || upper(p_name)]) AS name FROM part)"
_ALIASES = f"""{_NAMES}, a AS (SELECT s.type, s.name AS alias, l.name AS canonical FROM n s JOIN n l ON s.type = l.type AND length(l.name) > length(s.name) AND (starts_with(l.name, s.name || ' ') OR ends_with(l.name, ' ' || s.name))
  QUALIFY row_number() OVER (PARTITION BY s.type, s.name ORDER BY length(l.name) DESC, l.name) = 1)"""


def _part_aliases(spark, sf):
    p = table(spark, sf, "part")
    name = F.upper("p_name")
    return aliases.alias_map(p.select(F.col("p_brand").alias("type"), F.explode(F.array(name, F.split(name, " ")[0], F.concat(F.lit("NEW "), name))).alias("name")))


@query(f"WITH {_ALIASES} SELECT * FROM a")
def alias_map(spark, sf):
    return _part_aliases(spark, sf)


@query(f"""WITH RECURSIVE {_ALIASES}, r AS (SELECT type, alias, canonical FROM a UNION ALL SELECT r.type, r.alias, a.canonical FROM r JOIN a ON a.type = r.type AND a.alias = r.canonical),
e AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY type, alias ORDER BY length(canonical) DESC) = 1) SELECT type, canonical, list_sort(list(alias)) AS aliases FROM e GROUP BY 1, 2""")
def aliases_of_names(spark, sf):
    """Chains of aliases followed to their ends, listed by canonical name."""
    return aliases.listed(aliases.resolved(_part_aliases(spark, sf)))


@query("""WITH x AS (SELECT event_type AS kind, upper(event_type) || (user_id % 9) AS text, user_id % 7 AS start, round(value, 2) AS importance FROM events UNION ALL SELECT event_type, event_type || (user_id % 9), user_id % 7, 1.0 FROM events WHERE event_id % 2 = 0)
SELECT kind, min(text) AS text, start, max(importance) AS importance FROM x GROUP BY kind, lower(text), start""")
def merged_extractions(spark, sf):
    """Two extractions as one set; the greater importance stays."""
    e = table(spark, sf, "events")
    n = F.col("user_id") % 9
    first = e.select(F.col("event_type").alias("kind"), F.concat(F.upper("event_type"), n).alias("text"), (F.col("user_id") % 7).alias("start"), F.round("value", 2).alias("importance"))
    second = e.where("event_id % 2 = 0").select(F.col("event_type").alias("kind"), F.concat("event_type", n).alias("text"), (F.col("user_id") % 7).alias("start"), F.lit(1.0).alias("importance"))
    return aliases.merged(first.unionByName(second))


@query("SELECT s_suppkey, unnest([s_name, '', 'Desk ' || s_nationkey]) AS name, unnest(['s' || s_suppkey || '@x.org', 'info@x.org', 'n' || s_nationkey || '@y.org']) AS address FROM supplier")
def header_people(spark, sf):
    """Names and addresses out of a mail header's list."""
    header = F.concat("s_name", F.lit(" <s"), "s_suppkey", F.lit('@x.org>, info@x.org, "Desk '), "s_nationkey", F.lit('" <n'), "s_nationkey", F.lit("@y.org>"))
    people = F.transform(F.split(header, ","), lambda p: F.struct(F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>|[^ ]+@[^ ]+", ""), '"', "")).alias("name"), F.regexp_extract(p, r"([^\s<>\"]+@[^\s<>\"]+)", 1).alias("address")))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(people).alias("p")).select("s_suppkey", "p.name", "p.address")


@query("SELECT o_orderkey, 'g' || o_orderkey AS id, o_orderpriority || ' [now]' AS text FROM orders")
def goal_lines(spark, sf):
    """Goals of the form `- [id] text`; lines of other forms, and those without id or text, are none."""
    md = F.concat(F.lit("# Goals\n- [g"), "o_orderkey", F.lit("]  "), "o_orderpriority", F.lit(" [now]\n- no id\n- [] x\n- [g0] \n* [g1] y"))
    pattern = r"^- +\[\s*([^\]]*?)\s*\]\s*(.*)$"
    line = F.trim("line")
    lines = table(spark, sf, "orders").select("o_orderkey", F.explode(F.split(md, "\n")).alias("line")).where(line.rlike(pattern))
    parsed = lines.select("o_orderkey", F.regexp_extract(line, pattern, 1).alias("id"), F.trim(F.regexp_extract(line, pattern, 2)).alias("text"))
    return parsed.where("id <> '' and text <> ''")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k, length(o_orderpriority) * 40 AS size FROM orders),
c AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS total FROM r WHERE k <= 8) SELECT o_custkey, o_orderkey FROM c WHERE total <= 2000""")
def goals_capped(spark, sf):
    """The newest of each list: eight at most, 2,000 bytes at most."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.repeat("o_orderpriority", F.lit(40)).alias("text"))
    return aliases.capped(o, "o_custkey", "o_orderkey", "text").select("o_custkey", "o_orderkey")


@query("""WITH u AS (SELECT DISTINCT o_custkey, o_orderkey % 10 AS n FROM orders), c AS (SELECT o_custkey, count(*) AS n, list(n) AS used FROM u GROUP BY 1)
SELECT o_custkey, 'g' || list_min(list_filter(range(n + 1, 2 * n + 3), lambda i: NOT list_contains(used, i))) AS next_id FROM c""")
def next_goal_id(spark, sf):
    """The first unused number from the count of goals upward; lists hold ten numbers at most."""
    u = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 10).cast("long").alias("n")).distinct()
    c = u.groupBy("o_custkey").agg(F.collect_set("n").alias("used"))
    n = F.size("used").cast("long")
    return c.select("o_custkey", F.concat(F.lit("g"), F.array_min(F.array_except(F.sequence(n + 1, 2 * n + 2), "used"))).alias("next_id"))


# trees and retrieval


@query(f"""WITH {SUMS} SELECT 'root' AS id, 'root' AS kind, NULL AS parent UNION ALL SELECT DISTINCT tree_id, 'source', 'root' FROM sums UNION ALL SELECT id, 'summary', coalesce(parent_id, tree_id) FROM sums
UNION ALL SELECT id, 'chunk', 's1:' || scope || ':' || (doc_id // 20) FROM mem WHERE status <> 'dropped'""")
def tree_graph(spark, sf):
    """The memory as one tree: root, sources, summaries and chunks, each with its parent."""
    s = summaries(spark, sf)
    root = spark.createDataFrame([("root", "root", None)], "id string, kind string, parent string")
    sources = s.select("tree_id").distinct().select("tree_id", F.lit("source"), F.lit("root"))
    nodes = s.select("id", F.lit("summary"), F.coalesce("parent_id", "tree_id"))
    leaves = tree_links(spark, sf).where("child like 'c%'").select("child", F.lit("chunk"), "parent")
    return root.unionAll(sources).unionAll(nodes).unionAll(leaves)


@query(f"""WITH {LINKS}, i AS (SELECT l.parent, m.doc_id % 7 AS score, m.timestamp_ms, m.doc_id, trim(m.content, {_BLANK}) AS content FROM links l JOIN mem m ON l.child = m.id)
SELECT parent, substr(string_agg('— ' || content, chr(10) || chr(10) ORDER BY score DESC, doc_id), 1, 2000) AS summary FROM i WHERE content <> '' GROUP BY 1""")
def fallback_summaries(spark, sf):
    """Children of a summary (twenty at most) by score, then time, each after a dash, cut to 500 tokens."""
    c = memory_chunks(spark, sf).select(F.col("id").alias("child"), "doc_id", N.bare(F.col("content")).alias("content"))
    inputs = tree_links(spark, sf).join(c, "child").where("content <> ''")
    ordered = F.array_sort(F.collect_list(F.struct((-(F.col("doc_id") % 7)).alias("by"), "doc_id", "content")))
    parts = F.transform(ordered, lambda x: F.concat(F.lit("— "), x["content"]))
    return inputs.groupBy("parent").agg(F.substring(F.array_join(parts, "\n\n"), 1, 500 * 4).alias("summary"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings)),
d AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 50),
o AS (SELECT l_orderkey AS vec_id, count(DISTINCT l_suppkey) AS overlap FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP BY 1)
SELECT vec_id, similarity, coalesce(overlap, 0) AS overlap FROM d LEFT JOIN o USING (vec_id) ORDER BY overlap DESC, similarity DESC, vec_id LIMIT 25""")
def dense_by_overlap(spark, sf):
    """Twice as many nearest vectors as asked, then those first that share most of the query's entities; else by similarity."""
    e = table(spark, sf, "embeddings")
    asked = e.groupBy().agg(F.max_by("embedding", "vec_id").alias("q"))  # a row
    near = e.join(F.broadcast(asked)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(50)
    shared = table(spark, sf, "lineitem").where("l_suppkey in (1, 2, 3)").groupBy(F.col("l_orderkey").alias("vec_id")).agg(F.countDistinct("l_suppkey").alias("overlap"))
    ranked = near.join(shared, "vec_id", "left").select("vec_id", "similarity", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    return ranked.orderBy(F.desc("overlap"), F.desc("similarity"), "vec_id").limit(25)


@query("""WITH r AS (SELECT d.source, l.quality AS rel, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS k FROM documents d JOIN labels l USING (doc_id))
SELECT source, coalesce(max(rel) FILTER (k <= 1), 0)::DOUBLE AS hit_at_1, coalesce(max(rel) FILTER (k <= 5), 0)::DOUBLE AS hit_at_5 FROM r GROUP BY 1""")
def hit_at_k(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    best = d.select("source", "quality", k.alias("k")).where("k <= 5").groupBy("source")
    return best.agg(F.coalesce(F.max(F.when(F.col("k") == 1, F.col("quality"))), F.lit(0)).cast("double").alias("hit_at_1"), F.max("quality").cast("double").alias("hit_at_5"))


# the tables after mutations


@query("SELECT c_custkey AS source, coalesce(max(o_orderkey), -1) AS snapshot, count(o_orderkey) = 0 AS taken_now FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def checkpoint(spark, sf):
    """The latest snapshot of every source; those without one get one now (-1)."""
    latest = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.max("o_orderkey").alias("snapshot"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source")).join(latest, "source", "left")
    return c.select("source", F.coalesce("snapshot", F.lit(-1)).alias("snapshot"), F.col("snapshot").isNull().alias("taken_now"))


@query("""WITH m AS (SELECT o_custkey AS source, min(o_orderkey) AS mark FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT o_custkey AS source, max(o_orderkey) AS mark FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT source, greatest(m.mark, a.mark) AS mark FROM m FULL JOIN a USING (source)""")
def read_markers(spark, sf):
    """Markers after later ones are set: a marker never goes back."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("mark"))
    had = o.where("mark % 2 = 0").groupBy("source").agg(F.min("mark").alias("mark"))
    asked = o.where("mark % 3 = 0").groupBy("source").agg(F.max("mark").alias("mark"))
    return had.unionAll(asked).groupBy("source").agg(F.max("mark").alias("mark"))


@query("""WITH m AS (SELECT o_custkey AS source, min(o_orderkey) AS mark FROM orders GROUP BY 1) SELECT source, count(*) FILTER (o_orderkey > mark) AS unread, max(o_orderkey) AS newest FROM orders JOIN m ON o_custkey = source GROUP BY 1""")
def unread_since_marker(spark, sf):
    """Snapshots after each source's read marker, and the marker that a commit would set; sources are combined before the shuffle."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), "o_orderkey")
    marks = o.groupBy("source").agg(F.min("o_orderkey").alias("mark"))
    return o.join(marks, "source").groupBy("source").agg(F.count_if(F.col("o_orderkey") > F.col("mark")).alias("unread"), F.max("o_orderkey").alias("newest"))


@query("""WITH have AS (SELECT doc_id, 'm@64' AS signature, 1 AS version FROM documents WHERE doc_id % 2 = 0), put AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'm@64' ELSE 'n@32' END AS signature, 2 AS version FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, signature, max(version) AS version FROM (FROM have UNION ALL FROM put) GROUP BY 1, 2""")
def embeddings_upserted(spark, sf):
    """One vector for each chunk and signature; the later one replaces the former."""
    d = table(spark, sf, "documents").select("doc_id")
    have = d.where("doc_id % 2 = 0").select("doc_id", F.lit("m@64").alias("signature"), F.lit(1).alias("version"))
    put = d.where("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "m@64").otherwise("n@32").alias("signature"), F.lit(2).alias("version"))
    return have.unionAll(put).groupBy("doc_id", "signature").agg(F.max("version").alias("version"))


@query("""SELECT event_type AS entity, count(*) AS mentions, count(DISTINCT user_id) AS sources, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1""")
def hotness_counters(spark, sf):
    """Counters of an entity after two batches: totals add up, sources are counted once, times move forward."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("entity"), "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 2).alias("batch"))
    by_source = e.groupBy("entity", "user_id", "batch").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    return by_source.groupBy("entity").agg(F.sum("n").alias("mentions"), F.countDistinct("user_id").alias("sources"), F.max("at").alias("last_ms"))


@query(f"WITH {MEM}, paths AS (SELECT DISTINCT 'raw/' || scope || '/' || doc_id || '.md' AS path, doc_id FROM mem) SELECT path FROM paths WHERE doc_id % 3 <> 0")
def newly_ingested_paths(spark, sf):
    """Paths that a mark of all adds; those marked before stay as they were."""
    paths = memory_chunks(spark, sf).select(F.concat(F.lit("raw/"), "scope", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "doc_id").distinct()
    return paths.join(paths.where("doc_id % 3 = 0").select("path"), "path", "left_anti").select("path")


@query("SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings WHERE label IS NOT NULL AND label <> 3 GROUP BY 1 ORDER BY label")
def vector_namespaces(spark, sf):
    """Namespaces with their vectors after one of them is cleared."""
    return table(spark, sf, "embeddings").where("label is not null and label <> 3").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).orderBy("label")


@query("SELECT user_id, count(*) AS calls, round((sum(event_id % 1000) * 0.07 + sum(event_id % 77) * 0.28) / 1000000, 9) AS cost FROM events GROUP BY 1")
def audit_costs(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 1000).alias("i"), F.sum(F.col("event_id") % 77).alias("o"))
    return e.select("user_id", "calls", F.round(N.cost_usd(F.col("i"), F.col("o")), 9).alias("cost"))


@query(f"WITH {MEM} SELECT id, CASE WHEN source_id LIKE 'src1:%' AND starts_with(source_id, 'src1:') THEN 'dropped' WHEN doc_id % 10 = 2 THEN 'sealed' ELSE status END AS status FROM mem WHERE lang <> 'de'")
def lifecycle_after(spark, sf):
    """Chunks after a status change, a drop by source prefix and a deletion by owner (here: the language)."""
    c = memory_chunks(spark, sf).where("lang <> 'de'")
    status = F.when(F.col("source_id").startswith("src1:"), "dropped").when(F.col("doc_id") % 10 == 2, "sealed").otherwise(F.col("status"))
    return c.select("id", status.alias("status"))


@query("""WITH t AS (SELECT 'chunk' AS kind, doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'm@64' ELSE 'n@32' END AS signature FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'summary', vec_id, CASE WHEN vec_id % 3 = 0 THEN 'm@64' ELSE 'n@32' END FROM embeddings WHERE vec_id % 5 = 0)
SELECT kind, id, signature FROM t WHERE signature <> 'm@64'""")
def tombstones_cleared(spark, sf):
    """Skip marks of chunks and summaries that are left after those of one signature are cleared."""

    def marks(name, key, kind, every, of):
        s = F.when(F.col(key) % of == 0, "m@64").otherwise("n@32")
        return table(spark, sf, name).where(F.col(key) % every == 0).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), s.alias("signature"))

    return marks("documents", "doc_id", "chunk", 7, 2).unionAll(marks("embeddings", "vec_id", "summary", 5, 3)).where("signature <> 'm@64'")


@query(f"WITH {SUMS} SELECT id, level, n_children, 'old' AS made FROM sums WHERE deleted UNION ALL SELECT id, level, n_children, 'new' FROM sums WHERE NOT deleted")
def summaries_inserted(spark, sf):
    """Insert or ignore: summaries that are there stay as they are."""
    s = summaries(spark, sf).select("id", "level", "n_children", "deleted")
    have, new = s.where("deleted").drop("deleted").withColumn("made", F.lit("old")), s.drop("deleted").withColumn("made", F.lit("new"))
    return have.unionAll(new.join(have.select("id"), "id", "left_anti").select(have.columns))


@query("SELECT DISTINCT 'tool-' || lower(event_type) AS namespace, lower(event_type) AS tool FROM events WHERE event_id % 2 = 0 ORDER BY tool")
def tool_namespaces(spark, sf):
    """Tools that have a namespace of rules; other namespaces are left out."""
    n = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("tool-"), F.lower("event_type"))).otherwise(F.col("event_type"))
    found = table(spark, sf, "events").select(n.alias("namespace")).where("namespace like 'tool-%'").distinct()
    return found.select("namespace", F.substr("namespace", F.lit(6)).alias("tool")).orderBy("tool")


@query("""WITH v AS (SELECT source || '/' || (doc_id // 3) AS id, doc_id % 3 AS version FROM documents), g AS (SELECT id, max(version) AS version FROM v WHERE version < 2 GROUP BY 1)
SELECT v.id || '@' || v.version AS gate, g.version IS NOT NULL AND v.version <= g.version AS ingested FROM v LEFT JOIN g USING (id)""")
def version_gates(spark, sf):
    """Whether a document's version was taken in already; a later one passes the gate."""
    d = table(spark, sf, "documents")
    v = d.select(F.concat("source", F.lit("/"), F.expr("doc_id div 3")).alias("id"), (F.col("doc_id") % 3).alias("version"))
    g = v.where("version < 2").groupBy("id").agg(F.max("version").alias("done"))
    return v.join(g, "id", "left").select(F.concat("id", F.lit("@"), "version").alias("gate"), F.coalesce(F.col("version") <= F.col("done"), F.lit(False)).alias("ingested"))


@query(f"""WITH RECURSIVE {MEM}, w AS MATERIALIZED (SELECT scope, token_count, row_number() OVER (PARTITION BY scope ORDER BY doc_id) AS k FROM mem WHERE status IN ('admitted', 'pending_extraction')),
r AS (SELECT scope, k, token_count, token_count AS acc, 1 AS items, 0::BIGINT AS batch FROM w WHERE k = 1 UNION ALL
  SELECT w.scope, w.k, w.token_count, CASE WHEN r.acc + w.token_count > 2000 OR r.items >= 32 THEN 0 ELSE r.acc END + w.token_count, CASE WHEN r.acc + w.token_count > 2000 OR r.items >= 32 THEN 0 ELSE r.items END + 1,
    r.batch + (r.acc + w.token_count > 2000 OR r.items >= 32)::INT FROM r JOIN w ON w.scope = r.scope AND w.k = r.k + 1)
SELECT scope, batch, count(*) AS n, sum(token_count)::BIGINT AS tokens FROM r GROUP BY 1, 2""")
def pending_batches(spark, sf):
    """Chunks that wait, in order, in batches within a budget of 2,000 tokens and 32 chunks; a larger chunk is one alone."""
    c = memory_chunks(spark, sf).where("status in ('admitted', 'pending_extraction')").select("scope", "doc_id", "token_count")
    b = batches.restarting(c, "scope", ["doc_id"], "token_count", 2000, most_items=32)
    return b.groupBy("scope", "batch").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


@query(f"WITH {MEM} SELECT scope, count(*) AS flushed, max(timestamp_ms) AS newest_ms FROM mem WHERE status = 'buffered' AND scope NOT IN ('src0', 'src2') GROUP BY 1")
def forced_flush(spark, sf):
    """Buffers of live trees sealed whatever they hold; archived trees take nothing."""
    archived = spark.createDataFrame([("src0",), ("src2",)], "scope string")
    b = memory_chunks(spark, sf).where("status = 'buffered'").join(F.broadcast(archived), "scope", "left_anti")
    return b.groupBy("scope").agg(F.count("*").alias("flushed"), F.max("timestamp_ms").alias("newest_ms"))


@query("SELECT l_orderkey AS node, 'organization:' || l_suppkey AS entity, max(l_quantity) AS score FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1, 2 ORDER BY node, score DESC, entity")
def entities_of_node(spark, sf):
    """Distinct entities of each node, the best score first."""
    li = table(spark, sf, "lineitem").where("l_orderkey % 10 = 0")
    return li.groupBy(F.col("l_orderkey").alias("node"), F.concat(F.lit("organization:"), "l_suppkey").alias("entity")).agg(F.max("l_quantity").alias("score")).orderBy("node", F.desc("score"), "entity")


@query("SELECT l_suppkey AS entity, list_sort(list(DISTINCT tree)) AS trees FROM (SELECT l_suppkey, nullif(l_returnflag, 'N') AS tree FROM lineitem) WHERE tree IS NOT NULL GROUP BY 1")
def trees_of_entity(spark, sf):
    """The trees that mention an entity; rows without a tree are left out."""
    tree = F.nullif("l_returnflag", F.lit("N"))
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), tree.alias("tree")).where("tree is not null")
    return li.groupBy("entity").agg(F.array_sort(F.collect_set("tree")).alias("trees"))


@query("""WITH o AS (SELECT o_custkey % 10 AS source, o_orderkey AS item, o_totalprice AS content FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_custkey % 10 AS source, o_orderkey AS item, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS content FROM orders WHERE o_orderkey % 6 <> 0),
d AS (SELECT source, count(*) FILTER (o.item IS NULL) AS added, count(*) FILTER (n.item IS NULL) AS removed, count(*) FILTER (o.content <> n.content) AS modified FROM o FULL JOIN n USING (source, item) GROUP BY source)
SELECT count(*) AS sources, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, sum(modified)::BIGINT AS modified FROM d""")
def diff_totals(spark, sf):
    """Changes of all sources together, from a summary of each."""
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("source"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("content"))
    old = rows.where("item % 4 <> 0").withColumnRenamed("content", "was")
    new = rows.where("item % 6 <> 0").withColumn("now", F.when(F.col("item") % 5 == 0, 0.0).otherwise(F.col("content"))).drop("content")
    both = old.join(new, ["source", "item"], "full")
    each = both.groupBy("source").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"), F.count_if(F.col("was") != F.col("now")).alias("modified"))
    return each.agg(F.count("*").alias("sources"), *[F.sum(c).alias(c) for c in ("added", "removed", "modified")])


@query("SELECT user_id, max(epoch_us(ts) // 1000) FILTER (event_type <> 'error') AS last_success_ms, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1")
def latest_success(spark, sf):
    at, failed = F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_type") == "error"
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(~failed, at)).alias("last_success_ms"), F.count_if(failed).alias("failures"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' || event_id END AS said, CASE event_id % 2 WHEN 0 THEN ['x', 'y'] ELSE ['z'] END AS items FROM events")
def json_first(spark, sf):
    """The first string, and the first array, among several paths of a JSON value."""
    e = F.col("event_id")
    said = F.when(e % 3 == 0, F.concat(F.lit('"name":"a'), e, F.lit('",'))).when(e % 3 == 1, F.concat(F.lit('"name":"","data":{"title":"b'), e, F.lit('"},'))).otherwise("")
    items = F.when(e % 2 == 0, F.lit('"items":["x","y"]')).otherwise(F.lit('"items":null,"results":["z"]'))
    value = F.concat(F.lit("{"), said, items, F.lit("}"))
    found = F.coalesce(*[F.nullif(F.get_json_object(value, p), F.lit("")) for p in ("$.name", "$.data.title")])
    listed = F.coalesce(*[F.from_json(F.get_json_object(value, p), "array<string>") for p in ("$.items", "$.results")])
    return table(spark, sf, "events").select("event_id", found.alias("said"), listed.alias("items"))
