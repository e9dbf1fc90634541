"""Queries over what documents say: entities, relations, decisions. Registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import extraction, json_redaction, text_diff
from lodestack.plans.catalogue import query
from lodestack.sources.adapters import table
from lodestack.sources.transcripts import turns


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, title, text, tags): every order as a mail of its customer to its suppliers, with a heading, fields and a statement a line."""
    mail = lambda n: F.concat(n, F.lit(" <"), F.lower(n), F.lit("@parts.example>"))
    supplier = F.concat(F.lit("Supplier#"), F.col("l_suppkey"))
    part = F.concat(F.lit("Order-"), F.col("l_orderkey"), F.lit(" depends_on Part-"), F.col("l_partkey"))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_set(mail(supplier))).alias("to"), F.array_sort(F.collect_list(part)).alias("parts"))  # an order's lines, a few
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("Customer#"), F.col("o_custkey")).alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("due"), "o_orderpriority", "o_orderstatus")
    lines = F.concat(
        F.array(F.concat(F.lit("From: "), mail(F.col("customer")))), F.when(F.col("to").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("To: "), F.array_join("to", ", ")))),
        F.array(F.concat(F.lit("# Order-"), "doc"), F.concat(F.lit("Owner: "), "customer"), F.concat(F.lit("- Due date: "), "due"), F.concat(F.lit("Preferred extraction mode to try first: "), "o_orderpriority"), F.concat(F.lit("I prefer "), "o_orderstatus", F.lit(" delivery."))),
        F.coalesce("parts", F.array().cast("array<string>")),
    )
    return o.join(held, "doc", "left").select("doc", F.concat(F.lit("Order "), F.col("doc")).alias("title"), F.array_join(lines, "\n").alias("text"), F.array(F.lit("order"), F.lit("decision")).alias("tags"))


_NOTES = """l AS (SELECT l_orderkey AS doc, 'SUPPLIER#' || l_suppkey AS supplier, 'PART-' || l_partkey AS part FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
o AS (SELECT o_orderkey AS doc, 'CUSTOMER#' || o_custkey AS customer, 'ORDER-' || o_orderkey AS item, strftime(o_orderdate, '%Y-%m-%d') AS due, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"""


@query(f"""WITH {_NOTES}
SELECT doc, customer AS subject, 'PERSON' AS subject_type, 'COMMUNICATES_WITH' AS predicate, supplier AS object, 'PERSON' AS object_type, 0.82::DOUBLE AS confidence, 1 AS evidence FROM (SELECT DISTINCT doc, supplier FROM l) JOIN o USING (doc)
UNION ALL SELECT doc, customer, 'PERSON', 'OWNS', item, 'WORK_ITEM', 0.94, 1 FROM o
UNION ALL SELECT doc, item, 'WORK_ITEM', 'HAS_DEADLINE', due, 'DATE', 0.92, 1 FROM o
UNION ALL SELECT doc, customer, 'PERSON', 'PREFERS', status || ' DELIVERY', 'TOPIC', 0.92, 1 FROM o
UNION ALL SELECT doc, item, 'WORK_ITEM', 'DEPENDS_ON', part, 'PROJECT', 0.87, count(*) FROM l JOIN o USING (doc) GROUP BY doc, item, part""")
def extracted_relations(spark, sf):
    """Who writes to whom, owns, prefers and depends on what, from the notes' lines."""
    relations = extraction.extract(order_notes(spark, sf))[1]
    return relations.select("doc", "subject", "subject_type", "predicate", "object", "object_type", "confidence", "evidence")


@query(f"""WITH {_NOTES}
SELECT doc, supplier AS name, 'PERSON' AS type, 0.95::DOUBLE AS confidence, 0 AS n_aliases FROM (SELECT DISTINCT doc, supplier FROM l)
UNION ALL SELECT doc, part, 'PROJECT', 0.87, 0 FROM (SELECT DISTINCT doc, part FROM l)
UNION ALL SELECT doc, unnest([customer, item, due, replace(item, '-', ' '), priority, status || ' DELIVERY']), unnest(['PERSON', 'WORK_ITEM', 'DATE', 'PROJECT', 'MODE', 'TOPIC']), unnest([0.95, 0.94, 0.92, 0.88, 0.88, 0.92]), 0 FROM o""")
def extracted_entities(spark, sf):
    """The people, items and dates of the notes."""
    return extraction.extract(order_notes(spark, sf))[0].select("doc", "name", "type", "confidence", F.size("aliases").alias("n_aliases"))


@query(f"""WITH {_NOTES}
SELECT doc, 'deadline|decision|order|preference' AS tags, replace(item, '-', ' ') || ' uses ' || priority AS decisions, customer || ' prefers ' || status || ' delivery' AS preferences, 'profile' AS kind FROM o""")
def enriched_notes(spark, sf):
    """The notes with the tags and the kind that what they say gives them."""
    notes = order_notes(spark, sf).withColumn("kind", F.lit(None).cast("string"))
    facts = extraction.facts_of(notes)
    told = facts.select("doc", F.array_join("decisions", "|").alias("decisions"), F.array_join("preferences", "|").alias("preferences"))
    return extraction.enriched(notes, facts).join(told, "doc").select("doc", F.array_join("tags", "|").alias("tags"), "decisions", "preferences", "kind")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, place, line): conversations as session logs, with a broken line before each."""
    c = table(spark, sf_dir, "conversations")
    body = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))
    said = F.to_json(F.struct(F.col("role").alias("type"), body.alias("message"), F.concat(F.lit("/work/"), F.col("conv_id") % 7).alias("cwd"), F.concat(F.lit("s"), "conv_id").alias("sessionId")))
    place = F.col("turn").cast("long") * 2
    rows = c.select(F.concat(F.lit("log-"), "conv_id").alias("path"), F.explode(F.array(F.struct(place.alias("place"), F.substring(said, 1, 9).alias("line")), F.struct((place + 1).alias("place"), said.alias("line")))).alias("x"))
    return rows.select("path", "x.*")


_SAID = r"""said AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
heard AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text[1:200] END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context,
  regexp_matches(lower(text), '^(no,|no |nope|actually|wait|stop|don''t|dont|instead|revert|undo|that''s wrong|thats wrong|not like that)|not what i|do it again|that''s not') AS back FROM said)"""


@query(f"""WITH {_SAID}
SELECT 'log-' || conv_id AS path, turn * 2 + 1 AS place, CASE WHEN back THEN 1 ELSE 2 END AS tier,
  CASE WHEN NOT back THEN 'user: ' || text WHEN context IS NULL THEN 'user (interrupt): ' || text ELSE 'user (interrupting agent that said "' || context || '"): ' || text END AS excerpt FROM heard WHERE role = 'user'""")
def transcript_turns(spark, sf):
    """What users said in the logs, with what they interrupted."""
    return turns(_logs(spark, sf))[0].select("path", "place", "tier", "excerpt")


@query("SELECT 'log-' || conv_id AS path, '/work/' || (conv_id % 7) AS scope, 's' || conv_id AS session, count(*) AS broken FROM conversations GROUP BY conv_id")
def transcript_logs(spark, sf):
    """Scope, session and broken lines of each log."""
    return turns(_logs(spark, sf))[1].select("path", "scope", "session", "broken")


@query("""SELECT o_orderkey, '{"order":' || o_orderkey || ',"owner":{"access_token":"[REDACTED_SECRET]","Pass-Words":"[REDACTED_SECRET]","kept":[1,{"a":null}]},"items":["' || o_orderpriority || '",{"session key":"[REDACTED_SECRET]","keys":"' || o_orderstatus || '"}]}' AS body,
  3 AS key_redactions, 0 AS text_redactions, 0 AS depth_redactions FROM orders""")
def json_sanitized(spark, sf):
    """Orders as JSON with spaces between tokens, tokens and passwords among them."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    o = o.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")  # a small file holds work for all tasks
    body = F.concat(
        F.lit('{ "order": '), "o_orderkey", F.lit(',\n "owner": {"access_token": "t'), "o_custkey", F.lit('", "Pass-Words": [1, {"key": "}"}, [ ]], "kept": [1, {"a": null}]}, "items": ["'), "o_orderpriority",
        F.lit('", {"session key": {"x": "'), "o_orderstatus", F.lit('"}, "keys": "'), "o_orderstatus", F.lit('"} ] }'),
    )
    return json_redaction.sanitized(o.select("o_orderkey", body.alias("body")), "o_orderkey", "body")


@query(r"""WITH d AS (SELECT doc_id AS item, coalesce(text, '') AS text FROM documents WHERE doc_id % 2 = 0), l AS (SELECT item, text, CASE WHEN text = '' THEN [] WHEN text[-1:] = chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines FROM d),
h AS (SELECT *, least(3, len(lines)) AS c, text[-1:] <> chr(10) AND len(lines) <= 3 AS open FROM l)
SELECT item, ('@@ -' || CASE WHEN c = 0 THEN '0,0' ELSE '1,' || c END || ' +1,' || (c + 1) || ' @@' || chr(10) || '+version 2' || chr(10) || list_aggregate(list_transform(lines[1:c], lambda x: ' ' || x || chr(10)) || [''], 'string_agg', '')
  || CASE WHEN open AND c > 0 THEN '\ No newline at end of file' || chr(10) ELSE '' END)[1:2000] AS patch FROM h""")
def snapshot_patches(spark, sf):
    """Patches between two snapshots of documents: every second one gets a first line, the others stay."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), "text")
    new = d.withColumn("text", F.when(F.col("item") % 2 == 0, F.concat(F.lit("version 2\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    return text_diff.patches(d, new, "item", "text")
