"""Merkle manifest of a dataset: a tree of hashes for each partition of the rows, one tree over their roots, and a proof for each row.

Rows get their place in their tree from a range partitioning, a count of each range and a sum of the counts before it.
Consecutive runs of 512 nodes fold nine levels in one group, which stores for every parent the concatenated hashes of
its children, the parent's preimage. The groups' roots are the nodes of the next round, until each tree has one. Proofs
are made from the top down: a group joins the steps above its own root, every node takes the preimages of its ancestors
in the group, excises its own 64 characters from each and keeps what is left. A proof is folded by splicing a hash into
what is left, level by level. A tree of 10^12 rows takes five rounds; no group holds more than 512 nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import staged

LEVELS = 9
DIGEST = 64  # characters of a hash
STEPS = "array<struct<slot:int,rest:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value's text after its length in bytes and a colon; - for null. What is framed can be told apart when it is concatenated."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_leaf(*values: Column) -> Column:
    return digest(F.concat(*map(framed, values)))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, from 0 by order in their tree, and total, the tree's rows; at most one row of figures for each range and tree is summed."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    marked = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "leaves")  # the range's number, then 33 bits for the row's place in it
    marked = marked.withColumn("range", F.shiftrightunsigned("at", 33))
    counts = marked.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    all_of_tree = Window.partitionBy("tree")
    before = F.sum("n").over(all_of_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    figures = counts.select("tree", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(all_of_tree).alias("total"))
    return marked.join(figures, ["tree", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _folded(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, total, height, nodes, preimages, top) of runs of nodes: preimages holds for each folded level the concatenated child hashes of every parent."""
    out = nodes.groupBy("tree", F.shiftright("pos", levels).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "node", "carried"))).alias("nodes"), F.first("total").alias("total"))
    out = out.withColumn("height", F.when(F.col("total") > 1, F.least(F.length(F.bin(F.col("total") - 1)), F.lit(levels))).otherwise(0))
    out = out.withColumn("level0", F.transform("nodes", lambda x: x["node"]))
    for k in range(1, levels + 1):
        pairs = F.expr(f"transform(sequence(0, (size(level{k - 1}) - 1) div 2), i -> concat(level{k - 1}[2 * i], coalesce(get(level{k - 1}, 2 * i + 1), '')))")
        out = out.withColumn(f"preimages{k}", F.when(F.col("height") >= k, pairs).otherwise(F.array().cast("array<string>")))
        out = out.withColumn(f"level{k}", F.when(F.col("height") >= k, F.transform(f"preimages{k}", digest)).otherwise(F.col(f"level{k - 1}")))
    return out.select("tree", "block", "total", "height", "nodes", F.array(*[f"preimages{k}" for k in range(1, levels + 1)]).alias("preimages"), F.col(f"level{levels}")[0].alias("top"))


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The folded runs of all rounds, the leaves' first; a tree ends in the round in which its nodes are one run."""
    found = [staged(_folded(nodes, levels), "preimages")]
    while (found[-1].agg(F.max("total")).first()[0] or 0) > 2**levels:
        more = found[-1].where(F.col("total") > 2**levels)
        up = more.select("tree", F.col("block").alias("pos"), F.col("top").alias("node"), F.shiftright(F.col("total") + 2**levels - 1, levels).alias("total"), F.lit(None).cast("string").alias("carried"))
        found.append(staged(_folded(up, levels), "preimages"))
    return found


def _ended(rounds: list[DataFrame], levels: int) -> DataFrame:
    done = [x.where(F.col("total") <= 2**levels).select("tree", F.col("top").alias("subroot")) for x in rounds]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


#: A node's steps in its run: the ancestors' preimages without the node's own slot, then the steps above the run's root.
_INLINE = f"""inline(transform(nodes, (x, j) -> named_struct('pos', x.pos, 'node', x.node, 'carried', x.carried, 'steps', concat(
  transform(slice(preimages, 1, height), (p, k) -> named_struct('slot', shiftright(j, k) & 1, 'rest',
    concat(substring(p[shiftright(j, k + 1)], 1, {DIGEST} * (shiftright(j, k) & 1)), substring(p[shiftright(j, k + 1)], {DIGEST} * (shiftright(j, k) & 1) + {DIGEST + 1})))), above))))"""


def _down(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, node, carried, steps, subroot, root) of the leaves; tops: (tree, above, subroot, root) with the steps above each tree's root."""
    found = None
    for k, runs in reversed(list(enumerate(rounds))):
        above = runs.where(F.col("total") <= 2**levels).select("tree", "block").join(tops, "tree")
        if found is not None:
            above = above.unionByName(found.select("tree", F.col("pos").alias("block"), F.col("steps").alias("above"), "subroot", "root"))
        found = runs.join(above, ["tree", "block"]).select("tree", "subroot", "root", F.expr(_INLINE))
        if k:
            found = staged(found, "steps")
    return found


def proofs(rows: DataFrame, tree: Column, order: list[Column], leaf: Column, carry: list[Column], levels: int = LEVELS) -> DataFrame:
    """The carried columns, leaf, steps, subroot and root of every row.

    tree: the partition that a row belongs to; its rows are leaves by order, then by leaf and by what is carried. Two
    consecutive nodes become the hash of both, a last odd one that of itself, until one remains. The roots by tree, null first and
    bytewise, become one root likewise. steps: (slot, rest) for each level from the leaf up: the preimage of the parent
    without the node's own hash, which stood at slot. A lone leaf has no steps in its tree. Equal rows are leaves of
    their own; nulls in order come first; an empty table has no leaves, and so no root.
    """
    key = F.coalesce(F.concat(F.lit("1"), tree.cast("string")), F.lit("0"))  # null first
    by = [c.alias(f"by{k}") for k, c in enumerate(order)]
    leaves = rows.select(key.alias("tree"), *by, leaf.alias("node"), F.struct(*carry).alias("carried"))
    nodes = _placed(leaves, [*[f"by{k}" for k in range(len(order))], "node", "carried"])
    rounds = _rounds(nodes, levels)
    subroots = staged(_ended(rounds, levels), "subroots")
    tops = _placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("carried"), F.col("subroot").alias("node")), ["carried"])
    top_rounds = _rounds(tops, levels)
    nothing = F.array().cast(STEPS)
    root = _ended(top_rounds, levels).select("tree", nothing.alias("above"), "subroot", F.col("subroot").alias("root"))
    of_trees = staged(_down(top_rounds, root, levels).select(F.col("carried").alias("tree"), F.col("steps").alias("above"), F.col("node").alias("subroot"), "root"), "tops")
    out = _down(rounds, of_trees, levels)
    return out.select("carried.*", F.col("node").alias("leaf"), "steps", "subroot", "root")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    spliced = lambda node, x: F.concat(F.substring(x["rest"], F.lit(1), x["slot"] * DIGEST), node, F.substring(x["rest"], x["slot"] * DIGEST + 1, F.lit(2**31 - 1)))
    return F.aggregate(steps, leaf, lambda node, x: digest(spliced(node, x)))


def siblings(steps: Column) -> Column:
    """The siblings' hashes of a proof, concatenated from the leaf up."""
    return F.array_join(F.transform(steps, lambda x: x["rest"]), "")


def document_proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document, in trees by lang.

    folded_root is made from the row as it would be found later: where 7 divides the CRC-32 of doc_id's decimal digits,
    n_chars is one more than it was (a null stays; so does the largest long, which is then read as null).
    """
    fields = lambda n_chars: row_leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    found_later = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), fields(F.try_add("n_chars", F.lit(1))))
    made = proofs(docs, F.col("lang"), [F.col("doc_id")], fields(F.col("n_chars")), [F.col("doc_id"), found_later.alias("other")])
    made = made.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("steps")))
    return made.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("steps"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same in DuckDB SQL: levels by a recursion, the siblings of each leaf as rows, and a second recursion that folds them.
SQL = """
WITH RECURSIVE d AS (
  SELECT *, coalesce('1' || lang, '0') AS tree,
    list_reduce([ascii(x) FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, b: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(c, b)), 4294967295) AS crc
  FROM documents),
h AS MATERIALIZED (
  SELECT doc_id, tree, sha256(s || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || t) AS leaf,
    sha256(s || coalesce(CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END, strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || t) AS later
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS s,
    coalesce(strlen(text) || ':' || text, '-') AS t FROM d)),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
up AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 2),
r AS MATERIALIZED (SELECT tree, lvl AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM r
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY lvl, pos // 2),
steps AS MATERIALIZED (
  SELECT l.doc_id, l.leaf, u.lvl AS step, (l.pos >> u.lvl) % 2 AS slot, coalesce(s.h, '') AS rest
  FROM l JOIN up u ON u.tree = l.tree AND u.n > 1 AND u.pos = l.pos >> u.lvl LEFT JOIN up s ON s.tree = u.tree AND s.lvl = u.lvl AND s.pos = xor(u.pos, 1)
  UNION ALL SELECT l.doc_id, l.leaf, r.height + u.lvl, (r.pos >> u.lvl) % 2, coalesce(s.h, '')
  FROM l JOIN r USING (tree) JOIN top u ON u.n > 1 AND u.pos = r.pos >> u.lvl LEFT JOIN top s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1)),
f AS (
  SELECT doc_id, leaf, later AS h, 0 AS step FROM l
  UNION ALL SELECT f.doc_id, f.leaf, sha256(CASE WHEN slot = 0 THEN f.h || rest ELSE rest || f.h END), f.step + 1 FROM f JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.step = f.step),
p AS (SELECT doc_id, leaf, sha256(string_agg(rest, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY ALL)
SELECT l.doc_id, l.leaf, r.subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM l JOIN r USING (tree) JOIN (SELECT doc_id, leaf, arg_max(h, step) AS h FROM f GROUP BY ALL) f ON f.doc_id = l.doc_id AND f.leaf = l.leaf LEFT JOIN p ON p.doc_id = l.doc_id AND p.leaf = l.leaf"""
