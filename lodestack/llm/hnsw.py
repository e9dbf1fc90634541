"""Embedding near-dedup on hierarchical navigable small-world graphs, one per shard of a label.

A label's vectors are dealt by id to shards of bounded size; each shard becomes one graph, and each shard's vectors are
one block of queries. Every block queries every shard of its label. A search walks the graph for all queries of a block
in step, so each step is a few array operations. How wide beams are is audited. When a graph is made, queries are
planted just inside the bound around random vectors of it; beams widen until the walks find what a scan finds for them.
When a block asks, some of its queries are scanned too, and beams widen until no link of theirs is missed; a beam that
ends with nothing but links in it is widened in any case. Candidates are verified in double precision. A task returns
counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import staged
from lodestack.llm.components import components

SHARD_ROWS = 4_096
DEGREE = 16
BUILD_BEAM = 48
FIRST_BEAM = 32
AUDIT_QUERIES = 64  # of a block, that are scanned besides
AUDIT_LINKS = 2_000  # planted links of a graph at least, so that one in two thousand shows
AUDIT_RECALL = 1.0
NEAR = 2e-4  # how far inside the bound planted queries are
RUN = 16  # blocks of queries that one task takes to a graph, which is sent once for all of them
SCAN_FROM = 16  # a beam of more than one in so many vectors is not walked any more: the shard is scanned
SLACK = 1e-4  # single precision may be off by less


def _search(vectors: np.ndarray, near: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of each query's beam, best first, -1 where it isn't full; entries: (queries, any number) of node ids."""
    n, q = len(near), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -2.0, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    active, fresh = np.arange(q), entries
    while len(active):
        fresh = np.where(fresh < 0, n, fresh)
        fresh.sort(axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        new = ~seen[active[:, None], fresh]
        seen[active[:, None], fresh] = True
        found = np.einsum("qkd,qd->qk", vectors[np.where(new, fresh, 0)], queries[active])
        found[~new] = -2.0
        all_sims = np.concatenate([sims[active], found], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        take = lambda x: np.take_along_axis(x, order, 1)  # noqa: E731, B023
        sims[active] = take(all_sims)
        ids[active] = take(np.concatenate([ids[active], np.where(new, fresh, -1)], 1))
        done[active] = take(np.concatenate([done[active], ~new], 1))
        open_ = ~done[active]
        left = open_.any(1)
        active, open_ = active[left], open_[left]
        if not len(active):
            break
        rank = np.cumsum(open_, 1)
        pick = open_ & (rank <= wide)
        done[active] |= pick
        chosen = np.full((len(active), wide), -1, np.int64)
        r, c = np.nonzero(pick)
        chosen[r, rank[r, c] - 1] = ids[active[r], c]
        fresh = np.where(chosen[:, :, None] >= 0, near[np.maximum(chosen, 0)], -1).reshape(len(active), -1).astype(np.int64)
    return ids, sims


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to degree of each row's candidates, best first, none nearer to a chosen one than to the row's own; the nearest others fill up."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    between = np.einsum("qad,qbd->qab", v := vectors[np.maximum(ids, 0)], v)
    chosen = np.zeros(ids.shape, bool)
    worst = np.full(ids.shape, -2.0, np.float32)  # highest cosine to a chosen one
    for k in range(ids.shape[1]):
        ok = (ids[:, k] >= 0) & (worst[:, k] < sims[:, k]) & (chosen.sum(1) < degree)
        chosen[:, k] = ok
        worst = np.where(ok[:, None], np.maximum(worst, between[:, k]), worst)
    spare = (ids >= 0) & ~chosen
    chosen |= spare & (np.cumsum(spare, 1) + chosen.sum(1, keepdims=True) <= degree)
    out = np.full((len(ids), degree), -1, np.int64)
    r, c = np.nonzero(chosen)
    out[r, (np.cumsum(chosen, 1) - 1)[r, c]] = ids[r, c]
    return out


def _join_in(vectors: np.ndarray, near: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Links new nodes with the chosen of their candidates, both ways; full lists are chosen anew."""
    near[new] = _diverse(vectors, ids, sims, near.shape[1])
    to, by = near[new].ravel(), np.repeat(new, near.shape[1])
    to, by = to[to >= 0], by[to >= 0]
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    at, first, count = np.unique(to, return_index=True, return_counts=True)
    extra = np.full((len(at), count.max() if len(at) else 0), -1, np.int64)
    row = np.repeat(np.arange(len(at)), count)
    extra[row, np.arange(len(to)) - first[row]] = by
    for i in range(0, len(at), 256):
        a = at[i : i + 256]
        cand = np.sort(np.concatenate([near[a], extra[i : i + 256]], 1), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        s = np.einsum("qkd,qd->qk", vectors[np.maximum(cand, 0)], vectors[a])
        near[a] = _diverse(vectors, cand, np.where(cand >= 0, s, -2).astype(np.float32), near.shape[1])


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7) -> list[np.ndarray]:
    """Neighbour lists by level, the upper ones first; level k holds the first rows of vectors, as many as its list is long."""
    n, sizes = len(vectors), [len(vectors)]
    while sizes[-1] > 4 * degree:
        sizes.append(max(1, sizes[-1] // degree))
    levels: list[np.ndarray] = []
    for depth, size in enumerate(reversed(sizes)):
        near = np.full((size, degree * (2 if size == n else 1)), -1, np.int64)
        start = min(size, 4 * degree)
        g = vectors[:start] @ vectors[:start].T
        np.fill_diagonal(g, -2)
        every = np.broadcast_to(np.arange(start), (start, start)).copy()
        every[np.eye(start, dtype=bool)] = -1
        near[:start] = _diverse(vectors, every, g.astype(np.float32), near.shape[1])
        at = start
        while at < size:
            new = np.arange(at, min(size, 2 * at, at + 128))
            ids, sims = _search(vectors, near[:at], vectors[new], _descend(vectors, levels[:depth], vectors[new], at), beam)
            inside = vectors[new] @ vectors[new].T
            np.fill_diagonal(inside, -2)
            mates = np.argsort(-inside, axis=1)[:, :degree]
            ids = np.concatenate([ids, np.where(mates != np.arange(len(new))[:, None], new[mates], -1)], 1)
            sims = np.concatenate([sims, np.take_along_axis(inside, mates, 1).astype(np.float32)], 1)
            _join_in(vectors, near, new, ids, np.where(ids >= 0, sims, -2).astype(np.float32))
            at = int(new[-1]) + 1
        levels.append(near)
    return levels


def _descend(vectors: np.ndarray, upper: list[np.ndarray], queries: np.ndarray, inserted: int) -> np.ndarray:
    entry = np.zeros((len(queries), 1), np.int64)
    for near in upper:
        ids, _ = _search(vectors, near, queries, entry, 4, 1)
        entry = np.where(ids < inserted, ids, -1)
    return entry


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    scale = np.abs(raw).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    raw = raw / scale
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _verified(index: np.ndarray, queries: np.ndarray, r: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with a cosine of least or more in double precision."""
    good = np.concatenate([np.einsum("id,id->i", queries[r[i : i + 65_536]], index[c[i : i + 65_536]]) for i in range(0, len(r), 65_536)] or [np.zeros(0)]) >= least
    return r[good], c[good]


def _wider(beam: int, rows: int) -> int:
    """The next beam; in the end one for all rows, which is a scan."""
    return 2 * beam if 2 * beam * SCAN_FROM < rows else rows


def _walk(low: np.ndarray, levels: list[np.ndarray], q32: np.ndarray, todo: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, index rows) of the pairs that a search with this beam meets, single precision; a beam that holds nothing but links is widened."""
    rows: list[np.ndarray] = [np.zeros(0, int)]
    cols: list[np.ndarray] = [np.zeros(0, int)]
    wide = beam
    while len(todo):
        again = []
        step = max(16, 8_000_000 // (len(low) + wide * 16))
        for i in range(0, len(todo), step):
            part = todo[i : i + step]
            if wide >= len(low):
                r, c = np.nonzero(q32[part] @ low.T >= least - SLACK)
                rows.append(part[r])
                cols.append(c)
                continue
            ids, sims = _search(low, levels[-1], q32[part], _descend(low, levels[:-1], q32[part], len(low)), wide)
            narrow = sims[:, -1] >= least - SLACK
            again.append(part[narrow])
            r, c = np.nonzero((sims >= least - SLACK) & (ids >= 0) & ~narrow[:, None])
            rows.append(part[r])
            cols.append(ids[r, c])
        todo = np.concatenate(again) if again else np.zeros(0, int)
        wide = _wider(wide, len(low))
    return np.concatenate(rows), np.concatenate(cols)


def _recall(found: tuple[np.ndarray, np.ndarray], true: tuple[np.ndarray, np.ndarray], rows: int) -> float:
    """The share of the true pairs that are found, 1 where there are none; rows: of the index."""
    want = np.unique(true[0] * rows + true[1])
    return float(np.isin(want, found[0] * rows + found[1]).mean()) if len(want) else 1.0


def audited_beam(index: np.ndarray, levels: list[np.ndarray], least: float) -> tuple[int, float]:
    """(beam, recall): the first beam whose walks find AUDIT_RECALL of the links of planted queries, in the end one that is a scan."""
    rng = np.random.default_rng(11)
    at = rng.integers(0, len(index), AUDIT_LINKS)
    side = rng.normal(size=(len(at), index.shape[1]))
    side -= np.einsum("id,id->i", side, index[at])[:, None] * index[at]
    length = np.linalg.norm(side, axis=1, keepdims=True)
    cos = min(1.0, least + NEAR)
    planted = cos * index[at] + np.sqrt(1 - cos * cos) * np.divide(side, length, out=np.zeros_like(side), where=length > 1e-9)
    low, q32, every = index.astype(np.float32), planted.astype(np.float32), np.arange(len(at))
    true = _verified(index, planted, *_walk(low, levels, q32, every, len(low), least), least)
    beam = FIRST_BEAM
    while beam < len(index):
        recall = _recall(_verified(index, planted, *_walk(low, levels, q32, every, beam, least), least), true, len(index))
        if recall >= AUDIT_RECALL:
            return beam, recall
        beam = _wider(beam, len(index))
    return len(index), 1.0


def range_search(index: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, least: float, same: bool = False, beam: tuple[int, float] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(query rows, index rows, audited recall) of all found pairs with a cosine of least or more; both inputs are unit vectors in double precision.

    Every query walks, with the graph's audited beam at first. AUDIT_QUERIES random ones are scanned besides; while a link
    of theirs is missed, all walk again with a wider beam; a query's link with itself (same: both inputs are one) is no evidence. The recall is the lower of that of the planted and of the scanned queries.
    """
    low, q32 = index.astype(np.float32), queries.astype(np.float32)
    width, recall = beam or audited_beam(index, levels, least)
    sample = np.random.default_rng(7).permutation(len(queries))[:AUDIT_QUERIES]
    true = _verified(index, queries, *_walk(low, levels, q32, sample, len(low), least), least)
    if same:
        true = true[0][other := true[0] != true[1]], true[1][other]
    while True:
        found = _verified(index, queries, *_walk(low, levels, q32, np.arange(len(queries)), width, least), least)
        seen = _recall(found, true, len(index))
        if seen == 1 or width >= len(index):
            return *found, min(recall, seen)
        width = _wider(width, len(index))


def _forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def _make(least: float):
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        v = unit(np.stack(pdf["embedding"].to_numpy()))
        levels = build(v.astype(np.float32))
        beam, recall = audited_beam(v, levels, least)
        first = pdf.iloc[0]
        keep = {"ids": pdf["rep"].to_numpy(np.int64), "n": pdf["n"].to_numpy(np.int64), "v": v}
        return pd.DataFrame({
            "label": [first["label"]], "dim": [first["dim"]], "shards": [first["shards"]], "shard": [first["shard"]],
            **{k: [x.tobytes()] for k, x in keep.items()},
            "graph": [[x.astype("<i4").tobytes() for x in levels]], "beam": [beam], "recall": [recall],
        })

    return make


def _ask(least: float):
    """A graph and a run of blocks of queries."""

    def ask(graph: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        x, out = graph.iloc[0], []
        ids, n, v = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["n"], np.int64), np.frombuffer(x["v"]).reshape(-1, int(x["dim"]))
        sizes = [len(v)]
        while len(sizes) < len(x["graph"]):
            sizes.append(max(1, sizes[-1] // DEGREE))
        levels = [np.frombuffer(g, "<i4").reshape(s, -1).astype(np.int64) for g, s in zip(x["graph"], sizes[::-1], strict=True)]
        for shard, q_ids, q_v in zip(blocks["block"], blocks["q_ids"], blocks["q_v"], strict=True):
            q_ids, q = np.frombuffer(q_ids, np.int64), np.frombuffer(q_v).reshape(-1, v.shape[1])
            r, c, recall = range_search(v, levels, q, least, x["shard"] == shard, (int(x["beam"]), float(x["recall"])))
            r, c = r[keep := q_ids[r] != ids[c]], c[keep]
            count = np.bincount(r, weights=n[c], minlength=len(q_ids)).astype(np.int64)
            roots = _forest(q_ids[r], ids[c])
            links = dict(zip(q_ids[np.unique(r)].tolist(), count[np.unique(r)].tolist(), strict=True))
            out.append(pd.DataFrame({"a": list(roots), "b": list(roots.values()), "n": [links.get(k, 0) for k in roots], "recall": recall}))
        return pd.concat(out)

    return ask


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) of every row; links join vectors of one label with a cosine of least or more.

    A null label, and a vector that is null, empty, zero or holds null or non-finite components, links with nothing; vectors
    of unlike length don't link. Equal vectors of a label are one node that stands for all of them, each linked with the
    others. Every row gets a result, repeated ids too (they count as copies); an empty table gives an empty result.
    audited_recall is the lowest of the audits of the vector's blocks and graphs, null where it links with nothing else.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("usable", usable).withColumn("key", F.when(F.col("usable"), F.sha2(F.concat_ws(",", v.cast("array<string>"), F.array("label")), 256)))
    reps = staged(rows.where("usable").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "vectors").withColumn("dim", F.size("embedding"))
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    graphs = staged(
        dealt.groupBy("label", "dim", "shards", "shard").applyInPandas(_make(least), "label string, dim int, shards int, shard int, ids binary, n binary, v binary, graph array<binary>, beam int, recall double"),
        "graphs",
    )
    keys = ["label", "dim", "shard", "run"]
    index = graphs.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(shards - 1) div {RUN}"))))
    asks = graphs.select("label", "dim", F.expr(f"shard div {RUN}").alias("run"), F.col("shard").alias("block"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    met = index.groupBy(keys).cogroup(asks.groupBy(keys)).applyInPandas(_ask(least), "a long, b long, n long, recall double")
    met = staged(met, "links")
    counts = met.groupBy("a").agg(F.sum("n").alias("found"), F.min("recall").alias("audited_recall"))
    groups = components(met, "a", "b")
    per = reps.select("key", "rep", "n").join(counts, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    per = per.select("key", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "audited_recall")
    linked = rows.where("usable").select("id", "key").join(per, "key").select("id", "n_links", "component_id", "audited_recall")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(None).cast("double").alias("audited_recall"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "audited_recall")
