"""Content sort, Merkle manifest and vector codes against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm.content_sort import _Runs, content_groups
from lodestack.llm.merkle import document_proofs, folded, proofs, siblings
from lodestack.llm.vector_codes import codebooks_digest, cuts, nearest, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, sha string, run long, body string, tree string, node string, kept boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 7, "x", 1, "b", "t", "n", False) for i, t, lang in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_content_groups(spark, keep):
    rng = np.random.default_rng(5)
    rows = [(i, f"same beginning of more than thirty-two bytes {int(rng.integers(0, 60))}", "en") for i in range(400)]
    rows += [(i, "one text of very many rows", "en") for i in range(1000, 1600)]  # spans ranges
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, " ", "en"), (None, "", "en"), (None, "only null", "en"), (None, "only null", "en"), (2003, "é" * 300_000, "en"), (2004, "é" * 300_000, "en")]
    rows += [(3000, "repeated row", "en")] * 3 + [(-(2**63), "least", "en"), (2**63 - 1, "least", "en")]
    got = content_groups(docs(spark, rows).repartition(7), keep=keep).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    pick = max if keep == "largest" else min
    want = {t: pick((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.text_sha256) for r in got) == sorted((i or 0, want[t or ""] or 0, len(groups[t or ""]), sha(t or "")) for i, t, _ in rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_content_groups_normalised_and_empty(spark):
    d = docs(spark, [(1, "A b", "en"), (2, "a B", "en"), (3, "a  b", "en")])
    assert sorted((r.doc_id, r.keep_id, r.text_sha256) for r in content_groups(d, normalise=F.lower).collect()) == [(1, 1, sha("a b")), (2, 1, sha("a b")), (3, 3, sha("a  b"))]
    assert content_groups(d.limit(0)).count() == 0


def test_runs_with_equal_hashes():
    runs, out = _Runs(3), []
    for key, text, i in [((b"p", 1), b"a", 1), ((b"p", 1), b"b", 1), ((b"p", 1), b"b", 2), ((b"q", 1), b"c", 5), ((b"r", 1), b"d", 5), ((b"r", 1), b"e", 5)]:
        out += runs.add(key, text, i)
    rows = [r for b in [*out, *runs.end()] for r in b.to_pylist()]
    assert [(r["id"], r["n"], r["top"], r["last"], r["run"] is not None, r["body"]) for r in rows] == [
        (1, 1, 1, True, True, b"a"), (1, 2, 2, False, True, None), (2, 2, 2, True, True, b"b"), (5, 1, 5, True, False, None), (5, 1, 5, True, True, b"d"), (5, 1, 5, True, True, b"e"),
    ]


def climb(nodes):
    """The root, and each node's siblings, by the plain rule."""
    at, proof = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, p in enumerate(at):
            if (q := p ^ 1) < len(nodes):
                proof[k].append((p & 1, nodes[q]))
            else:
                proof[k].append((p & 1, ""))
        nodes, at = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)], [p // 2 for p in at]
    return nodes[0], proof


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_proofs(spark, levels):
    sizes = {None: 1, "": 2, "a": 3, "b": 4, "é": 5, "z": 23}
    rows = [(tree, k, sha(f"{tree} {k}")) for tree, n in sizes.items() for k in range(n)]
    d = spark.createDataFrame(rows, "lang string, k long, h string")
    got = proofs(d, F.col("lang"), [F.col("k")], F.col("h"), [F.col("lang"), F.col("k")], levels)
    got = {(r.lang, r.k): r for r in got.withColumn("folded", folded(F.col("leaf"), F.col("steps"))).withColumn("siblings", siblings(F.col("steps"))).collect()}
    trees = sorted(sizes, key=lambda x: b"" if x is None else b"1" + x.encode())
    made = {t: climb([sha(f"{t} {k}") for k in range(sizes[t])]) for t in trees}
    root, above = climb([made[t][0] for t in trees])
    assert len(got) == len(rows)
    for (t, k), r in got.items():
        steps = made[t][1][k] + above[trees.index(t)]
        assert (r.subroot, r.root, r.folded, r.siblings) == (made[t][0], root, root, "".join(x for _, x in steps))
        assert [(s.slot, s.rest) for s in r.steps] == steps


def test_document_proofs_edges(spark):
    rows = [(i, f"text {i}", "en") for i in range(40)] + [(7, "text 7", "en"), (None, None, None), (50, "", None), (60, "é\n" * 200_000, "de"), (-5, "x", "")]
    got = document_proofs(docs(spark, rows)).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 4
    for r in got:
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.verified == (not tampered) and (r.folded_root == r.root) == r.verified
    frame = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    want = sorted(sha("".join(map(frame, (i, "s", lang, None if t is None else len(t), t)))) for i, t, lang in rows)
    assert sorted(r.leaf for r in got) == want
    assert document_proofs(docs(spark, rows).limit(0)).count() == 0
    one = document_proofs(docs(spark, [(3, "a", "en")])).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("")


def brute_codes(q, parts, entries, rounds):
    begins = cuts(q.shape[1], parts)
    books, codes, off = [], [], 0
    for a, b in zip(begins, begins[1:], strict=False):
        x, book = q[:, a:b], q[:entries, a:b].copy()
        for k in range(rounds + 1):
            far = ((x[:, None] - book[None]) ** 2).sum(2)
            code = far.argmin(1)
            if k < rounds:
                for e in range(len(book)):
                    if (code == e).any():
                        book[e] = [int(s) // int((code == e).sum()) for s in x[code == e].sum(0)]
        books.append(book)
        codes.append(code)
        off = off + far.min(1)
    return np.stack(codes, 1), off, books


@pytest.mark.parametrize("n", [1, 9, 700])
def test_vector_codes(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(size=(n, 20)), 1).astype(np.float32)  # ties
    v[n // 2 :: 3] = v[0]
    rows = [(i * 3, x.tolist(), None if i % 3 else "a\x00b", 5) for i, x in enumerate(v)]
    odd = [(-1, None, "a", 5), (-2, [], "a", 5), (-3, [float("nan")] * 20, "a", 5), (-4, [float("inf")] + [0.0] * 19, "a", 5), (-5, [None] * 20, "a", 5), (None, [0.5] * 20, "a", 5), (10**6, [0.5] * 7, "a", 5)]
    d = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label string, error int").repartition(5)
    made, books = vector_codes(d)
    got = {r.vec_id: (r.code, r.error, r.label) for r in made.collect()}
    codes, off, want = brute_codes(np.floor(v.astype(float) * 4096).astype(np.int64), 8, 16, 6)
    assert all((a == b).all() for a, b in zip(books, want, strict=True)) and codebooks_digest(books) == codebooks_digest(want)
    assert got == {i * 3: (codes[i].tolist(), int(off[i]), "0" if i % 3 else "1a\x00b") for i in range(n)}


def test_vector_codes_of_nothing_and_of_large_values(spark):
    schema = "vec_id long, embedding array<float>, label string"
    made, books = vector_codes(spark.createDataFrame([(1, None, "a")], schema))
    assert made.count() == 0 and books == []
    made, _ = vector_codes(spark.createDataFrame([(1, [3e38] * 64, "a"), (1, [-3e38] * 64, "a"), (2, [0.0] * 64, None)], schema), entries=1, rounds=0)
    assert sorted(r.error for r in made.collect()) == [0, 64 * 2**54, 64 * 2**56]


def test_partial_distances_stop_early():
    rng = np.random.default_rng(2)
    x, book = rng.integers(-9_000, 9_000, (3_000, 8)), rng.integers(-9_000, 9_000, (16, 8))
    far = ((x[:, None] - book[None]) ** 2).sum(2)
    entry, best, terms = nearest(x, book, rng.integers(0, 16, 3_000))
    assert (entry == far.argmin(1)).all() and (best == far.min(1)).all()
    assert nearest(x, book, entry)[2] < terms < 0.75 * x.size * 16
