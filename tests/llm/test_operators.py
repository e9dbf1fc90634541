"""Each operator against brute force, an exact round trip or held-out labels, with nulls, empty tables and clashing columns."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import queries as Q
from lodestack.llm.chat import format_trees, parse, paths
from lodestack.llm.common import vocabulary
from lodestack.llm.components import components
from lodestack.llm.decontam import leaks
from lodestack.llm.hnsw import build, embedding_groups, range_search, unit
from lodestack.llm.html_text import main_text
from lodestack.llm.piece_codec import PieceModel, encode_pieces
from lodestack.llm.quality import quality_scores, terms
from lodestack.llm.simhash import allocate, fingerprint, simhash_groups
from lodestack.llm.suffix_dedup import LoserTree, front_code, remove_repeats
from lodestack.llm.token_codec import decode_ids, encode_ids, read_tokens, token_digests, write_tokens
from lodestack.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, label int, component_id string, features string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, 1, "x", "y") for i, t in enumerate(texts)], DOCS)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (5, 5), (None, 3), (1, 2)], "a long, b long")
    assert {r.node: r.component for r in components(e, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert components(e.limit(0), "a", "b").count() == 0


def test_hnsw_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    v = np.concatenate([centres[rng.integers(0, 30, 400)] + 0.1 * rng.normal(size=(400, 16)), np.repeat(centres[:1], 5, 0)]).astype(np.float32)
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, v[0].tolist(), None)]
    got = {r.vec_id: r.n_links for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard_rows=60).collect()}
    u, label = unit(v), np.arange(len(v)) % 2
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    assert got == {i: int(near[i].sum()) - 1 for i in range(len(v))} | {900: 0, 901: 0, 902: 0, 903: 0}


def test_hnsw_walk_finds_sparse_links():
    rng = np.random.default_rng(1)
    some = lambda k: unit(rng.normal(size=(k, 128)))
    centre = some(1)
    index, queries = unit(centre + 0.032**0.5 * some(1_500)), unit(centre + 0.032**0.5 * some(1_500))  # one cloud of near misses
    audited = np.linspace(0, 1_499, 64).astype(int)
    at = rng.choice(np.setdiff1d(np.arange(1_500), audited), 200, replace=False)
    queries[at] = unit(index[rng.choice(1_500, 200, replace=False)] + 0.034**0.5 * some(200))
    r, c, recall = range_search(index, build(index.astype(np.float32)), queries, 0.98)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(queries @ index.T >= 0.98)), strict=True))
    assert len(want) >= 200 and set(zip(r.tolist(), c.tolist(), strict=True)) == want and recall == 1.0


def test_hnsw_walk_passes_on_evidence():
    rng = np.random.default_rng(12)
    index = unit(np.repeat(rng.normal(size=(150, 16)), 10, 0) + 0.02 * rng.normal(size=(1_500, 16)))
    r, c, recall = range_search(index, build(index.astype(np.float32)), index, 0.98, True)
    near = index @ index.T >= 0.98
    assert recall >= 0.999 and len(r) >= 0.999 * near.sum() and near[r, c].all()


def test_decontamination_slots(spark):
    item = "if Alice Smith walks 12 km in 3 hours then how far does Alice walk in 5 hours at this pace?"
    same = "Now if Robert Jones walks 14 km in 4 hours then how far does Robert walk in 6 hours at this pace?"
    other = same.replace("does Robert", "does Peter")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots > 0 for r in leaks(docs(spark, [f"So {item} ok", same, other, None, "", "unrelated words " * 9]), bench).collect()}
    assert got == {(0, 7): False, (1, 7): True}
    assert leaks(docs(spark, ["a"]).limit(0), bench).count() == 0


def test_decontamination_of_edited_and_partial_passages(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("bcdfghjklm"), 6)) for _ in range(600)]
    items = {n: [str(w) for w in rng.choice(words, n, replace=False)] for n in (4, 7, 10, 15, 20, 38)}
    texts, want = [], set()
    for n, item in items.items():
        h = n // 2
        edits = [item, item[:h] + ["qqqqqq"] + item[h + 1 :], item[:h] + ["qqqqqq"] + item[h:], item[:h] + item[h + 1 :], item[: 2 * n // 3], item[n // 2 :], item[: n // 4], item[::-1]]
        for k, e in enumerate(edits):
            if k == 0 or (k < 4 and n >= 15) or (k == 1 and n >= 10) or (k in (4, 5) and len(e) >= 13):
                want.add((len(texts), n))
            texts.append(" ".join(["zzzzz yyyyy", *e, "xxxxx wwwww"]))
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(docs(spark, texts), bench).collect()}
    assert want <= got and all(k // 8 == list(items).index(n) and k % 8 < 6 for k, n in got)


def test_simhash_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank while it rains " * 6
    texts = [base, base.upper(), base + "!", None, "", "   ", "one", "one two", base.replace("fox", "cat")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs(spark, texts)).collect()}
    fps = [fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        group = [min(group[j] for j in range(len(texts)) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3) for i in range(len(texts))]
    assert got == {i: (f"{fps[i] & (2**64 - 1):016x}", group[i]) for i in range(len(texts))}
    groups, most, _ = allocate(np.arange(1, 300, dtype=np.int64) * 0x9E3779B97F4A7, 1000, 3)
    assert sum(t + 1 for t in most) == 4 and sorted(b for g in groups for b in g) == list(range(64))
    assert simhash_groups(docs(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize(("score", "target"), [(toxicity_scores, "toxic"), (quality_scores, "quality")])
def test_classifiers_on_held_out_labels(spark, score, target):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = score(d, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (held["predicted"] == held[target]).mean() > 0.9
    few = score(docs(spark, ["a b", None, ""]), labels.limit(0))
    assert few.count() == 3 and few.where("score between 0 and 1").count() == 3


def test_quality_reads_whole_words():
    rng = np.random.default_rng(6)
    blob = "".join(rng.choice(list("abcXYZ019+/"), 5_000))
    for rest in ("aaaa", "????", "漢字。" * 40):
        assert terms(blob + rest, {}) != terms(blob, {})
    assert terms("aA9-aA9-a?", {}) != terms("aA9-aA9-a!", {})


def test_main_text_after_unclosed_boilerplate():
    text = "some words of the article that are long enough to be read as text"
    for tag, wrap in (("p", "article"), ("li", "ul")):
        page = f"<body><{wrap}><{tag}>One {text}<{tag} class=share>{text} x<{tag}>Two {text}</{wrap}><div class='ad'><p>buy</div><article><p>Three {text}</article>"
        assert all(f"{w} {text}" in main_text(page) for w in ("One", "Two", "Three")) and "buy" not in main_text(page)
    page = f"<body><div><div class=sidebar>gone</div><section><aside>gone<p>gone</section><section><p>Four {text}</section></div>"
    assert main_text(page) == f"Four {text}"
    kept = f"<h2 id='side-effects'>Side effects</h2><section id='related-work'><p>{text}</section><div class='notice-period'><p>{text}</div>"
    assert main_text(f"<body><article>{kept}</article>") == f"Side effects\n{text}\n{text}"


def test_main_text():
    page = "<html><head><title>T</title></head><body><nav><a href=/a>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p>One <b>two\n three<br>four<p>Five</article><div id=comments>hi</div><script>'</p>'</script><footer>f</footer>"
    assert main_text(page) == "Head & more\nOne two three four\nFive"
    assert main_text(None) == main_text("") == main_text("<div></div>") == ""


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1024, 1025, 9000):
        ids = np.minimum(rng.zipf(1.3, n), 65_535)
        payloads, checks = encode_ids(ids)
        assert (decode_ids(payloads, checks, n) == ids).all()
    with pytest.raises(ValueError, match="damaged"):
        decode_ids([payloads[0][:-1] + b"\xff", *payloads[1:]], checks, n)


def test_coder_takes_little_time():
    """op6: a group of a million ids took minutes of one core; both forms of a block, the largest ids too."""
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 65_536, 300_000), np.minimum(rng.zipf(1.4, 700_000), 65_535), np.full(100, 65_535), np.full(3, 255)])
    begun = time.process_time()
    payloads, checks = encode_ids(ids)
    assert (decode_ids(payloads, checks, len(ids)) == ids).all()
    assert time.process_time() - begun < 5 and {p[0] for p in payloads} == {0, 1}


def test_token_files(spark):
    got = sorted(tuple(r) for r in token_digests(docs(spark, ["Hello  World", None, "a"]), vocabulary("word_bpe_49k.json")).collect())
    assert [(g[0], g[1], g[2]) for g in got] == [(0, 0, 3), (1, 3, 1), (2, 4, 2)]


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.1), (1, 3, 1, "assistant", "</s>[INST]\\<|end|>", 0.9), (1, 4, 3, "user", "x", 0.5), (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    assert {(r.leaf, r.node) for r in paths(nodes).collect()} == {(2, 2), (2, 1), (4, 4), (4, 3), (4, 1)}
    roles, texts = parse(F.col("formatted"))
    best = format_trees(nodes).select("leaf", roles.alias("r"), texts.alias("t")).collect()
    assert [(b.leaf, b.r, b.t) for b in best] == [(4, ["user", "assistant", "user"], ["q", "</s>[INST]\\<|end|>", "x"])]


def test_loser_tree():
    rng = np.random.default_rng(1)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).tolist()) for _ in range(20)) for _ in range(5)]
    out = [(r, k, n) for r, k, n in LoserTree([front_code(r) for r in runs])]
    merged = [runs[r][k] for r, k, _ in out]
    assert merged == sorted(sum(runs, []))
    for a, b, (_, _, n) in zip(merged, merged[1:], out[1:], strict=False):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


@pytest.mark.parametrize("hot", [40_000, 1])
def test_suffix_dedup_against_brute_force(spark, hot):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdé"), 4)) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared, whole = text(60), text(90)
    texts = [text(50) + shared + text(30), shared + text(20), text(10) + shared, whole, whole, "xy" * 300, None, "", "short", text(300)]
    seen, data = collections.Counter(), [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    want = {}
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want[i] = (len(b), int(gone.sum()), int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs(spark, texts), hot_gram=hot).collect()}
    assert got == want


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "  a  b", "Hello   world\n\n  x\ty\r\n\r\r", "日本語 😀 ñandú", "a" * 300, "The fox's 12345 http://x.y/z?a=b", " lead ", "▁x"]
    model = PieceModel(path)
    for t, b in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(b, "<u2").tolist() == sp.encode(t)
        assert model.decode(b) == sp.decode(sp.encode(t))
    got = {r.doc_id: r.round_trip for r in encode_pieces(docs(spark, [*texts[:-1], None]), path).collect()}
    assert all(got.values()) and len(got) == len(texts)


def test_sentencepiece_query_returns_the_ids(spark):
    import sentencepiece

    import corpus_pipeline

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: sp.encode(r.text or "") for r in d.collect()}
    for out in (Q.op9_sentencepiece(spark, SF), corpus_pipeline.encode(spark, d, SF)):
        assert {r.doc_id: r.ids for r in out.collect()} == want


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_run(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0 or name == "op2_decontaminate"


def test_token_files_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000, None), (10_001, "")], "doc_id long, text string"))
    found = read_tokens(write_tokens(d, path, 3)).collect()
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in d.collect()}
    assert {r.doc_id: r.ids for r in found} == want
    start = 0
    digests = {r.doc_id: r for r in token_digests(d, path).collect()}
    for k in sorted(want):
        r = digests[k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[k]), zlib.crc32(np.array(want[k], "<u4").tobytes()))
        start += len(want[k])


def test_token_files_with_long_and_null_rows(spark):
    text = "some words of a long document that reaches over groups " * 300
    rows = [(None, "a"), (None, "a"), (5, text), (5, "b"), (6, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_digests(table, vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    spread = read_tokens(write_tokens(table, vocabulary("word_bpe_49k.json"), most=500), True).collect()  # the long text needs several groups
    assert {(r.n_tokens, r.ids_crc32) for r in spread} == {(r.n_tokens, r.ids_crc32) for r in got} and max(r.n_tokens for r in spread) > 1_000
    assert [r.doc_id for r in got] == [None, None, 5, 5, 6] and [r.n_tokens for r in got][-1] == 1
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(5)]
    assert token_digests(spark.createDataFrame([], "doc_id long, text string"), vocabulary("word_bpe_49k.json")).count() == 0


def test_range_coder_mixes_orders():
    rng = np.random.default_rng(8)
    ids = np.minimum(rng.zipf(1.5, 40_960), 65_535)
    _, n = np.unique(ids, return_counts=True)
    entropy = -(n / n.sum() * np.log2(n / n.sum())).sum() / 8
    assert sum(map(len, encode_ids(ids)[0])) / len(ids) < 1.2 * entropy  # each block learns anew
    again = np.tile(rng.integers(0, 49_000, 500), 200)
    assert sum(map(len, encode_ids(again)[0])) / len(again) < 1.0  # order 0 alone needs 1.12


def test_hnsw_walks_large_shards(spark):
    rng = np.random.default_rng(21)
    v = np.repeat(rng.normal(size=(500, 24)), 10, 0) + 0.03 * rng.normal(size=(5_000, 24))
    rows = [(i, x.tolist(), 1, "x") for i, x in enumerate(v.astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: r.n_links for r in embedding_groups(table, shard_rows=2_500).collect()}
    u = unit(v.astype(np.float32))
    assert got == {i: int(n) - 1 for i, n in enumerate((u @ u.T >= 0.98).sum(1))}
    assert embedding_groups(table.limit(0)).count() == 0
    again = embedding_groups(table.limit(20).unionAll(table.limit(20))).collect()
    assert len(again) == 40 and all(r.n_links >= 1 for r in again)


def test_sentencepiece_keeps_code_point_zero():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path)
    texts = ["\x00", "a\x00b", "\x00\x00 end", "x" * 70_000 + "\x00"]
    for t, b in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(b, "<u2").tolist() == sp.encode(t) and model.decode(b) == t


def test_simhash_fingerprint_by_definition():
    import xxhash

    def plain(text):
        words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for t in ("", "   ", "One", "one TWO", "A b C d e\x0bf\u00a0g ÄÖ", "a b c " * 50, "w" * 9):
        assert fingerprint(t) & (2**64 - 1) == plain(t)


def test_main_text_in_layouts():
    prose = "Some words of the article that are long enough to be taken for its main text, and some more of them. " * 6
    article = f"<h1>Head</h1><p>{prose}<p>{prose}"
    around = "<body><nav><a href=/>menu</a></nav>{}<footer>imprint</footer></body>"
    rest = "<div class=sidebar><ul><li><a href=x>one</a></ul></div><div class=share><a href=y>tweet</a></div><div id=comments><p>a reader says this</div>"
    want = f"Head\n{prose.strip()}\n{prose.strip()}"
    for start in ("div class='layout has-sidebar'", "div id=page class='site no-header'", "div class=content-with-sidebar", "section class=promo-article", "div class='sidebar'", "form id=aspnetForm", "div class='page menu'", "div class=x"):
        end = start.split()[0]
        assert main_text(around.format(f"<{start}><div>{article}</div>{rest}</{end}>")) == want, start
    for head in ("<div class='entry-header'><h1>Head</h1></div>", "<header><h1>Head</h1></header>", "<h1 class=banner>Head</h1>"):
        assert main_text(around.format(f"<article>{head}<p>{prose}<p>{prose}{rest}</article>")) == want, head
    assert main_text("<body><nav><a>x</a></nav><div class=menu><a>foo</a> bar</div></body>") == ""


def test_decontamination_of_rewritten_copies(spark):
    item = "Last year Alice Smith and her friend Robert Jones walked 12 km from Port Hill to Old Town in 3 hours before supper was served to all"
    forms = [item, item.replace(" ", "  "), "\n".join([item[:40], item[40:]]), item.replace(" ", "\r\n"), item.replace(" ", "\u00a0"), item.lower(), item.upper(), f"({item})", item.replace("Alice", "Carol")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = docs(spark, [*(f"so they say: {f} and more" for f in forms), "nothing of the kind is in this text at all"])
    assert {r.doc_id for r in leaks(rows, bench).collect()} == set(range(len(forms)))
    mixed = docs(spark, ["x " + item, "other words " * 30]).withColumn("doc_id", F.lit(4).cast("long"))
    assert [r.doc_id for r in leaks(mixed, bench).collect()] == [4]
    none = docs(spark, [item]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.doc_id for r in leaks(none, bench).collect()] == [None]


def test_suffix_dedup_of_repeated_ids_and_long_texts(spark):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    shared, long = word(300), word(1_200_000)
    at = 1_048_500  # across the border of two pieces that are hashed at once
    long = long[:at] + shared + long[at + 300 :]
    other = word(50) + shared
    rows = [(1, long), (1, other), (None, "x" * 150), (None, word(400)), (7, "same " * 60), (7, "same " * 60)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in got}
    assert len(got) == 6 and found == {(1, 1_200_000): (300, 1), (1, 350): (300, 1), (None, 150): (0, 0), (None, 400): (0, 0), (7, 300): (300, 1)}
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
