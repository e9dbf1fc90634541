"""Chunk cascade against a plain version, and the splitters of chats and mails."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import chunking

WHITE = set("\t\n\v\f\r \u0085      　") | {chr(c) for c in range(0x2000, 0x200B)}


def weight(c):
    return 2 if c.isascii() and c.isalnum() else 1 if c in WHITE else 4


def cost(t):
    return -(-sum(map(weight, t)) // 4)


def after(text, ends):
    """Pieces of text that end where ends says so for the position behind."""
    out, start = [], 0
    for i in range(1, len(text)):
        if ends(text, start, i):
            out.append(text[start:i])
            start = i
    return [*out, text[start:]]


RULES = [
    lambda t, s, i: t[i - 2 : i] == "\n\n" and i - 2 >= s,
    lambda t, s, i: t[i - 1] == "\n" or (t[i - 1] in ".!?" and t[i] == " "),
    lambda t, s, i: t[i - 1] == " ",
]


def atoms(text, budget, rules=RULES):
    if cost(text) <= budget:
        return [text]
    if rules:
        return [x for p in after(text, rules[0]) for x in atoms(p, budget, rules[1:])]
    out, held = [], ""
    for c in text:
        if held and sum(map(weight, held + c)) > 4 * budget:
            out.append(held)
            held = ""
        held += c
    return [*out, held]


def plain(text, budget):
    aim = max(budget * 12 // 100, 1)
    most = max(budget * 40 // 100, aim)
    if cost(text) <= budget:
        return [(text, 0)]
    parts, made, held, again = atoms(text, max(budget - most, 1)), [], [], 0
    for p in parts:
        if held and sum(map(cost, held)) + cost(p) > budget:
            made.append(("".join(held), again))
            tail = []
            for x in reversed(held[1:]):
                if sum(map(cost, tail)) + cost(x) > most:
                    break
                tail.insert(0, x)
                if sum(map(cost, tail)) >= aim:
                    break
            held, again = tail, len("".join(tail))
        held.append(p)
    return [*made, ("".join(held), again)]


def some(rng):
    out = ""
    for _ in range(rng.randint(0, 60)):
        out += rng.choice(["word", "a", "Ünïcode", "日本語", "x" * rng.randint(1, 60), "#!", "\U0001f600", "é", "12"]) + rng.choice([" ", " ", " ", ". ", "!\n", "\n", "\n\n", "\n\n\n", "? ", " ", ""])
    return out


@pytest.mark.parametrize("budget", [1, 7, 40])
def test_chunks_equal_a_plain_version(spark, budget):
    rng = random.Random(budget)
    texts = ["", " ", "short", "x" * 300, "\n\n" * 30, "日" * 50, *[some(rng) for _ in range(60)]]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(999, None, 1)], "doc_id long, text string, seq int")
    got = {}
    for r in chunking.chunk_documents(d, tokens=budget).collect():
        got.setdefault(r.doc_id, []).append((r.seq, r.content, r.overlap_chars))
    assert [c for _, *c in got.pop(999)] == [["", 0]]
    for i, t in enumerate(texts):
        rows = sorted(got[i])
        assert [(c, o) for _, c, o in rows] == plain(t, budget), repr(t)
        assert "".join(c[o:] for _, c, o in rows) == t
        assert all(cost(c) <= budget or len(c) == 1 or budget < 7 for _, c, _ in rows)
    assert chunking.chunk_documents(d.limit(0)).count() == 0


def test_long_run_without_blanks(spark):
    text = "Ab1" * 40_000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = chunking.chunk_documents(d, tokens=1000).orderBy("seq").collect()
    assert "".join(r.content[r.overlap_chars :] for r in rows) == text and all(cost(r.content) <= 1000 for r in rows)


def units(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_mails(spark):
    thread = "intro\n---\n\nFrom: a\nbody --- x\n---\nno mail\n---  \n \nFrom: b\nend \n\n"
    assert units(spark, chunking.mails, thread) == ["---\n\nFrom: a\nbody --- x\n---\nno mail", "---  \n \nFrom: b\nend"]
    near, far = "---\n" + "\n" * 7 + "From: a", "---\n" + "\n" * 8 + "From: a"
    assert units(spark, chunking.mails, near) == [near] and units(spark, chunking.mails, "x\n" + far) == ["x\n" + far]
    assert units(spark, chunking.mails, "plain \n") == ["plain"] and units(spark, chunking.mails, " \n") == []


def test_chat_turns(spark):
    chat = "# Chat\nlost\n## a\nhello\n### not a turn\n##none\n## b\n\n\n## c\nlast \n"
    assert units(spark, chunking.chat_turns, chat) == ["## a\nhello\n### not a turn\n##none", "## b", "## c\nlast"]
    assert units(spark, chunking.chat_turns, "no turns\n") == ["no turns"]


def test_units_keep_their_ids(spark):
    long = "## b\n" + " ".join(f"Some words, {k} of them." for k in range(30))
    rows = [("s", "## a\nhi\n" + long), ("s", long + "\n## a\nhi"), ("e", " "), ("n", None)]
    got = chunking.chunk_units(spark.createDataFrame(rows, "source_id string, text string"), "chat", tokens=60).collect()
    ids = {}
    for r in got:
        ids.setdefault(r.content, set()).add(r.chunk_id)
        assert r.partial == (len(long) > 240 and r.content.startswith("## a") is False and r.content != "")
    assert all(len(v) == (2 if k == "" else 1) for k, v in ids.items())
    assert sorted(r.seq for r in got if r.source_id == "s") == sorted(2 * list(range(len({r.content for r in got if r.source_id == "s"}))))
    assert [(r.seq, r.part, r.content) for r in got if r.source_id in "en"] == [(0, 0, "")] * 2
