"""Safety, mail and tree functions on fixed cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import mail, safety
from lodestack.operators import trees
from lodestack.plans import memory


def texts(spark, f, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_secrets(spark):
    key = "a -----BEGIN RSA PRIVATE KEY-----\nMIIEsecret\n-----END RSA PRIVATE KEY----- b"
    got = texts(spark, safety.secrets_redacted, key, "Bearer abcdefgh12345", "api_key = xyz", "password: hunter2 and", "ghp_" + "a" * 24, "AKIA" + "B" * 16, "plain words", None)
    assert got == ["a [REDACTED_PRIVATE_KEY] b", "Bearer [REDACTED]", "api_key = [REDACTED]", "[REDACTED] and", "[REDACTED]", "[REDACTED]", "plain words", None]
    assert texts(spark, safety.has_secret, key, "plain") == [True, False]


def test_personal_data(spark):
    cases = {
        "cpf 529.982.247-25 x": "cpf [REDACTED_PII_CPF] x",
        "cpf 529.982.247-24 x": "cpf 529.982.247-24 x",
        "11.222.333/0001-81": "[REDACTED_PII_CNPJ]",
        "20-12345678-6": "[REDACTED_PII_CUIT]",
        "20-12345678-5": "20-12345678-5",
        "pay GB82 WEST 1234 5698 7654 32": "pay [REDACTED_PII_IBAN]",
        "card 4111 1111 1111 1111.": "card [REDACTED_PII_CREDIT_CARD].",
        "id 2341 2341 2346 x": "id [REDACTED_PII_AADHAAR] x",
        "dni 12345678Z, nie X1234567L": "dni [REDACTED_PII_DNI], nie [REDACTED_PII_DNI]",
        "dni 12345678A": "dni 12345678A",
        "nino AB123456C": "nino [REDACTED_PII_NINO]",
        "ssn 123-45-6789 or 666-45-6789": "ssn [REDACTED_PII_SSN] or 666-45-6789",
        "rrn 900101-1234567": "rrn [REDACTED_PII_RRN]",
        "pan ABCDE1234F": "pan [REDACTED_PII_PAN_IN]",
        "call +4930123456": "call [REDACTED_PII_PHONE]",
        "call (415) 555-2671": None,
        "My Number: 123456789012": "My Number: [REDACTED_PII_MYNUMBER]",
        "wide ５２９.９８２.２４７-２５": "wide [REDACTED_PII_CPF]",
        "nothing １２": "nothing １２",
    }
    got = texts(spark, safety.pii_redacted, *cases)
    for (text, want), have in zip(cases.items(), got, strict=True):
        assert have == want if want else "PHONE" in have, text
    assert texts(spark, safety.has_pii, "529.982.247-25", "4111111111111111", "x", "uid 234123412346") == [True, False, False, True]


def test_mail(spark):
    got = texts(
        spark, mail.clean_body,
        "Hello\n\n\n\nworld\nOn Monday, Bob wrote:\n> old", "Text\n> a\n\n> b\n> c\nafter", "Offer\nClick to Unsubscribe here\nmore", "a\n> one\nb\n> two\nc", "  x  \n", None,
    )
    assert got == ["Hello\n\nworld", "Text", "Offer", "a\n> one\nb\n> two\nc", "x", None]
    assert texts(spark, mail.address, "Bob <b@x.org>", "b@x.org", "Bob", "a b@x.org") == ["b@x.org", "b@x.org", None, None]
    assert texts(spark, mail.markdown_escaped, "a*b_c\nd\\") == ["a\\*b\\_c d\\\\"]
    assert texts(spark, lambda t: mail.truncated(t, 3), " abcd ", "abc") == ["abc…", "abc"]


def test_limits():
    assert [memory.clamped(x) for x in (None, 0, 5, 20_000)] == [100, 1, 5, 10_000]
    assert [memory.response_limit(x) for x in (0, 7, 500, 2**63 - 1)] == [10, 7, 100, None]


def test_cover_takes_the_fewest_nodes(spark):
    leaves = spark.createDataFrame([(f"c{i}", "s", i) for i in range(6)], "id string, scope string, timestamp_ms long")
    nodes = spark.createDataFrame([("a", "s", "top", 0, 2), ("b", "s", "top", 3, 4), ("top", "s", None, 0, 4)], "id string, scope string, parent_id string, start_ms long, end_ms long")
    links = spark.createDataFrame([("a", "c0"), ("a", "c1"), ("a", "c2"), ("b", "c3"), ("b", "c4"), ("top", "a"), ("top", "b")], "parent string, child string")
    cover = lambda lo, hi: [r.id for r in trees.window_cover(leaves, nodes, links, lo, hi).collect()]
    assert cover(0, 5) == ["top", "c5"] and cover(1, 4) == ["c1", "c2", "b"] and cover(5, 9) == ["c5"] and cover(8, 9) == []
    with pytest.raises(ValueError, match="ends at"):
        cover(2, 1)


def test_cascade(spark):
    leaves = spark.createDataFrame([("t", i, 10, i) for i in range(41)], "tree string, seq long, tokens long, at_ms long")
    got = {(r.level, r.node): (r.n_items, r.tokens) for r in trees.seal_cascade(leaves, fan_in=2, tokens=100).collect()}
    assert got == {(1, k): (10, 100) for k in range(4)} | {(2, 0): (2, 200), (2, 1): (2, 200), (3, 0): (2, 400)}


def test_entities_are_found_once_and_only_where_their_sign_is(spark):
    """the array was worked out again for a filter, and each pattern stopped at every character."""
    rng = random.Random(4)
    texts = ["", None, "@ab", "@@ab @a.b x@yy", "#tag&#no /#no ##no #a1", "a@b.co,@cd@ef @gh", "Ann#1234 x#12345", "é@ab \U0001f600@cd \U0001f600#ef", "see http://x.y/#z @me"] + ["".join(rng.choice("@@##ab1_. &/é\n") for _ in range(rng.randint(3, 30))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    each = lambda k, p: F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(1)), lambda s: F.struct(F.lit(k).alias("kind"), s.alias("surface")))
    plain = F.flatten(F.array(*[each(k, p) for k, p in memory.ENTITY_PATTERNS.items()]))
    assert all(list(r[0] or []) == list(r[1] or []) for r in rows.select(memory._entities(F.col("t")), plain).collect())
    plan = memory.entities_by_kind(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(memory.ENTITY_PATTERNS)
