"""Queries without SQL against plain Python on the small tables, and redaction that leaves everything else as it is."""

import re

import numpy as np
from pyspark.sql import functions as F

from lodestack.functions import safety
from lodestack.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
ZERO = safety.ZERO_WIDTH


def texts(spark, f, *values):
    return [r.o for r in spark.createDataFrame(list(enumerate(values)), "k int, t string").select("k", f(F.col("t")).alias("o")).orderBy("k").collect()]


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def weighted(d, weights):
    return sum(x * w for x, w in zip(d, weights, strict=False))


def valid(name, text):
    d = [int(c) for c in text if c in "0123456789"]
    if name == "CPF":
        return len(d) == 11 and len(set(d)) > 1 and all(weighted(d, range(n + 1, 1, -1)) * 10 % 11 % 10 == d[n] for n in (9, 10))
    if name == "CNPJ":
        left = lambda n: weighted(d, safety.CNPJ_WEIGHTS[13 - n :]) % 11
        return len(d) == 14 and len(set(d)) > 1 and all((0 if left(n) < 2 else 11 - left(n)) == d[n] for n in (12, 13))
    if name == "CUIT":
        left = weighted(d, safety.CUIT_WEIGHTS) % 11
        return len(d) == 11 and left != 1 and (0 if left == 0 else 11 - left) == d[10]
    if name == "CREDIT_CARD":
        return 13 <= len(d) <= 19 and luhn(d)
    if name == "IBAN":
        bare = re.sub(r"\s", "", text).upper()
        return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    if name == "DNI":
        up = text.upper().translate(str.maketrans("XYZ", "012")) if text[0] in "xyzXYZ" else text.upper()
        return safety.DNI_LETTERS[int(up[:8]) % 23] == text[-1].upper()
    if name == "NINO":
        return bool(re.fullmatch(r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]", text.upper())) and text[:2].upper() not in safety.NINO_BAD
    if name == "SSN":
        return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"
    return name != "AADHAAR" or aadhaar(text)


def redacted(text):
    where, view = [], ""
    wide = dict(zip(safety.WIDE + safety.EASTERN, "0123456789.-/:" + "0123456789" * 2, strict=True))
    for i, c in enumerate(text):
        if c not in ZERO:
            where.append(i)
            view += wide.get(c, c)
    taken = []
    for name, pattern, _, _, group in safety.PII:
        for m in re.finditer(pattern, view, re.ASCII):
            a, b = m.span(group)
            if valid(name, m[group]) and all(b <= x or y <= a for x, y, _ in taken):
                taken.append((a, b, name))
    out, at = "", 0
    for a, b, name in sorted(taken):
        out += text[at : where[a]] + f"[REDACTED_PII_{name}]"
        at = where[b - 1] + 1
    return out + text[at:]


def aadhaar(text):
    """Verhoeff's check by the dihedral group: rotations 0 to 4, reflections 5 to 9."""
    times = lambda a, b: (a + b) % 5 + 5 * (b > 4) if a < 5 else (a - b) % 5 + 5 * (b < 5)
    turned = list(range(10))
    d, c = [int(x) for x in text if x in "0123456789"], 0
    for x in reversed(d):
        c = times(c, turned[x])
        turned = [safety.VERHOEFF_STEP[t] for t in turned]
    return len(d) == 12 and d[0] >= 2 and c == 0


PLANTED = [
    "Ｈello １２ call 123-45-6789", f"a{ZERO[1]}b 123-{ZERO[0]}45-67{ZERO[3]}89{ZERO[2]}, c{ZERO[1]}d", f"{ZERO[0]}529.982.247-25{ZERO[0]}", "wide ５２９.９８２.２４７-２５ and １２３",
    "4111 1111 1111 1111 and 4111111111111111, 5500-0000-0000-0004", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000", "uid: 234123412346, My Number: 123456789012 x", "+4930123456 +1 415 555 2671 (415) 555-2671",
    "ABCDE1234F VECJ880326XK4 AB123456C 12345678Z X1234567L 900101-1234567", "٤١١١١١١١١١١١١١١١ ok", "12 34 5 6789", "", "x" * 50, "111.444.777-35 11222333000181 20-11111111-2", "2341 2341 2346 2341-2341-2347",
]


def test_redaction_equals_a_plain_version(spark):
    assert texts(spark, safety.pii_redacted, *PLANTED, None) == [*map(redacted, PLANTED), None]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    whole = [r.text for r in docs]
    assert texts(spark, safety.pii_redacted, *whole) == list(map(redacted, whole))


def test_text_outside_of_matches_is_kept(spark):
    got = texts(spark, safety.pii_redacted, PLANTED[0], PLANTED[1])
    assert got == ["Ｈello １２ call [REDACTED_PII_SSN]", f"a{ZERO[1]}b [REDACTED_PII_SSN]{ZERO[2]}, c{ZERO[1]}d"]


def test_cards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: n for r in docs if (n := sum(luhn([int(c) for c in m]) for m in re.findall(r"\b[0-9]{13,19}\b", r.text, re.ASCII)))}
    assert {r.doc_id: r.n_cards for r in QUERIES["pii_cards"](spark, SF).collect()} == want


def test_marginal_relevance(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    got = {(r.label, r["rank"]): r.vec_id for r in QUERIES["mmr"](spark, SF).collect()}
    for label in {r.label for r in rows}:
        own = [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.label == label]
        own = [(i, v / np.linalg.norm(v)) for i, v in own]
        first = own[0][1]
        pool = sorted(own, key=lambda x: (-round(float(x[1] @ first), 12), x[0]))[:50]
        chosen = []
        while len(chosen) < min(10, len(pool)):
            gain = lambda x, c=chosen: 0.7 * float(x[1] @ first) - 0.3 * max((float(x[1] @ y[1]) for y in c), default=0.0)
            chosen.append(max((x for x in pool if all(x[0] != y[0] for y in chosen)), key=gain))
        assert [got[label, k + 1] for k in range(len(chosen))] == [i for i, _ in chosen]
