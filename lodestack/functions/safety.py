"""Redaction of secrets and of personal data, as columns: patterns, check digits, and one placeholder for each class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole blocks of private keys.
KEY_BLOCKS = [
    r"(?is)-----BEGIN(?: [A-Z]+)? PRIVATE KEY-----.*?-----END(?: [A-Z]+)? PRIVATE KEY-----",
    r"(?is)-----BEGIN OPENSSH PRIVATE KEY-----.*?-----END OPENSSH PRIVATE KEY-----",
    r"(?is)-----BEGIN PGP PRIVATE KEY BLOCK-----.*?-----END PGP PRIVATE KEY BLOCK-----",
]
#: Credentials, with what stays of a match before its placeholder.
TOKENS = [
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1"),
    (r"(?i)(api[_-]?key\s*[=:\s]\s*[\"']?)[^\s\"']+", "$1"),
    (r"(?i)\b(token|access[_-]?token|refresh[_-]?token|client[_-]?secret|password|secret)\b\s*[=:\s]\s*[\"']?[^\s\"'&]+", ""),
    (r"\bsk-[A-Za-z0-9]{20,}\b", ""),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", ""),
    (r"\bAKIA[0-9A-Z]{16}\b", ""),
    (r"\bASIA[0-9A-Z]{16}\b", ""),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9._-]{8,}\.[A-Za-z0-9._-]{8,}\b", ""),
    (r"(?i)\b(access_token|refresh_token|id_token|authorization_code|code_verifier|code_challenge)\b\s*[=:\s]\s*[\"']?[^\s\"'&]+", ""),
    (r"\bAIza[0-9A-Za-z\-_]{35}\b", ""),
    (r"\bsk-ant-[A-Za-z0-9\-_]{16,}\b", ""),
    (r"\bsk-(?:proj|org)-[A-Za-z0-9\-_]{12,}\b", ""),
    (r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b", ""),
    (r"\bxox(?:a|b|p|s|r)-[A-Za-z0-9-]{10,}\b", ""),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", ""),
    (r"\bglpat-[A-Za-z0-9\-_]{16,}\b", ""),
    (r"\bnpm_[A-Za-z0-9]{20,}\b", ""),
    (r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}\b", ""),
]
KEY_MARK, TOKEN_MARK = "[REDACTED_PRIVATE_KEY]", "[REDACTED]"
#: Letters of the Spanish national number by its remainder; weights of check digits.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CNPJ_WEIGHTS = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
CUIT_WEIGHTS = [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]
VERHOEFF_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
NINO_BAD = ["BG", "GB", "NK", "KN", "TN", "NT", "ZZ"]


#: What a text must hold for one of TOKENS to be in it, in their order; hints without capitals are looked for in the text in lower case.
TOKEN_HINTS = [
    ["bearer"], ["api_key", "api-key", "apikey"], ["token", "secret", "password"], ["sk-"], ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], ["AKIA"], ["ASIA"], ["eyJ"],
    ["_token", "authorization_code", "code_verifier", "code_challenge"], ["AIza"], ["sk-ant-"], ["sk-proj-", "sk-org-"], ["k_live_", "k_test_"], ["xox"], ["github_pat_"], ["glpat-"], ["npm_"], ["SG."],
]


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _hinted(text: Column, low: Column, hints: list[str]) -> Column:
    found = F.lit(False)
    for h in hints:
        found = found | F.contains(low if h == h.lower() else text, F.lit(h))
    return found


def _rewriting(hint: Column, pattern: str, to: str) -> Callable[[Column], Column]:
    return lambda t: F.when(hint, F.regexp_replace(t, pattern, to)).otherwise(t)


def secrets_redacted(text: Column) -> Column:
    """Key blocks, then credentials, replaced; null stays null. A pattern runs over a text only if that has a hint of it."""

    def cleaned(low: Column) -> Column:
        out = text
        for pattern in KEY_BLOCKS:
            out = once(out, _rewriting(_hinted(text, low, ["private key"]), pattern, KEY_MARK))
        for (pattern, kept), hints in zip(TOKENS, TOKEN_HINTS, strict=True):
            out = once(out, _rewriting(_hinted(text, low, hints), pattern, kept + TOKEN_MARK))
        return out

    return once(F.lower(text), lambda low: F.when(_hinted(text, low, ["private key", *(h for hints in TOKEN_HINTS for h in hints)]), cleaned(low)).otherwise(text))


def has_secret(text: Column) -> Column:
    found = F.lit(False)
    for pattern in [*KEY_BLOCKS, *(p for p, _ in TOKENS)]:
        found = found | text.rlike(pattern)
    return found


def digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _weighted(d: Column, weights: list[int]) -> Column:
    return _sum(F.zip_with(F.slice(d, 1, len(weights)), F.array(*map(F.lit, weights)), lambda x, w: x * w))


def _all_equal(d: Column) -> Column:
    return F.size(F.array_distinct(d)) == 1


def valid_cpf(text: Column) -> Column:
    d = digits(text)
    check = lambda n: _weighted(d, list(range(n + 1, 1, -1))) * 10 % 11 % 10 == F.get(d, F.lit(n))
    return (F.size(d) == 11) & ~_all_equal(d) & check(9) & check(10)


def valid_cnpj(text: Column) -> Column:
    d = digits(text)

    def check(n: int) -> Column:
        left = _weighted(d, CNPJ_WEIGHTS[13 - n :]) % 11
        return F.when(left < 2, 0).otherwise(11 - left) == F.get(d, F.lit(n))

    return (F.size(d) == 14) & ~_all_equal(d) & check(12) & check(13)


def valid_cuit(text: Column) -> Column:
    d = digits(text)
    left = _weighted(d, CUIT_WEIGHTS) % 11
    return (F.size(d) == 11) & (left != 1) & (F.when(left == 0, 0).otherwise(11 - left) == F.get(d, F.lit(10)))


def valid_luhn(text: Column) -> Column:
    """13 to 19 digits whose sum, every second from the right doubled, is a multiple of ten."""
    d = F.reverse(digits(text))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.size(d).between(13, 19) & (_sum(twice) % 10 == 0)


def valid_iban(text: Column) -> Column:
    bare = F.upper(F.regexp_replace(text, r"\s", ""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.regexp_extract_all(turned, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.length(bare).between(15, 34) & bare.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]+$") & (rest == 1)


def valid_verhoeff(text: Column) -> Column:
    """Twelve digits, the first 2 or more, whose product in the dihedral group of order ten is the unit."""
    product = [(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for a in range(10) for b in range(10)]
    turns = [list(range(10))]
    while len(turns) < 8:
        turns.append([VERHOEFF_STEP[x] for x in turns[-1]])
    group, moved = F.array(*map(F.lit, product)), F.array(*(F.lit(x) for row in turns for x in row))
    d = digits(text)
    placed = F.transform(F.reverse(d), lambda x, i: F.get(moved, i % 8 * 10 + x))
    return (F.size(d) == 12) & (F.get(d, F.lit(0)) >= 2) & (F.aggregate(placed, F.lit(0), lambda c, x: F.get(group, c * 10 + x)) == 0)


def valid_ssn(text: Column) -> Column:
    bare = F.regexp_replace(text, "[^0-9]", "")
    area = F.substring(bare, 1, 3)
    return (F.length(bare) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(bare, 4, 2) != "00") & (F.substring(bare, 6, 4) != "0000")


def valid_dni(text: Column) -> Column:
    """Eight digits, or X, Y or Z and seven, and the letter of their remainder by 23."""
    up = F.upper(text)
    number = F.translate(F.substring(up, 1, 1), "XYZ", "012")
    number = F.concat(number, F.substring(up, 2, 7)).try_cast("int")
    return (F.length(up) == 9) & (F.substr(F.lit(DNI_LETTERS), number % 23 + 1, F.lit(1)) == F.substring(up, 9, 1))


def valid_nino(text: Column) -> Column:
    """Two letters that such numbers begin with, six digits and A to D."""
    up = F.upper(text)
    return up.rlike("^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]$") & ~F.substring(up, 1, 2).isin(NINO_BAD)


#: Fixed values, in order of priority: (class, pattern, check or None, strict: also where a whole value is refused, the group that is replaced).
PII: list[tuple[str, str, Callable[[Column], Column] | None, bool, int]] = [
    ("CPF", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", valid_cpf, True, 0),
    ("CNPJ", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", valid_cnpj, True, 0),
    ("CUIT", r"\b\d{2}-\d{8}-\d\b", valid_cuit, True, 0),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?:[\s]?[A-Z0-9]){11,30}\b", valid_iban, True, 0),
    ("CREDIT_CARD", r"\b(?:\d[\s\-]?){13,19}\b", valid_luhn, False, 0),
    ("CNPJ", r"\b\d{14}\b", valid_cnpj, False, 0),
    ("CPF", r"\b\d{11}\b", valid_cpf, False, 0),
    ("AADHAAR", r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}\b", valid_verhoeff, True, 0),
    ("AADHAAR", r"(?i)(?:aadhaar|aadhar|आधार|uidai|uid)[\s:#\-no.]{0,10}(\d{12})\b", valid_verhoeff, True, 1),
    ("DNI", r"(?i)\b\d{8}[A-Z]\b", valid_dni, True, 0),
    ("DNI", r"(?i)\b[XYZ]\d{7}[A-Z]\b", valid_dni, True, 0),
    ("NINO", r"(?i)\b[A-Z]{2}\d{6}[A-D]\b", valid_nino, True, 0),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", valid_ssn, True, 0),
    ("RRN", r"\b\d{6}-[1-4]\d{6}\b", None, True, 0),
    ("RFC", r"(?i)\b[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}\b", None, True, 0),
    ("PAN_IN", r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b", None, True, 0),
    ("PHONE", r"\+\d{7,15}\b", None, False, 0),
    ("PHONE", r"\b(?:\+?1[\s.\-]?)?\(?[2-9]\d{2}\)?[\s.\-]?[2-9]\d{2}[\s.\-]?\d{4}\b", None, False, 0),
    ("MYNUMBER", r"(?:マイナンバー|個人番号|My\s?Number)[\s:はがを、.\-]{0,12}(\d{12})\b", None, True, 1),
]
#: Characters that hide digits, and what they stand for.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u2060\u180e"
WIDE = "０１２３４５６７８９．－／："
EASTERN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


def folded(text: Column) -> Column:
    """Wide and Eastern digits as ASCII, without zero-width characters."""
    return F.translate(text, WIDE + EASTERN + ZERO_WIDTH, "0123456789.-/:" + "0123456789" * 2)


#: No personal data is in a folded text without one of these: six digits with little between them, the letters and digits of a tax number, the beginning of an account number.
PII_HINT = r"[0-9](?:[\s.\-/()]{0,3}[0-9]){5}|[A-Za-z]{5}[0-9]{4}[A-Za-z]|[A-Z]{2}[0-9]{2}\s?[A-Z0-9]"
SPANS = "array<struct<start:int,end:int,mark:string>>"


def _spans(view: Column, name: str, pattern: str, valid: Callable[[Column], Column] | None, group: int) -> Column:
    """(start, end, mark) of the valid matches of a class; of a match with a group only its last twelve digits."""
    found = F.regexp_extract_all(view, F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), F.lit(1))

    def placed(matches: Column) -> Column:
        between = F.transform(F.split(view, pattern, -1), F.length)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("made"))

        def step(s: Column, x: Column) -> Column:
            begin = s["at"] + x["gap"]
            end = begin + x["size"]
            return F.struct(end.alias("at"), F.array_append(s["made"], F.struct((end - 12 if group else begin).alias("start"), end.alias("end"))).alias("made"))

        pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), F.transform(matches, F.length), lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))
        return F.aggregate(pairs, start, step, lambda s: s["made"])

    def kept(matches: Column) -> Column:
        all_ = F.zip_with(placed(matches), matches, lambda p, m: F.struct(p["start"].alias("start"), p["end"].alias("end"), m.alias("m")))
        if valid:
            all_ = F.filter(all_, lambda x: valid(F.right(x["m"], F.lit(12)) if group else x["m"]))
        return F.transform(all_, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[REDACTED_PII_{name}]").alias("mark")))

    return once(found, lambda m: F.when(F.size(m) > 0, kept(m)).otherwise(F.array().cast(SPANS)))


def pii_spans(view: Column) -> Column:
    """(start, end, mark) of personal data in a folded text, by place; of two that overlap the class that comes first in PII stays, then the earlier one."""
    every = F.concat(*[_spans(view, name, pattern, valid, group) for name, pattern, valid, _, group in PII])
    free = lambda kept, x: ~F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    chosen = F.aggregate(every, F.array().cast(SPANS), lambda kept, x: F.when(free(kept, x), F.array_append(kept, x)).otherwise(kept))
    return F.array_sort(chosen)


def _original(text: Column, spans: Column) -> Column:
    """The spans' places in the text itself, that holds zero-width characters besides what its folded form holds: from a match's first character to its last."""
    runs = F.transform(F.split(text, f"[{ZERO_WIDTH}]", -1), F.length)
    ends = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("made")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["made"], s["at"] + n).alias("made")), lambda s: s["made"])

    def moved(gaps: Column) -> Column:  # gaps: folded places before which a zero-width character stands
        place = lambda k: k + F.size(F.filter(gaps, lambda g: g <= k))
        return F.transform(spans, lambda x: F.struct(place(x["start"]).alias("start"), (place(x["end"] - 1) + 1).alias("end"), x["mark"].alias("mark")))

    return F.when(text.rlike(f"[{ZERO_WIDTH}]"), once(ends, lambda e: moved(F.slice(e, F.lit(1), F.size(e) - 1)))).otherwise(spans)


def spans_replaced(text: Column, spans: Column) -> Column:
    """text with each span's mark in its place; spans by place, without overlaps. All else stays as it is."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("made"))
    step = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["made"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), x["mark"])).alias("made"))
    return F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["made"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def pii_redacted(text: Column) -> Column:
    """Personal data replaced by [REDACTED_PII_<class>]; what is outside of it stays as it is, wide digits and zero-width characters too. Matches are looked for in the folded text, and only where that has a hint of any; null stays null."""
    replaced = lambda t, spans: F.when(F.size(spans) > 0, spans_replaced(t, _original(t, spans))).otherwise(t)
    return once(folded(text), lambda view: F.when(view.rlike(PII_HINT), once(pii_spans(view), lambda spans: replaced(text, spans))).otherwise(text))


def has_pii(text: Column) -> Column:
    """Personal data by shapes that are more than a run of digits."""
    view, found = folded(text), F.lit(False)
    for _, pattern, valid, strict, group in PII:
        if strict:
            hits = F.regexp_extract_all(view, F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), F.lit(1 + bool(group)))
            found = found | (F.exists(hits, valid) if valid else F.size(hits) > 0)
    return found


def has_email(text: Column) -> Column:
    return text.rlike(r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b")
