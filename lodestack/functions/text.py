"""Text, token, id and date functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: Accented letters and those without the accent, in pairs.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: ASCII letters and digits; Unicode white space.
ASCII_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WHITE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
URL = r"https?://[^\s<>\"]+"


def chars_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def bytes_tokens(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def conservative_tokens(text: Column) -> Column:
    """ASCII letters and digits cost two quarters, white space one, all else a whole token; rounded up."""
    no_letters = F.length(F.translate(text, ASCII_ALNUM, ""))
    others = F.length(F.translate(text, ASCII_ALNUM + WHITE, ""))
    return F.floor((2 * F.length(text) - no_letters + 3 * others + 3) / 4).cast("long")


def words(text: Column) -> Column:
    """Lower-cased runs of Unicode letters and digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, most: int = 120) -> Column:
    """Lower-case ASCII letters and digits; underscores collapse, other runs become one hyphen."""
    runs = F.regexp_replace(F.regexp_replace(F.lower(text), "_+", "_"), "[^a-z0-9_]+", "-")
    return F.substring(F.regexp_replace(runs, "^-+|-+$", ""), 1, most)


def canonical_id(kind: Column, surface: Column) -> Column:
    """kind:surface, lower-cased without a leading @ or #; a URL keeps its case."""
    bare = F.regexp_replace(F.trim(surface), "^[@#]+", "")
    return F.concat(kind, F.lit(":"), F.when(kind == "url", F.trim(surface)).otherwise(F.lower(bare)))


def chunk_id(kind: Column, source: Column, seq: Column, content: Column) -> Column:
    """First half of the SHA-256 of kind, source, big-endian sequence number and content, NUL between them."""
    nul = F.unhex(F.lit("00"))
    number = F.unhex(F.lpad(F.hex(seq.cast("long")), 8, "0"))
    parts = [F.encode(kind, "UTF-8"), nul, F.encode(source, "UTF-8"), nul, number, nul, F.encode(content, "UTF-8")]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def unaccented(text: Column) -> Column:
    """Latin letters without their accents; other scripts stay."""
    return F.translate(text, ACCENTED, PLAIN)


def grams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of characters of the lower-cased text."""
    low = F.lower(text)
    size = F.length(low)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(low, i, n)))).otherwise(F.array().cast("array<string>"))


def flexible_time(text: Column, now: Column) -> Column:
    """RFC 3339 text or epoch milliseconds; null is now; numbers too small to be milliseconds are null."""
    number = F.expr("null").cast("long") if text is None else F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    by_number = F.when(F.abs(number) >= 100_000_000_000, F.timestamp_millis(number))
    return F.when(text.isNull(), now).when(number.isNotNull(), by_number).otherwise(F.try_to_timestamp(text))


def age_label(age_seconds: Column) -> Column:
    return F.when(age_seconds <= 30, "active").when(age_seconds <= 300, "recent").otherwise("idle")


def backoff(attempt: Column, base_ms: int = 60_000, most_ms: int = 3_600_000) -> Column:
    """base * 2^(attempt - 1), capped; shifts beyond 20 count as 20."""
    shift = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(20))
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), shift), F.lit(most_ms)).cast("long")
