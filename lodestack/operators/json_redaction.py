"""Redaction inside JSON: values under sensitive keys, strings, and what is nested too deeply.

A text becomes its tokens, an array in its own row, so nothing is shuffled. A walk over one character a token says what becomes
of each, in time linear in the text and to any depth; the rest are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.safety import once, pii_redacted, secrets_redacted

#: Nesting at which a value is replaced, the replacement, and how sensitive keys are, end or what they hold, as lower-case ASCII letters and digits.
MOST_DEPTH = 128
MARK = "[REDACTED_SECRET]"
SENSITIVE = "^authorization$|(?:token|apikey|clientsecret|key)$|password|secret"
#: Noncharacters that stand for an escaped backslash and quote while a text is cut.
BACKSLASH, QUOTE = "\ufdd0", "\ufdd1"
TOKEN = r'"[^"]*"|[{}\[\],:]|[^{}\[\],:"\s]+'


def is_sensitive(key: Column) -> Column:
    """Whether a key's name says that it holds a secret."""
    return F.lower(F.regexp_replace(key, "[^A-Za-z0-9]", "")).rlike(SENSITIVE)


def _string(token: Column) -> Column:
    """The text that a JSON string stands for."""
    return F.get_json_object(F.concat(F.lit('{"x":'), token, F.lit("}")), "$.x")


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")


def _walked(codes: str | None, most_depth: int) -> str | None:
    """What becomes of each token, a character each: n and d are replaced for their key and depth, - lies inside such a value, t is a string value, . stays."""
    if codes is None:
        return None
    out, depth, hidden = [], 0, None  # hidden: the level of the value that is being left out
    for k, c in enumerate(codes):
        level = depth  # containers around a value; of a separator or end, the one that it is in
        depth += (c in "{[") - (c in "}]")
        if hidden is not None:
            if level != hidden or c not in ",}]":
                out.append("-")
                continue
            hidden = None
        mark = "."
        if c not in ",:}]" and codes[k + 1 : k + 2] != ":":
            mark = "n" if codes[max(k - 2, 0) : k] == "s:" else "d" if level >= most_depth else "t" if c in 's"' else "."
            hidden = level if mark in "nd" else None
        out.append(mark)
    return "".join(out)


def sanitized(rows: DataFrame, key: str, text: str, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(key, text, key_redactions, text_redactions, depth_redactions) of JSON texts; nothing is shuffled.

    text is the same JSON without white space between tokens, order and numbers as they were. A sensitive key's value is replaced whole, whatever it is; a value inside most_depth
    containers is replaced, too; other strings go through the redaction of texts, and text_redactions counts those that change. Keys stay. Malformed and null texts give null.
    """
    walked = F.pandas_udf(lambda codes: codes.map(lambda c: _walked(c, most_depth)), "string")
    good = F.when(F.try_parse_json(text).isNotNull(), F.translate(text, BACKSLASH + QUOTE, ""))
    bare = F.replace(F.replace(good, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    restored = lambda cut: F.replace(F.replace(cut, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))
    t = rows.select(key, F.transform(F.regexp_extract_all(bare, F.lit(f"({TOKEN})"), F.lit(1)), restored).alias("tokens"))
    code = lambda token: F.when(~token.startswith('"'), F.when(token.rlike(r"^[{}\[\],:]$"), token).otherwise("v")).when(F.coalesce(is_sensitive(_string(token)), F.lit(False)), "s").otherwise('"')
    t = t.withColumn("marks", walked(F.array_join(F.transform("tokens", code), "")))
    parts = F.filter(F.arrays_zip("tokens", F.split("marks", "").alias("marks")), lambda p: p["marks"] != "-")

    said = F.transform(parts, lambda p: F.struct(p["tokens"].alias("token"), p["marks"].alias("mark"), F.when(p["marks"] == "t", _string(p["tokens"])).alias("was")))
    clean = lambda was: F.when(was.isNotNull(), once(once(was, secrets_redacted), pii_redacted))
    cleaned = lambda p: F.struct(p["token"].alias("token"), p["mark"].alias("mark"), p["was"].alias("was"), clean(p["was"]).alias("now"))
    changed = lambda p: F.coalesce(p["was"] != p["now"], F.lit(False))
    shown = lambda p: F.when(p["mark"].isin("n", "d"), F.lit(f'"{MARK}"')).when(changed(p), _quoted(p["now"])).otherwise(p["token"])
    count = lambda which, name: F.when(F.col("marks").isNotNull(), F.size(F.filter("parts", which)).cast("long")).alias(name)
    t = t.select(key, "marks", F.transform(said, cleaned).alias("parts"))
    return t.select(key, F.array_join(F.transform("parts", shown), "").alias(text), count(lambda p: p["mark"] == "n", "key_redactions"), count(changed, "text_redactions"), count(lambda p: p["mark"] == "d", "depth_redactions"))
