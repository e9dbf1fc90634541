"""Mail bodies and headers: reply chains, footers, addresses, markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What begins a footer, anywhere in a line.
FOOTERS = [
    "unsubscribe", "view in browser", "view this email in your browser", "view it in your browser", "update your email settings", "manage your subscription",
    "manage preferences", "email preferences", "you are receiving this email because", "you received this email because", "you're receiving this email because",
    "to stop receiving", "all rights reserved", "© 20", "(c) 20", "copyright 20", "powered by mailchimp", "sent via sendgrid", "this email and any files",
    "confidentiality notice", "if you are not the intended recipient", "this communication may contain",
]
#: What marks a quoted or forwarded message.
FORWARDS = ["---------- forwarded message", "----- original message", "--------- original message", "--- forwarded by"]
QUOTED = 3  # lines in a row that begin with > and are a quoted message


def _any(line: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | line.contains(m)
    return found


def _before(text: Column, at: Column) -> Column:
    """The first `at` lines, without white space at the end; the whole text if at is null."""
    return F.when(at.isNull(), text).otherwise(F.regexp_replace(F.array_join(F.slice(F.split(text, "\n"), F.lit(1), at), "\n"), r"\s+$", ""))


def without_reply(text: Column) -> Column:
    """What stands before the first reply or forward mark, or before three quoted lines with nothing but blank lines between them."""
    lines = F.split(text, "\n")
    low = F.transform(lines, lambda x: F.lower(F.trim(F.regexp_replace(x, "[\r\t]", " "))))
    marks = F.transform(low, lambda x, i: F.when((x.startswith("on ") & x.contains(" wrote:")) | _any(x, FORWARDS), i))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(-1).alias("at"), F.lit(None).cast("int").alias("cut"))

    def step(s: Column, x: Column) -> Column:
        quoted = x.startswith(">")
        run = F.when(quoted, s["run"] + 1).when(x == "", s["run"]).otherwise(0)
        at = F.when(quoted & (s["run"] == 0), s["i"]).otherwise(s["at"])
        return F.struct((s["i"] + 1).alias("i"), run.alias("run"), at.alias("at"), F.coalesce(s["cut"], F.when(run >= QUOTED, at)).alias("cut"))

    return _before(text, F.least(F.array_min(marks), F.aggregate(low, start, step)["cut"]))


def without_footer(text: Column) -> Column:
    return _before(text, F.array_min(F.transform(F.split(text, "\n"), lambda x, i: F.when(_any(F.lower(x), FOOTERS), i))))


def blank_runs_collapsed(text: Column) -> Column:
    """One blank line for several; none at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t\r]+$", ""), r"\n{3,}", "\n\n"), r"\n+$", "")


def clean_body(text: Column) -> Column:
    stripped = F.regexp_replace(without_footer(without_reply(text)), r"^\s+|\s+$", "")
    return blank_runs_collapsed(stripped)


def truncated(text: Column, most: int) -> Column:
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.substring(bare, 1, most), F.lit("…")))


def markdown_escaped(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, r"([\\`*_|])", r"\\$1"), "\r\n", "  ")


def address(header: Column) -> Column:
    """The address of `Name <a@b>`, or a bare one; null where there is none."""
    bare = F.trim(header)
    inner = F.trim(F.regexp_extract(bare, r"<([^<>]*)>[^<>]*$", 1))
    return F.when(inner.contains("@"), inner).when(bare.contains("@") & ~bare.contains(" "), bare)
