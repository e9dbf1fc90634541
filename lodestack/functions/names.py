"""Names, tags, ids and front matter as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import collapsed

NUL, UNIT = "\x00", "\x1f"
#: Engagement tags and what each adds.
ENGAGEMENT = {"sent": 0.6, "reply": 0.5, "dm": 0.3, "mention": 0.2}
#: Labels of earlier versions and what they are called now.
LEGACY_LABELS = {"work": "general", "from_reflection": "subconscious", "subconscious_tick": "subconscious", "agent-task": "tasks", "worker": "tasks"}
#: Words with single blanks between them, which neither begin nor end with these signs; read once, from left to right.
TIDY = r"\A(?![%s])(?:\S++ ?+)*+(?<![ %s\u0085\u2028\u2029])\z"
RESERVED = r'[\\/:*?"<>|]'


def bare(text: Column) -> Column:
    """Text without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def predicate(text: Column) -> Column:
    """Upper-case letters and digits; any other run is one underscore, none at the ends."""
    return F.regexp_replace(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "_")), "^_+|_+$", "")


def entity_name(text: Column) -> Column:
    """Upper-case, without punctuation at the ends, white space collapsed. What needs no change is looked at once."""
    tidy = collapsed(F.regexp_replace(bare(text), r"""^[-:;,."'()]+|[-:;,."'()]+$""", ""))
    return F.upper(F.when(text.rlike(TIDY % (("""-:;,."'()""",) * 2)), text).otherwise(tidy))


def fact(text: Column) -> Column:
    """Without leading hyphens and punctuation at the ends, white space collapsed. What needs no change is looked at once."""
    tidy = collapsed(F.regexp_replace(bare(F.regexp_replace(bare(text), "^-+", "")), "^[:;,.]+|[:;,.]+$", ""))
    return F.when(text.rlike(TIDY % ("-:;,.", ":;,.")), text).otherwise(tidy)


def search_text(text: Column) -> Column:
    """Lower-case letters and digits; _ - / . are blanks, other signs go."""
    blanks = F.regexp_replace(F.lower(text), r"[_\-/.\s]+", " ")
    return collapsed(F.regexp_replace(blanks, r"[^\p{L}\p{N} ]", ""))


def tag_value(text: Column) -> Column:
    """Words with a capital first letter, joined by hyphens; `unknown` if there are none."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "-")
    return F.when(joined == "", "unknown").otherwise(joined)


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, RESERVED, "-")


def uid(text: Column) -> Column:
    """Blanks are replaced as well; `unknown` if empty."""
    return F.when(text == "", "unknown").otherwise(F.regexp_replace(text, r'[\\/:*?"<>| ]', "-"))


def entity_slug(text: Column) -> Column:
    """Reserved and control characters become underscores."""
    return F.regexp_replace(text, r'[\\/:*?"<>|\p{Cntrl}]', "_")


def item_id(composite: Column) -> Column:
    """What follows `mem_src:<source>:`, else what follows the first colon, else all."""
    return F.when(composite.rlike("^mem_src:[^:]*:"), F.regexp_replace(composite, "^mem_src:[^:]*:", "")).otherwise(F.regexp_replace(composite, "^[^:]*:", ""))


def _head(text: Column, n: int = 32) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def session_chunk_id(session: Column, markdown: Column) -> Column:
    return F.concat(F.lit("archivist:"), _head(F.concat(session, F.lit(NUL), markdown)))


def evidence_id(source: Column, excerpt: Column) -> Column:
    return _head(F.concat(source, F.lit(UNIT), excerpt))


def stable_seq(scope: Column, content: Column) -> Column:
    """The first four bytes of a SHA-256 as a little-endian number."""
    h = _head(F.concat(scope, F.lit(UNIT), content), 8)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


def title(text: Column, item: Column, most: int = 120) -> Column:
    """The first line that isn't blank, without leading #; the item's id where there is none or nothing is left of it."""
    line = bare(F.regexp_replace(bare(F.regexp_extract(text, r"\A\s*([^\n]*)", 1)), "^#+", ""))
    return F.when(F.coalesce(line, F.lit("")) == "", item).otherwise(F.substring(line, 1, most))


def parent_node(node: Column) -> Column:
    """A time node's parent: years hang on the root, which has none, as nulls do."""
    return F.when(node.isNull() | (node == "root"), None).when(node.contains("/"), F.regexp_replace(node, "/[^/]*$", "")).otherwise("root")


def hour_of_file(name: Column) -> Column:
    """Hour node of a buffer file `<ms>_<id>.md`; null where the name has no number."""
    ms = F.regexp_extract(name, r"^(-?\d{1,15})(?:_|$)", 1)
    return F.when(ms != "", F.date_format(F.timestamp_millis(F.nullif(ms, F.lit("")).cast("long")), "yyyy/MM/dd/HH"))


def flush_block(at: Column) -> Column:
    """Date and block of three hours."""
    return F.concat_ws("#", F.date_format(at, "yyyy-MM-dd"), F.floor(F.hour(at) / 3).cast("string"))


def engagement(tags: Column) -> Column:
    """Sum of what engagement tags add, repeats too, 1 at most; 0.5 where there are none."""
    weights = F.create_map(*[F.lit(x) for pair in ENGAGEMENT.items() for x in pair])
    known = F.filter(F.transform(tags, lambda t: F.try_element_at(weights, t)), lambda w: w.isNotNull())
    return F.when(F.size(known) > 0, F.least(F.aggregate(known, F.lit(0.0), lambda a, w: a + w), F.lit(1.0))).otherwise(0.5)


def source_tag_first(scope: Column, tags: Column) -> Column:
    own = F.concat(F.lit("source/"), scope)
    return F.concat(F.array(own), F.filter(tags, lambda t: t != own))


def inferred_label(thread: Column) -> Column:
    return F.when(thread.contains("morning-briefing"), "briefing").when(thread.startswith("proactive:"), "notification").otherwise("general")


def current_labels(labels: Column) -> Column:
    """Labels by their present names, each once, in order."""
    names = F.create_map(*[F.lit(x) for pair in LEGACY_LABELS.items() for x in pair])
    return F.array_distinct(F.transform(labels, lambda x: F.coalesce(F.try_element_at(names, x), x)))


FRONT = r"(?s)\A---\n(.*?)\n---\n(.*)\z"


def front_matter(markdown: Column) -> Column:
    """The block between --- lines at the start; null where there is none."""
    return F.when(markdown.rlike(FRONT), F.regexp_extract(markdown, FRONT, 1))


def body(markdown: Column) -> Column:
    return F.when(markdown.rlike(FRONT), F.regexp_extract(markdown, FRONT, 2)).otherwise(markdown)


def front_field(front: Column, key: str) -> Column:
    """A scalar of front matter, without quotes; null where it is missing."""
    pattern = rf"(?m)^{key}:[ \t]*(.*)$"
    return F.when(front.rlike(pattern), F.regexp_replace(F.trim(F.regexp_extract(front, pattern, 1)), '^"|"$', ""))


def cost_usd(tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars for a million tokens in and out."""
    return (tokens_in * 0.07 + tokens_out * 0.28) / 1_000_000


def parsed_date(value: Column) -> Column:
    """Milliseconds of a date: epoch milliseconds, RFC 3339, mail dates with or without day name, or a plain date; null otherwise."""
    bare_date = F.regexp_replace(F.trim(value), "^[A-Za-z]{3}, *", "")
    ms = F.when(value.rlike(r"^\s*-?\d{1,15}\s*$"), F.timestamp_millis(F.trim(value).try_cast("long")))
    forms = ["yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "d MMM yyyy HH:mm:ss xx", "yyyy-MM-dd"]
    return F.unix_millis(F.coalesce(ms, *[F.try_to_timestamp(bare_date, F.lit(f)) for f in forms]))
