"""Chunkers: one text to many rows, by arrays of segments.

A text over its budget is cut into segments by a cascade: after blank lines, what is still too long after sentences and
lines, then after blanks, then between characters. Segments are packed in order; a chunk begins with the last whole
segments of the one before. Everything is an expression over arrays of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as T

#: Shares of the budget that are repeated, aimed at and at most, in percent; quarter tokens of a letter or digit, of white space and of any other character.
OVERLAP, OVERLAP_MOST = 12, 40
LETTER, SPACE, OTHER = 2, 1, 4
#: What a segment ends with, from the coarsest to the finest.
PARAGRAPH = r"(?s).*?\n\n|.+\z"
SENTENCE = r"(?s).*?(?:\n|[.!?](?= ))|.+\z"
WORD = r"[^ ]* |[^ ]+\z"
#: Where a mail begins in a thread: a rule alone on its line, at most seven blank lines, a sender; where a chat's turn begins.
MAIL = r"(?m)^(?=---[^\S\n]*\n(?:[^\S\n]*\n){0,7}From:)"
TURN = r"(?m)^(?=## )"


def _once(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(text: Column) -> Column:
    return T.conservative_tokens(text).cast("int")


def over(text: Column, budget: int) -> Column:
    """Whether a text has more tokens than the budget; its length tells for most, as a character has from a quarter to one."""
    return F.when(F.length(text) <= budget, False).when(F.length(text) > 4 * budget, True).otherwise(tokens(text) > budget)


def hard_cut(text: Column, budget: int) -> Column:
    """Pieces of at most budget tokens, each as long as possible and of one character at least."""
    chars = F.split(text, "")
    weight = lambda c: F.when(c.rlike("^[A-Za-z0-9]$"), LETTER).when(c.rlike(f"^[{T.WHITE}]$"), SPACE).otherwise(OTHER)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, w: Column) -> Column:
        over = (s["total"] + w > 4 * budget) & (s["at"] > 0) & (s["total"] > 0)
        return F.struct(F.when(over, w).otherwise(s["total"] + w).alias("total"), (s["at"] + 1).alias("at"), F.when(over, F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"]).alias("cuts"))

    folded = F.aggregate(F.transform(chars, weight), start, step)
    bounds = F.concat(F.array(F.lit(0)), folded["cuts"], F.array(F.length(text)))
    return F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda b, i: F.substring(text, b + 1, F.get(bounds, i + 1) - b))


def segments(text: Column, budget: int) -> Column:
    """Parts of at most budget tokens (or one character) that make up the text, cut as coarsely as that allows."""

    def finer(parts: Column, cut) -> Column:
        return F.flatten(F.transform(parts, lambda x: F.when(over(x, budget), cut(x)).otherwise(F.array(x))))

    ending = lambda pattern: lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    parts = F.array(text)
    for pattern in (PARAGRAPH, SENTENCE, WORD):
        parts = finer(parts, ending(pattern))
    return finer(parts, lambda x: hard_cut(x, budget))


def _tail(costs: Column, first: Column, end: Column, aim: int, most: int) -> Column:
    """(take, total): the last segments of first to end that are repeated: each while the sum stays within most, until it reaches aim; never all."""
    back = F.reverse(F.slice(costs, first + 1, end - first))

    def step(s: Column, t: Column) -> Column:
        fits = ~s["done"] & (s["total"] + t <= most)
        total = F.when(fits, s["total"] + t).otherwise(s["total"])
        return F.struct((s["take"] + fits.cast("int")).alias("take"), total.alias("total"), (s["done"] | ~fits | (total >= aim)).alias("done"))

    none = F.struct(F.lit(0).alias("take"), F.lit(0).alias("total"), F.lit(False).alias("done"))
    return F.when(end - first > 1, F.aggregate(F.slice(back, F.lit(1), end - first - 1), none, step)).otherwise(none)


def packed(costs: Column, budget: int, aim: int, most: int) -> Column:
    """(first, end) of each chunk of segments with these costs."""
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("total"), F.array().cast("array<struct<first:int,end:int>>").alias("made"))

    def step(s: Column, t: Column) -> Column:
        over = (s["at"] > s["first"]) & (s["total"] + t > budget)
        tail = F.when(over, _tail(costs, s["first"], s["at"], aim, most))
        made = F.array_append(s["made"], F.struct(s["first"].alias("first"), s["at"].alias("end")))
        return F.struct(
            F.when(over, s["at"] - tail["take"]).otherwise(s["first"]).alias("first"), (s["at"] + 1).alias("at"),
            (F.when(over, tail["total"]).otherwise(s["total"]) + t).alias("total"), F.when(over, made).otherwise(s["made"]).alias("made"),
        )

    return F.aggregate(costs, start, step, lambda s: F.array_append(s["made"], F.struct(s["first"].alias("first"), s["at"].alias("end"))))


def chunks_of(text: Column, budget: int) -> Column:
    """(content, overlap) of each chunk, overlap in characters; without its overlaps a text is its chunks one after the other.

    A text within the budget, and an empty or null one, is one chunk. A chunk is over the budget only where a single
    character is. The repeated part aims at 12 % and has at most 40 % of the budget.
    """
    budget = max(budget, 1)
    aim = max(budget * OVERLAP // 100, 1)
    most = max(budget * OVERLAP_MOST // 100, aim)

    def made(parts: Column, bounds: Column) -> Column:
        join = lambda first, end: F.array_join(F.slice(parts, first + 1, end - first), "")
        ended = lambda i: F.when(i > 0, F.get(bounds, i - 1)["end"]).otherwise(0)
        repeated = lambda b, i: F.when(ended(i) > b["first"], F.length(join(b["first"], ended(i)))).otherwise(0)
        return F.transform(bounds, lambda b, i: F.struct(join(b["first"], b["end"]).alias("content"), repeated(b, i).alias("overlap")))

    split = lambda t: F.when(over(t, budget), segments(t, max(budget - most, 1))).otherwise(F.array(t))
    pack = lambda parts: _once(F.transform(parts, tokens), lambda costs: packed(costs, budget, aim, most))
    return _once(F.coalesce(text, F.lit("")), lambda t: _once(split(t), lambda parts: _once(pack(parts), lambda bounds: made(parts, bounds))))


def chunk_documents(docs: DataFrame, tokens: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seq, content, overlap_chars) of every document, within the budget."""
    made = docs.select(id_col, F.posexplode(chunks_of(F.col(text_col), tokens)).alias("seq", "chunk"))
    return made.select(id_col, "seq", F.col("chunk.content").alias("content"), F.col("chunk.overlap").alias("overlap_chars"))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, f"[{T.WHITE}]+\\z", "")), lambda p: p != "")


def chat_turns(rendered: Column) -> Column:
    """Turns of a chat, each from its heading of level two on, without white space at its end. What stands before the first is dropped; a text without headings is one unit."""
    found = _trimmed(F.filter(F.split(rendered, TURN), lambda p: p.startswith("## ")))
    return F.when(F.size(found) > 0, found).otherwise(_trimmed(F.array(rendered)))


def mails(thread: Column) -> Column:
    """Mails of a thread, each from its rule on; what stands before the first is dropped. A text without mails is one unit."""
    found = _trimmed(F.filter(F.split(thread, MAIL), lambda p: p.rlike(r"^---[^\S\n]*\n(?:[^\S\n]*\n){0,7}From:")))
    return F.when(F.size(found) > 0, found).otherwise(_trimmed(F.array(thread)))


def chunk_units(rows: DataFrame, kind: str, tokens: int = 3000, source_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """(source_id, seq, part, content, tokens, partial, chunk_id) of chats or mails: a chunk for each unit, several for one of over 4 characters a token of the budget.

    seq counts a text's chunks; part counts those of a unit, and with the content makes the id, so that a unit that comes
    again in another text of its source gets the same id. A blank text is one empty chunk.
    """
    units = {"chat": chat_turns, "email": mails}[kind](F.coalesce(F.col(text_col), F.lit("")))
    one = lambda content, part, partial: F.struct(content.alias("content"), part.alias("part"), F.lit(partial).alias("partial"))
    whole = lambda u: F.array(one(u, F.lit(0), False))
    cut = lambda u: F.transform(chunks_of(u, tokens), lambda c, i: one(c["content"], i, True))
    made = F.flatten(F.transform(units, lambda u: F.when(F.length(u) > 4 * max(tokens, 1), cut(u)).otherwise(whole(u))))
    named = rows.select(F.col(source_col).alias("source_id"), F.posexplode(_once(made, lambda m: F.when(F.size(m) > 0, m).otherwise(whole(F.lit(""))))).alias("seq", "c"))
    named = named.select("source_id", "seq", "c.*")
    return named.select("source_id", "seq", "part", "content", T.chars_tokens(F.col("content")).alias("tokens"), "partial", T.chunk_id(F.lit(kind), F.col("source_id"), F.col("part"), F.col("content")).alias("chunk_id"))
