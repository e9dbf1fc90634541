"""Benchmark decontamination by templates, in DataFrame functions only.

Words are canonicalised: numbers, units after numbers and names become typed placeholders, all else is lower-cased
without punctuation. Windows of template words, shorter ones for short items, are hashed and joined with those of the
benchmark. A text is reported with an item when the windows found at one distance, or one word off it, cover enough of
the item's words, or RUN of them in a row, and the values in the slots agree: the same value of the item always stands
for the same value of the text. So edited and partial copies are found, and those with other numbers, names or units.
A run of name words is one slot, so "Ann Lee" may stand for "Maria". An item is also asked with its names as lower-case
words, so copies in one case are found whatever was a name. An item of one word is found where that word is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import staged, text_key

WINDOW = 8
LEAST_SHARE = 0.8
RUN = 13  # words in a row that are a leak of any item
#: Window by the words an item has at least; from 27 words one edit leaves a run, below it may cost a fifth of the words.
SHORT = [(27, WINDOW), (15, 3), (2, 2), (1, 1)]
BROADCAST_ROWS = 200_000  # benchmark windows up to which they are sent to every task (16 bytes each)
#: Units that become a placeholder after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs d day days week weeks month months year years hour hours minute minutes second seconds usd eur gbp dollars euros pounds percent mph kmh hz khz mhz ghz b kb mb gb tb w kw v k c f".split()
NUMBER = r"[+-]?[0-9]+(?:[.,:/-][0-9]+)*"


def _template(text: Column, names: bool = True) -> tuple[Column, Column]:
    """(plain words, template words), of equal length: lower-cased without the punctuation around them, with placeholders in the second.

    White space of any kind and length is one blank. A name is a run of capitalised words, not all capitals, after a word
    that ends no sentence; the run is one word here, so names of other lengths fit. Without names they are words as others.
    """
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " ")
    marked = F.regexp_replace(whole, r"(?=\p{Lu}\p{Ll})(?<=[^\s.!?:;|] )", "\u0001") if names else whole
    numbered = F.regexp_replace(marked, rf"(?<![\p{{L}}\p{{N}}])[$€£]?[+-]?{NUMBER}%?(?![\p{{L}}\p{{N}}])", "\u0002$0")
    united = F.regexp_replace(numbered, rf"(?i)(\u0002[^\s\p{{L}}]+\s+)({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", "$1\u0003$2")
    held = F.when(text.rlike("[0-9]"), united).otherwise(marked)  # by the text itself, and below without a question: each step is worked out once for a text
    spaced = F.regexp_replace(F.regexp_replace(held, r"[\p{Punct}&&[^$%+-]]+", ""), r" [ +-]*(?: |$)", " ")
    held = F.lower(F.trim(spaced))
    held = F.regexp_replace(held, "(\u0001\\S*) (?=\u0001)", "$1\u0004") if names else held
    plain = F.translate(held, "\u0001\u0002\u0003", "")
    kinds = F.regexp_replace(held, "([\u0001-\u0003])\\S*", "$1")
    return F.split(plain, " "), F.split(kinds, " ")


def _windows(rows: DataFrame, sizes: list[int], size: Column | None = None) -> DataFrame:
    """(id, pos, h) of each window of template words, of these sizes; of each row's own size where that is given. A window of one word is a word of `single`: no placeholder stands for it."""
    hashed = rows.select("id", *[F.transform(c, lambda w: F.xxhash64(w)).alias(c) for c in ("template", "single")], (F.lit(0) if size is None else size).alias("size"))

    def each(n: int) -> Column:
        w = F.col("single" if n == 1 else "template")
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)]).alias("h"))))

    none = F.array().cast("array<struct<pos:int,h:bigint>>")
    parts = [F.when(F.col("size").isin(0, n), F.coalesce(each(n), none)).otherwise(none) for n in sizes]
    return hashed.select("id", F.explode(F.concat(*parts)).alias("x")).select("id", "x.pos", "x.h")


def text_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, least_share: float = LEAST_SHARE) -> DataFrame:
    """(key, item, item_windows, matched_windows, share, n_slots, changed_slots), one row per leaked item of a text; key: MD5 of the text.

    share = words of the item covered by matched windows / all its words: the most at one distance, give or take a word.
    It is least_share or more, or else RUN covered words follow each other at the very distance. Slots are consistent if no
    value of the item stands for two values of the text there. Equal texts are one; repeated benchmark rows count once.
    """
    text = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").select(text_key(F.col("text")).alias("id"), "text")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    (plain, template), (bare_plain, bare_template) = _template(F.col("text")), _template(F.col("text"), names=False)
    # each item twice: as a template, and with its names as lower-case words, which a text has that shows no name there
    size = F.coalesce(*[F.when(F.size("template") >= n, F.lit(min(w, window))) for n, w in SHORT])
    as_both = items.select("id", F.explode(F.array_distinct(F.array(F.struct(plain.alias("plain"), template.alias("template")), F.struct(bare_plain.alias("plain"), bare_template.alias("template"))))).alias("x"))
    asked_rows = as_both.select("id", "x.*").where("array_join(template, '') <> ''").withColumn("size", size)
    asked_rows = asked_rows.withColumn("template", F.when(F.col("size") == 1, F.col("plain")).otherwise(F.col("template"))).distinct()
    item_rows = staged(asked_rows.select(F.col("id").alias("item_id"), F.concat_ws("/", "id", F.md5(F.array_join("template", " "))).alias("id"), "plain", "template", "size"), "items")
    used = sorted(r["size"] for r in item_rows.select("size").distinct().collect()) or [window]
    asked = _windows(item_rows.withColumn("single", F.col("plain")), used, F.col("size")).select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "h").distinct()
    sizes = item_rows.select(F.col("id").alias("item"), "size", F.size("template").alias("words"))
    few = asked.count() <= BROADCAST_ROWS
    asked = F.broadcast(asked) if few else asked
    single = bare_plain if 1 in used else F.array().cast("array<string>")
    hits = _windows(text.select("id", template.alias("template"), single.alias("single")), used).join(asked, "h").select("id", "item", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"))
    lined = staged(hits.groupBy("id", "item", "shift").agg(F.collect_set("item_pos").alias("at")), "hits")
    near = lined.withColumn("base", F.explode(F.array(*[F.col("shift") + k for k in (-1, 0, 1)])))
    near = near.groupBy("id", "item", "base").agg(F.collect_list(F.struct("shift", "at")).alias("parts")).join(sizes, "item")
    words = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + F.col("size") - 1))))
    covered = words(F.array_distinct(F.flatten(F.transform("parts", lambda x: x["at"]))))
    own = words(F.flatten(F.transform(F.filter("parts", lambda x: x["shift"] == F.col("base")), lambda x: x["at"])))
    near = near.withColumn("covered", F.size(covered)).withColumn("own", own).withColumn("share", F.col("covered") / F.col("words"))
    row = F.exists("own", lambda p: F.size(F.filter("own", lambda q: (q >= p) & (q < p + RUN))) == RUN)
    near = near.withColumn("n", F.size(F.array_distinct(F.flatten(F.transform("parts", lambda x: x["at"])))))
    leaked = staged(near.where((F.col("share") >= least_share) | row).select("id", "item", "base", "parts", "size", "words", "share", "n"), "leaked")
    # of an item's two forms the one that fits better tells whether its slots agree
    forms = item_rows.select(F.col("id").alias("item"), "item_id", F.exists("template", lambda t: t == "\u0001").alias("names"))
    forms = F.broadcast(forms) if few else forms
    better = leaked.join(forms, "item").groupBy("id", "item_id").agg(F.max_by("item", F.struct("share", "names")).alias("item"))
    leaked = leaked.join(better.select("id", "item", "item_id"), ["id", "item"])
    full = leaked.select("id").distinct()
    found = text.join(full, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")).select("id", plain.alias("doc_plain"))
    item_words = item_rows.select(F.col("id").alias("item"), "plain", "template")
    runs = leaked.select("id", "item", "base", "size", F.explode("parts").alias("part")).select("id", "item", "base", "part.shift", words(F.col("part.at")).alias("places"))
    # values in the slots of each place of the item; of two names as long as each other word by word, of others their first words
    slot = lambda kind, was, now: F.struct(kind.alias("kind"), was.alias("was"), now.alias("now"))

    def pairs(kind: Column, was: Column, now: Column) -> Column:
        old, new = F.split(was, "\u0004"), F.split(now, "\u0004")
        whole = F.when(F.size(old) == F.size(new), F.zip_with(old, new, lambda x, y: slot(kind, x, y)))
        return F.when(kind.isin("\u0001", "\u0002", "\u0003"), F.coalesce(whole, F.array(slot(kind, old[0], new[0])))).otherwise(F.array().cast("array<struct<kind:string,was:string,now:string>>"))

    slots = runs.join(item_words, "item").join(found, "id").select(
        "id", "item", "base", F.explode(F.flatten(F.transform("places", lambda p: pairs(F.get("template", p), F.get("plain", p), F.get("doc_plain", p + F.col("shift")))))).alias("slot"),
    ).select("id", "item", "base", "slot.*")
    values = slots.groupBy("id", "item", "base", "kind", "was").agg(F.countDistinct("now").alias("values"), F.min("now").alias("now"))
    per_run = values.groupBy("id", "item", "base").agg(F.count("*").alias("n_slots"), F.sum((F.col("was") != F.col("now")).cast("long")).alias("changed_slots"), F.max("values").alias("values"))
    per = leaked.join(per_run, ["id", "item", "base"], "left").where(F.coalesce("values", F.lit(1)) <= 1)
    per = per.groupBy("id", F.col("item_id").alias("item")).agg(
        F.max(F.col("words") - F.col("size") + 1).cast("long").alias("item_windows"), F.max("n").cast("long").alias("matched_windows"), F.max("share").alias("share"),
        F.coalesce(F.max("n_slots"), F.lit(0)).alias("n_slots"), F.coalesce(F.min("changed_slots"), F.lit(0)).alias("changed_slots"),
    )
    return per.select(F.col("id").alias("key"), "item", "item_windows", "matched_windows", F.round("share", 6).alias("share"), "n_slots", "changed_slots")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, item_windows, matched_windows, share, n_slots, changed_slots), one row per leaked item of a doc_id; see text_leaks.

    Null and empty texts and items leak nothing. Rows with one doc_id are read as one text each and reported together, with the
    greatest share; so are those without one. Empty tables give an empty result.
    """
    found = staged(text_leaks(docs, benchmark, text_col, item_col, item_text, window, least_share), "text-leaks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col).cast("string")).alias("key"))
    most = [F.max(c).alias(c) for c in ("item_windows", "matched_windows", "share", "n_slots")]
    return rows.join(found, "key").groupBy("doc_id", F.col("item").alias("item_id")).agg(*most, F.min("changed_slots").alias("changed_slots"))
