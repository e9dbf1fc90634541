"""Logs of agent sessions, JSON lines in two dialects: what users said, with what they interrupted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.names import bare

#: Characters of an assistant's text that are kept; how corrections begin and what they hold; how texts begin that no user wrote, by dialect.
CONTEXT = 200
OPENERS = ["no,", "no ", "nope", "actually", "wait", "stop", "don't", "dont", "instead", "revert", "undo", "that's wrong", "thats wrong", "not like that"]
WITHIN = ["not what i", "do it again", "that's not"]
SYNTHETIC = {
    "message": ["<local-command", "<command-name", "<command-message", "Caveat:", "<bash-"],
    "payload": ["<environment_context>", "<user_instructions>", "<subagent_notification>", "<permissions"],
}
REMINDER = r"(?s)<system-reminder>(?:.*?</system-reminder>)?"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, line) of every line of text files; place orders a file's lines, and large files are read by several tasks."""
    rows = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    return rows.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), F.regexp_replace("value", "\r$", "").alias("line"))


def is_correction(text: Column) -> Column:
    """Whether a user's text takes something back."""
    low = F.lower(F.regexp_replace(text, r"^\s+", ""))
    begins, holds = F.lit(False), F.lit(False)
    for x in OPENERS:
        begins = begins | low.startswith(x)
    for x in WITHIN:
        holds = holds | F.contains(low, F.lit(x))
    return begins | holds


def _texts(content: Column, kinds: list[str]) -> Column:
    """Texts of a content's blocks of these kinds, a line each; null if it is no list."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    of_kind = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string").isin(kinds))
    return F.array_join(F.transform(of_kind, lambda b: F.try_variant_get(b, "$.text", "string")), "\n")


def _first(value: Column, place: str) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col(place)))


def turns(lines: DataFrame, dialect: str = "message") -> tuple[DataFrame, DataFrame]:
    """(path, place, at, tier, excerpt) of what users said, and (path, scope, session, bytes, broken) of every log, of lines (path, place, line); place orders the lines of a path.

    A correction is of tier 1 and names what the assistant said last, others are of tier 2. Tool results, side chains and what a harness wrote are left out.
    Blank lines are skipped, lines that are no JSON (a null line too) count as broken; bytes counts all lines with their ends. Turns without a time have null there.
    """
    v = F.col("v")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    parsed = lines.withColumn("v", F.try_parse_json(bare(F.col("line"))))
    if dialect == "message":
        content = get("$.message.content", "variant")
        blocks = F.try_variant_get(content, "$", "array<variant>")
        tool = F.coalesce(F.exists(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "tool_result"), F.lit(False))
        said = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(_texts(content, ["text"]))
        by = get("$.type")
        own = ~tool & ~F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)) & ~F.coalesce(get("$.isMeta", "boolean"), F.lit(False))
        scope, session = get("$.cwd"), get("$.sessionId")
    elif dialect == "payload":
        message = (get("$.type") == "response_item") & (get("$.payload.type") == "message")
        said, by, own = _texts(get("$.payload.content", "variant"), ["input_text", "output_text", "text"]), F.when(message, get("$.payload.role")), F.lit(True)
        meta = get("$.type") == "session_meta"
        scope, session = F.when(meta, get("$.payload.cwd")), F.when(meta, get("$.payload.id"))
    else:
        raise ValueError(f"no dialect {dialect}")
    said = bare(said)
    made = F.lit(False)
    for x in SYNTHETIC[dialect]:
        made = made | said.startswith(x)
    read = parsed.select("path", "place", F.octet_length("line").alias("size"), (v.isNull() & (F.coalesce(bare(F.col("line")), F.lit("?")) != "")).alias("broken"), by.alias("by"), own.alias("own"), said.alias("said"), made.alias("made"), scope.alias("scope"), session.alias("session"), F.try_to_timestamp(get("$.timestamp")).alias("at"))
    logs = read.groupBy("path").agg(_first(F.col("scope"), "place").alias("scope"), _first(F.col("session"), "place").alias("session"), F.sum(F.coalesce("size", F.lit(0)) + 1).cast("long").alias("bytes"), F.sum(F.col("broken").cast("int")).cast("long").alias("broken"))

    text = bare(F.regexp_replace("said", REMINDER, "")) if dialect == "message" else F.col("said")
    heard = read.where("said <> '' and (by = 'assistant' or (by = 'user' and own and not made))").select("path", "place", "at", "by", F.when(F.col("by") == "user", text).otherwise(F.substring("said", 1, CONTEXT)).alias("text"))
    before = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    heard = heard.withColumn("context", F.last(F.when(F.col("by") == "assistant", F.col("text")), True).over(before)).where("by = 'user' and text <> ''")
    quoted = F.coalesce(F.concat(F.lit('user (interrupting agent that said "'), "context", F.lit('"): '), "text"), F.concat(F.lit("user (interrupt): "), "text"))
    taken_back = is_correction(F.col("text"))
    return heard.select("path", "place", "at", F.when(taken_back, 1).otherwise(2).alias("tier"), F.when(taken_back, quoted).otherwise(F.concat(F.lit("user: "), "text")).alias("excerpt")), logs
