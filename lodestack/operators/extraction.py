"""Entities and relations of documents, from their lines.

A line is a heading, a mail header, a field or a free statement; what it means depends on the lines before: the section's
heading, the sender, the document's project, the people met so far. Lines without any of these forms are left out
before anything is shuffled; the state is what windows by document carry forward, and people are found by joins on first names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import names as N
from lodestack.operators.aliases import alias_map, resolved
from lodestack.sources.staging import staged

#: What predicates are called, and what may stand before and after them.
THINGS = ["ORGANIZATION", "PROJECT", "PRODUCT", "TOOL", "TOPIC", "WORK_ITEM"]
PLACES = ["PLACE", "LOCATION", "ROOM"]
RULES = {
    "OWNS": (["OWNS", "WORKS_ON", "RESPONSIBLE_FOR", "REVIEWS"], ["PERSON"], THINGS),
    "USES": (["USES", "KEEPS", "ADOPTS"], THINGS, THINGS),
    "WORKS_FOR": (["WORKS_FOR"], ["PERSON"], ["ORGANIZATION", "PROJECT", "PRODUCT"]),
    "DEPENDS_ON": (["DEPENDS_ON"], THINGS, THINGS),
    "PREFERS": (["PREFERS"], ["PERSON"], ["TOPIC", "WORK_ITEM", "MODE", "PRODUCT", "TOOL"]),
    "HAS_DEADLINE": (["HAS_DEADLINE", "DUE_ON"], THINGS, ["DATE"]),
    "COMMUNICATES_WITH": (["COMMUNICATES_WITH"], ["PERSON"], ["PERSON"]),
    "INVESTIGATES": (["INVESTIGATES", "EVALUATES"], ["PERSON"], THINGS),
    "NORTH_OF": (["NORTH_OF"], PLACES, PLACES),
    "SOUTH_OF": (["SOUTH_OF"], PLACES, PLACES),
    "EAST_OF": (["EAST_OF"], PLACES, PLACES),
    "WEST_OF": (["WEST_OF"], PLACES, PLACES),
    "AVOIDS": (["AVOIDS"], THINGS, THINGS),
}
#: Forms of lines and units.
HEADER = r"^(From|To|Cc):\s*(.+)$"
MAILBOX = r"(?<![^,<>])([^,<]+?)\s*<([^>]+)>"
VERBS = ["works_on", "depends_on", "uses", "evaluates", "owns", "prefers"]
GRAPH = rf"^([A-Za-z0-9][A-Za-z0-9 ._\-/]+?)\s+({'|'.join(VERBS)})\s+(.+)$"
#: A sign that no subject and no verb holds, put between the parts of a statement.
CUT = "\ufdd0"
REVIEW = r"^([A-Za-z][A-Za-z ._-]+?) will review (.+)$"
ACTION = r"^([A-Za-z][A-Za-z ._-]+?):\s*(.+)$"
GIVEN = r"(?i)(?<![A-Z])([A-Z][A-Z]+(?: [A-Z][A-Z]+)?)\s+(?:gave|sent|handed|passed)\s+(.+?)\s+to\s+([A-Z][A-Z]+(?: [A-Z][A-Z]+)?)"
PLACED = r"(?i)(?<![A-Z0-9 _-])[0-9 _-]*([A-Z][A-Z0-9 _-]+?)\s+is\s+(north|south|east|west)\s+of\s+([A-Z][A-Z0-9 _-]+)"
UNIT_HINT = r"(?i)\b(?:gave|sent|handed|passed)\s|\sis\s+(?:north|south|east|west)\s+of\s"
#: No line has a form without one of these.
LINE_HINT = r"(?i)^\s*#|:|\s(?:works_on|depends_on|uses|evaluates|owns|prefers)\s|will review|I prefer|JSON-RPC|namespace|user_id"
MONTH_DATE = r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+\d{4}\b"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
DATE = f"{MONTH_DATE}|{ISO_DATE}"
PERSON = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"
WORK = ["MILESTONE", "ROADMAP", "CONTRACT", "API", "MEMORY", "FIXTURE", "THREAD", "WORK"]
ROOMS = ["OFFICE", "ROOM", "GARDEN", "KITCHEN"]
#: Words without which a text has no unit, and a line no form; lower case.
UNIT_WORDS = ["gave", "sent", "handed", "passed", "north", "south", "east", "west"]
LINE_WORDS = ["#", *VERBS, "will review", "i prefer", "json-rpc", "namespace", "user_id"]
OPPOSITE = {"NORTH": "SOUTH", "SOUTH": "NORTH", "EAST": "WEST", "WEST": "EAST"}
#: Fields, each with the confidence of what it says.
FIELDS = ["Subject", "Date", "Project name", "Subproject", "Owner", "Name", "Due date", "Target milestone", "Preferred embedding model for local experiments", "Preferred extraction mode to try first"]
#: All types of an entity, and a number that no line reaches; a time and a type are one number, so that they are counted without sorting.
TYPES = ["DATE", "MODE", "ORGANIZATION", "PERSON", "PRODUCT", "PROJECT", "ROOM", "TOOL", "TOPIC", "WORK_ITEM"]
LAST_LINE = 10**11
STEP_NAMES = ["subject", "subject_type", "predicate", "object", "object_type", "confidence"]
STEP = "struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string,confidence:double>"
#: Noncharacters that no text should hold; they are taken out of texts that do.
FULL, SHORT = "\ufdd0", "\ufdd1"


@dataclass(frozen=True)
class Names:
    """What a host's own words mean: products and organizations by name (upper case), and words that make a title or subject speak of a project."""

    products: list[str] = field(default_factory=lambda: ["JSON-RPC", "JSON-RPC 2.0"])
    organizations: list[str] = field(default_factory=list)
    projects: dict[str, str] = field(default_factory=dict)


def _holds(c: Column, *words: str) -> Column:
    """One of the words at least; far cheaper than a pattern, so it is asked first."""
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def _said(line: Column) -> Column:
    """What follows the first colon, all of a line without one."""
    return F.ltrim(F.substr(line, F.instr(line, F.lit(":")) + 1))


def _later_classes(up: Column, names: Names) -> Column:
    """Type of an entity, not empty, that is no date, address or person by its form."""
    organization = F.exists(F.array(*map(F.lit, names.organizations)), lambda o: F.contains(up, o)) if names.organizations else F.lit(False)
    return (
        F.when(up.isin(names.products), "PRODUCT").when(F.contains(up, F.lit("MODEL")), "TOOL").when(F.contains(up, F.lit("MODE")), "MODE").when(_holds(up, *WORK), "WORK_ITEM")
        .when(_holds(up, *ROOMS), "ROOM").when(organization | F.endswith(up, F.lit("CORE")), "ORGANIZATION").when(_holds(up, "-", "_") & ~_holds(up, " "), "PROJECT").otherwise("TOPIC")
    )


def _class(name: Column, up: Column, later: Column) -> Column:
    """up: the name as entity_name gives it, a column of its own, since it is asked for many times."""
    dated = (_holds(name, ",") & name.rlike(MONTH_DATE)) | (_holds(name, "-") & name.rlike(ISO_DATE))
    return F.when(F.coalesce(up, F.lit("")) == "", "TOPIC").when(dated, "DATE").when(_holds(up, "@"), "ORGANIZATION").when(_holds(name, " ") & name.rlike(PERSON), "PERSON").otherwise(later)


def entity_class(name: Column, names: Names) -> Column:
    """Type of an entity by its name alone; people that are known by a first name are not known here."""
    up = N.entity_name(name)
    return _class(name, up, _later_classes(up, names))


def _open_class(name: Column, up: Column, names: Names) -> Column:
    """Type of an entity; with a leading ? where a known first name makes it a person."""
    return _class(name, up, F.concat(F.lit("?"), _later_classes(up, names)))


def _people(value: Column) -> Column:
    found = F.transform(F.transform(F.regexp_extract_all(value, F.lit(MAILBOX), F.lit(1)), lambda n: N.fact(F.ltrim(n))), N.entity_name)
    return F.when(F.contains(value, F.lit("<")), F.filter(found, lambda n: n != "")).otherwise(F.array().cast("array<string>"))


def _step(subject, subject_type, predicate=None, object_=None, object_type=None, confidence=0.0) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = [column(subject), column(subject_type), column(predicate), column(object_), column(object_type), column(confidence)]
    return F.struct(*parts).cast(STEP)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, title, named, at, raw, line, cut, form, wish, task, decided) of lines that may be a heading, header, field, statement or decision."""
    raw, line, up = F.col("raw"), F.col("line"), N.entity_name(F.col("line"))
    hinted = _holds(raw, ":", *[f" {v} " for v in VERBS]) | (_holds(F.lower(raw), *LINE_WORDS) & raw.rlike(LINE_HINT))
    named = docs.select("doc", "title", N.entity_name(F.coalesce("title", F.lit(""))).alias("named"), "text")
    rows = named.select("doc", "title", "named", F.posexplode_outer(F.split("text", "\n")).alias("at", "raw")).where(hinted)
    rows = rows.where(raw.rlike(r"[^\s:;,.-]") | (N.fact(raw) != "")).withColumn("line", N.fact(raw))
    # a statement's parts, cut apart by one reading of the line; lines that are none stay whole
    rows = rows.withColumn("cut", F.when(_holds(line, *VERBS), F.regexp_replace(line, f"{GRAPH}(?s:.*)", f"$1{CUT}$2{CUT}$3")).otherwise(line))
    forms = F.when(_holds(raw, "#") & raw.rlike(r"^\s*#"), "heading").when((line.startswith("From:") | line.startswith("To:") | line.startswith("Cc:")) & line.rlike(HEADER), "header")
    for f in FIELDS:
        forms = forms.when(line.startswith(f"{f}:"), f)
    forms = forms.when(F.col("cut") != line, "graph").when(_holds(line, " will review ") & line.rlike(REVIEW), "review")
    decided = (
        F.when(F.contains(up, F.lit("JSON-RPC")), "uses JSON-RPC").when(up.rlike("SHOULD USE NAMESPACE|USE NAMESPACE AS THE STORAGE|NAMESPACE AS THE MAIN SCOPE KEY"), "uses namespace")
        .when(F.contains(up, F.lit("USER_ID")) & up.rlike("DO NOT NEED|AVOID"), "avoids user_id")
    )
    rows, free = rows.withColumn("form", forms), F.col("form").isNull()
    told = F.when(free & _holds(F.upper(line), "JSON-RPC", "NAMESPACE", "USER_ID"), decided)
    return rows.withColumn("wish", free & line.startswith("I prefer ")).withColumn("task", free & _holds(line, ":") & line.rlike(ACTION)).withColumn("decided", told)


def _stateful(lines: DataFrame, names: Names) -> DataFrame:
    """With what the lines so far say: subject, primary, sender."""
    so_far = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    line, form = F.col("line"), F.col("form")
    value = N.entity_name(_said(line))
    full = lambda c: F.when(c != "", c)
    subject = F.when(form == "heading", full(N.entity_name(F.ltrim(F.regexp_replace("raw", "^#+", ""))))).when(form == "Name", full(value))
    primary = F.when(form == "Subject", primary_of(line, names)).when(form == "Project name", full(value))
    people = F.when(form == "header", _people(F.regexp_extract(line, HEADER, 2)))
    sender = F.when((form == "header") & line.startswith("From:"), F.struct(F.get("people", F.lit(0)).alias("name")))
    kept = lines.withColumn("people", people).withColumns({"lodestack_subject": subject, "lodestack_primary": primary, "lodestack_sender": sender})
    last = lambda n: F.last(f"lodestack_{n}", True).over(so_far)
    carried = kept.withColumns({"subject": last("subject"), "primary": F.coalesce(last("primary"), primary_of(F.col("title"), names)), "sender": last("sender")["name"]})
    return carried.drop("title", "lodestack_subject", "lodestack_primary", "lodestack_sender").withColumnRenamed("named", "title")


def _statements(lines: DataFrame, names: Names) -> DataFrame:
    """With what free lines state: a, verb, b, the types of both, how sure that is, and the first name that must be known for it to count."""
    form, line = F.col("form"), F.col("line")
    wish = F.col("wish") & F.col("sender").isNotNull()
    cut = F.col("cut")
    first, two = F.substring_index(cut, CUT, 1), F.length(F.substring_index(cut, CUT, 2))
    part = lambda pattern, n: F.regexp_extract(line, pattern, n)
    shapes = [
        (form == "graph", first, F.substr(cut, two + 2)), (form == "review", part(REVIEW, 1), part(REVIEW, 2)),
        (wish, F.lit("I prefer "), part("^(I prefer )(.+)$", 2)), (F.col("task"), part(ACTION, 1), part(ACTION, 2)),
    ]
    kind, pattern_1, pattern_2 = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (shape, left, right) in reversed(list(enumerate(shapes))):
        kind = F.when(shape, k).otherwise(kind)
        pattern_1 = F.when(shape, left).otherwise(pattern_1)
        pattern_2 = F.when(shape, right).otherwise(pattern_2)
    rows = lines.withColumn("shape", kind).withColumn("a", F.when(F.col("shape") == 2, F.col("sender")).otherwise(pattern_1)).withColumn("b", F.when(F.col("shape") == 2, N.fact(pattern_2)).otherwise(pattern_2))
    rows = rows.withColumn("a_up", N.entity_name(F.col("a"))).withColumn("b_up", N.entity_name(F.col("b")))
    typed = lambda n: F.when(F.col(n).isNotNull(), _open_class(F.col(n), F.col(f"{n}_up"), names))
    rows = rows.withColumn("a_type", typed("a")).withColumn("b_type", typed("b"))
    verb = F.when(F.col("shape") == 0, F.upper(F.substring_index(F.substring_index(cut, CUT, 2), CUT, -1))).when(F.col("shape") == 1, "REVIEWS").when(F.col("shape") == 2, "PREFERS").when(F.col("shape") == 3, "OWNS")
    sureness = F.get(F.array(*map(F.lit, (0.87, 0.80, 0.92, 0.83))), F.col("shape"))
    return rows.withColumn("verb", verb).withColumn("sureness", sureness).withColumn("need", F.when((F.col("shape") == 3) & (F.col("a_type") != "PERSON"), F.col("a_up"))).drop("cut", "raw")


def primary_of(text: Column, names: Names) -> Column:
    found = F.lit(None).cast("string")
    for word, project in reversed(names.projects.items()):
        found = F.when(F.contains(text, F.lit(word)), project).otherwise(found)
    return found


def _steps(lines: DataFrame) -> DataFrame:
    """(doc, at, time, need, instead, subject, subject_type, predicate, object, object_type, confidence): entities and relations in the order they are met.

    need: a first name that must be known by then; instead: what a line says whose first name isn't.
    """
    form, sender, people = F.col("form"), F.col("sender"), F.col("people")
    value, document = _said(F.col("line")), F.coalesce("primary", "title")
    what, value, document = N.entity_name(N.fact(value)), N.entity_name(value), N.entity_name(document)  # a line has one case, so it is worked out for one
    primary = N.entity_name(F.col("primary"))
    fields = [
        ((form == "Date") & sender.isNotNull(), sender, "PERSON", "HAS_DEADLINE", what, "DATE", 0.75),
        (form == "Project name", value, "PROJECT", None, None, None, 0.96),
        (form == "Subproject", value, "PROJECT", None, None, None, 0.92),
        (form == "Owner", value, "PERSON", "OWNS", F.coalesce(F.col("subject"), document), "WORK_ITEM", 0.94),
        (form == "Name", value, "WORK_ITEM", None, None, None, 0.93),
        (form == "Due date", F.coalesce(F.col("subject"), primary, F.lit("DOCUMENT")), "WORK_ITEM", "HAS_DEADLINE", what, "DATE", 0.92),
        (form == "Target milestone", document, "PROJECT", "HAS_DEADLINE", what, "DATE", 0.92),
        (form == FIELDS[8], document, "PROJECT", "USES", what, "TOOL", 0.88),
        (form == FIELDS[9], document, "PROJECT", "USES", what, "MODE", 0.88),
        (F.col("a").isNotNull(), F.col("a_up"), F.when(form == "graph", F.col("a_type")).otherwise("PERSON"), F.col("verb"), F.col("b_up"), F.col("b_type"), F.col("sureness")),
    ]
    decided = F.col("decided")
    decisions = [
        (decided == "uses JSON-RPC", document, "PROJECT", "USES", "JSON-RPC", "PRODUCT", 0.86),
        (decided == "uses namespace", document, "PROJECT", "USES", "NAMESPACE", "TOPIC", 0.84),
        (decided == "avoids user_id", document, "PROJECT", "AVOIDS", "USER_ID", "TOPIC", 0.82),
    ]

    def one(cases) -> Column:
        step = F.lit(None).cast(STEP)
        for shape, *said in reversed(cases):
            step = F.when(shape, _step(*said)).otherwise(step)
        return step

    def item(k, need: Column, instead: Column, step: Column) -> Column:
        return F.struct(k.cast("int").alias("k"), need.cast("string").alias("need"), instead.alias("instead"), step.alias("step"))

    no, need = F.lit(False), F.col("need")
    met = F.transform(people, lambda p, i: item(i, F.lit(None), no, _step(p, "PERSON", confidence=0.95)))
    told = F.transform(people, lambda p, i: item(i + F.size(people), F.lit(None), no, _step(sender, "PERSON", "COMMUNICATES_WITH", p, "PERSON", 0.82)))
    heads = F.when(F.startswith("line", F.lit("From:")) | sender.isNull(), met).otherwise(F.concat(met, told))
    late = decided.isNotNull() & (F.col("shape").isNull() | need.isNotNull())
    others = F.array(item(F.lit(0), need, no, one(fields)), item(F.lit(0), need, need.isNotNull(), F.when(late, one(decisions))))
    # outer: else Spark works out the array for a filter as well
    rows = lines.select("doc", "at", F.explode_outer(F.when(form == "header", heads).otherwise(others)).alias("x")).where("x.step.subject is not null")
    return rows.select("doc", "at", (F.col("at") * 1_000_000 + F.col("x.k") * 2).cast("long").alias("time"), "x.need", "x.instead", "x.step.*")


def _named(steps: DataFrame) -> DataFrame:
    """With subject and object as entity names."""
    return steps.select(*[N.entity_name(F.col(c)).alias(c) if c in ("subject", "object") else c for c in steps.columns])


def units_of(docs: DataFrame, by_sentence: bool = True) -> DataFrame:
    """(doc, at, unit): sentences, those of under five bytes with the one before; or whole texts. Only of texts in which something is handed over or lies somewhere."""
    text = F.regexp_replace("text", f"[{FULL}{SHORT}]", "")
    hinted = docs.where(F.exists(F.array(F.lower("text")), lambda low: _holds(low, *UNIT_WORDS)) & F.col("text").rlike(UNIT_HINT))
    if not by_sentence:
        return hinted.select("doc", F.lit(0).alias("at"), N.fact(text).alias("unit"))
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?\n])"), N.fact), lambda s: s != "")
    marked = F.array_join(F.transform(parts, lambda s: F.concat(F.when(F.octet_length(s) < 5, SHORT).otherwise(FULL), s)), "")
    joined = F.translate(F.substring(marked, 2, 1 << 30), SHORT, " ")  # a short one with which the text begins stands alone
    return hinted.select("doc", F.posexplode(F.split(joined, FULL)).alias("at", "unit"))


def _unit_steps(units: DataFrame, names: Names) -> DataFrame:
    taken = lambda pattern: [F.regexp_extract("unit", pattern, n).alias(f"g{n}") for n in (1, 2, 3)]
    gave = units.where(F.col("unit").rlike(GIVEN)).select("doc", "at", *taken(GIVEN)).withColumn("up", N.entity_name(F.col("g2"))).withColumn("type", _open_class(F.col("g2"), F.col("up"), names))
    gave = gave.select("doc", "at", F.posexplode(F.array(_step(F.col("g1"), "PERSON", "USES", F.col("g2"), F.col("type"), 0.62), _step(F.col("g3"), "PERSON", "USES", F.col("g2"), F.col("type"), 0.55))).alias("k", "step"))
    lies = units.where(F.col("unit").rlike(PLACED)).select("doc", "at", *taken(PLACED)).withColumn("way", F.upper("g2"))
    back = F.element_at(F.create_map(*[F.lit(x) for pair in OPPOSITE.items() for x in pair]), F.col("way"))
    lies = lies.select("doc", "at", F.posexplode(F.array(_step(F.col("g1"), "ROOM", F.concat("way", F.lit("_OF")), F.col("g3"), "ROOM", 0.70), _step(F.col("g3"), "ROOM", F.concat(back, F.lit("_OF")), F.col("g1"), "ROOM", 0.70))).alias("k", "step"))
    rows = gave.unionAll(lies.withColumn("k", F.col("k") + 2))
    return _named(rows.select("doc", (F.col("at") + 10**12).alias("at"), ((F.col("at") + LAST_LINE) * 1_000_000 + F.col("k") * 2).cast("long").alias("time"), F.lit(None).cast("string").alias("need"), F.lit(False).alias("instead"), "step.*"))


def _mentions(steps: DataFrame) -> DataFrame:
    """(doc, word, since, full, need): people by their first names. A task names its own person only if that one is known already."""
    said = lambda n, t, shift, holds: F.when((F.col(t) == "PERSON") & (F.col(n) != "") & holds, F.struct(F.split(n, " ")[0].alias("word"), (F.col("time") + shift).alias("since"), F.col(n).alias("full")))
    sides = F.array(said("subject", "subject_type", 0, F.col("need").isNull()), said("object", "object_type", 1, F.lit(True)))
    return steps.where("subject <> '' and not instead").select("doc", "need", F.explode(sides).alias("x")).where("x is not null").select("doc", "x.*", "need")


def _first(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("doc", "word").agg(F.min("since").alias("since"), F.min_by("full", "since").alias("full"))


def _first_names(steps: DataFrame) -> DataFrame:
    """(doc, word, since, full): the first person of each first name, staged; of names that nothing asks for and that stand for themselves none need be here.

    A task may name a person only if its own is known, so these are followed until no name is met earlier.
    """
    mentions = _mentions(steps)
    waiting = mentions.where("need is not null")
    if waiting.isEmpty():
        open_name = lambda n: F.when(F.col(f"{n}_type").startswith("?"), F.col(n))
        asked = steps.select("doc", F.explode(F.array("need", open_name("subject"), open_name("object"))).alias("word")).where("word is not null and word not like '% %'")
        no = F.lit(False)
        told = mentions.select("doc", "word", "since", no.alias("asked"), (F.col("full") != F.col("word")).alias("longer"))
        words = told.unionByName(asked.select("doc", "word", F.lit(None).cast("long").alias("since"), F.lit(True).alias("asked"), no.alias("longer")))
        used = words.groupBy("doc", "word").agg(F.min("since").alias("since"), F.max("asked").alias("asked"), F.max("longer").alias("longer")).where("since is not null and (asked or longer)")
        return staged(_first(mentions.join(staged(used.select("doc", "word"), "asked"), ["doc", "word"], "left_semi")), "known")
    known = staged(_first(mentions.where("need is null")), "known")
    while True:
        asked = known.select("doc", F.col("word").alias("need"), F.col("since").alias("lodestack_since"))
        more = waiting.join(asked, ["doc", "need"]).where("lodestack_since < since").select("doc", "word", "since", "full")
        earlier = more.join(known.select("doc", "word", F.col("since").alias("lodestack_since")), ["doc", "word"], "left").where("lodestack_since is null or since < lodestack_since")
        if earlier.isEmpty():
            return known
        known = staged(_first(known.unionByName(more)), "known")


def _settled(steps: DataFrame, known: DataFrame) -> DataFrame:
    """Steps that count, with people by their full names and types by who was known."""
    s = _counted(steps, known).withColumnsRenamed({"subject": "s", "object": "o"})
    for n in ("s", "o"):
        s = s.join(known.select("doc", F.col("word").alias(n), F.col("since").alias(f"{n}_since"), F.col("full").alias(f"{n}_full")), ["doc", n], "left")
    time = F.col("time")
    typed = lambda t, n: F.when(F.col(t).startswith("?") & (F.col(f"{n}_since") < time), "PERSON").otherwise(F.ltrim(F.col(t), F.lit("?")))
    s = s.withColumn("subject_type", typed("subject_type", "s")).withColumn("object_type", typed("object_type", "o"))
    full = lambda t, n, by: F.when((F.col(t) == "PERSON") & (F.col(f"{n}_since") <= time + by), F.col(f"{n}_full")).otherwise(F.col(n))
    return s.select("doc", "at", "time", full("subject_type", "s", 0).alias("subject"), "subject_type", "predicate", full("object_type", "o", 1).alias("object"), "object_type", "confidence").where("subject <> ''")


def _counted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows without a need, those whose first name is known by then, and those instead of one whose isn't."""
    asked = known.select("doc", F.col("word").alias("need"), F.col("since").alias("need_since"))
    met = F.coalesce(F.col("need_since") < F.col("time"), F.lit(False))
    waiting = rows.where("need is not null").join(asked, ["doc", "need"], "left").where(met != F.col("instead"))
    return rows.where("need is null").unionByName(waiting.select(rows.columns))


def _marks(lines: DataFrame) -> DataFrame:
    """(doc, time, need, instead, tag, decision, preference) of lines that say one of them."""
    form, line = F.col("form"), F.col("line")
    of_document = F.coalesce("primary", "title")
    prefers = F.col("verb") == "PREFERS"
    chosen = form.isin(FIELDS[8:])
    preference = F.when(prefers, F.concat(N.entity_name(F.col("a")), F.lit(" prefers "), N.fact(F.col("b"))))
    decision = F.when(chosen, F.concat(of_document, F.lit(" uses "), N.fact(_said(line))))
    decided = F.concat(of_document, F.lit(" "), F.col("decided"))
    tag = F.when(prefers, "preference").when(F.col("shape").isin(1, 3), "owner").when(form.isin("Due date", "Target milestone"), "deadline").when(chosen, "decision")
    mark = lambda instead, tag, decision, preference: F.struct(F.col("need"), F.lit(instead).alias("instead"), tag.alias("tag"), decision.alias("decision"), preference.alias("preference"))
    null = F.lit(None).cast("string")
    late = F.when(F.col("decided").isNotNull() & (F.col("shape").isNull() | F.col("need").isNotNull()), mark(True, F.lit("decision"), decided, null))
    first = F.when(tag.isNotNull(), mark(False, tag, decision, preference))
    rows = lines.select("doc", (F.col("at") * 1_000_000).cast("long").alias("time"), F.explode(F.array_compact(F.array(first, late))).alias("m")).select("doc", "time", "m.*")
    return rows.withColumn("instead", F.col("instead") & F.col("need").isNotNull())


def _compiled(df: DataFrame, name: str) -> DataFrame:
    """Staged, with the expressions of large plans in methods of up to 8,000 bytes; longer ones are never compiled by the JVM."""
    conf, limit = df.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    before = conf.get(limit)
    conf.set(limit, "8000")
    try:
        return staged(df, name)
    finally:
        conf.set(limit, before)


def _lines(docs: DataFrame, names: Names) -> DataFrame:
    return _statements(_stateful(lines_of(docs), names), names)


def _texts(docs: DataFrame) -> DataFrame:
    """Dealt by document before texts are cut into lines: a small file holds work for all tasks, and a text is less than its lines."""
    spark = docs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.select("doc", "title", F.coalesce("text", F.lit("")).alias("text")).repartition(tasks, "doc")


def _staged_steps(docs: DataFrame, lines: DataFrame, names: Names, by_sentence: bool) -> DataFrame:
    return _compiled(_steps(lines).unionByName(_unit_steps(units_of(docs, by_sentence), names)), "steps")


def _facts(lines: DataFrame, known: DataFrame | None) -> DataFrame:
    """known: None where no line needs a first name."""
    marks = _marks(lines) if known is None else _counted(_marks(lines), known)
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    primary = lines.where("primary is not null").select("doc", *null("string", "tag", "decision", "preference"), "at", "primary")
    rows = marks.select("doc", "tag", "decision", "preference", *null("int", "at"), *null("string", "primary")).unionByName(primary)
    sorted_set = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    told = rows.groupBy("doc").agg(sorted_set("tag"), sorted_set("decision"), sorted_set("preference"), F.max_by("primary", F.when(F.col("primary").isNotNull(), F.col("at"))).alias("primary"))
    return told.select("doc", "tags", "decisions", "preferences", F.when((F.size("decisions") > 0) | (F.size("preferences") > 0), "profile").alias("kind"), "primary")


def facts_of(docs: DataFrame, names: Names | None = None, by_sentence: bool = True) -> DataFrame:
    """What documents say, the third table of `extract`, staged, without working out entities and relations; first names are looked for only in documents with a line that needs one."""
    docs, names = _texts(docs), names or Names()
    lines = _compiled(_lines(docs, names), "lines")
    asking = lines.where("need is not null").select("doc").distinct()
    if asking.isEmpty():
        return staged(_facts(lines, None), "facts")
    some = [df.join(asking, "doc", "left_semi") for df in (docs, lines)]
    return staged(_facts(lines, _first_names(_staged_steps(*some, names, by_sentence))), "facts")


def _met(settled: DataFrame) -> DataFrame:
    """(doc, name, type, confidence, mixed, short) of entities: the type that they are met with first, whether they are met with others too, and whether they may begin or end a longer name.

    Names of several words ask for their beginnings and ends in the same grouping; numbers alone are kept while grouping, so nothing is sorted.
    """
    code = lambda t: (F.array_position(F.array(*map(F.lit, TYPES)), F.col(t)) - 1).cast("int")
    side = lambda n, shift: F.struct(F.col(n).alias("name"), code(f"{n}_type").alias("code"), (F.col("time") + shift).alias("time"))
    sides = settled.select("doc", "confidence", F.explode(F.array(side("subject", 0), side("object", 1))).alias("x")).select("doc", "confidence", "x.*").where("name <> ''")
    words, n = F.split("name", " "), F.size(F.split("name", " "))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array(F.array_join(F.slice(words, 1, i), " "), F.array_join(F.slice(words, i + 1, n), " "))))
    several = F.when(F.contains("name", F.lit(" ")), F.concat(F.array("name"), parts)).otherwise(F.array("name"))
    asks = sides.withColumn("bit", F.expr("shiftleft(1, code)")).select("doc", "confidence", "time", "code", "bit", F.col("name").alias("whole"), F.explode_outer(several).alias("name"))
    own = F.col("name") == F.col("whole")  # a part is shorter
    rows = asks.select("doc", "name", F.when(own, F.col("time") * 16 + F.col("code")).alias("first"), F.when(own, F.col("confidence")).alias("confidence"), F.when(own, F.col("bit")).otherwise(0).alias("types"), F.when(own, 0).otherwise(F.col("bit")).alias("asked"))
    grouped = rows.groupBy("doc", "name").agg(F.min("first").alias("first"), F.max("confidence").alias("confidence"), F.bit_or("types").alias("types"), F.bit_or("asked").alias("asked")).where("first is not null")
    kind = F.pmod(F.col("first"), F.lit(16)).cast("int")
    return grouped.select("doc", "name", F.element_at(F.array(*map(F.lit, TYPES)), kind + 1).alias("type"), "confidence", (F.bit_count("types") > 1).alias("mixed"), F.col("asked").bitwiseAND(F.call_function("shiftleft", F.lit(1), kind)).alias("short")).withColumn("short", F.col("short") != 0)


def extract(docs: DataFrame, names: Names | None = None, by_sentence: bool = True, least_entity: float = 0.45, least_relation: float = 0.30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (doc, name, type, confidence, aliases), relations (doc, subject, subject_type, predicate, object, object_type, confidence, evidence, at) and what a document says
    (doc, tags, decisions, preferences, kind, primary) of docs (doc, title, text); doc is a unique id.

    An entity keeps the type it is met with first and its best confidence; a relation needs a rule that allows both types and two different names.
    Short names go to the longest of their type that begins or ends with them. evidence counts lines and units. Null texts and titles are empty ones; documents in which nothing is said have no rows.
    """
    docs, names = _texts(docs), names or Names()
    lines = _lines(docs, names)
    steps = _staged_steps(docs, lines, names, by_sentence)
    known = _first_names(steps)
    settled = _settled(steps, known)
    found = _compiled(_met(settled), "entities")
    # aliases are looked for only where a name begins or ends another; all others stand for themselves
    some = found.join(found.where("short").select("doc").distinct(), "doc", "left_semi").where("short or name like '% %'")
    longer = staged(alias_map(some.select(F.struct("doc", "type").alias("type"), "name")), "aliases")
    longer = staged(resolved(longer).select(F.col("type.doc").alias("doc"), F.col("alias").alias("name"), "canonical"), "canonical")
    typed = found.join(longer, ["doc", "name"], "left").select("doc", "name", "type", "confidence", "mixed", F.coalesce("canonical", "name").alias("canonical"))
    joined = longer.select("doc", "name").union(longer.select("doc", "canonical")).distinct()
    other = F.when(F.col("name") != F.col("canonical"), F.col("name"))
    merged = typed.join(joined, ["doc", "name"], "left_semi").groupBy("doc", F.col("canonical").alias("name")).agg(F.first("type").alias("type"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(other)).alias("aliases"))
    entities = found.join(joined, ["doc", "name"], "left_anti").select("doc", "name", "type", "confidence", F.array().cast("array<string>").alias("aliases")).unionByName(merged)

    # a statement's types hold unless its names are met with others too: a document's few such names, and its aliases, come in one join
    odd = typed.where("mixed or canonical <> name").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("type", "canonical")))).alias("odd"))
    said = settled.where("predicate is not null and object <> '' and subject <> object").join(odd, "doc", "left")
    for n in ("subject", "object"):
        said = said.withColumn("lodestack_odd", F.try_element_at("odd", F.col(n)))
        said = said.withColumn(f"{n}_type", F.coalesce("lodestack_odd.type", f"{n}_type")).withColumn(f"{n}_name", F.coalesce("lodestack_odd.canonical", n))
    # looked up, not asked one by one: all that a rule allows, and the rule of each predicate
    allowed = [f"{verb}|{head}|{tail}" for also, heads, tails in RULES.values() for verb in also for head in heads for tail in tails]
    rule = F.try_element_at(F.create_map(*[F.lit(x) for canonical, (also, _, _) in RULES.items() for verb in also for x in (verb, canonical)]), F.col("predicate"))
    said = said.where(F.concat_ws("|", "predicate", "subject_type", "object_type").isin(allowed) & (F.col("subject_name") != F.col("object_name")))
    # a name has one type in a document
    by = ["doc", F.col("subject_name").alias("subject"), rule.alias("predicate"), F.col("object_name").alias("object"), "subject_type", "object_type"]
    relations = said.groupBy(*by).agg(F.max("confidence").alias("confidence"), F.count_distinct("at").alias("evidence"), F.min("at").alias("at"))

    return entities.where(F.col("confidence") >= least_entity), relations.where(F.col("confidence") >= least_relation), _facts(lines, known)


def enriched(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """docs (doc, tags, kind, ...) with the tags found in them, sorted, and the kind of those that say decisions or preferences; null tags are none."""
    more = facts.select("doc", F.col("tags").alias("lodestack_tags"), F.col("kind").alias("lodestack_kind"))
    none = F.array().cast("array<string>")
    tags = F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("lodestack_tags", none)))
    return docs.join(more, "doc", "left").withColumn("tags", tags).withColumn("kind", F.coalesce("lodestack_kind", "kind")).select(docs.columns)
