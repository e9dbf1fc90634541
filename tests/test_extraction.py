"""Extraction of entities and relations: fixed documents, and a plain loop over the lines of random ones."""

import random
import re

from lodestack.operators.extraction import DATE, FIELDS, PERSON, RULES, Names, enriched, extract

NAMES = Names(projects={"Lodeproject": "LODEPROJECT"})
SCHEMA = "doc int, title string, text string"
MAIL = """From: Sanil Jain <s@x.org>
To: Ravi Kulkarni <r@x.org>, Asha Mehta <a@x.org>
Subject: Lodeproject plan
Date: Jan 4, 2026

# Core contract locked
Owner: Ravi Kulkarni
Due date: 2026-02-01
- Core should use JSON-RPC for calls.
Ravi: write the API docs
I prefer small patches"""
MAP = "Alice Smith sent the launch checklist to Bob Jones. Kitchen is north of Garden. East Room is east of Office."


def relations(frame):
    return {(r.doc, r.subject, r.predicate, r.object) for r in frame.collect()}


def test_mail_and_places(spark):
    docs = spark.createDataFrame([(1, "Plan", MAIL), (2, None, None), (3, "Office map", MAP), (4, "", "")], SCHEMA)
    entities, found, facts = extract(docs, NAMES)
    assert relations(found) == {
        (1, "SANIL JAIN", "COMMUNICATES_WITH", "RAVI KULKARNI"), (1, "SANIL JAIN", "COMMUNICATES_WITH", "ASHA MEHTA"), (1, "RAVI KULKARNI", "OWNS", "CORE CONTRACT LOCKED"),
        (1, "CORE CONTRACT LOCKED", "HAS_DEADLINE", "2026-02-01"), (1, "LODEPROJECT", "USES", "JSON-RPC"), (1, "RAVI KULKARNI", "OWNS", "WRITE THE API DOCS"), (1, "SANIL JAIN", "PREFERS", "SMALL PATCHES"),
        (3, "KITCHEN", "NORTH_OF", "GARDEN"), (3, "GARDEN", "SOUTH_OF", "KITCHEN"), (3, "EAST ROOM", "EAST_OF", "OFFICE"), (3, "OFFICE", "WEST_OF", "EAST ROOM"),
    }
    assert {"ALICE SMITH", "BOB JONES"} <= {r.name for r in entities.where("doc = 3 and type = 'PERSON'").collect()}
    (told,) = facts.collect()
    assert (told.doc, told.tags, told.decisions, told.preferences, told.kind, told.primary) == (1, ["deadline", "decision", "owner", "preference"], ["LODEPROJECT uses JSON-RPC"], ["SANIL JAIN prefers small patches"], "profile", "LODEPROJECT")
    tagged = spark.createDataFrame([(1, ["b", "deadline"], None, "extra"), (3, None, "chat", "x")], "doc int, tags array<string>, kind string, lodestack_note string")
    assert [(r.doc, r.tags, r.kind) for r in enriched(tagged, facts).orderBy("doc").collect()] == [(1, ["b", "deadline", "decision", "owner", "preference"], "profile"), (3, [], "chat")]


def test_whole_text_is_one_unit(spark):
    found = extract(spark.createDataFrame([(1, "t", MAP)], SCHEMA), by_sentence=False, least_relation=0.1)[1]
    assert relations(found) == {(1, "KITCHEN", "NORTH_OF", "GARDEN"), (1, "GARDEN", "SOUTH_OF", "KITCHEN")}


def test_short_names_and_chains_of_known_people(spark):
    text = "From: Ann Lee <a>\nBob: early\nAnn: Bob Stone roadmap\nBob: Cy Young thread\nCy: api\nDan: nothing\nOwner: Atlas Core\nAtlas Core Team uses Memory API\nTeam owns Memory"
    entities, found, _ = extract(spark.createDataFrame([(1, "t", text)], SCHEMA))
    owned = {(r.subject, r.object) for r in found.where("predicate = 'OWNS'").collect()}
    assert owned == {("CY YOUNG THREAD", "MEMORY API"), ("ATLAS CORE TEAM", "T")}  # Cy was known by two steps; people own no people, and a team alone is no person
    assert {r.name for r in entities.where("type = 'PERSON'").collect()} >= {"ANN LEE", "BOB STONE ROADMAP", "CY YOUNG THREAD"}
    assert {r.name: r.aliases for r in entities.where("size(aliases) > 0").collect()} == {"MEMORY API": ["API", "MEMORY"], "ATLAS CORE TEAM": ["ATLAS CORE"]}
    assert "EARLY" not in {r.name for r in entities.collect()}  # Bob wasn't known yet


def test_no_rows(spark):
    assert [f.count() for f in extract(spark.createDataFrame([], SCHEMA))] == [0, 0, 0]


# A plain loop, line by line.


def tidy(text):
    return " ".join(text.split())


def fact(text):
    return tidy(text.strip().lstrip("-").strip().strip(":;,."))


def entity(text):
    return tidy(text.strip().strip("-:;,.\"'()")).upper()


class Loop:
    def __init__(self, title):
        self.title, self.subject, self.primary, self.sender = entity(title), None, None, None
        self.known, self.types, self.found = {}, {}, {}

    def kind(self, name):
        up = entity(name)
        for ok, found in (
            (not up, "TOPIC"), (re.search(DATE, name), "DATE"), ("@" in up, "ORGANIZATION"), (up in self.known or re.search(PERSON, name), "PERSON"), (up in NAMES.products, "PRODUCT"),
            ("MODEL" in up, "TOOL"), ("MODE" in up, "MODE"), (any(w in up for w in "MILESTONE ROADMAP CONTRACT API MEMORY FIXTURE THREAD WORK".split()), "WORK_ITEM"),
            (any(w in up for w in "OFFICE ROOM GARDEN KITCHEN".split()), "ROOM"), (up.endswith("CORE"), "ORGANIZATION"), (("-" in up or "_" in up) and " " not in up, "PROJECT"),
        ):
            if ok:
                return found
        return "TOPIC"

    def meet(self, name, kind):
        name = entity(name)
        if not name:
            return None
        if kind == "PERSON":
            name = self.known.get(name, name)
        self.types.setdefault(name, kind)
        if kind == "PERSON":
            self.known.setdefault(name.split()[0], name)
        return name

    def relate(self, a, a_kind, verb, b, b_kind, at):
        a = self.meet(a, a_kind)
        b = a and self.meet(b, b_kind)
        if not b or a == b:
            return
        (rule, (_, heads, tails)), = [(k, v) for k, v in RULES.items() if verb in v[0]]
        if self.types[a] in heads and self.types[b] in tails:
            self.found.setdefault((a, rule, b), set()).add(at)

    def line(self, raw, at):
        line = fact(raw)
        if not line:
            return
        if raw.lstrip().startswith("#"):
            self.subject = entity(raw.lstrip("#")) or self.subject
            return
        if m := re.match(r"(From|To|Cc):\s*(.+)$", line):
            people = [n for n in (entity(fact(x)) for x in re.findall(r"([^,<]+?)\s*<[^>]+>", m[2])) if n]
            for p in people:
                self.meet(p, "PERSON")
            if m[1] == "From":
                self.sender = people[0] if people else None
            elif self.sender:
                for p in people:
                    self.relate(self.sender, "PERSON", "COMMUNICATES_WITH", p, "PERSON", at)
            return
        document = self.primary or self.title
        for f in FIELDS:
            if line.startswith(f + ":"):
                v = line[len(f) + 1 :]
                if f == "Subject":
                    self.primary = "LODEPROJECT" if "Lodeproject" in v else self.primary
                elif f == "Date" and self.sender:
                    self.relate(self.sender, "PERSON", "HAS_DEADLINE", fact(v), "DATE", at)
                elif f == "Project name" and entity(v):
                    self.primary = self.meet(v, "PROJECT")
                elif f == "Subproject":
                    self.meet(v, "PROJECT")
                elif f == "Owner":
                    self.relate(v, "PERSON", "OWNS", self.subject or document, "WORK_ITEM", at)
                elif f == "Name" and entity(v):
                    self.subject = self.meet(v, "WORK_ITEM") and entity(v)
                elif f == "Due date":
                    self.relate(self.subject or self.primary or "DOCUMENT", "WORK_ITEM", "HAS_DEADLINE", fact(v), "DATE", at)
                elif f == "Target milestone":
                    self.relate(document, "PROJECT", "HAS_DEADLINE", fact(v), "DATE", at)
                elif f.startswith("Preferred"):
                    self.relate(document, "PROJECT", "USES", fact(v), "TOOL" if "model" in f else "MODE", at)
                return
        if m := re.match(r"([A-Za-z0-9][A-Za-z0-9 ._\-/]+?)\s+(works_on|depends_on|uses|evaluates|owns|prefers)\s+(.+)$", line):
            self.relate(m[1], self.kind(m[1]), m[2].upper(), m[3], self.kind(m[3]), at)
        elif m := re.match(r"([A-Za-z][A-Za-z ._-]+?) will review (.+)$", line):
            self.relate(m[1], "PERSON", "REVIEWS", m[2], self.kind(m[2]), at)
        elif line.startswith("I prefer ") and self.sender:
            self.relate(self.sender, "PERSON", "PREFERS", fact(line[9:]), self.kind(fact(line[9:])), at)
        elif (m := re.match(r"([A-Za-z][A-Za-z ._-]+?):\s*(.+)$", line)) and (entity(m[1]) in self.known or self.kind(m[1]) == "PERSON"):
            self.relate(m[1], "PERSON", "OWNS", m[2], self.kind(m[2]), at)
        elif "JSON-RPC" in entity(line):
            self.relate(document, "PROJECT", "USES", "JSON-RPC", "PRODUCT", at)
        elif "USER_ID" in entity(line) and "AVOID" in entity(line):
            self.relate(document, "PROJECT", "AVOIDS", "user_id", "TOPIC", at)


def test_random_documents_equal_a_plain_loop(spark):
    rng = random.Random(7)
    people, things = ["Ann", "Ann Lee", "Bob Stone", "Bob", "Cy Young", "cy", "Dee"], ["Roadmap", "Atlas-1", "Memory API", "JSON-RPC", "2026-01-02", "Big Core", "Ann", "Cy Young thread", "a@b", "note: x", "light Mode", ""]
    who, what = lambda: rng.choice(people), lambda: rng.choice(things)
    shapes = [
        lambda: f"From: {who()} <x@y>", lambda: f"To: {who()} <x>, {who()} <y>,<z>", lambda: f"Cc: {who()}", lambda: f"# {what()}", lambda: f"  ## {what()}", lambda: f"Owner: {who()}", lambda: f"- Name: {what()}",
        lambda: "Due date: 2026-03-04", lambda: f"Target milestone: {what()}", lambda: f"Project name: {what()}", lambda: f"Subproject: {what()}", lambda: "Subject: Lodeproject", lambda: f"Date: {what()}",
        lambda: f"{what()} uses {what()}", lambda: f"{who()} owns {what()}", lambda: f"{who()} works_on {what()}", lambda: f"{who()} prefers {what()}", lambda: f"{who()} evaluates {what()}", lambda: f"{who()} will review {what()}",
        lambda: f"I prefer {what()}", lambda: f"{who()}: {what()}", lambda: f"{who()}: {who()} {what()}", lambda: f"{who()}: JSON-RPC it is", lambda: "avoid the user_id", lambda: f"{FIELDS[8]}: {what()}", lambda: "", lambda: "plain words",
    ]
    docs = [(d, rng.choice(["Lodeproject x", "Some title", ""]), "\n".join(rng.choice(shapes)() for _ in range(rng.randint(0, 14)))) for d in range(300)]
    want, types = {}, {}
    for d, title, text in docs:
        loop = Loop(title)
        loop.primary = "LODEPROJECT" if "Lodeproject" in title else None
        for at, raw in enumerate(text.split("\n")):
            loop.line(raw, at)
        longer = {}
        for a, kind in loop.types.items():
            fits = [b for b, other in loop.types.items() if other == kind and (b.startswith(a + " ") or b.endswith(" " + a))]
            if fits:
                longer[a] = min(fits, key=lambda b: (-len(b.encode()), b))

        def last(name, longer=longer):
            while name in longer:
                name = longer[name]
            return name

        types |= {(d, last(a)): kind for a, kind in loop.types.items()}
        for (a, rule, b), places in loop.found.items():
            if last(a) != last(b):
                want.setdefault((d, last(a), rule, last(b)), set()).update(places)
    entities, found, _ = extract(spark.createDataFrame(docs, SCHEMA), NAMES)
    assert {(r.doc, r.name): r.type for r in entities.collect()} == types
    assert {(r.doc, r.subject, r.predicate, r.object): r.evidence for r in found.collect()} == {k: len(v) for k, v in want.items()}


def test_lines_are_read_once_for_their_steps(spark):
    """lines were read four times, and names made anew for every column that asked for them."""
    from lodestack.operators import extraction as X

    lines = X._statements(X._stateful(X.lines_of(spark.createDataFrame([(1, "t", MAIL)], SCHEMA)), NAMES), NAMES)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(X._steps(lines)).count("posexplode") == 1
    assert plan(X.lines_of(spark.createDataFrame([(1, "t", MAIL)], SCHEMA))).count("^[:;,.]+|[:;,.]+$") <= 2


def test_tidy_names_equal_those_made_step_by_step(spark):
    """What needs no change is looked at once; ends, blanks and signs of every kind still go."""
    from pyspark.sql import functions as F

    from lodestack.functions import names as N

    rng = random.Random(3)
    texts = ["", " ", "-", "Order-5", "a  b", "a\tb", "--a:", ".a b.", "a ", "a. ", " a", "(x)", "a \n", "- - a", ":;x;:", '"q"', "ß b"] + ["".join(rng.choice(" -:;,.ab\t\n\"'()  \u0085") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    t = F.col("t")
    name = F.upper(flat(F.regexp_replace(bare(t), r"""^[-:;,."'()]+|[-:;,."'()]+$""", "")))
    fact = flat(F.regexp_replace(bare(F.regexp_replace(bare(t), "^-+", "")), "^[:;,.]+|[:;,.]+$", ""))
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", N.entity_name(t), name, N.fact(t), fact).collect()
    assert all(r[1] == r[2] and r[3] == r[4] for r in rows)


def test_facts_without_needed_names_work_out_no_steps(spark, monkeypatch):
    """entities and relations of all documents were worked out to find first names that no line asked for."""
    from lodestack.operators import extraction as X

    docs = spark.createDataFrame([(1, "t", "From: Customer#5 <c@x>\n- Due date: 2026-01-02\nI prefer O delivery.")], SCHEMA)
    monkeypatch.setattr(X, "_steps", None)
    (told,) = X.facts_of(docs).collect()
    assert (told.tags, told.preferences, told.primary) == (["deadline", "preference"], ["CUSTOMER#5 prefers O delivery"], None)


def test_names_that_stand_for_themselves_are_not_joined(spark):
    """every first name of every document was kept and joined three times, whether anything asked for it or not."""
    from lodestack.operators import extraction as X

    def known(text):
        docs = X._texts(spark.createDataFrame([(1, "t", text)], SCHEMA))
        return {(r.word, r.full) for r in X._first_names(X._staged_steps(docs, X._lines(docs, NAMES), NAMES, True)).collect()}

    assert known("From: Customer#5 <c@x>\nTo: Supplier#1 <s@x>\nOrder-1 depends_on Part-2") == set()
    assert known("From: Atlas <a@x>\nAtlas depends_on Part-2") == {("ATLAS", "ATLAS")}
    assert known("Owner: Ann Lee\nOwner: Bob") == {("ANN", "ANN LEE")}


def test_relations_are_shuffled_once_for_their_types(spark):
    """statements were joined with all entities, once for the subject and once for the object."""
    docs = spark.createDataFrame([(1, "Plan", MAIL)], SCHEMA)
    plan = extract(docs, NAMES)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter, (doc") <= 2 and plan.count("Join Inner") == 0


def test_statements_hold_odd_signs(spark):
    """Parts of a line are cut at a noncharacter; one that a text holds stays where it is."""
    docs = spark.createDataFrame([(1, "t", "Atlas-1 uses Big﷐Core\u0085\nAtlas-1  owns\tMemory uses API")], SCHEMA)
    assert relations(extract(docs)[1]) == {(1, "ATLAS-1", "USES", "BIG﷐CORE")}
    names = {r.name for r in extract(docs)[0].collect()}
    assert names == {"ATLAS-1", "BIG﷐CORE", "MEMORY USES API"}
