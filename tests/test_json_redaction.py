"""Redaction inside JSON, against a walk of the parsed values."""

import json
import random
import re

from lodestack.operators.json_redaction import MARK, sanitized

SECRET = "AKIA" + "A1B2C3D4E5F6G7H8"


def walk(value, depth, most):
    if depth >= most:
        return MARK
    if isinstance(value, dict):
        name = lambda k: re.sub("[^a-z0-9]", "", re.sub("[^A-Za-z0-9]", "", k).lower())
        hides = lambda n: n == "authorization" or n.endswith(("token", "apikey", "key")) or "password" in n or "secret" in n
        return {k: MARK if hides(name(k)) else walk(v, depth + 1, most) for k, v in value.items()}
    if isinstance(value, list):
        return [walk(v, depth + 1, most) for v in value]
    return "CHANGED" if isinstance(value, str) and SECRET in value else value


def test_random_values_equal_a_walk(spark):
    rng = random.Random(3)
    strings = ["", "a", 'q"uo\\te', "\\", "{[,:]}", "line\nbreak", "ünï €", f"id {SECRET} end", "x: y"]
    keys = ["a", "API-Key", "api_key", "token", "Refresh Token", "my password!", "monkeys", "key", "", 'q"', "authorization", "authorizations", "secretary", "b\\", "é"]

    def made(depth):
        kind = rng.random()
        if depth < 5 and kind < 0.35:
            return {k: made(depth + 1) for k in rng.sample(keys, rng.randint(0, 4))}
        if depth < 5 and kind < 0.6:
            return [made(depth + 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([*strings, 1, -2.5e10, True, None, 10**15])

    values = [made(0) for _ in range(200)]
    rows = spark.createDataFrame([(i, json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values)], "id int, body string")
    for most in (128, 3):
        got = {r.id: json.loads(r.body) for r in sanitized(rows, "id", "body", most).collect()}
        changed = lambda v: {k: changed(x) for k, x in v.items()} if isinstance(v, dict) else [changed(x) for x in v] if isinstance(v, list) else "CHANGED" if isinstance(v, str) and v.startswith("id [REDACTED") else v
        assert {i: changed(v) for i, v in got.items()} == {i: walk(v, 0, most) for i, v in enumerate(values)}


def test_depth_counts_and_malformed(spark):
    rows = spark.createDataFrame([(1, "[" * 200 + "7" + "]" * 200), (2, '{"a": '), (3, None), (4, '{"token": {"x": [1, {"y": 2}]}, "b": "' + SECRET + '", "c": 1.50}'), (5, '"plain"'), (6, "")], "id int, body string")
    got = {r.id: tuple(r)[1:] for r in sanitized(rows, "id", "body").collect()}
    assert got[1] == ("[" * 128 + f'"{MARK}"' + "]" * 128, 0, 0, 1)
    assert got[2] == got[3] == got[6] == (None, None, None, None)
    assert got[4][1:] == (1, 1, 0) and got[4][0].startswith('{"token":"' + MARK + '","b":"[REDACTED') and got[4][0].endswith(',"c":1.50}')
    assert got[5] == ('"plain"', 0, 0, 0)
    assert sanitized(rows.where("false"), "id", "body").count() == 0


def test_nothing_is_shuffled(spark):
    """A token a row made 38 rows of an order, which were dealt out by key and sorted."""
    rows = spark.createDataFrame([(None, '{"a": [1, {"token": [2]}], "b": "x"}'), (1, "{"), (1, None)], "k long, t string")
    made = sanitized(rows, "k", "t")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in made.collect()] == [('{"a":[1,{"token":"[REDACTED_SECRET]"}],"b":"x"}', 1, 0, 0), (None,) * 4, (None,) * 4]
