"""Session logs: broken lines, blanks, two dialects."""

import json

import pytest

from lodestack.sources.transcripts import read_lines, turns

LONG = "x" * 300


def message(kind, content, **more):
    return json.dumps({"type": kind, "message": {"content": content}} | more)


def test_message_dialect_from_files(spark, tmp_path):
    lines = [
        '{"type": "user", "message": {"content": "cut off',
        message("user", "no, not yet", timestamp="2026-01-02T03:04:05Z"),
        "",
        message("assistant", [{"type": "thinking", "text": "hm"}, {"type": "text", "text": f" {LONG}"}, {"type": "text", "text": "b"}], cwd="/w", sessionId="s1"),
        message("user", [{"type": "text", "text": "fine"}, {"type": "tool_result", "text": "t"}]),
        message("user", [{"type": "text", "text": "Wait <system-reminder>r</system-reminder>here"}, {"type": "image"}, {"type": "text", "text": "now"}]),
        message("user", "side", isSidechain=True), message("user", "meta", isMeta=True), message("user", 7), message("user", "<bash-input>ls"), message("user", "<system-reminder>only</system-reminder>"),
        message("user", "go on", cwd="/other"), message("assistant", "  "), "  [1, 2]  ", "not json", message("user", "it is not what I meant"), "null",
    ]
    text = "\n".join(lines) + "\r\n"
    (tmp_path / "a.jsonl").write_text(text)
    said, logs = turns(read_lines(spark, f"file://{tmp_path}"))
    assert [(r.tier, r.excerpt) for r in said.orderBy("place").collect()] == [
        (1, "user (interrupt): no, not yet"), (1, f'user (interrupting agent that said "{"x" * 200}"): Wait here\nnow'), (2, "user: go on"), (1, f'user (interrupting agent that said "{"x" * 200}"): it is not what I meant'),
    ]
    (log,) = logs.collect()
    assert (log.scope, log.session, log.bytes, log.broken) == ("/w", "s1", len(text.encode()) - 1, 2)


def test_payload_dialect(spark):
    item = lambda role, *blocks, kind="message": json.dumps({"type": "response_item", "payload": {"type": kind, "role": role, "content": [{"type": t, "text": x} for t, x in blocks]}})
    lines = [
        json.dumps({"type": "session_meta", "payload": {"cwd": "/w", "id": "s"}}), item("assistant", ("output_text", "done"), ("other", "no")), item("user", ("input_text", "undo that")), item("user", ("input_text", "<permissions>")),
        item("developer", ("text", "x")), item("user", ("text", "a"), ("input_text", "b")), item("user", ("text", "call"), kind="function_call"), json.dumps({"type": "event", "payload": 3}), None,
    ]
    rows = spark.createDataFrame([(p, k, x) for p in ("p", "q") for k, x in enumerate(lines)] + [("blank", 0, " ")], "path string, place int, line string")
    said, logs = turns(rows, "payload")
    assert [(r.path, r.excerpt) for r in said.orderBy("path", "place").collect()] == [(p, x) for p in ("p", "q") for x in ('user (interrupting agent that said "done"): undo that', "user: a\nb")]
    assert {(r.path, r.scope, r.session, r.broken) for r in logs.collect()} == {("p", "/w", "s", 1), ("q", "/w", "s", 1), ("blank", None, None, 0)}
    assert [x.count() for x in turns(rows.where("false"), "payload")] == [0, 0]
    with pytest.raises(ValueError):
        turns(rows, "third")
