"""Line diffs: applied patches give the new text, with as few edits as a table of common subsequences says."""

import random
import re

from lodestack.operators.text_diff import NO_END, edits, patch, patches


def applied(old, hunks):
    lines, out, at = re.findall(r"[^\n]*\n|[^\n]+", old), [], 0
    for hunk in re.split(r"(?m)^(?=@@ )", hunks)[1:]:
        first, count = map(int, re.match(r"@@ -(\d+),(\d+)", hunk).groups())
        first -= count > 0
        out += lines[at:first]
        at = first
        for x in re.findall(r"[^\n]*\n", hunk.replace(NO_END, "\0\n"))[1:]:
            x = x.replace("\0\n", "")
            if x[0] in " -":
                assert lines[at] == x[1:]
                at += 1
            out += [x[1:]] * (x[0] in " +")
    return "".join(out + lines[at:])


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        made = [0]
        for j, y in enumerate(b):
            made.append(row[j] + 1 if x == y else max(made[j], row[j + 1]))
        row = made
    return row[-1]


def test_random_pairs():
    rng = random.Random(5)
    for _ in range(400):
        a, b = (rng.choices("abcd", k=rng.randint(0, 25)) for _ in range(2))
        found = edits(a, b)
        assert sum(j - i + n - m for i, j, m, n in found) == len(a) + len(b) - 2 * common(a, b)
        ends = [rng.choice(["", "\n"]) for _ in range(2)]
        old, new = ("\n".join(t) + e for t, e in zip((a, b), ends, strict=True))
        for most in (1000, 3):
            assert applied(old, patch(old, new, most)) == new


def test_many_edits_are_one_block():
    old, new = ("\n".join(f"{p}{k}" for k in range(30_000)) for p in "xy")
    assert applied(old, patch(old, new)) == new


def test_patches(spark):
    long = "z" * 3000
    old = spark.createDataFrame([(1, "line one\nline two\n"), (2, "same"), (3, None), (4, "gone"), (None, "a")], "item int, text string")
    new = spark.createDataFrame([(1, "line one\nline TWO changed\n"), (2, "same"), (3, long), (5, "added"), (None, "b")], "item int, text string")
    got = {r.item: r.patch for r in patches(old, new, "item", "text").collect()}
    assert got == {1: "@@ -1,2 +1,2 @@\n line one\n-line two\n+line TWO changed\n", 3: ("@@ -0,0 +1,1 @@\n+" + long)[:2000]}
    assert patches(old.where("false"), new, "item", "text").count() == 0
