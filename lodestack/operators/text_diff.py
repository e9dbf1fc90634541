"""Line diffs of modified items, as patches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unchanged lines around a change, characters of a patch that are kept.
CONTEXT, MOST_CHARS = 3, 2000
MOST_EDITS = 1_000  # beyond so many edits what is left of a pair is one replaced block
NO_END = "\n\\ No newline at end of file\n"


def edits(old: list[str], new: list[str], most: int = MOST_EDITS) -> list[tuple[int, int, int, int]]:
    """(old from, old to, new from, new to) of the changed blocks, fewest edits up to most of them: furthest reaching paths, diagonal by diagonal."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    furthest, trail = {1: 0}, []
    for d in range(min(len(a) + len(b), most) + 1):
        trail.append(dict(furthest))
        for k in range(-d, d + 1, 2):
            x = furthest[k + 1] if k == -d or (k != d and furthest[k - 1] < furthest[k + 1]) else furthest[k - 1] + 1
            while x < len(a) and 0 <= x - k < len(b) and a[x] == b[x - k]:
                x += 1
            furthest[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    else:
        return [(head, len(old) - tail, head, len(new) - tail)]
    x, y, steps = len(a), len(b), []
    for d in range(len(trail) - 1, 0, -1):
        k, v = x - y, trail[d]
        above = k == -d or (k != d and v[k - 1] < v[k + 1])
        before = v[k + 1] if above else v[k - 1]
        x, y = before, before - (k + 1 if above else k - 1)
        steps.append((x, x + (not above), y, y + above))
    blocks: list[tuple[int, int, int, int]] = []
    for i, j, m, n in reversed(steps):
        if blocks and blocks[-1][1] == i and blocks[-1][3] == m:
            blocks[-1] = (blocks[-1][0], j, blocks[-1][2], n)
        else:
            blocks.append((i, j, m, n))
    return [(head + i, head + j, head + m, head + n) for i, j, m, n in blocks]


def patch(old: str, new: str, most_edits: int = MOST_EDITS) -> str:
    """Hunks of a unified diff, without names of files; empty for equal texts."""
    a, b = (t.split("\n") for t in (old, new))
    a, b = ([x + "\n" for x in t[:-1]] + [t[-1]] * bool(t[-1]) for t in (a, b))
    hunks: list[list[tuple[int, int, int, int]]] = []
    for e in edits(a, b, most_edits):
        if hunks and e[0] - hunks[-1][-1][1] <= 2 * CONTEXT:
            hunks[-1].append(e)
        else:
            hunks.append([e])
    out = []
    for hunk in hunks:
        before = min(CONTEXT, hunk[0][0])
        after = min(CONTEXT, len(a) - hunk[-1][1])
        i, m, j, n = hunk[0][0] - before, hunk[0][2] - before, hunk[-1][1] + after, hunk[-1][3] + after
        out.append(f"@@ -{i + (j > i)},{j - i} +{m + (n > m)},{n - m} @@\n")
        for x0, x1, y0, y1 in [*hunk, (j, j, n, n)]:
            out += [" " + x for x in a[i:x0]] + ["-" + x for x in a[x0:x1]] + ["+" + x for x in b[y0:y1]]
            i = x1
    return "".join(x if x.endswith("\n") else x + NO_END for x in out)


def patches(old: DataFrame, new: DataFrame, key: str, text: str, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """(key, patch) of the items whose text is another in the second snapshot; patches are cut after most_chars characters. Keys are unique, null texts are empty ones; added, removed and equal items have no row.

    Equal texts are left out by the join, so only changed pairs reach Python, an Arrow batch at a time.
    """
    side = lambda df, name: df.select(F.col(key), F.coalesce(text, F.lit("")).alias(name))
    pairs = side(old, "lodestack_old").join(side(new, "lodestack_new"), key).where("lodestack_old <> lodestack_new")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = [patch(o, n)[:most_chars] for o, n in zip(x["lodestack_old"], x["lodestack_new"], strict=True)]
            yield pd.DataFrame({key: x[key], "patch": made})

    return pairs.mapInPandas(each, f"`{key}` {pairs.schema[key].dataType.simpleString()}, patch string")
