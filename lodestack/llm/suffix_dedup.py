"""Suffix-array dedup: exact removal of long repeated byte strings by a distributed, common-prefix-aware merge sort.

A string of `match` bytes holds an anchor: a place whose `gram` bytes hash lowest in some window of that length. Equal
strings hold equal anchors at equal offsets, so only suffixes that begin at anchors are sorted, and of these only those
whose gram occurs twice in the corpus. Tasks sort their suffixes, up to `match` bytes, and exchange the runs front-coded,
dealt by gram. A loser tree merges the runs of a part; it never compares a known common prefix again and leaves the
suffix array with its common-prefix lengths. Those, and the same of the reversed bytes before each anchor, tell for
every offset which windows are equal. The suffixes of a gram that occurs more often than one merge could take are dealt on
by whole windows, spread over all tasks: the limit bounds a task's memory and loses nothing. Only hashes, runs and answers travel; an
answer goes back to the flush (a bounded bunch of texts) that asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import discard, staged, text_key

MATCH = 200
GRAM = 40
PIECE = 1 << 20  # bytes of a text that are hashed at once
FLUSH = 1_000_000  # anchors whose grams are asked for at once
GRAM_ROWS = 2_000_000  # hashes of grams that one task compares
RUN_ROWS = 60_000  # suffixes that are sorted at once
PART_ROWS = 40_000  # suffixes that one merge gets on average
HOT_GRAM = 200_000  # a gram that occurs more often is counted by windows: as many suffixes fit a task (200 MB)
PACK, UNPACK = zstandard.compress, zstandard.decompress  # texts and runs travel packed
#: How repeated a gram is.
ONCE, REPEATED, HOT = 0, 1, 2
GRAMS = "flush long, n long, keys binary, counts binary, gaps binary, h binary"
RUN = "part int, flush long, known binary, rest binary, sizes binary, left binary, left_sizes binary, times binary, ctx binary"
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, np.uint64, endpoint=False)


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every width values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def anchors(data: bytes, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of their grams): all places that hash lowest among those of some window of match bytes."""
    places, hashes = [], []
    for at in range(0, max(0, len(data) - match + 1), PIECE):
        h = _TABLE[np.frombuffer(data, np.uint8, min(len(data) - at, PIECE + 2 * match), at)]
        size = 1
        while size < gram:
            step = min(size, gram - size)
            h = h[:-step] * np.uint64((0x9E3779B97F4A7C15 * (2 * size + 1)) % 2**64) + h[step:]
            h ^= h >> np.uint64(29)
            size += step
        width = match - gram + 1
        low = _sliding(h, width, np.minimum)
        if len(low) == 0:
            continue
        edge = np.zeros(width - 1, np.uint64)
        here = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), width, np.maximum)[: len(h)] == h)
        places.append(here + at)
        hashes.append(h[here])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first].view(np.int64)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which known bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """(common-prefix length with the one before, all remainders in a row, their lengths) of sorted strings."""
    known = [0, *(common(a, b) for a, b in zip(strings, strings[1:], strict=False))][: len(strings)]
    rest = [s[k:] for s, k in zip(strings, known, strict=True)]
    return known, b"".join(rest), [len(x) for x in rest]


class LoserTree:
    """Merges front-coded sorted runs. Each loser keeps its common-prefix length with the string that beat it."""

    def __init__(self, runs: list[tuple[list[int], bytes, list[int]]]):
        self.runs, self.size = runs, 1 << max(0, len(runs) - 1).bit_length()
        self.at, self.offset = [0] * self.size, [0] * self.size
        self.now: list[bytes | None] = [self._next(r, b"")[0] for r in range(self.size)]
        self.known = [0] * self.size
        self.loser = [0] * self.size
        self.best = self._play(1)

    def _next(self, r: int, before: bytes) -> tuple[bytes | None, int]:
        if r >= len(self.runs) or self.at[r] >= len(self.runs[r][0]):
            return None, 0
        known, rest, sizes = self.runs[r]
        k, o, n = known[self.at[r]], self.offset[r], sizes[self.at[r]]
        self.at[r] += 1
        self.offset[r] = o + n
        return before[:k] + rest[o : o + n], k

    def _duel(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); both know their common prefix with the same string, which is not above either."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.known[a] != self.known[b]:
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        n = common(x, y, self.known[a])
        wins, loses = (a, b) if x[n:] <= y[n:] else (b, a)
        self.known[loses] = n
        return wins, loses

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        wins, self.loser[node] = self._duel(self._play(2 * node), self._play(2 * node + 1))
        return wins

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, number in the run, common-prefix length with the string before) in sorted order."""
        while (s := self.now[r := self.best]) is not None:
            yield r, self.at[r] - 1, self.known[r]
            self.now[r], self.known[r] = self._next(r, s)
            node = (r + self.size) // 2
            while node:
                r, self.loser[node] = self._duel(r, self.loser[node])
                node //= 2
            self.best = r


def repeated_offsets(known: np.ndarray, right: np.ndarray, lefts: list[bytes], times: np.ndarray, match: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) offset t of each suffix for which the match bytes from t before it occur elsewhere; most is -1 where none does.

    Suffixes are in sorted order, known with their common prefixes; right: their lengths; lefts: reversed bytes before them.
    """
    n = len(known)
    order = sorted(range(n), key=lefts.__getitem__)
    left_known = np.array([0, *(common(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False))][:n])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    left = np.array([len(x) for x in lefts], np.int64)
    least, most = np.full(n, match), np.full(n, -1)
    for t in range(match - gram + 1):
        fits = np.flatnonzero((left >= t) & (right >= match - t))
        if not len(fits):
            continue
        block, same = np.cumsum(known < match - t), np.cumsum(left_known < t)[rank]
        _, group, size = np.unique(block[fits] * (n + 1) + same[fits], return_inverse=True, return_counts=True)
        found = fits[(np.bincount(group, times[fits], len(size)) > 1)[group]]
        least[found] = np.minimum(least[found], t)
        most[found] = t
    return least, most


def _flush_id(seq: int) -> int:
    """Unique to a flush of this task; only ever read from a written table."""
    return TaskContext.get().partitionId() << 32 | seq


def _find(match: int, gram: int):
    """Anchors of texts, gathered from as many texts as hold FLUSH of them."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[bytes] = []
        places: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        held = seq = 0

        def flush() -> pd.DataFrame:
            counts = np.array([len(p) for p in places], "<i4")
            gaps = np.concatenate([np.diff(p, prepend=0) for p in places]).astype("<i4")
            return pd.DataFrame({"flush": [_flush_id(seq)], "n": [held], "keys": [b"".join(keys)], "counts": [PACK(counts.tobytes())], "gaps": [PACK(gaps.tobytes())], "h": [np.concatenate(hashes).astype("<u8").tobytes()]})

        for x in batches:
            for key, text in zip(x["key"], x["text"], strict=True):
                p, h = anchors(text.encode("utf-8", "surrogatepass"), match, gram)
                keys.append(key)
                places.append(p)
                hashes.append(h.view(np.uint64))
                held += len(p)
                if held >= FLUSH:
                    yield flush()
                    keys, places, hashes, held, seq = [], [], [], 0, seq + 1
        if held:
            yield flush()

    return find


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_part(h: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, distinct hashes, how often each occurs, which one each of the part's anchors has; its anchors): parts in order."""
    part = _part_of(h, parts)
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(own):
            some, which, times = np.unique(h[own], return_inverse=True, return_counts=True)
            yield int(part[own[0]]), some, times, (which, own)


def _deal(parts: int):
    """Each flush sends every part the distinct hashes that fall to it, so a common gram costs one hash a flush."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for flush, h in zip(x["flush"], x["h"], strict=True):
                yield pd.DataFrame([{"part": p, "flush": flush, "h": some.tobytes(), "times": PACK(times.astype("<i4").tobytes())} for p, some, times, _ in _by_part(np.frombuffer(h, "<u8"), parts)])

    return deal


def _mark(hot_gram: int):
    """ONCE, REPEATED or HOT for each hash of each flush."""

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        hs = [np.frombuffer(h, "<u8") for h in pdf["h"]]
        times = np.concatenate([np.frombuffer(UNPACK(t), "<i4") for t in pdf["times"]]).astype(np.int64)
        _, which = np.unique(np.concatenate(hs), return_inverse=True)
        n = np.bincount(which, times)[which]
        marks = np.where(n > hot_gram, HOT, np.where(n > 1, REPEATED, ONCE)).astype(np.uint8)
        ends = np.cumsum([len(h) for h in hs])[:-1]
        return pd.DataFrame({"flush": pdf["flush"], "part": pdf["part"], "marks": [PACK(m.tobytes()) for m in np.split(marks, ends)]})

    return mark


def _gather(parts: int):
    """Per text the places of its repeated grams, hot ones told by the lowest bit."""

    def gather(key: tuple, flushed: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        out = []
        told = {int(p): np.frombuffer(UNPACK(m), np.uint8) for p, m in zip(marked["part"], marked["marks"], strict=True)}
        for x in flushed.itertuples():
            h, counts, gaps = np.frombuffer(x.h, "<u8"), np.frombuffer(UNPACK(x.counts), "<i4"), np.frombuffer(UNPACK(x.gaps), "<i4").astype(np.int64)
            mark = np.zeros(len(h), np.uint8)
            for p, _, _, (which, own) in _by_part(h, parts):
                mark[own] = told[p][which]
            ends = np.cumsum(counts)
            for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                some = np.flatnonzero(m := mark[a:b])
                if len(some):
                    pos = np.cumsum(gaps[a:b])[some]
                    out.append((x.keys[16 * i : 16 * i + 16], len(some), PACK((2 * pos + (m[some] == HOT)).astype("<i8").tobytes())))
        return pd.DataFrame(out, columns=["key", "n_places", "places"])

    return gather


def _blocks(flush: int, contexts: dict[tuple[bytes, bytes], list[int]], parts: int, gram: int) -> Iterator[dict]:
    """One front-coded sorted run for each part; contexts: (right, left reversed) -> [number in the flush, times]."""
    by: dict[int, list] = {}
    for (right, left), (ctx, times) in contexts.items():
        by.setdefault(xxhash.xxh64_intdigest(right[:gram], 1) % parts, []).append((right, left, times, ctx))
    for part, rows in by.items():
        rows.sort()
        known, rest, sizes = front_code([x[0] for x in rows])
        lefts = [x[1] for x in rows]
        ints = lambda values, kind: PACK(np.array(values, kind).tobytes())
        yield {
            "kind": 1, "part": part, "flush": flush, "known": ints(known, "<i2"), "rest": PACK(rest), "sizes": ints(sizes, "<i2"), "left": PACK(b"".join(lefts)),
            "left_sizes": ints([len(x) for x in lefts], "<i2"), "times": ints([x[2] for x in rows], "<i8"), "ctx": ints([x[3] for x in rows], "<i4"),
        }


def _merge(match: int, gram: int):
    """Merges the runs of a part, and tells every flush which of its contexts hold repeated strings, and at which offsets."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ints = lambda x, kind: np.frombuffer(UNPACK(x), kind)
        runs = [(ints(x.known, "<i2").tolist(), UNPACK(x.rest), ints(x.sizes, "<i2").tolist()) for x in pdf.itertuples()]
        sizes = np.array([len(r[0]) for r in runs])
        first = np.cumsum(sizes) - sizes
        merged = np.array(list(LoserTree(runs)), np.int64).reshape(-1, 3)
        place = first[merged[:, 0]] + merged[:, 1]
        lefts = []
        for x in pdf.itertuples():
            ends = np.cumsum(ints(x.left_sizes, "<i2"), dtype=np.int64)
            left = UNPACK(x.left)
            lefts += [left[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        right = np.concatenate([np.add(k, s) for k, _, s in runs])[place]
        times = np.concatenate([ints(x, "<i8") for x in pdf["times"]])[place]
        least, most = repeated_offsets(merged[:, 2], right, [lefts[i] for i in place], times, match, gram)
        back = np.empty_like(place)
        back[place] = np.arange(len(place))
        out = []
        for flush, ctx, a, n in zip(pdf["flush"], pdf["ctx"], first.tolist(), sizes.tolist(), strict=True):
            own = back[a : a + n]
            hit = np.flatnonzero(most[own] >= 0)
            if len(hit):
                out.append((flush, *(PACK(v.astype("<i4").tobytes()) for v in (ints(ctx, "<i4")[hit], least[own][hit], most[own][hit]))))
        return pd.DataFrame(out, columns=["flush", "ctx", "least", "most"])

    return merge


def _cut(match: int, gram: int, parts: int):
    """Rows of kind 0: which context each place of a flush's texts has; 1: runs; 2: contexts of hot grams."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = 0
        contexts: tuple[dict, dict] = {}, {}
        keys: list[bytes] = []
        counts: list[int] = []
        at: list[int] = []
        ctx: list[int] = []

        def flush() -> Iterator[pd.DataFrame]:
            me = _flush_id(seq)
            yield pd.DataFrame([{"kind": 0, "flush": me, "keys": b"".join(keys), "counts": PACK(np.array(counts, "<i4").tobytes()), "at": PACK(np.array(at, "<i8").tobytes()), "ctx": PACK(np.array(ctx, "<i4").tobytes())}])
            rows = list(_blocks(me, contexts[REPEATED - 1], parts, gram))
            rows += [{"kind": 2, "flush": me, "hot_ctx": i, "hot_left": left, "hot_right": right, "hot_times": n} for (right, left), (i, n) in contexts[HOT - 1].items()]
            for i in range(0, len(rows), 1_000):
                yield pd.DataFrame(rows[i : i + 1_000])

        for x in batches:
            for key, n, packed, places in x[["key", "n", "packed", "places"]].itertuples(index=False):
                data, where = UNPACK(packed), np.frombuffer(UNPACK(places), "<i8").tolist()
                for i in range(0, len(where), RUN_ROWS):
                    for place in where[i : i + RUN_ROWS]:
                        pos = place >> 1
                        context = data[pos : pos + match], data[max(0, pos - match + gram) : pos][::-1]
                        known = contexts[place & 1].setdefault(context, [len(contexts[0]) + len(contexts[1]), 0])
                        known[1] += n
                        at.append(pos)
                        ctx.append(known[0])
                    keys.append(key)
                    counts.append(len(where[i : i + RUN_ROWS]))
                    if len(contexts[0]) + len(contexts[1]) >= RUN_ROWS:
                        yield from flush()
                        contexts, keys, counts, at, ctx, seq = ({}, {}), [], [], [], [], seq + 1
        if keys:
            yield from flush()

    schema = f"kind int, {RUN}, keys binary, counts binary, at binary, hot_ctx int, hot_left binary, hot_right binary, hot_times long"
    names = [x.split()[0] for x in schema.split(", ")]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in cut(batches):
            yield x.reindex(columns=names).astype(object).where(x.reindex(columns=names).notna().to_numpy(), None)

    return whole, schema


def _windows(match: int, gram: int):
    """(flush, ctx, t, w, n): every window of a hot gram's contexts by its hash."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for i in range(0, len(x), 50):
                out = []
                for flush, ctx, left, right, n in x.iloc[i : i + 50].itertuples(index=False):
                    text, k = left[::-1] + right, len(left)
                    out += [(flush, ctx, t, xxhash.xxh3_128_digest(text[k - t : k - t + match]), n) for t in range(match - gram + 1) if t <= k and len(right) >= match - t]
                yield pd.DataFrame(out, columns=["flush", "ctx", "t", "w", "n"])

    return windows


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield pd.DataFrame({"flush": x["flush"], **{k: [PACK(np.array([v], "<i4").tobytes()) for v in x[k]] for k in ("ctx", "least", "most")}})


def _spans(match: int):
    """The merged spans of each text of a flush."""

    def spans(key: tuple, flushed: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(flushed) or not len(found):
            return pd.DataFrame({"key": [], "spans": []})
        ints = lambda x, kind="<i4": np.frombuffer(UNPACK(x), kind)
        x = flushed.iloc[0]
        ctx, at, counts = ints(x["ctx"]), ints(x["at"], "<i8"), ints(x["counts"])
        least, most = np.zeros(ctx.max() + 1, np.int64), np.full(ctx.max() + 1, -1)
        for c, lo, hi in zip(found["ctx"], found["least"], found["most"], strict=True):
            least[ints(c)], most[ints(c)] = ints(lo), ints(hi)
        out, end = [], np.cumsum(counts)
        for i, (a, b) in enumerate(zip((end - counts).tolist(), end.tolist(), strict=True)):
            hit = most[ctx[a:b]] >= 0
            if hit.any():
                own, pos = ctx[a:b][hit], at[a:b][hit]
                lo, hi = pos - most[own], pos + match - least[own]
                out.append((x["keys"][16 * i : 16 * i + 16], _union(lo, hi).tobytes()))
        return pd.DataFrame(out, columns=["key", "spans"])

    return spans


def _union(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(lo, hi) rows of the union of spans, in order; touching spans are one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return np.stack([lo[new], hi[np.concatenate([new[1:], [True]])]], 1).astype("<i8")


def _texts(docs: DataFrame) -> DataFrame:
    """(key, n, packed) of each distinct text; docs: key, text. Copies are one row, and packed before they are shuffled."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"key": x["key"], "packed": [PACK(t.encode("utf-8", "surrogatepass")) for t in x["text"]]})

    return docs.mapInPandas(pack, "key binary, packed binary").groupBy("key").agg(F.count("*").alias("n"), F.first("packed").alias("packed"))


def _without(data: bytes, spans: list[bytes]) -> tuple[bytes, int]:
    """(what is left of data, number of spans)."""
    pairs = np.concatenate([np.frombuffer(s, "<i8").reshape(-1, 2) for s in spans])
    pairs = _union(pairs[:, 0], pairs[:, 1])
    edges = [0, *pairs.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(pairs)


def repeated_spans(docs: DataFrame, match: int = MATCH, gram: int = GRAM, hot_gram: int = HOT_GRAM) -> DataFrame:
    """(key, spans array of binaries) of texts with repeated bytes; docs: key (16 bytes, of the text), text not null, a row each.

    Texts go through one shuffle, as distinct ones. Else hashes of grams, contexts in runs, and answers travel; an answer goes
    back to the flush that asked, so no key that many rows share is ever joined on.
    """
    grams = staged(docs.mapInPandas(_find(match, gram), GRAMS), "grams")
    parts = int((grams.agg(F.sum("n")).first()[0] or 0) // GRAM_ROWS) + 1
    marks = grams.select("flush", "h").mapInPandas(_deal(parts), "part int, flush long, h binary, times binary").groupBy("part").applyInPandas(_mark(hot_gram), "flush long, part int, marks binary")
    told = grams.groupBy("flush").cogroup(marks.groupBy("flush")).applyInPandas(_gather(parts), "key binary, n_places long, places binary")
    places = staged(told.groupBy("key").agg(F.first("n_places").alias("n_places"), F.first("places").alias("places")), "places")
    discard(grams)
    parts = int((places.agg(F.sum("n_places")).first()[0] or 0) // PART_ROWS) + 1
    cut, schema = _cut(match, gram, parts)
    runs = staged(_texts(docs).join(places.select("key", "places"), "key").mapInPandas(cut, schema), "runs")
    discard(places)
    offsets = "flush long, ctx binary, least binary, most binary"
    merged = runs.where("kind = 1").select(*[x.split()[0] for x in RUN.split(", ")]).groupBy("part").applyInPandas(_merge(match, gram), offsets)
    hot = runs.where("kind = 2").select("flush", "hot_ctx", "hot_left", "hot_right", "hot_times").mapInPandas(_windows(match, gram), "flush long, ctx int, t int, w binary, n long")
    often = hot.groupBy("t", "w").agg(F.sum("n").alias("n")).where("n > 1").select("t", "w")
    hot_offsets = hot.join(often, ["t", "w"]).groupBy("flush", "ctx").agg(F.min("t").alias("least"), F.max("t").alias("most")).mapInPandas(_packed, offsets)
    asked = runs.where("kind = 0").select("flush", "keys", "counts", "at", "ctx")
    spans = asked.groupBy("flush").cogroup(merged.unionAll(hot_offsets).groupBy("flush")).applyInPandas(_spans(match), "key binary, spans binary")
    spans = staged(spans.groupBy("key").agg(F.collect_list("spans").alias("spans")), "spans")
    discard(runs)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, gram: int = GRAM, hot_gram: int = HOT_GRAM) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes; removes each byte covered by a match-byte string that also starts elsewhere.

    Texts are UTF-8 bytes, null ones empty; matches never cross texts, and are judged on the input. Repeated rows, of one id
    or of none, are documents of their own, so they are copies of each other. Texts shorter than match stay. kept_bytes is
    null where nothing goes, and may break inside a character where a match does. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", text_key(F.col("text")))
    long = keyed.where(F.octet_length("text") >= match).select("key", "text")
    spans = repeated_spans(long, match, gram, hot_gram)

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for key, packed, spans in x[["key", "packed", "spans"]].itertuples(index=False):
                data = UNPACK(packed)
                left, n = _without(data, spans)
                out.append((key, len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            yield pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "sha", "kept_bytes"])

    made = _texts(long).join(spans, "key").select("key", "packed", "spans").mapInPandas(drop, "key binary, n_removed long, n_spans long, sha string, kept_bytes binary")
    every = keyed.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("own"))
    none = F.lit(0).cast("long")
    return every.join(made, "key", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("sha", F.lower(F.hex("own"))).alias("kept_sha256"), "kept_bytes",
    )


def cut_texts(docs: DataFrame, text_col: str = "text", match: int = MATCH, gram: int = GRAM, hot_gram: int = HOT_GRAM) -> DataFrame:
    """docs with the repeated bytes cut out of the texts, as by remove_repeats; a row whose text is all repeats goes.

    Characters that a cut breaks go too. All other rows and columns stay as they are, with null and repeated ids, null and
    empty texts; each row is judged by its own text.
    """

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else PACK(t.encode("utf-8", "surrogatepass")))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else UNPACK(t).decode() if s is None else _without(UNPACK(t), s)[0].decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)], dtype=object)

    text = F.col(text_col).cast("string")
    keyed = docs.select("*", text_key(text).alias("lodestack_key"))
    spans = repeated_spans(keyed.where(F.octet_length(text) >= match).select(F.col("lodestack_key").alias("key"), text.alias("text")), match, gram, hot_gram)
    moved = keyed.withColumn(text_col, packed(text)).join(spans.select(F.col("key").alias("lodestack_key"), F.col("spans").alias("lodestack_spans")), "lodestack_key", "left")
    made = moved.withColumn(text_col, cut(text_col, "lodestack_spans"))
    return made.where(f"lodestack_spans is null or {text_col} <> ''").select(docs.columns)
