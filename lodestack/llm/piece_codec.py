"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where no piece can reach across (before white space and around characters of no longer piece), and the
distinct units of a batch are concatenated. The batch's suffixes are sorted; a binary search of every piece gives the range
of all its occurrences; these are edges, sorted by the place where they end. They are relaxed from left to right: an
edge extends a prefix if its piece may follow the prefix's last piece, that is if merging the two pieces' characters
gives just these two again. For byte-pair merges that leaves one way for each prefix, the one of the model itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE = 400_000  # units that are remembered between batches
BATCH_CHARS = 200_000  # characters of units that are indexed at once; at ten times as many a worker took 160 MB more and no less time
DOCS = 1_000
GAP = 0x110000  # stands between units; no character has this code


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = set(self.byte_ids)
        plain = [i for i in range(size) if i not in special and not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i)]
        self.score = {self.pieces[i]: (sp.get_score(i), i) for i in plain}
        self.base = size  # of characters without a piece
        if any(re.search(f"(?s)[^{SPACE}]{SPACE}|[\n\t].|\r[^\r]|.[\n\t]", self.pieces[i]) for i in plain):
            raise ValueError("a piece reaches across white space")
        self.unit = re.compile(f"[\n\t]|{SPACE}*[^{SPACE}\n\r\t]*\r+|{SPACE}*[^{SPACE}\n\r\t]+|{SPACE}+")
        usable = [i for i in plain if len(self.pieces[i]) == 1 or self.merge(self.pieces[i]) == [i]]
        letters = sorted({c for i in usable for c in self.pieces[i]})
        self.letters = np.array([ord(c) for c in letters], np.int64)  # codes of letters are their ranks from 1 on
        self.width = max(len(self.pieces[i]) for i in usable)
        self.ids = np.array(usable, np.int64)
        self.sizes = np.ones(size, np.int64)
        codes = np.zeros((len(usable), self.width), ">u2")
        above = np.full((len(usable), self.width), 0xFFFF, ">u2")
        for k, i in enumerate(usable):
            row = 1 + np.searchsorted(self.letters, [ord(c) for c in self.pieces[i]])
            codes[k, : len(row)] = above[k, : len(row)] = row
            self.sizes[i] = len(row)
        self.low, self.high = (x.view(f"S{2 * self.width}").ravel() for x in (codes, above))
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.known: dict[str, bytes] = {}

    def merge(self, text: str) -> list[int]:
        """Ids by merging, again and again, the leftmost best-scored neighbours that make a piece; for short strings."""
        parts = list(text)
        while True:
            best = max(((s[0], -k) for k in range(len(parts) - 1) if (s := self.score.get(parts[k] + parts[k + 1]))), default=None)
            if best is None:
                return [self.score[p][1] if p in self.score else self.base + ord(p) for p in parts]
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def may_follow(self, pairs: np.ndarray) -> np.ndarray:
        """For pairs coded as first << 32 | second, whether the merged characters of both give both again."""
        at = np.searchsorted(self.pairs, pairs)
        new = np.unique(pairs[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != pairs)] if len(self.pairs) else pairs)
        if len(new):
            text = lambda i: self.pieces[i] if i < self.base else chr(i - self.base)
            fits = [self.merge(text(p >> 32) + text(p & 0xFFFFFFFF)) == [p >> 32, p & 0xFFFFFFFF] for p in new.tolist()]
            every = np.concatenate([self.pairs, new])
            order = np.argsort(every, kind="stable")
            self.pairs, self.fits = every[order], np.concatenate([self.fits, fits])[order]
            at = np.searchsorted(self.pairs, pairs)
        return self.fits[at]

    def edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece id) of every occurrence of every piece; points: code points, GAP between units."""
        rank = np.searchsorted(self.letters, points)
        hit = self.letters[np.minimum(rank, len(self.letters) - 1)] == points
        codes = np.concatenate([np.where(hit, rank + 1, np.where(points == GAP, 0, 0xFFFE)), np.zeros(self.width, np.int64)]).astype(">u2")
        suffixes = np.lib.stride_tricks.sliding_window_view(codes, self.width)[: len(points)].copy().view(f"S{2 * self.width}").ravel()
        order = np.argsort(suffixes)
        ordered = suffixes[order]
        first, last = np.searchsorted(ordered, self.low), np.searchsorted(ordered, self.high, "right")
        count = last - first
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        places = order[np.repeat(first, count) + within]
        odd = np.flatnonzero(~hit & (points != GAP))
        return np.concatenate([places, odd]), np.concatenate([np.repeat(self.ids, count), self.base + points[odd]])

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, as little-endian unsigned 16-bit integers."""
        sizes = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        points[starts + sizes] = GAP
        owner = np.repeat(np.arange(len(units)), sizes + 1)
        place, piece = self.edges(points)
        length = np.where(piece < self.base, self.sizes[np.minimum(piece, self.base - 1)], 1)
        end = place + length
        step = end - starts[owner[place]]  # where the edge ends in its unit
        order = np.argsort(step, kind="stable")
        place, piece, end = place[order], piece[order], end[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=int(sizes.max(initial=0)) + 1))])
        last = np.full(len(points) + 1, -1, np.int64)  # the last piece of the prefix that ends here
        last[starts] = -2
        for k in range(1, len(bounds) - 1):
            a, b = bounds[k], bounds[k + 1]
            before = last[place[a:b]]
            ok = before == -2
            ask = np.flatnonzero(before >= 0)
            ok[ask] = self.may_follow(before[ask] << 32 | piece[a:b][ask])
            last[end[a:b][ok]] = piece[a:b][ok]
        at, live, found = starts + sizes, np.arange(len(units)), []
        while len(live := live[at[live] > starts[live]]):
            got = last[at[live]]
            found.append((live, got))
            at[live] -= np.where(got < self.base, self.sizes[np.clip(got, 0, self.base - 1)], 1)
        if not found:
            return [b""] * len(units)
        who, ids = np.concatenate([f[0] for f in found])[::-1], np.concatenate([f[1] for f in found])[::-1]
        order = np.argsort(who, kind="stable")
        who, ids = who[order], ids[order]
        counts = np.bincount(who, minlength=len(units))
        if (ids >= self.base).any():
            raw = [[i] if i < self.base else [self.byte_ids[b] for b in chr(i - self.base).encode("utf-8", "surrogatepass")] for i in ids.tolist()]
            spread = np.array([len(r) for r in raw])
            counts = np.bincount(who, spread, len(units)).astype(np.int64)
            ids = np.array([i for r in raw for i in r])
        data, ends = ids.astype("<u2").tobytes(), 2 * np.cumsum(counts)
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list({u for us in cut for u in us if u not in self.known})
        if len(self.known) + len(new) > CACHE:
            self.known = {u: self.known[u] for us in cut for u in us if u in self.known}  # the common ones are in every batch
        at = 0
        while at < len(new):
            held, to = 0, at
            while to < len(new) and (held == 0 or held + len(new[to]) < BATCH_CHARS):
                held += len(new[to]) + 1
                to += 1
            self.known.update(zip(new[at:to], self.encode_units(new[at:to]), strict=True))
            at = to
        return [b"".join(map(self.known.__getitem__, us)) for us in cut]

    @property
    def raw(self) -> list[bytes]:
        """Bytes of each id's text; control pieces have none."""
        if not hasattr(self, "_raw"):
            plain = {i for _, i in self.score.values()}
            self._raw = [p.replace(SPACE, " ").encode() if i in plain else b"" for i, p in enumerate(self.pieces)]
            for b, i in enumerate(self.byte_ids):
                self._raw[i] = bytes([b])
        return self._raw

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u2").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One for each Python worker."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip[, ids]) of every row; ids are the model's own, of whole texts.

    Null and empty texts have no ids. round_trip tells whether the decoded ids give the text again (null: the empty text); it is
    false for a text that holds the model's own sign for a blank. ids_crc32 is taken of unsigned 32-bit integers. Rows
    are independent of each other; an empty table gives an empty result.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = model(path)
        for x in batches:
            for i in range(0, len(x), DOCS):
                part = x.iloc[i : i + DOCS]
                texts = list(part["text"])
                found = pieces.encode(texts)
                wide = [np.frombuffer(b, "<u2").astype("<u4") for b in found]
                out = {"doc_id": part["doc_id"].astype("Int64"), "n_tokens": [len(w) for w in wide], "ids_crc32": [zlib.crc32(w.tobytes()) for w in wide], "round_trip": [pieces.decode(b) == (t or "") for b, t in zip(found, texts, strict=True)]}
                yield pd.DataFrame(out | {"ids": [w.astype(np.int32) for w in wide]} if with_ids else out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean"
    return rows.mapInPandas(each, f"{schema}, ids array<int>" if with_ids else schema).withColumnRenamed("doc_id", id_col)
