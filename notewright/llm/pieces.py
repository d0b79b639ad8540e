"""Problem 5: splitting oversized texts at natural boundaries.

Each position of a text gets a boundary strength. A sparse table of range maxima over these strengths answers,
in constant time, which cut is strongest in the window of permissible piece lengths; ties go to the right.
The next piece steps back from the cut by the overlap, to the strongest boundary in the far half of the
overlap window. A text of n code points costs O(n log window).

Defined results: null, empty and short texts give no pieces; a text without any boundary is cut at the limit;
records delivered twice (same key, text and spans) count once; null spans and spans outside the text are
left out; a span that no piece holds whole is given to each piece it touches, clipped, with `whole` false.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strengths, strongest first: heading, blank line, sentence end, line end, clause end, blank, none.
HEADING, BLANK_LINE, SENTENCE, LINE, CLAUSE, BLANK, NONE = 7, 6, 5, 4, 3, 2, 0
#: Added outside spans, so a cut inside a span loses against any cut outside all.
OUTSIDE = 8

_GAP = re.compile(r"\s+")
_HEADING = re.compile(r"(?:#{1,6} |\d{1,2}(?:\.\d{1,2})*[.)] ?|[IVX]{1,4}\. )?\S.{0,58}")
_MARKED = re.compile(r"(?:#{1,6} |\d{1,2}(?:\.\d{1,2})*[.)] ?\w|[IVX]{1,4}\. )")
_CLOSERS = "\"'”’»)]}」』"
_WIDE_END = re.compile(r"[。！？।॥។៕]+[”’」』»\"]*(?!\s)")


def _is_heading(line: str) -> bool:
    line = line.strip()
    if not line or not _HEADING.fullmatch(line) or line[-1] in ".,;?!":
        return False
    return line[-1] == ":" or bool(_MARKED.match(line)) or (line.isupper() and len(line) > 3)


def strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of a cut before each position 0..n; a cut stands after the blanks, before the next word."""
    n = len(text)
    s = np.zeros(n + 1, np.int32)
    for m in _GAP.finditer(text):
        a, b = m.span()
        if a == 0:
            continue
        gap = m.group()
        breaks = gap.count("\n")
        if breaks:
            end = text.find("\n", b)
            line = text[b : n if end < 0 else end] if b < n else ""
            if line and len(line) <= 80 and _is_heading(line):
                s[b] = HEADING
                continue
            if breaks > 1:
                s[b] = BLANK_LINE
                continue
        k = a - 1
        while k > 0 and text[k] in _CLOSERS:
            k -= 1
        last = text[k]
        if last in ".!?…。！？।॥។៕":
            s[b] = SENTENCE
        elif breaks:
            s[b] = LINE
        elif last in ",;:，；：、":
            s[b] = CLAUSE
        else:
            s[b] = BLANK
    for m in _WIDE_END.finditer(text):
        s[m.end()] = max(s[m.end()], SENTENCE)
    for m in re.finditer(r"[，；、：](?!\s)", text):
        s[m.end()] = max(s[m.end()], CLAUSE)
    inside = np.zeros(n + 2, np.int32)
    for a, b in spans:
        if b - a > 1:
            inside[a + 1] += 1
            inside[b] -= 1
    return s + np.where(np.cumsum(inside)[: n + 1] > 0, 0, OUTSIDE).astype(np.int32)


class RangeMax:
    """Sparse table over strengths, made for one stretch of the text at a time, so that its size does not grow with
    the text; queries are at most `widest` wide and may move back by as much. `best` gives the strongest position of [lo, hi], ties to the right or left."""

    def __init__(self, strength: np.ndarray, widest: int, stretch: int = 1 << 16):
        self.strength, self.widest, self.stretch = strength, widest, max(stretch, 4 * widest)
        self._read(0)

    def _read(self, base: int) -> None:
        part = self.strength[base : base + self.stretch]
        self.base, self.n = base, len(part)
        pos = np.arange(self.n, dtype=np.int64)
        s = part.astype(np.int64) * self.n
        self.right = self._table(s + pos, self.widest)
        self.left = self._table(s + (self.n - 1 - pos), self.widest)

    @staticmethod
    def _table(key: np.ndarray, widest: int) -> list[np.ndarray]:
        table = [key]
        w = 1
        while 2 * w <= min(widest, len(key)):
            t = table[-1]
            table.append(np.maximum(t[:-w], t[w:]))
            w *= 2
        return table

    def best(self, lo: int, hi: int, rightward: bool = True) -> int:
        if lo < self.base or hi >= self.base + self.n:
            self._read(max(0, lo - 2 * self.widest))
        lo, hi = lo - self.base, hi - self.base
        table = self.right if rightward else self.left
        level = (hi - lo + 1).bit_length() - 1
        row = table[level]
        at = int(max(row[lo], row[hi - (1 << level) + 1]) % self.n)
        return self.base + (at if rightward else self.n - 1 - at)


def cuts(text: str, spans: list[tuple[int, int]], limit: int = 1000, overlap: int = 100, least: int | None = None) -> list[tuple[int, int]]:
    """Pieces as (start, end) of a text, each at most `limit` long; `least` is the shortest piece aimed at."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    least = max(overlap + 1, limit // 2) if least is None else max(least, overlap + 1)
    strength = strengths(text, spans)
    index = RangeMax(strength, limit)
    out, start = [], 0
    while n - start > limit:
        end = index.best(start + least, start + limit)
        out.append((start, end))
        if overlap:
            back = index.best(end - overlap, end - max(1, overlap // 2), rightward=False)
            if strength[back] % OUTSIDE == NONE and strength[end - overlap] == strength[back]:
                back = end - overlap
            start = back
        else:
            start = end
    out.append((start, n))
    return out


_SPAN = pa.struct([("span_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("whole", pa.bool_())])
_OUT = pa.schema([("rec_id", pa.int64()), ("piece_no", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32()), ("shared", pa.int32()), ("piece", pa.string()), ("spans", pa.list_(_SPAN))])
_DDL = "rec_id bigint, piece_no int, start_at int, end_at int, shared int, piece string, spans array<struct<span_no:int,start:int,end:int,whole:boolean>>"


def _place(pieces: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[list[dict]]:
    """The spans of each piece, offsets relative to the piece. Pieces and spans are sorted by start."""
    starts = np.array([a for a, _ in pieces])
    ends = np.array([b for _, b in pieces])
    out: list[list[dict]] = [[] for _ in pieces]
    for no, a, b in sorted(spans, key=lambda x: x[1:]):
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, max(b, a + 1), "left"))
        touching = range(lo, hi)
        whole = [k for k in touching if pieces[k][0] <= a and b <= pieces[k][1]]
        for k in whole or touching:
            s, e = pieces[k]
            out[k].append({"span_no": no, "start": max(a, s) - s, "end": min(b, e) - s, "whole": bool(whole)})
    return out


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = len(text)
                kept = [(i, s["start"], s["end"]) for i, s in enumerate(spans or []) if s and s["start"] is not None and s["end"] is not None and 0 <= s["start"] < s["end"] <= n]
                pieces = cuts(text, [(a, e) for _, a, e in kept], limit, overlap)
                placed = _place(pieces, kept)
                for k, (a, e) in enumerate(pieces):
                    rows.append((key, k, a, e, pieces[k - 1][1] - a if k else 0, text[a:e], placed[k]))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _OUT]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    return run


def split_texts(df: DataFrame, key: str = "rec_id", text: str = "text", spans: str = "spans", limit: int = 1000, overlap: int = 100) -> DataFrame:
    """(rec_id, piece_no, start_at, end_at, shared, piece, spans) of each text of more than `limit` code points."""
    slim = F.transform(F.col(spans), lambda s: F.when(s.isNotNull(), F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    long = df.where(F.length(text) > limit).select(F.col(key).alias("rec_id"), F.col(text).alias("text"), slim.alias("spans"))
    return long.dropDuplicates().mapInArrow(_split(limit, overlap), _DDL)
