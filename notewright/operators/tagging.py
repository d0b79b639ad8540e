"""Tokens, labels and flags of whole records, many records at once, without a shuffle.

A record comes as one row with its text and its spans; tokens are found in the bytes of a block of texts, spans are
placed among them by binary search, so the work is that of the tokens and of the tokens that spans cover.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, but for one longer text, and tokens of spans that are laid out at once.
BLOCK, LAID = 2_000_000, 2_000_000


def compact(spans: Column | str, kinds: dict[str, tuple[str, ...]], asserted: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> Column:
    """`spans` as numbers: start, end, the place of each field of `kinds` among its values (-1 unknown, -2 null), and
    the flags as bits, -1 for types without."""
    known = lambda c, values: F.coalesce(F.array_position(F.array(*map(F.lit, values)), c).cast("int") - 1, F.lit(-2))

    def bits(s: Column) -> Column:
        held = [F.coalesce(F.array_contains(s["assertions"], a), F.lit(False)).cast("int") * (1 << i) for i, a in enumerate(flags)]
        return F.when(s["fine"].isin(*asserted), sum(held, F.lit(0))).otherwise(F.lit(-1))

    fields = lambda s: [s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), *(known(s[c], v).alias(c) for c, v in kinds.items()), *([bits(s).alias("bits")] if flags else [])]
    full = F.filter(spans, lambda s: s.isNotNull() & F.coalesce(s["start"] < s["end"], F.lit(False)))
    out = F.transform(full, lambda s: F.struct(*fields(s)))
    names = ["start", "end", *kinds, *(["bits"] if flags else [])]
    return F.coalesce(out, F.array().cast(f"array<struct<{','.join(f'`{n}`:int' for n in names)}>>"))


class Tokens:
    """The runs of characters other than white space of some texts: `offsets` by text, `row`, `start` and `end` by
    token; of each text the first `limit`."""

    def __init__(self, texts: pa.Array, limit: int | None = None):
        col = texts.cast(pa.large_binary())
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        full = ~(((data >= 9) & (data <= 13)) | (data == 32))
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        begins, ends = full.copy(), full.copy()
        begins[1:] &= ~full[:-1] | edge[1:-1]
        ends[:-1] &= ~full[1:] | edge[1:-1]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        self.base, self.length = chars[at[:-1]], np.diff(chars[at])
        self.row = np.searchsorted(at, b, "right") - 1
        self.offsets = np.searchsorted(self.row, np.arange(len(col) + 1))
        if limit is not None:
            kept = np.arange(len(b)) - self.offsets[self.row] < limit
            b, e, self.row = b[kept], e[kept], self.row[kept]
            self.offsets = np.searchsorted(self.row, np.arange(len(col) + 1))
        self._start, self._end = chars[b], chars[e]
        self.start, self.end = self._start - self.base[self.row], self._end - self.base[self.row]

    def ranges(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of spans the first token that they overlap and the one after the last, as places in the block."""
        own = [self.offsets[row], self.offsets[row + 1]]
        low, high = (self.base[row] + np.clip(x, 0, self.length[row]) for x in (start, end))
        return np.clip(np.searchsorted(self._end, low, "right"), *own), np.clip(np.searchsorted(self._start, high, "left"), *own)


def _laid(first: np.ndarray, stop: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(span, token) of all tokens of the chosen spans, in bounded runs."""
    chosen = chosen[first[chosen] < stop[chosen]]
    n = stop[chosen] - first[chosen]
    ends, done = np.cumsum(n), 0
    while done < len(chosen):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + LAID, "right")))
        lens = n[done:upto]
        span = np.repeat(chosen[done:upto], lens)
        yield span, first[span] + np.arange(len(span)) - np.repeat(np.cumsum(lens) - lens, lens)
        done = upto


def _labels(tokens: Tokens, first: np.ndarray, stop: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Numbers of the BIO labels: 0 for O and unknown kinds, 2k + 1 for B and 2k + 2 for I of kind k; the last span wins."""
    won = np.full(len(tokens.row), -1)
    for span, at in _laid(first, stop, np.flatnonzero(kind > -2)):
        np.maximum.at(won, at, span)
    at = np.flatnonzero(won >= 0)
    k = kind[won[at]]
    out = np.zeros(len(won), np.int32)
    out[at] = np.where(k < 0, 0, 2 * k + 1 + (first[won[at]] != at))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            yield b.slice(at, upto - at)
            at = upto


def _fields(col: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows and fields of an array of structs of numbers."""
    offsets, flat = col.offsets.to_numpy(), col.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(flat.type)}
    return np.repeat(np.arange(len(col)), np.diff(offsets)), fields


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def label_lists(df: DataFrame, key: str, text: str, spans: Column | str, kind: str, values: tuple[str, ...]) -> DataFrame:
    """(key, text, labels): one row a record, the numbers of its tokens' labels by one field of its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            t = Tokens(b.column(1))
            row, s = _fields(b.column(2))
            labels = _labels(t, *t.ranges(row, s["start"], s["end"]), s[kind])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(t.offsets, pa.array(labels, pa.int32()))], names=[key, text, "labels"])

    d = df.select(key, F.coalesce(text, F.lit("")).alias(text), compact(spans, {kind: values}).alias("s"))
    return d.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{text}` string, labels array<int>")


def training_rows(df: DataFrame, key: str, text: str, spans: Column | str, kinds: dict[str, tuple[str, ...]], asserted: tuple[str, ...], flags: tuple[str, ...], limit: int, ignored: int, lists: bool) -> DataFrame:
    """Tokens of each record with labels by each of `kinds`, flags and mask, between two special tokens at (0, 0). As
    lists: (key, starts, ends, *kinds, flags, mask), one row a record; else (key, no, start, end, *kinds, flags,
    mask), one row a token. Records without a key have the special tokens only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            t = Tokens(b.column(1), limit)
            row, s = _fields(b.column(2))
            first, stop = t.ranges(row, s["start"], s["end"])
            offsets = t.offsets + 2 * np.arange(len(t.offsets))
            at = np.arange(len(t.row)) + 2 * t.row + 1

            def placed(values: np.ndarray, special: int = 0) -> np.ndarray:
                out = np.full((offsets[-1], *values.shape[1:]), special, np.int32)  # noqa: B023
                out[at] = values  # noqa: B023
                return out

            hot, mask = np.zeros((len(t.row), len(flags)), np.int32), np.zeros(len(t.row), np.int32)
            for span, token in _laid(first, stop, np.flatnonzero(s["bits"] >= 0)):
                mask[token] = 1
                for i in range(len(flags)):
                    hot[token[(s["bits"][span] >> i) & 1 > 0], i] = 1
            labels = [pa.array(placed(_labels(t, first, stop, s[k]), ignored)) for k in kinds]
            start, end, mask = (pa.array(placed(x)) for x in (t.start, t.end, mask))
            hot = placed(hot)
            if lists:
                each = _lists(len(flags) * np.arange(offsets[-1] + 1), pa.array(hot.reshape(-1)))
                cols, names = [b.column(0), *(_lists(offsets, x) for x in (start, end, *labels, each, mask))], [key, "starts", "ends", *kinds, "flags", "mask"]
            else:
                owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                no = pa.array((np.arange(offsets[-1]) - offsets[owner]).astype(np.int32))
                cols = [b.column(0).take(pa.array(owner)), no, start, end, *labels, *(pa.array(np.ascontiguousarray(hot[:, i])) for i in range(len(flags))), mask]
                names = [key, "no", "start", "end", *kinds, *(f"f{i}" for i in range(len(flags))), "mask"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    d = df.select(key, F.when(F.col(key).isNotNull(), F.coalesce(text, F.lit(""))).otherwise(F.lit("")).alias("t"), compact(spans, kinds, asserted, flags).alias("s"))
    head = f"`{key}` {df.schema[key].dataType.simpleString()}"
    if lists:
        return d.mapInArrow(run, ", ".join([head, *(f"`{c}` array<int>" for c in ("starts", "ends", *kinds)), "flags array<array<int>>, mask array<int>"]))
    hot = [f"f{i}" for i in range(len(flags))]
    out = d.mapInArrow(run, ", ".join([head, *(f"`{c}` int" for c in ("no", "start", "end", *kinds, *hot, "mask"))]))
    return out.select(key, "no", "start", "end", *kinds, F.array(*hot).alias("flags"), "mask")


def runs(df: DataFrame, lens: str, tags: str, *keep: str) -> DataFrame:
    """(*keep, runs): of sentences the spans (start, end, label) of their tags, an array each, on the words of the given
    lengths joined by blanks; an I without its span opens one too."""
    fields = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, tag = b.column(len(keep)), b.column(len(keep) + 1)
            offsets = size.offsets.to_numpy() - size.offsets[0].as_py()
            n = size.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = tag.flatten().dictionary_encode()
            known = [x or "" for x in code.dictionary.to_pylist()] + [""]
            bio = [bool(re.match(r"[BI]-.+$", x)) for x in known]
            names = sorted({x[2:] for x, ok in zip(known, bio, strict=True) if ok})
            place = {x: i for i, x in enumerate(names)}
            code = code.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)
            mark = np.array([" BI".index(x[0]) if ok else 0 for x, ok in zip(known, bio, strict=True)])[code]
            kind = np.array([place[x[2:]] if ok else -1 for x, ok in zip(known, bio, strict=True)])[code]
            opens = np.zeros(len(n) + 1, bool)
            opens[offsets] = True
            same = np.zeros(len(n), bool)
            same[1:] = (kind[1:] == kind[:-1]) & (mark[:-1] > 0) & ~opens[1:-1]
            fresh = (mark == 1) | ((mark == 2) & ~same)
            breaks = np.append(np.flatnonzero(fresh | (mark == 0)), len(n))
            first = np.flatnonzero(fresh)
            last = breaks[np.searchsorted(breaks, first) + 1] - 1
            before = np.concatenate([[0], np.cumsum(n + 1)])
            row = np.searchsorted(offsets, first, "right") - 1
            base = before[offsets[row]]
            values = pa.StructArray.from_arrays([pa.array((before[first] - base).astype(np.int32)), pa.array((before[last] + n[last] - base).astype(np.int32)), pa.array([names[k] for k in kind[first]], pa.string())], fields=list(fields))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), _lists(np.searchsorted(row, np.arange(b.num_rows + 1)), values)], names=[*keep, "runs"])

    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "runs array<struct<start:int,end:int,label:string>>"])
    return df.select(*keep, lens, tags).mapInArrow(run, ddl)
