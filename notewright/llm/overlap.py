"""Problem 1: records that occur in the training split and in an evaluation split, exactly or almost.

Texts are brought to problem 4's form and cut into words without case, accents and punctuation. Records with
the same bag of words are one class (64-bit sums find the classes, SHA-256 of the sorted words confirms them);
only one member of a class goes on.

1. Routing. Which training records an evaluation record can overlap with at all is decided on bags of words,
   since word order does not count: a record's tokens (repeated words are tokens of their own) are ordered by
   rarity, by counts over all records of both sides, and the rarest 30 % and one are its anchors: two bags of
   Jaccard 0.7 share an anchor, so no pair is lost. Anchors are spread over shards of the token space. In a
   shard, pairs with an anchor in common are dropped by size, by the anchor's place and by a 128-bit parity of
   the tokens: the bits that differ are never more than the tokens that one side lacks. Long bags are cut by hash
   into parts of some 32 to 64 tokens: if the whole bags reach a Jaccard, some part reaches it too.
2. Search. The evaluation records that are left are put, as whole texts in their word order, into compressed
   full-text indexes (BWT in a wavelet matrix), one per block of records, and the training records routed there
   are streamed through backward search. A match is extended to the left until its interval is empty, then the
   next begins; matches that follow each other on both sides are merged to spans.
3. Counts. The spans of a pair give the words of the training record that the evaluation record holds, an
   upper bound of the words in common; pairs that cannot reach the threshold fall out, the others are counted
   exactly on their words.

Backward search alone cannot give the result asked for: a pair whose words are the same in another order has
no long match, and short ones are shared by nearly all records. Hence the routing before it.

No step is all against all: an anchor that is frequent is split over a grid of shards, by evaluation record and
by training record, so a shard's evaluation side and its work are bounded; training rows are streamed.

Defined results: null and blank texts are no cases; `split` is compared without case and blanks, train against
dev and test; rows delivered twice count once, each text where they differ; copies give every pair that the definition asks for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, remove, shared_dir
from .fmindex import FMIndex
from .match import fold

THRESHOLD = 0.7
SKETCH_BITS = 20
#: Bags of fewer tokens are not cut into parts.
WHOLE = 80
#: Evaluation anchors of one token beyond which it is split, and pairs beyond which training rows are too.
HOT, WORK = 50_000, 2_000_000_000


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order. They route; what comes out is verified on the words."""
    return F.transform(words(text), lambda w: F.hash(w))


# --- vectorised helpers over lists of words -----------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def _tokens(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the bags; the k-th occurrence of a word becomes a token of its own, so that sets of
    tokens count repetitions."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((words, row))
    r, w = row[order], words[order].astype(np.int64)
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    return r, (w << 24) + (np.arange(len(r)) - first)


def _level(n: np.ndarray) -> np.ndarray:
    """Log2 of the number of parts that a bag of n tokens is cut into."""
    return np.where(n < WHOLE, 0, np.log2(np.maximum(n, 32) / 32).astype(np.int64))



def _parts(w: np.ndarray, offsets: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(group, token, row) of every token of every part, and (level, size, parity 1, parity 2) by group. A pair is
    compared at the level of the smaller record, so a record takes part at each level that a smaller partner can
    have."""
    n = np.diff(offsets)
    row, token = _tokens(w, offsets)
    h = _mix(token)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    top = _level(n)
    low = _level(np.ceil(threshold * n - 1e-9).astype(np.int64))
    entries, groups, total = [], [], 0
    for level in range(int(low.min()) if len(n) else 0, int(top.max()) + 1 if len(n) else 0):
        mine = ((low <= level) & (level <= top))[row]
        r, t = row[mine], h[mine]
        if not len(r):
            continue
        part = (t >> np.uint64(32)) >> np.uint64(32 - level)
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        start = np.flatnonzero(new)
        bit = np.uint64(1) << (t & np.uint64(63))
        upper = (t & np.uint64(64)) > 0
        parity = [np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), start) for x in (~upper, upper)]
        entries.append((np.cumsum(new) - 1 + total, t, r))
        groups.append((np.full(len(start), level), np.diff(np.append(start, len(r))), *parity))
        total += len(start)
    if not entries:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)), tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*entries, strict=True)), tuple(np.concatenate(x) for x in zip(*groups, strict=True))


def _least_common(total: np.ndarray, threshold: float) -> np.ndarray:
    """The least number of tokens in common of two bags with `total` tokens together."""
    return np.ceil(threshold / (1 + threshold) * total - 1e-9).astype(np.int64)


def anchors_of(size: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """How many of a bag's rarest tokens are anchors: a bag that reaches the threshold holds one of them."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _slot(token: np.ndarray) -> np.ndarray:
    return (token & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


_SPLIT = 64


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << SKETCH_BITS), np.int64)
    for b in batches:
        w, offsets = _flat(b.column(0))
        row, token = _tokens(w, offsets)
        train = b.column(1).to_numpy(zero_copy_only=False)[row]
        slot = _slot(_mix(token))
        for side, mine in enumerate((train, ~train)):
            total[side] += np.bincount(slot[mine], minlength=total.shape[1])
    salt = pa.array(np.full(2 * _SPLIT, TaskContext.get().partitionId() % 64, np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * _SPLIT, dtype=np.int32)), salt, pa.array([x.tobytes() for x in np.split(total.reshape(-1), 2 * _SPLIT)])], names=["part", "salt", "counts"])


def _sum_parts(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("counts"))
    return pa.table({"part": t.column("part")[:1], "salt": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def token_sketch(table: DataFrame) -> np.ndarray:
    """Counts of all tokens in 2^20 slots, of train and of the others. A task counts its rows in one array; arrays
    are added in two rounds, part by part, so no task gets more than a share. What reaches the driver is 16 MB,
    whatever the corpus."""
    ddl = "part int, salt int, counts binary"
    counted = table.select("w", "train").mapInArrow(_sketch, ddl).groupBy("part", "salt").applyInArrow(_sum_parts, ddl)
    out = np.zeros((2 * _SPLIT, (1 << SKETCH_BITS) // _SPLIT), np.int64)
    for r in counted.groupBy("part").applyInArrow(_sum_parts, ddl).toLocalIterator():
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return out.reshape(2, -1)


# --- anchors, packed by shard: a blob holds the columns of many anchors --------------------------------------

_COLUMNS = (("key", "u4"), ("rec", "i8"), ("n", "u4"), ("size", "u2"), ("pos", "u2"), ("level", "u1"), ("p0", "u8"), ("p1", "u8"))
_WIDTH = sum(np.dtype(t).itemsize for _, t in _COLUMNS)
_ANCHORS = "shard bigint, side int, m int, data binary"


def _packed(cols: list[np.ndarray]) -> bytes:
    """Columns as bytes, those of the same rank together, compressed."""
    raw = b"".join(np.ascontiguousarray(c.astype(t).view(np.uint8).reshape(len(c), -1).T).tobytes() for c, (_, t) in zip(cols, _COLUMNS, strict=True))
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(m: int, data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=m * _WIDTH, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for _, t in _COLUMNS:
        width = np.dtype(t).itemsize * m
        out.append(np.ascontiguousarray(raw[at : at + width].reshape(-1, m).T).view(t).reshape(-1))
        at += width
    return out


def _anchors(sketch: np.ndarray, threshold: float, shards: int, hot: int, work: int, chunk: int = 500_000):
    def grid(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts that a slot's evaluation and training anchors are split into."""
        t, e = sketch[0][slot], sketch[1][slot]
        of_eval = np.maximum(1, -(-e // hot))
        return of_eval, np.maximum(1, -(-(t * e) // (of_eval * work)))

    def spread(side: int, at: np.ndarray, cols: list[np.ndarray], slot: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, index) of anchors: a heavy token's go to one row or column of its grid."""
        of_eval, of_train = grid(slot[at])
        heavy = of_eval * of_train > 1
        light = at[~heavy]
        out_shard, out_at = [(full[light] % np.uint64(shards)).astype(np.int64)], [light]
        if heavy.any():
            hat, ke, kt = at[heavy], of_eval[heavy], of_train[heavy]
            mine, others = (ke, kt) if side else (kt, ke)
            own = (_mix(cols[1][hat]) % mine.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(hat)), others)
            other = np.arange(len(again)) - np.repeat(np.cumsum(others) - others, others)
            cell = (own[again] * kt[again] + other) if side else (other * kt[again] + own[again])
            out_shard.append(-(slot[hat][again] * 65536 + cell) - 1)
            out_at.append(hat[again])
        return np.concatenate(out_shard), np.concatenate(out_at)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        slot, full, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
        has, cols = rest[:2], rest[2:]
        for side in (0, 1):  # train, evaluation
            shard, at = spread(side, np.flatnonzero(has[side]), cols, slot, full)
            order = np.argsort(shard, kind="stable")
            shard, at = shard[order], at[order]
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a < z:
                    rows.append((int(shard[a]), 1 - side, z - a, _packed([c[at[a:z]] for c in cols])))
        if rows:
            shard, side, m, data = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(side, pa.int32()), pa.array(m, pa.int32()), pa.array(data, pa.binary())], names=["shard", "side", "m", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            rec = b.column("rec_id").to_numpy()
            sides = [b.column("has_train").to_numpy(zero_copy_only=False), b.column("has_eval").to_numpy(zero_copy_only=False)]
            w, offsets = _flat(b.column("w"))
            (group, token, row), (level, size, p0, p1) = _parts(w, offsets, threshold)
            if not len(token):
                continue
            slot = _slot(token)
            order = np.lexsort((token, sketch[0][slot] * sketch[1][slot].astype(float), group))
            g = group[order]
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            pos = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            kept = pos < anchors_of(size, threshold)[g]
            at, g, pos = order[kept], g[kept], pos[kept]
            r = row[at]
            # an anchor that the other side does not hold at all finds nothing
            has = [sides[0][r] & (sketch[1][slot[at]] > 0), sides[1][r] & (sketch[0][slot[at]] > 0)]
            full = _mix(token[at] + level[g].astype(np.uint64))
            key = (full >> np.uint64(32)).astype(np.uint32)
            held.append((slot[at], full, *has, key, rec[r], np.diff(offsets)[r], size[g], pos, level[g], p0[g], p1[g]))
            count += len(at)
            if count >= chunk:
                yield from flush(held)
                held, count = [], 0
        if held:
            yield from flush(held)

    return run


_PAIRS = "t bigint, e bigint"


class _Shard:
    """The evaluation anchors of one shard, by key and size."""

    def __init__(self, cols: list[np.ndarray], threshold: float):
        order = np.lexsort((cols[3], cols[0]))
        self.cols = [c[order] for c in cols]
        self.keys, self.first, self.count = np.unique(self.cols[0], return_index=True, return_counts=True)
        self.threshold = threshold
        most = 2 * (1 << 16)
        total = np.arange(most)
        self.differ = (total - 2 * _least_common(total, threshold)).astype(np.int32)

    def _fits(self, t: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of anchors those that can belong to records over the threshold."""
        (_, trec, tn, ts, tp, tl, *tb), (_, erec, en, es, ep, el, *eb) = ([c[i] for c in cols] for cols, i in ((t, x), (self.cols, y)))
        both = ts.astype(np.int64) + es
        common = _least_common(both, self.threshold)
        smaller, larger = np.minimum(tn, en).astype(np.int64), np.maximum(tn, en)
        fits = np.bitwise_count(tb[0] ^ eb[0]).astype(np.int64) + np.bitwise_count(tb[1] ^ eb[1]) <= both - 2 * common
        fits &= (smaller >= self.threshold * larger - 1e-9) & (tl == el) & (tl == _level(smaller)) & (trec != erec)
        fits &= np.minimum(ts.astype(np.int64) - tp, es.astype(np.int64) - ep) >= common
        return trec[fits], erec[fits]

    def join(self, t: list[np.ndarray], few: int = 4096, block: int = 2_000_000) -> Iterator[pa.RecordBatch]:
        """Candidate pairs of training anchors `t` with the shard's."""
        order = np.lexsort((t[3], t[0]))
        t = [c[order] for c in t]
        keys, first, count = np.unique(t[0], return_index=True, return_counts=True)
        _, a, b = np.intersect1d(keys, self.keys, assume_unique=True, return_indices=True)
        tf, tc, ef, ec = first[a], count[a], self.first[b], self.count[b]
        small = tc * ec <= few
        found = []
        # small groups together: all their pairs in bounded runs
        sf, sc, df, dc = tf[small], tc[small], ef[small], ec[small]
        ends = np.cumsum(sc * dc)
        done = 0
        while done < len(sf):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + block, "right")))
            lens = (sc * dc)[done:upto]
            which = np.repeat(np.arange(done, upto), lens)
            k = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            found.append(self._fits(t, sf[which] + k // dc[which], df[which] + k % dc[which]))
            done = upto
        for i in np.flatnonzero(~small):
            found += self._block(t, tf[i], tc[i], ef[i], ec[i], block)
        trec, erec = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if len(trec):
            once = np.unique(np.stack([trec, erec], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["t", "e"])

    def _block(self, t: list[np.ndarray], tf: int, tc: int, ef: int, ec: int, block: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """One key's pairs as blocks of a matrix: training anchors by size, evaluation anchors of sizes that fit."""
        es = self.cols[3][ef : ef + ec].astype(np.int64)
        e0, e1 = self.cols[6][ef : ef + ec], self.cols[7][ef : ef + ec]
        ts, tp = t[3][tf : tf + tc].astype(np.int64), t[4][tf : tf + tc].astype(np.int64)
        # the largest partner that the tokens from the anchor on can still satisfy
        most = np.minimum(np.floor((ts - tp) * ((1 + self.threshold) / self.threshold) + 1e-6) - ts, np.floor(ts / self.threshold + 1e-6))
        order = np.lexsort((most, ts))
        ts, most, row = ts[order], most[order], order + tf
        t0, t1 = t[6][row], t[7][row]
        step = int(max(32, min(tc, block // max(ec, 1) // 4)))
        out = []
        for a in range(0, tc, step):
            z = min(tc, a + step)
            lo = int(np.searchsorted(es, np.ceil(self.threshold * ts[a] - 1e-9)))
            hi = int(np.searchsorted(es, most[a:z].max(), "right"))
            wide = max(1, block // (z - a))
            for c in range(lo, hi, wide):
                d = min(hi, c + wide)
                differ = np.bitwise_count(t0[a:z, None] ^ e0[None, c:d])
                differ += np.bitwise_count(t1[a:z, None] ^ e1[None, c:d])
                x, y = np.nonzero(differ <= self.differ[ts[a:z, None] + es[None, c:d]])
                if len(x):
                    out.append(self._fits(t, row[x + a], y + c + ef))
        return out


def _match(threshold: float, chunk: int = 1_000_000):
    """Blobs come sorted by (shard, side): the evaluation side is read first, then training is streamed past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, index, waiting, count = None, [], None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal index, waiting, count, held
            if waiting and (held or index is not None):
                if index is None:
                    index, held = _Shard([np.concatenate(x) for x in zip(*held, strict=True)], threshold), []
                yield from index.join([np.concatenate(x) for x in zip(*waiting, strict=True)])
            waiting, count = [], 0

        for b in batches:
            for shard, side, m, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if shard != current:
                    yield from flush()
                    current, held, index = shard, [], None
                if side == 0:
                    held.append(_unpacked(m, data))
                elif held or index is not None:
                    waiting.append(_unpacked(m, data))
                    count += m
                    if count >= chunk:
                        yield from flush()
        yield from flush()

    return run


# --- search in the evaluation texts ---------------------------------------------------------------------------

_SPANS = "t bigint, e bigint, n_spans int, longest int, covered int, common int, t_words int, e_words int, jaccard double, spans array<struct<t_start:int,e_start:int,length:int>>"
_SPAN_TYPE = pa.struct([("t_start", pa.int32()), ("e_start", pa.int32()), ("length", pa.int32())])


def _codes(t: pa.ListArray, e: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of both sides as numbers, with their offsets."""
    (tv, to), (ev, eo) = ((x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()), x.offsets.to_numpy() - x.offsets[0].as_py()) for x in (t, e))
    both = pa.concat_arrays([tv.cast(pa.string()), ev.cast(pa.string())]).dictionary_encode().indices.to_numpy().astype(np.int64)
    return both[: len(tv)], to.astype(np.int64), both[len(tv) :], eo.astype(np.int64)


def spans_of(tcode: np.ndarray, to: np.ndarray, ecode: np.ndarray, eo: np.ndarray, e_of: np.ndarray, piece: int = 256) -> tuple[np.ndarray, ...]:
    """(pair, t_start, e_start, length) of the spans of pairs: pattern k is the training text k, searched in the
    evaluation text e_of[k]. The index's symbols are (text, word), so one index serves all texts and a match lies
    in the pair's own. Long patterns are searched in pieces; what follows on both sides is merged."""
    lens = np.diff(eo)
    index = FMIndex((np.repeat(np.arange(len(lens)), lens) << 32) | ecode, eo)
    n = np.diff(to)
    pieces = -(-n // piece)
    owner = np.repeat(np.arange(len(n)), pieces)
    begin = to[:-1][owner] + piece * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    which, start, length, place = index.maximal_matches((np.repeat(e_of, n) << 32) | tcode, np.append(begin, to[-1]))
    pair = owner[which]
    t_start = begin[which] - to[:-1][pair] + start
    e_start = place - eo[:-1][e_of[pair]] - e_of[pair]
    order = np.lexsort((t_start, pair))
    pair, t_start, e_start, length = pair[order], t_start[order], e_start[order], length[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (t_start[:-1] + length[:-1] != t_start[1:]) | (e_start[:-1] + length[:-1] != e_start[1:])
    at = np.flatnonzero(new)
    return pair[at], t_start[at], e_start[at], np.add.reduceat(length, at) if len(at) else length


def _common(tcode: np.ndarray, to: np.ndarray, ecode: np.ndarray, eo: np.ndarray, e_of: np.ndarray) -> np.ndarray:
    """Words in common of each pair, counted with repetition."""
    size = int(max(tcode.max(initial=0), ecode.max(initial=0))) + 1
    n = np.diff(to)
    a, ac = np.unique(np.repeat(np.arange(len(n)), n) * size + tcode, return_counts=True)
    en = np.diff(eo)[e_of]
    at = np.repeat(eo[:-1][e_of] - np.cumsum(en) + en, en) + np.arange(int(en.sum()))
    b, bc = np.unique(np.repeat(np.arange(len(n)), en) * size + ecode[at], return_counts=True)
    both, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(both // size, weights=np.minimum(ac[x], bc[y]), minlength=len(n)).astype(np.int64)


def _compare(threshold: float, with_spans: bool, most: int = 500_000):
    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, first, e_of = np.unique(b.column("e").to_numpy(), return_index=True, return_inverse=True)
        tcode, to, ecode, eo = _codes(b.column("tw"), b.column("ew").take(pa.array(first)))
        pair, t_start, e_start, length = spans_of(tcode, to, ecode, eo, e_of)
        rows = len(e_of)
        n_spans = np.bincount(pair, minlength=rows)
        covered = np.bincount(pair, weights=length, minlength=rows).astype(np.int64)
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, pair, length)
        tn, en = np.diff(to), np.diff(eo)[e_of]
        common = _common(tcode, to, ecode, eo, e_of)
        kept = np.flatnonzero((covered >= _least_common(tn + en, threshold)) & (common >= threshold * (tn + en - common) - 1e-9))
        listed = pa.nulls(len(kept), pa.list_(_SPAN_TYPE))
        if with_spans:
            mine = np.isin(pair, kept)
            values = pa.StructArray.from_arrays([pa.array(c[mine].astype(np.int32)) for c in (t_start, e_start, length)], fields=list(_SPAN_TYPE))
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_spans[kept])).astype(np.int32)), values)
        cols = [b.column("t").take(pa.array(kept)), b.column("e").take(pa.array(kept))]
        cols += [pa.array(c[kept].astype(np.int32)) for c in (n_spans, longest, covered, common, tn, en)]
        cols += [pa.array(common[kept] / np.maximum(tn + en - common, 1)[kept]), listed]
        return pa.RecordBatch.from_arrays(cols, names=["t", "e", "n_spans", "longest", "covered", "common", "t_words", "e_words", "jaccard", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(np.diff(b.column("tw").offsets.to_numpy()) + np.diff(b.column("ew").offsets.to_numpy()))
            at = 0
            while at < b.num_rows:  # a block's texts are bounded, but for one pair
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
                yield block(b.slice(at, upto - at))
                at = upto

    return run


# --- the operator ---------------------------------------------------------------------------------------------


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a digest of the bag of words: a sum, so the order does not matter."""
    for b in batches:
        w, offsets = _flat(b.column("w"))
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(w.astype(np.int64) + np.int64(0x9E3779B9)), dtype=np.uint64)])
            h = (total[offsets[1:]] - total[offsets[:-1]] + _mix(np.diff(offsets).astype(np.int64))).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("rec_id"), b.column("train"), b.column("w"), pa.array(h)], names=["rec_id", "train", "w", "h"])


def record_words(unified: DataFrame) -> tuple[DataFrame, str]:
    """(rec_id, train, w, h) of the records with words, written once to the shared folder, and where: three
    passes read it, each only the columns it needs."""
    split = F.lower(F.trim("split"))
    src = unified.where(split.isin("train", "dev", "test")).select("rec_id", (split == "train").alias("train"), word_hashes(F.col("text")).alias("w"))
    out = src.where(F.size("w") > 0).mapInArrow(_digest, "rec_id bigint, train boolean, w array<int>, h bigint")
    spark = unified.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/notewright-words-{uuid.uuid4().hex}"
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path), path


def copies(unified: DataFrame, table: DataFrame) -> DataFrame:
    """(rec_id, train, rep, seq, has_train, has_eval): members of the classes of more than one record; `seq` is a
    digest of the words in their order. A class found by its 64-bit sum is confirmed on the words."""
    likely = table.groupBy("h").agg(F.min("rec_id").alias("a"), F.max("rec_id").alias("b")).where("a <> b").select("h")
    ids = cut(table.select("rec_id", "train", "h").join(broadcast_if_small(likely), "h", "left_semi").select("rec_id", "train").distinct())
    w = words(F.col("text"))
    texts = unified.select("rec_id", "text").join(broadcast_if_small(ids), "rec_id").select("rec_id", "train", F.sha2(F.array_join(F.array_sort(w), " "), 256).alias("bag"), F.sha2(F.array_join(w, " "), 256).alias("seq"))
    members = cut(texts.distinct())
    classes = members.groupBy("bag").agg(F.min("rec_id").alias("rep"), F.max("rec_id").alias("last"), F.max("train").alias("has_train"), F.max(~F.col("train")).alias("has_eval")).where("rep <> last")
    return members.join(broadcast_if_small(classes.drop("last")), "bag").select("rec_id", "train", "rep", "seq", "has_train", "has_eval")


def candidates(table: DataFrame, dups: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, work: int = WORK) -> DataFrame:
    """(t, e): class representatives with an anchor in common that sizes, places and parities do not part."""
    sketch = token_sketch(table)
    shards = int(max(64, sketch.sum() * 0.35 // 300_000))
    once = table.select("rec_id", "train", "w").join(broadcast_if_small(dups.select("rec_id", "rep", "has_train", "has_eval").distinct()), "rec_id", "left").where("rep IS NULL OR rep = rec_id")
    once = once.select("rec_id", F.coalesce("has_train", "train").alias("has_train"), F.coalesce("has_eval", ~F.col("train")).alias("has_eval"), "w")
    rows = once.mapInArrow(_anchors(sketch, threshold, shards, hot, work), _ANCHORS)
    tasks = min(shards, max(4 * table.sparkSession.sparkContext.defaultParallelism, shards // 4))
    return rows.repartition(tasks, "shard").sortWithinPartitions("shard", "side").mapInArrow(_match(threshold), _PAIRS).distinct()


def compared(unified: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, with_spans: bool = False) -> DataFrame:
    """(t, e, n_spans, longest, covered, common, t_words, e_words, jaccard, spans) of the `pairs` over the
    threshold; `spans` is null unless asked for."""
    ids = pairs.select(F.explode(F.array("t", "e")).alias("rec_id")).distinct()
    texts = unified.select("rec_id", "text").join(broadcast_if_small(ids), "rec_id", "left_semi").groupBy("rec_id").agg(F.first("text").alias("text"))
    texts = cut(texts.select("rec_id", words(F.col("text")).alias("w")))
    b = pairs.join(texts.select(F.col("rec_id").alias("t"), F.col("w").alias("tw")), "t").join(texts.select(F.col("rec_id").alias("e"), F.col("w").alias("ew")), "e")
    return b.select("t", "e", "tw", "ew").mapInArrow(_compare(threshold, with_spans), _SPANS)


def own_ids(unified: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rec_id, split, text) in which each text of a record that came with several texts, or on both sides, has an id
    of its own, and (own, of) of those ids; None if no record did."""
    split = F.lower(F.trim("split"))
    used = unified.where(split.isin("train", "dev", "test") & F.col("text").isNotNull() & F.col("rec_id").isNotNull())
    train, h = split == "train", F.xxhash64("text")
    facts = used.groupBy("rec_id").agg(F.min(h).alias("a"), F.max(h).alias("b"), F.min(train).alias("c"), F.max(train).alias("d"))
    many = cut(facts.where("a <> b OR c <> d").select("rec_id"))
    if many.isEmpty():
        return unified.select("rec_id", "split", "text"), None
    top = used.agg(F.max("rec_id")).first()[0]
    texts = used.join(broadcast_if_small(many), "rec_id", "left_semi").groupBy(F.col("rec_id").alias("of"), train.alias("train"), "text").agg(F.min(split).alias("split"))
    texts = cut(texts.withColumn("own", F.lit(top + 1) + F.monotonically_increasing_id()))
    rest = unified.select("rec_id", "split", "text").join(broadcast_if_small(many), "rec_id", "left_anti")
    return rest.unionByName(texts.select(F.col("own").alias("rec_id"), "split", "text")), texts.select("own", "of")


def _of_records(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """`pairs` by the ids of the records; of a pair that several texts give the closest."""
    for side in ("t", "e"):
        names = own.select(F.col("own").alias(side), F.col("of").alias(f"{side}_of"))
        pairs = pairs.join(broadcast_if_small(names), side, "left")
    pairs = cut(pairs)
    twice = F.col("t_of").isNotNull() | F.col("e_of").isNotNull()
    cols = ("exact", "jaccard", "n_spans", "longest", "covered", "spans")
    best = pairs.where(twice).groupBy(F.coalesce("t_of", "t").alias("t"), F.coalesce("e_of", "e").alias("e")).agg(F.max(F.struct(*cols)).alias("b"))
    return pairs.where(~twice).select("t", "e", *cols).unionByName(best.select("t", "e", "b.*"))


def overlaps(unified: DataFrame, threshold: float = THRESHOLD, with_spans: bool = False, hot: int = HOT, work: int = WORK) -> DataFrame:
    """(t, e, exact, jaccard, n_spans, longest, covered, spans): every pair of a train record and a dev or test
    record, copies expanded. `exact`: the words are the same in the same order; copies have one span then, else
    null counts (the same words in another order are not searched). A record that came with several texts, or in
    both splits, counts with each of them."""
    unified, own = own_ids(unified)
    table, path = record_words(unified)
    dups = cut(copies(unified, table))
    pairs = cut(candidates(table, dups, threshold, hot, work))
    remove(unified.sparkSession, path)
    found = compared(unified, pairs, threshold, with_spans)
    train = dups.where("train").select(F.col("rep").alias("t"), F.col("rec_id").alias("t_rec"), F.col("seq").alias("t_seq")).distinct()
    held = dups.where("NOT train").select(F.col("rep").alias("e"), F.col("rec_id").alias("e_rec"), F.col("seq").alias("e_seq")).distinct()
    near = found.join(train.drop("t_seq"), "t", "left").join(held.drop("e_seq"), "e", "left")
    near = near.select(F.coalesce("t_rec", "t").alias("t"), F.coalesce("e_rec", "e").alias("e"), F.lit(False).alias("exact"), "jaccard", "n_spans", "longest", "covered", "spans")
    # a class may hold a third of all rows: its members are salted
    salts = 16
    salted = train.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(
        held.withColumnRenamed("e", "t").withColumn("salt", F.pmod(F.xxhash64("e_rec"), F.lit(salts)).cast("int")), ["t", "salt"]
    )
    same = salted.select(F.col("t_rec").alias("t"), F.col("e_rec").alias("e"), (F.col("t_seq") == F.col("e_seq")).alias("exact"), F.lit(1.0).alias("jaccard"))
    found = near.unionByName(same, allowMissingColumns=True)
    return found if own is None else _of_records(found, own)


def report(unified: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(split, source, n_records, n_overlapping, n_exact, n_pairs, n_spans, longest, words): per evaluation split
    and source: its records, those that occur in train, word for word in order, pairs, and of the pairs that
    are not word for word the merged spans, the longest one and the words in spans."""
    o = overlaps(unified, threshold)
    per = o.groupBy(F.col("e").alias("rec_id")).agg(F.count("*").alias("pairs"), F.max("exact").alias("exact"), F.sum("n_spans").alias("spans"), F.max("longest").alias("longest"), F.sum("covered").alias("covered"))
    split = F.lower(F.trim("split"))
    held = unified.where(split.isin("dev", "test")).select("rec_id", split.alias("split"), F.lower(F.trim("source")).alias("source")).dropDuplicates(["rec_id"])
    zero = F.lit(0).cast("bigint")
    return held.join(per, "rec_id", "left").groupBy("split", "source").agg(
        F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.count_if("exact").alias("n_exact"), F.coalesce(F.sum("pairs"), zero).alias("n_pairs"),
        F.coalesce(F.sum("spans"), zero).alias("n_spans"), F.max("longest").alias("longest"), F.coalesce(F.sum("covered"), zero).alias("words"),
    )
