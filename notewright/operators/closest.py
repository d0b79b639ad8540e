"""The entries that share most trigrams with a key, and the codes of those that score best.

A list of entries is sent to the workers once; postings of its trigrams and words are built there, and the shared
trigrams and words of a key with all entries are counted by adding up postings. No pairs of keys and entries are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Scores are rounded to six digits afterwards, so what may still tie is kept.
SLACK = 2e-6


def _grams(key: str) -> set[str]:
    s = key.replace(" ", "")
    return {s[i : i + 3] for i in range(max(len(s) - 2, 1))} if s else set()


def _words(key: str) -> set[str]:
    return {w for w in key.split(" ") if w}


def _postings(sets: list[set[str]]) -> dict[str, np.ndarray]:
    lists: dict[str, list[int]] = {}
    for i, x in enumerate(sets):
        for g in x:
            lists.setdefault(g, []).append(i)
    return {g: np.array(x, np.int32) for g, x in lists.items()}


class _Entries:
    def __init__(self, rows: list[tuple[str, list[str]]]):
        rows = sorted(rows, key=lambda r: r[0])
        self.keys, self.codes = [r[0] for r in rows], [r[1] for r in rows]
        grams, words = [_grams(k) for k in self.keys], [_words(k) for k in self.keys]
        self.n_grams, self.n_words = (np.array([len(x) for x in s], np.int64) for s in (grams, words))
        self.grams, self.words = _postings(grams), _postings(words)

    def _shared(self, postings: dict[str, np.ndarray], of: set[str]) -> np.ndarray:
        lists = [postings[g] for g in of if g in postings]
        return np.bincount(np.concatenate(lists), minlength=len(self.keys)) if lists else np.zeros(len(self.keys), np.int64)

    def best(self, key: str, topk: int, cap: int) -> Iterator[tuple[str, float]]:
        """(code, score), not rounded, of the entries that can be among the `topk` best codes of the `cap` entries."""
        g, t = _grams(key), _words(key)
        shared = self._shared(self.grams, g)
        at = np.flatnonzero(shared)
        at = at[np.argsort(-shared[at], kind="stable")[:cap]]  # entries are in order of their keys
        gi, both = shared[at], self._shared(self.words, t)[at]
        sub = np.zeros(len(at))
        # a key of three characters or more stands only in entries that hold all its trigrams
        for i in np.flatnonzero(gi == len(g)) if len(key.replace(" ", "")) >= 3 else range(len(at)):
            e = self.keys[at[i]]
            sub[i] = 1.0 if e.startswith(key) else 0.7 if key in e else 0.0
        score = 0.40 * (gi / (len(g) + self.n_grams[at] - gi)) + 0.22 * (2 * both / (len(t) + self.n_words[at])) + 0.18 * (both == len(t)) + 0.12 * sub + 0.08 * (both / len(t))
        seen, least = set(), None
        for i in np.argsort(-score, kind="stable"):
            if least is not None and score[i] < least - SLACK:
                break
            for c in self.codes[at[i]]:
                seen.add(c)
                yield c, float(score[i])
            if least is None and len(seen) >= topk:
                least = score[i]


def best_codes(mentions: DataFrame, entries: DataFrame, topk: int, cap: int, most: int) -> DataFrame | None:
    """(key, code, score) of the codes that can be among the `topk` best of each mention key, by the `cap` entries
    (key, code) that share most trigrams with it; None for a list of more than `most` entries."""
    listed = entries.where("key <> ''").groupBy("key").agg(F.collect_set(F.struct("code")).alias("codes"))
    rows = listed.limit(most + 1).collect()  # bounded
    if len(rows) > most:
        return None
    sent = mentions.sparkSession.sparkContext.broadcast([(r.key, [x.code for x in r.codes]) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Entries(sent.value)
        for b in batches:
            out = [(k, c, s) for k in b.column(0).to_pylist() for c, s in index.best(k, topk, cap)]
            key, code, score = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(code, pa.string()), pa.array(score, pa.float64())], names=["key", "code", "score"])

    keys = spread(mentions.select("key").where("key <> ''").distinct(), "key")
    return keys.mapInArrow(run, "key string, code string, score double").select("key", "code", F.round("score", 6).alias("score"))
