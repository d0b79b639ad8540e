"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each merge rank has a bucket of positions in a doubly linked list of symbols. A three-level bitmap (64 bits
a word) marks the ranks whose bucket holds something; find-first-set gives the next rank. Positions whose
pair has changed since they were queued are stale and skipped. A pre-token of n bytes costs O(n) queue
operations, so very long pre-tokens do not turn quadratic.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

DEFAULT_DIR = os.environ.get("NOTEWRIGHT_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the public pre-token pattern of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    lines = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


class RankQueue:
    """Buckets of positions by rank, with a bitmap of three levels above them."""

    __slots__ = ("top", "mid", "low", "bucket")

    def __init__(self, n_ranks: int):
        words = (n_ranks >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        held = self.bucket.get(rank)
        if held is not None:
            held.append(pos)
            return
        self.bucket[rank] = [pos]
        w, g = rank >> 6, rank >> 12
        self.low[w] |= 1 << (rank & 63)
        self.mid[g] |= 1 << (w & 63)
        self.top |= 1 << g

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions, or None."""
        if not self.top:
            return None
        g = (self.top & -self.top).bit_length() - 1
        m = self.mid[g]
        w = (g << 6) + (m & -m).bit_length() - 1
        b = self.low[w]
        rank = (w << 6) + (b & -b).bit_length() - 1
        self.low[w] = b = b & (b - 1)
        if not b:
            self.mid[g] = m = m & ~(1 << (w & 63))
            if not m:
                self.top &= ~(1 << g)
        return rank, self.bucket.pop(rank)


class Encoder:
    """Encodes pre-tokens; `cache` keeps pieces seen before and is emptied when it holds `cache_size`."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 300_000):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.cache: dict[str, list[int]] = {}
        self.cache_size = cache_size

    def piece(self, text: str) -> list[int]:
        got = self.cache.get(text)
        if got is None:
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            got = self.cache[text] = self.merge(text.encode("utf-8"))
        return got

    def merge(self, raw: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        nxt = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        # pair[i]: rank of the pair that starts at i, -1 if there is none or i is no longer a start
        pair = [-1] * n
        queue = self.queue
        get, push = ranks.get, queue.push
        for i in range(n - 1):
            r = get(raw[i : i + 2])
            if r is not None:
                pair[i] = r
                push(r, i)
        while (popped := queue.pop()) is not None:
            rank, positions = popped
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                if pair[i] != rank:
                    continue  # stale
                j = nxt[i]
                k = nxt[j]
                nxt[i] = k
                pair[j] = -1
                pair[i] = -1
                if k < n:
                    prev[k] = i
                    r = get(raw[i : nxt[k]])
                    if r is not None:
                        pair[i] = r
                        push(r, i)
                p = prev[i]
                if p >= 0:
                    r = get(raw[p:k])
                    if r is None:
                        pair[p] = -1
                    elif pair[p] != r:
                        pair[p] = r
                        push(r, p)
        out = []
        i = 0
        while i < n:
            j = nxt[i]
            out.append(ranks[raw[i:j]])
            i = j
        return out
