"""Problem 6: encoding of a corpus with a public byte-level BPE vocabulary.

Pre-tokens are cut in the JVM by `regexp_extract_all`. Each Arrow batch is dictionary-encoded, so a worker
merges each distinct pre-token of a batch once, and ids are gathered with numpy. There is no shuffle.

Defined results: null, empty texts give `[]`; a text of blanks gives its blank tokens; repeated texts give the
same ids; special-token strings are ordinary text. Characters that the JVM's Unicode tables do not know yet
are cut by the worker's newer tables, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT_DIR, PRETOKEN, Encoder, parse_ranks

#: Java's own \s is ASCII only; the public pattern's is Unicode white space.
_JAVA_PRETOKEN = "(?U)" + PRETOKEN
_PYTHON_PRETOKEN = PRETOKEN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+", r"\p{White_Space}+").replace(r"(?!\S)", r"(?!\P{White_Space})")


def pretokens(text):
    """Array of pre-tokens of a string column; null where the JVM's tables do not know a character."""
    known = ~F.coalesce(text, F.lit("")).rlike(r"[\p{Cn}\p{Cs}]")
    return F.when(known, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_JAVA_PRETOKEN), F.lit(0)))


class _Worker:
    """Encodes lists of pre-tokens of one Arrow batch."""

    def __init__(self, vocabulary: bytes):
        self.encoder = Encoder(parse_ranks(vocabulary))

    def fallback(self, texts: list[str | None]) -> list[list[str]]:
        import regex

        rx = regex.compile(_PYTHON_PRETOKEN)
        return [rx.findall(t or "") for t in texts]

    def lists(self, pre: pa.Array, rest: pa.Array) -> pa.ListArray:
        """`pre`: lists of pre-tokens; where null, `rest` holds the text."""
        if isinstance(pre, pa.ChunkedArray):
            pre = pre.combine_chunks()
        if pre.null_count:
            rows = pre.to_pylist()
            for i, p in enumerate(rows):
                if p is None:
                    rows[i] = self.fallback([rest[i].as_py()])[0]
            pre = pa.array(rows, pa.list_(pa.string()))
        offsets = pre.offsets.to_numpy()
        flat = pre.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        piece = self.encoder.piece
        ids = [piece(t) for t in coded.dictionary.to_pylist()]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        start = np.concatenate([[0], np.cumsum(length)])[:-1].astype(np.int64)
        values = np.fromiter((x for p in ids for x in p), np.int32, int(length.sum()))
        index = coded.indices.to_numpy().astype(np.int64)
        lens = length[index]
        ends = np.concatenate([[0], np.cumsum(lens)])
        gather = np.repeat(start[index] - ends[:-1], lens) + np.arange(int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(values[gather], pa.int32()))


def _encode(vocabulary, key: str, key_type: str, counts: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(vocabulary.value)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ids = worker.lists(part.column("__pre"), part.column("__rest"))
                last = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)) if counts else ids
                yield pa.RecordBatch.from_arrays([part.column(c) for c in (key, *keep)] + [last], names=[key, *keep, "n_tokens" if counts else "ids"])

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken", counts: bool = False, keep: list[str] = ()) -> DataFrame:
    """One row per row of `df`: `key`, the columns `keep`, and `ids` (array<int>), or with `counts` only
    `n_tokens` (bigint). Columns of `df` beside these are not read. The vocabulary is read on the driver and sent to
    the executors: a public tokenizer's file, of a few MB."""
    keep = list(keep)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (key, *keep)) + (", n_tokens bigint" if counts else ", ids array<int>")
    pre = pretokens(F.col(text))
    src = df.select(key, *keep, pre.alias("__pre"), F.when(F.coalesce(F.col(text), F.lit("")).rlike(r"[\p{Cn}\p{Cs}]"), F.col(text)).alias("__rest"))
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    return src.mapInArrow(_encode(sent, key, types[key], counts, keep), schema)
