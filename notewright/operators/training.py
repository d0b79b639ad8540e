"""Token rows for training and what comes back from a token model: labels, flags, masks, padding, span scores.

Tokens are runs of characters other than white space, numbered from 1; 0 and the number after the last are the
special tokens at (0, 0). Null and empty texts have the two special tokens only; records without spans have 'O'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tables as T
from . import spans as S
from . import tagging

TOKEN = r"[^\t-\r\x{20}]+"
#: Fixed value: the label of tokens that take no part.
IGNORED = -100


def bio_labels(types: tuple[str, ...]) -> list[str]:
    """The label space of some types; a label's place is its number."""
    return ["O", *(f"{mark}-{t}" for t in types for mark in "BI")]


def _rows(df: DataFrame, key: str, text: str, spans: str, max_len: int, lists: bool) -> DataFrame:
    kinds = {"fine": T.TYPES, "coarse": T.COARSE}
    return tagging.training_rows(df, key, text, spans, kinds, T.ASSERTED_TYPES, T.ASSERTIONS, max_len - 2, IGNORED, lists)


def record_tokens(df: DataFrame, key: str, text: str, spans: str, max_len: int = 256) -> DataFrame:
    """(key, no, start, end, fine, coarse, flags, mask) of every token of records with their array of spans, special
    ones included; of the spans that overlap a token the last gives its label, all give their flags."""
    return _rows(df, key, text, spans, max_len, False)


def record_rows(df: DataFrame, key: str, text: str, spans: str, max_len: int = 256) -> DataFrame:
    """The same as one training row a record: (key, starts, ends, fine, coarse, flags, mask)."""
    return _rows(df, key, text, spans, max_len, True)


def token_rows(df: DataFrame, spans: DataFrame, key: str, text: str, max_len: int = 256) -> DataFrame:
    """(key, no, start, end, fine, coarse, flags, mask) of every token, special ones included. `df` has one row a
    record; `spans` has (key, span_no, start, end, fine, coarse, assertions)."""
    per = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("span_no", "start", "end", "fine", "coarse", "assertions"))).alias("__s"))
    return record_tokens(df.select(key, text).join(per, key, "left"), key, text, "__s", max_len)


def assembled(rows: DataFrame, key: str) -> DataFrame:
    """(key, starts, ends, fine, coarse, flags, mask): one training row a record, arrays in the order of tokens."""
    cols = ("start", "end", "fine", "coarse", "flags", "mask")
    a = S.spread(rows, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", *cols))).alias("a"))
    return a.select(key, *(F.col("a")[c].alias({"start": "starts", "end": "ends"}.get(c, c)) for c in cols))


def pad(arr: Column, value: Column, n: Column) -> Column:
    """An array filled up to n elements."""
    return F.concat(arr, F.array_repeat(value, F.greatest(n - F.size(arr), F.lit(0))))


def padded(rows: DataFrame, batch: str) -> DataFrame:
    """`rows` of `assembled` with a batch column, `width` and `attention`: all arrays as long as the batch's longest."""
    r = rows.withColumn("width", F.max(F.size("starts")).over(W.partitionBy(batch))).withColumn("attention", F.array_repeat(F.lit(1), F.size("starts")))
    fill = {"starts": F.lit(0), "ends": F.lit(0), "fine": F.lit(IGNORED), "coarse": F.lit(IGNORED), "flags": F.array(F.lit(0), F.lit(0), F.lit(0)), "mask": F.lit(0), "attention": F.lit(0)}
    return r.withColumns({c: pad(F.col(c), v, F.col("width")) for c, v in fill.items()})


def scored_spans(decoded: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """(key, first, last, kind, start, end, score, assertions) of decoded spans (key, first, last, kind) with the mean
    confidence of their tokens, and the labels whose mean probability is at least a half, for types that bear any.
    `preds` has (key, no, start, end, conf, probs), probs in the order of the labels."""
    each = decoded.select(key, "first", "last", "kind", F.explode(F.sequence("first", "last")).alias("no")).join(preds, [key, "no"])
    mean = each.groupBy(key, "first", "last", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("conf").alias("score"), *(F.avg(F.get("probs", F.lit(i))).alias(f"p{i}") for i in range(3)))
    labels = F.array_compact(F.array(*(F.when(F.round(f"p{i}", 9) >= 0.5, a) for i, a in enumerate(T.ASSERTIONS))))
    labels = F.when(F.col("kind").isin(*T.ASSERTED_TYPES), labels).otherwise(F.array().cast("array<string>"))
    return mean.select(key, "first", "last", "kind", "start", "end", F.round("score", 6).alias("score"), labels.alias("assertions"))
