"""Problem 7: mixing sources to target weights.

The aimed total is what the planned sources hold once. Each source gets its weight of it, at most its whole
supply times `max_repeat`. The documents of a source are laid end to end in a hashed order, copy after copy,
and cut into blocks of `block_tokens` tokens; blocks are then interleaved by Pfair scheduling: block k of a source
with m of M blocks is released at slot floor(kM/m) and due at ceil((k+1)M/m), and each slot takes the released
block that is due first. The share of every source then deviates by less than one block at any point, whatever
the corpus; `shares` reports the most that it does.

Offsets come from bucket sums and a running sum inside a bucket, so no task holds a whole source however hot
it is. The schedule is a stream of slots that one executor task makes with a heap of one entry per source; it is
written to the shared folder and joined by (source, block). Its length is the corpus over the block size: for a corpus
of many TB give a larger `block_tokens`.

Defined results: sources are compared without case and outer blanks; documents of unplanned or null sources
and documents without tokens (null, empty) take no part; a source without documents gets nothing and its
share shows it; a source whose supply falls short stays short, the others keep their weight of the aimed
total; equal documents are different documents. A document longer than a block counts where it begins.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import broadcast_if_small, cut
from .bpe import DEFAULT_DIR
from .tokenize import encode


def _name(c):
    return F.lower(F.trim(c))


def sized(docs: DataFrame, plan: DataFrame, vocabulary: str = f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, n_tokens) of the planned sources' documents with tokens. Written once, since encoding
    is the costly part and the offsets need several passes."""
    wanted = F.broadcast(plan.select(_name(F.col("source")).alias("source")).distinct())  # a plan is a short list
    mine = docs.select("doc_id", "text", _name(F.col("source")).alias("source")).join(wanted, "source", "left_semi")
    return cut(encode(mine, counts=True, keep=["source"], vocabulary=vocabulary).where("n_tokens > 0").select("doc_id", "source", F.col("n_tokens")))


def quotas(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, weight, max_repeat, supply, n_docs, aimed, quota): tokens each source is to give."""
    supply = sizes.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_docs"))
    p = plan.groupBy(_name(F.col("source")).alias("source")).agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    q = p.join(F.broadcast(supply), "source", "left").crossJoin(F.broadcast(total)).fillna(0, ["supply", "n_docs"])
    aimed = F.round(F.col("weight") * F.col("total")).cast("bigint")
    return q.withColumn("aimed", aimed).withColumn("quota", F.least("aimed", F.col("supply") * F.col("max_repeat")))


def schedule(blocks: dict[str, int]) -> Iterator[tuple[int, str, int]]:
    """(slot, source, block) by earliest deadline among the released blocks; ties by source."""
    total = sum(blocks.values())
    waiting = [(0, s, 0) for s, m in sorted(blocks.items()) if m > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        yield slot, s, k
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // blocks[s], s, k + 1))


def _scheduled(blocks: dict[str, int], rows: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                slots = schedule(blocks)
                while part := list(itertools.islice(slots, rows)):
                    slot, source, block = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(source), pa.array(block, pa.int64())], names=["slot", "source", "block"])

    return run


def slots(spark: SparkSession, quota: DataFrame, block_tokens: int) -> DataFrame:
    """(slot, source, block, last, before, after): the schedule; `before` and `after` are the blocks that the source is
    ahead of its share just before and just after the slot, its extremes."""
    rows = [(r.source, r.quota) for r in quota.select("source", "quota").collect()]  # one row per planned source
    blocks = {s: -(-q // block_tokens) for s, q in rows if q > 0}
    made = cut(spark.range(1, numPartitions=1).select("id").mapInArrow(_scheduled(blocks), "slot bigint, source string, block bigint"))
    if not blocks:
        return made.select("*", *(F.lit(0).alias(c) for c in ("last", "before", "after")))
    count = F.coalesce(*(F.when(F.col("source") == s, F.lit(m)) for s, m in blocks.items()))
    share = count / F.lit(sum(blocks.values()))
    return made.select("*", (count - 1).alias("last"), (F.col("block") - share * F.col("slot")).alias("before"), (F.col("block") + 1 - share * (F.col("slot") + 1)).alias("after"))


def positions(sizes: DataFrame, seed: int = 7, bucket_docs: int = 20_000) -> DataFrame:
    """`sizes` with `at`: the tokens of its source that precede a document in the hashed order."""
    n = max(1, -(-sizes.count() // bucket_docs))
    keyed = sizes.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.col("h"), F.lit(n)))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("held"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = sums.select("source", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offset, ["source", "bucket"])
    return placed.select("doc_id", "source", "n_tokens", (F.col("before") + F.col("within")).alias("at"))


def chosen(sizes: DataFrame, quota: DataFrame, seed: int = 7) -> DataFrame:
    """(source, copy_no, doc_id, n_tokens, at): document copies until each quota is reached; a copy is taken
    if the greater part of it lies inside the quota."""
    q = F.broadcast(quota.select("source", "supply", "quota", "max_repeat"))
    p = positions(sizes, seed).join(q, "source")
    middle = F.col("at") + F.floor(F.col("n_tokens") / 2)
    copies = F.when(middle < F.col("quota"), F.floor((F.col("quota") - middle - 1) / F.col("supply")) + 1).otherwise(0)
    p = p.withColumn("copies", F.least(copies, F.col("max_repeat").cast("bigint"))).where("copies > 0")
    p = p.withColumn("copy_no", F.explode(F.expr("sequence(0, cast(copies - 1 as int))")))
    return p.select("source", "copy_no", "doc_id", "n_tokens", (F.col("copy_no") * F.col("supply") + F.col("at")).alias("at"))


#: Tokens of a block.
BLOCK_TOKENS = 4096


def mixture(docs: DataFrame, plan: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """(slot, source, copy_no, doc_id, n_tokens, at_token): order by (slot, at_token) to read the mixture;
    `at_token` counts inside the source."""
    sizes = sized(docs, plan)
    quota = quotas(sizes, plan)
    s = slots(docs.sparkSession, quota, block_tokens)
    # a copy that starts at the quota's very end stays in the last block
    last = F.broadcast(s.groupBy("source").agg(F.max("last").alias("last")))  # one row per planned source
    c = chosen(sizes, quota, seed).join(last, "source").withColumn("block", F.least(F.floor(F.col("at") / block_tokens), F.col("last")))
    return c.join(broadcast_if_small(s.select("slot", "source", "block"), 20_000), ["source", "block"]).select("slot", "source", "copy_no", "doc_id", "n_tokens", F.col("at").alias("at_token"))


def shares(docs: DataFrame, plan: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """(source, weight, max_repeat, n_docs, supply, aimed, actual, copies, most_copies, actual_share, share_of_aim,
    blocks, most_off): what each source gives, its share of the mixture and of the aimed total, its blocks and the most
    blocks that it is ahead of or behind its share of the slots at any point."""
    sizes = sized(docs, plan)
    quota = quotas(sizes, plan)
    got = chosen(sizes, quota, seed).groupBy("source").agg(F.sum("n_tokens").alias("actual"), F.count("*").alias("copies"), (F.max("copy_no") + 1).alias("most_copies"))
    off = slots(docs.sparkSession, quota, block_tokens).groupBy("source").agg(F.count("*").alias("blocks"), F.round(F.max(F.greatest(F.abs("before"), F.abs("after"))), 6).alias("most_off"))
    out = quota.join(F.broadcast(got), "source", "left").join(F.broadcast(off), "source", "left").fillna(0, ["actual", "copies", "most_copies", "blocks", "most_off"])
    whole = W.partitionBy()  # one row per planned source
    return out.select(
        "source", "weight", "max_repeat", "n_docs", "supply", "aimed", "actual", "copies", "most_copies",
        F.round(F.try_divide("actual", F.sum("actual").over(whole)), 6).alias("actual_share"),
        F.round(F.try_divide("actual", "total"), 6).alias("share_of_aim"), "blocks", "most_off",
    )
