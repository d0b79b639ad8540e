"""Vector search, hybrid candidates and list-constrained choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tables as T
from ..session import cut

def _rows_of(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def _packed(size: int):
    """Batches of (id, code, vector) as blocks of at most `size` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                m = _rows_of(part.column(2))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.string())), pa.array([m.tobytes()], pa.binary())], names=["ids", "codes", "m"])

    return run


def _best(s: np.ndarray, ids: np.ndarray, codes: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries x k' indexes, scores) of the best columns of a score matrix, of each code the best one only; ties go to
    the smaller id."""
    order = np.argsort(ids, kind="stable")
    if codes is not None:
        order = order[np.argsort(codes[order], kind="stable")]
        c = codes[order]
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        sorted_ = s[:, order]
        top = np.maximum.reduceat(sorted_, starts, axis=1)
        width = np.diff(np.append(starts, len(order)))
        first = np.where(sorted_ == np.repeat(top, width, axis=1), np.arange(len(order)), len(order))
        s, order = top, order[np.minimum.reduceat(first, starts, axis=1)]
    else:
        s, order = s[:, order], np.broadcast_to(order, s.shape)
    if codes is not None:  # columns are codes now: ties by id among them
        by_id = np.argsort(ids[order], axis=1, kind="stable")
        s, order = np.take_along_axis(s, by_id, 1), np.take_along_axis(order, by_id, 1)
    best = np.argsort(-s, axis=1, kind="stable")[:, : min(k, s.shape[1])]
    return np.take_along_axis(order, best, 1), np.take_along_axis(s, best, 1)


def _scored(k: int, by_code: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q_ids, ids = np.array(r["q_ids"]), np.array(r["ids"])
                q, m = (np.frombuffer(r[c], np.float64).reshape(n, -1) for c, n in (("q", len(q_ids)), ("m", len(ids))))
                s = q @ m.T
                s = np.copysign(np.floor(np.abs(s) * 1e6 + 0.5) / 1e6, s)  # ties are ties of the rounded score
                codes = np.array(["" if c is None else c for c in r["codes"]]) if by_code else None
                at, best = _best(s, ids, codes, k)
                flat = at.reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, at.shape[1])), pa.array(ids[flat]), pa.array([r["codes"][i] for i in flat], pa.string()), pa.array(best.reshape(-1))],
                    names=["query", "id", "code", "score"],
                )

    return run


def _near(queries: DataFrame, rows: DataFrame, key: str, vector: str, code: str | None, k: int, block: int) -> DataFrame:
    """(query, id, code, score): of each block of rows and each query at least its k best."""
    ddl = "ids array<bigint>, codes array<string>, m binary"

    def blocks(df: DataFrame, c) -> DataFrame:
        return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), c.cast("string"), vector).mapInArrow(_packed(block), ddl)

    code_of = F.col(code) if code else F.lit(None)
    # the query set's blocks, numbered; each block of rows meets each of them by an equi-join on the number
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key), vector)
    n = max(1, -(-q.count() // block))
    q = blocks(q.withColumn("__q", F.pmod(F.xxhash64(key), F.lit(n))).repartition(n, "__q").drop("__q"), F.lit(None))
    q = cut(q.withColumn("no", F.monotonically_increasing_id()))
    numbers = F.array_sort(F.collect_list("no"))
    few = q.agg(numbers.alias("nos"))  # one number per block of queries
    r = blocks(rows, code_of).join(F.broadcast(few)).select("*", F.explode("nos").alias("no")).drop("nos")
    q = q.select("no", F.col("ids").alias("q_ids"), F.col("m").alias("q"))
    both = r.join(F.broadcast(q) if n * block <= BROADCAST_QUERIES else q, "no").select("q_ids", "q", "ids", "codes", "m")
    return both.mapInArrow(_scored(k, code is not None), "query bigint, id bigint, code string, score double")


#: Query blocks are broadcast up to so many queries, else joined by a shuffle.
BROADCAST_QUERIES = 20_000


def cosine_topk(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, block: int = 1000) -> DataFrame:
    """(query, id, score, rank): the k rows of unit vectors closest to each query, itself left out, by the score
    rounded to six digits; ties go to the smaller id. Blocks of queries meet blocks of rows on the executors; each
    meeting gives at most k + 1 rows per query before the shuffle. Rows with null vectors are left out."""
    found = _near(queries, rows, key, vector, None, k + 1, block)
    w = W.partitionBy("query").orderBy(F.desc("score"), "id")
    near = found.where("query <> id").select("query", "id", F.round("score", 6).alias("score")).withColumn("rank", F.row_number().over(w))
    return near.where(F.col("rank") <= k)


def code_search(queries: DataFrame, rows: DataFrame, key: str, vector: str, code: str, k: int = 5, block: int = 1000) -> DataFrame:
    """(query, code, id, score, rank): the k codes closest to each query, each by its closest row; ties of rows and of
    codes go to the smaller id. The queries' own rows take part; rows without a code are left out."""
    found = _near(queries, rows.where(F.col(code).isNotNull()), key, vector, code, k, block).withColumn("score", F.round("score", 6))
    best = found.groupBy("query", "code").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    w = W.partitionBy("query").orderBy(F.col("b.s"), F.col("b.id"))
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query", "code", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"), "rank")


def hybrid(linked: Column, hits: Column, threshold: float = 0.55, cap: int = 5) -> Column:
    """Linked codes, then the hits (array of (code, score)) at the threshold that are not among them, at most `cap`."""
    near = F.transform(F.filter(hits, lambda h: h["score"] >= threshold), lambda h: h["code"])
    return F.slice(F.array_distinct(F.concat(linked, near)), 1, cap)


def entity_answer(answer: Column) -> Column:
    """The (text, type) list in an answer, from its first '[' to its last ']'; empty if it is no such list."""
    shape = "array<struct<text:string,type:string>>"
    return F.coalesce(F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), shape), F.array().cast(shape))


def assertion_answer(answer: Column, cap: int = 3) -> Column:
    """The known labels of the first bracketed list in an answer, at most `cap`."""
    said = F.from_json(F.regexp_extract(answer, r"(?s)\[.*?\]", 0), "array<string>")
    return F.slice(F.filter(F.coalesce(said, F.array().cast("array<string>")), lambda x: x.isin(*T.ASSERTIONS)), 1, cap)


def enriched(items: DataFrame, chooser: Callable[[Column], Column] | None = None, topk: int = 3, threshold: float = 0.55, cap: int = 5) -> DataFrame:
    """`items` (mention, kind, context, assertions, said, linked, hits, names) with `assertions` and `candidates`: the
    labels of the answer `said` replace the item's if it names any, for types that bear labels; linked codes and
    hits are united, and of several the chooser takes what fits best, without one the first `topk`. `names` maps
    codes to names. Types without codes have none."""
    heard = assertion_answer(F.col("said"))
    d = items.withColumn("assertions", F.when(F.col("kind").isin(*T.ASSERTED_TYPES) & (F.size(heard) > 0), heard).otherwise(F.col("assertions")))
    coded = F.col("kind").isin(*T.CODED_TYPES)
    united = F.when(coded, hybrid(F.col("linked"), F.col("hits"), threshold, cap)).otherwise(F.array().cast("array<string>"))
    if chooser is None:
        return d.withColumn("candidates", F.slice(united, 1, topk))
    pairs = F.transform(united, lambda c: F.struct(c.alias("code"), F.coalesce(F.try_element_at("names", c), F.lit("")).alias("name")))
    return rerank(d.withColumn("candidates", pairs), chooser, topk).withColumn("candidates", F.col("chosen")).drop("chosen")


def prompt(mention: Column, kind: Column, context: Column, candidates: Column) -> Column:
    """A choice prompt: numbered candidates (array of (code, name)), the context cut to 300 characters."""
    lines = F.array_join(F.transform(candidates, lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), c["code"], F.lit(" - "), c["name"])), "\n")
    shown = F.when(F.coalesce(context, F.lit("")) == "", "(none)").otherwise(F.substring(context, 1, 300))
    return F.concat(F.lit("Mention: "), mention, F.lit("\nType: "), kind, F.lit("\nContext: "), shown, F.lit("\nCandidates:\n"), lines, F.lit("\nAnswer with a JSON list of numbers."))


def parse_indices(answer: Column, n: Column) -> Column:
    """Indices of 0..n-1 out of an answer: of its first bracketed list, else of all its numbers; distinct, in
    order."""
    first = F.regexp_extract(answer, r"\[[^\]]*\]", 0)

    def valid(numbers: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(numbers, lambda x: F.try_to_number(x, F.lit("S999999999")).cast("int")), lambda i: (i >= 0) & (i < n)))

    inner = valid(F.regexp_extract_all(first, F.lit(r"-?\d+"), F.lit(0)))
    return F.when(F.size(inner) > 0, inner).otherwise(valid(F.regexp_extract_all(answer, F.lit(r"-?\d+"), F.lit(0))))


def rerank(df: DataFrame, chooser: Callable[[Column], Column], topk: int = 3) -> DataFrame:
    """`df` (mention, kind, context, candidates) with `chosen`: no candidates give none, one is taken as it
    is, more go to the chooser (prompt -> answer, e.g. a pandas UDF), which sees only those rows and whose
    answer can never leave the list."""
    n = F.size("candidates")
    codes = F.transform("candidates", lambda c: c["code"])
    few = df.where(n <= 1).withColumn("chosen", codes)
    many = df.where(n > 1).withColumn("__answer", chooser(prompt(F.col("mention"), F.col("kind"), F.col("context"), F.col("candidates"))))
    picked = F.transform(parse_indices(F.col("__answer"), n), lambda i: F.get(codes, i))
    many = many.withColumn("chosen", F.slice(picked, 1, topk)).drop("__answer")
    return few.unionByName(many)
