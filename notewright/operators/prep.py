"""Preparation of training rows: hashed sampling, shards, batches, augmentation, triplets, chat rows, padding.

Randomness is a hash of a row's key and a seed, so a row's fate is the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tables as T
from ..functions import text as X
from ..session import broadcast_if_small
from . import spans as S


def uniform(seed: int, *key: str) -> Column:
    """A number in [0, 1) from a row's key."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def holdout(df: DataFrame, key: str, share: float = 0.02, seed: int = 11) -> DataFrame:
    """`df` with `held`: whether a row is held out."""
    return df.withColumn("held", uniform(seed, key) < share)


def numbered(df: DataFrame, key: str, seed: int | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """`df` with `index` of 0..n-1 in the order of a hash of the key (of the key itself without a seed): rows are
    ranked inside buckets, whose number follows the row count, and the buckets' sizes are summed up before them."""
    n = max(1, -(-df.count() // bucket_rows))
    if seed is None:
        d = df.repartitionByRange(n, key).withColumn("__b", F.spark_partition_id()).withColumn("__h", F.lit(0))
    else:
        d = df.withColumn("__h", F.xxhash64(key, F.lit(seed))).withColumn("__b", F.pmod("__h", F.lit(n)).cast("int"))
    sizes = d.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.broadcast(sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n"))  # one row per bucket
    no = F.row_number().over(W.partitionBy("__b").orderBy("__h", key))
    return d.withColumn("__r", no).join(before, "__b").withColumn("index", F.col("__before") + F.col("__r") - 1).drop("__b", "__h", "__r", "__before")


def occurrences(df: DataFrame, value: str, key: str, salts: int = 64) -> DataFrame:
    """`df` with `nth`: the number from 0 of a row among those of the same value. A value that many rows have is
    counted in salted parts."""
    d = df.withColumn("__v", F.xxhash64(value)).withColumn("__s", F.pmod(F.xxhash64(key), F.lit(salts)))
    parts = d.groupBy("__v", "__s").agg(F.count("*").alias("__n"))
    ahead = parts.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy("__v").orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    no = F.row_number().over(W.partitionBy("__v", "__s").orderBy(key))
    return d.withColumn("__r", no).join(ahead, ["__v", "__s"]).withColumn("nth", F.col("__before") + F.col("__r") - 1).drop("__v", "__s", "__r", "__before")


def shards(df: DataFrame, key: str, n: int, seed: int = 5) -> DataFrame:
    """`df` with `shard` of 0..n-1, dealt in turn, so that sizes differ by one at most."""
    return numbered(df, key, seed).withColumn("shard", F.pmod("index", F.lit(n))).drop("index")


def repeated_to(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of `df` over and over in the order of the key, `n` in all, with `place` of 0..n-1."""
    rows = numbered(df, key)
    size = rows.count()
    if size == 0:
        return rows.withColumnRenamed("index", "place")
    every = rows.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // size) - 1)))))
    return every.withColumn("place", F.col("__c") * size + F.col("index")).where(F.col("place") < n).drop("__c", "index")


def best_epoch(df: DataFrame, run: str = "run") -> DataFrame:
    """(run, epoch, f1): the best epoch of each run; of equal ones the first."""
    return df.groupBy(run).agg(F.min(F.struct((-F.col("f1")).alias("n"), "epoch", "f1")).alias("b")).select(run, F.col("b.epoch").alias("epoch"), F.col("b.f1").alias("f1"))


def noisy(name: Column, u: Column) -> Column:
    """A worn form of a name: without accents, cut at the first '-' or ',', or its first half, by `u`."""
    words = F.split(F.trim(name), " +")
    half = F.array_join(F.slice(words, 1, F.greatest(F.lit(2), F.floor(F.size(words) / 2).cast("int"))), " ")
    return F.when(u < 0.3, X.strip_accents(name)).when(u < 0.5, F.trim(F.regexp_extract(name, "^[^,-]*", 0))).when((u < 0.65) & (F.size(words) > 3), half).otherwise(name)


def triplets(names: DataFrame, seed: int = 11, sample: int | None = None) -> DataFrame:
    """(anchor, positive, negative) of names (code, name): a worn form, the name, and another name, the next in
    the hashed order; null where there is no other. At most `sample` names, drawn by the hash."""
    h = numbered(names.withColumn("__k", F.concat_ws("\n", "code", "name")), "__k", seed)
    if sample is not None:
        h = h.where(F.col("index") < sample)
    n = h.count()
    worn = noisy(F.col("name"), uniform(seed, "code", "name"))
    keep = (worn == "") | ((worn == F.col("name")) & (uniform(seed + 1, "code", "name") < 0.5))
    nxt = h.select(F.pmod(F.col("index") - 1, F.lit(max(n, 1))).alias("index"), F.col("name").alias("n"))
    rows = h.join(nxt, "index", "left")
    return rows.select(F.when(keep, F.col("name")).otherwise(worn).alias("anchor"), F.col("name").alias("positive"), F.when(F.col("n") != F.col("name"), F.col("n")).alias("negative"))


def gold_triplets(mentions: DataFrame, linked: DataFrame, names: DataFrame) -> DataFrame:
    """(anchor, positive, negative) of mentions (key, kind, surface, gold): the name of the first gold code, and of
    the first linked code (key, kind, codes) that is not gold, null if there is none; mentions whose gold code has
    no name are left out. `names` has (kind, code, name)."""
    gold = F.filter("gold", lambda c: F.coalesce(c, F.lit("")) != "")
    m = mentions.withColumn("gold", gold).where(F.size("gold") > 0).join(linked, ["key", "kind"], "left")
    m = m.withColumn("g", F.get("gold", F.lit(0))).withColumn("negatives", F.array_except(F.coalesce("codes", F.array().cast("array<string>")), "gold")).withColumn("neg", F.get("negatives", F.lit(0)))
    known = lambda c, n: broadcast_if_small(names.select("kind", F.col("code").alias(c), F.col("name").alias(n)).where(F.col(n) != ""))
    m = m.join(known("g", "positive"), ["kind", "g"]).join(known("neg", "negative"), ["kind", "neg"], "left")
    return m.select(F.col("surface").alias("anchor"), "positive", "negative")


def hard_negatives(df: DataFrame) -> DataFrame:
    """`df` (gold, linked: arrays) with the first linked code that is not gold."""
    return df.withColumn("negative", F.get(F.array_except("linked", "gold"), F.lit(0)))


def inject_gold(candidates: Column, gold: Column) -> Column:
    """Candidates, then the gold codes that are missing."""
    return F.array_union(candidates, gold)


# The wording of the training conversations.
SYSTEM = "Bạn là trợ lý trích xuất & mã hóa khái niệm y khoa tiếng Việt. Trả lời đúng định dạng yêu cầu, không giải thích thừa."
ASK_ENTITIES = 'Trích xuất các khái niệm y khoa (TRIỆU_CHỨNG, TÊN_XÉT_NGHIỆM, KẾT_QUẢ_XÉT_NGHIỆM, CHẨN_ĐOÁN, THUỐC) từ đoạn sau. Trả JSON list {"text","type"}.\n\n"'
ASK_ASSERTIONS = 'Xác định ngữ cảnh của khái niệm trong câu. Chọn 0..3 nhãn trong [isNegated, isFamily, isHistorical]. Trả JSON list.\n\nCâu: "'
ASK_CODES = ("Chọn (các) mã đúng nhất cho cụm \"", "\" (loại ", ").\nNgữ cảnh: \"", "\"\nỨng viên:\n", "\nTrả JSON list index.")
CONTEXT = 200  # characters of the note in a choice


def chat_row(user: Column, answer: Column, system: str = SYSTEM) -> Column:
    """One training conversation."""
    rows = [(F.lit("system"), F.lit(system)), (F.lit("user"), user), (F.lit("assistant"), answer)]
    return F.array(*(F.struct(r.alias("role"), c.alias("content")) for r, c in rows))


def entity_rows(df: DataFrame, key: str, text: str, spans: str) -> DataFrame:
    """(key, messages): one conversation per text with labelled spans, the spans as a JSON answer."""
    kept = F.filter(spans, lambda s: s.isNotNull() & s["fine"].isNotNull())
    answer = F.to_json(F.transform(kept, lambda s: F.struct(s["text"].alias("text"), s["fine"].alias("type"))))
    return df.where(F.size(kept) > 0).select(key, chat_row(F.concat(F.lit(ASK_ENTITIES), F.col(text), F.lit('"')), answer).alias("messages"))


def assertion_rows(spans_: DataFrame, key: str, text: str) -> DataFrame:
    """(key, span_no, messages): one conversation per span (key, text, span_no, surface, fine, assertions) of a type
    that bears assertions; null labels are left out."""
    s = spans_.where(F.col("fine").isin(*T.ASSERTED_TYPES))
    user = F.concat(F.lit(ASK_ASSERTIONS), F.col(text), F.lit('"\nKhái niệm: "'), F.col("surface"), F.lit('" (loại: '), F.col("fine"), F.lit(")"))
    answer = F.to_json(F.array_compact(F.coalesce("assertions", F.array().cast("array<string>"))))
    return s.select(key, "span_no", chat_row(user, answer).alias("messages"))


def choice_rows(mentions: DataFrame, linked: DataFrame, names: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """(key, span_no, candidates, gold_index, messages): one conversation per mention (key, span_no, mkey, surface, kind,
    context, gold) with gold and linked (mkey, kind, codes) codes: the codes with the missing gold ones, in a hashed
    order, and the places of the gold ones as the answer. `names` has (kind, code, name)."""
    gold = F.array_distinct(F.filter("gold", lambda c: F.coalesce(c, F.lit("")) != ""))
    m = mentions.withColumn("gold", gold).where(F.size("gold") > 0).join(linked.where(F.size("codes") > 0), ["mkey", "kind"])
    order = F.transform(inject_gold(F.col("codes"), F.col("gold")), lambda c: F.struct(F.xxhash64(c, F.col(key), F.col("span_no"), F.lit(seed)).alias("h"), c.alias("code")))
    m = m.withColumn("candidates", F.transform(F.array_sort(order), lambda x: x["code"]))
    each = m.select(key, "span_no", "kind", F.posexplode("candidates").alias("at", "code")).join(broadcast_if_small(names.select("kind", "code", "name")), ["kind", "code"], "left")
    line = F.concat(F.lit("["), F.col("at").cast("string"), F.lit("] "), "code", F.lit(" - "), F.coalesce("name", F.lit("")))
    lines = each.groupBy(key, "span_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    place = F.filter(F.transform("candidates", lambda c, i: F.when(F.array_contains("gold", c), i)), lambda x: x.isNotNull())
    a, b, c, d, e = map(F.lit, ASK_CODES)
    user = F.concat(a, "surface", b, "kind", c, F.substring("context", 1, CONTEXT), d, "lines", e)
    out = m.withColumn("gold_index", place).join(lines, [key, "span_no"])
    return out.select(key, "span_no", "candidates", "gold_index", chat_row(user, F.to_json("gold_index")).alias("messages"))


def inserted_names(df: DataFrame, names: DataFrame, key: str, text: str, spans: str, p: float = 0.5, seed: int = 13) -> DataFrame:
    """`df` with text and spans changed: spans of a kind in `names` (kind, name) are replaced, each with chance `p`, by a
    name of the kind, drawn by a hash; offsets move along. Of spans that overlap the first is replaced. Names are
    numbered and joined by number, so no row carries the list. `key` is unique; records without a span to
    replace stay as they are."""
    kinds = [r.kind for r in names.select("kind").distinct().collect()]  # a few types
    numbers, total = None, {}
    for k in sorted(kinds):
        one = numbered(names.where(F.col("kind") == k).select("name").distinct(), "name").select(F.lit(k).alias("fine"), F.col("index").alias("draw"), F.col("name").alias("new"))
        total[k] = one.count()
        numbers = one if numbers is None else numbers.unionByName(one)
    if not total:
        return df
    h = F.xxhash64(F.col(key), F.col("start"), F.lit(seed))
    count = F.coalesce(*(F.when(F.col("fine") == k, F.lit(n)) for k, n in total.items()))
    s = S.listed(df.select(key, spans), F.filter(spans, lambda x: x.isNotNull() & (x["start"] < x["end"]) & x["fine"].isin(*kinds)), key).select(key, "start", "end", "fine").distinct()
    s = s.where(F.pmod(h, F.lit(1 << 30)) < int(p * (1 << 30))).withColumn("draw", F.pmod(F.shiftrightunsigned(h, 30), count))
    edits = s.join(broadcast_if_small(numbers), ["fine", "draw"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("__e"))
    first = F.aggregate("__e", F.slice("__e", 1, 0), lambda acc, e: F.when((F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1)["end"] <= e["start"]), F.concat(acc, F.array(e))).otherwise(acc))
    return edited(df.join(edits.select(key, first.alias("__e")), key, "left"), text, spans)


def edited(df: DataFrame, text: str, spans: str, edits: str = "__e") -> DataFrame:
    """`df` after the edits of a column (array of start, end, new), which is dropped; spans move along and their
    text follows. A null or empty list changes nothing."""
    some = F.size(F.coalesce(edits, F.array().cast("array<struct<start:int,end:int,new:string>>"))) > 0
    d = df.withColumn("__t", F.when(some, S.apply_edits(F.col(edits), F.col(text))).otherwise(F.col(text)))

    def moved(s):
        a, b = S.shift(F.col(edits), s["start"]), S.shift(F.col(edits), s["end"])
        return s.withField("start", a.cast("int")).withField("end", b.cast("int")).withField("text", F.substring(F.col("__t"), a + 1, b - a))

    return d.withColumn(spans, F.when(some, F.transform(spans, lambda s: F.when(s.isNotNull(), moved(s)))).otherwise(F.col(spans))).withColumn(text, F.col("__t")).drop(edits, "__t")


def typos(df: DataFrame, key: str, text: str, spans: str, p_merge: float = 0.1, p_plain: float = 0.15, seed: int = 17) -> DataFrame:
    """`df` with a blank outside all spans dropped (chance `p_merge`) and all accents taken off (`p_plain`)."""
    u = lambda k: uniform(seed + k, key)
    inside = lambda at: F.exists(F.coalesce(spans, F.slice(spans, 1, 0)), lambda s: F.coalesce((s["start"] <= at) & (at < s["end"]), F.lit(False)))
    d = S.matches(df, text, " ", "__sp").withColumn("__free", F.filter("__sp", lambda x: ~inside(x["start"])))
    at = F.get("__free", F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(F.size("__free"), F.lit(1))).cast("int"))
    one = F.when((u(1) < p_merge) & (F.size("__free") > 0), F.array(F.struct(at["start"].alias("start"), at["end"].alias("end"), F.lit("").alias("new"))))
    d = edited(d.withColumn("__e", one).drop("__sp", "__free"), text, spans)
    plain = u(2) < p_plain
    d = d.withColumn(spans, F.when(plain, F.transform(spans, lambda s: F.when(s.isNotNull(), s.withField("text", X.strip_accents(s["text"]))))).otherwise(F.col(spans)))
    return d.withColumn(text, F.when(plain, X.strip_accents(F.col(text))).otherwise(F.col(text)))


# Tests that are made up: name, least and largest value, decimals, decimal sign.
LABS = (
    ("WBC", 3, 20, 2, ","), ("NEUT%", 40, 90, 1, ","), ("troponin", 0, 2, 2, "."), ("HGB", 80, 170, 0, "."),
    ("CRP", 0, 200, 1, "."), ("EF", 20, 70, 0, "."), ("creatinin", 40, 400, 0, "."), ("kali", 2.5, 6.5, 1, "."),
)
LAB_TITLE = " Kết quả xét nghiệm:"


def added_labs(df: DataFrame, key: str, text: str, spans: str, k: int = 2, seed: int = 19) -> DataFrame:
    """`df` with `k` made-up tests, name and value, at the end of each text, and their spans. Null texts stay."""
    made = F.array(*(
        F.struct(F.xxhash64(key, F.lit(n), F.lit(seed)).alias("h"), F.lit(n).alias("name"), F.translate(F.format_number(F.lit(float(a)) + F.lit(float(b - a)) * uniform(seed + i, key), dec), ".,", sign).alias("value"))
        for i, (n, a, b, dec, sign) in enumerate(LABS)
    ))
    start = F.struct(F.concat(F.regexp_replace(text, f"[{T.WS}]+$", ""), F.lit(LAB_TITLE)).alias("t"), F.array().cast("array<struct<s:int,e:int,w:string,name:boolean>>").alias("new"))

    def step(acc, x):
        at = F.length(acc["t"]) + 1
        value_at = at + F.length(x["name"]) + 2
        both = F.array(
            F.struct(at.alias("s"), (at + F.length(x["name"])).alias("e"), x["name"].alias("w"), F.lit(True).alias("name")),
            F.struct(value_at.alias("s"), (value_at + F.length(x["value"])).alias("e"), x["value"].alias("w"), F.lit(False).alias("name")),
        )
        return F.struct(F.concat(acc["t"], F.lit(" "), x["name"], F.lit(": "), x["value"], F.lit(";")).alias("t"), F.concat(acc["new"], both).alias("new"))

    d = df.withColumn("__a", F.aggregate(F.slice(F.array_sort(made), 1, k), start, step))
    new = F.transform("__a.new", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), x["w"].alias("text"), F.when(x["name"], T.TEST_NAME).otherwise(T.TEST_VALUE).alias("fine"), F.when(x["name"], "TEST").alias("coarse"), F.array().cast("array<string>").alias("assertions"), F.array().cast("array<string>").alias("candidates")))
    there = F.col(text).isNotNull()
    d = d.withColumn(spans, F.when(there, F.concat(F.coalesce(spans, F.slice(new, 1, 0)), new)).otherwise(F.col(spans)))
    return d.withColumn(text, F.when(there, F.col("__a.t")).otherwise(F.col(text))).drop("__a")


def augmented(df: DataFrame, names: DataFrame, key: str, text: str, spans: str, copies: int = 2, p_labs: float = 0.3) -> DataFrame:
    """(key, copy, source, text, spans): the originals (copy 0) and `copies` changed ones of each: names replaced,
    typos, and, with chance `p_labs`, made-up tests. `source` tells what was changed."""
    base = df.select(key, "source", text, spans)
    more = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("__k", F.concat_ws("-", key, "copy"))
    a = typos(inserted_names(more, names, "__k", text, spans), "__k", text, spans)
    a = a.withColumn("__lab", uniform(23, "__k") < p_labs)
    labs = added_labs(a.where("__lab"), "__k", text, spans)
    a = labs.unionByName(a.where("NOT __lab"))
    mark = F.concat(F.coalesce("source", F.lit("")), F.lit("+aug"), F.when(F.col("__lab"), "+lab").otherwise(""))
    return base.withColumn("copy", F.lit(0)).unionByName(a.withColumn("source", mark).drop("__k", "__lab"))


def batches(df: DataFrame, key: str, size: int, seed: int = 7) -> DataFrame:
    """`df` with `batch`: rows in a hashed order, `size` to a batch, the last one smaller."""
    return numbered(df, key, seed).withColumn("batch", F.floor(F.col("index") / size)).drop("index")


def distinct_batches(df: DataFrame, text: str, key: str, size: int, seed: int = 7) -> DataFrame:
    """`df` with `round` and `batch`: no batch holds a text twice. The n-th rows of all texts are a round, cut into
    batches in a hashed order."""
    rounds = occurrences(df, text, key)
    # a round's rows follow each other in the numbering, so a batch is a run inside its round
    n = numbered(rounds.withColumn("__o", F.struct("nth", F.xxhash64(key, F.lit(seed)).alias("h"), key)), "__o")
    first = n.groupBy("nth").agg(F.min("index").alias("__f"))
    return n.join(broadcast_if_small(first), "nth").withColumn("batch", F.floor((F.col("index") - F.col("__f")) / size)).withColumnRenamed("nth", "round").drop("__o", "__f", "index")
