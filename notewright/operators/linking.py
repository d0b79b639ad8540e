"""Entity linking: exact, hierarchy and relaxed look-ups, then a similarity join for the misses only.

Every code that comes out exists in the knowledge base. Each stage sees only what the stage before left over
(left-anti), so the costly join runs on misses. Ties are broken by code, so results do not depend on order.

The similarity join needs no cap on candidates: a score at the threshold needs so many words in common, by an
upper bound of the score, that only a mention's few rarest words have to be looked up (`least_shared`). Reports
without a threshold (`explain`) rank the entries that share most trigrams instead.

Null and empty keys are no mentions; repeated mentions and entries count once; an empty side gives no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..session import BROADCAST_ROWS, broadcast_if_small
from . import kb
from .closest import best_codes


def link_icd_exact(mentions: DataFrame, icd: DataFrame, topk: int = 3, expand: bool = True) -> DataFrame:
    """(key, codes) of the mentions (key) that equal an entry; a parent with leaves is replaced by them."""
    hit = mentions.join(broadcast_if_small(kb.exact_index(kb.icd_pairs(icd), "key", "code")), "key")
    if not expand:
        return hit.select("key", F.slice("codes", 1, topk).alias("codes"))
    kids = broadcast_if_small(kb.children(icd))
    one = hit.select("key", F.posexplode("codes").alias("pos", "code")).join(kids, F.col("code") == F.col("parent"), "left")
    lists = F.coalesce(F.slice("children", 1, topk), F.array("code"))
    per = one.select("key", "pos", lists.alias("l")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "l"))).alias("ls"))
    flat = F.array_distinct(F.flatten(F.transform("ls", lambda x: x["l"])))
    return per.select("key", F.slice(flat, 1, max(topk, 2)).alias("codes"))


def link_rx_exact(mentions: DataFrame, rx: DataFrame, topk: int = 3) -> DataFrame:
    """(key, codes) of the mentions that equal a drug key."""
    return mentions.join(broadcast_if_small(kb.exact_index(rx.select("key", "rxcui"), "key", "rxcui")), "key").select("key", F.slice("codes", 1, topk).alias("codes"))


def link_rx_relaxed(mentions: DataFrame, rx: DataFrame, topk: int = 3) -> DataFrame:
    """(key, codes) of the mentions that equal a drug key when both leave out their salts."""
    m = mentions.withColumn("k", X.strip_salts(F.col("key")))
    return m.join(broadcast_if_small(kb.relaxed_index(rx).withColumnRenamed("key", "k")), "k").select("key", F.slice("codes", 1, topk).alias("codes"))


def trigram_df(entries: DataFrame) -> DataFrame:
    """(gram, df): how many entries hold each trigram."""
    return entries.select(F.explode(X.char_ngrams(F.col("key"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


def trigram_candidates(mentions: DataFrame, entries: DataFrame, cap: int = 400, hot: int = 8000) -> DataFrame:
    """(key, ekey, shared): per mention key the `cap` entry keys that share most trigrams, grams of more than
    `hot` entries left out; ties by entry key. The cap is the operator's top-k."""
    e = entries.select(F.col("key").alias("ekey")).distinct().select("ekey", F.explode(X.char_ngrams(F.col("ekey"))).alias("gram"))
    frequent = e.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") > hot)
    e = e.join(broadcast_if_small(frequent.select("gram")), "gram", "left_anti")
    m = mentions.select("key").distinct().select("key", F.explode(X.char_ngrams(F.col("key"))).alias("gram"))
    shared = m.join(broadcast_if_small(e), "gram").groupBy("key", "ekey").agg(F.count("*").alias("shared"))
    w = W.partitionBy("key").orderBy(F.desc("shared"), "ekey")
    return shared.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).drop("r")


def features(df: DataFrame, key: str, g: str, t: str) -> DataFrame:
    """Distinct keys with their trigram and word sets, made once per key rather than once per pair."""
    return df.select(key).distinct().select(key, X.char_ngrams(F.col(key)).alias(g), F.array_distinct(X.tokens(F.col(key))).alias(t))


def similarity(key: Column, ekey: Column, g: Column, h: Column, t: Column, u: Column) -> Column:
    """0.40 Jaccard of trigrams, 0.22 Dice of words, 0.18 if all words are held, 0.12 for a prefix (0.7 of it
    for any place), 0.08 for the share of words held. g, h: trigram sets; t, u: word sets."""
    both = F.size(F.array_intersect(t, u))
    common = F.size(F.array_intersect(g, h))
    jaccard = F.coalesce(F.try_divide(common, F.size(g) + F.size(h) - common), F.lit(0.0))
    dice = F.coalesce(F.try_divide(2 * both, F.size(t) + F.size(u)), F.lit(0.0))
    contain = F.when((F.size(t) > 0) & (both == F.size(t)), 1.0).otherwise(0.0)
    sub = F.when(key == "", 0.0).when(ekey.startswith(key), 1.0).when(ekey.contains(key), 0.7).otherwise(0.0)
    cover = F.coalesce(F.try_divide(both, F.size(t)), F.lit(0.0))
    return 0.40 * jaccard + 0.22 * dice + 0.18 * contain + 0.12 * sub + 0.08 * cover


def _bound(b: float, q: float, t: float, jaccard: float = 1.0, sub: float = 1.0) -> float:
    return 0.40 * jaccard + 0.44 * b / (q + t) + 0.08 * b / q + (0.18 if b == q else 0.0) + 0.12 * sub


def least_shared(q: int, threshold: float) -> int:
    """The least number of a mention's `q` words that an entry at the threshold holds. A place inside the entry's
    name takes all words but the outer two."""
    fits = (b for b in range(1, q + 1) if _bound(b, q, b, sub=1.0 if b >= q - 2 else 0.0) >= threshold - 1e-6)
    return next(fits, q + 1)


def _looked_up(words: Column, threshold: float, longest: int = 128) -> Column:
    """How many of a mention's rarest words must be looked up; all where a mention is longer than `longest`."""
    if 0.40 + 0.12 >= threshold:
        raise ValueError("a threshold of 0.52 or less can be reached without a word in common")
    table = F.array(*(F.lit(max(0, q - least_shared(q, threshold) + 1)) for q in range(longest + 1)))
    return F.coalesce(F.get(table, F.size(words)), F.size(words))


def similar(mentions: DataFrame, entries: DataFrame, threshold: float, salts: bool = False) -> DataFrame:
    """(key, ekey, score) of all mention keys and entry keys with a similarity of at least `threshold`. With
    `salts`, keys that are equal without salts get 0.15 more."""
    m = features(mentions.where("key <> ''"), "key", "g", "t")
    e = features(entries.where("key <> ''").select(F.col("key").alias("ekey")), "ekey", "h", "u")
    count = broadcast_if_small(e.select(F.explode("u").alias("w")).groupBy("w").agg(F.count("*").alias("df")))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")))
    rare = m.select("key", F.explode("t").alias("w")).join(count, "w", "left").groupBy("key").agg(F.transform(order, lambda x: x["w"]).alias("t"))
    rare = rare.select("key", "t", X.char_ngrams(F.col("key")).alias("g"), F.posexplode(F.slice("t", F.lit(1), _looked_up(F.col("t"), threshold))).alias("pos", "w"))
    pairs = rare.join(broadcast_if_small(e.select("ekey", "h", "u", F.explode("u").alias("w"))), "w")
    # a pair is made at its first word in common
    pairs = pairs.where((F.col("pos") == 0) | ~F.arrays_overlap(F.slice("t", F.lit(1), F.col("pos")), F.col("u")))
    c = [F.col(x) for x in ("key", "ekey", "g", "h", "t", "u")]
    both, q, n = F.size(F.array_intersect("t", "u")), F.size("t"), F.size("u")
    most = 0.40 * F.least(F.size("g"), F.size("h")) / F.greatest(F.size("g"), F.size("h")) + 0.44 * both / (q + n) + 0.08 * both / q + F.when(both == q, 0.18).otherwise(0.0) + F.when(c[1].contains(c[0]), 0.12).otherwise(0.0)
    found = pairs.where(most >= threshold - 1e-6).select("key", "ekey", F.round(similarity(*c), 6).alias("score"))
    if salts:
        bare = lambda df, k: df.withColumn("bare", X.strip_salts(F.col(k)))
        same = bare(m, "key").join(broadcast_if_small(bare(e, "ekey")), "bare")
        found = found.unionByName(same.select("key", "ekey", F.round(similarity(*c) + 0.15, 6).alias("score"))).groupBy("key", "ekey").agg(F.max("score").alias("score"))
    return found.where(F.col("score") >= threshold)


def _best_codes(scored: DataFrame, entries: DataFrame, topk: int) -> DataFrame:
    codes = broadcast_if_small(entries.select(F.col("key").alias("ekey"), "code").distinct())
    best = scored.join(codes, "ekey").groupBy("key", "code").agg(F.max("score").alias("score"))
    w = W.partitionBy("key").orderBy(F.desc("score"), "code")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topk)


def link_fuzzy(mentions: DataFrame, entries: DataFrame, threshold: float, topk: int = 3, salts: bool = False) -> DataFrame:
    """(key, code, score, rank): the best codes of each mention key by similarity, the highest score of a code
    counting. `entries` has (key, code)."""
    return _best_codes(similar(mentions, entries, threshold, salts), entries, topk)


def closest(mentions: DataFrame, entries: DataFrame, cap: int = 400, hot: int = 8000) -> DataFrame:
    """(key, ekey, score) of the `cap` entries that share most trigrams with each mention, whatever their score."""
    c = trigram_candidates(mentions, entries, cap, hot).join(features(mentions, "key", "g", "t"), "key")
    c = c.join(broadcast_if_small(features(entries.select(F.col("key").alias("ekey")), "ekey", "h", "u")), "ekey")
    return c.select("key", "ekey", F.round(similarity(*(F.col(x) for x in ("key", "ekey", "g", "h", "t", "u"))), 6).alias("score"))


def _listed(fuzzy: DataFrame) -> DataFrame:
    return fuzzy.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes"))


def cascade_icd(mentions: DataFrame, icd: DataFrame, topk: int = 3, threshold: float = 0.62) -> DataFrame:
    """(key, stage, codes) of every distinct mention key: exact, fuzzy or none."""
    keys = mentions.select("key").where("key <> ''").distinct()
    exact = link_icd_exact(keys, icd, topk).withColumn("stage", F.lit("exact"))
    rest = keys.join(exact, "key", "left_anti")
    fuzzy = _listed(link_fuzzy(rest, kb.icd_pairs(icd).where("key <> ''"), threshold, topk)).withColumn("stage", F.lit("fuzzy"))
    return _with_none(keys, exact.unionByName(fuzzy))


def cascade_rx(mentions: DataFrame, rx: DataFrame, topk: int = 3, threshold: float = 0.60) -> DataFrame:
    """(key, stage, codes) of every distinct mention key: exact, relaxed, fuzzy or none."""
    keys = mentions.select("key").where("key <> ''").distinct()
    exact = link_rx_exact(keys, rx, topk).withColumn("stage", F.lit("exact"))
    rest = keys.join(exact, "key", "left_anti")
    relaxed = link_rx_relaxed(rest, rx, topk).withColumn("stage", F.lit("relaxed"))
    rest = rest.join(relaxed, "key", "left_anti")
    entries = rx.select("key", F.col("rxcui").alias("code")).where("key <> ''")
    fuzzy = _listed(link_fuzzy(rest, entries, threshold, topk, salts=True)).withColumn("stage", F.lit("fuzzy"))
    return _with_none(keys, exact.unionByName(relaxed).unionByName(fuzzy))


def _with_none(keys: DataFrame, found: DataFrame) -> DataFrame:
    out = keys.join(found, "key", "left")
    return out.select("key", F.coalesce("stage", F.lit("none")).alias("stage"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def _explained(exact: DataFrame, fuzzy: DataFrame, name: DataFrame, topk: int) -> DataFrame:
    best = exact.unionByName(fuzzy).groupBy("key", "code").agg(F.max("score").alias("score"))
    w = W.partitionBy("key").orderBy(F.desc("score"), "code")
    top = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= topk)
    return top.join(broadcast_if_small(name), "code", "left").select("key", "code", "name", "score")


def _equal(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    return mentions.select("key").distinct().join(broadcast_if_small(pairs.distinct()), "key").select("key", "code", F.lit(1.0).alias("score"))


def _closest_codes(mentions: DataFrame, entries: DataFrame, topk: int, cap: int = 400) -> DataFrame:
    """(key, code, score): codes of the closest entries, the `topk` best among them; all trigrams count."""
    found = best_codes(mentions, entries, topk, cap, BROADCAST_ROWS // 4)
    if found is not None:
        return found
    return _best_codes(closest(mentions, entries, cap, hot=1 << 62), entries, 10_000).select("key", "code", "score")


def explain(mentions: DataFrame, icd: DataFrame, topk: int = 5) -> DataFrame:
    """(key, code, name, score): the closest entries of each language with exact ones at 1, no threshold."""
    pairs = kb.icd_pairs(icd).where("key <> ''")
    fuzzy = None
    for c in ("key_vn", "key_en"):
        part = _closest_codes(mentions, icd.select(F.col(c).alias("key"), "code").where("key <> ''"), topk)
        fuzzy = part if fuzzy is None else fuzzy.unionByName(part)
    return _explained(_equal(mentions, pairs), fuzzy, kb.icd_names(icd), topk)


def explain_rx(mentions: DataFrame, rx: DataFrame, topk: int = 6) -> DataFrame:
    """The same for drugs, with preferred names."""
    pairs = rx.select("key", F.col("rxcui").alias("code")).where("key <> ''")
    fuzzy = _closest_codes(mentions, pairs, topk)
    return _explained(_equal(mentions, pairs), fuzzy, kb.preferred(rx).select(F.col("rxcui").alias("code"), "name"), topk)
