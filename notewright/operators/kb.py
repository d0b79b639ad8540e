"""Knowledge-base tables: keep filters, exact and relaxed indexes, hierarchy, preferred names, dictionary.

A knowledge base is a fixed table; its indexes are still built by plain aggregations that pre-aggregate before
the shuffle. Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..session import broadcast_if_small


def keep_codes(icd: DataFrame) -> DataFrame:
    """Entries whose code has at least three characters and begins with a letter, with level and parent."""
    code = F.trim("code")
    e = icd.where((F.length(code) >= 3) & code.rlike(r"^\p{L}"))
    return e.select(code.alias("code"), "en", "vn", "key_vn", "key_en", X.code_level(code).alias("level"), X.parent_code(code).alias("parent")).distinct()


def exact_index(pairs: DataFrame, key: str, code: str) -> DataFrame:
    """(key, codes): the distinct codes of each key in order."""
    return pairs.where(F.col(key) != "").groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(code)).alias("codes"))


def icd_pairs(icd: DataFrame) -> DataFrame:
    """(key, code) of both languages."""
    return icd.select(F.col("key_vn").alias("key"), "code").unionByName(icd.select(F.col("key_en").alias("key"), "code")).where("key IS NOT NULL")


def children(icd: DataFrame) -> DataFrame:
    """(parent, children): the leaves of each three-character code in order."""
    leaves = icd.where(F.col("code").contains(".")).select(X.parent_code(F.col("code")).alias("parent"), "code")
    return leaves.groupBy("parent").agg(F.array_sort(F.collect_set("code")).alias("children"))


def relaxed_index(rx: DataFrame) -> DataFrame:
    """(key, codes) by the key without salts, of entries that had one."""
    loose = X.strip_salts(F.col("key"))
    return exact_index(rx.select(loose.alias("k"), "key", "rxcui").where("k <> key"), "k", "rxcui")


def preferred(rx: DataFrame, ranks: tuple[str, ...] = T.TTY_RANK) -> DataFrame:
    """(rxcui, name): the name of the lowest term-type rank; ties by the name."""
    rank = F.coalesce(*(F.when(F.col("tty") == t, i) for i, t in enumerate(ranks)), F.lit(len(ranks)))
    return rx.groupBy("rxcui").agg(F.min(F.struct(rank.alias("r"), F.col("str").alias("name")))["name"].alias("name"))


def dictionary(rx: DataFrame, kinds: tuple[str, ...] = ("IN", "PIN", "MIN", "BN"), least: int = 4, blanks: int = 5, stop: tuple[str, ...] = T.NOT_DRUGS) -> DataFrame:
    """(name, n_chars): names for text scans, longest first."""
    k = F.col("key")
    keep = F.col("tty").isin(*kinds) & (F.length(k) >= least) & (F.length(k) - F.length(F.replace(k, F.lit(" "), F.lit(""))) <= blanks)
    if stop:
        keep = keep & ~k.isin(*stop)
    return rx.where(keep).select(k.alias("name"), F.length(k).alias("n_chars")).distinct().orderBy(F.desc("n_chars"), "name")


def names(icd: DataFrame, rx: DataFrame) -> DataFrame:
    """(kb, name, code): one row per name that is not empty."""
    i = icd.select(F.col("code"), F.explode(F.array("vn", "en")).alias("name")).select(F.lit("icd").alias("kb"), "name", "code")
    r = rx.select(F.lit("rxnorm").alias("kb"), F.col("str").alias("name"), F.col("rxcui").alias("code"))
    return i.unionByName(r).where("name <> ''").distinct()


def indexes(icd: DataFrame, rx: DataFrame) -> dict[str, DataFrame]:
    """The tables that linking reads, by name."""
    return {
        "icd_entries": keep_codes(icd), "icd_exact": exact_index(icd_pairs(icd), "key", "code"), "icd_children": children(icd),
        "rx_exact": exact_index(rx.select("key", "rxcui"), "key", "rxcui"), "rx_relaxed": relaxed_index(rx), "rx_preferred": preferred(rx), "dictionary": dictionary(rx), "names": names(icd, rx),
    }


def write_indexes(icd: DataFrame, rx: DataFrame, folder: str, version: str) -> None:
    """Write the index tables under folder/version; a version that is there is left as it is, so an index never
    outlives the knowledge base that it was built from."""
    for name, df in indexes(icd, rx).items():
        df.write.mode("ignore").parquet(f"{folder}/{version}/{name}")


def with_names(df: DataFrame, names: DataFrame, code: str = "code") -> DataFrame:
    """`df` with `name`: the preferred name (code, name) of its code, '' where there is none."""
    known = broadcast_if_small(names.select(F.col("code").alias(code), "name"))
    return df.join(known, code, "left").withColumn("name", F.coalesce("name", F.lit("")))


def icd_names(icd: DataFrame) -> DataFrame:
    """(code, name): the Vietnamese name, else the English one; of several the first in order."""
    return icd.groupBy("code").agg(F.coalesce(F.min(F.when(F.col("vn") != "", F.col("vn"))), F.min(F.when(F.col("en") != "", F.col("en")))).alias("name"))
