"""Problem 3: mapping freely typed values to the entries of a reference list.

A prefix-filter set-similarity join. Values and entries are brought to one form and cut into the trigrams of their
words, each word with marks at both ends, so the order of the words does not matter. Trigrams are ordered by
global rarity over both sides; only the rarest of each side, those that a pair at the threshold must share, are
joined, with a length and a positional filter; Jaccard is then computed exactly. Of an entry's names that pass a
last check the one of the largest Jaccard is kept. The check aligns the value with the entry's name: qualifiers may
stand in front or behind, the name's words may change places, the head word or the salt may be missing, but the name
itself may differ by few edits only, and strengths must be equal. Values that no entry passes are reported as 'none'.

Each distinct value is matched once and joined back to its rows, so a value that is typed a million times is
no hot key of the similarity join. The entry list's size is counted before it is broadcast; a longer list is joined
by shuffles, its frequent trigrams salted.

Defined results: null and blank values are no rows; a value of signs or annotations only is 'none'; ties go
to the smaller cost, then the smaller code; rows delivered twice count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import SALTS
from ..session import broadcast_if_small, cut
from . import canonical

DIAGNOSIS, DRUG = "CHẨN_ĐOÁN", "THUỐC"
NONE = "none"
#: Entry lists of at most so many names are broadcast; longer ones are joined by shuffles.
ENTRY_ROWS = 20_000

# Annotations around a name, after the form below. Parameters of `match_values`.
DIAGNOSIS_NOTES = ("chan doan xac dinh", "chan doan", "theo doi", "nghi ngo", "nghi", "td", "cd", "da dieu tri", "on dinh", "ben trai", "ben phai", "do iv", "do iii", "do ii", "do i", "toa cu")
DRUG_NOTES = (
    "toa cu", "vien", "ong", "goi", "lo", "po", "iv", "im", "sc", "bid", "tid", "qid", "qd", "daily", "prn", "uong", "tiem", "ngam", "dan", "boi", "sang", "trua", "chieu", "toi",
    r"\d+ ?v", r"x ?\d+ lan ?/ ?ngay", r"\d+ lan ?/ ?ngay", r"x ?\d+",
)
_STRENGTH = r"\d+(?:\.\d+)? ?(?:mg/ml|mcg/ml|g/l|mg|mcg|ml|g|iu|unit|%)(?:/ml)?"


def fold(c: Column) -> Column:
    """Problem 4's form, lower case, without accents; blanks and `_` single."""
    low = F.translate(F.lower(canonical.form(c)), "đ_", "d ")
    bare = F.regexp_replace(canonical.decompose(low, c), r"\p{M}+", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _spell(c: Column) -> Column:
    """Spellings of one sound: ks for x, kw for qu."""
    return F.replace(F.replace(c, F.lit("ks"), F.lit("x")), F.lit("kw"), F.lit("qu"))


def clean_diagnosis(c: Column, heads: dict[str, str], notes=DIAGNOSIS_NOTES) -> Column:
    """Words of a folded diagnosis without annotations, initials of head words written out."""
    c = F.regexp_replace(c, r"\b[a-tv-z]\.(?= )", " ")
    c = F.regexp_replace(c, r"[^a-z0-9]+", " ")
    c = F.regexp_replace(c, r"\b(?:" + "|".join(notes) + r")\b", " ")
    for initials, head in sorted(heads.items()):
        c = F.regexp_replace(c, rf"^ *{initials}\b|\b{initials}\b(?= )", f" {head} ")
    return F.trim(F.regexp_replace(c, r" +", " "))


def clean_drug(c: Column, notes=DRUG_NOTES) -> Column:
    """Words of a folded drug without routes and times, decimal points and units in one spelling."""
    c = F.regexp_replace(c, r"(\d),(\d)", "$1.$2")
    c = F.regexp_replace(c, r"(\d) *(mg/ml|mcg/ml|mg|mcg|ml|iu)\b", "$1 $2")
    c = F.regexp_replace(c, r"[^a-z0-9./% ]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r" +", " "), r"(?<![a-z0-9])(?:" + "|".join(notes) + r")(?![a-z0-9/])", " ")
    return F.trim(F.regexp_replace(c, r" +", " "))


def grams(c: Column) -> Column:
    """Set of the trigrams of each word with a mark at both ends, each as the number its three ASCII codes make."""
    words = F.filter(F.split(F.regexp_replace(c, r"[^a-z0-9./ ]", ""), " "), lambda w: w != "")

    def of(w):
        p = F.concat(F.lit("^"), w, F.lit("$"))
        at = lambda i: F.ascii(F.substring(p, i, F.lit(1)))
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: at(i) * 16384 + at(i + 1) * 128 + at(i + 2))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def _letters(c: Column) -> Column:
    """Counts of the letters and figures, for the distance of letter bags."""
    return F.array(*(F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit(""))) for ch in "abcdefghijklmnopqrstuvwxyz0123456789"))


def head_initials(entries: DataFrame, least: int = 60) -> dict[str, str]:
    """Initials of the two-word heads that at least `least` diagnosis names begin with. Few by construction:
    at most the number of entries over `least`."""
    first = F.expr("slice(split(name, ' '), 1, 2)")
    found = entries.select(F.array_join(first, " ").alias("h")).groupBy("h").count().where(F.col("count") >= least).select("h").collect()
    return {"".join(w[0] for w in r.h.split(" ")): r.h for r in found if " " in r.h}


def diagnosis_entries(icd: DataFrame) -> DataFrame:
    """(kind, code, name, bare, core, variants, strength) of the Vietnamese keys.

    A leaf's qualifier is its name without its parent's; the name proper is the parent's without its head.
    """
    e = icd.where("key_vn IS NOT NULL AND key_vn <> ''").select("code", F.col("key_vn").alias("name")).distinct()
    parent = e.where(~F.col("code").contains(".")).groupBy(F.col("code").alias("p")).agg(F.min("name").alias("pname"))
    e = e.withColumn("p", F.substring_index("code", ".", 1)).join(broadcast_if_small(parent), "p", "left")
    base = F.when(F.col("pname").isNotNull() & F.expr("startswith(name, pname)"), F.col("pname")).otherwise(F.col("name"))
    e = e.withColumn("base", base).withColumn("qual", F.expr("trim(substring(name, length(base) + 1))"))
    two = F.col("base").rlike(r"^(?:\S+ ){4,}")
    n_head = F.when(two, 2).otherwise(1)
    words = F.split("base", " ")
    e = e.withColumn("head", F.array_join(F.slice(words, 1, n_head), "")).withColumn("w", F.slice(words, n_head + 1, F.greatest(F.size(words) - n_head, F.lit(0))))
    w = [F.coalesce(F.get("w", F.lit(i)), F.lit("")) for i in range(3)]
    rest = F.array_join(F.slice("w", 4, 100), "")
    orders = [F.concat(*(w[i] for i in p), rest) for p in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))]
    q = F.replace(F.col("qual"), F.lit(" "), F.lit(""))
    short = F.substring("head", 1, 4)
    variants = F.array_distinct(F.array(*(F.concat(h, o, t) for o in orders for h, t in ((F.col("head"), q), (F.lit(""), q), (F.concat(q, F.col("head")), F.lit("")), (q, F.lit("")), (short, q), (F.concat(q, short), F.lit("")))))) 
    return e.select(F.lit(DIAGNOSIS).alias("kind"), "code", "name", F.length(F.array_join("w", "")).alias("core"), variants.alias("variants"), F.lit("").alias("strength"))


def _split_strength(c: Column) -> tuple[Column, Column]:
    s = F.array_join(F.array_sort(F.regexp_extract_all(c, F.lit(rf"(?<![a-z0-9.])({_STRENGTH})(?![a-z0-9/])"), F.lit(1))), "+")
    rest = F.regexp_replace(c, rf"(?<![a-z0-9.]){_STRENGTH}(?![a-z0-9/])", " ")
    return F.replace(s, F.lit(" "), F.lit("")), F.replace(rest, F.lit(" "), F.lit(""))


def drug_entries(rx: DataFrame) -> DataFrame:
    """The same columns for drug names; a variant leaves the salt out."""
    e = rx.where("key IS NOT NULL AND key <> ''").select(F.col("rxcui").alias("code"), F.col("key").alias("name")).distinct()
    name = _spell(clean_drug(F.col("name"), notes=("\\b\\B",)))
    strength, rest = _split_strength(name)
    _, no_salt = _split_strength(F.regexp_replace(name, r"\b(?:" + "|".join(SALTS) + r")\b", ""))
    core = F.length(F.substring_index(name, " ", 1))
    return e.select(F.lit(DRUG).alias("kind"), "code", name.alias("name"), core.alias("core"), F.array_distinct(F.array(rest, no_salt)).alias("variants"), strength.alias("strength"))


#: Trigrams of so many postings are salted where the entry list is too long to broadcast.
HOT_POSTINGS, SALTING = 2_000, 16


def _frequencies(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, t, edf, vdf): how many entries and values hold each trigram; one row per trigram of a small alphabet, at
    most 2 x 41^3."""
    of_entries = entries.select("kind", F.explode("g").alias("t")).groupBy("kind", "t").agg(F.count("*").alias("edf"))
    of_values = values.select("kind", F.explode("g").alias("t")).groupBy("kind", "t").agg(F.count("*").alias("vdf"))
    return cut(of_entries.join(of_values, ["kind", "t"], "full").fillna(0))


def candidates_by_join(values: DataFrame, entries: DataFrame, df: DataFrame, threshold: float) -> DataFrame:
    """(kind, vid, eid, jaccard) of all pairs of `values` (kind, vid, g) and `entries` (kind, eid, g) with Jaccard of at
    least `threshold`, by rare prefixes: for entry lists too long to broadcast. A pair is made at its first shared
    token only."""
    rarity = F.broadcast(df.select("kind", "t", (F.col("edf") + F.col("vdf")).alias("count")))  # see `_frequencies`

    def ordered(df: DataFrame, key: str) -> DataFrame:
        tokens = df.select("kind", key, F.explode("g").alias("t")).join(rarity, ["kind", "t"])
        o = F.array_sort(F.collect_list(F.struct("count", "t")))
        return tokens.groupBy("kind", key).agg(F.transform(o, lambda x: x["t"]).alias("o"))

    def prefix(o: Column) -> Column:
        return F.slice(o, 1, (F.size(o) - F.ceil(F.size(o) * threshold - 1e-9) + 1).cast("int"))

    hot = F.broadcast(df.where(F.col("edf") > HOT_POSTINGS).select("kind", "t", F.lit(True).alias("hot")))
    v = ordered(values, "vid").select("kind", "vid", F.col("o").alias("vo"), F.posexplode(prefix(F.col("o"))).alias("vp", "t")).join(hot, ["kind", "t"], "left")
    v = v.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("vid"), F.lit(SALTING))).otherwise(0).cast("int")).drop("hot")
    e = ordered(entries, "eid").select("kind", "eid", F.col("o").alias("eo"), F.posexplode(prefix(F.col("o"))).alias("ep", "t")).join(hot, ["kind", "t"], "left")
    e = e.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTING - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    vn, en = F.size("vo"), F.size("eo")
    needed = F.ceil(threshold / (1 + threshold) * (vn + en) - 1e-9)
    at_most = F.least(vn - F.col("vp"), en - F.col("ep"))
    both = v.join(e, ["kind", "t", "salt"]).where((en >= threshold * vn) & (vn >= threshold * en) & (at_most >= needed))
    first = (F.col("vp") == 0) | (F.col("ep") == 0) | ~F.arrays_overlap(F.expr("slice(vo, 1, vp)"), F.expr("slice(eo, 1, ep)"))
    shared = F.size(F.array_intersect("vo", "eo"))
    both = both.where(first).select("kind", "vid", "eid", F.explode_outer(F.array(shared / (vn + en - shared))).alias("jaccard"))
    return both.where(F.col("jaccard") >= threshold)


_LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)


def _bags(strings: list[str]) -> np.ndarray:
    """Counts of the letters and figures of each string."""
    place = np.full(256, len(_LETTERS))
    place[_LETTERS] = np.arange(len(_LETTERS))
    raw = [s.encode() for s in strings]
    row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    width = len(_LETTERS) + 1
    counts = np.bincount(row * width + place[np.frombuffer(b"".join(raw), np.uint8)], minlength=len(raw) * width).reshape(-1, width)
    return np.minimum(counts[:, :-1], 127).astype(np.int8)


class _Entries:
    """The entries of one kind: trigrams in the order of rarity, postings of their prefixes, letter bags."""

    def __init__(self, rows: list, order: dict[int, int], threshold: float, edits: float, most_edits: float):
        self.threshold, self.order = threshold, order
        self.eids = np.array([r.eid for r in rows], np.int64)
        grams_ = [sorted(order[t] for t in r.g) for r in rows]
        self.size = np.array([len(g) for g in grams_])
        self.presence = np.zeros((len(rows), len(order) + 1), bool)
        owner = np.repeat(np.arange(len(rows)), self.size)
        token = np.concatenate([np.array(g, np.int64) for g in grams_]) if rows else np.zeros(0, np.int64)
        self.presence[owner, token] = True
        pos = np.arange(len(token)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        kept = pos < prefix_size(self.size, threshold)[owner]
        token, owner, pos = token[kept], owner[kept], pos[kept]
        by = np.argsort(token, kind="stable")
        self.token, self.owner, self.pos = token[by], owner[by], pos[by]
        self.first = np.searchsorted(self.token, np.arange(len(order) + 2))
        bags = [np.unique(_bags(r.variants), axis=0) for r in rows]
        self.bags = np.concatenate(bags) if bags else np.zeros((0, len(_LETTERS)), np.int8)
        self.n_bags = np.array([len(x) for x in bags], np.int64)
        self.bag_at = np.cumsum(self.n_bags) - self.n_bags
        self.limit = np.array([most_cost(r.core, edits, most_edits) for r in rows])

    def match(self, values: list[list[int]], strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, entry, Jaccard) of the pairs at the threshold whose letters allow the check to pass."""
        unknown = len(self.order)
        grams_ = [sorted((self.order.get(t, -1) for t in g)) for g in values]
        n = np.array([len(g) for g in grams_])
        token = np.concatenate([np.array(g, np.int64) for g in grams_]) if len(n) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        known = (token >= 0) & (pos < prefix_size(n, self.threshold)[owner])
        t, v, p = token[known], owner[known], pos[known]
        lens = self.first[t + 1] - self.first[t]
        again = np.repeat(np.arange(len(t)), lens)
        at = np.arange(len(again)) - np.repeat(np.cumsum(lens) - lens, lens) + self.first[t][again]
        v, p, e, q = v[again], p[again], self.owner[at], self.pos[at]
        # length and place: what is left from the shared token on must suffice
        a, b = n[v], self.size[e]
        need = np.ceil(self.threshold / (1 + self.threshold) * (a + b) - 1e-9)
        fits = (b >= self.threshold * a) & (a >= self.threshold * b) & (np.minimum(a - p, b - q) >= need)
        pairs = np.zeros((len(n), len(self.eids)), bool)
        pairs[v[fits], e[fits]] = True
        v, e = np.nonzero(pairs)
        # Jaccard of the pairs, exactly
        lens = n[v]
        again = np.repeat(np.arange(len(v)), lens)
        at = np.arange(len(again)) - np.repeat(np.cumsum(lens) - lens, lens) + (np.cumsum(n) - n)[v][again]
        tok = np.where(token[at] >= 0, token[at], unknown)
        shared = np.add.reduceat(self.presence[e[again], tok], np.cumsum(lens) - lens, dtype=np.int64) if len(v) else np.zeros(0, np.int64)
        jaccard = shared / np.maximum(n[v] + self.size[e] - shared, 1)
        ok = jaccard >= self.threshold
        v, e, jaccard = v[ok], e[ok], jaccard[ok]
        # an alignment costs at least the difference of the letter bags
        lens = self.n_bags[e]
        again = np.repeat(np.arange(len(v)), lens)
        at = np.arange(len(again)) - np.repeat(np.cumsum(lens) - lens, lens) + self.bag_at[e][again]
        diff = _bags(strings)[v][again] - self.bags[at]
        differ = np.maximum(np.maximum(diff, 0).sum(1, dtype=np.int32), np.maximum(-diff, 0).sum(1, dtype=np.int32))
        near = np.zeros(len(v), bool)
        near[again[differ <= self.limit[e][again]]] = True
        return v[near], e[near], jaccard[near]


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of a set's rarest tokens a set at the threshold must share one of."""
    return n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1


def most_cost(core: float, edits: float, most_edits: float) -> float:
    """The cost up to which an alignment with a name of `core` letters passes."""
    return max(1.0, min(most_edits, core * edits))


def candidates_by_blocks(values: DataFrame, entries: DataFrame, df: DataFrame, threshold: float, edits: float, most_edits: float, block: int = 250) -> DataFrame:
    """(kind, vid, eid, jaccard): the same join for entry lists of at most ENTRY_ROWS names, which are broadcast with
    their postings; blocks of values (kind, vid, g, s) go through them. Pairs whose letters alone cost more than the
    check allows are left out."""
    order: dict[str, dict[int, int]] = {}
    for r in df.orderBy("kind", F.col("edf") + F.col("vdf"), "t").toLocalIterator():
        mine = order.setdefault(r.kind, {})
        mine[r.t] = len(mine)
    rows: dict[str, list] = {}
    for r in entries.select("kind", "eid", "g", "variants", "core").collect():  # at most ENTRY_ROWS
        rows.setdefault(r.kind, []).append(r)
    index = values.sparkSession.sparkContext.broadcast({k: _Entries(x, order.get(k, {}), threshold, edits, most_edits) for k, x in rows.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(0).to_pylist()
            for kind in sorted(set(kinds) & set(index.value)):
                known = index.value[kind]
                mine = pa.array([k == kind for k in kinds])
                vid, g, s = (b.column(c).filter(mine) for c in (1, 2, 3))
                for at in range(0, len(vid), block):
                    v, e, j = known.match(g.slice(at, block).to_pylist(), s.slice(at, block).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(v), pa.string()), vid.slice(at, block).take(pa.array(v)), pa.array(known.eids[e]), pa.array(j)], names=["kind", "vid", "eid", "jaccard"])

    return values.select("kind", "vid", "g", "s").mapInArrow(run, "kind string, vid bigint, eid bigint, jaccard double")


def candidates(values: DataFrame, entries: DataFrame, threshold: float = 0.3, edits: float = 0.3, most_edits: float = 2.0, most_entries: int = ENTRY_ROWS) -> DataFrame:
    """(kind, vid, eid, jaccard): pairs of values and entries at the threshold, by the way the list's length allows."""
    df = _frequencies(values, entries)
    if entries.count() <= most_entries:
        return candidates_by_blocks(values, entries, df, threshold, edits, most_edits)
    return candidates_by_join(values, entries, df, threshold)


def match_values(values: DataFrame, icd: DataFrame, rx: DataFrame, threshold: float = 0.3, edits: float = 0.3, most_edits: float = 2.0, most_entries: int = ENTRY_ROWS) -> DataFrame:
    """(kind, value, code, name, jaccard, cost): the entry of each distinct (kind, value), code 'none' if no
    entry passes. `edits` is the share of the name's letters that
    may differ, `most_edits` their number."""
    entries = diagnosis_entries(icd).unionByName(drug_entries(rx))
    entries = entries.groupBy("kind", "name").agg(F.min("code").alias("code"), F.min("core").alias("core"), F.array_distinct(F.flatten(F.collect_set("variants"))).alias("variants"), F.min("strength").alias("strength"))
    entries = cut(entries.withColumn("eid", F.xxhash64("kind", "name")).withColumn("g", grams(F.col("name"))))
    heads = head_initials(diagnosis_entries(icd))
    distinct = values.select("kind", "value").distinct()
    # small in bytes but not in work: an explicit number of partitions, which is not coalesced
    sc = values.sparkSession.sparkContext
    n = max(4 * sc.defaultParallelism, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = lambda c: F.explode_outer(F.array(c))  # noqa: E731 (a generator: the expression is not copied into filters)
    folded = distinct.repartition(n, "kind", "value").select("kind", "value", once(fold(F.col("value"))).alias("f"))
    clean = F.when(F.col("kind") == DIAGNOSIS, clean_diagnosis(F.col("f"), heads)).otherwise(_spell(clean_drug(F.col("f"))))
    cleaned = cut(folded.select("kind", "value", once(clean).alias("c")).withColumn("vid", F.xxhash64("kind", "c")))
    forms = cleaned.groupBy("kind", "vid").agg(F.min("c").alias("c")).repartition(n, "kind", "vid").select("*", once(grams(F.col("c"))).alias("g")).where(F.size("g") > 0)
    strength, rest = _split_strength(F.col("c"))
    drug = F.col("kind") == DRUG
    forms = forms.withColumn("strength", F.when(drug, strength).otherwise("")).withColumn("s", F.when(drug, rest).otherwise(F.replace(F.col("c"), F.lit(" "), F.lit(""))))
    forms = cut(forms)
    found = candidates(forms, entries, threshold, edits, most_edits, most_entries)
    known = broadcast_if_small(entries.select("kind", "eid", "code", "name", "core", "variants", F.col("strength").alias("es")), ENTRY_ROWS)
    checked = found.join(forms.select("kind", "vid", "s", "strength"), ["kind", "vid"]).join(known, ["kind", "eid"]).where(F.col("strength") == F.col("es"))
    near = F.filter("variants", lambda v: F.abs(F.length(v) - F.length("s")) <= 2 * most_edits)
    priced = checked.select("kind", "vid", "code", "name", "jaccard", "core", "s", F.explode_outer(near).alias("v"))
    priced = priced.select("*", once(F.levenshtein("s", "v", int(4 * most_edits))).alias("lev")).where((F.col("lev") >= 0) & (F.col("lev") <= F.col("core")))
    # half the edits that swap letters or words count: Levenshtein and the bag distance are averaged
    # the bag distance is the larger of what either side has more: (sum of |d| + |sum of d|) / 2
    d = F.zip_with(_letters(F.col("s")), _letters(F.col("v")), lambda a, b: a - b)
    sums = F.aggregate(d, F.struct(F.lit(0).alias("a"), F.lit(0).alias("n")), lambda acc, x: F.struct((acc["a"] + F.abs(x)).alias("a"), (acc["n"] + x).alias("n")))
    cost = F.transform(F.array(sums), lambda x: (F.col("lev") + (x["a"] + F.abs(x["n"])) / 2) / 2.0)
    priced = priced.select("*", F.explode_outer(cost).alias("cost")).where(F.col("cost") <= F.greatest(F.lit(1.0), F.least(F.lit(most_edits), F.col("core") * edits)))
    choice = priced.groupBy("kind", "vid").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "cost", "code", "name")).alias("m"))
    out = cleaned.select("kind", "value", "vid").join(choice, ["kind", "vid"], "left")
    return out.select("kind", "value", F.coalesce(F.col("m.code"), F.lit(NONE)).alias("code"), F.col("m.name").alias("name"), (-F.col("m.j")).alias("jaccard"), F.col("m.cost").alias("cost"))


def typed_values(out_docs: DataFrame, labelled: bool = False) -> DataFrame:
    """(out_id, concept_no, kind, value): diagnoses and drugs without candidates (with, if `labelled`), rows
    delivered twice once."""
    c = out_docs.select("out_id", F.posexplode("concepts").alias("concept_no", "c")).where(F.col("c.type").isin(DIAGNOSIS, DRUG) & F.col("c.text").rlike(r"(?U)\S"))
    has = F.coalesce(F.size(F.col("c.candidates")) > 0, F.lit(False))
    c = c.where(has if labelled else ~has)
    cols = ["out_id", "concept_no", F.col("c.type").alias("kind"), F.col("c.text").alias("value")] + ([F.col("c.candidates").alias("candidates")] if labelled else [])
    return c.select(*cols).distinct()


def link_typed(out_docs: DataFrame, icd: DataFrame, rx: DataFrame) -> DataFrame:
    """(out_id, concept_no, code, name, jaccard, cost) of every typed diagnosis and drug without candidates."""
    rows = typed_values(out_docs)
    return rows.join(match_values(rows, icd, rx), ["kind", "value"])
