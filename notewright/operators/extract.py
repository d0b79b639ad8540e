"""The rule extractor: drugs, lab pairs and clinical phrases of a note, resolved greedily, as one pipeline.

Candidate spans come from column expressions (`spans.scan`, `spans.dictionary_spans`) and are folded per note
by `spans.greedy` in the order drugs, labs, phrases. Rules are parameters; fixed values stand in this module.
Null and empty notes give no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..session import cut, spread
from . import linking, spans

# Units of lab values, and a name followed by ':' or '=' and a number.
LAB_UNITS = ("mg/dl", "mmol/l", "g/dl", "g/l", "u/l", "iu/l", "ng/ml", "pg/ml", "µmol/l", "umol/l", "mmhg", "lần/phút", "l/ph", "/µl", "/ul", r"10\^\d", "%", "bpm", "mm", "cm", "ml", "kg", "°c", "mcg", "mg")
#: Letters of a name, both cases, so that the pattern needs no folding, which is slow; the last three fold into them.
_LETTERS = "A-Za-zÀ-ỹµ\u212a\u212b"
_NAME = rf"[{_LETTERS}][{_LETTERS}0-9%()/{T.WS}.\-]{{0,40}}?"
_VALUE = rf"[<>]?[{T.WS}]*[0-9]+(?:[.,][0-9]+)?[{T.WS}]*(?iu:" + "|".join(LAB_UNITS).replace(r"\d", "[0-9]") + ")?"
LAB_COLON = rf"{_NAME}[{T.WS}]*[:=][{T.WS}]*{_VALUE}"
LAB_COLON_PARTS = rf"^({_NAME})([{T.WS}]*[:=][{T.WS}]*)({_VALUE})"
#: A number with its unit.
NUMBER_UNIT = rf"(?iu)\b[0-9]+(?:[.,][0-9]+)?[{T.WS}]*(?:" + "|".join(LAB_UNITS).replace(r"\d", "[0-9]") + r")\b"

# Parts of a key that make a phrase a diagnosis, phrases that are none, and what leads to one.
DIAGNOSIS_PARTS = (
    "benh ", "viem", "suy tim", "suy than", "suy gan", "suy ho hap", "ung thu", "nhoi mau", "xo gan", "xo vua", "xo hoa", "hoi chung", "roi loan", "tang huyet ap", "dai thao duong", "gay xuong",
    "gay co", "khoi u", "u ac", "u tuyen", "u lanh", "thieu mau", "nhiem trung", "nhiem khuan", "loet", "hep ", "phinh ", "trao nguoc", "soi than", "soi mat", "lao phoi", "hen suyen",
    "hen phe quan", "dot quy", "tai bien", "rung nhi", "block", "ngoai tam thu", "nhip nhanh", "nhip cham", "tran dich", "tran khi", "co that", "viem phoi", "copd",
)
NO_CONCEPT = ("n/a", "na", "khong", "binh thuong", "on dinh", "khong ro", "khong xac dinh", "khong co gi dang chu y", "khong ghi nhan gi bat thuong")
NOT_CLINICAL = r"mat viec|ca phe|caffeine|cong viec|xe cuu thuong|cuu thuong|the chien|dong ho|gio |phut\b"
PATIENT = r"benh nhan (nam|nu)|([0-9]+ tuoi)|bi benh [0-9]+|vao vien|nhap vien vi|ly do (vao|nhap)|theo loi|dia chi|so dien thoai|ho ten"
LEAD = r"^(?:duoc |da |di |dang )?(?:chan doan (?:mac|xac dinh|la)?|xac dinh|ket luan|nghi ngo|theo doi|tinh trang|phat hien(?: co)?|mac |bi ) *"


def lab_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, kind) of test names and values that ':' or '=' joins, then of named tests before a
    number."""
    m = spans.scan(df, key, text, LAB_COLON)
    part = lambda i: F.regexp_extract("match", LAB_COLON_PARTS, i)
    name = F.regexp_replace(part(1), r"[ \-\t]+$", "")
    name_key = X.norm_key(name)
    keep = (F.length(name_key) >= 2) & ~name_key.isin(*NO_CONCEPT) & (F.length(name) <= 45)
    value = X.strip(part(3))
    at = F.col("start") + F.length(part(1)) + F.length(part(2)) + F.length(part(3)) - F.length(F.regexp_replace(part(3), f"^[{T.WS}]+", ""))
    pair = F.array(
        F.struct(F.col("start").alias("start"), (F.col("start") + F.length(name)).alias("end"), F.lit(T.TEST_NAME).alias("kind")),
        F.struct(at.cast("int").alias("start"), (at + F.length(value)).cast("int").alias("end"), F.lit(T.TEST_VALUE).alias("kind")),
    )
    colon = spans.listed(m.where(keep), pair, key).withColumn("form", F.lit(0))
    n = spans.scan(df, key, text, spans.LAB_NAMED)
    word = F.regexp_extract("match", r"(?i)^(?:" + "|".join(spans.LAB_NAMES) + ")", 0)
    number = F.regexp_extract("match", r"[0-9]+(?:[.,][0-9]+)?\s*%?$", 0)
    pair = F.array(
        F.struct(F.col("start").alias("start"), (F.col("start") + F.length(word)).alias("end"), F.lit(T.TEST_NAME).alias("kind")),
        F.struct((F.col("end") - F.length(number)).alias("start"), (F.col("end") - F.length(number) + F.length(X.strip(number))).alias("end"), F.lit(T.TEST_VALUE).alias("kind")),
    )
    return colon.unionByName(spans.listed(n, pair, key).withColumn("form", F.lit(1)))


def phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, phrase): pieces between line ends, ';', ',' and sentence ends, without bullets, a short
    label before ':' and end marks. A dot inside a word drops what stands before it in its piece."""
    piece = spans.scan(df, key, text, r"[^\n;,]+")
    ends = F.split("match", rf"(?<=\.)(?=[{T.WS}])")
    p = piece.select(key, F.col("start").alias("base"), F.posexplode(ends).alias("i", "seg"), ends.alias("all"))
    before = F.aggregate(F.slice("all", 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
    inner = F.regexp_extract("seg", r"([^.]*\.?)\z", 1)
    p = p.withColumn("base", (F.col("base") + before + F.length("seg") - F.length(inner)).cast("int")).withColumn("seg", inner)
    lead = F.length(F.regexp_extract("seg", rf"^[{T.WS}\-*•0-9.)]+", 0))
    colon = F.instr("seg", ":") - 1
    after = colon + 1 + F.length(F.regexp_extract(F.expr("substring(seg, instr(seg, ':') + 1)"), f"^[{T.WS}]+", 0))
    off = F.when((colon >= 0) & (colon < 30) & (colon + 1 < F.length("seg")), after).otherwise(lead)
    p = p.withColumn("off", off)
    raw = F.regexp_replace(F.expr("substring(seg, off + 1)"), rf"[.,;:{T.WS}\-]+$", "")
    p = p.select("*", F.explode_outer(F.array(raw)).alias("phrase")).where(F.length("phrase") > 0)
    return p.select(key, (F.col("base") + F.col("off")).cast("int").alias("start"), (F.col("base") + F.col("off") + F.length("phrase")).cast("int").alias("end"), "phrase")


def classify(df: DataFrame, headers: tuple[str, ...] = T.HEADINGS) -> DataFrame:
    """`df` (..., phrase) with `kind` and `n_lead`, the words that lead to the name; phrases that are no concepts
    are left out."""
    lead = F.regexp_extract(X.norm_key(F.col("phrase")), LEAD, 0)
    words = F.filter(F.split("phrase", f"[{T.WS}]+"), lambda w: w != "")
    n_lead = F.size(F.filter(F.split(lead, " "), lambda w: w != ""))
    d = df.withColumn("__w", words).withColumn("n_lead", n_lead)
    led = (F.col("n_lead") > 0) & (F.col("n_lead") < F.size("__w"))
    name = F.when(led, F.array_join(F.slice("__w", F.col("n_lead") + 1, F.size("__w")), " ")).otherwise(F.col("phrase"))

    def kind(k: Column) -> Column:
        drop = k.isin(*NO_CONCEPT, *headers) | (F.length(k) < 3) | (F.length(k) > 60) | k.rlike(PATIENT) | k.rlike(NOT_CLINICAL)
        return F.when(drop, None).when((F.col("n_lead") > 0) | k.rlike("|".join(DIAGNOSIS_PARTS)), T.DIAGNOSIS).when(F.size(F.split(k, " ")) <= 8, T.SYMPTOM)

    # a generator between the expression and the filter, so that it is computed once
    kinds = d.select(*df.columns, "n_lead", "__w", F.explode_outer(F.transform(F.array(X.norm_key(name)), kind)).alias("kind"))
    return kinds.where("kind IS NOT NULL")


def _folded(spans_: DataFrame, key: str) -> DataFrame:
    """(key, spans): per note the spans that meet no kept one, neither with their whole range (a, b) nor with what
    is left of it (start, end), by (prio, seq); in order of start."""
    per = spread(spans_.where("end > start"), key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("prio", "seq", "start", "end", "kind", "a", "b"))).alias("all"))

    def step(kept, x):
        clash = F.exists(kept, lambda k: ((k["start"] < x["end"]) & (x["start"] < k["end"])) | ((k["start"] < x["b"]) & (x["a"] < k["end"])))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return per.select(key, F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias("spans"))


def extracted(df: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, spans): the concepts (start, end, kind) of each note that has any, stronger ones first where they
    overlap: drugs, then lab pairs, then phrases. A phrase that meets a drug or a lab value anywhere is dropped,
    even if what is left without its lead does not."""
    cols = [key, "start", "end", "kind", "prio", "seq"]
    drugs = spans.dictionary_spans(df, names, key, text, dose=spans.DOSE).select(key, "start", "end", F.lit(T.DRUG).alias("kind"), F.lit(0).alias("prio"), F.col("start").cast("bigint").alias("seq"))
    labs = lab_pairs(df, key, text).select(key, "start", "end", "kind", F.lit(1).alias("prio"), (F.col("form") * (1 << 32) + F.col("start")).alias("seq"))
    strong = drugs.unionByName(labs).select(*cols, F.col("start").alias("a"), F.col("end").alias("b"))
    ph, words = classify(phrases(df, key, text)), F.col("__w")
    led = (F.col("n_lead") > 0) & (F.col("n_lead") < F.size(words))
    # the lead is cut off by its number of words: from the next word on, as long as the rest with single blanks
    off = F.when(led, F.expr("instr(phrase, next)") - 1).otherwise(0)
    size = F.when(led, F.length(F.array_join(F.slice(words, F.col("n_lead") + 1, F.size(words)), " "))).otherwise(F.length("phrase"))
    ph = ph.withColumn("next", F.get(words, F.col("n_lead"))).withColumn("s", (F.col("start") + off).cast("int")).withColumn("e", (F.col("s") + size).cast("int"))
    weak = ph.select(key, F.col("s").alias("start"), F.col("e").alias("end"), "kind", F.lit(2).alias("prio"), F.col("start").cast("bigint").alias("seq"), F.col("start").alias("a"), F.col("end").alias("b"))
    return _folded(strong.unionByName(weak), key)


def extract(df: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, kind) of `extracted`, one row each."""
    return spans.listed(extracted(df, names, key, text), "spans", key)


_BEFORE, _AFTER = max(T.NEGATION_WINDOW, T.FAMILY_WINDOW, T.PAST_WINDOW), T.PAST_AFTER


def described(found: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, surface, kind, assertions) of notes' spans (key, spans): context flags by the words around
    a span and by the section it stands in. A span takes along its surroundings, not the note."""
    placed = spans.matches(found.join(df.select(key, text), key), text, spans.SECTION, "sec")

    def around(x):
        at = F.greatest(x["start"] - _BEFORE, F.lit(0))
        last = F.try_element_at(F.filter("sec", lambda c: c["start"] <= x["start"]), F.lit(-1))
        title = F.regexp_extract(last["match"], spans.SECTION_PARTS, 1)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.substring(F.col(text), at + 1, x["end"] - at + _AFTER).alias("near"), (x["start"] - at).alias("s"), title.alias("section"))

    one = spans.listed(placed, F.transform("spans", around), key)
    c = [F.col("near"), F.col("s"), F.col("s") + F.col("end") - F.col("start")]
    return one.select(key, "start", "end", F.substring(c[0], c[1] + 1, c[2] - c[1]).alias("surface"), "kind", spans.assertions(F.col("kind"), *c, X.strip(F.coalesce("section", F.lit("")))).alias("assertions"))


def coded(placed: DataFrame, icd: DataFrame, rx: DataFrame, topk: int = 3) -> DataFrame:
    """`placed` (..., surface, kind) with `candidates`: the codes of diagnoses and drugs. Each distinct key is
    linked once; every code exists in the knowledge base."""
    placed = cut(placed.withColumn("mkey", X.norm_key(F.col("surface"))))  # read three times below
    keys = lambda kind: placed.where(F.col("kind") == kind).select(F.col("mkey").alias("key"))
    dx = linking.cascade_icd(keys(T.DIAGNOSIS), icd, topk).withColumn("kind", F.lit(T.DIAGNOSIS))
    dr = linking.cascade_rx(keys(T.DRUG), rx, topk).withColumn("kind", F.lit(T.DRUG))
    codes = dx.unionByName(dr).where(F.size("codes") > 0).select(F.col("key").alias("mkey"), "kind", F.col("codes").alias("candidates"))
    out = placed.join(codes, ["mkey", "kind"], "left").drop("mkey")
    return out.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def concepts(df: DataFrame, names: DataFrame, icd: DataFrame, rx: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, surface, kind, assertions, candidates): the whole pipeline over notes, whose keys are
    unique. Null and empty notes give no rows."""
    return coded(described(extracted(df, names, key, text), df, key, text), icd, rx)


def predicted(found: DataFrame, df: DataFrame, icd: DataFrame, rx: DataFrame, key: str, text: str) -> DataFrame:
    """`found` (key, start, end, kind, assertions, ...) of a token model, or of the vote of several, as concepts: with
    `surface` and `candidates`, labels only for types that bear them."""
    bounds = found.groupBy(key).agg(F.collect_list(F.struct(*(c for c in found.columns if c != key))).alias("__s")).join(df.select(key, text), key)  # a text goes along once
    cut_ = F.transform("__s", lambda s: s.withField("surface", F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])))
    placed = spans.listed(bounds, cut_, key)
    none = F.array().cast("array<string>")
    return coded(placed.withColumn("assertions", F.when(F.col("kind").isin(*T.ASSERTED_TYPES), F.coalesce("assertions", none)).otherwise(none)), icd, rx)
