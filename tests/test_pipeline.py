"""Scans, extraction, linking and span operators against brute force and literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from notewright import session
from notewright.functions import tables as T
from notewright.functions import text as X
from notewright.operators import extract, kb, linking, spans


def test_scan_of_long_texts(spark):
    text = "ab c " * 30_000
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "   ")], "k int, t string")
    got = spans.scan(df, "k", "t", r"[^ ]+").agg(F.count("*").alias("n"), F.max("end").alias("e"), F.count_if(F.substring(F.lit("ab c "), F.pmod("start", F.lit(5)) + 1, F.length("match")) == F.col("match")).alias("ok")).first()
    assert (got.n, got.e, got.ok) == (60_000, len(text) - 1, 60_000)


def test_dictionary_against_a_pattern(spark):
    """Names of several words, with hyphens and figures, against one pattern of all names, the longest first."""
    rng = random.Random(3)
    names = ["vitamin", "vitamin c", "vitamin c zinc", "5-fluor", "fluor acid", "acid b-12", "b-12 complex", "abcde", "abcde fghij", "fghij klmno", "aspirin+codein", "short", "tiny"]
    bits = ["vitamin", "C", "c", "zinc", "5-fluor", "25-fluor", "acid", "b-12", "B-12", "complex", "abcde", "fghij", "klmno", "xabcde", "abcdef", "aspirin+codein", "éabcde", "abcde1", ".", ",", "tiny"]
    texts = ["".join(x + rng.choice([" ", "  ", "", "-"]) for x in rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)] + [None, ""]
    big = sorted((n for n in names if len(n) >= 5), key=lambda n: (-len(n), n))
    rx = re.compile("(?<![a-z])(" + "|".join(map(re.escape, big)) + ")(?![a-z])", re.I)
    want = sorted((i, m.start(), m.end(), m.group().lower()) for i, t in enumerate(texts) if t for m in rx.finditer(t))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("name", F.lit("clash"))
    dic = spark.createDataFrame([(n,) for n in names + ["vitamin"]], "name string")
    got = sorted(tuple(r) for r in spans.dictionary_spans(df, dic, "k", "t").collect())
    assert got == want and len({w for *_, w in want}) >= 8
    assert spans.dictionary_spans(df, dic.limit(0), "k", "t").count() == 0 and spans.dictionary_spans(df.limit(0), dic, "k", "t").count() == 0
    dosed = spark.createDataFrame([(1, "Vitamin C 25mg po bid, vitamin c 3")], "k int, t string")
    assert sorted((r.start, r.end) for r in spans.dictionary_spans(dosed, dic, "k", "t", dose=spans.DOSE).collect()) == [(0, 21), (23, 32)]


def test_knowledge_base_orders(spark):
    rows = [("1", "In", "in name", "IN"), ("1", "Scd", "scd name", "SCD"), ("1", "Sy", "sy name", "SY"), ("2", "P", "pin name", "PIN"), ("2", "I", "in other", "IN"), ("3", "Glucose", "glucose", "IN"), ("3", "M", "min name", "MIN"), ("4", "?", "odd", "XX"), ("5", "w", "a b c d e f g", "BN")]
    rx = spark.createDataFrame(rows, "rxcui string, str string, key string, tty string")
    assert {r.rxcui: r.name for r in kb.preferred(rx).collect()} == {"1": "Scd", "2": "I", "3": "M", "4": "?", "5": "w"}
    assert [r.name for r in kb.dictionary(rx).collect()] == ["in other", "min name", "pin name", "in name"]
    codes = spark.createDataFrame([("1",), ("9",), (None,)], "code string")
    assert sorted((r.code or "", r.name) for r in kb.with_names(codes, kb.preferred(rx).withColumnRenamed("rxcui", "code")).collect()) == [("", ""), ("1", "Scd"), ("9", "")]
    icd = spark.createDataFrame([("A00", "x", None, None, "x")], "code string, en string, vn string, key_vn string, key_en string")
    assert set(kb.indexes(icd, rx)) == {"icd_entries", "icd_exact", "icd_children", "rx_exact", "rx_relaxed", "rx_preferred", "dictionary", "names"}
    assert [(r.code, r.name) for r in kb.icd_names(icd).collect()] == [("A00", "x")]


def _score(key, ekey):
    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))} if s else set()
    g, h, t, u = grams(key.replace(" ", "")), grams(ekey.replace(" ", "")), set(key.split()), set(ekey.split())
    sub = 1.0 if ekey.startswith(key) else 0.7 if key in ekey else 0.0
    return 0.40 * len(g & h) / len(g | h) + 0.22 * 2 * len(t & u) / (len(t) + len(u)) + 0.18 * (t <= u) + 0.12 * sub + 0.08 * len(t & u) / len(t)


def test_similarity_join_is_whole(spark):
    """All pairs at the threshold come out, though only a mention's rarest words are looked up."""
    rng = random.Random(4)
    words = ["viem", "benh", "suy", "gan", "than", "phoi", "man", "tinh", "cap", "ho", "a", "viemphoi", "ganh"]
    make = lambda n: sorted({" ".join(rng.choices(words, k=rng.choice([1, 2, 2, 3, 3, 3, 4, 5, 7]))) for _ in range(n)})
    mentions, names = make(300), make(300) + ["aspirin sodium 5 mg"]
    m, e = (spark.createDataFrame([(x,) for x in c], "key string") for c in (mentions + mentions[:5] + ["", "aspirin 5 mg"], names + names[:5]))
    for threshold in (0.62, 0.75):
        want = {(a, b) for a in mentions for b in names if round(_score(a, b), 6) >= threshold}
        got = linking.similar(m, e, threshold).collect()
        assert {(r.key, r.ekey) for r in got if r.key != "aspirin 5 mg"} == want and len(want) > 50
        assert all(abs(r.score - _score(r.key, r.ekey)) < 1e-6 for r in got)
    with_salts = {(r.key, r.ekey): r.score for r in linking.similar(m, e, 0.6, salts=True).where("key = 'aspirin 5 mg'").collect()}
    assert abs(with_salts["aspirin 5 mg", "aspirin sodium 5 mg"] - 0.15 - _score("aspirin 5 mg", "aspirin sodium 5 mg")) < 1e-6
    with pytest.raises(ValueError):
        linking.similar(m, e, 0.5)
    assert linking.similar(m.limit(0), e, 0.6).count() == 0 and linking.similar(m, e.limit(0), 0.6).count() == 0


def test_extraction_order(spark):
    """A phrase that holds a drug or a lab value vanishes; headings are no symptoms; a lead is cut off by words."""
    text = "Tiền sử bệnh; uống capsaicin sau ăn; đau đầu\nchẩn đoán  viêm  phổi; EF 30%; mất việc, dị ứng: phấn hoa"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    names = spark.createDataFrame([("capsaicin",)], "name string")
    got = [(text[r.start : r.end], r.kind) for r in extract.extract(df, names, "k", "t").orderBy("start").collect()]
    # the lead's rest is as long as with single blanks, so double blanks cut it short
    assert got == [("capsaicin", T.DRUG), ("đau đầu", T.SYMPTOM), ("viêm  phổ", T.DIAGNOSIS), ("EF", T.TEST_NAME), ("30%", T.TEST_VALUE), ("phấn hoa", T.SYMPTOM)]


def test_pipeline(spark):
    text = "1. Tiền sử bệnh lý\nViêm phổi; không ho\n2. Hiện tại\nBố bị hen suyễn, dùng betalol 5mg. WBC: 12,5"
    df = spark.createDataFrame([(7, text), (8, None), (9, " ")], "k int, t string")
    names = spark.createDataFrame([("betalol",)], "name string")
    icd = spark.createDataFrame([("J18", "viem phoi", None), ("J18.0", "viem phoi thuy", None), ("J18.9", "viem phoi khac", None)], "code string, key_vn string, key_en string")
    rx = spark.createDataFrame([("1", "betalol 5 mg", "SCDC"), ("2", "betalol", "IN")], "rxcui string, key string, tty string")
    got = {r.surface: (r.kind, list(r.assertions), list(r.candidates)) for r in extract.concepts(df, names, icd, rx, "k", "t").collect()}
    assert got["Viêm phổi"] == (T.DIAGNOSIS, ["isHistorical"], ["J18.0", "J18.9"])
    assert got["không ho"][0] == T.SYMPTOM and got["WBC"] == (T.TEST_NAME, [], []) and got["12,5"] == (T.TEST_VALUE, [], [])
    assert got["betalol 5mg"][0] == T.DRUG and got["betalol 5mg"][2] == ["1"]
    assert "isFamily" in got["Bố bị hen suyễn"][1] and got["Bố bị hen suyễn"][2] == []
    assert extract.concepts(df.limit(0), names, icd, rx, "k", "t").count() == 0


def test_alignment_against_pairs(spark):
    rng = random.Random(5)
    toks, sp, want = [], [], {}
    for k in range(60):
        at, mine = 0, []
        for no in range(rng.randint(0, 12)):
            a = at + rng.randint(0, 2)
            at = a + rng.randint(1, 4)
            mine.append((no, a, at))
        toks += [(k, *t) for t in mine]
        these = [(no, a, a + rng.randint(0, 9), rng.choice("XY")) for no, a in enumerate(rng.choices(range(30), k=rng.randint(0, 5)))]
        sp += [(k, *s) for s in these]
        for no, a, b in mine:
            want[k, no] = "O"
        for _, s, e, kind in these:
            hit = [no for no, a, b in mine if s < e and a < e and s < b]
            for i, no in enumerate(hit):
                want[k, no] = ("I-" if i else "B-") + kind
    t = spark.createDataFrame(toks, "k int, no int, start int, end int")
    s = spark.createDataFrame(sp, "k int, span_no int, start int, end int, kind string")
    assert {(r.k, r.no): r.label for r in spans.align(t, s, "k").collect()} == want
    assert spans.align(t, s.limit(0), "k").where("label <> 'O'").count() == 0 and spans.align(t.limit(0), s, "k").count() == 0


def test_votes_carry_labels(spark):
    rows = [(1, "a", 1.0, 0, 5, "D", 0.9, ["isNegated", None, "x"], ["C1", "C2"]), (1, "b", 1.0, 1, 5, "D", 0.5, ["isFamily", "isNegated", "y"], ["C2", "C3"]), (1, "c", 1.0, 2, 4, "S", 0.3, ["no"], ["no"]), (2, "a", 1.0, 0, 1, "S", 0.5, None, None)]
    df = spark.createDataFrame(rows, "k int, model string, weight double, start int, end int, kind string, score double, assertions array<string>, candidates array<string>")
    got = {r.k: r for r in spans.ensemble(df, "k").collect()}
    assert got[1].assertions == ["isNegated", "x", "isFamily"] and got[1].candidates == ["C1", "C2", "C3"] and got[1].n_models == 3
    assert got[2].assertions == [] and got[2].candidates == []


def test_greedy_by_start_and_windows(spark):
    rows = [(1, 0, 5, "a"), (1, 3, 8, "b"), (1, 5, 6, "c"), (1, 6, 9, "d")]
    df = spark.createDataFrame(rows, "k int, start int, end int, kind string")
    assert sorted(r.kind for r in spans.greedy_by_start(df, "k").collect()) == ["a", "c", "d"]
    d = spark.createDataFrame([("Đau  đầu\tnhiều ",)], "t string")
    r = d.select(spans.left_window(F.col("t"), F.lit(8), 5).alias("w"), X.clean_blanks(F.col("t")).alias("c")).first()
    assert (r.w, r.c) == ("  dau", "Đau đầu nhiều")


def test_latest(spark):
    rows = [(1, 5, "old"), (1, 7, "new"), (2, None, "x"), (2, 1, "y"), (3, 1, "same"), (3, 1, "same"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k int, at int, v string")
    assert sorted(((r.k or 0), r.v) for r in session.latest(df, "k", "at", "v").collect()) == [(0, "n"), (1, "new"), (2, "y"), (3, "same")]
    assert session.latest(df.limit(0), "k", "at").count() == 0
