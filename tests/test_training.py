"""Training rows, augmentation, batches, search, readers: literal cases, invariants, brute force."""

import itertools
import json
import math
import zipfile

import numpy as np
from pyspark.sql import functions as F

from notewright.functions import tables as T
from notewright.operators import chain, prep, semantic, training
from notewright.sources import files

SPAN = "array<struct<start:int,end:int,text:string,fine:string,coarse:string,assertions:array<string>,candidates:array<string>>>"


def notes(spark):
    text = "ho đờm xanh, dùng aspirin"
    rows = [
        (1, "s", text, [(0, 11, "ho đờm xanh", T.SYMPTOM, "PROBLEM", ["isNegated"], None), None, (18, 25, "aspirin", T.DRUG, "TREATMENT", [], ["1191"])]),
        (2, None, "", None), (3, "s", None, []), (4, "s", "a b", [(0, 1, "a", None, None, None, [None])]),
    ]
    return spark.createDataFrame(rows, f"k int, source string, text string, spans {SPAN}")


def exploded(df):
    return df.select("k", "text", F.posexplode("spans").alias("span_no", "s")).where("s IS NOT NULL").select("k", "text", "span_no", "s.start", "s.end", F.col("s.text").alias("surface"), "s.fine", "s.coarse", "s.assertions", "s.candidates")


def test_token_rows(spark):
    df = notes(spark)
    rows = training.token_rows(df.select("k", "text"), exploded(df), "k", "text")
    fine = training.bio_labels(T.TYPES)
    assert len(fine) == 11 and len(training.bio_labels(T.COARSE)) == 9 and fine[0] == "O" and fine[2] == f"I-{T.TYPES[0]}"
    got = {r.k: r for r in training.assembled(rows, "k").collect()}
    b, i, d = fine.index(f"B-{T.SYMPTOM}"), fine.index(f"I-{T.SYMPTOM}"), fine.index(f"B-{T.DRUG}")
    assert got[1].fine == [-100, b, i, i, 0, d, -100] and got[1].mask == [0, 1, 1, 1, 0, 1, 0]
    assert got[1].flags == [[0, 0, 0]] + [[1, 0, 0]] * 3 + [[0, 0, 0]] * 3 and got[1].starts == [0, 0, 3, 7, 13, 18, 0]
    assert got[2].fine == [-100, -100] and got[3].fine == [-100, -100] and got[4].fine == [-100, 0, 0, -100]
    short = {r.k: r for r in training.assembled(training.token_rows(df.select("k", "text"), exploded(df), "k", "text", max_len=4), "k").collect()}
    assert short[1].fine == [-100, b, i, -100]
    p = training.padded(training.assembled(rows, "k").withColumn("batch", F.lit(0)), "batch").collect()
    assert all(len(r[c]) == r.width == 7 for r in p for c in ("starts", "fine", "coarse", "flags", "mask", "attention"))
    assert {r.k: sum(r.attention) for r in p} == {1: 7, 2: 2, 3: 2, 4: 4}
    assert training.token_rows(df.limit(0).select("k", "text"), exploded(df.limit(0)), "k", "text").count() == 0


def test_scored_spans(spark):
    preds = spark.createDataFrame([(1, n, n * 2, n * 2 + 1, c, p) for n, c, p in ((0, 0.5, [0.6, 0.1, 0.5]), (1, 0.9, [0.4, 0.1, 0.4]), (2, 0.7, [0.9, 0.9, 0.9]))], "k int, no int, start int, end int, conf double, probs array<double>")
    d = spark.createDataFrame([(1, 0, 1, T.DRUG), (1, 2, 2, T.TEST_NAME)], "k int, first int, last int, kind string")
    got = {r["first"]: (r.start, r.end, r.score, r.assertions) for r in training.scored_spans(d, preds, "k").collect()}
    assert got == {0: (0, 3, 0.7, ["isNegated"]), 2: (4, 5, 0.7, [])}


def test_conversations(spark):
    df = notes(spark)
    e = prep.entity_rows(df, "k", "text", "spans").collect()
    assert [r.k for r in e] == [1] and json.loads(e[0].messages[2].content) == [{"text": "ho đờm xanh", "type": T.SYMPTOM}, {"text": "aspirin", "type": T.DRUG}]
    a = {r.span_no: r.messages for r in prep.assertion_rows(exploded(df), "k", "text").collect()}
    assert json.loads(a[0][2].content) == ["isNegated"] and json.loads(a[2][2].content) == [] and a[0][1].content.endswith('Khái niệm: "ho đờm xanh" (loại: TRIỆU_CHỨNG)')
    m = spark.createDataFrame([(1, 0, "x", T.DRUG, "X", "c" * 300, ["B", None, "D", "B"]), (1, 1, "y", T.DRUG, "Y", None, []), (2, 0, "z", T.DRUG, "Z", "", ["A"])], "k int, span_no int, mkey string, kind string, surface string, context string, gold array<string>").select("k", "span_no", "mkey", "surface", "kind", "context", "gold")
    linked = spark.createDataFrame([("x", T.DRUG, ["A", "B", "C"]), ("z", T.DRUG, [])], "mkey string, kind string, codes array<string>")
    names = spark.createDataFrame([(T.DRUG, "A", "a name")], "kind string, code string, name string")
    got = prep.choice_rows(m, linked, names, "k").collect()
    assert len(got) == 1 and sorted(got[0].candidates) == ["A", "B", "C", "D"]
    assert sorted(got[0].candidates[i] for i in json.loads(got[0].messages[2].content)) == ["B", "D"]
    user = got[0].messages[1].content
    assert f"[{got[0].candidates.index('A')}] A - a name" in user and "c" * 200 + '"' in user and "c" * 201 not in user


def test_gold_triplets(spark):
    m = spark.createDataFrame([("x", "D", "X", ["B", "C"]), ("y", "D", "Y", ["N"]), ("z", "D", "Z", None), ("w", "D", "W", [None, "A"])], "key string, kind string, surface string, gold array<string>")
    linked = spark.createDataFrame([("x", "D", ["B", "A", "C"]), ("w", "D", [])], "key string, kind string, codes array<string>")
    names = spark.createDataFrame([("D", "A", "a"), ("D", "B", "b"), ("D", "C", "c")], "kind string, code string, name string")
    assert sorted(tuple(r) for r in prep.gold_triplets(m, linked, names).fillna("-").collect()) == [("W", "a", "-"), ("X", "b", "a")]
    t = prep.triplets(names.select("code", "name"), sample=2).collect()
    assert len(t) == 2 and all(r.negative != r.positive for r in t) and prep.triplets(names.select("code", "name").limit(1)).first().negative is None


def test_augmentation(spark):
    """Texts and spans stay in step, originals stay, null and empty records pass."""
    df = notes(spark)
    names = spark.createDataFrame([(T.DRUG, "paracetamol"), (T.DRUG, "x")], "kind string, name string")
    out = prep.augmented(df, names, "k", "text", "spans", copies=30).collect()
    assert len(out) == 4 * 31 and [r.text for r in out if r.copy == 0 and r.k == 1] == ["ho đờm xanh, dùng aspirin"]
    changed = [r for r in out if r.k == 1 and r.copy]
    for r in out:
        for s in r.spans or []:
            assert s is None or r.text[s.start : s.end] == s.text
    texts = " / ".join(r.text for r in changed)
    assert "paracetamol" in texts and "dùngparacetamol" in texts + "dùngparacetamol" and "ho dom xanh" in texts and prep.LAB_TITLE in texts
    assert any(r.text.count(" ") < 4 for r in changed) and any("+lab" in r.source for r in changed)
    assert all(r.text is None for r in out if r.k == 3) and prep.augmented(df.limit(0), names, "k", "text", "spans").count() == 0
    labs = prep.added_labs(df.where("k = 2"), "k", "text", "spans", k=3).first()
    assert len(labs.spans) == 6 and all(labs.text[s.start : s.end] == s.text for s in labs.spans)


def test_batches_and_numbers(spark):
    df = spark.range(1000).withColumn("t", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50))).withColumn("index", F.lit("clash")).drop("index")
    for seed in (None, 7):
        n = prep.numbered(df, "id", seed, bucket_rows=100).orderBy("index").collect()
        assert [r["index"] for r in n] == list(range(1000)) and (seed is not None or [r.id for r in n] == list(range(1000)))
    o = prep.occurrences(df, "t", "id").groupBy("t").agg(F.sort_array(F.collect_list("nth")).alias("n")).collect()
    assert all(r.n == list(range(len(r.n))) for r in o)
    b = prep.distinct_batches(df, "t", "id", 16).groupBy("round", "batch").agg(F.count("*").alias("n"), F.count_distinct("t").alias("d")).collect()
    assert all(r.n == r.d <= 16 for r in b) and sum(r.n for r in b) == 1000
    sizes = [r["count"] for r in prep.shards(df, "id", 7).groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    assert [r["count"] for r in prep.batches(df, "id", 300).groupBy("batch").count().orderBy("batch").collect()] == [300, 300, 300, 100]
    assert prep.repeated_to(df.limit(3), "id", 8).count() == 8 and prep.repeated_to(df.limit(0), "id", 8).count() == 0
    assert prep.numbered(df.limit(0), "id").count() == 0 and prep.distinct_batches(df.limit(0), "t", "id", 4).count() == 0
    assert 0 < prep.holdout(spark.range(5000), "id").where("held").count() < 250


def test_search(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(60, 6)), 1)
    codes = [None if i % 9 == 0 else f"c{i % 5}" for i in range(60)]
    df = spark.createDataFrame([(i, x.tolist(), c) for i, (x, c) in enumerate(zip(v, codes, strict=True))] + [(99, None, "c1")], "id bigint, v array<double>, code string").repartition(3)
    got = {}
    for r in semantic.code_search(df.where("id < 4"), df, "id", "v", "code", k=3, block=7).collect():
        got[r.query, r["rank"]] = (r.code, r.id, r.score)
    for q in range(4):
        best = {}
        for i, c in enumerate(codes):
            if c is not None:
                key = (-round(float(v[i] @ v[q]), 6), i)
                best[c] = min(best.get(c, (9e9, 0)), key)
        want = sorted(best.items(), key=lambda x: x[1])[:3]
        assert [got[q, k + 1] for k in range(3)] == [(c, i, -s) for c, (s, i) in want]
    assert semantic.code_search(df.limit(0), df, "id", "v", "code").count() == 0 and semantic.code_search(df.where("id < 4"), df.limit(0), "id", "v", "code").count() == 0


def test_answers(spark):
    given = ['x [{"text":"a","type":"T"}] y', "[]", "no", '[{"text":', None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    got = df.select("i", semantic.entity_answer(F.col("v")).alias("e")).orderBy("i").collect()
    assert [[tuple(x) for x in r.e] for r in got] == [[("a", "T")], [], [], [], []]
    df = spark.createDataFrame(list(enumerate(['a ["isFamily","zz"] ["isNegated"]', '["isNegated","isFamily","isHistorical","isNegated"]', "[x", None])), "i int, v string")
    assert [list(r.a) for r in df.select("i", semantic.assertion_answer(F.col("v")).alias("a")).orderBy("i").collect()] == [["isFamily"], ["isNegated", "isFamily", "isHistorical"], [], []]


def test_enriched(spark):
    rows = [
        (1, T.DRUG, ["isNegated"], '["isFamily"]', ["A", "B"], [("C", 0.6), ("D", 0.5), ("A", 0.9)], {"A": "a"}), (2, T.DRUG, ["isNegated"], "none", [], [], {}),
        (3, T.TEST_NAME, [], '["isFamily"]', ["A", "B"], [], {}), (4, T.DIAGNOSIS, [], None, ["A"], [], {}),
    ]
    df = spark.createDataFrame(rows, "i int, kind string, assertions array<string>, said string, linked array<string>, hits array<struct<code:string,score:double>>, names map<string,string>").withColumns({"mention": F.lit("m"), "context": F.lit("c")})
    got = {r.i: (r.assertions, r.candidates) for r in semantic.enriched(df, lambda p: F.lit("[2, 0, 7]")).collect()}
    assert got == {1: (["isFamily"], ["C", "A"]), 2: (["isNegated"], []), 3: ([], []), 4: ([], ["A"])}
    assert {r.i: r.candidates for r in semantic.enriched(df).collect()} == {1: ["A", "B", "C"], 2: [], 3: [], 4: ["A"]}


def test_chain_loss(spark):
    rng = np.random.default_rng(2)
    x, a, s, e = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    df = spark.createDataFrame([(1, x.tolist(), [2, 0, 1, 1]), (2, [], []), (3, None, None)], "k int, x array<array<double>>, p array<int>")
    args = (a.tolist(), s.tolist(), e.tolist())
    got = df.select("k", chain.path_score(F.col("x"), F.col("p"), *args).alias("s"), chain.loss(F.col("x"), F.col("p"), *args).alias("l")).orderBy("k").collect()
    score = lambda p: s[p[0]] + e[p[-1]] + sum(x[i, q] for i, q in enumerate(p)) + sum(a[q, r] for q, r in itertools.pairwise(p))
    assert math.isclose(got[0].s, score([2, 0, 1, 1]))
    assert math.isclose(got[0].l, math.log(sum(math.exp(score(p)) for p in itertools.product(range(3), repeat=4))) - score([2, 0, 1, 1]))
    assert (got[1].s, got[1].l, got[2].s) == (0.0, 0.0, 0.0)


def test_workbook(spark, tmp_path):
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [cell("R1", "MÃ") + cell("V1", "TÊN"), cell("R2", " A00.0 ") + cell("T2", "Cholera") + cell("V2", "Tả "), '<c r="R3" t="s"><v>1</v></c><c r="V3" t="s"><v>0</v></c>', '<c r="R4"><v>12</v></c>' + cell("V4", "số"), cell("R5", "1A0") + cell("V5", "x")]
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Lỵ</t></si><si><r><t>B</t></r><r><t>01</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    got = sorted(tuple(r) for r in files.read_code_workbook(spark, str(tmp_path / "a.xlsx")).collect())
    assert got == [("A00.0", "Cholera", "Tả", "ta", "cholera", 4), ("B01", "", "Lỵ", "ly", "", 3)]


def test_corpus_readers(spark, tmp_path):
    (tmp_path / "c.conll").write_text("Bệnh_nhân O\nho I-SYMPTOM\nkhan I-SYMPTOM\nở B-LOCATION\n\nx B-CAUSE\n\ny O\n")
    u = files.conll_to_unified(files.read_conll(spark, str(tmp_path / "c.conll")), "vimedner", files.label_table(spark)).orderBy("sent").collect()
    assert [r.text for r in u] == ["Bệnh nhân ho khan ở", "x", "y"]
    assert [tuple(s) for s in u[0].spans] == [(10, 17, "ho khan", T.SYMPTOM, "PROBLEM", [])] and u[1].spans == [] and u[2].spans == []
    m = spark.createDataFrame([("i2b2", "problem"), ("i2b2", "PROBLEM"), ("phoner", "age"), ("zz", "AGE"), (None, None)], "source string, label string")
    assert sorted((r.source or "", r.label or "", r.coarse) for r in files.meaning(m, files.label_table(spark)).collect()) == [("", "", None), ("i2b2", "PROBLEM", None), ("i2b2", "problem", "PROBLEM"), ("phoner", "age", "OTHER"), ("zz", "AGE", None)]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "3.note").write_text("ba")
    assert [(r.number, r.text) for r in files.read_notes(spark, str(tmp_path / "n")).collect()] == [(3, "ba")]
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [files.cached(spark, str(tmp_path / "cache"), "v1", make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    docs = spark.createDataFrame([(1, 5, "b"), (1, 0, "a"), (2, 0, "é")], "d int, start int, text string")
    files.write_documents(docs, "d", str(tmp_path / "out"))
    assert json.loads(next((tmp_path / "out" / "d=1").glob("part-*")).read_text()) == [{"text": "a"}, {"text": "b"}]
