"""Operators on literal fixtures, edge cases and brute force."""

from pyspark.sql import functions as F

from notewright.functions import tables as T
from notewright.functions import text as X
from notewright.operators import kb, linking, nested, prep, semantic, spans


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_keys(spark):
    given = ["bệnh trào ngược dạ dày - thực quản", "Chlorpheniramine 0.4 MG/ML", "Đái tháo đường típ 2", "NEUT% (Tỷ lệ % bạch cầu trung tính)", "aspirin 325mg", "", None]
    want = ["benh trao nguoc da day - thuc quan", "chlorpheniramine 0.4 mg/ml", "dai thao duong tip 2", "neut% ty le % bach cau trung tinh", "aspirin 325 mg", "", None]
    assert col(spark, given, X.norm_key) == want
    assert col(spark, ["ab", "abcd", "", "a b cd"], X.char_ngrams) == [["ab"], ["abc", "bcd"], [], ["abc", "bcd"]]
    assert col(spark, ["alpha maleate 5 mg", "sodium"], X.strip_salts) == ["alpha 5 mg", ""]
    assert col(spark, ["12a3.txt", "x.txt"], X.file_number) == [123, 0]


def test_sections_and_assertions(spark):
    text = "x\n\n 1. Tien su\nabc\n3.5 mg\n10. foo\n2.\nnext"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    assert [(r.pos, r.title) for r in spans.sections(df, "k", "t").orderBy("pos").collect()] == [(2, "Tien su"), (19, "5 mg"), (34, "next")]
    cases = [
        ("Bệnh nhân không ho, không sốt.", "ho", (True, False, False)),
        ("Không buồn nôn, hay nôn, đổ mồ hôi", "nôn", (True, False, False)),
        ("Có tiền sử hen suyễn nhiều năm.", "hen suyễn", (False, False, True)),
        ("Nhồi máu cơ tim cũ trên điện tâm đồ", "Nhồi máu cơ tim", (False, False, True)),
        ("bệnh thận mạn, không đặc hiệu", "bệnh thận mạn", (False, False, False)),
        ("Bố bệnh nhân bị đái tháo đường", "đái tháo đường", (False, True, False)),
    ]
    rows = [(i, t, t.index(w), t.index(w) + len(w)) for i, (t, w, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, text string, start int, end int")
    c = [F.col(x) for x in ("text", "start", "end")]
    out = df.select("i", spans.negated(c[0], c[1]).alias("n"), spans.of_family(*c).alias("f"), spans.historical(*c, F.lit(None).cast("string")).alias("h")).orderBy("i").collect()
    assert [(r.n, r.f, r.h) for r in out] == [x[2] for x in cases]


def test_linking(spark):
    icd = spark.createDataFrame([("A10", "viem x", "viem x"), ("A10.0", "viem xuong khop goi man cap", None), ("A10.1", "viem x man", None)], "code string, key_vn string, key_en string")
    icd = icd.withColumns({"vn": F.col("key_vn"), "en": F.col("key_en")})
    m = spark.createDataFrame([("viem x",), ("viem xuong khop goi man cap",), ("viem xuong khop goi man capp",), ("zzz",)], "key string")
    got = {r.key: (r.stage, list(r.codes)) for r in linking.cascade_icd(m, icd).collect()}
    assert got["viem x"] == ("exact", ["A10.0", "A10.1"])
    assert got["viem xuong khop goi man cap"] == ("exact", ["A10.0"])
    assert got["viem xuong khop goi man capp"][0] == "fuzzy" and got["viem xuong khop goi man capp"][1][0] == "A10.0"
    assert got["zzz"] == ("none", [])
    rx = spark.createDataFrame([("1", "alpha maleate 5 mg"), ("2", "beta 10 mg")], "rxcui string, key string")
    m = spark.createDataFrame([("alpha 5 mg",), ("beta 10",)], "key string")
    got = {r.key: (r.stage, list(r.codes)) for r in linking.cascade_rx(m, rx).collect()}
    assert got["alpha 5 mg"] == ("relaxed", ["1"]) and got["beta 10"] == ("fuzzy", ["2"])
    assert linking.cascade_rx(m.limit(0), rx).count() == 0 and linking.cascade_rx(m, rx.limit(0)).where("stage <> 'none'").count() == 0


def test_kb(spark):
    rx = spark.createDataFrame([("1", "B", "b", "SY"), ("1", "A", "a", "IN"), ("1", "A", "a", "IN"), ("2", "Z", "zzzz", "BN")], "rxcui string, str string, key string, tty string")
    assert {r.rxcui: r.name for r in kb.preferred(rx).collect()} == {"1": "A", "2": "Z"}
    assert [r.name for r in kb.dictionary(rx).collect()] == ["zzzz"]


def test_ensemble(spark):
    rows = [
        (1, "m1", 1.0, 0, 11, "S", 0.9), (1, "m2", 1.0, 0, 11, "S", 0.85), (1, "m1", 1.0, 20, 29, "D", 0.6), (1, "m2", 1.0, 20, 29, "S", 0.55),
        (1, "m1", 1.0, 40, 48, "T", 0.8), (1, "m2", 1.0, 60, 68, "N", 0.7), (1, "m2", 1.0, 70, 70, "N", 0.7),
    ]
    df = spark.createDataFrame(rows, "k int, model string, weight double, start int, end int, kind string, score double")
    out = [(r.start, r.end, r.kind, r.conf, r.n_agree, r.n_models) for r in spans.ensemble(df, "k").orderBy("start").collect()]
    assert out == [(0, 11, "S", 1.75, 2, 2), (20, 29, "D", 0.6, 1, 2), (40, 48, "T", 0.8, 1, 1), (60, 68, "N", 0.7, 1, 1)]
    assert [r.start for r in spans.ensemble(df, "k", require_agree=True).collect()] == [0]


def test_bio(spark):
    tags = spark.createDataFrame([(1, i, t) for i, t in enumerate(["I-X", "B-X", "I-X", "I-Y", "O"])], "k int, no int, label string")
    got = lambda lenient: sorted((r.first, r.last, r.kind) for r in spans.bio_decode(tags, "k", lenient).collect())
    assert got(False) == [(1, 2, "X")]
    assert got(True) == [(0, 0, "X"), (1, 2, "X"), (3, 3, "Y")]


def test_edits(spark):
    text = "Bệnh nhân được chẩn đoán trào ngược dạ dày, dùng atenolol"
    df = spark.createDataFrame([(1, text, [(25, 42, "CHẨN_ĐOÁN"), (49, 57, "THUỐC")])], "k int, t string, spans array<struct<start:int,end:int,fine:string>>")
    names = spark.createDataFrame([("CHẨN_ĐOÁN", "viêm phổi")], "kind string, name string")
    df = df.withColumn("spans", F.transform("spans", lambda s: s.withField("text", F.substring("t", s["start"] + 1, s["end"] - s["start"]))))
    out = prep.inserted_names(df, names, "k", "t", "spans", p=1.0).first()
    assert [(s.start, s.end, s.text) for s in out.spans] == [(25, 34, "viêm phổi"), (41, 49, "atenolol")]


def test_greedy(spark):
    rows = [(1, 0, 0, 0, 5, "a"), (1, 1, 0, 4, 8, "b"), (1, 1, 1, 5, 8, "c"), (1, 2, 0, 7, 9, "d")]
    df = spark.createDataFrame(rows, "k int, prio int, seq bigint, start int, end int, kind string")
    assert sorted(r.kind for r in spans.greedy(df, "k").collect()) == ["a", "c"]
    assert spans.greedy(df.limit(0), "k").count() == 0


def test_rerank(spark):
    assert [list(x) for x in col(spark, ["Chọn: [0, 1]", "K99.9 và [5], [1]", "[]", "no 2 or 7"], lambda c: semantic.parse_indices(c, F.lit(3)))] == [[0, 1], [1], [], [2]]


def test_cosine(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id bigint, v array<double>")
    got = {(r.query, r["rank"]): r.id for r in semantic.cosine_topk(df.where("id < 3"), df, "id", "v", 4, block=2).collect()}
    for q in range(3):
        s = v @ v[q]
        assert [got[q, k + 1] for k in range(4)] == [i for i in np.argsort(-s) if i != q][:4]
    assert semantic.cosine_topk(df.limit(0), df, "id", "v").count() == 0


def test_topk_of_copies(spark):
    """Copies and near ties in a batch not sorted by id: the smaller ids come out."""
    df = spark.createDataFrame([(i, [1.0, 1e-9 * i]) for i in range(30, -1, -1)], "id bigint, v array<double>").coalesce(1)
    got = semantic.cosine_topk(df.where("id = 7"), df, "id", "v", 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_items_at_any_depth():
    root = {"sections": [{"title": "t", "spans": [{"start": 1}, None]}]}
    for k in range(300):
        root = {"sections": [{"title": str(k), "spans": [{"start": -k}]}, root]}
    got = nested.items(root)
    assert [x and x["start"] for x, _ in got] == [*range(-299, 1), 1, None] and got[-1][1] == "t"


def test_deep_payloads():
    """Beyond the reader's own depth a payload is still read, and a broken one is not."""
    import json

    depth = 20_000
    text = '{"note":' * depth + '{"sections":[{"title":"t","concepts":[{"text":"c","links":[{"kb":"k","code":"Q","score":0.5}]},null]}]}' + "}" * depth
    rows = list(nested.routed(1, text))
    assert [r[2:6] for r in rows] == [("note", "record", "record", 0), ("note", "nested_concept", "span", 0), ("note", "nested_concept", "candidate", 0)]
    assert rows[1][11] == "c" and rows[1][15] == "t" and rows[2][6:9] == ("Q", "k", 0.5)
    assert [r[2] for r in nested.routed(1, text[:-1])] == ["unreadable"]
    for x in ('{"a": [1, {"b": "}"}, [], {}, -2.5e1, true, null], "c": {}}', "[]", ' {"k" : "v"} ', '"s"', "[[[1]], 2]"):
        assert nested._loads_deep(x) == json.loads(x)
    for x in ("[1,]", "{,}", '{"a" 1}', "[1 2]", "{]", "[}", "[1]]", "", '{"a":1,}'):
        try:
            nested._loads_deep(x)
            raise AssertionError(x)
        except ValueError:
            pass


def test_automaton():
    cases = [
        ({"text": "a"}, "record"), ({"text": "a", "spans": []}, "record"), ([{"text": "a"}], "list<concept>"), ([None, 1, {"label": "x"}], "list<null|scalar|span>"), ({"note": {"sections": []}}, "note"), ({"note": {"text": "a"}}, "record"),
        ({"title": "t", "concepts": []}, "section"), ({"start": 1, "spans": []}, "span"), ({"context": {}}, "nested_concept"), ({"code": "A", "kb": "x"}, "link"), ({"code": "A"}, "concept"), ({}, "object"), ({"zz": 1}, "object"),
    ]
    for tree, want in cases[:5] + cases[6:]:
        assert nested.variant(tree, nested.states(tree)) == want, tree


def test_nested(spark):
    rows = [
        (1, '{"text":"a","spans":[{"start":0,"end":1,"text":"a","assertions":"isNegated","candidates":["X",null,"","Y"]},null,{"start":0,"end":1}]}'),
        (1, '{"text":"a","spans":[{"start":0,"end":1,"text":"a","assertions":"isNegated","candidates":["X",null,"","Y"]},null,{"start":0,"end":1}]}'),
        (2, '"[{\\"text\\":\\"b\\",\\"type\\":\\"T\\",\\"candidates\\":\\"Z\\"}]"'),
        (3, '{"note":{"sections":[{"title":"t"},{"title":"u","concepts":[{"text":"c","span":{"from":0,"to":1},"context":{"assertions":["isFamily"]},"links":[{"kb":"k","code":"Q"}]}]}]}}'),
        (4, "{broken"), (5, None), (6, ""), (7, "{}"), (8, "null"), (9, "3"),
    ]
    df = spark.createDataFrame(rows, "raw_id bigint, payload string").withColumn("leaf", F.lit("clash"))
    rows = nested.flatten_json(df).cache()
    assert sorted(r.rec_key for r in rows.where("variant = 'unreadable'").collect()) == [4, 5, 6, 8, 9] and rows.where("leaf = 'record'").count() == 9
    tabled = rows.withColumn("tbl", F.lit("r"))
    assert [tuple(r) for r in nested.related(tabled, nested.NESTED).collect()] == [("r", 3, 0, 0, 1, "c", None, "u")]
    assert [(r.rec_key, r.type) for r in nested.related(tabled, nested.CONCEPT).collect()] == [(2, "T")]
    assert sorted((r.rec_key, r.span_no, r.start, r.end) for r in nested.related(tabled, nested.SPAN).collect()) == [(1, 0, 0, 1), (1, 2, 0, 1)]
    assert {(r.leaf_value, r.kb) for r in nested.related(tabled, "candidates").collect()} == {("X", None), ("Y", None), ("Z", None), ("Q", "k")}
    got = sorted((r.rec_key, r.span_no, r.leaf, r.leaf_no, r.leaf_value) for r in rows.where("leaf <> 'record'").collect())
    assert got == [
        (1, 0, "assertion", 0, "isNegated"), (1, 0, "candidate", 0, "X"), (1, 0, "candidate", 3, "Y"), (1, 0, "span", 0, ""), (1, 2, "span", 0, ""),
        (2, 0, "candidate", 0, "Z"), (2, 0, "span", 0, ""), (3, 0, "assertion", 0, "isFamily"), (3, 0, "candidate", 0, "Q"), (3, 0, "span", 0, ""),
    ]
    assert nested.flatten_json(df.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    from notewright.sources import files

    (tmp_path / "10.txt").write_text("mười")
    (tmp_path / "2.txt").write_text("hai\n")
    assert [(r.number, r.text) for r in files.read_notes(spark, str(tmp_path)).orderBy("number").collect()] == [(2, "hai\n"), (10, "mười")]
    (tmp_path / "a.conll").write_text("Bệnh_nhân O\nho B-SYMPTOM\n\nbad\nx\tB-A\n")
    t = files.conll_offsets(files.read_conll(spark, str(tmp_path / "a.conll")), ["file", "sent"]).orderBy("sent", "no").collect()
    assert [(r.sent, r.token, r.tag, r.start, r.end) for r in t] == [(0, "Bệnh_nhân", "O", 0, 9), (0, "ho", "B-SYMPTOM", 10, 12), (1, "x", "B-A", 0, 1)]
    row = ["7", "ENG"] + [""] * 9 + ["RXNORM", "IN", "", "Beta 5MG", ""]
    (tmp_path / "c.rrf").write_text("|".join(row) + "\nshort|row\n")
    assert [(r.rxcui, r.key) for r in files.read_rrf(spark, str(tmp_path / "c.rrf")).collect()] == [("7", "beta 5 mg")]


def test_stream(spark, tmp_path):
    from notewright.streaming import notes

    spark.createDataFrame([(1, "Ho 5mg")], "id int, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    q = notes.keyed_stream(s).writeStream.format("memory").queryName("keyed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert [r.key for r in spark.table("keyed").collect()] == ["ho 5 mg"]


def test_fixed_values():
    assert len(T.ACCENTED) == len(T.PLAIN) == 134


def test_extract(spark):
    from notewright.operators import extract

    text = "Bệnh nhân nam 70 tuổi, ho đờm xanh, được chẩn đoán mắc bệnh trào ngược dạ dày. Dùng Capsaicin 0.38 MG/ML, WBC:14,43; troponin 0.01"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    names = spark.createDataFrame([("capsaicin",)], "name string")
    got = {(text[r.start : r.end], r.kind) for r in extract.extract(df, names, "k", "t").collect()}
    assert got == {("ho đờm xanh", T.SYMPTOM), ("bệnh trào ngược dạ dày", T.DIAGNOSIS), ("Capsaicin 0.38 MG/ML", T.DRUG), ("WBC", T.TEST_NAME), ("14,43", T.TEST_VALUE), ("troponin", T.TEST_NAME), ("0.01", T.TEST_VALUE)}
    seg = spark.createDataFrame([(1, "EF 3.5 abc"), (2, "a. b. c"), (3, "v.v. ho")], "k int, t string")
    assert sorted((r.k, r.phrase) for r in extract.phrases(seg, "k", "t").collect()) == [(1, "abc"), (2, "a"), (2, "b"), (2, "c"), (3, "ho"), (3, "v")]


def test_chain(spark):
    import itertools
    import math

    import numpy as np

    from notewright.operators import chain

    rng = np.random.default_rng(2)
    x, a, s, e = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    df = spark.createDataFrame([(1, x.tolist()), (2, []), (3, None)], "k int, x array<array<double>>")
    args = (a.tolist(), s.tolist(), e.tolist())
    out = df.select("k", chain.viterbi(F.col("x"), *args).alias("p"), chain.log_partition(F.col("x"), *args).alias("z")).orderBy("k").collect()
    score = {p: s[p[0]] + e[p[-1]] + sum(x[i, q] for i, q in enumerate(p)) + sum(a[q, r] for q, r in itertools.pairwise(p)) for p in itertools.product(range(3), repeat=4)}
    assert tuple(out[0].p) == max(score, key=score.get) and math.isclose(out[0].z, math.log(sum(map(math.exp, score.values()))))
    assert list(out[1].p) == [] and out[2].z == 0.0
