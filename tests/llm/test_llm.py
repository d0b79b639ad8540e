"""Corpus operators: brute force, round trips, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import bpe, canonical, fmindex, match, mix, overlap, pieces, sentences, tokenize


def test_bpe_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken")
    ours = tiktoken.Encoding("own", pat_str=bpe.PRETOKEN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "  \n\t ", "Bệnh nhân không ho.", "aab" * 5000, "发热没有观察“仍然。”", "it's 37.5°C 🙂🙂", "<|endoftext|>", "x" * 9999, "ᾮ0\U0001fae8 rare"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: list(r.ids) for r in tokenize.encode(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ours.encode_ordinary(t or "")
        assert ours.decode(got[i]) == (t or "")
    assert tokenize.encode(df.limit(0)).count() == 0


def test_forms(spark):
    given = ["Tiền sử", "Ｍạch１０", "Мạсh", "γ-GT δ2", "Витаферон", "a​b c", "PRK‑1", "27 kg/m² – ≥ 3", "", None, "Ðổi"]
    want = ["Tiền sử", "Mạch10", "Mạch", "γ-GT δ2", "Витаферон", "ab c", "PRK-1", "27 kg/m² – ≥ 3", "", None, "Đổi"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, value string").withColumn("form", F.lit("clash"))
    out = canonical.canonical_forms(df).orderBy("i").collect()
    got = {r.i: (r.form, r.changed) for r in out}
    assert [got[i][0] for i in range(len(given))] == want
    assert all(got[i][1] == (g != w) for i, (g, w) in enumerate(zip(given, want, strict=True)) if g is not None)
    assert canonical.canonical_forms(df.limit(0)).count() == 0


def test_range_max():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 5, 300).astype(np.int32)
    index = pieces.RangeMax(s, 100)
    for _ in range(300):
        lo = int(rng.integers(0, 299))
        hi = min(299, lo + int(rng.integers(0, 99)))
        top = s[lo : hi + 1].max()
        at = np.flatnonzero(s[lo : hi + 1] == top) + lo
        assert index.best(lo, hi) == at[-1] and index.best(lo, hi, rightward=False) == at[0]
    short = pieces.RangeMax(s, 10, stretch=40)  # more than one stretch
    for lo in [*range(0, 290, 3), *range(280, 0, -7)]:
        assert short.best(lo, lo + 9) == index.best(lo, lo + 9)


def test_pieces(spark):
    text = ("Một câu ngắn. " * 200) + "x" * 2500
    for t in (text, "y" * 3001, "a b\n\n" * 900, "。" * 1500):
        p = pieces.cuts(t, [])
        assert p[0][0] == 0 and p[-1][1] == len(t)
        assert all(b - a <= 1000 for a, b in p) and all(x[1] >= y[0] > x[0] and x[1] - y[0] <= 100 for x, y in zip(p, p[1:], strict=False))
    spans = [(990, 1010)]
    assert all(not (990 < b < 1010) for _, b in pieces.cuts(text, spans)[:1])
    rows = [(1, text, [(10, 20), None, (990, 1010)]), (1, text, [(10, 20), None, (990, 1010)]), (2, "short", None), (3, None, None), (4, "z" * 1001, None)]
    df = spark.createDataFrame(rows, "rec_id bigint, text string, spans array<struct<start:int,end:int>>")
    out = pieces.split_texts(df).collect()
    assert {r.rec_id for r in out} == {1, 4} and all(r.piece == rows[0][1][r.start_at : r.end_at] for r in out if r.rec_id == 1)
    assert {s.span_no for r in out if r.rec_id == 1 for s in r.spans} == {0, 2} and all(s.whole for r in out for s in r.spans)


def test_fm_index():
    """Each match is as long as any to the left of its end can be, matches cover all that the text holds, and
    none crosses a record."""
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 400):
        offsets = np.unique(np.append(rng.integers(0, size, size // 7), [0, size]))
        w = rng.integers(0, 5, size)
        index = fmindex.FMIndex(w, offsets)
        records = ["".join(map(str, w[a:z])) for a, z in zip(offsets, offsets[1:], strict=False)]
        text = "|".join(records) + "|"
        lens = rng.integers(0, 30, 50)
        q = rng.integers(0, 7, lens.sum())
        cuts = np.append(0, np.cumsum(lens))
        pattern, start, length, place = index.maximal_matches(q, cuts)
        for k in range(50):
            mine = "".join(map(str, q[cuts[k] : cuts[k + 1]]))
            got = sorted((int(s), int(n), int(p)) for j, s, n, p in zip(pattern, start, length, place, strict=True) if j == k)
            want, i = [], len(mine)
            while i > 0:
                n = 0
                while n < i and mine[i - n - 1 : i] in text:
                    n += 1
                if n:
                    want.append((i - n, n))
                i -= max(n, 1)
            assert [x[:2] for x in got] == sorted(want)
            assert all(text[p : p + n] == mine[s : s + n] for s, n, p in got)
    assert not len(fmindex.FMIndex(np.zeros(0, int), np.zeros(1, int)).maximal_matches(np.arange(3), np.array([0, 3]))[0])


def test_spans():
    """The spans of a pair, found in pieces and merged, lie in the pair's own evaluation text."""
    rng = np.random.default_rng(6)
    e = [rng.integers(0, 50, n) for n in (700, 40, 0)]
    t = [np.concatenate([e[0][100:650], [99], e[0][:50]]), e[1][10:30], e[0], e[1]]
    e_of = np.array([0, 1, 1, 2])
    cut = lambda x: np.append(0, np.cumsum([len(v) for v in x]))
    pair, t_start, e_start, length = overlap.spans_of(np.concatenate(t), cut(t), np.concatenate(e), cut(e), e_of)
    for k in range(4):
        covered = np.zeros(len(t[k]), bool)
        for a, b, n in zip(*(x[pair == k] for x in (t_start, e_start, length)), strict=True):
            assert (t[k][a : a + n] == e[e_of[k]][b : b + n]).all()
            covered[a : a + n] = True
        assert (covered == np.isin(t[k], e[e_of[k]])).all()
    assert max(length[pair == 0]) >= 500 and (pair == 0).sum() <= 4 and (pair == 3).sum() == 0


def _bag_pairs(rows):
    import collections

    out = set()
    bags = {i: collections.Counter(t.lower().split()) for i, s, t in rows if t and t.strip()}
    split = {i: s for i, s, _ in rows}
    for a in bags:
        for b in bags:
            if split[a] == "train" and split[b] != "train":
                c = sum((bags[a] & bags[b]).values())
                if c >= 0.7 * (sum(bags[a].values()) + sum(bags[b].values()) - c):
                    out.add((min(a, b), max(a, b)))
    return out


def test_overlap_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        words = list(rng.choice(vocab, int(rng.integers(3, 60))))
        rows.append((3 * i, "train", " ".join(words)))
        edited = [x for x in words if rng.random() > 0.06]
        if rng.random() < 0.5:
            half = len(edited) // 2
            edited = edited[half:] + edited[:half]
        rows.append((3 * i + 1, ["dev", "test"][i % 2], " ".join(edited).upper()))
    rows += [(9001, "train", "same text here"), (9002, "train", "same text here"), (9003, "test", "Same, text here!"), (9004, "dev", None), (9005, "dev", "  ")]
    rows += [rows[0]]
    df = spark.createDataFrame([(*r, "s") for r in rows], "rec_id bigint, split string, text string, source string").withColumn("t", F.lit(1))
    got = {(min(r.t, r.e), max(r.t, r.e)) for r in overlap.overlaps(df).collect()}
    want = _bag_pairs([(i, s, (t or "").replace(",", "").replace("!", "")) for i, s, t in rows])
    assert got == want and (9001, 9003) in got and (9002, 9003) in got
    assert overlap.overlaps(df.limit(0)).count() == 0


def _found_pairs(spark, pairs):
    """(found, by brute force) of (train text, held text) pairs of word lists."""
    rows = [r for i, (a, b) in enumerate(pairs) for r in ((2 * i, "train", " ".join(a)), (2 * i + 1, ["dev", "test"][i % 2], " ".join(b)))]
    df = spark.createDataFrame([(*r, "s") for r in rows], "rec_id bigint, split string, text string, source string")
    return {(min(r.t, r.e), max(r.t, r.e)) for r in overlap.overlaps(df).collect()}, _bag_pairs(rows)


def test_overlap_of_records_with_several_texts(spark):
    """Only one text of such a record was compared, and it passed for a copy of what its other text equals."""
    t = lambda s, more="": " ".join(f"{s}{k}" for k in range(10)) + more
    rows = [(1, "train", t("a")), (1, "train", t("b")), (2, "test", t("a", " x")), (3, "dev", t("b", " y")), (4, "train", t("c")), (5, "train", t("c")), (5, "train", t("d")), (6, "test", t("d", " y"))]
    rows += [(7, "test", t("c", " y")), (8, "dev", t("d")), (9, "train", t("f")), (9, "test", t("f", " z")), (10, "dev", t("f")), (11, "train", t("g")), (11, "train", t("g", " v")), (12, "dev", t("g"))]
    df = spark.createDataFrame([(*r, "s") for r in rows], "rec_id bigint, split string, text string, source string")
    got = [(r.t, r.e, r.exact) for r in overlap.overlaps(df).collect()]
    assert sorted(got) == [(1, 2, False), (1, 3, False), (4, 7, False), (5, 6, False), (5, 7, False), (5, 8, True), (9, 9, False), (9, 10, True), (11, 12, True)]


def _texts(seed, sizes):
    rng = np.random.default_rng(seed)
    return [[f"w{k}" for k in rng.integers(0, 3000, n)] for n in sizes]


def test_overlap_with_evenly_spread_edits(spark):
    pairs = []
    for words in _texts(11, (4, 7, 12, 20, 24, 40, 79, 80, 95, 130, 200, 400, 900)):
        pairs.append((words, [w for i, w in enumerate(words) if i % 4 != 3]))
        pairs.append((words, [x for i, w in enumerate(words) for x in ([w, f"new{i}"] if i % 3 == 2 else [w])]))
    got, want = _found_pairs(spark, pairs)
    assert len(want) >= 26 and got == want
    for n in range(1, 400):  # an anchor is left in common, however the words that differ are placed
        partners = np.arange(int(np.ceil(0.7 * n - 1e-9)), int(n / 0.7 + 1e-9) + 1)
        common = overlap._least_common(n + partners, 0.7)
        assert ((n - common < overlap.anchors_of(np.array([n]))) | (common > np.minimum(n, partners))).all()


def test_overlap_in_a_hot_group(spark):
    """Near-copies of one form, with every sixth word changed: all its windows of words are frequent."""
    form = [f"form{i}" for i in range(60)]
    copies = [[f"own{i}x{k}" if k % 6 == i % 6 else w for k, w in enumerate(form)] for i in range(300)]
    got, want = _found_pairs(spark, list(zip(copies[::2], copies[1::2], strict=True)))
    got_same, want_same = _found_pairs(spark, list(zip(copies[::6], copies[6::6], strict=False)))
    assert len(want_same) > 2000 and got == want and got_same == want_same


def test_overlap_of_split_anchors(spark):
    """Frequent anchors split over a grid of shards give the same pairs, with spans and copies."""
    form = [f"form{i}" for i in range(40)]
    rows = [(i, ["train", "dev", "train"][i % 3], " ".join(f"own{i}x{k}" if k % 7 == i % 7 else w for k, w in enumerate(form))) for i in range(150)]
    rows += [(1000, "train", "b a c"), (1001, "test", "a b c"), (1002, "test", "B, a c!")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "rec_id bigint, split string, text string, source string")
    got = overlap.overlaps(df, hot=5, work=20, with_spans=True).collect()
    assert {(min(r.t, r.e), max(r.t, r.e)) for r in got} == _bag_pairs([(i, s, t.lower().replace(",", "").replace("!", "")) for i, s, t in rows])
    assert len({(r.t, r.e) for r in got}) == len(got)
    assert {r.e: (r.exact, r.spans) for r in got if r.t == 1000} == {1001: (False, None), 1002: (True, None)}
    assert all(sum(s.length for s in r.spans) == r.covered and len(r.spans) == r.n_spans and max(s.length for s in r.spans) == r.longest for r in got if r.t < 1000)
    assert overlap.report(df).where("n_pairs > 0").count() == 2


def test_overlap_without_order(spark):
    """Reordered records, and pairs of a short and a longer one with words inserted after every second one."""
    rng = np.random.default_rng(5)
    pairs = [(words, list(rng.permutation(words))[: len(words) - len(words) // 8]) for words in _texts(12, (5, 17, 18, 30, 60, 100, 500))]
    for words in _texts(13, (13, 14, 15, 16, 17)):
        more = int(len(words) / 0.7) - len(words)
        pairs.append((words, [x for i, w in enumerate(words) for x in ([w, f"in{i}"] if i % 2 and i // 2 < more else [w])]))
    got, want = _found_pairs(spark, pairs)
    assert len(want) == len(pairs) and got == want


def test_match(spark):
    icd = spark.createDataFrame([("A10", "viem song toang len"), ("A10.0", "viem song toang len man tinh"), ("B11", "u sen hien nhoi")], "code string, key_vn string")
    rx = spark.createDataFrame([("1", "kelotusylbrine"), ("2", "kelotusylbrine sodium 0.4 mg/ml injectable solution"), ("3", "kelotusylbrine 10 mg")], "rxcui string, key string")
    given = [
        ("Viêm sống toảng lễn", "A10", match.DIAGNOSIS), ("mạn tính, viem sonng toang len", "A10.0", match.DIAGNOSIS), ("theo dõi toang song len (mạn tính)", "A10.0", match.DIAGNOSIS),
        ("mạn tính", "none", match.DIAGNOSIS), ("???", "none", match.DIAGNOSIS), ("u khac han roi", "none", match.DIAGNOSIS), ("kelotusylbrinee 10MG uống", "3", match.DRUG),
        ("kelotusylbrine 0,4mg/ml injectable solution prn", "2", match.DRUG), ("10 mg", "none", match.DRUG), ("KELOTUSYLBRINE po bid", "1", match.DRUG),
    ]
    docs = [(i, [(t, k, None)]) for i, (t, _, k) in enumerate(given)] + [(50, None), (51, [None, (None, match.DRUG, None), (" ", match.DRUG, []), ("x", match.DRUG, ["1"])])]
    df = spark.createDataFrame([*docs, docs[0]], "out_id bigint, concepts array<struct<text:string,type:string,candidates:array<string>>>")
    got = {r.out_id: r.code for r in match.link_typed(df, icd, rx).collect()}
    assert got == {i: c for i, (_, c, _) in enumerate(given)}
    assert match.link_typed(df.limit(0), icd, rx).count() == 0
    # the way for long entry lists gives the same
    values = match.typed_values(df)
    pick = lambda d: sorted(tuple(r) for r in d.select("kind", "value", "code", "name", "cost").collect())
    assert pick(match.match_values(values, icd, rx)) == pick(match.match_values(values, icd, rx, most_entries=0))


def test_similarity_join_against_brute_force(spark):
    """Both ways find exactly the pairs at the threshold, with frequent trigrams and ties."""
    rng = np.random.default_rng(8)
    parts = ["viem", "benh", "ly", "song", "toang", "len", "man", "tinh", "u", "hep"]
    names = sorted({" ".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(60)})
    typed = sorted({" ".join(rng.choice([*parts, "sogn", "x1", "manh"], rng.integers(1, 5))) for _ in range(60)})
    sets = spark.createDataFrame([(0, i, n) for i, n in enumerate(names)] + [(1, i, n) for i, n in enumerate(typed)], "side int, id bigint, c string").withColumn("g", match.grams(F.col("c")))
    sets = sets.withColumn("kind", F.lit("k"))
    entries = sets.where("side = 0").select("kind", F.col("id").alias("eid"), "g", F.array(F.replace("c", F.lit(" "), F.lit(""))).alias("variants"), F.lit(9).alias("core"))
    values = sets.where("side = 1").select("kind", F.col("id").alias("vid"), "g", F.replace("c", F.lit(" "), F.lit("")).alias("s"))
    g = {(r.side, r.id): set(r.g) for r in sets.collect()}
    for threshold in (0.3, 0.6, 1.0):
        want = {(v, e) for v in range(len(typed)) for e in range(len(names)) if len(g[1, v] & g[0, e]) >= threshold * len(g[1, v] | g[0, e]) - 1e-9}
        joined = match.candidates(values, entries, threshold, most_entries=0).collect()
        assert {(r.vid, r.eid) for r in joined} == want and len(joined) == len(want)
        blocks = match.candidates(values, entries, threshold, edits=9.0, most_edits=99.0).collect()
        assert {(r.vid, r.eid) for r in blocks} == want and len(blocks) == len(want)


def test_schedule():
    blocks = {"a": 50, "b": 30, "c": 19, "d": 1}
    out = list(mix.schedule(blocks))
    assert [s for s, _, _ in out] == list(range(100))
    seen = dict.fromkeys(blocks, 0)
    for slot, s, k in out:
        assert seen[s] == k
        seen[s] += 1
        assert all(abs(seen[x] - blocks[x] * (slot + 1) / 100) < 1 for x in blocks)


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "ho sốt đau " * (1 + i % 7), ["a", "B ", "c", None][i % 4]) for i in range(200)] + [(900, None, "a"), (901, "", "a")], "doc_id bigint, text string, source string")
    plan = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("zero", 0.1, 3)], "source string, weight double, max_repeat int")
    out = mix.mixture(docs, plan).collect()
    used = {}
    for r in out:
        used[r.doc_id] = used.get(r.doc_id, 0) + 1
        assert r.copy_no < {"a": 2, "b": 1}[r.source]
    assert len({(r.doc_id, r.copy_no) for r in out}) == len(out)
    s = {r.source: r for r in mix.shares(docs, plan).collect()}
    assert s["zero"].actual == 0 and abs(s["a"].share_of_aim - 0.6) < 0.02 and abs(s["b"].share_of_aim - 0.3) < 0.02
    assert mix.mixture(docs.limit(0), plan).count() == 0
    small = {r.source: r for r in mix.shares(docs, plan, block_tokens=50).collect()}
    assert small["a"].blocks > 20 and all(r.most_off < 1 for r in small.values()) and small["zero"].blocks == 0
    sliced = mix.mixture(docs, plan, block_tokens=50).collect()
    assert {(r.doc_id, r.copy_no) for r in sliced} == {(r.doc_id, r.copy_no) for r in out} and len({r.slot for r in sliced}) > 20


def test_starters_and_collocations(spark):
    """A starter ends a sentence after a single capital; a name does not, even one that often begins a unit."""
    base = [f"The patient has a cough {w}. The lungs are clear {w}. Seen by J. Miller on day {w}. Seen by K. Brown {w}.\n\nMiller saw it {w}.\n\nThe visit {w} ended." for w in ("one", "two", "three", "four", "five", "six") for _ in range(8)]
    cases = [
        ("She takes vitamin C. The patient is well.", ["She takes vitamin C.", "The patient is well."]),
        ("Seen by J. Miller again.", ["Seen by J. Miller again."]),
        ("He has hepatitis B. Miller saw it.", ["He has hepatitis B.", "Miller saw it."]),
        ("Seen by K. Brown again.", ["Seen by K. Brown again."]),
    ]
    rows = [(i, t, "en") for i, (t, _) in enumerate(cases)] + [(100 + i, t, "en") for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    splitter = sentences.Splitter(sentences.learn(df))
    for text, want in cases:
        assert [text[s:e] for s, e in splitter.split(text, "en")] == want


def test_sentences(spark):
    base = [f"BS. Lan khám, thấy ho {w}. Ăn uống kém, v.v. nên cần nghỉ {w}. Liều 3.5 mg, tăng {w} dần.\n\nKhám tại TP. Vinh, hẹn {w} lại." for w in ("a", "hai", "ba", "bốn", "năm", "sáu") for _ in range(8)]
    cases = [
        ('BS. Minh khám. BN nói: "Đau. Mệt lắm." Chưa rõ.\nĐi lại', ["BS. Minh khám.", 'BN nói: "Đau. Mệt lắm."', "Chưa rõ.", "Đi lại"], "vi"),
        ("“Đau? Có.” là lời kể. Triệu chứng gồm ho, v.v. Khám lại ?!", ["“Đau? Có.” là lời kể.", "Triệu chứng gồm ho, v.v.", "Khám lại ?!"], "vi"),
        ("1. Bệnh sử:\n- ho nhiều;\n- sốt 3.5 độ\n\nHết.", ["1. Bệnh sử:", "- ho nhiều;", "- sốt 3.5 độ", "Hết."], "vi"),
        ("发热29.9好转。检查“稳定。好！”，停药？", ["发热29.9好转。", "检查“稳定。好！”，停药？"], "zh"),
        ("กินยา ABC ผล หาย 3 วัน", ["กินยา ABC ผล", "หาย 3 วัน"], "th"),
        ("", [], "vi"), (None, [], None), (" \n ", [], "vi"),
    ]
    rows = [(i, t, lang) for i, (t, _, lang) in enumerate(cases)] + [(100 + i, t, "vi") for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("sent_no", F.lit(1))
    model = sentences.learn(df)
    got = {}
    for r in sentences.split_sentences(df, model).orderBy("doc_id", "start_at").collect():
        if r.doc_id < 100:
            got.setdefault(r.doc_id, []).append(cases[r.doc_id][0][r.start_at : r.end_at])
    for i, (_, want, _) in enumerate(cases):
        assert got.get(i, []) == want
    assert sentences.split_sentences(df.limit(0), sentences.learn(df.limit(0))).count() == 0
