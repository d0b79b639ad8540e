"""Labels and flags of tokens by record: plans of few shuffles, brute force on odd spans."""

import random
import re
from pathlib import Path

import pytest

from notewright.functions import tables as T
from notewright.operators import tagging, training
from notewright.plans import prep_queries

DATA = "/root/testdata/sf0.001"
SPAN = "array<struct<start:int,end:int,text:string,fine:string,coarse:string,assertions:array<string>,candidates:array<string>>>"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_token_rows_in_few_shuffles(spark):
    """63 shuffles before, so the plan alone filled the driver."""
    assert shuffles(prep_queries.token_rows(spark, DATA)) <= 8


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_padded_batches_in_few_shuffles(spark):
    assert shuffles(prep_queries.padded_batches(spark, DATA)) <= 8


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_train_rows_in_few_shuffles(spark):
    assert shuffles(prep_queries.train_rows(spark, DATA)) <= 8


def odd_records(n=60, seed=5):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text = "".join(rng.choice(["a", "é", "\U0001f642", "đ", " ", "\t", "\n", " ", "\x1c"]) for _ in range(rng.choice([0, 1, 5, 30, 900])))
        place = lambda: rng.choice([None, -3, 0, len(text), len(text) + 7, *[rng.randint(0, len(text) + 1)] * 20])  # noqa: B023, E731
        spans = [(place(), place(), "x", rng.choice([None, "?", *T.TYPES]), rng.choice([None, "?", *T.COARSE]), rng.choice([None, [], [None], ["isNegated", "zz"], ["isFamily", "isHistorical"]]), None) for _ in range(rng.choice([0, 1, 4, 12]))]
        out.append((k, rng.choice([text, text, text, None]), rng.choice([spans, spans, spans, None, [*spans, None]])))
    return out


def by_hand(text, spans, limit=254):
    toks = [m.span() for m in re.finditer(r"[^\t-\r ]+", text or "")][:limit]
    spans = [s for s in spans or [] if s and s[0] is not None and s[1] is not None and s[0] < s[1]]
    touched = lambda s: [i for i, (a, b) in enumerate(toks) if a < s[1] and s[0] < b]
    out = [[a, b, 0, 0, [0, 0, 0], 0] for a, b in toks]
    for at, c, types in ((2, 3, T.TYPES), (3, 4, T.COARSE)):
        names = training.bio_labels(types)
        for s in spans:
            for i in touched(s) if s[c] is not None else ():
                label = ("B-" if i == touched(s)[0] else "I-") + s[c]
                out[i][at] = names.index(label) if label in names else 0
    for s in spans:
        for i in touched(s) if s[3] in T.ASSERTED_TYPES else ():
            out[i][4] = [max(x, int(a in (s[5] or []))) for x, a in zip(out[i][4], T.ASSERTIONS, strict=True)]
            out[i][5] = 1
    end = [0, 0, -100, -100, [0, 0, 0], 0]
    return [end, *out, end]


def test_token_rows_by_hand(spark, monkeypatch):
    monkeypatch.setattr(tagging, "BLOCK", 500)
    rows = odd_records()
    df = spark.createDataFrame(rows, f"k bigint, text string, spans {SPAN}").repartition(2)
    want = {k: by_hand(t, s) for k, t, s in rows}
    got = {}
    for r in training.record_tokens(df, "k", "text", "spans").collect():
        got.setdefault(r.k, {})[r.no] = [r.start, r.end, r.fine, r.coarse, r.flags, r.mask]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    lists = {r.k: [list(x) for x in zip(r.starts, r.ends, r.fine, r.coarse, r.flags, r.mask, strict=True)] for r in training.record_rows(df, "k", "text", "spans").collect()}
    assert lists == want


def test_runs_of_sentences_by_hand(spark):
    """Sentences next to each other, an I without its B, kinds that meet, null and odd tags."""
    rows = [(0, ["a_b", "c", "d"], ["I-x", "I-x", "B-x"]), (1, ["é", "\U0001f642"], ["I-x", "I-y"]), (2, [], []), (3, ["q", "r", "s"], ["O", None, "B-"]), (4, ["u", "v"], ["B-x", "I-x"])]
    df = spark.createDataFrame(rows, "sent int, tokens array<string>, tags array<string>").coalesce(1).selectExpr("sent", "transform(tokens, t -> length(t)) AS lens", "tags")
    got = {r.sent: [tuple(x) for x in r.runs] for r in tagging.runs(df, "lens", "tags", "sent").collect()}
    assert got == {0: [(0, 5, "x"), (6, 7, "x")], 1: [(0, 1, "x"), (2, 3, "y")], 2: [], 3: [], 4: [(0, 3, "x")]}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_conll_unified_in_few_shuffles(spark):
    assert shuffles(prep_queries.conll_unified(spark, DATA)) <= 8
