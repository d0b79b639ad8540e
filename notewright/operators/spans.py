"""Span operators: scans with offsets, overlap resolution, assertions, checks, alignment, ensembles, edits.

Offsets are 0-based, half-open, in code points. Regex scans use split and match lists, whose running lengths
give the offsets. Null texts give no spans; empty lists give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tables as T
from ..functions import text as X
from ..session import broadcast_if_small, spread


def _running(lens: Column, block: int = 256) -> Column:
    """Running sums of an array of numbers, in blocks, so that an array of n takes n x block steps, not n x n."""
    zero = F.array(F.lit(0))
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lens) - 1) / block).cast("int"), F.lit(0))), lambda k: F.slice(lens, k * block + 1, F.lit(block)))
    sums = F.transform(blocks, lambda b: F.slice(F.aggregate(b, zero, lambda acc, x: F.concat(acc, F.array(last(acc) + x))), F.lit(2), F.lit(block)))
    ahead = F.aggregate(sums, zero, lambda acc, b: F.concat(acc, F.array(last(acc) + last(b))))
    return F.flatten(F.transform(F.arrays_zip(sums.alias("b"), F.slice(ahead, F.lit(1), F.size(ahead) - 1).alias("a")), lambda z: F.transform(z["b"], lambda x: x + z["a"])))


def matches(df: DataFrame, text: str, pattern: str, name: str = "found") -> DataFrame:
    """`df` with an array of (start, end, match) of every match of a pattern that never matches nothing; null
    texts have a null array. No shuffle: offsets are folded inside the row."""
    m, g = f"__{name}_m", f"__{name}_g"
    d = df.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
    d = d.withColumn(g, F.transform(F.arrays_zip(gaps.alias("s"), F.col(m).alias("m")), lambda z: F.length(z["s"]) + F.length(z["m"])))
    ends = F.arrays_zip(_running(F.col(g)).alias("e"), F.col(m).alias("m"))
    return d.withColumn(name, F.transform(ends, lambda z: F.struct((z["e"] - F.length(z["m"])).cast("int").alias("start"), z["e"].cast("int").alias("end"), z["m"].alias("match")))).drop(m, g)


def listed(df: DataFrame, array, *keep: str) -> DataFrame:
    """One row per struct of an array column, its fields as columns. The outer generator keeps the optimiser from
    evaluating a costly array once more in a filter below."""
    return df.select(*keep, F.explode_outer(array).alias("__x")).where("__x IS NOT NULL").select(*keep, "__x.*")


def scan(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, no, start, end, match): every match of a pattern that never matches nothing, one row each."""
    one = matches(df.select(key, text), text, pattern).select(key, F.posexplode_outer("found").alias("no", "x")).where("x IS NOT NULL")
    return one.select(key, "no", "x.start", "x.end", "x.match")


_HEAD = "[a-z]+|[0-9%/+.-]"


def dictionary_spans(df: DataFrame, names: DataFrame, key: str, text: str, least: int = 5, dose: str | None = None) -> DataFrame:
    """(key, start, end, name): dictionary names that stand between characters other than a-z, in any case, from
    the left, the longest first, none inside another; names may hold blanks, hyphens and figures.

    Names are looked up by their head, the run of letters (or the one other sign) that they begin with, by a hash
    join; the few names of a head are compared with the text, so the cost does not grow with the dictionary.
    `dose`: a pattern that may extend a span; the scan goes on after the name. `names` hold keys: lower case,
    plain letters. Null and empty texts have none.
    """
    n = names.where(F.length("name") >= least).select("name").distinct()
    n = n.withColumn("head", F.regexp_extract("name", f"^(?:{_HEAD})", 0)).where("head <> ''")
    letters = F.col("head").rlike("[a-z]")
    facts = n.agg(F.max(F.length("name")).alias("longest"), F.min(F.when(letters, F.length("head"))).alias("least"), F.max(~letters).alias("signs")).first()
    longest, pattern = facts.longest or 0, f"[A-Za-z]{{{facts.least or 1},}}" + ("|[0-9%/+.-]" if facts.signs else "")
    heads = n.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("l"), "name"))), lambda x: x["name"]).alias("names"))
    found = matches(df.select(key, text), text, pattern)
    at = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.lower(x["match"]).alias("head"), F.substring(F.col(text), x["start"] + 1, F.lit(longest + 1)).alias("tail")))
    before = lambda at: F.substring(F.col(text), at, F.lit(1)).rlike("[A-Za-z]") & (at > 0)
    anchors = listed(found, F.filter(at, lambda x: ~before(x["start"])), key)
    low = F.lower("tail")
    whole = F.filter("names", lambda w: (F.substring(low, F.lit(1), F.length(w)) == w) & ~F.substring(F.col("tail"), F.length(w) + 1, F.lit(1)).rlike("[A-Za-z]"))
    hit = anchors.join(broadcast_if_small(heads), "head").withColumn("name", F.get(whole, F.lit(0))).where("name IS NOT NULL")
    per = hit.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.length("name")).alias("end"), "name"))).alias("all"))

    def step(kept, x):
        return F.when((F.size(kept) == 0) | (F.get(kept, F.size(kept) - 1)["end"] <= x["start"]), F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    if dose is None:
        return listed(per, kept, key)
    rest = per.select(key, kept.alias("all")).join(df.select(key, text), key)  # one row a text
    tail = lambda x: F.regexp_extract(F.substring(F.col(text), x["end"] + 1, F.length(text)), "^(?:" + dose + ")", 0)
    grown = F.transform("all", lambda x: F.struct(x["start"].alias("start"), (x["end"] + F.length(F.regexp_replace(tail(x), f"[{T.WS}]+$", ""))).cast("int").alias("end"), x["name"].alias("name")))
    return listed(rest, grown, key)


#: Fixed value: a dose right after a drug's name.
DOSE = (
    r"(?i)\s*[0-9]+(?:[.,][0-9]+)?\s*(?:mg/ml|mcg/ml|mg|mcg|ml|g|iu|unit|đơn vị)(?:\s*/\s*ml)?"
    r"(?:\s+(?:po|iv|im|sc|bid|tid|qid|qd|daily|prn|uống|tiêm|ngậm|dán|bôi|x\s*[0-9]+))*"
)
#: Fixed value: a numbered section title at the start of a line.
SECTION = rf"(?m)^[{T.WS}]*[0-9][{T.WS}]*\.[{T.WS}]*[^\n]{{0,60}}"
SECTION_PARTS = rf"^[{T.WS}]*[0-9][{T.WS}]*\.[{T.WS}]*([^\n]{{0,60}})"
#: Fixed value: a test's name and a number after it.
LAB_NAMES = (
    "troponin", "tropo", "wbc", "rbc", "hgb", "hct", "plt", "neut", "lymph", "lyph", "mono", "eos", "baso", "cea", "psa", "crp", "bnp", "nt-probnp", "inr", "pt", "aptt", "glucose",
    "hba1c", "creatinin", "ure", "ast", "alt", "ggt", "bilirubin", "natri", "kali", "clo", "canxi", "ef", "spo2", "tro",
)
LAB_NAMED = r"(?i)\b(?:" + "|".join(LAB_NAMES) + r")\b\s*[:=]?\s*[0-9]+(?:[.,][0-9]+)?\s*%?"


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, title) of the numbered sections."""
    s = scan(df, key, text, SECTION)
    return s.select(key, F.col("start").alias("pos"), X.strip(F.regexp_extract("match", SECTION_PARTS, 1)).alias("title"))


def section_asof(spans: DataFrame, secs: DataFrame, key: str) -> DataFrame:
    """`spans` with `section`: the last section that starts at or before a span, '' if there is none."""
    w = W.partitionBy(key).orderBy("at", "rank").rowsBetween(W.unboundedPreceding, 0)
    # a section comes before the spans that start where it does; one sort per document, no pairs
    both = spread(spans.withColumn("at", F.col("start")).withColumn("rank", F.lit(1)).unionByName(secs.select(key, F.col("pos").alias("at"), "title", F.lit(0).alias("rank")), allowMissingColumns=True), key)
    return both.withColumn("section", F.coalesce(F.last("title", ignorenulls=True).over(w), F.lit(""))).where("rank = 1").drop("at", "rank", "title")


def exploded(df: DataFrame, key: str, spans: str, *keep: str) -> DataFrame:
    """One row per span that is not null: (key, *keep, span_no, start, end, surface, fine, coarse, assertions, candidates)."""
    e = df.select(key, *keep, F.posexplode(spans).alias("span_no", "s")).where(F.col("s").isNotNull())
    return e.select(key, *keep, "span_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("surface"), "s.fine", "s.coarse", "s.assertions", "s.candidates")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of some plain words or phrases."""
    return c.rlike("|".join(words))


def negated(text: Column, start: Column) -> Column:
    """A cue close before the span, not followed by a word that undoes it."""

    def cue_in(left: Column, cue: str) -> Column:
        # 0-based place of the last occurrence
        last = F.length(left) - F.instr(F.reverse(left), cue[::-1]) - len(cue) + 1
        near = left.contains(cue) & (F.length(left) - last <= T.NEGATION_REACH)
        rest = F.substring(left, last + len(cue) + 1, F.length(left))
        undone = rest.rlike(rf"^[{T.WS}]*(?:" + "|".join(w.replace(" ", f"[{T.WS}]+") for w in T.PSEUDO_NEXT) + rf")(?:[{T.WS}]|\z)")
        return F.when(near, ~undone).otherwise(F.lit(False))

    def some(left: Column) -> Column:
        found = F.lit(False)
        for cue in T.NEGATION_CUES:
            found = found | cue_in(left, cue)
        return found

    return _let(X.clause_left(text, start, T.NEGATION_WINDOW), some)


def of_family(text: Column, start: Column, end: Column) -> Column:
    """A relative is named before the span or in it."""
    at = F.greatest(start - T.FAMILY_WINDOW, F.lit(0))
    return X.strip_accents(F.lower(F.substring(text, at + 1, end - at))).rlike(r"\b(?:" + "|".join(T.FAMILY_WORDS) + ")")


def historical(text: Column, start: Column, end: Column, section: Column) -> Column:
    """A section about the past, a word right after the span, or a cue before it."""
    title = X.strip_accents(F.lower(F.coalesce(section, F.lit(""))))
    left = X.clause_left(text, start, T.PAST_WINDOW)
    right = X.strip(X.strip_accents(F.lower(F.substring(text, end + 1, F.lit(T.PAST_AFTER)))))
    past = _let(title, lambda t: _any_of(t, T.PAST_TITLES) & ~_any_of(t, T.PRESENT_TITLES))
    return past | right.startswith("cu") | _any_of(left, T.PAST_CUES)


def left_window(text: Column, start: Column, n: int = 60) -> Column:
    """The last `n` characters before a span as a plain key."""
    at = F.greatest(start - n, F.lit(0))
    return X.strip_accents(F.lower(F.substring(text, at + 1, start - at)))


def assertions(kind: Column, text: Column, start: Column, end: Column, section: Column) -> Column:
    """Labels in the order negated, family, historical; none for other types."""
    labels = F.array(F.when(negated(text, start), T.ASSERTIONS[0]), F.when(of_family(text, start, end), T.ASSERTIONS[1]), F.when(historical(text, start, end, section), T.ASSERTIONS[2]))
    return F.when(kind.isin(*T.ASSERTED_TYPES), F.array_compact(labels)).otherwise(F.array().cast("array<string>"))


def check_spans(e: DataFrame, text: str, kind: str = "fine") -> DataFrame:
    """(…, error): the broken rules of each span: type, position, slice, assertions, gates."""
    n = F.length(text)
    k = F.col(kind)
    bad_place = ~((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= n))
    a = F.coalesce("assertions", F.array().cast("array<string>"))
    c = F.coalesce("candidates", F.array().cast("array<string>"))
    errors = F.array(
        F.when(k.isNull() | ~k.isin(*T.TYPES), "type"),
        F.when(F.coalesce(bad_place, F.lit(True)), "position").when(F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("surface"), "slice"),
        F.when((F.size(a) > 3) | F.exists(a, lambda x: ~F.coalesce(x.isin(*T.ASSERTIONS), F.lit(False))), "assertions"),
        F.when((F.size(c) > 0) & ~F.coalesce(k.isin(*T.CODED_TYPES), F.lit(False)), "candidates on type"),
        F.when((F.size(a) > 0) & ~F.coalesce(k.isin(*T.ASSERTED_TYPES), F.lit(False)), "assertions on type"),
    )
    return e.withColumn("error", F.explode(F.array_compact(errors)))


def missing_fields(e: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(…, error): the fields of each span that are null."""
    return e.withColumn("error", F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNull(), f"missing {c}") for c in fields)))))


def unknown_codes(e: DataFrame, codes: DataFrame) -> DataFrame:
    """(…, code) of the spans' candidates that the knowledge base (code) does not hold; null and empty ones are no
    codes."""
    each = e.withColumn("code", F.explode("candidates")).where("code <> ''")
    return each.join(broadcast_if_small(codes.select("code").distinct()), "code", "left_anti")


def greedy(spans: DataFrame, key: str) -> DataFrame:
    """Keep the spans that overlap no kept one, by (prio, seq): a fold over one document's spans."""
    s = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("prio", "seq", "start", "end", "kind"))).alias("all"))
    empty = F.slice("all", 1, 0)

    def step(kept, x):
        clash = F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    return listed(s, F.aggregate("all", empty, step), key).select(key, "start", "end", "kind", "prio", "seq")


def greedy_by_start(spans: DataFrame, key: str) -> DataFrame:
    """Keep a span if it starts at or after the end of the last kept one, in order of (start, end)."""
    s = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("all"))
    empty = F.slice("all", 1, 0)

    def step(kept, x):
        fits = (F.size(kept) == 0) | (F.get(kept, F.size(kept) - 1)["end"] <= x["start"])
        return F.when(fits, F.concat(kept, F.array(x))).otherwise(kept)

    return listed(s, F.aggregate("all", empty, step), key)


def islands(spans: DataFrame, key: str) -> DataFrame:
    """`spans` with `island`: a number for each group of spans that overlap, directly or through others."""
    spans = spread(spans, key)
    order = W.partitionBy(key).orderBy("start", "end", "model")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return spans.where("end > start").withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def ensemble(spans: DataFrame, key: str, min_conf: float = 0.0, require_agree: bool = False, labels: int = 3) -> DataFrame:
    """(key, island, start, end, kind, conf, n_agree, n_models, assertions, candidates) of the weighted vote of
    several models' spans (key, model, weight, start, end, kind, score, and if there, arrays assertions and
    candidates). Ties of kinds go to the first in order, ties of the representative to the smaller (start, end).
    Assertions (at most `labels`) and candidates are those of the winning kind's spans in order of model and
    place, each once; null arrays and elements add nothing."""
    none = F.array().cast("array<string>")
    for c in ("assertions", "candidates"):
        if c not in spans.columns:
            spans = spans.withColumn(c, none)
    g = islands(spans, key).withColumn("v", F.col("weight") * F.col("score"))
    n = g.groupBy(key, "island").agg(F.count_distinct("model").alias("n_models"))
    member = F.array_sort(F.collect_list(F.struct("model", "start", "end", F.coalesce("assertions", none).alias("a"), F.coalesce("candidates", none).alias("c"))))
    vote = g.groupBy(key, "island", "kind").agg(
        F.round(F.sum("v"), 6).alias("conf"), F.count_distinct("model").alias("n_agree"),
        F.min(F.struct((-F.col("v")).alias("v"), "start", "end")).alias("rep"), member.alias("m"),
    )
    best = vote.groupBy(key, "island").agg(F.min_by(F.struct("kind", "conf", "n_agree", "rep", "m"), F.struct((-F.col("conf")).alias("c"), "kind")).alias("b"))
    joined = lambda f: F.array_distinct(F.array_compact(F.flatten(F.transform("b.m", lambda x: x[f]))))
    out = best.join(n, [key, "island"]).select(
        key, "island", F.col("b.rep.start").alias("start"), F.col("b.rep.end").alias("end"), F.col("b.kind").alias("kind"), F.col("b.conf").alias("conf"), F.col("b.n_agree").alias("n_agree"), "n_models",
        F.slice(joined("a"), 1, labels).alias("assertions"), joined("c").alias("candidates"),
    )
    out = out.where(F.col("conf") >= min_conf)
    return out.where("n_agree >= 2") if require_agree else out


def token_ranges(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """`spans` (key, span_no, start, end, ...) with `first` and `last`, the numbers of the first and the last token
    (key, no from 0, start, end; disjoint) that they overlap; spans without a token are left out. Borders of
    tokens and spans are swept in one order, so no pairs of tokens and spans are made."""
    t = tokens.select(key, F.inline(F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("rank")), F.struct(F.col("start").alias("at"), F.lit(3).alias("rank")))))
    s = spans.select(key, "span_no", F.inline(F.array(F.struct(F.col("end").alias("at"), F.lit(1).alias("rank")), F.struct(F.col("start").alias("at"), F.lit(2).alias("rank")))))
    before = W.partitionBy(key).orderBy("at", "rank").rowsBetween(W.unboundedPreceding, 0)
    swept = spread(t.unionByName(s, allowMissingColumns=True), key).withColumn("ended", F.count_if(F.col("rank") == 0).over(before)).withColumn("begun", F.count_if(F.col("rank") == 3).over(before))
    ranges = swept.where("span_no IS NOT NULL").groupBy(key, "span_no").agg(F.max(F.when(F.col("rank") == 2, F.col("ended"))).cast("int").alias("first"), (F.max(F.when(F.col("rank") == 1, F.col("begun"))) - 1).cast("int").alias("last"))
    return spans.join(ranges.where("first <= last"), [key, "span_no"])


def align(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, no, start, end, label): BIO label of each token (key, no, start, end); of the spans (key,
    span_no, start, end, kind) that overlap a token the last wins, and its first token gets B."""
    hit = token_ranges(tokens, spans.where("start < end").select(key, "span_no", "start", "end", "kind"), key)
    each = hit.select(key, "span_no", "kind", F.col("first").alias("lead"), F.explode(F.sequence("first", "last")).alias("no"))
    won = each.groupBy(key, "no").agg(F.max(F.struct("span_no", "kind", "lead")).alias("w"))
    label = F.when(F.col("w").isNull(), "O").otherwise(F.concat(F.when(F.col("no") == F.col("w.lead"), "B-").otherwise("I-"), F.col("w.kind")))
    return tokens.join(won, [key, "no"], "left").select(key, "no", "start", "end", label.alias("label"))


def bio_decode(tags: DataFrame, key: str, lenient: bool = False) -> DataFrame:
    """(key, first, last, kind) of the spans in tags (key, no, label). Strict: only B opens; lenient: an I
    without its span opens one too."""
    w = W.partitionBy(key).orderBy("no")
    kind = F.expr("substring(label, 3)")
    mark = F.substring("label", 1, 2)
    t = tags.withColumn("kind", kind).withColumn("mark", mark)
    same = (F.lag("kind").over(w) == F.col("kind")) & F.lag("mark").over(w).isin("B-", "I-")
    fresh = (F.col("mark") == "B-") | ((F.col("mark") == "I-") & ~F.coalesce(same, F.lit(False)))
    t = t.withColumn("fresh", fresh).withColumn("island", F.sum(F.when(F.col("fresh") | ~F.col("mark").isin("B-", "I-"), 1).otherwise(0)).over(w))
    runs = t.where(F.col("mark").isin("B-", "I-")).groupBy(key, "island").agg(F.min("no").alias("first"), F.max("no").alias("last"), F.min("kind").alias("kind"), F.min_by("mark", "no").alias("opened"))
    return (runs if lenient else runs.where("opened = 'B-'")).select(key, "first", "last", "kind")


def prf(pred: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) over sets of spans, zero where a denominator is."""
    p, g = pred.select(*on).distinct().withColumn("p", F.lit(1)), gold.select(*on).distinct().withColumn("g", F.lit(1))
    c = p.join(g, on, "full").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)
    return c.select("tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def apply_edits(edits: Column, text: Column) -> Column:
    """Text after edits (array of (start, end, new) that do not overlap, sorted)."""
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    done = F.aggregate(edits, zero, lambda acc, e: F.struct(F.concat(acc["t"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["new"]).alias("t"), e["end"].alias("at")))
    return F.concat(done["t"], F.substring(text, done["at"] + 1, F.length(text)))


def shift(edits: Column, pos: Column) -> Column:
    """A position after the edits: moved by all that end at or before it."""
    return pos + F.aggregate(F.filter(edits, lambda e: e["end"] <= pos), F.lit(0), lambda acc, e: acc + F.length(e["new"]) - (e["end"] - e["start"]))
