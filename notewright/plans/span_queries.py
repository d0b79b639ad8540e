"""Queries over spans, labels, ensembles and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import prep, semantic, spans
from ..session import broadcast_if_small, latest, scattered, table



def _records(spark, sf_dir):
    """Records of unified, of those delivered twice the later one."""
    return latest(scattered(table(spark, sf_dir, "unified"), "rec_id"), "rec_id", "loaded_at", "text")


def _gold(spark, sf_dir):
    return spans.exploded(_records(spark, sf_dir), "rec_id", "spans", "text", "source")


def _words(spark, sf_dir):
    return spans.scan(_records(spark, sf_dir), "rec_id", "text", r"[^\t-\r\x{20}]+")


def dict_scan_offsets(spark, sf_dir):
    return spans.dictionary_spans(_records(spark, sf_dir), table(spark, sf_dir, "drug_gazetteer"), "rec_id", "text")


def dose_spans(spark, sf_dir):
    return spans.dictionary_spans(_records(spark, sf_dir), table(spark, sf_dir, "drug_gazetteer"), "rec_id", "text", dose=spans.DOSE)


def lab_pairs(spark, sf_dir):
    return spans.scan(_records(spark, sf_dir), "rec_id", "text", spans.LAB_NAMED)


def sections(spark, sf_dir):
    return spans.sections(table(spark, sf_dir, "documents"), "doc_id", "text")


def section_asof(spark, sf_dir):
    secs = spans.sections(_records(spark, sf_dir), "rec_id", "text")
    return spans.section_asof(_gold(spark, sf_dir).select("rec_id", "span_no", "start"), secs, "rec_id").select("rec_id", "span_no", "section")


def assertions(spark, sf_dir):
    e = spans.section_asof(_gold(spark, sf_dir).where("fine IS NOT NULL"), spans.sections(_records(spark, sf_dir), "rec_id", "text"), "rec_id")
    c = [F.col(x) for x in ("text", "start", "end")]
    return e.select("rec_id", "span_no", spans.negated(c[0], c[1]).alias("neg"), spans.of_family(*c).alias("fam"), spans.historical(*c, F.col("section")).alias("hist"))


def validate_concepts(spark, sf_dir):
    return spans.check_spans(_gold(spark, sf_dir), "text").groupBy("error").agg(F.count("*").alias("n"))


def run_report(spark, sf_dir):
    c = table(spark, sf_dir, "out_docs").dropDuplicates(["out_id"]).select(F.explode("concepts").alias("c"))
    return c.groupBy(F.col("c.type").alias("type")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("c.candidates") > 0, F.lit(False))).alias("with_codes")).orderBy(F.desc("n"), "type")


def greedy_nonoverlap(spark, sf_dir):
    drugs = dose_spans(spark, sf_dir).select("rec_id", F.lit(0).alias("prio"), F.col("start").cast("bigint").alias("seq"), "start", "end", F.lit(T.DRUG).alias("kind"))
    gold = _gold(spark, sf_dir).where("start < end").select("rec_id", F.lit(1).alias("prio"), F.col("span_no").cast("bigint").alias("seq"), "start", "end", F.coalesce("fine", "coarse", F.lit("OTHER")).alias("kind"))
    return spans.greedy(drugs.unionByName(gold), "rec_id")


def _models(spark, sf_dir):
    gold = _gold(spark, sf_dir).where("start < end").select("rec_id", F.lit("gold").alias("model"), F.lit(1.0).alias("weight"), "start", "end", F.coalesce("fine", "coarse", F.lit("OTHER")).alias("kind"), F.lit(0.75).alias("score"), "assertions", "candidates")
    scan = dict_scan_offsets(spark, sf_dir).select("rec_id", F.lit("scan").alias("model"), F.lit(0.5).alias("weight"), "start", "end", F.lit(T.DRUG).alias("kind"), F.lit(1.0).alias("score"))
    return gold.unionByName(scan, allowMissingColumns=True)


def ensemble_islands(spark, sf_dir):
    i = spans.islands(_models(spark, sf_dir), "rec_id")
    return i.groupBy("rec_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.count_distinct("model").alias("n_models")).drop("island")


def _votes(df):
    return df.withColumns({c: F.array_join(c, "|") for c in ("assertions", "candidates")}).drop("island")


def ensemble_vote(spark, sf_dir):
    return _votes(spans.ensemble(_models(spark, sf_dir), "rec_id"))


def ensemble_agree(spark, sf_dir):
    return _votes(spans.ensemble(_models(spark, sf_dir), "rec_id", require_agree=True))


def align_labels(spark, sf_dir):
    gold = _gold(spark, sf_dir).where("fine IS NOT NULL AND start < end").select("rec_id", "span_no", "start", "end", F.col("fine").alias("kind"))
    return spans.align(_words(spark, sf_dir), gold, "rec_id")


def bio_strict(spark, sf_dir):
    return spans.bio_decode(align_labels(spark, sf_dir), "rec_id")


def bio_lenient(spark, sf_dir):
    return spans.bio_decode(align_labels(spark, sf_dir), "rec_id", lenient=True)


def span_prf(spark, sf_dir):
    gold = _gold(spark, sf_dir).where(F.col("fine") == T.DRUG).select("rec_id", "start", "end")
    return spans.prf(dose_spans(spark, sf_dir).select("rec_id", "start", "end"), gold, ["rec_id", "start", "end"])


def label_map(spark, sf_dir):
    """Labels of a source, as its map knows them, with how often the source's spans bear that meaning."""
    dim = spark.createDataFrame([*T.LABELS], "source string, label string, fine string, coarse string")
    s = _gold(spark, sf_dir).select(F.lower(F.trim("source")).alias("source"), "fine", "coarse").groupBy("source", "fine", "coarse").agg(F.count("*").alias("n"))
    j = s.alias("s").join(broadcast_if_small(dim).alias("d"), (F.col("s.source") == F.col("d.source")) & F.col("s.fine").eqNullSafe(F.col("d.fine")) & F.col("s.coarse").eqNullSafe(F.col("d.coarse")), "left")
    return j.groupBy("s.source", "s.fine", "s.coarse", "n").agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"))


def silver_rows(spark, sf_dir):
    """Concepts as training spans: type as the fine label, no coarse label, source 'silver'."""
    c = table(spark, sf_dir, "out_docs").dropDuplicates(["out_id"]).select("out_id", F.posexplode("concepts").alias("span_no", "c"))
    c = c.where(F.size("c.position") == 2)
    return c.select("out_id", "span_no", F.col("c.position")[0].alias("start"), F.col("c.position")[1].alias("end"), F.col("c.text").alias("surface"), F.col("c.type").alias("fine"), F.lit("silver").alias("source"))


def run_totals(spark, sf_dir):
    """Notes, concepts, concepts that break a rule, and concepts per note."""
    d = table(spark, sf_dir, "out_docs").dropDuplicates(["out_id"])
    c = d.select("out_id", F.explode("concepts").alias("c")).where("c IS NOT NULL")
    broken = ~F.coalesce(F.col("c.type").isin(*T.TYPES), F.lit(False)) | (F.size(F.coalesce("c.assertions", F.array().cast("array<string>"))) > 3)
    n = c.agg(F.count("*").alias("n_concepts"), F.count_if(broken).alias("n_broken"))
    return d.agg(F.count("*").alias("n_notes")).join(F.broadcast(n)).select("n_notes", "n_concepts", "n_broken", F.round(F.try_divide("n_concepts", F.greatest("n_notes", F.lit(1))), 6).alias("per_note"))


def _out_concepts(spark, sf_dir):
    c = table(spark, sf_dir, "out_docs").dropDuplicates(["out_id"]).select("out_id", F.posexplode("concepts").alias("concept_no", "c")).where("c IS NOT NULL")
    return c.select("out_id", "concept_no", "c.*")


def missing_fields(spark, sf_dir):
    fields = ("text", "position", "type", "assertions", "candidates")
    return spans.missing_fields(_out_concepts(spark, sf_dir), fields).select("out_id", "concept_no", "error")


def unknown_codes(spark, sf_dir):
    """Codes of concepts, by type, that the diagnosis list does not hold (those of drugs stand in another list)."""
    return spans.unknown_codes(_out_concepts(spark, sf_dir), table(spark, sf_dir, "icd_index")).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("code").alias("n_codes"))


def shard_report(spark, sf_dir):
    """Notes per shard and how many of them gave concepts."""
    s = prep.shards(table(spark, sf_dir, "out_docs").dropDuplicates(["out_id"]), "out_id", 4)
    return s.groupBy("shard").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_shards"), F.sum("n").alias("n_notes"), F.max("n").alias("most"))


def code_search(spark, sf_dir):
    """The closest labels of each query vector, each by its closest vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("code"))
    return semantic.code_search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "code")


def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return semantic.cosine_topk(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding")


def rerank_gate(spark, sf_dir):
    """Typed concepts with several codes, the chooser always answering with the second and an impossible one."""
    c = table(spark, sf_dir, "out_docs").dropDuplicates(["out_id"]).select("out_id", F.posexplode("concepts").alias("concept_no", "c")).where(F.size("c.candidates") > 0)
    m = c.select("out_id", "concept_no", F.coalesce("c.text", F.lit("")).alias("mention"), F.col("c.type").alias("kind"), F.lit("").alias("context"), F.transform("c.candidates", lambda x: F.struct(F.coalesce(x, F.lit("")).alias("code"), F.lit("").alias("name"))).alias("candidates"))
    return semantic.rerank(m, lambda p: F.lit("I choose [1, 9, 1]")).select("out_id", "concept_no", F.array_join("chosen", "|").alias("chosen"))


QUERIES = {
    f.__name__: f
    for f in (
        dict_scan_offsets, dose_spans, lab_pairs, sections, section_asof, assertions, validate_concepts, run_report, greedy_nonoverlap, ensemble_islands, ensemble_vote, ensemble_agree,
        align_labels, bio_strict, bio_lenient, span_prf, label_map, silver_rows, run_totals, missing_fields, unknown_codes, shard_report, code_search, cosine_topk, rerank_gate,
    )
}

# --- SQL --------------------------------------------------------------------------------------------------

_REC = "rec AS (SELECT * FROM unified QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC, text) = 1)"


def _scan(src: str, key: str, pattern: str, name: str) -> str:
    return f"""{name}_l AS (SELECT {key}, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS s FROM {src} WHERE text IS NOT NULL),
{name}_x AS (SELECT {key}, i - 1 AS no, m[i] AS match, length(s[i]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_l)),
{name} AS (SELECT {key}, CAST(no AS INTEGER) AS no, CAST(e - length(match) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", match FROM (SELECT *, sum(gap + length(match)) OVER (PARTITION BY {key} ORDER BY no) AS e FROM {name}_x))"""


_GOLD = """gold AS (SELECT rec_id, text, source, CAST(i - 1 AS INTEGER) AS span_no, spans[i].start AS start, spans[i]."end" AS "end", spans[i].text AS surface, spans[i].fine AS fine, spans[i].coarse AS coarse, spans[i].assertions AS assertions, spans[i].candidates AS candidates
FROM (SELECT *, unnest(range(1, len(spans) + 1)) AS i FROM rec) WHERE spans[i] IS NOT NULL)"""
#: Names by their first run of letters, the longest that stands in the text; the fixed names are not part of one another.
_DICT = _scan("rec", "rec_id", "[A-Za-z]+", "w") + """, dn AS (SELECT DISTINCT name, regexp_extract(name, '^[a-z]+') AS head FROM drug_gazetteer WHERE length(name) >= 5),
dh AS (SELECT w.rec_id, w.start, name FROM w JOIN dn ON lower(match) = head JOIN rec ON rec.rec_id = w.rec_id WHERE lower(substring(text, w.start + 1, length(name))) = name AND NOT regexp_matches(substring(text, w.start + length(name) + 1, 1), '[A-Za-z]')),
dic AS (SELECT rec_id, start, CAST(start + length(name) AS INTEGER) AS "end", name FROM dh QUALIFY row_number() OVER (PARTITION BY rec_id, start ORDER BY length(name) DESC) = 1)"""
_SECS = _scan("rec", "rec_id", spans.SECTION, "sc") + f", secs AS (SELECT rec_id, start AS pos, regexp_replace(regexp_extract(match, '{spans.SECTION_PARTS}', 1), '^[{T.WS}]+|[{T.WS}]+$', '', 'g') AS title FROM sc)"
_ASOF = "sec AS (SELECT g.*, coalesce((SELECT arg_max(title, pos) FROM secs s WHERE s.rec_id = g.rec_id AND s.pos <= g.start), '') AS section FROM gold g)"
_MODELS = f"""models AS (SELECT rec_id, 'gold' AS model, 1.0 AS weight, start, "end", coalesce(fine, coarse, 'OTHER') AS kind, 0.75 AS score, coalesce(assertions, []) AS assertions, coalesce(candidates, []) AS candidates FROM gold WHERE start < "end" UNION ALL SELECT rec_id, 'scan', 0.5, start, "end", '{T.DRUG}', 1.0, [], [] FROM dic),
reach AS (SELECT *, max("end") OVER (PARTITION BY rec_id ORDER BY start, "end", model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM models),
isl AS (SELECT *, sum(CASE WHEN r IS NULL OR start >= r THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY start, "end", model ROWS UNBOUNDED PRECEDING) AS island FROM reach)"""
_VOTE = """vote AS (SELECT rec_id, island, kind, round(sum(weight * score), 6) AS conf, count(DISTINCT model) AS n_agree, min({'v': -weight * score, 's': start, 'e': "end"}) AS rep,
  list_filter(flatten(list(assertions ORDER BY model, start, "end", assertions, candidates)), lambda x: x IS NOT NULL) AS a, list_filter(flatten(list(candidates ORDER BY model, start, "end", assertions, candidates)), lambda x: x IS NOT NULL) AS c FROM isl GROUP BY 1, 2, 3),
nm AS (SELECT rec_id, island, count(DISTINCT model) AS n_models FROM isl GROUP BY 1, 2),
best AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY rec_id, island ORDER BY conf DESC, kind) = 1),
ens AS (SELECT rec_id, rep.s AS start, rep.e AS "end", kind, CAST(conf AS DOUBLE) AS conf, n_agree, n_models,
  array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:3], '|') AS assertions, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') AS candidates FROM best JOIN nm USING (rec_id, island))"""
_FOLD = f"translate(lower({{}}), '{T.ACCENTED}', '{T.PLAIN}')"


def _left(n: int) -> str:
    return _FOLD.format(f"regexp_extract(substring(text, greatest(start - {n}, 0) + 1, start - greatest(start - {n}, 0)), '([^.;\\n]*)\\z', 1)")


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _neg() -> str:
    ws, out = T.WS, []
    pseudo = ", ".join(f"'{w}'" for w in T.PSEUDO_NEXT)
    for cue in T.NEGATION_CUES:
        last = f"(length(l) - length(string_split(l, '{cue}')[-1]) - {len(cue)})"
        rest = f"substring(l, {last} + {len(cue) + 1})"
        first = f"regexp_extract({rest}, '^[{ws}]*([^{ws}]+)', 1)"
        two = f"regexp_extract({rest}, '^[{ws}]*([^{ws}]+[{ws}]+[^{ws}]+)', 1)"
        two = f"regexp_replace({two}, '[{ws}]+', ' ')"
        out.append(f"(contains(l, '{cue}') AND {first} NOT IN ({pseudo}) AND {two} NOT IN ({pseudo}) AND length(l) - {last} <= {T.NEGATION_REACH})")
    return "(" + " OR ".join(out) + ")"


_TOK = _scan("rec", "rec_id", r"[^\t-\r\x{20}]+", "tok")
_ALIGN = """hit AS (SELECT tok.rec_id, no, span_no, fine AS kind, min(no) OVER (PARTITION BY tok.rec_id, span_no) AS lead FROM tok JOIN gold g ON g.rec_id = tok.rec_id AND g.fine IS NOT NULL AND g.start < g."end" AND tok.start < g."end" AND g.start < tok."end"),
won AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY rec_id, no ORDER BY span_no DESC) = 1),
lab AS (SELECT tok.rec_id, tok.no, tok.start, tok."end", CASE WHEN kind IS NULL THEN 'O' WHEN won.no = lead THEN 'B-' || kind ELSE 'I-' || kind END AS label FROM tok LEFT JOIN won USING (rec_id, no))"""
_BIO = """mk AS (SELECT rec_id, no, label[1:2] AS mark, label[3:] AS kind, lag(label) OVER (PARTITION BY rec_id ORDER BY no) AS prev FROM lab),
fr AS (SELECT *, sum(CASE WHEN mark NOT IN ('B-', 'I-') OR mark = 'B-' OR prev IS NULL OR prev[1:2] NOT IN ('B-', 'I-') OR prev[3:] <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY no) AS island FROM mk),
runs AS (SELECT rec_id, island, min(no) AS first, max(no) AS last, min(kind) AS kind, arg_min(mark, no) AS opened FROM fr WHERE mark IN ('B-', 'I-') GROUP BY 1, 2)"""
_TYPES = ", ".join(f"'{t}'" for t in T.TYPES)
_ASSERT = ", ".join(f"'{t}'" for t in T.ASSERTIONS)

_DOSED = _DICT + f""", tails AS (SELECT dic.*, regexp_extract(substring(text, "end" + 1), '^(?:{spans.DOSE})') AS tail FROM dic JOIN rec USING (rec_id)),
dosed AS (SELECT rec_id, start, CAST("end" + length(regexp_replace(tail, '[{T.WS}]+$', '')) AS INTEGER) AS "end", name FROM tails)"""


def fold_sql(src: str) -> str:
    """`folded` (rec_id, x): the spans of `src` (rec_id, prio, seq, start, "end", kind, a, b) that meet no kept one, in order."""
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY prio, seq, start, "end", kind, a, b) AS rn FROM {src} WHERE "end" > start),
step AS (SELECT rec_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s BIGINT, e BIGINT, kind VARCHAR, prio INTEGER, seq BIGINT)[]) AS kept FROM (SELECT DISTINCT rec_id FROM ord)
UNION ALL SELECT s.rec_id, o.rn, CASE WHEN len(list_filter(kept, lambda k: (k.s < o."end" AND o.start < k.e) OR (k.s < o.b AND o.a < k.e))) > 0 THEN kept
  ELSE list_append(kept, {{'s': CAST(o.start AS BIGINT), 'e': CAST(o."end" AS BIGINT), 'kind': o.kind, 'prio': CAST(o.prio AS INTEGER), 'seq': CAST(o.seq AS BIGINT)}}) END FROM step s JOIN ord o ON o.rec_id = s.rec_id AND o.rn = s.rn + 1),
folded AS (SELECT rec_id, unnest(kept) AS x FROM (SELECT rec_id, arg_max(kept, rn) AS kept FROM step GROUP BY rec_id))"""


#: Flags of the spans in `sec`.
_FLAGS = (
    f"c AS (SELECT *, {_left(T.NEGATION_WINDOW)} AS l, {_left(T.PAST_WINDOW)} AS l2, {_FOLD.format('section')} AS ti FROM sec WHERE fine IS NOT NULL) "
    f"""SELECT rec_id, span_no, {_neg()} AS neg, regexp_matches({_FOLD.format(f'substring(text, greatest(start - {T.FAMILY_WINDOW}, 0) + 1, "end" - greatest(start - {T.FAMILY_WINDOW}, 0))')}, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{"|".join(T.FAMILY_WORDS)})') AS fam, """
    f"""(({_any('ti', T.PAST_TITLES)} AND NOT {_any('ti', T.PRESENT_TITLES)}) OR starts_with(regexp_replace({_FOLD.format(f'substring(text, "end" + 1, {T.PAST_AFTER})')}, '^[{T.WS}]+|[{T.WS}]+$', '', 'g'), 'cu') OR {_any('l2', T.PAST_CUES)}) AS hist FROM c"""
)

SQL = {
    "dict_scan_offsets": f"WITH {_REC}, {_DICT} SELECT * FROM dic",
    "lab_pairs": f"WITH {_REC}, " + _scan("rec", "rec_id", spans.LAB_NAMED, "lab") + " SELECT * FROM lab",
    "sections": "WITH " + _scan("documents", "doc_id", spans.SECTION, "sc") + f" SELECT doc_id, start AS pos, regexp_replace(regexp_extract(match, '{spans.SECTION_PARTS}', 1), '^[{T.WS}]+|[{T.WS}]+$', '', 'g') AS title FROM sc",
    "section_asof": f"WITH {_REC}, {_GOLD}, {_SECS}, {_ASOF} SELECT rec_id, span_no, section FROM sec",
    "assertions": f"WITH {_REC}, {_GOLD}, {_SECS}, {_ASOF}, {_FLAGS}",
    "validate_concepts": f"""WITH {_REC}, {_GOLD}, e AS (SELECT unnest(list_filter([
      CASE WHEN fine IS NULL OR fine NOT IN ({_TYPES}) THEN 'type' END,
      CASE WHEN coalesce(NOT (start >= 0 AND start <= "end" AND "end" <= length(text)), true) THEN 'position' WHEN substring(text, start + 1, "end" - start) <> surface THEN 'slice' END,
      CASE WHEN coalesce(len(assertions), 0) > 3 OR len(list_filter(coalesce(assertions, []), lambda x: coalesce(x NOT IN ({_ASSERT}), true))) > 0 THEN 'assertions' END,
      CASE WHEN coalesce(len(candidates), 0) > 0 AND coalesce(fine NOT IN ('{T.DIAGNOSIS}', '{T.DRUG}'), true) THEN 'candidates on type' END,
      CASE WHEN coalesce(len(assertions), 0) > 0 AND coalesce(fine NOT IN ('{T.DIAGNOSIS}', '{T.DRUG}', '{T.SYMPTOM}'), true) THEN 'assertions on type' END], lambda x: x IS NOT NULL)) AS error FROM gold)
      SELECT error, count(*) AS n FROM e GROUP BY error""",
    "run_report": "SELECT c.type AS type, count(*) AS n, count(*) FILTER (len(c.candidates) > 0) AS with_codes FROM (SELECT unnest(concepts) AS c FROM (SELECT DISTINCT ON (out_id) * FROM out_docs)) GROUP BY 1",
    "ensemble_islands": f'WITH {_REC}, {_GOLD}, {_DICT}, {_MODELS} SELECT rec_id, min(start) AS start, max("end") AS "end", count(*) AS n, count(DISTINCT model) AS n_models FROM isl GROUP BY rec_id, island',
    "ensemble_vote": f"WITH {_REC}, {_GOLD}, {_DICT}, {_MODELS}, {_VOTE} SELECT * FROM ens",
    "ensemble_agree": f"WITH {_REC}, {_GOLD}, {_DICT}, {_MODELS}, {_VOTE} SELECT * FROM ens WHERE n_agree >= 2",
    "align_labels": f"WITH {_REC}, {_GOLD}, {_TOK}, {_ALIGN} SELECT * FROM lab",
    "bio_strict": f"WITH {_REC}, {_GOLD}, {_TOK}, {_ALIGN}, {_BIO} SELECT rec_id, first, last, kind FROM runs WHERE opened = 'B-'",
    "bio_lenient": f"WITH {_REC}, {_GOLD}, {_TOK}, {_ALIGN}, {_BIO} SELECT rec_id, first, last, kind FROM runs",
    "silver_rows": "SELECT out_id, CAST(i - 1 AS INTEGER) AS span_no, concepts[i].position[1] AS start, concepts[i].position[2] AS \"end\", concepts[i].text AS surface, concepts[i].type AS fine, 'silver' AS source FROM (SELECT *, unnest(range(1, len(concepts) + 1)) AS i FROM (SELECT DISTINCT ON (out_id) * FROM out_docs)) WHERE len(concepts[i].position) = 2",
    "cosine_topk": "WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5",
    "rerank_gate": "SELECT out_id, CAST(i - 1 AS INTEGER) AS concept_no, CASE WHEN len(concepts[i].candidates) = 1 THEN coalesce(concepts[i].candidates[1], '') ELSE coalesce(concepts[i].candidates[2], '') END AS chosen FROM (SELECT *, unnest(range(1, len(concepts) + 1)) AS i FROM (SELECT DISTINCT ON (out_id) * FROM out_docs)) WHERE len(concepts[i].candidates) > 0",
    "run_totals": f"WITH d AS (SELECT DISTINCT ON (out_id) * FROM out_docs), c AS (SELECT unnest(concepts) AS c FROM d) SELECT (SELECT count(*) FROM d) AS n_notes, count(*) AS n_concepts, count(*) FILTER (coalesce(c.type NOT IN ({_TYPES}), true) OR coalesce(len(c.assertions), 0) > 3) AS n_broken, round(count(*) / greatest((SELECT count(*) FROM d), 1), 6) AS per_note FROM c WHERE c IS NOT NULL",
    "missing_fields": "WITH c AS (SELECT out_id, CAST(i - 1 AS INTEGER) AS concept_no, concepts[i] AS c FROM (SELECT *, unnest(range(1, len(concepts) + 1)) AS i FROM (SELECT DISTINCT ON (out_id) * FROM out_docs))) SELECT * FROM (SELECT out_id, concept_no, unnest(list_filter(["
    + ", ".join(f"CASE WHEN c.{f} IS NULL THEN 'missing {f}' END" for f in ("text", "position", "type", "assertions", "candidates")) + "], lambda x: x IS NOT NULL)) AS error FROM c WHERE c IS NOT NULL)",
    "unknown_codes": "WITH c AS (SELECT c.type AS type, unnest(c.candidates) AS code FROM (SELECT unnest(concepts) AS c FROM (SELECT DISTINCT ON (out_id) * FROM out_docs))), k AS (SELECT code FROM icd_index) SELECT type, count(*) AS n, count(DISTINCT code) AS n_codes FROM c WHERE code <> '' AND code NOT IN (SELECT code FROM k WHERE code IS NOT NULL) GROUP BY type",
    "shard_report": "WITH d AS (SELECT count(DISTINCT out_id) AS n FROM out_docs) SELECT CAST(4 AS BIGINT) AS n_shards, n AS n_notes, CAST(ceil(n / 4) AS BIGINT) AS most FROM d",
    "code_search": "WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, CAST(e.label AS VARCHAR) AS code, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 WHERE e.label IS NOT NULL), "
    "b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, code ORDER BY score DESC, id) = 1) SELECT query, code, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 5",
    "dose_spans": f"WITH {_REC}, {_DOSED} SELECT * FROM dosed",
    "greedy_nonoverlap": f"""WITH RECURSIVE {_REC}, {_GOLD}, {_DOSED}, al AS (SELECT rec_id, 0 AS prio, CAST(start AS BIGINT) AS seq, start, "end", '{T.DRUG}' AS kind, start AS a, "end" AS b FROM dosed
UNION ALL SELECT rec_id, 1, span_no, start, "end", coalesce(fine, coarse, 'OTHER'), start, "end" FROM gold WHERE start < "end"), {fold_sql("al")} SELECT rec_id, CAST(x.s AS INTEGER) AS start, CAST(x.e AS INTEGER) AS "end", x.kind AS kind, x.prio AS prio, x.seq AS seq FROM folded""",
    "label_map": "WITH " + _REC + ", " + _GOLD + ", d AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in T.LABELS) + ") t(source, label, fine, coarse)), s AS (SELECT lower(trim(source)) AS source, fine, coarse, count(*) AS n FROM gold GROUP BY 1, 2, 3) "
    "SELECT s.source, s.fine, s.coarse, n, coalesce(string_agg(label, '|' ORDER BY label), '') AS labels FROM s LEFT JOIN d ON s.source = d.source AND s.fine IS NOT DISTINCT FROM d.fine AND s.coarse IS NOT DISTINCT FROM d.coarse GROUP BY 1, 2, 3, 4",
}
SQL["span_prf"] = f"""WITH {_REC}, {_GOLD}, {_DOSED}, p AS (SELECT DISTINCT rec_id, start, "end" FROM dosed), go AS (SELECT DISTINCT rec_id, start, "end" FROM gold WHERE fine = '{T.DRUG}'),
c AS (SELECT count(*) FILTER (p.rec_id IS NOT NULL AND go.rec_id IS NOT NULL) AS tp, count(*) FILTER (go.rec_id IS NULL) AS fp, count(*) FILTER (p.rec_id IS NULL) AS fn FROM p FULL JOIN go USING (rec_id, start, "end"))
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"""
