"""Queries of training-row preparation and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators import chain, extract, kb, linking, prep, semantic, spans, tagging, training
from ..session import broadcast_if_small, scattered, table
from ..sources import files
from .kb_queries import _HIER, _PAIRS, _fuzzy, key_sql
from .span_queries import _ALIGN, _GOLD, _REC, _TOK, _gold, _models, _records


def _docs(spark, sf_dir):
    return scattered(table(spark, sf_dir, "documents"), "doc_id")


def _names(spark, sf_dir):
    """(kind, code, name) of diagnoses and drugs."""
    icd, rx = table(spark, sf_dir, "icd_index"), table(spark, sf_dir, "rxnorm_index")
    return kb.icd_names(icd).select(F.lit(T.DIAGNOSIS).alias("kind"), "code", "name").unionByName(kb.preferred(rx).select(F.lit(T.DRUG).alias("kind"), F.col("rxcui").alias("code"), "name"))


def _linked(spark, sf_dir, keyed, topk):
    """(key, kind, codes) of distinct keys (key, kind)."""
    dx = linking.cascade_icd(keyed.where(F.col("kind") == T.DIAGNOSIS), table(spark, sf_dir, "icd_index"), topk).withColumn("kind", F.lit(T.DIAGNOSIS))
    dr = linking.cascade_rx(keyed.where(F.col("kind") == T.DRUG), table(spark, sf_dir, "rxnorm_index"), topk).withColumn("kind", F.lit(T.DRUG))
    return dx.unionByName(dr).select("key", "kind", "codes")


def _coded_spans(spark, sf_dir):
    g = _gold(spark, sf_dir).where(F.col("fine").isin(*T.CODED_TYPES))
    return g.select("rec_id", "span_no", X.norm_key(F.col("surface")).alias("key"), F.col("fine").alias("kind"), "surface", F.col("text").alias("context"), F.col("candidates").alias("gold"))


def triplets(spark, sf_dir):
    return prep.triplets(kb.names(table(spark, sf_dir, "icd_index"), table(spark, sf_dir, "rxnorm_index")).select("code", "name"))


def gold_triplets(spark, sf_dir):
    """Triplets of the records' coded spans, and those of the names together."""
    m = _coded_spans(spark, sf_dir)
    g = prep.gold_triplets(m, _linked(spark, sf_dir, m.select("key", "kind"), 8), _names(spark, sf_dir))
    return g.withColumn("origin", F.lit("gold")).unionByName(triplets(spark, sf_dir).withColumn("origin", F.lit("names")))


def sft_rows(spark, sf_dir):
    return prep.entity_rows(_records(spark, sf_dir), "rec_id", "text", "spans").select("rec_id", F.size("messages").cast("bigint").alias("n_messages"), F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("answer"))


def sft_assertions(spark, sf_dir):
    r = prep.assertion_rows(_gold(spark, sf_dir), "rec_id", "text")
    return r.select("rec_id", "span_no", F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("answer"))


def sft_choices(spark, sf_dir):
    m = _coded_spans(spark, sf_dir).withColumnRenamed("key", "mkey")
    linked = _linked(spark, sf_dir, m.select(F.col("mkey").alias("key"), "kind"), 6).withColumnRenamed("key", "mkey")
    r = prep.choice_rows(m, linked, _names(spark, sf_dir), "rec_id")
    return r.select("rec_id", "span_no", F.array_join("candidates", "|").alias("candidates"), F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("answer"))


def augmented(spark, sf_dir):
    """Originals and two changed copies of each record."""
    names = kb.icd_names(table(spark, sf_dir, "icd_index")).select(F.lit(T.DIAGNOSIS).alias("kind"), "name").unionByName(table(spark, sf_dir, "rxnorm_index").select(F.lit(T.DRUG).alias("kind"), F.col("str").alias("name"))).where("name <> ''")
    return prep.augmented(_records(spark, sf_dir), names, "rec_id", "text", "spans")


def shards(spark, sf_dir):
    s = prep.shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8)
    return s.groupBy("shard").agg(F.count("*").alias("n"))


def repeated_rows(spark, sf_dir):
    return prep.repeated_to(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 2500)


def batch_sizes(spark, sf_dir):
    b = prep.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 48)
    return b.groupBy("batch").agg(F.count("*").alias("n"))


def distinct_batches(spark, sf_dir):
    """Rows and distinct texts by batch; no text is in a batch twice."""
    b = prep.distinct_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", 64)
    return b.groupBy("round", "batch").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("text", F.lit("(null)"))).alias("n_texts"))


def holdout(spark, sf_dir):
    return prep.holdout(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("held").agg(F.count("*").alias("n"))


def clause_left(spark, sf_dir):
    """The context before the last tenth of each text."""
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", X.clause_left(F.col("text"), F.floor(F.length("text") * 0.9).cast("int"), 120).alias("context"))


def hard_negatives(spark, sf_dir):
    """For each coded concept the first sibling leaf of its code that is not among its candidates."""
    c = table(spark, sf_dir, "out_docs").dropDuplicates(["out_id"]).select("out_id", F.posexplode("concepts").alias("concept_no", "c")).where(F.size("c.candidates") > 0)
    g = c.select("out_id", "concept_no", F.array_compact("c.candidates").alias("gold")).where("size(gold) > 0")
    kids = broadcast_if_small(kb.children(table(spark, sf_dir, "icd_index")))
    j = g.withColumn("parent", X.parent_code(F.get("gold", F.lit(0)))).join(kids.withColumnRenamed("children", "linked"), "parent")
    return prep.hard_negatives(j).select("out_id", "concept_no", "negative")


def gold_injected(spark, sf_dir):
    """The linked codes of each coded span with its own codes that are missing there."""
    m = _coded_spans(spark, sf_dir).where(F.col("kind") == T.DIAGNOSIS).where(F.size("gold") > 0)
    linked = linking.link_icd_exact(m.select("key").distinct(), table(spark, sf_dir, "icd_index"))
    return m.join(linked, "key").select("rec_id", "span_no", F.array_join(prep.inject_gold(F.col("codes"), F.array_distinct(F.array_compact("gold"))), "|").alias("codes"))


def token_rows(spark, sf_dir):
    """Labels and flags of the first 254 tokens of each record, special tokens included."""
    return training.record_tokens(_records(spark, sf_dir), "rec_id", "text", "spans").select("rec_id", "no", "start", "end", "fine", "coarse", *(F.get("flags", F.lit(i)).alias(f"f{i}") for i in range(3)), "mask")


def _line(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def train_rows(spark, sf_dir):
    a = training.record_rows(_records(spark, sf_dir), "rec_id", "text", "spans")
    return a.select("rec_id", F.size("starts").alias("n"), _line("fine").alias("fine"), _line("coarse").alias("coarse"), _line("mask").alias("mask"), _line(F.flatten("flags")).alias("flags"))


def padded_batches(spark, sf_dir):
    """Training rows padded in batches of 64 record numbers: width and the sum of the attention masks."""
    a = training.record_rows(_records(spark, sf_dir), "rec_id", "text", "spans").withColumn("batch", F.floor(F.col("rec_id") / 64))
    p = training.padded(a, "batch")
    return p.select("rec_id", "batch", "width", F.size("fine").alias("n_fine"), F.size("flags").alias("n_flags"), F.aggregate("attention", F.lit(0), lambda x, y: x + y).alias("n_tokens"), F.size(F.filter("fine", lambda x: x == training.IGNORED)).alias("n_ignored"))


def _scored(spark, sf_dir):
    r = _records(spark, sf_dir)
    toks = spans.scan(r, "rec_id", "text", training.TOKEN)
    gold = spans.exploded(r, "rec_id", "spans").where("fine IS NOT NULL").select("rec_id", "span_no", "start", "end", F.col("fine").alias("kind"))
    decoded = spans.bio_decode(spans.align(toks, gold, "rec_id"), "rec_id")
    h = lambda k, n: F.pmod(F.col("rec_id") * k + F.col("no") * n, F.lit(100)) / 100.0
    preds = toks.select("rec_id", "no", "start", "end", h(31, 17).alias("conf"), F.array(h(7, 3), h(11, 5), h(13, 29)).alias("probs"))
    return training.scored_spans(decoded, preds, "rec_id")


def scored_spans(spark, sf_dir):
    """Spans decoded from the records' labels, scored by made-up token confidences."""
    return _scored(spark, sf_dir).withColumn("assertions", F.array_join("assertions", "|"))


def _concepts(spark, sf_dir, found):
    icd, rx = kb.keep_codes(table(spark, sf_dir, "icd_index")), table(spark, sf_dir, "rxnorm_index")
    p = extract.predicted(found, _records(spark, sf_dir), icd, rx, "rec_id", "text")
    return p.select("rec_id", "start", "end", "kind", "surface", F.array_join("assertions", "|").alias("assertions"), F.array_join("candidates", "|").alias("candidates"))


def predicted(spark, sf_dir):
    """The scored spans of one model as concepts."""
    return _concepts(spark, sf_dir, _scored(spark, sf_dir).select("rec_id", "start", "end", "kind", "assertions"))


def predicted_by_vote(spark, sf_dir):
    """The vote of two models as concepts."""
    return _concepts(spark, sf_dir, spans.ensemble(_models(spark, sf_dir), "rec_id").select("rec_id", "start", "end", "kind", "assertions"))


def pseudo_labels(spark, sf_dir):
    """Problems without a fine label: diagnoses if they can be linked, else symptoms."""
    g = _gold(spark, sf_dir).where("coarse = 'PROBLEM' AND fine IS NULL").select("rec_id", "span_no", X.norm_key(F.col("surface")).alias("key"))
    linked = linking.cascade_icd(g.select("key"), table(spark, sf_dir, "icd_index")).where(F.size("codes") > 0).select("key", "stage")
    return g.join(linked, "key", "left").select("rec_id", "span_no", F.when(F.col("stage").isNotNull(), T.DIAGNOSIS).otherwise(T.SYMPTOM).alias("fine"))


def conll_unified(spark, sf_dir):
    """The records' words tagged by their coarse labels, read back as a tagged corpus: spans on the joined surfaces."""
    kinds = ("PROBLEM", "TEST", "TREATMENT", "OTHER")
    r = _records(spark, sf_dir).where("rec_id IS NOT NULL").withColumn("spans", F.filter("spans", lambda s: s["coarse"].isin(*kinds)))
    tags = F.array(*map(F.lit, training.bio_labels(tuple(k.lower() for k in kinds))))
    t = tagging.label_lists(r, "rec_id", "text", "spans", "coarse", kinds)
    t = t.select(F.lit("f").alias("file"), F.col("rec_id").alias("sent"), F.regexp_extract_all("text", F.lit(training.TOKEN), F.lit(0)).alias("tokens"), F.transform("labels", lambda i: F.get(tags, i)).alias("tags"))
    u = files.sentences_to_unified(t, "i2b2", files.label_table(spark))
    return spans.listed(u.select(F.col("sent").alias("rec_id"), "spans"), "spans", "rec_id").select("rec_id", "start", "end", "text", "fine", "coarse")


def best_epoch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run"), F.col("vec_id").alias("epoch"), F.round(F.get("embedding", F.lit(0)).cast("double"), 2).alias("f1"))
    return prep.best_epoch(e)


def max_pipeline(spark, sf_dir):
    """Concepts with codes taken as predicted items: flags by an answer, linked codes with close ones united and chosen
    from by a fixed chooser."""
    c = table(spark, sf_dir, "out_docs").dropDuplicates(["out_id"]).select("out_id", F.posexplode("concepts").alias("concept_no", "c")).where("c.text IS NOT NULL")
    m = c.select("out_id", "concept_no", F.col("c.text").alias("mention"), F.col("c.type").alias("kind"), F.coalesce("c.assertions", F.array().cast("array<string>")).alias("assertions"), X.norm_key(F.col("c.text")).alias("key"))
    linked = _linked(spark, sf_dir, m.where(F.col("kind").isin(*T.CODED_TYPES)).select("key", "kind"), 3)
    rx = table(spark, sf_dir, "rxnorm_index").select("key", F.col("rxcui").alias("code"))
    near = linking.link_fuzzy(m.where(F.col("kind") == T.DRUG).select("key"), rx, 0.6, 5)
    near = near.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "score"))), lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score"))).alias("hits")).withColumn("kind", F.lit(T.DRUG))
    none = F.array().cast("array<struct<code:string,score:double>>")
    items = m.join(linked, ["key", "kind"], "left").join(near, ["key", "kind"], "left").select(
        "out_id", "concept_no", "mention", "kind", F.lit("").alias("context"), "assertions", F.lit('Nhãn: ["isFamily", "x"]').alias("said"), F.coalesce("codes", F.array().cast("array<string>")).alias("linked"), F.coalesce("hits", none).alias("hits"),
        F.create_map().cast("map<string,string>").alias("names"),
    )
    out = semantic.enriched(items, lambda p: F.lit("[1, 0]"))
    return out.select("out_id", "concept_no", "kind", F.array_join("assertions", "|").alias("assertions"), F.array_join("candidates", "|").alias("candidates"))


def chain_paths(spark, sf_dir):
    """Best label paths of sequences of 16 emissions of four labels each, with their score and loss."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform(F.slice("embedding", t * 4 + 1, F.lit(4)), lambda x: x.cast("double"))).alias("x"))
    args = ([[0.3 if i == j else -0.1 for j in range(4)] for i in range(4)], [0.1, 0.0, -0.1, 0.2], [0.0, 0.1, 0.0, -0.2])
    p = e.withColumn("p", chain.viterbi(F.col("x"), *args))
    return p.select("vec_id", F.array_join(F.transform("p", lambda v: v.cast("string")), "").alias("path"), F.round(chain.path_score(F.col("x"), F.col("p"), *args), 6).alias("score"), F.round(chain.loss(F.col("x"), F.col("p"), *args), 6).alias("loss"))


QUERIES = {
    f.__name__: f
    for f in (
        triplets, gold_triplets, sft_rows, sft_assertions, sft_choices, augmented, shards, repeated_rows, batch_sizes, distinct_batches, holdout, clause_left, hard_negatives, gold_injected, token_rows, train_rows,
        padded_batches, scored_spans, predicted, predicted_by_vote, pseudo_labels, conll_unified, best_epoch, max_pipeline, chain_paths,
    )
}

_FOLD = f"translate(lower({{}}), '{T.ACCENTED}', '{T.PLAIN}')"
_AT = "CAST(floor(length(text) * 0.9) AS INTEGER)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ids(c: str, types) -> str:
    return f"coalesce(list_position({training.bio_labels(types)}, {c}) - 1, 0)"


def _labels(kind: str) -> str:
    """Labels of the first 254 tokens by one kind of type."""
    n = f"{kind}_"
    return f"""{n}hit AS (SELECT tk.rec_id, no, span_no, {kind} AS kind, min(no) OVER (PARTITION BY tk.rec_id, span_no) AS lead FROM tk JOIN gold g ON g.rec_id = tk.rec_id WHERE g.{kind} IS NOT NULL AND g.start < g."end" AND tk.start < g."end" AND g.start < tk."end"),
{n}won AS (SELECT * FROM {n}hit QUALIFY row_number() OVER (PARTITION BY rec_id, no ORDER BY span_no DESC) = 1),
{n}lab AS (SELECT tk.rec_id, tk.no, CASE WHEN kind IS NULL THEN 'O' WHEN w.no = lead THEN 'B-' || kind ELSE 'I-' || kind END AS label FROM tk LEFT JOIN {n}won w USING (rec_id, no))"""


_BORNE = ", ".join(f"'{t}'" for t in T.ASSERTED_TYPES)
_TOKEN_ROWS = f"""{_REC}, {_GOLD}, {_TOK}, tk AS (SELECT rec_id, no + 1 AS no, start, "end" FROM tok WHERE no < 254), {_labels('fine')}, {_labels('coarse')},
fl AS (SELECT tk.rec_id, no, {', '.join(f"max(CAST(coalesce(list_contains(assertions, '{a}'), false) AS INTEGER)) AS f{i}" for i, a in enumerate(T.ASSERTIONS))} FROM tk JOIN gold g ON g.rec_id = tk.rec_id
  WHERE g.fine IN ({_BORNE}) AND g.start < g."end" AND tk.start < g."end" AND g.start < tk."end" GROUP BY 1, 2),
tr AS (SELECT tk.rec_id, tk.no, tk.start, tk."end", CAST({_ids('a.label', T.TYPES)} AS INTEGER) AS fine, CAST({_ids('b.label', T.COARSE)} AS INTEGER) AS coarse, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, CAST(f0 IS NOT NULL AS INTEGER) AS mask
  FROM tk JOIN fine_lab a USING (rec_id, no) JOIN coarse_lab b USING (rec_id, no) LEFT JOIN fl USING (rec_id, no)
  UNION ALL SELECT rec_id, unnest([0, coalesce(n, 0) + 1]), 0, 0, -100, -100, 0, 0, 0, 0 FROM rec LEFT JOIN (SELECT rec_id, max(no) AS n FROM tk GROUP BY 1) USING (rec_id))"""
_KEYS = f"(SELECT DISTINCT {key_sql('surface')} AS key FROM gold WHERE coarse = 'PROBLEM' AND fine IS NULL)"
SQL = {
    "clause_left": "SELECT doc_id, " + _FOLD.format(f"regexp_extract(substring(text, greatest({_AT} - 120, 0) + 1, {_AT} - greatest({_AT} - 120, 0)), '([^.;\\n]*)\\z', 1)") + " AS context FROM documents WHERE text IS NOT NULL",
    "hard_negatives": "WITH kids AS (SELECT split_part(code, '.', 1) AS parent, list_sort(list(DISTINCT code)) AS linked FROM icd_index WHERE contains(code, '.') GROUP BY 1), "
    "g AS (SELECT out_id, CAST(i - 1 AS INTEGER) AS concept_no, list_filter(concepts[i].candidates, lambda x: x IS NOT NULL) AS gold FROM (SELECT *, unnest(range(1, len(concepts) + 1)) AS i FROM (SELECT DISTINCT ON (out_id) * FROM out_docs))) "
    "SELECT out_id, concept_no, list_filter(linked, lambda x: NOT list_contains(gold, x))[1] AS negative FROM g JOIN kids ON parent = split_part(gold[1], '.', 1) WHERE len(gold) > 0",
    "gold_injected": f"WITH {_REC}, {_GOLD}, men AS (SELECT DISTINCT {key_sql('surface')} AS key FROM gold WHERE fine = '{T.DIAGNOSIS}'), {_HIER}, "
    f"m AS (SELECT rec_id, span_no, {key_sql('surface')} AS key, list_filter(candidates, lambda x: x IS NOT NULL) AS g FROM gold WHERE fine = '{T.DIAGNOSIS}' AND len(candidates) > 0), "
    "c AS (SELECT rec_id, span_no, list_concat(codes, list_filter(g, lambda x, i: NOT list_contains(codes, x) AND list_position(g, x) = i)) AS codes FROM m JOIN hier USING (key)) SELECT rec_id, span_no, array_to_string(codes, '|') AS codes FROM c",
    "shards": "SELECT shard, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS shard FROM documents) GROUP BY shard",
    "repeated_rows": "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), c AS (SELECT doc_id, i + n * unnest(range(0, CAST(ceil(2500 / n) AS INTEGER) + 1)) AS place FROM d) SELECT doc_id, place FROM c WHERE place < 2500",
    "batch_sizes": "SELECT batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 48 AS batch FROM documents) GROUP BY batch",
    "distinct_batches": "WITH o AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS round FROM documents), b AS (SELECT *, (row_number() OVER (PARTITION BY round ORDER BY doc_id) - 1) // 64 AS batch FROM o) SELECT round, batch, count(*) AS n, count(*) AS n_texts FROM b GROUP BY 1, 2",
    "sft_rows": f"WITH {_REC}, k AS (SELECT rec_id, text, list_filter(spans, lambda s: s IS NOT NULL AND s.fine IS NOT NULL) AS kept FROM rec) SELECT rec_id, CAST(3 AS BIGINT) AS n_messages, {_quoted(prep.ASK_ENTITIES)}".replace("\\n", "' || chr(10) || '")
    + " || text || '\"' AS \"user\", CAST(to_json(list_transform(kept, lambda s: {'text': s.text, 'type': s.fine})) AS VARCHAR) AS answer FROM k WHERE len(kept) > 0",
    "sft_assertions": f"WITH {_REC}, {_GOLD} SELECT rec_id, span_no, {_quoted(prep.ASK_ASSERTIONS)} || text || '\"' || chr(10) || 'Khái niệm: \"' || surface || '\" (loại: ' || fine || ')' AS \"user\", CAST(to_json(list_filter(coalesce(assertions, []), lambda x: x IS NOT NULL)) AS VARCHAR) AS answer FROM gold WHERE fine IN ({_BORNE})",
    "token_rows": f'WITH {_TOKEN_ROWS} SELECT rec_id, CAST(no AS INTEGER) AS no, start, "end", fine, coarse, f0, f1, f2, mask FROM tr',
    "train_rows": f"WITH {_TOKEN_ROWS} SELECT rec_id, count(*) AS n, string_agg(CAST(fine AS VARCHAR), ' ' ORDER BY no) AS fine, string_agg(CAST(coarse AS VARCHAR), ' ' ORDER BY no) AS coarse, string_agg(CAST(mask AS VARCHAR), ' ' ORDER BY no) AS mask, string_agg(f0 || ' ' || f1 || ' ' || f2, ' ' ORDER BY no) AS flags FROM tr GROUP BY rec_id",
    "padded_batches": f"WITH {_TOKEN_ROWS}, n AS (SELECT rec_id, CAST(floor(rec_id / 64) AS BIGINT) AS batch, count(*) AS n_tokens FROM tr GROUP BY 1), w AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch) AS width FROM n) SELECT rec_id, batch, width, width AS n_fine, width AS n_flags, n_tokens, width - n_tokens + 2 AS n_ignored FROM w",
    "pseudo_labels": f"WITH {_REC}, {_GOLD}, men AS (SELECT key FROM {_KEYS} WHERE key <> ''), {_HIER}, rest AS (SELECT key FROM men ANTI JOIN hier USING (key)), {_fuzzy('rest', _PAIRS, 0.62, False)}, ok AS (SELECT key FROM hier UNION SELECT key FROM ranked) "
    f"SELECT rec_id, span_no, CASE WHEN {key_sql('surface')} IN (SELECT key FROM ok) THEN '{T.DIAGNOSIS}' ELSE '{T.SYMPTOM}' END AS fine FROM gold WHERE coarse = 'PROBLEM' AND fine IS NULL",
    "best_epoch": "SELECT run, arg_min(epoch, {'n': -f1, 'e': epoch}) AS epoch, max(f1) AS f1 FROM (SELECT label AS run, vec_id AS epoch, round(CAST(embedding[1] AS DOUBLE), 2) AS f1 FROM embeddings) GROUP BY run",
}
_BIO_ = """mk AS (SELECT rec_id, no, label[1:2] AS mark, label[3:] AS kind, lag(label) OVER (PARTITION BY rec_id ORDER BY no) AS prev FROM lab),
fr AS (SELECT *, sum(CASE WHEN mark NOT IN ('B-', 'I-') OR mark = 'B-' OR prev IS NULL OR prev[1:2] NOT IN ('B-', 'I-') OR prev[3:] <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY no) AS island FROM mk),
runs AS (SELECT rec_id, island, min(no) AS first, max(no) AS last, min(kind) AS kind, arg_min(mark, no) AS opened FROM fr WHERE mark IN ('B-', 'I-') GROUP BY 1, 2)"""
_H = "((rec_id * {} + no * {}) % 100) / 100.0"
SQL["scored_spans"] = f"""WITH {_REC}, {_GOLD}, {_TOK}, {_ALIGN}, {_BIO_}, z AS (SELECT rec_id, CAST(no AS INTEGER) - (SELECT min(no) FROM tok) AS no, start, "end" FROM tok),
zr AS (SELECT rec_id, first - (SELECT min(no) FROM tok) AS first, last - (SELECT min(no) FROM tok) AS last, kind FROM runs WHERE opened = 'B-'),
p AS (SELECT *, {_H.format(31, 17)} AS conf, {_H.format(7, 3)} AS p0, {_H.format(11, 5)} AS p1, {_H.format(13, 29)} AS p2 FROM z),
m AS (SELECT r.rec_id, first, last, kind, min(start) AS start, max("end") AS "end", avg(conf) AS score, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM zr r JOIN p ON r.rec_id = p.rec_id WHERE p.no BETWEEN first AND last GROUP BY 1, 2, 3, 4)
SELECT rec_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, kind, start, "end", round(score, 6) AS score, CASE WHEN kind IN ({_BORNE}) THEN array_to_string(list_filter([{', '.join(f"CASE WHEN round(p{i}, 9) >= 0.5 THEN '{a}' END" for i, a in enumerate(T.ASSERTIONS))}], lambda x: x IS NOT NULL), '|') ELSE '' END AS assertions FROM m"""
_LOW = "CASE coarse WHEN 'PROBLEM' THEN 'problem' WHEN 'TEST' THEN 'test' WHEN 'TREATMENT' THEN 'treatment' END"
SQL["conll_unified"] = f"""WITH {_REC}, {_GOLD}, {_TOK}, gc AS (SELECT rec_id, span_no, start, "end", coarse AS kind FROM gold WHERE coarse IS NOT NULL AND start < "end"),
hit AS (SELECT tok.rec_id, no, span_no, kind, min(no) OVER (PARTITION BY tok.rec_id, span_no) AS lead FROM tok JOIN gc g ON g.rec_id = tok.rec_id WHERE tok.start < g."end" AND g.start < tok."end"),
won AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY rec_id, no ORDER BY span_no DESC) = 1),
lab AS (SELECT tok.rec_id, tok.no, CASE WHEN kind IS NULL THEN 'O' WHEN won.no = lead THEN 'B-' || kind ELSE 'I-' || kind END AS label FROM tok LEFT JOIN won USING (rec_id, no)), {_BIO_},
sf AS (SELECT rec_id, no, replace(match, '_', ' ') AS t, sum(length(match) + 1) OVER (PARTITION BY rec_id ORDER BY no) AS e FROM tok),
tx AS (SELECT rec_id, string_agg(t, ' ' ORDER BY no) AS text FROM sf GROUP BY 1)
SELECT r.rec_id, CAST(a.e - length(a.t) - 1 AS INTEGER) AS start, CAST(b.e - 1 AS INTEGER) AS "end", substring(text, CAST(a.e - length(a.t) AS BIGINT), CAST(b.e - a.e + length(a.t) AS BIGINT)) AS text,
CASE kind WHEN 'TEST' THEN '{T.TEST_NAME}' END AS fine, kind AS coarse FROM runs r JOIN sf a ON a.rec_id = r.rec_id AND a.no = first JOIN sf b ON b.rec_id = r.rec_id AND b.no = last JOIN tx ON tx.rec_id = r.rec_id WHERE kind IN ('PROBLEM', 'TEST', 'TREATMENT')"""
