"""Queries of the corpus problems and their SQL. Each callable takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import canonical, match, mix, overlap, pieces, sentences, tokenize
from ..session import table


def p6_ids(spark, sf_dir):
    """(doc_id, ids): ids by byte_bpe_50k of each whole text, without special tokens."""
    return tokenize.encode(table(spark, sf_dir, "documents"))


def _values(spark, sf_dir):
    return canonical.values_of(*(table(spark, sf_dir, t) for t in ("unified", "out_docs", "icd_index")))


def p4_found(spark, sf_dir):
    """(tbl, row_key, item_no): the values that the consistent form changes."""
    return canonical.changed_forms(_values(spark, sf_dir)).select("tbl", "row_key", F.col("item_no").cast("int").alias("item_no")).distinct()


def p1_found(spark, sf_dir):
    """(rec_lo, rec_hi): pairs of a train record and a dev or test record that share most of their words."""
    o = overlap.overlaps(table(spark, sf_dir, "unified"))
    return o.select(F.least("t", "e").alias("rec_lo"), F.greatest("t", "e").alias("rec_hi")).distinct()


def p1_report(spark, sf_dir):
    """Overlapping records and pairs per evaluation split and source."""
    return overlap.report(table(spark, sf_dir, "unified"))


def p1_spans(spark, sf_dir):
    """(train_id, eval_id, t_start, e_start, length): the merged matches of each pair that is not a copy, in words."""
    o = overlap.overlaps(table(spark, sf_dir, "unified"), with_spans=True)
    return o.select(F.col("t").alias("train_id"), F.col("e").alias("eval_id"), F.inline("spans"))


def p3_found(spark, sf_dir):
    """(out_id, concept_no, code): the entry that each typed diagnosis and drug means, or 'none'."""
    out = match.link_typed(*(table(spark, sf_dir, t) for t in ("out_docs", "icd_index", "rxnorm_index")))
    return out.select("out_id", F.col("concept_no").cast("int").alias("concept_no"), "code")


def p3_report(spark, sf_dir):
    """Values and rows by kind and outcome."""
    out = match.link_typed(*(table(spark, sf_dir, t) for t in ("out_docs", "icd_index", "rxnorm_index")))
    return out.groupBy("kind", (F.col("code") != match.NONE).alias("matched")).agg(F.count("*").alias("n_rows"), F.count_distinct("value").alias("n_values"))


def p4_forms(spark, sf_dir):
    """(tbl, row_key, item_no, form, changed): every value in its one form."""
    return canonical.canonical_forms(_values(spark, sf_dir)).select("tbl", "row_key", "item_no", "form", "changed")


def p5_pieces(spark, sf_dir):
    """(rec_id, piece_no, start_at, end_at, shared, piece, spans): the pieces of the long records."""
    return pieces.split_texts(table(spark, sf_dir, "unified"))


def p5_found(spark, sf_dir):
    """(rec_id): the records that were split."""
    return p5_pieces(spark, sf_dir).select("rec_id").distinct()


def p7_mixture(spark, sf_dir):
    """(slot, source, copy_no, doc_id, n_tokens, at_token): the documents of the mixture in their order."""
    return mix.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"))


def p7_shares(spark, sf_dir):
    """One row per planned source: aimed and actual shares."""
    return mix.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"))


def p8_sentences(spark, sf_dir):
    """(doc_id, sent_no, start_at, end_at): every sentence with its number."""
    docs = table(spark, sf_dir, "documents")
    return sentences.split_sentences(docs, sentences.learn(docs))


def p8_found(spark, sf_dir):
    """(doc_id, start_at, end_at): one row per sentence."""
    return p8_sentences(spark, sf_dir).select("doc_id", "start_at", "end_at")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_spans": p1_spans, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_forms": p4_forms, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_sentences": p8_sentences}

_LOOK_FROM, _LOOK_TO = "".join(canonical.LOOKALIKE_LETTERS), "".join(canonical.LOOKALIKE_LETTERS.values())
_BLANK = "".join(canonical.BLANKS)
_PLAIN = r"translate(regexp_replace(v, '[\x{ad}\x{34f}\x{61c}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]', '', 'g'), '{0}', '{1}')".replace(
    "{0}", canonical._FROM.replace("'", "''")
).replace("{1}", canonical._TO.replace("'", "''"))
_FORM = f"""
WITH vals AS (
  SELECT 'unified' AS tbl, CAST(rec_id AS VARCHAR) AS row_key, 0 AS item_no, text AS v FROM unified
  UNION ALL SELECT 'out_docs', CAST(out_id AS VARCHAR), CAST(i - 1 AS INTEGER), concepts[i].text FROM (SELECT out_id, concepts, unnest(range(1, len(concepts) + 1)) AS i FROM out_docs)
  UNION ALL SELECT 'icd_index', code, 0, vn FROM icd_index
), plain AS (SELECT DISTINCT tbl, row_key, item_no, v, {_PLAIN} AS p FROM vals WHERE v IS NOT NULL),
formed AS (
  SELECT *, nfc_normalize(array_to_string(list_transform(regexp_extract_all(p, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'),
    lambda w: CASE WHEN regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}]') AND regexp_matches(w, '\\p{{Latin}}') THEN translate(w, '{_LOOK_FROM}', '{_LOOK_TO}') ELSE w END), '')) AS f
  FROM plain
)
"""
SQL: dict[str, str] = {
    "p4_found": _FORM + "SELECT DISTINCT tbl, row_key, CAST(item_no AS INTEGER) AS item_no FROM formed WHERE f <> v",
    "p5_found": "SELECT DISTINCT rec_id FROM unified WHERE length(text) > 1000",
}
