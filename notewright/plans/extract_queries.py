"""Queries of the rule extractor. Their expectations are literal fixtures in tests; phrases have SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import extract, kb
from ..session import table
from .kb_queries import SQL as LINK_SQL
from .kb_queries import _mentions, key_sql
from .span_queries import _ASOF, _DOSED, _FLAGS, _REC, _SECS, _records, _scan, fold_sql


def lab_colon(spark, sf_dir):
    return extract.lab_pairs(_records(spark, sf_dir), "rec_id", "text").select("rec_id", "start", "end", "kind")


def phrase_segments(spark, sf_dir):
    """Pieces of the texts between line ends, ';' and ',', with offsets."""
    return extract.spans.scan(_records(spark, sf_dir), "rec_id", "text", r"[^\n;,]+")


def phrase_classify(spark, sf_dir):
    return extract.classify(extract.phrases(_records(spark, sf_dir), "rec_id", "text")).select("rec_id", "start", "end", "kind", "n_lead")


def number_units(spark, sf_dir):
    return extract.spans.scan(_records(spark, sf_dir), "rec_id", "text", extract.NUMBER_UNIT)


def extract_spans(spark, sf_dir):
    """Drugs, lab pairs and phrases of whole records, stronger ones first."""
    return extract.extract(_records(spark, sf_dir).select("rec_id", "text"), table(spark, sf_dir, "drug_gazetteer"), "rec_id", "text")


def concepts(spark, sf_dir):
    """The whole pipeline over the records' texts: extracted, flagged and linked concepts."""
    icd, rx = kb.keep_codes(table(spark, sf_dir, "icd_index")), table(spark, sf_dir, "rxnorm_index")
    c = extract.concepts(_records(spark, sf_dir).select("rec_id", "text"), table(spark, sf_dir, "drug_gazetteer"), icd, rx, "rec_id", "text")
    return c.withColumns({x: F.array_join(x, "|") for x in ("assertions", "candidates")})


QUERIES = {f.__name__: f for f in (lab_colon, phrase_segments, phrase_classify, number_units, extract_spans, concepts)}
_P = extract.LAB_COLON_PARTS.replace("(?iu:", "(?i:")
_NAMED = r"(?i)^(?:" + "|".join(extract.spans.LAB_NAMES) + ")"
_NONE = ", ".join(f"'{w}'" for w in extract.NO_CONCEPT)
_LABS = f"""{_scan("rec", "rec_id", extract.LAB_COLON.replace("(?iu:", "(?i:"), "lc")}, {_scan("rec", "rec_id", extract.spans.LAB_NAMED, "ln")},
p AS (SELECT rec_id, start, regexp_extract(match, '{_P}', 1) AS a, regexp_extract(match, '{_P}', 2) AS b, regexp_extract(match, '{_P}', 3) AS v FROM lc),
q AS (SELECT *, regexp_replace(a, '[ \\-\\t]+$', '') AS name FROM p),
k AS (SELECT *, start + length(a) + length(b) + length(v) - length(regexp_replace(v, '^[{T.WS}]+', '')) AS v_at, length(regexp_replace(v, '^[{T.WS}]+|[{T.WS}]+$', '', 'g')) AS n FROM q WHERE length({key_sql('name')}) >= 2 AND {key_sql('name')} NOT IN ({_NONE}) AND length(name) <= 45),
m AS (SELECT *, length(regexp_extract(match, '{_NAMED}')) AS w, regexp_extract(match, '[0-9]+(?:[.,][0-9]+)?\\s*%?$') AS num FROM ln),
labs AS (SELECT rec_id, start, start + length(name) AS "end", '{T.TEST_NAME}' AS kind, 0 AS form FROM k UNION ALL SELECT rec_id, v_at, v_at + n, '{T.TEST_VALUE}', 0 FROM k
UNION ALL SELECT rec_id, start, start + w, '{T.TEST_NAME}', 1 FROM m UNION ALL SELECT rec_id, "end" - length(num), "end" - length(num) + length(regexp_replace(num, '^[{T.WS}]+|[{T.WS}]+$', '', 'g')), '{T.TEST_VALUE}', 1 FROM m)"""


def _split_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[{T.WS}]+'), lambda w: w <> '')"


_PHRASES = f"""{_scan("rec", "rec_id", "[^\n;,]+", "sg")},
c AS (SELECT rec_id, start, string_split(regexp_replace(match, '\\.([{T.WS}])', '.' || chr(1) || '\\1', 'g'), chr(1)) AS parts FROM sg),
d AS (SELECT rec_id, start + coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) + length(parts[i]) AS stop, regexp_extract(parts[i], '([^.]*\\.?)$', 1) AS seg FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c)),
e AS (SELECT rec_id, stop - length(seg) AS base, seg, instr(seg, ':') - 1 AS colon, length(regexp_extract(seg, '^[{T.WS}\\-*•0-9.)]+')) AS lead FROM d),
f AS (SELECT *, CASE WHEN colon >= 0 AND colon < 30 AND colon + 1 < length(seg) THEN colon + 1 + length(regexp_extract(substring(seg, colon + 2), '^[{T.WS}]+')) ELSE lead END AS off FROM e),
ph AS (SELECT rec_id, CAST(base + off AS INTEGER) AS start, regexp_replace(substring(seg, off + 1), '[.,;:{T.WS}\\-]+$', '') AS phrase FROM f),
ld AS (SELECT *, {_split_words('phrase')} AS w, len({_split_words(f"regexp_extract({key_sql('phrase')}, '{extract.LEAD}')")}) AS n_lead FROM ph WHERE length(phrase) > 0),
kk AS (SELECT *, {key_sql("CASE WHEN n_lead > 0 AND n_lead < len(w) THEN array_to_string(w[n_lead + 1:], ' ') ELSE phrase END")} AS k FROM ld),
cl AS (SELECT rec_id, start, CAST(start + length(phrase) AS INTEGER) AS "end", CAST(n_lead AS INTEGER) AS n_lead,
  CASE WHEN n_lead > 0 AND n_lead < len(w) THEN start + instr(phrase, w[n_lead + 1]) - 1 ELSE start END AS s, CASE WHEN n_lead > 0 AND n_lead < len(w) THEN length(array_to_string(w[n_lead + 1:], ' ')) ELSE length(phrase) END AS n, CASE
  WHEN k IN ({_NONE}, {", ".join(f"'{w}'" for w in T.HEADINGS)}) OR length(k) < 3 OR length(k) > 60 OR regexp_matches(k, '{extract.PATIENT}') OR regexp_matches(k, '{extract.NOT_CLINICAL}') THEN NULL
  WHEN n_lead > 0 OR regexp_matches(k, '{"|".join(extract.DIAGNOSIS_PARTS)}') THEN '{T.DIAGNOSIS}' WHEN len(string_split(k, ' ')) <= 8 THEN '{T.SYMPTOM}' END AS kind FROM kk)"""
_EXTRACTED = f"""{_REC}, {_DOSED}, {_LABS}, {_PHRASES},
al AS (SELECT rec_id, 0 AS prio, CAST(start AS BIGINT) AS seq, start, "end", '{T.DRUG}' AS kind, start AS a, "end" AS b FROM dosed UNION ALL SELECT rec_id, 1, form * 4294967296 + start, start, "end", kind, start, "end" FROM labs
UNION ALL SELECT rec_id, 2, start, s, s + n, kind, start, "end" FROM cl WHERE kind IS NOT NULL), {fold_sql("al")}"""


def _linked(name: str, kind: str) -> str:
    """A cascade's SQL over the surfaces of one kind."""
    return LINK_SQL[name].replace(_mentions(kind), f"men AS (SELECT DISTINCT {key_sql('surface')} AS key FROM cs WHERE kind = '{kind}' AND {key_sql('surface')} <> '')")


SQL = {
    "phrase_segments": f"WITH {_REC}, " + _scan("rec", "rec_id", r"[^\n;,]+", "seg") + " SELECT * FROM seg",
    "number_units": f"WITH {_REC}, " + _scan("rec", "rec_id", extract.NUMBER_UNIT.replace("(?iu)", "(?i)"), "nu") + " SELECT * FROM nu",
    "lab_colon": f'WITH {_REC}, {_LABS} SELECT rec_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", kind FROM labs',
    "phrase_classify": f'WITH {_REC}, {_PHRASES} SELECT rec_id, start, "end", kind, n_lead FROM cl WHERE kind IS NOT NULL',
    "extract_spans": f'WITH RECURSIVE {_EXTRACTED} SELECT rec_id, CAST(x.s AS INTEGER) AS start, CAST(x.e AS INTEGER) AS "end", x.kind AS kind FROM folded',
    "concepts": f"""WITH RECURSIVE {_EXTRACTED},
cs AS (SELECT f.rec_id, x.s AS start, x.e AS "end", x.kind AS kind, text, substring(text, x.s + 1, x.e - x.s) AS surface, row_number() OVER () AS span_no FROM folded f JOIN rec USING (rec_id)),
fl AS (WITH gold AS (SELECT rec_id, text, span_no, start, "end", kind AS fine FROM cs), {_SECS}, {_ASOF}, {_FLAGS}),
dx AS ({_linked("link_cascade_icd", T.DIAGNOSIS)}), dr AS ({_linked("link_cascade_rx", T.DRUG)})
SELECT cs.rec_id, CAST(cs.start AS INTEGER) AS start, CAST(cs."end" AS INTEGER) AS "end", cs.kind, surface,
CASE WHEN cs.kind IN ({", ".join(f"'{t}'" for t in T.ASSERTED_TYPES)}) THEN array_to_string(list_filter([CASE WHEN neg THEN '{T.ASSERTIONS[0]}' END, CASE WHEN fam THEN '{T.ASSERTIONS[1]}' END, CASE WHEN hist THEN '{T.ASSERTIONS[2]}' END], lambda x: x IS NOT NULL), '|') ELSE '' END AS assertions,
coalesce(CASE cs.kind WHEN '{T.DIAGNOSIS}' THEN dx.codes WHEN '{T.DRUG}' THEN dr.codes END, '') AS candidates
FROM cs JOIN fl USING (rec_id, span_no) LEFT JOIN dx ON dx.key = {key_sql("surface")} LEFT JOIN dr ON dr.key = {key_sql("surface")}""",
}
