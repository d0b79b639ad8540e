"""Queries over keys, the knowledge base and linking, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators import kb, linking
from ..session import table


def norm_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.norm_key(F.col("text")).alias("k"))


def norm_key_loose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.norm_key_loose(F.col("text")).alias("k"))


def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_accents(F.col("text")).alias("k"))


def strip_suffix_terms(spark, sf_dir):
    return table(spark, sf_dir, "rxnorm_index").select("rxcui", "key", X.strip_salts(F.col("key")).alias("k"))


def tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(X.norm_key(F.col("text")))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def char_trigrams(spark, sf_dir):
    return linking.trigram_df(kb.icd_pairs(table(spark, sf_dir, "icd_index")).distinct())


def kb_filter(spark, sf_dir):
    return kb.keep_codes(table(spark, sf_dir, "icd_index"))


def kb_exact(spark, sf_dir):
    e = kb.exact_index(kb.icd_pairs(table(spark, sf_dir, "icd_index")), "key", "code")
    return e.select("key", F.array_join("codes", "|").alias("codes"))


def kb_children(spark, sf_dir):
    return kb.children(table(spark, sf_dir, "icd_index")).select("parent", F.array_join("children", "|").alias("children"))


def kb_relaxed(spark, sf_dir):
    return kb.relaxed_index(table(spark, sf_dir, "rxnorm_index")).select("key", F.array_join("codes", "|").alias("codes"))


def kb_preferred(spark, sf_dir):
    return kb.preferred(table(spark, sf_dir, "rxnorm_index"))


def kb_dictionary(spark, sf_dir):
    return kb.dictionary(table(spark, sf_dir, "rxnorm_index"))


def kb_names(spark, sf_dir):
    return kb.names(table(spark, sf_dir, "icd_index"), table(spark, sf_dir, "rxnorm_index"))


def mentions(spark, sf_dir, kind):
    """Distinct keys of the concepts of a type, whole table."""
    c = table(spark, sf_dir, "out_docs").select(F.explode("concepts").alias("c")).where(F.col("c.type") == kind)
    return c.select(X.norm_key(F.col("c.text")).alias("key")).where("key <> ''").distinct()


def _stages(df):
    return df.select("key", "stage", F.array_join("codes", "|").alias("codes"))


def link_exact(spark, sf_dir):
    return linking.link_icd_exact(mentions(spark, sf_dir, T.DIAGNOSIS), table(spark, sf_dir, "icd_index"), expand=False).select("key", F.array_join("codes", "|").alias("codes"))


def link_hierarchy(spark, sf_dir):
    return linking.link_icd_exact(mentions(spark, sf_dir, T.DIAGNOSIS), table(spark, sf_dir, "icd_index")).select("key", F.array_join("codes", "|").alias("codes"))


def link_relaxed(spark, sf_dir):
    return linking.link_rx_relaxed(mentions(spark, sf_dir, T.DRUG), table(spark, sf_dir, "rxnorm_index")).select("key", F.array_join("codes", "|").alias("codes"))


def link_cascade_icd(spark, sf_dir):
    return _stages(linking.cascade_icd(mentions(spark, sf_dir, T.DIAGNOSIS), table(spark, sf_dir, "icd_index")))


def link_cascade_rx(spark, sf_dir):
    return _stages(linking.cascade_rx(mentions(spark, sf_dir, T.DRUG), table(spark, sf_dir, "rxnorm_index")))


def link_fuzzy(spark, sf_dir):
    rx = table(spark, sf_dir, "rxnorm_index").select("key", F.col("rxcui").alias("code"))
    return linking.link_fuzzy(mentions(spark, sf_dir, T.DRUG), rx, 0.60, salts=True)


def trigram_candidates(spark, sf_dir):
    rx = table(spark, sf_dir, "rxnorm_index")
    return linking.trigram_candidates(mentions(spark, sf_dir, T.DRUG), rx)


def link_explain(spark, sf_dir):
    return linking.explain(mentions(spark, sf_dir, T.DIAGNOSIS), table(spark, sf_dir, "icd_index"))


def link_explain_rx(spark, sf_dir):
    return linking.explain_rx(mentions(spark, sf_dir, T.DRUG), table(spark, sf_dir, "rxnorm_index"))


def code_names(spark, sf_dir):
    """The preferred name of each drug code among the concepts' candidates."""
    c = table(spark, sf_dir, "out_docs").select(F.explode("concepts").alias("c")).where(F.col("c.type") == T.DRUG)
    codes = c.select(F.explode("c.candidates").alias("code")).where("code <> ''").distinct()
    return kb.with_names(codes, kb.preferred(table(spark, sf_dir, "rxnorm_index")).withColumnRenamed("rxcui", "code"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_key, norm_key_loose, strip_accents, strip_suffix_terms, tokens, char_trigrams, kb_filter, kb_exact, kb_children, kb_relaxed, kb_preferred, kb_dictionary, kb_names,
        link_exact, link_hierarchy, link_relaxed, link_cascade_icd, link_cascade_rx, link_fuzzy, trigram_candidates, link_explain, link_explain_rx, code_names,
    )
}


# --- SQL --------------------------------------------------------------------------------------------------

_UNITS = "|".join(T.UNITS)


def key_sql(c: str) -> str:
    s = f"translate(translate(lower({c}), '{T.ACCENTED}', '{T.PLAIN}'), '–—_', '-- ')"
    s = rf"regexp_replace({s}, '[^a-z0-9%/+.\- ]', ' ', 'g')"
    s = rf"regexp_replace({s}, '([0-9]) *({_UNITS})\b', '\1 \2', 'g')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


def salts_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '\b(?:{'|'.join(T.SALTS)})\b', ' ', 'g'), ' +', ' ', 'g'))"


def _loose(c: str) -> str:
    s = f"regexp_replace({key_sql(c)}, '[0-9]+([.,][0-9]+)?', ' ', 'g')"
    for unit in ("mg", "ml", "mcg", "/", "%", "-"):
        s = f"replace({s}, '{unit}', ' ')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


def grams_sql(c: str) -> str:
    s = f"replace({c}, ' ', '')"
    return f"CASE WHEN length({s}) > 0 THEN list_distinct(list_transform(range(1, greatest(length({s}) - 2, 1) + 1), lambda i: substring({s}, i, 3))) ELSE [] END"


_PAIRS = "(SELECT key_vn AS key, code FROM icd_index WHERE key_vn <> '' UNION SELECT key_en, code FROM icd_index WHERE key_en <> '')"
_RX = "(SELECT DISTINCT key, rxcui AS code FROM rxnorm_index WHERE key <> '')"
_EXACT = f"exact AS (SELECT key, list_sort(list(DISTINCT code)) AS codes FROM {_PAIRS} GROUP BY key)"
_CHILD = "kids AS (SELECT split_part(code, '.', 1) AS parent, list_sort(list(DISTINCT code)) AS children FROM icd_index WHERE contains(code, '.') GROUP BY 1)"


def _mentions(kind: str) -> str:
    return f"men AS (SELECT DISTINCT {key_sql('c.text')} AS key FROM (SELECT unnest(concepts) AS c FROM out_docs) WHERE c.type = '{kind}' AND {key_sql('c.text')} <> '')"


_HIER = f"""{_EXACT}, {_CHILD}, hit AS (SELECT men.key, codes FROM men JOIN exact USING (key)),
one AS (SELECT key, unnest(range(1, len(codes) + 1)) AS pos, codes FROM hit),
ls AS (SELECT key, pos, coalesce(children[1:3], [codes[pos]]) AS l FROM one LEFT JOIN kids ON parent = codes[pos]),
flat AS (SELECT key, flatten(list(l ORDER BY pos)) AS f FROM ls GROUP BY key),
hier AS (SELECT key, list_filter(f, lambda x, i: list_position(f, x) = i)[1:3] AS codes FROM flat)"""


_SCORE = """0.40 * gi / (len(g) + len(h) - gi) + 0.22 * (2 * both_) / (len(t) + len(u)) + CASE WHEN both_ = len(t) THEN 0.18 ELSE 0 END
  + 0.12 * CASE WHEN starts_with(ekey, key) THEN 1 WHEN contains(ekey, key) THEN 0.7 ELSE 0 END + 0.08 * both_ / len(t)"""


def _scored(extra: str = "") -> str:
    return f"""parts AS (SELECT key, ekey, {grams_sql('key')} AS g, {grams_sql('ekey')} AS h, list_distinct(string_split(key, ' ')) AS t, list_distinct(string_split(ekey, ' ')) AS u FROM cand),
counted AS (SELECT *, len(list_intersect(t, u)) AS both_, len(list_intersect(g, h)) AS gi FROM parts),
scored AS (SELECT key, ekey, round({_SCORE}{extra}, 6) AS score FROM counted)"""


def _fuzzy(men: str, pairs: str, threshold: float, salts: bool) -> str:
    """All pairs with a word in common, or equal without salts, scored."""
    extra = f" + CASE WHEN {salts_sql('key')} = {salts_sql('ekey')} THEN 0.15 ELSE 0 END" if salts else ""
    equal = f" UNION SELECT key, ekey FROM (SELECT key, {salts_sql('key')} AS b FROM {men}) JOIN (SELECT DISTINCT key AS ekey, {salts_sql('key')} AS b FROM {pairs}) USING (b)" if salts else ""
    return f"""eg AS (SELECT DISTINCT key AS ekey, unnest(string_split(key, ' ')) AS word FROM {pairs}),
mg AS (SELECT DISTINCT key, unnest(string_split(key, ' ')) AS word FROM {men}),
cand AS (SELECT DISTINCT key, ekey FROM mg JOIN eg USING (word){equal}),
{_scored(extra)},
best AS (SELECT key, code, max(score) AS score FROM scored JOIN (SELECT DISTINCT key AS ekey, code FROM {pairs}) USING (ekey) WHERE score >= {threshold} GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, code) AS rank FROM best)"""


def _closest(sides: tuple[str, ...], exact: str, names: str, topk: int, cap: int = 400) -> str:
    """The entries of each side that share most trigrams, scored, and the exact ones at 1."""
    side = " UNION ALL ".join(f"SELECT {i} AS side, key AS ekey, code FROM {x}" for i, x in enumerate(sides))
    return f"""side AS ({side}), eg AS (SELECT DISTINCT side, ekey, unnest({grams_sql('ekey')}) AS gram FROM side),
mg AS (SELECT key, unnest({grams_sql('key')}) AS gram FROM men),
sh AS (SELECT key, side, ekey, count(*) AS shared FROM mg JOIN eg USING (gram) GROUP BY 1, 2, 3),
top AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY key, side ORDER BY shared DESC, ekey) <= {cap}),
cand AS (SELECT DISTINCT key, ekey FROM top), {_scored()},
al AS (SELECT key, code, score FROM top JOIN scored USING (key, ekey) JOIN side USING (side, ekey) UNION ALL SELECT key, code, 1.0 FROM men JOIN {exact} USING (key)),
ab AS (SELECT key, code, max(score) AS score FROM al GROUP BY 1, 2), nm AS ({names})
SELECT key, code, name, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, code) AS r FROM ab) LEFT JOIN nm USING (code) WHERE r <= {topk}"""


_ICD_NAMES = "SELECT code, coalesce(min(vn) FILTER (vn <> ''), min(en) FILTER (en <> '')) AS name FROM icd_index GROUP BY code"
_PREFERRED = "SELECT rxcui, arg_min(str, {'r': coalesce(list_position(" + str(list(T.TTY_RANK)) + ", tty), 99), 's': str}) AS name FROM rxnorm_index GROUP BY rxcui"
_REL = f"""rel AS (SELECT k, list_sort(list(DISTINCT rxcui)) AS codes FROM (SELECT {salts_sql('key')} AS k, key, rxcui FROM rxnorm_index) WHERE k <> key AND k <> '' GROUP BY k)"""

SQL = {
    "norm_key": f"SELECT doc_id, {key_sql('text')} AS k FROM documents",
    "norm_key_loose": f"SELECT doc_id, {_loose('text')} AS k FROM documents",
    "strip_accents": f"SELECT doc_id, translate(text, '{T.ACCENTED}', '{T.PLAIN}') AS k FROM documents",
    "strip_suffix_terms": f"SELECT rxcui, key, {salts_sql('key')} AS k FROM rxnorm_index",
    "tokens": f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split({key_sql('text')}, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token",
    "char_trigrams": f"SELECT gram, count(*) AS df FROM (SELECT key, code, unnest({grams_sql('key')}) AS gram FROM {_PAIRS}) GROUP BY gram",
    "kb_filter": "SELECT DISTINCT trim(code) AS code, en, vn, key_vn, key_en, CAST(CASE WHEN contains(code, '.') THEN 4 ELSE 3 END AS INTEGER) AS level, split_part(trim(code), '.', 1) AS parent FROM icd_index WHERE length(trim(code)) >= 3 AND regexp_matches(trim(code), '^\\p{L}')",
    "kb_exact": f"WITH {_EXACT} SELECT key, array_to_string(codes, '|') AS codes FROM exact",
    "kb_children": f"WITH {_CHILD} SELECT parent, array_to_string(children, '|') AS children FROM kids",
    "kb_relaxed": f"WITH {_REL} SELECT k AS key, array_to_string(codes, '|') AS codes FROM rel",
    "kb_preferred": _PREFERRED,
    "kb_dictionary": "SELECT DISTINCT key AS name, CAST(length(key) AS INTEGER) AS n_chars FROM rxnorm_index WHERE tty IN ('IN', 'PIN', 'MIN', 'BN') AND length(key) >= 4 AND length(key) - length(replace(key, ' ', '')) <= 5 AND key NOT IN (" + str(list(T.NOT_DRUGS))[1:-1] + ")",
    "kb_names": "SELECT DISTINCT * FROM (SELECT 'icd' AS kb, vn AS name, code FROM icd_index UNION ALL SELECT 'icd', en, code FROM icd_index UNION ALL SELECT 'rxnorm', str, rxcui FROM rxnorm_index) WHERE name <> ''",
    "link_exact": f"WITH {_mentions(T.DIAGNOSIS)}, {_EXACT} SELECT key, array_to_string(codes[1:3], '|') AS codes FROM men JOIN exact USING (key)",
    "link_hierarchy": f"WITH {_mentions(T.DIAGNOSIS)}, {_HIER} SELECT key, array_to_string(codes, '|') AS codes FROM hier",
    "link_relaxed": f"WITH {_mentions(T.DRUG)}, {_REL} SELECT key, array_to_string(codes[1:3], '|') AS codes FROM men JOIN rel ON k = {salts_sql('key')}",
    "link_cascade_icd": f"WITH {_mentions(T.DIAGNOSIS)}, {_HIER}, rest AS (SELECT key FROM men ANTI JOIN hier USING (key)), {_fuzzy('rest', _PAIRS, 0.62, False)}, fz AS (SELECT key, list(code ORDER BY rank) AS codes FROM ranked WHERE rank <= 3 GROUP BY key) "
    "SELECT men.key AS key, CASE WHEN hier.key IS NOT NULL THEN 'exact' WHEN fz.key IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS stage, array_to_string(coalesce(hier.codes, fz.codes, []), '|') AS codes FROM men LEFT JOIN hier USING (key) LEFT JOIN fz ON fz.key = men.key",
    "link_cascade_rx": f"WITH {_mentions(T.DRUG)}, ex AS (SELECT key, list_sort(list(DISTINCT code))[1:3] AS codes FROM men JOIN {_RX} USING (key) GROUP BY key), {_REL}, "
    f"rl AS (SELECT key, codes[1:3] AS codes FROM (SELECT key FROM men ANTI JOIN ex USING (key)) JOIN rel ON k = {salts_sql('key')}), rest AS (SELECT key FROM men ANTI JOIN ex USING (key) ANTI JOIN rl USING (key)), {_fuzzy('rest', _RX, 0.60, True)}, "
    "fz AS (SELECT key, list(code ORDER BY rank) AS codes FROM ranked WHERE rank <= 3 GROUP BY key) "
    "SELECT men.key AS key, CASE WHEN ex.key IS NOT NULL THEN 'exact' WHEN rl.key IS NOT NULL THEN 'relaxed' WHEN fz.key IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS stage, array_to_string(coalesce(ex.codes, rl.codes, fz.codes, []), '|') AS codes "
    "FROM men LEFT JOIN ex USING (key) LEFT JOIN rl ON rl.key = men.key LEFT JOIN fz ON fz.key = men.key",
    "link_fuzzy": f"WITH {_mentions(T.DRUG)}, {_fuzzy('men', _RX, 0.60, True)} SELECT key, code, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3",
    "trigram_candidates": f"WITH {_mentions(T.DRUG)}, eg AS (SELECT DISTINCT key AS ekey, unnest({grams_sql('key')}) AS gram FROM rxnorm_index), mg AS (SELECT key, unnest({grams_sql('key')}) AS gram FROM men), sh AS (SELECT key, ekey, count(*) AS shared FROM mg JOIN eg USING (gram) GROUP BY 1, 2) SELECT key, ekey, shared FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY shared DESC, ekey) AS r FROM sh) WHERE r <= 400",
    "link_explain": f"WITH {_mentions(T.DIAGNOSIS)}, " + _closest(tuple(f"(SELECT DISTINCT {c} AS key, code FROM icd_index WHERE {c} <> '')" for c in ("key_vn", "key_en")), _PAIRS, _ICD_NAMES, 5),
    "link_explain_rx": f"WITH {_mentions(T.DRUG)}, " + _closest((_RX,), _RX, f"SELECT rxcui AS code, name FROM ({_PREFERRED})", 6),
    "code_names": f"SELECT DISTINCT code, coalesce(name, '') AS name FROM (SELECT unnest(c.candidates) AS code FROM (SELECT unnest(concepts) AS c FROM out_docs) WHERE c.type = '{T.DRUG}') LEFT JOIN (SELECT rxcui AS code, name FROM ({_PREFERRED})) USING (code) WHERE code <> ''",
}
