"""Queries of problem 2 and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested
from ..session import table


def _rows(spark, sf_dir, attributes=False):
    return nested.flat_rows(*(table(spark, sf_dir, t) for t in ("unified", "out_docs", "raw_annot")), attributes)


def _related(name):
    def query(spark, sf_dir):
        return nested.related(_rows(spark, sf_dir, True), name)

    return query


def p2_found(spark, sf_dir):
    """(tbl, rec_key, span_no, leaf, leaf_no, leaf_value): every span, assertion and candidate."""
    return _rows(spark, sf_dir).select("tbl", "rec_key", "span_no", "leaf", F.col("leaf_no").cast("int").alias("leaf_no"), "leaf_value")


def p2_variants(spark, sf_dir):
    """Rows and records by table, variant and subtype."""
    r = _rows(spark, sf_dir).where("leaf = 'span'")
    return r.groupBy("tbl", "variant", "subtype").agg(F.count("*").alias("n_items"), F.count_distinct("rec_key").alias("n_records"))


def p2_typed(spark, sf_dir):
    """The rows of the two typed tables only, which SQL can state."""
    u = nested.flatten_typed(table(spark, sf_dir, "unified"), "rec_id", "spans", nested.SPAN).withColumn("tbl", F.lit("unified"))
    o = nested.flatten_typed(table(spark, sf_dir, "out_docs"), "out_id", "concepts", nested.CONCEPT).withColumn("tbl", F.lit("out_docs"))
    return u.unionByName(o).select("tbl", "rec_key", "span_no", "leaf", "leaf_no", "leaf_value")


def p2_typed_items(spark, sf_dir):
    """The items of the two typed tables with their attributes, which SQL can state."""
    rows = _rows(spark, sf_dir, True).where("tbl <> 'raw_annot' AND leaf = 'span'")
    place = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("start", "end")]
    return rows.select("tbl", "rec_key", "span_no", *place, "text", "fine", "coarse", "type")


QUERIES = {"p2_found": p2_found, "p2_variants": p2_variants, "p2_typed": p2_typed, "p2_typed_items": p2_typed_items, **{f"p2_{n}": _related(n) for n in nested.TABLES}}

_TYPED = """
WITH recs AS (
  SELECT DISTINCT 'unified' AS tbl, rec_id AS rec_key, list_transform(spans, lambda s: CASE WHEN s IS NULL THEN NULL ELSE {'a': s.assertions, 'c': s.candidates} END) AS items FROM unified
  UNION ALL
  SELECT DISTINCT 'out_docs', out_id, list_transform(concepts, lambda s: CASE WHEN s IS NULL THEN NULL ELSE {'a': s.assertions, 'c': s.candidates} END) FROM out_docs
), it AS (
  SELECT tbl, rec_key, CAST(i - 1 AS INTEGER) AS span_no, items[i] AS item FROM (SELECT tbl, rec_key, items, unnest(range(1, len(items) + 1)) AS i FROM recs)
  WHERE items[i] IS NOT NULL
), leafs AS (
  SELECT tbl, rec_key, span_no, 'span' AS leaf, 0 AS leaf_no, '' AS leaf_value FROM it
  UNION ALL
  SELECT tbl, rec_key, span_no, 'assertion', CAST(j - 1 AS INTEGER), item.a[j] FROM (SELECT *, unnest(range(1, len(item.a) + 1)) AS j FROM it) WHERE item.a[j] IS NOT NULL AND item.a[j] <> ''
  UNION ALL
  SELECT tbl, rec_key, span_no, 'candidate', CAST(j - 1 AS INTEGER), item.c[j] FROM (SELECT *, unnest(range(1, len(item.c) + 1)) AS j FROM it) WHERE item.c[j] IS NOT NULL AND item.c[j] <> ''
)
SELECT tbl, rec_key, span_no, leaf, CAST(leaf_no AS INTEGER) AS leaf_no, leaf_value FROM leafs
"""
SQL = {
    "p2_typed": _TYPED,
    "p2_typed_items": """WITH u AS (SELECT DISTINCT rec_id, spans, unnest(range(1, len(spans) + 1)) AS i FROM (SELECT DISTINCT rec_id, spans FROM unified)), o AS (SELECT out_id, concepts, unnest(range(1, len(concepts) + 1)) AS i FROM (SELECT DISTINCT out_id, concepts FROM out_docs))
SELECT 'unified' AS tbl, rec_id AS rec_key, CAST(i - 1 AS INTEGER) AS span_no, coalesce(spans[i].start, -1) AS start, coalesce(spans[i]."end", -1) AS "end", spans[i].text AS text, spans[i].fine AS fine, spans[i].coarse AS coarse, CAST(NULL AS VARCHAR) AS type FROM u WHERE spans[i] IS NOT NULL
UNION ALL SELECT 'out_docs', out_id, CAST(i - 1 AS INTEGER), coalesce(concepts[i].position[1], -1), coalesce(concepts[i].position[2], -1), concepts[i].text, NULL, NULL, concepts[i].type FROM o WHERE concepts[i] IS NOT NULL""",
}
