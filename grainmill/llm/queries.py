"""Queries p3 to p8 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import heavy, leakage, packing, quantiles, splitting, terms
from grainmill.session import clean, table

MIN_SHARE = 0.005


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    feats = heavy.heavy_items(table(spark, d, "sample_features"), {"feat": F.col("feat")}, MIN_SHARE)
    slots = heavy.heavy_items(table(spark, d, "dense_samples"), {"ad_slot": clean("ad_slot")}, MIN_SHARE)
    return feats.unionByName(slots)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _heavy(spark, d).select("col_name", "item")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return _heavy(spark, d).select("col_name", "item", "n", "total")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.groups_reaching(table(spark, d, "ranked_scores"), "group_key", "score", [("median", 0.5, 100.0), ("p95", 0.95, 1000.0)], 50)


def p4_load_sketches(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.load_sketches(table(spark, d, "ranked_scores"), "group_key", "load_id", "score")


def p4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.group_quantiles(p4_load_sketches(spark, d), "group_key")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "dense_samples")
    records = df.select("sample_id").where("sample_id IS NOT NULL").distinct().count()
    return terms.mark_terms(terms.term_counts(df, "sample_id", ["ad_slot"], ["tags"]), records)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark IS NOT NULL").select("feat_name", "category", "mark")


def p5_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_containers(spark, d).where("n_pieces > 1").select("doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pieces(spark, d).where("piece = 1").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_found, p3_counts, p4_found, p4_load_sketches, p4_quantiles, p5_found, p5_term_counts, p6_found, p6_containers, p7_found, p7_leaks, p8_found, p8_pieces)
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _clean(c: str) -> str:
    return f"nullif(nullif(trim({c}, {_BLANKS}), ''), '\\N')"


_HEAVY = f"""
WITH v AS (
  SELECT 'feat' AS col_name, CAST(feat AS VARCHAR) AS item FROM sample_features
  UNION ALL SELECT 'ad_slot', {_clean("ad_slot")} FROM dense_samples),
t AS (SELECT col_name, count(item) AS total FROM v GROUP BY 1),
c AS (SELECT col_name, item, count(*) AS n FROM v WHERE item IS NOT NULL GROUP BY 1, 2)
SELECT {{cols}} FROM c JOIN t USING (col_name) WHERE n >= 0.005 * total"""

_SCORES = "SELECT group_key, score FROM ranked_scores WHERE score IS NOT NULL AND NOT isnan(score)"

_TERMS = f"""
WITH o AS (
  SELECT 'ad_slot' AS feat_name, {_clean("ad_slot")} AS category, sample_id FROM dense_samples
  UNION ALL SELECT 'tags', {_clean("x")}, sample_id FROM (SELECT unnest(string_split({_clean("tags")}, ',')) AS x, sample_id FROM dense_samples)),
c AS (SELECT feat_name, category, count(*) AS n_occurrences, count(DISTINCT sample_id) AS n_records FROM o WHERE category IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.2 * (SELECT count(DISTINCT sample_id) FROM dense_samples) THEN 'common' END AS mark FROM c)"""

SQL: dict[str, str] = {
    "p3_found": _HEAVY.format(cols="col_name, item"),
    "p3_counts": _HEAVY.format(cols="col_name, item, n, total"),
    "p4_found": f"""
WITH g AS (SELECT group_key, quantile_disc(score, 0.5) AS m, quantile_disc(score, 0.95) AS p FROM ({_SCORES}) GROUP BY 1 HAVING count(*) >= 50)
SELECT group_key, 'median' AS stat FROM g WHERE m >= 100 UNION ALL SELECT group_key, 'p95' FROM g WHERE p >= 1000""",
    "p5_found": _TERMS + " SELECT feat_name, category, mark FROM m WHERE mark IS NOT NULL",
    "p5_term_counts": _TERMS + " SELECT feat_name, category, n_occurrences, n_records, mark FROM m",
}
