"""Queries p1 and p2 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import badrows, quality
from grainmill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.failed_lines(table(spark, d, "raw_samples")).select("line_no", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The usable lines, one row a feature in the order of the line (one row without a feature where a line has none)."""
    lists = {"names": "string", "texts": "string", "fields": "bigint", "ids": "bigint", "vals": "double"}
    rows = badrows.loaded_lines(table(spark, d, "raw_samples"))
    zipped = F.arrays_zip(*[F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c) for c, t in lists.items()])
    long = rows.select("line_no", "feed", "label", F.posexplode_outer(zipped).alias("pos", "f"))
    return long.select("line_no", "feed", "label", "pos", F.col("f.names").alias("name"), F.col("f.texts").alias("text"), F.col("f.fields").alias("field"), F.col("f.ids").alias("id"), F.col("f.vals").alias("val"))


def _rules(spark: SparkSession, d: str) -> list[quality.ColumnRule]:
    return quality.rules_from_tables(table(spark, d, "feature_schema"), table(spark, d, "num_summary"), table(spark, d, "cat_summary"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.load_findings(table(spark, d, "dense_samples"), _rules(spark, d)).select("load_id", "col_name", "issue")


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.profile_loads(table(spark, d, "dense_samples"), _rules(spark, d))


def p2_drift(spark: SparkSession, d: str) -> DataFrame:
    return quality.load_drift(table(spark, d, "dense_samples"), _rules(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_loaded, p2_found, p2_profile, p2_drift)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TEXTS = ("user_key", "label", "city", "os_name", "device_code", "ad_slot", "tags")
_NUMS = ("age", "income", "dwell_sec", "bid")


def _long() -> str:
    parts = [f"SELECT load_id, '{c}' AS col_name, CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS num, CAST(NULL AS VARCHAR) AS text FROM dense_samples" for c in _NUMS]
    parts += [f"SELECT load_id, '{c}', NULL, nullif(nullif(trim({c}, {_BLANKS}), ''), '\\N') FROM dense_samples" for c in _TEXTS]
    return " UNION ALL ".join(parts)


_FOUND = f"""
WITH v AS ({_long()}),
tr AS (
  SELECT feat_name, 1 - count_not_null / count_all AS miss, quantile_array[26] AS q25, quantile_array[76] AS q75 FROM num_summary
  UNION ALL SELECT feat_name, 1 - count_not_null / count_all, NULL, NULL FROM cat_summary),
lv AS (SELECT feat_name, unnest(concerned_categories).category AS level FROM cat_summary WHERE feat_name IN ('city', 'os_name')),
j AS (
  SELECT v.*, s.lo_val, s.hi_val, s.val_regex, tr.miss, tr.q25, tr.q75, l.level
  FROM v JOIN feature_schema s ON s.feat_name = v.col_name JOIN tr ON tr.feat_name = v.col_name
  LEFT JOIN lv l ON l.feat_name = v.col_name AND l.level = v.text),
a AS (
  SELECT load_id, col_name, count(*) AS n, count(num) + count(text) AS nn, any_value(miss) AS miss,
    count(*) FILTER (num < lo_val OR num > hi_val) AS outside,
    count(*) FILTER (val_regex IS NOT NULL AND text IS NOT NULL AND NOT regexp_full_match(text, val_regex)) AS unmatched,
    count(*) FILTER (text IS NOT NULL AND level IS NULL) AS unknown,
    quantile_disc(num, 0.5) AS med, any_value(q25) AS q25, any_value(q75) AS q75,
    count(DISTINCT num) + count(DISTINCT text) AS nd
  FROM j GROUP BY 1, 2)
SELECT load_id, col_name, 'nulls' AS issue FROM a WHERE 1 - nn / n > miss + 0.10
UNION ALL SELECT load_id, col_name, 'range' FROM a WHERE outside > 0
UNION ALL SELECT load_id, col_name, 'pattern' FROM a WHERE unmatched > 0.01 * nn
UNION ALL SELECT load_id, col_name, 'shift' FROM a WHERE med < q25 OR med > q75
UNION ALL SELECT load_id, col_name, 'levels' FROM a WHERE col_name IN ('city', 'os_name') AND unknown > 0.10 * nn
UNION ALL SELECT load_id, col_name, 'stuck' FROM a WHERE nn >= 20 AND nd = 1"""

_FIELD = r'(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)'
_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"

SQL: dict[str, str] = {
    "p2_found": _FOUND,
    "p2_profile": f"""
SELECT load_id, col_name, count(*) AS count_all, count(num) + count(text) AS count_not_null, count(DISTINCT num) + count(DISTINCT text) AS n_distinct,
  min(num) AS min_val, max(num) AS max_val, min(text) AS min_text, max(text) AS max_text
FROM ({_long()}) GROUP BY 1, 2""",
}
SQL["p1_found"] = rf"""
WITH l AS (SELECT line_no, feed, coalesce(trim(line, {_BLANKS}), '') AS s FROM raw_samples),
c AS (
  SELECT line_no, s, regexp_full_match(s, '{_FIELD}(,{_FIELD})*') AS quoted_ok,
    regexp_full_match(s, '{_FIELD}(,{_FIELD}){{6}}') AS seven,
    list_transform([regexp_extract(s, '^{_FIELD},({_FIELD})', 1), regexp_extract(s, '^(?:{_FIELD},){{2}}({_FIELD})', 1), regexp_extract(s, '^(?:{_FIELD},){{3}}({_FIELD})', 1)],
      lambda x: trim(trim(x, {_BLANKS}), '"' || {_BLANKS})) AS f
  FROM l WHERE feed = 'csv'),
p AS (SELECT line_no, feed, s, string_split(s, ',') AS e FROM l WHERE feed = 'sparse'),
q AS (
  SELECT line_no, s, list_transform(e, lambda x: list_transform(string_split(x, ':'), lambda y: trim(y, {_BLANKS}))) AS kv FROM p),
i AS (SELECT line_no, feed, s, string_split_regex(s, '[ \t]+') AS t, CASE feed WHEN 'libsvm' THEN 2 ELSE 3 END AS w FROM l WHERE feed IN ('libsvm', 'libffm')),
k AS (SELECT *, list_transform(t[2:], lambda x: string_split(x, ':')) AS parts FROM i)
SELECT line_no, reason FROM (
  SELECT line_no, CASE
    WHEN NOT quoted_ok THEN 'quotes' WHEN s = '' OR NOT seven THEN 'columns'
    WHEN f[1] NOT IN ('', '\N') AND NOT (regexp_full_match(f[1], '{_NUM}') AND coalesce(try_cast(f[1] AS DOUBLE) IN (-1, 0, 1), false)) THEN 'label'
    WHEN NOT (f[2] IN ('', '\N') OR (regexp_full_match(f[2], '{_NUM}') AND isfinite(try_cast(f[2] AS DOUBLE)))) OR NOT (f[3] IN ('', '\N') OR (regexp_full_match(f[3], '{_NUM}') AND isfinite(try_cast(f[3] AS DOUBLE)))) THEN 'features' END AS reason FROM c
  UNION ALL SELECT line_no, CASE
    WHEN s = '' OR len(list_filter(kv, lambda x: len(x) <> 2)) > 0 THEN 'columns'
    WHEN coalesce(len(list_filter(kv, lambda x: x[1] = 'label')), 0) = 0 OR NOT (regexp_full_match(list_filter(kv, lambda x: x[1] = 'label')[1][2], '{_NUM}') AND coalesce(try_cast(list_filter(kv, lambda x: x[1] = 'label')[1][2] AS DOUBLE) IN (-1, 0, 1), false)) THEN 'label'
    WHEN len(list_filter(kv, lambda x: x[1] IN ('age', 'income', 'dwell_sec', 'bid') AND NOT (regexp_full_match(x[2], '{_NUM}') AND isfinite(try_cast(x[2] AS DOUBLE))))) > 0 THEN 'features' END FROM q
  UNION ALL SELECT line_no, CASE
    WHEN s = '' OR len(parts) = 0 OR len(list_filter(parts, lambda x: len(x) <> w)) > 0 THEN 'columns'
    WHEN NOT (regexp_full_match(t[1], '{_NUM}') AND coalesce(try_cast(t[1] AS DOUBLE) IN (-1, 0, 1), false)) THEN 'label'
    WHEN len(list_filter(parts, lambda x: NOT (regexp_full_match(x[w], '{_NUM}') AND isfinite(try_cast(x[w] AS DOUBLE))) OR NOT regexp_full_match(x[1], '[0-9]+') OR try_cast(x[1] AS BIGINT) IS NULL OR NOT regexp_full_match(x[w - 1], '[0-9]+') OR try_cast(x[w - 1] AS BIGINT) IS NULL)) > 0 THEN 'features' END FROM k)
WHERE reason IS NOT NULL"""

_TRIMMED = lambda x: f"trim({x}, {_BLANKS})"
_UNQUOTED = lambda x: f"nullif(nullif(CASE WHEN starts_with({_TRIMMED(x)}, chr(34)) THEN {_TRIMMED(f'replace(substr({_TRIMMED(x)}, 2, length({_TRIMMED(x)}) - 2), chr(34) || chr(34), chr(34))')} ELSE {_TRIMMED(x)} END, ''), '\\N')"
_AT = lambda i: _UNQUOTED(f"regexp_extract(s, '^(?:{_FIELD},){{{{{i}}}}}({_FIELD})', 1)".replace("{{", "{").replace("}}", "}"))
_NAMES = ((0, "user_key"), (2, "age"), (3, "income"), (4, "city"), (5, "tags"), (6, "note"))
SQL["p1_loaded"] = rf"""
WITH good AS (SELECT line_no, feed, {_TRIMMED('line')} AS s FROM raw_samples WHERE line_no NOT IN (SELECT line_no FROM ({SQL["p1_found"]}))),
c AS (SELECT line_no, feed, CAST({_AT(1)} AS DOUBLE) AS label, unnest([{', '.join(f"{{'pos': {p}, 'name': '{n}', 'text': {_AT(i)}}}" for p, (i, n) in enumerate(_NAMES))}]) AS x FROM good WHERE feed = 'csv'),
q AS (SELECT line_no, feed, list_transform(string_split(s, ','), lambda e: list_transform(string_split(e, ':'), lambda y: trim(y, {_BLANKS}))) AS kv FROM good WHERE feed = 'sparse'),
r AS (SELECT line_no, feed, CAST(list_filter(kv, lambda e: e[1] = 'label')[1][2] AS DOUBLE) AS label, list_filter(kv, lambda e: e[1] <> 'label') AS kv FROM q),
i AS (SELECT line_no, feed, string_split_regex(s, '[ \t\n\r\f\v]+') AS t, CASE feed WHEN 'libsvm' THEN 2 ELSE 3 END AS w FROM good WHERE feed IN ('libsvm', 'libffm')),
j AS (SELECT line_no, feed, w, CAST(t[1] AS DOUBLE) AS label, unnest(range(1, len(t))) AS k, t FROM i),
f AS (SELECT line_no, feed, w, label, k, string_split(t[k + 1], ':') AS p FROM j)
SELECT line_no, feed, label, x.pos AS pos, x.name AS name, x.text AS text, CAST(NULL AS BIGINT) AS field, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS val FROM c
UNION ALL SELECT line_no, feed, label, CAST(k - 1 AS INTEGER), kv[k][1], nullif(nullif(kv[k][2], ''), '\N'), NULL, NULL, NULL FROM (SELECT *, unnest(range(1, len(kv) + 1)) AS k FROM r)
UNION ALL SELECT line_no, feed, label, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE len(kv) = 0
UNION ALL SELECT line_no, feed, label, CAST(k - 1 AS INTEGER), NULL, NULL, CASE WHEN w = 3 THEN CAST(p[1] AS BIGINT) END, CAST(p[w - 1] AS BIGINT), CAST(p[w] AS DOUBLE) FROM f"""
