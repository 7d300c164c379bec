"""What the query modules share: rounding that both engines agree on, dense samples with their strings cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import clean, clean_num, table

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NUMS, CATS = ["age", "income", "dwell_sec", "bid"], ["city", "os_name", "ad_slot"]


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def sql_clean(c: str) -> str:
    return f"nullif(nullif(trim({c}, {BLANKS}), ''), '\\N')"


def dense(spark: SparkSession, d: str) -> DataFrame:
    """dense_samples with blanks around strings removed and missing strings NULL."""
    df = table(spark, d, "dense_samples")
    return df.select("sample_id", "load_id", *[clean_num(c).alias(c) for c in NUMS], *[clean(c).alias(c) for c in ("user_key", "label", "city", "os_name", "device_code", "ad_slot", "tags")])


#: The same as a common table expression.
DENSE = "dense AS (SELECT sample_id, load_id, " + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in NUMS) + ", " + ", ".join(f"{sql_clean(c)} AS {c}" for c in ("user_key", "label", "city", "os_name", "device_code", "ad_slot", "tags")) + " FROM dense_samples)"
#: Rows with a label only, y in {0, 1} for any number.
LABELLED = DENSE + ", lab AS (SELECT *, try_cast(label AS DOUBLE) AS yy, CASE WHEN try_cast(label AS DOUBLE) > 0.5 THEN 1 ELSE 0 END AS y FROM dense WHERE try_cast(label AS DOUBLE) IS NOT NULL)"


def long_sql(cols: list[str], source: str, extra: str = "", cast: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feat_name, {f'CAST({c} AS {cast})' if cast else c} AS v{', ' + extra if extra else ''} FROM {source}" for c in cols)
