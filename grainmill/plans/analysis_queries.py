"""Profiles, label association, two-sample tests and grouped ranking, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import ks, profile, ranking, sampling
from grainmill.operators.running import exact_quantiles, running_total
from grainmill.plans.common import CATS, DENSE, LABELLED, NUMS, dense, long_sql, r
from grainmill.session import table
from grainmill.sources.files import parse_sparse_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 1.0]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NUM_LAB = f"WITH {LABELLED}, l AS ({long_sql(NUMS, 'lab', 'yy')})"
_NUM_ALL = f"WITH {DENSE}, l AS ({long_sql(NUMS, 'dense')})"
_MOMENTS = """, m AS (SELECT feat_name, avg(v) AS mu FROM l GROUP BY 1),
c AS (SELECT l.feat_name, count(*) AS n_all, count(v) AS n, any_value(mu) AS mu, sum((v - mu) ** 2) AS m2, sum((v - mu) ** 3) AS m3, sum((v - mu) ** 4) AS m4 FROM l JOIN m USING (feat_name) GROUP BY 1)
SELECT feat_name, n_all AS count_all, n AS count_not_null, round(mu, 4) + 0.0 AS mean_val, round(sqrt(m2 / (n - 1)), 4) + 0.0 AS std_val,
  round(sqrt(n) * m3 / m2 ** 1.5, 5) + 0.0 AS skewness, round(n * m4 / (m2 * m2) - 3, 5) + 0.0 AS kurtosis FROM c"""


@query(_NUM_LAB + _MOMENTS)
def profile_num_moments(spark: SparkSession, d: str) -> DataFrame:
    p = profile.numeric_profile(dense(spark, d), NUMS, "label")
    return p.select("feat_name", "count_all", "count_not_null", r("mean_val", 4).alias("mean_val"), r("std_val", 4).alias("std_val"), r("skewness", 5).alias("skewness"), r("kurtosis", 5).alias("kurtosis"))


@query(_NUM_ALL + _MOMENTS)
def profile_num_nolabel(spark: SparkSession, d: str) -> DataFrame:
    p = profile.numeric_profile(dense(spark, d), NUMS)
    return p.select("feat_name", "count_all", "count_not_null", r("mean_val", 4).alias("mean_val"), r("std_val", 4).alias("std_val"), r("skewness", 5).alias("skewness"), r("kurtosis", 5).alias("kurtosis"))


@query(_NUM_LAB + " SELECT feat_name, round(corr(v, yy), 6) + 0.0 AS corr_label, -1.0 AS auc FROM l WHERE v IS NOT NULL GROUP BY 1")
def profile_num_label_corr(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_profile(dense(spark, d), NUMS, "label").select("feat_name", r("corr_label").alias("corr_label"), "auc")


@query(_NUM_LAB + ", s AS (SELECT *, CASE WHEN yy > 0.5 THEN 1 ELSE 0 END AS y, rank() OVER w + (count(*) OVER (PARTITION BY feat_name, v) - 1) / 2.0 AS rk FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY feat_name ORDER BY v)) SELECT feat_name, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) + 0.0 AS auc FROM s GROUP BY 1")
def profile_num_auc(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_auc(dense(spark, d), NUMS, "label").select("feat_name", r("auc").alias("auc"))


@query(_NUM_ALL + f", q AS (SELECT feat_name, unnest([{', '.join(map(str, PS))}]) AS p, unnest(quantile_disc(v, [{', '.join(map(str, PS))}])) AS v FROM l WHERE v IS NOT NULL GROUP BY 1) SELECT feat_name, CAST(p AS DOUBLE) AS p, v FROM q")
def profile_num_quantiles_exact(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feat_name"), profile.as_number(c).alias("v")) for c in NUMS])))
    return exact_quantiles(long, PS)


@query("SELECT feat_name, CAST(i AS INTEGER) AS percent, true AS within_bound FROM (SELECT unnest(['age', 'income', 'dwell_sec', 'bid']) AS feat_name), range(101) AS g(i)")
def profile_num_quantiles_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact ranks of each percentile's estimate are within the stated error."""
    df = dense(spark, d)
    est = profile.numeric_profile(df, NUMS).select(F.col("feat_name").alias("f"), F.posexplode("quantile_array").alias("percent", "q"))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feat_name"), profile.as_number(c).alias("v")) for c in NUMS]))).where("v IS NOT NULL")
    counts = long.groupBy("feat_name", "v").agg(F.count(F.lit(1)).alias("c"))
    ranks = running_total(counts, ["feat_name"], ["v"], {"before": "c"})
    n = counts.groupBy(F.col("feat_name").alias("g")).agg(F.sum("c").alias("n"))
    j = est.join(ranks, (F.col("f") == F.col("feat_name")) & (F.col("q") == F.col("v")), "left").join(n, F.col("f") == F.col("g"))
    slack, at = profile.RELATIVE_ERROR * F.col("n") + 1, F.col("percent") / 100 * F.col("n")
    within = (F.col("before") <= at + slack) & (F.col("before") + F.col("c") >= at - slack)
    return j.select(F.col("f").alias("feat_name"), "percent", F.coalesce(within, F.lit(False)).alias("within_bound"))


@query(_NUM_ALL + " SELECT feat_name, min(v) AS min_val, max(v) AS max_val FROM l GROUP BY 1")
def profile_num_minmax(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_profile(dense(spark, d), NUMS).select("feat_name", "min_val", "max_val")


@query(f"WITH {DENSE}, l AS ({long_sql(NUMS + CATS, 'dense', cast='VARCHAR')}) SELECT feat_name, count(*) AS count_all, count(v) AS count_not_null FROM l GROUP BY 1")
def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    cat, num = profile.fit_dense(dense(spark, d), CATS, NUMS)
    return cat.select("feat_name", "count_all", "count_not_null").unionByName(num.select("feat_name", "count_all", "count_not_null"))


@query(f"WITH {DENSE}, l AS ({long_sql(NUMS, 'dense')}) SELECT feat_name, round(var_pop(v), 3) + 0.0 AS var_pop, round(stddev_pop(v), 4) + 0.0 AS std_pop FROM l GROUP BY 1")
def profile_num_biased(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feat_name"), profile.as_number(c).alias("v")) for c in NUMS])))
    return long.groupBy("feat_name").agg(r(F.var_pop("v"), 3).alias("var_pop"), r(F.stddev_pop("v"), 4).alias("std_pop"))


_LEVELS = f"WITH {LABELLED}, l AS ({long_sql(CATS, 'lab', 'y')}), c AS (SELECT feat_name, v AS category, count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM l WHERE v IS NOT NULL GROUP BY 1, 2)"


@query(_LEVELS + ", k AS (SELECT *, row_number() OVER (PARTITION BY feat_name ORDER BY p / n DESC, category) AS pos FROM c) SELECT feat_name, category, n, p, CAST(pos AS INTEGER) AS pos FROM k WHERE pos <= 200")
def profile_cat_levels_label(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_levels(profile.level_counts(dense(spark, d), CATS, "label"), True)


@query(f"WITH {DENSE}, l AS ({long_sql(CATS, 'dense')}), c AS (SELECT feat_name, v AS category, count(*) AS n, CAST(-1 AS BIGINT) AS p FROM l WHERE v IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY feat_name ORDER BY n DESC, category) AS pos FROM c) SELECT feat_name, category, n, p, CAST(pos AS INTEGER) AS pos FROM k WHERE pos <= 200")
def profile_cat_levels_nolabel(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_levels(profile.level_counts(dense(spark, d), CATS), False)


@query(_LEVELS + ", g AS (SELECT feat_name, p / n AS rate, sum(p) AS p, sum(n - p) AS q FROM c GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY feat_name ORDER BY rate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT feat_name, round(sum(p * below + 0.5 * p * q) / (sum(p) * sum(q)), 6) + 0.0 AS auc FROM w GROUP BY 1")
def profile_cat_auc(spark: SparkSession, d: str) -> DataFrame:
    return profile.level_auc(profile.level_counts(dense(spark, d), CATS, "label")).select("feat_name", r("auc").alias("auc"))


@query(_LEVELS + ", s AS (SELECT l.feat_name, l.y, c.p / c.n AS rate FROM l JOIN c ON c.feat_name = l.feat_name AND c.category = l.v), k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY feat_name, rate) - 1) / 2.0 AS rk FROM s WINDOW w AS (PARTITION BY feat_name ORDER BY rate)) SELECT feat_name, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) + 0.0 AS auc FROM k GROUP BY 1")
def profile_cat_auc_ranksum(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d)
    levels = profile.level_counts(df, CATS, "label").select(F.col("feat_name").alias("f"), "category", (F.col("p") / F.col("n")).alias("rate"))
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feat_name"), F.col(c).alias("v")) for c in CATS])), "label")
    scored = rows.join(levels, (F.col("feat_name") == F.col("f")) & (F.col("v") == F.col("category"))).select("feat_name", "rate", profile.as_number("label").alias("y")).where("y IS NOT NULL")
    cells = scored.groupBy("feat_name", "rate").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") > 0.5).cast("int")).alias("p"))
    return profile._auc(cells).select("feat_name", r("auc").alias("auc"))


@query(_LEVELS + ", t AS (SELECT feat_name, sum(n) AS tn, sum(p) AS tp FROM c GROUP BY 1), e AS (SELECT feat_name, tn, p AS j, n, tp AS s FROM c JOIN t USING (feat_name) UNION ALL SELECT feat_name, tn, n - p, n, tn - tp FROM c JOIN t USING (feat_name)) SELECT feat_name, round(sum(CASE WHEN j > 0 THEN j / tn * log2(j * tn / (n * s)) ELSE 0 END), 6) + 0.0 AS mutual_information FROM e GROUP BY 1")
def profile_cat_mi(spark: SparkSession, d: str) -> DataFrame:
    return profile.level_mi(profile.level_counts(dense(spark, d), CATS, "label")).select("feat_name", r("mutual_information").alias("mutual_information"))


@query(f"WITH {DENSE} SELECT 'label' AS col_name, count(DISTINCT try_cast(label AS DOUBLE)) <= 2 AS is_binary FROM dense UNION ALL SELECT 'age', count(DISTINCT age) <= 2 FROM dense")
def profile_label_kind(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d)
    return spark.createDataFrame([(c, profile.is_binary(df, c)) for c in ("label", "age")], "col_name string, is_binary boolean")


_CAT_COUNTS = f"WITH {LABELLED}, l AS ({long_sql(CATS, 'lab', 'y')}) SELECT feat_name, count(*) AS count_all, count(v) AS count_not_null FROM l GROUP BY 1"


@query(f"SELECT feat_name, count_all, count_not_null, auc, mutual_information, category, n AS cnt, p AS positives FROM ({_CAT_COUNTS}) JOIN ({SQL['profile_cat_auc']}) USING (feat_name) JOIN ({SQL['profile_cat_mi']}) USING (feat_name) JOIN ({SQL['profile_cat_levels_label']}) USING (feat_name)")
def profile_category_summary(spark: SparkSession, d: str) -> DataFrame:
    p = profile.category_profile(dense(spark, d), CATS, "label")
    return p.select("feat_name", "count_all", "count_not_null", r("auc").alias("auc"), r("mutual_information").alias("mutual_information"), F.inline("concerned_categories")).withColumnRenamed("pos", "positives")


# ---- sparse rows ---------------------------------------------------------------------------------------------------------

_SCATS, _SNUMS = ["city", "os_name"], ["age", "income", "dwell_sec", "bid"]


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    """The sparse lines that parse, as maps."""
    lines = table(spark, d, "raw_samples").where("feed = 'sparse'").select("line_no", F.trim("line").alias("value"))
    return parse_sparse_lines(lines)


_SPARSE_KV = "kv AS (SELECT line_no, i, string_split(x, ':') AS p, x FROM (SELECT line_no, unnest(string_split(trim(line), ',')) AS x, generate_subscripts(string_split(trim(line), ','), 1) AS i FROM raw_samples WHERE feed = 'sparse'))"
_SPARSE = f"""{_SPARSE_KV},
last AS (SELECT line_no, p[1] AS k, arg_max(substr(x, length(p[1]) + 2), i) AS v FROM kv WHERE len(p) >= 2 GROUP BY 1, 2),
ids AS (SELECT line_no FROM raw_samples WHERE feed = 'sparse'),
wide AS (SELECT ids.line_no, {', '.join(f"max(v) FILTER (k = '{c}') AS {c}" for c in _SCATS)}, {', '.join(f"try_cast(max(v) FILTER (k = '{c}') AS DOUBLE) AS {c}" for c in _SNUMS + ['label'])} FROM ids LEFT JOIN last USING (line_no) GROUP BY 1)"""


def _sparse_levels(kind: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feat_name, {f'coalesce({c}, {chr(39)}<default>{chr(39)})' if kind == 'default' else c} AS v, CASE WHEN label > 0.5 THEN 1 ELSE 0 END AS y FROM wide WHERE label IS NOT NULL AND NOT isnan(label)" for c in _SCATS)
    return f"WITH {_SPARSE}, l AS ({parts}) SELECT feat_name, v AS category, count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM l WHERE v IS NOT NULL GROUP BY 1, 2"


@query(_sparse_levels("default"))
def sparse_default_levels(spark: SparkSession, d: str) -> DataFrame:
    return profile.level_counts(profile.sparse_to_dense(_sparse(spark, d), _SCATS, [], "label", "default"), _SCATS, "label")


@query(_sparse_levels("missing"))
def sparse_missing_levels(spark: SparkSession, d: str) -> DataFrame:
    return profile.level_counts(profile.sparse_to_dense(_sparse(spark, d), _SCATS, [], "label", "missing"), _SCATS, "label")


@query(f"WITH {_SPARSE}, l AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS feat_name, CASE WHEN isfinite({c}) THEN {c} END AS v FROM wide WHERE label IS NOT NULL AND NOT isnan(label)' for c in _SNUMS)}) SELECT feat_name, count(*) AS count_all, count(v) AS count_not_null, round(avg(v), 5) + 0.0 AS mean_val, round(stddev_samp(v), 5) + 0.0 AS std_val FROM l GROUP BY 1")
def sparse_num_moments(spark: SparkSession, d: str) -> DataFrame:
    df = profile.sparse_to_dense(_sparse(spark, d), [], _SNUMS, "label", "missing")
    inf = float("inf")
    finite = df.select("label", *[F.when(F.abs(F.col(c)) < inf, F.col(c)).alias(c) for c in _SNUMS])
    p = profile.numeric_profile(finite, _SNUMS, "label")
    return p.select("feat_name", "count_all", "count_not_null", r("mean_val", 5).alias("mean_val"), r("std_val", 5).alias("std_val"))


# ---- two-sample tests ----------------------------------------------------------------------------------------------------


def _loads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Odd and even loads as the two samples."""
    df = dense(spark, d).select("load_id", *[profile.as_number(c).alias(c) for c in NUMS])
    return df.where("load_id % 2 = 1"), df.where("load_id % 2 = 0")


_KS = f"""WITH {DENSE}, l AS ({long_sql(NUMS, 'dense', 'load_id % 2 AS a')}),
c AS (SELECT feat_name, v, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 0) AS n2 FROM l WHERE v IS NOT NULL GROUP BY 1, 2),
w AS (SELECT feat_name, sum(n1) OVER o AS c1, sum(n2) OVER o AS c2, sum(n1) OVER t AS n, sum(n2) OVER t AS m FROM c WINDOW o AS (PARTITION BY feat_name ORDER BY v), t AS (PARTITION BY feat_name)),
s AS (SELECT feat_name AS left_col, max(abs(c1 / n - c2 / m)) AS d, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(m) AS BIGINT) AS m FROM w GROUP BY 1)"""


@query(_KS + " SELECT left_col, round(d, 8) + 0.0 AS d, n, m FROM s")
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    a, b = _loads(spark, d)
    return ks.ks_statistic(a, b, [(c, c) for c in NUMS]).select("left_col", r("d", 8).alias("d"), "n", "m")


@query(_KS + ", t AS (SELECT *, d * sqrt(n * m / (n + m)) AS x FROM s), k AS (SELECT left_col, x, sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * x * x)) AS z FROM t, range(1, 2000) AS g(i) GROUP BY ALL) SELECT left_col, round(least(1.0, greatest(0.0, CASE WHEN x = 0 THEN 1.0 ELSE 2 * z END)), 8) + 0.0 AS p_value FROM k")
def ks_pvalue_asymptotic(spark: SparkSession, d: str) -> DataFrame:
    a, b = _loads(spark, d)
    return ks.ks_test(a, b, [(c, c) for c in NUMS]).select("left_col", r("p_value", 8).alias("p_value"))


@query("""WITH l AS (SELECT 'quantity' AS f, l_quantity AS v, l_linestatus = 'F' AS a FROM lineitem UNION ALL SELECT 'price', l_extendedprice, l_linestatus = 'F' FROM lineitem),
c AS (SELECT f, v, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2 FROM l GROUP BY 1, 2),
w AS (SELECT f, sum(n1) OVER o AS c1, sum(n2) OVER o AS c2, sum(n1) OVER t AS n, sum(n2) OVER t AS m FROM c WINDOW o AS (PARTITION BY f ORDER BY v), t AS (PARTITION BY f))
SELECT CASE f WHEN 'quantity' THEN 'l_quantity' ELSE 'l_extendedprice' END AS left_col, round(max(abs(c1 / n - c2 / m)), 8) + 0.0 AS d, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(m) AS BIGINT) AS m FROM w GROUP BY 1""")
def ks_multi_column(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    out = ks.ks_statistic(li.where("l_linestatus = 'F'"), li.where("l_linestatus <> 'F'"), [("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice")])
    return out.select("left_col", r("d", 8).alias("d"), "n", "m")


@query("""WITH x AS (SELECT CAST(n_nationkey AS DOUBLE) AS v, 1 AS a, 0 AS b FROM nation UNION ALL SELECT n_nationkey * 1.37 + 3.1, 0, 1 FROM nation),
w AS (SELECT sum(a) OVER o AS ca, sum(b) OVER o AS cb FROM x WINDOW o AS (ORDER BY v)),
s AS (SELECT max(abs(ca - cb)) AS far, (SELECT count(*) FROM nation) AS n FROM w),
t AS (SELECT n, far, unnest(range(1, n + 1)) AS j FROM s)
SELECT round(any_value(far / n), 8) + 0.0 AS d, round(2 * sum(CASE WHEN j * (far + 1) > n THEN 0 ELSE CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(2 * lgamma(n + 1) - lgamma(greatest(n - j * (far + 1), 0) + 1) - lgamma(n + j * (far + 1) + 1)) END), 8) + 0.0 AS p_value FROM t""")
def ks_pvalue_exact(spark: SparkSession, d: str) -> DataFrame:
    """Two samples of equal size without ties, for which the exact law has a closed form."""
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("x"))
    b = table(spark, d, "nation").select((F.col("n_nationkey") * 1.37 + 3.1).alias("x"))
    return ks.ks_test(a, b, [("x", "x")]).select(r("d", 8).alias("d"), r("p_value", 8).alias("p_value"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def take_first(spark: SparkSession, d: str) -> DataFrame:
    return sampling.take_first(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, [F.col("o_totalprice").desc(), "o_orderkey"])


@query("SELECT least(500, count(*)) AS n, least(500, count(*)) AS n_distinct, least(500, count(*)) AS n_of_table FROM orders")
def take_sample(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn, different keys among them, and how many of them the table has."""
    orders = table(spark, d, "orders").select("o_orderkey")
    drawn = sampling.take_sample(orders, 500, ["o_orderkey"])
    of_table = drawn.join(orders.select(F.col("o_orderkey").alias("k")).distinct(), F.col("o_orderkey") == F.col("k"), "left")
    return of_table.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_distinct"), F.count("k").alias("n_of_table"))


# ---- grouped ranking -----------------------------------------------------------------------------------------------------

_FEATS, _KS_AT = ["score", "margin"], [1, 3, 5]
_RANK = """WITH x AS (SELECT coalesce(group_key, 'null') AS grp, label AS y, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, CASE WHEN isnan(margin) THEN NULL ELSE margin END AS margin FROM ranked_scores),
l AS (SELECT grp, y, 'score' AS feat_name, score AS v FROM x UNION ALL SELECT grp, y, 'margin', margin FROM x)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ranked_scores").select("group_key", "label", *[profile.as_number(c).alias(c) for c in _FEATS])


# the pairs of the hottest group are too many to list in SQL, so ranks stand for them there as well
_PAIRS = _RANK + """, c AS (SELECT feat_name, grp, v, y, count(*) AS n FROM l WHERE y IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
b AS (SELECT a.feat_name, a.grp, a.v, a.y, a.n, o.y AS y2 FROM c a JOIN (SELECT DISTINCT feat_name, grp, y FROM c) o ON o.feat_name = a.feat_name AND o.grp = a.grp),
u AS (SELECT feat_name, grp, v, y2, sum(n) FILTER (y = y2) AS own, sum(n) FILTER (y > y2) AS above, sum(n) FILTER (y < y2) AS under FROM b GROUP BY ALL),
w AS (SELECT *, sum(own) OVER (PARTITION BY feat_name, grp, y2 ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u),
s AS (SELECT feat_name, CAST(coalesce(sum(before * above), 0) AS BIGINT) AS concordant, CAST(coalesce(sum(before * under), 0) AS BIGINT) AS discordant FROM w GROUP BY 1)"""


@query(_PAIRS + " SELECT feat_name, concordant, discordant FROM s")
def group_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pair_counts(_scores(spark, d), "label", "group_key", _FEATS)


@query(_PAIRS + " SELECT feat_name, round(CASE WHEN discordant = 0 THEN -1.0 ELSE concordant / discordant END, 8) + 0.0 AS pair_rate FROM s")
def group_reverse_pair_rate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pair_rate(ranking.pair_counts(_scores(spark, d), "label", "group_key", _FEATS)).select("feat_name", r("pair_rate", 8).alias("pair_rate"))


@query("""WITH x AS (SELECT l_orderkey AS g, l_linenumber % 5 AS y, l_discount AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
p AS (SELECT sign((a.y - b.y) * (a.v - b.v)) AS s FROM x a JOIN x b ON a.g = b.g AND a.i < b.i)
SELECT 'l_discount' AS feat_name, count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant FROM p""")
def group_pairs_small_groups(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 5).alias("y"), "l_discount")
    return ranking.pair_counts(li, "y", "l_orderkey", ["l_discount"])


def _ndcg_sql(ks_at: list[int], gain: str) -> str:
    dcg = lambda alias, rn, n: ", ".join(f"coalesce(sum(CASE WHEN {rn} <= {k} AND {n} >= {k} THEN ({gain}) / log2({rn} + 1) ELSE 0 END), 0) AS {alias}{k}" for k in ks_at)
    cells = " UNION ALL ".join(f"SELECT grp, feat_name, {k} AS k, CASE WHEN coalesce(n_all, 0) < {min(ks_at)} OR coalesce(i{k}, 0) = 0 THEN 0.0 ELSE coalesce(d{k}, 0) / i{k} END AS nd, CASE WHEN coalesce(n_all, 0) < {min(ks_at)} OR coalesce(i{k}, 0) = 0 THEN 0.0 ELSE coalesce(a{k}, 0) / i{k} END AS na FROM j" for k in ks_at)
    return f"""{_RANK},
f AS (SELECT *, row_number() OVER (PARTITION BY feat_name, grp ORDER BY y DESC) AS ri, count(*) OVER (PARTITION BY feat_name, grp) AS n_all, count(v) OVER (PARTITION BY feat_name, grp) AS n_v FROM l WHERE y IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY feat_name, grp ORDER BY v DESC, y DESC) AS rd, row_number() OVER (PARTITION BY feat_name, grp ORDER BY v, y DESC) AS ra FROM f WHERE v IS NOT NULL),
i AS (SELECT feat_name, grp, any_value(n_all) AS n_all, {dcg('i', 'ri', 'n_all')} FROM f GROUP BY 1, 2),
e AS (SELECT feat_name, grp, {dcg('d', 'rd', 'n_v')}, {dcg('a', 'ra', 'n_v')} FROM h GROUP BY 1, 2),
g AS (SELECT DISTINCT grp, feat_name FROM l),
j AS (SELECT * FROM g LEFT JOIN i USING (grp, feat_name) LEFT JOIN e USING (grp, feat_name)),
z AS ({cells})"""


_GAIN = "CASE y WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 15 ELSE 0 END"


@query(_ndcg_sql(_KS_AT, _GAIN) + " SELECT grp, feat_name, k, round(nd, 6) + 0.0 AS ndcg_desc, round(na, 6) + 0.0 AS ndcg_asc FROM z")
def group_dcg(spark: SparkSession, d: str) -> DataFrame:
    per = ranking.group_ndcg(_scores(spark, d), "label", "group_key", _FEATS, _KS_AT)
    return per.select("grp", "feat_name", "k", r("ndcg_desc").alias("ndcg_desc"), r("ndcg_asc").alias("ndcg_asc"))


@query(_ndcg_sql(_KS_AT, _GAIN) + " SELECT feat_name, 'ndcg' || k AS metric, round(greatest(avg(nd), avg(na)), 6) + 0.0 AS ndcg FROM z GROUP BY feat_name, k")
def group_ndcg(spark: SparkSession, d: str) -> DataFrame:
    rep = ranking.ndcg_report(ranking.group_ndcg(_scores(spark, d), "label", "group_key", _FEATS, _KS_AT))
    return rep.select("feat_name", "metric", r("ndcg").alias("ndcg"))


@query(_ndcg_sql([2, 4], "CASE WHEN y >= 0 THEN 2 * y + 1 ELSE 0 END") + " SELECT feat_name, 'ndcg' || k AS metric, round(greatest(avg(nd), avg(na)), 6) + 0.0 AS ndcg FROM z GROUP BY feat_name, k")
def group_ndcg_custom_gain(spark: SparkSession, d: str) -> DataFrame:
    rep = ranking.ndcg_report(ranking.group_ndcg(_scores(spark, d), "label", "group_key", _FEATS, [2, 4], gains=lambda x: 2 * x + 1))
    return rep.select("feat_name", "metric", r("ndcg").alias("ndcg"))


@query(f"SELECT feat_name, pair_rate, metric, ndcg FROM ({SQL['group_reverse_pair_rate']}) JOIN ({SQL['group_ndcg']}) USING (feat_name)")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    s = ranking.fit_dense_grouped(_scores(spark, d), "label", "group_key", _FEATS, _KS_AT)
    return s.select("feat_name", r("pair_rate", 8).alias("pair_rate"), F.explode("ndcg").alias("metric", "v")).select("feat_name", "pair_rate", "metric", r("v").alias("ndcg"))
