"""Column profiles of dense and sparse tables, with and without a label.

Numeric features: counts, mean, unbiased std, population skewness and excess kurtosis, quantiles, correlation with the label.
Categorical features: counts, most frequent or most positive levels, AUC and mutual information with the label.
Rules: rows without a label are left out and not counted when there is a label; NULL and NaN numbers are left out of every
statistic; a label is positive above 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.running import exact_quantiles, running_total

PERCENTAGES = [i / 100 for i in range(101)]
#: Levels listed per feature; rank error of approximate quantiles; level that stands for an absent key of a sparse row.
TOP_LEVELS, RELATIVE_ERROR, DEFAULT_LEVEL = 200, 5e-4, "<default>"


def as_number(c: Column | str) -> Column:
    """A double; NULL for what isn't a number, and for NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def is_binary(df: DataFrame, label: str) -> bool:
    """At most two distinct labels, over all rows; stops as soon as a third is found."""
    return df.select(as_number(label).alias("y")).where("y IS NOT NULL").distinct().limit(3).count() <= 2


def _labelled(df: DataFrame, label: str | None) -> DataFrame:
    if label is None:
        return df.withColumn("__y", F.lit(None).cast("double"))
    return df.withColumn("__y", as_number(label)).where("__y IS NOT NULL")


def numeric_profile(df: DataFrame, nums: list[str], label: str | None = None, percentages: list[float] | None = None, relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """One row per feature: feat_name, count_all, count_not_null, mean_val, std_val, skewness, kurtosis, min_val, max_val, median_val,
    quantile_array, corr_label (NULL without a label), auc (-1, not defined for numbers).

    One pass, one aggregation of fixed-size buffers; relative_error = 0 replaces the sketch by exact quantiles (a second pass).
    A feature without values has NULL statistics; an empty table gives one row per feature with zero counts.
    """
    ps = percentages if percentages is not None else PERCENTAGES
    src = _labelled(df, label).select("__y", *[as_number(c).alias(f"x{i}") for i, c in enumerate(nums)])
    acc = max(1, round(1 / relative_error)) if relative_error else None
    aggs: list[Column] = []
    for i, c in enumerate(nums):
        x = F.col(f"x{i}")
        q = F.percentile_approx(x, [0.5, *ps], acc) if acc else F.lit(None).cast("array<double>")
        aggs.append(
            F.struct(
                F.lit(c).alias("feat_name"), F.count(F.lit(1)).alias("count_all"), F.count(x).alias("count_not_null"), F.avg(x).alias("mean_val"), F.stddev_samp(x).alias("std_val"),
                F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), F.min(x).alias("min_val"), F.max(x).alias("max_val"), q.alias("q"),
                (F.corr(x, "__y") if label else F.lit(None).cast("double")).alias("corr_label"), F.lit(-1.0).alias("auc"),
            )
        )
    wide = src.agg(F.array(*aggs).alias("r")).select(F.inline("r"))
    if acc:
        return wide.withColumn("median_val", F.element_at("q", 1)).withColumn("quantile_array", F.slice("q", 2, len(ps))).drop("q")
    long = src.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feat_name"), F.col(f"x{i}").alias("v")) for i, c in enumerate(nums)])))
    exact = exact_quantiles(long, sorted({0.5, *ps}))
    arrays = exact.groupBy("feat_name").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    arrays = arrays.select(F.col("feat_name").alias("f"), F.col("m")[0.5].alias("median_val"), F.transform(F.array(*[F.lit(float(p)) for p in ps]), lambda p: F.col("m")[p]).alias("quantile_array"))
    return wide.drop("q").join(arrays, F.col("feat_name") == F.col("f"), "left").drop("f")


def numeric_auc(df: DataFrame, nums: list[str], label: str) -> DataFrame:
    """(feat_name, auc): rank-sum AUC of each number against the label, ties counted half; NULL if a class is absent. An extension."""
    src = _labelled(df, label)
    long = src.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feat_name"), as_number(c).alias("rate")) for c in nums])), (F.col("__y") > 0.5).cast("int").alias("pos"))
    cells = long.where("rate IS NOT NULL").groupBy("feat_name", "rate").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("p"))
    return _auc(cells)


def level_counts(df: DataFrame, cats: list[str], label: str | None = None) -> DataFrame:
    """(feat_name, category, n, p): rows and positive rows of every level. NULL is no level. One shuffle of pre-aggregated levels."""
    src = _labelled(df, label)
    cells = F.array(*[F.struct(F.lit(c).alias("feat_name"), F.col(c).cast("string").alias("category")) for c in cats])
    long = src.select(F.inline(cells), (F.col("__y") > 0.5).cast("int").alias("pos")).where("category IS NOT NULL")
    pos = F.sum("pos") if label else F.lit(-1)
    return long.groupBy("feat_name", "category").agg(F.count(F.lit(1)).alias("n"), pos.cast("bigint").alias("p"))


def top_levels(levels: DataFrame, with_label: bool, top: int = TOP_LEVELS) -> DataFrame:
    """(feat_name, category, n, p, pos): the `top` levels by positive rate (with label) or count, ties by the level."""
    first = (F.col("p") / F.col("n")).desc() if with_label else F.col("n").desc()
    w = Window.partitionBy("feat_name").orderBy(first, F.col("category"))
    return levels.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top)


def _auc(cells: DataFrame) -> DataFrame:
    """(feat_name, auc) from cells (feat_name, rate, n, p): Mann-Whitney, cells of equal rate counted half against each other."""
    run = running_total(cells.groupBy("feat_name", "rate").agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q")), ["feat_name"], ["rate"], {"below": "q"})
    num = F.sum(F.col("p") * F.col("below") + F.col("p") * F.col("q") * 0.5)
    return run.groupBy("feat_name").agg((num / F.nullif((F.sum("p") * F.sum("q")).cast("double"), F.lit(0.0))).alias("auc"))


def level_auc(levels: DataFrame) -> DataFrame:
    """(feat_name, auc) of a categorical feature ranked by the positive rate of its levels; NULL if a class is absent."""
    return _auc(levels.withColumn("rate", F.col("p") / F.col("n")))


def level_mi(levels: DataFrame) -> DataFrame:
    """(feat_name, mutual_information) between level and label in bits, over the rows with a level; zero cells add nothing."""
    total = levels.groupBy(F.col("feat_name").alias("f")).agg(F.sum("n").alias("tn"), F.sum("p").alias("tp"))
    j = levels.join(total, F.col("feat_name") == F.col("f"))

    def term(joint: Column, side: Column) -> Column:
        return F.when(joint > 0, joint / F.col("tn") * F.log2(joint * F.col("tn") / (F.col("n") * side))).otherwise(0.0)

    return j.groupBy("feat_name").agg(F.sum(term(F.col("p"), F.col("tp")) + term(F.col("n") - F.col("p"), F.col("tn") - F.col("tp"))).alias("mutual_information"))


def category_profile(df: DataFrame, cats: list[str], label: str | None = None, top: int = TOP_LEVELS) -> DataFrame:
    """One row per feature: feat_name, count_all, count_not_null, concerned_categories (category, cnt, pos), auc, mutual_information.

    Without a label pos, auc and mutual_information are -1. Features without any level keep a row with an empty list.
    """
    src = _labelled(df, label)
    counts = src.agg(F.count(F.lit(1)).alias("count_all"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(cats)])
    base = counts.select("count_all", F.inline(F.array(*[F.struct(F.lit(c).alias("feat_name"), F.col(f"k{i}").alias("count_not_null")) for i, c in enumerate(cats)])))
    levels = level_counts(df, cats, label)
    lists = top_levels(levels, label is not None, top).groupBy(F.col("feat_name").alias("f")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "category", "n", "p"))), lambda s: F.struct(s["category"].alias("category"), s["n"].alias("cnt"), s["p"].alias("pos"))).alias("lv"))
    out = base.join(lists, F.col("feat_name") == F.col("f"), "left").withColumn("concerned_categories", F.coalesce("lv", F.expr("array()").cast("array<struct<category:string,cnt:bigint,pos:bigint>>"))).drop("f", "lv")
    if label is None:
        return out.withColumn("auc", F.lit(-1.0)).withColumn("mutual_information", F.lit(-1.0))
    out = out.join(level_auc(levels).withColumnRenamed("feat_name", "f"), F.col("feat_name") == F.col("f"), "left").drop("f")
    return out.join(level_mi(levels).withColumnRenamed("feat_name", "f"), F.col("feat_name") == F.col("f"), "left").drop("f")


def fit_dense(df: DataFrame, cats: list[str], nums: list[str], label: str | None = None, percentages: list[float] | None = None, relative_error: float = RELATIVE_ERROR) -> tuple[DataFrame, DataFrame]:
    """(category profile, numeric profile). A label with more than two values is treated as no label."""
    y = label if label is not None and is_binary(df, label) else None
    return category_profile(df, cats, y), numeric_profile(df, nums, y, percentages, relative_error)


def sparse_to_dense(df: DataFrame, cats: list[str], nums: list[str], label: str | None = None, sparse_type: str = "default", features: str = "features", default_level: str = DEFAULT_LEVEL) -> DataFrame:
    """Columns from a map column: an absent category is `default_level` (sparse_type default) or NULL (missing), an absent number NULL."""
    if sparse_type not in ("default", "missing"):
        raise ValueError(f"sparse_type is default or missing, not {sparse_type}")
    get = lambda c: F.col(features)[F.lit(c)]
    absent = F.lit(default_level) if sparse_type == "default" else F.lit(None).cast("string")
    cols = [F.coalesce(get(c), absent).alias(c) for c in cats] + [get(c).try_cast("double").alias(c) for c in nums]
    return df.select(*cols, *([get(label).try_cast("double").alias(label)] if label else []))


def fit_sparse(df: DataFrame, cats: list[str], nums: list[str], label: str | None = None, sparse_type: str = "default", features: str = "features", default_level: str = DEFAULT_LEVEL) -> tuple[DataFrame, DataFrame]:
    """`fit_dense` over the rows of a map column."""
    return fit_dense(sparse_to_dense(df, cats, nums, label, sparse_type, features, default_level), cats, nums, label)
