"""Grouped ranking metrics: concordant and discordant pairs, DCG and NDCG at k, for groups of any size.

NULL labels are left out of every metric, but their group still counts in the average. Pairs are counted without pairing:
after sorting by feature and label, the pairs ordered one way follow from ranks on a label's distinct values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.running import running_total

# Gains of the ratings 0 to 4; every other rating gains 0.
GAINS = {0: 0.0, 1: 1.0, 2: 3.0, 3: 7.0, 4: 15.0}


def default_discount(pos: int) -> float:
    """Discount of a position counted from 0."""
    import math

    return math.log2(pos + 2)


def _gain_column(rating: Column, gains: dict[int, float] | Callable[[int], float], ratings: range) -> Column:
    table = gains if isinstance(gains, dict) else {r: float(gains(r)) for r in ratings}
    out = F.lit(0.0)
    for r, g in table.items():
        if r >= 0 and g:
            out = F.when(rating == r, F.lit(float(g))).otherwise(out)
    return out


def long_form(df: DataFrame, label: str, group: str, feats: list[str]) -> DataFrame:
    """(grp, feat_name, v, y): one row per row and feature; NULL labels kept, a NULL group is the group `null`."""
    cells = F.array(*[F.struct(F.lit(c).alias("feat_name"), F.col(c).cast("double").alias("v")) for c in feats])
    return df.select(F.coalesce(F.col(group).cast("string"), F.lit("null")).alias("grp"), F.col(label).try_cast("int").alias("y"), F.inline(cells))


def pair_counts(df: DataFrame, label: str, group: str, feats: list[str]) -> DataFrame:
    """(feat_name, concordant, discordant), summed over groups; pairs tied in label or feature count for neither.

    Rows become cells (group, feature, v, y, n). For every cell and every label of its group (few), the rows of that label
    with a smaller v are a running total; a pair is concordant if the smaller v has the smaller label. The work grows with
    cells times distinct labels, not with pairs; nothing is gathered by group.
    """
    cells = long_form(df, label, group, feats).where("y IS NOT NULL AND v IS NOT NULL").groupBy("feat_name", "grp", "v", "y").agg(F.count(F.lit(1)).alias("n"))
    ys = cells.select("feat_name", "grp", F.col("y").alias("y2")).distinct()
    spread = cells.join(ys, ["feat_name", "grp"])
    per_value = spread.groupBy("feat_name", "grp", "y2", "v").agg(F.sum(F.when(F.col("y") == F.col("y2"), F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(F.col("y") > F.col("y2"), F.col("n")).otherwise(0)).alias("above"), F.sum(F.when(F.col("y") < F.col("y2"), F.col("n")).otherwise(0)).alias("under"))
    run = running_total(per_value, ["feat_name", "grp", "y2"], ["v"], {"before": "own"})
    return run.groupBy("feat_name").agg(F.sum(F.col("before") * F.col("above")).alias("concordant"), F.sum(F.col("before") * F.col("under")).alias("discordant"))


def pair_rate(pairs: DataFrame) -> DataFrame:
    """`pairs` with rate = concordant / discordant, -1 where there is no discordant pair."""
    return pairs.withColumn("pair_rate", F.when(F.col("discordant") == 0, -1.0).otherwise(F.col("concordant") / F.nullif("discordant", F.lit(0))))


def _dcg(ranked: DataFrame, ks: list[int], gain: Column, discount: Callable[[int], float], name: str, keys: list[str]) -> DataFrame:
    """Sum of gain / discount over the first k positions, per k; 0 for a k beyond the number of rows (column n)."""
    table = F.array(*[F.lit(float(discount(i))) for i in range(max(ks))])
    part = gain / F.element_at(table, F.col("rn").cast("int"))
    return ranked.where(F.col("rn") <= max(ks)).groupBy(*keys).agg(*[F.sum(F.when((F.col("rn") <= k) & (F.col("n") >= k), part).otherwise(0.0)).alias(f"{name}{k}") for k in ks])


def _ranked(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key in order, with rn. The limit is pushed below the shuffle, so a hot key sends few rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def group_ndcg(df: DataFrame, label: str, group: str, feats: list[str], ks: list[int], gains: dict[int, float] | Callable[[int], float] = GAINS, discount: Callable[[int], float] = default_discount, ratings: range = range(101)) -> DataFrame:
    """(grp, feat_name, k, ndcg_desc, ndcg_asc) per group. Groups with fewer labelled rows than min(ks) have 0 everywhere.

    The feature is ranked downwards and upwards, ties by label downwards; the ideal ranks all labelled rows by label, the
    actual ones only rows with the feature. A callable gain is evaluated for the ratings of `ratings`.
    """
    rows = long_form(df, label, group, feats)
    lab = rows.where("y IS NOT NULL")
    keys = ["grp", "feat_name"]
    gain, top = _gain_column(F.col("y"), gains, ratings), max(ks)
    sizes = lab.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"), F.count("v").alias("n_v"))
    groups = rows.select(*keys).distinct()
    ideal = _dcg(_ranked(lab, keys, [F.col("y").desc()], top).join(sizes.withColumnRenamed("n_all", "n"), keys), ks, gain, discount, "i", keys)
    have = lab.where("v IS NOT NULL")
    desc = _dcg(_ranked(have, keys, [F.col("v").desc(), F.col("y").desc()], top).join(sizes.withColumnRenamed("n_v", "n"), keys), ks, gain, discount, "d", keys)
    asc = _dcg(_ranked(have, keys, [F.col("v").asc(), F.col("y").desc()], top).join(sizes.withColumnRenamed("n_v", "n"), keys), ks, gain, discount, "a", keys)
    j = groups.join(sizes, keys, "left").join(ideal, keys, "left").join(desc, keys, "left").join(asc, keys, "left")
    small = F.coalesce("n_all", F.lit(0)) < min(ks)

    def norm(kind: str, k: int) -> Column:
        return F.when(small | (F.coalesce(f"i{k}", F.lit(0.0)) == 0), 0.0).otherwise(F.coalesce(f"{kind}{k}", F.lit(0.0)) / F.nullif(f"i{k}", F.lit(0.0)))

    cells = F.array(*[F.struct(F.lit(k).alias("k"), norm("d", k).alias("ndcg_desc"), norm("a", k).alias("ndcg_asc")) for k in ks])
    return j.select(*keys, F.inline(cells))


def ndcg_report(per_group: DataFrame) -> DataFrame:
    """(feat_name, metric, ndcg): the better of the mean downwards and the mean upwards over all groups; metric is ndcg<k>."""
    return per_group.groupBy("feat_name", "k").agg(F.greatest(F.avg("ndcg_desc"), F.avg("ndcg_asc")).alias("ndcg")).select("feat_name", F.concat(F.lit("ndcg"), F.col("k").cast("string")).alias("metric"), "ndcg")


def fit_dense_grouped(df: DataFrame, label: str, group: str, feats: list[str], ks: list[int], gains: dict[int, float] | Callable[[int], float] = GAINS, discount: Callable[[int], float] = default_discount) -> DataFrame:
    """(feat_name, pair_rate, ndcg map): the summary of each feature over all groups."""
    nd = ndcg_report(group_ndcg(df, label, group, feats, ks, gains, discount)).groupBy("feat_name").agg(F.map_from_entries(F.collect_list(F.struct("metric", "ndcg"))).alias("ndcg"))
    pr = pair_rate(pair_counts(df, label, group, feats)).select("feat_name", "pair_rate")
    return nd.join(pr, "feat_name", "left").select("feat_name", F.coalesce("pair_rate", F.lit(-1.0)).alias("pair_rate"), "ndcg")
