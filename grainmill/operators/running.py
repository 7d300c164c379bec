"""Running totals over a global order without a single-task window, and exact quantiles on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.session import cut


def running_total(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """`df` with, for each `name: column` of `sums`, the total of the column over all rows before this one in its key.

    A plain window would put a whole key into one task. Here the rows are range-partitioned by (keys, order), so a key may
    span many partitions; each partition sums its own rows per key, and the totals of earlier partitions - one row a key and
    partition - are added. `order` must be total within a key. The sorted rows are written once to the shared folder, so that
    the partition numbers the totals refer to can't change.
    """
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "__p").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    offsets = parts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__q"), *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums])
    cond = F.col("__p") == F.col("__q")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inner = ranged.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"__w_{n}") for n, c in sums.items()])
    return inner.join(offsets, cond).select(*df.columns, *[(F.col(f"__w_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def exact_quantiles(values: DataFrame, ps: list[float], key: str = "feat_name", value: str = "v") -> DataFrame:
    """(key, p, value): the value at rank max(1, ceil(p * n)) for each p, over the rows of `values` that aren't NULL.

    Values are counted first, so only distinct values are sorted; `ps` is a short list.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    run = running_total(counts, [key], [value], {"before": "c"})
    n = counts.groupBy(F.col(key).alias("__key")).agg(F.sum("c").alias("n"))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")
    at = run.join(n, F.col(key).eqNullSafe(F.col("__key"))).select(key, value, "c", "before", "n", asked)
    rank: Column = F.greatest(F.ceil(F.round(F.col("p") * F.col("n"), 9)), F.lit(1))
    return at.where((rank > F.col("before")) & (rank <= F.col("before") + F.col("c"))).select(key, "p", value)
