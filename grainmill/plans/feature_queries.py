"""Feature operators, sources, sinks and filters, with their SQL. Vectors are exported as (row, idx, value) rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from grainmill.features import transformers as X
from grainmill.operators import filters, profile
from grainmill.operators.badrows import NUMBER
from grainmill.plans.common import BLANKS as SQL_BLANKS
from grainmill.plans.common import DENSE, NUMS, dense, r
from grainmill.schema import parse_schema
from grainmill.session import shared_dir, table
from grainmill.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tmp(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


# ---- category encoder ----------------------------------------------------------------------------------------------------


def _index_sql(order: str, top: int = 0) -> str:
    by = {"frequencyDesc": "n DESC, level", "frequencyAsc": "n, level", "alphabetDesc": "level DESC", "alphabetAsc": "level"}[order]
    limit = f"WHERE rn < {top}" if top else ""
    return f"""WITH {DENSE}, c AS (SELECT city AS level, count(*) AS n FROM dense WHERE city IS NOT NULL GROUP BY 1),
k AS (SELECT * FROM (SELECT level, row_number() OVER (ORDER BY {by}) - 1 AS rn FROM c) {limit})
SELECT sample_id, load_id, coalesce(city, '') AS city, CAST(coalesce(rn, (SELECT count(*) FROM k)) AS INTEGER) AS city_index FROM dense LEFT JOIN k ON k.level = dense.city"""


def _encoded(spark: SparkSession, d: str, **kw: object) -> DataFrame:
    df = dense(spark, d).select("sample_id", "load_id", "city")
    return X.CategoryEncoder(inputCols=["city"], outputCols=["city_index"], **kw).fit(df).transform(df).select("sample_id", "load_id", F.coalesce("city", F.lit("")).alias("city"), "city_index")


@query(_index_sql("frequencyDesc"))
def cat_index_freq_desc(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d)


@query(_index_sql("frequencyAsc"))
def cat_index_freq_asc(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d, stringOrderType="frequencyAsc")


@query(_index_sql("alphabetDesc"))
def cat_index_alpha_desc(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d, stringOrderType="alphabetDesc")


@query(_index_sql("alphabetAsc"))
def cat_index_alpha_asc(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d, stringOrderType="alphabetAsc")


@query(_index_sql("frequencyDesc", 5))
def cat_index_topk(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d, categoriesReserved=5)


@query(f"""WITH {DENSE}, c AS (SELECT ad_slot AS level, count(*) AS n FROM dense WHERE ad_slot IS NOT NULL GROUP BY 1), k AS (SELECT level, row_number() OVER (ORDER BY n DESC, level) - 1 AS rn FROM c)
SELECT sample_id, load_id, CAST(coalesce(rn, (SELECT count(*) FROM k)) AS INTEGER) AS slot_index FROM dense LEFT JOIN k ON k.level = dense.ad_slot""")
def cat_index_many_levels(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d).select("sample_id", "load_id", "ad_slot")
    return X.CategoryEncoder(inputCols=["ad_slot"], outputCols=["slot_index"], dropInputCols=True).fit(df).transform(df)


@query(f"""WITH {DENSE}, c AS (SELECT os_name AS level, count(*) AS n FROM dense WHERE os_name IS NOT NULL GROUP BY 1), k AS (SELECT * FROM (SELECT level, row_number() OVER (ORDER BY n DESC, level) - 1 AS rn FROM c) WHERE rn < 4),
i AS (SELECT DISTINCT sample_id, coalesce(rn, (SELECT count(*) FROM k)) AS hot FROM dense LEFT JOIN k ON k.level = dense.os_name)
SELECT sample_id, CAST(idx AS INTEGER) AS idx, CASE WHEN idx = hot THEN 1.0 ELSE 0.0 END AS value FROM i, range(0, (SELECT count(*) + 1 FROM k)) AS g(idx)""")
def cat_onehot(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d).select("sample_id", "os_name")
    m = X.CategoryEncoder(inputCols=["os_name"], outputCols=["v"], indexOnly=False, categoriesReserved=4).fit(df)
    hot = m.transform(df).select("sample_id", vector_to_array("v").alias("a")).distinct()
    return files.vector_rows(hot, "sample_id", "a").select("sample_id", F.col("idx").cast("int").alias("idx"), "value")


@query(f"""WITH {DENSE}, c AS (SELECT city AS level, count(*) AS n FROM dense WHERE city IS NOT NULL AND load_id % 2 = 1 GROUP BY 1 HAVING count(*) > 0), k AS (SELECT level, row_number() OVER (ORDER BY n DESC, level) - 1 AS rn FROM c)
SELECT sample_id, load_id, CAST(coalesce(rn, (SELECT count(*) FROM k)) AS INTEGER) AS city_index FROM dense LEFT JOIN k ON k.level = dense.city""")
def cat_unseen_null(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d).select("sample_id", "load_id", "city")
    m = X.CategoryEncoder(inputCols=["city"], outputCols=["city_index"], dropInputCols=True).fit(df.where("load_id % 2 = 1"))
    return m.transform(df)


@query("""WITH c AS (SELECT l_returnflag AS level, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT level, row_number() OVER (ORDER BY n DESC, level) - 1 AS rn FROM c)
SELECT CAST(rn AS INTEGER) AS label_index, l_returnflag, count(*) AS n FROM lineitem JOIN k ON level = l_returnflag GROUP BY 1, 2""")
def cat_label_index(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_returnflag")
    m = X.CategoryEncoder(inputCols=["l_returnflag"], outputCols=["label_index"]).fit(df)
    return m.transform(df).groupBy("label_index", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(_index_sql("frequencyDesc"))
def cat_saved_model(spark: SparkSession, d: str) -> DataFrame:
    """Fitted, saved, loaded, applied."""
    df = dense(spark, d).select("sample_id", "load_id", "city")
    X.CategoryEncoder(inputCols=["city"], outputCols=["city_index"]).fit(df).write().overwrite().save(p := _tmp(spark, "encoder"))
    return X.CategoryEncoderModel.load(p).transform(df).select("sample_id", "load_id", F.coalesce("city", F.lit("")).alias("city"), "city_index")


@query(_index_sql("frequencyDesc").replace("FROM dense LEFT JOIN k ON k.level = dense.city", "FROM dense LEFT JOIN k ON k.level = dense.city WHERE city IS NOT NULL"))
def cat_index_strict(spark: SparkSession, d: str) -> DataFrame:
    """handleInvalid="error" passes where every level was fitted."""
    df = dense(spark, d).select("sample_id", "load_id", "city").where("city IS NOT NULL")
    return X.CategoryEncoder(inputCols=["city"], outputCols=["city_index"], handleInvalid="error").fit(df).transform(df)


# ---- multi-category encoder ----------------------------------------------------------------------------------------------

_TOKENS = f"""{DENSE}, raw AS (SELECT sample_id, load_id, tags, CASE WHEN tags = '' THEN [''] ELSE string_split(regexp_replace(tags, ',+$', ''), ',') END AS t FROM dense),
tok AS (SELECT sample_id, load_id, unnest(CASE WHEN regexp_full_match(tags, ',+') THEN [] ELSE t END) AS level FROM raw WHERE tags IS NOT NULL),
c AS (SELECT level, count(*) AS n FROM tok GROUP BY 1), k AS (SELECT * FROM (SELECT level, row_number() OVER (ORDER BY n DESC, level) - 1 AS rn FROM c) WHERE rn < 30)"""


def _multi(spark: SparkSession, d: str, **kw: object) -> tuple[DataFrame, X.MultiCategoryEncoderModel]:
    df = dense(spark, d).select("sample_id", "load_id", "tags")
    return df, X.MultiCategoryEncoder(inputCols=["tags"], outputCols=["v"], categoriesReserved=30, **kw).fit(df)


@query(f"WITH {_TOKENS} SELECT level, CAST(rn AS INTEGER) AS idx FROM k")
def multicat_fit(spark: SparkSession, d: str) -> DataFrame:
    _, m = _multi(spark, d)
    return spark.createDataFrame([(x, i) for i, x in enumerate(m.labels[0])], "level string, idx int")


@query(f"WITH {_TOKENS} SELECT DISTINCT sample_id, CAST(coalesce(rn, (SELECT count(*) FROM k)) AS INTEGER) AS idx FROM tok LEFT JOIN k USING (level)")
def multicat_index(spark: SparkSession, d: str) -> DataFrame:
    df, m = _multi(spark, d)
    return m.transform(df).where("v IS NOT NULL").select("sample_id", F.explode(vector_to_array("v").cast("array<int>")).alias("idx")).distinct()


_HOT = f"""WITH {_TOKENS}, hit AS (SELECT DISTINCT sample_id, load_id, coalesce(rn, (SELECT count(*) FROM k)) AS hot FROM tok LEFT JOIN k USING (level))
SELECT CAST(hot AS INTEGER) AS idx, CAST(count(*) AS DOUBLE) AS total FROM (SELECT DISTINCT * FROM hit) GROUP BY 1"""


def _totals(df: DataFrame) -> DataFrame:
    rows = df.where("v IS NOT NULL").select("sample_id", "load_id", vector_to_array("v").alias("a"))
    cells = rows.select("sample_id", "load_id", F.posexplode("a").alias("idx", "x")).where("x > 0").select("sample_id", "load_id", "idx").distinct()
    return cells.groupBy(F.col("idx").cast("int").alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("total"))


@query(_HOT)
def multicat_multihot_dense(spark: SparkSession, d: str) -> DataFrame:
    df, m = _multi(spark, d, indexOnly=False, outputSparse=False)
    return _totals(m.transform(df))


@query(_HOT)
def multicat_multihot_sparse(spark: SparkSession, d: str) -> DataFrame:
    df, m = _multi(spark, d, indexOnly=False, outputSparse=True)
    return _totals(m.transform(df))


# ---- numbers -------------------------------------------------------------------------------------------------------------

_SPLITS = f"WITH {DENSE}, q AS (SELECT list_sort(list_distinct(quantile_disc(income, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS s FROM dense WHERE income IS NOT NULL)"


def _buckets(spark: SparkSession, d: str, **kw: object) -> tuple[DataFrame, X.NumericBucketerModel]:
    df = dense(spark, d).select("sample_id", "load_id", "income")
    return df, X.NumericBucketer(inputCols=["income"], outputCols=["b"], numBucketsArray=[10], relativeError=0.0, dropInputCols=True, **kw).fit(df)


@query(_SPLITS + " SELECT CAST(i - 1 AS INTEGER) AS pos, s[i] AS split FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM q)")
def bucket_splits_exact(spark: SparkSession, d: str) -> DataFrame:
    _, m = _buckets(spark, d)
    return spark.createDataFrame([(i, x) for i, x in enumerate(m.splits_array[0][1:-1])], "pos int, split double")


@query(_SPLITS + " SELECT sample_id, load_id, CAST(CASE WHEN income IS NULL THEN len(s) + 1 ELSE len(list_filter(s, lambda x: x <= income)) END AS INTEGER) AS b FROM dense, q")
def bucket_index(spark: SparkSession, d: str) -> DataFrame:
    df, m = _buckets(spark, d)
    return m.transform(df)


@query(_SPLITS + ", i AS (SELECT CASE WHEN income IS NULL THEN len(s) + 1 ELSE len(list_filter(s, lambda x: x <= income)) END AS b FROM dense, q) SELECT CAST(b AS INTEGER) AS idx, CAST(count(*) AS DOUBLE) AS total FROM i GROUP BY 1")
def bucket_onehot(spark: SparkSession, d: str) -> DataFrame:
    df, m = _buckets(spark, d, indexOnly=False, outputSparse=False)
    cells = m.transform(df).select(F.posexplode(vector_to_array("b")).alias("idx", "x"))
    return cells.groupBy(F.col("idx").cast("int").alias("idx")).agg(F.sum("x").alias("total")).where("total > 0")


@query(SQL["bucket_onehot"])
def bucket_onehot_sparse(spark: SparkSession, d: str) -> DataFrame:
    df, m = _buckets(spark, d, indexOnly=False, outputSparse=True)
    cells = m.transform(df).select(F.posexplode(vector_to_array("b")).alias("idx", "x"))
    return cells.groupBy(F.col("idx").cast("int").alias("idx")).agg(F.sum("x").alias("total")).where("total > 0")


@query(f"""WITH {DENSE}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in NUMS)} FROM dense)
SELECT sample_id, load_id, {', '.join(f"coalesce(round(({c} - m_{c}) / s_{c}, 5), 'NaN'::DOUBLE) + 0.0 AS z_{c}" for c in NUMS)} FROM dense, m""")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d).select("sample_id", "load_id", *NUMS)
    m = X.NumericStandardizer(inputCols=NUMS, outputCols=[f"z_{c}" for c in NUMS], dropInputCols=True).fit(df)
    return m.transform(df).select("sample_id", "load_id", *[r(f"z_{c}", 5).alias(f"z_{c}") for c in NUMS])


@query(f"WITH {DENSE} SELECT sample_id, load_id, age FROM dense")
def col_drop(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d).select("sample_id", "load_id", "age", "bid", "income")
    return X.ColumnEliminator(inputCols=["bid", "income", "absent"]).transform(df)


@query(f"WITH {DENSE} SELECT sample_id, load_id AS delivery, age AS years FROM dense")
def col_rename(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d).select("sample_id", "load_id", "age")
    return X.ColumnRenamer(inputCols=["load_id", "age"], outputCols=["delivery", "years"]).transform(df)


_SCHEMA = ["sample_id;Other", "age;Num", "bid;Num", "os_name;Cat", "label;Label"]


def _pipeline(spark: SparkSession, d: str, **kw: object) -> DataFrame:
    """Rows and sum of the present numbers (a missing one is NaN in the vector, or in the last bucket) per slot of the merged vector and per label index."""
    df = dense(spark, d).select("sample_id", "age", "bid", "os_name", "label")
    out, _ = X.pipeline_fit_transform(df, parse_schema(_SCHEMA), **kw)
    cells = out.select(F.col(X.LABEL_COL).alias("y"), F.posexplode(vector_to_array(X.FEATURES_COL)).alias("idx", "x"))
    return cells.groupBy("y", F.col("idx").cast("int").alias("idx")).agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.nanvl("x", F.lit(None).cast("double"))), 4).alias("total"))


def _pipeline_sql(nums: str, extra: str = "") -> str:
    return f"""WITH {DENSE}, p AS (SELECT * FROM dense),
ko AS (SELECT os_name AS level, row_number() OVER (ORDER BY count(*) DESC, os_name) - 1 AS rn FROM p WHERE os_name IS NOT NULL GROUP BY 1),
kl AS (SELECT label AS level, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS rn FROM p WHERE label IS NOT NULL GROUP BY 1){extra},
e AS (SELECT {nums}, coalesce(ko.rn, (SELECT count(*) FROM ko)) AS x2, CAST(coalesce(kl.rn, (SELECT count(*) FROM kl)) AS INTEGER) AS y FROM p LEFT JOIN ko ON ko.level = p.os_name LEFT JOIN kl ON kl.level = p.label),
l AS (SELECT y, 0 AS idx, x0 AS x FROM e UNION ALL SELECT y, 1, x1 FROM e UNION ALL SELECT y, 2, x2 FROM e)
SELECT y, CAST(idx AS INTEGER) AS idx, count(*) AS n, round(sum(x) FILTER (NOT isnan(CAST(x AS DOUBLE))), 4) + 0.0 AS total FROM l GROUP BY 1, 2"""


@query(_pipeline_sql("(age - (SELECT avg(age) FROM p)) / (SELECT stddev_samp(age) FROM p) AS x0, (bid - (SELECT avg(bid) FROM p)) / (SELECT stddev_samp(bid) FROM p) AS x1"))
def pipeline_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _pipeline(spark, d, method_for_num="normalize")


@query(_pipeline_sql("age AS x0, bid AS x1"))
def pipeline_remain(spark: SparkSession, d: str) -> DataFrame:
    return _pipeline(spark, d, method_for_num="remain")


def _bucket_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN len(q_{c}) + 1 ELSE len(list_filter(q_{c}, lambda x: x <= {c})) END"


_EIGHTHS = "[" + ", ".join(str(i / 8) for i in range(1, 8)) + "]"


@query(_pipeline_sql(f"{_bucket_sql('age')} AS x0, {_bucket_sql('bid')} AS x1", f", q AS (SELECT list_sort(list_distinct(quantile_disc(age, {_EIGHTHS}))) AS q_age, list_sort(list_distinct(quantile_disc(bid, {_EIGHTHS}))) AS q_bid FROM p)").replace("FROM p LEFT JOIN ko", "FROM p CROSS JOIN q LEFT JOIN ko"))
def pipeline_bucketize(spark: SparkSession, d: str) -> DataFrame:
    return _pipeline(spark, d, method_for_num="bucketize", num_buckets=8, relative_error=0.0)


# ---- sources and sinks ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    files.write_csv(df, p := _tmp(spark, "csv"), "|", header=True)
    return files.read_csv(spark, p, "|", df.schema, "\\N", header=True)


_EMB = "SELECT vec_id, CAST(label AS DOUBLE) AS label, CAST(i - 1 AS INTEGER) AS idx, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"


@query(f"SELECT label, idx, count(*) AS n, round(sum(value), 5) + 0.0 AS total FROM ({_EMB}) GROUP BY 1, 2")
def libsvm_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    files.write_libsvm(df, p := _tmp(spark, "svm"), "label", "e")
    back = files.parse_libsvm(spark.read.text(p))
    cells = back.select("label", F.explode(F.arrays_zip("indices", "values")).alias("z"))
    return cells.groupBy("label", F.col("z.indices").cast("int").alias("idx")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("z.values"), 5).alias("total"))


@query(f"SELECT label, idx, count(*) AS n, round(sum(value), 5) + 0.0 AS total FROM ({_EMB}) GROUP BY 1, 2")
def libsvm_builtin_reader(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("e"))
    files.write_libsvm(df, p := _tmp(spark, "svm1"), "label", "e", one_based=True)
    back = files.read_libsvm(spark, p, 64)
    cells = back.select("labelLibSVM", F.posexplode(vector_to_array("featuresLibSVM")).alias("idx", "x"))
    return cells.groupBy(F.col("labelLibSVM").alias("label"), F.col("idx").cast("int").alias("idx")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 5).alias("total"))


_NUM = NUMBER.replace("?:", "")
_TOKENS_OF = f"list_filter(string_split_regex(trim(line, {SQL_BLANKS}), '[ \\t]+'), lambda x: x <> '')"
_SVM_OK = f"t AS (SELECT line_no, {_TOKENS_OF} AS t FROM raw_samples WHERE feed = 'libsvm'), f AS (SELECT line_no, CASE WHEN regexp_full_match(t[1], '{_NUM}') THEN try_cast(t[1] AS DOUBLE) END AS label, string_split(unnest(t[2:]), ':') AS p FROM t)"


def _svm(spark: SparkSession, d: str, **kw: object) -> DataFrame:
    lines = table(spark, d, "raw_samples").where("feed = 'libsvm'").select("line_no", F.col("line").alias("value"))
    out = files.parse_libsvm(lines, **kw)
    rows = out.select("line_no", "label", F.explode(F.arrays_zip("indices", "values")).alias("z"))
    return rows.select("line_no", "label", F.col("z.indices").alias("idx"), F.col("z.values").alias("value"))


def _finite(df: DataFrame) -> DataFrame:
    """Sums over the readable pairs, per line."""
    ok = df.where("idx IS NOT NULL AND value IS NOT NULL AND abs(value) < 1e300 AND label IS NOT NULL AND abs(label) < 1e300")
    return ok.groupBy("line_no", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"), r(F.sum("value"), 5).alias("total"))


def _svm_sql(label: str, base: int) -> str:
    return f"WITH {_SVM_OK} SELECT line_no, {label} AS label, count(*) AS n, CAST(sum(try_cast(p[1] AS BIGINT) - {base}) AS BIGINT) AS idx_sum, round(sum(try_cast(p[2] AS DOUBLE)), 5) + 0.0 AS total FROM f WHERE regexp_full_match(p[1], '[-+]?[0-9]+') AND try_cast(p[1] AS BIGINT) IS NOT NULL AND regexp_full_match(p[2], '{_NUM}') AND abs(try_cast(p[2] AS DOUBLE)) < 1e300 AND abs(label) < 1e300 GROUP BY 1, 2"


def _svm_sums(spark: SparkSession, d: str, **kw: object) -> DataFrame:
    return _finite(_svm(spark, d, **kw))


@query(_svm_sql("label", 0))
def libsvm_zero_based(spark: SparkSession, d: str) -> DataFrame:
    return _svm_sums(spark, d)


@query(_svm_sql("label", 1))
def libsvm_onebased(spark: SparkSession, d: str) -> DataFrame:
    return _svm_sums(spark, d, one_based=True, need_sort=True)


@query(_svm_sql("(label + 1) / 2", 0))
def libsvm_rescale(spark: SparkSession, d: str) -> DataFrame:
    return _svm_sums(spark, d, rescale_binary_label=True)


def _id_sql(feed: str, parts: int) -> str:
    whole = lambda i, t: f"CASE WHEN regexp_full_match(p[{i}], '[-+]?[0-9]+') THEN try_cast(p[{i}] AS {t}) END"
    heads = f"{whole(1, 'BIGINT')} AS id" if parts == 2 else f"{whole(1, 'INTEGER')} AS field, {whole(2, 'BIGINT')} AS id"
    return f"""WITH l AS (SELECT line_no, {_TOKENS_OF} AS t FROM raw_samples WHERE feed = '{feed}'),
f AS (SELECT line_no, CASE WHEN try_cast(t[1] AS DOUBLE) > 0 THEN 1.0 ELSE 0.0 END AS label, string_split(unnest(t[2:]), ':') AS p FROM l WHERE regexp_full_match(t[1], '{_NUM}') AND isfinite(try_cast(t[1] AS DOUBLE))),
g AS (SELECT line_no, label, {heads}, CASE WHEN regexp_full_match(p[{parts}], '{_NUM}') AND isfinite(try_cast(p[{parts}] AS FLOAT)) THEN round(try_cast(p[{parts}] AS FLOAT), 3) + 0.0 END AS val FROM f WHERE len(p) = {parts})
SELECT * FROM g WHERE id >= 0{' AND field >= 0' if parts == 3 else ''} AND val IS NOT NULL"""


def _lines_of(spark: SparkSession, d: str, feed: str) -> DataFrame:
    return table(spark, d, "raw_samples").where(F.col("feed") == feed).select("line_no", F.col("line").alias("value"))


def _readable(rows: DataFrame) -> DataFrame:
    """Features whose parts were all read, of lines whose label was."""
    return rows.where("label IS NOT NULL AND feat >= 0 AND val IS NOT NULL")


@query(_id_sql("libsvm", 2))
def libsvm_ids_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _readable(files.explode_samples(files.parse_id_lines(_lines_of(spark, d, "libsvm")), "line_no"))
    return rows.select("line_no", "label", F.col("feat").alias("id"), r(F.col("val").cast("float"), 3).alias("val"))


@query(_id_sql("libffm", 3))
def libffm_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _readable(files.explode_samples(files.parse_field_lines(_lines_of(spark, d, "libffm")), "line_no")).where("field >= 0")
    return rows.select("line_no", "label", "field", F.col("feat").alias("id"), r(F.col("val").cast("float"), 3).alias("val"))


@query("""WITH x AS (SELECT line_no, unnest(string_split(line, ',')) AS e, generate_subscripts(string_split(line, ','), 1) AS i FROM raw_samples WHERE feed = 'sparse')
SELECT line_no, substr(e, 1, instr(e, ':') - 1) AS k, arg_max(substr(e, instr(e, ':') + 1), i) AS v FROM x WHERE instr(e, ':') > 0 GROUP BY 1, 2""")
def sparse_map_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "raw_samples").where("feed = 'sparse'").select("line_no", F.col("line").alias("value"))
    return files.parse_sparse_lines(lines).select("line_no", F.explode("features").alias("k", "v"))


@query("SELECT n_nationkey, n_name FROM nation")
def table_scan(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "nation").createOrReplaceTempView("nation_view")
    return files.read_table(spark, "nation_view").select("n_nationkey", "n_name")


@query("SELECT feat_name AS name, CASE kind WHEN 'Num' THEN 'double' ELSE 'string' END AS type, true AS nullable FROM feature_schema")
def schema_file(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "feature_schema")
    s = parse_schema([f"{x['feat_name']};{x['kind']}" for x in df.collect()])
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in s.struct], "name string, type string, nullable boolean")


@query(f"SELECT label, idx, count(*) AS n, round(sum(value), 5) + 0.0 AS total FROM ({_EMB}) GROUP BY 1, 2")
def libsvm_custom_reader(spark: SparkSession, d: str) -> DataFrame:
    """Written with one-based indices, read by the reader with free delimiters, each line checked."""
    df = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    files.write_libsvm(df, p := _tmp(spark, "svm2"), "label", "e", one_based=True)
    back = files.read_libsvm_custom(spark, p, 64, one_based=True, check=True, need_sort=True)
    cells = back.select("label", F.posexplode(vector_to_array("features")).alias("idx", "x"))
    return cells.groupBy("label", F.col("idx").cast("int").alias("idx")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 5).alias("total"))


# ---- filters -------------------------------------------------------------------------------------------------------------

RULES = """[filter=1]
city={Orva, Raha}
age=[60,#]
os_name={andra};bid=[#,0]
[filter=0]
ad={yes}
[col]
income=1
"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """dense_samples as delimited feature records: name \\x03 class \\x02 value."""
    df = dense(spark, d)
    feat = lambda c, x: F.concat(F.lit(f"{c}\x03"), F.coalesce(F.col(c).cast("string") if x else F.col(c), F.lit("")), F.lit("\x02"), F.coalesce(F.col(c).cast("string") if x else F.lit("1"), F.lit("")))
    cells = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), feat(c, False)) for c in ("city", "os_name")], *[F.when(profile.as_number(c).isNotNull(), feat(c, True)) for c in NUMS]))
    line = F.concat(F.coalesce("label", F.lit("")), F.lit("\x01"), F.array_join(cells, "\x01"), F.lit("\x01"))
    return filters.parse_records(df.select("sample_id", "load_id", line.alias("value")))


def _kept(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "load_id")


def _rule(text: str) -> filters.FilterRules:
    return filters.parse_rules(text)


def _filter_sql(where: str) -> str:
    return f"WITH {DENSE} SELECT sample_id, load_id FROM dense WHERE {where}"


def _by(spark: SparkSession, d: str, text: str) -> DataFrame:
    return _kept(filters.filter_records(_records(spark, d), _rule(text)))


@query(_filter_sql("NOT coalesce(city IN ('Orva', 'Raha'), false)"))
def filter_class(spark: SparkSession, d: str) -> DataFrame:
    return _by(spark, d, "[filter=1]\ncity={Orva, Raha}")


@query(_filter_sql("NOT coalesce(city = 'Orva' AND os_name IN ('andra', 'iona'), false)"))
def filter_class_and(spark: SparkSession, d: str) -> DataFrame:
    return _by(spark, d, "[filter=1]\ncity={Orva};os_name={andra,iona}")


@query(_filter_sql("os_name IS NULL OR os_name IN ('andra', 'iona')"))
def filter_class_keep(spark: SparkSession, d: str) -> DataFrame:
    return _by(spark, d, "[filter=0]\nos_name={andra, iona}")


@query(_filter_sql("NOT coalesce(age BETWEEN 18 AND 30, false) AND NOT coalesce(bid <= 0, false)"))
def filter_value(spark: SparkSession, d: str) -> DataFrame:
    return _by(spark, d, "[filter=1]\nage=[18,30]\nbid=[#,0]")


@query(_filter_sql("NOT coalesce(age >= 18 AND bid <= 0, false)"))
def filter_value_and(spark: SparkSession, d: str) -> DataFrame:
    return _by(spark, d, "[filter=1]\nage=[18,#];bid=[#,0]")


@query(_filter_sql("age IS NULL OR age BETWEEN 20 AND 40"))
def filter_value_keep(spark: SparkSession, d: str) -> DataFrame:
    return _by(spark, d, "[filter=0]\nage=[20,40]")


@query(_filter_sql("NOT coalesce(city IN ('Orva', 'Raha'), false) AND NOT coalesce(age >= 60, false) AND NOT coalesce(os_name = 'andra' AND bid <= 0, false)"))
def filter_rules(spark: SparkSession, d: str) -> DataFrame:
    return _by(spark, d, RULES)


@query(f"WITH {DENSE}, l AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS name FROM dense WHERE {c} IS NOT NULL' for c in ('city', 'os_name', 'age', 'dwell_sec'))}) SELECT name, count(*) AS n FROM l GROUP BY 1")
def filter_columns(spark: SparkSession, d: str) -> DataFrame:
    out = filters.filter_records(_records(spark, d), _rule("[col]\nincome=1\nbid=1\nage=0"))
    return out.select(F.explode("feats.name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DENSE} SELECT sample_id, load_id, (city IS NOT NULL)::INT + (os_name IS NOT NULL)::INT + (age IS NOT NULL)::INT + (dwell_sec IS NOT NULL)::INT + (bid IS NOT NULL)::INT AS n_ids FROM dense WHERE NOT coalesce(city IN ('Orva', 'Raha'), false) AND NOT coalesce(age >= 60, false) AND NOT coalesce(os_name = 'andra' AND bid <= 0, false)")
def filter_hash(spark: SparkSession, d: str) -> DataFrame:
    out = filters.hash_records(filters.filter_records(_records(spark, d), _rule(RULES)))
    return out.select("sample_id", "load_id", F.size(F.filter("ids", lambda x: x.isNotNull())).alias("n_ids"))



