"""Column-level data quality of loads: exact base aggregates, a classifier two-sample test, findings of both.

Three layers, all over every row:

* `profile_loads`: countAll, countNotNull, distinct, min and max per load and column (two-level exact distinct).
* `trusted_drift` and `load_drift`: classifier two-sample tests. A logistic regression per load learns to tell it from the
  trusted load, which is drawn anew from its summary, or from its predecessor. Each column enters as one of 16 codes
  (quantile bin, level, missing, pattern violated). Two models per load are fitted on the two halves of a bounded sample;
  each scores the rows of the other half (cross-fitting), over the whole table. AUC near 0.5 means no change. Ablation says
  which columns carry a change: the drop of AUC without a column's term, and the AUC of the column's term alone among
  present values, which other changed columns can't hide.
* `load_findings`: `shift` and `levels`, the changes of a distribution, are looked for only in the columns of a load that the
  test against the trusted load doesn't clear, and confirmed by the exact counts; `nulls`, `range`, `pattern` and `stuck` are
  rules on exact counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import clean, clean_num, cut

#: Codes per column in the classifier, rows of one load that its models may be fitted on, rows drawn from the trusted summary, bins of a score.
CODES, TRAIN_ROWS, TRUSTED_ROWS, SCORE_BINS = 16, 4000, 4000, 256
#: A column of a load is cleared of a change if the models saw at least so many of its values, its own AUC is within so much
#: of 0.5 and AUC drops by no more than so much without it. A shift of the median beyond a quartile moves a quarter of the
#: values across it (AUC of 0.62 or more), a tenth of unknown levels gives 0.55, so both bounds leave room for the error of the fit.
MIN_SEEN, CLEAR_AUC, CLEAR_DROP = 200, 0.02, 0.01
#: Loads whose models are held in memory at a time while scoring (about 3 KB each for 11 columns), and whose histograms a task holds (about 30 KB each).
LOADS_PER_PASS, LOADS_PER_FLUSH = 4096, 256
#: Up to so many loads their table (32 bytes a load) is broadcast, beyond it is joined by shuffle.
MAX_BROADCAST_LOADS = 200_000
#: Levels of one column that may stand in a plan as literals; the levels of a column with more are joined as a table.
MAX_LEVELS = 10_000


@dataclass
class ColumnRule:
    """What is declared or trusted about one column. `levels` only where the trusted list is complete."""

    name: str
    numeric: bool = False
    multi: bool = False
    lo: float | None = None
    hi: float | None = None
    regex: str | None = None
    trusted_missing: float | None = None
    quantiles: list[float] = field(default_factory=list)
    levels: list[str] | None = None
    level_counts: list[float] | None = None

    @property
    def complete(self) -> bool:
        """Whether the trusted summary gives the whole distribution of the column."""
        return len(self.quantiles) == 101 if self.numeric else bool(self.levels)


def rules_from_tables(schema: DataFrame, nums: DataFrame, cats: DataFrame, complete: tuple[str, ...] = ("city", "os_name"), skip: tuple[str, ...] = ("sample_id",)) -> list[ColumnRule]:
    """Rules from the declared schema and the trusted summaries. Both have one row a column, so they fit the driver."""
    num = {r["feat_name"]: r for r in nums.collect()}
    cat = {r["feat_name"]: r for r in cats.collect()}
    out = []
    for r in schema.collect():
        name = r["feat_name"]
        if name in skip:
            continue
        s = num.get(name) or cat.get(name)
        missing = 1 - s["count_not_null"] / s["count_all"] if s and s["count_all"] else None
        listed = [x for x in cat[name]["concerned_categories"] or [] if x["category"] is not None] if name in complete and name in cat else []
        levels, level_counts = ([x["category"] for x in listed], [float(x["cnt"] or 0) for x in listed]) if listed else (None, None)
        out.append(ColumnRule(name, r["kind"] == "Num", r["kind"] == "MultiCat", r["lo_val"], r["hi_val"], r["val_regex"], missing, list(num[name]["quantile_array"] or []) if name in num else [], levels, level_counts))
    return out


def _value(r: ColumnRule) -> Column:
    return clean_num(r.name) if r.numeric else clean(F.col(r.name).cast("string"))


def _full_match(c: Column, regex: str) -> Column:
    return c.rlike(f"\\A(?:{regex})\\z")


def _long(r: ColumnRule) -> bool:
    return bool(r.levels) and len(r.levels) > MAX_LEVELS


def _join_levels(values: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """`values` (v_<column>...) with a mark k_<column> where a long trusted list has the level. The list is one row of the summary, which the driver has read, so it can be broadcast."""
    for r in filter(_long, rules):
        listed = values.sparkSession.createDataFrame([(x, True) for x in sorted(set(r.levels))], f"l_{r.name} string, k_{r.name} boolean")
        values = values.join(F.broadcast(listed), F.col(f"v_{r.name}") == F.col(f"l_{r.name}"), "left").drop(f"l_{r.name}")
    return values


def _unlisted(r: ColumnRule) -> Column:
    """Whether a value that is present isn't among the trusted levels."""
    v = F.col(f"v_{r.name}")
    return v.isNotNull() & F.col(f"k_{r.name}").isNull() if _long(r) else ~v.isin(r.levels)


# ---- exact base aggregates -----------------------------------------------------------------------------------------------


def profile_loads(df: DataFrame, rules: list[ColumnRule], load_col: str = "load_id") -> DataFrame:
    """One row per load and column: count_all, count_not_null, n_distinct, min_val, max_val (numbers) and min_text, max_text.

    Values are counted per (load, column, value) first, so the shuffle carries each value of a map task once and no load or
    value is gathered in one task; the second level counts the survivors. NULL load ids form their own load.
    """
    cells = F.array(*[
        F.struct(F.lit(r.name).alias("col_name"), (_value(r) if r.numeric else F.lit(None).cast("double")).alias("num"), (F.lit(None).cast("string") if r.numeric else _value(r)).alias("text"))
        for r in rules
    ])
    long = df.select(F.col(load_col).alias("load_id"), F.inline(cells))
    # -0.0 and 0.0 are one value
    per_value = long.groupBy("load_id", "col_name", (F.col("num") + F.lit(0.0)).alias("num"), "text").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("num").isNotNull() | F.col("text").isNotNull()
    return per_value.groupBy("load_id", "col_name").agg(
        F.sum("n").alias("count_all"),
        F.sum(F.when(present, F.col("n")).otherwise(0)).alias("count_not_null"),
        F.count(F.when(present, 1)).alias("n_distinct"),
        F.min("num").alias("min_val"),
        F.max("num").alias("max_val"),
        F.min("text").alias("min_text"),
        F.max("text").alias("max_text"),
    )


def base_counts(df: DataFrame, rules: list[ColumnRule], load_col: str = "load_id") -> DataFrame:
    """One row per load and column with the counts that decide the findings.

    A single hash aggregation with a partial step: per load only fixed-width counters are shuffled. `shift` needs no median:
    the median lies below a threshold q exactly if at least half of the values are < q, above it if fewer than half are <= q.
    `lo_hash`/`hi_hash` are equal if and only if (but for a 64-bit collision) all values are equal.
    """
    aggs = []
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    for r in rules:
        v = F.col(f"v_{r.name}")
        below = flag(v < r.quantiles[25]) if r.numeric and len(r.quantiles) == 101 else F.lit(None).cast("bigint")
        upto = flag(v <= r.quantiles[75]) if r.numeric and len(r.quantiles) == 101 else F.lit(None).cast("bigint")
        out = F.lit(False)
        if r.numeric and r.lo is not None:
            out = out | (v < r.lo)
        if r.numeric and r.hi is not None:
            out = out | (v > r.hi)
        key = F.xxhash64(v + F.lit(0.0)) if r.numeric else F.xxhash64(v)
        key = F.when(v.isNotNull(), key)
        parts = {
            "not_null": F.count(v),
            "outside": flag(out),
            "unmatched": flag(~_full_match(v, r.regex)) if r.regex and not r.numeric else F.lit(0).cast("bigint"),
            "unknown": F.lit(0).cast("bigint") if not r.levels else flag(_unlisted(r)),
            "below_q25": below,
            "upto_q75": upto,
            "lo_hash": F.min(key),
            "hi_hash": F.max(key),
        }
        aggs += [x.alias(f"{k}__{r.name}") for k, x in parts.items()]
    values = _join_levels(df.select(F.col(load_col).alias("load_id"), *[_value(r).alias(f"v_{r.name}") for r in rules]), rules)
    wide = values.groupBy("load_id").agg(F.count(F.lit(1)).alias("count_all"), *aggs)
    names = ("not_null", "outside", "unmatched", "unknown", "below_q25", "upto_q75", "lo_hash", "hi_hash")
    rows = F.array(*[F.struct(F.lit(r.name).alias("col_name"), *[F.col(f"{n}__{r.name}").alias(n) for n in names]) for r in rules])
    return wide.select("load_id", "count_all", F.inline(rows))


#: Findings of a change of distribution; the others are rules on counts.
CHANGES = ("shift", "levels")


def findings_from_counts(counts: DataFrame, rules: list[ColumnRule], null_slack: float = 0.10, pattern_share: float = 0.01, level_share: float = 0.10, stuck_min: int = 20) -> DataFrame:
    """(load_id, col_name, issue), one row a finding that the counts bear out. A column without values in a load can only have `nulls`."""
    trusted = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.trusted_missing).cast("double"))]) if rules else F.create_map()
    n, nn = F.col("count_all"), F.col("not_null")
    missing = 1 - nn / n
    issues = F.array(
        F.when(missing > trusted[F.col("col_name")] + null_slack, F.lit("nulls")),
        F.when(F.col("outside") > 0, F.lit("range")),
        F.when((nn > 0) & (F.col("unmatched") > nn * pattern_share), F.lit("pattern")),
        F.when((nn > 0) & ((F.col("below_q25") * 2 >= nn) | (F.col("upto_q75") * 2 < nn)), F.lit("shift")),
        F.when((nn > 0) & (F.col("unknown") > nn * level_share), F.lit("levels")),
        F.when((nn >= stuck_min) & (F.col("lo_hash") == F.col("hi_hash")), F.lit("stuck")),
    )
    return counts.select("load_id", "col_name", F.explode(F.array_compact(issues)).alias("issue"))


# ---- classifier two-sample test ------------------------------------------------------------------------------------------


def _cuts(r: ColumnRule) -> np.ndarray:
    """Borders of a number's bins: trusted percentiles. The quartiles stand as values of their own, so that what lies beyond one is told from what equals it."""
    q = r.quantiles
    if len(q) != 101:
        return np.array([-1e3, -10.0, -1.0, 0.0, 1.0, 10.0, 1e3, 1e6])
    just_below = [float(np.nextafter(q[i], -np.inf)) for i in (0, 25)]
    return np.array(sorted({*just_below, *(q[i] for i in (5, 10, 25, 40, 50, 60, 75, 90, 95, 100))}))


def _text_code(r: ColumnRule, trusted: bool) -> Column:
    """A text as one of CODES codes: 0 missing, 1 pattern violated or (against the trusted load) level not listed, the rest hashed levels.

    Against the trusted load a column whose distribution the summary doesn't give has one code for all other values.
    """
    v = F.col(f"v_{r.name}")
    hashed = 2 + F.pmod(F.xxhash64(v), F.lit(CODES - 2)).cast("int")
    if trusted and r.levels:
        code = F.when(_unlisted(r), 1).otherwise(hashed)
    elif r.multi and not trusted:
        items = F.split(v, ",")
        code = 1 + F.least(F.size(items), F.lit(5)) + F.pmod(F.xxhash64(items[0]), F.lit(9)).cast("int")
    else:
        code = F.lit(2) if trusted else hashed
        code = F.when(_full_match(v, r.regex), code).otherwise(1) if r.regex else code
    return F.when(v.isNull(), 0).otherwise(code).cast("byte")


def _encoded(df: DataFrame, rules: list[ColumnRule], loads: DataFrame, load_col: str, key_col: str, trusted: bool, sample: bool = False) -> DataFrame:
    """(m, fold, c_<column>...): the number of the row's load, its half by the hash of its key, and per column a number or the code of a text.

    All rows of a key share a half, so a repeated sample never stands on both sides of the cross-fit. `sample` keeps the rows to
    fit on: keys whose hash is below the load's rate. Rows of loads that `loads` doesn't have are left out.
    """
    named = loads.select(F.col("load_id").alias("__load"), F.col("m").alias("__m"), F.col("rate").alias("__rate"))
    own = df.join(named, F.col(load_col).eqNullSafe(F.col("__load")))
    if sample:
        own = own.where((F.shiftrightunsigned(F.xxhash64(F.col(key_col), F.lit("train")), 11) / float(2**53)) < F.col("__rate"))
    fold = F.pmod(F.xxhash64(F.col(key_col), F.lit("fold")), F.lit(2)).cast("byte")
    vals = _join_levels(own.select(F.col("__m").alias("m"), fold.alias("fold"), *[_value(r).alias(f"v_{r.name}") for r in rules]), rules if trusted else [])
    return vals.select("m", "fold", *[(F.col(f"v_{r.name}") if r.numeric else _text_code(r, trusted)).alias(f"c_{r.name}") for r in rules])


def _code_matrix(columns: list[np.ndarray], cuts: list[np.ndarray | None]) -> np.ndarray:
    """(rows, columns) of codes; numbers are put in their bins, NaN is the code of missing values."""
    out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.int64)
    for i, (x, c) in enumerate(zip(columns, cuts, strict=True)):
        out[:, i] = x if c is None else np.where(np.isnan(x), 0, 1 + np.searchsorted(c, x, side="left"))
    return out


def trusted_codes(spark: SparkSession, rules: list[ColumnRule], rows: int = TRUSTED_ROWS, seed: int = 11) -> np.ndarray:
    """The trusted load drawn anew from its summary, as codes: each column from its trusted distribution, independently.

    That the columns are independent doesn't matter to a model without interactions: it sees the columns' own distributions.
    """
    rng = np.random.default_rng(seed)
    places = {}
    listed = [(i, x) for i, r in enumerate(rules) if r.levels and not r.numeric for x in r.levels]
    if listed:
        coded = spark.createDataFrame(listed, "i int, x string").select("i", "x", (2 + F.pmod(F.xxhash64("x"), F.lit(CODES - 2))).cast("int").alias("code"))
        places = {(r["i"], r["x"]): r["code"] for r in coded.collect()}  # the trusted levels
    out = np.zeros((rows, len(rules)), np.int64)
    for i, r in enumerate(rules):
        if r.numeric:
            ends = np.array(r.quantiles[1:] if len(r.quantiles) == 101 else [], float)
            codes, share = 1 + np.searchsorted(_cuts(r), ends, side="left"), np.ones(len(ends))
        elif r.levels:
            codes, share = np.array([places[i, x] for x in r.levels]), np.array(r.level_counts or [1.0] * len(r.levels))
        else:
            codes, share = np.array([2]), np.ones(1)
        if len(codes) and share.sum() > 0:
            out[:, i] = rng.permutation(codes[np.minimum(np.searchsorted(np.cumsum(share) / share.sum(), (np.arange(rows) + 0.5) / rows), len(codes) - 1)])
        out[rng.random(rows) < (r.trusted_missing or 0.0), i] = 0
    return out


def fit_codes(codes: np.ndarray, y: np.ndarray, n_cols: int, l2: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on one-hot codes by Newton steps; weights (n_cols, CODES) and the intercept."""
    d = n_cols * CODES
    x = np.zeros((len(y), d + 1))
    x[np.arange(len(y))[:, None], codes + np.arange(n_cols) * CODES] = 1.0
    x[:, d] = 1.0
    w = np.zeros(d + 1)
    ridge = np.full(d + 1, l2)
    ridge[d] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        s = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(ridge), g)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:d].reshape(n_cols, CODES), float(w[d])


def _load_table(counts: DataFrame, load_type: str, train_rows: int, with_null: bool) -> tuple[DataFrame, list]:
    """(load_id, m, rate) and the load ids in order: m numbers the loads, rate is the share of a load's keys to fit on. One row a load."""
    spark = counts.sparkSession
    sizes = [(r["load_id"], r["n"]) for r in counts.groupBy("load_id").agg(F.max("count_all").alias("n")).collect() if with_null or r["load_id"] is not None]
    sizes.sort(key=lambda x: (x[0] is not None, x[0]))
    table = spark.createDataFrame([(x, m, min(1.0, train_rows / n)) for m, (x, n) in enumerate(sizes)], f"load_id {load_type}, m int, rate double")
    return (F.broadcast(table) if len(sizes) <= MAX_BROADCAST_LOADS else table), [x for x, _ in sizes]


_TEST = "m int, col_name string, n_rows bigint, auc double, auc_without double, auc_alone double, seen bigint"


def _two_sample(df: DataFrame, rules: list[ColumnRule], counts: DataFrame, load_col: str, key_col: str, train_rows: int, trusted: bool) -> tuple[DataFrame, list]:
    """(_TEST rows, load ids by m): every load against the trusted one, or every load but the first against its predecessor.

    Fitting takes a bounded hash sample of each load, one group per load and half, on the executors. Scoring reads every row
    once, holds the models of at most LOADS_PER_PASS loads and shuffles only histograms; what is evaluated per load at the
    end has a fixed size.
    """
    spark, names, k = df.sparkSession, [r.name for r in rules], len(rules)
    cols, cuts = [f"c_{n}" for n in names], [_cuts(r) if r.numeric else None for r in rules]
    loads, ids = _load_table(counts, df.schema[load_col].dataType.simpleString(), train_rows, with_null=trusted)
    result = spark.createDataFrame([], _TEST)
    if len(ids) < (1 if trusted else 2) or not k:
        return result, ids
    base = trusted_codes(spark, rules) if trusted else None
    half = None if base is None else np.arange(len(base)) % 2
    size = k * CODES + k + 1 + k

    picked = _encoded(df, rules, loads, load_col, key_col, trusted, sample=True).withColumn("y", F.lit(1).cast("byte"))
    if not trusted:
        both = F.array(F.struct(F.col("m"), F.lit(1).cast("byte").alias("y")), F.struct((F.col("m") + 1).alias("m"), F.lit(0).cast("byte").alias("y")))
        picked = picked.withColumn("r", F.explode(both)).select("r.m", "fold", *cols, "r.y").where(F.col("m").between(1, len(ids) - 1))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        fold, y = int(pdf["fold"].iloc[0]), pdf["y"].to_numpy(np.float64)
        codes = _code_matrix([pdf[c].to_numpy(np.float64 if cut_ is not None else np.int64) for c, cut_ in zip(cols, cuts, strict=True)], cuts)
        seen = (codes[y > 0] > 0).sum(axis=0)
        if base is not None:
            codes, y = np.concatenate([codes, base[half == fold]]), np.append(y, np.zeros(int((half == fold).sum())))
        wts, b = fit_codes(codes, y, k) if 0 < y.sum() < len(y) else (np.zeros((k, CODES)), 0.0)
        means = wts[np.arange(k), codes].mean(axis=0)
        return pd.DataFrame({"m": [int(pdf["m"].iloc[0])], "fold": [fold], "w": [[*wts.ravel(), *means, b, *seen]]})

    models = cut(picked.groupBy("m", "fold").applyInPandas(fit, "m int, fold tinyint, w array<double>"))
    for lo in range(0 if trusted else 1, len(ids), LOADS_PER_PASS):
        hi = min(len(ids), lo + LOADS_PER_PASS)
        weights, fitted = np.zeros((hi - lo, 2, size)), np.zeros((hi - lo, 2), bool)
        for r in models.where(F.col("m").between(lo, hi - 1)).collect():  # a row of fixed size per load of the pass
            weights[r["m"] - lo, r["fold"]], fitted[r["m"] - lo, r["fold"]] = r["w"], True
        shared = spark.sparkContext.broadcast(weights)  # LOADS_PER_PASS times a fixed size
        rows = _encoded(df, rules, loads, load_col, key_col, trusted).where(F.col("m").between(lo - (not trusted), hi - 1))
        cells = _histograms(rows, cols, cuts, shared, lo, hi, both_sides=not trusted)
        cells = cells.groupBy("m", "y", "kind", "at").agg(F.sum("n").alias("n"))

        result = result.unionByName(cells.groupBy("m").applyInPandas(_evaluator(shared, lo, fitted, base, names), _TEST))
    return cut(result), ids


def _evaluator(shared, lo: int, fitted: np.ndarray, base: np.ndarray | None, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:  # noqa: ANN001
    """From the cells of one model to its rows of _TEST. Side 0 is counted here where it is the trusted load."""
    k = len(names)
    half = None if base is None else np.arange(len(base)) % 2

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["m"].iloc[0])
        w = shared.value[m - lo]
        hist = np.zeros((2, (k + 1) * SCORE_BINS), np.int64)
        seen = np.zeros((2, 2 * k * CODES), np.int64)
        for kind, into in ((0, hist), (1, seen)):
            own = pdf[pdf["kind"] == kind]
            np.add.at(into, (own["y"].to_numpy(), own["at"].to_numpy()), own["n"].to_numpy())
        if base is not None:
            for fold in (0, 1):
                codes = base[half == fold]
                np.add.at(hist[0], _score_cells(codes, w[1 - fold], k).ravel(), 1)
                np.add.at(seen[0], ((fold * k + np.arange(k)) * CODES + codes).ravel(), 1)
        parts = hist.reshape(2, k + 1, SCORE_BINS)
        total = parts[1, 0].sum() + (parts[0, 0].sum() if base is None else 0)
        auc = [_auc(parts[1, v], parts[0, v]) for v in range(k + 1)]
        by_code, alone = seen.reshape(2, 2, k, CODES), []
        for i in range(k):
            got = []
            for fold in (0, 1):
                rank = np.unique(w[1 - fold, i * CODES + 1 : (i + 1) * CODES], return_inverse=True)[1]
                pos, neg = (np.bincount(rank, weights=by_code[y, fold, i, 1:]) for y in (1, 0))
                got.append(_auc(pos, neg))
            alone.append(float(np.nanmean(got)) if not np.isnan(got).all() else float("nan"))
        known = w[:, -k:].min(axis=0) if fitted[m - lo].all() else np.zeros(k)
        return pd.DataFrame({"m": m, "col_name": names, "n_rows": int(total), "auc": auc[0], "auc_without": auc[1:], "auc_alone": alone, "seen": known.astype(np.int64)})

    return evaluate


def _auc(pos: np.ndarray, neg: np.ndarray) -> float:
    """Share of pairs in which the positive has the higher bin, ties half; NaN without pairs."""
    pairs = float(pos.sum()) * float(neg.sum())
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs else float("nan")


def _score_cells(codes: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """(rows, k + 1) cells `variant * SCORE_BINS + bin`: variant 0 is the whole model, i the model with column i's term at its mean."""
    part = w[codes + np.arange(k) * CODES]
    full = part.sum(axis=1) + w[k * CODES + k]
    score = np.concatenate([full[:, None], full[:, None] - part + w[k * CODES : k * CODES + k]], axis=1)
    return np.arange(k + 1) * SCORE_BINS + np.clip((score * 16).astype(np.int64) + SCORE_BINS // 2, 0, SCORE_BINS - 1)


_CELLS = "m int, y tinyint, kind tinyint, at int, n bigint"


def _histograms(enc: DataFrame, cols: list[str], cuts: list[np.ndarray | None], shared, lo: int, hi: int, both_sides: bool) -> DataFrame:  # noqa: ANN001
    """Per model and side the cells of the held-out scores (kind 0) and of the codes per half (kind 1). A load's rows are side 1 of its own
    model and, with `both_sides`, side 0 of the next load's. Only cells that were touched are handed on."""
    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (m, y), arrays in held.items():
                for kind, a in enumerate(arrays):
                    at = np.flatnonzero(a)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m, np.int32)), pa.array(np.full(n, y, np.int8)), pa.array(np.full(n, kind, np.int8)), pa.array(at.astype(np.int32)), pa.array(a[at])], names=["m", "y", "kind", "at", "n"])
            held.clear()

        for b in batches:
            load, fold = b.column("m").to_numpy(), b.column("fold").to_numpy().astype(np.int64)
            codes = _code_matrix([pc.fill_null(b.column(c), np.nan).to_numpy() if cut_ is not None else b.column(c).to_numpy() for c, cut_ in zip(cols, cuts, strict=True)], cuts)
            for x in np.unique(load).tolist():
                own = load == x
                cd, fd = codes[own], fold[own]
                for m, y in ((x, 1), (x + 1, 0)) if both_sides else ((x, 1),):
                    if not lo <= m < hi:
                        continue
                    if (m, y) not in held:
                        if len(held) >= LOADS_PER_FLUSH:
                            yield from flush()
                        held[m, y] = (np.zeros((k + 1) * SCORE_BINS, np.int64), np.zeros(2 * k * CODES, np.int64))
                    scores, seen = held[m, y]
                    for f in (0, 1):
                        part = cd[fd == f]
                        if len(part):
                            scores += np.bincount(_score_cells(part, shared.value[m - lo, 1 - f], k).ravel(), minlength=len(scores))
                            seen += np.bincount(((f * k + np.arange(k)) * CODES + part).ravel(), minlength=len(seen))
        yield from flush()

    return enc.mapInArrow(run, _CELLS)


def trusted_drift(df: DataFrame, rules: list[ColumnRule], load_col: str = "load_id", key_col: str = "sample_id", train_rows: int = TRAIN_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """(load_id, col_name, n_rows, auc, drop, auc_alone, seen, cleared): each load, that of NULL ids included, against the trusted one.

    `auc` is the cross-fitted AUC over all rows, `drop` what is lost of it when the column's term is set to its mean, `auc_alone`
    the AUC of that term alone among present values. `cleared` means that the test saw enough values and found no change.
    """
    counts = counts if counts is not None else base_counts(df, rules, load_col)
    test, ids = _two_sample(df, rules, counts, load_col, key_col, train_rows, trusted=True)
    names = df.sparkSession.createDataFrame(list(enumerate(ids)), f"m int, load_id {df.schema[load_col].dataType.simpleString()}")
    drop = F.col("auc") - F.col("auc_without")
    calm = (F.abs(F.col("auc_alone") - 0.5) < CLEAR_AUC) & (drop < CLEAR_DROP)
    cleared = (F.col("seen") >= MIN_SEEN) & F.coalesce(calm & ~F.isnan("auc_alone"), F.lit(False))
    return test.join(names, "m").select("load_id", "col_name", "n_rows", "auc", drop.alias("drop"), "auc_alone", "seen", cleared.alias("cleared"))


def load_drift(df: DataFrame, rules: list[ColumnRule], load_col: str = "load_id", key_col: str = "sample_id", train_rows: int = TRAIN_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """(load_id, prev_load_id, col_name, n_rows, auc, auc_without, drop, auc_alone): each load with a predecessor in the order of the ids.

    As `trusted_drift`, but against the load before. Rows without a load id are left out; a table with fewer than two loads
    gives an empty result.
    """
    counts = counts if counts is not None else base_counts(df, rules, load_col)
    test, ids = _two_sample(df, rules, counts, load_col, key_col, train_rows, trusted=False)
    t = df.schema[load_col].dataType.simpleString()
    names = df.sparkSession.createDataFrame([(m, x, ids[m - 1]) for m, x in enumerate(ids) if m], f"m int, load_id {t}, prev_load_id {t}")
    return test.join(names, "m").select("load_id", "prev_load_id", "col_name", "n_rows", "auc", "auc_without", (F.col("auc") - F.col("auc_without")).alias("drop"), "auc_alone")


def load_findings(df: DataFrame, rules: list[ColumnRule], load_col: str = "load_id", key_col: str = "sample_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(load_id, col_name, issue, auc, drop, auc_alone): the findings with the evidence of the classifier against the trusted load.

    Changes of distribution (`shift`, `levels`) come out for the columns of a load that the classifier doesn't clear and whose
    exact counts confirm the change; the other findings are rules on the exact counts. Where the classifier saw too few values
    of a column to clear it, the counts are looked at too, so small loads lose nothing.
    """
    counts = cut(base_counts(df, rules, load_col))  # one row a load and column
    test = trusted_drift(df, rules, load_col, key_col, train_rows, counts)
    test = test.select(F.col("load_id").alias("d_load"), F.col("col_name").alias("d_col"), "auc", "drop", "auc_alone", "cleared")
    found = findings_from_counts(counts, rules).join(test, F.col("load_id").eqNullSafe(F.col("d_load")) & (F.col("col_name") == F.col("d_col")), "left")
    change = F.col("issue").isin(*CHANGES)
    return found.where(~change | ~F.coalesce("cleared", F.lit(False))).select("load_id", "col_name", "issue", "auc", "drop", "auc_alone")
