"""Two-sample and one-sample Kolmogorov-Smirnov tests: the statistic distributed, the p-value from (D, n, m) on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.running import running_total

#: Below this product of sample sizes the p-value is exact.
EXACT_BELOW = 10_000


def ks_statistic(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair_no, left_col, right_col, d, n, m): the largest distance of the two distribution functions per column pair.

    NULL is left out; NaN is a value above all others. Equal values are counted together, so ties need no special care.
    A sample without values gives n or m = 0 and no d. Pairs are kept by position, so a pair may occur twice.
    """

    def side(df: DataFrame, which: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias("pair_no"), F.col(p[which]).cast("double").alias("v")) for i, p in enumerate(pairs)])
        return df.select(F.inline(cells)).select("pair_no", (F.col("v") + F.lit(0.0)).alias("v"), F.lit(1 - which).alias("a"), F.lit(which).alias("b"))

    both = side(left, 0).unionByName(side(right, 1)).where("v IS NOT NULL")
    cells = both.groupBy("pair_no", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = running_total(cells, ["pair_no"], ["v"], {"ca": "a", "cb": "b"})
    total = cells.groupBy(F.col("pair_no").alias("k")).agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    gap = F.abs((F.col("ca") + F.col("a")) / F.nullif("n", F.lit(0)) - (F.col("cb") + F.col("b")) / F.nullif("m", F.lit(0)))
    per = run.join(total, F.col("pair_no") == F.col("k")).groupBy("pair_no").agg(F.max(gap).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))
    names = left.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, left_col string, right_col string")
    return names.join(per, F.col("i") == F.col("pair_no"), "left").select(F.col("i").alias("pair_no"), "left_col", "right_col", "d", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


def kolmogorov_tail(t: float, tolerance: float = 1e-20, most: int = 100_000) -> float:
    """P(K > t) of the limiting distribution: 2 * sum of (-1)^(i-1) exp(-2 i^2 t^2)."""
    if t <= 0:
        return 1.0
    if t < 0.4:  # the alternating series cancels there; its dual form converges at once
        c = math.pi**2 / (8 * t * t)
        return 1.0 - math.sqrt(2 * math.pi) / t * sum(math.exp(-((2 * i - 1) ** 2) * c) for i in range(1, 20))
    total = 0.0
    for i in range(1, most):
        term = math.exp(-2.0 * i * i * t * t)
        total += term if i % 2 else -term
        if term <= tolerance:
            break
    return min(1.0, max(0.0, 2 * total))


def asymptotic_p(d: float, n: int, m: int) -> float:
    return kolmogorov_tail(d * math.sqrt(n * m / (n + m)))


def exact_p(d: float, n: int, m: int, strict: bool = True) -> float:
    """P(D > d), or >= d if not strict, when all interleavings of n and m distinct values are equally likely.

    Counts lattice paths that stay within the distance; distances are compared as whole numbers of 1 / (n * m).
    """
    limit = round(d * n * m) if abs(d * n * m - round(d * n * m)) < 1e-6 else math.floor(d * n * m)
    inside = (lambda g: g <= limit) if strict else (lambda g: g < limit)
    row = [0.0] * (m + 1)
    for i in range(n + 1):
        for j in range(m + 1):
            if not inside(abs(i * m - j * n)):
                row[j] = 0.0
            elif i == 0 and j == 0:
                row[j] = 1.0
            else:
                # weights i/(i+j) and j/(i+j) keep the counts as probabilities
                row[j] = (row[j] * i / (i + j) if i else 0.0) + (row[j - 1] * j / (i + j) if j else 0.0)
    return 1.0 - row[m]


def p_value(d: float, n: int, m: int, strict: bool = True) -> float:
    """Exact for n * m < EXACT_BELOW, else asymptotic. Samples of fewer than two values raise ValueError."""
    if n < 2 or m < 2:
        raise ValueError(f"a sample needs two values at least, these have {n} and {m}")
    return exact_p(d, n, m, strict) if n * m < EXACT_BELOW else asymptotic_p(d, n, m)


def break_ties(x: np.ndarray, y: np.ndarray, seed: int = 100, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Both samples with a jitter below half the smallest gap wherever values tie, so that an exact p-value applies."""
    both = np.concatenate([x, y]).astype(float)
    values = np.unique(both)
    if len(values) == len(both):
        return x, y
    gap = np.diff(values).min() if len(values) > 1 else 1.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = both + rng.uniform(-gap / 2, gap / 2, len(both)) * 0.999
        if len(np.unique(moved)) == len(moved):
            return moved[: len(x)], moved[len(x) :]
    raise ValueError("ties remain")


def local_statistic(x: np.ndarray, y: np.ndarray) -> float:
    x, y = np.sort(x), np.sort(y)
    at = np.concatenate([x, y])
    return float(np.abs(np.searchsorted(x, at, "right") / len(x) - np.searchsorted(y, at, "right") / len(y)).max())


def ks_test(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """`ks_statistic` with p_value. Small pairs with ties are jittered first (they fit the driver: n * m < EXACT_BELOW)."""
    rows = []
    for r in ks_statistic(left, right, pairs).collect():
        d, n, m = r["d"], r["n"], r["m"]
        if n >= 2 and m >= 2 and n * m < EXACT_BELOW:
            x, y = (np.array([v[0] for v in df.select(F.col(c).cast("double")).where(F.col(c).isNotNull()).collect()]) for df, c in ((left, r["left_col"]), (right, r["right_col"])))
            d = local_statistic(*break_ties(x, y))
        rows.append((r["left_col"], r["right_col"], r["d"], n, m, p_value(d, n, m)))
    return left.sparkSession.createDataFrame(rows, "left_col string, right_col string, d double, n bigint, m bigint, p_value double")


def one_sample_statistic(x: np.ndarray, cdf: Callable[[np.ndarray], np.ndarray]) -> float:
    """Distance of a local sample from a given distribution function."""
    x = np.sort(x)
    f, i = cdf(x), np.arange(len(x))
    return float(max((f - i / len(x)).max(), ((i + 1) / len(x) - f).max()))


def one_sample_cdf(d: float, n: int) -> float:
    """P(D_n < d) by the matrix power of Marsaglia, Tsang and Wang (2003), in exact fractions up to n = 140, else the limit law."""
    if d <= 0.5 / n:
        return 0.0
    if d >= 1:
        return 1.0
    if n > 140:
        return 1.0 - kolmogorov_tail(math.sqrt(n) * d + 1 / (6 * math.sqrt(n)))
    k = math.ceil(n * d)
    h = float(k - Fraction(n) * Fraction(d).limit_denominator(10**12))
    size = 2 * k - 1
    mat = np.array([[1.0 if i - j + 1 >= 0 else 0.0 for j in range(size)] for i in range(size)])
    for i in range(size):
        mat[i, 0] -= h ** (i + 1)
        mat[size - 1, i] -= h ** (size - i)
    mat[size - 1, 0] += (2 * h - 1) ** size if 2 * h > 1 else 0.0
    for i in range(size):
        for j in range(size):
            if i - j + 1 > 0:
                mat[i, j] /= math.factorial(i - j + 1)
    out = np.eye(size)
    scale = 0
    for i in range(1, n + 1):
        out = out @ mat * (i / n)
        if abs(out[k - 1, k - 1]) > 1e140:
            out /= 1e140
            scale += 140
    return float(out[k - 1, k - 1] * 10.0**scale)


def monte_carlo_p(d: float, n: int, m: int, rounds: int = 10_000, strict: bool = True, seed: int = 1) -> float:
    """Share of random interleavings with a larger (or equal) distance."""
    rng, hits = np.random.default_rng(seed), 0
    step = np.concatenate([np.full(n, m), np.full(m, -n)])
    limit = round(d * n * m)
    for _ in range(rounds):
        far = np.abs(np.cumsum(rng.permutation(step))).max()
        hits += far > limit if strict else far >= limit
    return hits / rounds


def bootstrap_p(x: np.ndarray, y: np.ndarray, rounds: int = 10_000, strict: bool = True, seed: int = 1) -> float:
    """Share of resamples of the pooled values with a larger (or equal) distance."""
    rng, both = np.random.default_rng(seed), np.concatenate([x, y])
    d, hits = local_statistic(x, y), 0
    for _ in range(rounds):
        s = rng.choice(both, len(both))
        got = local_statistic(s[: len(x)], s[len(x) :])
        hits += got > d if strict else got >= d
    return hits / rounds
