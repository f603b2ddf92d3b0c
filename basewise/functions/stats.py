"""Special functions and tests of statistics, as vectorised functions and as columns.

Everything follows published formulae; a missing argument gives a missing result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

#: The smallest probability that the combinations of p-values take a logarithm of.
TINY = 1e-308

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_inverse = np.frompyfunc(NormalDist().inv_cdf, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def pnorm(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def dnorm(x: np.ndarray, mean: float = 0, sd: float = 1) -> np.ndarray:
    z = (np.asarray(x, float) - mean) / sd
    return np.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def qnorm(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    inside = np.clip(p, TINY, 1 - 2**-53)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.asarray(_inverse(inside), float)))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x >= (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                h *= d * c
        out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.clip(np.where(swap, 1 - out, out), 0, 1)


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function: by its series below a + 1, else by its continued fraction."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - log_gamma(a))
        term, total = 1 / a, 1 / a
        for n in range(1, 500):
            term = term * x / (a + n)
            total = total + term
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 500):
            num = -i * (i - a)
            b = b + 2
            d, c = 1 / (num * d + b), b + num / c
            h = h * d * c
        return np.clip(np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h)), 0, 1)


def chi_square_p(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def chi_square(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The p-value of a 2 x 2 table with Yates' correction; 1 if a margin is empty."""
    a, b, c, d = (np.asarray(v, float) for v in (a, b, c, d))
    n = a + b + c + d
    with np.errstate(all="ignore"):
        x = n * np.maximum(0, np.abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    return np.where(np.isfinite(x), chi_square_p(np.where(np.isfinite(x), x, 0), 1), 1.0)


def log_hyper(k: np.ndarray, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The logarithm of the hypergeometric probability of k good ones among n drawn."""

    def choose(m: np.ndarray, r: np.ndarray) -> np.ndarray:
        return log_gamma(m + 1) - log_gamma(r + 1) - log_gamma(m - r + 1)

    k, good, bad, n = (np.asarray(v, float) for v in (k, good, bad, n))
    return choose(good, k) + choose(bad, n - k) - choose(good + bad, n)


def fisher(a: float, b: float, c: float, d: float, two_sided: bool = False) -> float:
    """Fisher's exact test; one-sided towards the side on which the table stands (the sign of a d - b c)."""
    a, b, c, d = (int(math.floor(v + 0.5)) for v in (a, b, c, d))
    good, bad, n = a + b, c + d, a + c
    low, high = max(0, n - bad), min(good, n)
    if not two_sided:
        return min(1.0, _tail(a, high, good, bad, n) if a * d >= b * c else _tail(a, low, good, bad, n))
    p = np.exp(log_hyper(np.arange(low, high + 1), good, bad, n))
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


def _tail(k: int, end: int, good: int, bad: int, n: int) -> float:
    """The hypergeometric probability of k to end, k on end's side of the mean: terms fall faster and faster, and are summed until what is left can't change the sum."""
    step, size, total = (1 if end >= k else -1), 1024, 0.0
    while (end - k) * step >= 0:
        p = np.exp(log_hyper(np.arange(k, k + step * min(size, abs(end - k) + 1), step), good, bad, n))
        total += float(p.sum())
        # What is left is less than a geometric series that falls as the last two terms do.
        if len(p) > 1 and p[-1] < p[-2] and p[-1] * p[-1] / (p[-2] - p[-1]) <= total * 2**-60 or p[-1] == 0:
            break
        k, size = k + step * len(p), min(2 * size, 1 << 18)
    return total


def binomial(k: int, n: int, p: float = 0.5, alternative: str = "two.sided") -> float:
    """Exact binomial test; above 100 trials by the normal approximation of each probability."""
    x = np.arange(n + 1)
    if n > 100:
        prob = dnorm(x, n * p, math.sqrt(n * p * (1 - p)) or 1.0)
    else:
        with np.errstate(all="ignore"):
            prob = np.exp(log_gamma(n + 1) - log_gamma(x + 1) - log_gamma(n - x + 1) + np.where(x > 0, x * np.log(p or TINY), 0) + np.where(n - x > 0, (n - x) * np.log1p(-p) if p < 1 else -np.inf, 0))
    chosen = {"less": x <= k, "greater": x >= k}.get(alternative, prob <= prob[k] * (1 + 1e-7))
    return float(min(1.0, prob[chosen].sum()))


def correlation_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a correlation of n pairs by Student's distribution; 1 where it can't be told."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    with np.errstate(all="ignore"):
        df = n - 2
        x = np.clip(1 - r * r, 0, 1)
        return np.where((df > 0) & np.isfinite(r), beta_inc(np.maximum(df, 1) / 2, 0.5, x), 1.0)


def student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


# -- columns -----------------------------------------------------------------------------------------


def _column(f: Callable[..., np.ndarray], vectorised: bool = True) -> Callable[..., Column]:
    """f as a function of columns, by Arrow batches; rows with a missing argument give null."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = (columns,) if isinstance(columns, pd.Series) else columns
            known = ~np.logical_or.reduce([c.isna().to_numpy() for c in columns])
            args = [c.to_numpy(float, na_value=0)[known] for c in columns]
            out = np.full(len(known), np.nan)
            if known.any():
                out[known] = f(*args) if vectorised else [f(*row) for row in zip(*args, strict=True)]
            yield pd.Series(out).where(known, None)

    def call(*columns: Column | str) -> Column:
        return run(*(F.col(c) if isinstance(c, str) else c for c in columns))

    return call


pnorm_col = _column(pnorm)
qnorm_col = _column(qnorm)
correlation_p_col = _column(correlation_p)
student_p_col = _column(student_p)
chi_square_col = _column(chi_square)
chi_square_p_col = _column(chi_square_p)
fisher_col = _column(fisher, False)
beta_inc_col = _column(beta_inc)
gamma_q_col = _column(gamma_q)
log_gamma_col = _column(log_gamma)


def combine(df: DataFrame, by: list[str], p: str, method: str = "S") -> DataFrame:
    """One p for each group: Stouffer (S) or Fisher (F)."""
    kept = df.withColumn("__p", F.greatest(F.col(p), F.lit(TINY)))
    if method == "F":
        got = kept.groupBy(*by).agg((F.sum(F.ln("__p")) * -2).alias("__x"), (F.count("__p") * 2).alias("__d"))
        return got.withColumn(p, chi_square_p_col("__x", "__d")).drop("__x", "__d")
    got = kept.withColumn("__z", qnorm_col("__p")).groupBy(*by).agg((F.sum("__z") / F.sqrt(F.count("__z"))).alias("__x"))
    return got.withColumn(p, pnorm_col("__x")).drop("__x")


def adjusted(df: DataFrame, p: str, by: list[str] | None = None, method: str = "BH", n: int | None = None, running: bool = False, out: str = "padj") -> DataFrame:
    """Adjusted p-values, by key if one is given: Bonferroni, or Benjamini-Hochberg with the last rank of ties.

    running: the running maximum from the smallest p on, as the reference's own values have it, in place of the usual
    minimum from the largest p down. Missing values stay missing and aren't counted."""
    keys = [F.col(c) for c in by or []] or [F.lit(0)]
    whole = Window.partitionBy(*keys)
    total = F.lit(n) if n else F.count(p).over(whole)
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * total))
    # The count of values up to this one, ties included, is the last rank of its ties.
    rank = F.count(p).over(whole.orderBy(F.asc_nulls_last(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    scaled = df.withColumn("__s", F.when(F.col(p).isNotNull(), F.col(p) * total / rank))
    if running:
        end = F.max("__s").over(whole.orderBy(F.asc_nulls_last(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        end = F.min("__s").over(whole.orderBy(F.desc_nulls_last(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return scaled.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), end))).drop("__s")


def ranks(df: DataFrame, value: str, by: list[str], out: str = "rank", signed: bool = False) -> DataFrame:
    """Mean ranks of ties, from 1; null for null values (and for 0 if signed)."""
    keep = F.col(value).isNotNull() & ((F.col(value) != 0) if signed else F.lit(True))
    df = df.withColumn("__v", F.when(keep, F.col(value)))
    below = F.rank().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("__v")))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, "__v"))
    return df.withColumn(out, F.when(keep, below + (same - 1) / 2)).drop("__v")


def welch(df: DataFrame, by: list[str], group: str, value: str, paired_with: str | None = None) -> DataFrame:
    """Welch's t test between the groups 0 and 1 of each key: t, df and p (null if a group has under two values or no spread)."""
    if paired_with:
        d = df.withColumn("__d", F.col(value) - F.col(paired_with)).groupBy(*by).agg(F.avg("__d").alias("m"), F.stddev_samp("__d").alias("s"), F.count("__d").alias("n"))
        got = d.withColumn("t", F.try_divide(F.col("m") * F.sqrt("n"), F.col("s"))).withColumn("df", (F.col("n") - 1).cast("double"))
        return got.select(*by, "t", "df").withColumn("p", student_p_col("t", "df"))

    def moment(f: Callable, g: int, name: str) -> Column:
        return f(F.when(F.col(group) == g, F.col(value))).alias(name)

    got = df.groupBy(*by).agg(*(moment(f, g, f"{n}{g}") for g in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    e0, e1 = F.try_divide(F.col("v0"), F.col("n0")), F.try_divide(F.col("v1"), F.col("n1"))
    freedom = F.try_divide((e0 + e1) * (e0 + e1), F.try_divide(e0 * e0, F.col("n0") - 1) + F.try_divide(e1 * e1, F.col("n1") - 1))
    got = got.withColumns({"t": F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(e0 + e1)), "df": freedom})
    return got.select(*by, "t", "df").withColumn("p", student_p_col("t", "df"))


def rank_sum(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Wilcoxon's rank sum test between the groups 0 and 1 of each key, with tie and continuity corrections: w (of group 1), z and p."""
    ranked = ranks(df, value, by, "__r")
    ties = ranked.groupBy(*by, value).agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    one = F.col(group) == 1
    sums = ranked.groupBy(*by).agg(F.sum(F.when(one, F.col("__r"))).alias("rs"), F.count(F.when(one, 1)).alias("n1"), F.count(F.when(~one, 1)).alias("n0"))
    n = F.col("n0") + F.col("n1")
    w = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2
    spread = F.sqrt(F.col("n0") * F.col("n1") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    off = F.col("w") - F.col("n0") * F.col("n1") / 2
    got = sums.join(ties, by).withColumn("w", w).withColumn("z", F.try_divide(off - F.signum(off) * 0.5, spread))
    return got.select(*by, "w", "z").withColumn("p", F.lit(2.0) * pnorm_col(-F.abs("z")))


def signed_rank(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Wilcoxon's paired signed rank test, zero differences left out: v, z and p."""
    d = df.withColumn("__d", F.col(a) - F.col(b)).where("__d != 0").withColumn("__a", F.abs("__d"))
    ranked = ranks(d, "__a", by, "__r")
    ties = ranked.groupBy(*by, "__a").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    got = ranked.groupBy(*by).agg(F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0.0)).alias("v"), F.count(F.lit(1)).alias("n")).join(ties, by)
    off = F.col("v") - F.col("n") * (F.col("n") + 1) / 4
    z = F.try_divide(off - F.signum(off) * 0.5, F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48))
    return got.withColumn("z", z).select(*by, "v", "z").withColumn("p", F.lit(2.0) * pnorm_col(-F.abs("z")))
