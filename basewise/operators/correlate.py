"""Correlation of profiles from partial sums, with the usual ways to clean values first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import correlation_p_col, ranks


def pairs(profiles: DataFrame, keys: list[str], value: str = "value", sample: str = "sample") -> DataFrame:
    """Values of each two samples (s1 < s2) at the same keys; missing ones are left out."""
    known = profiles.where(F.col(value).isNotNull())
    a = known.select(*keys, F.col(sample).alias("s1"), F.col(value).alias("x"))
    b = known.select(*keys, F.col(sample).alias("s2"), F.col(value).alias("y"))
    return a.join(b, keys).where("s1 < s2")


def cleaned(df: DataFrame, by: list[str], x: str = "x", y: str = "y", cap: float | None = None, outliers: bool = False) -> DataFrame:
    """Pairs with both values, capped, and without those outside the 5th to 95th percentile of either column of their key."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if cap is not None:
        df = df.withColumns({x: F.least(F.col(x), F.lit(cap)), y: F.least(F.col(y), F.lit(cap))})
    if outliers:
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        df = df.withColumns({f"__{c}{q}": F.percentile(c, q / 100).over(w) for c in (x, y) for q in (5, 95)})
        df = df.where(F.col(x).between(F.col(f"__{x}5"), F.col(f"__{x}95")) & F.col(y).between(F.col(f"__{y}5"), F.col(f"__{y}95"))).drop(*(f"__{c}{q}" for c in (x, y) for q in (5, 95)))
    return df


def partials(x: Column, y: Column) -> list[Column]:
    """The six sums that a correlation needs; sums of parts add up to sums of the whole."""
    x, y = x.cast("double"), y.cast("double")
    return [F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")]


def from_partials() -> Column:
    """r, null for a constant column."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    small = 1e-9 * n
    return F.when((vx > small * F.abs(sxx)) & (vy > small * F.abs(syy)), F.try_divide(n * sxy - sx * sy, F.sqrt(vx * vy)))


def pearson(df: DataFrame, by: list[str], x: str = "x", y: str = "y", p: bool = False) -> DataFrame:
    got = df.groupBy(*by).agg(*partials(F.col(x), F.col(y))).withColumn("r", from_partials())
    return got.withColumn("p", F.coalesce(correlation_p_col("r", "n"), F.lit(1.0))).select(*by, "n", "r", "p") if p else got.select(*by, "n", "r")


def spearman(df: DataFrame, by: list[str], x: str = "x", y: str = "y", p: bool = False) -> DataFrame:
    """Pearson's correlation of mean ranks."""
    return pearson(ranks(ranks(df, x, by, "__rx"), y, by, "__ry"), by, "__rx", "__ry", p)


def replicates(df: DataFrame, samples: int, keys: list[str], value: str = "value", logs: bool = False, ignore_missing: bool = False) -> DataFrame:
    """Mean and deviation over replicates (geometric with logs), null where one lacks a value unless that is ignored."""
    v = F.col(value)
    if logs:
        v = F.ln(F.greatest(v, F.lit(1e-308)))
    mean, sd = F.avg(v), F.coalesce(F.stddev_samp(v), F.lit(0.0))
    if logs:
        mean, sd = F.exp(mean), F.exp(sd)
    whole = F.count(value) > 0 if ignore_missing else F.count(value) == samples
    return df.groupBy(*keys).agg(F.when(whole, mean).alias("mean"), F.when(whole, sd).alias("sd"))


def matrix(rs: DataFrame, value: str = "r") -> DataFrame:
    """Correlations of sample pairs as a square table: one row and column for each sample, 1 on the diagonal."""
    both = rs.select("s1", "s2", value).unionByName(rs.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), value))
    own = both.select("s1").distinct().select("s1", F.col("s1").alias("s2"), F.lit(1.0).alias(value))
    return both.unionByName(own).groupBy(F.col("s1").alias("sample")).pivot("s2").agg(F.first(value))


def attribute_conflicts(df: DataFrame, by: list[str], attributes: list[str]) -> DataFrame:
    """by, replicates, and conflicts: the attributes (in order) of which the replicates of a group have different values; null is a value too."""
    counts = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"__{i}") for i, c in enumerate(attributes)]
    got = df.groupBy(*by).agg(F.count(F.lit(1)).alias("replicates"), *counts)
    names = F.array_compact(F.array(*(F.when(F.col(f"__{i}") > 1, F.lit(c)) for i, c in enumerate(attributes))))
    return got.select(*by, "replicates", names.alias("conflicts"))


def consistent(df: DataFrame, by: list[str], attributes: list[str]) -> DataFrame:
    """The rows of groups whose replicates agree in all attributes."""
    return df.join(attribute_conflicts(df, by, attributes).where(F.size("conflicts") == 0).select(*by), by, "left_semi")


def in_all(df: DataFrame, key: str, sample: str, n: int) -> DataFrame:
    """The keys that n samples have."""
    return df.groupBy(key).agg(F.count_distinct(sample).alias("n")).where(F.col("n") == n).select(key)
