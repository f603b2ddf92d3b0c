"""Normalisers of raw reactivities, by transcript (or any other key), as window expressions without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A method needs so many values.
LEAST = 10
METHODS = ("2-8", "winsor", "boxplot", "mitchell")
#: Scores and normalisers that don't go together.
FORBIDDEN = {("rouskin", "2-8"), ("rouskin", "boxplot"), ("rouskin", "mitchell"), ("ding", "mitchell")}


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def check(score: str, method: str) -> None:
    if (score.lower(), method) in FORBIDDEN:
        raise ValueError(f"{method} normalisation doesn't go with {score} scores")


def _factor(by: list[str], value: str, method: str) -> Callable[[DataFrame], DataFrame]:
    """Adds the columns __n and __factor (and __floor for winsor) by key; rows without a value don't count."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)

    def ranked(df: DataFrame, descending: bool) -> DataFrame:
        order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
        return df.withColumns({"__rank": F.row_number().over(w.orderBy(order)) - 1, "__n": n})

    def two_eight(df: DataFrame) -> DataFrame:
        low, high = F.greatest(F.lit(1), half_up(F.col("__n") * 0.02) - 1), F.greatest(F.lit(1), half_up(F.col("__n") * 0.1) - 1)
        chosen = F.when(F.col("__rank").between(low, high), F.col(value))
        return ranked(df, True).withColumn("__factor", F.avg(chosen).over(w)).drop("__rank")

    def winsor(df: DataFrame) -> DataFrame:
        return df.withColumns({"__n": n, "__floor": F.coalesce(F.percentile(value, 0.05).over(w), F.lit(0.0)), "__factor": F.percentile(value, 0.95).over(w)})

    def boxplot(df: DataFrame) -> DataFrame:
        q1, q3 = F.percentile(value, 0.25).over(w), F.percentile(value, 0.75).over(w)
        df = ranked(df, True).withColumn("__limit", q3 + (q3 - q1) * 1.5)
        over = F.sum((F.col(value) > F.col("__limit")).cast("int")).over(w)
        outliers = F.when(F.col("__n") < 50, half_up(F.col("__n") * 0.02)).otherwise(over)
        df = df.withColumn("__out", F.greatest(F.lit(1), outliers))
        take = F.when(F.col("__n").between(50, 99), F.lit(10)).otherwise(half_up(F.col("__n") * 0.1))
        chosen = F.when((F.col("__rank") >= F.col("__out")) & (F.col("__rank") < F.col("__out") + take), F.col(value))
        return df.withColumn("__factor", F.avg(chosen).over(w)).drop("__rank", "__limit", "__out")

    def mitchell(df: DataFrame) -> DataFrame:
        df = ranked(df, False)
        low, high = F.greatest(F.lit(1), half_up(F.col("__n") * 0.9) - 1), F.greatest(F.lit(1), half_up(F.col("__n") * 0.95) - 1)
        above = F.sum((F.col(value) > 0.001).cast("int")).over(w)
        df = df.withColumns({"__mean": F.avg(F.when(F.col("__rank").between(low, high), F.col(value))).over(w), "__above": above})
        # The quarter mark among the values above 0.001, which are the last ones in rank order.
        place = F.col("__n") - F.col("__above") + F.greatest(F.lit(1), half_up(F.col("__above") * 0.75) - 1)
        top = F.max(F.when(F.col("__rank") == place, F.col(value))).over(w)
        return df.withColumn("__top", top).withColumn("__factor", F.greatest("__mean", "__top")).drop("__rank", "__mean", "__above", "__top")

    return {"2-8": two_eight, "winsor": winsor, "boxplot": boxplot, "mitchell": mitchell}[method]


def normalise(df: DataFrame, method: str, by: list[str] | None = None, value: str = "raw", factor: tuple[float, ...] | None = None, out: str = "norm") -> DataFrame:
    """value by its key's factor (or a given one; winsor takes two): null where a key has under LEAST values or a factor of 0."""
    by = by or ["id"]
    if factor is not None:
        df = df.withColumns({"__n": F.lit(LEAST), "__factor": F.lit(float(factor[-1])), "__floor": F.lit(float(factor[0]))})
    else:
        df = _factor(by, value, method)(df)
    scaled = F.try_divide(F.col(value), F.col("__factor"))
    if method == "winsor":
        scaled = F.least(F.try_divide(F.greatest(F.col(value), F.col("__floor")), F.col("__factor")), F.lit(1.0))
    else:
        scaled = F.greatest(F.lit(0.0), scaled)
    usable = (F.col("__n") >= LEAST) & (F.col("__factor") != 0) & F.col(value).isNotNull()
    return df.withColumn(out, F.when(usable, scaled)).drop("__n", "__factor", "__floor")


def remap(value: Column, largest: Column) -> Column:
    """Piecewise linear map of normalised reactivities to 0..1 with the fixed cut points 0.25, 0.3 and 0.7."""

    def line(a: float, b: Column | float, c: float, d: float) -> Column:
        return F.try_divide((value - a) * (d - c), F.lit(b) - a if isinstance(b, float) else b - a) + c

    return F.when(value < 0.25, line(0.0, 0.25, 0.0, 0.35)).when(value < 0.3, line(0.25, 0.3, 0.35, 0.55)).when(value < 0.7, line(0.3, 0.7, 0.55, 0.85)).otherwise(F.coalesce(line(0.7, largest, 0.85, 1.0), F.lit(0.85)))


def remapped(df: DataFrame, value: str = "norm", out: str = "norm") -> DataFrame:
    w = Window.partitionBy("id")
    return df.withColumn(out, F.when(F.col(value).isNotNull(), remap(F.col(value), F.max(value).over(w))))


def sliding(df: DataFrame, method: str, size: int, step: int, by_base: bool = False, value: str = "raw") -> DataFrame:
    """Each window of size positions (every step, and one at the end if a tail is left) normalised on its own; positions in several windows get the mean, null if any of them gave null.

    A transcript's length is its largest position plus 1."""
    w = Window.partitionBy("id")
    df = df.withColumn("__len", F.max("pos").over(w) + 1)
    wide, pace = F.least(F.lit(size), F.col("__len")), F.when(F.col("__len") <= size, F.col("__len")).otherwise(F.lit(step))
    df = df.withColumns({"__wide": wide, "__pace": pace})
    last = F.expr("(__len - __wide) div __pace * __pace")
    regular = F.expr("if(least(pos, __len - __wide) div __pace >= greatest(0, ceil((pos - __wide + 1) / __pace)), transform(sequence(cast(greatest(0, ceil((pos - __wide + 1) / __pace)) as bigint), cast(least(pos, __len - __wide) div __pace as bigint)), k -> k * __pace), array())")
    tail = F.when((last + F.col("__wide") < F.col("__len")) & (F.col("pos") >= F.col("__len") - F.col("__wide")), F.array((F.col("__len") - F.col("__wide")).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    spread = df.withColumn("__win", F.explode(F.concat(regular, tail))).drop("__wide", "__pace", "__len")
    scored = normalise(spread, method, ["id", "__win", *(["base"] if by_base else [])], value)
    keep = [c for c in df.columns if not c.startswith("__") and c not in ("id", "pos")]
    mean = F.when(F.count("norm") == F.count(F.lit(1)), F.avg("norm"))
    return scored.groupBy("id", "pos").agg(*(F.first(c).alias(c) for c in keep), mean.alias("norm"))


def dynamic(df: DataFrame, method: str, bases: list[str], size: int, step: int, value: str = "raw") -> DataFrame:
    """As sliding, with windows of size reactive bases, every step reactive bases; other bases stay null."""
    w = Window.partitionBy("id")
    chosen = df.where(F.col("base").isin(bases)).withColumn("__pos", F.row_number().over(w.orderBy("pos")) - 1)
    inner = chosen.withColumnRenamed("pos", "__real").withColumnRenamed("__pos", "pos")
    return sliding(inner.withColumnRenamed("__real", "real_pos"), method, size, step, value=value).drop("pos").withColumnRenamed("real_pos", "pos")
