"""Raw reactivities from counts and coverage: joins with controls, masks, and four scores.

Frames are long: one row for each (id, pos) with base, count and coverage. Missing values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_control(treated: DataFrame, prefix: str = "t", **controls: DataFrame) -> DataFrame:
    """Positions of the treated sample with those of each control, by id and position; bases must agree.

    Columns of a sample get its prefix (t_count, u_coverage). All sides shuffle on id alone, so that window functions
    over id that follow need no further exchange."""
    out = treated.select("id", "pos", "base", F.col("count").alias(f"{prefix}_count"), F.col("coverage").alias(f"{prefix}_coverage"))
    for name, control in controls.items():
        side = control.select("id", F.col("pos").alias("p"), F.col("base").alias("b"), F.col("count").alias(f"{name}_count"), F.col("coverage").alias(f"{name}_coverage"))
        out = out.join(side.withColumnRenamed("id", "i"), (F.col("id") == F.col("i")) & (F.col("pos") == F.col("p")) & (F.col("base") == F.col("b"))).drop("i", "p", "b")
    return out


def rejections(treated: DataFrame, control: DataFrame) -> DataFrame:
    """For each treated id why it is left out: absent, mismatch (of sequences) or ok."""

    def whole(df: DataFrame, name: str) -> DataFrame:
        bases = F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"])
        return df.groupBy("id").agg(F.array_join(bases, "").alias(name))

    return whole(treated, "t").join(whole(control, "u"), "id", "left").select("id", F.when(F.col("u").isNull(), "absent").when(F.col("t") != F.col("u"), "mismatch").otherwise("ok").alias("status"))


def covered(df: DataFrame, mean: float = 0, median: float = 0) -> DataFrame:
    """Rows of ids whose mean and median coverage reach the limits."""
    w = Window.partitionBy("id")
    kept = df.withColumns({"__mean": F.avg("coverage").over(w), "__median": F.percentile("coverage", 0.5).over(w)})
    return kept.where((F.col("__mean") >= mean) & (F.col("__median") >= median)).drop("__mean", "__median")


def rate(sample: str) -> Column:
    return F.try_divide(F.col(f"{sample}_count"), F.col(f"{sample}_coverage"))


def masked(samples: list[str], coverage: int, max_untreated: float = 1.0, max_rate: float = 1.0) -> Column:
    """True where a sample's coverage is too low, or a rate too high."""
    out = F.lit(False)
    for s in samples:
        out = out | (F.col(f"{s}_coverage") < coverage) | (rate(s) > max_rate)
        if s == "u":
            out = out | (rate(s) > max_untreated)
    return F.coalesce(out, F.lit(True))


def difference(df: DataFrame, coverage: int = 10, max_untreated: float = 0.05, max_rate: float = 0.2, ignore_lower: bool = False) -> DataFrame:
    """Treated rate less untreated rate, at least 0; divided by the denatured rate if there is one (0 where that is 0)."""
    denatured = "d_count" in df.columns
    mask = masked(["t", "u", *(["d"] if denatured else [])], coverage, max_untreated, max_rate)
    if ignore_lower:
        mask = mask | (rate("t") < rate("u"))
    raw = F.greatest(F.lit(0.0), rate("t") - rate("u"))
    if denatured:
        raw = F.coalesce(F.try_divide(raw, rate("d")), F.lit(0.0))
    return df.withColumn("raw", F.when(~mask, raw))


def log_ratio(df: DataFrame, reads: DataFrame | None = None, coverage: int = 10, pseudocount: float = 1.0, max_score: float = 10.0) -> DataFrame:
    """Logs of stops, each divided by the mean of its transcript's logs and of one more (the reads that stop nowhere); treated less untreated, from 0 to max_score.

    reads: id, t_reads, u_reads; without it the stops themselves count as the reads. A transcript whose mean is 0 gives null."""
    w = Window.partitionBy("id")
    df = df if reads is None else df.join(reads, "id")
    scaled = {}
    for s in ("t", "u"):
        logs = F.ln(F.col(f"{s}_count") + pseudocount)
        total = F.sum(f"{s}_count").over(w)
        rest = F.greatest(F.lit(0), (F.col(f"{s}_reads") if reads is not None else total) - total)
        mean = (F.sum(logs).over(w) + F.ln(rest + pseudocount)) / (F.count(F.lit(1)).over(w) + 1)
        scaled[s] = F.try_divide(logs, mean)
    raw = F.least(F.greatest(F.lit(0.0), scaled["t"] - scaled["u"]), F.lit(max_score))
    low = (F.col("t_coverage") < coverage) | (F.col("u_coverage") < coverage)
    return df.withColumn("raw", F.when(~low, raw))


def counts(df: DataFrame, coverage: int = 10) -> DataFrame:
    """Treated counts as they are."""
    return df.withColumn("raw", F.when(F.col("t_coverage") >= coverage, F.col("t_count").cast("double")))


def mutation_rate(df: DataFrame, coverage: int = 10, max_rate: float = 0.2) -> DataFrame:
    """Treated counts by coverage."""
    return df.withColumn("raw", F.when(~masked(["t"], coverage, max_rate=max_rate), rate("t")))
