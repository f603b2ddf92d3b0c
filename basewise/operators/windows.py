"""Operators on windows of positions: modification scores, enrichment windows, peaks, rolling medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import adjusted, combine, fisher_col
from . import intervals


def scaled(df: DataFrame, reads: tuple[float, float], to_smaller: bool = False) -> DataFrame:
    """Treated and untreated counts of libraries of different depth (mapped reads) brought to the larger depth, or to the smaller."""
    t, u = reads
    target = min(t, u) if to_smaller else max(t, u)
    names = {"t": target / t, "u": target / u}
    return df.withColumns({f"{s}_{c}": F.col(f"{s}_{c}") * k for s, k in names.items() for c in ("count", "coverage")})


def modification(df: DataFrame, window: int = 150, coverage: int = 10) -> DataFrame:
    """score: (treated - untreated) times the window's size by all counts of the window but the position's own; and ratio.

    The size leaves out the first and last position of the window, as published values do."""
    h = window // 2
    w = Window.partitionBy("id").orderBy("pos").rangeBetween(-h, h)
    own = F.col("t_count") + F.col("u_count")
    size = F.max("pos").over(w) - F.min("pos").over(w) - 1
    rest = F.sum(own).over(w) - own
    score = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(size * (F.col("t_count") - F.col("u_count")), rest), F.lit(0.0)))
    ratio = F.coalesce(F.try_divide(F.col("t_count"), F.col("t_coverage")), F.lit(0.0))
    enough = (F.col("t_coverage") >= coverage) & (F.col("u_coverage") >= coverage)
    return df.withColumns({"score": F.when(enough, score.cast("double")), "ratio": F.when(enough, ratio)})


def enrichment(df: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """log2 of coverage by its transcript's median, and by the same of the control if there is one (columns t_coverage, u_coverage)."""
    w = Window.partitionBy("id")

    def relative(c: str) -> Column:
        return (F.col(c) + pseudocount) / (F.percentile(c, 0.5).over(w) + pseudocount)

    ratio = relative("t_coverage") / relative("u_coverage") if "u_coverage" in df.columns else relative("t_coverage")
    return df.withColumn("enrichment", F.log2(ratio))


def starts(df: DataFrame, window: int, offset: int) -> DataFrame:
    """(id, start, end) of windows of window + 1 positions, every offset; those that would reach over the end are moved back to it."""
    ends = df.groupBy("id").agg(F.max("pos").alias("last"))
    w = ends.where("last > 0").select("id", "last", F.explode(F.expr(f"sequence(0, last - 1, {offset})")).alias("s"))
    return w.select("id", F.when(F.col("s") + window > F.col("last"), F.greatest(F.lit(0), F.col("last") - window)).otherwise(F.col("s")).alias("start"), F.least(F.col("s") + window, F.col("last")).alias("end"), F.col("s").alias("step"))


def scored(df: DataFrame, window: int, offset: int) -> DataFrame:
    """Mean enrichment and coverages of each window."""
    wins = starts(df, window, offset)
    inside = intervals.points_in(df, wins, ["id"], "pos", window + 1)
    aggs = [F.avg("enrichment").alias("score"), F.avg("t_coverage").alias("t_mean")]
    if "u_coverage" in df.columns:
        aggs.append(F.avg("u_coverage").alias("u_mean"))
    return inside.groupBy("id", "step", "start", "end").agg(*aggs)


def significant(wins: DataFrame, medians: DataFrame, p: float = 0.05, least: float = 3.0) -> DataFrame:
    """Windows whose Fisher p (rounded means against medians, adjusted by transcript) is below p and whose score reaches least."""
    joined = wins.join(medians, "id")
    if "u_mean" in wins.columns:
        u_mean, u_median = F.col("u_mean"), F.col("u_median")
    else:
        u_mean, u_median = F.avg("t_mean").over(Window.partitionBy("id")), F.col("t_median")
    tested = joined.withColumn("u_mean", u_mean).withColumn("p", fisher_col(F.col("t_mean"), F.col("t_median"), F.col("u_mean"), u_median))
    return adjusted(tested, "p", ["id"]).where((F.col("padj") < p) & (F.col("score") >= least)).select("id", "start", "end", "score", "padj")


def peaks(wins: DataFrame, distance: int = 50) -> DataFrame:
    """Windows at most distance apart as peaks: mean score, and p-values combined by Stouffer's method."""
    w = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = wins.withColumn("__new", F.coalesce((F.col("start") > reach + distance).cast("int"), F.lit(1)))
    islands = flagged.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"))
    return spans.join(combine(islands, ["id", "island"], "padj"), ["id", "island"]).withColumnRenamed("padj", "p").drop("island")


def refined(peaks: DataFrame, df: DataFrame, least: float, rounds: float = 0.5) -> DataFrame:
    """Peaks narrowed to the first and last position whose enrichment reaches least (or, failing that, half of it) with at least the transcript's median coverage, then widened over neighbours of which the same holds."""
    w = Window.partitionBy("id")
    good = df.withColumn("__median", F.percentile("t_coverage", 0.5).over(w)).where((F.col("enrichment") >= least * rounds) & (F.col("t_coverage") >= F.col("__median")))
    runs = intervals.islands(good, ["id"], "pos", F.lit(True)).select("id", F.col("start").alias("start2"), F.col("end").alias("end2"))
    held = peaks.join(runs, "id", "left").where(F.col("start2").isNull() | ((F.col("start2") <= F.col("end")) & (F.col("end2") >= F.col("start"))))
    got = held.groupBy(*peaks.columns).agg(F.min("start2").alias("a"), F.max("end2").alias("b"))
    out = peaks.join(got.select("id", F.col("start"), F.col("end"), "a", "b"), ["id", "start", "end"], "left")
    return out.withColumns({"start": F.coalesce("a", "start"), "end": F.coalesce("b", "end")}).drop("a", "b")


def summits(peaks: DataFrame, df: DataFrame, value: str = "t_coverage") -> DataFrame:
    """The longest run of positions with a peak's largest value, the first of equals: summit_start, summit_end."""
    spans = peaks.select("id", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    inside = intervals.points_in(df, spans, ["id"], "pos", 1024, ("p_start", "p_end"))
    top = inside.withColumn("__top", F.max(value).over(Window.partitionBy("id", "p_start", "p_end"))).where(F.col(value) == F.col("__top"))
    runs = intervals.islands(top, ["id", "p_start", "p_end"], "pos", F.lit(True))
    best = runs.groupBy("id", "p_start", "p_end").agg(F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("s"))
    return peaks.join(best.select("id", F.col("p_start").alias("start"), F.col("p_end").alias("end"), F.col("s.start").alias("summit_start"), F.col("s.end").alias("summit_end")), ["id", "start", "end"])


def rolling_median(df: DataFrame, value: str, half: int, least: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Median over half positions to each side, less the transcript's median; null where too few of the window have a value."""
    by = by or ["id"]
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(-half, half)
    share = F.count(value).over(w) / F.count(F.lit(1)).over(w)
    return df.withColumn("rolling", F.when(share >= least, F.percentile(value, 0.5).over(w) - F.percentile(value, 0.5).over(Window.partitionBy(*by))))


def metagene(df: DataFrame, size: int, value: str = "coverage") -> DataFrame:
    """Transcripts resampled to size bins by the nearest position, and summed."""
    lengths = df.groupBy("id").agg((F.max("pos") + 1).alias("n"))
    bins = lengths.select("id", "n", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("bin"))
    at = bins.select("id", "bin", F.floor(F.col("bin") / size * (F.col("n") - 1) + 0.5).alias("pos"))
    return at.join(df, ["id", "pos"]).groupBy("bin").agg(F.sum(value).alias("total"))
