"""How well reactivities tell unpaired from paired bases, and grids of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unpaired_coefficient(df: DataFrame, by: list[str], cutoff: float = 0.7) -> DataFrame:
    """Of the reactive bases (value from cutoff on), the share that is unpaired. df: value, paired (boolean)."""
    reactive = F.col("value") >= cutoff
    return df.groupBy(*by).agg(F.try_divide(F.count_if(reactive & ~F.col("paired")), F.count_if(reactive)).alias("coefficient"))


def dsci(df: DataFrame, by: list[str]) -> DataFrame:
    """Probability that an unpaired base is more reactive than a paired one (ties don't count), from ranks instead of all pairs."""
    known = df.where(F.col("value").isNotNull())
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # Paired bases strictly below each unpaired one.
    below = F.count_if(F.col("paired")).over(w.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count_if(F.col("paired")).over(Window.partitionBy(*by, "value") if by else Window.partitionBy("value"))
    got = known.withColumn("__below", below).groupBy(*by).agg(F.sum(F.when(~F.col("paired"), F.col("__below"))).alias("s"), F.count_if(F.col("paired")).alias("p"), F.count_if(~F.col("paired")).alias("u"))
    return got.select(*by, F.try_divide(F.col("s"), F.col("p") * F.col("u")).alias("dsci"))


def roc(df: DataFrame, by: list[str], steps: int = 1000) -> DataFrame:
    """(cutoff, tpr, fpr) by cutoff from 0 to 1: one histogram by step, then running sums from the top."""
    known = df.where(F.col("value").isNotNull())
    bin_ = F.greatest(F.lit(-1), F.least(F.lit(steps), F.floor(F.col("value") * steps + 1e-9))).cast("int")
    counts = known.groupBy(*by, bin_.alias("k")).agg(F.count_if(~F.col("paired")).alias("u"), F.count_if(F.col("paired")).alias("p"))
    keys = counts.groupBy(*by).agg(F.sum("u").alias("nu"), F.sum("p").alias("np"))
    dense = keys.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).join(counts, [*by, "k"], "left").fillna(0, ["u", "p"])
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    down = w.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dense.select(*by, "k", F.try_divide(F.sum("u").over(down), F.col("nu")).alias("tpr"), F.try_divide(F.sum("p").over(down), F.col("np")).alias("fpr"))


def auroc(df: DataFrame, by: list[str], steps: int = 1000) -> DataFrame:
    """Area under that curve by trapezoids, from (1, 1) to (0, 0)."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("k")
    c = roc(df, by, steps).withColumns({"t2": F.coalesce(F.lead("tpr").over(w), F.lit(0.0)), "f2": F.coalesce(F.lead("fpr").over(w), F.lit(0.0)), "t0": F.lag("tpr").over(w)})
    first = F.when(F.col("t0").isNull(), (1 + F.col("tpr")) * (1 - F.col("fpr")) / 2).otherwise(0.0)
    got = c.groupBy(*by).agg(F.sum((F.col("tpr") + F.col("t2")) * (F.col("fpr") - F.col("f2")) / 2 + first).alias("auroc"))
    return got


def grid(spark, slopes: tuple[float, float, float], intercepts: tuple[float, float, float]) -> DataFrame:
    """Every pair of slope and intercept (first, last, step)."""

    def values(a: float, b: float, step: float) -> list[tuple[float]]:
        return [(round(a + i * step, 10),) for i in range(int((b - a) / step + 1.5))]

    return spark.createDataFrame(values(*slopes), "slope double").crossJoin(spark.createDataFrame(values(*intercepts), "intercept double"))


def grid_scores(df: DataFrame, score: str, method: str = "geometric") -> DataFrame:
    """Score by (slope, intercept): geometric mean (0 if any is 0), mean or median."""
    how = {"mean": F.avg(score), "median": F.percentile(score, 0.5), "geometric": F.when(F.min(score) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(F.col(score) > 0, F.col(score))))))}[method]
    return df.groupBy("slope", "intercept").agg(how.alias("score"))


def grid_table(scores: DataFrame) -> DataFrame:
    return scores.groupBy("slope").pivot("intercept").agg(F.first("score")).orderBy("slope")


def window_pairs(pairs: DataFrame, windows: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs (id, i, j, win) that are in more than a share of the windows (id, win, start, end) that hold both ends."""
    seen = pairs.groupBy("id", "i", "j").agg(F.count_distinct("win").alias("n"))
    over = seen.join(windows.select("id", "start", "end"), "id").where((F.col("start") <= F.col("i")) & (F.col("end") >= F.col("j"))).groupBy("id", "i", "j", "n").agg(F.count(F.lit(1)).alias("windows"))
    return over.where(F.col("n") > F.col("windows") * share).select("id", "i", "j", "n", "windows")


def mean_probabilities(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean probability of pairs (id, i, j, win, p) over the windows that hold both ends (0 where a window hasn't the pair)."""
    sums = pairs.groupBy("id", "i", "j").agg(F.sum("p").alias("s"))
    over = sums.join(windows.select("id", "start", "end"), "id").where((F.col("start") <= F.col("i")) & (F.col("end") >= F.col("j")))
    return over.groupBy("id", "i", "j", "s").agg((F.col("s") / F.count(F.lit(1))).alias("p")).drop("s")


def fold_windows(lengths: DataFrame, size: int, step: int, ends: tuple[int, ...] = (50, 100)) -> DataFrame:
    """(id, start, end) of folding windows, with shorter steps at both ends of a sequence longer than a window."""
    whole = F.col("length") <= size
    n = F.expr(f"sequence(0, greatest(0, length - {size}), {step})")
    more = [F.lit(e) for e in ends] + [F.col("length") - size - e for e in ends] + [F.col("length") - size]
    starts = F.when(whole, F.array(F.lit(0))).otherwise(F.array_distinct(F.filter(F.concat(n, F.array(*(m.cast("int") for m in more))), lambda s: (s >= 0) & (s <= F.col("length") - size))))
    return lengths.select("id", "length", F.explode(starts).alias("start")).select("id", "start", F.least(F.col("start") + size - 1, F.col("length") - 1).alias("end"))


def pair_probability(probabilities: DataFrame, lookups: DataFrame, tasks: int | None = None) -> DataFrame:
    """id, i, j and p (0 if absent) of every pair asked for, in either order of its bases. probabilities: id, i, j, p with i < j.

    tasks: how many the join has (the session's number if none is given); that isn't lowered for small files, as pairs that are alike take few bytes there and many in memory."""
    n = tasks or int(lookups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["id", "__a", "__b"]
    asked = lookups.select("id", "i", "j").withColumns({"__a": F.least("i", "j"), "__b": F.greatest("i", "j")})
    known = probabilities.select("id", F.col("i").alias("__a"), F.col("j").alias("__b"), "p")
    joined = asked.repartition(n, *keys).join(known.repartition(n, *keys), keys, "left")
    return joined.select("id", "i", "j", F.coalesce("p", F.lit(0.0)).alias("p"))


def partners(probabilities: DataFrame) -> DataFrame:
    """id, base, partner and p of every pair, from both ends."""
    return probabilities.select("id", F.explode(F.array(F.struct(F.col("i").alias("base"), F.col("j").alias("partner")), F.struct(F.col("j").alias("base"), F.col("i").alias("partner")))).alias("x"), "p").select("id", "x.base", "x.partner", "p")
