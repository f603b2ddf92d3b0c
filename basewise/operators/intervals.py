"""Joins and merges of closed intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(df: DataFrame, by: list[str], start: str = "start", end: str = "end", distance: int = 0, aggregates: list[Column] | None = None) -> DataFrame:
    """Intervals of one key that overlap, or are at most distance apart, as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("__new", F.coalesce((F.col(start) > reach + distance).cast("int"), F.lit(1)))
    islands = flagged.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"), *(aggregates or [])).drop("__island")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], size: int, a: tuple[str, str] = ("start", "end"), b: tuple[str, str] = ("start2", "end2")) -> DataFrame:
    """Pairs of intervals of one key that share a position: both sides are dealt into bins of size, joined by (key, bin), and each pair is taken in the first bin that it shares.

    size should be near the usual length of an interval."""

    def binned(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        return df.withColumn("__bin", F.explode(F.expr(f"sequence(cast(floor({names[0]} / {size}) as bigint), cast(floor({names[1]} / {size}) as bigint))")))

    joined = binned(left, a).join(binned(right, b), [*by, "__bin"])
    first = F.col("__bin") == F.floor(F.greatest(a[0], b[0]) / size)
    return joined.where(first & (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))).drop("__bin")


def points_in(points: DataFrame, ranges: DataFrame, by: list[str], pos: str, size: int, a: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Points with the closed ranges of their key that hold them."""
    binned = ranges.withColumn("__bin", F.explode(F.expr(f"sequence(cast(floor({a[0]} / {size}) as bigint), cast(floor({a[1]} / {size}) as bigint))")))
    return points.withColumn("__bin", F.floor(F.col(pos) / size)).join(binned, [*by, "__bin"]).where(F.col(pos).between(F.col(a[0]), F.col(a[1]))).drop("__bin")


def outside(points: DataFrame, ranges: DataFrame, by: list[str], pos: str, size: int) -> DataFrame:
    """Points that no closed range of their key holds."""
    binned = ranges.select(*by, "start", "end", F.explode(F.expr(f"sequence(cast(floor(start / {size}) as bigint), cast(floor(end / {size}) as bigint))")).alias("__bin")).alias("r")
    p = points.withColumn("__bin", F.floor(F.col(pos) / size)).alias("p")
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in [*by, "__bin"]]
    cond = F.col(f"p.{pos}").between(F.col("r.start"), F.col("r.end"))
    for c in same:
        cond = cond & c
    return p.join(binned, cond, "left_anti").drop("__bin")


def islands(df: DataFrame, by: list[str], pos: str, when: Column) -> DataFrame:
    """Runs of neighbouring positions at which a condition holds: start, end."""
    w = Window.partitionBy(*by).orderBy(pos)
    kept = df.where(when).withColumn("__g", F.col(pos) - F.row_number().over(w))
    return kept.groupBy(*by, "__g").agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("__g")


def extracted(counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Regions of a count frame as transcripts of their own: blocks has name, id, start, end and strand; its blocks are joined in order, - strands reversed and complemented."""
    from ..functions.sequence import complement

    inside = points_in(counts, blocks, ["id"], "pos", 1024)
    w = Window.partitionBy("name")
    up, down = F.row_number().over(w.orderBy("pos")) - 1, F.row_number().over(w.orderBy(F.desc("pos"))) - 1
    minus = F.col("strand") == "-"
    both = inside.withColumns({"__up": up, "__down": down})
    return both.select("name", F.when(minus, F.col("__down")).otherwise(F.col("__up")).alias("pos"), F.when(minus, complement(F.col("base"))).otherwise(F.col("base")).alias("base"), "count", "coverage")
