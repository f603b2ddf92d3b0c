"""The chimera workflow: bounded sampling, clusters, base-pair support, refined clusters and their probability."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import chimera_centroid, clustered, tasks, whole_groups
from .intervals import overlapping


def sampled(df: DataFrame, key: str, most: int, order: list[str], seed: int = 0) -> DataFrame:
    """At most so many rows, in order: those whose key has the smallest hash, so the same rows in any run and order."""
    chosen = df.withColumn("__h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).orderBy("__h").limit(most)
    return chosen.drop("__h").orderBy(*order)


def centroids(chimeras: DataFrame, by: list[str]) -> DataFrame:
    """by, start1, end1, start2, end2 and reads of every cluster: for each half the middle of its most covered positions, half its median length to each side."""
    import numpy as np
    import pyarrow as pa

    names = ["start1", "end1", "start2", "end2"]
    ordered = chimeras.select(*by, *names).repartition(tasks(chimeras), *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, by):
            reads, points = np.diff(bounds), np.array([t[x].to_numpy() for x in names], np.int64)
            out = points[:, bounds[:-1]]
            out[[0, 2]] = np.maximum(out[[0, 2]], 0)  # the centroid of one chimera
            for g in np.flatnonzero(reads > 1):
                out[:, g] = chimera_centroid(points[:, bounds[g] : bounds[g + 1]].T.tolist())
            heads = t.select(by).take(pa.array(bounds[:-1]))
            yield from pa.table([*heads.columns, *(pa.array(v) for v in out), pa.array(reads)], names=[*by, *names, "reads"]).to_batches()

    kinds = "".join(f"{c} {chimeras.schema[c].dataType.simpleString()}, " for c in by)
    return ordered.mapInArrow(run, f"{kinds}start1 bigint, end1 bigint, start2 bigint, end2 bigint, reads bigint")


def supported(pairs: DataFrame, clusters: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Base pairs (by, i, j, n) whose share of their cluster's reads is over least: by, i, j, n and support."""
    joined = pairs.join(clusters.select(*by, "reads"), by)
    return joined.withColumn("support", F.col("n") / F.col("reads")).where(F.col("support") > least).select(*by, "i", "j", "n", "support")


def refined(pairs: DataFrame, clusters: DataFrame, by: list[str]) -> DataFrame:
    """Clusters with the bounds of their supported pairs; clusters without any are left out."""
    bounds = pairs.groupBy(*by).agg(F.min("i").alias("start1"), F.max("i").alias("end1"), F.min("j").alias("start2"), F.max("j").alias("end2"))
    return clusters.select(*by, "reads").join(bounds, by).select(*by, "start1", "end1", "start2", "end2", "reads")


def probability(clusters: DataFrame, by: list[str], key: str = "cluster", size: int = 128) -> DataFrame:
    """Clusters with the share of their reads among those of the clusters that can't be there at the same time: those that overlap at one half and differ at the other, and themselves.

    Halves meet in bins of size positions, and a pair of clusters is taken at the first two of its halves that overlap."""
    names = ["start1", "end1", "start2", "end2", "reads", key]
    mine = clusters.select(*by, *names)
    other = mine.select(*by, *(F.col(c).alias("o_" + c) for c in names))

    def meet(a: str, b: str):
        return (F.col(f"start{a}") <= F.col(f"o_end{b}")) & (F.col(f"o_start{b}") <= F.col(f"end{a}"))

    def halves(df: DataFrame, mark: str) -> DataFrame:
        each = (F.struct(F.lit(i).alias("half"), F.col(f"{mark}start{i + 1}").alias("low"), F.col(f"{mark}end{i + 1}").alias("high")) for i in (0, 1))
        half = df.withColumn("__h", F.explode(F.array(*each)))
        return half.withColumns({f"__{mark}{c}": F.col(f"__h.{c}") for c in ("half", "low", "high")}).drop("__h")

    pairs = overlapping(halves(mine, ""), halves(other, "o_"), by, size, ("__low", "__high"), ("__o_low", "__o_high"))
    first = F.when(meet("1", "1"), 0).when(meet("1", "2"), 1).when(meet("2", "1"), 2).otherwise(3)
    rivals = pairs.where((first == F.col("__half") * 2 + F.col("__o_half")) & ~(meet("1", "1") & meet("2", "2")) & (F.col(key) != F.col("o_" + key)))
    lost = rivals.groupBy(*by, key).agg(F.sum("o_reads").alias("lost"))
    return clusters.join(lost, [*by, key], "left").withColumn("probability", F.col("reads") / (F.col("reads") + F.coalesce("lost", F.lit(0)))).drop("lost")


def workflow(chimeras: DataFrame, most: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Chimeras (id, start1, end1, start2, end2; read for sampling) with their clusters, and the clusters with centroid, reads and probability.

    The pairs inside the clusters come from folding, which is outside; supported() and refined() take them from there."""
    rows = sampled(chimeras, "read", most, ["id", "start1"], seed) if most else chimeras
    got = clustered(rows).withColumn("cluster", F.concat_ws(".", "island.first", "island.second", "cluster")).drop("island")
    return got, probability(centroids(got, ["id", "cluster"]), ["id"])


def tagged_lines(alignments: DataFrame, clusters: DataFrame, read: str = "read") -> DataFrame:
    """SAM lines (read, value) with the number of their read's cluster as the group tag XG:i; reads without one have no tag."""
    got = alignments.join(clusters.select(read, F.col("cluster").alias("__c")), read, "left")
    return got.select(F.when(F.col("__c").isNull(), F.col("value")).otherwise(F.concat("value", F.lit("\tXG:i:"), F.col("__c").cast("string"))).alias("value"))
