"""K-means with any distance and centroid, and clusters of chimeras."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

FAR = 1e308


def euclidean(a: Sequence[float], b: Sequence[float]) -> float:
    return float(np.linalg.norm(np.asarray(a, float) - np.asarray(b, float)))


def mean_point(points: list[Sequence[float]]) -> list[float]:
    return np.mean(np.asarray(points, float), axis=0).tolist()


def kmeans(points: list, k: int, distance: Callable = euclidean, centroid: Callable = mean_point, seed: int = 0, rounds: int = 100) -> tuple[list[int], list]:
    """Labels and centroids: seeds by k-means++, a point infinitely far (FAR) from all centroids starts a cluster of its own."""
    rng = random.Random(seed)
    centres = [points[rng.randrange(len(points))]]
    while len(centres) < min(k, len(points)):
        d = [min(distance(p, c) for c in centres) ** 2 if min(distance(p, c) for c in centres) < FAR else 1.0 for p in points]
        if not sum(d):
            break
        centres.append(rng.choices(points, d)[0])
    labels: list[int] = []
    for _ in range(rounds):
        new = []
        for p in points:
            d = [distance(p, c) for c in centres]
            best = min(range(len(d)), key=d.__getitem__)
            if d[best] >= FAR:
                centres.append(p)
                best = len(centres) - 1
            new.append(best)
        if new == labels:
            break
        labels = new
        groups = [[p for p, q in zip(points, labels, strict=True) if q == i] for i in range(len(centres))]
        centres = [centroid(g) if g else c for g, c in zip(groups, centres, strict=True)]
    return labels, centres


def silhouette(points: list, labels: list[int], distance: Callable = euclidean) -> float:
    groups: dict[int, list] = {}
    for p, q in zip(points, labels, strict=True):
        groups.setdefault(q, []).append(p)
    if len(groups) < 2:
        return 0.0
    total = 0.0
    for p, q in zip(points, labels, strict=True):
        if len(groups[q]) > 1:
            a = sum(distance(p, x) for x in groups[q]) / (len(groups[q]) - 1)
            b = min(sum(distance(p, x) for x in g) / len(g) for r, g in groups.items() if r != q)
            total += (b - a) / max(a, b) if max(a, b) else 0.0
    return total / len(points)


def best_k(points: list, most: int, **more) -> tuple[int, list[int]]:
    """The number of clusters (from 2) with the largest silhouette."""
    tried = [(k, kmeans(points, k, **more)[0]) for k in range(2, most + 1)]
    return max(tried, key=lambda x: (silhouette(points, x[1], more.get("distance", euclidean)), -x[0]))


Chimera = tuple[int, int, int, int]


def chimera_distance(a: Chimera, b: Chimera) -> float:
    """1 less the product of the overlaps (by the shorter half) of first and second halves; FAR if a half doesn't overlap."""
    out = 1.0
    for i in (0, 2):
        n = min(a[i + 1], b[i + 1]) - max(a[i], b[i]) + 1
        if n <= 0:
            return FAR
        out *= n / min(a[i + 1] - a[i] + 1, b[i + 1] - b[i] + 1)
    return 1 - out


def chimera_centroid(points: list[Chimera]) -> Chimera:
    """For each half: the middle of the most covered positions, half the median length to each side."""
    out: list[int] = []
    for i in (0, 2):
        starts, ends = np.array([p[i] for p in points]), np.array([p[i + 1] for p in points])
        low = starts.min()
        depth = np.zeros(ends.max() - low + 2, int)
        np.add.at(depth, starts - low, 1)
        np.add.at(depth, ends - low + 1, -1)
        depth = depth.cumsum()[:-1]
        middle, half = np.flatnonzero(depth == depth.max()).mean() + low, np.median(ends - starts + 1) / 2
        out += [max(0, int(np.floor(middle - half + 0.5))), int(np.floor(middle + half + 0.5)) - 1]
    return tuple(out)


def seeds(points: list[Chimera]) -> list[Chimera]:
    """Chimeras in order of their start that no earlier seed overlaps at both halves."""
    out: list[Chimera] = []
    for p in sorted(points):
        if all(chimera_distance(p, s) >= FAR for s in out):
            out.append(p)
    return out


def cluster_chimeras(points: list[Chimera], batch: int = 1000, rounds: int = 20, near: float = 0.5) -> list[int]:
    """Labels: batches seeded by non-overlapping chimeras are refined, and clusters whose centroids are near are merged."""
    if not points:
        return []
    order = sorted(range(len(points)), key=lambda i: points[i])
    centres: list[Chimera] = []
    for at in range(0, len(order), batch):
        part = [points[i] for i in order[at : at + batch]]
        centres += [s for s in seeds(part) if all(chimera_distance(s, c) >= FAR for c in centres)]
    labels: list[int] = []
    for _ in range(rounds):
        new = []
        for p in points:
            d = [chimera_distance(p, c) for c in centres]
            best = min(range(len(d)), key=d.__getitem__)
            if d[best] >= FAR:
                centres.append(p)
                best = len(centres) - 1
            new.append(best)
        groups = [[p for p, q in zip(points, new, strict=True) if q == i] for i in range(len(centres))]
        centres = [chimera_centroid(g) if g else c for g, c in zip(groups, centres, strict=True)]
        if new == labels:
            break
        labels = new
    up = list(range(len(centres)))
    for i in range(len(centres)):
        for j in range(i):
            if up[j] == j and chimera_distance(centres[i], centres[j]) < near:
                up[i] = j
                break
    return [up[q] for q in labels]


def islands(df: DataFrame, start: str, end: str, by: list[str], name: str) -> DataFrame:
    """df with the number of the island (a run of intervals that overlap one after the other) of each row, in each group of by."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(*by).orderBy(start, end)
    begins = F.coalesce(F.col(start) > F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return df.withColumn(name, begins.cast("bigint")).withColumn(name, F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def tasks(df: DataFrame) -> int:
    """How many tasks a shuffle of df for Python code has: a given number isn't lowered for small files, where the work isn't in the bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def begins(t: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows, but for the first, whose keys aren't those of the row before."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        a, b = t[k].slice(0, len(new)), t[k].slice(1)
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the bounds of each, from batches in the order of their keys; one group at least and little more than a batch, so that small groups cost no call each."""

    def given() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t, np.concatenate([[0], begins(t, keys), [t.num_rows]])

    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        new, ends = begins(b, keys), [tuple(b[k][i].as_py() for k in keys) for i in (0, b.num_rows - 1)]
        if held and ends[0] != last:
            yield given()
            held = []
        if len(new):
            held.append(b.slice(0, new[-1]))
            yield given()
            held = []
        held.append(b.slice(new[-1] if len(new) else 0))
        last = ends[1]
    if held:
        yield given()


def clustered(chimeras: DataFrame, batch: int = 1000) -> DataFrame:
    """Chimeras (id, start1, end1, start2, end2) with their island and their cluster's number in it.

    Chimeras of one cluster overlap at both halves, so they lie in one island of first halves, and inside it in one of
    second halves: islands are clustered apart from each other without losing a cluster. Islands pass in their order, many
    to a batch, and those of one transcript are dealt to many tasks."""
    from pyspark.sql import functions as F

    names, keys = ["id", "start1", "end1", "start2", "end2"], ["id", "first", "second"]
    n = tasks(chimeras)
    dealt = chimeras.select(*names).repartition(n, "id")
    keyed = islands(islands(dealt, "start1", "end1", ["id"], "first"), "start2", "end2", ["id", "first"], "second")
    ordered = keyed.select(*names, "first", "second").repartition(n, *keys).sortWithinPartitions(*keys, *names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, keys):
            labels = np.zeros(t.num_rows, np.int64)  # a chimera alone in its island is cluster 0
            for g in np.flatnonzero(np.diff(bounds) > 1):
                low, high = bounds[g], bounds[g + 1]
                labels[low:high] = cluster_chimeras(list(zip(*(t[c].slice(low, high - low).to_pylist() for c in names[1:]), strict=True)), batch)
            yield from t.append_column("cluster", pa.array(labels)).to_batches()

    kinds = ", ".join(f"{c} {ordered.schema[c].dataType.simpleString()}" for c in ordered.columns)
    return ordered.mapInArrow(run, f"{kinds}, cluster bigint").select(*names, F.struct("first", "second").alias("island"), "cluster")
