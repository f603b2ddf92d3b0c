"""Conformations of deconvolved windows: merging, matching across replicates, assignment."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 3 or a.std() == 0 or b.std() == 0:
        return 0.0
    return float(np.corrcoef(a, b)[0, 1])


def assign(scores: np.ndarray) -> tuple[list[int], float]:
    """The one-to-one assignment of rows to columns with the largest sum: Hungarian method, O(n^3). Equal sums: the same choice each time."""
    n = len(scores)
    cost = np.vstack((np.zeros((1, n + 1)), np.hstack((np.zeros((n, 1)), -scores))))
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used
            free[0] = False
            now = cost[i0] - u[i0] - v
            better = free & (now < least)
            least[better], way[better] = now[better], j0
            j1 = int(np.flatnonzero(free)[least[free].argmin()])
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out, float(sum(scores[i, out[i]] for i in range(n)))


def assign_whole(scores: np.ndarray) -> tuple[list[int], float]:
    """The same by trying all assignments; for tests."""
    best = max(permutations(range(len(scores))), key=lambda p: sum(scores[i, j] for i, j in enumerate(p)))
    return list(best), float(sum(scores[i, j] for i, j in enumerate(best)))


def _rates(w: dict) -> np.ndarray:
    c, v = np.array(w["counts"], float), np.array(w["coverage"], float)
    return np.divide(c, v, out=np.zeros_like(c), where=v > 0)


def similarity(a: dict, b: dict) -> np.ndarray:
    """Correlations of each two conformations over the positions that both windows have."""
    low, high = max(a["start"], b["start"]), min(a["end"], b["end"])
    x, y = _rates(a)[:, low - a["start"] : high - a["start"] + 1], _rates(b)[:, low - b["start"] : high - b["start"] + 1]
    return np.array([[correlation(p, q) for q in y] for p in x])


def overlap(a: dict, b: dict) -> tuple[float, float]:
    n = max(0, min(a["end"], b["end"]) - max(a["start"], b["start"]) + 1)
    return n / (a["end"] - a["start"] + 1), n / (b["end"] - b["start"] + 1)


def joined(a: dict, b: dict, order: list[int]) -> dict:
    """b's conformations added to a's, as ordered, over the span of both."""
    start, end = min(a["start"], b["start"]), max(a["end"], b["end"])
    out = {"start": start, "end": end}
    for c in ("counts", "coverage"):
        whole = np.zeros((len(a[c]), end - start + 1), np.int64)
        whole[:, a["start"] - start : a["end"] - start + 1] += np.array(a[c], np.int64)
        whole[:, b["start"] - start : b["end"] - start + 1] += np.array(b[c], np.int64)[order]
        out[c] = whole.tolist()
    out["parts"] = [[*x, b["stoichiometries"][j]] for x, j in zip(a["parts"], order, strict=True)]
    out["stoichiometries"] = [float(np.mean(x)) for x in out["parts"]]
    return out


def merge(windows: list[dict], least_overlap: float = 0.75, least_correlation: float = 0.7) -> list[dict]:
    """Windows in order of their start; each joins the last one if they have as many conformations, overlap enough (with several conformations) and agree."""
    out: list[dict] = []
    for w in sorted(windows, key=lambda w: (w["start"], w["end"])):
        w = w | {"parts": [[s] for s in w["stoichiometries"]]}
        if out and len(out[-1]["counts"]) == len(w["counts"]) and out[-1]["end"] >= w["start"]:
            last = out[-1]
            if len(w["counts"]) == 1:
                out[-1] = joined(last, w, [0])
                continue
            if max(overlap(last, w)) >= least_overlap:
                scores = similarity(last, w)
                order, total = assign(scores)
                if total / len(order) >= least_correlation:
                    out[-1] = joined(last, w, order)
                    continue
        out.append(w)
    return [{k: v for k, v in w.items() if k != "parts"} for w in out]


def match(replicates: list[list[dict]], least_overlap: float = 0.75) -> list[list[dict]]:
    """Windows of the first replicate with one window of each other: as many conformations, the larger overlap share of the two at least least_overlap, the best mean share first, each window used once."""
    out, used = [], [set() for _ in replicates]
    for w in sorted(replicates[0], key=lambda w: (w["start"], w["end"])):
        row, chosen = [w], []
        for r, others in enumerate(replicates[1:], 1):
            good = [(-sum(o) / 2, x["start"], x["end"], k) for k, x in enumerate(others) if k not in used[r] and len(x["counts"]) == len(w["counts"]) and max(o := overlap(w, x)) >= least_overlap]
            if not good:
                break
            k = min(good)[3]
            chosen.append((r, k))
            row.append(others[k])
        else:
            for r, k in chosen:
                used[r].add(k)
            out.append(row)
    return out


COLUMNS = "file string, id string, start bigint, end bigint, stoichiometries array<double>, counts array<array<bigint>>, coverage array<array<bigint>>"


def merged_windows(df: DataFrame, least_overlap: float = 0.75, least_correlation: float = 0.7) -> DataFrame:
    """merge() of the windows of each file and transcript."""
    names = ["file", "id", "start", "end", "stoichiometries", "counts", "coverage"]

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        got = merge(rows, least_overlap, least_correlation)
        return pa.Table.from_pylist([{"file": rows[0]["file"], "id": rows[0]["id"], **w} for w in got], schema=t.select(names).schema)

    return df.select(names).groupBy("file", "id").applyInArrow(run, COLUMNS)


def trimmed(df: DataFrame, n: int) -> DataFrame:
    """Windows without their first and last n positions."""
    # Lengths stand in a column of their own: within a lambda, names of one select may mean its new columns.
    df = df.withColumn("__n", (F.col("end") - F.col("start") + 1 - 2 * n).cast("int")).where("__n > 0")

    def cut(c: str):
        return F.transform(c, lambda x: F.slice(x, F.lit(n + 1), F.greatest(F.col("__n"), F.lit(0))))

    return df.withColumns({"counts": cut("counts"), "coverage": cut("coverage"), "start": F.col("start") + n, "end": F.col("end") - n}).drop("__n")


def extended(df: DataFrame, n: int) -> DataFrame:
    """Windows widened by n positions of zeros to each side, as far as position 0 on the left."""
    df = df.withColumn("__left", F.least(F.lit(n).cast("bigint"), F.col("start")).cast("int"))

    def pad(c: str):
        return F.transform(c, lambda x: F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.col("__left")), x, F.array_repeat(F.lit(0).cast("bigint"), n)))

    return df.withColumns({"counts": pad("counts"), "coverage": pad("coverage"), "start": F.col("start") - F.col("__left"), "end": F.col("end") + n}).drop("__left")


def mean_stoichiometry(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.aggregate("stoichiometries", F.lit(0.0), lambda a, x: a + x) / F.size("stoichiometries"))


MATCHED = "id string, match bigint, replicate string, start bigint, end bigint, assigned array<int>, score double"


def matched_windows(df: DataFrame, replicate: str = "file", least_overlap: float = 0.75) -> DataFrame:
    """match() of each transcript's windows between replicates, in order of their names, with the conformations of each window assigned to those of the first replicate's (assigned, score: mean correlation).

    df as COLUMNS. Transcripts that a replicate lacks have no matches."""
    names = [replicate, "id", "start", "end", "counts", "coverage"]
    every = sorted(r[0] for r in df.select(replicate).distinct().collect())

    def run(t: pa.Table) -> pa.Table:
        groups = {r: [] for r in every}
        for w in t.to_pylist():
            groups[w[replicate]].append(w)
        out = []
        for k, row in enumerate(match(list(groups.values()), least_overlap) if all(groups.values()) else []):
            for r, w in zip(every, row, strict=True):
                order, total = assign(similarity(row[0], w))
                out.append({"id": str(w["id"]), "match": k, "replicate": r, "start": w["start"], "end": w["end"], "assigned": [int(x) for x in order], "score": float(total) / max(len(order), 1)})
        kinds = [("id", pa.string()), ("match", pa.int64()), ("replicate", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("assigned", pa.list_(pa.int32())), ("score", pa.float64())]
        return pa.Table.from_pylist(out, schema=pa.schema(kinds))

    return df.select(names).groupBy("id").applyInArrow(run, MATCHED)
