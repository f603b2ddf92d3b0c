"""Quality by importance resampling.

Words and pairs of words are hashed into BUCKETS. Two multinomial models are counted, one over target texts and one
over all texts; a text's weight is the logarithm of the ratio of its likelihoods under the two. Gumbel noise (fixed by
seed and row) is added, and the k largest sums are a sample of k texts without replacement by their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_WORDS, cut, gram_hashes, map_batches, pieces, scratch, settle, slices, small_batches, table, utf8_view, word_hashes

BUCKETS, SMOOTH, FRACTION, SEED = 10_000, 1.0, 0.5, 17
#: Labelled rows that the target model is fitted on, at most (a pseudorandom sample of them).
MAX_TARGET = 1_000_000


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of words."""
    words, row, _, _ = word_hashes(data, offsets, BLANK_WORDS)
    pairs = gram_hashes(words, 2)
    inside = row[: len(pairs)] == row[1 : len(pairs) + 1]
    return np.concatenate((row, row[: len(pairs)][inside])), (np.concatenate((words, pairs[inside])) % np.uint64(BUCKETS)).astype(np.int64)


def models(docs: DataFrame, target: str, text: str = "text") -> np.ndarray:
    """log(target model / model of all texts) by bucket; target names a boolean column."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in (x for y in batches for x in slices(y)):
            chosen = np.array([bool(x) for x in batch.column(1).to_pylist()])
            data, offsets = utf8_view(batch.column(0))
            for a, b in pieces(offsets):
                row, bucket = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[chosen[a:b][row]], minlength=BUCKETS)
        which, at = np.nonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(at), pa.array(total[which, at])], names=["model", "bucket", "n"])

    got = docs.select(text, target).mapInArrow(run, "model bigint, bucket bigint, n bigint").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((2, BUCKETS), SMOOTH)
    counts[got["model"].to_numpy(), got["bucket"].to_numpy()] += got["n"].to_numpy()
    logs = np.log(counts / counts.sum(1, keepdims=True))
    return logs[1] - logs[0]


def weigh(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """key, log_weight and noisy (log_weight plus Gumbel noise) of every row; texts without words weigh 0."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_view(batch.column(1))
        out = np.zeros(batch.num_rows)
        for a, b in pieces(offsets):
            row, bucket = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out[a:b] = np.bincount(row, held.value[bucket], minlength=b - a)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], names=[key, "__h", "log_weight"])

    hashed = docs.select(key, text, F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(seed)).alias("__h"))
    got = map_batches(hashed, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, __h bigint, log_weight double")
    uniform = (F.shiftrightunsigned("__h", 11).cast("double") + 0.5) / float(1 << 53)
    return got.withColumn("noisy", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(df: DataFrame, column: str, k: int, ties: str, bins: int = 4096, few: int = 10_000) -> tuple[float, int] | None:
    """The k-th row's (column, ties) in descending order of both, by narrowing histograms; None if k is below 1 or there are fewer rows."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not 1 <= k <= n:
        return None
    inside, left = df.select(column, ties), k
    while n > few and high > low:
        width = (high - low) / bins
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        # Rounding must not move a row between bins from one pass to the next: bounds come from the rows themselves.
        for r in sorted(inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: -r["bin"]):
            if left <= r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            left -= r["n"]
        inside = inside.where((F.col(column) >= low) & (F.col(column) <= high))
    if high > low:
        return tuple(inside.orderBy(F.desc(column), F.desc(ties)).limit(left).collect()[-1])
    low, high = inside.agg(F.min(ties), F.max(ties)).first()
    while n > few and high > low:  # very many equal weights: the same by the ties
        half = low + (high - low) // 2
        upper = inside.where(F.col(ties) > half).count()
        if left <= upper:
            low, n = half + 1, upper
        else:
            high, n, left = half, n - upper, left - upper
        inside = inside.where(F.col(ties).between(low, high))
    return tuple(inside.orderBy(F.desc(ties)).limit(left).collect()[-1])


def resample(docs: DataFrame, target: str, fraction: float = FRACTION, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """key, log_weight, noisy and selected of every row; as many rows as fraction of all are selected.

    target names a boolean column (null: not a target). Null and empty texts weigh 0. Equal noisy weights (repeated
    rows) are told apart by nothing: all rows equal to the last one selected are selected too."""
    with scratch(docs.sparkSession) as keep:
        got = keep(weigh(docs, models(docs, target, text), key, text, seed))
    k = round(got.count() * fraction)
    last = kth_largest(got, "noisy", k, "__h")
    chosen: Column = F.lit(False) if last is None else (F.col("noisy") > last[0]) | ((F.col("noisy") == last[0]) & (F.col("__h") >= last[1]))
    return got.withColumn("selected", chosen).drop("__h")


def bounded(labels: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or a pseudorandom sample by key of about most rows if there are more."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    target = F.broadcast(bounded(good, "doc_id", MAX_TARGET).withColumn("target", F.lit(True)))
    return resample(docs.join(target, "doc_id", "left"), "target")
