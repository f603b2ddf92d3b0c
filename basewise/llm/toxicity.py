"""Toxicity by cumulative-link (proportional odds) ordinal regression on sparse word features.

One weight vector is shared by all thresholds: P(grade >= j) = sigmoid(w.x - t_j), t_1 <= t_2 <= .... Features are the
presence of words that tell toxic from other training texts. The severity grades come from the labels alone: 0 for a
text that is not toxic, 1 for a toxic one of good quality, 2 for a toxic one of bad quality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, cut, map_batches, pieces, scratch, share, table, utf8_view, word_hashes
from .importance import bounded

GRADES = 2
#: Labelled rows that the model is fitted on, at most (a pseudorandom sample of them).
MAX_ROWS = 20_000
#: Training texts that a word must stand in, how telling it must be (log odds ratio, and its z, high enough for one test
#: of each of very many words), and the fit's own parameters.
MIN_TEXTS, ODDS, TELLING, STEPS, RATE, RIDGE = 4, 2.0, 4.0, 300, 0.3, 1e-5


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, row, _, _ = word_hashes(data, offsets, ALNUM_WORDS)
    return words, row


def word_sets(docs: DataFrame, keep: str, text: str) -> DataFrame:
    """keep and the distinct word hashes of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_view(batch.column(1))
        out: list[np.ndarray] = []
        for a, b in pieces(offsets):
            words, row = _distinct(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            edges = np.searchsorted(row, np.arange(b - a + 1))
            out += [np.unique(words[edges[i] : edges[i + 1]]).astype(np.int64) for i in range(b - a)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=[keep, "words"])

    return map_batches(docs.select(keep, text), run, f"`{keep}` {docs.schema[keep].dataType.simpleString()}, words array<bigint>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", quality: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (hashes, in order), their weights, and the thresholds.

    Rows without label or text are passed over; of several labels of a text the severest counts, and equal texts count
    once. Where labels has no column quality, or null in it, a toxic text has grade 1."""
    with scratch(docs.sparkSession):
        return _fit(docs, labels, key, text, toxic, quality, max_rows)


def _fit(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, quality: str, max_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bad = F.coalesce((F.col(quality) == 0).cast("int"), F.lit(0)) if quality in labels.columns else F.lit(0)
    told = labels.where(F.col(toxic).isNotNull()).groupBy(key).agg(F.max(F.when(F.col(toxic).cast("int") == 1, 1 + bad).otherwise(0)).alias("grade"))
    chosen = F.broadcast(bounded(told, key, max_rows))
    rows = docs.where(F.col(text).isNotNull()).select(key, text).join(chosen, key).select(F.struct("grade", F.xxhash64(text).alias("h")).alias("k"), text)
    sets = cut(word_sets(rows, "k", text).groupBy("k.h").agg(F.max("k.grade").alias("grade"), F.first("words").alias("words")))
    sizes = {r["bad"]: r["n"] for r in sets.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, np.inf if not n1 else -np.inf)
    seen = sets.select((F.col("grade") > 0).cast("int").alias("bad"), F.explode("words").alias("word")).groupBy("word").agg(F.sum("bad").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TEXTS)
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    rest1, rest0 = n1 - F.col("a") + 0.5, n0 - F.col("n") + F.col("a") + 0.5
    odds = F.log(a / rest1) - F.log(b / rest0)
    z = odds / F.sqrt(1 / a + 1 / b + 1 / rest1 + 1 / rest0)
    known = seen.where((F.abs(odds) >= ODDS) & (F.abs(z) >= TELLING)).select("word").toArrow()["word"].to_numpy().astype(np.uint64)
    known = np.sort(known)
    held = share(docs.sparkSession, known)

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of every text the places of the telling words that it holds."""
        lists = batch.column(1)
        word, edges = lists.flatten().to_numpy().astype(np.uint64), np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
        at = np.minimum(np.searchsorted(held.value, word), max(len(held.value) - 1, 0))
        hit = held.value[at] == word if len(held.value) else np.zeros(len(word), bool)
        before = np.concatenate(([0], np.cumsum(hit)))[edges]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(at[hit], pa.int64()))], names=["grade", "places"])

    # At most max_rows texts, each with the telling words that it holds.
    got = map_batches(sets.select("grade", "words"), places, "grade int, places array<bigint>").toArrow()
    grade = got["grade"].to_numpy().astype(np.int64)
    lists = got["places"].combine_chunks()
    row = np.repeat(np.arange(len(grade)), np.diff(lists.offsets.to_numpy()))
    return known, *_descend(row, lists.flatten().to_numpy(), grade, len(known))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def likelihood(x: np.ndarray, row: np.ndarray, column: np.ndarray, grade: np.ndarray, words: int) -> tuple[float, np.ndarray]:
    """Mean penalised log likelihood of the grades, and its gradient.

    x: the words' weights, the first threshold, and for each further one the logarithm of exp(gap) - 1; row and column:
    which text holds which word."""
    n, w, t = len(grade), x[:words], _thresholds(x[words:])
    score = np.bincount(row, w[column], minlength=n)
    # P(grade >= j) for j = 0 .. GRADES + 1, and the likelihood of each row's own grade.
    above = np.column_stack((np.ones(n), _sigmoid(score[:, None] - t), np.zeros(n)))
    here, next_ = above[np.arange(n), grade], above[np.arange(n), grade + 1]
    p = np.maximum(here - next_, 1e-12)
    up, down = here * (1 - here) / p, next_ * (1 - next_) / p
    g_t = np.bincount(np.concatenate((grade, grade + 1)), np.concatenate((-up, down)), minlength=GRADES + 2)[1 : GRADES + 1] / n
    g_w = np.bincount(column, (up - down)[row], minlength=words) / n - RIDGE * w
    chain = np.concatenate(([g_t.sum()], [g_t[j:].sum() * _sigmoid(x[words + j : words + j + 1])[0] for j in range(1, GRADES)]))
    return float(np.log(p).mean() - RIDGE / 2 * (w * w).sum()), np.concatenate((g_w, chain))


def _descend(row: np.ndarray, column: np.ndarray, grade: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the penalised likelihood."""
    n = len(grade)
    at_least = np.array([max((grade >= j).mean(), 1 / (2 * n)) for j in range(1, GRADES + 1)])
    first = -np.log(at_least / (1 - np.minimum(at_least, 1 - 1 / (2 * n))))
    gaps = np.maximum(np.diff(first), 0.05)
    x = np.concatenate((np.zeros(words), first[:1], np.log(np.expm1(gaps))))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        g = likelihood(x, row, column, grade, words)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:words], _thresholds(x[words:])


def _thresholds(x: np.ndarray) -> np.ndarray:
    return x[0] + np.concatenate(([0.0], np.cumsum(np.logaddexp(0, x[1:]))))


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, severity (the expected grade), grade (the likeliest), p_toxic (P(grade >= 1)) and toxic (p_toxic >= 0.5) of every row.

    Null and empty texts have no words. Repeated rows give repeated rows; an empty table gives no rows; other columns
    are not read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, weights, thresholds = held.value
        data, offsets = utf8_view(batch.column(1))
        score = np.zeros(batch.num_rows)
        for a, b in pieces(offsets) if len(known) else ():
            words, row = _distinct(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            hit = known[at] == words
            pair = np.unique(row[hit] * len(known) + at[hit])
            score[a:b] = np.bincount(pair // len(known), weights[pair % len(known)], minlength=b - a)
        above = _sigmoid(score[:, None] - thresholds)
        steps = np.column_stack((np.ones(len(score)), above)) - np.column_stack((above, np.zeros(len(score))))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(steps.argmax(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], names=[key, "severity", "grade", "p_toxic", "toxic"])

    return map_batches(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, severity double, grade bigint, p_toxic double, toxic boolean")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels")))
