"""Languages of texts as mixtures.

Training counts hashed byte trigrams by language over all labelled rows. A text is cut into segments of SEGMENT
trigrams; expectation-maximisation over the segments' likelihoods estimates the share of each language. The language
set grows from the likeliest language, in order of share, as long as the likelihood rises by more than PENALTY times
the logarithm of the number of segments for each further language. EM runs until no text's log likelihood rises by
TOLERANCE.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, release, settle, slices, small_batches, table, utf8_view

BUCKETS, SEGMENT, TOLERANCE, PENALTY, SMOOTH = 1 << 16, 32, 0.01, 3.0, 0.5
#: Trigrams of a segment overlap; its likelihood counts as if a third of them did.
TEMPER = 1 / 3
#: Word characters that aren't decimal digits: letters, but other numbers too.
WORDLIKE = re.compile(r"[^\W\d_]")

#: Letters keep (A-Z as a-z), all bytes from 0x80 on too; the rest are spaces.
CODE = np.full(256, 32, np.uint32)
CODE[97:123] = CODE[65:91] = np.arange(97, 123)
CODE[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each text (BUCKETS for those that hold two spaces in a row), and the n + 1 places where texts begin.

    Each text has a space before and behind it."""
    n = len(offsets) - 1
    places = offsets + 2 * np.arange(n + 1)
    codes = np.full(int(places[-1]) + 2, 32, np.uint32)
    codes[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))] = CODE[data]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    out = ((a << 16 | b << 8 | c) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int32)
    out[(b == 32) & ((a == 32) | (c == 32))] = BUCKETS
    return out, places


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order, and for each a row of BUCKETS + 1 log probabilities; rows without lang are passed over."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        totals: dict[str, np.ndarray] = {}
        for batch in (x for y in batches for x in slices(y)):
            names = batch.column(1).to_pylist()
            data, offsets = utf8_view(batch.column(0))
            for a, b in pieces(offsets):
                grams, places = trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                which = sorted({n for n in names[a:b]})
                row = np.repeat([which.index(n) for n in names[a:b]], np.diff(places))
                counts = np.bincount(row * (BUCKETS + 1) + grams[: len(row)], minlength=len(which) * (BUCKETS + 1)).reshape(len(which), -1)
                for n, c in zip(which, counts, strict=True):
                    totals[n] = totals.get(n, 0) + c
        release()
        for n, c in totals.items():
            at = np.flatnonzero(c[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    got = docs.where(F.col(lang).isNotNull()).select(text, F.col(lang).alias("lang")).mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = got.toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    model = np.full((len(names), BUCKETS + 1), SMOOTH)
    if names:
        index = {n: i for i, n in enumerate(names)}
        codes = counts["lang"].combine_chunks().dictionary_encode()
        row = np.array([index[n] for n in codes.dictionary.to_pylist()])[codes.indices.to_numpy()]
        model[row, counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    model = np.log(model / model[:, :BUCKETS].sum(1, keepdims=True))
    model[:, BUCKETS] = 0
    return names, model.astype(np.float32)


def _mix(likelihood: np.ndarray, row: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over segments: shares of the languages that share allows (not 0), and the texts' log likelihoods."""
    top = likelihood.max(1)
    scaled = np.exp(likelihood - top[:, None])
    out, value = share.copy(), np.full(len(sizes), -np.inf)
    live = np.arange(len(sizes))  # texts that still move
    while True:
        part = scaled * share[row]
        total = np.maximum(part.sum(1), 1e-300)
        now = np.add.reduceat(np.log(total) + top, starts)
        moves = now > value[live] + TOLERANCE
        out[live], value[live] = share, now
        if not moves.any():
            return out, value
        part /= total[:, None]
        share = np.add.reduceat(part, starts, axis=0) / sizes[:, None]
        share /= np.maximum(share.sum(1), 1e-300)[:, None]
        if not moves.all():
            held = moves[row]
            scaled, top, live, share, sizes = scaled[held], top[held], live[moves], share[moves], sizes[moves]
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            row = np.repeat(np.arange(len(sizes)), sizes)


def mixtures(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The share of each language in each text (rows sum to 1)."""
    grams, places = trigrams(data, offsets)
    lengths = np.diff(places)
    lengths[-1] = max(1, len(grams) - places[-2])
    sizes = -(-lengths // SEGMENT)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    row = np.repeat(np.arange(len(sizes)), sizes)
    cuts = places[:-1][row] + SEGMENT * (np.arange(len(row)) - starts[row])
    likelihood = np.stack([np.add.reduceat(logs[grams], cuts) for logs in model], axis=1).astype(np.float64) * TEMPER
    languages = model.shape[0]
    share, _ = _mix(likelihood, row, starts, sizes, np.full((len(sizes), languages), 1.0 / languages))
    order = np.argsort(-share, axis=1, kind="stable")
    # One language, the likeliest of all; then more, in order of their share.
    single = np.add.reduceat(likelihood, starts, axis=0)
    best = single.argmax(1)
    at = np.arange(len(sizes))
    out = np.zeros_like(share)
    out[at, best] = 1
    value = single[at, best]
    open_ = at
    for k in range(2, languages + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(open_), languages))
        np.put_along_axis(allowed, order[open_, :k], 1.0 / k, axis=1)
        keep = np.isin(row, open_)
        inner = sizes[open_]
        some, sum_ = _mix(likelihood[keep], np.repeat(np.arange(len(open_)), inner), np.concatenate(([0], np.cumsum(inner)))[:-1], inner, allowed)
        better = sum_ - value[open_] > penalty * np.log(inner + 1)
        won = open_[better]
        out[won], value[won] = some[better], sum_[better]
        open_ = won
    return out


def identify(docs: DataFrame, names: list[str], model: np.ndarray, text: str = "text", pred: str = "lang_pred", score: str = "score", mixture: str = "mixture") -> DataFrame:
    """docs with pred (the language with the largest share, ``und`` for texts that are null or hold no letter), score (its share, 0 for ``und``) and mixture (name:share of the chosen set).

    With nothing learned every text is ``und``; repeated rows give repeated rows; an empty table gives no rows; columns
    of docs that have one of the three names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(text).alias("__text"), *(c for c in docs.columns if c.lower() not in {pred.lower(), score.lower(), mixture.lower()}))
    columns = docs.columns[1:]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(0)
        known = [bool(names) and t is not None and has_letter(t) for t in column.to_pylist()]
        data, offsets = utf8_view(column)
        shares = np.concatenate([mixtures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], held.value) for a, b in pieces(offsets)]) if names else np.zeros((len(known), 1))
        best = shares.argmax(1)
        told = [",".join(f"{names[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] > 0) if k else "" for k, s in zip(known, shares, strict=True)]
        new = [pa.array([names[b] if k else "und" for k, b in zip(known, best, strict=True)], pa.string()), pa.array([float(min(1.0, s[b])) if k else 0.0 for k, s, b in zip(known, shares, best, strict=True)]), pa.array(told, pa.string())]
        return pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(columns))), *new], names=[*columns, pred, score, mixture])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields[1:])
    return map_batches(docs, run, f"{kinds}`{pred}` string, `{score}` double, `{mixture}` string")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), names, model).select("doc_id", "held_out", "lang_pred", "score", "mixture")
