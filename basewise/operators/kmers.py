"""K-mers and motifs of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import IUPAC, dishuffled, hamming, windows
from ..functions.stats import combine, fisher_col


def counts(df: DataFrame, k: int, once: bool = False, key: str = "id", sequence: str = "sequence") -> DataFrame:
    """(kmer, n): occurrences over all sequences, or (once) sequences that hold it; k-mers with other letters than ACGT are left out."""
    if once or k > MOST:
        kmers = windows(F.col(sequence), k)
        rows = df.select(key, F.explode(F.array_distinct(kmers) if once else kmers).alias("kmer")).where(~F.col("kmer").rlike("[^ACGT]"))
        return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n in _word_counts(batches, k):
            letters = np.empty((len(codes), k), np.uint8)
            for i in range(k):
                letters[:, i] = ACGT[codes >> (2 * (k - 1 - i)) & 3]
            words = pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(codes), [None, pa.py_buffer(letters.tobytes())])
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()).cast(pa.string()), pa.array(n)], names=["kmer", "n"])

    return df.select(sequence).mapInArrow(run, "kmer string, n bigint").groupBy("kmer").agg(F.sum("n").alias("n"))


#: Letters by code, codes by letter (4: another), the longest word that a code holds, and letters that are coded at a time.
ACGT = np.frombuffer(b"ACGT", np.uint8)
CODES = np.full(256, 4, np.uint8)
CODES[ACGT] = range(4)
MOST, PIECE = 31, 1 << 20


def _word_counts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of words of k bases with their occurrences: once for all batches where a table of all words is small, else by piece."""
    table = np.zeros(4**k, np.int64) if k <= 8 else None
    for b in batches:
        held: list[bytes] = []
        texts = [t for t in b.column(0).cast(pa.binary()).to_pylist() if t]
        size = 0
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size < PIECE and i + 1 < len(texts):
                continue
            c = CODES[np.frombuffer(b"\n".join(held), np.uint8)]  # no word goes over the line's end
            held, size = [], 0
            m = len(c) - k + 1
            if m < 1:
                continue
            codes, good = np.zeros(m, np.int64), np.ones(m, bool)
            for j in range(k):
                codes = codes << 2 | c[j : j + m]
                good &= c[j : j + m] < 4
            codes = codes[good]
            if table is None:
                yield np.unique(codes, return_counts=True)
            else:
                table += np.bincount(codes, minlength=len(table))
    if table is not None:
        codes = np.flatnonzero(table)
        yield codes, table[codes]


def all_kmers(spark, k: int) -> DataFrame:
    """Every word of k bases; there are 4 ** k."""
    out = spark.createDataFrame([(b,) for b in "ACGT"], "kmer string")
    one = out.withColumnRenamed("kmer", "b")
    for _ in range(k - 1):
        out = out.crossJoin(F.broadcast(one)).select(F.concat("kmer", "b").alias("kmer"))
    return out


def enriched(positive: DataFrame, negative: DataFrame, k: int, p: float = 1e-3, once: bool = False) -> DataFrame:
    """K-mers that are more frequent in the positive sequences: n, m (negative), odds and Fisher's p below the limit."""
    a, b = counts(positive, k, once), counts(negative, k, once).withColumnRenamed("n", "m")
    joined = a.join(b, "kmer", "left").fillna(0, ["m"])
    totals = joined.agg(F.sum("n").alias("tn")).crossJoin(b.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("tm")))
    tested = joined.crossJoin(F.broadcast(totals)).where(F.col("n") * F.col("tm") > F.col("m") * F.col("tn"))
    scored = tested.withColumn("p", fisher_col("n", F.col("tn") - F.col("n"), "m", F.col("tm") - F.col("m")))
    return scored.where(F.col("p") < p).select("kmer", "n", "m", "p")


def neighbours(kmers: DataFrame, most: int = 1) -> DataFrame:
    """Pairs of words (a < b) that differ at most at so many places (1: found by an equi-join on the words with one place left out)."""
    if most != 1:
        a, b = kmers.select(F.col("kmer").alias("a")), kmers.select(F.col("kmer").alias("b"))
        return a.join(b, F.col("a") < F.col("b")).where(hamming(F.col("a"), F.col("b")) <= most)
    places = F.sequence(F.lit(1), F.length("kmer"))
    masked = kmers.select("kmer", F.explode(F.transform(places, lambda i: F.concat(F.substring("kmer", F.lit(1), i - 1), F.lit("."), F.substring("kmer", i + 1, F.length("kmer"))))).alias("m"))
    a, b = masked.withColumnRenamed("kmer", "a"), masked.withColumnRenamed("kmer", "b")
    return a.join(b, "m").where("a < b").select("a", "b").distinct()


def clusters(found: DataFrame) -> DataFrame:
    """Words of one component of neighbours under the word with the smallest p: seed, kmers, n, combined p."""
    from .graph import components

    linked = components(neighbours(found.select("kmer")), "a", "b")
    named = found.join(linked.withColumnsRenamed({"node": "kmer", "component": "c"}), "kmer", "left").withColumn("c", F.coalesce("c", "kmer"))
    heads = named.groupBy("c").agg(F.min_by("kmer", F.struct("p", "kmer")).alias("seed"), F.array_sort(F.collect_list("kmer")).alias("kmers"), F.sum("n").alias("n"))
    return heads.join(combine(named, ["c"], "p"), "c").drop("c")


def matrix(kmers: DataFrame) -> DataFrame:
    """(pos, base, weight): for each cell the largest count of a word that has the base there."""
    each = kmers.select("n", F.posexplode(F.split("kmer", "")).alias("pos", "base"))
    return each.groupBy("pos", "base").agg(F.max("n").alias("weight"))


def consensus(cells: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(pos, code): the ambiguity code of the bases whose weight reaches the tolerance times the place's largest."""
    from pyspark.sql.window import Window

    top = F.max("weight").over(Window.partitionBy("pos"))
    bases = cells.withColumn("t", top).where(F.col("weight") >= F.col("t") * tolerance).groupBy("pos").agg(F.array_join(F.array_sort(F.collect_set("base")), "").alias("bases"))
    codes = F.create_map(*(F.lit(v) for code, b in IUPAC.items() for v in (b, code)))
    return bases.select("pos", codes[F.col("bases")].alias("code"))


def negatives(sequences: DataFrame, n: int = 20, seed: int = 0, dinucleotides: bool = True) -> DataFrame:
    """n shuffles of each sequence."""
    copies = sequences.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    if dinucleotides:
        return copies.select(F.concat_ws("_", "id", "copy").alias("id"), dishuffled(F.concat(F.col("sequence")), seed).alias("sequence"))
    return copies.select(F.concat_ws("_", "id", "copy").alias("id"), F.array_join(F.transform(F.array_sort(F.transform(F.split("sequence", ""), lambda c, i: F.struct(F.xxhash64("id", "copy", i, F.lit(seed)).alias("k"), c.alias("c")))), lambda x: x["c"]), "").alias("sequence"))


def around(centres: DataFrame, sequences: DataFrame, flank: int) -> DataFrame:
    """The sequence around each centre, as far as the transcript goes."""
    low = F.greatest(F.lit(0), F.col("centre") - flank)
    return centres.join(sequences, "id").select("id", "centre", F.substring("sequence", (low + 1).cast("int"), (F.col("centre") + flank - low + 1).cast("int")).alias("sequence"))


def discover(positive: DataFrame, negative: DataFrame, k: int = 4, motifs: int = 3, p: float = 1e-3) -> list[dict]:
    """Motifs one after the other: the cluster with the smallest p, whose words are then masked in the positive sequences.

    A loop of at most motifs rounds; each round's result is a few words."""
    out = []
    for _ in range(motifs):
        found = enriched(positive, negative, k, p)
        best = clusters(found).orderBy("p", "seed").limit(1).collect()
        if not best:
            break
        cells = matrix(found.where(F.col("kmer").isin(best[0]["kmers"])))
        code = "".join(r["code"] for r in consensus(cells).orderBy("pos").collect())
        out.append({"seed": best[0]["seed"], "kmers": best[0]["kmers"], "p": best[0]["p"], "consensus": code, "matrix": [r.asDict() for r in cells.orderBy("pos", "base").collect()]})
        positive = positive.withColumn("sequence", F.regexp_replace("sequence", "|".join(best[0]["kmers"]), "N" * k))
    return out
