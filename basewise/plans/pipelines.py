"""Whole workflows from the operators: one function for each program of the toolbox that is one dataflow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.structure import compared
from ..operators import correlate, evaluate, kmers, normalise, pileup, scoring, windows


@dataclass
class Settings:
    """Scoring and normalising, with the usual defaults."""

    score: str = "siegfried"  # ding, rouskin, siegfried, zubradt
    method: str = "2-8"
    bases: tuple[str, ...] = ("A", "C", "G", "T")
    coverage: int = 10
    max_untreated: float = 0.05
    max_rate: float = 0.2
    pseudocount: float = 1.0
    max_score: float = 10.0
    ignore_lower: bool = False
    window: int = 1_000_000_000
    step: int | None = None
    dynamic: bool = False
    by_base: bool = False
    remap: bool = False
    mean_coverage: float = 0
    median_coverage: float = 0


def reactivities(treated: DataFrame, untreated: DataFrame | None = None, denatured: DataFrame | None = None, settings: Settings = Settings(), reads: DataFrame | None = None, factor: tuple[float, ...] | None = None) -> DataFrame:
    """Count frames to normalised reactivities (norm), null where masked; transcripts with nothing but nulls are left out."""
    s = settings
    normalise.check(s.score, s.method)
    t = scoring.covered(treated, s.mean_coverage, s.median_coverage)
    if s.score in ("ding", "siegfried"):
        sides = {"u": untreated} | ({"d": denatured} if denatured is not None and s.score == "siegfried" else {})
        joined = scoring.with_control(t, **sides)
        raw = scoring.log_ratio(joined, reads, s.coverage, s.pseudocount, s.max_score) if s.score == "ding" else scoring.difference(joined, s.coverage, s.max_untreated, s.max_rate, s.ignore_lower)
    else:
        named = t.withColumnsRenamed({"count": "t_count", "coverage": "t_coverage"})
        raw = scoring.counts(named, s.coverage) if s.score == "rouskin" else scoring.mutation_rate(named, s.coverage, s.max_rate)
    raw = raw.withColumn("raw", F.when(F.col("base").isin(*s.bases), F.col("raw")))
    if factor is not None or s.window >= 1_000_000_000:
        out = normalise.normalise(raw, s.method, ["id", "base"] if s.by_base else ["id"], factor=factor)
    elif s.dynamic:
        out = normalise.dynamic(raw, s.method, list(s.bases), s.window, s.step or s.window)
    else:
        out = normalise.sliding(raw, s.method, s.window, s.step or s.window, s.by_base)
    if s.remap:
        out = normalise.remapped(out)
    return out.join(out.where("norm is not null").select("id").distinct(), "id", "left_semi")


def call_modifications(treated: DataFrame, untreated: DataFrame, reads: tuple[float, float], window: int = 150, coverage: int = 10, to_smaller: bool = False) -> DataFrame:
    """Window score and ratio by position."""
    joined = scoring.with_control(treated, u=untreated)
    return windows.modification(windows.scaled(joined, reads, to_smaller), window, coverage).select("id", "pos", "base", "score", "ratio")


def call_peaks(joined: DataFrame, window: int = 150, offset: int | None = None, least: float = 3.0, p: float = 0.05, distance: int = 50, pseudocount: float = 1.0, refine: bool = False) -> DataFrame:
    """Peaks of IP coverage (t_coverage) over the control (u_coverage, optional), with summits."""
    enriched = windows.enrichment(joined, pseudocount)
    sides = [c for c in ("t", "u") if f"{c}_coverage" in joined.columns]
    medians = joined.groupBy("id").agg(*(F.percentile(f"{c}_coverage", 0.5).alias(f"{c}_median") for c in sides))
    found = windows.peaks(windows.significant(windows.scored(enriched, window, offset or window // 2), medians, p, least), distance)
    if refine:
        found = windows.refined(found, enriched, least)
    return windows.summits(found, enriched)


def combine(profiles: DataFrame, samples: int, least_correlation: float | None = None, logs: bool = False, ignore_missing: bool = False) -> DataFrame:
    """Replicate profiles (sample, id, pos, base, value) as one: mean and deviation; transcripts whose replicates correlate too little are left out."""
    if least_correlation is not None:
        rs = correlate.pearson(correlate.pairs(profiles, ["id", "pos"]), ["id", "s1", "s2"])
        kept = rs.groupBy("id").agg(F.min("r").alias("r"), F.count("r").alias("n")).where((F.col("r") >= least_correlation) & (F.col("n") == samples * (samples - 1) // 2))
        profiles = profiles.join(kept.select("id"), "id", "left_semi")
    return correlate.replicates(profiles, samples, ["id", "pos", "base"], logs=logs, ignore_missing=ignore_missing)


def compare_structures(reference: DataFrame, predicted: DataFrame, relaxed: bool = False) -> DataFrame:
    """id, status (ok, missing, sequence, structure) and metrics of predicted against reference structures (id, sequence, structure)."""
    p = predicted.select("id", F.col("sequence").alias("p_sequence"), F.col("structure").alias("p_structure"))
    both = reference.join(p, "id", "left").withColumn("m", F.when(F.col("sequence") == F.col("p_sequence"), compared(F.col("structure"), F.col("p_structure"), relaxed)))
    status = F.when(F.col("p_structure").isNull(), "missing").when(F.col("sequence") != F.col("p_sequence"), "sequence").when(F.col("m").isNull(), "structure").otherwise("ok")
    return both.select("id", status.alias("status"), "m.*")


def evaluate_structures(profiles: DataFrame, pairs: DataFrame, lengths: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """Unpaired coefficient, DSCI and AUROC by transcript; profiles: id, pos, value; pairs: id, i, j."""
    paired = pairs.select("id", F.explode(F.array("i", "j")).alias("pos")).distinct().withColumn("paired", F.lit(True))
    n = profiles.groupBy("id").agg((F.max("pos") + 1).alias("own"))
    right = n.join(lengths, "id").where("own <= length").select("id")
    df = profiles.join(right, "id", "left_semi").join(paired, ["id", "pos"], "left").fillna(False, ["paired"])
    return evaluate.unpaired_coefficient(df, ["id"], cutoff).join(evaluate.dsci(df, ["id"]), "id", "left").join(evaluate.auroc(df, ["id"]), "id", "left")


def factors(frames: dict[str, DataFrame], coverage: int = 10, method: str = "2-8") -> DataFrame:
    """One factor for each sample over the positions that all samples cover and (2-8) select."""
    from pyspark.sql.window import Window

    rows = None
    for name, df in frames.items():
        one = df.where(F.col("coverage") >= coverage).select(F.lit(name).alias("sample"), "id", "pos", (F.col("count") / F.col("coverage")).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    n = F.count(F.lit(1)).over(Window.partitionBy("id", "pos"))
    common = rows.withColumn("__n", n).where(F.col("__n") == len(frames)).drop("__n")
    if method == "winsor":
        return common.groupBy("sample").agg(F.percentile("value", 0.05).alias("p5"), F.percentile("value", 0.95).alias("p95"))
    # Ranks of whole samples without one task for each: cut points by exact percentiles, ties included.
    cuts = common.groupBy("sample").agg(F.percentile("value", 0.9).alias("low"), F.percentile("value", 0.98).alias("high"))
    chosen = common.join(F.broadcast(cuts), "sample").where(F.col("value").between(F.col("low"), F.col("high")))
    kept = chosen.groupBy("id", "pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(frames))
    return common.join(kept, ["id", "pos"], "left_semi").groupBy("sample").agg(F.avg("value").alias("factor"))


def count_mutations(alignments: DataFrame, reference: DataFrame, rules=None, least_quality: int = 20, most_edits: float = 0.15) -> DataFrame:
    """Alignments (sources.text.sam) to a count frame: filtered reads, their mutations by base quality, coverage without introns."""
    from ..operators import reads

    kept = reads.passing(alignments.where(pileup.usable(F.col("flag"), F.col("mapq"))), least_quality, most_edits)
    called = reads.with_mutations(kept, reference, rules or reads.Rules())
    good = F.transform(F.filter("mutations", lambda m: m["good"]), lambda m: m["pos"])
    muts = called.select(F.col("rname").alias("id"), F.explode(F.array_distinct(good)).alias("pos")).groupBy("id", "pos").agg(F.count(F.lit(1)).alias("count"))
    spans = kept.select(F.col("rname").alias("id"), F.explode(pileup.blocks(F.col("pos"), F.col("cigar"))).alias("b")).select("id", "b.start", "b.end")
    return pileup.coverage(spans).join(muts, ["id", "pos"], "left").fillna(0, ["count"]).select("id", "pos", "count", "coverage")


def find_motifs(positive: DataFrame, negative: DataFrame | None = None, k: int = 4, motifs: int = 3, p: float = 1e-3, seed: int = 0) -> list[dict]:
    """Motifs of sequences against others, or against shuffles of themselves."""
    return kmers.discover(positive, negative if negative is not None else kmers.negatives(positive, seed=seed), k, motifs, p)


def fold(*_args, **_kwargs):
    """Folding needs an external folding program, which this engine doesn't ship; its windows, votes and entropies are in operators.evaluate."""
    raise NotImplementedError("no folding program is installed")
