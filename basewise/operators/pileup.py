"""Counts and coverage from reads, and the operations on count frames (id, pos, base, count, coverage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: SAM flag bits.
PAIRED, PROPER, UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE = 1, 2, 4, 16, 32, 64, 128, 256, 512, 1024


def usable(flag: Column, mapq: Column, least_mapq: int = 0, duplicates: bool = False, primary: bool = False, forward: bool = False, proper: bool = False) -> Column:
    """Reads that count: mapped and of good quality; no duplicates unless asked for; optionally primary, forward, properly paired ones only."""
    banned = UNMAPPED | QC_FAIL | (0 if duplicates else DUPLICATE) | (SECONDARY if primary else 0) | (REVERSE if forward else 0)
    needed = PAIRED | PROPER if proper else 0
    return (flag.bitwiseAND(F.lit(banned)) == 0) & (flag.bitwiseAND(F.lit(needed)) == needed) & (mapq >= least_mapq)


def library_strand(flag: Column, first_strand: bool) -> Column:
    """+ or - strand of the transcript that a read (or its pair) comes from."""
    reverse = flag.bitwiseAND(F.lit(REVERSE)) != 0
    second = (flag.bitwiseAND(F.lit(PAIRED)) != 0) & (flag.bitwiseAND(F.lit(SECOND)) != 0)
    minus = reverse != second
    return F.when(minus != F.lit(first_strand), "-").otherwise("+")


def stops(reads: DataFrame, trimmed: int = 0) -> DataFrame:
    """Reverse transcription stops: the base before each read's first (0-based start, less trimmed bases), if there is one."""
    at = F.col("start") - trimmed - 1
    return reads.where(at >= 0).groupBy("id", at.alias("pos")).agg(F.count(F.lit(1)).alias("count"))


def mutations(reads: DataFrame) -> DataFrame:
    return reads.select("id", F.explode("muts").alias("pos")).groupBy("id", "pos").agg(F.count(F.lit(1)).alias("count"))


def coverage(reads: DataFrame, by: tuple[str, ...] = ("id",), bin_size: int = 1024) -> DataFrame:
    """Depth at every covered position, by running sums of starts and ends.

    Reads are cut at bins of positions, so that each (id, bin) is a short running sum of its own and no transcript,
    however long or hot, has to be in one task."""
    cut = reads.select(*by, "start", "end", F.explode(F.expr(f"sequence(start div {bin_size}, end div {bin_size})")).alias("__bin"))
    first, last = F.greatest("start", F.col("__bin") * bin_size), F.least("end", (F.col("__bin") + 1) * bin_size - 1)
    edges = cut.select(*by, "__bin", F.explode(F.array(F.struct(first.alias("at"), F.lit(1).alias("d")), F.struct((last + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(*by, "__bin", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*by, "__bin").orderBy("at")
    runs = steps.select(*by, "at", F.sum("d").over(w).alias("coverage"), F.lead("at").over(w).alias("until")).where("coverage > 0")
    return runs.select(*by, F.explode(F.expr("sequence(at, until - 1)")).alias("pos"), "coverage")


def blocks(start: Column, cigar: Column) -> Column:
    """Reference blocks (closed) of an alignment: its span without introns (N) of the CIGAR string."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("bigint").alias("n"), F.substring(x, -1, 1).alias("op")))
    zero = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"), F.lit(True).alias("new"))

    def step(acc: Column, x: Column) -> Column:
        here = x["op"].isin("M", "D", "=", "X")
        last = F.element_at(acc["out"], -1)
        grown = F.when(acc["new"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + x["n"] - 1).alias("end"))))).otherwise(F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), (acc["at"] + x["n"] - 1).alias("end")))))
        return F.struct(F.when(here | (x["op"] == "N"), acc["at"] + x["n"]).otherwise(acc["at"]).alias("at"), F.when(here, grown).otherwise(acc["out"]).alias("out"), F.when(here, F.lit(False)).when(x["op"] == "N", F.lit(True)).otherwise(acc["new"]).alias("new"))

    return F.aggregate(ops, zero, step)["out"]


def merge(*frames: DataFrame) -> DataFrame:
    """Counts and coverage of several count frames added up."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.groupBy("id", "pos", "base").agg(F.sum("count").alias("count"), F.sum("coverage").alias("coverage"))


def from_reads(reads: DataFrame) -> DataFrame:
    """Count frame of mutation-mapped reads: mutations and coverage by position."""
    return coverage(reads).join(mutations(reads), ["id", "pos"], "left").select("id", "pos", F.coalesce("count", F.lit(0)).alias("count"), "coverage")


def downsampled(reads: DataFrame, most: int) -> DataFrame:
    """At most so many reads from each start (the first by read number)."""
    w = Window.partitionBy("id", "start").orderBy("read_no")
    return reads.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def collapsed(muts: Column, distance: int = 2) -> Column:
    """Sorted mutations, of each run with steps of at most distance the 3'-most only."""
    return F.filter(muts, lambda x, i: F.coalesce(F.get(muts, i + 1) - x > distance, F.lit(True)))


def isolated(muts: Column, distance: int = 2) -> Column:
    """Sorted mutations without those that have another within distance."""
    return F.filter(muts, lambda x, i: F.coalesce(F.get(muts, i + 1) - x > distance, F.lit(True)) & F.coalesce(x - F.get(muts, i - 1) > distance, F.lit(True)))


def agreed(a: Column, b: Column, a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Mutations of two mates: in their overlap those that both have, elsewhere all."""
    low, high = F.greatest(a_start, b_start), F.least(a_end, b_end)
    outside = F.filter(F.array_union(a, b), lambda x: (x < low) | (x > high))
    return F.array_sort(F.array_union(outside, F.array_intersect(a, b)))


def fragments(mates: DataFrame) -> DataFrame:
    """Reads of one pair as one fragment: pairs that overlap or touch are one span; a mate alone counts too."""
    got = mates.groupBy("pair_id", "id").agg(F.count(F.lit(1)).alias("mates"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("start").alias("last_start"), F.min("end").alias("first_end"))
    return got.withColumn("overlap", (F.col("mates") == 2) & (F.col("last_start") <= F.col("first_end"))).drop("last_start", "first_end")


def reconciled(mates: DataFrame, split_beyond: int, drop_beyond: int) -> DataFrame:
    """Fragments as reads: the gap between mates is bridged up to split_beyond, beyond it they are two reads, and beyond drop_beyond none."""
    got = mates.groupBy("pair_id", "id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("m"))
    one = F.array(F.struct(F.array_min(F.transform("m", lambda x: x["start"])).alias("start"), F.array_max(F.transform("m", lambda x: x["end"])).alias("end")))
    parts = F.when((F.size("m") < 2) | (F.try_element_at("m", F.lit(2)).isNull()), one).when(F.try_element_at("m", F.lit(2))["start"] - F.col("m")[0]["end"] - 1 <= split_beyond, one).when(F.try_element_at("m", F.lit(2))["start"] - F.col("m")[0]["end"] - 1 <= drop_beyond, F.col("m"))
    return got.select("pair_id", "id", F.explode(parts).alias("p")).select("pair_id", "id", "p.start", "p.end")


def co_mutations(reads: DataFrame) -> DataFrame:
    """How many reads have both of each two mutated positions."""
    pairs = F.flatten(F.transform("muts", lambda x, i: F.transform(F.slice("muts", i + 2, F.size("muts")), lambda y: F.struct(x.alias("i"), y.alias("j")))))
    return reads.select("id", F.explode(pairs).alias("p")).groupBy("id", "p.i", "p.j").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Rows by value, with every whole number between the smallest and the largest."""
    by = by or []
    counts = df.groupBy(*by, F.col(value).cast("bigint").alias(value)).agg(F.count(F.lit(1)).alias("n"))
    spans = counts.groupBy(*by).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    dense = spans.select(*by, F.explode(F.sequence("a", "b")).alias(value))
    return dense.join(counts, [*by, value], "left").fillna(0, ["n"])


def fine_coverage(reads: DataFrame, low: str, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Depth at every position that has any, without the positions of low quality (an array) of each read."""
    poor = reads.select(*by, "start", "end", F.explode(low).alias("pos")).where(F.col("pos").between(F.col("start"), F.col("end"))).groupBy(*by, "pos").agg(F.count(F.lit(1)).alias("__n"))
    depth = coverage(reads, by).join(poor, [*by, "pos"], "left")
    return depth.select(*by, "pos", (F.col("coverage") - F.coalesce("__n", F.lit(0))).alias("coverage")).where("coverage > 0")


def median_span(reads: DataFrame, order: str, most: int = 10_000) -> DataFrame:
    """The median length on the reference of the first reads, rounded half up: median."""
    first = reads.orderBy(order).limit(most).select((F.col("end") - F.col("start") + 1).alias("span"))
    return first.agg(F.floor(F.percentile("span", 0.5) + 0.5).cast("bigint").alias("median"))


def genome_counts(reads: DataFrame, trimmed: int = 0) -> DataFrame:
    """Stops and coverage of both strands: id, strand, pos, count, coverage; reads has id, strand, start, end.

    A read of the - strand stops behind its last position. Bases trimmed from a read's 5' end count as covered, and the
    stop lies before them. Positions before 0 are left out; those behind a sequence's end are the caller's to drop."""
    plus = F.col("strand") == "+"
    wide = reads.select("id", "strand", F.when(plus, F.greatest(F.col("start") - trimmed, F.lit(0))).otherwise(F.col("start")).alias("start"), F.when(plus, F.col("end")).otherwise(F.col("end") + trimmed).alias("end"), F.when(plus, F.col("start") - trimmed - 1).otherwise(F.col("end") + trimmed + 1).alias("at"))
    depth = coverage(wide, ("id", "strand")).withColumn("count", F.lit(0).cast("bigint"))
    stop = wide.where("at >= 0").groupBy("id", "strand", F.col("at").alias("pos")).agg(F.count(F.lit(1)).alias("count")).withColumn("coverage", F.lit(0).cast("bigint"))
    return depth.unionByName(stop.select(depth.columns)).groupBy("id", "strand", "pos").agg(F.sum("count").alias("count"), F.sum("coverage").alias("coverage"))
