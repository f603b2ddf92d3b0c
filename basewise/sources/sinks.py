"""Writers of text formats. Each makes one line or record of text per row; text files keep the order of the frame."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 60


def wrapped(x: Column, width: int = WIDTH) -> Column:
    return F.regexp_replace(x, rf"(.{{{width}}})(?!$)", "$1\n")


def fasta_records(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), wrapped(F.col("sequence"))).alias("value"))


def vienna_records(df: DataFrame) -> DataFrame:
    energy = F.when(F.col("energy").isNotNull(), F.format_string(" (%.2f)", "energy")).otherwise("")
    return df.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), F.col("sequence"), F.lit("\n"), F.col("structure"), energy).alias("value"))


def ct_records(df: DataFrame) -> DataFrame:
    """Rows of id, sequence, energy and pairs (from 0) as connectivity tables."""
    n = F.length("sequence")
    partner = F.map_from_entries(F.concat(F.transform("pairs", lambda p: F.struct(p["i"].alias("a"), p["j"].alias("b"))), F.transform("pairs", lambda p: F.struct(p["j"].alias("a"), p["i"].alias("b")))))
    got = df.withColumn("__p", partner).withColumn("__n", n)
    rows = F.transform(F.sequence(F.lit(1), F.col("__n")), lambda i: F.format_string("%d %s %d %d %d %d", i, F.substring("sequence", i, F.lit(1)), i - 1, F.when(i == F.col("__n"), 0).otherwise(i + 1), F.coalesce(F.col("__p")[i - 1] + 1, F.lit(0)), i))
    head = F.concat(F.col("__n").cast("string"), F.when(F.col("energy").isNotNull(), F.format_string(" ENERGY = %.2f", "energy")).otherwise(""), F.lit(" "), F.col("id"))
    return got.select(F.concat(head, F.lit("\n"), F.array_join(rows, "\n")).alias("value"))


def bed_lines(df: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Closed intervals as half-open BED lines, in order of id and start."""
    ordered = df.orderBy("id", "start", "end")
    return ordered.select(F.concat_ws("\t", "id", F.col("start"), F.col("end") + 1, *columns).alias("value"))


def wig_lines(df: DataFrame, value: str, zeros: bool = False, coverage: int = 0, name: str = "track") -> DataFrame:
    """variableStep lines of (id, pos from 0, value): no missing ones, zeros only if wanted, only from so much coverage on."""
    kept = df.where(F.col(value).isNotNull() & (F.lit(zeros) | (F.col(value) != 0)))
    if coverage:
        kept = kept.where(F.col("coverage") >= coverage)
    first = F.row_number().over(Window.partitionBy("id").orderBy("pos")) == 1
    line = F.concat_ws(" ", F.col("pos") + 1, F.col(value))
    head = F.concat(F.lit("variableStep chrom="), F.col("id").cast("string"), F.lit("\n"))
    return kept.withColumn("value", F.concat(F.when(first, head).otherwise(""), line)).orderBy("id", "pos").select("value")


def dot_plot_lines(df: DataFrame) -> DataFrame:
    """i, j (from 1) and -log10(p), in order."""
    return df.where("p > 0").orderBy("i", "j").select(F.format_string("%d\t%d\t%.6f", F.col("i") + 1, F.col("j") + 1, -F.log10("p") + 0.0).alias("value"))


def shannon(probabilities: DataFrame) -> DataFrame:
    """Entropy (base 10) by base from pair probabilities (id, i, j, p)."""
    ends = probabilities.where("p > 0").select("id", "p", F.explode(F.array("i", "j")).alias("pos"))
    return ends.groupBy("id", "pos").agg((-F.sum(F.col("p") * F.log10("p"))).alias("shannon"))


def xml_documents(df: DataFrame, attributes: dict[str, object], decimals: int = 3, tag: str = "reactivity") -> DataFrame:
    """id and the XML document of its profile (id, sequence, values); missing values as NaN, lines of WIDTH bases."""
    shown = F.transform("values", lambda v: F.when(v.isNull(), F.lit("NaN")).otherwise(F.format_string(f"%.{decimals}f", v)))
    text = F.regexp_replace(F.array_join(shown, ","), rf"((?:[^,]+,){{{WIDTH}}})", "$1\n")
    told = " ".join(f'{k}="{_escaped(v)}"' for k, v in attributes.items())
    parts = [F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<data {told}>\n<transcript id="'), F.col("id"), F.lit('" length="'), F.length("sequence"), F.lit('">\n<sequence>\n'), wrapped(F.col("sequence")), F.lit(f"\n</sequence>\n<{tag}>\n"), text, F.lit(f"\n</{tag}>\n</transcript>\n</data>\n")]
    return df.select("id", F.concat(*parts).alias("value"))


def _escaped(v: object) -> str:
    text = {True: "TRUE", False: "FALSE"}.get(v, str(v)) if isinstance(v, bool) else str(v)
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")


def transfac(matrix: list[dict[str, float]], name: str, consensus: str) -> str:
    """A position weight matrix as TRANSFAC text."""
    rows = [f"{i:02d}\t" + "\t".join(f"{r.get(b, 0):g}" for b in "ACGT") + f"\t{c}" for i, (r, c) in enumerate(zip(matrix, consensus, strict=True), 1)]
    return "\n".join([f"ID {name}", "BF unknown", "P0\tA\tC\tG\tT", *rows, "XX", "//"]) + "\n"


def write_text(df: DataFrame, path: str, single: bool = False) -> None:
    """df's column value as text files, or (single, for results known to be small) as one file."""
    if single:
        Path(path).write_text("".join(r[0] + "\n" for r in df.toLocalIterator()))
    else:
        df.write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.mode("overwrite").option("sep", separator).option("header", "true").csv(path)


def count_text(df: DataFrame, by: tuple[str, ...] = ("id",), tabular: bool = False) -> DataFrame:
    """Count records (by, pos, base, count, coverage) as text, by and value: id, sequence, counts and coverage on a line each, or a line for each base."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "base", "count", "coverage"))).alias("r"))

    def list_of(c: str) -> Column:
        return F.array_join(F.transform("r", lambda x: x[c].cast("string")), "" if c == "base" else ",")

    name = F.col(by[0]).cast("string")
    lines = F.array_join(F.transform("r", lambda x: F.concat_ws("\t", x["base"], x["count"].cast("string"), x["coverage"].cast("string"))), "\n")
    text = F.concat(name, F.lit("\n"), lines) if tabular else F.concat_ws("\n", name, list_of("base"), list_of("count"), list_of("coverage"))
    return rows.select(*by, text.alias("value"))


def bed12_lines(exons: DataFrame) -> DataFrame:
    """One BED12 line for each transcript (id, chrom, strand, start, end of exons; ends exclusive), the longest of those that share an id; cds_start and cds_end if there."""
    rows = exons.groupBy("id", "chrom", "strand").agg(
        F.min("start").alias("a"), F.max("end").alias("b"), F.sum(F.col("end") - F.col("start")).alias("n"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("e"),
        *(F.min(c).alias(c) for c in ("cds_start", "cds_end") if c in exons.columns),
    )
    best = rows.groupBy("id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "id")), F.struct("n", "chrom", "strand")).alias("t")).select("id", "t.*")
    thick = [F.col("cds_start"), F.col("cds_end")] if "cds_start" in exons.columns else [F.col("a"), F.col("b")]
    sizes = F.concat(F.array_join(F.transform("e", lambda x: (x["end"] - x["start"]).cast("string")), ","), F.lit(","))
    starts = F.concat(F.array_join(F.transform("e", lambda x: (x["start"] - F.col("a")).cast("string")), ","), F.lit(","))
    return best.select(F.concat_ws("\t", "chrom", *(F.col(c).cast("string") for c in ("a", "b")), F.col("id").cast("string"), F.lit("0"), "strand", *(c.cast("string") for c in thick), F.lit("0,0,0"), F.size("e").cast("string"), sizes, starts).alias("value"))
