"""Text formats: sequences, structures, alignments, annotations, profiles, tracks and lists, as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import ALPHABETS
from ..functions.structure import is_balanced


def fasta(spark: SparkSession, path: str, mask: bool = False) -> DataFrame:
    """id (the first word of the header), description and sequence; mask turns ambiguity codes into N. Repeated ids are an error to check for with repeated()."""
    text = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    head, body = F.substring_index("r", "\n", 1), F.regexp_replace("r", r"^[^\n]*\n?", "")
    seq = F.upper(F.regexp_replace(body, r"\s", ""))
    if mask:
        seq = F.regexp_replace(seq, "[^ACGTUN]", "N")
    return text.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.regexp_extract(head, r"^\S*\s*(.*?)\s*$", 1).alias("description"), seq.alias("sequence"))


def repeated(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def vienna(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence, structure and energy; records of unequal lengths or unbalanced brackets are left out."""
    text = spark.read.text(path, lineSep="\n>").select(F.split(F.regexp_replace("value", "^>", ""), "\n").alias("l")).where(F.size("l") >= 3)
    got = text.select(F.regexp_extract(F.get("l", F.lit(0)), r"^(\S+)", 1).alias("id"), F.upper(F.trim(F.get("l", F.lit(1)))).alias("sequence"), F.regexp_extract(F.get("l", F.lit(2)), r"^(\S+)", 1).alias("structure"), F.regexp_extract(F.get("l", F.lit(2)), r"\s\(\s*(-?[\d.]+)\s*\)", 1).try_cast("double").alias("energy"))
    return got.where((F.length("sequence") == F.length("structure")) & is_balanced(F.col("structure")))


CT = "id string, sequence string, energy double, pairs array<struct<i:int,j:int>>"


def parse_ct(text: str) -> Iterator[tuple[str, str, float | None, list[dict[str, int]]]]:
    lines = iter(text.splitlines())
    for line in lines:
        if not (m := re.match(r"\s*(\d+)\s+(.*)", line)):
            continue
        energy = re.search(r"(?:ENERGY|dG)\s*=\s*(-?[\d.]+)", m[2])
        name = re.sub(r"(?:ENERGY|dG)\s*=\s*\S+\s*", "", m[2]).strip()
        rows = [next(lines, "").split() for _ in range(int(m[1]))]
        if all(len(r) >= 6 for r in rows):
            pairs = [{"i": int(r[0]) - 1, "j": int(r[4]) - 1} for r in rows if int(r[4]) > int(r[0])]
            yield name, "".join(r[1] for r in rows).upper(), float(energy[1]) if energy else None, pairs


def ct(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence, energy and pairs (from 0, i < j) of every structure of connectivity table files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for t in b.column(0).to_pylist() for x in parse_ct(t)]
            pair = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pair)], names=["id", "sequence", "energy", "pairs"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, CT)


def sniff(lines: list[str], path: str = "") -> str:
    """fasta, vienna or ct, by the first hundred lines, else by the file's name."""
    kept = [x.rstrip() for x in lines[:100] if x.strip()]
    if kept and kept[0].startswith(">"):
        brackets = re.compile(r"^[.()\[\]{}<>A-Za-z]*[.(][.()\[\]{}<>A-Za-z]*(\s+\(.*\))?$")
        return "vienna" if any(brackets.match(x) and "." in x for x in kept if not x.startswith(">")) else "fasta"
    if kept and re.match(r"^\s*\d+\s+\S", kept[0]) and all(len(x.split()) >= 6 for x in kept[1:3]):
        return "ct"
    return {".db": "vienna", ".dot": "vienna", ".ct": "ct"}.get(Path(path).suffix, "fasta")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows with a CIGAR string; pos from 0, tags as a map, qualities as numbers."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).where((F.size("f") >= 11) & (F.get("f", F.lit(5)) != "*"))
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    got = lines.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)), F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))).alias("t"))
    tags = F.map_from_entries(F.transform("t", lambda x: F.struct(F.substring(x, 1, 2), F.regexp_replace(x, r"^[^:]*:[^:]*:", ""))))
    got = got.withColumns({c: F.col(c).cast("int") for c in ("flag", "mapq", "tlen")} | {c: F.col(c).cast("bigint") - 1 for c in ("pos", "pnext")})
    phred = F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33)
    return got.withColumn("tags", tags).withColumn("phred", F.when(F.col("qual") == "*", F.array().cast("array<int>")).otherwise(phred)).drop("t")


def sam_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(id, length) of the reference sequences that a SAM header names."""
    head = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return head.select(F.regexp_extract("value", r"\tSN:(\S+)", 1).alias("id"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length"))


def checked_header(header: DataFrame, reference: DataFrame) -> DataFrame:
    """The header's sequences that the reference holds too (id, sequence); raises if lengths differ or none is shared."""
    both = header.join(reference.select("id", F.length("sequence").alias("own")), "id")
    n, wrong = both.agg(F.count(F.lit(1)), F.count_if(F.col("length") != F.col("own"))).first()
    if not n:
        raise ValueError("header and reference share no sequence")
    if wrong:
        raise ValueError(f"{wrong} sequences differ in length between header and reference")
    return both.select("id", "length")


def sam_facts(lines: list[str]) -> dict[str, object]:
    """What the first rows of an alignment tell: paired reads, MD tags, stated sort order."""
    rows = [x.split("\t") for x in lines[:100] if not x.startswith("@")]
    order = next((m[1] for x in lines if x.startswith("@HD") and (m := re.search(r"\tSO:(\S+)", x))), "unknown")
    return {"paired": any(int(r[1]) & 1 for r in rows if len(r) >= 11), "md": bool(rows) and all(any(t.startswith("MD:Z:") for t in r[11:]) for r in rows if len(r) >= 11), "order": order}


def reactivity_xml(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence, one array for each of reactivity, probability, shannon, score, ratio (and their errors) that is there, attributes as a map; NaN is null.

    A record whose arrays and sequence differ in length is an error."""
    raw = spark.read.format("xml").option("rowTag", "data").option("inferSchema", "false").load(path)
    inner = raw.schema["transcript"].dataType
    attributes = [c for c in raw.columns if c.startswith("_")]
    amap = F.create_map(*(x for c in attributes for x in (F.lit(c[1:]), F.col(c)))) if attributes else F.create_map().cast("map<string,string>")
    names = [f.name for f in inner.fields if not f.name.startswith("_") and f.name != "sequence"]

    def numbers(c: str) -> Column:
        parts = F.split(F.regexp_replace(F.col(f"transcript.`{c}`"), r"\s", ""), ",")
        return F.transform(parts, lambda x: F.when(F.lower(x) != "nan", x.try_cast("double")))

    got = raw.select(F.col("transcript._id").alias("id"), F.regexp_replace("transcript.sequence", r"\s", "").alias("sequence"), *(numbers(c).alias(c) for c in names), amap.alias("attributes"))
    for c in names:
        same = F.size(F.col(f"`{c}`")) == F.length("sequence")
        got = got.withColumn(c, F.when(same, F.col(f"`{c}`")).otherwise(F.raise_error(F.concat(F.lit(f"{c} and sequence differ in length: "), "id"))))
    return got


def wig(spark: SparkSession, path: str) -> DataFrame:
    """id, pos (from 0) and value of variableStep tracks. Lines are numbered within a file by reading it as a whole."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.explode(F.split("value", "variableStep")).alias("b")).where(F.col("b").rlike(r"^\s+chrom="))
    rows = blocks.select(F.regexp_extract("b", r"chrom=(\S+)", 1).alias("id"), F.explode(F.slice(F.split("b", "\n"), 2, 1 << 30)).alias("l")).where(F.col("l").rlike(r"^\d+\s+\S"))
    return rows.select("id", (F.regexp_extract("l", r"^(\d+)", 1).cast("bigint") - 1).alias("pos"), F.regexp_extract("l", r"\s(\S+)", 1).try_cast("double").alias("value"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """name, id, start, end (closed, from 0) and strand; the blocks of BED12 rows as rows of their own."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser)|^\s*$")).select(f.alias("f"))

    def at(i: int) -> Column:
        return F.get("f", F.lit(i))

    start, end = at(1).cast("bigint"), at(2).cast("bigint")
    sizes, offs = F.split(F.rtrim(at(10), F.lit(",")), ","), F.split(F.rtrim(at(11), F.lit(",")), ",")
    blocks = F.zip_with(sizes, offs, lambda n, o: F.struct((start + o.cast("bigint")).alias("start"), (start + o.cast("bigint") + n.cast("bigint") - 1).alias("end")))
    whole = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
    parts = F.when(F.size("f") >= 12, blocks).otherwise(whole)
    return rows.select(F.coalesce(at(3), at(0)).alias("name"), at(0).alias("id"), F.coalesce(at(5), F.lit("+")).alias("strand"), F.explode(parts).alias("b")).select("name", "id", "b.start", "b.end", "strand")


def gtf(spark: SparkSession, path: str, feature: str = "exon", attribute: str = "transcript_id") -> DataFrame:
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(f.alias("f")).where((F.size("f") >= 9) & (F.get("f", F.lit(2)) == feature))
    return rows.select(F.regexp_extract(F.get("f", F.lit(8)), rf'{attribute} "([^"]+)"', 1).alias("name"), F.get("f", F.lit(0)).alias("id"), (F.get("f", F.lit(3)).cast("bigint") - 1).alias("start"), (F.get("f", F.lit(4)).cast("bigint") - 1).alias("end"), F.get("f", F.lit(6)).alias("strand")).where("name != ''")


def centres(peaks: DataFrame) -> DataFrame:
    return peaks.withColumn("centre", F.floor((F.col("start") + F.col("end")) / 2 + 0.5))


def junctions(spark: SparkSession, path: str, least_half: int = 20, least_gap: int = 1) -> DataFrame:
    """Chimeric junctions of one transcript, both halves forward, as closed halves in order; without repeats."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 14) & (F.get("f", F.lit(0)) == F.get("f", F.lit(3))) & (F.get("f", F.lit(2)) == "+") & (F.get("f", F.lit(5)) == "+"))

    def span(i: int) -> Column:
        ops = F.regexp_extract_all(F.get("f", F.lit(i)), F.lit(r"(\d+)[MD=X]"), F.lit(1))
        return F.aggregate(ops, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))

    a, b = F.get("f", F.lit(10)).cast("bigint") - 1, F.get("f", F.lit(12)).cast("bigint") - 1
    halves = F.array_sort(F.array(F.struct(a.alias("s"), (a + span(11) - 1).alias("e")), F.struct(b.alias("s"), (b + span(13) - 1).alias("e"))))
    got = rows.where(~F.get("f", F.lit(11)).contains("N") & ~F.get("f", F.lit(13)).contains("N")).select(F.get("f", F.lit(0)).alias("id"), halves.alias("h"))
    got = got.select("id", F.get("h", F.lit(0))["s"].alias("start1"), F.get("h", F.lit(0))["e"].alias("end1"), F.get("h", F.lit(1))["s"].alias("start2"), F.get("h", F.lit(1))["e"].alias("end2"))
    long = (F.col("end1") - F.col("start1") + 1 >= least_half) & (F.col("end2") - F.col("start2") + 1 >= least_half)
    return got.where(long & (F.col("start2") - F.col("end1") - 1 >= least_gap)).dropDuplicates()


def gapped(alignments: DataFrame, least_half: int = 20, least_gap: int = 1) -> DataFrame:
    """Forward alignments with exactly one intron as chimeras."""
    from ..operators.pileup import REVERSE, blocks

    b = alignments.where(F.col("flag").bitwiseAND(F.lit(REVERSE)) == 0).withColumn("b", blocks(F.col("pos"), F.col("cigar"))).where((F.size("b") == 2) & (F.regexp_count("cigar", F.lit("N")) == 1))
    got = b.select(F.col("rname").alias("id"), F.get("b", F.lit(0))["start"].alias("start1"), F.get("b", F.lit(0))["end"].alias("end1"), F.get("b", F.lit(1))["start"].alias("start2"), F.get("b", F.lit(1))["end"].alias("end2"))
    long = (F.col("end1") - F.col("start1") + 1 >= least_half) & (F.col("end2") - F.col("start2") + 1 >= least_half)
    return got.where(long & (F.col("start2") - F.col("end1") - 1 >= least_gap)).dropDuplicates()


def dot_plot(spark: SparkSession, path: str) -> DataFrame:
    """i, j (from 0) and probability (the square of the stated number) of the upper triangle."""
    pattern = r"^(\d+)\s+(\d+)\s+([\d.eE+-]+)\s+ubox"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    p = F.regexp_extract("value", pattern, 3).cast("double")
    return rows.select((F.regexp_extract("value", pattern, 1).cast("int") - 1).alias("i"), (F.regexp_extract("value", pattern, 2).cast("int") - 1).alias("j"), (p * p).alias("p"))


def probability_table(spark: SparkSession, path: str) -> DataFrame:
    """i, j (from 0) and probability, from rows of i, j and -log10(p)."""
    pattern = r"^\s*(\d+)\s+(\d+)\s+([\d.eE+-]+)\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select((F.regexp_extract("value", pattern, 1).cast("int") - 1).alias("i"), (F.regexp_extract("value", pattern, 2).cast("int") - 1).alias("j"), F.pow(F.lit(10.0), -F.regexp_extract("value", pattern, 3).cast("double")).alias("p"))


def masks(spark: SparkSession, path: str, reference: DataFrame) -> DataFrame:
    """id, start, end of masked ranges: given as ranges, or as a sequence (``rc:`` before one to be reverse complemented) at its first place in the transcript."""
    from ..functions.sequence import reverse_complement, to_dna

    f = F.split("value", "[,;]")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.trim(f[0]).alias("id"), F.explode(F.slice(f, 2, 1 << 20)).alias("m")).withColumn("m", F.trim("m"))
    ranges = rows.where(F.col("m").rlike(r"^\d+-\d+$")).select("id", F.regexp_extract("m", r"^(\d+)", 1).cast("bigint").alias("start"), F.regexp_extract("m", r"(\d+)$", 1).cast("bigint").alias("end"))
    texts = rows.where(F.col("m").rlike(r"(?i)^(rc:)?[ACGTU]+$"))
    bare = to_dna(F.upper(F.regexp_replace("m", "(?i)^rc:", "")))
    wanted = F.when(F.lower("m").startswith("rc:"), reverse_complement(bare)).otherwise(bare)
    found = texts.select("id", wanted.alias("w")).join(reference.select("id", to_dna(F.upper("sequence")).alias("s")), "id").withColumn("at", F.expr("locate(w, s)"))
    return ranges.unionByName(found.where("at > 0").select("id", (F.col("at") - 1).cast("bigint").alias("start"), (F.col("at") + F.length("w") - 2).cast("bigint").alias("end")))


def positions_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos) of lines of an id with positions or ranges; a line of an id alone gives a null position."""
    f = F.split("value", r"[;,\t]")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.trim(f[0]).alias("id"), F.explode_outer(F.slice(f, 2, 1 << 20)).alias("m"))
    ok = rows.where(F.col("m").isNull() | F.trim("m").rlike(r"^\d+(-\d+)?$"))
    a, b = F.regexp_extract("m", r"(\d+)", 1).cast("bigint"), F.regexp_extract("m", r"(\d+)\s*$", 1).cast("bigint")
    return ok.select("id", F.explode_outer(F.when(F.col("m").isNotNull() & (a <= b), F.sequence(a, b))).alias("pos")).distinct()


def repair_json(text: str) -> str:
    """JSON that was cut off: closes what is open, without the element that the cut hit."""
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    cut = len(text)
    while cut > 0:
        cut = max(text.rfind("}", 0, cut), text.rfind("]", 0, cut))
        if cut < 0:
            return "{}"
        stack, quoted, escaped = [], False, False
        for c in text[: cut + 1]:
            if quoted:
                quoted = escaped or c != '"'
                escaped = c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        candidate = text[: cut + 1] + "".join(reversed(stack))
        try:
            json.loads(candidate)
            return candidate
        except ValueError:
            continue
    return "{}"


WINDOW = "struct<start:bigint,end:bigint,stoichiometries:array<double>,counts:array<array<bigint>>,coverage:array<array<bigint>>,preCoverage:array<bigint>>"


def deconvolution(spark: SparkSession, path: str, least_conformations: int = 1, least_coverage: float = 0) -> DataFrame:
    """Windows of deconvolution files: file, id, start, end, stoichiometries, counts, coverage; of enough conformations and median coverage. Files that were cut off are repaired."""
    repair = F.udf(repair_json, "string", useArrow=True)
    schema = f"struct<transcripts:array<struct<id:string,sequence:string,windows:array<{WINDOW}>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json(repair("value"), schema).alias("j"))
    rows = raw.select("file", F.explode("j.transcripts").alias("t")).select("file", "t.id", "t.sequence", F.explode("t.windows").alias("w")).select("file", "id", "sequence", "w.*")
    from ..functions.math import median

    return rows.where((F.size("stoichiometries") >= least_conformations) & (F.coalesce(median(F.col("preCoverage")), F.lit(float("inf"))) >= least_coverage))


def profile_folder(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Profiles of several folders of XML files, with the sample's name; only ids that all of them hold."""
    out = None
    for name, path in paths.items():
        df = reactivity_xml(spark, path).withColumn("sample", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    n = F.size(F.collect_set("sample").over(Window.partitionBy("id")))
    return out.withColumn("__n", n).where(F.col("__n") == len(paths)).drop("__n")


def fastq_faults(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with the first reads of a FASTQ file."""
    lines = [r[0] for r in spark.read.text(path).limit(400).collect()]
    out = []
    for i in range(0, len(lines) - 3, 4):
        head, seq, plus, qual = lines[i : i + 4]
        if not head.startswith("@") or not plus.startswith("+") or len(seq) != len(qual) or not set(seq.upper()) <= set("ACGTUN."):
            out.append(f"read {i // 4 + 1}")
    if not lines or len(lines) % 4 and len(lines) < 400:
        out.append("length")
    return out


def aligner_statistics(text: str) -> dict[str, int]:
    """Reads by how they mapped, from an aligner's log."""
    patterns = {"processed": r"(?:reads processed: |^)(\d+)(?: reads; of these)?", "unique": r"at least one (?:reported )?alignment: (\d+)|(\d+) .*aligned exactly 1 time", "failed": r"failed to align: (\d+)|(\d+) .*aligned 0 times", "multiple": r"suppressed due to -m: (\d+)|(\d+) .*aligned >1 times"}
    out = {}
    for name, p in patterns.items():
        if m := re.search(p, text, re.M):
            out[name] = int(next(g for g in m.groups() if g))
    return out


def config(path: str, defaults: dict[str, object] | None = None) -> dict[str, object]:
    """key=value lines over defaults; yes/no, true/false as booleans, numbers as numbers. Unknown keys are an error where defaults are given."""
    out = dict(defaults or {})
    for line in Path(path).read_text().splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        key, _, value = (x.strip() for x in line.partition("="))
        if defaults is not None and key.lower() not in defaults:
            raise KeyError(key)
        low = value.lower()
        out[key.lower()] = True if low in ("yes", "true", "on") else False if low in ("no", "false", "off") else int(value) if re.fullmatch(r"[+-]?\d+", value) else float(value) if re.fullmatch(r"[+-]?\d*\.\d+(e[+-]?\d+)?", low) else value
    return out


def write_config(path: str, values: dict[str, object]) -> None:
    def text(v: object) -> str:
        return ("yes" if v else "no") if isinstance(v, bool) else str(v)

    Path(path).write_text("".join(f"{k}={text(v)}\n" for k, v in values.items()))


def annotation(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A gene annotation table over JDBC (needs the driver's jar on the class path)."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def kind_of(sequence: str) -> str | None:
    return next((k for k in ("dna", "rna", "na", "iupac", "aa") if sequence and set(sequence.upper()) <= set(ALPHABETS[k])), None)
