"""Mutations of alignments from CIGAR strings and MD tags."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
MD = re.compile(r"(\d+)|\^([A-Z]+)|([A-Z])")


def cigar(x: Column) -> Column:
    """clip5, clip3 (soft and hard), span on the reference without introns, length (aligned read bases), insertions (offsets of the base before each)."""
    ops = F.transform(F.regexp_extract_all(x, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda o: F.struct(F.regexp_extract(o, r"^(\d+)", 1).cast("int").alias("n"), F.substring(o, -1, 1).alias("op")))
    names = ["clip5", "clip3", "span", "length", "last"]
    zero = F.struct(*(F.lit(0).alias(n) for n in names), F.lit(False).alias("begun"), F.array().cast("array<int>").alias("insertions"))

    def step(a: Column, o: Column) -> Column:
        clip, n = o["op"].isin("S", "H"), o["n"]

        def add(c: str, when: Column) -> Column:
            return F.when(when, a[c] + n).otherwise(a[c]).alias(c)

        return F.struct(
            add("clip5", clip & ~a["begun"]), add("clip3", clip & a["begun"]), add("span", o["op"].isin("M", "D", "=", "X")), add("length", o["op"].isin("M", "I", "=", "X")), add("last", o["op"].isin("M", "D", "N", "=", "X")),
            (a["begun"] | ~clip).alias("begun"), F.when(o["op"] == "I", F.concat(a["insertions"], F.array(a["last"] - 1))).otherwise(a["insertions"]).alias("insertions"),
        )

    out = F.aggregate(ops, zero, step)
    return F.struct(*(out[n].alias(n) for n in ("clip5", "clip3", "span", "length", "insertions")))


def edit_distance(md: Column, insertions: Column) -> Column:
    """Substitutions, runs of deleted bases (those of N only don't count) and insertions."""
    bare = F.regexp_replace(md, r"\^[A-Z]+", "")
    return F.regexp_count(md, F.lit(r"\^N*[ACGT]")) + F.regexp_count(bare, F.lit("[ACGT]")) + insertions


def median_quality(phred: Column) -> Column:
    from ..functions.math import median

    return median(phred)


@dataclass(frozen=True)
class Rules:
    """How mutations are called; the defaults are the usual ones."""

    quality: int = 20
    around: bool = False
    deletions: bool = True
    longest_deletion: int = 10
    ambiguous: bool = True
    left_align: bool = False
    marks: str = "all"  # of a deletion: all, first or last base
    only: frozenset[str] | None = None  # e.g. AG: A in the reference, G in the read


def only_classes(text: str) -> frozenset[str]:
    """``A2T;C>N`` and the like as pairs of bases, ambiguity codes spelt out."""
    from ..functions.sequence import IUPAC

    out = set()
    for part in filter(None, re.split(r"[,;\s]+", text.upper().replace("U", "T"))):
        a, b = re.fullmatch(r"([A-Z])(?:2|>|:)?([A-Z])", part).groups()
        out |= {x + y for x in IUPAC[a] for y in IUPAC[b] if x != y}
    return frozenset(out)


def read_places(start: int, text: str) -> dict[int, int]:
    """Place in the read of each reference position that has an aligned base."""
    out, at, ref = {}, 0, start
    for n, op in CIGAR.findall(text):
        n = int(n)
        if op in "M=X":
            out.update(zip(range(ref, ref + n), range(at, at + n), strict=True))
        at += n if op in "MIS=X" else 0
        ref += n if op in "MDN=X" else 0
    return out


def slides(reference: str, start: int, size: int) -> tuple[int, int]:
    """First and last start at which deleting size bases gives the same sequence, at most ten bases off."""
    low = high = start
    while low > 0 and start - low < 10 and reference[low - 1] == reference[low + size - 1]:
        low -= 1
    while high + size < len(reference) and high - start < 10 and reference[high] == reference[high + size]:
        high += 1
    return low, high


def mutations(start: int, text: str, md: str, sequence: str, phred: list[int], reference: str, rules: Rules = Rules()) -> list[tuple[int, str, bool]]:
    """(position, class, good): class is the two bases or ``del``; not good ones lack quality or another class was asked for."""
    places, out, at = read_places(start, text), [], start

    def fine(pos: int) -> bool:
        k = places.get(pos)
        return k is None or (k < len(phred) and phred[k] >= rules.quality)

    for n, deleted, base in MD.findall(md.upper()):
        if n:
            at += int(n)
        elif deleted:
            size = len(deleted)
            if rules.deletions and rules.only is None and size <= rules.longest_deletion:
                low, high = slides(reference, at, size)
                if low == high or rules.ambiguous:
                    first = low if rules.left_align else high
                    marked = {"all": range(first, first + size), "first": [first], "last": [first + size - 1]}[rules.marks]
                    out += [(p, "del", True) for p in marked]
            at += size
        else:
            k = places.get(at)
            seen = sequence[k].upper() if k is not None and k < len(sequence) else "N"
            if base != "N" and seen != "N":
                good = fine(at) and (not rules.around or (fine(at - 1) and fine(at + 1))) and (rules.only is None or base + seen in rules.only)
                out.append((at, base + seen, good))
            at += 1
    return out


def with_mutations(alignments: DataFrame, reference: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Alignments (of sources.text.sam) with their mutations: an array of pos, kind and good. reference: id, sequence; joined by id."""
    kind = "array<struct<pos:bigint,kind:string,good:boolean>>"

    @F.udf(kind, useArrow=True)
    def parse(start: int, text: str, md: str, sequence: str, phred: list[int], ref: str):
        if md is None or ref is None:
            return None
        return [{"pos": p, "kind": k, "good": g} for p, k, g in mutations(start, text, md, sequence, list(phred), ref, rules)]

    both = alignments.join(reference.select(F.col("id").alias("rname"), F.col("sequence").alias("__ref")), "rname")
    return both.withColumn("mutations", parse("pos", "cigar", F.col("tags")["MD"], "seq", "phred", "__ref")).drop("__ref")


def passing(alignments: DataFrame, least_quality: int = 20, most_edits: float = 0.15, least_span: int = 1) -> DataFrame:
    """Reads long, good and like the reference enough; the mate of one that isn't goes too."""
    from pyspark.sql.window import Window

    parsed = alignments.withColumn("__c", cigar(F.col("cigar")))
    edits = edit_distance(F.coalesce(F.col("tags")["MD"], F.lit("")), F.size("__c.insertions"))
    bad = (F.col("__c.span") < least_span) | (F.try_divide(edits, F.col("__c.span")) > most_edits) | (F.coalesce(median_quality(F.col("phred")), F.lit(1e9)) < least_quality)
    w = Window.partitionBy("qname", "rname", F.least("pos", "pnext"), F.greatest("pos", "pnext"))
    return parsed.withColumn("__bad", F.max(bad.cast("int")).over(w)).where("__bad = 0").drop("__c", "__bad")


def unclipped(alignments: DataFrame, most5: int = 0, most3: int | None = None) -> DataFrame:
    """Reads whose clipping at each end stays within the limits."""
    c = cigar(F.col("cigar"))
    keep = c["clip5"] <= most5
    return alignments.where(keep if most3 is None else keep & (c["clip3"] <= most3))


def clip_limits(text: str) -> tuple[int | None, int | None, int | None]:
    """``5pN,3pN`` or a total: limits at the 5' end, the 3' end and in all."""
    five = re.search(r"5p(\d+)", text)
    three = re.search(r"3p(\d+)", text)
    if five or three:
        return int(five[1]) if five else None, int(three[1]) if three else None, None
    return None, None, int(text)
