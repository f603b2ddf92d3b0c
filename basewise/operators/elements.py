"""Structure elements: hairpins, followed outward through the helices that enclose them as long as they stay well defined."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.structure import helices


@dataclass(frozen=True)
class Rules:
    """What an element must be: length, share of paired bases, size of its loops, share of bases below the median, and whether it must have a multiway junction."""

    least: int = 50
    most: int | None = None
    truncate: bool = False
    paired: float = 0.5
    loop: int | None = None
    below: float = 0.7
    multiway: bool = False


def loop_size(k: int, found: list[dict]) -> int:
    """Bases that helix k encloses and no helix inside it does."""
    h = found[k]
    inner = [g for g in found if g["parents"] and g["parents"][-1] == k]
    return h["end3"] - h["end5"] - 1 - sum(g["start3"] - g["start5"] + 1 for g in inner)


def elements(db: str, flags: list[list[bool | None]] = (), rules: Rules = Rules()) -> list[tuple[int, int]]:
    """(start, end) of the elements of a structure without pseudoknots, in order.

    Each hairpin begins one. It is followed from helix to enclosing helix until a rule breaks; one that is too long at
    once is left out or, with truncate, loses outer pairs until it fits. flags: of each base, whether a profile lies
    below its median there (null: unknown, counts as not)."""
    found = [h for h in helices(db) if not h["knot"]]
    sums = []
    for flag in flags:
        run = [0]
        for x in flag:
            run.append(run[-1] + bool(x))
        sums.append(run)
    dots = [0]  # running number of unpaired bases
    for c in db:
        dots.append(dots[-1] + (c == "."))

    def low(a: int, b: int) -> bool:
        return all((s[b + 1] - s[a]) / (b - a + 1) >= rules.below for s in sums)

    def paired(a: int, b: int) -> bool:
        return 1 - (dots[b + 1] - dots[a]) / (b - a + 1) >= rules.paired

    def fits(a: int, b: int) -> bool:
        return rules.most is None or b - a + 1 <= rules.most

    out = []
    enclosing = {h["parents"][-1] for h in found if h["parents"]}
    for k, h in enumerate(found):
        if k in enclosing or (rules.loop is not None and loop_size(k, found) > rules.loop):
            continue
        a, b, follow = h["start5"], h["start3"], True
        if not fits(a, b):
            inner = [p for p in zip(h["bases5"], h["bases3"], strict=True) if fits(*p)]
            if not rules.truncate or not inner:
                continue
            (a, b), follow = inner[0], False
        if not low(a, b):
            continue
        while follow and h["parents"]:
            up = h["parents"][-1]
            g = found[up]
            c, d = g["start5"], g["start3"]
            if not fits(c, d) or not paired(c, d) or (rules.loop is not None and loop_size(up, found) > rules.loop) or not low(c, d):
                break
            h, a, b = g, c, d
        if paired(a, b) and b - a + 1 >= rules.least and (not rules.multiway or re.search(r"\)\.*\(", db[a : b + 1])):
            out.append((a, b))
    return sorted(set(out))


ELEMENTS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def below_median(profiles: DataFrame, value: str, out: str) -> DataFrame:
    """(id, out): of each position in order, whether its rolling value (see windows.rolling_median) is negative."""
    flags = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col(value) < 0, F.lit(False)).alias("low")))), lambda x: x["low"])
    return profiles.groupBy("id").agg(flags.alias(out))


def extracted(structures: DataFrame, profiles: tuple[str, ...] = (), rules: Rules = Rules()) -> DataFrame:
    """id, motif (id_start-end), start, end, sequence and structure of every element; structures: id, sequence, structure, and array columns of flags.

    Rows whose structure is null or not as long as its sequence have none."""

    @F.udf(ELEMENTS, useArrow=True)
    def find(db: str, flags: list):
        return None if db is None else [{"start": a, "end": b} for a, b in elements(db, [] if flags is None else list(flags), rules)]

    flags = F.array(*profiles) if profiles else F.lit(None).cast("array<array<boolean>>")
    rows = structures.where(F.length("structure") == F.length("sequence")).select("id", "sequence", "structure", F.explode(find("structure", flags)).alias("e"))
    start, size = F.col("e.start"), F.col("e.end") - F.col("e.start") + 1
    return rows.select("id", F.concat(F.col("id").cast("string"), F.lit("_"), start.cast("string"), F.lit("-"), F.col("e.end").cast("string")).alias("motif"), start.alias("start"), F.col("e.end").alias("end"), F.substring("sequence", start + 1, size).alias("sequence"), F.substring("structure", start + 1, size).alias("structure"))


def with_profiles(structures: DataFrame, *profiles: DataFrame) -> DataFrame:
    """Structures joined by id with frames of (id, flags), where each has as many flags as bases."""
    out = structures
    for frame in profiles:
        name = next(c for c in frame.columns if c != "id")
        out = out.join(frame, "id").where(F.size(name) == F.length("sequence"))
    return out


def element_records(found: DataFrame, per_motif: bool = False) -> DataFrame:
    """(file, value): dot-bracket records of elements, one file for each transcript or for each element."""
    record = F.concat(F.lit(">"), "motif", F.lit("\n"), "sequence", F.lit("\n"), "structure", F.lit("\n"))
    if per_motif:
        return found.select(F.concat("motif", F.lit(".db")).alias("file"), record.alias("value"))
    rows = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", record.alias("r")))).alias("rs"))
    return rows.select(F.concat(F.col("id").cast("string"), F.lit(".db")).alias("file"), F.array_join(F.transform("rs", lambda x: x["r"]), "").alias("value"))


