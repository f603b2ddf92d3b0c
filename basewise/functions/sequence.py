"""Columns on nucleic acid sequences (IUPAC alphabets, complements, translation, motifs)."""

from __future__ import annotations

import random
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The IUPAC alphabets, complements, and what each ambiguity code stands for.
ALPHABETS = {"dna": "ACGT", "rna": "ACGU", "na": "ACGTU", "iupac": "ACGTURYSWKMBDHVN", "aa": "ACDEFGHIKLMNPQRSTVWY"}
COMPLEMENT = ("ACGTUVHRMBDYKSWN", "TGCAABDYKVHRMSWN")
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
CODE_OF = {v: k for k, v in IUPAC.items()}
#: The standard genetic code, codons in the order TCAG, and the codons that other tables change.
BASES, STANDARD = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHANGES = {
    1: {}, 2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, 3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"}, 4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"}, 6: {"TAA": "Q", "TAG": "Q"}, 9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"}, 10: {"TGA": "C"}, 11: {}, 12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"}, 14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"}, 15: {"TAG": "Q"}, 16: {"TAG": "L"},
    21: {"AAA": "N", "AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"}, 22: {"TAG": "L", "TCA": "*"}, 23: {"TTA": "*"}, 24: {"AGA": "S", "AGG": "K", "TGA": "W"}, 25: {"TGA": "G"}, 26: {"CTG": "A"},
    27: {"TAA": "Q", "TAG": "Q", "TGA": "W"}, 28: {"TAA": "Q", "TAG": "Q", "TGA": "W"}, 29: {"TAA": "Y", "TAG": "Y"}, 30: {"TAA": "E", "TAG": "E"}, 31: {"TAA": "E", "TAG": "E", "TGA": "W"},
    32: {"TAG": "W"}, 33: {"AGA": "S", "AGG": "K", "TAA": "Y", "TGA": "W"},
}
THREE = dict(zip("ARNDCQEGHILKMFPSTWYV*", "Ala Arg Asn Asp Cys Gln Glu Gly His Ile Leu Lys Met Phe Pro Ser Thr Trp Tyr Val Stp".split(), strict=True))


def is_kind(x: Column, kind: str) -> Column:
    return x.rlike(f"(?i)^[{ALPHABETS[kind]}]+$")


def complement(x: Column, rna: bool = False) -> Column:
    source, target = COMPLEMENT
    target = target.replace("T", "U") if rna else target
    return F.translate(x, source + source.lower(), target + target.lower())


def reverse_complement(x: Column, rna: bool = False) -> Column:
    return F.reverse(complement(x, rna))


def to_rna(x: Column) -> Column:
    return F.translate(x, "Tt", "Uu")


def to_dna(x: Column) -> Column:
    return F.translate(x, "Uu", "Tt")


def genetic_code(table: int = 1) -> dict[str, str]:
    """Amino acid by codon in a numbered table; numbers that no table has (7, 8, 17 to 20) are refused."""
    if table not in CHANGES:
        raise ValueError(f"no genetic code {table}")
    codes = {"".join(c): a for c, a in zip(product(BASES, repeat=3), STANDARD, strict=True)}
    return codes | CHANGES[table]


def windows(x: Column, k: int, step: int = 1) -> Column:
    """All substrings of k characters, every step of them; overlapping or adjacent ones in one pass over the text."""
    if step in (1, k):
        pattern = f"(?s)(?=(.{{{k}}}))" if step == 1 else f"(?s)(.{{{k}}})"
        return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    n = F.length(x) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n, F.lit(step)), lambda i: F.substring(x, i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def translate(x: Column, table: int = 1) -> Column:
    """Amino acids by codon, ``X`` for codons with other letters; a rest of one or two bases is left out."""
    codes = F.create_map(*(F.lit(v) for pair in genetic_code(table).items() for v in pair))
    return F.array_join(F.transform(windows(to_dna(F.upper(x)), 3, 3), lambda c: F.coalesce(codes[c], F.lit("X"))), "")


def three_letters(x: Column) -> Column:
    codes = F.create_map(*(F.lit(v) for pair in THREE.items() for v in pair))
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(codes[c], F.lit("Xaa"))), "-")


def to_iupac(bases: Column) -> Column:
    """The code of a sorted string of distinct bases."""
    codes = F.create_map(*(F.lit(v) for pair in CODE_OF.items() for v in pair))
    return codes[bases]


def from_iupac(code: Column) -> Column:
    codes = F.create_map(*(F.lit(v) for pair in IUPAC.items() for v in pair))
    return codes[code]


def iupac_regex(pattern: str) -> str:
    return "".join(c if len(IUPAC.get(c, c)) == 1 else f"[{IUPAC[c]}]" for c in to_dna_text(pattern.upper()))


def to_dna_text(s: str) -> str:
    return s.replace("U", "T")


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two strings of one length (null if lengths differ)."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.when(F.length(a) == F.length(b), F.size(F.filter(differ, lambda z: z)))


def longest_orf(x: Column, starts: tuple[str, ...] = ("ATG",), any_start: bool = False, least: int = 0) -> Column:
    """The longest open reading frame (start to stop codon, both included), the first of equals; null below least bases."""
    start = "(?!TAA|TAG|TGA)[ACGT]{3}" if any_start else "|".join(starts)
    found = F.regexp_extract_all(x, F.lit(rf"(?=((?:{start})(?:(?!TAA|TAG|TGA)[ACGT]{{3}})*+(?:TAA|TAG|TGA)))"), F.lit(1))
    best = F.reduce(found, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    return F.when(F.length(best) >= max(least, 1), best)


def hard_masked(x: Column) -> Column:
    return F.regexp_replace(x, "[a-z]", "N")


def clean_id(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\w.\-:]", "_")


def extract(x: Column, start: Column, end: Column) -> Column:
    """Bases start to end (from 1, both included); null outside the sequence."""
    return F.when((start >= 1) & (end >= start) & (end <= F.length(x)), F.substring(x, start, end - start + 1))


def shuffled(x: Column, seed: int) -> Column:
    return F.array_join(F.shuffle(F.split(x, ""), F.lit(seed)), "")


def dinucleotide_shuffle(s: str, seed: int) -> str:
    """A random sequence with the same dinucleotides, first and last base: by a random Euler path through them."""
    if len(s) < 4:
        return s
    rng = random.Random(f"{seed}:{s}")
    edges: dict[str, list[str]] = {}
    for a, b in zip(s, s[1:], strict=False):
        edges.setdefault(a, []).append(b)
    last = s[-1]
    while True:  # a last edge for each base such that all lead to the final one
        final = {a: rng.choice(b) for a, b in edges.items() if a != last}

        def reaches(a: str, final: dict[str, str] = final) -> bool:
            seen = set()
            while a != last and a not in seen:
                seen.add(a)
                a = final.get(a, last)
            return a == last

        if all(reaches(a) for a in final):
            break
    order = {}
    for a, b in edges.items():
        rest = list(b)
        if a in final:
            rest.remove(final[a])
        rng.shuffle(rest)
        order[a] = iter([*rest, final[a]] if a in final else rest)
    out = [s[0]]
    while (nxt := next(order.get(out[-1], iter(())), None)) is not None:
        out.append(nxt)
    return "".join(out)


@F.udf(StringType(), useArrow=True)
def _dishuffle(s: str, seed: int) -> str | None:
    return None if s is None else dinucleotide_shuffle(s, seed)


def dishuffled(x: Column, seed: int = 0) -> Column:
    return _dishuffle(x, F.lit(seed))
