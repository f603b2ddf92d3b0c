"""Sizes, durations, random values and marked-up text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes (powers of 1024), and of durations in seconds (a month has 30.5 days, a year 12 months).
SIZES = "KMGTP"
DURATIONS = [("year", 31_622_400), ("month", 2_635_200), ("week", 604_800), ("day", 86_400), ("hour", 3600), ("minute", 60), ("second", 1)]


def human_size(size: Column) -> Column:
    """Bytes with one decimal in the largest unit that they reach; null for negative sizes."""
    out = F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit("B")))
    for power, unit in enumerate(SIZES, 1):
        last = power == len(SIZES)
        out = out.when(F.lit(True) if last else size < 1024 ** (power + 1), F.concat(F.format_string("%.1f", F.bround(size / 1024.0**power, 1)), F.lit(unit)))
    return F.when(size >= 0, out)


def size_in_bytes(text: Column) -> Column:
    """The bytes of a number with or without unit (B, K, M, G, T, P in any case); null for other texts."""
    number = F.regexp_extract(F.upper(text), r"^([0-9]+(?:\.[0-9]+)?)[BKMGTP]?$", 1)
    power = F.greatest(F.instr(F.lit(SIZES), F.right(F.upper(text), F.lit(1))), F.lit(0))
    return F.when(number != "", number.cast("double") * F.pow(F.lit(1024.0), F.when(F.upper(text).rlike("[KMGTP]$"), power).otherwise(0)))


def duration(seconds: Column, long: bool = False) -> Column:
    """A whole number of seconds in years, months, weeks, days, hours, minutes and seconds, without those that are 0."""
    parts, rest = [], seconds.cast("bigint")
    for name, size in DURATIONS:
        n = F.floor(rest / size)
        label = F.concat(F.lit(f" {name}"), F.when(n > 1, "s").otherwise("")) if long else F.lit(name[0])
        parts.append(F.when(n > 0, F.concat(n.cast("string"), label)))
        rest = rest % size
    out = F.concat_ws(", " if long else " ", *parts)
    return F.when(out == "", "0 seconds" if long else "0s").otherwise(out)


def random_whole(low: int, high: int, seed: int | None = None) -> Column:
    """A whole number from low to high, each as likely."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("bigint")


def random_text(length: int, letters: str, seed: int | None = None) -> Column:
    """A text of so many letters, each as likely."""
    picks = [F.substring(F.lit(letters), (F.floor(F.rand(None if seed is None else seed + i) * len(letters)) + 1).cast("int"), F.lit(1)) for i in range(length)]
    return F.concat(*picks) if picks else F.lit("")


def uri_escaped(text: Column) -> Column:
    """Everything but letters, digits and ``-_.~`` as %XX of its UTF-8 bytes; a space too."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def uri_plain(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def unquoted(text: Column) -> Column:
    """A text whose signs stand behind backslashes, without those."""
    return F.regexp_replace(text, r"\\(.)", "$1")
