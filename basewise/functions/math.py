"""Columns for plain mathematics, with the rounding and missing-value rules of this engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def nearest_multiple(x: Column, m: float) -> Column:
    """The multiple of m nearest to x, the upper one if both are as near."""
    return F.floor(x / m + 0.5) * m


def logarithm(x: Column, base: float) -> Column:
    """The logarithm of a positive number; infinite for 0, null below."""
    return F.when(x > 0, F.ln(x) / F.ln(F.lit(base))).when(x == 0, F.lit(float("inf")))


def rescale(x: Column, old: tuple[float, float], new: tuple[float, float]) -> Column:
    return (x - old[0]) * (new[1] - new[0]) / (old[1] - old[0]) + new[0]


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> tuple[Column, Column]:
    """First and last position that two closed intervals share; nulls if they share none."""
    low, high = F.greatest(a1, b1), F.least(a2, b2)
    return F.when(low <= high, low), F.when(low <= high, high)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def product(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(1.0), lambda a, x: a * x.cast("double"))


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs))


def variance(xs: Column, ddof: int = 1) -> Column:
    """0 for a single value."""
    m = mean(xs)
    squares = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(xs) > ddof, squares / (F.size(xs) - ddof)).when(F.size(xs) > 0, F.lit(0.0))


def deviation(xs: Column, ddof: int = 1) -> Column:
    return F.sqrt(variance(xs, ddof))


def geometric_mean(xs: Column) -> Column:
    """0 if any value is 0."""
    logs = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.ln(x))
    return F.when(F.exists(xs, lambda x: x == 0), F.lit(0.0)).otherwise(F.exp(F.try_divide(logs, F.size(xs))))


def median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def midrange(xs: Column) -> Column:
    return (F.array_min(xs) + F.array_max(xs)) / 2


def places(xs: Column, wanted: Callable[[Column], Column]) -> Column:
    """The positions (from 0) of all values that equal wanted(xs), e.g. F.array_max."""
    best = wanted(xs)
    return F.filter(F.transform(xs, lambda x, i: F.when(x == best, i)), lambda i: i.isNotNull())


def distance(a: Column, b: Column, normalised: bool = False) -> Column:
    """Euclidean distance over the places where both have a value; normalised: by the root of their number."""
    pairs = F.filter(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda z: z.isNotNull() & ~F.isnan(z))
    squares = total(pairs)
    return F.sqrt(F.try_divide(squares, F.size(pairs)) if normalised else squares)


def is_number(x: Column) -> Column:
    """Text that reads as a finite number."""
    v = x.try_cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def is_whole(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[+-]?\d+$"), F.lit(False))


def is_even(x: Column) -> Column:
    return F.pmod(x, F.lit(2)) == 0


def gini(xs: Column) -> Column:
    """Mean absolute difference of all pairs by twice the mean, from ranks in O(n log n)."""
    s, n = F.array_sort(F.transform(xs, lambda x: x.cast("double"))), F.size(xs)
    weighted = F.aggregate(F.transform(s, lambda x, i: x * (2 * i - n + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(weighted, n * total(s)), F.lit(0.0)))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
