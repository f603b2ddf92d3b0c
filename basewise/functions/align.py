"""Local alignment with scores of letter pairs and affine gaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Scores of the pairs that RNA can form, for aligning a sequence with one that may pair with it.
PAIRING = {"AU": 2.0, "CG": 3.0, "GU": 1.0}


@dataclass(frozen=True)
class Scores:
    """Scores of two letters in either order, of letters without one (equal or not), and of a gap's first and further places."""

    pairs: tuple[tuple[str, float], ...] = ()
    equal: float = 2.0
    other: float = -1.0
    open: float = -3.0
    extend: float = -1.0

    def of(self, a: str, b: str) -> float:
        known = dict(self.pairs)
        return known.get(a + b, known.get(b + a, self.equal if a == b else self.other))


def local(a: str, b: str, scores: Scores = Scores()) -> tuple[float, int, int, str, str]:
    """Score, begin in a and b, and both aligned parts (with ``-`` for gaps) of a best local alignment; score 0 and empty parts if there is none.

    Three scores for each cell: ending in two letters, in a gap of b, in a gap of a. Of equal alignments the one that
    ends first, in a and then in b, and that has letters rather than gaps at its end, is given."""
    a, b = a.upper(), b.upper()
    table = {(x, y): scores.of(x, y) for x in set(a) for y in set(b)}
    low = float("-inf")
    # Letters, gap of b, gap of a; and from which of the three (or 3: a new begin) each came.
    met, down, right = ([[low] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(3))
    came = [[(3, 0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    best, at = 0.0, None
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            before = (met[i - 1][j - 1], down[i - 1][j - 1], right[i - 1][j - 1], 0.0)
            k = max(range(4), key=lambda x: (before[x], x == 3, -x))
            met[i][j] = before[k] + table[a[i - 1], b[j - 1]]
            above = (met[i - 1][j] + scores.open, down[i - 1][j] + scores.extend, right[i - 1][j] + scores.open)
            d = max(range(3), key=lambda x: (above[x], -x))
            down[i][j] = above[d]
            left = (met[i][j - 1] + scores.open, down[i][j - 1] + scores.open, right[i][j - 1] + scores.extend)
            r = max(range(3), key=lambda x: (left[x], -x))
            right[i][j] = left[r]
            came[i][j] = (k, d, r)
            if met[i][j] > best:
                best, at = met[i][j], (i, j)
    if at is None:
        return 0.0, 0, 0, "", ""
    (i, j), state, one, two = at, 0, [], []
    while state < 3:
        back = came[i][j][state]
        one.append(a[i - 1] if state < 2 else "-")
        two.append(b[j - 1] if state != 1 else "-")
        i, j, state = i - (state < 2), j - (state != 1), back
    return best, i, j, "".join(reversed(one)), "".join(reversed(two))


RESULT = StructType([StructField("score", IntegerType()), StructField("start_a", IntegerType()), StructField("start_b", IntegerType()), StructField("a", StringType()), StructField("b", StringType())])


def aligned(a: Column, b: Column, scores: Scores = Scores()) -> Column:
    """local() of two columns, with the score rounded to a whole number; null if either is."""

    @F.udf(RESULT, useArrow=True)
    def run(x: str, y: str):
        if x is None or y is None:
            return None
        score, i, j, p, q = local(x, y, scores)
        return {"score": round(score), "start_a": i, "start_b": j, "a": p, "b": q}

    return run(a, b)
