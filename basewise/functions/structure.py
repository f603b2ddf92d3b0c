"""RNA secondary structures in dot-bracket notation: pairs, helices, pseudoknots, comparison."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Opening and closing signs, and the pairs that bases form with their hydrogen bonds.
OPEN = "([{<" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLOSE = ")]}>" + "abcdefghijklmnopqrstuvwxyz"
BONDS = {"AU": 2, "UA": 2, "GC": 3, "CG": 3, "GU": 2, "UG": 2}


def pairs(db: str) -> list[tuple[int, int]] | None:
    """Base pairs (from 0) by first position; None for text that is no balanced dot-bracket."""
    stacks: dict[str, list[int]] = {}
    out = []
    for i, c in enumerate(db):
        if c in OPEN:
            stacks.setdefault(c, []).append(i)
        elif c in CLOSE:
            stack = stacks.get(OPEN[CLOSE.index(c)])
            if not stack:
                return None
            out.append((stack.pop(), i))
        elif c != ".":
            return None
    return None if any(stacks.values()) else sorted(out)


def fixed(db: str) -> str:
    """db without signs that have no partner."""
    stacks: dict[str, list[int]] = {}
    out = [c if c in OPEN or c in CLOSE else "." for c in db]
    for i, c in enumerate(db):
        if c in OPEN:
            stacks.setdefault(c, []).append(i)
        elif c in CLOSE:
            stack = stacks.get(OPEN[CLOSE.index(c)])
            if stack:
                stack.pop()
            else:
                out[i] = "."
    for stack in stacks.values():
        for i in stack:
            out[i] = "."
    return "".join(out)


def crosses(a: tuple[int, int], b: tuple[int, int]) -> bool:
    return a[0] < b[0] < a[1] < b[1] or b[0] < a[0] < b[1] < a[1]


def stems(found: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of stacked pairs (i, j), (i + 1, j - 1), ..., outermost first."""
    known, out = set(found), []
    for p in sorted(found):
        if (p[0] - 1, p[1] + 1) in known:
            continue
        run = [p]
        while (nxt := (run[-1][0] + 1, run[-1][1] - 1)) in known:
            run.append(nxt)
        out.append(run)
    return out


def write(length: int, found: list[tuple[int, int]]) -> str:
    """Dot-bracket of pairs; each stem gets the first kind of brackets that no crossing stem has."""
    out, levels = ["."] * length, []
    for run in stems(found):
        level = next(k for k in range(len(OPEN)) if not any(v == k and crosses(s[0], run[0]) for s, v in levels))
        levels.append((run, level))
        for i, j in run:
            out[i], out[j] = OPEN[level], CLOSE[level]
    return "".join(out)


def helices(db: str, lonely: bool = True) -> list[dict]:
    """Stems with their ends, bases and parents (the helices that enclose them), plain ones and those of a pseudoknot apart."""
    out = []
    for run in stems(pairs(db) or []):
        if len(run) > 1 or lonely:
            out.append({"start5": run[0][0], "end5": run[-1][0], "end3": run[-1][1], "start3": run[0][1], "bases5": [p[0] for p in run], "bases3": [p[1] for p in run], "knot": db[run[0][0]] != "("})
    for kind in (False, True):
        group = sorted((h for h in out if h["knot"] == kind), key=lambda h: h["start5"])
        for k, h in enumerate(group):
            h["parents"] = [i for i, g in enumerate(group[:k]) if g["start5"] <= h["start3"] and h["start5"] <= g["start3"]]
    return out


def without_lonely(db: str) -> str:
    out = list(db)
    for run in stems(pairs(db) or []):
        if len(run) == 1:
            out[run[0][0]] = out[run[0][1]] = "."
    return "".join(out)


def canonical(sequence: str, found: list[tuple[int, int]], wobble: bool = True) -> list[tuple[int, int]]:
    s = sequence.upper().replace("T", "U")
    return [(i, j) for i, j in found if (b := s[i] + s[j]) in BONDS and (wobble or b not in ("GU", "UG"))]


def without_knots(sequence: str, found: list[tuple[int, int]], scores: dict[tuple[int, int], float] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(kept, taken out): the stems that don't cross with the highest total score (hydrogen bonds unless scores are given).

    Only stems that cross some other are weighed; each group of them is searched whole, by branch and bound."""
    runs = stems(found)
    s = sequence.upper().replace("T", "U")
    weight = [sum(scores.get(p, 0.0) if scores is not None else BONDS.get(s[p[0]] + s[p[1]], 0) for p in r) for r in runs]
    against = [{j for j, b in enumerate(runs) if j != i and crosses(a[0], b[0])} for i, a in enumerate(runs)]
    kept, seen = {i for i, c in enumerate(against) if not c}, set()
    for i in range(len(runs)):
        if i in kept or i in seen:
            continue
        group, todo = [], [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                group.append(k)
                todo += against[k] - seen
        group.sort(key=lambda k: (-weight[k], k))
        best: tuple[float, list[int]] = (-1.0, [])
        rest = [sum(weight[k] for k in group[n:]) for n in range(len(group) + 1)]
        stack = [(0, 0.0, [])]
        while stack:
            n, value, chosen = stack.pop()
            if value > best[0]:
                best = (value, chosen)
            if n < len(group) and value + rest[n] > best[0]:
                stack.append((n + 1, value, chosen))
                if not against[group[n]] & set(chosen):
                    stack.append((n + 1, value + weight[group[n]], [*chosen, group[n]]))
        kept |= set(best[1])
    return sorted(p for i in kept for p in runs[i]), sorted(p for i, r in enumerate(runs) if i not in kept for p in r)


def structure(sequence: str, db: str, wobble: bool = True, lonely: bool = False, knots: bool = True) -> str:
    """db with canonical pairs only, pseudoknots marked as such (or left out), lonely pairs left out unless wanted."""
    kept, taken = without_knots(sequence, canonical(sequence, pairs(db) or [], wobble))
    out = write(len(db), kept)
    if knots and taken:
        signs = write(len(db), taken)
        extra = str.maketrans(OPEN + CLOSE, OPEN[1:] + "Z" + CLOSE[1:] + "z")
        out = "".join(a if b == "." else b for a, b in zip(out, signs.translate(extra), strict=True))
    return out if lonely else without_lonely(out)


def common(reference: list[tuple[int, int]], predicted: list[tuple[int, int]], relaxed: bool = False) -> int:
    """Predicted pairs that are in the reference; relaxed: or that have one end off by one, each reference pair used once, in order of the predicted."""
    if not relaxed:
        return len(set(reference) & set(predicted))
    left, n = set(reference), 0
    for i, j in sorted(predicted):
        for p in ((i, j), (i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if p in left:
                left.remove(p)
                n += 1
                break
    return n


def compare(reference: str, predicted: str, relaxed: bool = False) -> dict[str, float] | None:
    """ppv, sensitivity, fmi, mfmi and distance of two structures; None if they can't be compared."""
    a, b = pairs(reference), pairs(predicted)
    if a is None or b is None or len(reference) != len(predicted) or not reference:
        return None
    n = common(a, b, relaxed)
    fmi = n / math.sqrt(len(a) * len(b)) if a and b else 0.0
    open_ = sum(x == y == "." for x, y in zip(reference, predicted, strict=True))
    share = open_ / len(reference)
    return {"ppv": n / len(b) if b else 0.0, "sensitivity": n / len(a) if a else 0.0, "fmi": fmi, "mfmi": share + (1 - share) * fmi, "distance": float(len(reference) - 2 * common(a, b) - open_)}


def pseudo_energy(db: str, values: list[float | None], slope: float = 1.8, intercept: float = -0.6) -> float:
    """Sum of slope ln(r + 1) + intercept over paired bases with a value: once at the ends of a stem, twice inside it."""
    total = 0.0
    for run in stems(pairs(db) or []):
        for k, p in enumerate(run):
            times = 1 if k in (0, len(run) - 1) else 2
            total += sum(times * (slope * math.log(values[i] + 1) + intercept) for i in p if values[i] is not None and values[i] >= 0)
    return total


def constraint(length: int, probabilities: dict[tuple[int, int], float], least: float = 0.5) -> str:
    """Dot-bracket of the likely pairs; of pairs that share a base the likelier stays."""
    chosen, used = [], set()
    for (i, j), p in sorted(probabilities.items(), key=lambda x: (-x[1], x[0])):
        if p > least and not {i, j} & used:
            chosen.append((i, j))
            used |= {i, j}
    return write(length, chosen)


def all_crossing(found: list[tuple[int, int]]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    return [(a, b) for a, b in combinations(sorted(found), 2) if crosses(a, b)]


# -- columns -----------------------------------------------------------------------------------------

#: The types are written out, as a worker that imports this module can't parse their names.
PAIR_LIST = ArrayType(StructType([StructField("i", IntegerType()), StructField("j", IntegerType())]))
METRICS = StructType([StructField(c, DoubleType()) for c in ("ppv", "sensitivity", "fmi", "mfmi", "distance")])


@F.udf(PAIR_LIST, useArrow=True)
def _pairs(db: str):
    found = None if db is None else pairs(db)
    return None if found is None else [{"i": i, "j": j} for i, j in found]


def list_pairs(db: Column) -> Column:
    return _pairs(db)


def is_dot_bracket(db: Column) -> Column:
    return db.rlike(r"^[.()\[\]{}<>A-Za-z]+$")


def is_balanced(db: Column) -> Column:
    return is_dot_bracket(db) & _pairs(db).isNotNull()


@F.udf(StringType(), useArrow=True)
def _structure(sequence: str, db: str, lonely: bool, knots: bool):
    return None if sequence is None or db is None or pairs(db) is None or len(sequence) != len(db) else structure(sequence, db, lonely=lonely, knots=knots)


def cleaned(sequence: Column, db: Column, lonely: bool = False, knots: bool = True) -> Column:
    return _structure(sequence, db, F.lit(lonely), F.lit(knots))


@F.udf(METRICS, useArrow=True)
def _compare(reference: str, predicted: str, relaxed: bool):
    return None if reference is None or predicted is None else compare(reference, predicted, relaxed)


def compared(reference: Column, predicted: Column, relaxed: bool = False) -> Column:
    return _compare(reference, predicted, F.lit(relaxed))


def pair_metrics(reference: DataFrame, predicted: DataFrame, lengths: DataFrame) -> DataFrame:
    """Strict comparison on pair tables (id, i, j): one aggregation over their union, without Python. lengths: id, length."""
    both = reference.select("id", "i", "j", F.lit(1).alias("r"), F.lit(0).alias("p")).unionByName(predicted.select("id", "i", "j", F.lit(0).alias("r"), F.lit(1).alias("p")))
    each = both.groupBy("id", "i", "j").agg(F.max("r").alias("r"), F.max("p").alias("p"))
    n = each.groupBy("id").agg(F.sum(F.col("r") * F.col("p")).alias("c"), F.sum("r").alias("nr"), F.sum("p").alias("np"))
    bases = each.select("id", F.explode(F.array("i", "j")).alias("b")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("bases"))
    got = n.join(bases, "id").join(lengths, "id")

    def share(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(x, y), F.lit(0.0))

    fmi = share(F.col("c"), F.sqrt(F.col("nr") * F.col("np")))
    open_ = (F.col("length") - F.col("bases")) / F.col("length")
    return got.select("id", share(F.col("c"), F.col("np")).alias("ppv"), share(F.col("c"), F.col("nr")).alias("sensitivity"), fmi.alias("fmi"), (open_ + (1 - open_) * fmi).alias("mfmi"))


def pair_distance(a: Column, b: Column) -> Column:
    """Bases that the two structures don't treat alike: paired in either, but not in a pair that both have."""

    def bases(p: Column) -> Column:
        return F.flatten(F.transform(p, lambda x: F.array(x["i"], x["j"])))

    p, q = _pairs(a), _pairs(b)
    return F.size(F.array_union(bases(p), bases(q))) - 2 * F.size(F.array_intersect(p, q))
