"""Functions and operators on hand-made cases and against plain versions."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise.functions import math as M
from basewise.functions import sequence as Q
from basewise.functions import stats as T
from basewise.functions import structure as R
from basewise.operators import clustering, deconvolution, graph, intervals, kmers, normalise, pileup, reads, windows
from basewise.plans import pipelines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def values(spark, xs, value="raw"):
    return spark.createDataFrame([(1, i, "ACGT"[i % 4], None if x is None else float(x)) for i, x in enumerate(xs)], f"id int, pos int, base string, {value} double")


# -- statistics ---------------------------------------------------------------------------------------


def test_special_functions():
    assert T.pnorm(1.96) == pytest.approx(0.9750021048517795) and T.qnorm(0.3) == pytest.approx(-0.5244005127080407)
    assert T.dnorm(1, 1, 2) == pytest.approx(0.19947114020071635) and list(T.qnorm([0, 1])) == [-np.inf, np.inf]
    assert T.beta_inc(2, 3, 0.5) == pytest.approx(0.6875) and T.beta_inc(0.5, 5, 0.01) == pytest.approx(1 - T.beta_inc(5, 0.5, 0.99))
    assert T.gamma_q(3, 2) == pytest.approx(0.6766764161830634) and T.gamma_q(3, 8) == pytest.approx(0.013753967744002971)
    assert T.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05) and T.student_p(2.0, 10) == pytest.approx(0.07338803477074)
    assert T.correlation_p(0.5, 2) == 1 and T.correlation_p(0.632, 10) == pytest.approx(0.0499, abs=2e-4) and T.correlation_p(float("nan"), 10) == 1


def test_exact_tests():
    assert T.fisher(3, 1, 1, 3) == pytest.approx(17 / 70) and T.fisher(1, 3, 3, 1) == pytest.approx(17 / 70)
    assert T.fisher(3, 1, 1, 3, two_sided=True) == pytest.approx(34 / 70) and T.fisher(0, 0, 5, 5) == 1
    assert T.binomial(2, 10) == pytest.approx(0.109375) and T.binomial(8, 10, alternative="greater") == pytest.approx(0.0546875) and T.binomial(0, 5, 0.0) == pytest.approx(1)
    assert T.chi_square(10, 20, 30, 5) == pytest.approx(T.chi_square_p(65 * (550 - 32.5) ** 2 / (30 * 35 * 40 * 25), 1)) and T.chi_square(0, 0, 1, 2) == 1


def test_adjusting(spark):
    df = spark.createDataFrame([(x,) for x in (0.01, 0.03, 0.04, 0.5, None)], "p double")
    got = {r["p"]: r["padj"] for r in T.adjusted(df, "p").collect()}
    assert [round(got[p], 4) for p in (0.01, 0.03, 0.04, 0.5)] == [0.04, 0.0533, 0.0533, 0.5] and got[None] is None
    running = {r["p"]: r["padj"] for r in T.adjusted(df, "p", running=True).collect()}
    assert [round(running[p], 4) for p in (0.01, 0.03, 0.04, 0.5)] == [0.04, 0.06, 0.06, 0.5]
    same = T.adjusted(spark.createDataFrame([(0.02,)] * 3, "p double"), "p").collect()
    assert all(r["padj"] == pytest.approx(0.02) for r in same)


def test_combining(spark):
    df = spark.createDataFrame([(0.05, 1), (0.1, 1), (0.0, 2)], "p double, g int")
    got = {r["g"]: r["p"] for r in T.combine(df, ["g"], "p").collect()}
    assert got[1] == pytest.approx(float(T.pnorm((T.qnorm(0.05) + T.qnorm(0.1)) / math.sqrt(2)))) and got[2] < 1e-300
    f = {r["g"]: r["p"] for r in T.combine(df, ["g"], "p", "F").collect()}
    assert f[1] == pytest.approx(float(T.chi_square_p(-2 * (math.log(0.05) + math.log(0.1)), 4)))


def test_paired_tests(spark):
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in [(1, 2), (3, 3), (5, 1), (6, 2), (9, 4)]], "k int, a double, b double")
    r = T.signed_rank(df, ["k"], "a", "b").first()
    assert (r["v"], round(r["z"], 4)) == (9.0, round((4 - 0.5) / math.sqrt(4 * 5 * 9 / 24 - 6 / 48), 4))
    w = T.welch(df, ["k"], None, "a", "b").first()
    d = np.array([-1, 0, 4, 4, 5])
    assert w["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(5))) and w["df"] == 4


# -- normalising --------------------------------------------------------------------------------------


def plain(method, xs):
    n = len(xs)
    if n < 10:
        return None
    half_up = lambda x: math.floor(x + 0.5)
    down, up = sorted(xs, reverse=True), sorted(xs)
    if method == "2-8":
        f = np.mean(down[max(1, half_up(n * 0.02) - 1) : max(1, half_up(n * 0.1) - 1) + 1])
        return [max(0, x / f) for x in xs] if f else None
    if method == "winsor":
        a, b = np.quantile(xs, 0.05), np.quantile(xs, 0.95)
        return [min(max(x, a) / b, 1) for x in xs] if b else None
    if method == "boxplot":
        q1, q3 = np.quantile(xs, 0.25), np.quantile(xs, 0.75)
        out = half_up(n * 0.02) if n < 50 else sum(x > q3 + 1.5 * (q3 - q1) for x in xs)
        f = np.mean(down[max(1, out) :][: 10 if 50 <= n < 100 else half_up(n * 0.1)])
        return [max(0, x / f) for x in xs] if f else None
    f = np.mean(up[max(1, half_up(n * 0.9) - 1) : max(1, half_up(n * 0.95) - 1) + 1])
    high = [x for x in up if x > 0.001]
    f = max(f, high[max(1, half_up(len(high) * 0.75) - 1)]) if len(high) > 1 else f
    return [max(0, x / f) for x in xs] if f else None


@pytest.mark.parametrize("method", normalise.METHODS)
@pytest.mark.parametrize("n", [9, 10, 49, 50, 99, 100])
def test_normalisers(spark, method, n):
    rng = random.Random(n)
    xs = [rng.choice([0, 0.5, rng.random() * 3]) for _ in range(n)]
    df = values(spark, [*xs, None])
    got = [r["norm"] for r in normalise.normalise(df, method).orderBy("pos").collect()]
    want = plain(method, xs)
    assert got[-1] is None and (got[:-1] == [None] * n if want is None else np.allclose(got[:-1], want))


def test_all_zero_and_equal(spark):
    for method in normalise.METHODS:
        assert {r["norm"] for r in normalise.normalise(values(spark, [0] * 20), method).collect()} == {None}
    assert {r["norm"] for r in normalise.normalise(values(spark, [2] * 20), "2-8").collect()} == {1.0}
    with pytest.raises(ValueError):
        normalise.check("Ding", "mitchell")


def test_windows_shorter_than_a_transcript(spark):
    df = values(spark, [i % 5 for i in range(25)])
    whole = {r["pos"]: r["norm"] for r in normalise.normalise(df, "2-8").collect()}
    for size in (25, 40):
        assert {r["pos"]: r["norm"] for r in normalise.sliding(df, "2-8", size, 10).collect()} == whole
    assert len(normalise.sliding(df, "2-8", 12, 5).collect()) == 25


def test_remap(spark):
    got = [one(spark, normalise.remap(F.lit(x), F.lit(2.0))) for x in (0.0, 0.25, 0.3, 0.7, 2.0, 0.125)]
    assert got == pytest.approx([0, 0.35, 0.55, 0.85, 1, 0.175])


# -- sequences ----------------------------------------------------------------------------------------


def test_sequences(spark):
    s = F.lit
    assert one(spark, Q.reverse_complement(s("ACGTRYSWKMBDHVN"))) == "NBDHVKMWSRYACGT" and one(spark, Q.reverse_complement(s("ACGU"), True)) == "ACGU"
    assert one(spark, Q.translate(s("ATGATAUGATAAGG"))) == "MI**"
    assert one(spark, Q.translate(s("ATGATATGANNN"), 2)) == "MMWX" and one(spark, Q.three_letters(s("MK*"))) == "Met-Lys-Stp"
    assert Q.genetic_code()["ATC"] == "I" and Q.iupac_regex("ARU") == "A[AG]T"
    assert one(spark, Q.hamming(s("ACGT"), s("AGGA"))) == 2 and one(spark, Q.hamming(s("A"), s("AA"))) is None
    assert one(spark, Q.longest_orf(s("CCATGAAATAGATGTAA"))) == "ATGAAATAG" and one(spark, Q.longest_orf(s("ATGAAA"))) is None
    assert one(spark, Q.longest_orf(s("ATGTAACTGTGA"), any_start=True)) == "ATGTAA"
    assert one(spark, Q.extract(s("ACGT"), s(2), s(3))) == "CG" and one(spark, Q.extract(s("ACGT"), s(0), s(3))) is None
    assert one(spark, Q.hard_masked(s("ACgtN"))) == "ACNNN" and one(spark, Q.windows(s("ACGT"), 3)) == ["ACG", "CGT"] and one(spark, Q.windows(s("A"), 3)) == []


def test_dinucleotide_shuffles():
    rng = random.Random(1)
    for k in range(200):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40)))
        t = Q.dinucleotide_shuffle(s, k)
        assert sorted(zip(s, s[1:], strict=False)) == sorted(zip(t, t[1:], strict=False)) and t[:1] == s[:1] and t[-1:] == s[-1:]


def test_math(spark):
    xs = F.array(*(F.lit(float(x)) for x in (3, 1, 2, 2)))
    assert [one(spark, f(xs)) for f in (M.median, M.mean, M.midrange, M.total, M.product)] == [2, 2, 2, 8, 12]
    assert one(spark, M.geometric_mean(xs)) == pytest.approx(12**0.25) and one(spark, M.variance(F.array(F.lit(5.0)))) == 0
    assert one(spark, M.places(xs, F.array_max)) == [0] and one(spark, M.places(F.array(F.lit(1), F.lit(1)), F.array_min)) == [0, 1]
    assert one(spark, M.half_up(F.lit(-2.5))) == -2 and one(spark, M.half_up(F.lit(2.5))) == 3 and one(spark, M.nearest_multiple(F.lit(7.5), 5)) == 10
    assert one(spark, M.logarithm(F.lit(8.0), 2)) == 3 and one(spark, M.logarithm(F.lit(0.0), 2)) == math.inf and one(spark, M.logarithm(F.lit(-1.0), 2)) is None
    assert one(spark, M.gini(F.array(F.lit(1.0), F.lit(1.0)))) == 0 and one(spark, M.gini(F.array(F.lit(0.0), F.lit(4.0)))) == 0.5
    assert one(spark, M.is_number(F.lit("1e3"))) and not one(spark, M.is_number(F.lit("inf"))) and not one(spark, M.is_number(F.lit("x")))


# -- structures ---------------------------------------------------------------------------------------


def test_pairs():
    assert R.pairs("((..[[)).]]") == [(0, 7), (1, 6), (4, 10), (5, 9)] and R.pairs("(()") is None and R.pairs("x)") is None and R.pairs("") == [] and R.pairs("(-)") is None
    assert R.fixed("(()].x") == ".()..." and R.without_lonely("(.((..)).)") == "..((..)).." and R.write(11, R.pairs("((..[[)).]]")) == "((..[[)).]]"


def test_helices():
    h = R.helices("((..((..)).((..))..))")
    assert [(x["start5"], x["parents"]) for x in h] == [(0, []), (4, [0]), (11, [0])]
    assert [x["knot"] for x in R.helices("((.[[.)).]]")] == [False, True] and R.helices("(..)", lonely=False) == []


def test_pseudoknots():
    rng = random.Random(2)
    for _ in range(200):
        found, used = [], set()
        for _ in range(6):
            i, j = sorted(rng.sample(range(30), 2))
            if j - i > 2 and not {i, j} & used:
                found.append((i, j))
                used |= {i, j}
        s = "".join(rng.choice("ACGU") for _ in range(30))
        kept, out = R.without_knots(s, found, {p: float(n + 1) for n, p in enumerate(found)})
        assert sorted(kept + out) == sorted(found) and not R.all_crossing(kept)
        weights = {tuple(r): sum(found.index(p) + 1 for p in r) for r in R.stems(found)}
        best = max(sum(weights[tuple(r)] for r in c) for n in range(len(weights) + 1) for c in combinations(R.stems(found), n) if not R.all_crossing([p for r in c for p in r]))
        assert sum(found.index(p) + 1 for p in kept) == best
    assert R.structure("GGAAAACCAAGC", "(([[..))..]]", lonely=True).startswith("((") and R.structure("GAAAC", "(...)", lonely=True) == "(...)" and R.structure("GAAAC", "(...)") == "....."


def test_comparison(spark):
    assert R.compare("((..))", "((..))") == {"ppv": 1, "sensitivity": 1, "fmi": 1, "mfmi": 1, "distance": 0}
    assert R.compare("((....))", ".((..)).", relaxed=False)["fmi"] == pytest.approx(0.5)
    assert R.compare("(....)", ".(..).", relaxed=True)["ppv"] == 0 and R.compare("(....)", "(...).", relaxed=True)["ppv"] == 1
    assert R.compare("(.)", "(..)") is None and R.compare("...", "(.)")["fmi"] == 0
    a = spark.createDataFrame([("x", "GGAACC", "((..))"), ("y", "GG", ".."), ("z", "AC", ".."), ("w", "AA", "..")], "id string, sequence string, structure string")
    b = spark.createDataFrame([("x", "GGAACC", "((..))"), ("y", "GC", ".."), ("w", "AA", "((")], "id string, sequence string, structure string")
    assert {r["id"]: r["status"] for r in pipelines.compare_structures(a, b).collect()} == {"x": "ok", "y": "sequence", "z": "missing", "w": "structure"}


def test_energy_and_constraints():
    assert R.pseudo_energy("(((...)))", [1.0] * 9) == pytest.approx((2 + 2 + 4) * (1.8 * math.log(2) - 0.6)) and R.pseudo_energy("...", [1.0] * 3) == 0
    assert R.constraint(6, {(0, 5): 0.9, (1, 5): 0.95, (2, 4): 0.4}) == ".(...)"


# -- reads --------------------------------------------------------------------------------------------


def test_cigar(spark):
    c = one(spark, reads.cigar(F.lit("2H3S5M1D2I4M7N3M2S")))
    assert (c["clip5"], c["clip3"], c["span"], c["length"], c["insertions"]) == (5, 2, 13, 14, [5])
    assert one(spark, reads.edit_distance(F.lit("3A2^NNC1^NN5G"), F.lit(1))) == 4
    b = one(spark, pileup.blocks(F.lit(10), F.lit("3S4M2D3M10N5M1I2M")))
    assert [tuple(x) for x in b] == [(10, 18), (29, 35)]


def test_mutations():
    ref = "ACGTACGTAAAACC"
    assert reads.mutations(0, "4M", "1C2", "ATGT", [30] * 4, ref) == [(1, "CT", True)]
    assert reads.mutations(0, "4M", "1C2", "ATGT", [30, 10, 30, 30], ref) == [(1, "CT", False)]
    assert reads.mutations(0, "4M", "1C2", "ATGT", [10, 30, 30, 30], ref, reads.Rules(around=True)) == [(1, "CT", False)]
    assert reads.mutations(0, "4M", "1C2", "ANGT", [30] * 4, ref) == []
    gap = lambda **k: reads.mutations(6, "3M1D3M", "3^A3", "GTAAAC", [30] * 6, ref, reads.Rules(**k))
    assert gap() == [(11, "del", True)] and gap(left_align=True) == [(8, "del", True)] and gap(ambiguous=False) == [] and gap(deletions=False) == []
    two = reads.mutations(0, "2M2D2M", "2^GT2", "ACAC", [30] * 4, "ACGTACTT", reads.Rules(ambiguous=False))
    assert two in ([], [(2, "del", True), (3, "del", True)])
    assert reads.only_classes("A2T;C>N") == {"AT", "CA", "CG", "CT"} and reads.clip_limits("5p3,3p4") == (3, 4, None) and reads.clip_limits("7") == (None, None, 7)
    assert reads.mutations(0, "2S2M", "0A1", "GGTC", [30] * 4, ref) == [(0, "AT", True)]


def test_slides_keep_the_sequence():
    rng = random.Random(3)
    for _ in range(300):
        ref = "".join(rng.choice("AC") for _ in range(25))
        size, at = rng.randint(1, 4), rng.randint(0, 20)
        low, high = reads.slides(ref, at, size)
        gone = ref[:at] + ref[at + size :]
        assert all(ref[:p] + ref[p + size :] == gone for p in range(low, high + 1)) and low <= at <= high


def test_counting_from_alignments(spark, tmp_path):
    from basewise.sources import text

    rows = ["r1\t0\tt\t1\t30\t8M\t*\t0\t0\tACGTTCGT\tIIIIIIII\tMD:Z:4A3", "r2\t0\tt\t3\t30\t6M\t*\t0\t0\tGTTCGT\tIIIIII\tMD:Z:2A3", "r3\t256\tt\t1\t30\t8M\t*\t0\t0\tACGTACGT\tIIIIIIII\tMD:Z:8", "r4\t1024\tt\t1\t30\t8M\t*\t0\t0\tACGTACGT\tIIIIIIII\tMD:Z:8", "r5\t0\tt\t1\t30\t8M\t*\t0\t0\tTTTTTTTT\tIIIIIIII\tMD:Z:0A0C0G1A0C0G1"]
    (tmp_path / "x.sam").write_text("\n".join(rows) + "\n")
    ref = spark.createDataFrame([("t", "ACGTACGTAA")], "id string, sequence string")
    got = {r["pos"]: (r["count"], r["coverage"]) for r in pipelines.count_mutations(text.sam(spark, str(tmp_path / "x.sam")), ref, most_edits=0.2).collect()}
    assert got[4] == (2, 3) and got[0] == (0, 2) and got[2] == (0, 3) and max(got) == 7


def test_coverage_by_bins(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 2), a := rng.randint(0, 300), a + rng.randint(0, 90)) for _ in range(200)]
    want = {}
    for i, a, b in rows:
        for p in range(a, b + 1):
            want[i, p] = want.get((i, p), 0) + 1
    df = spark.createDataFrame(rows, "id int, start int, end int")
    for size in (1, 16, 1000):
        assert {(r["id"], r["pos"]): r["coverage"] for r in pileup.coverage(df, bin_size=size).collect()} == want


def test_collapsing(spark):
    m = F.array(*(F.lit(x) for x in (1, 3, 5, 9, 10, 20)))
    assert one(spark, pileup.collapsed(m)) == [5, 10, 20] and one(spark, pileup.isolated(m)) == [20]


# -- intervals, windows, graphs -------------------------------------------------------------------------


def test_intervals(spark):
    rows = [(1, 0, 5), (1, 5, 9), (1, 12, 13), (1, 1, 2), (2, 14, 15)]
    df = spark.createDataFrame(rows, "id int, start int, end int")
    assert sorted((r["id"], r["start"], r["end"], r["n"]) for r in intervals.merged(df, ["id"]).collect()) == [(1, 0, 9, 3), (1, 12, 13, 1), (2, 14, 15, 1)]
    assert intervals.merged(df, ["id"], distance=3).count() == 2 and intervals.merged(df, ["id"], distance=2).count() == 3
    other = df.toDF("id", "start2", "end2")
    for size in (1, 3, 100):
        want = sum(a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2] for a in rows for b in rows)
        assert intervals.overlapping(df, other, ["id"], size).count() == want
    points = spark.createDataFrame([(1, p) for p in range(16)], "id int, pos int")
    assert sorted(r["pos"] for r in intervals.outside(points, df, ["id"], "pos", 4).collect()) == [10, 11, 14, 15]


def test_peaks_and_refinement(spark):
    rows = [(1, i, 500 if 40 <= i <= 60 else 40, 50) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, pos int, t_coverage int, u_coverage int")
    got = pipelines.call_peaks(df, 10, 5, 2.0, 0.05, 5).collect()
    assert len(got) == 1 and got[0]["start"] <= 45 and got[0]["end"] >= 55 and (got[0]["summit_start"], got[0]["summit_end"]) == (max(40, got[0]["start"]), min(60, got[0]["end"]))
    fine = pipelines.call_peaks(df, 10, 5, 2.0, 0.05, 5, refine=True).collect()
    assert (fine[0]["start"], fine[0]["end"]) == (40, 60)
    alone = pipelines.call_peaks(df.drop("u_coverage"), 10, 5, 2.0, 0.05, 5).collect()
    assert len(alone) == 1


def test_window_ends(spark):
    df = spark.createDataFrame([(1, i) for i in range(23)], "id int, pos int")
    got = sorted((r["start"], r["end"]) for r in windows.starts(df, 10, 5).collect())
    assert got == [(0, 10), (5, 15), (10, 20), (12, 22), (12, 22)]
    assert [(r["start"], r["end"]) for r in windows.starts(df.where("pos < 5"), 10, 5).collect()] == [(0, 4)]


def test_graph(spark):
    edges = [(1, 2), (2, 3), (9, 8), *((100 + i, 101 + i) for i in range(25))]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got[3] == 1 and got[9] == 8 and got[125] == 100


def test_motifs(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(30)) + "GGACT" + "".join(rng.choice("ACGT") for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, sequence string")
    other = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(65))) for i in range(200)], "id int, sequence string")
    found = pipelines.find_motifs(df, other, k=5, motifs=1, p=1e-6)
    assert "GGACT" in found[0]["kmers"] and len(found[0]["consensus"]) == 5
    assert kmers.neighbours(spark.createDataFrame([("AAA",), ("AAC",), ("ACC",)], "kmer string")).count() == 2
    shuffles = kmers.negatives(df.limit(2), 3).collect()
    assert len(shuffles) == 6 and all(len(r["sequence"]) == 65 for r in shuffles)


# -- conformations and clusters -------------------------------------------------------------------------


def test_assignment():
    rng = np.random.Generator(np.random.PCG64(6))
    for n in (1, 2, 3, 5, 6):
        for _ in range(40):
            scores = rng.normal(size=(n, n))
            assert deconvolution.assign(scores)[1] == pytest.approx(deconvolution.assign_whole(scores)[1])
            assert sorted(deconvolution.assign(scores)[0]) == list(range(n))


def window(start, rates, coverage=100, stoichiometries=None):
    n = len(rates[0])
    return {"file": "f", "id": "t", "start": start, "end": start + n - 1, "stoichiometries": stoichiometries or [1 / len(rates)] * len(rates), "counts": [[int(coverage * r) for r in x] for x in rates], "coverage": [[coverage] * n for _ in rates]}


def test_merging_windows(spark):
    a, b = [0.1, 0.9, 0.2, 0.8, 0.1, 0.5], [0.7, 0.1, 0.6, 0.1, 0.9, 0.0]
    wins = [window(0, [a, b], stoichiometries=[0.3, 0.7]), window(1, [b[1:] + [0.4], a[1:] + [0.3]], stoichiometries=[0.6, 0.4]), window(50, [a]), window(55, [a]), window(90, [a, b])]
    got = deconvolution.merge(wins)
    assert [(w["start"], w["end"], len(w["counts"])) for w in got] == [(0, 6, 2), (50, 60, 1), (90, 95, 2)]
    assert got[0]["coverage"][0] == [100, 200, 200, 200, 200, 200, 100] and got[0]["stoichiometries"] == pytest.approx([0.35, 0.65])
    df = spark.createDataFrame(wins, deconvolution.COLUMNS)
    assert deconvolution.merged_windows(df).count() == 3
    t = deconvolution.trimmed(df, 2).where("start = 2").first()
    assert t["end"] == 3 and len(t["counts"][0]) == 2
    e = deconvolution.extended(df, 2).where("start = 0").first()
    assert e["end"] == 7 and e["counts"][0][-2:] == [0, 0] and len(e["counts"][0]) == 8
    e = deconvolution.extended(df, 2).where("end = 57").first()
    assert e["start"] == 48 and len(e["counts"][0]) == 10
    assert deconvolution.match([[wins[0]], [wins[1], wins[4]]])[0][1] is wins[1] and deconvolution.match([[wins[2]], [wins[0]]]) == []


def test_kmeans():
    rng = random.Random(7)
    points = [(rng.gauss(c, 0.3), rng.gauss(c, 0.3)) for c in (0, 5, 10) for _ in range(20)]
    k, labels = clustering.best_k(points, 5, seed=1)
    assert k == 3 and all(len(set(labels[i : i + 20])) == 1 for i in (0, 20, 40))


def test_chimera_clusters(spark):
    rng = random.Random(8)
    rows = [("t", s + (d := rng.randint(-3, 3)), s + 25 + d, e + d, e + 25 + d) for s, e in ((100, 300), (500, 900)) for _ in range(30)]
    rng.shuffle(rows)
    got = clustering.clustered(spark.createDataFrame(rows, "id string, start1 int, end1 int, start2 int, end2 int")).collect()
    groups = {c: {r["start1"] < 300 for r in got if (r["island"], r["cluster"]) == c} for c in {(r["island"], r["cluster"]) for r in got}}
    assert len(groups) == 2 and all(len(g) == 1 for g in groups.values())
    assert clustering.chimera_centroid([(0, 9, 50, 59), (1, 10, 51, 60), (2, 11, 52, 61)]) == (1, 10, 51, 60)
    assert clustering.chimera_distance((0, 9, 50, 59), (0, 9, 70, 79)) == clustering.FAR
