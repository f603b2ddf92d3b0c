"""Alignment, structure elements, chimeras and texts against plain versions."""

from __future__ import annotations

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from basewise.functions import align, structure, text
from basewise.functions import sequence as Q
from basewise.operators import chimeras, clustering, elements


def plain_local(a, b, s):
    """The best score of all local alignments, by recursion over what both end in."""

    @lru_cache(None)
    def best(i, j, kind):
        if not i or not j and kind != 1:
            return float("-inf")
        if kind == 0:
            return s.of(a[i - 1], b[j - 1]) + max(0.0, *(best(i - 1, j - 1, k) for k in range(3)))
        if kind == 1:
            return max(best(i - 1, j, k) + (s.extend if k == 1 else s.open) for k in range(3))
        return max(best(i, j - 1, k) + (s.extend if k == 2 else s.open) for k in range(3)) if j else float("-inf")

    return max([0.0, *(best(i, j, 0) for i in range(1, len(a) + 1) for j in range(1, len(b) + 1))])


@pytest.mark.parametrize("scores", [align.Scores(), align.Scores(tuple(align.PAIRING.items()), -3, -3, -4, -2), align.Scores(equal=1, other=-2, open=-1, extend=-0.5)])
def test_local_alignment(scores):
    rng = random.Random(3)
    for _ in range(150):
        a, b = ("".join(rng.choice("ACGU") for _ in range(rng.randint(0, 9))) for _ in range(2))
        score, i, j, x, y = align.local(a, b, scores)
        assert score == pytest.approx(plain_local(a, b, scores))
        assert len(x) == len(y) and a[i:].startswith(x.replace("-", "")) and b[j:].startswith(y.replace("-", ""))
        total, last = 0.0, ""
        for p, q in zip(x, y, strict=True):
            gap = "a" if p == "-" else "b" if q == "-" else ""
            total += scores.of(p, q) if not gap else scores.extend if gap == last else scores.open
            last = gap
        assert total == pytest.approx(score)


def test_elements_follow_helices_outward():
    hairpin = "((((....))))"
    assert elements.elements(hairpin, rules=elements.Rules(least=12)) == [(0, 11)]
    assert elements.elements(hairpin, rules=elements.Rules(least=13)) == []
    assert elements.elements(hairpin, rules=elements.Rules(least=4, loop=3)) == []
    # Two hairpins in a multiway junction: the enclosing helix takes both.
    fork = "(((" + "..((((....))))..((((....)))).." + ")))"
    assert elements.elements(fork, rules=elements.Rules(least=10)) == [(0, len(fork) - 1)]
    assert elements.elements(fork, rules=elements.Rules(least=10, most=20)) == [(5, 16), (19, 30)]
    assert elements.elements(fork, rules=elements.Rules(least=10, most=20, multiway=True)) == []
    assert elements.elements(fork, rules=elements.Rules(least=10, multiway=True)) == [(0, len(fork) - 1)]
    assert elements.elements(fork, rules=elements.Rules(least=10, loop=5)) == [(5, 16), (19, 30)]
    assert elements.elements(fork, rules=elements.Rules(least=10, paired=0.65)) == [(5, 16), (19, 30)]
    # Too long at once: left out, or cut from outside.
    assert elements.elements(hairpin, rules=elements.Rules(least=6, most=9)) == []
    assert elements.elements(hairpin, rules=elements.Rules(least=6, most=9, truncate=True)) == [(2, 9)]
    # The second hairpin lies above the median.
    low = [k < 18 for k in range(len(fork))]
    assert elements.elements(fork, [low], elements.Rules(least=10, below=0.7)) == [(5, 16)]
    assert elements.elements(fork, [[None] * len(fork)], elements.Rules(least=10)) == [] and elements.elements("....") == []


def test_elements_of_rows(spark):
    fork = "(((" + "..((((....))))..((((....)))).." + ")))"
    rows = spark.createDataFrame([("t", "ACGU" * 9, fork), ("u", "ACGU" * 9, None), ("v", "A", fork)], "id string, sequence string, structure string")
    profile = spark.createDataFrame([("t", p, -1.0 if p < 18 else None if p % 2 else 1.0) for p in range(36)], "id string, pos int, rolling double")
    flags = elements.below_median(profile, "rolling", "low")
    got = elements.extracted(elements.with_profiles(rows, flags), ("low",), elements.Rules(least=10))
    assert [tuple(r) for r in got.collect()] == [("t", "t_5-16", 5, 16, ("ACGU" * 9)[5:17], fork[5:17])]
    every = elements.extracted(rows, rules=elements.Rules(least=10, most=20))
    assert elements.element_records(every).first()["value"].count(">") == 2 and elements.element_records(every, True).count() == 2
    assert elements.extracted(rows.limit(0)).count() == 0


def test_islands_keep_what_overlaps(spark):
    rng = random.Random(5)
    rows = [(i % 2, s := rng.randint(0, 400), s + rng.randint(0, 12)) for i in range(60)]
    got = clustering.islands(spark.createDataFrame(rows, "id int, a int, b int"), "a", "b", ["id"], "k").collect()
    for x in got:
        for y in got:
            if x["id"] == y["id"] and x["a"] <= y["b"] and y["a"] <= x["b"]:
                assert x["k"] == y["k"]
    for k in (0, 1):
        spans = sorted((x["a"], x["b"]) for x in got if x["id"] == k)
        runs, end = 0, -1
        for a, b in spans:
            runs += a > end
            end = max(end, b)
        assert len({x["k"] for x in got if x["id"] == k}) == runs


def test_chimera_workflow(spark):
    rows = [("t", i, 100 + i % 3, 125 + i % 3, 300 + i % 3, 325 + i % 3) for i in range(30)] + [("t", 30 + i, 100, 125, 900, 925) for i in range(10)] + [("t", 40 + i, 2_000_000, 2_000_025, 3_000_000, 3_000_025) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, read long, start1 int, end1 int, start2 int, end2 int")
    got, clusters = chimeras.workflow(df)
    by = {(r["start1"] // 50, r["start2"] // 50): r for r in clusters.collect()}
    assert got.count() == 45 and sorted(r["reads"] for r in by.values()) == [5, 10, 30]
    assert by[2, 6]["probability"] == pytest.approx(0.75) and by[2, 18]["probability"] == pytest.approx(0.25) and by[40000, 60000]["probability"] == 1
    few = chimeras.sampled(df, "read", 7, ["read"], 3)
    assert few.count() == 7 and few.collect() == chimeras.sampled(df.repartition(5), "read", 7, ["read"], 3).collect()
    lines = spark.createDataFrame([(1, "r1\t0"), (2, "r2\t0")], "read long, value string")
    tags = spark.createDataFrame([(1, 5)], "read long, cluster long")
    assert sorted(r["value"] for r in chimeras.tagged_lines(lines, tags).collect()) == ["r1\t0\tXG:i:5", "r2\t0"]


def test_support_and_bounds(spark):
    clusters = spark.createDataFrame([("t", 1, 10), ("t", 2, 4)], "id string, cluster long, reads long")
    pairs = spark.createDataFrame([("t", 1, 5, 50, 6), ("t", 1, 7, 40, 9), ("t", 1, 2, 60, 5), ("t", 2, 1, 2, 1)], "id string, cluster long, i int, j int, n long")
    good = chimeras.supported(pairs, clusters, ["id", "cluster"])
    assert sorted((r["i"], r["support"]) for r in good.collect()) == [(5, 0.6), (7, 0.9)]
    assert [tuple(r) for r in chimeras.refined(good, clusters, ["id", "cluster"]).collect()] == [("t", 1, 5, 7, 40, 50, 10)]


def test_pair_distance(spark):
    rng = random.Random(6)

    def any_structure(n):
        out = ["."] * n
        for _ in range(4):
            i, j = sorted(rng.sample(range(n), 2))
            if out[i] == out[j] == "." and all(structure.pairs("".join(out)) is not None for _ in (0,)):
                trial = list(out)
                trial[i], trial[j] = "(", ")"
                out = trial
        return "".join(out)

    rows = [(any_structure(14), any_structure(14)) for _ in range(40)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", structure.pair_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        p, q = set(structure.pairs(r["a"])), set(structure.pairs(r["b"]))
        assert r["d"] == 14 - 2 * len(p & q) - sum(x == y == "." for x, y in zip(r["a"], r["b"], strict=True))


def test_sizes_and_durations(spark):
    rows = [(0, "0B", "0s", "0 seconds"), (1023, "1023B", "17m 3s", "17 minutes, 3 seconds"), (1280, "1.2K", "21m 20s", "21 minutes, 20 seconds"), (5 * 1024**5, "5.0P", None, None), (-1, None, None, None), (90_061, "88.0K", "1d 1h 1m 1s", "1 day, 1 hour, 1 minute, 1 second")]
    got = spark.createDataFrame([(r[0],) for r in rows], "n long").select("n", text.human_size(F.col("n")).alias("size"), text.duration(F.col("n")).alias("d"), text.duration(F.col("n"), True).alias("long")).collect()
    for r, want in zip(sorted(got), sorted(rows, key=lambda x: x[0]), strict=True):
        assert r["size"] == want[1] and (want[2] is None or (r["d"], r["long"]) == want[2:])
    sizes = spark.createDataFrame([("12",), ("1.5k",), ("2B",), ("1x",), ("",), ("3P",), (None,)], "t string").select(text.size_in_bytes(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in sizes] == [12, 1536, 2, None, None, 3 * 1024**5, None]
    odd = spark.createDataFrame([("a b*~é/+%",)], "t string").select(text.uri_escaped(F.col("t")).alias("e"), text.uri_plain(text.uri_escaped(F.col("t"))).alias("p"), text.unquoted(F.lit(r"a\.b\\")).alias("u")).first()
    assert odd["e"] == "a%20b%2A~%C3%A9%2F%2B%25" and odd["p"] == "a b*~é/+%" and odd["u"] == "a.b\\"


def test_genetic_codes():
    assert Q.genetic_code(33)["TAA"] == "Y" and Q.genetic_code(25)["TGA"] == "G" and Q.genetic_code(31)["TAG"] == "E" and Q.genetic_code(26)["CTG"] == "A"
    for t in (7, 8, 17, 20, 34):
        with pytest.raises(ValueError):
            Q.genetic_code(t)
    assert len({tuple(Q.genetic_code(t).items()) for t in (1, *range(21, 34))}) == 13  # 27 and 28 differ in context only


def test_chimeras_of_many_islands_pass_in_few_batches(spark):
    """Whole groups, whatever the batches: the same clusters as island by island, and as with every pair of clusters compared."""
    rng = random.Random(9)
    rows = [(t, a := rng.randrange(6000), a + 20, b := a + rng.randrange(5, 400), b + 25) for t in range(6) for _ in range(150)]
    rows += [(7, a := rng.randrange(40), a + 20, b := a + rng.randrange(300, 330), b + 25) for _ in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, clusters = (df.collect() for df in chimeras.workflow(spark.createDataFrame(rows, "id long, start1 long, end1 long, start2 long, end2 long")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    islands = {}
    for r in got:
        islands.setdefault((r["id"], *r["cluster"].split(".")[:2]), []).append(r)
    assert sorted(tuple(r)[:5] for r in got) == sorted(rows) and max(map(len, islands.values())) > 7 and len(islands) > 300
    groups = {}
    for k, found in islands.items():
        points = sorted((tuple(r[1:5]), r["cluster"]) for r in found)
        assert [int(c.split(".")[2]) for _, c in points] == clustering.cluster_chimeras([p for p, _ in points])
        for p, c in points:
            groups.setdefault((k[0], c), []).append(p)
    want = {k: (*clustering.chimera_centroid(p), len(p)) for k, p in groups.items()}
    assert {(r["id"], r["cluster"]): tuple(r[c] for c in ("start1", "end1", "start2", "end2", "reads")) for r in clusters} == want

    def meet(a, b, i, j):
        return a[i] <= b[j + 1] and b[j] <= a[i + 1]

    for r in clusters:
        a = want[r["id"], r["cluster"]]
        lost = sum(b[4] for (t, c), b in want.items() if t == r["id"] and c != r["cluster"] and any(meet(a, b, i, j) for i in (0, 2) for j in (0, 2)) and not (meet(a, b, 0, 0) and meet(a, b, 2, 2)))
        assert r["probability"] == a[4] / (a[4] + lost)


def test_chimera_workflow_makes_no_call_for_each_group(spark):
    """A group of its own costs about a millisecond in Python calls and Arrow: millions of small islands pass in batches, by a join on bins."""
    df = spark.createDataFrame([(1, 1, 20, 50, 80)], "id long, start1 long, end1 long, start2 long, end2 long")
    p = chimeras.workflow(df)[1]._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in p and "MapInArrow" in p and "__bin" in p


def test_pair_lookup_tasks_go_with_the_rows(spark, tmp_path):
    """Alike pairs take few bytes in shuffle files; their join isn't merged into one task for that."""
    from basewise.plans import registry

    spark.range(130_000).selectExpr("id as p_partkey", "5 as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = registry.QUERIES["q10_pair_lookup"](spark, str(tmp_path))
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 130_000 and max(sizes) < 60_000
    assert got.where("p <> 0.5 or i <> 17 or j <> 0").count() == 0
