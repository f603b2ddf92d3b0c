"""Queries against their SQL, plans, streams, and the text operators' absence."""

from __future__ import annotations

import math
import os
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basewise.plans import pipelines, registry
from basewise.plans.views import rc_long, reads, sequences
from basewise.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return str([shown(x) for x in v])
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return ""
    return f"{float(v) + 0.0:.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted("|".join(shown(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = rows(registry.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(registry.ORACLES[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    differ = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not differ, differ[:3]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


def test_gini_of_all_vectors(spark, duck):
    want = duck.execute("with e as (select vec_id as id, unnest(list_transform(embedding, lambda x: abs(round(cast(x as double), 4)))) as x from embeddings) select a.id, sum(abs(a.x - b.x)) / (2 * count(*)) / avg(a.x) as gini from e a join e b using (id) group by a.id").fetchall()
    got = {r["id"]: r["gini"] for r in registry.QUERIES["f36_gini"](spark, SF).collect()}
    assert len(got) == len(want) == 500 and all(abs(got[i] - g) < 2e-5 for i, g in want)


def test_around_reaches_all_bases(spark):
    want = {r["id"]: r["sequence"] for r in sequences(spark, SF).collect() if r["sequence"]}
    got = registry.QUERIES["j19_around_peaks"](spark, SF).collect()
    assert {(r["id"], r["centre"], r["sequence"]) for r in got} == {(i, c, s[max(0, c - 10) : c + 11]) for i, s in want.items() for c in range(0, len(s), 11)}
    assert len(got) == sum(-(-len(s) // 11) for s in want.values()) and max(len(s) for s in want.values()) > 311


def test_fasta_and_hamming_of_whole_sequences(spark, duck):
    short = duck.execute("select conv_id * 1000 + turn, regexp_replace(upper(text), '[^ACGT]', '', 'g') from conversations").fetchall()
    fasta = sorted(r["value"] for r in registry.QUERIES["k11_fasta"](spark, SF).collect())
    assert fasta == sorted("\n".join([f">{i}", *(s[k : k + 60] for k in range(0, max(1, len(s)), 60))]) for i, s in short) and any(x.count("\n") > 1 for x in fasta)
    distance = sorted(tuple(r) for r in registry.QUERIES["f09_hamming"](spark, SF).collect())
    assert distance == sorted((i, sum(x != y for x, y in zip(s, s[::-1], strict=True))) for i, s in short)


def test_neighbours_and_weights_of_all_kmers(spark):
    n = Counter(s[i : i + 5] for s in (r["sequence"] for r in sequences(spark, SF).collect()) for i in range(len(s) - 4))
    pairs = {tuple(sorted((a, b))) for a in n for p in range(5) for c in "ACGT" if (b := a[:p] + c + a[p + 1 :]) in n and a != b}
    assert sorted(tuple(r) for r in registry.QUERIES["j15_neighbours"](spark, SF).collect()) == sorted(pairs)
    weights = {(p, b): max((m for k, m in n.items() if k[p] == b), default=0) for p in range(5) for b in "ACGT"}
    assert {(r["pos"], r["base"]): r["weight"] for r in registry.QUERIES["a44_weight_matrix"](spark, SF).collect()} == {k: m for k, m in weights.items() if m}
    assert min(n.values()) < 200


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["n05_two_eight", "a16_pearson", "w01_modification_score", "j11_interval_join", "j14_overlap_self_join", "a03_coverage", "j16_dsci", "w11_benjamini_hochberg"])
def test_plans_are_native(spark, name):
    p = plan(registry.QUERIES[name](spark, SF))
    assert not any(x in p for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_scan_reads_what_it_needs(spark):
    p = plan(rc_long(spark, SF))
    assert "l_extendedprice" not in p and "l_suppkey" in p


def test_workflow(spark):
    rc = rc_long(spark, SF)
    t, u = (rc.where(f"sample = '{s}'").drop("sample") for s in "FO")
    for score, method in (("siegfried", "2-8"), ("ding", "winsor"), ("zubradt", "boxplot"), ("rouskin", "winsor")):
        got = pipelines.reactivities(t, u, settings=pipelines.Settings(score, method, coverage=1, max_untreated=1, max_rate=1, remap=method == "2-8"))
        assert got.where("norm is not null").count() > 0
    windows = pipelines.reactivities(t, u, settings=pipelines.Settings(coverage=1, max_untreated=1, max_rate=1, window=20, step=5))
    assert windows.count() > 0
    given = pipelines.reactivities(t, settings=pipelines.Settings("zubradt", coverage=1, max_rate=1), factor=(0.5,)).toPandas()
    assert (given.norm.dropna() <= 2).all()
    f = pipelines.factors({"t": t, "u": u}, 1)
    assert {r["sample"] for r in f.collect()} <= {"t", "u"} and pipelines.factors({"t": t, "u": u}, 1, "winsor").count() == 2
    assert pipelines.call_modifications(t, u, (100, 80), 20, 1).where("score is not null").count() > 0


def test_streamed_mates(spark, tmp_path):
    schema = "pair_id long, id long, start long, end long, ts timestamp"
    (tmp_path / "in").mkdir()
    got = set()

    def run(number, rows):
        df = pd.DataFrame(rows, columns=["pair_id", "id", "start", "end", "ts"])
        df.assign(ts=pd.to_datetime(df.ts, unit="s").astype("datetime64[us]")).to_parquet(tmp_path / f"in/{number}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = incremental.paired(stream).writeStream.foreachBatch(lambda df, _: got.update(tuple(r) for r in df.collect()))
        assert out.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)

    run(1, [(1, 1, 5, 9, 100), (2, 1, 0, 4, 100), (3, 1, 0, 4, 100), (3, 1, 2, 8, 100)])
    assert got == {(3, 1, 0, 8, 2)}
    run(2, [(1, 1, 20, 29, 110), (9, 1, 0, 4, 100_000)])
    run(3, [(9, 1, 7, 8, 100_001)])
    assert got == {(3, 1, 0, 8, 2), (1, 1, 5, 29, 2), (2, 1, 0, 4, 1), (9, 1, 0, 8, 2)}


def test_streamed_table(spark, tmp_path):
    pd.DataFrame([("s", 1, 2, 1), ("s", 1, 2, 0)], columns=["sample", "id", "pos", "hit"]).to_parquet(tmp_path / "a.parquet")
    stream = spark.readStream.schema("sample string, id long, pos long, hit long").option("pathGlobFilter", "*.parquet").load(str(tmp_path))
    incremental.add_to_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r["count"], r["coverage"]) == (1, 2)


def test_works_without_the_text_operators(tmp_path):
    for name in ("basewise", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "basewise/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "basewise").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_streamed_counts_stay_off_the_driver(spark, tmp_path):
    """The result is read by tasks, and is that of all batches."""
    got = registry.QUERIES["k03_streamed_counts"](spark, SF)
    assert "LocalTableScan" not in plan(got) and not [t.name for t in spark.catalog.listTables() if t.name.startswith("counts_")]
    for k in range(3):
        pd.DataFrame([("s", 1, 2, k % 2), ("s", k, 3, 1), (None, 1, 2, 1)], columns=["sample", "id", "pos", "hit"]).to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema("sample string, id long, pos long, hit long").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).load(str(tmp_path))
    rows = [tuple(r) for r in incremental.last_counts(stream, str(tmp_path / "c")).collect()]
    assert sorted(rows, key=str) == sorted([("s", 1, 2, 1, 3), ("s", 0, 3, 1, 1), ("s", 1, 3, 1, 1), ("s", 2, 3, 1, 1), (None, 1, 2, 3, 3)], key=str)


def test_fisher_and_word_counts_of_large_tables(spark, monkeypatch):
    """A test's cost goes with the deviation, not the counts; words are counted as they pass."""
    from basewise.functions import stats
    from basewise.operators import kmers

    rng, seen, terms = __import__("random").Random(3), stats.log_hyper, []
    monkeypatch.setattr(stats, "log_hyper", lambda k, *more: terms.append(len(k)) or seen(k, *more))
    for _ in range(300):
        a, b, c, d = (rng.choice([0, rng.randrange(5), rng.randrange(50), rng.randrange(20_000)]) for _ in range(4))
        low, high = max(0, a - d), min(a + b, a + c)
        p = [math.exp(x) for x in seen(list(range(low, high + 1)), a + b, c + d, a + c)]
        assert stats.fisher(a, b, c, d) == pytest.approx(min(1.0, sum(p[a - low :] if a * d >= b * c else p[: a - low + 1])), rel=1e-10, abs=1e-300)
    terms.clear()
    assert 0.4 < stats.fisher(1_000_000, 49_000_000, 1_000_000, 49_000_000) < 0.6 and sum(terms) < 100_000
    rows = [(1, "ACGTACGTNACGT"), (2, ""), (3, None), (4, "ACé" + "GT" * 9), (5, "AC"), (6, "GTAC" * 40)]
    df = spark.createDataFrame(rows, "id long, sequence string")
    for k in (1, 2, 4, 9, 31):
        want = Counter(w for _, s in rows for i in range(len(s or "") - k + 1) if not re.search("[^ACGT]", w := s[i : i + k]))
        assert {r["kmer"]: r["n"] for r in kmers.counts(df, k).collect()} == want
    p = plan(kmers.counts(df, 4))
    assert "Generate" not in p and "regexp_extract_all" not in p


def test_reads_are_put_together_in_tasks_that_go_with_the_lines(spark, tmp_path):
    """Alike lines take few bytes in shuffle files; their sort isn't merged into one task for that."""
    line = "id div 4 as l_orderkey, id % 9 as l_suppkey, cast(id % 4 as int) as l_linenumber, 1.0D as l_quantity, 'R' as l_returnflag, 'F' as l_linestatus, timestamp'1995-03-05 00:00:00' as l_shipdate"
    spark.range(600_000).selectExpr(*line.split(", ")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = reads(spark, str(tmp_path))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 150_000 and max(sizes) < 62_500
