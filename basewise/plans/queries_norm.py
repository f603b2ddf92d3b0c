"""Queries on scoring and normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalise as N
from ..operators import scoring as S
from .views import SQL, rc_long, rc_thirds

COVERAGE = 3


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rc = rc_long(spark, sf_dir)
    return S.with_control(rc.where("sample = 'F'"), u=rc.where("sample = 'O'"))


def thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rc = rc_thirds(spark, sf_dir)
    return S.with_control(rc.where("sample = 'T'"), u=rc.where("sample = 'U'"), d=rc.where("sample = 'D'"))


def _r(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.difference(samples(spark, sf_dir), COVERAGE, 1.0, 1.0)


JOINED = f"""{SQL["rc"]}, pairs as (select t.id, t.pos, t.base, t.count as t_count, t.coverage as t_coverage, u.count as u_count, u.coverage as u_coverage
  from rc t join rc u using (id, pos, base) where t.sample = 'F' and u.sample = 'O'),
raws as (select *, case when t_coverage >= {COVERAGE} and u_coverage >= {COVERAGE} then greatest(0.0, t_count / t_coverage - u_count / u_coverage) end as raw from pairs)"""

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


_TWO_EIGHT = """ranked as (select *, row_number() over (partition by {by} order by {v} desc nulls last) - 1 as k, count({v}) over (partition by {by}) as n from {src}),
scaled as (select *, avg(case when k between greatest(1, floor(n * 0.02 + 0.5) - 1) and greatest(1, floor(n * 0.1 + 0.5) - 1) then {v} end) over (partition by {by}) as f from ranked),
normed as (select *, case when n >= 10 and f <> 0 and {v} is not null then greatest(0.0, {v} / f) end as norm from scaled)"""


@query("reactivity_profile", f"with {SQL['rc']}, t as (select id, pos, base, case when coverage >= {COVERAGE} then count / coverage end as raw from rc where sample = 'F'), {_TWO_EIGHT.format(by='id', v='raw', src='t')} select id, pos, base, round(norm, 6) as norm from normed")
def reactivity_profile(spark, sf_dir):
    rc = rc_long(spark, sf_dir).where("sample = 'F'").withColumnsRenamed({"count": "t_count", "coverage": "t_coverage"})
    return N.normalise(S.mutation_rate(rc, COVERAGE, 1.0), "2-8").select("id", "pos", "base", _r("norm"))


@query("j01_treated_untreated", f"with {JOINED} select id, pos, base, t_count, t_coverage, u_count, u_coverage from pairs")
def j01(spark, sf_dir):
    return samples(spark, sf_dir)


@query("j01_rejections", f"with {SQL['rc']}, s as (select id, sample, string_agg(base, '' order by pos) as w from rc group by all) select t.id, case when u.w is null then 'absent' when t.w <> u.w then 'mismatch' else 'ok' end as status from (select * from s where sample = 'F') t left join (select * from s where sample = 'O' and id % 5 <> 0) u using (id)")
def j01_rejections(spark, sf_dir):
    rc = rc_long(spark, sf_dir)
    return S.rejections(rc.where("sample = 'F'"), rc.where("sample = 'O' and id % 5 <> 0"))


@query("p06_covered", f"with {SQL['rc']}, m as (select id, avg(coverage) as a, quantile_cont(coverage, 0.5) as m from rc where sample = 'F' group by id) select rc.id, pos, coverage from rc join m using (id) where sample = 'F' and a >= 5.5 and m >= 5")
def p06(spark, sf_dir):
    return S.covered(rc_long(spark, sf_dir).where("sample = 'F'"), 5.5, 5).select("id", "pos", "coverage")


@query("p07_mask", f"with {JOINED} select id, pos, t_coverage < 5 or u_coverage < 5 or u_count / u_coverage > 0.4 or u_count / u_coverage > 0.6 or t_count / t_coverage > 0.6 as masked from pairs")
def p07(spark, sf_dir):
    return samples(spark, sf_dir).select("id", "pos", S.masked(["t", "u"], 5, 0.4, 0.6).alias("masked"))


@query("p08_ignore_lower", f"with {JOINED} select id, pos, round(case when t_coverage >= 3 and u_coverage >= 3 and t_count / t_coverage >= u_count / u_coverage then t_count / t_coverage - u_count / u_coverage end, 6) as raw from pairs")
def p08(spark, sf_dir):
    return S.difference(samples(spark, sf_dir), COVERAGE, 1.0, 1.0, ignore_lower=True).select("id", "pos", _r("raw"))


@query("p09_reactive_bases", f"with {SQL['rc']} select id, sample, pos, base, count from rc where base in ('A', 'C')")
def p09(spark, sf_dir):
    return rc_long(spark, sf_dir).where(F.col("base").isin("A", "C")).select("id", "sample", "pos", "base", "count")


@query("n01_ding", f"with {JOINED}, s as (select *, sum(ln(t_count + 1)) over w as st, sum(ln(u_count + 1)) over w as su, count(*) over w as n, sum(t_count) over w as ct, sum(u_count) over w as cu from pairs window w as (partition by id)), "
       "m as (select *, (st + ln(greatest(0, 100 - ct) + 1)) / (n + 1) as mt, (su + ln(greatest(0, 100 - cu) + 1)) / (n + 1) as mu from s) "
       "select id, pos, round(case when t_coverage >= 3 and u_coverage >= 3 and mt <> 0 and mu <> 0 then least(greatest(0.0, ln(t_count + 1) / mt - ln(u_count + 1) / mu), 10.0) end, 6) as raw from m")  # fmt: skip
def n01(spark, sf_dir):
    joined = samples(spark, sf_dir)
    reads = joined.select("id").distinct().select("id", F.lit(100).alias("t_reads"), F.lit(100).alias("u_reads"))
    return S.log_ratio(joined, reads, COVERAGE).select("id", "pos", _r("raw"))


@query("n02_rouskin", f"with {JOINED} select id, pos, case when t_coverage >= 3 then cast(t_count as double) end as raw from pairs")
def n02(spark, sf_dir):
    return S.counts(samples(spark, sf_dir), COVERAGE).select("id", "pos", "raw")


@query("n03_siegfried", f"with {JOINED} select id, pos, round(raw, 6) as raw from raws")
def n03(spark, sf_dir):
    return _raw(spark, sf_dir).select("id", "pos", _r("raw"))


@query("n03_siegfried_denatured", f"with {SQL['rc3']}, j as (select t.id, t.pos, t.count / t.coverage as t, u.count / u.coverage as u, d.count / d.coverage as d, least(t.coverage, u.coverage, d.coverage) as c from rc3 t join rc3 u using (id, pos, base) join rc3 d using (id, pos, base) where t.sample = 'T' and u.sample = 'U' and d.sample = 'D') select id, pos, round(case when c >= 2 then case when d = 0 then 0.0 else greatest(0.0, t - u) / d end end, 6) as raw from j")
def n03_denatured(spark, sf_dir):
    return S.difference(thirds(spark, sf_dir), 2, 1.0, 1.0).select("id", "pos", _r("raw"))


@query("n04_zubradt", f"with {SQL['rc']} select id, pos, round(case when coverage >= 3 and count / coverage <= 0.6 then count / coverage end, 6) as raw from rc where sample = 'F'")
def n04(spark, sf_dir):
    rc = rc_long(spark, sf_dir).where("sample = 'F'").withColumnsRenamed({"count": "t_count", "coverage": "t_coverage"})
    return S.mutation_rate(rc, COVERAGE, 0.6).select("id", "pos", _r("raw"))


@query("n05_two_eight", f"with {JOINED}, {_TWO_EIGHT.format(by='id', v='raw', src='raws')} select id, pos, round(norm, 6) as norm from normed")
def n05(spark, sf_dir):
    return N.normalise(_raw(spark, sf_dir), "2-8").select("id", "pos", _r("norm"))


@query("n06_winsor", f"with {JOINED}, q as (select id, coalesce(quantile_cont(raw, 0.05), 0) as a, quantile_cont(raw, 0.95) as b, count(raw) as n from raws group by id) select id, pos, round(case when n >= 10 and b <> 0 then least(greatest(raw, a) / b, 1.0) end, 6) as norm from raws join q using (id) where raw is not null union all select id, pos, null from raws where raw is null")
def n06(spark, sf_dir):
    return N.normalise(_raw(spark, sf_dir), "winsor").select("id", "pos", _r("norm"))


@query("n07_boxplot", f"""with {JOINED}, q as (select id, quantile_cont(raw, 0.75) + 1.5 * (quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25)) as lim, count(raw) as n from raws group by id),
k as (select *, row_number() over (partition by id order by raw desc nulls last) - 1 as k, sum(case when raw > lim then 1 else 0 end) over (partition by id) as o from raws join q using (id)),
f as (select *, greatest(1, case when n < 50 then floor(n * 0.02 + 0.5) else o end) as out, case when n between 50 and 99 then 10 else floor(n * 0.1 + 0.5) end as p from k),
a as (select *, avg(case when k >= out and k < out + p then raw end) over (partition by id) as f from f)
select id, pos, round(case when n >= 10 and f <> 0 and raw is not null then greatest(0.0, raw / f) end, 6) as norm from a""")
def n07(spark, sf_dir):
    return N.normalise(_raw(spark, sf_dir), "boxplot").select("id", "pos", _r("norm"))


@query("n08_mitchell", f"""with {JOINED}, k as (select *, row_number() over (partition by id order by raw nulls last) - 1 as k, count(raw) over (partition by id) as n, sum(case when raw > 0.001 then 1 else 0 end) over (partition by id) as h from raws),
m as (select *, avg(case when k between greatest(1, floor(n * 0.9 + 0.5) - 1) and greatest(1, floor(n * 0.95 + 0.5) - 1) then raw end) over (partition by id) as m, max(case when k = n - h + greatest(1, floor(h * 0.75 + 0.5) - 1) then raw end) over (partition by id) as t from k)
select id, pos, round(case when n >= 10 and greatest(m, t) <> 0 and raw is not null then greatest(0.0, raw / greatest(m, t)) end, 6) as norm from m""")
def n08(spark, sf_dir):
    return N.normalise(_raw(spark, sf_dir), "mitchell").select("id", "pos", _r("norm"))


@query("n09_zarringhalam", f"""with {JOINED}, {_TWO_EIGHT.format(by='id', v='raw', src='raws')}, t as (select *, max(norm) over (partition by id) as top from normed)
select id, pos, round(case when norm is null then null when norm < 0.25 then norm / 0.25 * 0.35 when norm < 0.3 then (norm - 0.25) / 0.05 * 0.2 + 0.35 when norm < 0.7 then (norm - 0.3) / 0.4 * 0.3 + 0.55 when top = 0.7 then 0.85 else (norm - 0.7) / (top - 0.7) * 0.15 + 0.85 end, 6) as norm from t""")
def n09(spark, sf_dir):
    return N.remapped(N.normalise(_raw(spark, sf_dir), "2-8")).select("id", "pos", _r("norm"))


@query("n10_given_factor", f"with {JOINED} select id, pos, round(least(greatest(raw, 0.1) / 0.8, 1.0), 6) as norm from raws where raw is not null union all select id, pos, null from raws where raw is null")
def n10(spark, sf_dir):
    return N.normalise(_raw(spark, sf_dir), "winsor", factor=(0.1, 0.8)).select("id", "pos", _r("norm"))


@query("n11_all_masked_dropped", f"with {JOINED}, {_TWO_EIGHT.format(by='id', v='raw', src='raws')} select id, pos, round(norm, 6) as norm from normed where id in (select id from normed where norm is not null)")
def n11(spark, sf_dir):
    got = N.normalise(_raw(spark, sf_dir), "2-8")
    return got.join(got.where("norm is not null").select("id").distinct(), "id", "left_semi").select("id", "pos", _r("norm"))


def _windows_sql(size: int, step: int, by: str, source: str, at: str = "pos") -> str:
    return f"""lens as (select id, max({at}) + 1 as len from {source} group by id),
starts as (select id, unnest(generate_series(0, len - least({size}, len), case when len <= {size} then len else {step} end)) as s, least({size}, len) as wide, len from lens),
wins as (select id, s, wide from starts union select id, len - wide, wide from starts group by id, len, wide having max(s) + wide < len),
src as (select r.*, s from {source} r join wins w on r.id = w.id and r.{at} between w.s and w.s + w.wide - 1),
{_TWO_EIGHT.format(by=by, v="raw", src="src")}"""


@query("w02_sliding_windows", f"with {JOINED}, {_windows_sql(30, 10, 'id, s', 'raws')} select id, pos, round(case when count(norm) = count(*) then avg(norm) end, 6) as norm from normed group by id, pos")
def w02(spark, sf_dir):
    return N.sliding(_raw(spark, sf_dir), "2-8", 30, 10).select("id", "pos", _r("norm"))


@query("w03_dynamic_windows", f"with {JOINED}, ac as (select *, row_number() over (partition by id order by pos) - 1 as q from raws where base in ('A', 'C')), {_windows_sql(15, 5, 'id, s', 'ac', 'q')} select id, pos, round(case when count(norm) = count(*) then avg(norm) end, 6) as norm from normed group by id, pos")
def w03(spark, sf_dir):
    return N.dynamic(_raw(spark, sf_dir), "2-8", ["A", "C"], 15, 5).select("id", "pos", _r("norm"))


@query("w04_by_base", f"with {JOINED}, {_TWO_EIGHT.format(by='id, base', v='raw', src='raws')} select id, pos, base, round(norm, 6) as norm from normed")
def w04(spark, sf_dir):
    return N.normalise(_raw(spark, sf_dir), "2-8", ["id", "base"]).select("id", "pos", "base", _r("norm"))
