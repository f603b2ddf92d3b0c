"""Queries on chimeras, structure elements, text views, sizes and replicates' attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import align
from ..functions import structure as R
from ..functions import text as X
from ..operators import chimeras as H
from ..operators import correlate as C
from ..operators import elements as L
from ..operators import evaluate as E
from ..operators import kmers as K
from ..operators import pileup as P
from ..sources import sinks
from .views import SQL, intervals, rc_long, reads, sequences, table, tasks_for

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("f17_human_size", """with b as (select doc_id, n_chars * n_chars * (doc_id % 97) as n from documents)
select doc_id, case when n < 1024 then n || 'B' when n < 1048576 then printf('%.1fK', n / 1024.0) when n < 1073741824 then printf('%.1fM', n / 1048576.0)
 when n < 1099511627776 then printf('%.1fG', n / 1073741824.0) else printf('%.1fT', n / 1099511627776.0) end as size from b""")
def f17(spark, sf_dir):
    n = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 97)
    return table(spark, sf_dir, "documents").select("doc_id", X.human_size(n).alias("size"))


@query("f17_duration", """with t as (select o_orderkey, cast(floor(o_totalprice) as bigint) * (o_custkey % 300) as n from orders),
p as (select o_orderkey, n // 31622400 as y, n % 31622400 // 2635200 as mo, n % 31622400 % 2635200 // 604800 as w, n % 31622400 % 2635200 % 604800 // 86400 as d,
 n % 31622400 % 2635200 % 604800 % 86400 // 3600 as h, n % 31622400 % 2635200 % 604800 % 86400 % 3600 // 60 as mi, n % 31622400 % 2635200 % 604800 % 86400 % 60 as s from t)
select o_orderkey, coalesce(nullif(concat_ws(' ', case when y > 0 then y || 'y' end, case when mo > 0 then mo || 'm' end, case when w > 0 then w || 'w' end, case when d > 0 then d || 'd' end,
 case when h > 0 then h || 'h' end, case when mi > 0 then mi || 'm' end, case when s > 0 then s || 's' end), ''), '0s') as age from p""")
def f17b(spark, sf_dir):
    n = F.floor("o_totalprice").cast("bigint") * (F.col("o_custkey") % 300)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.duration(n).alias("age"))


@query("f17_size_in_bytes", """select p_partkey, (p_size + 0.5) * pow(1024, p_partkey % 6) as bytes from part""")
def f17c(spark, sf_dir):
    text = F.concat((F.col("p_size") + 0.5).cast("string"), F.substring(F.lit("bkMGTp"), (F.col("p_partkey") % 6 + 1).cast("int"), F.lit(1)))
    return table(spark, sf_dir, "part").select("p_partkey", X.size_in_bytes(text).alias("bytes"))


@query("f16_random", "select p_partkey, true as whole, true as text from part")
def f16(spark, sf_dir):
    """Random values are inside their bounds."""
    got = table(spark, sf_dir, "part").select("p_partkey", X.random_whole(3, 9, 5).alias("n"), X.random_text(12, "ACGU", 5).alias("s"))
    return got.select("p_partkey", F.col("n").between(3, 9).alias("whole"), F.col("s").rlike("^[ACGU]{12}$").alias("text"))


@query("f18_local_alignment")
def f18(spark, sf_dir):
    """Every word of five bases against a hairpin's arm, by what can pair."""
    scores = align.Scores(tuple(align.PAIRING.items()), -3.0, -3.0, -4.0, -2.0)
    words = K.counts(sequences(spark, sf_dir), 5).select("kmer")
    return words.select("kmer", align.aligned(F.translate("kmer", "T", "U"), F.lit("GGCAUUACGC"), scores).alias("r")).select("kmer", "r.*")


_PAIR = "with d as (select p_partkey as id, p_size % 7 + 2 as n, p_partkey % (p_size % 7 + 2) as m from part)"


def _hairpins(spark, sf_dir):
    """Hairpins of n pairs, and the same with the m outer pairs only."""
    n = (F.col("p_size") % 7 + 2).cast("int")
    m = (F.col("p_partkey") % n).cast("int")
    dots = F.repeat(F.lit("."), (n - m) * 2 + 4)
    whole = F.concat(F.repeat(F.lit("("), n), F.lit("...."), F.repeat(F.lit(")"), n))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), whole.alias("structure"), F.concat(F.repeat(F.lit("("), m), dots, F.repeat(F.lit(")"), m)).alias("other"))


@query("r05_pair_distance", f"{_PAIR} select id, cast(2 * n - 2 * m as bigint) as distance from d")
def r05(spark, sf_dir):
    return _hairpins(spark, sf_dir).select("id", R.pair_distance(F.col("structure"), F.col("other")).cast("bigint").alias("distance"))


@query("x11_structure_elements", f"{_PAIR} select id, 0 as start, cast(2 * n + 3 as int) as \"end\", repeat('(', n) || '....' || repeat(')', n) as structure from d where 2 * n + 4 >= 12 and 2 * n / (2 * n + 4) >= 0.6")
def x11(spark, sf_dir):
    rows = _hairpins(spark, sf_dir).withColumn("sequence", F.repeat(F.lit("A"), F.length("structure")))
    return L.extracted(rows, rules=L.Rules(least=12, paired=0.6)).select("id", "start", "end", "structure")


@query("q10_pair_lookup", f"{_PAIR}, p as (select id, unnest(generate_series(0, n - 1)) as i, n from d), k as (select id, i, 2 * n + 3 - i as j, 1 / (i + 2) as p from p) select d.id, cast(2 * d.n + 3 as int) as i, 0 as j, round(coalesce(k.p, 0), 6) as p from d left join k on k.id = d.id and k.i = 0 and k.j = 2 * d.n + 3")
def q10(spark, sf_dir):
    """In tasks of some 50,000 hairpins, up to 400,000 pairs."""
    n = tasks_for(table(spark, sf_dir, "part"), 50_000)
    hairpins = _hairpins(spark, sf_dir).repartition(n, "id")
    pairs = hairpins.select("id", F.length("structure").alias("n"), F.explode(R.list_pairs(F.col("structure"))).alias("x")).select("id", "n", "x.i", "x.j", (1 / (F.col("x.i") + 2)).alias("p"))
    asked = _hairpins(spark, sf_dir).select("id", (F.length("structure") - 1).alias("i"), F.lit(0).alias("j"))
    return E.pair_probability(pairs, asked, n).select("id", "i", "j", F.round("p", 6).alias("p"))


@query("q10_partners", f"{_PAIR}, p as (select id, unnest(generate_series(0, n - 1)) as i, n from d), k as (select id, cast(i as int) as i, cast(2 * n + 3 - i as int) as j from p) select id, i as base, j as partner from k union all select id, j, i from k")
def q10b(spark, sf_dir):
    pairs = _hairpins(spark, sf_dir).select("id", F.explode(R.list_pairs(F.col("structure"))).alias("x")).select("id", "x.i", "x.j", F.lit(1.0).alias("p"))
    return E.partners(pairs).select("id", "base", "partner")


@query("a42_median_span", f'with {SQL["reads"]}, f as (select "end" - start + 1 as span from reads order by read_no limit 10000) select cast(floor(quantile_cont(span, 0.5) + 0.5) as bigint) as median from f')
def a42(spark, sf_dir):
    return P.median_span(reads(spark, sf_dir), "read_no")


@query("p14_fine_coverage", f'with {SQL["reads"]}, c as (select id, muts, unnest(generate_series(start, "end")) as pos from reads) select id, cast(pos as int) as pos, count(*) as coverage from c where not list_contains(muts, pos) group by all')
def p14(spark, sf_dir):
    """Mutated positions as those of low quality."""
    return P.fine_coverage(reads(spark, sf_dir), "muts").select("id", F.col("pos").cast("int").alias("pos"), F.col("coverage").cast("bigint").alias("coverage"))


@query("p16_attribute_conflicts", "select o_custkey as id, count(*) as replicates, concat_ws(',', case when count(distinct o_orderstatus) > 1 then 'o_orderstatus' end, case when count(distinct o_orderpriority) > 1 then 'o_orderpriority' end) as conflicts from orders group by 1")
def p16(spark, sf_dir):
    got = C.attribute_conflicts(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id"), ["id"], ["o_orderstatus", "o_orderpriority"])
    return got.select("id", "replicates", F.array_join("conflicts", ",").alias("conflicts"))


@query("p16_consistent", "select o_custkey as id, o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(distinct o_orderstatus) = 1)")
def p16b(spark, sf_dir):
    return C.consistent(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id"), ["id"], ["o_orderstatus"]).select("id", "o_orderkey")


@query("j04_in_all_samples", "select o_custkey as id from orders group by 1 having count(distinct o_orderstatus) = (select count(distinct o_orderstatus) from orders)")
def j04(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    n = orders.select("o_orderstatus").distinct().count()
    return C.in_all(orders, "id", "o_orderstatus", n)


@query("q08_count_text", f"with {SQL['rc']} select id, sample, id || chr(10) || string_agg(base, '' order by pos) || chr(10) || string_agg(count, ',' order by pos) || chr(10) || string_agg(coverage, ',' order by pos) as value from rc group by id, sample")
def q08(spark, sf_dir):
    return sinks.count_text(rc_long(spark, sf_dir), ("id", "sample"))


@query("q08_count_table", f"with {SQL['rc']} select id, sample, id || chr(10) || string_agg(base || chr(9) || count || chr(9) || coverage, chr(10) order by pos) as value from rc group by id, sample")
def q08b(spark, sf_dir):
    return sinks.count_text(rc_long(spark, sf_dir), ("id", "sample"), tabular=True)


@query("k21_bed12", """with e as (select l_orderkey as id, 'chr' || (l_orderkey % 5) as chrom, case when l_orderkey % 2 = 0 then '+' else '-' end as strand, l_linenumber * 1000 as a, l_linenumber * 1000 + cast(l_quantity as int) as b from lineitem)
select chrom || chr(9) || min(a) || chr(9) || max(b) || chr(9) || id || chr(9) || '0' || chr(9) || strand || chr(9) || min(a) || chr(9) || max(b) || chr(9) || '0,0,0' || chr(9) || count(*) || chr(9)
 || string_agg(b - a, ',' order by a, b) || ',' || chr(9) || string_agg(a - m, ',' order by a, b) || ',' as value from (select *, min(a) over (partition by id) as m from e) group by id, chrom, strand""")
def k21(spark, sf_dir):
    key, start = F.col("l_orderkey"), F.col("l_linenumber") * 1000
    exons = table(spark, sf_dir, "lineitem").select(key.alias("id"), F.concat(F.lit("chr"), (key % 5).cast("string")).alias("chrom"), F.when(key % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))
    return sinks.bed12_lines(exons)


@query("o04_sampled", f'with {SQL["iv"]}, s as (select event_id, start from iv order by md5(event_id || \':7\') limit 500) select event_id, start from s order by start, event_id')
def o04(spark, sf_dir):
    return H.sampled(intervals(spark, sf_dir), "event_id", 500, ["start", "event_id"], 7).select("event_id", "start")


_SUPPORT = f'{SQL["iv"]}, c as (select id, count(*) as reads from iv group by id), p as (select id, start % 40 as i, 100 + "end" % 40 as j, count(*) as n from iv group by all), s as (select id, i, j, n, n / reads as support, reads from p join c using (id) where n / reads > 0.04)'


def _support(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    clusters = iv.groupBy("id").agg(F.count(F.lit(1)).alias("reads"))
    pairs = iv.groupBy("id", (F.col("start") % 40).alias("i"), (F.col("end") % 40 + 100).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return H.supported(pairs, clusters, ["id"], 0.04), clusters


@query("a38_supported_pairs", f"with {_SUPPORT} select id, i, j, n, round(support, 6) as support from s")
def a38(spark, sf_dir):
    return _support(spark, sf_dir)[0].select("id", "i", "j", "n", F.round("support", 6).alias("support"))


@query("a38_refined_clusters", f"with {_SUPPORT} select id, min(i) as start1, max(i) as end1, min(j) as start2, max(j) as end2, max(reads) as reads from s group by id")
def a38b(spark, sf_dir):
    return H.refined(*_support(spark, sf_dir), ["id"])


@query("f15_uri", "select page_id, url, url_encode(url) as escaped from pages")
def f15(spark, sf_dir):
    """Escaped, and plain again."""
    got = table(spark, sf_dir, "pages").select("page_id", X.uri_escaped(F.col("url")).alias("escaped"))
    return got.select("page_id", X.uri_plain(F.col("escaped")).alias("url"), "escaped")


@query("q24_chimera_workflow")
def q24(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    rows = iv.select("id", "start", (F.col("start") + 20).alias("e"), "end").select(F.col("id"), F.col("start").alias("start1"), F.col("e").alias("end1"), (F.col("end") + 30).alias("start2"), (F.col("end") + 55).alias("end2"))
    return H.workflow(rows)[1]


@query("a05_genome_counts", f"""with {SQL['reads']}, g as (select id, case when read_no % 2 = 0 then '+' else '-' end as strand, case when read_no % 2 = 0 then greatest(start - 2, 0) else start end as a, case when read_no % 2 = 0 then "end" else "end" + 2 end as b,
 case when read_no % 2 = 0 then start - 3 else "end" + 3 end as stop from reads), c as (select id, strand, pos, 0 as s, 1 as d from (select id, strand, unnest(generate_series(a, b)) as pos from g) union all select id, strand, stop, 1, 0 from g where stop >= 0)
select id, strand, cast(pos as int) as pos, cast(sum(s) as bigint) as count, cast(sum(d) as bigint) as coverage from c group by all""")
def a05(spark, sf_dir):
    r = reads(spark, sf_dir).select("id", F.when(F.col("read_no") % 2 == 0, "+").otherwise("-").alias("strand"), "start", "end")
    return P.genome_counts(r, 2).withColumn("pos", F.col("pos").cast("int"))
