"""Queries on sequences, structures, evaluation, arrays and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import math as M
from ..functions import sequence as Q
from ..functions import stats as T
from ..functions import structure as R
from ..operators import evaluate as E
from ..operators import intervals as I
from ..operators import kmers as K
from ..operators import pileup as P
from ..operators import reads as A
from ..operators import windows as W
from ..sources import sinks
from .queries_norm import samples
from .views import SQL, intervals, mates, rc_long, reactivity_long, reads, sequences, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(c, name=None, digits=6):
    return F.round(c, digits).alias(name or c)


_PARTS = "parts as (select p_partkey as id, upper(p_name) as name, p_size, p_retailprice from part)"


def _short(spark, sf_dir):
    """Sequences of conversations: some hundred bases each."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("sequence"))


_SHORT = "short as (select conv_id * 1000 + turn as id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as sequence from conversations)"


@query("f02_reverse_complement", f"with {SQL['seqs']} select id, reverse(translate(sequence, 'ACGT', 'TGCA')) as rc from seqs")
def f02(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", Q.reverse_complement(F.col("sequence")).alias("rc"))


@query("f03_rna", f"with {SQL['seqs']} select id, translate(sequence, 'T', 'U') as rna from seqs")
def f03(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", Q.to_rna(F.col("sequence")).alias("rna"))


_CODONS = ", ".join(f"'{c}': '{a}'" for c, a in Q.genetic_code().items())


@query("f04_translate", f"with {_SHORT} select id, array_to_string(list_transform(generate_series(1, len(sequence) - 2, 3), lambda i: coalesce((map {{{_CODONS}}})[substr(sequence, i, 3)], 'X')), '') as protein from short where len(sequence) >= 3")
def f04(spark, sf_dir):
    return _short(spark, sf_dir).where("length(sequence) >= 3").select("id", Q.translate(F.col("sequence")).alias("protein"))


@query("f05_ambiguity_codes", f"""with {SQL['seqs']}, k as (select distinct substr(sequence, i, 3) as word from (select sequence, unnest(generate_series(1, len(sequence) - 2)) as i from seqs where len(sequence) >= 3)),
b as (select word, array_to_string(list_sort(list_distinct(string_split(word, ''))), '') as bases from k)
select word, substr('-ACMGRSVTWYHKDBN', cast(contains(bases, 'A') as int) + 2 * cast(contains(bases, 'C') as int) + 4 * cast(contains(bases, 'G') as int) + 8 * cast(contains(bases, 'T') as int) + 1, 1) as code, bases from b""")
def f05(spark, sf_dir):
    """The code of the bases in every word of three, and back."""
    bases = F.array_join(F.array_sort(F.array_distinct(F.split("kmer", ""))), "")
    got = K.counts(sequences(spark, sf_dir), 3).select(F.col("kmer").alias("word"), Q.to_iupac(bases).alias("code"))
    return got.select("word", "code", Q.from_iupac(F.col("code")).alias("bases"))


@query("f08_longest_orf", f"""with {SQL['seqs']}, c as (select id, i, substr(sequence, i, 3) as codon from (select id, sequence, unnest(generate_series(1, len(sequence) - 2)) as i from seqs where len(sequence) >= 3)),
s as (select id, i, codon, min(case when codon in ('TAA', 'TAG', 'TGA') then i end) over (partition by id, i % 3 order by i rows between current row and unbounded following) as stop from c),
b as (select id, i, stop + 3 - i as n, row_number() over (partition by id order by stop - i desc, i) as r from s where codon = 'ATG' and stop is not null)
select seqs.id, case when n >= 9 then substr(sequence, cast(i as int), cast(n as int)) end as orf from seqs left join b on seqs.id = b.id and r = 1""")
def f08(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", Q.longest_orf(F.col("sequence"), least=9).alias("orf"))


@query("f09_hamming", f"with {_SHORT} select id, case when sequence = '' then 0 else cast(hamming(sequence, reverse(sequence)) as bigint) end as distance from short")
def f09(spark, sf_dir):
    return _short(spark, sf_dir).select("id", Q.hamming(F.col("sequence"), F.reverse("sequence")).cast("bigint").alias("distance"))


@query("f10_extract", f"with {_SHORT} select id, case when len(sequence) >= 30 then substr(sequence, 11, 20) end as part from short")
def f10(spark, sf_dir):
    return _short(spark, sf_dir).select("id", Q.extract(F.col("sequence"), F.lit(11), F.lit(30)).alias("part"))


@query("f15_strip_tags", "select page_id, trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' ') as text from pages")
def f15(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace("html", "<[^>]*>", "")).alias("text"))


@query("p17_clean_ids", "select page_id, regexp_replace(url, '[^A-Za-z0-9_.:-]', '_', 'g') as id from pages")
def p17(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", Q.clean_id(F.col("url")).alias("id"))


@query("p22_hard_mask", "select p_partkey, regexp_replace(p_name, '[a-z]', 'N', 'g') as masked, upper(p_name) as unmasked from part")
def p22(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", Q.hard_masked(F.col("p_name")).alias("masked"), F.upper("p_name").alias("unmasked"))


@query("f01_alphabets", f"with {_SHORT} select id, regexp_full_match(sequence, '(?i)[ACGT]+') as dna, regexp_full_match(sequence, '(?i)[ACGU]+') as rna from short")
def f01(spark, sf_dir):
    s = F.col("sequence")
    return _short(spark, sf_dir).select("id", Q.is_kind(s, "dna").alias("dna"), Q.is_kind(s, "rna").alias("rna"))


_VEC = "v as (select vec_id as id, list_transform(embedding, lambda x: cast(round(cast(x as double), 4) as double)) as xs from embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("xs"))


@query("f22_array_summaries", f"with {_VEC} select id, round(list_avg(xs), 10) as mean, round(list_median(xs), 8) as median, round((list_min(xs) + list_max(xs)) / 2, 8) as midrange, round(list_stddev_samp(xs), 5) as sd, round(list_stddev_pop(xs), 5) as sd_pop from v")
def f22(spark, sf_dir):
    x = F.col("xs")
    return _vectors(spark, sf_dir).select("id", _r(M.mean(x), "mean", 10), _r(M.median(x), "median", 8), _r(M.midrange(x), "midrange", 8), _r(M.deviation(x), "sd", 5), _r(M.deviation(x, 0), "sd_pop", 5))


@query("f22_places_of_extremes", f"with {_VEC} select id, cast(list_position(xs, list_max(xs)) - 1 as bigint) as argmax, cast(list_position(xs, list_min(xs)) - 1 as bigint) as argmin from v")
def f22b(spark, sf_dir):
    x = F.col("xs")
    return _vectors(spark, sf_dir).select("id", M.places(x, F.array_max)[0].cast("bigint").alias("argmax"), M.places(x, F.array_min)[0].cast("bigint").alias("argmin"))


@query("f23_rounding", "select p_partkey, cast(floor(p_retailprice / 3 + 0.5) as bigint) as rounded, floor(p_retailprice / 25.0 + 0.5) * 25.0 as multiple, cast(floor(-p_size / 2 + 0.5) as bigint) as negative from part")
def f23(spark, sf_dir):
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", M.half_up(p / 3).alias("rounded"), M.nearest_multiple(p, 25.0).alias("multiple"), M.half_up(-F.col("p_size") / 2).alias("negative"))


@query("f21_logarithms", "select p_partkey, round(case when p_size % 5 > 0 then ln(p_size % 5) / ln(2) else 999 end, 6) as l from part")
def f21(spark, sf_dir):
    l = M.logarithm(F.col("p_size") % 5, 2.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.when(l == float("inf"), F.lit(999.0)).otherwise(l), 6).alias("l"))


@query("f24_sums_and_products", f"with {_VEC} select id, round(list_sum(xs), 5) as total, round(list_product(list_transform(xs, lambda x: 1 + abs(x) / 10)), 4) as product from v")
def f24(spark, sf_dir):
    x = F.col("xs")
    return _vectors(spark, sf_dir).select("id", _r(M.total(x), "total", 5), _r(M.product(F.transform(x, lambda v: 1 + F.abs(v) / 10)), "product", 4))


@query("f25_rescale", "select p_partkey, round((p_retailprice - 900) * 0.5 / 1200 + 0.25, 6) as y from part")
def f25(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _r(M.rescale(F.col("p_retailprice"), (900, 2100), (0.25, 0.75)), "y"))


@query("f26_interval_overlap", f'with {SQL["iv"]} select event_id, case when greatest(start, 1000) <= least("end", 20000) then greatest(start, 1000) end as low, case when greatest(start, 1000) <= least("end", 20000) then least("end", 20000) end as high from iv')
def f26(spark, sf_dir):
    low, high = M.overlap(F.col("start"), F.col("end"), F.lit(1000).cast("bigint"), F.lit(20000).cast("bigint"))
    return intervals(spark, sf_dir).select("event_id", low.alias("low"), high.alias("high"))


@query("f27_distance", f"with {_VEC} select a.id, round(list_distance(a.xs, b.xs), 5) as d, round(list_distance(a.xs, b.xs) / sqrt(len(a.xs)), 5) as dn from v a join v b on b.id = a.id + 1")
def f27(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    both = v.join(v.select((F.col("id") - 1).alias("id"), F.col("xs").alias("ys")), "id")
    x, y = F.col("xs"), F.col("ys")
    return both.select("id", _r(M.distance(x, y), "d", 5), _r(M.distance(x, y, True), "dn", 5))


@query("f36_gini", f"with {_VEC}, e as (select id, unnest(list_transform(xs, lambda x: abs(x))) as x from v), k as (select id, x, row_number() over (partition by id order by x) as i, count(*) over (partition by id) as n from e) select id, round(sum((2 * i - n - 1) * x) / max(n) / sum(x), 5) as gini from k group by id")
def f36(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", _r(M.gini(F.transform("xs", lambda x: F.abs(x))), "gini", 5))


@query("f20_predicates", "select conv_id, turn, regexp_full_match(substr(text, 1, 1), '[+-]?[0-9]+') as whole, conv_id % 2 = 0 as even, contains(text, '.') as has_point from conversations")
def f20(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", M.is_whole(F.substring("text", 1, 1)).alias("whole"), M.is_even(F.col("conv_id")).alias("even"), F.contains("text", F.lit(".")).alias("has_point"))


@query("a26_kmers", f"with {SQL['seqs']}, k as (select substr(sequence, i, 4) as kmer from (select sequence, unnest(generate_series(1, len(sequence) - 3)) as i from seqs where len(sequence) >= 4)) select kmer, count(*) as n from k group by kmer")
def a26(spark, sf_dir):
    return K.counts(sequences(spark, sf_dir), 4)


@query("a26_kmers_once", f"with {SQL['seqs']}, k as (select distinct id, substr(sequence, i, 4) as kmer from (select id, sequence, unnest(generate_series(1, len(sequence) - 3)) as i from seqs where len(sequence) >= 4)) select kmer, count(*) as n from k group by kmer")
def a26b(spark, sf_dir):
    return K.counts(sequences(spark, sf_dir), 4, once=True)


@query("q17_all_kmers", "with b as (select unnest(['A', 'C', 'G', 'T']) as b) select x.b || y.b || z.b as kmer from b x, b y, b z")
def q17(spark, sf_dir):
    return K.all_kmers(spark, 3)


_KM = f"{SQL['seqs']}, km as (select substr(sequence, i, 5) as kmer, count(*) as n from (select sequence, unnest(generate_series(1, len(sequence) - 4)) as i from seqs where len(sequence) >= 5) group by 1)"


@query("j15_neighbours", f"with {_KM} select a.kmer as a, b.kmer as b from km a join km b on a.kmer < b.kmer and hamming(a.kmer, b.kmer) <= 1")
def j15(spark, sf_dir):
    return K.neighbours(K.counts(sequences(spark, sf_dir), 5).select("kmer"))


@query("a44_weight_matrix", f"with {_KM} select cast(p - 1 as bigint) as pos, substr(kmer, cast(p as int), 1) as base, max(n) as weight from km, (select unnest(generate_series(1, 5)) as p) group by all")
def a44(spark, sf_dir):
    return K.matrix(K.counts(sequences(spark, sf_dir), 5)).select(F.col("pos").cast("bigint").alias("pos"), "base", "weight")


@query("x09_enriched_kmers", f"""with {SQL['seqs']}, k as (select id % 2 as odd, substr(sequence, i, 4) as kmer from (select id, sequence, unnest(generate_series(1, len(sequence) - 3)) as i from seqs where len(sequence) >= 4)),
c as (select kmer, count(*) filter (odd = 0) as n, count(*) filter (odd = 1) as m from k group by kmer), t as (select *, cast(sum(n) over () as bigint) as tn, cast(sum(m) over () as bigint) as tm from c),
e as (select *, unnest(generate_series(n, least(n + m, tn))) as k from t where n > 0 and n * tm > m * tn),
f as (select kmer, n, m, sum(exp(lgamma(tn + 1) - lgamma(k + 1) - lgamma(tn - k + 1) + lgamma(tm + 1) - lgamma(n + m - k + 1) - lgamma(tm - n - m + k + 1) - lgamma(tn + tm + 1) + lgamma(n + m + 1) + lgamma(tn + tm - n - m + 1))) as p from e group by all)
select kmer, n, m, round(p, 6) as p from f where p < 0.05""")
def x09(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return K.enriched(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 4, 0.05).select("kmer", "n", "m", _r("p"))


@query("j19_around_peaks", f"with {SQL['seqs']}, c as (select id, sequence, unnest(generate_series(0, len(sequence) - 1, 11)) as centre from seqs where sequence <> '') select id, cast(centre as int) as centre, substr(sequence, cast(greatest(0, centre - 10) + 1 as int), cast(centre + 10 - greatest(0, centre - 10) + 1 as int)) as sequence from c")
def j19(spark, sf_dir):
    """Centres so close that every base of every document stands around one."""
    s = sequences(spark, sf_dir)
    c = s.where("sequence <> ''").select("id", F.explode(F.sequence(F.lit(0), F.length("sequence") - 1, F.lit(11))).alias("centre"))
    return K.around(c, s, 10)


_EVAL = f"{SQL['react']}, ev as (select id, sample, pos, value, pos % 3 <> 0 as paired from react)"


def _eval(spark, sf_dir):
    return reactivity_long(spark, sf_dir).select("id", "sample", "pos", "value", (F.col("pos") % 3 != 0).alias("paired"))


@query("a33_unpaired_coefficient", f"with {_EVAL} select id, sample, round(count(*) filter (value >= 0.6 and not paired) / count(*) filter (value >= 0.6), 6) as coefficient from ev group by id, sample having count(*) filter (value >= 0.6) > 0")
def a33(spark, sf_dir):
    return E.unpaired_coefficient(_eval(spark, sf_dir), ["id", "sample"], 0.6).where("coefficient is not null").select("id", "sample", _r("coefficient"))


@query("j16_dsci", f"with {_EVAL}, k as (select * from ev where value is not null) select u.id, u.sample, round(count(*) filter (p.value < u.value) / count(*), 6) as dsci from k u join k p using (id, sample) where not u.paired and p.paired group by u.id, u.sample")
def j16(spark, sf_dir):
    return E.dsci(_eval(spark, sf_dir), ["id", "sample"]).where("dsci is not null").select("id", "sample", _r("dsci"))


@query("a33_auroc", f"""with {_EVAL}, k as (select * from ev where value is not null), t as (select unnest(generate_series(0, 100)) as k), c as (select id, t.k, count(*) filter (not paired and value * 100 + 1e-9 >= t.k) / count(*) filter (not paired) as tpr, count(*) filter (paired and value * 100 + 1e-9 >= t.k) / count(*) filter (paired) as fpr from k, t group by all),
a as (select id, k, tpr, fpr from c union all select id, -1, 1, 1 from c group by id union all select id, 101, 0, 0 from c group by id), l as (select *, lead(tpr) over w as t2, lead(fpr) over w as f2 from a window w as (partition by id order by k))
select id, round(sum((tpr + t2) * (fpr - f2) / 2), 6) as auroc from l where t2 is not null group by id""")
def a33b(spark, sf_dir):
    return E.auroc(_eval(spark, sf_dir), ["id"], 100).select("id", _r("auroc"))


@query("a34_grid", "with s as (select round(x * 0.5, 1) as slope from (select unnest(generate_series(0, 4)) as x)), i as (select round(-2 + y * 0.5, 1) as intercept from (select unnest(generate_series(0, 4)) as y)), l as (select slope, intercept, (n_nationkey + 1) / 25 + slope / 10 - intercept / 10 as score from s, i, nation) select slope, intercept, round(exp(avg(ln(score))), 6) as score from l group by all")
def a34(spark, sf_dir):
    g = E.grid(spark, (0, 2, 0.5), (-2, 0, 0.5))
    scores = g.crossJoin(F.broadcast(table(spark, sf_dir, "nation"))).withColumn("score", (F.col("n_nationkey") + 1) / 25 + F.col("slope") / 10 - F.col("intercept") / 10)
    return E.grid_scores(scores, "score").select("slope", "intercept", _r("score"))


_BP = f'{SQL["mates"]}, h as (select m1.id, m1.start as i, m2.start + 60 as j, m1.pair_id from mates m1 join mates m2 using (pair_id) where m1.mate = 1 and m2.mate = 2), ra as (select distinct id, i, j from h where pair_id % 3 <> 0), rb as (select distinct id, i, j from h where pair_id % 3 <> 1)'


def _pair_tables(spark, sf_dir):
    m = mates(spark, sf_dir)
    two = m.where("mate = 2").select("pair_id", (F.col("start") + 60).alias("j"))
    h = m.where("mate = 1").select("pair_id", "id", F.col("start").alias("i")).join(two, "pair_id")
    return tuple(h.where(f"pair_id % 3 <> {k}").select("id", "i", "j").distinct() for k in (0, 1))


@query("a31_pair_metrics", f"""with {_BP}, c as (select id, count(*) as c from ra join rb using (id, i, j) group by id), a as (select id, count(*) as nr from ra group by id), b as (select id, count(*) as np from rb group by id),
u as (select id, count(*) as bases from (select id, i as x from ra union select id, j from ra union select id, i from rb union select id, j from rb) group by id)
select id, round(coalesce(c / np, 0), 6) as ppv, round(coalesce(c / nr, 0), 6) as sensitivity, round(coalesce(c / sqrt(nr * np), 0), 6) as fmi, round((200 - bases) / 200 + (1 - (200 - bases) / 200) * coalesce(c / sqrt(nr * np), 0), 6) as mfmi from a join u using (id) left join b using (id) left join c using (id)""")
def a31(spark, sf_dir):
    a, b = _pair_tables(spark, sf_dir)
    lengths = a.select("id").distinct().withColumn("length", F.lit(200))
    return R.pair_metrics(a, b, lengths).select("id", _r("ppv"), _r("sensitivity"), _r("fmi"), _r("mfmi"))


@query("a32_median_metrics", f"""with {_BP}, c as (select id, count(*) as c from ra join rb using (id, i, j) group by id), a as (select id, count(*) as nr from ra group by id), b as (select id, count(*) as np from rb group by id) select round(median(coalesce(c / np, 0)), 6) as ppv, round(median(coalesce(c / nr, 0)), 6) as sensitivity from a left join b using (id) left join c using (id)""")
def a32(spark, sf_dir):
    a, b = _pair_tables(spark, sf_dir)
    got = R.pair_metrics(a, b, a.select("id").distinct().withColumn("length", F.lit(200)))
    return got.agg(_r(F.percentile("ppv", 0.5), "ppv"), _r(F.percentile("sensitivity", 0.5), "sensitivity"))


_WP = f"{SQL['mates']}, pw as (select distinct m1.id, m1.pair_id % 4 as win, m1.start as i, m2.start + 10 as j, (m1.pair_id % 10 + 1) / 10 as p from mates m1 join mates m2 using (pair_id) where m1.mate = 1 and m2.mate = 2), p1 as (select id, win, i, j, max(p) as p from pw group by all), wd as (select id, w as win, w * 5 as start, w * 5 + 50 as \"end\" from (select distinct id from p1), (select unnest(generate_series(0, 3)) as w))"


def _window_pairs(spark, sf_dir):
    m = mates(spark, sf_dir)
    two = m.where("mate = 2").select("pair_id", (F.col("start") + 10).alias("j"))
    one = m.where("mate = 1").select("pair_id", "id", F.col("start").alias("i")).join(two, "pair_id")
    pairs = one.groupBy("id", (F.col("pair_id") % 4).alias("win"), "i", "j").agg(F.max((F.col("pair_id") % 10 + 1) / 10).alias("p"))
    wins = pairs.select("id").distinct().withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"start": F.col("win") * 5, "end": F.col("win") * 5 + 50})
    return pairs, wins


@query("a28_window_votes", f'with {_WP}, s as (select id, i, j, count(distinct win) as n from p1 group by all) select s.id, i, j, n, count(*) as windows from s join wd on wd.id = s.id and wd.start <= i and wd."end" >= j group by s.id, i, j, n having n > count(*) * 0.5')
def a28(spark, sf_dir):
    return E.window_pairs(*_window_pairs(spark, sf_dir))


@query("a29_mean_probabilities", f'with {_WP}, s as (select id, i, j, sum(p) as s from p1 group by all) select s.id, i, j, round(s / count(*), 6) as p from s join wd on wd.id = s.id and wd.start <= i and wd."end" >= j group by s.id, i, j, s')
def a29(spark, sf_dir):
    return E.mean_probabilities(*_window_pairs(spark, sf_dir)).select("id", "i", "j", _r("p"))


@query("a30_shannon", f"with {_WP}, e as (select id, i as pos, p from p1 union all select id, j, p from p1) select id, pos, round(-sum(p * log10(p)), 6) + 0.0 as shannon from e group by all")
def a30(spark, sf_dir):
    got = sinks.shannon(_window_pairs(spark, sf_dir)[0])
    return got.select("id", "pos", (F.round("shannon", 6) + 0.0).alias("shannon"))


@query("w14_fold_windows", "with l as (select doc_id as id, n_chars as length from documents), s as (select id, length, unnest(case when length <= 600 then [0] else list_distinct(list_filter(list_concat(generate_series(0, length - 600, 200), [50, 100, length - 650, length - 700, length - 600]), lambda x: x >= 0 and x <= length - 600)) end) as start from l) select id, cast(start as bigint) as start, cast(least(start + 599, length - 1) as bigint) as \"end\" from s")
def w14(spark, sf_dir):
    lengths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("int").alias("length"))
    return E.fold_windows(lengths, 600, 200).select("id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("p01_flags", "select l_orderkey, l_linenumber, cast(l_quantity as int) * 37 % 2048 as flag from lineitem where (cast(l_quantity as int) * 37 % 2048) & 1540 = 0 and l_linenumber >= 2")
def p01(spark, sf_dir):
    flag = F.col("l_quantity").cast("int") * 37 % 2048
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag")).where(P.usable(F.col("flag"), F.col("l_linenumber"), 2))


@query("x15_library_strand", "select l_orderkey, l_linenumber, case when ((f & 16) <> 0) <> ((f & 1) <> 0 and (f & 128) <> 0) then '+' else '-' end as strand from (select *, cast(l_quantity as int) * 37 % 2048 as f from lineitem)")
def x15(spark, sf_dir):
    flag = F.col("l_quantity").cast("int") * 37 % 2048
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.library_strand(flag, True).alias("strand"))


@query("f12_cigar", "select l_orderkey, l_linenumber, cast(l_quantity as bigint) as clip5, cast(p + 7 as bigint) as span, cast(p + 9 as bigint) as length, p + 3 as insertion from (select *, l_partkey % 50 + 1 as p from lineitem)")
def f12(spark, sf_dir):
    p = F.col("l_partkey") % 50 + 1
    text = F.concat(F.col("l_quantity").cast("int"), F.lit("S"), p, F.lit("M3D2I"), F.lit("4M"), F.lit("5N"), F.lit("3M9H"))
    c = A.cigar(text)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.alias("c"))
    return line.select("l_orderkey", "l_linenumber", F.col("c.clip5").cast("bigint").alias("clip5"), (F.col("c.span") - 3).cast("bigint").alias("span"), F.col("c.length").cast("bigint").alias("length"), (F.col("c.insertions")[0] + 1).cast("bigint").alias("insertion"))


@query("a04_gapped_coverage", f'with {SQL["mates"]}, p as (select id, start as a, start + 4 as b from mates union all select id, start + 15, start + 19 from mates) select id, pos, count(*) as coverage from (select id, unnest(generate_series(a, b)) as pos from p) group by all')
def a04(spark, sf_dir):
    m = mates(spark, sf_dir).select("id", F.explode(P.blocks(F.col("start"), F.lit("2S5M10N5M"))).alias("b")).select("id", "b.start", "b.end")
    return P.coverage(m, bin_size=32).select("id", "pos", F.col("coverage").cast("bigint").alias("coverage"))


@query("j12_extracted_regions", f"with {SQL['rc']}, b as (select n_nationkey as k, n_nationkey % 10 + 1 as id, n_nationkey as start, n_nationkey + 12 as \"end\", case when n_nationkey % 2 = 0 then '+' else '-' end as strand from nation), x as (select b.k, strand, pos, base, count, coverage from rc join b on b.id = rc.id and pos between start and \"end\" where sample = 'F') select k as name, row_number() over (partition by k order by case when strand = '-' then -pos else pos end) - 1 as pos, case when strand = '-' then translate(base, 'ACGT', 'TGCA') else base end as base, count, coverage from x")
def j12(spark, sf_dir):
    n = F.col("n_nationkey")
    blocks = table(spark, sf_dir, "nation").select(n.alias("name"), (n % 10 + 1).cast("bigint").alias("id"), n.alias("start"), (n + 12).alias("end"), F.when(n % 2 == 0, "+").otherwise("-").alias("strand"))
    got = I.extracted(rc_long(spark, sf_dir).where("sample = 'F'").drop("sample"), blocks)
    return got.select("name", F.col("pos").cast("bigint").alias("pos"), "base", "count", "coverage")


@query("k09_wiggle", f"with {SQL['rc']}, k as (select * from rc where sample = 'F' and coverage >= 3 and count > 0) select case when row_number() over (partition by id order by pos) = 1 then 'variableStep chrom=' || id || chr(10) else '' end || (pos + 1) || ' ' || count as value from k")
def k09(spark, sf_dir):
    return sinks.wig_lines(rc_long(spark, sf_dir).where("sample = 'F'"), "count", coverage=3)


@query("k10_bed", f'with {SQL["iv"]} select id || chr(9) || start || chr(9) || ("end" + 1) as value from iv')
def k10(spark, sf_dir):
    return sinks.bed_lines(intervals(spark, sf_dir))


@query("k11_fasta", f"with {_SHORT} select '>' || id || chr(10) || rtrim(regexp_replace(sequence, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) as value from short")
def k11(spark, sf_dir):
    return sinks.fasta_records(_short(spark, sf_dir).withColumn("id", F.col("id").cast("string")))


@query("s18_peak_centres", f'with {SQL["iv"]} select event_id, cast(floor((start + "end") / 2 + 0.5) as bigint) as centre from iv')
def s18(spark, sf_dir):
    from ..sources.text import centres

    return centres(intervals(spark, sf_dir)).select("event_id", "centre")


@query("f42_welch", f"with {SQL['rc']}, g as (select id, avg(coverage) filter (sample = 'O') as m0, avg(coverage) filter (sample = 'F') as m1, var_samp(coverage) filter (sample = 'O') / count(*) filter (sample = 'O') as e0, var_samp(coverage) filter (sample = 'F') / count(*) filter (sample = 'F') as e1, count(*) filter (sample = 'O') as n0, count(*) filter (sample = 'F') as n1 from rc group by id) select id, round((m0 - m1) / sqrt(e0 + e1), 6) as t, round((e0 + e1) * (e0 + e1) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)), 6) as df from g")
def f42(spark, sf_dir):
    rc = rc_long(spark, sf_dir).withColumn("g", (F.col("sample") == "F").cast("int"))
    return T.welch(rc, ["id"], "g", "coverage").select("id", _r("t"), _r("df"))


@query("f41_rank_sum", f"""with {SQL['rc']}, k as (select *, rank() over (partition by id order by coverage) + (count(*) over (partition by id, coverage) - 1) / 2 as r from rc), t as (select id, sum(c * c * c - c) as ties from (select id, coverage, count(*) as c from rc group by all) group by id),
s as (select id, sum(r) filter (sample = 'F') as rs, count(*) filter (sample = 'F') as n1, count(*) filter (sample = 'O') as n0 from k group by id)
select id, round(rs - n1 * (n1 + 1) / 2, 6) as w, round((rs - n1 * (n1 + 1) / 2 - n0 * n1 / 2 - 0.5 * sign(rs - n1 * (n1 + 1) / 2 - n0 * n1 / 2)) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))), 6) as z from s join t using (id)""")
def f41(spark, sf_dir):
    rc = rc_long(spark, sf_dir).withColumn("g", (F.col("sample") == "F").cast("int"))
    return T.rank_sum(rc, ["id"], "g", "coverage").select("id", _r("w"), _r("z"))


_FISHER = f"with {SQL['rc']}, t as (select id, cast(sum(case when sample = 'F' then count end) as double) as a, cast(sum(case when sample = 'F' then coverage - count end) as double) as b, cast(sum(case when sample = 'O' then count end) as double) as c, cast(sum(case when sample = 'O' then coverage - count end) as double) as d from rc group by id)"


@query("f34_fisher", _FISHER + """, e as (select id, a, b, c, d, unnest(case when a * d >= b * c then generate_series(cast(a as bigint), cast(least(a + b, a + c) as bigint)) else generate_series(cast(greatest(0, a + c - c - d) as bigint), cast(a as bigint)) end) as k from t)
select id, round(least(1.0, sum(exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)))), 6) as p from e group by id""")
def f34(spark, sf_dir):
    rc = rc_long(spark, sf_dir)

    def total(sample, expr):
        return F.sum(F.when(F.col("sample") == sample, F.expr(expr))).cast("double")

    t = rc.groupBy("id").agg(total("F", "count").alias("a"), total("F", "coverage - count").alias("b"), total("O", "count").alias("c"), total("O", "coverage - count").alias("d"))
    return t.select("id", _r(T.fisher_col("a", "b", "c", "d"), "p"))


@query("q23_peaks")
def q23(spark, sf_dir):
    from .pipelines import call_peaks

    return call_peaks(samples(spark, sf_dir), window=10, offset=5, least=0.2, p=0.9, distance=3)


@query("f07_dinucleotide_shuffle", f"""with {_SHORT}, d as (select id, sequence, unnest(generate_series(1, greatest(len(sequence) - 1, 1))) as i from short), c as (select id, substr(sequence, i, 2) as pair, count(*) as n from d group by all),
g as (select id, string_agg(pair || ':' || n, ',' order by pair) as pairs from c group by id)
select id, substr(sequence, 1, 1) as first, substr(sequence, len(sequence), 1) as last, case when sequence = '' then ':1' else pairs end as pairs, len(sequence) >= 100 as moved from short join g using (id)""")
def f07(spark, sf_dir):
    """Ends and pairs of neighbours stay; sequences of 100 bases or more don't stay as they are."""
    s = _short(spark, sf_dir).select("id", "sequence", Q.dishuffled(F.col("sequence"), 7).alias("s"))
    d = s.select("id", F.explode(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1)))).alias("i"), "s").groupBy("id", F.expr("substring(s, i, 2)").alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    pairs = d.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair", "n"))), lambda x: F.concat(x["pair"], F.lit(":"), x["n"])), ",").alias("pairs"))
    return s.join(pairs, "id").select("id", F.left("s", F.lit(1)).alias("first"), F.right("s", F.lit(1)).alias("last"), "pairs", ((F.length("s") >= 100) & (F.col("s") != F.col("sequence"))).alias("moved"))


@query("r03_base_pairs", "with d as (select p_partkey as id, p_size % 7 + 2 as n from part) select id, cast(k as bigint) as i, cast(2 * n + 3 - k as bigint) as j from (select id, n, unnest(generate_series(0, n - 1)) as k from d)")
def r03(spark, sf_dir):
    n = F.col("p_size") % 7 + 2
    db = F.concat(F.repeat(F.lit("("), n), F.lit("...."), F.repeat(F.lit(")"), n))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(R.list_pairs(db)).alias("p")).select("id", F.col("p.i").cast("bigint").alias("i"), F.col("p.j").cast("bigint").alias("j"))


@query("o08_output_order", f'with {SQL["iv"]} select cast(id as varchar) as id, start from iv order by 1, 2')
def o08(spark, sf_dir):
    return intervals(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "start").orderBy("id", "start")


@query("x14_by_end", f'with {SQL["reads"]} select id, "end", count(*) as reads from reads group by all')
def x14(spark, sf_dir):
    return reads(spark, sf_dir).groupBy("id", "end").agg(F.count(F.lit(1)).alias("reads"))


@query("p11_read_filter", f"with {SQL['reads']} select read_no, unnest(list_filter(muts, lambda x: x % 4 in (0, 1) and x between start + 2 and \"end\" - 2)) as pos from reads where \"end\" - start + 1 >= 5 and len(muts) between 1 and 4")
def p11(spark, sf_dir):
    r = reads(spark, sf_dir).where((F.col("end") - F.col("start") + 1 >= 5) & F.size("muts").between(1, 4))
    kept = F.filter("muts", lambda x: (x % 4).isin(0, 1) & x.between(F.col("start") + 2, F.col("end") - 2))
    return r.select("read_no", F.explode(kept).alias("pos"))


@query("n13_without_control", f"with {SQL['rc']}, m as (select id, quantile_cont(coverage, 0.5) as m from rc where sample = 'F' group by id) select id, pos, round(log2((coverage + 2) / (m + 2)), 6) as enrichment from rc join m using (id) where sample = 'F'")
def n13b(spark, sf_dir):
    rc = rc_long(spark, sf_dir).where("sample = 'F'").withColumnRenamed("coverage", "t_coverage")
    return W.enrichment(rc, 2.0).select("id", "pos", _r("enrichment"))


@query("q26_total_length", f"with {SQL['rc']} select cast(sum(n) as bigint) as positions from (select id, max(pos) + 1 as n from rc group by id)")
def q26(spark, sf_dir):
    return rc_long(spark, sf_dir).groupBy("id").agg((F.max("pos") + 1).alias("n")).agg(F.sum("n").cast("bigint").alias("positions"))


@query("a08_class_frequency", f"with {SQL['rc']} select base, round(sum(count) / sum(sum(count)) over (), 6) as frequency from rc group by base".replace("select base, round(sum(count) / sum(sum(count)) over (), 6) as frequency from rc group by base", "select base, round(n / sum(n) over (), 6) as frequency from (select base, sum(count) as n from rc group by base)"))
def a08(spark, sf_dir):
    n = rc_long(spark, sf_dir).groupBy("base").agg(F.sum("count").alias("n"))
    return n.select("base", _r(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), "frequency"))
