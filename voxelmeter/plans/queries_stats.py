"""F1-F16 with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmeter.functions import CATEGORIES
from voxelmeter.operators import stats as st
from voxelmeter.plans import fixtures as fx
from voxelmeter.plans.fixtures import KEY, r, sql
from voxelmeter.plans.registry import query

Z = 1.959963984540054


@query("f1_describe", """with d as (select l_returnflag, l_extendedprice as v, median(l_extendedprice) over (partition by l_returnflag) as med from lineitem)
 select l_returnflag, count(*) as count, """ + ", ".join([
    f"{r(e, 3)} as {n}" for e, n in (("avg(v)", "mean"), ("stddev_samp(v)", "sample_sd"), ("min(v)", "minimum"), ("max(v)", "maximum"),
                                     ("quantile_cont(v,0.25)", "q1"), ("median(v)", "median"), ("quantile_cont(v,0.75)", "q3"), ("median(abs(v-med))", "mad"),
                                     ("max(v)-min(v)", "range"), ("quantile_cont(v,0.75)-quantile_cont(v,0.25)", "iqr"))])
       + f", {r('var_samp(v)/1e6')} as sample_variance from d group by 1")
def f1(spark, sf):
    out = st.describe(fx.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]).withColumn("sample_variance", F.col("sample_variance") / 1e6)
    return out.select("l_returnflag", "count", "sample_variance", *[F.round(c, 3).alias(c) for c in (
        "mean", "sample_sd", "minimum", "maximum", "q1", "median", "q3", "mad", "range", "iqr")])


@query("f1_top_values", f"""select l_returnflag, {r('v')} as l_tax, n, rank from (select *, row_number() over (partition by l_returnflag order by n desc, v) as rank from
 (select l_returnflag, round(l_tax,2) as v, count(*) as n from lineitem group by all)) where rank<=3""")
def f1b(spark, sf):
    return st.top_values(fx.table(spark, sf, "lineitem"), "l_tax", ["l_returnflag"], 3, 2)


def _u(seed, key):
    return f"(('0x'||substr(sha256('{seed}:'||{key}),1,13))::bigint/4503599627370496.0)"


def _boot(src, seed, draws, metrics, mode="pooled"):
    """Bootstrap of (sum, n) per case in SQL with the same md5 draws."""
    num = "s" if mode == "pooled" else "case when n>0 then s/n else 0 end"
    den = "n" if mode == "pooled" else "(n>0)::int"
    return f"""cl as materialized (select metric, case_id, coalesce(sum(v),0) as s, count(v) as n from {src} group by all),
 ix as materialized (select case_id, row_number() over (order by {_u(seed, 'case_id')}, case_id)-1 as rn from (select distinct case_id from cl)),
 cz as materialized (select metric, rn, {num} as s, {den} as n, n as o from cl join ix using (case_id)),
 sz as materialized (select count(*) as k from ix),
 pk as materialized (select d, ('0x'||substr(md5('{seed}:'||d||':'||s),1,8))::bigint % k as rn from (select unnest(range({draws})) as d), (select k, unnest(range(k)) as s from sz)),
 dr as materialized (select metric, d, case when sum(n)>0 then sum(s)/sum(n) end as m from pk join cz using (rn) group by all),
 bt as materialized (select metric, avg(m) as bootstrap_mean, quantile_cont(m,0.025) as ci_low, quantile_cont(m,0.975) as ci_high, count(m) as valid_draws from dr group by all),
 es as materialized (select metric, sum(s)/sum(n) as estimate, count(*) filter (n>0) as clusters_with_values, sum(o)::bigint as observations from cz group by all)"""


_BOUT = f"""select metric, {r('estimate')} as estimate, clusters_with_values, observations, {r('bootstrap_mean')} as bootstrap_mean, {r('ci_low')} as ci_low,
 {r('ci_high')} as ci_high, valid_draws, %d as draws, k as clusters from es join bt using (metric), sz"""
_M0 = """src as materialized (select unnest(['dice','good']) as metric, case_id, unnest([dice, case when dice>=0.1 then dice end]) as v from eval)"""


@query("f2_cluster_bootstrap", sql(_BOUT % 200, "eval", extra=_M0 + "," + _boot("src", 7, 200, None)))
def f2(spark, sf):
    rows = fx.evals(spark, sf).withColumn("good", F.when(F.col("hit"), F.col("dice")))
    return st.cluster_bootstrap(rows, "case_id", ["dice", "good"], 200, 7)


@query("f2_bootstrap_equal_case", sql(_BOUT % 200, "eval", extra=_M0 + "," + _boot("src", 8, 200, None, "equal_case")))
def f2b(spark, sf):
    rows = fx.evals(spark, sf).withColumn("good", F.when(F.col("hit"), F.col("dice")))
    return st.cluster_bootstrap(rows, "case_id", ["dice", "good"], 200, 8, "equal_case")


@query("f3_paired_bootstrap", sql(_BOUT % 200, "eval", extra="""src as materialized (select 'delta' as metric, a.case_id, b.dice-a.dice as v from eval a join eval b
 using (case_id, finding_id) where a.candidate_id='m0' and b.candidate_id='m1'),""" + _boot("src", 9, 200, None)))
def f3(spark, sf):
    ev = fx.evals(spark, sf)
    return st.paired_bootstrap(ev.where("candidate_id = 'm0'"), ev.where("candidate_id = 'm1'"), KEY, "case_id", "dice", 200, 9)


def _wilson(k, n, sign):
    c = f"(({k})/({n})::double+{Z}*{Z}/(2*({n})))/(1+{Z}*{Z}/({n}))"
    h = f"{Z}*sqrt(({k})/({n})::double*(1-({k})/({n})::double)/({n})+{Z}*{Z}/(4.0*({n})*({n})))/(1+{Z}*{Z}/({n}))"
    return f"case when ({n})<=0 then 0.0 else {'greatest(0.0,' if sign == '-' else 'least(1.0,'}{c}{sign}{h}) end"


@query("f4_wilson", sql(f"""select candidate_id, category, k, n, {r(_wilson('k', 'n', '-'))} as ci_low, {r(_wilson('k', 'n', '+'))} as ci_high from
 (select candidate_id, category, count(*) filter (hit) as k, count(*) as n from evalc group by all)""", "evalc"))
def f4(spark, sf):
    per = fx.evals_cat(spark, sf).groupBy("candidate_id", "category").agg(F.count_if("hit").alias("k"), F.count(F.lit(1)).alias("n"))
    return st.wilson(per, "k", "n")


def _erfc(x):
    """erfc by the all-positive series in closed form; the argument stays small on this data."""
    terms = f"list_sum(list_transform(range(0,80), lambda m: exp(m*ln(4.0)+lgamma(m+1)-lgamma(2*m+2))*pow({x},2*m+1)))"
    return f"(1-2/sqrt(pi())*exp(-({x})*({x}))*{terms})"


def _zp(k1, n1, k2, n2):
    pool = f"(({k1}+{k2})/({n1}+{n2})::double)"
    z = f"(abs({k1}/{n1}::double-{k2}/{n2}::double)/sqrt({pool}*(1-{pool})*(1.0/{n1}+1.0/{n2})))"
    return f"case when {pool}*(1-{pool})>0 then {_erfc('(' + z + '/sqrt(2.0))')} else 1.0 end"




@query("f5_two_prop_bh", sql(f"""select category, candidate_id, k, n, bk, bn, {r('p')} as p_value, {r('min(q) over (partition by category, p)')} as p_adjusted from (
 select *, least(1.0, min(p*cnt/rk) over (partition by category order by p desc)) as q from (
 select *, count(*) over (partition by category) as cnt, count(*) over (partition by category order by p) as rk from (
 select a.category, a.candidate_id, a.k, a.n, b.k as bk, b.n as bn, {_zp('a.k', 'a.n', 'b.k', 'b.n')} as p from h a join h b on a.category=b.category and b.candidate_id='m0')))""",
                             "evalc", extra="h as materialized (select category, candidate_id, count(*) filter (hit) as k, count(*) as n from evalc group by all)"))
def f5(spark, sf):
    h = fx.evals_cat(spark, sf).groupBy("category", "candidate_id").agg(F.count_if("hit").alias("k"), F.count(F.lit(1)).alias("n"))
    base = h.where("candidate_id = 'm0'").select("category", F.col("k").alias("bk"), F.col("n").alias("bn"))
    return st.benjamini_hochberg(st.two_prop(h.join(base, "category"), "k", "n", "bk", "bn"), "p_value", ["category"])


def _hist(f, split, *bins):
    return f.where(F.col("split") == split).groupBy(*bins).agg(F.count(F.lit(1)).cast("double").alias("n"))


_F6 = sql(f"""select {r('0.5*sum(abs(pa-pb))')} as total_variation, {r('0.5*(sum(case when pa>0 then pa*log2(pa/((pa+pb)/2)) else 0 end)+sum(case when pb>0 then pb*log2(pb/((pa+pb)/2)) else 0 end))')} as jensen_shannon_bits
 from (select category, count(*) filter (split='val')/(select count(*) from attrs where split='val') as pa, count(*) filter (split='test')/(select count(*) from attrs where split='test') as pb from attrs group by 1)""", "attrs")


@query("f6_distances", _F6)
def f6(spark, sf):
    f = fx.with_attributes(fx.finding_keys(spark, sf))
    return st.distances(_hist(f, "val", "category"), _hist(f, "test", "category"), ["category"])


def _tv(src):
    return f"(select 0.5*sum(abs(a/(select sum(a) from {src})-b/(select sum(b) from {src}))) from {src})"


@query("f6_mean_distance", sql(f"""select histogram, {r('v')} as total_variation from (select 'category' as histogram, {_tv('h1')} as v union all select 'entities', {_tv('h2')}
 union all select 'findings_per_case', {_tv('h3')} union all select 'mean', ({_tv('h1')}+{_tv('h2')}+{_tv('h3')})/3)""", "attrs", extra=",".join(
    f"{n} as materialized (select {c}, count(*) filter (split='val')::double as a, count(*) filter (split='test')::double as b from {t} group by 1)" for n, c, t in (
        ("h1", "category", "attrs"), ("h2", "entities", "attrs"), ("h3", "m", "(select case_id, split, count(*) m from attrs group by all)")))))
def f6b(spark, sf):
    f = fx.with_attributes(fx.finding_keys(spark, sf))
    per = f.groupBy("case_id", "split").agg(F.count(F.lit(1)).alias("m"))
    return st.mean_distance({"category": (_hist(f, "val", "category"), _hist(f, "test", "category"), ["category"]),
                             "entities": (_hist(f, "val", "entities"), _hist(f, "test", "entities"), ["entities"]),
                             "findings_per_case": (_hist(per, "val", "m"), _hist(per, "test", "m"), ["m"])})


_F7C = """c7 as materialized (select category, coalesce(train,0) as train, coalesce(val,0) as val, coalesce(test,0) as test, tn, vn, en from
 (select unnest(""" + str(CATEGORIES) + """) as category) left join (select category, count(*) filter (split='train') train, count(*) filter (split='val') val,
 count(*) filter (split='test') test from attrs group by 1) using (category), (select count(*) filter (split='train') tn, count(*) filter (split='val') vn, count(*) filter (split='test') en from attrs)),
 p7 as materialized (select *, """ + _zp("val", "vn", "test", "en") + """ as p from c7),
 q7 as materialized (select *, least(1.0, min(p*cnt/rk) over (order by p desc)) as q from (select *, count(*) over () as cnt, count(*) over (order by p) as rk from p7))"""
_F7 = sql(f"""select category, train as train_count, {r('train/tn')} as train_ratio, val as val_count, {r('val/vn')} as val_ratio, test as test_count, {r('test/en')} as test_ratio,
 {r(_wilson('val', 'vn', '-'))} as val_low, {r(_wilson('val', 'vn', '+'))} as val_high, {r(_wilson('test', 'en', '-'))} as test_low, {r(_wilson('test', 'en', '+'))} as test_high,
 {r('100*(test/en-val/vn)')} as difference_points, {r('(test/en)/nullif(val/vn,0)')} as ratio, {r('p')} as p_value, {r('q')} as p_adjusted, q<0.05 as significant,
 case when abs(test/en-val/vn)>=0.02 then 'VAL-TEST SHIFT' when not (case when val=0 then test>0 else (test/en)/(val/vn)<2.0/3 or (test/en)/(val/vn)>1.5 end) then ''
 when least(val,test)<5 then 'LOW-COUNT SHIFT WARNING' else 'VAL-TEST SHIFT' end as shift_flag from q7""", "attrs", extra=_F7C)


@query("f7_split_audit", _F7)
def f7(spark, sf):
    return st.split_audit(fx.with_attributes(fx.finding_keys(spark, sf)), CATEGORIES)


@query("f8_midrank", sql(f"""select case_id, finding_id, candidate_id, {r('dice')} as dice, hit, rank() over w - 1 as less, count(*) over (partition by candidate_id, dice) as equal,
 count(*) over (partition by candidate_id) - count(*) over (partition by candidate_id order by dice) as greater,
 {r('100.0*(rank() over w - 1 + count(*) over (partition by candidate_id, dice)/2)/count(*) over (partition by candidate_id)')} as percentile from eval
 window w as (partition by candidate_id order by dice)""", "eval"))
def f8(spark, sf):
    return st.midrank(fx.evals(spark, sf), "dice", ["candidate_id"])


_MD = """cm as materialized (select candidate_id, category, avg(dice) as dice, avg(hit::int) as hit, count(*) as n from evalc group by all),
 dl as materialized (select a.category, a.candidate_id as first, b.candidate_id as second, b.dice-a.dice as dd, b.hit-a.hit as dh, a.n from cm a join cm b on a.category=b.category and a.candidate_id<b.candidate_id)"""


def _means(spark, sf):
    return fx.evals_cat(spark, sf).groupBy("candidate_id", "category").agg(
        F.avg("dice").alias("dice"), F.avg(F.col("hit").cast("double")).alias("hit"), F.count(F.lit(1)).alias("n"))


@query("f8_sign_agreement", sql(f"""select first, second, count(*) as n, count(*) filter (dd*dh>0 and abs(dd)>1e-12 and abs(dh)>1e-12) as same_nonzero_direction,
 count(*) filter (dd*dh<0 and abs(dd)>1e-12 and abs(dh)>1e-12) as opposite_direction, count(*) filter (abs(dd)<=1e-12 or abs(dh)<=1e-12) as at_least_one_zero,
 {r('count(*) filter (dd*dh>0 and abs(dd)>1e-12 and abs(dh)>1e-12)/count(*)')} as same_direction_fraction, {r('corr(dd,dh)')} as pearson from dl group by all""", "evalc", extra=_MD))
def f8b(spark, sf):
    return st.sign_agreement(st.model_pair_deltas(_means(spark, sf), ["dice", "hit"]), ["first", "second"], "delta_dice", "delta_hit")


@query("f8_rms", sql(f"select first, second, {r('sqrt(sum(n*dd*dd)/sum(n))')} as weighted_rms, {r('sqrt(avg(dd*dd))')} as macro_rms from dl group by all", "evalc", extra=_MD))
def f8c(spark, sf):
    support = _means(spark, sf).where("candidate_id = 'm0'").select("category", "n")
    return st.rms(st.model_pair_deltas(_means(spark, sf), ["dice"]).join(support, "category"), ["first", "second"], "delta_dice", "n")


def _sub(spark, sf):
    """Cases whose truth is large: a subset with another category mix."""
    return fx.findings(spark, sf).groupBy("case_id").agg(F.sum("pixels").alias("n")).where("n >= 30").select("case_id")


def _groups(spark, sf):
    return fx.evals(spark, sf).select("candidate_id").distinct().withColumn("group", F.when(F.col("candidate_id") < "m4", "g1").otherwise("g2"))


_FS = """sb as materialized (select case_id from findings group by 1 having sum(pixels)>=30),
 fu as materialized (select candidate_id, category, avg(dice) fd, avg(hit::int) fh, count(*) n from evalc group by all),
 su as materialized (select candidate_id, category, avg(dice) sd, avg(hit::int) sh, count(*) m, sum(dice) ds, sum(hit::int) hs from evalc where case_id in (select case_id from sb) group by all),
 jn as materialized (select *, case when candidate_id<'m4' then 'g1' else 'g2' end as g from fu join su using (candidate_id, category)),
 pcr as materialized (select category, sqrt(avg((sd-fd)**2)) rd, sqrt(avg((sh-fh)**2)) rh from jn group by 1),
 prs as materialized (select round(a.sd-b.sd,12) as sd, round(a.fd-b.fd,12) as fd, round(a.sh-b.sh,12) as sh, round(a.fh-b.fh,12) as fh from jn a join jn b on a.g=b.g and a.category=b.category and a.candidate_id<b.candidate_id)"""


@query("f9_subset_fidelity", sql(f"""select * from (select {r('avg(rd)')} as macro_dice_rmse, {r('quantile_cont(rd,0.9)')} as p90_dice_rmse, {r('max(rd)')} as worst_dice_rmse,
 {r('avg(rh)')} as macro_hit_rmse, {r('quantile_cont(rh,0.9)')} as p90_hit_rmse, {r('max(rh)')} as worst_hit_rmse from pcr),
 (select {r('sqrt(avg((sd-fd)**2))')} as dice_delta_rmse, {r('sqrt(avg((sh-fh)**2))')} as hit_delta_rmse, {r('avg(case when fd<>0 then (sign(sd)=sign(fd))::int end)')} as dice_sign_agreement,
 {r('avg(case when fh<>0 then (sign(sh)=sign(fh))::int end)')} as hit_sign_agreement from prs)""", "evalc", "findings", extra=_FS))
def f9(spark, sf):
    return st.subset_fidelity(fx.evals_cat(spark, sf), _sub(spark, sf), _groups(spark, sf))


@query("f10_bias_decomposition", sql(f"""select metric, {r('avg(raw-fu)')} as total_bias, {r('avg(mix-fu)')} as composition_effect, {r('avg(raw-mix)')} as within_category_effect from (
 select candidate_id, unnest(['dice','hit_rate']) as metric, unnest([sum(fd*n)/sum(n), sum(fh*n)/sum(n)]) as fu, unnest([sum(fd*coalesce(m,0))/sum(m), sum(fh*coalesce(m,0))/sum(m)]) as mix,
 unnest([sum(ds)/sum(m), sum(hs)/sum(m)]) as raw from fu left join su using (candidate_id, category) group by 1) group by metric""", "evalc", "findings", extra=_FS))
def f10(spark, sf):
    return st.bias_decomposition(fx.evals_cat(spark, sf), _sub(spark, sf))


def _plans(spark, sf):
    """Orders as (cost, error) plans: discrete cost, falling error with noise."""
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", F.floor(F.col("o_totalprice") / 20000).alias("budget"), (1e6 / F.col("o_totalprice") + F.col("o_custkey") % 7 / 10.0).alias("error"))


_PL = "pl as materialized (select o_orderkey, floor(o_totalprice/20000)::bigint as budget, 1e6/o_totalprice+o_custkey%7/10.0 as error from orders)"
_FR = _PL + """, fr as materialized (select * from (select *, min(error) over (order by budget range between unbounded preceding and 1 preceding) as before, min(error) over (partition by budget) as own from pl)
 where error=own and (before is null or error<before))"""


@query("f11_pareto", sql(f"select o_orderkey, budget, {r('error')} as error from fr", extra=_FR))
def f11(spark, sf):
    return st.pareto(_plans(spark, sf), "budget", "error")


@query("f11_knee", sql(f"""select o_orderkey, budget, {r('error')} as error, {r('d')} as distance from (select o_orderkey, budget, error, 1-(budget-x0)/(40.0-x0)-error/y1 as d from fr,
 (select min(budget) x0, max(error) y1 from fr)) order by round(d,12) desc, budget, o_orderkey limit 1""", extra=_FR))
def f11b(spark, sf):
    return st.knee(st.pareto(_plans(spark, sf), "budget", "error"), "budget", "error", 40, ["o_orderkey"])


@query("f11_first_acceptable", sql(f"select o_orderkey, budget, {r('error')} as error from fr where budget between 3 and 30 and error<=8 order by budget, error limit 1", extra=_FR))
def f11c(spark, sf):
    return st.first_acceptable(st.pareto(_plans(spark, sf), "budget", "error"), "budget", "error", {"error": 8.0}, 3, 30)


BINS = [("0", 0, 1), ("1-4", 1, 5), ("5-9", 5, 10), ("10-19", 10, 20), ("20+", 20, None)]


@query("f12_size_bins", sql(f"""select focal, split, bin, coalesce(n,0) as n, {r('coalesce(n,0)/total')} as fraction from (select focal, split, count(*) as total from ff group by all) cross join
 (select unnest(['0','1-4','5-9','10-19','20+']) as bin) left join (select focal, split, case when pixels<1 then '0' when pixels<5 then '1-4' when pixels<10 then '5-9' when pixels<20 then '10-19' else '20+' end as bin,
 count(*) n from ff group by all) using (focal, split, bin)""", "findings", extra="ff as materialized (select *, unnest([split0,'all']) as split from (select pixels, split as split0, substr(category,1,1)='2' as focal from findings))"))
def f12(spark, sf):
    f = fx.findings(spark, sf).withColumn("focal", F.col("category").startswith("2"))
    return st.size_bins(f, "pixels", BINS, "split", ["focal"])


@query("f12_ecdf", sql(f"""select category, pixels, count(*) as n, {r('sum(count(*)) over (partition by category order by pixels)/sum(count(*)) over (partition by category)')} as ecdf from findings group by 1,2""", "findings"))
def f12b(spark, sf):
    return st.ecdf(fx.findings(spark, sf), "pixels", ["category"])


_ST = """sf as materialized (select *, row_number() over (partition by category order by d, h, case_id, finding_id) as rn, count(*) over (partition by category) as size from (
 select case_id, finding_id, category, round(avg(dice),12) as d, round(avg(hit::int),12) as h from evalc group by all)),
 sx as materialized (select case_id, finding_id, category, d, h, case when size>=40 then 3 when size>=12 then 2 else 1 end as bins, ntile(case when size>=40 then 3 when size>=12 then 2 else 1 end)
 over (partition by category order by rn) - 1 as difficulty_bin from sf)"""
_ST = _ST.replace("""ntile(case when size>=40 then 3 when size>=12 then 2 else 1 end)
 over (partition by category order by rn) - 1 as difficulty_bin""", """(select count(*)::int from (select unnest([1,2]) as q) where q < (case when size>=40 then 3 when size>=12 then 2 else 1 end)
 and rn > q*(size//(case when size>=40 then 3 when size>=12 then 2 else 1 end)) + least(q, size%(case when size>=40 then 3 when size>=12 then 2 else 1 end))) as difficulty_bin""")


@query("f13_difficulty_strata", sql(f"select case_id, finding_id, category, {r('d')} as mean_dice, {r('h')} as mean_hit, difficulty_bin, bins from sx", "evalc", extra=_ST))
def f13(spark, sf):
    return st.difficulty_strata(fx.evals_cat(spark, sf))


@query("f13_strata_summary", sql(f"select category, difficulty_bin, bins, count(*) as findings, {r('avg(d)', 9)} as mean_dice, {r('avg(h)', 9)} as mean_hit_rate from sx group by 1,2,3", "evalc", extra=_ST), digits=9)
def f13b(spark, sf):
    return st.strata_summary(f13(spark, sf))


_F14 = sql(f"""select metric, {r('t')} as train_value, {r('v')} as val_value, {r('v-t')} as difference from (select metric, max(x) filter (split='train') as t, max(x) filter (split='val') as v from (
 select split, unnest(['cases','positive_cases','case_rate','findings','findings_per_case','findings_per_positive_case','entities','entities_per_finding','entities_per_case','entities_per_positive_case']) as metric,
 unnest([c,pc,pc/c,f,f/c,f/nullif(pc,0),e,e/nullif(f,0),e/c,e/nullif(pc,0)]::double[]) as x from (select split, count(*) c, count(*) filter (f>0) pc, sum(f) f, sum(e) e from
 (select split, case_id, count(*) filter (category='2d') f, coalesce(sum(entities) filter (category='2d'),0) e from attrs where split<>'test' group by all) group by 1)) group by 1)""", "attrs")


@query("f14_population_compare", _F14)
def f14(spark, sf):
    return st.population_compare(fx.with_attributes(fx.finding_keys(spark, sf)), "2d")


@query("f14_entity_distribution", sql(f"""select category, split, bucket, coalesce(n,0) as findings, {r('coalesce(n,0)/total')} as fraction from (select category, split, count(*) total from attrs group by all) cross join
 (select unnest(['1','2','3','4+']) as bucket) left join (select category, split, case when entities>=4 then '4+' else entities::varchar end as bucket, count(*) n from attrs group by all) using (category, split, bucket)""", "attrs"))
def f14b(spark, sf):
    return st.entity_distribution(fx.with_attributes(fx.finding_keys(spark, sf)), ["category", "split"])


def _curve(spark, sf):
    """Journals where some losses are not finite."""
    j = fx.journal(spark, sf).select("arm", "global_update", "loss")
    return j.withColumn("loss", F.when(F.col("loss") > 250, float("nan")).when(F.col("loss") < 2, None).otherwise(F.col("loss")))


_CV = "cv as materialized (select arm, global_update, case when loss>250 or loss<2 then null else loss end as loss from journal)"


@query("f15_rolling", sql(f"""select arm, global_update, {r('avg(loss) over w', 9)} as rolling_mean, count(loss) over w as rolling_n from cv
 window w as (partition by arm order by global_update rows between 99 preceding and current row)""", "journal", extra=_CV), digits=9)
def f15(spark, sf):
    return st.rolling(_curve(spark, sf), ["arm"], "global_update", "loss", 100).drop("loss")


@query("f15_rolling_range", sql(f"""select arm, global_update, {r('avg(loss) over w', 9)} as rolling_mean, count(loss) over w as rolling_n from (select * replace (global_update + global_update // 10 * 40 as global_update) from cv)
 window w as (partition by arm order by global_update range between 49 preceding and current row)""", "journal", extra=_CV), digits=9)
def f15b(spark, sf):
    rows = _curve(spark, sf).withColumn("global_update", F.expr("global_update + global_update div 10 * 40"))  # gaps
    return st.rolling(rows, ["arm"], "global_update", "loss", 50, by_range=True).drop("loss")


@query("f15_curve_stats", sql(f"""select arm, n as observations, count(*) as finite_observations, {r('avg(loss) filter (rn<=100)')} as first_mean, {r('avg(loss) filter (rn>size-100)')} as last_mean,
 {r('avg(loss)')} as overall_mean, {r('max(loss)')} as maximum, n-count(*) as nonfinite_observations, {r('(avg(loss) filter (rn>size-100)-avg(loss) filter (rn<=100))/avg(loss) filter (rn<=100)')} as relative_change from
 (select *, row_number() over (partition by arm order by global_update) rn, count(*) over (partition by arm) size from cv where loss is not null) join (select arm, count(*) n from cv group by 1) using (arm) group by arm, n""",
                              "journal", extra=_CV))
def f15c(spark, sf):
    return st.curve_stats(_curve(spark, sf), ["arm"], "global_update", "loss")


@query("f16_poststratify", sql(f"""select candidate_id, {r('sum(ds)/sum(m)')} as raw_dice, {r('sum(hs)/sum(m)')} as raw_hit_rate, sum(m)::bigint as findings,
 {r('case when count(*) filter (m is null)=0 then sum(w*sd)/sum(w) end')} as weighted_dice, {r('case when count(*) filter (m is null)=0 then sum(w*sh)/sum(w) end')} as weighted_hit_rate,
 count(*) filter (m is null) as uncovered from (select candidate_id, category, w from (select distinct candidate_id from eval), (select category, count(*)::double as w from attrs where split='test' group by 1))
 full join su using (candidate_id, category) group by 1""".replace("full join su", "left join su").replace("sum(ds)/sum(m)", "any_value(rd)").replace("sum(hs)/sum(m)", "any_value(rh)").replace(
    "sum(m)::bigint", "any_value(rm)").replace("(candidate_id, category) group by 1", "(candidate_id, category) join (select candidate_id, sum(ds)/sum(m) rd, sum(hs)/sum(m) rh, sum(m)::bigint rm from su group by 1) using (candidate_id) group by 1"),
    "eval", "evalc", "findings", "attrs", extra=_FS))
def f16(spark, sf):
    ev = fx.evals_cat(spark, sf).join(_sub(spark, sf), "case_id", "left_semi")
    mix = fx.with_attributes(fx.finding_keys(spark, sf)).where("split = 'test'").groupBy("category").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return st.poststratify(ev, mix)
