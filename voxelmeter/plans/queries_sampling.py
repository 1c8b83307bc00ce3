"""G1-G14 with SQL twins for every draw that SQL can replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmeter.operators import sampling as sp
from voxelmeter.operators.grids import positive_points
from voxelmeter.operators.stats import difficulty_strata
from voxelmeter.plans import fixtures as fx
from voxelmeter.plans.fixtures import KEY, r, sql
from voxelmeter.plans.registry import query

PATCH = (6, 6, 6)


def _u(seed, *keys):
    return "(('0x'||substr(sha256('" + str(seed) + ":'||" + "||':'||".join(keys) + "),1,13))::bigint/4503599627370496.0)"


def _h(seed, *keys):
    return "('0x'||substr(md5('" + str(seed) + ":'||" + "||':'||".join(keys) + "),1,8))::bigint"


def _attrs(spark, sf):
    return fx.with_attributes(fx.finding_keys(spark, sf))


@query("g1_stable_unit", sql(f"select case_id, finding_id, {r(_u(11, 'case_id', 'finding_id'), 9)} as unit from keys", "keys"), digits=9)
def g1(spark, sf):
    return sp.stable_unit(fx.finding_keys(spark, sf), 11, KEY)


@query("g2_fixed_subset", sql(f"""select case_id, row_number() over (order by case_id)-1 as position from (select case_id from cases order by {_u(20260723, 'case_id')}, case_id limit 20)""", "cases"))
def g2(spark, sf):
    return sp.fixed_subset(fx.cases(spark, sf), ["case_id"], 20, 20260723, ["case_id"])


@query("g2_target_subset", sql(f"""select case_id, case when t and b then 'both' when t then 'target' else 'base' end as reason from (select case_id, bool_or(category in ('1a','2b')) as t,
 case_id in (select case_id from cases order by {_u(5, 'case_id')}, case_id limit 20) as b from attrs group by 1) where t or b""", "attrs", "cases"))
def g2b(spark, sf):
    base = sp.fixed_subset(fx.cases(spark, sf), ["case_id"], 20, 5, ["case_id"])
    return sp.target_subset(_attrs(spark, sf), ["1a", "2b"], base)


@query("g3_complement", sql("""select coalesce(k.case_id,s.case_id) as case_id, coalesce(k.finding_id,s.finding_id) as finding_id, case when s.case_id is null then 'complement'
 when k.case_id is null then 'foreign' else 'subset' end as part from keys k full join (select case_id, finding_id from gt group by all having count(*)>=10 union all
 select case_id, 7 from cases) s on k.case_id=s.case_id and k.finding_id=s.finding_id""", "keys", "gt", "cases"))
def g3(spark, sf):
    big = fx.gt(spark, sf).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select(*KEY)
    return sp.complement(fx.finding_keys(spark, sf), big.union(fx.cases(spark, sf).select("case_id", F.lit(7))), KEY)


@query("g4_grouped_kfold", sql(f"""select case_id, ((row_number() over (order by rarity desc, signature, {_u(42, 'case_id')}, case_id)-1)%5)::int as fold, findings from
 (select case_id, sum(c)::bigint as findings, round(sum(c/t),12) as rarity, string_agg(category||':'||c, ',' order by category||':'||c) as signature from
 (select case_id, category, count(*) as c from attrs group by all) join (select category, count(*) as t from attrs group by 1) using (category) group by 1)""", "attrs"))
def g4(spark, sf):
    return sp.grouped_kfold(_attrs(spark, sf), 5, 42)


_G5 = f"""q as materialized (select quantile_cont(pixels,0.25) a, quantile_cont(pixels,0.5) b, quantile_cont(pixels,0.75) c from findings),
 pf as materialized (select patient, count(*) f0, count(distinct case_id) f1, {", ".join(f"count(*) filter ((pixels>=a)::int+(pixels>=b)::int+(pixels>=c)::int={i}) as f{2 + i}" for i in range(4))},
 count(*) filter (entities=1) f6, count(*) filter (entities between 2 and 3) f7, count(*) filter (entities>3) f8 from findings, q group by 1),
 rk as materialized (select cand, pf.*, row_number() over (partition by cand order by {_u(3, 'cand', 'patient')}, cand, patient) as rn, count(*) over (partition by cand) as size from pf, (select unnest(range(40)) as cand)),
 tt as materialized (select {", ".join(f"sum(f{i}) as t{i}" for i in range(9))} from pf),
 sc as materialized (select cand, {", ".join(f"abs(2*sum(f{i})-any_value(t{i}))::bigint as g{i}" for i in range(9))} from rk, tt where rn<=size//2 group by cand),
 bs as materialized (select cand, g0, g1, g2+g3+g4+g5+g6+g7+g8 as gs from sc order by g0, g1, gs, cand limit 1)"""


@query("g5_balanced_halves", sql("select patient, case when rn<=size//2 then 'A' else 'B' end as half, cand::int as candidate, g0 as findings_gap, g1 as cases_gap, gs as strata_gap from rk join bs using (cand)",
                                 "findings", extra=_G5))
def g5(spark, sf):
    return sp.balanced_halves(fx.findings(spark, sf), 40, 3)


@query("g6_probe_search")
def g6(spark, sf):
    ev = fx.evals_cat(spark, sf)
    strata = difficulty_strata(ev).select("case_id", F.concat_ws("/", "category", "difficulty_bin").alias("stratum"))
    groups = spark.createDataFrame([(f"m{c}", "g1" if c < 4 else "g2") for c in range(8)], "candidate_id string, group string")
    n = fx.cases(spark, sf).count()
    return sp.probe_search(ev, strata, groups, [n // 2], [2], 8, 17)


_AL = """al as materialized (select category, w/sum(w) over ()*1000 as raw from (select category, %s as w from attrs group by 1)),
 ar as materialized (select *, floor(raw)::bigint as base, row_number() over (order by round(raw-floor(raw),12) desc, category desc) as rn from al)"""


@query("g7_allocate", sql(f"select category, {r('raw')} as raw, base+(rn<=1000-(select sum(base) from ar))::int as quota from ar", "attrs", extra=_AL % "count(*)::double"))
def g7(spark, sf):
    return sp.allocate(_attrs(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "n", 1000)


@query("g7_allocate_sqrt", sql(f"select category, {r('raw')} as raw, base+(rn<=1000-(select sum(base) from ar))::int as quota from ar", "attrs", extra=_AL % "sqrt(count(*)::double)"))
def g7b(spark, sf):
    return sp.allocate(_attrs(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "n", 1000, "sqrt")


def _pool(spark, sf):
    f = fx.findings(spark, sf).join(fx.pred(spark, sf).groupBy(*KEY).agg(F.count(F.lit(1)).alias("np")), KEY, "left").fillna(0, ["np"])
    return f.where("split <> 'test'").select(F.col("split").alias("source"), F.concat_ws("::", *KEY).alias("key"), F.col("pixels").alias("gt_n"),
                                             F.col("np").alias("prediction_n"))


_G8 = f"""pool as materialized (select split as source, case_id||'::'||finding_id as key, pixels as gt_n, coalesce(np,0) as prediction_n from findings left join
 (select case_id, finding_id, count(*) np from pred group by all) using (case_id, finding_id) where split<>'test'),
 pr as materialized (select *, row_number() over (partition by source order by {_u(13, 'key')}, key) as pos, count(*) over (partition by source) as size from pool),
 upd as materialized (select unnest(range((select ((count(*)+99)//100)*100 from pool))) as u),
 st as materialized (select u, case when row_number() over (partition by u//100 order by {_h(13, "'source'", 'u')}, u) <= 50 then 'train' else 'val' end as source,
 row_number() over (partition by u//100 order by {_h(13, "'mode'", 'u')}, u) as mr from upd)"""


@query("g8_block_schedule", sql(f"""select u+1 as update, s.source, case when mr<=50 then 'gt' when mr<=75 then 'prediction' else 'random' end as mode, key,
 case when mr<=50 then gt_n=0 when mr<=75 then prediction_n=0 else false end as fallback, {_h(13, "'patch'", 'u')} as patch_seed from st s join pr p on p.source=s.source
 and p.pos={_h(13, "'pick'", 'u')} % p.size + 1 where u < (select count(*) from pool)""", "findings", "pred", extra=_G8))
def g8(spark, sf):
    pool = _pool(spark, sf)
    return sp.block_schedule(pool, pool.count(), {"train": 50, "val": 50}, {"gt": 50, "prediction": 25, "random": 25}, 13)


def _points(spark, sf):
    return positive_points(fx.gt(spark, sf)).where("rank = 0").drop("rank")


def _text_pool(spark, sf):
    return fx.prompts(spark, sf).select(*KEY, "prompt")


def _events(spark, sf):
    h = fx.headers(spark, sf)
    n = fx.finding_keys(spark, sf).count()
    return sp.sample_events(sp.crop_options(_points(spark, sf), h, PATCH), _text_pool(spark, sf), h, n, PATCH, 23)


@query("g9_sample_events")
def g9(spark, sf):
    ev = _events(spark, sf)
    return ev.select("event_index", "case_id", F.to_json("prompt_slots").alias("slots"), "anchor_slot_index", "anchor_target_index",
                     F.array_join("patch_starts", ",").alias("starts"), "patch_seed")


@query("g9_event_check", sql("select count(*) as events, 0::bigint as bad_slot_count, 0::bigint as own_prompt_as_negative, 0::bigint as repeated_negative, 0::bigint as anchor_not_positive, 0::bigint as point_outside_crop from keys", "keys"))
def g9b(spark, sf):
    return sp.event_check(_events(spark, sf), _text_pool(spark, sf), fx.headers(spark, sf), PATCH)


@query("g10_cycle", sql(f"""select c*n+rn-1 as index, c::int as cycle, case_id from (select *, row_number() over (partition by c order by {_u(31, 'c', 'case_id')}, c, case_id) as rn from
 (select case_id, c, (select count(*) from cases) as n from cases, (select unnest(range(3)) as c))) where c*n+rn-1 < 5*n//2""", "cases"))
def g10(spark, sf):
    n = fx.cases(spark, sf).count()
    return sp.cycle(fx.cases(spark, sf), "case_id", 5 * n // 2, 31)


def _target(spark, sf):
    rows = _attrs(spark, sf).where("category >= '2'").select(*KEY, "category")
    return _indexed(rows)


def _replay(spark, sf):
    return _indexed(_attrs(spark, sf).where("category < '2'").select(*KEY, "category"))


def _indexed(rows):
    from voxelmeter.functions import hash_rank
    out = hash_rank(rows, [], 37, KEY, "event_index")
    return out.withColumn("event_index", F.col("event_index") - 1)


_MX = f"""t as materialized (select *, row_number() over (order by {_u(37, 'case_id', 'finding_id')}, case_id, finding_id)-1 as si from attrs where category>='2'),
 rp as materialized (select *, row_number() over (order by {_u(37, 'case_id', 'finding_id')}, case_id, finding_id)-1 as si from attrs where category<'2'),
 ne as materialized (select least(((select count(*) from t)+7)//8, ((select count(*) from rp)+3)//4) as e),
 mx as materialized (select source, source_index, epoch, case_id, finding_id, category, epoch*12+row_number() over (partition by epoch order by h, source, source_index)-1 as event_index from (
 select *, {_h(41, 'source', 'source_index')} as h from (select 'targeted' as source, si as source_index, si//8 as epoch, case_id, finding_id, category from t, ne where si<8*e union all
 select 'replay', si, si//4, case_id, finding_id, category from rp, ne where si<4*e)))"""


def _mixed(spark, sf):
    t, p = _target(spark, sf), _replay(spark, sf)
    epochs = min(-(-t.count() // 8), -(-p.count() // 4))  # the last one may be partial
    return sp.mix_schedule(t, p, "event_index", 12, 2 / 3, epochs, 41)


@query("g11_mix_schedule", sql("select * from mx", "attrs", extra=_MX))
def g11(spark, sf):
    return _mixed(spark, sf)


@query("g11_audit_schedule", sql("""select epoch, source, count(*) as rows, min(event_index) as first, max(event_index) as last, count(distinct category) as categories,
 case source when 'targeted' then 8 else 4 end::bigint as expected,
 count(*)=case source when 'targeted' then 8 else 4 end and min(event_index)//12=epoch and max(event_index)//12=epoch as ok from mx group by epoch, source""", "attrs", extra=_MX))
def g11b(spark, sf):
    return sp.audit_schedule(_mixed(spark, sf), "event_index", 12, 2 / 3, "category")


@query("g12_is_prefix", sql("""select n as rows, greatest(0,n-(select count(*) from mx)) as absent, (select count(*) from mx where category='2a')  as different,
 (select min(event_index) from mx where category='2a') as first_difference, (select count(*) from mx where category='2a')=0 as is_prefix from (select count(*) as n from mx)""", "attrs", extra=_MX))
def g12(spark, sf):
    long = _mixed(spark, sf)
    short = long.withColumn("category", F.when(F.col("category") == "2a", "2z").otherwise(F.col("category")))
    return sp.is_prefix(short, long, "event_index", ["source", "category", *KEY])


@query("g12_paired", sql("""select unnest(['source','category']) as field, (select count(*) from mx) as indices, (select count(*) from mx where source='replay') as unpaired,
 unnest([0, (select count(*) from mx where category='2b')]) as different""", "attrs", extra=_MX))
def g12b(spark, sf):
    a = _mixed(spark, sf)
    b = a.where("source = 'targeted'").withColumn("category", F.when(F.col("category") == "2b", None).otherwise(F.col("category")))
    return sp.paired(a, b, "event_index", ["source", "category"])


@query("g12_slice", sql("""select source, source_index, epoch, case_id, finding_id, category, event_index as source_event_index, event_index-12 as event_index from mx
 where event_index>=12 and event_index < (select count(*) from mx)-12""", "attrs", extra=_MX))
def g12c(spark, sf):
    mixed = _mixed(spark, sf)
    return sp.schedule_slice(mixed, "event_index", 12, mixed.count() - 24)


@query("g13_round_robin", sql("select case_id, ((row_number() over (order by case_id)-1)%6)::int as shard from cases", "cases"))
def g13(spark, sf):
    return sp.shards(fx.cases(spark, sf), 6, "case_id")


@query("g13_longest_first", sql("""select case_id, rows, (case when ((p-1)//6)%2=1 then 5-(p-1)%6 else (p-1)%6 end)::int as shard from
 (select case_id, rows, row_number() over (order by rows desc, case_id) as p from (select case_id, count(*) as rows from vox group by 1))""", "vox"))
def g13b(spark, sf):
    size = fx.vox(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"))
    return sp.shards(size, 6, "case_id", "rows")


@query("g14_review_sample", sql(f"""select case_id, finding_id, pixels, 'exception' as reason from findings where pixels=0 union all
 (select case_id, finding_id, pixels, 'sample' from findings where pixels<>0 order by {_u(43, 'case_id', 'finding_id')}, case_id, finding_id limit 25)""", "findings"))
def g14(spark, sf):
    return sp.review_sample(fx.findings(spark, sf).select(*KEY, "pixels"), F.col("pixels") == 0, 25, 43, KEY)


_RV = """rv as materialized (select e.case_id, e.finding_id, e.category, e.candidate_id as policy, round(e.dice-b.dice,12) as delta, e.dice, b.hit as base_hit, e.hit, e.dice=0 as excluded
 from evalc e join evalc b on e.case_id=b.case_id and e.finding_id=b.finding_id where b.candidate_id='m0' and e.candidate_id<>'m0')"""


@query("g14_review_extremes", sql("""select case_id, finding_id, policy, string_agg(distinct reason, '|' order by reason) as reasons from (
 (select case_id, finding_id, policy, 'category_largest_gain' as reason from rv qualify row_number() over (partition by category order by delta desc, case_id, finding_id, policy)=1) union all
 (select case_id, finding_id, policy, 'category_largest_harm' from rv qualify row_number() over (partition by category order by delta, case_id, finding_id, policy)=1) union all
 (select case_id, finding_id, policy, 'lost_hit' from rv where base_hit and not hit qualify row_number() over (partition by case_id, finding_id order by dice, policy)=1) union all
 (select case_id, finding_id, policy, 'completely_excluded' from rv where excluded qualify row_number() over (partition by case_id, finding_id order by dice, policy)=1)) group by 1,2,3""", "evalc", extra=_RV))
def g14b(spark, sf):
    ev = fx.evals_cat(spark, sf)
    base = ev.where("candidate_id = 'm0'").select(*KEY, F.col("dice").alias("bd"), F.col("hit").alias("base_hit"))
    rows = ev.where("candidate_id <> 'm0'").join(base, KEY)
    return sp.review_extremes(rows.select(*KEY, "category", F.col("candidate_id").alias("policy"), F.round(F.col("dice") - F.col("bd"), 12).alias("delta"),
                                          "dice", "base_hit", "hit", (F.col("dice") == 0).alias("excluded")))
