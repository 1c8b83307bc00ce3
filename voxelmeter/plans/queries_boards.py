"""I1-I12 with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmeter.functions import CATEGORIES
from voxelmeter.operators import boards as bd
from voxelmeter.operators import masks
from voxelmeter.plans import atlas, queries_masks
from voxelmeter.plans import fixtures as fx
from voxelmeter.plans.fixtures import KEY, r, sql
from voxelmeter.plans.queries_stats import _boot
from voxelmeter.plans.registry import query

_CATS = "(select unnest(" + str(CATEGORIES) + ") as category)"
_OV = """ov as materialized (select candidate_id, round(avg(dice),12) as dice, count(*) filter (hit) as hits, count(*) as findings, count(distinct case_id) as cases, count(*) filter (hit)/count(*) as hit_rate from eval group by 1),
 oc as materialized (select candidate_id, avg(m) as case_mean_dice from (select candidate_id, case_id, avg(dice) as m from eval group by 1,2) group by 1)"""


@query("i1_rank_overall", sql(f"""select candidate_id, {r('dice')} as dice, hits, findings, cases, {r('case_mean_dice')} as case_mean_dice, {r('hit_rate')} as hit_rate,
 (row_number() over (order by dice desc, hits desc, candidate_id))::int as rank, {r('max(dice) over ()')} as best_dice, {r('min(dice) over ()')} as worst_dice,
 {r('max(dice) over ()-min(dice) over ()')} as spread from ov join oc using (candidate_id)""", "eval", extra=_OV))
def i1(spark, sf):
    return bd.rank_overall(fx.evals(spark, sf))


_PC = _OV + f""", pc as materialized (select candidate_id, category, dice, coalesce(hits,0) as hits, coalesce(findings,0) as findings, o.dice as overall_dice from (select * exclude (dice, hits, findings), m.dice, m.hits, m.findings
 from (select candidate_id, category from ov, {_CATS}) left join (select candidate_id, category, round(avg(dice),12) as dice, count(*) filter (hit) as hits, count(*) as findings from evalc group by all) m using (candidate_id, category)) x
 join ov o using (candidate_id))""".replace("dice, coalesce(hits,0) as hits, coalesce(findings,0) as findings, o.dice", "x.dice, coalesce(x.hits,0) as hits, coalesce(x.findings,0) as findings, o.dice").replace("select * exclude (dice, hits, findings), m.dice", "select candidate_id, category, m.dice")


@query("i2_rank_category", sql(f"""select candidate_id, category, {r('dice')} as dice, hits, findings, {r('overall_dice')} as overall_dice, case when dice is not null then
 (row_number() over (partition by category order by dice desc nulls last, overall_dice desc, candidate_id))::int end as rank from pc""", "eval", "evalc", extra=_PC))
def i2(spark, sf):
    return bd.rank_category(fx.evals_cat(spark, sf), CATEGORIES)


@query("i3_submitter_rank", sql(f"""select entry_id, submitter, {r('dice')} as dice, pending, case when not pending and rn=1 then rank end as rank,
 case when pending then 'pending' when rn=1 then 'ranked' else 'secondary' end as state from (select *, case when not pending and rn=1 then
 row_number() over (partition by pending, rn order by dice desc, entry_id) end as rank from (select *, row_number() over (partition by pending, lower(submitter) order by dice desc, entry_id) as rn from submissions))""", "submissions"))
def i3(spark, sf):
    return bd.submitter_rank(fx.submissions(spark, sf), "submitter", "dice", "entry_id", F.col("pending"))


def _wide(v, by):
    return f"select {by}, {r(f'avg({v})')} as overall, " + ", ".join(f"{r(f'''avg({v}) filter (category='{c}')''')} as c_{c}" for c in CATEGORIES)


@query("i4_wide", sql(_wide("dice", "candidate_id") + " from evalc group by 1", "evalc"))
def i4(spark, sf):
    return bd.wide(fx.evals_cat(spark, sf), CATEGORIES)


@query("i4_wide_thresholds", sql(_wide("case when dice>=t then 1.0 else 0.0 end", "candidate_id, t::double as threshold") + " from evalc, (select unnest([0.1,0.25,0.5]) as t) group by 1,2", "evalc"))
def i4b(spark, sf):
    rows = fx.evals_cat(spark, sf).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.1, 0.25, 0.5)])))
    rows = rows.withColumn("reached", F.when(F.col("dice") >= F.col("threshold"), 1.0).otherwise(0.0))
    return bd.wide(rows, CATEGORIES, "reached", ["candidate_id", "threshold"])


_HH = """hm as materialized (select candidate_id, metric, round(avg(dice),12) as dice, count(*) filter (hit) as hits, count(*) as findings, candidate_id<'m4' as mine from
 (select *, unnest(['overall', category]) as metric from evalc) group by all),
 hb as materialized (select * from hm qualify row_number() over (partition by metric, mine order by dice desc, hits desc, candidate_id)=1)"""


@query("i5_head_to_head", sql(f"""select a.metric, a.findings, a.candidate_id as mine_candidate_id, {r('a.dice')} as mine_dice, a.hits as mine_hits, b.candidate_id as theirs_candidate_id, {r('b.dice')} as theirs_dice,
 b.hits as theirs_hits, {r('a.dice-b.dice')} as delta, case when abs(a.dice-b.dice)<=1e-12 then 'tie' when a.dice>b.dice then 'mine' else 'theirs' end as winner from hb a join hb b using (metric) where a.mine and not b.mine""",
                              "evalc", extra=_HH))
def i5(spark, sf):
    ev = fx.evals_cat(spark, sf)
    return bd.head_to_head(ev.where("candidate_id < 'm4'"), ev.where("candidate_id >= 'm4'"), ("mine", "theirs"))


_C13R = queries_masks._c13(lambda x, digits=6: f"({x})")
_C13B = _C13R[_C13R.index("with "):]
_SW = ("sweepr as materialized (" + _C13B[_C13B.rindex("\nselect case_id"):] + ")")
_I6X = _C13B[len("with "):_C13B.rindex("\nselect case_id")]
_I6 = f"""with {_I6X}, {_SW}, base as materialized (select case_id, finding_id, dice as base_dice, hit as base_hit from (
 select k.case_id, k.finding_id, case when coalesce(p+g,0)=0 then 1.0 else (2*t+1e-6)/(p+g+1e-6) end as dice, (case when coalesce(p+g,0)=0 then 1.0 else (2*t+1e-6)/(p+g+1e-6) end)>=0.1 as hit from
 (select case_id, finding_id from attrs) k left join (select case_id, finding_id, sum(p)::bigint p, sum(g)::bigint g, sum(p*g)::bigint t from flags group by all) f using (case_id, finding_id))),
 pr as materialized (select s.*, family||':'||shape||':'||margin_mm as policy, base_dice, base_hit, category, s.dice-base_dice as d from sweepr s join base using (case_id, finding_id) join attrs using (case_id, finding_id)),
 ps as materialized (select *, unnest(['all', category]) as stratum from pr)
 select policy, stratum, count(*) as n, count(*) filter (selected) as selected, {r('avg(base_dice)')} as before, {r('avg(dice)')} as after, {r('avg(d)')} as delta, count(*) filter (base_hit) as hits_before,
 count(*) filter (hit) as hits_after, count(*) filter (d>1e-7) as improved, count(*) filter (d < -1e-7) as worsened, count(*) filter (abs(d)<=1e-7) as unchanged, count(*) filter (hit and not base_hit) as hit_gains,
 count(*) filter (base_hit and not hit) as hit_losses, sum(tp_removed)::bigint as tp_removed, sum(fp_removed)::bigint as fp_removed, count(*) filter (prediction_emptied) as prediction_emptied,
 {r('avg("precision")')} as "precision", {r('avg(recall)')} as recall, {r('min(d)')} as worst_delta, {r('max(d)')} as best_delta, {r('avg(base_dice) filter (selected)')} as selected_before,
 {r('avg(dice) filter (selected)')} as selected_after, {r('avg(gt_coverage) filter (selected)')} as gt_coverage_mean, {r('min(gt_coverage) filter (selected)')} as gt_coverage_min,
 count(*) filter (selected and gt_coverage<0.95) as gt_coverage_below95, count(*) filter (selected and gt_completely_excluded) as gt_completely_excluded, any_value(pcd) as per_case_dice, any_value(nc) as cases
 from ps join (select policy, stratum, {r('avg(m)')} as pcd, count(*) as nc from (select policy, stratum, case_id, avg(dice) m from ps group by all) group by 1,2) using (policy, stratum) group by 1,2"""


@query("i6_policy_summary", _I6)
def i6(spark, sf):
    swept = queries_masks.c13(spark, sf)
    base = masks.mask_metrics(fx.finding_keys(spark, sf), fx.pred(spark, sf), fx.gt(spark, sf)).select(
        *KEY, F.col("dice").alias("base_dice"), F.col("hit").alias("base_hit"))
    cats = fx.with_attributes(fx.finding_keys(spark, sf)).select(*KEY, "category")
    rows = swept.join(base, KEY).join(cats, KEY).withColumn("policy", F.concat_ws(":", "family", "shape", F.col("margin_mm").cast("string")))
    return bd.policy_summary(rows, ["policy"], [F.col("category")])


_SL = """bigf as materialized (select case_id, finding_id from gt group by all having count(*)>=10),
 sl as materialized (select candidate_id, dice, hit, unnest(list_filter(['overall', case when category in ('2a','2b','2d') then 'target' else 'non_target' end, case when b then 'subset_total' end,
 case when b and category not in ('2a','2b','2d') then 'sentinel_non_target' end], lambda x: x is not null)) as slice from (select e.*, g.case_id is not null as b from evalc e left join bigf g using (case_id, finding_id)))"""


@query("i7_slice_summary", sql(f"select candidate_id, slice, count(*) as findings, {r('avg(dice)')} as dice, count(*) filter (hit) as hits, {r('count(*) filter (hit)/count(*)')} as hit_rate from sl group by 1,2", "evalc", "gt", extra=_SL))
def i7(spark, sf):
    big = fx.gt(spark, sf).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    return bd.slice_summary(fx.evals_cat(spark, sf), ["candidate_id"], ["2a", "2b", "2d"], big)


_MS = """ms as materialized (select category as arm, substr(candidate_id,2)::bigint as epoch, floor(avg(dice)*50+1e-9)/50 as dice, count(*) filter (hit)/count(*) as hit_rate from evalc group by all)"""


def _milestones(spark, sf):
    """Candidates read as milestones of each category's arm; coarse dice, so that ties occur."""
    return fx.evals_cat(spark, sf).groupBy(F.col("category").alias("arm"), F.substring("candidate_id", 2, 9).cast("bigint").alias("epoch")).agg(
        (F.floor(F.avg("dice") * 50 + 1e-9) / 50).alias("dice"), (F.count_if("hit") / F.count(F.lit(1))).alias("hit_rate"))


@query("i8_select_milestone", sql(f"""select m.arm, m.epoch, {r('m.dice')} as dice, {r('m.hit_rate')} as hit_rate, {r('m.dice-z.dice')} as delta_from_start from
 (select * from ms qualify row_number() over (partition by arm order by dice desc, hit_rate desc, epoch)=1) m join (select arm, dice from ms where epoch=0) z using (arm)""", "evalc", extra=_MS))
def i8(spark, sf):
    return bd.select_milestone(_milestones(spark, sf), ["arm"])


@query("i9_trajectory", sql(f"""select arm, epoch, {r('dice')} as dice, {r('hit_rate')} as hit_rate, {r('dice-first_value(dice) over w')} as from_first, {r('dice-lag(dice) over w')} as from_previous from ms
 window w as (partition by arm order by epoch)""", "evalc", extra=_MS))
def i9(spark, sf):
    return bd.trajectory(_milestones(spark, sf), ["arm"], "epoch", "dice")


@query("i9_matched_deltas", sql(f"""select a.global_update, a.arm, {r('a.loss')} as loss, {r('b.loss')} as baseline_value, {r('a.loss-b.loss')} as delta from journal a join journal b using (global_update)
 where b.arm='view' and a.arm<>'view'""", "journal"))
def i9b(spark, sf):
    j = fx.journal(spark, sf).select("arm", "global_update", "loss")
    return bd.matched_deltas(j, "arm", "view", "global_update", "loss")


@query("i10_timing", sql(f"""select arm, global_update, {r('loss')} as seconds, {r('sum(loss) over (partition by arm order by global_update)')} as cumulative_seconds from journal""", "journal"))
def i10(spark, sf):
    return bd.timing(fx.journal(spark, sf), ["arm"], "global_update", "loss", 4, chunk=128)[0]


@query("i10_timing_totals", sql(f"""select arm, count(*) as updates, {r('sum(loss)')} as total_seconds, {r('sum(loss)/count(*)')} as seconds_per_update, {r('count(*)*4/sum(loss)')} as samples_per_second from journal group by 1""", "journal"))
def i10b(spark, sf):
    return bd.timing(fx.journal(spark, sf), ["arm"], "global_update", "loss", 4)[1]


_AN = queries_masks._NAMES
_C5B = queries_masks._C5
_I11X = ",\n".join([queries_masks.FLAGS, queries_masks._REL, queries_masks._GREACH]) + f""",
 mm as materialized (select k.case_id, k.finding_id, coalesce(sum(p*g),0)::bigint tp, coalesce(sum(p),0)::bigint np, coalesce(sum(g),0)::bigint ng, coalesce(sum(p*(case when f.k<>7 then 1 else 0 end)),0)::bigint ins
 from keys k left join flags f on f.case_id=k.case_id and f.finding_id=k.finding_id group by all),
 pq as materialized (select case_id, finding_id, {", ".join(f"count(*) filter (part='{n}') as {n}" for n in _AN)} from parts group by 1,2),
 rc as materialized (select case_id, finding_id, count(*) comps, count(*) filter (known_positive=0) det, count(*) filter (known_positive=0 and ipsilateral+contralateral+outside_lung>0) dof from rel group by 1,2),
 gc as materialized (select case_id, finding_id, count(*) gtc, count(*) filter (seen) rec from (select g.case_id, g.finding_id, g.component, bool_or(p.i is not null) seen from gcomp g left join pred p using (case_id, finding_id, i, j, k) group by all) group by 1,2),
 atl as materialized (select case_id, finding_id, category, case when np+ng=0 then 1.0 else 2*tp/(np+ng) end as dice, np, ng, np=0 as prediction_empty, tp/nullif(ng,0) as kpr, np*sx*sy*sz as mm3, category<>'1a' as sup,
 coalesce(known_positive,0) kp, coalesce(ipsilateral+contralateral+outside_lung,0) as off, coalesce(other_certified,0) oc, coalesce(unknown,0) unk, sx*sy*sz as unit, coalesce(comps,0) comps, coalesce(det,0) det, coalesce(dof,0) dof, coalesce(gtc,0) gtc,
 coalesce(rec,0) rec, ins/nullif(np,0) as anat from mm join attrs using (case_id, finding_id) join hdr using (case_id) left join pq using (case_id, finding_id) left join rc using (case_id, finding_id) left join gc using (case_id, finding_id))"""
_I11 = sql(f"""select case_id, finding_id, category, {r('dice')} as dice, dice>=0.1 as hit, prediction_empty, np as prediction_voxels, ng as known_positive_voxels, {r('kpr')} as known_positive_recall, {r('mm3')} as predicted_mm3,
 {r('case when sup then kp/nullif(kp+off+oc,0) end')} as certified_precision, case when sup then off+oc end as certified_fp_voxels, unk as unknown_voxels, case when sup then off end as off_location_voxels,
 {r('case when sup then off*unit end')} as off_location_mm3, {r('case when sup then off/nullif(np,0) end')} as off_location_fraction, comps as components, det as detached, case when sup then dof end as detached_off_location,
 {r('det/nullif(comps,0)')} as detached_fraction, gtc as gt_components, rec as recalled, {r('rec/nullif(gtc,0)')} as candidate_recall, {r('anat')} as anatomy_fraction from atl""",
           "keys", "attrs", "pred", "gt", "hdr", extra=_I11X, recursive=True)


def _atlas(spark, sf):
    f = fx.with_attributes(fx.finding_keys(spark, sf)).select(*KEY, "category")
    lung = fx.anatomy(spark, sf).where("label > 0")
    return atlas.error_atlas(f, fx.pred(spark, sf), fx.gt(spark, sf), queries_masks._regions(spark, sf), fx.headers(spark, sf), lung, f.where("category <> '1a'"))


@query("i11_error_atlas", _I11)
def i11(spark, sf):
    return _atlas(spark, sf)


_MET = {"dice": "dice", "hit": "(dice>=0.1)::int", "known_positive_recall": "kpr", "certified_precision": "case when sup then kp/nullif(kp+off+oc,0) end", "predicted_mm3": "mm3",
        "off_location_fraction": "case when sup then off/nullif(np,0) end", "detached_fraction": "det/nullif(comps,0)", "candidate_recall": "rec/nullif(gtc,0)", "anatomy_fraction": "anat"}
_TOT = {"prediction_voxels": "np", "known_positive_voxels": "ng", "certified_fp_voxels": "case when sup then off+oc end", "unknown_voxels": "unk", "off_location_voxels": "case when sup then off end",
        "components": "comps", "detached": "det", "detached_off_location": "case when sup then dof end"}
_I11S = sql(f"""select 'mean' as kind, metric, {r('estimate', 4)} as value, observations, {r('ci_low', 4)} as ci_low, {r('ci_high', 4)} as ci_high from es join bt using (metric) union all
 select 'total', unnest({list(_TOT)}), unnest([{','.join(f'sum({v})::double' for v in _TOT.values())}]), unnest([{','.join(f'count({v})' for v in _TOT.values())}]), null, null from atl""",
            "keys", "attrs", "pred", "gt", "hdr", extra=_I11X + f""",
 src as materialized (select case_id, unnest({list(_MET)}) as metric, unnest([{','.join(f'({v})::double' for v in _MET.values())}]) as v from atl),""" + _boot("src", 77, 100, None), recursive=True)


@query("i11_atlas_summary", _I11S, digits=4)
def i11b(spark, sf):
    from voxelmeter.session import checkpointed
    return atlas.atlas_summary(checkpointed(_atlas(spark, sf)), 100, 77)


@query("i12_roster", sql(f"""select candidate_id, {r('dice')} as dice, hits, findings, content_hash, eligible, (row_number() over (order by dice desc, hits desc, candidate_id))::int as rank from catalog where eligible
 order by dice desc, hits desc, candidate_id limit 3""", "catalog"))
def i12(spark, sf):
    return bd.roster(fx.catalog(spark, sf), 3)


_I12 = """ra as materialized (select *, row_number() over (order by dice desc, hits desc, candidate_id)::int as rank from catalog where eligible qualify row_number() over (order by dice desc, hits desc, candidate_id)<=3),
 rb as materialized (select *, row_number() over (order by hits desc, candidate_id)::int as rank from catalog qualify row_number() over (order by hits desc, candidate_id)<=3),
 rd as materialized (select candidate_id, count(*) as parts from (select candidate_id, case_id from eval group by all having sum(hit::int)=3) group by 1)"""


@query("i12_merge_rosters", sql("""select coalesce(a.candidate_id,b.candidate_id) as candidate_id, case when a.candidate_id is null then 'second' when b.candidate_id is null then 'first' else 'both' end as origin,
 a.rank as rank_a, b.rank as rank_b, coalesce(parts,0) as parts, coalesce(parts,0)>=15 as ready from ra a full join rb b on a.candidate_id=b.candidate_id left join rd on rd.candidate_id=coalesce(a.candidate_id,b.candidate_id)""",
                                "catalog", "eval", extra=_I12))
def i12b(spark, sf):
    c = fx.catalog(spark, sf)
    second = bd.roster(c.withColumn("dice", F.col("hits").cast("double")).withColumn("eligible", F.lit(True)), 3)
    ready = fx.evals(spark, sf).groupBy("candidate_id", "case_id").agg(F.count_if("hit").alias("h")).where("h = 3")
    return bd.merge_rosters(bd.roster(c, 3), second, ready, 15)
