"""C1-C27 over the fixture masks, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmeter.operators import components as comp
from voxelmeter.operators import distance as dist
from voxelmeter.operators import grids, masks
from voxelmeter.plans import fixtures as fx
from voxelmeter.plans.fixtures import KEY, VOX, dice_sql, r, sql
from voxelmeter.plans.registry import query

# pred/gt flags per voxel, shared by several twins
FLAGS = """flags as materialized (select case_id,finding_id,i,j,k, max(p) as p, max(g) as g from
 (select *, 1 as p, 0 as g from pred union all select *, 0, 1 from gt) group by all)"""

_C1 = sql(f"""select k.case_id, k.finding_id, coalesce(tp,0) as tp, coalesce(p,0)-coalesce(tp,0) as fp,
 coalesce(g,0)-coalesce(tp,0) as fn, {r(dice_sql('coalesce(tp,0)', 'coalesce(p,0)', 'coalesce(g,0)'))} as dice,
 {dice_sql('coalesce(tp,0)', 'coalesce(p,0)', 'coalesce(g,0)')} >= 0.1 as hit,
 {r("case when coalesce(p,0)>0 then tp/p when coalesce(g,0)=0 then 1.0 else 0.0 end")} as "precision",
 {r("case when coalesce(g,0)>0 then tp/g else 1.0 end")} as recall
 from keys k left join (select case_id,finding_id, sum(p*g)::bigint tp, sum(p)::bigint p, sum(g)::bigint g
 from flags group by all) m using (case_id, finding_id)""", "keys", "pred", "gt", extra=FLAGS)


@query("c1_mask_metrics", _C1)
def c1(spark, sf):
    return masks.mask_metrics(fx.finding_keys(spark, sf), fx.pred_rows(spark, sf), fx.gt_rows(spark, sf))


def _allowed(spark, sf):
    return fx.anatomy(spark, sf).where("label > 0")


def _sup(r):
    """Gated metric columns; ``r`` rounds them or leaves them as they are."""
    return f"""select k.*, {r("(case when pn+g0=0 then 1.0 else (2*tp+1e-6)/(pn+g0+1e-6) end)")} as dice,
 (case when pn+g0=0 then 1.0 else (2*tp+1e-6)/(pn+g0+1e-6) end) >= 0.1 as hit,
 {r("case when pn>0 then tp/pn else 0 end")} as "precision", {r("case when g0>0 then tp/g0 else 1 end")} as recall,
 {r("case when g0>0 then gn/g0 else 1 end")} as gt_coverage, g0 as gt_voxels, pn as pred_voxels, tp, pn-tp as fp,
 tp0-tp as tp_removed, (p0-tp0)-(pn-tp) as fp_removed, g0>0 and gn=0 as gt_completely_excluded,
 p0>0 and pn=0 as prediction_emptied """


_SUP = _sup(r)
_C2 = sql(_SUP + """ from keys k join (select k.case_id, k.finding_id, coalesce(sum(p*g),0)::bigint tp0,
 coalesce(sum(p),0)::bigint p0, coalesce(sum(g),0)::bigint g0, coalesce(sum(p*g*a),0)::bigint tp,
 coalesce(sum(p*a),0)::bigint pn, coalesce(sum(g*a),0)::bigint gn from keys k left join
 (select f.*, case when label>0 then 1 else 0 end as a from flags f left join anatomy using (case_id,i,j,k)) f
 on f.case_id=k.case_id and f.finding_id=k.finding_id group by all) m using (case_id, finding_id)""".replace("k.*,", ""),
          "keys", "pred", "gt", "anatomy", extra=FLAGS)


@query("c2_supported_metrics", _C2)
def c2(spark, sf):
    return masks.supported_metrics(fx.finding_keys(spark, sf), fx.pred_rows(spark, sf), fx.gt_rows(spark, sf), _allowed(spark, sf))


_C3 = sql(f"""select case_id, finding_id, tp, n_pred-tp as fp, n_gt-tp as fn, {r(dice_sql('base_tp','base_pred','n_gt'))} as base_dice,
 {r(dice_sql('tp','n_pred','n_gt'))} as dice, {r(dice_sql('tp','n_pred','n_gt') + '-' + dice_sql('base_tp','base_pred','n_gt'))} as delta_dice,
 {dice_sql('base_tp','base_pred','n_gt')}>=0.1 as base_hit, {dice_sql('tp','n_pred','n_gt')}>=0.1 as hit,
 fp_removed, fn_recovered, tp_removed, tn_added, edited, {r('edited/greatest(1,touched)')} as edited_fraction_union,
 {r('edited/960.0')} as edited_fraction from (
 select k.case_id, k.finding_id, coalesce(sum(b*y),0)::bigint base_tp, coalesce(sum(b),0)::bigint base_pred,
 coalesce(sum(f*y),0)::bigint tp, coalesce(sum(f),0)::bigint n_pred, coalesce(sum(y),0)::bigint n_gt,
 coalesce(sum(b*(1-f)*(1-y)),0)::bigint fp_removed, coalesce(sum((1-b)*f*y),0)::bigint fn_recovered,
 coalesce(sum(b*(1-f)*y),0)::bigint tp_removed, coalesce(sum((1-b)*f*(1-y)),0)::bigint tn_added,
 coalesce(sum(abs(b-f)),0)::bigint edited, count(m.i) touched
 from keys k left join (select case_id,finding_id,i,j,k, max(b) b, max(f) f, max(y) y from
 (select *,1 b,0 f,0 y from pred union all select *,0,1,0 from final union all select *,0,0,1 from gt) group by all) m
 on m.case_id=k.case_id and m.finding_id=k.finding_id group by all)""", "keys", "pred", "final", "gt")


@query("c3_edit_metrics", _C3)
def c3(spark, sf):
    return masks.edit_metrics(fx.finding_keys(spark, sf), fx.pred_rows(spark, sf), fx.final_rows(spark, sf), fx.gt_rows(spark, sf),
                              fx.headers(spark, sf))


def _domain(spark, sf):
    """Touched voxels of each finding with their anatomy label; lower lobes are certified negative."""
    return fx.vox(spark, sf).select(*VOX).distinct()


def _negative(spark, sf):
    low = fx.anatomy(spark, sf).where("label = 13").select("case_id", "i", "j", "k").hint("merge")  # a grid is never broadcast
    return _domain(spark, sf).join(low, ["case_id", "i", "j", "k"]).select(*VOX)


_C4 = sql("""select d.case_id, d.finding_id, case when y then 1 when n then 0 else -1 end as state,
 case when y and n then 'overlap' else null end as violation, count(*) as voxels from
 (select v.*, g.i is not null as y, v.i>=9 and v.k<>7 as n from (select distinct case_id,finding_id,i,j,k from vox) v
 left join gt g using (case_id,finding_id,i,j,k)) d group by all""", "vox", "gt")


@query("c4_tristate", _C4)
def c4(spark, sf):
    rows = masks.tristate(_domain(spark, sf), fx.gt(spark, sf), _negative(spark, sf))
    return rows.groupBy(*KEY, F.col("state").cast("int").alias("state"), "violation").agg(F.count(F.lit(1)).alias("voxels"))


def _regions(spark, sf):
    """Certified regions of each finding, on voxels outside its known truth."""
    box = fx.anatomy(spark, sf).select("case_id", "i", "j", "k", "label").hint("merge")  # a grid is never broadcast
    rows = fx.pred(spark, sf).join(box, ["case_id", "i", "j", "k"]).join(fx.gt(spark, sf), VOX, "left_anti")
    name = (F.when(F.col("label") == 0, "outside_lung").when(F.col("label") == 13, "contralateral")
            .when(F.col("label") == 12, "ipsilateral").when((F.col("label") == 11) & (F.col("k") == 0), "other_certified"))
    return rows.withColumn("region", name).where("region is not null").select(*VOX, "region")


PARTS = """parts as materialized (select p.case_id,p.finding_id,p.i,p.j,p.k, case when g.i is not null then 'known_positive'
 when p.k=7 then 'outside_lung' when p.i>=9 then 'contralateral' when p.i>=6 then 'ipsilateral'
 when p.i>=3 and p.k=0 then 'other_certified' else 'unknown' end as part
 from pred p left join gt g using (case_id,finding_id,i,j,k))"""
_NAMES = masks.PARTITION
_C5 = sql("select k.case_id, k.finding_id, "
          + ", ".join(f"coalesce({n},0) as {n}_voxels" for n in _NAMES) + ", "
          + ", ".join(r(f"coalesce({n},0)*sx*sy*sz") + f" as {n}_mm3" for n in _NAMES)
          + f""", coalesce(off,0) as off_location_voxels, {r('coalesce(off,0)*sx*sy*sz')} as off_location_mm3,
 coalesce(off+other_certified,0) as certified_fp_voxels, coalesce(total,0) as predicted_voxels,
 {r('off/total')} as off_location_fraction,
 {r('known_positive/nullif(known_positive+off+other_certified,0)')} as certified_precision
 from keys k left join (select *, ipsilateral+contralateral+outside_lung as off from (select case_id, finding_id, count(*) total, """
          + ", ".join(f"count(*) filter (part='{n}') as {n}" for n in _NAMES)
          + """ from parts group by case_id, finding_id)) c using (case_id, finding_id) join hdr h using (case_id)""",
          "keys", "pred", "gt", "hdr", extra=PARTS)


@query("c5_partition_fp", _C5)
def c5(spark, sf):
    parts = masks.partition_words(fx.pred_rows(spark, sf), fx.gt_rows(spark, sf), _regions(spark, sf))
    return masks.partition_summary(fx.finding_keys(spark, sf), parts, fx.headers(spark, sf))


# Components by recursive label spreading inside SQL: reach every voxel from every earlier one.
REACH = """edges as materialized (select a.case_id, a.finding_id, a.i*100+a.j*10+a.k as a, b.i*100+b.j*10+b.k as b
 from pred a join pred b on a.case_id=b.case_id and a.finding_id=b.finding_id and abs(a.i-b.i)<=1 and abs(a.j-b.j)<=1
 and abs(a.k-b.k)<=1),
 reach as (select case_id, finding_id, a, a as b from edges union
 select r.case_id, r.finding_id, r.a, e.b from reach r join edges e on r.case_id=e.case_id and r.finding_id=e.finding_id
 and r.b=e.a where e.b > r.a or true),
 lab as materialized (select case_id, finding_id, b as v, min(a) as root from reach group by all),
 comp as materialized (select case_id, finding_id, v//100 as i, (v//10)%10 as j, v%10 as k,
 dense_rank() over (partition by case_id, finding_id order by root) as component from lab)"""


def _labels(spark, sf):
    return comp.components(fx.pred(spark, sf))


@query("c6_components", sql("""select case_id, finding_id, i::int as i, j::int as j, k::int as k, component from comp""",
                            "pred", extra=REACH, recursive=True))
def c6(spark, sf):
    return _labels(spark, sf)


_C7 = sql(f"""select c.case_id, c.finding_id, component, voxels, {r('ci')} as centroid_i, {r('cj')} as centroid_j, {r('ck')} as centroid_k,
 i_lo::int as i_lo, j_lo::int as j_lo, k_lo::int as k_lo, i_hi::int as i_hi, j_hi::int as j_hi, k_hi::int as k_hi,
 {r('ax*ci - ax*6')} as centroid_x, {r('sy*cj')} as centroid_y, {r('sz*ck')} as centroid_z,
 {r('least(ax*i_lo, ax*(i_hi-1))-ax*6')} as x_min, {r('sy*j_lo')} as y_min, {r('sz*k_lo')} as z_min,
 {r('greatest(ax*i_lo, ax*(i_hi-1))-ax*6')} as x_max, {r('sy*(j_hi-1)')} as y_max, {r('sz*(k_hi-1)')} as z_max,
 {r('voxels*sx*sy*sz')} as mm3, {r('voxels/sum(voxels) over w')} as share, {r('max(voxels) over w/sum(voxels) over w')} as largest_share
 from (select case_id, finding_id, component, count(*) voxels, avg(i) ci, avg(j) cj, avg(k) ck, min(i) i_lo, min(j) j_lo, min(k) k_lo,
 max(i)+1 i_hi, max(j)+1 j_hi, max(k)+1 k_hi from comp group by all) c join hdr using (case_id)
 window w as (partition by c.case_id, c.finding_id)""", "pred", "hdr", extra=REACH, recursive=True)


@query("c7_component_records", _C7)
def c7(spark, sf):
    return comp.component_records(_labels(spark, sf), fx.headers(spark, sf))


_REL = PARTS + ",\n" + REACH + """,
 rel as materialized (select case_id, finding_id, component, count(*) as voxels, """ + ", ".join(
    f"count(*) filter (part='{n}') as {n}" for n in _NAMES) + """ from comp join parts using (case_id, finding_id, i, j, k)
 group by case_id, finding_id, component)"""
_C8 = sql("select case_id, finding_id, component, voxels, " + ", ".join(_NAMES) + """,
 ipsilateral+contralateral+outside_lung as off_location, known_positive=0 as detached,
 known_positive=0 and ipsilateral+contralateral+outside_lung>0 as detached_off_location,
 ipsilateral+contralateral+outside_lung+other_certified=voxels as fully_certified from rel""",
          "pred", "gt", extra=_REL, recursive=True)


@query("c8_component_relations", _C8)
def c8(spark, sf):
    parts = masks.partition_words(fx.pred_rows(spark, sf), fx.gt_rows(spark, sf), _regions(spark, sf))
    return comp.component_relations(_labels(spark, sf), parts)


_GREACH = (REACH.replace("pred a", "gt a").replace("pred b", "gt b").replace("edges", "gedges").replace("reach", "greach")
           .replace("lab ", "glab ").replace("from lab", "from glab").replace("comp as", "gcomp as"))
_C8B = sql(f"""select k.case_id, k.finding_id, coalesce(components,0) as components, coalesce(detached,0) as detached,
 coalesce(dof,0) as detached_off_location, coalesce(gtc,0) as gt_components, coalesce(rec,0) as recalled,
 {r('detached/nullif(components,0)')} as detached_fraction, {r('rec/nullif(gtc,0)')} as candidate_recall
 from keys k left join (select case_id, finding_id, count(*) components, count(*) filter (known_positive=0) detached,
 count(*) filter (known_positive=0 and ipsilateral+contralateral+outside_lung>0) dof from rel group by all) a using (case_id, finding_id)
 left join (select case_id, finding_id, count(*) gtc, count(*) filter (seen) rec from (select g.case_id, g.finding_id, g.component,
 bool_or(p.i is not null) seen from gcomp g left join pred p using (case_id, finding_id, i, j, k) group by all) group by all) b
 using (case_id, finding_id)""", "keys", "pred", "gt", extra=_REL + ",\n" + _GREACH, recursive=True)


@query("c8_candidate_recall", _C8B)
def c8b(spark, sf):
    parts = masks.partition_words(fx.pred_rows(spark, sf), fx.gt_rows(spark, sf), _regions(spark, sf))
    rel = comp.component_relations(_labels(spark, sf), parts)
    return comp.relation_summary(fx.finding_keys(spark, sf), rel, comp.components(fx.gt(spark, sf)), fx.pred(spark, sf))


_C9 = sql("""select case_id, finding_id, count(distinct component) as a_components, count(distinct root) as b_components,
 0::bigint as mismatch_voxels, true as same_partition from comp join
 (select case_id, finding_id, v//100 as i, (v//10)%10 as j, v%10 as k, root from lab) using (case_id, finding_id, i, j, k)
 group by all""", "pred", extra=REACH, recursive=True)


@query("c9_same_partition", _C9)
def c9(spark, sf):
    labels = _labels(spark, sf)
    renamed = labels.withColumn("component", F.xxhash64("component"))
    return comp.same_partition(labels, renamed)


_C10 = sql(f"""select case_id, finding_id, i, j, k, {r('ax*i-ax*6')} as x, {r('sy*j')} as y, {r('sz*k')} as z, {r('sx*sy*sz')} as voxel_mm3,
 case when ax*i-ax*6 > 1e-6 then 'right' when ax*i-ax*6 < -1e-6 then 'left' else 'midline' end as side
 from gt join hdr using (case_id)""", "gt", "hdr")


@query("c10_to_world", _C10)
def c10(spark, sf):
    return masks.to_world(fx.gt(spark, sf), fx.headers(spark, sf))


_C10B = sql(f"""select case_id, 0 as voxel_axis, {r('ax')} as mm_per_voxel,
 case when ax>0 then 'right' else 'left' end as positive_direction from hdr""", "hdr")


@query("c10_left_right_axis", _C10B)
def c10b(spark, sf):
    return masks.left_right_axis(fx.headers(spark, sf))


@query("c10_reindex", sql("select case_id, finding_id, k as i, (9-j)::int as j, i as k from gt", "gt"))
def c10c(spark, sf):
    return masks.reindex(fx.gt(spark, sf), fx.headers(spark, sf), (2, 1, 0), (False, True, False))


_DIST = """sup as materialized (select case_id, i, j, k, sx, sy, sz from anatomy join hdr using (case_id) where label = 11),
 q as materialized (select distinct case_id, i, j, k from pred),
 bx as materialized (select case_id, min(i) li, max(i) hi, min(j) lj, max(j) hj, min(k) lk, max(k) hk from sup group by all)"""
_C11 = sql(f"""select q.case_id, q.i, q.j, q.k, {r("case when d<=cap+1e-6 then d else 1e9 end")} as dist_mm, {r('box')} as box_mm from
 (select q.case_id, q.i, q.j, q.k, min(sqrt(((s.i-q.i)*sx)**2+((s.j-q.j)*sy)**2+((s.k-q.k)*sz)**2)) d, 5.0 as cap,
 any_value(greatest(0,(li-q.i)*sx,(q.i-hi)*sx,(lj-q.j)*sy,(q.j-hj)*sy,(lk-q.k)*sz,(q.k-hk)*sz)) as box
 from q join sup s using (case_id) join bx using (case_id) group by all) q""", "pred", "anatomy", "hdr", extra=_DIST)


@query("c11_support_distance", _C11)
def c11(spark, sf):
    support = fx.anatomy(spark, sf).where("label = 11")
    out = dist.support_distance(fx.pred(spark, sf), support, fx.headers(spark, sf), 5.0)
    far = F.lit(1e9)
    return out.withColumn("dist_mm", F.least("dist_mm", far)).withColumn("box_mm", F.least("box_mm", far))


_C12 = sql("""select case_id, i, j, k from anatomy a join hdr using (case_id) where exists (select 1 from g1 s
 where s.case_id=a.case_id and abs(s.i-a.i)<=2 and abs(s.j-a.j)<=2 and abs(s.k-a.k)<=1
 and ((s.i-a.i)*sx)**2+((s.j-a.j)*sy)**2+((s.k-a.k)*sz)**2 <= (1.5+1e-7)**2)""", "gt", "anatomy", "hdr",
           extra="g1 as materialized (select distinct case_id, i, j, k from gt)")


@query("c12_dilate", _C12)
def c12(spark, sf):
    return dist.dilate(fx.gt(spark, sf).select("case_id", "i", "j", "k"), fx.headers(spark, sf), 1.5)


_C12B = sql("""select p.* from pred p join hdr using (case_id) where exists (select 1 from g1 s
 where s.case_id=p.case_id and ((s.i-p.i)*sx)**2+((s.j-p.j)*sy)**2+((s.k-p.k)*sz)**2 <= (1.5+1e-7)**2)""", "gt", "pred", "hdr",
            extra="g1 as materialized (select distinct case_id, i, j, k from gt)")


@query("c12_gate", _C12B)
def c12b(spark, sf):
    grown = dist.dilate(fx.gt(spark, sf).select("case_id", "i", "j", "k"), fx.headers(spark, sf), 1.5)
    return dist.gate(fx.pred(spark, sf), grown)


def _routing(spark, sf):
    """Two families: the whole lung for all findings, one lobe where the category is diffuse."""
    f = fx.findings(spark, sf)
    lobe = F.when(F.col("category").startswith("1"), "upper")
    return (f.select(*KEY, F.lit("all_lung").alias("family"), F.lit("lung").alias("scope"))
            .union(f.select(*KEY, F.lit("prompt_fine").alias("family"), lobe.alias("scope"))))


def _supports(spark, sf):
    a = fx.anatomy(spark, sf)
    return (a.where("label > 0").select("case_id", F.lit("lung").alias("scope"), "i", "j", "k")
            .union(a.where("label = 10").select("case_id", F.lit("upper").alias("scope"), "i", "j", "k")))


MARGINS = [0.0, 1.0, 2.0, 5.0]
def _c13(r):
    return sql(_sup(r).replace("select k.*,", "select case_id, finding_id, family, shape, margin_mm, selected,") + """ from (
 select z.case_id, z.finding_id, family, shape, m::double as margin_mm, scope is not null as selected, coalesce(sum(p*g),0)::bigint tp0,
 coalesce(sum(p),0)::bigint p0, coalesce(sum(g),0)::bigint g0,
 coalesce(sum(p*g*ok),0)::bigint tp, coalesce(sum(p*ok),0)::bigint pn, coalesce(sum(g*ok),0)::bigint gn from
 (select * from rt, (select unnest(['mask','bbox']) as shape), (select unnest([0.0,1.0,2.0,5.0]) as m)) z left join
 (select *, case when scope is null then 1 when case shape when 'mask' then dm else db end <= m+1e-7 then 1 else 0 end as ok
 from dd, (select unnest(['mask','bbox']) as shape), (select unnest([0.0,1.0,2.0,5.0]) as m)) d
 using (case_id, finding_id, family, scope_key, shape, m) group by all)""",
           "attrs", "pred", "gt", "hdr", extra=FLAGS + """,
 rt as materialized (select case_id, finding_id, 'all_lung' as family, 'lung' as scope, 'lung' as scope_key from attrs union all
 select case_id, finding_id, 'prompt_fine', case when category like '1%' then 'upper' end, coalesce(case when category like '1%' then 'upper' end,'-') from attrs),
 dd as materialized (select f.case_id, f.finding_id, family, scope_key, f.i, f.j, f.k, p, g,
 sqrt((greatest(0, f.i - case when scope='upper' then 2 else 11 end)*sx)**2 + (greatest(0, f.k-6)*sz)**2) as dm,
 greatest(greatest(0, f.i - case when scope='upper' then 2 else 11 end)*sx, greatest(0, f.k-6)*sz) as db
 from flags f join rt on f.case_id=rt.case_id and f.finding_id=rt.finding_id join hdr h on h.case_id=f.case_id)""").replace(
    "case when scope is null then 1 when case shape", "case when scope_key='-' then 1 when case shape")


_C13 = _c13(r)


@query("c13_margin_sweep", _C13)
def c13(spark, sf):
    return dist.margin_sweep(fx.finding_keys(spark, sf), fx.pred(spark, sf), fx.gt(spark, sf), _routing(spark, sf),
                             _supports(spark, sf), fx.headers(spark, sf), MARGINS)


_C14 = sql(f"""select case_id, finding_id, sum(n)::bigint as voxels, count(*) filter (label>0) as labels_touched,
 arg_max(label, n*100-label) filter (label>0) as best_label, coalesce(max(n) filter (label>0),0) as best_voxels,
 {r('coalesce(sum(n) filter (label=0),0)/sum(n)')} as background_share,
 {r('coalesce(sum(n) filter (label in (10,11)),0)/sum(n)')} as left_share,
 {r('coalesce(sum(n) filter (label in (12,13,14)),0)/sum(n)')} as right_share from
 (select case_id, finding_id, label, count(*) n from gt join anatomy using (case_id,i,j,k) group by all) group by all""",
           "gt", "anatomy")


@query("c14_label_overlap", _C14)
def c14(spark, sf):
    return masks.label_overlap(fx.gt(spark, sf), fx.anatomy(spark, sf), {"left": [10, 11], "right": [12, 13, 14]})


def _occupied(spark, sf):
    """Labels of the voxels touched by a case, so that presence and volume vary."""
    touched = fx.gt(spark, sf).select("case_id", "i", "j", "k").distinct()
    return fx.anatomy(spark, sf).join(touched, ["case_id", "i", "j", "k"], "left_semi")


_C15 = sql(f"""select label, count(*) as cases_present, sum(n)::bigint as voxels, {r('sum(n*sx*sy*sz)', 4)} as volume_mm3,
 min(n) as min_voxels, max(n) as max_voxels, {r('median(n)')} as median_voxels,
 {r('count(*)/(select count(*) from cases)')} as present_fraction from (select case_id, label, count(*) n from anatomy semi join
 (select distinct case_id,i,j,k from gt) using (case_id,i,j,k) where label>0 group by all) join hdr using (case_id) group by label""",
           "gt", "anatomy", "hdr")


@query("c15_label_presence", _C15)
def c15(spark, sf):
    out = masks.label_presence(_occupied(spark, sf), fx.headers(spark, sf))
    return out.withColumn("volume_mm3", F.round("volume_mm3", 4))


_OUT = """ofind as materialized (select a.case_id, a.finding_id, a.category, count(g.i) as gt_voxels,
 count(*) filter (g.i is not null and (g.k=7 or g.i>=9)) as outside_voxels from attrs a left join gt g
 on g.case_id=a.case_id and g.finding_id=a.finding_id group by all)"""


def _lung_part(spark, sf):
    return fx.anatomy(spark, sf).where("label between 10 and 12")


@query("c16_outside_support", sql(f"select *, {r('outside_voxels/nullif(gt_voxels,0)')} as outside_fraction from ofind",
                                  "attrs", "gt", extra=_OUT))
def c16(spark, sf):
    f = fx.findings(spark, sf).select(*KEY, "category")
    return masks.outside_support(f, fx.gt(spark, sf), _lung_part(spark, sf))


@query("c16_outside_by_case", sql("""select case_id, count(*) as gt_voxels, count(*) filter (k=7 or i>=9) as outside_voxels
 from (select distinct case_id,i,j,k from gt) group by all""", "gt"))
def c16b(spark, sf):
    return masks.outside_by_case(fx.gt(spark, sf), _lung_part(spark, sf))


@query("c16_outside_by_category", sql(f"""select category, count(*) as findings, count(*) filter (outside_voxels>0) as affected,
 sum(outside_voxels)::bigint as outside_voxels, {r('avg(outside_voxels)')} as mean_outside, max(outside_voxels) as max_outside,
 {r('quantile_cont(outside_voxels,0.5)')} as median_outside, {r('quantile_cont(outside_voxels,0.95)')} as p95_outside
 from ofind group by all""", "attrs", "gt", extra=_OUT))
def c16c(spark, sf):
    return masks.outside_by_category(c16(spark, sf))


_OUT20 = sql(f"""select k.case_id, k.finding_id, coalesce(n,0) as gt_voxels, coalesce(o,0) as outside_voxels,
 {r('o/nullif(n,0)')} as outside_fraction from keys k left join (select case_id, finding_id, count(*) n,
 count(*) filter ((greatest(0,i-5)*sx)**2+(greatest(0,k-6)*sz)**2 > (2+1e-7)**2) o from gt join hdr using (case_id) group by all)
 using (case_id, finding_id)""", "keys", "gt", "hdr")


@query("c16_outside_margin", _OUT20)
def c16d(spark, sf):
    lung = fx.anatomy(spark, sf).where("label in (10, 11)").select("case_id", "i", "j", "k")
    return masks.outside_support(fx.finding_keys(spark, sf), fx.gt(spark, sf), dist.dilate(lung, fx.headers(spark, sf), 2.0))


_LH = grids.LOW + grids.HIGH
_C17 = sql("select i.*, " + ", ".join(f"greatest(0, o.{c}-i.{c}) as deficit_{c}" for c in grids.LOW) + ", "
           + ", ".join(f"greatest(0, i.{c}-o.{c}) as deficit_{c}" for c in grids.HIGH)
           + ", greatest(" + ",".join([f"0,o.{c}-i.{c}" for c in grids.LOW] + [f"0,i.{c}-o.{c}" for c in grids.HIGH])
           + ") as expansion, greatest(" + ",".join([f"0,o.{c}-i.{c}" for c in grids.LOW] + [f"0,i.{c}-o.{c}" for c in grids.HIGH])
           + ")=0 as contained from gb i join pb o using (case_id, finding_id)", "gt", "pred",
           extra=",".join(f"""{n} as materialized (select case_id, finding_id, min(i) i_lo, min(j) j_lo, min(k) k_lo,
 max(i) i_hi, max(j) j_hi, max(k) k_hi from {t} group by all)""" for n, t in (("gb", "gt"), ("pb", "pred"))))


@query("c17_bbox_deficits", _C17)
def c17(spark, sf):
    return grids.bbox_deficits(grids.bbox(fx.pred(spark, sf)), grids.bbox(fx.gt(spark, sf)), KEY)


@query("c17_expand_bbox", sql("""select case_id, finding_id, greatest(0,min(i)-2)::int i_lo, greatest(0,min(j)-2)::int j_lo,
 greatest(0,min(k)-2)::int k_lo, least(11,max(i)+2)::int i_hi, least(9,max(j)+2)::int j_hi, least(7,max(k)+2)::int k_hi
 from gt group by all""", "gt"))
def c17b(spark, sf):
    return grids.expand_bbox(grids.bbox(fx.gt(spark, sf)), fx.headers(spark, sf), 2)


@query("c17_expansion_histogram", sql("select category, expansion, count(*) as findings from (" + _C17[_C17.index("select i.*"):].replace(
    "i.*", "i.case_id, i.finding_id") + ") join attrs using (case_id, finding_id) group by all", "attrs", "gt", "pred",
    extra=_C17[_C17.index("gb as"):_C17.index("select i.*")].strip()))
def c17c(spark, sf):
    f = fx.findings(spark, sf).select(*KEY, "category")
    return c17(spark, sf).join(f, KEY).groupBy("category", "expansion").agg(F.count(F.lit(1)).alias("findings"))


_WIN = "least(greatest(value,-1350.0),150.0)"
_C18 = sql(f"select case_id, i, k, {r(f'avg(({_WIN}+1350)/1500)')} as projected from intensity group by all", "intensity")


@query("c18_project_mean", _C18)
def c18(spark, sf):
    return grids.project_values(fx.intensity(spark, sf), "j", "mean", -600.0, 1500.0)


@query("c18_project_p75", sql(f"select case_id, i, k, {r(f'quantile_cont(({_WIN}+1350)/1500, 0.75)')} as projected from intensity group by all",
                              "intensity"))
def c18b(spark, sf):
    return grids.project_values(fx.intensity(spark, sf), "j", "p75", -600.0, 1500.0)


@query("c18_project_errors", sql("""select case_id, finding_id, i, k, case when max(p*g)=1 then 'tp' when max(p*(1-g))=1 and max((1-p)*g)=1
 then 'depth_mismatch' when max(p*(1-g))=1 then 'fp' else 'fn' end as error_class from flags group by all""", "pred", "gt", extra=FLAGS))
def c18c(spark, sf):
    return grids.project_errors(masks.flagged({"p": fx.pred(spark, sf), "g": fx.gt(spark, sf)}), "j")


_OS = """os as materialized (select *, greatest(1, round_even(nx*sx/2.0,0))::int ox, greatest(1, round_even(ny*sy/2.0,0))::int oy,
 greatest(1, round_even(nz*sz/2.0,0))::int oz from hdr)"""
_C19 = sql("""select * from direct union all select distinct g.case_id, g.finding_id, least(floor((i+0.5)*ox/nx),ox-1)::int i,
 least(floor((j+0.5)*oy/ny),oy-1)::int j, least(floor((k+0.5)*oz/nz),oz-1)::int k, true as fallback from gt g join os using (case_id)
 anti join direct d on d.case_id=g.case_id and d.finding_id=g.finding_id""", "gt", "hdr", extra=_OS + """,
 direct as materialized (select distinct g.case_id, g.finding_id, a::int as i, b::int as j, c::int as k, false as fallback from os
 cross join (select unnest(range(12)) a) cross join (select unnest(range(12)) b) cross join (select unnest(range(12)) c) join gt g
 on g.case_id=os.case_id and g.i=floor((a+0.5)*nx/ox) and g.j=floor((b+0.5)*ny/oy) and g.k=floor((c+0.5)*nz/oz)
 where a<ox and b<oy and c<oz)""")


@query("c19_resample_mask", _C19)
def c19(spark, sf):
    return grids.resample_mask(fx.gt(spark, sf), fx.headers(spark, sf), (2.0, 2.0, 2.0))


def _tap(axis, n, o):
    return f"greatest(0.0,({axis}+0.5)*{n}/{o}-0.5)"


_C19B = sql(f"""select case_id, a::int as i, b::int as j, c::int as k, {r('sum(wx*wy*wz*value)')} as value from (
 select o.*, t.value, case when t.i=floor(px) then 1-(px-floor(px)) else 0 end + case when t.i=least(floor(px)+1,nx-1) then px-floor(px) else 0 end as wx,
 case when t.j=floor(py) then 1-(py-floor(py)) else 0 end + case when t.j=least(floor(py)+1,ny-1) then py-floor(py) else 0 end as wy,
 case when t.k=floor(pz) then 1-(pz-floor(pz)) else 0 end + case when t.k=least(floor(pz)+1,nz-1) then pz-floor(pz) else 0 end as wz
 from (select *, {_tap('a', 'nx', 'ox')} as px, {_tap('b', 'ny', 'oy')} as py, {_tap('c', 'nz', 'oz')} as pz from os
 cross join (select unnest(range(12)) a) cross join (select unnest(range(12)) b) cross join (select unnest(range(12)) c)
 where a<ox and b<oy and c<oz) o join intensity t on t.case_id=o.case_id and t.i between floor(px) and floor(px)+1
 and t.j between floor(py) and floor(py)+1 and t.k between floor(pz) and floor(pz)+1) group by all""", "hdr", "intensity", extra=_OS)


@query("c19_resample_image", _C19B)
def c19b(spark, sf):
    return grids.resample_image(fx.intensity(spark, sf), fx.headers(spark, sf), (2.0, 2.0, 2.0))


_BOXED = """boxed as materialized (select t.* from intensity t join (select case_id, min(i) a, max(i) b, min(j) c, max(j) d, min(k) e, max(k) f
 from intensity where value<>0 group by all) using (case_id) where i between a and b and j between c and d and k between e and f)"""


@query("c20_zscore", sql(f"""select case_id,i,j,k, {r('(v-avg(v) over (partition by case_id))/greatest(1e-8,stddev_pop(v) over (partition by case_id))')} as value
 from (select *, least(greatest(value,-1024.0),1024.0) as v from boxed)""", "intensity", extra=_BOXED))
def c20(spark, sf):
    return grids.normalise(fx.intensity(spark, sf), "clip_zscore")


@query("c20_window", sql(f"select case_id,i,j,k, {r(f'({_WIN}+1350)/1500')} as value from boxed", "intensity", extra=_BOXED))
def c20b(spark, sf):
    return grids.normalise(fx.intensity(spark, sf), "window")


_PROF = ", ".join(f"{r(f'quantile_cont(value,{q})')} as p{n}" for n, q in ((5, .05), (25, .25), (50, .5), (75, .75), (95, .95)))
_C21 = sql(f"""select case when grouping(case_id)=0 then 'finding' when grouping(category)=0 then 'category' else 'all' end as scope,
 case when grouping(case_id)=0 then case_id||':'||finding_id when grouping(category)=0 then category else 'all' end as member,
 count(*) as voxels, {r('avg(value)')} as mean, {r('avg((value < -1000)::int)')} as below_floor, {r('avg((value > 400)::int)')} as above_400,
 {r('stddev_pop(value)')} as std, {_PROF} from gt join intensity using (case_id,i,j,k) join attrs using (case_id, finding_id)
 group by grouping sets ((case_id, finding_id), (category), ())""", "gt", "intensity", "attrs")


@query("c21_value_profile", _C21)
def c21(spark, sf):
    return grids.value_profile(fx.findings(spark, sf), fx.intensity(spark, sf), fx.gt(spark, sf),
                               {"below_floor": ("below", -1000.0), "above_400": ("above", 400.0)})


_PT = "struct_pack(i:=i::int,j:=j::int,k:=k::int)"
_C22 = sql(f"""select case_id, finding_id, pos-1 as rank, p.i as i, p.j as j, p.k as k from (select case_id, finding_id,
 unnest(pts) as p, generate_subscripts(pts,1) as pos from (select case_id, finding_id, list_filter(l, lambda x, n: list_position(l, x) = n) as pts from (
 select case_id, finding_id, [arg_min({_PT}, ((i-ci)**2+(j-cj)**2+(k-ck)**2)*4000+i*100+j*10+k), arg_min({_PT}, i*1000+i*100+j*10+k), arg_max({_PT}, i*1000-i*100-j*10-k),
 arg_min({_PT}, j*2000+i*100+j*10+k), arg_max({_PT}, j*2000-i*100-j*10-k), arg_min({_PT}, k*2000+i*100+j*10+k), arg_max({_PT}, k*2000-i*100-j*10-k)] as l
 from gt join (select case_id, finding_id, (min(i)+max(i))/2.0 ci, (min(j)+max(j))/2.0 cj, (min(k)+max(k))/2.0 ck from gt group by all)
 using (case_id, finding_id) group by all)))""", "gt")


@query("c22_positive_points", _C22)
def c22(spark, sf):
    return grids.positive_points(fx.gt(spark, sf))


TILE = (5, 5, 5)


def _starts_py(n, p, overlap=0.5):
    import math
    if n <= p:
        return [-(p - n) // 2]
    count = math.ceil((n - p) / (p * (1 - overlap))) + 1
    return sorted({round(t * (n - p) / (count - 1)) for t in range(count)})


_TS = ", ".join(f"ts{a} as (select unnest({_starts_py(n, p)}) as t{a})" for a, n, p in zip("ijk", fx.SHAPE, TILE))


@query("c23_tiles", sql("select case_id, ti::int as ti, tj::int as tj, tk::int as tk from cases, tsi, tsj, tsk", "cases", extra=_TS))
def c23(spark, sf):
    return grids.tiles(fx.headers(spark, sf), TILE)


_TC = FLAGS + ", " + _TS + """, tc as materialized (select case_id, finding_id, ti::int as ti, tj::int as tj, tk::int as tk, sum(p*g)::bigint as tp,
 sum(p*(1-g))::bigint as fp, sum(g)::bigint as gt, sum(p)>0 as active from flags, tsi, tsj, tsk
 where i>=ti and i<ti+5 and j>=tj and j<tj+5 and k>=tk and k<tk+5 group by all)"""


def _flags(spark, sf):
    return masks.flagged({"p": fx.pred(spark, sf), "g": fx.gt(spark, sf)})


@query("c23_tile_counts", sql("select * from tc", "pred", "gt", extra=_TC))
def c23b(spark, sf):
    return grids.tile_counts(_flags(spark, sf), fx.headers(spark, sf), TILE)


_NT = len(_starts_py(12, 5)) * len(_starts_py(10, 5)) * len(_starts_py(8, 5))
_C23C = sql(f"""select k.case_id, k.finding_id, {_NT} as tiles, 960 as volume, coalesce(cv,0) as covered_volume, coalesce(gv,0) as gt_voxels,
 coalesce(rg,0) as reachable_gt, coalesce(act,0) as active_tiles, coalesce(ina,0) as inactive_tiles_with_gt,
 {r('coalesce(cv,0)/960')} as covered_fraction, {r('rg/nullif(gv,0)')} as reachable_fraction from keys k left join
 (select case_id, finding_id, count(distinct i*100+j*10+k) cv from (select * from tc where active) t, (select unnest(range(12)) i),
 (select unnest(range(10)) j), (select unnest(range(8)) k) where i>=ti and i<ti+5 and j>=tj and j<tj+5 and k>=tk and k<tk+5 group by all) a
 using (case_id, finding_id) left join (select g.case_id, g.finding_id, count(distinct g.i*100+g.j*10+g.k) gv,
 count(distinct case when active then g.i*100+g.j*10+g.k end) rg from gt g left join tc on tc.case_id=g.case_id and tc.finding_id=g.finding_id
 and i>=ti and i<ti+5 and j>=tj and j<tj+5 and k>=tk and k<tk+5 group by all) b using (case_id, finding_id) left join
 (select case_id, finding_id, count(*) filter (active) act, count(*) filter (not active and gt>0) ina from tc group by all) c
 using (case_id, finding_id)""", "keys", "pred", "gt", extra=_TC)


@query("c23_tile_coverage", _C23C)
def c23c(spark, sf):
    return grids.tile_coverage(fx.finding_keys(spark, sf), _flags(spark, sf), fx.headers(spark, sf), TILE)


def _proposals(spark, sf):
    pool = fx.scores(spark, sf).groupBy(*VOX).agg(F.max("p").alias("score"))
    return grids.topk_nms(pool, fx.headers(spark, sf), 3, 2, TILE)


@query("c24_topk_nms")
def c24(spark, sf):
    return _proposals(spark, sf)


@query("c24_proposal_metrics")
def c24b(spark, sf):
    return grids.proposal_metrics(_proposals(spark, sf), fx.gt(spark, sf), fx.finding_keys(spark, sf), TILE, (1, 3))


_C25 = sql(f"""select category, count(*) as findings, count(*) filter (tp>0) as findings_with_overlap, count(*) filter (g=0) as undefined,
 {r('avg((tp>0)::int)')} as overlap_rate, {r('avg(tp/nullif(g,0))')} as mean_coverage, {r('sum(tp)/nullif(sum(g),0)')} as pooled_coverage,
 {r('avg(p/nullif(g,0))')} as mean_volume_ratio, {r('sum(p)/nullif(sum(g),0)')} as pooled_volume_ratio,
 {r('quantile_cont(tp/nullif(g,0),0.5)')} as median_coverage, {r('quantile_cont(p/nullif(g,0),0.5)')} as median_volume_ratio from
 (select category, a.case_id, a.finding_id, coalesce(sum(f.p*f.g),0) tp, coalesce(sum(f.p),0) p, coalesce(sum(f.g),0) g from attrs a
 left join flags f on f.case_id=a.case_id and f.finding_id=a.finding_id group by all) group by category""", "attrs", "pred", "gt", extra=FLAGS)


@query("c25_proposal_coverage", _C25)
def c25(spark, sf):
    m = masks.mask_metrics(fx.findings(spark, sf).select(*KEY, "category"), fx.pred(spark, sf), fx.gt(spark, sf))
    counts = m.select("category", "tp", (F.col("tp") + F.col("fp")).alias("pred"), (F.col("tp") + F.col("fn")).alias("gt"))
    return grids.proposal_coverage(counts, ["category"])


_C26 = sql("""select m.* from (select 'a' as candidate_id, * from pred union all select 'b', * from final) m
 join attrs using (case_id, finding_id) where candidate_id = case when category like '1%' then 'a' else 'b' end""", "pred", "final", "attrs")


@query("c26_compose", _C26)
def c26(spark, sf):
    both = (fx.pred(spark, sf).select(F.lit("a").alias("candidate_id"), *VOX)
            .union(fx.final(spark, sf).select(F.lit("b").alias("candidate_id"), *VOX)))
    f = fx.findings(spark, sf).select(*KEY, "category")
    winners = f.select("category").distinct().withColumn(
        "candidate_id", F.when(F.col("category").startswith("1"), "a").otherwise("b"))
    return masks.compose(both, winners, f)


def _patches(spark, sf):
    """Predicted voxels cut into overlapping 8-wide slabs along i, with a value per slab."""
    start = F.explode(F.array(F.lit(-2), F.lit(2), F.lit(6)))
    rows = fx.pred(spark, sf).withColumn("si", start).where("i >= si and i < si + 8")
    value = ((F.col("i") * 7 + F.col("j") * 3 + F.col("k") + F.col("si") * 5 + 20) % 50) / 10.0
    return rows.select(*KEY, "si", F.lit(0).alias("sj"), F.lit(0).alias("sk"), (F.col("i") - F.col("si")).alias("i"), "j", "k",
                       value.alias("value"))


_PAT = """pat as materialized (select *, (((i*7+j*3+k+si*5+20)%50)/10.0)::double as value from pred, (select unnest([-2,2,6]) as si)
 where i>=si and i<si+8)"""


@query("c27_stitch_max", sql(f"select case_id, finding_id, i, j, k, {r('max(value)')} as value from pat group by all", "pred", extra=_PAT))
def c27(spark, sf):
    return grids.stitch(_patches(spark, sf), fx.headers(spark, sf), (8, 10, 8), "max")


@query("c27_stitch_gaussian", sql(f"""select case_id, finding_id, i, j, k, {r('sum(w*value)/sum(w)')} as value from (select *,
 greatest(1e-7, exp(-0.5*(((i-si-3.5)/1.0)**2 + ((j-4.5)/1.25)**2 + ((k-3.5)/1.0)**2))/exp(-0.5*(0.25+0.16+0.25))) as w from pat) group by all""", "pred", extra=_PAT))
def c27b(spark, sf):
    return grids.stitch(_patches(spark, sf), fx.headers(spark, sf), (8, 10, 8), "gaussian")


@query("c27_paste_back", sql("""select case_id, finding_id, (k+3)::int as i, (j+2)::int as j, (i+1)::int as k from pred""", "pred"))
def c27c(spark, sf):
    crops = fx.cases(spark, sf).select("case_id", F.lit(1).alias("i_lo"), F.lit(2).alias("j_lo"), F.lit(3).alias("k_lo"))
    return grids.paste_back(fx.pred(spark, sf), crops, (2, 1, 0))
