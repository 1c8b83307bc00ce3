"""B1-B16 with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmeter.operators import integrity as ok
from voxelmeter.plans import fixtures as fx
from voxelmeter.plans.fixtures import KEY, VOX, r, sql
from voxelmeter.plans.registry import query
from voxelmeter.session import scratch_path


def _observed(spark, sf):
    """Keys with predictions, the larger ones twice."""
    n = fx.pred(spark, sf).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    extra = fx.finding_keys(spark, sf).where("finding_id = 2").select("case_id", F.lit(9).alias("finding_id"))
    return n.select(*KEY).union(n.where("n > 30").select(*KEY)).union(extra)


@query("b1_align", sql("""select * from (select coalesce(o.case_id,e.case_id) as case_id, coalesce(o.finding_id,e.finding_id) as finding_id,
 unnest(list_filter([case when o.n is null then 'missing' end, case when e.case_id is null then 'extra' end, case when o.n>1 then 'duplicate' end],
 lambda x: x is not null)) as issue, coalesce(o.n,0) as observed, case when e.case_id is null then 0 else 1 end::bigint as expected
 from (select case_id, finding_id, case when n>30 then 2 else 1 end::bigint as n from (select case_id,finding_id,count(*) n from pred group by all)
 union all select case_id, 9, 1 from keys where finding_id=2) o full join keys e on o.case_id=e.case_id and o.finding_id=e.finding_id)""", "pred", "keys"))
def b1(spark, sf):
    return ok.align(_observed(spark, sf), fx.finding_keys(spark, sf), KEY)


@query("b2_recompose", sql(f"""select candidate_id, count(*) as row_findings, {r('avg(dice)')} as row_dice, count(*) filter (hit) as row_hits,
 0::bigint as bad_hit_rows, candidate_id<>'m3' as dice_ok, candidate_id<>'m5' as hits_ok, true as findings_ok, true as category_ok,
 true as hit_rule_ok from evalc group by candidate_id""", "evalc"))
def b2(spark, sf):
    m = F.col("candidate_id")
    rep = fx.catalog(spark, sf).select("candidate_id", (F.col("dice") + F.when(m == "m3", 1e-6).otherwise(0.0)).alias("dice"),
                                       (F.col("hits") + F.when(m == "m5", 1).otherwise(0)).alias("hits"), "findings")
    return ok.recompose(fx.evals_cat(spark, sf), rep)


_JSON = """'{"case_id":'||case_id||',"finding_id":'||finding_id||',"i":'||i||',"j":'||j||',"k":'||k||'}'"""
_FP = f"""select %s sha256(concat_ws(':', count(*), {", ".join(f"sum(('0x'||substr(d,{8 * i + 1},8))::bigint)" for i in range(8))})) as fingerprint, count(*) as rows from
 (select %s sha256({_JSON}) as d from pred) group by all"""


@query("b3_fingerprint", sql(_FP % ("", ""), "pred"))
def b3(spark, sf):
    return ok.fingerprint(fx.pred(spark, sf))


@query("b3_fingerprint_by_case", sql(_FP % ("case_id,", "case_id,"), "pred"))
def b3b(spark, sf):
    return ok.fingerprint(fx.pred(spark, sf).select(*VOX), by=["case_id"])


@query("b4_manifest_diff")
def b4(spark, sf):
    path = scratch_path(spark, "files")
    fx.catalog(spark, sf).repartition(4, "candidate_id").write.json(path)
    now = ok.manifest(spark, path)
    first = now.agg(F.min("path")).first()[0]
    stored = now.where(F.col("path") != first).withColumn("bytes", F.col("bytes")).union(
        now.where(F.col("path") == first).select(F.lit("gone.json"), "bytes", "sha256"))
    return ok.manifest_diff(stored, now).select(F.regexp_replace("path", "^part-.*", "new").alias("path"), "status")


@query("b4_manifest_tables", """with a as (select o_orderkey::varchar||'.bin' as path, o_custkey as bytes, sha256(o_orderpriority) as sha256,
 o_orderstatus as s, o_totalprice as t from orders)
 select path, case when s='P' then 'unexpected' when t>400000 then 'missing' when t<50000 then 'size_mismatch' else 'hash_mismatch' end as status
 from a where s='P' or t>400000 or t<50000 or (s='F' and t>300000)""")
def b4b(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".bin")).alias("path"),
                                             F.col("o_custkey").alias("bytes"), F.sha2("o_orderpriority", 256).alias("sha256"),
                                             F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("t"))
    stored = o.where("s <> 'P'").select("path", "bytes", "sha256")
    change = F.when(F.col("t") < 50000, F.col("bytes") + 1).otherwise(F.col("bytes"))
    digest = F.when((F.col("s") == "F") & (F.col("t") > 300000), F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256"))
    now = o.where("s = 'P' or t <= 400000").select("path", change.alias("bytes"), digest.alias("sha256"))
    return ok.manifest_diff(stored, now)


@query("b5_readiness", """select o_orderpriority as priority, count(*) as expected, count(*) filter (there and not inc) as present,
 count(*) filter (there and inc) as in_progress, count(*) filter (not there) as missing,
 coalesce(sum(o_custkey) filter (there and not inc),0)::bigint as bytes, count(*)=count(*) filter (there and not inc) as ready
 from (select *, o_orderstatus<>'P' as there, o_totalprice<60000 as inc from orders) group by 1""")
def b5(spark, sf):
    o = fx.table(spark, sf, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    present = o.where("o_orderstatus <> 'P'").select("path", F.col("o_custkey").alias("bytes"), (F.col("o_totalprice") < 60000).alias("incomplete"))
    return ok.readiness(o.select(F.col("o_orderpriority").alias("priority"), "path"), present, ["priority"])


def _ledger(spark, sf):
    """Hash chains of at most eight events of a user; some rows are altered after hashing."""
    from voxelmeter.functions import bucketed_row_number
    ev = fx.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    rows = bucketed_row_number(ev, ["user_id"], F.floor(F.col("event_id") / 4096), ["event_id"], "n")
    rows = rows.select("user_id", F.floor((F.col("n") - 1) / 8).alias("block"), ((F.col("n") - 1) % 8 + 1).alias("seq"), "event_id", "event_type")
    packed = rows.groupBy("user_id", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "event_id", "event_type"))).alias("e"))
    text = lambda e, prev: F.concat_ws("|", e["seq"].cast("string"), e["event_id"].cast("string"), e["event_type"], F.coalesce(prev, F.lit("")))
    chain = F.aggregate("e", F.array().cast("array<string>"), lambda acc, e: F.concat(
        acc, F.array(F.sha2(text(e, F.when(F.size(acc) > 0, F.element_at(acc, -1))), 256))))
    out = packed.withColumn("h", chain).select("user_id", "block", F.posexplode("e").alias("p", "x"), "h")
    prev = F.when(F.col("p") > 0, F.element_at("h", F.greatest(F.col("p"), F.lit(1))))
    out = out.select("user_id", "block", "x.*", prev.alias("previous_hash"), F.element_at("h", F.col("p") + 1).alias("hash"))
    forged = F.when((F.col("event_type") == "signup") & (F.col("seq") > 1), F.sha2(F.lit("forged"), 256)).otherwise(F.col("previous_hash"))
    shown = F.when(F.col("event_type") == "error", "edited").otherwise(F.col("event_type"))
    return out.withColumn("previous_hash", forged).withColumn("event_type", shown)


@query("b6_validate_chain", """select user_id, ((n-1)//8)::bigint as block, (n-1)%8+1 as seq, true as seq_ok, not (event_type='signup' and (n-1)%8>0) as link_ok,
 event_type<>'error' and not (event_type='signup' and (n-1)%8>0) as hash_ok
 from (select *, row_number() over (partition by user_id order by event_id) as n from events)""")
def b6(spark, sf):
    text = F.concat_ws("|", F.col("seq").cast("string"), F.col("event_id").cast("string"), "event_type", F.coalesce("previous_hash", F.lit("")))
    return ok.validate_chain(_ledger(spark, sf), ["user_id", "block"], "seq", text)


def _segments(spark, sf):
    """Journals with lost rows, a repeated overlap and a few contradicting copies."""
    j = fx.journal(spark, sf).select("arm", F.expr("global_update + global_update div 100").alias("global_update"), "loss")  # a gap after each 99 updates
    again = j.where("loss > 50").withColumn("loss", F.when(F.col("loss") > 200, F.col("loss") + 1).otherwise(F.col("loss")))
    return j.union(again)


_J = "j as materialized (select arm, global_update + global_update // 100 as global_update, loss from journal)"


@query("b7_merge_journal", sql("select arm, global_update, round(loss,6)+0.0 as loss from j where loss <= 200", "journal", extra=_J))
def b7(spark, sf):
    return ok.merge_journal(_segments(spark, sf), ["arm"], "global_update", ["loss"])[0]


@query("b7_journal_report", sql("""select *, gaps=0 and first_index=1 as contiguous from (select arm, count(*) as indices, count(*) filter (loss>50) as duplicates,
 count(*) filter (loss>200) as conflicts, count(*) filter (global_update<>1 and before is distinct from global_update-1) as gaps,
 min(global_update) as first_index, max(global_update) as last_index from
 (select *, lag(global_update) over (partition by arm order by global_update) as before from j) group by arm)""", "journal", extra=_J))
def b7b(spark, sf):
    return ok.merge_journal(_segments(spark, sf), ["arm"], "global_update", ["loss"])[1]


@query("b7_reconcile", sql("""select arm, state, count(*) as n, max(global_update) as last from (select *, case when global_update <=
 (select max(global_update)//2 from journal x where x.arm=journal.arm) then 'kept' else 'archived' end as state from journal) group by all""", "journal"))
def b7c(spark, sf):
    j = fx.journal(spark, sf).select("arm", "global_update", "loss")
    cursor = j.groupBy("arm").agg(F.expr("max(global_update) div 2").alias("cursor"))
    return ok.reconcile(j, cursor, ["arm"], "global_update").groupBy("arm", "state").agg(
        F.count(F.lit(1)).alias("n"), F.max("global_update").alias("last"))


@query("b8_geometry_check", sql(f"""select case_id, case_id%7<>3 as shape_identical, {r("case when case_id%5=1 then 0.01/0.7 else 0 end")} as max_index_error_vox,
 {r("case when case_id%7=3 then null when case_id%5=1 then 0.01 else 0 end")} as max_corner_mm,
 case when ax>0 then 'right' else 'left' end as handedness_a, case when ax>0 then 'right' else 'left' end as handedness_b,
 case when case_id%7=3 then 'SHAPE_MISMATCH' when case_id%5=1 then 'INDEX_TRANSFORM_MISMATCH' else 'PASS' end as index_grid_status,
 case when case_id%7=3 then 'SHAPE_MISMATCH' when case_id%5=1 then 'WORLD_CORNER_MISMATCH' else 'PASS' end as world_header_status from hdr""", "hdr"))
def b8(spark, sf):
    a = fx.headers(spark, sf)
    off = F.when(F.col("case_id") % 5 == 1, 0.01).otherwise(0.0)
    moved = F.transform("affine", lambda x, n: F.when(n == 7, x + off).otherwise(x))
    shape = F.when(F.col("case_id") % 7 == 3, F.array(F.lit(12), F.lit(10), F.lit(9))).otherwise(F.col("shape"))
    return ok.geometry_check(a, a.withColumn("affine", moved).withColumn("shape", shape), 1e-4, 1e-3)


@query("b9_label_qc", sql(f"""select case_id, count(distinct label) filter (label>0) as labels, sum((label>0)::int)::bigint as foreground,
 sum((label<>floor(label))::int)::bigint as non_integer_voxels, count(distinct label) filter (label>0 and label not in (10,11,12)) as unexpected_labels,
 {r('sum((label>0)::int)/960')} as foreground_fraction, array_to_string(list_filter([case when sum((label<>floor(label))::int)>0 then 'non_integer' end,
 case when count(*) filter (label>0 and label not in (10,11,12))>0 then 'unexpected' end], lambda x: x is not null),'|') as flags from
 (select case_id, case when i=0 and j=0 and case_id%4=0 then label+0.5 else label end as label from anatomy) group by case_id""", "anatomy"))
def b9(spark, sf):
    v = fx.anatomy(spark, sf)
    odd = (F.col("i") == 0) & (F.col("j") == 0) & (F.col("case_id") % 4 == 0)
    v = v.select("case_id", F.when(odd, F.col("label") + 0.5).otherwise(F.col("label")).cast("double").alias("label"))
    return ok.label_qc(v, v.where("label in (10, 11, 12)").select("label").distinct(), fx.headers(spark, sf))


_U = "(('0x'||substr(sha256('%s:'||%s),1,13))::bigint/4503599627370496.0)"


@query("b10_reconcile_counts", sql(f"""select case_id, finding_id, pixels, counted, case when counted=0 and pixels=0 then 'ok' when counted=0 then 'missing'
 when counted=pixels then 'ok' else 'pixel_mismatch' end as status from (select f.case_id, f.finding_id, f.pixels, count(g.i) as counted from findings f
 left join (select * from gt where k<>7) g on g.case_id=f.case_id and g.finding_id=f.finding_id
 where f.case_id in (select case_id from cases order by {_U % (20260905, 'case_id')} limit 20) group by all)""", "findings", "gt", "cases"))
def b10(spark, sf):
    return ok.reconcile_counts(fx.findings(spark, sf), fx.gt(spark, sf).where("k <> 7"), 20, 20260905)


@query("b11_variant_audit", sql("""select case_id, finding_id, variant, case when variant='v1' and category='1a' then 'category' when variant='v2' and entities>3 then 'entities' end
 as first_difference, ((variant='v1' and category='1a')::int + (variant='v2' and entities>3)::int) as differences,
 case when pixels not between 1 and 20 then 'pixels' end as first_out_of_range from findings, (select unnest(['v1','v2']) as variant)""", "findings"))
def b11(spark, sf):
    f = fx.findings(spark, sf).select(*KEY, "category", "entities", "pixels")
    rows = f.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in ("base", "v1", "v2")])))
    rows = rows.withColumn("category", F.when((F.col("variant") == "v1") & (F.col("category") == "1a"), "1z").otherwise(F.col("category")))
    rows = rows.withColumn("entities", F.when((F.col("variant") == "v2") & (F.col("entities") > 3), None).otherwise(F.col("entities")))
    return ok.variant_audit(rows, KEY, "variant", "base", ["category", "entities", "pixels"], {"pixels": (1, 20)})


@query("b12_mad_flags", """with a as (select *, median(l_extendedprice) over (partition by l_returnflag) as med from lineitem),
 b as (select *, abs(l_extendedprice-med) as dev from a), c as (select *, median(dev) over (partition by l_returnflag) as mad from b)
 select l_returnflag, """ + f"""count(*) as rows, {r('max(med)', 4)} as median, {r('max(mad)', 4)} as mad, count(*) filter (0.6745*dev/mad > 1.2) as outliers from c group by 1""")
def b12(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    out = ok.mad_flags(rows, ["l_orderkey", "l_linenumber"], "l_extendedprice", ["l_returnflag"], 1.2)
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("median"), 4).alias("median"),
                                           F.round(F.max("mad"), 4).alias("mad"), F.count_if("outlier").alias("outliers"))


@query("b12_pair_flags", sql(f"""select case_id, l::double as left_ml, rr::double as right_ml, {r("case when l>0 and rr>0 then least(l,rr)/greatest(l,rr) end")} as volume_ratio,
 array_to_string(list_filter([case when l=0 or rr=0 then 'empty' end, case when l>0 and rr>0 and least(l,rr)/greatest(l,rr)<0.6 then 'left_right_volume_imbalance' end,
 case when least(l,rr)<9 then 'very_small_volume' end], lambda x: x is not null),'|') as flags from
 (select case_id, count(*) filter (i<6) as l, count(*) filter (i>=6) as rr from gt group by 1)""", "gt"))
def b12b(spark, sf):
    v = fx.gt(spark, sf).groupBy("case_id").agg(F.count_if(F.col("i") < 6).cast("double").alias("left_ml"),
                                                F.count_if(F.col("i") >= 6).cast("double").alias("right_ml"))
    return ok.pair_flags(v, ["case_id"], "left_ml", "right_ml", 9.0, 0.6)


_DIM = 64


@query("b13_embedding_audit", """select * from (select coalesce(d.doc_id, e.vec_id) as id, unnest(list_filter([case when e.vec_id is null then 'missing' end,
 case when d.doc_id is null then 'unused' end, case when len(e.embedding)<>64 then 'wrong_dimension' end,
 case when len(list_filter(e.embedding, lambda x: isnan(x) or isinf(x)))>0 then 'non_finite' end,
 case when list_sum(list_transform(e.embedding, lambda x: x*x))=0 then 'zero' end], lambda x: x is not null)) as problem
 from documents d full join embeddings e on d.doc_id=e.vec_id)""")
def b13(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    bank = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return ok.embedding_audit(docs, bank, _DIM, "id")


@query("b14_dedup_candidates", sql(f"""select path, candidate_id, {r('dice')} as dice, eligible, case when rn=1 then 'canonical' when dice=first then 'duplicate' else 'conflict' end as status
 from (select *, row_number() over (partition by candidate_id order by path) rn, first_value(dice) over (partition by candidate_id order by path) as first from
 (select c.candidate_id, p.path||c.candidate_id as path, case when p.path='z/' and c.candidate_id in ('m2','m6') then dice+0.5 else dice end as dice, eligible
 from catalog c, (select unnest(['a/','b/','z/']) as path) p where not (p.path='b/' and candidate_id='m4')))""", "catalog"))
def b14(spark, sf):
    rows = fx.catalog(spark, sf).withColumn("p", F.explode(F.array(F.lit("a/"), F.lit("b/"), F.lit("z/"))))
    rows = rows.where("not (p = 'b/' and candidate_id = 'm4')").withColumn("path", F.concat("p", "candidate_id"))
    bad = (F.col("p") == "z/") & F.col("candidate_id").isin("m2", "m6")
    rows = rows.withColumn("dice", F.when(bad, F.col("dice") + 0.5).otherwise(F.col("dice")))
    sig = F.sha2(F.to_json(F.struct("dice", "hits", "findings")), 256)
    out = ok.dedup_candidates(rows, F.col("content_hash"), sig, ["path"], F.col("eligible"))
    return out.select("path", "candidate_id", "dice", "eligible", "status")


@query("b15_storage_estimate", sql(f"""select split, target, count(*) as cases, sum(v)::bigint as voxels, max(v) as max_voxels,
 {r('sum(v*4)/1073741824.0', 9)} as image_gib, {r('sum(v*n)/1073741824.0', 9)} as target_gib from (select split, target, n,
 greatest(1,round_even(nx*sx/t,0))::bigint*greatest(1,round_even(ny*sy/t,0))::bigint*greatest(1,round_even(nz*sz/t,0))::bigint as v
 from hdr join (select case_id, split, count(*) n from attrs group by all) using (case_id), (values ('iso1',1.0),('iso2',2.0)) x(target,t)) group by all""", "hdr", "attrs"), digits=9)
def b15(spark, sf):
    per = fx.with_attributes(fx.finding_keys(spark, sf)).groupBy("case_id", "split").agg(F.count(F.lit(1)).alias("n"))
    return ok.storage_estimate(fx.headers(spark, sf).join(per, "case_id"), {"iso1": (1.0,) * 3, "iso2": (2.0,) * 3}, "n", ["split"])


@query("b16_leakage", sql("""select kind, value, string_agg(distinct split, '|' order by split) as splits from (
 select split, unnest(['case','patient']) as kind, unnest([case_id::varchar, patient::varchar]) as value from attrs) where not (kind='patient' and value='4')
 group by kind, value having count(distinct split)>1""", "attrs"))
def b16(spark, sf):
    f = fx.with_attributes(fx.finding_keys(spark, sf))
    allowed = f.where("patient = 4").select(F.lit("patient").alias("kind"), F.col("patient").cast("string").alias("value")).distinct()
    return ok.leakage(f, "split", {"case": F.col("case_id"), "patient": F.col("patient")}, allowed)
