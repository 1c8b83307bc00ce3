"""A1-A10 over files that the queries write from the given tables into the shared folder."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from voxelmeter.plans import fixtures as fx
from voxelmeter.plans.fixtures import KEY, r, sql
from voxelmeter.plans.registry import query
from voxelmeter.session import scratch_path
from voxelmeter.sources import census, markdown, sinks, volumes
from voxelmeter.sources.score_arrays import array_shapes, file_system, read_score_arrays


def _cases_json(spark, sf):
    """One nested record per case, the shape the census scan reads."""
    rows = fx.prompts(spark, sf).join(fx.findings(spark, sf).select(*KEY, "pixels"), KEY)
    entry = F.struct(F.col("finding_id").cast("string").alias("k"), "prompt", "category", "pixels", "entities")
    grouped = rows.groupBy("case_id", "split").agg(F.collect_list(entry).alias("e"))
    pick = lambda f: F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], x[f])))
    return grouped.select("split", F.col("case_id").alias("split_index"), F.concat(F.lit("case_"), "case_id").alias("name"),
                          pick("prompt").alias("findings"), pick("category").alias("categories"),
                          pick("pixels").alias("pixels"), pick("entities").alias("entity_counts"))


_A1 = sql("""select split, case_id as split_index, 'case_'||case_id as case_id, finding_id,
 (row_number() over (partition by p.case_id order by finding_id)-1)::int as channel, category, prompt, pixels, entities
 from prompts p join (select case_id, finding_id, pixels from findings) using (case_id, finding_id)""", "prompts", "findings")


@query("a1_read_census", _A1)
def a1(spark, sf):
    path = scratch_path(spark, "census")
    _cases_json(spark, sf).write.json(path)
    return census.read_census(spark, path, layout="lines")


@query("a1_flatten_census", _A1)
def a1b(spark, sf):
    return census.flatten_census(_cases_json(spark, sf))


@query("a2_read_evals", sql("select candidate_id, 'case_'||case_id as case_id, finding_id, round(dice,6)+0.0 as dice, hit from eval", "eval"))
def a2(spark, sf):
    path = scratch_path(spark, "evals")
    ev = fx.evals(spark, sf)
    entry = F.struct(F.concat(F.lit("finding_"), F.col("finding_id")).alias("k"),
                     F.struct(F.col("dice").alias("global_dice"), F.col("hit").alias("global_hit")).alias("v"))
    # One file per candidate and case, as an evaluator that runs case by case would leave them.
    cases = ev.groupBy("candidate_id", "case_id").agg(F.map_from_entries(F.collect_list(entry)).alias("findings"))
    rows = cases.select("candidate_id", F.array(F.struct(F.concat(F.lit("case_"), "case_id").alias("file"), "findings")).alias("cases"))
    rows.repartition("candidate_id").write.partitionBy("candidate_id").json(path)
    return census.read_evals(spark, path, r"candidate_id=([^/]+)/", "lines")


def _encode(batches):
    """Volume files (uncompressed, 8-bit labels) from one row per case; a fixture helper."""
    for batch in batches:
        out = []
        for case, points in zip(batch.case_id, batch.points):
            head = bytearray(352)
            struct.pack_into("<i", head, 0, 348)
            struct.pack_into("<8h", head, 40, 3, *fx.SHAPE, 1, 1, 1, 1)
            struct.pack_into("<2h", head, 70, 2, 8)
            struct.pack_into("<8f", head, 76, 1.0, 0.7, 0.7, 1.0 + (case % 3) * 0.5, 1, 1, 1, 1)
            struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
            head[344:348] = b"n+1\0"
            body = bytearray(fx.SHAPE[0] * fx.SHAPE[1] * fx.SHAPE[2])
            for p in points:
                body[p] = 1
            out.append({"path": str(case), "content": bytes(head + body)})
        yield pd.DataFrame(out, columns=["path", "content"])


def _volume_files(spark, sf):
    at = (F.col("i") + F.col("j") * fx.SHAPE[0] + F.col("k") * fx.SHAPE[0] * fx.SHAPE[1]).cast("int")
    points = fx.pred(spark, sf).select("case_id", at.alias("at")).groupBy("case_id").agg(F.collect_set("at").alias("points"))
    return points.mapInPandas(_encode, "path string, content binary")


@query("a3_decode_voxels", sql("select distinct case_id::varchar as path, 0 as channel, i, j, k, 1.0::double as value from pred", "pred"))
def a3(spark, sf):
    return volumes.decode_volumes(_volume_files(spark, sf))[1]


@query("a3_decode_headers", sql(f"""select case_id::varchar as path, '12,10,8' as shape, {r('sx', 4)} as sx, {r('sz', 4)} as sz, 'u1' as dtype,
 1.0::double as slope, 0.0::double as intercept, 'RAS' as axis_codes from hdr where case_id in (select case_id from pred)""", "hdr", "pred"))
def a3b(spark, sf):
    head = volumes.decode_volumes(_volume_files(spark, sf))[0]
    return head.select("path", F.array_join("shape", ",").alias("shape"), F.round(F.col("spacing")[0], 4).alias("sx"),
                       F.round(F.col("spacing")[2], 4).alias("sz"), "dtype", "slope", "intercept", "axis_codes")


def _chunks(spark, sf):
    """Dense per-case values as chunks of 128, one copy per candidate."""
    at = F.col("i") * 80 + F.col("j") * 8 + F.col("k")
    rows = fx.intensity(spark, sf).select("case_id", at.alias("at"), "value")
    rows = rows.withColumn("candidate_id", F.explode(F.array(F.lit("m0"), F.lit("m1"))))
    chunk = F.floor(F.col("at") / 128)
    packed = rows.groupBy("candidate_id", "case_id", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("c"))
    return packed.select("candidate_id", "case_id", F.lit(0).alias("finding_id"), "chunk", (F.col("chunk") * 128).cast("int").alias("offset"),
                         F.transform("c", lambda x: x["value"].cast("float")).alias("values"))


@query("a4_explode_chunks", sql(f"""select candidate_id, case_id, 0 as finding_id, i*80+j*8+k as voxel, {r('value')} as score
 from intensity, (select unnest(['m0','m1']) as candidate_id)""", "intensity"))
def a4(spark, sf):
    return census.explode_chunks(_chunks(spark, sf))


@query("a4_chunk_shapes", sql("select case_id, 0 as finding_id, 2::bigint as candidates, 960::bigint as voxels, true as ok from cases", "cases"))
def a4b(spark, sf):
    return census.chunk_shapes(_chunks(spark, sf))


def _stored_arrays(spark, sf):
    """The same values as stored arrays of two findings (the second one higher), a file for each candidate and case."""
    path = scratch_path(spark, "arrays")
    at = F.col("i") * 80 + F.col("j") * 8 + F.col("k")
    rows = fx.intensity(spark, sf).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "value"))).alias("c"))
    rows = rows.select("case_id", F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("candidate_id"), F.transform("c", lambda x: x["value"]).alias("values"))

    def store(batches):
        files, root = file_system(path)
        made = set()
        for batch in batches:
            lists = batch.column("values")
            for n, (case, candidate) in enumerate(zip(batch.column("case_id").to_pylist(), batch.column("candidate_id").to_pylist(), strict=True)):
                # One array at a time, and never as Python numbers.
                grid = lists[n].values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(fx.SHAPE)
                file = io.BytesIO()
                np.save(file, np.stack([grid, grid + 1]))
                folder = f"{root}/{candidate}/cases"
                if folder not in made:
                    files.create_dir(folder)
                    made.add(folder)
                with files.open_output_stream(f"{folder}/{case}.npy") as out:
                    out.write(file.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("case_id")], ["case_id"])
    rows.mapInArrow(store, "case_id long").count()
    return path


@query("a4_read_arrays", sql(f"""select candidate_id, case_id::varchar as case_id, f::int as finding_id, (i*80+j*8+k)//400 as chunk, count(*) as n, {r('sum(value+f)')} as total
 from intensity, (select unnest(['m0','m1']) as candidate_id), (select unnest([0,1]) as f) group by all""", "intensity"))
def a4_arrays(spark, sf):
    chunks = read_score_arrays(spark, _stored_arrays(spark, sf), chunk=400)
    return chunks.select("candidate_id", "case_id", "finding_id", "chunk", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("a4_array_shapes", sql("select case_id::varchar as case_id, f::int as finding_id, 2::bigint as candidates, 960::bigint as voxels, true as ok from cases, (select unnest([0,1]) as f)", "cases"))
def a4_arrays_b(spark, sf):
    return array_shapes(read_score_arrays(spark, _stored_arrays(spark, sf), chunk=400))


@query("a5_decode_typed_json", f"""select event_id, (props::json->>'k')::bigint as k, {r('value')} as score, event_type as kind,
 case when value > 100 then value > 200 end as high, (props::json->>'k')::bigint as nested_k from events""")
def a5(spark, sf):
    ev = fx.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    leaf = lambda tag, value: F.concat(F.lit('{"%s":' % tag), value, F.lit("}"))
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    doc = F.concat(
        F.lit('{"fields":{"k":'), leaf("integerValue", quoted(k)), F.lit(',"score":'), leaf("doubleValue", F.col("value").cast("string")),
        F.lit(',"kind":'), leaf("stringValue", quoted(F.col("event_type"))), F.lit(',"high":'),
        F.when(F.col("value") > 100, leaf("booleanValue", (F.col("value") > 200).cast("string"))).otherwise('{"nullValue":null}'),
        F.lit(',"nested":{"mapValue":{"fields":{"k":'), leaf("integerValue", quoted(k)), F.lit("}}}}}"))
    return census.decode_typed_json(ev.select("event_id", doc.alias("doc")), "doc", {
        "k": "bigint", "score": "double", "kind": "string", "high": "boolean", "nested.k": "bigint"})


@query("a6_read_events", """select arm, count(*) as events, count(*) as distinct_indices, 0::bigint as first, max(global_update)-1 as last,
 true as dense from (select event_type as arm, row_number() over (partition by event_type order by ts, event_id) as global_update
 from events) group by arm""")
def a6(spark, sf):
    path = scratch_path(spark, "events")
    rows = fx.journal(spark, sf).select("arm", (F.col("global_update") - 1).alias("event_index"), "loss")
    rows.repartition("arm").write.partitionBy("arm").json(path)
    _, checks = census.read_events(spark, path, "event_index bigint, loss double")
    arm = F.regexp_extract("source_file", r"arm=([^/]+)/", 1)
    return checks.select(arm.alias("arm"), "events", "distinct_indices", "first", "last", "dense")


_FILE = "split||'_'||patient||'_'||chr((97+case_id%2)::int)||case when finding_id=2 then '' else '_'||(finding_id+1) end||'.nii.gz'"
_A7 = sql(f"""select file, finding_id<>2 as valid, case when finding_id<>2 then split end as name_split,
 case when finding_id<>2 then split||'_'||patient end as name_patient,
 case when finding_id<>2 then split||'_'||patient||'_'||chr((97+case_id%2)::int) end as scan, case when finding_id<>2 then finding_id+1 end as reconstruction,
 case when finding_id<>2 then 'dataset/'||split||'_fixed/'||split||'_'||patient||'/'||split||'_'||patient||'_'||chr((97+case_id%2)::int)||'/'||file end as remote_path
 from (select *, {_FILE} as file from attrs)""", "attrs")


@query("a7_path_parts", _A7)
def a7(spark, sf):
    f = fx.with_attributes(fx.finding_keys(spark, sf))
    tail = F.when(F.col("finding_id") == 2, "").otherwise(F.concat(F.lit("_"), F.col("finding_id") + 1))
    name = F.concat(F.concat_ws("_", "split", F.col("patient").cast("string"), F.char(97 + F.col("case_id") % 2)), tail, F.lit(".nii.gz"))
    return census.with_path_parts(f.select(name.alias("file")), "file")


# These pages are flat: a run of tags and texts, each block tag opening the next block; SQL numbers the blocks and joins them.
_FLAT = """with x as (select page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') as host, regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*<body[^>]*>', ''), '(?s)<!--.*?-->', '', 'g'), '<[A-Za-z/!][^>]*$', '') as h from pages),
 t as (select page_id, host, unnest(regexp_extract_all(h, '<[^>]*>|[^<]+')) as tok, generate_subscripts(regexp_extract_all(h, '<[^>]*>|[^<]+'), 1) as pos from x),
 n as (select *, sum(regexp_matches(tok, '^</?(p|div|nav|ul|li|h1|article|footer|body|html)[ >]')::int) over (partition by page_id order by pos) as block from t),
 b as (select page_id, block, any_value(host) as host, min_by(tok, pos) as tag, regexp_replace(string_agg(tok, '' order by pos), '[ \\t\\n\\r]+', ' ', 'g') as raw from n group by all),
 c as (select page_id, block, tag, case when contains(raw, '<b>') then split_part(raw, '<b>', 1) || '**' || regexp_replace(split_part(raw, '<b>', 2), '(<br>| )+$', '') || '**'
  else regexp_replace(raw, '<a href="([^"]*)">(.*)</a>', '[\\2](' || host || '\\1)') end as linked from b),
 d as (select page_id, block, tag, trim(replace(replace(replace(replace(regexp_replace(replace(linked, '<br>', chr(10)), '<[^>]*>', '', 'g'), '&middot;', '\u00b7'), '&copy;', '\u00a9'), '&quot;', '"'), '&amp;', '&'), chr(10) || ' ') as body from c),
 f as (select page_id, block, tag = '<li>' as item, tag = '<h1>' as top, case tag when '<li>' then '- ' when '<h1>' then '# ' else '' end || body as line from d where body <> ''),
 a as (select page_id, min(block) filter (tag like '<article%') as first, min(block) filter (tag = '</article>') as last from b group by 1),
 g as (select page_id, min(block) filter (top and contains(lower(line), 'a')) as first, count(*) filter (top) as tops from f group by 1),
 o as (select f.*, case when item and lag(item) over w then chr(10) when lag(item) over w is not null then chr(10) || chr(10) else '' end as sep from f window w as (partition by page_id order by block))"""
_JOINED = "coalesce(string_agg(case when o.block = low then '' else sep end || line, '' order by o.block), '')"


@query("a8_pages_to_markdown", f"{_FLAT} select pages.page_id, {_JOINED} as markdown from pages left join (select *, -1 as low from o) o using (page_id) group by 1")
def a8(spark, sf):
    return markdown.pages_to_markdown(fx.table(spark, sf, "pages")).select("page_id", "markdown")


@query("a8_page_section", f"""{_FLAT} select g.page_id, case when g.first is not null then {_JOINED} end as section from g left join
 (select o.*, min(o.block) over (partition by o.page_id) as low from o join g on o.page_id = g.page_id and o.block >= g.first) o on o.page_id = g.page_id group by g.page_id, g.first""")
def a8b(spark, sf):
    return markdown.pages_to_markdown(fx.table(spark, sf, "pages"), heading="a", name="section").select("page_id", "section")


@query("a8_page_article", f"""{_FLAT} select a.page_id, {_JOINED} as article from a left join
 (select o.*, min(o.block) over (partition by o.page_id) as low from o join a on o.page_id = a.page_id and o.block >= a.first and o.block < coalesce(a.last, 1000000000)) o on o.page_id = a.page_id group by a.page_id""")
def a8c(spark, sf):
    return markdown.pages_to_markdown(fx.table(spark, sf, "pages"), selector="article", name="article").select("page_id", "article")


@query("a9_write_immutable", sql("select step, outcome, (select count(*) from pred) as stored from (values (1,'written'),(2,'unchanged'),(3,'conflict'),(4,'replaced')) t(step, outcome)"
                                 .replace("(select count(*) from pred)", "case when step<4 then (select count(*) from pred) else (select count(*) from gt) end"), "pred", "gt"))
def a9(spark, sf):
    path = scratch_path(spark, "immutable")
    first, other = fx.pred(spark, sf), fx.gt(spark, sf)
    log = []
    for step, (df, over) in enumerate([(first, False), (first, False), (other, False), (other, True)], start=1):
        try:
            outcome = sinks.write_immutable(df, path, overwrite=over)
        except sinks.ContentConflict:
            outcome = "conflict"
        log.append((step, outcome, sinks.read_immutable(spark, path).count()))
    return spark.createDataFrame(log, "step int, outcome string, stored bigint")


@query("a10_cached_result", sql(f"select candidate_id, {r('avg(dice)')} as dice, count(*) as findings from eval group by 1", "eval"))
def a10(spark, sf):
    root = scratch_path(spark, "cache")
    build = lambda: fx.evals(spark, sf).groupBy("candidate_id").agg(F.avg("dice").alias("dice"), F.count(F.lit(1)).alias("findings"))
    key = sinks.recipe_key(spark, "mean dice per candidate", fx.finding_keys(spark, sf))
    sinks.cached(build, key, root, spark)
    return sinks.cached(build, key, root, spark)
