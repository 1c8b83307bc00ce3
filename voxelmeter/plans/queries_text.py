"""H1-H5 with their SQL twins, built from the same rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmeter.operators import text as tx
from voxelmeter.plans import fixtures as fx
from voxelmeter.plans.fixtures import KEY, r, sql
from voxelmeter.plans.registry import query


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _list(pairs, text="t"):
    """List of the names whose pattern occurs in the text."""
    return "list_filter([" + ",".join(f"case when regexp_matches({text},{_q(p)}) then {_q(n)} end" for n, p in pairs) + "], lambda x: x is not null)"


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(prompt),'[_/\\]+',' ','g'),'[;,():\[\]{}]',' ','g'),'\s+',' ','g'))"


@query("h1_normalise_prompts", sql(f"select case_id, finding_id, {_NORM} as normalized from prompts", "prompts"))
def h1(spark, sf):
    return tx.normalise_text(fx.prompts(spark, sf), "prompt").select(*KEY, "normalized")


# NFKC changes none of the given texts, and their case fold is lower case with the sharp s spelled out.
@query("h1_normalise_documents", rf"""select doc_id, sha256(n) as sha256, length(n) as n_chars from (select doc_id, {_NORM.replace('lower(prompt)', "replace(lower(text),'ß','ss')")} as n from documents)""")
def h1b(spark, sf):
    return tx.normalise_text(fx.table(spark, sf, "documents"), "text").select("doc_id", F.sha2("normalized", 256).alias("sha256"), F.length("normalized").alias("n_chars"))


@query("h1_simple_text", r"select doc_id, trim(regexp_replace(replace(lower(text),'-',' '),'\s+',' ','g')) as simple from documents")
def h1c(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.simple_text("text").alias("simple"))


_DIMS = ", ".join(f"list_distinct(list_filter([{','.join(f'case when list_contains(loc,{_q(x[0])}) then {_q(x[3])} end' for x in tx.LOCATION if x[2] == d)}], lambda x: x is not null)) as {d}_v"
                  for d in tx.DIMENSIONS)
_H2 = f"""n1 as materialized (select case_id, finding_id, {_NORM} as t from prompts),
 n2 as materialized (select *, {_list(tx.NEGATION)} as neg, {_list(tx.AMBIGUITY)} as amb, {_list(tx.BILATERAL)} as bil, {_list(tx.DIFFUSE)} as dif, {_list([x[:2] for x in tx.LOCATION])} as loc from n1),
 n3 as materialized (select *, {_DIMS} from n2),
 n4 as materialized (select *, list_sort(list_filter([{','.join(f"case when len({d}_v)>1 then 'conflicting_{d}' end" for d in tx.DIMENSIONS)}], lambda x: x is not null)) as con from n3),
 n5 as materialized (select *, case when len(t)=0 then 'empty_prompt' when len(neg)>0 then 'negation_guard' when len(amb)>0 then 'ambiguity_guard' when len(bil)>0 then 'bilateral_or_multifocal_guard'
 when len(dif)>0 then 'diffuse_guard' when len(con)>0 then 'conflict' when len(lobe_v)>0 and len(laterality_v)>0 and laterality_v[1]<>split_part(lobe_v[1],'_',1) then 'conflicting_lobe_laterality'
 when len(lobe_v)+len(laterality_v)+len(vertical_v)+len(radial_v)+len(relation_v)=0 then 'no_safe_literal_location' else 'unambiguous_literal_match' end as st from n4),
 n6 as materialized (select *, st='unambiguous_literal_match' as ok from n5)"""
_H2Q = """select case_id, finding_id, case when ok then case when len(lobe_v)>0 then 'exact_lobe' when len(relation_v)>0 then relation_v[1] when len(vertical_v)>0 then 'apical_or_basal'
 when len(radial_v)>0 then 'central_or_peripheral' else 'laterality_only' end when st='bilateral_or_multifocal_guard' then 'bilateral_or_multifocal' when st='diffuse_guard' then 'diffuse' else 'unknown' end as "group",
 case when ok then coalesce(split_part(lobe_v[1],'_',1), laterality_v[1]) end as laterality, case when ok then lobe_v[1] end as lobe, case when ok then vertical_v[1] end as vertical,
 case when ok then radial_v[1] end as radial, case when ok then relation_v[1] end as relation, array_to_string(list_sort(case st when 'negation_guard' then neg when 'ambiguity_guard' then amb
 when 'bilateral_or_multifocal_guard' then bil when 'diffuse_guard' then dif else loc end),'|') as matched_rules, case when st='conflict' then array_to_string(con,'|') else st end as reason_codes, ok as is_restrictive from n6"""


@query("h2_classify", sql(_H2Q, "prompts", extra=_H2))
def h2(spark, sf):
    out = tx.classify(tx.normalise_text(fx.prompts(spark, sf).select(*KEY, "prompt"), "prompt"), "normalized")
    return out.drop("prompt", "normalized").withColumn("matched_rules", F.array_join(F.array_sort("matched_rules"), "|")).withColumn(
        "reason_codes", F.array_join("reason_codes", "|"))


@query("h2_classify_documents")
def h2b(spark, sf):
    docs = tx.normalise_text(fx.table(spark, sf, "documents"), "text").select("doc_id", "normalized")
    out = tx.classify(docs, "normalized")
    return out.select("doc_id", "group", "laterality", F.array_join("matched_rules", "|").alias("matched_rules"), F.array_join("reason_codes", "|").alias("reason_codes"))


_H3 = f"""r1 as materialized (select case_id, finding_id, trim(regexp_replace(replace(lower(prompt),'-',' '),'\\s+',' ','g')) as t from prompts),
 r2 as materialized (select *, {_list(tx.INCLUDE_PATTERNS.items())} as inc, {_list(tx.EXCLUDE_PATTERNS.items())} as exc from r1),
 r3 as materialized (select *, list_concat(exc, case when regexp_matches(t,{_q(tx.MULTIFOCAL)}) then ['diffuse_multifocal'] else [] end) as rk from r2)"""
_H3Q = """select case_id, finding_id, array_to_string(inc,'|') as include, case when len(rk)=0 then 'clean_or_unspecified' else array_to_string(list_sort(rk),'|') end as risk_groups, """ + ", ".join(
    f"len(inc)>0 and len(list_filter(exc, lambda x: list_contains({names}, x)))=0 as {p}_gate, array_to_string(list_filter(exc, lambda x: list_contains({names}, x)),'|') as {p}_exclude"
    for p, names in tx.POLICY_EXCLUDES.items()) + " from r3"


@query("h3_route", sql(_H3Q, "prompts", extra=_H3))
def h3(spark, sf):
    out = tx.route(fx.prompts(spark, sf).select(*KEY, "prompt"), "prompt").drop("prompt")
    arrays = ["include", "risk_groups", *[f"{p}_exclude" for p in tx.POLICY_EXCLUDES]]
    return out.select(*[F.array_join(c, "|").alias(c) if c in arrays else F.col(c) for c in out.columns])


def _m(p):
    return f"regexp_matches(t,{_q(p)})"


_SC = f"""s1 as materialized (select case_id, finding_id, category, lower(prompt) as t from prompts),
 s2 as materialized (select *, {_list(tx.RISK_PATTERNS.items())} as rk, {_list(tx.LOBE_PATTERNS.items())} as lb, {_m(tx.SIDE_PATTERNS['L'])} as l, {_m(tx.SIDE_PATTERNS['R'])} as r, {_m(tx.BOTH_SIDES)} as b from s1),
 s3 as materialized (select *, case when b or (l and r) then 'B' when len(lb)>0 then array_to_string(lb,'+') when l then 'L' when r then 'R' else 'W' end as scope,
 not (category in ('2e','2g') or (list_contains(rk,'pleural') and not {_m(tx.LUNG_WORDS)}) or list_contains(rk,'pneumothorax') or (list_contains(rk,'vascular') and not {_m(tx.LUNG_ONLY)})) as el from s2),
 s4 as materialized (select *, el and (len(lb)>0 or l<>r or b) as fine, list_sort(list_distinct(flatten(list_transform(string_split(scope,'+'), lambda x: case x {' '.join(f"when '{k}' then {v}" for k, v in tx.SCOPE_LABELS.items() if v)} end)))) as lab from s3)"""
_SCQ = f"""select case_id, finding_id, case when {_m(tx.EXTENTS['diffuse'])} then 'diffuse' when {_m(tx.EXTENTS['multifocal'])} then 'multifocal' when {_m(tx.EXTENTS['focal'])} then 'focal' else 'unclear' end as extent,
 case when scope='B' then 'bilateral' when scope like 'L%' then 'left' when scope like 'R%' then 'right' else 'unspecified' end as laterality, array_to_string(lb,'|') as lobes, scope, array_to_string(rk,'|') as risks,
 el as eligible, fine as fine_eligible, case when el then array_to_string(lab,'|') else '' end as labels, case when not el then 'no restriction: target is not represented by lung support' when fine then 'named side or lobe'
 else 'whole lung only' end as rationale, {_m(tx.UNCERTAIN)} as uncertainty, {_m(tx.NEGATED)} as negation from s4"""


@query("h3_route_scope", sql(_SCQ, "prompts", extra=_SC))
def h3b(spark, sf):
    out = tx.route_scope(fx.prompts(spark, sf).select(*KEY, "category", "prompt"), "prompt").drop("prompt", "category")
    return out.select(*[F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if c in ("lobes", "risks", "labels") else F.col(c) for c in out.columns])


def _alt(ps):
    return "(?i)(?:" + "|".join(ps) + ")"


_FIRST = "case " + " ".join(f"when regexp_matches(prompt,{_q(_alt(p))}) then {_q(n)}" for n, p in tx.PRIMARY_RULES) + f" else {_q(tx.PRIMARY_DEFAULT)} end"
_AUD = f"""au as materialized (select split, kind, label, n as findings, n/total as fraction, (row_number() over (partition by split, kind order by n desc, label))::int as rank from (
 select split, kind, label, count(*) as n from (select split, 'primary' as kind, {_FIRST} as label from prompts union all select split, 'cue', unnest({_list([(n, _alt(p)) for n, _, p in tx.CUE_RULES], 'prompt')}) from prompts) group by all)
 join (select split, count(*) total from prompts group by 1) using (split))"""


@query("h4_text_audit", sql(f"select split, kind, label, findings, {r('fraction')} as fraction, rank from au", "prompts", extra=_AUD))
def h4(spark, sf):
    return tx.text_audit(fx.prompts(spark, sf), "prompt", ["split"])


@query("h4_compare_audits", sql(f"""select coalesce(a.kind,b.kind) as kind, coalesce(a.label,b.label) as label, coalesce(a.findings,0) as a_findings, coalesce(b.findings,0) as b_findings,
 {r('coalesce(a.fraction,0)')} as a_fraction, {r('coalesce(b.fraction,0)')} as b_fraction, a.rank as a_rank, b.rank as b_rank, {r('coalesce(b.fraction,0)-coalesce(a.fraction,0)')} as difference
 from (select * from au where split='train') a full join (select * from au where split='val') b on a.kind=b.kind and a.label=b.label""", "prompts", extra=_AUD))
def h4b(spark, sf):
    p = fx.prompts(spark, sf)
    return tx.compare_audits(tx.text_audit(p.where("split = 'train'"), "prompt", []), tx.text_audit(p.where("split = 'val'"), "prompt", []))


@query("h4_topics", sql("select case_id, finding_id, case " + " ".join(f"when regexp_matches(prompt,{_q('(?i)' + p)}) then {_q(n)}" for n, p in tx.TOPIC_RULES) + " else 'other' end as topic from prompts", "prompts"))
def h4c(spark, sf):
    return fx.prompts(spark, sf).select(*KEY, tx.topic("prompt").alias("topic"))


TERMS = {"nodule": ["nodul[a-z]*"], "opacity": ["opacit[a-z]*", "consolidation"], "lobe": ["(?:upper|middle|lower) lobe"], "pleura": ["[a-z]*pleural"], "side": ["left", "right"]}
_VO = "vo as materialized (select concept, split, prompt, n, forms from (select prompt, split, count(*) n from prompts group by all), lateral (select unnest([" + ",".join(
    f"{{'concept': {_q(c)}, 'forms': list_distinct(list_concat({','.join(f'regexp_extract_all(lower(prompt),{_q(p)})' for p in ps)}))}}" for c, ps in TERMS.items()) + "], recursive := true)) where len(forms)>0)"


@query("h5_vocabulary", sql("""select concept, train, val, test, total, variants, examples from (select concept, coalesce(sum(n) filter (split='train'),0)::bigint as train, coalesce(sum(n) filter (split='val'),0)::bigint as val,
 coalesce(sum(n) filter (split='test'),0)::bigint as test, sum(n)::bigint as total from vo group by 1) join (select concept, string_agg(form||' ('||n||')', '; ' order by n desc, form) as variants from (select concept, form, sum(n)::bigint as n,
 row_number() over (partition by concept order by sum(n) desc, form) rn from (select concept, n, unnest(forms) as form from vo) group by 1,2) where rn<=12 group by 1) using (concept) join
 (select concept, string_agg(prompt, ' / ' order by prompt) as examples from (select concept, prompt, row_number() over (partition by concept order by prompt) rn from (select distinct concept, prompt from vo)) where rn<=3 group by 1) using (concept)""",
                            "prompts", extra=_VO))
def h5(spark, sf):
    return tx.vocabulary(fx.prompts(spark, sf), "prompt", "split", ["train", "val", "test"], TERMS)


_DT = {"the": ["the"], "er": ["[a-z]*er"], "num": ["[0-9]+"]}
_VD = "vo as materialized (select concept, lang as split, text as prompt, n, forms from (select text, lang, count(*) n from documents group by all), lateral (select unnest([" + ",".join(
    f"{{'concept': {_q(c)}, 'forms': list_distinct(list_concat({','.join(f'regexp_extract_all(lower(text),{_q(p)})' for p in ps)}))}}" for c, ps in _DT.items()) + "], recursive := true)) where len(forms)>0)"


@query("h5_vocabulary_documents", "with " + _VD + """ select concept, total, variants from (select concept, sum(n)::bigint as total from vo group by 1) join (select concept, string_agg(form||' ('||n||')', '; ' order by n desc, form) as variants from (
 select concept, form, sum(n)::bigint as n, row_number() over (partition by concept order by sum(n) desc, form) rn from (select concept, n, unnest(forms) as form from vo) group by 1,2) where rn<=12 group by 1) using (concept)""")
def h5b(spark, sf):
    docs = fx.table(spark, sf, "documents").select("text", "lang")
    return tx.vocabulary(docs, "text", "lang", ["en"], _DT).select("concept", "total", "variants")
