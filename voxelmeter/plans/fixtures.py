"""Views of the given tables shaped like segmentation data, and the same views as SQL text.

Empty masks arise from the data itself: the discount cut rises with the finding id, so
some findings keep no truth or no predicted voxel. No rows are filtered by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmeter.functions import CATEGORIES, bucketed_row_number
from voxelmeter.functions.columns import logit
from voxelmeter.operators.chunks import unstacked, voxel_stacks

VOX = ["case_id", "finding_id", "i", "j", "k"]
KEY = ["case_id", "finding_id"]
SHAPE = (12, 10, 8)

# Example prompts, at least one for each kind of rule of the text operators.
PROMPTS = [
    "Small calcified granuloma, upper lobe on the right side",
    "Subpleural reticulation along the left lower lobe",
    "There is no pleural fluid on the right",
    "Likely infiltrate within the left upper lobe",
    "Ground-glass change in both lungs, bilateral",
    "Diffuse thickening of the bronchial walls",
    "Peripheral wedge-shaped density of the right lower lobe",
    "Perihilar soft tissue next to the right middle lobe",
    "Layering effusion, left pleural space",
    "Apical pneumothorax, right",
    "Several scattered nodules, multifocal",
    "Band of atelectasis, lingula",
    "Density spanning the right lung and the left lower lobe",
    "Central density with peribronchial cuffing",
    "Centrilobular emphysema",
    "Single nodule, apical segment of the left upper lobe",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vox(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.expr("l_orderkey div 38").alias("case_id"),
        (F.col("l_linenumber") % 3).alias("finding_id"),
        (F.col("l_partkey") % 12).cast("int").alias("i"),
        (F.col("l_suppkey") % 10).cast("int").alias("j"),
        (F.col("l_quantity").cast("int") % 8).alias("k"),
        F.col("l_returnflag").alias("rf"),
        F.round(F.col("l_discount") * 100).cast("int").alias("dc"))


def gt_rows(spark, sf) -> DataFrame:
    return vox(spark, sf).where("rf = 'A' and dc >= 4 * finding_id").select(*VOX)


def gt(spark, sf) -> DataFrame:
    return gt_rows(spark, sf).distinct()


def pred_rows(spark, sf) -> DataFrame:
    return (vox(spark, sf)
            .where("rf <> 'R' and dc >= case finding_id when 0 then 2 when 1 then 5 else 9 end "
                   "and not (finding_id = 2 and rf = 'A')")
            .select(*VOX))


def pred(spark, sf) -> DataFrame:
    return pred_rows(spark, sf).distinct()


def final(spark, sf) -> DataFrame:
    """An edited prediction: drops the low-discount part, adds some returned rows."""
    return final_rows(spark, sf).distinct()


def final_rows(spark, sf) -> DataFrame:
    return vox(spark, sf).where("(rf = 'N' and dc >= 6) or (rf = 'A' and dc >= 8)").select(*VOX)


def category() -> F.Column:
    code = (F.col("case_id") * 5 + F.col("finding_id") * 3) % 14
    picked = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (code + 1).cast("int"))
    return F.when(picked == "2f", F.lit("2d")).otherwise(picked)


def finding_keys(spark, sf) -> DataFrame:
    return vox(spark, sf).select(*KEY).distinct()


def with_attributes(keys: DataFrame) -> DataFrame:
    ten = F.col("case_id") % 10
    return keys.select(
        *KEY, category().alias("category"), F.expr("case_id div 2").alias("patient"),
        F.when(ten <= 6, "train").when(ten <= 8, "val").otherwise("test").alias("split"),
        (1 + (F.col("case_id") + F.col("finding_id")) % 5).alias("entities"))


def findings(spark, sf) -> DataFrame:
    sizes = gt(spark, sf).groupBy(*KEY).agg(F.count(F.lit(1)).alias("pixels"))
    return with_attributes(finding_keys(spark, sf)).join(sizes, KEY, "left").fillna(0, ["pixels"])


def prompts(spark, sf) -> DataFrame:
    index = ((F.col("case_id") + F.col("finding_id")) % 16 + 1).cast("int")
    return with_attributes(finding_keys(spark, sf)).withColumn(
        "prompt", F.element_at(F.array(*[F.lit(p) for p in PROMPTS]), index))


def evals(spark, sf) -> DataFrame:
    c = F.col("c")
    base = finding_keys(spark, sf).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    score = ((F.col("case_id") * 37 + F.col("finding_id") * 17 + c * 29 + (F.col("case_id") * c) % 11) % 101) / 100.0
    return base.select(F.concat(F.lit("m"), c).alias("candidate_id"), *KEY,
                       score.cast("double").alias("dice"), (score >= 0.1).alias("hit"))


def evals_cat(spark, sf) -> DataFrame:
    return evals(spark, sf).withColumn("category", category())


def cases(spark, sf) -> DataFrame:
    return vox(spark, sf).select("case_id").distinct()


def anatomy(spark, sf) -> DataFrame:
    nx, ny, nz = SHAPE
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = (cases(spark, sf).withColumn("i", axis(nx)).withColumn("j", axis(ny)).withColumn("k", axis(nz)))
    return grid.withColumn("label", F.when(F.col("k") == 7, 0).otherwise(F.expr("10 + i div 3")).cast("int"))


def headers(spark, sf) -> DataFrame:
    sx = F.when(F.col("case_id") % 2 == 1, F.lit(-0.7)).otherwise(F.lit(0.7))
    sz = 1.0 + (F.col("case_id") % 3) * 0.5
    z = F.lit(0.0)
    affine = F.array(sx, z, z, -sx * 6, z, F.lit(0.7), z, z, z, z, sz, z, z, z, z, F.lit(1.0))
    return cases(spark, sf).select(
        "case_id", F.array(*[F.lit(n) for n in SHAPE]).alias("shape"),
        F.array(F.lit(0.7), F.lit(0.7), sz).alias("spacing"), affine.alias("affine"))


def intensity(spark, sf) -> DataFrame:
    value = -1000 + (F.col("i") * 131 + F.col("j") * 37 + F.col("k") * 61 + F.col("case_id") * 17) % 1500
    return anatomy(spark, sf).select("case_id", "i", "j", "k", value.cast("double").alias("value"))


def _true() -> F.Column:
    return F.when((F.col("rf") == "A") & (F.col("dc") >= 4 * F.col("finding_id")), 1).otherwise(0)


def _touched(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*VOX).agg(F.max(_true()).alias("is_gt"))


def _probability(c: F.Column) -> F.Column:
    p = (1 + (F.col("i") * 31 + F.col("j") * 17 + F.col("k") * 13 + F.col("case_id") * 7 + c * c * 5) % 700
         + 298 * F.col("is_gt")) / 1000.0
    return p.cast("double")


def scores(spark, sf) -> DataFrame:
    """Five candidates per touched voxel; truth lifts the probability."""
    c = F.col("c")
    return (_touched(vox(spark, sf)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(4))))
            .select(F.concat(F.lit("m"), c).alias("candidate_id"), *VOX, F.col("is_gt").cast("boolean").alias("is_gt"),
                    _probability(c).alias("p"))
            .withColumn("z", logit("p")))


def score_stacks(spark, sf, value: str = "z") -> DataFrame:
    """The same as arrays: one row a finding with the values of each candidate, voxels in order, and the places of the true ones.

    Voxels are shuffled once, by finding and before there is a value per candidate.
    """
    rows = vox(spark, sf).select(*VOX, _true().alias("is_gt"))
    p = {f"m{c}": _probability(F.lit(c)) for c in range(5)}
    return voxel_stacks(rows, p if value == "p" else {c: logit(x) for c, x in p.items()})


def score_chunks(spark, sf, value: str = "z") -> DataFrame:
    """The same as one chunk per candidate and finding."""
    return unstacked(score_stacks(spark, sf, value))


def journal(spark, sf) -> DataFrame:
    """events as training journals: one run per event type, dense update numbers by time."""
    hour = F.date_format("ts", "yyyyMMddHH").cast("bigint")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("arm"), "ts", "event_id",
                                             F.col("value").alias("loss"))
    return bucketed_row_number(rows, ["arm"], hour, ["ts", "event_id"], "global_update")


def catalog(spark, sf) -> DataFrame:
    ev = evals(spark, sf).groupBy("candidate_id").agg(
        F.avg("dice").alias("dice"), F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("findings"))
    number = F.substring("candidate_id", 2, 9).cast("int")
    return ev.withColumn("content_hash", F.sha2(F.col("candidate_id"), 256)).withColumn(
        "eligible", number % 3 != 1)


def submissions(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entry_id"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Team"), F.col("o_custkey")))
        .otherwise(F.concat(F.lit("TEAM"), F.col("o_custkey"))).alias("submitter"),
        (F.col("o_totalprice") / 1e6).alias("dice"),
        (F.col("o_orderstatus") == "P").alias("pending"))


# ---------------------------------------------------------------- the same views as SQL

_CODES = "[" + ",".join(f"'{c}'" for c in CATEGORIES) + "]"
_TEXTS = "[" + ",".join("'" + p.replace("'", "''") + "'" for p in PROMPTS) + "]"

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "vox": ((), """select l_orderkey // 38 as case_id, l_linenumber % 3 as finding_id, (l_partkey % 12)::int as i,
        (l_suppkey % 10)::int as j, (l_quantity::int % 8) as k, l_returnflag as rf,
        round(l_discount*100)::int as dc from lineitem"""),
    "gt": (("vox",), "select distinct case_id,finding_id,i,j,k from vox where rf='A' and dc >= 4*finding_id"),
    "pred": (("vox",), """select distinct case_id,finding_id,i,j,k from vox where rf<>'R'
        and dc >= case finding_id when 0 then 2 when 1 then 5 else 9 end and not (finding_id=2 and rf='A')"""),
    "final": (("vox",), """select distinct case_id,finding_id,i,j,k from vox
        where (rf='N' and dc>=6) or (rf='A' and dc>=8)"""),
    "keys": (("vox",), "select distinct case_id, finding_id from vox"),
    "attrs": (("keys",), f"""select case_id, finding_id,
        case when c='2f' then '2d' else c end as category, case_id // 2 as patient,
        case when case_id%10<=6 then 'train' when case_id%10<=8 then 'val' else 'test' end as split,
        1+(case_id+finding_id)%5 as entities
        from (select *, {_CODES}[((case_id*5+finding_id*3)%14+1)::int] as c from keys)"""),
    "findings": (("attrs", "gt"), """select a.*, coalesce(n,0) as pixels from attrs a left join
        (select case_id, finding_id, count(*) n from gt group by all) g using (case_id, finding_id)"""),
    "prompts": (("attrs",), f"select *, {_TEXTS}[((case_id+finding_id)%16+1)::int] as prompt from attrs"),
    "eval": (("keys",), """select 'm'||c as candidate_id, case_id, finding_id, dice, dice>=0.1 as hit from
        (select *, ((case_id*37+finding_id*17+c*29+(case_id*c)%11)%101)/100.0::double as dice
         from keys, (select unnest(range(8)) as c))"""),
    "evalc": (("eval", "attrs"), "select e.*, category from eval e join attrs a using (case_id, finding_id)"),
    "cases": (("vox",), "select distinct case_id from vox"),
    "anatomy": (("cases",), """select case_id, i::int as i, j::int as j, k::int as k,
        (case when k=7 then 0 else 10+i//3 end)::int as label from cases, (select unnest(range(12)) as i),
        (select unnest(range(10)) as j), (select unnest(range(8)) as k)"""),
    "hdr": (("cases",), """select case_id, 0.7::double as sx, 0.7::double as sy, (1.0+(case_id%3)*0.5)::double as sz,
        case when case_id%2=1 then -0.7 else 0.7 end::double as ax, 12 as nx, 10 as ny, 8 as nz from cases"""),
    "intensity": (("anatomy",), """select case_id,i,j,k,
        (-1000+(i*131+j*37+k*61+case_id*17)%1500)::double as value from anatomy"""),
    "scores": (("vox",), """select 'm'||c as candidate_id, case_id,finding_id,i,j,k,is_gt=1 as is_gt,p, ln(p/(1-p)) as z
        from (select *, ((1+(i*31+j*17+k*13+case_id*7+c*c*5)%700+298*is_gt)/1000.0)::double as p from
        (select case_id,finding_id,i,j,k,max(case when rf='A' and dc>=4*finding_id then 1 else 0 end) as is_gt
         from vox group by all), (select unnest(range(5)) as c))"""),
    "journal": ((), """select event_type as arm, ts, event_id, value as loss,
        row_number() over (partition by event_type order by ts, event_id) as global_update from events"""),
    "catalog": (("eval",), """select candidate_id, avg(dice) as dice, count(*) filter (hit) as hits,
        count(*) as findings, sha256(candidate_id) as content_hash,
        substr(candidate_id,2)::int % 3 <> 1 as eligible from eval group by candidate_id"""),
    "submissions": ((), """select o_orderkey as entry_id,
        case when o_custkey%2=0 then 'Team'||o_custkey else 'TEAM'||o_custkey end as submitter,
        o_totalprice/1e6 as dice, o_orderstatus='P' as pending from orders"""),
}


def sql(body: str, *views: str, extra: str = "", recursive: bool = False) -> str:
    """``with <views and what they need>[, extra] body`` for DuckDB."""
    order: list[str] = []

    def need(name: str) -> None:
        for parent in SQL[name][0]:
            need(parent)
        if name not in order:
            order.append(name)

    for view in views:
        need(view)
    parts = [f"{name} as materialized ({SQL[name][1]})" for name in order]
    if extra:
        parts.append(extra.strip().rstrip(","))
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`voxelmeter.functions.tidy` for one expression."""
    return f"(round(({expr})::double,{digits})+0.0)"


def dice_sql(tp: str, p: str, g: str) -> str:
    return f"(case when {p}+{g}=0 then 1.0 else (2*{tp}+1e-6)/({p}+{g}+1e-6) end)"
