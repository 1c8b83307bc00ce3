"""Structured scans that flatten nested records into long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT_MAP = "map<string,string>"
CASE_DDL = (f"name string, findings {_TEXT_MAP}, categories {_TEXT_MAP}, pixels map<string,bigint>, "
            "entity_counts map<string,bigint>")
MAPS = ["findings", "categories", "pixels", "entity_counts"]


def read_census(spark: SparkSession, path: str, splits: list[str] | None = None, layout: str = "document") -> DataFrame:
    """A1: one row per (split, case, finding) of a nested dataset description.

    ``document``: each file is one JSON object ``{split: [case, ...]}``. ``lines``: one case
    per line with its ``split`` and ``split_index``, the layout that splits over tasks.
    """
    if layout == "lines":
        cases = spark.read.schema(f"split string, split_index bigint, {CASE_DDL}").json(path)
        if splits:
            cases = cases.where(F.col("split").isin(splits))
        return flatten_census(cases)
    splits = splits or ["train", "val", "test"]
    schema = ", ".join(f"{s}: array<struct<{_as_struct(CASE_DDL)}>>" for s in splits)
    doc = spark.read.schema(T._parse_datatype_string(f"struct<{schema}>")).option("multiLine", True).json(path)
    parts = None
    for split in splits:
        part = doc.select(F.lit(split).alias("split"), F.posexplode(split).alias("split_index", "c"))
        part = part.select("split", F.col("split_index").cast("bigint").alias("split_index"), "c.*")
        parts = part if parts is None else parts.unionByName(part)
    return flatten_census(parts)


def _as_struct(ddl: str) -> str:
    out = []
    for piece in ddl.split(", "):
        name, _, kind = piece.partition(" ")
        out.append(f"{name}:{kind}")
    return ",".join(out)


def flatten_census(cases: DataFrame) -> DataFrame:
    """A1: explode the id-keyed maps; ``channel`` is the rank of the id inside its case.

    Ids sort as numbers. A case whose four maps disagree on ids is an error when read.
    """
    ids = lambda m: F.array_sort(F.map_keys(m))
    agree = (ids("findings") == ids("categories"))
    for extra in MAPS[2:]:
        agree = agree & (F.col(extra).isNull() | (ids(extra) == ids("findings")))
    checked = F.when(agree, F.map_entries("findings")).otherwise(
        F.raise_error(F.concat(F.lit("finding ids differ between maps of case "), F.col("name"))))
    rows = cases.withColumn("e", F.explode(checked)).withColumn("finding_id", F.col("e.key").cast("int"))
    channel = F.size(F.filter(F.map_keys("findings"), lambda k: k.cast("int") < F.col("finding_id")))
    return rows.select(
        "split", "split_index", F.col("name").alias("case_id"), "finding_id", channel.alias("channel"),
        F.col("categories")[F.col("e.key")].alias("category"), F.col("e.value").alias("prompt"),
        F.col("pixels")[F.col("e.key")].alias("pixels"), F.col("entity_counts")[F.col("e.key")].alias("entities"))


EVAL_DDL = ("summary struct<mean_global_dice_per_finding:double,hit_rate:double,total_hits:bigint,total_findings:bigint,"
            "total_cases:bigint>, cases array<struct<file:string,findings:map<string,struct<global_dice:double,"
            "global_hit:boolean>>>>")


def _eval_files(spark: SparkSession, path: str, candidate_pattern: str, layout: str) -> DataFrame:
    raw = spark.read.schema(EVAL_DDL).option("multiLine", layout == "document").json(path)
    return raw.withColumn("candidate_id", F.regexp_extract(F.col("_metadata.file_path"), candidate_pattern, 1))


def read_evals(spark: SparkSession, path: str, candidate_pattern: str = r"([^/]+)\.json$", layout: str = "document") -> DataFrame:
    """A2: evaluator files to ``(candidate_id, case_id, finding_id, dice, hit)``.

    The candidate is the first group of ``candidate_pattern`` in the file path. ``document``
    files hold one object; ``lines`` files one object per line, so that big ones split.
    """
    rows = _eval_files(spark, path, candidate_pattern, layout).select("candidate_id", F.explode("cases").alias("c"))
    rows = rows.select("candidate_id", F.col("c.file").alias("case_id"), F.explode("c.findings").alias("key", "m"))
    return rows.select("candidate_id", "case_id", F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("finding_id"),
                       F.col("m.global_dice").alias("dice"), F.col("m.global_hit").alias("hit"))


def read_eval_summaries(spark: SparkSession, path: str, candidate_pattern: str = r"([^/]+)\.json$",
                        layout: str = "document") -> DataFrame:
    """A2: the reported summary of every evaluator file."""
    return _eval_files(spark, path, candidate_pattern, layout).select("candidate_id", "summary.*")


def explode_chunks(chunks: DataFrame) -> DataFrame:
    """A4: ``(candidate_id, case_id, finding_id, chunk, offset, values)`` to one row per voxel.

    A non-finite value is an error; the shape check is :func:`chunk_shapes`.
    """
    bad = F.exists("values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    checked = F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("non-finite score in"), "candidate_id", "case_id"))
                     ).otherwise(F.col("values"))
    return chunks.select("candidate_id", "case_id", "finding_id", "offset", F.posexplode(checked).alias("pos", "score")).select(
        "candidate_id", "case_id", "finding_id", (F.col("offset") + F.col("pos")).alias("voxel"), "score")


def chunk_shapes(chunks: DataFrame) -> DataFrame:
    """A4: voxels per candidate and whether all candidates of a finding agree on them."""
    sizes = chunks.groupBy("case_id", "finding_id", "candidate_id").agg(
        F.sum(F.size("values")).alias("voxels"), F.max(F.col("offset") + F.size("values")).alias("end"))
    return sizes.groupBy("case_id", "finding_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("voxels").alias("voxels"),
        ((F.min("voxels") == F.max("voxels")) & (F.min("end") == F.max("end")) & (F.min("end") == F.min("voxels"))).alias("ok"))


_LEAVES = {"string": ("stringValue", "string"), "bigint": ("integerValue", "bigint"), "double": ("doubleValue", "double"),
           "boolean": ("booleanValue", "boolean"), "timestamp": ("timestampValue", "timestamp")}


def decode_typed_json(df: DataFrame, column: str, fields: dict[str, str], keep: list[str] | None = None,
                      root: str = "$.fields") -> DataFrame:
    """A5: typed-leaf JSON documents to flat columns.

    ``fields`` maps a dotted name to ``string``, ``bigint``, ``double``, ``boolean`` or
    ``timestamp``, or to ``variant`` for a nested map or array. Dots step into
    ``mapValue.fields``. A number field takes an integer or a double leaf; null leaves and
    absent fields are null.
    """
    doc = F.parse_json(F.col(column))
    out = []
    for name, kind in fields.items():
        path = root + "." + ".mapValue.fields.".join(name.split("."))
        if kind == "variant":
            leaf = F.coalesce(F.try_variant_get(doc, f"{path}.mapValue.fields", "variant"),
                              F.try_variant_get(doc, f"{path}.arrayValue.values", "variant"))
        elif kind == "double":
            leaf = F.coalesce(F.try_variant_get(doc, f"{path}.doubleValue", "double"),
                              F.try_variant_get(doc, f"{path}.integerValue", "double"))
        else:
            tag, cast = _LEAVES[kind]
            leaf = F.try_variant_get(doc, f"{path}.{tag}", cast)
        out.append(leaf.alias(name.replace(".", "_")))
    return df.select(*(keep if keep is not None else [c for c in df.columns if c != column]), *out)


def read_events(spark: SparkSession, path: str, schema: str, index: str = "event_index") -> tuple[DataFrame, DataFrame]:
    """JSON-lines events and one check row per file.

    A file is complete when its indices are exactly 0..n-1 once each.
    """
    rows = spark.read.schema(schema).json(path).withColumn("source_file", F.col("_metadata.file_path"))
    seen = rows.groupBy("source_file", index).agg(F.count(F.lit(1)).alias("n"))
    checks = seen.groupBy("source_file").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("distinct_indices"), F.min(index).alias("first"), F.max(index).alias("last"))
    dense = ((F.col("first") == 0) & (F.col("last") == F.col("events") - 1) & (F.col("distinct_indices") == F.col("events")))
    return rows, checks.withColumn("dense", F.coalesce(dense, F.lit(False)))


NAME_PATTERN = r"^([A-Za-z]+)_(\d+)_([^_/]+)_(\d+)\.nii\.gz$"


def with_path_parts(df: DataFrame, column: str) -> DataFrame:
    """Split, patient, scan, reconstruction and remote path of a volume file name.

    Names of another form get nulls and ``valid = false``, so they can be set aside.
    """
    part = lambda n: F.regexp_extract(column, NAME_PATTERN, n)
    ok = F.col(column).rlike(NAME_PATTERN)
    patient = F.concat_ws("_", part(1), part(2))
    scan = F.concat_ws("_", patient, part(3))
    path = F.concat_ws("/", F.lit("dataset"), F.concat(part(1), F.lit("_fixed")), patient, scan, F.col(column))
    return df.select("*", ok.alias("valid"), F.when(ok, part(1)).alias("name_split"), F.when(ok, patient).alias("name_patient"),
                     F.when(ok, scan).alias("scan"), F.when(ok, part(4).cast("int")).alias("reconstruction"),
                     F.when(ok, path).alias("remote_path"))
