"""H1-H5: rule-based prompt operators.

Rules are plain tables; matching is built from regular-expression columns, so everything
but Unicode normalisation stays in the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC").str.casefold()


def normalise_text(df: DataFrame, column: str, name: str = "normalized") -> DataFrame:
    """H1: NFKC, casefold, separators and punctuation to spaces, single spaces, trimmed."""
    t = _nfkc_casefold(F.col(column))
    for pattern in (r"[_/\\]+", r"[;,():\[\]{}]", r"(?U)\s+"):
        t = F.regexp_replace(t, pattern, " ")
    return df.withColumn(name, F.trim(t))


def simple_text(column: str) -> Column:
    """H1, lighter form: lower case, hyphens and blank runs to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(column), "-", " "), r"(?U)\s+", " "))


# ---------------------------------------------------------------- fixed values: classification rules
# (id, pattern) of the guards in order of precedence, then (id, pattern, dimension, value) of locations.

NEGATION = [
    ("negation:no", r"\bno\b"),
    ("negation:not", r"\bnot\b"),
    ("negation:without", r"\bwithout\b"),
    ("negation:absent", r"\babs(?:ent|ence)\b"),
    ("negation:negative_for", r"\bnegative\s+for\b"),
    ("negation:free_of", r"\bfree\s+of\b"),
    ("negation:lack", r"\black(?:s|ing|ed)?\b"),
    ("negation:neither_nor", r"\b(?:neither|nor)\b"),
    ("negation:resolved", r"\bresolved\b"),
]
AMBIGUITY = [
    ("ambiguity:possible", r"\bpossibl(?:e|y)\b"),
    ("ambiguity:probable", r"\bprobabl(?:e|y)\b"),
    ("ambiguity:likely", r"\b(?:un)?likely\b"),
    ("ambiguity:uncertain", r"\buncertain(?:ty)?\b"),
    ("ambiguity:indeterminate", r"\bindeterminate\b"),
    ("ambiguity:questionable", r"\bquestionable\b"),
    ("ambiguity:equivocal", r"\bequivocal\b"),
    ("ambiguity:suspected", r"\bsuspect(?:ed|ing)?\b"),
    ("ambiguity:suspicious", r"\bsuspicious\b"),
    ("ambiguity:may_might_could", r"\b(?:may|might|could)\b"),
    ("ambiguity:cannot_exclude", r"\bcannot\s+exclude\b"),
    ("ambiguity:exclude", r"\bexclud(?:e|es|ed|ing)\b"),
    ("ambiguity:except", r"\bexcept(?:ing)?\b"),
    ("ambiguity:suggestive", r"\bsuggest(?:s|ed|ive(?:\s+of)?)\b"),
    ("ambiguity:favored", r"\bfavou?red\b"),
    ("ambiguity:presumed", r"\bpresum(?:ed|ably)\b"),
    ("ambiguity:versus", r"\b(?:versus|vs\.?)\b"),
    ("ambiguity:either", r"\beither\b"),
    ("ambiguity:or", r"\bor\b"),
    ("ambiguity:predominant", r"\bpredominant(?:ly)?\b"),
    ("ambiguity:difficult_to_distinguish", r"\bdifficult\s+to\s+distinguish\b"),
    ("ambiguity:coordinated_lobes", r"\b(?:upper|middle|lower)\s+(?:lobe\s+)?and\s+(?:upper|middle|lower)\s+lobes?\b"),
]
BILATERAL = [
    ("distribution:bilateral", r"\bbilateral(?:ly)?\b"),
    ("distribution:both", r"\bboth(?:\s+(?:the\s+)?)?(?:(?:upper|middle|lower)\s+)?(?:lungs?|lobes?|sides?|hemithoraces)\b"),
    ("distribution:both_apices_bases", r"\bboth\s+(?:lung\s+)?(?:apices|bases)\b"),
    ("distribution:multifocal", r"\bmultifocal(?:ity)?\b"),
    ("distribution:multilobar", r"\bmulti[-\s]?lobar\b"),
    ("distribution:multiple", r"\bmultiple\b"),
    ("distribution:scattered", r"\bscattered\b"),
    ("distribution:numerous", r"\bnumerous\b"),
    ("distribution:several", r"\bseveral\b"),
    ("distribution:coordinated_sides", r"\b(?:right\s+and\s+left|left\s+and\s+right)\b"),
]
DIFFUSE = [
    ("distribution:diffuse", r"\bdiffus(?:e|ely)\b"),
    ("distribution:widespread", r"\bwidespread\b"),
    ("distribution:throughout", r"\bthroughout\b"),
    ("distribution:generalized", r"\bgenerali[sz]ed\b"),
    ("distribution:extensive", r"\bextensive(?:ly)?\b"),
]
LOCATION = [
    ("lobe:right_upper", r"\bright\s+upper\s+lobe\b", "lobe", "right_upper"),
    ("lobe:right_upper_alt", r"\bupper\s+lobe\s+of\s+(?:the\s+)?right\s+lung\b", "lobe", "right_upper"),
    ("lobe:rul", r"\brul\b", "lobe", "right_upper"),
    ("lobe:right_middle", r"\bright\s+middle\s+lobe\b", "lobe", "right_middle"),
    ("lobe:right_middle_alt", r"\bmiddle\s+lobe\s+of\s+(?:the\s+)?right\s+lung\b", "lobe", "right_middle"),
    ("lobe:middle_unpaired", r"\bmiddle\s+lobe\b", "lobe", "right_middle"),
    ("lobe:rml", r"\brml\b", "lobe", "right_middle"),
    ("lobe:right_lower", r"\bright\s+lower\s+lobe\b", "lobe", "right_lower"),
    ("lobe:right_lower_alt", r"\blower\s+lobe\s+of\s+(?:the\s+)?right\s+lung\b", "lobe", "right_lower"),
    ("lobe:rll", r"\brll\b", "lobe", "right_lower"),
    ("lobe:left_upper", r"\bleft\s+upper\s+lobe\b", "lobe", "left_upper"),
    ("lobe:left_upper_alt", r"\bupper\s+lobe\s+of\s+(?:the\s+)?left\s+lung\b", "lobe", "left_upper"),
    ("lobe:lul", r"\blul\b", "lobe", "left_upper"),
    ("lobe:lingula", r"\blingul(?:a|ar)\b", "lobe", "left_upper"),
    ("lobe:left_lower", r"\bleft\s+lower\s+lobe\b", "lobe", "left_lower"),
    ("lobe:left_lower_alt", r"\blower\s+lobe\s+of\s+(?:the\s+)?left\s+lung\b", "lobe", "left_lower"),
    ("lobe:lll", r"\blll\b", "lobe", "left_lower"),
    ("laterality:right_word", r"\bright\b", "laterality", "right"),
    ("laterality:right", r"\bright(?:[-\s]sided|\s+(?:lung|pulmonary|pleur(?:a|al)|hemithorax|thorax|chest|upper|middle|lower)|\s+side\b)", "laterality", "right"),
    ("laterality:on_right", r"\bon\s+the\s+right\b", "laterality", "right"),
    ("laterality:rul_rml_rll", r"\b(?:rul|rml|rll)\b", "laterality", "right"),
    ("laterality:left_word", r"\bleft\b", "laterality", "left"),
    ("laterality:left", r"\bleft(?:[-\s]sided|\s+(?:lung|pulmonary|pleur(?:a|al)|hemithorax|thorax|chest|upper|lower)|\s+side\b)", "laterality", "left"),
    ("laterality:on_left", r"\bon\s+the\s+left\b", "laterality", "left"),
    ("laterality:lul_lll", r"\b(?:lul|lll)\b", "laterality", "left"),
    ("laterality:lingula", r"\blingul(?:a|ar)\b", "laterality", "left"),
    ("vertical:apical", r"\bapical\b", "vertical", "apical"),
    ("vertical:apex", r"\bap(?:ex|ices)\b", "vertical", "apical"),
    ("vertical:upper_zone", r"\bupper\s+(?:lung\s+)?zone\b", "vertical", "apical"),
    ("vertical:basal", r"\b(?:postero|antero|latero|medio)?basal\b", "vertical", "basal"),
    ("vertical:base", r"\b(?:lung\s+)?bases?\b", "vertical", "basal"),
    ("vertical:lower_zone", r"\blower\s+(?:lung\s+)?zone\b", "vertical", "basal"),
    ("radial:central", r"\bcentral(?:ly)?\b", "radial", "central"),
    ("radial:inner", r"\binner\s+(?:lung|zone)\b", "radial", "central"),
    ("radial:peripheral", r"\bperipheral(?:ly)?\b", "radial", "peripheral"),
    ("radial:outer", r"\bouter\s+(?:lung|zone)\b", "radial", "peripheral"),
    ("relation:subpleural", r"\bsub[-\s]?pleural\b", "relation", "subpleural"),
    ("relation:juxtapleural", r"\bjuxta[-\s]?pleural\b", "relation", "subpleural"),
    ("relation:hilar", r"\bhilar\b", "relation", "hilar"),
    ("relation:perihilar", r"\bperi[-\s]?hilar\b", "relation", "hilar"),
    ("relation:peribronchial", r"\bperi[-\s]?bronchial\b", "relation", "peribronchial"),
    ("relation:peribronchovascular", r"\bperi[-\s]?bronchovascular\b", "relation", "peribronchial"),
]
DIMENSIONS = ["lobe", "laterality", "vertical", "radial", "relation"]
GUARDS = [("negation", NEGATION, "unknown"), ("ambiguity", AMBIGUITY, "unknown"),
          ("bilateral_or_multifocal", BILATERAL, "bilateral_or_multifocal"), ("diffuse", DIFFUSE, "diffuse")]


def _found(text: Column, rules: list) -> Column:
    """Ids of the matching rules by first position, then end, then id; positions are looked for only where any rule matches."""
    hits = []
    for rule in rules:
        pattern = F.lit("(?U)" + rule[1])
        start = F.regexp_instr(text, pattern)
        hits.append(F.when(start > 0, F.struct(start.alias("s"), (start + F.length(F.regexp_substr(text, pattern))).alias("e"), F.lit(rule[0]).alias("id"))))
    some = text.rlike("(?U)" + "|".join(f"(?:{rule[1]})" for rule in rules))
    ids = F.transform(F.array_sort(F.array_compact(F.array(*hits))), lambda h: h["id"])
    return F.when(some, ids).otherwise(F.array().cast("array<string>"))


def classify(df: DataFrame, column: str) -> DataFrame:
    """H2: group, location target, matched rules and reason codes of a normalised text.

    Guards apply in order: negation, ambiguity, bilateral or multifocal, diffuse. Else each
    location dimension may carry one value; conflicts inside a dimension or between lobe
    and side give ``unknown`` with reasons.
    """
    text = F.col(column)
    rows = df
    for name, rules, _ in GUARDS:
        rows = rows.withColumn(f"__{name}", _found(text, rules))
    rows = rows.withColumn("__location", _found(text, LOCATION))
    for dim in DIMENSIONS:
        values = [F.when(F.array_contains("__location", r[0]), r[3]) for r in LOCATION if r[2] == dim]
        rows = rows.withColumn(f"__{dim}", F.array_distinct(F.array_compact(F.array(*values))))
    conflicts = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"__{d}") > 1, f"conflicting_{d}") for d in DIMENSIONS])))
    rows = rows.withColumn("__conflicts", conflicts)
    first = lambda d: F.get(f"__{d}", F.lit(0))
    lobe_side = F.substring_index(first("lobe"), "_", 1)
    crossed = first("lobe").isNotNull() & first("laterality").isNotNull() & (first("laterality") != lobe_side)
    none = sum((F.size(f"__{d}") for d in DIMENSIONS), F.lit(0)) == 0
    state = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty_prompt")
    for name, _, _ in GUARDS:
        state = state.when(F.size(f"__{name}") > 0, f"{name}_guard")
    state = state.when(F.size("__conflicts") > 0, "conflict").when(crossed, "conflicting_lobe_laterality").when(
        none, "no_safe_literal_location").otherwise("unambiguous_literal_match")
    rows = rows.withColumn("__state", state)
    ok = F.col("__state") == "unambiguous_literal_match"
    group = F.lit("unknown")
    for name, _, shown in GUARDS:
        group = F.when(F.col("__state") == f"{name}_guard", shown).otherwise(group)
    located = (F.when(F.size("__lobe") > 0, "exact_lobe").when(F.size("__relation") > 0, first("relation"))
               .when(F.size("__vertical") > 0, "apical_or_basal").when(F.size("__radial") > 0, "central_or_peripheral").otherwise("laterality_only"))
    matched = F.col("__location")
    for name, _, _ in reversed(GUARDS):
        matched = F.when(F.col("__state") == f"{name}_guard", F.col(f"__{name}")).otherwise(matched)
    matched = F.when(F.col("__state") == "empty_prompt", F.array().cast("array<string>")).otherwise(matched)
    reasons = F.when(F.col("__state") == "conflict", F.col("__conflicts")).otherwise(F.array("__state"))
    side = F.coalesce(F.when(first("lobe").isNotNull(), lobe_side), first("laterality"))
    return rows.select(
        *df.columns, F.when(ok, located).otherwise(group).alias("group"), F.when(ok, side).alias("laterality"),
        *[F.when(ok, first(d)).alias(d) for d in ("lobe", "vertical", "radial", "relation")],
        matched.alias("matched_rules"), reasons.alias("reason_codes"), ok.alias("is_restrictive"))


# ---------------------------------------------------------------- fixed values: routing patterns

INCLUDE_PATTERNS = {
    "lung": r"\blungs?\b",
    "lobe": r"\blobes?\b",
    "lingula": r"\blingul(?:a|ar)\b",
    "pulmonary": r"\bpulmonary\b",
    "parenchymal": r"\bparenchym(?:a|al)\b",
    "centrilobular": r"\bcentrilobular\b",
    "segment": r"\b(?:segment|segments|apical|apicoposterior|anterior|posterior|superior|inferior|anterobasal|posterobasal|laterobasal|lateral basal|medial basal|mediobasal|basal)\b",
}
EXCLUDE_PATTERNS = {
    "pleural": r"\b(?:pleura|pleural|pleuroparenchymal|subpleural|juxtapleural|hemithorax)\b",
    "effusion": r"\beffusions?\b",
    "pneumothorax": r"\bpneumothorax\b",
    "peripheral": r"\bperipheral(?:ly)?\b",
    "fissural": r"\b(?:fissure|fissural|perifissural)\b",
    "airway": r"\b(?:airway|bronchial|bronchiectasis|bronchiectatic|bronchus|bronchi|bronchovascular|peribronchial|trachea|tracheal|tree in bud)\b",
    "central_hilar_mediastinal": r"\b(?:central|hilar|perihilar|mediastinal|paramediastinal|paracardiac|pericardiac|retrocardiac)\b",
    "diaphragm_chest_wall": r"\b(?:diaphragm|diaphragmatic|chest wall|chestwall|subcutaneous|paravertebral|costovertebral|parasternal|rib|ribs|sternal|sternum|costal)\b",
    "lymph_node": r"\b(?:lymph|lymphadenopathy|adenopathy|node|nodes)\b",
    "extrapulmonary": r"\b(?:abdominal|abdomen|liver|spleen|adrenal|soft tissue)\b",
}
POLICY_EXCLUDES = {
    "strict_clean_lung": ["pleural", "effusion", "pneumothorax", "peripheral", "fissural", "airway", "central_hilar_mediastinal",
                          "diaphragm_chest_wall", "lymph_node", "extrapulmonary"],
    "allow_peripheral": ["pleural", "effusion", "pneumothorax", "fissural", "airway", "central_hilar_mediastinal", "diaphragm_chest_wall",
                         "lymph_node", "extrapulmonary"],
    "broad_lung_prompt": ["pleural", "effusion", "pneumothorax", "fissural", "central_hilar_mediastinal", "diaphragm_chest_wall", "lymph_node"],
}
MULTIFOCAL = r"\b(?:diffuse|diffusely|widespread|bilateral|both|multiple|multifocal|scattered|several|throughout)\b"
SCOPE_LABELS = {"LU": [10], "LL": [11], "RU": [12], "RM": [13], "RL": [14], "L": [10, 11], "R": [12, 13, 14],
                "B": [10, 11, 12, 13, 14], "W": [10, 11, 12, 13, 14], "N": []}
LOBE_PATTERNS = {
    "LL": r"(?:left|lt\.?)[ -]*(?:lower|inferior)[ -]*lobe",
    "LU": r"(?:left|lingu(?:la|lar)|lt\.?)[ -]*(?:upper|sup(?:erior)?)[ -]*lobe",
    "RL": r"(?:right|rt\.?)[ -]*(?:lower|inferior)[ -]*lobe",
    "RM": r"(?:right|rt\.?)[ -]*middle[ -]*lobe",
    "RU": r"(?:right|rt\.?)[ -]*(?:upper|sup(?:erior)?)[ -]*lobe",
}
SIDE_PATTERNS = {"L": r"\b(?:left|lt\.?|lingula|lingular)\b", "R": r"\b(?:right|rt\.?)\b"}
RISK_PATTERNS = {
    "peripheral": r"peripheral|subpleural|pleural[ -]?based|juxtapleural|paraseptal",
    "pleural": r"pleur",
    "fissural": r"fissur",
    "airway": r"airway|bronch|tree[ -]?in[ -]?bud|centrilobular",
    "vascular": r"vascular|vessel|aorta|artery|vein",
    "pneumothorax": r"pneumothorax",
    "landmark": r"mediast|hilar|diaphragm|chest wall|fissur",
}
BOTH_SIDES = r"\bbilateral\b|\bboth\s+(?:lungs|sides)\b"
EXTENTS = {"diffuse": r"diffuse|widespread|extensive|throughout", "multifocal": r"multifocal|multiple|bilateral",
           "focal": r"focal|single|solitary|nodule|mass|opacity|focus"}
LUNG_WORDS = r"lung|pulmonary|parench|opacity|nodule|mass|consolid|ground.?glass"
LUNG_ONLY = r"lung|pulmonary|parench"
UNCERTAIN = r"uncertain|indeterminate|nonspecific|cannot exclude"
NEGATED = r"no |without |absence of"
EXTRAPULMONARY_CATEGORIES = ["2e", "2g"]


def _names(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike("(?U)" + p), n) for n, p in patterns.items()]))


def route(df: DataFrame, column: str) -> DataFrame:
    """H3: per policy whether a prompt is gated, with the include and active exclude terms; and risk groups."""
    rows = df.withColumn("__t", simple_text(column))
    rows = rows.withColumn("include", _names(F.col("__t"), INCLUDE_PATTERNS)).withColumn("exclude", _names(F.col("__t"), EXCLUDE_PATTERNS))
    risks = F.concat("exclude", F.when(F.col("__t").rlike("(?U)" + MULTIFOCAL), F.array(F.lit("diffuse_multifocal"))).otherwise(
        F.array().cast("array<string>")))
    risks = F.when(F.size(risks) == 0, F.array(F.lit("clean_or_unspecified"))).otherwise(F.array_sort(F.array_distinct(risks)))
    out = []
    for policy, names in POLICY_EXCLUDES.items():
        active = F.filter("exclude", lambda x: x.isin(names)) if len(names) else F.array()
        out += [((F.size("include") > 0) & (F.size(active) == 0)).alias(f"{policy}_gate"), active.alias(f"{policy}_exclude")]
    return rows.select(*df.columns, "include", risks.alias("risk_groups"), *out)


def route_scope(df: DataFrame, column: str, category: str = "category") -> DataFrame:
    """H3: side or lobe scope, extent, risks, eligibility and anatomical labels of a prompt."""
    t = F.lower(column)
    rows = df.withColumn("__t", t)
    t = F.col("__t")
    has = lambda p: t.rlike("(?U)" + p)
    rows = rows.withColumn("risks", _names(t, RISK_PATTERNS)).withColumn("lobes", _names(t, LOBE_PATTERNS))
    left, right, both = has(SIDE_PATTERNS["L"]), has(SIDE_PATTERNS["R"]), has(BOTH_SIDES)
    scope = (F.when(both | (left & right), "B").when(F.size("lobes") > 0, F.array_join("lobes", "+")).when(left, "L").when(right, "R").otherwise("W"))
    extent = F.lit("unclear")
    for name, pattern in reversed(EXTENTS.items()):
        extent = F.when(has(pattern), name).otherwise(extent)
    risk = lambda n: F.array_contains("risks", n)
    pleura = risk("pleural") & ~has(LUNG_WORDS)
    outside = F.col(category).isin(EXTRAPULMONARY_CATEGORIES) | pleura | risk("pneumothorax") | (risk("vascular") & ~has(LUNG_ONLY))
    fine = ~outside & ((F.size("lobes") > 0) | (left != right) | both)
    rows = rows.withColumn("scope", scope).withColumn("eligible", ~outside).withColumn("fine_eligible", fine)
    members = [F.when(F.array_contains(F.split("scope", r"\+"), code), F.array(*[F.lit(n) for n in nums]))
               for code, nums in SCOPE_LABELS.items() if nums]
    labels = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*members)))))
    side = (F.when(F.col("scope") == "B", "bilateral").when(F.col("scope").startswith("L"), "left")
            .when(F.col("scope").startswith("R"), "right").otherwise("unspecified"))
    why = (F.when(~F.col("eligible"), "no restriction: target is not represented by lung support")
           .when(F.col("fine_eligible"), "named side or lobe").otherwise("whole lung only"))
    return rows.select(
        *df.columns, extent.alias("extent"), side.alias("laterality"), "lobes", "scope", "risks", "eligible", "fine_eligible",
        F.when(F.col("eligible"), labels).otherwise(F.array().cast("array<int>")).alias("labels"), why.alias("rationale"),
        has(UNCERTAIN).alias("uncertainty"), has(NEGATED).alias("negation"))


# ---------------------------------------------------------------- fixed values: location wording

PRIMARY_RULES = [
    ("Bilateral / both lungs", [r"\b(?:both lungs|bilateral(?:ly)?|both lung parenchyma|both upper lobes|both lower lobes)\b"]),
    ("Left lower lobe", [r"\bleft lower lobe\b", r"\blower lobe of the left lung\b"]),
    ("Right lower lobe", [r"\bright lower lobe\b", r"\blower lobe of the right lung\b", r"\bsuperior right lower lobe\b"]),
    ("Right upper lobe", [r"\bright upper lobe\b", r"\bupper lobe of the right lung\b"]),
    ("Right middle lobe", [r"\bright middle lobe\b"]),
    ("Left upper lobe", [r"\bleft upper lobe\b", r"\bupper lobe of the left lung\b"]),
    ("Right lung, lobe not stated", [r"\bright lung\b"]),
    ("Right minor fissure / perifissural", [r"\bright minor fissure\b", r"\bperifissural\b"]),
    ("Left lung fissure", [r"\bleft lung fissure\b"]),
    ("Laterobasal, side not stated", [r"\blaterobasal\b"]),
    ("Right apical (bleb wording)", [r"\bright apical\b"]),
]
PRIMARY_DEFAULT = "No location stated"
CUE_RULES = [
    ("Bilateral / both lungs", "laterality/distribution", [r"\b(?:both lungs|bilateral(?:ly)?|both lung parenchyma|both upper lobes|both lower lobes)\b"]),
    ("Left lower lobe", "lobe", [r"\bleft lower lobe\b", r"\blower lobe of the left lung\b"]),
    ("Right lower lobe", "lobe", [r"\bright lower lobe\b", r"\blower lobe of the right lung\b", r"\bsuperior right lower lobe\b"]),
    ("Right upper lobe", "lobe", [r"\bright upper lobe\b", r"\bupper lobe of the right lung\b"]),
    ("Right middle lobe", "lobe", [r"\bright middle lobe\b"]),
    ("Left upper lobe", "lobe", [r"\bleft upper lobe\b", r"\bupper lobe of the left lung\b"]),
    ("Right-lung wording", "laterality", [r"\bright lung\b"]),
    ("Left-lung wording", "laterality", [r"\bleft lung\b"]),
    ("Basal / laterobasal / posterobasal / anterobasal / mediobasal", "within-lung qualifier", [r"\b(?:basal|laterobasal|posterobasal|anterobasal|mediobasal)\b"]),
    ("Subpleural", "surface/relationship", [r"\bsubpleural\b"]),
    ("Lateral / laterobasal", "within-lung qualifier", [r"\blateral\b", r"\blaterobasal\b"]),
    ("Posterior / posterobasal", "within-lung qualifier", [r"\bposterior\b", r"\bposterobasal\b"]),
    ("Superior", "within-lung qualifier", [r"\bsuperior\b"]),
    ("Anterior / anterobasal", "within-lung qualifier", [r"\banterior\b", r"\banterobasal\b"]),
    ("Fissural / perifissural", "surface/relationship", [r"\bfissure\b", r"\bperifissural\b"]),
    ("Peripheral", "surface/relationship", [r"\bperipheral(?:ly)?\b"]),
    ("Diaphragmatic / juxtadiaphragmatic", "within-lung qualifier", [r"\b(?:diaphragmatic|juxtadiaphragmatic)\b"]),
    ("Lingular", "within-lung qualifier", [r"\blingular\b"]),
    ("Medial / mediobasal", "within-lung qualifier", [r"\bmedial\b", r"\bmediobasal\b"]),
    ("Pleural-based", "surface/relationship", [r"\bpleural[- ]based\b"]),
    ("Apical / apex", "within-lung qualifier", [r"\b(?:apical|apex)\b"]),
    ("Intrapulmonary", "relationship", [r"\bintrapulmonary\b"]),
]
TOPIC_RULES = [
    ("nodule", r"\bnodul"),
    ("ground_glass", r"ground[- ]glass"),
    ("consolidation", r"consolidat|infiltrat"),
    ("effusion", r"effusion"),
    ("atelectasis", r"atelect"),
    ("cyst_cavity", r"\bcyst|cavit"),
    ("lymph_node", r"lymph|adenopath"),
]


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?iU)(?:" + "|".join(patterns) + ")")


def first_label(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """H4: label of the first rule with a matching pattern."""
    out = F.lit(default)
    for label, patterns in reversed(rules):
        out = F.when(_any(text, patterns), label).otherwise(out)
    return out


def topic(column: str) -> Column:
    """H4: coarse topic of a prompt."""
    return first_label(F.col(column), [(n, [p]) for n, p in TOPIC_RULES], "other")


def text_audit(df: DataFrame, column: str, by: list[str], primary: list = PRIMARY_RULES, cues: list = CUE_RULES,
               default: str = PRIMARY_DEFAULT) -> DataFrame:
    """H4: counts, fraction and rank of the first-match label and of every cue, per group.

    A text has one primary label and any number of cues; absent labels are not listed.
    """
    t = F.col(column)
    hits = F.array_compact(F.array(
        F.struct(F.lit("primary").alias("kind"), first_label(t, primary, default).alias("label")),
        *[F.when(_any(t, p), F.struct(F.lit("cue").alias("kind"), F.lit(n).alias("label"))) for n, _, p in cues]))
    counts = df.select(*by, F.explode(hits).alias("h")).groupBy(*by, "h.kind", "h.label").agg(F.count(F.lit(1)).alias("findings"))
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    rows = counts.join(totals, by) if by else counts.crossJoin(F.broadcast(totals))
    # One row per rule and group: the window sees at most the size of the rule table.
    rank = F.row_number().over(W.partitionBy(*by, "kind").orderBy(F.desc("findings"), "label"))
    return rows.select(*by, "kind", "label", "findings", (F.col("findings") / F.col("total")).alias("fraction"), rank.alias("rank"))


def compare_audits(a: DataFrame, b: DataFrame) -> DataFrame:
    """H4: two audits side by side; a label missing on one side counts 0 there."""
    left = a.select("kind", "label", F.col("findings").alias("a_findings"), F.col("fraction").alias("a_fraction"), F.col("rank").alias("a_rank"))
    right = b.select("kind", "label", F.col("findings").alias("b_findings"), F.col("fraction").alias("b_fraction"), F.col("rank").alias("b_rank"))
    rows = left.join(right, ["kind", "label"], "full_outer").fillna(0, ["a_findings", "b_findings"]).fillna(0.0, ["a_fraction", "b_fraction"])
    return rows.withColumn("difference", F.col("b_fraction") - F.col("a_fraction"))


def _top(df: DataFrame, by: list[str], order: list, n: int, spread: str) -> DataFrame:
    """First n rows of each group by ``order``: per slice first, so no task ranks a whole group."""
    part = F.pmod(F.xxhash64(spread), F.lit(64))
    local = df.withColumn("__p", part).withColumn("__r", F.row_number().over(W.partitionBy(*by, "__p").orderBy(*order))).where(F.col("__r") <= n)
    return local.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n).drop("__p", "__r")


def vocabulary(df: DataFrame, column: str, split: str, splits: list[str], terms: dict[str, list[str]], variants: int = 12, examples: int = 3) -> DataFrame:
    """H5: per concept the prompts that use it by split, its frequent raw forms and some examples.

    Equal prompts are counted once and weighted by how often they occur.
    """
    prompts = df.groupBy(column, split).agg(F.count(F.lit(1)).alias("n"))
    low = F.lower(column)
    uses = F.array_compact(F.array(*[
        F.when(_any(F.col(column), ps), F.struct(F.lit(c).alias("concept"), F.array_distinct(F.flatten(F.array(*[
            F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(0)) for p in ps]))).alias("forms"))) for c, ps in terms.items()]))
    rows = prompts.select(column, split, "n", F.explode(uses).alias("u")).select(column, split, "n", "u.concept", "u.forms")
    counts = rows.groupBy("concept").agg(*[F.sum(F.when(F.col(split) == s, F.col("n")).otherwise(0)).alias(s) for s in splits], F.sum("n").alias("total"))
    forms = rows.select("concept", "n", F.explode("forms").alias("form")).groupBy("concept", "form").agg(F.sum("n").alias("n"))
    best = _top(forms, ["concept"], [F.desc("n"), "form"], variants, "form").groupBy("concept").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "form", "n"))), lambda x: F.concat(x["form"], F.lit(" ("), x["n"], F.lit(")"))), "; ").alias("variants"))
    texts = rows.select("concept", column).distinct()
    shown = _top(texts, ["concept"], [column], examples, column).groupBy("concept").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", column))), lambda x: x[column]), " / ").alias("examples"))
    return counts.join(best, "concept").join(shown, "concept")
