"""Personal data, and terms that reveal it: information-theoretic sanitisation from DataFrame functions alone.

Patterns find the protected entities. How strongly a term reveals one is estimated from the corpus: by the pointwise
mutual information of term and entity, against the information content of the entity itself. Terms that disclose more
than a share of that content are spans of their own, to be generalised in every document that holds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmeter.llm.io import checkpointed, release

# The kinds in their order. Possessive repeats and starts at the front of a run keep each search linear; they
# match what the plain patterns match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
TERM = r"[\p{L}\p{N}]{4,}"
CONTEXT_CHARS = 80
DISCLOSURE = 0.5
MIN_CONTEXTS = 3
MIN_SHARE = 0.5
BROADCAST_TERMS = 500_000
_BLOCK = 256
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(steps: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or other joins that leave a number joined with 0, of an array of numbers from 0, in blocks so that long arrays take little more than linear time."""
    def inner(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(join(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: inner(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(blocks, lambda sums: let(
        F.aggregate(sums, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(join(F.element_at(acc, -1), F.element_at(block, -1))))),
        lambda offsets: F.flatten(F.transform(sums, lambda block, i: F.transform(block, lambda x: join(x, F.get(offsets, i)))))))


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int"), lambda n: F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)))
    return F.aggregate(F.filter(doubled, lambda n: n.isNotNull()), F.lit(0), lambda acc, n: acc + n) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return let(F.translate(match, " -", ""), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def _cut(kind: str, text: Column) -> Column:
    """Struct (found, gaps): the matches of a kind, and the stretches before, between and behind them; null if there are none."""
    pattern = PATTERNS[kind]
    both = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))))
    return F.when(F.instr(text, NEEDS[kind]) > 0, both) if NEEDS[kind] else both


def _placed(found: Column, gaps: Column, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Spans of the valid matches, in code points."""
    steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(F.lit(0)))
    spans = F.zip_with(found, _running(steps, lambda a, b: a + b), lambda m, start: F.struct(
        start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("value")))
    return F.filter(spans, lambda s: valid(s["value"]))


def base_spans(text: Column) -> Column:
    """All valid base matches of a text as an array of (start, kind, end, value) in order; kind is an index of KINDS."""
    def one(i: int) -> Column:
        spans = let(_cut(KINDS[i], text), lambda c: F.when(c.isNotNull(), _placed(c["found"], c["gaps"], i, lambda m: _valid(KINDS[i], m))))
        return F.coalesce(spans, F.array().cast(_SPAN))
    return F.sort_array(F.concat(*(one(i) for i in range(len(KINDS)))))


def _contexts(text: Column) -> Column:
    """(entity, context) of each valid match: kind and value in lower case, and the words about it."""
    def one(kind: str) -> Column:
        def near(c: Column) -> Column:
            around = F.transform(c["found"], lambda m, i: F.struct(
                F.concat(F.lit(kind + ":"), F.lower(m)).alias("entity"),
                F.concat_ws(" ", F.right(F.get(c["gaps"], i), F.lit(CONTEXT_CHARS)), F.left(F.get(c["gaps"], i + 1), F.lit(CONTEXT_CHARS))).alias("context"), m.alias("match")))
            return F.filter(around, lambda s: _valid(kind, s["match"]))
        return F.coalesce(let(_cut(kind, text), lambda c: F.when(c.isNotNull(), near(c))), F.array().cast("array<struct<entity:string,context:string,match:string>>"))
    return F.concat(*(one(k) for k in KINDS))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _pairs(documents: DataFrame) -> DataFrame:
    """(entity, term, together, contexts, times): how often entities and the terms of their contexts occur, alone and together."""
    text = F.col("text").cast("string")
    seen = documents.where(text.isNotNull()).select(F.explode(_contexts(text)).alias("c")).select(
        "c.entity", F.regexp_replace(F.lower("c.context"), r"[^\p{L}\p{N}]+", " ").alias("context"))
    contexts = checkpointed(seen.groupBy("entity", "context").agg(F.count("*").alias("times")))
    entities = contexts.groupBy("entity").agg(F.count("*").alias("contexts"), F.sum("times").alias("times")).where(F.col("contexts") >= MIN_CONTEXTS)
    words = contexts.select("entity", F.explode(_words(F.col("context"))).alias("term"))
    pairs = checkpointed(words.groupBy("entity", "term").agg(F.count("*").alias("together")).where(F.col("together") >= MIN_CONTEXTS).join(entities, "entity").where(
        F.col("together") >= MIN_SHARE * F.col("contexts")))
    release(contexts)
    return pairs


def _row_key(text: Column) -> Column:
    """Which terms a text holds follows from the text, so rows that share a key do no harm."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))


def _holders(documents: DataFrame) -> DataFrame:
    """(term, holders): in how many document rows each word stands; counted in each task first, without a row for each document and term."""
    text = F.lower(F.col("text").cast("string"))
    return documents.where(text.isNotNull()).select(F.explode(_words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("holders"))


def _named(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(__named, __terms): the given terms that each document row holds; no row if none."""
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)  # of bounded size; the words of all documents are not shuffled then
    text = F.col("text").cast("string")
    words = documents.where(text.isNotNull()).select(_row_key(text).alias("__named"), F.explode(_words(F.lower(text))).alias("term"))
    return words.join(terms, "term").groupBy("__named").agg(F.sort_array(F.collect_set("term")).alias("__terms"))


def _disclosing(documents: DataFrame, pairs: DataFrame, holders: DataFrame, disclosure: float) -> DataFrame:
    total = documents.select(F.count("*").alias("docs"))
    known = pairs.join(holders, "term").crossJoin(F.broadcast(total))  # one row
    pmi = F.log(F.col("together") / F.col("contexts") / (F.col("holders") / F.col("docs")))
    content = -F.log(F.least(F.col("times") / F.col("docs"), F.lit(1.0)))
    return known.where((pmi > 0) & (pmi > disclosure * content)).select("entity", "term")


def disclosing_terms(documents: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term): terms that give away more than ``disclosure`` of what naming the entity itself would.

    PMI(term; entity) = log(P(term | entity) / P(term)) is held against ``disclosure`` times -log P(entity). P(term) and
    P(entity) are shares of all documents that hold them; P(term | entity) the share of the entity's distinct contexts, 80 characters to
    each side, that hold the term, so copies of a passage count once. A term must occur in at least three distinct contexts and
    half of the entity's. Null texts count as documents without words.
    """
    pairs = _pairs(documents)
    return _disclosing(documents, pairs, _holders(documents), disclosure)


def _with_terms(documents: DataFrame, disclosure: float) -> DataFrame:
    """The rows with ``__terms``: the disclosing terms that each holds, whether or not it names their entity; null if none."""
    pairs = _pairs(documents)
    known = checkpointed(_disclosing(documents, pairs, _holders(documents), disclosure).select("term").distinct())
    release(pairs)
    terms = checkpointed(_named(documents, known))
    release(known)
    # Holders grow with the input: never broadcast, so that texts are shuffled alike at every size.
    return documents.join(terms.hint("merge"), _row_key(F.col("text").cast("string")) == F.col("__named"), "left").drop("__named")


def _term_pattern(terms: Column) -> Column:
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def _term_cut(text: Column, terms: Column) -> Column:
    found = F.regexp_extract_all(text, _term_pattern(terms), F.lit(0))
    return F.when(terms.isNotNull(), let(found, lambda f: F.when(F.size(f) > 0, F.struct(f.alias("found"), F.split(text, _term_pattern(terms), -1).alias("gaps")))))


def _term_spans(text: Column, terms: Column) -> Column:
    spans = let(_term_cut(text, terms), lambda c: F.when(c.isNotNull(), _placed(c["found"], c["gaps"], len(KINDS), lambda m: F.lit(True))))
    return F.coalesce(spans, F.array().cast(_SPAN))


def find(documents: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, base, terms) per row: spans of personal data, and of terms that reveal it, in code points.

    A null text is empty. Terms are looked for in all documents, also where their entity is not named. Every row is searched for itself, whether or not
    its doc_id repeats or is null, and whole, however long its text is.
    """
    marked = _with_terms(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), disclosure)
    return marked.select("doc_id", base_spans(F.col("text")).alias("base"), _term_spans(F.col("text"), F.col("__terms")).alias("terms"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text."""
    def of_kind(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.size("terms").cast("long").alias("n_term"), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.sort_array(F.concat("base", "terms"))).alias("spans"))


def _masked(text: Column, kind: str, cut: Column) -> Column:
    def glue(c: Column) -> Column:
        pieces = F.transform(c["gaps"], lambda gap, i: F.concat(gap, F.coalesce(
            let(F.get(c["found"], i), lambda m: F.when(m.isNotNull(), F.when(_valid(kind, m), F.lit(PLACEHOLDERS[kind])).otherwise(m))), F.lit(""))))
        return F.array_join(pieces, "")
    return let(cut, lambda c: F.when(c.isNotNull(), glue(c)).otherwise(text))


def _merged(spans: Column) -> Column:
    """Spans that overlap as one, from the first start to the last end, of the first of their kinds; terms are the last kind."""
    def of(s: Column, reach: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))
        return let(firsts, lambda at: F.transform(at, lambda i, k: let(F.coalesce(F.get(at, k + 1), F.size(s)), lambda stop: F.struct(
            F.get(s, i)["start"].alias("start"), F.get(reach, stop - 1).alias("end"), F.array_min(F.transform(F.slice(s, i + 1, stop - i), lambda x: x["kind"])).alias("kind")))))
    return let(F.sort_array(spans), lambda s: let(_running(F.transform(s, lambda x: x["end"]), F.greatest), lambda reach: of(s, reach)))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with placeholders for its spans, of which there is one at least; in blocks, as finding a place takes time with its distance from the front."""
    names = F.array(*(F.lit(PLACEHOLDERS[k]) for k in (*KINDS, "term")))

    def block(m: Column, b: Column) -> Column:
        def glue(part: Column, front: Column) -> Column:
            own = F.substr(text, front + 1, F.element_at(part, -1)["end"] - front)

            def piece(stretch: Column, s: Column, i: Column) -> Column:
                before = F.coalesce(F.get(part, i - 1)["end"], front)
                return F.concat(F.substr(stretch, before - front + 1, s["start"] - before), F.get(names, s["kind"]))
            return let(own, lambda stretch: F.array_join(F.transform(part, lambda s, i: piece(stretch, s, i)), ""))
        return let(F.slice(m, b * _BLOCK + 1, F.lit(_BLOCK)), lambda part: let(F.coalesce(F.get(m, b * _BLOCK - 1)["end"], F.lit(0)), lambda front: glue(part, front)))
    return let(_merged(spans), lambda m: F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / _BLOCK).cast("int")), lambda b: block(m, b)), ""),
        F.substr(text, F.element_at(m, -1)["end"] + 1)))


def sanitise(documents: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """Documents whose texts have placeholders for personal data and generalised terms; columns as given.

    All spans that ``find`` gives, those of the text as it came, are replaced at once; overlapping ones by one placeholder, that of a
    base kind if there is one. What becomes a match only by that, as a card number behind which an address stood, is then replaced kind
    after kind. Null and other texts stay; a column ``n_chars`` follows a changed text.
    """
    marked = _with_terms(documents, disclosure).withColumn("__old", F.col("text").cast("string"))
    kind = documents.schema["text"].dataType
    step = marked.withColumn("__spans", F.concat(base_spans(F.col("__old")), _term_spans(F.col("__old"), F.col("__terms"))))
    step = step.withColumn("__text", F.when(F.size("__spans") > 0, _replaced(F.col("__old"), F.col("__spans"))).otherwise(F.col("__old")))
    for k in KINDS:
        step = step.withColumn("__text", F.when(F.size("__spans") > 0, _masked(F.col("__text"), k, _cut(k, F.col("__text")))).otherwise(F.col("__text")))
    changed = F.col("text").isNotNull() & (F.col("__text") != F.col("text"))
    out = {"text": F.when(changed, F.col("__text").cast(kind)).otherwise(F.col("text"))}
    if "n_chars" in documents.columns:
        out["n_chars"] = F.when(changed, F.length("__text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return step.select(*(out[c].alias(c) if c in out else F.col(c) for c in documents.columns))
