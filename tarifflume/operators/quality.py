"""Validation rules, confidence, corrections and review over the long-form field table.

`fields(extraction_id, field_path, entity, ord, field_name, value, value_num, confidence,
source_page, source_text, needs_review, override)`: one row per extracted value, null
values included. Confidence is DECIMAL(6,4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifflume.functions import values as v
from tarifflume.operators.resolve import CONF

CORE_FIELDS = ["customer_name", "account_number", "agreement_number", "effective_date", "carrier"]
REVIEW_BELOW = "0.7"
VERIFY_BELOW = "0.85"
# Words whose surroundings the verifier always sees.
CONTEXT_WORDS = ["discount", "fuel", "gsr", "dim", "minimum", "accessorial"]


def _dec(x: str) -> Column:
    return F.lit(x).cast(CONF)


def _issues(rows: DataFrame, rules: list[tuple[Column, str, str, str]], *carry: Column | str) -> DataFrame:
    """One pass: every rule (broken, code, severity, entity kind) that a row breaks becomes a row."""
    found = F.array_compact(
        F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(kind).alias("entity_kind"))) for broken, code, sev, kind in rules])
    )
    return rows.select("extraction_id", *carry, F.inline(found))


def validate(metadata: DataFrame, terms: DataFrame, surcharges: DataFrame, dims: DataFrame) -> DataFrame:
    """Issues (extraction_id, entity_id, field, code, severity, entity_kind).

    `metadata` is long-form (field_name, value, confidence); the other inputs are one row
    per term with `ord`.
    """
    f, val, conf = F.col("field_name"), F.nullif("value", F.lit("")), F.col("confidence")
    none = F.lit(None).cast("bigint").alias("entity_id")
    meta = _issues(
        metadata,
        [
            ((f == "customer_name") & val.isNull(), "METADATA_MISSING_CUSTOMER", "warning", "metadata"),
            ((f == "account_number") & val.isNull(), "METADATA_MISSING_ACCOUNT", "warning", "metadata"),
            ((f == "carrier") & (val.isNull() | (val == "Unknown")), "METADATA_MISSING_CARRIER", "warning", "metadata"),
            (f.isin(CORE_FIELDS) & F.col("value").isNotNull() & (conf < _dec("0.5")), "METADATA_LOW_CONFIDENCE", "info", "metadata"),
        ],
        none, f.alias("field"),
    )
    ids = metadata.select("extraction_id").distinct()
    empty = ids.join(terms.select("extraction_id"), "extraction_id", "left_anti").select(
        "extraction_id", none, F.lit(None).cast("string").alias("field"), F.lit("NO_SERVICE_TERMS").alias("code"), F.lit("warning").alias("severity"), F.lit("extraction").alias("entity_kind")
    )
    own = [F.col("ord").cast("bigint").alias("entity_id"), F.lit(None).cast("string").alias("field")]
    service = F.nullif("service_type", F.lit(""))
    pct, sconf = F.col("discount_pct"), F.col("service_confidence")
    term_issues = _issues(
        terms,
        [
            (service.isNull(), "SERVICE_TERM_MISSING_TYPE", "warning", "service_term"),
            (pct.isNull(), "SERVICE_TERM_MISSING_DISCOUNT", "info", "service_term"),
            ((pct < 0) | (pct > 100), "INCONSISTENT_PERCENT_RANGE", "error", "service_term"),
            ((sconf > 0) & (sconf < _dec("0.5")), "SERVICE_TERM_LOW_CONFIDENCE", "info", "service_term"),
        ],
        *own,
    )
    # Later terms of an already seen service: the first one per key comes from a map-side
    # aggregate and is joined back, so a key with very many terms is not gathered.
    keyed = terms.where(service.isNotNull()).withColumn("key", F.lower(F.trim("service_type")))
    seen = keyed.groupBy("extraction_id", "key").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = keyed.join(seen, ["extraction_id", "key"]).where("ord > first_ord").select(
        "extraction_id", *own, F.lit("DUPLICATE_SERVICE_TERM").alias("code"), F.lit("info").alias("severity"), F.lit("service_term").alias("entity_kind")
    )
    fee_issues = _issues(
        surcharges,
        [
            (F.nullif("surcharge_name", F.lit("")).isNull(), "SURCHARGE_MISSING_NAME", "warning", "surcharge"),
            (F.nullif("modification", F.lit("")).isNull(), "SURCHARGE_MISSING_MODIFICATION", "info", "surcharge"),
        ],
        *own,
    )
    dim_issues = _issues(dims, [(F.col("dim_divisor").isNull(), "DIM_RULE_MISSING_DIVISOR", "warning", "dim_rule")], *own)
    return meta.unionByName(empty).unionByName(term_issues).unionByName(repeats).unionByName(fee_issues).unionByName(dim_issues)


def summarize(issues: DataFrame) -> DataFrame:
    """Counts per extraction by severity and by code (a map over the 13 codes)."""
    per_code = issues.groupBy("extraction_id", "code", "severity").agg(F.count(F.lit(1)).alias("n"))
    by = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0))
    return per_code.groupBy("extraction_id").agg(
        F.sum("n").alias("total_issues"), by("error").alias("errors"), by("warning").alias("warnings"), by("info").alias("infos"),
        F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("codes"),
    )


def document_confidence(metadata: DataFrame, terms: DataFrame, surcharges: DataFrame, dims: DataFrame, issues: DataFrame) -> DataFrame:
    """Extraction, completeness and penalty scores and their weighted aggregate."""
    positive = lambda c: F.when(c > 0, c)
    zero = F.lit(0).cast(CONF)
    core = metadata.where(F.col("field_name").isin(CORE_FIELDS))
    credit = lambda c, key: F.coalesce(c, zero).cast("decimal(20,4)").alias(key)

    def part(rows: DataFrame, scores: list[Column], points: Column | None) -> DataFrame:
        total = lambda cols: sum((F.coalesce(positive(c), zero).cast("decimal(20,4)") for c in cols[1:]), F.coalesce(positive(cols[0]), zero).cast("decimal(20,4)"))
        count = sum(((c > 0).cast("int") for c in scores[1:]), F.coalesce((scores[0] > 0).cast("int"), F.lit(0)))
        return rows.groupBy("extraction_id").agg(
            F.sum(total(scores)).alias("conf_sum"), F.sum(count).alias("conf_n"),
            (F.sum(points) if points is not None else F.lit(0)).cast("decimal(20,4)").alias("points"),
            (F.count(F.lit(1)) if points is not None else F.lit(0).cast("bigint")).alias("slots"),
        )

    half = lambda named, full, some: F.when(named & full, _dec("1")).when(named, _dec(some)).otherwise(zero)
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    parts = [
        part(core, [F.col("confidence")], F.col("value").isNotNull().cast("int")),
        part(terms, [F.coalesce("service_confidence", zero), F.coalesce("discount_confidence", zero)], half(has("service_type"), F.col("discount_pct").isNotNull(), "0.5")),
        part(surcharges, [F.col("name_confidence")], half(has("surcharge_name"), has("modification"), "0.4")),
        part(dims, [F.col("divisor_confidence")], None),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    sums = union.groupBy("extraction_id").agg(*[F.sum(c).alias(c) for c in ("conf_sum", "conf_n", "points", "slots")])
    cost = F.when(F.col("severity") == "error", _dec("0.12")).when(F.col("severity") == "warning", _dec("0.05")).otherwise(_dec("0.015"))
    penalties = issues.groupBy("extraction_id").agg(F.sum(cost).alias("penalty"))
    # Exact decimals, half up.
    share = lambda top, n: F.round(F.try_divide(F.col(top).cast("decimal(20,4)"), F.col(n).cast("decimal(12,0)")), 4).cast(CONF)
    ext = F.when(F.col("conf_n") > 0, share("conf_sum", "conf_n")).otherwise(_dec("0.4"))
    norm = F.when(F.col("slots") > 0, F.least(_dec("1"), share("points", "slots"))).otherwise(_dec("0.5"))
    penalty = F.least(F.lit(1).cast("decimal(20,4)"), F.coalesce(F.col("penalty").cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))).cast(CONF)
    scored = sums.join(penalties, "extraction_id", "left").select(
        "extraction_id", ext.alias("extraction"), norm.alias("normalization"), penalty.alias("validation_penalty")
    )
    weight = lambda w, c: F.lit(w).cast("decimal(3,2)") * c
    total = weight("0.45", F.col("extraction")) + weight("0.35", F.col("normalization")) + weight("0.20", _dec("1") - F.col("validation_penalty"))
    return scored.withColumn("aggregate", F.greatest(_dec("0"), F.least(_dec("1"), F.round(total, 4).cast(CONF))))


def rescore(fields: DataFrame) -> DataFrame:
    """Refined confidence and review flag of every field."""
    name, text, num = F.col("field_name"), F.col("value"), F.col("value_num")
    conf, one = F.col("confidence"), _dec("1")
    is_text = text.isNotNull() & num.isNull()
    up = lambda c, by: F.least((c + _dec(by)).cast(CONF), one)
    base = (
        F.when(F.contains(name, F.lit("date")), F.when(is_text & text.rlike(r"\d{4}-\d{2}-\d{2}"), up(conf, "0.05")).otherwise(conf))
        .when(F.contains(name, F.lit("account")), F.when(is_text & text.rlike(r"[\dA-Z]{4,}"), up(conf, "0.05")).otherwise(conf))
        .when((F.contains(name, F.lit("percentage")) | F.contains(name, F.lit("divisor"))) & num.isNotNull(), up(conf, "0.05"))
        .otherwise(conf)
    )
    sourced = F.col("source_page").isNotNull() & F.coalesce(F.col("source_text") != "", F.lit(False))
    refined = F.when(text.isNull(), _dec("0")).otherwise(F.round(F.when(sourced, up(base, "0.03")).otherwise(base), 3)).cast(CONF)
    return fields.withColumn("confidence", refined).withColumn(
        "needs_review", F.when(text.isNotNull(), F.col("confidence") < _dec(REVIEW_BELOW)).otherwise(F.col("needs_review"))
    )


def extraction_scores(scored: DataFrame) -> DataFrame:
    """Mean confidence and counts per extraction, over the filled fields."""
    filled = F.col("value").isNotNull()
    counted = scored.groupBy("extraction_id").agg(
        F.sum(F.when(filled, F.col("confidence"))).alias("total"),
        F.count_if(filled).alias("fields_extracted"),
        F.count_if(filled & F.col("needs_review")).alias("fields_needing_review"),
    )
    mean = F.round(F.coalesce(F.col("total").cast("double"), F.lit(0.0)) / F.greatest("fields_extracted", F.lit(1)), 3)
    return counted.select("extraction_id", mean.alias("overall_confidence"), "fields_extracted", "fields_needing_review")


def field_problems(fields: DataFrame) -> DataFrame:
    """Generic check: missing value, or confidence above zero and below .35."""
    kind, name = F.upper("entity"), F.upper("field_name")
    missing = F.col("value").isNull() | (F.col("value") == "")
    low = (F.col("confidence") > 0) & (F.col("confidence") < _dec("0.35"))
    codes = F.array_compact(F.array(F.when(missing, F.concat_ws("_", kind, F.lit("MISSING"), name)), F.when(low, F.concat_ws("_", kind, F.lit("LOW_CONFIDENCE")))))
    return fields.select("extraction_id", "field_path", F.explode(codes).alias("code"))


def verifier_candidates(fields: DataFrame, max_chars: int | None = None) -> DataFrame:
    """All doubtful fields in (confidence, path) order, with the JSON size used up to each.

    `max_chars` keeps those that fit a budget.
    """
    body = F.to_json(
        F.struct(
            "field_path", "value", F.col("confidence").cast("double").alias("confidence"), "needs_review", "source_page",
            F.coalesce("source_text", F.lit("")).alias("source_text"),
        ),
        {"ignoreNullFields": "false"},
    )
    doubtful = fields.where((F.col("confidence") < _dec(VERIFY_BELOW)) | F.col("needs_review"))
    order = Window.partitionBy("extraction_id").orderBy("confidence", "field_path")
    near = doubtful.withColumn("pick", F.row_number().over(order))
    # 11 blanks separate keys and values of one object, 2 characters separate objects, and
    # the wrapper takes 29.
    taken = F.sum(F.length("json") + 13).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 2 + 29
    sized = near.withColumn("json", body).withColumn("used", taken)
    return sized if max_chars is None else sized.where(F.col("used") <= max_chars)


def context_sections(documents: DataFrame, paths: DataFrame, reach: int = 500, head: int | None = None, max_chars: int | None = None) -> DataFrame:
    """The text plus the surroundings of keywords, overlaps merged.

    Keywords are the fixed words and the tokens of the doubtful field paths. All their hits
    count; `head` clips the text in front and `max_chars` the whole, where they are given. A
    document travels once, with its few words; hits are found inside its row.
    """
    tokens = paths.select("doc_id", F.explode(F.split(F.lower("field_path"), "[^a-z0-9_]+")).alias("word")).where("length(word) > 2")
    words = tokens.groupBy("doc_id").agg(F.collect_set("word").alias("own"))
    fixed = F.array(*[F.lit(w) for w in CONTEXT_WORDS])
    known = documents.select("doc_id", "text").join(words, "doc_id", "left").withColumn("words", F.array_union(fixed, F.coalesce("own", F.array().cast("array<string>"))))
    low, size = F.lower("text"), F.length("text")

    def spans_of(word: Column) -> Column:
        pieces = F.split(low, F.concat(F.lit("\\Q"), word, F.lit("\\E")), -1)
        lengths = F.transform(pieces, F.length)
        # Running length of the pieces before each hit, carried in one pass.
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, n: F.struct((acc["at"] + n + F.length(word)).alias("at"), F.array_append(acc["all"], acc["at"] + n).alias("all"))
        hits = F.slice(F.aggregate(lengths, start, step)["all"], F.lit(1), F.size(pieces) - 1)
        return F.transform(hits, lambda at: F.struct(F.greatest(F.lit(0), at - reach).alias("s"), F.least(size, at + F.length(word) + reach).alias("e")))

    spans = known.select("doc_id", F.explode(F.flatten(F.transform("words", spans_of))).alias("x")).select("doc_id", "x.s", "x.e")
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (F.col("s") > F.coalesce(reached, F.lit(-1))).cast("int"))
    islands = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    listed = merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    joined = documents.join(listed, "doc_id", "left")
    cuts = F.transform("spans", lambda x: F.substring(F.col("text"), x["s"] + 1, x["e"] - x["s"]))
    tail = F.when(
        F.size("spans") > 0,
        F.concat(F.lit("\n\n--- TARGETED KEYWORD SECTIONS ---\n\n"), F.array_join(cuts, "\n\n---\n\n")),
    ).otherwise("")
    front = F.col("text") if head is None else F.substring("text", 1, head)
    whole = F.concat(front, F.coalesce(tail, F.lit("")))
    return joined.select(
        "doc_id", F.coalesce(F.size("spans"), F.lit(0)).alias("sections"), (whole if max_chars is None else F.substring(whole, 1, max_chars)).alias("context"),
    )


def apply_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Fields with the last proposed correction of their path; unknown paths fall away and
    equal values change nothing."""
    last = corrections.groupBy("extraction_id", "field_path").agg(
        F.max_by(F.struct("corrected", "reason", "rationale", "confidence", "source_page", "source_text"), "ord").alias("c")
    )
    joined = fields.join(last, ["extraction_id", "field_path"], "left")
    changed = F.col("c").isNotNull() & ~F.col("value").eqNullSafe(F.col("c.corrected"))
    joined = joined.withColumn("was_llm_corrected", changed)
    when = lambda c, other: F.when(F.col("was_llm_corrected"), c).otherwise(other)
    given = F.col("c.confidence").cast(CONF)
    clamp = F.when(given.isNotNull(), F.greatest(F.lit(0).cast(CONF), F.least(F.lit(1).cast(CONF), given)))
    text = F.nullif(F.col("c.source_text"), F.lit(""))
    return (
        joined.withColumn("original_parser_value", when(F.col("value"), F.lit(None)))
        .withColumn("llm_corrected_value", when(F.col("c.corrected"), F.lit(None)))
        .withColumn("correction_reason", when(F.col("c.reason"), F.lit(None)))
        .withColumn("confidence_rationale", when(F.col("c.rationale"), F.lit(None)))
        .withColumn("confidence", when(F.coalesce(clamp, F.col("confidence")), F.col("confidence")))
        .withColumn("source_page", when(F.coalesce("c.source_page", "source_page"), F.col("source_page")))
        .withColumn("source_text", when(F.coalesce(text, F.col("source_text")), F.col("source_text")))
        .withColumn("value", when(F.col("c.corrected"), F.col("value")))
        .drop("c")
    )


def correction_diagnostics(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Proposed and accepted corrections per extraction."""
    corrected = apply_corrections(fields, corrections)
    accepted = corrected.groupBy("extraction_id").agg(F.count_if("was_llm_corrected").alias("corrections_accepted"))
    proposed = corrections.groupBy("extraction_id").agg(F.count(F.lit(1)).alias("corrections_proposed"))
    return accepted.join(proposed, "extraction_id", "left").select(
        "extraction_id", F.coalesce("corrections_proposed", F.lit(0)).alias("corrections_proposed"), "corrections_accepted"
    )


def skip_reason(has_service: Column, is_invoice: Column, non_contract: Column, candidates: Column) -> Column:
    """Why the verifier is not called; null when it is."""
    return (
        F.when(~has_service, "no LLM_API_KEY configured")
        .when(is_invoice, "invoice-classified document")
        .when(non_contract, "non-contract document detected")
        .when(candidates == 0, "all fields high confidence, verification not needed")
    )


def corrected_fields(fields: DataFrame) -> DataFrame:
    return fields.where("was_llm_corrected").select(
        "extraction_id", "field_path", "original_parser_value", "llm_corrected_value", "correction_reason", "confidence_rationale"
    )


def apply_review(fields: DataFrame, updates: DataFrame) -> DataFrame:
    """Reviewer overrides (the last update of a path wins) and rescored fields."""
    last = updates.groupBy("extraction_id", "field_path").agg(F.max_by(F.struct("corrected"), "ord").alias("u"))
    joined = fields.join(last, ["extraction_id", "field_path"], "left")
    return rescore(joined.withColumn("override", F.when(F.col("u").isNotNull(), F.col("u.corrected")).otherwise(F.col("override"))).drop("u"))


def review_status(approve: Column, reject: Column, current: Column) -> Column:
    """Approval beats rejection."""
    return F.when(approve, "approved").when(reject, "rejected").otherwise(current)
