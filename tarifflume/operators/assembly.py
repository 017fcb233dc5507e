"""From page rows to one extraction per document: precedence, merges, hits and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifflume.operators import agreement_tables as at, agreement_text as tx
from tarifflume.operators.quality import CORE_FIELDS

FIELD_STRUCT = "struct<value: string, confidence: double, source_page: int, source_text: string>"


def table_pricing(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pricing rows of both kinds of page tables."""
    return at.zone_pricing(tables, pages).unionByName(at.ups_weight_pricing(tables, pages))


def all_pricing(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pricing rows of page tables (`src_ord` 1) and of page text (2), tables before text on each page.

    Text pricing counts for services no table up to the page and no earlier page has supplied.
    That holds exactly for the first text page of a service when no table page comes before
    or with it, so two minima over the rows of a service replace the page-by-page walk, and
    every page is read once.
    """
    shared = ["doc_id", "page_number", "src_ord", "part_ord", "row_ord", "line_ord", "cell_ord", "service_name", "weight_range", "zone", "discount_pct", "is_all_zones"]
    left = table_pricing(pages, tables).withColumn("src_ord", F.lit(1)).withColumn("part_ord", F.col("table_ord").cast("bigint")).select(*shared)
    right = tx.text_pricing(pages).withColumn("src_ord", F.lit(2)).withColumn("part_ord", F.col("block").cast("bigint")).withColumn("line_ord", F.lit(0)).select(*shared)
    service = Window.partitionBy("doc_id", "service_name")
    first = lambda src: F.min(F.when(F.col("src_ord") == src, F.col("page_number"))).over(service)
    placed = left.unionByName(right).withColumn("_table", first(1)).withColumn("_text", first(2))
    supplied = F.col("_table").isNotNull() & (F.col("_table") <= F.col("_text"))
    return placed.where((F.col("src_ord") == 1) | ((F.col("page_number") == F.col("_text")) & ~supplied)).drop("_table", "_text")


def service_terms(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Service terms of documents, tables before text on each page."""
    return at.pricing_terms(all_pricing(pages, tables))


def surcharge_terms(pages: DataFrame, tables: DataFrame) -> DataFrame:
    cols = ["doc_id", "page_number", "src_ord", "row_ord", "name", "application", "applicable_zones", "modification"]
    left = at.surcharge_rows(tables).withColumn("src_ord", F.col("table_ord").cast("bigint")).select(*cols)
    right = tx.incentive_rows(pages).withColumn("src_ord", F.lit(1_000_000).cast("bigint")).select(*cols)
    return at.surcharge_terms(left.unionByName(right))


def dim_terms(pages: DataFrame, tables: DataFrame) -> DataFrame:
    cols = ["doc_id", "page_number", "src_ord", "row_ord", "name", "divisor", "application"]
    left = at.dim_rows(tables).withColumn("src_ord", F.col("table_ord").cast("bigint")).select(*cols)
    right = tx.dim_specs(pages).withColumn("src_ord", F.when(F.col("kind") == "DIM Divisor", 1_000_000).otherwise(1_000_001).cast("bigint")).select(*cols)
    return at.dim_terms(left.unionByName(right))


def special_terms(pages: DataFrame, tables: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Earned discounts, provisions and the offer deadline as special terms.

    Provisions count once for the page and once more where the page has tables, as in the
    page-by-page order they stand for.
    """
    none = F.lit(None).cast("string")
    found = tx.provisions(pages)
    again = found.join(tables.select("doc_id", "page_number").distinct().hint("merge"), ["doc_id", "page_number"], "left_semi")
    shape = lambda df, src: df.select("doc_id", "page_number", F.lit(src).alias("src_ord"), "row_ord", F.col("name").alias("term_name"), F.col("value").alias("term_value"), none.alias("conditions"))
    earned = at.earned_terms(at.earned_rows(tables)).select("doc_id", "page_number", F.lit(1).alias("src_ord"), "row_ord", "term_name", "term_value", "conditions")
    out = earned.unionByName(shape(again, 2)).unionByName(shape(found, 3))
    if meta is not None:
        offer = meta.where("offer_expiration is not null").select(
            "doc_id", F.lit(0).cast(pages.schema["page_number"].dataType).alias("page_number"), F.lit(0).alias("src_ord"), F.lit(0).alias("row_ord"),
            F.lit("Offer expiration / acceptance deadline").alias("term_name"), F.col("offer_expiration.value").alias("term_value"), none.alias("conditions"),
        )
        out = offer.unionByName(out)
    return out


def deterministic_hits(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Parsed objects per document: a priced table or block counts once, every other row once."""
    priced = all_pricing(pages, tables)
    blocks = priced.select("doc_id", "page_number", "src_ord", "part_ord")
    parts = [
        blocks.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
        *[df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")) for df in (surcharge_terms(pages, tables), dim_terms(pages, tables), special_terms(pages, tables))],
    ]
    # The documents of the pages, also those without objects, by one aggregate without a join.
    total = pages.select("doc_id", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("paged"))
    for p in parts:
        total = total.unionByName(p.withColumn("paged", F.lit(False)))
    return total.groupBy("doc_id").agg(F.sum("n").alias("hits"), F.bool_or("paged").alias("paged")).where("paged").drop("paged")


def merge_by_name(known: DataFrame, proposed: DataFrame, name: str, fold_case: bool = False) -> DataFrame:
    """Known rows plus the proposed ones whose name the document does not have yet."""
    key = F.lower(F.trim(F.col(name))) if fold_case else F.col(name)
    have = known.select("doc_id", key.alias("_key")).where("_key <> ''").distinct()
    fresh = proposed.withColumn("_key", key).where("_key <> ''").join(have, ["doc_id", "_key"], "left_anti").drop("_key")
    return known.unionByName(fresh, allowMissingColumns=True)


def gated_signals(documents: DataFrame, hits: DataFrame, least: int = 3) -> DataFrame:
    """Invoice signals of the documents with fewer than `least` parsed objects (see `deterministic_hits`)."""
    covered = hits.where(F.col("hits") >= least).select("doc_id")
    return tx.invoice_signals(documents.join(covered, "doc_id", "left_anti"))


def with_invoice_signals(services: DataFrame, surcharges: DataFrame, specials: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three term lists of documents with the signals whose names they don't have yet, whatever the case."""
    of = lambda kind, name, value: signals.where(F.col("kind") == kind).select("doc_id", F.col("name").alias(name), F.col("value").alias(value))
    return (
        merge_by_name(services, of("service", "service_name", "conditions"), "service_name", fold_case=True),
        merge_by_name(surcharges, of("surcharge", "name", "modification"), "name", fold_case=True),
        merge_by_name(specials, of("special", "term_name", "term_value"), "term_name", fold_case=True),
    )


def amendment_payload(found: DataFrame, services: DataFrame, surcharges: DataFrame, dims: DataFrame) -> DataFrame:
    """What each amendment changes: the service terms, surcharges and DIM rules of its own document."""
    body = lambda df, kind: df.select("doc_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "doc_id"])).alias("term"))
    terms = body(services, "service_terms").unionByName(body(surcharges, "surcharges")).unionByName(body(dims, "dim_rules"))
    return found.select("doc_id", "amendment_number").join(terms, "doc_id")


def raw_field(raw: Column) -> Column:
    """Value struct of a raw JSON field: objects carry their confidence, bare values get .5,
    null gives an empty value."""
    is_object = F.startswith(F.trim(raw), F.lit("{"))
    parsed = F.from_json(raw, "struct<value: string, confidence: double, source_page: int, source_text: string>")
    bare = F.regexp_replace(F.trim(raw), r'^"|"$', "")
    nothing = raw.isNull() | (F.trim(raw) == "null")
    return F.when(
        is_object, F.struct(parsed["value"], F.coalesce(parsed["confidence"], F.lit(0.0)), parsed["source_page"], parsed["source_text"]).cast(FIELD_STRUCT)
    ).otherwise(F.struct(F.when(~nothing, bare), F.when(nothing, 0.0).otherwise(0.5), F.lit(None).cast("int"), F.lit(None).cast("string")).cast(FIELD_STRUCT))


TERM_LISTS = {
    "service_terms": ["service_type", "applicable_zones", "discount_percentage", "base_rate_adjustment", "conditions", "effective_date"],
    "surcharges": ["surcharge_name", "application", "applicable_zones", "modification", "discount_percentage", "effective_date"],
    "dim_rules": ["dim_divisor", "applicable_services", "conditions"],
    "special_terms": ["term_name", "term_value", "conditions"],
}


def proposed_fields(bodies: DataFrame) -> DataFrame:
    """Long-form fields of externally proposed JSON (doc_id, body): metadata and term lists."""
    meta = bodies.select("doc_id", F.explode(F.from_json(F.get_json_object("body", "$.metadata"), "map<string, string>")).alias("field_name", "raw")).where(
        F.col("field_name").isin(tx.METADATA_FIELDS)
    )
    out = meta.select("doc_id", F.lit("metadata").alias("entity"), F.lit(None).cast("int").alias("ord"), "field_name", raw_field(F.col("raw")).alias("ev"))
    for entity, names in TERM_LISTS.items():
        listed = F.from_json(F.get_json_object("body", f"$.{entity}"), "array<map<string, string>>")
        rows = bodies.select("doc_id", F.posexplode(listed).alias("ord", "fields"))
        long = rows.select("doc_id", F.lit(entity).alias("entity"), "ord", F.inline(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col("fields")[n].alias("raw")) for n in names])))
        out = out.unionByName(long.select("doc_id", "entity", "ord", "field_name", raw_field(F.col("raw")).alias("ev")))
    return out.select("doc_id", "entity", "ord", "field_name", "ev.*")


def extraction_stats(meta_rows: DataFrame, services: DataFrame, surcharges: DataFrame, dims: DataFrame, specials: DataFrame) -> DataFrame:
    """Fields found, fields to review and mean confidence per document."""
    none, unscored = F.lit(0.0), F.lit(None).cast("decimal(8,4)")
    used = F.col("field_name").isin(CORE_FIELDS) & (F.col("confidence") > 0)
    row = lambda df, found, review, score, scored: df.select(
        "doc_id", found.cast("bigint").alias("found"), review.cast("bigint").alias("review"), score.cast("decimal(8,4)").alias("s"), scored.cast("bigint").alias("n")
    )
    one, no = F.lit(1), F.lit(0)
    flag = lambda c: F.when(c, 1).otherwise(0)
    # Rows of all lists meet in one aggregate, which sums them before they travel.
    rows = row(meta_rows, flag(F.col("value").isNotNull()), flag(F.col("needs_review")), F.when(used, F.col("confidence")), flag(used))
    rows = rows.unionByName(row(services, one, no, F.col("discount_confidence"), flag(F.col("discount_confidence") > 0)))
    rows = rows.unionByName(row(surcharges, one, no, F.lit(0.90), one))
    for df in (dims, specials):
        rows = rows.unionByName(row(df, one, no, unscored, no))
    total = rows.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("found", "review", "s", "n")])
    mean = F.coalesce(F.try_divide(F.col("s").cast("double"), F.col("n")), none)
    return total.select("doc_id", F.col("found").alias("fields_extracted"), F.col("review").alias("fields_needing_review"), F.round(mean, 6).alias("overall_confidence"))
