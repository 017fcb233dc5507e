"""Active terms of agreements: dedupe, amendments, multi-document overlay, company merge.

Everything is "last write wins" per key, so it is a map-side aggregate over an order
column instead of a walk over documents; no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifflume.functions import values as v
from tarifflume.schemas import PCT

# Later document types win on the same date.
DOCUMENT_PRIORITY = {"amendment": 3, "addendum": 2, "pricing_addendum": 2, "accessorial_addendum": 2, "base_agreement": 1}

CONF = "decimal(6,4)"


def dedupe_terms(terms: DataFrame) -> DataFrame:
    """First of the terms that agree in service, zones, discount, conditions and date."""
    key = [
        "extraction_id",
        v.text_key(F.col("service_type")),
        F.coalesce(v.list_key(F.col("zones")), F.lit("")),
        v.text_key(F.col("discount_pct").cast("string")),
        v.text_key(F.col("conditions")),
        v.text_key(F.col("effective_date")),
    ]
    first = Window.partitionBy(*key).orderBy("ord")
    return terms.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def active_key(kind: Column, name: Column, services: Column) -> Column:
    """Key under which a term replaces an earlier one: DIM rules by their sorted services,
    everything else by its name."""
    named = F.lower(F.trim(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))))
    return F.when(kind == "dim", F.coalesce(v.list_key(services, ordered=True), F.lit(""))).otherwise(named)


def active_terms(terms: DataFrame, extra_keys: list[Column] | None = None) -> DataFrame:
    """One row per active term: the last writer's values in first-seen order.

    Base rows have a null `amendment_ord`; amendments apply by effective date text, those
    without a date first. `extra_keys` keeps terms apart that share a name.
    """
    place = F.struct(
        F.col("amendment_ord").isNotNull().alias("amended"),
        F.when(F.col("amendment_ord").isNotNull(), F.coalesce(v.blank_to_null(F.col("amendment_date")), F.lit("0000-00-00"))).alias("day"),
        F.coalesce("amendment_ord", F.lit(-1)).alias("amendment_ord"),
        F.col("ord").alias("ord"),
    )
    keyed = terms.withColumn("active_key", active_key(F.col("kind"), F.col("name"), F.col("services"))).withColumn("place", place)
    more = {f"_k{i}": c for i, c in enumerate(extra_keys or [])}
    for name, c in more.items():
        keyed = keyed.withColumn(name, c)
    payload = [c for c in terms.columns if c not in ("extraction_id", "kind")]
    merged = keyed.groupBy("extraction_id", "kind", "active_key", *more).agg(
        F.max_by(F.struct(*payload), "place").alias("t"), F.min("place").alias("first_seen")
    )
    return merged.select("extraction_id", "kind", "active_key", "t.*", "first_seen")


def document_place(effective: Column, doc_type: Column, ordinal: Column) -> Column:
    """Order of the documents of a company: date text, then type priority, then upload order."""
    rank = F.create_map(*[F.lit(x) for pair in DOCUMENT_PRIORITY.items() for x in pair])[F.lower(F.coalesce(doc_type, F.lit("base_agreement")))]
    return F.struct(
        F.coalesce(v.blank_to_null(effective), F.lit("1900-01-01")).alias("day"),
        F.coalesce(rank, F.lit(1)).alias("priority"),
        ordinal.alias("ordinal"),
    )


def overlay_fields(fields: DataFrame, carried: list[str] | None = None, kept: list[str] | None = None, notes: bool = True) -> DataFrame:
    """Per (company, field): the value of the last document whose effective value is filled.

    The first document supplies the row, and its reviewer override stays in force. The
    rationale names every amendment that set the field, in document order, also where a later
    document of another type overwrote the value; without `notes` it is left out, and
    `overlay_notes` has the trail as rows. `carried` columns come with the value, `kept` ones
    with the first document.
    Input has `place` (see `document_place`), `doc_type` and `file_name`.
    """
    carried, kept = carried or [], kept or []
    effective = F.coalesce("override", "value")
    filled = effective.isNotNull() & (effective != "")
    content = F.struct("value", "confidence", "source_page", "source_text", "doc_type", "file_name", *carried)
    trail = F.array_sort(F.collect_list(F.when(filled & (F.lower("doc_type") == "amendment"), F.struct("place", F.concat(F.lit("Controlled by amendment "), "file_name").alias("note")))))
    merged = fields.groupBy("company_key", "field_path").agg(
        F.min_by(F.struct("override", *kept, F.struct(content.alias("c")).alias("own")), "place").alias("base"),
        F.max_by(F.struct("place", content.alias("c")), F.when(filled, F.col("place"))).alias("last"),
        F.min("place").alias("base_place"),
        *([trail.alias("notes")] if notes else []),
    )
    use_last = F.col("last").isNotNull() & (F.col("last.place") > F.col("base_place"))
    chosen = F.when(use_last, F.col("last.c")).otherwise(F.col("base.own.c"))
    joined = lambda acc, n: F.when(acc.isNull(), n).when(F.contains(acc, n), acc).otherwise(F.concat(acc, F.lit("; "), n))
    rationale = []
    if notes:
        later = F.transform(F.filter("notes", lambda n: n["place"] > F.col("base_place")), lambda n: n["note"])
        rationale = [F.aggregate(later, F.lit(None).cast("string"), joined).alias("rationale")]
    return merged.withColumn("chosen", chosen).select(
        "company_key", "field_path", "chosen.value", F.col("base.override").alias("override"), "chosen.confidence", "chosen.source_page",
        "chosen.source_text", *[f"chosen.{c}" for c in carried], *[f"base.{c}" for c in kept], *rationale,
    )


def overlay_notes(fields: DataFrame) -> DataFrame:
    """Every amendment that set a field, as rows in document order (the full trail of notes)."""
    effective = F.coalesce("override", "value")
    firsts = fields.groupBy("company_key").agg(F.min("place").alias("base_place"))
    return (
        fields.where(effective.isNotNull() & (effective != "") & (F.lower("doc_type") == "amendment"))
        .join(firsts, "company_key").where("place > base_place")
        .select("company_key", "field_path", "place", F.concat(F.lit("Controlled by amendment "), "file_name").alias("note"))
    )


def overlay_lists(rows: DataFrame) -> DataFrame:
    """Per (company, kind): the list rows of the last document that has any."""
    last = rows.groupBy("company_key", "kind").agg(F.max("place").alias("place"))
    r, l = rows.alias("r"), last.alias("l")
    same = (F.col("r.company_key") == F.col("l.company_key")) & (F.col("r.kind") == F.col("l.kind")) & (F.col("r.place") == F.col("l.place"))
    return r.join(l, same, "left_semi")


def merge_leaves(leaves: DataFrame) -> DataFrame:
    """Free-form terms by leaf path: the last filled value, else the first one seen."""
    filled = F.col("value").isNotNull() & (F.col("value") != "")
    return leaves.groupBy("company_key", "path").agg(
        F.coalesce(F.max_by("value", F.when(filled, F.col("place"))), F.min_by("value", "place")).alias("value"),
        F.min("place").alias("first_seen"),
    )


def expire_fuel(rows: DataFrame, as_of: str) -> DataFrame:
    """Fuel discount of 0 after its expiration date."""
    expired = F.coalesce(F.to_date(F.lit(as_of)) > v.iso_date(F.col("expiration_date")), F.lit(False))
    return rows.withColumn("discount_pct", F.when(expired, F.lit(0).cast(PCT)).otherwise(F.col("discount_pct"))).withColumn(
        "note", F.when(expired, "Fuel surcharge discount expired; defaulted to 0%.")
    )


def company_groups(documents: DataFrame) -> DataFrame:
    """Companies with more than one document: size, shown name and the id of the merged one."""
    keyed = documents.withColumn("company_key", v.company_key(F.col("customer_name")))
    shown = F.coalesce(v.blank_to_null(F.trim("customer_name")), F.lit("Unknown Company"))
    return (
        keyed.groupBy("company_key")
        .agg(F.count(F.lit(1)).alias("files"), F.min_by(shown, "ordinal").alias("company"))
        .where("files > 1")
        .select(
            "company_key", "company", "files",
            F.concat(F.lit("merged-"), F.md5(F.col("company_key").cast("binary"))).alias("merged_id"),
            F.concat("company", F.lit(" ("), F.col("files").cast("string"), F.lit(" files).pdf")).alias("file_name"),
            F.lit("pending_review").alias("status"),
        )
    )


def best_value(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Most confident filled value per key; the earliest of equals."""
    filled = v.filled(F.col("value"))
    rank = F.struct(filled.alias("filled"), F.col("confidence"), (-F.col("ord")).alias("earlier"))
    return fields.groupBy(*keys).agg(F.max_by(F.struct("value", "confidence"), rank).alias("b")).select(*keys, "b.*")


def first_of_equal_rows(rows: DataFrame, content: list[str], order: str) -> DataFrame:
    """Rows that repeat an earlier row in all `content` columns are dropped."""
    first = Window.partitionBy(F.to_json(F.struct(*content))).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
