"""Invoice sources: CSV in three dialects, carrier JSON payloads, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tarifflume.functions import values as v
from tarifflume.functions.services import service_pair
from tarifflume.schemas import INVOICE_LINE, MONEY

# Header aliases of the two carrier dialects and their marker headers.
FEDEX_COLUMNS = {
    "tracking": ["tracking id", "tracking number"],
    "ship_date": ["ship date"],
    "delivery_date": ["delivery date"],
    "service": ["service type", "service"],
    "destination_zip": ["recipient zip", "ship to zip"],
    "zone": ["zone"],
    "rated_weight": ["billed weight", "rated weight"],
    "transport_charge": ["transportation charge"],
    "earned_discount": ["earned discount"],
    "net_charge": ["net charge", "billed charge", "total charge"],
    "fuel": ["fuel surcharge"],
    "residential": ["residential surcharge"],
}
UPS_COLUMNS = {
    "tracking": ["tracking number", "tracking id"],
    "ship_date": ["ship date"],
    "delivery_date": ["delivery date"],
    "service": ["service", "service type"],
    "destination_zip": ["ship to zip", "recipient zip"],
    "zone": ["zone"],
    "published_charge": ["published charge"],
    "incentive": ["incentive", "earned discount"],
    "billed_charge": ["billed charge", "net charge", "total charge"],
    "fuel": ["fuel surcharge"],
}
FEDEX_MARKERS = ["tracking id", "service type", "transportation charge", "earned discount"]
UPS_MARKERS = ["tracking number", "published charge", "incentive", "billed charge"]

# Canonical columns read only without `strict_reference`.
EXTRA_CANONICAL = [n for n, t in INVOICE_LINE if t == MONEY and n not in (
    "rated_weight_lbs", "actual_weight_lbs", "net_transport_charge", "transport_charge", "published_charge", "fuel_surcharge_billed", "billed_amount", "total_billed",
)]


def carrier_of_headers(headers: Column, hint: Column) -> Column:
    """Dialect of a header list: two or more markers of a carrier decide, else the hint."""
    hits = lambda markers: F.size(F.array_intersect(headers, F.array(*[F.lit(m) for m in markers])))
    return F.when(hits(FEDEX_MARKERS) >= 2, "fedex").when(hits(UPS_MARKERS) >= 2, "ups").otherwise(hint)


def dialect_of(columns: list[str], hint: str) -> str:
    """canonical, fedex or ups, from the handful of header names of one file set."""
    keys = {v.header_key_of(c) for c in columns}
    if {"service code", "ship date"} <= keys:
        return "canonical"
    if len(keys & set(FEDEX_MARKERS)) >= 2:
        return "fedex"
    if len(keys & set(UPS_MARKERS)) >= 2:
        return "ups"
    return hint


def header_groups(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of a path, grouped by their header line. A row for each file reaches the driver."""
    first = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        .where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    )
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        groups.setdefault(row["header"].strip("\ufeff\r"), []).append(row["file"])
    return list(groups.values())


def numbered_rows(raw: DataFrame) -> DataFrame:
    """Adds `_file` and `_row`, the 1-based row in the file, in file order however it was split.

    Rows are numbered inside their split, and splits by the rows of the file's earlier ones.
    """
    placed = raw.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    split = Window.partitionBy("_path", "_start")
    counts = placed.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_path", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.withColumn("_row", F.row_number().over(split.orderBy("_at"))).join(before, ["_path", "_start"]).withColumn("_row", F.col("_row") + F.col("_before")).drop("_path", "_start", "_at", "_before")


def read_csv_invoice(spark: SparkSession, path: str, carrier_hint: str, strict_reference: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV invoices as line items; each file is read in the dialect of its own header.

    `_row` is the row number in its file. `multi_line` allows line breaks inside quoted fields;
    a file is then one task.
    """
    out = None
    for files in header_groups(spark, path):
        raw = spark.read.csv(files, header=True, inferSchema=False, multiLine=multi_line)
        lines = csv_lines(numbered_rows(raw), carrier_hint, strict_reference)
        out = lines if out is None else out.unionByName(lines, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no invoice file with a header line in {path}")
    return out


def csv_lines(raw: DataFrame, carrier_hint: str, strict_reference: bool = False) -> DataFrame:
    """Line items of text columns plus `_file` and `_row` (1-based position)."""
    named = [c for c in raw.columns if not c.startswith("_")]
    dialect = dialect_of(named, carrier_hint)
    by_key = {v.header_key_of(c): F.col(f"`{c}`") for c in named}
    # Blank-free text of the row, for evidence.
    evidence = F.to_json(F.struct(*[F.col(f"`{c}`") for c in named]))
    base = raw.withColumn("raw_line_text", evidence)
    if dialect == "canonical":
        return _canonical(base, by_key, carrier_hint, strict_reference)
    return _carrier_dialect(base, by_key, dialect)


def _canonical(raw: DataFrame, by_key: dict[str, Column], hint: str, strict: bool) -> DataFrame:
    null = F.lit(None).cast("string")
    get = lambda name: by_key.get(name.replace("_", " "), null)
    filled = lambda name: F.nullif(get(name), F.lit(""))
    number = lambda name: v.to_number(get(name))
    service = filled("service_code")
    pair = service_pair(service, F.lit(hint))
    tracking = F.coalesce(filled("tracking_number"), filled("transaction_id"), F.lit(""))
    zero = F.lit(0).cast(MONEY)
    billed = F.coalesce(v.nonzero(number("billed_amount")), v.nonzero(number("total_billed")), zero)
    extra = [] if strict else [number(n).alias(n) for n in EXTRA_CANONICAL]
    extra += [] if strict else [
        F.substring(F.trim(get("destination_zip")), 1, 5).alias("destination_zip"),
        number("zone").cast("int").alias("zone"),
        F.when(v.blank_to_null(get("is_residential")).isNotNull(), v.truthy(get("is_residential"))).alias("is_residential"),
        filled("carrier_exception_code").alias("carrier_exception_code"),
        F.try_to_timestamp(get("actual_delivery_datetime")).cast("timestamp_ntz").alias("actual_delivery_datetime"),
    ]
    return raw.select(
        F.coalesce(filled("id"), F.concat_ws(":", "_file", "_row")).alias("line_id"),
        get("invoice_id").alias("invoice_id"),
        tracking.alias("tracking_number"),
        F.coalesce(filled("transaction_id"), F.nullif(tracking, F.lit(""))).alias("transaction_id"),
        v.parse_date(get("ship_date")).alias("ship_date"),
        F.coalesce(pair["code"], service).alias("service_code"),
        F.coalesce(filled("service_group"), pair["grp"]).alias("service_group"),
        F.coalesce(filled("service_or_charge_type"), F.lit("Unknown charge")).alias("service_or_charge_type"),
        *[number(n).alias(n) for n in ("rated_weight_lbs", "actual_weight_lbs", "net_transport_charge", "transport_charge", "published_charge", "fuel_surcharge_billed")],
        billed.alias("billed_amount"),
        F.coalesce(v.nonzero(number("total_billed")), billed).alias("total_billed"),
        *extra,
        "raw_line_text", "_file", "_row",
    )


def _carrier_dialect(raw: DataFrame, by_key: dict[str, Column], carrier: str) -> DataFrame:
    aliases = UPS_COLUMNS if carrier == "ups" else FEDEX_COLUMNS
    null = F.lit(None).cast("string")
    zero = F.lit(0).cast(MONEY)

    def first(name: str) -> Column:
        known = [by_key[a] for a in aliases.get(name, []) if a in by_key]
        return v.first_non_blank(*known) if known else null

    direct = lambda *names: v.first_non_blank(*[by_key[n] for n in names if n in by_key]) if any(n in by_key for n in names) else null
    number = lambda c: v.to_number(c)
    service = F.coalesce(first("service"), F.lit("Unknown charge"))
    pair = service_pair(service, F.lit(carrier))
    transport, published = number(first("transport_charge")), number(first("published_charge"))
    fuel, residential = number(first("fuel")), number(first("residential"))
    net = number(first("net_charge"))
    summed = F.coalesce(v.nonzero(transport), v.nonzero(published), zero) + F.coalesce(fuel, zero) + F.coalesce(residential, zero)
    total = F.coalesce(net, number(first("billed_charge")), summed, zero).cast(MONEY)
    tracking = F.coalesce(first("tracking"), F.lit(""))
    return raw.select(
        F.concat_ws(":", "_file", "_row").alias("line_id"),
        null.alias("invoice_id"),
        tracking.alias("tracking_number"),
        F.nullif(tracking, F.lit("")).alias("transaction_id"),
        v.parse_date(first("ship_date")).alias("ship_date"),
        # A delivery date carries no time of day: midnight.
        v.parse_date(first("delivery_date")).cast("timestamp_ntz").alias("actual_delivery_datetime"),
        pair["code"].alias("service_code"),
        pair["grp"].alias("service_group"),
        service.alias("service_or_charge_type"),
        F.substring(F.trim(first("destination_zip")), 1, 5).alias("destination_zip"),
        first("zone").try_cast("double").cast("int").alias("zone"),
        number(direct("actual weight lbs", "actual weight")).alias("actual_weight_lbs"),
        number(direct("length")).alias("length"),
        number(direct("width")).alias("width"),
        number(direct("height")).alias("height"),
        number(first("rated_weight")).alias("rated_weight_lbs"),
        number(direct("rate per lb")).alias("rate_per_lb"),
        transport.alias("transport_charge"),
        published.alias("published_charge"),
        number(first("earned_discount")).alias("earned_discount_applied"),
        number(first("incentive")).alias("incentive_credit"),
        net.alias("net_transport_charge"),
        fuel.alias("fuel_surcharge_billed"),
        residential.alias("residential_surcharge_billed"),
        total.alias("billed_amount"),
        total.alias("total_billed"),
        "raw_line_text", "_file", "_row",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Carrier payload files `{line_items: [...]}`; the invoice id is the file stem."""
    body = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("invoice"), F.col("value").alias("body")
    )
    return payload_lines(body)


def payload_lines(bodies: DataFrame) -> DataFrame:
    """Line items of payload texts (invoice, body); entries that are not objects are skipped."""
    fields = [(n, t) for n, t in INVOICE_LINE if n != "line_id"]
    item = ", ".join(["id: string"] + [f"{n}: {'timestamp_ntz' if t == 'timestamp_ntz' else t}" for n, t in fields])
    entries = F.from_json("body", "struct<line_items: array<string>>")["line_items"]
    rows = bodies.select("invoice", F.posexplode(entries).alias("pos", "entry")).where(F.startswith(F.trim("entry"), F.lit("{")))
    parsed = rows.withColumn("x", F.from_json("entry", f"struct<{item}>"))
    has = lambda key: F.get_json_object("entry", f"$.{key}").isNotNull()
    zero = F.lit(0).cast(MONEY)
    plain = [n for n, _ in fields if n not in ("tracking_number", "service_or_charge_type", "total_billed", "billed_amount")]
    return parsed.select(
        "invoice", "pos",
        F.coalesce("x.id", F.concat_ws(":", "invoice", F.col("pos") + 1)).alias("line_id"),
        F.when(has("tracking_number"), F.col("x.tracking_number")).otherwise(F.coalesce("x.transaction_id", F.lit(""))).alias("tracking_number"),
        F.coalesce("x.service_or_charge_type", F.lit("Unknown")).alias("service_or_charge_type"),
        F.coalesce("x.total_billed", zero).alias("total_billed"),
        F.coalesce("x.billed_amount", zero).alias("billed_amount"),
        *[F.col(f"x.{n}").alias(n) for n in plain],
    )


def union_sources(sources: list[tuple[int, DataFrame, list[str]]]) -> DataFrame:
    """Lines of all sources with one `line_seq`: payloads first, then files in order.

    Each source is (source order, lines, its own position columns).
    """
    out = None
    for ordinal, lines, position in sources:
        seq = F.struct(F.lit(ordinal).alias("source_ord"), (F.col(position[0]).cast("string") if len(position) > 1 else F.lit("")).alias("file"), F.col(position[-1]).cast("bigint").alias("row"))
        part = lines.withColumn("line_seq", seq).drop(*position)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def approved_only(agreements: DataFrame) -> DataFrame:
    """The approval gate: audits read approved agreements only."""
    return agreements.where(F.col("status") == "approved")


def require_approved(agreements: DataFrame) -> DataFrame:
    """Stop when an agreement that is not approved is offered for an audit."""
    if not agreements.where(~F.col("status").eqNullSafe(F.lit("approved"))).isEmpty():
        raise ValueError("Invoice audit requires an approved agreement.")
    return agreements
