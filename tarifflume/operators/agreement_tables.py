"""Page tables of agreements to pricing, surcharge, DIM and earned-discount rows.

Input `tables(doc_id, page_number, table_ord, headers, rows)`: one row per table of a
page, so every window below stays inside one table that is already one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifflume.session import dealt

# A percentage.
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
TABLE_KEY = ["doc_id", "page_number", "table_ord"]

# Service headings in page text (one alternation, so matches come in text order).
SERVICE_HEADINGS = [
    r"FedEx\s+(?:Priority|Standard|First)\s+Overnight(?:\s+(?:Envelope|Pak))?",
    r"FedEx\s+2Day(?:\s+A\.M\.)?(?:\s+(?:Envelope|Pak))?",
    r"FedEx\s+Express\s+Saver(?:\s+(?:Envelope|Pak))?",
    r"FedEx\s+\dDay\s+Freight",
    r"Ground\s+Domestic\s+(?:Single\s+Piece|MWT)\s*(?:\([^)]+\))?",
    r"Home\s+Delivery\s+Domestic\s+(?:Single\s+Piece|MWT)\s*(?:\([^)]+\))?",
    r"FedEx\s+Ground\s+Economy(?:\s+(?:by\s+(?:Ounce|Pound)|Bound\s+Printed\s+Matter))?\s*(?:\([^)]+\))?",
    r"UPS\s+(?:Ground|Next\s+Day\s+Air|2nd\s+Day\s+Air|3\s+Day\s+Select)(?:\s+(?:Saver|A\.M\.)?)?(?:\s+(?:Letter|Package))?",
]
SERVICE_HEADING = r"(?m)^(" + "|".join(SERVICE_HEADINGS) + r")\s*$"
# Words of lines that name no service.
NOT_A_SERVICE = ["term ", "agreement", "version", "proposal", "pricing", "supersedes", "discounts and"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _flat(c: Column) -> Column:
    return F.replace(_strip(c), F.lit("\n"), F.lit(" "))


def _percent(c: Column) -> Column:
    return F.when(c.rlike(PERCENT), F.regexp_extract(c, PERCENT, 1)).try_cast("double")


def _contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _rest(arr: Column) -> Column:
    """The array without its first element."""
    return F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 1, F.lit(0)))


def table_kind(headers: Column) -> Column:
    """surcharge, earned, zone, ups_weight or null, in dispatch order."""
    joined = F.lower(F.array_join(headers, " "))
    cell = lambda i: F.lower(_flat(F.get(headers, i)))
    has = lambda w: F.contains(joined, F.lit(w))
    two = F.size(headers) >= 2
    return (
        F.when(has("name of surcharge") | (has("surcharge") & has("modification")), "surcharge")
        .when(has("grace discount") | (has("annualized") & has("earned")), "earned")
        .when(two & F.startswith(F.lower(_strip(F.get(headers, 0))), F.lit("zones")), "zone")
        .when(two & F.contains(cell(0), F.lit("weight")) & (F.contains(cell(1), F.lit("zones")) | (cell(1) == "")), "ups_weight")
    )


def service_names(text: Column) -> Column:
    """Service headings of a page in text order."""
    return F.transform(F.regexp_extract_all(text, F.lit(SERVICE_HEADING), F.lit(1)), _strip)


def service_above(text: Column, headers: Column) -> Column:
    """Service a zone table belongs to: the nearest usable line among the ten above its header
    in the page text, else the last service heading of the page."""
    trimmed = F.transform(_rest(headers), _strip)
    typed = F.concat(F.lit("Zones =>"), F.array_join(F.transform(trimmed, lambda h: F.concat(F.lit(" "), h)), ""))
    direct = F.instr(text, F.array_join(headers, " "))
    at = F.when(direct > 0, direct).otherwise(F.instr(text, typed))
    above = F.split(F.rtrim(F.substring(text, F.lit(1), at - 1)), "\n")
    near = F.transform(F.slice(above, F.greatest(F.size(above) - 9, F.lit(1)), F.lit(10)), _strip)
    usable = F.filter(near, lambda x: (F.length(x) > 5) & ~_contains_any(F.lower(x), NOT_A_SERVICE) & ~x.rlike(r"^\d+$"))
    names = service_names(text)
    last = F.when(F.size(names) > 0, F.element_at(names, -1))
    return F.coalesce(F.when((at > 0) & (F.size(usable) > 0), F.element_at(usable, -1)), last, F.lit("Unknown Service"))


def ups_service(text: Column) -> Column:
    """Service of a UPS incentive table from the page wording."""
    package = r"(?i)(UPS[^\n]*?(?:Commercial|Residential)\s*Package[^\n]*?)(?:Incentives|Rates)"
    line = r"(?i)(UPS\s*(?:®|™)?\s*(?:Ground|SurePost)[^\n]*?)(?:-\s*(?:Commercial|Residential)|Incentives|Rates)"
    named = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, package, 1)), r"\s*-\s*Prepaid.*$", ""))
    return F.when(text.rlike(package), named).when(text.rlike(line), F.trim(F.regexp_extract(text, line, 1))).otherwise("UPS Service")


def _with_text(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables with the text of their page, by sort-merge: page texts are never broadcast, whatever Spark takes their size for."""
    texts = dealt(pages.select("doc_id", "page_number", "text"), "doc_id", "page_number")
    return tables.join(texts.hint("merge"), ["doc_id", "page_number"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def zone_pricing(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Percent per (service, weight, zone) of zone tables."""
    kept = _with_text(tables.where(table_kind(F.col("headers")) == "zone"), pages)
    zones = F.filter(F.transform(_rest(F.col("headers")), _strip), lambda h: h != "")
    base = kept.select(
        *TABLE_KEY, service_above(F.col("text"), F.col("headers")).alias("service_name"), zones.alias("zones"), F.posexplode("rows").alias("row_ord", "row")
    ).where((F.size("row") >= 2) & (_strip(F.get("row", 0)) != ""))
    cells = base.select("*", F.posexplode(_rest(F.col("row"))).alias("cell_ord", "cell"))
    single = (F.size("zones") == 1) & F.contains(F.lower(F.get("zones", 0)), F.lit("all"))
    return cells.select(
        *TABLE_KEY, "service_name", "row_ord", F.lit(0).alias("line_ord"), "cell_ord", _strip(F.get("row", 0)).alias("weight_range"),
        F.coalesce(F.get("zones", F.col("cell_ord")), F.concat(F.lit("zone_"), F.col("cell_ord").cast("string"))).alias("zone"),
        _percent(_strip(F.col("cell"))).alias("discount_pct"), single.alias("is_all_zones"),
    ).where("discount_pct is not null")


def ups_weight_pricing(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Percent per (service, weight, zone) of weight tables whose cells hold several lines."""
    # The service is in the page's wording alone, so the page sends its name and not its text.
    named = pages.select("doc_id", "page_number", ups_service(F.coalesce("text", F.lit(""))).alias("service_name")).hint("merge")
    kept = dealt(tables.where(table_kind(F.col("headers")) == "ups_weight"), "doc_id", "page_number").join(named, ["doc_id", "page_number"], "left")
    blank_first = lambda r: (_strip(F.get(r, 0)) == "") & (F.size(r) > 1)
    zone_row = lambda r: blank_first(r) & F.forall(_rest(r), lambda z: (_strip(z) == "") | _strip(z).rlike(r"^\d+$"))
    zone_rows = F.filter("rows", zone_row)
    listed = F.when(F.size(zone_rows) > 0, _rest(F.element_at(zone_rows, -1))).otherwise(_rest(F.col("headers")))
    zones = F.filter(F.transform(listed, _strip), lambda z: z != "")
    base = kept.select(*TABLE_KEY, F.coalesce("service_name", F.lit("UPS Service")).alias("service_name"), zones.alias("zones"), F.posexplode("rows").alias("row_ord", "row")).where(
        _strip(F.get("row", 0)) != ""
    )
    lines = base.select("*", F.posexplode(F.split(_strip(F.get("row", 0)), "\n")).alias("line_ord", "weight")).withColumn("weight_range", _strip(F.col("weight"))).where("weight_range <> ''")
    cells = lines.select("*", F.posexplode("zones").alias("cell_ord", "zone"))
    cell = F.split(_strip(F.get(F.col("row"), F.col("cell_ord") + 1)), "\n")
    return cells.select(
        *TABLE_KEY, "service_name", "row_ord", "line_ord", "cell_ord", "weight_range", "zone",
        _percent(_strip(F.get(cell, F.col("line_ord")))).alias("discount_pct"), F.lit(False).alias("is_all_zones"),
    ).where("discount_pct is not null")


def _surcharge_rows(tables: DataFrame) -> DataFrame:
    rows = tables.where(table_kind(F.col("headers")) == "surcharge").select(*TABLE_KEY, F.posexplode("rows").alias("row_ord", "row"))
    return rows.where(F.size("row") >= 4).withColumn("name", _flat(F.get("row", 0)))


def surcharge_rows(tables: DataFrame) -> DataFrame:
    """Surcharge modifications; heading and DIM rows are left out."""
    low = F.lower("name")
    zones = _flat(F.get("row", 2))
    return _surcharge_rows(tables).where((F.col("name") != "") & ~F.startswith(low, F.lit("name of")) & ~F.startswith(low, F.lit("dim"))).select(
        *TABLE_KEY, "row_ord", "name", _flat(F.get("row", 1)).alias("application"), F.when(zones != "", zones).otherwise("All Zones").alias("applicable_zones"),
        _flat(F.get("row", 3)).alias("modification"),
    )


def dim_rows(tables: DataFrame) -> DataFrame:
    """DIM divisors of surcharge tables; rows without a number are left out."""
    digits = F.regexp_replace(_strip(F.get("row", 3)), r"[^\d.]", "")
    return _surcharge_rows(tables).where(F.startswith(F.lower("name"), F.lit("dim"))).select(
        *TABLE_KEY, "row_ord", "name", digits.try_cast("double").alias("divisor"), _strip(F.get("row", 1)).alias("application")
    ).where("divisor is not null")


def earned_rows(tables: DataFrame) -> DataFrame:
    """Earned-discount rows: services, tiers, and the grace percent carried down the table."""
    rows = tables.where(table_kind(F.col("headers")) == "earned").select(
        *TABLE_KEY, _percent(F.get("headers", 0)).alias("seed"), F.posexplode("rows").alias("row_ord", "row")
    ).where(F.size("row") >= 3)
    first = F.lower(_strip(F.get("row", 0)))
    is_grace = F.startswith(first, F.lit("grace discount"))
    down = Window.partitionBy(*TABLE_KEY).orderBy("row_ord").rowsBetween(Window.unboundedPreceding, 0)
    grace = F.last(F.when(is_grace, _percent(F.get("row", 0))), ignorenulls=True).over(down)
    cell_lines = lambda i: F.filter(F.transform(F.split(_strip(F.get("row", i)), "\n"), _strip), lambda x: x != "")
    tiers = F.transform(
        cell_lines(1), lambda t, i: F.struct(t.alias("threshold"), _percent(F.get(cell_lines(2), i)).alias("discount_pct"))
    )
    return (
        rows.withColumn("grace_pct", F.coalesce(grace, "seed")).where(~is_grace & ~F.startswith(first, F.lit("service")))
        .select(*TABLE_KEY, "row_ord", cell_lines(0).alias("services"), "grace_pct", tiers.alias("tiers"))
        .where((F.size("services") > 0) | (F.size("tiers") > 0))
    )


def pricing_terms(pricing: DataFrame) -> DataFrame:
    """Service terms of pricing rows with their fixed confidences."""
    return pricing.select(
        *[c for c in pricing.columns if c not in ("weight_range", "zone", "is_all_zones")],
        F.when(F.col("is_all_zones"), F.array(F.lit("All Zones"))).otherwise(F.array("zone")).alias("applicable_zones"),
        F.concat(F.lit("Weight: "), "weight_range").alias("conditions"),
        F.lit(0.90).alias("service_confidence"), F.lit(0.92).alias("discount_confidence"), F.lit(0.85).alias("conditions_confidence"),
    )


def surcharge_terms(rows: DataFrame) -> DataFrame:
    pct = _percent(F.col("modification"))
    # A percent of zero counts as none for the confidence.
    return rows.withColumn("discount_percentage", pct).withColumn("discount_confidence", F.when(F.coalesce(pct, F.lit(0.0)) != 0, 0.85).otherwise(0.0))


def dim_terms(rows: DataFrame) -> DataFrame:
    plain = F.lower("name").isin("dim", "")
    return rows.withColumn("conditions", F.when(plain, "Standard").otherwise(F.col("name")))


def earned_terms(rows: DataFrame) -> DataFrame:
    """Earned-discount rows as special terms with one descriptive text."""
    grace = F.when(F.col("grace_pct").isNotNull(), F.array(F.concat(F.lit("Grace Discount: "), F.col("grace_pct").cast("string"), F.lit("%")))).otherwise(F.array().cast("array<string>"))
    each = F.transform(
        "tiers", lambda t: F.concat(t["threshold"], F.when(t["discount_pct"].isNotNull(), F.concat(F.lit(" → "), t["discount_pct"].cast("string"), F.lit("%"))).otherwise(""))
    )
    parts = F.concat(grace, each)
    return rows.select(
        *TABLE_KEY, "row_ord", F.lit("Earned Discount Program").alias("term_name"),
        F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("See contract").alias("term_value"),
        F.when(F.size("services") > 0, F.concat(F.lit("Applicable to: "), F.array_join("services", ", "))).alias("conditions"),
    )


def row_maps(tables: DataFrame) -> DataFrame:
    """Table rows as maps by header; nameless columns are col_i and the last of equal headers wins."""
    named = F.transform("headers", lambda h, i: F.coalesce(h, F.concat(F.lit("col_"), i.cast("string"))))
    rows = tables.select(*TABLE_KEY, named.alias("h"), F.posexplode("rows").alias("row_ord", "row"))
    n = F.least(F.size("h"), F.size("row"))
    pairs = F.arrays_zip(F.slice("h", F.lit(1), n).alias("k"), F.slice("row", F.lit(1), n).alias("v"))
    from_end = F.reverse(F.slice("h", F.lit(1), n))
    last = F.filter(pairs, lambda p, i: F.array_position(from_end, p["k"]) == (n - i))
    return rows.select(*TABLE_KEY, "row_ord", F.map_from_entries(last).alias("cells"))


def table_text(table: DataFrame) -> DataFrame:
    """Each table as bar-joined lines under a rule of the header's length."""
    head = F.array_join("headers", " | ")
    body = F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit("None"))), " | "))
    return table.select(*TABLE_KEY, F.array_join(F.concat(F.array(head, F.repeat(F.lit("-"), F.length(head))), body), "\n").alias("table_text"))


def pages_with_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Page text followed by its tables, each behind a marker."""
    marked = F.concat(F.lit("\n[TABLE on page "), F.col("page_number").cast("string"), F.lit("]\n"), F.col("table_text"))
    per_page = table_text(tables).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("table_ord", marked.alias("t")))).alias("ts"))
    joined = pages.join(per_page, ["doc_id", "page_number"], "left")
    extra = F.transform(F.coalesce(F.col("ts.t"), F.array().cast("array<string>")), lambda x: x)
    return joined.select(
        "doc_id", "page_number", F.array_join(F.concat(F.array(F.coalesce("text", F.lit(""))), extra), "\n").alias("text"), F.col("ts").isNotNull().alias("has_tables")
    )
