"""Agreement page text and document text to pricing rows, provisions and metadata.

Page functions take `pages(doc_id, page_number, text)`; document functions take
`documents(doc_id, full_text)`, where all metadata fields come from one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifflume.functions import labels as lb
from tarifflume.operators.agreement_tables import PERCENT

# ---------------------------------------------------------------- page text


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _unmark(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[™®]", ""))


def _contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _bound(value: Column, use) -> Column:
    """`use` of a value that is evaluated once, however often `use` names it, also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, full, g1) of every match; start counts from 0.

    One pass carries the length of all pieces and matches so far.
    """
    pieces = F.split(text, pattern)
    full, g1 = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    rows = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), full.alias("full"), g1.alias("g1"))
    matches = F.slice(rows, F.lit(1), F.size(full))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, full: string, g1: string>>").alias("all"))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + m["gap"]
        return F.struct((at + F.length(m["full"])).alias("at"), F.array_append(acc["all"], F.struct(at.alias("start"), m["full"].alias("full"), m["g1"].alias("g1"))).alias("all"))

    return F.aggregate(matches, start, step)["all"]


# Wording of incentives and dimensional terms.
INCENTIVE = r"(?i)(UPS[^\n]*?)-\s*Incentives?\s*Off\s*Effective\s*Rates\s*-?\s*(\d+(?:\.\d+)?)\s*%"
DIM_DIVISOR = r"(?i)Custom\s*Dimensional\s*Weight\s*Divisor\s*[:\s]*(\d+)"
CUBIC_THRESHOLD = r"(?i)Custom\s*Cubic\s*Inch\s*Threshold\s*[:\s]*(\d+)"


def incentive_rows(pages: DataFrame) -> DataFrame:
    """Surcharge rows of incentive lines (service - kind - incentives off - percent)."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(INCENTIVE), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(INCENTIVE), F.lit(2)).alias("pct"))
    rows = pages.select("doc_id", "page_number", F.posexplode(pairs).alias("row_ord", "m"))
    parts = F.split(F.trim("m.name"), "-")
    service = _unmark(F.trim(F.get(parts, 0)))
    kind = F.when(F.size(parts) > 1, _unmark(F.trim(F.element_at(parts, -1)))).otherwise("General Incentive")
    return rows.select(
        "doc_id", "page_number", "row_ord", F.concat_ws(" - ", service, kind).alias("name"), service.alias("application"), F.lit("All Zones").alias("applicable_zones"),
        F.concat(F.lit("- "), F.col("m.pct").cast("double").cast("string"), F.lit("%")).alias("modification"),
    )


def dim_specs(pages: DataFrame) -> DataFrame:
    """Custom DIM divisors and cubic thresholds with the service named last before them."""
    named = r"(?i)(UPS[^\n]*?-\s*DimensionalWeight)"
    near = r"(UPS\s*[^\n]{3,40}?)(?:\n|$)"
    loose = r"(UPS[^\n]*?)(?:\n|$)"
    last = lambda ctx, p: F.try_element_at(F.regexp_extract_all(ctx, F.lit(p), F.lit(1)), F.lit(-1))
    before = _strip(F.substring(F.col("text"), F.lit(1), F.col("m.start")))
    own = lambda c: F.trim(F.regexp_replace(_unmark(c), r"(?i)\s*-?\s*DimensionalWeight\s*$", ""))
    blank = lambda c: F.when(c != "", c)
    divisors = pages.select("doc_id", "page_number", "text", F.posexplode(match_spans(F.col("text"), DIM_DIVISOR)).alias("row_ord", "m")).withColumn("ctx", before)
    service = F.when(last(F.col("ctx"), named).isNotNull(), blank(own(last(F.col("ctx"), named)))).otherwise(blank(_unmark(last(F.col("ctx"), near))))
    cubic = pages.select("doc_id", "page_number", "text", F.posexplode(match_spans(F.col("text"), CUBIC_THRESHOLD)).alias("row_ord", "m")).withColumn("ctx", before)
    fill = lambda df, svc, title: df.withColumn("application", F.coalesce(svc, F.lit("UPS Service"))).select(
        "doc_id", "page_number", F.lit(title).alias("kind"), "row_ord", F.concat(F.lit(title + " ("), "application", F.lit(")")).alias("name"), F.col("m.g1").cast("double").alias("divisor"), "application"
    )
    return fill(divisors, service, "DIM Divisor").unionByName(fill(cubic, _unmark(last(F.col("ctx"), loose)), "Cubic Inch Threshold"))


SERVICE_LINE = r"(?i)^(FedEx|Ground Domestic|Home Delivery|UPS)\s+"
ZONE_LINE = r"(?i)Zones?\s*=>\s*(.*)"
WEIGHT_LINE = r"(?i)^((?:[\d.]+\s*-\s*[\d.]+\s*(?:lb|oz)\(?s?\)?)|All\s+Applicable\s+Weights|Envelope|(?:[\d.]+\s*\+\s*(?:lb|oz)\(?s?\)?))"
# Wording that is no service heading, and wording that ends a pricing block.
NO_HEADING = [
    "the following", "pricing", "supersedes", "accounts", "discounts and", "for services", "shipments", "fedex and", "fedex freight", "fedex corporation",
    "fedex transportation", "fedex credit", "fedex money", "fedex service guide",
]
BLOCK_END = ["earned discount", "term ", "united states", "pricing provisions", "name of surcharge", "express returns", "proposal", "money back"]


def text_pricing(pages: DataFrame) -> DataFrame:
    """Percent per (service, weight, zone) of pricing blocks in page text.

    A block runs from a service line to the next service or stop line. Windows stay inside
    one page, which is one row of text.
    """
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", _strip(F.col("raw"))).where("line <> ''")
    line, low = F.col("line"), F.lower("line")
    heading, zone, weight = line.rlike(SERVICE_LINE), line.rlike(ZONE_LINE), line.rlike(WEIGHT_LINE)
    may_open = heading & ~_contains_any(low, NO_HEADING)
    plain = ~zone & ~weight
    # Events of a line: opens a block, or ends one; a heading that also names zones opens one
    # only outside a block and leaves it open either way.
    event = F.when(may_open, "open").when(plain & (heading | _contains_any(low, BLOCK_END)), "end")
    # Lines that neither open nor end a block nor name zones or weights say nothing: they don't travel.
    telling = lines.withColumns({"event": event, "names_zones": zone, "weighs": weight}).where("event is not null or names_zones or weighs")
    zone, weight = F.col("names_zones"), F.col("weighs")
    page = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    tagged = telling.drop("raw").withColumn("was_open", F.coalesce(F.last("event", ignorenulls=True).over(before) == "open", F.lit(False)))
    tagged = tagged.withColumn("opens", (F.col("event") == "open") & ~(zone & F.col("was_open")))
    placed = tagged.withColumn("block", F.sum(F.coalesce(F.col("opens"), F.lit(False)).cast("int")).over(upto)).withColumn(
        "inside", F.col("was_open") & (F.coalesce(F.col("event"), F.lit("")) != "end") & ~F.coalesce(F.col("opens"), F.lit(False))
    )
    block = Window.partitionBy("doc_id", "page_number", "block").orderBy("line_no")
    here = block.rowsBetween(Window.unboundedPreceding, 0)
    all_block = Window.partitionBy("doc_id", "page_number", "block")
    zone_text = F.trim(F.regexp_extract("line", ZONE_LINE, 1))
    is_zone = F.col("inside") & zone
    every = is_zone & zone_text.rlike(r"(?i)All\s+Zones")
    zones = F.when(every, F.array(F.lit("All Zones"))).when(is_zone, F.split(zone_text, r"\s+"))
    carried = (
        placed.withColumn("service_name", F.max(F.when(F.coalesce(F.col("opens"), F.lit(False)), line)).over(all_block))
        .withColumn("zones", F.last(zones, ignorenulls=True).over(here))
        .withColumn("seen_all", F.coalesce(F.max(F.when(every, True)).over(here), F.lit(False)))
        .withColumn("is_all_zones", F.coalesce(F.max(F.when(every, True)).over(all_block), F.lit(False)))
    )
    rows = carried.where(F.col("inside") & weight & ~zone)
    span = F.regexp_extract("line", WEIGHT_LINE, 1)
    tail = F.regexp_extract_all(F.substring("line", F.length(span) + 1, F.length("line")), F.lit(PERCENT), F.lit(1))
    pcts = F.when(F.size(tail) > 0, tail).otherwise(F.regexp_extract_all("line", F.lit(PERCENT), F.lit(1)))
    cells = rows.select("*", span.alias("weight_range"), F.posexplode(pcts).alias("cell_ord", "pct"))
    spare = F.when(F.col("seen_all"), "All Zones").otherwise(F.concat(F.lit("zone_"), F.col("cell_ord").cast("string")))
    return cells.select(
        "doc_id", "page_number", "block", "service_name", F.col("line_no").alias("row_ord"), "cell_ord", F.trim("weight_range").alias("weight_range"),
        F.coalesce(F.get(F.coalesce("zones", F.array().cast("array<string>")), F.col("cell_ord")), spare).alias("zone"), F.col("pct").cast("double").alias("discount_pct"), "is_all_zones",
    )


def provisions(pages: DataFrame) -> DataFrame:
    """Money-back waiver, unexpected volume and payment days of page text."""
    # Wording of provisions.
    money = r"(?is)Money\s*[-\s]?Back\s+Guarantee\.\s*(.+?)(?:\n[A-Z]|\n\n)"
    volume = r"(?is)Unexpected\s+International\s+Volume\.\s*(.+?)(?:\n[A-Z][a-z]|\n\n)"
    due = r"(?i)(Payment\s+Terms?\.\s*Payment\s+is\s+due\s+within\s+(?:the\s+following\s+number\s+of\s+days|\d+\s+days))"
    t = F.col("text")
    clause = lambda p: F.when(t.rlike(p), F.regexp_extract(t, p, 1))
    money_text = clause(money)
    money_value = F.when(F.contains(F.lower(money_text), F.lit("waive")), "Waived").when(money_text.isNotNull(), _strip(money_text))
    matched = F.when(t.rlike(due), F.regexp_extract(t, due, 1))
    reach = F.substring(t, F.instr(t, matched), F.length(matched) + 50)
    days = F.when(reach.rlike(r":\s*(\d+)"), F.concat(F.lit("Net "), F.regexp_extract(reach, r":\s*(\d+)", 1), F.lit(" days")))
    named = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))
    found = F.array_compact(
        F.array(
            named("Money-Back Guarantee", money_value),
            named("Unexpected International Volume", F.when(t.rlike(volume), _strip(clause(volume)))),
            named("Payment Terms", days),
        )
    )
    return pages.select("doc_id", "page_number", F.posexplode(found).alias("row_ord", "p")).select("doc_id", "page_number", "row_ord", "p.name", "p.value")


# ---------------------------------------------------------------- document tests and invoice signals


def likely_invoice(text: Column) -> Column:
    has = lambda w: F.contains(text, F.lit(w))
    return (has("Invoice Number") & has("Invoice Date")) | has("Delivery Service Invoice")


def likely_non_contract(text: Column) -> Column:
    head = F.lower(text)
    other = ["statement of work", "sow", "scope of work", "master services agreement", "proposal", "project plan"]
    return _contains_any(head, other) & ~_contains_any(head, ["pricing agreement", "carrier agreement", "service terms", "surcharge", "fedex", "ups"])


# A service total of an invoice.
SERVICE_TOTAL = r"(?i)([A-Za-z][A-Za-z &/\-]{3,80}?)\s+Total Charges\s+USD\s+\$?([\d,]+(?:\.\d{2})?)"


def invoice_signals(documents: DataFrame) -> DataFrame:
    """Rows (kind, name, value) an invoice shows: type, number, services, totals, fuel."""
    t = F.col("full_text")
    # Wording of invoices.
    number, total = r"(?i)Invoice Number\s+([A-Z0-9\-]+)", r"(?i)TOTAL\s+THIS\s+INVOICE\s+USD\s+\$?([\d,]+(?:\.\d{2})?)"
    fuel, transport = r"(?i)Fuel Surcharge\s+([\d,]+(?:\.\d{2})?)", r"(?i)Transportation Charges\s+([\d,]+(?:\.\d{2})?)"
    row = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))

    def grab(kind: str, name: str, p: str, prefix: str = "") -> Column:
        return _bound(F.regexp_extract(t, p, 1), lambda m: F.when(m != "", row(kind, F.lit(name), F.concat(F.lit(prefix), m))))

    def listed(totals: Column) -> Column:
        keys = F.transform(totals, lambda s: F.lower(s["name"]))
        first_seen = _bound(keys, lambda known: F.filter(totals, lambda s, i: F.array_position(known, F.lower(s["name"])) == i + 1))
        services = F.transform(first_seen, lambda s: row("service", s["name"], F.concat(F.lit("Total Charges USD "), s["amount"])))
        specials = F.array(
            row("special", F.lit("Document Type"), F.lit("Invoice")),
            grab("special", "Invoice Number", number),
            grab("special", "Invoice Total", total, "USD "),
            grab("surcharge", "Fuel Surcharge", fuel, "Observed amount "),
            F.when(F.size(totals) == 0, grab("service", "UPS Transportation Charges", transport, "Transportation Charges ")),
        )
        return F.concat(services, F.array_compact(specials))

    names = F.transform(F.regexp_extract_all(t, F.lit(SERVICE_TOTAL), F.lit(1)), lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")))
    totals = F.arrays_zip(names.alias("name"), F.regexp_extract_all(t, F.lit(SERVICE_TOTAL), F.lit(2)).alias("amount"))
    return documents.where(likely_invoice(t)).select("doc_id", F.inline(_bound(totals, listed)))


# ---------------------------------------------------------------- metadata

MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
LONG_DATE = MONTH + r"\s+\d{1,2},?\s+\d{4}"
ANY_DATE = rf"(?:{LONG_DATE}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})"
# Ordered patterns of each metadata field.
CUSTOMER = [
    r"(?i)Customer\s*(?:Name)?\s*[:\-]\s*(.+?)(?:\n|$)",
    r"(?i)(?:Prepared\s+for|Shipper)\s*[:\-]\s*(.+?)(?:\n|$)",
    r"(?i)This\s+FedEx.*?agreement.*?between.*?(?:FedEx.*?and|and)\s+(.+?)(?:\(|,|\n)",
    r'(?i)(?:between)\s*(.+?)\s*\(\s*"?\s*Customer\s*"?\s*\)',
    r'(?i)(?:made\s*and\s*entered\s*into\s*by\s*and\s*between)\s*(.+?)\s*(?:\(|")',
    r"(?i)This\s+UPS.*?agreement.*?between.*?(?:UPS.*?and|and)\s+(.+?)(?:\(|,|\n)",
    r"(?m)^([A-Z][A-Za-z\s&.,\-]+(?:Inc|LLC|Corp|Ltd|Co|LP)\.?)\s*$",
]
BILL_TO = [
    r"(?i)(?:Bill(?:ed)?\s+To|Submitted\s+to)\s*[:\-][ \t]*([A-Z][A-Z0-9&.,' \-]{2,120})",
    r"(?i)(?:Submitted\s+to)\s+([A-Z][A-Z0-9&.,' \-]{2,120}\b(?:LLC|Inc\.?|Corp\.?|Ltd\.?|Company))",
    r"(?i)(?:Customer\s+Name)\s*[:\-][ \t]*([A-Z][A-Z0-9&.,' \-]{2,120})",
]
ACCOUNT = [
    r"(?i)Account\s*(?:Number|#|No\.?)\s*[:\-]?\s*([A-Z0-9\-]{6,20})",
    r"(?i)Acct\s*(?:No\.?|#)\s*[:\-]?\s*([A-Z0-9\-]{6,20})",
    r"(?i)(?:^|\n)\s*([A-Z0-9]{6,12})\s+[A-Z0-9&.,'\- ]{3,}\n",
    r"(\d{9,12})\s*-\s*\d{2,3}",
]
ADDENDUM_ACCOUNT = r"(?im)List\s+of\s+Account\s+Numbers[\s\S]*?(?:^|\n)\s*([A-Z0-9]{6,12})\s+[A-Z0-9&.,'\- ]{3,}"
LOOSE_ACCOUNT = r"([\dA-Z]{10,11})\s+[A-Z\-]"
AGREEMENT = [
    r"(?i)Agreement\s*(?:Number|#|No\.?)\s*[:\-]?\s*([\w\-]+)",
    r"(?i)Contract\s*(?:Number|#|No\.?)\s*[:\-]?\s*([\w\-]+)",
    r"(\d{9,12}-\d{3}-\d{2}-\d{2})",
]
UPS_AGREEMENT = r"(P\d{9,12}-\d{2})"
VERSION = [r"(?i)Version\s*(?:Number|#|No\.?)?\s*[:\-]?\s*(\d+)", r"(?i)(?:Pricing\s+Proposal)\s+(\d+)"]
EFFECTIVE = [
    rf"(?i)Effective\s+(?:Date|from|as\s+of)\s*[:\-]?\s*({ANY_DATE})",
    r"(?i)effective\s+(?:on\s+)?(\d{1,2}/\d{1,2}/\d{4})",
    rf"(?i)Date\s*Signed\s*:\s*({ANY_DATE})",
    rf"(?i)Effective\s+Date\s*:\s*({ANY_DATE})",
]
PROCEDURAL = (
    r"(?i)(This\s+Agreement\s+shall\s+take\s+effect\s+on\s+the\s+Monday\s+following\s+the\s+signing"
    r"\s+of\s+this\s+Agreement\s+or\s+the\s+Effective\s+Date,\s+whichever\s+is\s+later)"
)
PROCEDURAL_TEXT = "Monday after signing or Effective Date on signature page, whichever is later"
OFFER = [rf"(?i)(?:offer\s+is\s+)?void\s*if\s*not\s*accepted\s*by\s*({LONG_DATE}|\d{{1,2}}/\d{{1,2}}/\d{{4}})"]
EXTERNAL_TERM = [
    r"(?i)(\b(?:Addendum|Exhibit|Schedule)\s+[A-Z]\b)",
    r"(?i)(\bMaster\s+Agreement\b)",
    r"(?i)(49\s*U\.?\s*S\.?\s*C\.?\s*§?\s*13102)",
    r"(?i)(\bas\s+the\s+term\s+is\s+defined\b)",
]
TERM_RANGE = [
    rf"(?i)Term\s*[:\-]?\s*({LONG_DATE})\s+through\s+({LONG_DATE})",
    r"(\d{1,2}/\d{1,2}/\d{4})\s*(?:(?i:through|to)|-)\s*(\d{1,2}/\d{1,2}/\d{4})",
    r"(?i)(?:^|\n)\s*1\s+(Effective\s+Date)\s+(Does\s+Not\s+Expire)",
    r"(?i)(?:^|\n)\s*1\s+(Effective\s+Date)\s+(\d+\s+Month\(?s?\)?)",
    rf"(?i)(?:^|\n)\s*1\s+({LONG_DATE})\s+(Does\s+Not\s+Expire)",
    rf"(?i)(?:^|\n)\s*1\s+({LONG_DATE})\s+({LONG_DATE})",
    r"(?i)(?:^|\n)\s*1\s+(\d{1,2}/\d{1,2}/\d{4})\s+(\d{1,2}/\d{1,2}/\d{4})",
    r"(?i)(?:^|\n)\s*1\s+(\d{1,2}/\d{1,2}/\d{4})\s+(Does\s+Not\s+Expire)",
    r"(?i)(?:^|\n)\s*1\s+(\d{1,2}/\d{1,2}/\d{4})\s+(\d+\s+Month\(?s?\)?)",
]
TERM_DURATION = r"(?i)remain\s*in\s*effect\s*for\s*(\d+)\s*(weeks?|months?|years?)"
PAYMENT_OPENING = r"(?i)(Customer agrees to pay the total invoice amount in full within the time period required by UPS\.)"
PAYMENT_DAYS = [
    r"(?i)Payment\s+is\s+due\s+within\s+the\s+following\s+number\s+of\s+days[\s\S]*?(?:Attachment|Credit\s+Term)\s*[:\s]\s*(\d+)",
    r"(?i)Payment\s+is\s+due\s+within[^\n]*?(\d+)\s*(?:days?|calendar)",
    r"(?im)Payment\s*Terms?\s*\(\s*Days\s*\)[^\n]*\n(?:[\s\S]*?\n)??[^\n]*[\dA-Z]{8,}\s+\S+[^\n]*\s(\d{1,3})\s*$",
    r"(?i)Payment\s+Terms?\s*[:\-]\s*(?:Net\s+)?(\d+)\s*(?:days?)?",
    r"(?i)Net\s+(\d+)\s+days?",
]
PAYMENT_LINE = [r"(?i)Payment\s+Terms?\s*[:\-]\s*(.+?)(?:\n|$)", r"(?i)(Net\s+\d+\s+(?:days?)?)"]
PAYMENT_BLOCK = (
    r"(?is)\bPayment\s+Terms\.?\s*(.*?)(?:(?:^|\n)[ \t]*(?:Applicable\s+Services|Special\s+Provisions|Effective\s+Date|Definitions|Waiver|Surcharges|Service\.|"
    r"Confidentiality\.|Offer\s+Expiration|Term\.|All\s+Services\s+provided)\b|\z)"
)
SERVICES_BLOCK = (
    r"(?is)\bApplicable\s+Services\s*[:\.]?\s*(.*?)(?:\n[ \t]*(?:Payment\s+Terms|Special\s+Provisions|Effective\s+Date|Surcharges|Definitions|Master\s+Agreement)\b|\z)"
)
SERVICES_CLAUSE = (
    r"(?is)\b(?:the\s+following\s+services?|services?\s+covered)\b[\s:,-]+(.{40,}?)(?:\n[ \t]*(?:Payment\s+Terms|Special\s+Provisions|Effective\s+Date)\b|\z)"
)

EV = "struct<value: string, confidence: double, source_text: string, needs_review: boolean>"


def _hit(text: Column, pattern: str, confidence: float, *, value=None, group: int = 1, before: int = 20, after: int = 20, review: bool = False) -> Column:
    """Extracted value of one pattern, or null: the matched text is bound once."""

    def build(m: Column) -> Column:
        at = F.instr(text, m)
        start = F.greatest(F.lit(1), at - before)
        snippet = _strip(F.substring(text, start, at - start + F.length(m) + after))
        found = F.trim(F.regexp_extract(text, pattern, group)) if value is None else value(text)
        return F.when(m != "", F.struct(_strip(found), F.lit(confidence), snippet, F.lit(review)).cast(EV))

    return F.get(F.transform(F.array(F.regexp_extract(text, pattern, 0)), build), 0)


def find_first(text: Column, patterns: list[str], confidence: float = 0.85, **kw) -> Column:
    """First pattern in order that matches, with a snippet around it."""
    return F.coalesce(*[_hit(text, p, confidence, **kw) for p in patterns])


def _block(text: Column, pattern: str, confidence: float, at_least: int) -> Column:
    """Collapsed narrative of a section."""

    def build(body: Column) -> Column:
        return F.when(F.length(body) >= at_least, F.struct(body, F.lit(confidence), body, F.lit(True)).cast(EV))

    return F.get(F.transform(F.array(lb.squeeze(F.regexp_extract(text, pattern, 1))), build), 0)


def _carrier(head: Column) -> Column:
    kinds = [("FedEx", r"(?i)(FedEx)"), ("FedEx", r"(?i)(Federal\s+Express)"), ("UPS", r"(\bUPS\b)"), ("UPS", r"(?i)(United\s+Parcel\s+Service)")]
    hits = [_hit(head, p, 0.95, value=lambda _, n=name: F.lit(n)) for name, p in kinds]
    unknown = F.struct(F.lit("Unknown"), F.lit(0.3), F.lit(None).cast("string"), F.lit(True)).cast(EV)
    return F.coalesce(*hits, unknown)


def _customer(head: Column) -> Column:
    def accept(found: Column) -> Column:
        cleaned = lb.clean_company(found["value"])
        return F.when(lb.valid_company(cleaned), F.struct(cleaned, found["confidence"], found["source_text"], found["needs_review"]).cast(EV))

    checked = F.get(F.transform(F.array(find_first(head, CUSTOMER)), lambda c: F.when(c.isNotNull(), accept(c))), 0)
    billed = [F.get(F.transform(F.array(_hit(head, p, 0.72, review=True)), lambda c: F.when(c.isNotNull(), accept(c))), 0) for p in BILL_TO]
    return F.coalesce(checked, *billed)


def _account(text: Column) -> Column:
    found = F.coalesce(
        find_first(text, ACCOUNT), _hit(text, ADDENDUM_ACCOUNT, 0.82), _hit(text, LOOSE_ACCOUNT, 0.70, before=10, review=True)
    )
    # The check runs last, so a first hit that fails it leaves the field empty.
    return F.get(F.transform(F.array(found), lambda c: F.when(lb.account_like(c["value"]), c)), 0)


def _payment(text: Column) -> Column:
    days = [
        _hit(text, p, 0.90, value=lambda t, p=p: F.concat(F.lit("Net "), F.trim(F.regexp_extract(t, p, 1)), F.lit(" days"))) for p in PAYMENT_DAYS
    ]
    return F.coalesce(
        _hit(text, PAYMENT_OPENING, 0.88, before=40, after=30), *days, find_first(text, PAYMENT_LINE), _block(text, PAYMENT_BLOCK, 0.78, 40)
    )


def metadata(documents: DataFrame) -> DataFrame:
    """The twelve metadata fields of each document, one struct column each."""
    text = F.col("full_text")
    base = documents.select(
        "doc_id",
        "full_text",
        _customer(text).alias("customer_name"),
        _account(text).alias("account_number"),
        F.coalesce(find_first(text, AGREEMENT), _hit(text, UPS_AGREEMENT, 0.80, before=10)).alias("agreement_number"),
        find_first(text, VERSION).alias("version_number"),
        find_first(text, EFFECTIVE).alias("effective_date"),
        find_first(text, OFFER).alias("offer_expiration"),
        find_first(text, EXTERNAL_TERM, 0.78, value=lambda _: F.lit("true"), before=60, after=80, review=True).alias("external_term_reference"),
        _carrier(text).alias("carrier"),
        _payment(text).alias("payment_terms"),
        F.coalesce(_block(text, SERVICES_BLOCK, 0.74, 25), F.when(~text.rlike(r"(?i)\bApplicable\s+Services"), _block(text, SERVICES_CLAUSE, 0.74, 25))).alias("applicable_services"),
        find_first(text, TERM_RANGE, group=1, before=10, after=10).alias("range_start"),
        find_first(text, TERM_RANGE, group=2, before=10, after=10).alias("range_end"),
        _hit(text, TERM_DURATION, 0.80, value=lambda t: F.concat_ws(" ", F.regexp_extract(t, TERM_DURATION, 1), F.regexp_extract(t, TERM_DURATION, 2))).alias("duration"),
        _hit(text, PROCEDURAL, 0.72, value=lambda _: F.lit(PROCEDURAL_TEXT), before=40, after=40, review=True).alias("procedural"),
    )
    dated = base.withColumn(
        "effective_date", F.coalesce("effective_date", F.when(F.col("carrier.value") == "UPS", F.col("procedural")))
    ).withColumn("parseable", F.coalesce(lb.dated(F.col("effective_date.value")), F.lit(False)))
    eff = F.col("effective_date.value")
    # The text of a provisional start.
    note = (
        "Provisional term_start: same as Effective Date because the text references an external document for the full term; "
        "term_end intentionally left unset. Review required."
    )
    given = F.col("range_start")
    own_start = F.when(
        given.isNotNull(),
        F.struct(F.when((F.lower(given["value"]) == "effective date") & eff.isNotNull(), eff).otherwise(given["value"]), given["confidence"], given["source_text"], given["needs_review"]).cast(EV),
    )
    derived = F.when(F.col("range_end").isNull() & F.col("duration").isNotNull() & F.col("parseable"), F.struct(eff, F.lit(0.80), F.lit("Derived from effective date"), F.lit(False)).cast(EV))
    provisional = F.when(F.col("external_term_reference").isNotNull() & F.col("parseable"), F.struct(eff, F.lit(0.62), F.lit(note), F.lit(True)).cast(EV))
    return dated.select(
        "doc_id", "customer_name", "account_number", "agreement_number", "version_number", "effective_date",
        F.coalesce(own_start, derived, provisional).alias("term_start"), F.coalesce("range_end", "duration").alias("term_end"),
        "payment_terms", "carrier", "offer_expiration", "external_term_reference", "applicable_services",
    )


METADATA_FIELDS = [
    "customer_name", "account_number", "agreement_number", "version_number", "effective_date", "term_start", "term_end", "payment_terms", "carrier",
    "offer_expiration", "external_term_reference", "applicable_services",
]
REVIEW_WHEN_EMPTY = ["customer_name", "account_number", "agreement_number", "effective_date"]


def metadata_rows(wide: DataFrame) -> DataFrame:
    """Long-form metadata: one row per document and field, empty ones included."""
    rows = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("ev")) for n in METADATA_FIELDS])
    long = wide.select("doc_id", F.inline(rows))
    return long.select(
        "doc_id", F.concat(F.lit("metadata."), "field_name").alias("field_path"), "field_name", F.col("ev.value").alias("value"),
        F.coalesce("ev.confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("ev.source_text").isNotNull(), 1).alias("source_page"), F.col("ev.source_text").alias("source_text"),
        F.coalesce(F.col("ev.needs_review"), F.col("field_name").isin(REVIEW_WHEN_EMPTY)).alias("needs_review"),
    )


# ---------------------------------------------------------------- amendments

# Wording of amendments.
AMENDMENT_TITLE = r"(?i)((?:FedEx|UPS)?\s*(?:Transportation\s+Services\s+)?Agreement\s+Amendment)"
AMENDMENT_NUMBER = r"(?i)Agreement\s*Number\(?s?\)?\s*[:\-]?\s*([\d\-]+)"
SUPERSEDES = [r"(?i)(?:supersedes|replaces)\s+(?:Pricing\s+Proposal\s+)?(?:Version\s+)?(\d+)", r"(?i)supersedes\s+all\s+prior\s+(.+?)\s+pricing"]
REPLACED = r"(?i)(?:replaces?|replaced)\s+(?:with\s+)?the\s+pricing\s+(?:contained|in)\s"


def amendments(documents: DataFrame) -> DataFrame:
    """Documents titled as amendments: number, superseded version and effective date."""
    text = F.col("full_text")
    number = F.when(text.rlike(AMENDMENT_NUMBER), F.regexp_extract(text, AMENDMENT_NUMBER, 1))
    stated = F.coalesce(
        *[F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in SUPERSEDES], F.when(text.rlike(REPLACED), F.lit("All prior pricing"))
    )
    ver, base = F.regexp_extract(number, r"-(\d+)$", 1).try_cast("int"), F.regexp_extract(number, r"^(.*)-\d+$", 1)
    derived = F.when(ver > 1, F.concat(base, F.lit("-"), F.when(ver <= 10, F.lpad((ver - 1).cast("string"), 2, "0")).otherwise((ver - 1).cast("string")))).when(
        ver.isNotNull(), F.concat(base, F.lit(" (original)"))
    )
    effective = F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in EFFECTIVE])
    return documents.where(text.rlike(AMENDMENT_TITLE)).select(
        "doc_id", F.coalesce(number, F.lit("Unknown")).alias("amendment_number"), F.coalesce(stated, derived).alias("supersedes_version"), effective.alias("effective_date"),
        F.when(F.coalesce(stated, derived).isNotNull(), 0.80).otherwise(0.0).alias("supersedes_confidence"), F.when(effective.isNotNull(), 0.80).otherwise(0.0).alias("date_confidence"),
    )
