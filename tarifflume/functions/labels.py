"""Column builders for contract wording: services, percents, weights, names, headers, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Contract service wording -> canonical name, tried in this order.
CANONICAL_SERVICES: list[tuple[str, str]] = [
    ("fedex ground", "fedex_ground"),
    ("fedex express", "fedex_express"),
    ("fedex home delivery", "fedex_home_delivery"),
    ("fedex freight", "fedex_freight"),
    ("ground", "ground"),
    ("ups ground", "ups_ground"),
    ("ups next day air", "ups_next_day_air"),
    ("ups 2nd day air", "ups_2nd_day_air"),
    ("ups 3 day select", "ups_3_day_select"),
    ("ups surepost", "ups_surepost"),
]

# Wording that is never a company name.
NOT_A_COMPANY = [
    "do not pay",
    "charges were submitted",
    "your charges have been submitted",
    "your bank account will be",
    "invoice summary",
    "delivery service invoice",
    "have you seen the new bill payment platform",
    "bill payment experience easier",
    "total amount outstanding",
    "invoice number",
]
# Words of company names.
COMPANY_MARKERS = ["llc", "inc", "corp", "ltd", "co", "company", "international", "holdings"]


def squeeze(c: Column) -> Column:
    """Trimmed text with inner white space as single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _slug(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def canonical_service(text: Column, vendor: Column) -> Column:
    """Struct (name, confidence) of a service label.

    A listed wording gives .95 (whole) or .88 (inside the label). Anything with "ground"
    in it is caught by the list, so what remains is a slug: .45 with a carrier prefix up
    to 64 characters, else .35.
    """
    key = F.lower(squeeze(text))
    pair = lambda name, conf: F.struct(name.alias("name"), F.lit(conf).alias("confidence"))
    chain = F.when(key == "", pair(F.lit(None).cast("string"), 0.0))
    for alias, canon in CANONICAL_SERVICES:
        chain = chain.when(key == alias, pair(F.lit(canon), 0.95)).when(F.contains(key, F.lit(alias)), pair(F.lit(canon), 0.88))
    slug = _slug(key)
    prefixed = F.when(F.startswith(slug, vendor), slug).otherwise(F.concat_ws("_", vendor, slug))
    known_vendor = vendor.isin("fedex", "ups") & (F.length(key) <= 64) & (slug != "")
    return chain.when(known_vendor, pair(prefixed, 0.45)).otherwise(pair(F.when(slug != "", slug), 0.35))


def percent_value(text: Column, strict: bool = True) -> Column:
    """Struct (unit, value, confidence) of a percent wording.

    With `strict` a percent sign only counts directly before a word character, as the
    source pattern demands; `strict=False` accepts any percent sign.
    """
    s = squeeze(text)
    tail = r"(?:%|percent|pct\.?)\b" if strict else r"(?:%|(?:percent|pct\.?)\b)"
    percent = r"(?i)(\d+(?:\.\d+)?)\s*" + tail
    plain, fraction = r"^\d+(?:\.\d+)?$", r"\b(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\b"
    out = lambda unit, value, conf: F.struct(F.lit(unit).alias("unit"), value.cast("double").alias("value"), F.lit(conf).alias("confidence"))
    number = s.try_cast("double")
    num, den = F.regexp_extract(s, fraction, 1).try_cast("double"), F.regexp_extract(s, fraction, 2).try_cast("double")
    unknown = F.lit(None)
    return (
        F.when(s == "", out("unknown", unknown, 0.0))
        .when(s.rlike(percent), out("percent", F.regexp_extract(s, percent, 1), 0.9))
        .when(s.rlike(plain) & (number <= 1), out("fraction", number * 100, 0.5))
        .when(s.rlike(plain) & (number <= 100), out("percent", number, 0.65))
        .when(s.rlike(fraction) & (den != 0), out("percent", F.round(F.try_divide(num * 100, den), 6), 0.55))
        .otherwise(out("unknown", unknown, 0.2))
    )


def _weight_unit(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("kg", "kgs", "kilogram", "kilograms"), "kg").when(u.isin("oz", "ounce", "ounces"), "oz").otherwise("lb")


def weight_range(text: Column) -> Column:
    """Struct (lo, hi, unit, confidence) of a weight wording."""
    s = squeeze(text)
    span = r"(?i)(\d+(?:\.\d+)?)\s*(?:-|–|—|to|through)\s*(\d+(?:\.\d+)?)\s*(lbs?|pounds?|kgs?|kilograms?|oz|ounces?)?"
    single = r"(?i)^(\d+(?:\.\d+)?)\s*(lbs?|pounds?|kgs?|kilograms?|oz)?$"
    out = lambda lo, hi, unit, conf: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), unit.alias("unit"), conf.alias("confidence"))
    grab = lambda p, g: F.regexp_extract(s, p, g)
    lo, hi, one = grab(span, 1).try_cast("double"), grab(span, 2).try_cast("double"), grab(single, 1).try_cast("double")
    none = F.lit(None)
    return (
        F.when(s == "", out(none, none, none.cast("string"), F.lit(0.0)))
        .when(s.rlike(span), out(lo, hi, _weight_unit(grab(span, 3)), F.when(lo <= hi, 0.85).otherwise(0.3)))
        .when(s.rlike(single), out(one, one, _weight_unit(grab(single, 2)), F.lit(0.6)))
        .otherwise(out(none, none, none.cast("string"), F.lit(0.25)))
    )


# Patterns of spoiled company names, in order, and what takes their place.
COMPANY_SPACING = [
    (r"(?i)^UPSHC[-_]", ""),
    (r"(?<=[a-z])(?=[A-Z])", " "),
    (r"(?<=[a-zA-Z])(LLC|INC|CORP|LTD|CO|LP)\b", " $1"),
    (r"(?<=[a-zA-Z])(Inc|Corp|Ltd)\.", " $1."),
    (r"\s{2,}", " "),
]


def clean_company(name: Column) -> Column:
    """Company name with the spaces that page text loses: camel case and glued suffixes."""
    return F.trim(reduce(lambda text, rule: F.regexp_replace(text, *rule), COMPANY_SPACING, name))


def valid_company(name: Column) -> Column:
    """False for boilerplate, sentences and long captures."""
    txt = squeeze(name)
    low, words = F.lower(txt), F.split(txt, " ")
    any_of = lambda items: _any_contains(low, items)
    sentence = F.endswith(low, F.lit(" to")) | F.startswith(low, F.lit("the ")) | F.startswith(low, F.lit("your "))
    proper = (F.size(words) <= 5) & F.forall(words, lambda w: w.rlike(r"^[A-Za-z0-9&.'-]+$"))
    return (F.length(txt) >= 3) & ~any_of(NOT_A_COMPANY) & ~sentence & (F.size(words) <= 8) & (any_of(COMPANY_MARKERS) | proper)


def _any_contains(text: Column, items: list[str]) -> Column:
    hit = F.lit(False)
    for item in items:
        hit = hit | F.contains(text, F.lit(item))
    return hit


def account_like(raw: Column) -> Column:
    """At least six characters with a digit among them."""
    txt = F.trim(F.coalesce(raw, F.lit("")))
    return (F.length(txt) >= 6) & txt.rlike(r"\d")


def section_header(text: Column) -> Column:
    """First line that looks like a section header."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.transform(F.split(trimmed, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    # Wording of headers.
    header = lambda x: (
        x.rlike(r"(?i)^(SECTION|ARTICLE|PART|SCHEDULE|EXHIBIT|APPENDIX|AMENDMENT)\s") | x.rlike(r"^\d+\.\s+[A-Z]") | x.rlike(r"^[A-Z][A-Z\s]{5,}$")
    )
    return F.get(F.filter(lines, header), 0)


def ocr_header(line: Column) -> Column:
    """Numbered heading, short capitals or a trailing colon."""
    s = F.trim(line)
    short = F.length(s) <= 80
    return (F.length(s) >= 3) & (
        s.rlike(r"^\d+(\.\d+)*\s+[A-Z]") | (s.rlike(r"^[A-Z][A-Z0-9\s\-&/,\.]{2,60}$") & short) | (s.rlike(r"^.{5,}:$") & short)
    )


def path_parts(path: Column) -> Column:
    """Struct (entity, ord, field) of `metadata.x` or `service_terms[0].x` or
    `amendments[1].modified_surcharges[2].x`."""
    field = F.regexp_extract(path, r"([^.\[\]]+)$", 1)
    entity = F.regexp_extract(path, r"^(.*?)(?:\[(\d+)\])?\.[^.\[\]]+$", 1)
    number = F.regexp_extract(path, r"\[(\d+)\]\.[^.\[\]]+$", 1)
    return F.struct(entity.alias("entity"), number.try_cast("int").alias("ord"), field.alias("field"))


def lenient_json(text: Column) -> Column:
    """Variant of a JSON text; else of its outermost braces; else an empty object."""
    inner = F.when(text.rlike(r"(?s)\{.*\}"), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    empty = F.try_parse_json(F.lit("{}"))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(inner), empty)


def dated(value: Column) -> Column:
    """True when a text holds a calendar date (month name, m/d/Y or ISO)."""
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    shape = rf"(?i){month}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}"
    token = F.regexp_extract(value, f"({shape})", 1)
    flat = F.initcap(F.regexp_replace(F.regexp_replace(token, ",", " "), r"\s+", " "))
    real = F.coalesce(F.try_to_date(token, "M/d/yyyy"), F.try_to_date(token, "d/M/yyyy"), F.try_to_date(token, "yyyy-MM-dd"), F.try_to_date(flat, "MMMM d yyyy"))
    return F.coalesce(value.rlike(shape) & real.isNotNull(), F.lit(False))
