"""Column builders for scalar clean-up: numbers, dates, text keys, names, percents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tarifflume.schemas import MONEY


def blank_to_null(c: Column) -> Column:
    """Null for blank text; the surviving value keeps its own spaces."""
    return F.when(F.trim(c) != "", c)


def to_number(c: Column, sql_type: str = MONEY) -> Column:
    """Text amount to number: drops `,` and `$`; blank or malformed gives null."""
    cleaned = F.trim(F.regexp_replace(c, "[,$]", ""))
    return F.when(cleaned != "", cleaned).try_cast(sql_type)


def parse_date(c: Column) -> Column:
    """First of five formats that fits: ISO, m/d/Y, m/d/y, `Mon d, Y`, `Month d, Y`.

    Two-digit years pivot at 69: Spark reads 69..99 as 2069..2099, so those move
    back a century.
    """
    text = F.trim(c)
    named = F.initcap(F.regexp_replace(text, "\\s+", " "))
    short = F.try_to_date(text, "M/d/yy")
    short = F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(
        F.try_to_date(text, "yyyy-M-d"),
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")),
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), short),
        F.when(named.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), F.try_to_date(named, "MMM d, yyyy")),
        F.when(named.rlike(r"^[A-Z][a-z]{2,8} \d{1,2}, \d{4}$"), F.try_to_date(named, "MMMM d, yyyy")),
    )


def iso_date(c: Column) -> Column:
    """Strict ISO date or null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def header_key(c: Column) -> Column:
    """Column header in lower case with every other character run as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def header_key_of(text: str) -> str:
    """Driver-side twin of `header_key` for the handful of names in `df.columns`."""
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in text.lower()).split())


def first_non_blank(*cols: Column) -> Column:
    """First column that is not blank, untrimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def truthy(c: Column, accept_t: bool = True) -> Column:
    """Lenient flag; the review-screen variant does not accept `t`."""
    words = ["1", "true", "yes", "y"] + (["t"] if accept_t else [])
    return F.coalesce(F.lower(F.trim(c)).isin(words), F.lit(False))


def nonzero(c: Column) -> Column:
    """Null for zero, so that `coalesce` skips empty amounts."""
    return F.when(c != 0, c)


def zip5(c: Column) -> Column:
    """Five-digit ZIP key: first five characters, left padded; null gives 00000."""
    return F.lpad(F.substring(F.coalesce(c, F.lit("")), 1, 5), 5, "0")


def slug(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def effective(override: Column, value: Column) -> Column:
    """Reviewed value when there is one, else the extracted value."""
    return F.coalesce(override, value)


def dim_weight(length: Column, width: Column, height: Column, divisor: Column) -> Column:
    """Dimensional weight in whole pounds, in integer arithmetic (sizes are not negative)."""
    volume = (F.ceil(length) * F.ceil(width) * F.ceil(height)).cast("bigint")
    by = divisor.cast("bigint")
    return F.call_function("div", volume + by - 1, by)


def rated_weight(actual: Column, dim: Column) -> Column:
    return F.greatest(actual, dim.cast(MONEY))


def company_key(name: Column) -> Column:
    """Grouping key of a company name; blank names share one key."""
    shown = F.coalesce(blank_to_null(F.trim(name)), F.lit("Unknown Company"))
    return F.trim(F.regexp_replace(F.lower(shown), r"[^\p{L}\p{N}]+", " "))


def text_key(value: Column) -> Column:
    """Comparable text of one scalar."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def list_key(values: Column, ordered: bool = False) -> Column:
    """Comparable text of a list; `ordered` sorts the parts first."""
    parts = F.transform(values, lambda v: F.lower(F.trim(v)))
    return F.array_join(F.array_sort(parts) if ordered else parts, "|")


def filled(value: Column) -> Column:
    """True for a value that is neither null nor blank."""
    return value.isNotNull() & (F.trim(value) != "")


def filled_list(values: Column) -> Column:
    return values.isNotNull() & (F.size(values) > 0)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.7, "mid").otherwise("low")


def week_start(d: Column) -> Column:
    """Monday of the week of `d`."""
    return F.date_trunc("week", d).cast("date")


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """First pattern in order that matches; Spark gives '' for no match."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, group)) for p in patterns])
