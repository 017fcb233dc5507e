"""Small DataFrames in the library's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarifflume.plans.views import _fields
from tarifflume.schemas import AGREEMENT_DDL, INVOICE_LINE
from tarifflume.sources.reference import business_calendar, us_federal_holidays


def lines(spark, rows: list[dict]) -> DataFrame:
    """Invoice lines from dicts of text values; `line_seq` is the list position."""
    names = sorted({k for r in rows for k in r} - {"agreement_id"})
    types = dict(INVOICE_LINE)
    data = [(i, r.get("agreement_id", 1)) + tuple(None if r.get(n) is None else str(r[n]) for n in names) for i, r in enumerate(rows)]
    raw = spark.createDataFrame(data, "line_seq bigint, agreement_id bigint" + "".join(f", {n} string" for n in names))
    cols = [F.col(n).cast(types[n]).alias(n) if n in names else F.lit(None).cast(t).alias(n) for n, t in INVOICE_LINE]
    out = raw.select("line_seq", "agreement_id", *cols)
    return out.withColumn("line_id", F.coalesce("line_id", F.concat(F.lit("L"), F.col("line_seq").cast("string")))).fillna("", ["tracking_number", "service_or_charge_type"])


def agreement(spark, **terms: str) -> DataFrame:
    """One approved agreement; keyword values are SQL expressions."""
    base = {"agreement_id": "1", "carrier": "'FedEx'", "status": "'approved'", "contract_ref": "'AG-1'", "customer_name": "'Acme LLC'"}
    base.update(terms)
    exprs = [f"cast({base.get(n, 'null')} as {t}) {n}" for n, t in _fields(AGREEMENT_DDL)]
    return spark.range(1).selectExpr(*exprs)


def fuel(spark, *rows):
    return spark.createDataFrame(rows, "carrier string, class string, w string, p string").selectExpr("carrier", "class", "to_date(w) week_start", "cast(p as decimal(8,4)) pct")


def windows(spark, *rows):
    return spark.createDataFrame(list(rows) or [("none", "2000-01-01", "2000-01-01")], "carrier string, s string, e string").selectExpr(
        "carrier", "to_date(s) start_date", "to_date(e) end_date"
    )


def calendar(spark):
    return business_calendar(spark, us_federal_holidays(spark, 2023, 2028), "2023-01-01", "2028-12-31")


def zips(spark, *rows):
    return spark.createDataFrame(list(rows), "carrier string, zip string, tier string")


def reference(spark, **over):
    base = {
        "fuel_rates": fuel(spark, ("fedex", "ground", "2025-01-06", "12.25"), ("fedex", "ground", "2025-01-13", "12.5"), ("ups", "ground", "2025-01-06", "11.75")),
        "windows": windows(spark), "calendar": calendar(spark), "area_zips": zips(spark, ("fedex", "10001", "metro")),
    }
    base.update(over)
    return base
