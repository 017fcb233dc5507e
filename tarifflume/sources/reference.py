"""Readers of the versioned reference tables: fuel weeks, area ZIPs, suspension
windows, holidays, zone maps. Every one of these is bounded by the calendar or by
the ZIP code space, never by the invoice volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tarifflume.schemas import PCT

# Service code -> (business days, latest delivery time or none).
SERVICE_COMMITMENTS: list[tuple[str, int, str | None]] = [
    ("fedex_first_overnight", 1, "08:00:00"),
    ("fedex_priority_overnight", 1, "10:30:00"),
    ("fedex_standard_overnight", 1, "16:30:00"),
    ("fedex_2day_am", 2, "10:30:00"),
    ("fedex_2day", 2, "16:30:00"),
    ("fedex_express_saver", 3, "16:30:00"),
    ("ups_next_day_air_early", 1, "08:00:00"),
    ("ups_next_day_air", 1, "10:30:00"),
    ("ups_next_day_air_saver", 1, "15:00:00"),
    ("ups_2nd_day_air_am", 2, "10:30:00"),
    ("ups_2nd_day_air", 2, None),
    ("ups_3_day_select", 3, None),
]

# Delivery exceptions that void the guarantee.
EXEMPT_EXCEPTIONS = ["weather", "address_error", "business_closed", "recipient_unavailable", "customs_delay"]

# Published minimum net charge by carrier and service group.
PUBLISHED_MINIMUM: list[tuple[str, str, str]] = [
    ("fedex", "ground", "11.00"),
    ("fedex", "home_delivery", "11.00"),
    ("fedex", "express", "12.50"),
    ("fedex", "ground_economy", "4.50"),
    ("ups", "ground", "11.00"),
    ("ups", "ground_saver", "4.50"),
    ("ups", "express", "12.50"),
]


def read_fuel_rates(spark: SparkSession, path: str) -> DataFrame:
    """JSON carrier -> class -> week -> percent as rows."""
    body = spark.read.text(path, wholetext=True)
    return fuel_rates_from_json(body.select(F.col("value").alias("body")))


def fuel_rates_from_json(bodies: DataFrame) -> DataFrame:
    """Rows (carrier, class, week_start, pct) of JSON documents in column `body`."""
    nested = F.from_json("body", "map<string, map<string, map<string, double>>>")
    return (
        bodies.select(F.explode(nested).alias("carrier", "classes"))
        .select("carrier", F.explode("classes").alias("class", "weeks"))
        .select("carrier", "class", F.explode("weeks").alias("week", "pct"))
        .select("carrier", "class", F.to_date("week").alias("week_start"), F.col("pct").cast(PCT).alias("pct"))
    )


def fuel_intervals(rates: DataFrame) -> DataFrame:
    """Each weekly rate with the day it stops to apply (null for the latest week).

    Of a week that occurs twice the row of greatest `row_ord` counts, without that column the
    greatest rate.
    """
    last = F.max_by("pct", "row_ord") if "row_ord" in rates.columns else F.max("pct")
    weeks = rates.groupBy("carrier", "class", "week_start").agg(last.alias("pct"))
    series = Window.partitionBy("carrier", "class").orderBy("week_start")
    return weeks.withColumn("week_end", F.lead("week_start").over(series))


def read_area_zips(spark: SparkSession, path: str, carrier: str) -> DataFrame:
    """Area-surcharge ZIPs of one carrier; the last row of a repeated ZIP wins.

    Row order of a CSV scan is (file, block offset in file, position in block).
    """
    raw = spark.read.csv(path, header=True)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at"))
    return area_zips(raw.withColumn("row_ord", order), F.lit(carrier))


def area_zips(raw: DataFrame, carrier: Column) -> DataFrame:
    """(carrier, zip, tier) of rows (zip, tier, row_ord)."""
    return (
        raw.groupBy(carrier.alias("carrier"), F.lpad(F.trim("zip"), 5, "0").alias("zip"))
        .agg(F.max_by(F.trim("tier"), "row_ord").alias("tier"))
    )


def read_suspension_windows(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("carrier string, start string, end string, reason string").json(path, multiLine=True)
    return suspension_windows(raw)


def suspension_windows(raw: DataFrame) -> DataFrame:
    return raw.select(
        "carrier",
        F.to_date("start").alias("start_date"),
        F.to_date("end").alias("end_date"),
        "reason",
    )


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Holiday dates of a JSON file year -> [dates]."""
    body = spark.read.text(path, wholetext=True)
    return holidays_from_json(body.select(F.col("value").alias("body")))


def holidays_from_json(bodies: DataFrame) -> DataFrame:
    years = F.from_json("body", "map<string, array<string>>")
    return (
        bodies.select(F.explode(years).alias("year", "days"))
        .select(F.explode("days").alias("day"))
        .select(F.to_date("day").alias("holiday"))
        .distinct()
    )


def us_federal_holidays(spark: SparkSession, first_year: int = 1990, last_year: int = 2100) -> DataFrame:
    """Federal holidays with their observed shifts (Saturday to Friday, Sunday to Monday)."""

    def day(month: int, dom: int) -> Column:
        return F.make_date("y", F.lit(month), F.lit(dom))

    def nth(month: int, weekday: str, n: int) -> Column:
        return F.date_add(F.next_day(F.date_sub(day(month, 1), 1), weekday), 7 * (n - 1))

    last_may_monday = F.date_sub(F.next_day(day(5, 31), "Mon"), 7)
    floating = [nth(1, "Mon", 3), nth(2, "Mon", 3), last_may_monday, nth(9, "Mon", 1), nth(10, "Mon", 2), nth(11, "Thu", 4)]
    juneteenth = F.when(F.col("y") >= 2021, day(6, 19))
    # New Year's Day of the next year can be observed on 31 December of this one.
    fixed = [day(1, 1), juneteenth, day(7, 4), day(11, 11), day(12, 25)]

    def observed(d: Column) -> Column:
        return F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1))

    every = floating + fixed + [observed(d) for d in fixed]
    years = spark.range(first_year, last_year + 1, 1, 1).select(F.col("id").cast("int").alias("y"))
    return (
        years.select(F.explode(F.array(*every)).alias("holiday")).where("holiday is not null").distinct()
    )


def business_calendar(
    spark: SparkSession, holidays: DataFrame, first_day: str = "1990-01-01", last_day: str = "2100-12-31"
) -> DataFrame:
    """(day, bd_ord, is_business): running number of business days.

    The n-th business day strictly after any day d is the business day numbered
    ``bd_ord(d) + n``. One row per day (about 365 a year), so the single-partition
    window is bounded by the calendar.
    """
    span = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day)))).alias("day"))
    off = holidays.select(F.col("holiday").alias("day")).distinct().withColumn("off", F.lit(True))
    flagged = span.join(F.broadcast(off), "day", "left").select(
        "day", ((F.weekday("day") < 5) & F.col("off").isNull()).alias("is_business")
    )
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("bd_ord", F.sum(F.col("is_business").cast("int")).over(running))


def read_zone_map(spark: SparkSession, path: str) -> DataFrame:
    """Zone by three-digit origin and destination prefix."""
    return spark.read.schema("origin_prefix string, destination_prefix string, zone int").csv(path, header=True)


def read_transit_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("zone int, business_days int").csv(path, header=True)


def commitments(spark: SparkSession) -> DataFrame:
    """The fixed delivery commitments as a table."""
    return spark.createDataFrame(SERVICE_COMMITMENTS, "service_code string, days int, commit_time string")
