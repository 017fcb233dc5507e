"""Files as they come: mixed dialects in one folder, split files, repeated weeks."""

import datetime

from pyspark.sql import functions as F

from helpers import fuel
from tarifflume.operators import checks as ck, invoice_text as it, maintenance as mt
from tarifflume.sources import invoices as inv, reference

FEDEX = "Tracking ID,Ship Date,Service Type,Transportation Charge,Earned Discount,Net Charge\nT1,01/13/2025,FedEx Ground,100.00,5,90.00\nT2,01/14/2025,FedEx Ground,50.00,5,45.00\n"
UPS = "Tracking Number,Ship Date,Service,Published Charge,Incentive,Billed Charge\n1Z1,01/13/2025,UPS Ground,80.00,8,72.00\n"


def test_each_file_is_read_in_its_own_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_text(FEDEX)
    (tmp_path / "b.csv").write_text(UPS)
    (tmp_path / "c.csv").write_text(FEDEX.replace("T1", "T3").replace("T2", "T4"))
    rows = {r["tracking_number"]: r for r in inv.read_csv_invoice(spark, str(tmp_path), "fedex").collect()}
    assert set(rows) == {"T1", "T2", "T3", "T4", "1Z1"}
    assert rows["1Z1"]["service_code"] == "ups_ground" and float(rows["1Z1"]["published_charge"]) == 80.0
    assert all(r["ship_date"] is not None for r in rows.values())
    assert {k: (r["_file"], r["_row"]) for k, r in rows.items()} == {"T1": ("a.csv", 1), "T2": ("a.csv", 2), "T3": ("c.csv", 1), "T4": ("c.csv", 2), "1Z1": ("b.csv", 1)}


def test_row_numbers_follow_the_file_however_it_is_split(spark, tmp_path):
    head = "Tracking ID,Ship Date,Service Type,Transportation Charge,Earned Discount,Net Charge\n"
    (tmp_path / "big.csv").write_text(head + "".join(f"T{k},01/13/2025,FedEx Ground,100.00,5,90.00\n" for k in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = inv.read_csv_invoice(spark, str(tmp_path), "fedex")
        assert spark.read.csv(str(tmp_path), header=True).rdd.getNumPartitions() > 1
        assert {r["tracking_number"]: r["_row"] for r in got.collect()} == {f"T{k}": k for k in range(1, 3001)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_repeated_week_gives_one_rate_a_day(spark):
    rates = fuel(spark, ("fedex", "ground", "2025-01-06", "10"), ("fedex", "ground", "2025-01-13", "11"), ("fedex", "ground", "2025-01-13", "12"), ("fedex", "ground", "2025-01-20", "13"))
    lines = spark.sql("select explode(sequence(date'2025-01-05', date'2025-01-27')) ship_date, 'fedex' ag_carrier, 'ground' service_group")
    got = [(r["ship_date"], r["fuel_rate_pct"]) for r in ck.attach_fuel_rate(lines, rates).orderBy("ship_date").collect()]
    assert len(got) == 23 and len({d for d, _ in got}) == 23
    rate = {d.day: None if p is None else float(p) for d, p in got}
    assert rate[5] is None and rate[6] == 10 and rate[13] == 12 and rate[19] == 12 and rate[27] == 13
    ordered = reference.fuel_intervals(rates.withColumn("row_ord", -F.col("pct"))).where("week_start = date'2025-01-13'").collect()
    assert [float(r["pct"]) for r in ordered] == [11]


def test_context_of_a_document_is_found_on_any_page(spark):
    pages = [(1, p, "nothing here" if p != 400 else "Invoice Number: INV-77\nInvoice Date: 02/03/2025\nPriority Overnight by UPS 1Z") for p in range(1, 401)] + [(2, 1, "x")]
    got = {r["doc_id"]: r for r in it.page_context(spark.createDataFrame(pages, "doc_id long, page_number long, text string"), F.lit("fedex")).collect()}
    assert got[1]["invoice_id"] == "INV-77" and got[1]["invoice_date"] == datetime.date(2025, 2, 3) and got[1]["mentions_1z"]
    assert got[2]["invoice_id"] is None and got[2]["default_service"]["code"] == "fedex_ground" and not got[2]["mentions_ups"]


def test_all_incomplete_lines_are_reported(spark):
    items = spark.range(60).selectExpr("id doc_id", "cast(id as string) line_id", "cast(null as date) ship_date", "'x' service_code", "cast(1 as decimal(18,4)) rated_weight_lbs")
    assert it.validation_errors(items, ["doc_id"]).count() == 60
    assert it.validation_errors(items, ["doc_id"], shown=5).count() == 5


def test_age_of_a_table_is_that_of_its_newest_row(spark):
    dates = spark.sql("select * from values ('fuel_weekly_rates', date'2025-01-01'), ('fuel_weekly_rates', date'2025-01-09'), ('fedex_das_zips', date'2024-01-01') as t(name, day)")
    got = {r["name"]: (r["age_days"], r["stale"]) for r in mt.freshness(mt.table_ages(dates, F.lit("2025-01-15").cast("date")), mt.freshness_limits(spark)).collect()}
    assert got["fuel_weekly_rates"] == (6.0, False) and got["fedex_das_zips"] == (380.0, True) and got["ups_zone_map"] == (None, True)
