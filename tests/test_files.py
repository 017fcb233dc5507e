"""Readers and sinks on real files."""

import json

import pytest
from pyspark.sql import functions as F

from tarifflume.operators import maintenance as mt, study as st
from tarifflume.sources import extractions as ex, invoices as inv, reference as rf


def test_reference_files(spark, tmp_path):
    fuel = tmp_path / "fuel.json"
    fuel.write_text(json.dumps({"fedex": {"ground": {"2025-01-06": 12.25, "2025-01-13": 12.5}}}, indent=1))
    assert {(str(r["week_start"]), float(r["pct"])) for r in rf.read_fuel_rates(spark, str(fuel)).collect()} == {("2025-01-06", 12.25), ("2025-01-13", 12.5)}
    win = tmp_path / "w.json"
    win.write_text(json.dumps([{"carrier": "ups", "start": "2024-11-25", "end": "2025-01-05", "reason": "peak"}], indent=1))
    (row,) = rf.read_suspension_windows(spark, str(win)).collect()
    assert str(row["end_date"]) == "2025-01-05"
    hol = tmp_path / "h.json"
    hol.write_text(json.dumps({"2025": ["2025-01-01", "2025-12-25"]}, indent=1))
    assert rf.read_holidays(spark, str(hol)).count() == 2
    zips = tmp_path / "z.csv"
    zips.write_text("zip,tier\n501,metro\n00501, rural \n10001,metro\n")
    assert {(r["zip"], r["tier"]) for r in rf.read_area_zips(spark, str(zips), "fedex").collect()} == {("00501", "rural"), ("10001", "metro")}
    zone = tmp_path / "zone.csv"
    zone.write_text("origin_prefix,destination_prefix,zone\n070,005,2\n")
    assert rf.read_zone_map(spark, str(zone)).first()["origin_prefix"] == "070"


def test_payload_files(spark, tmp_path):
    (tmp_path / "INV9.json").write_text(json.dumps({"line_items": [{"transaction_id": "t1", "total_billed": 5.5}, "x", {"id": "own", "tracking_number": "t2", "ship_date": "2025-01-02"}]}))
    got = {r["line_id"]: r for r in inv.read_payloads(spark, str(tmp_path / "INV9.json")).collect()}
    assert set(got) == {"INV9:1", "own"} and got["INV9:1"]["tracking_number"] == "t1" and float(got["INV9:1"]["total_billed"]) == 5.5


def test_stores_skip_broken_files(spark, tmp_path):
    for folder, name, body in (("a", "1", {"id": "1", "status": "pending_review", "extraction_timestamp": "2025-01-01"}), ("b", "1", {"id": "1", "status": "approved", "extraction_timestamp": "2025-01-02"}), ("b", "2", {"id": "2", "status": "approved", "extraction_timestamp": "2025-03-01"})):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "a" / "bad.json").write_text("{not json")
    stored = ex.read_store(spark, str(tmp_path / "a"), 0).unionByName(ex.read_store(spark, str(tmp_path / "b"), 1))
    assert [(r["id"], r["store_ord"]) for r in ex.list_extractions(stored).collect()] == [("2", 1), ("1", 0)]
    assert [r["id"] for r in ex.list_extractions(stored, "approved").collect()] == ["2", "1"]
    path = ex.write_state(ex.with_status(ex.list_extractions(stored), "approved"), str(tmp_path / "state"), "v1")
    assert spark.read.parquet(path).where("status = 'approved'").count() == 2
    with pytest.raises(Exception):
        ex.write_state(stored, str(tmp_path / "state"), "v1")


def test_sinks(spark, tmp_path):
    headers = spark.sql("select 1L agreement_id, 'Acme' company_name")
    lines = spark.sql("select 1L agreement_id, 1 section, 0L item, explode(array(named_struct('part', 0, 'text', 'a'), named_struct('part', 1, 'text', 'b'))) x").select("agreement_id", "section", "item", "x.*")
    ex.write_report(headers, headers, lines, str(tmp_path / "rep"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "rep" / "text")).collect()} == {"a", "b"}
    for _ in range(2):
        ex.write_run_log(headers, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert mt.write_version(headers, str(tmp_path / "ref"), "20250101").endswith("version=20250101")
    records = st.with_outcome(spark.sql("select 's' shipment_id, false ai_found, true human_found"))
    st.write_gaps(records, str(tmp_path / "fn"))
    assert spark.read.csv(str(tmp_path / "fn"), header=True).first()["outcome"] == "FN"


def test_freshness(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t.parquet"))
    ages = mt.file_ages(spark, {"fuel_weekly_rates": str(tmp_path / "t.parquet")}, F.current_timestamp() + F.expr("interval 11 days"))
    got = {r["name"]: r for r in mt.freshness(ages, mt.freshness_limits(spark)).collect()}
    assert got["fuel_weekly_rates"]["stale"] and got["fuel_weekly_rates"]["present"] and not got["ups_das_zips"]["present"]
    assert mt.health_summary(mt.freshness(ages, mt.freshness_limits(spark))).first()["stale_or_missing"] == 5


def test_weekly_pairs(spark):
    df = spark.createDataFrame([("d", "Week of 01/06/2025 rate is 12.25 % then 2025-01-13: 12.5% and 1/6/2025 now 13%")], "doc_id string, text string")
    assert {(r["week"], float(r["pct"])) for r in mt.weekly_pairs(df).collect()} == {("2025-01-06", 13.0), ("2025-01-13", 12.5)}


def test_only_published_versions_are_read(spark, tmp_path):
    folder = str(tmp_path / "v")
    one, two = spark.range(3), spark.range(5)
    mt.publish_version(one, folder, "20250101")
    mt.publish_version(two, folder, "20250201")
    mt.write_version(spark.range(9), folder, "20250301")
    assert mt.read_version(spark, folder).count() == 5 and mt.read_version(spark, folder, "20250101").count() == 3
    with pytest.raises(ValueError, match="no published version"):
        mt.read_version(spark, folder, "20250301")
