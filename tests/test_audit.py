"""Line checks and rollups on hand-made lines."""

import pytest
from pyspark.sql import functions as F

from helpers import agreement, fuel, lines, reference, windows
from tarifflume.operators import checks as ck, rollups as ru
from tarifflume.schemas import INVOICE_LINE
from tarifflume.sources import invoices as inv


def run(spark, check, rows, terms=None, **ref):
    enriched = ck.enrich(lines(spark, rows), agreement(spark, **(terms or {})), checks=[check], **reference(spark, **ref))
    return ck.run_checks(enriched, [check]).collect()


def test_dim_weight_rounds_every_side_up(spark):
    from tarifflume.functions.values import dim_weight

    row = spark.range(1).select(dim_weight(F.lit(11.1), F.lit(8.1), F.lit(6.1), F.lit(139)).alias("d")).first()
    assert row["d"] == 6


LONG_BOX = {"length": 49.1, "width": 10, "height": 10, "actual_weight_lbs": 5, "rate_per_lb": 1}


def test_long_side_minimum_is_fedex_only(spark):
    (fedex,) = run(spark, "dim", [LONG_BOX | {"rated_weight_lbs": 20}])
    assert float(fedex["expected_value"]) == 40.0 and fedex["discrepancy_type"] == "undercharge"
    (ups,) = run(spark, "dim", [LONG_BOX | {"rated_weight_lbs": 40}], {"carrier": "'UPS'"})
    assert float(ups["expected_value"]) != 40.0


def test_missing_size_gives_no_dim_finding(spark):
    assert run(spark, "dim", [{"length": 10, "width": 10, "actual_weight_lbs": 5, "rated_weight_lbs": 50}]) == []


FUEL_LINE = {"ship_date": "2025-01-10", "service_group": "ground", "net_transport_charge": 100, "published_charge": 200, "fuel_surcharge_billed": 20}


def fuel_terms(pct, expires="null"):
    return {"fuel_surcharge": f"named_struct('discount_pct', cast({pct} as decimal(8,4)), 'expiration_date', cast({expires} as date))"}


def test_fuel_discount_and_expiry(spark):
    (found,) = run(spark, "fuel", [FUEL_LINE], fuel_terms(10))
    assert float(found["expected_value"]) == 11.03
    (expired,) = run(spark, "fuel", [FUEL_LINE], fuel_terms(10, "'2024-12-31'"))
    assert float(expired["expected_value"]) == 12.25


def test_fuel_base_depends_on_carrier(spark):
    (fedex,) = run(spark, "fuel", [FUEL_LINE], fuel_terms(0))
    (ups,) = run(spark, "fuel", [FUEL_LINE | {"fuel_surcharge_billed": 40}], fuel_terms(0) | {"carrier": "'UPS'"})
    assert float(fedex["expected_value"]) == 12.25 and float(ups["expected_value"]) == 23.5


def test_fuel_before_first_week_or_without_terms_is_skipped(spark):
    assert run(spark, "fuel", [FUEL_LINE | {"ship_date": "2024-12-01"}], fuel_terms(0)) == []
    assert run(spark, "fuel", [FUEL_LINE], fuel_terms("null")) == []


LATE = {"ship_date": "2026-01-05", "service_code": "fedex_priority_overnight", "service_group": "express", "total_billed": 55, "actual_delivery_datetime": "2026-01-06 12:00:00"}


def test_guarantee(spark):
    (late,) = run(spark, "guarantee", [LATE])
    assert float(late["dollar_impact"]) == 55.0
    assert run(spark, "guarantee", [LATE | {"actual_delivery_datetime": "2026-01-06 10:00:00"}]) == []
    assert run(spark, "guarantee", [LATE], {"gsr_status": "map('express', 'Waived')"}) == []
    assert run(spark, "guarantee", [LATE | {"carrier_exception_code": "Weather"}]) == []
    assert run(spark, "guarantee", [LATE], windows=windows(spark, ("fedex", "2026-01-01", "2026-01-10"), ("fedex", "2026-01-03", "2026-01-06"))) == []


def test_business_days_skip_weekends_and_holidays(spark):
    import datetime as dt

    rows = lines(spark, [{"ship_date": d, "service_code": "fedex_express_saver"} for d in ("2025-07-02", "2025-07-04", "2025-07-05", "2025-12-24")])
    from helpers import calendar

    got = [r["promised_date"] for r in ck.attach_promise(rows, calendar(spark)).orderBy("line_seq").collect()]
    # Independence Day and Christmas are off.
    assert got == [dt.date(2025, 7, 8), dt.date(2025, 7, 9), dt.date(2025, 7, 9), dt.date(2025, 12, 30)]


def test_holidays_match_the_published_years(spark):
    from tarifflume.sources.reference import us_federal_holidays

    days = {str(r["holiday"]) for r in us_federal_holidays(spark, 2025, 2026).collect()}
    assert {"2025-01-20", "2025-05-26", "2025-10-13", "2025-11-27", "2026-01-19", "2026-07-03", "2026-09-07", "2026-11-26"} <= days


def test_area_and_residential_and_duplicates(spark):
    (area,) = run(spark, "area", [{"destination_zip": "99999", "das_billed": 5}, {"destination_zip": "10001-22", "das_billed": 5}])
    assert area["line_id"] == "L0"
    (res,) = run(spark, "residential", [{"is_residential": "false", "residential_surcharge_billed": 4}, {"residential_surcharge_billed": 4}])
    assert res["discrepancy_type"] == "unsupported_fee" and res["line_id"] == "L0"
    twice = [{"tracking_number": "t1", "ship_date": "2026-01-01", "total_billed": 10}] * 2
    dup = ck.duplicate_findings(lines(spark, twice + [{"tracking_number": "Unknown", "total_billed": 1}] * 2)).collect()
    assert [d["line_id"] for d in dup] == ["L1"]


TIERS = """named_struct('kind', null, 'tiers', array(
  named_struct('threshold_min', 50000, 'threshold_max', null, 'discounts', map('fedex_ground', 20)),
  named_struct('threshold_min', 0, 'threshold_max', 50000, 'discounts', map('fedex_ground', 10))), 'base_discounts', null, 'tier_discounts', null)"""


def test_earned_tier_follows_revenue(spark):
    line = {"ship_date": "2025-01-07", "service_code": "fedex_ground", "transport_charge": 100, "incentive_credit": -10}
    assert run(spark, "earned", [line], {"earned": TIERS}) == []
    (found,) = run(spark, "earned", [line | {"transport_charge": 1000, "incentive_credit": -100}], {"earned": TIERS})
    assert found["discrepancy_type"] == "missing_discount" and float(found["dollar_impact"]) == 100.0


LAYERS = """named_struct('kind', 'ups_multi_layer', 'tiers', null, 'base_discounts', map(
  'ups_ground', named_struct('alias', null, 'zone_exceptions', map('8', 50), 'flat_discount_pct', null,
     'by_weight', array(named_struct('min_lbs', null, 'max_lbs', 10, 'discount_pct', 20), named_struct('min_lbs', 10, 'max_lbs', null, 'discount_pct', 40)))),
  'tier_discounts', map('ups_ground', 10))"""


@pytest.mark.parametrize("zone,weight,expected", [(2, 10, 72.0), (2, 11, 54.0), (8, 5, 45.0)])
def test_layered_discount(spark, zone, weight, expected):
    line = {"service_code": "ups_ground", "published_charge": 100, "net_transport_charge": 99, "zone": zone, "rated_weight_lbs": weight}
    (found,) = run(spark, "earned", [line], {"earned": LAYERS, "carrier": "'UPS'"})
    assert float(found["expected_value"]) == expected


def test_minimum_handling_large_address(spark):
    (low,) = run(spark, "minimum", [{"service_group": "ground", "net_transport_charge": 11.02}], {"minimum_net_charge": "map('ground', 8.5)"})
    assert float(low["dollar_impact"]) == 2.52
    box = {"length": 20, "width": 20, "height": 20, "actual_weight_lbs": 10, "ahs_billed": 15, "large_package_billed": 90}
    assert len(run(spark, "handling", [box, box | {"width": 31, "length": 40}])) == 1
    assert len(run(spark, "large", [box, box | {"length": 97}])) == 1
    over = {"accessorials": "map('address_correction', named_struct('flat_fee_override', 18))"}
    (adr,) = run(spark, "address", [{"address_correction_billed": 20}], over)
    assert adr["discrepancy_type"] == "overcharge" and float(adr["dollar_impact"]) == 2.0


def test_storage_checks(spark):
    rows = spark.sql("select 'a' line_id, 1L agreement_id, 'r' reference_id, ' Storage' service_category, 'bin' unit_of_measure, 10.0 quantity_billed, 2.5 rate_billed, 25.0 amount_billed")
    terms = spark.sql("select 1L agreement_id, cast(2 as decimal(18,4)) storage_rate, 'pallet' storage_unit")
    got = {r["field"]: r for r in ck.storage_findings(rows, terms).collect()}
    assert float(got["storage_rate"]["dollar_impact"]) == 5.0 and got["storage_unit"]["discrepancy_type"] == "ambiguous_needs_review"


def test_dedupe_report_and_order_independence(spark):
    rows = [FUEL_LINE | {"line_id": "same", "tracking_number": f"t{i}", "total_billed": 100} for i in range(3)]
    data, terms = lines(spark, rows), agreement(spark, **fuel_terms(10))
    first = ru.first_per_charge(ru.all_findings(data, terms, **reference(spark)))
    again = ru.first_per_charge(ru.all_findings(data.repartition(7), terms, **reference(spark)))
    key = lambda df: sorted((r["line_id"], r["field"], r["line_seq"]) for r in df.collect())
    assert key(first) == key(again) == [("same", "fuel_surcharge", 0)]
    (report,) = ru.report_headers(data, first, terms).collect()
    assert report["lines_audited"] == 3 and report["lines_with_discrepancies"] == 1 and float(report["total_recovery_potential"]) == 8.97
    (run_row,) = ru.run_counters(ru.report_headers(data, first, terms)).collect()
    assert run_row["checks_evaluated"] == 30 and run_row["checks_without_result"] == 29


def test_text_report_reads_in_order(spark):
    rows = [FUEL_LINE | {"line_id": f"l{i}", "tracking_number": f"t{i}"} for i in range(12)]
    data, terms = lines(spark, rows), agreement(spark, **fuel_terms(10))
    found = ru.first_per_charge(ru.all_findings(data, terms, **reference(spark)))
    text = ru.report_lines(found, ru.report_headers(data, found, terms), "2026-01-01Z", F.floor(F.col("line_seq") / 5))
    body = [r["text"] for r in text.orderBy("section", "item", "part").collect()]
    assert body[0] == "Invoice Audit Report" and "Company:        Acme LLC" in body
    assert [b for b in body if b.startswith("[")] == [f"[{i}] OVERCHARGE" for i in range(1, 13)]
    assert "Overcharge                   12 shipments    $107.64" in body


def test_csv_chain_gives_known_findings(spark, tmp_path):
    """Four carrier rows; one clean, one over-billed weight, one fuel overcharge, one below a pound off."""
    head = "Tracking ID,Ship Date,Service Type,Recipient ZIP,Zone,Billed Weight,Transportation Charge,Net Charge,Fuel Surcharge,actual_weight_lbs,length,width,height,rate_per_lb"
    rows = [
        "T1,2025-01-13,FedEx Ground,10001,5,5,100.00,100.00,11.25,5,5,5,5,1",
        "T2,01/13/2025,FedEx Ground,10001,5,24,100.00,100.00,11.25,5,5,5,5,1.5",
        "T3,2025-01-13,FXG,10001,5,5,100.00,100.00,20.00,5,5,5,5,1",
        'T4,"Jan 13, 2025",FedEx Ground,10001,5,5.4,100.00,100.00,11.25,5,5,5,5,1',
    ]
    path = tmp_path / "inv.csv"
    path.write_text("\n".join([head, *rows]) + "\n")
    items = inv.read_csv_invoice(spark, str(path), "fedex").withColumn("line_seq", F.col("_row")).withColumn("agreement_id", F.lit(1).cast("bigint"))
    full = items.select("agreement_id", "line_seq", *[F.col(n) if n in items.columns else F.lit(None).cast(t).alias(n) for n, t in INVOICE_LINE])
    found = ru.first_per_charge(ru.all_findings(full, agreement(spark, **fuel_terms(10)), **reference(spark))).collect()
    got = {(r["tracking_number"], r["field"]): float(r["dollar_impact"]) for r in found}
    assert got == {("T2", "rated_weight_lbs"): 28.5, ("T3", "fuel_surcharge"): 8.75}


def test_canonical_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("id,tracking_number,ship_date,service_code,rated_weight_lbs,net_transport_charge,fuel_surcharge_billed,total_billed\nx1,T9,2025-01-13,FXG,5,100,20,120\n,T8,bad,,,,,\n")
    got = {r["tracking_number"]: r for r in inv.read_csv_invoice(spark, str(path), "fedex").collect()}
    assert got["T9"]["service_code"] == "fedex_ground" and float(got["T9"]["total_billed"]) == 120.0
    assert got["T8"]["ship_date"] is None and got["T8"]["service_code"] is None


def test_approval_gate(spark):
    with pytest.raises(ValueError, match="approved"):
        inv.require_approved(agreement(spark, status="'pending_review'"))


def explained(spark, check, rows, terms=None, **ref):
    enriched = ck.enrich(lines(spark, rows), agreement(spark, **(terms or {})), checks=[check], **reference(spark, **ref))
    return [r["explanation"] for r in ck.describe(ck.run_checks(enriched, [check])).collect()]


def test_explanations_name_what_the_check_saw(spark):
    assert explained(spark, "fuel", [FUEL_LINE], fuel_terms(10)) == [
        "Published rate 12.25% - 10.0% contracted discount = 11.025% effective. Base: $100.00. Expected: $11.03, Billed: $20.00"
    ]
    assert explained(spark, "dim", [LONG_BOX | {"rated_weight_lbs": 20}]) == [
        "DIM divisor 139: ceil(49.1)×ceil(10.0)×ceil(10.0)/139 = 36 lb DIM, rated 40.0 lb, billed 20.0 lb"
    ]
    assert explained(spark, "guarantee", [LATE]) == [
        "GSR eligible: promised 2026-01-06 by 10:30:00, delivered 2026-01-06 12:00:00. Full refund of $55.00 eligible."
    ]
    by_end_of_day = LATE | {"service_code": "ups_2nd_day_air", "actual_delivery_datetime": "2026-01-09 08:00:00"}
    assert explained(spark, "guarantee", [by_end_of_day], {"carrier": "'UPS'"})[0].startswith("GSR eligible: promised 2026-01-07 by EOD,")
    assert explained(spark, "area", [{"destination_zip": "99999-1234", "das_billed": 3}]) == ["ZIP 99999 is not on FEDEX DAS list but DAS was charged"]
    box = {"length": 10.5, "width": 4, "height": 3}
    assert explained(spark, "handling", [box | {"ahs_billed": 15}]) == [
        "AHS charged but package dims 10.5x4.0x3.0 and weight 0.0 lbs do not meet FEDEX AHS criteria"
    ]
    assert explained(spark, "large", [box | {"large_package_billed": 95}]) == [
        "Large Package Surcharge charged but dims 11x4x3 do not meet FEDEX large package threshold"
    ]
    assert explained(spark, "residential", [{"residential_surcharge_billed": 4, "is_residential": "false"}]) == ["Residential surcharge applied to commercial address"]
    mnc = {"minimum_net_charge": "map('ground', cast(8.25 as decimal(18,4)))"}
    assert explained(spark, "minimum", [{"service_group": "ground", "net_transport_charge": 11}], mnc) == ["Contract MNC $8.25 but published default $11.00 applied"]


def test_a_finding_fills_only_its_own_evidence(spark):
    (found,) = run(spark, "area", [{"destination_zip": "99999", "das_billed": 3}])
    assert {k: v for k, v in found["evidence"].asDict().items() if v is not None} == {"carrier": "fedex", "zip": "99999"}
    twice = [{"tracking_number": "T1", "ship_date": "2025-01-02", "total_billed": 5}] * 2
    (again,) = ck.describe(ck.duplicate_findings(lines(spark, twice))).collect()
    assert again["evidence"] is None and again["explanation"] == "Tracking number T1 billed more than once on 2025-01-02"


def test_staged_findings_hold_no_texts(spark):
    rows = [FUEL_LINE | {"line_id": f"l{i}", "tracking_number": f"t{i}"} for i in range(4)]
    data, terms = lines(spark, rows), agreement(spark, **fuel_terms(10))
    staged, whole = ru.staged_findings(data, terms, **reference(spark)), ru.first_per_charge(ru.all_findings(data, terms, **reference(spark)))
    told = lambda df: sorted(map(str, df.select("line_id", "field", "dollar_impact", "billed_amount", "why_discrepancy", "explanation").collect()))
    assert told(staged) == told(whole) and len(told(whole)) == 4
    assert "explanation" not in spark.read.parquet(*staged.inputFiles()).columns
