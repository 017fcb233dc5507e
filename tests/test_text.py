"""Text parsers, positions, layout, chunks and metadata."""

import pytest
from pyspark.sql import Window, functions as F

from tarifflume.functions import labels as lb, values as v
from tarifflume.operators import agreement_text as tx, assembly as asm, invoice_text as it, positions as ps, quality as qa, resolve as rs, sections as sc
from tarifflume.sources import documents as docs

UPS_PAGES = [
    (1, "Invoice Number: INV-77\nInvoice Date: 03/01/2025\n02/10/2025\n1Z1234567890ABCDEF Ground Residential 10001 5 12 20.00 -5.00 15.00\n1st ref 99.99\n"
        "Fuel Surcharge 1.50\nResidential Delivery 4.45\nCustomer Weight 10.5"),
    (2, "Total 30.00 20.95\nTotal Billed 99.00\n1Z1234567890ABCDEG Next Day Air 7.00\nFuel Surcharge 0.70\nBilling Adjustments\n1Z1234567890ABCDEH Ground 5.00"),
]
FEDEX_PAGES = [
    (1, "Invoice Number: F-1\nFedEx Ground Prepaid Detail\nShip Date: Mar 03, 2025\nTracking ID 123456789012\nZone 5  10001\nTransportation Charge 12.00\nFuel Surcharge 1.20\nRated Weight 7 lbs\n"
        "Ship Date: 03/04/2025\nTracking ID 123456789013\nTransportation Charge 9.00"),
    (2, "Priority Overnight Ship Date: 03/05/2025\nZone 3\nWeight: 2.5 lbs"),
]


def pages(spark, rows, doc="d"):
    return spark.createDataFrame([(doc, n, text) for n, text in rows], "doc_id string, page_number int, text string")


def context(spark, data, hint):
    return it.document_context(docs.head_text(data), F.lit(hint))


@pytest.mark.parametrize("block", [1, 4096])
def test_tracking_shipments(spark, block):
    data = pages(spark, UPS_PAGES)
    rows = it.tracking_shipments(data, context(spark, data, "ups"), block).orderBy("item_no").collect()
    a, b = rows
    assert (a["tracking_number"], str(a["ship_date"]), a["invoice_id"]) == ("1Z1234567890ABCDEF", "2025-02-10", "INV-77")
    assert float(a["total_billed"]) == 20.95 and float(a["rated_weight_lbs"]) == 12.0 and float(a["actual_weight_lbs"]) == 10.5
    assert float(a["published_charge"]) == 20.0 and float(a["incentive_credit"]) == -5.0 and a["source_page"] == 2
    assert float(b["total_billed"]) == 7.7 and b["service_code"] == "ups_next_day_air" and len(rows) == 2


@pytest.mark.parametrize("block", [1, 4096])
def test_block_shipments(spark, block):
    data = pages(spark, FEDEX_PAGES)
    rows = it.block_shipments(docs.text_lines(data), context(spark, data, "fedex"), block).orderBy("item_no").collect()
    assert [float(r["total_billed"]) for r in rows] == [13.2, 9.0, 0.0]
    assert rows[0]["destination_zip"] == "10001" and rows[0]["service_code"] == "fedex_ground"
    # The second block is closed by a ship-date line that names the next service.
    assert rows[1]["service_or_charge_type"].startswith("Priority Overnight") and str(rows[2]["ship_date"]) == "2025-03-05"


def test_cascade_and_gate(spark):
    data = pages(spark, UPS_PAGES).unionByName(pages(spark, FEDEX_PAGES, "f"))
    kept = it.parse_documents(data, context(spark, data, "fedex")).collect()
    assert {(r["doc_id"], r["parser_ord"]) for r in kept} == {("d", 2), ("f", 3)}
    bad = spark.sql("select 'x' doc_id, 'x:1' line_id, cast(null as date) ship_date, 'g' service_code, 1.0 rated_weight_lbs")
    with pytest.raises(ValueError, match="missing critical field"):
        it.require_complete(bad, ["line_id"])


def test_blocks_only_where_the_caller_says(spark):
    """An invoice that begins with adjustments has no records; its weight lines are blocks only if they may be."""
    lost = [(1, "Invoice Number: INV-1\nInvoice Date: 02/03/2025\nBilling Adjustments\n1Z1234567890ABCDEF Ground 5.00\nFuel Surcharge 1.50\nCustomer Weight 10.5")]
    ups, fedex = pages(spark, lost, "u"), pages(spark, FEDEX_PAGES, "f")
    data = ups.unionByName(fedex)
    where = it.page_context(data.select("doc_id", "page_number", docs.marked_page().alias("text")), F.expr("case when doc_id = 'u' then 'ups' else 'fedex' end"))
    of = lambda **kw: {(r["doc_id"], r["parser_ord"]) for r in it.parse_documents(data, where, **kw).collect()}
    assert of() == {("u", 3), ("f", 3)}
    assert of(block_pages=data.where("doc_id = 'f'")) == {("f", 3)}


def test_running_by_page_equals_plain_windows(spark):
    rows = [("a" if i < 150 else "b", i // 5, i % 5, i % 7 == 3, f"s{i}" if i % 11 == 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, page long, no int, f boolean, s string")
    how = dict(sums={"n": F.col("f").cast("bigint")}, lasts={"last": F.col("s")}, befores={"before": F.col("s")})
    block = F.floor(F.col("page") / 4)
    whole = Window.partitionBy("k").orderBy("page", "no")
    want = df.select(
        "*", F.sum(F.col("f").cast("bigint")).over(whole).alias("n"), F.last("s", True).over(whole).alias("last"),
        F.last("s", True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.row_number().over(whole).alias("number"),
    ).collect()
    got = ps.running(df, ["k"], ["page", "no"], block, page="page", **how)
    got = ps.number_within(got, ["k"], ["page", "no"], block, page="page").select(*want[0].asDict()).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:3]) == sorted(map(tuple, want), key=lambda r: r[:3])


def test_running_equals_plain_windows(spark):
    rows = [(i % 3, i // 3, i % 5 == 0, None if i % 4 else f"v{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "k int, p int, f boolean, s string")
    got = ps.running(df, ["k"], ["p"], F.floor(F.col("p") / 4), sums={"n": F.col("f").cast("bigint")}, lasts={"last": F.col("s")}).collect()
    for k in range(3):
        n, last = 0, None
        for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["p"]):
            n, last = n + int(r["f"]), r["s"] or last
            assert (r["n"], r["last"]) == (n, last)
    numbered = ps.number_within(df, ["k"], ["p"], F.floor(F.col("p") / 7)).collect()
    assert all(r["number"] == r["p"] + 1 for r in numbered)


def test_match_spans_are_exact(spark):
    df = spark.createDataFrame([("ab12cd3ef456",)], "t string")
    (row,) = df.select(tx.match_spans(F.col("t"), r"[a-z](\d+)").alias("m")).collect()
    assert [(m["start"], m["full"], m["g1"]) for m in row["m"]] == [(1, "b12", "12"), (5, "d3", "3"), (8, "f456", "456")]


def meta_of(spark, text):
    df = spark.createDataFrame([("d", text)], "doc_id string, full_text string")
    return tx.metadata(df).first()


def test_customer_boilerplate_is_rejected(spark):
    assert meta_of(spark, "Shipper: Do not pay this bill, charges were submitted to\n")["customer_name"] is None
    got = meta_of(spark, "Submitted to: ARMOIRE STYLE LLC\nInvoice")["customer_name"]
    assert got["value"] == "ARMOIRE STYLE LLC" and got["needs_review"] and got["confidence"] == 0.72


def test_account_needs_a_digit(spark):
    assert meta_of(spark, "Account Number: Invoice\n")["account_number"] is None
    assert meta_of(spark, "Account Number: 123456789\n")["account_number"]["value"] == "123456789"


def test_company_cleaning(spark):
    (row,) = spark.range(1).select(lb.clean_company(F.lit("UPSHC_NorthRiverLLC")).alias("c")).collect()
    assert row["c"] == "North River LLC"


def test_two_digit_years(spark):
    (row,) = spark.range(1).select(v.parse_date(F.lit("1/2/75")).alias("a"), v.parse_date(F.lit("1/2/68")).alias("b"), v.parse_date(F.lit("2025-13-01")).alias("c")).collect()
    assert (str(row["a"]), str(row["b"]), row["c"]) == ("1975-01-02", "2068-01-02", None)


def chunk_by_hand(rows, target, limit):
    """Plain restatement of the chunk rules for short fixtures."""
    groups = []
    for n, text in rows:
        header = text.startswith("SECTION")
        if header and groups or not groups:
            groups.append("")
        groups[-1] += f"\n\n--- Page {n} ---\n{text}"
    merged = []
    for g in groups:
        if merged and len(merged[-1]) + len(g) < target:
            merged[-1] += g
        else:
            merged.append(g)
    out = []
    for m in merged:
        m = m.strip()
        if len(m) <= limit:
            out.append(m)
            continue
        open_part = ""
        for para in m.split("\n\n"):
            if len(open_part) + len(para) > target and open_part:
                out.append(open_part.strip())
                open_part = ""
            open_part += "\n\n" + para
        out.append(open_part.strip())
    return out


def test_chunks(spark):
    rows = [(i, ("SECTION A\n" if i % 3 == 0 else "") + f"para {i}\n\n" + "x" * (40 * i)) for i in range(1, 9)]
    got = sc.chunks(pages(spark, rows), target=200, limit=400, pages_per_block=2).orderBy("chunk", "part").collect()
    assert [r["text"] for r in got] == chunk_by_hand(rows, 200, 400)


def test_chunks_of_a_long_document_without_headers(spark):
    """Line feeds of all lengths between pages, empty and null pages, many runs."""
    ends = ["", "\n", "\n\n", "\n\n\n", " \n\n\n\n\n"]
    rows = [(i, "\n" * (i % 4) + f"w{i} " * (i % 23) + "\n\n" + "y" * (i * 7 % 90) + ends[i % 5]) for i in range(1, 120)]
    got = sc.chunks(pages(spark, rows), target=300, limit=500, pages_per_block=8).orderBy("chunk", "part").collect()
    wanted = [x for x in chunk_by_hand(rows, 300, 500) if x]
    assert [r["text"] for r in got] == wanted and [r["part"] for r in got] == list(range(len(wanted)))
    assert sc.chunks(pages(spark, rows).where("false")).count() == 0


def test_context_sections(spark):
    text = "a" * 9000 + "fuel" + "b" * 300 + "discount" + "c" * 2000
    data = spark.createDataFrame([("d", text)], "doc_id string, text string")
    paths = spark.createDataFrame([("d", "metadata.zz")], "doc_id string, field_path string")
    (row,) = qa.context_sections(data, paths).collect()
    assert row["sections"] == 1 and row["context"].endswith(text[8500:9000 + 4 + 300 + 8 + 500])


def test_verifier_budget(spark):
    rows = [("e", f"f{i:02d}", "x" * 90, 0.5, False, 1, "s") for i in range(60)]
    df = spark.createDataFrame(rows, "extraction_id string, field_path string, value string, c double, needs_review boolean, source_page int, source_text string").withColumn("confidence", F.col("c").cast("decimal(6,4)"))
    assert qa.verifier_candidates(df).count() == 60
    got = qa.verifier_candidates(df, max_chars=4000).collect()
    import json

    whole = json.dumps({"low_confidence_fields": [{"field_path": r["field_path"], "value": r["value"], "confidence": 0.5, "needs_review": False, "source_page": 1, "source_text": "s"} for r in got]})
    assert len(whole) == max(r["used"] for r in got) <= 4000 < len(whole) + len(whole) // len(got)


def test_overlay_and_expiry(spark):
    base = [("c", "p", "5.0", None, "base_agreement", "2024-01-01", 0), ("c", "p", "7.0", None, "addendum", "2025-01-01", 1), ("c", "p", "9.0", None, "amendment", "2025-01-01", 2), ("c", "p", "", None, "amendment", "2026-01-01", 3)]
    df = spark.createDataFrame(base, "company_key string, field_path string, value string, override string, doc_type string, eff string, o int").withColumn(
        "place", rs.document_place(F.col("eff"), F.col("doc_type"), F.col("o"))
    ).selectExpr("*", "concat('file', o) file_name", "0.9 confidence", "1 source_page", "'s' source_text")
    (row,) = rs.overlay_fields(df).collect()
    assert row["value"] == "9.0" and row["rationale"] == "Controlled by amendment file2"
    gone = rs.expire_fuel(spark.sql("select cast(8 as decimal(8,4)) discount_pct, '2025-01-31' expiration_date"), "2026-01-01").first()
    assert float(gone["discount_pct"]) == 0.0


def test_correction_keeps_provenance(spark):
    fields = spark.sql("select 'e' extraction_id, 'metadata.customer_name' field_path, 'Armoire LLC' value, cast(0.6 as decimal(6,4)) confidence, 1 source_page, 's' source_text")
    corr = spark.sql("select 'e' extraction_id, 'metadata.customer_name' field_path, 1 ord, 'ARMOIRE' corrected, 'why' reason, cast(null as string) rationale, 0.95 confidence, cast(null as int) source_page, '' source_text")
    row = qa.apply_corrections(fields, corr).first()
    assert (row["value"], row["original_parser_value"], float(row["confidence"]), row["source_text"], row["was_llm_corrected"]) == ("ARMOIRE", "Armoire LLC", 0.95, "s", True)


def test_amendment_payload_holds_the_terms_of_its_document(spark):
    found = spark.createDataFrame([(1, "A-1"), (3, "A-3")], "doc_id long, amendment_number string")
    services = spark.createDataFrame([(1, "Ground"), (1, "Air"), (2, "Ground")], "doc_id long, service_name string")
    dims = spark.createDataFrame([(1, 139.0)], "doc_id long, divisor double")
    got = {(r["amendment_number"], r["kind"], r["term"]) for r in asm.amendment_payload(found, services, services.where("false"), dims).collect()}
    assert got == {("A-1", "service_terms", '{"service_name":"Ground"}'), ("A-1", "service_terms", '{"service_name":"Air"}'), ("A-1", "dim_rules", '{"divisor":139.0}')}


def test_hits_hold_every_document_without_broadcast(spark, tmp_path):
    """Page texts unfold from small files, so neither they nor keys of documents may be broadcast."""
    text = "FedEx Priority Overnight\nZones => 2 3\n1 - 5 lbs 10% 11%\nUPS Ground\nZones => 2\n6 + lbs 7%\nMoney Back Guarantee. Claims within 15 days.\nNext"
    data = spark.createDataFrame([("a", 1, text), ("a", 2, "nothing"), ("b", 1, "nothing"), ("c", 1, text)], "doc_id string, page_number int, text string")
    zone = ("a", 1, 0, ["Zones =>", "2", "3"], [["1-5 lbs", "10%", "11%"]])
    fees = ("c", 1, 0, ["Name of Surcharge", "Application", "Zones", "Modification"], [["Peak", "All", "", "5%"], ["DIM", "Ground", "", "Divisor 139"]])
    tables = spark.createDataFrame([zone, fees, ("x", *fees[1:])], "doc_id string, page_number int, table_ord int, headers array<string>, rows array<array<string>>")
    small = []
    for name, df in (("pages", data), ("tables", tables)):
        df.write.parquet(f"{tmp_path}/{name}")
        small.append(spark.read.parquet(f"{tmp_path}/{name}"))
    got = asm.deterministic_hits(*small)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # a: one table (its service is that of the text above it), one other block, a provision twice; c: two blocks, two rows, a provision twice
    assert {r["doc_id"]: r["hits"] for r in got.collect()} == {"a": 4, "b": 0, "c": 6}
    assert "Broadcast" not in plan


def test_invoice_signals_search_a_text_once_for_each_pattern(spark):
    """Inside of a lambda Spark evaluates an unbound list again for every element, that is once a service."""
    text = "Invoice Number INV9\nInvoice Date today\n" + "\n".join(f"Home  Lane {c} Total Charges USD $1,0{i}0.50" for i, c in enumerate("ABA")) + "\nFuel Surcharge 12.34"
    found = tx.invoice_signals(spark.createDataFrame([("d", text), ("e", "Invoice Number X-1 Invoice Date Transportation Charges 88.10")], "doc_id string, full_text string"))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("d", "service", "Home Lane A", "Total Charges USD 1,000.50"), ("d", "service", "Home Lane B", "Total Charges USD 1,010.50"), ("d", "special", "Document Type", "Invoice"),
        ("d", "special", "Invoice Number", "INV9"), ("d", "surcharge", "Fuel Surcharge", "Observed amount 12.34"),
        ("e", "service", "UPS Transportation Charges", "Transportation Charges 88.10"), ("e", "special", "Document Type", "Invoice"), ("e", "special", "Invoice Number", "X-1"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2
