"""Agreement extraction over contract pages and page tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarifflume.catalog.registry import query
from tarifflume.operators import agreement_tables as at, agreement_text as tx, assembly as asm, sections as sc
from tarifflume.session import dealt
from tarifflume.sources import documents as docs

# ---------------------------------------------------------------- views (one SQL text for both engines)

_K, _P = "cast(k as string)", "cast(k % 60 as string)"
PAGE_ONE = f"""concat_ws(chr(10),
 case when k % 7 = 0 then 'FedEx Transportation Services Agreement Amendment' else 'Carrier Pricing Agreement' end,
 case k % 4 when 0 then concat('Customer Name: Acme', {_K}, ' LLC') when 1 then concat('Prepared for: Do not pay ', {_K}) when 2 then concat('Shipper - Blue Bird ', {_K}) else 'Submitted to: NORTH RIVER LLC' end,
 case k % 5 when 0 then concat('Account Number: AC', {_K}, '0001') when 1 then 'Account No. Invoice' when 2 then concat('Acct # ', {_K}, '77777') end,
 concat('Agreement Number(s): 1234567', lpad({_K}, 5, '0'), '-', lpad({_P}, 2, '0')),
 case when k % 3 <> 0 then concat('Version ', {_P}) end,
 case k % 6 when 0 then 'Effective Date: January 5, 2025' when 1 then 'effective on 3/14/2025' when 2 then 'Date Signed: 2025-02-01' end,
 case when k % 2 = 0 then 'FedEx rates apply' when k % 3 = 0 then 'UPS rates apply' else 'carrier rates apply' end,
 case when k % 8 = 3 then 'offer is void if not accepted by March 1, 2025' end,
 case k % 9 when 0 then 'Term: January 1, 2025 through December 31, 2026' when 1 then '1 Effective Date Does Not Expire' when 2 then 'shall remain in effect for 156 weeks' when 3 then 'see Exhibit B for the term' end,
 case k % 4 when 0 then 'Payment Terms: Net 30' when 1 then 'Payment is due within 15 days of receipt' when 2 then 'Payment Terms: on receipt' end,
 case when k % 10 = 4 then 'supersedes Version 3' end,
 'Special rules follow here.')"""
PAGE_TWO = f"""concat_ws(chr(10),
 'RATE SCHEDULE',
 case k % 3 when 0 then 'FedEx Priority Overnight' when 1 then 'Ground Domestic Single Piece (lbs)' else 'UPS Ground Commercial Package Incentives - Prepaid' end,
 'Zones => 2 3 4',
 concat('1 - 5 lbs ', {_P}, '% 11.5% 12%'),
 'All Applicable Weights 9%',
 case when k % 4 = 1 then 'Term details of the plan' end,
 '6 + lbs 7.5%',
 case when k % 5 = 0 then 'FedEx Express Saver' end,
 case when k % 5 = 0 then 'Zone => All Zones' end,
 case when k % 5 = 0 then 'Envelope 33%' end,
 case when k % 2 = 1 then concat('UPS Next Day Air™ Early - Fuel Surcharge - Incentives Off Effective Rates - ', {_P}, '.50%') end,
 case when k % 6 = 1 then concat('UPS Ground - DimensionalWeight', chr(10), 'Custom Dimensional Weight Divisor: ', cast(139 + k % 60 as string)) end,
 case when k % 6 = 5 then concat('UPS 2nd Day Air Saver', chr(10), 'Custom Cubic Inch Threshold 1728') end,
 case when k % 4 = 2 then concat('Money-Back Guarantee. Shipper agrees to waive all claims.', chr(10), chr(10)) end,
 case when k % 4 = 3 then concat('Money Back Guarantee. Claims within 15 days.', chr(10), 'Next') end,
 case when k % 7 = 2 then 'Payment Terms. Payment is due within the following number of days: 21' end,
 'Fuel Surcharge:',
 'A fuel surcharge is billed weekly and may be waived for residential delivery.')"""


# A part or customer is a few bytes of a file but pages and tables of a document, so the scan alone makes too few tasks.
SPREAD = 8


def _pages(t):
    part = t.spread_table("part", SPREAD).selectExpr("p_partkey k", "p_size z")
    return part.selectExpr("k doc_id", f"explode(array(named_struct('page_number', 1, 'text', {PAGE_ONE}), named_struct('page_number', 2, 'text', {PAGE_TWO}))) p").select("doc_id", "p.page_number", "p.text")


PAGES = f"""cp as (select k doc_id, page_number, case when page_number = 1 then {PAGE_ONE} else {PAGE_TWO} end "text" from (select p_partkey k, p_size z from part), (values (1), (2)) v(page_number))"""


def _tables(t):
    """Four tables per document: zone pricing, weight pricing, surcharges, earned discounts."""
    pct = "concat(cast(k % 60 as string), '.25%')"
    zone = f"""named_struct('page_number', 2, 'table_ord', 0, 'headers', case when k % 3 = 2 then array('Zones =>', 'All Zones') else array('Zones =>', '2', '3', '4') end,
      'rows', array(array('1-5 lbs', {pct}, '20%', case when k % 2 = 0 then '-' else '5 %' end), array('', '9%'), array(' 6+ lbs ', '', '21%', '22%', '23%')))"""
    ups = f"""named_struct('page_number', 2, 'table_ord', 1, 'headers', array(concat('Weight', chr(10), '(lbs)'), 'Zones', ''),
      'rows', array(array('', '2', '3'), array(concat('1-5', chr(10), '6-10'), concat({pct}, chr(10), '36.00%'), concat('n/a', chr(10), '41%')), array('', 'x', 'y')))"""
    fees = f"""named_struct('page_number', 1, 'table_ord', 0, 'headers', array('Name of Surcharge', 'Application', 'Zones', 'Modification'),
      'rows', array(array('Name of Surcharge', 'a', 'b', 'c'), array(concat('Residential', chr(10), 'Delivery'), 'Ground', '', {pct}), array('DIM', 'Ground', '', concat('Divisor ', cast(139 + k % 60 as string))), array('Dim Express', 'Air', '', 'none'), array('Fuel', 'All'), array('Peak', 'All', 'Zone 2', 'Waived')))"""
    earned = f"""named_struct('page_number', 1, 'table_ord', 1, 'headers', array(case when k % 2 = 0 then 'Grace Discount 4%' else 'Annualized' end, 'Earned', 'Discount'),
      'rows', array(array('Services', 'Threshold', 'Discount'), array(concat('Ground', chr(10), 'Home'), concat('0-100', chr(10), '101-200', chr(10), '201+'), concat('1%', chr(10), {pct})), array('Grace Discount 7.5%', '', ''), array('Express', '0-500', '')))"""
    part = t.spread_table("part", SPREAD).selectExpr("p_partkey k")
    return part.selectExpr("k doc_id", f"explode(array({zone}, {ups}, {fees}, {earned})) x").select("doc_id", "x.page_number", "x.table_ord", "x.headers", "x.rows")


_PCT = "(k % 60 + 0.25)::double"
KEYS = "ks as (select p_partkey k from part)"
# Service the zone table of a document sits under: the line above "Zones => 2 3 4" on page two.
_ABOVE = "case k % 3 when 0 then 'FedEx Priority Overnight' when 1 then 'Ground Domestic Single Piece (lbs)' else 'UPS Ground Commercial Package Incentives - Prepaid' end"


@query("e2_table_kinds", f"with {KEYS} select k doc_id, page_number, table_ord, kind from ks, (values (2, 0, 'zone'), (2, 1, 'ups_weight'), (1, 0, 'surcharge'), (1, 1, 'earned')) v(page_number, table_ord, kind)")
def _(t):
    return _tables(t).select("doc_id", "page_number", "table_ord", at.table_kind(F.col("headers")).alias("kind"))


@query(
    "e3_e9_zone_pricing",
    f"""with {KEYS}, c as (select k, unnest([{{'w': '1-5 lbs', 'c': 0, 'p': {_PCT}}}, {{'w': '1-5 lbs', 'c': 1, 'p': 20.0}}, {{'w': '1-5 lbs', 'c': 2, 'p': case when k % 2 = 0 then null else 5.0 end}}, {{'w': '6+ lbs', 'c': 1, 'p': 21.0}}, {{'w': '6+ lbs', 'c': 2, 'p': 22.0}}, {{'w': '6+ lbs', 'c': 3, 'p': 23.0}}]) x from ks)
 select k doc_id, case when k % 3 = 2 then case when k % 6 = 5 then 'UPS 2nd Day Air Saver' when k % 5 = 0 then 'FedEx Express Saver' else 'Unknown Service' end else {_ABOVE} end service_name, x.w weight_range,
 case when k % 3 = 2 then case x.c when 0 then 'All Zones' else 'zone_' || x.c::varchar end else case x.c when 0 then '2' when 1 then '3' when 2 then '4' else 'zone_3' end end "zone", x.p discount_pct, k % 3 = 2 is_all_zones from c where x.p is not null""",
)
def _(t):
    return at.zone_pricing(_tables(t), _pages(t)).select("doc_id", "service_name", "weight_range", "zone", "discount_pct", "is_all_zones")


@query(
    "e4_e10_ups_weight_pricing",
    f"""with {KEYS}, c as (select k, unnest([{{'w': '1-5', 'z': '2', 'p': {_PCT}}}, {{'w': '6-10', 'z': '2', 'p': 36.0}}, {{'w': '6-10', 'z': '3', 'p': 41.0}}]) x from ks)
 select k doc_id, case when k % 3 = 2 then 'UPS Ground Commercial Package' else 'UPS Service' end service_name, x.w weight_range, x.z "zone", x.p discount_pct from c""",
)
def _(t):
    return at.ups_weight_pricing(_tables(t), _pages(t)).select("doc_id", "service_name", "weight_range", "zone", "discount_pct")


@query(
    "e5_surcharge_rows",
    f"""with {KEYS} select k doc_id, n "name", a application, z applicable_zones, case when n = 'Peak' then 'Waived' else (k % 60)::varchar || '.25%' end modification from ks, (values ('Residential Delivery', 'Ground', 'All Zones'), ('Peak', 'All', 'Zone 2')) v(n, a, z)""",
)
def _(t):
    return at.surcharge_rows(_tables(t)).select("doc_id", "name", "application", "applicable_zones", "modification")


@query("e6_dim_rows", f"with {KEYS} select k doc_id, 'DIM' \"name\", (139 + k % 60)::double divisor, 'Ground' application from ks")
def _(t):
    return at.dim_rows(_tables(t)).select("doc_id", "name", "divisor", "application")


@query(
    "e7_earned_rows",
    f"""with {KEYS} select k doc_id, s services, case when r = 3 then 7.5 when k % 2 = 0 then 4.0 end::double grace_pct, case when r = 3 then '0-500=' else '0-100=1.0|101-200=' || (k % 60)::varchar || '.25|201+=' end tiers from ks, (values (1, 'Ground|Home'), (3, 'Express')) v(r, s)""",
)
def _(t):
    tiers = F.array_join(F.transform("tiers", lambda x: F.concat(x["threshold"], F.lit("="), F.coalesce(x["discount_pct"].cast("string"), F.lit("")))), "|")
    return at.earned_rows(_tables(t)).select("doc_id", F.array_join("services", "|").alias("services"), "grace_pct", tiers.alias("tiers"))


@query(
    "e8_service_headings",
    f"""with {PAGES} select doc_id, page_number, array_to_string(list_transform(regexp_extract_all("text", '(?m)^({'|'.join(at.SERVICE_HEADINGS)})\\s*$', 1), lambda x: trim(x, chr(10) || ' ')), '|') names from cp""",
)
def _(t):
    return _pages(t).select("doc_id", "page_number", F.array_join(at.service_names(F.col("text")), "|").alias("names"))


@query(
    "e11_incentive_rows",
    f"""with {KEYS} select k doc_id, 'UPS Next Day Air Early - Fuel Surcharge' "name", 'UPS Next Day Air Early' application, 'All Zones' applicable_zones, '- ' || (k % 60)::varchar || '.5%' modification from ks where k % 2 = 1""",
)
def _(t):
    return tx.incentive_rows(_pages(t)).select("doc_id", "name", "application", "applicable_zones", "modification")


@query(
    "e12_dim_specs",
    f"""with {KEYS} select k doc_id, 'DIM Divisor (UPS Ground)' "name", (139 + k % 60)::double divisor, 'UPS Ground' application from ks where k % 6 = 1
 union all select k, 'Cubic Inch Threshold (UPS 2nd Day Air Saver)', 1728, 'UPS 2nd Day Air Saver' from ks where k % 6 = 5""",
)
def _(t):
    return tx.dim_specs(_pages(t)).select("doc_id", "name", "divisor", "application")


@query(
    "e13_text_pricing",
    f"""with {KEYS}, c as (select k, unnest([{{'s': 1, 'w': '1 - 5 lbs', 'z': '2', 'p': (k % 60)::double}}, {{'s': 1, 'w': '1 - 5 lbs', 'z': '3', 'p': 11.5}}, {{'s': 1, 'w': '1 - 5 lbs', 'z': '4', 'p': 12.0}}, {{'s': 1, 'w': 'All Applicable Weights', 'z': '2', 'p': 9.0}},
  {{'s': 1, 'w': '6 + lbs', 'z': '2', 'p': case when k % 4 <> 1 then 7.5 end}}, {{'s': 2, 'w': 'Envelope', 'z': 'All Zones', 'p': case when k % 5 = 0 then 33.0 end}}]) x from ks)
 select k doc_id, case when x.s = 2 then 'FedEx Express Saver' else {_ABOVE} end service_name, x.w weight_range, x.z "zone", x.p discount_pct, x.s = 2 is_all_zones from c where x.p is not null""",
)
def _(t):
    return tx.text_pricing(_pages(t)).select("doc_id", "service_name", "weight_range", "zone", "discount_pct", "is_all_zones")


@query(
    "e14_provisions",
    f"""with {KEYS} select k doc_id, 2 page_number, 'Money-Back Guarantee' "name", case when k % 4 = 2 then 'Waived' else 'Claims within 15 days.' end "value" from ks where k % 4 in (2, 3) union all select k, 2, 'Payment Terms', 'Net 21 days' from ks where k % 7 = 2""",
)
def _(t):
    return tx.provisions(_pages(t)).select("doc_id", "page_number", "name", "value")


@query(
    "e15_terms_of_rows",
    f"""with {KEYS} select k doc_id, 'earned' kind, case when r = 1 then case when k % 2 = 0 then 'Grace Discount: 4.0%; ' else '' end || '0-100 → 1.0%; 101-200 → ' || (k % 60)::varchar || '.25%; 201+' else 'Grace Discount: 7.5%; 0-500' end "text", case when r = 1 then 'Applicable to: Ground, Home' else 'Applicable to: Express' end conditions, null::double pct from ks, (values (1), (3)) v(r)
 union all select k, 'dim', 'DIM', 'Standard', null from ks union all select k, 'surcharge', n, null, case when n = 'Peak' then null else (k % 60 + 0.25)::double end from ks, (values ('Residential Delivery'), ('Peak')) w(n)
 union all select k, 'pricing', x.w, case when k % 3 = 2 then 'All Zones' else case x.c when 0 then '2' when 1 then '3' when 2 then '4' else 'zone_3' end end, x.p
 from (select k, unnest([{{'w': '1-5 lbs', 'c': 0, 'p': {_PCT}}}, {{'w': '1-5 lbs', 'c': 1, 'p': 20.0}}, {{'w': '1-5 lbs', 'c': 2, 'p': case when k % 2 = 0 then null else 5.0 end}}, {{'w': '6+ lbs', 'c': 1, 'p': 21.0}}, {{'w': '6+ lbs', 'c': 2, 'p': 22.0}}, {{'w': '6+ lbs', 'c': 3, 'p': 23.0}}]) x from ks) where x.p is not null""",
)
def _(t):
    tables, none = _tables(t), F.lit(None)
    row = lambda df, kind, text, cond, pct: df.select("doc_id", F.lit(kind).alias("kind"), text.alias("text"), cond.cast("string").alias("conditions"), pct.cast("double").alias("pct"))
    pricing = at.pricing_terms(at.zone_pricing(tables, _pages(t)))
    return (
        row(at.earned_terms(at.earned_rows(tables)), "earned", F.col("term_value"), F.col("conditions"), none)
        .unionByName(row(at.dim_terms(at.dim_rows(tables)), "dim", F.col("name"), F.col("conditions"), none))
        .unionByName(row(at.surcharge_terms(at.surcharge_rows(tables)), "surcharge", F.col("name"), none, F.col("discount_percentage")))
        .unionByName(row(pricing, "pricing", F.substring("conditions", 9, 20), F.array_join("applicable_zones", ","), F.col("discount_pct")))
    )


@query("e16_assembled_service_terms")
def _(t):
    terms = asm.service_terms(_pages(t), _tables(t))
    return terms.select("doc_id", "page_number", "src_ord", "service_name", F.array_join("applicable_zones", "|").alias("zones"), "conditions", "discount_pct")


@query("e16_deterministic_hits")
def _(t):
    return asm.deterministic_hits(_pages(t), _tables(t))


# ---------------------------------------------------------------- whole documents


def _documents(t):
    return docs.full_text(_pages(t))


DOCS = f"""{PAGES}, doc as (select doc_id, doc_id k, string_agg('--- Page ' || page_number::varchar || ' ---' || chr(10) || "text", chr(10) || chr(10) order by page_number) x from cp group by 1)"""

_WORDS = """concat_ws(' ', case doc_id % 8 when 0 then 'FedEx Ground service guide' when 1 then 'United Parcel Service tariff groups' when 2 then 'UPS Freight tariff' when 3 then 'warehouse kitting with SLA and monthly minimum'
 when 4 then 'LTL class 50 reweigh bill of lading' when 5 then 'Invoice Number and Invoice Date' when 6 then 'statement of work only' end, text)"""


@query(
    "e1_vendor",
    f"""with d as (select doc_id, lower({_WORDS}) t from documents), s as (select doc_id,
 (case when contains(t, 'fedex') or contains(t, 'federal express') then 0.6 else 0 end + case when regexp_matches(t, '\\bfedex\\s+(express|ground|freight)\\b') then 0.25 else 0 end + case when contains(t, 'service guide') and contains(t, 'fedex') then 0.15 else 0 end) a,
 (case when contains(t, 'ups') or contains(t, 'united parcel service') then 0.6 else 0 end + case when regexp_matches(t, '\\bups\\s+(ground|air|freight)\\b') then 0.25 else 0 end + case when contains(t, 'tariff') and contains(t, 'ups') then 0.15 else 0 end) b,
 (case when regexp_matches(t, 'warehouse|pick and pack|pick/pack|kitting|storage fee|pallet in|pallet out|fulfillment|receiving|handling fee') then 0.65 else 0 end + case when regexp_matches(t, 'sla|service level agreement|order cutoff|same day shipping') then 0.2 else 0 end + case when regexp_matches(t, 'monthly minimum|minimum monthly') then 0.1 else 0 end) c,
 (case when regexp_matches(t, 'ltl|less-than-truckload|nmfc|class 50|class 55|class 60|class 65|class 70|class 77\\.5|class 85|class 92\\.5|class 100') then 0.55 else 0 end + case when regexp_matches(t, '\\b(fuel\\s+surcharge|accessorial|rebill|reweigh|reclass)\\b') then 0.25 else 0 end + case when regexp_matches(t, 'bill of lading|bol') then 0.1 else 0 end) d from d)
 select doc_id, case when greatest(a, b, c, d) = 0 then 'unknown' when a = greatest(a, b, c, d) then 'fedex' when b = greatest(a, b, c, d) then 'ups' when c = greatest(a, b, c, d) then '3pl' else 'freight' end vendor_type, greatest(a, b, c, d)::double confidence from s""",
)
def _(t):
    return sc.detect_vendor(t.table("documents").selectExpr("doc_id", f"{_WORDS} text")).select("doc_id", "vendor_type", F.col("confidence").cast("double").alias("confidence"))


@query(
    "e17_document_tests",
    f"""with d as (select doc_id, {_WORDS} t from documents), l as (select *, lower(t) h from d)
 select doc_id, (contains(t, 'Invoice Number') and contains(t, 'Invoice Date')) or contains(t, 'Delivery Service Invoice') likely_invoice,
 regexp_matches(h, 'statement of work|sow|scope of work|master services agreement|proposal|project plan') and not regexp_matches(h, 'pricing agreement|carrier agreement|service terms|surcharge|fedex|ups') non_contract from l""",
)
def _(t):
    rows = t.table("documents").selectExpr("doc_id", f"{_WORDS} x")
    return rows.select("doc_id", tx.likely_invoice(F.col("x")).alias("likely_invoice"), tx.likely_non_contract(F.col("x")).alias("non_contract"))


@query(
    "e18_invoice_signals",
    """with c as (select c_custkey k from customer where c_custkey % 3 <> 2) select k doc_id, 'special' kind, 'Document Type' "name", 'Invoice' "value" from c union all select k, 'special', 'Invoice Number', 'INV' || k::varchar from c
 union all select k, 'service', 'Home Lane ' || chr(65 + i::int), 'Total Charges USD 1,0' || i::varchar || '0.50' from c, range(7) r(i) where k % 3 = 0 union all select k, 'service', 'UPS Transportation Charges', 'Transportation Charges 88.10' from c where k % 3 = 1
 union all select k, 'special', 'Invoice Total', 'USD 512.00' from c where k % 2 = 0 union all select k, 'surcharge', 'Fuel Surcharge', 'Observed amount 12.34' from c where k % 5 = 0""",
)
def _(t):
    return tx.invoice_signals(_invoices(t))


def _invoices(t):
    lanes = "concat_ws(chr(10), transform(array(0, 1, 0, 2, 3, 4, 5, 6), i -> concat('Home  Lane ', chr(65 + i), ' Total Charges USD $1,0', cast(i as string), '0.50')))"
    body = f"""concat_ws(chr(10), case when k % 3 = 2 then 'Statement' else 'Invoice Date today' end, concat('Invoice Number INV', cast(k as string)), case when k % 3 = 0 then {lanes} end, case when k % 3 = 1 then 'Transportation Charges 88.10' end,
      case when k % 2 = 0 then 'Total This Invoice USD $512.00' end, case when k % 5 = 0 then 'Fuel Surcharge 12.34' end)"""
    return t.spread_table("customer", SPREAD).selectExpr("c_custkey k").selectExpr("k doc_id", f"{body} full_text")


@query(
    "e18_gated_terms",
    """with c as (select c_custkey k from customer where c_custkey % 3 <> 2 and c_custkey % 5 < 3)
 select k doc_id, 'special' kind, 'Document Type' "name", 'Invoice' "value" from c where k % 4 <> 0 union all select k, 'special', 'Invoice Number', 'INV' || k::varchar from c
 union all select k, 'service', 'Home Lane ' || chr(65 + i::int), 'Total Charges USD 1,0' || i::varchar || '0.50' from c, range(7) r(i) where k % 3 = 0 and not (k % 2 = 1 and i = 1) union all select k, 'service', 'UPS Transportation Charges', 'Transportation Charges 88.10' from c where k % 3 = 1
 union all select k, 'special', 'Invoice Total', 'USD 512.00' from c where k % 2 = 0 union all select k, 'surcharge', 'Fuel Surcharge', 'Observed amount 12.34' from c where k % 5 = 0
 union all select c_custkey, 'special', 'document type ', 'known' from customer where c_custkey % 4 = 0 union all select c_custkey, 'service', 'HOME LANE B', 'known' from customer where c_custkey % 2 = 1""",
)
def _(t):
    customers = t.spread_table("customer", SPREAD).selectExpr("c_custkey doc_id")
    signals = asm.gated_signals(_invoices(t), customers.selectExpr("doc_id", "doc_id % 5 hits"))
    services = customers.where("doc_id % 2 = 1").selectExpr("doc_id", "'HOME LANE B' service_name", "'known' conditions")
    specials = customers.where("doc_id % 4 = 0").selectExpr("doc_id", "'document type ' term_name", "'known' term_value")
    surcharges = customers.where("false").selectExpr("doc_id", "'' name", "'' modification")
    lists = zip(("service", "surcharge", "special"), asm.with_invoice_signals(services, surcharges, specials, signals))
    out = None
    for kind, rows in lists:
        part = rows.toDF("doc_id", "name", "value").select("doc_id", F.lit(kind).alias("kind"), "name", "value")
        out = part if out is None else out.unionByName(part)
    return out




@query(
    "e19_amendments",
    f"""with {KEYS} select k doc_id, '1234567' || lpad(k::varchar, 5, '0') || '-' || lpad((k % 60)::varchar, 2, '0') amendment_number, case when k % 10 = 4 then '3' when k % 60 > 1 then '1234567' || lpad(k::varchar, 5, '0') || '-' || lpad((k % 60 - 1)::varchar, 2, '0') else '1234567' || lpad(k::varchar, 5, '0') || ' (original)' end supersedes_version,
 case k % 6 when 0 then 'January 5, 2025' when 1 then '3/14/2025' when 2 then '2025-02-01' end effective_date from ks where k % 7 = 0""",
)
def _(t):
    return tx.amendments(_documents(t)).select("doc_id", "amendment_number", "supersedes_version", "effective_date")


@query(
    "e20_e27_metadata_fields",
    f"""with {KEYS}, m as (select k, case k % 4 when 0 then 'Acme' || k::varchar || ' LLC' when 1 then null when 2 then 'Blue Bird ' || k::varchar else 'NORTH RIVER LLC' end customer_name,
 case when k % 3 <> 0 then (k % 60)::varchar when k % 10 = 4 then '3' end version_number, case k % 6 when 0 then 'January 5, 2025' when 1 then '3/14/2025' when 2 then '2025-02-01' end ed,
 case when k % 2 = 0 or k % 3 = 0 or k % 5 = 0 or k % 7 = 0 then 'FedEx' else 'UPS' end carrier from ks)
 select k doc_id, customer_name, version_number, coalesce(ed, '') effective_date, carrier, case when k % 8 = 3 then 'March 1, 2025' end offer_expiration,
 case when k % 4 = 0 then 'Net 30 days' when k % 4 = 1 then 'Net 15 days' when k % 4 = 2 then 'on receipt' when k % 7 = 2 then 'Payment is due within the following number of days: 21 Fuel Surcharge: A fuel surcharge is billed weekly and may be waived for residential delivery.' end payment_terms,
 case k % 9 when 0 then 'January 1, 2025' when 1 then coalesce(ed, 'Effective Date') when 2 then ed when 3 then ed end term_start, case k % 9 when 0 then 'December 31, 2026' when 1 then 'Does Not Expire' when 2 then '156 weeks' end term_end from m""",
)
def _(t):
    m = tx.metadata(_documents(t))
    value = lambda c: F.col(f"{c}.value").alias(c)
    return m.select(
        "doc_id", value("customer_name"), value("version_number"), F.coalesce("effective_date.value", F.lit("")).alias("effective_date"), value("carrier"), value("offer_expiration"),
        value("payment_terms"), value("term_start"), value("term_end"),
    )


_IDENTIFIERS = """concat('Rates: ', k, chr(10),
 case k % 4 when 0 then concat('Account Number: AB', k, '7788', chr(10)) when 1 then concat('Acct # 99', k, '1234', chr(10)) when 2 then concat('List of Account Numbers', chr(10), repeat(concat('a (b) c;', chr(10)), 20 + k % 500), 'ZX', k, '40 ACME SHIPPING CO', chr(10)) else '' end,
 case k % 3 when 0 then concat('Agreement No. PA-', k, '-x', chr(10)) when 1 then concat('Contract #: C', k, chr(10)) else concat('signed P123456789-0', k % 10, ' (UPS)', chr(10)) end,
 case k % 5 when 0 then concat('Applicable Services: Ground and Air, daily  pickup', chr(10), 'for all (b) of ', k, chr(10)) when 1 then concat('the following services: ', repeat('a (b) c; ', 5 + k % 700), chr(10)) else '' end,
 'Payment Terms: (net)')"""


@query(
    "e22_e23_e27_identifiers",
    f"""with d as (select o_orderkey k, {_IDENTIFIERS} x from orders),
 hit as (select k, x, coalesce(nullif(regexp_extract(x, '(?i)Account\\s*(?:Number|#|No\\.?)\\s*[:\\-]?\\s*([A-Z0-9\\-]{{6,20}})', 1), ''), nullif(regexp_extract(x, '(?i)Acct\\s*(?:No\\.?|#)\\s*[:\\-]?\\s*([A-Z0-9\\-]{{6,20}})', 1), ''),
  nullif(regexp_extract(x, '(?i)(?:^|\\n)\\s*([A-Z0-9]{{6,12}})\\s+[A-Z0-9&.,''\\- ]{{3,}}\\n', 1), ''), nullif(regexp_extract(x, '(\\d{{9,12}})\\s*-\\s*\\d{{2,3}}', 1), ''), nullif(regexp_extract(x, '([\\dA-Z]{{10,11}})\\s+[A-Z\\-]', 1), '')) account, regexp_extract(x, '(?is)\\bApplicable\\s+Services\\s*[:\\.]?\\s*(.*?)\\n[ \\t]*Payment\\s+Terms\\b', 1) named,
  regexp_extract(x, '(?is)\\bthe\\s+following\\s+services?\\b[\\s:,-]+(.{{40,}}?)\\n[ \\t]*Payment\\s+Terms\\b', 1) listed from d),
 squeezed as (select *, trim(regexp_replace(case when contains(x, 'Applicable Services') then named else listed end, '\\s+', ' ', 'g')) services from hit)
 select k doc_id, case when length(account) >= 6 and regexp_matches(account, '\\d') then account end account_number, coalesce(nullif(regexp_extract(x, '(?i)Agreement\\s*(?:Number|#|No\\.?)\\s*[:\\-]?\\s*([\\w\\-]+)', 1), ''), nullif(regexp_extract(x, '(?i)Contract\\s*(?:Number|#|No\\.?)\\s*[:\\-]?\\s*([\\w\\-]+)', 1), ''), nullif(regexp_extract(x, '(P\\d{{9,12}}-\\d{{2}})', 1), '')) agreement_number,
 case when length(services) >= 25 then length(services) end services_chars, case when length(services) >= 25 then md5(services) end services_digest from squeezed""",
)
def _(t):
    """Accounts far behind their title and services clauses of any length."""
    m = tx.metadata(t.table("orders").selectExpr("o_orderkey k").selectExpr("k doc_id", f"{_IDENTIFIERS} full_text"))
    services = F.col("applicable_services.value")
    return m.select("doc_id", F.col("account_number.value").alias("account_number"), F.col("agreement_number.value").alias("agreement_number"), F.length(services).alias("services_chars"), F.md5(services).alias("services_digest"))


@query("e21_e23_long_metadata")
def _(t):
    return tx.metadata_rows(tx.metadata(_documents(t)))


@query(
    "e28_layout_blocks",
    r"""with p as (select doc_id, doc_id % 3 pn, 'ZONE RATES' || chr(10) || "text" || chr(10) || '----' || chr(10) || '2.1 Fees and more' || chr(10) || 'notes:' || chr(10) || 'one line' || chr(10) || ' two ' || chr(10) || chr(10) || 'three' x from documents),
 l0 as (select doc_id, pn, unnest(string_split(x, chr(10))) raw, generate_subscripts(string_split(x, chr(10)), 1) - 1 n from p), l1 as (select *, regexp_replace(raw, '^\s+|\s+$', '', 'g') t from l0),
 l2 as (select *, t = '' or regexp_matches(t, '^[-=]{4,}$') gap, length(t) >= 3 and (regexp_matches(t, '^\d+(\.\d+)*\s+[A-Z]') or (regexp_matches(t, '^[A-Z][A-Z0-9\s\-&/,\.]{2,60}$') and length(t) <= 80) or (regexp_matches(t, '^.{5,}:$') and length(t) <= 80)) h from l1),
 l3 as (select *, sum((gap or h)::int) over (partition by doc_id order by n) isl from l2) select doc_id, pn page_number, min(n) block_no, case when h then 'header' else 'paragraph' end block_type, string_agg(t, ' ' order by n) "text" from l3 where not gap group by doc_id, pn, isl, h""",
)
def _(t):
    return sc.layout_blocks(_ocr_pages(t)).select("doc_id", "page_number", "block_no", "block_type", "text")


def _ocr_pages(t):
    body = "concat('ZONE RATES\\n', text, '\\n----\\n2.1 Fees and more\\nnotes:\\none line\\n two \\n\\nthree')"
    return t.table("documents").selectExpr("doc_id", "doc_id % 3 page_number", f"{body} text")


def _block_rows(t):
    """Blocks of long documents: one document per customer, one page per order, one block per line."""
    lines = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey doc_id", "l_orderkey page_number", "l_linenumber block_no", "l_partkey")
    return dealt(lines, "doc_id", "page_number").groupBy("doc_id", "page_number", "block_no").agg(F.min("l_partkey").alias("p")).selectExpr(
        "doc_id", "page_number", "block_no", "case when p % 5 = 0 then 'header' else 'paragraph' end block_type",
        "array('Rate Schedule zone', 'Fuel surcharge waived', 'governing law and indemnification', 'whereas the recitals', 'Ground discount 5% off', 'plain words', 'Residential delivery DAS', 'base rate per pound')[cast((p + block_no) % 8 as int)] text")


BLOCKS = """bl as (select o_custkey doc_id, l_orderkey page_number, l_linenumber block_no, min(l_partkey) p from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3),
 b as (select doc_id, page_number, block_no, p % 5 = 0 h, ['Rate Schedule zone', 'Fuel surcharge waived', 'governing law and indemnification', 'whereas the recitals', 'Ground discount 5% off', 'plain words', 'Residential delivery DAS', 'base rate per pound'][1 + (p + block_no) % 8] t from bl)"""


@query(
    "e29_repeated_headers",
    f"with {BLOCKS} select doc_id, page_number, block_no, case when h and row_number() over (partition by doc_id, h, t order by page_number, block_no) = 1 then 'header' else 'paragraph' end block_type from b",
)
def _(t):
    return sc.downgrade_repeats(_block_rows(t)).select("doc_id", "page_number", "block_no", "block_type")


SECTIONS = f"""{BLOCKS}, n as (select *, sum(h::int) over (partition by doc_id order by page_number, block_no) s from b),
 g as (select doc_id, s section_no, max(case when h then t end) title, min(page_number) page_start, max(page_number) last_page, string_agg(case when not h then t end, chr(10) order by page_number, block_no) content from n group by 1, 2),
 sec as (select *, coalesce(lead(page_start) over (partition by doc_id order by section_no), last_page) page_end from g)"""


@query("e30_e38_sections", f"with {SECTIONS} select doc_id, section_no::bigint section_no, title, page_start, page_end, coalesce(content, '') content from sec")
def _(t):
    return sc.sections(_block_rows(t)).select("doc_id", "section_no", "title", "page_start", "page_end", "content")


def _wording_sql(col: str, kind: str) -> str:
    case = lambda p, w: "case when regexp_matches(" + col + ", '" + p + "') then " + str(w) + " else 0 end"
    return " + ".join(case(p, w) for p, w in sc.SECTION_WORDING[kind])


@query(
    "e31_e39_section_types",
    f"with {SECTIONS}, "
    + "sco as (select *, " + ", ".join(f"({_wording_sql('coalesce(content, ' + chr(39) * 2 + ')', k)}) + 2 * ({_wording_sql('coalesce(title, ' + chr(39) * 2 + ')', k)}) s_{k}" for k in sc.SECTION_WORDING) + " from sec), "
    + "bst as (select *, greatest(s_pricing, s_surcharge, s_terms, s_boilerplate) m from sco) select doc_id, section_no::bigint section_no, case when m < 2 then 'unknown' when s_pricing = m then 'pricing' when s_surcharge = m then 'surcharge' when s_terms = m then 'terms' else 'boilerplate' end section_type, case when m < 2 then 0 else least(m * 0.1, 1) end::double confidence from bst where m >= 2",
)
def _(t):
    classified = sc.classify_sections(sc.sections(_block_rows(t)))
    typed = sc.sections_of_type(classified, "pricing", "surcharge", "terms", "boilerplate")
    return typed.select("doc_id", "section_no", "section_type", F.col("confidence").cast("double").alias("confidence"))


# Real texts, 64 pages to a document: headers in its first half only, so the second half is one long group.
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CHUNKS = f"""with recursive pg as (select doc_id // 64 d, (doc_id % 64)::int n, case when doc_id % 64 < 32 and doc_id % 5 = 0 then 'SECTION A' || chr(10) else '' end || coalesce(text, '') t from documents),
 hd as (select d, n, chr(10) || chr(10) || '--- Page ' || n::varchar || ' ---' || chr(10) || t b,
  list_filter(list_transform(string_split({_TRIM.format("t")}, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: regexp_matches(x, '(?i)^(SECTION|ARTICLE|PART|SCHEDULE|EXHIBIT|APPENDIX|AMENDMENT)\\s') or regexp_matches(x, '^\\d+\\.\\s+[A-Z]') or regexp_matches(x, '^[A-Z][A-Z\\s]{{5,}}$'))[1] h from pg),
 gr as (select *, sum((h is not null and n > f)::int) over (partition by d order by n) g from (select *, min(n) over (partition by d) f from hd)),
 sz as (select *, sum(size) over (partition by d order by g) upto from (select d, g, sum(length(b)) size from gr group by 1, 2)),
 nx as (select a.d, a.g, min(b.g) z from sz a join sz b on b.d = a.d and b.g > a.g and b.upto - a.upto + a.size >= 6000 group by 1, 2),
 st as (select d, 0::hugeint g from sz where g = 0 union all select nx.d, nx.z from st join nx on nx.d = st.d and nx.g = st.g),
 cn as (select gr.*, (select count(*) from st where st.d = gr.d and st.g <= gr.g) - 1 c from gr),
 ch as (select d, c, {_TRIM.format("string_agg(b, '' order by n)")} t, string_agg(n::varchar, ',' order by n) p, arg_min(h, n) filter (where h is not null and g = g0) h from (select *, min(g) over (partition by d, c) g0 from cn) group by 1, 2),
 pa as (select d, c, unnest(string_split(t, chr(10) || chr(10))) x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) i from ch where length(t) > 10000),
 ps as (select *, sum(length(x) + 2) over (partition by d, c order by i) upto from pa),
 pn as (select a.d, a.c, a.i, min(b.i) z from ps a join ps b on b.d = a.d and b.c = a.c and b.i > a.i and b.upto - 2 - a.upto + length(a.x) + 2 > 6000 group by 1, 2, 3),
 pt as (select d, c, i from ps where i = 1 union all select pn.d, pn.c, pn.z from pt join pn on pn.d = pt.d and pn.c = pt.c and pn.i = pt.i),
 pr as (select d, c, k, {_TRIM.format("string_agg(x, chr(10) || chr(10) order by i)")} t from (select ps.*, (select count(*) from pt where pt.d = ps.d and pt.c = ps.c and pt.i <= ps.i) k from ps) group by 1, 2, 3),
 al as (select d, c, 0 part, t, p, h from ch where length(t) <= 10000 union all select pr.d, pr.c, row_number() over (partition by pr.d, pr.c order by k) - 1, pr.t, p, h from pr join ch on ch.d = pr.d and ch.c = pr.c where pr.t <> '')
 select d doc_id, c chunk, part, length(t) chars, md5(t) digest, p pages, h section_header from al"""


@query("e32_chunks", CHUNKS)
def _(t):
    pages = t.table("documents").selectExpr(
        "doc_id div 64 doc_id", "cast(doc_id % 64 as int) page_number", "concat(case when doc_id % 64 < 32 and doc_id % 5 = 0 then 'SECTION A\\n' else '' end, coalesce(text, '')) text"
    )
    return sc.chunks(pages).select(
        "doc_id", "chunk", "part", F.length("text").alias("chars"), F.md5("text").alias("digest"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "section_header"
    )


@query(
    "e33_merged_terms",
    "with known as (select o_custkey % 500 doc_id, ['Ground', 'Air', ''][1 + o_orderkey % 3] n, o_orderkey from orders where o_orderkey % 2 = 0), prop as (select o_custkey % 500 doc_id, ['Ground', 'Home', '', 'ground'][1 + o_orderkey % 4] n, o_orderkey from orders where o_orderkey % 2 = 1) select doc_id, n service_type, o_orderkey from known union all select doc_id, n, o_orderkey from prop where n <> '' and (doc_id, n) not in (select (doc_id, n) from known)".replace("(doc_id, n) not in (select (doc_id, n) from known)", "not exists (select 1 from known where known.doc_id = prop.doc_id and known.n = prop.n)"),
)
def _(t):
    known = t.table("orders").where("o_orderkey % 2 = 0").selectExpr("o_custkey % 500 doc_id", "array('Ground', 'Air', '')[cast(o_orderkey % 3 as int)] service_type", "o_orderkey")
    proposed = t.table("orders").where("o_orderkey % 2 = 1").selectExpr("o_custkey % 500 doc_id", "array('Ground', 'Home', '', 'ground')[cast(o_orderkey % 4 as int)] service_type", "o_orderkey")
    return asm.merge_by_name(known, proposed, "service_type")


@query(
    "e34_proposed_fields",
    """select o_orderkey doc_id, 'metadata' entity, null::int ord, 'carrier' field_name, 'FedEx' "value", 0.75::double confidence from orders union all select o_orderkey, 'metadata', null, 'version_number', o_custkey::varchar, 0.5::double from orders union all select o_orderkey, 'metadata', null, 'term_end', null, 0.0::double from orders
 union all select o_orderkey, 'service_terms', i::int, f, case when f = 'service_type' then 'S' || i::varchar when f = 'discount_percentage' and i = 0 then o_custkey::varchar end, case when f = 'service_type' then 0.5 when f = 'discount_percentage' and i = 0 then 0.9 else 0.0 end::double from orders, range(2) r(i), (values ('service_type'), ('applicable_zones'), ('discount_percentage'), ('base_rate_adjustment'), ('conditions'), ('effective_date')) v(f)""",
)
def _(t):
    body = """concat('{"metadata": {"carrier": {"value": "FedEx", "confidence": 0.75}, "version_number": ', cast(o_custkey as string), ', "term_end": null, "other": 1}, "service_terms": [{"service_type": "S0", "discount_percentage": {"value": ', cast(o_custkey as string), ', "confidence": 0.9}}, {"service_type": "S1"}]}')"""
    return asm.proposed_fields(t.table("orders").selectExpr("o_orderkey doc_id", f"{body} body")).select("doc_id", "entity", "ord", "field_name", "value", "confidence")


@query("e35_extraction_stats")
def _(t):
    pages, tables = _pages(t), _tables(t)
    meta = tx.metadata(_documents(t))
    return asm.extraction_stats(
        tx.metadata_rows(meta), asm.service_terms(pages, tables), asm.surcharge_terms(pages, tables), asm.dim_terms(pages, tables), asm.special_terms(pages, tables, meta)
    )


@query(
    "e36_row_maps",
    "select c_custkey doc_id, 1 row_ord, 'b' || c_custkey::varchar dup, 'c' col_2 from customer union all select c_custkey, 0, 'h', null from customer",
)
def _(t):
    tables = t.table("customer").selectExpr("c_custkey doc_id", "1 page_number", "0 table_ord", "array('x', 'x', cast(null as string), 'extra') headers", "array(array('h'), array('a', concat('b', cast(c_custkey as string)), 'c')) rows")
    return at.row_maps(tables).select("doc_id", "row_ord", F.col("cells")["x"].alias("dup"), F.col("cells")["col_2"].alias("col_2"))


@query(
    "e37_pages_with_tables",
    "select c_custkey doc_id, c_custkey % 2 = 0 has_tables, 'text' || c_custkey::varchar || case when c_custkey % 2 = 0 then chr(10) || chr(10) || '[TABLE on page 1]' || chr(10) || 'a | b' || chr(10) || '-----' || chr(10) || '1 | ' || c_custkey::varchar else '' end \"text\" from customer",
)
def _(t):
    pages = t.table("customer").selectExpr("c_custkey doc_id", "1 page_number", "concat('text', cast(c_custkey as string)) text")
    tables = t.table("customer").where("c_custkey % 2 = 0").selectExpr("c_custkey doc_id", "1 page_number", "0 table_ord", "array('a', 'b') headers", "array(array('1', cast(c_custkey as string))) rows")
    return at.pages_with_tables(pages, tables).select("doc_id", "has_tables", "text")
