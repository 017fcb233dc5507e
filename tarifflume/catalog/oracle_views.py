"""The views of `plans.views` in SQL for the comparing engine, as WITH items."""

from __future__ import annotations

from tarifflume.functions.services import SERVICE_FRAGMENTS
from tarifflume.plans.views import FUEL_SERIES, WINDOWS

SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"

BASE = """base as (
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  cast(l_quantity as decimal(10,2)) qty, cast(l_extendedprice as decimal(12,2)) price,
  cast(l_discount as decimal(4,2)) disc, cast(l_tax as decimal(4,2)) tax,
  date '2024-01-01' + cast(datediff('day', date '1995-01-01', cast(l_shipdate as date)) % 820 as int) ship_date
from lineitem)"""

LINES = BASE + """, l0 as (
select *,
  cast(price * 0.001 as decimal(18,4)) published_charge,
  cast(price * 0.001 * (1 - disc) as decimal(18,4)) net_transport_charge,
  cast(cast(price * 0.001 * (0.08 + tax) as decimal(18,2)) as decimal(18,4)) fuel_surcharge_billed,
  cast(case when l_orderkey % 4 = 0 then 4.45 + 0.05 * (l_linenumber % 4) end as decimal(18,4)) residential_surcharge_billed,
  cast(case when l_partkey % 6 = 1 then 3.55 end as decimal(18,4)) das_billed,
  cast(case when l_partkey % 8 = 3 then 15.50 end as decimal(18,4)) ahs_billed,
  cast(case when l_partkey % 16 = 5 then 95.00 end as decimal(18,4)) large_package_billed,
  cast(case when l_orderkey % 9 = 2 then 17.50 + 0.25 * l_linenumber end as decimal(18,4)) address_correction_billed,
  case when l_suppkey % 2 = 0 then 'fedex' else 'ups' end carrier
from base), line as (
select *, l_suppkey agreement_id,
  l_orderkey::varchar || ':' || l_linenumber::varchar line_id,
  case when l_orderkey % 97 = 0 then 'Unknown' when l_orderkey % 101 = 0 then ' ' when l_orderkey % 7 = 3 then 'BULK-' || (l_orderkey % 5)::varchar else l_orderkey::varchar end tracking_number,
  l_orderkey::varchar transaction_id, 'INV-' || l_suppkey::varchar invoice_id,
  case when l_partkey % 11 <> 0 then ship_date + l_linenumber::int + to_hours(cast(8 + l_partkey % 11 as int)) + to_minutes(cast(l_orderkey % 60 as int)) end delivered,
  case when carrier = 'fedex' then ['fedex_ground','fedex_home_delivery','fedex_priority_overnight','fedex_2day','fedex_express_saver','fedex_ground_economy'][1 + l_partkey % 6]
    else ['ups_ground','ups_ground_saver','ups_next_day_air','ups_2nd_day_air','ups_3_day_select','ups_next_day_air_saver'][1 + l_partkey % 6] end service_code,
  case when carrier = 'fedex' then ['ground','home_delivery','express','express','express','ground_economy'][1 + l_partkey % 6]
    else ['ground','ground_saver','express','express','ground','express'][1 + l_partkey % 6] end service_group,
  'Service ' || (l_partkey % 6)::varchar service_or_charge_type,
  lpad((l_partkey * 37 % 100000)::varchar, 5, '0') destination_zip,
  cast(2 + l_partkey % 7 as int) zone,
  cast(qty * 1.7 as decimal(18,4)) actual_weight_lbs,
  cast(4.3 + l_partkey % 110 as decimal(18,4)) length,
  cast(3.1 + l_orderkey % 50 as decimal(18,4)) width,
  cast(2 + (l_partkey + l_orderkey) % 40 as decimal(18,4)) height,
  cast(ceil(qty * 1.7) + l_orderkey % 3 as decimal(18,4)) rated_weight_lbs,
  cast(0.5 + 0.1 * l_linenumber as decimal(18,4)) rate_per_lb,
  case when l_partkey % 5 <> 0 then published_charge end transport_charge,
  cast(case when l_partkey % 10 = 0 then published_charge * 0.12 when l_partkey % 10 = 1 then 0 end as decimal(18,4)) earned_discount_applied,
  cast(- published_charge * disc as decimal(18,4)) incentive_credit,
  cast(net_transport_charge + fuel_surcharge_billed + coalesce(residential_surcharge_billed, 0) + coalesce(das_billed, 0)
    + coalesce(ahs_billed, 0) + coalesce(large_package_billed, 0) + coalesce(address_correction_billed, 0) as decimal(18,4)) total_billed,
  case l_orderkey % 3 when 0 then true when 1 then false end is_residential,
  case l_orderkey % 13 when 0 then 'weather' when 1 then 'ADDRESS_ERROR' when 2 then 'damage' end exception_code
from l0)"""

AGREEMENTS = """agreement as (
select s_suppkey agreement_id, case when s_suppkey % 2 = 0 then 'fedex' else 'ups' end ag_carrier,
  case when s_suppkey % 10 = 9 then 'pending_review' when s_suppkey % 10 = 8 then 'rejected' else 'approved' end status,
  cast(case when s_suppkey % 5 = 4 then null else (s_suppkey % 4) * 5.5 end as decimal(6,2)) fuel_pct,
  case when s_suppkey % 3 = 0 then date '2025-06-30' end fuel_exp,
  cast(case when s_suppkey % 3 = 1 then 4.50 end as decimal(18,4)) res_fee,
  cast(case when s_suppkey % 3 <> 2 then 18.25 end as decimal(18,4)) addr_fee,
  s_suppkey % 6 = 5 waived,
  cast(case when s_suppkey % 4 = 2 then 10.75 else 13 end as decimal(18,4)) mnc_express,
  case s_suppkey % 3 when 0 then 166 when 1 then 139 else 194 end divisor,
  s_suppkey % 4 = 1 layered, s_suppkey % 8 <> 0 tiered, s_name, s_suppkey
from supplier)"""

FUEL = (
    "series(carrier, class, base_pct) as (values "
    + ", ".join(f"('{c}', '{k}', {b})" for c, k, b in FUEL_SERIES)
    + "), fuel_rate as (select carrier, class, date '2026-04-20' - cast(7 * i as int) week_start,"
    " cast(base_pct + ((i % 13) - 6) * 0.06 as decimal(6,2)) pct from range(104) t(i), series)"
)

SUSPENSION = "susp(carrier, s, e) as (values " + ", ".join(f"('{c}', date '{s}', date '{e}')" for c, s, e in WINDOWS) + ")"

# Federal holidays on or near a working day, written out for the ship dates of the views.
HOLIDAYS = [
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-11",
    "2024-11-28", "2024-12-25", "2025-01-01", "2025-01-20", "2025-02-17", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01",
    "2025-10-13", "2025-11-11", "2025-11-27", "2025-12-25", "2026-01-01", "2026-01-19", "2026-02-16", "2026-05-25", "2026-06-19",
    "2026-07-03", "2026-07-04",
]
CALENDAR = (
    "off(d) as (values " + ", ".join(f"(date '{h}')" for h in HOLIDAYS) + "), days as (select cast(d as date) d from "
    "generate_series(date '2023-12-01', date '2026-06-30', interval 1 day) t(d)), workday as (select d, row_number() over (order by d) n "
    "from days where isodow(d) < 6 and d not in (select d from off))"
)

ZIPS = """area as (
select c.carrier, lpad((p_partkey * 37 % 100000)::varchar, 5, '0') zip,
  arg_max(case when p_partkey % 2 = 0 then 'metro' else 'rural' end, p_partkey) tier
from part, (values ('fedex'), ('ups')) c(carrier)
where p_partkey % 3 <> 1 and (c.carrier = 'fedex' or p_partkey % 5 <> 0) group by all)"""

COMMITMENTS = (
    "commitment(service_code, n, by_time) as (values ('fedex_priority_overnight', 1, time '10:30:00'), ('fedex_2day', 2, time '16:30:00'), "
    "('fedex_express_saver', 3, time '16:30:00'), ('ups_next_day_air', 1, time '10:30:00'), ('ups_2nd_day_air', 2, null), "
    "('ups_3_day_select', 3, null), ('ups_next_day_air_saver', 1, time '15:00:00'))"
)


def service_case(text: str, carrier: str, part: int) -> str:
    """CASE over the fragments: part 0 gives the code, part 1 the group."""
    low = f"lower(trim(coalesce({text}, '')))"
    whens = " ".join(f"when contains({low}, '{frag}') then '{pair[part]}'" for frag, *pair in SERVICE_FRAGMENTS)
    default = ("ups_ground", "ground")[part], ("fedex_ground", "ground")[part]
    return (
        f"case when {low} = '' then null {whens} when {carrier} = 'ups' then '{default[0]}' when {carrier} = 'fedex' then '{default[1]}' end"
    )
