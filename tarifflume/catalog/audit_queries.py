"""Line checks and audit rollups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarifflume.catalog import oracle_views as ov
from tarifflume.catalog.registry import query
from tarifflume.operators import checks as ck, maintenance as mt, rollups as ru
from tarifflume.session import written_folder
from tarifflume.sources import extractions as ex

JOINED = "j as (select line.*, a.* exclude (agreement_id) from line join agreement a using (agreement_id) where a.status = 'approved')"


def _only(views, check: str):
    """Findings of one check, with just the joins it needs."""
    enriched = ck.enrich(views.invoice_line, views.approved, checks=[check], **views.reference)
    found = ck.run_checks(enriched, [check])
    return found.selectExpr(
        "agreement_id", "line_id", "cast(line_seq.l_partkey as bigint) part_key", "date_format(ship_date, 'yyyy-MM-dd') ship_day", "discrepancy_type",
        "cast(expected_value as double) expected_value", "cast(billed_value as double) billed_value", "cast(dollar_impact as double) dollar_impact",
    )


OUT = """agreement_id, line_id, cast(l_partkey as bigint) part_key, strftime(ship_date, '%Y-%m-%d') ship_day, kind discrepancy_type,
cast(expected as double) expected_value, cast(billed as double) billed_value, cast(impact as double) dollar_impact"""


def _sql(body: str, *extra: str) -> str:
    return "with " + ", ".join([ov.LINES, ov.AGREEMENTS, JOINED, *extra]) + ", f as (" + body + f") select {OUT} from f"


DUP = """select *, 'overcharge' kind, cast(0 as decimal(18,4)) expected, total_billed billed, cast(total_billed as decimal(18,2)) impact from (
  select *, row_number() over (partition by agreement_id, trim(tracking_number), ship_date order by {seq}) k from line
  where trim(tracking_number) <> '' and lower(trim(tracking_number)) <> 'unknown') where k > 1 and total_billed > 0""".format(seq=ov.SEQ)

GSR = """select j.*, due.d promised, c.by_time, 'overcharge' kind, cast(0 as decimal(18,4)) expected, total_billed billed, cast(total_billed as decimal(18,2)) impact
from j join commitment c using (service_code)
join lateral (select count(*) k from workday w where w.d <= j.ship_date) before on true
join workday due on due.n = before.k + c.n
where not (waived and service_group = 'express') and delivered is not null
  and coalesce(lower(exception_code), '') not in ('weather','address_error','business_closed','recipient_unavailable','customs_delay')
  and not exists (select 1 from susp where susp.carrier = j.ag_carrier and j.ship_date between s and e)
  and (cast(delivered as date) > due.d or (cast(delivered as date) = due.d and cast(delivered as time) > c.by_time))"""
# The lateral count is written as a join on distinct ship dates to keep it linear.
GSR = GSR.replace(
    "join lateral (select count(*) k from workday w where w.d <= j.ship_date) before on true",
    "join (select s.ship_date, count(w.d) k from (select distinct ship_date from line) s left join workday w on w.d <= s.ship_date group by 1) before using (ship_date)",
)

REVENUE = """weekly as (select agreement_id, date_trunc('week', ship_date) w,
   sum(case when carrier = 'ups' then coalesce(nullif(published_charge, 0), transport_charge, 0) + coalesce(residential_surcharge_billed, 0) + coalesce(das_billed, 0)
       else coalesce(nullif(transport_charge, 0), published_charge, 0) end) amount from j group by all),
 revenue as (select agreement_id, round(cast(sum(amount) * 52 as double) / count(w), 2) rolling from weekly group by 1)"""

EARNED = """select *, case when layered then 'missing_discount' when due - applied > 0 then 'missing_discount' else 'undercharge' end kind,
  case when layered then lexp else due end expected, case when layered then net_transport_charge else applied end billed,
  case when layered then round(net_transport_charge - lexp, 2) else round(due - applied, 2) end impact
from (select *, cast(round(cast(gross * pct as decimal(28,8)) * 0.01, 2) as decimal(18,4)) due,
    cast(round(cast(cast(published_charge * (100 - base_pct) as decimal(24,8)) * (100 - tpct) as decimal(30,10)) * 0.0001, 2) as decimal(18,4)) lexp
  from (select j.*, rolling, coalesce(nullif(transport_charge, 0), published_charge) gross,
      abs(coalesce(nullif(earned_discount_applied, 0), nullif(incentive_credit, 0), 0)) applied,
      cast(case when not tiered then null
        when rolling < 25000 then case service_code when 'fedex_ground' then 5 when 'ups_ground' then 4 else 0 end
        when rolling < 60000 then case service_code when 'fedex_ground' then 8 when 'fedex_2day' then 12 when 'ups_ground' then 6 else 0 end
        else case service_code when 'fedex_ground' then 11 when 'fedex_2day' then 15 when 'ups_ground' then 9 when 'ups_2nd_day_air' then 20 else 0 end end as decimal(6,2)) pct,
      cast(case when service_code in ('ups_2nd_day_air', 'ups_3_day_select') then 40.25
        when service_code in ('ups_ground', 'ups_ground_saver', 'ups_next_day_air_saver') then case when zone = 2 then 31.5 when zone = 8 then 12 when rated_weight_lbs <= 10 then 20 when rated_weight_lbs <= 50 then 25 else 30.5 end
        else 0 end as decimal(6,2)) base_pct,
      cast(case service_code when 'ups_ground' then 3.5 when 'ups_2nd_day_air' then 10 else 0 end as decimal(6,2)) tpct
    from j join revenue using (agreement_id)))
where case when layered and published_charge > 0 then net_transport_charge > 0 and lexp > 0 and round(net_transport_charge - lexp, 2) > 0.05
  else tiered and gross <> 0 and abs(gross * pct - applied * 100) >= gross * 0.1 end"""

DIM = """select *, case when rated_weight_lbs > expected then 'overcharge' else 'undercharge' end kind, rated_weight_lbs billed,
  round(cast(rated_weight_lbs - expected as decimal(12,4)) * cast(rate_per_lb as decimal(12,4)), 2) impact
from (select *, greatest(actual_weight_lbs, cast(dimlb as decimal(18,4)), case when ag_carrier = 'fedex' and ceil(greatest(length, width, height)) > 48 then 40 else 0 end) expected
  from (select *, cast(ceil(length) * ceil(width) * ceil(height) as bigint) // divisor + case when cast(ceil(length) * ceil(width) * ceil(height) as bigint) % divisor > 0 then 1 else 0 end dimlb from j))
where abs(rated_weight_lbs - expected) >= 0.5"""

FUEL = """select *, 'overcharge' kind, fuel_surcharge_billed billed, fuel_surcharge_billed - expected impact
from (select k.*, r.pct rate, case when fuel_exp is not null and ship_date > fuel_exp then 0 else fuel_pct end in_force, cast(round(cast((case when ag_carrier = 'fedex' then net_transport_charge else published_charge end) as decimal(14,4))
     * (r.pct * (100 - case when fuel_exp is not null and ship_date > fuel_exp then 0 else fuel_pct end)) * 0.0001, 2) as decimal(18,4)) expected
  from (select *, case when service_group in ('ground','home_delivery','ground_saver') then 'ground' when ag_carrier = 'ups' then 'air' else 'express' end class from j) k
  asof join fuel_rate r on r.carrier = k.ag_carrier and r.class = k.class and k.ship_date >= r.week_start where fuel_pct is not null)
where fuel_surcharge_billed - expected > 0.02"""

MNC = """select *, 'overcharge' kind, net_transport_charge billed, round(net_transport_charge - expected, 2) impact
from (select *, case service_group when 'ground' then 8.25 when 'express' then mnc_express end expected,
   case when service_group = 'ground' then 11.00 when service_group = 'express' then 12.50 end published from j)
where expected < published and abs(net_transport_charge - published) < 0.05"""

RES = """select *, case when not is_residential then 'unsupported_fee' when billed > expected then 'overcharge' else 'undercharge' end kind, billed - expected impact
from (select *, residential_surcharge_billed billed, case when is_residential = false then cast(0 as decimal(18,4)) else res_fee end expected from j)
where billed > 0 and (is_residential = false or abs(billed - expected) > 0.02)"""

SIDES = """select *, list_sort([ceil(length), ceil(width), ceil(height)]) d, d[3] hi, d[2] mid, 2 * (d[2] + d[1]) girth from j"""
AHS = f"""select *, 'unsupported_fee' kind, cast(0 as decimal(18,4)) expected, ahs_billed billed, ahs_billed impact from ({SIDES})
where ahs_billed > 0 and not (case when ag_carrier = 'fedex' then hi > 48 or mid > 30 or actual_weight_lbs > 70 else hi > 48 or actual_weight_lbs > 70 or hi + girth > 105 end)"""
LPS = f"""select *, 'unsupported_fee' kind, cast(0 as decimal(18,4)) expected, large_package_billed billed, large_package_billed impact from ({SIDES})
where large_package_billed > 0 and not (hi + girth > 165 or hi > case when ag_carrier = 'fedex' then 96 else 108 end)"""
ADDR = """select *, case when billed > expected then 'overcharge' else 'undercharge' end kind, billed - expected impact
from (select *, address_correction_billed billed, addr_fee expected from j) where billed > 0 and abs(billed - expected) > 0.02"""
DAS = """select *, 'unsupported_fee' kind, cast(0 as decimal(18,4)) expected, das_billed billed, das_billed impact from j
where das_billed > 0 and not exists (select 1 from area z where z.carrier = j.ag_carrier and z.zip = j.destination_zip)"""

# name of the check -> (query name, finding SQL, extra WITH items)
LINE_SQL = {
    "guarantee": ("a2_late_delivery_guarantee", GSR, [ov.SUSPENSION, ov.CALENDAR, ov.COMMITMENTS]),
    "earned": ("a3_a4_earned_discount", EARNED, [REVENUE]),
    "dim": ("a5_dim_rated_weight", DIM, []),
    "fuel": ("a6_fuel_surcharge", FUEL, [ov.FUEL]),
    "minimum": ("a7_minimum_net_charge", MNC, []),
    "residential": ("a8_residential_fee", RES, []),
    "handling": ("a9_additional_handling", AHS, []),
    "large": ("a10_large_package", LPS, []),
    "address": ("a11_address_correction", ADDR, []),
    "area": ("a12_area_surcharge", DAS, [ov.ZIPS]),
}
for _check, (_name, _body, _extra) in LINE_SQL.items():
    query(_name, _sql(_body, *_extra))(lambda t, c=_check: _only(t, c))


@query("a1_duplicate_billing", _sql(DUP.replace("from line\n", "from j\n")))
def _(t):
    lines = t.invoice_line.join(t.approved.select("agreement_id"), "agreement_id", "left_semi")
    return ck.duplicate_findings(lines).selectExpr(
        "agreement_id", "line_id", "cast(line_seq.l_partkey as bigint) part_key", "date_format(ship_date, 'yyyy-MM-dd') ship_day", "discrepancy_type",
        "cast(expected_value as double) expected_value", "cast(billed_value as double) billed_value", "cast(dollar_impact as double) dollar_impact",
    )


@query(
    "a6a_fuel_rate_as_of",
    f"with {ov.LINES}, {ov.FUEL}, k as (select *, case when service_group in ('ground','home_delivery','ground_saver') then 'ground' when carrier = 'ups' then 'air' else 'express' end class from line)"
    " select k.carrier, k.class, strftime(k.ship_date, '%Y-%m-%d') ship_day, cast(r.pct as double) fuel_rate_pct, count(*) line_count from k"
    " asof left join fuel_rate r on r.carrier = k.carrier and r.class = k.class and k.ship_date >= r.week_start group by all",
)
def _(t):
    keyed = ck.attach_fuel_rate(t.invoice_line.withColumn("ag_carrier", F.col("carrier")), t.fuel_rate)
    label = "case when service_group in ('ground','home_delivery','ground_saver') then 'ground' when carrier = 'ups' then 'air' else 'express' end"
    return (
        keyed.selectExpr("carrier", f"{label} class", "date_format(ship_date, 'yyyy-MM-dd') ship_day", "cast(fuel_rate_pct as double) fuel_rate_pct")
        .groupBy("carrier", "class", "ship_day", "fuel_rate_pct").agg(F.count(F.lit(1)).alias("line_count"))
    )


@query(
    "a2a_suspension_windows",
    f"with {ov.LINES}, {ov.SUSPENSION} select carrier, strftime(ship_date, '%Y-%m-%d') ship_day, count(*) line_count from line"
    " where exists (select 1 from susp where susp.carrier = line.carrier and line.ship_date between s and e) group by all",
)
def _(t):
    flagged = ck.attach_suspension(t.invoice_line.withColumn("ag_carrier", F.col("carrier")), t.windows).where("suspended")
    return flagged.groupBy("carrier", F.date_format("ship_date", "yyyy-MM-dd").alias("ship_day")).agg(F.count(F.lit(1)).alias("line_count"))


@query(
    "a2b_promised_delivery_day",
    f"with {ov.LINES}, {ov.CALENDAR}, {ov.COMMITMENTS}, before as (select s.ship_date, count(w.d) k from (select distinct ship_date from line) s left join workday w on w.d <= s.ship_date group by 1)"
    " select service_code, strftime(ship_date, '%Y-%m-%d') ship_day, strftime(due.d, '%Y-%m-%d') promised_day, count(*) line_count"
    " from line join commitment c using (service_code) join before using (ship_date) join workday due on due.n = before.k + c.n group by all",
)
def _(t):
    promised = ck.attach_promise(t.invoice_line, t.calendar).where("commit_days is not null")
    return promised.groupBy(
        "service_code", F.date_format("ship_date", "yyyy-MM-dd").alias("ship_day"), F.date_format("promised_date", "yyyy-MM-dd").alias("promised_day")
    ).agg(F.count(F.lit(1)).alias("line_count"))


@query(
    "a13_a14_storage_lines",
    "with l as (select l_orderkey::varchar || '-' || l_linenumber::varchar || '-' || l_partkey::varchar || '-' || l_suppkey::varchar line_id, l_suppkey agreement_id,"
    " case l_linenumber % 3 when 0 then ' Storage' when 1 then 'pick' else 'storage' end cat, case when l_partkey % 4 = 0 then 'bin' else 'pallet' end unit,"
    " cast(l_quantity as decimal(14,4)) q, cast(cast(l_tax as decimal(4,2)) + 1 as decimal(14,4)) r, cast(l_discount as decimal(4,2)) disc from lineitem),"
    " t as (select s_suppkey agreement_id, cast(case when s_suppkey % 4 <> 3 then 1.02 + 0.01 * (s_suppkey % 3) end as decimal(14,4)) rate, case when s_suppkey % 5 <> 0 then 'pallet' end su from supplier),"
    " j as (select *, cast(q * r * (1 - disc) as decimal(18,4)) amt from l join t using (agreement_id) where lower(trim(cat)) = 'storage')"
    " select line_id, 'storage_rate' field, case when r > rate then 'overcharge' else 'undercharge' end kind, cast(round(amt - q * rate, 2) as double) impact, cast(round(q * rate, 2) as double) expected, '3PL storage billed rate differs from contract rate.' explanation from j where abs(r - rate) > 0.01"
    " union all select line_id, 'storage_unit', 'ambiguous_needs_review', 0.0, null, 'Storage billed as ' || unit || ', contract expects ' || su || '.' from j where su is not null and unit <> su",
)
def _(t):
    lines = t.table("lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) line_id", "l_suppkey agreement_id", "cast(l_orderkey as string) reference_id",
        "case l_linenumber % 3 when 0 then ' Storage' when 1 then 'pick' else 'storage' end service_category",
        "case when l_partkey % 4 = 0 then 'bin' else 'pallet' end unit_of_measure",
        "cast(l_quantity as decimal(18,4)) quantity_billed", "cast(cast(l_tax as decimal(4,2)) + 1 as decimal(18,4)) rate_billed", "cast(l_discount as decimal(4,2)) disc",
    ).selectExpr("*", "cast(cast(quantity_billed as decimal(14,4)) * cast(rate_billed as decimal(14,4)) * (1 - disc) as decimal(18,4)) amount_billed")
    terms = t.table("supplier").selectExpr(
        "s_suppkey agreement_id", "cast(case when s_suppkey % 4 <> 3 then 1.02 + 0.01 * (s_suppkey % 3) end as decimal(18,4)) storage_rate", "case when s_suppkey % 5 <> 0 then 'pallet' end storage_unit"
    )
    return ck.storage_findings(lines, terms).selectExpr(
        "line_id", "field", "discrepancy_type kind", "cast(dollar_impact as double) impact", "cast(expected_amount as double) expected", "explanation"
    )


# ---------------------------------------------------------------- rollups

_F = "agreement_id, line_id, tracking_number, service_or_charge_type, ship_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, kind, expected, billed, impact"
_CENTS = "cast(cast({} as decimal(18,2)) as varchar)"
_E, _B = _CENTS.format("expected"), _CENTS.format("billed")
_FLOAT = "cast(cast({} as double) as varchar)"
_DIMS = [_FLOAT.format(c) for c in ("length", "width", "height")]
_TENTHS = "cast(cast(round({}, 1) as decimal(18,1)) as varchar)"
# (check, order in the run, field, reason, explanation)
_ORDERED = [
    ("guarantee", 1, "gsr_late_delivery", "'Late delivery qualifies for money-back guarantee refund.'",
     f"'GSR eligible: promised ' || promised::varchar || ' by ' || coalesce(by_time::varchar, 'EOD') || ', delivered ' || strftime(delivered, '%Y-%m-%d %H:%M:%S') || '. Full refund of $' || {_B} || ' eligible.'"),
    ("earned", 2, "earned_discount", "case when layered then 'Billed net charge exceeds expected after applying all contract discount layers.' else 'Applied earned discount does not match expected tier.' end",
     f"case when layered then 'Published $' || {_CENTS.format('published_charge')} || ' × contract multi-layer discount (' || {_TENTHS.format('cast(100 - (100 - base_pct) * (100 - tpct) * 0.01 as decimal(18,8))')} || '% effective) = expected $' || {_E} || ', billed $' || {_B}"
     f" else 'Rolling revenue $' || format('{{:,.0f}}', rolling) || ' -> tier expects ' || {_TENTHS.format('pct')} || '%, applied ' || {_TENTHS.format('cast(applied * 100 / gross as decimal(18,8))')} || '% ($' || {_B} || ' vs $' || {_E} || ')' end"),
    ("dim", 3, "rated_weight_lbs", "'Rated weight differs from contract-based DIM expectation.'",
     f"'DIM divisor ' || divisor || ': ceil(' || {_DIMS[0]} || ')×ceil(' || {_DIMS[1]} || ')×ceil(' || {_DIMS[2]} || ')/' || divisor || ' = ' || dimlb || ' lb DIM, rated ' || {_FLOAT.format('expected')} || ' lb, billed ' || {_FLOAT.format('billed')} || ' lb'"),
    ("fuel", 4, "fuel_surcharge", "'Fuel surcharge does not match weekly table and contracted discount.'",
     f"'Published rate ' || {_FLOAT.format('rate')} || '% - ' || {_FLOAT.format('in_force')} || '% contracted discount = ' || cast(cast(round(cast(rate * (100 - in_force) * 0.01 as decimal(18,8)), 3) as decimal(18,3)) as varchar) || '% effective. Base: $' || {_CENTS.format("case when ag_carrier = 'fedex' then net_transport_charge else published_charge end")} || '. Expected: $' || {_E} || ', Billed: $' || {_B}"),
    ("minimum", 5, "minimum_net_charge", "'Published MNC appears used instead of contracted MNC.'", f"'Contract MNC $' || {_E} || ' but published default $' || {_CENTS.format('published')} || ' applied'"),
    ("residential", 6, "residential_surcharge", "case when is_residential = false then 'Residential fee should not apply to commercial address.' else 'Residential surcharge does not match flat override.' end",
     f"case when is_residential = false then 'Residential surcharge applied to commercial address' else 'Contract specifies flat residential fee of $' || {_E} || ', billed $' || {_B} end"),
    ("handling", 7, "ahs_surcharge", "'AHS fee appears unsupported by package dimensions/weight.'",
     f"'AHS charged but package dims ' || {_DIMS[0]} || 'x' || {_DIMS[1]} || 'x' || {_DIMS[2]} || ' and weight ' || {_FLOAT.format('actual_weight_lbs')} || ' lbs do not meet ' || upper(ag_carrier) || ' AHS criteria'"),
    ("large", 8, "large_package_surcharge", "'Large package fee appears unsupported by dimension thresholds.'",
     "'Large Package Surcharge charged but dims ' || cast(ceil(length) as int) || 'x' || cast(ceil(width) as int) || 'x' || cast(ceil(height) as int) || ' do not meet ' || upper(ag_carrier) || ' large package threshold'"),
    ("address", 9, "address_correction", "'Address correction fee does not match contract override.'", f"'Contract address correction fee: $' || {_E} || ', billed: $' || {_B}"),
    ("area", 10, "das_surcharge", "'DAS billed on ZIP not present in carrier DAS mapping.'", "'ZIP ' || destination_zip || ' is not on ' || upper(ag_carrier) || ' DAS list but DAS was charged'"),
]
_AGAIN = "'Tracking number ' || tracking_number || ' billed more than once on ' || ship_date::varchar"
FINDINGS = (
    ", ".join(["with " + ov.LINES, ov.AGREEMENTS, JOINED, ov.SUSPENSION, ov.CALENDAR, ov.COMMITMENTS, REVENUE, ov.FUEL, ov.ZIPS])
    + f", allf as (select {_F}, 0 ord, 'duplicate_charge' field, 'Potential duplicate invoice line.' why, {_AGAIN} basis from ({DUP.replace('from line' + chr(10), 'from j' + chr(10))})"
    + "".join(f" union all select {_F}, {o}, '{field}', {why}, {basis} from ({LINE_SQL[c][1]})" for c, o, field, why, basis in _ORDERED)
    + f"), ded as (select * from (select *, row_number() over (partition by agreement_id, line_id, field order by (ord > 0)::int, {ov.SEQ}, ord) rn from allf) where rn = 1)"
)


def _audit(t):
    lines = t.invoice_line.join(t.approved.select("agreement_id"), "agreement_id", "left_semi")
    return lines, ru.kept_findings(lines, t.approved, **t.reference)


@query("r1_rolling_revenue", "with " + ", ".join([ov.LINES, ov.AGREEMENTS, JOINED, REVENUE]) + " select agreement_id, rolling rolling_revenue from revenue")
def _(t):
    return ck.rolling_revenue(t.invoice_line, t.approved).selectExpr("agreement_id", "cast(rolling_revenue as double) rolling_revenue")


@query("r2_r3_all_findings", FINDINGS + " select agreement_id, line_id, field, kind discrepancy_type, cast(impact as double) dollar_impact, why why_discrepancy, basis explanation from allf")
def _(t):
    lines = t.invoice_line.join(t.approved.select("agreement_id"), "agreement_id", "left_semi")
    return ru.all_findings(lines, t.approved, **t.reference).selectExpr(
        "agreement_id", "line_id", "field", "discrepancy_type", "cast(dollar_impact as double) dollar_impact", "why_discrepancy", "explanation"
    )


@query("r4_first_per_charge", FINDINGS + " select agreement_id, line_id, field, kind discrepancy_type, cast(impact as double) dollar_impact from ded")
def _(t):
    return _audit(t)[1].selectExpr("agreement_id", "line_id", "field", "discrepancy_type", "cast(dollar_impact as double) dollar_impact")


_HEADER = """, hdr as (select agreement_id, count(*) lines_audited, min(ship_date) d0, max(ship_date) d1 from j group by 1),
 fl as (select agreement_id, coalesce(sum(impact) filter (impact > 0), 0) gain, count(distinct line_id) flagged, count(*) n from ded group by 1),
 hd as (select agreement_id, case when s_suppkey % 2 = 0 then ' FedEx' else 'UPS ' end shown_carrier, coalesce(case when s_suppkey % 5 = 0 then 'client ' || s_suppkey::varchar end, case when s_suppkey % 10 <> 1 then s_name end, 'Unknown Company') company_name,
 case when s_suppkey % 7 = 0 then s_suppkey::varchar else 'AG-' || s_suppkey::varchar end agreement_ref,
 strftime(d0, '%Y-%m-%d') period_start, strftime(d1, '%Y-%m-%d') period_end, cast(coalesce(gain, 0) as double) total_recovery_potential, lines_audited, coalesce(flagged, 0) lines_with_discrepancies,
 coalesce(n, 0) discrepancy_count, lines_audited * 10 checks_evaluated, greatest(lines_audited * 10 - coalesce(n, 0), 0) checks_without_result
 from hdr join agreement using (agreement_id) left join fl using (agreement_id))"""


@query("r5_r6_report_headers_and_counters", FINDINGS + _HEADER + " select * exclude (shown_carrier) from hd")
def _(t):
    lines, findings = _audit(t)
    reports = ru.report_headers(lines, findings, t.approved)
    counters = ru.run_counters(reports).select("agreement_id", "checks_evaluated", "checks_without_result")
    return reports.join(counters, "agreement_id").selectExpr(
        "agreement_id", "company_name", "agreement_ref", "date_format(invoice_period_start, 'yyyy-MM-dd') period_start", "date_format(invoice_period_end, 'yyyy-MM-dd') period_end",
        "cast(total_recovery_potential as double) total_recovery_potential", "lines_audited", "lines_with_discrepancies", "discrepancy_count", "checks_evaluated", "checks_without_result",
    )


_TITLE = "case kind when 'overcharge' then 'Overcharge' when 'undercharge' then 'Undercharge' when 'unsupported_fee' then 'Unsupported Fee' when 'missing_discount' then 'Missing Discount' else 'Ambiguous Needs Review' end"


@query("r8_summary_by_type", FINDINGS + f" select agreement_id, {_TITLE} dtype, count(*) shipments, cast(sum(impact) as double) total_impact from ded group by all")
def _(t):
    return ru.summary_by_type(_audit(t)[1], "agreement_id").selectExpr("agreement_id", "dtype", "shipments", "cast(total_impact as double) total_impact")


@query("audit_summary_by_carrier", FINDINGS + " select case when l_suppkey % 2 = 0 then 'fedex' else 'ups' end carrier, field, kind discrepancy_type, count(*) findings, cast(sum(impact) as double) total_impact from ded group by all")
def _(t):
    carriers = t.approved.selectExpr("agreement_id", "lower(trim(carrier)) carrier")
    return (
        _audit(t)[1].join(carriers, "agreement_id").groupBy("carrier", "field", "discrepancy_type")
        .agg(F.count(F.lit(1)).alias("findings"), F.sum("dollar_impact").cast("double").alias("total_impact"))
    )


@query("r9_status_counts", f"with {ov.AGREEMENTS} select status, count(*) extractions from agreement group by 1")
def _(t):
    return ru.status_counts(t.agreement)


_ACTION = """case when field = 'gsr_late_delivery' then 'File GSR claim with carrier within allowed claim window.'
 when field = 'fuel_surcharge' then 'Request fuel surcharge adjustment using weekly table and contract discount.'
 when field = 'rated_weight_lbs' then 'Dispute billed rated weight with DIM calculation evidence.'
 when kind = 'missing_discount' then 'Request rebill with contracted discount tier.'
 when kind = 'unsupported_fee' then 'Dispute unsupported fee and request credit.' else 'Review invoice evidence and submit recovery request.' end"""


@query(
    "r10_f31_f32_findings_table",
    FINDINGS + f""" select agreement_id, line_id, coalesce(nullif(trim(tracking_number), ''), l_orderkey::varchar) tracking, l_orderkey::varchar "transaction", {_TITLE} issue,
 cast(abs(impact) as double) discrepancy, case when impact >= 0 then 'overcharge' else 'undercharge' end direction, {_ACTION} action from ded""",
)
def _(t):
    return ru.findings_table(_audit(t)[1]).selectExpr(
        "agreement_id", "line_id", "tracking", "transaction", "issue", "cast(discrepancy as double) discrepancy", "direction", "action"
    )


_HEAD, _THIN = "=" * 72, "-" * 72
_REPORT = (
    FINDINGS
    + _HEADER
    + f""",
 num as (select *, {_TITLE} issue, row_number() over (partition by agreement_id order by (ord > 0)::int, {ov.SEQ}, ord) n from ded),
 typ as (select agreement_id, issue, count(*) k, sum(impact) total from num group by all),
 part as (
 select agreement_id, 1 section, 0 item, ['Invoice Audit Report', '{_HEAD}', 'Company:        ' || company_name, 'Agreement ID:   ' || agreement_ref, 'Carrier:        ' || shown_carrier,
   'Invoice Period: ' || period_start || ' to ' || period_end, 'Audited Lines:  ' || lines_audited, 'Lines Flagged:  ' || lines_with_discrepancies,
   'Total Recovery Potential: $' || {_CENTS.format('total_recovery_potential')}, 'Generated:      2026-04-20T00:00:00Z', '{_HEAD}', '', 'DISCREPANCIES FOUND', '{_THIN}', ''] texts from hd
 union all select agreement_id, 2, n, ['[' || n || '] ' || upper(issue), '    Tracking:    ' || coalesce(nullif(trim(tracking_number), ''), l_orderkey::varchar), '    Transaction: ' || l_orderkey,
   '    Ship Date:   ' || ship_date::varchar, '    Service:     ' || service_or_charge_type, '    Billed:      $' || {_B}, '    Expected:    $' || {_E},
   '    Discrepancy: $' || {_CENTS.format('abs(impact)')} || case when impact >= 0 then ' overcharge' else ' undercharge' end, '    Why:         ' || why, '    Basis:       ' || basis, '    Action:      ' || {_ACTION}, ''] from num
 union all select agreement_id, 3, 0, ['{_HEAD}', 'SUMMARY BY DISCREPANCY TYPE', '{_THIN}'] from hd
 union all select agreement_id, 4, row_number() over (partition by agreement_id order by issue), [rpad(issue, 28, ' ') || lpad(k::varchar, greatest(3, length(k::varchar))::int, ' ') || ' shipments    $' || {_CENTS.format('total')}] from typ
 union all select agreement_id, 5, 0, ['{_THIN}', 'TOTAL RECOVERY POTENTIAL                  $' || {_CENTS.format('total_recovery_potential')}, '{_HEAD}'] from hd)
 select agreement_id, section, item, unnest(generate_series(0, len(texts) - 1))::int part, unnest(texts) "text" from part"""
)


@query("r7_text_report", _REPORT)
def _(t):
    lines = t.invoice_line.join(t.approved.select("agreement_id"), "agreement_id", "left_semi")
    findings = ru.staged_findings(lines, t.approved, **t.reference)
    reports = ru.report_headers(lines, findings, t.approved)
    block = F.floor(F.col("line_seq.l_orderkey") / 4096)
    return ru.report_lines(findings, reports, "2026-04-20T00:00:00Z", block)


@query(
    "s17_written_report",
    _REPORT.rsplit(" select agreement_id, section, item", 1)[0]
    + """ select 'header' what, count(*) n, cast(sum(total_recovery_potential) as double) total from hd union all select 'finding', count(*), cast(sum(impact) as double) from ded
 union all select 'text', sum(len(texts))::bigint, cast(sum(list_sum(list_transform(texts, lambda x: length(x)))) as double) from part""",
)
def _(t):
    """The report of all agreements, written, read back and summed up from its files."""
    lines = t.invoice_line.join(t.approved.select("agreement_id"), "agreement_id", "left_semi")
    kept = ru.kept_findings(lines, t.approved, **t.reference).drop(*ck.DESCRIBED, "invoice_id", "invoice_source_reference")
    folder = written_folder(t.spark, "report")
    stored = mt.write_version(kept, f"{folder}/findings-table", "1")
    kept = ck.describe(t.spark.read.schema(kept.schema).parquet(stored))
    findings = kept.select(
        "agreement_id", "line_id", "line_seq", "check_ord", "tracking_number", "transaction_id", "ship_date", "service_or_charge_type", "discrepancy_type", "field",
        "billed_value", "billed_amount", "expected_value", "expected_amount", "dollar_impact", "why_discrepancy", "explanation")
    headers = ru.report_headers(lines, findings, t.approved)
    body = ru.report_lines(kept, headers, "2026-04-20T00:00:00Z", F.floor(F.col("line_seq.l_orderkey") / 4096))
    ex.write_report(headers, findings, body, f"{folder}/out")
    back = ex.read_report(t.spark, f"{folder}/out", headers.schema, findings.schema)
    sums = [("header", F.col("total_recovery_potential")), ("finding", F.col("dollar_impact")), ("text", F.length("text"))]
    out = [df.agg(F.count(F.lit(1)).alias("n"), F.sum(c).cast("double").alias("total")).select(F.lit(what).alias("what"), "n", "total") for df, (what, c) in zip(back, sums, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("s20_published_version", f"with {ov.FUEL} select carrier, class, strftime(week_start, '%Y-%m-%d') week_day, cast(pct + 0.5 as double) pct from fuel_rate")
def _(t):
    """Two published versions and one that was never finished: readers get the second."""
    folder = written_folder(t.spark, "fuel-versions")
    mt.publish_version(t.fuel_rate, folder, "20260401")
    mt.publish_version(t.fuel_rate.withColumn("pct", (F.col("pct") + F.lit("0.5").cast("decimal(2,1)")).cast("decimal(8,4)")), folder, "20260408")
    mt.write_version(t.fuel_rate, folder, "20260415")
    return mt.read_version(t.spark, folder).selectExpr("carrier", "class", "date_format(week_start, 'yyyy-MM-dd') week_day", "cast(pct as double) pct")
