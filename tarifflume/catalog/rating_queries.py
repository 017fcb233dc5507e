"""Contract rating, reference upkeep and the evaluation study."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarifflume.catalog import oracle_views as ov
from tarifflume.catalog.registry import query
from tarifflume.operators import maintenance as mt, rating as ra, study as st

def _shipments(t):
    return t.table("lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) shipment_id", "l_suppkey contract_id",
        "element_at(array('GROUND','2DAY','OVERNIGHT','FREIGHT'), cast(1 + l_partkey % 4 as int)) service_type",
        "cast(2 + l_orderkey % 8 as string) zone", "cast(cast(l_quantity as decimal(10,2)) * 0.5 as decimal(18,4)) weight",
        "case when l_linenumber % 2 = 0 then 'RESIDENTIAL' else 'COMMERCIAL' end shipment_type", "cast(l_extendedprice as decimal(12,2)) price",
    )


SHIP = """ship as (select l_orderkey::varchar || '-' || l_linenumber::varchar || '-' || l_partkey::varchar || '-' || l_suppkey::varchar shipment_id, l_suppkey contract_id,
 ['GROUND','2DAY','OVERNIGHT','FREIGHT'][1 + l_partkey % 4] service_type, (2 + l_orderkey % 8)::varchar "zone", cast(cast(l_quantity as decimal(10,2)) * 0.5 as decimal(18,4)) weight,
 case when l_linenumber % 2 = 0 then 'RESIDENTIAL' else 'COMMERCIAL' end shipment_type, cast(l_extendedprice as decimal(12,2)) price from lineitem)"""


def _terms(t):
    return t.table("supplier").selectExpr("s_suppkey contract_id", "explode(array('GROUND','2DAY','OVERNIGHT')) service_type").where(
        "not (contract_id % 4 = 3 and service_type = 'OVERNIGHT')"
    ).selectExpr(
        "*", "cast(10 + contract_id % 7 * 2.5 + length(service_type) as decimal(8,4)) discount_percentage",
        "cast(8 + contract_id % 3 as decimal(18,4)) minimum_charge", "cast(case when contract_id % 9 = 4 then 0.5 else 139 end as decimal(6,2)) dim_divisor",
    )


TERM = """term as (select s_suppkey contract_id, service_type, cast(10 + s_suppkey % 7 * 2.5 + length(service_type) as decimal(8,4)) discount_percentage,
 cast(8 + s_suppkey % 3 as decimal(18,4)) minimum_charge, cast(case when s_suppkey % 9 = 4 then 0.5 else 139 end as decimal(6,2)) dim_divisor
 from supplier, (values ('GROUND'), ('2DAY'), ('OVERNIGHT')) v(service_type) where not (s_suppkey % 4 = 3 and service_type = 'OVERNIGHT'))"""


def _tiers(t):
    """Four tiers per service and zone; zone 9 is missing and some cards have a gap."""
    bands = "explode(array(named_struct('k', 0, 'lo', 0, 'hi', 1), named_struct('k', 1, 'lo', 1, 'hi', 5), named_struct('k', 2, 'lo', 5, 'hi', 10), named_struct('k', 3, 'lo', 10, 'hi', null))) b"
    zones = t.table("supplier").selectExpr("s_suppkey contract_id", "explode(array('GROUND','2DAY','OVERNIGHT')) service_type").selectExpr("*", "explode(sequence(2, 8)) z")
    return zones.selectExpr("*", bands).selectExpr(
        "contract_id", "service_type", "cast(z as string) zone",
        "cast(case when contract_id % 6 = 1 and b.k = 2 then 6 when contract_id % 6 = 2 and b.k = 1 then 0.5 else b.lo end as decimal(18,4)) min_weight",
        "cast(case when contract_id % 6 = 3 and z = 4 and b.k = 1 then null when contract_id % 6 = 4 and b.k = 3 then 20 else b.hi end as decimal(18,4)) max_weight",
        "cast(6 + z * 0.75 + b.k * 3.1 + contract_id % 5 * 0.25 + length(service_type) as decimal(18,4)) base_rate",
    )


TIER = """tier as (select s_suppkey contract_id, service_type, z::varchar "zone",
 cast(case when s_suppkey % 6 = 1 and k = 2 then 6 when s_suppkey % 6 = 2 and k = 1 then 0.5 else lo end as decimal(18,4)) min_weight,
 cast(case when s_suppkey % 6 = 3 and z = 4 and k = 1 then null when s_suppkey % 6 = 4 and k = 3 then 20 else hi end as decimal(18,4)) max_weight,
 cast(6 + z * 0.75 + k * 3.1 + s_suppkey % 5 * 0.25 + length(service_type) as decimal(18,4)) base_rate
 from supplier, (values ('GROUND'), ('2DAY'), ('OVERNIGHT')) v(service_type), range(2, 9) zz(z), (values (0, 0, 1), (1, 1, 5), (2, 5, 10), (3, 10, null)) b(k, lo, hi))"""


def _surcharges(t):
    return t.table("supplier").selectExpr("s_suppkey contract_id", """explode(array(
      named_struct('charge_code','RES','charge_format','PERCENTAGE','modification_type','DISCOUNT','value', cast(20 as decimal(18,4)), 'shipment_type','RESIDENTIAL','services',cast(array() as array<string>),'zones',cast(null as array<string>),'min_weight',cast(null as decimal(18,4)),'max_weight',cast(null as decimal(18,4))),
      named_struct('charge_code','FSC','charge_format','WAIVED','modification_type','WAIVER','value', cast(0 as decimal(18,4)), 'shipment_type',cast(null as string),'services',array('GROUND'),'zones',cast(array() as array<string>),'min_weight',cast(null as decimal(18,4)),'max_weight',cast(10 as decimal(18,4))),
      named_struct('charge_code','AHS','charge_format','PER_POUND','modification_type','MARKUP','value', cast(0.35 as decimal(18,4)), 'shipment_type','ALL','services',array('2DAY','OVERNIGHT'),'zones',array('5','6','7','8'),'min_weight',cast(15 as decimal(18,4)),'max_weight',cast(null as decimal(18,4))),
      named_struct('charge_code','ZZZ','charge_format','FLAT_AMOUNT','modification_type','OVERRIDE','value', cast(4.5 as decimal(18,4)), 'shipment_type','COMMERCIAL','services',cast(array() as array<string>),'zones',array('2'),'min_weight',cast(5 as decimal(18,4)),'max_weight',cast(case when s_suppkey % 5 = 0 then 4 else 20 end as decimal(18,4))),
      named_struct('charge_code','PEAK','charge_format','PERCENTAGE_OF_CHARGE','modification_type','DISCOUNT','value', cast(case when s_suppkey % 7 = 0 then 120 else 12 end as decimal(18,4)), 'shipment_type','','services',array('OVERNIGHT'),'zones',cast(array() as array<string>),'min_weight',cast(null as decimal(18,4)),'max_weight',cast(null as decimal(18,4))))) s""").select("contract_id", "s.*")


SUR = """sur as (select s_suppkey contract_id, code, fmt, mod, case when code = 'PEAK' and s_suppkey % 7 = 0 then 120 else val end val, st, svc, zs, lo, case when code = 'ZZZ' and s_suppkey % 5 = 0 then 4 else hi end hi from supplier,
 (values ('RES','PERCENTAGE','DISCOUNT',20.0,'RESIDENTIAL',null,null,null,null), ('FSC','WAIVED','WAIVER',0.0,null,['GROUND'],null,null,10), ('AHS','PER_POUND','MARKUP',0.35,null,['2DAY','OVERNIGHT'],['5','6','7','8'],15,null),
  ('ZZZ','FLAT_AMOUNT','OVERRIDE',4.5,'COMMERCIAL',null,['2'],5,20), ('PEAK','PERCENTAGE_OF_CHARGE','DISCOUNT',12.0,null,['OVERNIGHT'],null,null,null)) v(code, fmt, mod, val, st, svc, zs, lo, hi))"""
APPLY = """app as (select ship.*, code, fmt, mod, val from ship join sur using (contract_id) where (svc is null or list_contains(svc, service_type)) and (zs is null or list_contains(zs, "zone"))
 and (st is null or st = shipment_type) and (lo is null or weight >= lo) and (hi is null or weight <= hi))"""

RATED = """rated as (select ship.shipment_id, ship.contract_id, ship.service_type, ship."zone", ship.weight, t.discount_percentage, t.minimum_charge, t.contract_id is null no_term,
 (select count(*) > 0 from tier where tier.contract_id = ship.contract_id and tier.service_type = ship.service_type and tier."zone" = ship."zone") has_zone,
 (select arg_min(base_rate, min_weight) from tier where tier.contract_id = ship.contract_id and tier.service_type = ship.service_type and tier."zone" = ship."zone"
   and ship.weight >= min_weight and (max_weight is null or ship.weight <= max_weight)) base_rate from ship left join term t on t.contract_id = ship.contract_id and t.service_type = ship.service_type)"""


def _rated(t):
    return ra.with_net_rate(ra.with_base_rate(ra.with_service_term(_shipments(t), _terms(t)), _tiers(t)))


@query(
    "p1_p2_p4_contract_rating",
    f"""with {SHIP}, {TERM}, {TIER}, {RATED} select shipment_id, cast(base_rate as double) base_rate, cast(greatest(cast(base_rate * (100 - discount_percentage) * 0.01 as decimal(18,4)), case when base_rate is not null and discount_percentage is not null then minimum_charge end) as double) net_rate,
 case when no_term then 'service_not_found' when not has_zone then 'zone_not_found' when base_rate is null then 'tier_not_found' end rating_error from rated""".replace(
        "cast(greatest(cast(base_rate * (100 - discount_percentage) * 0.01 as decimal(18,4)), case when base_rate is not null and discount_percentage is not null then minimum_charge end) as double) net_rate",
        "case when base_rate is not null and discount_percentage is not null then cast(greatest(cast(base_rate * (100 - discount_percentage) * 0.01 as decimal(18,4)), minimum_charge) as double) end net_rate",
    ),
)
def _(t):
    return _rated(t).selectExpr("shipment_id", "cast(base_rate as double) base_rate", "cast(net_rate as double) net_rate", "rating_error")


@query("p3_applicable_surcharges", f"with {SHIP}, {SUR}, {APPLY} select shipment_id, code charge_code, mod modification_type from app")
def _(t):
    return ra.applicable_surcharges(_shipments(t), _surcharges(t)).select("shipment_id", "charge_code", "modification_type")


@query(
    "p5_tier_breaks",
    f"""with {TIER} select contract_id, service_type, "zone", cast(min_weight as double) min_weight, case when max_weight is null then 'open_tier_not_last' when nxt > max_weight then 'gap' else 'overlap' end problem
 from (select *, lead(min_weight) over (partition by contract_id, service_type, "zone" order by min_weight) nxt from tier) where nxt is not null and (max_weight is null or nxt <> max_weight)""",
)
def _(t):
    return ra.tier_breaks(_tiers(t)).selectExpr("contract_id", "service_type", "zone", "cast(min_weight as double) min_weight", "problem")


@query("p6_repeated_keys", "select l_orderkey contract_id, l_linenumber::varchar service_type, count(*) uses from lineitem group by all having count(*) > 1")
def _(t):
    rows = t.table("lineitem").selectExpr("l_orderkey contract_id", "cast(l_linenumber as string) service_type")
    return ra.repeated_keys(rows, ["contract_id", "service_type"])


CONTRACT = """con as (select o_orderkey contract_id, o_custkey account, cast(o_orderdate as date) eff, case when o_orderkey % 4 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 50 * 20 - 40 as int) end ex,
 case when o_orderkey % 5 < 2 then (o_orderkey % 90 - 3) end notice, o_orderkey % 3 = 0 renews from orders)"""


def _contracts(t):
    return t.table("orders").selectExpr(
        "o_orderkey contract_id", "o_custkey account", "cast(o_orderdate as date) effective_date",
        "case when o_orderkey % 4 <> 0 then date_add(cast(o_orderdate as date), cast(o_orderkey % 50 * 20 - 40 as int)) end expiration_date",
        "case when o_orderkey % 5 < 2 then cast(o_orderkey % 90 - 3 as int) end cancellation_notice_days", "case when o_orderkey % 3 = 0 then true end auto_renews",
    )


@query(
    "p7_row_violations",
    f"""with {CONTRACT}, {TERM}, {TIER}, {SUR} select 'contract' entity, contract_id::varchar "key", c.code from con, (values ('expiration_not_after_effective'), ('notice_without_auto_renew'), ('negative_notice')) c(code)
 where case c.code when 'expiration_not_after_effective' then ex <= eff when 'notice_without_auto_renew' then notice is not null and not renews else notice < 0 end
 union all select 'service_term', contract_id::varchar || '/' || service_type, 'dim_divisor_below_one' from term where dim_divisor < 1
 union all select 'weight_tier', contract_id::varchar || '/' || service_type || '/' || "zone" || '/' || min_weight::varchar, 'max_not_above_min' from tier where max_weight <= min_weight
 union all select 'surcharge', contract_id::varchar || '/' || code, 'percentage_above_100' from sur where fmt like 'PERC%' and val > 100
 union all select 'surcharge', contract_id::varchar || '/' || code, 'weight_range' from sur where hi <= lo""",
)
def _(t):
    return (
        ra.contract_violations(_contracts(t)).unionByName(ra.term_violations(_terms(t)))
        .unionByName(ra.tier_violations(_tiers(t))).unionByName(ra.surcharge_violations(_surcharges(t)))
    )


@query(
    "p8_contracts_in_force",
    f"with {CONTRACT} select o_orderkey order_key, count(*) in_force from orders o join con on con.account = o.o_custkey and eff <= cast(o_orderdate as date) + 30 and (ex is null or cast(o_orderdate as date) + 30 <= ex) group by 1",
)
def _(t):
    dated = t.table("orders").selectExpr("o_orderkey order_key", "o_custkey account", "date_add(cast(o_orderdate as date), 30) day")
    return ra.contracts_in_force(dated, _contracts(t), "day").groupBy("order_key").agg(F.count(F.lit(1)).alias("in_force"))


@query(
    "p9_p11_charge_amounts",
    f"""with {SHIP}, {SUR}, {APPLY}, a as (select *, cast(price * 0.001 as decimal(14,4)) base, cast(case fmt when 'PERCENTAGE' then round(cast(price * 0.001 as decimal(14,4)) * val * 0.01, 4) when 'PERCENTAGE_OF_CHARGE' then round(cast(5.25 as decimal(14,4)) * val * 0.01, 4)
 when 'FLAT_AMOUNT' then val when 'PER_POUND' then val * weight else 0 end as decimal(18,4)) amount, cast(5.25 as decimal(18,4)) pub from app)
 select shipment_id, code charge_code, case code when 'RES' then 'Residential Delivery Surcharge' when 'FSC' then 'Fuel Surcharge' when 'AHS' then 'Additional Handling Surcharge' when 'PEAK' then 'Peak / Demand Surcharge' end charge_name,
 cast(amount as double) amount, cast(cast(case mod when 'WAIVER' then 0 when 'OVERRIDE' then val when 'DISCOUNT' then pub - case when fmt like 'PERC%' then round(pub * val * 0.01, 4) else amount end else pub + amount end as decimal(18,4)) as double) contract_pays from a""",
)
def _(t):
    applied = ra.with_charge_name(ra.applicable_surcharges(_shipments(t), _surcharges(t)))
    base, published = F.expr("cast(price * 0.001 as decimal(18,4))"), F.lit("5.25").cast("decimal(18,4)")
    amount = ra.charge_amount(F.col("charge_format"), F.col("value"), base, F.col("weight"), published)
    pays = ra.contract_charge(F.col("modification_type"), published, amount, F.col("charge_format"), F.col("value"))
    return applied.select("shipment_id", "charge_code", "charge_name", amount.cast("double").alias("amount"), pays.cast("double").alias("contract_pays"))


@query(
    "p10_billing_weight",
    """with w as (select ['NEXT_WHOLE_POUND','NEAREST_POUND','NEXT_HALF_POUND','ACTUAL'][1 + l_partkey % 4] m, cast(cast(l_quantity as decimal(10,2)) * 0.37 as decimal(18,4)) w from lineitem)
 select m rounding_mode, cast(w as double) weight, cast(case m when 'NEXT_WHOLE_POUND' then ceil(w) when 'NEAREST_POUND' then round(w, 0) when 'NEXT_HALF_POUND' then ceil(w * 2) * 0.5 else w end as double) billed_weight, count(*) shipments from w group by all""",
)
def _(t):
    rows = t.table("lineitem").selectExpr(
        "element_at(array('NEXT_WHOLE_POUND','NEAREST_POUND','NEXT_HALF_POUND','ACTUAL'), cast(1 + l_partkey % 4 as int)) rounding_mode", "cast(cast(l_quantity as decimal(10,2)) * 0.37 as decimal(18,4)) w"
    )
    billed = ra.billing_weight(F.col("w"), F.col("rounding_mode")).cast("double").alias("billed_weight")
    return rows.select("rounding_mode", F.col("w").cast("double").alias("weight"), billed).groupBy("rounding_mode", "weight", "billed_weight").agg(F.count(F.lit(1)).alias("shipments"))


# ---------------------------------------------------------------- reference upkeep

_WEEK = "date_add(date'2024-01-01', cast(datediff(cast(o_orderdate as date), date'1995-01-01') % 830 as int))"
_WEEK_SQL = "cast(date_trunc('week', date '2024-01-01' + cast(datediff('day', date '1995-01-01', cast(o_orderdate as date)) % 830 as int)) as date)"
SERIES_SQL = f"""raw as (select case when o_custkey % 2 = 0 then 'fedex' else 'ups' end carrier, case when o_custkey % 4 < 2 then 'ground' else 'express' end class, {_WEEK_SQL} week_start, min(o_orderkey) k from orders group by all),
 old as (select carrier, class, week_start, cast(10 + k % 60 * 0.1 as decimal(8,4)) pct from raw where datediff('day', date '2024-01-01', week_start) // 7 % 3 <> 0),
 fresh as (select carrier, class, week_start, cast(10 + k % 60 * 0.1 + case when k % 17 = 0 then 0.75 else 0.25 end as decimal(8,4)) pct from raw where datediff('day', date '2024-01-01', week_start) // 7 % 5 <> 0)"""


def _series(t):
    raw = t.table("orders").selectExpr(
        "case when o_custkey % 2 = 0 then 'fedex' else 'ups' end carrier", "case when o_custkey % 4 < 2 then 'ground' else 'express' end class",
        f"cast(date_trunc('week', {_WEEK}) as date) week_start", "o_orderkey",
    ).groupBy("carrier", "class", "week_start").agg(F.min("o_orderkey").alias("k")).withColumn("n", F.expr("datediff(week_start, date'2024-01-01') div 7"))
    old = raw.where("n % 3 <> 0").selectExpr("carrier", "class", "week_start", "cast(10 + k % 60 * 0.1 as decimal(8,4)) pct")
    new = raw.where("n % 5 <> 0").selectExpr("carrier", "class", "week_start", "cast(10 + k % 60 * 0.1 + case when k % 17 = 0 then 0.75 else 0.25 end as decimal(8,4)) pct")
    return old, new


@query(
    "k1_backfilled_weeks",
    f"""with {SERIES_SQL}, b as (select distinct carrier, class, case when carrier = 'fedex' then 12.25 else 11.75 end base from old),
 want as (select carrier, class, date '2026-04-20' - cast(7 * i as int) week_start, cast(round(base + ((i % 13) - 6) * 0.06, 2) as decimal(8,4)) pct from b, range(104) r(i))
 select carrier, class, strftime(week_start, '%Y-%m-%d') week_start, cast(pct as double) pct from old union all
 select carrier, class, strftime(week_start, '%Y-%m-%d'), cast(pct as double) from want anti join old using (carrier, class, week_start)""",
)
def _(t):
    old, _ = _series(t)
    bases = old.select("carrier", "class").distinct().withColumn("base_pct", F.expr("cast(case when carrier = 'fedex' then 12.25 else 11.75 end as decimal(6,2))"))
    return mt.backfill_weeks(old, bases, "2026-04-23").selectExpr("carrier", "class", "date_format(week_start, 'yyyy-MM-dd') week_start", "cast(pct as double) pct")


@query(
    "k2_merged_history",
    f"with {SERIES_SQL} select carrier, class, strftime(week_start, '%Y-%m-%d') week_start, cast(coalesce(old.pct, fresh.pct) as double) pct from old full join fresh using (carrier, class, week_start)",
)
def _(t):
    return mt.merge_history(*_series(t)).selectExpr("carrier", "class", "date_format(week_start, 'yyyy-MM-dd') week_start", "cast(pct as double) pct")


@query(
    "k3_value_drift",
    f"with {SERIES_SQL}, o as (select count(*) overlap, count(*) filter (abs(fresh.pct - old.pct) > 0.5) changed from old join fresh using (carrier, class, week_start)) select overlap, changed, changed / overlap drift, changed / overlap <= 0.05 accepted from o",
)
def _(t):
    return mt.value_drift(*_series(t))


@query(
    "k4_row_count_drift",
    """with now as (select 'zips' || (p_size % 7)::varchar tbl, count(*) rows_now from part group by 1), ver as (select 'zips' || (p_size % 7)::varchar tbl, p_partkey % 3 version, count(*) n from part where p_size % 7 <> 6 group by 1, 2),
 last as (select tbl, arg_max(n, version) rows_before from ver group by 1) select tbl, rows_now, rows_before, coalesce(abs(rows_now - rows_before) / rows_before, 0) drift, coalesce(abs(rows_now - rows_before) / rows_before, 0) <= 0.05 accepted from now left join last using (tbl)""",
)
def _(t):
    rows = t.table("part").selectExpr("concat('zips', cast(p_size % 7 as string)) tbl", "p_partkey % 3 version", "p_size")
    return mt.row_count_guard(rows, rows.where("p_size % 7 <> 6"), ["tbl"])


@query(
    "k5_leaf_count_guard",
    """select p_partkey doc_id, case when p_partkey % 9 = 0 then 0 else 3 end AS before, case when p_partkey % 11 = 0 then 0 when p_partkey % 4 = 0 then 4 else 3 end AS now,
 case when p_partkey % 9 = 0 then 0 when p_partkey % 11 = 0 then 1 when p_partkey % 4 = 0 then 1.0 / 3 else 0 end drift,
 case when p_partkey % 9 = 0 then true when p_partkey % 11 = 0 or p_partkey % 4 = 0 then false else true end accepted from part""",
)
def _(t):
    guide = lambda extra: f"""concat('{{"svc 1.5', cast(p_partkey % 5 as string), '": {{"zone_2": {{"1": ', cast(p_retailprice as string), ', "5": ', cast(p_size as string), '.5}}, "zone_5": {{"1": 14', {extra}, '}}}}}}')"""
    more = "case when p_partkey % 4 = 0 then ', \"10\": 21.75' else '' end"
    empty = "''"
    pairs = t.table("part").selectExpr(
        "p_partkey doc_id", f"case when p_partkey % 9 = 0 then '{{}}' else {guide(empty)} end previous", f"case when p_partkey % 11 = 0 then '{{}}' else {guide(more)} end current"
    )
    return mt.leaf_guard(pairs)


@query(
    "f26_numeric_leaves",
    """select p_partkey doc_id, 'svc' || (p_partkey % 5)::varchar service, "zone", weight, case when "zone" = 'zone_5' then 14 when weight = '1' then p_size + 0.25 else p_size + 0.5 end::double "value"
 from part, (values ('zone_2', '1'), ('zone_2', '5'), ('zone_5', '1')) v("zone", weight)""",
)
def _(t):
    body = """concat('{"svc', cast(p_partkey % 5 as string), '": {"zone_2": {"1": ', cast(p_size as string), '.25, "5": ', cast(p_size as string), '.5}, "zone_5": {"1": 14}}}')"""
    return mt.numeric_leaves(t.table("part").selectExpr("p_partkey doc_id", f"{body} body"))


@query(
    "k6_first_zips",
    """with z as (select case when l_suppkey % 2 = 0 then 'fedex' else 'ups' end carrier, lpad((l_partkey * 37 % 100000)::varchar, 5, '0') zip, l_orderkey * 8 + l_linenumber pos, l_suppkey from lineitem),
 m as (select carrier, zip, min(pos * 100000 + l_suppkey) first_pos, arg_max(case when l_suppkey % 3 = 0 then 'metro' else 'rural' end, pos * 100000 + l_suppkey) tier from z group by all)
 select carrier, zip, first_pos, tier from m""",
)
def _(t):
    rows = t.table("lineitem").selectExpr(
        "case when l_suppkey % 2 = 0 then 'fedex' else 'ups' end carrier", "lpad(cast(l_partkey * 37 % 100000 as string), 5, '0') zip",
        "(l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey pos", "case when l_suppkey % 3 = 0 then 'metro' else 'rural' end tier",
    )
    return mt.first_zips(rows).select("carrier", "zip", "first_pos", "tier")


@query(
    "k7_k8_reference_freshness",
    """with days as (select 'fuel_weekly_rates' "name", l_shipdate::date d from lineitem union all select case when l_suppkey % 2 = 0 then 'fedex_das_zips' else 'ups_das_zips' end, l_shipdate::date from lineitem where l_linenumber = 1
  union all select 'fedex_zone_map', o_orderdate::date from orders),
 ages as (select "name", date '1998-12-20' - max(d) age from days group by 1),
 e as (select l."name", age, age is null or age > days_limit stale from (values ('fuel_weekly_rates', 10), ('fedex_das_zips', 90), ('ups_das_zips', 90), ('fedex_zone_map', 120), ('ups_zone_map', 120)) l("name", days_limit) left join ages using ("name"))
 select "name", age::double age_days, 1 tables, stale::int stale_or_missing from e union all select 'all tables', null, count(*), sum(stale::int) from e""",
)
def _(t):
    lines = t.table("lineitem")
    dates = (
        lines.selectExpr("'fuel_weekly_rates' name", "cast(l_shipdate as date) day")
        .unionByName(lines.where("l_linenumber = 1").selectExpr("case when l_suppkey % 2 = 0 then 'fedex_das_zips' else 'ups_das_zips' end name", "cast(l_shipdate as date) day"))
        .unionByName(t.table("orders").selectExpr("'fedex_zone_map' name", "cast(o_orderdate as date) day"))
    )
    entries = mt.freshness(mt.table_ages(dates, F.lit("1998-12-20").cast("date")), mt.freshness_limits(t.spark))
    total = mt.health_summary(entries).selectExpr("'all tables' name", "cast(null as double) age_days", "total tables", "stale_or_missing")
    return entries.selectExpr("name", "age_days", "1L tables", "cast(stale as bigint) stale_or_missing").unionByName(total)


# ---------------------------------------------------------------- evaluation study

_TRACK = "concat(cast(user_id as string), '-', cast(cast(value as int) % 40 as string))"
STUDY_SQL = """ai0 as (select event_id, case when event_id % 10 = 0 then '' else user_id::varchar || '-' || (trunc("value")::int % 40)::varchar end tn, user_id::varchar || '-' || (trunc("value")::int % 40)::varchar tx, event_type kind, cast("value" as decimal(18,4)) amt from events where event_type in ('click', 'error')),
 ai as (select coalesce(nullif(tn, ''), tx) track, arg_min(kind, event_id) ai_type, arg_min(amt, event_id) ai_dollars from ai0 group by 1),
 hum as (select event_id::varchar shipment_id, user_id::varchar || '-' || (trunc("value")::int % 40)::varchar track, event_id % 3 <> 1 human_found, case when event_id % 4 <> 0 then cast("value" as decimal(18,4)) * 2 end human_dollars from events where event_type not in ('click', 'error')),
 rec as (select *, ai.track is not null ai_found, case when ai.track is not null and human_found then 'TP' when ai.track is not null then 'FP' when human_found then 'FN' else 'TN' end outcome from hum left join ai using (track))"""


def _study(t):
    events = t.table("events")
    ai = events.where("event_type in ('click', 'error')").selectExpr(
        "event_id", f"case when event_id % 10 = 0 then '' else concat(' ', {_TRACK}) end tracking_number", f"{_TRACK} transaction_id", "event_type discrepancy_type", "cast(value as decimal(18,4)) dollar_impact"
    )
    human = events.where("event_type not in ('click', 'error')").selectExpr(
        "cast(event_id as string) shipment_id", f"concat({_TRACK}, ' ') tracking_number", "case event_id % 3 when 0 then ' TRUE' when 1 then 't' else 'yes' end discrepancy_found",
        "cast(null as string) discrepancy_type", "case when event_id % 4 <> 0 then concat('$', cast(cast(value as decimal(18,4)) * 2 as string)) else '' end dollar_amount",
    )
    return st.compare(human, ai, "event_id")


@query("z1_z2_study_records", f"with {STUDY_SQL} select shipment_id, track tracking_number, ai_type, cast(ai_dollars as double) ai_dollars, human_found, cast(human_dollars as double) human_dollars, outcome from rec")
def _(t):
    return _study(t).selectExpr("shipment_id", "tracking_number", "ai_type", "cast(ai_dollars as double) ai_dollars", "human_found", "cast(human_dollars as double) human_dollars", "outcome")


@query(
    "z3_study_metrics",
    f"""with {STUDY_SQL}, c as (select count(*) filter (outcome = 'TP') tp, count(*) filter (outcome = 'FP') fp, count(*) filter (outcome = 'FN') fn, count(*) filter (outcome = 'TN') tn, count(*) total_records,
 cast(coalesce(sum(ai_dollars) filter (ai_found), 0) as double) ai_recovery, cast(coalesce(sum(human_dollars) filter (human_found), 0) as double) human_recovery, cast(coalesce(sum(ai_dollars) filter (outcome = 'FP'), 0) as double) ai_only_recovery from rec),
 d as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end p, case when tp + fn > 0 then tp / (tp + fn) else 0 end r from c)
 select tp, fp, fn, tn, round(p, 4) "precision", round(r, 4) recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) f1, total_records, ai_recovery, human_recovery, ai_only_recovery, r >= 0.9 recall_target_met, ai_only_recovery > 0 additional_finds_target_met from d""",
)
def _(t):
    return st.metrics(_study(t))


@query("z4_s21_study_gaps", f"with {STUDY_SQL} select shipment_id, track tracking_number, outcome from rec where outcome in ('FP', 'FN')")
def _(t):
    records = _study(t)
    return st.misses(records, "FP").unionByName(st.misses(records, "FN")).select("shipment_id", "tracking_number", "outcome")


@query(
    "s13_f22_study_rows",
    """select event_id::varchar shipment_id, event_id % 5 in (0, 1, 3) ai_found, event_id % 4 in (0, 2) human_found, case when event_id % 3 <> 0 then cast(cast("value" as decimal(18,4)) as double) end ai_dollars,
 case when event_id % 5 in (0, 1, 3) then case when event_id % 4 in (0, 2) then 'TP' else 'FP' end when event_id % 4 in (0, 2) then 'FN' else 'TN' end outcome from events""",
)
def _(t):
    raw = t.table("events").selectExpr(
        "cast(event_id as string) shipment_id", "cast(user_id as string) tracking_number", "element_at(array('1', ' True', 'no', 'T ', ''), cast(1 + event_id % 5 as int)) ai_found_discrepancy",
        "event_type ai_discrepancy_type", "case when event_id % 3 <> 0 then cast(cast(value as decimal(18,4)) as string) else '' end ai_dollar_impact",
        "element_at(array('yes', '0', 'Y', 'maybe'), cast(1 + event_id % 4 as int)) human_found_discrepancy", "'' human_discrepancy_type", "cast(null as string) human_dollar_impact",
    )
    return st.study_records(raw).selectExpr("shipment_id", "ai_found", "human_found", "cast(ai_dollars as double) ai_dollars", "outcome")


@query(
    "f27_weekly_pairs",
    """with d as (select o_orderkey doc_id, date '2024-01-01' + cast(o_orderkey % 500 as int) d from orders)
 select doc_id, strftime(d, '%Y-%m-%d') AS "week", (doc_id % 20 + 0.5)::double pct from d union all select doc_id, strftime(d + 7, '%Y-%m-%d'), 9.0 from d""",
)
def _(t):
    day = "date_add(date'2024-01-01', cast(o_orderkey % 500 as int))"
    text = f"""concat('Week of ', date_format({day}, 'M/d/yyyy'), ' was 3% and ', date_format({day}, 'yyyy-MM-dd'), ' the rate\\nis ', cast(o_orderkey % 20 as string), '.5 % then ', date_format(date_add({day}, 7), 'MM/dd/yyyy'), ': 9%')"""
    return mt.weekly_pairs(t.table("orders").selectExpr("o_orderkey doc_id", f"{text} text")).select("doc_id", "week", F.col("pct").cast("double").alias("pct"))
