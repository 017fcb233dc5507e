"""Scalar clean-up and source mapping over text columns derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarifflume.catalog import oracle_views as ov
from tarifflume.catalog.registry import query
from tarifflume.functions import labels as lb, values as v
from tarifflume.functions.services import service_pair
from tarifflume.operators import checks as ck, rollups as ru
from tarifflume.sources import extractions as ex, invoices as inv, reference as rf


def _pick(names: list[str], key: str) -> str:
    """SQL of both engines: the name at position key modulo length (1-based arrays)."""
    return "array(" + ", ".join("'" + n.replace("'", "\\'") + "'" for n in names) + f")[cast({key} % {len(names)} as int)]"


def _pick_sql(names: list[str], key: str) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + f"][1 + {key} % {len(names)}]"


@query(
    "f1_to_number",
    """select l_orderkey k, l_linenumber n, l_partkey p, case l_partkey % 6 when 3 then null when 4 then null when 5 then cast(-l_linenumber as double) else cast(cast(l_extendedprice as decimal(12,2)) as double) end "value" from lineitem""",
)
def _(t):
    text = """case l_partkey % 6 when 0 then concat('$', cast(cast(l_extendedprice as decimal(12,2)) as string)) when 1 then concat(' ', format_number(cast(l_extendedprice as decimal(12,2)), 2), ' ')
      when 2 then cast(cast(l_extendedprice as decimal(12,2)) as string) when 3 then ' ' when 4 then concat(cast(l_orderkey as string), ' lbs') else concat('-', cast(l_linenumber as string)) end"""
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), v.to_number(F.expr(text)).cast("double").alias("value")
    )


@query(
    "f2_f34_parse_date",
    """select o_orderkey k, case when o_orderkey % 8 in (6, 7) then null else strftime(cast(o_orderdate as date), '%Y-%m-%d') end parsed,
 case when o_orderkey % 8 = 0 then strftime(cast(o_orderdate as date), '%Y-%m-%d') end iso from orders""",
)
def _(t):
    d = "cast(o_orderdate as date)"
    text = f"""case o_orderkey % 8 when 0 then date_format({d}, 'yyyy-MM-dd') when 1 then date_format({d}, 'MM/dd/yyyy') when 2 then date_format({d}, 'M/d/yy') when 3 then date_format({d}, 'MMM d, yyyy')
      when 4 then upper(date_format({d}, 'MMMM dd, yyyy')) when 5 then concat(' ', date_format({d}, 'MMMM d, yyyy'), ' ') when 6 then concat('on ', date_format({d}, 'MM/dd/yyyy')) else '13/45/2024' end"""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.table("orders").withColumn("x", F.expr(text)).select(F.col("o_orderkey").alias("k"), day(v.parse_date(F.col("x"))).alias("parsed"), day(v.iso_date(F.col("x"))).alias("iso"))


_HEADERS = ["Tracking ID", " Ship-Date ", "service_code", "TOTAL  Billed ($)", "Recipient ZIP", "Net Charge!"]


@query(
    "f3_f4_headers_and_first_value",
    f"""with h as (select l_orderkey k, l_linenumber n, l_partkey p, {_pick_sql(_HEADERS, 'l_partkey')} h, case when l_partkey % 3 = 0 then ' ' when l_partkey % 3 = 1 then null else ' a ' end a, case when l_orderkey % 2 = 0 then 'b ' else '' end b from lineitem)
 select k, n, p, trim(regexp_replace(lower(h), '[^a-z0-9]+', ' ', 'g')) header_key, case when trim(a) <> '' then a when trim(b) <> '' then b end first_value from h""",
)
def _(t):
    rows = t.table("lineitem").selectExpr(
        "l_orderkey k", "l_linenumber n", "l_partkey p", f"{_pick(_HEADERS, 'l_partkey')} h", "case when l_partkey % 3 = 0 then ' ' when l_partkey % 3 = 1 then null else ' a ' end a", "case when l_orderkey % 2 = 0 then 'b ' else '' end b"
    )
    return rows.select("k", "n", "p", v.header_key(F.col("h")).alias("header_key"), v.first_non_blank(F.col("a"), F.col("b")).alias("first_value"))


_SERVICE_TEXT = ["FedEx Ground", "fedex 2day am", "Ground Economy", "UPS Next Day Air Early A.M.", "NDA saver", "Standard Overnight", " Home Delivery ", "2DA AM", "SurePost", "freight", "", "FedEx International Economy", "express saver pak", "fedex_ground"]


@query(
    "f5_service_code",
    f"""with s as (select l_orderkey k, l_linenumber n, l_partkey p, {_pick_sql(_SERVICE_TEXT, '(l_partkey + l_linenumber)')} s, case l_suppkey % 3 when 0 then 'fedex' when 1 then 'ups' else 'dhl' end c from lineitem)
 select k, n, p, {ov.service_case('s', 'c', 0)} service_code, {ov.service_case('s', 'c', 1)} service_group from s""",
)
def _(t):
    rows = t.table("lineitem").selectExpr(
        "l_orderkey k", "l_linenumber n", "l_partkey p", f"{_pick(_SERVICE_TEXT, '(l_partkey + l_linenumber)')} s", "case l_suppkey % 3 when 0 then 'fedex' when 1 then 'ups' else 'dhl' end c"
    )
    return rows.withColumn("x", service_pair(F.col("s"), F.col("c"))).select("k", "n", "p", F.col("x.code").alias("service_code"), F.col("x.grp").alias("service_group"))


@query(
    "f8_f12_slug_zip_dim_effective",
    f"""with {ov.LINES} select l_orderkey k, l_linenumber n, l_partkey p, carrier slug, case l_partkey % 4 when 0 then '00000' when 1 then lpad((l_partkey % 1000)::varchar, 5, '0') else lpad((l_partkey % 100000)::varchar, 5, '0') end zip_key,
 cast((cast(ceil(length) * ceil(width) * ceil(height) as bigint) + 138) // 139 as bigint) dim_lbs, cast(greatest(actual_weight_lbs, (cast(ceil(length) * ceil(width) * ceil(height) as bigint) + 138) // 139) as double) rated_lbs,
 case when l_orderkey % 3 = 0 then 'reviewed' when l_orderkey % 3 = 1 then 'raw' end effective from line""",
)
def _(t):
    zips = "case l_partkey % 4 when 0 then null when 1 then cast(l_partkey % 1000 as string) else concat(lpad(cast(l_partkey % 100000 as string), 5, '0'), '-1234') end"
    rows = t.invoice_line.withColumn("z", F.expr(zips))
    dim = v.dim_weight(F.col("length"), F.col("width"), F.col("height"), F.lit(139))
    return rows.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), v.slug(F.concat(F.lit(" "), F.upper("carrier"))).alias("slug"), v.zip5(F.col("z")).alias("zip_key"),
        dim.alias("dim_lbs"), v.rated_weight(F.col("actual_weight_lbs"), dim).cast("double").alias("rated_lbs"),
        v.effective(F.expr("case when l_orderkey % 3 = 0 then 'reviewed' end"), F.expr("case when l_orderkey % 3 < 2 then 'raw' end")).alias("effective"),
    )


@query(
    "f13_company_key",
    """select c_custkey k, case when c_custkey % 5 = 0 then 'unknown company' else 'acme ' || c_custkey::varchar || ' co ltd' end company_key from customer""",
)
def _(t):
    name = "case when c_custkey % 10 = 0 then null when c_custkey % 10 = 5 then '  ' when c_custkey % 2 = 0 then concat('ACME  ', cast(c_custkey as string), ' & Co., Ltd.') else concat(' Acme-', cast(c_custkey as string), '/co (LTD)') end"
    return t.table("customer").select(F.col("c_custkey").alias("k"), v.company_key(F.expr(name)).alias("company_key"))


_LABELS = ["FedEx  Ground", "Ground", "UPS Next Day Air Saver", "Priority Overnight!", "ups surepost", "Air Freight (heavy)", "", "***", "FedEx First Overnight"]


@query(
    "f14_canonical_service",
    f"""with s as (select l_orderkey k, l_linenumber n, l_partkey p, {_pick_sql(_LABELS, '(l_partkey + l_linenumber)')} s, ['fedex', 'ups', 'unknown'][1 + l_suppkey % 3] vendor from lineitem)
 select k, n, p, case s when '' then null when 'FedEx  Ground' then 'fedex_ground' when 'Ground' then 'ground' when 'UPS Next Day Air Saver' then 'ups_next_day_air' when 'ups surepost' then 'ups_surepost' when '***' then null
  when 'Priority Overnight!' then case when vendor = 'unknown' then '' else vendor || '_' end || 'priority_overnight' when 'Air Freight (heavy)' then case when vendor = 'unknown' then '' else vendor || '_' end || 'air_freight_heavy'
  else case when vendor = 'ups' then 'ups_' else '' end || 'fedex_first_overnight' end canonical,
 case when s = '' then 0.0 when s in ('FedEx  Ground', 'Ground', 'ups surepost') then 0.95 when s = 'UPS Next Day Air Saver' then 0.88 when s = '***' or vendor = 'unknown' then 0.35 else 0.45 end::double confidence from s""",
)
def _(t):
    rows = t.table("lineitem").selectExpr("l_orderkey k", "l_linenumber n", "l_partkey p", f"{_pick(_LABELS, '(l_partkey + l_linenumber)')} s", "array('fedex', 'ups', 'unknown')[cast(l_suppkey % 3 as int)] vendor")
    return rows.withColumn("x", lb.canonical_service(F.col("s"), F.col("vendor"))).select("k", "n", "p", F.col("x.name").alias("canonical"), F.col("x.confidence").alias("confidence"))


@query(
    "f15_percent_value",
    """with r as (select l_orderkey k, l_linenumber n, l_partkey p, cast(l_quantity as int) q, l_partkey % 8 c from lineitem)
 select k, n, p, case c when 0 then 'percent' when 1 then 'unknown' when 2 then 'percent' when 3 then case when q <= 1 then 'fraction' else 'percent' end when 4 then 'fraction' when 5 then 'percent' else 'unknown' end unit,
 case c when 0 then q + 0.5 when 2 then q when 3 then case when q <= 1 then q * 100 else q end when 4 then 25 when 5 then round(100.0 * q / 64, 6) end::double "value",
 case c when 0 then 0.9 when 1 then 0.2 when 2 then 0.9 when 3 then case when q <= 1 then 0.5 else 0.65 end when 4 then 0.5 when 5 then 0.55 when 6 then 0.0 else 0.2 end::double confidence from r""",
)
def _(t):
    q = "cast(cast(l_quantity as int) as string)"
    text = f"case l_partkey % 8 when 0 then concat(' save ', {q}, '.5 percent ') when 1 then concat({q}, '% off') when 2 then concat({q}, '%off') when 3 then {q} when 4 then '0.25' when 5 then concat('rate ', {q}, ' / 64') when 6 then ' ' else 'none' end"
    rows = t.table("lineitem").withColumn("x", lb.percent_value(F.expr(text)))
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), "x.unit", "x.value", "x.confidence")


@query(
    "f16_weight_range",
    """with r as (select l_orderkey k, l_linenumber n, l_partkey p, cast(l_quantity as int) q, l_partkey % 6 c from lineitem)
 select k, n, p, case c when 0 then 5 when 1 then 1.5 when 2 then q when 3 then q end::double lo, case c when 0 then q when 1 then q when 2 then q when 3 then 10 end::double hi,
 case c when 0 then 'lb' when 1 then 'kg' when 2 then 'oz' when 3 then 'lb' end unit, case c when 0 then case when 5 <= q then 0.85 else 0.3 end when 1 then case when 1.5 <= q then 0.85 else 0.3 end when 2 then 0.6 when 3 then case when q <= 10 then 0.85 else 0.3 end when 4 then 0.25 else 0.0 end::double confidence from r""",
)
def _(t):
    q = "cast(cast(l_quantity as int) as string)"
    text = f"case l_partkey % 6 when 0 then concat('5 - ', {q}, ' lbs') when 1 then concat('from 1.5  to ', {q}, 'KGS') when 2 then concat({q}, ' oz') when 3 then concat({q}, ' through 10') when 4 then 'all weights' else '' end"
    rows = t.table("lineitem").withColumn("x", lb.weight_range(F.expr(text)))
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), "x.lo", "x.hi", "x.unit", "x.confidence")


_COMPANIES = ["ArmoireLLC", "UPSHC_GlobexInc.", "Do not pay this bill Inc", "the long way", "Nine words are far too many for one name", "Blue Bird", "Acme (west)", "Delta Holdings of the World", "AB", "invoice number 5 LLC"]


@query(
    "f17_clean_company",
    f"""with c as (select c_custkey k, {_pick_sql(_COMPANIES, 'c_custkey')} || ' ' || c_mktsegment s from customer),
 a as (select k, regexp_replace(s, '^UPSHC[-_]', '', 'i') s from c), b as (select k, regexp_replace(s, '([a-z])([A-Z])', '\\1 \\2', 'g') s from a),
 d as (select k, regexp_replace(s, '([a-zA-Z])(LLC|INC|CORP|LTD|CO|LP)\\b', '\\1 \\2', 'g') s from b), e as (select k, regexp_replace(s, '([a-zA-Z])(Inc|Corp|Ltd)\\.', '\\1 \\2.', 'g') s from d)
 select k, trim(regexp_replace(s, '\\s{{2,}}', ' ', 'g')) company from e""",
)
def _(t):
    rows = t.table("customer").selectExpr("c_custkey k", f"concat({_pick(_COMPANIES, 'c_custkey')}, ' ', c_mktsegment) raw")
    return rows.select("k", lb.clean_company(F.col("raw")).alias("company"))


@query(
    "f18_f19_company_and_account_checks",
    f"""with c as (select c_custkey k, {_pick_sql(_COMPANIES, 'c_custkey')} s from customer) select k, s in ('ArmoireLLC', 'UPSHC_GlobexInc.', 'Blue Bird', 'Delta Holdings of the World') valid_company,
 k % 3 <> 1 and length('AC' || (k * 1000)::varchar) >= 6 and k % 3 = 0 account_like from c""",
)
def _(t):
    rows = t.table("customer").selectExpr("c_custkey k", f"{_pick(_COMPANIES, 'c_custkey')} s", "case c_custkey % 3 when 0 then concat(' AC', cast(c_custkey * 1000 as string)) when 1 then null else 'Invoice' end acct")
    return rows.select("k", lb.valid_company(F.col("s")).alias("valid_company"), lb.account_like(F.col("acct")).alias("account_like"))


@query(
    "f20_f21_list_keys",
    """select c_custkey k, lower(c_mktsegment) || '|' || 'b ' || c_custkey::varchar list_key, case when lower(c_mktsegment) < 'b ' || c_custkey::varchar then lower(c_mktsegment) || '|' || 'b ' || c_custkey::varchar else 'b ' || c_custkey::varchar || '|' || lower(c_mktsegment) end dim_key, lower(c_mktsegment) text_key from customer""",
)
def _(t):
    parts = F.array(F.concat(F.lit(" "), F.col("c_mktsegment")), F.concat(F.lit("B "), F.col("c_custkey").cast("string")))
    return t.table("customer").select(
        F.col("c_custkey").alias("k"), v.list_key(parts).alias("list_key"), v.list_key(parts, ordered=True).alias("dim_key"), v.text_key(F.concat(F.col("c_mktsegment"), F.lit(" "))).alias("text_key")
    )


@query(
    "f22_f24_f33_flags_and_bands",
    """select event_id k, event_id % 6 in (0, 1, 2) truthy, event_id % 6 in (0, 1) ui_truthy, case when "value" >= 85 then 'high' when "value" >= 70 then 'mid' else 'low' end band, event_id % 4 = 0 filled, event_id % 3 = 2 filled_list from events""",
)
def _(t):
    rows = t.table("events").selectExpr(
        "event_id k", "array(' Yes', '1', 't', 'no', '', null)[cast(event_id % 6 as int)] flag", "value", "array('x', '  ', null, '')[cast(event_id % 4 as int)] s", "case event_id % 3 when 0 then array() when 1 then null else array('a') end arr"
    )
    return rows.select(
        "k", v.truthy(F.col("flag")).alias("truthy"), v.truthy(F.col("flag"), accept_t=False).alias("ui_truthy"), v.confidence_band(F.expr("cast(cast(value as decimal(12,2)) * 0.01 as decimal(12,4))")).alias("band"),
        v.filled(F.col("s")).alias("filled"), v.filled_list(F.col("arr")).alias("filled_list"),
    )


@query("f23_week_start", "select o_orderkey k, strftime(cast(date_trunc('week', o_orderdate) as date), '%Y-%m-%d') monday from orders")
def _(t):
    return t.table("orders").select(F.col("o_orderkey").alias("k"), F.date_format(v.week_start(F.col("o_orderdate").cast("date")), "yyyy-MM-dd").alias("monday"))


@query(
    "f25_lenient_json",
    """select event_id k, case when event_id % 3 = 2 then null else cast(json_extract_string(props, '$.k') as bigint) end k_value from events""",
)
def _(t):
    text = "case event_id % 3 when 0 then props when 1 then concat('Here you are: ', props, ' - done') else 'no json here' end"
    return t.table("events").select(F.col("event_id").alias("k"), F.try_variant_get(lb.lenient_json(F.expr(text)), "$.k", "bigint").alias("k_value"))


@query(
    "f28_f29_header_lines",
    r"""with x as (select doc_id, case doc_id % 5 when 0 then 'Section 4 rates' || chr(10) when 1 then chr(10) || '12. Terms' || chr(10) when 2 then 'hello' || chr(10) || 'ZONE RATES' || chr(10) when 3 then 'zones:' || chr(10) else '' end || "text" x, string_split("text", chr(10))[1] l from documents),
 y as (select *, list_filter(list_transform(regexp_split_to_array(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(10)), lambda a: regexp_replace(a, '^\s+|\s+$', '', 'g')), lambda a: regexp_matches(a, '(?i)^(SECTION|ARTICLE|PART|SCHEDULE|EXHIBIT|APPENDIX|AMENDMENT)\s') or regexp_matches(a, '^\d+\.\s+[A-Z]') or regexp_matches(a, '^[A-Z][A-Z\s]{5,}$')) hits from x)
 select doc_id, hits[1] section_header, length(trim(l)) >= 3 and (regexp_matches(trim(l), '^\d+(\.\d+)*\s+[A-Z]') or (regexp_matches(trim(l), '^[A-Z][A-Z0-9\s\-&/,\.]{2,60}$') and length(trim(l)) <= 80) or (regexp_matches(trim(l), '^.{5,}:$') and length(trim(l)) <= 80)) ocr_header from y""",
)
def _(t):
    lead = "concat(case doc_id % 5 when 0 then 'Section 4 rates\\n' when 1 then '\\n12. Terms\\n' when 2 then 'hello\\nZONE RATES\\n' when 3 then 'zones:\\n' else '' end, text)"
    return t.table("documents").select(
        "doc_id", lb.section_header(F.expr(lead)).alias("section_header"), lb.ocr_header(F.expr("split(text, '\\n')[0]")).alias("ocr_header")
    )


@query(
    "f30_path_parts",
    """select c_custkey k, case c_custkey % 3 when 0 then 'metadata' when 1 then 'service_terms' else 'amendments[1].modified_surcharges' end entity, case when c_custkey % 3 <> 0 then c_custkey % 50 end ord,
 case c_custkey % 3 when 0 then 'customer_name' when 1 then 'discount_percentage' else 'application' end field from customer""",
)
def _(t):
    path = "case c_custkey % 3 when 0 then 'metadata.customer_name' when 1 then concat('service_terms[', cast(c_custkey % 50 as string), '].discount_percentage') else concat('amendments[1].modified_surcharges[', cast(c_custkey % 50 as string), '].application') end"
    return t.table("customer").withColumn("x", lb.path_parts(F.expr(path))).select(F.col("c_custkey").alias("k"), "x.entity", "x.ord", "x.field")


@query(
    "f35_dated_text",
    r"""with t as (select o_orderkey k, case o_orderkey % 4 when 0 then 'as of ' || strftime(o_orderdate::date, '%B %-d, %Y') when 1 then 'Monday after signing' when 2 then '13/45/2024' else strftime(o_orderdate::date, '%-m/%-d/%Y') end s from orders),
 w as (select k, regexp_extract(s, '(?i)((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})', 1) d from t)
 select k, d <> '' and coalesce(try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%Y-%m-%d'), try_strptime(replace(d, ',', ''), '%B %d %Y')) is not null parseable from w""",
)
def _(t):
    text = "case o_orderkey % 4 when 0 then concat('as of ', date_format(o_orderdate, 'MMMM d, yyyy')) when 1 then 'Monday after signing' when 2 then '13/45/2024' else date_format(o_orderdate, 'M/d/yyyy') end"
    return t.table("orders").select(F.col("o_orderkey").alias("k"), lb.dated(F.expr(text)).alias("parseable"))


# ---------------------------------------------------------------- sources


@query(
    "s1_canonical_csv",
    f"""with {ov.LINES}, c as (select *, case when l_partkey % 5 = 0 then '' else service_code end raw from line)
 select line_id, agreement_id || '-' || l_partkey::varchar rid, trim(tracking_number) = '' blank_tracking, strftime(ship_date, '%Y-%m-%d') ship_date, coalesce({ov.service_case('raw', "'fedex'", 0)}, '') service_code, service_group, cast(rated_weight_lbs as double) rated_weight_lbs,
 cast(case when l_orderkey % 3 = 0 then cast(total_billed as decimal(18,2)) else 0 end as double) billed_amount, cast(case when l_orderkey % 3 = 0 then cast(total_billed as decimal(18,2)) else 0 end as double) total_billed from c""",
)
def _(t):
    raw = t.invoice_line.selectExpr(
        "line_id `ID`", "concat(cast(agreement_id as string), '-', cast(l_partkey as string)) `Invoice ID`", "tracking_number `tracking_number`", "date_format(ship_date, 'MM/dd/yyyy') `Ship Date`",
        "case when l_partkey % 5 = 0 then '' else service_code end `service_code`", "service_group", "cast(rated_weight_lbs as string) `Rated Weight lbs`", "'' billed_amount",
        "case when l_orderkey % 3 = 0 then concat('$', cast(cast(total_billed as decimal(18,2)) as string)) else '' end `Total Billed`", "'f.csv' _file", "l_orderkey _row",
    )
    return inv.csv_lines(raw, "fedex").selectExpr(
        "line_id", "invoice_id rid", "trim(tracking_number) = '' blank_tracking", "date_format(ship_date, 'yyyy-MM-dd') ship_date", "coalesce(service_code, '') service_code", "service_group",
        "cast(rated_weight_lbs as double) rated_weight_lbs", "cast(billed_amount as double) billed_amount", "cast(total_billed as double) total_billed",
    )


@query(
    "s2_carrier_csv",
    f"""with {ov.LINES} select carrier, carrier || '.csv:' || l_orderkey::varchar || l_linenumber::varchar || '_' || l_partkey::varchar line_id, strftime(ship_date, '%Y-%m-%d') ship_date, strftime(ship_date + 2, '%Y-%m-%d %H:%M:%S') delivered,
 case when carrier = 'fedex' then 'fedex_home_delivery' else 'ups_ground_saver' end service_code, destination_zip, "zone", cast(case when carrier = 'fedex' then rated_weight_lbs end as double) rated_weight_lbs,
 cast(case when carrier = 'ups' then cast(published_charge as decimal(18,2)) end as double) published_charge, cast(cast(fuel_surcharge_billed as decimal(18,2)) as double) fuel_surcharge_billed,
 cast(case when l_orderkey % 2 = 0 then cast(net_transport_charge as decimal(18,2)) else cast(published_charge as decimal(18,2)) + cast(fuel_surcharge_billed as decimal(18,2)) end as double) total_billed from line""",
)
def _(t):
    lines = t.invoice_line.withColumn("_file", F.expr("concat(carrier, '.csv')")).withColumn("_row", F.expr("concat(cast(l_orderkey as string), cast(l_linenumber as string), '_', cast(l_partkey as string))"))
    common = ["date_format(ship_date, 'M/d/yyyy') `Ship Date`", "date_format(date_add(ship_date, 2), 'yyyy-MM-dd') `Delivery Date`", "cast(zone as string) `Zone`", "cast(cast(fuel_surcharge_billed as decimal(18,2)) as string) `Fuel Surcharge`"]
    fedex = lines.where("carrier = 'fedex'").selectExpr(
        *common, "tracking_number `Tracking ID`", "'Home Delivery' `Service Type`", "concat(destination_zip, '-0001') `Recipient ZIP`", "cast(rated_weight_lbs as string) `Billed Weight`",
        "cast(cast(published_charge as decimal(18,2)) as string) `Transportation Charge`", "case when l_orderkey % 2 = 0 then cast(cast(net_transport_charge as decimal(18,2)) as string) else '' end `Net Charge`", "_file", "_row")
    ups = lines.where("carrier = 'ups'").selectExpr(
        *common, "tracking_number `Tracking Number`", "'surepost' `Service`", "destination_zip `Ship To Zip`", "cast(cast(published_charge as decimal(18,2)) as string) `Published Charge`",
        "'' `Incentive`", "case when l_orderkey % 2 = 0 then cast(cast(net_transport_charge as decimal(18,2)) as string) else '' end `Billed Charge`", "_file", "_row")
    both = inv.csv_lines(fedex, "ups").withColumn("carrier", F.lit("fedex")).unionByName(inv.csv_lines(ups, "fedex").withColumn("carrier", F.lit("ups")))
    return both.selectExpr(
        "carrier", "line_id", "date_format(ship_date, 'yyyy-MM-dd') ship_date", "date_format(actual_delivery_datetime, 'yyyy-MM-dd HH:mm:ss') delivered", "service_code", "destination_zip", "zone",
        *[f"cast({c} as double) {c}" for c in ("rated_weight_lbs", "published_charge", "fuel_surcharge_billed", "total_billed")],
    )


@query(
    "s3_header_dialect",
    "select c_custkey k, case when c_custkey % 4 = 0 then 'fedex' when c_custkey % 4 = 1 then 'ups' when c_custkey % 3 = 0 then 'ups' else 'fedex' end carrier from customer",
)
def _(t):
    heads = "case c_custkey % 4 when 0 then array('tracking id', 'zone', 'service type') when 1 then array('published charge', 'incentive', 'tracking id') when 2 then array('zone') else array('tracking number', 'service type') end"
    hint = F.expr("case when c_custkey % 3 = 0 then 'ups' else 'fedex' end")
    return t.table("customer").select(F.col("c_custkey").alias("k"), inv.carrier_of_headers(F.expr(heads), hint).alias("carrier"))


@query(
    "s4_payload_lines",
    f"""with {ov.LINES} select 'P' || l_orderkey::varchar || '_' || l_partkey::varchar || '_' || l_linenumber::varchar || '_' || agreement_id::varchar invoice, case when l_partkey % 3 = 0 then 'P' || l_orderkey::varchar || '_' || l_partkey::varchar || '_' || l_linenumber::varchar || '_' || agreement_id::varchar || ':1' else line_id end line_id,
 case when l_partkey % 2 = 0 then '1Z' || l_orderkey::varchar else transaction_id end tracking_number, strftime(ship_date, '%Y-%m-%d') ship_date, cast(total_billed as double) total_billed, 'Unknown' service_or_charge_type from line""",
)
def _(t):
    item = """concat('{', case when l_partkey % 3 = 0 then '' else concat('"id": "', line_id, '", ') end, case when l_partkey % 2 = 0 then concat('"tracking_number": "1Z', cast(l_orderkey as string), '", ') else '' end,
      '"transaction_id": "', transaction_id, '", "ship_date": "', date_format(ship_date, 'yyyy-MM-dd'), '", "total_billed": ', cast(total_billed as string), '}')"""
    bodies = t.invoice_line.selectExpr("concat_ws('_', concat('P', cast(l_orderkey as string)), l_partkey, l_linenumber, agreement_id) invoice", f"concat('{{\"line_items\": [', {item}, ', \"skipped\", 7]}}') body")
    return inv.payload_lines(bodies).selectExpr("invoice", "line_id", "tracking_number", "date_format(ship_date, 'yyyy-MM-dd') ship_date", "cast(total_billed as double) total_billed", "service_or_charge_type")


@query("s8_area_zips", f"with {ov.ZIPS} select carrier, zip, tier from area")
def _(t):
    raw = t.table("part").where("p_partkey % 3 <> 1").selectExpr(
        "explode(array('fedex', 'ups')) carrier_name", "concat(' ', cast(p_partkey * 37 % 100000 as string)) zip", "case when p_partkey % 2 = 0 then 'metro ' else 'rural' end tier", "p_partkey row_ord"
    ).where("carrier_name = 'fedex' or row_ord % 5 <> 0")
    return rf.area_zips(raw, F.col("carrier_name"))


@query(
    "s9_fuel_json",
    "select 'c' || (o_custkey % 3)::varchar carrier, 'k' || o_orderkey::varchar class, strftime(cast(o_orderdate as date), '%Y-%m-%d') week_start, cast(cast(10 + o_custkey % 50 * 0.25 as decimal(8,4)) as double) pct from orders",
)
def _(t):
    body = """concat('{"c', cast(o_custkey % 3 as string), '": {"k', cast(o_orderkey as string), '": {"', date_format(o_orderdate, 'yyyy-MM-dd'), '": ', cast(10 + o_custkey % 50 * 0.25 as string), '}}}')"""
    return rf.fuel_rates_from_json(t.table("orders").selectExpr(f"{body} body")).selectExpr("carrier", "class", "date_format(week_start, 'yyyy-MM-dd') week_start", "cast(pct as double) pct")


@query(
    "s10_suspension_rows",
    "select case when c_custkey % 2 = 0 then 'fedex' else 'ups' end carrier, strftime(date '2024-01-01' + cast(c_custkey % 300 as int), '%Y-%m-%d') start_day, strftime(date '2024-01-01' + cast(c_custkey % 300 + 14 as int), '%Y-%m-%d') end_day, 'peak ' || c_custkey::varchar reason from customer",
)
def _(t):
    raw = t.table("customer").selectExpr(
        "case when c_custkey % 2 = 0 then 'fedex' else 'ups' end carrier", "date_format(date_add(date'2024-01-01', cast(c_custkey % 300 as int)), 'yyyy-MM-dd') start",
        "date_format(date_add(date'2024-01-01', cast(c_custkey % 300 + 14 as int)), 'yyyy-MM-dd') `end`", "concat('peak ', cast(c_custkey as string)) reason")
    return rf.suspension_windows(raw).selectExpr("carrier", "date_format(start_date, 'yyyy-MM-dd') start_day", "date_format(end_date, 'yyyy-MM-dd') end_day", "reason")


@query(
    "s11_holiday_shipments",
    f"with {ov.LINES}, {ov.CALENDAR} select strftime(ship_date, '%Y-%m-%d') ship_day, count(*) line_count from line where ship_date in (select d from off) group by 1",
)
def _(t):
    days = rf.us_federal_holidays(t.spark, 2020, 2035)
    hit = t.invoice_line.join(F.broadcast(days), F.col("ship_date") == F.col("holiday"), "left_semi")
    return hit.groupBy(F.date_format("ship_date", "yyyy-MM-dd").alias("ship_day")).agg(F.count(F.lit(1)).alias("line_count"))


@query(
    "s12_zone_lookup",
    """with z as (select distinct lpad((p_partkey % 90)::varchar, 3, '0') o, lpad((p_partkey % 70)::varchar, 3, '0') d from part) select lpad((l_suppkey % 90)::varchar, 3, '0') origin_prefix, lpad((l_partkey % 70)::varchar, 3, '0') destination_prefix, z.o is not null known, count(*) line_count
 from lineitem left join z on z.o = lpad((l_suppkey % 90)::varchar, 3, '0') and z.d = lpad((l_partkey % 70)::varchar, 3, '0') group by all""",
)
def _(t):
    zones = t.table("part").selectExpr("lpad(cast(p_partkey % 90 as string), 3, '0') origin_prefix", "lpad(cast(p_partkey % 70 as string), 3, '0') destination_prefix", "cast(2 + p_partkey % 7 as int) zone").groupBy("origin_prefix", "destination_prefix").agg(F.max("zone").alias("zone"))
    lines = t.table("lineitem").selectExpr("lpad(cast(l_suppkey % 90 as string), 3, '0') origin_prefix", "lpad(cast(l_partkey % 70 as string), 3, '0') destination_prefix")
    counted = lines.groupBy("origin_prefix", "destination_prefix").agg(F.count(F.lit(1)).alias("line_count"))
    return counted.join(zones, ["origin_prefix", "destination_prefix"], "left").select("origin_prefix", "destination_prefix", F.col("zone").isNotNull().alias("known"), "line_count")


_STORED_SQL = """st as (select o_orderkey % 4000 id, case when o_orderkey < 4000 then 0 else 1 end * 100000 + o_orderkey // 4000 store_ord, ['approved', 'pending_review', 'rejected'][1 + o_custkey % 3] status, strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad((o_orderkey % 24)::varchar, 2, '0') ts from orders)"""


def _stored(t):
    return t.table("orders").selectExpr(
        "cast(o_orderkey % 4000 as string) id", "(case when o_orderkey < 4000 then 0 else 1 end) * 100000 + o_orderkey div 4000 store_ord", "array('approved', 'pending_review', 'rejected')[cast(o_custkey % 3 as int)] status",
        "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T', lpad(cast(o_orderkey % 24 as string), 2, '0')) extraction_timestamp",
    )


@query("s14_list_extractions", f"with {_STORED_SQL} select id::varchar id, store_ord, ts extraction_timestamp from (select *, row_number() over (partition by id order by store_ord) rn from st where status = 'approved') where rn = 1")
def _(t):
    return ex.list_extractions(_stored(t), "approved").select("id", "store_ord", "extraction_timestamp")


@query("s15_load_extraction", f"with {_STORED_SQL} select id::varchar id, store_ord, status from st where id = 7 order by store_ord limit 1")
def _(t):
    return ex.load_extraction(_stored(t), "7").select("id", "store_ord", "status")


@query(
    "s16_state_change",
    f"with {_STORED_SQL}, cur as (select * from (select *, row_number() over (partition by id order by store_ord) rn from st) where rn = 1) select case when id % 5 = 0 then 'approved' else status end status, count(*) n from cur where id % 11 <> 0 group by 1",
)
def _(t):
    current = ex.list_extractions(_stored(t))
    approved = ex.with_status(current.where("cast(id as bigint) % 5 = 0"), "approved")
    kept = ex.remove_rows(ex.replace_rows(current, approved), current.where("cast(id as bigint) % 11 = 0"))
    return kept.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s18_run_log_rows",
    f"with {ov.AGREEMENTS}, l as (select l_suppkey agreement_id, count(*) n from lineitem group by 1) select agreement_id, n lines_audited, n * 10 checks_evaluated, n * 10 - n // 3 checks_without_result, 5 reference_total from l join agreement a using (agreement_id) where a.status = 'approved'",
)
def _(t):
    lines = t.table("lineitem").groupBy(F.col("l_suppkey").alias("agreement_id")).agg(F.count(F.lit(1)).alias("lines_audited"))
    reports = inv.approved_only(t.agreement).select("agreement_id").join(lines, "agreement_id").withColumn("discrepancy_count", F.expr("lines_audited div 3"))
    return ru.run_counters(reports).select("agreement_id", "lines_audited", "checks_evaluated", "checks_without_result", F.lit(5).alias("reference_total"))


@query(
    "s19_batch_totals",
    "select count(*) files, count(*) filter (event_id % 7 <> 0) succeeded, count(*) filter (event_id % 7 = 0) failed, sum(case when event_id % 3 <> 0 then event_id % 5 else 0 end)::bigint corrections_proposed, sum(event_id % 2)::bigint corrections_accepted, count(*) filter (event_id % 4 = 1) verifier_called, count(*) filter (event_id % 7 <> 0 and event_id % 4 = 2) verifier_skipped, count(*) filter (event_id % 9 = 0) verifier_timeouts from events",
)
def _(t):
    rows = t.table("events").selectExpr(
        "case when event_id % 7 = 0 then 'bad file' end error", "case when event_id % 3 <> 0 then event_id % 5 end corrections_proposed", "event_id % 2 corrections_accepted",
        "case event_id % 4 when 1 then true when 2 then false end verifier_called", "event_id % 9 = 0 verifier_timeout")
    return ex.combine_batches(rows)


@query(
    "t8_source_union",
    f"with {ov.LINES}, {ov.AGREEMENTS} select case when l_linenumber % 2 = 0 then 0 else 1 end source_ord, count(*) line_count, cast(sum(total_billed) as double) total_billed from line join agreement a using (agreement_id) where a.status = 'approved' group by 1",
)
def _(t):
    lines = t.invoice_line.join(inv.approved_only(t.agreement).select("agreement_id"), "agreement_id", "left_semi").select("agreement_id", "line_id", "total_billed", "l_linenumber", "l_orderkey", F.lit("f").alias("_file"))
    both = inv.union_sources([
        (0, lines.where("l_linenumber % 2 = 0").drop("l_linenumber", "_file"), ["l_orderkey"]),
        (1, lines.where("l_linenumber % 2 = 1").drop("l_linenumber"), ["_file", "l_orderkey"]),
    ])
    return both.groupBy("line_seq.source_ord").agg(F.count(F.lit(1)).alias("line_count"), F.sum("total_billed").cast("double").alias("total_billed"))
