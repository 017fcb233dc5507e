"""Resolution, validation, confidence and review over terms derived from orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarifflume.catalog.registry import query
from tarifflume.functions import values as v
from tarifflume.operators import company_merge as cm, quality as qa, resolve as rs
from tarifflume.operators.positions import number_within

# ---------------------------------------------------------------- views

_SERVICE = "array(' FedEx Ground', 'fedex ground', 'UPS 2nd Day Air', '', 'Home Delivery')[cast(p % 5 as int)]"
_SERVICE_SQL = "[' FedEx Ground', 'fedex ground', 'UPS 2nd Day Air', '', 'Home Delivery'][1 + p % 5]"


def _terms(t):
    """One service term per line of an order."""
    base = t.table("lineitem").groupBy(F.col("l_orderkey").alias("extraction_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    return base.selectExpr(
        "extraction_id", "cast(n as bigint) ord", f"{_SERVICE} service_type", "case when p % 4 = 0 then null when p % 4 = 1 then array('Zone 2', ' 3 ') else array('All Zones') end zones",
        "cast(case when p % 9 = 0 then null when p % 23 = 0 then 140 else p % 3 * 10 + 0.5 end as decimal(8,4)) discount_pct", "case when s % 2 = 0 then 'Weight: 1-5' end conditions",
        "case when p % 6 = 0 then '2025-01-01' end effective_date", "cast(0.3 + (p + s) % 7 * 0.1 as decimal(6,4)) service_confidence", "cast(case when p % 9 = 0 then 0 else 0.92 end as decimal(6,4)) discount_confidence", "p", "s",
    )


TERMS = f"""tb as (select l_orderkey extraction_id, l_linenumber n, min(l_partkey) p, max(l_suppkey) s from lineitem group by 1, 2), term as (select extraction_id, n::bigint ord, {_SERVICE_SQL} service_type,
 case when p % 4 = 0 then '' when p % 4 = 1 then 'zone 2|3' else 'all zones' end zone_key, cast(case when p % 9 = 0 then null when p % 23 = 0 then 140 else p % 3 * 10 + 0.5 end as decimal(8,4)) discount_pct, case when s % 2 = 0 then 'Weight: 1-5' end conditions,
 case when p % 6 = 0 then '2025-01-01' end effective_date, cast(0.3 + (p + s) % 7 * 0.1 as decimal(6,4)) service_confidence, cast(case when p % 9 = 0 then 0 else 0.92 end as decimal(6,4)) discount_confidence, p, s from tb)"""


def _metadata(t):
    fields = """explode(array(named_struct('field_name', 'customer_name', 'value', case when o_custkey % 6 = 0 then null else concat('Cust ', cast(o_custkey as string)) end),
      named_struct('field_name', 'account_number', 'value', case when o_custkey % 5 = 0 then '' when o_custkey % 5 = 1 then 'abc' else concat('AC', cast(o_custkey as string), '99') end),
      named_struct('field_name', 'agreement_number', 'value', cast(o_orderkey as string)), named_struct('field_name', 'effective_date', 'value', case when o_orderkey % 4 = 0 then 'soon' else date_format(o_orderdate, 'yyyy-MM-dd') end),
      named_struct('field_name', 'carrier', 'value', array('FedEx', 'UPS', 'Unknown')[cast(o_custkey % 3 as int)]), named_struct('field_name', 'payment_terms', 'value', case when o_orderkey % 2 = 0 then 'Net 30 days' end))) f"""
    return t.table("orders").selectExpr("o_orderkey extraction_id", "o_custkey", fields).selectExpr(
        "extraction_id", "concat('metadata.', f.field_name) field_path", "'metadata' entity", "cast(null as int) ord", "f.field_name", "f.value", "cast(null as double) value_num",
        "cast(case when f.value is null then 0 else 0.3 + (extraction_id + length(f.field_name)) % 13 * 0.05 end as decimal(6,4)) confidence", "case when extraction_id % 3 <> 0 then 1 end source_page",
        "case when extraction_id % 7 = 0 then '' else concat('near ', f.field_name) end source_text", "o_custkey % 11 = 0 needs_review", "cast(null as string) override",
    )


META = """meta as (select o_orderkey extraction_id, o_custkey, f.field_name, f."value", cast(case when f."value" is null then 0 else 0.3 + (o_orderkey + length(f.field_name)) % 13 * 0.05 end as decimal(6,4)) confidence,
 case when o_orderkey % 3 <> 0 then 1 end source_page, case when o_orderkey % 7 = 0 then '' else 'near ' || f.field_name end source_text, o_custkey % 11 = 0 needs_review
 from (select *, unnest([{'field_name': 'customer_name', 'value': case when o_custkey % 6 = 0 then null else 'Cust ' || o_custkey::varchar end}, {'field_name': 'account_number', 'value': case when o_custkey % 5 = 0 then '' when o_custkey % 5 = 1 then 'abc' else 'AC' || o_custkey::varchar || '99' end},
  {'field_name': 'agreement_number', 'value': o_orderkey::varchar}, {'field_name': 'effective_date', 'value': case when o_orderkey % 4 = 0 then 'soon' else strftime(o_orderdate, '%Y-%m-%d') end},
  {'field_name': 'carrier', 'value': ['FedEx', 'UPS', 'Unknown'][1 + o_custkey % 3]}, {'field_name': 'payment_terms', 'value': case when o_orderkey % 2 = 0 then 'Net 30 days' end}]) f from orders))"""


def _surcharges(t):
    return _terms(t).where("ord > 4").selectExpr(
        "extraction_id", "ord", "case when p % 7 = 0 then null else concat('Fee ', cast(s as string)) end surcharge_name", "case when p % 5 = 0 then '' else '- 5%' end modification", "cast(case when p % 7 = 0 then 0 else 0.9 end as decimal(6,4)) name_confidence")


def _dims(t):
    return _terms(t).where("ord = 2").selectExpr("extraction_id", "ord", "case when p % 3 = 0 then null else 139.0 end dim_divisor", "cast(0.9 as decimal(6,4)) divisor_confidence")


ISSUES = f"""{TERMS}, {META}, iss as (select extraction_id, null::bigint entity_id, field_name field, 'METADATA_MISSING_CUSTOMER' code, 'warning' severity from meta where field_name = 'customer_name' and "value" is null
 union all select extraction_id, null, field_name, 'METADATA_MISSING_ACCOUNT', 'warning' from meta where field_name = 'account_number' and "value" = ''
 union all select extraction_id, null, field_name, 'METADATA_MISSING_CARRIER', 'warning' from meta where field_name = 'carrier' and "value" = 'Unknown'
 union all select extraction_id, null, field_name, 'METADATA_LOW_CONFIDENCE', 'info' from meta where field_name <> 'payment_terms' and "value" is not null and confidence < 0.5
 union all select o_orderkey, null, null, 'NO_SERVICE_TERMS', 'warning' from orders where o_orderkey not in (select l_orderkey from lineitem)
 union all select extraction_id, ord, null, 'SERVICE_TERM_MISSING_TYPE', 'warning' from term where service_type = ''
 union all select extraction_id, ord, null, 'SERVICE_TERM_MISSING_DISCOUNT', 'info' from term where discount_pct is null
 union all select extraction_id, ord, null, 'INCONSISTENT_PERCENT_RANGE', 'error' from term where discount_pct > 100
 union all select extraction_id, ord, null, 'SERVICE_TERM_LOW_CONFIDENCE', 'info' from term where service_confidence < 0.5
 union all select extraction_id, ord, null, 'DUPLICATE_SERVICE_TERM', 'info' from (select *, row_number() over (partition by extraction_id, lower(trim(service_type)) order by ord) rn from term where service_type <> '') where rn > 1
 union all select extraction_id, ord, null, 'SURCHARGE_MISSING_NAME', 'warning' from term where ord > 4 and p % 7 = 0
 union all select extraction_id, ord, null, 'SURCHARGE_MISSING_MODIFICATION', 'info' from term where ord > 4 and p % 5 = 0
 union all select extraction_id, ord, null, 'DIM_RULE_MISSING_DIVISOR', 'warning' from term where ord = 2 and p % 3 = 0)"""


def _issues(t):
    return qa.validate(_metadata(t), _terms(t), _surcharges(t), _dims(t))


# ---------------------------------------------------------------- validation and confidence


@query("v1_validation_issues", f"with {ISSUES} select * from iss")
def _(t):
    return _issues(t).select("extraction_id", "entity_id", "field", "code", "severity")


@query(
    "v2_issue_summary",
    f"with {ISSUES}, c as (select extraction_id, code, severity, count(*) n from iss group by all) select extraction_id, sum(n)::bigint total_issues, coalesce(sum(n) filter (severity = 'error'), 0)::bigint errors, coalesce(sum(n) filter (severity = 'warning'), 0)::bigint warnings, coalesce(sum(n) filter (severity = 'info'), 0)::bigint infos, string_agg(code || '=' || n::varchar, ',' order by code) codes from c group by 1",
)
def _(t):
    text = F.array_join(F.array_sort(F.transform(F.map_entries("codes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return qa.summarize(_issues(t)).select("extraction_id", "total_issues", "errors", "warnings", "infos", text.alias("codes"))


@query(
    "v3_document_confidence",
    f"""with {ISSUES}, parts as (select extraction_id, case when confidence > 0 then confidence else 0 end s, (confidence > 0)::int n, ("value" is not null)::int::decimal(6,4) pts, 1 slots from meta where field_name <> 'payment_terms'
 union all select extraction_id, service_confidence + discount_confidence, 1 + (discount_confidence > 0)::int, case when service_type <> '' and discount_pct is not null then 1 when service_type <> '' then 0.5 else 0 end, 1 from term
 union all select extraction_id, case when p % 7 = 0 then 0 else 0.9 end, (p % 7 <> 0)::int, case when p % 7 = 0 then 0 when p % 5 = 0 then 0.4 else 1 end, 1 from term where ord > 4
 union all select extraction_id, 0.9, 1, 0, 0 from term where ord = 2),
 s as (select extraction_id, (((2 * sum(s) * 10000)::bigint + sum(n)) // (2 * sum(n)) * 0.0001)::decimal(6,4) ext, least(1, ((2 * sum(pts) * 10000)::bigint + sum(slots)) // (2 * sum(slots)) * 0.0001)::decimal(6,4) norm from parts group by 1),
 pen as (select extraction_id, least(1.0, sum(case severity when 'error' then 0.12 when 'warning' then 0.05 else 0.015 end))::decimal(6,4) pen from iss group by 1)
 select extraction_id, ext::double extraction, norm::double normalization, coalesce(pen, 0)::double validation_penalty, round(0.45 * ext + 0.35 * norm + 0.20 * (1 - coalesce(pen, 0)::decimal(6,4)), 4)::double aggregate from s left join pen using (extraction_id)""",
)
def _(t):
    scores = qa.document_confidence(_metadata(t), _terms(t), _surcharges(t), _dims(t), _issues(t))
    return scores.select("extraction_id", *[F.col(c).cast("double").alias(c) for c in ("extraction", "normalization", "validation_penalty", "aggregate")])


def _fields(t):
    numbers = _terms(t).selectExpr(
        "extraction_id", "concat('service_terms[', cast(ord as string), '].discount_percentage') field_path", "'service_term' entity", "cast(ord as int) ord", "'discount_percentage' field_name",
        "cast(discount_pct as string) value", "cast(discount_pct as double) value_num", "discount_confidence confidence", "cast(p % 3 as int) source_page", "case when p % 2 = 0 then 'row' end source_text", "false needs_review", "cast(null as string) override")
    return _metadata(t).unionByName(numbers)


FIELDS = f"""{TERMS}, {META}, fld as (select extraction_id, 'metadata.' || field_name field_path, 'metadata' entity, field_name, "value", null::double value_num, confidence, source_page, source_text, needs_review from meta
 union all select extraction_id, 'service_terms[' || ord::varchar || '].discount_percentage', 'service_term', 'discount_percentage', discount_pct::varchar, discount_pct::double, discount_confidence, (p % 3)::int, case when p % 2 = 0 then 'row' end, false from term),
 sc0 as (select *, case when field_name = 'effective_date' and regexp_matches("value", '\\d{{4}}-\\d{{2}}-\\d{{2}}') then 0.05 when field_name = 'account_number' and regexp_matches("value", '[\\dA-Z]{{4,}}') then 0.05 when value_num is not null then 0.05 else 0 end b from fld),
 sc as (select * exclude (confidence, needs_review), case when "value" is null then 0 else least(least(confidence + b, 1) + case when source_page is not null and source_text <> '' then 0.03 else 0 end, 1) end::decimal(6,4) conf, needs_review nr, confidence raw from sc0)"""


@query("v4_rescored_fields", f"""with {FIELDS} select extraction_id, field_path, conf::double confidence, case when "value" is not null then conf < 0.7 else nr end needs_review from sc""")
def _(t):
    return qa.rescore(_fields(t)).select("extraction_id", "field_path", F.col("confidence").cast("double").alias("confidence"), "needs_review")


@query(
    "v4_extraction_scores",
    f"""with {FIELDS} select extraction_id, round(coalesce(sum(conf) filter ("value" is not null), 0)::double / greatest(count("value"), 1), 3) overall_confidence, count("value") fields_extracted, count(*) filter ("value" is not null and conf < 0.7) fields_needing_review from sc group by 1""",
)
def _(t):
    return qa.extraction_scores(qa.rescore(_fields(t)))


@query(
    "v5_field_problems",
    f"""with {FIELDS} select extraction_id, field_path, upper(entity) || '_MISSING_' || upper(field_name) code from fld where "value" is null or "value" = '' union all select extraction_id, field_path, upper(entity) || '_LOW_CONFIDENCE' from fld where confidence > 0 and confidence < 0.35""",
)
def _(t):
    return qa.field_problems(_fields(t))


@query("v6_verifier_candidates")
def _(t):
    return qa.verifier_candidates(_fields(t)).select("extraction_id", "field_path", "pick", "used")


@query("v7_context_sections")
def _(t):
    documents = t.table("documents").selectExpr("doc_id", "concat(case when doc_id % 2 = 0 then 'Fuel discount of 5% applies. ' else '' end, text, ' minimum charge note') text")
    paths = t.table("documents").selectExpr("doc_id", "case when doc_id % 3 = 0 then 'service_terms[0].discount_percentage' else 'metadata.the_date' end field_path")
    return qa.context_sections(documents, paths).select("doc_id", "sections", F.length("context").alias("chars"), F.md5(F.col("context").cast("binary")).alias("digest"))


def _corrections(t):
    rows = _terms(t).where("s % 3 = 0").selectExpr(
        "extraction_id", "case when p % 10 = 3 then 'metadata.nope' else 'metadata.carrier' end field_path", "ord", "array('FedEx', 'UPS', 'DHL')[cast(p % 3 as int)] corrected",
        "concat('because ', cast(p as string)) reason", "cast(null as string) rationale", "cast(case when p % 4 = 0 then 1.5 when p % 4 = 1 then 0.95 end as decimal(6,4)) confidence", "cast(case when p % 2 = 0 then 4 end as int) source_page", "'' source_text")
    return rows


CORR = f"""{FIELDS}, corr as (select extraction_id, case when p % 10 = 3 then 'metadata.nope' else 'metadata.carrier' end field_path, ord, ['FedEx', 'UPS', 'DHL'][1 + p % 3] corrected, 'because ' || p::varchar reason,
 cast(case when p % 4 = 0 then 1.0 when p % 4 = 1 then 0.95 end as decimal(6,4)) c, case when p % 2 = 0 then 4 end page from term where s % 3 = 0),
 lastc as (select extraction_id, field_path, unnest(arg_max({{'corrected': corrected, 'reason': reason, 'c': c, 'page': page}}, ord)) from corr group by 1, 2),
 app as (select f.*, l.* exclude (extraction_id, field_path), l.corrected is not null and l.corrected is distinct from f."value" ch from fld f left join lastc l on l.extraction_id = f.extraction_id and l.field_path = f.field_path)"""


@query(
    "v8_v10_corrected_fields",
    f"""with {CORR} select extraction_id, field_path, "value" original_parser_value, corrected llm_corrected_value, reason correction_reason, coalesce(c, confidence)::double confidence, coalesce(page, source_page) source_page from app where ch""",
)
def _(t):
    applied = qa.apply_corrections(_fields(t), _corrections(t))
    listed = qa.corrected_fields(applied).drop("confidence_rationale")
    return listed.join(applied.select("extraction_id", "field_path", F.col("confidence").cast("double").alias("confidence"), "source_page"), ["extraction_id", "field_path"])


@query(
    "v9_correction_diagnostics",
    f"with {CORR} select a.extraction_id, coalesce(p.n, 0) corrections_proposed, a.n corrections_accepted from (select extraction_id, count(*) filter (ch) n from app group by 1) a left join (select extraction_id, count(*) n from corr group by 1) p using (extraction_id)",
)
def _(t):
    return qa.correction_diagnostics(_fields(t), _corrections(t))


@query(
    "v9_skip_reasons",
    "select case when o_orderkey % 10 = 0 then 'no LLM_API_KEY configured' when o_orderkey % 10 = 1 then 'invoice-classified document' when o_orderkey % 10 = 2 then 'non-contract document detected' when o_custkey % 4 = 0 then 'all fields high confidence, verification not needed' end reason, count(*) documents from orders group by 1",
)
def _(t):
    reason = qa.skip_reason(F.expr("o_orderkey % 10 <> 0"), F.expr("o_orderkey % 10 = 1"), F.expr("o_orderkey % 10 = 2"), F.expr("o_custkey % 4"))
    return t.table("orders").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


@query(
    "v11_review_updates",
    f"""with {FIELDS}, up as (select extraction_id, arg_max('rev ' || p::varchar, ord) ov from term where s % 4 = 1 group by 1) select sc.extraction_id, field_path, case when field_path = 'metadata.customer_name' then ov end "override", conf::double confidence,
 case when sc.extraction_id % 3 = 0 then 'approved' when sc.extraction_id % 5 = 0 then 'rejected' else 'pending_review' end status from sc left join up using (extraction_id)""",
)
def _(t):
    updates = _terms(t).where("s % 4 = 1").selectExpr("extraction_id", "'metadata.customer_name' field_path", "ord", "concat('rev ', cast(p as string)) corrected")
    status = qa.review_status(F.expr("extraction_id % 3 = 0"), F.expr("extraction_id % 5 = 0"), F.lit("pending_review"))
    return qa.apply_review(_fields(t), updates).select("extraction_id", "field_path", "override", F.col("confidence").cast("double").alias("confidence"), status.alias("status"))


# ---------------------------------------------------------------- resolution


@query(
    "m1_deduped_terms",
    f"with {TERMS} select extraction_id, ord from (select *, row_number() over (partition by extraction_id, lower(trim(service_type)), zone_key, coalesce(discount_pct::varchar, ''), coalesce(conditions, ''), coalesce(effective_date, '') order by ord) rn from term) where rn = 1",
)
def _(t):
    return rs.dedupe_terms(_terms(t)).select("extraction_id", "ord")


def _amended(t):
    """Terms of a customer: base lines (numbers 1-3) and amendment lines (numbers 4-7)."""
    return t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "o_custkey extraction_id", "case l_partkey % 4 when 0 then 'service' when 1 then 'surcharge' when 2 then 'dim' else 'special' end kind",
        "array(' Ground', 'ground ', 'Air', '', 'Express')[cast(l_suppkey % 5 as int)] name", "case when l_suppkey % 2 = 0 then array('B', ' a') else array('a', 'b ') end services",
        "case when l_linenumber > 3 then cast(l_linenumber as bigint) end amendment_ord", "case when l_linenumber > 3 and l_partkey % 3 <> 0 then date_format(o_orderdate, 'yyyy-MM-dd') end amendment_date",
        "((l_orderkey * 1000 + l_partkey % 1000) * 10 + l_linenumber) * 10000 + l_suppkey ord", "cast(l_discount as decimal(8,4)) discount_pct",
    )


AMENDED = """am as (select o_custkey extraction_id, ['service', 'surcharge', 'dim', 'special'][1 + l_partkey % 4] kind, case when l_partkey % 4 = 2 then 'a|b' else [ 'ground', 'ground', 'air', 'unknown', 'express'][1 + l_suppkey % 5] end k,
 ((l_orderkey * 1000 + l_partkey % 1000) * 10 + l_linenumber) * 10000 + l_suppkey ord, l_linenumber > 3 amended, case when l_linenumber > 3 then coalesce(case when l_partkey % 3 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end, '0000-00-00') else '' end AS "day", case when l_linenumber > 3 then l_linenumber else -1 end ao,
 cast(l_discount as decimal(8,4)) d from lineitem join orders on l_orderkey = o_orderkey)"""


@query(
    "m2_active_terms",
    f"""with {AMENDED}, r as (select *, row_number() over (partition by extraction_id, kind, k order by amended desc, "day" desc, ao desc, ord desc) rn, row_number() over (partition by extraction_id, kind, k order by amended, "day", ao, ord) rf from am)
 select a.extraction_id, a.kind, a.k active_key, a.ord, cast(a.d as double) discount_pct, f.ord first_ord from r a join r f on a.extraction_id = f.extraction_id and a.kind = f.kind and a.k = f.k and f.rf = 1 where a.rn = 1""",
)
def _(t):
    return rs.active_terms(_amended(t)).select("extraction_id", "kind", "active_key", "ord", F.col("discount_pct").cast("double").alias("discount_pct"), F.col("first_seen.ord").alias("first_ord"))


def _company_fields(t):
    """Documents of a company are the orders of a market segment and customer block."""
    place = rs.document_place(F.col("eff"), F.col("doc_type"), F.col("o_orderkey"))
    docs = t.table("orders").selectExpr(
        "o_orderkey", "o_custkey % 200 company_key", "case when o_orderkey % 6 = 0 then null else date_format(o_orderdate, 'yyyy-MM') end eff",
        "array('amendment', 'Addendum', 'base_agreement', null)[cast(o_orderkey % 4 as int)] doc_type", "concat('file', cast(o_orderkey as string)) file_name", "o_custkey", "o_totalprice")
    return docs.withColumn("place", place)


DOCS = """doc as (select o_orderkey, o_custkey % 200 company_key, coalesce(case when o_orderkey % 6 <> 0 then strftime(o_orderdate, '%Y-%m') end, '1900-01-01') eff, ['amendment', 'Addendum', 'base_agreement', null][1 + o_orderkey % 4] doc_type, [3, 2, 1, 1][1 + o_orderkey % 4] pr,
 case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then '' else 'v' || o_orderkey::varchar end val, case when o_orderkey % 5 = 0 then 'ov' || o_orderkey::varchar end ov from orders),
 rk as (select *, row_number() over (partition by company_key order by eff, pr, o_orderkey) rn from doc)"""


@query("m3_document_order", f"with {DOCS} select company_key, o_orderkey, rn doc_number from rk")
def _(t):
    numbered = number_within(_company_fields(t), ["company_key"], ["place"], F.col("place.day"))
    return numbered.select("company_key", "o_orderkey", F.col("number").alias("doc_number"))


def _overlay_rows(t):
    return _company_fields(t).selectExpr(
        "company_key", "'metadata.customer_name' field_path", "place", "doc_type", "file_name", "case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then '' else concat('v', cast(o_orderkey as string)) end value",
        "case when o_orderkey % 5 = 0 then concat('ov', cast(o_orderkey as string)) end override", "cast(0.9 as decimal(6,4)) confidence", "cast(o_orderkey % 9 as int) source_page", "'s' source_text")


@query(
    "m4_overlaid_fields",
    f"""with {DOCS}, b as (select * from rk where rn = 1), l as (select * from (select *, row_number() over (partition by company_key order by rn desc) k from rk where coalesce(ov, val, '') <> '') where k = 1)
 select b.company_key, case when l.rn > 1 then l.val else b.val end "value", b.ov "override", (case when l.rn > 1 then l.o_orderkey else b.o_orderkey end % 9)::int source_page, list_reduce(notes, lambda acc, x: case when contains(acc, x) then acc else acc || '; ' || x end) rationale from b left join l using (company_key)
 left join (select company_key, list('Controlled by amendment file' || o_orderkey::varchar order by rn) notes from rk where rn > 1 and doc_type = 'amendment' and coalesce(ov, val, '') <> '' group by 1) n using (company_key)""",
)
def _(t):
    return rs.overlay_fields(_overlay_rows(t)).select("company_key", "value", "override", "source_page", "rationale")


@query("m4_overlay_notes", f"with {DOCS} select company_key, 'Controlled by amendment file' || o_orderkey::varchar note from rk where rn > 1 and doc_type = 'amendment' and coalesce(ov, val, '') <> ''")
def _(t):
    return rs.overlay_notes(_overlay_rows(t)).select("company_key", "note")


@query(
    "m4_overlaid_lists",
    f"with {DOCS}, li as (select rk.*, l_linenumber, l_partkey from rk join lineitem on l_orderkey = o_orderkey) select company_key, o_orderkey, l_linenumber, l_partkey from (select *, max(rn) over (partition by company_key) last from li) where rn = last",
)
def _(t):
    rows = _company_fields(t).join(t.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"), "o_orderkey").withColumn("kind", F.lit("service_terms"))
    return rs.overlay_lists(rows).select("company_key", "o_orderkey", "l_linenumber", "l_partkey")


@query(
    "m5_merged_leaves",
    f"""with {DOCS}, lf as (select *, 'gsr_status.' || (o_orderkey % 4)::varchar path, case when o_orderkey % 7 < 4 then case when o_orderkey % 2 = 0 then '' end else 'w' || o_orderkey::varchar end w from rk)
 select company_key, path, coalesce(arg_max(w, rn) filter (w <> ''), (array_agg(w order by rn))[1]) "value" from lf group by 1, 2""",
)
def _(t):
    leaves = _company_fields(t).selectExpr("company_key", "place", "concat('gsr_status.', cast(o_orderkey % 4 as string)) path", "case when o_orderkey % 7 < 4 then case when o_orderkey % 2 = 0 then '' end else concat('w', cast(o_orderkey as string)) end value")
    return rs.merge_leaves(leaves).select("company_key", "path", "value")


@query(
    "m6_expired_fuel_discount",
    "select o_orderkey k, case when o_orderkey % 5 <> 0 and cast(o_orderdate as date) < date '1998-01-01' then 0.0 else o_custkey % 20 end::double discount_pct from orders",
)
def _(t):
    rows = t.table("orders").selectExpr("o_orderkey k", "case when o_orderkey % 5 = 0 then 'open' else date_format(o_orderdate, 'yyyy-MM-dd') end expiration_date", "cast(o_custkey % 20 as decimal(8,4)) discount_pct")
    return rs.expire_fuel(rows, "1998-01-01").select("k", F.col("discount_pct").cast("double").alias("discount_pct"))


@query(
    "m7_company_groups",
    """with c as (select c_custkey, case when c_custkey % 13 = 0 then '' when c_custkey % 2 = 0 then ' Acme ' || (c_custkey % 300)::varchar || ', Inc.' else 'ACME-' || (c_custkey % 301)::varchar || ' inc' end n from customer),
 g as (select case when n = '' then 'unknown company' else trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) end company_key, count(*) files, arg_min(case when n = '' then 'Unknown Company' else trim(n) end, c_custkey) company from c group by 1) select company_key, company, files, company || ' (' || files::varchar || ' files).pdf' file_name from g where files > 1""",
)
def _(t):
    documents = t.table("customer").selectExpr("c_custkey ordinal", "case when c_custkey % 13 = 0 then ' ' when c_custkey % 2 = 0 then concat(' Acme ', cast(c_custkey % 300 as string), ', Inc.') else concat('ACME-', cast(c_custkey % 301 as string), ' inc') end customer_name")
    return rs.company_groups(documents).select("company_key", "company", "files", "file_name")


def _company_merge(t):
    """Orders are documents; those of one customer, and all without a name, are a company's."""
    documents = t.table("orders").selectExpr(
        "o_orderkey extraction_id", "case when o_custkey % 6 <> 0 then concat('Cust ', cast(o_custkey as string)) end customer_name", "case when o_orderkey % 6 <> 0 then date_format(o_orderdate, 'yyyy-MM') end effective_date",
        "array('amendment', 'Addendum', 'base_agreement', null)[cast(o_orderkey % 4 as int)] document_type", "concat('file', cast(o_orderkey as string)) file_name", "concat('in/', cast(o_orderkey % 50 as string)) file_path", "o_orderkey ordinal")
    terms = _terms(t).selectExpr(
        "extraction_id", "'service' kind", "service_type name", "cast(null as array<string>) services", "case when ord > 3 then ord end amendment_ord", "case when ord > 3 then effective_date end amendment_date",
        "extraction_id * 10 + ord ord", "discount_pct")
    leaves = t.table("orders").selectExpr(
        "o_orderkey extraction_id",
        "inline(array(struct('fuel_surcharge.discount_pct', cast(o_orderkey % 20 as string)), struct('fuel_surcharge.expiration_date', case when o_orderkey % 3 = 0 then '' else date_format(o_orderdate, 'yyyy-MM-dd') end), struct(concat('gsr_status.', cast(o_orderkey % 3 as string)), 'active'))) as (path, value)")
    return cm.merge_companies(documents, _fields(t), terms, leaves, "1998-01-01")


COMPANIES = f"""{FIELDS}, dk as (select o_orderkey id, coalesce(case when o_custkey % 6 <> 0 then 'Cust ' || o_custkey::varchar end, 'Unknown Company') company, coalesce(case when o_orderkey % 6 <> 0 then strftime(o_orderdate, '%Y-%m') end, '1900-01-01') eff,
  [3, 2, 1, 1][1 + o_orderkey % 4] pr, o_orderkey % 4 = 0 amendment, o_orderdate from orders),
 rk as (select *, count(*) over (partition by company) files, row_number() over (partition by company order by eff, pr, id) rn, first_value(company) over (partition by company order by id) shown from dk),
 g as (select * from rk where files > 1),
 mf as (select company, field_path, field_name, max(rn) filter ("value" <> '') > 1 later, arg_min(needs_review, rn) nr, arg_max({{'v': "value", 'c': confidence, 'p': source_page, 's': source_text}}, rn) filter ("value" <> '') l, arg_min({{'v': "value", 'c': confidence, 'p': source_page, 's': source_text}}, rn) b
  from fld join g on id = extraction_id where entity = 'metadata' group by all),
 lastdoc as (select company, max(rn) rn from g join term on id = extraction_id group by 1),
 mg as (select company, field_path, field_name, case when later then l.v else b.v end "value", null::double value_num, case when later then l.c else b.c end confidence, case when later then l.p else b.p end source_page, case when later then l.s else b.s end source_text, nr needs_review from mf
  union all select company, field_path, field_name, "value", value_num, confidence, source_page, source_text, needs_review from fld join g on id = extraction_id join lastdoc using (company, rn) where entity = 'service_term'),
 ms as (select *, case when "value" is null then 0 else least(least(confidence + case when field_name = 'effective_date' and regexp_matches("value", '\\d{{4}}-\\d{{2}}-\\d{{2}}') then 0.05 when field_name = 'account_number' and regexp_matches("value", '[\\dA-Z]{{4,}}') then 0.05 when value_num is not null then 0.05 else 0 end, 1)
   + case when source_page is not null and source_text <> '' then 0.03 else 0 end, 1) end::decimal(6,4) conf from mg),
 mr as (select *, case when "value" is not null then conf < 0.7 else needs_review end review from ms)"""


@query(
    "m7_merged_documents",
    f"""with {COMPANIES} select company, any_value(files) files, company || ' (' || any_value(files)::varchar || ' files).pdf' file_name, 'pending_review' status, round(coalesce(sum(conf) filter ("value" is not null), 0)::double / greatest(count("value"), 1), 3) overall_confidence,
 count("value") fields_extracted, count(*) filter ("value" is not null and review) fields_needing_review from mr join (select company, any_value(files) files from g group by 1) using (company) group by company""",
)
def _(t):
    return _company_merge(t).documents.select("company", "files", "file_name", "status", "overall_confidence", "fields_extracted", "fields_needing_review")


@query("m7_merged_fields", f"""with {COMPANIES} select company, field_path, "value", conf::double confidence, source_page, review needs_review from mr""")
def _(t):
    merged = _company_merge(t)
    return merged.fields.join(merged.documents.select("extraction_id", "company"), "extraction_id").select("company", "field_path", "value", F.col("confidence").cast("double").alias("confidence"), "source_page", "needs_review")


@query(
    "m7_merged_active_terms",
    f"""with {COMPANIES}, tm as (select company, rn, extraction_id * 10 + ord ord, ord > 3 amended, lower(trim(case when service_type = '' then 'unknown' else service_type end)) k, case when ord > 3 then coalesce(effective_date, '0000-00-00') end d, case when ord > 3 then ord else -1 end ao, discount_pct from term join g on id = extraction_id),
 kept as (select * from (select *, max(rn) over (partition by company, amended) mx from tm) where rn = mx)
 select company, k active_key, ord, cast(discount_pct as double) discount_pct from (select *, row_number() over (partition by company, k order by amended desc, d desc, ao desc, ord desc) i from kept) where i = 1""",
)
def _(t):
    merged = _company_merge(t)
    return merged.active.join(merged.documents.select("extraction_id", "company"), "extraction_id").select("company", "active_key", "ord", F.col("discount_pct").cast("double").alias("discount_pct"))


@query(
    "m7_merged_leaves",
    f"""with {COMPANIES}, lf as (select company, rn, unnest([{{'p': 'fuel_surcharge.discount_pct', 'v': (id % 20)::varchar}}, {{'p': 'fuel_surcharge.expiration_date', 'v': case when id % 3 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end}}, {{'p': 'gsr_status.' || (id % 3)::varchar, 'v': 'active'}}]) x from g),
 lm as (select company, x.p path, coalesce(arg_max(x.v, rn) filter (x.v <> ''), arg_min(x.v, rn)) "value" from lf group by all), ex as (select company from lm where path = 'fuel_surcharge.expiration_date' and try_cast("value" as date) < date '1998-01-01')
 select company, path, case when path = 'fuel_surcharge.discount_pct' and company in (select company from ex) then '0.0' else "value" end "value" from lm union all select company, 'fuel_surcharge.note', 'Fuel surcharge discount expired; defaulted to 0%.' from ex""",
)
def _(t):
    merged = _company_merge(t)
    return merged.leaves.join(merged.documents.select("extraction_id", "company"), "extraction_id").select("company", "path", "value")


@query(
    "m7_merged_files_and_notes",
    f"""with {COMPANIES} select company, 'file' what, 'in/' || (id % 50)::varchar "text" from g group by all union all
 select company, field_path, 'Controlled by amendment file' || id::varchar from fld join g on id = extraction_id where entity = 'metadata' and rn > 1 and amendment and "value" <> ''
 union all select company, 'untouched', id::varchar from rk where files = 1""",
)
def _(t):
    merged = _company_merge(t)
    names = merged.documents.select("extraction_id", "company", "company_key")
    files = merged.files.join(names, "extraction_id").select("company", F.lit("file").alias("what"), F.col("file_path").alias("text"))
    notes = merged.notes.join(names, "company_key").select("company", F.col("field_path").alias("what"), F.col("note").alias("text"))
    alone = merged.untouched.select(F.coalesce("customer_name", F.lit("Unknown Company")).alias("company"), F.lit("untouched").alias("what"), F.col("extraction_id").cast("string").alias("text"))
    return files.unionByName(notes).unionByName(alone)


@query(
    "m8_best_value",
    """with e as (select user_id, event_id, case when event_id % 3 = 0 then ' ' else event_type || event_id::varchar end val, cast("value" as decimal(12,2)) c from events) select user_id, val "value", c::double confidence from (select *, row_number() over (partition by user_id order by (val <> ' ')::int desc, c desc, event_id) rn from e) where rn = 1""",
)
def _(t):
    rows = t.table("events").selectExpr("user_id", "event_id ord", "case when event_id % 3 = 0 then ' ' else concat(event_type, cast(event_id as string)) end value", "cast(value as decimal(12,2)) confidence")
    return rs.best_value(rows, ["user_id"]).select("user_id", "value", F.col("confidence").cast("double").alias("confidence"))


@query("m9_first_of_equal_rows", "select user_id, event_type, min(event_id) event_id from events group by 1, 2")
def _(t):
    return rs.first_of_equal_rows(t.table("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")
