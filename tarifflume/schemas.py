"""Table schemas of the data model.

Money is DECIMAL(18,4); weights and sizes are DECIMAL as well so that the
tolerances of the checks compare exactly.
"""

from __future__ import annotations

MONEY = "decimal(18,4)"
PCT = "decimal(8,4)"
CENTS = "decimal(18,2)"

# (column, type) of one normalised invoice line.
INVOICE_LINE: list[tuple[str, str]] = [
    ("line_id", "string"),
    ("tracking_number", "string"),
    ("transaction_id", "string"),
    ("invoice_id", "string"),
    ("ship_date", "date"),
    ("actual_delivery_datetime", "timestamp_ntz"),
    ("service_code", "string"),
    ("service_group", "string"),
    ("package_type", "string"),
    ("service_or_charge_type", "string"),
    ("origin_zip", "string"),
    ("destination_zip", "string"),
    ("zone", "int"),
    ("actual_weight_lbs", MONEY),
    ("length", MONEY),
    ("width", MONEY),
    ("height", MONEY),
    ("rated_weight_lbs", MONEY),
    ("rate_per_lb", MONEY),
    ("published_charge", MONEY),
    ("transport_charge", MONEY),
    ("earned_discount_applied", MONEY),
    ("incentive_credit", MONEY),
    ("net_transport_charge", MONEY),
    ("fuel_surcharge_billed", MONEY),
    ("residential_surcharge_billed", MONEY),
    ("das_billed", MONEY),
    ("ahs_billed", MONEY),
    ("large_package_billed", MONEY),
    ("address_correction_billed", MONEY),
    ("saturday_delivery_billed", MONEY),
    ("declared_value_billed", MONEY),
    ("total_billed", MONEY),
    ("is_residential", "boolean"),
    ("carrier_exception_code", "string"),
    ("base_amount", MONEY),
    ("billed_amount", MONEY),
    ("applied_discount_pct", PCT),
    ("source_page", "int"),
    ("source_text", "string"),
    ("raw_line_text", "string"),
]

# Agreement terms read by the audit. Terms of one agreement stay nested in its
# row (a contract has tens of entries), so a line needs one join and no fan-out.
AGREEMENT_DDL = f"""
  agreement_id bigint,
  contract_ref string,
  client_id string,
  customer_name string,
  carrier string,
  status string,
  fuel_surcharge struct<discount_pct: {PCT}, expiration_date: date>,
  accessorials map<string, struct<flat_fee_override: {MONEY}>>,
  gsr_status map<string, string>,
  minimum_net_charge map<string, {MONEY}>,
  dim_rules array<struct<ord: int, divisor: {MONEY}>>,
  earned struct<
    kind: string,
    tiers: array<struct<threshold_min: {MONEY}, threshold_max: {MONEY}, discounts: map<string, {PCT}>>>,
    base_discounts: map<string, struct<
      alias: string,
      zone_exceptions: map<string, {PCT}>,
      flat_discount_pct: {PCT},
      by_weight: array<struct<min_lbs: {MONEY}, max_lbs: {MONEY}, discount_pct: {PCT}>>>>,
    tier_discounts: map<string, {PCT}>>
"""

# What a check saw: the values its explanation names. Each check fills its own part.
EVIDENCE: dict[str, str] = {
    "carrier": "string",
    "published_pct": PCT,
    "discount_pct": PCT,
    "effective_pct": "decimal(16,8)",
    "base": MONEY,
    "length": MONEY,
    "width": MONEY,
    "height": MONEY,
    "weight": MONEY,
    "divisor": "int",
    "dim_lbs": "bigint",
    "promised_date": "date",
    "commit_time": "string",
    "delivered": "timestamp_ntz",
    "rolling_revenue": "decimal(28,2)",
    "zip": "string",
}
EVIDENCE_STRUCT = "struct<" + ", ".join(f"{name}: {kind}" for name, kind in EVIDENCE.items()) + ">"

# One audit finding, before the descriptive text columns are added.
FINDING_STRUCT = (
    f"struct<check_ord: int, discrepancy_type: string, expected_value: {MONEY}, "
    f"billed_value: {MONEY}, dollar_impact: {CENTS}, evidence: {EVIDENCE_STRUCT}>"
)
