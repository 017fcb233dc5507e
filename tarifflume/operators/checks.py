"""Line-level audit checks.

`enrich` brings agreement terms and reference values next to each line; every
check is then one column expression over that row, and `run_checks` evaluates all
of them in a single pass. Only the agreement join can shuffle: reference tables
are bounded by calendar or ZIP space and are broadcast; the agreement table has no
hint, so Spark broadcasts it below its size threshold and otherwise sort-merges
with AQE splitting a hot agreement.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from tarifflume.functions import values as v
from tarifflume.schemas import CENTS, EVIDENCE, EVIDENCE_STRUCT, FINDING_STRUCT, MONEY, PCT
from tarifflume.sources.reference import (
    EXEMPT_EXCEPTIONS,
    PUBLISHED_MINIMUM,
    SERVICE_COMMITMENTS,
    fuel_intervals,
)

OVER, UNDER = "overcharge", "undercharge"
UNSUPPORTED, MISSING, AMBIGUOUS = "unsupported_fee", "missing_discount", "ambiguous_needs_review"

# Check -> (order in the run, field, confidence, reason)
CHECKS: dict[str, tuple[int, str, float, str]] = {
    "duplicate": (0, "duplicate_charge", 0.9, "Potential duplicate invoice line."),
    "guarantee": (1, "gsr_late_delivery", 0.9, "Late delivery qualifies for money-back guarantee refund."),
    "earned": (2, "earned_discount", 0.82, "Applied earned discount does not match expected tier."),
    "dim": (3, "rated_weight_lbs", 0.9, "Rated weight differs from contract-based DIM expectation."),
    "fuel": (4, "fuel_surcharge", 0.86, "Fuel surcharge does not match weekly table and contracted discount."),
    "minimum": (5, "minimum_net_charge", 0.8, "Published MNC appears used instead of contracted MNC."),
    "residential": (6, "residential_surcharge", 0.83, "Residential surcharge does not match flat override."),
    "handling": (7, "ahs_surcharge", 0.83, "AHS fee appears unsupported by package dimensions/weight."),
    "large": (8, "large_package_surcharge", 0.84, "Large package fee appears unsupported by dimension thresholds."),
    "address": (9, "address_correction", 0.83, "Address correction fee does not match contract override."),
    "area": (10, "das_surcharge", 0.85, "DAS billed on ZIP not present in carrier DAS mapping."),
}
# Orders 11 and 12 are variants of checks 2 and 6 with their own reason and confidence.
LAYERED_ORD, COMMERCIAL_ORD = 11, 12
VARIANTS: dict[int, tuple[str, float, str]] = {
    LAYERED_ORD: ("earned_discount", 0.85, "Billed net charge exceeds expected after applying all contract discount layers."),
    COMMERCIAL_ORD: ("residential_surcharge", 0.8, "Residential fee should not apply to commercial address."),
}
GROUND_GROUPS = ["ground", "home_delivery", "ground_saver"]


def _amount(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast(MONEY))


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def _product(a: Column, b: Column, hundredths: str) -> Column:
    """a*b scaled by a power of ten, with the intermediate kept inside DECIMAL(38)."""
    return (a * b).cast("decimal(28,8)") * F.lit(hundredths).cast("decimal(6,6)")


def _finding(check: str | int, when: Column, kind: Column | str, expected, billed, impact, **seen: Column) -> Column:
    """A finding with the evidence `seen`, or null; nothing of it is computed for lines in order."""
    order = check if isinstance(check, int) else CHECKS[check][0]
    evidence = F.struct(*[seen.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in EVIDENCE.items()])
    kind = F.lit(kind) if isinstance(kind, str) else kind
    body = F.struct(
        F.lit(order).alias("check_ord"),
        kind.alias("discrepancy_type"),
        _money(expected).alias("expected_value"),
        _money(billed).alias("billed_value"),
        impact.cast(CENTS).alias("dollar_impact"),
        (evidence if seen else F.lit(None)).cast(EVIDENCE_STRUCT).alias("evidence"),
    )
    return F.when(when, body.cast(FINDING_STRUCT))


def _literal_map(pairs: list[tuple[str, Column]]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), val) for k, val in pairs))


# ---------------------------------------------------------------- enrichment


def agreement_terms(agreements: DataFrame) -> DataFrame:
    """The agreement columns the checks read, one row per agreement."""
    divisor = F.filter("dim_rules", lambda r: r["divisor"] > 0)
    return agreements.select(
        "agreement_id",
        v.slug(F.col("carrier")).alias("ag_carrier"),
        F.col("fuel_surcharge.discount_pct").alias("fuel_discount_pct"),
        F.col("fuel_surcharge.expiration_date").alias("fuel_expiration"),
        F.col("accessorials")["residential_delivery"]["flat_fee_override"].alias("residential_override"),
        F.col("accessorials")["address_correction"]["flat_fee_override"].alias("address_override"),
        "gsr_status",
        "minimum_net_charge",
        F.coalesce(F.get(F.array_sort(divisor), 0)["divisor"].cast("int"), F.lit(139)).alias("dim_divisor"),
        "earned",
    )


def rolling_revenue(lines: DataFrame, agreements: DataFrame) -> DataFrame:
    """Annualised revenue per agreement.

    Lines are first summed per (agreement, ship week), which both pre-aggregates
    map-side and splits a hot agreement over its weeks.
    """
    carriers = agreements.select("agreement_id", v.slug(F.col("carrier")).alias("ag_carrier"))
    weekly = (
        lines.groupBy("agreement_id", v.week_start(F.col("ship_date")).alias("week"))
        .agg(
            F.sum(F.coalesce(v.nonzero(F.col("published_charge")), _amount("transport_charge"))).alias("published_first"),
            F.sum(F.coalesce(v.nonzero(F.col("transport_charge")), _amount("published_charge"))).alias("transport_first"),
            F.sum(_amount("residential_surcharge_billed") + _amount("das_billed")).alias("fees"),
        )
    )
    gross = F.when(F.col("ag_carrier") == "ups", F.col("published_first") + F.col("fees")).otherwise(F.col("transport_first"))
    return (
        weekly.join(carriers, "agreement_id")
        .groupBy("agreement_id")
        .agg(F.sum(gross.cast("decimal(28,4)")).alias("batch"), F.count("week").alias("weeks"))
        .select(
            "agreement_id",
            F.round(F.col("batch") * 52 / F.greatest(F.col("weeks"), F.lit(1)), 2).cast("decimal(28,2)").alias("rolling_revenue"),
        )
    )


def with_earned_tier(agreements: DataFrame, revenue: DataFrame) -> DataFrame:
    """Agreements with the tier their revenue falls in (lowest threshold first)."""
    rev = F.coalesce(F.col("rolling_revenue"), F.lit(0).cast("decimal(28,2)"))
    floor = lambda t: F.coalesce(t["threshold_min"], F.lit(0).cast(MONEY))
    ranked = F.transform(
        F.col("earned.tiers"),
        lambda t, i: F.struct(
            floor(t).alias("lo"), i.alias("i"), t["threshold_max"].alias("hi"), t["discounts"].alias("discounts")
        ),
    )
    inside = F.filter(ranked, lambda t: (t["lo"] <= rev) & (t["hi"].isNull() | (rev < t["hi"])))
    # Order by (lo, list position); the discounts map itself is not orderable.
    first = F.array_min(F.transform(inside, lambda t: F.struct(t["lo"].alias("lo"), t["i"].alias("i"))))
    tier = F.get(F.filter(inside, lambda t: (t["lo"] == first["lo"]) & (t["i"] == first["i"])), 0)
    return (
        agreements.join(revenue, "agreement_id", "left")
        .withColumn("tier_found", first.isNotNull())
        .withColumn("tier_discounts", tier["discounts"])
    )


def attach_fuel_rate(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """As-of lookup: the latest weekly rate not after the ship date (null before the first).

    The rates are unfolded to one row per day, and a ship date after the last known week is
    looked up at that week, so both joins are hash lookups on unique keys: no line is
    compared with every week of its series.
    """
    series = ["ag_carrier", "fuel_class"]
    last_day = F.coalesce(F.date_sub("week_end", 1), F.col("week_start"))
    daily = fuel_intervals(rates).select(
        F.col("carrier").alias("ag_carrier"), F.col("class").alias("fuel_class"),
        F.explode(F.sequence("week_start", last_day)).alias("rate_day"), F.col("pct").alias("fuel_rate_pct"),
    )
    ends = rates.groupBy(F.col("carrier").alias("ag_carrier"), F.col("class").alias("fuel_class")).agg(F.max("week_start").alias("last_week"))
    ground = F.coalesce(F.col("service_group").isin(GROUND_GROUPS), F.lit(False))
    air = F.when(F.col("ag_carrier") == "ups", "air").otherwise("express")
    return (
        lines.withColumn("fuel_class", F.when(ground, "ground").otherwise(air))
        .join(F.broadcast(ends), series, "left")
        .withColumn("rate_day", F.when(F.col("ship_date") > F.col("last_week"), F.col("last_week")).otherwise(F.col("ship_date")))
        .join(F.broadcast(daily), [*series, "rate_day"], "left")
        .drop("fuel_class", "rate_day", "last_week")
    )


def attach_suspension(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Flag lines shipped inside a guarantee suspension (both ends inclusive)."""
    by_carrier = windows.groupBy(F.col("carrier").alias("w_carrier")).agg(
        F.collect_list(F.struct("start_date", "end_date")).alias("w_spans")
    )
    inside = F.exists("w_spans", lambda w: (w["start_date"] <= F.col("ship_date")) & (F.col("ship_date") <= w["end_date"]))
    joined = lines.join(F.broadcast(by_carrier), F.col("ag_carrier") == F.col("w_carrier"), "left")
    return joined.withColumn("suspended", F.coalesce(inside, F.lit(False))).drop("w_carrier", "w_spans")


def attach_promise(lines: DataFrame, calendar: DataFrame) -> DataFrame:
    """Promised delivery day and time of the services that carry a commitment."""
    days = _literal_map([(code, F.lit(n)) for code, n, _ in SERVICE_COMMITMENTS])
    times = _literal_map([(code, F.lit(t).cast("string")) for code, _, t in SERVICE_COMMITMENTS])
    shipped = calendar.select(F.col("day").alias("ship_date"), F.col("bd_ord").alias("ship_ord"))
    due = calendar.where("is_business").select(F.col("bd_ord").alias("due_ord"), F.col("day").alias("promised_date"))
    return (
        lines.withColumn("commit_days", days[F.col("service_code")])
        .withColumn("commit_time", times[F.col("service_code")])
        .join(F.broadcast(shipped), "ship_date", "left")
        .withColumn("due_ord", F.col("ship_ord") + F.col("commit_days"))
        .join(F.broadcast(due), "due_ord", "left")
        .drop("ship_ord", "due_ord")
    )


def attach_area_tier(lines: DataFrame, zips: DataFrame) -> DataFrame:
    # one tier a ZIP, whatever the caller's table holds, so no line is doubled and 100,000 ZIPs a carrier are the most
    listed = zips.groupBy(F.col("carrier").alias("ag_carrier"), F.col("zip").alias("zip_key")).agg(F.max("tier").alias("area_tier"))
    return lines.withColumn("zip_key", v.zip5(F.col("destination_zip"))).join(
        F.broadcast(listed), ["ag_carrier", "zip_key"], "left"
    )


# ---------------------------------------------------------------- checks


def _guarantee_steps() -> list[dict[str, Column]]:
    """Delivery day and time, only for services that carry a commitment."""
    promised = F.col("commit_days").isNotNull()
    arrived = F.col("actual_delivery_datetime")
    return [{
        "_arrived_day": F.when(promised, arrived.cast("date")),
        "_arrived_time": F.when(promised & F.col("commit_time").isNotNull(), F.date_format(arrived, "HH:mm:ss")),
    }]


def guarantee_check() -> Column:
    status = F.coalesce(F.lower(F.col("gsr_status")[F.coalesce(v.blank_to_null(F.col("service_group")), F.lit("express"))]), F.lit("active"))
    exempt = F.coalesce(F.lower("carrier_exception_code").isin(EXEMPT_EXCEPTIONS), F.lit(False))
    after_hour = (F.col("_arrived_day") == F.col("promised_date")) & (F.col("_arrived_time") > F.col("commit_time"))
    late = (F.col("_arrived_day") > F.col("promised_date")) | F.coalesce(after_hour, F.lit(False))
    due = F.col("total_billed")
    # The cheap and selective lateness test comes first.
    return _finding(
        "guarantee", late & ~F.col("suspended") & (status == "active") & ~exempt, OVER, F.lit(0), due, F.round(due, 2),
        promised_date=F.col("promised_date"), commit_time=F.col("commit_time"), delivered=F.col("actual_delivery_datetime"),
    )


def _layered_base_pct() -> Column:
    rules = F.col("earned.base_discounts")
    service = F.coalesce(F.col("service_code"), F.lit(""))
    own = rules[service]
    aliased = F.when(own["alias"].isNotNull(), rules[own["alias"]]).otherwise(own)
    ground_like = F.contains(service, F.lit("ground")) | F.contains(service, F.lit("saver"))
    rule = F.coalesce(aliased, F.when(ground_like, rules["ups_ground"]))
    weight = _amount("rated_weight_lbs")
    bands = F.filter(
        rule["by_weight"],
        lambda b: (weight >= F.coalesce(b["min_lbs"], F.lit(0))) & (b["max_lbs"].isNull() | (weight <= b["max_lbs"])),
    )
    by_zone = F.when(v.nonzero(F.col("zone")).isNotNull(), rule["zone_exceptions"][F.col("zone").cast("string")])
    return F.coalesce(by_zone, rule["flat_discount_pct"], F.get(bands, 0)["discount_pct"], F.lit(0).cast(PCT))


def _earned_steps() -> list[dict[str, Column]]:
    published, zero = F.col("published_charge"), F.lit(0).cast(MONEY)
    hundred, no_pct = F.lit(100).cast(PCT), F.lit(0).cast(PCT)
    after_base = (published * (hundred - F.col("_base_pct"))).cast("decimal(24,8)")
    layered_due = F.round((after_base * (hundred - F.col("_layer_pct"))).cast("decimal(30,10)") * F.lit("0.0001").cast("decimal(4,4)"), 2)
    tier_due = F.round(_product(F.col("_gross"), F.col("_tier_pct"), "0.01"), 2)
    return [
        {
            "_layered": F.coalesce((F.col("earned.kind") == "ups_multi_layer") & (published > 0), F.lit(False)),
            "_layer_net": F.coalesce(v.nonzero(F.col("net_transport_charge")), v.nonzero(F.col("billed_amount")), zero),
            "_gross": F.coalesce(v.nonzero(F.col("transport_charge")), v.nonzero(published), zero),
            "_applied": F.abs(F.coalesce(v.nonzero(F.col("earned_discount_applied")), v.nonzero(F.col("incentive_credit")), zero)),
            "_tier_pct": F.coalesce(F.col("tier_discounts")[F.col("service_code")], no_pct),
            "_layer_pct": F.coalesce(F.col("earned.tier_discounts")[F.col("service_code")], no_pct),
        },
        {"_base_pct": F.when(F.col("_layered"), _layered_base_pct())},
        {"_layer_due": F.when(F.col("_layered"), _money(layered_due)), "_tier_due": F.when(~F.col("_layered"), _money(tier_due))},
        {"_layer_gap": _money(F.col("_layer_net") - F.col("_layer_due")), "_tier_delta": _money(F.col("_tier_due") - F.col("_applied"))},
    ]


def earned_check() -> Column:
    net, due, gap = F.col("_layer_net"), F.col("_layer_due"), F.round("_layer_gap", 2)
    kept = (F.lit(100).cast(PCT) - F.col("_base_pct")) * (F.lit(100).cast(PCT) - F.col("_layer_pct"))
    layered = _finding(
        LAYERED_ORD, (net > 0) & (due > 0) & (gap > F.lit("0.05").cast("decimal(4,2)")), MISSING, due, net, gap,
        base=F.col("published_charge"), effective_pct=F.lit(100) - kept * F.lit("0.01").cast("decimal(2,2)"),
    )
    gross, applied, delta = F.col("_gross"), F.col("_applied"), F.round("_tier_delta", 2)
    # |pct - applied/gross*100| >= 0.1, multiplied through by gross.
    off = F.abs(gross * F.col("_tier_pct") - applied * 100) >= F.abs(gross) * F.lit("0.1").cast("decimal(2,1)")
    by_tier = _finding(
        "earned", F.col("tier_found") & (gross != 0) & off, F.when(delta > 0, MISSING).otherwise(UNDER), F.col("_tier_due"), applied, delta,
        rolling_revenue=F.coalesce("rolling_revenue", F.lit(0)), discount_pct=F.col("_tier_pct"), effective_pct=applied / gross * 100,
    )
    return F.when(F.col("_layered"), layered).otherwise(by_tier)


def _sizes() -> dict[str, Column]:
    return {c: F.col(c) for c in ("length", "width", "height")}


def _dim_steps() -> list[dict[str, Column]]:
    longest = F.greatest(F.ceil("length"), F.ceil("width"), F.ceil("height"))
    rated = v.rated_weight(F.col("actual_weight_lbs"), F.col("_dim_lbs"))
    long_fedex = (F.col("ag_carrier") == "fedex") & (longest > 48)
    return [
        {"_dim_lbs": v.dim_weight(F.col("length"), F.col("width"), F.col("height"), F.col("dim_divisor"))},
        # greatest() skips nulls; without a size there is no expectation at all.
        {"_dim_due": F.when(F.col("_dim_lbs").isNotNull() & F.col("actual_weight_lbs").isNotNull(), F.when(long_fedex, F.greatest(rated, F.lit(40).cast(MONEY))).otherwise(rated))},
        {"_dim_billed": F.coalesce("rated_weight_lbs", "actual_weight_lbs")},
        {"_dim_delta": _money(F.col("_dim_billed") - F.col("_dim_due"))},
    ]


def dim_check() -> Column:
    delta = F.col("_dim_delta")
    impact = F.round(delta * _amount("rate_per_lb").cast("decimal(14,4)"), 2)
    return _finding(
        "dim", F.abs(delta) >= F.lit("0.5").cast("decimal(2,1)"), F.when(delta > 0, OVER).otherwise(UNDER), F.col("_dim_due"), F.col("_dim_billed"), impact,
        divisor=F.col("dim_divisor"), dim_lbs=F.col("_dim_lbs"), **_sizes(),
    )


def _fuel_steps() -> list[dict[str, Column]]:
    in_force = F.when(F.col("ship_date") > F.col("fuel_expiration"), F.lit(0).cast(PCT)).otherwise(F.col("fuel_discount_pct"))
    base = F.when(F.col("ag_carrier") == "fedex", _amount("net_transport_charge")).otherwise(_amount("published_charge"))
    rate = (F.col("fuel_rate_pct") * (F.lit(100).cast(PCT) - in_force)).cast("decimal(16,8)")
    due = F.round((base.cast("decimal(14,4)") * rate).cast("decimal(30,12)") * F.lit("0.0001").cast("decimal(4,4)"), 2)
    known = F.col("ag_carrier").isin("fedex", "ups") & F.col("fuel_discount_pct").isNotNull()
    return [
        {"_fuel_due": F.when(known, _money(due)), "_fuel_base": base, "_fuel_in_force": in_force},
        {"_fuel_delta": _money(F.col("fuel_surcharge_billed") - F.col("_fuel_due"))},
    ]


def fuel_check() -> Column:
    delta = F.round("_fuel_delta", 2)
    rate, discount = F.col("fuel_rate_pct"), F.col("_fuel_in_force")
    return _finding(
        "fuel", delta > F.lit("0.02").cast("decimal(4,2)"), OVER, F.col("_fuel_due"), F.col("fuel_surcharge_billed"), delta,
        published_pct=rate, discount_pct=discount, base=F.col("_fuel_base"),
        effective_pct=rate * (F.lit(100).cast(PCT) - discount) * F.lit("0.01").cast("decimal(2,2)"),
    )


def _minimum_steps() -> list[dict[str, Column]]:
    group = F.coalesce(v.blank_to_null(F.col("service_group")), F.lit("ground"))
    table = _literal_map([(f"{carrier}/{grp}", F.lit(amount).cast(MONEY)) for carrier, grp, amount in PUBLISHED_MINIMUM])
    return [{"_mnc_published": table[F.concat_ws("/", F.col("ag_carrier"), group)], "_mnc_contract": F.col("minimum_net_charge")[group]}]


def minimum_check() -> Column:
    contracted, published, net = F.col("_mnc_contract"), F.col("_mnc_published"), _amount("net_transport_charge")
    used = F.abs(net - published) < F.lit("0.05").cast("decimal(4,2)")
    return _finding("minimum", (contracted < published) & used, OVER, contracted, net, F.round(net - contracted, 2), base=published)


def _override_check(check: str, billed: Column, override: Column) -> Column:
    delta = F.round(billed - override, 2)
    off = (billed > 0) & (F.abs(billed - override) > F.lit("0.02").cast("decimal(4,2)"))
    return _finding(check, off, F.when(delta > 0, OVER).otherwise(UNDER), override, billed, delta)


def residential_check() -> Column:
    billed = _amount("residential_surcharge_billed")
    commercial = (billed > 0) & F.col("is_residential").eqNullSafe(F.lit(False))
    return F.when(
        commercial, _finding(COMMERCIAL_ORD, F.lit(True), UNSUPPORTED, F.lit(0), billed, billed)
    ).otherwise(_override_check("residential", billed, F.col("residential_override")))


def address_check() -> Column:
    return _override_check("address", _amount("address_correction_billed"), F.col("address_override"))


def _side_steps() -> list[dict[str, Column]]:
    up = {"_l": F.ceil("length").cast("bigint"), "_w": F.ceil("width").cast("bigint"), "_h": F.ceil("height").cast("bigint")}
    longest = F.greatest("_l", "_w", "_h")
    total = F.col("_l") + F.col("_w") + F.col("_h")
    return [
        up,
        {"_longest": longest, "_shortest": F.least("_l", "_w", "_h"), "_sides": total, "_sized": (F.col("length") != 0) & (F.col("width") != 0) & (F.col("height") != 0)},
        {"_second": F.col("_sides") - F.col("_longest") - F.col("_shortest")},
    ]


def _longest_and_girth() -> Column:
    return F.col("_longest") + 2 * (F.col("_second") + F.col("_shortest"))


def handling_check() -> Column:
    weight, billed = _amount("actual_weight_lbs"), _amount("ahs_billed")
    heavy = (F.col("_longest") > 48) | (weight > 70)
    fits = heavy | F.when(F.col("ag_carrier") == "fedex", F.col("_second") > 30).otherwise(_longest_and_girth() > 105)
    return _finding(
        "handling", (billed > 0) & F.col("_sized") & ~fits, UNSUPPORTED, F.lit(0), billed, billed,
        carrier=F.col("ag_carrier"), weight=weight, **_sizes(),
    )


def large_package_check() -> Column:
    billed = _amount("large_package_billed")
    fits = (_longest_and_girth() > 165) | (F.col("_longest") > F.when(F.col("ag_carrier") == "fedex", 96).otherwise(108))
    return _finding(
        "large", (billed > 0) & F.col("_sized") & ~fits, UNSUPPORTED, F.lit(0), billed, billed,
        carrier=F.col("ag_carrier"), length=F.col("_l"), width=F.col("_w"), height=F.col("_h"),
    )


def area_check() -> Column:
    billed = _amount("das_billed")
    return _finding("area", (billed > 0) & F.col("area_tier").isNull(), UNSUPPORTED, F.lit(0), billed, billed, carrier=F.col("ag_carrier"), zip=F.col("zip_key"))


def duplicate_check(order: str = "line_seq") -> Column:
    """A later bill of a repeated (tracking number, ship date)."""
    total = F.col("total_billed")
    return _finding("duplicate", (F.col(order) > F.col("first_seq")) & (total > 0), OVER, F.lit(0), total, total)


LINE_CHECKS = {
    "duplicate": duplicate_check,
    "guarantee": guarantee_check,
    "earned": earned_check,
    "dim": dim_check,
    "fuel": fuel_check,
    "minimum": minimum_check,
    "residential": residential_check,
    "handling": handling_check,
    "large": large_package_check,
    "address": address_check,
    "area": area_check,
}
# Values a check needs more than once, as layers of columns: each layer is its own
# projection, so that an expected amount is computed once and not once per use.
STEPS = {
    "guarantee": _guarantee_steps,
    "earned": _earned_steps,
    "dim": _dim_steps,
    "fuel": _fuel_steps,
    "minimum": _minimum_steps,
    "handling": _side_steps,
    "large": _side_steps,
}


def with_steps(lines: DataFrame, checks: list[str]) -> DataFrame:
    """Lines with the intermediate columns of the named checks."""
    layers: list[dict[str, Column]] = []
    for check in checks:
        for i, layer in enumerate(STEPS[check]() if check in STEPS else []):
            if i == len(layers):
                layers.append({})
            layers[i].update(layer)
    out = lines
    for layer in layers:
        out = out.withColumns(layer)
    return out


def enrich(
    lines: DataFrame,
    agreements: DataFrame,
    *,
    checks: list[str],
    fuel_rates: DataFrame | None = None,
    windows: DataFrame | None = None,
    calendar: DataFrame | None = None,
    area_zips: DataFrame | None = None,
) -> DataFrame:
    """Lines with everything the named checks need, and only that."""
    terms = agreement_terms(agreements)
    if "earned" in checks:
        terms = with_earned_tier(terms, rolling_revenue(lines, agreements))
    out = (attach_repeats(lines) if "duplicate" in checks else lines).join(terms, "agreement_id")
    if "fuel" in checks:
        out = attach_fuel_rate(out, fuel_rates)
    if "guarantee" in checks:
        out = attach_promise(attach_suspension(out, windows), calendar)
    if "area" in checks:
        out = attach_area_tier(out, area_zips)
    return with_steps(out, checks)


def run_checks(enriched: DataFrame, checks: list[str], order: str = "line_seq") -> DataFrame:
    """Findings of the named checks: one pass over the lines, no join per check."""
    # The checks are plain columns first (generated code), then one row per check.
    kept = ["agreement_id", "line_id", "tracking_number", "invoice_id", "transaction_id", "ship_date", "service_or_charge_type", order]
    judged = enriched.select(
        *kept, F.col("raw_line_text").alias("invoice_source_reference"),
        *[LINE_CHECKS[c]().alias(f"_check_{c}") for c in checks],
    )
    unfolded = judged.select(*kept, "invoice_source_reference", F.inline(F.array(*[f"_check_{c}" for c in checks])))
    return unfolded.where("check_ord is not null")


def attach_repeats(lines: DataFrame, order: str = "line_seq") -> DataFrame:
    """`first_seq`: the first line of a (tracking number, ship date) billed more than once.

    The first line of each repeated key comes from a map-side aggregate, and only keys
    seen more than once are joined back, so a key holding a large share of all lines is
    never gathered in one task. Lines without a tracking number join with nothing.
    """
    named = F.trim("tracking_number")
    keyed = lines.withColumn("dup_tracking", F.when((named != "") & (F.lower(named) != "unknown"), named))
    repeated = (
        keyed.where("dup_tracking is not null").groupBy("agreement_id", "dup_tracking", F.col("ship_date").alias("dup_day"))
        .agg(F.min(order).alias("first_seq"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    joined = keyed.alias("u").join(
        repeated.alias("r"),
        (F.col("u.agreement_id") == F.col("r.agreement_id"))
        & (F.col("u.dup_tracking") == F.col("r.dup_tracking"))
        & F.col("u.ship_date").eqNullSafe(F.col("r.dup_day")),
        "left",
    )
    return joined.select("u.*", "first_seq").drop("dup_tracking")


def duplicate_findings(lines: DataFrame, order: str = "line_seq") -> DataFrame:
    """Second and later bills of one (tracking number, ship date) with a positive total."""
    return run_checks(attach_repeats(lines, order).where("first_seq is not null"), ["duplicate"], order)


def _explanations() -> dict[int, Column]:
    """The sentence of each check, from what it saw."""
    seen = lambda name: F.col(f"evidence.{name}")
    cents = lambda c: c.cast(CENTS).cast("string")
    number = lambda c: c.cast("double").cast("string")
    tenths = lambda c: F.round(c, 1).cast("decimal(18,1)").cast("string")
    expected, billed = F.col("expected_value"), F.col("billed_value")
    carrier = F.upper(seen("carrier"))
    sides = [number(seen(c)) for c in ("length", "width", "height")]
    # The explanation sentences.
    sentences = {
        "duplicate": ("Tracking number %s billed more than once on %s", F.col("tracking_number"), F.col("ship_date").cast("string")),
        "guarantee": (
            "GSR eligible: promised %s by %s, delivered %s. Full refund of $%s eligible.",
            seen("promised_date").cast("string"), F.coalesce(seen("commit_time"), F.lit("EOD")), F.date_format(seen("delivered"), "yyyy-MM-dd HH:mm:ss"), cents(billed),
        ),
        LAYERED_ORD: (
            "Published $%s × contract multi-layer discount (%s%% effective) = expected $%s, billed $%s",
            cents(seen("base")), tenths(seen("effective_pct")), cents(expected), cents(billed),
        ),
        "earned": (
            "Rolling revenue $%s -> tier expects %s%%, applied %s%% ($%s vs $%s)",
            F.format_number("evidence.rolling_revenue", 0), tenths(seen("discount_pct")), tenths(seen("effective_pct")), cents(billed), cents(expected),
        ),
        "dim": (
            "DIM divisor %s: ceil(%s)×ceil(%s)×ceil(%s)/%s = %s lb DIM, rated %s lb, billed %s lb",
            seen("divisor").cast("string"), *sides, seen("divisor").cast("string"), seen("dim_lbs").cast("string"), number(expected), number(billed),
        ),
        "fuel": (
            "Published rate %s%% - %s%% contracted discount = %s%% effective. Base: $%s. Expected: $%s, Billed: $%s",
            number(seen("published_pct")), number(seen("discount_pct")), F.round(seen("effective_pct"), 3).cast("decimal(18,3)").cast("string"),
            cents(seen("base")), cents(expected), cents(billed),
        ),
        "minimum": ("Contract MNC $%s but published default $%s applied", cents(expected), cents(seen("base"))),
        "residential": ("Contract specifies flat residential fee of $%s, billed $%s", cents(expected), cents(billed)),
        COMMERCIAL_ORD: ("Residential surcharge applied to commercial address",),
        "handling": ("AHS charged but package dims %sx%sx%s and weight %s lbs do not meet %s AHS criteria", *sides, number(seen("weight")), carrier),
        "large": (
            "Large Package Surcharge charged but dims %sx%sx%s do not meet %s large package threshold",
            *[seen(c).cast("int").cast("string") for c in ("length", "width", "height")], carrier,
        ),
        "address": ("Contract address correction fee: $%s, billed: $%s", cents(expected), cents(billed)),
        "area": ("ZIP %s is not on %s DAS list but DAS was charged", seen("zip"), carrier),
    }
    orders = {check: check if isinstance(check, int) else CHECKS[check][0] for check in sentences}
    return {orders[check]: F.format_string(*parts) if len(parts) > 1 else F.lit(parts[0]) for check, parts in sentences.items()}


def _fact(i: int) -> Column:
    """Field (0), confidence (1) or reason (2) of a finding's check."""
    facts = {order: (field, conf, why) for order, field, conf, why in CHECKS.values()} | VARIANTS
    return _literal_int_map([(o, F.lit(f[i])) for o, f in facts.items()])[F.col("check_ord")]


#: What `describe` adds; all of it follows from the other columns.
DESCRIBED = ["field", "confidence", "why_discrepancy", "explanation", "expected_amount", "billed_amount", "dollar_discrepancy"]


def finding_field() -> Column:
    """Field of a finding that is not described yet."""
    return _fact(0)


def describe(findings: DataFrame) -> DataFrame:
    """Field, confidence and texts of each finding, added after the checks so that only
    findings pay for them."""
    by_check = iter(_explanations().items())
    order, text = next(by_check)
    explanation = F.when(F.col("check_ord") == order, text)
    for order, text in by_check:
        explanation = explanation.when(F.col("check_ord") == order, text)
    return findings.select(
        "*",
        finding_field().alias("field"),
        _fact(1).alias("confidence"),
        _fact(2).alias("why_discrepancy"),
        explanation.alias("explanation"),
        F.col("expected_value").alias("expected_amount"),
        F.col("billed_value").alias("billed_amount"),
        F.col("dollar_impact").alias("dollar_discrepancy"),
    )


def _literal_int_map(pairs: list[tuple[int, Column]]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), val) for k, val in pairs))


def storage_findings(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """Warehouse storage lines against the contract rate and unit (two checks per line)."""
    joined = lines.where(F.lower(F.trim("service_category")) == "storage").join(terms, "agreement_id")
    rate, billed = F.col("storage_rate"), F.col("rate_billed")
    due = F.col("quantity_billed").cast("decimal(14,4)") * rate.cast("decimal(14,4)")
    shape = "struct<field: string, discrepancy_type: string, expected_value: {m}, billed_value: {m}, expected_amount: {c}, dollar_impact: {c}, explanation: string>".format(m=MONEY, c=CENTS)
    rate_off = F.when(
        F.abs(billed - rate) > F.lit("0.01").cast("decimal(4,2)"),
        F.struct(
            F.lit("storage_rate"), F.when(billed > rate, OVER).otherwise(UNDER), rate, billed,
            F.round(due, 2), F.round(F.col("amount_billed") - due, 2), F.lit("3PL storage billed rate differs from contract rate."),
        ).cast(shape),
    )
    zero = F.lit(0).cast(MONEY)
    unit_text = F.format_string("Storage billed as %s, contract expects %s.", F.coalesce("unit_of_measure", F.lit("None")), F.col("storage_unit"))
    unit_off = F.when(
        (F.col("storage_unit") != "") & (F.coalesce(F.col("unit_of_measure"), F.lit("")) != F.col("storage_unit")),
        F.struct(F.lit("storage_unit"), F.lit(AMBIGUOUS), F.lit(None).cast(MONEY), zero, F.lit(None).cast(CENTS), zero, unit_text).cast(shape),
    )
    found = F.filter(F.array(rate_off, unit_off), lambda f: f.isNotNull())
    return joined.select("line_id", "agreement_id", F.col("reference_id").alias("tracking_number"), "service_category", F.inline(found))
