"""Contract rating over the relational model: service terms, zone rates, weight tiers, surcharges.

A rate card is small next to the shipments: its tiers are nested per (term, zone), unique
by lower bound, so a shipment finds its rate with one equi-join and no fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifflume.schemas import MONEY

# Carrier charge codes and their names.
CHARGE_CODES: list[tuple[str, str]] = [
    ("RES", "Residential Delivery Surcharge"),
    ("FSC", "Fuel Surcharge"),
    ("DAS", "Delivery Area Surcharge"),
    ("EDAS", "Extended Delivery Area Surcharge"),
    ("RDAS", "Remote Delivery Area Surcharge"),
    ("AHS", "Additional Handling Surcharge"),
    ("OSP1", "Oversize Package (Tier 1)"),
    ("OSP2", "Oversize Package (Tier 2)"),
    ("SIGSVC", "Signature Required Service"),
    ("ADSIG", "Adult Signature Required"),
    ("SAT", "Saturday Delivery"),
    ("SUN", "Sunday / Holiday Delivery"),
    ("RET", "Return Shipment"),
    ("COD", "Collect on Delivery"),
    ("INSURE", "Declared Value / Insurance"),
    ("ADDR", "Address Correction"),
    ("HB", "Hundredweight / Multi-piece Discount"),
    ("PEAK", "Peak / Demand Surcharge"),
]


def rate_cards(tiers: DataFrame) -> DataFrame:
    """(contract_id, service_type, zone, tiers) with tiers sorted by lower bound."""
    return tiers.groupBy("contract_id", "service_type", "zone").agg(
        F.array_sort(F.collect_list(F.struct("min_weight", "max_weight", "base_rate"))).alias("tiers")
    )


def billing_weight(weight: Column, mode: Column) -> Column:
    """Declared rounding modes of the billed weight (an extension: the modes are only named)."""
    return (
        F.when(mode == "NEXT_WHOLE_POUND", F.ceil(weight).cast(MONEY))
        .when(mode == "NEAREST_POUND", F.round(weight, 0).cast(MONEY))
        .when(mode == "NEXT_HALF_POUND", (F.ceil(weight * 2).cast("decimal(16,0)") * F.lit("0.5").cast("decimal(2,1)")).cast(MONEY))
        .otherwise(weight.cast(MONEY))
    )


def with_service_term(shipments: DataFrame, terms: DataFrame) -> DataFrame:
    """Term of each shipment's service; `rating_error` tells when the contract has none."""
    found = terms.select("contract_id", "service_type", "discount_percentage", "minimum_charge", F.lit(True).alias("_known"))
    return (
        shipments.join(found, ["contract_id", "service_type"], "left")
        .withColumn("rating_error", F.when(F.col("_known").isNull(), F.lit("service_not_found")))
        .drop("_known")
    )


def with_base_rate(shipments: DataFrame, tiers: DataFrame) -> DataFrame:
    """Published rate by zone and weight: bounds inclusive, the lower tier wins a shared edge."""
    w = F.col("weight")
    hit = F.filter("tiers", lambda t: (t["min_weight"] <= w) & (t["max_weight"].isNull() | (w <= t["max_weight"])))
    joined = shipments.join(rate_cards(tiers), ["contract_id", "service_type", "zone"], "left")
    base = F.get(hit, 0)["base_rate"]
    error = F.when(F.col("tiers").isNull(), "zone_not_found").when(base.isNull(), "tier_not_found")
    earlier = F.col("rating_error") if "rating_error" in shipments.columns else F.lit(None).cast("string")
    return joined.withColumn("base_rate", base).withColumn("rating_error", F.coalesce(earlier, error)).drop("tiers")


def with_net_rate(rated: DataFrame) -> DataFrame:
    """Discounted rate, not below the minimum charge."""
    kept = (F.col("base_rate") * (F.lit(100) - F.col("discount_percentage"))).cast("decimal(26,8)")
    net = (kept * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)
    return rated.withColumn("net_rate", F.when(net.isNotNull(), F.greatest(net, F.col("minimum_charge"))))


def applicable_surcharges(shipments: DataFrame, surcharges: DataFrame) -> DataFrame:
    """Every surcharge of the contract whose conditions fit the shipment; empty scopes fit all."""
    s, c = shipments.alias("s"), surcharges.alias("c")
    empty = lambda col: F.coalesce(F.size(col), F.lit(0)) <= 0
    fits = (
        (F.col("s.contract_id") == F.col("c.contract_id"))
        & (empty(F.col("c.services")) | F.array_contains("c.services", F.col("s.service_type")))
        & (empty(F.col("c.zones")) | F.array_contains("c.zones", F.col("s.zone")))
        & (F.coalesce(F.col("c.shipment_type"), F.lit("ALL")).isin("ALL", "") | (F.col("c.shipment_type") == F.col("s.shipment_type")))
        & (F.col("c.min_weight").isNull() | (F.col("s.weight") >= F.col("c.min_weight")))
        & (F.col("c.max_weight").isNull() | (F.col("s.weight") <= F.col("c.max_weight")))
    )
    return s.join(c, fits).select("s.*", "c.charge_code", "c.charge_format", "c.modification_type", "c.value")


def charge_amount(fmt: Column, value: Column, base: Column, weight: Column, referenced: Column) -> Column:
    """Dollar amount of a charge by its format (an extension: specified only in words)."""
    share = lambda amount: F.round((amount.cast("decimal(14,4)") * value.cast("decimal(10,4)")).cast("decimal(26,8)") * F.lit("0.01").cast("decimal(2,2)"), 4)
    return (
        F.when(fmt == "PERCENTAGE", share(base))
        .when(fmt == "PERCENTAGE_OF_CHARGE", share(referenced))
        .when(fmt.isin("FLAT_AMOUNT", "PER_PACKAGE"), value)
        .when(fmt == "PER_POUND", (value.cast("decimal(10,4)") * weight.cast("decimal(14,4)")).cast(MONEY))
        .when(fmt == "WAIVED", F.lit(0))
        .cast(MONEY)
    )


def contract_charge(modification: Column, published: Column, amount: Column, fmt: Column, value: Column) -> Column:
    """What the contract pays, from the published surcharge and the modification."""
    pct = fmt.isin("PERCENTAGE", "PERCENTAGE_OF_CHARGE")
    shift = F.when(
        pct, F.round((published.cast("decimal(14,4)") * value.cast("decimal(10,4)")).cast("decimal(26,8)") * F.lit("0.01").cast("decimal(2,2)"), 4)
    ).otherwise(amount)
    return (
        F.when(modification == "WAIVER", F.lit(0))
        .when(modification == "OVERRIDE", value)
        .when(modification == "DISCOUNT", published - shift)
        .when(modification == "MARKUP", published + shift)
        .cast(MONEY)
    )


def with_charge_name(rows: DataFrame) -> DataFrame:
    """Names of the known charge codes; the table has a fixed, tiny size."""
    names = rows.sparkSession.createDataFrame(CHARGE_CODES, "charge_code string, charge_name string")
    return rows.join(F.broadcast(names), "charge_code", "left")


def tier_breaks(tiers: DataFrame) -> DataFrame:
    """Tiers that do not meet the next one: an open tier before the last, a gap or an overlap."""
    order = Window.partitionBy("contract_id", "service_type", "zone").orderBy("min_weight")
    nxt = F.lead("min_weight").over(order)
    problem = F.when(F.col("max_weight").isNull(), "open_tier_not_last").when(nxt > F.col("max_weight"), "gap").when(nxt < F.col("max_weight"), "overlap")
    judged = tiers.withColumn("next_min", nxt).withColumn("problem", F.when(F.col("next_min").isNotNull(), problem))
    return judged.where("problem is not null").select("contract_id", "service_type", "zone", "min_weight", "max_weight", "next_min", "problem")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values used more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def _violations(rows: DataFrame, entity: str, key: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]))
    return rows.select(F.lit(entity).alias("entity"), key.cast("string").alias("key"), F.explode(codes).alias("code"))


def contract_violations(contracts: DataFrame) -> DataFrame:
    return _violations(contracts, "contract", F.col("contract_id"), [
        ("expiration_not_after_effective", F.col("expiration_date") <= F.col("effective_date")),
        ("notice_without_auto_renew", F.col("cancellation_notice_days").isNotNull() & ~F.coalesce("auto_renews", F.lit(False))),
        ("negative_notice", F.col("cancellation_notice_days") < 0),
    ])


def term_violations(terms: DataFrame) -> DataFrame:
    return _violations(terms, "service_term", F.concat_ws("/", F.col("contract_id"), "service_type"), [
        ("discount_out_of_range", (F.col("discount_percentage") < 0) | (F.col("discount_percentage") > 100)),
        ("negative_minimum", F.col("minimum_charge") < 0),
        ("dim_divisor_below_one", F.col("dim_divisor") < 1),
    ])


def tier_violations(tiers: DataFrame) -> DataFrame:
    return _violations(tiers, "weight_tier", F.concat_ws("/", F.col("contract_id"), "service_type", "zone", F.col("min_weight")), [
        ("negative_weight", F.col("min_weight") < 0),
        ("max_not_above_min", F.col("max_weight") <= F.col("min_weight")),
        ("negative_rate", F.col("base_rate") < 0),
        ("blank_zone", F.length("zone") < 1),
    ])


def surcharge_violations(surcharges: DataFrame) -> DataFrame:
    return _violations(surcharges, "surcharge", F.concat_ws("/", F.col("contract_id"), "charge_code"), [
        ("blank_code", F.length("charge_code") < 1),
        ("negative_value", F.col("value") < 0),
        ("waived_value_not_zero", (F.col("charge_format") == "WAIVED") & (F.col("value") != 0)),
        ("percentage_above_100", F.col("charge_format").isin("PERCENTAGE", "PERCENTAGE_OF_CHARGE") & (F.col("value") > 100)),
        ("weight_range", F.col("max_weight") <= F.col("min_weight")),
    ])


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def contracts_in_force(dated: DataFrame, contracts: DataFrame, day: str, months: int = 24, years: int = 40) -> DataFrame:
    """Contracts of the row's account that are in force on its date (both ends inclusive).

    Contracts are unfolded to the months they touch, those of over `months` months to years, and
    open or longer than `years` to one bin, so each has a bounded number of rows. A dated row
    looks into its month, its year and the open bin of its account: it meets the contracts of that
    month, not all its account ever had. The dates are tested after.
    """
    first, last = _month(F.col("effective_date")), _month(F.col("expiration_date"))
    bins = lambda kind, low, high: F.transform(F.sequence(low, high), lambda n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n")))
    open_bin = F.struct(F.lit("open").alias("kind"), F.lit(0).alias("n"))
    spread = (
        F.when(F.col("expiration_date").isNull() | (last - first > 12 * years), F.array(open_bin))
        .when(last - first <= months, bins("month", first, last))
        .otherwise(bins("year", F.floor(first / 12), F.floor(last / 12)))
    )
    alive = contracts.where(F.col("expiration_date").isNull() | (F.col("effective_date") <= F.col("expiration_date")))
    unfolded = alive.select("account", "contract_id", "effective_date", "expiration_date", F.explode(spread).alias("bin"))
    month = _month(F.col(day))
    own = F.array(open_bin, F.struct(F.lit("month").alias("kind"), month.cast("int").alias("n")), F.struct(F.lit("year").alias("kind"), F.floor(month / 12).cast("int").alias("n")))
    rows = dated.where(F.col(day).isNotNull()).withColumn("_bin", F.explode(own))
    on = (F.col("d.account") == F.col("c.account")) & (F.col("d._bin.kind") == F.col("c.bin.kind")) & (F.col("d._bin.n") == F.col("c.bin.n"))
    inside = (F.col("c.effective_date") <= F.col(f"d.{day}")) & (F.col("c.expiration_date").isNull() | (F.col(f"d.{day}") <= F.col("c.expiration_date")))
    # Spark takes the unfolded side for as small as its files: a sort-merge join holds whatever comes out of them.
    return rows.alias("d").join(unfolded.hint("merge").alias("c"), on).where(inside).select("d.*", "c.contract_id").drop("_bin")
