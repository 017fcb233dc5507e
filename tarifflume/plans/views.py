"""Audit inputs derived from the star-schema tables.

The given tables hold no parcel data, so every query first maps them to the data model:
lines from `lineitem`, agreements from `supplier`, weekly rates from the calendar, and so
on. All values are exact decimals so that another engine can reproduce them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarifflume.schemas import AGREEMENT_DDL
from tarifflume.session import dealt
from tarifflume.sources import documents as docs
from tarifflume.sources.reference import business_calendar, us_federal_holidays

FIRST_SHIP_DAY = "2024-01-01"
LAST_FUEL_WEEK = "2026-04-20"

# Reference rows of the views (suspension windows and one fuel series base per class).
WINDOWS = [
    ("fedex", "2024-11-25", "2025-01-05"),
    ("ups", "2024-11-25", "2025-01-05"),
    ("fedex", "2025-11-24", "2026-01-04"),
    ("ups", "2025-11-24", "2026-01-04"),
    ("ups", "2025-12-20", "2026-01-10"),
]
FUEL_SERIES = [("fedex", "ground", "12.25"), ("fedex", "express", "14.75"), ("ups", "ground", "11.75"), ("ups", "air", "15.25")]


class Views:
    """Lazily built views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread_table(self, name: str, per_core: int = 1) -> DataFrame:
        """A table whose scan has fewer than `per_core` splits to a core, spread over so many.

        Only small inputs qualify (one row group in one file); a large scan has far more
        splits than cores and keeps them.
        """
        scan = self.table(name)
        tasks = self.spark.sparkContext.defaultParallelism * per_core
        return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan

    @cached_property
    def line_base(self) -> DataFrame:
        """Exact columns of `lineitem` plus the order-preserving `line_seq`."""
        ship = "date_add(date'2024-01-01', cast(datediff(cast(l_shipdate as date), date'1995-01-01') % 820 as int))"
        return self.spread_table("lineitem").selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "cast(l_quantity as decimal(10,2)) qty",
            "cast(l_extendedprice as decimal(12,2)) price",
            "cast(l_discount as decimal(4,2)) disc",
            "cast(l_tax as decimal(4,2)) tax",
            f"{ship} ship_date",
            "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) line_seq",
        )

    @cached_property
    def invoice_line(self) -> DataFrame:
        dec = "decimal(18,4)"
        base = self.line_base.selectExpr(
            "*",
            f"cast(price * 0.001 as {dec}) published_charge",
            f"cast(price * 0.001 * (1 - disc) as {dec}) net_transport_charge",
            f"cast(cast(price * 0.001 * (0.08 + tax) as decimal(18,2)) as {dec}) fuel_surcharge_billed",
            f"cast(case when l_orderkey % 4 = 0 then 4.45 + 0.05 * (l_linenumber % 4) end as {dec}) residential_surcharge_billed",
            f"cast(case when l_partkey % 6 = 1 then 3.55 end as {dec}) das_billed",
            f"cast(case when l_partkey % 8 = 3 then 15.50 end as {dec}) ahs_billed",
            f"cast(case when l_partkey % 16 = 5 then 95.00 end as {dec}) large_package_billed",
            f"cast(case when l_orderkey % 9 = 2 then 17.50 + 0.25 * l_linenumber end as {dec}) address_correction_billed",
            "case when l_suppkey % 2 = 0 then 'fedex' else 'ups' end carrier",
        )
        total = " + ".join(
            ["net_transport_charge", "fuel_surcharge_billed"]
            + [f"coalesce({c}, 0)" for c in ("residential_surcharge_billed", "das_billed", "ahs_billed", "large_package_billed", "address_correction_billed")]
        )
        return base.selectExpr(
            "l_suppkey agreement_id",
            "line_seq", "carrier", "l_orderkey", "l_linenumber", "l_partkey",
            "concat(cast(l_orderkey as string), ':', cast(l_linenumber as string)) line_id",
            "case when l_orderkey % 97 = 0 then 'Unknown' when l_orderkey % 101 = 0 then ' ' when l_orderkey % 7 = 3 then concat('BULK-', cast(l_orderkey % 5 as string)) else cast(l_orderkey as string) end tracking_number",
            "cast(l_orderkey as string) transaction_id",
            "concat('INV-', cast(l_suppkey as string)) invoice_id",
            "ship_date",
            "case when l_partkey % 11 <> 0 then make_timestamp_ntz(year(date_add(ship_date, l_linenumber)), month(date_add(ship_date, l_linenumber)), "
            "day(date_add(ship_date, l_linenumber)), cast(8 + l_partkey % 11 as int), cast(l_orderkey % 60 as int), 0) end actual_delivery_datetime",
            "case when carrier = 'fedex' then element_at(array('fedex_ground','fedex_home_delivery','fedex_priority_overnight','fedex_2day','fedex_express_saver','fedex_ground_economy'), cast(1 + l_partkey % 6 as int))"
            " else element_at(array('ups_ground','ups_ground_saver','ups_next_day_air','ups_2nd_day_air','ups_3_day_select','ups_next_day_air_saver'), cast(1 + l_partkey % 6 as int)) end service_code",
            "case when carrier = 'fedex' then element_at(array('ground','home_delivery','express','express','express','ground_economy'), cast(1 + l_partkey % 6 as int))"
            " else element_at(array('ground','ground_saver','express','express','ground','express'), cast(1 + l_partkey % 6 as int)) end service_group",
            "concat('Service ', cast(l_partkey % 6 as string)) service_or_charge_type",
            "lpad(cast(l_partkey * 37 % 100000 as string), 5, '0') destination_zip",
            "cast(2 + l_partkey % 7 as int) zone",
            f"cast(qty * 1.7 as {dec}) actual_weight_lbs",
            f"cast(4.3 + l_partkey % 110 as {dec}) length",
            f"cast(3.1 + l_orderkey % 50 as {dec}) width",
            f"cast(2 + (l_partkey + l_orderkey) % 40 as {dec}) height",
            f"cast(ceil(qty * 1.7) + l_orderkey % 3 as {dec}) rated_weight_lbs",
            f"cast(0.5 + 0.1 * l_linenumber as {dec}) rate_per_lb",
            "published_charge",
            "case when l_partkey % 5 <> 0 then published_charge end transport_charge",
            f"cast(case when l_partkey % 10 = 0 then published_charge * 0.12 when l_partkey % 10 = 1 then 0 end as {dec}) earned_discount_applied",
            f"cast(- published_charge * disc as {dec}) incentive_credit",
            "net_transport_charge", "fuel_surcharge_billed", "residential_surcharge_billed", "das_billed", "ahs_billed",
            "large_package_billed", "address_correction_billed",
            f"cast({total} as {dec}) total_billed",
            f"cast({total} as {dec}) billed_amount",
            "case l_orderkey % 3 when 0 then true when 1 then false end is_residential",
            "case l_orderkey % 13 when 0 then 'weather' when 1 then 'ADDRESS_ERROR' when 2 then 'damage' end carrier_exception_code",
            "concat('line ', cast(l_orderkey as string), ' ', cast(l_linenumber as string)) raw_line_text",
        )

    @cached_property
    def agreement(self) -> DataFrame:
        """One agreement per supplier, with every kind of term the audit reads."""
        m, p = "decimal(18,4)", "decimal(8,4)"
        pct_map = lambda *pairs: "map(" + ", ".join(f"'{k}', cast({x} as {p})" for k, x in pairs) + ")"
        tiers = (
            f"array(named_struct('threshold_min', cast(null as {m}), 'threshold_max', cast(25000 as {m}), 'discounts', {pct_map(('fedex_ground', 5), ('ups_ground', 4))}),"
            f" named_struct('threshold_min', cast(25000 as {m}), 'threshold_max', cast(60000 as {m}), 'discounts', {pct_map(('fedex_ground', 8), ('fedex_2day', 12), ('ups_ground', 6))}),"
            f" named_struct('threshold_min', cast(60000 as {m}), 'threshold_max', cast(null as {m}), 'discounts', {pct_map(('fedex_ground', 11), ('fedex_2day', 15), ('ups_ground', 9), ('ups_2nd_day_air', 20))}))"
        )
        band = lambda lo, hi, x: f"named_struct('min_lbs', cast({lo} as {m}), 'max_lbs', cast({hi} as {m}), 'discount_pct', cast({x} as {p}))"
        no_zone, no_band = f"cast(null as map<string,{p}>)", f"cast(null as array<struct<min_lbs:{m},max_lbs:{m},discount_pct:{p}>>)"
        rule = lambda alias, zones, flat, bands: (
            f"named_struct('alias', cast({alias} as string), 'zone_exceptions', {zones}, 'flat_discount_pct', cast({flat} as {p}), 'by_weight', {bands})"
        )
        base = (
            "map('ups_ground', " + rule("null", "map('2', cast(31.5 as " + p + "), '8', cast(12 as " + p + "))", "null",
                                        f"array({band('null', 10, 20)}, {band(10, 50, 25)}, {band(50, 'null', 30.5)})")
            + ", 'ups_2nd_day_air', " + rule("null", no_zone, "40.25", no_band)
            + ", 'ups_3_day_select', " + rule("'ups_2nd_day_air'", no_zone, "null", no_band) + ")"
        )
        kind = "case when s_suppkey % 4 = 1 then 'ups_multi_layer' when s_suppkey % 4 = 3 then 'tiers' when s_suppkey % 8 = 0 then null else 'tiers' end"
        out = self.table("supplier").selectExpr(
            "s_suppkey agreement_id",
            "case when s_suppkey % 7 = 0 then '' else concat('AG-', cast(s_suppkey as string)) end contract_ref",
            "case when s_suppkey % 5 = 0 then concat('client ', cast(s_suppkey as string)) end client_id",
            "case when s_suppkey % 10 = 1 then null else s_name end customer_name",
            "case when s_suppkey % 2 = 0 then ' FedEx' else 'UPS ' end carrier",
            "case when s_suppkey % 10 = 9 then 'pending_review' when s_suppkey % 10 = 8 then 'rejected' else 'approved' end status",
            f"named_struct('discount_pct', cast(case when s_suppkey % 5 = 4 then null else (s_suppkey % 4) * 5.5 end as {p}), 'expiration_date', case when s_suppkey % 3 = 0 then date'2025-06-30' end) fuel_surcharge",
            f"map('residential_delivery', named_struct('flat_fee_override', cast(case when s_suppkey % 3 = 1 then 4.50 end as {m})), 'address_correction', named_struct('flat_fee_override', cast(case when s_suppkey % 3 <> 2 then 18.25 end as {m}))) accessorials",
            "map('express', case when s_suppkey % 6 = 5 then 'Waived' else 'Active' end) gsr_status",
            f"map('ground', cast(8.25 as {m}), 'express', cast(case when s_suppkey % 4 = 2 then 10.75 else 13 end as {m})) minimum_net_charge",
            f"array(named_struct('ord', 1, 'divisor', cast(case when s_suppkey % 3 = 0 then 0 when s_suppkey % 3 = 1 then null else 194.9 end as {m})), named_struct('ord', 2, 'divisor', cast(case when s_suppkey % 3 = 0 then 166 end as {m}))) dim_rules",
            f"named_struct('kind', {kind}, 'tiers', case when s_suppkey % 8 <> 0 then {tiers} end, 'base_discounts', {base}, 'tier_discounts', {pct_map(('ups_ground', 3.5), ('ups_2nd_day_air', 10))}) earned",
        )
        return out.selectExpr(*[f"cast({name} as {sql}) {name}" for name, sql in _fields(AGREEMENT_DDL)])

    @cached_property
    def approved(self) -> DataFrame:
        return self.agreement.where("status = 'approved'")

    @cached_property
    def fuel_rate(self) -> DataFrame:
        """104 weeks of four series."""
        series = self.spark.createDataFrame(FUEL_SERIES, "carrier string, class string, base string")
        return series.select("*", F.explode(F.sequence(F.lit(0), F.lit(103))).alias("i")).selectExpr(
            "carrier", "class", f"date_sub(date'{LAST_FUEL_WEEK}', 7 * i) week_start",
            "cast(cast(base as decimal(6,2)) + ((i % 13) - 6) * 0.06 as decimal(8,4)) pct",
        )

    @cached_property
    def windows(self) -> DataFrame:
        rows = self.spark.createDataFrame(WINDOWS, "carrier string, s string, e string")
        return rows.selectExpr("carrier", "to_date(s) start_date", "to_date(e) end_date")

    @cached_property
    def calendar(self) -> DataFrame:
        """Every day from 1990 to 2100, so no line's ship date lies outside."""
        return business_calendar(self.spark, us_federal_holidays(self.spark))

    @cached_property
    def area_zip(self) -> DataFrame:
        """ZIPs of two thirds of the parts; at most 100,000 distinct values exist."""
        return (
            self.table("part").where("p_partkey % 3 <> 1")
            .selectExpr("explode(array('fedex', 'ups')) carrier", "lpad(cast(p_partkey * 37 % 100000 as string), 5, '0') zip",
                        "case when p_partkey % 2 = 0 then 'metro' else 'rural' end tier", "p_partkey row_ord")
            .where("carrier = 'fedex' or row_ord % 5 <> 0")
            .groupBy("carrier", "zip").agg(F.max_by("tier", "row_ord").alias("tier"))
        )

    @property
    def reference(self) -> dict[str, DataFrame]:
        return {"fuel_rates": self.fuel_rate, "windows": self.windows, "calendar": self.calendar, "area_zips": self.area_zip}

    # ------------------------------------------------------------ invoice text

    @cached_property
    def invoice_page(self) -> DataFrame:
        """Invoice pages as text: one document per supplier, one page per order of it."""
        line = self.line_base.selectExpr(
            "l_suppkey doc_id", "l_orderkey + 1 page_number", "line_seq", "l_orderkey k", "l_linenumber n", "l_partkey p",
            "date_format(ship_date, 'MM/dd/yyyy') day",
            "cast(cast(price * 0.001 as decimal(10,2)) as string) published",
            "cast(cast(price * 0.001 * disc as decimal(10,2)) as string) credit",
            "cast(cast(price * 0.001 * (1 - disc) as decimal(10,2)) as string) billed",
            "cast(cast(price * 0.0001 as decimal(10,2)) as string) fuel",
            "cast(cast(qty as int) as string) weight",
        )
        ups = [
            "case when n % 3 = 1 then day end",
            "case when k % 41 = 0 and n = 7 then 'Billing Adjustments' end",
            "concat('1Z', lpad(cast(k as string), 10, '0'), lpad(cast(p % 1000000 as string), 6, '0'), case n % 4 when 0 then ' Ground Residential' when 1 then ' Next Day Air' when 2 then ' 2nd Day Air' else ' UPS SurePost' end,"
            " case when n % 5 <> 4 then concat(' ', lpad(cast(p * 37 % 100000 as string), 5, '0'), ' ', cast(2 + p % 7 as string), ' ', weight) else '' end,"
            " case n % 3 when 0 then concat(' ', billed) when 1 then concat(' ', published, ' -', credit, ' ', billed) else concat(' ', published, ' ', billed) end)",
            "case when n % 2 = 0 then concat('1st ref ', cast(k as string), ' 12.34') end",
            "case when n % 5 in (3, 4) then concat('Customer Weight ', cast(1 + p % 60 as string), '.5') end",
            "concat('Fuel Surcharge ', fuel)",
            "case when k % 4 = 0 then 'Residential Delivery 4.45' end",
            "case when p % 6 = 1 then 'Extended Delivery Area 3.55' end",
            "case when p % 12 = 1 then 'Delivery Area Surcharge 1.05' end",
            "case when n % 4 <> 2 then concat('Total ', billed, ' ', cast(cast(cast(billed as decimal(10,2)) + cast(fuel as decimal(10,2)) as decimal(10,2)) as string)) end",
            "case when n % 4 = 3 then concat('Total Billed ', published) end",
        ]
        block = [
            "case when n % 3 = 1 then 'FedEx Ground Prepaid Detail' when n % 3 = 2 then 'Priority Overnight package' end",
            "case when n % 2 = 0 then concat('Ship Date: ', date_format(to_date(day, 'MM/dd/yyyy'), 'MMM dd, yyyy')) when n % 7 <> 3 then concat('Ship Date: ', day) end",
            "case when n % 6 <> 5 then concat('Tracking ID ', lpad(cast(k * 10 + n as string), 12, '0')) end",
            "concat('Zone ', cast(2 + p % 7 as string), '  ', lpad(cast(p * 37 % 100000 as string), 5, '0'))",
            "concat('Transportation Charge $', published)",
            "case when p % 4 <> 0 then concat('Fuel Surcharge ', fuel) end",
            "case when n % 5 <> 0 then concat('Rated Weight ', weight, '.5 lbs') end",
        ]
        pieces = "case when doc_id % 2 = 1 then array(" + ", ".join(ups) + ") else array(" + ", ".join(block) + ") end"
        chunks = line.selectExpr("doc_id", "page_number", "line_seq", f"array_join({pieces}, '\\n') body")
        heading = (
            "concat('Invoice Number: INV', cast(doc_id as string), '-', lpad(cast(page_number as string), 5, '0'), '\\n', 'Invoice Date: ', "
            "case when doc_id % 3 = 0 then 'January 15, 2025' else '02/03/2025' end, '\\n', 'Carrier ', case when doc_id % 2 = 1 then 'UPS' else 'Express' end, '\\n')"
        )
        return (
            dealt(chunks, "doc_id", "page_number").groupBy("doc_id", "page_number")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_seq", "body"))), lambda x: x["body"]), "\n").alias("body"))
            .selectExpr("doc_id", "page_number", f"concat({heading}, body) text")
        )

    @cached_property
    def invoice_text_line(self) -> DataFrame:
        return docs.text_lines(self.invoice_page)

    @cached_property
    def invoice_marked_page(self) -> DataFrame:
        return self.invoice_page.select("doc_id", "page_number", docs.marked_page().alias("text"))


def _fields(ddl: str) -> list[tuple[str, str]]:
    """Top-level (name, type) pairs of a DDL text."""
    out, depth, word = [], 0, ""
    for ch in ddl + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            name, sql = word.strip().split(None, 1)
            out.append((name, sql))
            word = ""
        else:
            word += ch
    return out
