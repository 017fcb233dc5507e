"""Plans whose cost must not grow faster than their input: what they deal, and how often."""

from __future__ import annotations

import re

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def of(spark, name: str) -> str:
    return plan(entry.queries()[name](spark, FOLDER))


def test_statistics_of_extractions_meet_in_one_aggregate(spark):
    assert of(spark, "e35_extraction_stats").count("Exchange ") <= 30  # 43 before


def test_service_terms_read_pages_once_for_their_text_pricing(spark):
    assert of(spark, "e16_assembled_service_terms").count("Exchange ") <= 13  # 24 before


def test_table_pricing_is_dealt_over_all_partitions(spark):
    assert "REPARTITION_BY_NUM" in of(spark, "e3_e9_zone_pricing")
    weights = of(spark, "e4_e10_ups_weight_pricing")
    assert "REPARTITION_BY_NUM" in weights and "text" not in weights.split("SortMergeJoin")[0]


def test_invoice_parsers_and_their_context_read_one_exchange_of_pages(spark):
    for name in ("t1_tracking_shipments", "t3_amount_lines"):
        shown = of(spark, name)
        asked = re.sub(r"#\d+L?", "", shown)
        assert len({tuple(sorted(x.split(", "))) for x in re.findall(r"DataFilters: \[(.*?)\], Format", asked)}) == 1  # else they are other exchanges


def test_invoice_context_searches_a_page_once_for_a_pattern(spark):
    assert "RLIKE(text" not in of(spark, "f6_f7_invoice_context")


def test_section_types_search_each_pattern_once_a_text(spark):
    assert of(spark, "e31_e39_section_types").count("RLIKE(") <= 2 * 57  # the filter on the type repeated them all


def test_blocks_of_long_documents_are_dealt_over_all_partitions(spark):
    for name in ("e29_repeated_headers", "e30_e38_sections"):
        shown = of(spark, name)
        assert "REPARTITION_BY_NUM" in shown and "REPARTITION_BY_COL" not in shown
