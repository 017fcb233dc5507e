"""Registered queries, grouped by area."""

import importlib

AREAS = ["audit_queries", "scalar_queries", "text_queries", "rating_queries", "agreement_queries", "contract_queries"]


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"tarifflume.catalog.{area}")
