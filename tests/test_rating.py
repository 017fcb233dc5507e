"""Contracts in force, against a comparison of all pairs."""

import datetime as dt
import random

from tarifflume.operators import rating as ra


def test_contracts_in_force_at_every_span(spark):
    rng = random.Random(6)
    start = dt.date(1995, 1, 1)
    day = lambda n: start + dt.timedelta(days=n)
    contracts = [(rng.randint(1, 4), i, a := day(rng.randint(0, 9000)), rng.choice([None, a, a + dt.timedelta(days=rng.randint(-50, 60)), a + dt.timedelta(days=rng.randint(0, 6000)), a + dt.timedelta(days=20_000)])) for i in range(80)]
    rows = [(i, rng.randint(1, 5), rng.choice([None, day(rng.randint(0, 12_000))]) if i % 9 else contracts[i % 80][2]) for i in range(200)]
    got = ra.contracts_in_force(
        spark.createDataFrame(rows, "id int, account int, day date"), spark.createDataFrame(contracts, "account int, contract_id int, effective_date date, expiration_date date"), "day", months=6, years=10
    )
    assert got.columns == ["id", "account", "day", "contract_id"]
    want = sorted((i, c) for i, account, d in rows if d for own, c, a, b in contracts if own == account and a <= d and (b is None or d <= b))
    assert sorted((r["id"], r["contract_id"]) for r in got.collect()) == want and want


def test_unfolded_contracts_are_not_broadcast(spark):
    """Files of a few MB unfold to more than a driver holds, which Spark's estimate doesn't see."""
    contracts = spark.range(50).selectExpr("cast(id % 5 as int) account", "id contract_id", "date'2025-01-01' effective_date", "date'2026-06-01' expiration_date")
    rows = spark.range(100).selectExpr("id", "cast(id % 5 as int) account", "date'2025-03-01' day")
    got = ra.contracts_in_force(rows, contracts, "day")
    assert got.count() == 1000
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
