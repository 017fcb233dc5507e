"""AI-versus-human evaluation of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarifflume.functions import values as v
from tarifflume.schemas import MONEY


def read_study_csv(spark: SparkSession, path: str) -> DataFrame:
    return study_records(spark.read.csv(path, header=True))


def study_records(raw: DataFrame) -> DataFrame:
    """Typed study rows of text columns, with the outcome."""
    return with_outcome(
        raw.select(
            F.coalesce("shipment_id", F.lit("")).alias("shipment_id"),
            F.coalesce("tracking_number", F.lit("")).alias("tracking_number"),
            v.truthy(F.col("ai_found_discrepancy")).alias("ai_found"),
            F.nullif("ai_discrepancy_type", F.lit("")).alias("ai_type"),
            v.to_number(F.col("ai_dollar_impact")).alias("ai_dollars"),
            v.truthy(F.col("human_found_discrepancy")).alias("human_found"),
            F.nullif("human_discrepancy_type", F.lit("")).alias("human_type"),
            v.to_number(F.col("human_dollar_impact")).alias("human_dollars"),
        )
    )


def outcome(ai: Column, human: Column) -> Column:
    return F.when(ai & human, "TP").when(ai, "FP").when(human, "FN").otherwise("TN")


def with_outcome(records: DataFrame) -> DataFrame:
    return records.withColumn("outcome", outcome(F.col("ai_found"), F.col("human_found")))


def compare(human: DataFrame, findings: DataFrame, order: str) -> DataFrame:
    """Human rows with the first AI finding of their tracking number.

    The first finding is a map-side aggregate, so the join side has one row per tracking
    number however many findings one number carries.
    """
    key = F.trim(F.coalesce(v.blank_to_null(F.col("tracking_number")), F.col("transaction_id")))
    first = (
        findings.withColumn("track", key).where("track <> ''")
        .groupBy("track")
        .agg(F.min_by(F.struct("discrepancy_type", "dollar_impact"), order).alias("ai"))
    )
    rows = human.withColumn("track", F.trim(F.coalesce("tracking_number", F.lit(""))))
    joined = rows.join(first, "track", "left")
    found = F.col("ai").isNotNull()
    return with_outcome(
        joined.select(
            F.coalesce(v.blank_to_null(F.col("shipment_id")), F.col("track")).alias("shipment_id"),
            F.col("track").alias("tracking_number"),
            found.alias("ai_found"),
            F.col("ai.discrepancy_type").alias("ai_type"),
            F.when(found, F.coalesce("ai.dollar_impact", F.lit(0))).cast(MONEY).alias("ai_dollars"),
            v.truthy(F.col("discrepancy_found"), accept_t=False).alias("human_found"),
            F.nullif("discrepancy_type", F.lit("")).alias("human_type"),
            v.to_number(F.col("dollar_amount")).alias("human_dollars"),
        )
    )


def metrics(records: DataFrame) -> DataFrame:
    """Precision, recall, F1 (0 where undefined), dollars and the two study targets."""
    counted = records.agg(
        *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "FN", "TN")],
        F.count(F.lit(1)).alias("total_records"),
        *[
            F.coalesce(F.sum(F.when(cond, F.coalesce(col, F.lit(0)))), F.lit(0)).cast("double").alias(name)
            for name, cond, col in (
                ("ai_recovery", F.col("ai_found"), F.col("ai_dollars")),
                ("human_recovery", F.col("human_found"), F.col("human_dollars")),
                ("ai_only_recovery", F.col("outcome") == "FP", F.col("ai_dollars")),
            )
        ],
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = counted.withColumn("p", precision).withColumn("r", recall)
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return scored.select(
        "tp", "fp", "fn", "tn",
        F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"),
        "total_records", "ai_recovery", "human_recovery", "ai_only_recovery",
        (F.col("r") >= 0.9).alias("recall_target_met"),
        (F.col("ai_only_recovery") > 0).alias("additional_finds_target_met"),
    )


def misses(records: DataFrame, kind: str) -> DataFrame:
    """Rows of one outcome: FP (to verify) or FN (gaps)."""
    return records.where(F.col("outcome") == kind)


def write_gaps(records: DataFrame, path: str) -> None:
    """False negatives as CSV part files with a header."""
    misses(records, "FN").write.mode("overwrite").csv(path, header=True)
