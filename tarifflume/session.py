"""Session helpers: local sessions for tests and benches, and staging in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tarifflume", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benches; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local temporary folder stands in for it in local mode only, where driver and
    executors are one process; a cluster without the setting gives None.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") if context.master.startswith("local") else None


def written_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what a query writes and reads again."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back, for plans that use it several times.

    The copy lies in the shared folder, so it survives lost executors. Without a shared
    folder the plan is returned as it is: right as well, only evaluated per use.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by `keys` over all shuffle partitions.

    Page texts compress more than tenfold and Spark merges partitions by their compressed size, so
    left to it a task would hold a large share of all texts; a given number is not merged.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
