"""Session settings."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

# Settings a job wants on any cluster; sizes are left to the cluster.
JOB_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even if what follows needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine find the library where the driver has it.

    On a cluster the library is shipped with the job, as for any Spark program.
    """
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p and p != root]
    environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def job_session(app_name: str) -> SparkSession:
    """Session of a submitted job; master and sizes come from the cluster."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(app_name: str, cpus: int | None = None) -> SparkSession:
    """Session of tests and benchmarks on this machine."""
    cpus = cpus or os.cpu_count() or 8
    builder = SparkSession.builder.appName(app_name).master(f"local[{cpus}]")
    settings = {
        **JOB_SETTINGS,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
