"""Session defaults the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app_name: str = "retort", **conf: str) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC.

    The master, memory and shuffle width come from the launcher (spark-submit);
    pass them in ``conf`` only for local runs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    The launcher must set it; a folder of one machine would be missing on the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")
