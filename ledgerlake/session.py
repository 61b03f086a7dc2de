"""The session settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str, settings: dict[str, str] | None = None, master: str = "local[8]", memory: str = "8g") -> SparkSession:
    """A local session; on a cluster, spark-submit sets master and memory, and the defaults give way."""
    builder = SparkSession.builder.appName(name).master(master).config("spark.driver.memory", memory)
    for k, v in (SETTINGS | (settings or {})).items():
        builder = builder.config(k, v)
    out = builder.getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
