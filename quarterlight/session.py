"""Session settings that the library's jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI casts, UTC, and the last of two equal map keys.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(name: str = "quarterlight", cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster spark-submit gives master, memory and the shared spark.checkpoint.dir."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    more = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def prepare(spark: SparkSession) -> SparkSession:
    """Sets what can be set on a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
