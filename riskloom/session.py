"""Session settings that suit wide rows of many expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

# the JVM does not compile methods above 8000 bytes of code to machine code; beyond that size
# Spark had better split a projection than fuse it into one method that stays interpreted
RUNTIME_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; sizes and partition counts stay its own."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark
