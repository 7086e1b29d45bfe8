"""A session with the settings that the semantics here rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: ANSI off: a division by zero or a bad cast is NULL; times are UTC; skewed joins are split at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.config(map=SETTINGS | more)
    return (b.master(master) if master else b).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found
