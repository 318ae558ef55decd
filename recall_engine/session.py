"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A generated method above 8,000 bytes of code is never compiled by the JVM. With this limit Spark splits the code of wide rows instead.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")
SETTINGS = {
    METHOD_LIMIT[0]: METHOD_LIMIT[1],
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits the hot side of a shuffled join at run time, also where that costs an extra shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Tries of one session are merged before they are shuffled, also for a learner with most of them.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "recall_engine") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
