"""Session settings every job relies on, and the one place that cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


# Methods above 8000 bytes are never compiled by the JVM's JIT, so generated code that large runs interpreted;
# the small set aggregates here should not fall back to sorting after 128 groups.
TUNING = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Recommended runtime settings for these jobs; results do not depend on them."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "trustlake", **conf: str) -> SparkSession:
    """Session for tests and local benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; make a private one only where none is set (tests)."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int = 200_000) -> bool:
    """Count at most ``max_rows + 1`` rows of an aggregated side table (class statistics, key stores)."""
    return df.limit(max_rows + 1).count() <= max_rows


def sized_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` is small; otherwise leave the join to Spark."""
    return F.broadcast(df) if is_small(df, max_rows) else df
