"""Helpers shared by the training-data operators: reading, staging and word rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.session import ensure_checkpoint_dir

#: White space is these ASCII characters only, so that words mean the same in Java, Python and DuckDB.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    This cuts lineage with files that outlive executors, column by column (unlike a row checkpoint, a later read
    takes only the columns it needs). The files go when the session ends.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches of whole texts small: rows are counted, not bytes, and some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for the jobs started inside; the session's own figure is put back."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def seeded(seed: int, *columns: Column) -> Column:
    """Uniform draw in [0, 1) fixed by the seed and the columns."""
    mixed = F.xxhash64(F.lit(seed), *columns)
    return F.shiftrightunsigned(mixed, 11).cast("double") / F.lit(float(1 << 53))
