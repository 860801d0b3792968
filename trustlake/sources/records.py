"""Inference records and audit logs as JSON lines, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
RECORD = T.StructType([
    T.StructField("record_id", _S), T.StructField("session_id", _S), T.StructField("producer_id", _S), T.StructField("origin", _S),
    T.StructField("input_image_hash", _S), T.StructField("model_id", _S), T.StructField("model_weight_digest", _S),
    T.StructField("preprocessing_config_hash", _S), T.StructField("inference_config", _S), T.StructField("output", _S),
    T.StructField("binding_hmac", _S), T.StructField("signing_key_id", _S), T.StructField("timestamp", T.TimestampType()),
    T.StructField("sequence_number", T.LongType()), T.StructField("nonce", _S), T.StructField("previous_record_hash", _S),
    T.StructField("signature", _S), T.StructField("schema_version", _S),
])
EVENT = T.StructType([
    T.StructField("event_id", _S), T.StructField("sequence_number", T.LongType()), T.StructField("timestamp", _S), T.StructField("event_type", _S),
    T.StructField("actor", _S), T.StructField("asset_id", _S), T.StructField("session_id", _S), T.StructField("details", _S),
    T.StructField("previous_event_hash", _S), T.StructField("event_hash", _S), T.StructField("signature", _S), T.StructField("schema_version", _S),
    T.StructField("_bad", _S),
])
_ROW_BITS = (1 << 33) - 1


def read_records(spark: SparkSession, path: str, arrival: bool = True) -> DataFrame:
    """Records with a fixed schema; unknown fields are ignored, free-form maps stay JSON text.

    ``arrival`` adds a file-order number where the producer's own order column is not at hand: files by path, then lines by place. A
    task may read splits of several files in any order, so its running number alone would not do.
    """
    read = spark.read.schema(RECORD).json(path)
    if not arrival:
        return read.fillna("1.0", ["schema_version"])
    placed = read.withColumns({
        "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id(),
    })
    splits = placed.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row per split: how many records lie in the splits before it.
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    rows = placed.join(starts, ["_file", "_block"]).withColumn("arrival", (F.col("_before") + F.col("_row") - F.col("_first")).cast("long"))
    return rows.drop("_file", "_block", "_row", "_first", "_before").fillna("1.0", ["schema_version"])


def stream_records(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same records as a stream of arriving files; ``arrival`` must come with the data or from the caller."""
    schema = T.StructType([*RECORD.fields, T.StructField("arrival", T.LongType())])
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).fillna("1.0", ["schema_version"])


def read_audit_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events in line order: ``log_id`` is the file, ``pos`` grows with the line's place in it.

    A split log stays parallel: a line's place is its split's byte offset plus its row number in the split,
    which is below the split's length and so never reaches the next offset. Blank lines are skipped; a line
    that is not an event fails the job, or is kept with ``bad`` set when ``strict`` is off.
    """
    text = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row"),
    )
    firsts = text.groupBy("log_id", "_block").agg(F.min("_row").alias("_first"))
    rows = text.where(F.trim("value") != "").join(firsts, ["log_id", "_block"])
    event = F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.select("log_id", (F.col("_block") + F.col("_row") - F.col("_first")).alias("pos"), "value", event.alias("e"))
    bad = F.col("e._bad").isNotNull() | F.col("e.event_id").isNull() | F.col("e.event_type").isNull() | F.col("e.actor").isNull()
    if strict:
        bad = F.when(bad, F.raise_error(F.concat(F.lit("malformed audit event: "), F.col("value"))).cast("boolean")).otherwise(False)
    fields = [f"e.{f.name}" for f in EVENT.fields if f.name not in ("_bad", "timestamp", "schema_version", "sequence_number")]
    return rows.select(
        "log_id", "pos", *fields, F.coalesce("e.sequence_number", F.lit(0)).alias("sequence_number"),
        F.coalesce("e.schema_version", F.lit("1.0")).alias("schema_version"), F.regexp_replace("e.timestamp", "Z$", "+00:00").alias("timestamp_text"),
        F.to_timestamp("e.timestamp").alias("timestamp"), bad.alias("bad"),
    )
