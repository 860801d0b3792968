"""Appending audit events to hash chains from a stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.constants import GENESIS
from trustlake.functions.hashing import EVENT_FIELDS
from trustlake.functions.text import utc_text

LOG_SCHEMA = (
    "log_id string, event_id string, sequence_number long, timestamp_text string, event_type string, actor string, asset_id string, "
    "session_id string, details string, previous_event_hash string, event_hash string, schema_version string, batch_id long"
)


def _text(event: dict) -> str:
    body = {name: event[name] for name in EVENT_FIELDS if name not in ("timestamp", "details")}
    body |= {"timestamp": event["timestamp_text"], "details": json.loads(event["details"] or "{}"), "sequence_number": int(event["sequence_number"])}
    return json.dumps(body, sort_keys=True, separators=(",", ":"))


def _fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Chain one log's new events after its tip; hashing is serial within a log by its nature."""
    rows = [{k: None if pd.isna(v) else v for k, v in r.items()} for r in pdf.sort_values("ord", kind="stable").to_dict("records")]
    tip = rows[0]["tip_sequence"]
    previous, number = rows[0]["tip_hash"] or GENESIS, -1 if tip is None else int(tip)
    for row in rows:
        number += 1
        row["sequence_number"], row["previous_event_hash"], row["schema_version"] = number, previous, "1.0"
        row["event_hash"] = previous = hashlib.sha256(_text(row).encode()).hexdigest()
    return pd.DataFrame(rows)[[c.split()[0] for c in LOG_SCHEMA.split(", ")]]


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    except AnalysisException as error:  # any other fault must not start a second chain
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def append_batch(events: DataFrame, path: str, batch_id: int) -> None:
    """Append one micro-batch ``log_id, ord, event_id, timestamp, event_type, actor, asset_id, session_id, details``.

    A batch that is delivered again is recognised by its number and written once.
    """
    spark = events.sparkSession
    log = _log(spark, path)
    if not log.where(F.col("batch_id") == batch_id).isEmpty():
        return
    touched = events.select("log_id").distinct()
    tips = log.join(touched, "log_id", "left_semi").groupBy("log_id").agg(
        F.max_by("event_hash", "sequence_number").alias("tip_hash"), F.max("sequence_number").alias("tip_sequence")
    )
    stamp = utc_text(F.col("timestamp"), "+00:00")
    rows = events.select(
        "log_id", "ord", "event_id", stamp.alias("timestamp_text"), "event_type", "actor", "asset_id", "session_id", "details"
    ).join(tips, "log_id", "left").withColumn("batch_id", F.lit(batch_id).cast("long"))
    rows.groupBy("log_id").applyInPandas(_fold, LOG_SCHEMA).write.mode("append").parquet(path)


def append_audit(path: str) -> Callable[[DataFrame, int], None]:
    """Function for ``writeStream.foreachBatch``."""
    return lambda batch, batch_id: append_batch(batch, path, batch_id)
