"""Hash-chain verification of event logs, many logs at once and one huge log alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.constants import GENESIS
from trustlake.functions.hashing import add_event_payload
from trustlake.operators.scan import WIDTH, with_previous, with_rank


def row_hashes(log: DataFrame, timestamp_text: str = "timestamp_text") -> DataFrame:
    """Add ``computed_hash`` of each event's canonical text."""
    return add_event_payload(log, "_payload", timestamp_text).withColumn("computed_hash", F.sha2("_payload", 256)).drop("_payload")


def chain_checks(log: DataFrame, keys: Sequence[str] = ("log_id",), order: str = "pos", genesis: str = GENESIS, width: int = WIDTH) -> DataFrame:
    """Add ``link_ok, content_ok, sequence_ok, time_ok`` per event. Needs ``computed_hash``."""
    rows = with_previous(log, keys, order, ["event_hash", "sequence_number", "timestamp"], width)
    yes = F.lit(True)
    return rows.select(
        *log.columns,
        (F.lower("previous_event_hash") == F.lower(F.coalesce("prev_event_hash", F.lit(genesis)))).alias("link_ok"),
        (F.lower("event_hash") == F.lower("computed_hash")).alias("content_ok"),
        F.coalesce(F.col("sequence_number") > F.col("prev_sequence_number"), yes).alias("sequence_ok"),
        F.coalesce(F.col("timestamp") >= F.col("prev_timestamp"), yes).alias("time_ok"),
    )


def failure_reason() -> Column:
    """First failing check of an event in the fixed order link, content, sequence, time."""
    expr = None
    for name in ("link", "content", "sequence", "time"):
        failed = ~F.coalesce(F.col(f"{name}_ok"), F.lit(False))
        expr = F.when(failed, name) if expr is None else expr.when(failed, name)
    return expr


def first_failure(checked: DataFrame, keys: Sequence[str] = ("log_id",), order: str = "pos") -> DataFrame:
    """One row per log: validity, events before the first failure, and what failed there."""
    reason = failure_reason()
    failed_at = F.min(F.when(F.col("_reason").isNotNull(), F.col(order)))
    return checked.withColumn("_reason", reason).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_events"), failed_at.alias("failed_index"),
        F.min_by(F.col("_reason"), F.when(F.col("_reason").isNotNull(), F.col(order))).alias("reason"),
    ).select(
        *keys, F.col("failed_index").isNull().alias("is_valid"), "total_events",
        F.coalesce("failed_index", "total_events").alias("verified_events"), "failed_index", "reason",
    )


def verify_chain(
    log: DataFrame, keys: Sequence[str] = ("log_id",), order: str = "pos", genesis: str = GENESIS,
    dense: bool = True, width: int = WIDTH,
) -> DataFrame:
    """Verify every log. ``dense`` says positions already count 0, 1, 2, ... within each log."""
    if not dense:
        log = with_rank(log, keys, order, "_at", width).drop(order).withColumnRenamed("_at", order)
    return first_failure(chain_checks(log, keys, order, genesis, width), keys, order)


def verify_archives(files: DataFrame, events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sealed archives against their manifest: ``files(path, sha256)``, ``events(path, hash_ok)``,
    ``manifest(path, expected_sha256, expected_events)``. First problem wins."""
    counts = events.groupBy("path").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(~F.coalesce("hash_ok", F.lit(False))).alias("_bad")
    )
    joined = files.join(manifest, "path", "full_outer").join(counts, "path", "left").fillna(0, ["total_events", "_bad"])
    expected = F.coalesce("expected_events", F.lit(0))
    error = (
        F.when(F.col("expected_sha256").isNull(), "manifest_missing")
        .when(F.col("sha256").isNull(), "archive_missing")
        .when(F.lower("sha256") != F.lower("expected_sha256"), "hash_mismatch")
        .when(F.col("_bad") > 0, "event_corrupted")
        .when((expected != 0) & (expected != F.col("total_events")), "event_count_mismatch")
    )
    return joined.select("path", error.isNull().alias("is_valid"), "total_events", error.alias("error"))
