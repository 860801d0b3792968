"""Evidence catalogue: search, joins with findings, counts and reconciliation with files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.functions.text import basename, extension, prefix_match


def has_payload(metrics: Column, artifacts: Column, baseline: Column, raw_ref: Column) -> Column:
    """At least one of a metric map, an artifact list, a baseline text or a raw reference carries content."""
    no = F.lit(False)
    return (
        F.coalesce(F.size(metrics) > 0, no) | F.coalesce(F.size(artifacts) > 0, no)
        | F.coalesce(~F.trim(baseline).isin("", "{}"), no) | F.coalesce(F.trim(raw_ref) != "", no)
    )


def evidence_with_threat(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Add ``threat_id`` from the finding, else from the stored JSON; of a finding told with several threats the least counts."""
    side = findings.groupBy("finding_id").agg(F.min("threat_id").alias("_threat"))
    stored = F.get_json_object("record_json", "$.reproducibility_info.threat_id")
    joined = evidence.join(side, "finding_id", "left")
    return joined.withColumn("threat_id", F.coalesce("_threat", stored)).drop("_threat")


def search_evidence(evidence: DataFrame, findings: DataFrame | None = None, **filters: str) -> DataFrame:
    """Exact-or-prefix filters on session_id, finding_id, evidence_type, content_hash, threat_id.

    Filters on stored columns apply before the join, and reach the file scan.
    """
    exact_case = {"session_id", "finding_id", "content_hash"}
    rows = evidence
    for name, wanted in filters.items():
        if wanted and name in exact_case:
            rows = rows.where(F.col(name).startswith(wanted.strip()))
        elif wanted and name == "evidence_type":
            rows = rows.where(prefix_match(F.col(name), wanted))
    if findings is not None:
        rows = evidence_with_threat(rows, findings)
    if filters.get("threat_id"):
        rows = rows.where(prefix_match(F.col("threat_id"), filters["threat_id"]))
    return rows


def evidence_by_category(evidence: DataFrame, findings: DataFrame, category: str) -> DataFrame:
    wanted = findings.where(F.col("category") == category).select("finding_id").distinct()
    return evidence.join(wanted, "finding_id", "left_semi")


def evidence_for_verdict(verdict_findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of a verdict's contributing findings; input rows are ``verdict_id, finding_id``."""
    return verdict_findings.select("verdict_id", "finding_id").distinct().join(evidence, "finding_id")


def evidence_counts(evidence: DataFrame, types: Sequence[str], by: str = "session_id") -> DataFrame:
    """Total and one column per type, types compared without case."""
    kind = F.upper("evidence_type")
    return evidence.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(kind == t.upper()).alias(t.lower()) for t in types]
    )


def reconcile(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """Both directions at once: ``path, kind, state`` with state ok, missing, tampered or orphan.

    Temporary files are ignored, and a stray file in an evidence folder counts only when it is JSON.
    """
    stored = catalogue.select("path", "kind", F.col("digest").alias("_stored"))
    found = files.where(~basename(F.col("path")).startswith(".tmp_")).select(
        "path", F.col("kind").alias("_kind"), F.col("digest").alias("_found")
    )
    joined = stored.join(found, "path", "full_outer")
    state = (
        F.when(F.col("_found").isNull(), "missing").when(F.col("_stored").isNull(), "orphan")
        .when(F.col("_stored") != F.col("_found"), "tampered").otherwise("ok")
    )
    rows = joined.select("path", F.coalesce("kind", "_kind").alias("kind"), state.alias("state"))
    return rows.where((F.col("state") != "orphan") | (F.col("kind") != "evidence") | (extension(F.col("path")) == "json"))


def consistency(reconciled: DataFrame) -> DataFrame:
    """One row per kind with the tally of every state."""
    states = ("ok", "missing", "tampered", "orphan")
    rows = reconciled.groupBy("kind").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    return rows.withColumn("is_consistent", F.col("missing") + F.col("tampered") + F.col("orphan") == 0)


def list_assets(assets: DataFrame, asset_type: str | None = None, status: str | None = None) -> DataFrame:
    """Newest first, optionally of one type or status."""
    rows = assets
    for name, wanted in (("asset_type", asset_type), ("status", status)):
        rows = rows if wanted is None else rows.where(F.col(name) == wanted)
    return rows.orderBy(F.desc("ingestion_timestamp"))


def recent_sessions(sessions: DataFrame, n: int = 50, order: str = "start_time", tie: str = "session_id") -> DataFrame:
    return sessions.orderBy(F.desc(order), tie).limit(n)


def findings_by_confidence(findings: DataFrame, session_id: str) -> DataFrame:
    return findings.where(F.col("session_id") == session_id).orderBy(F.desc("confidence"), "finding_id")


def page(df: DataFrame, order: Sequence[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in a total order; ``limit`` is the page size, from 1 to 1000."""
    if not (1 <= limit <= 1000 and offset >= 0):
        raise ValueError("limit must be 1..1000 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def first_n(df: DataFrame, by: Sequence[str], value: str, n: int, name: str = "first") -> DataFrame:
    """The n smallest values per group as an array, with the group's full count beside it."""
    lowest = W.partitionBy(*by).orderBy(value)
    kept = df.select(*by, value, F.row_number().over(lowest).alias("_rn")).where(F.col("_rn") <= n)
    lists = kept.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias(name))
    return lists.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("total")), list(by))
