"""Lineage status of a session across seven stages, and partial session updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Threat prefix and category of each stage's findings.
STAGE_RULES = {
    "dataset": ("DT-", "DATA_INTEGRITY"), "model": ("MT-", "MODEL_INTEGRITY"),
    "inference": ("IT-", "INFERENCE_PROVENANCE"), "distribution": ("DS-", "DISTRIBUTION_SHIFT"),
}
# Names that select a section's analyses and findings when a session is updated in part.
SECTION_NAMES = {
    "dataset": ("DATASET", "DATA_INTEGRITY"), "model": ("MODEL", "MODEL_INTEGRITY"),
    "inference": ("INFERENCE", "INFERENCE_PROVENANCE"), "distribution": ("DISTRIBUTION", "DISTRIBUTION_SHIFT"),
}
# Dependency edges between stages.
DEPENDENCIES = (
    ("DATASET", "MODEL", "TRAINED_WITH / EVALUATED_AGAINST"), ("MODEL", "INFERENCE", "WEIGHT_DIGEST_BINDING"),
    ("INFERENCE", "DISTRIBUTION", "OPERATIONAL_STREAM_SAMPLE"), ("DISTRIBUTION", "EVIDENCE", "EVIDENCE_PERSISTENCE"),
    ("EVIDENCE", "AUDIT", "TAMPER_EVIDENT_AUDIT_LOG"), ("AUDIT", "ASSURANCE", "HOLISTIC_ASSURANCE_EVALUATION"),
)
FAILED = "FAILED / TAMPERED"


def merge_findings(stored: DataFrame, session: DataFrame) -> DataFrame:
    """Stored findings, plus session findings whose id is not stored."""
    return stored.unionByName(session.join(stored.select("finding_id"), "finding_id", "left_anti"))


def latest_provenance(provenance: DataFrame, order: str = "created_at") -> DataFrame:
    """Newest record per session; one row per session and task survives the map side."""
    newest = W.partitionBy("session_id").orderBy(F.desc(order), F.desc("record_id"))
    return provenance.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def model_binding(sessions: DataFrame, provenance: DataFrame) -> DataFrame:
    """Add ``model_mismatch``: the session's model digest differs from the digest its record binds."""
    side = provenance.select("session_id", F.col("model_weight_digest").alias("bound_digest"))
    clean = lambda c: F.lower(F.trim(F.col(c)))
    joined = sessions.join(side, "session_id", "left")
    usable = (F.coalesce(F.col("model_digest"), F.lit("")) != "") & (F.coalesce(F.col("bound_digest"), F.lit("")) != "")
    return joined.withColumn("model_mismatch", F.coalesce(usable & (clean("model_digest") != clean("bound_digest")), F.lit(False)))


def _finding_facts(findings: DataFrame) -> DataFrame:
    threat, severity = F.col("threat_id"), F.col("severity")
    columns = [F.count(F.lit(1)).alias("findings")]
    for stage, (prefix, category) in STAGE_RULES.items():
        mine = F.coalesce(threat.startswith(prefix), F.lit(False)) | F.coalesce(F.col("category") == category, F.lit(False))
        columns += [
            F.count_if(mine).alias(f"{stage}_n"),
            F.bool_or(mine & severity.isin("CRITICAL", "HIGH")).alias(f"{stage}_high"),
            F.bool_or(mine & severity.isin("MEDIUM", "LOW")).alias(f"{stage}_low"),
        ]
    columns += [F.bool_or(threat == t).alias(n) for t, n in (("IT-1", "it1"), ("DS-4", "ds4"))]
    return findings.groupBy("session_id").agg(*columns)


def _analysis_facts(analyses: DataFrame) -> DataFrame:
    """Input: long ``session_id, analysis_id, state`` with state executed or skipped."""
    a, executed = F.col("analysis_id"), F.col("state") == "executed"
    return analyses.groupBy("session_id").agg(
        F.bool_or(executed & (a.startswith("DT-") | (a == "DATASET"))).alias("dataset_ran"),
        F.bool_or(executed & (a == "MODEL")).alias("model_named"),
        F.count_if(executed & a.startswith("MT-")).alias("model_supported"),
        F.count_if(~executed & a.contains("MT-")).alias("model_unsupported"),
        F.bool_or(executed & (a == "INFERENCE_PROVENANCE")).alias("inference_ran"),
        F.bool_or(executed & (a.startswith("DS-") | (a == "DISTRIBUTION_SHIFT"))).alias("distribution_ran"),
    )


def _graded(ran: Column, high: Column, low: Column) -> Column:
    return F.when(~ran, "NOT RUN").when(high, FAILED).when(low, "FINDINGS")


def lineage(
    sessions: DataFrame, findings: DataFrame, analyses: DataFrame, provenance: DataFrame,
    evidence_totals: DataFrame, chains: DataFrame, verdicts: DataFrame,
) -> DataFrame:
    """Stage statuses and overall status of every session.

    ``sessions(session_id, model_digest)``; ``provenance(session_id, record_id, model_weight_digest, status,
    is_valid, created_at)``; ``evidence_totals(session_id, total)``; ``chains(session_id, is_valid)``;
    ``verdicts(session_id, disposition, open_checks)``.
    """
    newest = latest_provenance(provenance).select(
        "session_id", "model_weight_digest", F.col("status").alias("record_status"), "is_valid"
    )
    rows = model_binding(sessions.select("session_id", "model_digest"), newest).join(
        newest.drop("model_weight_digest"), "session_id", "left"
    )
    parts = [
        _finding_facts(findings), _analysis_facts(analyses), evidence_totals.select("session_id", F.col("total").alias("evidence_total")),
        chains.select("session_id", F.col("is_valid").alias("chain_intact")), verdicts.select("session_id", "disposition", "open_checks"),
    ]
    rows = reduce(lambda a, b: a.join(b, "session_id", "left"), parts, rows)
    flags = [f for f in rows.columns if f.endswith(("_high", "_low", "_ran")) or f in ("it1", "ds4", "model_named")]
    counts = [f for f in rows.columns if f.endswith("_n") or f in ("findings", "model_supported", "model_unsupported", "evidence_total", "open_checks")]
    rows = rows.fillna(False, flags).fillna(0, counts).fillna(True, ["chain_intact"])
    c = F.col

    dataset = _graded(c("dataset_ran") | (c("dataset_n") > 0), c("dataset_high"), c("dataset_low")).otherwise("VERIFIED")
    model_ran = c("model_named") | (c("model_supported") + c("model_unsupported") + c("model_n") > 0)
    model = (
        _graded(model_ran, c("model_high"), c("model_low"))
        .when((c("model_unsupported") > 0) & (c("model_supported") == 0), "UNSUPPORTED")
        .when(c("model_unsupported") > 0, "REVIEW").otherwise("VERIFIED")
    )
    recorded = c("record_status").isNotNull()
    inference_ran = recorded | (c("inference_n") > 0) | c("inference_ran")
    state = F.coalesce("record_status", F.when(c("it1"), "TAMPERED_OUTPUT").otherwise("VERIFIED"))
    valid = F.when(recorded, c("is_valid")).otherwise(c("inference_n") == 0)
    rows = rows.withColumn("tampered", inference_ran & (c("it1") | state.isin("TAMPERED_OUTPUT", "SIGNATURE_INVALID")))
    rows = rows.withColumn("replayed", inference_ran & (state == "REPLAYED_RECORD")).withColumn("model_mismatch", c("model_mismatch") & inference_ran & model_ran)
    broken = c("tampered") | c("replayed") | c("model_mismatch") | (state == "SUBSTITUTED_MODEL") | c("inference_high")
    inference = _graded(inference_ran, broken, c("inference_low")).when(~valid, FAILED).otherwise("VERIFIED")
    distribution = (
        F.when(~(c("distribution_ran") | (c("distribution_n") > 0)), "NOT RUN").when(c("ds4") | c("distribution_high"), FAILED)
        .when(c("distribution_low"), "REVIEW").otherwise("VERIFIED")
    )
    assurance = (
        F.when(c("disposition").isNull(), "NOT RUN").when(c("disposition") == "QUARANTINE", FAILED)
        .when(c("disposition") == "REVIEW", "REVIEW").otherwise("VERIFIED")
    )
    rows = rows.select(
        "session_id", dataset.alias("dataset"), model.alias("model"), inference.alias("inference"), distribution.alias("distribution"),
        F.when(c("evidence_total") > 0, "VERIFIED").otherwise("NOT RUN").alias("evidence"),
        F.when(c("chain_intact"), "VERIFIED").otherwise(FAILED).alias("audit"), assurance.alias("assurance"),
        "findings", "tampered", "replayed", "model_mismatch", "chain_intact", "disposition", "open_checks", "model_unsupported",
    )
    return rows.withColumn("overall", overall_status())


def overall_status() -> Column:
    c = F.col
    stages = [c(s) for s in ("dataset", "model", "inference", "distribution", "audit", "assurance")]
    some = lambda value: reduce(lambda a, b: a | b, [s == value for s in stages])
    no = F.lit(False)
    settled = [c(s).isin("VERIFIED", "NOT RUN") for s in ("dataset", "model", "inference")]
    return (
        F.when(some(FAILED) | c("tampered") | c("model_mismatch") | ~c("chain_intact"), "FAILED / QUARANTINE")
        .when((c("dataset") == "NOT RUN") & (c("model") == "NOT RUN") & (c("inference") == "NOT RUN"), "INCOMPLETE / NOT VERIFIED")
        .when((c("findings") > 0) | some("FINDINGS") | F.coalesce(c("disposition") == "REVIEW", no), "FINDINGS / REVIEW")
        .when((c("model_unsupported") > 0) | c("model").isin("UNSUPPORTED", "REVIEW") | (c("open_checks") > 0), "LIMITED COVERAGE")
        .when(reduce(lambda a, b: a & b, settled) & c("assurance").isin("VERIFIED", "NOT RUN"), "VERIFIED")
        .otherwise("INCOMPLETE / NOT VERIFIED")
    )


def lineage_dependencies(lineages: DataFrame) -> DataFrame:
    """The six stage-to-stage edges of every session with their validity."""
    c = F.col
    valid = {
        "DATASET": (c("dataset") == "VERIFIED") & (c("model") != FAILED),
        "MODEL": ~c("model_mismatch") & (c("inference") != FAILED),
        "INFERENCE": (c("inference") != FAILED) & (c("distribution") != FAILED),
        "DISTRIBUTION": c("evidence") == "VERIFIED", "EVIDENCE": c("chain_intact"), "AUDIT": c("assurance") != FAILED,
    }
    edges = [
        F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(r).alias("relationship"), valid[s].alias("is_valid"))
        for s, t, r in DEPENDENCIES
    ]
    return lineages.select("session_id", F.inline(F.array(*edges)))


def in_section(threat_or_analysis: Column, category: Column | None, section: str) -> Column:
    prefix, names = STAGE_RULES[section][0], SECTION_NAMES[section]
    text = F.upper(F.coalesce(threat_or_analysis, F.lit("")))
    hit = text.startswith(prefix)
    other = F.upper(F.coalesce(category, F.lit(""))) if category is not None else text
    return hit | other.isin(*names)


def merge_section(old: DataFrame, new: DataFrame, section: str, kind: str = "findings") -> DataFrame:
    """Replace one section of updated sessions and keep everything else.

    ``kind`` is findings (threat_id, category) or analyses (analysis_id). Only sessions present in ``new`` change.
    """
    name = "threat_id" if kind == "findings" else "analysis_id"
    category = F.col("category") if kind == "findings" else None
    touched = new.select("session_id", F.lit(True).alias("_touched")).distinct()
    kept = old.join(touched, "session_id", "left").where(
        F.col("_touched").isNull() | ~in_section(F.col(name), category, section)
    ).drop("_touched")
    merged = kept.unionByName(new)
    return merged if kind == "findings" else merged.dropDuplicates(["session_id", "analysis_id", "state"])


def merge_durations(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Add the updates' run time to each session."""
    rows = sessions.select("session_id", "duration_ms").unionByName(updates.select("session_id", "duration_ms"))
    return rows.groupBy("session_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("duration_ms"))


def merge_analyses(old: Column, new: Column) -> Column:
    """Ordered union of two analysis lists."""
    return F.array_distinct(F.concat(old, new))
