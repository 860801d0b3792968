"""From findings to one verdict per session: Noisy-OR per dimension, composite risk, disposition."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.constants import (
    DIMENSION_WEIGHTS, DIMENSIONS, NARRATIVE, QUARANTINE_THRESHOLD, REVIEW_THRESHOLD, SEVERITY_WEIGHTS, VETO_CONFIDENCE,
)
from trustlake.functions.numeric import clamp, fixed
from trustlake.functions.risk import (
    critical_veto, disposition, finding_dimension, finding_problems, finding_risk,
)


@dataclass(frozen=True)
class AssurancePolicy:
    severity_weights: Mapping[str, float] = field(default_factory=lambda: dict(SEVERITY_WEIGHTS))
    dimension_weights: Mapping[str, float] = field(default_factory=lambda: dict(DIMENSION_WEIGHTS))
    quarantine: float = QUARANTINE_THRESHOLD
    review: float = REVIEW_THRESHOLD
    min_veto_confidence: float = VETO_CONFIDENCE
    veto_enabled: bool = True

    def normalised(self) -> dict[str, float]:
        total = sum(self.dimension_weights.values())
        weights = self.dimension_weights if total > 0 else DIMENSION_WEIGHTS
        return {d: weights.get(d, 0.0) / sum(weights.values()) for d in DIMENSIONS}


DEFAULT_POLICY = AssurancePolicy()


def validate_findings(findings: DataFrame, require_uuid: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split into usable findings and rejects (with a ``problems`` array)."""
    c = F.col
    tagged = findings.withColumn(
        "problems",
        finding_problems(
            c("finding_id"), c("category"), c("threat_id"), c("severity"), c("confidence"),
            c("recommended_disposition"), require_uuid,
        ),
    )
    return tagged.where(F.size("problems") == 0).drop("problems"), tagged.where(F.size("problems") > 0)


def dedup_findings(findings: DataFrame, order: str = "ord") -> DataFrame:
    """First row per finding id. Spark prunes to one row per id on the map side before shuffling."""
    first = W.partitionBy("finding_id").orderBy(order)
    return findings.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def score_findings(findings: DataFrame, policy: AssurancePolicy = DEFAULT_POLICY) -> DataFrame:
    """Add dimension, risk, veto, review_asked and contributes."""
    c = F.col
    veto = critical_veto(c("severity"), c("confidence"), c("recommended_disposition"), policy.min_veto_confidence)
    return (
        findings.withColumn("dimension", finding_dimension(c("category"), c("threat_id")))
        .withColumn("risk", finding_risk(c("severity"), c("confidence"), policy.severity_weights))
        .withColumn("veto", veto & F.lit(policy.veto_enabled))
        .withColumn("review_asked", c("recommended_disposition") == "REVIEW")
        .withColumn("contributes", (c("risk") > 0) | c("recommended_disposition").isin("REVIEW", "QUARANTINE"))
    )


def _noisy_or(risk: Column) -> Column:
    return fixed(clamp(F.lit(1.0) - F.coalesce(F.product(F.lit(1.0) - risk), F.lit(1.0))), 4)


def noisy_or(scored: DataFrame, by: str = "session_id") -> DataFrame:
    """Long form: one score per (group, dimension) that has findings."""
    return scored.groupBy(by, "dimension").agg(_noisy_or(F.col("risk")).alias("score"))


def session_scores(scored: DataFrame, policy: AssurancePolicy = DEFAULT_POLICY, by: str = "session_id") -> DataFrame:
    """All four dimension scores, maxima and flags of a session in one partial-aggregated shuffle."""
    per_dimension = [
        _noisy_or(F.when(F.col("dimension") == d, F.col("risk"))).alias(d) for d in DIMENSIONS
    ]
    return scored.groupBy(by).agg(
        F.min("asset_id").alias("asset_id"),
        F.count(F.lit(1)).alias("findings"),
        *per_dimension,
        F.max("risk").alias("max_risk"),
        F.bool_or("veto").alias("veto"),
        F.bool_or("review_asked").alias("review_asked"),
        F.count_if(F.col("veto")).alias("veto_findings"),
        F.count_if(F.col("contributes")).alias("contributing"),
    )


def composite_risk(policy: AssurancePolicy = DEFAULT_POLICY) -> Column:
    """Largest single risk or weighted dimension sum, lifted to the quarantine line by a veto."""
    weighted = F.lit(0.0)
    for dimension, weight in policy.normalised().items():
        weighted = weighted + F.lit(weight) * F.coalesce(F.col(dimension), F.lit(0.0))
    risk = F.greatest(F.coalesce(F.col("max_risk"), F.lit(0.0)), weighted)
    risk = F.when(F.col("veto"), F.greatest(risk, F.lit(policy.quarantine))).otherwise(risk)
    return fixed(clamp(risk), 4)


def open_checks(coverage: DataFrame, findings: DataFrame) -> DataFrame:
    """(session_id, analysis_id) still open: unsupported or skipped, minus executed, minus checks with findings."""
    state = F.col("state")
    marks = coverage.select(
        "session_id", F.trim("analysis_id").alias("analysis_id"),
        state.isin("unsupported", "skipped").alias("open"), (state == "executed").alias("covered"),
    ).unionByName(
        findings.select(
            "session_id", F.trim("threat_id").alias("analysis_id"),
            F.lit(False).alias("open"), F.lit(True).alias("covered"),
        )
    )
    return (
        marks.where(F.col("analysis_id").isNotNull() & (F.col("analysis_id") != ""))
        .groupBy("session_id", "analysis_id")
        .agg(F.bool_or("open").alias("open"), F.bool_or("covered").alias("covered"))
        .where("open AND NOT covered")
        .select("session_id", "analysis_id")
    )


def contributing_findings(scored: DataFrame) -> DataFrame:
    """Long form of a verdict's contributing ids; a session may own any number of them."""
    return scored.where("contributes").select("session_id", "finding_id", "threat_id", "risk", "veto")


def _marks(scored: DataFrame, coverage: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """Findings, coverage rows and bare sessions in one layout, so that each input is read once."""
    state = F.col("state")
    rows = scored.select(
        "session_id", "asset_id", F.trim("threat_id").alias("analysis_id"), "dimension", "risk", "veto", "review_asked",
        "contributes", F.lit(1).alias("finding"), F.lit(False).alias("open"), F.lit(True).alias("covered"),
    ).unionByName(
        coverage.select(
            "session_id", F.trim("analysis_id").alias("analysis_id"), F.lit(0).alias("finding"),
            state.isin("unsupported", "skipped").alias("open"), (state == "executed").alias("covered"),
        ),
        allowMissingColumns=True,
    )
    if sessions is not None:
        assets = F.col("asset_id") if "asset_id" in sessions.columns else F.lit(None).cast("string")
        rows = rows.unionByName(
            sessions.select("session_id", assets.alias("asset_id"), F.lit(0).alias("finding")), allowMissingColumns=True
        )
    return rows


def verdicts(
    findings: DataFrame, coverage: DataFrame, sessions: DataFrame | None = None,
    policy: AssurancePolicy = DEFAULT_POLICY, order: str = "ord",
) -> DataFrame:
    """One verdict per session named by a finding, a coverage row or the optional ``sessions`` table.

    One aggregation over one union: each input is scanned once, and a session owning a third of the findings is
    reduced on the map side. The two sets kept per session hold check identifiers, so the check catalogue bounds
    them; finding ids have no bound and stay in the long table of :func:`contributing_findings`.
    """
    scored = score_findings(dedup_findings(findings, order), policy)
    left = lambda d: F.product(F.when(F.col("dimension") == d, F.lit(1.0) - F.col("risk")))
    no = F.lit(False)
    per_session = _marks(scored, coverage, sessions).groupBy("session_id").agg(
        F.min("asset_id").alias("asset_id"), F.sum("finding").alias("findings"),
        *[fixed(clamp(F.lit(1.0) - F.coalesce(left(d), F.lit(1.0))), 4).alias(d) for d in DIMENSIONS],
        F.max("risk").alias("max_risk"), F.coalesce(F.bool_or("veto"), no).alias("veto"),
        F.coalesce(F.bool_or("review_asked"), no).alias("review_asked"),
        F.count_if(F.col("veto")).alias("veto_findings"), F.count_if(F.col("contributes")).alias("contributing"),
        F.collect_set(F.when(F.col("open") & (F.col("analysis_id") != ""), F.col("analysis_id"))).alias("_open"),
        F.collect_set(F.when(F.col("covered"), F.col("analysis_id"))).alias("_covered"),
    ).withColumn("unsupported_checks", F.sort_array(F.array_except("_open", "_covered")))
    return per_session.withColumn("composite_risk", composite_risk(policy)).select(
        "session_id", "asset_id", "composite_risk",
        disposition(
            F.col("composite_risk"), F.col("veto"), F.col("review_asked"), F.size("unsupported_checks"),
            policy.quarantine, policy.review,
        ).alias("disposition"),
        *DIMENSIONS, "findings", "veto", "veto_findings", "contributing", "unsupported_checks",
    )


def _listed(rows: DataFrame, text: Column, order: str) -> DataFrame:
    return rows.groupBy("session_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("_t")))), lambda r: r["_t"]), ", ")
        .alias("listed")
    )


def narrative(verdict_rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Deterministic explanation per session.

    Veto findings are told by distinct description, with the count of those that occur more than once: check, severity and
    confidence in two digits bound the text however many findings a session has. :func:`contributing_findings` has them all.
    """
    c = F.col
    label = F.format_string(NARRATIVE["veto_item"], c("threat_id"), c("severity"), c("confidence"))
    vetoes = scored.where("veto").groupBy("session_id", label.alias("label")).count()
    times = F.when(c("count") > 1, c("count").cast("string"))
    veto_text = _listed(vetoes, F.concat_ws(" x ", "label", times), "label").withColumnRenamed("listed", "veto_text")
    threats = scored.where("contributes").groupBy("session_id", "threat_id").count()
    threat_text = _listed(threats, F.format_string(NARRATIVE["threat_item"], c("threat_id"), c("count")), "threat_id")
    threat_text = threat_text.withColumnRenamed("listed", "threat_text")
    profile = F.concat_ws(", ", *[F.format_string(f"{d}=%.4f", c(d)) for d in DIMENSIONS])
    open_text = F.concat(
        F.lit("["), F.array_join(F.transform("unsupported_checks", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
        F.lit("]"),
    )
    parts = [
        F.format_string(NARRATIVE["headline"], c("disposition"), c("composite_risk")),
        F.when(
            c("veto_findings") > 0,
            F.format_string(
                NARRATIVE["veto"],
                c("veto_findings"), c("veto_text"),
            ),
        ),
        F.format_string(NARRATIVE["profile"], profile),
        F.when(
            c("contributing") > 0,
            F.format_string(NARRATIVE["contributing"], c("contributing"), c("threat_text")),
        ).otherwise(F.lit(NARRATIVE["none"])),
        F.when(
            F.size("unsupported_checks") > 0,
            F.format_string(
                NARRATIVE["incomplete"],
                F.size("unsupported_checks"), open_text,
            ),
        ).otherwise(F.lit(NARRATIVE["complete"])),
    ]
    joined = verdict_rows.join(veto_text, "session_id", "left").join(threat_text, "session_id", "left")
    return joined.select("session_id", F.concat_ws(" ", *parts).alias("summary"))
