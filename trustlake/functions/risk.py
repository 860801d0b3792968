"""Finding-level risk rules and the bands that turn scores into decisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake.constants import (
    DIMENSION_CATEGORIES, DIMENSION_PREFIXES, DISPOSITIONS, QUARANTINE_THRESHOLD,
    REVIEW_THRESHOLD, SEVERITIES, SEVERITY_WEIGHTS, VETO_CONFIDENCE,
)
from trustlake.functions.numeric import clamp

_UUID = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def case_of(key: Column, table: Mapping[str, object], default: object) -> Column:
    """Small constant lookup as a CASE expression: no join, stays inside code generation."""
    expr = None
    for name, value in table.items():
        expr = F.when(key == name, F.lit(value)) if expr is None else expr.when(key == name, F.lit(value))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def finding_dimension(category: Column, threat_id: Column) -> Column:
    """Assurance dimension by category, else by threat prefix, else null (the finding is rejected)."""
    cat = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    threat = F.upper(F.trim(F.coalesce(threat_id, F.lit(""))))
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for dimension, names in DIMENSION_CATEGORIES.items():
        expr = expr.when(cat.isin(*names), dimension)
    for dimension, prefix in DIMENSION_PREFIXES.items():
        expr = expr.when(threat.startswith(prefix), dimension)
    return expr


def finding_problems(
    finding_id: Column, category: Column, threat_id: Column, severity: Column,
    confidence: Column, recommended: Column, require_uuid: bool = False,
) -> Column:
    """Array of reasons why a finding cannot enter the arithmetic; empty means valid."""
    bad_id = finding_id.isNull() if not require_uuid else ~F.coalesce(finding_id.rlike(_UUID), F.lit(False))
    checks = [
        (bad_id, "finding_id"),
        (confidence.isNull() | F.isnan(confidence) | (F.abs(confidence) == F.lit(float("inf"))), "confidence_not_finite"),
        (~F.isnan(confidence) & ((confidence < 0) | (confidence > 1)), "confidence_out_of_range"),
        (~F.coalesce(severity.isin(*SEVERITIES), F.lit(False)), "severity"),
        (~F.coalesce(recommended.isin(*DISPOSITIONS), F.lit(False)), "recommended_disposition"),
        (finding_dimension(category, threat_id).isNull(), "dimension"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))


def finding_risk(severity: Column, confidence: Column, weights: Mapping[str, float] = SEVERITY_WEIGHTS) -> Column:
    for name, weight in weights.items():
        if not 0.0 <= weight < float("inf"):
            raise ValueError(f"invalid severity weight for {name}: {weight}")
    return clamp(case_of(severity, weights, 0.0) * confidence)


def critical_veto(
    severity: Column, confidence: Column, recommended: Column, min_confidence: float = VETO_CONFIDENCE
) -> Column:
    return ((severity == "CRITICAL") & (confidence >= min_confidence)) | (recommended == "QUARANTINE")


def disposition(
    risk: Column, veto: Column, review_asked: Column, open_checks: Column,
    quarantine: float = QUARANTINE_THRESHOLD, review: float = REVIEW_THRESHOLD,
) -> Column:
    """Veto or high risk first, then anything incomplete or asked for, then acceptance."""
    return (
        F.when(veto | (risk >= quarantine), "QUARANTINE")
        .when((risk >= review) | review_asked | (open_checks > 0), "REVIEW")
        .otherwise("ACCEPT")
    )


def distance_band(distance: Column, lower: float = 0.08, upper: float = 0.25) -> Column:
    """Behavioural distance to assessment: equivalent, drift (MT-2) or substitution (MT-1)."""
    return (
        F.when(distance < lower, "VALIDATION_RESULT")
        .when(distance < upper, "MODEL_DIFFERENCE")
        .otherwise("SUSPICIOUS_INDICATOR")
    )


def calibrated_confidence(
    metric: Column, sufficient: Column, floor: float, base: float, slope: float, small_slope: float
) -> Column:
    """Confidence of a shift finding: wide range with enough samples, at most 0.40 without."""
    enough = F.least(F.lit(0.95), F.greatest(F.lit(floor), F.lit(base) + metric * slope))
    few = F.least(F.lit(0.40), F.lit(0.20) + metric * small_slope)
    return F.when(sufficient, enough).otherwise(few)


def check_state(images: Column, classes: Column, min_images: Column, min_classes: Column, requested: Column) -> Column:
    """Whether a data check runs on a dataset of this size."""
    return (
        F.when(~requested, "not_requested")
        .when((images < min_images) | (classes < min_classes), "insufficient")
        .otherwise("executed")
    )
