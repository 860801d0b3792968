"""Data findings rolled up per contributor and batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.constants import CONTRIBUTOR_DEFAULT_WEIGHT, CONTRIBUTOR_WEIGHTS
from trustlake.functions.risk import case_of


def contributor_breakdown(findings: DataFrame, by: Sequence[str] = ("contributor_id", "batch_id")) -> DataFrame:
    """Finding counts per contributor, threat and severity."""
    return findings.where(F.col(by[0]).isNotNull()).groupBy(*by, "threat_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def contributor_risk(
    findings: DataFrame, images: DataFrame, by: Sequence[str] = ("contributor_id", "batch_id"), per_image: float = 0.1
) -> DataFrame:
    """Summed severity weights over ``per_image`` of the images, capped at one. Rows without a contributor are left out:
    provenance is never guessed. ``images`` has one row per contributor with a ``images`` count."""
    weight = case_of(F.col("severity"), CONTRIBUTOR_WEIGHTS, CONTRIBUTOR_DEFAULT_WEIGHT)
    totals = findings.where(F.col(by[0]).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("issues"), F.sum(weight).alias("_weight")
    )
    size = F.coalesce(F.col("images"), F.lit(0))
    risk = F.least(F.lit(1.0), F.col("_weight") / F.greatest(F.lit(1.0), size * per_image))
    return totals.join(images, list(by), "left").withColumn("risk", risk).select(
        *by, "issues", size.alias("images"), "risk",
        F.when(F.col("risk") > 0.6, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(F.col("risk") < 0.7, "REVIEW").otherwise("QUARANTINE").alias("recommended_disposition"),
    )
