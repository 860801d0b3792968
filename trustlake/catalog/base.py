"""Registry of runnable queries and the inputs they derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent DuckDB text."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@dataclass(frozen=True)
class Tables:
    """Lazy access to the parquet tables of one scale directory."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def fx(expr: str, digits: int = 6) -> str:
    """DuckDB spelling of :func:`trustlake.functions.numeric.fixed`."""
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5000001::DOUBLE) / {scale})"


# --- findings: every lineitem row is one finding of its order ------------------------------------------------

FINDINGS_SQL = """raw_findings AS (
  SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_suppkey::VARCHAR AS finding_id,
         'a' || (l_orderkey % 100)::VARCHAR AS asset_id, l_orderkey::VARCHAR AS session_id,
         l_suppkey AS contributor, l_partkey AS ord,
         CASE l_linenumber % 4 WHEN 0 THEN 'DT-' WHEN 1 THEN 'MT-' WHEN 2 THEN 'IT-' ELSE 'DS-' END
           || (1 + l_suppkey % 3)::VARCHAR AS threat_id,
         CASE WHEN l_linenumber = 7 THEN 'other'
              ELSE CASE l_linenumber % 4 WHEN 0 THEN 'DATA_INTEGRITY' WHEN 1 THEN 'MODEL_INTEGRITY'
                   WHEN 2 THEN 'INFERENCE_PROVENANCE' ELSE ' Distribution_Shift' END END AS category,
         CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 'CRITICAL'
              WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'HIGH'
              WHEN l_returnflag = 'R' THEN 'MEDIUM' WHEN l_returnflag = 'A' THEN 'LOW'
              ELSE 'INFORMATIONAL' END AS severity,
         abs(l_discount) * 10 AS confidence,
         CASE WHEN l_tax >= 0.08 AND l_quantity >= 45 THEN 'QUARANTINE' WHEN l_tax >= 0.07 THEN 'REVIEW'
              ELSE 'ACCEPT' END AS recommended_disposition
  FROM lineitem),
findings AS (SELECT * FROM raw_findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ord) = 1)"""

SCORED_SQL = FINDINGS_SQL + """,
scored AS (
  SELECT *, CASE WHEN lower(trim(category)) IN ('data_integrity', 'dataset_integrity') THEN 'data_integrity'
                 WHEN lower(trim(category)) = 'model_integrity' THEN 'model_integrity'
                 WHEN lower(trim(category)) IN ('inference_provenance', 'provenance') THEN 'inference_provenance'
                 WHEN lower(trim(category)) IN ('distribution_shift', 'shift') THEN 'distribution_shift'
                 WHEN threat_id LIKE 'DT-%' THEN 'data_integrity' WHEN threat_id LIKE 'MT-%' THEN 'model_integrity'
                 WHEN threat_id LIKE 'IT-%' THEN 'inference_provenance' ELSE 'distribution_shift' END AS dimension,
         greatest(0.0, least(1.0, confidence * CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8
             WHEN 'MEDIUM' THEN 0.5 WHEN 'LOW' THEN 0.2 ELSE 0.0 END::DOUBLE)) AS risk,
         (severity = 'CRITICAL' AND confidence >= 0.5) OR recommended_disposition = 'QUARANTINE' AS veto
  FROM findings)"""

COVERAGE_SQL = """coverage AS (
  SELECT o_orderkey::VARCHAR AS session_id,
         CASE o_custkey % 5 WHEN 0 THEN 'DT-2' WHEN 1 THEN ' MT-1' WHEN 2 THEN 'IT-3' WHEN 3 THEN 'DS-1' ELSE 'DT-5' END
           AS analysis_id,
         CASE o_orderstatus WHEN 'F' THEN 'executed' WHEN 'O' THEN 'skipped' ELSE 'unsupported' END AS state
  FROM orders)"""


def _pick(key: Column, options: dict[int, str], other: str) -> Column:
    expr = None
    for value, text in options.items():
        expr = F.when(key == value, text) if expr is None else expr.when(key == value, text)
    return expr.otherwise(other)


def findings(t: Tables) -> DataFrame:
    c = F.col
    kind = c("l_linenumber") % 4
    return t("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("finding_id"),
        F.concat(F.lit("a"), c("l_orderkey") % 100).alias("asset_id"),
        c("l_orderkey").cast("string").alias("session_id"),
        c("l_suppkey").alias("contributor"),
        c("l_partkey").alias("ord"),
        F.concat(_pick(kind, {0: "DT-", 1: "MT-", 2: "IT-"}, "DS-"), (1 + c("l_suppkey") % 3)).alias("threat_id"),
        F.when(c("l_linenumber") == 7, "other").otherwise(
            _pick(kind, {0: "DATA_INTEGRITY", 1: "MODEL_INTEGRITY", 2: "INFERENCE_PROVENANCE"}, " Distribution_Shift")
        ).alias("category"),
        F.when((c("l_returnflag") == "R") & (c("l_quantity") >= 49), "CRITICAL")
        .when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), "HIGH")
        .when(c("l_returnflag") == "R", "MEDIUM").when(c("l_returnflag") == "A", "LOW")
        .otherwise("INFORMATIONAL").alias("severity"),
        (F.abs("l_discount") * 10).alias("confidence"),
        F.when((c("l_tax") >= 0.08) & (c("l_quantity") >= 45), "QUARANTINE").when(c("l_tax") >= 0.07, "REVIEW")
        .otherwise("ACCEPT").alias("recommended_disposition"),
    )


def coverage(t: Tables) -> DataFrame:
    c = F.col
    return t("orders").select(
        c("o_orderkey").cast("string").alias("session_id"),
        _pick(c("o_custkey") % 5, {0: "DT-2", 1: " MT-1", 2: "IT-3", 3: "DS-1"}, "DT-5").alias("analysis_id"),
        F.when(c("o_orderstatus") == "F", "executed").when(c("o_orderstatus") == "O", "skipped")
        .otherwise("unsupported").alias("state"),
    )
