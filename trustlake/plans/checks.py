"""Check interfaces: a check turns tables into rows of the common findings layout."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.session import cut_lineage

Tables = Mapping[str, DataFrame]
FINDING_COLUMNS = (
    "finding_id", "asset_id", "session_id", "threat_id", "category", "severity", "confidence", "recommended_disposition", "ord", "title", "metrics",
)


class Staged(dict):
    """Tables of a run, with results that checks share: each is computed when first asked for and then stored."""

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self:
            self[name] = cut_lineage(make())
        return self[name]


def once(tables: Tables, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The shared result of a run, or a plan of its own where tables are not :class:`Staged`."""
    return tables.once(name, make) if isinstance(tables, Staged) else make()


@dataclass(frozen=True)
class Check:
    """``requires`` names the tables the check reads; ``run`` returns findings built by :func:`finding_rows`."""

    threat_id: str
    requires: tuple[str, ...]
    run: Callable[[Tables], DataFrame]

    def applicable(self, tables: Tables) -> bool:
        return all(name in tables for name in self.requires)


def finding_rows(
    df: DataFrame, asset: str, threat_id: str, category: str, severity: Column, confidence: Column, recommended: Column,
    title: Column, metrics: Mapping[str, Column], session: str | None = None,
) -> DataFrame:
    """One finding per row of ``df``. The id is a digest of what makes the finding unique, so reruns agree."""
    session_id = F.col(session) if session else F.col(asset)
    number = [x for n, c in metrics.items() for x in (F.lit(n), c.cast("double"))]
    return df.select(
        F.sha2(F.concat_ws("|", session_id.cast("string"), F.col(asset).cast("string"), F.lit(threat_id), title), 256).alias("finding_id"),
        F.col(asset).cast("string").alias("asset_id"), session_id.cast("string").alias("session_id"), F.lit(threat_id).alias("threat_id"),
        F.lit(category).alias("category"), severity.alias("severity"), confidence.cast("double").alias("confidence"), recommended.alias("recommended_disposition"),
        F.lit(0).cast("long").alias("ord"), title.alias("title"), F.create_map(*number).alias("metrics"),
    )


def evidence_rows(findings: DataFrame) -> DataFrame:
    """One evidence record per finding, with its metrics and digest."""
    body = F.to_json(F.struct("metrics", F.struct("threat_id").alias("reproducibility_info")))
    return findings.select(
        F.sha2(F.concat("finding_id", F.lit("|evidence")), 256).alias("evidence_id"), "session_id", "finding_id",
        F.lit("STATISTICAL").alias("evidence_type"), F.sha2(body, 256).alias("content_hash"), body.alias("record_json"),
    )


def no_findings(spark: SparkSession) -> DataFrame:
    """The findings layout without a row, for a request that no check answers."""
    kinds = {"confidence": "double", "ord": "bigint", "metrics": "map<string,double>"}
    return spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in FINDING_COLUMNS))


def run_checks(checks: Iterable[Check], tables: Tables, requested: Iterable[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Union of the findings of every requested, applicable check, and the state of each check."""
    wanted = set(requested or ())
    parts, states = [], {}
    for check in checks:
        if wanted and check.threat_id not in wanted and "AUTO" not in wanted:
            states[check.threat_id] = "skipped"
        elif not check.applicable(tables):
            states[check.threat_id] = "unsupported"
        else:
            parts.append(check.run(tables).select(*FINDING_COLUMNS))
            states[check.threat_id] = "executed"
    return (reduce(DataFrame.unionByName, parts) if parts else no_findings(next(iter(tables.values())).sparkSession)), states
