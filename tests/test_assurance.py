"""Hand-computed assurance scenarios."""

import pytest

from trustlake.operators import assurance as A
from trustlake.plans.jobs import assess

COLUMNS = "finding_id string, asset_id string, session_id string, threat_id string, category string, severity string, confidence double, recommended_disposition string, ord long"
CATEGORY = {"DT": "DATA_INTEGRITY", "MT": "MODEL_INTEGRITY", "IT": "INFERENCE_PROVENANCE", "DS": "DISTRIBUTION_SHIFT"}


def _f(session, n, threat, severity, confidence, advice="ACCEPT"):
    return (f"{session}-{n}", "a", session, threat, CATEGORY[threat[:2]], severity, confidence, advice, n)


FINDINGS = [
    _f("two_medium", 1, "DT-1", "MEDIUM", 0.8, "REVIEW"), _f("two_medium", 2, "DT-2", "MEDIUM", 0.8, "REVIEW"),
    _f("one_high", 1, "DS-1", "HIGH", 0.9), _f("veto", 1, "MT-3", "CRITICAL", 0.55, "REVIEW"), _f("low", 1, "DT-1", "LOW", 0.5),
    _f("no_veto", 1, "MT-3", "CRITICAL", 0.4), _f("advised", 1, "IT-1", "LOW", 0.1, "QUARANTINE"), _f("covered", 1, "DT-5", "LOW", 0.1),
]
COVERAGE = [("clean", "DT-1", "executed"), ("open", "DS-3", "unsupported"), ("open", " DS-3 ", "skipped"), ("open", "DT-5", "skipped"),
            ("open", "DT-5", "executed"), ("covered", "DT-5", "skipped")]
EXPECTED = {
    "two_medium": (0.40, "REVIEW"), "one_high": (0.72, "QUARANTINE"), "veto": (0.70, "QUARANTINE"), "low": (0.10, "ACCEPT"), "no_veto": (0.40, "REVIEW"),
    "advised": (0.70, "QUARANTINE"), "clean": (0.0, "ACCEPT"), "open": (0.0, "REVIEW"), "covered": (0.02, "ACCEPT"),
}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(FINDINGS, COLUMNS), spark.createDataFrame(COVERAGE, "session_id string, analysis_id string, state string")


def test_scenarios(tables):
    rows = {r["session_id"]: r for r in A.verdicts(*tables).collect()}
    assert {k: (r["composite_risk"], r["disposition"]) for k, r in rows.items()} == EXPECTED
    assert rows["two_medium"]["data_integrity"] == 0.64
    assert rows["open"]["unsupported_checks"] == ["DS-3"] and rows["covered"]["unsupported_checks"] == []


def test_duplicates_and_order_do_not_matter(tables):
    findings, coverage = tables
    twice = findings.union(findings.withColumn("severity", A.F.lit("CRITICAL")).withColumn("ord", A.F.col("ord") + 100)).orderBy("finding_id")
    assert sorted(A.verdicts(twice, coverage).collect()) == sorted(A.verdicts(findings, coverage).collect())


def test_narrative_counts_equal_vetoes(spark, tables):
    many = spark.createDataFrame([_f("hot", i, "IT-1", "CRITICAL", 1.0, "QUARANTINE") for i in range(1500)] + [
        _f("hot", 1500, "MT-2", "CRITICAL", 0.9, "QUARANTINE")], COLUMNS)
    rows, _, text = assess(many, tables[1])
    assert rows.where("session_id = 'hot'").first()["veto_findings"] == 1501
    line = {r["session_id"]: r["summary"] for r in text.collect()}
    assert "[IT-1 (CRITICAL, conf: 1.00) x 1500, MT-2 (CRITICAL, conf: 0.90)]" in line["hot"] and "COMPLETE" in line["clean"] and "INCOMPLETE" in line["open"]
