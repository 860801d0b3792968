"""Assurance queries over lineitem and orders."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.catalog.base import COVERAGE_SQL, FINDINGS_SQL, SCORED_SQL, Tables, coverage, findings, fx, query
from trustlake.constants import DIMENSIONS
from trustlake.functions.numeric import fixed
from trustlake.functions.risk import distance_band
from trustlake.operators import assurance as A

_DIMENSION_COLUMNS = ",\n".join(
    fx(f"greatest(0.0, least(1.0, 1 - coalesce(product(1 - risk) FILTER (dimension = '{d}'), 1.0)))", 4) + f" AS {d}"
    for d in DIMENSIONS
)
VERDICT_SQL = f"""WITH {SCORED_SQL}, {COVERAGE_SQL},
marks AS (
  SELECT session_id, trim(analysis_id) AS analysis_id, state <> 'executed' AS open, state = 'executed' AS covered FROM coverage
  UNION ALL SELECT session_id, threat_id, false, true FROM scored),
still_open AS (
  SELECT session_id, analysis_id FROM marks GROUP BY ALL HAVING bool_or(open) AND NOT bool_or(covered)),
open_lists AS (SELECT session_id, string_agg(analysis_id, ',' ORDER BY analysis_id) AS open_list, count(*) AS open_n
               FROM still_open GROUP BY session_id),
scores AS (
  SELECT session_id, min(asset_id) AS asset_id, count(*) AS findings, {_DIMENSION_COLUMNS},
         max(risk) AS max_risk, bool_or(veto) AS veto, bool_or(recommended_disposition = 'REVIEW') AS review_asked,
         count(*) FILTER (veto) AS veto_findings,
         count(*) FILTER (risk > 0 OR recommended_disposition <> 'ACCEPT') AS contributing
  FROM scored GROUP BY session_id),
named AS (SELECT session_id FROM scored UNION SELECT session_id FROM coverage),
joined AS (
  SELECT n.session_id, asset_id, coalesce(findings, 0) AS findings, coalesce(veto, false) AS veto,
         coalesce(review_asked, false) AS review_asked, coalesce(veto_findings, 0) AS veto_findings,
         coalesce(contributing, 0) AS contributing, coalesce(max_risk, 0.0) AS max_risk,
         {", ".join(f"coalesce({d}, 0.0) AS {d}" for d in DIMENSIONS)},
         coalesce(open_list, '') AS unsupported_checks, coalesce(open_n, 0) AS open_n
  FROM named n LEFT JOIN scores USING (session_id) LEFT JOIN open_lists USING (session_id)),
risked AS (
  SELECT *, {fx('''greatest(0.0, least(1.0, greatest(max_risk,
      0.25 * data_integrity + 0.15 * distribution_shift + 0.25 * inference_provenance + 0.35 * model_integrity,
      CASE WHEN veto THEN 0.7 ELSE 0.0 END)))''', 4)} AS composite_risk
  FROM joined),
verdicts AS (
  SELECT session_id, asset_id, composite_risk,
         CASE WHEN veto OR composite_risk >= 0.7 THEN 'QUARANTINE'
              WHEN composite_risk >= 0.3 OR review_asked OR open_n > 0 THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition,
         {", ".join(DIMENSIONS)}, findings, veto, veto_findings, contributing, unsupported_checks, open_n
  FROM risked)"""


def verdict_rows(t: Tables):
    return A.verdicts(findings(t), coverage(t))


@query("assurance_verdicts", VERDICT_SQL + "\nSELECT * EXCLUDE (open_n) FROM verdicts")
def assurance_verdicts(spark, sf):
    rows = verdict_rows(Tables(spark, sf))
    return rows.withColumn("unsupported_checks", F.array_join("unsupported_checks", ","))


@query("assurance_narrative", VERDICT_SQL + """,
labels AS (SELECT session_id, format('{} ({}, conf: {:.2f})', threat_id, severity, confidence) AS label, count(*) AS n FROM scored WHERE veto GROUP BY ALL),
vetoes AS (SELECT session_id, string_agg(label || CASE WHEN n > 1 THEN ' x ' || n::VARCHAR ELSE '' END, ', ' ORDER BY label) AS t FROM labels GROUP BY session_id),
threats AS (SELECT session_id, string_agg(format('{} (count={})', threat_id, n), ', ' ORDER BY threat_id) AS t
            FROM (SELECT session_id, threat_id, count(*) AS n FROM scored
                  WHERE risk > 0 OR recommended_disposition <> 'ACCEPT' GROUP BY ALL) GROUP BY session_id)
SELECT v.session_id, concat_ws(' ',
  format('DISPOSITION: {} | Composite Risk Score: {:.4f}', disposition, composite_risk),
  CASE WHEN veto_findings > 0 THEN format('CRITICAL VETO TRIGGERED: {} finding(s) forced immediate quarantine: [{}].',
       veto_findings, vetoes.t) END,
  format('Dimensional Risk Profile: data_integrity={:.4f}, distribution_shift={:.4f}, inference_provenance={:.4f}, model_integrity={:.4f}.',
         data_integrity, distribution_shift, inference_provenance, model_integrity),
  CASE WHEN contributing > 0 THEN format('Contributing Findings ({}): [{}].', contributing, threats.t)
       ELSE 'Contributing Findings: None (zero threat signals detected).' END,
  CASE WHEN open_n > 0 THEN 'Verification Coverage INCOMPLETE: ' || open_n::VARCHAR || ' check(s) unperformed/skipped: ['''
            || replace(unsupported_checks, ',', ''', ''') || ''']. Asset cannot receive ACCEPT disposition.'
       ELSE 'Verification Coverage: COMPLETE. All requested checks executed and evaluated.' END) AS summary
FROM verdicts v LEFT JOIN vetoes USING (session_id) LEFT JOIN threats USING (session_id)""")
def assurance_narrative(spark, sf):
    t = Tables(spark, sf)
    scored = A.score_findings(A.dedup_findings(findings(t)))
    return A.narrative(verdict_rows(t), scored)


@query("noisy_or", f"""WITH {SCORED_SQL}
SELECT contributor, dimension, {fx('greatest(0.0, least(1.0, 1 - product(1 - risk)))', 4)} AS score
FROM scored GROUP BY ALL""")
def noisy_or(spark, sf):
    return A.noisy_or(A.score_findings(A.dedup_findings(findings(Tables(spark, sf)))), "contributor")


@query("finding_dedup", f"WITH {FINDINGS_SQL} SELECT finding_id, ord, severity, confidence FROM findings")
def finding_dedup(spark, sf):
    return A.dedup_findings(findings(Tables(spark, sf))).select("finding_id", "ord", "severity", "confidence")


@query("finding_risk", f"""WITH {SCORED_SQL}
SELECT finding_id, dimension, {fx('risk')} AS risk, veto FROM scored""")
def finding_risk(spark, sf):
    scored = A.score_findings(A.dedup_findings(findings(Tables(spark, sf))))
    return scored.select("finding_id", "dimension", fixed(F.col("risk"), 6).alias("risk"), "veto")


@query("finding_validation", f"""WITH {FINDINGS_SQL},
broken AS (SELECT finding_id, ord,
    CASE WHEN ord % 7 = 0 THEN 'SEVERE' ELSE severity END AS severity,
    CASE WHEN ord % 11 = 0 THEN 'NaN'::DOUBLE WHEN ord % 13 = 0 THEN confidence + 1.5 ELSE confidence END AS confidence,
    CASE WHEN ord % 17 = 0 THEN 'BLOCK' ELSE recommended_disposition END AS recommended_disposition,
    CASE WHEN ord % 19 = 0 THEN 'zz' ELSE category END AS category,
    CASE WHEN ord % 19 = 0 THEN 'ZZ-1' ELSE threat_id END AS threat_id FROM raw_findings)
SELECT finding_id, ord, concat_ws(',',
    CASE WHEN isnan(confidence) THEN 'confidence_not_finite' END,
    CASE WHEN NOT isnan(confidence) AND (confidence < 0 OR confidence > 1) THEN 'confidence_out_of_range' END,
    CASE WHEN severity = 'SEVERE' THEN 'severity' END,
    CASE WHEN recommended_disposition = 'BLOCK' THEN 'recommended_disposition' END,
    CASE WHEN category = 'zz' THEN 'dimension' END) AS problems
FROM broken WHERE problems <> ''""")
def finding_validation(spark, sf):
    hit = lambda n: F.col("ord") % n == 0
    broken = (
        findings(Tables(spark, sf))
        .withColumn("severity", F.when(hit(7), "SEVERE").otherwise(F.col("severity")))
        .withColumn("confidence", F.when(hit(11), float("nan")).when(hit(13), F.col("confidence") + 1.5)
                    .otherwise(F.col("confidence")))
        .withColumn("recommended_disposition", F.when(hit(17), "BLOCK").otherwise(F.col("recommended_disposition")))
        .withColumn("category", F.when(hit(19), "zz").otherwise(F.col("category")))
        .withColumn("threat_id", F.when(hit(19), "ZZ-1").otherwise(F.col("threat_id")))
    )
    _, rejects = A.validate_findings(broken)
    return rejects.select("finding_id", "ord", F.array_join("problems", ",").alias("problems"))


@query("open_checks", f"""WITH {FINDINGS_SQL}, {COVERAGE_SQL}
SELECT DISTINCT session_id, trim(analysis_id) AS analysis_id FROM coverage c WHERE state <> 'executed'
  AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.session_id = c.session_id AND f.threat_id = trim(c.analysis_id))
  AND NOT EXISTS (SELECT 1 FROM coverage e WHERE e.session_id = c.session_id AND e.state = 'executed'
                  AND trim(e.analysis_id) = trim(c.analysis_id))""")
def open_checks(spark, sf):
    t = Tables(spark, sf)
    return A.open_checks(coverage(t), A.dedup_findings(findings(t)))


@query("contributing_findings", f"""WITH {SCORED_SQL}
SELECT session_id, finding_id, threat_id, {fx('risk')} AS risk, veto FROM scored
WHERE risk > 0 OR recommended_disposition IN ('REVIEW', 'QUARANTINE')""")
def contributing_findings(spark, sf):
    rows = A.contributing_findings(A.score_findings(A.dedup_findings(findings(Tables(spark, sf)))))
    return rows.withColumn("risk", fixed(F.col("risk"), 6))


@query("distance_bands", """SELECT l_suppkey AS model_id, count(*) AS lines,
  CASE WHEN avg(l_tax) * 2 < 0.08 THEN 'VALIDATION_RESULT' WHEN avg(l_tax) * 2 < 0.25 THEN 'MODEL_DIFFERENCE'
       ELSE 'SUSPICIOUS_INDICATOR' END AS band FROM lineitem GROUP BY l_suppkey""")
def distance_bands(spark, sf):
    """Taxes are added up in the order of the rows: means that lie on an edge of a band depend on that order."""
    at = F.struct("_metadata.file_path", "_metadata.row_index").alias("at")
    rows = Tables(spark, sf)("lineitem").select(F.col("l_suppkey").alias("model_id"), F.col("l_tax").alias("tax"), at)
    so_far = rows.withColumn("so_far", F.sum("tax").over(W.partitionBy("model_id").orderBy("at")))
    drift = so_far.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("lines"), (F.max_by("so_far", "at") / F.count("tax") * 2).alias("d")
    )
    return drift.select("model_id", "lines", distance_band(F.col("d")).alias("band"))
