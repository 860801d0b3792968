"""Evidence, lineage and catalogue queries over documents, orders and lineitem."""

from pyspark.sql import functions as F

from trustlake.catalog.base import COVERAGE_SQL, FINDINGS_SQL, Tables, coverage, findings, query
from trustlake.functions.hashing import sha256
from trustlake.functions.text import basename, extension, safe_path, stem, clean_relative
from trustlake.operators import assurance as A
from trustlake.operators import evidence as E
from trustlake.operators import lineage as L

KINDS = ("STATISTICAL", "VISUAL", "CRYPTOGRAPHIC", "BEHAVIORAL", "COMPARATIVE")
EVIDENCE = """evidence AS (SELECT doc_id AS evidence_id, source AS session_id, 'f' || (doc_id // 2)::VARCHAR AS finding_id,
  ['STATISTICAL', 'visual', 'CRYPTOGRAPHIC', 'BEHAVIORAL', 'COMPARATIVE'][doc_id % 5 + 1] AS evidence_type, sha256(text) AS content_hash,
  '{"reproducibility_info": {"threat_id": "DT-' || (doc_id % 6)::VARCHAR || '"}}' AS record_json FROM documents),
fnd AS (SELECT 'f' || doc_id::VARCHAR AS finding_id, 'MT-' || (quality * 2 + toxic)::VARCHAR AS threat_id,
  CASE WHEN quality = 1 THEN 'MODEL_INTEGRITY' ELSE 'DATA_INTEGRITY' END AS category FROM labels),
threats AS (SELECT DISTINCT e.*, coalesce(f.threat_id, record_json::JSON->>'$.reproducibility_info.threat_id') AS threat_id FROM evidence e LEFT JOIN fnd f USING (finding_id))"""


def evidence(t: Tables):
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(k if k != "VISUAL" else "visual") for k in KINDS])
    return t("documents").select(
        d.alias("evidence_id"), F.col("source").alias("session_id"), F.concat(F.lit("f"), F.floor(d / 2)).alias("finding_id"),
        F.element_at(kinds, (d % 5 + 1).cast("int")).alias("evidence_type"), sha256(F.col("text")).alias("content_hash"),
        F.concat(F.lit('{"reproducibility_info": {"threat_id": "DT-'), d % 6, F.lit('"}}')).alias("record_json"),
    )


def evidence_findings(t: Tables):
    return t("labels").select(
        F.concat(F.lit("f"), "doc_id").alias("finding_id"), F.concat(F.lit("MT-"), F.col("quality") * 2 + F.col("toxic")).alias("threat_id"),
        F.when(F.col("quality") == 1, "MODEL_INTEGRITY").otherwise("DATA_INTEGRITY").alias("category"),
    )


@query("evidence_with_threat", f"WITH {EVIDENCE} SELECT evidence_id, finding_id, threat_id FROM threats")
def evidence_with_threat(spark, sf):
    t = Tables(spark, sf)
    return E.evidence_with_threat(evidence(t), evidence_findings(t)).select("evidence_id", "finding_id", "threat_id")


@query("search_evidence", f"""WITH {EVIDENCE} SELECT evidence_id, session_id, evidence_type, threat_id FROM threats
WHERE session_id LIKE 'src1%' AND upper(evidence_type) LIKE 'VIS%' AND upper(threat_id) LIKE 'MT%'""")
def search_evidence(spark, sf):
    t = Tables(spark, sf)
    rows = E.search_evidence(evidence(t), evidence_findings(t), session_id="src1", evidence_type="vis", threat_id="mt")
    return rows.select("evidence_id", "session_id", "evidence_type", "threat_id")


@query("evidence_by_category", f"WITH {EVIDENCE} SELECT evidence_id, content_hash FROM evidence WHERE finding_id IN (SELECT finding_id FROM fnd WHERE category = 'DATA_INTEGRITY')")
def evidence_by_category(spark, sf):
    t = Tables(spark, sf)
    return E.evidence_by_category(evidence(t), evidence_findings(t), "DATA_INTEGRITY").select("evidence_id", "content_hash")


@query("evidence_for_verdict", f"""WITH {EVIDENCE}, vf AS (SELECT DISTINCT 'v' || (doc_id % 10)::VARCHAR AS verdict_id, 'f' || doc_id::VARCHAR AS finding_id FROM labels WHERE toxic = 1)
SELECT verdict_id, finding_id, evidence_id FROM vf JOIN evidence USING (finding_id)""")
def evidence_for_verdict(spark, sf):
    t = Tables(spark, sf)
    chosen = t("labels").where("toxic = 1").select(
        F.concat(F.lit("v"), F.col("doc_id") % 10).alias("verdict_id"), F.concat(F.lit("f"), "doc_id").alias("finding_id")
    )
    return E.evidence_for_verdict(chosen, evidence(t)).select("verdict_id", "finding_id", "evidence_id")


@query("evidence_counts", f"WITH {EVIDENCE} SELECT session_id, count(*) AS total, " + ", ".join(
    f"count(*) FILTER (upper(evidence_type) = '{k}') AS {k.lower()}" for k in KINDS) + " FROM evidence GROUP BY session_id")
def evidence_counts(spark, sf):
    return E.evidence_counts(evidence(Tables(spark, sf)), KINDS)


RECONCILE = """cat AS (SELECT 's' || (o_custkey % 50)::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '/evidence/' ELSE '/artifacts/' END || o_orderkey::VARCHAR || '.json' AS path,
    CASE WHEN o_orderkey % 2 = 0 THEN 'evidence' ELSE 'artifact' END AS kind, sha256(o_orderkey::VARCHAR) AS digest FROM orders WHERE o_orderkey % 7 <> 0),
fil AS (SELECT 's' || (o_custkey % 50)::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '/evidence/' ELSE '/artifacts/' END
    || CASE WHEN o_orderkey % 91 = 0 THEN '.tmp_' ELSE '' END || o_orderkey::VARCHAR || CASE WHEN o_orderkey % 77 = 0 THEN '.bin' ELSE '.json' END AS path,
    CASE WHEN o_orderkey % 2 = 0 THEN 'evidence' ELSE 'artifact' END AS kind, sha256((o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS digest FROM orders WHERE o_orderkey % 11 <> 0),
rec AS (SELECT coalesce(c.path, f.path) AS path, coalesce(c.kind, f.kind) AS kind, CASE WHEN f.path IS NULL THEN 'missing' WHEN c.path IS NULL THEN 'orphan' WHEN c.digest <> f.digest THEN 'tampered' ELSE 'ok' END AS state
  FROM cat c FULL JOIN (SELECT * FROM fil WHERE path NOT LIKE '%/.tmp_%') f ON c.path = f.path),
kept AS (SELECT * FROM rec WHERE state <> 'orphan' OR kind <> 'evidence' OR path LIKE '%.json')"""


def _store(t: Tables):
    k = F.col("o_orderkey")
    even = k % 2 == 0
    base = F.concat(F.lit("s"), F.col("o_custkey") % 50, F.when(even, "/evidence/").otherwise("/artifacts/"))
    kind = F.when(even, "evidence").otherwise("artifact").alias("kind")
    catalogue = t("orders").where(k % 7 != 0).select(F.concat(base, k, F.lit(".json")).alias("path"), kind, sha256(k.cast("string")).alias("digest"))
    name = F.concat(base, F.when(k % 91 == 0, ".tmp_").otherwise(""), k, F.when(k % 77 == 0, ".bin").otherwise(".json"))
    digest = sha256((k + F.when(k % 13 == 0, 1).otherwise(0)).cast("string"))
    return catalogue, t("orders").where(k % 11 != 0).select(name.alias("path"), kind, digest.alias("digest"))


@query("reconcile_store", f"WITH {RECONCILE} SELECT path, kind, state FROM kept")
def reconcile_store(spark, sf):
    return E.reconcile(*_store(Tables(spark, sf)))


@query("store_consistency", f"""WITH {RECONCILE} SELECT kind, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'tampered') AS tampered,
  count(*) FILTER (state = 'orphan') AS orphan, count(*) FILTER (state <> 'ok') = 0 AS is_consistent FROM kept GROUP BY kind""")
def store_consistency(spark, sf):
    return E.consistency(E.reconcile(*_store(Tables(spark, sf))))


@query("list_assets", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def list_assets(spark, sf):
    rows = Tables(spark, sf)("orders").withColumnsRenamed({"o_orderpriority": "asset_type", "o_orderstatus": "status", "o_orderdate": "ingestion_timestamp"})
    return E.list_assets(rows, "1-URGENT", "F").select("o_orderkey", F.col("asset_type").alias("o_orderpriority"))


@query("recent_sessions", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_sessions(spark, sf):
    return E.recent_sessions(Tables(spark, sf)("orders"), 50, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("findings_by_confidence", f"WITH {FINDINGS_SQL} SELECT finding_id, severity, confidence FROM findings WHERE session_id = '7'")
def findings_by_confidence(spark, sf):
    return E.findings_by_confidence(A.dedup_findings(findings(Tables(spark, sf))), "7").select("finding_id", "severity", "confidence")


@query("evidence_page", f"WITH {EVIDENCE} SELECT session_id, evidence_id FROM evidence ORDER BY session_id, evidence_id LIMIT 100 OFFSET 150")
def evidence_page(spark, sf):
    return E.page(evidence(Tables(spark, sf)).select("session_id", "evidence_id"), ["session_id", "evidence_id"], 100, 150)


@query("first_n", f"WITH {EVIDENCE} SELECT session_id, list_aggregate(list_sort(list(evidence_id))[1:20], 'string_agg', ',') AS first, count(*) AS total FROM evidence GROUP BY session_id")
def first_n(spark, sf):
    rows = E.first_n(evidence(Tables(spark, sf)), ["session_id"], "evidence_id", 20)
    return rows.withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


@query("has_payload", """SELECT doc_id, (doc_id % 3 = 0) OR (doc_id % 5 = 0) OR (doc_id % 7 = 0) OR (doc_id % 11 = 0 AND trim(source) <> '') AS has_payload FROM documents""")
def has_payload(spark, sf):
    d = F.col("doc_id")
    metrics = F.when(d % 3 == 0, F.create_map(F.lit("n"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))
    artifacts = F.when(d % 5 == 0, F.array(F.lit("a")))
    ref = F.when(d % 11 == 0, F.col("source")).otherwise(" ")
    return Tables(spark, sf)("documents").select("doc_id", E.has_payload(metrics, artifacts, F.when(d % 7 == 0, '{"a":1}').otherwise("{}"), ref).alias("has_payload"))


PATHS = """p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/' || split_part(url, '//', 2) WHEN 1 THEN 'C:' || split_part(url, '//', 2) WHEN 2 THEN split_part(url, '//', 2) || '/../x'
  WHEN 3 THEN replace(split_part(url, '//', 2), '/', '\\') WHEN 4 THEN split_part(url, '//', 2) || '..' ELSE split_part(url, '//', 2) END AS path FROM pages)"""


def paths(t: Tables):
    rest = F.split_part("url", F.lit("//"), F.lit(2))
    kind = F.col("page_id") % 6
    path = (
        F.when(kind == 0, F.concat(F.lit("/"), rest)).when(kind == 1, F.concat(F.lit("C:"), rest)).when(kind == 2, F.concat(rest, F.lit("/../x")))
        .when(kind == 3, F.replace(rest, F.lit("/"), F.lit("\\"))).when(kind == 4, F.concat(rest, F.lit(".."))).otherwise(rest)
    )
    return t("pages").select("page_id", path.alias("path"))


@query("safe_path", f"""WITH {PATHS}, s AS (SELECT *, NOT (path LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:') OR list_contains(string_split(replace(path, '\\', '/'), '/'), '..')) AS safe FROM p)
SELECT page_id, safe, CASE WHEN safe THEN replace(path, '\\', '/') END AS clean FROM s""")
def safe_paths(spark, sf):
    p = F.col("path")
    return paths(Tables(spark, sf)).select("page_id", safe_path(p).alias("safe"), clean_relative(p).alias("clean"))


@query("path_parts", """WITH p AS (SELECT page_id, replace(split_part(url, '//', 2), '?', '.') AS path FROM pages), b AS (SELECT *, list_extract(string_split(path, '/'), -1) AS base FROM p)
SELECT page_id, base, CASE WHEN base LIKE '_%.%' THEN array_to_string(string_split(base, '.')[:-2], '.') ELSE base END AS stem,
  CASE WHEN base LIKE '_%._%' AND base NOT LIKE '%.' THEN lower(list_extract(string_split(base, '.'), -1)) ELSE '' END AS ext FROM b""")
def path_parts(spark, sf):
    p = F.replace(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("?"), F.lit("."))
    return Tables(spark, sf)("pages").select("page_id", basename(p).alias("base"), stem(p).alias("stem"), extension(p).alias("ext"))


@query("json_extract", "SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_extract(spark, sf):
    return Tables(spark, sf)("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- lineage --------------------------------------------------------------------------------------------------------

PROVENANCE = """prov AS (SELECT o_orderkey::VARCHAR AS session_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS record_id, sha256((l_partkey % 40)::VARCHAR) AS model_weight_digest,
  ['VERIFIED', 'VERIFIED', 'VERIFIED', 'VERIFIED_WITH_WARNING', 'TAMPERED_OUTPUT', 'REPLAYED_RECORD', 'SUBSTITUTED_MODEL', 'UNVERIFIED_KEY'][l_suppkey % 8 + 1] AS status, l_shipdate AS created_at
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
newest AS (SELECT * FROM prov QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, record_id DESC) = 1)"""
LINEAGE_FINDINGS = "lf AS (SELECT session_id, threat_id, trim(category) AS category, severity FROM findings)"


def provenance(t: Tables):
    c = F.col
    names = F.array(*[F.lit(n) for n in ("VERIFIED", "VERIFIED", "VERIFIED", "VERIFIED_WITH_WARNING", "TAMPERED_OUTPUT", "REPLAYED_RECORD", "SUBSTITUTED_MODEL", "UNVERIFIED_KEY")])
    lines = t("lineitem")
    status = F.element_at(names, (c("l_suppkey") % 8 + 1).cast("int"))
    return lines.join(t("orders"), c("l_orderkey") == c("o_orderkey"), "left_semi").select(
        c("l_orderkey").cast("string").alias("session_id"), (c("l_partkey") * 1000000 + c("l_suppkey") * 10 + c("l_linenumber")).alias("record_id"),
        sha256((c("l_partkey") % 40).cast("string")).alias("model_weight_digest"), status.alias("status"),
        status.isin("VERIFIED", "VERIFIED_WITH_WARNING").alias("is_valid"), c("l_shipdate").alias("created_at"),
    )


def lineage_rows(t: Tables):
    c = F.col
    k = c("o_orderkey")
    session = k.cast("string").alias("session_id")
    sessions = t("orders").select(session, F.when(k % 3 == 0, F.upper(sha256((k % 40).cast("string")))).alias("model_digest"))
    found = A.dedup_findings(findings(t)).withColumn("category", F.trim("category"))
    analyses = coverage(t).select(
        "session_id", F.trim("analysis_id").alias("analysis_id"), F.when(c("state") == "executed", "executed").otherwise("skipped").alias("state")
    )
    totals = t("orders").select(session, (c("o_custkey") % 3).alias("total"))
    chains = t("orders").select(session, (k % 50 != 0).alias("is_valid"))
    verdicts = t("orders").where(k % 4 != 0).select(
        session, F.when(k % 10 == 0, "QUARANTINE").when(k % 10 < 4, "REVIEW").otherwise("ACCEPT").alias("disposition"), (k % 5).alias("open_checks")
    )
    return L.lineage(sessions, found, analyses, provenance(t), totals, chains, verdicts)


_STAGES = {"dataset": ("DT-", "DATA_INTEGRITY"), "model": ("MT-", "MODEL_INTEGRITY"), "inference": ("IT-", "INFERENCE_PROVENANCE"), "distribution": ("DS-", "Distribution_Shift_")}
LINEAGE = f"""{FINDINGS_SQL}, {COVERAGE_SQL}, {PROVENANCE}, {LINEAGE_FINDINGS},
ff AS (SELECT session_id, count(*) AS n, bool_or(threat_id = 'IT-1') AS it1, bool_or(threat_id = 'DS-4') AS ds4, """ + ", ".join(
    f"""count(*) FILTER (threat_id LIKE '{p}%' OR category = '{cat}') AS {s}_n, coalesce(bool_or((threat_id LIKE '{p}%' OR category = '{cat}') AND severity IN ('CRITICAL', 'HIGH')), false) AS {s}_h,
    coalesce(bool_or((threat_id LIKE '{p}%' OR category = '{cat}') AND severity IN ('MEDIUM', 'LOW')), false) AS {s}_l""" for s, (p, cat) in _STAGES.items()) + """ FROM lf GROUP BY session_id),
an AS (SELECT session_id, bool_or(state = 'executed' AND trim(analysis_id) LIKE 'DT-%') AS dt, count(*) FILTER (state = 'executed' AND trim(analysis_id) LIKE 'MT-%') AS ms,
  count(*) FILTER (state <> 'executed' AND trim(analysis_id) LIKE 'MT-%') AS mu, bool_or(state = 'executed' AND trim(analysis_id) LIKE 'DS-%') AS ds FROM coverage GROUP BY session_id),
j AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS session_id, o_custkey % 3 AS ev, o_orderkey % 50 <> 0 AS chain, CASE WHEN o_orderkey % 3 = 0 THEN sha256((o_orderkey % 40)::VARCHAR) END AS md,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'QUARANTINE' WHEN o_orderkey % 10 < 4 THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition,
  CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 5 END AS open_checks, coalesce(n, 0) AS findings, coalesce(it1, false) AS it1, coalesce(ds4, false) AS ds4, coalesce(dt, false) AS dt, coalesce(ms, 0) AS ms, coalesce(mu, 0) AS mu, coalesce(ds, false) AS ds,
  """ + ", ".join(f"coalesce({s}_n, 0) AS {s}_n, coalesce({s}_h, false) AS {s}_h, coalesce({s}_l, false) AS {s}_l" for s in _STAGES) + """,
  newest.status AS rs, newest.model_weight_digest AS bd FROM orders LEFT JOIN ff ON ff.session_id = o_orderkey::VARCHAR LEFT JOIN an ON an.session_id = o_orderkey::VARCHAR LEFT JOIN newest ON newest.session_id = o_orderkey::VARCHAR),
r AS (SELECT *, ms + mu + model_n > 0 AS mran, rs IS NOT NULL OR inference_n > 0 AS iran, coalesce(rs, CASE WHEN it1 THEN 'TAMPERED_OUTPUT' ELSE 'VERIFIED' END) AS st,
  CASE WHEN rs IS NULL THEN inference_n = 0 ELSE rs IN ('VERIFIED', 'VERIFIED_WITH_WARNING') END AS valid FROM j),
q AS (SELECT *, iran AND (it1 OR st = 'TAMPERED_OUTPUT') AS tampered, iran AND st = 'REPLAYED_RECORD' AS replayed, coalesce(md <> bd, false) AND iran AND mran AS mm FROM r),
stages AS (SELECT *, CASE WHEN NOT (dt OR dataset_n > 0) THEN 'NOT RUN' WHEN dataset_h THEN 'FAILED / TAMPERED' WHEN dataset_l THEN 'FINDINGS' ELSE 'VERIFIED' END AS dataset,
  CASE WHEN NOT mran THEN 'NOT RUN' WHEN model_h THEN 'FAILED / TAMPERED' WHEN model_l THEN 'FINDINGS' WHEN mu > 0 AND ms = 0 THEN 'UNSUPPORTED' WHEN mu > 0 THEN 'REVIEW' ELSE 'VERIFIED' END AS model,
  CASE WHEN NOT iran THEN 'NOT RUN' WHEN tampered OR replayed OR mm OR st = 'SUBSTITUTED_MODEL' OR inference_h THEN 'FAILED / TAMPERED' WHEN inference_l THEN 'FINDINGS' WHEN NOT valid THEN 'FAILED / TAMPERED' ELSE 'VERIFIED' END AS inference,
  CASE WHEN NOT (ds OR distribution_n > 0) THEN 'NOT RUN' WHEN ds4 OR distribution_h THEN 'FAILED / TAMPERED' WHEN distribution_l THEN 'REVIEW' ELSE 'VERIFIED' END AS distribution,
  CASE WHEN ev > 0 THEN 'VERIFIED' ELSE 'NOT RUN' END AS evidence, CASE WHEN chain THEN 'VERIFIED' ELSE 'FAILED / TAMPERED' END AS audit,
  CASE WHEN disposition IS NULL THEN 'NOT RUN' WHEN disposition = 'QUARANTINE' THEN 'FAILED / TAMPERED' WHEN disposition = 'REVIEW' THEN 'REVIEW' ELSE 'VERIFIED' END AS assurance FROM q),
lin AS (SELECT *, CASE WHEN 'FAILED / TAMPERED' IN (dataset, model, inference, distribution, audit, assurance) THEN 'FAILED / QUARANTINE'
  WHEN dataset = 'NOT RUN' AND model = 'NOT RUN' AND inference = 'NOT RUN' THEN 'INCOMPLETE / NOT VERIFIED'
  WHEN findings > 0 OR disposition = 'REVIEW' THEN 'FINDINGS / REVIEW' WHEN mu > 0 OR open_checks > 0 THEN 'LIMITED COVERAGE'
  WHEN dataset IN ('VERIFIED', 'NOT RUN') AND model IN ('VERIFIED', 'NOT RUN') AND inference IN ('VERIFIED', 'NOT RUN') THEN 'VERIFIED' ELSE 'INCOMPLETE / NOT VERIFIED' END AS overall FROM stages)"""


@query("lineage", f"WITH {LINEAGE} SELECT session_id, dataset, model, inference, distribution, evidence, audit, assurance, findings, mm AS model_mismatch, overall FROM lin")
def lineage(spark, sf):
    return lineage_rows(Tables(spark, sf)).select(
        "session_id", "dataset", "model", "inference", "distribution", "evidence", "audit", "assurance", "findings", "model_mismatch", "overall"
    )


@query("lineage_dependencies", f"""WITH {LINEAGE} SELECT source, target, count(*) FILTER (v) AS valid, count(*) AS sessions FROM (
SELECT 'DATASET' AS source, 'MODEL' AS target, dataset = 'VERIFIED' AND model <> 'FAILED / TAMPERED' AS v FROM lin
UNION ALL SELECT 'MODEL', 'INFERENCE', NOT mm AND inference <> 'FAILED / TAMPERED' FROM lin
UNION ALL SELECT 'INFERENCE', 'DISTRIBUTION', inference <> 'FAILED / TAMPERED' AND distribution <> 'FAILED / TAMPERED' FROM lin
UNION ALL SELECT 'DISTRIBUTION', 'EVIDENCE', evidence = 'VERIFIED' FROM lin UNION ALL SELECT 'EVIDENCE', 'AUDIT', chain FROM lin
UNION ALL SELECT 'AUDIT', 'ASSURANCE', assurance <> 'FAILED / TAMPERED' FROM lin) GROUP BY ALL""")
def lineage_dependencies(spark, sf):
    edges = L.lineage_dependencies(lineage_rows(Tables(spark, sf)))
    return edges.groupBy("source", "target").agg(F.count_if(F.col("is_valid")).alias("valid"), F.count(F.lit(1)).alias("sessions"))


@query("latest_provenance", f"WITH {PROVENANCE} SELECT session_id, record_id, status FROM newest")
def latest_provenance(spark, sf):
    return L.latest_provenance(provenance(Tables(spark, sf))).select("session_id", "record_id", "status")


@query("model_binding", f"""WITH {PROVENANCE}, s AS (SELECT o_orderkey::VARCHAR AS session_id, sha256((o_orderkey % 40)::VARCHAR) AS d FROM orders)
SELECT session_id, coalesce(d <> model_weight_digest, false) AS model_mismatch FROM s LEFT JOIN newest USING (session_id)""")
def model_binding(spark, sf):
    t = Tables(spark, sf)
    sessions = t("orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.upper(sha256((F.col("o_orderkey") % 40).cast("string"))).alias("model_digest"))
    return L.model_binding(sessions, L.latest_provenance(provenance(t))).select("session_id", "model_mismatch")


@query("merge_findings", f"WITH {FINDINGS_SQL} SELECT finding_id, severity FROM findings WHERE ord % 2 = 0 UNION ALL SELECT finding_id, 'LOW' FROM findings WHERE ord % 2 <> 0")
def merge_findings(spark, sf):
    rows = A.dedup_findings(findings(Tables(spark, sf))).select("finding_id", "ord", "severity")
    stored = rows.where(F.col("ord") % 2 == 0)
    return L.merge_findings(stored, rows.withColumn("severity", F.lit("LOW"))).select("finding_id", "severity")


@query("merge_section", f"""WITH {FINDINGS_SQL}, old AS (SELECT finding_id, session_id, threat_id, trim(category) AS category FROM findings), fresh AS (
  SELECT 'n' || finding_id AS finding_id, session_id, 'MT-9' AS threat_id, 'MODEL_INTEGRITY' AS category FROM findings WHERE ord % 10 = 0)
SELECT finding_id, threat_id FROM old WHERE session_id NOT IN (SELECT session_id FROM fresh) OR NOT (threat_id LIKE 'MT-%' OR upper(category) = 'MODEL_INTEGRITY')
UNION ALL SELECT finding_id, threat_id FROM fresh""")
def merge_section(spark, sf):
    old = A.dedup_findings(findings(Tables(spark, sf))).withColumn("category", F.trim("category"))
    fresh = old.where(F.col("ord") % 10 == 0).select(
        F.concat(F.lit("n"), "finding_id").alias("finding_id"), "session_id", F.lit("MT-9").alias("threat_id"), F.lit("MODEL_INTEGRITY").alias("category")
    )
    return L.merge_section(old.select("finding_id", "session_id", "threat_id", "category"), fresh, "model").select("finding_id", "threat_id")


@query("merge_durations", "SELECT l_orderkey AS session_id, count(*) * 1.5 AS duration_ms FROM lineitem GROUP BY l_orderkey")
def merge_durations(spark, sf):
    lines = Tables(spark, sf)("lineitem").select(F.col("l_orderkey").alias("session_id"), F.lit(1.5).alias("duration_ms"), "l_linenumber")
    odd = F.col("l_linenumber") % 2 == 1
    return L.merge_durations(lines.where(odd), lines.where(~odd))


@query("merge_analyses", "SELECT o_orderkey, array_to_string(list_distinct(['DT-1', 'MT-' || (o_custkey % 3)::VARCHAR, 'DT-' || (o_custkey % 2)::VARCHAR]).list_sort(), ',') AS merged FROM orders")
def merge_analyses(spark, sf):
    c = F.col("o_custkey")
    merged = L.merge_analyses(F.array(F.lit("DT-1"), F.concat(F.lit("MT-"), c % 3)), F.array(F.concat(F.lit("DT-"), c % 2)))
    return Tables(spark, sf)("orders").select("o_orderkey", F.array_join(F.array_sort(merged), ",").alias("merged"))
