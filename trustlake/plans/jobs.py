"""The jobs users call: dataset scan, shift analysis, model comparison, assessment, store audit, lineage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.functions.binary import byte_features, dhash, edge_residual
from trustlake.functions.numeric import fixed
from trustlake.operators import assurance as A
from trustlake.operators import centroids as C
from trustlake.operators import chain as CH
from trustlake.operators import contributors as R
from trustlake.operators import duplicates as D
from trustlake.operators import evidence as E
from trustlake.operators import ingest as I
from trustlake.operators import lineage as L
from trustlake.operators import neighbours as N
from trustlake.operators import shift as S
from trustlake.operators import twosample as TS
from trustlake.operators.records import verify_records  # noqa: F401  (job B4 is the operator itself)
from trustlake.plans.checks import FINDING_COLUMNS, Check, Staged, Tables, evidence_rows, finding_rows, once, run_checks
from trustlake.plans.compare import compare_model_pairs
from trustlake.session import cut_lineage

DATA = "DATA_INTEGRITY"
KEY = "dataset_id"
lit = F.lit


def byte_signals(images: DataFrame, extractor: Callable[[Column], Column] = byte_features) -> DataFrame:
    """Everything the data checks need from image bytes, in one pass that leaves the bytes behind.

    Input ``dataset_id, image_id, ord, content``; ``ord`` is a unique integer. ``extractor`` is a column function
    from bytes to a vector, by default the statistical features.
    """
    content = F.col("content")
    return images.select(
        KEY, "image_id", "ord", F.sha2(content, 256).alias("file_hash"), dhash(content).alias("dhash"), edge_residual(content).alias("edge"),
        extractor(content).alias("vec"),
    )


def _ratio_confidence(base: float, slope: float, top: float) -> Column:
    return F.least(lit(top), lit(base) + F.col("ratio") * slope)


# Titles, severities and confidence limits of the findings below.
def _exact(t: Tables) -> DataFrame:
    rows = D.duplicate_summary(t["signals"], [KEY]).where("clusters > 0")
    return finding_rows(rows, KEY, "DT-4", DATA, lit("HIGH"), lit(1.0), lit("QUARANTINE"), lit("Exact Duplicate Images Detected"),
                        {"clusters": F.col("clusters"), "files": F.col("files"), "ratio": F.col("ratio")})


def _near(t: Tables) -> DataFrame:
    narrow = t["signals"].select(KEY, "image_id", "file_hash", "dhash")
    found = once(t, "near", lambda: D.near_duplicate_clusters(narrow, [KEY]))
    rows = D.near_duplicate_summary(found, narrow, [KEY]).where("clusters > 0")
    return finding_rows(rows, KEY, "DT-4", DATA, lit("MEDIUM"), lit(0.85), lit("REVIEW"), lit("Perceptual Near-Duplicate Images Detected"),
                        {"clusters": F.col("clusters"), "files": F.col("files"), "ratio": F.col("ratio")})


def _trigger(t: Tables, threshold: float = 0.55) -> DataFrame:
    hit = F.col("edge.score") >= threshold
    rows = t["signals"].groupBy(KEY).agg(
        F.count_if(hit).alias("n"), F.count(lit(1)).alias("images"), F.avg(F.when(hit, F.round("edge.score", 3))).alias("mean")
    ).where("n > 0").withColumn("ratio", F.col("n") / F.col("images"))
    return finding_rows(rows, KEY, "DT-1", DATA, F.when(F.col("n") >= 3, "CRITICAL").otherwise("HIGH"), _ratio_confidence(0.65, 0.4, 0.92),
                        lit("QUARANTINE"), lit("Potential Backdoor Trigger Injections"),
                        {"samples": F.col("n"), "ratio": F.col("ratio"), "mean_score": F.round("mean", 3)})


def _labelled(t: Tables, default: int | None = None) -> DataFrame:
    return N.labelled(t["signals"], N.primary_label(t["annotations"]), default=default)


def _flips(t: Tables, k: int = 5, threshold: float = 0.8) -> DataFrame:
    rows = _labelled(t)
    sizes = rows.groupBy(KEY).agg(F.count(lit(1)).alias("samples")).where(F.col("samples") > k)
    found = N.nearest(rows.join(sizes.select(KEY), KEY, "left_semi"), k, by=[KEY])
    flipped = once(t, "flipped", lambda: N.label_disagreement(found, k, threshold))
    rows = flipped.groupBy(KEY).agg(F.count(lit(1)).alias("n")).join(sizes, KEY).withColumn("ratio", F.col("n") / F.col("samples"))
    return finding_rows(rows, KEY, "DT-2", DATA, F.when(F.col("ratio") > 0.05, "HIGH").otherwise("MEDIUM"), _ratio_confidence(0.70, 0.5, 0.95),
                        lit("REVIEW"), lit("Potential Label Inconsistencies Detected"), {"samples": F.col("n"), "ratio": F.col("ratio")})


def _confusion(t: Tables) -> DataFrame:
    pairs = C.asymmetric_confusion(_labelled(t), [KEY]).groupBy(KEY).agg(F.count(lit(1)).alias("pairs"), F.max("asymmetry").alias("asymmetry"))
    return finding_rows(pairs, KEY, "DT-3", DATA, lit("HIGH"), lit(0.82), lit("REVIEW"), lit("Asymmetric Systematic Mislabelling Pattern"),
                        {"pairs": F.col("pairs"), "max_asymmetry": F.col("asymmetry")})


def _outliers(t: Tables, sigma: float = 3.0) -> DataFrame:
    images = t["signals"].groupBy(KEY).agg(F.count(lit(1)).alias("images"))
    found = once(t, "outliers", lambda: C.class_outliers(_labelled(t, 0), sigma, by=[KEY]))
    rows = found.groupBy(KEY).agg(F.count(lit(1)).alias("n"), F.max("score").alias("top"))
    rows = rows.join(images, KEY).withColumn("ratio", F.col("n") / F.col("images"))
    return finding_rows(rows, KEY, "DT-5", DATA, lit("MEDIUM"), _ratio_confidence(0.60, 0.4, 0.85), lit("REVIEW"),
                        lit("Potential Out-of-Distribution Samples"), {"samples": F.col("n"), "ratio": F.col("ratio"), "max_score": F.round("top", 3)})


DATA_CHECKS = (
    Check("DT-4", ("signals",), lambda t: _exact(t).unionByName(_near(t))), Check("DT-1", ("signals",), _trigger),
    Check("DT-2", ("signals", "annotations"), _flips), Check("DT-3", ("signals", "annotations"), _confusion), Check("DT-5", ("signals", "annotations"), _outliers),
)


def _samples(t: Staged, threshold: float = 0.55) -> DataFrame:
    """``dataset_id, image_id, threat_id, title, cluster, score``: what the findings of the run are about."""
    signals = t["signals"]
    none = lit(None)

    def rows(df: DataFrame, threat: str, title: str, cluster: Column = none, score: Column = none) -> DataFrame:
        return df.select(KEY, F.col("image_id").cast("string").alias("image_id"), lit(threat).alias("threat_id"), lit(title).alias("title"),
                         cluster.cast("string").alias("cluster"), score.cast("double").alias("score"))

    shared = D.exact_duplicates(signals.select(KEY, "file_hash"), [KEY])
    parts = [
        rows(signals.join(shared, [KEY, "file_hash"], "left_semi"), "DT-4", "Exact Duplicate Images Detected", F.col("file_hash")),
        rows(signals.where(F.col("edge.score") >= threshold), "DT-1", "Potential Backdoor Trigger Injections", score=F.col("edge.score")),
    ]
    if "near" in t:
        parts.append(rows(t["near"], "DT-4", "Perceptual Near-Duplicate Images Detected", F.col("cluster")))
    if "flipped" in t:
        parts.append(rows(t["flipped"], "DT-2", "Potential Label Inconsistencies Detected", F.col("consensus"), F.col("disagreement")))
    if "outliers" in t:
        parts.append(rows(t["outliers"], "DT-5", "Potential Out-of-Distribution Samples", score=F.col("score")))
    return reduce(DataFrame.unionByName, parts)


def scan_datasets(images: DataFrame, annotations: DataFrame, classes: DataFrame, datasets: DataFrame, *args, **options) -> tuple[DataFrame, DataFrame]:
    """Findings and coverage of every dataset; arguments as for :func:`scan_with_samples`."""
    return scan_with_samples(images, annotations, classes, datasets, *args, **options)[:2]


def scan_with_samples(
    images: DataFrame, annotations: DataFrame, classes: DataFrame, datasets: DataFrame, requested: Sequence[str] | None = None,
    extractor: Callable[[Column], Column] = byte_features, checks: Sequence[Check] = DATA_CHECKS, contributors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Findings, coverage, the samples of each finding and its evidence rows. Bytes are read once; checks work on stored signals.

    ``images(dataset_id, image_id, ord, content)``; ``datasets(dataset_id, contributor_id, batch_id)``. Samples are rows
    ``finding_id, dataset_id, image_id, cluster, score``, whole whatever their number. With ``contributors(dataset_id,
    image_id, contributor_id, batch_id)`` a finding counts for those whose images it is about, and a finding without
    samples for all of the dataset; else for the contributors that ``datasets`` names.
    """
    signals = cut_lineage(byte_signals(images, extractor))
    sizes = signals.groupBy(KEY).agg(F.count(lit(1)).alias("images")).join(
        classes.groupBy(KEY).agg(F.count_distinct("class_id").alias("classes")), KEY, "left"
    ).fillna(0, ["classes"])
    coverage = I.coverage(sizes, requested)
    tables = Staged(signals=signals, annotations=annotations, classes=classes)
    found, _ = run_checks(checks, tables, requested)
    ready = coverage.where("state = 'executed'").select(F.col(KEY).cast("string").alias("asset_id"), F.col("analysis_id").alias("threat_id"))
    findings = cut_lineage(found.join(ready, ["asset_id", "threat_id"], "left_semi").select(*FINDING_COLUMNS))
    coverage = coverage.withColumn("session_id", F.col(KEY).cast("string"))
    named = findings.select("finding_id", "asset_id", "threat_id", "title")
    samples = _samples(tables).withColumn("asset_id", F.col(KEY).cast("string")).join(named, ["asset_id", "threat_id", "title"])
    samples = samples.select("finding_id", KEY, "image_id", "cluster", "score")
    if requested and not {"DT-6", "AUTO"} & set(requested):
        return findings, coverage, samples, evidence_rows(findings)
    who = ["contributor_id", "batch_id"]
    if contributors is None:
        owners = datasets.select(F.col(KEY).cast("string").alias("asset_id"), *who)
        owned = findings.join(owners, "asset_id")
        pictures = sizes.select(F.col(KEY).cast("string").alias("asset_id"), "images").join(owners, "asset_id")
    else:
        owners = contributors.select(F.col(KEY).cast("string").alias("asset_id"), F.col("image_id").cast("string").alias("image_id"), *who)
        samples = cut_lineage(samples)
        touched = samples.select("finding_id", F.col(KEY).cast("string").alias("asset_id"), "image_id").join(owners, ["asset_id", "image_id"])
        about = touched.select("finding_id", *who).distinct()
        general = findings.join(samples.select("finding_id").distinct(), "finding_id", "left_anti")
        owned = findings.join(about, "finding_id").unionByName(general.join(owners.select("asset_id", *who).distinct(), "asset_id"))
        pictures = owners.groupBy("asset_id", *who).agg(F.count(lit(1)).alias("images"))
    pictures = pictures.groupBy("asset_id", *who).agg(F.sum("images").alias("images"))
    findings = findings.unionByName(_contributor(owned, pictures))
    return findings, coverage, samples, evidence_rows(findings)


def _contributor(owned: DataFrame, pictures: DataFrame) -> DataFrame:
    filled = lambda df: df.withColumn("batch_id", F.coalesce("batch_id", lit("default")))
    by = ("contributor_id", "batch_id", "asset_id")
    rows = R.contributor_risk(filled(owned), filled(pictures), by)
    title = F.format_string("Contributor Risk Profile: %s (Risk Score: %.2f)", F.col("contributor_id"), F.col("risk"))
    return finding_rows(rows, "asset_id", "DT-6", DATA, F.col("severity"), lit(0.85), F.col("recommended_disposition"), title,
                        {"risk": fixed(F.col("risk"), 3), "issues": F.col("issues"), "images": F.col("images")})


def analyze_shift(
    features: DataFrame, class_samples: DataFrame, quality: DataFrame, by: Sequence[str], order: str = "ord", label: str = "class_name", min_n: int = 15,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dimension rows, report rows and findings of every comparison ``by``.

    ``features(by..., side, order, label, vec)``; ``class_samples(by..., side, label)`` has one row per annotation;
    ``quality(by..., side, luminance, contrast, sharpness)``.
    """
    keys = list(by)
    features = cut_lineage(features)
    parts = [
        S.covariate_shift(features, keys, order, min_n=min_n), S.semantic_shift(TS.align_class_counts(class_samples, keys, label), keys, min_n=min_n),
        S.environmental_shift(quality, keys, min_n=min_n), S.subpopulation_shift(features, keys, label, min_n=min_n),
    ]
    rows = cut_lineage(reduce(DataFrame.unionByName, [p.select(*keys, *S.COMMON) for p in parts]))
    sizes = features.groupBy(*keys).agg(F.count_if(F.col("side") == "ref").alias("n_ref"), F.count_if(F.col("side") == "eval").alias("n_eval"))
    report = S.shift_report(rows, sizes, keys, min_n)
    threat = {"covariate_shift": "DS-1", "semantic_shift": "DS-2", "environmental_drift": "DS-3", "adversarial_manipulation": "DS-4"}
    named = rows.where("detected").withColumn("_asset", F.concat_ws("|", *keys))
    found = reduce(DataFrame.unionByName, [
        finding_rows(named.where(F.col("dimension") == d), "_asset", t, "DISTRIBUTION_SHIFT", F.col("severity"), F.col("confidence"), lit("REVIEW"),
                     lit(f"{d} detected"), {"metric": F.col("metric"), "p_value": F.col("p_value")})
        for d, t in threat.items()
    ])
    return rows, report, found


def predict(inputs: DataFrame, model: Callable, schema: str) -> DataFrame:
    """Batch prediction with the caller's ``mapInPandas`` function."""
    return inputs.mapInPandas(model, schema)


def compare_models(tables: Tables, candidate: str, reference: str, asset_id: str = "model") -> DataFrame:
    """Findings of one candidate against one reference; :func:`compare_model_pairs` tells which tables count.

    ``scores`` may lack ``model_id``: they are the candidate's then.
    """
    pairs = next(iter(tables.values())).sparkSession.createDataFrame([(asset_id, candidate, reference)], "asset_id string, candidate string, reference string")
    if "scores" in tables and "model_id" not in tables["scores"].columns:
        tables = {**tables, "scores": tables["scores"].withColumn("model_id", lit(candidate))}
    return compare_model_pairs(tables, pairs)


def assess(findings: DataFrame, coverage: DataFrame, policy: A.AssurancePolicy = A.DEFAULT_POLICY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts, contributing findings and narratives of every session."""
    valid, _ = A.validate_findings(findings)
    scored = cut_lineage(A.score_findings(A.dedup_findings(valid), policy))
    rows = cut_lineage(A.verdicts(valid, coverage, policy=policy))
    return rows, A.contributing_findings(scored), A.narrative(rows, scored)


def verify_audit_chain(log: DataFrame, **options) -> DataFrame:
    """Chain verification of raw events, hashes recomputed."""
    return CH.verify_chain(CH.row_hashes(log), dense=False, **options)


def audit_evidence_store(catalogue: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every path's state and the tally per kind."""
    rows = E.reconcile(catalogue, files)
    return rows, E.consistency(rows)


def trace_lineage(**tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stage statuses and dependency edges of every session."""
    rows = cut_lineage(L.lineage(**tables))
    return rows, L.lineage_dependencies(rows)


__all__ = [
    "analyze_shift", "assess", "audit_evidence_store", "byte_signals", "compare_model_pairs", "compare_models", "predict", "scan_datasets", "scan_with_samples", "trace_lineage", "verify_audit_chain", "verify_records",
]
