"""Model comparison for any number of (candidate, reference) pairs in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.operators import models as M
from trustlake.plans.checks import Check, Tables, finding_rows, run_checks
from trustlake.session import cut_lineage

ASSET = "asset_id"
lit = F.lit


def _row(df: DataFrame, threat: str, severity: str, confidence: Column, advice: str, title: Column | str, metrics: dict[str, Column]) -> DataFrame:
    title = lit(title) if isinstance(title, str) else title
    return finding_rows(df, ASSET, threat, "MODEL_INTEGRITY", lit(severity), confidence, lit(advice), title, metrics)


def _side(rows: DataFrame, pairs: DataFrame, which: str) -> DataFrame:
    """Rows of the pairs' candidates or references under ``asset_id``; a model in several pairs serves each of them."""
    return rows.join(pairs.select(ASSET, F.col(which).alias("model_id")), "model_id").drop("model_id")


def classification_behaviour(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``asset_id, distance`` from top-k predictions."""
    p = M.class_probabilities(predictions)
    return M.classification_distance(_side(p, pairs, "candidate"), _side(p, pairs, "reference"), [ASSET]).select(ASSET, "distance")


def detection_behaviour(detections: DataFrame, pairs: DataFrame) -> DataFrame:
    """``asset_id, distance`` and its parts from ``model_id, probe_id, detections``; every probe either model saw counts."""
    by = (ASSET, "probe_id")
    probes = reduce(DataFrame.union, [_side(detections.select("model_id", "probe_id"), pairs, w) for w in ("candidate", "reference")])
    boxes = M.explode_detections(detections)
    cand, ref = (cut_lineage(_side(boxes, pairs, w)) for w in ("candidate", "reference"))
    metrics = M.match_metrics(M.match_boxes(cand, ref, by=by), cand, ref, probes.select(*by), by)
    return M.detection_distance(metrics, M.class_counts_pair(cand, ref, [ASSET]), by=[ASSET])


def perturbed_drops(detections: DataFrame, probes: DataFrame, pairs: DataFrame) -> DataFrame:
    """First class per candidate whose detections vanish on perturbed probes while the others stay.

    ``probes(probe_id, perturbed)``. Counts of clean probes are scaled to the number of perturbed ones; detections of
    any confidence count. Candidates without a clean or without a perturbed probe have no row.
    """
    seen = _side(detections.select("model_id", "probe_id", "detections"), pairs.select(ASSET, "candidate").distinct(), "candidate")
    seen = seen.join(probes.select("probe_id", "perturbed").where("perturbed IS NOT NULL"), "probe_id")
    sizes = seen.select(ASSET, "probe_id", "perturbed").distinct().groupBy(ASSET).agg(
        (F.count_if(F.col("perturbed")) / F.nullif(F.count_if(~F.col("perturbed")), lit(0))).alias("_scale")
    )
    kinds = seen.select(ASSET, "perturbed", F.explode("detections.class_id").alias("class_id")).where("class_id >= 0")
    counts = kinds.groupBy(ASSET, "class_id").agg(F.count_if(~F.col("perturbed")).alias("c_ref"), F.count_if(F.col("perturbed")).alias("c_cand"))
    return M.selective_drop(counts.join(sizes, ASSET), [ASSET], scale=F.col("_scale"))


def compare_model_pairs(tables: Tables, pairs: DataFrame) -> DataFrame:
    """Findings of every ``asset_id, candidate, reference`` row of ``pairs``, from whichever tables are present.

    ``models(model_id, digest)``: weight digests. ``weights(model_id, layer, value)``, ``activations(model_id, probe_id,
    layer, neuron, value)``, ``predictions(model_id, probe_id, top_k)``, ``detections(model_id, probe_id, detections)`` with
    one row per probe, empty ones too, ``probes(probe_id, perturbed)`` and ``scores(model_id, name, score)``: the size of
    the trigger found for each class. Per-model figures are computed once and joined to the pairs that use the model.
    """
    d = F.col("distance")
    one = F.count(lit(1))
    behaviours = [n for n in ("predictions", "detections") if n in tables]
    parts = {"predictions": classification_behaviour, "detections": detection_behaviour}
    behaviour = None
    if behaviours:
        found = reduce(DataFrame.unionByName, [parts[n](tables[n], pairs).select(ASSET, "distance") for n in behaviours])
        behaviour = found.groupBy(ASSET).agg(F.max("distance").alias("distance"))
        if "models" in tables:
            digest = lambda which: _side(tables["models"].select("model_id", F.col("digest").alias(which)), pairs, which)
            known = digest("candidate").join(digest("reference"), ASSET).select(ASSET, (F.col("candidate") == F.col("reference")).alias("_same"))
            behaviour = behaviour.join(known, ASSET, "left")
        else:
            behaviour = behaviour.withColumn("_same", lit(False))
        behaviour = cut_lineage(behaviour.withColumn("_same", F.coalesce("_same", lit(False))))

    def identity(_: Tables) -> DataFrame:
        verified = behaviour.where(M.substitution_verdict(d, F.col("_same")) == "IDENTICAL")
        return _row(verified, "MT-1", "INFORMATIONAL", lit(0.99), "ACCEPT", "Model Identity Verified", {"distance": d})

    def substitution(_: Tables) -> DataFrame:
        hit = behaviour.where(M.substitution_verdict(d, F.col("_same")) == "SUBSTITUTED")
        return _row(hit, "MT-1", "HIGH", F.least(lit(0.95), 0.70 + (d - 0.25) * 0.5), "QUARANTINE", "Potential Model Substitution", {"distance": d})

    def drift(_: Tables) -> DataFrame:
        return _row(behaviour.where(M.drift_verdict(d)), "MT-2", "MEDIUM", lit(0.75), "REVIEW", "Behavioral Drift Detected", {"distance": d})

    def layers(t: Tables) -> DataFrame:
        stats = M.layer_stats(t["weights"])
        compared = M.compare_layers(_side(stats, pairs, "candidate"), _side(stats, pairs, "reference"), [ASSET, "layer"])
        # A pair whose candidate shows no weights at all is not comparable, which is not the same as missing every layer.
        changed = M.modified_layers(compared.join(_side(stats, pairs, "candidate").select(ASSET).distinct(), ASSET, "left_semi"))
        total = changed.groupBy(ASSET).agg(one.alias("layers"), F.coalesce(F.max("relative_l2"), lit(0.0)).alias("top"))
        return _row(total, "MT-2", "MEDIUM", F.least(lit(0.90), 0.65 + F.col("top")), "REVIEW", "Model Parameter Modification Detected",
                    {"layers": F.col("layers"), "max_l2": F.col("top")})

    def sparse(t: Tables) -> DataFrame:
        rows = _side(M.dead_layers(M.layer_stats(t["weights"])), pairs, "candidate").groupBy(ASSET).agg(one.alias("layers"), F.max("sparsity").alias("top"))
        return _row(rows, "MT-2", "LOW", lit(0.60), "REVIEW", "Anomalous Parameter Sparsity Observed", {"layers": F.col("layers"), "max_sparsity": F.col("top")})

    def dead(t: Tables) -> DataFrame:
        rows = _side(M.dead_neurons(t["activations"]).where("flagged"), pairs, "candidate")
        rows = rows.groupBy(ASSET).agg(one.alias("layers"), F.max("dead_ratio").alias("top"))
        return _row(rows, "MT-4", "MEDIUM", lit(0.80), "REVIEW", "Elevated Dead Neuron Ratio", {"layers": F.col("layers"), "max_ratio": F.col("top")})

    def diverged(t: Tables) -> DataFrame:
        sides = [_side(t["activations"], pairs, w) for w in ("candidate", "reference")]
        rows = M.activation_similarity(*sides, by=[ASSET]).where("divergent")
        rows = rows.groupBy(ASSET).agg(one.alias("layers"), F.min("similarity").alias("low"))
        return _row(rows, "MT-4", "HIGH", lit(0.85), "QUARANTINE", "Intermediate Representation Divergence", {"layers": F.col("layers"), "min_similarity": F.col("low")})

    def evasion(t: Tables) -> DataFrame:
        title = F.format_string("Evasion Backdoor Behavior Detected (Class: %s)", F.col("class_id").cast("string"))
        return _row(perturbed_drops(t["detections"], t["probes"], pairs), "MT-3", "HIGH", lit(0.88), "QUARANTINE", title,
                    {"drop": F.col("drop"), "clean_count": F.col("c_ref"), "perturbed_count": F.col("c_cand")})

    def trojan(t: Tables) -> DataFrame:
        rows = M.mad_outlier(_side(t["scores"], pairs.select(ASSET, "candidate").distinct(), "candidate"), [ASSET])
        index = F.col("anomaly_index")
        hit = _row(rows.where("flagged"), "MT-3", "HIGH", F.least(lit(0.95), 0.70 + (index - 2.0) * 0.05), "QUARANTINE",
                   "Anomalous Trigger Reconstruction Pattern", {"anomaly_index": index})
        few = rows.where("status = 'INSUFFICIENT_EVIDENCE'")
        return hit.unionByName(_row(few, "MT-3", "INFORMATIONAL", lit(1.0), "ACCEPT", "Insufficient Evidence for Backdoor Anomaly Detection", {"classes": F.col("n")}))

    behaves = tuple(behaviours) or ("predictions",)
    checks = [
        Check("MT-1", (*behaves, "models"), identity), Check("MT-1", behaves, substitution), Check("MT-2", behaves, drift),
        Check("MT-2", ("weights",), layers), Check("MT-2", ("weights",), sparse), Check("MT-4", ("activations",), dead),
        Check("MT-4", ("activations",), diverged), Check("MT-3", ("detections", "probes"), evasion), Check("MT-3", ("scores",), trojan),
    ]
    found, _ = run_checks(checks, tables)
    return found
