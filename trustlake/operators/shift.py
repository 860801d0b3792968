"""The four shift dimensions and their roll-up into one report row per comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.constants import SHIFT_WEIGHTS
from trustlake.functions.numeric import clamp, fixed
from trustlake.functions.risk import calibrated_confidence, case_of
from trustlake.operators import twosample as TS
from trustlake.operators.scan import order_statistics

QUALITY_METRICS = ("luminance", "contrast", "sharpness")
COMMON = ("dimension", "detected", "metric", "p_value", "severity", "confidence", "n_ref", "n_eval")


def _sufficient(min_n: int) -> Column:
    return (F.col("n_ref") >= min_n) & (F.col("n_eval") >= min_n)


def _merge(by: Sequence[str], *parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(by)), parts)


def covariate_shift(
    features: DataFrame, by: Sequence[str], order: str, vector: str = "vec",
    threshold: float = 0.15, w1_threshold: float = 0.20, max_dims: int | None = None,
    ks_dims: int | None = None, alpha: float = 0.05, min_n: int = 15, gamma: float | None = None, sample: int | None = None,
) -> DataFrame:
    """DS-1 from ``by..., side, order, vector``: kernel MMD, mean Wasserstein-1 and KS rejections.

    All rows and dimensions count. ``max_dims`` limits the Wasserstein mean to the dimensions of the largest reference
    variance, ``ks_dims`` the tests to the first ones, ``sample`` the kernel to a systematic sample.
    """
    long = TS.explode_vectors(features, [*by, "side"], vector)
    scored = TS.per_dimension(long, by)  # one ECDF pass serves both statistics
    if max_dims is None:
        scored = scored.withColumn("_top", F.lit(True))
    else:
        chosen = TS.top_variance_dims(long, by, max_dims).select(*by, "dim", F.lit(True).alias("_top"))
        scored = scored.join(chosen, [*by, "dim"], "left")
    first = F.lit(True) if ks_dims is None else F.col("dim") < ks_dims
    stats = scored.groupBy(*by).agg(
        fixed(F.avg(F.when(F.col("_top"), F.col("w1"))), 6).alias("mean_w1"),
        fixed(F.count_if(first & (F.col("p_value") < alpha)) / F.count_if(first), 4).alias("ks_rejection_ratio"),
        fixed(F.median(F.when(first, F.col("p_value"))), 4).alias("p_value"),
    )
    return covariate_rows(_merge(by, TS.mmd_rbf(features, by, order, vector, gamma, sample), stats), by, threshold, w1_threshold, min_n)


def covariate_rows(joined: DataFrame, by: Sequence[str], threshold: float = 0.15, w1_threshold: float = 0.20, min_n: int = 15) -> DataFrame:
    """DS-1 from its figures ``n_ref, n_eval, mmd, mean_w1, ks_rejection_ratio, p_value``."""
    metric = fixed(F.lit(0.6) * F.col("mmd") + F.lit(0.4) * F.col("mean_w1"), 6)
    detected = (F.col("metric") > threshold) | (
        (F.col("mean_w1") > w1_threshold) & (F.col("ks_rejection_ratio") > 0.5)
    )
    return joined.withColumn("metric", metric).withColumn("detected", detected).select(
        *by, F.lit("covariate_shift").alias("dimension"), "detected", "metric", "p_value",
        F.when(F.col("metric") > 0.35, "HIGH").otherwise("MEDIUM").alias("severity"),
        calibrated_confidence(F.col("metric"), _sufficient(min_n), 0.60, 0.50, 1.0, 0.5).alias("confidence"),
        "n_ref", "n_eval", "mmd", "mean_w1", "ks_rejection_ratio",
    )


def semantic_shift(counts: DataFrame, by: Sequence[str], threshold: float = 0.25, min_n: int = 15) -> DataFrame:
    """DS-2 from aligned class counts. ``p_value`` is 1 - distance, not a probability."""
    return semantic_rows(TS.total_variation(counts, by).withColumnsRenamed({"total_ref": "n_ref", "total_eval": "n_eval"}), by, threshold, min_n)


def semantic_rows(tv: DataFrame, by: Sequence[str], threshold: float = 0.25, min_n: int = 15) -> DataFrame:
    """DS-2 from its figures ``n_ref, n_eval, tv, missing_classes, new_classes``."""
    high = (F.col("tv") > 0.5) | (F.col("missing_classes") > 2)
    return tv.select(
        *by, F.lit("semantic_shift").alias("dimension"),
        ((F.col("tv") > threshold) | (F.col("missing_classes") > 0)).alias("detected"),
        F.col("tv").alias("metric"), fixed(F.greatest(F.lit(0.0), 1 - F.col("tv")), 4).alias("p_value"),
        F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"),
        calibrated_confidence(F.col("tv"), _sufficient(min_n), 0.60, 0.50, 0.45, 0.3).alias("confidence"),
        "n_ref", "n_eval", "missing_classes", "new_classes",
    )


def environmental_shift(quality: DataFrame, by: Sequence[str], threshold: float = 0.20, min_n: int = 15) -> DataFrame:
    """DS-3 from ``by..., side`` and one column per quality metric."""
    names = F.array(*[F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("v")) for m in QUALITY_METRICS])
    long = quality.select(*by, "side", F.inline(names))
    return environmental_rows(TS.compare_samples(long, [*by, "metric_name"]), by, threshold, min_n)


def environmental_rows(scored: DataFrame, by: Sequence[str], threshold: float = 0.20, min_n: int = 15) -> DataFrame:
    """DS-3 from ``n_ref, n_eval, p_value, w1`` of each metric."""
    rows = scored.groupBy(*by).agg(
        fixed(F.avg("w1"), 6).alias("metric"), F.min("p_value").alias("p_value"),
        F.count_if(F.col("p_value") < 0.01).alias("significant"),
        F.max("n_ref").alias("n_ref"), F.max("n_eval").alias("n_eval"),
    )
    m = F.col("metric")
    detected = (m > threshold) | ((F.col("significant") >= 2) & (m > threshold * 0.75))
    return rows.select(
        *by, F.lit("environmental_drift").alias("dimension"), detected.alias("detected"), m, "p_value",
        F.lit("MEDIUM").alias("severity"),
        calibrated_confidence(m, _sufficient(min_n), 0.60, 0.50, 0.45, 0.3).alias("confidence"),
        "n_ref", "n_eval", "significant",
    )


def class_displacement(
    features: DataFrame, by: Sequence[str], label: str = "class_name", vector: str = "vec"
) -> DataFrame:
    """Euclidean distance between both sides' centroids for each class the sides share."""
    long = TS.explode_vectors(features, [*by, "side", label], vector)
    means = long.groupBy(*by, label, "dim").agg(
        F.avg(TS._on("ref", F.col("v"))).alias("m_ref"), F.avg(TS._on("eval", F.col("v"))).alias("m_eval")
    )
    gap = F.col("m_ref") - F.col("m_eval")
    rows = means.groupBy(*by, label).agg(F.sqrt(F.sum(gap * gap)).alias("displacement"))
    return rows.where(F.col("displacement").isNotNull())


def targeted_classes(displaced: DataFrame, by: Sequence[str], label: str = "class_name") -> DataFrame:
    """Classes moved by more than mean + 1.5 sample deviations."""
    limits = displaced.groupBy(*by).agg(
        (F.avg("displacement") + 1.5 * F.coalesce(F.stddev_samp("displacement"), F.lit(0.0))).alias("_limit")
    )
    return displaced.join(limits, list(by)).where("displacement > _limit").select(*by, label, "displacement")


def multi_class_rows(displaced: DataFrame, by: Sequence[str]) -> DataFrame:
    stats = displaced.groupBy(*by).agg(
        F.count(F.lit(1)).alias("classes"), F.avg("displacement").alias("mean_shift"),
        F.max("displacement").alias("max_shift"),
    )
    ratio = F.col("max_shift") / F.greatest(F.lit(1e-6), F.col("mean_shift"))
    score = fixed(clamp((F.col("concentration") - 1) * 0.4 + F.col("max_shift") * 0.6), 6)
    return stats.withColumn("concentration", ratio).withColumn("metric", score)


def spread_score(n: Column, moved: Column, q90: Column, q50: Column) -> Column:
    spread = q90 / F.greatest(F.lit(1e-6), q50)
    return F.when(n > 1, (spread - 1.2) * 0.3 + moved * 0.5).otherwise(moved)


def spread_shift(features: DataFrame, by: Sequence[str], vector: str = "vec") -> DataFrame:
    """Single-population form: centroid distance and q90/q50 spread of distances to the reference centroid."""
    long = TS.explode_vectors(features, [*by, "side"], vector)
    means = long.groupBy(*by, "dim").agg(
        F.avg(TS._on("ref", F.col("v"))).alias("m_ref"), F.avg(TS._on("eval", F.col("v"))).alias("m_eval")
    )
    gap = F.col("m_ref") - F.col("m_eval")
    centre = means.groupBy(*by).agg(
        F.sqrt(F.sum(gap * gap)).alias("global_shift"),
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "m_ref"))), lambda s: s["m_ref"]).alias("_centre"),
    )
    evaluation = features.where(F.col("side") == "eval").join(centre, list(by))
    away = F.sqrt(
        F.aggregate(
            F.zip_with(F.col(vector).cast("array<double>"), "_centre", lambda a, b: (a - b) * (a - b)),
            F.lit(0.0), lambda acc, x: acc + x,
        )
    )
    n = F.col("n")
    picks = order_statistics(
        evaluation.select(*by, away.alias("_away")), by, "_away",
        {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2), "q90": F.floor(n * 0.9)},
    )
    q50 = (F.col("_low") + F.col("_high")) / 2
    score = spread_score(n, F.col("global_shift"), F.col("q90"), q50)
    return centre.drop("_centre").join(picks, list(by)).select(
        *by, F.lit(1).alias("classes"), F.col("global_shift").alias("mean_shift"), F.col("global_shift").alias("max_shift"),
        F.lit(1.0).alias("concentration"), fixed(clamp(score), 6).alias("metric"),
    )


def subpopulation_shift(
    features: DataFrame, by: Sequence[str], label: str = "class_name", vector: str = "vec",
    threshold: float = 0.25, min_n: int = 15,
) -> DataFrame:
    """DS-4: targeted class displacement, or the spread form where fewer than two classes are shared."""
    named = features.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit("default_class")))
    sizes = named.groupBy(*by).agg(
        F.count_if(F.col("side") == "ref").alias("n_ref"), F.count_if(F.col("side") == "eval").alias("n_eval")
    )
    multi = multi_class_rows(class_displacement(named, by, label, vector), by).where("classes > 1")
    single = spread_shift(named.join(multi, list(by), "left_anti"), by, vector)
    columns = [*by, "classes", "mean_shift", "max_shift", "concentration", "metric"]
    rows = multi.select(*columns).union(single.select(*columns)).join(sizes, list(by))
    return subpopulation_rows(rows, by, threshold, min_n)


def subpopulation_rows(rows: DataFrame, by: Sequence[str], threshold: float = 0.25, min_n: int = 15) -> DataFrame:
    """DS-4 from its figures ``n_ref, n_eval, classes, mean_shift, max_shift, concentration, metric``."""
    m = F.col("metric")
    detected = (m > threshold) & ((F.col("max_shift") > 0.10) | (F.col("concentration") >= 1.8))
    return rows.select(
        *by, F.lit("adversarial_manipulation").alias("dimension"), detected.alias("detected"), m,
        fixed(F.greatest(F.lit(0.0), 1 - m), 4).alias("p_value"), F.lit("HIGH").alias("severity"),
        calibrated_confidence(m, _sufficient(min_n), 0.65, 0.55, 0.40, 0.25).alias("confidence"),
        "n_ref", "n_eval", "classes", "mean_shift", "max_shift", "concentration",
    )


def shift_report(dimensions: DataFrame, sizes: DataFrame, by: Sequence[str], min_n: int = 15) -> DataFrame:
    """Overall distance, characterisation and both likelihoods from long dimension rows and ``n_ref, n_eval``."""
    weight = case_of(F.col("dimension"), SHIFT_WEIGHTS, 0.0)
    value = lambda d: F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("metric"))), F.lit(0.0))
    flag = lambda d: F.coalesce(F.bool_or((F.col("dimension") == d) & F.col("detected")), F.lit(False))
    rolled = dimensions.groupBy(*by).agg(
        fixed(F.sum(weight * F.col("metric")), 6).alias("overall_distance"),
        F.bool_or("detected").alias("shift_detected"),
        *[value(d).alias(f"_d_{d}") for d in SHIFT_WEIGHTS], *[flag(d).alias(f"_f_{d}") for d in SHIFT_WEIGHTS],
    )
    cov, env, manip = F.col("_d_covariate_shift"), F.col("_d_environmental_drift"), F.col("_d_adversarial_manipulation")
    overall = F.col("overall_distance")
    within = lambda x, low, high: fixed(F.least(F.lit(high), F.greatest(F.lit(low), x)), 4)
    cases = [
        (~_sufficient(min_n), "INSUFFICIENT_SAMPLES", within(overall * 0.5, 0.05, 0.35), within(manip * 0.5, 0.05, 0.35)),
        (F.col("_f_adversarial_manipulation") & (manip > 0.25), "SUSPICIOUS_MANIPULATION",
         fixed(F.greatest(F.lit(0.05), F.lit(0.35) - manip * 0.30), 4), within(F.lit(0.5) + manip * 0.5, 0.65, 0.95)),
        (F.col("_f_environmental_drift") & (env > 0.15), "NATURAL_ENVIRONMENTAL_DRIFT",
         within(F.lit(0.5) + env * 0.45, 0.65, 0.95), within(manip * 0.30, 0.05, 0.25)),
        (~F.col("_f_covariate_shift") & (overall < 0.10), "NO_SIGNIFICANT_SHIFT", F.lit(0.05), F.lit(0.05)),
        (F.col("_f_covariate_shift"), "COVARIATE_DOMAIN_SHIFT",
         within(cov * 0.7, 0.20, 0.80), within(manip * 0.5, 0.05, 0.40)),
        (F.lit(True), "INDETERMINATE_SHIFT", within(overall, 0.10, 0.50), within(manip, 0.10, 0.50)),
    ]
    name = natural = suspicious = None
    for test, label, nat, sus in cases:
        name = F.when(test, label) if name is None else name.when(test, label)
        natural = F.when(test, nat) if natural is None else natural.when(test, nat)
        suspicious = F.when(test, sus) if suspicious is None else suspicious.when(test, sus)
    return rolled.join(sizes, list(by)).select(
        *by, "n_ref", "n_eval", "overall_distance", "shift_detected", name.alias("characterization"),
        natural.alias("natural_drift_likelihood"), suspicious.alias("suspicious_manipulation_likelihood"),
        _sufficient(min_n).alias("evidence_sufficient"),
    )
