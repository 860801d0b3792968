"""Two-sample statistics: ECDF, Kolmogorov-Smirnov, Wasserstein-1, kernel MMD, total variation.

Samples are long: ``by...``, ``side`` ('ref' or 'eval') and a value ``v``. Every statistic is grouped, so one
job compares any number of populations, dimensions or metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.functions.numeric import clamp, finite, fixed, kolmogorov_p
from trustlake.session import cut_lineage
from trustlake.functions.vectors import squared_distance
from trustlake.operators.scan import _BUCKET, WIDTH, equi_depth_buckets, exact_median, join_buckets, with_previous, with_rank


def explode_vectors(features: DataFrame, keep: Sequence[str], vector: str = "vec") -> DataFrame:
    """Long form ``keep..., dim, v`` of a vector column; dims count from zero."""
    return features.select(*keep, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def _on(side: str, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def support(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Union of both supports with multiplicities; the pre-aggregation that keeps a repeated value to one row."""
    return (
        samples.select(*by, "side", finite(F.col("v"), "sample").alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(*by, "v")
        .agg(F.count(_on("ref", F.col("v"))).alias("c_ref"), F.count(_on("eval", F.col("v"))).alias("c_eval"))
    )


def ecdf(samples: DataFrame, by: Sequence[str], side: int = 32, rows_per_bucket: int = WIDTH) -> DataFrame:
    """Both empirical distribution functions at every support point, with the next point.

    Output: ``by..., v, next_v, n_ref, n_eval, f_ref, f_eval``. Cumulative counts are carried over equi-depth
    buckets, so one huge group does not have to be sorted by a single task. The pre-aggregated support is read
    several times and is materialised once.
    """
    rows = equi_depth_buckets(cut_lineage(support(samples, by)), by, "v", side, rows_per_bucket)
    inside = W.partitionBy(*by, _BUCKET).orderBy("v")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = rows.groupBy(*by, _BUCKET).agg(
        F.sum("c_ref").alias("_t_ref"), F.sum("c_eval").alias("_t_eval"), F.min("v").alias("_first")
    )
    across = W.partitionBy(*by).orderBy(_BUCKET)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    carried = totals.select(
        *by, _BUCKET,
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_c_{s}") for s in ("ref", "eval")],
        *[F.sum(f"_t_{s}").over(whole).alias(f"n_{s}") for s in ("ref", "eval")],
        F.lead("_first").over(across).alias("_next"),
    )
    rows = rows.select(
        *by, "v", _BUCKET, F.lead("v").over(inside).alias("_lead"),
        *[F.sum(f"c_{s}").over(upto).alias(f"_i_{s}") for s in ("ref", "eval")],
    )
    return join_buckets(rows, carried, by).select(
        *by, "v", F.coalesce("_lead", "_next").alias("next_v"), "n_ref", "n_eval",
        *[F.try_divide(F.col(f"_c_{s}") + F.col(f"_i_{s}"), F.col(f"n_{s}")).alias(f"f_{s}") for s in ("ref", "eval")],
    )


def _both(value: Column, otherwise: float) -> Column:
    return F.when((F.max("n_ref") > 0) & (F.max("n_eval") > 0), value).otherwise(F.lit(otherwise))


def compare_samples(samples: DataFrame, by: Sequence[str], side: int = 32, rows_per_bucket: int = WIDTH) -> DataFrame:
    """KS statistic, KS p-value and Wasserstein-1 of each group in one pass over the ECDF."""
    gap = F.abs(F.col("f_ref") - F.col("f_eval"))
    stats = ecdf(samples, by, side, rows_per_bucket).groupBy(*by).agg(
        F.max("n_ref").alias("n_ref"), F.max("n_eval").alias("n_eval"),
        _both(F.max(gap), 0.0).alias("_d"),
        _both(F.coalesce(F.sum(gap * (F.col("next_v") - F.col("v"))), F.lit(0.0)), 0.0).alias("_w"),
    )
    return stats.select(
        *by, "n_ref", "n_eval", fixed(F.col("_d"), 6).alias("ks"),
        fixed(kolmogorov_p(F.col("_d"), F.col("n_ref"), F.col("n_eval")), 6).alias("p_value"),
        fixed(F.col("_w"), 8).alias("w1"),
    )


def ks_two_sample(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return compare_samples(samples, by).select(*by, "n_ref", "n_eval", "ks", "p_value")


def wasserstein_1d(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return compare_samples(samples, by).select(*by, "n_ref", "n_eval", "w1")


def dimension_variance(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sample variance of the reference side per (group, dim); a single row counts as zero."""
    ref = samples.where(F.col("side") == "ref")
    return ref.groupBy(*by, "dim").agg(F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("variance"))


def top_variance_dims(samples: DataFrame, by: Sequence[str], n: int = 16) -> DataFrame:
    """The ``n`` dimensions with the largest reference variance, larger index first on ties."""
    best = W.partitionBy(*by).orderBy(F.desc("variance"), F.desc("dim"))
    ranked = dimension_variance(samples, by).withColumn("_rn", F.row_number().over(best))
    return ranked.where(F.col("_rn") <= n).select(*by, "dim", "variance")


def per_dimension(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return compare_samples(samples, [*by, "dim"])


def mean_wasserstein(samples: DataFrame, by: Sequence[str], max_dims: int | None = None) -> DataFrame:
    """Mean Wasserstein-1 over all dimensions, or over the ``max_dims`` of the largest reference variance."""
    if max_dims is not None:
        chosen = top_variance_dims(samples, by, max_dims).drop("variance")
        samples = samples.join(chosen, [*by, "dim"], "left_semi")
    return per_dimension(samples, by).groupBy(*by).agg(fixed(F.avg("w1"), 6).alias("mean_w1"))


def ks_rejection(samples: DataFrame, by: Sequence[str], dims: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Share of the dimensions whose KS test rejects, with the median p-value; ``dims`` looks at the first ones only."""
    tested = per_dimension(samples if dims is None else samples.where(F.col("dim") < dims), by)
    return tested.groupBy(*by).agg(
        fixed(F.count_if(F.col("p_value") < alpha) / F.count(F.lit(1)), 4).alias("ks_rejection_ratio"),
        fixed(F.median("p_value"), 4).alias("median_p"),
    )


def systematic_sample(
    df: DataFrame, keys: Sequence[str], order: str, cap: int = 500
) -> DataFrame:
    """Every floor(n / cap)-th row of each key in order, at most ``cap``; all rows when n <= cap."""
    ranked = with_rank(df, keys, order, "_rank")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    stride = F.when(F.col("_n") > cap, F.floor(F.col("_n") / cap)).otherwise(F.lit(1))
    joined = ranked.join(sizes, list(keys)).withColumn("_stride", stride)
    taken = joined.where((F.col("_rank") % F.col("_stride") == 0) & (F.col("_rank") / F.col("_stride") < cap))
    return taken.withColumn("sample_pos", (F.col("_rank") / F.col("_stride")).cast("long")).drop("_rank", "_n", "_stride")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gaps = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.maximum(gaps, 0.0)


def _mmd(x: np.ndarray, y: np.ndarray, gamma: float | None) -> float:
    if gamma is None:
        near = _squared(x[:40], y[:40])
        near = near[near > 1e-8]
        gamma = 1.0 / (2.0 * max(1e-6, float(np.median(near)))) if near.size else 0.5

    def within(a: np.ndarray) -> float:
        if len(a) < 2:
            return 1.0
        k = np.exp(-gamma * _squared(a, a))
        return float((k.sum() - np.trace(k)) / (len(a) * (len(a) - 1)))

    cross = float(np.exp(-gamma * _squared(x, y)).mean())
    return float(np.sqrt(max(0.0, within(x) + within(y) - 2.0 * cross)))


def _sampled_mmd(rows: DataFrame, by: Sequence[str], sample: int, gamma: float | None) -> DataFrame:
    """All pairs of a systematic sample of ``sample`` rows a side."""
    taken = systematic_sample(rows, [*by, "side"], "_ord", sample)
    fields = [rows.schema[b] for b in by] + [T.StructField("_mmd", T.DoubleType())]

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = {}
        for name, part in pdf.sort_values("sample_pos").groupby("side"):
            sides[name] = np.stack(part["_vec"].to_numpy())
        value = _mmd(sides["ref"], sides["eval"], gamma) if len(sides) == 2 else 0.0
        return pd.DataFrame([[*key, value]], columns=[f.name for f in fields])

    return taken.groupBy(*by).applyInPandas(kernel, T.StructType(fields))


def _linear_mmd(ranked: DataFrame, sizes: DataFrame, by: Sequence[str], gamma: float | None) -> DataFrame:
    """Every row with its neighbour in order, and every row of the larger side with one of the other side.

    Reference row ``i mod n_ref`` meets evaluation row ``(i + 1) mod n_eval``: the step keeps rows of one origin apart. The
    number of pairs is linear in the rows, no row is left out, and the bandwidth is the median of all cross distances.
    """
    near = with_previous(ranked, [*by, "side"], "_pos", ["_vec"]).where("prev__vec IS NOT NULL").select(
        *by, F.col("side").alias("kind"), squared_distance(F.col("_vec"), F.col("prev__vec")).alias("dd")
    )
    most = F.greatest("n_ref", "n_eval")
    placed = ranked.join(sizes, list(by)).where("n_ref > 0 AND n_eval > 0")

    def dealt(side: str, start: Column, name: str) -> DataFrame:
        at = F.explode(F.sequence(start, most - 1, F.col(f"n_{side}"))).alias("_i")
        return placed.where(F.col("side") == side).select(*by, at, F.col("_vec").alias(name))

    left = dealt("ref", F.col("_pos"), "_x")
    right = dealt("eval", (F.col("_pos") - 1 + F.col("n_eval")) % F.col("n_eval"), "_y")
    cross = left.join(right, [*by, "_i"]).select(*by, F.lit("cross").alias("kind"), squared_distance(F.col("_x"), F.col("_y")).alias("dd"))
    pairs = cut_lineage(near.union(cross))
    if gamma is None:
        middle = exact_median(pairs.where("kind = 'cross' AND dd > 1e-8"), by, "dd", "_median")
        pairs = pairs.join(middle.select(*by, "_median"), list(by), "left")
        width = F.coalesce(1.0 / (2.0 * F.greatest(F.lit(1e-6), F.col("_median"))), F.lit(0.5))
    else:
        width = F.lit(float(gamma))
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.exp(-width * F.col("dd"))))
    one = F.lit(1.0)
    square = F.coalesce(mean("ref"), one) + F.coalesce(mean("eval"), one) - 2.0 * mean("cross")
    return pairs.groupBy(*by).agg(F.coalesce(F.sqrt(F.greatest(F.lit(0.0), square)), F.lit(0.0)).alias("_mmd"))


def mmd_rbf(
    features: DataFrame, by: Sequence[str], order: str, vector: str = "vec",
    gamma: float | None = None, sample: int | None = None,
) -> DataFrame:
    """RBF MMD per group, over all rows in linear time; ``sample`` takes all pairs of a systematic sample instead.

    Populations that are equal row by row give zero; that is decided over all rows from order-sensitive digests. Vectors
    that are not finite, or of different lengths within a group, are an error.
    """
    keys = [*by, "side"]
    vec = F.transform(F.col(vector).cast("array<double>"), lambda x: finite(x, "vector"))
    rows = features.select(*by, "side", F.col(order).alias("_ord"), vec.alias("_vec"))
    ranked = cut_lineage(with_rank(rows, keys, "_ord", "_pos"))
    mark = lambda seed: F.xxhash64(F.lit(seed), F.col("_pos"), F.col("_vec")).cast("decimal(38,0)")
    length = F.size("_vec")
    digests = ranked.groupBy(*by).agg(
        *[
            F.sum(F.when(F.col("side") == "ref", mark(s)).otherwise(-mark(s))).alias(f"_x{s}")
            for s in (1, 2)
        ],
        F.count_if(F.col("side") == "ref").alias("n_ref"), F.count_if(F.col("side") == "eval").alias("n_eval"),
        F.when(F.min(length) < F.max(length), F.raise_error(F.lit("vectors of different lengths"))).cast("int").alias("_ragged"),
    )
    if sample is None:
        scored = _linear_mmd(ranked, digests.select(*by, "n_ref", "n_eval"), by, gamma)
    else:
        scored = _sampled_mmd(ranked.select(*keys, "_ord", "_vec"), by, sample, gamma)
    same = (F.col("n_ref") == F.col("n_eval")) & (F.col("_x1") == 0) & (F.col("_x2") == 0)
    value = F.when(same, 0.0).otherwise(fixed(F.coalesce("_mmd", F.lit(0.0)), 6))
    joined = digests.where("_ragged IS NULL").join(scored, list(by), "left")
    return joined.select(*by, "n_ref", "n_eval", value.alias("mmd"))


def align_class_counts(samples: DataFrame, by: Sequence[str], label: str = "class_name") -> DataFrame:
    """Counts of both sides per class with zero for an absent side: ``by..., class, n_ref, n_eval``."""
    one = F.lit(1)
    return samples.groupBy(*by, label).agg(
        F.count(_on("ref", one)).alias("n_ref"), F.count(_on("eval", one)).alias("n_eval")
    )


def total_variation(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total-variation distance of aligned class counts, with missing and new class tallies."""
    totals = counts.groupBy(*by).agg(F.sum("n_ref").alias("total_ref"), F.sum("n_eval").alias("total_eval"))
    share = lambda s: F.try_divide(F.col(f"n_{s}"), F.col(f"total_{s}"))
    grouped = counts.join(totals, list(by)).groupBy(*by).agg(
        F.max("total_ref").alias("total_ref"), F.max("total_eval").alias("total_eval"),
        (F.sum(F.abs(share("ref") - share("eval"))) * 0.5).alias("_tv"),
        F.count_if((F.col("n_ref") > 0) & (F.col("n_eval") == 0)).alias("missing_classes"),
        F.count_if((F.col("n_ref") == 0) & (F.col("n_eval") > 0)).alias("new_classes"),
    )
    empty = (F.col("total_ref") == 0).cast("int") + (F.col("total_eval") == 0).cast("int")
    tv = F.when(empty == 2, 0.0).when(empty == 1, 1.0).otherwise(fixed(clamp(F.col("_tv")), 6))
    return grouped.select(*by, "total_ref", "total_eval", tv.alias("tv"), "missing_classes", "new_classes")


def class_shares(counts: DataFrame, by: Sequence[str], label: str = "class_name") -> DataFrame:
    """Proportions of both sides per class and whether the class is common, missing or new."""
    totals = counts.groupBy(*by).agg(F.sum("n_ref").alias("_r"), F.sum("n_eval").alias("_e"))
    state = (
        F.when((F.col("n_ref") > 0) & (F.col("n_eval") > 0), "common").when(F.col("n_ref") > 0, "missing").otherwise("new")
    )
    return counts.join(totals, list(by)).select(
        *by, label,
        fixed(F.coalesce(F.try_divide("n_ref", "_r"), F.lit(0.0)), 4).alias("ref_share"),
        fixed(F.coalesce(F.try_divide("n_eval", "_e"), F.lit(0.0)), 4).alias("eval_share"),
        state.alias("state"),
    )


def common_classes(ref: DataFrame, evaluation: DataFrame) -> DataFrame:
    return ref.intersect(evaluation)


def class_diff(ref: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Classes of one side only, with ``state`` missing (reference only) or new."""
    missing = ref.subtract(evaluation).withColumn("state", F.lit("missing"))
    return missing.unionByName(evaluation.subtract(ref).withColumn("state", F.lit("new")))
