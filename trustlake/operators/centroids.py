"""Class centroids, directed confusion between classes, and class-conditional outliers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.functions.numeric import fixed
from trustlake.functions.vectors import cosine_distance, unit
from trustlake.session import cut_lineage, is_small, sized_broadcast

SALTS = 64
#: Centroids of all datasets that may travel to every task.
MATRIX_BYTES = 64 << 20


def _long(features: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return features.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("_d", "_v"))


def _pack(column: str):
    """Per-dimension values back into one vector; bounded by the vector's length."""
    return F.transform(F.sort_array(F.collect_list(F.struct("_d", column))), lambda s: s[column])


def class_centroids(
    features: DataFrame, by: Sequence[str] = (), label: str = "class_id", vector: str = "vec", min_n: int = 1
) -> DataFrame:
    """Unit-length mean vector per class. Only (class, dim) partial averages are shuffled."""
    keys = [*by, label]
    means = _long(features, keys, vector).groupBy(*keys, "_d").agg(F.avg("_v").alias("_m"), F.count("_v").alias("_n"))
    packed = means.groupBy(*keys).agg(_pack("_m").alias("_mean"), F.max("_n").alias("n"))
    return packed.where(F.col("n") >= min_n).select(*keys, "n", unit(F.col("_mean")).alias("centroid"))


def centroid_distances(
    features: DataFrame, centroids: DataFrame, by: Sequence[str] = (), label: str = "class_id", vector: str = "vec"
) -> DataFrame:
    """Every row against every centroid of its dataset: ``..., other, distance`` beside ``own_distance``.

    The centroid table is counted before it is broadcast; a larger one joins on the dataset key and a salt.
    """
    small = is_small(centroids)
    own = centroids.select(*by, label, F.col("centroid").alias("_own"))
    others = centroids.select(*by, F.col(label).alias("other"), F.col("centroid").alias("_other"))
    rows = features
    if small:
        own, others = F.broadcast(own), F.broadcast(others.withColumn("_salt", F.lit(0)))
        salt = F.lit(0)
    else:
        others = others.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(vector), F.lit(SALTS)).cast("int")
    rows = rows.join(own, [*by, label]).withColumn("_salt", salt).join(others, [*by, "_salt"])
    v = F.col(vector).cast("array<double>")
    return rows.select(
        *by, label, "other",
        fixed(cosine_distance(v, F.col("_own")), 9).alias("own_distance"),
        fixed(cosine_distance(v, F.col("_other")), 9).alias("distance"),
    )


def closer_counts(
    features: DataFrame, centroids: DataFrame, by: Sequence[str] = (), label: str = "class_id", vector: str = "vec"
) -> DataFrame:
    """``by..., label, other, n, closer``: rows of class ``label`` and how many of them lie closer to ``other`` than to their own centroid.

    A batch of rows is multiplied with the centroid matrix of its dataset, and only counts leave the task: no row is copied per
    class. ``centroids`` must fit in memory, see :func:`matrix_bytes`. Distances are compared at nine digits.
    """
    keys = [*by, label]
    matrices: dict[tuple, tuple[list, np.ndarray]] = {}
    for row in sorted(centroids.select(*keys, "centroid").collect(), key=lambda r: str(r[label])):
        names, vectors = matrices.setdefault(tuple(row[b] for b in by), ([], []))
        names.append(row[label])
        vectors.append(row["centroid"])
    held = features.sparkSession.sparkContext.broadcast({k: (names, np.array(v, dtype=float)) for k, (names, v) in matrices.items()})
    schema = T.StructType([
        *[features.schema[k] for k in keys], T.StructField("other", features.schema[label].dataType), T.StructField("n", T.LongType()), T.StructField("closer", T.LongType()),
    ])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, rows in pdf.groupby(list(by)) if by else [((), pdf)]:
                names, matrix = held.value.get(key, ([], None))
                place = {name: i for i, name in enumerate(names)}
                own = rows[label].map(place)
                rows, own = rows[own.notna()], own.dropna().astype(int).to_numpy()
                n, closer = np.zeros(len(names), dtype=np.int64), np.zeros((len(names), len(names)), dtype=np.int64)
                for start in range(0, len(rows), 2048):
                    at = own[start:start + 2048]
                    away = np.maximum(0.0, 1.0 - np.stack(rows["_vec"].iloc[start:start + 2048].to_numpy()) @ matrix.T)
                    away = np.floor(away * 1e9 + 0.5000001)
                    np.add.at(closer, at, away < away[np.arange(len(at)), at][:, None])
                    n += np.bincount(at, minlength=len(names))
                out += [(*key, names[i], names[j], int(n[i]), int(closer[i, j])) for i in np.flatnonzero(n) for j in range(len(names)) if i != j]
            yield pd.DataFrame(out, columns=schema.names)

    rows = features.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_vec"))
    return rows.mapInPandas(multiply, schema).groupBy(*keys, "other").agg(F.sum("n").alias("n"), F.sum("closer").alias("closer"))


def matrix_bytes(centroids: DataFrame) -> int:
    return centroids.agg(F.sum(F.size("centroid") * 8 + 64)).first()[0] or 0


def confusion_rates(
    features: DataFrame, by: Sequence[str] = (), label: str = "class_id", vector: str = "vec", min_n: int = 3, max_bytes: int = MATRIX_BYTES
) -> DataFrame:
    """Share of class ``label`` rows lying closer to centroid ``other`` than to their own.

    Centroids up to ``max_bytes`` in all go to the tasks as matrices; more are joined to the rows by dataset.
    """
    centroids = cut_lineage(class_centroids(features, by, label, vector, min_n))
    if matrix_bytes(centroids) <= max_bytes:
        counts = closer_counts(features, centroids, by, label, vector)
    else:
        away = centroid_distances(features, centroids, by, label, vector).where(F.col(label) != F.col("other"))
        counts = away.groupBy(*by, label, "other").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") < F.col("own_distance")).alias("closer")
        )
    return counts.select(*by, label, "other", "n", (F.col("closer") / F.col("n")).alias("rate"))


def asymmetric_confusion(
    features: DataFrame, by: Sequence[str] = (), label: str = "class_id", vector: str = "vec",
    delta: float = 0.35, min_rate: float = 0.30, min_n: int = 3,
) -> DataFrame:
    """Class pairs confused in one direction only, with source and target."""
    rates = confusion_rates(features, by, label, vector, min_n)
    back = rates.select(*by, F.col(label).alias("other"), F.col("other").alias(label), F.col("rate").alias("back"), F.col("n").alias("n_other"))
    pairs = rates.join(back, [*by, label, "other"]).where(F.col(label) < F.col("other"))
    gap = F.abs(F.col("rate") - F.col("back"))
    flagged = pairs.where(((F.col("rate") > min_rate) | (F.col("back") > min_rate)) & (gap >= delta - 1e-12))
    forward = F.col("rate") > F.col("back")
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return flagged.select(
        *by, pick(label, "other").alias("source_class"), pick("other", label).alias("target_class"),
        pick("rate", "back").alias("source_to_target"), pick("back", "rate").alias("target_to_source"),
        gap.alias("asymmetry"), pick("n", "n_other").alias("sample_count"),
    )


def outlier_scores(
    features: DataFrame, by: Sequence[str] = (), label: str = "class_id", vector: str = "vec", min_n: int = 4
) -> DataFrame:
    """Root mean square of per-dimension z-scores within the class, over dimensions that vary.

    Class moments are tiny next to the rows, so they travel to the rows as two arrays instead of the rows
    being exploded and shuffled.
    """
    keys = [*by, label]
    moments = _long(features, keys, vector).groupBy(*keys, "_d").agg(
        F.avg("_v").alias("_m"), F.var_samp("_v").alias("_s"), F.count("_v").alias("_n")
    )
    spread = F.when(F.col("_s") > 1e-8, F.sqrt("_s"))
    packed = (
        moments.withColumn("_sd", spread).groupBy(*keys)
        .agg(_pack("_m").alias("_mean"), _pack("_sd").alias("_dev"), F.max("_n").alias("n"), F.count("_sd").alias("_active"))
        .where((F.col("n") >= min_n) & (F.col("_active") > 0))
    )
    rows = features.join(sized_broadcast(packed), keys)
    centred = F.zip_with(F.col(vector).cast("array<double>"), "_mean", lambda x, m: x - m)
    squares = F.zip_with(centred, "_dev", lambda x, s: F.coalesce((x / s) * (x / s), F.lit(0.0)))
    score = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / F.col("_active"))
    return rows.withColumn("score", score).drop("_mean", "_dev", "_active")


def class_outliers(features: DataFrame, sigma: float = 3.0, **options) -> DataFrame:
    return outlier_scores(features, **options).where(F.col("score") > sigma)
