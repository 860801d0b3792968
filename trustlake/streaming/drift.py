"""Drift of arriving data against a fixed baseline, per tumbling window of event time.

A window is scored once, when the watermark passes its end, from sketches that merge exactly however its rows were spread over
micro-batches: counts per class, counts per value of each quality metric and dimension, coordinate sums per class, sums of random
Fourier features, counts of distances to the baseline's centroid. Each task sketches its rows per Arrow batch, Spark's windowed aggregation
merges the sketches in its state store, map side first, so a window that holds most rows is no hot key.

With ``grid`` values are rounded to so many quantiles of the baseline, which bounds the state of a window; without, every distinct
value is kept and the figures are those of the batch operators. The kernel distance is always that of the Fourier features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.functions.numeric import clamp, fixed, kolmogorov_p
from trustlake.operators import shift as S
from trustlake.session import cut_lineage

WINDOW = "window_start"
SKETCH = "at long, part string, key string, value double, n long, s double"
DEFAULT_CLASS = "default_class"


@dataclass(frozen=True)
class Columns:
    """What is watched: a class label, quality metrics, a vector. ``None`` or an empty tuple leaves the part out."""

    time: str
    label: str | None = None
    quality: Sequence[str] = ()
    vector: str | None = None


@dataclass(frozen=True)
class Baseline:
    """Sketch of the reference rows, and the few numbers that tasks need to sketch others alike.

    ``edges`` are some three times ``grid`` values per metric and dimension; ``weights`` and ``phases`` are the Fourier features; ``centre`` is
    the mean vector.
    """

    columns: Columns
    sketch: DataFrame | None
    edges: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    weights: np.ndarray | None = None
    phases: np.ndarray | None = None
    centre: np.ndarray | None = None


def _pick(frame: DataFrame, columns: Columns) -> DataFrame:
    """The watched columns under fixed names; ``at`` in microseconds since the epoch, zero for a baseline without a time."""
    timed = columns.time in frame.columns
    names = [F.unix_micros(F.col(columns.time).cast("timestamp")).alias("at") if timed else F.lit(0).cast("long").alias("at")]
    if columns.label:
        names.append(F.col(columns.label).cast("string").alias("label"))
    names += [F.col(q).cast("double").alias(f"q_{q}") for q in columns.quality]
    if columns.vector:
        names.append(F.col(columns.vector).cast("array<double>").alias("vector"))
    return frame.select(*names)


def _reach(quantiles: np.ndarray) -> np.ndarray:
    """The quantiles of the baseline, as many even steps over a range below and above them, and doubling steps beyond: drifted values need a place too."""
    quantiles = np.unique(quantiles)
    low, high, n = quantiles[0], quantiles[-1], len(quantiles)
    size = max(high - low, abs(high), 1e-9)
    near, far = np.arange(1, n + 1) / n, 2.0 ** np.arange(1, 64)
    out = np.concatenate([near, far]) * size
    return np.unique(np.concatenate([low - out, quantiles, high + out]))


def _rounded(values: np.ndarray, edges: np.ndarray | None) -> np.ndarray:
    """Each value as the nearest of the quantiles; as it is without them."""
    if edges is None:
        return values
    above = np.clip(np.searchsorted(edges, values), 1, len(edges) - 1) if len(edges) > 1 else np.zeros(len(values), dtype=int)
    low = edges[np.maximum(above - 1, 0)]
    return np.where(values - low <= edges[above] - values, low, edges[above])


def _sketch_rows(pdf: pd.DataFrame, base: Baseline) -> pd.DataFrame:
    """Sketch of the rows of one window: ``part, key, value, n, s``."""
    columns, edges = base.columns, base.edges
    out: list[pd.DataFrame] = []

    def add(part: str, key: object, value: object, n: object, s: object = 0.0) -> None:
        out.append(pd.DataFrame({"part": part, "key": key, "value": value, "n": n, "s": s}))

    def count(part: str, key: str, values: np.ndarray) -> None:
        values = values[~np.isnan(values)]
        if np.isinf(values).any():
            raise ValueError(f"{part} {key} contains non-finite values")
        distinct, n = np.unique(_rounded(values, edges.get((part, key))), return_counts=True)
        if len(distinct):
            add(part, key, distinct, n)

    if columns.label:
        classes = pdf["label"].value_counts(dropna=False)
        add("class", classes.index.astype(object).where(classes.index.notna(), None), 0.0, classes.to_numpy())
    for q in columns.quality:
        count("quality", q, pdf[f"q_{q}"].to_numpy(dtype=float))
    if columns.vector:
        held = pdf[pdf["vector"].notna()]
        add("rows", "", 0.0, [len(held)])
        if len(held):
            x = np.stack(held["vector"].to_numpy()).astype(float)
            if not np.isfinite(x).all():
                raise ValueError("vector contains non-finite values")
            for d in range(x.shape[1]):
                count("dim", str(d), x[:, d])
            names = held["label"].where(held["label"].notna(), DEFAULT_CLASS).to_numpy() if columns.label else np.full(len(x), DEFAULT_CLASS)
            for name in np.unique(names.astype(str)):
                own = x[names == name]
                add("centroid", name, np.arange(x.shape[1], dtype=float), len(own), own.sum(0))
            waves = np.cos(x @ base.weights + base.phases).sum(0)
            add("kernel", "", np.arange(len(waves), dtype=float), len(x), waves)
            count("away", "", np.sqrt(((x - base.centre) ** 2).sum(1)))
    return pd.concat(out) if out else pd.DataFrame(columns=["part", "key", "value", "n", "s"])


def _sketches(picked: DataFrame, base: Baseline, width_s: int | None) -> DataFrame:
    """Partial sketches, one set per Arrow batch and window, stamped with the latest time of their rows."""
    bare = replace(base, sketch=None)  # a plan is not shipped to tasks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, rows in pdf.groupby(pdf["at"] // (width_s * 1_000_000)) if width_s else [(0, pdf)]:
                if len(rows):
                    found = _sketch_rows(rows, bare)
                    found.insert(0, "at", rows["at"].max())
                    yield found

    timed = picked.where("at IS NOT NULL") if width_s else picked.withColumn("at", F.coalesce("at", F.lit(0).cast("long")))
    return timed.mapInPandas(run, SKETCH)


def merged(sketches: DataFrame, by: Sequence[object] = ()) -> DataFrame:
    return sketches.groupBy(*by, "part", "key", "value").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def build_baseline(
    reference: DataFrame, columns: Columns, grid: int | None = 512, features: int = 512, gamma: float | None = None, sample: int = 500, seed: int = 7
) -> Baseline:
    """Sketch ``reference`` once. The kernel width is the median heuristic over ``sample`` rows unless ``gamma`` is given."""
    picked = cut_lineage(_pick(reference, columns))
    edges: dict[tuple[str, str], np.ndarray] = {}
    weights = phases = centre = None
    if grid:
        points = [k / (grid - 1) for k in range(grid)]
        for q in columns.quality:
            edges["quality", q] = _reach(np.array(picked.select(F.percentile_approx(f"q_{q}", points, 10 * grid)).first()[0] or [0.0]))
    if columns.vector:
        long = picked.select(F.posexplode("vector").alias("dim", "v"))
        stats = [F.avg("v").alias("m")] + ([F.percentile_approx("v", points, 10 * grid).alias("q")] if grid else [])
        found = long.groupBy("dim").agg(*stats).orderBy("dim").collect()  # one row a dimension
        centre = np.array([r["m"] for r in found])
        if grid:
            edges |= {("dim", str(r["dim"])): _reach(np.array(r["q"])) for r in found}
        if gamma is None:
            rows = picked.where("vector IS NOT NULL").orderBy(F.xxhash64("vector")).limit(sample).collect()
            x = np.array([r["vector"] for r in rows])
            gaps = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
            gaps = gaps[gaps > 1e-8]
            gamma = 1.0 / (2.0 * max(1e-6, float(np.median(gaps)))) if gaps.size else 0.5
        rng = np.random.default_rng(seed)
        weights = rng.normal(scale=np.sqrt(2.0 * gamma), size=(len(centre), features))
        phases = rng.uniform(0.0, 2.0 * np.pi, size=features)
        if grid:
            square = F.aggregate(F.zip_with("vector", F.lit(centre.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
            away = picked.where("vector IS NOT NULL").select(F.percentile_approx(F.sqrt(square), points, 10 * grid))
            edges["away", ""] = _reach(np.array(away.first()[0]))
    base = Baseline(columns, None, edges, weights, phases, centre)
    return replace(base, sketch=cut_lineage(merged(_sketches(picked, base, None))))


def window_sketches(stream: DataFrame, baseline: Baseline, width_s: int, delay: str) -> DataFrame:
    """``window_start, part, key, value, n, s`` of every window, appended when the watermark passes its end; rows later than that are dropped."""
    sketches = _sketches(_pick(stream, baseline.columns), baseline, width_s).withColumn("at", F.timestamp_micros("at"))
    found = merged(sketches.withWatermark("at", delay), [F.window("at", f"{width_s} seconds").alias("_w")])
    return found.select(F.col("_w.start").alias(WINDOW), "part", "key", "value", "n", "s")


def _compare(sketches: DataFrame, base: DataFrame, part: str) -> DataFrame:
    """KS and Wasserstein-1 of every key of a part in every window; the baseline's values come along as one array a key."""
    pack = lambda df, by, name: df.where(F.col("part") == part).groupBy(*by, "key").agg(
        F.sort_array(F.collect_list(F.struct("value", "n"))).alias(name)
    )
    both = pack(sketches, [WINDOW], "e").join(pack(base, [], "r"), "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for e, r in zip(pdf["e"], pdf["r"]):
                (ve, ne), (vr, nr) = ((np.array([x["value"] for x in y]), np.array([x["n"] for x in y])) for y in (e, r))
                at = np.union1d(ve, vr)
                cumulate = lambda v, n: np.concatenate([[0], np.cumsum(n)])[np.searchsorted(v, at, side="right")] / n.sum()
                gap = np.abs(cumulate(ve, ne) - cumulate(vr, nr))
                out.append((int(nr.sum()), int(ne.sum()), float(gap.max()), float((gap[:-1] * np.diff(at)).sum())))
            yield pd.concat([pdf[[WINDOW, "key"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_ref", "n_eval", "d", "w"])], axis=1)

    found = both.mapInPandas(run, f"{WINDOW} timestamp, key string, n_ref long, n_eval long, d double, w double")
    return found.select(
        WINDOW, "key", "n_ref", "n_eval", fixed(kolmogorov_p(F.col("d"), F.col("n_ref"), F.col("n_eval")), 6).alias("p_value"), fixed(F.col("w"), 8).alias("w1")
    )


def _one(value: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Baseline totals joined to every window row: a single row, or one per key."""
    return F.broadcast(value.withColumn("_one", F.lit(1))) if not by else value


def score_windows(sketches: DataFrame, baseline: Baseline, min_n: int = 15) -> DataFrame:
    """DS-1 to DS-4 of complete window sketches, in the columns of the batch operators."""
    base, by = baseline.sketch, [WINDOW]
    parts = []
    if baseline.columns.label:
        ours = sketches.where("part = 'class'").select(WINDOW, "key", "n")
        theirs = base.where("part = 'class'").select("key", F.col("n").alias("r"))
        whole = theirs.agg(F.sum("r").alias("n_ref"), F.count(F.lit(1)).alias("_classes"))
        sizes = ours.groupBy(*by).agg(F.sum("n").alias("n_eval")).withColumn("_one", F.lit(1)).join(_one(whole), "_one").drop("_one")
        known = ours.join(theirs.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left").join(sizes, by)
        p, q = F.col("r") / F.col("n_ref"), F.col("n") / F.col("n_eval")
        # Classes of one side only add their whole share; no row is needed for those of the baseline.
        sums = known.groupBy(*by).agg(
            F.max("n_ref").alias("n_ref"), F.max("n_eval").alias("n_eval"),
            (0.5 * (F.sum(F.when(F.col("r").isNull(), q).otherwise(F.abs(p - q))) + 1 - F.sum(F.coalesce(p, F.lit(0.0))))).alias("_tv"),
            (F.max("_classes") - F.count("r")).alias("missing_classes"), F.count_if(F.col("r").isNull()).alias("new_classes"),
        )
        parts.append(S.semantic_rows(sums.withColumn("tv", fixed(clamp(F.col("_tv")), 6)), by, min_n=min_n))
    if baseline.columns.quality:
        parts.append(S.environmental_rows(_compare(sketches, base, "quality"), by, min_n=min_n))
    if baseline.columns.vector:
        total = base.where("part = 'rows'").agg(F.sum("n").alias("n_ref"))
        sizes = sketches.where("part = 'rows'").select(WINDOW, F.col("n").alias("n_eval")).withColumn("_one", F.lit(1)).join(_one(total), "_one").drop("_one")
        tested = _compare(sketches, base, "dim")
        stats = tested.groupBy(*by).agg(
            fixed(F.avg("w1"), 6).alias("mean_w1"), fixed(F.count_if(F.col("p_value") < 0.05) / F.count(F.lit(1)), 4).alias("ks_rejection_ratio"),
            fixed(F.median("p_value"), 4).alias("p_value"),
        )
        waves = sketches.where("part = 'kernel'").join(base.where("part = 'kernel'").select("value", F.col("n").alias("rn"), F.col("s").alias("rs")), "value")
        gap = F.col("s") / F.col("n") - F.col("rs") / F.col("rn")
        kernel = waves.groupBy(*by).agg(fixed(F.sqrt(F.sum(gap * gap) * 2.0 / F.count(F.lit(1))), 6).alias("mmd"))
        parts.append(S.covariate_rows(sizes.join(kernel, by).join(stats, by), by, min_n=min_n))
        parts.append(_subpopulation(sketches, base, sizes, min_n))
    if not parts:
        raise ValueError("name a label, quality metrics or a vector")
    return reduce(DataFrame.unionByName, [p.select(WINDOW, *S.COMMON) for p in parts])


def _subpopulation(sketches: DataFrame, base: DataFrame, sizes: DataFrame, min_n: int) -> DataFrame:
    by = [WINDOW]
    ours = sketches.where("part = 'centroid'").select(WINDOW, "key", "value", F.col("n").alias("en"), F.col("s").alias("es"))
    theirs = base.where("part = 'centroid'").select("key", "value", F.col("n").alias("rn"), F.col("s").alias("rs"))
    gap = F.col("es") / F.col("en") - F.col("rs") / F.col("rn")
    displaced = ours.join(theirs, ["key", "value"]).groupBy(*by, "key").agg(F.sqrt(F.sum(gap * gap)).alias("displacement"))
    multi = S.multi_class_rows(displaced, by).where("classes > 1")
    whole = lambda df, k: df.groupBy(*k, "value").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    all_e = whole(sketches.where("part = 'centroid'"), by)
    all_r = whole(base.where("part = 'centroid'"), []).select("value", F.col("n").alias("rn"), F.col("s").alias("rs"))
    moved = F.col("s") / F.col("n") - F.col("rs") / F.col("rn")
    shift = all_e.join(all_r, "value").groupBy(*by).agg(F.sqrt(F.sum(moved * moved)).alias("global_shift"))
    upto = W.partitionBy(WINDOW).orderBy("value")  # the distinct distances of a window, bounded by the grid
    away = sketches.where("part = 'away'").join(multi.select(WINDOW), WINDOW, "left_anti").select(
        WINDOW, "value", F.sum("n").over(upto).alias("_upto"), F.sum("n").over(W.partitionBy(WINDOW)).alias("_all")
    )
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("value")))
    n = F.col("_all")
    picks = away.groupBy(WINDOW).agg(
        F.max("_all").alias("n"), at(F.floor((n - 1) / 2)).alias("_low"), at(F.floor(n / 2)).alias("_high"), at(F.floor(n * 0.9)).alias("q90")
    )
    score = S.spread_score(F.col("n"), F.col("global_shift"), F.col("q90"), (F.col("_low") + F.col("_high")) / 2)
    single = picks.join(shift, by).select(
        WINDOW, F.lit(1).cast("long").alias("classes"), F.col("global_shift").alias("mean_shift"), F.col("global_shift").alias("max_shift"),
        F.lit(1.0).alias("concentration"), fixed(clamp(score), 6).alias("metric"),
    )
    columns = [WINDOW, "classes", "mean_shift", "max_shift", "concentration", "metric"]
    return S.subpopulation_rows(multi.select(*columns).unionByName(single.select(*columns)).join(sizes, by), by, min_n=min_n)


def report_windows(rows: DataFrame, min_n: int = 15) -> DataFrame:
    """One report row per window from its dimension rows."""
    sizes = rows.groupBy(WINDOW).agg(F.max("n_ref").alias("n_ref"), F.max("n_eval").alias("n_eval"))
    return S.shift_report(rows, sizes, [WINDOW], min_n)


def monitor_drift(baseline: Baseline, path: str, min_n: int = 15) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` over :func:`window_sketches`: writes the rows of the windows that closed, overwriting a repeated batch.

    All sketches of a window close in one micro-batch, so each window is written once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            held = cut_lineage(batch)
            score_windows(held, baseline, min_n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
