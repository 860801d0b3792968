"""Ordered scans (previous row, running total, rank) that hold when one key owns a third of the table.

A plain window over such a key would sort the whole stream in one task. Here the order column is cut into
buckets of a fixed width: the row-level window runs inside (key, bucket), and a second window carries one
summary row per bucket forward. With a unique integer order a bucket holds at most ``width`` rows.

A sparse order (time-stamped ids) gives nearly a bucket per row, so the summaries are scanned the same way, in
spans of ``SPAN`` buckets. The cuts are digits of the order value and need no pass over the data: of any 64-bit
order no window sees more than 2^18 rows, 2^22 bucket summaries or 2^24 span summaries of a key. Rows that share
one order value stay together; in which order they are scanned is not defined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH, SPAN = 1 << 18, 1 << 22
_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
_BUCKET, _AT = "_bucket", "_at"


def _merge(kind: str, left: Column, right: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def add_bucket(df: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    return df.withColumn(_BUCKET, F.floor(F.col(order) / F.lit(width)).cast("long"))


def join_buckets(rows: DataFrame, buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach bucket summaries; null-safe so that rows with a null key are kept."""
    on = [*keys, _BUCKET]
    side = buckets.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in buckets.columns if c not in on])
    test = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(side[f"_r_{k}"]) for k in on])
    return rows.join(side, test, "left").drop(*[f"_r_{k}" for k in on])


def with_running(
    df: DataFrame, keys: Sequence[str], order: str,
    aggs: Mapping[str, tuple[str, Column]], width: int = WIDTH, include_current: bool = False, span: int | None = SPAN,
) -> DataFrame:
    """Add running aggregates over earlier rows of the key: ``{"name": ("max", col)}``.

    ``span`` buckets are summarised once more; None carries all buckets of a key in one window.
    """
    rows = add_bucket(df, order, width)
    end = W.currentRow if include_current else -1
    inside = W.partitionBy(*keys, _BUCKET).orderBy(order).rowsBetween(W.unboundedPreceding, end)
    totals = rows.groupBy(*keys, _BUCKET).agg(*[_AGG[k](c).alias(f"_t_{n}") for n, (k, c) in aggs.items()])
    merged = {f"_c_{n}": ("sum" if k == "count" else k, F.col(f"_t_{n}")) for n, (k, _) in aggs.items()}
    if span is None:
        across = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
        carried = totals.select(*keys, _BUCKET, *[_AGG[k](c).over(across).alias(n) for n, (k, c) in merged.items()])
    else:
        carried = with_running(totals.withColumnRenamed(_BUCKET, _AT), keys, _AT, merged, span, span=None)
        carried = carried.select(*keys, F.col(_AT).alias(_BUCKET), *merged)
    rows = rows.select("*", *[_AGG[k](c).over(inside).alias(f"_i_{n}") for n, (k, c) in aggs.items()])
    joined = join_buckets(rows, carried, keys)
    return joined.select(
        *df.columns, *[_merge(k, F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n, (k, _) in aggs.items()]
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], width: int = WIDTH, prefix: str = "prev_", span: int | None = SPAN
) -> DataFrame:
    """Add ``prev_<column>`` of the preceding row of the key; null on its first row. ``span`` as in :func:`with_running`."""
    rows = add_bucket(df, order, width)
    packed = F.struct(*[F.col(c) for c in columns])
    inside = W.partitionBy(*keys, _BUCKET).orderBy(order)
    last = rows.groupBy(*keys, _BUCKET).agg(F.max_by(packed, order).alias("_last"))
    if span is None:
        carried = last.select(*keys, _BUCKET, F.lag("_last").over(W.partitionBy(*keys).orderBy(_BUCKET)).alias("_carried"))
    else:
        carried = with_previous(last.withColumnRenamed(_BUCKET, _AT), keys, _AT, ["_last"], span, "_before", None)
        carried = carried.select(*keys, F.col(_AT).alias(_BUCKET), F.col("_before_last").alias("_carried"))
    rows = rows.withColumn("_lag", F.lag(packed).over(inside))
    joined = join_buckets(rows, carried, keys)
    before = F.coalesce(F.col("_lag"), F.col("_carried"))
    return joined.select(*df.columns, *[before[c].alias(f"{prefix}{c}") for c in columns])


def with_rank(df: DataFrame, keys: Sequence[str], order: str, name: str = "rank", width: int = WIDTH) -> DataFrame:
    """Zero-based position of each row in its key by a unique integer order."""
    return with_running(df, keys, order, {name: ("count", F.lit(1))}, width)


def assign_sequence(df: DataFrame, keys: Sequence[str], order: str, width: int = WIDTH) -> DataFrame:
    """Consecutive sequence numbers from zero per stream."""
    return with_rank(df, keys, order, "sequence_number", width)


def equi_depth_buckets(
    support: DataFrame, by: Sequence[str], value: str, side: int = 32, rows_per_bucket: int = WIDTH
) -> DataFrame:
    """Add ``_bucket`` with about equal numbers of distinct values per group.

    A group of up to ``rows_per_bucket`` values is one bucket. Larger groups are cut at bounds from a mergeable
    quantile sketch, which follow the data however clustered it is; a value finds its bucket in two steps of
    ``side`` comparisons (side * side buckets in all).
    """
    count = side * side
    cuts = [i / count for i in range(1, count)]
    keys = [F.col(b).alias(f"_g_{b}") for b in by]
    large = support.groupBy(*by).agg(F.count(F.lit(1)).alias("_values")).where(F.col("_values") > rows_per_bucket).select(*keys)
    match = lambda side_: reduce(lambda a, b: a & b, [support[b].eqNullSafe(side_[f"_g_{b}"]) for b in by], F.lit(True))
    # Only large groups pay for the sketch.
    bounds = support.join(large, match(large), "left_semi").groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), cuts, 20_000).alias("_bounds")
    ).withColumn("_steps", F.filter("_bounds", lambda x, i: i % side == side - 1))
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col(value)))
    return (
        support.join(bounds, match(bounds), "left")
        .withColumn("_coarse", F.when(F.col("_bounds").isNotNull(), below("_steps")).otherwise(0))
        .withColumn(_BUCKET, F.when(
            F.col("_bounds").isNotNull(), F.col("_coarse") * side + below(F.slice("_bounds", F.col("_coarse") * side + 1, side))
        ).otherwise(0).cast("long"))
        .drop("_bounds", "_steps", "_coarse", *[f"_g_{b}" for b in by])
    )


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Column],
    side: int = 32, rows_per_bucket: int = WIDTH,
) -> DataFrame:
    """Exact order statistics per group without sorting a group in one task.

    ``ranks`` maps an output name to a zero-based rank expression over ``n``. One row per group with ``n``.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    rows = equi_depth_buckets(counts, by, value, side, rows_per_bucket)
    inside = W.partitionBy(*by, _BUCKET).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = rows.groupBy(*by, _BUCKET).agg(F.sum("_k").alias("_t"))
    across = W.partitionBy(*by).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    carried = totals.select(
        *by, _BUCKET, F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_c"), F.sum("_t").over(whole).alias("n")
    )
    placed = join_buckets(rows.withColumn("_i", F.sum("_k").over(inside)), carried, by)
    upto = F.col("_c") + F.col("_i")
    hits = [
        F.min(F.when((upto > rank) & (upto - F.col("_k") <= rank), F.col(value))).alias(name)
        for name, rank in ranks.items()
    ]
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *hits)


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    n = F.col("n")
    found = order_statistics(
        df, by, value, {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}
    )
    return found.select(*by, "n", ((F.col("_low") + F.col("_high")) / 2).alias(name))
