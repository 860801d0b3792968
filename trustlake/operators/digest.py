"""Order-independent digests of tables: a Merkle tree keyed by digest prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (6, 3, 0)


def row_digest(columns: Sequence[str | Column]) -> Column:
    """SHA-256 of the columns' text, each behind its length; a null is ``-``. Different rows never have one text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat_ws(",", *parts), 256)


def merkle(digests: DataFrame, by: Sequence[str] = (), column: str = "digest", levels: Sequence[int] = LEVELS) -> DataFrame:
    """Fold row digests into one per group.

    Equal digests collapse to a count first. Each level hashes the sorted children of one prefix; digests are
    uniform, so a node has few children at any table size and no group is ever gathered whole.
    """
    node = digests.groupBy(*by, F.col(column).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    node = node.select(*by, "_d", F.concat_ws(":", "_d", "_n").alias("_leaf"))
    for depth in levels:
        prefix = F.substring("_d", 1, depth) if depth else F.lit("")
        node = node.groupBy(*by, prefix.alias("_d")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("_leaf")), ","), 256).alias("_hash")
        )
        node = node.select(*by, "_d", F.concat_ws(":", "_d", "_hash").alias("_leaf"))
    return node.select(*by, F.split_part("_leaf", F.lit(":"), F.lit(2)).alias("digest"))


def table_digest(df: DataFrame, columns: Sequence[str | Column], levels: Sequence[int] = LEVELS) -> DataFrame:
    """One-row digest of a table, unchanged by row order."""
    return merkle(df.select(row_digest(columns).alias("digest")), (), "digest", levels)


def group_digest(df: DataFrame, by: Sequence[str], columns: Sequence[str | Column], levels: Sequence[int] = LEVELS) -> DataFrame:
    """Digest per group, such as a model's weights or a battery's probes."""
    return merkle(df.select(*by, row_digest(columns).alias("digest")), by, "digest", levels)


def dataset_digest(
    images: DataFrame, annotations: DataFrame, classes: DataFrame, datasets: DataFrame, levels: Sequence[int] = LEVELS
) -> DataFrame:
    """Digest per dataset over images, annotations, classes and provenance; changes with any of them."""
    c = F.col
    corner = lambda n: F.round(c("bbox")[n], 6)
    parts = [
        images.select("dataset_id", row_digest([F.lit("image"), F.translate("file_path", "\\", "/"), "file_hash", "width", "height"]).alias("digest")),
        annotations.select(
            "dataset_id",
            row_digest([F.lit("annotation"), "image_id", "class_id", *[corner(n) for n in ("x_min", "y_min", "x_max", "y_max")]]).alias("digest"),
        ),
        classes.select("dataset_id", row_digest([F.lit("class"), "class_id", "class_name"]).alias("digest")),
        datasets.select("dataset_id", row_digest([F.lit("dataset"), "format_origin", "contributor_id", "batch_id"]).alias("digest")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return merkle(rows, ["dataset_id"], "digest", levels)
