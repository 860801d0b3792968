"""Exact and near duplicates: digest groups, Hamming joins on 64-bit hashes, connected components."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.functions.binary import hamming
from trustlake.session import cut_lineage

BITS = 64


def exact_duplicates(images: DataFrame, by: Sequence[str] = (), key: str = "file_hash") -> DataFrame:
    """One row per digest shared by several files: ``by..., key, files``."""
    return images.groupBy(*by, key).agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def duplicate_summary(images: DataFrame, by: Sequence[str] = (), key: str = "file_hash") -> DataFrame:
    """Cluster count, file count and ratio per dataset."""
    sizes = images.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    dup = F.col("_n") > 1
    rows = sizes.groupBy(*by).agg(
        F.count_if(dup).alias("clusters"), F.coalesce(F.sum(F.when(dup, F.col("_n"))), F.lit(0)).alias("files"),
        F.sum("_n").alias("images"),
    )
    return rows.withColumn("ratio", F.round(F.col("files") / F.col("images"), 4))


def _band_masks(max_distance: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - max_distance`` blocks: a close pair agrees on at least one of them."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (high - low)) - 1) << low for low, high in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(parts, blocks - max_distance)]


def band_blocks(hashes: int, max_distance: int, per_band: int = 16) -> int:
    """Blocks whose bands are long enough that ``hashes`` spread hashes share a band value with about ``per_band`` others at most."""
    blocks = max_distance + 2
    while blocks < 4 * (max_distance + 1) and hashes > per_band * 2 ** (BITS * (blocks - max_distance) / blocks):
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _ball(h: Column, radius: int) -> Column:
    """All 64-bit values within ``radius`` flips of ``h``."""
    near = F.array(h)
    for _ in range(radius):
        flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
        step = F.flatten(F.transform(near, lambda x: F.transform(flips, lambda m: x.bitwiseXOR(m))))
        near = F.array_distinct(F.concat(near, step))
    return near


def _pairs(keyed: DataFrame, keys: Sequence[str], max_distance: int) -> DataFrame:
    left = keyed.select(*keys, F.col("h").alias("a"))
    right = keyed.select(*keys, F.col("h").alias("b"))
    joined = left.join(right, list(keys)).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= max_distance))
    return joined.select(*[k for k in keys if not k.startswith("_")], "a", "b")


def hamming_pairs(
    hashes: DataFrame, by: Sequence[str] = (), hash_col: str = "dhash", max_distance: int = 4,
    blocks: int | None = None, hot: int = 4000,
) -> DataFrame:
    """Distinct hash pairs ``a < b`` within ``max_distance``; exact recall, no cross join.

    Hashes are made distinct first, so copies never multiply. Bands are chosen blocks of bits: more blocks give
    longer keys and fewer false candidates at the price of more keys per hash; their number follows from the count of hashes. A band value shared by more than
    ``hot`` hashes would still pair quadratically; its hashes are instead joined through the ball of values within
    half the distance, where a key meets at most the hashes of that ball, about two thousand for distance 4.
    """
    distinct = cut_lineage(hashes.select(*by, F.col(hash_col).cast("long").alias("h")).where("h IS NOT NULL").distinct())
    blocks = blocks or band_blocks(distinct.count(), max_distance)
    masks = [_signed(m) for m in _band_masks(max_distance, blocks)]
    bands = F.array(*[F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    keyed = distinct.select(*by, "h", F.posexplode(bands).alias("_no", "_band"))
    keys = [*by, "_no", "_band"]
    crowded = keyed.groupBy(*keys).count().where(F.col("count") > hot).select(*keys)
    calm = keyed.join(crowded, keys, "left_anti")
    packed = keyed.join(crowded, keys, "left_semi").select(*by, "h").distinct()
    balls = packed.select(*by, "h", F.explode(_ball(F.col("h"), (max_distance + 1) // 2)).alias("_near"))
    found = _pairs(calm, keys, max_distance).union(_pairs(balls, [*by, "_near"], max_distance))
    return found.distinct().withColumn("distance", hamming(F.col("a"), F.col("b")))


def hamming_join(hashes: DataFrame, by: Sequence[str] = (), hash_col: str = "dhash", max_distance: int = 4) -> DataFrame:
    """Near pairs of distinct hashes ``a < b`` with their distance; :func:`hash_members` says which contents have a hash.

    Contents of one hash are never paired with each other: m of them would be m * m / 2 rows.
    """
    return hamming_pairs(hashes, by, hash_col, max_distance)


def hash_members(
    hashes: DataFrame, by: Sequence[str] = (), hash_col: str = "dhash", digest: str = "file_hash"
) -> DataFrame:
    """``by..., hash, digest`` once per content: the other half of :func:`hamming_join`."""
    return hashes.select(*by, F.col(hash_col).cast("long").alias("h"), digest).where("h IS NOT NULL").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node of the component) from edges ``a, b``.

    Alternates large-star and small-star steps: every round hooks neighbours to the smallest node they know, so
    rounds grow with the logarithm of the longest path. Each round is checkpointed, which bounds the plan and
    lets a lost executor be recovered from files.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = cut_lineage(both)
    state = _fingerprint(current)
    while True:
        large = _large_star(current)
        current = cut_lineage(_small_star(large))
        new_state = _fingerprint(current)
        if new_state == state:
            break
        state = new_state
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    arcs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = arcs.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node itself, to the smallest of them."""
    arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = arcs.groupBy("u").agg(F.min("v").alias("m"))
    moved = arcs.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def near_duplicate_clusters(
    images: DataFrame, by: Sequence[str] = (), hash_col: str = "dhash", digest: str = "file_hash", max_distance: int = 4
) -> DataFrame:
    """Images of clusters that hold at least two different contents, with the cluster's smallest hash.

    The graph is over distinct hashes: all images of a hash share its component, so its size never depends on
    how many copies exist. ``images`` should be narrow (ids, digest, hash): it is materialised once so that
    file bytes are not read again by each step.
    """
    def node(h: str) -> Column:
        return F.struct(*by, h) if by else F.col(h)

    images = cut_lineage(images)
    hashes = images.select(*by, F.col(hash_col).alias("h"), digest)
    sizes = hashes.distinct().groupBy(*by, "h").agg(F.count(F.lit(1)).alias("contents"))
    pairs = hamming_pairs(images, by, hash_col, max_distance)
    edges = pairs.select(
        F.struct(*by, F.col("a").alias("h")).alias("a") if by else F.col("a"),
        F.struct(*by, F.col("b").alias("h")).alias("b") if by else F.col("b"),
    )
    components = connected_components(edges)
    placed = sizes.withColumn("node", node("h")).join(components, "node", "left")
    smallest = F.col("component")["h"] if by else F.col("component")
    placed = placed.withColumn("cluster", F.coalesce(smallest, "h"))
    kept = placed.groupBy(*by, "cluster").agg(F.sum("contents").alias("contents")).where("contents > 1")
    members = placed.select(*by, "h", "cluster").join(kept, [*by, "cluster"])
    return images.join(members.withColumnRenamed("h", hash_col), [*by, hash_col])


def near_duplicate_summary(clusters: DataFrame, images: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clusters, files and ratio per dataset."""
    one = F.lit(1)
    marked = clusters.select(*by, "cluster", one.alias("_near")).unionByName(
        images.select(*by, F.lit(None).cast("long").alias("cluster"), F.lit(0).alias("_near"))
    )
    rows = marked.groupBy(*by).agg(
        F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("_near") == 1).alias("files"),
        F.count_if(F.col("_near") == 0).alias("images"),
    )
    return rows.withColumn("ratio", F.round(F.col("files") / F.col("images"), 4))
