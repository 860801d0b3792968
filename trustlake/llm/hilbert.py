"""Sharding along a Hilbert curve over quantised metadata, for files that prune on several columns at once.

Every dimension is scaled between its smallest and largest value and quantised to ``bits`` bits; the cells of the
grid (at most ``2 ** (bits * dimensions)``, a bound that does not grow with the rows) are numbered along the curve,
and the ordered rows are cut into shards of equal bytes or equal counts. Nearby shards cover nearby metadata, so
that minimum and maximum of each column prune files for a filter on any of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.llm.common import stage, text_crc32, utf8_bytes

SEED = 0x51A2D


def curve_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of integer coordinates.

    Coordinates are turned into the transposed Gray form level by level (the rotation of each sub-cube undoes the
    one above it), then the bits are interleaved from the most significant level down.
    """
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            flip = (x[d] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= fix
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> level) & 1)
    return index


def leading_number(text: Column, skip: int) -> Column:
    """Six bytes after a common prefix of ``skip`` bytes as a number; keeps the byte order of the strings."""
    head = F.rpad(F.hex(F.substring(text.cast("binary"), skip + 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _common_prefix(a: str | None, b: str | None) -> int:
    a, b = (a or "").encode(), (b or "").encode()
    size = 0
    while size < min(len(a), len(b)) and a[size] == b[size]:
        size += 1
    return size


def hilbert_shards(
    docs: DataFrame, dims: Mapping[str, Column], shards: int = 16, law: str = "bytes", bits: int = 4,
    id_col: str = "doc_id", text_col: str = "text", cuts: int = 1024,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` plus ``curve_index`` and one ``cell_<name>`` per dimension.

    ``law`` is ``bytes`` (a shard takes the rows whose middle byte falls into its share, so its size is off by one row
    at most) or ``rows`` (counts differ by one at most). String dimensions are ordered by their bytes behind the common
    prefix. Within a cell rows are ordered by a seeded hash of id and text, and a cell that holds more than one part in
    ``cuts`` of all rows is split by that hash, so no cell, source or group of copies is ever one task.

    Nulls: a null dimension has the lowest coordinate; a null text has size 1 and the checksum of the empty text; a null
    id is a row like others. Repeated rows keep their own slots. An empty table gives an empty result. Columns of ``docs``
    other than the ones used play no part, whatever their names.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law}")
    names = list(dims)
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (utf8_bytes(text) + 1).alias("size"), text_crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(SEED), F.col(id_col), text).alias("_draw"), *[c.alias(f"_d{i}") for i, c in enumerate(dims.values())],
    )
    rows = stage(slim, "hilbert")
    kinds = dict(rows.dtypes)
    strings = [f"_d{i}" for i in range(len(names)) if kinds[f"_d{i}"] == "string"]
    if strings:
        ends = rows.agg(*[f(c).alias(f"{f.__name__}{c}") for c in strings for f in (F.min, F.max)]).first()
        rows = rows.withColumns({c: leading_number(F.col(c), _common_prefix(ends[f"min{c}"], ends[f"max{c}"])) for c in strings})
    scale = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
        *[f(F.col(f"_d{i}").cast("double")).alias(f"{f.__name__}{i}") for i in range(len(names)) for f in (F.min, F.max)],
    ).first()
    steps = (1 << bits) - 1

    def cell(i: int) -> Column:
        low, high = scale[f"min{i}"], scale[f"max{i}"]
        if low is None:
            return F.lit(0)
        share = (F.col(f"_d{i}").cast("double") - low) / ((high - low) or 1.0)
        return F.when(F.col(f"_d{i}").isNull(), 0).otherwise(1 + F.least(F.floor(share * steps), F.lit(steps - 1))).cast("int")

    cells = [f"cell_{n}" for n in names]
    rows = rows.select("doc_id", "size", "text_crc32", "_draw", *[cell(i).alias(c) for i, c in enumerate(cells)])
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    total = (scale["bytes"] if law == "bytes" else scale["n"]) or 1

    @F.pandas_udf("long")
    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(curve_index(batch.to_numpy(), bits))

    grid = rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).select(
        *cells, along(F.struct(*cells)).alias("curve_index"), F.ceil(F.col("_n") * cuts / max(1, scale["n"])).alias("_parts"),
    )
    # At most 2 ** (bits * dims) cells of a few numbers each: the size of this broadcast does not depend on the rows.
    placed = rows.join(F.broadcast(grid), cells).withColumn("_w", weight).withColumn(
        "_part", F.floor(F.shiftrightunsigned("_draw", 33) * F.col("_parts") / F.lit(1 << 31)).cast("int")
    )
    bucket = ["curve_index", "_part"]
    order = [F.shiftrightunsigned("_draw", 1), "_draw", "doc_id", "text_crc32"]
    earlier = W.partitionBy(*bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # One row per bucket: no more than cells + cuts rows.
    starts = placed.groupBy(*bucket).agg(F.sum("_w").alias("_tw"), F.count(F.lit(1)).alias("_tn")).select(
        *bucket, F.coalesce(F.sum("_tw").over(before), zero).alias("_bw"), F.coalesce(F.sum("_tn").over(before), zero).alias("_bn"),
    )
    ranked = placed.select(
        "*", F.coalesce(F.sum("_w").over(earlier), zero).alias("_iw"), F.count(F.lit(1)).over(earlier).alias("_in"),
    ).join(F.broadcast(starts), bucket)
    middle = 2 * (F.col("_bw") + F.col("_iw")) + F.col("_w") - (1 if law == "rows" else 0)
    done = stage(ranked.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"),
        F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(38,0)"))).cast("int").alias("shard"),
        (F.col("_bn") + F.col("_in")).alias("_rank"), "curve_index", *cells,
    ), "hilbert-ranks")
    first = done.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return done.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("_rank") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve_index", *cells,
    )


def shard_manifest(placed: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, bytes and the covered cells of each shard: what a reader prunes on."""
    return placed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.min("curve_index").alias("first_index"),
        F.max("curve_index").alias("last_index"),
        *[f(f"cell_{d}").alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)],
    )


def write_shards(docs: DataFrame, placed: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` in curve order under ``folder/shard=<n>``; rows of a null id stay out, as they cannot be looked up."""
    keys = placed.select(F.col("doc_id").alias("_id"), F.col("shard"), F.col("slot").alias("_slot"))
    rows = docs.join(keys, docs[id_col] == keys["_id"]).drop("_id")
    rows.repartitionByRange("shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(folder)
