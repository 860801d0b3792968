"""Paging through a large table: rows stored in ranges of their order, an index of the ranges, and tokens.

Sorting all rows for every page puts a deep offset in one place. Here the rows are dealt once into ranges of the order, each
sorted and stored as a folder of its own; the index says how many rows lie before each. A page reads the ranges that hold it, one
or two, and a token continues behind the last row seen whatever was stored before it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.operators.scan import with_running


def write_pages(df: DataFrame, order: Sequence[str], folder: str, rows_per_range: int = 50_000) -> PageIndex:
    """Store ``df`` under ``folder`` by ranges of ``order`` (ascending, nulls first; total over the rows) and index them."""
    total = df.count()
    parts = max(1, -(-total // rows_per_range))
    dealt = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    # Adaptive execution could join neighbouring ranges, but never reorders them, so the numbers stay in order.
    dealt.sortWithinPartitions(*order).write.partitionBy("_range").parquet(f"{folder}/rows")
    spark = df.sparkSession
    index = PageIndex(spark, folder, tuple(order), df.schema)
    stored = index.stored()
    ends = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct(*order)).alias("last")).withColumn("_all", F.lit(0))
    with_running(ends, ["_all"], "_range", {"before": ("sum", F.col("rows"))}).select(
        "_range", "rows", F.coalesce("before", F.lit(0)).cast("long").alias("before"), "last"
    ).write.parquet(f"{folder}/index")
    return index


def _behind(order: Sequence[str], values: Sequence[object], schema: T.StructType) -> Column:
    """Rows after ``values`` in the order: the first differing column is greater; null is the least."""
    test: Column = F.lit(False)
    for name, value in zip(reversed(order), reversed(values)):
        column, given = F.col(name), F.lit(value).cast(schema[name].dataType)
        test = (column.isNotNull() if value is None else column > given) | (column.eqNullSafe(given) & test)
    return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class PageIndex:
    spark: SparkSession
    folder: str
    order: tuple[str, ...]
    schema: T.StructType

    def stored(self) -> DataFrame:
        fields = [*self.schema.fields, T.StructField("_range", T.IntegerType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(f"{self.folder}/rows")

    def _index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    def _rows(self, ranges: Sequence[int]) -> DataFrame:
        return self.stored().where(F.col("_range").isin(list(ranges))).drop("_range")

    def total(self) -> int:
        return self._index().agg(F.sum("rows")).first()[0] or 0

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, from the ranges that hold them; ``limit`` is from 1 to 1000."""
        if not (1 <= limit <= 1000 and offset >= 0):
            raise ValueError("limit must be 1..1000 and offset not negative")
        held = self._index().where((F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)).select("_range", "before").collect()
        skip = offset - min((r["before"] for r in held), default=offset)
        return self._rows([r["_range"] for r in held]).orderBy(*self.order).offset(skip).limit(limit)

    def token(self, row) -> str:
        """Where to go on after ``row``; text that may leave the system."""
        return base64.urlsafe_b64encode(json.dumps([row[c] for c in self.order], default=str).encode()).decode()

    def after(self, token: str | None, limit: int = 100) -> DataFrame:
        """The ``limit`` rows behind a token, the first ones without."""
        if token is None:
            return self.page(limit)
        if not 1 <= limit <= 1000:
            raise ValueError("limit must be 1..1000")
        values = json.loads(base64.urlsafe_b64decode(token))
        index = self._index()
        last = index.select("_range", "rows", "last.*")
        # Ranges that end behind the token, as many as may be needed: the first may hold few rows behind it, the others are whole.
        near = last.where(_behind(self.order, values, self.schema)).orderBy("_range").limit(limit + 1).select("_range", "rows").collect()
        chosen, whole = [], 0
        for k, r in enumerate(near):
            if k and whole >= limit:
                break
            chosen.append(r["_range"])
            whole += r["rows"] if k else 0
        return self._rows(chosen).where(_behind(self.order, values, self.schema)).orderBy(*self.order).limit(limit)
