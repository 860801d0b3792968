"""Writers: replace by key, write once, content addressed, evidence bundles."""

from __future__ import annotations

import json
from collections.abc import Sequence
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trustlake.session import cut_lineage

PARTS = 256


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


LAYOUT = "_layout"


def _hold_layout(spark: SparkSession, path: str, layout: dict) -> None:
    """Store ``layout`` in the table's folder once (readers skip the file by its name), or compare it with the stored one."""
    name = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LAYOUT}")
    system = name.getFileSystem(spark._jsc.hadoopConfiguration())
    told = json.dumps(layout, sort_keys=True)
    if system.exists(name):
        with closing(system.open(name)) as stream:
            stored = bytes(stream.readAllBytes()).decode()
        if stored != told:
            raise ValueError(f"the table was made with {stored}, not {told}")
        return
    with closing(system.create(name, False)) as stream:
        stream.write(bytearray(told.encode()))


def upsert(df: DataFrame, path: str, keys: Sequence[str], order: str, parts: int = PARTS) -> None:
    """Insert or replace by key; the highest ``order`` wins, new rows win ties.

    Rows live in hash partitions of their key and only partitions with new rows are rewritten. The number of partitions and the keys are
    stored beside the table when it is made; a later call with other ones is refused, for it would leave old rows beside new ones.
    """
    _hold_layout(df.sparkSession, path, {"parts": parts, "keys": list(keys)})
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    new = df.withColumn("_part", part).withColumn("_new", F.lit(1))
    old = _existing(df.sparkSession, path)
    merged = new
    if old is not None:
        touched = [r[0] for r in new.select("_part").distinct().collect()]  # at most ``parts`` numbers
        merged = new.unionByName(old.where(F.col("_part").isin(touched)).withColumn("_new", F.lit(0)), allowMissingColumns=True)
    latest = W.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    rows = merged.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "_new")
    rows = cut_lineage(rows)  # the target is read above and written below
    rows.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)


class ImmutableError(ValueError):
    """A write-once key already exists."""


def append_immutable(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key is new; any known or repeated key rejects the whole batch before a row is written."""
    doubled = df.groupBy(key).count().where("count > 1").select(key)
    old = _existing(df.sparkSession, path)
    known = doubled if old is None else doubled.union(df.select(key).join(old.select(key), key, "left_semi"))
    clash = known.first()
    if clash is not None:
        raise ImmutableError(f"{key} {clash[0]!r} already exists and is immutable")
    df.write.mode("append").parquet(path)


def write_by_digest(df: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Store each distinct content once under its SHA-256 prefix; returns ``digest, rel_path`` of the input."""
    digest = F.sha2(content, 256)
    rows = df.select(digest.alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"])
    rows = rows.withColumn("prefix", F.substring("digest", 1, 2))
    old = _existing(df.sparkSession, path)
    fresh = rows if old is None else rows.join(old.select("prefix", "digest"), ["prefix", "digest"], "left_anti")
    fresh = cut_lineage(fresh) if old is not None else fresh
    fresh.write.mode("append").partitionBy("prefix").parquet(path)
    rel = F.concat_ws("/", F.lit("objects"), F.substring("digest", 1, 2), F.substring("digest", 3, 62))
    return rows.select("digest", rel.alias("rel_path"))


class TamperError(ValueError):
    """The evidence store does not match its catalogue."""


def export_bundle(evidence: DataFrame, artifacts: DataFrame, reconciled: DataFrame, path: str) -> DataFrame:
    """Write evidence and artifacts as a directory with a per-file SHA-256 manifest, only when all is consistent.

    ``evidence(evidence_id, record_json)``; ``artifacts(path, content)``. Returns the manifest.
    """
    fault = reconciled.where("state <> 'ok'").first()
    if fault is not None:
        raise TamperError(f"cannot export: {fault['path']} is {fault['state']}")
    if evidence.isEmpty():
        raise FileNotFoundError("no evidence to export")
    files = evidence.select(
        F.concat(F.lit("evidence/"), "evidence_id", F.lit(".json")).alias("path"), F.encode("record_json", "UTF-8").alias("content")
    ).unionByName(artifacts.select("path", "content")).withColumn("sha256", F.sha2("content", 256))
    files.write.mode("errorifexists").parquet(f"{path}/files")
    manifest = evidence.sparkSession.read.parquet(f"{path}/files").select("path", "sha256")
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest
