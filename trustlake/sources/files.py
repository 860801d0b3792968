"""File catalogues: paths, sizes, digests and image headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.constants import IMAGE_EXTENSIONS
from trustlake.functions.binary import image_header
from trustlake.functions.text import extension


def open_file(path: str):
    """A file that can seek, opened in a task through Arrow file systems."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:") else path)
    return system.open_input_file(inner)


def relative(path: Column, root: str) -> Column:
    """Path below ``root`` without scheme; both may carry one."""
    base = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    plain = F.regexp_replace(path, "^[a-zA-Z0-9]+:/*", "/")
    return F.when(plain.startswith(base), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain)


def split_dataset(path: Column, nested: bool, dataset_id: str) -> tuple[Column, Column]:
    """(dataset id, path inside the dataset): the first folder when ``nested``, else one dataset."""
    if not nested:
        return F.lit(dataset_id), path
    return F.substring_index(path, "/", 1), F.regexp_replace(path, "^[^/]*/", "")


def file_listing(spark: SparkSession, root: str, nested: bool = False, dataset_id: str = "dataset") -> DataFrame:
    """``dataset_id, path, size_bytes`` of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    dataset, inner = split_dataset(relative(F.col("path"), root), nested, dataset_id)
    return files.select(dataset.alias("dataset_id"), inner.alias("path"), F.col("length").alias("size_bytes"))


def file_digests(spark: SparkSession, root: str, nested: bool = False, dataset_id: str = "dataset", glob: str = "*") -> DataFrame:
    """``dataset_id, path, digest, size_bytes``; digest is SHA-256 of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    dataset, inner = split_dataset(relative(F.col("path"), root), nested, dataset_id)
    return files.select(dataset.alias("dataset_id"), inner.alias("path"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size_bytes"))


def image_catalog(
    spark: SparkSession, root: str, nested: bool = False, dataset_id: str = "dataset", keep_content: bool = False
) -> DataFrame:
    """Images with digest, size and header: ``dataset_id, path, file_hash, file_size_bytes, width, height, format``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    images = files.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS))
    dataset, inner = split_dataset(relative(F.col("path"), root), nested, dataset_id)
    rows = images.select(
        dataset.alias("dataset_id"), inner.alias("path"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size_bytes"),
        image_header(F.col("content")).alias("_head"), *([F.col("content")] if keep_content else []),
    )
    tail = ["content"] if keep_content else []
    return rows.select("dataset_id", "path", "file_hash", "file_size_bytes", "_head.width", "_head.height", "_head.format", *tail)
