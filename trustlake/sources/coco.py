"""COCO manifests to image, annotation, class and dataset tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.constants import SPLIT_NAMES
from trustlake.functions.geometry import box_from_xywh
from trustlake.functions.text import basename, folder
from trustlake.operators.ingest import attach_class_names, namespaced_id, resolve_files, split_of
from trustlake.session import cut_lineage
from trustlake.sources.files import relative, split_dataset
from trustlake.sources.jsonranges import RANGE, JsonFiles, scan_json

IMAGE_FIELDS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()), T.StructField("source_metadata", T.MapType(T.StringType(), T.StringType())),
])
ANNOTATION_FIELDS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("image_id", T.StringType()), T.StructField("category_id", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("area", T.DoubleType()), T.StructField("score", T.DoubleType()),
    T.StructField("iscrowd", T.IntegerType()), T.StructField("segmentation", T.StringType()),
])
CATEGORY_FIELDS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
MANIFEST = T.StructType([
    T.StructField("info", T.StructType([T.StructField("contributor", T.StringType())])), T.StructField("images", T.ArrayType(IMAGE_FIELDS)),
    T.StructField("annotations", T.ArrayType(ANNOTATION_FIELDS)), T.StructField("categories", T.ArrayType(CATEGORY_FIELDS)),
])


@dataclass(frozen=True)
class AnnotatedTables:
    images: DataFrame
    annotations: DataFrame
    classes: DataFrame
    datasets: DataFrame


def _manifests(spark: SparkSession, root: str, nested: bool, dataset_id: str) -> DataFrame:
    raw = (
        spark.read.schema(MANIFEST).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json").json(root).withColumn("_file", F.col("_metadata.file_path"))
    )
    raw = raw.unionByName(_underscored(spark, root, nested))
    dataset, inner = split_dataset(relative(F.col("_file"), root), nested, dataset_id)
    return raw.withColumn("dataset_id", dataset).withColumn("manifest", inner)


def _hidden_manifests(spark: SparkSession, root: str, nested: bool) -> list:
    """File states of manifests named ``_annotations.coco.json``; one per split folder."""
    jvm = spark.sparkContext._jvm
    pattern = root.rstrip("/") + ("/*" if nested else "") + "/{" + ",".join(SPLIT_NAMES) + "}/_annotations.coco.json"
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []


def _underscored(spark: SparkSession, root: str, nested: bool) -> DataFrame:
    """Manifests named ``_annotations.coco.json``, which Spark's own readers skip as hidden files.

    The driver lists their names (one per split folder); tasks read and parse them.
    """
    found = _hidden_manifests(spark, root, nested)
    names = spark.createDataFrame([(f.getPath().toUri().toString(),) for f in found], "_file string")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for name in pdf["_file"]:
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_stream(inner) as stream:
                    yield pd.DataFrame({"_file": [name], "_text": [stream.read().decode()]})

    text = names.repartition(max(1, len(found))).mapInPandas(load, "_file string, _text string")
    parsed = text.select("_file", F.from_json("_text", MANIFEST).alias("m"))
    return parsed.select("m.*", "_file")


def discover_manifests(manifests: DataFrame) -> DataFrame:
    """Manifests in use per dataset, with split and folder: split folders first, then annotations/, then the root.

    Works on paths only; at most one manifest per split folder, standard names before any other.
    """
    is_coco = F.col("images").isNotNull() & (F.col("annotations").isNotNull() | F.col("categories").isNotNull())
    rows = manifests.where(is_coco).select("dataset_id", "manifest")
    here, name = folder(F.col("manifest")), basename(F.col("manifest"))
    level = F.when(here.isin(*SPLIT_NAMES), 1).when(here == "annotations", 2).when(here == "", 3)
    instances = F.concat(F.lit("instances_"), here, F.lit(".json"))
    rank = F.when(name == "_annotations.coco.json", 0).when(name == instances, 1).when(name == "instances.json", 2).when(name == "annotations.json", 3).otherwise(4)
    standard = name.isin(*[f"instances_{s}.json" for s in SPLIT_NAMES])
    rows = rows.withColumn("_level", level).where("_level IS NOT NULL").withColumn("manifest_dir", here)
    per_dataset = W.partitionBy("dataset_id")
    rows = rows.withColumn("_best", F.min("_level").over(per_dataset)).where("_level = _best")
    per_folder = W.partitionBy("dataset_id", "manifest_dir").orderBy(rank, "manifest")
    rows = rows.withColumn("_rn", F.row_number().over(per_folder)).withColumn("_std", standard)
    rows = rows.withColumn("_any", F.bool_or("_std").over(per_dataset))
    rows = rows.where(F.when(F.col("_level") == 1, F.col("_rn") == 1).otherwise(~F.col("_any") | F.col("_std")))
    order = W.partitionBy("dataset_id").orderBy("manifest")
    return rows.select(
        "dataset_id", "manifest", "manifest_dir", split_of(F.col("manifest")).alias("split"), F.row_number().over(order).alias("manifest_no"),
        F.count(F.lit(1)).over(per_dataset).alias("manifests"), F.bool_or(F.col("_level") == 1).over(per_dataset).alias("split_folder"),
    )


_PLACE = ["dataset_id", "manifest", "manifest_dir", "split", "manifest_no", "manifests", "split_folder"]


def read_coco(spark: SparkSession, root: str, nested: bool = False, dataset_id: str = "dataset", files: DataFrame | None = None) -> AnnotatedTables:
    """Read every dataset below ``root`` (one per folder when ``nested``).

    ``files`` is a catalogue as from ``image_catalog``; with it images get path, digest and size, and images
    without a file are dropped. One manifest is parsed by one task; :func:`read_coco_ranges` reads large manifests
    by many.
    """
    manifests = _manifests(spark, root, nested, dataset_id)
    used = discover_manifests(manifests)
    rows = manifests.join(used, ["dataset_id", "manifest"])
    images = rows.select(*_PLACE, F.explode("images").alias("i"))
    annotations = rows.select(*_PLACE, F.posexplode("annotations").alias("_pos", "a"))
    annotations = annotations.withColumn("ann_ord", F.col("manifest_no").cast("long") * F.lit(1 << 40) + F.col("_pos"))
    categories = rows.select(*_PLACE, F.explode("categories").alias("c"))
    return _finish(*_tables(images, annotations, categories, rows), files)


def read_coco_ranges(
    spark: SparkSession, root: str, nested: bool = False, dataset_id: str = "dataset", files: DataFrame | None = None, range_bytes: int = RANGE,
) -> AnnotatedTables:
    """The tables of :func:`read_coco`, each manifest read by one task per ``range_bytes``; a manifest of any size is never held whole.

    ``ann_ord`` counts bytes in place of annotations: the order is the same. ``segmentation`` is JSON without spaces.
    A broken manifest yields nothing.
    """
    files_of = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    listed = files_of.select("path", F.col("length").alias("size_bytes"))
    hidden = [(f.getPath().toUri().toString(), f.getLen()) for f in _hidden_manifests(spark, root, nested)]
    listed = listed.union(spark.createDataFrame(hidden, "path string, size_bytes long"))
    found = scan_json(listed, range_bytes)
    has = lambda key: F.max(F.when((F.col("key") == key) & (F.col("kind") == "["), True)).alias(key)
    dataset, inner = split_dataset(relative(F.col("path"), root), nested, dataset_id)
    manifests = found.members.groupBy("path").agg(has("images"), has("annotations"), has("categories"))
    manifests = cut_lineage(manifests.withColumn("dataset_id", dataset).withColumn("manifest", inner))
    used = manifests.select("path", "dataset_id", "manifest").join(discover_manifests(manifests), ["dataset_id", "manifest"])
    used = cut_lineage(used.select("path", *_PLACE))
    chosen = JsonFiles(found.ranges.join(used.select("path"), "path", "left_semi"), found.members)

    def parsed(key: str, fields: T.StructType, name: str) -> DataFrame:
        rows = chosen.elements(key).select("path", "place", F.from_json("text", fields).alias(name))
        return rows.join(used, "path")

    annotations = parsed("annotations", ANNOTATION_FIELDS, "a")
    annotations = annotations.withColumn("ann_ord", F.col("manifest_no").cast("long") * F.lit(1 << 44) + F.col("place"))
    info = used.join(parsed("info", MANIFEST["info"].dataType, "info").select("path", "info"), "path", "left")
    return _finish(*_tables(parsed("images", IMAGE_FIELDS, "i"), annotations, parsed("categories", CATEGORY_FIELDS, "c"), info), files)


def _tables(images: DataFrame, annotations: DataFrame, categories: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Images, annotations, categories and datasets from parsed records ``i``, ``a``, ``c`` and ``info`` with the place of their manifest."""
    named = lambda raw: namespaced_id(raw, F.col("split"), F.col("manifests"), F.col("split_folder"))
    images = images.select(
        "dataset_id", named(F.col("i.id")).alias("image_id"), F.col("i.id").alias("raw_id"), "split", "manifest_dir", "manifest",
        "i.file_name", "i.width", "i.height", "i.source_metadata",
    )
    annotations = annotations.select(
        "dataset_id", named(F.col("a.id")).alias("annotation_id"), named(F.col("a.image_id")).alias("image_id"), "ann_ord", F.col("a.category_id").alias("class_id"),
        F.col("a.bbox").alias("pixel_box"), "a.area", F.col("a.score").alias("confidence"), F.coalesce("a.iscrowd", F.lit(0)).alias("iscrowd"), "a.segmentation",
    )
    categories = categories.select("dataset_id", "manifest_no", F.col("c.id").alias("class_id"), F.col("c.name").alias("class_name"))
    datasets = manifests.select("dataset_id", "manifest_no", F.col("info.contributor").alias("contributor")).groupBy("dataset_id").agg(
        F.min_by("contributor", F.when(F.coalesce("contributor", F.lit("")) != "", F.col("manifest_no"))).alias("contributor_id")
    ).withColumn("format_origin", F.lit("coco"))
    return images, annotations, categories, datasets


def _finish(images: DataFrame, annotations: DataFrame, categories: DataFrame, datasets: DataFrame, files: DataFrame | None) -> AnnotatedTables:
    if files is not None:
        side = files.select("dataset_id", F.col("path").alias("resolved_path"), "file_hash", "file_size_bytes", F.col("width").alias("_w"), F.col("height").alias("_h"))
        images = resolve_files(images, files).where("resolved_path IS NOT NULL").join(side, ["dataset_id", "resolved_path"])
        declared = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
        size = lambda own, head: F.when(declared, F.col(own)).when(F.col(head) > 0, F.col(head)).when(F.col(own) > 0, F.col(own)).otherwise(1)
        images = images.select(
            "dataset_id", "image_id", "raw_id", "split", "file_name", "manifest_dir", F.col("resolved_path").alias("file_path"), "file_hash", "file_size_bytes",
            size("width", "_w").alias("width"), size("height", "_h").alias("height"), "source_metadata",
        )
    names = categories.groupBy("dataset_id", "class_id").agg(F.max_by("class_name", "manifest_no").alias("class_name"))
    sizes = images.select("dataset_id", "image_id", "width", "height").dropDuplicates(["dataset_id", "image_id"])
    boxed = annotations.join(sizes, ["dataset_id", "image_id"], "left").withColumn(
        "bbox", box_from_xywh(F.col("pixel_box"), F.coalesce("width", F.lit(1)), F.coalesce("height", F.lit(1)))
    ).drop("width", "height")
    boxed = attach_class_names(boxed, names)
    counts = annotations.groupBy("dataset_id", "class_id").agg(F.count(F.lit(1)).alias("count"))
    classes = names.join(counts, ["dataset_id", "class_id"], "left").fillna(0, ["count"])
    return AnnotatedTables(images, boxed, classes, datasets)


def read_coco_lines(spark: SparkSession, images: str, annotations: str, categories: str, dataset_id: str = "dataset") -> AnnotatedTables:
    """The same tables from JSON lines, one record per line: splits over any number of tasks."""
    tag = F.lit(dataset_id).alias("dataset_id")
    i = spark.read.schema(IMAGE_FIELDS).json(images).select(
        tag, F.col("id").alias("image_id"), F.col("id").alias("raw_id"), F.lit(None).cast("string").alias("split"), F.lit("").alias("manifest_dir"),
        F.lit("").alias("manifest"), "file_name", "width", "height", "source_metadata",
    )
    a = spark.read.schema(ANNOTATION_FIELDS).json(annotations).select(
        tag, F.col("id").alias("annotation_id"), "image_id", F.monotonically_increasing_id().alias("ann_ord"), F.col("category_id").alias("class_id"),
        F.col("bbox").alias("pixel_box"), "area", F.col("score").alias("confidence"), F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"), "segmentation",
    )
    c = spark.read.schema(CATEGORY_FIELDS).json(categories).select(tag, F.lit(1).alias("manifest_no"), F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    datasets = c.select("dataset_id").distinct().withColumn("contributor_id", F.lit(None).cast("string")).withColumn("format_origin", F.lit("coco"))
    return _finish(i, a, c, datasets, None)
