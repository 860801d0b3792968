"""YOLO label folders to image, annotation and class tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.functions.geometry import box_from_centre, polygon_envelope
from trustlake.operators.ingest import all_classes, attach_class_names, pair_images_labels, parse_label_line
from trustlake.sources.coco import AnnotatedTables
from trustlake.sources.files import file_listing, relative, split_dataset


def read_label_lines(spark: SparkSession, root: str, nested: bool = False, dataset_id: str = "dataset") -> DataFrame:
    """``dataset_id, label_path, line_no, line``. A label file describes one image, so it is read whole to number its lines."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    dataset, inner = split_dataset(relative(F.col("_file"), root), nested, dataset_id)
    lines = F.split("value", "\r\n|\r|\n")
    return raw.select(dataset.alias("dataset_id"), inner.alias("label_path"), F.posexplode(lines).alias("_pos", "line")).select(
        "dataset_id", "label_path", (F.col("_pos") + 1).alias("line_no"), "line"
    )


def read_yolo(
    spark: SparkSession, root: str, names: DataFrame | None = None, nested: bool = False, dataset_id: str = "dataset",
    files: DataFrame | None = None, contributors: DataFrame | None = None,
) -> AnnotatedTables:
    """Read datasets below ``root``. ``names(dataset_id, class_id, class_name)`` and
    ``contributors(dataset_id, contributor_id)`` come from the caller's configuration files.

    Lines that do not parse are skipped; :func:`trustlake.operators.ingest.label_violations` reports them.
    """
    listing = file_listing(spark, root, nested, dataset_id)
    images = pair_images_labels(listing).withColumnRenamed("image_path", "file_path")
    if files is not None:
        side = files.select("dataset_id", F.col("path").alias("file_path"), "file_hash", "file_size_bytes", "width", "height")
        known = images.join(side, ["dataset_id", "file_path"], "left")
        images = known.withColumns({n: F.when(F.coalesce(n, F.lit(0)) > 0, F.col(n)).otherwise(640) for n in ("width", "height")})
    lines = read_label_lines(spark, root, nested, dataset_id).where(F.trim("line") != "")
    lines = lines.withColumns({f"_{k}": v for k, v in parse_label_line(F.col("line")).items()})
    coords = F.col("_coords")
    usable = (F.col("_tokens") >= 5) & F.col("_class_id").isNotNull() & ~F.exists(coords, lambda v: v.isNull())
    at = lambda i: F.try_element_at(coords, F.lit(i))
    box = F.when(F.size(coords) == 4, box_from_centre(at(1), at(2), at(3), at(4))).otherwise(polygon_envelope(coords))
    polygon = F.when((F.size(coords) >= 6) & (F.size(coords) % 2 == 0), coords)
    rows = lines.where(usable).join(images.where("label_path IS NOT NULL").select("dataset_id", "label_path", "image_id"), ["dataset_id", "label_path"])
    annotations = rows.select(
        "dataset_id", F.concat_ws("_", "image_id", F.lit("ann"), "line_no").alias("annotation_id"), "image_id", F.col("line_no").cast("long").alias("ann_ord"),
        F.col("_class_id").alias("class_id"), box.alias("bbox"), polygon.alias("segmentation"),
    )
    if names is None:
        names = spark.createDataFrame([], "dataset_id string, class_id int, class_name string")
    datasets = images.select("dataset_id").distinct().withColumn("format_origin", F.lit("yolo"))
    if contributors is None:
        datasets = datasets.withColumn("contributor_id", F.lit(None).cast("string"))
    else:
        datasets = datasets.join(contributors, "dataset_id", "left")
    return AnnotatedTables(images, attach_class_names(annotations, names), all_classes(names, annotations), datasets)
