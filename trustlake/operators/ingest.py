"""Structural checks and dimension joins of annotated image datasets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.constants import (
    CHECK_REQUIREMENTS, IMAGE_EXTENSIONS, IMAGE_FOLDERS, NON_LABEL_FILES, SPLIT_NAMES, YAML_NAMES,
)
from trustlake.functions.risk import case_of, check_state
from trustlake.functions.text import basename, clean_relative, extension, folder, stem

ERRORS = (
    "malformed_bbox", "non_positive_size", "too_few_tokens", "negative_class", "non_integer_class", "non_numeric_coordinate",
    "centre_out_of_range", "missing_id", "missing_name", "orphan_annotation", "unknown_category", "missing_file", "duplicate_image_id",
)


def coco_violations(annotations: DataFrame) -> DataFrame:
    """Box rules on pixel boxes ``bbox array<double>``: one row per violation with its level."""
    x, y, w, h = (F.try_element_at("bbox", F.lit(i)) for i in (1, 2, 3, 4))
    whole = F.size("bbox") == 4
    rules = [
        (F.col("bbox").isNotNull() & ~whole, "malformed_bbox"),
        (whole & ((w <= 0) | (h <= 0)), "non_positive_size"),
        (whole & ((x < 0) | (y < 0)), "negative_coordinate"),
    ]
    return _explode_rules(annotations, rules)


def _explode_rules(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in rules]))
    long = rows.select("*", F.explode(found).alias("code"))
    return long.withColumn("level", F.when(F.col("code").isin(*ERRORS), "error").otherwise("warning"))


def parse_label_line(line: Column) -> dict[str, Column]:
    """Class id and coordinates of a label line; null where a token does not parse."""
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    cid = F.try_element_at(parts, F.lit(1))
    coords = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: t.try_cast("double"))
    return {"tokens": F.size(parts), "class_id": F.when(cid.rlike(r"^[+-]?\d+$"), cid.try_cast("int")), "coords": coords}


def label_violations(labels: DataFrame, max_class: Column | None = None) -> DataFrame:
    """Rules on ``line`` of label files; a line stops at its first parse error, as a reader would."""
    rows = labels.where(F.trim("line") != "")
    for name, column in parse_label_line(F.col("line")).items():
        rows = rows.withColumn(f"_{name}", column)
    short, cid, coords = F.col("_tokens") < 5, F.col("_class_id"), F.col("_coords")
    has_null = F.exists(coords, lambda v: v.isNull() | F.isnan(v))
    parsed = ~short & cid.isNotNull() & ~has_null
    box = parsed & (F.size(coords) == 4)
    polygon = parsed & (F.size(coords) >= 6) & (F.size(coords) % 2 == 0)
    at = lambda i: F.try_element_at(coords, F.lit(i))
    rules = [
        (short, "too_few_tokens"), (~short & cid.isNull(), "non_integer_class"), (~short & (cid < 0), "negative_class"),
        (~short & cid.isNotNull() & has_null, "non_numeric_coordinate"), (box & ((at(3) <= 0) | (at(4) <= 0)), "non_positive_size"),
        (box & ~(at(1).between(0.0, 1.05) & at(2).between(0.0, 1.05)), "centre_out_of_range"),
        (polygon & F.exists(coords, lambda v: ~v.between(-0.05, 1.05)), "polygon_out_of_range"),
    ]
    if max_class is not None:
        rules.append((~short & (cid > max_class), "class_above_declared"))
    long = _explode_rules(rows, rules)
    return long.drop("_tokens", "_class_id", "_coords")


def category_violations(categories: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Entries without id or name, and ids that carry different names in different manifests."""
    missing = categories.where(F.col("class_id").isNull() | F.col("class_name").isNull()).select(
        *by, "class_id", F.when(F.col("class_id").isNull(), "missing_id").otherwise("missing_name").alias("code")
    )
    pairs = categories.where(F.col("class_id").isNotNull()).select(*by, "class_id", "class_name").distinct()
    clash = pairs.groupBy(*by, "class_id").agg(F.count("class_name").alias("_n")).where("_n > 1")
    return missing.unionByName(clash.select(*by, "class_id", F.lit("conflicting_names").alias("code")))


def duplicate_image_ids(images: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    counts = images.groupBy(*by, "image_id").agg(F.count(F.lit(1)).alias("copies"))
    return counts.where("copies > 1").withColumn("code", F.lit("duplicate_image_id"))


def orphan_annotations(annotations: DataFrame, images: DataFrame, classes: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Annotations whose image or class is not declared, with a code for each."""
    no_image = annotations.join(images.select(*by, "image_id").distinct(), [*by, "image_id"], "left_anti")
    no_class = annotations.join(classes.select(*by, "class_id").distinct(), [*by, "class_id"], "left_anti")
    return no_image.withColumn("code", F.lit("orphan_annotation")).unionByName(no_class.withColumn("code", F.lit("unknown_category")))


def unannotated_images(images: DataFrame, annotations: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    return images.join(annotations.select(*by, "image_id").distinct(), [*by, "image_id"], "left_anti")


def orphan_labels(labels: DataFrame, images: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Label files no image uses; files that are never labels are left out. Inputs carry ``label_path``."""
    candidates = labels.where(~F.lower(basename(F.col("label_path"))).isin(*NON_LABEL_FILES))
    return candidates.join(images.select(*by, "label_path").distinct(), [*by, "label_path"], "left_anti")


def resolve_files(images: DataFrame, files: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Add ``resolved_path`` of each declared ``file_name`` (null when missing).

    Order: beside the manifest (``manifest_dir``), at the root, in the usual folders, then any file of that
    name. ``files`` has ``path`` relative to the dataset root. Every candidate becomes one row and one equi-join
    resolves them all, by best rank.
    """
    name = clean_relative(F.col("file_name"))
    join = lambda base: F.when(F.coalesce(base, F.lit("")) == "", name).otherwise(F.concat_ws("/", base, name))
    # Equal places are asked for once, and only ranks move after the join: a path follows from its rank.
    places = F.array_distinct(F.array(join(F.col("manifest_dir")), name, *[join(F.lit(f)) for f in IMAGE_FOLDERS]))
    keyed = images.withColumn("_row", F.xxhash64(*by, "image_id", "file_name", "manifest_dir"))
    there = keyed.where(name.isNotNull())
    probes = there.select(*by, "_row", F.posexplode(places).alias("_rank", "path"))
    exact = probes.join(files.select(*by, "path"), [*by, "path"], "left_semi").select(*by, "_row", "_rank")
    named = files.select(*by, basename(F.col("path")).alias("_base"), "path").groupBy(*by, "_base").agg(F.min("path").alias("_any"))
    elsewhere = there.select(*by, "_row", basename(name).alias("_base")).join(named, [*by, "_base"]).select(*by, "_row", "_any")
    none = lambda kind, as_: F.lit(None).cast(kind).alias(as_)
    both = exact.select("*", none("string", "_any")).union(elsewhere.select(*by, "_row", none("int", "_rank"), "_any"))
    best = both.groupBy(*by, "_row").agg(F.min("_rank").alias("_rank"), F.min("_any").alias("_any"))
    rows = keyed.join(best, [*by, "_row"], "left")
    return rows.withColumn("resolved_path", F.coalesce(F.get(places, F.col("_rank")), F.col("_any"))).drop("_row", "_rank", "_any")


def split_of(path: Column) -> Column:
    """Split named by the parent folder, else contained in the file stem."""
    parent = F.lower(basename(folder(path)))
    name = F.lower(stem(path))
    expr = F.when(parent.isin(*SPLIT_NAMES), parent)
    for split in SPLIT_NAMES:
        expr = expr.when(name.contains(split), split)
    return expr


def namespaced_id(raw: Column, split: Column, manifests: Column, split_folder: Column) -> Column:
    """``{split}_{id}`` when a dataset has several manifests or split folders, else the id."""
    return F.when(split.isNotNull() & ((manifests > 1) | split_folder), F.concat_ws("_", split, raw.cast("string"))).otherwise(raw.cast("string"))


def pair_images_labels(files: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Images with their label file and split, by the first directory layout that holds any image.

    Layouts in order: images/{split} with labels/{split}; flat images/ and labels/; {split}/images with
    {split}/labels; label beside the image or in the sibling labels folder.
    """
    rows = files.select(*by, "path")
    images = rows.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS))
    parts = F.split("path", "/")
    depth = F.size(parts)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    has_labels = rows.groupBy(*by).agg(F.bool_or(F.col("path").startswith("labels/")).alias("_labels"))
    layout = (
        F.when((depth == 3) & (at(1) == "images"), 1).when((depth == 2) & (at(1) == "images") & F.col("_labels"), 2)
        .when((depth == 3) & (at(2) == "images"), 3).otherwise(4)
    )
    images = images.join(has_labels, list(by)).withColumn("_layout", layout)
    chosen = images.groupBy(*by).agg(F.min("_layout").alias("_chosen"))
    images = images.join(chosen, list(by)).where((F.col("_chosen") == 4) | (F.col("_layout") == F.col("_chosen")))
    leaf = F.concat(stem(F.col("path")), F.lit(".txt"))
    here = folder(F.col("path"))
    beside = F.when(here == "", leaf).otherwise(F.concat_ws("/", here, leaf))
    swapped = F.regexp_replace(here, "^(.*/)?images(/(?!(?:.*/)?images(?:/|$)).*)?$", "$1labels$2")
    sibling = F.when(here.rlike("(^|/)images(/|$)"), F.concat_ws("/", swapped, leaf))
    layout_no = F.col("_chosen")
    first = F.when(layout_no == 1, F.concat_ws("/", F.lit("labels"), at(2), leaf)).when(layout_no == 2, F.concat_ws("/", F.lit("labels"), leaf)).when(
        layout_no == 3, F.concat_ws("/", at(1), F.lit("labels"), leaf)
    ).otherwise(beside)
    parent, grand = F.lower(basename(here)), F.lower(basename(folder(here)))
    loose = F.when(parent.isin(*SPLIT_NAMES), parent).when(grand.isin(*SPLIT_NAMES), grand)
    split = F.when(layout_no == 1, at(2)).when(layout_no == 3, F.lower(at(1))).when(layout_no == 4, loose)
    images = images.select(*by, "path", split.alias("split"), first.alias("_first"), F.when(layout_no == 4, sibling).alias("_second"))
    labels = rows.where(extension(F.col("path")) == "txt").distinct()
    look = lambda name: labels.select(*by, F.col("path").alias(name), F.col("path").alias(f"{name}_hit"))
    joined = images.join(look("_first"), [*by, "_first"], "left").join(look("_second"), [*by, "_second"], "left")
    return joined.select(*by, F.col("path").alias("image_path"), stem(F.col("path")).alias("image_id"), "split",
                         F.coalesce("_first_hit", "_second_hit").alias("label_path"))


def detect_format(files: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Format and variant per dataset. ``files`` has ``path``, ``is_coco_json`` and ``is_label_text`` flags."""
    path, json = F.col("path"), F.coalesce(F.col("is_coco_json"), F.lit(False))
    here = folder(path)
    standard = path.isin(*[f"{d}instances_{s}.json" for d in ("annotations/", "") for s in ("train", "val")])
    any_split = F.regexp_extract(path, "^images/([^/]+)/", 1)
    marks = {
        "yaml": path.isin(*YAML_NAMES), "standard": json & standard, "split": json & here.isin(*SPLIT_NAMES),
        "folder": json & (here == "annotations"), "root": json & (here == ""), "images": path.startswith("images/"),
        "labels": path.startswith("labels/"), "splits": any_split.isin("train", "val", "test"),
        "text": (extension(path) == "txt") & F.coalesce(F.col("is_label_text"), F.lit(False)),
    }
    seen = files.groupBy(*by).agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(n) for n, t in marks.items()])
    layout = F.col("images") & F.col("labels")
    cases = [
        (F.col("yaml"), "yolo", "yolo_yaml_configured"), (F.col("standard"), "coco", "coco_standard"), (F.col("split"), "coco", "coco_split_first"),
        (F.col("folder"), "coco", "coco_json"), (F.col("root"), "coco", "coco_root_json"),
        (layout & F.col("splits"), "yolo", "yolo_split"), (layout, "yolo", "yolo_flat"), (F.col("text"), "yolo", "yolo_paired_txt"),
    ]
    pick = lambda i: reduce(lambda e, c: e.when(c[0], c[i]), cases[1:], F.when(cases[0][0], cases[0][i])).otherwise("unsupported")
    return seen.select(*by, pick(1).alias("format"), pick(2).alias("variant"))


def class_counts(annotations: DataFrame, classes: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Instances per class name; declared counts stand in for a dataset without annotations."""
    named = attach_class_names(annotations, classes, by)
    counted = named.groupBy(*by, "class_name").agg(F.count(F.lit(1)).alias("n"))
    declared = classes.join(annotations.select(*by).distinct(), list(by), "left_anti")
    fallback = declared.groupBy(*by, "class_name").agg(F.sum("count").alias("n"))
    return counted.unionByName(fallback)


def attach_class_names(annotations: DataFrame, classes: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Class name by id, ``class_{id}`` where none is declared."""
    side = classes.select(*by, "class_id", F.col("class_name").alias("_name"))
    rows = annotations.join(side, [*by, "class_id"], "left")
    own = F.col("class_name") if "class_name" in annotations.columns else F.lit(None).cast("string")
    name = F.coalesce(own, F.col("_name"), F.concat(F.lit("class_"), F.col("class_id")))
    return rows.withColumn("class_name", name).drop("_name")


def all_classes(declared: DataFrame, annotations: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Declared and observed classes with names and instance counts."""
    rows = declared.select(*by, "class_id", "class_name", F.lit(0).alias("_n")).unionByName(
        annotations.select(*by, "class_id", F.lit(None).cast("string").alias("class_name"), F.lit(1).alias("_n"))
    )
    grouped = rows.groupBy(*by, "class_id").agg(F.max("class_name").alias("class_name"), F.sum("_n").alias("count"))
    return grouped.withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("class_"), F.col("class_id"))))


def register_assets(images: DataFrame, annotations: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """One registration row per dataset; the manifest itself stays a long table (:func:`asset_files`)."""
    sizes = images.groupBy(*by).agg(F.count(F.lit(1)).alias("total_images"), F.sum("file_size_bytes").alias("total_size_bytes"))
    counts = annotations.groupBy(*by).agg(F.count(F.lit(1)).alias("total_annotations"))
    return sizes.join(counts, list(by), "left").fillna(0, ["total_annotations"]).withColumn("status", F.lit("REGISTERED"))


def asset_files(images: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    return images.select(*by, F.col("file_path").alias("path"), F.col("file_hash").alias("digest"), F.col("file_size_bytes").alias("size_bytes"))


def verify_battery(probes: DataFrame, files: DataFrame) -> DataFrame:
    """State of every probe file: ok, missing or corrupted. ``files(path, digest)``."""
    side = files.select(F.col("path").alias("file_path"), F.col("digest").alias("_found"))
    state = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("file_hash"), "corrupted").otherwise("ok")
    return probes.join(side, "file_path", "left").withColumn("state", state).drop("_found")


def validation_summary(violations: DataFrame, sizes: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Per dataset: errors, warnings, tallies per code, and validity with the zero-match rules.

    ``violations(by..., code, level)``; ``sizes(by..., total_images, verified_images, total_annotations)``.
    """
    codes = (*ERRORS, "negative_coordinate", "polygon_out_of_range", "class_above_declared", "conflicting_names")
    tallied = violations.groupBy(*by).agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"),
        *[F.count_if(F.col("code") == c).alias(c) for c in codes],
    )
    rows = sizes.join(tallied, list(by), "left").fillna(0)
    empty = (F.col("errors") == 0) & (
        ((F.col("total_images") == 0) & (F.col("total_annotations") == 0)) | (F.col("verified_images") == 0)
    )
    return rows.withColumn("errors", F.col("errors") + empty.cast("int")).withColumn("is_valid", F.col("errors") == 0)


def coverage(sizes: DataFrame, requested: Sequence[str] | None = None, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Which data checks run on which dataset. ``sizes(by..., images, classes)``."""
    names = sorted(CHECK_REQUIREMENTS)
    rows = sizes.withColumn("analysis_id", F.explode(F.array(*[F.lit(n) for n in names])))
    need = lambda field: case_of(F.col("analysis_id"), {n: CHECK_REQUIREMENTS[n][field] for n in names}, 0)
    wanted = F.lit(True) if not requested or "AUTO" in requested else F.col("analysis_id").isin(*requested)
    state = check_state(F.col("images"), F.col("classes"), need("min_images"), need("min_classes"), wanted)
    return rows.select(
        *by, "analysis_id", F.when(state == "executed", state).otherwise("skipped").alias("state"),
        F.when(state != "executed", state).alias("reason"),
    )
