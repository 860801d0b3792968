"""Annotation formats as Spark data sources: ``spark.read.format("coco").load(folder)``.

A format is one class: it names itself, says which files hold annotations and turns one file into rows. Listing, dealing files to tasks,
skipping files by pushed filters on ``split`` and ``path``, Arrow batches and the common schema are here. ``register`` makes the formats known.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from trustlake.constants import SPLIT_NAMES
from trustlake.functions.geometry import box_from_centre, box_from_xywh, polygon_envelope

SCHEMA = (
    "path string, split string, image string, number long, class_id int, class_name string, kind string, coords array<double>, "
    "width long, height long, score double"
)
ARROW = pa.schema([
    ("path", pa.string()), ("split", pa.string()), ("image", pa.string()), ("number", pa.int64()), ("class_id", pa.int32()), ("class_name", pa.string()),
    ("kind", pa.string()), ("coords", pa.list_(pa.float64())), ("width", pa.int64()), ("height", pa.int64()), ("score", pa.float64()),
])
#: Bytes of files read by one task, and rows in a batch.
TASK_BYTES, BATCH = 64 << 20, 4096


@dataclass
class Files(InputPartition):
    """Files of one task: place for the file system, and path below the root."""

    names: list[tuple[str, str]]


def split_name(path: str) -> str | None:
    """The first folder of a path that names a split."""
    return next((part for part in path.split("/")[:-1] if part in SPLIT_NAMES), None)


class AnnotationFormat(DataSource):
    """Base of all formats. A subclass sets ``name`` and ``suffixes`` and implements ``rows``; ``takes`` may narrow the choice of files."""

    suffixes: Sequence[str] = ()

    def schema(self) -> str:
        return SCHEMA

    def takes(self, path: str) -> bool:
        return path.lower().endswith(tuple(self.suffixes))

    def rows(self, path: str, content: bytes) -> Iterator[dict]:
        """Rows of one file by column name; columns left out are null. ``kind`` says how ``coords`` are meant, see :func:`boxes`."""
        raise NotImplementedError(f"{type(self).__name__} does not say how to read a file")

    def reader(self, schema) -> FormatReader:
        return FormatReader(self)


class FormatReader(DataSourceReader):
    def __init__(self, form: AnnotationFormat):
        self.form, self.filters = form, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the split or the path choose files; all others stay with Spark."""
        for f in filters:
            column = f.attribute if isinstance(f, (EqualTo, In, StringStartsWith)) else ()
            if column in (("split",), ("path",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        value = {"path": path, "split": split_name(path)}
        for f in self.filters:
            held = value[f.attribute[0]]
            if isinstance(f, EqualTo) and held != f.value or isinstance(f, In) and held not in f.value:
                return False
            if isinstance(f, StringStartsWith) and not (held or "").startswith(f.value):
                return False
        return True

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        root = self.form.options["path"]
        system, inner = fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")
        prefix = root[: len(root) - len(inner)] if root.endswith(inner) else ""
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        below = lambda place: place.removeprefix(inner.rstrip("/") + "/")
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and self.form.takes(below(f.path)) and self._wanted(below(f.path)))
        out, size = [Files([])], 0
        for place, length in files:
            if size + length > TASK_BYTES and out[-1].names:
                out.append(Files([]))
                size = 0
            out[-1].names.append((prefix + place, below(place)))
            size += length
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: list[dict] = []
        for place, path in partition.names:
            system, inner = fs.FileSystem.from_uri(place if "://" in place else f"file://{place.removeprefix('file:')}")
            with system.open_input_stream(inner) as stream:
                content = stream.read()
            for number, row in enumerate(self.form.rows(path, content)):
                held.append({"path": path, "split": split_name(path), "number": number, **row})
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)


class Coco(AnnotationFormat):
    """COCO manifests; annotations of images or categories that a manifest does not list keep their ids alone."""

    suffixes = (".json",)

    @classmethod
    def name(cls) -> str:
        return "coco"

    def rows(self, path: str, content: bytes) -> Iterator[dict]:
        told = json.loads(content)
        if not isinstance(told, dict) or "images" not in told:
            return
        images = {i.get("id"): i for i in told["images"]}
        names = {c.get("id"): c.get("name") for c in told.get("categories") or []}
        for a in told.get("annotations") or []:
            image = images.get(a.get("image_id"), {})
            yield {
                "image": image.get("file_name") or str(a.get("image_id")), "class_id": a.get("category_id"), "class_name": names.get(a.get("category_id")), "kind": "xywh",
                "coords": [float(v) for v in a.get("bbox") or []], "width": image.get("width"), "height": image.get("height"), "score": a.get("score"),
            }


class Yolo(AnnotationFormat):
    """YOLO label files; lines that do not parse give no row."""

    suffixes = (".txt",)

    @classmethod
    def name(cls) -> str:
        return "yolo"

    def rows(self, path: str, content: bytes) -> Iterator[dict]:
        image = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for line in content.decode(errors="replace").splitlines():
            try:
                class_id, *coords = line.split()
                found = {"image": image, "class_id": int(class_id), "coords": [float(c) for c in coords]}
            except ValueError:
                continue
            if len(coords) >= 4:
                yield found | {"kind": "centre" if len(coords) == 4 else "polygon"}


FORMATS = (Coco, Yolo)


def register(spark: SparkSession, *more: type[AnnotationFormat]) -> None:
    """Make the formats of this library, and ``more``, known to ``spark.read``, with filter push-down on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for form in (*FORMATS, *more):
        spark.dataSource.register(form)


def boxes(rows: DataFrame) -> DataFrame:
    """Add ``bbox``, normalised corners: ``xywh`` in pixels of ``width, height``, ``centre`` and ``polygon`` in shares of the image."""
    at = lambda i: F.try_element_at("coords", F.lit(i))
    box: Column = F.when(F.col("kind") == "xywh", box_from_xywh(F.col("coords"), F.coalesce("width", F.lit(1)), F.coalesce("height", F.lit(1))))
    box = box.when(F.col("kind") == "centre", box_from_centre(at(1), at(2), at(3), at(4))).when(F.col("kind") == "polygon", polygon_envelope(F.col("coords")))
    return rows.withColumn("bbox", box)
