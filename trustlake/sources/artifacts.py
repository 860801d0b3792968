"""Safety scan of serialized model files, many at once."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.constants import (
    MAX_ARCHIVE_BYTES, MAX_ARCHIVE_RATIO, MAX_MODEL_BYTES, MODEL_FORMATS, RATIO_MIN_BYTES, SCRIPT_SUFFIXES, UNSAFE_SIGNATURES,
)
from trustlake.functions.risk import case_of
from trustlake.functions.text import extension
from trustlake.sources.files import open_file


def _name(signature: bytes) -> str:
    return signature.decode("ascii").strip()


#: Bytes of an archive member in memory at a time.
PIECE = 1 << 20


def _signatures(member: io.BufferedIOBase) -> list[bytes]:
    """Signatures anywhere in a member, read in pieces that overlap by the longest of them."""
    keep = max(map(len, UNSAFE_SIGNATURES)) - 1
    found, tail = set(), b""
    while piece := member.read(PIECE):
        tail += piece
        found |= {s for s in UNSAFE_SIGNATURES if s in tail}
        tail = tail[-keep:]
    return [s for s in UNSAFE_SIGNATURES if s in found]


def _member_problems(content: io.BufferedIOBase, max_ratio: float, max_total: int) -> tuple[list[str], list[str]]:
    """Problems and warnings of one archive, from its directory and its pickled members; ``content`` can seek and is read in pieces."""
    problems, warnings, total = [], [], 0
    try:
        with zipfile.ZipFile(content) as archive:
            for info in archive.infolist():
                name, low = info.filename, info.filename.lower()
                total += info.file_size
                if ".." in name or name[:1] in ("/", "\\"):
                    problems.append(f"path_traversal: {name}")
                if low.endswith(SCRIPT_SUFFIXES):
                    problems.append(f"executable_script: {name}")
                if info.compress_size and info.file_size > RATIO_MIN_BYTES and info.file_size / info.compress_size > max_ratio:
                    problems.append(f"compression_ratio: {name}")
                if low.endswith((".pkl", "/data")) or "pickle" in low:
                    try:
                        with archive.open(info) as member:
                            unsafe = _signatures(member)
                    except Exception as error:  # noqa: BLE001
                        warnings.append(f"unreadable_member: {name}: {error}")
                        continue
                    problems += [f"unsafe_signature: {name}: {_name(s)}" for s in unsafe]
            if total > max_total:
                problems.append("archive_too_large")
    except zipfile.BadZipFile:
        problems.append("malformed_archive")
    return problems, warnings


#: Files above this are read by ranges of ``RANGE`` bytes; Spark's own reader holds a file in one row and ends at about 2 GiB.
WHOLE_BYTES, RANGE = 256 << 20, 64 << 20


def scan_artifacts(
    spark: SparkSession, path: str, max_bytes: int = MAX_MODEL_BYTES,
    max_ratio: float = MAX_ARCHIVE_RATIO, max_archive_bytes: int = MAX_ARCHIVE_BYTES, whole_bytes: int = WHOLE_BYTES, range_bytes: int = RANGE,
) -> DataFrame:
    """One row per file: format, digest, problems, warnings and ``is_safe``; files of any size, none held whole beyond ``whole_bytes``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= whole_bytes).select("path", "content", F.col("length").alias("size_bytes"))
    found = scan_contents(small, max_bytes, max_ratio, max_archive_bytes)
    listed = files.where(F.col("length") > whole_bytes).select("path", F.col("length").alias("size_bytes"))
    return found.unionByName(scan_ranges(listed, max_bytes, max_ratio, max_archive_bytes, range_bytes))


class _Seekable(io.RawIOBase):
    """An Arrow file as ``zipfile`` expects one: a seek before the start is an ``OSError``."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (0, self.file.tell(), self.file.size())[whence]
        if place < 0:
            raise OSError("seek before the start of the file")
        return self.file.seek(place)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def range_signatures(listed: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """``path, signatures`` of listed files: each range is a row of its own, read with the overlap of the longest signature."""
    last = max(map(len, UNSAFE_SIGNATURES)) - 1
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = listed.where("size_bytes > 0").select("path", starts.alias("start"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, start in zip(pdf["path"], pdf["start"].tolist()):
                with open_file(path) as file:
                    file.seek(start)
                    left, tail, found = range_bytes + last, b"", set()
                    while left > 0 and (piece := file.read(min(PIECE, left))):
                        tail += piece
                        found |= {i for i, s in enumerate(UNSAFE_SIGNATURES) if s in tail}
                        left, tail = left - len(piece), tail[-last:]
                out += [(path, i) for i in found]
            yield pd.DataFrame(out, columns=["path", "number"])

    # Ranges are the unit of work, dealt one by one: a file of any size is read by many tasks.
    dealt = ranges.repartition(max(1, listed.sparkSession.sparkContext.defaultParallelism), "path", "start")
    hits = dealt.mapInPandas(search, "path string, number int")
    return hits.groupBy("path").agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def scan_ranges(
    listed: DataFrame, max_bytes: int = MAX_MODEL_BYTES, max_ratio: float = MAX_ARCHIVE_RATIO, max_archive_bytes: int = MAX_ARCHIVE_BYTES, range_bytes: int = RANGE,
) -> DataFrame:
    """The rows of :func:`scan_contents` for listed files ``path, size_bytes``, which Arrow file systems can open.

    A digest needs the bytes in order, so one task streams them by pieces; signatures are searched by ranges; an archive is read
    member by member.
    """
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                digest, inner, warnings = hashlib.sha256(), [], []
                with open_file(path) as file:
                    is_zip = file.read(4) == b"PK\x03\x04"
                    file.seek(0)
                    while piece := file.read(PIECE):
                        digest.update(piece)
                    if is_zip:
                        file.seek(0)
                        inner, warnings = _member_problems(io.BufferedReader(_Seekable(file), PIECE), max_ratio, max_archive_bytes)
                yield pd.DataFrame({"path": [path], "file_hash": [digest.hexdigest()], "is_archive": [is_zip], "_inner": [inner], "warnings": [warnings]})

    schema = "path string, file_hash string, is_archive boolean, _inner array<string>, warnings array<string>"
    streamed = listed.repartition("path").select("path").mapInPandas(stream, schema)
    kind = extension(F.col("path"))
    names = F.array(*[F.lit(f"unsafe_signature: {_name(s)}") for s in UNSAFE_SIGNATURES])
    raw = F.when(~F.col("is_archive"), F.transform("numbers", lambda i: F.get(names, i)))
    basic = F.array_compact(F.array(
        F.when(F.col("size_bytes") == 0, "empty_file"), F.when(F.col("size_bytes") > max_bytes, "file_too_large"), F.when(~kind.isin(*MODEL_FORMATS), "unsupported_extension"),
    ))
    none = F.array().cast("array<string>")
    joined = listed.join(streamed, "path").join(range_signatures(listed, range_bytes), "path", "left")
    problems = F.concat(basic, F.coalesce(raw, none), F.col("_inner"))
    return joined.select(
        "path", "size_bytes", case_of(kind, MODEL_FORMATS, "unsupported").alias("format"), "file_hash", "is_archive", problems.alias("problems"), "warnings",
        (F.size(problems) == 0).alias("is_safe"),
    )


def scan_contents(
    files: DataFrame, max_bytes: int = MAX_MODEL_BYTES,
    max_ratio: float = MAX_ARCHIVE_RATIO, max_archive_bytes: int = MAX_ARCHIVE_BYTES,
) -> DataFrame:
    """Scan rows ``path, content, size_bytes``, whole. Plain streams are searched natively; only archives reach Python."""
    kind = extension(F.col("path"))
    is_zip = F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")
    raw = [F.when(~is_zip & F.contains("content", F.lit(s)), F.lit(f"unsafe_signature: {_name(s)}")) for s in UNSAFE_SIGNATURES]
    basic = [
        F.when(F.col("size_bytes") == 0, "empty_file"), F.when(F.col("size_bytes") > max_bytes, "file_too_large"),
        F.when(~kind.isin(*MODEL_FORMATS), "unsupported_extension"),
    ]

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_member_problems(io.BytesIO(c), max_ratio, max_archive_bytes) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "_inner": [f[0] for f in found], "warnings": [f[1] for f in found]})

    archives = files.where(is_zip).select("path", "content").mapInPandas(members, "path string, _inner array<string>, warnings array<string>")
    scanned = files.select(
        "path", "size_bytes", case_of(kind, MODEL_FORMATS, "unsupported").alias("format"), F.sha2("content", 256).alias("file_hash"),
        is_zip.alias("is_archive"), F.array_compact(F.array(*basic, *raw)).alias("_outer"),
    )
    none = F.array().cast("array<string>")
    joined = scanned.join(archives, "path", "left")
    problems = F.concat("_outer", F.coalesce("_inner", none))
    return joined.select(
        "path", "size_bytes", "format", "file_hash", "is_archive", problems.alias("problems"), F.coalesce("warnings", none).alias("warnings"),
        (F.size(problems) == 0).alias("is_safe"),
    )
