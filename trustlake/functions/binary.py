"""Signals read from raw bytes.

Whatever needs only a few positions (headers, difference hash) is native and never leaves the JVM. Whatever
reads every byte runs in an Arrow pandas UDF over numpy; the edge residual ships three short windows only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.functions.numeric import fixed


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def byte_at(content: Column, pos: Column | int) -> Column:
    """One-byte slice at a zero-based position; binary ordering is unsigned."""
    pos = pos if isinstance(pos, Column) else F.lit(pos)
    return F.substring(content, (pos + 1).cast("int"), F.lit(1))


def uint(content: Column, pos: int, size: int, big_endian: bool = True) -> Column:
    """Unsigned integer stored at a zero-based position."""
    order = range(size) if big_endian else reversed(range(size))
    text = F.concat(*[F.hex(F.substring(content, pos + 1 + i, 1)) for i in order])
    return F.conv(text, 16, 10).cast("long")


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated one time, however often the body looks at it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dhash(content: Column, side: int = 8) -> Column:
    """64-bit difference hash of a strided byte grid as a long; fewer than 64 bytes hash to zero."""
    return once(content, lambda c: _dhash(c, side))


def _dhash(content: Column, side: int) -> Column:
    cells = (side + 1) * side
    size = F.length(content)
    step = F.greatest(F.lit(1), F.floor(size / cells).cast("int"))

    def sample(index: Column) -> Column:
        return byte_at(content, (index * step) % size)

    def push(acc: Column, p: Column) -> Column:
        at = F.floor(p / side).cast("int") * (side + 1) + p % side
        bit = F.when(sample(at) > sample(at + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.shiftleft(acc, 1).bitwiseOR(bit)

    bits = F.aggregate(F.sequence(F.lit(0), F.lit(side * side - 1)), F.lit(0).cast("long"), push)
    return F.when(size < 64, F.lit(0).cast("long")).otherwise(bits)


def dhash_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Distance of two 16-digit hex hashes; 64 when either does not parse."""
    def parse(h: Column) -> Column:
        return F.when(h.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(h, 16, -10).cast("long"))

    return F.coalesce(hamming(parse(a), parse(b)), F.lit(64))


@F.pandas_udf(_doubles("first", "last", "middle"))
def _window_deltas(windows: pd.Series) -> pd.DataFrame:
    out = np.full((len(windows), 3), np.nan)
    present = windows.notna().to_numpy()
    if present.any():
        data = np.frombuffer(b"".join(windows[present]), dtype=np.uint8).reshape(-1, 3, 256).astype(np.int16)
        out[present] = np.abs(np.diff(data, axis=2)).mean(axis=2)
    return pd.DataFrame(out, columns=["first", "last", "middle"])


def edge_residual(content: Column) -> Column:
    """Struct (score, region): byte-to-byte change of both ends against the middle of the stream."""
    size = F.length(content)
    skip = F.least(F.lit(128), F.floor(size / 10).cast("int"))
    windows = F.concat(
        F.substring(content, skip + 1, F.lit(256)),
        F.substring(content, size - 255, F.lit(256)),
        F.substring(content, F.floor(size / 2).cast("int") + 1, F.lit(256)),
    )
    deltas = _window_deltas(F.when(size >= 1024, windows))
    last = deltas["last"] / (deltas["middle"] + 1.0)
    first = deltas["first"] / (deltas["middle"] + 1.0)
    pick_last = (last > first) & (last > 2.8)
    small = F.coalesce(size, F.lit(0)) < 1024
    region = F.when(small, "none").when(pick_last, "bottom_right").when(first > 2.8, "top_left").otherwise("none")
    score = (
        F.when(region == "bottom_right", F.least(F.lit(1.0), last / 5))
        .when(region == "top_left", F.least(F.lit(1.0), first / 5))
        .otherwise(0.0)
    )
    return F.struct(score.alias("score"), region.alias("region"))


def _features(data: bytes, dim: int) -> np.ndarray:
    out = np.zeros(max(dim, 70))
    if not data:
        return out[:dim]
    raw = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(raw, minlength=256).astype(float)
    share = counts / raw.size
    values = np.arange(256.0)
    mean = float(share @ values)
    centred = values - mean
    variance = float(share @ centred**2)
    std = np.sqrt(variance) if variance > 0 else 1e-6
    out[:64] = share.reshape(64, 4).sum(axis=1)
    out[64:68] = (
        mean / 255.0, std / 255.0,
        float(share @ centred**3) / std**3 / 10.0, float(share @ centred**4) / std**4 / 50.0,
    )
    steps = np.abs(np.diff(raw.astype(np.int16)))
    if steps.size:
        out[68:70] = steps.mean() / 255.0, steps.max() / 255.0
    out = out[:dim]
    length = np.sqrt(np.square(out).sum())
    return out / length if length > 0 else out


def byte_features(content: Column, dim: int = 128) -> Column:
    """Unit vector of 64 byte-share bins, four moments and two gradient figures, padded to ``dim``."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def extract(data: pd.Series) -> pd.Series:
        return data.map(lambda d: _features(d or b"", dim))

    return extract(content)


def pixel_bytes(data: bytes) -> bytes:
    """Uncompressed payload of PNG and BMP; other streams are taken as they are."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        chunks, at = [], 8
        while at + 4 < len(data):
            size, kind = int.from_bytes(data[at:at + 4], "big"), data[at + 4:at + 8]
            if kind == b"IEND":
                break
            if kind == b"IDAT":
                chunks.append(data[at + 8:at + 8 + size])
            at += size + 12
        try:
            return zlib.decompress(b"".join(chunks)) if chunks else data
        except zlib.error:
            return data
    if data[:2] == b"BM" and len(data) >= 26:
        return data[int.from_bytes(data[10:14], "little"):]
    return data


@F.pandas_udf(T.BinaryType())
def decoded_pixels(content: pd.Series) -> pd.Series:
    return content.map(lambda d: None if d is None else pixel_bytes(d))


@F.pandas_udf(_doubles("luminance", "contrast", "sharpness"))
def _quality(content: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(content), 3))
    for i, data in enumerate(content):
        raw = np.frombuffer(pixel_bytes(data or b""), dtype=np.uint8)
        if raw.size:
            steps = np.abs(np.diff(raw.astype(np.int16)))
            out[i] = raw.mean(), raw.std(), steps.mean() if steps.size else 0.0
    return pd.DataFrame(out / 255.0, columns=["luminance", "contrast", "sharpness"])


def quality_scalars(content: Column, width: Column, height: Column) -> Column:
    """Struct of five quality figures over all pixel bytes."""
    q = _quality(content)
    size = F.coalesce(F.length(content), F.lit(0))
    aspect = F.when((size > 0) & (width > 0) & (height > 0), width / height).otherwise(1.0)
    return F.struct(
        *[fixed(q[n], 6).alias(n) for n in ("luminance", "contrast", "sharpness")],
        fixed(aspect, 4).alias("aspect_ratio"),
        fixed(size / F.lit(1024.0), 4).alias("size_kb"),
    )


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("width", "height")]))
def _jpeg_size(content: pd.Series) -> pd.DataFrame:
    def walk(data: bytes | None) -> tuple[int, int]:
        at = 2
        while data is not None and at + 8 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xC3:
                return int.from_bytes(data[at + 7:at + 9], "big"), int.from_bytes(data[at + 5:at + 7], "big")
            at += 2 if marker in (0xD8, 0xD9) else 2 + int.from_bytes(data[at + 2:at + 4], "big")
        return 0, 0

    return pd.DataFrame([walk(d) for d in content], columns=["width", "height"])


def image_header(content: Column) -> Column:
    """Struct (width, height, format) from the header. Only JPEG files reach Python, whole: a large profile may precede the size."""
    size = F.length(content)
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    png = starts(b"\x89PNG\r\n\x1a\n") & (size >= 24)
    jpeg = starts(b"\xff\xd8")
    bmp = starts(b"BM") & (size >= 26)
    gif = (starts(b"GIF87a") | starts(b"GIF89a")) & (size >= 10)
    webp = starts(b"RIFF") & (size >= 30) & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
    kind = F.substring(content, 13, 4)
    le = lambda pos, n: uint(content, pos, n, big_endian=False)
    jpeg_size = _jpeg_size(F.when(jpeg & (size >= 16), content))
    mask14 = F.lit(0x3FFF).cast("long")
    packed = le(21, 4)
    shapes = [
        (png, uint(content, 16, 4), uint(content, 20, 4), "png"),
        (jpeg, jpeg_size["width"], jpeg_size["height"], "jpeg"),
        (bmp, le(18, 4), le(22, 4), "bmp"),
        (gif, le(6, 2), le(8, 2), "gif"),
        (webp & (kind == F.lit(b"VP8 ")), le(26, 2).bitwiseAND(mask14), le(28, 2).bitwiseAND(mask14), "webp"),
        (webp & (kind == F.lit(b"VP8L")), packed.bitwiseAND(mask14) + 1,
         F.shiftright(packed, 14).bitwiseAND(mask14) + 1, "webp"),
        (webp & (kind == F.lit(b"VP8X")), le(24, 3) + 1, le(27, 3) + 1, "webp"),
        (webp, F.lit(0), F.lit(0), "webp"),
    ]
    width, height, name = F.when(size < 16, 0), F.when(size < 16, 0), F.when(size < 16, "unknown")
    for test, w, h, fmt in shapes:
        width, height, name = width.when(test, w), height.when(test, h), name.when(test, fmt)
    return F.struct(
        width.otherwise(0).cast("long").alias("width"),
        height.otherwise(0).cast("long").alias("height"),
        name.otherwise("unknown").alias("format"),
    )
