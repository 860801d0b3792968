"""Path, token and timestamp text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def safe_path(path: Column) -> Column:
    """True for a relative path without null byte, drive letter or parent segment."""
    bad = (
        path.contains("\x00")
        | path.rlike(r"^[/\\]")
        | path.rlike("^[A-Za-z]:")
        | F.array_contains(F.split(forward_slashes(path), "/"), "..")
    )
    return F.coalesce(~bad, F.lit(False))


def clean_relative(path: Column) -> Column:
    """Forward-slash form of a safe path, null for an unsafe one."""
    return F.when(safe_path(path), F.ltrim(forward_slashes(path), F.lit("/")))


def stays_inside(path: Column) -> Column:
    """True when resolving the segments never climbs above the base folder (leading slashes are ignored)."""
    depth = F.aggregate(
        F.split(forward_slashes(path), "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, part: F.struct(
            (acc["depth"] + _step(part)).alias("depth"),
            F.least(acc["lowest"], acc["depth"] + _step(part)).alias("lowest"),
        ),
    )
    return depth["lowest"] >= 0


def _step(part: Column) -> Column:
    return F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)


def basename(path: Column) -> Column:
    return F.substring_index(forward_slashes(path), "/", -1)


def folder(path: Column) -> Column:
    """Everything before the last slash; empty for a bare name."""
    return F.regexp_extract(forward_slashes(path), "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^(.+?)(\.[^.]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def utc_text(ts: Column, suffix: str = "Z") -> Column:
    """ISO text with microseconds, in UTC whatever the session time zone; a timestamp without zone is taken as UTC."""
    seconds = (F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    instant = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    plain = F.when(F.typeof(ts) == "timestamp_ntz", ts.cast("string")).otherwise(instant.cast("string"))
    fraction = F.rpad(F.substring(plain, 21, 6), 6, "0")
    return F.concat(F.translate(F.substring(plain, 1, 19), " ", "T"), F.lit("."), fraction, F.lit(suffix))


def canonical_timestamp(ts: Column) -> Column:
    """UTC text with microseconds."""
    return utc_text(ts)


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)


def timestamp_skew(ts: Column, now: Column, tolerance: float) -> Column:
    return F.abs(seconds_between(now, ts)) > tolerance


def prefix_match(value: Column, wanted: str) -> Column:
    return F.upper(value).startswith(wanted.strip().upper())
