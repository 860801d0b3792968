"""SHA-256, HMAC and canonical JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.functions.text import utc_text

# Fields of a record that its signature binds, in the order of the canonical text.
BOUND_FIELDS = (
    "inference_config", "input_image_hash", "model_id", "model_weight_digest", "nonce", "output",
    "preprocessing_config_hash", "previous_record_hash", "producer_id", "record_id", "schema_version",
    "sequence_number", "session_id", "signing_key_id", "timestamp",
)
# Name parts that select four-digit rounding; everything else keeps six digits.
_FOUR_DIGITS = re.compile("confidence|conf|score|prob")
# Fields of an audit event that its hash covers.
EVENT_FIELDS = (
    "actor", "asset_id", "details", "event_id", "event_type",
    "previous_event_hash", "schema_version", "sequence_number", "session_id", "timestamp",
)


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def _xor_pad(key_hex: Column, byte: int) -> Column:
    """64-byte HMAC pad of a hex key, built byte by byte; runs on the key table only."""
    padded = F.rpad(key_hex, 128, "0")
    flipped = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.lpad(
            F.hex(F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte).cast("long"))),
            2, "0",
        ),
    )
    return F.unhex(F.array_join(flipped, ""))


def hmac_pads(secret: Column) -> Column:
    """Struct (inner, outer) for a binary secret; keys longer than a block are hashed first."""
    key_hex = F.when(F.length(secret) > 64, F.sha2(secret, 256)).otherwise(F.hex(secret))
    return F.struct(_xor_pad(key_hex, 0x36).alias("inner"), _xor_pad(key_hex, 0x5C).alias("outer"))


def hmac_sha256(pads: Column, message: Column) -> Column:
    inner = F.unhex(F.sha2(F.concat(pads["inner"], message), 256))
    return F.sha2(F.concat(pads["outer"], inner), 256)


def typed_json(**fields: Column) -> Column:
    """Native canonical text: fields in name order, nulls kept. For typed columns only."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def quantized(value: object, key: str = "") -> object:
    """Rounding of one parsed JSON value; the enclosing key picks the digits."""
    if isinstance(value, dict):
        return {k: quantized(v, k) for k, v in value.items()}
    if isinstance(value, list):
        numbers = all(isinstance(v, (int, float)) for v in value)
        if "bbox" in key.lower() and numbers:
            return [round(float(v), 6) for v in value]
        return [quantized(v, key) for v in value]
    if isinstance(value, float):
        return round(value, 4 if _FOUR_DIGITS.search(key.lower()) else 6)
    return value


def _compact(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def _per_distinct(text: pd.Series, fn) -> pd.Series:
    """Apply ``fn`` once per distinct text of the batch."""
    known = {t: fn(t) for t in text.dropna().unique()}
    return text.map(lambda t: None if t is None else known[t])


@F.pandas_udf(T.StringType())
def quantize_json(text: pd.Series) -> pd.Series:
    """Free-form JSON text with every float rounded, keys sorted."""
    return _per_distinct(text, lambda t: _compact(quantized(json.loads(t))))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no spaces and ASCII escapes."""
    return _per_distinct(text, lambda t: _compact(json.loads(t)))


_GAP = r"[ \t\r\n]*+"
_PLAIN_VALUE = r'(?:-?(?:0|[1-9][0-9]{0,8})\.(?:0|[0-9]{0,3}[1-9])|0|-?[1-9][0-9]{0,17}|true|false|null|"[ !#-\[\]-~]*+")(?=[ \t\r\n,}])'
_PLAIN_PAIR = rf'"([A-Za-z0-9_]++)"{_GAP}:{_GAP}({_PLAIN_VALUE})'
_PLAIN_OBJECT = rf"\A{_GAP}\{{{_GAP}(?:{_PLAIN_PAIR}(?:{_GAP},{_GAP}{_PLAIN_PAIR})*+{_GAP})?+\}}{_GAP}\z"


def plain_json(text: Column) -> Column:
    """Canonical form of a short flat object of printable ASCII whose keys ascend and whose numbers need no rounding; else null.

    Such a number has at most four digits behind the point, the last of them no zero, so that neither rounding nor Python's
    way of writing it changes anything.
    """
    keys, values = (F.regexp_extract_all(text, F.lit(_PLAIN_PAIR), F.lit(i)) for i in (1, 2))
    body = F.array_join(F.zip_with(keys, values, lambda k, v: F.concat(F.lit('"'), k, F.lit('":'), v)), ",")
    flat = (F.length(text) <= 2000) & text.rlike(_PLAIN_OBJECT)
    return F.when(flat, F.when(F.sort_array(F.array_distinct(keys)) == keys, F.concat(F.lit("{"), body, F.lit("}"))))


def _finisher(names: list[str], rounded: bool):
    """Python's part for rows that need it: the typed parts as JSON text, and each free-form text parsed on its own."""
    @F.pandas_udf(T.StringType())
    def finish(*columns: pd.Series) -> pd.Series:
        out = []
        for typed, *texts in zip(*columns):
            if typed is None:
                out.append(None)
                continue
            free = [json.loads(t) for t in texts]
            out.append(_compact(json.loads(typed) | dict(zip(names, map(quantized, free) if rounded else free))))
        return pd.Series(out, dtype=object)

    return finish


def _add_body(df: DataFrame, name: str, parts: dict[str, Column], free: dict[str, Column], rounded: bool) -> DataFrame:
    """Add one JSON object in key order: typed parts natively, free-form parts from JSON text in canonical form.

    Staged as columns so that the text is built once. Python sees a row only where a free-form text is not plain or the whole
    holds anything but printable ASCII, and then once for all its parts.
    """
    staged = df.withColumns({f"_raw_{n}": F.coalesce(c, F.lit("{}")) for n, c in free.items()})
    staged = staged.withColumns({f"_free_{n}": plain_json(F.col(f"_raw_{n}")) for n in free})
    pieces, run = [], {}

    def flush() -> None:
        if run:
            text = F.to_json(F.struct(*[c.alias(n) for n, c in run.items()]), {"ignoreNullFields": "false"})
            pieces.append(F.substring(text, F.lit(2), F.length(text) - 2))
            run.clear()

    for part in sorted([*parts, *free]):
        if part in parts:
            run[part] = parts[part]
        else:
            flush()
            pieces.append(F.concat(F.lit(f'"{part}":'), F.coalesce(F.col(f"_free_{part}"), F.lit("null"))))
    flush()
    staged = staged.withColumn("_text", F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")))
    needs = F.col("_text").rlike("[^ -~]|\\\\u")
    for n in free:
        needs = needs | F.col(f"_free_{n}").isNull()
    staged = staged.withColumn("_needs", needs)
    sent = [F.when(F.col("_needs"), F.col(c)) for c in ("_text", *[f"_raw_{n}" for n in free])]
    done = _finisher(list(free), rounded)(*sent)
    return staged.withColumn(name, F.coalesce(done, F.col("_text"))).drop("_text", "_needs", *[f"_{k}_{n}" for k in ("raw", "free") for n in free])


def add_payload(df: DataFrame, name: str = "payload", timestamp: str = "timestamp") -> DataFrame:
    """Add the exact text a record's binding covers."""
    free = {n: F.col(n) for n in ("inference_config", "output")}
    parts = {n: F.col(n) for n in BOUND_FIELDS if n not in free}
    parts["sequence_number"] = F.col("sequence_number").cast("long")
    parts["timestamp"] = utc_text(F.col(timestamp))
    return _add_body(df, name, parts, free, rounded=True)


def add_event_payload(df: DataFrame, name: str = "payload", timestamp_text: str = "timestamp_text") -> DataFrame:
    """Add the canonical text of an audit event; ``timestamp_text`` is the stored ISO form."""
    free = {"details": F.col("details")}
    parts = {n: F.col(n) for n in EVENT_FIELDS if n not in free}
    parts["timestamp"] = F.col(timestamp_text)
    return _add_body(df, name, parts, free, rounded=False)
