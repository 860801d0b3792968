"""Stateful checks on arriving records: chain tip, sequence, nonce.

State lives in the query's state store and survives restarts through its checkpoint. Stale records still
advance state, as in batch, so the operators run on processing time and never drop late rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trustlake.operators.records import STREAM, SignatureCheck, authentic, judge, stateless_checks

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of this size belongs off the heap; the stateful processors require it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


class _FirstUse(StatefulProcessor):
    """Marks every use of a key but the earliest; single pass, constant memory however often it repeats."""

    def __init__(self, ttl_ms: int | None, stores: str | None):
        self.ttl_ms, self.stores = ttl_ms, stores

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("arrival", T.LongType())])
        self.seen = handle.getValueState("seen", schema, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known, first = self.seen.exists(), None
        for pdf in rows:
            if self.stores is not None:
                passed = pdf[~pdf[self.stores].astype(bool)]
                if len(passed):
                    yield passed.assign(nonce_replay=False)
                pdf = pdf[pdf[self.stores].astype(bool)]
            if not len(pdf):
                continue
            if known:
                yield pdf.assign(nonce_replay=True)
                continue
            at = pdf["arrival"].idxmin()
            lowest = pdf.loc[[at]]
            rest = pdf.drop(index=at)
            if first is None:
                first = lowest
            elif lowest["arrival"].iloc[0] < first["arrival"].iloc[0]:
                first, lowest = lowest, first
                rest = pd.concat([rest, lowest])
            else:
                rest = pd.concat([rest, lowest])
            if len(rest):
                yield rest.assign(nonce_replay=True)
        if first is not None:
            self.seen.update((int(first["arrival"].iloc[0]),))
            yield first.assign(nonce_replay=False)

    def close(self) -> None:
        pass


#: Arrivals in a chunk of a stream's share of a micro-batch.
CHUNK = 1 << 14
_NONE = np.iinfo(np.int64).min


def _pack(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


class _StreamState(StatefulProcessor):
    """Chain tip and last accepted sequence number of one stream, advanced in order of arrival.

    Rows of a share come in any order. A share of one Arrow batch is sorted as it is; a larger one is put into map state by
    chunks of arrival and taken out chunk by chunk, so memory holds one chunk however much of a stream a micro-batch brings.
    Numbers are text on the way, since pandas would turn a column with nulls into doubles.
    """

    def __init__(self, check_links: bool, chunk: int = CHUNK):
        self.check_links, self.chunk = check_links, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("sequence", T.LongType()), T.StructField("tip", T.StringType())])
        self.state = handle.getValueState("stream", schema)
        place = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("part", T.LongType())])
        self.pending = handle.getMapState("pending", place, T.StructType([T.StructField("rows", T.BinaryType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, tip = self.state.get() if self.state.exists() else (None, None)
        last = _NONE if last is None else last
        for pdf in self._in_order(rows):
            pdf, last, tip = self._advance(pdf, last, tip)
            yield pdf
        self.state.update((None if last == _NONE else last, tip))

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = next(rows, None), next(rows, None)
        if second is None:
            if first is not None:
                yield self._sorted(first)
            return
        places = []
        for pdf in chain([first, second], rows):
            for number, part in pdf.groupby(pdf["arrival"].astype("int64") // self.chunk):
                places.append((int(number), len(places)))
                self.pending.updateValue(places[-1], (_pack(part),))
        for _, group in groupby(sorted(places), key=itemgetter(0)):
            held = list(group)
            yield self._sorted(pd.concat([_unpack(bytes(self.pending.getValue(p)[0])) for p in held]))
            for place in held:
                self.pending.removeKey(place)

    @staticmethod
    def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[np.argsort(pdf["arrival"].astype("int64").to_numpy(), kind="stable")].reset_index(drop=True)

    def _advance(self, pdf: pd.DataFrame, last: int, tip: str | None) -> tuple[pd.DataFrame, int, str | None]:
        if self.check_links:
            expected = pdf["record_hash"].shift(1)
            expected.iloc[0] = tip
            stated = pdf["previous_record_hash"].where(pdf["previous_record_hash"].notna(), "")
            pdf["link_broken"] = expected.notna() & (expected.where(expected.notna(), "") != stated)
            pdf["authentic"] = pdf["authentic"] & ~pdf["link_broken"]
        trusted = pdf["authentic"].fillna(False).to_numpy(dtype=bool)
        given = pdf["sequence_number"].notna().to_numpy()
        number = pdf["sequence_number"].where(given, str(_NONE)).astype("int64").to_numpy()
        top = np.maximum.accumulate(np.concatenate([[last], np.where(trusted & given, number, _NONE)]))
        before = top[:-1]
        known = before != _NONE
        checked = trusted & known & given
        pdf["previous_sequence"] = pd.Series(before.astype(str)).where(known, None)
        pdf["sequence_regression"] = checked & (number <= before)
        pdf["sequence_gap"] = checked & (number > before) & (number - 1 != before)
        return pdf, int(top[-1]), str(pdf["record_hash"].iloc[-1])

    def close(self) -> None:
        pass


def _with(schema: T.StructType, *extra: tuple[str, T.DataType]) -> T.StructType:
    names = {n for n, _ in extra}
    return T.StructType([f for f in schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in extra])


def _ordered(pieces: T.StructType, frame: DataFrame) -> DataFrame:
    return frame.select(*[f.name for f in pieces.fields])


def flag_nonce(
    stream: DataFrame, ttl_ms: int | None = None, scope: Sequence[str] = (), stores: str | None = None
) -> DataFrame:
    """Add ``nonce_replay``; rows are flagged, never dropped. ``ttl_ms`` forgets a nonce after that time.

    ``stores`` names a boolean column: rows without it neither use a nonce up nor are tested.
    """
    schema = _with(stream.schema, ("nonce_replay", T.BooleanType()))
    return stream.groupBy(*scope, "nonce").transformWithStateInPandas(
        _FirstUse(ttl_ms, stores), schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def drop_repeated_nonce(stream: DataFrame, time: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """The dropping variant: later uses of a nonce within ``delay`` of event time disappear."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["nonce"])


def flag_stream(stream: DataFrame, keys: Sequence[str] = STREAM, check_links: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Add sequence flags, and link flags when asked. Needs ``arrival, authentic, record_hash``; ``arrival`` is never null.

    Only authentic rows advance the sequence; a broken link makes its row not authentic.
    """
    extra = [("previous_sequence", T.LongType()), ("sequence_regression", T.BooleanType()), ("sequence_gap", T.BooleanType())]
    if check_links:
        extra = [("link_broken", T.BooleanType()), ("authentic", T.BooleanType()), *extra]
    schema = _with(stream.schema, *extra)
    longs = {f.name for f in schema.fields if f.dataType == T.LongType() and f.name not in keys}
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name in longs else f.dataType) for f in schema.fields])
    rows = stream.withColumns({c: F.col(c).cast("string") for c in longs if c in stream.columns})
    found = rows.groupBy(*keys).transformWithStateInPandas(_StreamState(check_links, chunk), text, outputMode="Append", timeMode="None")
    return found.withColumns({c: F.col(c).cast("long") for c in longs})


def enrich(
    stream: DataFrame, keys: DataFrame, now: Column, models: DataFrame | None = None, preprocessing: DataFrame | None = None,
    images: DataFrame | None = None, tolerance: float = 300.0, verify_signature: SignatureCheck | None = None,
) -> DataFrame:
    """Stream-static joins with keys and registries, and every check that needs no state."""
    rows = stateless_checks(stream, keys, now, models, preprocessing, images, tolerance, verify_signature)
    return authentic(rows.withColumn("link_broken", F.lit(False)))


def verify_batch_of(batch: DataFrame) -> DataFrame:
    """Status, disposition and findings of rows that carry every flag."""
    return judge(batch)


def verify_stream(
    stream: DataFrame, keys: DataFrame, now: Column | None = None, check_links: bool = False, ttl_ms: int | None = None, **options
) -> DataFrame:
    """Full verification of a record stream; the clock is the processing time unless ``now`` is given."""
    rows = enrich(stream, keys, F.current_timestamp() if now is None else now, **options).drop("inference_config", "output")
    named = ~F.col("schema_bad") & (F.coalesce(F.col("signing_key_id"), F.lit("")) != "")
    rows = rows.withColumn("uses_nonce", named)
    return judge(flag_nonce(flag_stream(rows, check_links=check_links), ttl_ms, stores="uses_nonce")).drop("uses_nonce")
