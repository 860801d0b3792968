"""Elements of top-level arrays of JSON files of any size, each file read by many tasks.

A byte range cannot be parsed alone: it may start within a string or at any depth. So each range first tells what it does to the two facts a
parser carries, whether it is inside a string and how deep it is, for both ways of starting; a running sum over the ranges of a file gives every
range its true start; then each range yields the elements that start in it, reading on past its end for the last one. No file, array or range
is held whole. Files are UTF-8. A file whose brackets or quotes do not close is no JSON and yields nothing; of a repeated key the last counts;
array elements that are no objects are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.session import cut_lineage
from trustlake.sources.files import open_file

#: Bytes of a range, of a piece in memory, and of the first look back for a key.
RANGE, PIECE, LOOK = 32 << 20, 4 << 20, 4 << 10
_QUOTE, _BACKSLASH, _OPEN_LIST, _OPEN_OBJECT = b'"\\[{'
_STEP = np.zeros(256, dtype=np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = _STEP != 0
_MARK[_QUOTE] = True
_SPACE = b" \t\r\n"


def _backslashes_before(file, start: int) -> int:
    """Length of the run of backslashes that ends right before ``start``."""
    run, step = 0, LOOK
    while run < start:
        file.seek(max(0, start - run - step))
        data = file.read(min(step, start - run))
        kept = data.rstrip(b"\\")
        run += len(data) - len(kept)
        if kept:
            break
    return run


def _escaped(data: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """Which bytes ``at`` follow an odd run of backslashes; ``run`` backslashes came before the data."""
    slashes = np.flatnonzero(data == _BACKSLASH)
    length = np.zeros(len(at), dtype=np.int64)
    if len(slashes):
        first = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) > 1, slashes, 0))
        k = np.searchsorted(slashes, at) - 1
        near = (k >= 0) & (slashes[k] == at - 1)
        begin = first[k[near]]
        length[near] = at[near] - begin + np.where(begin == 0, run, 0)
    length[at == 0] = run
    return length % 2 == 1


def _marks(file, start: int, stop: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of ``start .. stop``: place, bytes, places of quotes and brackets in the piece, their bytes, and whether an odd number of
    quotes since ``start`` comes before each."""
    run, odd, place = _backslashes_before(file, start), 0, start
    while place < stop:
        file.seek(place)
        raw = file.read(min(PIECE, stop - place))
        if not raw:
            return
        data = np.frombuffer(raw, dtype=np.uint8)
        at = np.flatnonzero(_MARK[data])
        quote = data[at] == _QUOTE
        real = ~quote
        real[quote] = ~_escaped(data, at[quote], run)
        at, quote = at[real], quote[real]
        upto = odd + np.cumsum(quote)
        yield place, raw, at, data[at], (upto - quote) % 2 == 1
        odd = int(upto[-1]) % 2 if len(upto) else odd
        tail = len(raw) - len(raw.rstrip(b"\\"))
        run = run + tail if tail == len(raw) else tail
        place += len(raw)


def _transition(file, start: int, length: int) -> tuple[int, ...]:
    """Quotes of a range; then change of depth and lowest depth if it starts outside a string, and the same if inside."""
    quotes, depth, low = 0, [0, 0], [0, 0]
    for _, _, _, code, odd in _marks(file, start, start + length):
        quotes += int((code == _QUOTE).sum())
        for state in (0, 1):
            steps = np.cumsum(_STEP[code[odd == bool(state)]], dtype=np.int64)
            if len(steps):
                low[state] = min(low[state], depth[state] + int(steps.min()))
                depth[state] += int(steps[-1])
    return quotes, depth[0], low[0], depth[1], low[1]


def _brackets(file, start: int, stop: int, inside: bool, depth: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces with the brackets that count: their places in the piece, their bytes, and the depth before each."""
    for place, raw, at, code, odd in _marks(file, start, stop):
        keep = (odd == inside) & (code != _QUOTE)
        at, code = at[keep], code[keep]
        step = _STEP[code].astype(np.int64)
        after = depth + np.cumsum(step)
        yield place, raw, at, code, after - step
        depth = int(after[-1]) if len(after) else depth


def _key_before(file, place: int) -> str | None:
    """The key of the value that starts at ``place``; None where it has none."""
    back = LOOK
    while True:
        begin = max(0, place - back)
        file.seek(begin)
        text = file.read(place - begin).rstrip(_SPACE)
        if text and not text.endswith(b":"):
            return None
        text = text[:-1].rstrip(_SPACE)
        if text and not text.endswith(b'"'):
            return None
        quote = len(text) - 1
        while quote > 0:
            quote = text.rfind(b'"', 0, quote)
            if quote < 0:
                break
            slashes = len(text[:quote]) - len(text[:quote].rstrip(b"\\"))
            if slashes % 2 == 0 and (slashes < quote or begin == 0):
                return json.loads(text[quote:])
        if begin == 0:
            return None
        back *= 2


def _members(file, start: int, length: int, inside: bool, depth: int) -> Iterator[tuple[int, str, str]]:
    """Place, key and opening bracket of each array or object right below the root that starts in a range."""
    for place, _, at, code, before in _brackets(file, start, start + length, inside, depth):
        for i in np.flatnonzero((before == 1) & (_STEP[code] > 0)).tolist():
            key = _key_before(file, place + int(at[i]))
            if key is not None:
                yield place + int(at[i]), key, chr(code[i])


def _elements(file, start: int, length: int, inside: bool, depth: int, kind: str, begin: int, until: int) -> Iterator[list[tuple[int, bytes]]]:
    """Place and bytes of the objects of one member that start in a range, a list per piece; a member that is an object is its only element."""
    level, end = (2 if kind == "[" else 1), start + length
    opened, held, object_ = -1, b"", False  # the element that has started and not ended
    for place, raw, at, code, before in _brackets(file, start, until, inside, depth):
        step = _STEP[code]
        edge = np.flatnonzero((at + place >= begin) & np.where(step > 0, before == level, before == level + 1))
        out, cut = [], 0
        for offset, sign, letter in zip(at[edge].tolist(), step[edge].tolist(), code[edge].tolist()):
            if sign > 0:
                if place + offset >= end:
                    break
                opened, cut, object_ = place + offset, offset, letter == _OPEN_OBJECT
            elif opened >= 0:
                if object_:
                    out.append((opened, held + raw[cut:offset + 1]))
                opened, held = -1, b""
        if opened >= 0:
            held += raw[cut:]
        yield out
        if opened < 0 and place + len(raw) >= end:
            return


@dataclass(frozen=True)
class JsonFiles:
    """``ranges``: every range with its true start; ``members``: ``path, key, kind, begin, until`` of arrays and objects below the root."""

    ranges: DataFrame
    members: DataFrame

    def elements(self, *keys: str) -> DataFrame:
        """``path, key, place, text``: one row per object of the arrays ``keys``, or the object itself; only the ranges of these are read."""
        wanted = self.members.where(F.col("key").isin(*keys)).withColumnRenamed("path", "_p")
        near = (F.col("path") == F.col("_p")) & (F.col("start") < F.col("until")) & (F.col("start") + F.col("length") > F.col("begin"))
        rows = self.ranges.join(wanted, near).drop("_p")
        schema = pa.schema([("path", pa.string()), ("key", pa.string()), ("place", pa.int64()), ("text", pa.string())])

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                with open_file(row["path"]) as file:
                    for found in _elements(file, row["start"], row["length"], row["inside"], row["depth"], row["kind"], row["begin"], row["until"]):
                        if found:
                            places, texts = zip(*found)
                            head = [[row["path"]] * len(found), [row["key"]] * len(found)]
                            yield pa.record_batch([*head, places, [t.decode(errors="replace") for t in texts]], schema=schema)

        return _dealt(rows).mapInArrow(load, "path string, key string, place long, text string")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges are the unit of work, dealt one by one."""
    return ranges.repartition(max(1, ranges.sparkSession.sparkContext.defaultParallelism), "path", "start")


def scan_json(listed: DataFrame, range_bytes: int = RANGE) -> JsonFiles:
    """Find ranges and members of listed files ``path, size_bytes``, which Arrow file systems can open. Reads each byte once, and the few
    ranges that touch the root a second time; both results are small and written to the checkpoint folder."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = listed.where("size_bytes > 0").select("path", "size_bytes", starts)
    ranges = ranges.select("path", "size_bytes", "start", F.least(F.lit(range_bytes), F.col("size_bytes") - F.col("start")).alias("length"))
    names = ["quotes", "d0", "l0", "d1", "l1"]
    fields = [("path", pa.string()), ("size_bytes", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), *[(n, pa.int64()) for n in names]]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            with open_file(row["path"]) as file:
                told = dict(zip(names, _transition(file, row["start"], row["length"])))
            yield pa.RecordBatch.from_pylist([row | told], schema=pa.schema(fields))

    told = _dealt(ranges).mapInArrow(tell, "path string, size_bytes long, start long, length long, " + ", ".join(f"{n} long" for n in names))
    earlier = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("path")
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    told = told.withColumn("inside", so_far("quotes") % 2 == 1)
    pick = lambda out, into: F.when(F.col("inside"), F.col(into)).otherwise(F.col(out))
    told = told.withColumns({"_step": pick("d0", "d1"), "_low": pick("l0", "l1")}).withColumn("depth", so_far("_step"))
    closed = (F.sum("_step").over(whole) == 0) & (F.sum("quotes").over(whole) % 2 == 0) & (F.min(F.col("depth") + F.col("_low")).over(whole) >= 0)
    told = told.withColumn("_closed", closed).withColumn("low", F.col("depth") + F.col("_low"))
    told = cut_lineage(told.where("_closed").select("path", "size_bytes", "start", "length", "inside", "depth", "low"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("begin", pa.int64()), ("key", pa.string()), ("kind", pa.string())])
        for row in _rows(batches):
            with open_file(row["path"]) as file:
                for begin, key, kind in _members(file, row["start"], row["length"], row["inside"], row["depth"]):
                    found = {"path": row["path"], "size_bytes": row["size_bytes"], "begin": begin, "key": key, "kind": kind}
                    yield pa.RecordBatch.from_pylist([found], schema=schema)

    # A member starts at depth 1, so its range starts there or comes down to it.
    found = _dealt(told.where("low <= 1")).mapInArrow(find, "path string, size_bytes long, begin long, key string, kind string")
    order = W.partitionBy("path").orderBy("begin")
    found = found.withColumn("until", F.coalesce(F.lead("begin").over(order), "size_bytes"))
    last = found.groupBy("path", "key").agg(F.max_by(F.struct("kind", "begin", "until"), "begin").alias("m"))
    return JsonFiles(told.select("path", "start", "length", "inside", "depth"), cut_lineage(last.select("path", "key", "m.*")))
