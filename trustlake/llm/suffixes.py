"""Removal of long repeated byte strings by interval expansion on Burrows-Wheeler transforms.

A string of ``LENGTH`` bytes (a window) is repeated if it starts at two places of the corpus. Equal windows have the same minimizer, the
least hash among their substrings of ``seed`` bytes. So:

1. Pieces: every text is cut into runs of neighbouring windows with one minimizer, each a piece of text named by (minimizer, content
   hash). Only names and places are kept, one row for some eighty bytes.
2. A minimizer that occurs once holds no repeat (but for a piece of periodic text, which is told by the minimizer standing in it twice). A piece that occurs twice is repeated as a whole. Different pieces of one
   minimizer are the edges of repeats; one text of each kind of piece is cut out again, and all pieces of a minimizer meet in a task.
3. There they form one string with its Burrows-Wheeler transform. Breadth-first backward extension of intervals derives common
   prefixes by increasing value: an interval of w becomes those of cw, and the rank behind each new one has the common prefix
   |w| with its predecessor if none is known yet. It stops at ``LENGTH``: ranks still open then share a whole window.
4. Repeated windows go back to all texts that hold the piece; covered bytes are taken out.

A minimizer with very many kinds of pieces (the edges of one passage in a third of all texts) is cut again by a longer seed, at last of
the window's own length, where every kind is one window and equal ones fold into one row. So no group is ever held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import arrow_batches, stage

LENGTH = 200
#: Lengths of the substrings whose least hash names a window; each is used for the minimizers that were too full under the one before.
SEEDS = (32, 184, 200)
#: Windows in a piece, and kinds of pieces of one minimizer that may meet in a task (about a megabyte).
PIECE, KINDS = 256, 2048
#: Bytes for one transform and for one round of hashing.
POOL, BLOCK = 1 << 18, 1 << 20

MULTIPLIER, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * MULTIPLIER
    return x ^ (x >> SHIFT)


def substring_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``length`` bytes: hashes of doubling length, and two overlapping ones at the end."""
    hashes, size = _mix(raw.astype(np.uint64) + np.uint64(1)), 1
    while size < length:
        step = min(size, length - size)
        hashes = _mix(hashes[:-step] + (hashes[step:] ^ (hashes[step:] >> np.uint64(31))) * np.uint64(3) + np.uint64(step))
        size += step
    return hashes


def sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """Least or greatest (``pick``) of each ``width`` neighbours, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = pick(values[:-step], values[step:])
        size += step
    return values


def window_runs(raw: np.ndarray, seed: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimizer of every piece of one text, and whether it holds its minimizer twice.

    Only a piece that holds it twice can repeat one of its own windows.
    """
    width = length - seed + 1
    hashes = substring_hashes(raw, seed)
    least = sliding(np.minimum, hashes, width)
    opens = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(opens, len(least)))
    cuts = -(-count // PIECE)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first = np.repeat(opens, cuts) + nth * PIECE
    windows = np.minimum(np.repeat(opens + count, cuts) - first, PIECE)
    around = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(hashes == sliding(np.maximum, np.concatenate([around, least, around]), width))
    names, place = np.unique(hashes[at], return_inverse=True)
    held = np.sort(place * len(raw) + at)
    own = np.searchsorted(names, least[first]) * len(raw) + first
    twice = np.searchsorted(held, own + windows + width - 1) - np.searchsorted(held, own) > 1
    return first, windows, least[first].view(np.int64), twice


def pieces_of(raw: bytes, seed: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """First window, number of windows, minimizer, content hash and doubt (see above) of every piece; very long texts block by block."""
    found, view = [], memoryview(raw)
    for at in range(0, max(1, len(raw) - length + 1), BLOCK):
        part = np.frombuffer(view[at:at + BLOCK + length - 1], dtype=np.uint8)
        if len(part) >= length:
            first, windows, least, twice = window_runs(part, seed, length)
            found.append((first + at, windows, least, twice))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    first, windows, least, twice = (np.concatenate(x) for x in zip(*found))
    digest = xxhash.xxh3_64_intdigest
    names = [digest(view[a:b]) for a, b in zip(first.tolist(), (first + windows + (length - 1)).tolist())]
    return first, windows, least, np.array(names, dtype=np.uint64).view(np.int64), twice


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, dtype=np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(7):  # nine bits a symbol
        key = (key << np.uint64(9)) | padded[k:k + n]
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    depth = 7
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)  # places in the order, whole groups of equal rank
        if not len(at):
            return order
        suffix = order[at]
        ahead = suffix + depth
        behind = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        both = rank[suffix] * (n + 1) + behind + 1
        moved = np.argsort(both)
        suffix, both = suffix[moved], both[moved]
        order[at] = suffix
        new = np.concatenate([[True], both[1:] != both[:-1]])
        fresh[at] = new
        rank[suffix] = np.maximum.accumulate(np.where(new, at, 0))
        depth *= 2


def open_ranks(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``text``, and which ranks share a prefix of ``length`` or more with the rank before.

    ``text`` ends with a symbol that is nowhere else. The queue holds the intervals whose right end was new; all of one
    prefix length are extended at once. ``step`` maps a rank to that of the suffix one symbol longer.
    """
    n = len(text)
    order = suffix_array(text)
    last = text[order - 1]  # the transform; before the first suffix stands the last symbol
    step = np.empty(n, dtype=np.int64)
    step[np.argsort(last.astype(np.int16), kind="stable")] = np.arange(n)  # a radix sort
    unknown = np.ones(n + 1, dtype=bool)
    unknown[[0, n]] = False
    low, high = np.zeros(1, dtype=np.int64), np.full(1, n, dtype=np.int64)  # half open
    for _ in range(length):
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        moved = step[inside]
        symbol = last[inside]
        if len(moved) * 4 > n:  # many: lay the intervals out over all ranks, neighbours of one owner and symbol are one
            label = np.full(n, -1, dtype=np.int64)
            label[moved] = owner * 512 + symbol
            at = np.flatnonzero(label >= 0)
            label = label[at]
        else:
            by = np.argsort(moved)
            at, label = moved[by], (owner * 512 + symbol)[by]
        begins = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (at[1:] != at[:-1] + 1)]))
        low = at[begins]
        high = at[np.append(begins[1:], len(at)) - 1] + 1
        new = unknown[high]
        low, high = low[new], high[new]
        unknown[high] = False
        if not len(low):
            break
    return order, unknown[:n]


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """``(piece, from, to)``: windows of each piece (half open) that also start at another place of these pieces."""
    joined = np.concatenate([np.append(np.frombuffer(p, dtype=np.uint8).astype(np.int16) + 2, 1) for p in pieces] + [np.zeros(1, dtype=np.int16)])
    order, shared = open_ranks(joined, length)
    shared[:-1] |= shared[1:]
    starts = np.zeros(len(joined) + 1, dtype=bool)
    starts[order[shared]] = True
    sizes = np.array([len(p) for p in pieces])
    first = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    offset = np.arange(len(owner)) - first[owner]
    starts[: len(owner)] &= offset <= (sizes - length)[owner]  # a window ends within its piece
    starts[len(owner):] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], starts]).astype(np.int8)))
    low, high = edge[::2], edge[1::2]
    return [(int(owner[a]), int(offset[a]), int(offset[a] + b - a)) for a, b in zip(low, high)]


def _text_names(text: str) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


PLACES = "key long, name long, t1 long, t2 long, first int, windows int, twice boolean"


def find_pieces(texts: DataFrame) -> DataFrame:
    """Names and places of all pieces. A task passes a text on twice at most: more copies say no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: dict[tuple[int, int], int] = {}
        for batch in batches:
            out, refs, sizes = [], [], []
            for t1, t2, raw in zip(batch["t1"].tolist(), batch["t2"].tolist(), batch["raw"]):
                times = told[t1, t2] = told.get((t1, t2), 0) + 1
                if times <= 2:
                    out.append(pieces_of(raw, SEEDS[0]))
                    refs.append((t1, t2))
                    sizes.append(len(out[-1][0]))
            if sum(sizes):
                first, windows, key, name, twice = (np.concatenate(x) for x in zip(*out))
                t1, t2 = (np.repeat(np.array(x, dtype=np.int64), sizes) for x in zip(*refs))
                yield pd.DataFrame({"key": key, "name": name, "t1": t1, "t2": t2, "first": first.astype(np.int32), "windows": windows.astype(np.int32), "twice": twice})

    return texts.mapInPandas(run, PLACES)


def cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, name, piece`` for ``wanted`` (``t1, t2, pieces``): the bytes of those pieces from one copy of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, pieces in zip(batch["raw"], batch["pieces"]):
                out += [(p["key"], p["name"], raw[p["first"]:p["first"] + p["windows"] + LENGTH - 1]) for p in pieces]
            yield pd.DataFrame(out, columns=["key", "name", "piece"])

    return texts.join(wanted, ["t1", "t2"]).select("raw", "pieces").mapInPandas(run, "key long, name long, piece binary")


WINDOWS = "key long, name long, low int, high int"


def _expand(pieces: DataFrame) -> DataFrame:
    """Repeated windows among the pieces of each minimizer: minimizers are pooled into transforms of about ``POOL`` bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, size, key = [], 0, None

        def done() -> pd.DataFrame:
            found = repeated_windows([p[2] for p in pool])
            return pd.DataFrame([(pool[i][0], pool[i][1], a, b) for i, a, b in found], columns=["key", "name", "low", "high"])

        for batch in batches:
            for row in zip(batch["key"].tolist(), batch["name"].tolist(), batch["piece"]):
                if size > POOL and row[0] != key:
                    yield done()
                    pool, size = [], 0
                pool.append(row)
                key, size = row[0], size + len(row[2])
        if pool:
            yield done()

    return pieces.repartition("key").sortWithinPartitions("key", "name").mapInPandas(run, WINDOWS)


def _refine(pieces: DataFrame, seed: int) -> DataFrame:
    """The pieces cut by a longer seed: ``key2, name2, piece2`` beside ``key, name`` and the offset ``at`` in their piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, name, piece in zip(batch["key"].tolist(), batch["name"].tolist(), batch["piece"]):
                first, windows, least, names, _ = pieces_of(piece, seed)
                out += [(key, name, a, k, m, piece[a:a + w + LENGTH - 1]) for a, w, k, m in zip(first.tolist(), windows.tolist(), least.tolist(), names.tolist())]
            yield pd.DataFrame(out, columns=["key", "name", "at", "key2", "name2", "piece2"])

    return pieces.select("key", "name", "piece").mapInPandas(run, "key long, name long, at int, key2 long, name2 long, piece2 binary")


def windows_between(pieces: DataFrame, level: int = 0) -> DataFrame:
    """``key, name, low, high``: windows that different pieces of one minimizer share, or one piece holds twice."""
    kinds = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    crowded = stage(kinds.where(F.col("kinds") > KINDS).select("key"), "crowded")
    if level + 1 == len(SEEDS) or crowded.isEmpty():
        return _expand(pieces)
    found = _expand(pieces.join(crowded, "key", "left_anti"))
    finer = stage(_refine(pieces.join(crowded, "key", "left_semi"), SEEDS[level + 1]), "finer")
    again = finer.groupBy("key2", "name2").agg(F.count(F.lit(1)).alias("times"), F.first("piece2").alias("piece"))
    again = stage(again.select(F.col("key2").alias("key"), F.col("name2").alias("name"), "times", "piece"), "again")
    whole = again.where("times > 1").select("key", "name", F.lit(0).alias("low"), (F.octet_length("piece") - LENGTH + 1).alias("high"))
    long = F.max(F.octet_length("piece")) > LENGTH  # several windows: they may be equal
    several = again.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), long.alias("_long")).where("kinds > 1 OR _long").select("key")
    mixed = stage(again.join(several, "key", "left_semi").select("key", "name", "piece"), "mixed")
    inner = whole.unionByName(windows_between(mixed, level + 1)).select(F.col("key").alias("key2"), F.col("name").alias("name2"), "low", "high")
    back = finer.drop("piece2").join(inner, ["key2", "name2"])
    return found.unionByName(back.select("key", "name", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")))


def strip(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, number of maximal removed runs, and what is left after taking out the (overlapping) ranges."""
    low, high = (np.array(x, dtype=np.int64) for x in zip(*sorted(ranges)))
    high = np.maximum.accumulate(high)
    begins = np.concatenate([[True], low[1:] > high[:-1]])
    low, high = low[begins], high[np.append(np.flatnonzero(begins)[1:], len(high)) - 1]
    edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(raw)]
    view = memoryview(raw)
    return int((high - low).sum()), len(low), b"".join(view[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Every byte of the UTF-8 text under a window of ``LENGTH`` bytes that starts at another place too, in the same text or another, is
    removed; windows never cross documents and are judged on the input. ``kept`` is what is left (binary), null where the text is whole.

    A null text counts as empty; texts shorter than a window stay whole. Equal texts, rows of one id and rows of a null id
    are documents of their own, so copies remove each other. Long texts are read whole. An empty table gives no row; other columns
    play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = rows.where(F.octet_length("text") >= LENGTH).select(*_text_names("text"), F.col("text").cast("binary").alias("raw"))
    with arrow_batches(spark, 256):
        places = stage(find_pieces(texts), "places")
        repeated = places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("_twice")).where("n > 1 OR _twice").select("key")
        held = stage(places.join(repeated, "key"), "held")
        names = stage(
            held.groupBy("key", "name").agg(F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice"), F.min(F.struct("t1", "t2", "first", "windows")).alias("at")),
            "names",
        )
        several = names.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("_twice")).where("kinds > 1 OR _twice").select("key")
        wanted = names.join(several, "key").select("key", "name", "at.*").groupBy("t1", "t2").agg(
            F.collect_list(F.struct("key", "name", "first", "windows")).alias("pieces")
        )
        one_copy = texts.groupBy("t1", "t2").agg(F.first("raw").alias("raw"))
        pieces = stage(cut_out(one_copy, wanted), "pieces")
    with arrow_batches(spark, 4096):
        windows = stage(windows_between(pieces), "windows")
    whole = names.where("times > 1").select("key", "name")
    everywhere = held.join(whole, ["key", "name"]).select("t1", "t2", F.col("first").alias("low"), (F.col("first") + F.col("windows")).alias("high"))
    partly = held.join(windows, ["key", "name"]).select("t1", "t2", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    ranges = everywhere.unionByName(partly).groupBy("t1", "t2").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t1, t2, raw, found in zip(batch["t1"], batch["t2"], batch["raw"], batch["ranges"]):
                removed, spans, kept = strip(raw, [(r["low"], r["high"] + LENGTH - 1) for r in found])
                out.append((t1, t2, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    with arrow_batches(spark, 256):
        cleaned = stage(one_copy.join(ranges, ["t1", "t2"]).mapInPandas(run, schema), "cleaned")
    plain = rows.select("doc_id", *_text_names("text"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_sha"))
    return plain.join(cleaned, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"), "kept",
    )
