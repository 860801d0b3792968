"""Alignment of two tokenizers over the same texts.

Both token sequences of a text spell the same bytes. A pointer into either sequence walks along; the pair under the pointers
is a link, the pointer whose token ends first moves on, and where both end together there is a cut that closes a group. All
documents of a batch walk in lockstep: one NumPy vector of pointer pairs, one step for all, finished ones taken out of
the vector. A long document is several lanes of that vector, each a run of its A tokens, so that no document keeps the others waiting.

The tokenizers cut texts at single spaces between other characters before anything else, so a batch is encoded by its distinct
words; texts with other white space are encoded whole.

Counts of linked id pairs are needed corpus-wide. Documents are packed in chunks of some megabytes of text; a chunk keeps
its distinct pairs, so what is shuffled to count pairs and to bring counts back is the vocabulary of a chunk, not its links.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import arrow_batches, stage

#: Tokens of one lane: a step of the lockstep costs as much for few lanes as for many.
LANE = 256
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Ids of words that a Python worker keeps.
CACHED_IDS = 4_000_000
#: How byte-level files cut texts (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space next to a space or at either end, or the piece model's own space mark: such texts are encoded whole.
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = rf"\A{SPACES}|{SPACES}\z| {SPACES}|{SPACES} |\x{{2581}}|\A\z"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def id_strings(size: int, last: str) -> np.ndarray:
    """Decimal ids below ``size``, each with a comma (even rows) and with ``last`` (odd rows), as zero-padded bytes."""
    table = np.array([f"{i}{end}".encode() for i in range(size) for end in (",", last)])
    return table.view(np.uint8).reshape(len(table), -1)


class Tokenizers:
    """Both tokenizers of a Python worker, what their ids spell, and the ids of the words seen so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        vocabulary, self.a = byte_level_bpe(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()
            for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        ]
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        # A boundary before a space is none for a model that has a piece with a space behind another character.
        self.by_words = not any(b" " in x.lstrip(b" ") for x in self.bytes_b)
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        width = max(len(str(size_a)), len(str(size_b))) + 1
        strings = [id_strings(size_a, "|"), id_strings(size_b, ";")]
        self.strings = np.concatenate([np.pad(s, ((0, 0), (0, width - s.shape[1]))) for s in strings])
        self.string_lengths = (self.strings != 0).sum(axis=1)
        self.b_strings = 2 * size_a
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.sizes, self.same = (array("i"), array("i")), (array("q"), array("q")), array("b")

    def add(self, units: list[str]) -> None:
        """Append ids of A, ids of B, and whether both spell a space and the unit, for units without a row."""
        ids_b = self.b.encode(units, num_threads=1)
        for unit, b in zip(units, ids_b):
            want = " " + unit
            a = self.a.encode_ordinary(want)
            self.same.append(b"".join([self.bytes_a[i] for i in a]) == (raw := want.encode()) and b"".join([self.bytes_b[i] for i in b]) == raw)
            for side, ids in enumerate((a, b)):
                self.ids[side].extend(ids)
                self.sizes[side].append(len(ids))
            self.rows[unit] = len(self.rows)

    def encode(self, units: list[str]) -> np.ndarray:
        """Rows of the units in the table."""
        if len(self.ids[0]) > CACHED_IDS:
            self.forget()
        rows = self.rows
        self.add([u for u in units if u not in rows])
        return np.fromiter((rows[u] for u in units), dtype=np.int64, count=len(units))


def byte_level_bpe(path: str):
    """``(id -> bytes, encoder)`` of a byte-level BPE file whose merges stand in order of their ids; special tokens stay plain text."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    kind, model = told["pre_tokenizer"], told["model"]
    if told["normalizer"] or (kind["type"], kind["add_prefix_space"], kind["use_regex"]) != ("ByteLevel", False, True):
        raise ValueError(f"{path} is no plain byte-level file")
    chars = _byte_of_char()
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    joined = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if joined != sorted(joined):
        raise ValueError(f"merges of {path} are not in order of their ids")
    return {i: raw for raw, i in ranks.items()}, tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def tokenizers_of_worker(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def gather(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``values[begin[k]: begin[k] + count[k]]`` for every k, one after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begin - (ends - count), count)]


def encode_batch(tok: Tokenizers, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and of B of all texts, one after another, and how many each text has; texts without tokens have none."""
    whole = pa.array(texts, type=pa.large_string())
    odd = np.asarray(pc.fill_null(pc.match_substring_regex(whole, ODD), True)) if tok.by_words else np.ones(len(texts), dtype=bool)
    parts = pc.split_pattern(pc.if_else(pa.array(odd), None, whole), " ")
    held = np.asarray(pc.fill_null(pc.list_value_length(parts), 0)).astype(np.int64)
    coded = pc.list_flatten(parts).dictionary_encode()
    words = coded.dictionary.to_pylist()
    rows = tok.encode(words)
    tok.add([t for t in dict.fromkeys(texts[k] for k in np.flatnonzero(odd) if texts[k]) if t not in tok.rows])
    place = rows[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(words) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), held)
    bad = np.bincount(owner, weights=1 - np.frombuffer(tok.same, dtype=np.int8)[place], minlength=len(texts)) > 0
    # What one word lacks another could make up for: such texts, too, are judged whole.
    tok.add([t for t in dict.fromkeys(texts[k] for k in np.flatnonzero(bad)) if t not in tok.rows])
    alone = np.flatnonzero(odd | bad)
    alone = alone[[bool(texts[k]) and tok.same[tok.rows[texts[k]]] == 1 for k in alone]] if len(alone) else alone
    keep = ~bad[owner]
    place, owner = np.concatenate([place[keep], [tok.rows[texts[k]] for k in alone]]).astype(np.int64), np.concatenate([owner[keep], alone])
    order = np.argsort(owner, kind="stable")
    place, owner = place[order], owner[order]
    out = []
    for side in (0, 1):
        size, flat = np.array(tok.sizes[side]), np.array(tok.ids[side])
        out.append(gather(flat, (np.cumsum(size) - size)[place], size[place]))
        out.append(np.bincount(owner, weights=size[place], minlength=len(texts)).astype(np.int64))
    return out[0], out[2], out[1], out[3]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A index, B index) and cuts (A index, B index) of sequences laid one after another.

    ``end_a`` and ``end_b`` are the byte offsets where tokens end, rising over all documents; ``first_a`` are the first A tokens of
    the documents that have tokens. Each lane owns the links and cuts of its A tokens.
    """
    if not len(end_a):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    opens = np.union1d(first_a, np.arange(0, len(end_a), LANE))
    i, stop = opens.copy(), np.append(opens[1:], len(end_a))
    j = np.searchsorted(end_b, np.where(i > 0, end_a[i - 1], 0), side="right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        ahead = end_a[i] - end_b[j]
        together = ahead == 0
        cuts_a.append(i[together])
        cuts_b.append(j[together])
        i = i + (ahead <= 0)
        j = j + (ahead >= 0)
        walking = i < stop
        if not walking.all():
            i, j, stop = i[walking], j[walking], stop[walking]
    return tuple(np.concatenate(x) for x in (links_a, links_b, cuts_a, cuts_b))


def group_hashes(tok: Tokenizers, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for every document, an empty string for one without tokens."""
    last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    last_a[cuts_a] = 1
    last_b[cuts_b] = 1
    groups = len(cuts_a)
    of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    held_a, held_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + (np.cumsum(held_b) - held_b)[of_a]] = 2 * a.astype(np.int64) + last_a
    codes[np.arange(len(b)) + np.cumsum(held_a)[of_b]] = 2 * b.astype(np.int64) + last_b + tok.b_strings
    ends = np.concatenate([[0], np.cumsum(tok.string_lengths[codes])])
    raw = tok.strings[codes].reshape(-1)
    raw = memoryview(raw[raw != 0].tobytes())
    bounds = ends[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    return [hashlib.sha256(raw[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def align(tok: Tokenizers, texts: list[str | None]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Figures of every text; and document, pair (A id in the upper half) and times of its distinct linked pairs."""
    a, b, n_a, n_b = encode_batch(tok, texts)
    bounds_a = np.cumsum(n_a) - n_a
    links_a, links_b, cuts_a, cuts_b = lockstep(np.cumsum(tok.length_a[a]), np.cumsum(tok.length_b[b]), bounds_a[n_a > 0])
    docs_of_a = np.repeat(np.arange(len(texts)), n_a)
    doc = docs_of_a[links_a]
    frame = pd.DataFrame({
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(docs_of_a[cuts_a], minlength=len(texts)),
        "n_links": np.bincount(doc, minlength=len(texts)),
        "groups_sha256": group_hashes(tok, a, b, n_a, n_b, cuts_a, cuts_b),
    })
    pair = (a[links_a].astype(np.int64) << 32) | b[links_b]
    names, place = np.unique(pair, return_inverse=True)
    held, times = np.unique(doc * max(1, len(names)) + place, return_counts=True)
    return frame, held // max(1, len(names)), names[held % max(1, len(names))] if len(names) else names, times


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
CHUNKS = (
    "chunk long, docs array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in FIGURES) + ", groups_sha256 array<string>, "
    "pairs array<bigint>, with_pair array<bigint>, held binary, which binary, times binary"
)


def align_chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Packed chunks of documents: figures, distinct pairs with the number of documents that hold them, and each document's pairs."""

    def pack(number: int, ids: list, frames: list[pd.DataFrame], doc: list, pair: list, times: list) -> pd.DataFrame:
        shift = np.cumsum([0] + [len(f) for f in frames])
        doc = np.concatenate([d + s for d, s in zip(doc, shift)])
        names, which, with_pair = np.unique(np.concatenate(pair), return_inverse=True, return_counts=True)
        frame = pd.concat(frames)
        return pd.DataFrame({
            "chunk": [number], "docs": [ids], **{c: [frame[c].to_numpy()] for c in FIGURES}, "groups_sha256": [frame["groups_sha256"].tolist()],
            "pairs": [names], "with_pair": [with_pair], "held": [np.bincount(doc, minlength=len(ids)).astype("<u4").tobytes()],
            "which": [which.astype("<u4").tobytes()], "times": [np.concatenate(times).astype("<u4").tobytes()],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, number = tokenizers_of_worker(path_a, path_b), TaskContext.get().partitionId() << 32
        ids, parts, size = [], [], 0
        for batch in batches:
            texts = batch["text"].tolist()
            lengths = np.array([len(t) if t else 0 for t in texts])
            keys = [None if k is None or k != k else int(k) for k in batch["doc_id"].astype(object)]
            bounds = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(lengths) // (CHUNK_BYTES // 4)])))
            for low, high in zip([0, *bounds[bounds > 0].tolist()], [*bounds[bounds > 0].tolist(), len(texts)]):
                parts.append(align(tok, texts[low:high]))
                ids += keys[low:high]
                size += int(lengths[low:high].sum())
                if size >= CHUNK_BYTES:
                    yield pack(number, ids, *map(list, zip(*parts)))
                    ids, parts, size, number = [], [], 0, number + 1
        if ids:
            yield pack(number, ids, *map(list, zip(*parts)))

    return docs.mapInPandas(run, CHUNKS)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A (a byte-level BPE file of ``tokenizers``) encodes a space and the text, B (a SentencePiece model that adds the space itself) the text; marks of
    special tokens are plain text. ``n_best`` counts links whose pair is held by the most documents for its A id (ties included), ``count_sum`` adds up
    how many documents hold the pair of each link.

    A text that is null or empty, or that one of the tokenizers does not spell back, has no tokens: zeros and an empty string.
    Rows of one id, and rows of a null id, each are a document of their own and count as such. Long texts are read
    whole. An empty table gives no row; other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_batches(spark, 256):
        chunks = stage(align_chunks(rows, path_a, path_b), "aligned")
    pairs = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "with_pair")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.with_pair").alias("docs"))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    rated = stage(counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    back = pairs.join(rated, "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("r")).select(
        "chunk", F.col("r.count").alias("counts"), F.col("r.best").alias("best")
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch.itertuples(index=False):
                size, which, times = (np.frombuffer(x, dtype="<u4").astype(np.int64) for x in (c.held, c.which, c.times))
                ends = np.cumsum(size)
                sums = [np.concatenate([[0], np.cumsum(times * np.asarray(x, dtype=np.int64)[which])]) for x in (c.best, c.counts)]
                yield pd.DataFrame({
                    "doc_id": pd.array([None if k is None or k != k else int(k) for k in c.docs], dtype="Int64"), **{f: getattr(c, f) for f in FIGURES},
                    "n_best": sums[0][ends] - sums[0][ends - size], "count_sum": sums[1][ends] - sums[1][ends - size], "groups_sha256": c.groups_sha256,
                })

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    with arrow_batches(spark, 1):
        kept = ["chunk", "docs", *FIGURES, "groups_sha256", "held", "which", "times"]
        scored = chunks.select(*kept).join(back, "chunk", "left").mapInPandas(score, schema)
        return stage(scored, "alignment")
