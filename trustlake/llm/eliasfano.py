"""Token ids in blocks with Elias-Fano coded document boundaries.

A block is one row of a Parquet table (so Spark's commit protocol covers lost tasks and any store works): the
concatenated ids of consecutive documents as little-endian integers, and two Elias-Fano sequences, the end offset of
each document and the document ids. An Elias-Fano sequence of n values up to u keeps the low ``l = log2(u / n)`` bits
of each value packed, and the high parts as unary gaps in a bit vector of ``n + u / 2^l`` bits, a little over
``2 + log2(u / n)`` bits a value in place of 64; ``select(i)`` finds the i-th set bit through sampled positions.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.llm.common import small_batches
from trustlake.session import sized_broadcast

#: Set bits between two sampled positions of the high bit vector.
SAMPLE = 512
#: A block is closed when it holds this many ids; one document is never split.
BLOCK_IDS = 1 << 20
BLOCKS = (
    "block long, first_doc long, docs long, nulls long, ids_total long, id_bytes int, ids binary, "
    "ends_low binary, ends_high binary, ends_samples binary, ends_top long, "
    "keys_base long, keys_low binary, keys_high binary, keys_samples binary, keys_top long"
)


def _low_bits(count: int, top: int) -> int:
    return max(0, (top // count).bit_length() - 1) if count else 0


def encode(values: np.ndarray, top: int) -> tuple[bytes, bytes, bytes]:
    """Low bits, high bits and select samples of non-decreasing ``values`` in ``[0, top]``."""
    values = values.astype(np.uint64)
    n = len(values)
    low = _low_bits(n, top)
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    high[ones] = 1
    return (
        np.packbits(bits, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(),
        ones[::SAMPLE].astype("<u8").tobytes(),
    )


class EliasFano:
    """Reader of one encoded sequence: ``select`` for single positions, ``all`` for every value."""

    def __init__(self, low: bytes, high: bytes, samples: bytes, count: int, top: int):
        self.count, self.width = count, _low_bits(count, top)
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u8")

    def _low_part(self, rank: int) -> int:
        start = rank * self.width
        byte, shift = divmod(start, 8)
        chunk = int.from_bytes(self.low[byte:(start + self.width + 7) // 8].tobytes(), "little")
        return (chunk >> shift) & ((1 << self.width) - 1)

    def select(self, rank: int) -> int:
        """The value at ``rank``: jump to the sampled bit before it, then count set bits byte by byte."""
        if not 0 <= rank < self.count:
            raise IndexError(rank)
        position = int(self.samples[rank // SAMPLE])
        left = rank % SAMPLE
        byte = position // 8
        rest = int(self.high[byte]) >> (position % 8) << (position % 8)
        while left >= rest.bit_count():
            left -= rest.bit_count()
            byte += 1
            rest = int(self.high[byte])
        for _ in range(left):
            rest &= rest - 1
        position = byte * 8 + (rest & -rest).bit_length() - 1
        return ((position - rank) << self.width) | self._low_part(rank)

    def all(self) -> np.ndarray:
        if not self.count:
            return np.zeros(0, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        value = (ones - np.arange(self.count)) << self.width
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.width].reshape(self.count, self.width)
            value = value | (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return value.astype(np.int64)


def _block(number: int, keys: list[int | None], parts: list[bytes], width: int) -> tuple:
    nulls = sum(k is None for k in keys)
    known = np.array([k for k in keys if k is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    offsets = (known.astype(object) - base) if len(known) else np.zeros(0, dtype=object)
    span = int(offsets[-1]) if len(known) else 0
    ends = np.cumsum([len(p) // width for p in parts]).astype(np.uint64)
    top = int(ends[-1])
    return (
        number, base, len(keys), nulls, top, width, b"".join(parts), *encode(ends, top), top, base,
        *encode(offsets.astype(np.uint64), span), span,
    )


#: What str.split takes for white space but the tokenizer does not.
ODD_BLANK = re.compile("[\x1c-\x1f\x85]")
ASCII_WORD = re.compile("[^ \t\n\x0b\x0c\r]+")
#: Letters below this point are in composed form and lower-case one by one; all but U+0130, which becomes two characters.
LATIN_END, DOTTED = "\u0250", "\u0130"
#: Marks of ASCII that never join the letters before them; an apostrophe may.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def byte_letters() -> str:
    """The byte-level alphabet by byte: printable bytes stand for themselves, the others for the code points from 256 up.
    A space stays one, since words are told apart by it."""
    spare = iter(range(256, 512))
    shown = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(spare)) for b in range(256)]
    return "".join(shown[:32]) + " " + "".join(shown[33:])


class Words:
    """Ids of texts through a cache of words.

    The tokenizer cuts texts at white space before anything else, so the ids of a text are those of its words in order.
    A word of Latin letters, the bulk of all words, goes to the model without the costly normalising steps, which
    leave it as it is but for its case; marks behind its letters are a piece of their own. Every other word takes the
    whole way. Texts of Latin-1 are lowered first, so that the cases of a word are one entry.
    """

    def __init__(self, path: str, dtype: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.model = self.tokenizer.model
        self.bare = Tokenizer(self.model)  # the model alone, on words between spaces
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.dtype, self.pack, self.most = np.dtype(dtype), "H" if dtype == "<u2" else "I", most
        self.shown = byte_letters()
        # Two generations: when the newer one is full it becomes the older, which words in use move out of again.
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _raw(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.pack}", *ids)

    def _whole(self, words: list[str]) -> Iterator[bytes]:
        for start in range(0, len(words), 2000):
            for got in self.tokenizer.encode_batch_fast(words[start:start + 2000], add_special_tokens=False):
                yield self._raw(got.ids)

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """Ids of lower-case Latin words, thousands of them as one text for the model."""
        for start in range(0, len(words), 5000):
            some = words[start:start + 5000]
            shown = codecs.charmap_decode(" ".join(some).encode(), "strict", self.shown)[0]
            ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(some):  # the model does not mark ends of words
                yield from (self._raw([t.id for t in self.model.tokenize(w)]) for w in shown.split(" "))
                continue
            raw, at = ids.tobytes(), 0
            for end in ends.tolist():
                yield raw[at:end]
                at = end

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.most:
            self.old, self.known = self.known, {"": b""}
        if len(self.marks) > self.most:
            self.marks = {"": b""}
        known, old, marks = self.known, self.old, self.marks
        unknown = words.difference(known)
        fresh = unknown.difference(old)
        known.update((w, old[w]) for w in unknown.difference(fresh))
        parts, others, plain, tails = [], [], {}, {}
        for word in fresh:
            core = word.rstrip(MARKS)
            if not core.isalpha() or not core.isascii() and (max(core) >= LATIN_END or DOTTED in core):
                others.append(word)
                continue
            letters = core.lower()
            if letters not in known:
                plain[letters] = None
            if letters != word:
                tail = word[len(core):]
                if tail not in marks:
                    tails[tail] = None
                parts.append((word, letters, tail))
        known.update(zip(plain, self._letters(list(plain))))
        known.update(zip(others, self._whole(others)))
        marks.update(zip(tails, self._whole(list(tails))))
        known.update((word, known[letters] + marks[tail]) for word, letters, tail in parts)

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        end = self._raw([end_id])
        split = [ASCII_WORD.findall(t) if ODD_BLANK.search(t) else t.split() for t in map(lowered, texts)]
        self.learn(set().union(*split))
        known = self.known
        return [b"".join(itemgetter("", *words)(known)) + end for words in split]


def lowered(text: str) -> str:
    """A text of Latin-1 in lower case, which the tokenizer would come to anyway; any other text as it is."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


@lru_cache(maxsize=1)
def words_of_worker(path: str, dtype: str) -> Words:
    """One tokenizer and cache per Python worker, whatever number of tasks it runs."""
    return Words(path, dtype)


def write_token_blocks(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, wide: bool = False, block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text and write blocks in ascending order of the document id (null ids first).

    One shuffle by ranges of the id moves the texts; each range is encoded and packed as it streams through its task, so
    a task holds one block at a time. ``wide`` stores 32-bit ids, else 16-bit ones (vocabularies of up to 65,536).

    A null or empty text is encoded as the end id alone; long texts are encoded whole; rows of one id keep one entry each,
    in the order of their texts; an empty table writes no block. Other columns play no part.
    """
    small_batches(docs.sparkSession)
    dtype = "<u4" if wide else "<u2"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = words_of_worker(tokenizer_path, dtype)
        width, keys, parts, held = np.dtype(dtype).itemsize, [], [], 0
        number = TaskContext.get().partitionId() << 32  # ranges are numbered in order, and so are blocks
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            ids = [None if k is None or k != k else int(k) for k in batch["doc_id"].astype(object)]
            for key, raw in zip(ids, encoder.encode(texts, end_id)):
                keys.append(key)
                parts.append(raw)
                held += len(raw) // width
                if held >= block_ids:
                    yield pd.DataFrame([_block(number, keys, parts, width)], columns=names)
                    number, keys, parts, held = number + 1, [], [], 0
        if keys:
            yield pd.DataFrame([_block(number, keys, parts, width)], columns=names)

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The id alone is the range key: rows of one id stay together.
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    ordered.mapInPandas(pack, BLOCKS).write.parquet(folder)


def read_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: one row per document, from the written blocks alone.

    ``start`` counts the ids of all documents before; it is the running total over blocks plus the offset that the
    Elias-Fano sequence gives inside the block. The checksum is over the ids as little-endian 32-bit integers.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per block of a million ids
    starts = blocks.select("block", F.coalesce(F.sum("ids_total").over(before), F.lit(0).cast("long")).alias("block_start"))
    placed = blocks.join(sized_broadcast(starts), "block")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                ends = EliasFano(b.ends_low, b.ends_high, b.ends_samples, b.docs, b.ends_top).all()
                known = EliasFano(b.keys_low, b.keys_high, b.keys_samples, b.docs - b.nulls, b.keys_top).all() + b.keys_base
                ids = np.frombuffer(b.ids, dtype="<u4" if b.id_bytes == 4 else "<u2")
                begins = np.concatenate([[0], ends[:-1]])
                yield pd.DataFrame({
                    "doc_id": pd.array([None] * b.nulls + known.tolist(), dtype="Int64"), "start": begins + b.block_start,
                    "n_tokens": ends - begins,
                    "ids_crc32": [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(begins.tolist(), ends.tolist())],
                })

    return placed.mapInPandas(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")
