"""Quality rules: per-text counts, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import stage, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SALTS = 64


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """64-bit hash of every ``width``-word window; no window in a shorter text."""
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    return F.when(F.size(words) >= width, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(
        F.array().cast("array<bigint>")
    )


def repeated_window_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more in the text, first occurrences included.

    Where all hashes differ, the usual case, a hash set decides; else the hashes are sorted with their positions, equal
    neighbours give the covered positions, and overlaps are counted once.
    """
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # Neighbours are compared by zipping the sorted array with itself moved by one.
    zipped = F.arrays_zip(
        placed.alias("at"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), placed).alias("before"),
        F.slice(placed, 2, F.size(placed)).alias("behind"),
    )
    twice = F.filter(zipped, lambda z: (
        z["at"].isNotNull() & ((z["at"]["h"] == z["before"]["h"]) | (z["at"]["h"] == z["behind"]["h"]))
    ))
    at = F.sort_array(F.transform(twice, lambda z: z["at"]["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(0).alias("sum"), F.lit(-width).alias("last")),
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(width), i - acc["last"])).alias("sum"), i.alias("last")),
    )["sum"]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0).cast("long")


def text_counts(docs: DataFrame, id_col: str, text_col: str, host: Column) -> DataFrame:
    """One row per document with the base counts, the host and the hashes and sizes of its distinct lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.split(text, "\n")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), host.alias("host"), F.col(text_col).alias("text")
    ).withColumn("_words", words_of(F.col("text"))).withColumn("_lines", F.filter(raw, lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("_hashes", window_hashes(F.col("_words")))
    blanks = F.translate(text, " \t\n\x0b\x0c\r", "")
    return rows.select(
        "doc_id", "host", F.size("_words").cast("long").alias("n_words"), F.length(blanks).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_hashes")).alias("n_repeat_words"), F.xxhash64("text").alias("text_key"),
        F.transform("_lines", lambda line: F.struct(line_key(line).alias("key"), F.size(words_of(line)).alias("words"))).alias("lines"),
    )


def line_key(line: Column) -> Column:
    """Hash of a line without case, digits, punctuation at its ends and runs of white space."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")
    return F.xxhash64(F.trim(plain))


def frequent_lines(counted: DataFrame, share: float, least: int, salts: int = SALTS, by_text: bool = False) -> DataFrame:
    """``host, key, docs``: lines in more distinct documents of their host than ``max(least, share * documents)``.

    Documents are told apart by their ids, and by their texts where the id is null. With ``by_text`` documents of equal text
    are one, so that copies do not make each other's lines look like boilerplate. Counting goes by (host, line, salt) before
    it goes by (host, line), so that a line of a third of all documents meets in many tasks.
    """
    text = F.col("text_key")
    unit = text if by_text else F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text.cast("string")), F.lit("text"))
    units = counted.withColumn("_unit", unit)
    one = units.select("host", "_unit").distinct()
    limits = one.groupBy("host").agg(F.greatest(F.lit(float(least)), F.count(F.lit(1)) * F.lit(share)).alias("limit"))
    lines = units.select("host", "_unit", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    salt = F.pmod(F.col("_unit") if by_text else F.xxhash64("_unit"), F.lit(salts)).cast("int").alias("salt")
    part = lines.groupBy("host", "key", salt).agg(F.count_distinct("_unit").alias("docs"))
    total = part.groupBy("host", "key").agg(F.sum("docs").alias("docs")).where(F.col("docs") > least)
    bounded = total.join(limits.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).where(F.col("docs") > F.col("limit"))
    return bounded.select("host", "key", "docs")


def line_quality(
    docs: DataFrame, host: Column | None = None, share: float = 0.01, least: int = 20, min_words: int = 20, most_removed: float = 0.8,
    id_col: str = "doc_id", text_col: str = "text", by_text: bool = False,
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words``.

    Base rules fail texts of under 20 words and texts of which more than 30 of 100 words lie in repeated windows. Then lines
    that more than ``max(least, share * documents of the host)`` distinct documents of a host hold (distinct texts with
    ``by_text``) are taken out, and a text is rejected when that leaves fewer than ``min_words`` words or takes more than ``most_removed`` of them.

    ``host`` defaults to the column ``source``. Nulls: a null text has no words and fails; a null host is a host of its own;
    a null id is kept in the result. Repeated rows are judged alike. Long texts are read whole. An empty table gives no row.
    """
    host = F.col("source") if host is None else host
    counted = stage(text_counts(docs, id_col, text_col, host.cast("string")), "lines")
    frequent = frequent_lines(counted, share, least, by_text=by_text)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    known = frequent.select(F.col("host").alias("_h"), F.col("key").alias("_k"), salts.alias("_s"))
    # One row per distinct line of a distinct text; equal rows of the table share it.
    texts = counted.groupBy("host", "text_key").agg(F.min(F.struct("n_words", "lines")).alias("_t")).select("host", "text_key", F.explode("_t.lines").alias("_line"))
    looked = texts.select("host", "text_key", F.col("_line.key").alias("key"), F.col("_line.words").alias("words"), F.pmod("text_key", F.lit(SALTS)).cast("int").alias("salt"))
    hit = looked.join(
        known, F.col("host").eqNullSafe(F.col("_h")) & (F.col("key") == F.col("_k")) & (F.col("salt") == F.col("_s"))
    ).groupBy("host", "text_key").agg(F.sum("words").alias("removed_words"))
    hit = hit.select(F.col("host").alias("_h"), F.col("text_key").alias("_t"), "removed_words")
    joined = counted.drop("lines").join(hit, F.col("host").eqNullSafe(F.col("_h")) & (F.col("text_key").eqNullSafe(F.col("_t"))), "left")
    removed = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (removed > 0) & ((F.col("n_words") - removed < min_words) | (removed > most_removed * F.col("n_words")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"), removed.alias("removed_words"),
    )


def without_frequent_lines(docs: DataFrame, frequent: DataFrame, host: Column, text_col: str = "text") -> DataFrame:
    """``docs`` with the frequent lines cut out of their texts. ``frequent`` (host, key) is grouped per host into one array."""
    per_host = frequent.groupBy(F.col("host").alias("_lh")).agg(F.collect_set("key").alias("_cut"))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda line: ~F.array_contains(F.col("_cut"), line_key(line)))
    joined = docs.join(per_host, host.eqNullSafe(F.col("_lh")), "left")
    text = F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)
