"""Mixing sources to target weights by capped water-filling, in whole and fractional seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.llm.common import WORD, seeded, stage

SEED = 20_011
#: Rows whose order is decided in one task; a larger source is cut into more such pieces.
PIECE = 2_000


def numbered_sources(rows: DataFrame) -> DataFrame:
    """``source, docs, source_size, number`` by code point order of the source, null last.

    Spark compares strings by UTF-8 bytes, which is code point order. Sources are ordered in ranges and each range is
    counted on, so a table of very many sources is never sorted in one task.
    """
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ids = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    cut = stage(totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", ids), "sources")
    parts = cut.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return cut.withColumn("_part", F.shiftright("_id", 33)).join(parts, "_part").select(
        "source", "docs", "source_size", (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("number"),
    )


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows of ``source_size, weight``: shares of ``budget``, none above ``max_epochs`` times its size.

    A source over its cap is clamped there; what it cannot take is shared again among the others by weight, until no
    source is above. Each round is one small aggregate (three numbers come back), and each round but the last clamps one
    more source at least; the level only rises, so a clamped source stays so.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    clamped = -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        state = sources.agg(
            F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("used"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if state["n"] == clamped or not state["open"]:
            break
        clamped = state["n"]
        level = max(level, (budget - state["used"]) / float(state["open"]))
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, repeats, source, weight, text_key``, one row per document.

    ``weights`` repeat over the sources in code point order (null last). A source of target/size = whole + fraction takes
    each document ``whole`` times, and once more the first documents in seeded order whose middle word lies within the
    fraction, so its words come within half a document of the target. The order depends on seed, id and text alone:
    reruns agree.

    Nulls: a null source is a source of its own, the last; a null text has no words and is taken like others (no words
    come of it); a null id is drawn by its text. Equal rows may share the fate of their order. Empty tables give empty
    results. A budget above all caps leaves every source at its cap.
    """
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(text_col, F.lit(WORD))).cast("long").alias("size"),
        seeded(seed, F.col(id_col), F.col(text_col)).alias("_draw"), F.xxhash64(F.lit(seed + 1), F.col(text_col)).alias("_tie"),
    ), "mixing")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    sources = stage(numbered_sources(rows).withColumn("weight", F.get(kinds, (F.col("number") % len(weights)).cast("int"))), "weights")
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    sources = water_fill(sources, float(words) * share, max_epochs).withColumn("_parts", F.ceil(F.col("docs") / PIECE))
    marked = rows.join(
        sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s").withColumn("_part", F.floor(F.col("_draw") * F.col("_parts")).cast("long"))
    piece = ["source", "_part"]
    earlier = W.partitionBy(*piece).orderBy("_draw", "_tie", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per piece
    zero = F.lit(0).cast("long")
    starts = marked.groupBy(*piece).agg(F.sum("size").alias("_t")).select(
        F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_t").over(before), zero).alias("_b"),
    )
    ranked = marked.withColumn("_i", F.coalesce(F.sum("size").over(earlier), zero)).join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))
    )
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(epochs), F.lit(int(max_epochs)))
    rest = F.col("target") - whole * F.col("source_size")
    more = (whole < F.lit(max_epochs)) & (F.col("_b") + F.col("_i") + F.col("size") / 2 < rest)
    repeats = (whole + more.cast("long")).cast("long")
    return ranked.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * repeats).alias("taken"),
        repeats.alias("repeats"), "source", "weight", F.col("_tie").alias("text_key"),
    )


def repeat_rows(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed documents: each row as often as ``repeats`` says, a row taken zero times not at all.

    Rows are found again by id and text; rows equal in both are all repeated as often as the most repeated of them.
    """
    key = [F.col(id_col).alias("_mix_id"), F.xxhash64(F.lit(SEED + 1), F.col(text_col)).alias("_mix_text")]
    times = repeats.where("repeats > 0").groupBy(F.col("doc_id").alias("_times_id"), F.col("text_key").alias("_times_text")).agg(
        F.max("repeats").alias("_mix_n")
    )
    joined = docs.select("*", *key).join(
        times, F.col("_mix_id").eqNullSafe(F.col("_times_id")) & (F.col("_mix_text") == F.col("_times_text"))
    )
    copies = joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n"))))
    return copies.select(*[docs[c] for c in docs.columns])
