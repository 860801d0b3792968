"""Benchmark decontamination by template windows: copied questions are found even with other numbers, names or units.

Numbers, units behind numbers and capitalised words (adjoining ones as one) become typed placeholders, case and
punctuation go; a second view folds the case of the whole text and keeps its names as words. Windows of either view,
over the remaining tokens, are hashed and joined. A window counts when its values are the item's own, and a run of adjoining
windows when its values map consistently: an item's value is always answered by the same value of the text. Whether a text
holds an item with the item's own values is told from the whole alignment of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlake.llm.common import stage

NUMBER, UNIT, NAME = "", "", ""
WIDTH = 13
#: A template needs so many tokens, and so many words among them; items with fewer are matched with their values.
SHORTEST, LITERALS = 8, 6
#: Windows of a benchmark that may be broadcast (12 bytes each); beyond it both sides are shuffled by the hash.
BROADCAST_WINDOWS = 2_000_000
#: Words in a row by which a text is known to be worth a closer look.
ANCHOR = 3
#: Windows of items that one hash brings to one key of a join; more are dealt out.
SHARE = 1000
UNITS = (
    "mm|cm|dm|m|km|in|ft|yd|mi|miles|metres|meters|mg|g|kg|t|lb|oz|grams|ml|l|litres|liters|s|sec|seconds|min|minutes|h|hours|days|weeks|"
    "months|years|K|V|W|kW|A|J|kJ|Hz|kHz|MHz|Pa|bar|km/h|mph|percent|euros|dollars|cents|pounds"
)
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
_ONE_NAME = r"\p{Lu}\p{Ll}++(?!\p{L})"
#: Adjoining names are one: New York answers Berlin.
_NAME = rf"(?<!\p{{L}}){_ONE_NAME}(?:[^\p{{L}}\p{{N}}{NUMBER}{UNIT}{NAME}]++{_ONE_NAME})*+"
_UNIT_AFTER = rf"(?<=[0-9]|[0-9] )(?i:{UNITS})(?![\p{{L}}\p{{N}}])"
#: A text is seen in two ways: with names as placeholders, and with all words in one case and names as words.
#: Items that are too short or too poor in words for that are seen exactly: in one case, with numbers and units as words.
NAMED, FOLDED, EXACT = "named", "folded", "exact"
_SLOTS = {NAMED: rf"{_NUMBER}|{_UNIT_AFTER}|{_NAME}", FOLDED: rf"{_NUMBER}|{_UNIT_AFTER}"}


def _plain(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(f"[{NUMBER}{UNIT}{NAME}]"), F.translate(text, NUMBER + UNIT + NAME, "   ")).otherwise(text)


def _fold(text: Column) -> Column:
    return F.lower(F.upper(text))  # the detour makes one of letters that have no capital of their own


def _numbered(text: Column) -> Column:
    t = F.regexp_replace(_plain(text), _UNIT_AFTER, f" {UNIT} ")
    return F.regexp_replace(t, _NUMBER, f" {NUMBER} ")


def _split(text: Column) -> Column:
    t = F.regexp_replace(_fold(text), rf"[^\p{{L}}\p{{N}}{NUMBER}{UNIT}{NAME}]+", " ")
    return F.filter(F.split(t, " "), lambda w: w != "")


def template_tokens(text: Column, view: str = NAMED) -> Column:
    """Tokens of a text with typed placeholders; null and blank texts have none."""
    if view == EXACT:
        return _split(_plain(text))
    return _split(F.regexp_replace(_numbered(text), _NAME, NAME) if view == NAMED else _numbered(text))


def slot_values(text: Column, view: str = NAMED) -> Column:
    """The values behind the placeholders, in the order of the placeholders; case and what stands between names play no part."""
    found = F.regexp_extract_all(_plain(text), F.lit(_SLOTS[view]), F.lit(0))
    return F.transform(found, lambda v: F.when(v.rlike("^[0-9]"), v).otherwise(F.regexp_replace(_fold(v), r"[^\p{L}\p{N}/]+", " ")))


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, UNIT, NAME)


def _token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _windows(hashes: Column, view: str, width: Column) -> Column:
    """``struct(at, hash)`` of every window of an array of token hashes; windows of other views and widths hash differently."""
    starts = F.sequence(F.lit(1), F.size(hashes) - (width - 1))
    hashed = F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(view), width, F.slice(hashes, i, width)).alias("hash")))
    return F.when((F.size(hashes) >= width) & (width > 0), hashed).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))


def _slots(text: Column, view: str) -> Column:
    """Position and value of each placeholder."""
    at = F.filter(F.transform(template_tokens(text, view), lambda w, i: F.when(_is_slot(w), i + 1)), lambda i: i.isNotNull())
    return F.arrays_zip(at.alias("at"), slot_values(text, view).alias("value"))


def _near(slots: str, at: str, width: Column) -> Column:
    """Values of the slots inside the window at ``at``, in their order."""
    inside = F.filter(slots, lambda s: (s["at"] >= F.col(at)) & (s["at"] < F.col(at) + width))
    return F.transform(inside, lambda s: s["value"])


def _letter_words(text: Column) -> Column:
    """Runs of letters of a whole text in one case, with one form of sigma, which is the one letter whose case looks around."""
    return F.split(F.replace(_fold(text), F.lit("ς"), F.lit("σ")), r"[^\p{L}]+")


def _anchor_key(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def _anchor(tokens: Column) -> Column:
    """``struct(size, key)`` of the words of a window, up to three in a row and as long as can be, that no text with the
    window lacks; null where no token is of letters alone."""
    words = F.transform(tokens, lambda w: F.replace(w, F.lit("ς"), F.lit("σ")))

    def best(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(tokens) - size)
        rows = F.transform(starts, lambda i: F.slice(words, i + 1, size))
        whole = F.filter(rows, lambda g: F.forall(g, lambda w: w.rlike(r"^\p{L}+$")))
        rated = F.array_max(F.transform(whole, lambda g: F.struct(F.length(F.array_join(g, "")).alias("long"), g.alias("words"))))["words"]
        return F.when(F.size(tokens) >= size, F.when(rated.isNotNull(), F.struct(F.lit(size).alias("size"), _anchor_key(rated, F.lit(0), size).alias("key"))))

    return F.coalesce(*[best(size) for size in range(ANCHOR, 0, -1)])


def _candidates(there: DataFrame, owners: DataFrame, text_col: str) -> DataFrame:
    """``text_key, text`` once per text that holds the anchor of a window; texts without one hold no window.

    Only these are tokenised in every view. A window without an anchor, as one of numbers alone, makes every text a candidate.
    """
    key = F.xxhash64(F.col(text_col)).alias("text_key")
    rows = there.select(key, F.col(text_col).alias("text"))
    anchors = owners.select("anchor").distinct()
    sizes = sorted(r["size"] for r in anchors.select("anchor.size").distinct().collect() if r["size"])  # three at most
    if anchors.where("anchor IS NULL").isEmpty():
        each = there.select(key, _letter_words(F.col(text_col)).alias("words")).select("text_key", "words", F.posexplode("words").alias("at", "word"))
        keys = [F.when(F.col("at") + n <= F.size("words"), _anchor_key(F.col("words"), F.col("at"), n)) for n in sizes] or [F.lit(None).cast("long")]
        each = each.select("text_key", (F.explode(F.array(*keys)) if len(keys) > 1 else keys[0]).alias("key"))
        known = anchors.select(F.col("anchor.key").alias("key")).distinct()
        few = known.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
        held = each.join(F.broadcast(known) if few else known, "key", "left_semi").select("text_key")
        # the one mark that becomes a letter by its case may join what a placeholder parts
        marked = there.where(F.contains(F.col(text_col), F.lit("\u0345"))).select(key)
        chosen = stage(held.union(marked).distinct(), "chosen")
        small = chosen.limit(200_001).count() <= 200_000
        rows = rows.join(F.broadcast(chosen) if small else chosen, "text_key", "left_semi")
    return stage(rows.groupBy("text_key").agg(F.min("text").alias("text")), "candidates")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``view, width, hash, item_id, item_at, item_values, anchor, salts, salt`` of every item that has the window.

    An item's windows have 13 tokens, or all its tokens where it has fewer. Items that share a template all stay; ``salt``
    deals out those of one hash.
    """
    text = F.col(text_col)
    items = benchmark.select(F.col(item_col).alias("item_id"), text.alias("text"))

    def rows(view: str, of: DataFrame) -> DataFrame:
        slots = F.array().cast("array<struct<at:int,value:string>>") if view == EXACT else _slots(F.col("text"), view)
        seen = of.select("item_id", "text", slots.alias("slots"), template_tokens(F.col("text"), view).alias("tokens"))
        seen = seen.withColumn("width", F.least(F.lit(WIDTH), F.size("tokens")))
        each = seen.withColumn("w", F.explode(_windows(_token_hashes(F.col("tokens")), view, F.col("width"))))
        inside = F.slice("tokens", F.col("w.at"), F.col("width"))
        words = F.size(F.filter(inside, lambda w: ~_is_slot(w)))
        return each.select(
            "item_id", "text", F.lit(view).alias("view"), "width", "w.hash", F.col("w.at").alias("item_at"),
            _near("slots", "w.at", F.col("width")).alias("item_values"), _anchor(inside).alias("anchor"),
            ((F.col("width") >= SHORTEST) & (words >= LITERALS)).alias("rich"),
        )

    folded = rows(FOLDED, items)
    poor = folded.where("NOT rich").select("item_id", "text").distinct()
    found = rows(NAMED, items).where("rich").union(folded.where("rich")).union(rows(EXACT, poor)).drop("text", "rich").distinct()
    sized = found.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("item_id", "item_at", "item_values"), F.col("salts")).cast("int").alias("salt")
    return stage(found.join(sized, "hash").select("hash", "view", "width", "item_id", "item_at", "item_values", "anchor", "salts", salt), "templates")


def template_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``text_key, item_id, windows, verbatim`` for texts that hold a verbatim window or a consistent run of windows of an item.

    Texts are known by a 64-bit hash, so copies of a text are one case. One plain pass keeps the texts that hold a few words in
    a row of some window, and only these are tokenised. The distinct hashes of the benchmark are broadcast
    when counting shows that they are few, else both sides are shuffled; matching texts are looked at again for their
    values, and a window is held against the values of every item that has its hash.
    """
    owners = benchmark_windows(benchmark, item_col, item_text_col)
    windows = owners.select("hash", "salts").distinct()
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    kinds = sorted((r["view"], r["width"]) for r in owners.select("view", "width").distinct().collect())  # a few numbers
    views = sorted({v for v, _ in kinds})
    held = _candidates(docs.where(F.col(text_col).isNotNull()), owners, text_col)
    hashes = held.select("text_key", *[_token_hashes(template_tokens(F.col("text"), v)).alias(v) for v in views])
    cut = [_windows(F.col(v), v, F.lit(n)) for v, n in kinds] or [F.array().cast("array<struct<at:int,hash:bigint>>")]
    each = hashes.select("text_key", F.explode(F.concat(*cut)).alias("w")).select("text_key", "w.at", "w.hash")
    hits = stage(each.join(F.broadcast(windows) if few else windows, "hash").select("text_key", "at", "hash", "salts").distinct(), "hits")
    wanted = hits.select("text_key").distinct()
    small = wanted.limit(200_001).count() <= 200_000
    texts = held.join(F.broadcast(wanted) if small else wanted, "text_key", "left_semi")
    slots = F.create_map(*[x for v in (NAMED, FOLDED) for x in (F.lit(v), _slots(F.col("text"), v))])
    slotted = texts.select("text_key", slots.alias("by_view"))
    salted = hits.select("text_key", "at", "hash", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    owned = salted.join(owners.drop("salts", "anchor"), ["hash", "salt"]).join(slotted, "text_key")
    owned = owned.withColumn("slots", F.coalesce(F.col("by_view")[F.col("view")], F.array().cast("array<struct<at:int,value:string>>")))
    lined = owned.withColumn("values", _near("slots", "at", F.col("width"))).select(
        "text_key", "item_id", "view", "width", (F.col("at") - F.col("item_at")).alias("shift"), "at", "item_values", "values",
        (F.col("item_values") == F.col("values")).alias("same"),
    )
    alignment = ["text_key", "item_id", "view", "width", "shift"]
    rank = F.dense_rank().over(Window.partitionBy(*alignment).orderBy("at"))  # no more rows than the item has windows
    runs = stage(lined.withColumn("run", F.col("at") - rank), "runs")  # read three times
    counted = runs.groupBy(*alignment, "run").agg(
        F.count_distinct("at").alias("windows"), F.count_distinct(F.when(F.col("same"), F.col("at"))).alias("same"),
    )
    pairs = runs.select(*alignment, "run", F.explode(F.arrays_zip("item_values", "values")).alias("p")).select(
        *alignment, "run", F.col("p.item_values").alias("iv"), F.col("p.values").alias("dv")
    ).groupBy(*alignment, "run", "iv").agg(F.min("dv").alias("low"), F.max("dv").alias("high"))
    single = F.bool_and(F.col("low").eqNullSafe(F.col("high")))
    within = pairs.groupBy(*alignment, "run").agg(single.alias("holds"))
    across = pairs.groupBy(*alignment, "iv").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy(*alignment).agg(single.alias("consistent"))
    yes = F.lit(True)
    judged = counted.join(within, [*alignment, "run"], "left").withColumn("found", F.when(F.coalesce("holds", yes), F.col("windows")).otherwise(F.col("same")))
    aligned = judged.groupBy(*alignment).agg(
        F.sum("found").alias("windows"), (F.sum("same") > 0).alias("some"), (F.sum("same") == F.sum("windows")).alias("all"),
    ).where("windows > 0")
    slip = ~F.coalesce("consistent", yes)  # an edited copy: windows with the item's own values beside others
    seen = aligned.join(across, alignment, "left").groupBy("text_key", "item_id", "view").agg(
        F.sum("windows").alias("windows"), F.bool_or(F.col("all") | (F.col("some") & slip)).alias("verbatim")
    )
    # the named view sees changed names, so its word on them goes first; windows are those of the view that finds most
    return seen.groupBy("text_key", "item_id").agg(
        F.max("windows").alias("windows"), F.coalesce(F.bool_or(F.when(F.col("view") == NAMED, F.col("verbatim"))), F.bool_or("verbatim")).alias("verbatim")
    )


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, leaked, n_items, n_windows, reparameterised`` for every row of ``docs``.

    ``reparameterised`` says that no matching item occurs with its own values; where values map inconsistently over a whole
    alignment, one window with the item's own values is enough to call it an edited copy. A null or empty text
    does not leak; a null id stays in the result; repeated rows are judged alike; items without a
    word match nothing, and an empty benchmark finds nothing. Items that share a template are each compared. An item of a few
    words is found wherever these words stand in a row, so a benchmark should hold no item that is no evidence.
    """
    found = template_matches(docs, benchmark, text_col, item_col, item_text_col).groupBy(F.col("text_key").alias("_leak")).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("windows").alias("n_windows"), (~F.bool_or("verbatim")).alias("reparameterised"),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col))).alias("_key"))
    zero = F.lit(0).cast("long")
    return rows.join(found, F.col("_key") == F.col("_leak"), "left").select(
        "doc_id", F.col("_leak").isNotNull().alias("leaked"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("n_windows", zero).alias("n_windows"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns as they are."""
    found = stage(template_matches(docs, benchmark, text_col).select(F.col("text_key").alias("_leak")).distinct(), "leaks")
    side = F.broadcast(found) if found.limit(200_001).count() <= 200_000 else found
    return docs.join(side, F.xxhash64(docs[text_col]) == side["_leak"], "left_anti")
