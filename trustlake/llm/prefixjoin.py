"""Exact n-gram Jaccard join by prefixes of grouped documents, and its connected components.

Two sets with Jaccard similarity t or more share an element among the first ``n - ceil(t n) + 1`` of each, in any common
order of the elements. The order here puts frequent shingles last, so prefixes hold what few documents share.

1. Counting: shingles of all texts are counted in hashed cells (a table of fixed size, summed over all rows).
2. Texts of one set collapse, and texts of one prefix and size collapse into a group.
3. Groups meet in the shingles of their prefixes. In a bucket of few texts they are listed as pairs, which are counted and
   filtered: similar sets share so many shingles of their prefixes, the first of them so early. A bucket of many texts is a
   star, its smallest group against each other one. Of all candidates, a spanning part is expanded and verified first, and
   every group's first text against its other texts; verified links are contracted to components.
4. Candidates between different components are verified then. Buckets of many texts that still hold several components
   are expanded to their texts and compared block against block inside tasks; only links that join components leave a task.
   So no list of all pairs of a large bucket ever exists, and no pair is skipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import arrow_batches, small_batches, stage
from trustlake.operators.duplicates import connected_components
from trustlake.session import sized_broadcast

#: Cells of the frequency table; four bytes each in every task, whatever the size of the input.
CELLS = 1 << 23
SHIFT = np.uint64(64 - 23)
CHUNK = 1 << 13
#: Texts in a bucket up to which its groups are listed as pairs: at most half as many pairs as that for a posting.
LISTED = 64
#: Rows above four times the mean from which a cell counts as full.
FULL = 10_000
#: Texts of one side of a block pair.
BLOCK = 512
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE, BASE_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, size: int) -> None:
        while len(self.up) < size:
            step = np.uint64(pow(BASE, len(self.up), 1 << 64))
            back = np.uint64(pow(BASE_INVERSE, len(self.down), 1 << 64))
            self.up = np.concatenate([self.up, self.up * step])
            self.down = np.concatenate([self.down, self.down * back])


def word_hashes(raw: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of every word of UTF-8 bytes, A-Z lowered: differences of one running polynomial sum."""
    solid = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    powers.reach(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers.up[: len(raw)])])
        return mix((total[end] - total[start]) * powers.down[start] + (end - start).astype(np.uint64) * GOLD)


def shingles(text: str | None, powers: Powers, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a text of fewer words is one shingle, without words none."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    hashes = word_hashes(raw, powers) if len(raw) else np.zeros(0, dtype=np.uint64)
    if not len(hashes):
        return hashes
    with np.errstate(over="ignore"):
        count, width = max(1, len(hashes) - words + 1), min(words, len(hashes))
        out = np.full(count, np.uint64(width))
        for k in range(width):
            out = mix(out * GOLD + hashes[k:k + count])
    return np.unique(out)


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (-(-percent * n // 100)) + 1


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def cell_counts(docs: DataFrame, words: int, text_col: str) -> np.ndarray:
    """How often the shingles of each cell occur over all texts, summed chunk by chunk in parallel."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held = Powers(), np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            sets = [shingles(t, powers, words) for t in batch["text"]]
            cells, times = np.unique(np.concatenate(sets) >> SHIFT, return_counts=True)
            held[cells.astype(np.int64)] += times.astype(np.uint32)
        pieces = held.reshape(-1, CHUNK)
        used = np.flatnonzero(pieces.any(axis=1))
        yield pd.DataFrame({"chunk": used.astype(np.int32), "counts": [zlib.compress(pieces[i].tobytes(), 1) for i in used]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"], batch["counts"]):
                held[chunk] = held.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), dtype=np.uint32).astype(np.int64)
        sums = [np.minimum(v, (1 << 32) - 1).astype(np.uint32).tobytes() for v in held.values()]
        yield pd.DataFrame({"chunk": np.array(list(held), dtype=np.int32), "counts": sums})

    kind = "chunk int, counts binary"
    table = np.zeros((CELLS // CHUNK, CHUNK), dtype=np.uint32)
    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(count, kind)
    for row in parts.repartition("chunk").mapInPandas(add, kind).collect():  # CELLS numbers, whatever the input
        table[row["chunk"]] = np.frombuffer(row["counts"], dtype=np.uint32)
    return table.reshape(-1)


def prefixes(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, s1, s2, g, prefix, calm``: size and 128-bit name of each text's set, its group and the group's prefix.

    ``g`` names size and prefix. The prefix array comes once per group and task, else it is null; its first ``calm``
    shingles lie in ordinary cells, the others in cells so full that many documents must hold them.
    """
    table = cell_counts(docs, words, text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(table)  # 32 MB
    full = FULL + 4 * int(table.mean())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, told = Powers(), set()
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = shingles(text, powers, words)
                if not len(found):
                    out.append((0, 0, 0, 0, None, 0))
                    continue
                rank = ranks.value[(found >> SHIFT).astype(np.int64)]
                order = np.lexsort((found, rank))[: prefix_length(len(found), percent)]
                first = found[order]
                with np.errstate(over="ignore"):
                    s1, s2 = np.add.reduce(mix(found + GOLD)), np.add.reduce(mix(found ^ MIX2))
                    g = np.add.reduce(mix(first * GOLD), keepdims=True) + np.uint64(len(found)) * MIX1
                g = int(_signed(mix(g))[0])
                new = g not in told
                told.add(g)
                names = (int(_signed(s.reshape(1))[0]) for s in (s1, s2))
                out.append((len(found), *names, g, _signed(first) if new else None, int((rank[order] < full).sum())))
            frame = pd.DataFrame(out, columns=["n", "s1", "s2", "g", "prefix", "calm"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, n long, s1 long, s2 long, g long, prefix array<bigint>, calm int")


#: Stands for a null id while rows are joined; the largest number, so that any real id goes before it.
NO_ID = (1 << 63) - 1


def shared_postings(rows: DataFrame) -> DataFrame:
    """``token, g, n, at`` of the prefix shingles that occur in more than one group.

    One shuffle brings the rows of an ordinary shingle together in order; they stream through the task, which passes on the
    runs of more than one group. Shingles of full cells need no such test and are only made distinct.
    """
    each = rows.where("prefix IS NOT NULL").select("g", "n", "calm", F.posexplode("prefix").alias("at", "token"))

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, several = None, False  # the last row, and whether its run has been passed on so far
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            token, g = batch["token"].to_numpy(), batch["g"].to_numpy()
            begins = token[1:] != token[:-1]
            fresh = np.concatenate([[True], begins | (g[1:] != g[:-1])])  # a group's rows may repeat, once per task
            run = np.concatenate([[0], np.cumsum(begins)])
            many = np.bincount(run, weights=fresh) > 1
            many[0] |= several
            passed = many[run] & fresh
            passed[0] &= not several
            yield batch[passed]
            held, several = batch.iloc[[-1]], bool(many[-1])

    columns = ["token", "g", "n", "at"]
    ordinary = each.where("at < calm").select(*columns).repartition("token").sortWithinPartitions("token", "g")
    found = ordinary.mapInPandas(shared, "token long, g long, n long, at int")
    return found.unionByName(each.where("at >= calm").groupBy("token", "g").agg(F.max("n").alias("n"), F.max("at").alias("at")))


def _prefix(n: Column, percent: int) -> Column:
    return n - F.ceil(F.lit(percent) * n / 100) + 1


def listed_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Group pairs ``ga < gb`` of small buckets (``token, g, n, at``) that may reach the similarity.

    If two sets share c shingles of their prefixes, they share no more than c and what lies behind the longer rest; and no
    more than what lies behind the first shared one. Pairs whose prefixes also share a shingle of a large bucket are counted
    short here, but they are compared there.
    """
    left = postings.select("token", F.col("g").alias("ga"), F.col("n").alias("na"), F.col("at").alias("ia"))
    right = postings.select("token", F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    close = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("ga") < F.col("gb"))
    pairs = left.join(right, "token").where(close).groupBy("ga", "gb").agg(
        F.count(F.lit(1)).alias("c"), F.min("ia").alias("ia"), F.min("ib").alias("ib"), F.max("na").alias("na"), F.max("nb").alias("nb"),
    )
    na, nb = F.col("na"), F.col("nb")
    rest = F.col("c") + F.greatest(na - _prefix(na, percent), nb - _prefix(nb, percent))
    behind = F.least(na - F.col("ia"), nb - F.col("ib"))
    needed = F.lit(percent) * (na + nb)
    return pairs.where(((100 + percent) * rest >= needed) & ((100 + percent) * behind >= needed)).select("ga", "gb")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of texts whose whole sets reach the similarity."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("_x"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("_y"))
    common = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(left, "a").join(right, "b").where(
        100 * common >= percent * (F.size("_x") + F.size("_y") - common)
    ).select("a", "b")


def block_links(rep: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int, columns: int = 8192) -> list[tuple[int, int]]:
    """Links between texts of different components, as many as join the components; sides 0 and 1, or one side alone.

    Common elements are counted by products of incidence matrices, a slice of the vocabulary at a time.
    """
    if len(set(comp.tolist())) < 2:
        return []
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    vocabulary, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = np.flatnonzero(times > 1)
    rank = np.full(len(vocabulary), -1)
    rank[useful] = np.arange(len(useful))
    place = rank[place]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, len(useful), columns):
        i, j = np.searchsorted(place, [low, low + columns])
        cut = np.zeros((len(sets), min(columns, len(useful) - low)), dtype=np.float32)
        cut[owner[i:j], place[i:j] - low] = 1
        common += cut[left] @ cut[right].T
    common = common.astype(np.int64)
    near = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
    near &= comp[left][:, None] != comp[right][None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(near)):
        a, b = root(int(comp[left[i]])), root(int(comp[right[j]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(rep[left[i]]), int(rep[right[j]])))
    return links


def _open_links(postings: DataFrame, texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` found in large buckets, and in groups, that hold several components. ``texts``: ``g, rep, n, comp``."""
    groups = texts.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    buckets = postings.join(groups, "g").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    in_tokens = postings.select("token", "g").join(buckets.where("low <> high").select("token"), "token").select(F.lit(0).alias("kind"), "token", "g")
    in_groups = groups.where("low <> high").select(F.lit(1).alias("kind"), F.col("g").alias("token"), "g")
    members = stage(in_tokens.union(in_groups).join(texts, "g").select("kind", "token", "rep", "n", "comp"), "open")
    bucket = ["kind", "token"]
    blocks = members.groupBy(*bucket).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / (BLOCK * 1000))).cast("int").alias("_blocks")
    )
    placed = members.join(blocks, bucket).withColumn("_b", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    dealt = placed.select(*bucket, "rep", "comp", "_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o"))
    dealt = dealt.select(*bucket, "rep", "comp", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("_b") > F.col("_o")).cast("int").alias("side"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = block_links(
            frame["rep"].to_numpy(), frame["comp"].to_numpy(), frame["side"].to_numpy(), [np.asarray(h) for h in frame["hashes"]], percent
        )
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.join(sets.select("rep", "hashes"), "rep").groupBy(*bucket, "i", "j").applyInPandas(compare, "a long, b long")


def similar_documents(
    docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents whose shingle sets have Jaccard similarity ``percent``/100 or more are linked.

    A-Z is lowered; words end at ASCII white space. A text of fewer than ``words`` words is one shingle. Texts that are
    null, empty or without words have size 0, link with nothing and stand alone. Equal texts are linked. A null id takes no
    part in numbering: it has the component of an equal text with an id, and none (null) otherwise. Rows of one id are one
    document, linked by each of its texts. Shingles are 64-bit hashes. An empty table gives no row, other columns play no
    part. Very long texts are read whole.
    """
    small_batches(docs.sparkSession)
    rows = stage(prefixes(docs, percent, words, id_col, text_col), "prefixes")
    name = ["n", "s1", "s2"]
    texts = stage(rows.where("n > 0").groupBy(*name).agg(F.min("doc_id").alias("rep"), F.min("g").alias("g")), "texts")
    with arrow_batches(docs.sparkSession, 1 << 16):  # rows of fixed width
        postings = stage(shared_postings(rows), "postings")
    heads = texts.groupBy("g").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("held"))
    sized = postings.join(heads.select("g", "held"), "g")
    full = sized.groupBy("token").agg(F.sum("held").alias("_texts")).where(F.col("_texts") > LISTED).select("token")
    full = stage(full, "full")
    crowded = stage(postings.join(full, "token", "left_semi"), "crowded")
    listed = stage(listed_pairs(postings.join(full, "token", "left_anti"), percent), "listed")
    active = heads.where("held > 1").select("g").union(crowded.select("g")).union(listed.select("ga")).union(listed.select("gb")).distinct()
    wanted = stage(texts.join(active, "g", "left_semi"), "wanted").where(F.col("rep") != NO_ID)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            found = [shingles(t, powers, words) for t in batch["text"]]
            with np.errstate(over="ignore"):
                s1 = [int(_signed(np.add.reduce(mix(f + GOLD), keepdims=True))[0]) for f in found]
            yield pd.DataFrame({"rep": batch["rep"].to_numpy(), "n": [len(f) for f in found], "s1": s1, "hashes": [_signed(f) for f in found]})

    chosen = wanted.select("rep").distinct()
    few = chosen.limit(200_001).count() <= 200_000
    sources = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen) if few else chosen, "rep", "left_semi"
    )
    sets = sources.mapInPandas(whole, "rep long, n long, s1 long, hashes array<bigint>")
    sets = stage(sets.join(wanted.select("rep", "n", "s1"), ["rep", "n", "s1"], "left_semi").dropDuplicates(["rep", "n", "s1"]), "sets")

    centre = crowded.groupBy("token").agg(F.min("g").alias("ga"))
    stars = crowded.join(centre, "token").where("g <> ga").select("ga", F.col("g").alias("gb")).union(
        listed.groupBy("gb").agg(F.min("ga").alias("ga")).select("ga", "gb")
    ).distinct()
    first = wanted.groupBy("g").agg(F.min("rep").alias("head"))
    across = stars.join(first.select(F.col("g").alias("ga"), F.col("head").alias("a")), "ga").join(
        first.select(F.col("g").alias("gb"), F.col("head").alias("b")), "gb"
    ).select("a", "b")
    inside = wanted.join(first, "g").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    links = stage(verified(across.union(inside).where("a <> b").distinct(), sets, percent), "stars")
    rough = stage(connected_components(links), "rough")
    placed = stage(wanted.join(rough, F.col("rep") == F.col("node"), "left").select("g", "rep", "n", F.coalesce("component", "rep").alias("comp")), "placed")
    left = placed.select(F.col("g").alias("ga"), F.col("rep").alias("a"), F.col("comp").alias("ca"))
    right = placed.select(F.col("g").alias("gb"), F.col("rep").alias("b"), F.col("comp").alias("cb"))
    between = listed.join(left, "ga").join(right, "gb").where("ca <> cb").select("a", "b")
    more = stage(verified(between, sets, percent).union(_open_links(crowded, placed, sets, percent)), "links")
    final = stage(connected_components(links.union(more)), "components")
    settled = texts.join(final, F.col("rep") == F.col("node"), "left").select(
        *name, F.when(F.col("rep") != NO_ID, F.coalesce("component", "rep")).alias("component_id")
    )
    alone = F.when((F.col("n") == 0) & (F.col("doc_id") != NO_ID), F.col("doc_id"))
    return rows.select("doc_id", *name).join(settled, name, "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", alone).alias("component_id"),
    )


def keep_first(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, that of the smallest id, with all its columns; rows without id or words all stay.

    Of several rows of one id a single one stays.
    """
    found = similar_documents(docs, percent, words, id_col, text_col)
    gone = stage(found.where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    twice = stage(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_twice")).count().where("count > 1").select("_twice"), "twice")
    kept = docs.join(sized_broadcast(gone), docs[id_col] == gone["_gone"], "left_anti")
    if twice.isEmpty():
        return kept
    again = kept[id_col] == twice["_twice"]
    return kept.join(twice, again, "left_anti").union(kept.join(twice, again, "left_semi").dropDuplicates([id_col]))
