"""Hilbert sharding and water-filled mixing against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake.llm import hilbert, mixing
from trustlake.llm.queries import QUERIES, hilbert_dims

from .conftest import SF


@pytest.mark.parametrize("bits,dims", [(1, 2), (3, 2), (3, 3), (2, 4)])
def test_curve_visits_neighbours(bits, dims):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert.curve_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for taken in slots.values():
        assert sorted(taken) == list(range(len(taken)))


def test_shards_of_equal_bytes(spark, docs):
    rows = QUERIES["op1_hilbert_shards"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    check_slots(rows)
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(16))
    largest = max(r["size"] for r in rows)
    assert max(abs(s - sum(sizes.values()) / 16) for s in sizes.values()) <= largest
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in order] == sorted(r["curve_index"] for r in rows)
    again = QUERIES["op1_hilbert_shards"](spark, SF).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_shards_of_equal_counts_and_odd_rows(spark, odd, empty, tmp_path):
    placed = hilbert.hilbert_shards(odd, hilbert_dims(), shards=4, law="rows")
    rows = placed.collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == odd.count() and max(counts.values()) - min(counts.values()) <= 1
    check_slots(rows)
    assert hilbert.hilbert_shards(empty, hilbert_dims()).count() == 0
    manifest = hilbert.shard_manifest(placed, ["lang"]).collect()
    assert sum(m["rows"] for m in manifest) == len(rows)
    hilbert.write_shards(odd.drop("shard").where("doc_id in (2, 4, 6)"), placed.where("doc_id in (2, 4, 6)"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_one_cell_holds_all_rows(spark):
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.lit("s").alias("source"))
    rows = hilbert.hilbert_shards(same, {"source": F.col("source")}, shards=8).collect()
    assert set(Counter(r["shard"] for r in rows).values()) == {375}
    check_slots(rows)


def plain_targets(sizes, weights, share, epochs):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, budget, out = set(order), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level >= epochs * sizes[s]]
        if not over:
            out |= {s: weight[s] * level for s in left}
            break
        for s in over:
            out[s] = epochs * sizes[s]
            budget -= out[s]
            left.discard(s)
    return out


@pytest.mark.parametrize("share", [0.2, 1.5, 1.9, 5.0])
def test_mix_meets_targets(spark, docs, share):
    rows = mixing.mix_sources(docs, share=share).collect()
    source = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s, n = source[r["doc_id"]]
        assert r["size"] == n and r["source"] == s and r["taken"] == n * r["repeats"] <= 2 * n
        sizes[s] += n
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = plain_targets(sizes, (3.0, 1.0, 2.0), share, 2.0)
    longest = max(n for _, n in source.values())
    for s in sizes:
        assert abs(want[s] - target[s]) <= 1e-6 * max(1.0, want[s])
        assert abs(taken[s] - target[s]) <= longest
    again = mixing.mix_sources(docs.repartition(5), share=share).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in rows}


def test_mix_of_odd_rows(spark, odd, empty):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.repeat_rows(odd, mixing.mix_sources(odd))
    assert mixed.columns == odd.columns and mixed.count() > 0


def test_large_source_is_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 50)
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix_sources(rows, share=0.35).collect()
    assert abs(sum(r["taken"] for r in got) - 2100) <= 3
