"""Token blocks: exact round trip. Chat snapshots: brute force over whole prefixes."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trustlake.llm import eliasfano, snapshots
from trustlake.llm.queries import QUERIES

from .conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=1500))
def test_elias_fano_round_trip(values):
    values = np.array(sorted(values), dtype=np.int64)
    top = int(values[-1]) if len(values) else 0
    read = eliasfano.EliasFano(*eliasfano.encode(values, top), len(values), top)
    assert (read.all() == values).all()
    for i in range(0, len(values), 97):
        assert read.select(i) == values[i]
    with pytest.raises(IndexError):
        read.select(len(values))


def test_boundaries_need_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(100, 2000, 10_000))
    low, high, samples = eliasfano.encode(ends, int(ends[-1]))
    assert 8 * (len(low) + len(high) + len(samples)) / len(ends) < 2.5 + np.log2(ends[-1] / len(ends)) + 0.2 < 16


def expected(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_round_trip(spark, docs):
    want = expected(sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    got = QUERIES["op6_elias_fano_tokens"](spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


@pytest.mark.parametrize("wide", [False, True])
def test_odd_texts_and_small_blocks(spark, odd, empty, tmp_path, wide):
    extra = spark.createDataFrame([
        (20, "I'll DON'T <|endoftext|>x <|endoftext|> a\x1cb\x85c\xa0d"), (21, "ÀÉ ﬁ İstanbul ΣΑΣ. Straße é"), (22, "x" * 3000 + ",. A.B, .")],
        "doc_id long, text string")
    rows = odd.select("doc_id", "text").union(extra)
    folder = str(tmp_path / "blocks")
    eliasfano.write_token_blocks(rows, folder, PATH, wide=wide, block_ids=20)
    got = [tuple(r) for r in eliasfano.read_token_blocks(spark, folder).collect()]
    first = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    want = expected(sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=first))
    assert sorted(got, key=lambda r: r[1]) == want
    eliasfano.write_token_blocks(empty, str(tmp_path / "none"), PATH)
    assert eliasfano.read_token_blocks(spark, str(tmp_path / "none")).count() == 0


def test_select_reaches_one_document(spark, docs, tmp_path):
    eliasfano.write_token_blocks(docs, str(tmp_path / "b"), PATH)
    block = spark.read.parquet(str(tmp_path / "b")).orderBy("block").first()
    ends = eliasfano.EliasFano(block["ends_low"], block["ends_high"], block["ends_samples"], block["docs"], block["ends_top"])
    text = docs.where("doc_id = 5").first()["text"]
    ids = np.frombuffer(block["ids"], dtype="<u2")[ends.select(4):ends.select(5)]
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1]


def plain_collapse(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, {}).setdefault(turn, set()).add((role, text))
    shape = {c: tuple((t, frozenset(v)) for t, v in sorted(x.items(), key=lambda i: (i[0] is not None, i[0]))) for c, x in convs.items()}
    beginnings = {s[:k] for s in shape.values() for k in range(1, len(s))}
    kept = {}
    for c, s in shape.items():
        if s not in beginnings and (s not in kept or (c is not None and (kept[s] is None or c < kept[s]))):
            kept[s] = c
    return sorted(kept.values(), key=str)


def test_snapshots_of_growing_chats(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "PIECE", 4)
    rng = random.Random(2)
    rows, c = [], 0
    for seed in range(12):
        turns = [(k, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", None, ""]) if k else f"start {seed % 3}") for k in range(10)]
        for length in rng.sample(range(1, 11), 5) + [10, 10]:
            rows += [(c, *t) for t in turns[:length]]
            c += 1
    rows += rows[:7] + [(None, 0, "user", "x"), (None, None, None, None), (500, 0, "user", "x"), (500, 0, "user", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = snapshots.collapse_snapshots(df)
    assert sorted({r["conv_id"] for r in got.collect()}, key=str) == plain_collapse(rows)
    assert snapshots.collapse_snapshots(df.where("false")).count() == 0
    assert got.where("conv_id = 500").count() == 2
    text = {r["conv_id"]: r["text"] for r in snapshots.whole_texts(got).collect()}[500]
    assert text == "<|im_start|>user\nx<|im_end|>\n<|im_start|>user\ny<|im_end|>\n"


def test_very_common_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(600) for t in range(3 if c % 2 else 2)]
    got = snapshots.collapse_snapshots(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["copies"]) for r in got} == {(1, 300)} and len(got) == 3


def test_latin_words_get_the_ids_of_the_whole_tokenizer():
    """Every letter below U+0250 and its neighbours, alone, inside words, in capitals and before marks."""
    words = [f"{a}{chr(i)}{b}" for i in range(33, 0x260) for a, b in (("", ""), ("a", "e"), ("X", "."), ("", ","), ("\u00c7\u0130", "\u0308"))]
    texts = [" ".join(words), " ".join(reversed(words)), "e\u0301t\u00e9 \u00c9T\u00c9. na\u00efve, \u023a\u023e \u01c4x ` a\u0300 \u1e9e \u0394\u03a3"]
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = False
    got = eliasfano.Words(PATH, "<u4").encode(texts, 1)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]
