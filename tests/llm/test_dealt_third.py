"""Repeated byte strings, conversation repair and tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trustlake.llm import alignment, repair, suffixes


def plain(value):
    return None if value is None or value != value else value


# --- repeated byte strings


def brute_repeats(texts, length=200):
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found_repeats(docs):
    out = suffixes.remove_repeats(docs).collect()
    for r in out:
        if r.kept is not None:
            assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)


def test_suffix_array_and_open_ranks_agree_with_sorting():
    rng = random.Random(5)
    for _ in range(40):
        letters = rng.choice([b"ab", b"abcd", bytes(range(256))])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(3)]
        pieces = list(dict.fromkeys(b"".join(rng.choice(base)[rng.randint(0, 9):] for _ in range(3)) or b"x" for _ in range(rng.randint(1, 8))))
        text = [b + 2 for b in pieces[0]] + [0]
        assert suffixes.suffix_array(np.array(text, dtype=np.int16)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        length = rng.choice([2, 7, 20])
        count = Counter(p[i:i + length] for p in pieces for i in range(len(p) - length + 1))
        want = {(k, i) for k, p in enumerate(pieces) for i in range(len(p) - length + 1) if count[p[i:i + length]] > 1}
        assert {(k, i) for k, a, b in suffixes.repeated_windows(pieces, length) for i in range(a, b)} == want


@pytest.mark.parametrize("kinds", [2048, 4])
def test_repeats_agree_with_brute_force(spark, monkeypatch, kinds):
    """One passage with other text around it in most rows, periodic texts, copies; also where a minimizer counts as crowded early."""
    monkeypatch.setattr(suffixes, "KINDS", kinds)
    monkeypatch.setattr(suffixes, "POOL", 4000)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = some(400)
    texts = [some(rng.randint(0, 300)) + passage[rng.randint(0, 100):rng.randint(300, 400)] + some(rng.randint(0, 300)) for _ in range(80)]
    texts += ["a" * 900, "a" * 250, "a" * 199, "", "é" * 150, "é" * 150 + "x", "xy" * 400, texts[0], texts[0], texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_repeats(docs) == sorted(brute_repeats([t.encode() for t in texts]))


def test_repeats_on_odd_rows_and_given_documents(spark, odd, empty, docs):
    texts = [(r.text or "").encode() for r in odd.collect()]
    short = [t for t in texts if len(t) < 100_000]
    got = found_repeats(odd)
    assert len(got) == len(texts) and set(sorted(brute_repeats(short))) <= set(got)
    long = next(t for t in texts if len(t) >= 100_000)  # periodic: every window is repeated
    assert (len(long), len(long), 1, hashlib.sha256(b"").hexdigest()) in got
    assert suffixes.remove_repeats(empty).count() == 0
    some = docs.where("doc_id < 150")
    assert found_repeats(some) == sorted(brute_repeats([(r.text or "").encode() for r in some.collect()]))


def test_very_long_texts_are_cut_in_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = some(900)
    texts = [some(1500) + passage + some(333), some(90) + passage[:850] + some(2000), some(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_repeats(docs) == sorted(brute_repeats([t.encode() for t in texts]))


# --- conversations


def brute_damage(rows):
    out = {}
    for (conv, turn, role, text), times in Counter(rows).items():
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        key = (turn is not None, turn or 0, role, text)
        if fate == 0:
            continue
        new = "user" if fate == 4 else role, "" if fate == 1 else text.translate({ord(c): None for c in ".!?"}) if fate == 2 else text
        out[conv] += [(key, turn, *new)] * (times * (2 if fate == 3 else 1))
    return {c: [r[1:] for r in sorted(rows, key=lambda r: r[0])] for c, rows in out.items()}


def brute_repair(rows):
    """Left to right over (rows read, state), cheapest first: another way than the interval parse."""
    seen, kinds, count = set(), [], Counter()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            count[fault] += 1
    steps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {(0, 0): (0, "", ())}
    for k in range(len(rows) + 1):
        for _ in range(4):  # insertions
            for state in range(4):
                if (k, state) in best:
                    cost, audit, made = best[k, state]
                    for c, name in (("u", "user"), ("a", "assistant")):
                        if state in steps[c]:
                            new = (cost + 2, audit + "I", (*made, f"{name}:"))
                            key = (k, steps[c][state])
                            best[key] = min(best.get(key, (1 << 30, "", ())), new)
        if k == len(rows):
            break
        _, role, text = rows[k]
        for state in range(4):
            if (k, state) not in best:
                continue
            cost, audit, made = best[k, state]
            options = [(cost + 3, audit + "D", made, state)]
            if kinds[k] in (None, "truncated"):
                more = kinds[k] == "truncated"
                if state in steps.get(role[:1], {}):
                    options.append((cost + more, audit + "K", (*made, f"{role}:{text}"), steps[role[:1]][state]))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if state in steps[c]:
                        options.append((cost + 2 + more, audit + "R", (*made, f"{name}:{text}"), steps[c][state]))
            for c, a, m, s in options:
                best[k + 1, s] = min(best.get((k + 1, s), (1 << 30, "", ())), (c, a, m))
    cost, audit, made = min(best[len(rows), s] for s in (0, 3) if (len(rows), s) in best)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
        hashlib.sha256("\n".join(made).encode()).hexdigest(),
    )


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def held_against_brute_force(frame):
    rows = [(plain(r.conv_id), plain(r.turn), r.role, r.text) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    want = {c: brute_repair(r) for c, r in brute_damage(rows).items()}
    got = {plain(r.conv_id): tuple(r[f] for f in FIELDS) for r in repair.repair_conversations(frame).collect()}
    assert got == want


def test_repair_agrees_with_brute_force(spark):
    held_against_brute_force(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def test_repair_of_odd_and_of_one_huge_conversation(spark):
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "", " \n", None, "What? ", "Fine!\n"]
    rows = [(1, k, rng.choice(roles[:3]), f"line {k}" + rng.choice([".", "", "?"])) for k in range(900)]
    rows += [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(2, 60)] for _ in range(rng.randint(1, 7))]
    rows += [(70, 3, "user", "Same.")] * 5
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit("x")).withColumn("part", F.lit(1))
    held_against_brute_force(frame.repartition(3))
    assert repair.repair_conversations(frame.where("false")).count() == 0


def test_spans_combine_to_the_same_cell_in_any_division():
    kinds = "uAxaosUaasu"
    cell = repair.parse(kinds)
    for k in range(1, len(kinds)):
        assert repair.join_cells(repair.parse(kinds[:k]), repair.parse(kinds[k:])) == cell


# --- tokenizers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    chars, docs = alignment._byte_of_char(), []
    for text in texts:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        raw_a = [bytes(chars[c] for c in first.id_to_token(x)) for x in a]
        raw_b = [bytes([int(p[3:5], 16)]) if second.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, second.id_to_piece(x)) for x in b)]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
        begins_a, begins_b = [0, *ends_a], [0, *ends_b]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if begins_a[i] < ends_b[j] and begins_b[j] < ends_a[i]]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        docs.append((a, b, links, groups))
    held = Counter(p for d in docs for p in set(d[2]))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (len(a), len(b), len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, links, g in docs
    ]


def aligned(frame):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((plain(r.doc_id), *(r[c] for c in columns)) for r in alignment.align_tokenizers(frame, A, B).where("doc_id IS NOT NULL").collect())


@pytest.mark.parametrize("lane, chunk", [(256, 16 << 20), (3, 2000)])
def test_alignment_agrees_with_brute_force(spark, monkeypatch, lane, chunk):
    monkeypatch.setattr(alignment, "LANE", lane)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    texts = [
        "Hello world, this is a test.", None, "", "a  b", "  lead", "a▁b c", "漢字 é x <|endoftext|> <s>", "tab\tx\n y ", "alpha beta gamma " * 60 + "end", " ",
        "Hello world, this is a test.", "nul \x00 x", "wide　space here", "line\nline two\n", "́ combining é", "🙂 ok 🙂",
    ]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 2000").limit(60).collect()]
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, chunk int")
    assert aligned(frame) == [(k, *r) for k, r in enumerate(brute_alignment(texts))]


def test_alignment_of_odd_rows(odd, empty):
    out = alignment.align_tokenizers(odd, A, B)
    assert out.count() == odd.count() and out.where("doc_id IS NULL").count() == 2
    assert alignment.align_tokenizers(empty, A, B).count() == 0
    long = out.where("doc_id = 6").first()
    assert long.n_links >= max(long.n_a, long.n_b) > 100_000


def test_a_file_with_merges_out_of_order_is_refused(tmp_path):
    import json

    told = json.loads(open(A, encoding="utf-8").read())
    told["model"]["merges"] = told["model"]["merges"][::-1]
    (tmp_path / "a.json").write_text(json.dumps(told))
    with pytest.raises(ValueError):
        alignment.byte_level_bpe(str(tmp_path / "a.json"))
