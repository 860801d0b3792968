"""Toxicity, secrets and language: trained here, so held-out accuracy and plain recomputation."""

import hashlib
import random
import re
import string

import numpy as np

from trustlake.llm import hyperlang, markov, ordinal
from trustlake.llm.queries import QUERIES

from .conftest import SF

LARGE = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal.fit_severity(ordinal.training_rows(docs, labels.where("doc_id % 3 <> 0")))
    assert list(model.thresholds) == sorted(model.thresholds)
    test = ordinal.grade_documents(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    toxic = [r for r in test if r["toxic"] == 1]
    clean = [r for r in test if r["toxic"] == 0]
    assert np.mean([r["rejected"] for r in toxic]) > 0.9
    assert np.mean([r["rejected"] for r in clean]) < 0.01
    assert {r["grade"] for r in test} == {0, 1, 2} and all(0 <= r["severity"] <= 2 for r in test)
    kept = ordinal.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == ordinal.grade_documents(docs, model).where("NOT rejected").count()


def test_true_grades_are_ordered(spark):
    rng = random.Random(1)
    def text(g):
        return " ".join(rng.choices(["plain", "word", "here", "there"], k=30) + ["vile"] * (2 * g))
    rows = [(text(g), g) for g in [0, 1, 2, 3] * 60]
    model = ordinal.fit_severity(spark.createDataFrame(rows, "text string, grade int"), grades=4, severe_hits=None)
    expected = model.probabilities([text(g) for g in range(4)]).sum(axis=1)
    assert list(expected) == sorted(expected) and expected[0] < 0.5 and expected[3] > 2


def test_toxicity_of_odd_rows(spark, odd, empty):
    nothing = ordinal.fit_severity(ordinal.training_rows(odd, spark.createDataFrame([], "doc_id long, toxic int")))
    assert not any(r["rejected"] for r in ordinal.grade_documents(odd, nothing).collect())
    labels = spark.createDataFrame([(1, 1), (None, 1), (6, None), (6, 0), (1, 0)], "doc_id long, toxic int")
    assert ordinal.grade_documents(odd, ordinal.fit_severity(ordinal.training_rows(odd, labels))).count() == odd.count()
    assert ordinal.grade_documents(empty, nothing).count() == 0
    assert ordinal.drop_toxic(empty, nothing).count() == 0


def plain_base(text):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
        ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0),
    ]
    found = [(m.start(), i, m.end()) for i, (_, p, least, g) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least]
    return [(kinds[i][0], s, e) for s, i, e in sorted(found)]


def test_secret_base_spans(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = QUERIES["op5_markov_secrets"](spark, SF).collect()
    assert len(rows) == len(texts) and sum(r["n_assign"] for r in rows) > 5
    for r in rows:
        base = plain_base(texts[r["doc_id"]] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for k, _, _ in base) for n in ("assign", "access", "hex")]
        words = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(words).encode()).hexdigest()
        assert set(words) <= set(r["spans"].split(",")) | {""}


def test_planted_spans(spark):
    text = 'é PASSWORD = "hunter22" token:abc api_key=\'xy_9.z=\' AKIA' + "A1" * 8 + " " + "0f" * 12 + " " + "0f" * 11 + " ſecret=abcdefg"
    assert markov.joined(markov.base_spans(text)) == ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(text))
    assert len(markov.base_spans(text)) == 4


def test_markov_finds_random_keys(spark, docs):
    model = markov.fit_markov(markov.labelled_strings(docs))
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits
    keys = ["".join(rng.choices(letters, k=32)) for _ in range(200)]
    assert np.mean([len(model.spans(f"put {k} here", [])) == 1 for k in keys]) > 0.95
    found = [s for r in docs.collect() for s in model.spans(r["text"], markov.base_spans(r["text"]))]
    assert len(found) < 5


def test_secrets_of_odd_rows(spark, odd, empty):
    model = markov.fit_markov(markov.labelled_strings(empty))
    rows = markov.scan_secrets(odd, model).collect()
    assert len(rows) == odd.count() and all(r["spans"] == "" for r in rows)
    assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert markov.scan_secrets(empty, model).count() == 0
    strings = spark.createDataFrame([("abc", False), (None, True), ("é", True), ("", False), ("x1", None)], "string string, secret boolean")
    assert markov.transition_counts(strings).where("secret").count() == 0


def test_language_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGE}/documents.parquet").collect()}
    rows = QUERIES["op9_hyperdimensional_language"](spark, LARGE).where("held_out").collect()
    assert len(rows) > 2000 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bundle_is_the_sum_of_bound_trigrams():
    space = hyperlang.Space(3, 64)
    vectors, has = space.bundle(["Ab, b", None, "12 !"])
    want = np.zeros(64)
    text = " ab b "
    for i in range(len(text) - 2):
        a, b, c = (space.letter(ord(x)) for x in text[i:i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.allclose(vectors[0], want / np.linalg.norm(want), atol=1e-5)
    assert has.tolist() == [True, False, False] and not vectors[1:].any()


def test_a_text_scores_alike_alone_and_beside_other_scripts():
    cyrillic, arabic = "быстрая лиса прыгает через ленивую собаку", "الثعلب البني السريع يقفز فوق الكلب"
    large = ["".join(chr(c) for c in range(start, start + 3000)) for start in (0x4E00, 0x5E00, 0xAC00)]
    alone = [hyperlang.Space(3, 64).bundle([t])[0][0] for t in (cyrillic, arabic, large[0])]
    beside = hyperlang.Space(3, 64).bundle([cyrillic, arabic, *large])[0]
    assert np.array_equal(np.stack(alone), beside[:3])
    space, want, text = hyperlang.Space(3, 64), np.zeros(64), f" {large[0]} "
    for i in range(len(text) - 2):
        a, b, c = (space.letter(ord(x)) for x in text[i:i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.allclose(beside[2], want / np.linalg.norm(want), atol=1e-5)


def test_language_of_odd_rows(spark, odd, empty):
    model = hyperlang.fit_prototypes(odd.select("text", "lang"))
    rows = {r["doc_id"]: r for r in hyperlang.identify_language(odd, model).where("doc_id IS NOT NULL").collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (3, 4, 5, 7))
    assert rows[6]["lang_pred"] == "en" and rows[8]["lang_pred"] == "fr"
    nothing = hyperlang.fit_prototypes(empty.select("text", "lang"))
    assert {r["lang_pred"] for r in hyperlang.identify_language(odd, nothing).collect()} == {"und"}
    assert hyperlang.identify_language(empty, model).count() == 0
