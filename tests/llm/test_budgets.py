"""Costly steps of operators run on what needs them only, with the results of the plain way."""

import random

import numpy as np

from trustlake.llm import eliasfano, templates


def test_words_of_one_spelling_are_encoded_once(monkeypatch):
    """cases of a word and marks behind it are no words of their own for the tokenizer."""
    import public_tokenizers

    words = eliasfano.Words(public_tokenizers.path("word_bpe_49k.json"), "<u2", most=300)
    given, slow = [], []
    letters, whole = words._letters, words._whole
    monkeypatch.setattr(words, "_letters", lambda w: given.extend(w) or letters(w))
    monkeypatch.setattr(words, "_whole", lambda w: slow.extend(w) or whole(w))
    words.encode(["Ofarther ofarther OFARTHER. ofarther,", "ofarther%%% Señoría señoría!!", "señoría"], 1)
    assert sorted(given) == ["ofarther", "señoría"] and set(slow) <= {".", ",", "%%%", "!!"}
    rng = random.Random(5)
    signs = list("abzABZ09'.,!*$%_-#<\" \t\n\x0b\x1c\x85\xa0éÉßÿµªº²½ĀİıſȺΣσςあ漢🙂’“\u0301\u200b") + ["'s", "'T", " It's ", "</w>", "<|endoftext|>"]
    texts = ["", " "] + ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(3000)]
    got = [raw for i in range(0, len(texts), 100) for raw in words.encode(texts[i:i + 100], 1)]
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(g, "<u2").tolist() == [*w.ids, 1] for g, w in zip(got, want))


def _every_text(there, owners, text_col):
    key = templates.F.xxhash64(templates.F.col(text_col)).alias("text_key")
    return there.select(key, templates.F.col(text_col).alias("text")).groupBy("text_key").agg(templates.F.min("text").alias("text"))


def test_only_texts_with_an_anchor_are_tokenised(spark, monkeypatch):
    """the same leaks as when every text is tokenised, from the few texts that hold words of a window."""
    rng = random.Random(9)
    words = ["ship", "ΟΔΟΣ", "οδος", "Anna", "Peru", "harbour", "the", "of", "12", "40km", "3 h", "x7y", "Straße", "über", "²", "abc²", "ŉu", "λόγος", "Σ"]
    parts = [" ", " ", " ", ", ", ".", "-", "\u0345", "\ue002 ", "\n", "’"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice(parts) for _ in range(n))

    items = [(i, text(rng.choice([3, 9, 20, 30]))) for i in range(25)]
    texts = [f"{text(4)} {t if k else t.upper()} {text(4)}" for _, t in items for k in (0, 1)]
    texts += [t.replace("Anna", "Zoe").replace("12", "13").replace("40km", "50 mi") for _, t in items]
    texts += [f"plain{i} prose{i} without{i} a word of theirs" for i in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for some in (items, [(1, "12 13 14"), *items[:3]]):
        bench = spark.createDataFrame(some, "item_id long, text string")
        got = sorted(map(tuple, templates.find_leaks(df, bench).collect()))
        with monkeypatch.context() as m:
            m.setattr(templates, "_candidates", _every_text)
            want = sorted(map(tuple, templates.find_leaks(df, bench).collect()))
        assert got == want and sum(r[1] for r in got) > 5
    owners = templates.benchmark_windows(spark.createDataFrame([(1, "the keeper counts the lamps along the quiet road to the harbour and back")], "item_id long, text string"))
    assert templates._candidates(df.where("text LIKE 'plain%'"), owners, "text").count() == 0
