"""Near duplicates, line rules and template windows against plain Python, and the pipeline stage by stage."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from trustlake.llm import lines, prefixjoin, templates
from trustlake.llm.queries import QUERIES

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows, percent=80):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets.items()}


def family(seed, copies, words=40, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block,listed", [(512, 64), (16, 8), (512, 10_000)])
def test_join_equals_brute_force(spark, monkeypatch, block, listed):
    monkeypatch.setattr(prefixjoin, "BLOCK", block)
    monkeypatch.setattr(prefixjoin, "LISTED", listed)
    texts = family(1, 120) + family(2, 60, words=200, edits=12) + family(3, 40, words=7, edits=1)
    common = " ".join(f"c{k}" for k in range(60))
    texts += [f"{common} " + " ".join(f"u{i}x{k}" for k in range(40)) for i in range(60)]
    texts += ["one two", "one  TWO", "one two three", "a", "", " \n", None, "the same"] + ["the same"] * 20
    random.Random(4).shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in prefixjoin.similar_documents(df).collect()}
    assert got == plain_components(rows)


def test_join_where_all_cells_are_full(spark, monkeypatch):
    """Every shingle counts as frequent: the branch that needs no test of runs."""
    monkeypatch.setattr(prefixjoin, "cell_counts", lambda *a: prefixjoin.np.full(prefixjoin.CELLS, 40_000_000, dtype="uint32"))
    monkeypatch.setattr(prefixjoin, "FULL", 0)
    rows = list(enumerate(family(5, 50) + family(6, 30, words=9, edits=2)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in prefixjoin.similar_documents(df).collect()} == plain_components(rows)


def test_runs_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(g, 50, 50, [t for t in range(40) if t % (1 + g % 7) == 0]) for g in range(30)] * 2
    df = spark.createDataFrame(rows, "g long, n long, calm int, prefix array<bigint>")
    got = Counter((r["token"], r["g"]) for r in prefixjoin.shared_postings(df).collect())
    holders = defaultdict(set)
    for g, _, _, tokens in rows:
        for t in tokens:
            holders[t].add(g)
    assert got == Counter((t, g) for t, gs in holders.items() if len(gs) > 1 for g in gs)


def test_join_of_odd_rows(spark, odd, empty):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in prefixjoin.similar_documents(odd).collect()}
    assert {(1, 10, 1), (2, 10, 1), (3, 0, 3), (4, 0, 4), (9, 1, 9), (10, 1, 9), (None, 0, None)} <= rows
    assert prefixjoin.similar_documents(empty).count() == 0
    kept = prefixjoin.keep_first(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 2}


def plain_repeats(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)})


def test_line_rules(spark, odd, empty):
    rng = random.Random(7)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    footer = "Subscribe to our News letter 2024 for more of this"
    rows = [(i, f"{own(60)}\n{footer if i % 2 else own(9)}\n{own(20)}", "a") for i in range(80)]
    rows += [(100 + i, "\n".join([footer] * 2 + [own(12)]), "a") for i in range(3)]
    rows += [(200 + i, own(1) + "\n" + (phrase + " ") * 3 + own(30), "b") for i, phrase in enumerate([own(8), own(9), own(20)])]
    rows += [(300, rows[0][1], "b")] * 30 + [(301, None, None), (302, "a " * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in lines.line_quality(df, share=0.01, least=20).collect()}
    for i, text, _ in rows:
        words, r = WORD.findall(text or ""), got[i]
        full = [x for x in (text or "").split("\n") if x.strip()]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_repeat_words"] == plain_repeats(text) and r["n_dup_lines"] == len(full) - len(set(full))
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))
    assert all(got[i]["kept"] and got[i]["removed_words"] == (10 if i % 2 else 0) for i in range(80))
    assert all(not got[100 + i]["kept"] for i in range(3)) and got[300]["kept"] and not got[301]["kept"]
    assert lines.line_quality(odd).count() == odd.count()
    assert lines.line_quality(empty).count() == 0
    counted = lines.text_counts(df, "doc_id", "text", lines.F.col("source"))
    cleaned = lines.without_frequent_lines(df, lines.frequent_lines(counted, 0.01, 20), lines.F.col("source"))
    assert cleaned.columns == df.columns
    assert not any(footer in (r["text"] or "") for r in cleaned.where("source = 'a'").collect())


ITEM = "A train leaves Springfield at 9 and travels 120 km in 3 hours toward Shelbyville while another train waits"


def leak(spark, texts, items=((1, ITEM),)):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {r["doc_id"]: (r["leaked"], r["reparameterised"]) for r in templates.find_leaks(df, bench).collect()}


def test_templates_find_changed_questions(spark):
    changed = ITEM.replace("Springfield", "Berlin").replace("120 km", "75 miles").replace("9", "11,5").replace("Shelbyville", "Köln")
    other = "A cook waits in Springfield at 9 and buys 120 g of 3 things toward evening while another cook sleeps over there"
    got = leak(spark, [f"Intro words here. {ITEM}. More", f"So: {changed}!", other, None, "", ITEM.upper().lower() and "x " * 50, f"{ITEM} {changed}"])
    assert got == {0: (True, False), 1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False), 5: (False, False), 6: (True, False)}


def test_inconsistent_values_are_no_copy(spark):
    item = "if Anna pays Bernd then Anna and Bernd share what Bernd owes while Anna keeps the rest of it"
    same = item.replace("Anna", "Zoe").replace("Bernd", "Max")
    mixed = "if Zoe pays Max then Zoe and Tim share what Ute owes while Ida keeps the rest of it"
    assert leak(spark, [same, mixed], [(1, item)]) == {0: (True, True), 1: (False, False)}


def test_items_of_one_template_are_each_compared(spark, monkeypatch):
    a = "the grocer buys 3 apples and 3 pears and then sells all of them at the old market"
    b = a.replace("3 pears", "4 pears")
    for share in (templates.SHARE, 1):
        monkeypatch.setattr(templates, "SHARE", share)
        assert leak(spark, [b, a], [(1, a), (2, b)]) == {0: (True, False), 1: (True, False)}
    df = spark.createDataFrame([(0, b)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    assert templates.find_leaks(df, bench).first()["n_items"] == 1
    assert templates.drop_leaks(df, bench).count() == 0


def test_edited_copies_are_found(spark):
    item = (
        "The keeper Anna counts 40 lamps along the quiet road to the harbour and writes them into a long book before the night "
        "falls over the town and all of the boats come home with fish for the market where Anna sells what is left of it to them"
    )
    name, opener = item.replace("where Anna", "where Berta"), f"{item}. The end".replace("The end", "This end")
    short = "if Anna pays all of it then we and Anna share what is left over there"
    texts = [name, opener, short.replace("and Anna", "and Berta"), name.replace("40", "50")]
    assert leak(spark, texts, [(1, item), (2, f"{item}. The end")]) == {0: (True, False), 1: (True, False), 2: (False, False), 3: (True, False)}
    assert leak(spark, [name], [(1, item.replace("40", "60"))]) == {0: (True, False)}


def test_copies_in_another_case_are_found(spark):
    item = "What is the shortest way from Berlin to the old harbour when a ship of 90 metres blocks the Kiel canal and Straße 4"
    two = item.replace("Berlin", "New York").replace("Kiel", "Panama City")
    texts = [item.lower(), item.upper(), item.title(), f"Tell me, {item[0].lower()}{item[1:]}?", two, item.lower().replace("90 metres", "75 feet"), "x"]
    got = leak(spark, texts, [(1, item)])
    assert [got[i][0] for i in range(7)] == [True] * 6 + [False]
    assert [got[i][1] for i in (0, 1, 4)] == [False, False, True]


def test_short_and_literal_poor_items_are_found(spark):
    table = "Kg 12 13 14 15 16 17 18 19 20 21 22 23 24 25 km 26"
    items = [(1, ITEM), (2, "What is the capital of France?"), (3, table), (4, "we went to the shop and bought bread")]
    common = "another train waits while the cook reads and travels 5 km in 7 hours toward evening and then he sleeps"
    part = " ".join(ITEM.split()[1:10]) + " nothing more of it follows in this text at all"
    texts = ["so what is the CAPITAL of france, then", f"see {table}", table.replace("18", "99"), part, common, "today we went to the shop and bought bread", "What is the capital of Peru?"]
    got = leak(spark, texts, items)
    assert [got[i][0] for i in range(7)] == [True, True, False, False, False, True, False]


def test_templates_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (None, "too short"), (3, "")], "item_id long, text string")
    assert templates.find_leaks(odd, bench).where("leaked").count() == 0
    assert templates.find_leaks(odd, bench).count() == odd.count()
    assert templates.find_leaks(empty, bench).count() == 0
    assert templates.find_leaks(odd, bench.where("false")).where("leaked").count() == 0
    kept = templates.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_leaks_of_the_tables(spark, docs):
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in docs.collect() if any(i in norm(r["text"]) for i in items if len(i.split()) >= 13)}
    got = {r["doc_id"] for r in QUERIES["op10_template_decontamination"](spark, SF).where("leaked").collect()}
    assert want and got == want


def test_pipeline_stages(spark, docs):
    """Every stage on what the one before it kept, against the operators' plain versions."""
    rows = docs
    for name, step in corpus_pipeline.STAGES:
        before, rows = rows, corpus_pipeline.stage(step(spark, rows, SF), name)
        had = {r["doc_id"]: r["text"] for r in before.collect()}
        now = [r["doc_id"] for r in rows.collect()]
        if name == "near_duplicates":
            assert set(now) == {c for _, _, c in plain_components(had.items())}
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert rows.columns == docs.columns and len(now) == len(set(now)) and set(now) < set(had)
        if name == "mixture":
            assert rows.columns == docs.columns and set(now) <= set(had) and max(Counter(now).values()) == 2
        if name == "sharding":
            assert len(now) == before.count()


def test_pipeline_runs(spark):
    small = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and {r["doc_id"] for r in rows} < {r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
