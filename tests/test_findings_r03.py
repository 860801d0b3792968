"""Faults found in the third round, each on a small table that shows it."""

import json

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from trustlake.catalog import ORACLES, QUERIES
from trustlake.functions import hashing as H
from trustlake.llm import lines as L
from trustlake.operators import ingest as I
from trustlake.operators import models as M
from trustlake.operators import neighbours as N


def test_bands_of_means_on_an_edge_follow_the_order_of_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    taxes = [rng.permutation([0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08] * 40) for _ in range(60)]
    for part in range(24):
        rows = [(s, float(x)) for i in range(part * 15, part * 15 + 15) for s, x in ((s, t[i]) for s, t in enumerate(taxes))]
        table = pa.table({"l_suppkey": [r[0] for r in rows], "l_tax": [r[1] for r in rows]})
        pq.write_table(table, folder / f"part-{part:03d}.parquet")
    got = {tuple(r) for r in QUERIES["distance_bands"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    want = {tuple(r) for r in con.execute(ORACLES["distance_bands"]).fetchall()}
    assert len({band for _, _, band in want}) == 2  # sums on both sides of the edge
    assert got == want


def test_vectors_without_clusters_do_not_multiply_queries(spark):
    """Bounds prune nothing among even vectors: queries stay in one place, and chunks are scored exactly."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    points = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, _uid long, _vec array<double>")
    members, queries = N.pivot_tree(points, ["g"], 3, 200, 32)
    assert members.count() == len(x) and queries.count() <= 16 * len(x)
    df = spark.createDataFrame([(str(i), i, i % 3, v.tolist()) for i, v in enumerate(x)], "image_id string, ord long, class_id int, vec array<double>")
    got = {}
    for r in N.knn_join(df, 3, pivots=32, leaf=200).collect():
        got.setdefault(r["ord"], []).append((r["rank"], int(r["n_id"])))
    away = np.floor(np.maximum(0, 1 - x @ x.T) * 1e9 + 0.5000001) / 1e9
    np.fill_diagonal(away, np.inf)
    for i in range(len(x)):
        assert [j for _, j in sorted(got[i])] == list(np.argsort(away[i], kind="stable")[:3])


def test_clear_boxes_need_no_assignment(monkeypatch):
    """Many overlap groups at once: the assignment runs for unclear ones alone, and every total is the best one."""
    rng = np.random.default_rng(4)
    plain, calls = M._assign, []
    monkeypatch.setattr(M, "_assign", lambda cost: calls.append(1) or plain(cost))
    costs = [np.clip(1 - np.eye(4) * 0.9 - 0.02 * rng.random((4, 4)), 0, 1) if g % 2 else rng.random((3, 4)) for g in range(60)]
    edges = np.array([(g, i, j, 1 - c[i, j]) for g, c in enumerate(costs) for i in range(len(c)) for j in range(4)])
    owner, c_no, r_no = (edges[:, i].astype(int) for i in range(3))
    chosen = M._accepted(owner, c_no, r_no, edges[:, 3], 2.0)
    assert len(calls) <= 30
    for g, cost in enumerate(costs):
        mine = chosen[owner[chosen] == g]
        assert len(set(c_no[mine])) == len(mine) == len(set(r_no[mine]))
        assert abs((1 - edges[mine, 3]).sum() - sum(cost[at] for at in plain(cost))) < 1e-9


def test_boxes_of_calm_and_crowded_probes_together(spark):
    """One probe above and some below the number of boxes that meet in one row, null classes and probes included."""
    def rows(shift):
        out = [(None, 1, 1, (0.1, 0.1, 0.5, 0.5)), ("odd", 2, None, (0.1, 0.1, 0.5, 0.5)), ("odd", 3, 1, None)]
        for probe, n in (("busy", 40), ("calm", 8), ("one", 1)):
            for i in range(n):
                x, y = (i % 8) / 8, (i // 8) / 8
                out.append((probe, i, i % 3, (x + shift, y, x + 0.14 + shift, y + 0.14)))
        return spark.createDataFrame(out, "probe_id string, det_no int, class_id int, box struct<x_min:double,y_min:double,x_max:double,y_max:double>")
    got = M.match_boxes(rows(0.01), rows(0.0)).collect()
    assert sorted((r["probe_id"], r["c_no"]) for r in got) == sorted([(p, i) for p, n in (("busy", 40), ("calm", 8), ("one", 1)) for i in range(n)] + [("odd", 2)])
    assert all(r["c_no"] == r["r_no"] and (r["same_class"] or r["probe_id"] == "odd") for r in got)


def test_files_are_resolved_without_moving_paths_twice(spark):
    """Places in their order, repeated places once, any file of the name last; no path is grouped after the join."""
    images = spark.createDataFrame(
        [(1, "a", "a.jpg", "train"), (1, "b", "b.jpg", ""), (1, "c", "c.jpg", None), (1, "d", "d.jpg", "x"), (1, "e", None, ""), (1, "f", "f.jpg", "x")],
        "dataset_id int, image_id string, file_name string, manifest_dir string",
    )
    files = spark.createDataFrame([(1, p) for p in (
        "images/a.jpg", "train/a.jpg", "a.jpg", "images/b.jpg", "test/b.jpg", "z/c.jpg", "y/c.jpg", "d.jpg", "x/d.jpg", "d.jpg")], "dataset_id int, path string")
    out = I.resolve_files(images, files)
    assert {r["image_id"]: r["resolved_path"] for r in out.collect()} == {
        "a": "train/a.jpg", "b": "images/b.jpg", "c": "y/c.jpg", "d": "x/d.jpg", "e": None, "f": None}
    assert "min_by" not in out._jdf.queryExecution().executedPlan().toString()


def test_plain_json_needs_no_python_and_says_the_same(spark):
    """Native canonical texts equal Python's, and whatever is not plain is left to it."""
    texts = [
        '{}', ' { } ', '{"a": 1, "b": 2.5}', '{"class_id": 3, "confidence": 0.875}', '{"a":"x, \'y\': {1}","b":null, "c" : true}', '{"a": -0.5, "b": 10.0, "c": 0}',
        '{"b": 1, "a": 2}', '{"a": 1, "a": 2}', '{"a": 1.50}', '{"a": 0.12345}', '{"confidence": 0.123456789}', '{"a": 1e3}', '{"a": -0}', '{"a": [1.0]}', '{"bbox": [1, 2]}',
        '{"a": "\\u00e9"}', '{"a": "é"}', '{"a": {"b": 0.25}}', '[1]', '{"a": 12345678901234567890}', '{"a": "' + "x" * 3000 + '"}', '{"A": 1, "_": 2, "a": 3}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", H.plain_json(F.col("t")).alias("p")).collect()}
    want = [H._compact(H.quantized(json.loads(t))) for t in texts]
    assert all(got[i] in (None, w) for i, w in enumerate(want))
    assert [i for i in range(len(texts)) if got[i] is not None] == [0, 1, 2, 3, 4, 5, 21]
    rows = df.select(*[F.lit("é" if n == "record_id" else "x").alias(n) for n in H.BOUND_FIELDS if n not in ("output", "inference_config", "sequence_number", "timestamp")],
                     F.lit(1).alias("sequence_number"), F.to_timestamp(F.lit("2024-01-01")).alias("timestamp"), "i", F.col("t").alias("output"), F.lit(None).cast("string").alias("inference_config"))
    out = H.add_payload(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in out.collect():
        assert json.loads(r["payload"])["output"] == H.quantized(json.loads(texts[r["i"]])) and "\\u00e9" in r["payload"]


def test_lines_are_counted_by_document_unless_asked_by_text(spark):
    """A line of 30 copies is in 30 documents, and in one text."""
    own = " ".join(f"word{i}" for i in range(30))
    rows = [(i, f"{own}\nSame line everywhere in here", "a") for i in range(30)] + [(100 + i, own + f" {i}", "a") for i in range(5)] + [(None, own, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {by_text: {r["doc_id"]: r["removed_words"] for r in L.line_quality(df, by_text=by_text).collect()} for by_text in (False, True)}
    assert all(removed[False][i] == 35 for i in range(30)) and all(not n for n in removed[True].values())
