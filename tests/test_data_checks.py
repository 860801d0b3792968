"""Planted faults, brute force and hot groups for the data operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake.functions import binary as B
from trustlake.operators import centroids as C
from trustlake.operators import duplicates as D
from trustlake.operators import models as M
from trustlake.operators import neighbours as N
from trustlake.operators.digest import table_digest


def test_hamming_pairs_brute_force_and_hot_bands(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 3, 4, 5, 9) for _ in range(12)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed for _ in range(2)], "dhash long")
    truth = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if bin((p[0] ^ p[1]) & (1 << 64) - 1).count("1") <= 4}
    for hot in (4000, 3):
        got = {(r["a"], r["b"]) for r in D.hamming_pairs(df, hot=hot).collect()}
        assert got == truth


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in D.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_near_duplicates_need_two_contents(spark):
    rows = [("d", "1", "A", 0), ("d", "2", "A", 0), ("d", "3", "B", 1 << 20), ("d", "4", "C", -1), ("d", "5", "C", -1), ("e", "6", "D", 3)]
    df = spark.createDataFrame(rows, "dataset_id string, image_id string, file_hash string, dhash long")
    got = D.near_duplicate_clusters(df, ["dataset_id"])
    assert sorted(r["image_id"] for r in got.collect()) == ["1", "2", "3"]
    summary = {r["dataset_id"]: r for r in D.near_duplicate_summary(got, df, ["dataset_id"]).collect()}
    assert (summary["d"]["clusters"], summary["d"]["files"], summary["e"]["clusters"]) == (1, 3, 0)


@pytest.mark.parametrize("pivots", [1, 6])
def test_knn_brute_force_with_a_third_of_rows_equal(spark, pivots):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 5))
    x[:40] = x[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(str(i), i, i % 3, [float(v) for v in row]) for i, row in enumerate(x)], "image_id string, ord long, class_id int, vec array<double>")
    got = {}
    for r in N.knn_join(df, 4, pivots=pivots, block=16).collect():
        got.setdefault(r["ord"], []).append((r["rank"], int(r["n_id"])))
    away = np.floor(np.maximum(0, 1 - x @ x.T) * 1e9 + 0.5000001) / 1e9
    for i in range(120):
        order = sorted((away[i, j], j) for j in range(120) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in order]


def test_one_huge_group_is_pruned_by_its_own_tree(spark):
    """Nearly all rows in one clustered group: exact against brute force, and far fewer pairs than its square."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8))
    rows, x = [], []
    for i in range(2100):
        v = centres[i % 40] + 0.05 * rng.normal(size=8) if i % 7 else centres[i % 40]
        x.append(v / np.linalg.norm(v))
        rows.append(("small" if i % 21 == 0 else "huge", str(i), i, i % 3, x[-1].tolist()))
    df = spark.createDataFrame(rows, "g string, image_id string, ord long, class_id int, vec array<double>").repartition(5)
    x, group = np.array(x), np.array([r[0] for r in rows])
    got = {}
    for r in N.knn_join(df, 3, by=["g"], pivots=32, leaf=300, block=64).collect():
        got.setdefault(r["ord"], []).append((r["rank"], int(r["n_id"])))
    away = np.floor(np.maximum(0, 1 - x @ x.T) * 1e9 + 0.5000001) / 1e9
    for i in range(len(rows)):
        order = sorted((away[i, j], j) for j in np.flatnonzero(group == group[i]) if j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in order]
    points = spark.createDataFrame([(r[0], r[2], r[4]) for r in rows], "g string, _uid long, _vec array<double>")
    members, queries = N.pivot_tree(points, ["g"], 3, 100, 32)
    held, asked = ({tuple(r)[:2]: r["count"] for r in d.groupBy("_g", "_path").count().collect()} for d in (members, queries))
    assert sum(held.values()) == len(rows) and len(held) > 30
    assert sum(n * asked.get(node, 0) for node, n in held.items()) < len(rows) ** 2 / 5


def test_flipped_label_is_found(spark):
    def content(level, i):
        return bytes((level + (i * 7 + j) % 9) % 256 for j in range(600))

    rows = [(f"{c}{i}", c * 10 + i, c, bytearray(content(40 if c == 0 else 200, i))) for c in (0, 1) for i in range(5)]
    rows.append(("flipped", 99, 1, bytearray(content(40, 3))))
    df = spark.createDataFrame(rows, "image_id string, ord long, class_id int, content binary").withColumn("vec", B.byte_features(F.col("content"))).drop("content")
    got = N.label_disagreement(N.nearest(df, 5), 5, 0.8).collect()
    assert [(r["image_id"], r["consensus"]) for r in got] == [("flipped", "0")]


def test_hmac_and_byte_functions(spark):
    import hashlib
    import hmac

    from trustlake.functions.hashing import hmac_pads, hmac_sha256

    rows = [(bytearray(bytes(range(n % 256)) * (1 + n // 256)), bytearray(f"message {n}".encode())) for n in (0, 5, 64, 65, 200)]
    df = spark.createDataFrame(rows, "k binary, m binary")
    for r in df.select("k", "m", hmac_sha256(hmac_pads(F.col("k")), F.col("m")).alias("h")).collect():
        assert r["h"] == hmac.new(bytes(r["k"]), bytes(r["m"]), hashlib.sha256).hexdigest()


def test_image_headers(spark):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\0" * 8
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08" + struct.pack(">HH", 33, 44) + b"\0" * 12
    bmp = b"BM" + b"\0" * 16 + struct.pack("<II", 7, 9) + b"\0" * 8
    gif = b"GIF89a" + struct.pack("<HH", 3, 5) + b"\0" * 10
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([png, jpeg, bmp, gif, webp, b"x" * 20, b"x"])], "i int, c binary")
    got = [tuple(r["h"]) for r in df.select("i", B.image_header(F.col("c")).alias("h")).orderBy("i").collect()]
    assert got == [(640, 480, "png"), (44, 33, "jpeg"), (7, 9, "bmp"), (3, 5, "gif"), (100, 50, "webp"), (0, 0, "unknown"), (0, 0, "unknown")]


def test_assignment_is_optimal():
    rng = np.random.default_rng(6)
    for rows, cols in ((1, 4), (3, 3), (5, 3), (4, 6)):
        for _ in range(20):
            cost = rng.integers(0, 9, size=(rows, cols)).astype(float)
            got = M._assign(cost)
            small, large = (rows, cols) if rows <= cols else (cols, rows)
            c = cost if rows <= cols else cost.T
            best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
            assert len(got) == small and sum(cost[i, j] for i, j in got) == best


def test_matching_is_the_same_when_a_crowded_probe_is_split(spark):
    rng = np.random.default_rng(7)

    def boxes(model, n, seed):
        out = []
        for i, (x, y) in enumerate(np.random.default_rng(seed).random((n, 2)) * 0.9):
            out.append((model, "p", i, i % 3, 0.9, (float(x), float(y), float(x) + 0.08, float(y) + 0.08)))
        return spark.createDataFrame(out, "model_id string, probe_id string, det_no int, class_id int, confidence double, box struct<x_min:double,y_min:double,x_max:double,y_max:double>")

    del rng
    cand, ref = boxes("c", 90, 1), boxes("r", 80, 2)
    whole = M.match_boxes(cand, ref, crowd=10_000)
    split = M.match_boxes(cand, ref, crowd=5)
    total = lambda df: (df.count(), round(df.agg(F.sum("iou")).first()[0], 9))
    assert total(whole) == total(split)
    plain, grid = M.iou_pairs(cand, ref, crowd=10_000), M.iou_pairs(cand, ref, crowd=1)
    key = lambda df: sorted((r["c_no"], r["r_no"], round(r["iou"], 9)) for r in df.collect())
    assert key(plain) == key(grid) and len(key(plain)) > 20


def test_digest_ignores_order_but_not_content(spark):
    df = spark.range(200).withColumn("x", F.col("id") % 7)
    same = table_digest(df.orderBy(F.desc("id")), ["id", "x"]).first()
    assert table_digest(df, ["id", "x"]).first() == same
    assert table_digest(df.withColumn("x", F.when(F.col("id") == 5, 6).otherwise(F.col("x"))), ["id", "x"]).first() != same
    assert table_digest(df.union(df.limit(1)), ["id", "x"]).first() != same


def test_mad_outlier_rules(spark):
    rows = [("ok", n, s) for n, s in (("a", 10.0), ("b", 11.0), ("c", 9.0), ("d", 1.0), ("e", 10.5))] + [("few", "a", 1.0), ("few", "b", 2.0)]
    rows += [("flat", n, 5.0) for n in "abc"] + [("stuck", n, s) for n, s in (("a", 5.0), ("b", 5.0), ("c", 5.0), ("d", 1.0))]
    got = {r["g"]: r for r in M.mad_outlier(spark.createDataFrame(rows, "g string, name string, score double"), ["g"]).collect()}
    assert (got["ok"]["suspect"], got["ok"]["flagged"], got["ok"]["anomaly_index"]) == ("d", True, 6.07)
    assert got["few"]["status"] == got["stuck"]["status"] == "INSUFFICIENT_EVIDENCE" and got["flat"]["anomaly_index"] == 0.0


def test_confusion_by_matrix_equals_the_join(spark):
    """Both ways, grouped, with a class too small for a centroid and a label that occurs in one group only."""
    import numpy as np

    rng = np.random.default_rng(9)
    rows = []
    for k in range(600):
        label = int(rng.integers(0, 5)) if k % 3 else 0
        v = rng.normal(size=8) + label * 0.4
        rows.append(("d1" if k % 4 else "d2", label if k != 17 else 99, (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame(rows, "d string, class_id int, vec array<double>").repartition(6)
    pick = lambda max_bytes: sorted(map(tuple, C.confusion_rates(df, ["d"], max_bytes=max_bytes).collect()))
    assert pick(1 << 20) == pick(0) and len(pick(0)) == 2 * 5 * 4
