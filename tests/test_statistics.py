"""Analytic two-sample cases, bucketed plans against plain ones, exact order statistics."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.operators import shift as S
from trustlake.operators import twosample as TS
from trustlake.operators.scan import order_statistics, with_previous, with_rank, with_running


def _samples(spark, ref, ev, name="x"):
    return spark.createDataFrame([(name, "ref", float(v)) for v in ref] + [(name, "eval", float(v)) for v in ev], "g string, side string, v double")


@pytest.mark.parametrize("ref,ev,w1,ks,p", [
    ([1, 2, 3], [2, 3, 4], 1.0, 0.333333, None), ([0], [10], 10.0, 1.0, None), ([], [1], 0.0, 0.0, 1.0),
    ([1, 2, 3], [1, 2, 3], 0.0, 0.0, 1.0), (range(20), range(100, 120), 100.0, 1.0, 0.0),
])
def test_known_distances(spark, ref, ev, w1, ks, p):
    row = TS.compare_samples(_samples(spark, ref, ev), ["g"]).first()
    assert row["w1"] == w1 and row["ks"] == ks and (p is None or row["p_value"] == pytest.approx(p, abs=1e-3))


def test_not_finite_is_an_error(spark):
    with pytest.raises(Exception, match="non-finite"):
        TS.compare_samples(_samples(spark, [1.0, float("nan")], [1.0]), ["g"]).collect()


def test_buckets_change_nothing_under_skew(spark):
    rng = random.Random(1)
    hot = [rng.choice([0.0, rng.lognormvariate(0, 3)]) for _ in range(1500)]
    other = [rng.lognormvariate(0, 3) for _ in range(900)]
    df = _samples(spark, hot, other)
    plain = TS.compare_samples(df, ["g"]).first()
    cut = TS.compare_samples(df, ["g"], side=8, rows_per_bucket=10).first()
    assert plain == cut


def test_order_statistics_under_skew(spark):
    values = [0.0] * 500 + [float(i) for i in range(501)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    n = F.col("n")
    row = order_statistics(df, ["g"], "v", {"mid": F.floor(n / 2), "q90": F.floor(n * 0.9)}, side=8, rows_per_bucket=20).first()
    ordered = sorted(values)
    assert (row["n"], row["mid"], row["q90"]) == (1001, ordered[500], ordered[900])


def test_scans_equal_windows_for_any_width(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "b"]), i, rng.randint(0, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, x long")
    for width in (3, 50, 10_000):
        got = with_rank(with_previous(with_running(df, ["k"], "o", {"top": ("max", F.col("x")), "total": ("sum", F.col("x"))}, width), ["k"], "o", ["x"], width), ["k"], "o", "r", width)
        seen = {}
        for row in got.orderBy("o").collect():
            past = seen.setdefault(row["k"], [])
            assert (row["top"], row["total"], row["prev_x"], row["r"]) == (max(past, default=None), sum(past), past[-1] if past else None, len(past))
            past.append(row["x"])


def test_scans_over_sparse_and_repeated_orders(spark):
    rng = random.Random(3)
    at = sorted(rng.sample(range(1 << 40), 300))
    stamped = [(t << 22) | rng.randrange(4096) for t in at]  # ids made of milliseconds: a bucket each
    df = spark.createDataFrame([("hot", o, i % 7) for i, o in enumerate(stamped)] + [("cold", -5, 1), ("cold", 9, 2)], "k string, o long, x long")
    plain = W.partitionBy("k").orderBy("o")
    before = plain.rowsBetween(W.unboundedPreceding, -1)
    wanted = df.select("k", "o", F.lag("x").over(plain).alias("p"), F.max("x").over(before).alias("m"), F.coalesce(F.sum("x").over(before), F.lit(0)).alias("s"))
    wanted = sorted(map(tuple, wanted.collect()))
    for width, span in ((1 << 18, 1 << 22), (1 << 18, 1 << 40), (1 << 50, 4), (1 << 18, None)):
        got = with_running(df, ["k"], "o", {"m": ("max", F.col("x")), "s": ("sum", F.col("x"))}, width, span=span)
        got = with_previous(got, ["k"], "o", ["x"], width, span=span).select("k", "o", F.col("prev_x").alias("p"), "m", "s")
        assert sorted(map(tuple, got.collect())) == wanted
    buckets = df.where("k = 'hot'").select(F.floor(F.col("o") / (1 << 18)).alias("b"))
    assert buckets.distinct().count() > 290  # the summaries are as many as the rows, yet no window holds many of them
    spread = spark.createDataFrame([("hot", (i << 30) + (i % 3)) for i in range(5000)], "k string, o long")
    spans = spread.select(F.floor(F.col("o") / (1 << 18)).alias("b")).distinct().groupBy(F.floor(F.col("b") / (1 << 18)).alias("s")).count()
    assert spans.agg(F.max("count")).first()[0] <= 64
    same = spark.createDataFrame([("k", 4, 1)] * 20 + [("k", 5, 1)], "k string, o long, x long")
    ranks = sorted(r["r"] for r in with_rank(same, ["k"], "o", "r", 2).collect())
    assert ranks == list(range(21))


def _pair(spark, ref, ev, classes=2):
    rows = [("c", side, i, str(i % classes), [float(x) for x in v]) for side, m in (("ref", ref), ("eval", ev)) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "report string, side string, ord long, class_name string, vec array<double>")


def test_mmd(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    same = TS.mmd_rbf(_pair(spark, x, x), ["report"], "ord").first()
    moved = TS.mmd_rbf(_pair(spark, x, x + 0.5), ["report"], "ord").first()
    assert same["mmd"] == 0.0 and moved["mmd"] > 0.05


def test_total_variation_edges(spark):
    def tv(ref, ev):
        rows = [("r", n, "ref") for n, k in ref.items() for _ in range(k)] + [("r", n, "eval") for n, k in ev.items() for _ in range(k)]
        return TS.total_variation(TS.align_class_counts(spark.createDataFrame(rows, "g string, class_name string, side string"), ["g"]), ["g"]).first()

    assert tv({"tank": 5, "apc": 5}, {"tank": 5, "apc": 5})["tv"] == 0.0
    row = tv({"tank": 5, "apc": 5}, {"drone": 10})
    assert (row["tv"], row["missing_classes"], row["new_classes"]) == (1.0, 2, 1)


def test_shift_report_cases(spark):
    rows = [
        ("few", "covariate_shift", True, 0.5, 5), ("manip", "adversarial_manipulation", True, 0.6, 20), ("env", "environmental_drift", True, 0.3, 20),
        ("calm", "covariate_shift", False, 0.05, 20), ("cov", "covariate_shift", True, 0.4, 20), ("odd", "semantic_shift", True, 0.9, 20),
    ]
    dims = spark.createDataFrame([r[:4] for r in rows], "g string, dimension string, detected boolean, metric double")
    sizes = spark.createDataFrame([(r[0], r[4], r[4]) for r in rows], "g string, n_ref long, n_eval long")
    got = {r["g"]: r for r in S.shift_report(dims, sizes, ["g"]).collect()}
    assert {k: r["characterization"] for k, r in got.items()} == {
        "few": "INSUFFICIENT_SAMPLES", "manip": "SUSPICIOUS_MANIPULATION", "env": "NATURAL_ENVIRONMENTAL_DRIFT", "calm": "NO_SIGNIFICANT_SHIFT",
        "cov": "COVARIATE_DOMAIN_SHIFT", "odd": "INDETERMINATE_SHIFT",
    }
    assert got["manip"]["suspicious_manipulation_likelihood"] == 0.8 and not got["few"]["evidence_sufficient"]


def test_single_class_uses_spread(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    row = S.subpopulation_shift(_pair(spark, x, x + 1.0, classes=1), ["report"]).first()
    away = np.sort(np.linalg.norm(x + 1.0 - x.mean(0), axis=1))
    score = (away[int(0.9 * 30)] / np.median(away) - 1.2) * 0.3 + np.linalg.norm(x.mean(0) - (x + 1.0).mean(0)) * 0.5
    assert row["classes"] == 1 and row["metric"] == pytest.approx(min(1.0, max(0.0, score)), abs=1e-5)
