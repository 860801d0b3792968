"""Signals planted only where a prefix, sample or cap would not look, and faults that never show in the test tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake.functions import binary as B
from trustlake.functions.hashing import add_payload
from trustlake.functions.text import utc_text
from trustlake.functions.vectors import unit
from trustlake.operators import digest, records
from trustlake.operators import shift as S
from trustlake.operators import twosample as TS
from trustlake.plans.checks import FINDING_COLUMNS, run_checks


def vectors(spark, ref, ev):
    rows = [("c", side, i, [float(x) for x in v]) for side, m in (("ref", ref), ("eval", ev)) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "report string, side string, ord long, vec array<double>")


def test_kernel_sees_every_row(spark):
    rng = np.random.default_rng(3)
    ref, ev = rng.normal(size=(1000, 3)), rng.normal(size=(1000, 3))
    ev[501:] += 4.0
    whole = TS.mmd_rbf(vectors(spark, ref, ev), ["report"], "ord").first()["mmd"]
    assert whole > 0.2
    with pytest.raises(Exception, match="(?i)vector"):
        bad = ref.copy()
        bad[700, 2] = np.nan
        TS.mmd_rbf(vectors(spark, bad, ev), ["report"], "ord").collect()
    ragged = vectors(spark, ref[:5], ev[:5]).withColumn("vec", F.when(F.col("ord") == 3, F.slice("vec", 1, 2)).otherwise(F.col("vec")))
    with pytest.raises(Exception, match="lengths"):
        TS.mmd_rbf(ragged, ["report"], "ord").collect()


def test_kernel_over_unequal_sides_is_the_plain_mean(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(7, 2)), rng.normal(size=(17, 2)) + 1
    k = lambda a, b: np.exp(-0.3 * ((a - b) ** 2).sum())
    near = lambda m: np.mean([k(m[i], m[i + 1]) for i in range(len(m) - 1)])
    cross = np.mean([k(x[i % 7], y[(i + 1) % 17]) for i in range(17)])
    got = TS.mmd_rbf(vectors(spark, x, y), ["report"], "ord", gamma=0.3).first()["mmd"]
    assert got == pytest.approx(np.sqrt(max(0.0, near(x) + near(y) - 2 * cross)), abs=1e-6)


def test_shift_sees_late_dimensions(spark):
    rng = np.random.default_rng(5)
    ref, ev = rng.normal(size=(60, 44)), rng.normal(size=(60, 44))
    ev[:, 40:] += 3.0
    long = TS.explode_vectors(vectors(spark, ref, ev), ["report", "side"])
    calm = TS.explode_vectors(vectors(spark, ref, np.where(np.arange(44) < 40, ev, ev - 3.0)), ["report", "side"])
    ratio = lambda df: TS.ks_rejection(df, ["report"]).first()["ks_rejection_ratio"]
    assert ratio(long) - ratio(calm) >= 0.06
    assert TS.mean_wasserstein(long, ["report"]).first()["mean_w1"] > 0.35
    row = S.covariate_shift(vectors(spark, ref, ev), ["report"], "ord").first()
    assert row["ks_rejection_ratio"] >= 0.09


def test_bytes_behind_the_first_thousands(spark):
    flat, late = bytes([7]) * 20_000, bytes([7]) * 5_000 + bytes([7, 250]) * 7_500
    rows = spark.createDataFrame([(0, bytearray(flat)), (1, bytearray(late))], "i int, c binary")
    q = [r["q"] for r in rows.orderBy("i").select(B.quality_scalars(F.col("c"), F.lit(1), F.lit(1)).alias("q")).collect()]
    assert q[0]["sharpness"] == 0 and q[1]["sharpness"] == pytest.approx(243 * 14_999 / 19_999 / 255, abs=1e-4)
    f = [r["f"] for r in rows.orderBy("i").select(B.byte_features(F.col("c")).alias("f")).collect()]
    assert f[0][69] == 0 and f[1][69] > 0


def test_jpeg_size_behind_a_large_profile(spark):
    profile = b"".join(b"\xff\xe2" + (60_002).to_bytes(2, "big") + b"\0" * 60_000 for _ in range(3))
    body = b"\xff\xd8" + profile + b"\xff\xc0" + (17).to_bytes(2, "big") + b"\x08" + (33).to_bytes(2, "big") + (44).to_bytes(2, "big") + b"\0" * 20
    got = spark.createDataFrame([(bytearray(body),)], "c binary").select(B.image_header(F.col("c")).alias("h")).first()["h"]
    assert tuple(got) == (44, 33, "jpeg")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_text_is_utc_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    moments = [dt.datetime(2024, 3, 10, 2, 30, 0, 5, tzinfo=dt.UTC), dt.datetime(2024, 11, 3, 5, 30, tzinfo=dt.UTC), dt.datetime(1969, 12, 31, 23, 0, tzinfo=dt.UTC)]
    rows = spark.createDataFrame([(m,) for m in moments], "t timestamp")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r[0] for r in rows.select(utc_text(F.col("t"))).collect()]
        plain = rows.limit(1).select(utc_text(F.expr("timestamp_ntz'2024-03-10 02:30:00.5'"), "+00:00").alias("t")).first()["t"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [m.strftime("%Y-%m-%dT%H:%M:%S.%fZ") for m in moments] and plain == "2024-03-10T02:30:00.500000+00:00"


def test_payload_does_not_depend_on_the_zone(spark):
    fields = "record_id session_id producer_id input_image_hash model_id model_weight_digest preprocessing_config_hash nonce previous_record_hash signing_key_id schema_version inference_config output".split()
    rows = spark.createDataFrame([(*["{}"] * len(fields), 1, dt.datetime(2024, 7, 1, 12, tzinfo=dt.UTC))], ", ".join(f"{f} string" for f in fields) + ", sequence_number long, timestamp timestamp")
    before, texts = spark.conf.get("spark.sql.session.timeZone"), set()
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            texts.add(add_payload(rows).first()["payload"])
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
    assert len(texts) == 1 and "2024-07-01T12:00:00.000000Z" in texts.pop()


def test_row_digests_are_injective(spark):
    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\x00", "x"), ("-", "x"), ("1:a", ""), ("1", "a:"), ("", None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(digest.row_digest(["x", "y"]).alias("d")).distinct().count() == len(rows)


def test_repeated_registry_rows(spark):
    seen = spark.createDataFrame([("r1", "m", "d1"), ("r2", "n", "d2")], "record_id string, model_id string, model_weight_digest string")
    same = spark.createDataFrame([("m", "d1"), ("m", "d1"), ("n", "zz")], "model_id string, registered_digest string")
    got = {r["record_id"]: r["model_mismatch"] for r in records.check_model_digest(seen, same).collect()}
    assert got == {"r1": False, "r2": True} and records.check_model_digest(seen, same).count() == 2
    two = spark.createDataFrame([("m", "d1"), ("m", "d2")], "model_id string, registered_digest string")
    with pytest.raises(Exception, match="different rows"):
        records.check_model_digest(seen, two).collect()


def test_no_check_gives_an_empty_table(spark):
    found, states = run_checks([], {"signals": spark.range(1)}, ["DT-6"])
    assert found.count() == 0 and tuple(found.columns) == FINDING_COLUMNS and states == {}


def test_unit_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<double>")
    assert [r["u"] for r in rows.select(unit(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
