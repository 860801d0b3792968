"""Streaming operators give the batch results, also across a restart."""

import json

from pyspark.sql import functions as F

from trustlake.catalog import streams as ST
from trustlake.catalog.base import Tables
from trustlake.operators import chain as CH
from trustlake.operators import records as R
from trustlake.operators import shift as S
from trustlake.operators import twosample as TS
from trustlake.streaming import audit, drift
from trustlake.streaming import records as SR

SF = "/root/testdata/sf0.001"


def _write_parts(df, path, parts):
    bounds = df.agg(F.max("arrival")).first()[0] + 1
    for i in range(parts):
        low, high = bounds * i // parts, bounds * (i + 1) // parts
        df.where((F.col("arrival") >= low) & (F.col("arrival") < high)).coalesce(1).write.mode("append").parquet(str(path))
    return path


def _run(spark, stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(out))


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_sequence_and_nonce_equal_batch_across_restart(spark, tmp_path):
    SR.use_rocksdb(spark)
    events = ST.events(Tables(spark, SF)).withColumn("record_hash", F.sha2("nonce", 256)).drop("timestamp")
    source = tmp_path / "in"
    half = events.agg(F.max("arrival")).first()[0] // 2
    schema = events.schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))

    columns = ["arrival", "previous_sequence", "sequence_regression", "sequence_gap"]
    _write_parts(events.where(F.col("arrival") <= half), source, 2)
    _run(spark, SR.flag_stream(stream()), tmp_path / "seq", tmp_path / "cp1")
    _run(spark, SR.flag_nonce(stream()), tmp_path / "nonce", tmp_path / "cp2")
    _write_parts(events.where(F.col("arrival") > half), source, 3)
    seq = _run(spark, SR.flag_stream(stream()), tmp_path / "seq", tmp_path / "cp1")
    nonce = _run(spark, SR.flag_nonce(stream()), tmp_path / "nonce", tmp_path / "cp2")
    assert _rows(seq, *columns) == _rows(R.sequence_state(events), *columns)
    assert _rows(nonce, "arrival", "nonce_replay") == _rows(R.nonce_replay(events), "arrival", "nonce_replay")


def test_full_stream_equals_batch(spark, tmp_path):
    SR.use_rocksdb(spark)
    t = Tables(spark, SF)
    records = ST.records(t).where("arrival < 400").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    source = _write_parts(records, tmp_path / "in", 3)
    now = F.to_timestamp(F.lit(ST.NOW))
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    models, preprocessing, images = ST.registries(t)
    found = SR.verify_stream(stream, ST.keys(t), now, tolerance=864_000.0, models=models, preprocessing=preprocessing, images=images)
    out = _run(spark, found, tmp_path / "out", tmp_path / "cp")
    batch = R.verify_records(records, ST.keys(t), now, models, preprocessing, images, tolerance=864_000.0)
    assert _rows(out, "arrival", "status") == _rows(batch, "arrival", "status")


def test_links_in_stream(spark, tmp_path):
    SR.use_rocksdb(spark)
    rows = [(i, "s", "k", i, f"h{i}", f"h{i - 1}" if i != 3 else "zz", True) for i in range(6)]
    df = spark.createDataFrame(rows, "arrival long, session_id string, signing_key_id string, sequence_number long, record_hash string, previous_record_hash string, authentic boolean")
    source = _write_parts(df, tmp_path / "in", 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = _run(spark, SR.flag_stream(stream, check_links=True), tmp_path / "out", tmp_path / "cp")
    assert _rows(out, "arrival", "link_broken", "sequence_gap") == [(i, i == 3, i == 4) for i in range(6)]


def test_one_hot_stream_of_large_numbers_in_one_batch_equals_batch(spark, tmp_path):
    """Most rows are of one stream and come shuffled, in many Arrow batches; its numbers lie above 2^53."""
    SR.use_rocksdb(spark)
    base = (1 << 60) + 1
    df = spark.range(30_000).select(
        F.col("id").alias("arrival"), F.when(F.col("id") % 20 == 0, "t").otherwise("s").alias("session_id"), F.lit("k").alias("signing_key_id"),
        F.when(F.col("id") % 97 != 5, F.lit(base) + F.col("id") - F.when(F.col("id") % 53 == 0, 3).otherwise(0)).alias("sequence_number"),
        F.sha2(F.col("id").cast("string"), 256).alias("record_hash"), (F.col("id") % 11 != 0).alias("authentic"),
    )
    path = tmp_path / "in"
    df.orderBy(F.xxhash64("arrival")).coalesce(1).write.parquet(str(path))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        stream = spark.readStream.schema(df.schema).parquet(str(path))
        out = _run(spark, SR.flag_stream(stream, chunk=1500), tmp_path / "out", tmp_path / "cp")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("sequence_regression", "sequence_gap")]
    pick = lambda rows: {r[0]: tuple(r) for r in rows.select("arrival", "sequence_number", "previous_sequence", *flags).collect()}
    ours, batch = pick(out), pick(R.sequence_state(df))
    assert ours == batch and len(ours) == 30_000
    assert any(r[3] for r in ours.values()) and any(r[4] for r in ours.values())


def test_append_audit_continues_chains(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"log{i % 2}", i, f"e{i}", "2024-01-01 00:00:00", "FINDING_RECORDED", "tester", None, None, json.dumps({"n": i})) for i in range(8)]
    df = spark.createDataFrame(rows, "log_id string, ord long, event_id string, timestamp string, event_type string, actor string, asset_id string, session_id string, details string")
    df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
    write = audit.append_audit(path)
    write(df.where("ord < 4"), 0)
    write(df.where("ord < 4"), 0)
    write(df.where("ord >= 4"), 1)
    log = spark.read.parquet(path).withColumn("timestamp", F.to_timestamp("timestamp_text"))
    result = CH.verify_chain(CH.row_hashes(log), order="sequence_number").collect()
    assert [(r["is_valid"], r["total_events"]) for r in result] == [(True, 4), (True, 4)]
    tampered = log.withColumn("actor", F.when(F.col("event_id") == "e4", "other").otherwise(F.col("actor")))
    bad = {r["log_id"]: r for r in CH.verify_chain(CH.row_hashes(tampered), order="sequence_number").collect()}
    assert bad["log0"]["reason"] == "content" and bad["log0"]["failed_index"] == 2 and bad["log1"]["is_valid"]


WATCHED = drift.Columns("ts", "class_name", ("luminance", "contrast", "sharpness"), "vec")


def _drifting(spark):
    """Two windows with other classes, brightness and vectors, and a far one that closes them."""
    import numpy as np

    rng = np.random.default_rng(4)
    make = lambda n, start, names, move: [
        (start + int(s), str(rng.choice(names)), float(rng.normal(0.5 + move, 0.1)), float(rng.random()), float(rng.random() * (1 + move)), (rng.normal(size=6) + move).tolist())
        for s in rng.integers(0, 3600, n)
    ]
    schema = "sec long, class_name string, luminance double, contrast double, sharpness double, vec array<double>"
    timed = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("sec"))
    baseline = timed(make(400, 0, ["cat", "dog", "fox"], 0.0))
    windows = [make(300, 7200, ["cat", "dog", "fox"], 0.02), make(200, 10800, ["cat", "dog", "owl"], 0.6), make(90, 14400, ["cat"], 0.3), make(1, 36000, ["cat"], 0.0)]
    return baseline, timed([r for w in windows for r in w])


def _monitored(spark, tmp_path, base, rows, parts, last):
    source = tmp_path / "arriving"
    for k in range(parts):
        rows.where(F.pmod(F.xxhash64("sec", "luminance"), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(str(source))
    last.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    sketches = drift.window_sketches(stream, base, 3600, "12 hours")
    path = str(tmp_path / "drift")
    query = sketches.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    query.foreachBatch(drift.monitor_drift(base, path)).start().awaitTermination()
    return spark.read.parquet(path)


def test_drift_of_split_windows_equals_batch_and_comes_once(spark, tmp_path):
    """Each window is spread over three micro-batches; a fourth moves the watermark past them."""
    SR.use_rocksdb(spark)
    baseline, rows = _drifting(spark)
    base = drift.build_baseline(baseline, WATCHED, grid=None, features=4096, gamma=0.05)
    late = spark.createDataFrame([(400_000, "cat", 0.5, 0.5, 0.5, [0.0] * 6)], "sec long, class_name string, luminance double, contrast double, sharpness double, vec array<double>")
    found = _monitored(spark, tmp_path, base, rows, 3, late.withColumn("ts", F.timestamp_seconds("sec")))
    ours = {(r["window_start"].timestamp(), r["dimension"]): r for r in found.collect()}
    assert found.count() == len(ours)
    both = rows.withColumn("w", F.floor(F.col("sec") / 3600) * 3600)
    wanted = both.select("w").distinct()
    both = both.withColumn("side", F.lit("eval")).unionByName(baseline.join(F.broadcast(wanted), F.lit(True)).withColumn("side", F.lit("ref")))
    both = both.withColumn("ord", F.monotonically_increasing_id())
    parts = [
        S.semantic_shift(TS.align_class_counts(both, ["w"]), ["w"]), S.environmental_shift(both, ["w"]), S.subpopulation_shift(both, ["w"]),
        S.covariate_shift(both, ["w"], "ord", gamma=0.05, sample=500),
    ]
    checked = 0
    for part in parts:
        for r in part.collect():
            key = (float(r["w"]), r["dimension"])
            if key not in ours:
                assert r["w"] == 36000 and r["dimension"] == "covariate_shift"  # a single row
                continue
            checked += 1
            got = ours[key]
            for c in S.COMMON:
                if r["dimension"] == "covariate_shift" and c in ("metric", "confidence"):
                    assert abs(got[c] - r[c]) < 0.05, (key, c)
                else:
                    assert got[c] == r[c] or abs(got[c] - r[c]) < 2e-6, (key, c, got[c], r[c])
    assert checked >= 12


def test_drift_on_a_grid_stays_near_the_exact_figures(spark, tmp_path):
    SR.use_rocksdb(spark)
    baseline, rows = _drifting(spark)
    exact, rough = (drift.build_baseline(baseline, WATCHED, grid=g, gamma=0.05) for g in (None, 64))
    one = rows.where("sec < 14400 AND sec >= 10800")
    figures = []
    for base in (exact, rough):
        held = drift.merged(drift._sketches(drift._pick(one, WATCHED), base, 3600)).withColumn("window_start", F.to_timestamp(F.lit("2024-01-01")))
        figures.append({r["dimension"]: r for r in drift.score_windows(held, base).collect()})
        assert base is exact or held.where("part IN ('quality', 'dim', 'away')").groupBy("part", "key").count().agg(F.max("count")).first()[0] <= 3 * 64 + 126
    assert set(figures[0]) == set(figures[1]) and len(figures[0]) == 4
    for d in figures[0]:
        assert figures[0][d]["detected"] == figures[1][d]["detected"] and abs(figures[0][d]["metric"] - figures[1][d]["metric"]) < 0.03
    assert drift.report_windows(drift.score_windows(held, rough)).count() == 1
