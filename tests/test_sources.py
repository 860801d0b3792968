"""Readers, sinks and jobs on small planted datasets."""

import hashlib
import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from trustlake.operators import ingest as I
from trustlake.operators import records as R
from trustlake.plans import jobs
from trustlake.sources import adapters, jsonranges, sinks
from trustlake.sources.artifacts import scan_artifacts, scan_contents, scan_ranges
from trustlake.sources.coco import read_coco, read_coco_ranges
from trustlake.sources.files import file_digests, image_catalog
from trustlake.sources.pages import write_pages
from trustlake.sources.records import read_audit_log, read_records
from trustlake.sources.yolo import read_label_lines, read_yolo


def png(width=8, height=8, fill=7):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes([fill]) * width * 3 for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def manifest(ids, contributor=None):
    return json.dumps({
        "info": {"contributor": contributor}, "categories": [{"id": 1, "name": "tank"}, {"id": 2, "name": "apc"}],
        "images": [{"id": i, "file_name": f"im{i}.png", "width": 200, "height": 100} for i in ids],
        "annotations": [{"id": 10 + i, "image_id": i, "category_id": 1 + i % 2, "bbox": [20, 10, 80, 40], "area": 3200, "iscrowd": 0} for i in ids],
    })


def test_coco_splits_boxes_and_contributor(spark, tmp_path):
    root = tmp_path / "sets"
    for split in ("train", "valid"):
        put(root / "d1" / split / "_annotations.coco.json", manifest([1, 2], "unit-7"))
        put(root / "d1" / split / "other.json", manifest([9]))
        for i in (1, 2):
            put(root / "d1" / split / f"im{i}.png", png(fill=i))
    put(root / "d2" / "annotations" / "instances_train.json", manifest([5, 6]))
    put(root / "d2" / "images" / "im5.png", png())
    catalog = image_catalog(spark, str(root), nested=True)
    t = read_coco(spark, str(root), nested=True, files=catalog)
    images = {(r["dataset_id"], r["image_id"]): r for r in t.images.collect()}
    assert sorted(images) == [("d1", "train_1"), ("d1", "train_2"), ("d1", "valid_1"), ("d1", "valid_2"), ("d2", "5")]
    assert images["d1", "train_1"]["file_path"] == "train/im1.png" and images["d2", "5"]["file_path"] == "images/im5.png"
    box = t.annotations.where("annotation_id = 'train_11'").first()
    assert tuple(box["bbox"]) == pytest.approx((0.1, 0.1, 0.5, 0.5)) and box["class_name"] == "apc"
    assert {r["dataset_id"]: r["contributor_id"] for r in t.datasets.collect()} == {"d1": "unit-7", "d2": None}
    assert {(r["dataset_id"], r["class_id"]): r["count"] for r in t.classes.collect()} == {("d1", 1): 2, ("d1", 2): 2, ("d2", 1): 1, ("d2", 2): 1}


def _plain(tables):
    pick = lambda df, *drop: sorted(map(repr, df.drop(*drop).collect()))
    annotations = tables.annotations.withColumn("segmentation", F.from_json("segmentation", "array<array<double>>"))
    return pick(tables.images), pick(annotations, "ann_ord"), pick(tables.classes), pick(tables.datasets)


AWKWARD = {
    "info": {"contributor": "a \\\" {[ \\\\", "nested": {"images": [{"id": 77}]}}, "licenses": [{"id": 5, "url": "x"}], "notes": [[{"id": 1}], 3, "]}"],
    "categories": [{"id": 1, "name": "ta\"nk]"}, {"id": 2, "name": "a\\\\"}],
    "images": [{"id": i, "file_name": "i}{%d\\" % i + "é" * i + ".png", "width": 20, "height": 10} for i in range(9)],
    "annotations": [
        {"id": i, "image_id": i % 9, "category_id": 1 + i % 2, "bbox": [1, 2, 3, i], "segmentation": [[1, 2, 3.5]], "attributes": {"t": "\\" * i + '"' * (i % 3)}}
        for i in range(40)
    ],
}


def test_json_ranges_of_any_size(monkeypatch):
    """Lexer states composed over ranges, and elements cut from them, against a plain parse."""
    wanted = {k: [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)] for k, v in AWKWARD.items()}
    for text in (json.dumps(AWKWARD), json.dumps(AWKWARD, indent=3, ensure_ascii=False)):
        raw = text.encode()
        for piece, size in ((3, 64), (37, 7), (37, 1 << 20), (1 << 20, 7), (1 << 20, 300)):
            monkeypatch.setattr(jsonranges, "PIECE", piece)
            file, quotes, depth, ranges = io.BytesIO(raw), 0, 0, []
            for start in range(0, len(raw), size):
                told = jsonranges._transition(file, start, min(size, len(raw) - start))
                ranges.append((start, size, quotes % 2 == 1, depth))
                depth += told[3] if quotes % 2 else told[1]
                quotes += told[0]
            assert depth == 0 and quotes % 2 == 0
            members = [m for r in ranges for m in jsonranges._members(file, *r)]
            ends = [m[0] for m in members[1:]] + [len(raw)]
            found = {
                key: [json.loads(x) for r in ranges if r[0] < end and r[0] + size > begin for part in jsonranges._elements(file, *r, kind, begin, end) for _, x in part]
                for (begin, key, kind), end in zip(members, ends)
            }
            assert found == wanted


def test_manifests_by_ranges(spark, tmp_path):
    root = tmp_path / "sets"
    for split in ("train", "valid"):
        put(root / "d1" / split / "_annotations.coco.json", manifest([1, 2], "unit-7"))
    put(root / "d2" / "annotations" / "instances_train.json", json.dumps(AWKWARD))
    put(root / "d3" / "annotations.json", json.dumps(AWKWARD, indent=3, ensure_ascii=False))
    put(root / "d4" / "annotations.json", '{"images": [], "annotations": [], "categories": []}')
    put(root / "d5" / "data.json", '{"images": "none"}')
    put(root / "d6" / "data.json", '[{"images": [{"id": 1}]}]')
    wanted = _plain(read_coco(spark, str(root), nested=True))
    assert len(wanted[0]) == 22 and len(wanted[1]) == 84
    for size in (90, 1 << 20):
        found = read_coco_ranges(spark, str(root), nested=True, range_bytes=size)
        assert _plain(found) == wanted, size
        order = [r["annotation_id"] for r in found.annotations.where("dataset_id = 'd3'").orderBy("ann_ord").collect()]
        assert order == [str(i) for i in range(40)]
    put(root / "d7" / "annotations.json", json.dumps(AWKWARD)[:-1])
    assert read_coco_ranges(spark, str(root), nested=True, range_bytes=64).images.where("dataset_id = 'd7'").count() == 0


def test_one_manifest_many_tasks(spark, tmp_path):
    n = 60_000
    annotations = ",".join(f'{{"id":{i},"image_id":{i % 500},"category_id":1,"bbox":[1,2,3,4]}}' for i in range(n))
    images = ",".join(f'{{"id":{i},"file_name":"{i}.png","width":10,"height":10}}' for i in range(500))
    put(tmp_path / "m" / "annotations.json", f'{{"annotations":[{annotations}],"images":[{images}],"categories":[{{"id":1,"name":"a"}}]}}')
    found = read_coco_ranges(spark, str(tmp_path / "m"), range_bytes=100_000)
    assert found.annotations.agg(F.count("*"), F.count_distinct("annotation_id"), F.sum(F.col("annotation_id").cast("long"))).first() == (n, n, n * (n - 1) // 2)
    read = jsonranges.scan_json(spark.createDataFrame([(str(tmp_path / "m" / "annotations.json"), (tmp_path / "m" / "annotations.json").stat().st_size)], "path string, size_bytes long"), 100_000)
    dealt = read.elements("annotations").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < n
    assert read.elements("images").count() == 500


def test_yolo_pairs_boxes_and_violations(spark, tmp_path):
    root = tmp_path / "y"
    for name, text in {"a": "0 0.5 0.5 0.4 0.4\n1 0.1 0.1 0.3 0.1 0.2 0.4\n", "b": "0 0.5 0.5\nx 0.5 0.5 0.1 0.1\n\n2 0.5 0.5 0.1 0.1", "c": ""}.items():
        put(root / "images" / "train" / f"{name}.png", png())
        put(root / "labels" / "train" / f"{name}.txt", text)
    put(root / "labels" / "train" / "lost.txt", "0 0.5 0.5 0.1 0.1")
    names = spark.createDataFrame([("dataset", 0, "tank")], "dataset_id string, class_id int, class_name string")
    t = read_yolo(spark, str(root), names)
    got = {(r["image_id"], r["ann_ord"]): r for r in t.annotations.collect()}
    assert sorted(got) == [("a", 1), ("a", 2), ("b", 4)]
    assert tuple(got["a", 1]["bbox"]) == pytest.approx((0.3, 0.3, 0.7, 0.7)) and tuple(got["a", 2]["bbox"]) == pytest.approx((0.1, 0.1, 0.3, 0.4))
    assert {r["class_id"]: (r["class_name"], r["count"]) for r in t.classes.collect()} == {0: ("tank", 1), 1: ("class_1", 1), 2: ("class_2", 1)}
    lines = read_label_lines(spark, str(root))
    assert sorted(r["code"] for r in I.label_violations(lines).collect()) == ["non_integer_class", "too_few_tokens"]
    assert [r["label_path"] for r in I.orphan_labels(lines.select("dataset_id", "label_path").distinct(), t.images).collect()] == ["labels/train/lost.txt"]


def _event(n, previous, log):
    body = {
        "event_id": f"e{n}", "sequence_number": n, "timestamp": f"2024-01-01T00:00:0{n}+00:00", "event_type": "FINDING_RECORDED", "actor": "añ", "asset_id": None,
        "session_id": log, "details": {"b": [1, 2.5], "a": "x"}, "previous_event_hash": previous, "schema_version": "1.0",
    }
    digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return {**body, "event_hash": digest, "signature": None}, digest


def test_audit_log_round_trip_and_tampering(spark, tmp_path):
    events, previous = [], "0" * 64
    for n in range(5):
        event, previous = _event(n, previous, "s")
        events.append(event)
    variants = {"good": events, "edited": [dict(e, actor="evil") if i == 2 else e for i, e in enumerate(events)], "cut": events[:1] + events[2:], "swapped": [events[0], events[2], events[1], *events[3:]]}
    for name, rows in variants.items():
        put(tmp_path / "logs" / f"{name}.jsonl", "\n\n".join(json.dumps(r) for r in rows) + "\n")
    got = {r["log_id"].rsplit("/", 1)[1][:-6]: r for r in jobs.verify_audit_chain(read_audit_log(spark, str(tmp_path / "logs"))).collect()}
    assert got["good"]["is_valid"] and got["good"]["verified_events"] == 5
    assert {k: (r["failed_index"], r["reason"]) for k, r in got.items() if k != "good"} == {"edited": (2, "content"), "cut": (1, "link"), "swapped": (1, "link")}
    put(tmp_path / "bad" / "x.jsonl", "not json\n")
    with pytest.raises(Exception, match="malformed audit event"):
        read_audit_log(spark, str(tmp_path / "bad")).collect()


RECORD = {
    "session_id": "s", "producer_id": "unit", "input_image_hash": "i", "model_id": "m", "model_weight_digest": "w", "preprocessing_config_hash": "p", "inference_config": {},
    "output": {"confidence": 0.87654321}, "signing_key_id": "k", "timestamp": "2024-01-01T00:00:01Z", "schema_version": "1.0", "extra_field": 1,
}


def test_record_scenarios(spark, tmp_path):
    rows = [dict(RECORD, record_id=f"r{i}", sequence_number=s, nonce=n) for i, (s, n) in enumerate([(0, "a"), (5, "b"), (6, "c"), (2, "d"), (7, "b"), (8, "e"), (9, "f")])]
    put(tmp_path / "r" / "x.json", "\n".join(json.dumps(r) for r in rows))
    keys = spark.createDataFrame([("k", "HMAC_SECRET", "ACTIVE", bytearray(b"secret"))], "key_id string, key_type string, status string, secret binary")
    keys = keys.withColumn("valid_from", F.lit(None).cast("timestamp")).withColumn("valid_until", F.lit(None).cast("timestamp"))
    signed = R.sign_records(read_records(spark, str(tmp_path / "r")), keys)
    edited = signed.withColumn("output", F.when(F.col("record_id") == "r5", '{"confidence": 0.9}').when(F.col("record_id") == "r6", '{"confidence": 0.87654}').otherwise(F.col("output")))
    got = R.verify_records(edited, keys, F.to_timestamp(F.lit("2024-01-01 00:02:00"))).orderBy("arrival").collect()
    assert [r["status"] for r in got] == ["VERIFIED", "VERIFIED_WITH_WARNING", "VERIFIED", "REPLAYED_RECORD", "REPLAYED_RECORD", "TAMPERED_OUTPUT", "VERIFIED_WITH_WARNING"]
    assert [f["threat_id"] for f in got[1]["findings"]] == ["IT-5"] and got[3]["sequence_regression"]
    late = R.verify_records(signed, keys, F.to_timestamp(F.lit("2024-01-02 00:00:00"))).collect()
    assert all(r["status"] == "REPLAYED_RECORD" and r["stale"] for r in late)
    assert all(r["status"] == "UNVERIFIED_KEY" for r in R.verify_records(signed, keys.where("false"), F.to_timestamp(F.lit("2024-01-01 00:02:00"))).collect() if r["record_id"] != "r4")


def test_artifact_scan(spark, tmp_path):
    def archive(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in members.items():
                z.writestr(name.replace("__", "/"), body)
        return out.getvalue()

    files = {
        "ok.pt": b"weights" * 10, "evil.pt": b"..cposix\nsystem..", "odd.txt": b"x", "zip_ok.pt": archive(data__0=b"abc"),
        "zip_evil.pt": archive(archive__data_pkl=b"x", a_pkl=b"x").replace(b"zz", b"zz"), "bomb.pt": archive(big=b"\0" * (11 * 1024**2)), "broken.pt": b"PK\x03\x04rubbish",
        "deep.pt": b"w" * (17 * 1024**2) + b"cposix\nsystem", "edge.pth": archive(**{"m.pkl": b"k" * (1024**2 - 5) + b"cbuiltins\neval"}),
        "script.pth": archive(**{"run.sh": b"x"}), "climb.pth": archive(**{"..__x": b"x"}), "pickle.pth": archive(**{"m.pkl": b"cbuiltins\neval"}),
    }
    for name, body in files.items():
        put(tmp_path / "m" / name, body)
    got = {r["path"].rsplit("/", 1)[1]: r["problems"] for r in scan_artifacts(spark, str(tmp_path / "m")).collect()}
    assert {n for n, p in got.items() if not p} == {"ok.pt", "zip_ok.pt", "zip_evil.pt"}
    first = {n: p[0].split(":")[0] for n, p in got.items() if p}
    assert first == {"evil.pt": "unsafe_signature", "deep.pt": "unsafe_signature", "edge.pth": "unsafe_signature", "odd.txt": "unsupported_extension", "bomb.pt": "compression_ratio", "broken.pt": "malformed_archive",
                     "script.pth": "executable_script", "climb.pth": "path_traversal", "pickle.pth": "unsafe_signature"}
    pick = lambda rows: {r["path"]: (r["format"], r["file_hash"], r["is_archive"], r["problems"], r["is_safe"], r["size_bytes"]) for r in rows.collect()}
    # Read by ranges, with payloads at their borders, the same files give the same rows.
    for size in (1000, 1 << 20):
        ranged = scan_artifacts(spark, str(tmp_path / "m"), whole_bytes=0, range_bytes=size)
        assert pick(ranged) == pick(scan_artifacts(spark, str(tmp_path / "m")))
    body = b"w" * 995 + b"cposix\nsystem" + b"w" * 500
    put(tmp_path / "border" / "b.pt", body)
    listed = spark.createDataFrame([(f"file:{tmp_path}/border/b.pt", len(body))], "path string, size_bytes long")
    for size in (5, 100, 996, 1000):
        assert scan_ranges(listed, range_bytes=size).first()["problems"] == ["unsafe_signature: cposix\nsystem"]
    large = scan_artifacts(spark, str(tmp_path / "border"), max_bytes=100, whole_bytes=10).first()
    assert large["problems"][0] == "file_too_large" and not large["is_safe"]
    empty = spark.createDataFrame([("e.onnx", bytearray(), 0)], "path string, content binary, size_bytes long")
    assert scan_contents(empty).first()["problems"] == ["empty_file"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string"), path, ["k"], "v")
    sinks.upsert(spark.createDataFrame([(2, 2, "B"), (3, 1, "c"), (1, 0, "old")], "k int, v int, x string"), path, ["k"], "v")
    assert sorted((r["k"], r["x"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError, match="made with"):
        sinks.upsert(spark.createDataFrame([(9, 1, "z")], "k int, v int, x string"), path, ["k"], "v", parts=8)
    once = str(tmp_path / "once")
    sinks.append_immutable(spark.createDataFrame([("e1",), ("e2",)], "evidence_id string"), once, "evidence_id")
    with pytest.raises(sinks.ImmutableError):
        sinks.append_immutable(spark.createDataFrame([("e3",), ("e1",)], "evidence_id string"), once, "evidence_id")
    assert spark.read.parquet(once).count() == 2
    blobs = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    for _ in range(2):
        sinks.write_by_digest(blobs, str(tmp_path / "objects"))
    assert spark.read.parquet(str(tmp_path / "objects")).count() == 2
    evidence = spark.createDataFrame([("e1", "{}")], "evidence_id string, record_json string")
    artifacts = spark.createDataFrame([("a/b.bin", bytearray(b"z"))], "path string, content binary")
    fine = spark.createDataFrame([("a", "ok")], "path string, state string")
    with pytest.raises(sinks.TamperError):
        sinks.export_bundle(evidence, artifacts, fine.withColumn("state", F.lit("tampered")), str(tmp_path / "b0"))
    assert sinks.export_bundle(evidence, artifacts, fine, str(tmp_path / "b1")).count() == 2


def test_file_digests(spark, tmp_path):
    put(tmp_path / "f" / "a" / "x.bin", b"hello")
    row = file_digests(spark, str(tmp_path / "f"), nested=True).first()
    assert (row["dataset_id"], row["path"], row["digest"]) == ("a", "x.bin", hashlib.sha256(b"hello").hexdigest())


def test_scan_datasets_finds_planted_faults(spark):
    import random

    rng = random.Random(0)
    rows, notes = [], []
    for d in ("dirty", "clean"):
        for i in range(24):
            label = i % 2
            level = 60 if label == 0 else 180
            body = bytes(max(0, min(255, level + rng.randint(-20, 20))) for _ in range(1500))
            if d == "dirty" and i == 4:
                body = bytes(180 + rng.randint(-20, 20) for _ in range(1500))
            if d == "dirty" and i == 6:
                body = rows[-1][3] if rows[-1][0] == d else body
            if d == "dirty" and i in (8, 10, 12):
                body = body[:-256] + bytes(255 * (j % 2) for j in range(256))
            rows.append((d, f"{d}{i}", len(rows), bytearray(body)))
            notes.append((d, f"{d}{i}", 0, label))
    images = spark.createDataFrame(rows, "dataset_id string, image_id string, ord long, content binary")
    annotations = spark.createDataFrame(notes, "dataset_id string, image_id string, ann_ord long, class_id int")
    classes = annotations.select("dataset_id", "class_id").distinct()
    datasets = spark.createDataFrame([("dirty", "unit-1", None), ("clean", None, None)], "dataset_id string, contributor_id string, batch_id string")
    findings, coverage = jobs.scan_datasets(images, annotations, classes, datasets)
    got = {}
    for r in findings.collect():
        got.setdefault(r["asset_id"], {})[r["threat_id"]] = r
    assert {"DT-1", "DT-2", "DT-4", "DT-6"} <= set(got["dirty"]) and "DT-6" not in got.get("clean", {})
    assert got["dirty"]["DT-1"]["severity"] == "CRITICAL" and "DT-1" not in got.get("clean", {})
    verdicts, _, _ = jobs.assess(findings, coverage)
    assert {r["session_id"]: r["disposition"] for r in verdicts.collect()}["dirty"] == "QUARANTINE"
    owners = images.select("dataset_id", "image_id", F.when(F.col("image_id").isin("dirty5", "dirty6"), "copier").otherwise("unit-1").alias("contributor_id"),
                           F.lit(None).cast("string").alias("batch_id"))
    again, _, samples, evidence = jobs.scan_with_samples(images, annotations, classes, datasets, contributors=owners.where("dataset_id = 'dirty'"))
    known = {r["finding_id"]: r for r in again.collect()}
    plain = {k for d in got.values() for k in (r["finding_id"] for t, r in d.items() if t != "DT-6")}
    assert plain <= set(known) and {r["finding_id"] for r in evidence.collect()} == set(known)
    about = {}
    for r in samples.collect():
        about.setdefault(known[r["finding_id"]]["title"], {}).setdefault(r["dataset_id"], set()).add(r["image_id"])
    assert about["Exact Duplicate Images Detected"] == {"dirty": {"dirty5", "dirty6"}}
    assert about["Potential Backdoor Trigger Injections"] == {"dirty": {"dirty8", "dirty10", "dirty12"}}
    assert "dirty4" in about["Potential Label Inconsistencies Detected"]["dirty"]
    risk = {r["title"].split(": ")[1].split(" ")[0]: r["metrics"] for r in known.values() if r["threat_id"] == "DT-6"}
    about_copies = sum(bool({"dirty5", "dirty6"} & d.get("dirty", set())) for d in about.values())
    whole = sum(r["asset_id"] == "dirty" and r["threat_id"] != "DT-6" and r["title"] not in about for r in known.values())
    assert risk["copier"]["images"] == 2 and risk["unit-1"]["images"] == 22 and risk["copier"]["issues"] == about_copies + whole


def test_shift_and_model_jobs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for report, move in (("same", 0.0), ("moved", 1.5)):
        base = rng.normal(size=(30, 6))
        for side in ("ref", "eval"):
            for i in range(30):
                v = base[i] + (move if side == "eval" else 0.0)
                rows.append((report, side, len(rows), f"c{i % 3}", [float(x) for x in v], 0.5, 0.2, 0.1 + (0.5 if move and side == "eval" else 0.0)))
    df = spark.createDataFrame(rows, "report string, side string, ord long, class_name string, vec array<double>, luminance double, contrast double, sharpness double")
    dims, report, found = jobs.analyze_shift(df.drop("luminance", "contrast", "sharpness"), df, df, ["report"])
    assert {r["asset_id"] for r in found.collect()} == {"moved"}
    assert {r["report"]: r["shift_detected"] for r in report.collect()} == {"same": False, "moved": True} and dims.count() == 8
    weights = [(m, layer, i, float(x * (1.5 if (m, layer) == ("c", "l1") else 1.0))) for m in "cr" for layer in ("l0", "l1") for i, x in enumerate(np.linspace(-1, 1, 20))]
    top = [(m, f"p{p}", [(0, 0.9 if m == "r" else 0.1), (1, 0.1 if m == "r" else 0.9)]) for m in "cr" for p in range(6)]
    tables = {
        "weights": spark.createDataFrame(weights, "model_id string, layer string, idx long, value double"),
        "predictions": spark.createDataFrame(top, "model_id string, probe_id string, top_k array<struct<class_id:int,confidence:double>>"),
    }
    assert sorted(r["threat_id"] for r in jobs.compare_models(tables, "c", "r").collect()) == ["MT-1", "MT-2"]
    assert jobs.compare_models(tables, "r", "r").count() == 0


def test_many_model_pairs_in_one_job(spark):
    """Detection models: a copy, one with shifted boxes and one blind for class 1 under perturbation; each pair as if alone."""
    from trustlake.plans.compare import detection_behaviour

    def rows(model):
        out = []
        for p in range(12):
            boxes = []
            for i in range(4):
                x, y = 0.1 + 0.2 * i, 0.05 * (p % 4) + 0.1
                x += 0.06 if model == "shifted" else 0.0
                kind = i % 2
                if model == "blind" and p >= 6 and kind == 1:
                    continue
                boxes.append((kind, 0.9, [x, y, x + 0.15, y + 0.2]))
            out.append((model, f"p{p}", boxes if p != 5 else []))
        return out

    data = [r for m in ("base", "copy", "shifted", "blind") for r in rows(m)]
    detections = spark.createDataFrame(data, "model_id string, probe_id string, detections array<struct<class_id:int,confidence:double,bbox:array<double>>>")
    probes = spark.createDataFrame([(f"p{p}", p >= 6) for p in range(12)], "probe_id string, perturbed boolean")
    models = spark.createDataFrame([("base", "x"), ("copy", "x"), ("shifted", "y"), ("blind", "z")], "model_id string, digest string")
    scores = spark.createDataFrame([("copy", n, s) for n, s in (("a", 10.0), ("b", 11.0), ("c", 9.0), ("d", 1.0), ("e", 10.5))] + [("blind", "a", 1.0)],
                                   "model_id string, name string, score double")
    pairs = spark.createDataFrame([(m, m, "base") for m in ("copy", "shifted", "blind")], "asset_id string, candidate string, reference string")
    tables = {"detections": detections, "probes": probes, "models": models, "scores": scores}
    found = jobs.compare_model_pairs(tables, pairs).collect()
    got = {}
    for r in found:
        got.setdefault(r["asset_id"], set()).add((r["threat_id"], r["severity"]))
    assert got["copy"] == {("MT-1", "INFORMATIONAL"), ("MT-3", "HIGH")}
    assert ("MT-3", "HIGH") in got["blind"] and ("MT-3", "INFORMATIONAL") in got["blind"] and ("MT-1", "INFORMATIONAL") not in got["blind"]
    assert got["shifted"] & {("MT-1", "HIGH"), ("MT-2", "MEDIUM")} and ("MT-3", "HIGH") not in got["shifted"]
    behaviour = {r["asset_id"]: r for r in detection_behaviour(detections, pairs).collect()}
    iou = 0.09 / 0.21  # 0.15 wide boxes moved by 0.06; the probe without boxes agrees fully
    assert abs(behaviour["shifted"]["distance"] - 0.4 * (1 - (11 * iou + 1) / 12)) < 1e-5 and behaviour["copy"]["identical"]
    assert abs(behaviour["blind"]["count_drift_ratio"] - round(12 / 44, 4)) < 1e-9
    alone = jobs.compare_models(tables, "blind", "base", "blind").collect()
    assert {(r["finding_id"], r["severity"]) for r in alone} == {(r["finding_id"], r["severity"]) for r in found if r["asset_id"] == "blind"}


def test_pages_read_only_their_ranges(spark, tmp_path):
    rows = [(k % 7 if k % 50 else None, f"id{k:05d}", k) for k in range(5000)]
    df = spark.createDataFrame(rows, "s long, id string, n long").repartition(5)
    index = write_pages(df, ["s", "id"], str(tmp_path / "pages"), rows_per_range=400)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert index.total() == 5000
    for limit, offset in ((100, 0), (1000, 2950), (10, 4995), (7, 399), (5, 5000)):
        page = index.page(limit, offset)
        assert [tuple(r) for r in page.collect()] == order[offset:offset + limit]
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "(_range#" in plan or "_range#" in plan and " IN " in plan or "LocalTableScan" in plan or offset == 5000, plan
    seen, token = [], None
    while batch := index.after(token, 800).collect():
        seen += [tuple(r) for r in batch]
        token = index.token(batch[-1])
    assert seen == order
    with pytest.raises(ValueError):
        index.page(1001)
    nothing = write_pages(df.where("false"), ["id"], str(tmp_path / "none"))
    assert nothing.total() == 0


class Csv(adapters.AnnotationFormat):
    """A third format: ``image,class,x,y,w,h`` in pixels of a picture of 100 x 50."""

    suffixes = (".boxes",)

    @classmethod
    def name(cls):
        return "toy_boxes"

    def rows(self, path, content):
        for line in content.decode().splitlines():
            image, name, *coords = line.split(",")
            yield {"image": image, "class_name": name, "kind": "xywh", "coords": [float(c) for c in coords], "width": 100, "height": 50}


def test_formats_as_data_sources(spark, tmp_path):
    adapters.register(spark, Csv)
    manifest = {
        "images": [{"id": 1, "file_name": "a.png", "width": 200, "height": 100}], "categories": [{"id": 3, "name": "tank"}],
        "annotations": [{"id": 7, "image_id": 1, "category_id": 3, "bbox": [20, 10, 80, 40], "score": 0.5}, {"id": 8, "image_id": 9, "category_id": 4, "bbox": [0, 0, 1, 1]}],
    }
    put(tmp_path / "c" / "train" / "instances.json", json.dumps(manifest))
    put(tmp_path / "c" / "val" / "broken.json", "{")
    read = spark.read.format("coco").load(str(tmp_path / "c"))
    with pytest.raises(Exception, match="(?s).*JSON.*|.*Expecting.*"):
        read.collect()
    rows = adapters.boxes(read.where("split = 'train'")).orderBy("number").collect()  # the broken file is of another split and is not opened
    assert [(r["image"], r["class_name"], r["score"]) for r in rows] == [("a.png", "tank", 0.5), ("9", None, None)]
    direct = read_coco(spark, str(tmp_path / "c" / "train")).annotations.where("class_id = 3").first()
    assert tuple(rows[0]["bbox"]) == tuple(direct["bbox"]) == pytest.approx((0.1, 0.1, 0.5, 0.5))
    put(tmp_path / "y" / "labels" / "a.txt", "0 0.5 0.5 0.4 0.4\n1 0.1 0.1 0.3 0.1 0.2 0.4\nx y\n")
    found = adapters.boxes(spark.read.format("yolo").load(str(tmp_path / "y"))).orderBy("number").collect()
    assert [tuple(r["bbox"]) for r in found] == [pytest.approx((0.3, 0.3, 0.7, 0.7)), pytest.approx((0.1, 0.1, 0.3, 0.4))]
    for k in range(5):
        put(tmp_path / "t" / f"{k}.boxes", f"i{k},cat,10,10,20,20\n" * (k + 1))
    toy = spark.read.format("toy_boxes").load(str(tmp_path / "t"))
    assert toy.count() == 15 and toy.where("path = '3.boxes'").count() == 4
    assert tuple(adapters.boxes(toy).first()["bbox"]) == pytest.approx((0.1, 0.2, 0.3, 0.6))
    assert toy.where("path LIKE 'none%'").count() == 0


def test_arrival_is_file_order_whatever_task_reads_a_split(spark, tmp_path):
    """Files of very unequal size, cut in many splits that Spark packs by size."""
    wanted = []
    for name, n in (("a", 3), ("b", 900), ("c", 40), ("d", 2)):
        lines = [json.dumps({"record_id": f"{name}{k:04d}", "session_id": "s" * (k % 50)}) for k in range(n)]
        put(tmp_path / "r" / f"{name}.jsonl", "\n".join(lines) + "\n")
        wanted += [f"{name}{k:04d}" for k in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_records(spark, str(tmp_path / "r")).select("record_id", "arrival").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["record_id"] for r in sorted(rows, key=lambda r: r["arrival"])] == wanted
    assert sorted(r["arrival"] for r in rows) == list(range(len(wanted)))
