"""Ingestion queries: boxes and label lines from lineitem, images and manifests from orders, files from pages."""

from pyspark.sql import functions as F

from trustlake.catalog.base import Tables, fx, query
from trustlake.functions import geometry as G
from trustlake.functions.numeric import fixed
from trustlake.functions.text import tokens
from trustlake.operators import ingest as I
from trustlake.operators import neighbours as N

# Images are orders (dataset by customer), annotations are lines. Fixed rules plant faults.
TABLES = """img AS (SELECT o_custkey % 20 AS dataset_id, o_orderkey::VARCHAR AS image_id, 200 + o_custkey % 300 AS width, 100 + o_orderkey % 400 AS height,
  'f' || o_orderkey::VARCHAR || '.jpg' AS file_name, o_orderkey AS k FROM orders WHERE o_orderkey % 9 <> 0),
ann AS (SELECT o_custkey % 20 AS dataset_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS annotation_id, l_orderkey::VARCHAR AS image_id, l_suppkey % 30 AS class_id,
  CASE WHEN l_partkey % 50 = 0 THEN [1.0, 2.0, 3.0] ELSE [l_partkey % 200 - 10, l_suppkey % 90 - 5, l_quantity * 3 - 6, l_linenumber * 20 - 20]::DOUBLE[] END AS bbox,
  l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS ann_ord FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
cls AS (SELECT DISTINCT o_custkey % 20 AS dataset_id, o_orderkey % 25 AS class_id, 'c' || (o_orderkey % 25)::VARCHAR AS class_name FROM orders)"""


def images(t: Tables):
    c = F.col
    return t("orders").where(c("o_orderkey") % 9 != 0).select(
        (c("o_custkey") % 20).alias("dataset_id"), c("o_orderkey").cast("string").alias("image_id"), (200 + c("o_custkey") % 300).alias("width"),
        (100 + c("o_orderkey") % 400).alias("height"), F.concat(F.lit("f"), "o_orderkey", F.lit(".jpg")).alias("file_name"), c("o_orderkey").alias("k"),
    )


def annotations(t: Tables):
    c = F.col
    owner = t("orders").select(c("o_orderkey").alias("l_orderkey"), (c("o_custkey") % 20).alias("dataset_id"))
    number = c("l_partkey") * 1000000 + c("l_suppkey") * 10 + c("l_linenumber")
    parts = [c("l_partkey") % 200 - 10, c("l_suppkey") % 90 - 5, c("l_quantity") * 3 - 6, c("l_linenumber") * 20 - 20]
    box = F.when(c("l_partkey") % 50 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(F.array(*[p.cast("double") for p in parts]))
    return t("lineitem").join(owner, "l_orderkey").select(
        "dataset_id", number.alias("annotation_id"), c("l_orderkey").cast("string").alias("image_id"), (c("l_suppkey") % 30).alias("class_id"),
        box.alias("bbox"), number.alias("ann_ord"),
    )


def classes(t: Tables):
    c = F.col
    return t("orders").select(
        (c("o_custkey") % 20).alias("dataset_id"), (c("o_orderkey") % 25).alias("class_id"), F.concat(F.lit("c"), c("o_orderkey") % 25).alias("class_name")
    ).distinct()


def _corner_columns(box, digits=9):
    return [fixed(box[n], digits).alias(n) for n in ("x_min", "y_min", "x_max", "y_max")]


_CLAMP = "greatest(0.0, least(1.0, {}))"


def _box_sql(x0, y0, x1, y1):
    parts = dict(zip(("x_min", "y_min", "x_max", "y_max"), (_CLAMP.format(e) for e in (x0, y0, x1, y1))))
    ok = f"{parts['x_max']} >= {parts['x_min']} AND {parts['y_max']} >= {parts['y_min']}"
    return ", ".join(f"CASE WHEN {ok} THEN {fx(e, 9)} END AS {n}" for n, e in parts.items())


@query("box_from_xywh", f"""WITH {TABLES}, j AS (SELECT annotation_id, bbox AS b, width AS w, height AS h FROM ann JOIN img USING (dataset_id, image_id))
SELECT annotation_id, {_box_sql('b[1] / w', 'b[2] / h', '(b[1] + b[3]) / w', '(b[2] + b[4]) / h')} FROM j WHERE len(b) = 4
UNION ALL SELECT annotation_id, NULL, NULL, NULL, NULL FROM j WHERE len(b) <> 4""")
def box_from_xywh(spark, sf):
    t = Tables(spark, sf)
    rows = annotations(t).join(images(t), ["dataset_id", "image_id"])
    return rows.select("annotation_id", G.box_from_xywh(F.col("bbox"), F.col("width"), F.col("height")).alias("b")).select(
        "annotation_id", *_corner_columns(F.col("b"))
    )


_CENTRE = "(l_partkey % 100) / 100.0::DOUBLE AS cx, (l_suppkey % 100) / 100.0::DOUBLE AS cy, l_quantity / 50 AS w, abs(l_tax) * 5 - 0.05 AS h"


@query("box_from_centre", f"""WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_CENTRE} FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_box_sql('cx - w / 2', 'cy - h / 2', 'cx + w / 2', 'cy + h / 2')} FROM c""")
def box_from_centre(spark, sf):
    c = F.col
    box = G.box_from_centre((c("l_partkey") % 100) / 100.0, (c("l_suppkey") % 100) / 100.0, c("l_quantity") / 50, F.abs("l_tax") * 5 - 0.05)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return Tables(spark, sf)("lineitem").select(*keys, box.alias("b")).select(*keys, *_corner_columns(c("b")))


@query("polygon_envelope", f"""WITH v AS (SELECT vec_id, list_transform(CASE WHEN vec_id % 5 = 0 THEN list_append(embedding, 0.5::FLOAT) ELSE embedding END, lambda x: x::DOUBLE + 0.3) AS p FROM embeddings),
xy AS (SELECT vec_id, len(p) AS n, list_filter(p, lambda x, i: i % 2 = 1) AS xs, list_filter(p, lambda x, i: i % 2 = 0) AS ys FROM v)
SELECT vec_id, {', '.join(f"CASE WHEN n >= 6 AND n % 2 = 0 THEN {fx(_CLAMP.format(f'list_{m}({v}s)'), 9)} END AS {v}_{m}" for v in 'xy' for m in ('min', 'max'))} FROM xy""")
def polygon_envelope(spark, sf):
    whole = F.col("embedding").cast("array<double>")
    coords = F.transform(F.when(F.col("vec_id") % 5 == 0, F.array_append(whole, F.lit(0.5))).otherwise(whole), lambda x: x + 0.3)
    rows = Tables(spark, sf)("embeddings").select("vec_id", coords.alias("p"))
    return rows.select("vec_id", G.polygon_envelope(F.col("p")).alias("b")).select("vec_id", *_corner_columns(F.col("b")))


@query("valid_box", f"""WITH {TABLES}, n AS (SELECT annotation_id, list_transform(bbox, lambda x: x / 150) AS b FROM ann)
SELECT annotation_id, coalesce(len(b) = 4 AND list_min(b) >= 0 AND list_max(b) <= 1.05 AND b[3] >= b[1] AND b[4] >= b[2], false) AS valid FROM n""")
def valid_box(spark, sf):
    rows = annotations(Tables(spark, sf)).withColumn("b", F.transform("bbox", lambda x: x / 150))
    return rows.select("annotation_id", G.valid_box(F.col("b")).alias("valid"))


@query("coco_violations", f"""WITH {TABLES} SELECT annotation_id, unnest(list_filter([CASE WHEN len(bbox) <> 4 THEN 'malformed_bbox' END,
  CASE WHEN len(bbox) = 4 AND (bbox[3] <= 0 OR bbox[4] <= 0) THEN 'non_positive_size' END,
  CASE WHEN len(bbox) = 4 AND (bbox[1] < 0 OR bbox[2] < 0) THEN 'negative_coordinate' END], lambda x: x IS NOT NULL)) AS code FROM ann""")
def coco_violations(spark, sf):
    return I.coco_violations(annotations(Tables(spark, sf))).select("annotation_id", "code")


LINES = """lab AS (SELECT l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS line_id, o_custkey % 20 AS dataset_id, l_suppkey % 30 AS c,
  CASE l_partkey % 40 WHEN 0 THEN 'x' WHEN 1 THEN '-1' ELSE (l_suppkey % 30)::VARCHAR END || ' ' || CASE l_partkey % 40 WHEN 2 THEN '0.5 abc' WHEN 3 THEN '1.2 0.5' ELSE '0.5 0.5' END
  || CASE l_partkey % 40 WHEN 4 THEN ' 0.2' WHEN 5 THEN ' 0.2 0' WHEN 6 THEN ' 0.2  0.1 0.3 0.4' WHEN 7 THEN ' 0.2 0.1 1.3 0.4 ' ELSE ' 0.2 0.1' END AS line
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def label_lines(t: Tables):
    c = F.col
    kind = c("l_partkey") % 40
    owner = t("orders").select(c("o_orderkey").alias("l_orderkey"), (c("o_custkey") % 20).alias("dataset_id"))
    head = F.when(kind == 0, "x").when(kind == 1, "-1").otherwise((c("l_suppkey") % 30).cast("string"))
    middle = F.when(kind == 2, "0.5 abc").when(kind == 3, "1.2 0.5").otherwise("0.5 0.5")
    tail = F.when(kind == 4, " 0.2").when(kind == 5, " 0.2 0").when(kind == 6, " 0.2  0.1 0.3 0.4").when(kind == 7, " 0.2 0.1 1.3 0.4 ").otherwise(" 0.2 0.1")
    return t("lineitem").join(owner, "l_orderkey").select(
        (c("l_partkey") * 1000000 + c("l_suppkey") * 10 + c("l_linenumber")).alias("line_id"), "dataset_id", F.concat(head, F.lit(" "), middle, tail).alias("line"),
        kind.alias("kind"), (c("l_suppkey") % 30).alias("c"),
    )


@query("label_violations", f"""WITH {LINES}, k AS (SELECT line_id, c, (line_id // 1000000) % 40 AS kind FROM lab)
SELECT line_id, 'non_integer_class' AS code FROM k WHERE kind = 0 UNION ALL SELECT line_id, 'negative_class' FROM k WHERE kind = 1
UNION ALL SELECT line_id, 'non_numeric_coordinate' FROM k WHERE kind = 2 UNION ALL SELECT line_id, 'centre_out_of_range' FROM k WHERE kind = 3
UNION ALL SELECT line_id, 'too_few_tokens' FROM k WHERE kind = 4 UNION ALL SELECT line_id, 'non_positive_size' FROM k WHERE kind = 5
UNION ALL SELECT line_id, 'polygon_out_of_range' FROM k WHERE kind = 7 UNION ALL SELECT line_id, 'class_above_declared' FROM k WHERE kind NOT IN (0, 1, 4) AND c > 24""")
def label_violations(spark, sf):
    return I.label_violations(label_lines(Tables(spark, sf)), F.lit(24)).select("line_id", "code")


@query("token_split", f"WITH {LINES} SELECT line_id, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''))::INTEGER AS tokens FROM lab")
def token_split(spark, sf):
    return label_lines(Tables(spark, sf)).select("line_id", F.size(tokens(F.col("line"))).alias("tokens"))


@query("category_violations", """WITH cat AS (SELECT o_custkey % 20 AS dataset_id, CASE WHEN o_orderkey % 501 = 0 THEN NULL ELSE o_orderkey % 25 END AS class_id,
  CASE WHEN o_orderkey % 402 = 0 THEN NULL ELSE 'c' || (o_orderkey % 25)::VARCHAR || CASE WHEN o_orderkey % 603 = 0 THEN 'x' ELSE '' END END AS class_name FROM orders)
SELECT dataset_id, class_id, CASE WHEN class_id IS NULL THEN 'missing_id' ELSE 'missing_name' END AS code FROM cat WHERE class_id IS NULL OR class_name IS NULL
UNION ALL SELECT dataset_id, class_id, 'conflicting_names' FROM cat WHERE class_id IS NOT NULL GROUP BY dataset_id, class_id HAVING count(DISTINCT class_name) > 1""")
def category_violations(spark, sf):
    k = F.col("o_orderkey")
    rows = Tables(spark, sf)("orders").select(
        (F.col("o_custkey") % 20).alias("dataset_id"), F.when(k % 501 != 0, k % 25).alias("class_id"),
        F.when(k % 402 != 0, F.concat(F.lit("c"), k % 25, F.when(k % 603 == 0, "x").otherwise(""))).alias("class_name"),
    )
    return I.category_violations(rows)


@query("orphan_annotations", f"""WITH {TABLES} SELECT annotation_id, 'orphan_annotation' AS code FROM ann a WHERE NOT EXISTS (SELECT 1 FROM img i WHERE i.dataset_id = a.dataset_id AND i.image_id = a.image_id)
UNION ALL SELECT annotation_id, 'unknown_category' FROM ann a WHERE NOT EXISTS (SELECT 1 FROM cls c WHERE c.dataset_id = a.dataset_id AND c.class_id = a.class_id)""")
def orphan_annotations(spark, sf):
    t = Tables(spark, sf)
    return I.orphan_annotations(annotations(t), images(t), classes(t)).select("annotation_id", "code")


@query("unannotated_images", f"WITH {TABLES} SELECT dataset_id, image_id FROM img i WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE i.dataset_id = a.dataset_id AND i.image_id = a.image_id)")
def unannotated_images(spark, sf):
    t = Tables(spark, sf)
    return I.unannotated_images(images(t), annotations(t)).select("dataset_id", "image_id")


@query("duplicate_image_ids", "SELECT o_custkey % 20 AS dataset_id, (o_orderkey % 700)::VARCHAR AS image_id, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_image_ids(spark, sf):
    orders = Tables(spark, sf)("orders").select((F.col("o_custkey") % 20).alias("dataset_id"), (F.col("o_orderkey") % 700).cast("string").alias("image_id"))
    return I.duplicate_image_ids(orders).drop("code")


@query("primary_label", f"WITH {TABLES} SELECT dataset_id, image_id, arg_min(class_id, ann_ord) AS class_id FROM ann GROUP BY ALL")
def primary_label(spark, sf):
    return N.primary_label(annotations(Tables(spark, sf)))


@query("labelled_images", f"""WITH {TABLES}, p AS (SELECT dataset_id, image_id, arg_min(class_id, ann_ord) AS class_id FROM ann GROUP BY ALL)
SELECT dataset_id, image_id, coalesce(class_id, 0) AS class_id FROM img LEFT JOIN p USING (dataset_id, image_id)""")
def labelled_images(spark, sf):
    t = Tables(spark, sf)
    return N.labelled(images(t), N.primary_label(annotations(t)), default=0).select("dataset_id", "image_id", "class_id")


@query("class_names", f"""WITH {TABLES} SELECT annotation_id, coalesce(class_name, 'class_' || a.class_id::VARCHAR) AS class_name FROM ann a LEFT JOIN cls USING (dataset_id, class_id)""")
def class_names(spark, sf):
    t = Tables(spark, sf)
    return I.attach_class_names(annotations(t), classes(t)).select("annotation_id", "class_name")


@query("class_counts", f"""WITH {TABLES} SELECT dataset_id, coalesce(class_name, 'class_' || a.class_id::VARCHAR) AS class_name, count(*) AS n FROM ann a LEFT JOIN cls USING (dataset_id, class_id)
  WHERE dataset_id <> 3 GROUP BY ALL UNION ALL SELECT dataset_id, class_name, 5 FROM cls WHERE dataset_id = 3""")
def class_counts(spark, sf):
    t = Tables(spark, sf)
    return I.class_counts(annotations(t).where("dataset_id <> 3"), classes(t).withColumn("count", F.lit(5).cast("long")))


@query("all_classes", f"""WITH {TABLES}, u AS (SELECT dataset_id, class_id FROM cls WHERE class_id < 20 UNION SELECT dataset_id, class_id FROM ann)
SELECT dataset_id, class_id, coalesce(class_name, 'class_' || class_id::VARCHAR) AS class_name, coalesce(n, 0) AS count FROM u LEFT JOIN (SELECT * FROM cls WHERE class_id < 20) USING (dataset_id, class_id)
LEFT JOIN (SELECT dataset_id, class_id, count(*) AS n FROM ann GROUP BY ALL) USING (dataset_id, class_id)""")
def all_classes(spark, sf):
    t = Tables(spark, sf)
    return I.all_classes(classes(t).where("class_id < 20"), annotations(t))


@query("register_assets", f"""WITH {TABLES} SELECT dataset_id, count(*) AS total_images, sum(width)::BIGINT AS total_size_bytes, any_value(n) AS total_annotations, 'REGISTERED' AS status
FROM img LEFT JOIN (SELECT dataset_id, count(*) AS n FROM ann GROUP BY ALL) USING (dataset_id) GROUP BY dataset_id""")
def register_assets(spark, sf):
    t = Tables(spark, sf)
    return I.register_assets(images(t).withColumn("file_size_bytes", F.col("width")), annotations(t))


FILES = TABLES + """,
fil AS (SELECT dataset_id, CASE k % 6 WHEN 0 THEN 'train/' WHEN 1 THEN '' WHEN 2 THEN 'images/' WHEN 3 THEN 'images/val/' WHEN 4 THEN 'deep/er/' END || file_name AS path FROM img WHERE k % 6 <> 5)"""


@query("resolve_files", f"""WITH {FILES} SELECT i.dataset_id, image_id, path AS resolved_path FROM img i LEFT JOIN fil f ON f.dataset_id = i.dataset_id AND list_extract(string_split(path, '/'), -1) = file_name""")
def resolve_files(spark, sf):
    rows = images(Tables(spark, sf)).withColumn("manifest_dir", F.when(F.col("k") % 2 == 0, "train").otherwise(""))
    kind = F.col("k") % 6
    place = F.when(kind == 0, "train/").when(kind == 1, "").when(kind == 2, "images/").when(kind == 3, "images/val/").otherwise("deep/er/")
    files = rows.where(kind != 5).select("dataset_id", F.concat(place, "file_name").alias("path"))
    return I.resolve_files(rows, files).select("dataset_id", "image_id", "resolved_path")


PAIRS = """fl AS (SELECT o_custkey % 4 AS dataset_id, o_orderkey AS k, CASE o_custkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END END AS s FROM orders),
im AS (SELECT dataset_id, k, s, CASE dataset_id WHEN 0 THEN 'images/' || s || '/' WHEN 1 THEN 'images/' WHEN 2 THEN 'valid/images/' ELSE 'shots/images/train/' END || 'p' || k::VARCHAR || '.png' AS path FROM fl),
lb AS (SELECT dataset_id, k, CASE dataset_id WHEN 0 THEN 'labels/' || s || '/' WHEN 1 THEN 'labels/' WHEN 2 THEN 'valid/labels/' ELSE CASE WHEN k % 2 = 0 THEN 'shots/labels/train/' ELSE 'shots/images/train/' END END || 'p' || k::VARCHAR || '.txt' AS path FROM fl WHERE k % 5 <> 0)"""


def layout_files(t: Tables):
    k, d = F.col("o_orderkey"), F.col("o_custkey") % 4
    split = F.when(k % 2 == 0, "train").otherwise("val")
    place = F.when(d == 0, F.concat(F.lit("images/"), split, F.lit("/"))).when(d == 1, "images/").when(d == 2, "valid/images/").otherwise("shots/images/train/")
    label = (
        F.when(d == 0, F.concat(F.lit("labels/"), split, F.lit("/"))).when(d == 1, "labels/").when(d == 2, "valid/labels/")
        .otherwise(F.when(k % 2 == 0, "shots/labels/train/").otherwise("shots/images/train/"))
    )
    pics = t("orders").select(d.alias("dataset_id"), F.concat(place, F.lit("p"), k, F.lit(".png")).alias("path"))
    return pics.union(t("orders").where(k % 5 != 0).select(d.alias("dataset_id"), F.concat(label, F.lit("p"), k, F.lit(".txt")).alias("path")))


@query("pair_images_labels", f"""WITH {PAIRS} SELECT im.dataset_id, im.path AS image_path, 'p' || k::VARCHAR AS image_id,
  CASE im.dataset_id WHEN 0 THEN s WHEN 2 THEN 'valid' WHEN 3 THEN 'train' END AS split, lb.path AS label_path FROM im LEFT JOIN lb USING (dataset_id, k)""")
def pair_images_labels(spark, sf):
    return I.pair_images_labels(layout_files(Tables(spark, sf)))


@query("orphan_labels", f"WITH {PAIRS} SELECT dataset_id, path AS label_path FROM lb WHERE k % 3 = 0")
def orphan_labels(spark, sf):
    files = layout_files(Tables(spark, sf))
    pairs = I.pair_images_labels(files).where(F.regexp_extract("image_id", r"(\d+)", 1).cast("long") % 3 != 0)
    labels = files.where(F.col("path").endswith(".txt")).withColumnRenamed("path", "label_path")
    return I.orphan_labels(labels, pairs).select("dataset_id", "label_path")


@query("detect_format", """SELECT o_custkey % 12 AS dataset_id, CASE o_custkey % 12 WHEN 0 THEN 'yolo' WHEN 1 THEN 'coco' WHEN 2 THEN 'coco' WHEN 3 THEN 'coco' WHEN 4 THEN 'coco' WHEN 5 THEN 'yolo' WHEN 6 THEN 'yolo' WHEN 7 THEN 'yolo' ELSE 'unsupported' END AS format,
  CASE o_custkey % 12 WHEN 0 THEN 'yolo_yaml_configured' WHEN 1 THEN 'coco_standard' WHEN 2 THEN 'coco_split_first' WHEN 3 THEN 'coco_json' WHEN 4 THEN 'coco_root_json' WHEN 5 THEN 'yolo_split' WHEN 6 THEN 'yolo_flat' WHEN 7 THEN 'yolo_paired_txt' ELSE 'unsupported' END AS variant
FROM orders GROUP BY 1, 2, 3""")
def detect_format(spark, sf):
    d, k = F.col("o_custkey") % 12, F.col("o_orderkey").cast("string")
    named = {
        0: ["data.yaml", "annotations/instances_train.json"], 1: ["annotations/instances_val.json"], 2: ["valid/_annotations.coco.json"], 3: ["annotations/all.json"],
        4: ["all.json"], 5: ["images/train/a.png", "labels/train/a.txt"], 6: ["images/a.png", "labels/a.txt"], 7: ["x/a.png", "x/a.txt"],
    }
    marker = None
    for number, paths in named.items():
        value = F.array(*[F.lit(p) for p in paths])
        marker = F.when(d == number, value) if marker is None else marker.when(d == number, value)
    rows = Tables(spark, sf)("orders").select(d.alias("dataset_id"), F.explode(F.concat(F.array(F.concat(F.lit("misc/"), k, F.lit(".bin"))), marker.otherwise(F.array().cast("array<string>")))).alias("path"))
    flagged = rows.withColumn("is_coco_json", F.col("path").endswith(".json")).withColumn("is_label_text", F.col("path").endswith(".txt"))
    return I.detect_format(flagged)


@query("split_names", """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'train/_annotations.coco.json' WHEN 1 THEN 'annotations/instances_val.json' WHEN 2 THEN 'x/my_test_set.json' ELSE 'all.json' END AS path FROM pages),
s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' END AS split FROM p)
SELECT page_id, split, CASE WHEN split IS NOT NULL AND (page_id % 3 > 1) THEN split || '_' || page_id::VARCHAR ELSE page_id::VARCHAR END AS image_id FROM s""")
def split_names(spark, sf):
    k = F.col("page_id") % 4
    path = F.when(k == 0, "train/_annotations.coco.json").when(k == 1, "annotations/instances_val.json").when(k == 2, "x/my_test_set.json").otherwise("all.json")
    rows = Tables(spark, sf)("pages").select("page_id", I.split_of(path).alias("split"))
    return rows.withColumn("image_id", I.namespaced_id(F.col("page_id"), F.col("split"), F.col("page_id") % 3, F.lit(False)))


@query("verify_battery", """SELECT doc_id::VARCHAR AS probe_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'corrupted' ELSE 'ok' END AS state FROM documents""")
def verify_battery(spark, sf):
    d = F.col("doc_id")
    docs = Tables(spark, sf)("documents")
    probes = docs.select(d.cast("string").alias("probe_id"), F.concat(F.lit("p/"), d).alias("file_path"), F.sha2("text", 256).alias("file_hash"))
    files = docs.where(d % 7 != 0).select(F.concat(F.lit("p/"), d).alias("path"), F.sha2(F.when(d % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return I.verify_battery(probes, files).select("probe_id", "state")


@query("validation_summary", f"""WITH {TABLES}, v AS (SELECT dataset_id, 'error' AS level, 'malformed_bbox' AS code FROM ann WHERE len(bbox) <> 4
  UNION ALL SELECT dataset_id, 'error', 'non_positive_size' FROM ann WHERE len(bbox) = 4 AND (bbox[3] <= 0 OR bbox[4] <= 0)
  UNION ALL SELECT dataset_id, 'warning', 'negative_coordinate' FROM ann WHERE len(bbox) = 4 AND (bbox[1] < 0 OR bbox[2] < 0))
SELECT dataset_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (code = 'malformed_bbox') AS malformed_bbox,
  count(*) FILTER (code = 'negative_coordinate') AS negative_coordinate, count(*) FILTER (level = 'error') = 0 AS is_valid FROM v WHERE dataset_id <> 5 GROUP BY dataset_id
UNION ALL SELECT 5, 1, 0, 0, 0, false""")
def validation_summary(spark, sf):
    t = Tables(spark, sf)
    found = I.coco_violations(annotations(t)).where("dataset_id <> 5").select("dataset_id", "code", "level")
    totals = annotations(t).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_annotations"))
    verified = F.count_if(F.col("dataset_id") != 5)
    sizes = images(t).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_images"), verified.alias("verified_images")).join(totals, "dataset_id")
    return I.validation_summary(found, sizes).select("dataset_id", "errors", "warnings", "malformed_bbox", "negative_coordinate", "is_valid")


@query("check_coverage", """WITH s AS (SELECT o_custkey AS dataset_id, count(*) AS images, count(DISTINCT o_orderstatus) AS classes FROM orders GROUP BY o_custkey),
req(analysis_id, mi, mc) AS (VALUES ('DT-1', 3, 0), ('DT-2', 6, 2), ('DT-3', 10, 2), ('DT-4', 2, 0), ('DT-5', 6, 0))
SELECT dataset_id, analysis_id, CASE WHEN analysis_id = 'DT-1' OR images < mi OR classes < mc THEN 'skipped' ELSE 'executed' END AS state,
  CASE WHEN analysis_id = 'DT-1' THEN 'not_requested' WHEN images < mi OR classes < mc THEN 'insufficient' END AS reason FROM s, req""")
def check_coverage(spark, sf):
    sizes = Tables(spark, sf)("orders").groupBy(F.col("o_custkey").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("images"), F.count_distinct("o_orderstatus").alias("classes")
    )
    return I.coverage(sizes, ["DT-2", "DT-3", "DT-4", "DT-5"])
