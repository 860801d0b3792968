"""Model-comparison queries: embeddings as weights and activations, lineitem as detections, digests of orders."""

from pyspark.sql import functions as F

from trustlake.catalog.base import Tables, fx, query
from trustlake.functions.geometry import centre_size_delta, grid_cell, iou
from trustlake.functions.numeric import fixed
from trustlake.operators import digest as G
from trustlake.operators import models as M
from trustlake.operators.twosample import explode_vectors
from trustlake.plans.compare import compare_model_pairs

WEIGHTS = """w AS (SELECT CASE vec_id % 2 WHEN 0 THEN 'ref' ELSE 'cand' END AS model_id, label AS layer, vec_id,
  unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS value FROM embeddings),
stats AS (SELECT model_id, layer, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, sqrt(sum(value * value)) AS l2,
  min(value) AS lo, max(value) AS hi, count(*) FILTER (abs(value) < 1e-7) / count(*) AS sparsity FROM w GROUP BY ALL)"""


def weights(t: Tables):
    rows = t("embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("cand").alias("model_id"), F.col("label").alias("layer"), "embedding"
    )
    return explode_vectors(rows, ["vec_id", "model_id", "layer"], "embedding").withColumnRenamed("v", "value")


@query("layer_stats", f"""WITH {WEIGHTS} SELECT model_id, layer, n, {fx('mean', 9)} AS mean, {fx('std', 9)} AS std, {fx('l2', 9)} AS l2,
  {fx('lo', 9)} AS min, {fx('hi', 9)} AS max, {fx('sparsity', 9)} AS sparsity FROM stats""")
def layer_stats(spark, sf):
    rows = M.layer_stats(weights(Tables(spark, sf)))
    return rows.select("model_id", "layer", "n", *[fixed(F.col(n), 9).alias(n) for n in ("mean", "std", "l2", "min", "max", "sparsity")])


LAYERS = WEIGHTS + """,
cmp AS (SELECT r.layer, abs(c.l2 - r.l2) / (r.l2 + 1e-7) AS rel, abs(c.mean - r.mean) AS md, c.l2 IS NULL AS missing
  FROM (SELECT * FROM stats WHERE model_id = 'ref') r LEFT JOIN (SELECT * FROM stats WHERE model_id = 'cand' AND layer <> 7) c USING (layer))"""


def _compared(t: Tables):
    stats = M.layer_stats(weights(t))
    candidate = stats.where((F.col("model_id") == "cand") & (F.col("layer") != 7))
    return M.compare_layers(candidate, stats.where(F.col("model_id") == "ref"))


@query("compare_layers", f"WITH {LAYERS} SELECT layer, {fx('rel')} AS relative_l2, {fx('md', 9)} AS mean_delta, missing FROM cmp")
def compare_layers(spark, sf):
    rows = _compared(Tables(spark, sf))
    return rows.select("layer", fixed(F.col("relative_l2"), 6).alias("relative_l2"), fixed(F.col("mean_delta"), 9).alias("mean_delta"), "missing")


@query("modified_layers", f"WITH {LAYERS} SELECT layer, {fx('rel')} AS relative_l2, missing FROM cmp WHERE rel > 0.02 OR md > 0.05 OR missing")
def modified_layers(spark, sf):
    return M.modified_layers(_compared(Tables(spark, sf))).select("layer", fixed(F.col("relative_l2"), 6).alias("relative_l2"), "missing")


@query("dead_layers", f"""WITH {WEIGHTS.replace('AS value FROM', '* (vec_id % 4 // 3) AS value FROM').replace('label AS layer', 'vec_id % 4 AS layer')}
SELECT model_id, layer, n, {fx('sparsity')} AS sparsity FROM stats WHERE sparsity > 0.95 AND n > 10""")
def dead_layers(spark, sf):
    rows = weights(Tables(spark, sf)).withColumn("layer", F.col("vec_id") % 4)
    rows = rows.withColumn("value", F.when(F.col("layer") == 3, F.col("value")).otherwise(0.0))
    return M.dead_layers(M.layer_stats(rows)).select("model_id", "layer", "n", fixed(F.col("sparsity"), 6).alias("sparsity"))


ACT = """act AS (SELECT CASE vec_id // 3 % 2 WHEN 0 THEN 'ref' ELSE 'cand' END AS model_id, vec_id % 3 AS layer, vec_id // 6 AS probe_id,
  unnest(range(len(embedding))) AS neuron, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


def activations(t: Tables):
    v = F.col("vec_id")
    rows = t("embeddings").select(
        F.when(F.floor(v / 3) % 2 == 0, "ref").otherwise("cand").alias("model_id"), (v % 3).alias("layer"), F.floor(v / 6).alias("probe_id"), "embedding"
    )
    return explode_vectors(rows, ["model_id", "layer", "probe_id"], "embedding").withColumnsRenamed({"v": "value", "dim": "neuron"})


@query("dead_neurons", f"""WITH {ACT}, n AS (SELECT model_id, layer, neuron, max(value - 0.25 - neuron * 0.003) <= 0 AS dead FROM act GROUP BY ALL)
SELECT model_id, layer, count(*) AS neurons, {fx('count(*) FILTER (dead) / count(*)')} AS dead_ratio, count(*) FILTER (dead) / count(*) >= 0.3 AS flagged FROM n GROUP BY ALL""")
def dead_neurons(spark, sf):
    rows = activations(Tables(spark, sf)).withColumn("value", F.col("value") - 0.25 - F.col("neuron") * 0.003)
    found = M.dead_neurons(rows, threshold=0.3)
    return found.withColumn("dead_ratio", fixed(F.col("dead_ratio"), 6))


@query("activation_similarity", f"""WITH {ACT},
j AS (SELECT layer, probe_id, sum(a.value * b.value) AS ab, sqrt(sum(a.value * a.value)) AS na, sqrt(sum(b.value * b.value)) AS nb, count(a.value) AS ca, count(b.value) AS cb
  FROM (SELECT * FROM act WHERE model_id = 'cand') a FULL JOIN (SELECT * FROM act WHERE model_id = 'ref') b USING (layer, probe_id, neuron) GROUP BY ALL)
SELECT layer, {fx('coalesce(avg(ab / (na * nb)), 1.0)')} AS similarity, avg(ab / (na * nb)) < 0.5 AS divergent FROM j WHERE ca = cb AND ca > 0 GROUP BY layer""")
def activation_similarity(spark, sf):
    rows = activations(Tables(spark, sf))
    found = M.activation_similarity(rows.where(F.col("model_id") == "cand"), rows.where(F.col("model_id") == "ref"))
    return found.withColumn("similarity", fixed(F.col("similarity"), 6))


PROBS = """p AS (SELECT l_linestatus AS m, l_suppkey AS probe_id, l_linenumber % 4 AS class_id, round(avg(abs(l_discount) * 5), 6) AS p,
  l_suppkey % 10 AS batch FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_linenumber % 4 = 2 AND l_suppkey % 3 = 0) GROUP BY ALL)"""
ALIGNED = PROBS + """,
aligned AS (SELECT batch, probe_id, class_id, coalesce(a.p, 0.0) AS a, coalesce(b.p, 0.0) AS b FROM (SELECT * FROM p WHERE m = 'O') a
  FULL JOIN (SELECT * FROM p WHERE m = 'F') b USING (batch, probe_id, class_id))"""


def probabilities(t: Tables):
    c = F.col
    kept = t("lineitem").where(~((c("l_linestatus") == "O") & (c("l_linenumber") % 4 == 2) & (c("l_suppkey") % 3 == 0)))
    return kept.groupBy(c("l_linestatus").alias("m"), c("l_suppkey").alias("probe_id"), (c("l_linenumber") % 4).alias("class_id")).agg(
        F.round(F.avg(F.abs("l_discount") * 5), 6).alias("p")
    ).withColumn("batch", c("probe_id") % 10)


@query("align_outputs", f"WITH {ALIGNED} SELECT probe_id, class_id, {fx('a')} AS a, {fx('b')} AS b FROM aligned")
def align_outputs(spark, sf):
    rows = probabilities(Tables(spark, sf))
    found = M.align_outputs(rows.where(F.col("m") == "O"), rows.where(F.col("m") == "F"))
    return found.select("probe_id", "class_id", fixed(F.col("a"), 6).alias("a"), fixed(F.col("b"), 6).alias("b"))


@query("classification_distance", f"""WITH {ALIGNED},
d AS (SELECT batch, greatest(0.0, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))) AS d FROM aligned GROUP BY batch)
SELECT batch, {fx('d')} AS distance, d < 1e-4 AS identical, CASE WHEN d < 0.08 THEN 'VALIDATION_RESULT' WHEN d < 0.25 THEN 'MODEL_DIFFERENCE' ELSE 'SUSPICIOUS_INDICATOR' END AS assessment FROM d""")
def classification_distance(spark, sf):
    rows = probabilities(Tables(spark, sf))
    return M.classification_distance(rows.where(F.col("m") == "O"), rows.where(F.col("m") == "F"), ["batch"])


# --- detections: lines of an order are boxes on one probe ---------------------------------------------------------

BOXES = """raw AS (SELECT l_orderkey AS probe_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS det_no, (l_linenumber % 4)::INTEGER AS class_id,
  0.2 + abs(l_discount) * 8 AS confidence, (l_partkey % 60) / 100.0::DOUBLE AS x, (l_suppkey % 50) / 100.0::DOUBLE AS y, 0.1 + l_quantity / 100 AS s, abs(l_tax) AS shift, l_partkey FROM lineitem),
det AS (SELECT 'ref' AS model_id, probe_id, det_no, class_id, confidence, {'x_min': x, 'y_min': y, 'x_max': least(1.0, x + s), 'y_max': least(1.0, y + s)} AS box FROM raw WHERE confidence >= 0.25
  UNION ALL SELECT 'cand', probe_id, det_no, CASE WHEN l_partkey % 9 = 0 THEN 3 - class_id ELSE class_id END, confidence,
    {'x_min': x + shift, 'y_min': y, 'x_max': least(1.0, x + shift + s), 'y_max': least(1.0, y + s)} FROM raw WHERE confidence >= 0.25 AND l_partkey % 10 <> 0)"""
_IW = "greatest(0.0, least(a.box.x_max, b.box.x_max) - greatest(a.box.x_min, b.box.x_min))"
_IH = "greatest(0.0, least(a.box.y_max, b.box.y_max) - greatest(a.box.y_min, b.box.y_min))"
_AREA = "({0}.box.x_max - {0}.box.x_min) * ({0}.box.y_max - {0}.box.y_min)"
IOU_SQL = f"{_IW} * {_IH} / ({_AREA.format('a')} + {_AREA.format('b')} - {_IW} * {_IH})"
_DELTA = " + ".join(
    f"abs((a.box.{k}_min + a.box.{k}_max) / 2 - (b.box.{k}_min + b.box.{k}_max) / 2) + abs((a.box.{k}_max - a.box.{k}_min) - (b.box.{k}_max - b.box.{k}_min))"
    for k in "xy"
)
IOU_PAIRS = BOXES + f""",
ours AS MATERIALIZED (SELECT probe_id, det_no, box FROM det WHERE model_id = 'cand'),
theirs AS MATERIALIZED (SELECT probe_id, det_no, box FROM det WHERE model_id = 'ref'),
met AS MATERIALIZED (SELECT o.probe_id, o.det_no AS c_no, t.det_no AS r_no, {{'box': o.box}} AS a, {{'box': t.box}} AS b FROM ours o JOIN theirs t ON o.probe_id = t.probe_id),
pairs AS (SELECT probe_id, c_no, r_no, {IOU_SQL} AS iou, {_DELTA} AS delta FROM met WHERE {_IW} > 0 AND {_IH} > 0)"""


def detections(t: Tables):
    c = F.col
    x, y = (c("l_partkey") % 60) / 100.0, (c("l_suppkey") % 50) / 100.0
    s, shift = F.lit(0.1) + c("l_quantity") / 100, F.abs("l_tax")
    one = F.lit(1.0)
    box = lambda dx: F.struct((x + dx).alias("x_min"), y.alias("y_min"), F.least(one, x + dx + s).alias("x_max"), F.least(one, y + s).alias("y_max"))
    kind = (c("l_linenumber") % 4).cast("int")
    common = [c("l_orderkey").alias("probe_id"), (c("l_partkey") * 1000000 + c("l_suppkey") * 10 + c("l_linenumber")).alias("det_no")]
    confidence = (F.lit(0.2) + F.abs("l_discount") * 8).alias("confidence")
    rows = t("lineitem").where(F.lit(0.2) + F.abs("l_discount") * 8 >= 0.25)
    ref = rows.select(F.lit("ref").alias("model_id"), *common, kind.alias("class_id"), confidence, box(F.lit(0.0)).alias("box"))
    flipped = F.when(c("l_partkey") % 9 == 0, 3 - kind).otherwise(kind)
    cand = rows.where(c("l_partkey") % 10 != 0).select(F.lit("cand").alias("model_id"), *common, flipped.alias("class_id"), confidence, box(shift).alias("box"))
    return cand, ref


@query("iou_pairs", f"WITH {IOU_PAIRS} SELECT probe_id, c_no, r_no, {fx('iou', 9)} AS iou, {fx('delta', 9)} AS delta FROM pairs WHERE iou > 0")
def iou_pairs(spark, sf):
    rows = M.iou_pairs(*detections(Tables(spark, sf)))
    delta = centre_size_delta(F.col("c_box"), F.col("r_box"))
    return rows.select("probe_id", "c_no", "r_no", fixed(F.col("iou"), 9).alias("iou"), fixed(delta, 9).alias("delta"))


@query("box_functions", f"""WITH {BOXES} SELECT a.model_id, a.probe_id, a.det_no, {fx(IOU_SQL, 9)} AS iou,
  (least(3, greatest(0, floor((a.box.y_min + a.box.y_max) / 2 * 4))) * 4 + least(3, greatest(0, floor((a.box.x_min + a.box.x_max) / 2 * 4))))::INTEGER AS cell
FROM det a, (SELECT {{'x_min': 0.25::DOUBLE, 'y_min': 0.25::DOUBLE, 'x_max': 0.75::DOUBLE, 'y_max': 0.75::DOUBLE}} AS box) b""")
def box_functions(spark, sf):
    cand, ref = detections(Tables(spark, sf))
    middle = F.struct(*[F.lit(v).alias(n) for n, v in (("x_min", 0.25), ("y_min", 0.25), ("x_max", 0.75), ("y_max", 0.75))])
    return cand.unionByName(ref).select(
        "model_id", "probe_id", "det_no", fixed(iou(F.col("box"), middle), 9).alias("iou"), grid_cell(F.col("box")).alias("cell")
    )


@query("detection_signature", f"""WITH {BOXES},
cells AS (SELECT model_id, class_id, least(3, greatest(0, floor((box.y_min + box.y_max) / 2 * 4))) * 4 + least(3, greatest(0, floor((box.x_min + box.x_max) / 2 * 4))) AS cell, confidence FROM det),
cls AS (SELECT model_id, class_id, count(*) AS n, avg(confidence) AS m, stddev_pop(confidence) AS s FROM cells GROUP BY ALL),
frame AS (SELECT model_id, c AS class_id FROM (SELECT DISTINCT model_id FROM det), range(5) r(c)),
tot AS (SELECT model_id, count(*) AS total FROM det GROUP BY model_id),
f AS (SELECT frame.model_id, frame.class_id, coalesce(n, 0) AS n, coalesce(m, 0.0) AS m, coalesce(s, 0.0) AS s FROM frame LEFT JOIN cls USING (model_id, class_id)),
hits AS (SELECT model_id, class_id, cell, count(*) AS k FROM cells GROUP BY ALL)
SELECT model_id, class_id, 'count' AS part, 0 AS cell, {fx('n / total')} AS value FROM f JOIN tot USING (model_id)
UNION ALL SELECT model_id, class_id, 'conf_mean', 0, {fx('m')} FROM f UNION ALL SELECT model_id, class_id, 'conf_std', 0, {fx('s')} FROM f
UNION ALL SELECT f.model_id, f.class_id, 'spatial', g, {fx('coalesce(k, 0) / greatest(1, n)')} FROM f CROSS JOIN range(16) t(g)
  LEFT JOIN hits h ON h.model_id = f.model_id AND h.class_id = f.class_id AND h.cell = g""")
def detection_signature(spark, sf):
    cand, ref = detections(Tables(spark, sf))
    return M.detection_signature(cand.unionByName(ref), 5).withColumn("class_id", F.col("class_id").cast("long"))


@query("match_boxes")
def match_boxes(spark, sf):
    """Optimal assignment has no SQL form; brute force on small probes is in the tests."""
    rows = M.match_boxes(*detections(Tables(spark, sf)))
    return rows.withColumn("iou", fixed(F.col("iou"), 9)).withColumn("delta", fixed(F.col("delta"), 9))


@query("detection_distance")
def detection_distance(spark, sf):
    cand, ref = detections(Tables(spark, sf))
    metrics = M.match_metrics(M.match_boxes(cand, ref), cand, ref, ref.select("probe_id"))
    return M.detection_distance(metrics, M.class_counts_pair(cand, ref))


PAIRS = [("a1", "m1", "m0"), ("a2", "m2", "m0"), ("a3", "m3", "m1")]
#: A model is what shares a remainder: layers and activations from embeddings, class probabilities from lineitem.
PAIR_TABLES = f"""prs(asset, c, r) AS (VALUES {", ".join(map(str, PAIRS))}),
w AS (SELECT 'm' || (vec_id % 4)::VARCHAR AS m, label AS layer, unnest(embedding)::DOUBLE * (label + vec_id % 4 <> 3)::INTEGER AS v FROM embeddings),
st AS (SELECT m, layer, count(*) AS n, avg(v) AS mean, sqrt(sum(v * v)) AS l2, count(*) FILTER (abs(v) < 1e-7) / count(*) AS sparsity FROM w GROUP BY ALL),
lay AS (SELECT asset, abs(c.l2 - r.l2) / (r.l2 + 1e-7) AS rel, c.l2 IS NULL AS gone, abs(c.mean - r.mean) AS md
  FROM prs JOIN st r ON r.m = prs.r LEFT JOIN st c ON c.m = prs.c AND c.layer = r.layer),
act AS (SELECT 'm' || (vec_id % 4)::VARCHAR AS m, label AS layer, vec_id // 4 AS probe, unnest(range(len(embedding))) AS neuron, unnest(embedding)::DOUBLE - 0.2 AS v FROM embeddings),
dn AS (SELECT m, layer, count(*) FILTER (top <= 0) / count(*) AS ratio FROM (SELECT m, layer, neuron, max(v) AS top FROM act GROUP BY ALL) GROUP BY ALL),
cs AS (SELECT asset, a.layer, a.probe, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS s
  FROM prs JOIN act a ON a.m = prs.c JOIN act b ON b.m = prs.r AND b.layer = a.layer AND b.probe = a.probe AND b.neuron = a.neuron GROUP BY ALL),
sim AS (SELECT asset, layer, avg(s) AS s FROM cs GROUP BY ALL),
p AS (SELECT 'm' || (l_linenumber % 4)::VARCHAR AS m, l_suppkey AS probe, l_partkey % 3 AS class_id, {fx('avg(abs(l_discount) * 5 + l_linenumber % 4 // 2 * (l_partkey % 3))')} AS p FROM lineitem GROUP BY ALL),
al AS (SELECT coalesce(x.asset, y.asset) AS asset, coalesce(x.p, 0.0) AS a, coalesce(y.p, 0.0) AS b FROM (SELECT asset, probe, class_id, p FROM prs JOIN p ON p.m = prs.c) x
  FULL JOIN (SELECT asset, probe, class_id, p FROM prs JOIN p ON p.m = prs.r) y ON x.asset = y.asset AND x.probe = y.probe AND x.class_id = y.class_id),
bd AS (SELECT asset, {fx('greatest(0.0, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))))')} AS d FROM al GROUP BY asset),
fnd AS (SELECT asset, 'MT-1' AS t, 'Potential Model Substitution' AS title, least(0.95, 0.7 + (d - 0.25) * 0.5) AS conf, NULL AS n, d AS x FROM bd WHERE d >= 0.25
  UNION ALL SELECT asset, 'MT-2', 'Behavioral Drift Detected', 0.75, NULL, d FROM bd WHERE d >= 0.08 AND d < 0.25
  UNION ALL SELECT asset, 'MT-2', 'Model Parameter Modification Detected', least(0.9, 0.65 + coalesce(max(rel), 0)), count(*), coalesce(max(rel), 0) FROM lay WHERE rel > 0.02 OR md > 0.05 OR gone GROUP BY asset
  UNION ALL SELECT asset, 'MT-2', 'Anomalous Parameter Sparsity Observed', 0.6, count(*), max(sparsity) FROM prs JOIN st ON st.m = prs.c WHERE sparsity > 0.95 AND n > 10 GROUP BY asset
  UNION ALL SELECT asset, 'MT-4', 'Elevated Dead Neuron Ratio', 0.8, count(*), max(ratio) FROM prs JOIN dn ON dn.m = prs.c WHERE ratio >= 0.75 GROUP BY asset
  UNION ALL SELECT asset, 'MT-4', 'Intermediate Representation Divergence', 0.85, count(*), min(s) FROM sim WHERE s < 0.5 GROUP BY asset)"""


def model_tables(t: Tables):
    e, model = t("embeddings"), F.concat(F.lit("m"), (F.col("vec_id") % 4).cast("string")).alias("model_id")
    keys = ["model_id", "layer", "probe_id", "keep"]
    rows = explode_vectors(e.select(
        model, F.col("label").alias("layer"), F.floor(F.col("vec_id") / 4).alias("probe_id"), (F.col("label") + F.col("vec_id") % 4 != 3).alias("keep"), "embedding"
    ), keys, "embedding")
    number = F.col("l_linenumber") % 4
    confidence = F.avg(F.abs("l_discount") * 5 + F.floor(number / 2) * (F.col("l_partkey") % 3))
    top = t("lineitem").groupBy(
        F.concat(F.lit("m"), number.cast("string")).alias("model_id"), F.col("l_suppkey").alias("probe_id"), (F.col("l_partkey") % 3).cast("int").alias("class_id")
    ).agg(confidence.alias("confidence"))
    return {
        "weights": rows.select("model_id", "layer", F.when(F.col("keep"), F.col("v")).otherwise(0.0).alias("value")),
        "activations": rows.select("model_id", "layer", "probe_id", F.col("dim").alias("neuron"), (F.col("v") - 0.2).alias("value")),
        "predictions": top.groupBy("model_id", "probe_id").agg(F.collect_list(F.struct("class_id", "confidence")).alias("top_k")),
    }


@query("compare_model_pairs", f"""WITH {PAIR_TABLES}
SELECT asset AS asset_id, t AS threat_id, title, {fx('conf')} AS confidence, n::DOUBLE AS layers, {fx('x')} AS value FROM fnd""")
def compare_pairs(spark, sf):
    """Three model pairs in one job: behaviour, weights, dead layers and neurons, activations."""
    pairs = spark.createDataFrame(PAIRS, "asset_id string, candidate string, reference string")
    found = compare_model_pairs(model_tables(Tables(spark, sf)), pairs)
    value = F.coalesce(*[F.col("metrics")[n] for n in ("distance", "max_l2", "max_sparsity", "max_ratio", "min_similarity")])
    return found.select("asset_id", "threat_id", "title", fixed(F.col("confidence"), 6).alias("confidence"), F.col("metrics")["layers"].alias("layers"), fixed(value, 6).alias("value"))


COUNTS = """counts AS (SELECT l_linenumber AS model_id, l_suppkey % 25 AS class_id, count(*) FILTER (l_returnflag = 'A') AS c_ref,
  count(*) FILTER (l_returnflag = 'R' AND (l_suppkey % 25 <> l_linenumber OR l_quantity < 5)) AS c_cand FROM lineitem GROUP BY ALL)"""


def drop_counts(t: Tables):
    c = F.col
    kind = c("l_suppkey") % 25
    kept = (c("l_returnflag") == "R") & ((kind != c("l_linenumber")) | (c("l_quantity") < 5))
    return t("lineitem").groupBy(c("l_linenumber").alias("model_id"), kind.alias("class_id")).agg(
        F.count_if(c("l_returnflag") == "A").alias("c_ref"), F.count_if(kept).alias("c_cand")
    )


def _drop_sql(expected: str, peer: str) -> str:
    return f"""WITH {COUNTS}, e AS (SELECT *, {expected} AS e FROM counts WHERE c_ref >= 2),
d AS (SELECT *, (e - c_cand) / e AS drop_, (e - c_cand) / {peer} AS peer FROM e),
o AS (SELECT *, (sum(peer) OVER w - peer) / (count(*) OVER w - 1) AS other_ FROM d WINDOW w AS (PARTITION BY model_id))
SELECT model_id, class_id, c_ref, c_cand, {fx('drop_')} AS drop, {fx('other_')} AS other_drop FROM o WHERE drop_ > 0.75 AND other_ < 0.25
QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY class_id) = 1"""


def _drops(rows):
    return rows.withColumn("drop", fixed(F.col("drop"), 6)).withColumn("other_drop", fixed(F.col("other_drop"), 6))


@query("selective_drop", _drop_sql("c_ref::DOUBLE", "e"))
def selective_drop(spark, sf):
    return _drops(M.selective_drop(drop_counts(Tables(spark, sf)), ["model_id"]))


@query("perturbed_drop", _drop_sql("c_ref * (11 / 10)", "greatest(1.0, e)"))
def perturbed_drop(spark, sf):
    """Clean against perturbed probes: counts scaled to the number of probes."""
    return _drops(M.selective_drop(drop_counts(Tables(spark, sf)), ["model_id"], scale=F.lit(1.1)))


@query("mad_outlier", f"""WITH s AS (SELECT l_linenumber AS grp, l_suppkey AS name, round(avg(l_extendedprice) / 1000, 6) AS score FROM lineitem GROUP BY ALL),
m AS (SELECT grp, count(*) AS n, median(score) AS med, min(score) AS lo, arg_min(name, score) AS suspect FROM s GROUP BY grp),
a AS (SELECT s.grp, median(abs(score - med)) AS mad FROM s JOIN m USING (grp) GROUP BY s.grp)
SELECT grp, n, 'SUCCESS' AS status, {fx('med', 4)} AS median, {fx('mad', 4)} AS mad, {fx('(med - lo) / (1.4826 * mad)', 2)} AS anomaly_index, suspect,
  {fx('(med - lo) / (1.4826 * mad)', 2)} >= 2.0 AS flagged FROM m JOIN a USING (grp)""")
def mad_outlier(spark, sf):
    scores = Tables(spark, sf)("lineitem").groupBy(F.col("l_linenumber").alias("grp"), F.col("l_suppkey").alias("name")).agg(
        F.round(F.avg("l_extendedprice") / 1000, 6).alias("score")
    )
    return M.mad_outlier(scores, ["grp"])


# --- digests --------------------------------------------------------------------------------------------------------

def merkle_sql(row: str, table: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    level = lambda src, n: f"""SELECT {key}{f"d[1:{n}]" if n else "''"} AS d, sha256(string_agg(d || ':' || x, ',' ORDER BY d || ':' || x)) AS x FROM {src} GROUP BY ALL"""
    return f"""WITH leaves AS (SELECT {key}sha256({row}) AS d, count(*)::VARCHAR AS x FROM {table} GROUP BY ALL),
l6 AS ({level('leaves', 6)}), l3 AS ({level('l6', 3)}), l0 AS ({level('l3', 0)})
SELECT {key}x AS digest FROM l0"""


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_ROW = " || ',' || ".join(f"length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR" for c in ORDER_COLUMNS)


@query("table_digest", merkle_sql(_ROW, "orders"))
def table_digest(spark, sf):
    return G.table_digest(Tables(spark, sf)("orders"), ORDER_COLUMNS)


@query("group_digest", merkle_sql(_ROW, "orders", "o_orderstatus"))
def group_digest(spark, sf):
    return G.group_digest(Tables(spark, sf)("orders"), ["o_orderstatus"], ORDER_COLUMNS)
