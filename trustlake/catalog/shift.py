"""Two-sample and shift queries: even vectors against odd ones, early documents against late ones."""

from pyspark.sql import functions as F

from trustlake.catalog.base import Tables, fx, query
from trustlake.functions.binary import quality_scalars
from trustlake.functions.numeric import fixed
from trustlake.functions.risk import calibrated_confidence
from trustlake.operators import shift as S
from trustlake.operators import twosample as TS

LINE_SAMPLES = """samples AS (SELECT l_returnflag AS grp, CASE l_linestatus WHEN 'F' THEN 'ref' ELSE 'eval' END AS side,
  l_extendedprice AS v FROM lineitem)"""
VECTOR_SAMPLES = """vectors AS (SELECT vec_id, CASE vec_id % 2 WHEN 0 THEN 'ref' ELSE 'eval' END AS side, label,
  list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
samples AS (SELECT 'e' AS report, vec_id, side, label, unnest(range(len(vec)))::INTEGER AS grp, unnest(vec) AS v FROM vectors)"""


def ecdf_sql(keys: str = "grp") -> str:
    return f"""support AS (SELECT {keys}, v, count(*) FILTER (side = 'ref') AS c_ref, count(*) FILTER (side = 'eval') AS c_eval
  FROM samples GROUP BY ALL),
ecdf AS (SELECT {keys}, v, lead(v) OVER w AS next_v,
  sum(c_ref) OVER (PARTITION BY {keys}) AS n_ref, sum(c_eval) OVER (PARTITION BY {keys}) AS n_eval,
  sum(c_ref) OVER w / sum(c_ref) OVER (PARTITION BY {keys}) AS f_ref,
  sum(c_eval) OVER w / sum(c_eval) OVER (PARTITION BY {keys}) AS f_eval
  FROM support WINDOW w AS (PARTITION BY {keys} ORDER BY v)),
d AS (SELECT {keys}, max(n_ref)::DOUBLE AS n, max(n_eval)::DOUBLE AS m, max(abs(f_ref - f_eval)) AS d,
  sum(abs(f_ref - f_eval) * (next_v - v)) AS w FROM ecdf GROUP BY ALL),
lam AS (SELECT *, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * d AS lambda_ FROM d),
scored AS (SELECT {keys}, n::BIGINT AS n_ref, m::BIGINT AS n_eval, {fx('d')} AS ks,
  {fx('''CASE WHEN d <= 0 THEN 1.0 WHEN lambda_ > 4 THEN 0.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(
     range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * pow(k * lambda_, 2)))))) END''')} AS p_value,
  {fx('w', 8)} AS w1 FROM lam)"""


def line_samples(t: Tables):
    side = F.when(F.col("l_linestatus") == "F", "ref").otherwise("eval")
    return t("lineitem").select(F.col("l_returnflag").alias("grp"), side.alias("side"), F.col("l_extendedprice").alias("v"))


def vectors(t: Tables):
    return t("embeddings").select(
        F.lit("e").alias("report"), "vec_id", F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("eval").alias("side"),
        F.col("label").cast("string").alias("class_name"), F.col("embedding").cast("array<double>").alias("vec"),
    )


def vector_samples(t: Tables):
    return TS.explode_vectors(vectors(t), ["report", "side"])


@query("ecdf_two_sample", f"""WITH {LINE_SAMPLES}, {ecdf_sql()}
SELECT grp, v, next_v, n_ref::BIGINT AS n_ref, n_eval::BIGINT AS n_eval, {fx('f_ref', 9)} AS f_ref, {fx('f_eval', 9)} AS f_eval FROM ecdf""")
def ecdf_two_sample(spark, sf):
    rows = TS.ecdf(line_samples(Tables(spark, sf)), ["grp"])
    return rows.withColumn("f_ref", fixed(F.col("f_ref"), 9)).withColumn("f_eval", fixed(F.col("f_eval"), 9))


@query("ks_two_sample", f"WITH {LINE_SAMPLES}, {ecdf_sql()} SELECT grp, n_ref, n_eval, ks, p_value FROM scored")
def ks_two_sample(spark, sf):
    return TS.ks_two_sample(line_samples(Tables(spark, sf)), ["grp"])


@query("wasserstein_1d", f"""WITH {LINE_SAMPLES}, {ecdf_sql()}
SELECT grp, n_ref, n_eval, floor(w * 10000 + 0.5000001::DOUBLE) / 10000 AS w1 FROM lam JOIN scored USING (grp)""")
def wasserstein_1d(spark, sf):
    # Prices reach 1e5, so eight digits would compare summation order; four are exact.
    return TS.wasserstein_1d(line_samples(Tables(spark, sf)), ["grp"]).withColumn("w1", fixed(F.col("w1"), 4))


@query("dimension_statistics", f"WITH {VECTOR_SAMPLES}, {ecdf_sql()} SELECT grp AS dim, n_ref, n_eval, ks, p_value, w1 FROM scored")
def dimension_statistics(spark, sf):
    return TS.per_dimension(vector_samples(Tables(spark, sf)), ["report"]).drop("report")


TOP_DIMS = """variances AS (SELECT grp, var_samp(v) AS variance FROM samples WHERE side = 'ref' GROUP BY grp),
top_dims AS (SELECT grp, variance FROM variances ORDER BY variance DESC, grp DESC LIMIT 16)"""


@query("top_variance_dims", f"WITH {VECTOR_SAMPLES}, {TOP_DIMS} SELECT grp AS dim, {fx('variance', 9)} AS variance FROM top_dims")
def top_variance_dims(spark, sf):
    rows = TS.top_variance_dims(vector_samples(Tables(spark, sf)), ["report"])
    return rows.select("dim", fixed(F.col("variance"), 9).alias("variance"))


@query("mean_wasserstein", f"""WITH {VECTOR_SAMPLES}, {ecdf_sql()}
SELECT {fx('avg(w1)')} AS mean_w1 FROM scored""")
def mean_wasserstein(spark, sf):
    return TS.mean_wasserstein(vector_samples(Tables(spark, sf)), ["report"]).drop("report")


@query("ks_rejection", f"""WITH {VECTOR_SAMPLES}, {ecdf_sql()}
SELECT {fx('count(*) FILTER (p_value < 0.05) / count(*)', 4)} AS ks_rejection_ratio, {fx('median(p_value)', 4)} AS median_p
FROM scored""")
def ks_rejection(spark, sf):
    return TS.ks_rejection(vector_samples(Tables(spark, sf)), ["report"]).drop("report")


@query("systematic_sample", """WITH ranked AS (
  SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS r,
         count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
strided AS (SELECT *, CASE WHEN n > 500 THEN n // 500 ELSE 1 END AS stride FROM ranked)
SELECT o_orderstatus, o_orderkey, r // stride AS sample_pos FROM strided WHERE r % stride = 0 AND r // stride < 500""")
def systematic_sample(spark, sf):
    rows = Tables(spark, sf)("orders").select("o_orderstatus", "o_orderkey")
    return TS.systematic_sample(rows, ["o_orderstatus"], "o_orderkey")


MMD_SQL = f"""ranked AS (SELECT side, vec, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY side) AS n, lag(vec) OVER w AS before
  FROM vectors WINDOW w AS (PARTITION BY side ORDER BY vec_id)),
most AS (SELECT max(n) AS most FROM ranked),
xs AS (SELECT vec AS x, unnest(range(r, most, n)) AS i FROM ranked, most WHERE side = 'ref'),
ys AS (SELECT vec AS y, unnest(range((r - 1 + n) % n, most, n)) AS i FROM ranked, most WHERE side = 'eval'),
pairs AS (SELECT side AS kind, pow(list_distance(vec, before), 2) AS dd FROM ranked WHERE before IS NOT NULL
  UNION ALL SELECT 'cross', pow(list_distance(x, y), 2) FROM xs JOIN ys USING (i)),
gam AS (SELECT 1.0 / (2.0 * greatest(1e-6, median(dd))) AS g FROM pairs WHERE kind = 'cross' AND dd > 1e-8),
parts AS (SELECT avg(exp(-g * dd)) FILTER (kind = 'ref') AS xx, avg(exp(-g * dd)) FILTER (kind = 'eval') AS yy,
  avg(exp(-g * dd)) FILTER (kind = 'cross') AS xy FROM pairs, gam),
mmd AS (SELECT {fx('sqrt(greatest(0.0, xx + yy - 2 * xy))')} AS mmd FROM parts)"""


@query("mmd_rbf", f"""WITH {VECTOR_SAMPLES}, {MMD_SQL}
SELECT (SELECT count(*) FROM vectors WHERE side = 'ref') AS n_ref, (SELECT count(*) FROM vectors WHERE side = 'eval') AS n_eval, mmd FROM mmd""")
def mmd_rbf(spark, sf):
    return TS.mmd_rbf(vectors(Tables(spark, sf)), ["report"], "vec_id").drop("report")


LANG_COUNTS = """counts AS (SELECT source, lang, count(*) FILTER (doc_id // 20 % 2 = 0) AS n_ref, count(*) FILTER (doc_id // 20 % 2 = 1) AS n_eval
  FROM documents GROUP BY ALL)"""
TV_SQL = LANG_COUNTS + f""",
shares AS (SELECT *, n_ref / nullif(sum(n_ref) OVER (PARTITION BY source), 0) AS p, n_eval / nullif(sum(n_eval) OVER (PARTITION BY source), 0) AS q FROM counts),
tv AS (SELECT source, sum(n_ref)::BIGINT AS total_ref, sum(n_eval)::BIGINT AS total_eval,
  CASE WHEN sum(n_ref) = 0 OR sum(n_eval) = 0 THEN 1.0 ELSE {fx('greatest(0.0, least(1.0, 0.5 * sum(abs(p - q))))')} END AS tv,
  count(*) FILTER (n_ref > 0 AND n_eval = 0) AS missing_classes, count(*) FILTER (n_ref = 0 AND n_eval > 0) AS new_classes
  FROM shares GROUP BY source)"""


def lang_counts(t: Tables):
    rows = t("documents").select("source", "lang", F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, "ref").otherwise("eval").alias("side"))
    return TS.align_class_counts(rows, ["source"], "lang")


@query("class_count_alignment", f"WITH {LANG_COUNTS} SELECT * FROM counts")
def class_count_alignment(spark, sf):
    return lang_counts(Tables(spark, sf))


@query("total_variation", f"WITH {TV_SQL} SELECT * FROM tv")
def total_variation(spark, sf):
    return TS.total_variation(lang_counts(Tables(spark, sf)), ["source"])


@query("class_shares", f"""WITH {TV_SQL} SELECT source, lang, {fx('coalesce(p, 0.0)', 4)} AS ref_share, {fx('coalesce(q, 0.0)', 4)} AS eval_share,
  CASE WHEN n_ref > 0 AND n_eval > 0 THEN 'common' WHEN n_ref > 0 THEN 'missing' ELSE 'new' END AS state FROM shares""")
def class_shares(spark, sf):
    return TS.class_shares(lang_counts(Tables(spark, sf)), ["source"], "lang")


SETS = """ref AS (SELECT DISTINCT lang, source FROM documents WHERE doc_id // 20 % 2 = 0), ev AS (SELECT DISTINCT lang, source FROM documents WHERE doc_id // 20 % 2 = 1)"""


def _class_sets(t: Tables):
    docs = t("documents").select("doc_id", "lang", "source")
    return (docs.where(F.floor(F.col("doc_id") / 20) % 2 == p).select("lang", "source").distinct() for p in (0, 1))


@query("common_classes", f"WITH {SETS} SELECT * FROM ref INTERSECT SELECT * FROM ev")
def common_classes(spark, sf):
    return TS.common_classes(*_class_sets(Tables(spark, sf)))


@query("class_diff", f"""WITH {SETS} SELECT *, 'missing' AS state FROM (SELECT * FROM ref EXCEPT SELECT * FROM ev)
UNION ALL SELECT *, 'new' FROM (SELECT * FROM ev EXCEPT SELECT * FROM ref)""")
def class_diff(spark, sf):
    return TS.class_diff(*_class_sets(Tables(spark, sf)))


COVARIATE_SQL = f"""{VECTOR_SAMPLES}, {ecdf_sql()}, {MMD_SQL},
cov AS (SELECT mmd, (SELECT {fx('avg(w1)')} FROM scored) AS mean_w1,
  (SELECT {fx('count(*) FILTER (p_value < 0.05) / count(*)', 4)} FROM scored) AS ks_rejection_ratio,
  (SELECT {fx('median(p_value)', 4)} FROM scored) AS p_value FROM mmd),
covariate AS (SELECT *, {fx('0.6 * mmd + 0.4 * mean_w1')} AS metric FROM cov)"""
COVARIATE_ROW = """SELECT 'covariate_shift' AS dimension, metric > 0.15 OR (mean_w1 > 0.2 AND ks_rejection_ratio > 0.5) AS detected,
  metric, p_value FROM covariate"""


@query("covariate_shift", f"""WITH {COVARIATE_SQL}
SELECT c.*, mmd, mean_w1, ks_rejection_ratio FROM ({COVARIATE_ROW}) c, covariate""")
def covariate_shift(spark, sf):
    rows = S.covariate_shift(vectors(Tables(spark, sf)), ["report"], "vec_id")
    return rows.select("dimension", "detected", "metric", "p_value", "mmd", "mean_w1", "ks_rejection_ratio")


@query("semantic_shift", f"""WITH {TV_SQL}
SELECT source, 'semantic_shift' AS dimension, tv > 0.25 OR missing_classes > 0 AS detected, tv AS metric,
  {fx('greatest(0.0, 1 - tv)', 4)} AS p_value, CASE WHEN tv > 0.5 OR missing_classes > 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  {fx('''CASE WHEN total_ref >= 15 AND total_eval >= 15 THEN least(0.95, greatest(0.6, 0.5 + tv * 0.45)) ELSE least(0.4, 0.2 + tv * 0.3) END''')} AS confidence
FROM tv""")
def semantic_shift(spark, sf):
    rows = S.semantic_shift(lang_counts(Tables(spark, sf)), ["source"])
    return rows.select("source", "dimension", "detected", "metric", "p_value", "severity",
                       fixed(F.col("confidence"), 6).alias("confidence"))


DISPLACED_SQL = """means AS (SELECT label, grp, avg(v) FILTER (side = 'ref') AS r, avg(v) FILTER (side = 'eval') AS e FROM samples GROUP BY ALL),
displaced AS (SELECT label::VARCHAR AS class_name, sqrt(sum(pow(r - e, 2))) AS displacement FROM means GROUP BY label
  HAVING sum(pow(r - e, 2)) IS NOT NULL)"""
SUBPOP_SQL = f"""{DISPLACED_SQL},
moved AS (SELECT count(*) AS classes, avg(displacement) AS mean_shift, max(displacement) AS max_shift,
  max(displacement) / greatest(1e-6, avg(displacement)) AS concentration FROM displaced),
subpop AS (SELECT *, {fx('greatest(0.0, least(1.0, (concentration - 1) * 0.4 + max_shift * 0.6))')} AS metric FROM moved)"""
SUBPOP_ROW = f"""SELECT 'adversarial_manipulation' AS dimension,
  metric > 0.25 AND (max_shift > 0.1 OR concentration >= 1.8) AS detected, metric, {fx('greatest(0.0, 1 - metric)', 4)} AS p_value FROM subpop"""


@query("class_displacement", f"WITH {VECTOR_SAMPLES}, {DISPLACED_SQL} SELECT class_name, {fx('displacement', 9)} AS displacement FROM displaced")
def class_displacement(spark, sf):
    rows = S.class_displacement(vectors(Tables(spark, sf)), ["report"])
    return rows.select("class_name", fixed(F.col("displacement"), 9).alias("displacement"))


@query("targeted_classes", f"""WITH {VECTOR_SAMPLES.replace("label, unnest", "label::VARCHAR || '-' || (vec_id // 2 % 3)::VARCHAR AS label, unnest")}, {DISPLACED_SQL}
SELECT class_name, {fx('displacement', 9)} AS displacement FROM displaced
WHERE displacement > (SELECT avg(displacement) + 1.5 * stddev_samp(displacement) FROM displaced)""")
def targeted_classes(spark, sf):
    fine = F.concat_ws("-", "class_name", F.floor(F.col("vec_id") / 2) % 3)
    moved = S.class_displacement(vectors(Tables(spark, sf)).withColumn("class_name", fine), ["report"])
    return S.targeted_classes(moved, ["report"]).select("class_name", fixed(F.col("displacement"), 9).alias("displacement"))


@query("subpopulation_shift", f"""WITH {VECTOR_SAMPLES}, {SUBPOP_SQL}
SELECT r.*, classes, {fx('mean_shift')} AS mean_shift, {fx('max_shift')} AS max_shift, {fx('concentration')} AS concentration
FROM ({SUBPOP_ROW}) r, subpop""")
def subpopulation_shift(spark, sf):
    rows = S.subpopulation_shift(vectors(Tables(spark, sf)), ["report"])
    return rows.select("dimension", "detected", "metric", "p_value", F.col("classes").cast("long").alias("classes"),
                       *[fixed(F.col(n), 6).alias(n) for n in ("mean_shift", "max_shift", "concentration")])


@query("spread_shift", f"""WITH {VECTOR_SAMPLES},
means AS (SELECT grp, avg(v) FILTER (side = 'ref') AS r, avg(v) FILTER (side = 'eval') AS e FROM samples GROUP BY grp),
centre AS (SELECT sqrt(sum(pow(r - e, 2))) AS gshift, list(r ORDER BY grp) AS c FROM means),
away AS (SELECT list_distance(vec, c) AS a FROM vectors, centre WHERE side = 'eval'),
picked AS (SELECT median(a) AS q50, list_sort(list(a))[floor(0.9 * count(*))::BIGINT + 1] AS q90 FROM away)
SELECT {fx('gshift')} AS mean_shift, {fx('greatest(0.0, least(1.0, (q90 / greatest(1e-6, q50) - 1.2) * 0.3 + gshift * 0.5))')} AS metric
FROM picked, centre""")
def spread_shift(spark, sf):
    rows = S.spread_shift(vectors(Tables(spark, sf)), ["report"])
    return rows.select(fixed(F.col("mean_shift"), 6).alias("mean_shift"), "metric")


@query("confidence_calibration", f"""WITH {TV_SQL} SELECT source, total_ref >= 15 AND total_eval >= 15 AS sufficient,
  {fx('''CASE WHEN total_ref >= 15 AND total_eval >= 15 THEN least(0.95, greatest(0.65, 0.55 + tv * 0.4)) ELSE least(0.4, 0.2 + tv * 0.25) END''')} AS confidence FROM tv""")
def confidence_calibration(spark, sf):
    tv = TS.total_variation(lang_counts(Tables(spark, sf)), ["source"])
    enough = (F.col("total_ref") >= 15) & (F.col("total_eval") >= 15)
    score = calibrated_confidence(F.col("tv"), enough, 0.65, 0.55, 0.40, 0.25)
    return tv.select("source", enough.alias("sufficient"), fixed(score, 6).alias("confidence"))


QUALITY_SAMPLES = f"""raw AS (SELECT page_id, strlen(html) AS n, list_transform(regexp_extract_all(hex(encode(html)), '..'), lambda x: ('0x' || x)::INTEGER) AS bs FROM pages),
figures AS (SELECT page_id, coalesce(list_avg(bs), 0) / 255 AS luminance, coalesce(list_stddev_pop(bs), 0) / 255 AS contrast,
  coalesce(list_avg(list_transform(range(1, n), lambda i: abs(bs[i + 1] - bs[i]))), 0) / 255 AS sharpness FROM raw),
long AS (UNPIVOT figures ON luminance, contrast, sharpness INTO NAME metric_name VALUE v),
samples AS (SELECT page_id % 5 AS grp, metric_name, CASE WHEN page_id // 5 % 2 = 0 THEN 'ref' ELSE 'eval' END AS side, {fx('v')} AS v FROM long)"""


@query("environmental_shift", f"""WITH {QUALITY_SAMPLES}, {ecdf_sql('grp, metric_name')},
rolled AS (SELECT grp, {fx('avg(w1)')} AS metric, min(p_value) AS p_value, count(*) FILTER (p_value < 0.01) AS significant, max(n_ref) AS n_ref,
  max(n_eval) AS n_eval FROM scored GROUP BY grp)
SELECT grp, 'environmental_drift' AS dimension, metric > 0.01 OR (significant >= 2 AND metric > 0.0075) AS detected, metric, p_value, 'MEDIUM' AS severity,
  {fx('CASE WHEN n_ref >= 15 AND n_eval >= 15 THEN least(0.95, greatest(0.6, 0.5 + metric * 0.45)) ELSE least(0.4, 0.2 + metric * 0.3) END')} AS confidence,
  n_ref, n_eval, significant FROM rolled""")
def environmental_shift(spark, sf):
    page = F.col("page_id")
    figures = quality_scalars(F.encode("html", "UTF-8"), F.lit(1), F.lit(1))
    rows = Tables(spark, sf)("pages").select(
        (page % 5).alias("grp"), F.when(F.floor(page / 5) % 2 == 0, "ref").otherwise("eval").alias("side"), figures.alias("q")
    ).select("grp", "side", "q.*")
    return S.environmental_shift(rows, ["grp"], threshold=0.01).withColumn("confidence", fixed(F.col("confidence"), 6))


REPORT_DIMENSIONS = ("covariate_shift", "semantic_shift", "environmental_drift", "adversarial_manipulation")


def _bounded(x: str, low: float, high: float) -> str:
    return fx(f"least({high}, greatest({low}, {x}))", 4)


@query("shift_report", f"""WITH base AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, {list(REPORT_DIMENSIONS)}[c_custkey % 4 + 1] AS dimension,
  min((c_acctbal + 1000) / 11000) AS m FROM customer GROUP BY ALL),
dims AS (SELECT nation, segment, dimension, {fx('m')} AS metric FROM base),
sizes AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) FILTER (c_custkey // 4 % 2 = 0) AS n_ref, count(*) FILTER (c_custkey // 4 % 2 = 1) AS n_eval
  FROM customer GROUP BY ALL),
rolled AS (SELECT nation, segment, {fx("sum(metric * CASE dimension WHEN 'covariate_shift' THEN 0.4 WHEN 'semantic_shift' THEN 0.3 WHEN 'environmental_drift' THEN 0.2 ELSE 0.1 END::DOUBLE)")} AS overall,
  bool_or(metric > 0.3) AS shift_detected, coalesce(max(metric) FILTER (dimension = 'covariate_shift'), 0) AS cov,
  coalesce(max(metric) FILTER (dimension = 'environmental_drift'), 0) AS env, coalesce(max(metric) FILTER (dimension = 'adversarial_manipulation'), 0) AS manip
  FROM dims GROUP BY ALL),
kinds AS (SELECT *, n_ref >= 4 AND n_eval >= 4 AS enough, CASE WHEN NOT (n_ref >= 4 AND n_eval >= 4) THEN 1 WHEN manip > 0.3 THEN 2 WHEN env > 0.3 THEN 3
  WHEN cov <= 0.3 AND overall < 0.1 THEN 4 WHEN cov > 0.3 THEN 5 ELSE 6 END AS kind FROM rolled JOIN sizes USING (nation, segment))
SELECT nation, segment, n_ref, n_eval, overall AS overall_distance, shift_detected,
  ['INSUFFICIENT_SAMPLES', 'SUSPICIOUS_MANIPULATION', 'NATURAL_ENVIRONMENTAL_DRIFT', 'NO_SIGNIFICANT_SHIFT', 'COVARIATE_DOMAIN_SHIFT', 'INDETERMINATE_SHIFT'][kind] AS characterization,
  CASE kind WHEN 1 THEN {_bounded('overall * 0.5', 0.05, 0.35)} WHEN 2 THEN {fx('greatest(0.05, 0.35 - manip * 0.30)', 4)} WHEN 3 THEN {_bounded('0.5 + env * 0.45', 0.65, 0.95)}
    WHEN 4 THEN 0.05 WHEN 5 THEN {_bounded('cov * 0.7', 0.2, 0.8)} ELSE {_bounded('overall', 0.1, 0.5)} END::DOUBLE AS natural_drift_likelihood,
  CASE kind WHEN 1 THEN {_bounded('manip * 0.5', 0.05, 0.35)} WHEN 2 THEN {_bounded('0.5 + manip * 0.5', 0.65, 0.95)} WHEN 3 THEN {_bounded('manip * 0.30', 0.05, 0.25)}
    WHEN 4 THEN 0.05 WHEN 5 THEN {_bounded('manip * 0.5', 0.05, 0.4)} ELSE {_bounded('manip', 0.1, 0.5)} END::DOUBLE AS suspicious_manipulation_likelihood,
  enough AS evidence_sufficient FROM kinds""")
def shift_report(spark, sf):
    keys = [F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")]
    kind = F.element_at(F.array(*[F.lit(d) for d in REPORT_DIMENSIONS]), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = Tables(spark, sf)("customer").select(
        *keys, kind.alias("dimension"), F.floor(F.col("c_custkey") / 4).alias("half"), ((F.col("c_acctbal") + 1000) / 11000).alias("m")
    )
    by = ["nation", "segment"]
    dims = rows.groupBy(*by, "dimension").agg(fixed(F.min("m"), 6).alias("metric")).withColumn("detected", F.col("metric") > 0.3)
    sizes = rows.groupBy(*by).agg(F.count_if(F.col("half") % 2 == 0).alias("n_ref"), F.count_if(F.col("half") % 2 == 1).alias("n_eval"))
    return S.shift_report(dims, sizes, by, min_n=4)
