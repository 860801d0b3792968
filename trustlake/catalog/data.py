"""Data-integrity queries: vectors from embeddings, byte streams from documents and pages."""

from pyspark.sql import functions as F

from trustlake.catalog.base import FINDINGS_SQL, Tables, findings, fx, query
from trustlake.functions import binary as B
from trustlake.functions.numeric import fixed
from trustlake.functions.vectors import unit
from trustlake.operators import assurance as A
from trustlake.operators import centroids as C
from trustlake.operators import contributors as R
from trustlake.operators import duplicates as D
from trustlake.operators import neighbours as N

VECTORS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"""
KNN = VECTORS + f""",
dist AS (SELECT a.vec_id, a.label, b.vec_id AS n_id, b.label AS n_label,
  {fx('greatest(0.0, 1 - list_dot_product(a.vec, b.vec))', 9)} AS distance FROM v a, v b WHERE a.vec_id <> b.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, n_id) AS rank FROM dist QUALIFY rank <= 5)"""
KNN_OPTIONS = {"id_col": "vec_id", "order": "ord", "label": "label"}


def features(t: Tables):
    return t("embeddings").select(
        "vec_id", F.col("vec_id").alias("ord"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )


@query("knn_join", f"WITH {KNN} SELECT vec_id, rank, n_id, n_label, distance FROM knn")
def knn_join(spark, sf):
    rows = N.knn_join(features(Tables(spark, sf)), 5, **KNN_OPTIONS)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("rank").cast("long").alias("rank"),
                       F.col("n_id").cast("long").alias("n_id"), F.col("n_label").cast("int").alias("n_label"), "distance")


@query("knn_join_pivots", f"WITH {KNN} SELECT vec_id, rank, n_id, distance FROM knn")
def knn_join_pivots(spark, sf):
    """The pruned plan large inputs take, forced on."""
    rows = N.knn_join(features(Tables(spark, sf)), 5, pivots=16, block=128, **KNN_OPTIONS)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("rank").cast("long").alias("rank"),
                       F.col("n_id").cast("long").alias("n_id"), "distance")


@query("label_disagreement", f"""WITH {KNN},
votes AS (SELECT vec_id, label, n_label, count(*) AS c, min(rank) AS r FROM knn GROUP BY ALL),
tally AS (SELECT vec_id, label, coalesce(sum(c) FILTER (n_label = label), 0) AS own, arg_max(n_label, c * 100 - r) AS consensus FROM votes GROUP BY ALL),
means AS (SELECT vec_id, avg(distance) AS d FROM knn GROUP BY vec_id)
SELECT vec_id, label::VARCHAR AS label, consensus::VARCHAR AS consensus, round(1 - own / 5, 3) AS disagreement, {fx('d')} AS mean_distance
FROM tally JOIN means USING (vec_id) WHERE 1 - own / 5 >= 0.8 - 1e-9""")
def label_disagreement(spark, sf):
    found = N.nearest(features(Tables(spark, sf)), 5, **KNN_OPTIONS)
    rows = N.label_disagreement(found, 5, label="label")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "consensus", "disagreement",
                       fixed(F.col("mean_distance"), 6).alias("mean_distance"))


@query("knn_cells_by_label", f"""WITH {KNN.replace('a.vec_id <> b.vec_id', 'a.vec_id <> b.vec_id AND a.label = b.label')} SELECT vec_id, rank, n_id, distance FROM knn""")
def knn_cells_by_label(spark, sf):
    """Neighbours within each group."""
    rows = N.knn_join(features(Tables(spark, sf)).withColumn("grp", F.col("label")), 5, by=["grp"], **KNN_OPTIONS)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("rank").cast("long").alias("rank"),
                       F.col("n_id").cast("long").alias("n_id"), "distance")


CENTROIDS = VECTORS + """,
long AS (SELECT vec_id, label, unnest(range(len(vec))) AS d, unnest(vec) AS x FROM v),
means AS (SELECT label, d, avg(x) AS m FROM long GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(m * m)) AS norm FROM means GROUP BY label),
cent AS (SELECT label, list(m / norm ORDER BY d) AS centroid FROM means JOIN norms USING (label) GROUP BY label)"""


@query("class_centroids", f"WITH {CENTROIDS} SELECT label, d AS dim, {fx('m / norm', 9)} AS value FROM means JOIN norms USING (label)")
def class_centroids(spark, sf):
    rows = C.class_centroids(features(Tables(spark, sf)), label="label")
    long = rows.select("label", F.posexplode("centroid").alias("dim", "value"))
    return long.select("label", F.col("dim").cast("long").alias("dim"), fixed(F.col("value"), 9).alias("value"))


CONFUSION = CENTROIDS + f""",
away AS (SELECT v.label, o.label AS other, {fx('greatest(0.0, 1 - list_dot_product(v.vec, m.centroid))', 9)} AS own,
  {fx('greatest(0.0, 1 - list_dot_product(v.vec, o.centroid))', 9)} AS d
  FROM v JOIN cent m ON m.label = v.label JOIN cent o ON o.label <> v.label),
rates AS (SELECT label, other, count(*) AS n, count(*) FILTER (d < own) / count(*) AS rate FROM away GROUP BY ALL)"""


@query("confusion_rates", f"WITH {CONFUSION} SELECT label, other, n, {fx('rate')} AS rate FROM rates")
def confusion_rates(spark, sf):
    rows = C.confusion_rates(features(Tables(spark, sf)), label="label")
    return rows.select("label", "other", "n", fixed(F.col("rate"), 6).alias("rate"))


@query("asymmetric_confusion", f"""WITH {CONFUSION},
pairs AS (SELECT a.label AS x, a.other AS y, a.rate AS xy, b.rate AS yx, a.n AS nx, b.n AS ny FROM rates a JOIN rates b
  ON a.label = b.other AND a.other = b.label WHERE a.label < a.other AND (a.rate > 0.005 OR b.rate > 0.005) AND abs(a.rate - b.rate) >= 0.01)
SELECT CASE WHEN xy > yx THEN x ELSE y END AS source_class, CASE WHEN xy > yx THEN y ELSE x END AS target_class,
  {fx('greatest(xy, yx)')} AS source_to_target, {fx('least(xy, yx)')} AS target_to_source, {fx('abs(xy - yx)')} AS asymmetry,
  CASE WHEN xy > yx THEN nx ELSE ny END AS sample_count FROM pairs""")
def asymmetric_confusion(spark, sf):
    """Low thresholds: the test vectors carry no planted mislabelling."""
    rows = C.asymmetric_confusion(features(Tables(spark, sf)), label="label", delta=0.01, min_rate=0.005)
    return rows.select("source_class", "target_class", "sample_count",
                       *[fixed(F.col(n), 6).alias(n) for n in ("source_to_target", "target_to_source", "asymmetry")])


OUTLIERS = CENTROIDS + """,
moments AS (SELECT label, d, avg(x) AS m, var_samp(x) AS s, count(*) AS n FROM long GROUP BY ALL),
z AS (SELECT vec_id, label, sqrt(avg(pow((x - m) / sqrt(s), 2))) AS score FROM long JOIN moments USING (label, d)
  WHERE s > 1e-8 AND n >= 4 GROUP BY ALL)"""


@query("outlier_scores", f"WITH {OUTLIERS} SELECT vec_id, label, {fx('score')} AS score FROM z")
def outlier_scores(spark, sf):
    rows = C.outlier_scores(features(Tables(spark, sf)), label="label")
    return rows.select("vec_id", "label", fixed(F.col("score"), 6).alias("score"))


@query("class_outliers", f"WITH {OUTLIERS} SELECT vec_id, label, {fx('score', 3)} AS score FROM z WHERE score > 1.0")
def class_outliers(spark, sf):
    rows = C.class_outliers(features(Tables(spark, sf)), sigma=1.0, label="label")
    return rows.select("vec_id", "label", fixed(F.col("score"), 3).alias("score"))


@query("unit_vectors", f"""WITH {VECTORS}, doubled AS (SELECT vec_id, list_transform(vec, lambda x: x * (vec_id % 5)) AS w FROM v),
normed AS (SELECT vec_id, w, sqrt(list_dot_product(w, w)) AS n FROM doubled)
SELECT vec_id, {fx('CASE WHEN n > 0 THEN list_sum(w) / n ELSE 0.0 END', 9)} AS total FROM normed""")
def unit_vectors(spark, sf):
    scaled = F.transform("vec", lambda x: x * (F.col("vec_id") % 5))
    total = F.aggregate(unit(F.col("w")), F.lit(0.0), lambda a, x: a + x)
    return features(Tables(spark, sf)).select("vec_id", scaled.alias("w")).select("vec_id", fixed(total, 9).alias("total"))


# --- byte streams ---------------------------------------------------------------------------------------------

BYTES = """docs AS (SELECT doc_id, source, sha256(text) AS file_hash, regexp_extract_all(hex(encode(text)), '..') AS hb, strlen(text) AS n FROM documents)"""
BYTE = "('0x' || hb[({}) + 1])::INTEGER"


def byte(pos: str) -> str:
    return BYTE.format(pos)


DHASH = BYTES + f""",
hashes AS (SELECT doc_id, source, file_hash, n, CASE WHEN n < 64 THEN 0::UBIGINT ELSE list_sum(list_transform(range(64), lambda p:
  CASE WHEN hb[((p // 8 * 9 + p % 8) * greatest(1, n // 72)) % n + 1] > hb[((p // 8 * 9 + p % 8 + 1) * greatest(1, n // 72)) % n + 1]
  THEN (1::UBIGINT << (63 - p)::UBIGINT)::HUGEINT ELSE 0 END))::UBIGINT END AS dhash FROM docs)"""


def documents(t: Tables):
    content = F.encode("text", "UTF-8")
    return t("documents").select(
        F.col("doc_id"), "source", content.alias("content"), F.sha2(content, 256).alias("file_hash")
    )


def hashed(t: Tables):
    return documents(t).select("doc_id", "source", "file_hash", B.dhash(F.col("content")).alias("dhash"))


@query("content_digests", f"WITH {BYTES} SELECT doc_id, file_hash, n AS size FROM docs")
def content_digests(spark, sf):
    rows = documents(Tables(spark, sf))
    return rows.select("doc_id", "file_hash", F.length("content").cast("long").alias("size"))


@query("difference_hash", f"WITH {DHASH} SELECT doc_id, format('{{:016x}}', dhash) AS dhash FROM hashes")
def difference_hash(spark, sf):
    return hashed(Tables(spark, sf)).select("doc_id", B.dhash_hex(F.col("dhash")).alias("dhash"))


@query("exact_duplicates", f"WITH {BYTES} SELECT file_hash, count(*) AS files FROM docs GROUP BY file_hash HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return D.exact_duplicates(documents(Tables(spark, sf)))


@query("duplicate_summary", f"""WITH {BYTES}, g AS (SELECT source, file_hash, count(*) AS c FROM docs GROUP BY ALL)
SELECT source, count(*) FILTER (c > 1) AS clusters, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS files, sum(c)::BIGINT AS images,
  {fx('coalesce(sum(c) FILTER (c > 1), 0) / sum(c)', 4)} AS ratio FROM g GROUP BY source""")
def duplicate_summary(spark, sf):
    rows = D.duplicate_summary(documents(Tables(spark, sf)), ["source"])
    return rows.withColumn("ratio", fixed(F.col("files") / F.col("images"), 4))


NEAR = DHASH + """,
contents AS (SELECT DISTINCT file_hash, dhash FROM hashes),
near AS (SELECT least(a.file_hash, b.file_hash) AS digest_a, greatest(a.file_hash, b.file_hash) AS digest_b, bit_count(xor(a.dhash, b.dhash)) AS distance
  FROM contents a JOIN contents b ON a.file_hash < b.file_hash WHERE bit_count(xor(a.dhash, b.dhash)) <= 4)"""


SIGNED = "(CASE WHEN dhash > 9223372036854775807 THEN dhash::HUGEINT - 18446744073709551616 ELSE dhash::HUGEINT END)::BIGINT"


# Invented texts have no close hashes, so each hash also comes with one to six bits flipped, by a rule on doc_id.
FLIPPED = """flipped AS (SELECT xor(dhash, list_sum([1::UBIGINT << ((doc_id * 7 + j * 11) % 64)::INTEGER for j in range(doc_id % 6 + 1)])::UBIGINT) AS dhash FROM hashes),
both_hashes AS (SELECT dhash FROM hashes UNION SELECT dhash FROM flipped)"""


@query("hamming_join", f"""WITH {DHASH}, {FLIPPED}, h AS (SELECT {SIGNED} AS s, dhash AS u FROM both_hashes)
SELECT a.s AS a, b.s AS b, bit_count(xor(a.u, b.u))::INTEGER AS distance FROM h a JOIN h b ON a.s < b.s
WHERE bit_count(xor(a.u, b.u)) <= 4""")
def hamming_join(spark, sf):
    rows = hashed(Tables(spark, sf)).select("doc_id", "dhash")
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("doc_id") * 7 + j * 11) % 64).cast("int"))
    mask = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 6), F.lit(0).cast("long"), lambda m, j: m.bitwiseOR(bit(j)))
    flipped = rows.select(F.col("dhash").bitwiseXOR(mask).alias("dhash"))
    return D.hamming_join(rows.select("dhash").union(flipped))


@query("hash_members", f"WITH {DHASH} SELECT DISTINCT {SIGNED} AS h, file_hash FROM hashes")
def hash_members(spark, sf):
    return D.hash_members(hashed(Tables(spark, sf)))


@query("near_duplicate_clusters", f"""WITH RECURSIVE {NEAR},
edges AS (SELECT digest_a AS a, digest_b AS b FROM near UNION ALL SELECT digest_b, digest_a FROM near),
reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
comp AS (SELECT node AS file_hash, min(other) AS root, count(DISTINCT other) AS contents FROM reach GROUP BY node)
SELECT doc_id, contents, min(doc_id) OVER (PARTITION BY root) AS first_doc FROM hashes JOIN comp USING (file_hash)""")
def near_duplicate_clusters(spark, sf):
    rows = D.near_duplicate_clusters(hashed(Tables(spark, sf)))
    first = rows.groupBy("cluster").agg(F.min("doc_id").alias("first_doc"))
    return rows.join(first, "cluster").select("doc_id", "contents", "first_doc")


DELTA = "list_avg(list_transform(range(1, 256), lambda i: abs({0} - {1})))"


def _delta(start: str) -> str:
    return DELTA.format(byte(f"{start} + i"), byte(f"{start} + i - 1"))


@query("edge_residual", f"""WITH {BYTES}, big AS (SELECT *, least(128, n // 10) AS skip FROM docs WHERE n >= 1024),
deltas AS (SELECT doc_id, {_delta('skip')} AS tl, {_delta('n - 256')} AS br, {_delta('n // 2')} AS mid FROM big),
s AS (SELECT doc_id, br / (mid + 1) AS b, tl / (mid + 1) AS t FROM deltas)
SELECT doc_id, coalesce({fx('CASE WHEN b > t AND b > 2.8 THEN least(1.0, b / 5) WHEN t > 2.8 THEN least(1.0, t / 5) ELSE 0.0 END')}, 0.0) AS score,
  coalesce(CASE WHEN b > t AND b > 2.8 THEN 'bottom_right' WHEN t > 2.8 THEN 'top_left' ELSE 'none' END, 'none') AS region
FROM docs LEFT JOIN s USING (doc_id)""")
def edge_residual(spark, sf):
    rows = documents(Tables(spark, sf)).select("doc_id", B.edge_residual(F.col("content")).alias("r"))
    return rows.select("doc_id", fixed(F.col("r.score"), 6).alias("score"), "r.region")


@query("byte_features", f"""WITH {BYTES}, pairs AS (SELECT doc_id, n, unnest(hb) AS hx FROM docs),
freq AS (SELECT doc_id, ('0x' || hx)::INTEGER AS b, count(*) / any_value(n) AS p FROM pairs GROUP BY doc_id, hx),
hist AS (SELECT doc_id, b // 4 AS dim, sum(p) AS value FROM freq GROUP BY ALL),
mean AS (SELECT doc_id, sum(p * b) AS m FROM freq GROUP BY doc_id),
mom AS (SELECT doc_id, any_value(m) AS m, sum(p * pow(b - m, 2)) AS v2, sum(p * pow(b - m, 3)) AS v3, sum(p * pow(b - m, 4)) AS v4 FROM freq JOIN mean USING (doc_id) GROUP BY doc_id),
sd AS (SELECT doc_id, m, v3, v4, CASE WHEN v2 > 0 THEN sqrt(v2) ELSE 1e-6 END AS s FROM mom),
heads AS (SELECT doc_id, list_transform(hb, lambda x: ('0x' || x)::INTEGER) AS bs FROM docs),
steps AS (SELECT doc_id, list_transform(range(1, len(bs)), lambda i: abs(bs[i + 1] - bs[i])) AS st FROM heads),
grad AS (SELECT doc_id, coalesce(list_avg(st), 0) / 255 AS g1, coalesce(list_max(st), 0) / 255 AS g2 FROM steps),
parts AS (SELECT doc_id, dim, value FROM hist UNION ALL SELECT doc_id, 64, m / 255 FROM sd UNION ALL SELECT doc_id, 65, s / 255 FROM sd
  UNION ALL SELECT doc_id, 66, v3 / pow(s, 3) / 10 FROM sd UNION ALL SELECT doc_id, 67, v4 / pow(s, 4) / 50 FROM sd
  UNION ALL SELECT doc_id, 68, g1 FROM grad UNION ALL SELECT doc_id, 69, g2 FROM grad),
norms AS (SELECT doc_id, sqrt(sum(value * value)) AS norm FROM parts GROUP BY doc_id)
SELECT doc_id, dim, {fx('value / norm')} AS value FROM parts JOIN norms USING (doc_id) WHERE value <> 0""")
def byte_features(spark, sf):
    rows = documents(Tables(spark, sf)).select("doc_id", F.posexplode(B.byte_features(F.col("content"))).alias("dim", "value"))
    return rows.where("value <> 0").select("doc_id", F.col("dim").cast("long").alias("dim"), fixed(F.col("value"), 6).alias("value"))


@query("quality_scalars", f"""WITH p AS (SELECT page_id, strlen(html) AS n, regexp_extract_all(hex(encode(html)), '..') AS hb FROM pages),
numbers AS (SELECT page_id, n, list_transform(hb, lambda x: ('0x' || x)::INTEGER) AS bs FROM p WHERE n > 0),
stats AS (SELECT page_id, n, list_avg(bs) AS m, list_stddev_pop(bs) AS s,
  list_avg(list_transform(range(1, len(bs)), lambda i: abs(bs[i + 1] - bs[i]))) AS g FROM numbers)
SELECT page_id, {fx('m / 255')} AS luminance, {fx('s / 255')} AS contrast, {fx('g / 255')} AS sharpness,
  {fx('(page_id % 7 + 1) / (page_id % 3 + 1)', 4)} AS aspect_ratio, {fx('n / 1024', 4)} AS size_kb FROM stats""")
def quality_scalars(spark, sf):
    rows = Tables(spark, sf)("pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    q = B.quality_scalars(F.col("content"), F.col("page_id") % 7 + 1, F.col("page_id") % 3 + 1)
    return rows.select("page_id", q.alias("q")).select("page_id", "q.*")


# --- contributors ---------------------------------------------------------------------------------------------

CONTRIB = f"""WITH {FINDINGS_SQL},
imgs AS (SELECT l_suppkey AS contributor, count(DISTINCT l_partkey) AS images FROM lineitem GROUP BY l_suppkey)"""


@query("contributor_risk", CONTRIB + f""",
t AS (SELECT contributor, count(*) AS issues, sum(CASE severity WHEN 'INFORMATIONAL' THEN 0.05 WHEN 'LOW' THEN 0.15 WHEN 'MEDIUM' THEN 0.4
  WHEN 'HIGH' THEN 0.75 WHEN 'CRITICAL' THEN 1.0 ELSE 0.2 END::DOUBLE) AS w FROM findings GROUP BY contributor),
r AS (SELECT contributor, issues, images, least(1.0, w / greatest(1.0, images * 0.6)) AS risk FROM t JOIN imgs USING (contributor))
SELECT contributor, issues, images, {fx('risk')} AS risk, CASE WHEN {fx('risk')} > 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN {fx('risk')} < 0.7 THEN 'REVIEW' ELSE 'QUARANTINE' END AS recommended_disposition FROM r""")
def contributor_risk(spark, sf):
    t = Tables(spark, sf)
    images = t("lineitem").groupBy(F.col("l_suppkey").alias("contributor")).agg(F.count_distinct("l_partkey").alias("images"))
    rows = R.contributor_risk(A.dedup_findings(findings(t)), images, ["contributor"], per_image=0.6)
    return rows.withColumn("risk", fixed(F.col("risk"), 6))


@query("contributor_breakdown", CONTRIB + " SELECT contributor, threat_id, severity, count(*) AS n FROM findings GROUP BY ALL")
def contributor_breakdown(spark, sf):
    return R.contributor_breakdown(A.dedup_findings(findings(Tables(spark, sf))), ["contributor"])
