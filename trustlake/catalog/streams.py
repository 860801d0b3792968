"""Record-stream queries over events, chain queries over conversations."""

from pyspark.sql import functions as F

from trustlake.catalog.base import Tables, query
from trustlake.functions.hashing import sha256
from trustlake.functions.text import canonical_timestamp, timestamp_skew
from trustlake.operators import chain as CH
from trustlake.operators import records as R
from trustlake.operators.scan import assign_sequence, with_previous

NOW = "2024-01-12 00:00:00"
DAY = 86_400.0

EVENTS = """ev AS (SELECT event_id AS arrival, ts, user_id, user_id::VARCHAR AS session_id, 'k' || (user_id % 10)::VARCHAR AS signing_key_id,
  (props::JSON->>'$.k')::BIGINT AS sequence_number, user_id::VARCHAR || '-' || (props::JSON->>'$.k') AS nonce,
  event_type, event_type <> 'error' AS authentic FROM events)"""
SEQUENCE = EVENTS + """,
prior AS (SELECT *, max(CASE WHEN authentic THEN sequence_number END) OVER (PARTITION BY session_id, signing_key_id ORDER BY arrival
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_sequence FROM ev),
seq AS (SELECT *, authentic AND previous_sequence IS NOT NULL AND sequence_number <= previous_sequence AS sequence_regression,
  authentic AND previous_sequence IS NOT NULL AND sequence_number > previous_sequence + 1 AS sequence_gap FROM prior)"""


def events(t: Tables):
    k = F.get_json_object("props", "$.k")
    return t("events").select(
        F.col("event_id").alias("arrival"), F.col("ts").alias("timestamp"), "user_id", "event_type",
        F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("k"), F.col("user_id") % 10).alias("signing_key_id"),
        k.cast("long").alias("sequence_number"), F.concat_ws("-", "user_id", k).alias("nonce"),
        (F.col("event_type") != "error").alias("authentic"),
    )


@query("sequence_state", f"WITH {SEQUENCE} SELECT arrival, previous_sequence, sequence_regression, sequence_gap FROM seq")
def sequence_state(spark, sf):
    return R.sequence_state(events(Tables(spark, sf))).select("arrival", "previous_sequence", "sequence_regression", "sequence_gap")


@query("sequence_state_bucketed", f"WITH {SEQUENCE} SELECT arrival, previous_sequence, sequence_regression, sequence_gap FROM seq")
def sequence_state_bucketed(spark, sf):
    """Same result with buckets narrow enough to matter on small tables."""
    rows = R.sequence_state(events(Tables(spark, sf)), width=500)
    return rows.select("arrival", "previous_sequence", "sequence_regression", "sequence_gap")


@query("nonce_replay", f"WITH {EVENTS} SELECT arrival, row_number() OVER (PARTITION BY nonce ORDER BY arrival) > 1 AS nonce_replay FROM ev")
def nonce_replay(spark, sf):
    return R.nonce_replay(events(Tables(spark, sf))).select("arrival", "nonce_replay")


@query("timestamp_skew", f"WITH {EVENTS} SELECT arrival, abs(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6 > {DAY} AS stale FROM ev")
def stale_records(spark, sf):
    now = F.to_timestamp(F.lit(NOW))
    return events(Tables(spark, sf)).select("arrival", timestamp_skew(F.col("timestamp"), now, DAY).alias("stale"))


@query("canonical_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_text FROM events")
def canonical_ts(spark, sf):
    return Tables(spark, sf)("events").select("event_id", canonical_timestamp(F.col("ts")).alias("ts_text"))


@query("assign_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence_number FROM events")
def assigned(spark, sf):
    return assign_sequence(Tables(spark, sf)("events").select("event_id", "user_id"), ["user_id"], "event_id")


KEYS = """keys AS (SELECT 'k' || n::VARCHAR AS key_id, CASE n WHEN 3 THEN 'REVOKED' WHEN 4 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
  CASE n WHEN 5 THEN DATE '2023-12-31' ELSE DATE '2025-01-01' END AS valid_until,
  CASE n WHEN 6 THEN DATE '2024-06-01' ELSE DATE '2023-01-01' END AS valid_from
  FROM (SELECT DISTINCT user_id % 10 AS n FROM events) WHERE n <> 7)"""
KEY_ERROR = """CASE WHEN e.user_id % 23 = 0 THEN 'MISSING_KEY_ID' WHEN k.key_id IS NULL THEN 'UNKNOWN_KEY'
  WHEN k.status <> 'ACTIVE' OR DATE '2024-01-12' > k.valid_until OR DATE '2024-01-12' < k.valid_from THEN 'EXPIRED_OR_REVOKED_KEY' END"""


def keys(t: Tables):
    n = F.col("n")
    day = lambda text: F.to_timestamp(F.lit(text))
    ids = t("events").select((F.col("user_id") % 10).alias("n")).distinct().where(n != 7)
    return ids.select(
        F.concat(F.lit("k"), n).alias("key_id"), F.lit("HMAC_SECRET").alias("key_type"),
        F.when(n == 3, "REVOKED").when(n == 4, "SUSPENDED").otherwise("ACTIVE").alias("status"),
        F.when(n == 6, day("2024-06-01")).otherwise(day("2023-01-01")).alias("valid_from"),
        F.when(n == 5, day("2023-12-31")).otherwise(day("2025-01-01")).alias("valid_until"),
        F.encode(F.concat(F.lit("secret-"), n), "UTF-8").alias("secret"),
    )


@query("join_keys", f"""WITH {EVENTS}, {KEYS} SELECT arrival, {KEY_ERROR} AS key_error
FROM ev e LEFT JOIN keys k ON k.key_id = e.signing_key_id""")
def join_keys(spark, sf):
    t = Tables(spark, sf)
    rows = events(t).withColumn("signing_key_id", F.when(F.col("user_id") % 23 != 0, F.col("signing_key_id")))
    return R.join_keys(rows, keys(t), F.to_timestamp(F.lit(NOW))).select("arrival", "key_error")


def records(t: Tables):
    """Signed inference records from events; a fixed rule tampers, unbinds or misfiles some of them."""
    a = F.col("arrival")
    digest = lambda *parts: sha256(F.concat_ws("|", *parts))
    base = events(t).withColumn("signing_key_id", F.when(F.col("user_id") % 23 != 0, F.col("signing_key_id")))
    rows = base.select(
        "arrival", F.concat(F.lit("r"), a).alias("record_id"), "session_id", "event_type",
        F.concat(F.lit("unit-"), F.col("user_id") % 5).alias("producer_id"), "signing_key_id", "sequence_number", "nonce", "timestamp",
        digest(F.lit("image"), "arrival").alias("input_image_hash"), F.concat(F.lit("m"), F.col("user_id") % 4).alias("model_id"),
        digest(F.lit("w"), F.when(a % 41 == 0, 99).otherwise(F.col("user_id") % 4)).alias("model_weight_digest"),
        digest(F.lit("p"), F.when(a % 43 == 0, 99).otherwise(F.col("user_id") % 4)).alias("preprocessing_config_hash"),
        F.lit(None).cast("string").alias("previous_record_hash"), F.lit('{"threshold": 0.25}').alias("inference_config"),
        F.concat(F.lit('{"class_id": '), F.col("user_id") % 7, F.lit(', "confidence": 0.875}')).alias("output"),
        F.lit(None).cast("string").alias("signature"), F.when(a % 53 == 0, "0.9").otherwise("1.0").alias("schema_version"),
    )
    signed = R.sign_records(rows, keys(t))
    return signed.withColumn(
        "output", F.when(a % 17 == 0, F.lit('{"class_id": 1, "confidence": 0.99}')).otherwise(F.col("output"))
    ).withColumn("binding_hmac", F.when(a % 19 != 0, F.coalesce("binding_hmac", F.lit("unsigned"))))


def registries(t: Tables):
    ids = t("events").select((F.col("user_id") % 4).alias("n")).distinct()
    model = F.concat(F.lit("m"), F.col("n")).alias("model_id")
    models = ids.select(model, F.upper(sha256(F.concat_ws("|", F.lit("w"), "n"))).alias("registered_digest"))
    preprocessing = ids.select(model, sha256(F.concat_ws("|", F.lit("p"), "n")).alias("registered_preprocessing"))
    images = t("events").select(
        F.concat(F.lit("r"), F.col("event_id")).alias("record_id"),
        sha256(F.concat_ws("|", F.when(F.col("event_id") % 47 == 0, "other").otherwise("image"), "event_id")).alias("image_digest"),
    )
    return models, preprocessing, images


VERIFIED = f"""{EVENTS}, {KEYS},
base AS (SELECT e.*, {KEY_ERROR} AS key_error, arrival % 53 = 0 AS schema_bad,
  arrival % 19 = 0 AS unbound, arrival % 41 = 0 AS model_mismatch, arrival % 43 = 0 AS pre_mismatch, arrival % 47 = 0 AS image_mismatch,
  abs(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6 > 864000 AS stale,
  e.user_id % 23 <> 0 AND arrival % 53 <> 0 AS named FROM ev e LEFT JOIN keys k ON k.key_id = e.signing_key_id),
bound AS (SELECT *, arrival % 17 = 0 AND key_error IS NULL AND NOT unbound AS hmac_invalid,
  key_error IS NULL AND NOT unbound AND arrival % 17 <> 0 AND NOT image_mismatch AND NOT schema_bad AS trusted FROM base),
prior2 AS (SELECT *, max(CASE WHEN trusted THEN sequence_number END) OVER (PARTITION BY session_id, CASE WHEN user_id % 23 <> 0 THEN signing_key_id END ORDER BY arrival
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  min(CASE WHEN named THEN arrival END) OVER (PARTITION BY nonce) AS first_use FROM bound),
judged AS (SELECT *, named AND coalesce(first_use < arrival, false) AS nonce_replay,
  trusted AND prev IS NOT NULL AND sequence_number <= prev AS regression, trusted AND prev IS NOT NULL AND sequence_number > prev + 1 AS gap FROM prior2),
verified AS (SELECT arrival, session_id, CASE WHEN schema_bad THEN 'UNSUPPORTED' WHEN hmac_invalid OR unbound OR image_mismatch THEN 'TAMPERED_OUTPUT'
  WHEN nonce_replay OR regression OR stale THEN 'REPLAYED_RECORD' WHEN model_mismatch OR pre_mismatch THEN 'SUBSTITUTED_MODEL'
  WHEN key_error = 'EXPIRED_OR_REVOKED_KEY' THEN 'EXPIRED_KEY' WHEN key_error IS NOT NULL THEN 'UNVERIFIED_KEY'
  WHEN gap THEN 'VERIFIED_WITH_WARNING' ELSE 'VERIFIED' END AS status,
  CASE WHEN schema_bad THEN 1 ELSE (key_error IS NOT NULL)::INT + hmac_invalid::INT + unbound::INT + image_mismatch::INT + model_mismatch::INT
    + pre_mismatch::INT + stale::INT + regression::INT + gap::INT + nonce_replay::INT END AS findings FROM judged)"""


def judged(t: Tables):
    models, preprocessing, images = registries(t)
    now = F.to_timestamp(F.lit(NOW))
    return R.verify_records(records(t), keys(t), now, models, preprocessing, images, tolerance=864_000.0)


@query("verify_records", f"""WITH {VERIFIED} SELECT arrival, status, findings::BIGINT AS findings,
  CASE WHEN status IN ('TAMPERED_OUTPUT', 'REPLAYED_RECORD', 'SUBSTITUTED_MODEL', 'EXPIRED_KEY') THEN 'QUARANTINE'
       WHEN status = 'VERIFIED' THEN 'ACCEPT' ELSE 'REVIEW' END AS disposition FROM verified""")
def verify_records(spark, sf):
    """HMAC, registries, clock, sequence and nonce checks over every event; SQL states the planted outcome."""
    rows = judged(Tables(spark, sf))
    return rows.select("arrival", "status", F.size("findings").cast("long").alias("findings"), "disposition")


@query("record_outcomes", f"WITH {VERIFIED} SELECT session_id, status, count(*) AS records FROM verified GROUP BY ALL")
def record_outcomes(spark, sf):
    return judged(Tables(spark, sf)).groupBy("session_id", "status").agg(F.count(F.lit(1)).alias("records"))


@query("registry_mismatches", f"""WITH {EVENTS} SELECT arrival, arrival % 41 = 0 AS model_mismatch, arrival % 43 = 0 AS preprocessing_mismatch,
  arrival % 47 = 0 AS image_mismatch FROM ev""")
def registry_mismatches(spark, sf):
    t = Tables(spark, sf)
    models, preprocessing, images = registries(t)
    rows = R.check_input_image(R.check_preprocessing(R.check_model_digest(records(t), models), preprocessing), images)
    return rows.select("arrival", "model_mismatch", "preprocessing_mismatch", "image_mismatch")


@query("record_links", f"""WITH {EVENTS},
h AS (SELECT *, sha256(nonce || '|' || arrival::VARCHAR) AS record_hash FROM ev),
p AS (SELECT *, lag(record_hash) OVER (PARTITION BY session_id, signing_key_id ORDER BY arrival) AS prev FROM h)
SELECT arrival, prev IS NOT NULL AND arrival % 29 = 0 AS link_broken FROM p""")
def record_links(spark, sf):
    rows = events(Tables(spark, sf)).withColumn("record_hash", sha256(F.concat_ws("|", "nonce", "arrival")))
    linked = with_previous(rows, R.STREAM, "arrival", ["record_hash"])
    stated = F.when(F.col("arrival") % 29 == 0, "forged").otherwise(F.col("prev_record_hash"))
    return R.record_links(linked.withColumn("previous_record_hash", stated).drop("prev_record_hash")).select("arrival", "link_broken")


# --- chains -----------------------------------------------------------------------------------------------------

LOG = f"""stored AS (SELECT conv_id AS log_id, turn AS pos, sha256(conv_id::VARCHAR || '|' || turn::VARCHAR || '|' || text) AS computed_hash,
  CASE WHEN (conv_id * 31 + turn) % 29 = 0 THEN sha256(text) ELSE sha256(conv_id::VARCHAR || '|' || turn::VARCHAR || '|' || text) END AS event_hash,
  CASE WHEN (conv_id + turn) % 23 = 0 THEN turn - 2 ELSE turn END AS sequence_number,
  CASE WHEN (conv_id * 3 + turn) % 37 = 0 THEN 60 * turn - 100 ELSE 60 * turn END AS t FROM conversations),
log AS (SELECT *, lag(event_hash) OVER w AS prev, lag(sequence_number) OVER w AS pseq, lag(t) OVER w AS pt,
  CASE WHEN (log_id * 7 + pos) % 31 = 0 THEN 'broken' ELSE coalesce(lag(event_hash) OVER w, '{"0" * 64}') END AS previous_event_hash
  FROM stored WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
checked AS (SELECT *, previous_event_hash = coalesce(prev, '{"0" * 64}') AS link_ok, event_hash = computed_hash AS content_ok,
  coalesce(sequence_number > pseq, true) AS sequence_ok, coalesce(t >= pt, true) AS time_ok FROM log)"""


def log(t: Tables):
    turn, conv = F.col("turn"), F.col("conv_id")
    computed = sha256(F.concat_ws("|", "conv_id", "turn", "text"))
    stored = t("conversations").select(
        conv.alias("log_id"), turn.alias("pos"), computed.alias("computed_hash"),
        F.when((conv * 31 + turn) % 29 == 0, sha256(F.col("text"))).otherwise(computed).alias("event_hash"),
        F.when((conv + turn) % 23 == 0, turn - 2).otherwise(turn).alias("sequence_number"),
        F.timestamp_seconds(F.when((conv * 3 + turn) % 37 == 0, 60 * turn - 100).otherwise(60 * turn)).alias("timestamp"),
    )
    linked = with_previous(stored, ["log_id"], "pos", ["event_hash"])
    stated = F.when((F.col("log_id") * 7 + F.col("pos")) % 31 == 0, "broken").otherwise(F.coalesce("prev_event_hash", F.lit("0" * 64)))
    return linked.withColumn("previous_event_hash", stated).drop("prev_event_hash")


@query("chain_checks", f"WITH {LOG} SELECT log_id, pos, link_ok, content_ok, sequence_ok, time_ok FROM checked")
def chain_checks(spark, sf):
    return CH.chain_checks(log(Tables(spark, sf))).select("log_id", "pos", "link_ok", "content_ok", "sequence_ok", "time_ok")


@query("verify_chain", f"""WITH {LOG}, failing AS (SELECT *, CASE WHEN NOT link_ok THEN 'link' WHEN NOT content_ok THEN 'content'
  WHEN NOT sequence_ok THEN 'sequence' WHEN NOT time_ok THEN 'time' END AS reason FROM checked)
SELECT log_id, min(pos) FILTER (reason IS NOT NULL) IS NULL AS is_valid, count(*) AS total_events,
  coalesce(min(pos) FILTER (reason IS NOT NULL), count(*)) AS verified_events, min(pos) FILTER (reason IS NOT NULL) AS failed_index,
  arg_min(reason, pos) FILTER (reason IS NOT NULL) AS reason FROM failing GROUP BY log_id""")
def verify_chain(spark, sf):
    return CH.verify_chain(log(Tables(spark, sf)), width=4)


@query("verify_archives", """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
counts AS (SELECT doc_id, count(*) AS total_events, count(*) FILTER (length(trim(line)) % 97 = 0) AS bad FROM lines WHERE trim(line) <> '' GROUP BY doc_id),
j AS (SELECT d.doc_id, coalesce(total_events, 0) AS total_events, CASE WHEN d.doc_id % 11 = 0 THEN 'manifest_missing' WHEN d.doc_id % 13 = 0 THEN 'hash_mismatch'
  WHEN bad > 0 THEN 'event_corrupted' WHEN d.doc_id % 17 = 0 THEN 'event_count_mismatch' END AS error FROM documents d LEFT JOIN counts USING (doc_id))
SELECT doc_id AS path, error IS NULL AS is_valid, total_events, error FROM j""")
def verify_archives(spark, sf):
    docs = Tables(spark, sf)("documents").select(F.col("doc_id").alias("path"), "text")
    line = F.trim("line")
    events_ = docs.select("path", F.explode(F.split("text", "\n")).alias("line")).where(line != "").select(
        "path", (F.length(line) % 97 != 0).alias("hash_ok")
    )
    files = docs.select("path", sha256(F.col("text")).alias("sha256"))
    real = events_.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    manifest = docs.join(real, "path", "left").where(F.col("path") % 11 != 0).select(
        "path", F.when(F.col("path") % 13 == 0, "0").otherwise(sha256(F.col("text"))).alias("expected_sha256"),
        (F.coalesce("n", F.lit(0)) + F.when(F.col("path") % 17 == 0, 1).otherwise(0)).alias("expected_events"),
    )
    return CH.verify_archives(files, events_, manifest)
