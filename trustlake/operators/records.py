"""Verification of signed record streams: keys, binding, registries, clock, order, replay, outcome.

Every check is one boolean column. State checks (sequence, nonce, stream tip) look only at earlier rows by a
unique integer ``arrival`` and hold for streams that own a third of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.functions.hashing import add_payload, hmac_pads, hmac_sha256
from trustlake.functions.text import timestamp_skew
from trustlake.operators.scan import WIDTH, with_previous, with_running
from trustlake.session import cut_lineage, sized_broadcast

SignatureCheck = Callable[[Column, Column, Column], Column]
STREAM = ("session_id", "signing_key_id")
FLAGS = (
    "schema_bad", "signature_invalid", "hmac_invalid", "unbound", "image_mismatch", "model_mismatch",
    "preprocessing_mismatch", "stale", "link_broken", "sequence_regression", "sequence_gap", "nonce_replay",
)


def key_state(status: Column, valid_from: Column, valid_until: Column, now: Column) -> Column:
    """ACTIVE, the stored status, EXPIRED or NOT_YET_VALID."""
    return (
        F.when(status != "ACTIVE", status)
        .when(valid_until.isNotNull() & (now > valid_until), "EXPIRED")
        .when(valid_from.isNotNull() & (now < valid_from), "NOT_YET_VALID")
        .otherwise("ACTIVE")
    )


def join_keys(records: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Add ``key_error`` (null for a usable key), key type and material."""
    state = key_state(F.col("status"), F.col("valid_from"), F.col("valid_until"), now)
    known = keys.select(
        F.col("key_id").alias("_kid"), state.alias("_state"), F.col("key_type").alias("_key_type"), F.col("secret").alias("_secret"),
        hmac_pads(F.col("secret")).alias("_pads"),
    )
    known = one_per_key(known, "_kid", ["_state", "_key_type", "_secret", "_pads"], "key table")
    joined = records.join(sized_broadcast(known), F.col("signing_key_id") == F.col("_kid"), "left")
    missing = F.coalesce(F.col("signing_key_id"), F.lit("")) == ""
    error = (
        F.when(missing, "MISSING_KEY_ID").when(F.col("_kid").isNull(), "UNKNOWN_KEY")
        .when(F.col("_state") != "ACTIVE", "EXPIRED_OR_REVOKED_KEY")
    )
    return joined.withColumn("key_error", error).drop("_kid", "_state")


def bind(records: DataFrame, verify_signature: SignatureCheck | None = None) -> DataFrame:
    """Check HMAC (native) and signature (caller's vectorised verifier) over the canonical payload.

    Adds ``record_hash, bound, signature_invalid, hmac_invalid, unbound``. Signatures stay unproven, not
    invalid, when no verifier or no matching key is at hand.
    """
    active = F.col("key_error").isNull()
    has_sig, has_mac = F.col("signature").isNotNull(), F.col("binding_hmac").isNotNull()
    rows = add_payload(records, "_payload").withColumn("_payload", F.encode("_payload", "UTF-8"))
    can_mac = active & has_mac & (F.col("_key_type") == "HMAC_SECRET") & F.col("_secret").isNotNull()
    mac_ok = F.when(can_mac, F.lower("binding_hmac") == hmac_sha256(F.col("_pads"), F.col("_payload")))
    sig_ok = F.lit(None).cast("boolean")
    if verify_signature is not None:
        can_sign = active & has_sig & F.col("_key_type").startswith("ED25519") & F.col("_secret").isNotNull()
        sig_ok = F.when(can_sign, verify_signature(F.col("_secret"), F.col("_payload"), F.col("signature")))
    rows = rows.withColumn("_mac_ok", mac_ok).withColumn("_sig_ok", sig_ok)
    no = F.lit(False)
    return rows.select(
        *[c for c in records.columns if not c.startswith("_")],
        F.sha2("_payload", 256).alias("record_hash"),
        (F.coalesce("_mac_ok", no) | F.coalesce("_sig_ok", no)).alias("bound"),
        F.coalesce(~F.col("_sig_ok"), no).alias("signature_invalid"),
        F.coalesce(~F.col("_mac_ok"), no).alias("hmac_invalid"),
        (~has_sig & ~has_mac).alias("unbound"),
    )


def one_per_key(side: DataFrame, key: str, values: list[str], what: str) -> DataFrame:
    """Equal rows of a lookup table become one; a key with different rows is an error, as it would multiply records."""
    row = F.struct(*values)
    twice = F.raise_error(F.concat(F.lit(f"{what} holds different rows for "), F.col(key).cast("string")))
    one = side.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("_low"), F.max(row).alias("_high"))
    return one.select(key, F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(twice).alias("_row")).select(key, "_row.*")


def _mismatch(records: DataFrame, registry: DataFrame, key: str, expected: str, own: str, flag: str) -> DataFrame:
    side = registry.select(F.col(key).alias("_rk"), F.col(expected).alias("_expected"))
    side = sized_broadcast(one_per_key(side, "_rk", ["_expected"], "registry"))
    joined = records.join(side, F.col(key) == F.col("_rk"), "left")
    differs = F.coalesce(F.lower(own) != F.lower("_expected"), F.lit(False))
    return joined.withColumn(flag, differs).drop("_rk", "_expected")


def check_model_digest(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry: ``model_id, registered_digest``. Unregistered models pass."""
    return _mismatch(records, registry, "model_id", "registered_digest", "model_weight_digest", "model_mismatch")


def check_preprocessing(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry: ``model_id, registered_preprocessing``."""
    return _mismatch(records, registry, "model_id", "registered_preprocessing", "preprocessing_config_hash", "preprocessing_mismatch")


def check_input_image(records: DataFrame, images: DataFrame) -> DataFrame:
    """Images: ``record_id, image_digest`` of the presented input; an empty digest means an unreadable file."""
    return _mismatch(records, images, "record_id", "image_digest", "input_image_hash", "image_mismatch")


def check_clock(records: DataFrame, now: Column, tolerance: float = 300.0) -> DataFrame:
    return records.withColumn("stale", timestamp_skew(F.col("timestamp"), now, tolerance))


def record_links(records: DataFrame, keys: Sequence[str] = STREAM, width: int = WIDTH) -> DataFrame:
    """Add ``link_broken``: the stated previous hash is not the hash of the stream's preceding record."""
    rows = with_previous(records, keys, "arrival", ["record_hash"], width)
    tip = F.col("prev_record_hash")
    broken = tip.isNotNull() & ~tip.eqNullSafe(F.col("previous_record_hash"))
    return rows.withColumn("link_broken", broken).drop("prev_record_hash")


def authentic(rows: DataFrame) -> DataFrame:
    """Add ``authentic``: only such rows may advance sequence state."""
    c = F.col
    forged = c("signature_invalid") | c("hmac_invalid") | c("unbound") | c("link_broken") | c("image_mismatch")
    return rows.withColumn("authentic", ~c("schema_bad") & c("bound") & c("key_error").isNull() & ~forged)


def sequence_state(
    rows: DataFrame, keys: Sequence[str] = STREAM, order: str = "arrival", trusted: str = "authentic", width: int = WIDTH
) -> DataFrame:
    """Add previous accepted sequence number, regression and gap flags.

    A rejected number never exceeds the accepted maximum, so the accepted maximum is the running maximum of
    trusted rows and needs no serial fold.
    """
    seq = F.col("sequence_number")
    running = with_running(rows, keys, order, {"previous_sequence": ("max", F.when(F.col(trusted), seq))}, width)
    before = F.col("previous_sequence")
    checked = F.col(trusted) & before.isNotNull()
    return running.withColumn("sequence_regression", checked & (seq <= before)).withColumn(
        "sequence_gap", checked & (seq > before + 1)
    )


def nonce_replay(
    rows: DataFrame, order: str = "arrival", stores: Column | None = None, checks: Column | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Add ``nonce_replay``: an earlier row already used the nonce.

    ``stores`` selects rows that use a nonce up, ``checks`` rows that are tested. The first use is found by a
    pre-aggregated minimum, so a nonce repeated a billion times is one row before it is joined back.
    """
    stores = F.lit(True) if stores is None else stores
    checks = F.lit(True) if checks is None else checks
    keys = [*scope, "nonce"]
    first = rows.where(stores).groupBy(*keys).agg(F.min(order).alias("_first"))
    joined = rows.join(first, keys, "left")
    replay = checks & F.coalesce(F.col("_first") < F.col(order), F.lit(False))
    return joined.withColumn("nonce_replay", replay).drop("_first").select(*rows.columns, "nonce_replay")


def record_status() -> Column:
    """Outcome by priority: unsupported, tampered, replayed, substituted, key trouble, gap, verified."""
    c = F.col
    tampered = c("signature_invalid") | c("hmac_invalid") | c("unbound") | c("link_broken") | c("image_mismatch")
    return (
        F.when(c("schema_bad"), "UNSUPPORTED")
        .when(tampered, "TAMPERED_OUTPUT")
        .when(c("nonce_replay") | c("sequence_regression") | c("stale"), "REPLAYED_RECORD")
        .when(c("model_mismatch") | c("preprocessing_mismatch"), "SUBSTITUTED_MODEL")
        .when(c("key_error") == "EXPIRED_OR_REVOKED_KEY", "EXPIRED_KEY")
        .when(c("key_error").isNotNull(), "UNVERIFIED_KEY")
        .when(c("sequence_gap"), "VERIFIED_WITH_WARNING")
        .otherwise("VERIFIED")
    )


def record_disposition(status: Column) -> Column:
    return (
        F.when(status.isin("TAMPERED_OUTPUT", "REPLAYED_RECORD", "SUBSTITUTED_MODEL", "EXPIRED_KEY"), "QUARANTINE")
        .when(status.isin("UNVERIFIED_KEY", "UNSUPPORTED", "VERIFIED_WITH_WARNING"), "REVIEW")
        .otherwise("ACCEPT")
    )


def record_findings() -> Column:
    """Findings of a judged record as array<struct>; a schema error hides every other finding."""
    c = F.col
    bad_key = c("key_error") == "EXPIRED_OR_REVOKED_KEY"
    rules = [
        (bad_key, "IT-KEY-EXPIRED", "HIGH", 1.0, "Inactive signing key", "REVIEW"),
        (c("key_error").isNotNull() & ~bad_key, "IT-KEY-UNKNOWN", "MEDIUM", 1.0, "Unknown or missing signing key", "REVIEW"),
        (c("signature_invalid"), "IT-1", "CRITICAL", 1.0, "Invalid signature", "QUARANTINE"),
        (c("hmac_invalid"), "IT-1", "CRITICAL", 1.0, "Invalid HMAC binding", "QUARANTINE"),
        (c("unbound"), "IT-1", "CRITICAL", 1.0, "No cryptographic binding", "QUARANTINE"),
        (c("image_mismatch"), "IT-4", "CRITICAL", 1.0, "Input image digest mismatch", "QUARANTINE"),
        (c("model_mismatch"), "IT-2", "HIGH", 1.0, "Model digest mismatch", "QUARANTINE"),
        (c("preprocessing_mismatch"), "IT-2", "MEDIUM", 1.0, "Preprocessing mismatch", "REVIEW"),
        (c("stale"), "IT-3", "HIGH", 1.0, "Timestamp skew exceeded", "REVIEW"),
        (c("link_broken"), "IT-1", "CRITICAL", 1.0, "Broken record chain link", "QUARANTINE"),
        (c("sequence_regression"), "IT-3", "HIGH", 1.0, "Sequence regression", "QUARANTINE"),
        (c("sequence_gap"), "IT-5", "MEDIUM", 0.85, "Sequence gap", "REVIEW"),
        (c("nonce_replay"), "IT-3", "CRITICAL", 1.0, "Replayed nonce", "QUARANTINE"),
    ]

    def finding(threat: str, severity: str, confidence: float, title: str, advice: str) -> Column:
        return F.struct(
            F.lit(threat).alias("threat_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
            F.lit(title).alias("title"), F.lit(advice).alias("recommended_disposition"),
        )

    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), finding(*rest)) for test, *rest in rules]))
    schema = F.array(finding("IT-SCHEMA-ERR", "HIGH", 1.0, "Unsupported schema version", "REVIEW"))
    return F.when(c("schema_bad"), schema).otherwise(found)


def judge(rows: DataFrame) -> DataFrame:
    """Status, disposition, validity and findings from the flag columns."""
    status = record_status()
    return rows.withColumn("status", status).withColumn("disposition", record_disposition(F.col("status"))).withColumn(
        "is_valid", F.col("status").isin("VERIFIED", "VERIFIED_WITH_WARNING")
    ).withColumn("findings", record_findings())


def stateless_checks(
    records: DataFrame, keys: DataFrame, now: Column, models: DataFrame | None = None,
    preprocessing: DataFrame | None = None, images: DataFrame | None = None,
    tolerance: float = 300.0, verify_signature: SignatureCheck | None = None,
) -> DataFrame:
    """All checks that need no earlier row; valid for batch and streaming records alike."""
    rows = records.withColumn("schema_bad", F.coalesce(F.col("schema_version") != "1.0", F.lit(True)))
    rows = bind(join_keys(rows, keys, now), verify_signature)
    for registry, check, flag in (
        (models, check_model_digest, "model_mismatch"),
        (preprocessing, check_preprocessing, "preprocessing_mismatch"),
        (images, check_input_image, "image_mismatch"),
    ):
        rows = rows.withColumn(flag, F.lit(False)) if registry is None else check(rows, registry)
    return check_clock(rows, now, tolerance)


def verify_records(
    records: DataFrame, keys: DataFrame, now: Column, models: DataFrame | None = None,
    preprocessing: DataFrame | None = None, images: DataFrame | None = None, tolerance: float = 300.0,
    verify_signature: SignatureCheck | None = None, check_links: bool = False, check_replay: bool = True,
    nonce_from: str = "all", nonce_scope: Sequence[str] = (), width: int = WIDTH, materialize: bool = True,
) -> DataFrame:
    """Full verification of a batch. ``nonce_from='trusted'`` lets only authentic records use a nonce up.

    The state checks read the flags several times. ``materialize`` writes the stateless result, without the
    free-form payload columns, to the checkpoint folder so that payloads are serialised and hashed once.
    """
    rows = stateless_checks(records, keys, now, models, preprocessing, images, tolerance, verify_signature)
    if materialize and (check_links or check_replay):
        rows = cut_lineage(rows.drop("inference_config", "output"))
    rows = record_links(rows, width=width) if check_links else rows.withColumn("link_broken", F.lit(False))
    rows = authentic(rows)
    if check_replay:
        rows = sequence_state(rows, width=width)
        named = ~F.col("schema_bad") & (F.coalesce(F.col("signing_key_id"), F.lit("")) != "")
        stores = named if nonce_from == "all" else F.col("authentic")
        rows = nonce_replay(rows, stores=stores, checks=named, scope=nonce_scope)
    else:
        for flag in ("sequence_regression", "sequence_gap", "nonce_replay"):
            rows = rows.withColumn(flag, F.lit(False))
    return judge(rows)


def records_to_findings(judged: DataFrame) -> DataFrame:
    """Long findings table in the assurance layout."""
    long = judged.select("record_id", "session_id", "arrival", F.posexplode("findings").alias("_no", "f"))
    return long.select(
        F.concat_ws("-", "record_id", "_no").alias("finding_id"), F.col("session_id").alias("asset_id"), "session_id",
        "f.threat_id", F.lit("INFERENCE_PROVENANCE").alias("category"), "f.severity", "f.confidence",
        "f.recommended_disposition", F.col("arrival").alias("ord"), "f.title",
    )


def sign_records(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Fill ``binding_hmac`` over the canonical payload with the record's key; pads are built once per key."""
    side = sized_broadcast(keys.select(F.col("key_id").alias("_kid"), hmac_pads(F.col("secret")).alias("_pads")))
    rows = records.join(side, F.col("signing_key_id") == F.col("_kid"), "left")
    rows = add_payload(rows, "_payload")
    return rows.withColumn("binding_hmac", hmac_sha256(F.col("_pads"), F.encode("_payload", "UTF-8"))).drop("_kid", "_pads", "_payload")
