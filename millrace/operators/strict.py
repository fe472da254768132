"""Strict reading: every record in one bucket of integrity, exemptions, and what a result may hold."""

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions.text import any_of
from . import audit

VALID = "valid"
# Buckets that may be exempted, and those that mean tampering or errors.
CANDIDATES = ("unverifiable_hmac", "unverifiable_missing_key")
FAILURES = ("malformed_row", "decrypt_failure", "content_hash_mismatch", "algorithm_downgrade", "bad_signature")
BUCKETS = (VALID, *CANDIDATES, *FAILURES)


def classified(records: DataFrame, registry: DataFrame, key: bytes) -> DataFrame:
    """Adds `bucket`: columns content (null: cannot be decrypted), content_hash, producer_sig and the signed fields.

    registry: (tenant, principal, algorithm). Signatures made by the strong algorithm start with strong-hmac:.
    """
    algorithms = registry.groupBy("tenant", F.col("principal").alias("created_by")).agg(F.collect_set("algorithm").alias("_algorithms"))
    out = records.join(algorithms, ["tenant", "created_by"], "left")
    has = lambda a: F.coalesce(F.array_contains("_algorithms", a), F.lit(False))
    sig = F.col("producer_sig")
    actual = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    expected = F.replace(crypto.signature(key, crypto.payload(F.col("id"), F.col("content_hash"), F.col("uri"), F.col("created_by"), F.col("epistemic"))), F.lit("hmac-sha256:"), F.lit("strong-hmac:"))
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in ("id", "tenant", "created_by", "epistemic", "content_hash", "producer_sig", "subject"))) == 1
    bucket = (
        F.when(missing, "malformed_row").when(F.col("content").isNull(), "decrypt_failure").when(actual != F.col("content_hash"), "content_hash_mismatch")
        .when(sig.startswith("hmac-sha256:"), F.when(has("strong") & ~has("hmac-sha256"), "algorithm_downgrade").otherwise("unverifiable_hmac"))
        .when(~sig.startswith("strong-hmac:"), "malformed_row").when(~has("strong"), "unverifiable_missing_key").when(sig == expected, VALID).otherwise("bad_signature")
    )
    return out.withColumn("bucket", bucket).drop("_algorithms")


def bucket_counts(checked: DataFrame) -> DataFrame:
    """A count for every bucket, zeros too, and of failures; the buckets add up to the rows."""
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    return checked.agg(F.count("*").alias("rows"), *counts, F.count_if(F.col("bucket").isin(*FAILURES)).alias("failures"))


def exempted(checked: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds `exempt`: the record stands in the manifest with the same tenant, content hash, bucket and signature fingerprint."""
    keys = ["id", "tenant", "content_hash", "signature_fingerprint", "bucket"]
    own = checked.withColumn("signature_fingerprint", crypto.signature_fingerprint(F.col("producer_sig")))
    return own.join(manifest.select(*keys).distinct().withColumn("_m", F.lit(True)), keys, "left").withColumn("exempt", F.coalesce("_m", F.lit(False)) & F.col("bucket").isin(*CANDIDATES)).drop("_m")


def readable(checked: DataFrame) -> Column:
    return (F.col("bucket") == VALID) | F.col("exempt")


def strict_result(ranked: DataFrame, mode: str) -> DataFrame:
    """off: all rows; filter: only readable ones, nothing moves up; enforce: an error that counts the buckets if any is not."""
    if mode == "off":
        return ranked
    if mode == "filter":
        return ranked.where(readable(ranked))
    refused = ranked.where(~readable(ranked)).groupBy("bucket").count().orderBy("bucket").collect()
    if refused:
        raise PermissionError("strict: " + ", ".join(f"{r['bucket']} {r['count']}" for r in refused))
    return ranked


def baseline_valid(receipts: DataFrame) -> DataFrame:
    """Adds `valid` to rotation receipts (seq, receipt_id, receipt_hash, lineage_hash, baseline_seq, baseline_id, baseline_hash).

    One that names no baseline must be the first of its lineage; another must name an earlier receipt as it stands.
    """
    first = receipts.groupBy("lineage_hash").agg(F.min("seq").alias("_first"))
    named = receipts.select(F.col("seq").alias("baseline_seq"), F.col("receipt_id").alias("_id"), F.col("receipt_hash").alias("_hash"))
    out = receipts.join(first, "lineage_hash").join(named, "baseline_seq", "left")
    follows = (F.col("baseline_seq") < F.col("seq")) & (F.col("_id") == F.col("baseline_id")) & (F.col("_hash") == F.col("baseline_hash"))
    valid = F.when(F.col("baseline_seq").isNull(), F.col("seq") == F.col("_first")).otherwise(F.coalesce(follows, F.lit(False)))
    return out.withColumn("valid", valid).drop("_first", "_id", "_hash")


def probe_status(cases: DataFrame) -> DataFrame:
    """Per probe: FAIL if a contract or control case is off, else DEGRADED if a boundary case is, else PASS."""
    off = lambda *kinds: F.coalesce(F.bool_or(F.col("case_type").isin(*kinds) & ~F.col("matches")), F.lit(False))
    return cases.groupBy("probe").agg(F.when(off("contract", "positive_control"), "FAIL").when(off("boundary"), "DEGRADED").otherwise("PASS").alias("status"), F.count("*").alias("cases"))


# Phrases that a text must not use, and those that need a disclaimer on their line or the one before.
BANNED = (r"guarantee[ds]?", r"guaranteed", r"unbreakable", r"zero[\s_-]?knowledge", r"provabl[ey][\s_-]+eras", r"military[\s_-]?grade", r"100%\s+secure", r"cannot\s+be\s+decrypted", r"not\s+a\s+single\s+byte")
GUARDED = (r"recall[\s_-]?exclusion", r"authorization[\s_-]?integrity", r"tamper[\s_-]?proof", r"db[\s_-]?compromise[\s_-]?resistance", r"database[\s_-]?compromise[\s_-]?resistance")
DISCLAIMER = r"(?i)\bnot\b|\bno\b|\bnor\b|\bcannot\b|\bwithout\b|\boutside\b|\bnon\b|\bnever\b|not_claimed|non-claim|boundary|\bassume"
NEARBY = ("tamper-evident", "tamper evident", "tamper_evidence", "tamper evidence")


def claim_lint(texts: DataFrame) -> DataFrame:
    """id, line (from 1), term of each forbidden phrase in a text: columns id, text. A line counts once for a term."""
    lines = texts.select("id", F.split("text", "\n").alias("_l")).select("id", F.posexplode("_l").alias("n", "raw"), "_l")
    rows = lines.select("id", (F.col("n") + 1).alias("line"), F.lower("raw").alias("low"), F.concat(F.coalesce(F.lower(F.get("_l", F.col("n") - 1)), F.lit("")), F.lit(" "), F.lower("raw")).alias("context"))
    hard = [F.when(F.col("low").rlike(p), F.lit(f"hard-banned:{p}")) for p in BANNED]
    # a guarded phrase is calm if every place of it has an allowed phrase within 40 characters
    loud = lambda p: F.exists(F.regexp_extract_all("low", F.lit(f".{{0,40}}(?:{p}).{{0,40}}"), 0), lambda w: ~any_of(F.contains(w, F.lit(a)) for a in NEARBY))
    soft = [F.when(F.col("low").rlike(p) & loud(p) & ~F.col("context").rlike(DISCLAIMER), F.lit(f"unguarded-claim:{p}")) for p in GUARDED]
    return rows.select("id", "line", F.explode(F.filter(F.array(*hard, *soft), lambda x: x.isNotNull())).alias("term"))


OUTCOMES = {"passed": "PASS", "degraded": "DEGRADED", "failed": "FAILED"}


def rotation_reconciled(cases: DataFrame, summaries: DataFrame) -> DataFrame:
    """Adds `error` to each receipt's summary (receipt_id, passed, degraded, failed) by its cases (receipt_id, case_id, after).

    duplicate_case_id, then summary_mismatch where the counts of outcomes are not the summary's; a receipt without cases is cases.
    """
    by_case = cases.groupBy("receipt_id", "case_id").agg(F.count("*").alias("_n"), *(F.count_if(F.col("after") == v).alias(f"_{k}") for k, v in OUTCOMES.items()))
    told = by_case.groupBy("receipt_id").agg(F.max("_n").alias("_most"), *(F.sum(f"_{k}").alias(f"_{k}") for k in OUTCOMES))
    same = F.lit(True)
    for k in OUTCOMES:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = summaries.join(told, "receipt_id", "left")
    return out.withColumn("error", F.when(F.col("_most").isNull(), "cases").when(F.col("_most") > 1, "duplicate_case_id").when(~same, "summary_mismatch")).drop("_most", "_passed", "_degraded", "_failed")


MODES = ("off", "filter", "enforce")
ENTRIES = ("id", "tenant", "content_hash", "signature_fingerprint", "bucket")


def mode_of(value: str | None, custody: bool) -> str:
    """The strict mode that a setting names (none: off); enforcing needs signing keys in custody."""
    mode = (value or "off").strip().lower()
    if mode not in MODES:
        raise ValueError("strict mode must be one of " + ", ".join(MODES))
    if mode == "enforce" and not custody:
        raise PermissionError("strict mode enforce needs keys in custody")
    return mode


def _canonical(value: dict) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def manifest_digest(manifest: dict) -> str:
    """What is pinned of a manifest: all of it, its signature too."""
    return "sha256:" + hashlib.sha256(_canonical(manifest)).hexdigest()


def _seal(manifest: dict, key: bytes) -> str:
    return "hmac-sha256:" + hmac.new(crypto.derived_key(key, "strict-manifest"), _canonical({k: v for k, v in manifest.items() if k != "signature"}), hashlib.sha256).hexdigest()


def signed_manifest(entries: DataFrame, chain_id: str, approved_seq: int, key: bytes) -> dict:
    """The manifest of a table of exemptions (ENTRIES): how many, their digest, the head of the chain that was approved, signed."""
    rows = entries.select(*ENTRIES)
    told = {"schema_version": 1, "chain_id": chain_id, "approved_seq": approved_seq, "rows": rows.count(), "entries_digest": audit.content_digest(rows)}
    told["manifest_id"] = "sct_" + hashlib.sha256(_canonical(told)).hexdigest()[:24]
    return {**told, "signature": _seal(told, key)}


def manifest_error(manifest: dict, entries: DataFrame, key: bytes, pinned: str | None) -> str | None:
    """The first rule that a manifest breaks: fields, signature, not_pinned, pin, bucket, duplicate_id, rows, digest; null if it may be used."""
    fields = {"schema_version", "chain_id", "approved_seq", "rows", "entries_digest", "manifest_id", "signature"}
    if set(manifest) != fields or manifest["schema_version"] != 1:
        return "fields"
    if not hmac.compare_digest(str(manifest["signature"]), _seal(manifest, key)):
        return "signature"
    if pinned is None:
        return "not_pinned"
    if pinned != manifest_digest(manifest):
        return "pin"
    rows = entries.select(*ENTRIES)
    seen = rows.groupBy("id").agg(F.count("*").alias("_n"), F.bool_and(F.col("bucket").isin(*CANDIDATES)).alias("_ok")).agg(F.sum("_n").alias("n"), F.max("_n").alias("most"), F.bool_and(F.coalesce("_ok", F.lit(False))).alias("ok")).first()
    if seen["n"] and not seen["ok"]:
        return "bucket"
    if (seen["most"] or 0) > 1:
        return "duplicate_id"
    if (seen["n"] or 0) != manifest["rows"]:
        return "rows"
    return None if audit.content_digest(rows) == manifest["entries_digest"] else "digest"
