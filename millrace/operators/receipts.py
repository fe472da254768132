"""Rotation receipts: signing, and verification against the audit chains that record them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from . import audit

ACTION = "rotation_receipt"
FIELDS = ("chain_id", "audit_seq", "receipt_id", "receipt_hash", "lineage_hash", "status", "signed_by", "baseline_seq", "baseline_id", "baseline_hash")


def event_body(tenant: Column) -> Column:
    """The audit body that records a receipt."""
    return audit.body(action=F.lit(ACTION), principal=F.col("signed_by"), target=F.col("receipt_id"), tenant=tenant, receipt_hash=F.col("receipt_hash"), lineage_hash=F.col("lineage_hash"), status=F.col("status"))


def sealed(drafts: DataFrame, key: bytes) -> DataFrame:
    """Adds `signature` over all FIELDS of a receipt."""
    return drafts.withColumn("signature", crypto.signature(key, audit.body(**{f: F.col(f) for f in FIELDS})))


def verified(receipts: DataFrame, chain: DataFrame, key: bytes, tenant: str) -> DataFrame:
    """For each receipt: signature_valid, audit_event_valid, audit_chain_valid, baseline_valid and ok (all four).

    The event at the receipt's place of its chain must say just what the receipt says. A receipt that names no baseline
    must be the first that its chain records for the lineage; another must name an earlier receipt's place, id and hash.
    What is null, unknown or of another tenant is not valid; receipts repeated whole stay repeated. The chain is read by
    key, its statuses and first receipts are aggregated before they are joined, so no task holds a chain.
    """
    told = lambda name: F.get_json_object("body", f"$.{name}")
    rows = chain.select("chain_id", "seq", "body")
    own = rows.where((told("action") == ACTION) & (told("tenant") == tenant)).select("chain_id", "seq", told("target").alias("_id"), told("receipt_hash").alias("_hash"), told("lineage_hash").alias("lineage_hash"))
    first = rows.where(told("action") == ACTION).groupBy("chain_id", told("lineage_hash").alias("lineage_hash")).agg(F.min("seq").alias("_first"))
    status = audit.chain_status(chain).select("chain_id", F.col("ok").alias("_chain"))
    out = receipts.join(rows.select("chain_id", F.col("seq").alias("audit_seq"), F.col("body").alias("_body")), ["chain_id", "audit_seq"], "left")
    out = out.join(own.select("chain_id", F.col("seq").alias("baseline_seq"), "_id", "_hash"), ["chain_id", "baseline_seq"], "left")
    out = out.join(first, ["chain_id", "lineage_hash"], "left").join(status, "chain_id", "left")
    follows = (F.col("baseline_seq") < F.col("audit_seq")) & (F.col("_id") == F.col("baseline_id")) & (F.col("_hash") == F.col("baseline_hash"))
    leads = F.col("baseline_id").isNull() & F.col("baseline_hash").isNull() & F.col("lineage_hash").isNotNull() & (F.col("_first").isNull() | (F.col("_first") >= F.col("audit_seq")))
    checks = {
        "signature_valid": F.col("signature") == crypto.signature(key, audit.body(**{f: F.col(f) for f in FIELDS})),
        "audit_event_valid": F.col("_body") == event_body(F.lit(tenant)),
        "audit_chain_valid": F.col("_chain"),
        "baseline_valid": F.when(F.col("baseline_seq").isNull(), leads).otherwise(follows),
    }
    out = out.select("chain_id", "audit_seq", "receipt_id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()))
    return out.withColumn("ok", F.col("signature_valid") & F.col("audit_event_valid") & F.col("audit_chain_valid") & F.col("baseline_valid"))
