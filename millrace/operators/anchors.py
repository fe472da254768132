"""Anchor logs: signed records of chain heads and of manifest digests, their rules, and what an append may do.

A record is one line of canonical JSON (keys in order, no blanks). Lines of a log come as value and `place`, which
orders them; all else here is per line, or aggregated by chain or manifest before it is joined.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crypto

ANCHOR, PIN = "audit_anchor", "manifest_pin"
VERSION = 1
DOMAINS = {ANCHOR: "millrace.audit-anchor.v1", PIN: "millrace.manifest-pin.v1"}
_SHARED = ("chain_id", "created_at_utc", "domain", "record_type", "schema_version", "sink_id", "signing_key_id", "verification_root_fingerprint")
OWN = {ANCHOR: ("anchor_id", "row_hash", "seq"), PIN: ("manifest_digest", "manifest_id", "pin_id")}
_TYPES = {"seq": "long", "schema_version": "int"}
#: Columns of a parsed record.
SCHEMA = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in sorted({*_SHARED, *OWN[ANCHOR], *OWN[PIN], "signature"}))
# Forms of the fields.
DIGEST, ROW_HASH, UTC = "^sha256:[0-9a-f]{64}$", "^[0-9a-f]{64}$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"
IDS = {"chain_id": "^chain_[0-9a-f]{32}$", "anchor_id": "^anc_[0-9a-f]{24}$", "pin_id": "^pin_[0-9a-f]{24}$", "manifest_id": "^sct_[0-9a-f]{24}$"}


def key_of(root: bytes, sink_id: str) -> bytes:
    """The key that signs the records of a sink."""
    return crypto.derived_key(root, f"anchor-log:{sink_id}")


def fingerprint(key: bytes) -> str:
    """What a verifier pins of a signing key; it tells nothing of the key."""
    return "sha256:" + crypto.derived_key(key, "fingerprint").hex()


def minted(prefix: str, *parts: Column) -> Column:
    """An id made of its parts, so that a task that runs again makes the same one."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), F.lit(24)))


def utc_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _body(kind: str, *more: str) -> Column:
    return F.to_json(F.struct(*sorted((*_SHARED, *OWN[kind], *more))))


def _sealed(kind: str) -> Column:
    """What is signed: the domain, a zero byte, and the record without its signature."""
    return F.concat(F.lit(DOMAINS[kind] + "\0"), _body(kind))


def _signed(rows: DataFrame, kind: str, key: bytes, sink_id: str, key_id: str, keep: tuple[str, ...]) -> DataFrame:
    told = {"domain": DOMAINS[kind], "record_type": kind, "schema_version": VERSION, "sink_id": sink_id, "signing_key_id": key_id, "verification_root_fingerprint": fingerprint(key)}
    rows = rows.withColumns({k: F.lit(v) for k, v in told.items()})
    return rows.withColumn("signature", crypto.signature(key, _sealed(kind))).select(*keep, _body(kind, "signature").alias("value"))


def anchor_lines(heads: DataFrame, key: bytes, sink_id: str, key_id: str = "k1", keep: tuple[str, ...] = ()) -> DataFrame:
    """A signed line for each head (chain_id, seq, row_hash, ts), after its columns to keep."""
    rows = heads.select(*keep, "chain_id", F.col("seq").cast("long").alias("seq"), "row_hash", utc_text(F.col("ts")).alias("created_at_utc"))
    return _signed(rows.withColumn("anchor_id", minted("anc_", F.lit(sink_id), F.col("chain_id"), F.col("seq"), F.col("row_hash"))), ANCHOR, key, sink_id, key_id, keep)


def pin_lines(manifests: DataFrame, key: bytes, sink_id: str, key_id: str = "k1", keep: tuple[str, ...] = ()) -> DataFrame:
    """A signed line for each manifest (chain_id, manifest_id, manifest_digest, ts), after its columns to keep."""
    rows = manifests.select(*keep, "chain_id", "manifest_id", "manifest_digest", utc_text(F.col("ts")).alias("created_at_utc"))
    return _signed(rows.withColumn("pin_id", minted("pin_", F.lit(sink_id), F.col("chain_id"), F.col("manifest_id"), F.col("manifest_digest"))), PIN, key, sink_id, key_id, keep)


def parsed(lines: DataFrame, key: bytes, sink_id: str, roots: list[str]) -> DataFrame:
    """The lines' other columns, the record's fields, and `error`: the first rule that a line breaks, null for a good one.

    In order: malformed (no object, other or repeated keys, other types, a cut tail, not canonical), record_type, domain,
    chain_id, sink_id, id, seq, row_hash, manifest_id, manifest_digest, created_at, root (not that of the key), untrusted_root
    (none of `roots`), signing_key_id, signature. A null line is malformed.
    """
    rest = [c for c in lines.columns if c != "value"]
    rows = lines.withColumn("_r", F.from_json("value", SCHEMA)).select(*(F.col(c).alias(f"_own_{c}") for c in rest), "value", "_r.*")
    kind, no = F.col("record_type"), lambda c: ~F.coalesce(c, F.lit(False))
    of = lambda f: F.when(kind == ANCHOR, f(ANCHOR)).when(kind == PIN, f(PIN))
    like = lambda name, form: no(F.col(name).rlike(form))
    anchor, pin = kind == ANCHOR, kind == PIN
    known = F.coalesce(anchor | pin, F.lit(False))
    rules = (
        (kind.isNull(), "malformed"), (~known, "record_type"), (no(F.col("value") == of(lambda k: _body(k, "signature"))), "malformed"),
        (no(F.col("domain") == of(lambda k: F.lit(DOMAINS[k]))) | no(F.col("schema_version") == VERSION), "domain"), (like("chain_id", IDS["chain_id"]), "chain_id"), (no(F.col("sink_id") == sink_id), "sink_id"),
        (anchor & like("anchor_id", IDS["anchor_id"]) | pin & like("pin_id", IDS["pin_id"]), "id"), (anchor & no(F.col("seq") > 0), "seq"), (anchor & like("row_hash", ROW_HASH), "row_hash"),
        (pin & like("manifest_id", IDS["manifest_id"]), "manifest_id"), (pin & like("manifest_digest", DIGEST), "manifest_digest"),
        (like("created_at_utc", UTC) | F.try_to_timestamp("created_at_utc").isNull(), "created_at"), (no(F.col("verification_root_fingerprint") == fingerprint(key)), "root"),
        (~F.col("verification_root_fingerprint").isin(*roots) if roots else F.lit(True), "untrusted_root"), (no(F.col("signing_key_id") != ""), "signing_key_id"),
        (no(F.col("signature") == of(lambda k: crypto.signature(key, _sealed(k)))), "signature"),
    )
    error = F
    for broken, name in rules:
        error = error.when(broken, name)
    fields = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return rows.select(*(F.col(f"_own_{c}").alias(c) for c in rest), "value", *fields, error.otherwise(F.lit(None)).alias("error"))


def outcomes(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds `outcome` to good records that are to be appended to a log of good records: append, known, reordered or conflicting.

    An anchor behind its chain's last one is reordered; at its place it is known, or conflicting with another hash. A pin whose
    manifest is pinned is known, or conflicting with another digest. Records that come together are held against each other alike:
    of equal ones the first line by text is appended. The last of a chain is the one of the latest place, then of the highest seq.
    """
    last = log.where(F.col("record_type") == ANCHOR).groupBy("chain_id").agg(F.max_by(F.struct("seq", "row_hash"), F.struct("place", "seq")).alias("_last"))
    held = log.where(F.col("record_type") == PIN).groupBy("chain_id", "manifest_id").agg(F.min("manifest_digest").alias("_low"), F.max("manifest_digest").alias("_high"))
    anchor = F.col("record_type") == ANCHOR
    same = ["record_type", "chain_id", "seq", "manifest_id"]
    told = F.coalesce("row_hash", "manifest_digest")
    own = Window.partitionBy(*same)
    rows = incoming.withColumn("_differ", F.min(told).over(own) != F.max(told).over(own)).withColumn("_nth", F.row_number().over(own.orderBy("value")))
    rows = rows.join(last, "chain_id", "left").join(held, ["chain_id", "manifest_id"], "left")
    outcome = (
        F.when(F.col("_differ"), "conflicting")
        .when(anchor & (F.col("seq") < F.col("_last.seq")), "reordered")
        .when(anchor & (F.col("seq") == F.col("_last.seq")), F.when(F.col("row_hash") == F.col("_last.row_hash"), "known").otherwise("conflicting"))
        .when(~anchor & F.col("_low").isNotNull(), F.when((F.col("_low") == F.col("manifest_digest")) & (F.col("_high") == F.col("manifest_digest")), "known").otherwise("conflicting"))
        .when(F.col("_nth") > 1, "known").otherwise("append")
    )
    return rows.select(*incoming.columns, outcome.alias("outcome"))


def resolved(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """Adds manifest_digest and `error` (not_pinned, or duplicated: pinned more than once) to rows of chain_id and manifest_id."""
    pins = log.where((F.col("record_type") == PIN) & F.col("error").isNull()).groupBy("chain_id", "manifest_id").agg(F.count("*").alias("_n"), F.min("manifest_digest").alias("_digest"))
    error = F.when(F.col("_n").isNull(), "not_pinned").when(F.col("_n") > 1, "duplicated")
    out = wanted.join(pins, ["chain_id", "manifest_id"], "left")
    return out.select(*wanted.columns, F.when(error.isNull(), F.col("_digest")).alias("manifest_digest"), error.alias("error"))
