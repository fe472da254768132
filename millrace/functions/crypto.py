"""Keys, encryption, signatures: AES-GCM by the engine's own functions, HMAC-SHA256 from nested hashes."""

import hashlib
import hmac
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def derived_key(root: bytes, info: str, size: int = 32) -> bytes:
    """HKDF-SHA256 without salt."""
    pseudo = hmac.new(b"\0" * 32, root, hashlib.sha256).digest()
    out, block, n = b"", b"", 0
    while len(out) < size:
        n += 1
        block = hmac.new(pseudo, block + info.encode() + bytes([n]), hashlib.sha256).digest()
        out += block
    return out[:size]


def hidden(value: bytes) -> Column:
    """The bytes as a column that plans, logs and the UI show as a subquery's number alone."""
    return SparkSession.active().createDataFrame([(bytearray(value),)], "k binary").scalar()


def wrapped(key: Column, root: bytes, tenant: str) -> Column:
    """A data key under the tenant's key, itself derived from the root."""
    return F.aes_encrypt(key, hidden(derived_key(root, f"wrap:{tenant}")), F.lit("GCM"))


def unwrapped(key: Column, root: bytes, tenant: str) -> Column:
    """The data key; null if the root or the tenant is not the right one."""
    return F.try_aes_decrypt(key, hidden(derived_key(root, f"wrap:{tenant}")), F.lit("GCM"))


def subject_keys(records: DataFrame) -> DataFrame:
    """A random key for each tenant and subject: tenant, subject, dek, state.

    Nothing else can make a key again, so to shred it is to lose it. Each evaluation makes other keys: write
    the rows, or cut their lineage, before anything is encrypted under them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([secrets.token_bytes(32) for _ in range(b.num_rows)], pa.binary()), pa.array(["active"] * b.num_rows, pa.string())], ["tenant", "subject", "dek", "state"])

    return records.select("tenant", "subject").distinct().mapInArrow(run, "tenant string, subject string, dek binary, state string")


def shredded(keys: DataFrame, tenant: str, subject: str) -> DataFrame:
    hit = (F.col("tenant") == tenant) & (F.col("subject") == subject)
    return keys.withColumn("state", F.when(hit, "shredded").otherwise(F.col("state"))).withColumn("dek", F.when(hit, None).otherwise(F.col("dek")))


def encrypted(records: DataFrame, keys: DataFrame, column: str = "content", unwrap: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """The column under its subject's key, as content_enc; null without a key, so refuse such rows first. unwrap: the stored key to the plain one."""
    joined = records.join(keys.select("tenant", "subject", "dek"), ["tenant", "subject"], "left")
    return joined.withColumn("content_enc", F.aes_encrypt(F.col(column).cast("binary"), unwrap(F.col("dek")), F.lit("GCM"))).drop(column, "dek")


def decrypted(records: DataFrame, keys: DataFrame, column: str = "content", unwrap: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """The text; null where the key is shredded or wrong."""
    joined = records.join(keys.select("tenant", "subject", "dek"), ["tenant", "subject"], "left")
    return joined.withColumn(column, F.decode(F.try_aes_decrypt("content_enc", unwrap(F.col("dek")), F.lit("GCM")), "UTF-8")).drop("dek")


def key_census(keys: DataFrame, root_present: bool = False) -> DataFrame:
    """Per tenant: active, wrapped, raw and shredded keys, and whether nothing can be read any more. Wrapped keys are longer than 32 bytes."""
    active = (F.col("state") != "shredded") & F.col("dek").isNotNull()
    raw = active & (F.length("dek") <= 32)
    return keys.groupBy("tenant").agg(
        F.count_if(active).alias("active"), F.count_if(active & (F.length("dek") > 32)).alias("wrapped"), F.count_if(raw).alias("raw"), F.count_if(F.col("state") == "shredded").alias("shredded"),
        (F.lit(not root_present) & (F.count_if(raw) == 0)).alias("proved"),
    )


def erase_proof(keys: DataFrame, root_present: bool) -> DataFrame:
    """The census of each tenant with `reason`: why its texts cannot be read any more, or still can."""
    present = F.lit(root_present)
    reason = F.when(present, "root still present").when(F.col("raw") > 0, "raw active keys remain").otherwise("root absent and no raw active keys remain")
    return key_census(keys, root_present).withColumn("reason", reason)


def payload(record_id: Column, content_hash: Column, uri: Column, created_by: Column, epistemic: Column) -> Column:
    """What a producer signs; lengths keep neighbouring fields apart."""
    parts = [F.coalesce(c, F.lit("")) for c in (record_id, content_hash, uri, created_by, epistemic)]
    return F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p, F.lit("|"))))


def signature(key: bytes, text: Column) -> Column:
    """hmac-sha256: and the hex digest of HMAC over the text."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (hidden(bytes(a ^ x for a in key.ljust(64, b"\0"))) for x in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))
    return F.concat(F.lit("hmac-sha256:"), F.sha2(F.concat(outer, digest), 256))


def signature_fingerprint(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))
