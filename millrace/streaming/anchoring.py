"""Anchors as a stream: the heads of audit chains go to an anchor log as their rows come, by number of rows or by time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anchors, audit
from ..sources.anchor_log import AnchorLog


def due_heads(heads: DataFrame, log: DataFrame, now: float, every_rows: int = audit.EVERY_ROWS, every_seconds: float = audit.EVERY_SECONDS) -> DataFrame:
    """Of heads (chain_id, seq, row_hash) those whose chain has no anchor, or enough rows or time since its last one; chain numbers have no gaps."""
    last = log.where((F.col("record_type") == anchors.ANCHOR) & F.col("error").isNull()).groupBy("chain_id").agg(F.max("seq").alias("_seq"), F.max_by("created_at_utc", "seq").alias("_at"))
    rows = heads.join(last, "chain_id", "left")
    seconds = F.lit(now) - F.unix_micros(F.try_to_timestamp("_at")) / 1e6
    return rows.where(F.col("_seq").isNull() | audit.cadence_due(F.col("seq") - F.col("_seq"), seconds, every_rows, every_seconds)).select(heads.columns)


def anchored(chain: DataFrame, log: AnchorLog, every_rows: int = audit.EVERY_ROWS, every_seconds: float = audit.EVERY_SECONDS):
    """A writer for a stream of chain rows (chain_id, seq, row_hash): start it with a checkpoint.

    Each batch anchors the chains that fall due in it, through `log.attempt`, so a log that fails stops no stream; the chain comes again with its next rows.
    A batch that is run again finds its anchors known.
    """
    receipts: list[dict] = []

    def write(batch: DataFrame, _: int) -> None:
        heads = batch.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("row_hash", "seq").alias("row_hash"))
        now = log.clock()
        receipts.append(log.attempt(lambda: log.anchor(due_heads(heads, log.checked(), now, every_rows, every_seconds), now)))
        del receipts[:-100]

    writer = chain.writeStream.foreachBatch(write)
    writer.receipts = receipts
    return writer
