"""An anchor log on a file system: numbered batches of signed lines that are never changed."""

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors, audit, contracts, graph
from . import files


class Refused(RuntimeError):
    """A log or an append breaks a rule; nothing has been appended."""


class AnchorLog:
    """Batches under `root`, each made once under the next number; what is appended is read back and held against what was sent.

    Each append checks all lines of the log, so append for many chains at once.
    """

    def __init__(self, spark: SparkSession, root: str, key: bytes, sink_id: str, roots: list[str] | None = None, backoff: float = 1.0, most_backoff: float = 60.0, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.sink_id = spark, root.rstrip("/"), sink_id
        self.key = anchors.key_of(key, sink_id)
        self.roots = [anchors.fingerprint(self.key)] if roots is None else roots
        self.backoff, self.most_backoff, self.clock = backoff, most_backoff, clock
        self.failures, self.next_try = 0, 0.0

    def batches(self) -> list[int]:
        return [int(n.removeprefix("batch-")) for n in files.names(self.spark, self.root) if n.startswith("batch-")]

    def _folder(self, n: int) -> str:
        return f"{self.root}/batch-{n:012d}"

    def lines(self, batches: list[int]) -> DataFrame:
        """value and place (the number of its batch)."""
        if not batches:
            return self.spark.createDataFrame([], "value string, place long")
        place = F.regexp_extract(F.col("_metadata.file_path"), r"batch-(\d+)/", 1).cast("long")
        return self.spark.read.text([self._folder(n) for n in batches]).select("value", place.alias("place"))

    def records(self, batches: list[int] | None = None) -> DataFrame:
        return anchors.parsed(self.lines(self.batches() if batches is None else batches), self.key, self.sink_id, self.roots)

    def checked(self, batches: list[int] | None = None) -> DataFrame:
        """All records; an error if any line breaks a rule or a manifest is pinned twice."""
        rows = graph.cut(self.records(batches))
        self._sound(rows, "log")
        twice = rows.where(F.col("record_type") == anchors.PIN).groupBy("chain_id", "manifest_id").count().where("count > 1")
        if not twice.isEmpty():
            raise Refused("log: a manifest is pinned more than once")
        return rows

    def _sound(self, rows: DataFrame, what: str) -> None:
        bad = rows.where("error IS NOT NULL").groupBy("error").count().orderBy("error").collect()
        if bad:
            raise Refused(f"{what}: " + ", ".join(f"{r['error']} {r['count']}" for r in bad))

    def append(self, lines: DataFrame) -> dict[str, int]:
        """Appends signed lines (value); counts by outcome. Any line that may not be appended refuses them all; what is known is not repeated."""
        incoming = graph.cut(anchors.parsed(lines.select("value"), self.key, self.sink_id, self.roots))
        self._sound(incoming, "append")
        before = self.batches()
        told = graph.cut(anchors.outcomes(self.checked(before), incoming))
        counts = {r["outcome"]: r["count"] for r in told.groupBy("outcome").count().collect()}
        refused = {k: counts[k] for k in ("conflicting", "reordered") if k in counts}
        if refused:
            raise Refused("append: " + ", ".join(f"{k} {n}" for k, n in refused.items()))
        if not counts.get("append"):
            return counts
        n = max(before, default=0) + 1
        new = told.where("outcome = 'append'").select("value")
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        new.write.text(draft)
        if not files.published(self.spark, draft, self._folder(n)):
            raise Refused(f"append: batch {n} has been made by another writer")
        again = self.lines([n]).select("value")
        if audit.content_digest(again) != audit.content_digest(new):
            raise Refused(f"append: batch {n} does not read back as it was sent")
        return counts

    def anchor(self, chains: DataFrame, ts: float | None = None) -> dict[str, int]:
        """Appends the head of every chain (chain_id, seq, row_hash and the rest of an audit chain)."""
        at = F.timestamp_micros(F.lit(int((self.clock() if ts is None else ts) * 1e6)))
        heads = chains.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("row_hash", "seq").alias("row_hash")).withColumn("ts", at)
        return self.append(anchors.anchor_lines(heads, self.key, self.sink_id))

    def pin(self, chain_id: str, manifest_id: str, manifest_digest: str) -> bool:
        """Pins a manifest's digest; False if it stood there. Another digest is refused."""
        row = self.spark.createDataFrame([(chain_id, manifest_id, manifest_digest)], "chain_id string, manifest_id string, manifest_digest string")
        row = row.withColumn("ts", F.timestamp_micros(F.lit(int(self.clock() * 1e6))))
        return self.append(anchors.pin_lines(row, self.key, self.sink_id)).get("append", 0) == 1

    def resolve(self, chain_id: str, manifest_id: str, head: dict | None = None) -> str:
        """The pinned digest; an error if there is none, or if the log lacks what it held at `head`."""
        if head is not None and not self.holds(head):
            raise Refused("log: it has been cut or changed since the known head")
        row = anchors.resolved(self.spark.createDataFrame([(chain_id, manifest_id)], "chain_id string, manifest_id string"), self.checked()).first()
        if row["error"]:
            raise Refused(f"manifest {manifest_id}: {row['error']}")
        return row["manifest_digest"]

    def head(self) -> dict:
        """What a verifier keeps elsewhere, so as to see later whether the log was cut: the last batch and the digest of all lines."""
        batches = self.batches()
        return {"batch": max(batches, default=0), "digest": audit.content_digest(self.lines(batches))}

    def holds(self, head: dict) -> bool:
        return audit.content_digest(self.lines([n for n in self.batches() if n <= head["batch"]])) == head["digest"]

    def attempt(self, step: Callable[[], dict]) -> dict:
        """Runs an append that must not fail its caller: a receipt with ok, or with the error's category and when to try again.

        The wait doubles with each failure in a row, up to most_backoff; an attempt before its time is not made.
        """
        now = self.clock()
        if now < self.next_try:
            return {"ok": False, "error": "waiting", "failures": self.failures, "retry_after_seconds": self.next_try - now}
        try:
            done = step()
        except Exception as e:
            self.failures += 1
            wait = min(self.backoff * 2 ** (self.failures - 1), self.most_backoff)
            self.next_try = now + wait
            return {"ok": False, "error": contracts.error_category(e), "failures": self.failures, "retry_after_seconds": wait}
        self.failures, self.next_try = 0, 0.0
        return {"ok": True, **done}
