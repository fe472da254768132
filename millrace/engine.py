"""The record store as an object over a Spark session: write, recall, explain, review, forget, verify.

Tables are parquet under one folder. A version is a manifest that lists each table's folders and files; a commit
writes new folders first and then the manifest, and a reader takes the latest manifest, so it sees all of a commit
or nothing. Appends add a folder, changes rewrite the files that they touch. Of several writers that begin with one
version the first to publish the next wins and the others get a Conflict; that needs a file system whose rename
refuses a taken name, as HDFS and local ones do.

Texts are encrypted under random keys, one for each subject, which are stored wrapped under a key derived from the
engine's. Forgetting loses the key and removes all files of older versions.
"""

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import crypto
from .functions import text as T
from .functions import values as V
from .operators import audit, contracts, graph, ingest, policy, receipts, retrieval
from .operators.policy import Principal
from .sources import files

SCHEMAS = {
    "records": "id string, tenant string, subject string, created_by string, kind string, epistemic string, confidence double, salience double, classification string, pii boolean, roles array<string>, role_groups array<array<string>>, attrs array<struct<k:string,v:string>>, visibility string, review_state string, valid_from string, valid_until string, created_at double, content_hash string, indexed boolean, entities array<string>, subject_ids array<string>, source_ids array<string>, source_spans array<string>, policy_scope string, truth_status string, retention string, uri string, producer_sig string, content_enc binary",
    "edges": "child string, parent string, kind string",
    "lineage": "artifact_id string, artifact_kind string, subject string, tenant string",
    "keys": "tenant string, subject string, dek binary, state string",
    "audit": "chain_id string, seq long, ts timestamp, body string, prev_hash string, row_hash string",
}

#: Holds the records of round trips; give it to nobody.
CANARY_TENANT = "tenant:diagnostic"
#: Capability contracts: their kind, and the role that stores and reads them.
CONTRACT_KIND, CONTRACT_ROLE = "capability-contract", "continuity-admin"


class Conflict(RuntimeError):
    """Another writer has made the version that this change would have made; nothing of it is stored. Begin it again."""


class Change:
    """One new version: everything is read from the version it began with, and written under a number fixed then.

    Files that no longer serve are kept for readers of the version before, or removed at once where `erase` is set.
    """

    def __init__(self, engine: "Engine"):
        self.engine = engine
        self.base = engine.version()
        self.entries = engine.manifest(self.base)
        self._own: list[str] = []

    def __enter__(self) -> "Change":
        return self

    def __exit__(self, *_) -> None:
        """What was written and not committed goes."""
        for folder in self._own:
            self.engine.remove(folder)

    def table(self, name: str) -> DataFrame:
        return self.engine.read(name, self.entries[name])

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Adds the rows; returns them as they are stored."""
        folder = f"{self.engine.root}/data/{name}-{uuid.uuid4().hex}"
        self._own.append(folder)
        df.select(*columns_of(name)).write.parquet(folder)
        self.entries[name] = [*self.entries[name], folder]
        return self.engine.read(name, [folder])

    def rewrite(self, name: str, hit: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> None:
        """Writes anew, through `change`, the files that hold rows which `hit` returns; all others stay."""
        file = F.col("_metadata.file_path")
        files = sorted(r[0] for r in hit(self.table(name).select("*", file.alias("_file"))).select("_file").distinct().collect())
        if not files:
            return
        doomed = {self.engine.short(f) for f in files}
        rest = [f for e in self.entries[name] for f in self.engine.unless(e, doomed)]
        rows = self.engine.read(name, files)
        self.entries[name] = rest
        self.append(name, change(rows))

    def commit(self, action: str, who: Principal, target: str, detail: dict, erase: bool = False, flat: bool = False) -> int:
        self.append("audit", self.engine.audit_row(self.table("audit"), action, who.id, target, detail, who.tenant, flat))
        n = self.base + 1
        self.engine.publish(n, self.entries)
        self._own = []
        if erase:
            self.engine.vacuum(n)
        return n


def canonical(value: dict) -> str:
    """JSON with keys in order, without blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def columns_of(name: str) -> list[str]:
    return [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]


class Engine:
    def __init__(self, spark: SparkSession, root: str, key: bytes, chain_id: str = "main"):
        self.spark, self.root, self.key, self.chain_id = spark, root.rstrip("/"), key, chain_id
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(f"{self.root}/manifests"))

    # Versions

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop.Path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.root}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _manifest_path(self, n: int) -> str:
        return f"{self.root}/manifests/{n:08d}.json"

    def manifest(self, n: int) -> dict[str, list[str]]:
        """Folders and files of each table in a version."""
        if not n:
            return {t: [] for t in SCHEMAS}
        return json.loads(self.spark.read.text(self._manifest_path(n), wholetext=True).first()["value"])

    def publish(self, n: int, entries: dict[str, list[str]]) -> None:
        """Makes version n if nobody else has: the manifest is written aside and renamed, which fails where the name is taken."""
        draft = f"{self.root}/manifests/.{n:08d}.{uuid.uuid4().hex}"
        files.write_bytes(self.spark, draft, json.dumps(entries, sort_keys=True).encode())
        if not files.published(self.spark, draft, self._manifest_path(n)):
            raise Conflict(f"version {n} has been made by another writer")

    @staticmethod
    def short(path: str) -> str:
        """Folder and file name, however the path is written."""
        return "/".join(path.rstrip("/").split("/")[-2:])

    def unless(self, entry: str, doomed: set[str]) -> list[str]:
        """The entry, or its other files where it holds a doomed one."""
        if entry.endswith(".parquet"):
            return [] if self.short(entry) in doomed else [entry]
        files = [f"{entry}/{n}" for n in self._names(entry) if n.endswith(".parquet")]
        kept = [f for f in files if self.short(f) not in doomed]
        return [entry] if len(kept) == len(files) else kept

    def remove(self, path: str) -> None:
        self._fs.delete(self._hadoop.Path(path), True)

    def vacuum(self, n: int) -> None:
        """Removes older manifests, and the files that they name and version n does not."""
        old = [v for v in self.versions() if v < n]
        current = [e for entries in self.manifest(n).values() for e in entries]
        folders = {e.rsplit("/", 1)[0] if e.endswith(".parquet") else e for v in old for entries in self.manifest(v).values() for e in entries}
        for v in old:
            self.remove(self._manifest_path(v))
        for folder in sorted(folders - {e for e in current if not e.endswith(".parquet")}):
            kept = {self.short(e) for e in current if e.startswith(folder + "/")}
            if not kept:
                self.remove(folder)
                continue
            for name in self._names(folder):
                if name.endswith(".parquet") and self.short(f"{folder}/{name}") not in kept:
                    self.remove(f"{folder}/{name}")
                    self.remove(f"{folder}/.{name}.crc")

    def read(self, name: str, entries: list[str]) -> DataFrame:
        if not entries:
            # a scan of no files, so that its columns are those of any other
            return self.spark.read.schema(SCHEMAS[name]).parquet(self._nothing())
        return self.spark.read.schema(SCHEMAS[name]).parquet(*entries)

    def _nothing(self) -> str:
        folder = f"{self.root}/data/nothing"
        self._fs.mkdirs(self._hadoop.Path(folder))
        return folder

    def table(self, name: str) -> DataFrame:
        return self.read(name, self.manifest(self.version())[name])

    def change(self) -> Change:
        return Change(self)

    # Audit

    def audit_row(self, log: DataFrame, action: str, principal: str, target: str, detail: dict, tenant: str, flat: bool = False) -> DataFrame:
        """The row that follows the log; `flat`: the detail's fields stand beside the others."""
        head = log.where(F.col("chain_id") == self.chain_id).agg(F.max("seq").alias("seq"), F.max_by("row_hash", "seq").alias("hash")).first()
        seq, prev = (head["seq"] or 0) + 1, head["hash"] or audit.GENESIS
        told = {"action": action, "principal": principal, "target": target, "tenant": tenant}
        body = canonical({**told, **detail} if flat else {**told, "detail": detail})
        now = dt.datetime.now(dt.timezone.utc)
        us = int(now.timestamp()) * 1_000_000 + now.microsecond
        row = hashlib.sha256(f"{prev}{body}{us}".encode()).hexdigest()
        return self.spark.createDataFrame([(self.chain_id, seq, now, body, prev, row)], SCHEMAS["audit"])

    def verify_audit(self) -> dict:
        row = audit.chain_status(self.table("audit").where(F.col("chain_id") == self.chain_id)).first()
        return row.asDict() if row else {"chain_id": self.chain_id, "n_rows": 0, "ok": True, "first_bad_seq": None, "head_seq": 0, "head_hash": audit.GENESIS}

    # Writing

    def _signature(self) -> Column:
        return crypto.signature(self.key, crypto.payload(F.col("id"), F.col("content_hash"), F.col("uri"), F.col("created_by"), F.col("epistemic")))

    def _plain_key(self, tenant: str) -> Callable[[Column], Column]:
        return lambda dek: crypto.unwrapped(dek, self.key, tenant)

    def remember_many(self, rows: DataFrame, principal: Principal) -> dict:
        """Writes records given as maps `fields` (with the usual aliases, and derived_from: ids by commas); returns counts by outcome.

        Rows that are refused are counted by reason, among them those of an erased subject. Of rows with one id
        the first by content hash is written and the others count as repeated; ids that are stored count as known.
        Derived records take on the strictest policy of their parents.
        """
        with self.change() as c:
            report = self._remember(c, rows, principal)
            c.commit("remember", principal, "records", report)
        return report

    def _remember(self, c: Change, rows: DataFrame, principal: Principal) -> dict:
        f = F.col("fields")
        known, deks = c.table("records"), c.table("keys")
        erased = deks.where("state = 'shredded'").select("tenant", "subject", F.lit(True).alias("_erased"))
        told = ingest.bulk_records(rows.select("fields"), principal.tenant).join(erased, ["tenant", "subject"], "left")
        attrs, groups = V.attr_pairs(f["attrs"]), V.role_groups(f["role_groups"])
        visibility = F.coalesce(f["visibility"], F.lit("tenant"))
        why = (
            F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("tenant") != principal.tenant, "cross-tenant").when(F.col("_erased"), "erased subject")
            .when(~visibility.isin("private", "tenant", "shared"), "visibility").when(F.exists(attrs, lambda a: a.isNull()), "attrs").when(groups.isNull(), "role_groups")
            .when(f["valid_from"].isNotNull() & V.instant(f["valid_from"]).isNull(), "valid_from").when(f["valid_until"].isNotNull() & V.instant(f["valid_until"]).isNull(), "valid_until").otherwise("ok")
        )
        told = told.withColumn("why", why)
        now = dt.datetime.now(dt.timezone.utc).timestamp()
        new = told.where("why = 'ok'").withColumn("content_hash", T.content_hash(F.col("content"))).withColumn("id", F.coalesce(f["memory_id"], f["id"], V.stable_id(F.col("tenant"), F.coalesce("uri", "subject"), F.col("content_hash"))))
        nth = F.row_number().over(Window.partitionBy("id").orderBy("content_hash", "subject", F.to_json("fields")))
        new = new.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "why", "_erased")
        new = new.withColumns(
            {
                "created_by": F.lit(principal.id), "salience": F.coalesce(f["salience"].try_cast("double"), F.lit(0.5)), "role_groups": groups, "attrs": attrs,
                "visibility": visibility, "review_state": F.when(F.col("epistemic") == "model-generated", "proposed").cast("string"), "valid_from": f["valid_from"], "valid_until": f["valid_until"],
                "created_at": F.coalesce(f["created_at"].try_cast("double"), F.lit(now)), "indexed": V.bool_value(f["indexed"], True), "entities": V.list_value(f["entities"]), "subject_ids": F.array("subject"),
                "source_ids": F.when(F.col("uri").isNotNull(), F.array("uri")).otherwise(F.array().cast("array<string>")), "source_spans": V.list_value(f["source_spans"]), "policy_scope": F.coalesce(f["policy_scope"], F.lit("default")),
                "truth_status": V.default_truth(F.col("epistemic")), "retention": F.coalesce(f["retention"], F.lit("decayable")), "derived_from": V.list_value(f["derived_from"]),
            }
        )
        new = new.join(known.select("id"), "id", "left_anti")
        edges = new.select(F.col("id").alias("child"), F.explode("derived_from").alias("parent"), F.lit("derived_from").alias("kind")).distinct()
        every = known.select("id", "classification", "pii", "roles", "role_groups").unionByName(new.select("id", "classification", "pii", "roles", "role_groups"))
        strictest = policy.inherited(every, edges).withColumnsRenamed({"classification": "_c", "pii": "_p", "role_groups": "_g"})
        derived = F.col("_g").isNotNull()
        new = new.join(strictest, "id", "left").withColumns(
            {"classification": F.when(derived, F.col("_c")).otherwise(F.col("classification")), "pii": F.coalesce("_p", "pii"), "role_groups": F.coalesce("_g", "role_groups"), "roles": F.when(derived, F.array().cast("array<string>")).otherwise(F.col("roles"))}
        )
        # five tables are made of these rows; what is kept of them in the meantime goes with the call
        new = new.withColumn("producer_sig", self._signature()).persist()
        try:
            return self._store(c, new, told, principal)
        finally:
            new.unpersist()

    def _store(self, c: Change, new: DataFrame, told: DataFrame, principal: Principal) -> dict:
        f, deks = F.col("fields"), c.table("keys")
        keys = crypto.subject_keys(new.join(deks.select("tenant", "subject"), ["tenant", "subject"], "left_anti"))
        made = c.append("keys", keys.withColumn("dek", crypto.wrapped(F.col("dek"), self.key, principal.tenant)))
        stored = c.append("records", crypto.encrypted(new.drop("fields", "_c", "_p", "_g"), deks.unionByName(made), unwrap=self._plain_key(principal.tenant)))
        c.append("edges", new.select(F.col("id").alias("child"), F.explode("derived_from").alias("parent"), F.lit("derived_from").alias("kind")).distinct())
        c.append("lineage", stored.select(F.explode(F.array(F.struct(F.col("id").alias("a"), F.lit("memory").alias("k")), F.struct(F.concat(F.lit("emb:"), "id").alias("a"), F.lit("embedding").alias("k")))).alias("x"), "subject", "tenant").select(F.col("x.a").alias("artifact_id"), F.col("x.k").alias("artifact_kind"), "subject", "tenant"))
        if stored.where("content_enc IS NULL").limit(1).count():
            raise RuntimeError("a record would have been stored without its text")
        report = {r["why"]: r["count"] for r in told.groupBy("why").count().collect()}
        report["written"] = stored.count()
        if lost := report.get("ok", 0) - report["written"]:
            ids = told.where("why = 'ok'").select(F.coalesce(f["memory_id"], f["id"], V.stable_id(F.col("tenant"), F.coalesce("uri", "subject"), T.content_hash(F.col("content")))).alias("id")).distinct().count()
            report |= {k: v for k, v in (("repeated", report["ok"] - ids), ("known", lost - (report["ok"] - ids))) if v}
        return report

    def store_contracts(self, documents: DataFrame, approved: dict[str, Sequence[str]], who: Principal) -> dict:
        """Stores capability contracts (JSON in `document`) that break no rule, where only holders of CONTRACT_ROLE read them and no recall finds them.

        Returns counts by rule that was broken and of those written; a contract is stored once.
        """
        self._may_bind(who)
        told = graph.cut(contracts.contracts(documents.select("document"), approved))
        given = {
            "content": F.to_json(F.parse_json("document")), "subject": F.concat(F.lit("continuity-contract:"), F.replace("hash", F.lit("sha256:"), F.lit(""))), "uri": F.concat(F.lit("contract:"), "hash"), "kind": F.lit(CONTRACT_KIND), "epistemic": F.lit("imported-source"),
            "confidence": F.lit("1.0"), "salience": F.lit("0.0"), "classification": F.lit("confidential"), "roles": F.lit(CONTRACT_ROLE), "policy_scope": F.lit("continuity"), "indexed": F.lit("false"),
        }
        fields = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), v)))
        report = {r["error"]: r["count"] for r in told.where("error IS NOT NULL").groupBy("error").count().collect()}
        return report | {"written": self.remember_many(told.where("error IS NULL").dropDuplicates(["hash"]).select(fields.alias("fields")), who)["written"]}

    def _may_bind(self, who: Principal) -> None:
        if CONTRACT_ROLE not in who.roles:
            raise PermissionError(f"contracts need the role {CONTRACT_ROLE}")

    def contracts(self, who: Principal) -> DataFrame:
        """hash, route_id, schema_version, contract_hash and document of the stored contracts of the principal's tenant whose text is still that of their hash."""
        self._may_bind(who)
        rows = policy.visible(self.table("records"), who).where(F.col("kind") == CONTRACT_KIND)
        rows = crypto.decrypted(rows, self.table("keys"), unwrap=self._plain_key(who.tenant)).where("content IS NOT NULL")
        told = F.concat(F.lit("sha256:"), F.sha2("content", 256))
        own = rows.where(F.col("uri") == F.concat(F.lit("contract:"), told))
        field = lambda k: F.get_json_object("content", f"$.{k}").alias(k)
        return own.select(told.alias("hash"), field("route_id"), field("schema_version"), told.alias("contract_hash"), F.col("content").alias("document"))

    def issue_receipt(self, draft: str, who: Principal) -> dict:
        """Records a rotation draft (JSON) in the audit chain and returns its signed receipt; the draft itself is not stored.

        Refused are a draft that breaks a rule or binds a contract that is not stored, production evidence (nothing here attests
        a run), a broken chain, and a baseline that is neither the lineage's start nor an earlier receipt as the chain records it.
        """
        self._may_bind(who)
        told = contracts.drafts(self.spark.createDataFrame([(draft,)], "document string")).first()
        if told["error"]:
            raise ValueError(told["error"])
        d = json.loads(draft)
        if d["evidence_mode"] == "production":
            raise PermissionError("production evidence needs an attested run")
        pairs = self.spark.createDataFrame([tuple(d[k][f] for f in ("route_id", "schema_version", "contract_hash")) for k in ("from_contract", "to_contract")], "route_id string, schema_version string, contract_hash string")
        if not contracts.bound(pairs, self.contracts(who)).where("NOT bound").isEmpty():
            raise ValueError("contract_binding")
        lineage = "sha256:" + hashlib.sha256(canonical({k: d[k] for k in ("from_route", "to_route")}).encode()).hexdigest()
        base = d["prior_baseline"] if "receipt_id" in d["prior_baseline"] else {}
        with self.change() as c:
            log = c.table("audit").where(F.col("chain_id") == self.chain_id)
            status = audit.chain_status(log).first()
            if status is None or not status["ok"]:
                raise RuntimeError("the audit chain does not hold")
            field = lambda k: F.get_json_object("body", f"$.{k}")
            same = log.where((field("action") == receipts.ACTION) & (field("lineage_hash") == lineage))
            if base:
                same = log.where((F.col("seq") == base["audit_seq"]) & (field("action") == receipts.ACTION) & (field("tenant") == who.tenant) & (field("target") == base["receipt_id"]) & (field("receipt_hash") == base["receipt_hash"]))
            if same.isEmpty() == bool(base):
                raise ValueError("prior_baseline")
            seq = status["head_seq"] + 1
            own = {"chain_id": self.chain_id, "audit_seq": seq, "receipt_id": d["receipt_id"], "lineage_hash": lineage, "status": d["evidence_mode"], "signed_by": who.id}
            own["receipt_hash"] = "sha256:" + hashlib.sha256(canonical({**d, "signed_by": who.id, "audit_seq": seq}).encode()).hexdigest()
            own |= {"baseline_seq": base.get("audit_seq"), "baseline_id": base.get("receipt_id"), "baseline_hash": base.get("receipt_hash")}
            row = self.spark.createDataFrame([tuple(own[f] for f in receipts.FIELDS)], ", ".join(f"{f} {'long' if f.endswith('_seq') else 'string'}" for f in receipts.FIELDS))
            signed = receipts.sealed(row, self._receipt_key()).first().asDict()
            c.commit(receipts.ACTION, who, d["receipt_id"], {k: own[k] for k in ("receipt_hash", "lineage_hash", "status")}, flat=True)
        return signed

    def _receipt_key(self) -> bytes:
        return crypto.derived_key(self.key, "rotation-receipt")

    def verify_receipts(self, held: DataFrame, who: Principal) -> DataFrame:
        """What receipts.verified says of receipts against the audit chain."""
        return receipts.verified(held, self.table("audit").where(F.col("chain_id") == self.chain_id), self._receipt_key(), who.tenant)

    def import_markdown(self, root: str, who: Principal) -> dict:
        """Records from *.md files under root: fields from frontmatter, else from file names; secrets make a record restricted.

        Files that stand unchanged are skipped; of changed ones the old record is purged once the new one is written.
        """
        told = files.with_frontmatter(files.read_markdown(self.spark, root))
        uri, f = F.concat(F.lit("markdown://"), "relative_path"), F.col("fields")
        secret = T.shows_secret(F.col("body"))
        given = F.create_map(
            F.lit("content"), F.col("body"), F.lit("uri"), uri, F.lit("subject"), F.coalesce(f["subject"], F.concat(F.lit("file:"), "relative_path")), F.lit("kind"), F.coalesce(f["kind"], V.inferred_kind(F.col("relative_path"))),
            F.lit("epistemic"), F.coalesce(f["epistemic"], V.inferred_epistemic(F.col("relative_path"))), F.lit("classification"), F.when(secret, "restricted").otherwise(F.coalesce(f["classification"], F.lit("internal"))),
            F.lit("pii"), F.when(secret, "true").otherwise(F.coalesce(f["pii"], F.lit("false"))),
        )
        rest = F.map_filter(f, lambda k, v: ~k.isin("content", "text", "body", "uri", "source_uri", "source_id", "subject", "subject_id", "kind", "memory_type", "epistemic", "epistemic_class", "classification", "pii", "contains_pii"))
        rows = told.select(F.map_concat(rest, given).alias("fields"), uri.alias("path"), F.lit(who.tenant).alias("tenant"), T.content_hash(F.col("body")).alias("content_hash"))
        with self.change() as c:
            old = c.table("records").where((F.col("tenant") == who.tenant) & F.startswith("uri", F.lit("markdown://"))).select("tenant", F.col("uri").alias("path"), "content_hash", "id")
            plan = graph.cut(ingest.import_plan(old, rows).where("new_hash IS NOT NULL"))
            stale = graph.cut(old.join(plan.where("action = 'update'").select("path"), "path").select("id"))
            report = self._remember(c, rows.join(plan.where("action IN ('insert', 'update')").select("path"), "path", "left_semi").select("fields"), who)
            counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
            report = {**counts, **{k: v for k, v in report.items() if k != "ok"}}
            self._delete(c, stale)
            c.commit("import_markdown", who, "records", report, erase=bool(counts.get("update")))
        return report

    def import_links(self, who: Principal) -> dict:
        """Edges from [[links]] between the records that the principal may read; known edges stay as they are."""
        rows = self.readable(who).select("id", "subject", "uri", F.regexp_replace("uri", "^markdown://", "").alias("path"), "content")
        links = graph.cut(graph.wikilinks(rows, graph.aliases(rows)))
        new = links.where("outcome = 'edge'").select(F.col("id").alias("child"), "parent", F.lit("wikilink").alias("kind"), F.col("place").alias("ordinal"))
        report = {r["outcome"]: r["count"] for r in links.groupBy("outcome").count().collect()}
        with self.change() as c:
            report["inserted"] = c.append("edges", graph.add_edges(c.table("edges"), new).where("inserted")).count()
            c.commit("import_links", who, "edges", report)
        return report

    def _change(self, action: str, who: Principal, target: str, chosen: Column, change: Callable[[DataFrame], DataFrame], detail: dict) -> int:
        """Applies `change`, which marks what it changes in a column `changed`, to the chosen records of the principal's tenant."""
        chosen = chosen & (F.col("tenant") == who.tenant)
        with self.change() as c:
            n = change(c.table("records").where(chosen)).where("changed").count()
            if n:
                c.rewrite("records", lambda rows: rows.where(chosen), lambda rows: change(rows.where(chosen)).drop("changed").unionByName(rows.where(~F.coalesce(chosen, F.lit(False)))))
                c.commit(action, who, target, {**detail, "changed": n})
        return n

    def transition(self, record_id: str, state: str, who: Principal) -> int:
        may = policy.move_refusal(F.col("review_state"), F.lit(state), who.roles).isNull()
        return self._change("review_transition", who, record_id, F.col("id") == record_id, lambda rows: policy.set_where(rows, "review_state", F.col("review_state"), F.lit(state), may), {"to": state})

    def approve(self, record_id: str, who: Principal) -> int:
        def signed(rows: DataFrame) -> DataFrame:
            own = policy.approved(rows, F.lit(True), who.roles)
            return own.withColumn("producer_sig", F.when(F.col("changed"), self._signature()).otherwise(F.col("producer_sig")))

        return self._change("approve", who, record_id, F.col("id") == record_id, signed, {})

    def expire(self, record_id: str, at: str | None, who: Principal) -> int:
        value = F.lit(None).cast("string") if at is None else V.utc_text(F.lit(at))
        if at is not None and self.spark.range(1).select(value).first()[0] is None:
            raise ValueError("not an instant: " + at)
        return self._change("expire", who, record_id, F.col("id") == record_id, lambda rows: policy.set_where(rows, "valid_until", F.col("valid_until"), value, F.lit(True)), {"at": at})

    def set_indexed(self, record_id: str, indexed: bool, who: Principal) -> int:
        return self._change("set_indexed", who, record_id, F.col("id") == record_id, lambda rows: policy.set_where(rows, "indexed", F.lit(not indexed), F.lit(indexed), F.lit(True)), {"indexed": indexed})

    def _delete(self, c: Change, gone: DataFrame) -> None:
        """Deletes records (id), their edges and their lineage."""
        ids = gone.select("id").distinct()
        both = ids.select(F.explode(F.array("id", F.concat(F.lit("emb:"), "id"))).alias("artifact_id"))
        for name, keys in (("records", {"id": ids}), ("lineage", {"artifact_id": both}), ("edges", {"child": ids.withColumnRenamed("id", "child"), "parent": ids.withColumnRenamed("id", "parent")})):
            for key, values in keys.items():
                c.rewrite(name, lambda rows, key=key, values=values: rows.join(values, key, "left_semi"), lambda rows, key=key, values=values: rows.join(values, key, "left_anti"))

    def forget(self, subject: str, who: Principal) -> dict:
        """Shreds the subject's key, deletes its records and all that derives from them, and removes the files of older versions.

        A subject that is forgotten cannot be written again.
        """
        with self.change() as c:
            gone = graph.cut(graph.erased(c.table("records"), c.table("edges"), c.table("lineage"), subject, who.tenant))
            report = {r["why"]: r["count"] for r in gone.groupBy("why").count().collect()}
            self._delete(c, gone)
            own = (F.col("tenant") == who.tenant) & (F.col("subject") == subject)
            if c.table("keys").where(own).isEmpty():
                c.append("keys", self.spark.createDataFrame([(who.tenant, subject, None, "shredded")], SCHEMAS["keys"]))
            else:
                c.rewrite("keys", lambda rows: rows.where(own), lambda rows: crypto.shredded(rows, who.tenant, subject))
            c.commit("forget", who, subject, report, erase=True)
        return report

    def purge(self, record_id: str, who: Principal) -> bool:
        with self.change() as c:
            gone = graph.cut(c.table("records").where((F.col("id") == record_id) & (F.col("tenant") == who.tenant)).select("id"))
            if gone.isEmpty():
                return False
            self._delete(c, gone)
            c.commit("purge", who, record_id, {}, erase=True)
        return True

    # Reading

    def readable(self, who: Principal, filters: dict | None = None, at: Column | None = None) -> DataFrame:
        """Records that pass filters and policy and whose text can be decrypted; nothing is scored before."""
        at = F.current_timestamp() if at is None else at
        rows = policy.matching(policy.visible(self.table("records"), who), filters or {}, at)
        return crypto.decrypted(rows, self.table("keys"), unwrap=self._plain_key(who.tenant)).where("content IS NOT NULL")

    def recall(self, cue: str, who: Principal, filters: dict | None = None, k: int = 8, topc: int = 50, method: str = "hybrid", at: Column | None = None) -> DataFrame:
        """The k best records with content, score, rank, what they claim to be, the signals behind the score, integrity, and a badge where they are unreviewed."""
        filters, k, topc = policy.merged_filters(filters or {}, {}, k, topc)
        best = retrieval.recall(self.readable(who, filters, at), cue, k, topc, method, filters.get("intent", "default"), filters.get("entities"), at)
        return best.select(
            "id", "rank", F.round("score", 4).alias("score"), "content", "subject", "kind", "epistemic", "dense", "bm25", "rrf", "rerank", "collapsed_ids", (F.col("review_state") == "proposed").alias("unreviewed"),
            F.when(F.col("review_state") == "proposed", "unreviewed").alias("review_badge"), "review_state", "truth_status", "confidence", "classification", "policy_scope", "subject_ids", "source_ids",
            F.struct("dense", "bm25", "rrf", "rerank").alias("signals"),
            (T.content_hash(F.col("content")) == F.col("content_hash")).alias("content_ok"), (F.col("producer_sig") == self._signature()).alias("signature_ok"),
        )

    def explain(self, cue: str, who: Principal, filters: dict | None = None, at: Column | None = None, **how) -> dict:
        """Counts and edges behind a recall; what was denied is told by reason, never by record."""
        at = F.current_timestamp() if at is None else at
        rows = policy.matching(self.table("records"), filters or {}, at).where(F.col("tenant") == who.tenant)
        reasons = {r["reason"]: r["count"] for r in rows.groupBy(policy.deny_reason(who).alias("reason")).count().collect()}
        ids = [r["id"] for r in self.recall(cue, who, filters, at=at, **how).orderBy("rank").collect()]
        among = self.table("edges").where(F.col("child").isin(*ids) & F.col("parent").isin(*ids)).orderBy("kind", "child", "parent").limit(100)
        return {"visible": reasons.pop("ok", 0), "denied": reasons, "results": ids, "paths": [tuple(r) for r in among.collect()]}

    def verify_roundtrip(self, who: Principal) -> dict:
        """Writes a record with a new marker for a tenant of its own, recalls it and purges it: whether each of these held, and all."""
        own = replace(who, tenant=CANARY_TENANT)
        marker = "canary" + uuid.uuid4().hex
        fields = {"id": f"diag_{marker}", "content": f"diagnostic {marker}", "subject": f"diagnostic:{marker}", "classification": "public", "policy_scope": "diagnostic-canary"}
        out = {"written": False, "recalled": False, "removed": False}
        try:
            out["written"] = self.remember_many(self.spark.createDataFrame([(fields,)], "fields map<string,string>"), own)["written"] == 1
            out["recalled"] = [r["id"] for r in self.recall(marker, own, {}, 1).collect()] == [fields["id"]]
        finally:
            out["removed"] = self.purge(fields["id"], own) and self.table("records").where(F.col("id") == fields["id"]).isEmpty()
        return {**out, "ok": all(out.values())}

    def readiness(self, dims: int | None = None, found_dims: int | None = None, most_lag: int = 0, most_age_s: float | None = None) -> dict:
        """Whether the store may serve: it has records, its audit holds, few of them wait for the index, vectors have the wanted length, the last record is not too old."""
        rows = self.table("records").agg(F.count("*").alias("n"), F.count_if(~F.col("indexed") & (F.col("kind") != CONTRACT_KIND)).alias("lag"), F.max("created_at").alias("last")).first()
        age = None if rows["last"] is None else dt.datetime.now(dt.timezone.utc).timestamp() - rows["last"]
        checks = {"has_records": rows["n"] > 0, "audit_ok": self.verify_audit()["ok"], "index_lag_ok": rows["lag"] <= most_lag, "dims_ok": dims is None or dims == found_dims, "fresh": most_age_s is None or age is not None and age <= most_age_s}
        return {**checks, "index_lag": rows["lag"], "ready": all(checks.values())}

    def health(self) -> dict:
        rows = self.table("records").agg(F.count("*").alias("n"), F.count_if(~F.col("indexed")).alias("lag")).first()
        return {"version": self.version(), "records": rows["n"], "index_lag": rows["lag"], "audit_ok": self.verify_audit()["ok"]}
