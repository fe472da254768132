"""Anchor logs, digests, manifests, the vector index, closed documents and merged summaries: what their queries do not show."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from millrace.engine import Engine
from millrace.operators import anchors, audit, consolidate, contracts, gates, index, ingest, receipts, strict
from millrace.operators.policy import Principal
from millrace.sources import files
from millrace.sources.anchor_log import AnchorLog, Refused
from millrace.streaming.anchoring import anchored
from millrace.tools import Credentials, Tools

CHAIN = "chain_" + "a" * 32
OTHER = "chain_" + "b" * 32


def heads(spark, *rows):
    return spark.createDataFrame([(c, n, h * 64) for c, n, h in rows], "chain_id string, seq long, row_hash string")


def test_anchor_log(spark, tmp_path):
    now = [1000.0]
    log = AnchorLog(spark, f"file://{tmp_path}/log", b"k", "s1", clock=lambda: now[0])
    empty = log.head()
    assert log.batches() == [] and log.holds(empty)
    assert log.anchor(heads(spark, (CHAIN, 3, "a"), (OTHER, 5, "b"))) == {"append": 2}
    # the same head again, though at another time, is known and not repeated
    now[0] = 2000.0
    assert log.anchor(heads(spark, (CHAIN, 3, "a"))) == {"known": 1} and log.batches() == [1]
    assert log.anchor(heads(spark, (CHAIN, 4, "c"))) == {"append": 1}
    for bad in ((CHAIN, 2, "a"), (CHAIN, 4, "d")):
        with pytest.raises(Refused, match="reordered 1|conflicting 1"):
            # a good one beside it is refused too
            log.anchor(heads(spark, bad, (OTHER, 9, "e")))
    with pytest.raises(Refused, match="append: row_hash 1"):
        log.anchor(heads(spark, (OTHER, 9, "x")))
    kept = log.head()
    manifest, digest = "sct_" + "1" * 24, "sha256:" + "2" * 64
    assert log.pin(CHAIN, manifest, digest) and not log.pin(CHAIN, manifest, digest)
    with pytest.raises(Refused, match="conflicting"):
        log.pin(CHAIN, manifest, "sha256:" + "3" * 64)
    assert log.resolve(CHAIN, manifest, kept) == digest and log.holds(empty)
    with pytest.raises(Refused, match="not_pinned"):
        log.resolve(OTHER, manifest)
    # under another key, or where no root is trusted, nothing is good
    assert {r["error"] for r in AnchorLog(spark, log.root, b"other", "s1").records().collect()} == {"root"}
    assert {r["error"] for r in AnchorLog(spark, log.root, b"k", "s1", roots=[]).records().collect()} == {"untrusted_root"}
    assert {r["error"] for r in AnchorLog(spark, log.root, b"k", "s2").records().collect()} == {"sink_id"}
    # a log that is cut no longer holds its head; a cut line spoils it
    shutil.rmtree(tmp_path / "log" / "batch-000000000002")
    assert not log.holds(kept)
    with pytest.raises(Refused, match="cut or changed"):
        log.resolve(CHAIN, manifest, kept)
    part = next((tmp_path / "log" / "batch-000000000001").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(part.read_bytes()[:-9])
    with pytest.raises(Refused, match="log: malformed"):
        log.append(spark.createDataFrame([], "value string"))


def test_two_writers_of_a_batch(spark, tmp_path, monkeypatch):
    log = AnchorLog(spark, f"file://{tmp_path}/log", b"k", "s1")
    assert log.anchor(heads(spark, (CHAIN, 1, "a"))) == {"append": 1}
    monkeypatch.setattr(log, "batches", lambda: [])
    with pytest.raises(Refused, match="another writer"):
        log.anchor(heads(spark, (CHAIN, 2, "b")))
    monkeypatch.undo()
    assert log.records().count() == 1 and not [n for n in files.names(spark, log.root) if n.startswith(".draft")]


def test_attempts_wait_longer_after_each_failure(spark, tmp_path):
    now = [0.0]
    log = AnchorLog(spark, f"file://{tmp_path}/log", b"k", "s1", backoff=2.0, most_backoff=5.0, clock=lambda: now[0])

    def fails():
        raise ConnectionError("secret host")

    assert log.attempt(fails) == {"ok": False, "error": "unavailable", "failures": 1, "retry_after_seconds": 2.0}
    now[0] = 1.0
    assert log.attempt(lambda: {}) == {"ok": False, "error": "waiting", "failures": 1, "retry_after_seconds": 1.0}
    now[0] = 2.0
    assert log.attempt(fails)["retry_after_seconds"] == 4.0
    now[0] = 6.0
    assert log.attempt(fails)["retry_after_seconds"] == 5.0
    now[0] = 11.0
    assert log.attempt(lambda: {"append": 1}) == {"ok": True, "append": 1} and log.failures == 0


def test_odd_lines(spark):
    key = anchors.key_of(b"k", "s1")
    read = lambda *v: [r["error"] for r in anchors.parsed(spark.createDataFrame([(x,) for x in v], "value string"), key, "s1", [anchors.fingerprint(key)]).collect()]
    assert read(None, "", "[]", "{}", "x", '{"record_type":"audit_anchor","record_type":"audit_anchor"}') == ["malformed"] * 6
    good = anchors.anchor_lines(heads(spark, (CHAIN, 1, "a")).withColumn("ts", F.lit("2024-01-01").cast("timestamp")), key, "s1").first()["value"]
    told = json.loads(good)
    assert read(good) == [None] and read(json.dumps({**told, "more": 1}, sort_keys=True, separators=(",", ":"))) == ["malformed"]
    told["created_at_utc"] = "2024-13-01T00:00:00Z"
    assert read(json.dumps(told, sort_keys=True, separators=(",", ":"))) == ["created_at"]


def test_content_digest(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else "x" * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string")
    whole = audit.content_digest(df)
    assert audit.content_digest(df.orderBy(F.desc("a")).repartition(7).select("b", "a")) == whole
    assert audit.content_digest(df.unionByName(df.where("a = 5"))) != whole != audit.content_digest(df.where("a <> 5"))
    assert audit.content_digest(df.limit(0)) == "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    # many levels give a digest as stable as one does
    monkeypatch.setattr(audit, "LEAVES", 1)
    deep = audit.content_digest(df)
    assert audit.content_digest(df.repartition(5)) == deep != whole


def test_signed_manifests(spark, tmp_path):
    entries = spark.createDataFrame([("1", "t", "h1", "f1", "unverifiable_hmac"), ("2", "t", "h2", "f2", "unverifiable_missing_key")], ", ".join(f"{c} string" for c in strict.ENTRIES))
    m = strict.signed_manifest(entries, CHAIN, 7, b"k")
    pin = strict.manifest_digest(m)
    check = lambda m=m, rows=entries, key=b"k", pin=pin: strict.manifest_error(m, rows, key, pin)
    assert check() is None and check(key=b"x") == "signature" and check(m={**m, "approved_seq": 8}) == "signature" and check(m={**m, "more": 1}) == "fields"
    assert check(pin=None) == "not_pinned" and check(pin="sha256:0") == "pin" and check(rows=entries.limit(1)) == "rows"
    assert check(rows=entries.withColumn("content_hash", F.lit("h"))) == "digest" and check(rows=entries.withColumn("id", F.lit("1"))) == "duplicate_id"
    assert check(rows=entries.withColumn("bucket", F.lit("bad_signature"))) == "bucket" and check(rows=entries.withColumn("bucket", F.lit(None).cast("string"))) == "bucket"
    none = strict.signed_manifest(entries.limit(0), CHAIN, 7, b"k")
    assert strict.manifest_error(none, entries.limit(0), b"k", strict.manifest_digest(none)) is None
    # published at once or not at all
    path = f"file://{tmp_path}/manifest"
    assert files.publish_tables(spark, {"entries": entries}, m, path) and not files.publish_tables(spark, {"entries": entries.limit(1)}, {}, path)
    assert files.read_manifest(spark, path) == m and check(rows=spark.read.parquet(f"{path}/entries")) is None
    assert [p.name for p in tmp_path.iterdir()] == ["manifest"]


def test_strict_mode_setting():
    assert strict.mode_of(None, False) == strict.mode_of(" OFF ", False) == "off" and strict.mode_of("enforce", True) == "enforce"
    with pytest.raises(PermissionError):
        strict.mode_of("enforce", False)
    with pytest.raises(ValueError):
        strict.mode_of("on", True)


def test_vector_index(spark, tmp_path):
    own = index.VectorIndex(spark, f"file://{tmp_path}/index")
    assert own.search([("q", "t", [1.0, 0.0])], 3).collect() == []
    rows = [("a", "t", [1.0, 0.0]), ("b", "t", [1.0, 0.0]), ("c", "t", [0.5, 0.5]), ("d", "u", [9.0, 9.0]), ("e", "t", [1.0]), ("f", "t", []), ("g", "t", None), (None, "t", [1.0, 1.0]), ("h", None, [1.0, 1.0]), ("c", "t", [0.5, 0.5])]
    v = spark.createDataFrame(rows, "id string, tenant string, vector array<double>")
    own.add(v.where("id IN ('d', 'h')"))
    own.rebuild(v)
    find = lambda n=5, allowed=None, tenant="t": [(r["rank"], r["id"], r["score"]) for r in own.search([("q", tenant, [1.0, 0.0])], n, allowed).orderBy("rank").collect()]
    # ties go to the smaller id; other tenants, lengths and empty vectors take no part
    assert find() == [(1, "a", 1.0), (2, "b", 1.0), (3, "c", 0.5)] and find(1) == [(1, "a", 1.0)] and find(tenant="u") == [(1, "d", 9.0)]
    assert find(allowed=v.where("id = 'c'")) == [(1, "c", 0.5)] and find(allowed=v.limit(0)) == []
    own.remove(v.where("id = 'a'"))
    own.add(spark.createDataFrame([("c", "t", [2.0, 0.0])], v.schema))
    assert find() == [(1, "c", 2.0), (2, "b", 1.0)]
    # a row that moves to another tenant leaves the old one
    own.add(spark.createDataFrame([("b", "u", [2.0, 0.0])], v.schema))
    assert find() == [(1, "c", 2.0)]
    before = sorted(map(tuple, own.live().collect()), key=str)
    own.rebuild()
    own.vacuum()
    assert sorted(map(tuple, own.live().collect()), key=str) == before and len(own._parts()) == 1
    own.add(v.where("id = 'a'"))
    assert find() == [(1, "c", 2.0), (2, "a", 1.0)]
    assert own.search_all(v.limit(0).withColumnRenamed("id", "query"), 3).collect() == []


def test_closed_documents(spark):
    check = contracts.closed("top", {"a": contracts.whole("a", 1, 5), "b": contracts.text("b", "[a-z]+")}, {"c": contracts.flag("c")})
    docs = ['{"b":"x", "a":5}', '{"a":5,"b":"x","c":true}', None, "", "[]", "null", '{"a":1}', '{"a":1,"b":"x","d":1}', '{"a":0,"b":"x"}', '{"a":"1","b":"x"}', '{"a":1e0,"b":"x"}', '{"a":99999999999999999999,"b":"x"}', '{"a":1,"b":"X"}', '{"a":1,"b":"x\\n"}', '{"a":1,"b":null}', '{"a":1,"b":"x","c":"true"}', '{"a":1,"a":1,"b":"x"}']
    told = contracts.checked(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, document string"), check).orderBy("i").collect()
    assert [r["error"] for r in told] == [None, None, "top", "top", "top", "top", "top_fields", "top_fields", "a", "a", "a", "a", "b", "b", "b", "c", "top"]
    assert told[0]["hash"] == "sha256:" + __import__("hashlib").sha256(b'{"a":5,"b":"x"}').hexdigest() and told[2]["hash"] is None


def test_rotation_drafts(spark):
    route = lambda x: f"route_{x * 12}"
    digest = "sha256:" + "0" * 64
    binding = lambda x: {"route_id": route(x), "schema_version": "1", "contract_hash": digest}
    case = {"case_id": "case_" + "a" * 12, "before": "pass", "after": "failed", "delta": -1, "before_error_category": None, "after_error_category": "timeout", "fallback": {"attempted": True, "fallback_exercised": True, "trigger": "on_error", "target_route_id": route("c"), "result": "pass", "error_category": None}}
    good = {
        "schema_version": "1", "receipt_id": "rot_" + "a" * 12, "evidence_mode": "production", "from_route": route("a"), "to_route": route("b"), "from_contract": binding("a"), "to_contract": binding("b"),
        "eval_suite": {"eval_suite_id": "suite_" + "a" * 12, "schema_version": "v1", "eval_suite_hash": digest}, "run_id": "run_" + "a" * 12, "prior_baseline": {"receipt_id": "rot_" + "b" * 12, "receipt_hash": digest, "audit_seq": 1}, "ts": "2024-01-01T00:00:00+02:00", "cases": [case], "summary": {"passed": 0, "degraded": 0, "failed": 1},
    }
    tried = case["fallback"]
    changes = [
        ({}, None), ({"prior_baseline": {"is_genesis": True}}, None), ({"prior_baseline": {"is_genesis": "true"}}, "genesis_marker"), ({"prior_baseline": {"is_genesis": True, "audit_seq": 1}}, "baseline_binding_fields"), ({"prior_baseline": {**good["prior_baseline"], "audit_seq": 0}}, "baseline_audit_seq"),
        ({"prior_baseline": None}, "prior_baseline"), ({"cases": []}, "cases"), ({"cases": {}}, "cases"), ({"cases": [None]}, "rotation_case"), ({"cases": [case, case], "summary": {"passed": 0, "degraded": 0, "failed": 2}}, "duplicate_case_id"), ({"cases": [{**case, "delta": 1.5}]}, "delta"),
        ({"cases": [{**case, "after_error_category": None}]}, "after_error_category"), ({"cases": [{**case, "fallback": {**tried, "result": "failed"}}]}, "fallback_error_category"), ({"cases": [{**case, "fallback": {**tried, "fallback_exercised": False}}]}, "unobserved_fallback"),
        ({"cases": [{**case, "fallback": {"attempted": False, "fallback_exercised": False}}]}, None), ({"cases": [{**case, "fallback": {**tried, "attempted": False}}]}, "fallback_observation_fields"), ({"cases": [{**case, "fallback": {}}]}, "fallback_attempted"),
        ({"summary": {"passed": 1, "degraded": 0, "failed": 0}}, "summary_mismatch"), ({"summary": {"passed": -1, "degraded": 0, "failed": 1}}, "summary_count"), ({"ts": "2024-01-01"}, "timestamp"), ({"ts": None}, "timestamp"), ({"run_id": "run_short"}, "run_id"),
    ]
    rows = spark.createDataFrame([(i, json.dumps({**good, **c})) for i, (c, _) in enumerate(changes)], "i int, document string")
    assert [r["error"] for r in contracts.drafts(rows).orderBy("i").collect()] == [e for _, e in changes]


def test_error_categories():
    assert [contracts.error_category(e) for e in (TimeoutError(), PermissionError(), ConnectionResetError(), UnicodeError(), KeyError())] == ["timeout", "authorization", "unavailable", "invalid_response", "internal"]


def test_proposals(spark):
    base = {"tenant": "t", "subject": "s", "classification": "internal", "pii": False, "retention": "decayable", "epistemic": "observed-fact", "truth_status": None, "review_state": None, "valid_from": None, "valid_until": None, "created_at": 0.0, "roles": [], "role_groups": []}
    said = {"a": ["the refund was sent", "the refund was sent", "order 7 arrived"], "b": ["x words here", None], "c": ["one text alone"], "d": ["some words here", "other words here"]}
    rows = [{**base, "cluster_id": k, "id": f"{k}{i}", "content": t, "classification": "restricted" if k == "d" else "internal"} for k, v in said.items() for i, t in enumerate(v)]
    schema = "cluster_id string, id string, content string, tenant string, subject string, classification string, pii boolean, retention string, epistemic string, truth_status string, review_state string, valid_from string, valid_until string, created_at double, roles array<string>, role_groups array<array<string>>"
    members = spark.createDataFrame(rows, schema)
    seen = []

    def generate(asked):
        seen.extend(asked.collect())
        return asked.select("cluster_id", F.array_join("texts", " and ").alias("summary"), F.lit(None).cast("array<string>").alias("claims"))

    model = F.struct(*(F.lit(v).alias(k) for k, v in (("runtime", "api"), ("provider", "p"), ("region", "r"), ("retention", "zero"), ("training_opt_out", True), ("endpoint", None), ("provider_policy_id", None))))
    lst = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rules = F.struct(F.lit(True).alias("allow_external_models"), lst("p").alias("allowed_providers"), lst("r").alias("allowed_regions"), F.lit(True).alias("require_zero_retention"), F.lit(False).alias("allow_redaction"), lst().alias("redactable_pii_labels"), lst().alias("deny_pii_labels"), lst("restricted").alias("deny_classifications"), lst().alias("human_review_classifications"))
    got = consolidate.proposals(members, generate, F.lit("2024-01-01").cast("timestamp"), 2, model, rules).cache()
    assert {r["cluster_id"]: r["outcome"] for r in got.collect()} == {"a": "proposed", "b": "unavailable", "c": "unsafe", "d": "egress"}
    # copies come once, and nothing is shown that may not be
    assert [(r["cluster_id"], r["texts"]) for r in seen] == [("a", ["the refund was sent", "order 7 arrived"])]
    a = got.where("cluster_id = 'a'").first()
    assert (a["review_state"], a["epistemic"], a["truth_status"], a["content"]) == ("proposed", "model-generated", "generated_supported", "the refund was sent and order 7 arrived")
    assert sorted((r["child"], r["parent"]) for r in consolidate.proposal_edges(got, members).collect()) == [(a["id"], f"a{i}") for i in range(3)]
    assert consolidate.proposals(members.limit(0), lambda asked: asked.select("cluster_id", F.lit("").alias("summary"), F.lit(None).alias("claims")), F.current_timestamp()).count() == 0


def test_roundtrip(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), b"k" * 32)
    who = Principal("admin", "tenant:a", (), {}, "internal")
    assert e.verify_roundtrip(who) == {"written": True, "recalled": True, "removed": True, "ok": True}
    assert e.table("records").isEmpty() and e.verify_audit()["ok"]


def test_contracts_are_privileged(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), b"k" * 32)
    admin = Principal("admin", "tenant:a", ("continuity-admin",), {}, "restricted")
    doc = {
        "schema_version": "1", "route_id": "route_" + "a" * 12, "provider": "acme", "model": "m-1", "tool_use": True, "structured_output": {"json_mode": True, "json_schema": True, "grammar": False}, "context_window_tokens": 10, "latency_class": "batch", "price_class": "economy", "residency": "eu",
        "fallback": {},
    }
    docs = spark.createDataFrame([(json.dumps(doc),), (json.dumps({**doc, "model": "m-9"}),), (json.dumps(dict(reversed(doc.items()))),)], "document string")
    with pytest.raises(PermissionError):
        e.store_contracts(docs, {"acme": ["m-1"]}, Principal("x", "tenant:a", (), {}, "restricted"))
    # the same contract in another order of keys is the same
    assert e.store_contracts(docs, {"acme": ["m-1"]}, admin) == {"approved_provider_model": 1, "written": 1}
    assert e.store_contracts(docs, {"acme": ["m-1"]}, admin)["written"] == 0
    stored = e.contracts(admin)
    assert [json.loads(r["document"]) for r in stored.collect()] == [doc]
    binding = stored.select("route_id", "schema_version", "contract_hash")
    assert [r["bound"] for r in contracts.bound(binding.unionByName(binding.withColumn("route_id", F.lit("route_x"))), stored).orderBy("bound").collect()] == [False, True]
    assert e.recall("acme batch economy", admin).count() == 0
    other = {**doc, "route_id": "route_" + "b" * 12}
    e.store_contracts(spark.createDataFrame([(json.dumps(other),)], "document string"), {"acme": ["m-1"]}, admin)
    hashes = {r["route_id"]: r["hash"] for r in e.contracts(admin).collect()}
    bind = lambda d: {"route_id": d["route_id"], "schema_version": "1", "contract_hash": hashes[d["route_id"]]}
    case = {"case_id": "case_" + "a" * 12, "before": "pass", "after": "pass", "delta": 0, "before_error_category": None, "after_error_category": None, "fallback": {"attempted": False, "fallback_exercised": False}}
    draft = {
        "schema_version": "1", "receipt_id": "rot_" + "a" * 12, "evidence_mode": "prototype", "from_route": doc["route_id"], "to_route": other["route_id"], "from_contract": bind(doc), "to_contract": bind(other),
        "eval_suite": {"eval_suite_id": "suite_" + "a" * 12, "schema_version": "v1", "eval_suite_hash": "sha256:" + "0" * 64}, "run_id": "run_" + "a" * 12, "prior_baseline": {"is_genesis": True}, "ts": "2024-01-01T00:00:00Z", "cases": [case], "summary": {"passed": 1, "degraded": 0, "failed": 0},
    }
    with pytest.raises(PermissionError):
        e.issue_receipt(json.dumps({**draft, "evidence_mode": "production"}), admin)
    with pytest.raises(ValueError, match="contract_binding"):
        e.issue_receipt(json.dumps({**draft, "to_contract": {**bind(other), "contract_hash": "sha256:" + "1" * 64}}), admin)
    one = e.issue_receipt(json.dumps(draft), admin)
    with pytest.raises(ValueError, match="prior_baseline"):
        e.issue_receipt(json.dumps(draft), admin)
    base = {"receipt_id": one["receipt_id"], "receipt_hash": one["receipt_hash"], "audit_seq": one["audit_seq"]}
    with pytest.raises(ValueError, match="prior_baseline"):
        e.issue_receipt(json.dumps({**draft, "prior_baseline": {**base, "receipt_hash": "sha256:" + "2" * 64}}), admin)
    two = e.issue_receipt(json.dumps({**draft, "receipt_id": "rot_" + "b" * 12, "prior_baseline": base}), admin)
    fields = ", ".join(f"{f} {'long' if f.endswith('_seq') else 'string'}" for f in (*receipts.FIELDS, "signature"))
    held = spark.createDataFrame([tuple(r[f] for f in (*receipts.FIELDS, "signature")) for r in (one, two, {**two, "status": "production"})], fields)
    assert sorted((r["receipt_id"], r["signature_valid"], r["ok"]) for r in e.verify_receipts(held, admin).collect()) == [(one["receipt_id"], True, True), (two["receipt_id"], False, False), (two["receipt_id"], True, True)]
    assert e.verify_audit()["ok"]
    with pytest.raises(PermissionError):
        e.contracts(Principal("x", "tenant:a", ("reviewer",), {}, "restricted"))
    assert e.contracts(Principal("x", "tenant:b", ("continuity-admin",), {}, "restricted")).count() == 0
    ready = e.readiness(dims=3, found_dims=3, most_age_s=3600)
    assert ready["ready"] and not e.readiness(dims=3, found_dims=4)["ready"] and not e.readiness(most_age_s=-1)["ready"]


def test_tools_are_a_closed_list(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), b"k" * 32)
    tokens = Credentials({"t1": Principal("agent", "tenant:a", ("support",), {}, "internal")})
    tools = Tools(e, tokens, ("remember", "recall", "evaluate_egress", "assess_faithfulness"))
    denied, bad = {"ok": False, "error": "authorization"}, {"ok": False, "error": "invalid_response"}
    assert tools.call("forget", {"subject": "s"}, "t1") == denied and Tools(e, tokens).call("recall", {"query": "x"}, "t1") == denied
    assert tools.call("recall", {"query": "x"}, "t2") == denied and tools.call("recall", {"query": "x"}, None) == denied
    assert tools.call("recall", {"query": "x", "roles": ["billing"]}, "t1") == bad and tools.call("remember", {"records": [{"content": "x", "subject": "s", "tenant": "b"}]}, "t1") == bad
    assert tools.call("recall", "not json", "t1") == bad and tools.call("recall", {"nonsense": 1}, "t1") == bad and tools.call("remember", {"records": []}, "t1") == bad
    assert tools.call("remember", json.dumps({"records": [{"content": "the refund was sent", "subject": "s:1", "epistemic": "model-generated", "confidence": 0.5}]}), "t1")["result"]["written"] == 1
    got = tools.call("recall", {"query": "refund", "k": 999}, "t1")["result"]["results"]
    assert [(r["content"], r["review_badge"], r["confidence"], r["signature_ok"]) for r in got] == [("the refund was sent", "unreviewed", 0.5, True)] and set(got[0]["signals"]) == {"dense", "bm25", "rrf", "rerank"}
    assert tools.call("evaluate_egress", {"request": {"model": {"runtime": "local"}, "spans": [{"span_id": "a", "text": "x"}]}}, "t1")["result"]["decision"] == "local_model_only"
    told = tools.call("assess_faithfulness", {"claims": [{"claim": "refund was sent", "support": "the refund was sent"}, {"claim": "order 7 arrived", "support": "the refund was sent"}]}, "t1")["result"]
    assert told["decision"] == "rejected" and [c["label"] for c in told["claims"]] == ["supported", "unsupported"]
    with pytest.raises(ValueError):
        Tools(e, tokens, ("shell",))


def test_anchors_as_a_stream(spark, tmp_path):
    schema = "chain_id string, seq long, row_hash string"
    (tmp_path / "in").mkdir()
    now = [1000.0]
    log = AnchorLog(spark, f"file://{tmp_path}/log", b"k", "s1", clock=lambda: now[0])

    def run(*rows):
        heads(spark, *rows).write.mode("append").json(str(tmp_path / "in"))
        writer = anchored(spark.readStream.schema(schema).json(str(tmp_path / "in")), log, 3, 60.0)
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return writer.receipts

    assert run((CHAIN, 1, "a"), (CHAIN, 2, "b"), (OTHER, 1, "c")) == [{"ok": True, "append": 2}]
    # two more rows are too few, and too soon
    assert run((CHAIN, 3, "a"), (CHAIN, 4, "b")) == [{"ok": True}]
    assert run((CHAIN, 5, "d")) == [{"ok": True, "append": 1}]
    now[0] = 2000.0
    assert run((OTHER, 2, "e")) == [{"ok": True, "append": 1}]
    assert sorted((r["chain_id"], r["seq"]) for r in log.checked().collect()) == [(CHAIN, 2), (CHAIN, 5), (OTHER, 1), (OTHER, 2)]


def test_contextual_rows(spark):
    words = " ".join(f"w{i} alpha{i % 7}" for i in range(60))
    docs = spark.createDataFrame([("a", words, "internal"), ("b", words, "restricted"), ("c", words, None), ("d", words, "internal"), ("e", "", "internal"), ("f", None, "internal")], "id string, text string, classification string").withColumn("pii_labels", F.lit(None).cast("array<string>"))
    lst = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    model = F.struct(*(F.lit(v).alias(k) for k, v in (("runtime", "api"), ("provider", "p"), ("region", "r"), ("retention", "zero"), ("training_opt_out", True), ("endpoint", None), ("provider_policy_id", None))))
    rules = F.struct(F.lit(True).alias("allow_external_models"), lst("p").alias("allowed_providers"), lst("r").alias("allowed_regions"), F.lit(True).alias("require_zero_retention"), F.lit(False).alias("allow_redaction"), lst().alias("redactable_pii_labels"), lst().alias("deny_pii_labels"), lst("restricted").alias("deny_classifications"), lst().alias("human_review_classifications"))
    # of d the second chunk's context says what the text does not
    told = lambda parts: parts.withColumn("context", F.when((F.col("id") == "d") & (F.col("ordinal") == 1), "unrelated elephants").when(F.col("id") == "c", F.lit(None)).otherwise("alpha1 alpha2"))
    rows = ingest.contextual(docs, told, model, rules, 50, 5).orderBy("id", "ordinal").collect()
    assert [(r["id"], r["mode"], r["ordinal"]) for r in rows] == [("a", "contextual", 0), ("a", "contextual", 1), ("a", "contextual", 2), ("b", "whole_file", 0), ("c", "whole_file", 0), ("d", "whole_file", 0)]
    spans = ingest.chunk_spans(words, 50, 5)
    assert [(r["char_start"], r["char_end"], r["index_text"]) for r in rows[:3]] == [(a, b, "alpha1 alpha2\n\n" + words[a:b]) for a, b in spans] and rows[3]["index_text"] == words and rows[3]["char_end"] == len(words)


def test_contexts_that_repeat_their_chunk(spark):
    text = "alpha " * 50 + "of " * 50 + "refund denied"
    docs = spark.createDataFrame([(i, text, "internal", None) for i in "abcd"], "id string, text string, classification string, pii_labels array<string>")
    lst = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    model = F.struct(*(F.lit(v).alias(k) for k, v in (("runtime", "local"), ("provider", "p"), ("region", "r"), ("retention", "zero"), ("training_opt_out", True), ("endpoint", None), ("provider_policy_id", None))))
    rules = F.struct(F.lit(False).alias("allow_external_models"), *(lst().alias(k) for k in ("allowed_providers", "allowed_regions", "redactable_pii_labels", "deny_pii_labels", "deny_classifications", "human_review_classifications")), F.lit(False).alias("require_zero_retention"), F.lit(False).alias("allow_redaction"))
    # the second chunk has no word that counts; of b the last context denies its text, of c the first repeats another chunk, of d the second is of no such word and repeats none
    own = F.when((F.col("id") == "b") & (F.col("ordinal") == 2), "refund approved").when((F.col("id") == "c") & (F.col("ordinal") == 0), ("of " * 50).strip()).when((F.col("id") == "d") & (F.col("ordinal") == 1), "of of")
    told = lambda parts: parts.withColumn("context", own.when((F.col("ordinal") == 0), "alpha alpha").otherwise(F.concat(F.lit(" "), "chunk")))
    rows = ingest.contextual(docs, told, model, rules, 50, 0).orderBy("id", "ordinal").collect()
    assert [(r["id"], r["mode"], r["ordinal"]) for r in rows] == [("a", "contextual", 0), ("a", "contextual", 1), ("a", "contextual", 2), ("b", "whole_file", 0), ("c", "whole_file", 0), ("d", "whole_file", 0)]


def test_many_claims_on_a_text_are_labelled_as_one_by_one(spark):
    text = "Order 7 was approved on monday, it may be late. The refund is 5% of $20."
    claims = ["order 7 approved", "order 7 denied", "the refund is 6%", "refund refund", "", "monday late", "order 7 approved may be late"]
    many = gates.claim_labels(F.col("claims"))(spark.createDataFrame([(text, claims)], "support string, claims array<string>")).first()["labels"]
    rows = spark.createDataFrame([(i, c, text, True) for i, c in enumerate(claims)], "i int, claim string, support string, cited boolean")
    assert many == [r["label"] for r in gates.check_claims(rows).orderBy("i").collect()] and len(set(many)) > 2
