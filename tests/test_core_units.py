"""Operators on small literals: cases that the tables do not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import values as V
from millrace.operators import audit, consolidate, gates, graph, ingest, policy, receipts
from millrace.plans import governance, more  # noqa: F401  (add their queries)
from millrace.plans.queries import QUERIES
from millrace.sources import files
from millrace.streaming import limits


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_chunks_follow_tokens_and_overlap():
    text = "one two three four five six seven eight nine ten eleven twelve"
    assert [text[a:b] for a, b in ingest.chunk_spans(text, 5, 2)] == ["one two three four five", "four five six seven eight nine ten", "nine ten eleven twelve"]


def test_chunks_keep_headings_and_paragraphs_apart():
    text = "# A\nalpha beta\n\ngamma delta\n# B\nepsilon"
    spans = ingest.chunk_spans(text, 3, 0)
    assert [text[a:b] for a, b in spans] == ["# A\nalpha beta", "gamma delta", "# B\nepsilon"] and spans == [(0, 14), (16, 27), (28, 39)]
    assert ingest.chunk_spans("  \n ", 3, 1) == []
    with pytest.raises(ValueError):
        ingest.chunk_spans("a", 3, 3)


def test_frontmatter():
    fields, body = files.frontmatter("---\r\ntitle: 'A: b'\r\ntags: [x, 2, true]\r\nroles:\r\n- a\r\n- b\r\nempty: null\r\nn: 1.5\r\n---\r\nbody")
    assert fields == {"title": "A: b", "tags": ["x", 2, True], "roles": ["a", "b"], "empty": None, "n": 1.5}
    assert body == "body"
    assert files.frontmatter("no fence") == ({}, "no fence")
    assert files.frontmatter("---\na: 1")[0] == {}


def test_markdown_source_skips_hidden_files(spark, tmp_path):
    (tmp_path / "a/.hidden").mkdir(parents=True)
    (tmp_path / "a/x.md").write_text("---\nkind: source\n---\nHallo")
    (tmp_path / "a/.hidden/y.md").write_text("no")
    (tmp_path / "z.txt").write_text("no")
    rows = files.with_frontmatter(files.read_markdown(spark, str(tmp_path))).collect()
    assert [(r["relative_path"], r["fields"], r["body"]) for r in rows] == [("a/x.md", {"kind": "source"}, "Hallo")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "subject": "s"}\n\nnot json\n')
    rows = files.read_json_records(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()
    assert [(r["fields"], r["error"]) for r in rows] == [({"text": "x", "subject": "s"}, None), (None, "not a JSON object")]
    (tmp_path / "b.json").write_text('{"records": [{"text": "x"}, {"text": "y"}]}')
    assert [r["fields"]["text"] for r in files.read_json_records(spark, str(tmp_path / "b.json")).orderBy("line").collect()] == ["x", "y"]


def test_secrets_and_placeholders(spark):
    key = "AKIA" + "Q" * 16
    rows = spark.createDataFrame([(f"the key {key} is",), (f"example {key}",), (f"example {'.' * 30}, {key}",), (f"example: {key} {'z' * 40} {key}",), ("none",)], "t string")
    assert [r[0] for r in rows.select(T.shows_secret(F.col("t"))).collect()] == [True, False, False, True, False]


def test_review_moves(spark):
    legal = {(a, b) for a, to in policy.TRANSITIONS.items() for b in to}
    states = spark.createDataFrame([(a, b) for a in policy.TRANSITIONS for b in policy.TRANSITIONS], "a string, b string")
    for roles in (["reviewer"], []):
        for r in states.select("a", "b", policy.move_refusal(F.col("a"), F.col("b"), roles).alias("no")).collect():
            assert (r["no"] is None) == (bool(roles) and (r["a"], r["b"]) in legal)


def test_validity_is_half_open_and_bad_bounds_do_not_bind(spark):
    at = F.lit("2024-01-02").cast("timestamp")
    ok = lambda a, b: one(spark, V.valid_at(F.lit(a).cast("string"), F.lit(b).cast("string"), at))[0]
    assert ok("2024-01-02", None) and not ok("2024-01-03", None)
    assert not ok(None, "2024-01-02") and ok(None, "2024-01-03")
    assert ok("soon", "2024") and ok(None, None)


def test_claim_labels(spark):
    def label(claim, support, cited=True):
        return one(spark, T.claim_label(F.lit(claim), F.lit(support), F.lit(cited)))[0]

    assert label("x", "x", False) == label("x", "") == "not_checkable"
    assert label("customer is eligible", "the customer is not eligible") == "contradicted"
    # the phrase holds its opposite, so even equal texts contradict each other
    assert label("not eligible", "not eligible") == "contradicted"
    assert label("order 7 shipped", "order 8 shipped") == "unsupported"
    assert label("parcel shipped monday", "parcel may have shipped monday") == "partially_supported"
    assert label("parcel shipped monday", "the parcel shipped on monday") == "supported"
    assert label("parcel shipped monday", "parcel monday") == "partially_supported"
    assert label("parcel shipped monday", "weather") == "unsupported"


def test_redaction_order_and_leaks(spark):
    r = one(spark, T.redact(F.lit("mail a@b.co, call 555-123-4567, id 123-45-6789, customer 42")).alias("a"), T.detected_pii(F.lit("customer 42 a@b.co")).alias("b"))
    assert r["a"] == "mail [REDACTED_EMAIL], call [REDACTED_PHONE], id [REDACTED_SSN], [REDACTED_CUSTOMER_ID]"
    assert r["b"] == ["email"]


def test_leak_after_redaction_is_denied(spark):
    row = {
        "id": "a", "model": {"runtime": "api", "provider": "p", "region": "us", "retention": "zero", "training_opt_out": True, "endpoint": None, "provider_policy_id": None},
        "policy": {"allow_external_models": True, "allowed_providers": ["p"], "allowed_regions": ["us"], "require_zero_retention": True, "allow_redaction": True, "redactable_pii_labels": ["email"], "deny_pii_labels": [], "deny_classifications": [], "human_review_classifications": []},
        "spans": [{"span_id": "s", "classification": None, "pii_labels": ["email"], "text": "a@b.co 555-123-4567"}],
    }
    schema = "id string, model struct<runtime:string,provider:string,region:string,retention:string,training_opt_out:boolean,endpoint:string,provider_policy_id:string>, policy struct<allow_external_models:boolean,allowed_providers:array<string>,allowed_regions:array<string>,require_zero_retention:boolean,allow_redaction:boolean,redactable_pii_labels:array<string>,deny_pii_labels:array<string>,deny_classifications:array<string>,human_review_classifications:array<string>>, spans array<struct<span_id:string,classification:string,pii_labels:array<string>,text:string>>"
    entry = "array<struct<provider_policy_id:string,provider:string,runtime:string,region:string,retention:string,training_opt_out:boolean,endpoint:string,status:string,allowed_classifications:array<string>,denied_pii_labels:array<string>>>"
    df = spark.createDataFrame([row], schema).withColumn("providers", F.lit(None).cast(entry))
    got = gates.egress(df).first()
    assert (got["decision"], got["payload"], got["leaks"], got["classifications"]) == (gates.DENIED, None, ["phone"], ["internal"])


def test_chain_detects_edits_gaps_and_nothing_else(spark):
    rows = spark.createDataFrame([(1, i, dt.datetime(2024, 1, 1, 0, 0, i), f"b{i}") for i in range(1, 6)], "chain_id long, seq long, ts timestamp, body string")
    chain = audit.chained(rows).cache()
    assert audit.chain_status(chain).first()["ok"]
    edited = chain.withColumn("body", F.when(F.col("seq") == 3, "x").otherwise(F.col("body")))
    assert audit.chain_status(edited).first()["first_bad_seq"] == 3
    assert audit.chain_status(chain.where("seq <> 3")).first()["first_bad_seq"] == 4
    # a cut tail shows only against anchors
    anchors = audit.anchors_of(chain, 5)
    now = F.lit("2024-01-01").cast("timestamp")
    assert audit.chain_status(chain.where("seq < 5")).first()["ok"]
    assert audit.against_anchors(chain.where("seq < 5"), anchors, now).first()["first_failure"] == "row_missing"
    assert audit.against_anchors(chain, anchors, now).first()["first_failure"] is None


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_chains_hold_or_fail_alike_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(audit, "BLOCK", block)
    rows = spark.createDataFrame([(c, i * (c or 1), dt.datetime(2024, 1, 1, 0, 0, i), f"b{i}") for c in (None, 1, 7) for i in range(1, 9)], "chain_id long, seq long, ts timestamp, body string")
    chain = audit.chained(rows).cache()
    assert {(r["chain_id"], r["n_rows"], r["ok"]) for r in audit.chain_status(chain).collect()} == {(None, 8, True), (1, 8, True), (7, 8, True)}
    cut = chain.where("chain_id = 7 AND seq NOT IN (7, 35)")
    assert [r["seq"] for r in audit.verified(cut).where("failure = 'link'").orderBy("seq").collect()] == [14, 42]
    edited = chain.where("chain_id = 1").withColumn("row_hash", F.when(F.col("seq") == 4, "0" * 64).otherwise(F.col("row_hash")))
    assert [(r["seq"], r["failure"]) for r in audit.verified(edited).where("failure IS NOT NULL").orderBy("seq").collect()] == [(4, "hash"), (5, "link")]
    nulled = edited.withColumn("row_hash", F.when(F.col("seq") == 4, None).otherwise(F.col("row_hash")))
    assert [(r["seq"], r["failure"]) for r in audit.verified(nulled).where("failure IS NOT NULL").orderBy("seq").collect()] == [(4, "hash"), (5, "link")]
    chain.unpersist()


def test_anchor_ladder(spark):
    rows = spark.createDataFrame([(1, i, dt.datetime(2024, 1, 1, 0, 0, i), f"b{i}") for i in range(1, 9)], "chain_id long, seq long, ts timestamp, body string")
    chain = audit.chained(rows).cache()
    anchors = audit.anchors_of(chain, 2).withColumn("position", F.col("seq")).cache()
    now = F.lit("2024-01-01 00:00:08").cast("timestamp")

    def failure(c, a, **more):
        return audit.against_anchors(c, a, now, **more).first()["first_failure"]

    assert failure(chain, anchors) is None
    assert failure(chain, anchors.limit(0)) == "no_anchors"
    assert failure(chain.limit(0), anchors) == "row_missing"
    assert audit.against_anchors(chain.limit(0), anchors.limit(0), now).count() == 0
    assert failure(chain, anchors.withColumn("anchor_id", F.lit("a"))) == "duplicate_anchor_id"
    assert failure(chain, anchors.withColumn("position", -F.col("seq"))) == "reordered_seq"
    other = anchors.withColumn("row_hash", F.when(F.col("seq") == 4, "x").otherwise(F.col("row_hash")))
    assert failure(chain, other) == "row_hash_mismatch"
    assert failure(chain.where("seq <> 2"), other) == "row_missing"
    assert failure(chain.where("seq <> 6"), other) == "row_hash_mismatch"
    assert failure(chain.withColumn("row_hash", F.when(F.col("seq") == 4, None).otherwise(F.col("row_hash"))), anchors) == "row_hash_mismatch"
    assert failure(chain.where("seq <> 3"), anchors) == "chain_invalid"
    assert failure(chain, anchors.where("seq < 6"), every_rows=4) == "stale" and failure(chain, anchors.where("seq < 6"), every_rows=5) is None
    assert failure(chain, anchors.where("seq < 6"), every_seconds=4) == "stale"
    chain.unpersist()
    anchors.unpersist()


def test_bundle_ladder(spark):
    rows = spark.createDataFrame([(1, i, dt.datetime(2024, 1, 1, 0, 0, i), f"b{i}") for i in range(1, 9)], "chain_id long, seq long, ts timestamp, body string")
    chain = audit.chained(rows).cache()
    anchors = audit.anchors_of(chain, 3)
    kept, manifest = audit.bundle(chain, anchors)
    top = anchors.orderBy(F.desc("seq")).first()["anchor_id"]

    def verdict(r, a, m, *pins):
        return [tuple(x)[1:] for x in audit.verify_bundle(r, a, m, spark.createDataFrame(list(pins), "chain_id long, trusted boolean, latest_anchor_id string")).collect()]

    assert verdict(kept, anchors, manifest, (1, True, top)) == [("PASS", None)]
    for pins in ([], [(1, None, top)], [(1, False, top)], [(2, True, top)]):
        assert verdict(kept, anchors, manifest, *pins) == [("UNTRUSTED_SELF_CONSISTENT", "external_trust_root_required")]
    assert verdict(kept, anchors, manifest, (1, True, None)) == [("FRESHNESS_UNVERIFIED", "external_latest_anchor_checkpoint_required")]
    assert verdict(kept, anchors, manifest, (1, True, "other")) == [("FAIL", "expected_latest_anchor_checkpoint_mismatch")]
    tail = manifest.withColumn("rows", F.lit(8)).withColumn("last_seq", F.lit(8))
    assert verdict(chain, anchors, tail, (1, True, top)) == [("FAIL", "unsigned_rows_after_latest_anchor")]
    assert verdict(chain, anchors, manifest, (1, True, top)) == verdict(kept.limit(0), anchors, manifest, (1, True, top)) == verdict(kept, anchors, manifest.limit(0), (1, True, top)) == [("FAIL", "manifest_range")]
    assert verdict(kept, anchors.limit(0), manifest, (1, True, top)) == [("FAIL", "no_anchors")]
    assert verdict(kept.limit(0), anchors.limit(0), manifest.limit(0)) == []
    chain.unpersist()


def test_builders_of_fields(spark):
    def made(build, **fields):
        f = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv)).cast("map<string,string>")
        return one(spark, build(f).alias("x"))["x"]

    assert tuple(made(V.policy_from, x="")) == ("tenant", "internal", False, [], [], "decayable", [])
    assert tuple(made(V.policy_from, roles="a, b", pii="yes", attrs="k=v", role_groups="c,d", visibility="private")) == ("private", "internal", True, ["a", "b"], [("k", "v")], "decayable", [["c", "d"]])
    assert made(V.policy_from, role_groups='[["a","b"],[],["c"]]')["role_groups"] == [["a", "b"], ["c"]]
    assert made(V.policy_from, role_groups="[a")["role_groups"] is None and made(V.policy_from, role_groups='["a"]')["role_groups"] is None
    assert tuple(made(V.principal_from, x="")) == ("agent:recall", "tenant:default", [], [], "internal")
    assert tuple(made(V.principal_from, principal_id="", id="me", tenant="en", clearance="public", attrs="a:b"))[:2] == ("me", "tenant:en")
    assert made(V.source_from, x="") is None and made(V.source_from, source=" ", source_uri="", uri="u") is None
    assert tuple(made(V.source_from, source=" s ", path="p")) == ("bulk", "s", None)
    assert tuple(made(V.source_from, source_id="i", uri="u", path="p", source_kind="k")) == ("k", "i", "p")


def test_receipts_fail_closed(spark):
    schema = "chain_id long, audit_seq long, receipt_id string, receipt_hash string, lineage_hash string, status string, signed_by string, baseline_seq long, baseline_id string, baseline_hash string"
    rows = [
        (1, 1, "r1", "h1", "a", "p", "me", None, None, None),  # the first of its lineage
        (1, 2, "r2", "h2", "a", "p", "me", 1, "r1", "h1"),
        (1, 3, "r3", "h3", "a", "p", "me", None, None, None),  # not the first
        (1, 4, "r4", "h4", "a", "p", "me", 5, "r5", "h5"),  # names a later one
        (1, 5, "r5", "h5", "b", "p", "me", 2, "r2", None),  # names no hash
        (1, 6, "r6", "h6", None, "p", "me", None, None, None),  # no lineage
    ]
    drafts = spark.createDataFrame(rows, schema)
    said = drafts.select("chain_id", F.col("audit_seq").alias("seq"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"), receipts.event_body(F.lit("t")).alias("body"))
    chain = audit.chained(said).cache()
    held = receipts.sealed(drafts, b"k").withColumn("extra", F.lit(0)).cache()

    def check(r, c, key=b"k", tenant="t"):
        return {x["receipt_id"]: (x["signature_valid"], x["audit_event_valid"], x["audit_chain_valid"], x["baseline_valid"], x["ok"]) for x in receipts.verified(r, c, key, tenant).collect()}

    got = check(held, chain)
    assert got["r1"] == got["r2"] == (True, True, True, True, True)
    assert {k for k, v in got.items() if v == (True, True, True, False, False)} == {"r3", "r4", "r5", "r6"}
    assert check(held, chain, b"other")["r1"] == (False, True, True, True, False)
    assert check(held, chain, tenant="u")["r2"] == (True, False, True, False, False)
    assert check(held, chain.where("seq <> 2"))["r2"] == (True, False, False, True, False)
    assert check(held, chain.limit(0))["r2"] == (True, False, False, False, False)
    assert check(held.withColumn("signature", F.lit(None).cast("string")), chain)["r1"][0] is False
    assert check(held.limit(0), chain) == {}
    chain.unpersist()
    held.unpersist()


def test_edge_import_counts_each_pair_once(spark):
    edges = spark.createDataFrame([("a", "b", "cites")], "child string, parent string, kind string")
    records = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    rows = [("a", "b", "x", 0), ("b", "c", "x", 1), ("b", "c", "x", 2), ("b", "c", "y", 0), ("c", "z", "x", 3), (None, "a", "x", 4), ("a", " ", None, 5), ("c", "d", "", 6)]
    told = graph.proposals(spark.createDataFrame(rows, "child string, parent string, kind string, ordinal long"), records)
    found = spark.createDataFrame([("b", 0, "edge", "c"), ("d", 0, "edge", "a"), ("d", 1, "edge", "a"), ("d", 2, "self", None), ("d", 3, "dangling", None), ("d", 4, "ambiguous", None)], "id string, place int, outcome string, parent string")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in graph.import_report(edges, told, found).collect()}
    # rows, inserted, duplicate, missing, ambiguous, self, invalid
    assert got == {
        ("proposal", "x"): (5, 0, 3, 1, 0, 0, 1), ("proposal", "y"): (1, 1, 0, 0, 0, 0, 0), ("proposal", "related_to"): (2, 1, 0, 0, 0, 0, 1), ("wikilinks", "links_to"): (6, 1, 2, 1, 1, 1, 0),
    }
    assert graph.import_report(edges, told.limit(0), found.limit(0)).count() == 0


def test_closure_of_diamond_chain_and_cycle(spark):
    pairs = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d")] + [(f"n{i + 1}", f"n{i}") for i in range(18)]
    edges = spark.createDataFrame([(c, p, "derived_from") for c, p in pairs], "child string, parent string, kind string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in graph.descendants(edges, seeds).collect()} == {("b", 1), ("c", 1), ("d", 2)}
    assert graph.descendants(edges, spark.createDataFrame([("n0",)], "id string")).count() == 18
    assert graph.ancestors(edges, spark.createDataFrame([("n18",)], "id string")).count() == 16


def test_wikilinks(spark):
    records = spark.createDataFrame(
        [("1", "s:one", "markdown://n/one", "n/one.md", "see [[Two]], [[two|alias]], ![[two]], [[none]], [[One#h]], [[Dup]]"), ("2", "s:two", "", "n/two.md", ""), ("3", "s:dup", "", "a/dup.md", ""), ("4", "s:dup", "", "b/dup.md", "")],
        "id string, subject string, uri string, path string, content string",
    )
    got = [(r["target"], r["outcome"], r["parent"]) for r in graph.wikilinks(records, graph.aliases(records)).orderBy("place").collect()]
    assert got == [("Two", "edge", "2"), ("two", "edge", "2"), ("none", "dangling", None), ("One", "self", None), ("Dup", "ambiguous", None)]


def test_rate_limit_counts_only_what_passed(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", t + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 10, 11, 12])], "key string, ts timestamp, event_id int")
    got = limits.rate_limited(rows, 2, 10.0).orderBy("event_id").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True, True, False]


def test_streaming_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limits.tumbling(stream, "6 hours", "40 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r)[:3] for r in spark.sql("select start, event_type, n from w").collect()} == {tuple(r) for r in limits.tumbling(events, "6 hours").select("start", "event_type", "n").collect()}


def test_policy_on_private_attrs_and_groups(spark):
    who = policy.Principal("me", "t", ("a", "b"), {"region": "us"}, "internal")
    row = dict(tenant="t", classification="internal", roles=["a"], role_groups=[["b", "c"], []], attrs=[("region", "us")], visibility="tenant", created_by="x")
    schema = "tenant string, classification string, roles array<string>, role_groups array<array<string>>, attrs array<struct<k:string,v:string>>, visibility string, created_by string"
    cases = [({}, "ok"), ({"tenant": "u"}, "cross-tenant"), ({"classification": "restricted"}, "classification>clearance"), ({"role_groups": [["c"]]}, "role"), ({"attrs": [("region", "eu")]}, "attr:region"), ({"visibility": "private"}, "private"), ({"visibility": "private", "created_by": "me"}, "ok"), ({"roles": [], "role_groups": None, "attrs": None}, "ok")]
    df = spark.createDataFrame([{**row, **c} for c, _ in cases], schema)
    assert [r[0] for r in df.select(policy.deny_reason(who)).collect()] == [x for _, x in cases]


def test_near_clusters_cross_labels_and_keep_rows_without_one(spark, monkeypatch):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [0.9, 0.1]), (3, None, [0.8, 0.2]), (4, "a", [0.0, 1.0]), (5, "b", [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    clusters = lambda **kw: [(r["ids"], r["key"]) for r in consolidate.near_neighbourhoods(df, 0.5, **kw).collect()]
    assert clusters() == [([1, 2, 3], 1)] and clusters(block="label") == []
    monkeypatch.setattr(consolidate, "BLOCK", 2)
    assert clusters() == [([1, 2, 3], 1)]


def test_whole_table_queries_keep_other_tenants_and_sources(spark, tmp_path):
    rows = [(12, "a\nb\nc\nd", "it", "src9", 7), (24, "a\nb", "en", "src1", 3), (36, "x", None, "src2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {tuple(r) for r in QUERIES["r28_recall_by_tenant"](spark, str(tmp_path)).collect()} == {("tenant:it", 1), ("tenant:en", 1), (None, 1)}
    assert {(r["id"][-2:], r["lines"]) for r in QUERIES["s18_line_ranges_all"](spark, str(tmp_path)).collect()} == {("12", "b\nc"), ("24", "b"), ("36", "")}


def test_what_is_unknown_is_denied(spark):
    from millrace.operators import policy
    from millrace.operators.policy import Principal

    schema = "id string, tenant string, classification string, roles array<string>, role_groups array<array<string>>, attrs array<struct<k:string,v:string>>, visibility string, created_by string, pii boolean"
    good = ("ok", "t", "public", [], [], [], "tenant", "x", False)
    change = lambda name, **new: tuple({**dict(zip(("id", "tenant", "classification", "roles", "role_groups", "attrs", "visibility", "created_by", "pii"), good, strict=True)), "id": name, **new}.values())
    rows = [
        good, change("no tenant", tenant=None), change("no class", classification=None), change("odd class", classification="secret"), change("no role", roles=[None]), change("null group", role_groups=[None]),
        change("no attr", attrs=[(None, None)]), change("null value", attrs=[("region", None)]), change("null visibility", visibility=None), change("odd visibility", visibility="hidden"), change("private of nobody", visibility="private", created_by=None),
        change("no lists", roles=None, role_groups=None, attrs=None), change("own", visibility="private", created_by="me"),
    ]
    df = spark.createDataFrame(rows, schema)
    me = Principal("me", "t", ("a",), {"region": "us"}, "restricted")
    got = {r["id"]: r["why"] for r in df.select("id", policy.deny_reason(me).alias("why")).collect()}
    assert got == {
        "ok": "ok", "no tenant": "cross-tenant", "no class": "classification>clearance", "odd class": "classification>clearance", "no role": "role", "null group": "role", "no attr": "attr:", "null value": "attr:region",
        "null visibility": "private", "odd visibility": "private", "private of nobody": "private", "no lists": "ok", "own": "ok",
    }
    edges = spark.createDataFrame([("ok", "odd class", "x"), ("own", "null group", "x")], "child string, parent string, kind string")
    child = df.drop("classification", "role_groups", "pii").join(policy.inherited(df, edges), "id")
    assert {r["id"]: r["why"] for r in child.select("id", policy.deny_reason(me).alias("why")).collect()} == {"ok": "classification>clearance", "own": "role"}


def test_allowed_phrases_are_the_four_plain_ones(spark):
    from millrace.operators import strict

    lines = ["it is tamper-evident, so tamper proof", "tamper evidence: tamper-proof", "a tamper_evident tamper-proof thing", "tamper_evidence, tamperproof"]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    assert [r["id"] for r in strict.claim_lint(df).collect()] == [2]


def test_requests_unite_lists_and_replace_values():
    from millrace.operators import policy

    got = policy.merged_filters({"kinds": ["a"], "subject": "s"}, {"kind": "b, a", "subject": "t", "intent": "", "entities": ["x"]}, 99, 500)
    assert got == ({"kinds": ["a", "b"], "subject": "t", "entities": ["x"]}, 50, 200)
    assert policy.merged_filters({}, {}, 20, 5) == ({}, 20, 20)


def test_provenance_tree_cuts_cycles_and_marks_what_is_missing(spark):
    from millrace.operators import graph

    edges = spark.createDataFrame([("a", "b", "x"), ("a", "c", "x"), ("b", "c", "x"), ("c", "gone", "x"), ("b", "a", "x")], "child string, parent string, kind string")
    records = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rows = graph.provenance(edges, records, spark.createDataFrame([("a",)], "id string")).collect()
    assert {(r["id"], r["depth"], r["missing"]) for r in rows} == {("a", 0, False), ("b", 1, False), ("c", 1, False), ("gone", 2, True)}
    cut = {"cycle_or_depth_cut": True}
    c = {"id": "c", "derived_from": [{"id": "gone", "missing": True}]}
    assert graph.provenance_tree(rows, "a") == {"id": "a", "derived_from": [{"id": "b", "derived_from": [{"id": "a", **cut}, c]}, {"id": "c", **cut}]}


def test_chunk_counts_are_those_of_their_texts(spark):
    import random
    import re

    rng = random.Random(3)
    texts = ["\n\n".join("# h" * (rng.random() < 0.2) + " ".join(rng.choice(("alpha", "be-ta", "é1", "x")) for _ in range(rng.randrange(1, 60))) for _ in range(12)) for _ in range(20)] + [None, "", " \n"]
    from millrace.operators import ingest

    rows = ingest.chunks(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 30, 5).collect()
    assert rows and {r["id"] for r in rows} == set(range(20))
    for r in rows:
        assert r["chunk"] == texts[r["id"]][r["char_start"] : r["char_end"]] and r["n_tokens"] == len(re.findall("[A-Za-z0-9]+", r["chunk"])) <= 35
