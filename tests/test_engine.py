"""The engine end to end: writing, policy, recall, review, erasure, audit."""

import pytest
from pyspark.sql import functions as F

from millrace.engine import Conflict, Engine
from millrace.operators.policy import Principal

AGENT = Principal("agent", "tenant:a", ("support",), {}, "internal")
CHIEF = Principal("chief", "tenant:a", ("support", "billing", "reviewer", "approver"), {}, "restricted")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), b"k" * 32)
    rows = [
        {"memory_id": "1", "text": "the refund was sent on monday", "subject": "s:1"},
        {"memory_id": "2", "body": "the refund policy of the shop", "subject_id": "s:2", "classification": "restricted", "roles": "billing"},
        {"memory_id": "3", "content": "a summary of the refund", "subject": "s:1b", "derived_from": "1,2", "epistemic": "model-generated"},
        {"memory_id": "4", "content": "weather in spring", "subject": "s:4", "valid_until": "2020-01-01"},
        {"memory_id": "5", "content": "", "subject": "s:5"},
        {"memory_id": "6", "content": "other tenant", "subject": "s:6", "tenant": "b"},
    ]
    df = spark.createDataFrame([(r,) for r in rows], "fields map<string,string>")
    report = e.remember_many(df, AGENT)
    assert report == {"ok": 4, "content is required": 1, "cross-tenant": 1, "written": 4}
    assert e.remember_many(df, AGENT)["written"] == 0
    return e


def test_recall_obeys_policy_before_scoring(engine):
    got = engine.recall("refund", AGENT).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["1"]
    assert got[0]["content"] == "the refund was sent on monday" and got[0]["content_ok"] and got[0]["signature_ok"]
    # the summary inherits the strictest policy of its sources
    assert {r["id"] for r in engine.recall("refund", CHIEF).collect()} == {"1", "2", "3"}
    told = engine.explain("refund", AGENT)
    assert told["visible"] == 1 and told["denied"] == {"classification>clearance": 2} and told["results"] == ["1"]
    assert engine.explain("refund", CHIEF)["paths"] == [("3", "1", "derived_from"), ("3", "2", "derived_from")]


def test_validity_and_review(engine):
    assert "4" not in {r["id"] for r in engine.recall("weather", AGENT).collect()}
    assert engine.expire("4", None, AGENT) == 1
    assert "4" in {r["id"] for r in engine.recall("weather", AGENT).collect()}
    with pytest.raises(ValueError):
        engine.expire("4", "soon", AGENT)
    assert engine.transition("3", "rejected", AGENT) == 0
    assert engine.transition("3", "rejected", CHIEF) == 1
    assert "3" not in {r["id"] for r in engine.recall("refund", CHIEF).collect()}
    assert "3" in {r["id"] for r in engine.recall("refund", CHIEF, {"include_review_states": ["rejected"]}).collect()}
    assert engine.approve("3", CHIEF) == 0 and engine.approve("1", CHIEF) == 1 and engine.approve("1", AGENT) == 0
    assert engine.recall("refund", AGENT).first()["signature_ok"]
    assert engine.set_indexed("4", False, AGENT) == 1 and engine.health()["index_lag"] == 1


def test_forgetting_cascades_and_is_audited(engine):
    before = engine.version()
    assert engine.forget("s:1", CHIEF) == {"subject": 1, "derived": 1}
    assert engine.version() == before + 1
    assert {r["id"] for r in engine.table("records").collect()} == {"2", "4"}
    assert engine.table("edges").count() == 0
    key = engine.table("keys").where("subject = 's:1'").first()
    assert key["state"] == "shredded" and key["dek"] is None
    assert engine.purge("4", CHIEF) and not engine.purge("4", CHIEF)
    status = engine.verify_audit()
    assert status["ok"] and status["n_rows"] == engine.version() and engine.versions() == [engine.version()]
    log = engine.table("audit").withColumn("body", F.when(F.col("seq") == 3, "{}").otherwise(F.col("body")))
    from millrace.operators import audit

    assert audit.chain_status(log).first()["first_bad_seq"] == 3


def test_markdown_import_updates_and_links(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), b"k" * 32)
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "reference_one.md").write_text("---\nsubject: s:one\n---\nabout [[project two]] and [[nothing]]")
    (notes / "project_two.md").write_text("key AK" + "IA" + "Q" * 16)
    assert e.import_markdown(str(notes), CHIEF) == {"insert": 2, "written": 2}
    got = {r["uri"]: r for r in e.table("records").collect()}
    assert got["markdown://reference_one.md"]["kind"] == "source" and got["markdown://reference_one.md"]["subject"] == "s:one"
    assert got["markdown://project_two.md"]["classification"] == "restricted" and got["markdown://project_two.md"]["pii"]
    assert e.import_links(CHIEF) == {"edge": 1, "dangling": 1, "inserted": 1}
    (notes / "project_two.md").write_text("no key")
    assert e.import_markdown(str(notes), CHIEF) == {"skip": 1, "update": 1, "written": 1}
    assert {r["uri"]: r["classification"] for r in e.table("records").collect()} == {"markdown://reference_one.md": "internal", "markdown://project_two.md": "internal"}
    assert e.verify_audit()["ok"]


def test_role_groups_of_fields_bind(spark, tmp_path):
    e = _store(spark, tmp_path / "store")
    rows = _rows(spark, {"id": "1", "text": "a", "subject": "s"}, {"id": "2", "text": "b", "subject": "s", "role_groups": '[["auditor"]]'}, {"id": "3", "text": "c", "subject": "s", "role_groups": "[broken"})
    assert e.remember_many(rows, CHIEF) == {"ok": 2, "role_groups": 1, "written": 2}
    assert e.table("records").where("id = '2'").first()["role_groups"] == [["auditor"]]
    reader = Principal("agent:x", CHIEF.tenant, ("clerk",), {}, "restricted")
    assert {r["id"] for r in e.readable(reader).collect()} == {"1"}
    assert {r["id"] for r in e.readable(Principal("agent:x", CHIEF.tenant, ("auditor",), {}, "restricted")).collect()} == {"1", "2"}


def _store(spark, folder):
    return Engine(spark, str(folder), b"k" * 32)


def _rows(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "fields map<string,string>")


def test_a_forgotten_subject_is_gone_from_every_file_and_stays_refused(spark, tmp_path):
    e = _store(spark, tmp_path / "store")
    e.remember_many(_rows(spark, {"id": "1", "text": "one secret", "subject": "s:1"}, {"id": "2", "text": "two", "subject": "s:2"}), CHIEF)
    key = e.table("keys").where("subject = 's:1'").first()["dek"]
    text = e.table("records").where("id = '1'").first()["content_enc"]
    stored = lambda: b"".join(p.read_bytes() for p in (tmp_path / "store").rglob("*.parquet"))
    assert bytes(key) in stored() and bytes(text) in stored()
    assert e.forget("s:1", CHIEF) == {"subject": 1}
    assert bytes(key) not in stored() and bytes(text) not in stored() and e.versions() == [2]
    # the same call makes another key, so nothing brings the first one back
    assert e.remember_many(_rows(spark, {"id": "1", "text": "one secret", "subject": "s:1"}, {"id": "3", "text": "three", "subject": "s:3"}), CHIEF) == {"erased subject": 1, "ok": 1, "written": 1}
    assert {r["id"]: r["content"] for r in e.readable(CHIEF).collect()} == {"2": "two", "3": "three"}
    assert e.forget("s:never", CHIEF) == {} and e.remember_many(_rows(spark, {"text": "x", "subject": "s:never"}), CHIEF) == {"erased subject": 1, "written": 0}
    other = _store(spark, tmp_path / "other")
    other.remember_many(_rows(spark, {"id": "1", "text": "one secret", "subject": "s:1"}), CHIEF)
    assert other.table("keys").first()["dek"] != key


def test_keys_stay_out_of_plans(spark, tmp_path):
    e = _store(spark, tmp_path / "store")
    e.remember_many(_rows(spark, {"text": "one", "subject": "s:1"}), CHIEF)
    plan = e.recall("one", CHIEF)._jdf.queryExecution().toString().lower()
    from millrace.functions import crypto

    pad = bytes(a ^ 0x36 for a in (b"k" * 32).ljust(64, b"\0"))
    for secret in (b"k" * 32, pad, crypto.derived_key(b"k" * 32, "wrap:tenant:a")):
        assert secret.hex() not in plan and str(list(secret))[1:-1] not in plan


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    e = _store(spark, tmp_path / "store")
    e.remember_many(_rows(spark, {"id": "1", "text": "one", "subject": "s:1"}), CHIEF)
    with e.change() as first, e.change() as second:
        a, b = (e._remember(c, _rows(spark, {"id": n, "text": n, "subject": n}), CHIEF) for c, n in ((first, "2"), (second, "3")))
        assert a["written"] == b["written"] == 1
        first.commit("remember", CHIEF, "records", a)
        with pytest.raises(Conflict):
            second.commit("remember", CHIEF, "records", b)
    assert {r["id"] for r in e.table("records").collect()} == {"1", "2"} and e.version() == 2
    # nothing of the refused change is left behind, and it can be made again
    held = {p.parent.name for p in (tmp_path / "store/data").rglob("*.parquet")}
    assert held == {x.rsplit("/", 1)[1] for entries in e.manifest(2).values() for x in entries}
    assert e.remember_many(_rows(spark, {"id": "3", "text": "3", "subject": "3"}), CHIEF)["written"] == 1
    assert e.verify_audit()["n_rows"] == 3


def test_changes_rewrite_only_the_files_they_touch(spark, tmp_path):
    e = _store(spark, tmp_path / "store")
    for n in "12":
        e.remember_many(_rows(spark, {"id": n, "text": n, "subject": n}), CHIEF)
    before = e.manifest(2)["records"]
    assert e.set_indexed("2", False, CHIEF) == 1 and e.set_indexed("9", False, CHIEF) == 0
    after = e.manifest(3)["records"]
    assert before[0] in after and before[1] not in after and e.table("records").count() == 2


def test_rows_of_one_id_and_odd_fields_are_counted(spark, tmp_path):
    e = _store(spark, tmp_path / "store")
    rows = _rows(
        spark,
        {"id": "1", "text": "a", "subject": "s"}, {"id": "1", "text": "b", "subject": "s"}, {"id": "2", "text": "c", "subject": "s", "attrs": "region=us,team:x", "visibility": "private", "source_spans": "p,q"},
        {"id": "3", "text": "d", "subject": "s", "attrs": "nothing"}, {"id": "4", "text": "e", "subject": "s", "visibility": "odd"}, {"id": "5", "text": "f", "subject": "s", "valid_until": "soon"},
    )
    assert e.remember_many(rows, CHIEF) == {"ok": 3, "attrs": 1, "visibility": 1, "valid_until": 1, "written": 2, "repeated": 1}
    assert e.remember_many(rows, CHIEF) == {"ok": 3, "attrs": 1, "visibility": 1, "valid_until": 1, "written": 0, "repeated": 1, "known": 2}
    two = e.table("records").where("id = '2'").first()
    assert two["attrs"] == [("region", "us"), ("team", "x")] and two["visibility"] == "private" and two["source_spans"] == ["p", "q"]
    assert {r["id"] for r in e.recall("a b c", CHIEF).collect()} == {"1"}
