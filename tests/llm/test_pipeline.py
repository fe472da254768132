"""The pipeline: each stage on its own input, against brute force where SQL has no form for it."""

import pytest
from test_llm import SF, _components, _cut, _leaks, prose

import corpus_pipeline as P
from millrace.llm import toxicity
from millrace.llm.jobs import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append((name, before.collect(), docs.collect()))
    return {name: (a, b) for name, a, b in out}


def test_toxicity_keeps_what_it_scores_under_half(spark, stages):
    before, after = stages["toxicity"]
    docs = table(spark, SF, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, SF, "labels"))).where("score < 0.5").collect()
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in scored} and len(after) > 0.6 * len(before)


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages["near_dedup"]
    parts = _components([(r["doc_id"], r["text"]) for r in before], 80)
    assert {r["doc_id"] for r in after} == {d for d, (_, c) in parts.items() if d == c}


def test_substring_stage_keeps_rows_and_cuts_texts(stages):
    before, after = stages["substring_dedup"]
    cut = _cut([(r["doc_id"], r["text"]) for r in before])
    same = {r["doc_id"]: r["text"] for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == {d: k if n else same[d] for d, (_, n, k) in cut.items()}


def test_decontamination_drops_what_brute_force_finds(duck, stages):
    before, after = stages["decontamination"]
    found = _leaks([(r["doc_id"], r["text"]) for r in before], duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone == {d for d, _ in found} and gone


def test_packing_takes_all(stages):
    before, after = stages["packing"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)


def test_run_equals_its_stages(spark, stages):
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == {r["doc_id"] for r in stages["packing"][1]}


def test_planted_cases(spark, tmp_path):
    """Copies, leaks and shared passages among clean documents are caught, clean ones stay."""
    passage, item = prose(70, 1), prose(40, 2)
    clean = {i: prose(150, 100 + i) for i in range(30)}
    near = list(clean[3])
    near[75] = "changed"
    docs = {**clean, 100: clean[5], 101: near, 102: [*prose(60, 300), *item, *prose(60, 301)], 103: [*prose(40, 302), *passage], 104: [*passage, *prose(40, 303)]}
    rows = [(d, " ".join(w), "en", "s", 0) for d, w in docs.items()] + [(200, None, None, None, None), (201, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*clean, 103, 104, 200, 201}
    assert (got[103], got[104]) == (110, 40)
