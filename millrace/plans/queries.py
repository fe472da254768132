"""Queries over whole tables, one for each operator, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import audit, consolidate, gates, graph, ingest, policy, retrieval
from ..streaming import limits
from .records import AT, CUE, DENY_SQL, EDGES_SQL, RECORDS_SQL, SHOWN_SQL, SUPPORT, VALID_SQL, edges, records, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def with_records(sql: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join([RECORDS_SQL, *more])} {sql}"


def at():
    return F.lit(AT).cast("timestamp")


# Scans

query("s2_tenant_scan", with_records("SELECT id, content_hash, confidence FROM r WHERE tenant = 'tenant:fr'"))(lambda s, d: records(s, d).where("tenant = 'tenant:fr'").select("id", "content_hash", "confidence"))
query("s3_metadata_scan", with_records("SELECT id, kind, epistemic, classification, subject, review_state, valid_from, valid_until, created_at, confidence, salience, indexed, policy_scope FROM r WHERE tenant = 'tenant:en'"))(
    lambda s, d: records(s, d).where("tenant = 'tenant:en'").select("id", "kind", "epistemic", "classification", "subject", "review_state", "valid_from", "valid_until", "created_at", "confidence", "salience", "indexed", "policy_scope")
)
query(
    "s4_row_view",
    with_records("SELECT id, CASE WHEN truth_status IS NOT NULL THEN truth_status WHEN epistemic = 'model-generated' THEN 'generated_supported' WHEN epistemic IN ('inferred-belief', 'hypothesis', 'simulated') THEN 'inferred' ELSE 'source_observed' END AS truth_status, coalesce(review_state, 'none') AS review_state, subject AS first_subject FROM r"),
)(lambda s, d: records(s, d).select("id", V.truth_status(F.col("truth_status"), F.col("epistemic")).alias("truth_status"), F.coalesce("review_state", F.lit("none")).alias("review_state"), F.get("subject_ids", F.lit(0)).alias("first_subject")))
query("s5_point_get", with_records("SELECT id, kind, content FROM r WHERE id = 'doc_00000042'"))(lambda s, d: records(s, d).where("id = 'doc_00000042'").select("id", "kind", "content"))
query("s6_embeddings_scan", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE len(embedding) > 0")(lambda s, d: table(s, d, "embeddings").where(F.size("embedding") > 0).select("vec_id", F.size("embedding").alias("dims")))
query("s7_by_source_path", with_records("SELECT id, path FROM r WHERE path = 'notes/src3/3.md' OR 'markdown://notes/src3/3' = replace('markdown://' || path, '.md', '')"))(lambda s, d: records(s, d).where((F.col("path") == "notes/src3/3.md") | (F.col("uri") == "markdown://notes/src3/3") | F.array_contains("source_ids", "markdown://notes/src3/3")).select("id", "path"))
query("s17_latest_by_path", with_records("SELECT path, arg_max(id, created_at) AS id, count(*) AS versions FROM r GROUP BY path"))(lambda s, d: ingest.latest_by(records(s, d), "path").select("path", "id", "versions"))


def _line_ranges(df):
    return df.select("id", T.line_range(F.col("content"), 2, 2).alias("lines"), F.left("content", F.lit(700)).alias("head"))


query("s18_line_ranges", with_records("SELECT id, array_to_string(string_split(content, chr(10))[2:3], chr(10)) AS lines, substr(content, 1, 700) AS head FROM r WHERE starts_with(path, 'notes/src1/')"))(
    lambda s, d: _line_ranges(records(s, d).where(F.startswith("path", F.lit("notes/src1/"))))
)
query("s18_line_ranges_all", with_records("SELECT id, array_to_string(string_split(content, chr(10))[2:3], chr(10)) AS lines, substr(content, 1, 700) AS head FROM r"))(lambda s, d: _line_ranges(records(s, d)))


@query(
    "s19_turn_pairs",
    "WITH t AS (SELECT conv_id, turn, role, trim(coalesce(text, '')) AS own, lead(role) OVER w AS next_role, lead(trim(coalesce(text, ''))) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
    "SELECT conv_id, turn, 'session:' || conv_id AS subject, trim('User: ' || own || chr(10) || 'Assistant: ' || CASE WHEN next_role = 'assistant' THEN reply ELSE '' END) AS content FROM t WHERE role = 'user' AND (own <> '' OR (next_role = 'assistant' AND reply <> ''))",
)
def turn_pairs(spark, sf_dir):
    return ingest.turn_records(table(spark, sf_dir, "conversations"))


# Filters and policy

_FILTERS = {
    "review": ({}, SHOWN_SQL),
    "review_hide": ({"hide_review_states": ["accepted"], "include_review_states": ["disputed"]}, "coalesce(review_state NOT IN ('rejected', 'superseded', 'accepted'), true)"),
    "kinds": ({"kinds": ["source", "semantic"]}, "kind IN ('source', 'semantic')"),
    "kinds_none": ({"kinds": []}, "false"),
    "types": ({"memory_types": ["episodic", "profile"]}, "kind IN ('episodic', 'profile')"),
    "epistemics": ({"epistemics": ["observed-fact"]}, "epistemic = 'observed-fact'"),
    "scopes": ({"policy_scopes": ["default"]}, "policy_scope = 'default'"),
    "auxiliary": ({}, "policy_scope <> 'contextual-aux'"),
    "classifications": ({"allowed_classifications": ["public", "internal"]}, "classification IN ('public', 'internal')"),
    "subjects": ({"denied_subjects": ["src:src2", "src:src5"]}, "subject NOT IN ('src:src2', 'src:src5')"),
    "valid": ({}, VALID_SQL),
    "subject": ({"subject": "src:src4"}, "subject = 'src:src4'"),
    "indexed": ({}, "indexed"),
}
for _id, (_name, (_given, _sql)) in zip(("f1", "f2", "f3", "f3", "f4", "f5", "f6", "f7", "f8", "f9", "f10", "f11", "f12"), _FILTERS.items(), strict=True):
    query(f"{_id}_filter_{_name}", with_records(f"SELECT id FROM r WHERE {_sql}"))(
        lambda s, d, name=_name.split("_")[0], given=_given: records(s, d).where(policy.predicates(given, at())[name]).select("id")
    )

_ALL = f"{SHOWN_SQL} AND policy_scope <> 'contextual-aux' AND {VALID_SQL} AND indexed"
query("f_matching", with_records(f"SELECT id FROM r WHERE {_ALL} AND kind <> 'working'"))(lambda s, d: policy.matching(records(s, d), {"kinds": ["source", "episodic", "semantic", "procedural", "profile", "generated"]}, at()).select("id"))
query("p_deny_reason", with_records(f"SELECT id, {DENY_SQL} AS reason FROM r"))(lambda s, d: records(s, d).select("id", policy.deny_reason(SUPPORT).alias("reason")))
query("p_visible", with_records(f"SELECT id FROM r WHERE {DENY_SQL} = 'ok'"))(lambda s, d: policy.visible(records(s, d), SUPPORT).select("id"))
query("a18_deny_counts", with_records(f"SELECT {DENY_SQL} AS reason, count(*) AS n FROM r GROUP BY 1"))(lambda s, d: records(s, d).groupBy(policy.deny_reason(SUPPORT).alias("reason")).agg(F.count("*").alias("n")))
query(
    "p6_inheritance",
    with_records(
        "SELECT id, ['public','internal','confidential','restricted'][max(class_rank) + 1] AS classification, bool_or(pii) AS pii, coalesce(string_agg(DISTINCT g, ',' ORDER BY g) FILTER (g <> ''), '') AS gates FROM (SELECT x.id, r.class_rank, r.pii, unnest(list_concat(roles, flatten(role_groups), [''])) AS g FROM (SELECT DISTINCT child AS id, parent AS p FROM e UNION SELECT child, child FROM e) x JOIN r ON r.id = x.p) GROUP BY id",
        EDGES_SQL,
    ),
)(lambda s, d: policy.inherited(records(s, d), edges(s, d)).select("id", "classification", "pii", F.array_join(F.array_sort(F.array_distinct(F.flatten("role_groups"))), ",").alias("gates")))
query("p7_write_guard", with_records("SELECT id, CASE WHEN doc_id % 29 = 0 THEN 'approved-canonical requires approval' WHEN doc_id % 31 = 0 AND indexed THEN 'contracts must be privileged and unindexed' END AS refusal FROM r"))(
    lambda s, d: (
        records(s, d)
        .withColumn("epistemic", F.when(F.col("doc_id") % 29 == 0, "approved-canonical").otherwise(F.col("epistemic")))
        .withColumn("kind", F.when(F.col("doc_id") % 31 == 0, "capability-contract").otherwise(F.col("kind")))
        .withColumn("policy_scope", F.when(F.col("doc_id") % 31 == 0, "continuity-privileged").otherwise(F.col("policy_scope")))
        .select("id", V.write_refusal().alias("refusal"))
    )
)
query("p8_validation", with_records("SELECT id, CASE WHEN doc_id % 10 = 3 THEN 'confidence,content_hash' WHEN doc_id % 10 = 7 THEN 'visibility' ELSE '' END AS errors FROM r"))(
    lambda s, d: (
        records(s, d)
        .withColumn("confidence", F.when(F.col("doc_id") % 10 == 3, 1.5).otherwise(F.col("confidence")))
        .withColumn("content_hash", F.when(F.col("doc_id") % 10 == 3, "sha256:0").otherwise(F.col("content_hash")))
        .withColumn("visibility", F.when(F.col("doc_id") % 10 == 7, "secret").otherwise(F.col("visibility")))
        .select("id", F.array_join(V.record_errors(), ",").alias("errors"))
    )
)
_MOVES = " OR ".join(f"(review_state = '{a}' AND target = '{b}')" for a, to in policy.TRANSITIONS.items() for b in to)
query(
    "t1_review_moves",
    with_records(f"SELECT id, target, CASE WHEN review_state IS NULL THEN 'not in the workflow' WHEN NOT ({_MOVES}) THEN 'illegal transition' END AS refusal FROM r CROSS JOIN (VALUES ('accepted'), ('rejected'), ('disputed'), ('superseded'), ('proposed')) v(target)"),
)(lambda s, d: records(s, d).select("id", "review_state", F.explode(F.array(*map(F.lit, policy.TRANSITIONS))).alias("target")).select("id", "target", policy.move_refusal(F.col("review_state"), F.col("target"), ["reviewer"]).alias("refusal")))

# Retrieval

_VISIBLE = f"v AS (SELECT * FROM r WHERE {DENY_SQL} = 'ok' AND {_ALL})"
_TOKENS = "tk AS (SELECT id, lower(unnest(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS t FROM v), dl AS (SELECT v.id, count(t) AS doclen FROM v LEFT JOIN tk ON v.id = tk.id GROUP BY v.id)"
_TERMS = ", ".join(f"('{t}')" for t in retrieval.query_tokens(CUE))
_BM25 = (
    f"q AS (SELECT * FROM (VALUES {_TERMS}) x(t)), tf AS (SELECT id, t, count(*) AS f FROM tk WHERE t IN (SELECT t FROM q) GROUP BY 1, 2), df AS (SELECT t, count(*) AS n FROM tf GROUP BY 1), st AS (SELECT count(*) AS n_docs, avg(doclen) AS avgdl FROM dl), "
    "b AS (SELECT dl.id, doclen, round(coalesce(sum(ln(1 + (n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) * (f * 2.5::DOUBLE) / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doclen / avgdl))), 0), 9) AS bm25 FROM dl LEFT JOIN tf ON tf.id = dl.id LEFT JOIN df ON df.t = tf.t CROSS JOIN st GROUP BY dl.id, doclen)"
)
_CUE_COUNTS = retrieval.hashed_counts(CUE)
_NORM = sum(n * n for n in _CUE_COUNTS.values()) ** 0.5
_DENSE = (
    "bk AS (SELECT id, CAST('0x' || substr(md5(t), 31, 2) AS INTEGER) AS b, count(*) AS c FROM tk GROUP BY 1, 2), "
    f"qb AS (SELECT * FROM (VALUES {', '.join(f'({b}, {n})' for b, n in sorted(_CUE_COUNTS.items()))}) x(b, n)), "
    f"dn AS (SELECT v.id, round(coalesce(sum(c * n) / (sqrt(sum(c * c)) * {_NORM!r}::DOUBLE), 0), 9) AS dense FROM v LEFT JOIN bk ON bk.id = v.id LEFT JOIN qb ON qb.b = bk.b GROUP BY v.id)"
)
_CANDS = "dt AS (SELECT id, dense FROM dn ORDER BY dense DESC, id LIMIT 50), lt AS (SELECT id FROM b ORDER BY bm25 DESC, id LIMIT 50), c AS (SELECT v.*, b.bm25, dt.dense FROM v JOIN b ON b.id = v.id LEFT JOIN dt ON dt.id = v.id WHERE v.id IN (SELECT id FROM dt UNION SELECT id FROM lt))"
_LEXICAL = "lt AS (SELECT id FROM b ORDER BY bm25 DESC, id LIMIT 50), c AS (SELECT v.*, b.bm25 FROM v JOIN b ON b.id = v.id WHERE v.id IN (SELECT id FROM lt))"
_FUSED = (
    "rk AS (SELECT *, row_number() OVER (ORDER BY dense DESC NULLS LAST, id) AS dr, row_number() OVER (ORDER BY bm25 DESC, id) AS lr FROM c), "
    "fu AS (SELECT *, round(CASE WHEN dr <= 50 THEN 1.0::DOUBLE / (dr + 60) ELSE 0 END + CASE WHEN lr <= 50 THEN 1.0::DOUBLE / (lr + 60) ELSE 0 END, 12) AS rrf FROM rk), "
    "top AS (SELECT * FROM fu WHERE rrf > 0 ORDER BY rrf DESC, id LIMIT 50), "
    f"ce AS (SELECT *, (SELECT round(CAST(len(list_intersect(dt, qt)) AS DOUBLE) / greatest(len(list_distinct(list_concat(dt, qt))), 1), 9) FROM (SELECT list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS dt, [{', '.join(repr(t) for t in retrieval.query_tokens(CUE))}] AS qt)) AS rerank FROM top)"
)


def _collapse_sql(source: str, score: str, k: int) -> str:
    order = f"{score} DESC, mirror_rank, id"
    return f"ps AS (SELECT *, row_number() OVER (ORDER BY {order}) AS pos, row_number() OVER (PARTITION BY mirror_key ORDER BY {order}) AS nth FROM {source}), kp AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS rank FROM ps WHERE nth = 1 QUALIFY row_number() OVER (ORDER BY pos) <= {k}), ls AS (SELECT mirror_key AS mk, string_agg(id, ',' ORDER BY id) AS lost FROM ps WHERE nth > 1 AND pos < (SELECT max(pos) FROM kp) GROUP BY 1)"


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.matching(policy.visible(records(spark, sf_dir), SUPPORT), {}, at())


query("r1_tokens", with_records("SELECT id, CAST(len(regexp_extract_all(lower(content), '[a-z0-9]+')) AS INTEGER) AS n, CAST(len(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS INTEGER) AS n_distinct FROM r"))(
    lambda s, d: records(s, d).withColumn("t", T.tokens(F.col("content"))).select("id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))
)
query("r2_hashed_embedding", with_records("SELECT id, dense FROM dn", _VISIBLE, _TOKENS, _DENSE))(lambda s, d: visible(s, d).select("id", F.round(retrieval.hashed_similarity(CUE)(F.col("content")), 9).alias("dense")))
_DOT = "list_sum([CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE) FOR p IN list_zip(a.embedding, b.embedding)])"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


query("r3_dense_top_n", f"SELECT a.vec_id, round({_DOT}, 9) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, a.vec_id LIMIT 20")(lambda s, d: retrieval.nearest(table(s, d, "embeddings"), _first_vector(s, d), 20).select("vec_id", "score"))
query(
    "r4_dense_l2", "SELECT a.vec_id, round(-sqrt(list_sum([(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) FOR p IN list_zip(a.embedding, b.embedding)])), 9) + 0.0 AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, a.vec_id LIMIT 20"
)(lambda s, d: retrieval.nearest(table(s, d, "embeddings"), _first_vector(s, d), 20, "l2").select("vec_id", "score"))
query("r7_bm25", with_records("SELECT id, doclen, round(bm25, 6) AS bm25 FROM b", _VISIBLE, _TOKENS, _BM25))(lambda s, d: retrieval.bm25(visible(s, d), CUE).select("id", F.col("doclen").cast("long").alias("doclen"), F.round("bm25", 6).alias("bm25")))
query("r8_candidates", with_records("SELECT id, round(bm25, 6) AS bm25, round(dense, 6) AS dense FROM c", _VISIBLE, _TOKENS, _BM25, _DENSE, _CANDS))(lambda s, d: retrieval.candidates(visible(s, d), CUE).select("id", F.round("bm25", 6).alias("bm25"), F.round("dense", 6).alias("dense")))
query("r9_rank_fusion", with_records("SELECT id, rrf FROM top", _VISIBLE, _TOKENS, _BM25, _DENSE, _CANDS, _FUSED))(lambda s, d: retrieval.fused(retrieval.candidates(visible(s, d), CUE)).select("id", "rrf"))
def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(*map(F.lit, retrieval.query_tokens(CUE)))
    return retrieval.fused(retrieval.candidates(visible(spark, sf_dir), CUE)).select("id", F.round(T.jaccard(asked, F.array_distinct(T.tokens(F.col("content")))), 9).alias("rerank"))


query("r11_lexical_rerank", with_records("SELECT id, rerank FROM ce", _VISIBLE, _TOKENS, _BM25, _DENSE, _CANDS, _FUSED))(_reranked)
query("r13_clip", with_records("SELECT id, CASE WHEN length(content) <= 200 THEN content ELSE substr(content, 1, 97) || chr(10) || '...' || chr(10) || right(content, 98) END AS clipped FROM r"))(lambda s, d: records(s, d).select("id", T.clip(F.col("content"), 200).alias("clipped")))
query("r18_lexical_recall", with_records("SELECT rank, id, round(bm25, 6) AS score, coalesce(lost, '') AS collapsed FROM kp LEFT JOIN ls ON mk = mirror_key", _VISIBLE, _TOKENS, _BM25, _LEXICAL, _collapse_sql("c", "bm25", 8)))(
    lambda s, d: retrieval.recall(visible(s, d), CUE, method="lexical").select(F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"), F.array_join("collapsed_ids", ",").alias("collapsed"))
)
query("r15_hybrid_recall", with_records("SELECT rank, id, rerank AS score, rrf, coalesce(lost, '') AS collapsed FROM kp LEFT JOIN ls ON mk = mirror_key", _VISIBLE, _TOKENS, _BM25, _DENSE, _CANDS, _FUSED, _collapse_sql("ce", "rerank", 8)))(
    lambda s, d: retrieval.recall(visible(s, d), CUE).select(F.col("rank").cast("long").alias("rank"), "id", "score", "rrf", F.array_join("collapsed_ids", ",").alias("collapsed"))
)
_TRUTH = "CASE WHEN truth_status = 'generated_needs_review' THEN 0.4::DOUBLE WHEN epistemic = 'model-generated' THEN 0.92::DOUBLE WHEN epistemic IN ('inferred-belief', 'hypothesis', 'simulated') THEN 0.52::DOUBLE ELSE 1.0::DOUBLE END"
_TYPE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in V.TYPE_WEIGHTS["procedure"].items()) + " ELSE 1.0::DOUBLE END"
_AGE = "0.035::DOUBLE * (1 / (1 + greatest((epoch(TIMESTAMP '2024-04-01') - created_at) / 86400.0::DOUBLE, 0.0::DOUBLE) / 30.0::DOUBLE))"
_TYPED = f"{{base}} * {_TYPE} * {_TRUTH} * CASE WHEN confidence = 0 THEN 1.0::DOUBLE ELSE confidence END + 0.06::DOUBLE * CAST(list_contains(entities, 'src1') AS INTEGER) / 2 + 0.06::DOUBLE * CAST(list_contains(entities, 'en') AS INTEGER) / 2 + CASE WHEN has_spans THEN 0.035::DOUBLE ELSE 0 END + {_AGE}"
query("r16_mirror_family", with_records("SELECT id, mirror_key AS key, CAST(mirror_rank AS INTEGER) AS rank FROM r"))(lambda s, d: records(s, d).withColumn("m", V.mirror_family(F.col("source_ids"))).select("id", "m.key", "m.rank"))
query("r19_typed_scores", with_records(f"SELECT id, round({_TYPED.format(base='1.0::DOUBLE')}, 6) AS score FROM r"))(lambda s, d: records(s, d).select("id", F.round(V.typed_score(F.lit(1.0), intent="procedure", entities=["src1", "en"], at=at()), 6).alias("score")))
query(
    "r19_typed_recall",
    with_records("SELECT row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, id, score FROM (SELECT id, round(" + _TYPED.format(base="rerank") + ", 9) AS score FROM kp) ORDER BY score DESC, id LIMIT 8", _VISIBLE, _TOKENS, _BM25, _DENSE, _CANDS, _FUSED, _collapse_sql("ce", "rerank", 50)),
)(lambda s, d: retrieval.recall(visible(s, d), CUE, method="typed", intent="procedure", entities=["src1", "en"], at=at()).select(F.col("rank").cast("long").alias("rank"), "id", "score"))
query("r27_paths_among", with_records("SELECT e.child, e.parent, e.kind FROM e WHERE child IN (SELECT id FROM v) AND parent IN (SELECT id FROM v) ORDER BY kind, child, parent LIMIT 100", _VISIBLE, EDGES_SQL))(
    lambda s, d: edges(s, d).join(visible(s, d).select(F.col("id").alias("child")), "child", "left_semi").join(visible(s, d).select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent", "kind").orderBy("kind", "child", "parent").limit(100)
)
query("r29_index_lag", with_records("SELECT tenant, count(*) FILTER (NOT indexed) AS lag FROM r GROUP BY tenant"))(lambda s, d: records(s, d).groupBy("tenant").agg(F.count_if(~F.col("indexed")).alias("lag")))

# Aggregates

query("a1_count_by_tenant", with_records("SELECT tenant, count(*) AS n FROM r GROUP BY tenant"))(lambda s, d: records(s, d).groupBy("tenant").agg(F.count("*").alias("n")))
query("a2_count_all", "SELECT count(*) AS n FROM documents")(lambda s, d: table(s, d, "documents").agg(F.count("*").alias("n")))
query("a3_dims", "SELECT DISTINCT CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")(lambda s, d: table(s, d, "embeddings").select(F.size("embedding").alias("dims")).distinct())
query("a4_last_created", with_records("SELECT max(created_at) AS created_at FROM r WHERE kind = 'source'"))(lambda s, d: records(s, d).where("kind = 'source'").agg(F.max("created_at").alias("created_at")))
query("a5_percentile", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")(lambda s, d: limits.nearest_rank("value", 95, ["event_type"], table(s, d, "events")))
query("a6_recent_metrics", "SELECT event_type, quantile_disc(value, 0.5) AS p50, max(value) AS most, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 2000 GROUP BY event_type")(
    lambda s, d: (
        table(s, d, "events").withColumn("k", F.expr("row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC)")).where("k <= 2000").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.max("value").alias("most"), F.count("*").alias("n"))
    )
)
query("a13_ingestion_lag", "SELECT d.source, count(*) AS pending, min(d.doc_id) AS oldest FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY d.source")(lambda s, d: table(s, d, "documents").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("pending"), F.min("doc_id").alias("oldest")))
query("a16_review_queue", with_records("SELECT id, created_at FROM r WHERE review_state = 'disputed'"))(lambda s, d: records(s, d).where(F.col("review_state").eqNullSafe("disputed")).orderBy("created_at", "id").select("id", "created_at"))

# Audit chains: one for each user of `events`


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    body = audit.body(action=F.col("event_type"), principal=F.col("user_id"), target=F.col("event_id"), tenant=F.lit("tenant:en"))
    return audit.chained(e.select(F.col("user_id").alias("chain_id"), (F.col("event_id") + 1).alias("seq"), "ts", body.alias("body")))


_CHAIN = """o AS (SELECT user_id AS chain_id, event_id + 1 AS seq, epoch_us(ts) AS us, '{"action":"' || event_type || '","principal":"' || user_id || '","target":"' || event_id || '","tenant":"tenant:en"}' AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
ch AS (SELECT chain_id, seq, n, us, body, 'genesis' AS prev_hash, sha256('genesis' || body || us) AS row_hash FROM o WHERE n = 1
    UNION ALL SELECT o.chain_id, o.seq, o.n, o.us, o.body, ch.row_hash, sha256(ch.row_hash || o.body || o.us) FROM ch JOIN o ON o.chain_id = ch.chain_id AND o.n = ch.n + 1)"""
query("c1_chain", f"WITH RECURSIVE {_CHAIN} SELECT chain_id, seq, prev_hash, row_hash FROM ch")(lambda s, d: _chain(s, d).select("chain_id", "seq", "prev_hash", "row_hash"))
_BROKEN = "bk AS (SELECT chain_id, seq, us, CASE WHEN chain_id % 10 = 0 AND n = 3 THEN body || ' ' ELSE body END AS body, prev_hash, row_hash FROM ch WHERE NOT (chain_id % 7 = 0 AND n = 4))"
_CHECKED = "ck AS (SELECT *, CASE WHEN prev_hash <> coalesce(lag(row_hash) OVER (PARTITION BY chain_id ORDER BY seq), 'genesis') THEN 'link' WHEN row_hash <> sha256(prev_hash || body || us) THEN 'hash' END AS failure FROM bk)"


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third row of some chains is edited, the fourth of others is missing."""
    c = _chain(spark, sf_dir).withColumn("n", F.expr("row_number() OVER (PARTITION BY chain_id ORDER BY seq)"))
    c = c.where(~((F.col("chain_id") % 7 == 0) & (F.col("n") == 4)))
    return c.withColumn("body", F.when((F.col("chain_id") % 10 == 0) & (F.col("n") == 3), F.concat("body", F.lit(" "))).otherwise(F.col("body"))).drop("n")


query("c3_verify", f"WITH RECURSIVE {_CHAIN}, {_BROKEN}, {_CHECKED} SELECT chain_id, count(*) AS n_rows, bool_and(failure IS NULL) AS ok, min(seq) FILTER (failure IS NOT NULL) AS first_bad_seq, max(seq) AS head_seq, arg_max(row_hash, seq) AS head_hash FROM ck GROUP BY chain_id")(lambda s, d: audit.chain_status(_broken(s, d)))
query("c5_rows_for_target", "SELECT event_id + 1 AS seq, user_id AS chain_id FROM events WHERE event_id = 77")(lambda s, d: _chain(s, d).where(F.get_json_object("body", "$.target") == "77").select("seq", "chain_id"))
query("c7_cadence", "SELECT user_id AS chain_id, count(*) >= 50 OR epoch(max(ts) - min(ts)) >= 86400 * 25 AS due FROM events GROUP BY user_id")(
    lambda s, d: table(s, d, "events").groupBy(F.col("user_id").alias("chain_id")).agg(audit.cadence_due(F.count("*"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6, 50, 86400.0 * 25).alias("due"))
)
_ANCHORS = "an AS (SELECT chain_id, seq, row_hash, n FROM ch WHERE n % 20 = 0)"


@query(
    "c8_against_anchors",
    f"WITH RECURSIVE {_CHAIN}, {_BROKEN}, {_CHECKED}, {_ANCHORS}, la AS (SELECT chain_id, count(*) AS n_anchors, max(seq) AS s FROM an GROUP BY 1), "
    "st AS (SELECT ck.chain_id, count(*) AS n_rows, bool_and(failure IS NULL) AS ok, count(*) FILTER (seq > s) AS since, any_value(n_anchors) AS n_anchors FROM ck LEFT JOIN la ON la.chain_id = ck.chain_id GROUP BY 1) "
    "SELECT chain_id, n_rows, ok, coalesce(n_anchors, 0) AS n_anchors, CASE WHEN n_anchors IS NULL THEN n_rows ELSE since END AS rows_since, CASE WHEN n_anchors IS NULL THEN 'no_anchors' WHEN NOT ok THEN 'chain_invalid' WHEN since >= 10 THEN 'stale' END AS first_failure FROM st",
)
def against_anchors(spark, sf_dir):
    anchors = audit.anchors_of(_chain(spark, sf_dir), 20)
    return audit.against_anchors(_broken(spark, sf_dir), anchors, F.lit("2024-01-01").cast("timestamp"), 10)


query("c12_bundle", f"WITH RECURSIVE {_CHAIN}, {_ANCHORS}, la AS (SELECT chain_id, max(seq) AS s FROM an GROUP BY 1) SELECT ch.chain_id, count(*) FILTER (seq <= s) AS rows, count(*) FILTER (seq > s) AS excluded_rows, any_value(s) AS last_seq FROM ch JOIN la ON la.chain_id = ch.chain_id GROUP BY 1")(
    lambda s, d: audit.bundle(_chain(s, d), audit.anchors_of(_chain(s, d), 20))[1]
)

# Graph and deletion

_BELOW = "cl AS (SELECT child AS id FROM e WHERE parent = 'doc_00000003' UNION SELECT e.child FROM cl JOIN e ON e.parent = cl.id)"


def _third(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("doc_00000003").alias("id"))


query("g1_descendants", f"WITH RECURSIVE {EDGES_SQL}, {_BELOW} SELECT id FROM cl WHERE id <> 'doc_00000003'")(lambda s, d: graph.descendants(edges(s, d), _third(s)).select("id"))
query("g2_parents", f"WITH {EDGES_SQL} SELECT parent FROM e WHERE child = 'doc_00000077'")(lambda s, d: edges(s, d).where("child = 'doc_00000077'").select("parent"))
query("g3_ancestors", f"WITH RECURSIVE {EDGES_SQL}, up AS (SELECT parent AS id, 1 AS depth FROM e WHERE child = 'doc_00000100' UNION SELECT e.parent, depth + 1 FROM up JOIN e ON e.child = up.id WHERE depth < 16) SELECT id, min(depth) AS depth FROM up GROUP BY id")(
    lambda s, d: graph.ancestors(edges(s, d), s.range(1).select(F.lit("doc_00000100").alias("id"))).select("id", F.col("depth"))
)


@query("g7_edge_insert", f"WITH {EDGES_SQL} SELECT child, parent, kind, false AS inserted FROM e UNION ALL SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0'), 'doc_' || lpad(CAST(doc_id // 3 AS VARCHAR), 8, '0'), 'wikilink', true FROM documents WHERE doc_id > 3")
def edge_insert(spark, sf_dir):
    """Every record links to that of a third of its number, and again to that of half, which is known."""
    ids = table(spark, sf_dir, "documents").select("doc_id").where("doc_id > 3")
    name = lambda n: F.concat(F.lit("doc_"), F.lpad(F.floor(n).cast("string"), 8, "0"))
    new = ids.select(name(F.col("doc_id")).alias("child"), F.explode(F.array(name(F.col("doc_id") / 3), name(F.col("doc_id") / 2))).alias("parent"), F.lit("wikilink").alias("kind"), F.col("doc_id").alias("ordinal"))
    return graph.add_edges(edges(spark, sf_dir), new)


@query("d15_forget", with_records("SELECT id, 'subject' AS why FROM r WHERE subject = 'src:src7' AND tenant = 'tenant:en' UNION ALL SELECT id, 'derived' FROM cl WHERE id NOT IN (SELECT id FROM r WHERE subject = 'src:src7' AND tenant = 'tenant:en')", EDGES_SQL, "cl AS (SELECT child AS id FROM e WHERE parent IN (SELECT id FROM r WHERE subject = 'src:src7' AND tenant = 'tenant:en') UNION SELECT e.child FROM cl JOIN e ON e.parent = cl.id)", recursive=True))
def forget(spark, sf_dir):
    r = records(spark, sf_dir)
    lineage = r.select(F.col("id").alias("artifact_id"), F.lit("memory").alias("artifact_kind"), "subject", "tenant")
    return graph.erased(r, edges(spark, sf_dir), lineage, "src:src7", "tenant:en")


@query("d4_delete", with_records("SELECT (SELECT count(*) FROM r WHERE doc_id % 10 <> 4) AS records, (SELECT count(*) FROM e WHERE child NOT IN (SELECT id FROM g) AND parent NOT IN (SELECT id FROM g)) AS edges, 2 * (SELECT count(*) FROM r WHERE doc_id % 10 <> 4) AS lineage", EDGES_SQL, "g AS (SELECT id FROM r WHERE doc_id % 10 = 4)"))
def delete(spark, sf_dir):
    r = records(spark, sf_dir)
    lineage = r.select(F.explode(F.array("id", F.concat(F.lit("emb:"), F.col("id")))).alias("artifact_id"), "subject", "tenant")
    left = graph.without(r, edges(spark, sf_dir), lineage, r.where("doc_id % 10 = 4"))
    counts = [t.agg(F.count("*").alias(n)) for t, n in zip(left, ("records", "edges", "lineage"), strict=True)]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


query("d7_set_review_state", with_records("SELECT id, CASE WHEN review_state IS NULL THEN 'proposed' ELSE review_state END AS review_state, review_state IS NULL AS changed FROM r"))(
    lambda s, d: policy.set_where(records(s, d), "review_state", F.lit(None).cast("string"), F.lit("proposed"), F.lit(True)).select("id", "review_state", "changed")
)
query("d8_set_indexed", with_records("SELECT id, true AS indexed, NOT indexed AS changed FROM r"))(lambda s, d: policy.set_where(records(s, d), "indexed", F.lit(False), F.lit(True), F.lit(True)).select("id", "indexed", "changed"))
query("d9_set_valid_until", with_records("SELECT id, CASE WHEN valid_until = '2024-06-05' AND kind = 'source' THEN '2024-05-01' ELSE valid_until END AS valid_until, coalesce(valid_until = '2024-06-05' AND kind = 'source', false) AS changed FROM r"))(
    lambda s, d: policy.set_where(records(s, d), "valid_until", F.lit("2024-06-05"), F.lit("2024-05-01"), F.col("kind") == "source").select("id", "valid_until", "changed")
)
query("d11_approve", with_records("SELECT id, CASE WHEN kind = 'semantic' AND coalesce(review_state = 'accepted', true) THEN 'approved-canonical' ELSE epistemic END AS epistemic, kind = 'semantic' AND coalesce(review_state = 'accepted', true) AS changed FROM r"))(
    lambda s, d: policy.approved(records(s, d), F.col("kind") == "semantic", ["approver"]).select("id", "epistemic", "changed")
)


@query("d17_import_plan", with_records("SELECT coalesce(o.tenant, n.tenant) AS tenant, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN 'purge' WHEN o.content_hash = n.content_hash THEN 'skip' ELSE 'update' END AS action FROM o FULL JOIN n ON o.tenant = n.tenant AND o.path = n.path", "o AS (SELECT tenant, id || '.md' AS path, content_hash FROM r WHERE doc_id % 5 <> 0)", "n AS (SELECT tenant, id || '.md' AS path, CASE WHEN doc_id % 4 = 0 THEN 'sha256:new' ELSE content_hash END AS content_hash FROM r WHERE doc_id % 7 <> 0)"))
def import_plan(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("path", F.concat("id", F.lit(".md")))
    new = r.where("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 4 == 0, "sha256:new").otherwise(F.col("content_hash")))
    return ingest.import_plan(r.where("doc_id % 5 <> 0"), new).select("tenant", "path", "action")


@query("d2_bulk_report", "SELECT CASE WHEN event_type = 'click' THEN 'tenant:a' ELSE 'tenant:default' END AS tenant, count(*) FILTER (event_id % 10 <> 3) AS taken, count(*) FILTER (event_id % 10 = 3) AS refused, count(*) FILTER (event_id % 10 <> 3 AND event_id % 2 = 0) AS with_source FROM events GROUP BY 1")
def bulk(spark, sf_dir):
    """Events as bulk records under aliases; some lack their content."""
    e = table(spark, sf_dir, "events")
    pairs = {"tenant_id": F.when(F.col("event_type") == "click", "a"), "body": F.when(F.col("event_id") % 10 != 3, F.col("props")), "subject_id": F.col("user_id").cast("string"), "uri": F.when(F.col("event_id") % 2 == 0, "x://y"), "pii": F.lit("yes")}
    return ingest.bulk_report(ingest.bulk_records(e.select(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))).alias("fields"))))


@query("d18_span_split", with_records("SELECT id, 'self' AS ref_0, 'payload' AS ref_1, 0 AS index_1, content AS text_0, 'src:' || source AS text_1 FROM r WHERE content <> 'src:' || source"))
def spans(spark, sf_dir):
    span = lambda n, t: F.struct(F.lit(n).alias("span_id"), t.alias("text"))
    out = ingest.split_spans(records(spark, sf_dir).withColumn("spans", F.array(span("a", F.col("content")), span("b", F.col("subject")))))
    at_ = lambda i: F.get("spans", F.lit(i))
    return out.select("id", at_(0)["text_ref"].alias("ref_0"), at_(1)["text_ref"].alias("ref_1"), at_(1)["text_index"].alias("index_1"), ingest.span_text(at_(0), F.col("content"), F.col("payload")).alias("text_0"), ingest.span_text(at_(1), F.col("content"), F.col("payload")).alias("text_1"))


# Text gates

_EMAIL, _PHONE, _SSN, _CUSTOMER, _CARD = T.PII.values()
_REDACTED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '{_EMAIL}', '[REDACTED_EMAIL]', 'g'), '{_PHONE}', '[REDACTED_PHONE]', 'g'), '{_SSN}', '[REDACTED_SSN]', 'g'), '{_CUSTOMER}', '[REDACTED_CUSTOMER_ID]', 'g'), '{_CARD}', '[REDACTED_CREDIT_CARD]', 'g')"
_LABELS = f"CASE WHEN regexp_matches({{x}}, '{_CARD}') THEN 'credit_card,' ELSE '' END || CASE WHEN regexp_matches({{x}}, '{_EMAIL}') THEN 'email,' ELSE '' END || CASE WHEN regexp_matches({{x}}, '{_PHONE}') THEN 'phone,' ELSE '' END || CASE WHEN regexp_matches({{x}}, '{_SSN}') THEN 'ssn,' ELSE '' END"
query("x1_content_hash", with_records("SELECT id, content_hash FROM r"))(lambda s, d: records(s, d).select("id", T.content_hash(F.col("content")).alias("content_hash")))
query("x2_tenant_names", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'tenant:default' WHEN doc_id % 3 = 1 THEN 'tenant:' || lang ELSE 'org:' || lang || ':x' END AS name, CASE WHEN doc_id % 3 = 0 THEN 'default' WHEN doc_id % 3 = 1 THEN lang ELSE lang || ':x' END AS slug FROM documents")(
    lambda s, d: (
        table(s, d, "documents").withColumn("raw", F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "lang")).otherwise(F.concat(F.lit("org:"), "lang", F.lit(":x")))).select("doc_id", V.tenant_name(F.col("raw")).alias("name"), V.tenant_slug(F.col("raw")).alias("slug"))
    )
)
query("x7_slug", with_records("SELECT id, substr(CASE WHEN trim(regexp_replace(lower(content), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'memory' ELSE trim(regexp_replace(lower(content), '[^a-z0-9]+', '_', 'g'), '_') END, 1, 36) AS slug FROM r"))(
    lambda s, d: records(s, d).select("id", T.slug(F.col("content")).alias("slug"))
)
query("x9_secrets", with_records("SELECT id, doc_id % 2 = 0 AS secret FROM r"))(
    lambda s, d: records(s, d).select("id", T.shows_secret(F.concat("content", F.lit(" " * 30 + "key AK" + "IA" + "Q" * 16), F.when(F.col("doc_id") % 2 == 0, " ").otherwise(" placeholder"))).alias("secret"))
)
query("x18_redaction", with_records(f"SELECT id, {_REDACTED} AS redacted, rtrim({_LABELS.replace('{x}', 'content')}, ',') AS labels FROM r"))(lambda s, d: records(s, d).select("id", T.redact(F.col("content")).alias("redacted"), F.array_join(T.detected_pii(F.col("content")), ",").alias("labels")))
query("x24_numbered_lines", with_records("SELECT id, array_to_string([lpad(CAST(i AS VARCHAR), 6, ' ') || chr(9) || string_split(content, chr(10))[i] FOR i IN range(1, len(string_split(content, chr(10))) + 1)], chr(10)) AS numbered FROM r"))(lambda s, d: records(s, d).select("id", T.numbered_lines(F.col("content")).alias("numbered")))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document answers for one of the benchmark passages, altered in one of four ways."""
    claims = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    n = claims.agg(F.count("*").alias("items"))  # one row
    d = F.col("doc_id")
    rows = records(spark, sf_dir).select("id", d, F.col("content").alias("own")).crossJoin(F.broadcast(n)).withColumn("item_id", d % F.col("items")).join(claims, "item_id")
    start = F.concat("passage", F.lit(" order 7"))
    claim = F.when(d % 4 == 0, F.concat(start, F.lit(" approved"))).when(d % 4 == 1, F.col("passage")).otherwise(start)
    support = F.when(d % 4 == 0, F.concat(start, F.lit(" denied"))).when(d % 4 == 1, F.concat("passage", F.when(d % 8 == 1, " may be").otherwise(""))).when(d % 4 == 2, F.col("passage")).otherwise(F.when(d % 8 == 3, "").otherwise(F.concat(F.col("own"), F.lit(" order 7"))))
    return rows.select("id", F.col("item_id").alias("candidate_id"), (d % 5 != 0).alias("material"), (d % 16 != 15).alias("cited"), claim.alias("claim"), support.alias("support"))


_FLAT = "replace(trim(regexp_replace(replace(lower({x}), '_', ' '), '\\s+', ' ', 'g')), '-', ' ')"
_SETS = "[t FOR t IN list_distinct(regexp_extract_all(trim(regexp_replace(replace(lower({x}), '_', ' '), '\\s+', ' ', 'g')), '[a-z0-9]+')) IF length(t) > 2 AND t NOT IN ('a', 'an', 'and', 'are', 'because', 'by', 'for', 'has', 'is', 'of', 'on', 'the', 'to', 'was', 'with')]"
_CLAIMS_SQL = (
    "cm AS (SELECT r.id, b.item_id AS candidate_id, r.doc_id % 5 <> 0 AS material, r.doc_id % 16 <> 15 AS cited, b.text || CASE r.doc_id % 4 WHEN 0 THEN ' order 7 approved' WHEN 1 THEN '' ELSE ' order 7' END AS claim, "
    "CASE r.doc_id % 4 WHEN 0 THEN b.text || ' order 7 denied' WHEN 1 THEN b.text || CASE WHEN r.doc_id % 8 = 1 THEN ' may be' ELSE '' END WHEN 2 THEN b.text ELSE CASE WHEN r.doc_id % 8 = 3 THEN '' ELSE r.content || ' order 7' END END AS support, r.doc_id % 4 AS way FROM r JOIN benchmark b ON b.item_id = r.doc_id % (SELECT count(*) FROM benchmark)), "
    f"sc AS (SELECT *, {_SETS.replace('{x}', 'claim')} AS ct, {_SETS.replace('{x}', 'support')} AS stt, {_FLAT.replace('{x}', 'support')} AS sf FROM cm), "
    "lb AS (SELECT *, CASE WHEN len(ct) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect(ct, stt)) AS DOUBLE) / len(ct) END AS score FROM sc), "
    "ev AS (SELECT *, CASE WHEN NOT cited OR support = '' THEN 'not_checkable' WHEN way = 0 THEN 'contradicted' WHEN way = 2 AND NOT contains(sf, 'order 7') THEN 'unsupported' "
    "WHEN regexp_matches(sf, 'might|may|possible|suspected|not confirmed|unconfirmed') AND NOT regexp_matches(" + _FLAT.replace('{x}', "claim") + ", 'might|may|possible|possibly|suspected') THEN 'partially_supported' WHEN score >= 0.72 THEN 'supported' WHEN score >= 0.45 THEN 'partially_supported' ELSE 'unsupported' END AS label FROM lb)"
)
query("x16_claim_labels", with_records("SELECT id, round(score, 9) AS support_score, label FROM ev", _CLAIMS_SQL))(lambda s, d: gates.check_claims(_claims(s, d)).select("id", F.round("support_score", 9).alias("support_score"), "label"))
query(
    "x17_decisions",
    with_records(
        "SELECT candidate_id, CASE WHEN bool_or(material AND label IN ('contradicted', 'unsupported')) THEN 'rejected' WHEN bool_or(material AND label IN ('partially_supported', 'not_checkable')) THEN 'needs_human_review' ELSE 'accepted' END AS decision, count(*) AS claim_count, "
        + ", ".join(f"count(*) FILTER (label = '{x}') AS claims_{x}" for x in gates.CLAIM_LABELS)
        + " FROM ev GROUP BY candidate_id",
        _CLAIMS_SQL,
    ),
)(lambda s, d: gates.decide(gates.check_claims(_claims(s, d))))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each record; its number chooses the rule that decides it."""
    d = F.col("doc_id")
    r = records(spark, sf_dir)
    lst = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    model = F.struct(
        F.when(d % 20 == 0, "local").otherwise("api").alias("runtime"), F.when(d % 20 == 4, "other").otherwise("acme").alias("provider"), F.when(d % 20 == 5, "cn").otherwise("us").alias("region"), F.when(d % 20 == 6, "30d").otherwise("zero").alias("retention"), (d % 20 != 7).alias("training_opt_out"),
        F.lit(None).cast("string").alias("endpoint"), F.when(d % 20 == 2, "p9").otherwise("p1").alias("provider_policy_id"),
    )
    rules = F.struct(
        (d % 20 != 1).alias("allow_external_models"), lst("acme").alias("allowed_providers"), lst("us").alias("allowed_regions"), F.lit(True).alias("require_zero_retention"), (d % 20 != 12).alias("allow_redaction"), lst("email", "phone", "credit_card").alias("redactable_pii_labels"),
        lst("ssn").alias("deny_pii_labels"), F.when(d % 20 == 10, lst("public", "internal", "confidential")).otherwise(lst()).alias("deny_classifications"), lst("confidential").alias("human_review_classifications"),
    )
    entry = F.struct(F.lit("p1").alias("provider_policy_id"), model["provider"].alias("provider"), model["runtime"].alias("runtime"), model["region"].alias("region"), model["retention"].alias("retention"), model["training_opt_out"].alias("training_opt_out"), F.lit(None).cast("string").alias("endpoint"), F.when(d % 20 == 3, "pending").otherwise("approved").alias("status"), lst("public", "internal", "confidential").alias("allowed_classifications"), F.when(d % 20 == 9, lst("email")).otherwise(lst()).alias("denied_pii_labels"))
    labels = F.when(d % 20 == 11, lst("ssn")).when(d % 20 == 9, lst("email")).when(d % 20 >= 12, T.detected_pii(F.col("content"))).otherwise(lst())
    span = F.struct(F.col("id").alias("span_id"), F.col("classification").alias("classification"), labels.alias("pii_labels"), F.col("content").alias("text"))
    return r.select("id", model.alias("model"), rules.alias("policy"), F.array(entry).alias("providers"), F.array(span).alias("spans"))


_DECIDED = (
    f"rq AS (SELECT id, doc_id % 20 AS n, classification, content, CASE WHEN doc_id % 20 = 11 THEN 'ssn,' WHEN doc_id % 20 = 9 THEN 'email,' WHEN doc_id % 20 >= 12 THEN {_LABELS.replace('{x}', 'content')} ELSE '' END AS labels FROM r), "
    f"rd AS (SELECT *, {_REDACTED} AS all_red, CASE WHEN n = 0 OR n = 1 THEN 'local_model_only' WHEN n IN (2, 3, 4, 5, 6, 7) OR classification = 'restricted' OR n IN (9, 10, 11) THEN 'denied' WHEN classification = 'confidential' THEN 'human_approval_required' WHEN labels = '' THEN 'external_model_allowed' WHEN n = 12 OR contains(labels, 'ssn') THEN 'human_approval_required' ELSE 'redact' END AS d FROM rq)"
)
_PART_RED = "CASE WHEN contains(labels, 'credit_card') THEN regexp_replace({x}, '" + _CARD + "', '[REDACTED_CREDIT_CARD]', 'g') ELSE {x} END"
_STEP1 = f"CASE WHEN contains(labels, 'email') THEN regexp_replace(content, '{_EMAIL}', '[REDACTED_EMAIL]', 'g') ELSE content END"
_STEPS = f"s1 AS (SELECT *, {_STEP1} AS c1 FROM rd), s2 AS (SELECT *, CASE WHEN contains(labels, 'phone') THEN regexp_replace(c1, '{_PHONE}', '[REDACTED_PHONE]', 'g') ELSE c1 END AS c2 FROM s1), s3 AS (SELECT *, {_PART_RED.replace('{x}', 'c2')} AS c3 FROM s2), fin AS (SELECT id, CASE WHEN d <> 'redact' THEN d WHEN {_LABELS.replace('{x}', 'c3')} <> '' THEN 'denied' ELSE 'external_model_allowed_with_redaction' END AS decision, CASE WHEN d = 'external_model_allowed' THEN content WHEN d = 'redact' AND {_LABELS.replace('{x}', 'c3')} = '' THEN c3 END AS sent FROM s3)"
query("x20_egress", with_records("SELECT id, decision, sent FROM fin", _DECIDED, _STEPS))(lambda s, d: gates.egress(_requests(s, d)).select("id", "decision", F.get("payload", F.lit(0))["text"].alias("sent")))
query("a10_egress_summary", with_records("SELECT " + ", ".join(f"count(*) FILTER (decision = '{x}') AS {x}" for x in (gates.ALLOWED, gates.REDACTED, gates.LOCAL, gates.REVIEW, gates.DENIED)) + " FROM fin", _DECIDED, _STEPS))(lambda s, d: gates.egress_summary(gates.egress(_requests(s, d))))
query("x11_chunks")(lambda s, d: ingest.chunks(records(s, d).select("id", F.col("content").alias("text"))).select("id", "ordinal", "char_start", "char_end", "n_tokens"))

# Clusters

query("n1_exact_clusters", with_records("SELECT tenant, subject, content_hash AS key, string_agg(id, ',' ORDER BY id) AS ids FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2"))(lambda s, d: consolidate.exact_clusters(records(s, d), 2).select("tenant", "subject", "key", F.array_join("ids", ",").alias("ids")))

def _near_clusters(spark, sf_dir, block=None):
    """Of equal `label` alone in n2_near_clusters, as in its SQL; of all vectors, as in the reference, in n2_near_clusters_all."""
    found = consolidate.near_neighbourhoods(table(spark, sf_dir, "embeddings"), 0.3, block=block)
    return found.select(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "key", F.round("score", 6).alias("score"))


query(
    "n2_near_clusters",
    f"WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, round({_DOT}, 9) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label), s AS (SELECT id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS ids, round(min(sim), 6) AS score FROM p WHERE sim >= 0.3 OR id = other GROUP BY id HAVING count(*) >= 3) SELECT ids, min(id) AS key, arg_min(score, id) AS score FROM s GROUP BY ids",
)(lambda s, d: _near_clusters(s, d, "label"))
query(
    "n2_near_clusters_all",
    f"WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, round({_DOT}, 9) AS sim FROM embeddings a CROSS JOIN embeddings b), s AS (SELECT id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS ids, round(min(sim), 6) AS score FROM p WHERE sim >= 0.3 OR id = other GROUP BY id HAVING count(*) >= 3) SELECT ids, min(id) AS key, arg_min(score, id) AS score FROM s GROUP BY ids",
)(lambda s, d: _near_clusters(s, d))
_NOW = "TIMESTAMP '2024-04-01'"
_MERGE = f"retention <> 'pinned' AND coalesce(valid_from, '') <> 'not-a-date' AND {VALID_SQL} AND {SHOWN_SQL} AND (epistemic <> 'model-generated' OR coalesce(review_state = 'accepted', false)) AND NOT pii AND greatest((epoch({_NOW}) - created_at) / 86400.0::DOUBLE, 0) >= 90"
query("n4_may_merge", with_records(f"SELECT id, {_MERGE} AS mergeable FROM r"))(lambda s, d: records(s, d).select("id", consolidate.may_merge(at()).alias("mergeable")))
query(
    "n5_safe_clusters",
    with_records(
        f"SELECT content_hash AS cluster_id, count(*) AS n, count(*) >= 2 AND count(DISTINCT tenant) = 1 AND count(DISTINCT subject) = 1 AND count(DISTINCT classification || CAST(roles AS VARCHAR) || CAST(role_groups AS VARCHAR)) = 1 AND NOT bool_or(retention = 'pinned') AND bool_and({_MERGE}) AS safe FROM r GROUP BY content_hash"
    ),
)(lambda s, d: consolidate.safe_clusters(records(s, d).withColumn("cluster_id", F.col("content_hash")), at(), 2).select("cluster_id", "n", "safe"))

# Events


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


query("w1_rate_limit")(lambda s, d: limits.rate_limited(_keyed(s, d), 3, 86400.0).select("key", "event_id", "allowed", "remaining"))
query(
    "w3_breaches",
    "WITH i AS (SELECT *, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT user_id AS key, count(*) AS n, epoch_us(min(ts)) AS first_us, count(*) >= 2 AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 3600000000 AS fires FROM i WHERE value > 50 GROUP BY user_id, g",
)(lambda s, d: limits.breaches(_keyed(s, d), 50.0, 2, 3600.0).select("key", "n", F.unix_micros("first").alias("first_us"), "fires"))
query("e_tumbling", "SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda s, d: limits.tumbling(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))
)
query(
    "e_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '12 hours' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM i GROUP BY user_id, k",
)(lambda s, d: limits.sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "12 hours").select("user_id", F.unix_micros("start").alias("start_us"), "n"))
