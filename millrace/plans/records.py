"""The test tables as governed records, by arithmetic on ids that SQL can repeat."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.policy import Principal

KINDS = ("source", "episodic", "semantic", "procedural", "profile", "generated", "working")
EPISTEMICS = ("observed-fact", "user-stated", "imported-source", "inferred-belief", "model-generated", "hypothesis", "simulated")
CLASSES = ("public", "internal", "confidential", "restricted")

SUPPORT = Principal("agent:src1", "tenant:en", ("support",), {"region": "us"}, "confidential")
CUE = "the thesened therble of onthan erstion and stthe"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda items, n: F.get(F.array(*map(F.lit, items)), d % n)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    day = lambda start: F.date_format(F.date_add(F.lit(start).cast("date"), (d % 60).cast("int")), "yyyy-MM-dd")
    bound = lambda start: F.when(d % 97 == 0, "not-a-date").when(d % 4 != 1, day(start))
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.concat(F.lit("doc_"), F.lpad(d.cast("string"), 8, "0")).alias("id"), d.alias("doc_id"), F.concat(F.lit("tenant:"), "lang").alias("tenant"), F.concat(F.lit("src:"), "source").alias("subject"),
        F.concat(F.lit("agent:"), "source").alias("created_by"), pick(KINDS, 7).alias("kind"), pick(EPISTEMICS, 7).alias("epistemic"), pick(CLASSES, 4).alias("classification"), (d % 6 == 0).alias("pii"),
        F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 3 == 1, F.array(F.lit("support"))).otherwise(F.array(F.lit("legal"))).alias("roles"),
        F.when(d % 11 == 0, F.array(F.array(F.lit("billing")))).otherwise(F.array().cast("array<array<string>>")).alias("role_groups"),
        F.when(d % 5 == 0, F.array(F.struct(F.lit("region").alias("k"), F.lit("us").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>")).alias("attrs"),
        F.when(d % 13 == 0, "private").otherwise("tenant").alias("visibility"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "disputed").when(F.col("quality") == 1, "accepted").alias("review_state"),
        bound("2024-01-01").alias("valid_from"), bound("2024-06-01").alias("valid_until"), (1700000000.0 + d * 3600).alias("created_at"), F.when(d % 89 == 0, 0.0).otherwise((d % 10 + 1) / 10.0).alias("confidence"), ((d % 5) / 5.0).alias("salience"),
        text.alias("content"), content_hash(text).alias("content_hash"), (d % 17 != 0).alias("indexed"), F.array("source", "lang").alias("entities"), F.array(F.concat(F.lit("src:"), "source")).alias("subject_ids"),
        F.array(F.concat(F.lit("markdown://"), F.when(d % 2 == 0, "memory").otherwise("team-memory"), F.lit("/"), F.left(F.sha2(text, 256), F.lit(16)))).alias("source_ids"),
        F.when(d % 2 == 0, F.array(F.concat(F.lit("span:"), d.cast("string")))).otherwise(F.array().cast("array<string>")).alias("source_spans"),
        F.when(d % 19 == 0, "contextual-aux").otherwise("default").alias("policy_scope"), F.when(d % 9 == 0, "generated_needs_review").alias("truth_status"), F.when(d % 23 == 0, "pinned").otherwise("decayable").alias("retention"),
        F.concat(F.lit("notes/"), "source", F.lit("/"), (d % 50).cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("markdown://notes/"), "source", F.lit("/"), (d % 50).cast("string")).alias("uri"),
    )


#: The same in DuckDB SQL, as the common table expression `r`.
RECORDS_SQL = """r AS (
    SELECT 'doc_' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS id, d.doc_id AS doc_id, 'tenant:' || lang AS tenant, 'src:' || source AS subject, 'agent:' || source AS created_by,
        ['source','episodic','semantic','procedural','profile','generated','working'][d.doc_id % 7 + 1] AS kind,
        ['observed-fact','user-stated','imported-source','inferred-belief','model-generated','hypothesis','simulated'][d.doc_id % 7 + 1] AS epistemic,
        ['public','internal','confidential','restricted'][d.doc_id % 4 + 1] AS classification, d.doc_id % 4 AS class_rank, d.doc_id % 6 = 0 AS pii,
        CASE WHEN d.doc_id % 3 = 0 THEN CAST([] AS VARCHAR[]) WHEN d.doc_id % 3 = 1 THEN ['support'] ELSE ['legal'] END AS roles,
        CASE WHEN d.doc_id % 11 = 0 THEN [['billing']] ELSE CAST([] AS VARCHAR[][]) END AS role_groups,
        d.doc_id % 5 = 0 AS needs_region, CASE WHEN d.doc_id % 13 = 0 THEN 'private' ELSE 'tenant' END AS visibility,
        CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'disputed' WHEN quality = 1 THEN 'accepted' END AS review_state,
        CASE WHEN d.doc_id % 97 = 0 THEN 'not-a-date' WHEN d.doc_id % 4 <> 1 THEN strftime(DATE '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER), '%Y-%m-%d') END AS valid_from,
        CASE WHEN d.doc_id % 97 = 0 THEN 'not-a-date' WHEN d.doc_id % 4 <> 1 THEN strftime(DATE '2024-06-01' + CAST(d.doc_id % 60 AS INTEGER), '%Y-%m-%d') END AS valid_until,
        CAST(1700000000 + d.doc_id * 3600 AS DOUBLE) AS created_at, CASE WHEN d.doc_id % 89 = 0 THEN 0.0::DOUBLE ELSE CAST(d.doc_id % 10 + 1 AS DOUBLE) / 10.0::DOUBLE END AS confidence,
        CAST(d.doc_id % 5 AS DOUBLE) / 5.0::DOUBLE AS salience, coalesce(text, '') AS content, 'sha256:' || sha256(coalesce(text, '')) AS content_hash, d.doc_id % 17 <> 0 AS indexed,
        [source, lang] AS entities, 'mirror:' || substr(sha256(coalesce(text, '')), 1, 16) AS mirror_key, d.doc_id % 2 AS mirror_rank, d.doc_id % 2 = 0 AS has_spans,
        CASE WHEN d.doc_id % 19 = 0 THEN 'contextual-aux' ELSE 'default' END AS policy_scope, CASE WHEN d.doc_id % 9 = 0 THEN 'generated_needs_review' END AS truth_status,
        CASE WHEN d.doc_id % 23 = 0 THEN 'pinned' ELSE 'decayable' END AS retention, 'notes/' || source || '/' || CAST(d.doc_id % 50 AS VARCHAR) || '.md' AS path, source, lang
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

#: Why SUPPORT is denied a record, in SQL.
DENY_SQL = """CASE WHEN tenant <> 'tenant:en' THEN 'cross-tenant' WHEN class_rank > 2 THEN 'classification>clearance'
    WHEN (len(roles) > 0 AND NOT list_contains(roles, 'support')) OR len(role_groups) > 0 THEN 'role'
    WHEN visibility = 'private' AND created_by <> 'agent:src1' THEN 'private' ELSE 'ok' END"""

VALID_SQL = "coalesce(TIMESTAMP '2024-04-01' >= TRY_CAST(valid_from AS TIMESTAMP), true) AND coalesce(TIMESTAMP '2024-04-01' < TRY_CAST(valid_until AS TIMESTAMP), true)"
SHOWN_SQL = "coalesce(review_state NOT IN ('rejected', 'disputed', 'superseded'), true)"
AT = "2024-04-01"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record derives from that of half its number, but for the first; records 4 and 1 close a cycle."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    name = lambda n: F.concat(F.lit("doc_"), F.lpad(n.cast("string"), 8, "0"))
    half = F.floor(F.col("doc_id") / 2)
    out = ids.where("doc_id > 1").select(name(F.col("doc_id")).alias("child"), name(half).alias("parent"), F.lit("derived_from").alias("kind"))
    back = spark.range(1).select(F.lit("doc_00000001").alias("child"), F.lit("doc_00000004").alias("parent"), F.lit("related_to").alias("kind"))
    return out.unionByName(back)


EDGES_SQL = """e AS (
    SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS child, 'doc_' || lpad(CAST(doc_id // 2 AS VARCHAR), 8, '0') AS parent, 'derived_from' AS kind FROM documents WHERE doc_id > 1
    UNION ALL SELECT 'doc_00000001', 'doc_00000004', 'related_to'
)"""
