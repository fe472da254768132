"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, neardup, packing, substring, tokens, topk, toxicity, urls
from .jobs import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.examples(turns.unionByName(more)))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_classes(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).drop("words")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontamination, op2_chat_formatting, op3_licenses, op4_packing, op5_minhash_near_dedup, op6_url_filter, op7_exact_top_k, op8_toxicity, op9_token_counts, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), s AS (
            SELECT *, role = 'assistant' AS reply,
                length(regexp_replace(replace(role, '\', '\\'), '[<\[](/?s>|/?INST\]|<SYS>>|</SYS>>|\|)', '\0+', 'g')) + 3 * (length(role) - length(replace(role, chr(10), '')))
                + length(regexp_replace(replace(text, '\', '\\'), '[<\[](/?s>|/?INST\]|<SYS>>|</SYS>>|\|)', '\0+', 'g')) + 17 AS chars,
                row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s)
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (reply), '')) AS loss_sha256,
            CAST(sum(upto) FILTER (reply OR i = n) AS BIGINT) AS formatted_chars,
            CAST(count(*) FILTER (reply OR i = n) AS BIGINT) AS n_examples
        FROM e GROUP BY conv_id""",
    "op5_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM d
        ), g AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM p
        ), sh AS (SELECT DISTINCT doc_id, s FROM g WHERE i + 5 <= n OR (n < 5 AND i = 0)
        ), c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
        ), x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (SELECT a, b FROM x JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 85 * (ca.n + cb.n - k)
        ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM d
        ), g AS (SELECT *, CASE WHEN i + 50 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS s FROM p
        ), f AS (SELECT s, min(doc_id) AS m FROM g WHERE s IS NOT NULL GROUP BY s
        ), h AS (SELECT g.doc_id, i, word, coalesce(m < g.doc_id, false) AS hit FROM g LEFT JOIN f ON f.s = g.s
        ), k AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h
        ), t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS left_text FROM k GROUP BY doc_id)
        SELECT d.doc_id, coalesce(t.n, 0) AS n_words, coalesce(t.g, 0) AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
