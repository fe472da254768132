"""Hybrid top-k retrieval: BM25 and hashed embeddings, rank fusion, re-ranking, collapse of mirrors.

Scores are columns of one pass over the visible records: the query's terms are
few, so a record's term counts need no exploded tokens, and corpus statistics
are one row. Only top lists (at most topc rows) leave the executors. Ties go to
the smaller id.
"""

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

DIMS = 256


def query_tokens(cue: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", cue.lower())))


def hashed_counts(text: str) -> dict[int, int]:
    out: dict[int, int] = {}
    for t in re.findall("[a-z0-9]+", (text or "").lower()):
        b = hashlib.md5(t.encode()).digest()[-1] % DIMS
        out[b] = out.get(b, 0) + 1
    return out


def hashed_similarity(cue: str):
    """A pandas UDF: cosine of a text's hashed token counts with the cue's; 0 without tokens."""
    asked = np.zeros(DIMS)
    for b, n in hashed_counts(cue).items():
        asked[b] = n
    asked /= np.linalg.norm(asked) or 1.0

    @F.pandas_udf("double")
    def similarity(texts: pd.Series) -> pd.Series:
        seen: dict[str, int] = {}
        out = []
        for text in texts:
            places = []
            for t in re.findall("[a-z0-9]+", (text or "").lower()):
                if (b := seen.get(t)) is None:
                    b = seen[t] = hashlib.md5(t.encode()).digest()[-1] % DIMS
                places.append(b)
            v = np.bincount(places, minlength=DIMS) if places else np.zeros(DIMS)
            out.append(float(v @ asked) / (float(np.sqrt((v * v).sum())) or 1.0))
        return pd.Series(out)

    return similarity


def term_counts(records: DataFrame, cue: str, text: str = "content") -> tuple[DataFrame, list[str]]:
    """records with `doclen` and one count column tf_i for each query token."""
    terms = query_tokens(cue)
    out = records.withColumn("_tokens", T.tokens(F.col(text))).withColumn("doclen", F.size("_tokens"))
    for i, t in enumerate(terms):
        out = out.withColumn(f"tf_{i}", F.size("_tokens") - F.size(F.array_remove("_tokens", t)))
    return out.drop("_tokens"), terms


def bm25(records: DataFrame, cue: str, text: str = "content", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """records with their BM25 score for the cue; statistics are of these records alone."""
    counted, terms = term_counts(records, cue, text)
    found = [F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("doclen").alias("avgdl"), *found)
    length = F.when(F.coalesce("avgdl", F.lit(0.0)) == 0, 1.0).otherwise(F.col("avgdl"))

    def part(i: int) -> Column:
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("doclen") / length))).otherwise(0.0)

    score = reduce(lambda x, y: x + y, (part(i) for i in range(len(terms))), F.lit(0.0))
    # one row of statistics for every record
    return counted.crossJoin(F.broadcast(stats)).withColumn("bm25", score).select(*records.columns, "doclen", "bm25")


def term_index(records: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Postings (token, id, tf) and lengths (id, doclen), to be written once and read by many queries.

    Written sorted by token, a query reads only the row groups of its own tokens. No statistics of the corpus
    are kept, as they depend on what a principal may see.
    """
    tokens = records.select("id", T.tokens(F.col(text)).alias("t"))
    return tokens.select("id", F.explode("t").alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf")), tokens.select("id", F.size("t").cast("long").alias("doclen"))


def bm25_indexed(postings: DataFrame, lengths: DataFrame, visible: DataFrame, cue: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, bm25) of the visible records that hold a query token, from an index instead of texts."""
    seen = lengths.join(visible.select("id"), "id", "left_semi")
    stats = seen.agg(F.count("*").alias("n_docs"), F.avg("doclen").alias("avgdl"))
    hits = postings.where(F.col("token").isin(*query_tokens(cue))).join(seen, "id")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))  # a row for each query token
    rows = hits.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("doclen") / F.col("avgdl")))
    return rows.groupBy("id").agg(F.sum(part).alias("bm25"))


def nearest(vectors: DataFrame, query: list[float], n: int, metric: str = "dot") -> DataFrame:
    """The n rows with the highest dot product, or least distance (score: its negative), with the query."""
    q = F.array(*(F.lit(float(x)) for x in query))
    terms = F.zip_with("embedding", q, lambda a, b: a.cast("double") * b if metric == "dot" else (a.cast("double") - b) * (a.cast("double") - b))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    score = total if metric == "dot" else -F.sqrt(total)
    return vectors.where(F.size("embedding") == len(query)).withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "vec_id").limit(n)


def candidates(visible: DataFrame, cue: str, topc: int = 50, lexical_only: bool = False) -> DataFrame:
    """Top lists of both scores, united; `dense` is null for those outside the dense list. lexical_only: the first list alone, no text goes to Python."""
    scored = bm25(visible, cue).withColumn("bm25", F.round("bm25", 9))
    lexical = scored.orderBy(F.desc("bm25"), "id").limit(topc)
    if lexical_only:
        return lexical.withColumn("dense", F.lit(None).cast("double"))
    scored = scored.withColumn("dense", F.round(hashed_similarity(cue)(F.col("content")), 9))
    dense = scored.orderBy(F.desc("dense"), "id").limit(topc)
    both = dense.unionByName(lexical.withColumn("dense", F.lit(None).cast("double")))
    first = Window.partitionBy("id").orderBy(F.desc_nulls_last("dense"))
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def fused(cands: DataFrame, topc: int = 50, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of both orders, the topc best of it; at most 2 * topc rows come in."""
    rank = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(c), "id"))
    ranked = cands.withColumn("_d", rank("dense")).withColumn("_l", rank("bm25"))
    mass = lambda r: F.when(F.col(r) <= topc, 1.0 / (F.col(r) + k)).otherwise(0.0)
    return ranked.withColumn("rrf", F.round(mass("_d") + mass("_l"), 12)).where("rrf > 0").drop("_d", "_l").orderBy(F.desc("rrf"), "id").limit(topc)


def collapsed(ranked: DataFrame, score: str, k: int) -> DataFrame:
    """The k best by score, one of each mirror family: rank from 0, and the ids that gave way to it."""
    family = V.mirror_family(F.col("source_ids"))
    rows = ranked.withColumn("_key", F.coalesce(family["key"], F.concat(F.lit("id:"), F.col("id")))).withColumn("_prec", F.coalesce(family["rank"], F.lit(2)))
    order = [F.desc(score), F.col("_prec"), F.col("id")]
    whole, family_of = Window.partitionBy(F.lit(0)), Window.partitionBy("_key")
    rows = rows.withColumn("_pos", F.row_number().over(whole.orderBy(*order))).withColumn("_nth", F.row_number().over(family_of.orderBy(*order)))
    rows = rows.withColumn("rank", F.sum(F.when(F.col("_nth") == 1, 1).otherwise(0)).over(whole.orderBy("_pos")) - 1)
    rows = rows.withColumn("_last", F.max(F.when((F.col("_nth") == 1) & (F.col("rank") < k), F.col("_pos"))).over(whole))
    lost = F.array_sort(F.collect_list(F.when((F.col("_nth") > 1) & (F.col("_pos") < F.col("_last")), F.col("id"))).over(family_of))
    return rows.withColumn("collapsed_ids", lost).where((F.col("_nth") == 1) & (F.col("rank") < k)).drop("_key", "_prec", "_pos", "_nth", "_last")


def recall(visible: DataFrame, cue: str, k: int = 8, topc: int = 50, method: str = "hybrid", intent: str = "default", entities: list[str] | None = None, at: Column | None = None) -> DataFrame:
    """The k best records: id, rank, score and its parts. method: lexical, hybrid or typed."""
    cands = candidates(visible, cue, topc, method == "lexical")
    if method == "lexical":
        return collapsed(cands.withColumn("score", F.col("bm25")).withColumn("rrf", F.lit(0.0)).withColumn("rerank", F.col("bm25")), "score", k)
    asked = F.array(*map(F.lit, query_tokens(cue))).cast("array<string>")
    ranked = fused(cands, topc).withColumn("rerank", F.round(T.jaccard(asked, F.array_distinct(T.tokens(F.col("content")))), 9))
    if method == "hybrid":
        return collapsed(ranked.withColumn("score", F.col("rerank")), "score", k)
    # re-scoring follows the collapse, so a family is judged by its best member
    ranked = collapsed(ranked, "rerank", topc).drop("rank")
    ranked = ranked.withColumn("score", F.round(V.typed_score(F.col("rerank"), intent=intent, entities=entities or [], at=at), 9))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")) - 1).where(F.col("rank") < k)


def scored_by(cands: DataFrame, cue: str, scorer, limit: int = 4000) -> DataFrame:
    """Re-ranks by a model: scorer(cue, texts) -> scores, called on Arrow batches of clipped texts; `scorer` loads what it needs on the worker."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in scorer(cue, texts.tolist())])

    return cands.withColumn("rerank", score(T.clip(F.col("content"), limit)))


def subject_first(visible: DataFrame, cue: str, subject: str, k: int = 8) -> DataFrame:
    """Recall within a subject; over all visible records if the subject has none."""
    own = visible.where(F.col("subject") == subject)
    return recall(own if not own.isEmpty() else visible, cue, k)


def keyword_fallback(records: DataFrame, cue: str, k: int = 8) -> DataFrame:
    """Without any index: the k records that share most query tokens, as a share of them."""
    terms = query_tokens(cue)
    asked = F.array(*map(F.lit, terms)).cast("array<string>")
    score = F.size(F.array_intersect(asked, T.tokens(F.col("content")))) / max(1, len(terms))
    return records.withColumn("score", F.round(score, 9)).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
