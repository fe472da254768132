"""Corpus pipeline: five filters and transforms over `documents`, each on all that the one before it kept.

Toxicity drops what its classifier rejects; near-dedup keeps the smallest doc_id
of each group of near copies (five-word shingles, similarity 0.8); substring
dedup removes repeated 50-word windows from the texts; decontamination drops
documents that hold a benchmark item; packing lays the rest out in batches.

Every stage but the last takes and returns whole rows of documents, further
columns of any name included. Defined results: null and empty texts are scored
as empty, are nobody's copy, lose no word, hold no item and are packed with
length 0; a row without doc_id is nobody's copy and loses no word, and is judged
by its text elsewhere; rows repeated whole go through each stage together; of
equal texts the smallest doc_id stays; an empty table gives no rows.
"""

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, neardup, packing, substring, toxicity
from millrace.llm.jobs import discard, table, written

NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose calibrated score is under 0.5; all of them where the labels show one kind only."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without those linked, directly or through others, with a smaller doc_id."""
    return neardup.deduplicate(docs, NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose no word stay as they are."""
    return substring.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of `benchmark`; all of them where that table is empty."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document: its length, bucket, batch and place."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack)]

#: The classifier, signatures and dynamic program have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
