"""Packing (4): optimal length buckets.

A dynamic program over the histogram of all documents' lengths chooses the
bucket boundaries that need the least padding: documents in a bucket are padded
to its boundary, its longest length. Its transitions are lines in the boundary,
so a lower envelope makes it linear in the number of lengths. Within each bucket
documents form batches of budget // boundary rows: full but for the bucket's last.

Lengths are words unless a column is named. The histogram is exact up to 65,536
and in steps of 1/2048 beyond (rounded up), so the driver gets a bounded table.
Places in a bucket come from counts by (bucket, slot), with about the square root
of the number of rows as slots, so no task holds a bucket.

Defined results: null and empty texts have length 0 and are packed too; a
document longer than the budget is a batch of its own, whole; equal rows are
packed as often as they stand; an empty table gives no rows.
"""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import written

BUDGET = 65_536
BUCKETS = 16
EXACT = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rounded(length: Column) -> Column:
    """The length up to EXACT, then the next multiple of 1/2048 of its power of two."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(EXACT)).cast("double"))) - 11).cast("long")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step).cast("long") * step)


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending distinct lengths and their counts -> the at most `buckets` boundaries with the least padding."""
    m = len(lengths)
    if m <= buckets:
        return [int(x) for x in lengths]
    lens = [int(x) for x in lengths]
    number = [0, *np.cumsum(counts).tolist()]
    total = [0, *np.cumsum(lengths * counts).tolist()]
    cost = [0] + [math.inf] * m
    back = []
    for _ in range(buckets):
        nxt, choice = [math.inf] * (m + 1), [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # lines (slope -number[i], intercept cost[i] + total[i], i); queries rise
        head = 0
        for j in range(1, m + 1):
            i = j - 1
            if cost[i] < math.inf:
                line = (-number[i], cost[i] + total[i], i)
                while len(hull) - head >= 2:
                    (s1, c1, _), (s2, c2, _) = hull[-2], hull[-1]
                    if (line[1] - c1) * (s1 - s2) <= (c2 - c1) * (s1 - line[0]):
                        hull.pop()
                    else:
                        break
                hull.append(line)
            x = lens[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                s, c, i = hull[head]
                nxt[j], choice[j] = s * x + c + x * number[j] - total[j], i
        back.append(choice)
        cost = nxt
    out, j = [], m
    for choice in reversed(back):
        out.append(lens[j - 1])
        j = choice[j]
        if not j:
            break
    return out[::-1]


def pack(docs: DataFrame, length: str | None = None, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens (its boundary), batch (within the bucket), place (within the batch), padding."""
    n = F.col(length).cast("long") if length else word_count(F.col("text").cast("string"))
    rows = written(docs.select(F.col("doc_id").cast("long"), F.coalesce(n, F.lit(0)).alias("n_tokens")))
    histogram = rows.groupBy(rounded(F.col("n_tokens")).alias("n")).agg(F.count("*").alias("c")).orderBy("n").collect()
    ends = boundaries(np.array([r["n"] for r in histogram], np.int64), np.array([r["c"] for r in histogram], np.int64), buckets) or [0]
    slots = math.isqrt(sum(r["c"] for r in histogram)) + 1
    all_ends = F.array(*(F.lit(e).cast("long") for e in ends))
    rows = rows.withColumn("bucket", F.size(F.filter(all_ends, lambda e: e < F.col("n_tokens"))))
    rows = rows.withColumn("bucket_tokens", F.get(all_ends, F.col("bucket"))).withColumn("slot", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(slots)))
    before = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("bucket", "slot").agg(F.count("*").alias("n")).select("bucket", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("doc_id", "n_tokens"))
    rows = rows.withColumn("row", place).join(offsets, ["bucket", "slot"]).withColumn("row", F.col("offset") + F.col("row") - 1)
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("row") / size).cast("long").alias("batch"), (F.col("row") % size).alias("place"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding")
    )
