"""Exact top-k search (7) by inner product: columnar branch-and-bound.

Candidates stand in vertical layout, a row of the matrix for each dimension.
Products are summed one block of dimensions after another, for BLOCK queries at
once. What the remaining dimensions can still add is at most the product of the
two remaining norms; a candidate whose sum plus that mass is under the query's
k-th best so far cannot be among its k. Once few (query, candidate) pairs
survive they are compacted, and later blocks are summed for those alone. The
k-th best score of each query is carried over the tiles of a partition, so later
tiles are cut from the start. What survives all blocks is ranked exactly:
components are integers, and sums of products of theirs are exact in doubles up
to 2**53.

Queries are taken QUERIES at a time, a bounded table in the tasks' memory; a
task holds BLOCK * TILE sums besides. Every partition of candidates gives its k
best for each query, and the k best of those are the result. No candidate vector
is shuffled.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; empty vectors score 0 with one another.
Vectors of another length than the query's are not compared with it. Ties go to
the smaller id. Rows with the query's id are its own and not its candidates;
queries of one id and equal vectors are one query, those of one id and different
vectors have a list each under that id. Candidate rows of one id stand each for
themselves. Without queries, or without other rows, there are no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import written

K = 5
QUERIES = 8_192
#: Queries whose sums are held at once, and dimensions in a block.
BLOCK, STEP = 256, 8
#: Sums are compacted once fewer than one pair in so many survives.
SPARSE = 16
#: Candidates in one matrix.
TILE = 4_096


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


class Best:
    """The k best candidates of each query so far, in falling order: scores and ids."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.queries, self.k = own, queries, k
        self.scores = np.full((len(own), k), -np.inf)
        self.ids = np.zeros((len(own), k), np.int64)
        dims = queries.shape[1]
        self.edges = [*range(0, dims, STEP), dims] if dims else [0, 0]
        self.left = _remaining(queries.T, self.edges)

    def add(self, columns: np.ndarray, ids: np.ndarray) -> int:
        """Takes a tile of candidates (dimensions x candidates); returns how many pairs were summed to the end."""
        left = _remaining(columns, self.edges)
        return sum(self._add(slice(a, a + BLOCK), columns, ids, left) for a in range(0, len(self.own), BLOCK))

    def _add(self, block: slice, columns: np.ndarray, ids: np.ndarray, left: np.ndarray) -> int:
        queries, floor, k = self.queries[block], self.scores[block, -1].copy(), self.k
        sums = np.where(self.own[block][:, None] == ids[None, :], -np.inf, 0.0)
        pairs = None
        for i, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            mine = self.left[i][block]
            if pairs is None:
                sums += queries[:, a:b] @ columns[a:b]
                mass = mine[:, None] * left[i][None, :] * (1 + 1e-9)
                if len(ids) > k:
                    low = sums - mass
                    floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
                alive = (sums + mass >= floor[:, None]) & (sums > -np.inf)
                if alive.sum() * SPARSE < alive.size or b == self.edges[-1]:
                    q, c = np.nonzero(alive)
                    pairs, sums = (q, c), sums[q, c]
                else:
                    sums[~alive] = -np.inf
            else:
                q, c = pairs
                sums = sums + np.einsum("ij,ji->i", queries[q, a:b], columns[a:b, c])
                alive = sums + mine[q] * left[i][c] * (1 + 1e-9) >= floor[q]
                pairs, sums = (q[alive], c[alive]), sums[alive]
        q, c = pairs
        q, found = np.concatenate((q, np.repeat(np.arange(len(queries)), k))), np.concatenate((ids[c], self.ids[block].reshape(-1)))
        scores = np.concatenate((sums, self.scores[block].reshape(-1)))
        order = np.lexsort((found, -scores, q))
        first = np.searchsorted(q[order], np.arange(len(queries)))
        best = order[first[:, None] + np.arange(k)]
        self.scores[block], self.ids[block] = scores[best], found[best]
        return len(c)

    def rows(self) -> pa.RecordBatch:
        q, at = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(self.ids[q, at]), pa.array(self.scores[q, at].astype(np.int64))], ["q", "vec_id", "score"])


def _remaining(columns: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of what stands after each block of dimensions."""
    squares = np.concatenate((np.cumsum((columns**2)[::-1], axis=0)[::-1], np.zeros((1, columns.shape[1]))))
    return np.sqrt(squares[edges[1:]])


def _search(queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """queries: by number of dimensions, their numbers, ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dims: Best(own, matrix, k) for dims, (_, own, matrix) in queries.items()}
        tile: list[pa.RecordBatch] = []

        def flush() -> None:
            batch = pa.Table.from_batches(tile).combine_chunks()
            ids, vectors = batch.column(0).to_numpy(), batch.column(1).combine_chunks()
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
            for dims, own in best.items():
                rows = np.flatnonzero(sizes == dims)
                if len(rows):
                    own.add(np.ascontiguousarray(flat[at[rows][:, None] + np.arange(dims)].T, np.float64), ids[rows])

        held = 0
        for whole in batches:
            for start in range(0, whole.num_rows, TILE):
                tile.append(whole.slice(start, TILE))
                held += tile[-1].num_rows
                if held >= TILE:
                    flush()
                    tile, held = [], 0
        if held:
            flush()
        for dims, own in best.items():
            found = own.rows()
            yield found.set_column(0, "q", pa.array(queries[dims][0][found.column(0).to_numpy()]))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k other rows with the highest integer inner product, for each row where is_query."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    asked = rows.where(is_query).distinct()
    passes = max(1, -(-asked.count() // QUERIES))
    out = None
    for n in range(passes):
        held = sorted((r["vec_id"], list(r["v"])) for r in asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes)) == n).collect())
        block: dict[int, list[int]] = {}
        for q, (_, v) in enumerate(held):
            block.setdefault(len(v), []).append(q)
        queries = {dims: (np.array(x), np.array([held[q][0] for q in x], np.int64), np.array([held[q][1] for q in x], np.float64).reshape(len(x), dims)) for dims, x in block.items()}
        found = rows.mapInArrow(_search(queries, k), "q long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        ids = vectors.sparkSession.createDataFrame([(q, i) for q, (i, _) in enumerate(held)], "q long, query_id long")  # QUERIES rows at most, or about
        part = found.join(F.broadcast(ids), "q").select("query_id", "rank", "vec_id", "score")
        part = written(part) if passes > 1 else part
        out = part if out is None else out.unionByName(part)
    return out
