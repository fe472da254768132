"""A vector index of files: a base sorted by tenant, and deltas that add, replace and remove until it is built anew."""

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files

SCHEMA = "id string, tenant string, vector array<float>, removed boolean"
#: Vectors scored at once.
ROWS = 4_096
#: Queries sent to the tasks at once.
QUERIES = 4_096


class VectorIndex:
    """Parts under `root`, each published once under the next number: a base (`base`) or a delta. Vectors alone; policy is the caller's `allowed`.

    A search reads the files of its tenants (the base is sorted, so others are skipped by their statistics), lets ids of later deltas
    replace earlier ones, and keeps n rows a query in each task. Ids null and vectors null or empty are not indexed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _parts(self) -> list[str]:
        """The last base and the deltas after it."""
        found = [n for n in files.names(self.spark, self.root) if n.startswith("part-")]
        bases = [i for i, n in enumerate(found) if n.endswith("-base")]
        return found[bases[-1] :] if bases else found

    def _publish(self, rows: DataFrame, kind: str) -> None:
        found = [n for n in files.names(self.spark, self.root) if n.startswith("part-")]
        number = int(found[-1].split("-")[1]) + 1 if found else 1
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        rows.select("id", "tenant", "vector", "removed").write.parquet(draft)
        # of two writers of one number one takes `claim-`; the other leaves nothing behind
        claim = f"{self.root}/.claim-{uuid.uuid4().hex}"
        files.write_bytes(self.spark, claim, kind.encode())
        if not files.published(self.spark, claim, f"{self.root}/claim-{number:08d}"):
            files.removed(self.spark, draft)
            raise RuntimeError(f"part {number} has been made by another writer")
        if not files.published(self.spark, draft, f"{self.root}/part-{number:08d}-{kind}"):
            raise RuntimeError(f"part {number} has been made by another writer")

    @staticmethod
    def _given(vectors: DataFrame) -> DataFrame:
        rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("tenant").cast("string").alias("tenant"), F.col("vector").cast("array<float>").alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
        # of rows with one id the greatest stays
        return rows.groupBy("id").agg(F.max(F.struct("tenant", "vector")).alias("_r")).select("id", "_r.*", F.lit(False).alias("removed"))

    def rebuild(self, vectors: DataFrame | None = None) -> None:
        """A new base from id, tenant, vector; from what is indexed where none are given. The parts before are kept for readers; `vacuum` removes them."""
        rows = self.live() if vectors is None else self._given(vectors)
        self._publish(rows.withColumn("removed", F.lit(False)).repartitionByRange(F.col("tenant"), F.col("id")).sortWithinPartitions("tenant", "id"), "base")

    def add(self, vectors: DataFrame) -> None:
        """Adds vectors, or replaces those of known ids."""
        self._publish(self._given(vectors), "delta")

    def remove(self, ids: DataFrame) -> None:
        rows = ids.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
        self._publish(rows.select("id", F.lit(None).cast("string").alias("tenant"), F.lit(None).cast("array<float>").alias("vector"), F.lit(True).alias("removed")), "delta")

    def vacuum(self) -> None:
        """Removes the parts that the last base replaced."""
        kept = set(self._parts())
        for n in files.names(self.spark, self.root):
            if n.startswith("part-") and n not in kept:
                files.removed(self.spark, f"{self.root}/{n}")

    def live(self, tenants: list[str] | None = None) -> DataFrame:
        """What is indexed: id, tenant, vector. Only deltas are grouped by id; the base is held against their ids."""
        parts = self._parts()
        read = lambda names: self.spark.read.schema(SCHEMA).parquet(*(f"{self.root}/{n}" for n in names))
        mine = (lambda df: df.where(F.col("tenant").isin(*tenants))) if tenants is not None else (lambda df: df)
        base, deltas = [p for p in parts if p.endswith("-base")], [p for p in parts if p.endswith("-delta")]
        out = mine(read(base)) if base else self.spark.createDataFrame([], SCHEMA)
        if deltas:
            place = F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)-", 1).cast("long")
            last = read(deltas).withColumn("_p", place).groupBy("id").agg(F.max_by(F.struct("tenant", "vector", "removed"), "_p").alias("_r")).select("id", "_r.*")
            out = out.join(last.select("id"), "id", "left_anti").select("id", "tenant", "vector", "removed").unionByName(mine(last.where("NOT removed")))
        return out.select("id", "tenant", "vector")

    def search(self, queries: list[tuple[str, str, list[float]]], n: int, allowed: DataFrame | None = None) -> DataFrame:
        """query, rank (from 1), id, score of the n highest dot products of each query (name, tenant, vector), ties to smaller ids.

        Only rows of the query's tenant and length count, and of `allowed` (id) where given. The queries go to every task: give some thousands at once.
        """
        rows = self.live(sorted({t for _, t, _ in queries}))
        if allowed is not None:
            rows = rows.join(allowed.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        by: dict[tuple[str, int], tuple[list[str], list[list[float]]]] = {}
        for name, tenant, vector in queries:
            own = by.setdefault((tenant, len(vector)), ([], []))
            own[0].append(name)
            own[1].append(vector)
        kept = {k: (names, np.array(v, dtype=float)) for k, (names, v) in by.items()}
        found = rows.select("id", "tenant", "vector").mapInArrow(_scored(kept, n), "query string, id string, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query", "rank", "id", "score")

    def search_all(self, queries: DataFrame, n: int, allowed: DataFrame | None = None) -> DataFrame:
        """The same for a table of queries (query, tenant, vector), QUERIES at a time."""
        rows, out = queries.select(F.col("query").cast("string"), F.col("tenant").cast("string"), F.col("vector").cast("array<double>")).where("size(vector) > 0").toLocalIterator(), None
        while block := list(itertools.islice(rows, QUERIES)):
            part = self.search([tuple(r) for r in block], n, allowed)
            out = part if out is None else out.unionByName(part)
        return self.search([], n, allowed) if out is None else out


def _scored(kept: dict[tuple[str, int], tuple[list[str], np.ndarray]], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ids, tenants = np.array(batch["id"].to_pylist(), dtype=object), np.array(batch["tenant"].to_pylist(), dtype=object)
                vectors = batch["vector"]
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                for (tenant, size), (names, matrix) in kept.items():
                    hit = np.nonzero((tenants == tenant) & (sizes == size))[0]
                    if not len(hit):
                        continue
                    own = vectors.take(pa.array(hit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
                    order = np.argsort(ids[hit].astype(str), kind="stable")
                    hit, scores = hit[order], np.round(own[order] @ matrix.T, 9)
                    best = np.argsort(-scores, axis=0, kind="stable")[:n]
                    for q, name in enumerate(names):
                        rows = best[:, q]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(list(ids[hit[rows]]), pa.string()), pa.array(scores[rows, q])], ["query", "id", "score"])

    return run
