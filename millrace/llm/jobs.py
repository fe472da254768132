"""Helpers for jobs of several steps: shared folders, cut lineage, batch sizes.

Intermediate tables of a job stand in one folder under spark.checkpoint.dir. Inside `scope(spark)` that folder
goes when the block ends, so write or collect results there; outside of one it goes when the application ends.
"""

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that a Python function gets at once, as texts may be long.
ROWS, BYTES = 256, 1 << 23
_scope: contextvars.ContextVar[str | None] = contextvars.ContextVar("scope", default=None)
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset and all run on one machine."""
    if kept := spark.conf.get("spark.checkpoint.dir", None):
        return kept.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return _local[0]


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(spark: SparkSession) -> str:
    """The scope's folder, or one that the file system removes when the application ends."""
    if kept := _scope.get():
        return kept
    name = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    path, files = _path(spark, name)
    files.deleteOnExit(path)
    return name


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of all operators that run in the block; it goes with the block."""
    name = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    token = _scope.set(name)
    try:
        yield name
    finally:
        _scope.reset(token)
        path, files = _path(spark, name)
        files.delete(path, True)


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder; its lineage ends there, so a lost executor costs no recomputation.

    While it is written, Arrow batches are small and the step's shuffle files go as it ends; the session's own settings come back.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    with _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table made by written() that no later result reads."""
    path, files = _path(df.sparkSession, df._millrace_path)
    files.delete(path, True)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, whole, in slices of at most ROWS rows and about BYTES bytes."""
    if not batch.num_rows:
        return
    step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.get_total_buffer_size())))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in small parts, whatever the session's batches are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield from function(part)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, flags: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows, whole, whose text is flagged; nothing is shuffled. flags: texts of a batch -> whether each stays."""
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(flags(batch.column(at)), pa.bool_()))

    return map_batches(df, run, df.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
