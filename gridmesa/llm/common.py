"""What several corpus operators need: shared storage, held-out folds, bounded samples, batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow record batches are handled in slices of about so many bytes of text, so that a worker's memory does not follow the batch.
SLICE_BYTES = 2 << 20


#: Rows of an Arrow batch, unless the session says otherwise: rows are whole documents, and batches stand in memory several times over.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Where the session has Spark's default size of Arrow batches, it gets a smaller one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share. A local one is made only where the cluster names none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="gridmesa-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df after a round trip through a table in the shared folder: the lineage is cut, and losing an executor loses nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


#: Paths of the tables that written() has made and that have not been discarded.
_SCRATCH: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)
    _SCRATCH.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        if df.scratch_path in _SCRATCH:
            _delete(df.sparkSession, df.scratch_path)


def written_alone(spark: SparkSession, make, name: str) -> DataFrame:
    """written(make(), name), after which the tables that make() and its plan needed on the way are deleted."""
    before = set(_SCRATCH)
    out = written(make(), name)
    for path in [p for p in _SCRATCH if p not in before and p != out.scratch_path]:
        _delete(spark, path)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo divisor. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """All of df if it has at most `rows` rows, else about that many, chosen by a hash of the columns `by`."""
    total = df.count()
    if total <= rows:
        return df
    share = int((1 << 30) * rows / total)
    return df.where(F.pmod(F.xxhash64(*[F.col(c) for c in by], F.lit("sample")), F.lit(1 << 30)) < share)


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about `limit` characters each, at least one text in each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def arrow_texts(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches, each with its texts; null is the empty text. The size is judged on the Arrow buffers."""
    for batch in batches:
        values = batch.column(column)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0))
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            floor = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, floor + SLICE_BYTES, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start = stop


def with_columns(part: pa.RecordBatch, keep: list[str], **added: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column(c) for c in keep] + list(added.values()), names=keep + list(added))


def appended_schema(df: DataFrame, keep: list[str], ddl: str):
    """df's types of the columns `keep`, followed by the fields of ddl."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(df.sparkSession)
    return StructType([df.schema[c] for c in keep] + _parse_datatype_string(ddl).fields)
