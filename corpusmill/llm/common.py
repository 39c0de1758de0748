"""Helpers shared by the training-data operators: Arrow mapping, shared storage, batch sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.shipping import ship
from corpusmill.storage import fresh_path, scope, shared_dir, written

__all__ = ["arrow_map", "arrow_schema", "bounded_batches", "fresh_path", "id_and_text", "input_bytes", "partitions", "raw", "read", "scope", "shared_dir", "ship", "strings", "units", "unshuffled", "unused", "written"]

#: Rows and text bytes of one unit of Python work; longer texts are a unit of their own.
UNIT_ROWS, UNIT_BYTES = 2048, 2 << 20
#: Bytes of an Arrow batch between Spark and a worker.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Ships the package and holds the session's Arrow batches to BATCH_BYTES: a batch of very long texts is memory twice."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(BATCH_BYTES))


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes a job's shuffle files at its end, not when the driver's memory happens to be collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def units(batches: Iterable[pa.RecordBatch], size_of: str | None = None, most_bytes: int = UNIT_BYTES, most_rows: int = UNIT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most most_rows rows and, by the lengths of column size_of, about most_bytes bytes."""
    for batch in batches:
        if size_of is None:
            for at in range(0, batch.num_rows, most_rows):
                yield batch.slice(at, most_rows)
            continue
        column = batch.column(batch.schema.get_field_index(size_of))
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(lengths):
            if i > first and (held + n > most_bytes or i - first >= most_rows):
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if batch.num_rows > first:
            yield batch.slice(first)


def arrow_schema(ddl: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl))


def arrow_map(df: DataFrame, ddl: str | T.StructType, start: Callable[[], Callable], size_of: str | None = "text") -> DataFrame:
    """mapInArrow by a step that turns a bounded slice of rows into columns or None.

    start() runs once a task and returns the step; the step gets a RecordBatch and returns a list of columns (Python
    lists or Arrow arrays) in the order of ddl.
    """
    schema = ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for unit in units(batches, size_of):
            if (columns := step(unit)) is not None:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=pa.schema([pa.field(f.name, c.type if isinstance(c, pa.Array) else f.type) for c, f in zip(columns, arrow, strict=True)]))

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_bytes(docs: DataFrame) -> int:
    """The size of docs as Spark estimates it from its files; that of its texts where no files tell."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return size


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator names, so that extra ones don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
