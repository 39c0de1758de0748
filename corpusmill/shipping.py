"""Gives the executors this package's source, for functions that run in Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, about: a batch of texts is memory several times over.
BATCH_BYTES = 8 << 20
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once an application; Spark serves them to each executor."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    folder = Path(tempfile.mkdtemp(prefix="corpusmill-source-"))
    (folder / "corpusmill.zip").write_bytes(packed.getvalue())
    context.addPyFile(str(folder / "corpusmill.zip"))
    _SHIPPED.add(context.applicationId)


def bounded(spark: SparkSession) -> None:
    """ship(), and the session's Arrow batches held to BATCH_BYTES."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
