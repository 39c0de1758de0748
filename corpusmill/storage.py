"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written inside each open scope.
_SCOPES: list[dict[int, tuple[DataFrame, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or, on this machine alone (tests), a folder of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and it survives lost executors."""
    return appended([df], name)


def appended(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Tables of one schema, one at least, as one written table; each is made when the one before it is done."""
    path = ""
    for df in parts:
        if path:
            gc.collect()  # else plans of parts that are done, with their lists of files, stay in the JVM for long
        path = path or fresh_path(df.sparkSession, name)
        df.write.mode("append").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1][id(stored)] = (stored, path)
    return stored


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scope:
    def __init__(self) -> None:
        self.kept: set[int] = set()

    def keep(self, *tables: DataFrame) -> tuple[DataFrame, ...]:
        self.kept |= {id(t) for t in tables}
        return tables


@contextmanager
def scope() -> Iterator[Scope]:
    """Tables written inside are removed at its end, but those that keep() names: they are the next outer scope's."""
    own = Scope()
    _SCOPES.append({})
    try:
        yield own
    except BaseException:
        own.kept.clear()
        raise
    finally:
        for key, (table, path) in _SCOPES.pop().items():
            if key not in own.kept:
                removed(table.sparkSession, path)
            elif _SCOPES:
                _SCOPES[-1][key] = (table, path)
