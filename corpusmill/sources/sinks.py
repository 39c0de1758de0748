"""Writers of training data and reports."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

log = logging.getLogger(__name__)


def jsonl(records: DataFrame, folder: str, by: tuple[str, ...] = ("split",)) -> None:
    """JSON lines in a folder a split (and label); what was there is replaced."""
    records.write.mode("overwrite").partitionBy(*by).json(folder)


def report(row: DataFrame, folder: str) -> bool:
    """One row as JSON, best effort: a failure is logged, not raised."""
    try:
        row.coalesce(1).write.mode("overwrite").json(folder)
        return True
    except Exception:
        log.warning("could not write %s", folder, exc_info=True)
        return False


def anchors(pairs: DataFrame, folder: str) -> None:
    """High-reward pairs added to those already kept."""
    pairs.write.mode("append").json(folder)


def trace(steps: DataFrame, folder: str, config: str = "Unknown") -> bool:
    """Steps as JSON lines in folder/trace, their number and the model's configuration in folder/metadata, best effort."""
    try:
        steps.write.mode("overwrite").json(f"{folder}/trace")
    except Exception:
        log.warning("could not write %s", folder, exc_info=True)
        return False
    return report(steps.agg(F.count(F.lit(1)).alias("total_steps"), F.lit(config).alias("model_config")), f"{folder}/metadata")


def manifest(inputs: DataFrame, failed: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row: inputs and failed are lists of files, datasets counts by label and split."""
    listed = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    return listed(inputs, "inputs").crossJoin(listed(failed, "failed")).crossJoin(listed(datasets, "datasets"))


def kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "dataset_id", value: str = "frame") -> DataStreamWriter:
    """Frames to a broker, keyed by dataset, acknowledged by all; needs the connector's package on the class path."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.linger.ms", 5).option("topic", topic).option("checkpointLocation", checkpoint)
