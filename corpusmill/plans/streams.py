"""Queries that run a stream to its end over a table's files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import control
from corpusmill.storage import fresh_path
from corpusmill.streaming import events

from . import sessions
from .registry import ORACLE, QUERIES


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """The rows that a stream appends until its source has no more, from the shared folder."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, f"{name}-progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def q36_stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Events delivered twice, streamed and deduplicated by id within a watermark."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")  # a pattern: the table may be one file
    twice = source.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = events.deduplicated(twice, "event_id", "ts", "1 hour")
    return run_to_end(once.select("event_id", "user_id", "event_type"), "deduplicated")


def streamed(spark: SparkSession, folder: str) -> DataFrame:
    """The table events as a stream, ts an instant."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def q36_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users, by the stream's own aggregate, over the bounded table: no session waits for a watermark."""
    own = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.sessions(own, "user_id")
    return found.select("user_id", F.col("begins").cast("timestamp_ntz").alias("begins"), F.col("ends").cast("timestamp_ntz").alias("ends"), "events")


def q60_stream_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each dataset, kept by a stateful stream and read from its state."""
    spark.conf.set(*events.STATE_STORE)
    own = streamed(spark, folder).select(F.col("user_id").cast("string").alias("dataset_id"), control.wire_state(sessions.event_state()).alias("wire"), "ts", "event_id")
    progress = fresh_path(spark, "states-progress")
    changed = events.kept_states(own, ["dataset_id"], "wire", ["ts", "event_id"])
    changed.writeStream.outputMode("update").format("noop").option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return events.states(spark, progress, ["dataset_id"])


def q61_stream_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames from a stream, decoded; malformed ones are dropped and counted."""
    framed = sessions.framed_events(streamed(spark, folder))
    decoded = events.sound(framed).select("event_id", "decoded.schema_id", F.array_join("decoded.indexes", ",").alias("path"), F.col("decoded.payload").cast("string").alias("payload"))
    return run_to_end(decoded, "frames")


def q62_stream_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Lifecycle events of a stream of commands."""
    own = streamed(spark, folder).select(F.col("event_id").cast("string").alias("command_id"), F.col("user_id").cast("string").alias("dataset_id"), F.when(F.col("event_type") == "click", "train").when(F.col("event_type") == "view", "ORCHESTRATION_ACTION_PREPARE").otherwise(F.col("event_type")).alias("action"), "ts")
    return run_to_end(events.lifecycle(own).drop("ts"), "lifecycle")


def q63_stream_relay(spark: SparkSession, folder: str) -> DataFrame:
    """A relay whose first delivery fails: every event arrives once."""
    out, tries = fresh_path(spark, "relayed"), []

    def deliver(batch: DataFrame, number: int) -> None:
        tries.append(number)
        if len(tries) == 1:
            raise ConnectionError("not yet")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    events.relayed(streamed(spark, folder).select("event_id", "event_type"), deliver).option("checkpointLocation", fresh_path(spark, "relay-progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type")


def _registered(f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[f.__name__], ORACLE[f.__name__] = f, sql


_registered(q36_stream_dedup, "SELECT event_id, user_id, event_type FROM events")
_registered(q36_sessions, """WITH gaps AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS fresh FROM events),
placed AS (SELECT user_id, ts, sum(fresh::int) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS number FROM gaps)
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 30 MINUTE AS ends, count(*)::bigint AS events FROM placed GROUP BY user_id, number""")
_registered(q60_stream_states, ORACLE["q31_state_machine_latest"])
_registered(q61_stream_frames, f"WITH {sessions.FRAMES} SELECT event_id, 7::bigint AS schema_id, array_to_string(path, ',') AS path, event_type AS payload FROM framed WHERE event_id % 5 <> 0")
_registered(q62_stream_lifecycle, "SELECT event_id::varchar AS command_id, user_id::varchar AS dataset_id, CASE event_type WHEN 'click' THEN 'train' ELSE 'prepare' END AS step, 'IN_PROGRESS' AS state FROM events WHERE event_type IN ('click', 'view')")
_registered(q63_stream_relay, "SELECT event_id, event_type FROM events")
