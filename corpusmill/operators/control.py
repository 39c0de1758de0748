"""Control plane over tables: commands, states, gates, models, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import frames
from corpusmill.storage import written

# Actions with their step and target state, and states on the wire.
ACTIONS = (("PREPARE", "prepare", "PREPARING"), ("TRAIN", "train", "TRAINING"))
ACTION_PREFIX = "ORCHESTRATION_ACTION_"
WIRE = (("QUEUED", "QUEUED"), ("NOT_STARTED", "QUEUED"), ("IN_PROGRESS", "IN_PROGRESS"), ("PARTIAL", "PARTIAL"), ("NEEDS_MASSAGE", "NEEDS_MASSAGE"), ("DONE", "COMPLETED"), ("COMPLETED", "COMPLETED"), ("FAILED", "FAILED"))
WINDOW = 4096
DIRS = ("raw_data", "schema", "adapters", "preflight", "taxonometry", "anchors/owner", "anchors/engine", "acceptance", "output")
MESH_HOSTS = ("host.docker.internal",)


def wire_state(state: Column) -> Column:
    """A state's name on the wire, in either case; UNSPECIFIED for others."""
    out = F.lit("UNSPECIFIED")
    for name, wire in reversed(WIRE):
        out = F.when(F.upper(state) == name, wire).otherwise(out)
    return out


def mapped(commands: DataFrame) -> DataFrame:
    """commands with step and target of their action (wire name or verb, in either case); null for unknown ones."""
    verb = F.regexp_replace(F.upper("action"), f"^{ACTION_PREFIX}", "")
    pick = lambda k: F.coalesce(*(F.when(verb == a[0], F.lit(a[k])) for a in ACTIONS))
    return commands.withColumn("step", pick(1)).withColumn("target", pick(2))


def judged(commands: DataFrame, order: str = "seq") -> DataFrame:
    """commands with step, target and status: invalid (no id or dataset), rejected (unknown action), accepted or duplicate.

    Unknown actions are not remembered: only mapped commands count for duplicates. Over a bounded table all earlier ids are
    remembered; stream.fifo_dedup forgets as the service does.
    """
    known = mapped(commands)
    valid = F.col("command_id").isNotNull() & F.col("dataset_id").isNotNull() & F.col("action").isNotNull()
    counted = valid & F.col("step").isNotNull()
    first = F.row_number().over(Window.partitionBy(F.when(counted, F.col("command_id")).otherwise(F.concat(F.lit("-"), F.col(order).cast("string")))).orderBy(order))
    return known.withColumn("status", F.when(~valid, "invalid").when(F.col("step").isNull(), "rejected").when(first > 1, "duplicate").otherwise("accepted"))


def retained(commands: DataFrame, order: str = "seq", size: int = WINDOW) -> DataFrame:
    """command_id, seq: the newest size distinct ids in order of first acceptance. A top-k, not a sort of all."""
    return commands.groupBy("command_id").agg(F.min(order).alias(order)).orderBy(F.col(order).desc()).limit(size)


def latest_state(events: DataFrame, keys: list[str], state: str, order: list[str], unknown: str = "IDLE") -> DataFrame:
    """keys, state: the last state of each; aggregated before it is shuffled."""
    return events.groupBy(*keys).agg(F.coalesce(F.max_by(state, F.struct(*order)), F.lit(unknown)).alias("state"))


def error_hours(events: DataFrame, failed: Column, at: str = "ts") -> DataFrame:
    """hour, errors, polls for the hours 0 to 23, empty ones included."""
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    own = events.groupBy(F.hour(at).alias("hour")).agg(F.count_if(failed).alias("errors"), F.count(F.lit(1)).alias("polls"))
    return hours.join(F.broadcast(own), "hour", "left").na.fill(0, ["errors", "polls"])  # 24 rows


def parsed_events(raw: DataFrame, schema: str, text: str = "props") -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON text parses (with parsed), and the others."""
    tried = raw.withColumn("parsed", F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col(text).isNull() | F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull()
    return tried.filter(~bad), tried.filter(bad).drop("parsed")


def rewritten_host(url: Column, host: str = "127.0.0.1") -> Column:
    """url with a mesh-only host name replaced."""
    for name in MESH_HOSTS:
        for end in (":", "/"):
            url = F.replace(url, F.lit(f"//{name}{end}"), F.lit(f"//{host}{end}"))
    return url


def resolved(sources: DataFrame, wanted: DataFrame, host: str = "127.0.0.1") -> DataFrame:
    """wanted (name, and what else it has) with provider, url, model: the first model of the first healthy source whose name contains it."""
    served = sources.filter("healthy").select("place", "provider", "url", F.posexplode("models").alias("at", "model"))
    names = wanted.select("name").distinct()  # many may want the same
    found = names.join(F.broadcast(served), F.contains(F.lower("model"), F.lower("name")))  # sources are a short list
    best = found.groupBy("name").agg(F.min(F.struct("place", "at", "provider", "url", "model")).alias("b"))
    return wanted.join(best, "name", "left").select(*wanted.columns, "b.provider", rewritten_host(F.col("b.url"), host).alias("url"), "b.model")


def verify(datasets: DataFrame) -> DataFrame:
    """dataset_id, valid, corpus_files, corpus_bytes, issues of rows with dirs, corpus_files, corpus_bytes, schema_json."""
    missing = F.array_except(F.array(*map(F.lit, DIRS)), F.coalesce("dirs", F.array().cast("array<string>")))
    schema = F.from_json("schema_json", "archetype string, routing map<string, string>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    broken = schema["_corrupt"].isNotNull()
    issues = F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing dirs: "), F.array_join(missing, ", "))),
        F.when(F.coalesce("corpus_files", F.lit(0)) == 0, F.lit("raw_data has no .md corpus")),
        F.when(F.col("schema_json").isNull(), F.lit("missing schema/schema.json")).when(broken, F.lit("schema.json is invalid json")),
        F.when(F.col("schema_json").isNotNull() & ~broken & (F.coalesce(schema["archetype"], F.lit("")) == ""), F.lit("schema.json missing 'archetype'")),
        F.when(F.col("schema_json").isNotNull() & ~broken & (F.coalesce(F.size(schema["routing"]), F.lit(0)) <= 0), F.lit("schema.json missing 'routing'")),
    )
    told = datasets.withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))
    return told.select("dataset_id", (F.size("issues") == 0).alias("valid"), F.coalesce("corpus_files", F.lit(0)).alias("corpus_files"), F.coalesce("corpus_bytes", F.lit(0)).alias("corpus_bytes"), "issues")


class GateFailed(ValueError):
    """A stage's input isn't there yet."""


def gate(df: DataFrame, message: str) -> DataFrame:
    """df, or GateFailed if it has no row."""
    if df.isEmpty():
        raise GateFailed(message)
    return df


def framed(events: DataFrame, schema_id: int, path: Column, payload: str) -> DataFrame:
    """events with frame; path holds the message's indexes."""
    return events.withColumn("frame", frames.encoded_path(F.lit(schema_id), path, F.col(payload)))


def unframed(rows: DataFrame, frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Rows with decoded, and those whose frame is malformed. Frames are made once, decoded once and written."""
    tried = written(written(rows, "framed").withColumn("decoded", frames.decoded(F.col(frame))), "decoded")
    return tried.filter("decoded is not null"), tried.filter("decoded is null").drop("decoded")


def totals(commits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, commits, additions, deletions, last_modified_commit of commits (commit_hash, date, additions, deletions)."""
    return commits.groupBy(*keys).agg(F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.max_by("commit_hash", F.struct("date", "commit_hash")).alias("last_modified_commit"))


def history(commits: DataFrame, keys: list[str]) -> DataFrame:
    """The commits of each keys, oldest first: a row a commit, sorted within partitions by keys, as a file's history may be long."""
    return commits.select(*keys, "date", "commit_hash", "additions", "deletions").repartitionByRange(*keys, "date", "commit_hash").sortWithinPartitions(*keys, "date", "commit_hash")


def throughput(runs: DataFrame) -> DataFrame:
    """runs with elapsed seconds and token_throughput (0 without time)."""
    elapsed = F.col("end_time") - F.col("start_time")
    return runs.withColumn("elapsed", elapsed).withColumn("token_throughput", F.when(elapsed > 0, F.col("output_tokens") / elapsed).otherwise(0.0))
