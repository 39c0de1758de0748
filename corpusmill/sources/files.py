"""Readers of a dataset's folders. All of them are Spark reads, whatever the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.control import DIRS, GateFailed

# Folders that a walk leaves out.
EXCLUDED = (r"\.git", r"\.venv", r"\.obsidian", "node_modules")
#: Bytes that opening a file counts as where files are dealt to tasks: 64 small files make a task of 4 MB.
OPEN_COST = 1 << 16
SIGNATURE = "title string, zipf_avg double, zipf_cluster array<int>, rarity_pos double"
MESSAGE = "struct<raw:string,extracted:string,authors:array<int>,timestamp:double,host:string>"


def _text(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path below folder, text of files whose name fits pattern; a task reads many small ones, and the session keeps no listing."""
    spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST))
    spark.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", "0")
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    root = folder.split("://")[-1].rstrip("/")
    full = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^[a-z0-9]+:/+", "/")
    return rows.select(F.substr(full, F.instr(full, F.lit(root)) + len(root) + 1).alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("bytes"))


def folders(spark: SparkSession, root: str) -> list[str]:
    """The folders in root, or root itself without any: read one after the other, the driver knows the files of one at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f"{root}/{x.getPath().getName()}" for x in found if x.isDirectory()) or [root]


def markdown(spark: SparkSession, folder: str, excluded: tuple[str, ...] = EXCLUDED, pattern: str = "*.md") -> DataFrame:
    """path, text, bytes of the .md files below folder, hidden ones and excluded folders aside."""
    found = _text(spark, folder, pattern).filter(~F.element_at(F.split("path", "/"), -1).startswith("."))
    for pattern in excluded:
        found = found.filter(~F.col("path").rlike(pattern))  # anywhere in the path
    return found


def ingested(files: DataFrame) -> DataFrame:
    """name, path, text, counted: files copied flat; of equal names the last path wins, though all are counted."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.groupBy(name.alias("name")).agg(F.max("path").alias("path"), F.max_by("text", "path").alias("text"), F.count(F.lit(1)).alias("counted"))


def reviews(spark: SparkSession, folder: str, pattern: str = "*-review.json") -> DataFrame:
    """context_id, source_doc, context, questions of review files. Candidate answers may be strings or objects.

    Files that aren't JSON are left out; rejected_reviews() tells them.
    """
    return parsed_reviews(review_texts(spark, folder, pattern))


def review_texts(spark: SparkSession, folder: str, pattern: str = "*-review.json") -> DataFrame:
    """path, text of review files, for parsed_reviews() and rejected()."""
    return _text(spark, folder, pattern).select("path", "text")


def parsed_reviews(texts: DataFrame) -> DataFrame:
    """reviews() of files that are read already."""
    raw = texts.withColumn("v", F.try_parse_json("text")).filter("v is not null")
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    v = F.col("v")
    answer = lambda a: F.coalesce(get(a, "$.answer"), get(a, "$"))
    question = lambda q: F.struct(
        get(q, "$.question").alias("question"), F.coalesce(F.transform(get(q, "$.answers", "array<variant>"), answer), F.array().cast("array<string>")).alias("answers"),
        F.coalesce(get(q, "$.rating", "int"), F.lit(0)).alias("rating"), get(q, "$.synthesis_answer").alias("synthesis_answer"), F.coalesce(get(q, "$.approved", "boolean"), F.lit(False)).alias("approved"),
    )
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    return raw.select(F.coalesce(get(v, "$.context_id"), stem).alias("context_id"), get(v, "$.source_doc").alias("source_doc"), get(v, "$.context").alias("context"), F.coalesce(F.transform(get(v, "$.questions", "array<variant>"), question), F.array().cast("array<struct<question:string,answers:array<string>,rating:int,synthesis_answer:string,approved:boolean>>")).alias("questions"))


def rejected_reviews(spark: SparkSession, folder: str, pattern: str = "*-review.json") -> DataFrame:
    """path of files that reviews() leaves out."""
    return rejected(review_texts(spark, folder, pattern))


def rejected(texts: DataFrame) -> DataFrame:
    return texts.filter(F.try_parse_json("text").isNull()).select("path")


def layout(spark: SparkSession, folder: str) -> DataFrame:
    """One row of what control.verify() judges: dataset_id, dirs, corpus_files, corpus_bytes, schema_json of a dataset's folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        raise GateFailed(f"{folder} not found")
    dirs = [d for d in DIRS if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{d}"))]
    told = spark.createDataFrame([(root.getName(), dirs)], "dataset_id string, dirs array<string>")
    sizes = markdown(spark, f"{folder}/raw_data", ()).select("bytes") if "raw_data" in dirs else spark.range(0).selectExpr("id AS bytes")
    corpus = sizes.agg(F.count(F.lit(1)).alias("corpus_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("corpus_bytes"))
    there = "schema" in dirs and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/schema/schema.json"))
    schema = spark.read.text(f"{folder}/schema/schema.json", wholetext=True).select(F.col("value").alias("schema_json")) if there else spark.range(1).select(F.lit(None).cast("string").alias("schema_json"))
    return told.crossJoin(corpus).crossJoin(schema)


def signatures(spark: SparkSession, folder: str, strict: bool = False, pattern: str = "*.json") -> DataFrame:
    """title, zipf_avg, zipf_cluster, rare_terms, rarity_pos, filename of signature files; the title defaults to the stem.

    Rare terms that aren't strings are left out.
    strict: a file that isn't a signature fails the job; else it is left out.
    """
    told = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = _text(spark, folder, pattern).withColumn("s", F.from_json("text", SIGNATURE if strict else f"{SIGNATURE}, _corrupt string", told))
    kept = rows if strict else rows.filter("s is not null and s._corrupt is null")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    zero = lambda c: F.coalesce(f"s.{c}", F.lit(0.0)).alias(c)
    listed = F.try_variant_get(F.try_parse_json("text"), "$.rare_terms", "array<variant>")
    terms = F.transform(F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return kept.select(F.coalesce("s.title", stem).alias("title"), zero("zipf_avg"), "s.zipf_cluster", F.coalesce(terms, F.array().cast("array<string>")).alias("rare_terms"), zero("rarity_pos"), F.col("path").alias("filename"))


def chatlogs(spark: SparkSession, folder: str, skip_bad: bool = False) -> DataFrame:
    """conv_id (the path), turn, text, host of chat logs, in the order of the messages' keys.

    A file without an object of messages fails the read, unless skip_bad leaves it out.
    """
    raw = _text(spark, folder, "*.json").withColumn("messages", F.get_json_object("text", "$.messages"))
    keys = F.json_object_keys("messages")
    known = raw.withColumn("keys", keys).withColumn("map", F.from_json("messages", f"map<string,{MESSAGE}>"))
    if not skip_bad:
        bad = [r["path"] for r in known.filter("keys is null").select("path").limit(5).collect()]
        if bad:
            raise ValueError(f"not chat logs: {', '.join(bad)}")
    turn = known.filter("keys is not null").select(F.col("path").alias("conv_id"), "map", F.posexplode("keys").alias("turn", "key"))
    return turn.select("conv_id", "turn", F.col("map")[F.col("key")]["extracted"].alias("text"), F.col("map")[F.col("key")]["host"].alias("host"))


def rejected_chatlogs(spark: SparkSession, folder: str) -> DataFrame:
    """path of files that chatlogs() can't read."""
    raw = _text(spark, folder, "*.json")
    return raw.filter(F.json_object_keys(F.get_json_object("text", "$.messages")).isNull()).select("path")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """path, commit_hash, date, additions, deletions of `git log --numstat --format=%x1e%H%x1f%cI` written to path.

    A commit without files has no row; files without line counts (binary ones) have 0.
    """
    lines = F.split("value", "\n")
    head = F.split(F.get(lines, F.lit(0)), "\x1f")
    stats = F.filter(lines, lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t."))
    own = spark.read.text(path, lineSep="\x1e").select(F.get(head, F.lit(0)).alias("commit_hash"), F.to_timestamp(F.get(head, F.lit(1))).alias("date"), F.explode(stats).alias("line"))
    field = F.split("line", "\t", 3)
    return own.select(field[2].alias("path"), "commit_hash", "date", *(F.coalesce(field[i].try_cast("long"), F.lit(0).cast("long")).alias(name) for i, name in enumerate(("additions", "deletions"))))


def commands(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of command files: JSON lines landing in folder; what doesn't parse has _corrupt_record."""
    ddl = "command_id string, dataset_id string, action string, trace_id string, parameters_json string, issued_by string, ts timestamp, _corrupt_record string"
    return spark.readStream.schema(ddl).option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)


def kafka_commands(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from a broker, from its latest offsets; needs the connector's package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load().select(F.col("value").alias("frame"), "timestamp")


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that are new in folder."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "modificationTime", "length")


def require(found: DataFrame, what: str) -> DataFrame:
    """found, or GateFailed naming what is missing."""
    if found.isEmpty():
        raise GateFailed(f"{what} not found")
    return found
