"""The stages that a user runs over folders: verify, prepare, chat logs, profile, relate, questions, answers, curate, assemble.

Each gates on its input (GateFailed), computes with the operators, writes what it owns, and returns a one-row report.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import chat, markdown
from corpusmill.functions import text as T
from corpusmill.operators import control, conversations, dataset, generation, graph, lexicon, tagger
from corpusmill.sources import files, sinks
from corpusmill.storage import written

log = logging.getLogger(__name__)
MODES = ("sections", "raw_text", "qa_pairs")


def _split_counts(split: DataFrame) -> DataFrame:
    return split.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "valid").alias("valid"))


def _write(records: DataFrame, column: str, folder: str, valid: float, seed: int) -> DataFrame:
    """Splits the records (one column) by their content, writes them, and counts them."""
    split = written(dataset.split(records.select(column), F.to_json(F.struct(column)), valid, seed), "split")
    sinks.jsonl(split, folder)
    return _split_counts(split)


def prepare(spark: SparkSession, source: str, target: str, mode: str = "sections", reviews: str | None = None, signatures: str | None = None, valid: float = 0.1, seed: int = 42, size: int = 500, overlap: int = 50, system: str = dataset.SYSTEM_PROMPT, excluded: tuple[str, ...] = files.EXCLUDED) -> DataFrame:
    """Markdown, approved reviews and signatures as training records in target/split=train and split=valid."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    docs = files.markdown(spark, source, excluded).filter(F.length(F.trim("text")) > 0)
    plain, column = mode == "raw_text", "text" if mode == "raw_text" else "messages"
    make = {"sections": lambda: dataset.section_records(docs, system, "path"), "raw_text": lambda: dataset.chunk_records(docs, size, overlap, "path"), "qa_pairs": lambda: dataset.document_records(docs, system, "path")}
    records = make[mode]().select(column)
    if reviews:
        records = records.unionByName(dataset.pair_records(dataset.reviewed_pairs(files.reviews(spark, reviews))[0], system, plain).select(column))
    if signatures:
        records = records.unionByName(dataset.signature_records(files.signatures(spark, signatures), system, plain=plain).select(column))
    return _write(files.require(records, "training records"), column, target, valid, seed)


def prepare_chatlogs(spark: SparkSession, source: str, target: str, valid: float = 0.1, seed: int = 42, system: str | None = None, skip_bad: bool = False) -> DataFrame:
    """Character and painter records of chat logs in target/<label>/split=...; returns the manifest, also in target/manifest."""
    said = written(conversations.turns(files.chatlogs(spark, source, skip_bad)), "turns")
    made = {"character": conversations.character_records(said, fallback=system), "painter": conversations.painter_records(said)}
    files.require(said, "turns")
    counts = None
    for label, records in made.items():
        own = _write(records, "messages", f"{target}/{label}", valid, seed).withColumn("label", F.lit(label))
        counts = own if counts is None else counts.unionByName(own)
    inputs = conversations.manifest(said, made["character"], made["painter"])
    told = written(sinks.manifest(inputs, files.rejected_chatlogs(spark, source), counts), "manifest")
    sinks.report(told, f"{target}/manifest")
    return told


def profile(spark: SparkSession, source: str, target: str, lexicon_path: str | None = None, fix_only: bool = False, tags_path: str | None = None) -> DataFrame:
    """Signatures of the markdown files below source in target, and their rollup. fix_only leaves profiled ones as they are.

    With a table of tagged words (sentence, place, word, tag) a tagger is trained, for rare terms and odd tags.
    """
    docs = files.require(files.markdown(spark, source).select("path", "text"), "corpus")
    known = spark.read.parquet(lexicon_path) if lexicon_path else lexicon.corpus_lexicon(docs)
    todo = lexicon.unprofiled(docs, spark.read.parquet(target), "path") if fix_only else docs
    model = tagger.train(spark.read.parquet(tags_path)) if tags_path else None
    lexicon.profiled(todo, known, "path", tagger=model).write.mode("append" if fix_only else "overwrite").parquet(target)
    return lexicon.rollup(spark.read.parquet(target), "path")


def relate(spark: SparkSession, source: str, profiles: str, target: str) -> DataFrame:
    """The concept graph of a profiled corpus in target/nodes and target/edges; returns its metrics and coverage."""
    subject = graph.subjects(files.require(files.markdown(spark, source).select("path", "text"), "corpus"))
    rare = files.require(spark.read.parquet(profiles).select("path", "rare_terms"), "profiles")
    graph.nodes(subject, rare).write.mode("overwrite").parquet(f"{target}/nodes")
    node = spark.read.parquet(f"{target}/nodes")
    graph.edges(graph.mentions(subject, node)).write.mode("overwrite").parquet(f"{target}/edges")
    edge = spark.read.parquet(f"{target}/edges")
    return graph.metrics(edge, node).crossJoin(graph.coverage(subject))


def verify(spark: SparkSession, source: str) -> DataFrame:
    """Whether a dataset's folder is sound, and what is amiss."""
    return control.verify(files.layout(spark, source))


def _parsed_questions(completion: str) -> list[str]:
    """T.questions of one completion, in a model's worker."""
    chunks = (c.strip() for c in re.split("[Qq]?>", completion))
    bare = (re.sub(r"^\s*\d+[.)]?\s*", "", c.split("?")[0] + "?").strip() for c in chunks if "?" in c)
    return [q for q in bare if len(q) > 1]


def questions(spark: SparkSession, source: str, target: str, factory: Callable[[], generation.Model], profiles: str | None = None) -> DataFrame:
    """Questions on each paragraph of the markdown files below source, asked for until none is new, in target; returns counts.

    profiles: signatures by which thin documents are left out.
    """
    docs = files.require(files.markdown(spark, source).select("path", "text"), "corpus")
    if profiles:
        docs = lexicon.without_thin(docs, spark.read.parquet(profiles), "path")
    paragraph = docs.select("path", F.posexplode(markdown.paragraphs(F.col("text"))).alias("n", "context"))
    contexts = written(paragraph.select(F.concat("path", F.lit("#"), F.col("n").cast("string")).alias("context_id"), F.col("path").alias("source_doc"), "context"), "contexts")
    prompts = generation.question_prompts(files.require(contexts, "paragraphs"), "context_id", "context")
    found = written(generation.completed(prompts, "context_id", factory, _parsed_questions, generation.QUESTION_ATTEMPTS), "questions")
    contexts.join(found, "context_id").select("context_id", "source_doc", "context", F.col("found").alias("questions"), "attempts").write.mode("overwrite").json(target)
    return generation.loop_report(found, contexts)


QUESTIONS = "context_id string, source_doc string, context string, questions array<string>"
ANSWERED = "context_id string, source_doc string, context string, questions array<struct<question:string,answers:array<string>,rating:int,synthesis_answer:string,approved:boolean>>"


def _each_question(rows: DataFrame, *more: str) -> DataFrame:
    """A row a question, with key."""
    own = rows.select("context_id", "source_doc", "context", F.posexplode("questions").alias("place", "q"))
    return own.withColumn("key", F.concat("context_id", F.lit("?"), F.col("place").cast("string"))).select("key", "context_id", "source_doc", "context", "place", *more)


def answers(spark: SparkSession, source: str, target: str, factory: Callable[[], generation.Model]) -> DataFrame:
    """Candidate answers to the questions in source, asked for until none is new, as reviews in target; returns counts."""
    asked = written(_each_question(files.require(spark.read.schema(QUESTIONS).json(source), "questions"), F.col("q").alias("question")), "asked")
    found = written(generation.completed(generation.answer_prompts(asked, "key"), "key", factory, lambda reply: [a for a in [reply.strip()] if a], generation.ANSWER_ATTEMPTS, str.lower), "answers")
    one = F.struct("place", "question", F.col("found").alias("answers"), F.lit(0).alias("rating"), F.lit("").alias("synthesis_answer"), F.lit(False).alias("approved"))
    _reviews(asked.join(found, "key").withColumn("one", one)).write.mode("overwrite").json(target)
    return generation.loop_report(found, asked)


def _reviews(rows: DataFrame) -> DataFrame:
    """A context's questions in their order; a context has few."""
    listed = F.transform(F.array_sort(F.collect_list("one")), lambda q: q.dropFields("place"))
    return rows.groupBy("context_id", "source_doc", "context").agg(listed.alias("questions"))


def curate(spark: SparkSession, source: str, target: str, factory: Callable[[], generation.Model]) -> DataFrame:
    """Reviews in source with a model's rating and synthesis, in target; returns counts."""
    rows = files.require(spark.read.schema(ANSWERED).json(source), "reviews")
    asked = written(_each_question(rows, F.col("q.question").alias("question"), F.col("q.answers").alias("answers")), "reviewed")
    told = generation.replied(generation.curation_prompts(asked, "key"), "key", factory)
    grades = written(generation.graded(asked.join(told, "key")), "grades")
    one = F.struct("place", "question", "answers", "rating", "synthesis_answer", "approved")
    _reviews(grades.withColumn("one", one)).write.mode("overwrite").json(target)
    return generation.curation_report(grades, "context_id")


def assemble(spark: SparkSession, curated: str, target: str, valid: float = 0.1, seed: int = 42, system: str = chat.TRAINING_PROMPT) -> DataFrame:
    """Approved pairs of curated reviews as training records; returns counts, skipped ones included."""
    reviews = files.require(files.reviews(spark, curated, "*.json"), "curated reviews")
    if (bad := files.rejected_reviews(spark, curated, "*.json").count()) > 0:
        log.warning("%d files are no reviews", bad)
    pairs, skipped = dataset.reviewed_pairs(reviews)
    records = files.require(dataset.pair_records(pairs, system), "approved pairs")
    return _write(records, "messages", target, valid, seed).crossJoin(skipped)
