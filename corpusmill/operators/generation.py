"""Model stages: convergence over repeated completions, grading, and curation. Models are pluggable and fail closed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import chat
from corpusmill.functions import text as T
from corpusmill.shipping import ship

QUESTION_ATTEMPTS, ANSWER_ATTEMPTS, APPROVED = 10, 5, 4


class Model(Protocol):
    """Made once a worker process by a factory; an exception of complete() fails the job."""

    def complete(self, prompt: str, attempt: int) -> str: ...


def completed(prompts: DataFrame, key: str, factory: Callable[[], Model], parse: Callable[[str], list[str]], attempts: int, same: Callable[[str], str] = str) -> DataFrame:
    """key, found, attempts: completions are asked for until one adds nothing new, at most attempts times.

    prompts has key (a string) and prompt. same gives the form by which two finds are one.
    """
    ship(prompts.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            rows = []
            for name, prompt in zip(batch[key], batch["prompt"], strict=True):
                found: dict[str, str] = {}
                for attempt in range(1, attempts + 1):
                    before = len(found)
                    for one in parse(model.complete(prompt, attempt)):
                        found.setdefault(same(one), one)
                    if len(found) == before:
                        break
                rows.append((name, sorted(found.values()), attempt))
            yield pd.DataFrame(rows, columns=[key, "found", "attempts"])

    return prompts.select(F.col(key).cast("string").alias(key), "prompt").mapInPandas(run, f"{key} string, found array<string>, attempts int")


def converged(passes: DataFrame, key: str, attempt: str, found: Column, attempts: int) -> DataFrame:
    """key, found, attempts from recorded completions, a row a pass: everything up to the first pass that adds nothing new.

    A find is new in the pass of its first occurrence. Sets are deduplicated before they are gathered.
    """
    own = passes.select(key, F.row_number().over(Window.partitionBy(key).orderBy(attempt)).alias("pass"), F.array_distinct(found).alias("own")).filter(F.col("pass") <= attempts)
    first = own.select(key, "pass", F.explode("own").alias("item")).groupBy(key, "item").agg(F.min("pass").alias("pass"))
    adds = own.select(key, "pass").join(first.groupBy(key, "pass").agg(F.count(F.lit(1)).alias("new")), [key, "pass"], "left")
    stop = adds.groupBy(key).agg(F.min(F.when(F.col("new").isNull(), F.col("pass"))).alias("empty"), F.max("pass").alias("last")).select(key, F.coalesce("empty", "last").alias("attempts"))
    kept = first.join(stop, key).filter("pass <= attempts").groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("found"))
    return stop.join(kept, key, "left").select(key, F.coalesce("found", F.array().cast("array<string>")).alias("found"), "attempts")


def question_prompts(contexts: DataFrame, key: str, context: str = "text") -> DataFrame:
    return contexts.select(key, chat.filled(chat.QUESTION_PROMPT, context=F.col(context)).alias("prompt"))


def answer_prompts(questions: DataFrame, key: str) -> DataFrame:
    return questions.select(key, chat.filled(chat.ANSWER_PROMPT, question=F.col("question"), context=F.col("context")).alias("prompt"))


def curation_prompts(questions: DataFrame, key: str) -> DataFrame:
    return questions.select(key, chat.filled(chat.CURATION_PROMPT, context=F.col("context"), question=F.col("question"), answers=chat.bullets(F.col("answers"))).alias("prompt"))


def graded(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with rating, synthesis_answer and approved."""
    rated = replies.withColumn("rating", T.rating(F.col(reply))).withColumn("synthesis_answer", T.synthesis(F.col(reply)))
    return rated.withColumn("approved", F.col("rating") >= APPROVED)


def curation_report(grades: DataFrame, context: str) -> DataFrame:
    """contexts, questions_graded, approved."""
    return grades.agg(F.countDistinct(context).alias("contexts"), F.count(F.lit(1)).alias("questions_graded"), F.count_if("approved").alias("approved"))


def answers(reply: Column) -> Column:
    """The one answer that a completion is, lower-cased, as answers are told apart; none if it is blank."""
    return F.filter(F.array(F.lower(T.strip(reply))), lambda a: a != "")


def replied(prompts: DataFrame, key: str, factory: Callable[[], Model]) -> DataFrame:
    """key, reply: one completion a prompt."""
    own = completed(prompts, key, factory, lambda reply: [reply], 1)
    return own.select(key, F.coalesce(F.get("found", F.lit(0)), F.lit("")).alias("reply"))


def loop_report(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """contexts, skipped (without a find), total (finds), attempts."""
    counts = found.agg(F.count_if(F.size("found") == 0).alias("skipped"), F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("total"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))
    return contexts.agg(F.count(F.lit(1)).alias("contexts")).crossJoin(counts)
