"""Conversations: roles from hosts, merged turns, and records of either side."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.window import Window

from corpusmill.functions import chat, sentiment
from corpusmill.functions import text as T
from corpusmill.shipping import ship

# The shortest turn without a host, and the marker of a lost prompt.
LEAST_CHARS = 20
MARKER = "Original custom instructions no longer available"


def turns(messages: DataFrame, session: str = "conv_id", place: str = "turn", least_chars: int = LEAST_CHARS, marker: str = MARKER) -> DataFrame:
    """session, pos, role, content of rows with host and text.

    Rows are repaired and stripped; empty ones, short ones without a host and markers go. The first row with a host is the
    system prompt, later ones the user, rows without a host the assistant. Neighbours of one role are one turn, joined by
    a blank line; the system prompt never merges.
    """
    own = messages.select(session, place, "host", T.strip(T.repaired(F.coalesce("text", F.lit("")))).alias("text"))
    kept = own.filter((F.length("text") > 0) & (F.col("host").isNotNull() | (F.length("text") >= least_chars)) & ~F.col("text").contains(marker))
    order = Window.partitionBy(session).orderBy(place)
    first = (F.col("host").isNotNull()) & (F.sum(F.col("host").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    said = kept.withColumn("role", F.when(first, "system").when(F.col("host").isNull(), "assistant").otherwise("user"))
    new = (~F.col("role").eqNullSafe(F.lag("role").over(order))) | (F.col("role") == "system")
    island = said.withColumn("pos", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = island.groupBy(session, "pos", "role").agg(F.array_sort(F.collect_list(F.struct(place, "text"))).alias("rows"))
    return joined.select(session, "pos", "role", F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("content"))


def character_records(said: DataFrame, session: str = "conv_id", fallback: str | None = None) -> DataFrame:
    """session, messages: a record a session that has a user or assistant turn, led by the fallback prompt if none."""
    listed = said.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    own = listed.select(session, messages.alias("messages")).filter(F.exists("messages", lambda m: m["role"].isin("user", "assistant")))
    if fallback:
        led = F.concat(F.array(chat.message("system", F.lit(fallback))), F.col("messages"))
        own = own.withColumn("messages", F.when(F.get("messages", F.lit(0))["role"] == "system", F.col("messages")).otherwise(led))
    return own


def painter_records(said: DataFrame, session: str = "conv_id") -> DataFrame:
    """session, pos, messages: a record a user turn with everything before it, seen from the other side.

    User turns before anything else are no targets and never enter a history.
    """
    order = Window.partitionBy(session).orderBy("pos")
    opened = said.withColumn("_open", F.max((F.col("role") != "user").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_open = 1")
    seen = F.collect_list(F.struct(chat.inverted(F.col("role")).alias("role"), "content")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("messages", seen).filter(F.col("role") == "user").select(session, "pos", "messages")


def manifest(sessions: DataFrame, character: DataFrame, painter: DataFrame, session: str = "conv_id") -> DataFrame:
    """session, turns, character_records, painter_records."""
    count = lambda df, name: df.groupBy(session).agg(F.count(F.lit(1)).alias(name))
    out = count(sessions, "turns").join(count(character, "character_records"), session, "left").join(count(painter, "painter_records"), session, "left")
    return out.na.fill(0, ["character_records", "painter_records"])


def charges(said: DataFrame, lexicon: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    """key, charge of each row's text by the rules of sentiment, with a lexicon (word, valence) of any size.

    Only the words of a text that the lexicon has come back to it; a word listed twice has its greatest valence. Rows that share
    a key are one; a null text is empty, and an empty text has half a charge, as one without any neutral word.
    """
    ship(said.sparkSession)
    known = lexicon.groupBy(F.lower("word").alias("word")).agg(F.max(F.col("valence").cast("double")).alias("valence"))
    own = said.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_text")).dropDuplicates(key)
    felt = own.select(*key, F.explode(sentiment.spoken(F.col("_text"))).alias("word")).join(known, "word")
    felt = felt.groupBy(*key).agg(F.collect_list("word").alias("_words"), F.collect_list("valence").alias("_valences"))
    both = own.join(felt, key, "left").select(*key, "_text", "_words", "_valences")
    schema = T_.StructType([*(both.schema[k] for k in key), T_.StructField("charge", T_.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, values = (batch.column(len(key) + i).to_pylist() for i in range(3))
            found = [sentiment.charge(t, dict(zip(w or (), v or (), strict=True))) for t, w, v in zip(texts, words, values, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(key))), pa.array(found, pa.float64())], [*key, "charge"])

    return both.mapInArrow(run, schema)


def rewards(said: DataFrame, lexicon: DataFrame, key: list[str], order: list[str], text: str = "content") -> DataFrame:
    """key, reward: length up to 200 characters for 0.4, charge for 0.4, 0.2 for a text not seen before (in order); empty 0.

    The first row of each text is found by its digest and joined back by key, so no task gets all rows of a frequent text.
    """
    names = [*order, *(k for k in key if k not in order)]
    first = said.groupBy(F.sha2(F.lower(text), 256)).agg(F.min(F.struct(*names)).alias("first")).select(*(F.col(f"first.{k}").alias(k) for k in key), F.lit(0.2).alias("novelty"))
    both = said.join(first, key, "left").join(charges(said, lexicon, key, text), key)
    length = F.least(F.length(text) / F.lit(200.0), F.lit(1.0)) * 0.4
    return both.select(*key, F.when(F.length(text) > 0, F.least(length + F.col("charge") * 0.4 + F.coalesce("novelty", F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("reward"))


def high_reward(scored: DataFrame, threshold: float = 0.6) -> DataFrame:
    return scored.filter(F.col("reward") >= threshold)
