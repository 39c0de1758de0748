"""Training records: sections, chunks, whole documents, reviewed pairs, signatures, and the train/validation split."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import chat, markdown
from corpusmill.functions import text as T
from corpusmill.storage import written

# Wording of the records.
SYSTEM_PROMPT = "You are a helpful assistant."
#: Records of the last range that a split ranks, and digits of a hash.
RANKED, DIGITS = 4096, 32


def word_chunks(words: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of size words (or token ids), each starting size - overlap after the last, until one reaches the end."""
    step = size - overlap
    n = F.size(words)
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(words, i * step + 1, F.lit(size)))
    return F.filter(windows, lambda w: F.size(w) > 0)


def chunk_records(docs: DataFrame, size: int = 500, overlap: int = 50, key: str = "doc_id", encode: Callable[[Column], Column] = T.parts, decode: Callable[[Column], Column] = lambda words: F.array_join(words, " ")) -> DataFrame:
    """key, chunk (from 1), chunks, text: each chunk under a head that names its document.

    encode gives a text's tokens (words or ids) and decode a chunk's text.
    """
    words = docs.select(key, encode(F.col("text")).alias("words"))  # a step of its own: each window refers to it
    chunks = words.select(key, word_chunks(F.col("words"), size, overlap).alias("all")).select(key, F.size("all").alias("chunks"), "all")
    # Outer: the filter inferred for an inner one computes all chunks again. Counted before: rows don't carry all chunks.
    each = chunks.select(key, "chunks", F.posexplode_outer("all").alias("place", "words")).filter("place is not null")
    head = F.format_string("Document: %s\nChunk %d/%d\n---\n", F.col(key).cast("string"), F.col("place") + 1, F.col("chunks"))
    return each.select(key, (F.col("place") + 1).alias("chunk"), "chunks", F.concat(head, decode(F.col("words"))).alias("text"))


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, header, headers_path, content of markdown texts; sections without content are left out.

    Headings are one to six # and white space at the start of a line. The path holds the headings above: a heading of level
    n ends those of its level and deeper. Text before any heading has the header Introduction and no path.

    Each document is walked once, line by line, by itself: nothing is shuffled.
    """
    own = docs.select(key, markdown.sections(F.col("text")).alias("all"))  # a step of its own: the filter would walk again
    each = own.select(key, F.posexplode_outer("all").alias("section", "s"))
    return each.filter(F.col("s.content") != "").select(key, "section", "s.header", "s.headers_path", "s.content")


def section_records(docs: DataFrame, system: str = SYSTEM_PROMPT, key: str = "doc_id") -> DataFrame:
    """key, section, messages."""
    path = F.when(F.size("headers_path") > 0, F.array_join("headers_path", " -> ")).otherwise(F.col("header"))
    prompt = F.concat(F.lit("In the document '"), F.col(key).cast("string"), F.lit("' under '"), path, F.lit("', what is written?"))
    return sections(docs, key).select(key, "section", chat.exchange(system, prompt, F.col("content")).alias("messages"))


def document_records(docs: DataFrame, system: str = SYSTEM_PROMPT, key: str = "doc_id") -> DataFrame:
    """key, messages: the whole stripped text as the answer; blank texts are left out."""
    body = docs.select(key, T.strip(F.col("text")).alias("body")).filter(F.length("body") > 0)
    prompt = F.concat(F.lit("Retrieve the complete content of the note/document '"), F.col(key).cast("string"), F.lit("'."))
    return body.select(key, chat.exchange(system, prompt, F.col("body")).alias("messages"))


def reviewed_pairs(reviews: DataFrame, key: str = "context_id") -> tuple[DataFrame, DataFrame]:
    """Pairs (key, question, answer) of approved questions with an answer, and a one-row count of the others (skipped).

    The answer is the synthesis, else the first candidate.
    """
    each = reviews.select(key, F.explode("questions").alias("q"))
    text = lambda c: T.strip(F.coalesce(c, F.lit("")))
    own = each.select(key, F.coalesce("q.approved", F.lit(False)).alias("approved"), text(F.col("q.question")).alias("question"), F.coalesce(F.nullif(text(F.col("q.synthesis_answer")), F.lit("")), text(F.get("q.answers", F.lit(0)))).alias("answer"))
    good = F.col("approved") & (F.col("question") != "") & (F.col("answer") != "")
    return own.filter(good).drop("approved"), own.agg(F.count_if(~good).alias("skipped"))


def pair_records(pairs: DataFrame, system: str = chat.TRAINING_PROMPT, plain: bool = False) -> DataFrame:
    """messages of question and answer, or plain text."""
    if plain:
        return pairs.withColumn("text", F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer: "), F.col("answer"))).drop("question", "answer")
    return pairs.withColumn("messages", chat.exchange(system, F.col("question"), F.col("answer"))).drop("question", "answer")


def signature_records(profiles: DataFrame, system: str = SYSTEM_PROMPT, title: str = "title", plain: bool = False) -> DataFrame:
    """title, record (1 overview, 2 list of rare terms, if any), messages; or title and one text block."""
    name, listed, rare = F.col(title).cast("string"), F.array_join("rare_terms", ", "), F.size("rare_terms") > 0
    if plain:
        block = F.concat(F.lit("Taxonometry Profile for '"), name, F.format_string("':\n- Zipf Average: %.3f\n- Rarity Position: %.5f", "zipf_avg", "rarity_pos"), F.when(rare, F.concat(F.lit("\n- Rare Terms: "), listed)).otherwise(""))
        return profiles.select(title, block.alias("text"))
    overview = F.concat(F.lit("The document '"), name, F.format_string("' has a Zipf average of %.3f and rarity position of %.5f.", "zipf_avg", "rarity_pos"), F.when(rare, F.concat(F.lit(" Its rare terms include: "), listed, F.lit("."))).otherwise(""))
    first = F.struct(F.lit(1).alias("record"), chat.exchange(system, F.concat(F.lit("What is the taxonometric profile of the document '"), name, F.lit("'?")), overview).alias("messages"))
    second = F.struct(F.lit(2).alias("record"), chat.exchange(system, F.concat(F.lit("List the rare terms associated with the document '"), name, F.lit("'.")), F.concat(F.lit("The rare terms associated with the document '"), name, F.lit("' are: "), listed, F.lit("."))).alias("messages"))
    return profiles.select(title, F.explode(F.when(rare, F.array(first, second)).otherwise(F.array(first))).alias("r")).select(title, "r.record", "r.messages")


def split(records: DataFrame, key: Column, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """records with split (train or valid): by the rank of a seeded hash of key, the first int(n * (1 - valid)) train.

    Of two or more records one at least is valid. Only the hash and key at the cut are looked for: hashes are counted by their
    first digits, and further by digits of the one range that holds the cut, until it is small. Then each record is told by
    itself, and none moves. Records that share a key are on one side together (so sizes are exact for distinct keys); those
    with a null key are valid.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    keys = written(records.select(digest.alias("hash"), key.alias("key")), "keys")
    n = keys.count()
    cut = min(math.floor(n * (1 - valid)), n - 1 if n > 1 else n)
    if cut <= 0:
        return records.withColumn("split", F.lit("valid"))
    prefix, before, size = "", 0, n
    while size > RANKED and len(prefix) < DIGITS:
        more = F.substring("hash", 1, len(prefix) + 3)
        sizes = keys.filter(F.col("hash").startswith(prefix)).groupBy(more.alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # 4096 rows at most
        for range_, size in sizes:
            if before + size >= cut:
                break
            before += size
        prefix = range_
    inside = keys.filter(F.col("hash").startswith(prefix) if len(prefix) < DIGITS else F.col("hash") == prefix)
    last = inside.groupBy("hash", "key").agg(F.count(F.lit(1)).alias("n")).orderBy("hash", "key").collect()  # RANKED rows at most
    for hash_, at, size in last:
        before += size
        if before >= cut:
            break
    trains = (digest < hash_) | ((digest == hash_) & (key <= F.lit(at)))
    return records.withColumn("split", F.when(trains, "train").otherwise("valid"))
